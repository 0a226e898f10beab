"""Job intake: the stream against the batch functions, replays, lines that are no objects."""

import json

from pyspark.sql import functions as F

from lotwise.streaming import intake


def test_intake_and_replay(spark, tmp_path):
    lines = [{"request_id": "r1", "record_key": k, "payload": "p"} for k in (" a ", "b", "b", "", "gone", "done")] + [{"request_id": "r2", "record_key": "a"}, {"request_id": "r2", "record_key": None}]
    lines += [{"request_id": "r3", "record_key": f"k{i}"} for i in range(26)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text("\n".join(map(json.dumps, lines)))
    jobs = spark.createDataFrame([("a", "dispatching"), ("b", "dispatching"), ("done", "completed"), ("k1", "dispatching")], "record_key string, status string")
    path = f"file://{tmp_path}/out"
    stream = intake.request_stream(spark, f"file://{tmp_path}/in")
    found = lambda: sorted((x.request_id or "", x.record_key or "", x.outcome) for n in (intake.ACCEPTED, intake.REFUSED) for x in intake.taken_in(spark, path, n, stream.schema).collect())
    intake.intake(stream, lambda: jobs, path)
    want = [("r1", "", "blank_key"), ("r1", "a", "accepted"), ("r1", "b", "duplicate_key"), ("r1", "b", "duplicate_key"), ("r1", "done", "status_completed"), ("r1", "gone", "not_found"), ("r2", "", "blank_key"), ("r2", "a", "accepted"), *(("r3", f"k{i}", "too_many_jobs") for i in range(26))]
    assert found() == sorted(want)
    # the batch functions on the same rows say the same, and a batch that comes again replaces itself
    rows = spark.createDataFrame([(x["request_id"], x["record_key"], x.get("payload"), json.dumps(x)) for x in lines], "request_id string, record_key string, payload string, line string")
    assert sorted((x.request_id, x.record_key or "", x.outcome) for x in intake.told(rows, jobs).collect()) == sorted(want)
    intake.land(rows, 0, jobs, path)
    assert found() == sorted(want)
    # more lands later, one line of it broken
    (tmp_path / "in" / "two.json").write_text('not json\n{"request_id": "r4", "record_key": "b"}')
    intake.intake(intake.request_stream(spark, f"file://{tmp_path}/in"), lambda: jobs, path)
    assert found() == sorted([*want, ("", "", "blank_key"), ("r4", "b", "accepted")])
    refused = intake.taken_in(spark, path, intake.REFUSED, stream.schema)
    assert refused.where("line = 'not json'").count() == 1 and refused.select(F.max("batch")).first()[0] == 1
