"""Chat windows: round trips, budgets, history and masks against a plain reading."""

import random
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lotwise.llm import chat, queries

TURNS = "conv_id long, turn long, role string, text string"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\<[/]sINT>a\n", max_size=40))
def test_escaping(text):
    out = chat.escaped(text)
    assert chat.unescaped(out) == text and not any(c in out for c in (chat.BEGIN, chat.OPEN, chat.CLOSE, chat.END))


def plain_digest(turns):
    """What the contract says of a conversation's (role, text), in order."""
    h = sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), h, len(loss), sha256(loss.encode()).hexdigest()


def in_order(rows):
    """Conversations with their turns; the numbers differ or the rows are equal."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        out.setdefault(conv, []).append((role, text))
    return out


def some_rows(seed):
    r = random.Random(seed)
    words = lambda n: " ".join(r.choice(["a", "</s>", "[INST]", "\\", "é", "b\n", "<s>[/INST]"]) for _ in range(n))
    rows = []
    for conv in range(12):
        start = 1 if conv % 3 == 0 else 0
        if start:
            rows.append((conv, 0, "system", words(6)))
        n = 700 if conv == 6 else r.randint(0, 9)
        rows += [(conv, start + i, "user" if i % 2 == 0 else "assistant", words(r.randint(0, 30) if r.random() < 0.97 else 90)) for i in range(n)]
    rows += [(None, 0, "user", None), (None, 1, None, "x"), (20, None, "assistant", ""), (20, 3, "system", "late"), (21, 0, "user", "twice"), (21, 0, "user", "twice"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("budget,history,per_segment", [(60, 20, 2), (60, 0, 4), (512, 128, 64), (100, 60, 1)])
def test_windows(spark, budget, history, per_segment):
    rows = some_rows(budget)
    df = spark.createDataFrame(rows, TURNS).withColumns({"key": F.lit(1), "start": F.lit("x"), "of": F.lit(None).cast("long")}).repartition(5)
    segments = chat.segment_windows(df, budget=budget, history=history, per_segment=per_segment)
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat.digests(segments).collect()}
    want = in_order(rows)
    assert got == {conv: plain_digest(turns) for conv, turns in want.items()}
    by = {}
    for w in sorted(chat.exploded(segments).collect(), key=lambda w: (w.segment, w.window)):
        by.setdefault(w.conv_id, []).append(w)
    count = lambda t: len((t or "").split()) + chat.MARKS
    for conv, windows in by.items():
        turns = [(r or "", t or "") for r, t in want[conv]]
        system = turns[0] if turns[0][0] == "system" else None
        done = 0
        for i, w in enumerate(windows):
            said = chat.read_window(w.text)
            new = said[w.repeated :]
            assert said[0] == system or system is None
            assert w.tokens == sum(count(t) for _, t in said) and (w.tokens <= budget or len(new) == 1 and w.repeated <= (system is not None))
            past = said[(system is not None) : w.repeated] if i else []
            assert past == turns[done - len(past) : done] and sum(count(t) for _, t in past) <= history
            # one more turn would not fit, nor be within the segment
            assert new == turns[done : done + len(new)]
            assert [chat.unescaped(w.text[x.s : x.e]) for x in w.loss] == [t for r, t in new if r == "assistant"]
            done += len(new)
        assert done == len(turns)
    if per_segment == 2:
        assert max(w.segment for w in by[6]) > 20 and all(len(s.windows) <= 2 * per_segment + 2 for s in segments.collect())


def test_history_is_repeated_across_segments(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"w{i} " * 6) for i in range(60)]
    windows = chat.exploded(chat.segment_windows(spark.createDataFrame(rows, TURNS), budget=30, history=10, per_segment=1)).collect()
    later = [w for w in windows if w.segment or w.window]
    assert {w.segment for w in windows} > {0, 1, 2} and all(w.repeated == 1 for w in later)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], TURNS)
    assert chat.digests(chat.segment_windows(empty)).count() == 0
    alone = chat.exploded(chat.segment_windows(spark.createDataFrame([(1, 0, "system", "s")], TURNS))).collect()
    assert [(w.text, w.repeated) for w in alone] == [("<s>[INST]system[/INST]s</s>", 0)]
    with pytest.raises(ValueError, match="history"):
        chat.segment_windows(empty, budget=10, history=10, per_segment=1)


def test_query(spark):
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in queries.op11_chat_formatting(spark, "/root/testdata/sf0.01").collect()}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + queries.PLANTED_TURNS
    assert got == {conv: plain_digest(turns) for conv, turns in in_order(rows).items()} and -7 in got
