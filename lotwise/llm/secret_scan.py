"""Secret scans with multipart credential linking, with DataFrame functions only.

Base spans (assignments, access keys, hexadecimal strings) stand on their own.
Weak parts (an account or user name, a random-looking string, an endpoint) are
reported only where the complementary parts of a credential meet: within `reach`
code points from the end of one to the start of the other, and the same block of text
(blocks are separated by blank lines). The interval join is a pair of range windows over
the starts and ends of one block's parts, so no pairs are enumerated. An identifier and
a secret that overlap are one string and do not meet; an endpoint may hold the others.

Defined results: null and empty texts have no spans; repeated rows get equal spans;
rows that share an id but not a text are kept apart; an empty table stays empty;
columns that clash with the new ones are replaced, others pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WS, fresh, joined, small_side, spans, text_key, written

KINDS = ("assign", "access", "hex")
#: Fixed patterns: expression and cheap probe of each base kind.
PATTERNS = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++", r"(?i)passw|secret|token|api_?key"),
    "access": (r"AKIA[A-Z0-9]++", "AKIA"),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{32,}+", None),
}
VALUE = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?"
#: Weak parts: role, expression, probe. Roles complement each other.
WEAK = {
    "identifier": (r"(?i:\b(?:user(?:_?name)?|login|account(?:_?(?:id|name))?|client_?id|access_?key(?:_?id)?))[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.@=-]{3,}+", r"(?i)user|login|account|client|access"),
    "secret": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*?[a-z])(?=[A-Za-z0-9+/_-]*?[A-Z])(?=[A-Za-z0-9+/_-]*?[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![A-Za-z0-9+/=_-])", r"[A-Za-z0-9+/_-]{16}"),
    "endpoint": (rf"(?i:\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis)://)[^{WS}\"'<>]++|(?i:\b(?:host(?:name)?|endpoint|server))[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9._:/-]{{4,}}+", r"(?i)://|host|endpoint|server"),
}
#: Which role a base span plays.
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret"}
ROLES = ("identifier", "secret", "endpoint")
REACH = 200


def _kept(kind: str, v: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_replace(v, VALUE, "")) >= 8
    return F.length(v) >= (16 if kind == "access" else 32)


def base_spans(text: Column, kind: str) -> Column:
    pattern, probe = PATTERNS[kind]
    return F.transform(F.filter(spans(text, pattern, probe), lambda x: _kept(kind, x["v"])), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def _breaks(text: Column) -> Column:
    """Where blocks end."""
    return F.transform(spans(text, rf"\n[\x20\t\r]*+\n", r"\n[\x20\t\r]*+\n"), lambda x: x["s"])


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The parts (id, k, block, s, role, ...) near which, within reach, stand parts of the complementary roles.

    An identifier needs a secret and a secret an identifier; an endpoint needs both.
    """
    sides = F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(True).alias("start")), F.struct(F.col("e").alias("at"), F.lit(False).alias("start"))))
    rows = parts.withColumn("_x", sides).select(*parts.columns, "_x.at", "_x.start")
    near = Window.partitionBy("id", "k", "block").orderBy("at")
    after = lambda role: F.max((F.col("role") == role) & F.col("start")).over(near.rangeBetween(0, reach))
    before = lambda role: F.max((F.col("role") == role) & ~F.col("start")).over(near.rangeBetween(-reach, 0))
    for role in ("identifier", "secret"):
        apart = F.when(F.col("start"), F.col(f"_{role}_before")).otherwise(F.col(f"_{role}_after"))
        inside = (F.col("role") == "endpoint") & (F.col(f"_{role}_before") | F.col(f"_{role}_after"))
        rows = rows.withColumn(f"_{role}_before", before(role)).withColumn(f"_{role}_after", after(role)).withColumn(f"_{role}", apart | inside)
    met = rows.groupBy(*parts.columns).agg(F.max("_identifier").alias("_identifier"), F.max("_secret").alias("_secret"))
    needs = F.when(F.col("role") == "identifier", F.col("_secret")).when(F.col("role") == "secret", F.col("_identifier")).otherwise(F.col("_identifier") & F.col("_secret"))
    return met.where(needs).select(*parts.columns)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row (id, key, `secrets`) for each row of docs: the kinds' base spans and `found`, the linked weak ones."""
    own = docs.select(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("key"), F.col(text_col).alias("t"))
    weak = {role: spans(F.col("t"), *WEAK[role]) for role in ROLES}
    raw = own.select("id", "key", "t", *[base_spans(F.col("t"), kind).alias(kind) for kind in KINDS], *[F.transform(weak[r], lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(r) for r in ROLES])
    some = reduce(lambda a, b: a | b, [F.size(x) > 0 for x in (*KINDS, *ROLES)])
    held = written(raw.select("id", "key", *KINDS, *ROLES, F.when(some, _breaks(F.col("t"))).alias("breaks")), "secrets-base")
    taken = lambda x: reduce(lambda a, b: a | b, [F.exists(F.col(kind), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])) for kind in KINDS])
    part = lambda items, role, strong: F.transform(items, lambda x: F.struct(F.lit(role).alias("role"), F.lit(strong).alias("strong"), x["s"].alias("s"), x["e"].alias("e"), F.size(F.filter("breaks", lambda b: b < x["s"])).alias("block")))
    sides = [part(F.col(kind), ROLE[kind], True) for kind in KINDS] + [part(F.filter(role, lambda x: ~taken(x)), role, False) for role in ROLES]
    parts = held.where(some).select("id", F.col("key").alias("k"), F.explode(F.concat(*sides)).alias("x")).select("id", "k", "x.*").distinct()
    found = linked(parts, reach).where(~F.col("strong")).groupBy("id", "k").agg(F.array_sort(F.collect_set(F.struct("s", "role", "e"))).alias("found"))
    found = small_side(written(found.withColumnRenamed("id", "id_"), "secrets-found"))
    out = held.join(found, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("id_")), "left")
    nothing = F.expr("cast(array() as array<struct<s:bigint,role:string,e:bigint>>)")
    return out.select(F.col("id").alias(id_col), "key", F.struct(*KINDS, F.coalesce("found", nothing).alias("found")).alias("secrets"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of what secret_scan() returned."""
    tag = lambda items, rank, kind: F.transform(items, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind")))
    base = [tag(F.col(f"secrets.{kind}"), i, kind) for i, kind in enumerate(KINDS)]
    more = F.transform("secrets.found", lambda x: F.struct(x["s"].alias("s"), (F.lit(len(KINDS) - 1) + F.array_position(F.array(*[F.lit(r) for r in ROLES]), x["role"]).cast("int")).alias("rank"), x["e"].alias("e"), x["role"].alias("kind")))
    text = lambda items: F.concat_ws(",", F.transform(F.array_sort(items), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))
    return scanned.select(
        id_col,
        *[F.size(f"secrets.{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(text(F.concat(*base)), 256).alias("base_sha256"),
        text(F.concat(*base, more)).alias("spans"),
        F.size("secrets.found").cast("long").alias("n_found"),
    )


def merged(items: Column) -> Column:
    """Spans (sorted by start) with overlapping ones united."""
    empty = F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        own = F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))
        longer = F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e")))
        return F.when(F.size(acc) == 0, own).when(x["s"] < last["e"], F.concat(F.slice(acc, 1, F.size(acc) - 1), longer)).otherwise(F.concat(acc, own))

    return F.aggregate(items, empty, step)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, by: str = "[secret]") -> DataFrame:
    """docs whose secrets, base and linked, read `by`; all columns and rows stay.

    Only what the linking found is joined to the texts; base spans are found in place.
    """
    from .personal_data import replaced

    key, own, more, ident, union = fresh(docs, "_key", "_own", "_more", "_id", "_spans")
    found = secret_scan(docs, id_col, text_col, reach).where(F.size("secrets.found") > 0)
    found = written(found.select(F.col(id_col).alias(ident), F.col("key").alias(key), F.transform("secrets.found", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(more)).distinct(), "secrets-join")
    keyed = docs.withColumn(own, text_key(id_col, text_col))
    out = keyed.join(small_side(found), (F.col(key) == F.col(own)) & F.col(ident).eqNullSafe(F.col(id_col)), "left")
    every = F.array_sort(F.concat(*[base_spans(F.col(text_col), kind) for kind in KINDS], F.coalesce(F.col(more), F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"))))
    out = out.withColumn(union, merged(every)).withColumn(text_col, replaced(F.col(text_col), F.col(union), F.lit(by)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
