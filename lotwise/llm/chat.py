"""Chat formatting in budgeted windows: turn-aligned spans by prefix sums, with history and loss masks.

A conversation's turns follow each other by turn number. Prefix sums of their tokens deal them into segments of
SEGMENT_WINDOWS budgets, so that a conversation of any length is many rows of bounded size; within a segment windows are filled
turn by turn. A window begins with the conversation's system turn, then repeats as many of the latest turns before it as
`history` tokens hold, then has its own turns up to the budget. Only the assistant's own turns are under the loss mask: a
turn that is repeated as history is masked there, so each target counts once.

A turn is written OPEN role CLOSE text END, a window starts with BEGIN. Inside roles and texts a backslash follows each
backslash, `<` and `[`, so no control string can occur in them, and unescaped() gives them back.

Only conversations longer than a segment need prefix sums; their turns' sizes, not their texts, are scanned.
The segments are dealt to tasks by conversation and number, and one segment at a time is in a task's memory.

Defined results: null texts and roles are empty; turns are never cut: one that is longer than the budget has a window of its own,
over the budget, without history; turns with equal numbers follow by role and text; repeated rows are turns of
their own, in one segment; a null conversation id is a conversation of its own; only a first turn is the system turn, others are turns like
any; an empty table has no rows; further columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import prefix_scan
from .common import WS, small_side, written

#: The template's control strings.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
#: Tokens of a window, of the history that it repeats, and of what marks a turn; windows that a segment holds.
BUDGET, HISTORY, MARKS, SEGMENT_WINDOWS = 512, 128, 4, 64
TARGET, SYSTEM = "assistant", "system"

_SPAN = T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])
_WINDOW = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("loss", T.ArrayType(_SPAN)), T.StructField("repeated", T.IntegerType()), T.StructField("tokens", T.LongType()),
])
_SEGMENT = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("large", T.BooleanType()), T.StructField("windows", T.ArrayType(_WINDOW))])
_ARROW_WINDOWS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("repeated", pa.int32()), ("tokens", pa.int64())]))
_DIGEST = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
    T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()), T.StructField("n_windows", T.LongType()), T.StructField("n_repeated", T.LongType()),
])


def escaped(text: str) -> str:
    return re.sub(r"[\\<\[]", r"\g<0>\\", text)


def unescaped(text: str) -> str:
    return re.sub(r"([\\<\[])\\", r"\1", text)


def turn_tokens(text_col: str = "text") -> Column:
    """The default token measure: words of the text, and what marks the turn."""
    return (F.coalesce(F.regexp_count(F.col(text_col), F.lit(f"[^{WS}]+")), F.lit(0)) + MARKS).cast("long")


class Turn:
    __slots__ = ("own", "role", "text", "tokens")

    def __init__(self, role: str | None, text: str | None, tokens: int, own: bool):
        self.role, self.text, self.tokens, self.own = role or "", text or "", tokens, own


def _formatted(system: Turn | None, history: list[Turn], own: list[Turn], first: bool) -> dict:
    """A window's text, its loss spans in code points, and how many of its turns are repeated."""
    parts, at, loss = [BEGIN], len(BEGIN), []
    repeated = len(history) + (system is not None and not first)
    for i, t in enumerate([*([system] if system else []), *history, *own]):
        head, body = f"{OPEN}{escaped(t.role)}{CLOSE}", escaped(t.text)
        if i >= repeated and t.role == TARGET:
            loss.append({"s": at + len(head), "e": at + len(head) + len(body)})
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return {"text": "".join(parts), "loss": loss, "repeated": repeated, "tokens": sum(t.tokens for t in [*([system] if system else []), *history, *own])}


def windows_of(turns: list[Turn], first: bool, budget: int, history: int) -> list[dict]:
    """The windows of a segment: of its turns in order, those of other segments (not own) first; first: the conversation starts here."""
    system = turns[0] if turns and turns[0].role == SYSTEM and (turns[0].own == first) else None
    rest = turns[1:] if system else turns
    held = system.tokens if system else 0
    out, i = [], next((j for j, t in enumerate(rest) if t.own), len(rest))
    while i < len(rest):
        # the latest turns that both the history and the first own turn leave room for
        room, start = min(history, budget - held - rest[i].tokens), i
        while start and rest[start - 1].tokens <= room:
            start -= 1
            room -= rest[start].tokens
        left, end = budget - held - sum(t.tokens for t in rest[start:i]) - rest[i].tokens, i + 1
        while end < len(rest) and rest[end].tokens <= left:
            left -= rest[end].tokens
            end += 1
        out.append(_formatted(system, rest[start:i], rest[i:end], first and not out))
        i = end
    return out or ([_formatted(system, [], [], True)] if first and system else [])


def _segments(batches: Iterator[pa.RecordBatch], budget: int, history: int) -> Iterator[pa.RecordBatch]:
    """Windows of the segments, whose rows follow each other."""
    now, turns = None, []

    def closed():
        conv, segment, large = now
        found = windows_of(turns, segment == 0, budget, history)
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([segment], pa.int64()), pa.array([large]), pa.array([found], _ARROW_WINDOWS)], names=_SEGMENT.names)

    for batch in batches:
        for conv, segment, large, own, role, text, tokens in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (conv, segment, large) != now:
                if now is not None and any(t.own for t in turns):
                    yield closed()
                now, turns = (conv, segment, large), []
            turns.append(Turn(role, text, tokens, own))
    if now is not None and any(t.own for t in turns):
        yield closed()


def segment_windows(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens: Column | None = None, budget: int = BUDGET, history: int = HISTORY, per_segment: int = SEGMENT_WINDOWS
) -> DataFrame:
    """One row conv_id, segment, large, windows for each segment; large: the conversation has several segments.

    windows: array<struct<text, loss, repeated, tokens>> in order; the first `repeated` turns of a window are not its own.
    """
    if not 0 <= history < budget * per_segment:
        raise ValueError("the history has to be shorter than a segment")
    own = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
        (turn_tokens(text_col) if tokens is None else tokens.cast("long")).alias("tokens"),
    )
    own = own.withColumn("tokens", F.greatest("tokens", F.lit(1))).withColumn("key", F.xxhash64("role", "text"))
    length = budget * per_segment
    sizes = own.select("conv_id", "turn", "key", "tokens", (F.col("role") == SYSTEM).alias("system"))
    large = sizes.groupBy("conv_id").agg(F.sum("tokens").alias("all")).where(F.col("all") > length)
    large = small_side(written(large.withColumnsRenamed({"conv_id": "of"}), "chat-large"))
    # equal rows share a place, so that a turn number's join stays one to one
    scanned = sizes.join(large, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi").groupBy("conv_id", "turn", "key", "system").agg(F.sum("tokens").alias("tokens"))
    placed = prefix_scan(scanned, ["conv_id"], ["turn", "key"], {"start": ("before", F.col("tokens"))}, most=0)
    last = placed.groupBy("conv_id").agg(F.floor(F.max("start") / length).alias("last")).withColumnRenamed("conv_id", "of")
    placed = written(placed.select("conv_id", "turn", "key", "system", "start"), "chat-places")
    placed = placed.join(small_side(written(last, "chat-last")), F.col("conv_id").eqNullSafe(F.col("of")))
    number = F.floor(F.col("start") / length)
    # the next segment takes what may be its history; all take the system turn
    upto = F.when(F.col("system") & (F.col("start") == 0), F.col("last")).otherwise(F.least(F.col("last"), F.floor((F.col("start") + history) / length)))
    placed = placed.select(F.col("conv_id").alias("of"), F.col("turn").alias("turn_of"), F.col("key").alias("key_of"), number.alias("number"), upto.alias("upto"))
    side = small_side(written(placed, "chat-segments"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & F.col("turn").eqNullSafe(F.col("turn_of")) & (F.col("key") == F.col("key_of"))
    dealt = own.join(side, same, "left").withColumns({"number": F.coalesce("number", F.lit(0).cast("long")), "large": F.col("of").isNotNull() | F.col("key_of").isNotNull()})
    dealt = dealt.withColumn("segment", F.explode(F.sequence("number", F.coalesce("upto", "number"))))
    order = ["conv_id", "segment", "turn", "key"]
    rows = dealt.select("conv_id", "segment", "large", (F.col("segment") == F.col("number")).alias("own"), "role", "text", "tokens", "turn", "key")
    rows = rows.repartition("conv_id", "segment").sortWithinPartitions(*order).drop("turn", "key")
    return rows.mapInArrow(partial(_segments, budget=budget, history=history), _SEGMENT)


def exploded(segments: DataFrame) -> DataFrame:
    """One row conv_id, segment, window, text, loss, repeated, tokens for each window."""
    return segments.select("conv_id", "segment", F.posexplode("windows").alias("window", "w")).select("conv_id", "segment", "window", "w.*")


def read_window(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a window's turns."""
    if not text.startswith(BEGIN):
        raise ValueError("not a window")
    turns = text[len(BEGIN) :].split(END)[:-1]
    return [tuple(map(unescaped, t.removeprefix(OPEN).split(CLOSE, 1))) for t in turns]


class _Digest:
    """What is read back from a conversation's windows, one after the other."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss = conv, sha256(), sha256()
        self.n = self.loss_chars = self.chars = self.windows = self.repeated = 0

    def add(self, window: dict) -> None:
        text = window["text"]
        for role, said in read_window(text)[window["repeated"] :]:
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n += 1
        for span in window["loss"]:
            target = unescaped(text[span["s"] : span["e"]])
            self.loss.update(target.encode())
            self.loss_chars += len(target)
        self.chars += len(text)
        self.windows += 1
        self.repeated += window["repeated"]

    def row(self) -> list:
        return [self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.windows, self.repeated]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    listed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DIGEST_ARROW, strict=True)], names=_DIGEST.names)
    for batch in batches:
        done = []
        for conv, segment, windows in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if now is None or segment == 0 or conv != now.conv:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv)
            for window in windows:
                now.add(window)
        if done:
            yield listed(done)
    if now is not None:
        yield listed([now.row()])


_DIGEST_ARROW = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def digests(segments: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its windows: turns, their hash, the loss mask's text, its hash, characters and windows.

    A hash runs over a conversation's windows in order, one segment at a time, so it needs no memory for the conversation.
    """
    whole = segments.where(~F.col("large")).select("conv_id", "segment", "windows")
    several = segments.where("large").select("conv_id", "segment", "windows").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return whole.mapInArrow(_digests, _DIGEST).unionByName(several.mapInArrow(_digests, _DIGEST))
