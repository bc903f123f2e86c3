"""Chats as training text: a compiled template over turns, with spans to learn, and reading them back.

Turns are rendered where they lie, one row each, so a conversation that holds a third of all rows is
rendered by all tasks. Only a template that asks for a turn's place needs places: turns are counted in
stretches of ``STRETCH`` turn numbers, the counts (not the texts) are summed along a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailfleet.llm.template import Template

STRETCH = 256
TURN, ROLE_END, TURN_END = "### ", ": ", "</turn>"
#: Turns as ``### role: text</turn>``; what an assistant says is learned.
TEMPLATE = Template(
    "{% for m in messages %}" + TURN + "{{ m.role | escape }}" + ROLE_END
    + "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    + "{% else %}{{ m.text | escape }}{% endif %}" + TURN_END + "\n{% endfor %}", (TURN, ROLE_END, TURN_END))

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ORDER = ["part", "turn", "role", "tie"]


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with ``_index`` (from 0) and ``_length`` of their conversation."""
    own = ["conv_id", "_stretch"]
    turns = turns.withColumn("_stretch", F.floor(F.coalesce("turn", F.lit(-1)) / STRETCH))
    sizes = turns.groupBy(own).agg(F.count(F.lit(1)).alias("_own"))
    along = Window.partitionBy("conv_id").orderBy("_stretch")
    sizes = sizes.select(
        F.col("conv_id").alias("_c"), F.col("_stretch").alias("_s"),
        (F.sum("_own").over(along) - F.col("_own")).alias("_before"),
        F.sum("_own").over(Window.partitionBy("conv_id")).alias("_length"))
    place = F.row_number().over(Window.partitionBy(own).orderBy("turn", "role", "tie"))
    return turns.withColumn("_place", place).join(
        sizes, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_stretch") == F.col("_s"))).withColumn(
        "_index", F.col("_before") + F.col("_place") - 1)


def format_turns(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``conv_id, part, turn, role, tie, text, loss``: the formatted text of all conversations.

    A conversation's text is its rows' ``text`` in the order of ``part`` (0 head, 1 turns, 2 tail),
    ``turn``, ``role`` and ``tie``; ``loss`` are the spans of that row's text to learn, in code points.
    Null roles and texts are empty, null turns come first, rows without ``conv_id`` are one
    conversation, and turns that share a number go by role and a hash of their text. Needs the columns
    ``conv_id, turn, role, text``; others are ignored, whatever their names.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("_text"))
    turns = turns.withColumn("tie", F.xxhash64("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    if template.needs_position:
        turns = _placed(turns)
    else:
        turns = turns.withColumns({"_index": F.lit(0).cast("long"), "_length": F.lit(1).cast("long")})
    turns = turns.select("conv_id", F.lit(1).alias("part"), "turn", "role", "tie", "_text", "_index", "_length")

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [template.message(r, t, i, n) for r, t, i, n in zip(
                *(batch.column(c).to_pylist() for c in ("role", "_text", "_index", "_length")), strict=True)]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("conv_id", *_ORDER)),
                pa.array([t for t, _ in done], pa.string()),
                pa.array([[{"start": a, "end": b} for a, b in s] for _, s in done], _SPANS)],
                names=["conv_id", *_ORDER, "text", "loss"])

    spans = "array<struct<start: bigint, end: bigint>>"
    out = turns.mapInArrow(rendered, (
        f"conv_id {kinds['conv_id']}, part int, turn {kinds['turn']}, role string, tie bigint, text string, loss {spans}"))
    ends = [(0, template.head())] * template.has_head + [(2, template.tail())] * template.has_tail
    for part, (text, own) in ends:
        loss = "array(" + ",".join(f"named_struct('start', {a}L, 'end', {b}L)" for a, b in own) + ")"
        out = out.unionByName(conversations.select("conv_id").distinct().select(
            "conv_id", F.lit(part).alias("part"), F.lit(None).cast(kinds["turn"]).alias("turn"), F.lit("").alias("role"),
            F.lit(0).cast("long").alias("tie"), F.lit(text).alias("text"), F.expr(loss).cast(spans).alias("loss")))
    return out


_BODY = r"(?:[^\\<:]+|\\(?:\\|### |</turn>|: )|<(?!/turn>)|:{})*+"
_ONE_TURN = re.compile("### (" + _BODY.format("(?! )") + "): (" + _BODY.format("") + ")</turn>\n")


class Reading:
    """Reads one conversation's formatted text piece by piece and keeps digests only."""

    def __init__(self) -> None:
        self.rest, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        for span in spans or ():
            learned = TEMPLATE.controls.unescape(text[span["start"]:span["end"]])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())
        self.rest += text
        at = 0
        while m := _ONE_TURN.match(self.rest, at):
            role, said = map(TEMPLATE.controls.unescape, m.groups())
            self.all.update(f"{role}\n{said}\n".encode())
            self.turns += 1
            at = m.end()
        self.rest = self.rest[at:]

    def result(self) -> tuple[int, str, int, str, int]:
        if self.rest:
            raise ValueError(f"not a turn: {self.rest[:80]!r}")
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation digests of what ``format_turns`` gave with ``TEMPLATE``, read from the text.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. A digest needs a
    conversation's text in order, so one task reads it; it streams and holds one turn at a time.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER).select("conv_id", "text", "loss")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reading = None, None
        for batch in batches:
            rows = []
            ids, texts, spans = (batch.column(c).to_pylist() for c in ("conv_id", "text", "loss"))
            for conv, text, own in zip(ids, texts, spans, strict=True):
                if reading is None or conv != current:
                    if reading:
                        rows.append((current, *reading.result()))
                    current, reading = conv, Reading()
                reading.feed(text, own)
            yield packed(rows, batch)
            last = batch
        if reading:
            yield packed([(current, *reading.result())], last)

    def packed(rows: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return ordered.mapInArrow(digests, (
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"))
