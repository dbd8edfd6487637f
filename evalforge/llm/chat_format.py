"""Chat formatting from event logs: logs are dealt by conversation, sorted by sequence, folded into final messages, rendered.

An event is (conv_id, turn, key, seq, kind, value). Messages stand in order of (turn, key), nulls first; events of a message in
order of seq. `open` starts a message whose role is the value, `delta` adds the value to its text, `edit` puts the value in place
of the text so far, `regenerate` drops it. Tasks stream their conversations and hold one message at a time, so a conversation
may be of any length; one task streams it, as the digests of its turns run over them in order.

Rendering: a turn is start, role, middle, text, end of the template. In roles and texts the escape character is doubled and
put after the first character of every control string, so none of them stands in what was said, and reading undoes it.
A conversation is rendered in parts of whole turns, PART characters or one longer turn each, with loss spans (code points of
the part, end exclusive) over the assistant's texts.

Defined results: null values, roles and texts are empty; a delta before any open starts a message with an empty role; other
kinds do nothing. A null conv_id is a conversation. Repeated rows of a table are turns of their own, beside each other; rows
of one turn that differ stand in order of a hash of role and text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, small_batches, take

#: Characters of a rendered part, and of a delta that a table's text is cut into.
PART, DELTA = 1 << 20, 1024
ASSISTANT = "assistant"


@dataclass(frozen=True)
class Template:
    """Marks of a turn, and strings that may not stand in what was said. None of them may hold the escape character."""

    start: str = "<|turn|>"
    middle: str = "<|text|>"
    end: str = "<|end|>"
    others: tuple[str, ...] = field(default=("<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<|endoftext|>"))
    escape: str = "\\"

    def __post_init__(self) -> None:
        if len(self.escape) != 1 or any(self.escape in c or len(c) < 2 for c in self.controls):
            raise ValueError("control strings have two characters or more, none of them the escape character")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.middle, self.end, *self.others)

    @cached_property
    def _starts(self) -> re.Pattern:
        return re.compile("(?=(?:" + "|".join(map(re.escape, self.controls)) + "))(.)", re.S)

    @cached_property
    def _escaped(self) -> re.Pattern:
        return re.compile(re.escape(self.escape) + "(.)", re.S)

    @cached_property
    def turns(self) -> re.Pattern:
        return re.compile(f"{re.escape(self.start)}(.*?){re.escape(self.middle)}(.*?){re.escape(self.end)}", re.S)

    def hide(self, text: str) -> str:
        """Escaped: no control string is left in it."""
        return self._starts.sub(lambda m: m[1] + self.escape, text.replace(self.escape, self.escape * 2))

    def show(self, text: str) -> str:
        """What was hidden."""
        return self._escaped.sub(lambda m: m[1], text)


EVENTS = ["conv_id", "turn", "key", "seq", "kind", "value"]


def log(rows: DataFrame, part: int = DELTA) -> DataFrame:
    """The events that a table (conv_id, turn, role, text) came from: streamed deltas, of some turns after an abandoned start
    that was regenerated or edited away."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    key = F.struct(F.xxhash64("role", "text").alias("hash"), F.monotonically_increasing_id().alias("row"))  # the row parts equal ones
    event = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    deltas = lambda text: F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{part}}}"), F.lit(0)), lambda v: event("delta", v))
    draft, way = event("delta", F.substring("text", 1, 32)), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5))
    again = F.concat(F.array(draft, event("regenerate", F.lit(""))), deltas(F.col("text")))
    edited = F.concat(F.array(draft, event("edit", F.substring("text", 1, part))), deltas(F.expr(f"substring(text, {part + 1})")))
    told = F.concat(F.array(event("open", F.col("role"))), F.when(way == 0, again).when(way == 1, edited).otherwise(deltas(F.col("text"))))
    return rows.select("conv_id", "turn", key.alias("key"), F.posexplode(told).alias("seq", "event")).select(*EVENTS[:4], "event.*")


def _sorted(events: DataFrame) -> DataFrame:
    order = ["conv_id", F.asc_nulls_first("turn"), "key", "seq"]
    return events.repartition(partitions(events), "conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "value")


def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """(conv_id, role, text) of final messages, from events in order."""
    conv, role, parts, is_open = None, "", [], False
    for b in batches:
        for c, kind, value in zip(take(b, "conv_id").to_pylist(), take(b, "kind").to_pylist(), take(b, "value").to_pylist()):
            value = value or ""
            if is_open and (c != conv or kind == "open"):
                yield conv, role, "".join(parts)
                is_open = False
            if kind == "open":
                conv, role, parts, is_open = c, value, [], True
            elif kind in ("delta", "edit", "regenerate"):
                if not is_open:
                    conv, role, parts, is_open = c, "", [], True
                if kind != "delta":
                    parts.clear()
                if kind != "regenerate":
                    parts.append(value)
    if is_open:
        yield conv, role, "".join(parts)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(_SPAN))])
PARTS = "conv_id long, part long, formatted string, loss array<struct<start: long, end: long>>"


def _rendered(template: Template):
    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        conv, part, size, turns, loss, some = None, 0, 0, [], [], False
        for c, role, text in folded(batches):
            if some and (c != conv or size >= PART):
                yield {"conv_id": conv, "part": part, "formatted": "".join(turns), "loss": loss}
                part, size, turns, loss = part + 1 if c == conv else 0, 0, [], []
            conv, some = c, True
            head, body = f"{template.start}{template.hide(role)}{template.middle}", template.hide(text)
            if role == ASSISTANT:
                loss.append({"start": size + len(head), "end": size + len(head) + len(body)})
            turns.append(head + body + template.end)
            size += len(turns[-1])
        if some:
            yield {"conv_id": conv, "part": part, "formatted": "".join(turns), "loss": loss}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in parts(batches):
            held.append(row)
            size += len(row["formatted"])
            if size >= PART or len(held) >= 1000:
                yield pa.RecordBatch.from_pylist(held, _PARTS)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _PARTS)

    return run


def render(events: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, part, formatted, loss: every conversation of the log, its parts in order and in one partition."""
    small_batches(events.sparkSession)
    return _sorted(events).mapInArrow(_rendered(template), PARTS)


def messages(events: DataFrame) -> DataFrame:
    """conv_id, position, role, text: the final messages of the log."""
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, k = None, -1
        for c, role, text in folded(batches):
            conv, k = c, k + 1 if c == conv else 0  # a null conversation comes first
            yield pa.RecordBatch.from_pylist([{"conv_id": c, "position": k, "role": role, "text": text}], schema)

    small_batches(events.sparkSession)
    return _sorted(events).mapInArrow(run, "conv_id long, position long, role string, text string")


def read_back(parts: DataFrame, template: Template = Template(), arranged: bool = False) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from rendered parts alone. Parts that stand as
    `render` left them (arranged) are read in place; others, stored ones for instance, are dealt and sorted again."""
    digests = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some = [], False
        conv = n = loss_chars = chars = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        row = lambda: (conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), digests)], schema=digests)
        for b in batches:
            for c, formatted, spans in zip(*(take(b, x).to_pylist() for x in ("conv_id", "formatted", "loss"))):
                if not some or c != conv:
                    if some:
                        held.append(row())
                    conv, n, loss_chars, chars, some = c, 0, 0, 0, True
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                chars += len(formatted)
                for m in template.turns.finditer(formatted):
                    n += 1
                    turns.update(f"{template.show(m[1])}\n{template.show(m[2])}\n".encode())
                for s in spans:
                    text = template.show(formatted[s["start"] : s["end"]])
                    loss_chars += len(text)
                    loss.update(text.encode())
            if held:
                yield out()
                held.clear()
        if some:
            held.append(row())
            yield out()

    small_batches(parts.sparkSession)
    if not arranged:
        parts = parts.repartition(partitions(parts), "conv_id").sortWithinPartitions("conv_id", "part")
    return parts.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
