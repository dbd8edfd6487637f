"""Repair of a conversation's structure at the least cost: which turns to keep, give another role, delete or insert.

A repaired conversation reads `(s?(ua)+)?` by role initials: an optional system turn, then user and assistant in turn. The
cheapest edits are found over retained turns: dp[i, r] is the least cost of retaining turn i with final role r. The turns
between two retained ones are deleted, at a price that prefix sums give, so the best retained turn before is a running
minimum a role of (dp - prefix sum); the two roles alone determine what has to be inserted between them. Among equal costs the
ASCII-least audit (a letter an edit: D, I, K, R) wins. In a gap the deletions stand before the insertions, which is least.
Audits of all states have a letter for each turn so far, so none begins another: their order so far, a rank of at most four
states, decides, and only if they are equal does what is appended. So no strings are compared and a turn costs a few bytes.

Turns are streamed in order: first narrow rows (initial, fault), which give cost and audit a conversation, then texts, hashed
as they pass. Nothing but the audit, a letter a turn, is held of a conversation, however long. SHA-256 runs over a
conversation's turns one after another, so one task streams each conversation.

Defined results: nulls are one space, in keys of the damage as well. Order: turn (nulls first), then role and SHA-256 of the
text, so copies stand side by side. A role counts by its first character; other initials than s, u, a are rerolled or deleted,
as is an empty role. A null conv_id is a conversation. Conversations of which no row is left: zeros, empty audit, digest of
the empty text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import partitions, small_batches, take

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: Turns inserted before a retained role, by the role retained before it ("" is none yet), and at the end.
INSERTS = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "a"): 0, ("u", "u"): 1, ("a", "u"): 0, ("a", "a"): 1}
CLOSING = {"": 0, "s": 2, "u": 1, "a": 0}
ROLES = {"u": "user", "a": "assistant"}
WHITE = r"\x20\x09-\x0D"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: the rows as the damage leaves them; dropped ones are kept with their mark."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    out = out.withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    out = out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), "kind")
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _fault(copies: Column) -> Column:
    blank, ended = ~F.col("text").rlike(f"[^{WHITE}]"), F.col("text").rlike(rf"[.!?][{WHITE}]*\z")
    return F.when(blank, BLANK).when(copies, DUPLICATE).when(~ended, CUT).otherwise(NONE)


class Turns:
    """The cheapest edits of one conversation, turn by turn."""

    def __init__(self) -> None:
        self.n = self.spent = 0
        self.best = {"": (0, 0, -1)}  # role retained last: (dp less prefix sum, rank of its audit, place among retained)
        self.retained: list[tuple[int, int, str]] = []  # (place of the one before, turn, edits appended)

    def add(self, initial: str, fault: int) -> None:
        i, price = self.n, self.spent
        self.n, self.spent = i + 1, price + DELETE
        # a state's audit once this turn is done: that of its source, then D or what is appended here
        kept = {q: (cost, (rank, "D"), place, None) for q, (cost, rank, place) in self.best.items()}
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED if fault == CUT else 0
            for r in "sua":
                if r != initial and r not in ROLES:
                    continue
                edit, own = ("K", 0) if r == initial else ("R", REROLE)
                for q, (cost, rank, place) in self.best.items():
                    k = INSERTS.get((q, r))
                    if k is None:
                        continue
                    letters = "I" * k + edit
                    new = (cost + price + k * INSERT + own + extra - self.spent, (rank, letters), place, letters)
                    if r not in kept or new[:2] < kept[r][:2]:
                        kept[r] = new
        ranks = {key: k for k, key in enumerate(sorted({v[1] for v in kept.values()}))}
        best = {}
        for q, (cost, key, place, letters) in kept.items():
            if letters is not None:
                self.retained.append((place, i, letters))
                place = len(self.retained) - 1
            best[q] = (cost, ranks[key], place)
        self.best = best

    def close(self) -> tuple[int, str]:
        """Least cost and its audit."""
        cost, (_, tail), place = min((cost + self.spent + CLOSING[q] * INSERT, (rank, "I" * CLOSING[q]), place) for q, (cost, rank, place) in self.best.items())
        parts, at = [tail], self.n
        while place >= 0:
            before, i, letters = self.retained[place]
            parts.append(letters + "D" * (at - i - 1))
            place, at = before, i
        parts.append("D" * at)
        return cost, "".join(reversed(parts))


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_SUMMARY = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
LEGAL = {"su", "ua", "au"}
_NO = object()


def _decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from rows in order: conv_id, dropped, turn, initial, fault."""
    current, turns, faults, illegal, last, seen = _NO, Turns(), [0] * 4, 0, None, []
    done: list[tuple] = []

    def end() -> None:
        cost, audit = turns.close()
        low, high, n = seen or (0, 0, 1)
        done.append((current, high - low + 1 - n, *faults[1:], illegal, cost, audit))

    for batch in batches:
        for conv, dropped, turn, initial, fault in zip(*(take(batch, c).to_pylist() for c in ("conv_id", "dropped", "turn", "initial", "fault"))):
            if conv != current or current is _NO:
                if current is not _NO:
                    end()
                current, turns, faults, illegal, last, seen = conv, Turns(), [0] * 4, 0, None, []
            if dropped:
                continue
            turns.add(initial, fault)
            faults[fault] += 1
            illegal += last is not None and last + initial not in LEGAL
            last = initial
            if turn is not None:
                seen = [seen[0], turn, seen[2] + (turn != seen[1])] if seen else [turn, turn, 1]
        if done:
            yield _summaries(done)
            done.clear()
    if current is not _NO:
        end()
        yield _summaries(done)


def _summaries(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SUMMARY)], schema=_SUMMARY)


def repaired_turns(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation, from the turns in order."""
    source, last = iter(rows), ""
    for letter in audit:
        if letter == "I":
            role, text = ROLES["a" if last == "u" else "u"], ""
        else:
            role, text = next(source)
            if letter == "D":
                continue
            if letter == "R":
                role = ROLES["a" if last == "u" else "u"]
        last = role[:1]
        yield role, text


def _paired(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """Each conversation's summary with the iterator over its turns, which has to be used up before the next."""

    def flat():
        names = [*_SUMMARY.names, "role", "text"]
        for b in batches:
            yield from zip(take(b, "kind").to_pylist(), zip(*(take(b, c).to_pylist() for c in names)))

    rows = flat()
    ahead = next(rows, None)
    while ahead is not None:
        summary = dict(zip(_SUMMARY.names, ahead[1]))
        ahead = None

        def turns():
            nonlocal ahead
            for kind, values in rows:
                if kind == 0:
                    ahead = (kind, values)
                    return
                yield values[-2], values[-1]

        own = turns()
        yield summary, own
        for _ in own:  # what the caller left
            pass


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    schema = pa.schema([*_SUMMARY, ("repaired_sha256", pa.string())])
    out = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    for summary, turns in _paired(batches):
        sha, first = hashlib.sha256(), True
        for role, text in repaired_turns(summary["audit"], turns):
            sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        held.append((*summary.values(), sha.hexdigest()))
        if len(held) >= 1000:
            yield out()
            held.clear()
    if held:
        yield out()


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    for summary, turns in _paired(batches):
        for k, (role, text) in enumerate(repaired_turns(summary["audit"], turns)):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((summary["conv_id"], k, role, text), schema)], schema=schema)


def decisions(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit a conversation of damaged rows (conv_id, turn, role,
    text, dropped)."""
    rows = rows.withColumn("digest", F.sha2("text", 256))
    same = W.partitionBy("conv_id", "dropped", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    narrow = rows.select("conv_id", "dropped", "turn", "role", "digest", _fault(F.lit(False)).alias("fault"))
    narrow = narrow.withColumn("seen", F.row_number().over(same) > 1).withColumn("fault", F.when(F.col("seen") & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault")))
    narrow = narrow.repartition(partitions(rows), "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "seen")
    return narrow.select("conv_id", "dropped", "turn", F.substring("role", 1, 1).alias("initial"), "fault").mapInArrow(_decide, SUMMARY)


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's summary (kind 0), then its rows in order."""
    kinds = dict(zip(_SUMMARY.names, (f.dataType for f in found.schema)))
    empty = lambda names: [F.lit(None).cast(kinds[n]).alias(n) for n in names]
    blank = [F.lit(None).cast(k).alias(n) for n, k in (("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "string"))]
    heads = found.select(F.lit(0).alias("kind"), *_SUMMARY.names, *blank)
    own = rows.filter(~F.col("dropped")).withColumn("digest", F.sha2("text", 256))
    turns = own.select(F.lit(1).alias("kind"), "conv_id", *empty(_SUMMARY.names[1:]), "turn", "role", "text", "digest")
    both = heads.union(turns).repartition(partitions(rows), "conv_id")
    return both.sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest").select("kind", *_SUMMARY.names, "role", "text")


def repair(rows: DataFrame) -> DataFrame:
    """Every conversation of damaged rows: decisions and repaired_sha256, of `role:text` a repaired turn, newline-joined."""
    small_batches(rows.sparkSession)
    return _streamed(rows, decisions(rows)).mapInArrow(_digests, SUMMARY + ", repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, role, text."""
    small_batches(rows.sparkSession)
    return _streamed(rows, decisions(rows)).mapInArrow(_texts, "conv_id long, position long, role string, text string")
