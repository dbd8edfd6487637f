"""Digests over the rows of a group, in order, without gathering the group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NO = object()


def grouped(rows: DataFrame, group: str, order: list[Column], text: Column, before: str = "", between: str = ",", after: str = "") -> DataFrame:
    """group, n_rows, sha256 (upper-case hex of before, the texts joined by between, after): rows are dealt by group, sorted, and
    hashed as they pass, so a task holds one Arrow batch and a hash's state, however large a group is. SHA-256 has no parts
    that could be joined: one task streams a group."""
    kind = rows.schema[group].dataType
    placed = rows.repartition(group).sortWithinPartitions(group, *order).select(F.col(group), text.cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n, sha, names = _NO, 0, None, ["group", "n_rows", "sha256"]
        for b in batches:
            done: list[tuple] = []
            for own, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if own != current or current is _NO:
                    if current is not _NO:
                        sha.update(after.encode())
                        done.append((current, n, sha.hexdigest().upper()))
                    current, n, sha = own, 0, hashlib.sha256(before.encode())
                sha.update(f"{between if n else ''}{value or ''}".encode())
                n += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (b.schema.field(0).type, pa.int64(), pa.string()))], names)
            last = b.schema.field(0).type
        if current is not _NO:
            sha.update(after.encode())
            yield pa.RecordBatch.from_arrays([pa.array([current], last), pa.array([n], pa.int64()), pa.array([sha.hexdigest().upper()])], names)

    return placed.mapInArrow(run, f"{group} {kind.simpleString()}, n_rows long, sha256 string")
