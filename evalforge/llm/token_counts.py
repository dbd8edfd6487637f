"""Token counts without ids: each distinct pre-token is encoded once, its count joined to the documents' frequencies.

1. Each task counts its pre-tokens; the counts meet by pre-token (partial sums, so a frequent one is a row a task).
2. Every distinct pre-token is encoded once; the table (piece, pieces in it, frequency) goes to the shared folder.
3. Documents are split again. The most frequent pre-tokens, TOP_BYTES bytes of them with what a table row costs, are a
   bounded table that every task holds, so hot keys never reach the shuffle, however long; the rest are rows
   (document, piece, frequency), joined with the table by shuffle and summed.

Defined results: null or empty text: 0 bytes, 0 tokens. Repeated rows: a row each, also for null doc_ids. Special
strings inside texts count as the library's default has it: one token. Extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections import Counter
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import chunks, materialise, most_frequent, small_batches, take

TOP_BYTES, ROW_BYTES = 16 << 20, 100
#: Bytes of distinct pre-tokens, with what each costs, that a task holds before it passes on what it has counted.
HELD_BYTES = 40 << 20


def _count(path: str):
    def run(batches):
        held: Counter = Counter()
        size = 0  # not less than what is held: pieces of two chunks are added twice until it is summed anew

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["piece", "n"])
            held.clear()

        for _, data, offsets in chunks(batches):
            found = tokens.split(path, data, offsets)
            for piece, n in zip(found.distinct.to_numpy(zero_copy_only=False).tolist(), np.bincount(found.codes, minlength=len(found.distinct)).tolist()):
                held[piece] += n
            size += len(found.distinct) * ROW_BYTES + found.distinct.nbytes
            if size > HELD_BYTES:
                size = sum(map(len, held)) + ROW_BYTES * len(held)
                if size > HELD_BYTES // 2:
                    yield from out()
                    size = 0
        yield from out()

    return run


def _encode(path: str):
    def run(batches):
        for b in batches:
            if b.num_rows:
                _, n = tokens.encode_pieces(path, take(b, "piece").to_pylist())
                yield pa.RecordBatch.from_arrays([take(b, "piece"), take(b, "n"), pa.array(n, pa.int64())], ["piece", "n", "n_pieces"])

    return run


def piece_table(docs: DataFrame, path: str) -> DataFrame:
    """(piece, n, n_pieces) of every distinct pre-token of the texts."""
    counted = docs.select("text").mapInArrow(_count(path), "piece binary, n long")
    distinct = counted.groupBy("piece").agg(F.sum("n").alias("n"))
    return materialise(distinct.mapInArrow(_encode(path), "piece binary, n long, n_pieces long"), "pieces")


@lru_cache(maxsize=1)
def _top(key: int, shared) -> dict[bytes, int]:
    pieces, n = shared.value
    return dict(zip(pieces, n))


def _frequencies(path: str, shared):
    def run(batches):
        top = _top(shared.id if hasattr(shared, "id") else id(shared), shared).get
        task, row = TaskContext.get().partitionId() << 36, 0
        for batch, data, offsets in chunks(batches):
            found = tokens.split(path, data, offsets)
            first, pieces = found.first, found.distinct.to_numpy(zero_copy_only=False).tolist()
            known = np.fromiter(map(top, pieces, repeat(-1)), np.int64, len(pieces))
            n = known[found.codes]
            sums = np.concatenate([[0], np.cumsum(np.maximum(n, 0))])
            base = sums[first[1:]] - sums[first[:-1]]
            for k, _, _ in found.marks:
                base[k] += 1
            gap = np.flatnonzero(n < 0)
            of = np.searchsorted(first, gap, "right") - 1
            rest, times = np.unique(of * len(pieces) + found.codes[gap], return_counts=True)
            own = np.arange(row, row + batch.num_rows) + task
            row += batch.num_rows
            docs = take(batch, "doc_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), docs, pa.array([b"\xff" + struct.pack(">q", u) for u in own.tolist()], pa.binary()), pa.array(np.zeros(len(own), np.int64)), pa.array(np.diff(offsets)), pa.array(base)],
                ["row", "doc_id", "piece", "f", "n_bytes", "n_tokens"],
            )
            if len(rest):
                at, code = np.divmod(rest, len(pieces))
                zero = pa.array(np.zeros(len(rest), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), docs.take(pa.array(at)), found.distinct.take(pa.array(code)), pa.array(times), zero, zero], ["row", "doc_id", "piece", "f", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = piece_table(docs, path)
    top = most_frequent(table, "n", TOP_BYTES, F.length("piece") + ROW_BYTES).select("piece", "n_pieces").toArrow()
    shared = spark.sparkContext.broadcast((top["piece"].to_pylist(), top["n_pieces"].to_pylist()))
    rows = docs.mapInArrow(_frequencies(path, shared), "row long, doc_id long, piece binary, f long, n_bytes long, n_tokens long")
    joined = rows.join(table.select("piece", "n_pieces"), "piece", "left")
    summed = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("n_tokens") + F.col("f") * F.coalesce("n_pieces", F.lit(0))).alias("n_tokens")
    )
    return summed.select("doc_id", "n_bytes", "n_tokens")
