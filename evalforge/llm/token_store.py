"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on doc_id.

Rows are dealt by ranges of doc_id and sorted inside them, so files ascend and a doc_id filter prunes files,
stripes (their minimum and maximum, the Bloom filter) and row groups from metadata. Each row has its place among the
ids of its file; the files' own starts are a running sum over one total a file.

Files: `part` (the file's place in the order), `doc_id`, `local_start`, `n_tokens`, `ids` array<int>.

Defined results: null or empty text: the end id alone. Null doc_ids come first; repeated doc_ids stand in the order
of a hash of their texts. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .shared import chunks, new_path, partitions, small_batches, take

SCHEMA = "part long, doc_id long, local_start long, n_tokens long, ids array<int>"
ORC = {
    "orc.compress": "ZSTD",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


@lru_cache(maxsize=1)
def _cache(path: str) -> tokens.PieceCache:
    return tokens.PieceCache(path)


def encode_chunk(path: str, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a chunk, with the end id after each, and where each text's ids start (one more at the end)."""
    pieces = tokens.split(path, data, offsets)
    cache = _cache(path)
    ids, ends = cache.ids(cache.look(pieces))
    edges = np.concatenate([[0], ends])
    starts = edges[pieces.first]
    extra_at = [edges[p] for _, p, _ in pieces.marks]
    extra_of = [k for k, _, _ in pieces.marks]
    extra_id = [i for _, _, i in pieces.marks]
    if end_id is not None:  # inserted after what stands at the same place
        extra_at += starts[1:].tolist()
        extra_of += range(len(offsets) - 1)
        extra_id += [end_id] * (len(offsets) - 1)
    if extra_at:
        order = np.lexsort((np.arange(len(extra_at)), np.array(extra_of), np.array(extra_at)))
        ids = np.insert(ids, np.array(extra_at)[order], np.array(extra_id, np.int32)[order])
        starts = starts + np.concatenate([[0], np.cumsum(np.bincount(np.array(extra_of), minlength=len(offsets) - 1))])
    return ids, starts


def _encode(path: str, end_id: int):
    def run(batches):
        part, total = TaskContext.get().partitionId(), 0
        for batch, data, offsets in chunks(batches):
            ids, starts = encode_chunk(path, data, offsets, end_id)
            n = np.diff(starts)
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int64)), take(batch, "doc_id"), pa.array(total + starts[:-1]), pa.array(n), lists], ["part", "doc_id", "local_start", "n_tokens", "ids"])
            total += int(starts[-1])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every text of docs (doc_id, text) and write its ids in ascending doc_id order."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", "hash", "place"]  # the last two deal rows of one id, or of none, over several ranges
    placed = docs.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(_encode(tokenizer, end_id), SCHEMA).write.options(**ORC).orc(path)


def _crc(batches):
    for b in batches:
        lists = take(b, "ids")
        values = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<u4")
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        raw = memoryview(values).cast("B")
        at, n, crc = 0, [], []
        for end in ends.tolist():
            n.append(end - at)
            crc.append(zlib.crc32(raw[at * 4 : end * 4]))
            at = end
        yield pa.RecordBatch.from_arrays([take(b, "part"), take(b, "doc_id"), take(b, "local_start"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; ORC's statistics and Bloom filters leave the other stripes unread."""
    return read(spark, path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids in the files before each file. A row a file, summed from two narrow columns."""
    totals = read(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    return totals.select("part", (F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("total")).alias("base"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the stored ids."""
    small_batches(spark)
    rows = read(spark, path).select("part", "doc_id", "local_start", "ids").mapInArrow(_crc, "part long, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(starts(spark, path)), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def store(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write docs to a new ORC folder beside the checkpoints and read it back."""
    path = new_path(docs.sparkSession, "tokens-orc")
    write(docs, path, tokenizer, end_id)
    return read_back(docs.sparkSession, path)
