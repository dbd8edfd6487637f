"""Strict scans and sinks: fixed schemas, headers that must match, no NaN in JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import cut

MANIFEST = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("actions", T.ArrayType(T.IntegerType())), T.StructField("rationales", T.ArrayType(T.IntegerType()))])


def jsonl(spark: SparkSession, path: str, schema: T.StructType = MANIFEST) -> DataFrame:
    """A dictionary a line; blank lines are passed over, malformed ones fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def csv_strict(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV whose header is exactly the schema's names; `columns` narrows what is read, so labels can stay unseen."""
    df = spark.read.schema(schema).options(header="true", enforceSchema="false", mode="FAILFAST").csv(path)
    return df.select(*columns) if columns else df


def csv_label_blind(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str], split: str) -> tuple[DataFrame, DataFrame]:
    """(rows, files): the named columns alone, labels unseen, and the bytes and SHA-256 of each whole file. A row whose
    key columns occur under several values of `split`, or twice, is an error where it is read."""
    rows = csv_strict(spark, path, schema, columns)
    keys = [c for c in columns if c != split]
    seen = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.countDistinct(split).alias("_s"), F.first(split).alias(split))
    bad = F.concat(F.lit("in several splits or repeated: "), F.concat_ws(",", *keys))
    checked = seen.select(*(c if c != split else F.when((F.col("_n") == 1) & (F.col("_s") == 1), F.col(split)).otherwise(F.raise_error(bad).cast("string")).alias(split) for c in columns))
    return checked, hashed(spark, path)


def hashed(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files, without their contents."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.length("content").cast("long").alias("bytes"), F.upper(F.sha2("content", 256)).alias("sha256"))


def read_expected(spark: SparkSession, path: str, size: int, sha256: str) -> DataFrame:
    """(path, content) of a file that has these bytes; any other fails the job that reads it."""
    files = spark.read.format("binaryFile").load(path)
    same = (F.length("content") == size) & (F.upper(F.sha2("content", 256)) == sha256.upper())
    return files.select("path", F.when(same, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("not the expected bytes: "), "path")).cast("binary")).alias("content"))


def segments(files: DataFrame, most: int) -> DataFrame:
    """(path, ix, line, complete) from (path, content): lines with their newline, and what stands after the last newline
    as it is, not complete. A line of more than `most` bytes fails the job."""
    parts = F.expr("split(decode(content, 'ISO-8859-1'), '\n')")  # a character a byte, so bytes come back unchanged
    rows = files.select("path", F.size(parts).alias("n"), F.posexplode(parts).alias("ix", "part"))
    complete = F.col("ix") < F.col("n") - 1
    whole = F.encode(F.when(complete, F.concat("part", F.lit("\n"))).otherwise(F.col("part")), "ISO-8859-1")
    long = F.raise_error(F.concat(F.lit("a line is too long: "), "path")).cast("binary")
    return rows.select("path", F.col("ix").cast("long").alias("ix"), F.when(F.length(whole) <= most, whole).otherwise(long).alias("line"), complete.alias("complete")).filter("complete or length(line) > 0")


#: Blocks of files up to which their places are broadcast; of more, lines are joined with them by shuffle.
BLOCKS = 100_000


def lines(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(path, ix, line, complete) of files of any size: lines as bytes without their newline, numbered from 0; what stands after
    a file's last newline is a line that isn't complete. A line of more than `most` bytes fails the job.

    Files are read in byte ranges by many tasks, each of which reads on to the end of a line that starts in its range. A range's
    first number is the sum of the lines of those before it, a row a range. Whether the last line is complete is seen from the
    bytes: lines and newlines add up to the file's size or to one more. A UTF-8 byte order mark at the start is left out."""
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("line"))
    blocks = raw.groupBy("path", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.max("size").alias("size"))
    order, whole = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("path")
    blocks = cut(blocks.select("path", "start", "first", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("all"), (F.col("size") - F.sum("bytes").over(whole)).alias("left")))
    held = F.broadcast(blocks) if blocks.count() <= BLOCKS else blocks
    rows = raw.drop("size").join(held, ["path", "start"]).withColumn("ix", F.col("base") + F.col("id") - F.col("first"))
    long = F.raise_error(F.concat(F.lit("a line is too long: "), "path")).cast("binary")
    complete = (F.col("ix") < F.col("all") - 1) | F.col("left").isin(0, 3)
    return rows.select("path", "ix", F.when(F.octet_length("line") <= most, F.col("line")).otherwise(long).alias("line"), complete.alias("complete"))


def images(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """manifest (file_name, ...) with content: the bytes of each named file of the folder; null where there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), "content")
    return manifest.join(files, "file_name", "left")


def batches(rows: DataFrame, key: str, size: int, seed: int | None = None) -> DataFrame:
    """rows with batch and place: `size` rows a batch in the order of key, or of its hash with a seed."""
    from ..operators.maps import ranked

    order = F.col(key).cast("string") if seed is None else F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)
    placed = ranked(rows.withColumn("_o", order), ["_o", key], F.substring("_o", 1, 3), "_at")
    return placed.select(*rows.columns, F.floor(F.col("_at") / size).alias("batch"), (F.col("_at") % size).alias("place"))


def sampled(rows: DataFrame, key: str, count: int, salt: str) -> DataFrame:
    """`count` different rows, the same ones on every run: those with the least hashes of salt and key, in the order of
    key. The count is the feature; each task keeps at most as many."""
    least = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{salt}|"), F.col(key).cast("string")), 256)).orderBy("_h", key).limit(count)
    return least.drop("_h").orderBy(key)


def first_records(rows: DataFrame, order: Sequence[str], count: int) -> DataFrame:
    """The first rows of an order that is stated; without one a limit would be any rows."""
    return rows.orderBy(*order).limit(count)


def audit_pack(rows: DataFrame, strata: Sequence[str], key: str, count: int, salt: str, questions: Sequence[str]) -> DataFrame:
    """`count` rows a stratum by the least salted hashes, numbered, with an empty column for each question. Ranks are cut
    off in every task before rows meet, so a large stratum doesn't gather."""
    by = W.partitionBy(*strata).orderBy(F.sha2(F.concat(F.lit(f"{salt}|"), F.col(key).cast("string")), 256), key)
    chosen = rows.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= count)
    return chosen.select(*rows.columns, "place", *(F.lit(None).cast("string").alias(q) for q in questions))


#: Columns of the tidy result files.
TIDY = ("record_type", "axis", "index", "value", "check_name", "passed")


def write_tidy_csv(rows: DataFrame, path: str) -> None:
    """rows of TIDY as CSV with a header, in their order, numbers spelled so that they read back as they were."""
    spelled = rows.select(*(F.col(c).cast("string").alias(c) for c in TIDY)).orderBy("record_type", "axis", F.col("index").cast("long"), "check_name")
    spelled.write.option("header", "true").csv(path)


def write_event_log(events: DataFrame, path: str) -> None:
    """A line of JSON an event in the order of `sequence`, which has no gaps and starts at 0; no clock is written."""
    n, least, most, distinct = events.agg(F.count("*"), F.min("sequence"), F.max("sequence"), F.countDistinct("sequence")).first()
    if n and (least, most, distinct) != (0, n - 1, n):
        raise ValueError("sequence must be 0, 1, 2, ...")
    events.select("sequence", *sorted(c for c in events.columns if c != "sequence")).orderBy("sequence").write.json(path)


def pax_flags_ok(flags: Column) -> Column:
    """Whether flags joined by `|` are known, in order, sorted by kind and without repeats."""
    parts = F.when(flags == "", F.array().cast("array<string>")).otherwise(F.split(flags, "\\|"))
    of = lambda kind: F.filter(parts, lambda x: F.startswith(x, F.lit(kind)))
    rank = F.transform(parts, lambda x: F.when(x == "PATH_OVERRIDE", 0).when(x == "SIZE_OVERRIDE", 1).when(F.startswith(x, F.lit("GLOBAL_KEY_SHA256:")), 2).when(F.startswith(x, F.lit("EXTENDED_KEY_SHA256:")), 3).otherwise(9))
    known = F.forall(parts, lambda x: x.isin("PATH_OVERRIDE", "SIZE_OVERRIDE") | x.rlike("^(GLOBAL|EXTENDED)_KEY_SHA256:[0-9A-F]{64}$"))
    ordered = (F.array_sort(rank) == rank) & (F.array_sort(of("GLOBAL")) == of("GLOBAL")) & (F.array_sort(of("EXTENDED")) == of("EXTENDED"))
    return known & ordered & (F.size(F.array_distinct(parts)) == F.size(parts))


def require_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """df, or an error that names what is missing, unknown or of another type."""
    have, want = ({f.name: f.dataType for f in s.fields} for s in (df.schema, expected))
    wrong = sorted({*want} ^ {*have} | {n for n in {*want} & {*have} if want[n] != have[n]})
    if wrong:
        raise ValueError(f"columns that are missing, unknown or of another type: {', '.join(wrong)}")
    return df


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def canonical_json(rows: DataFrame, strict: bool = True) -> DataFrame:
    """One column `json`: keys sorted, compact. A row with NaN or an infinity fails the job; if not strict it is null there
    and can be counted."""
    names = sorted(rows.columns)
    numbers = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    bad = F.lit(False)
    for n in numbers:
        bad = bad | F.coalesce(F.isnan(n) | (F.abs(n) == float("inf")), F.lit(False))
    said = F.raise_error(F.lit("a number that JSON has no word for")).cast("string") if strict else F.lit(None).cast("string")
    return rows.select(F.when(~bad, F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).otherwise(said).alias("json"))


def write_small_json(df: DataFrame, path: str) -> None:
    """A result of a few rows as one indented file; NaN is an error."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump([r.asDict(recursive=True) for r in df.collect()], f, indent=2, sort_keys=True, allow_nan=False)


def byte_ranges(spark: SparkSession, size: int, part: int) -> DataFrame:
    """ix, first, last (inclusive) of contiguous ranges; the last may be short."""
    return spark.range((size + part - 1) // part).select(F.col("id").alias("ix"), (F.col("id") * part).alias("first"), (F.least(F.col("id") * part + part, F.lit(size)) - 1).alias("last"))


def verify_chunks(plan: DataFrame, found: DataFrame) -> DataFrame:
    """ix, status of planned (ix, bytes, sha256) against found chunks."""
    both = plan.alias("p").join(found.alias("f"), "ix", "full_outer")
    status = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("p.sha256").isNull(), "extra").when(F.col("p.bytes") != F.col("f.bytes"), "size").when(F.col("p.sha256") != F.col("f.sha256"), "hash").otherwise("ok")
    return both.select("ix", status.alias("status"))
