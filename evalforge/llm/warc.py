r"""WARC archives: written from pages, read back, and assembled into one nested row per capture.

Each page is a transaction of three records: a request and a metadata record, which name the response or revisit
record in WARC-Concurrent-To. Pages of equal payloads are one response (the largest page_id) and revisits of it.
Archives are gzip files of up to PAGES pages, fewer where pages are long: as many as have ARCHIVE_BYTES bytes of html by
the mean of all. Pages of more than LONG bytes have archives of their own, of as many as have LONG_ARCHIVE bytes if all were
as long as the longest, so no archive grows beyond what a reader takes, however skewed lengths are. They are written by Spark's text writer: a record is text (its payload UTF-8) and the writer's commit
protocol drops what lost tasks have written. Reading verifies each response's payload digest.
Record ids are made from the page's id and its place in the scan; each is written once, so a retried task's own ids
are the only ones that are read.

Which payloads occur twice is found on digests alone: (page_id, SHA-256) rows are summed by digest, so copies meet as
partial maxima. Only digests of several pages go on: broadcast if measured small, else joined by shuffle.

Defined results: null html is an empty payload; null urls have an empty target; line breaks in a url are escaped.
Repeated rows are captures of their own; those of the largest page_id are all responses. Pages of a null page_id are
captures with a null id, and revisits only of pages with one. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, materialise, new_path, small_batches, take

PAGES, ARCHIVE_BYTES = 2048, 64 << 20
#: Bytes of html from which a page is long (PAGES pages of fewer are an archive that can be read), and of long pages' archives.
LONG, LONG_ARCHIVE = 256 << 10, 512 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_NL = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of a binary column's SHA-1: 32 digits of five bits, each cut from two hex digits."""

    def digit(hexed: Column, k: Column) -> Column:
        two = F.conv(F.rpad(F.substring(hexed, k * 5 / 4 + 1, F.lit(2)), 2, "0"), 16, 10).cast("int")
        value = F.pmod(F.floor(two / F.pow(F.lit(2), 3 - F.pmod(k * 5, F.lit(4)))), F.lit(32)).cast("int")
        return F.substring(F.lit(_ALPHABET), value + 1, F.lit(1))

    spelled = lambda hexed: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: digit(hexed, k)), "")
    return F.get(F.transform(F.array(F.sha1(payload)), spelled), F.lit(0))  # the digest is bound once


def _headers(*pairs: tuple[str, Column | str]) -> Column:
    parts = [F.lit("WARC/1.1" + _NL)]
    for name, value in pairs:
        parts += [F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(_NL)]
    return F.concat(*parts)


def _record(block: Column, *pairs: tuple[str, Column | str]) -> Column:
    return F.concat(_headers(*pairs, ("Content-Length", F.octet_length(block).cast("string"))), F.lit(_NL), block, F.lit(_NL * 2))


def transactions(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, int, int]:
    """`value`, the records of each page as text, and `long`, whether the page is; how many other pages an archive holds, and how
    many long ones, 0 if there are none. Payloads of at least `least_bytes` bytes are deduplicated."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    raw = F.encode("html", "UTF-8")
    key = F.unhex(F.sha2(raw, 256))
    seen = Observation("pages")  # measured in the pass that digests them
    measured = pages.observe(seen, F.count("*").alias("n"), F.sum(F.octet_length("html").cast("long")).alias("bytes"), F.max(F.octet_length("html")).alias("longest"))
    large = measured.filter(F.octet_length("html") >= least_bytes).select("page_id", key.alias("key"))
    several = materialise(large.groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("key", "first"), "payloads")
    size = {"n": 1, "bytes": 1, "longest": 0} if pages.isEmpty() else seen.get  # a plan that is known to be empty measures nothing
    longest = size["longest"] or 0
    per_archive = max(1, min(PAGES, ARCHIVE_BYTES * size["n"] // max(1, size["bytes"] or 1)))
    held = F.broadcast(several) if several.count() * 48 <= BROADCAST_BYTES else several
    joined = pages.withColumn("key", F.when(F.octet_length("html") >= least_bytes, key)).join(held, "key", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))

    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    unique = F.concat(page, F.lit(":"), F.spark_partition_id().cast("string"), F.lit("-"), F.monotonically_increasing_id().cast("string"))
    name = lambda kind: F.concat(F.lit("<urn:capture:"), F.col("unique"), F.lit(f":{kind}>"))
    digest = F.concat(F.lit("sha1:"), base32_sha1(raw))
    host = F.regexp_extract("target", "://([^/?#]*)", 1)
    where = F.regexp_extract("target", "://[^/?#]*(.*)", 1)
    main = F.when(revisit, name("revisit")).otherwise(name("response"))
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_NL}Content-Type: text/html; charset=utf-8{_NL}Content-Length: "), size, F.lit(_NL * 2))
    rows = joined.withColumn("unique", unique).withColumn("target", url)
    common = [("WARC-Target-URI", F.col("target")), ("WARC-Date", DATE)]
    request = _record(F.concat(F.lit("GET "), where, F.lit(f" HTTP/1.1{_NL}Host: "), host, F.lit(_NL * 2)), ("WARC-Type", "request"), ("WARC-Record-ID", name("request")), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request"))
    response = _record(F.concat(http, F.col("html")), ("WARC-Type", "response"), ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response"))
    again = _record(http, ("WARC-Type", "revisit"), ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", digest), ("WARC-Profile", PROFILE), ("Content-Type", "application/http; msgtype=response"))
    refers = F.when(revisit, F.concat(F.lit("refers-to-page: "), F.col("first").cast("string"), F.lit(_NL))).otherwise("")
    notes = F.concat(F.lit("page: "), page, F.lit(f"{_NL}payload-length: "), size, F.lit(_NL), refers)
    metadata = _record(notes, ("WARC-Type", "metadata"), ("WARC-Record-ID", name("metadata")), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields"))
    told = rows.select(F.concat(request, F.when(revisit, again).otherwise(response), metadata).alias("value"), (F.octet_length("html") > LONG).alias("long"))
    return told, per_archive, max(1, min(per_archive, LONG_ARCHIVE // longest)) if longest > LONG else 0


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    rows, per_archive, long = transactions(pages, least_bytes)
    for name, n, own in (("pages", per_archive, rows.filter(~F.col("long")) if long else rows), ("long", long, rows.filter("long"))):
        if n:
            own.select("value").write.options(lineSep="\n", compression="gzip", maxRecordsPerFile=n).text(f"{path}/{name}")


def records(stream: io.BufferedIOBase):
    """(headers, block) of each record; lengths decide where it ends, so a payload may hold anything."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            headers[k.strip().lower()] = v.strip()
        yield headers, stream.read(int(headers["content-length"]))


def _payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


_RECORD = "record_id string, type string, concurrent_to string, target string, digest string, n_bytes long, fields map<string,string>"


def _parse(batches):
    for b in batches:
        for content in take(b, "content"):
            rows = []
            for h, block in records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                kind = h["warc-type"]
                digest, n, fields = h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, []
                if kind == "response":
                    payload = _payload(block)
                    n, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324
                    if own != digest:
                        raise ValueError(f"{h['warc-record-id']}: the payload has digest {own}, its header {digest}")
                elif kind == "metadata":
                    fields = [tuple(x.split(": ", 1)) for x in block.decode().splitlines() if ": " in x]
                rows.append((h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), digest, n, fields))
            types = [pa.string()] * 5 + [pa.int64(), pa.map_(pa.string(), pa.string())]
            names = ["record_id", "type", "concurrent_to", "target", "digest", "n_bytes", "fields"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path, a row each."""
    small_batches(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(_parse, _RECORD)


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: the main record with the request and metadata records that name it."""
    # max() of a struct with a map isn't defined, so the fields of the metadata record are carried beside it
    flat = F.struct("record_id", "type", "target", "digest", "n_bytes")
    main, request, metadata = (F.max(F.when(F.col("type").isin(*k), flat)) for k in (("response", "revisit"), ("request",), ("metadata",)))
    fields = F.first(F.when(F.col("type") == "metadata", F.col("fields")), ignorenulls=True)
    return found.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(main.alias("main"), request.alias("request"), metadata.alias("metadata"), fields.alias("fields"))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives beside the checkpoints, read them, and give page_id, payload_bytes, payload_digest,
    record_type, refers_to and the url of each capture."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, least_bytes)
    done = captures(read(spark, path))
    f = F.col("fields")
    page = F.when(f["page"] != "null", f["page"].cast("long"))
    return done.select(
        page.alias("page_id"),
        F.coalesce("main.n_bytes", f["payload-length"].cast("long")).alias("payload_bytes"),
        F.col("main.digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        f["refers-to-page"].cast("long").alias("refers_to"),
        F.col("main.target").alias("target"),
    )
