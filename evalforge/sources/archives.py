"""A Python data source over tar and tar.gz archives: a row for each member, headers only, with caps that fail closed."""

from __future__ import annotations

import hashlib
import io
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, ordinal long, path string, type string, size long, sha256 string, pax array<string>"
MAX_MEMBERS, MAX_BYTES = 400_000, 64 << 30


@dataclass
class Archive(InputPartition):
    path: str


def members(stream, name: str, max_members: int = MAX_MEMBERS, max_bytes: int = MAX_BYTES) -> Iterator[tuple]:
    """Members in order from one pass; contents are hashed in blocks and never held."""
    total = 0
    with tarfile.open(fileobj=stream, mode="r|*") as tar:
        for k, m in enumerate(tar):
            total += m.size
            if k >= max_members or total > max_bytes:
                raise ValueError(f"{name}: more than {max_members} members or {max_bytes} bytes")
            kind = "file" if m.isreg() else "dir" if m.isdir() else "link" if m.issym() or m.islnk() else "other"
            digest = None
            if m.isreg():
                h = hashlib.sha256()
                with tar.extractfile(m) as f:
                    while block := f.read(1 << 20):
                        h.update(block)
                digest = h.hexdigest().upper()
            yield name, k, m.name, kind, m.size, digest, sorted(m.pax_headers)


class TarSource(DataSource):
    """spark.read.format("tar_members").option("paths", "a.tar,b.tar.gz").load(): a partition for each archive; paths
    may be URIs of any store that Arrow reads. option("strict", "true") refuses what isn't plain USTAR or PAX."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TarReader:  # noqa: ANN001
        return TarReader(self.options)


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", "").split(",") if p]
        self.strict = options.get("strict", "false") == "true"

    def partitions(self) -> list[Archive]:
        return [Archive(p) for p in self.paths]

    def read(self, partition: Archive) -> Iterator[tuple]:
        walk = strict_members if self.strict else members
        with pa.fs.FileSystem.from_uri(partition.path)[0].open_input_stream(pa.fs.FileSystem.from_uri(partition.path)[1]) if "://" in partition.path else open(partition.path, "rb") as f:
            yield from walk(f, partition.path)


class Inflated:
    """Bytes of one gzip member, read forward: its checksum and length are held against its trailer, and nothing may stand
    behind it. Keeps the number and SHA-256 of the compressed bytes. A file that isn't gzip is read as it is."""

    BLOCK = 1 << 16

    def __init__(self, stream, max_bytes: int):
        self.stream, self.max, self.total, self.compressed = stream, max_bytes, 0, 0
        self.digest, self.held = hashlib.sha256(), b""
        first = self._take()
        self.inflate = zlib.decompressobj(wbits=31) if first[:2] == b"\x1f\x8b" else None
        self.fresh = first

    def _take(self) -> bytes:
        block = self.stream.read(self.BLOCK)
        self.compressed += len(block)
        self.digest.update(block)
        return block

    def _more(self) -> bytes:
        block, self.fresh = self.fresh or self._take(), b""
        if self.inflate is None:
            return block
        while True:
            if self.inflate.eof:
                if self.inflate.unused_data or block:
                    raise ValueError("bytes behind the gzip member")
                return b""
            try:
                out = self.inflate.decompress(self.inflate.unconsumed_tail + block, 1 << 20)
            except zlib.error as e:
                raise ValueError(f"gzip: {e}") from e
            if out:
                return out
            block = self._take()
            if not (block or self.inflate.eof or self.inflate.unconsumed_tail):
                raise ValueError("the gzip member is cut off")

    def read(self, n: int) -> bytes:
        """The next n bytes, fewer only at the end."""
        parts, have = [self.held], len(self.held)
        while have < n and (more := self._more()):
            parts.append(more)
            have += len(more)
        whole = b"".join(parts)
        self.held = whole[n:]
        self.total += min(n, have)
        if self.total > self.max:
            raise ValueError(f"more than {self.max} bytes")
        return whole[:n]


_BLOCK = 512
#: Types of members by flag (fixed values of the format).
KINDS = {b"0": "file", b"\0": "file", b"1": "link", b"2": "link", b"5": "dir"}


def _octal(field: bytes, what: str) -> int:
    digits = field.strip(b" \0")
    if not digits or any(c not in b"01234567" for c in digits):
        raise ValueError(f"{what} isn't octal")
    return int(digits, 8)


def pax_records(body: bytes) -> dict[str, str]:
    """key: value of `length key=value` lines, which must fill the body; a key may stand once."""
    out: dict[str, str] = {}
    at = 0
    while at < len(body):
        gap = body.find(b" ", at)
        size = body[at:gap] if gap > at else b""
        if not size.isdigit() or size.startswith(b"0") or body[at + int(size) - 1 : at + int(size)] != b"\n":
            raise ValueError("a PAX record's length is wrong")
        key, eq, value = body[gap + 1 : at + int(size) - 1].partition(b"=")
        if not eq or not key or key.decode() in out:
            raise ValueError("a PAX record has no key, no value or repeats a key")
        out[key.decode()] = value.decode()
        at += int(size)
    return out


#: Keys that would change what a member is; archives with them are refused.
FORBIDDEN_KEYS = ("linkpath", "hdrcharset")
MAX_HEADER = 1 << 20


def strict_members(stream, name: str, max_members: int = MAX_MEMBERS, max_bytes: int = MAX_BYTES) -> Iterator[tuple]:
    """Members like `members`, but USTAR headers only, each with its checksum; PAX may override path and size; archives end
    with two empty blocks and zeros. `pax` has the flags PATH_OVERRIDE, SIZE_OVERRIDE and hashes of other keys, in order.
    Anything else is an error, also bytes behind a gzip member or a wrong checksum of it."""
    source = Inflated(stream, max_bytes)
    everywhere: dict[str, str] = {}
    once: dict[str, str] | None = None
    k = 0
    while True:
        header = source.read(_BLOCK)
        if len(header) < _BLOCK:
            raise ValueError(f"{name}: the archive is cut off")
        if not any(header):
            break
        if header[257:265] != b"ustar\x0000":
            raise ValueError(f"{name}: not a USTAR header")
        if _octal(header[148:156], "checksum") != sum(header[:148]) + 8 * 0x20 + sum(header[156:]):
            raise ValueError(f"{name}: a header's checksum is wrong")
        flag, size = header[156:157], _octal(header[124:136], "size")
        if flag in (b"x", b"g"):
            if size > MAX_HEADER:
                raise ValueError(f"{name}: a PAX header of {size} bytes")
            body = source.read(size)
            source.read(-size % _BLOCK)
            found = pax_records(body)
            if any(key in FORBIDDEN_KEYS for key in found):
                raise ValueError(f"{name}: a PAX key that is not allowed")
            if flag == b"g":
                everywhere.update(found)
            elif once is not None:
                raise ValueError(f"{name}: two PAX headers before a member")
            else:
                once = found
            continue
        if flag not in KINDS:
            raise ValueError(f"{name}: a member of type {flag!r}")
        own = everywhere | (once or {})
        text = lambda a, b: header[a:b].split(b"\0", 1)[0].decode()
        path = own.get("path") or "/".join(p for p in (text(345, 500), text(0, 100)) if p)
        if "size" in own:
            if not own["size"].isdigit():
                raise ValueError(f"{name}: a PAX size that isn't a number")
            size = int(own["size"])
        if not path or k >= max_members:
            raise ValueError(f"{name}: a member without a path, or more than {max_members} members")
        flags = [f for f, key in (("PATH_OVERRIDE", "path"), ("SIZE_OVERRIDE", "size")) if key in own]
        for kind, keys in (("GLOBAL", everywhere), ("EXTENDED", once or {})):
            flags += sorted(f"{kind}_KEY_SHA256:{hashlib.sha256(key.encode()).hexdigest().upper()}" for key in keys if key not in ("path", "size"))
        digest, left = hashlib.sha256(), size if KINDS[flag] == "file" else 0
        while left:
            block = source.read(min(left, 1 << 20))
            if not block:
                raise ValueError(f"{name}: a member is cut off")
            digest.update(block)
            left -= len(block)
        if KINDS[flag] == "file":
            source.read(-size % _BLOCK)
        yield name, k, path.rstrip("/"), KINDS[flag], size, digest.hexdigest().upper() if KINDS[flag] == "file" else None, flags
        k, once = k + 1, None
    if once is not None:
        raise ValueError(f"{name}: a PAX header without a member")
    if len(tail := source.read(_BLOCK)) < _BLOCK or any(tail):
        raise ValueError(f"{name}: one empty block at the end")
    while rest := source.read(1 << 16):
        if any(rest):
            raise ValueError(f"{name}: bytes behind the end")


def member_content(archives: DataFrame, path: str, sha256: str) -> DataFrame:
    """(archive, content) of one member of each archive of a binaryFile DataFrame (path, content): found by its path, its
    bytes held against their hash; any other bytes fail the job, and a member that isn't there gives no row."""

    def run(batches):
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as tar:
                    for m in tar:
                        if m.name == path and m.isreg():
                            body = tar.extractfile(m).read()
                            if hashlib.sha256(body).hexdigest().upper() != sha256.upper():
                                raise ValueError(f"{archive}: {path} has other bytes than expected")
                            yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([body], pa.binary())], ["archive", "content"])

    return archives.select("path", "content").mapInArrow(run, "archive string, content binary")


def from_binary(archives: DataFrame, strict: bool = False) -> DataFrame:
    """The same rows from a binaryFile DataFrame (path, content), for stores that only Spark reads; a task holds one
    archive as it is stored. `strict` reads with `strict_members`."""
    walk = strict_members if strict else members

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = list(walk(io.BytesIO(content), path))
                cols = list(zip(*rows)) if rows else [()] * 7
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["archive", "ordinal", "path", "type", "size", "sha256", "pax"])

    return archives.select("path", "content").mapInArrow(run, SCHEMA)


def audit(rows: DataFrame) -> DataFrame:
    """One row: members, files, repeated paths, paths that differ only in case, unsafe paths."""
    by = rows.groupBy("archive", F.lower("path").alias("low")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("d"))
    twice = by.agg(F.coalesce(F.sum(F.col("n") - F.col("d")), F.lit(0)).alias("n_repeated"), F.coalesce(F.sum((F.col("d") > 1).cast("long")), F.lit(0)).alias("n_case_clash"))
    unsafe = F.col("path").rlike(r"^/|(^|/)\.\.(/|$)|[\x00-\x1f]|^[A-Za-z]:")
    whole = rows.agg(F.count("*").alias("n_members"), F.count_if(F.col("type") == "file").alias("n_files"), F.count_if(unsafe).alias("n_unsafe"))
    return whole.join(F.broadcast(twice))


def public_and_restricted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two projections of one inventory, in lock step: hashes of paths, and the paths themselves. More rows than MAX_MEMBERS
    are an error."""
    if rows.limit(MAX_MEMBERS + 1).count() > MAX_MEMBERS:
        raise ValueError(f"more than {MAX_MEMBERS} members")
    public = rows.select("ordinal", F.upper(F.sha2("path", 256)).alias("path_sha256"), "type", "size", F.array_join("pax", "|").alias("pax_flags"))
    return public, rows.select("ordinal", "path")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarSource)


def artifact_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.length("content").cast("long").alias("bytes"), F.upper(F.sha2("content", 256)).alias("sha256"))


def gzip_ok(raw: bytes) -> bool:
    """Whether raw is one gzip member with nothing behind it, its checksum and length right."""
    source = Inflated(io.BytesIO(raw), 1 << 62)
    try:
        while source.inflate and source.read(1 << 20):
            pass
    except ValueError:
        return False
    return source.inflate is not None
