"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before they are encoded, only where white space follows another character: there the split
pattern ends a match in any case (no alternative runs from a non-space character into white space), and neither
side looks back. The ids of the parts are the ids of the whole, and no list of a very long text's ids is held.

Defined results: null is an empty text (no ids). Repeated rows and null doc_ids: a row each. Other columns are kept
by `encode`, whose `ids` replaces a column of that name.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, take

#: Characters that are encoded at once.
PART = 1 << 16
_SAFE = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in order, cut at safe places at least `size` characters apart."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(enc, text: str) -> Iterator[np.ndarray]:
    for part in parts(text):
        yield np.asarray(enc.encode_to_numpy(part, disallowed_special=())).astype("<u4", copy=False)


def decode_bytes(enc, ids: np.ndarray) -> bytes:
    """Raw bytes of ids; a token may hold part of a character, so no text is made."""
    return enc.decode_bytes(ids.tolist())


def _digests(path: str, pattern: str):
    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            n, ids_sha, bytes_sha = [], [], []
            for value in take(b, "text"):
                a, d, count = hashlib.sha256(), hashlib.sha256(), 0
                for ids in encode_text(enc, value.as_py() or ""):
                    count += len(ids)
                    a.update(ids.tobytes())
                    d.update(decode_bytes(enc, ids))
                n.append(count)
                ids_sha.append(a.hexdigest())
                bytes_sha.append(d.hexdigest())
            yield pa.RecordBatch.from_arrays([take(b, "doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode each text and decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_digests(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids."""

    @F.pandas_udf("array<int>")
    def run(s):  # noqa: ANN001, ANN202
        enc = encoding(path, pattern)
        return s.map(lambda t: np.concatenate(list(encode_text(enc, t or ""))).astype(np.int32))

    small_batches(docs.sparkSession)
    return docs.withColumn(ids, run(F.col(text).cast("string")))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the raw bytes of a column of token ids."""

    @F.pandas_udf("binary")
    def run(s):  # noqa: ANN001, ANN202
        enc = encoding(path, pattern)
        return s.map(lambda v: None if v is None else decode_bytes(enc, np.asarray(v)))

    return docs.withColumn(out, run(F.col(ids)))
