"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) hold whatever the score; other kinds (card_group, iban, national_id, secret) are
kept from a score of THRESHOLD. Offsets are code points, ends exclusive. Every pattern is written so that a text is
passed over in linear time, however long a run of digits or letters is.

Defined results: null or empty text: no spans. Repeated rows: a row each. `redact` keeps all columns and the rows'
number; a text without spans (or null) stays as it is.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches, take

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "card_group", "iban", "national_id", "secret")
THRESHOLD = 0.6
#: Characters on either side in which context words count.
NEAR = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A whole run of digits with three more parts or alone, so that no start inside a run is tried again.
_IP = re.compile(r"[0-9]++(?:\.[0-9]++\.[0-9]++\.[0-9]++)?+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]++")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"[=:][ ]?[\"']?([A-Za-z0-9_+/-]{16,})")
_CONTEXT = {
    "email": re.compile(r"mail|contact|write", re.I),
    "ip": re.compile(r"\bip\b|host|server|address", re.I),
    "card": re.compile(r"card|visa|master|credit|payment", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax", re.I),
    "card_group": re.compile(r"card|visa|master|credit|payment", re.I),
    "iban": re.compile(r"iban|bank|account|konto|compte|cuenta", re.I),
    "national_id": re.compile(r"ssn|social|security|national|passport|\bid\b", re.I),
    "secret": re.compile(r"token|secret|key|password|passwd|pwd|bearer", re.I),
}
#: What a proposal is worth alone, with its checksum, and with a context word.
_WORTH = {"email": (0.9, 0.0), "ip": (0.6, 0.1), "card": (0.3, 0.5), "phone": (0.5, 0.1), "card_group": (0.2, 0.5), "iban": (0.2, 0.6), "national_id": (0.35, 0.0), "secret": (0.35, 0.0)}
_NEAR_WORTH = 0.3


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d * 2 - 9 if d > 4 else d * 2) if k % 2 else d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The remainder of an account number, country and check digits moved to its end, is 1."""
    moved = code[4:] + code[:4]
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _proposals(text: str):
    """(kind, start, end) of every span whose checks hold."""
    for a, b in _emails(text):
        yield "email", a, b
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if "." in m[0] and all(map(_small, m[0].split("."))):
                yield "ip", m.start(), m.end()
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 13:
                continue
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
            elif len(digits) > 19:  # numbers side by side, which the pattern takes as one
                for g in _DIGITS.finditer(m[0]):
                    if 13 <= len(g[0]) <= 19 and luhn(g[0]):
                        yield "card_group", m.start() + g.start(), m.start() + g.end()
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    yield "phone", m.start(), m.end()
        for m in _IBAN.finditer(text):
            if mod97(m[0].replace(" ", "")):
                yield "iban", m.start(), m.end()
        if "-" in text:
            for m in _NATIONAL.finditer(text):
                yield "national_id", m.start(), m.end()
        if "=" in text or ":" in text:
            for m in _SECRET.finditer(text):
                if any(map(str.isdigit, m[1])):
                    yield "secret", m.start(1), m.end(1)


def find(text: str | None) -> list[Span]:
    """All kept spans by kind, then start."""
    out = []
    for kind, a, b in _proposals(text or ""):
        alone, checked = _WORTH[kind]
        near = text[max(0, a - NEAR) : a] + " " + text[b : b + NEAR]
        score = min(1.0, alone + checked + (_NEAR_WORTH if _CONTEXT[kind].search(near) else 0.0))
        if kind in BASE_KINDS or score >= THRESHOLD:
            out.append(Span(kind, a, b, round(score, 3)))
    return sorted(out, key=lambda s: (KINDS.index(s.kind), s.start))


def redacted(text: str | None) -> str | None:
    """The text with each span, overlapping ones as one, replaced by its kind in angle brackets."""
    if not text or not (spans := find(text)):
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def _scan(batches):
    for b in batches:
        rows = []
        for value in take(b, "text"):
            spans = find(value.as_py())
            name = [f"{s.kind}:{s.start}:{s.end}" for s in spans]
            base = [n for n, s in zip(name, spans) if s.kind in BASE_KINDS]
            rows.append([*(sum(s.kind == k for s in spans) for k in BASE_KINDS), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(name), [s.score for s in spans]])
        cols = list(zip(*rows)) if rows else [[]] * 7
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([take(b, "doc_id"), *(pa.array(list(c), t) for c, t in zip(cols, types))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])


def scan(docs: DataFrame) -> DataFrame:
    """Counts, digest, spans and scores of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data replaced in `text`."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(redacted, na_action="ignore")

    small_batches(docs.sparkSession)
    return docs.withColumn(text, run(F.col(text).cast("string")))
