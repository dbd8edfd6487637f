"""Small tables with what operators must stand: nulls, empty and long texts, repeated rows, clashing names."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, ids string, hits string, score double, component_id long"
PASSAGE = "the quick brown fox jumps over the lazy dog near a quiet river bank while seven small birds sing of summer rain and distant hills"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["the", "of", "and", "tion", "er", "an", "in", "ou", "sh", "ble"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def german(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["der", "und", "ung", "sch", "keit", "lich", "ein", "ü", "ö", "ß"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def make() -> list[tuple]:
    base = prose(1, 120)
    rows: list[tuple] = [
        (1, base, "en"),
        (2, base, "en"),  # an exact copy
        (3, base.upper(), "en"),  # the same when lower-cased
        (4, base + " " + prose(2, 12), "en"),  # a near copy
        (5, prose(3, 120) + " " + PASSAGE, "en"),
        (6, prose(4, 90) + " " + PASSAGE.title(), "en"),
        (7, None, "en"),
        (8, "", None),
        (9, " \n\t ", "en"),
        (10, "one two three", "en"),
        (11, "ONE two  three", "en"),
        (12, "123 456 !!!", None),
        (13, german(1, 80), "de"),
        (14, german(2, 80), "de"),
        (15, german(3, 80), "de"),
        (16, prose(5, 60_000), "en"),  # very long
        (17, "x" * 200_000, "en"),  # one very long word
        (18, "mail bob.smith@example.co.uk or call +1 (555) 010-9999, card 4111 1111 1111 1111, ip 10.0.0.255, iban DE89370400440532013000", "en"),
        (19, "line one is here\nline two is here\nline one is here\nline one is here", "en"),
        (20, "漢字 émoji 😀 naïve it's they'll  we're\r\n\r\n done <|endoftext|> tail", None),
        (None, prose(6, 30), "en"),
        (21, prose(7, 40), "en"),
        (21, prose(7, 40), "en"),  # a repeated row
    ]
    rows += [(100 + k, prose(100 + k, 50), "en") for k in range(20)] + [(200 + k, german(200 + k, 50), "de") for k in range(20)]
    return [(i, t, g, "src", None if t is None else len(t), "extra", "ids", "hits", 0.5, -1) for i, t, g in rows]


@pytest.fixture(scope="session")
def rows():
    return make()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(r, *names):
    return tuple(sorted([tuple("~" if v is None else str(v) for v in (x[n] for n in names)) for x in r]))
