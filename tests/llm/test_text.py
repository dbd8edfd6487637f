"""Token counts, BPE, token store, personal data, quality, language ID, decontamination on the small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalforge.llm import byte_bpe, decontaminate, language_id, pii, quality, token_counts, token_store, tokens
from evalforge.llm.fm_index import FMIndex
from evalforge.llm.pretoken import Splitter, library_classes

from .conftest import PASSAGE, key

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
LIB = Tokenizer.from_file(JSON)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def library_ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab's trevmld \n\t12!?é\u00a0\u3000漢²½\"'😀")), max_size=40))
def test_splitter_agrees_with_the_pattern(text):
    data = np.frombuffer(text.encode(), np.uint8)
    codes, distinct, _ = Splitter(library_classes(LIB)).coded(data, np.array([0, len(data)]))
    assert [distinct[int(c)].as_py().decode() for c in codes] == regex.findall(P.PATTERN, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab's tz \n12!?é\u00a0\u2003\u3000漢²\"'😀")), max_size=40), max_size=8))
def test_pieces_are_encoded_as_each_would_be(texts):
    pieces = [p.encode() for t in texts for p in regex.findall(P.PATTERN, t)]
    ids, n = tokens.encode_pieces(JSON, pieces)
    assert np.split(ids, np.cumsum(n)[:-1]) if pieces else not len(ids)
    assert [i.tolist() for i in np.split(ids, np.cumsum(n)[:-1])][: len(pieces)] == [library_ids(p.decode()) for p in pieces]


def test_token_counts(docs, rows, empty):
    got = token_counts.token_counts(docs, JSON).collect()
    want = [(i, len((t or "").encode()), len(library_ids(t))) for i, t, *_ in rows]
    assert key(got, "doc_id", "n_bytes", "n_tokens") == tuple(sorted(tuple("~" if v is None else str(v) for v in w) for w in want))
    assert token_counts.token_counts(empty, JSON).count() == 0


def test_token_counts_beyond_the_table_of_frequent_pieces(docs, rows, monkeypatch):
    monkeypatch.setattr(token_counts, "TOP_BYTES", 600)
    got = token_counts.token_counts(docs, JSON).collect()
    assert sum(r.n_tokens for r in got) == sum(len(library_ids(t)) for _, t, *_ in rows)


def test_round_trip(docs, rows, empty):
    enc = byte_bpe.encoding(RANKS, P.PATTERN)
    got = byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect()
    want = []
    for i, t, *_ in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append(("~" if i is None else str(i), str(len(ids)), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert key(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == tuple(sorted(want))
    assert byte_bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0


def test_encode_and_decode_columns(docs, rows):
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert {bytes(r.decoded) for r in back.collect()} == {(t or "").encode() for _, t, *_ in rows}
    assert "extra" in back.columns and back.schema["ids"].dataType.simpleString() == "array<int>"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab '\n\t1!é漢")), max_size=200))
def test_parts_join_to_the_ids_of_the_whole(text):
    enc = byte_bpe.encoding(RANKS, P.PATTERN)
    parts = list(byte_bpe.parts(text, 7))
    assert "".join(parts) == text
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert isinstance(enc, tiktoken.Encoding)


def test_token_store(docs, rows, empty, spark, tmp_path):
    got = token_store.store(docs, JSON, 2).collect()
    at, want = 0, []
    for i, t in sorted(((i, t) for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library_ids(t), 2], "<u4")
        want.append(("~" if i is None else str(i), str(at), str(len(ids)), str(zlib.crc32(ids.tobytes()))))
        at += len(ids)
    assert key(got, "doc_id", "start", "n_tokens", "ids_crc32") == tuple(sorted(want))
    assert token_store.store(empty, JSON, 2).count() == 0
    path = f"file://{tmp_path}/t"
    token_store.write(docs, path, JSON, 2)
    found = token_store.lookup(spark, path, [10])
    assert [r.ids for r in found.collect()] == [[*library_ids("one two three"), 2]]


def scanned(df):
    """How many rows the scan of a query reads."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_lookups_prune_by_row_index_and_bloom_filter(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(0, 12_000, 1, 1).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    token_store.write(rows, path, JSON, 2)
    assert scanned(token_store.read(spark, path)) == 12_000
    one = token_store.lookup(spark, path, [6_000])
    assert len(one.collect()) == 1 and 0 < scanned(one) <= 1000  # one row group of one file
    assert scanned(token_store.lookup(spark, path, [6_001])) <= scanned(one)
    assert sum(scanned(token_store.lookup(spark, path, [k])) == 0 for k in range(6_001, 6_101, 2)) >= 45  # between stored ids: Bloom filter


# -- personal data --------------------------------------------------------------------------------------------------

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(int(p) < 256 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "1", "2", "-", " ", "+", "(", "b.c", "45", "@x.y", "4111111111111111", "é", "%", "=", "token"]), max_size=25))
def test_base_spans_are_those_of_the_patterns(parts):
    text = "".join(parts)
    assert [s[:3] for s in pii.find(text) if s.kind in pii.BASE_KINDS] == base_spans(text)


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")


def test_scan_and_redact(docs, rows, empty):
    got = {r.doc_id: r for r in pii.scan(docs).collect()}
    r = got[18]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and "iban:" in r.spans and len(r.scores) == 5
    assert got[7].spans == "" and got[7].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.scan(docs).count() == len(rows) and pii.scan(empty).count() == 0
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    by = {r.doc_id: r.text for r in clean.collect()}
    assert by[18] == "mail <EMAIL> or call <PHONE>, card <CARD>, ip <IP>, iban <IBAN>" and by[7] is None
    assert by[1] == rows[0][1]


# -- quality --------------------------------------------------------------------------------------------------------


def brute_statistics(text):
    words = WORD.findall(text)
    where: dict = {}
    for k in range(len(words) - 4):
        where.setdefault(tuple(words[k : k + 5]), []).append(k)
    hit = {j for v in where.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), sum(a == b for a, b in zip(words, words[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab  \n#é")), max_size=80), min_size=1, max_size=4))
def test_statistics(texts):
    raw = [t.encode() for t in texts]
    got = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert list(zip(*(c.tolist() for c in got))) == [brute_statistics(t) for t in texts]


def test_judge(spark, docs, rows, empty):
    labels = spark.createDataFrame([(100 + k, 1, 0) for k in range(15)] + [(17, 0, 0), (16, 0, 1), (999, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        if i is not None:
            assert tuple(by[i][s] for s in quality.STATS) == brute_statistics(t or "")
            assert by[i].base_failed == (by[i].n_words < 10 or 100 * by[i].n_repeat_words > 20 * by[i].n_words)
            assert not (by[i].kept and by[i].base_failed)
    assert all(by[100 + k].kept for k in range(20))
    none = quality.judge(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)
    assert quality.judge(empty, labels).count() == 0


def plain_path(f, x, at, level=0):
    """The path length of one row by going down one tree."""
    if f.feature[at] < 0:
        return f.depth[at]
    return plain_path(f, x, f.child[at] + int(x[f.feature[at]] > f.split[at]))


def test_forest_finds_outliers_and_scores_by_mean_path_length():
    x = np.random.default_rng(1).normal(0, 1, (500, 3))
    f = quality.Forest.grow(x)
    assert f.score(np.array([[9.0, 9, 9]]))[0] > f.score(x).max() - 0.1 > f.score(np.zeros((1, 3)))[0]
    for row, got in zip(x[:20], f.score(x[:20])):
        assert got == pytest.approx(2 ** (-np.mean([plain_path(f, row, r) for r in f.roots]) / f.scale))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=60), st.lists(st.integers(0, 9), max_size=60))
def test_threshold_gains_most(good, bad):
    got = quality.threshold(np.bincount(good, minlength=10), np.bincount(bad, minlength=10))
    gain = lambda c: sum(b / 10 >= c for b in bad) / len(bad) - quality.GOOD_WEIGHT * sum(g / 10 >= c for g in good) / len(good)
    if good and bad:
        assert gain(got) == pytest.approx(max(gain(c / 10) for c in range(11)))
    else:
        assert got == 1.0


def test_verdicts_on_labelled_rows_that_took_no_part(spark):
    """Of rows whose labels are hidden: bad ones that pass the base rules are out, good ones stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    hidden = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = quality.judge(docs, labels.filter(~hidden)).join(labels.filter(hidden), "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")), F.count("*"))
    kept = {q: (share, n) for q, share, n in got.collect()}
    assert kept[0][1] > 50 and kept[0][0] <= 0.05 and kept[1][0] >= 0.98


# -- language ID ------------------------------------------------------------------------------------------------------


def test_language_id(docs, rows, empty):
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert got[7].lang_pred == got[8].lang_pred == got[12].lang_pred == "und" and got[12].score == 0
    right = [got[i].lang_pred == ("en" if i < 200 else "de") for i in (*range(100, 120), *range(200, 220))]
    assert sum(right) == len(right)
    for i in got:
        if i is not None:
            assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
            assert 0 <= got[i].score <= 1
    kept = language_id.accept(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t, *_ in rows if t and re.search(r"[^\W\d_]", t)}
    assert language_id.fit(empty) is None and language_id.predict(docs, None).filter("lang_pred <> 'und'").count() == 0
    assert language_id.predict(empty, model).count() == 0


def test_held_out_accuracy_on_the_corpus(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.predict(corpus, language_id.fit(corpus)).join(corpus.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    n, right = out.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right / n > 0.97


def test_families_hold_close_languages_apart():
    texts = [("en", "the cat and the dog went to the house"), ("de", "die Katze und der Hund gingen zum Haus"), ("fr", "le chat et le chien sont dans la maison"), ("es", "el gato y el perro fueron a la casa")]
    raw = [t.encode() for _, t in texts for _ in range(5)]
    x = language_id.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    model = language_id.Model.fit(x, np.array([g for g, _ in texts for _ in range(5)], object))
    assert model.families == ["germanic", "romance"] and [len(p) for p in model.pairs] == [1, 1]
    assert model.predict(x)[0] == [g for g, _ in texts for _ in range(5)]


# -- decontamination -------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=5), min_size=1, max_size=6))
def test_fm_index_finds_every_place(seq, patterns):
    seq = [*seq, 0]
    index = FMIndex(np.array(seq), 4)
    table = np.zeros((len(patterns), 5), np.int64)
    for k, p in enumerate(patterns):
        table[k, 5 - len(p) :] = p
    lo, hi = index.search(table, np.array([len(p) for p in patterns]))
    for k, p in enumerate(patterns):
        assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == [i for i in range(len(seq)) if seq[i : i + len(p)] == p]


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ten_words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items):
    words, hit, found = ten_words(text), set(), set()
    for item, t in items:
        own = ten_words(t)
        n = min(10, len(own))
        wins = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontaminate(spark, docs, rows, empty, monkeypatch):
    items = [(1, PASSAGE), (2, "two three"), (3, None), (4, ""), (10, PASSAGE.upper()), (11, "lonely words that no text has at all in any place whatever"), (12, "the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = tuple(sorted(tuple("~" if v is None else str(v) for v in (i, *brute_hits(t, items))) for i, t, *_ in rows))
    got = decontaminate.find(docs, bench)
    assert "extra" in got.columns and key(got.collect(), "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == want
    small = decontaminate.blocks
    monkeypatch.setattr(decontaminate, "blocks", lambda b: small(b, 50))  # an item a block
    assert key(decontaminate.find(docs, bench).collect(), "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == want
    assert decontaminate.find(empty, bench).count() == 0
    assert decontaminate.find(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_remove_cuts_the_passages_and_nothing_else(spark, docs, rows, monkeypatch):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    out = decontaminate.remove(docs, bench)
    assert out.columns == docs.columns
    small = decontaminate.blocks
    monkeypatch.setattr(decontaminate, "blocks", lambda b: small(b, 50))  # an item a block: the text is cut after the last
    more = spark.createDataFrame([(k, f"{k} words that no text has") for k in range(2, 8)] + [(1, PASSAGE)], "item_id long, text string")
    assert sorted(map(str, decontaminate.remove(docs, more.orderBy("item_id")).collect())) == sorted(map(str, out.collect()))
    assert {r.hits for r in out.collect()} == {"hits"} and out.schema["hits"] == docs.schema["hits"]
    by = {r.doc_id: r.text for r in out.collect()}
    for i, t, *_ in rows:
        if i in (5, 6):
            assert by[i] == t[: -len(PASSAGE)]
        elif i is not None:
            assert by[i] == t


def test_token_counts_hold_bytes_not_pieces(spark, monkeypatch):
    """Long distinct pieces: a task passes on what it has counted by their bytes."""
    import pyarrow as pa

    monkeypatch.setattr(token_counts, "HELD_BYTES", 1 << 20)
    texts = [" ".join(chr(97 + k % 26) * 3000 + "x" * (k % 97) for k in range(j, j + 60)) for j in range(0, 6000, 60)]
    out = list(token_counts._count(JSON)([pa.RecordBatch.from_arrays([pa.array(texts[k : k + 10])], ["text"]) for k in range(0, len(texts), 10)]))
    held = [sum(map(len, b.column(0).to_pylist())) for b in out]
    assert len(out) > 1 and max(held) < 4 << 20  # a chunk more than the bound at most
    got = sum((np.array([b.column(1).to_numpy().sum()]) for b in out), np.zeros(1))
    assert got == sum(len(t.split(" ")) for t in texts)
