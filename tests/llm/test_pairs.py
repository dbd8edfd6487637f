"""The n-gram join, WARC transactions, URL filter and the pipeline on the small tables."""

from __future__ import annotations

import base64
import hashlib
import io
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalforge.llm import ngram_join, url_filter, warc

from .conftest import PASSAGE, key


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    union = ngram_join.Union(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                union.join(i, j)
    ids: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[union.find(i)] = min(r[0], ids.get(union.find(i), r[0]))
    return [(r[0], len(sets[i]), ids.get(union.find(i))) for i, r in enumerate(rows)]


def text_rows(rows):
    return tuple(sorted(tuple("~" if v is None else str(v) for v in r) for r in rows))


def test_components(docs, rows, empty):
    assert key(ngram_join.components(docs).collect(), "doc_id", "n_shingles", "component_id") == text_rows(brute_components(rows))
    assert ngram_join.components(empty).count() == 0


def test_families_of_near_copies_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    rng = np.random.default_rng(5)
    rows = []
    for f in range(6):
        base = [f"w{rng.integers(10_000)}" for _ in range(80)]
        for _ in range(30):
            own = list(base)
            for k in rng.integers(0, 80, rng.integers(0, 4)):
                own[k] = f"x{rng.integers(10_000)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000 + k, " ".join(f"y{rng.integers(10_000)}" for _ in range(60)) + " " + PASSAGE) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.components(docs).collect()
    assert key(got, "doc_id", "n_shingles", "component_id") == text_rows(brute_components(rows))
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.component_id for r in got})


def test_texts_of_more_shingles_than_a_byte_of_size_classes(spark):
    words = [f"b{k}" for k in range(400_000)]
    rows = [(1, " ".join(words[:300_000])), (2, " ".join(words[:290_000])), (3, " ".join(words)), (4, " ".join(words[:220_000]))]
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert key(got, "doc_id", "n_shingles", "component_id") == text_rows(brute_components(rows))


def test_a_long_path_of_random_ids_is_one_component(spark):
    ids = np.unique(np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 3000))
    np.random.default_rng(4).shuffle(ids)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids[:-1], ids[1:])], "a long, b long")
    got = ngram_join.connected(edges, "path").collect()
    assert len(got) == 3000 and {r.label for r in got} == {int(ids.min())}


def test_a_chain_of_drifting_texts(spark):
    words = [f"w{k}" for k in range(4 * 1500 + 44)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 44])) for k in range(1500)]
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert key(got, "doc_id", "n_shingles", "component_id") == text_rows(brute_components(rows))
    assert {r.component_id for r in got} == {0}


def test_rows_of_one_id_or_none_keep_their_own_texts(spark):
    drift = lambda name, k: " ".join(f"{name}{w}" for w in range(4 * k, 4 * k + 44))
    rows = [(1, drift("a", 0)), (1, drift("b", 0)), (2, drift("a", 1)), (3, drift("b", 1)), (4, drift("c", 0)), (None, drift("c", 1)), (None, drift("c", 1)), (5, drift("c", 2)), (None, drift("d", 0)), (None, drift("d", 1)), (None, "")]
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert key(got, "doc_id", "n_shingles", "component_id") == text_rows(brute_components(rows))
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_signature_tree_equals_all_pairs(seed):
    rng = np.random.default_rng(seed)
    bases = [rng.integers(0, 2**63, rng.integers(3, 60), dtype=np.uint64) for _ in range(4)]
    sets = []
    for _ in range(rng.integers(1, 90)):
        b = bases[rng.integers(4)]
        kept = b[rng.random(len(b)) > rng.random() * 0.3]
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, rng.integers(0, len(b) // 4 + 1), dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    union = ngram_join.Union(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if ngram_join.links(sets[i], sets[j]):
                union.join(i, j)
    assert ngram_join.join_sets(sets) == [union.find(i) for i in range(len(sets))]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10_000))
def test_prefixes_of_sets_that_link_share_enough(n, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    drop = rng.integers(0, len(a) // 4 + 1)
    b = np.sort(np.delete(a, rng.choice(len(a), drop, replace=False)))
    if len(b) and ngram_join.links(a, b):
        hot = np.sort(rng.choice(ngram_join.codes(a, 7), len(a) // 3, replace=False))
        pa, pb = (set(ngram_join.prefix(ngram_join.codes(s, 7), hot).tolist()) for s in (a, b))
        least = min(int(ngram_join.shared_least(np.array([ngram_join.size_class(len(s))]))[0]) for s in (a, b))
        assert len(pa & pb) >= least


def test_sets_that_share_a_frequent_shingle_are_tied_only_where_sizes_allow_a_link():
    sizes = [400] * 40 + [5000] + [430, 560, 740]
    nodes, classes = np.arange(len(sizes)) * 7 - 50, np.array([ngram_join.size_class(n) for n in sizes])
    ties = [(a, b) for r in ngram_join._tied(np.zeros(len(sizes), np.uint32), nodes, classes) for a, b, n, least in zip(*(c.to_pylist() for c in r.columns)) if n >= least]
    union, of = ngram_join.Union(len(sizes)), {int(n): k for k, n in enumerate(nodes)}
    for a, b in ties:
        union.join(of[a], of[b])
    roots = [union.find(k) for k in range(len(sizes))]
    assert len({roots[k] for k in range(len(sizes)) if k != 40}) == 1 and roots.count(roots[40]) == 1


def test_a_family_of_copies_has_its_own_shingles_before_those_of_all_texts():
    code = np.arange(1, 41, dtype=np.int64)
    place = np.where(code <= 12, 40 + code, code)  # the first ones are a passage of many texts
    assert ngram_join.prefix(code, code, place).min() > 12


def test_one_passage_does_not_tie_short_texts():
    rng = np.random.default_rng(2)
    sets = [np.unique(np.concatenate([rng.integers(0, 2**63, 30, dtype=np.uint64), np.arange(4, dtype=np.uint64)])) for _ in range(9)]
    parts = [ngram_join.prefix(ngram_join.codes(s, 1), np.zeros(0, np.int64)) for s in sets]
    k, n = np.concatenate(parts), np.repeat(np.arange(9), [len(p) for p in parts])
    found = list(ngram_join._tied(k.astype(np.uint32), n, np.repeat([ngram_join.size_class(len(s)) for s in sets], [len(p) for p in parts])))
    assert found and not any(n >= least for r in found for n, least in zip(r.column(2).to_pylist(), r.column(3).to_pylist()))


# -- WARC -----------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, type string, first string"


def page_rows():
    big = "<p>ü 漢</p>" * 20_000
    rows = [(1, "http://a.net/x", "same"), (2, "http://b.net/", "same"), (3, None, "same"), (4, "no scheme", None), (5, "https://c.org/a?b#c", ""), (6, "http://d.com/\r\nWARC/1.1\r\n", "one\r\n\r\nWARC/1.1\r\n\r\ntwo"), (7, "http://e.com", big), (None, "http://f.com", "lonely"), (None, "http://f.com", "same"), (8, "http://g.com/", "twice"), (8, "http://g.com/", "twice")]
    return [(*r, "t", "f") for r in rows]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    rows = page_rows()
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3), least).collect()
    want = []
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        holder = max((r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None), default=None) if len(raw) >= least else None
        again = holder is not None and holder != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", holder if again else None))
    assert key(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == text_rows(want)


def test_warc_of_no_pages_and_its_captures(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), PAGES)
    assert warc.round_trip(pages.limit(0)).count() == 0
    path = f"file://{tmp_path}/w"
    warc.write(pages, path)
    records = warc.read(spark, path)
    assert {r["type"]: r["count"] for r in records.groupBy("type").count().collect()} == {"request": 11, "metadata": 11, "response": 7, "revisit": 4}
    done = warc.captures(records).collect()
    assert len(done) == 11 and all(r.main and r.request and r.metadata for r in done)


def test_records_end_where_their_length_says():
    stream = io.BufferedReader(io.BytesIO(b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 12\r\n\r\nWARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
    assert [len(b) for _, b in warc.records(stream)] == [12, 0]


# -- URL filter ------------------------------------------------------------------------------------------------------------

RULES = [url_filter.parse_rule(r) for r in ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")]
URLS = ["http://a.net/x", "http://a.example.net/en/1", "http://example.net/en/2", "http://notexample.net/en/2", "HTTP://WWW.Example.COM/de/x?q", "http://example.com/DE/x", "http://b.org/fr/a#b", "https://b.org/en/a", "http://net", "://x/y", "nothing", None, "", "http://a.net/x", "http://k.com/en/" + "a" * 50_000, "http://münchen.org/fr/ü😀", "a://b://c/d"]


def parsed(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def ruled(host, path):
    fits = [(len(r.name), r.name, r.verdict) for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits)[1:] if fits else (None, None)


def generated(n):
    rng = np.random.default_rng(8)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(4, 9)))
    out = []
    for _ in range(n):
        out += [f"http://{word('abcde')}.net/{word('abcdefgh')}?q=1", f"https://{word('stuvw')}.org/fr/{word('stuvwxyz')}", f"http://{word('abcdestuvw')}.com/{word('abcdestuvw')}#x"]
    return out


def brute_cut(scored):
    """The cut from (verdict, part, score) of the distinct URLs that rules decide."""
    own = [(v, min(max(math.floor((s + 4) * 50), 0), 400)) for v, part, s in scored if part in url_filter.CALIBRATING]
    bins = sorted({b for _, b in own})
    n = Counter(v for v, _ in own)
    if len(n) < 2:
        return None
    gain = lambda b: sum(x < b for v, x in own if v == "block") / n["block"] - sum(x < b for v, x in own if v == "allow") / n["allow"]
    best = max(bins, key=lambda b: (round(gain(b), 12), -b))
    at = bins.index(best)
    return ((bins[at - 1] + 1 if at else best) + best) / 2 * 8 / 400 - 4


@pytest.mark.parametrize("more", [0, 150])
def test_url_rules_ratio_and_verdict(spark, more):
    urls = URLS + generated(more)
    rows = [(k, u, "clash") for k, u in enumerate(urls)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string"), RULES).collect()}
    assert len(got) == len(urls)
    distinct = sorted({parsed(u) for u in urls} - {("", "")})
    parts = spark.createDataFrame(distinct, "host string, path string").withColumn("part", url_filter.part_of(F.col("host"), F.col("path"))).collect()
    part = {(r.host, r.path): r.part for r in parts}
    grams = lambda h, p: (lambda s: [s[k : k + 4] for k in range(len(s) - 3)])("\2\2\2" + h + p + "\3")
    seen = {k: Counter() for k in ("allow", "block")}
    for h, p in distinct:
        if (v := ruled(h, p)[1]) and part[h, p] < 7:
            for g in grams(h, p):
                for o in range(4):
                    seen[v][g[3 - o :]] += 1
                    seen[v][f"c{o}{g[3 - o : 3]}"] += 1

    def chance(v, g):
        out = 1 / 256
        for o in range(4):
            out = (seen[v][g[3 - o :]] + 4 * out) / (seen[v][f"c{o}{g[3 - o : 3]}"] + 4)
        return out

    score = {(h, p): sum(math.log(chance("allow", g)) - math.log(chance("block", g)) for g in grams(h, p)) / len(grams(h, p)) for h, p in distinct}
    decided = [(ruled(*u)[1], part[u], score[u]) for u in distinct if ruled(*u)[1]]
    cut = brute_cut(decided)
    for k, u in enumerate(urls):
        h, p = parsed(u)
        rule, verdict = ruled(h, p)
        assert (got[k].host, got[k].path, got[k].rule) == (h, p, rule)
        if not h and not p:
            assert got[k].score is None and got[k].verdict == "block"
            continue
        assert got[k].score == pytest.approx(score[h, p], abs=1e-6)
        assert got[k].cut == (None if cut is None else pytest.approx(cut))
        assert got[k].verdict == (verdict or ("allow" if cut is None or got[k].score >= cut else "block"))
    if more:  # the part that neither made the models nor the cut
        held = [(v, s >= cut) for v, x, s in decided if x == 9]
        assert len(held) > 20 and all(ok == (v == "allow") for v, ok in held)


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.xyz/b")], "page_id long, url string")
    assert url_filter.judge(pages, RULES).first().verdict == "allow"
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_url_filter_runs_no_python(spark):
    plan = url_filter.judge(spark.createDataFrame([(1, "http://a.net/b"), (2, "http://a.org/fr/b")], "page_id long, url string"), RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- pipeline ---------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        held = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {r.doc_id for r in held.collect()}
    component = {i: c for i, _, c in brute_components([r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]) if i is not None}
    assert ids == {*component.values(), None}  # rows without an id stay
    red = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/pii").collect()}
    assert "<EMAIL>" in red[18].text and PASSAGE not in red[5].text and red[5].n_chars == len(red[5].text)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_grams_beyond_the_broadcast_are_rated_alike(spark):
    from evalforge.llm import url_filter

    rows = spark.createDataFrame([(k, g) for k in range(50) for g in ("hot", f"g{k % 7}", f"h{k}")], "key int, gram string")
    ratios = spark.createDataFrame([("hot", 50, 0.5), *((f"g{k}", 8, k / 10) for k in range(7)), *((f"h{k}", 1, -k / 10) for k in range(50))], "gram string, n long, ratio double")
    small, large = (sorted(map(tuple, url_filter.rated(rows, ratios, most).select("key", "gram", "ratio").collect())) for most in (1000, 5))
    assert small == large and len(small) == 150


def test_long_pages_have_archives_of_their_own(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "LONG", 1000)
    monkeypatch.setattr(warc, "LONG_ARCHIVE", 9000)
    rows = [(k, f"http://a.net/{k}", "x" * (40 + k % 7) if k % 10 else "y" * (1500 + 30 * k)) for k in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = str(tmp_path / "skewed")
    warc.write(pages, path)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "skewed" / "long").glob("*.gz")]
    assert len(sizes) >= 5 and max(sizes) < 2 * 9000 + 4000
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.round_trip(pages).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: len(h) for k, _, h in rows} and len(got) == 100
    ids = [r.record_id for r in warc.read(spark, path).select("record_id").collect()]
    assert len(ids) == len(set(ids)) == 300
