"""Queries against their SQL on the smallest tables; operators against hand-made and brute-force values."""

from __future__ import annotations

import io
import itertools
import math
import tarfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalforge.functions import exprs as E
from evalforge.functions import hashes
from evalforge.operators import curves, graph, maps, metrics, ranking, worlds
from evalforge.plans import catalog
from evalforge.sources import archives, files
from evalforge.streaming import inventory

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A query of each kind; the driver compares all of them.
CHOSEN = """confusion_counts micro_f1 ece risk_coverage_curve selective_bundle aurc_tie_averaged aurc_weighted threshold_grid causal_evidence_gap jaccard_components rq1_metrics bottleneck corruption_gate
manifest_validation exclusion_flow cross_modal_join clip_membership partition_cover alignment_audit graded_source_maps connected_components bootstrap_clip bootstrap_stratified bootstrap_component paired_contrasts d_axis_cells box_overlap_antijoin aligned_window_edge
stratified_sample rule_prevalence kendall_tau_b hash_split bootstrap_metrics replayed_bootstrap curve_dominance component_audit group_id hash_manifest_check member_inventory phash_hamming path_safety infidelity expected_grid""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(df: pd.DataFrame) -> list[tuple]:
    def text(v) -> str:
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.6f}".replace("-0.000000", "0.000000") if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    assert rows_of(catalog.queries()[name](spark, SF).toPandas()) == rows_of(duck.execute(catalog.oracle_sql()[name]).fetchdf())


def test_every_query_has_sql_or_a_test():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"d_axis_bootstrap", "endpoint_bounds", "gate_bounds", "graded_gate", "round12_gate", "temperature_fit"}


def plain_aurc(conf, wrong):
    """The mean risk over coverages; samples of one confidence count as their mean."""
    order = sorted(zip(conf, wrong), key=lambda x: -x[0])
    risks, done, lost = [], 0, 0.0
    for _, tie in itertools.groupby(order, key=lambda x: x[0]):
        tie = [w for _, w in tie]
        risks += [(lost + k * sum(tie) / len(tie)) / (done + k) for k in range(1, len(tie) + 1)]
        done, lost = done + len(tie), lost + sum(tie)
    return sum(risks) / len(risks)


def plain_f1(target, pred):
    out = []
    for t, p in zip(zip(*target), zip(*pred)):
        both = sum(a and b for a, b in zip(t, p))
        out.append(2 * both / (sum(t) + sum(p)) if sum(t) + sum(p) else 0.0)
    return sum(out) / len(out)


def test_axis_draws_equal_plain_loops(spark):
    from evalforge.operators import draws
    from evalforge.plans import inference
    from evalforge.sources import adapters as A

    reps = 2
    got = {(r.axis, r.model, r.family, r.level, r.rep): r.value for r in inference.axis_draws(spark, SF, (43,), reps).collect()}
    rows = {h: A.actions(spark, SF, (43,), A.MODELS, A.FAMILIES, (0, 3), h, clean=True).toPandas() for h in ("action", "rationale")}
    clusters = sorted(rows["action"].cluster_key.unique())
    n = len(clusters)
    for rep in range(reps):
        drawn = [c for c, k in zip(clusters, draws.weights(n, [rep])[0]) for _ in range(k)]
        for (model, family, level), own in rows["action"].groupby(["model", "family", "level"]):
            if level == 0 and family:
                continue
            by = dict(list(own.groupby("cluster_key")))
            picked = pd.concat([by[c] for c in drawn])
            pred = [[int(z >= 0) for z in v] for v in picked.logit]
            clean = [[int(z >= 0) for z in v] for v in picked.clean_logit]
            wrong = [int(p != list(t)) for p, t in zip(pred, picked.target)]
            conf = [1 / (1 + math.exp(-max(z))) for z in picked.logit]
            assert got["A", model, family, level, rep] == pytest.approx(plain_f1(picked.target, pred))
            assert got["C1", model, family, level, rep] == pytest.approx(sum(p != c for p, c in zip(pred, clean)) / len(pred))
            assert got["S", model, family, level, rep] == pytest.approx(plain_aurc(conf, wrong))
        for (family, level), own in rows["rationale"].query("model == 1").groupby(["family", "level"]):
            if level == 0 and family:
                continue
            by = dict(list(own.groupby("cluster_key")))
            picked = pd.concat([by[c] for c in drawn])
            assert got["R", 1, family, level, rep] == pytest.approx(plain_f1(picked.target, [[int(z >= 0) for z in v] for v in picked.logit]))


def test_quantiles_and_slices(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.exponential(1, 300), np.full(100, 0.25), [1e9]])
    rows = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 3.0), ("b", None), ("c", None)], "k string, v double")
    got = {r.k: r for r in ranking.quantiles(rows, ["k"], "v", {"p10": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    assert got["a"].n == 401 and [got["a"].p10, got["a"].mid, got["a"].top] == pytest.approx(np.quantile(values, [0.1, 0.5, 1.0]))
    assert (got["b"].n, got["b"].mid) == (1, 3.0) and "c" not in got
    conf = sorted([*(1 - 2.0 ** -rng.uniform(0, 60, 300)), *rng.random(300), 0.0, 1.0, 0.5, 0.75, np.nextafter(0.5, 0), np.nextafter(0.5, 1)])
    slices = [r.s for r in spark.createDataFrame([(k, float(c)) for k, c in enumerate(conf)], "k int, conf double").withColumn("s", ranking._slice()).orderBy("k").collect()]
    assert slices == sorted(slices, reverse=True) and len(set(slices)) > 300


@pytest.mark.parametrize(("change", "want"), [({}, "PASS"), ({"d_c1": 0.0}, "FAIL"), ({"enough_seeds": False}, "FAIL"), ({"point": False}, "FAIL"), ({"families": False}, "FAIL"), ({"d_s": -0.01}, "PARTIAL"), ({"d_a": -0.02}, "PARTIAL"), ({"d_r": -0.02}, "PARTIAL")])
def test_four_axis_verdict(spark, change, want):
    from evalforge.plans import inference

    held = {"point": True, "enough_seeds": True, "families": True, "d_a": 0.0, "d_r": 0.0, "d_s": 0.0, "d_c1": 0.001} | change
    frame = lambda names, kind: spark.createDataFrame([tuple(held[n] for n in names)], ", ".join(f"{n} {kind}" for n in names))
    assert inference.d_verdict(frame(["point", "enough_seeds", "families"], "boolean"), frame(["d_a", "d_r", "d_s", "d_c1"], "double")).first().verdict == want


def test_weighted_ties_against_all_orders(spark):
    errors, conf, weight = [0, 1, 1, 0], [0.9, 0.9, 0.4, 0.1], [2, 3, 1, 0]
    df = spark.createDataFrame([(1, c, e, w) for c, e, w in zip(conf, errors, weight)], "k int, conf double, error int, w int")
    got = ranking.aurc_tie_averaged(df, ["k"], "w").first()["aurc"]
    first = [0, 0, 1, 1, 1]
    risks = [np.mean(np.cumsum([*p, 1]) / np.arange(1, 7)) for p in itertools.permutations(first)]
    assert got == pytest.approx(np.mean(risks))


@pytest.mark.parametrize(("labels", "scores", "want"), [([0, 1], [0.9, 0.1], 1.0), ([0, 1], [0.1, 0.9], 0.0), ([0, 1], [0.5, 0.5], 0.5), ([0, 0], [0.5, 0.1], None)])
def test_auroc(spark, labels, scores, want):
    df = spark.createDataFrame([(1, s, e) for s, e in zip(scores, labels)], "k int, conf double, error int")
    assert ranking.auroc(df, ["k"]).first()["auroc"] == want


def test_f1_of_nothing(spark):
    counts = spark.createDataFrame([(0, 0, 0), (2, 1, 1)], "tp int, fp int, fn int")
    assert [r.f1 for r in metrics.class_f1(counts).orderBy("tp").collect()] == [0.0, pytest.approx(4 / 6)]
    assert metrics.class_f1(counts, 1.0).orderBy("tp").first().f1 == 1.0


def test_crossings(spark):
    a, b = [0, 0.3, 0.1], [0.1, 0.2, 0.2]
    df = spark.createDataFrame([(1, i, x - y) for i, (x, y) in enumerate(zip(a, b))], "k int, i int, d double")
    assert curves.crossings(df, ["k"], "i", "d").first().n_crossings == 2


def test_empty_sets_are_alike(spark):
    df = spark.createDataFrame([([0, 0], [0, 0]), ([1, 0], [1, 1])], "a array<int>, b array<int>")
    o = E.overlap(F.col("a"), F.col("b"))
    assert [r.j for r in df.select(E.jaccard(o["common"], o["joint"]).alias("j")).collect()] == [1.0, 0.5]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges, spark.createDataFrame([(900,)], "node long")).collect()}
    assert got == {900: 900}
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert all(got[k] == 0 for k in range(201)) and got[501] == 500


def test_maps_are_permutations_that_leave_clips(spark):
    rows = spark.createDataFrame([(i, f"c{i % 60}_{i}.jpg", f"c{i % 60}") for i in range(101)], "sample_ix long, name string, clip string")
    cycles = maps.cycles(rows, "name", "clip", "salt")
    got = maps.graded(cycles, 101).toPandas()
    for q, part in got.groupby("q_ix"):
        assert sorted(part.src_ix) == sorted(part.dst_ix) == list(range(101))
        moved = part[part.src_ix != part.dst_ix]
        assert len(moved) == (101 if q == 4 else 2 * int(q * 0.25 * 101 / 2 + 0.5)) and all(moved.src_ix % 60 != moved.dst_ix % 60)


def test_maps_that_no_rotation_allows_fail(spark):
    rows = spark.createDataFrame([(i, f"c{i % 4}_{i}.jpg", f"c{i % 4}") for i in range(101)], "sample_ix long, name string, clip string")
    with pytest.raises(Exception, match="every rotation"):
        maps.cycles(rows, "name", "clip", "salt").count()


@pytest.mark.parametrize(("rule", "want"), [("x0 OR x1 XOR x2 AND x3", lambda b: b[0] | (b[1] ^ (b[2] & b[3]))), ("MAJORITY(x0, x1)", lambda b: b[0] & b[1]), ("NOT (x0 XOR x1)", lambda b: 1 - (b[0] ^ b[1]))])
def test_rules(spark, rule, want):
    for r in worlds.rows(spark, 4).select("row", worlds.compile_rule(rule, F.col("row")).alias("y")).collect():
        assert r.y == want([r.row >> k & 1 for k in range(4)])


@pytest.mark.parametrize("rule", ["x0 AND", "(x0", "x0 x1", "x0 & x1"])
def test_rules_that_are_none(spark, rule):
    with pytest.raises(ValueError):
        worlds.compile_rule(rule, F.col("row"))


def test_vectorised_bootstrap_equals_the_loop(spark):
    from evalforge.operators import draws, resample

    stats = spark.createDataFrame([(k * 3, 1, k % 3 + 1, k % 2) for k in range(20)], "c long, m int, n long, wrong long")
    got = {r.rep: (r.n, r.wrong) for r in resample.vectorised(stats, "c", ["m"], ["n", "wrong"], 10).collect()}
    for rep in range(10):
        draw = [k for k, w in enumerate(draws.weights(20, [rep])[0]) for _ in range(w)]
        assert got[rep] == (sum(k % 3 + 1 for k in draw), sum(k % 2 for k in draw))


def test_ranges_of_a_bootstrap_decide_only_its_plan(spark, monkeypatch):
    from evalforge.operators import resample

    stats = spark.createDataFrame([(k * 977, k % 2, k % 3 + 1, k % 5) for k in range(300)] + [(977, 2, 1, 1)], "c long, m int, n long, wrong long")
    one = sorted(resample.vectorised(stats, "c", ["m"], ["n", "wrong"], 30).collect())
    monkeypatch.setattr(resample, "RANGE", 37)
    monkeypatch.setattr(resample, "REP_BLOCK", 7)
    assert one == sorted(resample.vectorised(stats, "c", ["m"], ["n", "wrong"], 30).collect()) and len(one) == 90
    assert all(r.n > 0 for r in one if r.m < 2)


def test_temperature_has_no_slope(spark):
    t = catalog.queries()["temperature_fit"](spark, SF).collect()
    assert len(t) == 2 and all(0.05 <= r.temperature <= 20 for r in t)


def archive(path):
    with tarfile.open(path, "w:gz", format=tarfile.PAX_FORMAT) as tar:
        for name, body in (("a/One.txt", b"one"), ("a/one.txt", b"ONE"), ("../up", b""), ("ü.txt", b"x" * 5000)):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))


def test_archives(spark, tmp_path):
    archive(tmp_path / "t.tar.gz")
    archives.register(spark)
    rows = spark.read.format("tar_members").option("paths", f"{tmp_path}/t.tar.gz").load()
    assert [(r.path, r.size) for r in rows.orderBy("ordinal").collect()] == [("a/One.txt", 3), ("a/one.txt", 3), ("../up", 0), ("ü.txt", 5000)]
    again = archives.from_binary(spark.read.format("binaryFile").load(f"{tmp_path}/*.gz"))
    assert {r.sha256 for r in again.collect()} == {r.sha256 for r in rows.collect()}
    assert archives.audit(rows).first().asDict() == {"n_members": 4, "n_files": 4, "n_unsafe": 1, "n_repeated": 0, "n_case_clash": 1}
    assert archives.artifact_index(spark, str(tmp_path)).count() == 1
    raw = (tmp_path / "t.tar.gz").read_bytes()
    assert archives.gzip_ok(raw) and not archives.gzip_ok(raw + b"x") and not archives.gzip_ok(raw[:-3])
    with pytest.raises(ValueError):
        list(archives.members(io.BytesIO(raw), "t", max_members=2))


def test_files(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"file_name": "a", "actions": [1, 0], "rationales": []}\n\n{"file_name": "b", "actions": [], "rationales": [1]}\n')
    assert files.jsonl(spark, str(tmp_path / "m.jsonl")).count() == 2
    with pytest.raises(ValueError, match="rationales"):
        files.require_schema(spark.createDataFrame([("a", [1])], "file_name string, actions array<int>"), files.MANIFEST)
    with pytest.raises(Exception, match="no word for"):
        files.canonical_json(spark.createDataFrame([(float("nan"), "y")], "b double, a string")).collect()
    out = files.canonical_json(spark.createDataFrame([(1.5, "x"), (float("nan"), "y")], "b double, a string"), strict=False).collect()
    assert [r.json for r in out] == ['{"a":"x","b":1.5}', None]
    assert [tuple(r) for r in files.byte_ranges(spark, 10, 4).collect()] == [(0, 0, 3), (1, 4, 7), (2, 8, 9)]
    plan = spark.createDataFrame([(0, 4, "a"), (1, 4, "b"), (2, 2, "c")], "ix long, bytes long, sha256 string")
    found = spark.createDataFrame([(0, 4, "a"), (1, 3, "b"), (3, 1, "d")], "ix long, bytes long, sha256 string")
    assert {r.ix: r.status for r in files.verify_chunks(plan, found).collect()} == {0: "ok", 1: "size", 2: "missing", 3: "extra"}


def tar_bytes(names, kind=tarfile.USTAR_FORMAT, **headers) -> bytes:
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=kind, **headers) as tar:
        for name, body in names:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return raw.getvalue()


def test_strict_archives(spark, tmp_path):
    import gzip
    import hashlib

    names = [("a/one.txt", b"one"), ("b" * 99, b""), ("d/" * 60 + "deep.txt", b"x" * 5000)]
    plain = tar_bytes(names)
    read = lambda raw, **k: list(archives.strict_members(io.BytesIO(raw), "t", **k))
    want = [("t", k, n, "file", len(b), hashlib.sha256(b).hexdigest().upper(), []) for k, (n, b) in enumerate(names)]
    assert read(plain) == want == read(gzip.compress(plain)) == [m[:6] + ([],) for m in archives.members(io.BytesIO(plain), "t")]
    long = "e/" * 200 + "ü.txt"
    pax = tar_bytes([(long, b"y")], tarfile.PAX_FORMAT, pax_headers={"comment": "c"})
    ((_, _, path, _, size, _, flags),) = read(pax)
    key = hashlib.sha256(b"comment").hexdigest().upper()
    assert (path, size, flags) == (long, 1, ["PATH_OVERRIDE", f"GLOBAL_KEY_SHA256:{key}"])
    assert archives.pax_records(b"9 a=b=c\n\n"[:8].replace(b"9", b"8")) == {"a": "b=c"}
    zipped = gzip.compress(plain)
    broken = [plain[:700], plain[:-9000], plain + b"x", zipped + b"x", zipped[:-4], zipped[:-8] + b"0000" + zipped[-4:], gzip.compress(plain) * 2, plain[:148] + b"0000000\0" + plain[156:], tar_bytes(names, tarfile.GNU_FORMAT), tar_bytes([("x", b"")], tarfile.PAX_FORMAT, pax_headers={"linkpath": "y"})]
    for raw in broken:
        with pytest.raises(ValueError):
            read(raw)
    for caps in ({"max_members": 2}, {"max_bytes": 4000}):
        with pytest.raises(ValueError):
            read(plain, **caps)
    (tmp_path / "t.tar.gz").write_bytes(zipped)
    spark.dataSource.register(archives.TarSource)
    for where in (f"{tmp_path}/t.tar.gz", f"file://{tmp_path}/t.tar.gz"):
        assert spark.read.format("tar_members").options(paths=where, strict="true").load().count() == 3
    stored = spark.read.format("binaryFile").load(f"{tmp_path}/t.tar.gz")
    assert archives.from_binary(stored, strict=True).select("path").distinct().count() == 3
    one = hashlib.sha256(b"one").hexdigest()
    assert archives.member_content(stored, "a/one.txt", one).first().content == b"one" and archives.member_content(stored, "none", one).count() == 0
    with pytest.raises(Exception, match="other bytes"):
        archives.member_content(stored, "a/one.txt", "0" * 64).collect()


def test_sources_and_sinks(spark, tmp_path):
    import hashlib
    import json

    (tmp_path / "l.csv").write_text("uuid,split,label\na,train,1\nb,test,0\n")
    (tmp_path / "r.csv").write_text("uuid,split,label\na,train,1\na,test,0\n")
    schema = spark.createDataFrame([], "uuid string, split string, label int").schema
    read = lambda f: files.csv_label_blind(spark, f"{tmp_path}/{f}", schema, ["uuid", "split"], "split")
    rows, whole = read("l.csv")
    assert sorted(map(tuple, rows.collect())) == [("a", "train"), ("b", "test")] and rows.columns == ["uuid", "split"]
    raw = (tmp_path / "l.csv").read_bytes()
    assert tuple(whole.first())[1:] == (len(raw), hashlib.sha256(raw).hexdigest().upper())
    with pytest.raises(Exception, match="several splits"):
        read("r.csv")[0].collect()
    assert files.read_expected(spark, f"{tmp_path}/l.csv", len(raw), hashlib.sha256(raw).hexdigest()).first().content == raw
    with pytest.raises(Exception, match="expected bytes"):
        files.read_expected(spark, f"{tmp_path}/l.csv", len(raw) + 1, hashlib.sha256(raw).hexdigest()).collect()

    lines = spark.createDataFrame([("p", b"one\n\nt\xffo\ntail"), ("q", b"x\n"), ("r", b"")], "path string, content binary")
    got = {(r.path, r.ix): (bytes(r.line), r.complete) for r in files.segments(lines, 5).collect()}
    assert got == {("p", 0): (b"one\n", True), ("p", 1): (b"\n", True), ("p", 2): (b"t\xffo\n", True), ("p", 3): (b"tail", False), ("q", 0): (b"x\n", True)}
    with pytest.raises(Exception, match="too long"):
        files.segments(lines, 3).collect()

    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.jpg").write_bytes(b"A")
    named = spark.createDataFrame([("a.jpg", 1), ("b.jpg", 2)], "file_name string, k int")
    assert {r.file_name: r.content for r in files.images(spark, named, f"{tmp_path}/img").collect()} == {"a.jpg": b"A", "b.jpg": None}

    ids = spark.range(25).withColumnRenamed("id", "k")
    dealt = files.batches(ids, "k", 10, 7).collect()
    assert sorted((r.batch, r.place) for r in dealt) == [(k // 10, k % 10) for k in range(25)] and [r.k for r in sorted(dealt, key=lambda r: (r.batch, r.place))] != list(range(25))
    chosen = [r.k for r in files.sampled(ids, "k", 5, "s").collect()]
    assert chosen == sorted(sorted(range(25), key=lambda k: hashlib.sha256(f"s|{k}".encode()).hexdigest())[:5])
    assert [r.k for r in files.first_records(ids, ["k"], 3).collect()] == [0, 1, 2]
    pack = files.audit_pack(ids.withColumn("s", F.col("k") % 2), ["s"], "k", 3, "s", ["seen"]).collect()
    for s in (0, 1):
        assert sorted(r.k for r in pack if r.s == s) == sorted(sorted(range(s, 25, 2), key=lambda k: hashlib.sha256(f"s|{k}".encode()).hexdigest())[:3])

    tidy = spark.createDataFrame([("point", "A", 1, 0.1, None, None), ("check", None, None, None, "c", True), ("point", "A", 0, 1e-9, None, None)], "record_type string, axis string, index int, value double, check_name string, passed boolean")
    files.write_tidy_csv(tidy, f"{tmp_path}/tidy")
    text = "".join(f.read_text() for f in sorted((tmp_path / "tidy").glob("*.csv")))
    assert text.splitlines() == ["record_type,axis,index,value,check_name,passed", "check,,,,c,true", "point,A,0,1.0E-9,,", "point,A,1,0.1,,"]
    events = spark.createDataFrame([(1, "stop"), (0, "start")], "sequence int, event string")
    files.write_event_log(events, f"{tmp_path}/log")
    said = "".join(f.read_text() for f in sorted((tmp_path / "log").glob("*.json")))
    assert [json.loads(x) for x in said.splitlines()] == [{"sequence": 0, "event": "start"}, {"sequence": 1, "event": "stop"}]
    with pytest.raises(ValueError):
        files.write_event_log(events.filter("sequence = 1"), f"{tmp_path}/log2")

    a, b = "A" * 64, "B" * 64
    flags = {"": True, "PATH_OVERRIDE|SIZE_OVERRIDE": True, "SIZE_OVERRIDE|PATH_OVERRIDE": False, f"GLOBAL_KEY_SHA256:{a}|EXTENDED_KEY_SHA256:{a}": True, f"GLOBAL_KEY_SHA256:{b}|GLOBAL_KEY_SHA256:{a}": False, f"GLOBAL_KEY_SHA256:{a}|GLOBAL_KEY_SHA256:{a}": False, "OTHER": False, f"EXTENDED_KEY_SHA256:{a.lower()}": False}
    got = spark.createDataFrame([(f,) for f in flags], "f string").select("f", files.pax_flags_ok(F.col("f")).alias("ok")).collect()
    assert {r.f: r.ok for r in got} == flags


def test_command_line(spark, tmp_path):
    from evalforge import run

    levels = spark.read.parquet(f"{SF}/orders.parquet").agg(F.countDistinct("o_orderpriority"), F.countDistinct("o_orderstatus"), F.countDistinct(F.year("o_orderdate"))).first()
    assert run.main(["expected_grid", SF, "--out", f"{tmp_path}/grid"]) == 0 and spark.read.parquet(f"{tmp_path}/grid").count() == math.prod(levels)
    with pytest.raises(SystemExit):
        run.main(["no_such_query", SF])


def test_stream_of_members(spark, tmp_path):
    rows = spark.range(10).select((F.col("id") % 4).alias("k"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("at"))
    rows.write.parquet(f"{tmp_path}/in")
    seen = inventory.first_seen(inventory.stream(spark, f"{tmp_path}/in", rows.schema), ["k"], "at")
    inventory.write_once(seen, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3]


def test_entry_without_the_corpus_operators(spark, monkeypatch):
    import importlib.util

    import __spark_entry__

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith("evalforge.llm") else real(n, *a))
    assert set(__spark_entry__.queries()) == set(catalog.queries()) and __spark_entry__.entry(spark).count() == 41


def plain_stretch(low, high, shortest=6):
    import statistics

    found = []
    for a in range(len(low)):
        for b in range(a + shortest, len(low) + 1):
            x, y = statistics.median(low[a:b]), statistics.median(high[a:b])
            if x <= 4 and y >= 0.92:
                found.append((a - b, x, -y, a))
    if not found:
        return None
    n, x, y, a = min(found)
    return a, -n, x, -y


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(880, 960)), max_size=30))
def test_longest_stretch(rows):
    from evalforge.operators.stretches import best_stretch

    low, high = [float(r[0]) for r in rows], [r[1] / 1000 for r in rows]
    assert best_stretch(low, high, 4, 0.92) == plain_stretch(low, high)


def test_longest_stretch_of_a_long_series():
    import statistics
    import time

    from evalforge.operators.stretches import best_stretch

    rng = np.random.default_rng(3)
    low, high = rng.integers(0, 8, 100_000).astype(float).tolist(), (0.9 + rng.integers(0, 100, 100_000) / 1000).tolist()
    low[40_000:60_000] = [6.0] * 20_000
    began = time.time()
    at, n, x, y = best_stretch(low, high, 4, 0.92)
    assert x == statistics.median(low[at : at + n]) <= 4 and y == statistics.median(high[at : at + n]) >= 0.92
    assert n > 50_000 and time.time() - began < 60


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_runs_go_on_in_the_next_batch(size):
    """Whatever the batches, users' best windows are those of all their runs; none but users' rows come out."""
    import pyarrow as pa

    from evalforge.operators.stretches import best_stretch
    from evalforge.plans import scenes

    rng = np.random.default_rng(9)
    rows = [(u, k, int(h), 0.9 + int(s) / 1000, int(g)) for u in range(12) for k, (h, s, g) in enumerate(zip(rng.integers(0, 9, 90), rng.integers(0, 100, 90), rng.integers(0, 23, 90) == 0)) if h <= 7]
    names = ["user_id", "k", "hamming", "ssim", "gap"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[a : a + size]]) for a in range(0, len(rows), size)]
    runs = []
    for r in rows:
        if runs and runs[-1][-1][0] == r[0] and runs[-1][-1][1] + 1 == r[1] and not r[4]:
            runs[-1].append(r)
        else:
            runs.append([r])
    assert [(u, k, h.tolist()) for u, k, h, _ in scenes._runs(iter(batches))] == [(run[0][0], run[0][1], [r[2] for r in run]) for run in runs]
    want = {}
    for run in runs:
        if (x := best_stretch([r[2] for r in run], [r[3] for r in run], 4, 0.92)) is not None:
            own = (-x[1], x[2], -x[3], run[0][1] + x[0], run[0][1] + x[0] + x[1])
            want[run[0][0]] = min(want.get(run[0][0], own), own)
    found = [tuple(r.values()) for b in scenes._windows(iter(batches)) for r in b.to_pylist()]
    assert found == [(u, s, e, -n, mh, -ms) for u, (n, mh, ms, s, e) in sorted(want.items())]


def test_group_digests_do_not_gather(spark):
    import hashlib

    from evalforge.operators.digests import grouped

    rows = [(None, 3)] + [(k % 3, k) for k in range(30_000)]
    got = {r.g: (r.n_rows, r.sha256) for r in grouped(spark.createDataFrame(rows, "g long, v long").repartition(5), "g", [F.col("v")], F.col("v"), "[", ",", "]").collect()}
    for g in (None, 0, 1, 2):
        own = sorted(v for k, v in rows if k == g)
        assert got[g] == (len(own), hashlib.sha256(f"[{','.join(map(str, own))}]".encode()).hexdigest().upper())
    assert grouped(spark.createDataFrame([], "g long, v long"), "g", [F.col("v")], F.col("v")).count() == 0


def test_draws_do_not_repeat():
    """No two of 10,000 replicates correlate above noise at 100,000 units: pairs of the distances that once repeated, and
    pairs at random."""
    from evalforge.operators import draws

    n, rng = 100_000, np.random.default_rng(1)
    reps = np.unique(np.concatenate([np.arange(12), np.arange(12) + 1103, rng.integers(0, 10_000, 130), [9_999]]))
    w = draws.weights(n, reps)
    assert (w.sum(1) == n).all() and abs(w.var() - 1) < 0.01
    c = np.corrcoef(w)
    np.fill_diagonal(c, 0)
    assert np.abs(c).max() < 6 / np.sqrt(n)
    assert (draws.weights(n, reps[:5], low=70_001, high=90_007) == w[:5, 70_001:90_007]).all()
    assert np.abs(draws.weights(1000, np.arange(4000)).mean(0) - 1).max() < 5 / np.sqrt(4000)


def test_draws_of_a_range_are_made_once(monkeypatch):
    """Four times the units take about four times the random numbers: a range doesn't go down from the top for each stretch."""
    from types import SimpleNamespace

    import pyarrow as pa

    from evalforge.operators import draws, resample

    made, mix = [0], draws.mix

    def counted(x):
        made[0] += x.size
        return mix(x)

    monkeypatch.setattr(resample, "POSITIONS", 64)
    took = []
    for n in (1 << 14, 1 << 16):
        head = SimpleNamespace(value=draws.heads(n, np.arange(4), draws.CLUSTERS))
        rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (np.zeros(n, int), np.arange(n), np.zeros(n, int), np.ones(n))], ["r", "p", "c", "v"])
        monkeypatch.setattr(draws, "mix", counted)
        made[0] = 0
        out = list(resample._sums(n, 4, draws.CLUSTERS, head, n, 1, 1)([rows]))
        took.append(made[0])
        monkeypatch.setattr(draws, "mix", mix)
        assert out[0].column(2).to_pylist() == [n] * 4
    assert took[1] < 5 * took[0], took


def test_stretches_of_draws_are_the_draws():
    from evalforge.operators import draws

    for n in (1, 64, 90, 5000, 70_001):
        rep = np.array([0, 3, 1999])
        head, w = draws.heads(n, rep, draws.MAPS), draws.weights(n, rep, draws.MAPS)
        low, high = n // 3, n - n // 5
        got = list(draws.runs(n, rep, draws.MAPS, head, low, high, 100))
        assert (w.sum(1) == n).all() and (np.concatenate([c for _, c in got], 1) == w[:, low:high]).all()
        assert [a for a, _ in got] == [low + sum(c.shape[1] for _, c in got[:k]) for k in range(len(got))]
        assert head.shape[1] == len(draws.tops(n)) <= 2 * draws.TOPS + draws.LEAF


def test_parts_of_a_curve_do_not_grow_with_the_rows(spark, monkeypatch):
    """Each part makes the draws of all units, so there are as many as keep the cores busy, not one for so many rows."""
    from evalforge.operators import resample

    monkeypatch.setattr(resample, "SLICE_ROWS", 20)
    made, curve = [], resample.vectorised
    monkeypatch.setattr(resample, "vectorised", lambda stats, *a: made.append(stats.select("_part").distinct().count()) or curve(stats, *a))
    rows = spark.range(6000).selectExpr("id % 50 as u", "1 as m", "(id * 7919 % 6007) / 6007.0D as conf", "cast(id % 3 = 0 as int) as error")
    assert resample.aurc(rows, "u", ["m"], 2).count() == 2
    assert made[0] <= 8 * spark.sparkContext.defaultParallelism, made


def test_rows_are_added_to_the_sums_of_their_group():
    from evalforge.operators import resample

    rng = np.random.default_rng(2)
    group, at, count, drawn = np.sort(rng.integers(0, 40, 500)), rng.integers(0, 90, 500), rng.integers(1, 4, 500), rng.integers(0, 5, (90, 150)).astype(np.int32)
    total, plain = np.zeros((40, 150), np.int32), np.zeros((40, 150), np.int64)
    np.add.at(plain, group, drawn[at] * count[:, None])
    resample._add(total, group, drawn, at, count)
    assert (total == plain).all()


def test_weighted_flips_and_overlaps_are_those_of_repeated_rows(spark):
    from evalforge.operators import consistency

    rows = [(k % 2, k % 5, (k * 3) % 4, [k % 2, 1], [k // 2 % 2, 1], k % 3 + 1) for k in range(24)]
    frame = spark.createDataFrame(rows, "m int, joint long, common long, pred array<int>, clean array<int>, copies long").withColumn("common", F.least("common", "joint"))
    every = frame.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    for f in (consistency.flips, consistency.jaccard_parts):
        one, other = (sorted(map(tuple, x.collect())) for x in (f(frame, ["m"], F.col("copies")), f(every, ["m"])))
        assert len(one) == 2 and all(a == pytest.approx(b) for a, b in zip(one, other))


def test_boxes_in_one_place_are_compared_once(spark, monkeypatch):
    from evalforge.operators import geometry

    boxes = [(k, 10 * (k % 3), 0, 10 * (k % 3) + 8, 8) for k in range(60)] + [(60, None, 0, 8, 8), (61, 5, 5, 5, 9)]
    c = spark.createDataFrame(boxes, "id long, cl int, ct int, cr int, cb int")
    d = spark.createDataFrame([(11, 1, 15, 4)] * 50, "dl int, dt int, dr int, db int")
    seen, cells = [], geometry.cells
    monkeypatch.setattr(geometry, "cells", lambda df, p, size: seen.append(df.count()) or cells(df, p, size))
    left = {r.id for r in geometry.without_overlap(c, d, "id").collect()}
    assert left == {k for k in range(60) if k % 3 != 1} | {60, 61}
    assert seen == [5, 1]


def test_streams_of_draws_differ():
    from evalforge.operators import draws

    a, b = draws.weights(5000, np.arange(20), draws.CLUSTERS), draws.weights(5000, np.arange(20), draws.COMPONENTS)
    assert abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 0.02


def test_stored_draws_are_proved_as_they_are_read(spark):
    from evalforge.operators import bootstrap, resample

    units = spark.createDataFrame([(k * 3,) for k in range(90)], "c long")
    table = bootstrap.stored(units, "c", 6).cache()
    fresh = {(r.rep, r.c): r.weight for r in resample.drawn(units, "c", 6).collect()}
    assert {(r.rep, r.unit): r.weight for r in bootstrap.verified(table).collect()} == fresh
    total = bootstrap.manifest(table).collect()
    assert len(total) == 6 and {r.draws for r in total} == {90} and len({r.digest for r in total}) == 6
    changed = table.withColumn("weights", F.when(F.col("rep") == 4, F.transform("weights", lambda x: x + 1)).otherwise(F.col("weights")))
    with pytest.raises(Exception, match="replicate 4, piece 0, were changed"):
        bootstrap.verified(changed).collect()


def test_stored_draws_are_replayed_without_a_row_a_draw(spark, monkeypatch):
    from evalforge.operators import bootstrap, resample

    monkeypatch.setattr(bootstrap, "PIECE", 64)
    monkeypatch.setattr(bootstrap, "REPLAYED", 4)
    monkeypatch.setattr(resample, "REP_BLOCK", 3)
    stats = spark.createDataFrame([(k * 3, m, float(k % 5), 1.5 * m) for k in range(300) for m in range(2) if (k + m) % 7], "c long, m int, x double, y double")
    table = bootstrap.written(bootstrap.stored(stats.select("c"), "c", 10))
    got = bootstrap.replayed(stats, "c", ["m"], ["x", "y"], table)
    assert "weight#" not in got._jdf.queryExecution().toString()  # a row a draw
    want = resample.vectorised(stats, "c", ["m"], ["x", "y"], 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert table.filter("units is not null").count() == 5 and table.count() == 50  # names once a piece
    assert {(r.pieces, r.draws) for r in bootstrap.manifest(table).collect()} == {(5, 300)}
    other = table.withColumn("units", F.transform("units", lambda x: x + 1))
    with pytest.raises(Exception, match="were changed"):
        bootstrap.replayed(stats, "c", ["m"], ["x", "y"], other).collect()


@pytest.mark.parametrize(("most", "bits"), [(0, 4), (15, 4), (16, 8), (256, 16), (1 << 16, 32), ((1 << 32) - 1, 32)])
@pytest.mark.parametrize("n", [1, 15, 16, 17, 4096])
def test_packed_counts(most, bits, n):
    from evalforge.operators import bootstrap

    w = np.arange(n, dtype=np.int64) % 16 * (most >= 15)
    w[-1] = most
    found, packed = bootstrap._pack(w)
    assert found == bits and packed.dtype == np.int64 and bootstrap._unpack(found, packed, n).tolist() == w.tolist()


def test_harmonic_spans_by_series():
    from evalforge.operators import resample

    table = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, 100_001))])
    rng = np.random.default_rng(2)
    before, n = rng.integers(0, 3000, 5000), rng.integers(0, 90_000, 5000) // rng.integers(1, 5000, 5000)
    assert np.allclose(resample.harmonic_span(before, n), table[before + n] - table[before], rtol=0, atol=1e-11)


def test_spark_harmonic_spans_by_series(spark):
    from evalforge.operators import ranking

    table = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, 200_001))])
    rows = [(b, n) for b in (0, 1, 100, 255, 256, 257, 5000) for n in (1, 2, 155, 156, 157, 300, 100_000)]
    for r in spark.createDataFrame(rows, "b long, n long").withColumn("s", ranking.harmonic_span(F.col("b"), F.col("n"))).collect():
        assert r.s == pytest.approx(table[r.b + r.n] - table[r.b], abs=1e-11)


def test_keyed_hash(spark):
    import hashlib
    import hmac

    got = [r.m for r in spark.createDataFrame([("v",), (None,)], "s string").select(hashes.hmac_sha256(b"k")("s").alias("m")).collect()]
    assert got == [hmac.new(b"k", b"v", hashlib.sha256).hexdigest().upper(), None]


def test_graded_draws_equal_plain_loops(spark):
    from evalforge.operators import draws
    from evalforge.plans import gates

    rows = gates.graded_rows(spark, SF, (43,))
    got = {(r.axis, r.model, r.q_ix, r.rep): r.value for r in gates.graded_draws(spark, SF, (43,), 2, rows).collect()}
    acts, why, (named, n) = rows[0].toPandas(), rows[1].toPandas(), rows[2]
    parts = [r.part for r in named.orderBy("_position").collect()]
    assert len(parts) == n and set(parts) == set(acts.part)
    for rep in range(2):
        picked = [p for p, k in zip(parts, draws.weights(n, [rep], draws.COMPONENTS)[0]) for _ in range(k)]
        for (model, q), own in acts.groupby(["model", "q_ix"]):
            by = dict(list(own.groupby("part")))
            f = pd.concat([by[p] for p in picked])
            assert got["A", model, q, rep] == pytest.approx(plain_f1(f.target_q, f.pred))
            flips = [sum(list(p) != list(h) for h in hits) / 3 for p, *hits in zip(f.pred, f.hit0, f.hit1, f.hit2)]
            assert got["C1", model, q, rep] == pytest.approx(sum(flips) / len(flips))
            assert got["S", model, q, rep] == pytest.approx(plain_aurc(f.conf_q, [int(list(p) != list(t)) for p, t in zip(f.pred, f.target)]))
        for q, own in why.groupby("q_ix"):
            by = dict(list(own.groupby("part")))
            f = pd.concat([by[p] for p in picked])
            assert got["R", 1, q, rep] == pytest.approx(plain_f1(f.target_q, f.pred))
            over = []
            for p, *hits in zip(f.pred, f.hit0, f.hit1, f.hit2):
                each = [(sum(a and b for a, b in zip(p, h)), sum(a or b for a, b in zip(p, h))) for h in hits]
                over.append(sum(1.0 if j == 0 else c / j for c, j in each) / 3)
            assert got["J", 1, q, rep] == pytest.approx(sum(over) / len(over))


def test_effects_and_gates_by_hand(spark):
    """Bottlenecks are least steps in the expected direction, by component; an axis takes the least of its components."""
    from evalforge.plans import gates

    values = [("S", 43, 0, 0, v, x) for v, x in enumerate((0.1, 0.2, 0.25, 0.4, 0.6))] + [("J", 43, 1, 0, v, x) for v, x in enumerate((1.0, 0.9, 0.91, 0.5, 0.4))] + [("C1", 43, 1, 0, v, x) for v, x in enumerate((0.0, 0.3, 0.4, 0.5, 0.6))]
    frame = spark.createDataFrame(values, "axis string, seed int, model int, family int, level int, value double")
    got = {r.axis: (round(r.bottleneck, 9), round(r.effect, 9)) for r in gates.effects(frame, []).collect()}
    assert got == {"S": (0.05, 0.5), "J": (-0.01, 0.6), "C1": (0.1, 0.6)}
    drawn = gates.effects(frame, []).withColumn("rep", F.lit(0).cast("long"))
    own = {r.axis: r.b for r in drawn.groupBy("rep", gates.gate_of().alias("axis"), "seed", "family").agg(F.min("bottleneck").alias("b")).collect()}
    assert round(own["C1"], 9) == -0.01 and round(own["S"], 9) == 0.05


def test_slices_of_a_curve_decide_only_its_plan(spark, monkeypatch):
    from evalforge.operators import resample

    rng = np.random.default_rng(4)
    data = [(int(u), int(m), float(c), int(e)) for u, m, c, e in zip(rng.integers(0, 60, 3000), rng.integers(0, 2, 3000), rng.integers(0, 40, 3000) / 40, rng.integers(0, 2, 3000))]
    frame = spark.createDataFrame(data, "u long, m int, conf double, error int")
    one = {(r.rep, r.m): r.value for r in resample.aurc(frame, "u", ["m"], 5).collect()}
    monkeypatch.setattr(resample, "SLICE_ROWS", 200)
    many = {(r.rep, r.m): r.value for r in resample.aurc(frame, "u", ["m"], 5).collect()}
    assert one.keys() == many.keys() and len(one) == 10 and all(many[k] == pytest.approx(v, rel=1e-12) for k, v in one.items())


def test_lines_of_files_larger_than_a_range(spark, tmp_path):
    rng = np.random.default_rng(5)
    bodies = {"a.txt": b"".join(bytes(rng.integers(32, 255, rng.integers(0, 300)).astype(np.uint8)) + b"\n" for _ in range(3000)), "b.txt": b"one\ntwo\n\nlast\r", "c.txt": b"", "d.txt": b"\n", "e.txt": b"whole\n", "f.txt": "\ufeffx\ny".encode()}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        table = files.lines(spark, str(tmp_path / "*.txt"), 400)
        assert table.rdd.getNumPartitions() > 10
        got = {}
        for r in table.collect():
            got.setdefault(r.path.rsplit("/", 1)[1], {})[r.ix] = (bytes(r.line), r.complete)
        for name, body in bodies.items():
            parts = body.removeprefix(b"\xef\xbb\xbf").split(b"\n")
            want = {k: (p, k < len(parts) - 1) for k, p in enumerate(parts) if k < len(parts) - 1 or p}
            assert got.get(name, {}) == want, name
        with pytest.raises(Exception, match="too long"):
            files.lines(spark, str(tmp_path / "a.txt"), 100).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_stream_with_state_equals_the_batch(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"))
    few = pages.withColumn("path", F.when(F.col("path").endswith("1"), F.upper("path")).otherwise(F.substring("path", 1, 4)))
    few.repartition(6).write.parquet(str(tmp_path / "in"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = inventory.stream(spark, str(tmp_path / "in"), few.schema, 2)
        inventory.write_once(inventory.inventory(rows, "host", "path"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
        out = spark.read.parquet(str(tmp_path / "out"))
        assert out.select("batch").distinct().count() > 1
        got = {r.archive: (r.new, r.duplicate, r.collision) for r in out.groupBy("archive").pivot("kind", ["new", "duplicate", "collision"]).count().fillna(0).collect()}
        want = {r.archive: (r.n_new, r.n_duplicate, r.n_collision) for r in inventory.inventory_counts(few, "host", "path").collect()}
        assert got == want and any(v[1] for v in want.values())
        most = max(v[0] + v[2] for v in want.values())
        with pytest.raises(Exception, match="more than"):
            inventory.write_once(inventory.inventory(rows, "host", "path", most - 1), str(tmp_path / "no"), str(tmp_path / "nomark")).awaitTermination()
    finally:
        spark.conf.set(provider, old)


def test_scratch_tables_are_released(spark, tmp_path):
    import os

    rows = graph.cut(spark.range(5))
    (path,) = {os.path.dirname(f).removeprefix("file:").replace("//", "/") for f in rows.inputFiles()}
    assert os.path.isdir(path) and rows.count() == 5
    held, graph._written[:] = graph._written[:-1], graph._written[-1:]  # only this one: others' results may be read yet
    graph.release(spark)
    graph._written[:] = held
    assert not os.path.isdir(path)


def test_doses_of_a_world_are_compared_without_a_join(spark):
    from evalforge.plans import scenes

    plan = scenes.mtmm_gap(spark, SF)._jdf.queryExecution().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("head", ["action", "rationale"])
def test_profiles_stand_for_their_samples(spark, head):
    from evalforge.sources import adapters as A

    keys = [*range(-40, 40), *(k * 1201 * 1100 + r for k in range(4) for r in range(9)), *range(10_000, 10_400)]
    rows = spark.createDataFrame([(k, k % 7, 1 + k % 3) for k in keys], "sample_ix long, cluster_key long, digit int")
    cells = ["seed", "model", "family", "level", "target", "logit"]
    of = lambda r: A.actions(spark, SF, (43, 47), families=A.FAMILIES, levels=A.LEVELS, head=head, rows=r)
    want = of(rows).groupBy(*cells).count().collect()
    alike = A.profiles(rows, head)
    got = of(alike).groupBy(*cells).agg(F.sum("copies")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    assert alike.count() < len(keys)


def test_axes_multiply_profiles_not_samples(spark, tmp_path):
    from evalforge.plans import consistency
    from evalforge.sources import adapters as A

    orders = A.table(spark, SF, "orders")
    period = 1201 * 1100
    twice = orders.union(orders.withColumn("o_orderkey", F.col("o_orderkey") + period))
    twice.write.parquet(f"{tmp_path}/orders.parquet")
    assert A.profiles(A.samples(spark, str(tmp_path))).count() == A.profiles(A.samples(spark, SF)).count()
    pick = lambda sf: {tuple(r)[:5]: round(r["value"], 9) for r in consistency.axes(spark, sf, (43,)).filter("axis <> 'S'").collect()}
    assert pick(str(tmp_path)) == pick(SF)


def test_replicates_draw_the_samples_of_a_profile(spark, monkeypatch):
    """Counts by profile are the draws' product with who is of it, whatever the ranges of units and the kinds of numbers."""
    from evalforge.operators import draws, profiled

    monkeypatch.setattr(profiled, "ROWS", 100)
    rng = np.random.default_rng(3)
    units, places = rng.integers(0, 300, 900), rng.integers(0, 40, 900)
    table = np.zeros((300, 40), int)
    np.add.at(table, (units, places), 1)
    table[7, 3] = 90
    rows = [(5 * u, p, int(table[u, p])) for u, p in zip(*map(np.ndarray.tolist, np.nonzero(table)))]
    named = spark.createDataFrame([(5 * u, u) for u in range(300)], "c long, _position long")
    found = profiled.drawn_counts(spark.createDataFrame(rows, "c long, place long, n long"), "c", 40, 120, named=(named, 300)).toPandas()
    got = {b: sum(np.frombuffer(r.counts, r.kind).reshape(40, -1).astype(int) for r in f.itertuples()) for b, f in found.groupby("block")}
    want = draws.weights(300, np.arange(120)) @ table
    assert len(found) > 3 and [got[b].shape[1] for b in range(3)] == [50, 50, 20] and {len(np.dtype(k).str) for k in found.kind} == {3}
    assert np.concatenate([got[b] for b in range(3)], 1).T.tolist() == want.tolist()


def test_cells_of_profiles_are_those_of_samples(spark, monkeypatch):
    from evalforge.operators import profiled
    from evalforge.plans import inference

    pick = lambda: {tuple(r)[:6]: r.value for r in inference.axis_draws(spark, SF, (43,), 3).collect()}
    found = pick()
    monkeypatch.setattr(profiled, "MOST", 0)
    assert pick() == pytest.approx(found) and len(found) == 3 * (26 * 3 + 13 * 2)


def test_draws_of_a_map_are_made_by_ranges_of_its_components(spark, monkeypatch):
    from evalforge.operators import draws, resample
    from evalforge.plans import inference
    from evalforge.sources import adapters as A

    reps, size = 3, 150
    monkeypatch.setattr(inference, "COMPONENT_RANGE", 64)
    rng = np.random.default_rng(1)
    values = {m: rng.integers(1, 9, (size + m, len(A.SEEDS), 2, 6)) for m in range(inference.MAPS)}
    rows = [(m, p, size + m, s, k, *map(int, v[p, i, k])) for m, v in values.items() for p in range(size + m) for i, s in enumerate(A.SEEDS) for k in A.MODELS]
    stats = spark.createDataFrame(rows, "map_id int, position long, n_comp long, seed int, model int, n long, e0 long, e1 long, e2 long, e3 long, e4 long").cache()
    seeds = {(r.rep, r.seed): r.times for r in resample.seed_draws(spark, reps, A.SEEDS).collect()}
    tasks, plain = [], inference._range_sums
    monkeypatch.setattr(inference, "_range_sums", lambda *a: tasks.append(a) or plain(*a))
    got = {r.rep: r.v for r in inference.multimap_draws(stats, reps).collect()}
    assert tasks and len(got) == reps
    for rep in range(reps):
        of = []
        for occ in range(inference.MAPS):
            m = int(draws.choices(draws.MAPS, np.array([rep]), np.array([occ]), inference.MAPS)[0])
            sums = np.tensordot(draws.weights(size + m, [rep * inference.MAPS + occ], draws.MAP_COMPONENTS)[0], values[m], 1)
            least = (np.diff(sums[..., 1:], axis=2).min(2) / sums[..., 0]).min(1)
            times = [seeds.get((rep, s), 0) for s in A.SEEDS]
            of.append(float(least @ times) / sum(times))
        assert got[rep] == pytest.approx(sum(of) / len(of))


def test_overlaps_of_points_multiply_profiles(spark, monkeypatch):
    from evalforge.operators import consistency as C
    from evalforge.plans import consistency, gates
    from evalforge.sources import adapters as A

    asked, plain = [], A.actions
    monkeypatch.setattr(gates, "SEEDS", (43,))
    monkeypatch.setattr(gates, "axes", lambda spark, sf: spark.createDataFrame([], "axis string, seed int, model int, family int, level int, value double"))
    monkeypatch.setattr(A, "actions", lambda *a, **k: asked.append(k.get("rows")) or plain(*a, **k))
    got = {(r.family, r.level): r.value for r in gates.points(spark, SF).collect()}
    assert asked and all(r is not None and "copies" in r.columns for r in asked)
    monkeypatch.undo()
    own = C.jaccard_parts(C.overlaps(consistency.perturbed(spark, SF, "rationale", (43,), (2, 4), (1,))), ["family", "level"]).collect()
    assert {(r.family, r.level): r.jaccard for r in own} == pytest.approx({k: v for k, v in got.items() if k[1] in (2, 4)}) and len(got) == 15


def test_exploded_rows_are_not_broadcast(spark):
    from evalforge.plans import inference
    from evalforge.sources import adapters as A

    rows = metrics.predicted(A.actions(spark, SF, families=A.FAMILIES, levels=(4,)))
    got = maps.gather(rows, inference.moved(spark, SF), ["seed", "model", "family", "level"], ["pred"])
    for df in (got, catalog.queries()["pairing_controls"](spark, SF)):
        joins = [x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "BroadcastHashJoin" in x]
        assert not [x for x in joins if "seed" in x or "dst_ix" in x]


def test_invariants_of_moves_are_those_of_graded_maps(spark):
    from evalforge.plans import inference

    rng = np.random.default_rng(5)
    rows = [(m, k, int(rng.integers(0, 40)) if m == 2 else (k + m) % 40, int(rng.integers(1, 5))) for m in range(4) for k in range(40)]
    names = spark.createDataFrame([(k, f"c{k // 3}", f"n{k % 37}") for k in range(40)], "sample_ix long, clip string, name string")
    moves = spark.createDataFrame(rows, "map_id int, dst_ix long, src_ix long, first int")
    side = lambda ix, x: names.select(F.col("sample_ix").alias(ix), F.col("clip").alias(f"clip_{x}"), F.col("name").alias(f"name_{x}"))
    beside = moves.join(side("dst_ix", "a"), "dst_ix").join(side("src_ix", "b"), "src_ix").withColumn("same_clip", F.expr("clip_a = clip_b")).withColumn("same_name", F.expr("name_a = name_b"))
    found = inference.move_invariants(beside)
    long = moves.withColumn("q_ix", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("src_ix", F.expr("if(first <= q_ix, src_ix, dst_ix)")).drop("first")
    want = inference.invariants(inference.stepped(long, ["map_id"]), names, ["map_id", "q_ix"])
    assert sorted(map(tuple, found.drop("p").select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert len({r.bijective for r in want.collect()}) == 2


def test_rows_of_map_stacks_hold_no_names_and_no_severities(spark):
    """They are a row a sample and map; names, clips and digests are made where they are compared."""
    from evalforge.plans import inference

    moves = inference.map_moves(spark, SF)
    plan = moves._jdf.queryExecution().sparkPlan().toString()
    assert "q_ix" not in plan and moves.count() == inference.MAPS * inference.odd_names(spark, SF)[1]
    rows = spark.createDataFrame([(i, f"c{i % 60}_{i}.jpg", f"c{i % 60}") for i in range(101)], "sample_ix long, name string, clip string")
    made = maps.cycles(rows.select("sample_ix"), lambda c: F.concat(F.lit("c"), c("sample_ix") % 60, F.lit("_"), c("sample_ix"), F.lit(".jpg")), lambda c: c("sample_ix") % 60, "salt")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, maps.cycles(rows, "name", "clip", "salt").collect()))


def test_rotations_that_are_looked_at_first_decide_only_the_plan(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"c{i % 60}_{i}.jpg", f"c{i % 60}") for i in range(301)], "sample_ix long, name string, clip string")
    want = sorted(map(tuple, maps.cycles(rows, "name", "clip", "salt-7").collect()))
    monkeypatch.setattr(maps, "ROTATIONS", 1)
    assert sorted(map(tuple, maps.cycles(rows, "name", "clip", "salt-7").collect())) == want


def test_answers_of_profiles_are_those_of_samples(spark):
    """Severities and sources are no rows: a sample's answers, made once a profile, stand beside its source's as bits."""
    from evalforge.plans import inference
    from evalforge.sources import adapters as A

    keys = [*range(-20, 20), *(k * 1201 * 1100 + r for k in (1, 2) for r in range(9)), *range(5000, 5200)]
    rows = spark.createDataFrame([(k, k % 7, 1 + k % 5) for k in keys], "sample_ix long, cluster_key long, digit int")
    got = {r.sample_ix: r for r in inference.answered(rows).collect()}
    number = lambda labels: int("".join(map(str, labels)), 2)
    for head, name, count, models in (("action", "act", A.ACTIONS, A.MODELS), ("rationale", "why", A.RATIONALES, (1,))):
        cells = metrics.predicted(A.actions(spark, SF, models=models, families=A.FAMILIES, levels=(4,), head=head, clean=True, rows=rows)).withColumn("clean", E.hard(F.col("clean_logit")))
        for r in cells.withColumn("conf", F.array_max(E.probabilities(F.col("clean_logit")))).collect():
            own, m = got[r.sample_ix], r.model if head == "action" else 0
            field = lambda x, k: x >> k * count & (1 << count) - 1  # noqa: B023, E731
            assert field(own[name], m) == number(r.clean) and field(own[name], 8 if head == "action" else 1) == number(r.target)
            hit = field(own.act, 2 + 3 * m + r.family) if head == "action" else field(own.why_hit, r.family)
            assert hit == number(r.pred) and (head != "action" or own.conf[m] == r.conf)
    assert len(got) == len(keys)
    plan = catalog.queries()["graded_curves"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "logit" not in plan and not [x for x in plan.splitlines() if "Join" in x and "q_ix" in x and "src_ix" in x]


def test_moves_say_what_graded_maps_say(spark):
    from evalforge.plans import inference

    cycles, n = inference.cycle_rows(spark, SF)
    long = maps.moves(cycles, n).withColumn("q_ix", F.explode(F.sequence(F.lit(0), F.lit(len(maps.SEVERITIES) - 1))))
    got = long.select("q_ix", "dst_ix", F.when(F.col("q_ix") >= F.col("first"), F.col("src_ix")).otherwise(F.col("dst_ix")).alias("src_ix"))
    want = maps.graded(cycles, n)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and long.count() == 5 * n
