"""Operators against hand-computed values and brute force on small fixtures."""

import json
import math
import pathlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from korvane import dist
from korvane.operators import (cache as ca, chats as ch, corpus as co, extract as ex, fusion as fu,
                               gate as ga, graph as gr, lexical as lx, memory as mm, metrics as me,
                               retrieve as rt, trust as tr, vector as ve)
from korvane.operators.answers import _lcs, rouge_l, with_bleu

# ---- skew-safe numbering -------------------------------------------------------------------


def test_numbering_with_hot_group(spark):
    rows = [(0 if i % 3 == 0 else i % 50, i * 37 % 1009) for i in range(1009)]
    df = spark.createDataFrame(rows, "g int, o int")
    got = {(r.g, r.o): r.p for r in dist.position_within(df, "g", "o", "p", parts=9).collect()}
    want = {}
    for g, o in sorted(rows):
        want[(g, o)] = sum(1 for g2, o2 in rows if g2 == g and o2 < o)
    assert got == want
    ids = [r.o for r in dist.number_rows(df, ["o"], "n", parts=9).orderBy("n").collect()]
    assert ids == sorted(o for _, o in rows)


def test_numbering_spreads_a_hot_group(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").alias("o"))
    df = df.withColumn("x", F.col("o")).withColumn("o", F.lit(7))       # one key for all rows
    placed = dist._placed(df, ["g", "o"], 8).withColumn("b", F.spark_partition_id())
    sizes = placed.groupBy("b").count().collect()
    assert len(sizes) > 3 and max(r["count"] for r in sizes) < 5000 / 2
    got = [r.p for r in dist.position_within(df, "g", "o", "p", parts=8).collect()]
    assert sorted(got) == list(range(5000))


def test_numbering_survives_many_partitions(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("g"), F.col("id").alias("o"))
    ids = dist.number_rows(df, ["g", "o"], "n", parts=2000)
    assert ids.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, 3000, 3000)


# ---- vectors -----------------------------------------------------------------------------------


def _vectors(spark, n, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.standard_normal(dim)]) for i in range(n)]
    rows[3] = (3, rows[2][1])            # a tie
    rows.append((n, [0.0] * dim))        # zero norm
    return spark.createDataFrame(rows, "id long, embedding array<float>"), rows


def _brute(qs, vs, k):
    out = {}
    for q, a in qs:
        a = np.float32(a).astype(float)
        scored = []
        for i, b in vs:
            b = np.float32(b).astype(float)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            scored.append((-round(float(a @ b / n), 9) if n else 0.0, i))
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def _lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("query_rows,vector_rows", [(1000, 20_000), (2, 7)])
def test_knn_any_tiles(spark, query_rows, vector_rows):
    vec, rows = _vectors(spark, 60)
    q = vec.filter("id < 10").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = ve.semantic_search(q, vec, 5, query_rows=query_rows, vector_rows=vector_rows)
    assert _lists(got) == _brute(rows[:10], rows, 5)


def test_knn_string_ids_and_groups(spark):
    vec, rows = _vectors(spark, 40)
    v = vec.withColumn("user_id", F.when(F.col("id") < 30, "hot").otherwise("cold")).withColumn(
        "id", F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 3, "0")))
    q = spark.createDataFrame([("q", "hot", rows[0][1])], "query_id string, user_id string, query_vec array<float>")
    got = _lists(ve.user_search(q, v, 4, vector_rows=8))
    want = _brute([("q", rows[0][1])], [r for r in rows if r[0] < 30], 4)
    assert got == {"q": [f"v{i:03d}" for i in want["q"]]}


def test_knn_has_no_product_without_broadcasts(spark):
    vec, _ = _vectors(spark, 60)
    q = vec.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for by in ([], ["g"]):
            a, b = q.withColumn("g", F.col("query_id") % 2), vec.withColumn("g", F.col("id") % 2)
            text = plan(ve._tiled_knn(a, b, 3, "query_id", "query_vec", "id", "embedding", by, 7, 9))
            assert "CartesianProduct" not in text and "NestedLoop" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lsh_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((20, 16))
    rows = [(i, [float(x) for x in base[i % 20] + 0.1 * rng.standard_normal(16)]) for i in range(200)]
    vec = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = vec.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = ve.semantic_search(q, vec, 5)
    approx = ve.semantic_search_lsh(q, vec, 5, dim=16)
    assert ve.recall_against(approx, exact).first()[0] > 0.9


@pytest.mark.parametrize("bits", [None, 6, 11])
def test_lsh_recall_with_the_hyperplanes_of_a_large_table(spark, bits):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 32))
    rows = [(i, [float(x) for x in base[i % 60] + 0.7 * rng.standard_normal(32)]) for i in range(1500)]
    vec = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = vec.filter("id < 100").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = ve.semantic_search(q, vec, 10)
    approx = ve.semantic_search_lsh(q, vec, 10, dim=32, bits=bits, **({"bucket": 20} if bits is None else {}))
    assert ve.recall_against(approx, exact).first()[0] >= 0.9


@pytest.mark.parametrize("spread", [0.1, 0.7, 3.0])
def test_ivf_recall_and_cells(spark, spread):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((30, 24))
    rows = [(i, [float(x) for x in base[0 if i % 3 else i % 30] + spread * rng.standard_normal(24)]) for i in range(2000)]
    vec = spark.createDataFrame(rows + [(9001, None), (9002, [1.0]), (9003, [0.0] * 24)], "id long, embedding array<float>")
    q = vec.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    file = ve.fit_ivf(q, vec, 10, dim=24, cell=40, sample=60)
    assert 20 < len(file.centres) <= 50
    found = ve.semantic_search_ivf(q, vec, 10, file, dim=24)
    exact = ve.semantic_search(q, vec, 10)
    assert ve.recall_against(found, exact).first()[0] >= 0.9
    true = {(r.query_id, r.id): r.score for r in ve.semantic_search(q, vec, 2003).collect()}
    assert all(true[r.query_id, r.id] == pytest.approx(r.score, abs=1e-11) for r in found.collect())
    unit = ve._matrix([v for _, v in rows])
    assert np.bincount(file.cells(unit)).max() < 700          # the hot third is split
    if spread == 0.1:                                         # outside the crowd, near neighbours need few cells
        assert np.mean([len(p) for p in file.probes(unit[::3])]) < len(file.centres) / 3


def test_block_matches_a_plain_ranking_with_ties():
    rng = np.random.default_rng(3)
    v = ve._matrix(np.concatenate([rng.integers(-1, 2, (9_000, 4)), np.full((1, 4), np.nan)]))
    q, ids = v[:40], rng.permutation(len(v))
    q_ids, found, scores = ve._block(np.arange(40), q, ids, v, 7)
    for i in range(40):
        s = np.round(q[i] @ v[:-1].T, ve.DIGITS)
        want = np.lexsort((ids[:-1], -s))[:7]
        assert found[q_ids == i].tolist() == ids[want].tolist() and scores[q_ids == i].tolist() == s[want].tolist()


def test_lsh_copies_pay_for_both_sides(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(4_000)]
    vec = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = vec.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    found = ve.semantic_search_lsh(q, vec, 10, dim=16, bucket=64)
    assert _lists(found) == _lists(ve.semantic_search(q, vec, 10))      # far neighbours, few queries: no hyperplane pays


def test_ivf_sends_a_query_once_to_a_shard(spark):
    rng = np.random.default_rng(10)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(1_000)]
    vec = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = vec.filter("id < 30").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    file = ve.InvertedFile(ve._matrix(rng.standard_normal((150, 8))), 9.0)     # every cell of all three shards
    seen, old = [], ve._tiled_knn
    ve._tiled_knn = lambda asked, *a: (seen.append(asked.count()), old(asked, *a))[1]
    try:
        found = ve.semantic_search_ivf(q, vec, 10, file, dim=8)
    finally:
        ve._tiled_knn = old
    assert seen == [90] and _lists(found) == _lists(ve.semantic_search(q, vec, 10))


def test_ivf_edges(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    q = vec.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    assert ve.semantic_search_ivf(q, vec, 1, dim=2).count() == 2
    assert ve.semantic_search_ivf(q, vec.limit(0), 1, dim=2).count() == 0
    assert ve.semantic_search_ivf(q.limit(0), vec, 1, dim=2).count() == 0


# ---- metrics -----------------------------------------------------------------------------------


def _metrics(spark, ranked, gold, k):
    r = spark.createDataFrame([("s", k, 1, i, p + 1) for p, i in enumerate(ranked)],
                              "strategy string, k int, query_id long, id long, rank int")
    g = spark.createDataFrame([(1, i) for i in gold], "query_id long, id long")
    return me.evaluate_queries(r, g).first()


def test_metric_values(spark):
    m = _metrics(spark, [5, 1, 9], [1, 2], 3)
    assert (round(m.precision, 6), m.recall, m.hit, m.mrr) == (round(1 / 3, 6), 0.5, 1.0, 0.5)
    assert m.ndcg == pytest.approx(0.386853, abs=1e-6)
    m = _metrics(spark, [1], [1], 5)
    assert (m.precision, m.recall) == (0.2, 1.0)
    m = _metrics(spark, [1, 1], [1], 2)
    assert m.precision == 1.0 and m.ndcg == pytest.approx(1.630930, abs=1e-6)
    m = _metrics(spark, [1, 2], [], 2)
    assert (m.precision, m.recall, m.hit, m.mrr, m.ndcg) == (0, 0, 0, 0, 0)


def test_best_takes_first_on_ties(spark):
    df = spark.createDataFrame([("a", 3, "m", 0.5), ("b", 3, "m", 0.5), ("a", 5, "m", 0.5)],
                               "strategy string, k int, metric string, value double")
    r = me.best_per_metric(df, ["b", "a"], [3, 5]).first()
    assert (r.strategy, r.k) == ("b", 3)


def test_gold_remap(spark):
    ev = spark.createDataFrame([(1, [7, 5, 9])], "query_id long, gold_docs array<long>")
    old = spark.createDataFrame([(5, "a"), (7, "b")], "id long, mapc string")
    new = spark.createDataFrame([(50, "a"), (70, "b")], "id long, mapc string")
    r = me.remap_gold(ev, old, new).first()
    assert (r.gold_docs, r.gold_docs_old, r.mapped, r.total) == ([70, 50], [7, 5, 9], 2, 3)


# ---- fusion ------------------------------------------------------------------------------------


def test_minmax(spark):
    df = spark.createDataFrame([(1, .3), (1, .3), (2, 1.), (2, 3.), (2, 2.)], "query_id int, s double")
    got = [(r.query_id, r.n) for r in fu.minmax(df, "s", "n").orderBy("query_id", "s").collect()]
    assert got == [(1, 1.0), (1, 1.0), (2, 0.0), (2, 0.5), (2, 1.0)]


def _hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, rank int, mapc string, url string, passage string, "
                                       "score double, source string, ten string, noidung string")


def test_overlap_rerank_keeps_first(spark):
    df = spark.createDataFrame([(1, 1, "k", "ban", "toàn dân", .5), (1, 2, "k", "", "", 1.)],
                               "query_id int, pos int, mapc string, ten string, noidung string, base_score double")
    r = fu.overlap_rerank(df.withColumns({"passage": F.lit(""), "q_text": F.lit("an toàn")}), 5).collect()
    assert len(r) == 1 and r[0].score == pytest.approx(0.6)


def test_confidence(spark):
    rows = [(2, 1, "a", "", "", .8, "phapdien", "", "")]
    rows += [(3, i, "", f"u{i}", "", .9, "web", "", "") for i in range(1, 6)]
    q = spark.createDataFrame([(1, 1), (2, 1), (3, 6)], "query_id int, iterations int")
    got = {r.query_id: (r.confidence, r.warning) for r in fu.confidence(_hits(spark, rows), q).collect()}
    assert got == {1: (0.0, True), 2: (0.64, False), 3: (0.567, True)}


def test_sufficiency(spark):
    rows = [(q, i, "", "", "", .9, "", "x y", "thuế nhà đất" if q == 3 else "z") for q in (1, 3, 4) for i in (1, 2, 3)]
    rows += [(2, i, "", "", "", .9, "", "thuế", "nhà") for i in (1, 2)]
    q = spark.createDataFrame([(1, "a b"), (2, "thuế nhà"), (3, "thuế nhà"), (4, "z x 2025"), (5, "q")],
                              "query_id int, q_text string")
    got = {r.query_id: r.sufficient for r in fu.is_sufficient(q, _hits(spark, rows)).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False}


def test_bucket_merge_and_final_dedup(spark):
    steps = spark.createDataFrame(
        [(1, 0, 1, "a", "", "p"), (1, 0, 2, "", "", "q"), (1, 1, 1, "a", "", "p"), (1, 1, 2, "", "", "q"),
         (1, 1, 3, "b", "", ""), (1, 1, 4, "", "", "")],
        "turn_id int, step int, rank int, mapc string, url string, passage string")
    got = {(r.step, r.rank) for r in fu.bucket_merge(steps).collect()}
    assert got == {(0, 1), (0, 2), (1, 2), (1, 3)}
    hits = spark.createDataFrame([(1, 1, "a", "", "", "phapdien"), (1, 2, "", "u", "", "web"), (1, 3, "a", "", "", "phapdien")],
                                 "query_id int, pos int, mapc string, url string, passage string, source string")
    assert [r.pos for r in fu.final_dedup(hits).orderBy("rank").collect()] == [2, 1]


def test_head_rerank(spark):
    ranked = spark.createDataFrame([(1, i, i, 1.0 - i / 10) for i in range(1, 6)], "query_id int, id int, rank int, score double")
    scores = spark.createDataFrame([(1, 2, "0.9"), (1, 3, "1"), (1, 5, "1")], "query_id int, id int, raw_score string")
    assert [r.id for r in fu.head_rerank(ranked, scores, 3).orderBy("rank").collect()] == [3, 2, 1, 4, 5]


def test_hydrate(spark):
    keys = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "b"), (1, 3, "z")], "query_id int, pos int, mapc string")
    first = spark.createDataFrame([("a", "1")], "mapc string, ten string")
    second = spark.createDataFrame([("a", "x"), ("b", "2")], "mapc string, ten string")
    got = [(r.pos, r.ten) for r in fu.hydrate(keys, first, second).orderBy("pos").collect()]
    assert got == [(0, "2"), (1, "1"), (2, "2")]


def test_unknown_strategy(spark):
    vec, _ = _vectors(spark, 5)
    with pytest.raises(ValueError):
        rt.retrieve(vec, vec, vec, "nope")


def test_sweep_equals_single_runs(spark):
    vec, rows = _vectors(spark, 40)
    docs = vec.select("id", *[F.concat(F.lit("w"), (F.col("id") % m).cast("string"), F.lit(" t")).alias(c) for m, c in
                              ((3, "ten"), (5, "noidung"), (2, "tenchuong"), (2, "tendemuc"), (2, "tenchude"), (7, "vbqppl"))])
    q = vec.filter("id < 4").select(F.col("id").alias("query_id"), F.lit("w1 w2 t").alias("q_text"),
                                    F.col("embedding").alias("query_vec"))
    names = ["semantic_search", "hybrid_search", "two_stage_search"]
    swept = rt.sweep(q, vec, docs, names, [3, 5])
    for s in names:
        for k in (3, 5):
            one = _lists(rt.retrieve(q, vec, docs, s, k))
            assert _lists(swept.filter((F.col("strategy") == s) & (F.col("k") == k))) == one


# ---- lexical -----------------------------------------------------------------------------------


def test_bm25_tasks_grow_with_the_rows(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"a b{i % 7} c" * (1 + i % 3)) for i in range(60)], "id long, t string")
    q = spark.createDataFrame([(1, "a b1"), (2, "c b2 a")], "query_id long, q_text string")
    want = sorted(map(tuple, lx.bm25_search(q, d, {"t": 1.0}, 5).collect()))
    numbers = []
    deal = type(d).repartition
    monkeypatch.setattr(type(d), "repartition", lambda df, *a: (numbers.append(a[0]), deal(df, *a))[1])
    monkeypatch.setattr(lx, "TASK_CHARS", 100)
    monkeypatch.setattr(lx, "TASK_SUMS", 10)
    assert sorted(map(tuple, lx.bm25_search(q, d, {"t": 1.0}, 5).collect())) == want
    assert all(n > 5 for n in numbers) and len(numbers) == 2


def test_bm25_matches_brute_force(spark):
    rnd = random.Random(3)
    words = ["thuế", "nhà", "đất", "luật", "pháp luật", "tòa án", "xe", "là", "a_b"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 12))), " ".join(rnd.choices(words, k=3))) for i in range(30)]
    d = spark.createDataFrame(docs, "id long, noidung string, ten string")
    q = spark.createDataFrame([(1, "luật nhà nhà"), (2, "phiên tòa xe"), (3, "không có")], "query_id long, q_text string")
    boosts = {"noidung": 9.0, "ten": 10.0}
    fast = {(r.query_id, r.id): (r.rank, round(r.score, 6)) for r in lx.bm25_search(q, d, boosts, 10).collect()}
    for k in (1, 3):
        part = {(r.query_id, r.id): (r.rank, round(r.score, 6)) for r in lx.bm25_search(q, d, boosts, k).collect()}
        assert part == {key: v for key, v in fast.items() if v[0] <= k} and part
    toks = {r[0]: (r[1], r[2], r[3], r[4]) for r in d.select(
        "id", lx.analyze("noidung"), lx.analyze("ten"), lx.expand(lx.analyze("noidung")), lx.expand(lx.analyze("ten"))).collect()}
    qt = {r[0]: r[1] for r in q.select("query_id", lx.expand(lx.analyze("q_text"))).collect()}
    scores = {}
    for f, boost in ((0, 9.0), (1, 10.0)):
        full = {i: t[f] for i, t in toks.items()}
        grown = {i: t[f + 2] for i, t in toks.items()}
        n = sum(1 for t in full.values() if t)
        avg = sum(len(t) for t in full.values()) / n
        for qid, terms in qt.items():
            for i, t in grown.items():
                s = 0.0
                for term in terms:
                    tf = t.count(term)
                    df = sum(term in x for x in grown.values())
                    if tf:
                        s += math.log(1 + (n - df + .5) / (df + .5)) * tf / (tf + 1.2 * (.25 + .75 * len(full[i]) / avg))
                if s:
                    scores[(qid, i)] = max(scores.get((qid, i), 0), boost * s)
    for qid in qt:
        best = sorted(((-round(s, 9), i) for (x, i), s in scores.items() if x == qid))[:10]
        assert [i for _, i in best] == [i for (x, i), (r, _) in sorted(fast.items(), key=lambda e: e[1][0]) if x == qid]


def test_synonyms(spark):
    row = spark.createDataFrame([("Phiên tòa xét chứ",)], "x string").select(lx.expand(lx.analyze("x"))).first()[0]
    other = spark.createDataFrame([("tòa án",)], "x string").select(lx.expand(lx.analyze("x"))).first()[0]
    assert "chứ" not in row and set(row) & set(other) - {"tòa"} == {"~12"}


# ---- trust -------------------------------------------------------------------------------------


def test_trust(spark):
    df = spark.createDataFrame([
        (1, "https://www.vbpl.vn/x", "", "điều khoản"), (2, "http://x.blogspot.com", "luật", "điều khoản thông tư xử phạt"),
        (3, "", "", "luật"), (4, None, "", "văn bản thông tư"), (5, "not a url", "", "")],
        "id int, url string, ten string, noidung string")
    got = {r.id: (r.trust_score, r.trust_level) for r in tr.trust_class(tr.trust_score(df)).collect()}
    assert got[1] == (0.88, "high")  # điều, khoản, điều khoản
    assert got[2] == (0.37, "low") and got[3] == (0.34, "low") and got[4] == (0.4, "medium")
    assert got[5] == (0.28, "low")


# ---- graph -------------------------------------------------------------------------------------


def test_expand_small(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")], "src string, dst string")
    s = spark.createDataFrame([(1, "a")], "query_id int, key string")
    got = {r.key: (r.base, r.hop) for r in gr.graph_expand(s, e, 2, 40).collect()}
    assert got == {"a": (1.0, 0), "b": (0.5, 1), "d": (0.5, 1), "c": (0.5, 2)}


@pytest.mark.parametrize("limit", [4, 9, None])
def test_expand_with_hub_equals_brute_force(spark, limit):
    rnd = random.Random(11)
    edges = {(f"n{rnd.randint(0, 60):02d}", f"n{rnd.randint(0, 60):02d}") for _ in range(70)}
    edges |= {("n00", f"n{i:02d}") for i in range(1, 50)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seeds = {1: ["n00"], 2: ["n55", "n03"], 3: ["n59"]}
    want = {}
    for q, start in seeds.items():
        level = {x: 0 for x in start}
        front = set(start)
        for hop in (1, 2, 3):
            front = {y for x in front for y in near.get(x, ())} - set(level)
            level.update({y: hop for y in front})
        want[q] = [k for _, k in sorted((h, k) for k, h in level.items())][:limit]
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    s = spark.createDataFrame([(q, k) for q, ks in seeds.items() for k in ks], "query_id int, key string")
    got = {}
    for r in gr.graph_expand(s, e, 3, limit).orderBy("query_id", "hop", "key").collect():
        got.setdefault(r.query_id, []).append(r.key)
    assert got == want


def test_related_and_citations(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "x")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",)], "key string")
    assert {(r.src, r.dst) for r in gr.related_edges(pairs, nodes).collect()} == {("a", "b"), ("b", "a")}
    art = spark.createDataFrame([("1", "1.1.LQ.1", "theo 1.1.LQ.2 và 1.1.LQ.1"), ("2", "1.1.LQ.2", "xem 9.9.NĐ.4.1")],
                                "mapc string, code string, noidung string")
    assert [(r.src, r.dst) for r in gr.citation_edges(art, code="code").collect()] == [("1", "2")]


# ---- corpus and pages ----------------------------------------------------------------------------


def test_chapters(spark):
    ch2 = spark.createDataFrame([("d", "23011000", 1), ("d", "23012000", 2), ("e", "77", 1)], "demuc_id string, mapc string, pos int")
    art = spark.createDataFrame([("d", "230120009"), ("d", "99"), ("e", "1"), ("f", "1")], "demuc_id string, mapc string")
    got = {(r.demuc_id, r.mapc): r.chapter_id for r in ex.assign_chapter(art, ch2).collect()}
    assert got == {("d", "230120009"): "23012000", ("d", "99"): None, ("e", "1"): "77", ("f", "1"): None}


PAGE = """<div><p class='pChuong'><a name='10'></a>Chương I</p>
<p class='pDieu'><a name='101'></a>Điều 1. Tên</p><p class='pGhiChu'><a href='http://v?ItemID=7#x'>(ghi chú)</a></p><p class='pNoiDung'><p>Một &amp; hai</p>
<table border=1><tr><td>x<br></td></tr></table><p>Ba</p></p><a href='/f1'>f</a><a href='/f2'>g</a><p class='pChiDan'>(xem <a onclick="go('102')">Điều 2</a> <a href='#'>y</a> <a onclick=''>z</a>)</p>
<p class='pDieu'><a name='102'></a>Điều 2</p><p class='pGhiChu'>trống</p><p class='pNoiDung'>Chữ</p></div>"""


def test_page_files(spark, tmp_path):
    from korvane.sources.readers import pages_after, read_pages
    for name in ("p1", "p2"):
        (tmp_path / f"{name}.html").write_text("﻿" + PAGE, encoding="utf-8")
    pages = read_pages(spark, str(tmp_path))
    assert pages.count() == 2 and not pages.first().html.startswith("﻿")
    assert [r.page_id for r in pages_after(pages, "p2.html").collect()] == ["p2"]
    art = ex.extract_articles(pages.filter("page_id = 'p1'")).orderBy("pos").collect()
    assert [a.mapc for a in art] == ["101", "102"]
    a = art[0]
    assert a.ten == "Điều 1. Tên" and a.vbqppl == "(ghi chú)" and a.vbqppl_link == "http://v?ItemID=7#x"
    assert a.noidung == "Một & hai\n\nBa\n" and a.files == ["/f1", "/f2"]
    assert a.tables == ['<table border="1"><tr><td>x<br/></td></tr></table>']
    assert art[1].vbqppl == "trống" and art[1].vbqppl_link is None and art[1].noidung == "Chữ\n"
    rel = ex.extract_related(ex.extract_articles(pages.filter("page_id = 'p1'"))).collect()
    assert [(r.dieu_id1, r.dieu_id2) for r in rel] == [("101", "102")]


def test_page_files_are_listed_by_lots(spark, tmp_path, monkeypatch):
    import hashlib

    from korvane.plans import corpus
    from korvane.session import shared_dir
    rows = [(i, f"u{i}", f"<p>{i} ố\n</p>" * (i % 5)) for i in range(-3, 97)] + [(None, "u", "lost"), (500, "u", None)]
    rows += [(600, "u", "twice")] * 2 + [(700, "u", "a"), (700, "u", "b")]
    schema = "page_id long, url string, html string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "pages.parquet"))
    listed, shape = [], corpus.rd.shape_pages
    monkeypatch.setattr(corpus, "PAGE_LOT", 12, raising=False)
    monkeypatch.setattr(corpus.rd, "shape_pages", lambda raw, *a: listed.append(len(raw.inputFiles())) or shape(raw, *a))
    kept = {p.name for p in pathlib.Path(shared_dir(spark), "korvane").glob("page*")}
    cache = spark.conf.get("spark.sql.hive.filesourcePartitionFileCacheSize")
    got = sorted(((r.page_id, r.html) for r in corpus.page_read(spark, str(tmp_path)).collect()), key=str)
    assert sum(listed) == 104 and max(listed) <= 30 and len(listed) > 4     # a file per id, never all at once

    def md5(x):
        return hashlib.md5(x.encode()).hexdigest()
    want = [(None if i is None else str(i), md5((h or "") + "\u0001")) for i, _, h in rows[:101]] + [("500", md5("\u0001"))]
    mark = "﻿"
    assert [g for g in got if g[0] not in ("600", "700")] == sorted(want, key=str)
    # pages of one id are one file; only its first mark goes
    both = {md5(f"{a}\u0001{mark}{b}\u0001") for a, b in ("ab", "ba")}
    assert dict(got)["600"] == md5(f"twice\u0001{mark}twice\u0001") and dict(got)["700"] in both
    left = {p.name for p in pathlib.Path(shared_dir(spark), "korvane").glob("page*")} - kept
    assert [x[:9] for x in left] == ["page-rows"]       # the files of a lot go when it is read
    assert spark.conf.get("spark.sql.hive.filesourcePartitionFileCacheSize") == cache


def test_page_read_of_no_pages(spark, tmp_path):
    from korvane.plans import corpus
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = corpus.page_read(spark, str(tmp_path))
    assert found.columns == ["page_id", "html"] and found.collect() == []


def test_json_inputs(spark, tmp_path):
    from korvane.sources import readers as rd
    (tmp_path / "c.json").write_text(json.dumps([{"Value": "1", "Text": "A", "STT": "2"}]), encoding="utf-8")
    assert rd.read_catalog(spark, str(tmp_path / "c.json")).first().stt == 2
    chat = {"title": "t", "messages": [{"role": "user", "content": "x"}]}
    (tmp_path / "m.json").write_text(json.dumps({"k": chat}), encoding="utf-8")
    (tmp_path / "l.json").write_text(json.dumps([chat, chat]), encoding="utf-8")
    assert [r.chat_id for r in rd.read_chats_json(spark, str(tmp_path / "m.json")).collect()] == ["k"]
    assert [r.chat_id for r in rd.read_chats_json(spark, str(tmp_path / "l.json")).collect()] == ["0", "1"]
    (tmp_path / "e.json").write_text(json.dumps([{"query": "q", "gold_docs": [1, 2], "gold_response": "r"}]), encoding="utf-8")
    assert rd.read_eval(spark, str(tmp_path / "e.json")).first().gold_docs == [1, 2]


def test_rejects(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 3, "x"), (3, 4, None)], "id int, pos int, ref string")
    ok, bad = co.reject_invalid(df, ["id"], {"ref": spark.createDataFrame([("a",)], "k string")}, "pos")
    assert {r.pos for r in ok.collect()} == {1, 4}
    assert {(r.pos, r.reason) for r in bad.collect()} == {(2, "duplicate key"), (3, "missing ref")}


# ---- chats and memory ------------------------------------------------------------------------------


def test_message_arrays(spark):
    msg = "array<struct<role:string,content:string,tts_url:string,feedback:string>>"
    df = spark.createDataFrame([([("u", "a", "t", None), ("u", "b", None, None)],
                                 [("u", "a", None, None), ("u", "b", None, None), ("u", "c", None, None)])], f"o {msg}, n {msg}")
    got = df.select(ch.merge_message_arrays("o", "n")).first()[0]
    assert [m.tts_url for m in got] == ["t", None, None]


def test_long_chat_is_paged(spark):
    s = spark.createDataFrame([("c", "t", True, "1", None)], "id string, title string, pinned boolean, created_at string, updated_at string")
    m = spark.range(25).select("id", F.lit("c").alias("session_id"), F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))
    pages = ch.assemble_chats(s, m, page_size=10).orderBy("page").collect()
    assert [len(p.messages) for p in pages] == [10, 10, 5] and pages[2].messages[-1].content == "24"


def test_history_window_spans(spark):
    rows = [("c", i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "chat_id string, pos int, role string, content string")
    for span in (4, 7, 100):
        got = {r.pos: r.history for r in ch.history_window(df, 3, span=span).collect()}
        assert got == {i: "\n".join(f"{r.capitalize()}: {t}" for _, _, r, t in rows[max(0, i - 3):i]) for i in range(0, 40, 2)}


def test_chat_commands(spark):
    chats = spark.createDataFrame([("a", "A", False), ("b", "B", True), ("c", "C", False)], "chat_id string, title string, pinned boolean")
    cmds = spark.createDataFrame([
        ("a", 1, "rename", "X"), ("a", 2, "toggle", None), ("a", 3, "rename", "Y"), ("b", 1, "delete", None),
        ("c", 1, "pin", "true"), ("c", 2, "toggle", None), ("d", 1, "create", "D"), ("d", 2, "toggle", None), ("e", 1, "rename", "no")],
        "chat_id string, seq int, op string, value string")
    got = {r.chat_id: (r.title, r.pinned) for r in ch.apply_chat_commands(chats, cmds).collect()}
    assert got == {"a": ("Y", True), "c": ("C", False), "d": ("D", True)}


def _fold(mem, decisions):
    """The rules, one decision at a time."""
    state = {m: dict(fact=f, version=1, deleted=False) for m, f in mem}
    for seq, action, fact, target, new in decisions:
        if action == "ADD":
            state[new] = dict(fact=fact, version=1, deleted=False)
        elif target in state and not state[target]["deleted"]:
            if action == "UPDATE":
                row = state.pop(target)
                state[new] = dict(fact=fact, version=row["version"] + 1, deleted=False)
            elif action == "DELETE":
                state[target]["deleted"] = True
    return {k: (v["fact"], v["version"], v["deleted"]) for k, v in state.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decisions_equal_fold(spark, seed):
    rnd = random.Random(seed)
    mem = [(i, f"m{i}") for i in range(6)]
    decisions = []
    for seq in range(60):
        target = rnd.choice([i for i, _ in mem] + [1000 + s for s in range(60)])
        decisions.append((seq, rnd.choice(["ADD", "UPDATE", "UPDATE", "UPDATE", "DELETE"]), f"f{seq}", target, 1000 + seq))
    chain, last = [], 0
    for seq in range(60, 90):                      # one long version chain
        chain.append((seq, "UPDATE", f"f{seq}", last, 1000 + seq))
        last = 1000 + seq
    decisions = [x for x in decisions if x[3] != 0] + chain
    base = spark.createDataFrame([("u", i, f, "core", None, 1, False, None) for i, f in mem],
                                 "user_id string, mem_id long, fact string, mem_type string, timestamp timestamp, "
                                 "version int, deleted boolean, deleted_at timestamp")
    d = spark.createDataFrame([("u", s, a, f, "core", t, None, "r", n) for s, a, f, t, n in decisions],
                              "user_id string, seq long, action string, fact string, mem_type string, target_id long, "
                              "merged_fact string, reason string, new_id long").withColumn("at", F.timestamp_seconds("seq"))
    out, history, report = mm.apply_decisions(base, d)
    got = {r.mem_id: (r.fact, r.version, r.deleted) for r in out.collect()}
    assert got == _fold(mem, decisions)
    assert history.filter("root = 0").count() == 30 and report.count() == len(decisions)


def test_applied_decisions_are_joined_once(spark):
    base = spark.createDataFrame([("u", 1, "a", "core", None, 1, False, None)],
                                 "user_id string, mem_id long, fact string, mem_type string, timestamp timestamp, "
                                 "version int, deleted boolean, deleted_at timestamp")
    d = spark.createDataFrame([("u", 1, "UPDATE", "b", "core", 1, None, "r", 11), ("u", 2, "UPDATE", "c", "core", 11, None, "r", 12)],
                              "user_id string, seq long, action string, fact string, mem_type string, target_id long, "
                              "merged_fact string, reason string, new_id long").withColumn("at", F.timestamp_seconds("seq"))
    parts = mm.apply_decisions(base, d)
    for part in parts:         # memories, history and report read the same written step
        assert any("/applied-" in f for f in part.inputFiles())
        assert not any("/attempts-" in f for f in part.inputFiles())
    assert [(r.mem_id, r.fact, r.version) for r in parts[0].collect()] == [(12, "c", 3)]


def test_retrieve_memories(spark):
    mem = spark.createDataFrame([(1, "u", "core", "a", [1., 0.]), (2, "u", "core", "b", [0., 1.]),
                                 (3, "u", "semantic", "c", [.6, .8]), (4, "v", "core", "d", [1., 0.])],
                                "mem_id long, user_id string, mem_type string, fact string, embedding array<float>")
    q = spark.createDataFrame([(9, "u", [1., 0.])], "query_id long, user_id string, query_vec array<float>")
    got = {r.mem_id: r.score for r in mm.retrieve_memories(q, mem, k=2).collect()}
    assert got == {1: 1.0, 3: 0.6, 2: 1.0}
    text = mm.memory_context(mm.retrieve_memories(q, mem, k=2)).first().context.split("\n")
    assert text[1:] == ["- (core) a", "- (core) b", "- (semantic) c"]


def test_parse_facts(spark):
    rows = [(1, '```json\n[{"fact":"x","type":"Core"},{"fact":"cccd 012345678901","type":"core"}]\n```'), (2, "oops"),
            (3, '[{"fact":" ","type":"core"},{"fact":"y","type":"odd"}]')]
    got = mm.parse_facts(spark.createDataFrame(rows, "turn_id int, raw string")).collect()
    assert [(r.turn_id, r.fact, r.type) for r in got] == [(1, "x", "core")]


# ---- cache -------------------------------------------------------------------------------------


def test_cache(spark):
    c = spark.createDataFrame([(1, [1., 0.], 10), (2, [1., 0.], 20), (3, [0., 1.], 5), (4, [1.], 30)],
                              "entry_id long, embedding array<double>, t long")
    c = c.select("entry_id", "embedding", F.timestamp_seconds("t").alias("created_at"),
                 F.timestamp_seconds(F.col("t") + 86400).alias("expires_at"))
    q = spark.createDataFrame([(1, [2., 0.]), (2, [1., .5]), (3, [0., 1.])], "query_id long, query_vec array<double>")
    now = F.timestamp_seconds(F.lit(86400 + 6))
    assert [(r.query_id, r.entry_id) for r in ca.cache_lookup(q, c, now).collect()] == [(1, 2)]
    assert {r.entry_id for r in ca.cache_purge(c, now).collect()} == {1, 2, 4}


# ---- answers -----------------------------------------------------------------------------------


def test_answers(spark):
    assert _lcs("abcbdab", "bdcaba") == 4
    df = spark.createDataFrame([("a b c", "a x c", .0), ("", "a", .0)], "r string, g string, z double")
    got = [r[0] for r in df.select(rouge_l("r", "g")).collect()]
    assert got[0] == pytest.approx(2 / 3) and got[1] == 0
    pairs = [("a b c d e", "a b c d e"), ("x y", "a b"), ("", "a"), (None, "a"), ("a b", None),
             ("a a b c", "a b b c d"), ("a", "a b c")]
    df = spark.createDataFrame(pairs, "r string, g string")
    got = {(r.r, r.g): r.bleu for r in with_bleu(df, "r", "g").collect()}
    assert got[pairs[0]] == pytest.approx(1.0) and not any(got[p] for p in pairs[1:5])
    # 3/4, 2/3, none of 2, none of 1; shorter than the gold text by one
    want = np.exp(1 - 5 / 4) * np.prod([3 / 4, 2 / 3, np.log(4) / 10 / 2, np.log(4) / 20]) ** 0.25
    assert got[pairs[5]] == pytest.approx(want)
    assert got[pairs[6]] == pytest.approx(np.exp(1 - 3))
    df = spark.createDataFrame([("Luật đất", "luật đất đai")], "r string, g string")
    assert df.select(rouge_l("r", "g")).first()[0] == pytest.approx(0.8)


def test_stems(spark):
    from korvane.functions.stem import porter
    pairs = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled
        motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss
        fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration
        valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile
        analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
        hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic
        formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv
        allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
        irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog
        communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
        probate probat rate rate cease ceas controll control roll roll dying die news news died die a a is is""".split()
    wrong = [(w, porter(w), s) for w, s in zip(pairs[::2], pairs[1::2]) if porter(w) != s]
    assert not wrong
    df = spark.createDataFrame([("The cats were RUNNING!", "a cat was running")] * 3 + [(None, "x"), ("", None)],
                               "r string, g string").repartition(2)
    got = sorted(r[0] for r in df.select(rouge_l("r", "g", ascii_only=True, stem=True)).collect())
    assert got == [0, 0, 0.5, 0.5, 0.5]
    rnd = random.Random(1)
    rows = [(" ".join(rnd.choices(["runs", "running", "hopes", "hoping", "x", "xs"], k=9)),
             " ".join(rnd.choices(["runs", "running", "hopes", "hoping", "x", "xs"], k=7))) for _ in range(50)]
    def plain(r, g):
        a, b = ([porter(t) if len(t) > 3 else t for t in x.split()] for x in (g, r))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return 2 * table[-1][-1] / (len(a) + len(b))
    df = spark.createDataFrame(rows, "r string, g string")
    for r in df.withColumn("s", rouge_l("r", "g", stem=True)).collect():
        assert r.s == pytest.approx(plain(r.r, r.g))


# ---- plans -------------------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().toString()


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    assert plan(dist.top_per(df, "g", ["id"], 2)).count("WindowGroupLimit") >= 2


def test_scan_prunes_columns_and_pushes_filters(spark):
    d = "/root/testdata/sf0.001"
    text = plan(fu.get_article(spark.read.parquet(f"{d}/customer.parquet").select(
        F.col("c_name").alias("mapc"), "c_acctbal"), "Customer#000000001"))
    assert "EqualTo(c_name,Customer#000000001)" in text and "c_mktsegment" not in text.split("ReadSchema")[-1]


@pytest.mark.parametrize("name", ["knn_cosine", "route_turns", "graph_expand", "bm25_multi", "hierarchy_denorm",
                                  "apply_decisions", "trust_filter", "tree_children", "assign_chapter"])
def test_no_cartesian_products(spark, name):
    from korvane.plans import load
    text = plan(load()[0][name](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_gate_needs_no_shuffle(spark):
    df = spark.createDataFrame([("xin chào",)], "text string")
    assert "Exchange" not in plan(ga.route_turns(df, {"xin chào": "x"}))


# ---- sinks and streams ---------------------------------------------------------------------------


def test_load_and_resume(spark, tmp_path):
    from korvane.sources.writers import write_load
    df = spark.createDataFrame([(1, "ok"), (2, ""), (3, "ok")], "id int, text string")
    good, bad = co.load_with_rejects(df, {"empty": F.col("text") == ""})
    out, err = str(tmp_path / "out"), str(tmp_path / "err")
    write_load(good.filter("id = 1"), bad, out, err, resume=False)
    rest = co.load_increment(good, spark.read.parquet(out))
    assert [r.id for r in rest.collect()] == [3]
    write_load(rest, bad.limit(0), out, err)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 3]
    assert [(r.id, r.error) for r in spark.read.parquet(err).collect()] == [(2, "empty")]
    assert co.load_increment(good, spark.read.parquet(out), resume=False).count() == 2


def _flat(tree):
    tree.finish()
    return [(n.tag, n.attrs, n.up.no, n.at, n.last, [k for k in n.kids if isinstance(k, str)], n.html()) for n in tree.flat]


def test_plain_pages_read_as_by_the_parser():
    import random
    rng = random.Random(5)
    bits = ["<p class='a b'>", "<p>", "</p>", "<a href=\"x'y>\" name=''>", "</a>", "<br>", "</br>", "t &amp; u", "&lt", " \n", "Điều &#7;", "<td>", "</td>",
            "x; &am"]
    odd = ["<P>", "<a b>", "<br/>", "< p", "<!-- c -->", "<script>", "</script>", "<a href='&amp;'>", "<title>", "<", "</p >"]
    for turn in range(400):
        page = "".join(rng.choice(bits if turn % 2 or rng.random() < 0.9 else odd) for _ in range(rng.randrange(40)))
        plain, full = ex._Tree(), ex._Tree()
        full.feed(page)
        read = plain.read(page)
        assert read or turn % 2 == 0
        if read:
            assert _flat(plain) == _flat(full), page


def test_walk_holds_no_batch_of_articles(spark):
    one = "<p class='pDieu'><a name='%d'></a>t</p><p>n</p><p class='pNoiDung'>" + "x" * 50_000 + "</p>"
    pages = spark.createDataFrame([(i, "".join(one % n for n in range(8))) for i in range(30)], "page_id long, html string")
    sizes = ex.extract_articles(pages.coalesce(1)).mapInArrow(
        lambda batches: (b.append_column("n", pa.array([b.num_rows] * b.num_rows)).select(["n"]) for b in batches), "n long")
    assert sizes.count() == 240 and sizes.agg(F.max("n")).first()[0] < 100     # 50 KB each


def test_workers_are_handed_bounded_batches(spark):
    from korvane.session import prepare
    assert int(prepare(spark).conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_page_stream_resumes(spark, tmp_path):
    from korvane.streaming.streams import ingest_stream, run_to_table
    src = tmp_path / "in"
    src.mkdir()

    def run():
        return run_to_table(ingest_stream(spark, str(src), 1), str(tmp_path / "out"), str(tmp_path / "check"))

    (src / "a.html").write_text(PAGE, encoding="utf-8")
    assert run().count() == 2
    (src / "b.html").write_text(PAGE, encoding="utf-8")
    assert {(r.page_id, r.mapc) for r in run().collect()} == {(p, m) for p in "ab" for m in ("101", "102")}


def test_ingest_replaces_changed_pages_only(spark, tmp_path):
    from korvane.streaming.streams import ingest_changes

    def run(*rows):
        spark.createDataFrame(rows, "page_id string, html string, sent int").coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "in"))
        sdf = spark.readStream.schema("page_id string, html string, sent int").parquet(str(tmp_path / "in"))
        read = ingest_changes(sdf, str(tmp_path / "table"), str(tmp_path / "check"), order="sent", buckets=4)
        return sorted((r.page_id, r.mapc) for r in read().collect())

    one = "<p class='pDieu'><a name='7'></a>t</p><p>n</p><p class='pNoiDung'>body</p>"
    a = [("a", "101"), ("a", "102")]
    assert run(("a", PAGE, 1), ("b", one, 1)) == [*a, ("b", "7")]
    assert run(("a", PAGE, 2), ("c", one.replace("7", "8"), 2)) == [*a, ("b", "7"), ("c", "8")]
    versions = {p.name for p in (tmp_path / "table/articles/data").iterdir()}
    assert run(("a", PAGE, 3)) == [*a, ("b", "7"), ("c", "8")]                     # nothing new, nothing written
    assert {p.name for p in (tmp_path / "table/articles/data").iterdir()} == versions
    assert run(("b", one.replace("7", "9"), 5), ("b", one.replace("7", "3"), 4), ("a", None, 4)) == [("b", "9"), ("c", "8")]
    assert run(("a", PAGE, 6), (None, PAGE, 6)) == [*a, ("b", "9"), ("c", "8")]


def test_memory_stream_replays_and_restarts(spark, tmp_path):
    from korvane.streaming.streams import memory_stream
    fields = ("user_id string, seq long, action string, fact string, mem_type string, target_id long, merged_fact string, "
              "reason string, new_id long, at timestamp")
    src, root, check = (str(tmp_path / x) for x in ("in", "state", "check"))
    first = spark.createDataFrame([("u", 1, "a", "core", None, 1, False, None), ("v", 2, "b", "core", None, 1, False, None)],
                                  "user_id string, mem_id long, fact string, mem_type string, timestamp timestamp, "
                                  "version int, deleted boolean, deleted_at timestamp")

    def send(*rows):
        spark.createDataFrame([(*r, None) for r in rows], fields).coalesce(1).write.mode("append").parquet(src)
        return spark.readStream.schema(fields).parquet(src)

    memory_stream(send(("u", 1, "UPDATE", "c", "core", 1, None, "r", 101)), root, first, check)
    latest = memory_stream(send(("u", 2, "UPDATE", "d", "core", 101, None, "r", 102), ("w", 3, "ADD", "e", "core", None, None, "r", 103)),
                           root, None, check)
    got = {(r.user_id, r.mem_id, r.fact, r.version) for r in latest().collect()}
    assert got == {("u", 102, "d", 3), ("v", 2, "b", 1), ("w", 103, "e", 1)}


def test_memory_stream_keeps_history_and_only_live_versions(spark, tmp_path):
    import os
    from korvane.streaming.streams import memory_stream
    fields = ("user_id string, seq long, action string, fact string, mem_type string, target_id long, merged_fact string, "
              "reason string, new_id long, at timestamp, source_chat_id string, embedding array<float>")
    root, check = str(tmp_path / "state"), str(tmp_path / "check")
    rows = [("u", 1, "ADD", "a", None, 101), ("u", 2, "UPDATE", "b", 101, 102), ("v", 3, "ADD", "x", None, 103),
            ("u", 4, "UPDATE", "c", 102, 104), ("u", 5, "UPDATE", "lost", 101, 105), ("u", 6, "DELETE", "no", 104, 106),
            ("v", 7, "UPDATE", "y", 103, 107), ("w", 8, "UPDATE", "new", 999, 108), ("w", 9, "UPDATE", "newer", 108, 109),
            ("u", 10, "NOOP", "n", None, 110), ("w", 11, "ADD", "", None, 111)]
    made = [(u, s, act, f, "core", t, None, f"r{s}", n, None, f"chat{s}", [float(s)]) for u, s, act, f, t, n in rows]
    empty = spark.createDataFrame([], "user_id string, mem_id long, fact string, mem_type string, timestamp timestamp, "
                                  "version int, deleted boolean, deleted_at timestamp, source_chat_id string, embedding array<float>")
    out, history, report = mm.apply_decisions(empty, spark.createDataFrame(made, fields), upsert=True)
    for i in range(0, len(made), 3):                           # four batches
        spark.createDataFrame(made[i:i + 3], fields).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        tables = memory_stream(spark.readStream.schema(fields).parquet(str(tmp_path / "in")), root,
                               empty if i == 0 else None, check, buckets=4, upsert=True)
    key = lambda r: repr(r)
    cols = ["user_id", "mem_id", "fact", "version", "deleted", "source_chat_id", "embedding"]
    same = lambda a, b, *c: sorted(map(tuple, a.select(*c).collect()), key=key) == sorted(
        map(tuple, b.select(*c).collect()), key=key)
    assert same(tables(), out, *cols)
    assert same(tables.history(), history, "user_id", "root", "depth", "mem_id", "action", "fact", "reason", "negated_by")
    assert same(tables.report(), report, "user_id", "seq", "fact", "action")
    got = {(r.user_id, r.mem_id, r.fact, r.version, r.deleted, r.source_chat_id, r.embedding[0]) for r in tables().collect()}
    assert got == {("u", 104, "c", 3, True, "chat1", 4.0), ("u", 105, "lost", 2, False, "chat5", 5.0),
                   ("v", 107, "y", 2, False, "chat3", 7.0), ("w", 109, "newer", 3, False, "chat8", 9.0)}
    live = {(p.version, p.bucket) for p in tables.state.pieces()}
    held = {(int(v[8:]), int(b[7:])) for v in os.listdir(f"{root}/data") for b in os.listdir(f"{root}/data/{v}")
            if b.startswith("bucket=")}
    assert live <= held and len(tables.state.batches()) == 2
    assert held == {(p.version, p.bucket) for n in (3, 4) for p in tables.state.pieces(n)}


def test_cache_stream_sees_new_entries_and_its_clock(spark, tmp_path):
    import datetime as dt
    from korvane.streaming import streams as st
    day = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    entry = "entry_id long, text string, embedding array<double>, created_at timestamp"
    cache = st.cache_table(spark, str(tmp_path / "cache"), spark.createDataFrame([], entry + ", expires_at timestamp").drop("text").schema)
    hours = iter([0, 1, 30, 50])

    def put(rows, now=None):
        spark.createDataFrame([(i, t, v, day + dt.timedelta(hours=h)) for i, t, v, h in rows], entry).coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "puts"))
        return st.cache_put_stream(spark.readStream.schema(entry).parquet(str(tmp_path / "puts")), cache,
                                   str(tmp_path / "put"), now, most_pieces=2)

    def ask(i, v):
        now = day + dt.timedelta(hours=next(hours))
        spark.createDataFrame([(i, v)], "query_id long, query_vec array<double>").coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "asks"))
        sdf = spark.readStream.schema("query_id long, query_vec array<double>").parquet(str(tmp_path / "asks"))
        found = st.cache_lookup_stream(sdf, cache, lambda n: F.lit(now), str(tmp_path / "found"), str(tmp_path / "asked"))
        return {r.query_id: r.entry_id for r in found.collect()}

    assert ask(1, [1.0, 0.0]) == {}                                    # nothing stored yet
    put([(10, "a", [1.0, 0.0], 0), (10, "a", [1.0, 0.0], 0), (11, "hi", [1.0, 0.0], 0), (12, "b", [0.0, 1.0], -90)])
    assert ask(2, [1.0, 0.0]) == {2: 10}                               # put between two batches
    put([(10, "a", [1.0, 0.0], 5), (13, "c", [0.0, 1.0], 20)])         # sent again, later: not stored twice
    assert ask(3, [1.0, 0.0]) == {2: 10}                               # expired by the clock
    assert ask(4, [0.0, 1.0]) == {2: 10}                               # expired as well after two days
    reader = put([(14, "late", [1.0, 1.0], -1000)])
    assert sorted(r.entry_id for r in reader().collect()) == [10, 12, 13, 14]
    reader = put([(15, "new", [1.0, 1.0], 60)], now=day + dt.timedelta(hours=61))
    assert 15 in [r.entry_id for r in reader().collect()]
    assert all(p.until > (day + dt.timedelta(hours=61)).replace(tzinfo=None) for p in cache.pieces())


def test_lots_are_files_of_bounded_rows():
    from korvane.plans import turns
    assert [turns._lot_files(n) for n in (0, 200_000, 1_000_000, 1_000_001, 72_000_000)] == [1, 1, 1, 2, 72]


def test_retag_needs_valid_claims(spark):
    df = spark.createDataFrame([(1, "demo_a"), (2, "x_b"), (3, "demo_c")], "id int, user_id string")
    claims = spark.createDataFrame([("demo_a", "U"), ("x_b", "V"), ("demo_c", "")], "anonymous_id string, uid string")
    assert {(r.id, r.user_id, r.moved) for r in ch.retag_user(df, claims).collect()} == {
        (1, "U", True), (2, "x_b", False), (3, "demo_c", False)}


def test_bounded_lists_do_not_shuffle_the_corpus(spark):
    from korvane.plans.common import docs, query_rows, vectors
    d = "/root/testdata/sf0.001"
    hits = ve.semantic_search(query_rows(spark, d), vectors(spark, d), 5)
    text = plan(docs(spark, d).join(hits, "id"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_workers_do_not_need_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle
    path = tmp_path / "f.bin"
    path.write_bytes(cloudpickle.dumps((_lcs, ex._articles, ve._block, ve.best_positions)))
    code = f"import pickle; f = pickle.load(open({str(path)!r}, 'rb')); print(f[0]('a b', 'a b'), len(list(f[1]({PAGE!r}))))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert out.stdout.split()[-1] == "2", out.stderr


def test_cuts_are_parameters(spark):
    df = spark.createDataFrame([(1, 1, "x" * 90 + "a"), (1, 2, "x" * 90 + "b")], "query_id int, pos int, passage string")
    df = df.withColumns({"mapc": F.lit(None).cast("string"), "url": F.lit(None).cast("string"),
                         "source": F.lit("phapdien")})
    assert fu.final_dedup(df, key_chars=80).count() == 1
    assert fu.final_dedup(df).count() == fu.final_dedup(df, key_chars=None).count() == 2
    raw = spark.createDataFrame([(1, '[{"fact": "' + "f" * 3000 + '", "type": "core"}]')], "turn_id int, raw string")
    assert [len(mm.parse_facts(raw, **kw).first().fact) for kw in ({}, {"chars": None}, {"chars": 5})] == [1800, 3000, 5]


def test_deeply_nested_pages_are_read():
    deep = "<div>" * 5000 + "body & soul<br>" + "</div>" * 5000
    page = ('<p class="pDieu"><a name="1"></a>Title</p><p class="pNoiDung">' + deep + "<table>" + "<tr><td>x" * 3000
            + "</table></p>")
    (found,) = ex._articles(page)
    assert found[0] == "1" and "body & soul" in found[2]
