import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import deliver as dv
from corvane.operators import evaluate as ev
from corvane.operators import fusion as fu
from corvane.operators import significance as sg


def frames(spark, ranking, gold):
    r = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(ranking)], "query_id string, doc_id string, rank int")
    return r, spark.createDataFrame([("q", d, g) for d, g in gold.items()], "query_id string, doc_id string, grade int")


def metrics(spark, ranking, gold, depth=100, **kw):
    return ev.topic_metrics(*frames(spark, ranking, gold), depth, **kw).first()


def test_ndcg_vectors(spark):
    m = metrics(spark, ["x", "a", "b"], {"a": 1, "b": 1})
    assert abs(m.ndcg10 - (1 / math.log2(3) + 1 / math.log2(4)) / (1 / math.log2(2) + 1 / math.log2(3))) < 1e-12
    assert metrics(spark, ["a", "b"], {"a": 1, "b": 1, "c": 1}, k=2).ndcg10 == 1
    assert metrics(spark, [f"x{i}" for i in range(10)] + ["a"], {"a": 1}).mrr10 == 0
    assert metrics(spark, [f"x{i}" for i in range(9)] + ["a"], {"a": 1}).mrr10 == pytest.approx(0.1)


def test_no_hit(spark):
    m = metrics(spark, ["x", "y"], {"a": 1})
    assert m.ndcg10 == m.recall10 == m.recall100 == m.average_precision == m.r_precision == m.all_gold_in_top10 == 0
    assert m.recall300 is None and m.recall1000 is None and m.rbp_residual == pytest.approx(1)


def test_topic_without_results_and_negative_grades(spark):
    r, q = frames(spark, [], {"a": 2, "b": 0, "c": -1})
    m = ev.topic_metrics(r, q, 100).first()
    assert m.ndcg10 == 0 and m.rbp_residual == 1
    m = metrics(spark, ["b", "a"], {"a": 2, "b": 0, "c": -1})
    assert m.ndcg10 == pytest.approx(1 / math.log2(3)) and m.rbp_residual == pytest.approx(0.64)


def test_mean_is_null_unless_all_are_measured(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 3.0)], "x double, y double")
    assert df.agg(ev.mean_if_all("x").alias("x"), ev.mean_if_all("y").alias("y")).first() == (None, 2.0)


def test_oracle_bounds(spark):
    rng = random.Random(1)
    rows = [(f"q{q}", f"d{d}", r + 1) for q in range(20) for r, d in enumerate(rng.sample(range(40), 15))]
    gold = [(f"q{q}", f"d{d}", rng.randrange(3)) for q in range(20) for d in rng.sample(range(40), 8)]
    r, g = spark.createDataFrame(rows, "query_id string, doc_id string, rank int"), spark.createDataFrame(gold, "query_id string, doc_id string, grade int")
    for x in ev.forensics(r, g).collect():
        assert 0 <= x.ndcg <= x.oracle_ndcg + 1e-9 <= 1 + 2e-9


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("q", f"a{i}", i, c) for i, c in enumerate([5, 9, 3, 1], 1)], "query_id string, atom_id string, rank int, c long")
    assert [r.atom_id for r in dv.fit_budget(df, F.col("c"), 10).orderBy("rank").collect()] == ["a1", "a3", "a4"]


def test_cap_order_and_confidence(spark):
    rows = [("q", f"a{i}", d, i, o, float(10 - i)) for i, (d, o) in enumerate([("x", 5), ("y", 1), ("x", 2), ("x", None), ("y", 0)], 1)]
    df = spark.createDataFrame(rows, "query_id string, atom_id string, document string, rank int, origin_index int, score double")
    capped = dv.cap_per_document(df, 2)
    assert {r.atom_id for r in capped.collect()} == {"a1", "a2", "a3", "a5"} and dv.cap_per_document(df, 0).count() == 5
    assert [r.atom_id for r in dv.reading_order(capped).orderBy("place").collect()] == ["a3", "a1", "a5", "a2"]
    asked = spark.createDataFrame([("q",), ("none",)], "query_id string")
    assert {r.query_id: r.confidence for r in dv.confidence(df.withColumn("relevance", F.lit(0.5)), asked).collect()} == {"q": "ok", "none": "none"}
    assert dv.pool_size(10, 2) == 100 and dv.pool_size(80, 2) == 160 and dv.pool_size(5, None, 40) == 40


def test_fusion_by_hand(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, atom_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, atom_id string, rank int")
    fused = {r.atom_id: (r.rank, r.score) for r in fu.fuse_legs(a, b).collect()}
    assert fused["y"] == (1, round(0.5 / 22 + 0.5 / 21, 12)) and fused["x"][0] == 2 and fused["z"][0] == 3
    rer = {r.atom_id: (r.rank, r.score) for r in fu.fuse_rerank(a, b).collect()}
    assert rer["y"] == (1, round(0.75 / 21 + 0.25 / 22, 12)) and rer["x"] == (2, round(0.25 / 21, 12))
    assert len(fu.fusion_grid(["a", "b", "c"])) == 2 * 3 * 2 + 3


def reference_random(seed, counter):
    mask = 0xFFFFFFFF
    state = (seed + counter * 0x6D2B79F5) & mask
    a = ((state ^ (state >> 15)) * (1 | state)) & mask
    b = ((a + ((a ^ (a >> 7)) * (61 | a))) & mask) ^ a
    return ((b ^ (b >> 14)) & mask) / 2**32


def test_generator(spark):
    got = spark.range(2_000).select("id", sg.unit_random(sg.PERMUTATION_SEED, F.col("id")).alias("u")).collect()
    assert all(r.u == reference_random(sg.PERMUTATION_SEED, r.id) for r in got)


def topics(spark, values):
    return spark.createDataFrame([(f"q{i:03d}", v) for i, v in enumerate(values)], "query_id string, m double")


def test_significance(spark):
    rng = random.Random(2)
    base = [rng.random() for _ in range(40)]
    noise = [rng.gauss(0, 0.1) for _ in base]
    noisy = sg.paired_differences(topics(spark, base), topics(spark, [b + x for b, x in zip(base, noise)]), "m")
    balanced = sg.paired_differences(topics(spark, base), topics(spark, [b + (0.1 if i % 2 else -0.1) for i, b in enumerate(base)]), "m")
    gain = sg.paired_differences(topics(spark, base), topics(spark, [b + 0.2 for b in base]), "m")
    # The p-value equals that of the same draws made one by one.
    observed = abs(sum(noise)) / 40 - sg.TIE_EPSILON
    flips = [sum(-x if reference_random(sg.PERMUTATION_SEED, i * 40 + t) < 0.5 else x for t, x in enumerate(noise)) / 40 for i in range(1_000)]
    assert sg.permutation_test(noisy, 1_000).first().p_value == pytest.approx((sum(abs(m) >= observed for m in flips) + 1) / 1_001)
    assert sg.permutation_test(balanced, 1_000).first().p_value > 0.9
    p = sg.permutation_test(gain, 1_000).first()
    assert p.p_value == pytest.approx(1 / 1_001) and p.topics == 40 and p.mean_difference == pytest.approx(0.2)
    ci = sg.bootstrap_interval(gain, 1_000).first()
    assert ci.ci_low == pytest.approx(0.2) and ci.ci_high == pytest.approx(0.2)


def test_unlike_runs_are_refused(spark):
    with pytest.raises(ValueError, match="topics differ"):
        sg.paired_differences(topics(spark, [1.0]), topics(spark, [1.0, 2.0]), "m")
    with pytest.raises(ValueError, match="missing"):
        sg.paired_differences(topics(spark, [None]), topics(spark, [1.0]), "m")


def test_registered_recall_curve_has_every_depth(spark, tiny):
    from corvane.plans import registry

    rows = {r.k: r.recall for r in registry.queries()["e31_recall_curves_deep"](spark, tiny).collect()}
    curve = [rows[k] for k in ev.RECALL_DEPTHS]
    assert None not in curve and curve == sorted(curve)


def test_blocks_of_draws_equal_the_columns(spark):
    import numpy as np

    u = sg._random_block(sg.BOOTSTRAP_SEED, np.arange(2_000, dtype=np.uint64) * np.uint64(7_919))
    want = [r.u for r in spark.range(2_000).select("id", sg.unit_random(sg.BOOTSTRAP_SEED, F.col("id") * 7_919).alias("u")).orderBy("id").collect()]
    assert u.tolist() == want


def test_cross_pairing(spark):
    rows = lambda shift: spark.createDataFrame([(f"q{i}", 0.1 * (i % 7) + shift * (i % 3), None if i == 3 else 0.5) for i in range(40)], "query_id string, ndcg10 double, recall10 double")
    got = {r.metric: r for r in sg.cross_pairing(rows(0.0), rows(0.2), ("ndcg10", "recall10")).collect()}
    assert got["ndcg10"].significant and got["ndcg10"].topics == 40 and got["ndcg10"].ci_low > 0 and got["recall10"].p_value is None
    with pytest.raises(ValueError):
        sg.cross_pairing(rows(0.0), rows(0.0).where("query_id <> 'q1'"), ("ndcg10",))


def test_paired_verdict(spark):
    scores = {p: spark.createDataFrame([(f"q{i}", 0.5 + (i % 5) * d) for i in range(n)], "query_id string, ndcg10 double") for p, n, d in (("a", 30, 0.0), ("b", 30, 0.1), ("c", 29, 0.1))}
    row = lambda **kw: {"ts": "t", "adapter": "x", "depth": 100, "perTopic": "a", **kw}
    say = lambda b, metric="ndcg10": sg.paired_verdict(row(), b, metric, scores.get)
    assert say(row(depth=50))["kind"] == "provenance-changed" and say(row(perTopic=None))["kind"] == "unattributable-run"
    assert say(row(perTopic="zz"))["kind"] == "missing-per-topic" and say(row(perTopic="c"))["kind"] == "topics-differ"
    v = say(row(perTopic="b", analyzer="y"))
    assert v["kind"] == "verdict" and v["significant"] and [a["field"] for a in v["arms"]] == ["analyzer"]
    scores["n"] = scores["a"].withColumn("ndcg10", F.lit(None).cast("double"))
    assert say(row(perTopic="n"))["kind"] == "metric-unavailable"
    assert not __import__("corvane.operators.runs", fromlist=["x"]).changed_fields(row(), row(rerankPool=5, prfDocs=3))


def test_engine_metrics(spark):
    ranking = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "query_id string, doc_id string, rank int")
    golden = spark.createDataFrame([("a", ["y", "y", None, "w"]), ("b", []), ("c", ["q"])], "query_id string, doc_ids array<string>")
    got = {r.query_id: tuple(r)[1:] for r in ev.engine_metrics(ranking, golden, 10).collect()}
    assert got == {"a": (2, 0.5, 0.5), "b": (1, None, None), "c": (0, 0.0, 0.0)}
    s = ev.engine_summary(ev.engine_metrics(ranking, golden, 10)).first()
    assert (s.recall, s.mrr, s.scored, s.unscorable) == (0.25, 0.25, 2, 1)


def test_best_cell_breaks_ties(spark):
    cells = spark.createDataFrame([(1.2, 0.75, "q", 0.5), (0.9, 0.4, "q", 0.5), (1.5, 0.4, "q", 0.5), (0.9, 0.75, "q", 0.4)], "k1 double, b double, query_id string, ndcg10 double")
    assert tuple(ev.best_cell(cells).first())[:2] == (0.9, 0.4)


def test_identifier_gap_takes_the_rarest_part(spark):
    from corvane.operators import rank as rk

    df = spark.createDataFrame([("retri", 5), ("polici", 2), ("cach", 1)], "term string, df long")
    q = spark.createDataFrame([("a", "retry_policy cache.size x"), ("b", None), ("c", "retry-nothing")], "query_id string, query_text string")
    got = {r.query_id: (r.n_terms, r.n_gaps, r.gap_terms) for r in rk.vocabulary_gap(q, df, "ident-porter-fold").collect()}
    assert got["a"][2] == "cache_size size x" and got["c"][2] == "noth retry_nothing" and "b" not in got


def test_reproduction_is_checked(spark):
    a = spark.createDataFrame([("q1", 0.5), ("q2", 0.25)], "query_id string, ndcg10 double")
    ev.check_reproduction(a, a.withColumn("ndcg10", F.col("ndcg10") + 1e-12))
    with pytest.raises(ValueError, match="2 topics"):
        ev.check_reproduction(a, a.withColumn("ndcg10", F.col("ndcg10") + 1e-6))
    ev.check_reproduction(a, a.withColumn("ndcg10", F.col("ndcg10") + 1e-6), tolerance=ev.AGREEMENT_TOLERANCE)


def test_judged_documents_alone_give_the_metrics_of_the_whole_ranking(spark):
    whole = spark.createDataFrame([(q, f"d{i}", i) for q in ("a", "b") for i in range(1, 41)], "query_id string, doc_id string, rank int")
    gold = spark.createDataFrame([("a", "d1", 1), ("a", "d17", 2), ("a", "d30", 0), ("a", "x", 1), ("b", "d12", 1), ("c", "d3", 1)], "query_id string, doc_id string, grade int")
    part = whole.join(gold, ["query_id", "doc_id"], "left_semi")
    rows = [[tuple(r[c] if c == "query_id" or r[c] is None else round(r[c], 12) for c in ("query_id", *ev.METRICS)) for r in df.orderBy("query_id").collect()] for df in (ev.topic_metrics(whole, gold, 1_000), ev.topic_metrics(part, gold, 1_000, judged_only=True))]
    assert rows[0] == rows[1] and len(rows[0]) == 3
    curve = lambda df, **kw: ev.macro_metrics(ev.topic_metrics(df, gold, 1_000, **kw)).select(*(f"recall{k}" for k in ev.RECALL_DEPTHS)).first()
    assert curve(part, judged_only=True) == curve(whole)


def test_ranks_in_each_cell_of_a_grid(spark):
    from corvane.operators import index as ix
    from corvane.operators import rank as rk

    docs = spark.createDataFrame([(f"a{i}", "x " * (1 + i % 3) + "y " * (i % 4) + "z " * (i % 5)) for i in range(30)], "atom_id string, body string")
    idx, q = ix.Index.build(docs, "nostem-fold"), spark.createDataFrame([("p", "x", 1), ("q", "y", 1), ("q", "z", 1)], "query_id string, term string, qtf long")
    grid = spark.createDataFrame([(0.9, 0.4), (1.5, 0.75)], "k1 double, b double")
    wanted = docs.where("atom_id in ('a1', 'a7', 'a24')").selectExpr("explode(array('p', 'q')) as query_id", "atom_id")
    want = {(c.k1, c.b, *r) for c in grid.collect() for r in rk.top_k(rk.bm25(idx, q, c.k1, c.b), 20).select("query_id", "atom_id", "rank").join(wanted, ["query_id", "atom_id"], "left_semi").collect()}
    assert want and {tuple(r) for r in rk.ranks_of(idx, q, wanted, 20, grid).collect()} == want


def _no_ranking(monkeypatch):
    from corvane.operators import rank as rk

    def refused(*args, **kwargs):
        raise AssertionError("a ranking was made: rows of queries x depth on disk")

    for name in ("bm25_top", "top_k"):
        monkeypatch.setattr(rk, name, refused)


def test_the_deep_recall_curve_comes_without_a_ranking(spark, tiny, monkeypatch):
    from corvane.plans import eval_queries as eq

    whole = ev.macro_metrics(ev.topic_metrics(eq.golden_ranking(spark, tiny, 1_000), eq.qrels(spark, tiny), 1_000)).first()
    _no_ranking(monkeypatch)
    assert {r.k: r.recall for r in eq.e31_recall_curves_deep(spark, tiny).collect()} == {k: whole[f"recall{k}"] for k in ev.RECALL_DEPTHS}
    assert whole.recall1000 > whole.recall10 > 0


def test_deep_topic_metrics_come_without_a_ranking(spark, tiny, monkeypatch):
    from corvane.plans import eval_queries as eq

    rows = lambda df: {r.query_id: tuple(r[c] if r[c] is None else round(r[c], 9) for c in ev.METRICS) for r in df.collect()}
    whole = eq.golden_ranking(spark, tiny, 1_000)
    want = {k: rows(ev.topic_metrics(whole.where(f"rank <= {k}"), eq.qrels(spark, tiny), k)) for k in (20, 1_000)}
    _no_ranking(monkeypatch)
    assert rows(eq.e_topic_metrics_deep(spark, tiny)) == want[1_000] and rows(eq.e_topic_metrics(spark, tiny, 20)) == want[20] != want[1_000]
