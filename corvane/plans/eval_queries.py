"""Queries of fusion, delivery and evaluation over the run and judgment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.api import Profile, SearchRequest, dense_leg, type_filter
from corvane.functions import text as tx
from corvane.operators import deliver as dv
from corvane.operators import evaluate as ev
from corvane.operators import fusion as fu
from corvane.operators import index as ix
from corvane.operators import rank as rk
from corvane.operators import significance as sg
from corvane.operators.references import reference_value
from corvane.plans import sql
from corvane.plans.rank_queries import ANALYZER, corpus, queries_of, text_of
from corvane.session import cut, table

DEPTH = 10
#: Ranks of the legs of the first queries; evaluation over all recall depths takes EVAL_DEPTH (the *_deep queries).
LEG_DEPTH = 40
EVAL_DEPTH = max(ev.RECALL_DEPTHS)
AS_OF = "2025-06-30"
KNOWN_TYPES = ["adr", "benchmark", "feature-log", "knowledge", "paper", "review", "standard"]


def qrels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "golden_queries").select("query_id", F.explode("relevant_atom_ids").alias("v"))
    return rows.select("query_id", reference_value("v").alias("doc_id"), F.lit(1).alias("grade")).where("doc_id is not null").distinct()


def run_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each run's rows by natural key, the last loaded one."""
    w = Window.partitionBy("run_tag", "query_id", "rank_no").orderBy(F.desc("loaded_at"), F.desc("hit_no"))
    rows = table(spark, d, "run_hits").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return rows.select("run_tag", "query_id", reference_value("atom_id").alias("doc_id"), F.col("rank_no").alias("rank"), "score", "run_at")


def run_rankings(spark: SparkSession, d: str) -> DataFrame:
    return ev.clean_ranking(run_rows(spark, d), ["run_tag", "query_id"])


class _Legs(dict):
    """The best of each leg down to a depth, made when asked for and kept in the checkpoint folder."""

    def __init__(self, spark: SparkSession, d: str, depth: int) -> None:
        super().__init__()
        self.depth = depth
        self.corpus = cut(corpus(spark, d).select("atom_id", "title", "body"))  # every leg reads it
        self.terms = cut(rk.query_terms(queries_of(spark, d), ANALYZER))

    def __missing__(self, name: str) -> DataFrame:
        text = {"linear": text_of(), "body": F.col("body"), "title": F.col("title")}[name]
        self[name] = cut(rk.bm25_top(ix.Index.build(self.corpus, ANALYZER, text), self.terms, self.depth))
        return self[name]


def _legs(spark: SparkSession, d: str, depth: int = LEG_DEPTH) -> _Legs:
    return _Legs(spark, d, depth)


def golden_ranking(spark: SparkSession, d: str, depth: int = LEG_DEPTH) -> DataFrame:
    leg = _legs(spark, d, depth)["linear"]
    return leg.select("query_id", F.col("atom_id").alias("doc_id"), "rank")


def u1_fuse_rerank(spark: SparkSession, d: str) -> DataFrame:
    legs = _legs(spark, d)
    return fu.fuse_rerank(legs["linear"], legs["title"])


def u3_replace_rerank(spark: SparkSession, d: str) -> DataFrame:
    legs = _legs(spark, d)
    return fu.fuse_rerank(legs["linear"], legs["title"], replace=True)


def u2_fuse_legs(spark: SparkSession, d: str) -> DataFrame:
    legs = _legs(spark, d)
    return fu.fuse_legs(legs["body"], legs["title"])


def r12_hybrid_full(spark: SparkSession, d: str) -> DataFrame:
    legs = _legs(spark, d)
    return fu.fuse_legs(legs["body"], legs["title"], leg_cut=5)


def u6_fusion_grid(spark: SparkSession, d: str, depth: int = LEG_DEPTH) -> DataFrame:
    legs = _legs(spark, d, depth)
    rows = None
    for name in ("linear", "body", "title"):
        part = legs[name].select(F.lit(name).alias("leg"), "query_id", "atom_id", "rank")
        rows = part if rows is None else rows.unionByName(part)
    weights = spark.createDataFrame(fu.fusion_grid(["linear", "body", "title"]), "fusion string, leg string, weight double")
    return fu.fuse_many(rows, weights).where("rank <= 10")


def u7_head_to_head(spark: SparkSession, d: str) -> DataFrame:
    legs, q = _legs(spark, d), qrels(spark, d)
    ndcg = lambda leg: ev.topic_metrics(leg.select("query_id", F.col("atom_id").alias("doc_id"), "rank"), q, 40)
    return fu.head_to_head(ndcg(legs["body"]), ndcg(legs["title"]), "ndcg10")


def _pool(spark: SparkSession, d: str, depth: int = LEG_DEPTH) -> DataFrame:
    leg = _legs(spark, d, depth)["body"]
    return leg.join(queries_of(spark, d), "query_id").join(corpus(spark, d).select("atom_id", "body"), "atom_id")


def u8_rerank(spark: SparkSession, d: str, depth: int = LEG_DEPTH) -> DataFrame:
    return fu.rerank(_pool(spark, d, depth)).where("rank <= 10")


def u10_calibration(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    return run_rows(spark, d).select("run_tag", "query_id", "rank", F.round(fu.calibrate(s - 20), 9).alias("sigmoid"), fu.calibrate(s, "identity").alias("identity"))


def f4_live_atoms(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).where(dv.is_retrievable(AS_OF)).select("atom_id", "status", "stale_after")


def f2_type_and_domain(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    return c.where(dv.member_of("atom_type", ["review", "standard"]) & dv.member_of("x_domain", ["docs", "runner"])).select("atom_id", "atom_type", "x_domain")


def f5_known_type(spark: SparkSession, d: str) -> DataFrame:
    kind = dv.known_type("atom_type", KNOWN_TYPES, "knowledge")
    return corpus(spark, d).groupBy(kind.alias("atom_type")).agg(F.count("*").alias("n"))


def _pool_with_docs(spark: SparkSession, d: str, depth: int = LEG_DEPTH) -> DataFrame:
    c = corpus(spark, d).select("atom_id", F.coalesce(F.get("sources", F.lit(0)), F.col("atom_id")).alias("document"), "title", "heading_chain", "body", "origin_index", "origin_count")
    return _legs(spark, d, depth)["body"].join(c, "atom_id")


def w3_cap_per_document(spark: SparkSession, d: str, depth: int = LEG_DEPTH) -> DataFrame:
    return dv.renumber(dv.cap_per_document(_pool_with_docs(spark, d, depth)), 10).select("query_id", "atom_id", "document", "rank")


def w5_reading_order(spark: SparkSession, d: str, depth: int = LEG_DEPTH) -> DataFrame:
    capped = dv.renumber(dv.cap_per_document(_pool_with_docs(spark, d, depth)), 10)
    return dv.reading_order(capped).select("query_id", "atom_id", "document", "place")


def w6_fit_budget(spark: SparkSession, d: str) -> DataFrame:
    served = _pool_with_docs(spark, d).where("rank <= 10")
    return dv.fit_budget(served, tx.byte_size(F.coalesce("body", F.lit(""))), 8_000)


def w8_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = _legs(spark, d)["body"].where("rank <= 10").withColumn("relevance", fu.calibrate(F.col("score") - 15))
    return dv.confidence(rows, queries_of(spark, d))


def f7_relevance_floor(spark: SparkSession, d: str) -> DataFrame:
    rows = _legs(spark, d)["body"].where("rank <= 10").withColumn("relevance", fu.calibrate(F.col("score") - 15))
    return dv.relevance_floor(rows, 0.4).select("query_id", "atom_id", "rank", "below_floor", "unscored")


def w9_normalised(spark: SparkSession, d: str) -> DataFrame:
    return dv.normalise_scores(run_rows(spark, d).where("run_tag is not null"), ("run_tag", "query_id")).select("run_tag", "query_id", "rank", F.round("score_normalised", 9).alias("score_normalised"))


def w10_document_rollup(spark: SparkSession, d: str) -> DataFrame:
    origins = corpus(spark, d).select("atom_id", F.transform(F.filter("sources", lambda s: s.isNotNull()), lambda s: F.regexp_extract(s, r"([^/]+?)(?:\.md)?$", 1)).alias("documents"))
    return ev.document_rollup(_legs(spark, d)["body"], origins)


def w11_atom_spread(spark: SparkSession, d: str) -> DataFrame:
    return ev.atom_spread(_pool_with_docs(spark, d).where("rank <= 10"))


def w13_percentiles(spark: SparkSession, d: str) -> DataFrame:
    at = lambda f: F.expr(f"percentile_disc({f}) within group (order by score)")
    return run_rows(spark, d).where("score is not null").groupBy("run_tag").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.count("*").alias("n"))


def w15_pack(spark: SparkSession, d: str, depth: int = LEG_DEPTH) -> DataFrame:
    capped = dv.reading_order(dv.renumber(dv.cap_per_document(_pool_with_docs(spark, d, depth)), 5))
    packs = dv.render_pack(capped)
    return packs.select("query_id", F.md5("pack").alias("pack_md5"), "citations", "markers")


def golden_metrics(spark: SparkSession, d: str, depth: int = LEG_DEPTH) -> DataFrame:
    """topic_metrics() of the linear leg down to a depth; only the ranks of judged documents are made, which is all that the metrics read."""
    gold = cut(qrels(spark, d))
    found = rk.ranks_of(ix.Index.build(corpus(spark, d), ANALYZER, text_of()), rk.query_terms(queries_of(spark, d), ANALYZER), gold.select("query_id", F.col("doc_id").alias("atom_id")), depth)
    return ev.topic_metrics(found.withColumnRenamed("atom_id", "doc_id"), gold, depth, judged_only=True)


def e_topic_metrics(spark: SparkSession, d: str, depth: int = LEG_DEPTH) -> DataFrame:
    m = golden_metrics(spark, d, depth)
    return m.select("query_id", *(F.round(c, 9).alias(c) for c in ev.METRICS))


def e_run_metrics(spark: SparkSession, d: str) -> DataFrame:
    hits = run_rankings(spark, d)
    return ev.macro_metrics(ev.topic_metrics(hits, qrels(spark, d), DEPTH, hits), ["run_tag"])


def e14_dataset_score(spark: SparkSession, d: str, depth: int = LEG_DEPTH) -> DataFrame:
    return ev.macro_metrics(golden_metrics(spark, d, depth))


def e13_strata(spark: SparkSession, d: str) -> DataFrame:
    return ev.strata(ev.topic_metrics(golden_ranking(spark, d), qrels(spark, d), 40), table(spark, d, "golden_queries").select("query_id", "axis").distinct())


def e15_forensics(spark: SparkSession, d: str) -> DataFrame:
    return ev.forensics(golden_ranking(spark, d), qrels(spark, d))


def e33_legacy_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return ev.legacy_ndcg(golden_ranking(spark, d), qrels(spark, d))


def e16_gold_in_budget(spark: SparkSession, d: str) -> DataFrame:
    """Per topic: gold in the served slice, gold that survives the budget, and the share of other atoms delivered."""
    kept = w6_fit_budget(spark, d).select("query_id", F.lower("atom_id").alias("doc_id"))
    gold = qrels(spark, d)
    served = _legs(spark, d)["body"].where("rank <= 10").select("query_id", F.lower("atom_id").alias("doc_id"))
    n = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    rows = n(gold, "gold").join(n(served.join(gold, ["query_id", "doc_id"], "left_semi"), "gold_served"), "query_id", "left")
    rows = rows.join(n(kept.join(gold, ["query_id", "doc_id"], "left_semi"), "gold_kept"), "query_id", "left").join(n(kept, "delivered"), "query_id", "left").na.fill(0)
    return rows.select("query_id", "gold", "gold_served", "gold_kept", F.round(F.try_divide(F.col("delivered") - F.col("gold_kept"), F.col("delivered")), 9).alias("noise"))


def e18_significance(spark: SparkSession, d: str) -> DataFrame:
    legs, q = _legs(spark, d), qrels(spark, d)
    ndcg = lambda leg: ev.topic_metrics(leg.select("query_id", F.col("atom_id").alias("doc_id"), "rank"), q, 40).select("query_id", F.round("ndcg10", 9).alias("ndcg10"))
    diff = sg.paired_differences(ndcg(legs["title"]), ndcg(legs["linear"]), "ndcg10")
    return sg.permutation_test(diff).crossJoin(sg.bootstrap_interval(diff))


def e21_gold_audit(spark: SparkSession, d: str) -> DataFrame:
    current = table(spark, d, "atoms").where("removed_at is null").select(reference_value("atom_id").alias("doc_id"))
    everything = table(spark, d, "atoms").select(reference_value("atom_id").alias("doc_id"))
    return ev.gold_audit(qrels(spark, d), everything, current)


def e22_collapsing_topics(spark: SparkSession, d: str) -> DataFrame:
    return ev.collapsing_topics(table(spark, d, "golden_queries").select("query_id", "query_text").distinct(), qrels(spark, d))


def e24_reachability(spark: SparkSession, d: str) -> DataFrame:
    there = table(spark, d, "atoms").where("removed_at is null").select(reference_value("atom_id").alias("doc_id")).distinct().withColumn("there", F.lit(1))
    per = qrels(spark, d).join(there, "doc_id", "left").groupBy("query_id").agg((F.count("there") / F.count("*")).alias("ceiling"), F.count_if(F.col("there").isNull()).alias("unreachable"))
    return per.agg(F.sum("unreachable").alias("unreachable"), F.round(F.avg("ceiling"), 9).alias("recall_ceiling"), F.count("*").alias("topics"))


def e34_random_recall(spark: SparkSession, d: str) -> DataFrame:
    n = corpus(spark, d).agg(F.count("*").alias("n"))
    return n.select(F.explode(F.array(*map(F.lit, ev.RECALL_DEPTHS))).alias("k"), "n").select("k", F.round(F.least(F.lit(1.0), F.try_divide(F.col("k"), F.col("n"))), 9).alias("recall"))


def e26_metric_delta(spark: SparkSession, d: str) -> DataFrame:
    """Each query's mean score of a run against the run before it."""
    per = run_rows(spark, d).groupBy("query_id", "run_tag").agg(F.min("run_at").alias("run_at"), F.round(F.avg("score"), 9).alias("mean_score"))
    before = F.lag("mean_score").over(Window.partitionBy("query_id").orderBy("run_at", "run_tag"))
    return per.withColumn("delta", F.round(F.col("mean_score") - before, 9)).select("query_id", "run_tag", "mean_score", "delta")


def e26_ndcg_delta(spark: SparkSession, d: str) -> DataFrame:
    """Each judged topic's nDCG@10 in a run against that in the run before it."""
    hits = run_rankings(spark, d)
    began = run_rows(spark, d).groupBy("run_tag").agg(F.min("run_at").alias("run_at"))
    m = ev.topic_metrics(hits, qrels(spark, d), DEPTH, hits).select("run_tag", "query_id", F.round("ndcg10", 9).alias("ndcg10")).join(began, "run_tag")
    before = F.lag("ndcg10").over(Window.partitionBy("query_id").orderBy("run_at", "run_tag"))
    return m.withColumn("delta", F.round(F.col("ndcg10") - before, 9)).select("run_tag", "query_id", "ndcg10", "delta")


def e27_regression_gate(spark: SparkSession, d: str) -> DataFrame:
    m = e_run_metrics(spark, d).select("run_tag", "ndcg10", "recall10")
    before = F.lag("ndcg10").over(Window.orderBy("run_tag"))  # one row a run
    return m.withColumn("previous", before).select("run_tag", "ndcg10", "previous", F.when(F.col("previous").isNull(), "first").when(F.col("ndcg10") - F.col("previous") >= -0.01, "pass").otherwise("fail").alias("gate"))


def e31_recall_curves(spark: SparkSession, d: str, depth: int = LEG_DEPTH) -> DataFrame:
    m = e14_dataset_score(spark, d, depth)
    points = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"recall{k}").alias("recall")) for k in ev.RECALL_DEPTHS))
    return m.select(F.explode(points).alias("p")).select("p.k", "p.recall")


def e35_metric_disagreement(spark: SparkSession, d: str) -> DataFrame:
    """Metrics as recorded from the title leg against those recomputed from the body leg."""
    legs, q = _legs(spark, d), qrels(spark, d)
    m = lambda leg: ev.topic_metrics(leg.select("query_id", F.col("atom_id").alias("doc_id"), "rank"), q, 40)
    out = ev.metric_disagreement(m(legs["title"]), m(legs["body"]), ("ndcg10", "mrr10"))
    return out.select("query_id", "metric", F.round("recorded", 9).alias("recorded"), F.round("recomputed", 9).alias("recomputed"))


def e35_late_loads(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each run's topics as recorded from the rows that were loaded within a week, against those of all rows."""
    rows = table(spark, d, "run_hits")
    w = Window.partitionBy("run_tag", "query_id", "rank_no").orderBy(F.desc("loaded_at"), F.desc("hit_no"))

    def metrics(part: DataFrame) -> DataFrame:
        last = part.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("run_tag", "query_id", reference_value("atom_id").alias("doc_id"), F.col("rank_no").alias("rank"))
        hits = ev.clean_ranking(last, ["run_tag", "query_id"])
        m = ev.topic_metrics(hits, qrels(spark, d), DEPTH, every)
        return m.select(F.concat_ws("@", "query_id", "run_tag").alias("query_id"), "ndcg10", "mrr10")

    every = rows.where("run_tag is not null").select("run_tag", "query_id").distinct()
    named = rows.where("run_tag is not null")
    out = ev.metric_disagreement(metrics(named.where("loaded_at <= run_at + interval 7 days")), metrics(named), ("ndcg10", "mrr10"))
    return out.select("query_id", "metric", F.round("recorded", 9).alias("recorded"), F.round("recomputed", 9).alias("recomputed"))


def e22_collapsing_run_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics asked by several runs: each run's copy of a golden query has the same text and gold as the others."""
    runs = run_rows(spark, d).select("run_tag", "query_id").where("run_tag is not null").distinct()
    named = F.concat_ws("@", "query_id", "run_tag").alias("query_id")
    golden = table(spark, d, "golden_queries").select("query_id", "query_text").distinct()
    return ev.collapsing_topics(runs.join(golden, "query_id").select(named, "query_text"), runs.join(qrels(spark, d), "query_id").select(named, "doc_id", "grade"))


def e17_engine_metrics(spark: SparkSession, d: str) -> DataFrame:
    golden = table(spark, d, "golden_queries").select("query_id", F.transform("relevant_atom_ids", lambda x: reference_value(x)).alias("doc_ids"))
    m = ev.engine_metrics(golden_ranking(spark, d), golden, 10)
    return m.select("query_id", "retrieved", F.round("recall", 9).alias("recall"), F.round("reciprocal_rank", 9).alias("reciprocal_rank"))


def e17_engine_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.engine_summary(e17_engine_metrics(spark, d))


def r17_best_cell(spark: SparkSession, d: str) -> DataFrame:
    """The best cell of the sweep by nDCG@10 over the judged topics; the baseline is one of the cells."""
    grid = spark.createDataFrame([(k1, b) for k1 in (0.9, 1.2, 1.5) for b in (0.4, 0.75)], "k1 double, b double")
    gold = cut(qrels(spark, d))
    top = rk.ranks_of(ix.Index.build(corpus(spark, d), ANALYZER, text_of()), rk.query_terms(queries_of(spark, d), ANALYZER), gold.select("query_id", F.col("doc_id").alias("atom_id")), 10, grid)
    cell = F.concat_ws(" ", F.col("k1").cast("string"), F.col("b").cast("string"))
    ranking = top.select(cell.alias("run_tag"), "query_id", F.col("atom_id").alias("doc_id"), "rank")
    every = grid.select(cell.alias("run_tag")).crossJoin(gold.select("query_id").distinct())  # the grid has a few cells
    m = ev.topic_metrics(ranking, gold, 10, every)
    at = F.split("run_tag", " ")
    return ev.best_cell(m.select(at[0].cast("double").alias("k1"), at[1].cast("double").alias("b"), "query_id", "ndcg10"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return rk.hashed_vectors(corpus(spark, d), "atom_id", tx.tokenize(F.col("body"))), rk.hashed_vectors(queries_of(spark, d), "query_id", tx.tokenize(F.col("query_text")))


def _hybrid_legs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vectors, asked = _vectors(spark, d)
    return _legs(spark, d)["body"], dense_leg(vectors, asked, LEG_DEPTH)


def r10_dense_leg(spark: SparkSession, d: str) -> DataFrame:
    """The nearest atoms of each query by cosine of hashed term vectors."""
    return _hybrid_legs(spark, d)[1].select("query_id", "atom_id", "score", "rank")


def r11_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """A lexical and a dense leg by reciprocal ranks, cut to the first 10."""
    return fu.fuse_legs(*_hybrid_legs(spark, d)).where("rank <= 10")


def u5_served_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two served legs with uniform weights."""
    legs = _legs(spark, d)
    rows = legs["linear"].select(F.lit("linear").alias("leg"), "query_id", "atom_id", "rank").unionByName(legs["body"].select(F.lit("body").alias("leg"), "query_id", "atom_id", "rank"))
    weights = spark.createDataFrame([("served", "linear", 0.5), ("served", "body", 0.5)], "fusion string, leg string, weight double")
    return fu.fuse_many(rows, weights).where("rank <= 10").drop("fusion")


PROFILE = Profile(("adr", "docs", "misc", "runner", "standards"), (*KNOWN_TYPES, "brainstorm", "lessons-learned", "plan", "research", "runner-rule", "teaching", "vendor-doc"), ("brainstorm", "plan"))


def f3_default_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Atoms of the types that a search covers unless it says otherwise."""
    return corpus(spark, d).where(dv.member_of("atom_type", type_filter(SearchRequest(), PROFILE))).select("atom_id", "atom_type")


def w7_reserved_budget(spark: SparkSession, d: str) -> DataFrame:
    """A byte budget of which the rendering has reserved a part."""
    served = _pool_with_docs(spark, d).where("rank <= 10")
    return dv.fit_budget(served, tx.byte_size(F.coalesce("body", F.lit(""))), 8_000, 500)


def e40_cross_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two rankers as two systems: paired tests of all metrics of a cross pairing."""
    legs, q = _legs(spark, d), qrels(spark, d)
    m = lambda leg: ev.topic_metrics(leg.select("query_id", F.col("atom_id").alias("doc_id"), "rank"), q, LEG_DEPTH).select("query_id", *(F.round(c, 9).alias(c) for c in sg.CROSS_METRICS))
    out = sg.cross_pairing(m(legs["title"]), m(legs["linear"]))
    return out.select("metric", "topics", *(F.round(c, 9).alias(c) for c in ("mean_difference", "p_value", "ci_low", "ci_high")), "significant")


# The same over the depth that evaluation and the pools of delivery call for.


def u6_fusion_grid_deep(spark: SparkSession, d: str) -> DataFrame:
    return u6_fusion_grid(spark, d, EVAL_DEPTH)


def u8_rerank_deep(spark: SparkSession, d: str) -> DataFrame:
    return u8_rerank(spark, d, dv.pool_size(10, None, dv.POOL_FLOOR))


def w3_cap_per_document_deep(spark: SparkSession, d: str) -> DataFrame:
    return w3_cap_per_document(spark, d, dv.pool_size(10, dv.MAX_PER_DOC))


def w5_reading_order_deep(spark: SparkSession, d: str) -> DataFrame:
    return w5_reading_order(spark, d, dv.pool_size(10, dv.MAX_PER_DOC))


def w15_pack_deep(spark: SparkSession, d: str) -> DataFrame:
    return w15_pack(spark, d, dv.pool_size(5, dv.MAX_PER_DOC))


def e_topic_metrics_deep(spark: SparkSession, d: str) -> DataFrame:
    return e_topic_metrics(spark, d, EVAL_DEPTH)


def e14_dataset_score_deep(spark: SparkSession, d: str) -> DataFrame:
    return e14_dataset_score(spark, d, EVAL_DEPTH)


def e31_recall_curves_deep(spark: SparkSession, d: str) -> DataFrame:
    return e31_recall_curves(spark, d, EVAL_DEPTH)


QUERIES = {
    f.__name__: f
    for f in (
        u1_fuse_rerank, u2_fuse_legs, u3_replace_rerank, r12_hybrid_full, u6_fusion_grid, u7_head_to_head, u8_rerank, u10_calibration,
        f2_type_and_domain, f4_live_atoms, f5_known_type, f7_relevance_floor,
        w3_cap_per_document, w5_reading_order, w6_fit_budget, w8_confidence, w9_normalised, w10_document_rollup, w11_atom_spread, w13_percentiles, w15_pack,
        e_topic_metrics, e_run_metrics, e13_strata, e14_dataset_score, e15_forensics, e16_gold_in_budget, e18_significance, e21_gold_audit, e22_collapsing_topics, e24_reachability, e26_metric_delta, e27_regression_gate, e31_recall_curves, e33_legacy_ndcg, e34_random_recall, e35_metric_disagreement,
        e26_ndcg_delta, e35_late_loads, e22_collapsing_run_topics, e17_engine_metrics, e17_engine_summary, r17_best_cell, r10_dense_leg, r11_hybrid, u5_served_fusion, f3_default_exclusion, w7_reserved_budget, e40_cross_pairs,
        u6_fusion_grid_deep, u8_rerank_deep, w3_cap_per_document_deep, w5_reading_order_deep, w15_pack_deep, e_topic_metrics_deep, e14_dataset_score_deep, e31_recall_curves_deep,
    )
}

# --- SQL twins ---------------------------------------------------------------------------------

_REF = lambda c: f"nullif(lower(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '')"
_QRELS = f"qrels AS (SELECT DISTINCT query_id, doc_id, 1 AS grade FROM (SELECT query_id, {_REF('v')} AS doc_id FROM (SELECT query_id, unnest(relevant_atom_ids) AS v FROM golden_queries)) WHERE doc_id IS NOT NULL)"
_RUNS = f"""runs AS (SELECT run_tag, query_id, {_REF('atom_id')} AS doc_id, rank_no AS rank, score, run_at FROM
  (SELECT *, row_number() OVER (PARTITION BY run_tag, query_id, rank_no ORDER BY loaded_at DESC, hit_no DESC) AS rn FROM run_hits) WHERE rn = 1),
hits AS (SELECT run_tag, query_id, doc_id, row_number() OVER (PARTITION BY run_tag, query_id ORDER BY rank, doc_id) AS rank
  FROM (SELECT run_tag, query_id, doc_id, min(rank) AS rank FROM runs WHERE doc_id IS NOT NULL GROUP BY 1, 2, 3))"""


def _leg(name: str, text: str) -> tuple[str, ...]:
    """The CTEs of one leg: its own index, scores and the best 40."""
    index = sql.INDEX.replace("coalesce(title, '') || ' ' || coalesce(body, '')", text)
    for x in ("tokens", "docs", "postings", "stats"):
        index = index.replace(f"{x} AS", f"{x}_{name} AS").replace(f"FROM {x}", f"FROM {x}_{name}")
    index = index.replace("df AS (", f"df_{name} AS (")
    score = sql.scores(name=f"scores_{name}")
    for x in ("postings", "df", "docs"):
        score = score.replace(f"JOIN {x} USING", f"JOIN {x}_{name} USING")
    score = score.replace("CROSS JOIN stats", f"CROSS JOIN stats_{name}")
    return index, score, sql.ranked(f"scores_{name}", 40, f"leg_{name}")


_LINEAR = _leg("linear", "coalesce(title, '') || ' ' || coalesce(body, '')")
_BODY_LEG = _leg("body", "body")
_TITLE = _leg("title", "title")
_START = (sql.CORPUS, sql.QUERIES, sql.QTERMS)
_FUSED = "SELECT query_id, atom_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r1 {nulls}, r2) AS rank FROM fused"
_POOL = "pool AS (SELECT l.query_id, l.atom_id, l.rank, l.score, coalesce(sources[1], atom_id) AS document, title, heading_chain, body, origin_index, origin_count FROM leg_body l JOIN corpus USING (atom_id))"
_CAPPED = lambda k: f"capped AS (SELECT * EXCLUDE (n, rank, r), r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document ORDER BY rank) AS n FROM pool) WHERE n <= 2) WHERE r <= {k})"
_ORDERED = "ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, origin_index ASC NULLS LAST, rank) AS place FROM (SELECT *, min(rank) OVER (PARTITION BY query_id, document) AS best FROM capped))"
_BUDGET = """served AS (SELECT query_id, list({'rank': rank, 'atom_id': atom_id, 'cost': CAST(octet_length(encode(coalesce(body, ''))) AS BIGINT)} ORDER BY rank) AS xs FROM pool WHERE rank <= 10 GROUP BY 1),
folded AS (SELECT query_id, list_reduce(list_prepend({'used': CAST(0 AS BIGINT), 'kept': CAST([] AS STRUCT(rank BIGINT, atom_id VARCHAR, cost BIGINT, used BIGINT)[])},
   list_transform(xs, lambda x: {'used': x.cost, 'kept': [{'rank': x.rank, 'atom_id': x.atom_id, 'cost': x.cost, 'used': CAST(0 AS BIGINT)}]})),
   lambda a, x: CASE WHEN a.used + x.used <= 8000 THEN {'used': a.used + x.used, 'kept': list_append(a.kept, {'rank': x.kept[1].rank, 'atom_id': x.kept[1].atom_id, 'cost': x.kept[1].cost, 'used': a.used + x.used})} ELSE a END) AS f FROM served),
kept AS (SELECT query_id, k.atom_id AS atom_id, k.rank AS rank, k.cost AS cost, k.used AS used FROM (SELECT query_id, unnest(f.kept) AS k FROM folded))"""


def _metrics_sql(ranking: str, depth: int, topics: str | None = None, name: str = "metrics") -> str:
    """ranking: ([run_tag,] query_id, doc_id, rank)."""
    keys = "run_tag, query_id" if topics else "query_id"
    asked = f"(SELECT DISTINCT {keys} FROM {topics}) JOIN ideal_{name} USING (query_id)" if topics else f"ideal_{name}"
    cut = lambda k, x: x if k <= depth else "CAST(NULL AS DOUBLE)"
    share = lambda x: f"CASE WHEN n_relevant > 0 THEN ({x}) / n_relevant ELSE 0 END"
    recalls = ", ".join(f"{cut(k, share(f'count(*) FILTER (rel AND rank <= {k})'))} AS recall{k}" for k in ev.RECALL_DEPTHS)
    precisions = ", ".join(f"{cut(k, f'count(*) FILTER (rel AND rank <= {k}) / {k}.0')} AS precision{k}" for k in ev.PRECISION_DEPTHS)
    return f"""ideal_{name} AS (SELECT query_id, count(*) FILTER (grade > 0) AS n_relevant, sum(CASE WHEN grade > 0 AND place <= 10 THEN grade / log2(place + 1) ELSE 0 END) AS idcg
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS place FROM qrels) GROUP BY 1),
rows_{name} AS (SELECT *, sum(CASE WHEN rel THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY rank ROWS UNBOUNDED PRECEDING) AS so_far FROM (
  SELECT {keys}, n_relevant, idcg, rank, grade, coalesce(grade > 0, false) AS rel FROM {asked} LEFT JOIN (SELECT * FROM {ranking} LEFT JOIN qrels USING (query_id, doc_id)) r USING ({keys}))),
{name} AS (SELECT {keys},
  CASE WHEN idcg > 0 THEN sum(CASE WHEN rel AND rank <= 10 THEN grade / log2(rank + 1) ELSE 0 END) / idcg ELSE 0 END AS ndcg10, {recalls},
  coalesce(1.0 / min(rank) FILTER (rel AND rank <= 10), 0) AS mrr10, {precisions},
  {cut(10, "CASE WHEN n_relevant > 0 AND count(*) FILTER (rel AND rank <= 10) = least(n_relevant, 10) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")} AS all_gold_in_top10,
  {share("sum(CASE WHEN rel THEN so_far / rank ELSE 0 END)")} AS average_precision,
  CASE WHEN n_relevant > {depth} THEN NULL WHEN n_relevant = 0 THEN 0 ELSE count(*) FILTER (rel AND rank <= n_relevant) / n_relevant END AS r_precision,
  (1 - 0.8) * sum(CASE WHEN rank IS NOT NULL AND grade IS NULL THEN pow(0.8, rank - 1) ELSE 0 END) + pow(0.8, count(rank)) AS rbp_residual
  FROM rows_{name} GROUP BY {keys}, n_relevant, idcg)"""


def _macro_sql(source: str = "metrics", keys: str = "") -> str:
    all_or_null = lambda m: f"round(CASE WHEN count({m}) = count(*) THEN avg({m}) END, 9) AS {m}"
    means = ", ".join("round(coalesce(avg(r_precision), 0), 9) AS r_precision" if m == "r_precision" else all_or_null(m) for m in ev.METRICS)
    head, group = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    return f"SELECT {head}count(*) AS topics, {means}, count(r_precision) AS r_precision_topics, round(coalesce(stddev_samp(ndcg10), 0), 9) AS ndcg10_sd FROM {source}{group}"


_GOLDEN = (*_START, *_LINEAR, _QRELS, "ranking AS (SELECT query_id, atom_id AS doc_id, rank FROM leg_linear)")
_RRF = "1.0 / (20 + {r})"
_DCG = lambda r: f"sum(CASE WHEN {r} <= 10 THEN g / log2({r} + 1) ELSE 0 END)"
_REL = "(1 / (1 + exp(-(score - 15))))"
_MARKER = r"<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<<<KNOWLEDGE-PACK>>>|<<<END-KNOWLEDGE-PACK>>>"
_NEUTRAL = lambda c: f"regexp_replace(regexp_replace({c}, '({_MARKER})', '[[neutralised:\\1]]', 'g'), '(?im)^([ \\t]*)(System:|Assistant:|User:|Human:)', '\\1[[neutralised:\\2]]', 'g')"

ORACLES = {
    "u1_fuse_rerank": sql.base(*_START, *_LINEAR, *_TITLE, "fused AS (SELECT a.query_id, a.atom_id, a.rank AS r1, b.rank AS r2, round(coalesce(0.75 / (20 + b.rank), 0) + 0.25 / (20 + a.rank), 12) AS score FROM leg_linear a LEFT JOIN leg_title b USING (query_id, atom_id))") + _FUSED.format(nulls=""),
    "u3_replace_rerank": sql.base(*_START, *_LINEAR, *_TITLE, "fused AS (SELECT a.query_id, a.atom_id, a.rank AS r1, b.rank AS r2, round(1.0 / coalesce(b.rank, count(b.rank) OVER (PARTITION BY a.query_id) + a.rank), 12) AS score FROM leg_linear a LEFT JOIN leg_title b USING (query_id, atom_id))") + _FUSED.format(nulls=""),
    "u2_fuse_legs": sql.base(*_START, *_BODY_LEG, *_TITLE, "fused AS (SELECT query_id, atom_id, a.rank AS r1, b.rank AS r2, round(coalesce(0.5 / (20 + a.rank), 0) + coalesce(0.5 / (20 + b.rank), 0), 12) AS score FROM leg_body a FULL JOIN leg_title b USING (query_id, atom_id))") + _FUSED.format(nulls="ASC NULLS LAST"),
    "r12_hybrid_full": sql.base(*_START, *_BODY_LEG, *_TITLE, "fused AS (SELECT query_id, atom_id, a.rank AS r1, b.rank AS r2, round(coalesce(0.5 / (20 + a.rank), 0) + coalesce(0.5 / (20 + b.rank), 0), 12) AS score FROM (SELECT * FROM leg_body WHERE rank <= 5) a FULL JOIN (SELECT * FROM leg_title WHERE rank <= 5) b USING (query_id, atom_id))") + _FUSED.format(nulls="ASC NULLS LAST"),
    "u6_fusion_grid": sql.base(*_START, *_LINEAR, *_BODY_LEG, *_TITLE,
        "legs AS (SELECT 'linear' AS leg, query_id, atom_id, rank FROM leg_linear UNION ALL SELECT 'body', query_id, atom_id, rank FROM leg_body UNION ALL SELECT 'title', query_id, atom_id, rank FROM leg_title)",
        "weights AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{leg}', {w!r}::DOUBLE)" for f, leg, w in fu.fusion_grid(["linear", "body", "title"])) + ") x(fusion, leg, weight))",
        "scores AS (SELECT fusion, query_id, atom_id, round(sum(weight / (20 + rank)), 12) AS score FROM legs JOIN weights USING (leg) WHERE rank <= 100 GROUP BY 1, 2, 3)", sql.ranked("scores", 10, keys="fusion, query_id")) + "SELECT fusion, query_id, atom_id, score, rank FROM ranked",
    "u7_head_to_head": sql.base(*_START, *_BODY_LEG, *_TITLE, _QRELS, "ra AS (SELECT query_id, atom_id AS doc_id, rank FROM leg_body)", "rb AS (SELECT query_id, atom_id AS doc_id, rank FROM leg_title)", _metrics_sql("ra", 40, name="ma"), _metrics_sql("rb", 40, name="mb"))
        + "SELECT count(*) FILTER (a.ndcg10 - b.ndcg10 > 1e-9) AS wins, count(*) FILTER (a.ndcg10 - b.ndcg10 < -1e-9) AS losses, count(*) FILTER (abs(a.ndcg10 - b.ndcg10) <= 1e-9) AS ties FROM ma a JOIN mb b USING (query_id)",
    "u8_rerank": sql.base(*_START, *_BODY_LEG, f"q AS (SELECT query_id, list_distinct({sql.tok('query_text')}) AS qt FROM queries)",
        f"scored AS (SELECT query_id, atom_id, rank, round(CASE WHEN len(qt) > 0 THEN len(list_filter(qt, lambda t: list_contains(bt, t))) / len(qt) ELSE 0 END, 9) AS rerank_score FROM (SELECT l.query_id, l.atom_id, l.rank, qt, {sql.tok('left(body, 2000)')} AS bt FROM leg_body l JOIN q USING (query_id) JOIN corpus USING (atom_id)))",
    ) + "SELECT query_id, atom_id, rerank_score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS r FROM scored) WHERE r <= 10",
    "u10_calibration": sql.base(_RUNS) + "SELECT run_tag, query_id, rank, round(1 / (1 + exp(-(score - 20))), 9) AS sigmoid, CASE WHEN score BETWEEN 0 AND 1 THEN score END AS identity FROM runs",
    "f2_type_and_domain": sql.base(sql.CORPUS) + "SELECT atom_id, atom_type, x_domain FROM corpus WHERE atom_type IN ('review', 'standard') AND x_domain IN ('docs', 'runner')",
    "f4_live_atoms": sql.base(sql.CORPUS) + f"SELECT atom_id, status, stale_after FROM corpus WHERE NOT coalesce(lower(trim(status)) = 'deprecated', false) AND NOT coalesce(regexp_full_match(stale_after, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND stale_after < '{AS_OF}', false)",
    "f5_known_type": sql.base(sql.CORPUS) + "SELECT CASE WHEN atom_type IN (" + ", ".join(f"'{t}'" for t in KNOWN_TYPES) + ") THEN atom_type ELSE 'knowledge' END AS atom_type, count(*) AS n FROM corpus GROUP BY 1",
    "f7_relevance_floor": sql.base(*_START, *_BODY_LEG) + f"SELECT query_id, atom_id, rank, below_floor, unscored FROM (SELECT query_id, atom_id, rank, {_REL} AS r, count(*) FILTER ({_REL} < 0.4) OVER w AS below_floor, count(*) FILTER ({_REL} IS NULL) OVER w AS unscored FROM leg_body WHERE rank <= 10 WINDOW w AS (PARTITION BY query_id)) WHERE r >= 0.4",
    "w3_cap_per_document": sql.base(*_START, *_BODY_LEG, _POOL, _CAPPED(10)) + "SELECT query_id, atom_id, document, rank FROM capped",
    "w5_reading_order": sql.base(*_START, *_BODY_LEG, _POOL, _CAPPED(10), _ORDERED) + "SELECT query_id, atom_id, document, place FROM ordered",
    "w6_fit_budget": sql.base(*_START, *_BODY_LEG, _POOL, _BUDGET) + "SELECT query_id, atom_id, rank, cost, used FROM kept",
    "w8_confidence": sql.base(*_START, *_BODY_LEG) + f"SELECT q.query_id, CASE WHEN b.query_id IS NULL THEN 'none' WHEN b.relevance >= 0.4 THEN 'ok' ELSE 'weak' END AS confidence FROM queries q LEFT JOIN (SELECT query_id, {_REL} AS relevance FROM leg_body WHERE rank = 1) b USING (query_id)",
    "w9_normalised": sql.base(_RUNS) + "SELECT run_tag, query_id, rank, round(CASE WHEN count(*) OVER w >= 2 AND max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 9) AS score_normalised FROM runs WINDOW w AS (PARTITION BY run_tag, query_id)",
    "w10_document_rollup": sql.base(*_START, *_BODY_LEG, "origins AS (SELECT atom_id, list_transform(list_filter(sources, lambda s: s IS NOT NULL), lambda s: regexp_extract(s, '([^/]+?)(?:\\.md)?$', 1)) AS ds FROM corpus)",
        "firsts AS (SELECT query_id, doc_id, min({'rank': rank, 'pos': i}) AS at1 FROM (SELECT query_id, rank, i, ds[i] AS doc_id FROM (SELECT query_id, rank, ds, unnest(range(1, len(ds) + 1)) AS i FROM leg_body JOIN origins USING (atom_id))) GROUP BY 1, 2)",
    ) + "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY at1, doc_id) AS rank FROM firsts",
    "w11_atom_spread": sql.base(*_START, *_BODY_LEG, _POOL, "marked AS (SELECT *, CASE WHEN lag(document) OVER (PARTITION BY query_id ORDER BY rank) IS DISTINCT FROM document THEN 1 ELSE 0 END AS new_run FROM pool WHERE rank <= 10)")
        + "SELECT query_id, CASE WHEN count(*) FILTER (rank <= 5) >= 5 THEN count(DISTINCT document) FILTER (rank <= 5) END AS docs5, CASE WHEN count(*) >= 10 THEN count(DISTINCT document) END AS docs10, CASE WHEN count(*) >= 10 THEN sum(new_run)::BIGINT END AS runs10 FROM marked GROUP BY 1",
    "w13_percentiles": sql.base(_RUNS) + "SELECT run_tag, quantile_disc(score, 0.5) AS p50, quantile_disc(score, 0.95) AS p95, count(*) AS n FROM runs WHERE score IS NOT NULL GROUP BY 1",
    "w15_pack": sql.base(*_START, *_BODY_LEG, _POOL, _CAPPED(5), _ORDERED, f"""blocks AS (SELECT query_id, place, atom_id,
        CASE WHEN row_number() OVER (PARTITION BY query_id, document ORDER BY place) = 1 THEN '## ' || {_NEUTRAL("coalesce(nullif(split_part(heading_chain, ' > ', 1), ''), nullif(title, ''), regexp_extract(document, '([^/]+?)(?:\\.[^.]*)?$', 1))")} || ' — ' || {_NEUTRAL('document')} || chr(10) || chr(10) ELSE '' END
        || '[^' || atom_id || ']' || CASE WHEN origin_index IS NOT NULL AND origin_count IS NOT NULL THEN ' (' || (origin_index + 1) || '/' || origin_count || ')' ELSE '' END || chr(10) || {_NEUTRAL("coalesce(body, '')")} AS block,
        len(regexp_extract_all(coalesce(body, ''), '{_MARKER}')) + len(regexp_extract_all(coalesce(body, ''), '(?im)^[ \\t]*(?:System:|Assistant:|User:|Human:)')) AS n FROM ordered)""")
        + "SELECT query_id, md5('<<<KNOWLEDGE-PACK>>>' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY place) || chr(10) || '<<<END-KNOWLEDGE-PACK>>>') AS pack_md5, string_agg(atom_id, ' ' ORDER BY place) AS citations, sum(n)::BIGINT AS markers FROM blocks GROUP BY 1",
    "e_topic_metrics": sql.base(*_GOLDEN, _metrics_sql("ranking", 40)) + "SELECT query_id, " + ", ".join(f"round({m}, 9) AS {m}" for m in ev.METRICS) + " FROM metrics",
    "e_run_metrics": sql.base(_QRELS, _RUNS, _metrics_sql("hits", DEPTH, "hits")) + _macro_sql(keys="run_tag"),
    "e14_dataset_score": sql.base(*_GOLDEN, _metrics_sql("ranking", 40)) + _macro_sql(),
    "e13_strata": sql.base(*_GOLDEN, _metrics_sql("ranking", 40)) + "SELECT *, row_number() OVER (ORDER BY topics DESC, axis) AS place FROM (SELECT axis, count(*) AS topics, round(avg(ndcg10), 9) AS mean FROM metrics JOIN (SELECT DISTINCT query_id, axis FROM golden_queries WHERE trim(axis) <> '') USING (query_id) GROUP BY 1)",
    "e15_forensics": sql.base(*_GOLDEN, _metrics_sql("ranking", 40), "found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, rank) AS best FROM (SELECT query_id, rank, coalesce(grade, 0) AS g FROM ranking LEFT JOIN qrels USING (query_id, doc_id)))",
        f"per AS (SELECT query_id, {_DCG('rank')} AS dcg, {_DCG('best')} AS best_dcg, count(*) FILTER (g > 0) AS retrieved, min(rank) FILTER (g > 0) AS first_relevant_rank FROM found GROUP BY 1)",
        "done AS (SELECT query_id, n_relevant, coalesce(retrieved, 0) AS retrieved, round(coalesce(dcg, 0) / idcg, 9) AS ndcg, round(coalesce(best_dcg, 0) / idcg, 9) AS oracle_ndcg, first_relevant_rank FROM ideal_metrics LEFT JOIN per USING (query_id))",
    ) + "SELECT *, round(oracle_ndcg - ndcg, 9) AS ordering_loss, round(1 - oracle_ndcg, 9) AS recall_loss, retrieved < least(n_relevant, 10) AS recall_limited FROM done",
    "e33_legacy_ndcg": sql.base(*_GOLDEN, "found AS (SELECT query_id, rank, coalesce(grade > 0, false) AND rank <= 10 AS hit FROM ranking LEFT JOIN qrels USING (query_id, doc_id))")
        + "SELECT query_id, round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 9) AS ndcg FROM (SELECT query_id, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (hit) AS n FROM found GROUP BY 1)",
    "e16_gold_in_budget": sql.base(*_START, *_BODY_LEG, _POOL, _BUDGET, _QRELS) + """SELECT query_id, gold, coalesce(s.n, 0) AS gold_served, coalesce(k.n, 0) AS gold_kept, round((coalesce(t.n, 0) - coalesce(k.n, 0)) / nullif(coalesce(t.n, 0), 0), 9) AS noise
        FROM (SELECT query_id, count(*) AS gold FROM qrels GROUP BY 1)
        LEFT JOIN (SELECT l.query_id, count(*) AS n FROM leg_body l JOIN qrels q ON q.query_id = l.query_id AND q.doc_id = lower(l.atom_id) WHERE l.rank <= 10 GROUP BY 1) s USING (query_id)
        LEFT JOIN (SELECT l.query_id, count(*) AS n FROM kept l JOIN qrels q ON q.query_id = l.query_id AND q.doc_id = lower(l.atom_id) GROUP BY 1) k USING (query_id)
        LEFT JOIN (SELECT query_id, count(*) AS n FROM kept GROUP BY 1) t USING (query_id)""",
    "e21_gold_audit": sql.base(_QRELS, f"everything AS (SELECT DISTINCT {_REF('atom_id')} AS doc_id FROM atoms)", f"present AS (SELECT DISTINCT {_REF('atom_id')} AS doc_id FROM atoms WHERE removed_at IS NULL)",
        "orphans AS (SELECT doc_id FROM everything e WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.doc_id = e.doc_id))", "lost AS (SELECT * FROM qrels WHERE doc_id IN (SELECT doc_id FROM orphans))",
    ) + "SELECT (SELECT count(*) FROM orphans) AS orphans, (SELECT count(DISTINCT doc_id) FROM lost) AS judged_orphans, (SELECT count(*) FROM lost) AS lost_judgments, (SELECT count(DISTINCT query_id) FROM lost) AS affected_topics, (SELECT count(*) FROM qrels) AS judgments",
    "e22_collapsing_topics": sql.base(_QRELS, "gold AS (SELECT query_id, string_agg(doc_id, chr(10) ORDER BY doc_id) AS gold FROM qrels GROUP BY 1)") + "SELECT query_id, n_same FROM (SELECT query_id, count(*) OVER (PARTITION BY trim(query_text, ' '), gold) AS n_same FROM (SELECT DISTINCT query_id, query_text FROM golden_queries) JOIN gold USING (query_id)) WHERE n_same > 1",
    "e24_reachability": sql.base(_QRELS, f"present AS (SELECT DISTINCT {_REF('atom_id')} AS doc_id FROM atoms WHERE removed_at IS NULL)") + "SELECT sum(unreachable)::BIGINT AS unreachable, round(avg(ceiling), 9) AS recall_ceiling, count(*) AS topics FROM (SELECT query_id, count(p.doc_id) / count(*) AS ceiling, count(*) FILTER (p.doc_id IS NULL) AS unreachable FROM qrels LEFT JOIN present p USING (doc_id) GROUP BY 1)",
    "e34_random_recall": sql.base(sql.CORPUS) + "SELECT k, round(least(1.0, k / n), 9) AS recall FROM (SELECT count(*) AS n FROM corpus), (VALUES (10), (20), (100), (300), (1000)) x(k)",
    "e26_metric_delta": sql.base(_RUNS, "per AS (SELECT query_id, run_tag, min(run_at) AS run_at, round(avg(score), 9) AS mean_score FROM runs GROUP BY 1, 2)") + "SELECT query_id, run_tag, mean_score, round(mean_score - lag(mean_score) OVER (PARTITION BY query_id ORDER BY run_at, run_tag), 9) AS delta FROM per",
    "e27_regression_gate": sql.base(_QRELS, _RUNS, _metrics_sql("hits", DEPTH, "hits"), f"macro AS ({_macro_sql(keys='run_tag')})") + "SELECT run_tag, ndcg10, previous, CASE WHEN previous IS NULL THEN 'first' WHEN ndcg10 - previous >= -0.01 THEN 'pass' ELSE 'fail' END AS gate FROM (SELECT run_tag, ndcg10, lag(ndcg10) OVER (ORDER BY run_tag) AS previous FROM macro)",
    "e31_recall_curves": sql.base(*_GOLDEN, _metrics_sql("ranking", 40), f"macro AS ({_macro_sql()})") + " UNION ALL ".join(f"SELECT {k} AS k, recall{k} AS recall FROM macro" for k in ev.RECALL_DEPTHS),
    "e35_metric_disagreement": sql.base(*_START, *_TITLE, *_BODY_LEG, _QRELS, "ra AS (SELECT query_id, atom_id AS doc_id, rank FROM leg_title)", "rb AS (SELECT query_id, atom_id AS doc_id, rank FROM leg_body)", _metrics_sql("ra", 40, name="ma"), _metrics_sql("rb", 40, name="mb"),
        "longer AS (" + " UNION ALL ".join(f"SELECT query_id, '{m}' AS metric, a.{m} AS recorded, b.{m} AS recomputed FROM ma a JOIN mb b USING (query_id)" for m in ("ndcg10", "mrr10")) + ")") + "SELECT query_id, metric, round(recorded, 9) AS recorded, round(recomputed, 9) AS recomputed FROM longer WHERE abs(recorded - recomputed) > 1e-4",
}


def _deeper(query: str, depth: int) -> str:
    """A twin with its legs cut at another depth."""
    return query.replace(f"WHERE rank <= {LEG_DEPTH})", f"WHERE rank <= {depth})")


_DEEP_METRICS = (*(_deeper(c, EVAL_DEPTH) for c in _GOLDEN), _metrics_sql("ranking", EVAL_DEPTH))
ORACLES |= {
    "u6_fusion_grid_deep": _deeper(ORACLES["u6_fusion_grid"], EVAL_DEPTH),
    **{f"{name}_deep": _deeper(ORACLES[name], 100) for name in ("u8_rerank", "w3_cap_per_document", "w5_reading_order", "w15_pack")},
    "e_topic_metrics_deep": sql.base(*_DEEP_METRICS) + "SELECT query_id, " + ", ".join(f"round({m}, 9) AS {m}" for m in ev.METRICS) + " FROM metrics",
    "e14_dataset_score_deep": sql.base(*_DEEP_METRICS) + _macro_sql(),
    "e31_recall_curves_deep": sql.base(*_DEEP_METRICS, f"macro AS ({_macro_sql()})") + " UNION ALL ".join(f"SELECT {k} AS k, recall{k} AS recall FROM macro" for k in ev.RECALL_DEPTHS),
}

_RAND = """(SELECT i, topic, diff, n, xor(t2, t2 >> 14) / 4294967296.0 AS u FROM (SELECT *, xor((t + ((xor(t, t >> 7)::HUGEINT * (t | 61)) % 4294967296)::BIGINT) & 4294967295, t) AS t2 FROM (
  SELECT *, ((xor(a, a >> 15)::HUGEINT * (a | 1)) % 4294967296)::BIGINT AS t FROM (SELECT i, topic, diff, n, ({seed} + ({stride}::HUGEINT * (i * n + topic) % 4294967296)::BIGINT) & 4294967295 AS a FROM {source}))))"""


def _draws_sql(metrics: tuple[str, ...]) -> str:
    """The paired statistics of mb minus ma for each metric, with the generator written out in integers."""
    rand = lambda seed: _RAND.format(seed=seed, stride=sg.STRIDE, source="(SELECT i, topic, CAST(NULL AS DOUBLE) AS diff, n FROM its, (SELECT topic FROM numbered), (SELECT count(*) AS n FROM numbered))")
    longer = " UNION ALL ".join(f"SELECT topic, '{m}' AS metric, {m} AS diff FROM numbered" for m in metrics)
    return ",\n".join((
        "numbered AS (SELECT row_number() OVER (ORDER BY query_id) - 1 AS topic, " + ", ".join(f"round(b.{m}, 9) - round(a.{m}, 9) AS {m}" for m in metrics) + " FROM ma a JOIN mb b USING (query_id))",
        f"its AS (SELECT unnest(range({sg.ITERATIONS})) AS i)", f"longer AS ({longer})", "means AS (SELECT metric, count(*) AS topics, avg(diff) AS mean_difference FROM longer GROUP BY 1)",
        f"signs AS (SELECT i, topic, u < 0.5 AS flip FROM {rand(sg.PERMUTATION_SEED)})",
        "flipped AS (SELECT metric, i, sum(CASE WHEN flip THEN -diff ELSE diff END) / (SELECT count(*) FROM numbered) AS m FROM signs JOIN longer USING (topic) GROUP BY 1, 2)",
        f"tested AS (SELECT metric, topics, mean_difference, (count(*) FILTER (abs(m) >= abs(mean_difference) - 1e-12) + 1) / {sg.ITERATIONS + 1}.0 AS p_value FROM flipped JOIN means USING (metric) GROUP BY 1, 2, 3)",
        f"picks AS (SELECT i, least(n - 1, floor(u * n))::BIGINT AS topic FROM {rand(sg.BOOTSTRAP_SEED)})",
        "resampled AS (SELECT metric, i, sum(diff) / (SELECT count(*) FROM numbered) AS m FROM picks JOIN longer USING (topic) GROUP BY 1, 2)",
        f"spread AS (SELECT metric, list_sort(list(m)) AS ms FROM resampled GROUP BY 1)",
        f"paired AS (SELECT metric, topics, mean_difference, p_value, ms[{int(0.025 * (sg.ITERATIONS - 1) + 0.5) + 1}] AS ci_low, ms[{int(0.975 * (sg.ITERATIONS - 1) + 0.5) + 1}] AS ci_high FROM tested JOIN spread USING (metric))",
    ))


_PAIR = (*_START, *_TITLE, *_LINEAR, _QRELS, "ra AS (SELECT query_id, atom_id AS doc_id, rank FROM leg_title)", "rb AS (SELECT query_id, atom_id AS doc_id, rank FROM leg_linear)", _metrics_sql("ra", 40, name="ma"), _metrics_sql("rb", 40, name="mb"))
_CROSS_THERE = tuple(m for m in sg.CROSS_METRICS if m != "recall100")
_RECALL = "coalesce(len(list_filter(found, lambda x: list_contains(g, x))), 0) / len(g)"
_VECTORS = lambda name, source, key, text: f"""{name} AS (SELECT {key}, list(v ORDER BY slot) AS e FROM (SELECT {key}, slot, coalesce(v, 0.0) AS v FROM (SELECT DISTINCT {key}, unnest(range(64)) AS slot FROM th_{name}) LEFT JOIN
  (SELECT {key}, h % 64 AS slot, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM th_{name} GROUP BY 1, 2) USING ({key}, slot)) GROUP BY 1)"""  # noqa: E731
_HASHED = lambda name, source, key, text: f"th_{name} AS (SELECT {key}, ('0x' || left(md5(t), 8))::BIGINT AS h FROM (SELECT {key}, unnest({sql.tok(text)}) AS t FROM {source}))"
_DENSE = (
    _HASHED("av", "corpus", "atom_id", "body"), _VECTORS("av", "corpus", "atom_id", "body"), _HASHED("qv", "queries", "query_id", "query_text"), _VECTORS("qv", "queries", "query_id", "query_text"),
    "near AS (SELECT query_id, atom_id, round(list_cosine_similarity(qv.e, av.e), 9) AS score FROM qv, av WHERE list_max(list_transform(qv.e, lambda x: abs(x))) > 0 AND list_max(list_transform(av.e, lambda x: abs(x))) > 0)", sql.ranked("near", LEG_DEPTH, "leg_dense"),
)
_LATE = lambda name, where: f"""{name} AS (SELECT run_tag, query_id, doc_id, row_number() OVER (PARTITION BY run_tag, query_id ORDER BY rank, doc_id) AS rank FROM (SELECT run_tag, query_id, doc_id, min(rank) AS rank FROM (
  SELECT run_tag, query_id, {_REF('atom_id')} AS doc_id, rank_no AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_tag, query_id, rank_no ORDER BY loaded_at DESC, hit_no DESC) AS rn FROM run_hits WHERE run_tag IS NOT NULL{where}) WHERE rn = 1) WHERE doc_id IS NOT NULL GROUP BY 1, 2, 3))"""  # noqa: E731

ORACLES |= {
    "e26_ndcg_delta": sql.base(_QRELS, _RUNS, _metrics_sql("hits", DEPTH, "hits"), "began AS (SELECT run_tag, min(run_at) AS run_at FROM runs GROUP BY 1)", "nd AS (SELECT run_tag, query_id, round(ndcg10, 9) AS ndcg10, run_at FROM metrics JOIN began USING (run_tag))")
        + "SELECT run_tag, query_id, ndcg10, round(ndcg10 - lag(ndcg10) OVER (PARTITION BY query_id ORDER BY run_at, run_tag), 9) AS delta FROM nd",
    "e18_significance": sql.base(*_PAIR, _draws_sql(("ndcg10",))) + "SELECT topics, mean_difference, p_value, ci_low, ci_high FROM paired",
    "e40_cross_pairs": sql.base(*_PAIR, _draws_sql(_CROSS_THERE)) + f"SELECT metric, topics, round(mean_difference, 9) AS mean_difference, round(p_value, 9) AS p_value, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, p_value < 0.05 AS significant FROM (VALUES {', '.join(chr(40) + repr(m) + chr(41) for m in sg.CROSS_METRICS)}) v(metric) LEFT JOIN paired USING (metric)",
    "e35_late_loads": sql.base(_QRELS, "every AS (SELECT DISTINCT run_tag, query_id FROM run_hits WHERE run_tag IS NOT NULL)", _LATE("ra", " AND loaded_at <= run_at + INTERVAL 7 DAY"), _LATE("rb", ""), _metrics_sql("ra", DEPTH, "every", "ma"), _metrics_sql("rb", DEPTH, "every", "mb"),
        "longer AS (" + " UNION ALL ".join(f"SELECT a.query_id || '@' || a.run_tag AS query_id, '{m}' AS metric, a.{m} AS recorded, b.{m} AS recomputed FROM ma a JOIN mb b ON a.query_id = b.query_id AND a.run_tag = b.run_tag" for m in ("ndcg10", "mrr10")) + ")")
        + "SELECT query_id, metric, round(recorded, 9) AS recorded, round(recomputed, 9) AS recomputed FROM longer WHERE abs(recorded - recomputed) > 1e-4",
    "e22_collapsing_run_topics": sql.base(_QRELS, "gold AS (SELECT query_id, string_agg(doc_id, chr(10) ORDER BY doc_id) AS gold FROM qrels GROUP BY 1)", "asked AS (SELECT DISTINCT run_tag, query_id FROM run_hits WHERE run_tag IS NOT NULL)")
        + "SELECT query_id, n_same FROM (SELECT query_id || '@' || run_tag AS query_id, count(*) OVER (PARTITION BY trim(query_text, ' '), gold) AS n_same FROM asked JOIN (SELECT DISTINCT query_id, query_text FROM golden_queries) USING (query_id) JOIN gold USING (query_id)) WHERE n_same > 1",
    "e17_engine_metrics": sql.base(*_START, *_LINEAR, f"gg AS (SELECT DISTINCT ON (query_id) query_id, list_distinct(list_filter(list_transform(coalesce(relevant_atom_ids, []), lambda v: {_REF('v')}), lambda x: x IS NOT NULL)) AS g FROM golden_queries)",
        "ff AS (SELECT query_id, count(*) AS retrieved, list(atom_id ORDER BY rank) FILTER (rank <= 10) AS found, list(atom_id ORDER BY rank) AS every FROM leg_linear GROUP BY 1)",
        "mm AS (SELECT query_id, coalesce(retrieved, 0) AS retrieved, CASE WHEN len(g) > 0 THEN " + _RECALL + " END AS recall, CASE WHEN len(g) > 0 THEN coalesce(1 / list_min(list_filter(list_transform(g, lambda x: list_position(every, x)), lambda p: p > 0)), 0) END AS rr FROM gg LEFT JOIN ff USING (query_id))",
    ) + "SELECT query_id, retrieved, round(recall, 9) AS recall, round(rr, 9) AS reciprocal_rank FROM mm",
    "r10_dense_leg": sql.base(*_START, *_DENSE) + "SELECT query_id, atom_id, score, rank FROM leg_dense",
    "r11_hybrid": sql.base(*_START, *_BODY_LEG, *_DENSE, "fused AS (SELECT query_id, atom_id, a.rank AS r1, b.rank AS r2, round(coalesce(0.5 / (20 + a.rank), 0) + coalesce(0.5 / (20 + b.rank), 0), 12) AS score FROM leg_body a FULL JOIN leg_dense b USING (query_id, atom_id))")
        + "SELECT * FROM (" + _FUSED.format(nulls="ASC NULLS LAST") + ") WHERE rank <= 10",
    "u5_served_fusion": sql.base(*_START, *_LINEAR, *_BODY_LEG, "scores AS (SELECT query_id, atom_id, round(sum(0.5 / (20 + rank)), 12) AS score FROM (SELECT query_id, atom_id, rank FROM leg_linear UNION ALL SELECT query_id, atom_id, rank FROM leg_body) GROUP BY 1, 2)", sql.ranked("scores", 10)) + "SELECT query_id, atom_id, score, rank FROM ranked",
    "f3_default_exclusion": sql.base(sql.CORPUS) + "SELECT atom_id, atom_type FROM corpus WHERE atom_type IN (" + ", ".join(f"'{t}'" for t in PROFILE.types if t not in PROFILE.excluded_types) + ")",
    "w7_reserved_budget": sql.base(*_START, *_BODY_LEG, _POOL, _BUDGET.replace("<= 8000", "<= 7500")) + "SELECT query_id, atom_id, rank, cost, used + 500 AS used FROM kept",
}
ORACLES["e17_engine_summary"] = f"SELECT round(avg(recall), 9) AS recall, round(avg(reciprocal_rank), 9) AS mrr, count(recall) AS scored, count(*) FILTER (recall IS NULL) AS unscorable FROM ({ORACLES['e17_engine_metrics']})"
ORACLES["r17_best_cell"] = sql.base(sql.CORPUS, sql.QUERIES, sql.INDEX, sql.QTERMS, _QRELS, "grid AS (SELECT k1, b FROM (VALUES (0.9::DOUBLE), (1.2), (1.5)) x(k1), (VALUES (0.4::DOUBLE), (0.75)) y(b))",
    """scores AS (SELECT k1, b, query_id, atom_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * (k1 + 1.0) / (tf + k1 * (1 - b + b * doc_len / avg_len)))), 9) AS score
    FROM qterms JOIN postings USING (term) JOIN df USING (term) JOIN docs USING (atom_id) CROSS JOIN stats CROSS JOIN grid GROUP BY 1, 2, 3, 4)""",
    sql.ranked(k=10, keys="k1, b, query_id"), "hits AS (SELECT k1 || ' ' || b AS run_tag, query_id, atom_id AS doc_id, rank FROM ranked)", "every AS (SELECT k1 || ' ' || b AS run_tag, query_id FROM grid, (SELECT DISTINCT query_id FROM qrels))", _metrics_sql("hits", 10, "every"),
) + "SELECT split_part(run_tag, ' ', 1)::DOUBLE AS k1, split_part(run_tag, ' ', 2)::DOUBLE AS b, round(avg(ndcg10), 9) AS ndcg10, count(*) AS topics FROM metrics GROUP BY 1, 2 ORDER BY 3 DESC, 2, 1 LIMIT 1"
