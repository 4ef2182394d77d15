"""Retrieval metrics over (query_id, rank, doc_id) and (query_id, doc_id, grade): one pass for all topics and all depths.

Metrics follow the topics of the judgments: a topic without results scores zeros. A metric whose depth exceeds the run's is null, and an
average over topics of which any is null is null (mean_if_all), unlike avg().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECALL_DEPTHS = (10, 20, 100, 300, 1000)
PRECISION_DEPTHS = (5, 10)
RBP_P = 0.8
METRICS = ("ndcg10", *(f"recall{k}" for k in RECALL_DEPTHS), "mrr10", *(f"precision{k}" for k in PRECISION_DEPTHS), "all_gold_in_top10", "average_precision", "r_precision", "rbp_residual")


def clean_ranking(hits: DataFrame, keys: list[str], id_col: str = "doc_id") -> DataFrame:
    """Dense ranks in which each document stands once, at its first occurrence."""
    first = hits.where(F.col(id_col).isNotNull()).groupBy(*keys, id_col).agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("rank", id_col)))


def judged(ranking: DataFrame, qrels: DataFrame, keys: list[str]) -> DataFrame:
    """The ranking with grade (null where unjudged). A repeated judgment counts with its greatest grade."""
    return ranking.join(qrels.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade")), ["query_id", "doc_id"], "left")


def ideal(qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, n_relevant, idcg) of each topic: the best order of all relevant documents, down to k."""
    graded = qrels.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
    ranked = graded.withColumn("place", place)
    gain = F.when((F.col("grade") > 0) & (F.col("place") <= k), F.col("grade") / F.log2(F.col("place") + 1)).otherwise(0.0)
    return ranked.groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("n_relevant"), F.sum(gain).alias("idcg"))


def topic_metrics(ranking: DataFrame, qrels: DataFrame, depth: int, topics: DataFrame | None = None, k: int = 10, judged_only: bool = False) -> DataFrame:
    """One row of METRICS for each topic of qrels, or for each (run_tag, query_id) of topics that qrels judge.

    ranking: ([run_tag,] query_id, doc_id, rank) with dense ranks; depth: the depth the run was made to. grade <= 0 is not relevant, an
    unjudged document has no grade. Average precision runs over the whole ranking. judged_only: the ranking has only the judged
    documents of a dense one, at their ranks in it, to any depth.
    """
    keys = ["run_tag", "query_id"] if topics is not None else ["query_id"]
    found = judged(ranking, qrels, keys)
    best = ideal(qrels, k)
    asked = best if topics is None else topics.select(*keys).distinct().join(best, "query_id")
    # The number of relevant documents is needed inside the sums, so the topic side comes first.
    rows = asked.join(found, keys, "left")
    relevant = F.coalesce(F.col("grade") > 0, F.lit(False))
    hits_so_far = F.sum(F.when(relevant, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("relevant", relevant).withColumn("hits", hits_so_far)
    at = lambda n: F.count_if(F.col("relevant") & (F.col("rank") <= n))
    agg = rows.groupBy(*keys, "n_relevant", "idcg").agg(
        F.sum(F.when(F.col("relevant") & (F.col("rank") <= k), F.col("grade") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        *(at(n).alias(f"hits{n}") for n in sorted({*RECALL_DEPTHS, *PRECISION_DEPTHS})),
        F.min(F.when(F.col("relevant") & (F.col("rank") <= 10), F.col("rank"))).alias("first_rank"),
        F.sum(F.when(F.col("relevant"), F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        F.count_if(F.col("relevant") & (F.col("rank") <= F.col("n_relevant"))).alias("hits_r"),
        F.sum(F.when(F.col("rank").isNotNull() & F.col("grade").isNull(), F.pow(F.lit(RBP_P), F.col("rank") - 1)).otherwise(0.0)).alias("unjudged"),
        F.sum(F.when(F.col("rank").isNotNull() & F.col("grade").isNotNull(), F.pow(F.lit(RBP_P), F.col("rank") - 1)).otherwise(0.0)).alias("judged"),
        F.count("rank").alias("n_ranked"),
    )
    r = F.col("n_relevant")
    share = lambda x: F.when(r > 0, x / r).otherwise(0.0)
    null = F.lit(None).cast("double")
    return agg.select(
        *keys,
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg10"),
        *((share(F.col(f"hits{n}")) if n <= depth else null).alias(f"recall{n}") for n in RECALL_DEPTHS),
        F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("mrr10"),
        *((F.col(f"hits{n}") / F.lit(n) if n <= depth else null).alias(f"precision{n}") for n in PRECISION_DEPTHS),
        (F.when((r > 0) & (F.col("hits10") == F.least(r, F.lit(10))), 1.0).otherwise(0.0) if depth >= 10 else null).alias("all_gold_in_top10"),
        share(F.col("ap_sum")).alias("average_precision"),
        F.when(r > depth, null).when(r == 0, 0.0).otherwise(F.col("hits_r") / r).alias("r_precision"),
        # All ranks without end weigh 1, so what is not judged weighs what the judged ones leave.
        (1 - (1 - RBP_P) * F.col("judged") if judged_only else (1 - RBP_P) * F.col("unjudged") + F.pow(F.lit(RBP_P), F.col("n_ranked"))).alias("rbp_residual"),
    )


def mean_if_all(column: str) -> Column:
    """The mean over all topics; null unless every topic has a value."""
    return F.when(F.count(column) == F.count("*"), F.avg(column))


def macro_metrics(topics: DataFrame, keys: list[str] | None = None, digits: int = 9) -> DataFrame:
    """Means over topics: mean_if_all, but r_precision over the topics that have it (with their number), and the spread of ndcg10 (0 for one topic)."""
    rounded = lambda c, name: F.round(c, digits).alias(name)
    means = [rounded(F.coalesce(F.avg("r_precision"), F.lit(0.0)) if m == "r_precision" else mean_if_all(m), m) for m in METRICS]
    return topics.groupBy(*(keys or [])).agg(F.count("*").alias("topics"), *means, F.count("r_precision").alias("r_precision_topics"), rounded(F.coalesce(F.stddev_samp("ndcg10"), F.lit(0.0)), "ndcg10_sd"))


def strata(topics: DataFrame, facets: DataFrame, metric: str = "ndcg10") -> DataFrame:
    """(axis, topics, mean) of the topics that have an axis, the largest stratum first by place."""
    rows = topics.join(facets.where("axis is not null and trim(axis) <> ''"), "query_id").groupBy("axis").agg(F.count("*").alias("topics"), F.round(F.avg(metric), 9).alias("mean"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("topics"), "axis")))  # as many rows as facet values


def forensics(ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Per topic: ndcg, the ndcg of the same documents in the best order, what order and recall cost, and the first relevant rank."""
    found = judged(ranking, qrels, ["query_id"]).withColumn("g", F.greatest(F.coalesce("grade", F.lit(0)), F.lit(0)))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("g"), "rank"))
    found = found.withColumn("best", best)
    gain = lambda place: F.sum(F.when(F.col(place) <= k, F.col("g") / F.log2(F.col(place) + 1)).otherwise(0.0))
    per = found.groupBy("query_id").agg(gain("rank").alias("dcg"), gain("best").alias("best_dcg"), F.count_if(F.col("g") > 0).alias("retrieved"), F.min(F.when(F.col("g") > 0, F.col("rank"))).alias("first_relevant_rank"))
    both = ideal(qrels, k).join(per, "query_id", "left")
    norm = lambda c: F.round(F.when(F.col("idcg") > 0, F.coalesce(c, F.lit(0.0)) / F.col("idcg")).otherwise(0.0), 9)
    out = both.select("query_id", "n_relevant", F.coalesce("retrieved", F.lit(0)).alias("retrieved"), norm(F.col("dcg")).alias("ndcg"), norm(F.col("best_dcg")).alias("oracle_ndcg"), "first_relevant_rank")
    return out.withColumns({"ordering_loss": F.round(F.col("oracle_ndcg") - F.col("ndcg"), 9), "recall_loss": F.round(1 - F.col("oracle_ndcg"), 9), "recall_limited": F.col("retrieved") < F.least(F.col("n_relevant"), F.lit(k))})


def legacy_ndcg(ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg): binary, its ideal being the retrieved documents in the best order, so gold that was not retrieved costs nothing."""
    hit = F.coalesce(F.col("grade") > 0, F.lit(False)) & (F.col("rank") <= k)
    found = judged(ranking, qrels, ["query_id"]).groupBy("query_id").agg(F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.count_if(hit).alias("n"))
    ideal_dcg = F.aggregate(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n").cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return found.select("query_id", F.round(F.when(F.col("n") > 0, F.col("dcg") / ideal_dcg).otherwise(0.0), 9).alias("ndcg"))


def document_rollup(hits: DataFrame, origins: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank): an atom's documents take consecutive ranks; each document keeps its first.

    hits: (query_id, atom_id, rank); origins: (atom_id, documents ARRAY).
    """
    each = hits.join(origins, "atom_id").select("query_id", "rank", F.posexplode("documents").alias("pos", "doc_id"))
    first = each.groupBy("query_id", "doc_id").agg(F.min(F.struct("rank", "pos")).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "doc_id"))).select("query_id", "doc_id", "rank")


def atom_spread(hits: DataFrame, depths: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Per query: distinct documents among the first n, and runs of neighbouring atoms of one document among the first 10; null below n atoms."""
    changed = F.lag("document").over(Window.partitionBy("query_id").orderBy("rank"))
    rows = hits.withColumn("new_run", F.when(changed.isNull() | (changed != F.col("document")), 1).otherwise(0))
    full = lambda n, x: F.when(F.count_if(F.col("rank") <= n) >= n, x)
    return rows.groupBy("query_id").agg(
        *(full(n, F.count_distinct(F.when(F.col("rank") <= n, F.col("document")))).alias(f"docs{n}") for n in depths),
        full(10, F.sum(F.when(F.col("rank") <= 10, F.col("new_run")))).alias("runs10"),
    )


def gold_audit(qrels: DataFrame, corpus: DataFrame, represented: DataFrame) -> DataFrame:
    """One row: documents no atom stands for, those of them that are judged, the judgments and topics lost, and all judgments."""
    orphans = corpus.select("doc_id").distinct().join(represented.select("doc_id").distinct(), "doc_id", "left_anti")
    lost = qrels.join(orphans, "doc_id", "left_semi")
    a = orphans.agg(F.count("*").alias("orphans"))
    b = lost.agg(F.count_distinct("doc_id").alias("judged_orphans"), F.count("*").alias("lost_judgments"), F.count_distinct("query_id").alias("affected_topics"))
    c = qrels.agg(F.count("*").alias("judgments"))
    return a.crossJoin(b).crossJoin(c)  # three rows of one


def soundness(documents: DataFrame, represented: DataFrame, least: float = 0.9) -> DataFrame:
    """One row: documents, represented, share, sound. Sound is an ingest that made atoms of at least this share of the documents."""
    marked = documents.select("doc_id").distinct().join(represented.select("doc_id").distinct().withColumn("there", F.lit(1)), "doc_id", "left")
    out = marked.agg(F.count("*").alias("documents"), F.count("there").alias("represented"))
    share = F.coalesce(F.try_divide(F.col("represented").cast("double"), F.col("documents")), F.lit(0.0))
    return out.withColumn("share", F.round(share, 9)).withColumn("sound", (share >= least) & (F.col("represented") > 0))


def duplicate_links(deduped: DataFrame) -> DataFrame:
    """(doc_id, survivor): documents that lost all their atoms as copies, and the document of the first surviving one. deduped: from ingest.dedupe_bodies()."""
    kept = deduped.where("survivor_id = atom_id").select(F.col("atom_id").alias("survivor_id"), F.col("document").alias("survivor"))
    alive = kept.select(F.col("survivor").alias("document")).distinct()
    gone = deduped.where("survivor_id <> atom_id").join(alive, "document", "left_anti")
    return gone.join(kept, "survivor_id").groupBy(F.col("document").alias("doc_id")).agg(F.min_by("survivor", "atom_id").alias("survivor"))


def repoint(qrels: DataFrame, links: DataFrame) -> DataFrame:
    """Judgments of dropped duplicates moved to the survivor; two judgments that meet keep the greater grade. links: (doc_id, survivor)."""
    return qrels.join(links, "doc_id", "left").groupBy("query_id", F.coalesce("survivor", "doc_id").alias("doc_id")).agg(F.max("grade").alias("grade"))


def collapsing_topics(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, n_same): topics with the same trimmed text and the same gold set as another one."""
    gold = qrels.where("grade > 0").groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("doc_id")), "\n").alias("gold"))
    rows = queries.select("query_id", F.trim("query_text").alias("q")).join(gold, "query_id")
    return rows.withColumn("n_same", F.count("*").over(Window.partitionBy("q", "gold"))).where("n_same > 1").select("query_id", "n_same")


def metric_disagreement(recorded: DataFrame, recomputed: DataFrame, metrics: tuple[str, ...], tolerance: float = 1e-4) -> DataFrame:
    """(query_id, metric, recorded, recomputed) that differ by more than tolerance; a metric that was not recorded agrees."""
    long = lambda df, name: df.select("query_id", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics))).alias("x")).select("query_id", "x.metric", f"x.{name}")
    both = long(recorded, "recorded").join(long(recomputed, "recomputed"), ["query_id", "metric"], "left")
    return both.where(F.col("recorded").isNotNull() & (F.coalesce(F.abs(F.col("recorded") - F.col("recomputed")), F.lit(float("inf"))) > tolerance))


# How closely a re-scored metric must agree with the recorded one in a forecast, and in forensics.
REPRODUCTION_TOLERANCE, AGREEMENT_TOLERANCE = 1e-9, 1e-4


def check_reproduction(recorded: DataFrame, recomputed: DataFrame, metric: str = "ndcg10", tolerance: float = REPRODUCTION_TOLERANCE) -> None:
    """Refuses a run whose recorded topics cannot be re-scored to the same value: names how many differ and the first of them."""
    off = metric_disagreement(recorded, recomputed, (metric,), tolerance)
    n = off.count()
    if n:
        first = off.orderBy("query_id").first()
        raise ValueError(f"{n} topics are not reproduced, among them {first.query_id}: {first.recorded} recorded, {first.recomputed} recomputed")


def random_recall(n_docs: int, depths: tuple[int, ...] = RECALL_DEPTHS) -> list[tuple[int, float]]:
    """(k, recall) a random ranking reaches: min(1, k / N)."""
    return [(k, min(1.0, k / n_docs) if n_docs else 0.0) for k in depths]


def engine_metrics(ranking: DataFrame, golden: DataFrame, k: int) -> DataFrame:
    """(query_id, retrieved, recall, reciprocal_rank) of each golden query: the share of its gold among the first k, and 1 / the first gold rank (0 without).

    ranking: (query_id, doc_id, rank); golden: (query_id, doc_ids ARRAY), nulls and repeats of which do not count. A query without gold has null metrics.
    """
    gold = golden.select("query_id", F.array_distinct(F.array_compact(F.coalesce("doc_ids", F.array().cast("array<string>")))).alias("g")).dropDuplicates(["query_id"])
    hits = ranking.join(gold, "query_id").groupBy("query_id").agg(
        F.count("*").alias("retrieved"), F.count_distinct(F.when((F.col("rank") <= k) & F.array_contains("g", F.col("doc_id")), F.col("doc_id"))).alias("found"), F.min(F.when(F.array_contains("g", F.col("doc_id")), F.col("rank"))).alias("first"),
    )
    rows = gold.join(hits, "query_id", "left")
    n = F.size("g")
    return rows.select("query_id", F.coalesce("retrieved", F.lit(0)).alias("retrieved"), F.when(n > 0, F.coalesce("found", F.lit(0)) / n).alias("recall"), F.when(n > 0, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"))


def engine_summary(metrics: DataFrame) -> DataFrame:
    """One row: recall and mrr over the queries that have gold, and how many have and have not."""
    return metrics.agg(F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("reciprocal_rank"), 9).alias("mrr"), F.count("recall").alias("scored"), F.count_if(F.col("recall").isNull()).alias("unscorable"))


def best_cell(cells: DataFrame, metric: str = "ndcg10") -> DataFrame:
    """One row: the cell (k1, b) of a sweep with the greatest mean of the metric, of equal ones that with the lower b, then the lower k1. cells: (k1, b, query_id, metric)."""
    means = cells.groupBy("k1", "b").agg(F.round(F.avg(metric), 9).alias(metric), F.count("*").alias("topics"))
    return means.orderBy(F.desc(metric), "b", "k1").limit(1)
