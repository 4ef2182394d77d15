"""Rank fusion and reranking over (query_id, doc, rank) relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import small

#: The rank constant, the shipped weight of the rerank leg, and the depth of a fused leg.
RRF_K = 20
RERANK_WEIGHT = 0.75
LEG_DEPTH = 100
#: Fixed value: how far two scores may differ and still tie.
TIE = 1e-9


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def fuse_rerank(first: DataFrame, reranked: DataFrame, weight: float = RERANK_WEIGHT, k: int = RRF_K, replace: bool = False) -> DataFrame:
    """(query_id, atom_id, score, rank) of a first pass (query_id, atom_id, rank) and a rerank of it (query_id, atom_id, rank).

    weight / (k + rerank rank) + (1 - weight) / (k + first rank); an item that the reranker did not return has the first-pass
    term only. replace: 1 / rerank rank, unreturned items behind all returned ones in first-pass order. Ties keep the first-pass order.
    """
    both = first.select("query_id", "atom_id", F.col("rank").alias("r1")).join(reranked.select("query_id", "atom_id", F.col("rank").alias("r2")), ["query_id", "atom_id"], "left")
    if replace:
        returned = F.count("r2").over(Window.partitionBy("query_id"))
        score = 1.0 / F.coalesce(F.col("r2"), returned + F.col("r1"))
    else:
        score = F.coalesce(F.lit(weight) / (k + F.col("r2")), F.lit(0.0)) + F.lit(1 - weight) / (k + F.col("r1"))
    return _ranked(both.withColumn("score", F.round(score, 12)), F.desc("score"), F.asc("r1")).select("query_id", "atom_id", "score", "rank")


def fuse_legs(lexical: DataFrame, dense: DataFrame, dense_weight: float = 0.5, k: int = RRF_K, leg_cut: int | None = None) -> DataFrame:
    """(query_id, atom_id, score, rank): reciprocal ranks of two legs, either of which may lack an item.

    Ties: the lexical order, then the order of the items that only the dense leg has. leg_cut keeps so many of each leg before fusing.
    """
    if leg_cut is not None:
        lexical, dense = lexical.where(F.col("rank") <= leg_cut), dense.where(F.col("rank") <= leg_cut)
    both = lexical.select("query_id", "atom_id", F.col("rank").alias("r1")).join(dense.select("query_id", "atom_id", F.col("rank").alias("r2")), ["query_id", "atom_id"], "full_outer")
    score = F.coalesce((1 - dense_weight) / (k + F.col("r1")), F.lit(0.0)) + F.coalesce(dense_weight / (k + F.col("r2")), F.lit(0.0))
    return _ranked(both.withColumn("score", F.round(score, 12)), F.desc("score"), F.asc_nulls_last("r1"), F.asc("r2")).select("query_id", "atom_id", "score", "rank")


def fuse_many(legs: DataFrame, weights: DataFrame, k: int = RRF_K, depth: int = LEG_DEPTH) -> DataFrame:
    """(fusion, query_id, atom_id, score, rank) of any number of weighted legs; ties by id.

    legs: (leg, query_id, atom_id, rank), weights: (fusion, leg, weight), a small table. Each leg counts down to depth, and a fused list is cut there.
    """
    scored = legs.where(F.col("rank") <= depth).join(small(weights), "leg").groupBy("fusion", "query_id", "atom_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 12).alias("score"))
    w = Window.partitionBy("fusion", "query_id").orderBy(F.desc("score"), "atom_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)


def fusion_grid(legs: list[str], weights: tuple[float, ...] = (0.3, 0.5, 0.7)) -> list[tuple[str, str, float]]:
    """(fusion, leg, weight): the first leg with each other one at each weight, and all legs alike."""
    rows = [(f"{legs[0]}*{w:g}+{other}*{round(1 - w, 6):g}", leg, x) for other in legs[1:] for w in weights for leg, x in ((legs[0], w), (other, round(1 - w, 6)))]
    return rows + [("uniform", leg, 1.0 / len(legs)) for leg in legs]


def head_to_head(a: DataFrame, b: DataFrame, value: str, tie: float = TIE) -> DataFrame:
    """One row: wins, losses and ties of a against b over the topics both have."""
    both = a.select("query_id", F.col(value).alias("x")).join(b.select("query_id", F.col(value).alias("y")), "query_id")
    diff = F.col("x") - F.col("y")
    return both.agg(F.count_if(diff > tie).alias("wins"), F.count_if(diff < -tie).alias("losses"), F.count_if(F.abs(diff) <= tie).alias("ties"))


def overlap_scorer(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's distinct terms that the text holds."""
    from corvane.functions.text import tokenize

    q = F.array_distinct(tokenize(F.coalesce(query, F.lit(""))))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokenize(F.coalesce(text, F.lit(""))))) / F.size(q)).otherwise(F.lit(0.0))


def rerank(pool: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_scorer, window: int = 2_000, strategy: str = "head") -> DataFrame:
    """(query_id, atom_id, rerank_score, rank) of a pool (query_id, query_text, atom_id, rank, body): scored by any Column function.

    A model server is called by a scorer that wraps an Arrow UDF; it then gets whole batches. Ties keep the pool's order.
    """
    from corvane.functions.text import extract_window

    scored = pool.withColumn("rerank_score", F.round(scorer(F.col("query_text"), extract_window(F.col("body"), strategy, window)), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return scored.select("query_id", "atom_id", "rerank_score", F.row_number().over(w).alias("rank"))


def calibrate(score: Column, kind: str = "sigmoid") -> Column:
    """A relevance in [0, 1]: identity or sigmoid; an identity value out of range is null."""
    return 1 / (1 + F.exp(-score)) if kind == "sigmoid" else F.when(score.between(0, 1), score)


def discrimination(scores: DataFrame, spread: float = 1e-6) -> DataFrame:
    """(query_id, verdict) of a probe (query_id, relevant_score, other_score): ok, degenerate, constant or inverted."""
    gap = F.col("relevant_score") - F.col("other_score")
    verdict = F.when(F.greatest(F.abs("relevant_score"), F.abs("other_score")) < spread, "degenerate").when(F.abs(gap) < spread, "constant").when(gap < 0, "inverted").otherwise("ok")
    return scores.select("query_id", verdict.alias("verdict"))
