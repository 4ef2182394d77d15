"""A mixture of sources in target shares of the total size, small sources repeated up to a cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import clean_label
from corvane.session import cut, salted_join

SEED = 17
#: Denominator of the hash-seeded draw.
DRAW = 1 << 30


def source_rates(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, source_tokens, total_tokens, rate) of each source with a target.

    sizes: (source, n_tokens). Shares are taken relative to the targets that have any tokens, as a source without text
    cannot contribute. Without `total`, the mixture is as large as it can be with every share met and no cap
    exceeded; with it, a source whose rate would exceed its cap stays at the cap, and its actual share falls short.
    A null, zero or negative share or cap keeps the source out (rate 0). A source named twice is taken with its
    largest share and smallest cap.
    """
    goal = targets.groupBy(clean_label(F.col("source")).alias("source")).agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    tokens = sizes.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    both = goal.join(tokens, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    usable = (F.col("source_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    whole = both.where(usable).agg(F.sum("target_share").alias("share_sum"), F.min(F.col("max_repeats") * F.col("source_tokens") / F.col("target_share")).alias("room"))
    size = F.lit(float(total)) if total is not None else F.col("room") * F.col("share_sum")
    wanted = size * F.col("target_share") / F.col("share_sum")
    rate = F.when(usable, F.least(wanted / F.col("source_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    # `whole` is one row.
    return both.crossJoin(F.broadcast(whole)).select("source", "target_share", "max_repeats", "source_tokens", size.alias("total_tokens"), rate.alias("rate"))


def mix(sized: DataFrame, rates: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    """(id, source, copy_no, n_tokens): each document floor(rate) times and once more with probability rate - floor(rate).

    The extra copy is drawn by a hash of seed and id, so the mixture is the same on every run and layout. Documents
    with no target source are left out; empty documents are kept, they weigh nothing. No document exceeds its cap: the rate does not.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(DRAW)) / float(DRAW)
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    joined = salted_join(sized.select(id_col, "source", "n_tokens"), rates.select("source", "rate"), "source", "inner")
    return joined.withColumn("copies", copies.cast("int")).where("copies > 0").select(id_col, "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")


def mix_report(mixture: DataFrame, rates: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, rate, max_repeats, source_tokens, mixed_tokens, n_copies) of each source with a target."""
    made = mixture.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("n_copies"))
    rows = rates.join(made, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0))).withColumn("n_copies", F.coalesce("n_copies", F.lit(0)))
    whole = rows.agg(F.sum("mixed_tokens").alias("whole"))
    return rows.crossJoin(F.broadcast(whole)).select(
        "source", "target_share", F.try_divide(F.col("mixed_tokens").cast("double"), F.col("whole").cast("double")).alias("actual_share"), "rate", "max_repeats", "source_tokens", "mixed_tokens", "n_copies",
    )


def sized_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, n_tokens) of each different text of a source, checkpointed: the mixture needs the sizes twice, the tokenizer runs once.

    A text that comes again under other doc_ids of its source stands once, under the smallest, so that the cap on repeats
    holds for the text. Documents without a text stay apart.
    """
    from corvane.llm.tokens import with_token_counts

    key = F.coalesce(F.md5("text"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    rows = docs.select("doc_id", clean_label(F.col("source")).alias("source"), key.alias("text_key"), F.col("text").alias("_text"))
    counted = with_token_counts(rows, F.col("_text"), tokenizer)
    return cut(counted.groupBy("source", "text_key").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens")).select("doc_id", "source", "n_tokens"))
