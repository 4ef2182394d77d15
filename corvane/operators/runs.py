"""Comparison of runs by their recorded provenance, artefact inventory, enrichment quality and build health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Fields of a run's history row that set its scale (a difference makes runs incomparable), and those that name the treatment.
SCALE_FIELDS = ("atomMaxChars", "depth", "rerankPool", "corpusBytes", "corpusLines", "atomCount")
TREATMENT_FIELDS = (
    "adapter", "rerank", "rerankProfile", "rerankWeight", "rerankModel", "rerankDocMaxChars", "rerankExtract", "hybridWeight", "tokenBudget", "servedK", "embedModel", "analyzer", "fieldWeights",
    "enrichment", "bodySource", "keywordFilter", "enrichmentColumns", "queryAdjacency", "provenanceMerge", "prf", "prfDocs", "prfTerms", "prfAlpha", "fuseLegs", "typeFilter",
)
#: Fields that mean something only in a run that reranks, or that expands queries.
RERANK_ONLY = ("rerankPool", "rerankProfile", "rerankWeight", "rerankModel", "rerankDocMaxChars", "rerankExtract")
PRF_ONLY = ("prfDocs", "prfTerms", "prfAlpha")


def changed_fields(previous: dict, latest: dict, defaults: dict | None = None) -> list[dict]:
    """[{field, kind, before, after}] of two history rows. A field that a row lacks has its default; one that does not apply to either run is not compared."""
    value = lambda row, f: row[f] if row.get(f) is not None else (defaults or {}).get(f)
    on = lambda f: bool(value(previous, f)) or bool(value(latest, f))
    out = []
    for f in (*SCALE_FIELDS, *TREATMENT_FIELDS):
        if (f in RERANK_ONLY and not on("rerank")) or (f in PRF_ONLY and not on("prf")):
            continue
        before, after = value(previous, f), value(latest, f)
        if before != after:
            out.append({"field": f, "kind": "scale" if f in SCALE_FIELDS else "treatment", "before": before, "after": after})
    return out



def long_form(history: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys..., field, value) of each row's fields, as strings."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    return history.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.field", "p.value")


def provenance_diff(history: DataFrame, fields: list[str], defaults: dict[str, str] | None = None, scale: tuple[str, ...] = SCALE_FIELDS) -> DataFrame:
    """(dataset, run_at, field, kind, before, after): what changed between each run and the one before it of its dataset.

    kind is 'scale' or 'treatment'. A field that an old row lacks has its default. history: dataset, run_at, and the fields.
    """
    fill = defaults or {}
    rows = history.withColumns({f: F.coalesce(F.col(f).cast("string"), F.lit(fill.get(f))) for f in fields})
    w = Window.partitionBy("dataset").orderBy("run_at")
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.lag(f).over(w).alias("before"), F.col(f).alias("after")) for f in fields))
    both = rows.withColumn("n", F.row_number().over(w)).withColumn("pairs", pairs).where("n > 1").select("dataset", "run_at", F.explode("pairs").alias("p")).select("dataset", "run_at", "p.*")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("kind", F.when(F.col("field").isin(*scale), "scale").otherwise("treatment")).select("dataset", "run_at", "field", "kind", "before", "after")


def metric_deltas(history: DataFrame, metrics: list[str], tolerance: float = 0.01) -> DataFrame:
    """(dataset, run_at, <metric>_delta..., gate): against the run before; null if either lacks the metric; the gate is on the first metric."""
    w = Window.partitionBy("dataset").orderBy("run_at")
    out = history.select("dataset", "run_at", *((F.col(m) - F.lag(m).over(w)).alias(f"{m}_delta") for m in metrics))
    return out.withColumn("gate", F.when(F.col(f"{metrics[0]}_delta").isNull(), "first").when(F.col(f"{metrics[0]}_delta") >= -tolerance, "pass").otherwise("fail"))


def select_run(history: DataFrame, part: str) -> DataFrame:
    """The one run whose path contains part; none or several are refused."""
    found = history.where(F.col("path").contains(part))
    n = found.select("path").distinct().limit(2).count()
    if n != 1:
        raise ValueError(f"{part!r} names {'no run' if n == 0 else 'several runs'}")
    return found


def artefact_inventory(history: DataFrame, files: DataFrame, tolerance_seconds: int = 60) -> DataFrame:
    """(path, run_at, length, verdict): each recorded artefact against the file there: missing, ok, older or newer."""
    gap = F.unix_timestamp("modificationTime") - F.unix_timestamp("run_at")
    verdict = F.when(F.col("length").isNull(), "missing").when(gap < -tolerance_seconds, "older").when(gap > tolerance_seconds, "newer").otherwise("ok")
    return history.select("path", "run_at").join(files.select("path", "length", "modificationTime"), "path", "left").select("path", "run_at", "length", verdict.alias("verdict"))


# The quality gate of enrichment.
SHORT_WORDS, QUESTIONS_LOW, QUESTIONS_HIGH, KEYWORDS, RUN_LIMIT, OFFENDERS_PER_100 = 25, 12, 15, 10, 8, 12


@F.pandas_udf(T.IntegerType())
def longest_shared_run(a, b):
    """Length of the longest run of equal neighbouring terms of two term arrays."""
    import pandas as pd

    def one(x, y) -> int:
        best, row = 0, {}
        where: dict = {}
        for j, t in enumerate(y if y is not None else []):
            where.setdefault(t, []).append(j)
        for t in x if x is not None else []:
            row = {j: row.get(j - 1, 0) + 1 for j in where.get(t, ())}
            best = max(best, *row.values()) if row else best
        return best

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")


def enrichment_quality(records: DataFrame, terms) -> DataFrame:
    """Per record (atom_id): empty_field, long_short, bad_questions, bad_keywords, shared_run with the body's first two sentences, generality, strict and partial novel keywords.

    records: atom_id, body, short_desc, long_desc, doc_description, keywords, entities, questions. terms: the analyzer, a Column -> Column of terms.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    any_blank = lambda c: F.coalesce(F.exists(c, lambda x: x.isNull() | (F.trim(x) == "")), F.lit(False))
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    empty = blank("short_desc") | blank("long_desc") | blank("doc_description") | (count("keywords") <= 0) | (count("questions") <= 0) | any_blank("keywords") | any_blank("entities") | any_blank("questions")
    words = F.size(F.filter(F.split(F.trim(F.coalesce("short_desc", F.lit(""))), r"\s+"), lambda w: w != ""))
    opening = F.array_join(F.slice(F.split(F.trim(F.coalesce("body", F.lit(""))), r"(?<=[.!?])\s+"), 1, 2), " ")
    general = F.coalesce(F.col("short_desc"), F.lit("")).rlike(r"(?i)\b(this|the)\s+(document|fragment|text|passage|article|section)\b")
    kw = F.array_compact(F.coalesce("keywords", F.array().cast("array<string>")))
    rows = records.select(
        "atom_id", empty.alias("empty_field"), (words > SHORT_WORDS).alias("long_short"), ~count("questions").between(QUESTIONS_LOW, QUESTIONS_HIGH), (count("keywords") != KEYWORDS).alias("bad_keywords"),
        longest_shared_run(terms(F.coalesce("long_desc", F.lit(""))), terms(opening)).alias("shared_run"), general.alias("generality"), kw.alias("kw"), terms(F.coalesce("body", F.lit(""))).alias("bt"),
    ).toDF("atom_id", "empty_field", "long_short", "bad_questions", "bad_keywords", "shared_run", "generality", "kw", "bt")
    strict = F.size(F.filter("kw", lambda k: F.size(F.array_intersect(terms(k), F.col("bt"))) == 0))
    partial = F.size(F.filter("kw", lambda k: F.size(F.array_except(terms(k), F.col("bt"))) > 0))
    return rows.withColumn("strict_novel", strict).withColumn("partial_novel", partial).withColumn("n_keywords", F.size("kw")).drop("kw", "bt")


def quality_gate(quality: DataFrame) -> DataFrame:
    """One row: totals, near-verbatim and general records against the scaled limit, novelty ratios (null without keywords)."""
    limit = F.count("*") * (OFFENDERS_PER_100 / 100)
    verbatim, general = F.count_if(F.col("shared_run") >= RUN_LIMIT), F.count_if("generality")
    total = F.sum("n_keywords")
    return quality.agg(
        F.count("*").alias("records"), F.count_if("empty_field").alias("empty_fields"), F.count_if("long_short").alias("long_shorts"), F.count_if("bad_questions").alias("bad_questions"), F.count_if("bad_keywords").alias("bad_keywords"),
        verbatim.alias("verbatim"), (verbatim < limit).alias("verbatim_pass"), general.alias("general"), (general < limit).alias("general_pass"),
        F.round(F.try_divide(F.sum("strict_novel").cast("double"), total), 9).alias("strict_novelty"), F.round(F.try_divide(F.sum("partial_novel").cast("double"), total), 9).alias("partial_novelty"),
    )


def build_health(census: DataFrame, merged: Column, empty_bodies: Column, total: Column) -> DataFrame:
    """The echo rate of offered keywords, null when none was offered, and whether the build failed altogether. census: one row (kept, dropped, ...)."""
    return census.withColumn("echo_rate", F.try_divide(F.col("dropped").cast("double"), F.col("kept") + F.col("dropped"))).withColumn("failed", (merged == 0) | (empty_bodies == total))
