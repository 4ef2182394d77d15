"""From ranked atoms to what is delivered: filters, caps per document, reading order, byte budget, confidence, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text as tx

#: Atoms of one document, pool floor, and the least calibrated relevance of a confident answer.
MAX_PER_DOC = 2
POOL_FLOOR = 100
CONFIDENCE_FLOOR = 0.4
#: The lines a pack opens and closes with.
PACK_OPEN, PACK_CLOSE = "<<<KNOWLEDGE-PACK>>>", "<<<END-KNOWLEDGE-PACK>>>"


def member_of(column: str, allowed: list[str] | None) -> Column:
    """Membership; None passes all, an empty list is refused."""
    if allowed is None:
        return F.lit(True)
    if not allowed:
        raise ValueError(f"an empty list of {column} would pass nothing: leave the filter out instead")
    return F.col(column).isin(*allowed)


def is_retrievable(as_of: str) -> Column:
    """Not deprecated and not stale before as_of (YYYY-MM-DD); a stale_after that is no ISO date does not count."""
    iso = F.col("stale_after").rlike(r"^\d{4}-\d{2}-\d{2}$")
    return ~F.coalesce(F.lower(F.trim("status")) == "deprecated", F.lit(False)) & ~F.coalesce(iso & (F.col("stale_after") < as_of), F.lit(False))


def known_type(column: str, known: list[str], default: str) -> Column:
    """A type outside the vocabulary becomes the default; no row is dropped."""
    return F.when(F.col(column).isin(*known), F.col(column)).otherwise(F.lit(default))


def pool_size(k: int, max_per_doc: int | None, rerank_pool: int | None = None) -> int:
    n = k if not max_per_doc else max(k * max_per_doc, POOL_FLOOR)
    return max(n, rerank_pool) if rerank_pool else n


def cap_per_document(ranked: DataFrame, n: int = MAX_PER_DOC) -> DataFrame:
    """The first n atoms of each document in rank order; 0 or less is no cap. ranked: query_id, document, rank."""
    if n <= 0:
        return ranked
    w = Window.partitionBy("query_id", "document").orderBy("rank")
    return ranked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def renumber(ranked: DataFrame, k: int | None = None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("rank")
    out = ranked.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def reading_order(ranked: DataFrame) -> DataFrame:
    """Adds place: documents by their best rank, inside by origin_index, atoms without one last in rank order."""
    best = F.min("rank").over(Window.partitionBy("query_id", "document"))
    w = Window.partitionBy("query_id").orderBy("best", F.asc_nulls_last("origin_index"), "rank")
    return ranked.withColumn("best", best).withColumn("place", F.row_number().over(w)).drop("best")


def relevance_floor(ranked: DataFrame, floor: float) -> DataFrame:
    """Keeps atoms with relevance of at least floor, and counts what the query lost: below_floor and unscored."""
    w = Window.partitionBy("query_id")
    counted = ranked.withColumn("below_floor", F.count_if(F.col("relevance") < floor).over(w)).withColumn("unscored", F.count_if(F.col("relevance").isNull()).over(w))
    return counted.where(F.col("relevance") >= floor)


def fit_budget(ranked: DataFrame, cost: Column, limit: int, overhead: int = 0) -> DataFrame:
    """(query_id, atom_id, cost, used) admitted in rank order: an atom that does not fit is skipped, later ones may still fit.

    overhead is reserved for what the rendering puts around the atoms; used counts it. ranked holds a bounded number of atoms a query (a served slice), so the fold over one query's array is small.
    """
    rows = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "atom_id", cost.cast("long").alias("cost")))).alias("xs"))
    kept_type = "array<struct<rank:int,atom_id:string,cost:bigint,used:bigint>>"
    start = F.struct(F.lit(overhead).cast("long").alias("used"), F.array().cast(kept_type).alias("kept"))

    def admit(acc: Column, x: Column) -> Column:
        used = acc["used"] + x["cost"]
        row = F.struct(x["rank"].cast("int").alias("rank"), x["atom_id"].alias("atom_id"), x["cost"].alias("cost"), used.alias("used"))
        fits = x["cost"].isNotNull() & (used <= limit)
        return F.when(fits, F.struct(used.alias("used"), F.concat(acc["kept"], F.array(row)).alias("kept"))).otherwise(acc)

    return rows.select("query_id", F.explode(F.aggregate("xs", start, admit)["kept"]).alias("k")).select("query_id", "k.atom_id", "k.rank", "k.cost", "k.used")


def confidence(delivered: DataFrame, queries: DataFrame, floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """(query_id, confidence): 'none' without atoms, 'ok' if the best-scored atom's relevance meets the floor, else 'weak'."""
    best = delivered.groupBy("query_id").agg(F.max(F.struct(F.col("score"), F.lit(0) - F.col("rank"), F.col("relevance"))).alias("b"))
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id", F.when(F.col("b").isNull(), "none").when(F.coalesce(F.col("b.relevance") >= floor, F.lit(False)), "ok").otherwise("weak").alias("confidence"),
    )


def normalise_scores(ranked: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds score_normalised: min-max over what one query of one run returned; null for one atom or equal scores. keys name the run too where there are several."""
    w = Window.partitionBy(*keys)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return ranked.withColumn("score_normalised", F.when((F.count("*").over(w) >= 2) & (high > low), (F.col("score") - low) / (high - low)))


def render_pack(delivered: DataFrame) -> DataFrame:
    """(query_id, pack, citations, markers): delivered atoms as citable text between PACK_OPEN and PACK_CLOSE, markers of templates and of the pack made harmless.

    delivered: query_id, place, document, atom_id, title, heading_chain, body, origin_index, origin_count. The first atom of a
    document gets its header; citations are listed in delivered order. A query's delivered slice is bounded by its budget.
    """
    own = (PACK_OPEN, PACK_CLOSE)
    neutralise, marker_count = (lambda c: tx.neutralise(c, own)), (lambda c: tx.marker_count(c, own))
    first = F.row_number().over(Window.partitionBy("query_id", "document").orderBy("place")) == 1
    head = F.coalesce(F.nullif(F.substring_index("heading_chain", " > ", 1), F.lit("")), F.nullif(F.col("title"), F.lit("")), F.regexp_extract("document", r"([^/]+?)(?:\.[^.]*)?$", 1))
    marker = F.when(F.col("origin_index").isNotNull() & F.col("origin_count").isNotNull(), F.concat(F.lit(" ("), F.col("origin_index") + 1, F.lit("/"), F.col("origin_count"), F.lit(")"))).otherwise("")
    header = F.when(first, F.concat(F.lit("## "), neutralise(head), F.lit(" — "), neutralise(F.col("document")), F.lit("\n\n"))).otherwise("")
    body = F.coalesce("body", F.lit(""))
    block = F.concat(header, F.lit("[^"), F.col("atom_id"), F.lit("]"), marker, F.lit("\n"), neutralise(body))
    lines = delivered.select("query_id", "place", "atom_id", block.alias("block"), marker_count(body).alias("n"))
    xs = F.sort_array(F.collect_list(F.struct("place", "atom_id", "block")))
    return lines.groupBy("query_id").agg(xs.alias("xs"), F.sum("n").alias("markers")).select(
        "query_id", F.concat_ws("\n", F.lit(PACK_OPEN), F.array_join(F.transform("xs", lambda x: x["block"]), "\n\n"), F.lit(PACK_CLOSE)).alias("pack"), F.array_join(F.transform("xs", lambda x: x["atom_id"]), " ").alias("citations"), "markers",
    )


def fabricated(cited: Column, delivered: Column) -> Column:
    """Citations of what was never delivered."""
    return F.array_except(cited, delivered)


def render_text(delivered: DataFrame) -> DataFrame:
    """(query_id, rendered): a numbered list, a line with rank, title, id and document and the body below it. delivered: query_id, place, atom_id, document, title, score, body."""
    head = F.concat(F.col("place"), F.lit(". "), F.coalesce("title", "atom_id"), F.lit(" ["), F.col("atom_id"), F.lit("] "), F.coalesce("document", F.lit("")))
    return _joined(delivered, F.concat_ws("\n", head, F.coalesce("body", F.lit(""))), "\n\n", "", "")


def render_json(delivered: DataFrame) -> DataFrame:
    """(query_id, rendered): a JSON array of the delivered atoms in order; null fields are left out."""
    return _joined(delivered, F.to_json(F.struct("place", "atom_id", "document", "title", "score", "body")), ",", "[", "]")


def render_xml(delivered: DataFrame) -> DataFrame:
    """(query_id, rendered): <atoms> with an <atom> each, its facts as attributes and its body as text; everything is escaped."""
    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), tx.escape_xml(F.coalesce(c.cast("string"), F.lit(""))), F.lit('"'))
    one = F.concat(F.lit("<atom"), attribute("place", F.col("place")), *(attribute(n, F.col(c)) for n, c in (("id", "atom_id"), ("document", "document"), ("title", "title"))), F.lit(">"), tx.escape_xml(F.coalesce("body", F.lit(""))), F.lit("</atom>"))
    return _joined(delivered, one, "", "<atoms>", "</atoms>")


def _joined(delivered: DataFrame, one: Column, between: str, before: str, after: str) -> DataFrame:
    """A query's delivered slice is bounded by its budget."""
    xs = F.sort_array(F.collect_list(F.struct("place", one.alias("t"))))
    return delivered.groupBy("query_id").agg(F.concat(F.lit(before), F.array_join(F.transform(xs, lambda x: x["t"]), between), F.lit(after)).alias("rendered"))
