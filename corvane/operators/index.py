"""Term statistics and positional postings of a corpus, as ordinary DataFrames.

Everything of one document is made in the task that holds the document: the corpus is partitioned by document once, and
explode, term frequency, scoring and per-document sums keep that partitioning, so that no posting is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text as tx
from corvane.session import cut, small

#: The indexed text columns in their order.
COLUMNS = ("body", "short", "long", "doc_desc", "keywords", "entities", "questions")


def latest_rows(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key: the first in the given order. Rows with a null key are dropped; ties are rows that are alike in all of order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def current_atoms(atoms: DataFrame) -> DataFrame:
    """One row an atom_id: the one taken in last."""
    return latest_rows(atoms, "atom_id", F.desc_nulls_last("ingested_at"), F.desc_nulls_first("removed_at"), F.desc_nulls_last("body"))


def lean_atoms(atoms: DataFrame) -> DataFrame:
    """current_atoms() for a corpus that is read several times: only the atoms that come more than once are shuffled, the others stay in their task."""
    repeated = cut(atoms.where("atom_id is not null").groupBy("atom_id").agg(F.count("*").alias("n")).where("n > 1").select("atom_id"))
    repeated = small(repeated)
    return atoms.where("atom_id is not null").join(repeated, "atom_id", "left_anti").unionByName(current_atoms(atoms.join(repeated, "atom_id", "left_semi")))


def latest_enrichment(enrichment: DataFrame) -> DataFrame:
    """One record an atom_id (trimmed, in lower case): the last appended one supersedes."""
    rows = enrichment.withColumn("atom_id", F.nullif(F.lower(F.trim("atom_id")), F.lit("")))
    return latest_rows(rows, "atom_id", F.desc_nulls_last("created_at"), F.desc("record_no"))


def indexed_fields(atoms: DataFrame, enrichment: DataFrame | None = None, body_source: str = "atom") -> DataFrame:
    """(atom_id, body, short, long, doc_desc, keywords, entities, questions), missing texts as ''.

    body_source: 'atom', 'long' (the enrichment's long text, else the body) or 'long+keywords'. Array fields are joined by
    blanks. Atoms without a record keep empty enrichment columns.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    if enrichment is None:
        return atoms.select("atom_id", blank(F.col("body")).alias("body"), *(F.lit("").alias(c) for c in COLUMNS[1:]))
    joined = lambda c: blank(F.array_join(F.array_compact(c), " "))
    e = enrichment.select(
        F.col("atom_id").alias("_id"), blank(F.col("short_desc")).alias("short"), blank(F.col("long_desc")).alias("long"), blank(F.col("doc_description")).alias("doc_desc"),
        joined("keywords").alias("keywords"), joined("entities").alias("entities"), joined("questions").alias("questions"),
    )
    both = atoms.select("atom_id", blank(F.col("body")).alias("body")).join(e, F.lower(F.trim("atom_id")) == F.col("_id"), "left").drop("_id").na.fill("")
    if body_source == "atom":
        return both
    long = F.when(F.trim("long") == "", F.col("body")).otherwise(F.col("long"))
    if body_source == "long":
        return both.withColumn("body", long)
    if body_source == "long+keywords":
        return both.withColumn("body", F.concat_ws(" ", long, "keywords"))
    raise ValueError(f"unknown body_source {body_source!r}")


@dataclass
class Index:
    """postings: (atom_id, doc_len, term, tf); its statistics cover every document, whatever is filtered later.

    rows holds a document in one row: (atom_id, doc_len, terms), terms being either its terms (in their order, if nothing was left out) or array<struct<term, tf>>.
    """

    postings: DataFrame
    docs: DataFrame  # (atom_id, doc_len)
    analyzer: str
    rows: DataFrame
    kept: bool = False  # rows are written

    @staticmethod
    def build(corpus: DataFrame, analyzer: str, text: Column | None = None) -> Index:
        """corpus: one row an atom_id. Documents without terms count in N and in the average length, with length 0.

        Without a stemmer nothing is shuffled but what the postings need. A stemmer sees each distinct term once, so the terms are
        written first, and a document's stems are brought together again.
        """
        text = F.col("body") if text is None else text
        idents = tx.ANALYZERS[analyzer][2]
        terms = (tx.unstemmed_terms if idents else tx.plain_terms)(F.coalesce(text, F.lit("")), analyzer)
        placed = corpus.select("atom_id", terms.alias("terms")).withColumn("doc_len", F.size("terms")).select("atom_id", "doc_len", "terms")
        if tx.ANALYZERS[analyzer][1] is None:
            return of_rows(placed, analyzer)
        placed = cut(placed.repartition("atom_id"))
        tokens = placed.select("atom_id", "doc_len", F.explode_outer("terms").alias("t"))
        tokens = tokens.select("atom_id", "doc_len", "t.term", "t.whole") if idents else tokens.withColumnRenamed("t", "term")
        stems = tx.stem_terms(tokens, analyzer, whole="whole" if idents else None).groupBy("atom_id", "doc_len", "term").agg(F.count("*").alias("tf"))
        # A document without terms keeps its row: the list leaves out its null.
        return of_rows(stems.groupBy("atom_id", "doc_len").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("terms")), analyzer)

    def by_document(self) -> DataFrame:
        """The postings, partitioned so that sums over a document's terms stay in its task."""
        return _postings(self.rows.repartition("atom_id"))

    def stats(self) -> DataFrame:
        """One row: n_docs, avg_len (0 for an empty corpus)."""
        return self.docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_len"))

    def document_frequency(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df), of the given distinct terms only if there are any (marked for broadcast if they are few): counted in each task before the shuffle."""
        each = self.rows.select(F.explode(F.array_distinct("terms") if rows_listed(self.rows) else F.col("terms.term")).alias("term"))
        return (each if terms is None else each.join(terms, "term", "left_semi")).groupBy("term").agg(F.count("*").alias("df"))

    def stored(self) -> Index:
        """The same index, made once: a row a document is written to the checkpoint folder, and all the rest is read from it."""
        return self if self.kept else of_rows(cut(self.rows), self.analyzer, True)

    def write(self, path: str) -> None:
        """A row a document; the stamp comes last, so an index that was not finished is not read."""
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.stats().withColumn("analyzer", F.lit(self.analyzer)).write.mode("overwrite").parquet(f"{path}/stamp")

    @staticmethod
    def read(spark: SparkSession, path: str, analyzer: str) -> Index:
        """An index whose stamp names another analyzer is refused."""
        stamp = spark.read.parquet(f"{path}/stamp").first()
        if stamp is None or stamp.analyzer != analyzer:
            raise ValueError(f"the index was built with analyzer {stamp and stamp.analyzer!r}, not {analyzer!r}")
        return of_rows(spark.read.parquet(f"{path}/rows"), analyzer, True)


def rows_listed(rows: DataFrame) -> bool:
    """Whether rows list a document's terms with repeats, not with their frequencies."""
    return not rows.schema["terms"].dataType.simpleString().startswith("array<struct")


def _postings(rows: DataFrame) -> DataFrame:
    if not rows_listed(rows):
        return rows.select("atom_id", "doc_len", F.inline("terms"))
    return rows.select("atom_id", "doc_len", F.explode("terms").alias("term")).groupBy("atom_id", "doc_len", "term").agg(F.count("*").alias("tf"))


def of_rows(rows: DataFrame, analyzer: str, kept: bool = False) -> Index:
    return Index(_postings(rows), rows.select("atom_id", "doc_len"), analyzer, rows, kept)


def placed_fields(fields: DataFrame, analyzer: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(atom_id, doc_len, fields) with the unstemmed terms of every column in their order; doc_len counts all columns."""
    split = tx.unstemmed_terms if tx.ANALYZERS[analyzer][2] else tx.plain_terms
    term_lists = [F.struct(F.lit(c).alias("col"), split(F.col(c), analyzer).alias("terms")) for c in columns]
    placed = fields.repartition("atom_id").select("atom_id", F.array(*term_lists).alias("fields"))
    return placed.withColumn("doc_len", F.aggregate("fields", F.lit(0), lambda s, x: s + F.size(x["terms"])))


def positions_of(placed: DataFrame, analyzer: str) -> DataFrame:
    """(atom_id, col, pos, term, doc_len) of every token of placed_fields()."""
    by_col = placed.select("atom_id", "doc_len", F.explode("fields").alias("f")).select("atom_id", "doc_len", "f.col", F.posexplode("f.terms").alias("pos", "t"))
    if not tx.ANALYZERS[analyzer][2]:
        return tx.stem_terms(by_col.withColumnRenamed("t", "term"), analyzer, whole=None)
    return tx.stem_terms(by_col.select("atom_id", "doc_len", "col", "pos", "t.term", "t.whole"), analyzer).drop("whole")


def positions(fields: DataFrame, analyzer: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(atom_id, col, pos, term, doc_len) of every token of every column; doc_len counts all columns."""
    return positions_of(placed_fields(fields, analyzer, columns), analyzer)


def novel_keywords(records: DataFrame, analyzer: str = "nostem-fold") -> DataFrame:
    """(atom_id, kept, dropped): a keyword is kept unless each of its terms occurs in the body; one without terms is dropped.

    records: atom_id, body, keywords. The analyzer must not stem, as this stays one expression a row.
    """
    terms = lambda c: tx.plain_terms(c, analyzer)
    rows = records.select("atom_id", F.coalesce(F.array_compact("keywords"), F.array().cast("array<string>")).alias("kw"), terms(F.coalesce("body", F.lit(""))).alias("body_terms"))
    novel = lambda k: F.size(F.array_except(terms(k), F.col("body_terms"))) > 0
    return rows.select("atom_id", F.filter("kw", novel).alias("kept"), F.filter("kw", lambda k: ~novel(k)).alias("dropped"))


def commonest_terms(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("df"), "term").limit(n)


def rarest_terms(postings: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """The n rarest terms of each document: (atom_id, place, term, df)."""
    w = Window.partitionBy("atom_id").orderBy("df", "term")
    return postings.select("atom_id", "term").join(df, "term").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("atom_id", "place", "term", "df")


def without_filler(terms: Column, common: list[str]) -> Column:
    """The terms that are not among the commonest ones (a list of a fixed length)."""
    return F.filter(terms, lambda t: ~t.isin(*common)) if common else terms
