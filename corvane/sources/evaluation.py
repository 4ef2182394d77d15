"""Readers and writers of evaluation data: BEIR-style corpora, judgments, passage benchmarks, question sets, TREC runs, histories, sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import safe_id


def _line_order() -> Column:
    """Where a line stands: its file, the block of the file, and its place in the block."""
    return F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))


def read_beir_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, text) of corpus.jsonl; empty ids go, ids are made safe, and two ids that become one are refused."""
    raw = spark.read.schema("_id string, title string, text string").json(path).where("_id <> ''")
    out = raw.select(safe_id(F.col("_id")).alias("doc_id"), F.col("_id").alias("raw"), "title", "text")
    clash = out.groupBy("doc_id").agg(F.count_distinct("raw").alias("n")).where("n > 1").first()
    if clash is not None:
        raise ValueError(f"several ids become {clash.doc_id}")
    return out.drop("raw")


def read_beir_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query_text, axis, domain, type); an empty facet is null."""
    raw = spark.read.schema("_id string, text string, axis string, domain string, type string").json(path).where("_id <> ''")
    return raw.select(F.col("_id").alias("query_id"), F.col("text").alias("query_text"), *(F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("axis", "domain", "type")))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, grade) of a tab-separated file with a header; of a repeated pair the last line holds."""
    raw = spark.read.option("sep", "\t").option("header", "true").schema("query_id string, doc string, grade int").csv(path)
    last = raw.withColumn("at", _line_order())
    w = Window.partitionBy("query_id", "doc").orderBy(F.desc("at"))
    return last.withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", safe_id(F.col("doc")).alias("doc_id"), F.coalesce("grade", F.lit(0)).alias("grade"))


def topics_of(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Judged queries with a text."""
    return queries.where("trim(query_text) <> ''").join(qrels.select("query_id").distinct(), "query_id", "left_semi")


def read_passages(spark: SparkSession, documents: str, examples: str) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text) and examples (id, query_text, gold_ids, gold_ids_long, excluded_ids) of a passage benchmark in parquet files; blank ids go."""
    docs = spark.read.parquet(documents).where("trim(id) <> ''").select(safe_id(F.col("id").cast("string")).alias("doc_id"), F.col("content").alias("text"))
    rows = spark.read.parquet(examples).where("trim(id) <> ''")
    empty = F.array().cast("array<string>")
    ids = lambda c: (F.coalesce(F.col(c).cast("array<string>"), empty) if c in rows.columns else empty).alias(c)
    return docs, rows.select(F.col("id").cast("string").alias("id"), F.col("query").alias("query_text"), *map(ids, ("gold_ids", "gold_ids_long", "excluded_ids")))


def passages_to_qrels(examples: DataFrame, granularity: str = "long") -> tuple[DataFrame, DataFrame]:
    """(query_id, doc_id, grade) and (query_id, doc_id) excluded, of examples (id, gold_ids, gold_ids_long, excluded_ids). 'N/A' excludes nothing."""
    gold = {"long": "gold_ids_long", "passage": "gold_ids"}[granularity]
    q = F.col("id").cast("string").alias("query_id")
    judged = examples.select(q, F.explode(gold).alias("d")).where("d <> ''").select("query_id", safe_id(F.col("d")).alias("doc_id"), F.lit(1).alias("grade")).distinct()
    excluded = examples.select(q, F.explode("excluded_ids").alias("d")).where("d <> '' and d <> 'N/A'").select("query_id", safe_id(F.col("d")).alias("doc_id")).distinct()
    return judged, excluded


def without_excluded(ranking: DataFrame, excluded: DataFrame) -> DataFrame:
    return ranking.join(excluded, ["query_id", "doc_id"], "left_anti")


#: The nested form of a question-answering set.
SQUAD_SCHEMA = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,is_impossible:boolean>>>>>>"


def flatten_questions(nested: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, title, text), queries (query_id, query_text) and qrels of SQUAD_SCHEMA rows.

    Unanswerable questions go; blanks are collapsed; equal contexts of an article are one document; documents are numbered within their
    article in order of appearance; a question asked twice of one document is one topic.
    """
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    articles = nested.select(F.posexplode("data").alias("a", "art")).select("a", "art.title", F.posexplode("art.paragraphs").alias("p", "par"))
    contexts = articles.select("a", "title", "p", flat(F.col("par.context")).alias("text"), "par.qas")
    first = contexts.groupBy("a", "title", "text").agg(F.min("p").alias("p"))
    numbered = first.withColumn("doc_id", F.concat_ws("-", safe_id(F.col("title")), F.row_number().over(Window.partitionBy("a", "title").orderBy("p"))))
    asked = contexts.select("a", "title", "text", F.explode("qas").alias("q")).where("not coalesce(q.is_impossible, false)").select("a", "title", "text", "q.id", flat(F.col("q.question")).alias("question"))
    topics = asked.join(numbered, ["a", "title", "text"]).groupBy("question", "doc_id").agg(F.min("id").alias("query_id"))
    return numbered.select("doc_id", "title", "text"), topics.select("query_id", F.col("question").alias("query_text")), topics.select("query_id", "doc_id", F.lit(1).alias("grade"))


def golden_dataset(atoms: DataFrame, golden: DataFrame, exclude_types: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, qrels and one row of reach: gold that no document answers to and the mean recall ceiling."""
    kept = atoms.where(~F.coalesce(F.col("atom_type").isin(*exclude_types), F.lit(False))) if exclude_types else atoms
    docs = kept.select(F.col("atom_id").alias("doc_id"), "title", F.regexp_replace("body", r"^#[ \t]+[^\n]*\n+", "").alias("text"))
    qrels = golden.select("query_id", F.explode("relevant_atom_ids").alias("doc_id")).where("doc_id is not null").distinct().withColumn("grade", F.lit(1))
    marked = qrels.join(docs.select("doc_id").distinct().withColumn("there", F.lit(1)), "doc_id", "left")
    per = marked.groupBy("query_id").agg(F.count_if(F.col("there").isNull()).alias("lost"), (F.count("there") / F.count("*")).alias("ceiling"))
    return docs, qrels, per.agg(F.sum("lost").alias("unreachable"), F.avg("ceiling").alias("recall_ceiling"))


def materialise(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as Markdown pages: the title as a heading, then the text, or the title again where the text is blank."""
    body = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.col("title")).otherwise(F.col("text"))
    return docs.select("doc_id", F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit("")), F.lit("\n")).alias("text"))


def parse_trec(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(query_id, doc_id, rank, score, tag) of run lines (value).

    strict: six fields, else the job fails and names the line; rank and score are the line's. Lenient: three fields are
    enough; rank is the order in the file, so lines must come from one text source.
    """
    rows = lines.where("trim(value) <> ''").withColumn("f", F.split(F.trim("value"), r"\s+"))
    need = 6 if strict else 3
    rows = rows.withColumn("f", F.when(F.size("f") >= need, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("malformed run line: "), F.col("value"))).cast("array<string>")))
    if strict:
        return rows.select(F.col("f")[0].alias("query_id"), F.col("f")[2].alias("doc_id"), F.col("f")[3].cast("int").alias("rank"), F.col("f")[4].cast("double").alias("score"), F.col("f")[5].alias("tag"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    rows = rows.select(F.col("f")[0].alias("query_id"), F.col("f")[2].alias("doc_id"), F.monotonically_increasing_id().alias("at"))
    return rows.withColumn("rank", order).select("query_id", "doc_id", "rank")


def format_trec(ranking: DataFrame, tag: str) -> DataFrame:
    """(value): 'qid Q0 doc rank score tag', the score falling from the number of documents to 1."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return ranking.select(F.concat_ws(" ", "query_id", F.lit("Q0"), "doc_id", F.col("rank").cast("string"), (n - F.col("rank") + 1).cast("string"), F.lit(tag)).alias("value"))


def write_topic_metrics(topics: DataFrame, path: str) -> None:
    topics.write.mode("overwrite").option("sep", "\t").option("header", "true").option("nullValue", "").csv(path)


def read_topic_metrics(spark: SparkSession, path: str, metrics: tuple[str, ...]) -> DataFrame:
    """(query_id, metrics...) with null for a blank cell; a file without the wanted columns is refused."""
    raw = spark.read.option("sep", "\t").option("header", "true").option("nullValue", "").csv(path)
    missing = [m for m in ("query_id", *metrics) if m not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return raw.select("query_id", *(F.expr(f"try_cast(`{m}` as double)").alias(m) for m in metrics))


def format_scores(ranking: DataFrame, rerank: bool = False) -> DataFrame:
    """(query_id, rank, value): tab-separated lines of query, rank, document and score, with the scores before and after a rerank; null scores are empty cells.

    ranking: query_id, doc_id, rank, score[, first_pass_score, rerank_score].
    """
    cells = ["query_id", "rank", "doc_id", "score", *(["first_pass_score", "rerank_score"] if rerank else [])]
    return ranking.select("query_id", "rank", F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells)).alias("value"))


def write_scores(ranking: DataFrame, path: str, rerank: bool = False) -> None:
    """The same as CSV files with a header, a topic's lines together and in rank order."""
    cells = ["query_id", "rank", "doc_id", "score", *(["first_pass_score", "rerank_score"] if rerank else [])]
    ranking.select(*cells).repartition("query_id").sortWithinPartitions("query_id", "rank").write.mode("overwrite").option("sep", "\t").option("header", "true").option("nullValue", "").csv(path)


def format_enrichment(records: DataFrame) -> DataFrame:
    """(value): a JSON line a record, its keys in order, as read_enrichment() reads it."""
    return records.select(F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_enrichment(records: DataFrame, path: str) -> None:
    format_enrichment(records).write.mode("append").text(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All rows that append_history() wrote."""
    return spark.read.json(path)


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_enrichment(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The sidecar's records, the last of each id, and one row with the number of malformed lines."""
    fields = "key string, docKey string, variant string, unit string, id string, source string, promptVersion int, model string, short string, long string, doc_description string, keywords array<string>, entities array<string>, questions array<string>"
    lines = spark.read.text(path).withColumn("at", _line_order()).where("trim(value) <> ''")
    parsed = lines.withColumn("r", F.from_json("value", fields, {"mode": "PERMISSIVE"}))
    ok = "r.id is not null and r.key is not null and r.short is not null and r.long is not null"
    good = parsed.where(ok).select("at", "r.*")
    w = Window.partitionBy("id").orderBy(F.desc("at"))
    return good.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "at"), parsed.agg(F.expr(f"count_if(not coalesce({ok}, false))").alias("malformed"))


def is_fresh(body: str, key: str, prompt_version: int, model: str):
    """An enrichment record is fresh if body hash, prompt version and model are all the current ones."""
    return (F.sha2(F.col(body), 256) == F.col(key)) & (F.col("promptVersion") == prompt_version) & (F.col("model") == model)


def synthetic_corpus(spark: SparkSession, n: int, seed: int, vocabulary: list[str], domains: list[str], title_words: int = 4, body_words: int = 48) -> DataFrame:
    """(atom_id, x_domain, title, body) of n documents whose words a 32-bit hash of 'seed:index:slot' picks."""

    def fnv(text):
        codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
        step = lambda h, c: ((h.bitwiseXOR(c)) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(2166136261).cast("long"), step)

    words = F.array(*map(F.lit, vocabulary))
    pick = lambda i, slot: F.element_at(words, (F.pmod(fnv(F.concat_ws(":", F.lit(str(seed)), i.cast("string"), slot.cast("string"))), F.lit(len(vocabulary))) + 1).cast("int"))
    i = F.col("id")
    text = lambda a, b: F.array_join(F.transform(F.sequence(F.lit(a), F.lit(b)), lambda s: pick(i, s)), " ")
    return spark.range(n).select(
        F.concat(F.lit(f"syn-{seed}-"), F.lpad(i.cast("string"), 6, "0")).alias("atom_id"), F.element_at(F.array(*map(F.lit, domains)), (F.pmod(i, F.lit(len(domains))) + 1).cast("int")).alias("x_domain"),
        text(0, title_words - 1).alias("title"), text(title_words, title_words + body_words - 1).alias("body"),
    )
