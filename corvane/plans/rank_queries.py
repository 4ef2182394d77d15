"""Queries of index building, first-pass ranking, dense search, fusion and delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import index as ix
from corvane.operators import rank as rk
from corvane.plans import sql
from corvane.session import cut, table

ANALYZER = "nostem-fold"
K = 10


def text_of():
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return ix.current_atoms(table(spark, d, "atoms"))


def queries_of(spark: SparkSession, d: str) -> DataFrame:
    golden = table(spark, d, "golden_queries").select("query_id", "query_text")
    return golden.unionByName(table(spark, d, "probes").select(F.col("probe_id").alias("query_id"), "query_text")).distinct()


def linear_index(spark: SparkSession, d: str, analyzer: str = ANALYZER) -> ix.Index:
    return ix.Index.build(corpus(spark, d), analyzer, text_of())


def body_index(spark: SparkSession, d: str) -> ix.Index:
    return ix.Index.build(corpus(spark, d), ANALYZER)


def r1_bm25_linear(spark: SparkSession, d: str) -> DataFrame:
    idx = linear_index(spark, d).stored()
    return rk.bm25_top(idx, rk.query_terms(queries_of(spark, d), ANALYZER), K)


def r1_bm25_porter(spark: SparkSession, d: str) -> DataFrame:
    idx = linear_index(spark, d, "porter-fold").stored()
    return rk.bm25_top(idx, rk.query_terms(queries_of(spark, d), "porter-fold"), K)


def r8_bm25_plus(spark: SparkSession, d: str) -> DataFrame:
    idx = body_index(spark, d).stored()
    return rk.bm25_top(idx, rk.query_terms(queries_of(spark, d), ANALYZER), K, b=0.7, delta=0.5)


def r9_bm25_body(spark: SparkSession, d: str) -> DataFrame:
    idx = body_index(spark, d).stored()
    return rk.bm25_top(idx, rk.query_terms(queries_of(spark, d), ANALYZER), K)


def _fields(spark: SparkSession, d: str) -> DataFrame:
    return ix.indexed_fields(corpus(spark, d), ix.latest_enrichment(table(spark, d, "enrichment")))


WEIGHTS = {"body": 1.0, "short": 2.0, "keywords": 1.5, "questions": 0.5}


def _fts(spark: SparkSession, d: str, weights: dict[str, float], columns: tuple[str, ...], adjacency: bool = False) -> DataFrame:
    fields = _fields(spark, d) if len(columns) > 1 else ix.indexed_fields(corpus(spark, d))
    placed = cut(ix.placed_fields(fields, ANALYZER, columns))
    return rk.fts_top(placed, ANALYZER, rk.disjuncts(queries_of(spark, d), ANALYZER, adjacency), weights, K)


def r2_bm25_fts(spark: SparkSession, d: str) -> DataFrame:
    return _fts(spark, d, {"body": 1.0}, ("body",))


def r3_field_weights(spark: SparkSession, d: str) -> DataFrame:
    return _fts(spark, d, WEIGHTS, ("body", "short", "keywords", "questions"))


def r5_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return _fts(spark, d, {"body": 1.0}, ("body",), adjacency=True)


def r4_disjuncts(spark: SparkSession, d: str) -> DataFrame:
    return rk.disjuncts(queries_of(spark, d), ANALYZER).select("query_id", "disjunct", F.array_join("terms", " ").alias("phrase"))


def r7_phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    parts = rk.disjuncts(queries_of(spark, d), ANALYZER).where("size(terms) > 1").select(F.array_join("terms", " ").alias("phrase"), "terms").distinct()
    return rk.phrase_hits(ix.positions(ix.indexed_fields(corpus(spark, d)), ANALYZER, ("body",)), parts).select("phrase", "atom_id", "tf")


def _prf(spark: SparkSession, d: str):
    """The index, the feedback weights, and the words that their terms are numbers of (None: they are words)."""
    index = ix.Index.build(ix.lean_atoms(table(spark, d, "atoms")), ANALYZER)
    idx, terms, words = rk.all_numbered(index, rk.query_terms(queries_of(spark, d), ANALYZER, distinct=False))
    first = cut(rk.bm25_top(idx, terms.withColumn("qtf", F.lit(1).cast("long")), 10))
    return idx, cut(rk.rm3_weights(terms, first, idx.rows)), words


def r13_rm3_weights(spark: SparkSession, d: str) -> DataFrame:
    _, weights, words = _prf(spark, d)
    named = weights if words is None else rk.in_words(weights, words)
    return named.select("query_id", "term", F.round("weight", 9).alias("weight"))


def r14_prf_rescore(spark: SparkSession, d: str) -> DataFrame:
    idx, weights, _ = _prf(spark, d)
    return rk.weighted_top(idx, weights.withColumn("weight", F.round("weight", 9)), K)


def r17_sweep(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.createDataFrame([(k1, b) for k1 in (0.9, 1.2, 1.5) for b in (0.4, 0.75)], "k1 double, b double")
    return rk.sweep_top(linear_index(spark, d), rk.query_terms(queries_of(spark, d), ANALYZER), grid, 3)


def r18_vocabulary_gap(spark: SparkSession, d: str) -> DataFrame:
    return rk.vocabulary_gap(queries_of(spark, d), linear_index(spark, d).document_frequency())


def r10_dense_knn(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return rk.dense_knn(v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), K)


def i1_postings(spark: SparkSession, d: str) -> DataFrame:
    return linear_index(spark, d).postings.select("atom_id", "term", "tf", "doc_len")


def i1_positions(spark: SparkSession, d: str) -> DataFrame:
    pos = ix.positions(ix.indexed_fields(corpus(spark, d)), ANALYZER, ("body",))
    return pos.groupBy("term").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"), F.max("pos").alias("pos_max"))


def i2_body_source(spark: SparkSession, d: str) -> DataFrame:
    f = ix.indexed_fields(corpus(spark, d), ix.latest_enrichment(table(spark, d, "enrichment")), "long+keywords")
    return f.select("atom_id", F.md5("body").alias("body_md5"))


def i3_novel_keywords(spark: SparkSession, d: str) -> DataFrame:
    e = ix.latest_enrichment(table(spark, d, "enrichment")).select("atom_id", "keywords")
    rows = corpus(spark, d).select("atom_id", "body").join(e, "atom_id")
    return ix.novel_keywords(rows).select("atom_id", F.array_join("kept", "|").alias("kept"), F.array_join("dropped", "|").alias("dropped"))


def i4_keyword_census(spark: SparkSession, d: str) -> DataFrame:
    e = ix.latest_enrichment(table(spark, d, "enrichment")).select("atom_id", "keywords")
    n = ix.novel_keywords(corpus(spark, d).select("atom_id", "body").join(e, "atom_id"))
    return n.agg(F.sum(F.size("kept")).alias("kept"), F.sum(F.size("dropped")).alias("dropped"))


def i5_empty_bodies(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).agg(F.count_if(F.trim(F.coalesce("body", F.lit(""))) == "").alias("empty_bodies"), F.count("*").alias("atoms"))


def i8_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return linear_index(spark, d).stats().withColumn("avg_len", F.round("avg_len", 9))


def i9_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return linear_index(spark, d).document_frequency()


def i10_commonest_terms(spark: SparkSession, d: str) -> DataFrame:
    return ix.commonest_terms(linear_index(spark, d).document_frequency(), 50)


def i10_rarest_terms(spark: SparkSession, d: str) -> DataFrame:
    idx = linear_index(spark, d).stored()
    return ix.rarest_terms(idx.postings, idx.document_frequency(), 5)


def i11_filler_strip(spark: SparkSession, d: str) -> DataFrame:
    common = [r.term for r in ix.commonest_terms(linear_index(spark, d).document_frequency(), 50).collect()]  # 50 rows
    q = queries_of(spark, d)
    return q.select("query_id", F.array_join(ix.without_filler(tx.tokenize(F.coalesce("query_text", F.lit(""))), common), " ").alias("stripped"))


QUERIES = {
    f.__name__: f
    for f in (
        r1_bm25_linear, r1_bm25_porter, r2_bm25_fts, r3_field_weights, r4_disjuncts, r5_adjacency, r7_phrase_hits, r8_bm25_plus, r9_bm25_body, r10_dense_knn,
        r13_rm3_weights, r14_prf_rescore, r17_sweep, r18_vocabulary_gap,
        i1_postings, i1_positions, i2_body_source, i3_novel_keywords, i4_keyword_census, i5_empty_bodies, i8_corpus_stats, i9_vocabulary, i10_commonest_terms, i10_rarest_terms, i11_filler_strip,
    )
}

_IDX = (sql.CORPUS, sql.QUERIES, sql.INDEX, sql.QTERMS)
_BODY_INDEX = sql.INDEX.replace("coalesce(title, '') || ' ' || coalesce(body, '')", "body")
_BODY = (sql.CORPUS, sql.QUERIES, _BODY_INDEX, sql.QTERMS)
_TOP = "SELECT query_id, atom_id, score, rank FROM ranked"
_CHUNKS = f"""chunks AS (SELECT query_id, i - 1 AS chunk, {sql.tok("raw[i]")} AS terms
  FROM (SELECT query_id, raw, unnest(range(1, len(raw) + 1)) AS i FROM (SELECT query_id, list_filter(regexp_split_to_array(coalesce(query_text, ''), '\\s+'), lambda x: x <> '') AS raw FROM queries)))"""
_DISJ = "disj AS (SELECT query_id, chunk || '.p' AS disjunct, terms FROM chunks WHERE len(terms) > 0)"
_DISJ_ADJ = """disj AS (SELECT query_id, chunk || '.p' AS disjunct, terms FROM chunks WHERE len(terms) > 0
  UNION ALL SELECT query_id, chunk || '.' || (i - 1), [terms[i]] FROM (SELECT query_id, chunk, terms, unnest(range(1, len(terms) + 1)) AS i FROM chunks WHERE len(terms) > 1))"""


def _fts_sql(columns: dict[str, tuple[str, float]], disj: str, enrich: bool) -> str:
    """columns: name -> (text expression, weight)."""
    source = "corpus LEFT JOIN enr ON lower(trim(corpus.atom_id)) = enr.atom_id" if enrich else "corpus"
    pos = " UNION ALL ".join(f"SELECT corpus.atom_id, '{c}' AS col, {sql.tok(e)} AS ts, CAST({w} AS DOUBLE) AS w FROM {source}" for c, (e, w) in columns.items())
    return sql.base(
        sql.CORPUS, *([sql.ENRICH] if enrich else []), sql.QUERIES, _CHUNKS, disj,
        f"fields AS ({pos})",
        "lens AS (SELECT atom_id, sum(len(ts)) AS doc_len FROM fields GROUP BY 1)",
        "toks AS (SELECT atom_id, col, w, i AS pos, ts[i] AS term FROM (SELECT atom_id, col, w, ts, unnest(range(1, len(ts) + 1)) AS i FROM fields))",
        "phrases AS (SELECT DISTINCT array_to_string(terms, ' ') AS phrase, terms FROM disj)",
        "pt AS (SELECT phrase, len(terms) AS n, i, terms[i] AS term FROM (SELECT phrase, terms, unnest(range(1, len(terms) + 1)) AS i FROM phrases))",
        "starts AS (SELECT phrase, atom_id, col, w, pos - i AS s FROM pt JOIN toks USING (term) GROUP BY phrase, atom_id, col, w, pos - i, n HAVING count(*) = n)",
        "hits AS (SELECT phrase, atom_id, sum(w) AS wtf FROM starts GROUP BY 1, 2)",
        "pdf AS (SELECT phrase, count(*) AS df FROM hits GROUP BY 1)",
        "st AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM lens)",
        "asked AS (SELECT query_id, array_to_string(terms, ' ') AS phrase, count(*) AS repeats FROM disj GROUP BY 1, 2)",
        """scores AS (SELECT query_id, atom_id, round(sum(repeats * CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END
          * (wtf * 2.2 / (wtf + 1.2 * (1 - 0.75 + 0.75 * doc_len / avg_len)))), 9) AS score
          FROM asked JOIN hits USING (phrase) JOIN pdf USING (phrase) JOIN lens USING (atom_id) CROSS JOIN st GROUP BY 1, 2)""",
        sql.ranked(),
    ) + _TOP


_KW = lambda c: f"array_to_string(list_filter({c}, lambda x: x IS NOT NULL), ' ')"
_RM3 = (
    *_BODY, sql.scores(), sql.ranked(),
    "fb AS (SELECT query_id, atom_id, CASE WHEN sum(greatest(score, 0)) OVER w > 0 THEN greatest(score, 0) / sum(greatest(score, 0)) OVER w ELSE 1.0 / count(*) OVER w END AS share FROM ranked WINDOW w AS (PARTITION BY query_id))",
    "grown AS (SELECT query_id, term, round(sum(share * tf / doc_len), 12) AS mass FROM fb JOIN postings USING (atom_id) JOIN docs USING (atom_id) GROUP BY 1, 2)",
    "kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mass DESC, term) AS place FROM grown) WHERE place <= 20)",
    "expansion AS (SELECT query_id, term, 0.5 * mass / sum(mass) OVER (PARTITION BY query_id) AS w FROM kept)",
    "own AS (SELECT query_id, term, 0.5 * qtf / sum(qtf) OVER (PARTITION BY query_id) AS w FROM qterms)",
    "weights AS (SELECT query_id, term, round(sum(w), 9) AS weight FROM (SELECT * FROM own UNION ALL SELECT * FROM expansion) GROUP BY 1, 2)",
)
_NOVEL = f"""novel AS (SELECT atom_id, list_filter(kw, lambda k: len(list_filter({sql.tok("k")}, lambda t: NOT list_contains(bt, t))) > 0) AS kept,
  list_filter(kw, lambda k: len(list_filter({sql.tok("k")}, lambda t: NOT list_contains(bt, t))) = 0) AS dropped
  FROM (SELECT corpus.atom_id, coalesce(list_filter(keywords, lambda x: x IS NOT NULL), []) AS kw, {sql.tok("body")} AS bt FROM corpus JOIN enr USING (atom_id)))"""

ORACLES = {
    "r1_bm25_linear": sql.base(*_IDX, sql.scores(), sql.ranked()) + _TOP,
    "r8_bm25_plus": sql.base(*_BODY, sql.scores(b="0.7", extra="+ 0.5"), sql.ranked()) + _TOP,
    "r9_bm25_body": sql.base(*_BODY, sql.scores(), sql.ranked()) + _TOP,
    "r2_bm25_fts": _fts_sql({"body": ("body", 1.0)}, _DISJ, False),
    "r3_field_weights": _fts_sql({"body": ("body", 1.0), "short": ("short_desc", 2.0), "keywords": (_KW("keywords"), 1.5), "questions": (_KW("questions"), 0.5)}, _DISJ, True),
    "r5_adjacency": _fts_sql({"body": ("body", 1.0)}, _DISJ_ADJ, False),
    "r4_disjuncts": sql.base(sql.QUERIES, _CHUNKS, _DISJ) + "SELECT query_id, disjunct, array_to_string(terms, ' ') AS phrase FROM disj",
    "r7_phrase_hits": sql.base(
        sql.CORPUS, sql.QUERIES, _CHUNKS, _DISJ,
        f"toks AS (SELECT atom_id, i AS pos, ts[i] AS term FROM (SELECT atom_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT atom_id, {sql.tok('body')} AS ts FROM corpus)))",
        "phrases AS (SELECT DISTINCT array_to_string(terms, ' ') AS phrase, terms FROM disj WHERE len(terms) > 1)",
        "pt AS (SELECT phrase, len(terms) AS n, i, terms[i] AS term FROM (SELECT phrase, terms, unnest(range(1, len(terms) + 1)) AS i FROM phrases))",
        "starts AS (SELECT phrase, atom_id, pos - i AS s FROM pt JOIN toks USING (term) GROUP BY phrase, atom_id, pos - i, n HAVING count(*) = n)",
    ) + "SELECT phrase, atom_id, count(*) AS tf FROM starts GROUP BY 1, 2",
    "r13_rm3_weights": sql.base(*_RM3) + "SELECT query_id, term, weight FROM weights",
    "r14_prf_rescore": sql.base(*_RM3, sql.scores("weight", name="again", terms="(SELECT * FROM weights WHERE weight > 0)"), sql.ranked("again", name="last")) + "SELECT query_id, atom_id, score, rank FROM last",
    "r17_sweep": sql.base(*_IDX, "grid AS (SELECT k1, b FROM (VALUES (0.9::DOUBLE), (1.2), (1.5)) x(k1), (VALUES (0.4::DOUBLE), (0.75)) y(b))",
        """scores AS (SELECT k1, b, query_id, atom_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * (k1 + 1.0) / (tf + k1 * (1 - b + b * doc_len / avg_len)))), 9) AS score
        FROM qterms JOIN postings USING (term) JOIN df USING (term) JOIN docs USING (atom_id) CROSS JOIN stats CROSS JOIN grid GROUP BY 1, 2, 3, 4)""",
        sql.ranked(k=3, keys="k1, b, query_id")) + "SELECT k1, b, query_id, atom_id, score, rank FROM ranked",
    "r18_vocabulary_gap": sql.base(*_IDX) + "SELECT query_id, count(*) AS n_terms, count(*) FILTER (df IS NULL) AS n_gaps, coalesce(string_agg(term, ' ' ORDER BY term) FILTER (df IS NULL), '') AS gap_terms FROM qterms LEFT JOIN df USING (term) GROUP BY 1",
    "r10_dense_knn": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
        FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
        SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "i1_postings": sql.base(*_IDX[:3]) + "SELECT atom_id, term, tf, doc_len FROM postings JOIN docs USING (atom_id)",
    "i1_positions": sql.base(sql.CORPUS) + f"SELECT ts[i] AS term, count(*) AS n, sum(i - 1)::BIGINT AS pos_sum, max(i - 1) AS pos_max FROM (SELECT ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT {sql.tok('body')} AS ts FROM corpus)) GROUP BY 1",
    "i2_body_source": sql.base(sql.CORPUS, sql.ENRICH) + f"SELECT corpus.atom_id, md5(CASE WHEN trim(coalesce(long_desc, ''), ' ') = '' THEN coalesce(body, '') ELSE long_desc END || ' ' || coalesce({_KW('keywords')}, '')) AS body_md5 FROM corpus LEFT JOIN enr ON lower(trim(corpus.atom_id)) = enr.atom_id",
    "i3_novel_keywords": sql.base(sql.CORPUS, sql.ENRICH, _NOVEL) + "SELECT atom_id, array_to_string(kept, '|') AS kept, array_to_string(dropped, '|') AS dropped FROM novel",
    "i4_keyword_census": sql.base(sql.CORPUS, sql.ENRICH, _NOVEL) + "SELECT sum(len(kept))::BIGINT AS kept, sum(len(dropped))::BIGINT AS dropped FROM novel",
    "i5_empty_bodies": sql.base(sql.CORPUS) + "SELECT count(*) FILTER (trim(coalesce(body, '')) = '') AS empty_bodies, count(*) AS atoms FROM corpus",
    "i8_corpus_stats": sql.base(*_IDX[:3]) + "SELECT n_docs, round(avg_len, 9) AS avg_len FROM stats",
    "i9_vocabulary": sql.base(*_IDX[:3]) + "SELECT term, df FROM df",
    "i10_commonest_terms": sql.base(*_IDX[:3]) + "SELECT term, df FROM df ORDER BY df DESC, term LIMIT 50",
    "i10_rarest_terms": sql.base(*_IDX[:3]) + "SELECT atom_id, place, term, df FROM (SELECT atom_id, term, df, row_number() OVER (PARTITION BY atom_id ORDER BY df, term) AS place FROM postings JOIN df USING (term)) WHERE place <= 5",
    "i11_filler_strip": sql.base(*_IDX[:3], "common AS (SELECT list(term) AS c FROM (SELECT term FROM df ORDER BY df DESC, term LIMIT 50))") + f"SELECT query_id, array_to_string(list_filter({sql.tok('query_text')}, lambda t: NOT list_contains(c, t)), ' ') AS stripped FROM queries CROSS JOIN common",
}
