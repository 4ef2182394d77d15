"""Queries of run formats, run comparison and enrichment quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.api import SearchRequest, search
from corvane.functions import text as tx
from corvane.operators import chunking, evaluate, ingest, rank, runs
from corvane.operators import index as ix
from corvane.plans import sql
from corvane.plans.eval_queries import _QRELS, _RUNS, PROFILE, qrels, run_rankings, run_rows
from corvane.plans.rank_queries import corpus, queries_of
from corvane.plans.text_queries import _DEDUPE, _FILE_OK, _deduped
from corvane.session import table
from corvane.sources import evaluation, markdown



def s18_trec_roundtrip(spark, d):
    """Each run of run_hits written as TREC lines and read back strictly."""
    hits = run_rankings(spark, d).withColumn("query_id", F.concat_ws("@", "query_id", "run_tag"))
    return evaluation.parse_trec(evaluation.format_trec(hits, "run")).select("query_id", "doc_id", "rank", "score", "tag")


def s14_golden_dataset(spark, d):
    return evaluation.golden_dataset(corpus(spark, d), table(spark, d, "golden_queries").distinct(), ["brainstorm"])[2].select("unreachable", F.round("recall_ceiling", 9).alias("recall_ceiling"))


def s16_materialised(spark, d):
    return evaluation.materialise(table(spark, d, "documents")).select("doc_id", F.md5("text").alias("text_md5"))


def s7_atom_files(spark, d):
    """Each atom serialised as a file and parsed back: what the parser finds."""
    rows = corpus(spark, d).withColumn("status", F.coalesce("status", F.lit("draft"))).withColumn("sources", F.array_compact("sources"))
    files = markdown.serialise_atoms(rows)
    parsed = markdown.parse_atoms(files.withColumnRenamed("path", "source_path"))
    return parsed.groupBy("ok", "status").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))


def e25_provenance_diff(spark, d):
    """Changes of the manifest between a profile's builds."""
    m = table(spark, d, "corpus_manifest").select(F.col("profile").alias("dataset"), F.col("built_at").alias("run_at"), "atom_count", "skipped", "duplicates", "digest").distinct()
    return runs.provenance_diff(m, ["atom_count", "skipped", "duplicates", "digest"], {"duplicates": "0"}, ("digest", "atom_count"))


def w12_manifest_deltas(spark, d):
    m = table(spark, d, "corpus_manifest").select(F.col("profile").alias("dataset"), F.col("built_at").alias("run_at"), F.col("atom_count").cast("double").alias("atom_count"), F.col("skipped").cast("double").alias("skipped")).distinct()
    return runs.metric_deltas(m, ["atom_count", "skipped"])


def _quality(spark, d):
    records = ix.latest_enrichment(table(spark, d, "enrichment")).select("atom_id", "short_desc", "long_desc", "doc_description", "keywords", "entities", "questions")
    return runs.enrichment_quality(records.join(corpus(spark, d).select("atom_id", "body"), "atom_id"), lambda c: tx.plain_terms(c, "nostem-fold"))


def e29_enrichment_quality(spark, d):
    return _quality(spark, d).drop("shared_run")


def e29_shared_runs(spark, d):
    """The longest run of words that a record's long text shares with the first two sentences of its atom."""
    return _quality(spark, d).select("atom_id", "shared_run")


def e37_document_links(spark, d):
    """Documents whose text another document of a smaller id stands for."""
    docs = table(spark, d, "documents").where("source_path is not null").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("atom_id"), F.col("text").alias("body"), F.col("source_path").alias("document"))
    return evaluate.duplicate_links(ingest.dedupe_bodies(docs))


def s21_scores(spark, d):
    """The lines of a scores file for each run."""
    hits = run_rows(spark, d).where("run_tag is not null and doc_id is not null").withColumn("query_id", F.concat_ws("@", "query_id", "run_tag"))
    return evaluation.format_scores(hits)


def s23_enrichment_lines(spark, d):
    """Each current record as a line of the sidecar and read back."""
    e = ix.latest_enrichment(table(spark, d, "enrichment"))
    named = e.select(F.col("body_key").alias("key"), F.col("doc_key").alias("docKey"), F.col("atom_id").alias("id"), F.col("source_path").alias("source"), F.col("prompt_version").alias("promptVersion"), F.col("short_desc").alias("short"), F.col("long_desc").alias("long"), "keywords", "questions")
    back = evaluation.format_enrichment(named).select(F.from_json("value", "id string, key string, short string, long string, promptVersion int, keywords array<string>").alias("r")).select("r.*")
    return back.select("id", "key", F.md5("short").alias("short_md5"), F.md5("long").alias("long_md5"), "promptVersion", F.array_join("keywords", "|").alias("keywords"))


def r18_identifier_gap(spark, d):
    """Vocabulary gaps of queries and of code spans under an analyzer that keeps identifiers whole."""
    spans = corpus(spark, d).select(F.col("atom_id").alias("query_id"), F.array_join(F.regexp_extract_all("body", F.lit("`([^`\\s]+)`"), 1), " ").alias("query_text"))
    idx = ix.Index.build(corpus(spark, d).withColumn("body", F.col("title")), "porter-fold").stored()
    return rank.vocabulary_gap(queries_of(spark, d).unionByName(spans), idx.document_frequency(), "ident-porter-fold")


def e29_quality_gate(spark, d):
    return runs.quality_gate(_quality(spark, d))


def e38_build_health(spark, d):
    e = ix.latest_enrichment(table(spark, d, "enrichment")).select("atom_id", "keywords")
    n = ix.novel_keywords(corpus(spark, d).select("atom_id", "body").join(e, "atom_id"))
    census = n.agg(F.sum(F.size("kept")).alias("kept"), F.sum(F.size("dropped")).alias("dropped"), F.count("*").alias("merged"))
    return runs.build_health(census, F.col("merged"), F.lit(0), F.lit(1)).select("merged", F.round("echo_rate", 9).alias("echo_rate"), "failed")


def r6_identifier_disjuncts(spark, d):
    """Disjuncts of the probes' and golden queries' chunks and of the atoms' code spans, which are full of identifiers."""
    spans = corpus(spark, d).select(F.col("atom_id").alias("query_id"), F.array_join(F.regexp_extract_all("body", F.lit("`([^`\\s]+)`"), 1), " ").alias("query_text"))
    return rank.identifier_disjuncts(queries_of(spark, d).unionByName(spans)).select("query_id", "disjunct", F.array_join("terms", " ").alias("terms"))


def e23_soundness(spark, d):
    docs = table(spark, d, "documents").where("source_path is not null").select(F.col("source_path").alias("doc_id"), "text")
    made = chunking.chunk_documents(docs, "text", ["doc_id"]).where("trim(body) <> ''")
    return evaluate.soundness(docs, made)


def e37_duplicate_links(spark, d):
    return evaluate.duplicate_links(_deduped(spark, d))


def e36_repointed_qrels(spark, d):
    """Judgments of atoms moved to the atom that stands for their body."""
    links = _deduped(spark, d).where("survivor_id <> atom_id").select(F.lower("atom_id").alias("doc_id"), F.lower("survivor_id").alias("survivor"))
    return evaluate.repoint(qrels(spark, d), links)


def search_delivered(spark, d):
    """The whole pipeline for every query: score, filter, cap, order, fit the budget."""
    request = SearchRequest(k=8, ranker="body", analyzer="nostem-fold", domains=["docs", "runner", "standards"], budget=12_000, as_of="2025-06-30")
    return search(queries_of(spark, d), corpus(spark, d), request).select("query_id", "atom_id", "document", "rank", "place", "score")


def search_hybrid(spark, d):
    """The whole pipeline with a lexical and a dense leg over hashed term vectors."""
    vectors = rank.hashed_vectors(corpus(spark, d), "atom_id", tx.tokenize(F.col("body")))
    asked = rank.hashed_vectors(queries_of(spark, d), "query_id", tx.tokenize(F.col("query_text")))
    request = SearchRequest(k=8, ranker="hybrid", analyzer="nostem-fold", budget=12_000, overhead=600, as_of="2025-06-30")
    return search(queries_of(spark, d), corpus(spark, d), request, PROFILE, vectors, asked).select("query_id", "atom_id", "document", "rank", "place", "score")


QUERIES = {f.__name__: f for f in (e29_shared_runs, e37_document_links, s21_scores, s23_enrichment_lines, r18_identifier_gap, search_hybrid, s7_atom_files, s14_golden_dataset, s16_materialised, s18_trec_roundtrip, e25_provenance_diff, w12_manifest_deltas, e29_enrichment_quality, e29_quality_gate, e38_build_health, r6_identifier_disjuncts, e23_soundness, e36_repointed_qrels, e37_duplicate_links, search_delivered)}

_M = "m AS (SELECT DISTINCT profile AS dataset, built_at AS run_at, atom_count, skipped, duplicates, digest FROM corpus_manifest)"
_DIFF = lambda f, c, kind: f"SELECT dataset, run_at, '{f}' AS field, '{kind}' AS kind, lag({c}) OVER w AS before, {c} AS after, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY dataset ORDER BY run_at)"
_BLANK = lambda c: f"trim(coalesce({c}, ''), ' ') = ''"
_ANYBLANK = lambda c: f"coalesce(len(list_filter({c}, lambda x: x IS NULL OR trim(x, ' ') = '')) > 0, false)"
_KWL = "coalesce(list_filter(keywords, lambda x: x IS NOT NULL), [])"

ORACLES = {
    "s18_trec_roundtrip": sql.base(_RUNS) + "SELECT query_id || '@' || run_tag AS query_id, doc_id, rank::INT AS rank, (count(*) OVER (PARTITION BY query_id, run_tag) - rank + 1)::DOUBLE AS score, 'run' AS tag FROM hits",
    "s14_golden_dataset": sql.base(sql.CORPUS, "qr AS (SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, unnest(relevant_atom_ids) AS doc_id FROM golden_queries) WHERE doc_id IS NOT NULL)", "dd AS (SELECT atom_id AS doc_id FROM corpus WHERE NOT coalesce(atom_type = 'brainstorm', false))")
        + "SELECT sum(lost)::BIGINT AS unreachable, round(avg(ceiling), 9) AS recall_ceiling FROM (SELECT query_id, count(*) FILTER (dd.doc_id IS NULL) AS lost, count(dd.doc_id) / count(*) AS ceiling FROM qr LEFT JOIN dd USING (doc_id) GROUP BY 1)",
    "s16_materialised": "SELECT doc_id, md5('# ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN title ELSE text END, '') || chr(10)) AS text_md5 FROM documents",
    "e25_provenance_diff": sql.base(_M) + "SELECT dataset, run_at, field, kind, before, after FROM (" + " UNION ALL ".join((_DIFF("atom_count", "atom_count::VARCHAR", "scale"), _DIFF("skipped", "skipped::VARCHAR", "treatment"), _DIFF("duplicates", "coalesce(duplicates::VARCHAR, '0')", "treatment"), _DIFF("digest", "digest", "scale"))) + ") WHERE n > 1 AND before IS DISTINCT FROM after",
    "w12_manifest_deltas": sql.base("m AS (SELECT DISTINCT profile AS dataset, built_at AS run_at, atom_count::DOUBLE AS a, skipped::DOUBLE AS s FROM corpus_manifest)") + "SELECT dataset, run_at, da AS atom_count_delta, ds AS skipped_delta, CASE WHEN da IS NULL THEN 'first' WHEN da >= -0.01 THEN 'pass' ELSE 'fail' END AS gate FROM (SELECT dataset, run_at, a - lag(a) OVER w AS da, s - lag(s) OVER w AS ds FROM m WINDOW w AS (PARTITION BY dataset ORDER BY run_at))",
    "e29_enrichment_quality": sql.base(sql.CORPUS, sql.ENRICH) + f"""SELECT atom_id, {_BLANK('short_desc')} OR {_BLANK('long_desc')} OR {_BLANK('doc_description')} OR coalesce(len(keywords), 0) <= 0 OR coalesce(len(questions), 0) <= 0 OR {_ANYBLANK('keywords')} OR {_ANYBLANK('entities')} OR {_ANYBLANK('questions')} AS empty_field,
        len(list_filter(regexp_split_to_array(trim(coalesce(short_desc, ''), ' '), '\\s+'), lambda w: w <> '')) > 25 AS long_short, NOT coalesce(len(questions), 0) BETWEEN 12 AND 15 AS bad_questions, coalesce(len(keywords), 0) <> 10 AS bad_keywords,
        regexp_matches(coalesce(short_desc, ''), '(?i)\\b(this|the)\\s+(document|fragment|text|passage|article|section)\\b') AS generality,
        len(list_filter({_KWL}, lambda k: len(list_filter({sql.tok('k')}, lambda t: list_contains(bt, t))) = 0)) AS strict_novel, len(list_filter({_KWL}, lambda k: len(list_filter({sql.tok('k')}, lambda t: NOT list_contains(bt, t))) > 0)) AS partial_novel, len({_KWL}) AS n_keywords
        FROM (SELECT enr.*, {sql.tok('body')} AS bt FROM enr JOIN corpus USING (atom_id))""",
    "e38_build_health": sql.base(sql.CORPUS, sql.ENRICH) + f"SELECT count(*) AS merged, round(sum(dropped) / nullif(sum(n), 0), 9) AS echo_rate, count(*) = 0 AS failed FROM (SELECT len(list_filter({_KWL}, lambda k: len(list_filter({sql.tok('k')}, lambda t: NOT list_contains(bt, t))) = 0)) AS dropped, len({_KWL}) AS n FROM (SELECT keywords, {sql.tok('body')} AS bt FROM enr JOIN corpus USING (atom_id)))",
    "r6_identifier_disjuncts": sql.base(sql.CORPUS, sql.QUERIES, "asked AS (SELECT query_id, query_text FROM queries UNION ALL SELECT atom_id, array_to_string(regexp_extract_all(body, '`([^`\\s]+)`', 1), ' ') FROM corpus)",
        "raws AS (SELECT query_id, i - 1 AS chunk, raw[i] AS raw FROM (SELECT query_id, raw, unnest(range(1, len(raw) + 1)) AS i FROM (SELECT query_id, list_filter(regexp_split_to_array(coalesce(query_text, ''), '\\s+'), lambda x: x <> '') AS raw FROM asked)))",
        f"parts AS (SELECT query_id, chunk, raw, {sql.tok('raw')} AS ts, regexp_replace(regexp_replace(replace(strip_accents(lower(raw)), '@', 'at'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS whole FROM raws)",
    ) + "SELECT query_id, chunk || '.p' AS disjunct, array_to_string(ts, ' ') AS terms FROM parts WHERE len(ts) > 0 UNION ALL SELECT query_id, chunk || '.w', whole FROM parts WHERE regexp_matches(raw, '[a-zA-Z0-9][/:_.-]+[a-zA-Z0-9]|[a-z][A-Z]') AND whole <> '' AND NOT (len(ts) = 1 AND ts[1] = whole)",
    "e36_repointed_qrels": sql.base(sql.CORPUS, _DEDUPE, _QRELS) + "SELECT query_id, coalesce(s, doc_id) AS doc_id, max(grade) AS grade FROM qrels LEFT JOIN (SELECT lower(atom_id) AS doc_id, lower(survivor_id) AS s FROM deduped WHERE survivor_id <> atom_id) USING (doc_id) GROUP BY 1, 2",
    "e37_duplicate_links": sql.base(sql.CORPUS, _DEDUPE, "kept AS (SELECT atom_id AS survivor_id, document AS survivor FROM deduped WHERE survivor_id = atom_id)") + "SELECT document AS doc_id, arg_min(survivor, deduped.atom_id) AS survivor FROM deduped JOIN kept USING (survivor_id) WHERE deduped.survivor_id <> deduped.atom_id AND document NOT IN (SELECT survivor FROM kept) GROUP BY 1",
    "s21_scores": sql.base(_RUNS) + "SELECT query_id || '@' || run_tag AS query_id, rank, query_id || '@' || run_tag || chr(9) || rank || chr(9) || doc_id || chr(9) || coalesce(score::VARCHAR, '') AS value FROM runs WHERE run_tag IS NOT NULL AND doc_id IS NOT NULL",
    "s23_enrichment_lines": sql.base(sql.ENRICH) + "SELECT atom_id AS id, body_key AS key, md5(short_desc) AS short_md5, md5(long_desc) AS long_md5, prompt_version AS \"promptVersion\", coalesce(array_to_string(keywords, '|'), CASE WHEN keywords IS NOT NULL THEN '' END) AS keywords FROM enr",
    "s7_atom_files": sql.base(sql.CORPUS, f"f AS (SELECT {_FILE_OK.replace('status IN', chr(34) + 'st' + chr(34) + ' IN')} AS ok, CASE WHEN true THEN st END AS status, length(regexp_replace(coalesce(body, ''), '^\\n+', '')) AS n FROM (SELECT *, coalesce(status, 'draft') AS st FROM corpus))") + "SELECT ok, status, count(*) AS n, sum(n)::BIGINT AS chars FROM f GROUP BY 1, 2",
    "e37_document_links": """WITH k AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS i, source_path AS p, CASE WHEN length(text) >= 200 THEN sha1(regexp_replace(text, '^#+[ \\t]+[^\\n]*\\n+', '')) END AS k FROM documents WHERE source_path IS NOT NULL),
        s AS (SELECT i, p, CASE WHEN k IS NULL THEN i ELSE min(i) OVER (PARTITION BY k) END AS s FROM k), kept AS (SELECT i AS s, p AS survivor FROM s WHERE i = s)
        SELECT p AS doc_id, arg_min(survivor, i) AS survivor FROM s JOIN kept USING (s) WHERE s.s <> s.i AND p NOT IN (SELECT survivor FROM kept) GROUP BY 1""",
    "e29_shared_runs": sql.base(sql.CORPUS, sql.ENRICH,
        f"""texts AS (SELECT atom_id, {sql.tok('long_desc')} AS a, {sql.tok("array_to_string(string_split(regexp_replace(trim(coalesce(body, ''), ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:2], ' ')")} AS b FROM enr JOIN corpus USING (atom_id))""",
        "x AS (SELECT atom_id, i, a[i] AS t FROM (SELECT atom_id, a, unnest(range(1, len(a) + 1)) AS i FROM texts))", "y AS (SELECT atom_id, j, b[j] AS t FROM (SELECT atom_id, b, unnest(range(1, len(b) + 1)) AS j FROM texts))",
        "met AS (SELECT x.atom_id, i, i - j AS d, i - row_number() OVER (PARTITION BY x.atom_id, i - j ORDER BY i) AS g FROM x JOIN y ON x.atom_id = y.atom_id AND x.t = y.t)",
        "best AS (SELECT atom_id, max(n) AS n FROM (SELECT atom_id, count(*) AS n FROM met GROUP BY atom_id, d, g) GROUP BY 1)",
    ) + "SELECT atom_id, coalesce(n, 0)::INT AS shared_run FROM texts LEFT JOIN best USING (atom_id)",
}
ORACLES["e29_quality_gate"] = f"""WITH q AS (SELECT * FROM ({ORACLES["e29_enrichment_quality"]}) JOIN ({ORACLES["e29_shared_runs"]}) USING (atom_id))
    SELECT count(*) AS records, count(*) FILTER (empty_field) AS empty_fields, count(*) FILTER (long_short) AS long_shorts, count(*) FILTER (bad_questions) AS bad_questions, count(*) FILTER (bad_keywords) AS bad_keywords,
    count(*) FILTER (shared_run >= 8) AS verbatim, count(*) FILTER (shared_run >= 8) < count(*) * 0.12 AS verbatim_pass, count(*) FILTER (generality) AS general, count(*) FILTER (generality) < count(*) * 0.12 AS general_pass,
    round(sum(strict_novel) / nullif(sum(n_keywords), 0), 9) AS strict_novelty, round(sum(partial_novel) / nullif(sum(n_keywords), 0), 9) AS partial_novelty FROM q"""
