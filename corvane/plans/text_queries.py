"""Queries of the text functions and of ingestion over the document and atom tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import chunking, ingest
from corvane.operators import deliver as dv
from corvane.operators import index as ix
from corvane.plans import sql
from corvane.plans.rank_queries import corpus, queries_of
from corvane.session import spread, table
from corvane.sources import markdown


def _docs(spark: SparkSession, d: str, *columns) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *columns)


def _md5(tokens) -> object:
    return F.md5(F.array_join(tokens, " "))


def a1_tokenize(spark, d):
    t = tx.tokenize(F.col("text"))
    return _docs(spark, d, F.size(t).alias("n"), _md5(t).alias("tokens_md5")).where("n is not null and tokens_md5 is not null")


def a2_split_tokens(spark, d):
    t = tx.split_tokens(F.col("text"))
    return _docs(spark, d, _md5(t).alias("tokens_md5"))


def a3_lower_tokens(spark, d):
    return _docs(spark, d, _md5(tx.lower_tokens(tx.split_tokens(F.col("text")))).alias("tokens_md5"))


def a4_fold(spark, d):
    return _docs(spark, d, F.md5(tx.fold(F.col("text"))).alias("folded_md5"))


def a5_porter(spark, d):
    """Stem of each distinct term of all atoms, with the number of occurrences."""
    terms = corpus(spark, d).select(F.explode(tx.tokenize(F.col("body"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return terms.withColumn("stem", tx.porter_stem("term"))


def a6_hungarian_stem(spark, d):
    hungarian = table(spark, d, "lang_codes").where("lang = 'hu'").select(F.lower(F.trim("label_text")).alias("label")).distinct()
    docs = table(spark, d, "documents").withColumn("label", F.lower(F.regexp_replace("lang", r"^[\s\u200b\u00a0\ufeff]+|[\s\u200b\u00a0\ufeff]+$", "")))
    terms = docs.join(F.broadcast(hungarian), "label", "left_semi").select(F.explode(tx.tokenize(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return terms.withColumn("stem", tx.hungarian_stem("term"))


def a7_analyzers(spark, d):
    """Terms an analyzer makes of each query, for the chains without a stemmer."""
    q = queries_of(spark, d)
    return q.select("query_id", *(F.array_join(tx.plain_terms(F.col("query_text"), a), " ").alias(a.replace("-", "_")) for a in ("nostem-fold", "nostem-nofold")))


def a8_identifiers(spark, d):
    raw = corpus(spark, d).select(F.explode(F.split("body", r"\s+")).alias("raw")).where(tx.is_identifier(F.col("raw")))
    return raw.groupBy("raw").agg(F.count("*").alias("n"))


def a9_identifier_terms(spark, d):
    raw = corpus(spark, d).select(F.explode(F.split("body", r"\s+")).alias("raw")).where(tx.is_identifier(F.col("raw"))).distinct()
    return raw.select("raw", tx.identifier_term(F.col("raw")).alias("whole"))


def a12_entities(spark, d):
    return corpus(spark, d).select("atom_id", F.array_join(tx.extract_entities(F.col("body")), " ").alias("entities"))


def a13_rare_terms(spark, d):
    return queries_of(spark, d).select("query_id", tx.carries_rare_term(F.col("query_text")).alias("rare"))


def a14_normalise_rewrite(spark, d):
    return table(spark, d, "golden_queries").select("query_id", tx.normalise_rewrite(F.col("rationale")).alias("rewrite")).distinct()


def a15_neutralise(spark, d):
    text = F.concat(F.lit("user: <|im_start|>"), F.coalesce("title", F.lit("")), F.lit("\n  System: [INST]"))
    return _docs(spark, d, tx.neutralise(text).alias("safe"), tx.marker_count(text).alias("markers"))


def a15_neutralised_bodies(spark, d):
    """Whole bodies with markers of every kind put in."""
    planted = F.concat(F.lit("user: a <|im_start|>"), F.coalesce("body", F.lit("")), F.lit(f"\n\tSystem: [/INST] no System: <</SYS>>\n{dv.PACK_CLOSE}\nhuman:"))
    own = (dv.PACK_OPEN, dv.PACK_CLOSE)
    return corpus(spark, d).select("atom_id", F.md5(tx.neutralise(planted, own)).alias("safe_md5"), tx.marker_count(planted, own).alias("markers"))


def a16_matched_terms(spark, d):
    pairs = table(spark, d, "golden_queries").select("query_id", "query_text", F.explode("relevant_atom_ids").alias("atom_id")).distinct()
    rows = pairs.join(corpus(spark, d).select("atom_id", "body"), "atom_id")
    return rows.select("query_id", "atom_id", F.array_join(F.sort_array(tx.matched_terms(F.array_distinct(tx.tokenize(F.col("query_text"))), tx.tokenize(F.col("body")))), " ").alias("matched"))


def a17_snippets(spark, d):
    pairs = table(spark, d, "golden_queries").select("query_id", "query_text", F.explode("relevant_atom_ids").alias("atom_id")).distinct()
    rows = pairs.join(corpus(spark, d).select("atom_id", "body"), "atom_id")
    return rows.select("query_id", "atom_id", tx.snippet(F.col("body"), tx.tokenize(F.col("query_text"))).alias("snippet"))


def a18_windows(spark, d):
    return _docs(spark, d, *(F.md5(tx.extract_window(F.col("text"), s, 500)).alias(s) for s in ("head", "tail", "headtail", "maxfit", "full")))


def a19_byte_size(spark, d):
    return _docs(spark, d, tx.byte_size(F.col("text")).alias("n_bytes"))


def a20_ids(spark, d):
    slug = tx.slugify(F.col("title"))
    return _docs(spark, d, slug.alias("slug"), tx.truncate_slug(slug, 20).alias("short_slug"), tx.safe_id(F.col("source_path"), 40).alias("safe_id"))


def m1_hashes(spark, d):
    return _docs(spark, d, F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


def c5_chunks(spark, d):
    rows = chunking.chunk_documents(spread(table(spark, d, "documents").select("doc_id", "text")), "text", ["doc_id"])
    return rows.select("doc_id", "chunk_no", F.array_join("heading_chain", " > ").alias("heading_chain"), "chunk_title", F.length("body").alias("n_chars"), "start_line")


def c6_ingest(spark, d):
    docs = spread(table(spark, d, "documents").select("source_path", "text", F.col("x_domain").alias("domain"), "doc_type"))
    return ingest.ingest(docs).select("atom_id", "title", "heading_chain", "x_domain", "atom_type", "origin_index", "origin_count", F.length("body").alias("n_chars"))


def c7_document_title(spark, d):
    return ingest.with_document_title(table(spark, d, "documents"), "text", "source_path", ["doc_id"]).select("doc_id", F.col("doc_title").alias("title"))


def c7_planted_titles(spark, d):
    """Titles where each text begins with a front matter behind a comment, with a fence full of hash marks, or with rules that are no front matter."""
    nl = lambda *x: F.lit("\n".join(x) + "\n")
    title = F.concat(F.lit('title:  "Page '), F.col("doc_id").cast("string"), F.lit('"\n---\n'))
    kind = F.col("doc_id") % 3
    head = F.when(kind == 0, F.concat(nl("<!-- a", "b -->", "", "---", "key: 1"), title)).when(kind == 1, nl("```sh", "# install it", "~~~", "# still", "````")).otherwise(nl("---", "no key", "---"))
    docs = table(spark, d, "documents").withColumn("text", F.concat(head, F.coalesce("text", F.lit(""))))
    return ingest.with_document_title(docs, "text", "source_path", ["doc_id"]).select("doc_id", F.col("doc_title").alias("title"))


def c8_document_summary(spark, d):
    return corpus(spark, d).select("atom_id", ingest.document_summary(F.concat(F.lit("<!-- LLM-PRIMARY:"), F.coalesce("summary", F.lit("")), F.lit(" -->"), F.coalesce("body", F.lit("")))).alias("summary"))


def c8_summary_comments(spark, d):
    """The first summary comment of each document, wherever it stands, its lines joined."""
    half = (F.length("text") / 2).cast("int")
    text = F.concat(F.substring("text", F.lit(1), half), F.lit("\n<!--  LLM-PRIMARY: of\n  "), F.coalesce("title", F.lit("")), F.lit("\n-->\n<!-- LLM-PRIMARY: second -->"), F.substring(F.col("text"), half + 1, F.length("text")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", ingest.document_summary(text).alias("summary"))


def c9_compose_body(spark, d):
    chain = F.split(F.coalesce("heading_chain", F.lit("")), " > ")
    return corpus(spark, d).select("atom_id", F.md5(ingest.compose_body(F.coalesce("body", F.lit("")), chain)).alias("body_md5"))


def c10_shared_titles(spark, d):
    rows = corpus(spark, d).select("atom_id", "title", F.coalesce("heading_chain", F.lit("")).alias("heading_path"), F.get("sources", F.lit(0)).alias("source_path")).where("title is not null and source_path is not null")
    return ingest.disambiguate_titles(rows).select("atom_id", "title")


def c11_colliding_ids(spark, d):
    """Base ids of documents made from their titles; those that collide get a fingerprint."""
    rows = table(spark, d, "documents").where("title is not null").select(F.col("doc_id").alias("chunk_no"), F.coalesce("source_path", F.lit("")).alias("source_path"), F.coalesce("text", F.lit("")).alias("body"), tx.slugify(F.col("title")).alias("base_id"))
    return ingest.resolve_ids(rows).select(F.col("chunk_no").alias("doc_id"), "atom_id")


def c12_label_by_path(spark, d):
    rules = spark.createDataFrame([("docs/", "docs"), ("docs/logs/", "logs"), ("notes/", "notes"), ("wiki/review/", "reviews")], "prefix string, label string")
    rows = corpus(spark, d).select("atom_id", F.get("sources", F.lit(0)).alias("path"))
    return ingest.label_by_path(rows, rules, "path", "label", "other").select("atom_id", "label")


_DOMAIN_RULES = [("docs/", "docs"), ("docs/logs/2024", "logs"), ("notes/re", "reviews"), ("notes/", "notes")]
_TYPE_RULES = [("docs/standard", "standard"), ("docs/", "knowledge"), ("notes/", "note")]
_SEGMENT_RULES = [("feature-log", "feature-log"), ("teaching", "teaching"), ("adr", "adr")]


def c12_path_mapping(spark, d):
    """Domain, type and reason to skip of each atom's source document by a profile's rules."""
    rules = lambda rows: spark.createDataFrame(rows, "prefix string, label string")
    rows = corpus(spark, d).select("atom_id", F.get("sources", F.lit(0)).alias("path"))
    return ingest.map_paths(rows, "path", rules(_DOMAIN_RULES), rules(_TYPE_RULES), _SEGMENT_RULES, "vendor-doc").select("atom_id", "domain", "doc_type", "skip_reason")


_DOMAINS, _TYPES = ["adr", "docs", "misc", "runner", "standards"], ["adr", "benchmark", "brainstorm", "feature-log", "knowledge", "lessons-learned", "paper", "plan", "research", "review", "runner-rule", "standard", "teaching", "vendor-doc"]


def c13_refusals(spark, d):
    rows = table(spark, d, "atoms").distinct()
    return ingest.refusals(rows, _DOMAINS, _TYPES).where("size(reasons) > 0").select("atom_id", "ingested_at", F.array_join("reasons", "; ").alias("reasons"))


def _deduped(spark, d):
    rows = corpus(spark, d).select("atom_id", "body", "sources", "origin_index", F.coalesce(F.get("sources", F.lit(0)), F.col("atom_id")).alias("document"))
    golden = table(spark, d, "golden_queries").select(F.explode("relevant_atom_ids").alias("atom_id")).distinct()
    return ingest.dedupe_bodies(rows, rows.join(golden, "atom_id", "left_semi").select("document"))


def c15_dedupe(spark, d):
    return _deduped(spark, d).select("atom_id", "survivor_id")


def c16_provenance(spark, d):
    return ingest.merge_provenance(_deduped(spark, d).select("survivor_id", "atom_id", "sources")).select("atom_id", F.array_join("sources", "|").alias("sources"))


def c17_renumber(spark, d):
    rows = _deduped(spark, d).where("survivor_id = atom_id").select("atom_id", "document", "origin_index")
    return ingest.renumber_origins(rows).select("atom_id", "new_index", "new_count")


def c18_digest(spark, d):
    return ingest.corpus_digest(corpus(spark, d).select("atom_id", "body"))


def i12_domain_census(spark, d):
    """Atoms and current atoms of each declared or found domain."""
    found = corpus(spark, d).groupBy(F.coalesce("x_domain", F.lit("(none)")).alias("x_domain")).agg(F.count("*").alias("atoms"), F.count_if(F.col("removed_at").isNull()).alias("current"))
    declared = spark.createDataFrame([(x,) for x in (*_DOMAINS, "archive")], "x_domain string").withColumn("declared", F.lit(True))
    return found.join(declared, "x_domain", "full_outer").select("x_domain", F.coalesce("atoms", F.lit(0)).alias("atoms"), F.coalesce("current", F.lit(0)).alias("current"), F.coalesce("declared", F.lit(False)).alias("declared"))


def i13_manifest_tallies(spark, d):
    """Counts by type of each build, from the atoms, beside the manifest's own."""
    own = table(spark, d, "corpus_manifest").groupBy("build_id").agg(F.max("atom_count").alias("manifest_count"))
    made = table(spark, d, "atoms").distinct().groupBy("build_id").agg(F.count("*").alias("atom_rows"), F.count_distinct("atom_id").alias("atom_ids"))
    return made.join(own, "build_id", "full_outer").select("build_id", "atom_rows", "atom_ids", "manifest_count")


def i13_tallies(spark, d):
    """Each build's atoms by type and domain, counted from the atoms and as the manifest states them."""
    made = ingest.tallies(table(spark, d, "atoms").distinct()).withColumnRenamed("n", "counted")
    stated = ingest.manifest_tallies(table(spark, d, "corpus_manifest")).withColumnRenamed("n", "stated")
    return made.join(stated, ["build_id", "kind", "label"], "full_outer").select("build_id", "kind", "label", "counted", "stated")


def i12_file_census(spark, d):
    """Atom files by domain, and those of them that parse, with declared domains that have none."""
    parsed = markdown.parse_atoms(markdown.serialise_atoms(corpus(spark, d).withColumn("sources", F.array_compact("sources"))).withColumnRenamed("path", "source_path"))
    return ingest.domain_census(parsed.select(F.col("x_domain").alias("domain"), "ok"), [*_DOMAINS, "archive"])


def j18_prefix_join(spark, d):
    """The source document that each sidecar id begins with: documents are known by the slugs of their stems."""
    stems = corpus(spark, d).select(tx.slugify(F.regexp_extract(F.get("sources", F.lit(0)), r"([^/]*?)(?:\.md)?$", 1)).alias("doc_id")).where("doc_id <> ''")
    ids = ix.latest_enrichment(table(spark, d, "enrichment")).select("atom_id")
    return ingest.longest_segment_prefix(ids, stems, "atom_id")


def m6_xml(spark, d):
    return _docs(spark, d, F.md5(tx.escape_xml(F.col("text"))).alias("escaped_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        a1_tokenize, a2_split_tokens, a3_lower_tokens, a4_fold, a5_porter, a6_hungarian_stem, a7_analyzers, a8_identifiers, a9_identifier_terms, a12_entities, a13_rare_terms, a14_normalise_rewrite, a15_neutralise, a15_neutralised_bodies, a16_matched_terms, a17_snippets, a18_windows, a19_byte_size, a20_ids, m1_hashes,
        c5_chunks, c6_ingest, c7_document_title, c7_planted_titles, c8_document_summary, c8_summary_comments, c9_compose_body, c10_shared_titles, c11_colliding_ids, c12_label_by_path, c12_path_mapping, c13_refusals, c15_dedupe, c16_provenance, c17_renumber, c18_digest, i12_domain_census, i12_file_census, i13_manifest_tallies, i13_tallies, j18_prefix_join, m6_xml,
    )
}

# --- SQL twins ---------------------------------------------------------------------------------

_WORDS = lambda e, p: f"list_filter(regexp_split_to_array({e}, '{p}'), lambda t: t <> '')"
_MARKS = "[^\\p{L}\\p{N}\\p{M}]+"
_IDENT = "[a-zA-Z0-9][/:_.-]+[a-zA-Z0-9]|[a-z][A-Z]"
_Q = lambda s: s.replace("'", "''")
_SHAPE = lambda t, shapes: f"(length({t}) > 1 AND (" + " OR ".join(f"regexp_matches({t}, '{_Q(s)}')" for s in shapes) + "))"
_STRIP = lambda t, a, b: f"regexp_replace(regexp_replace({t}, '{_Q(a)}', ''), '{_Q(b)}', '')"
_RAWS = f"raws AS (SELECT raw FROM (SELECT unnest(regexp_split_to_array(body, '\\s+')) AS raw FROM corpus) WHERE regexp_matches(raw, '{_IDENT}'))"
_KEY = "sha1(regexp_replace(body, '^#+[ \\t]+[^\\n]*\\n+', ''))"
_DEDUPE = f"""rows0 AS (SELECT atom_id, body, sources, origin_index, coalesce(sources[1], atom_id) AS document FROM corpus),
judged AS (SELECT DISTINCT document FROM rows0 WHERE atom_id IN (SELECT unnest(relevant_atom_ids) FROM golden_queries)),
keyed AS (SELECT *, CASE WHEN document IN (SELECT document FROM judged) THEN 1 ELSE 0 END AS j, CASE WHEN length(body) >= 200 THEN {_KEY} END AS k FROM rows0),
deduped AS (SELECT *, CASE WHEN k IS NULL OR (j = 1 AND n_docs >= 2 AND own = atom_id) THEN atom_id ELSE head END AS survivor_id FROM (
  SELECT *, (SELECT count(DISTINCT document) FROM keyed x WHERE x.k = y.k AND x.j = 1) AS n_docs, min(atom_id) OVER (PARTITION BY k, document, j) AS own,
  first_value(atom_id) OVER (PARTITION BY k ORDER BY j DESC, atom_id) AS head FROM keyed y))"""
_MATTER = "(?s)^(?:[ \\t]*\\n|[ \\t]*<!--.*?-->[^\\n]*\\n)*---\\n(.*?)\\n---(?:\\n|$)"
_BARE = "regexp_replace(regexp_replace(regexp_replace(coalesce(body, ''), '(?s)<!--.*?-->', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|\\s+$', '', 'g')"
_PATH = "array_to_string(list_filter(string_split(coalesce(heading_chain, ''), ' > '), lambda t: trim(t, ' ') <> ''), ' > ')"
_SLUG = "regexp_replace(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"

_MARKS_SQL = r"<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<<<KNOWLEDGE-PACK>>>|<<<END-KNOWLEDGE-PACK>>>"
_ROLES_SQL = r"(?im)^([ \t]*)(System:|Assistant:|User:|Human:)"
_BEGINS = lambda rules, p: "CASE " + " ".join(f"WHEN starts_with({p}, '{x}') THEN '{y}'" for x, y in sorted(rules, key=lambda r: -len(r[0]))) + " END"
_FILE_OK = """coalesce(atom_type <> '' AND atom_id <> '' AND title <> '' AND x_domain <> '' AND status IN ('draft', 'stable', 'deprecated') AND coalesce(regexp_full_match(stale_after, '\\d{4}-\\d\\d-\\d\\d'), true)
    AND coalesce(regexp_full_match(verified_at, '\\d{4}-\\d\\d-\\d\\d'), true) AND coalesce(origin_index >= 0, true) AND coalesce(origin_count >= 0, true) AND len(list_filter(sources, lambda x: x IS NOT NULL)) > 0, false)"""



def _titles_sql(source: str) -> str:
    """Titles of (doc_id, source_path, t). A front matter behind blank lines and comments counts if it has a key line; a fold over the lines keeps the open fence and the first heading outside of one."""
    keyed = "regexp_matches(m, '(?m)^[A-Za-z_][A-Za-z0-9_.-]*:')"
    return sql.base(
        f"src AS (SELECT doc_id, source_path, t, regexp_extract(t, '{_MATTER}', 1) AS m FROM ({source}))",
        f"front AS (SELECT *, CASE WHEN {keyed} THEN regexp_replace(t, '{_MATTER}', '') ELSE t END AS rest, CASE WHEN {keyed} THEN nullif(trim(trim(trim(regexp_extract(m, '(?m)^title:(.*)$', 1)), chr(34) || chr(39))), '') END AS field FROM src)",
        "lines AS (SELECT doc_id, list_transform(string_split(rest, chr(10)), lambda l: {'fence': regexp_extract(l, '^ {0,3}(`{3,}|~{3,})', 1), 'title': CASE WHEN regexp_matches(l, '^#+[ \\t]+') THEN nullif(trim(regexp_extract(l, '^#+[ \\t]+(.*)$', 1), ' ' || chr(9) || chr(13)), '') END}) AS ls FROM front)",
        """heads AS (SELECT doc_id, list_reduce(list_prepend({'fence': '', 'title': CAST(NULL AS VARCHAR)}, ls), lambda a, x: {
            'fence': CASE WHEN x.fence = '' THEN a.fence WHEN a.fence = '' THEN x.fence WHEN x.fence[1] = a.fence[1] AND length(x.fence) >= length(a.fence) THEN '' ELSE a.fence END,
            'title': coalesce(a.title, CASE WHEN a.fence = '' AND x.fence = '' THEN x.title END)}).title AS head FROM lines)""",
    ) + "SELECT doc_id, coalesce(field, head, nullif(replace(regexp_extract(source_path, '([^/]*?)(?:\\.md)?$', 1), '-', ' '), '')) AS title FROM front JOIN heads USING (doc_id)"


ORACLES = {
    "a1_tokenize": f"SELECT doc_id, len(ts) AS n, md5(array_to_string(ts, ' ')) AS tokens_md5 FROM (SELECT doc_id, {sql.tok('text')} AS ts FROM documents WHERE text IS NOT NULL)",
    "a2_split_tokens": f"SELECT doc_id, md5(array_to_string({_WORDS('text', _MARKS)}, ' ')) AS tokens_md5 FROM documents",
    "a3_lower_tokens": f"SELECT doc_id, md5(array_to_string({_WORDS('lower(text)', _MARKS)}, ' ')) AS tokens_md5 FROM documents",
    "a4_fold": "SELECT doc_id, md5(strip_accents(text)) AS folded_md5 FROM documents",
    "a7_analyzers": sql.base(sql.QUERIES) + f"SELECT query_id, array_to_string({sql.tok('query_text')}, ' ') AS nostem_fold, array_to_string({_WORDS('lower(query_text)', _MARKS)}, ' ') AS nostem_nofold FROM queries",
    "a8_identifiers": sql.base(sql.CORPUS, _RAWS) + "SELECT raw, count(*) AS n FROM raws GROUP BY 1",
    "a9_identifier_terms": sql.base(sql.CORPUS, _RAWS) + "SELECT DISTINCT raw, regexp_replace(regexp_replace(replace(strip_accents(lower(raw)), '@', 'at'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS whole FROM raws",
    "a12_entities": sql.base(sql.CORPUS, "bare AS (SELECT atom_id, list_transform(regexp_split_to_array(body, '\\s+'), lambda t: " + _STRIP("t", "^[(\"'`\\[\\]{*_<]+", "[?!.,;:)\"'`\\[\\]{}*_>]+$") + ") AS ts FROM corpus)")
        + f"SELECT atom_id, array_to_string(list_transform(list_filter(range(1, len(ts) + 1), lambda i: {_SHAPE('ts[i]', tx.ENTITY_SHAPES)} AND list_position(ts, ts[i]) = i), lambda i: ts[i]), ' ') AS entities FROM bare",
    "a13_rare_terms": sql.base(sql.QUERIES) + "SELECT query_id, len(list_filter(list_transform(regexp_split_to_array(query_text, '\\s+'), lambda t: " + _STRIP("t", "^[(\"'`]+", "[?!.,;)\"'`]+$") + f"), lambda t: {_SHAPE('t', tx.RARE_SHAPES)})) > 0 AS rare FROM queries",
    "a14_normalise_rewrite": "SELECT DISTINCT query_id, trim(regexp_replace(regexp_replace(lower(coalesce(list_filter(list_transform(string_split(rationale, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1], '')), '[^\\p{L}\\p{N}\\p{M}\\s]+', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS rewrite FROM golden_queries",
    "a15_neutralise": "SELECT doc_id, '[[neutralised:user:]] [[neutralised:<|im_start|>]]' || coalesce(title, '') || chr(10) || '  [[neutralised:System:]] [[neutralised:[INST]]]' AS safe, 4 AS markers FROM documents",
    "a15_neutralised_bodies": sql.base(sql.CORPUS, f"planted AS (SELECT atom_id, 'user: a <|im_start|>' || coalesce(body, '') || chr(10) || chr(9) || 'System: [/INST] no System: <</SYS>>' || chr(10) || '{dv.PACK_CLOSE}' || chr(10) || 'human:' AS t FROM corpus)")
        + f"SELECT atom_id, md5(regexp_replace(regexp_replace(t, '({_MARKS_SQL})', '[[neutralised:\\1]]', 'g'), '{_ROLES_SQL}', '\\1[[neutralised:\\2]]', 'g')) AS safe_md5, (len(regexp_extract_all(t, '{_MARKS_SQL}')) + len(regexp_extract_all(t, '{_ROLES_SQL}')))::INT AS markers FROM planted",
    "a16_matched_terms": sql.base(sql.CORPUS) + f"SELECT query_id, atom_id, array_to_string(list_sort(list_filter(list_distinct({sql.tok('query_text')}), lambda t: list_contains({sql.tok('body')}, t))), ' ') AS matched FROM (SELECT DISTINCT query_id, query_text, unnest(relevant_atom_ids) AS atom_id FROM golden_queries) JOIN corpus USING (atom_id)",
    "a18_windows": "SELECT doc_id, md5(left(text, 500)) AS head, md5(right(text, 500)) AS tail, md5(CASE WHEN length(text) <= 500 THEN text ELSE left(text, 250) || chr(10) || '...' || chr(10) || right(text, 250) END) AS headtail, md5(left(text, 500)) AS maxfit, md5(text) AS \"full\" FROM documents",
    "a19_byte_size": "SELECT doc_id, octet_length(encode(text))::INT AS n_bytes FROM documents",
    "a20_ids": f"""SELECT doc_id, slug, CASE WHEN length(slug) <= 20 OR substr(slug, 21, 1) = '-' THEN left(slug, 20) ELSE regexp_replace(left(slug, 20), '-[^-]*$', '') END AS short_slug,
        CASE WHEN length(s) <= 40 THEN s ELSE left(s, 31) || '-' || left(sha256(source_path), 8) END AS safe_id FROM (SELECT doc_id, source_path, {_SLUG} AS slug, regexp_replace(source_path, '[^A-Za-z0-9_-]', '_', 'g') AS s FROM documents)""",
    "m1_hashes": "SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents",
    "c7_document_title": _titles_sql("SELECT doc_id, source_path, coalesce(text, '') AS t FROM documents"),
    "c7_planted_titles": _titles_sql("SELECT doc_id, source_path, CASE doc_id % 3 WHEN 0 THEN '<!-- a' || chr(10) || 'b -->' || chr(10) || chr(10) || '---' || chr(10) || 'key: 1' || chr(10) || 'title:  \"Page ' || doc_id || '\"' || chr(10) || '---' || chr(10) WHEN 1 THEN '```sh' || chr(10) || '# install it' || chr(10) || '~~~' || chr(10) || '# still' || chr(10) || '````' || chr(10) ELSE '---' || chr(10) || 'no key' || chr(10) || '---' || chr(10) END || coalesce(text, '') AS t FROM documents"),
    "c8_document_summary": sql.base(sql.CORPUS) + "SELECT atom_id, nullif(trim(regexp_replace(regexp_extract('<!-- LLM-PRIMARY:' || coalesce(summary, '') || ' -->' || coalesce(body, ''), '(?s)<!--\\s*LLM-PRIMARY:(.*?)-->', 1), '\\s+', ' ', 'g'), ' '), '') AS summary FROM corpus",
    "c8_summary_comments": "SELECT doc_id, nullif(trim('of ' || trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'), ' '), ' '), '') AS summary FROM documents WHERE text IS NOT NULL",
    "c9_compose_body": sql.base(sql.CORPUS) + f"SELECT atom_id, md5(CASE WHEN p = '' OR length('# ' || p || chr(10) || chr(10) || b) > 4000 THEN b ELSE '# ' || p || chr(10) || chr(10) || b END) AS body_md5 FROM (SELECT atom_id, {_PATH} AS p, {_BARE} AS b FROM corpus)",
    "c10_shared_titles": sql.base(sql.CORPUS) + "SELECT atom_id, CASE WHEN n > 1 AND coalesce(heading_chain, '') <> '' THEN heading_chain ELSE title END AS title FROM (SELECT atom_id, title, heading_chain, (SELECT count(DISTINCT y.sources[1]) FROM corpus y WHERE y.title = x.title) AS n FROM corpus x WHERE title IS NOT NULL AND sources[1] IS NOT NULL)",
    "c11_colliding_ids": f"""SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY slug) = 1 THEN slug ELSE slug || '-' || left(sha1(coalesce(source_path, '') || chr(0) || doc_id || chr(0) || coalesce(text, '')), 8) END AS atom_id FROM (SELECT *, {_SLUG} AS slug FROM documents WHERE title IS NOT NULL)""",
    "c12_label_by_path": sql.base(sql.CORPUS) + "SELECT atom_id, CASE WHEN starts_with(p, 'docs/logs/') THEN 'logs' WHEN starts_with(p, 'docs/') THEN 'docs' WHEN starts_with(p, 'notes/') THEN 'notes' WHEN starts_with(p, 'wiki/review/') THEN 'reviews' ELSE 'other' END AS label FROM (SELECT atom_id, sources[1] AS p FROM corpus)",
    "c12_path_mapping": sql.base(sql.CORPUS, f"p AS (SELECT atom_id, sources[1] AS p, {_BEGINS(_DOMAIN_RULES, 'sources[1]')} AS domain FROM corpus)")
        + "SELECT atom_id, domain, CASE " + " ".join(f"WHEN list_contains(string_split(p, '/'), '{x}') THEN '{y}'" for x, y in _SEGMENT_RULES) + f" ELSE coalesce({_BEGINS(_TYPE_RULES, 'p')}, 'vendor-doc') END AS doc_type, CASE WHEN domain IS NULL THEN 'no domain rule claims ' || coalesce(p, 'a document without a path') END AS skip_reason FROM p",
    "c13_refusals": """WITH r AS (SELECT DISTINCT * FROM atoms), n AS (SELECT atom_id, count(*) AS n FROM r GROUP BY 1)
        SELECT atom_id, ingested_at, array_to_string(reasons, '; ') AS reasons FROM (SELECT r.atom_id, ingested_at, list_filter([
          CASE WHEN NOT coalesce(regexp_full_match(r.atom_id, '[a-z0-9]+(-[a-z0-9]+)*'), false) THEN 'id is no slug' END, CASE WHEN NOT coalesce(n.n = 1, false) THEN 'id is not unique' END,
          CASE WHEN NOT coalesce(length(body) + length(regexp_replace(body, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) <= 4000, false) THEN 'body exceeds the size limit' END,
          CASE WHEN NOT coalesce(x_domain IN (""" + ", ".join(f"'{x}'" for x in _DOMAINS) + """), false) THEN 'unknown domain' END, CASE WHEN NOT coalesce(atom_type IN (""" + ", ".join(f"'{x}'" for x in _TYPES) + """), false) THEN 'unknown type' END,
          CASE WHEN NOT coalesce(len(sources) > 0, false) THEN 'no source' END, CASE WHEN NOT coalesce(trim(body, ' ') <> '', false) THEN 'empty body' END], lambda x: x IS NOT NULL) AS reasons
        FROM r LEFT JOIN n ON r.atom_id IS NOT DISTINCT FROM n.atom_id) WHERE len(reasons) > 0""",
    "c15_dedupe": sql.base(sql.CORPUS, _DEDUPE) + "SELECT atom_id, survivor_id FROM deduped",
    "c16_provenance": sql.base(sql.CORPUS, _DEDUPE) + """SELECT atom_id, string_agg(source, '|' ORDER BY copy, first_id, pos) AS sources FROM (
        SELECT survivor_id AS atom_id, source, min(copy) AS copy, arg_min(atom_id, (copy, atom_id, pos)) AS first_id, arg_min(pos, (copy, atom_id, pos)) AS pos FROM (
          SELECT survivor_id, atom_id, CASE WHEN atom_id <> survivor_id THEN 1 ELSE 0 END AS copy, i AS pos, sources[i] AS source FROM (SELECT survivor_id, atom_id, sources, unnest(range(1, len(sources) + 1)) AS i FROM deduped)) GROUP BY 1, 2) GROUP BY 1""",
    "c17_renumber": sql.base(sql.CORPUS, _DEDUPE) + "SELECT atom_id, (row_number() OVER (PARTITION BY document ORDER BY origin_index ASC NULLS LAST, atom_id) - 1)::INT AS new_index, (count(*) OVER (PARTITION BY document))::INT AS new_count FROM deduped WHERE survivor_id = atom_id",
    "c18_digest": sql.base(sql.CORPUS, "leaves AS (SELECT left(sha1(atom_id), 2) AS bucket, substr(sha1(atom_id), 3, 4) AS sub, sha256(string_agg(atom_id || chr(0) || sha256(coalesce(body, '')), chr(10) ORDER BY atom_id || chr(0) || sha256(coalesce(body, '')))) AS h FROM corpus GROUP BY 1, 2)",
        "buckets AS (SELECT bucket, sha256(string_agg(h, chr(10) ORDER BY sub)) AS h FROM leaves GROUP BY 1)") + "SELECT sha256(string_agg(h, chr(10) ORDER BY bucket)) AS digest FROM buckets",
    "i12_domain_census": sql.base(sql.CORPUS) + "SELECT coalesce(f.x_domain, d.x_domain) AS x_domain, coalesce(atoms, 0) AS atoms, coalesce(current, 0) AS current, d.x_domain IS NOT NULL AS declared FROM (SELECT coalesce(x_domain, '(none)') AS x_domain, count(*) AS atoms, count(*) FILTER (removed_at IS NULL) AS current FROM corpus GROUP BY 1) f FULL JOIN (VALUES " + ", ".join(f"('{x}')" for x in (*_DOMAINS, "archive")) + ") d(x_domain) ON f.x_domain = d.x_domain",
    "i13_manifest_tallies": "SELECT coalesce(a.build_id, m.build_id) AS build_id, atom_rows, atom_ids, manifest_count FROM (SELECT build_id, count(*) AS atom_rows, count(DISTINCT atom_id) AS atom_ids FROM (SELECT DISTINCT * FROM atoms) GROUP BY 1) a FULL JOIN (SELECT build_id, max(atom_count) AS manifest_count FROM corpus_manifest GROUP BY 1) m ON a.build_id = m.build_id",
    "i12_file_census": sql.base(sql.CORPUS, f"f AS (SELECT x_domain, count(*) AS files, count(*) FILTER ({_FILE_OK}) AS indexed FROM corpus WHERE x_domain IS NOT NULL GROUP BY 1)")
        + "SELECT coalesce(f.x_domain, d.x_domain) AS domain, coalesce(files, 0) AS files, coalesce(indexed, 0) AS indexed, d.x_domain IS NOT NULL AS declared, coalesce(files > 0 AND indexed = 0, false) AS dropped FROM f FULL JOIN (VALUES " + ", ".join(f"('{x}')" for x in (*_DOMAINS, "archive")) + ") d(x_domain) ON f.x_domain = d.x_domain",
    "i13_tallies": """WITH a AS (SELECT DISTINCT * FROM atoms), made AS (SELECT build_id, 'type' AS kind, atom_type AS label, count(*) AS counted FROM a WHERE atom_type IS NOT NULL GROUP BY ALL UNION ALL SELECT build_id, 'domain', x_domain, count(*) FROM a WHERE x_domain IS NOT NULL GROUP BY ALL),
        e AS (SELECT build_id, 'type' AS kind, unnest(map_entries(by_type)) AS e FROM corpus_manifest UNION ALL SELECT build_id, 'domain', unnest(map_entries(by_domain)) FROM corpus_manifest), stated AS (SELECT build_id, kind, e.key AS label, max(e.value) AS stated FROM e GROUP BY ALL)
        SELECT build_id, kind, label, counted, stated FROM made FULL JOIN stated USING (build_id, kind, label)""",
    "j18_prefix_join": sql.base(sql.CORPUS, sql.ENRICH, "stems AS (SELECT DISTINCT regexp_replace(regexp_replace(strip_accents(lower(regexp_extract(sources[1], '([^/]*?)(?:\\.md)?$', 1))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM corpus)")
        + "SELECT atom_id, (SELECT arg_max(s, length(s)) FROM stems WHERE s <> '' AND (enr.atom_id = s OR starts_with(enr.atom_id, s || '-'))) AS found_id FROM enr",
    "m6_xml": "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&apos;')) AS escaped_md5 FROM documents",
}
