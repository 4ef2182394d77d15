"""Pieces of the SQL twins: the same relations, written independently for DuckDB."""

from __future__ import annotations

CORPUS = """corpus AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY atom_id ORDER BY ingested_at DESC NULLS LAST, removed_at DESC NULLS FIRST, body DESC NULLS LAST) AS rn
    FROM atoms WHERE atom_id IS NOT NULL) WHERE rn = 1)"""

ENRICH = """enr AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT * EXCLUDE (atom_id), id AS atom_id, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, record_no DESC) AS rn
    FROM (SELECT *, nullif(lower(trim(atom_id)), '') AS id FROM enrichment) WHERE id IS NOT NULL) WHERE rn = 1)"""

QUERIES = """queries AS (SELECT DISTINCT query_id, query_text FROM golden_queries UNION SELECT probe_id, query_text FROM probes)"""


def tok(expr: str) -> str:
    """Lower-case folded words."""
    return f"list_filter(regexp_split_to_array(strip_accents(lower(coalesce({expr}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


#: Terms of title and body, by document, with lengths and statistics.
INDEX = f"""tokens AS (SELECT atom_id, {tok("coalesce(title, '') || ' ' || coalesce(body, '')")} AS ts FROM corpus),
docs AS (SELECT atom_id, len(ts) AS doc_len FROM tokens),
postings AS (SELECT atom_id, term, count(*) AS tf FROM (SELECT atom_id, unnest(ts) AS term FROM tokens) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
stats AS (SELECT count(*) AS n_docs, coalesce(avg(doc_len), 0) AS avg_len FROM docs)"""

QTERMS = f"""qterms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tok("query_text")}) AS term FROM queries) GROUP BY 1, 2)"""


def scores(weight: str = "1", k1: str = "1.2", b: str = "0.75", extra: str = "", name: str = "scores", terms: str = "qterms") -> str:
    """BM25 with the smoothed idf, rounded as in the operators."""
    return f"""{name} AS (
  SELECT query_id, atom_id, round(sum({weight} * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * ({k1} + 1.0) / (tf + {k1} * (1 - {b} + {b} * doc_len / avg_len)) {extra})), 9) AS score
  FROM {terms} JOIN postings USING (term) JOIN df USING (term) JOIN docs USING (atom_id) CROSS JOIN stats GROUP BY 1, 2 HAVING score > 0)"""


def ranked(source: str = "scores", k: int = 10, name: str = "ranked", keys: str = "query_id", id_col: str = "atom_id") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, {id_col}) AS rank FROM {source}) WHERE rank <= {k})"


def base(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
