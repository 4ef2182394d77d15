"""Registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import answer_defects, languages, mixing, near_duplicates, packing, splitting, tokens
from corvane.session import cut, spread, table


def texts(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """The given columns of a table of texts, or all of them, over all cores."""
    return spread(table(spark, d, name).select(*columns or "*"))


DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "source_path", "x_domain")
ENRICHMENT_COLUMNS = ("record_no", "short_desc", "long_desc", "keywords", "questions")


def _p1_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    atoms = texts(spark, d, "atoms", "atom_id", "body").where(F.length("body") >= 200)
    return near_duplicates.near_duplicate_links(atoms, "atom_id", "body", threshold=0.7, words=3)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = _p1_parts(spark, d)
    return near_duplicates.record_pairs(members, links).select(F.col("id_a").alias("atom_id_a"), F.col("id_b").alias("atom_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    members, links = _p1_parts(spark, d)
    return near_duplicates.near_duplicate_groups(members, links)


def _p2_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return texts(spark, d, "documents", *DOCUMENT_COLUMNS), texts(spark, d, "atoms"), table(spark, d, "lang_codes")


def p2_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_budget(*_p2_parts(spark, d))


def p2_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(*_p2_parts(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    model = languages.fit_text_model(texts(spark, d, "documents", "doc_id", "text", "lang"), table(spark, d, "lang_codes"))
    return answer_defects.answer_defects(texts(spark, d, "enrichment", *ENRICHMENT_COLUMNS), model)


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return answer_defects.defect_counts(p4_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.atom_pieces(table(spark, d, "atoms"), with_text=False)
    return pieces.where("piece_no = 0 and n_pieces > 1").select("atom_id").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.atom_pieces(table(spark, d, "atoms"))


def p5_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each oversized body make up, against the body itself."""
    once = table(spark, d, "atoms").select("atom_id", "body", F.md5("body").alias("source_md5")).dropDuplicates(["atom_id", "source_md5"])
    return splitting.rebuilt(splitting.split_oversized(once, "body", ["atom_id", "source_md5"]), ["atom_id", "source_md5"])


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d, "documents", "doc_id", "text").withColumnRenamed("text", "_text")
    return packing.pack(tokens.with_token_counts(docs, F.col("_text")), "doc_id", "n_tokens")


def _p7_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = mixing.sized_documents(texts(spark, d, "documents", "doc_id", "source", "text"), tokens.TOKENIZER)
    rates = cut(mixing.source_rates(sized, table(spark, d, "mix_targets")))
    return mixing.mix(sized, rates, "doc_id"), rates


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _p7_parts(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(*_p7_parts(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.language_cases(languages.detect_languages(texts(spark, d, "documents", *DOCUMENT_COLUMNS), table(spark, d, "lang_codes")))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    found = languages.detect_languages(texts(spark, d, "documents", *DOCUMENT_COLUMNS), table(spark, d, "lang_codes"))
    return found.select("doc_id", "lang", "confidence", "n_words")


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    found = languages.detect_languages(texts(spark, d, "documents", *DOCUMENT_COLUMNS), table(spark, d, "lang_codes"))
    return found.select("doc_id", F.posexplode("segments").alias("segment_no", "s")).select("doc_id", "segment_no", "s.start", "s.stop", "s.n_words", "s.lang", "s.confidence")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_token_budget, p2_token_counts, p4_found, p4_counts, p5_found, p5_pieces, p5_rebuilt, p6_containers, p7_mixture, p7_shares, p8_found, p8_languages, p8_segments)}


def oracle_sql() -> dict[str, str]:
    return {
        # Exact likeness of all pairs that share a run of three words.
        "p1_found": """WITH b AS (SELECT DISTINCT atom_id, body FROM atoms WHERE atom_id IS NOT NULL AND length(body) >= 200),
            w AS (SELECT atom_id, row_number() OVER (ORDER BY atom_id, body) AS r, regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+') AS ws FROM b),
            s AS (SELECT DISTINCT r, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
            n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
            c AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.r < y.r GROUP BY 1, 2)
            SELECT DISTINCT least(x.atom_id, y.atom_id) AS atom_id_a, greatest(x.atom_id, y.atom_id) AS atom_id_b
            FROM c JOIN n na ON na.r = a JOIN n nb ON nb.r = b JOIN w x ON x.r = a JOIN w y ON y.r = b
            WHERE x.atom_id <> y.atom_id AND c >= 0.7 * (na.n + nb.n - c)""",
        "p5_rebuilt": "SELECT DISTINCT atom_id, md5(body) AS source_md5, md5(body) AS body_md5, true AS within_limit, true AS overlaps_hold, true AS all_there FROM atoms WHERE length(body) + length(regexp_replace(body, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) > 4000",
        "p5_found": "SELECT DISTINCT atom_id FROM atoms WHERE length(body) + length(regexp_replace(body, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) > 4000",
    }
