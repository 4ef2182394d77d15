"""Exact token counts under an existing public tokenizer and their totals by cube."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.languages import host_key, label_language
from corvane.session import cut

#: A byte-level BPE rank file; its path is a parameter of every operator here.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges of such a rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once a worker: the copy that was shipped with the job, else the file itself."""
    import tiktoken

    with open(_local(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _local(path: str) -> str:
    try:
        shipped = SparkFiles.get(os.path.basename(path))
    except Exception:  # no Spark in this process
        return path
    return shipped if os.path.exists(shipped) else path


def ship(spark: SparkSession, path: str) -> None:
    """Send the rank file to every worker, once an application."""
    if (key := (spark.sparkContext.applicationId, path)) not in _shipped:
        spark.sparkContext.addFile(path)
        _shipped.add(key)


_shipped: set[tuple[str, str]] = set()


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            once = batch.column(at).dictionary_encode()  # a text that comes again in a batch is encoded once
            sizes = np.array([0, *map(len, enc.encode_ordinary_batch([_valid(t) for t in once.dictionary.to_pylist()], num_threads=1))], np.int64)
            n = sizes[once.indices.fill_null(-1).to_numpy() + 1]
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(n, pa.int64())], [*(batch.schema.field(i).name for i in keep), "n_tokens"])

    return run


def _valid(text: str) -> str:
    """Lone surrogates, which UTF-8 cannot hold, become replacement characters."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def with_token_counts(df: DataFrame, text: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns of df (without its text, unless selected) and n_tokens of the text expression.

    Exact over the whole text; null has 0 tokens, as has the empty text. One narrow stage: only what df selects goes
    through the workers, and a batch is at most what spark.sql.execution.arrow.maxBytesPerBatch allows.
    """
    ship(df.sparkSession, tokenizer)
    extra = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "_text")
    return df.withColumn("_text", text).mapInArrow(_count(tokenizer), f"{extra}, n_tokens long")


def token_cube(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Documents and tokens for every combination of the keys; the key is null and its bit in `level` set where it is totalled.

    The finest groups are aggregated first, so the cube expands groups, not documents. A hot group is pre-aggregated in each task.
    """
    fine = counted.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    return fine.cube(*keys).agg(F.grouping_id().alias("level"), F.sum("n").alias("n_docs"), F.sum("t").alias("n_tokens"))


def clean_label(column: Column, missing: str = "(none)") -> Column:
    """Spellings of a label brought together; null and blank become `missing`."""
    key = F.regexp_replace(F.lower(F.regexp_replace(column, r"^[\s ​﻿]+|[\s ​﻿]+$", "")), r"[_\s ]+", "-")
    return F.coalesce(F.nullif(key, F.lit("")), F.lit(missing))


def document_path(column: Column, missing: str = "(none)") -> Column:
    """A source path without outer white space, with '/' for a backslash, without a leading './', in lower case."""
    p = F.regexp_replace(F.lower(F.trim(F.regexp_replace(column, r"\\", "/"))), r"^\./", "")
    return F.coalesce(F.nullif(p, F.lit("")), F.lit(missing))


def document_counts(docs: DataFrame, codes: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a document: doc_id, n_tokens and its labels. A label that lang_codes lacks counts as 'und'."""
    rows = label_language("lang", codes, docs.select("doc_id", "text", "lang", "source", "x_domain"))
    rows = rows.select("doc_id", F.col("text").alias("_text"), clean_label(host_key("source")).alias("source"), F.coalesce("label_lang", F.lit("und")).alias("language"), clean_label(F.col("x_domain")).alias("x_domain"))
    return with_token_counts(rows, F.col("_text"), tokenizer)


def row_key(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row, nulls told apart from absent values."""
    whole = [x for f in df.columns for x in (F.col(f"`{f}`").isNull(), F.col(f"`{f}`"))]
    return [F.xxhash64(F.lit(seed), *whole).alias(f"_row{seed}") for seed in (1, 2)]


def atom_counts(atoms: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each row of atoms, exact repeats once: atom_id with the times it was there, n_tokens and its labels.

    Repeats are told by hashes of all columns of atoms, so rows that differ in any of them stay apart.
    """
    rows = atoms.select(
        F.col("body").alias("_text"),
        document_path(F.get("sources", F.lit(0))).alias("source"),
        clean_label(F.col("x_domain")).alias("x_domain"),
        clean_label(F.col("atom_type")).alias("atom_type"),
        "atom_id",
        "ingested_at",
        "removed_at",
        *row_key(atoms),
    )
    return with_token_counts(rows, F.col("_text"), tokenizer).dropDuplicates(["_row1", "_row2"]).drop("_row1", "_row2")


def token_counts(docs: DataFrame, atoms: DataFrame, codes: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The counts of single texts in one table, written to the checkpoint folder: (slice_of, doc_id, atom_id, ingested_at, removed_at, source, language, x_domain, atom_type, n_tokens)."""
    d = document_counts(docs, codes, tokenizer).withColumn("slice_of", F.lit("documents"))
    a = atom_counts(atoms, tokenizer).withColumn("slice_of", F.lit("atoms"))
    columns = ("slice_of", "doc_id", "atom_id", "ingested_at", "removed_at", "source", "language", "x_domain", "atom_type", "n_tokens")
    return cut(d.unionByName(a, allowMissingColumns=True).select(*columns))


def document_budget(docs: DataFrame, codes: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Totals of documents by source, language and x_domain."""
    return token_cube(document_counts(docs, codes, tokenizer), ["source", "language", "x_domain"])


def token_budget(docs: DataFrame, atoms: DataFrame, codes: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Both cubes of the table of counts in one table: (slice_of, source, language, x_domain, atom_type, level, n_docs, n_tokens).

    Documents are totalled by source, language and x_domain, atoms by source document, x_domain and atom_type.
    """
    counted, null = token_counts(docs, atoms, codes, tokenizer), F.lit(None).cast("string")
    d = token_cube(counted.where("slice_of = 'documents'"), ["source", "language", "x_domain"]).select(F.lit("documents").alias("slice_of"), "source", "language", "x_domain", null.alias("atom_type"), "level", "n_docs", "n_tokens")
    a = token_cube(counted.where("slice_of = 'atoms'"), ["source", "x_domain", "atom_type"]).select(F.lit("atoms").alias("slice_of"), "source", null.alias("language"), "x_domain", "atom_type", "level", "n_docs", "n_tokens")
    return d.unionByName(a)
