"""Markdown corpora and atom files: readers that list before they read, and the sink."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The front matter's keys in their canonical order.
REQUIRED = ("type", "id", "title", "x_domain", "status")
OPTIONAL = ("summary", "heading_chain", "origin_index", "origin_count", "stale_after", "verified_by", "verified_at")
STATUSES = ("draft", "stable", "deprecated")

ATOM_SCHEMA = "path string, ok boolean, error string, " + ", ".join(f"{k} string" for k in (*REQUIRED, *OPTIONAL)) + ", sources array<string>, body string"


def read_markdown(spark: SparkSession, roots: list[str], exclude: tuple[str, ...] = (), base: str = "") -> DataFrame:
    """(source_path, text) of every *.md file under the roots (folders, files or globs), each file once.

    A root without any file is refused. Excluded prefixes of source_path are filtered on the file's name, which Spark applies
    before a file is opened. source_path is relative to base where the file lies under it.
    """
    if not roots:
        raise ValueError("no roots")
    parts = []
    for root in roots:
        df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
        if not df.select("_metadata.file_path").limit(1).count():  # reads no further than the first file
            raise ValueError(f"the root {root} holds no Markdown file")
        parts.append(df.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("source_path"), F.col("value").alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    prefix = base.rstrip("/") + "/" if base else ""
    out = out.withColumn("source_path", F.when(F.col("source_path").startswith(prefix), F.substring("source_path", len(prefix) + 1, 1 << 30)).otherwise(F.col("source_path")) if prefix else F.col("source_path"))
    for e in exclude:
        out = out.where(~F.col("source_path").startswith(e))
    return out.dropDuplicates(["source_path"])


def parse_atom(text: str) -> tuple[dict, str | None]:
    """The fields of one atom file and what is wrong with it; the front matter is closed, an unknown line is refused."""
    lines = text.split("\n")
    if not lines or lines[0] != "---" or "---" not in lines[1:]:
        return {}, "no front matter"
    close = lines.index("---", 1)
    fields: dict = {"sources": []}
    in_sources = False
    for line in lines[1:close]:
        if in_sources and (m := re.fullmatch(r"\s+- (.+)", line)):
            fields["sources"].append(m.group(1).strip())
            continue
        in_sources = line.strip() == "sources:"
        if in_sources:
            continue
        key, sep, value = line.partition(":")
        if not sep or key not in (*REQUIRED, *OPTIONAL):
            return fields, f"unknown line {line!r}"
        value = value.strip()
        fields[key] = value[1:-1].replace('\\"', '"') if len(value) > 1 and value[0] == value[-1] == '"' else value
    fields["body"] = "\n".join(lines[close + 1 :]).lstrip("\n")
    missing = [k for k in REQUIRED if not fields.get(k)]
    if missing:
        return fields, f"missing {', '.join(missing)}"
    if fields["status"] not in STATUSES:
        return fields, f"unknown status {fields['status']!r}"
    for k in ("stale_after", "verified_at"):
        if k in fields and not re.fullmatch(r"\d{4}-\d\d-\d\d", fields[k]):
            return fields, f"{k} is no date"
    for k in ("origin_index", "origin_count"):
        if k in fields and not re.fullmatch(r"0|[1-9]\d*", fields[k]):
            return fields, f"{k} is no number"
    return fields, None if fields["sources"] else "no source"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = (*REQUIRED, *OPTIONAL)
    for batch in batches:
        parsed = [parse_atom(t or "") for t in batch.column(1).to_pylist()]
        cols = [batch.column(0), pa.array([e is None for _, e in parsed]), pa.array([e for _, e in parsed], pa.string())]
        cols += [pa.array([f.get(k) for f, _ in parsed], pa.string()) for k in keys]
        cols += [pa.array([f.get("sources", []) for f, _ in parsed], pa.list_(pa.string())), pa.array([f.get("body") for f, _ in parsed], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["path", "ok", "error", *keys, "sources", "body"])


def parse_atoms(files: DataFrame) -> DataFrame:
    """ATOM_SCHEMA of (source_path, text); a bad file is a row with ok false and its error, never a failure of the job."""
    return files.select("source_path", "text").mapInArrow(_parse, ATOM_SCHEMA)


def serialise_atoms(atoms: DataFrame) -> DataFrame:
    """(path, text): each atom in canonical form, which parse_atoms() reads back to the same fields."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), '"', r'\\"'), F.lit('"'))
    line = lambda k, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}: "), quoted(c), F.lit("\n"))).otherwise("")
    names = {"type": "atom_type", "id": "atom_id"}
    head = F.concat(*(line(k, names.get(k, k)) for k in (*REQUIRED, *OPTIONAL)))
    sources = F.concat(F.lit("sources:\n"), F.array_join(F.transform("sources", lambda s: F.concat(F.lit("  - "), s)), "\n"), F.lit("\n"))
    path = F.concat(F.coalesce("x_domain", F.lit("none")), F.lit("/"), "atom_id", F.lit(".md"))
    return atoms.select(path.alias("path"), F.concat(F.lit("---\n"), head, sources, F.lit("---\n\n"), F.coalesce("body", F.lit(""))).alias("text"))


def round_trip_failures(atoms: DataFrame) -> DataFrame:
    """(atom_id, error): atoms (unique ids) whose file does not parse, or does not give back what was written; those that do have no row."""
    back = parse_atoms(serialise_atoms(atoms).withColumnRenamed("path", "source_path"))
    names = {"type": "atom_type", "id": "atom_id"}
    ours = atoms.select(F.xxhash64("atom_id").alias("_h"), "atom_id", *(F.col(names.get(k, k)).cast("string").alias(f"_{k}") for k in (*REQUIRED, *OPTIONAL)), F.col("sources").alias("_sources"), F.regexp_replace(F.coalesce("body", F.lit("")), r"^\n+", "").alias("_body"))
    both = ours.join(back.drop("path"), ours["atom_id"] == back["id"], "left")
    lost = [F.when(~F.col(f"_{k}").eqNullSafe(F.col(k)), F.lit(k)) for k in (*REQUIRED, *OPTIONAL, "sources", "body")]
    error = F.coalesce(F.when(F.col("ok").isNull(), "no file gives this id back"), F.col("error"), F.nullif(F.concat(F.lit("changed: "), F.array_join(F.array_compact(F.array(*lost)), ", ")), F.lit("changed: ")))
    return both.select(ours["atom_id"], error.alias("error")).where("error is not null")


def write_atoms(atoms: DataFrame, path: str, owner: str) -> None:
    """Replace the atoms under path, so that none of an earlier run stays; a folder that another owner wrote is refused."""
    spark = atoms.sparkSession
    stamp = f"{path}_owner"
    try:
        row = spark.read.text(stamp).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        row = None
    if row is not None and row.value != owner:
        raise ValueError(f"{path} belongs to {row.value!r}, not {owner!r}")
    if row is None:  # the folder is claimed before anything of it is replaced
        spark.createDataFrame([(owner,)], "value string").write.mode("overwrite").text(stamp)
    atoms.write.mode("overwrite").parquet(path)
