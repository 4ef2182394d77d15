"""From documents to atoms: titles, ids, labels, validation, deduplication, provenance, renumbering, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text as tx
from corvane.operators.chunking import MAX_UNITS, chunk_documents, document_titles
from corvane.session import cut, salted_join, small

#: Bodies shorter than this are never taken for copies of each other.
DEDUPE_MIN = 200


def stem_title(path: Column) -> Column:
    """The file's name without '.md', with blanks for '-'; null for an empty one."""
    return F.nullif(F.translate(F.regexp_extract(path, r"([^/]*?)(?:\.md)?$", 1), "-", " "), F.lit(""))


def with_document_title(docs: DataFrame, text: str, path: str, keep: list[str]) -> DataFrame:
    """The keep columns and doc_title: the front matter's title, else the first heading outside fences, else the file's stem."""
    found = document_titles(docs, text, list(dict.fromkeys([*keep, path])))
    return found.select(*keep, F.coalesce("found_title", stem_title(F.col(path))).alias("doc_title"))


def document_summary(text: Column) -> Column:
    """What a '<!-- LLM-PRIMARY: ... -->' comment says, blanks collapsed; null without one."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, r"(?s)<!--\s*LLM-PRIMARY:(.*?)-->", 1), r"\s+", " ")), F.lit(""))


def with_summaries(docs: DataFrame, sidecar: DataFrame) -> DataFrame:
    """docs with summary: the document's own comment, else the sidecar's (source_path, summary)."""
    s = sidecar.groupBy("source_path").agg(F.max("summary").alias("_side"))
    return docs.join(small(s), "source_path", "left").withColumn("summary", F.coalesce(document_summary(F.col("text")), "_side")).drop("_side")


def compose_body(body: Column, chain: Column, limit: int = MAX_UNITS) -> Column:
    """The body without HTML comments and doubled blank lines, under a line with its heading path unless that exceeds the limit."""
    bare = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), r"\n{3,}", "\n\n")
    bare = F.regexp_replace(bare, r"^\n+|\s+$", "")
    path = F.array_join(F.filter(chain, lambda t: F.trim(t) != ""), " > ")
    headed = F.concat(F.lit("# "), path, F.lit("\n\n"), bare)
    return F.when((path == "") | (F.length(headed) > limit), bare).otherwise(headed)


#: Rows of one group that are numbered in one task.
NUMBER_BLOCK = 100_000


def numbered(rows: DataFrame, keys: list[str], order: list[str], block: int = NUMBER_BLOCK) -> DataFrame:
    """rows with _i (from 1, by order, nulls last) and _n (how many) inside each group of keys; null keys are a group.

    The last of `order` tells the rows of a group apart, the first is a number. Groups of more than `block` rows, which are at most
    rows / block, are cut into 64 ranges at the quantiles of that number (rows that are equal in it stay together), numbered range by
    range, and shifted by the sizes of the ranges before.
    """
    place = F.struct(*(x for c in order for x in (F.col(c).isNull(), F.col(c))))
    named, own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], [f"_k{i}" for i in range(len(keys))]
    on = [F.col(k).eqNullSafe(F.col(x)) for k, x in zip(keys, own)]
    large = cut(rows.groupBy(*named).agg(F.count("*").alias("_n")).where(F.col("_n") > block).drop("_n"))
    if not large.limit(1).count():
        w = Window.partitionBy(*keys)
        return rows.withColumn("_place", place).withColumn("_i", F.row_number().over(w.orderBy("_place"))).withColumn("_n", F.count("*").over(w)).drop("_place")
    quantiles = F.percentile_approx(order[0], [i / 64 for i in range(1, 64)], 10_000)
    bounds = rows.join(small(large), on, "left_semi").groupBy(*named).agg(quantiles.alias("_bounds"))
    inside = F.when(F.col(order[0]).isNull(), 64).otherwise(F.size(F.filter("_bounds", lambda x: x < F.col(order[0]))))
    marked = cut(rows.join(small(bounds), on, "left").withColumn("_range", F.when(F.col("_bounds").isNull(), 0).otherwise(inside)).drop("_bounds", *own))
    w = Window.partitionBy(*own)
    per_range = marked.groupBy(*named, F.col("_range").alias("_r")).agg(F.count("*").alias("_c"))
    before = per_range.select(*own, "_r", F.coalesce(F.sum("_c").over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(w).alias("_n"))
    local = marked.withColumn("_place", place).withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_place"))).drop("_place")
    return local.join(before, [*on, F.col("_range") == F.col("_r")]).withColumn("_i", F.col("_i") + F.col("_before")).drop("_range", "_r", "_before", *own)


def number_parts(chunks: DataFrame, doc: str = "source_path", chain: str = "heading_chain") -> DataFrame:
    """Adds title: the chunk's title, with ' (i/n)' where several chunks of a document share a heading chain."""
    out = numbered(chunks.withColumn("_chain", F.array_join(chain, "\u0000")), [doc, "_chain"], ["chunk_no"])
    return out.withColumn("title", F.when(F.col("_n") > 1, F.concat("chunk_title", F.lit(" ("), "_i", F.lit("/"), "_n", F.lit(")"))).otherwise(F.col("chunk_title"))).drop("_i", "_n", "_chain")


def disambiguate_titles(chunks: DataFrame, doc: str = "source_path", title: str = "title", path: str = "heading_path") -> DataFrame:
    """A title that two or more documents use is replaced by the full heading path. The title counts are pre-aggregated, a hot title costs one row."""
    used = chunks.select(title, doc).distinct().groupBy(title).agg(F.count("*").alias("_n")).where("_n > 1")
    return salted_join(chunks, used, title).withColumn(title, F.when(F.col("_n").isNotNull() & (F.coalesce(F.col(path), F.lit("")) != ""), F.col(path)).otherwise(F.col(title))).drop("_n")


def content_print(content: str = "body", doc: str = "source_path") -> Column:
    """8 digits of the hash of a chunk's document, place and content."""
    return F.substring(F.sha1(F.concat_ws("\u0000", doc, F.col("chunk_no").cast("string"), content)), 1, 8)


def resolve_ids(chunks: DataFrame, base: str = "base_id", print8: Column | None = None) -> DataFrame:
    """Adds atom_id: the base id; where it collides, all that share it get their content_print()."""
    counts = chunks.groupBy(base).agg(F.count("*").alias("_n")).where("_n > 1")
    print8 = content_print() if print8 is None else print8
    return salted_join(chunks, counts, base).withColumn("atom_id", F.when(F.col("_n").isNull(), F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), print8))).drop("_n")


#: Rules of one profile at most.
RULES = 1_000


def label_by_path(docs: DataFrame, rules: DataFrame, path: str, out: str, default: str | None = None) -> DataFrame:
    """docs with `out`, the label of the longest rule (prefix, label) that the path begins with; null, or the default, without one.

    A path is looked up by its beginnings of the lengths that rules have, so the join is an equi-join. Of equal prefixes the smaller label
    holds. A profile has at most RULES rules; paths are distinct before they are joined and joined back salted.
    """
    r = rules.where("prefix is not null").groupBy("prefix").agg(F.min("label").alias("label"))
    lengths = [x.n for x in r.select(F.length("prefix").alias("n")).distinct().limit(RULES + 1).collect()]  # at most RULES
    if len(lengths) > RULES:
        raise ValueError(f"a profile has at most {RULES} rules")
    paths = docs.select(F.col(path).alias("_p")).where("_p is not null").distinct()
    starts = F.array(*(F.when(F.length("_p") >= n, F.substring("_p", 1, n)) for n in lengths)) if lengths else F.array().cast("array<string>")
    found = paths.select("_p", F.explode(F.array_compact(starts)).alias("prefix")).join(small(r), "prefix").groupBy("_p").agg(F.max_by("label", F.length("prefix")).alias("_label"))
    joined = salted_join(docs, found.select(F.col("_p").alias(path), F.col("_label").alias(out)), path)
    return joined.withColumn(out, F.col(out) if default is None else F.coalesce(out, F.lit(default))).select(*docs.columns, out)


def map_paths(docs: DataFrame, path: str, domain_rules: DataFrame, type_rules: DataFrame, segment_rules: list[tuple[str, str]], default_type: str) -> DataFrame:
    """docs with domain, doc_type and skip_reason, which says why a document is left out, or null.

    The domain is that of the longest prefix rule; a document outside all of them is skipped, as no domain is guessed. The type is that of the
    first segment rule (segment, type) of which the path holds the whole segment; without one that of the longest prefix rule,
    without that the default.
    """
    mapped = label_by_path(label_by_path(docs, domain_rules, path, "domain"), type_rules, path, "_by_prefix", default_type)
    by_segment = F.coalesce(*(F.when(F.array_contains(F.split(path, "/"), s), F.lit(t)) for s, t in segment_rules)) if segment_rules else F.lit(None).cast("string")
    reason = F.when(F.col("domain").isNull(), F.concat(F.lit("no domain rule claims "), F.coalesce(F.col(path), F.lit("a document without a path"))))
    return mapped.withColumn("doc_type", F.coalesce(by_segment, "_by_prefix")).withColumn("skip_reason", reason).drop("_by_prefix")


def refusals(atoms: DataFrame, domains: list[str], types: list[str], limit: int = MAX_UNITS) -> DataFrame:
    """atoms with reasons: all that is wrong with each row, an empty array where nothing is.

    Checks: slug id, unique id, size, domain and type of the vocabularies, at least one source, a body. A null counts as wrong.
    """
    copies = atoms.groupBy("atom_id").agg(F.count("*").alias("_n"))
    rows = atoms.join(copies, atoms["atom_id"].eqNullSafe(copies["atom_id"]), "left").drop(copies["atom_id"])
    bad = lambda ok, reason: F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason))
    units = F.length("body") + F.length(F.regexp_replace("body", r"[^\x{10000}-\x{10FFFF}]", ""))
    checks = [
        bad(F.col("atom_id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "id is no slug"), bad(F.col("_n") == 1, "id is not unique"), bad(units <= limit, "body exceeds the size limit"),
        bad(F.col("x_domain").isin(*domains), "unknown domain"), bad(F.col("atom_type").isin(*types), "unknown type"), bad(F.size("sources") > 0, "no source"), bad(F.trim("body") != "", "empty body"),
    ]
    return rows.withColumn("reasons", F.array_compact(F.array(*checks))).drop("_n")


def body_key(body: Column) -> Column:
    """The hash by which bodies count as copies: without their first heading line."""
    return F.sha1(F.regexp_replace(body, r"^#+[ \t]+[^\n]*\n+", ""))


def dedupe_bodies(atoms: DataFrame, judged: DataFrame | None = None, min_chars: int = DEDUPE_MIN) -> DataFrame:
    """atoms with survivor_id: which atom stands for each body; a row survives where it is its own.

    Of equal bodies of at least min_chars characters, judged atoms come first, then the smaller id. If two or more judged documents
    share a body, each of them keeps its first atom. atoms: atom_id (unique), body, document; judged: (document). Only keys and ids
    are grouped, never bodies; the winner of a group is a maximum, so a group of a third of all rows is one aggregated row.
    """
    flag = F.lit(0) if judged is None else F.coalesce("_j", F.lit(0))
    rows = atoms if judged is None else salted_join(atoms, judged.select("document").distinct().withColumn("_j", F.lit(1)), "document")
    # Bodies stay where they are: only keys, ids and documents take part in grouping and joining.
    keys = cut(rows.select("atom_id", "document", flag.alias("_judged"), F.when(F.length("body") >= min_chars, body_key(F.col("body"))).alias("_key")).where("_key is not null"))
    heads = keys.groupBy("_key").agg(F.min(F.struct((1 - F.col("_judged")).alias("o"), F.col("atom_id"))).alias("_first"), F.count("*").alias("_n"), F.min(F.when(F.col("_judged") == 1, F.col("document"))).alias("_d0"), F.max(F.when(F.col("_judged") == 1, F.col("document"))).alias("_d1"))
    shared = cut(heads.where("_n > 1").select("_key", F.col("_first.atom_id").alias("_head"), F.coalesce(F.col("_d0") != F.col("_d1"), F.lit(False)).alias("_several")))
    own = keys.where("_judged = 1").groupBy("_key", "document").agg(F.min("atom_id").alias("_own"))
    copies = salted_join(keys, shared, "_key", "inner")
    copies = salted_join(copies, own, ["_key", "document"])
    survivor = F.when(F.col("_several") & (F.col("_judged") == 1) & (F.col("_own") == F.col("atom_id")), F.col("atom_id")).otherwise(F.col("_head"))
    moved = copies.select("atom_id", survivor.alias("_survivor")).where("_survivor <> atom_id")
    return atoms.join(small(moved), "atom_id", "left").withColumn("survivor_id", F.coalesce("_survivor", "atom_id")).drop("_survivor")


def merge_provenance(deduped: DataFrame) -> DataFrame:
    """(atom_id, sources) of each survivor: its own sources, then those of the copies it stands for, each once, in order of the copies' ids.

    The result is one array a survivor by definition; each source is brought down to its first place before it is collected.
    """
    each = deduped.select("survivor_id", "atom_id", F.posexplode("sources").alias("pos", "source"))
    first = each.groupBy("survivor_id", "source").agg(F.min(F.struct((F.col("atom_id") != F.col("survivor_id")).cast("int").alias("copy"), F.col("atom_id"), F.col("pos"))).alias("at"))
    return first.groupBy(F.col("survivor_id").alias("atom_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "source"))), lambda x: x["source"]).alias("sources"))  # distinct sources of one body


def renumber_origins(atoms: DataFrame, doc: str = "document") -> DataFrame:
    """origin_index 0.. and origin_count over a document's atoms, in the order of their old index, then id."""
    out = numbered(atoms, [doc], ["origin_index", "atom_id"])
    return out.withColumn("new_index", (F.col("_i") - 1).cast("int")).withColumn("new_count", F.col("_n").cast("int")).drop("_i", "_n")


def tallies(atoms: DataFrame) -> DataFrame:
    """(build_id, kind, label, n): each build's atoms by type and by domain, exact repeats of a row once."""
    pairs = F.array(F.struct(F.lit("type").alias("kind"), F.col("atom_type").alias("label")), F.struct(F.lit("domain").alias("kind"), F.col("x_domain").alias("label")))
    return atoms.select("build_id", F.explode(pairs).alias("p")).where("p.label is not null").groupBy("build_id", "p.kind", "p.label").agg(F.count("*").alias("n"))


def manifest_tallies(manifest: DataFrame) -> DataFrame:
    """(build_id, kind, label, n) as a manifest's maps by_type and by_domain state them; a repeated row counts once."""
    part = lambda kind, c: manifest.select("build_id", F.lit(kind).alias("kind"), F.explode(c).alias("label", "n"))
    return part("type", "by_type").unionByName(part("domain", "by_domain")).groupBy("build_id", "kind", "label").agg(F.max("n").alias("n"))


def domain_census(files: DataFrame, declared: list[str]) -> DataFrame:
    """(domain, files, indexed, declared, dropped) of each declared or found domain. files: (domain, ok), a row a file; dropped: files but none indexed."""
    found = files.where("domain is not null").groupBy("domain").agg(F.count("*").alias("files"), F.count_if("ok").alias("indexed"))
    named = files.sparkSession.createDataFrame([(x,) for x in declared], "domain string").distinct().withColumn("declared", F.lit(True))
    both = found.join(named, "domain", "full_outer").na.fill({"files": 0, "indexed": 0, "declared": False})
    return both.withColumn("dropped", (F.col("files") > 0) & (F.col("indexed") == 0))


def longest_segment_prefix(ids: DataFrame, known: DataFrame, id_col: str, out: str = "found_id") -> DataFrame:
    """ids with `out`: the longest beginning of the id, cut at a '-', that is an id of known (doc_id); null without one.

    Each id is looked up by its own beginnings, so the join is an equi-join on distinct ids; the answer is joined back salted.
    """
    parts = F.split("_id", "-")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    each = ids.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().select("_id", F.explode(starts).alias("doc_id"))
    found = each.join(known.select("doc_id").distinct(), "doc_id").groupBy("_id").agg(F.max_by("doc_id", F.length("doc_id")).alias(out))
    return salted_join(ids, found.withColumnRenamed("_id", id_col), id_col)


def corpus_digest(atoms: DataFrame, id_col: str = "atom_id", content: str = "body") -> DataFrame:
    """One row: the hash over the sorted lines of id and content hash, in levels: 65,536 leaves by hashes of the id, their hashes in 256 buckets, and those.

    A single hash over all lines in order would have to pass the whole corpus through one task; this one is as independent of the order of
    rows, and equal corpora have equal digests, but the value differs from that of a single hash.
    """
    line = F.concat(F.col(id_col), F.lit("\u0000"), F.sha2(F.coalesce(content, F.lit("")), 256))
    lines = atoms.select(F.substring(F.sha1(F.col(id_col)), 1, 2).alias("bucket"), F.substring(F.sha1(F.col(id_col)), 3, 4).alias("sub"), line.alias("line"))
    leaves = lines.groupBy("bucket", "sub").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("h"))
    buckets = leaves.groupBy("bucket").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sub", "h"))), lambda x: x["h"]), "\n"), 256).alias("h"))
    return buckets.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "\n"), 256).alias("digest"))


def ingest(docs: DataFrame, rules: DataFrame | None = None, default_type: str = "knowledge", limit: int = MAX_UNITS) -> DataFrame:
    """Atoms of Markdown documents: source_path, text, domain and doc_type -> atom_id, title, heading_chain, body, origin_index, origin_count, ...

    Composes the chunker and the steps above. Documents without a path are dropped; an empty text gives no atom.
    """
    # The texts go through the chunker once. Titles, ids and places are settled on keys; the bodies are joined to them at the end.
    made = chunk_documents(docs.where("source_path is not null"), "text", ["source_path", "domain", "doc_type"], limit)
    made = made.withColumn("body", compose_body(F.col("body"), F.col("heading_chain"), limit)).where(F.trim("body") != "")
    chunks = cut(made.withColumn("_id", F.monotonically_increasing_id()))
    keys = cut(number_parts(chunks.select("_id", "source_path", "chunk_no", "heading_chain", "chunk_title", content_print().alias("_print"))))
    keys = disambiguate_titles(keys.withColumn("heading_path", F.array_join(F.filter("heading_chain", lambda t: F.trim(t) != ""), " > ")))
    base = tx.truncate_slug(tx.slugify(F.concat_ws(" ", F.regexp_extract("source_path", r"([^/]+?)(?:\.[^./]*)?$", 1), "title")))
    keys = resolve_ids(cut(keys.withColumn("base_id", base)), print8=F.col("_print"))
    placed = renumber_origins(cut(keys.select("_id", "atom_id", "title", "heading_path", F.col("source_path").alias("document"), F.col("chunk_no").alias("origin_index"))))
    return placed.join(chunks.drop("heading_chain", "chunk_title"), "_id").select(
        "atom_id", "title", F.col("domain").alias("x_domain"), F.coalesce("doc_type", F.lit(default_type)).alias("atom_type"), F.col("heading_path").alias("heading_chain"),
        F.col("new_index").alias("origin_index"), F.col("new_count").alias("origin_count"), F.array("source_path").alias("sources"), F.coalesce("found_title", stem_title(F.col("source_path"))).alias("doc_title"), "body",
    )
