"""References to records that do not exist at the reference's own time.

Keys are dictionary-encoded as (key_range, pos). For every key range there are compressed bitmaps: of the keys referenced in a month, of
those whose first row begins in a month, and of those that are there from one month to another without a gap. All three kinds of
orphans are bits that survive an AND-NOT: referenced AND-NOT ever there is missing; of the rest, AND-NOT begun by the month's end is
late; of the rest, AND-NOT there for the whole month is in doubt, and exact times settle it. Surviving bits are decoded back to keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvane.session import cut, salted_join

#: Bits of one bitmap, which is what bitmap_construct_agg() makes; keys a range on average.
BITMAP_BITS = 32_768
KEYS_PER_RANGE = 16_384
#: Up to so many keys a bitmap is kept as a sorted array of 16-bit positions, beyond it as bits.
ARRAY_LIMIT = 2_048

_SPACE = r"[\s\u001c-\u001f\u0085\p{Z}]"


def reference_value(column: Column | str, path: bool = False) -> Column:
    """A key without outer white space, in lower case; of a path, '\\' becomes '/' and then one leading './' goes. Blank is null."""
    c = F.col(column) if isinstance(column, str) else column
    v = F.lower(F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", ""))
    if path:
        v = F.regexp_replace(F.translate(v, "\\", "/"), r"^\./", "")
    return F.nullif(v, F.lit(""))


@F.pandas_udf(T.BinaryType())
def _compress(bitmaps: pd.Series) -> pd.Series:
    """Bits to 'a' and sorted positions if there are few, else to 'b' and the bits."""

    def one(raw: bytes) -> bytes:
        bits = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
        return b"a" + at.astype("<u2").tobytes() if len(at) <= ARRAY_LIMIT else b"b" + raw

    return bitmaps.map(one)


def _bits(packed: bytes) -> np.ndarray:
    if packed[:1] == b"b":
        return np.frombuffer(packed, np.uint8, offset=1)
    flags = np.zeros(BITMAP_BITS, np.uint8)
    flags[np.frombuffer(packed, "<u2", offset=1)] = 1
    return np.packbits(flags, bitorder="little")


def _flags(packed: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(_bits(packed), bitorder="little"))


#: Bitmaps of one key range: (what, lo, hi, packed), months as year x 12 + month - 1.
_REFERENCED, _BEGUN, _THERE = 0, 1, 2
_NO_MONTH = -1


def _survivors(rows: pa.Table) -> pa.Table:
    """The bits of one key range that no parent accounts for: (key_range, month, pos, verdict)."""
    cols = {c: rows.column(c).to_pylist() for c in ("what", "lo", "hi", "packed")}
    maps = sorted(zip(*cols.values()), key=lambda r: r[:3])
    begun = np.full(BITMAP_BITS, 1 << 30, np.int32)
    for _, lo, _, packed in (r for r in maps if r[0] == _BEGUN):
        begun[_flags(packed)] = lo
    ever = np.packbits(begun < 1 << 30, bitorder="little")
    there, until, at = [r for r in maps if r[0] == _THERE], np.full(BITMAP_BITS, -1, np.int32), 0
    month, pos, verdict = [], [], []
    for _, m, _, packed in (r for r in maps if r[0] == _REFERENCED):
        referenced = _bits(packed)
        while at < len(there) and there[at][1] <= m:
            bits = _flags(there[at][3])
            until[bits] = np.maximum(until[bits], there[at][2])
            at += 1
        by_then, whole = np.packbits(begun <= m, bitorder="little"), np.packbits(until >= m, bitorder="little")
        left = {"missing": referenced & ~ever}
        if m != _NO_MONTH:
            left |= {"late": referenced & ever & ~by_then, "doubt": referenced & by_then & ~whole}
        for name, bits in left.items():
            found = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
            month.append(np.full(len(found), m, np.int32)), pos.append(found.astype(np.int32)), verdict.extend([name] * len(found))
    flat = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32))
    keys = pa.array(np.full(len(verdict), rows.column("key_range")[0].as_py() if rows.num_rows else 0, np.int32))
    return pa.table({"key_range": keys, "month": flat(month), "pos": flat(pos), "verdict": pa.array(verdict, pa.string())})


def _month(c: Column | str) -> Column:
    return F.year(c) * 12 + F.month(c) - 1


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References that point to nothing at their own time: the columns of refs without `kind` and `at`, orphan_kind, period.

    refs: (kind, ref_table, ref_field, ref_key, ref_value, at); parents: (kind, key, start, stop), a row there from start up
    to, not including, stop (null: still there; a null start: from the beginning). kind says which key space is meant.
    orphan_kind: 'missing' if no parent row has the key, 'late' if `at` lies before all of them, 'removed' if none covers
    it. A null ref_value is no reference; with a null `at` only 'missing' is reported, with period null. Repeated
    references and parent rows count once. However many rows one key has: joins salt hot keys, a key is one bit a month, and exact times
    meet by key and hour.
    """
    far_past, far_future = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"), F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    refs = refs.where("ref_value is not null").select("kind", "ref_table", "ref_field", "ref_key", F.col("ref_value").alias("key"), F.col("at").cast("timestamp_ntz").alias("at")).distinct()
    parents = (
        parents.where("key is not null")
        .select("kind", "key", F.coalesce(F.col("start").cast("timestamp_ntz"), far_past).alias("start"), F.coalesce(F.col("stop").cast("timestamp_ntz"), far_future).alias("stop"))
        .groupBy("kind", "key", "start").agg(F.max("stop").alias("stop"))
    )
    refs, parents = cut(refs), cut(parents)
    keys = cut(parents.select("kind", "key").unionByName(refs.select("kind", "key")).distinct())
    n_ranges = max(1, -(-keys.count() // KEYS_PER_RANGE))
    in_range = Window.partitionBy("key_range").orderBy("kind", "key")
    dictionary = cut(
        keys.withColumn("key_range", F.pmod(F.xxhash64("kind", "key"), F.lit(n_ranges)).cast("int"))
        .withColumn("pos", F.row_number().over(in_range) - 1)
    )
    # A range of hashes holds its mean and a few standard deviations more; the encoding must never run over.
    if dictionary.where(F.col("pos") >= BITMAP_BITS).limit(1).count():
        raise RuntimeError("a key range ran over its bitmap")
    known = salted_join(refs, dictionary, ["kind", "key"], "inner")
    known = cut(known.select("ref_table", "ref_field", "ref_key", F.col("key").alias("ref_value"), "at", "key_range", "pos", F.coalesce(_month("at"), F.lit(_NO_MONTH)).alias("month")))
    encoded = cut(salted_join(parents, dictionary, ["kind", "key"], "inner").select("key_range", "pos", "start", "stop"))

    # One row for each bit: what a month or a span of months says of a key. Spans stay spans, however long.
    bit = lambda what, lo, hi: (F.lit(what).alias("what"), lo.alias("lo"), hi.alias("hi"))
    month = _month("start")
    first_whole = F.when(F.date_format("start", "dd HH:mm:ss.SSSSSS") == "01 00:00:00.000000", month).otherwise(month + 1)
    spans = encoded.select("key_range", "pos", first_whole.alias("lo"), (_month("stop") - 1).alias("hi")).where("lo <= hi").groupBy("key_range", "pos", "lo").agg(F.max("hi").alias("hi"))
    rows = (
        known.select("key_range", "pos", *bit(_REFERENCED, F.col("month"), F.col("month"))).distinct()
        .unionByName(encoded.groupBy("key_range", "pos").agg(F.min("start").alias("start")).select("key_range", "pos", *bit(_BEGUN, month, month)))
        .unionByName(spans.select("key_range", "pos", *bit(_THERE, F.col("lo"), F.col("hi"))))
    )
    # Rows of a few bytes are brought together before they become bitmaps, so no half-filled bitmap is shuffled.
    bitmaps = rows.repartition("key_range").groupBy("key_range", "what", "lo", "hi").agg(F.bitmap_construct_agg(F.col("pos").cast("long")).alias("raw")).select("key_range", "what", "lo", "hi", _compress("raw").alias("packed"))
    left = cut(bitmaps.groupBy("key_range").applyInArrow(_survivors, "key_range int, month int, pos int, verdict string"))
    judged = cut(salted_join(known, left, ["key_range", "month", "pos"], "inner"))
    report = ["ref_table", "ref_field", "ref_key", "ref_value", "orphan_kind", F.date_format("at", "yyyy-MM").alias("period")]
    by_bits = judged.where("verdict <> 'doubt'").withColumn("orphan_kind", F.col("verdict"))

    # Exact times, for what is left: is the latest stop of all rows that began by `at` later than `at`?
    key = ["key_range", "pos"]
    hour = lambda c: F.date_format(c, "yyyy-MM-dd HH")
    open_refs = judged.where("verdict = 'doubt'")
    asked = open_refs.select(*key, F.col("at").alias("t"), F.lit(1).alias("is_ref"), F.lit(None).cast("timestamp_ntz").alias("stop")).distinct()
    starts = salted_join(encoded, open_refs.select(*key).distinct(), key, "left_semi").select(*key, F.col("start").alias("t"), F.lit(0).alias("is_ref"), "stop")
    times = cut(asked.unionByName(starts).withColumn("hour", hour("t")))
    # What earlier hours carry over, one row a key and hour, so a hot key's times are spread over its hours.
    earlier = Window.partitionBy(*key).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = times.groupBy(*key, "hour").agg(F.max("stop").alias("hour_stop")).select(*key, "hour", F.max("hour_stop").over(earlier).alias("carried"))
    so_far = Window.partitionBy(*key, "hour").orderBy("t", "is_ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = times.withColumn("latest", F.max("stop").over(so_far)).where("is_ref = 1").join(carried, [*key, "hour"]).select(*key, F.col("t").alias("at"), F.greatest("latest", "carried").alias("latest"))
    settled = salted_join(open_refs, latest, [*key, "at"], "inner")
    by_times = settled.where("coalesce(latest <= at, true)").withColumn("orphan_kind", F.when(F.col("latest").isNull(), "late").otherwise("removed"))
    return by_bits.select(*report).unionByName(by_times.select(*report)).distinct()


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """(ref_table, ref_field, period, orphan_kind, n_references, n_values)."""
    return orphans.groupBy("ref_table", "ref_field", "period", "orphan_kind").agg(F.count("*").alias("n_references"), F.count_distinct("ref_value").alias("n_values"))


def corpus_references(golden: DataFrame, enrichment: DataFrame) -> DataFrame:
    """The references of golden queries and enrichment records in the form orphan_references() takes."""
    g = golden.select("query_id", "frozen_at", F.explode("relevant_atom_ids").alias("v")).select(
        F.lit("atom").alias("kind"), F.lit("golden_queries").alias("ref_table"), F.lit("relevant_atom_ids").alias("ref_field"), F.col("query_id").alias("ref_key"), reference_value("v").alias("ref_value"), F.col("frozen_at").alias("at"),
    )
    base = lambda field, kind, value: enrichment.select(F.lit(kind).alias("kind"), F.lit("enrichment").alias("ref_table"), F.lit(field).alias("ref_field"), F.col("record_no").cast("string").alias("ref_key"), value.alias("ref_value"), F.col("created_at").alias("at"))
    return g.unionByName(base("atom_id", "atom", reference_value("atom_id"))).unionByName(base("source_path", "file", reference_value("source_path", True)))


def corpus_parents(atoms: DataFrame, files: DataFrame) -> DataFrame:
    a = atoms.select(F.lit("atom").alias("kind"), reference_value("atom_id").alias("key"), F.col("ingested_at").alias("start"), F.col("removed_at").alias("stop"))
    f = files.select(F.lit("file").alias("kind"), reference_value("file_path", True).alias("key"), F.col("written_at").alias("start"), F.col("removed_at").alias("stop"))
    return a.unionByName(f)
