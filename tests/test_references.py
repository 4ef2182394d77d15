import datetime as dt
import random

from corvane.operators import references as rf

REFS = "kind string, ref_table string, ref_field string, ref_key string, ref_value string, at timestamp, pos int, month string"
PARENTS = "kind string, key string, start timestamp, stop timestamp, key_range int"


def brute(refs, parents):
    out = set()
    for kind, table, field, key, value, at, *_ in refs:
        if value is None:
            continue
        rows = [(a or dt.datetime.min, b or dt.datetime.max) for k, p, a, b, _ in parents if k == kind and p == value]
        period = at and at.strftime("%Y-%m")
        if not rows:
            out.add((table, field, key, value, "missing", period))
        elif at is None:
            continue
        elif at < min(a for a, _ in rows):
            out.add((table, field, key, value, "late", period))
        elif not any(a <= at < b for a, b in rows):
            out.add((table, field, key, value, "removed", period))
    return out


def run(spark, refs, parents):
    return {tuple(r) for r in rf.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).select("ref_table", "ref_field", "ref_key", "ref_value", "orphan_kind", "period").collect()}


def test_equals_brute_force(spark):
    rng = random.Random(3)
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 500))
    parents = [(rng.choice("ab"), f"k{rng.randrange(60)}", day(), day() if rng.random() < 0.6 else None, 7) for _ in range(150)]
    refs = [(rng.choice("ab"), "t", "f", str(i), f"k{rng.randrange(80)}", day(), 1, "x") for i in range(600)]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_edges_of_intervals(spark):
    t = lambda m, d, h=0: dt.datetime(2024, m, d, h)
    parents = [("a", "k", t(2, 1), t(3, 1), 1), ("a", "k", t(2, 1), t(3, 1), 1), ("a", "k", t(5, 10), t(5, 1), 1), ("a", None, t(1, 1), None, 1), ("a", "open", None, None, 1)]
    refs = [("a", "t", "f", str(i), "k", x, 1, "m") for i, x in enumerate([t(1, 31, 23), t(2, 1), t(2, 29), t(3, 1), t(5, 20), None])]
    refs += [("a", "t", "f", "n", None, t(2, 1), 1, "m"), ("a", "t", "f", "o", "open", t(2, 1), 1, "m"), ("a", "t", "f", "z", "zz", None, 1, "m"), refs[0]]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_hot_key_and_empty_tables(spark):
    parents = [("a", "hot", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), dt.datetime(2024, 1, 1, 0, 30) + dt.timedelta(hours=i), 1) for i in range(2_000)]
    refs = [("a", "t", "f", str(i), "hot", dt.datetime(2024, 1, 1, 0, 15 if i % 2 else 45) + dt.timedelta(hours=i), 1, "m") for i in range(2_000)]
    got = run(spark, refs, parents)
    assert len(got) == 1_000 and got == brute(refs, parents)
    assert run(spark, [], parents) == set()
    assert {r[4] for r in run(spark, refs[:5], [])} == {"missing"}


def test_compressed_bitmaps():
    import numpy as np

    for n in (0, 5, rf.ARRAY_LIMIT, rf.ARRAY_LIMIT + 1, 30_000):
        flags = np.zeros(rf.BITMAP_BITS, np.uint8)
        flags[np.random.default_rng(n).choice(rf.BITMAP_BITS, n, replace=False)] = 1
        raw = np.packbits(flags, bitorder="little").tobytes()
        at = np.flatnonzero(flags)
        packed = b"a" + at.astype("<u2").tobytes() if n <= rf.ARRAY_LIMIT else b"b" + raw
        assert rf._bits(packed).tobytes() == raw


def test_values(spark):
    from pyspark.sql import functions as F

    v = lambda s, p: spark.createDataFrame([(s,)], "v string").select(rf.reference_value(F.col("v"), p).alias("r")).first().r
    assert v(" .\\Docs\\A.md ", True) == "docs/a.md" and v("././a", True) == "./a" and v(" \t", True) is None and v(" ABC ", False) == "abc"


def test_stray_dates_stay_spans(spark):
    """A parent of a thousand years is one span, and a reference from long ago is found late."""
    parents = [("a", "old", dt.datetime(1024, 3, 5), dt.datetime(2024, 5, 7, 3), 1), ("a", "new", dt.datetime(2024, 1, 9, 5), None, 1)]
    refs = [("a", "t", "f", str(i), k, x, 1, "m") for i, (k, x) in enumerate([("old", dt.datetime(1901, 1, 1)), ("old", dt.datetime(2024, 5, 7, 2)), ("old", dt.datetime(2024, 5, 7, 3)), ("new", dt.datetime(1000, 1, 1)), ("new", dt.datetime(2024, 1, 9, 4)), ("new", dt.datetime(2024, 1, 9, 5)), ("old", dt.datetime(1024, 3, 4))])]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_salted_join_of_hot_and_null_keys(spark, monkeypatch):
    from corvane import session as ss

    monkeypatch.setattr(ss, "BROADCAST_BYTES", 0)
    big = spark.range(3_000).selectExpr("id", "case when id % 3 = 0 then null when id % 3 = 1 then 7 else id end as k", "id % 2 as j")
    lookup = spark.range(3_000).selectExpr("id as k", "id % 2 as j", "id * 10 as v").unionByName(spark.sql("select 7L as k, 0L as j, 70L as v"))
    for keys, how in (("k", "left"), (["k", "j"], "left"), (["k", "j"], "inner"), (["k", "j"], "left_semi")):
        side = lookup.dropDuplicates([keys] if isinstance(keys, str) else keys)
        side = side.drop("j") if isinstance(keys, str) else side
        got = ss.salted_join(big, side, keys, how, hot_rows=100)
        want = big.join(side, keys, how)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_no_broadcast_beyond_its_bytes(spark, monkeypatch):
    from corvane import session as ss

    wide = spark.range(50).selectExpr("id", "repeat('x', 10000) as s", "array(repeat('y', 10000)) as a")
    assert ss.fits(wide)
    monkeypatch.setattr(ss, "BROADCAST_BYTES", 900_000)
    assert not ss.fits(wide) and ss.fits(wide.select("id")) and not ss.fits(wide.select("id"), 49)
