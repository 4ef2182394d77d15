import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import near_duplicates as nd
from corvane.session import table

SCHEMA = "atom_id string, body string, grp int, bits string, side int"


def shingles(text, n):
    words = nd.WORD.findall((text or "").lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, threshold):
    sets = [(i, shingles(t, n)) for i, t in {(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None}]
    out = set()
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i != j and (a or b) and len(a & b) >= threshold * len(a | b):
            out.add((min(i, j), max(i, j)))
    return out


def pairs(spark, rows, threshold=0.7, words=3, **kw):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    members, links = nd.near_duplicate_links(df, "atom_id", "body", threshold, words, **kw)
    return {(r.id_a, r.id_b) for r in nd.record_pairs(members, links).collect()}, members, links


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + rng.randrange(2)] = [rng.choice(words)]
    return out


def corpus(seed, families=12, copies=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 160))]
        for c in range(copies):
            rows.append((f"id-{f}-{c}", " ".join(edited(rng, base, rng.randrange(0, 6)))))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = corpus(1)
    found, _, _ = pairs(spark, rows)
    assert found == brute(rows, 3, 0.7)
    assert len(found) > 20


def test_pairs_of_the_test_table_equal_brute_force(spark, tiny):
    atoms = table(spark, tiny, "atoms").where("length(body) >= 200").select("atom_id", "body").distinct()
    rows = [tuple(r) for r in atoms.collect()]
    found, _, _ = pairs(spark, rows)
    assert found == brute(rows, 3, 0.7)


def test_hot_buckets_are_split_without_loss(spark):
    rows = corpus(2, families=2, copies=40)
    found, _, _ = pairs(spark, rows)
    df = spark.createDataFrame(rows, "atom_id string, body string")
    signed = nd.signatures(df, "atom_id", "body", 3)
    sketches = signed.selectExpr("set_key", "band_keys", "bits").dropDuplicates(["set_key"])
    whole = {tuple(r) for r in nd.candidate_pairs(sketches).collect()}
    split = {tuple(r) for r in nd.candidate_pairs(sketches, block=5).collect()}
    assert whole == split and found == brute(rows, 3, 0.7)


def test_hot_keys_are_split_before_the_shuffle(spark, monkeypatch):
    """The same pairs whether the tasks notice the hot keys or not."""
    base = " ".join(f"w{i * 7 % 101}" for i in range(100))
    df = spark.createDataFrame([(f"a{i}", f"{base} tail{i} end{i % 7}") for i in range(150)], "atom_id string, body string")
    sketches = nd.signatures(df, "atom_id", "body", 3).selectExpr("set_key", "band_keys", "bits").dropDuplicates(["set_key"]).repartition(2).checkpoint()
    whole = {tuple(r) for r in nd.candidate_pairs(sketches).collect()}
    assert sketches.select("band_keys").mapInArrow(nd._frequent, "grp long, n long").where("n > 20").count() > 0
    assert {tuple(r) for r in nd.candidate_pairs(sketches, block=20).collect()} == whole


def test_large_classes_are_paired_in_blocks(spark):
    members = spark.createDataFrame([(f"a{i}", 1) for i in range(40)] + [(f"b{i}", 2) for i in range(30)] + [("c", 3), ("d", 4), ("a1", 2)], "rec_id string, set_key long")
    links = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8)], "key_a long, key_b long, likeness double")
    want = {tuple(r) for r in nd.record_pairs(members.select("rec_id", "set_key"), links).collect()}
    got = {tuple(r) for r in nd.record_pairs(members, links, block=7).collect()}
    ids = {1: {f"a{i}" for i in range(40)}, 2: {f"b{i}" for i in range(30)} | {"a1"}, 3: {"c"}}
    pairs_ = {(min(x, y), max(x, y)) for p, q in ((1, 1), (2, 2), (1, 2), (2, 3)) for x in ids[p] for y in ids[q] if x != y}
    assert got == want and {(a, b) for a, b, _ in got} == pairs_


def test_nulls_empty_repeated_and_long_texts(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [("a", None), (None, "one two three four"), ("b", ""), ("c", "x" * 500_000), ("d", "one two"), ("e", "one two three four"), ("e", "one two three four"), ("f", "One, two; THREE four"), ("g", long), ("h", long + " end")]
    found, members, links = pairs(spark, rows)
    assert found == {("e", "f"), ("g", "h")}
    groups = {r.rec_id: r for r in nd.near_duplicate_groups(members, links).collect()}
    assert groups["e"].group_id == groups["f"].group_id and groups["e"].n_copies == 1
    assert groups["g"].group_id == groups["h"].group_id and groups["g"].n_links == 1


def test_empty_table(spark):
    found, members, links = pairs(spark, [])
    assert found == set() and nd.near_duplicate_groups(members, links).count() == 0


def test_components_of_paths_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 100 + i) for i in range(1, 50)] + [(500, 400), (400, 450)]
    roots = {r.node: r.root for r in nd.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    path = {r.node: r.root for r in nd.connected(spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")).collect()}
    assert all(path[i] == 0 for i in range(1, 301))
    assert all(roots[i] == 1 for i in range(2, 31)) and all(roots[100 + i] == 100 for i in range(1, 50)) and roots[500] == roots[450] == 400


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 60), st.integers(0, 40))
def test_trie_join_equals_all_pairs(seed, n, budget):
    rng = np.random.default_rng(seed)
    key = rng.integers(0, 3, n).astype(np.int64)
    base = rng.integers(0, 1 << 16, (3, 8), dtype=np.int64)
    bits = base[rng.integers(0, 3, n)]
    for _ in range(20):
        bits[rng.integers(0, n), rng.integers(0, 8)] ^= 1 << int(rng.integers(0, 16))
    bits = bits.astype(np.uint16)
    i, j = nd.trie_join(key, bits, budget)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if key[a] == key[b] and sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(bits[a], bits[b])) <= budget}
    assert got == want and len(got) == len(i)


def test_trie_join_of_a_large_block_in_small_slices(monkeypatch):
    monkeypatch.setattr(nd, "FRONTIER", 1_000)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 16, (300, 8)).astype(np.uint16)
    bits = np.concatenate([base, base, base ^ np.uint16(3)])
    i, j = nd.trie_join(np.zeros(len(bits), np.int64), bits, 16)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    dist = np.bitwise_count(bits[:, None, :] ^ bits[None, :, :]).sum(2)
    assert got == {(a, b) for a in range(900) for b in range(a + 1, 900) if dist[a, b] <= 16} and len(got) == len(i)


def test_recall_over_likeness(spark):
    """All pairs from 0.7 on, over many families: the bands miss at most a few in a thousand of those just above it."""
    rows = corpus(7, families=60, copies=5)
    want = brute(rows, 3, 0.7)
    found, _, _ = pairs(spark, rows)
    assert found <= want and len(found) >= 0.99 * len(want)


def test_stream_passes_hot_keys_over_many_batches():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    keys = np.sort(np.concatenate([np.full(130_000, 50), rng.integers(0, 100, 60_000), np.full(3, 200)]))
    sets = np.arange(len(keys))
    blob = [rng.bytes(16) for _ in range(len(keys))]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(keys[i : i + 9_000]), pa.array(sets[i : i + 9_000]), pa.array(blob[i : i + 9_000]), pa.array(np.full(len(keys[i : i + 9_000]), -1, np.int32))], ["grp", "set_key", "bits", "side"])
        for i in range(0, len(keys), 9_000)
    ]
    out = pa.Table.from_batches(list(nd._join_partition(30, 1_000)(iter(batches)))).to_pandas()
    hot = out[out.grp.notna()]
    assert sorted(hot.set_key.astype(int)) == sets[keys == 50].tolist()
    pairs = out[out.key_a.notna()]
    want = 0
    for k in [*range(100), 200]:
        if k != 50:
            at = np.flatnonzero(keys == k)
            i, _ = nd.trie_join(np.zeros(len(at), np.int64), np.frombuffer(b"".join(blob[x] for x in at), ">u2").reshape(-1, 8).astype(np.uint16), 30)
            want += len(i)
    assert len(pairs) == want
