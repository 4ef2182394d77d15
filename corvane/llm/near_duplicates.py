"""Near-duplicate records by a binary trie self-join over Hamming fingerprints.

Every distinct text gets a 128-bit fingerprint whose bits agree with probability (1 + J) / 2 for two texts of shingle
likeness J: bit i is one bit of the mixed i-th min-hash. All texts stand in binary tries. A trie's upper levels, which
must agree exactly, are one band of min-hashes and serve as the shuffle key; below them the trie over the 128 bits is
joined with itself: pairs of nodes go down together, differing bits are added up, and a pair is dropped once they
exceed the error budget. Texts meet if any of BANDS bands agrees. The pairs that reach the leaves are checked exactly.

Recall: two texts at likeness 0.7 share none of 22 bands of 4 with probability (1 - 0.7**4)**22 = 0.0024, at 0.75
0.0003; the budget of 38 differing bits is 4.6 standard deviations above the 19.2 expected at 0.7. Precision is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut, ensure_checkpoint_dir, salted_join, small

BITS = 128
BANDS = 22
BAND_ROWS = 4
BUDGET = 38
#: Rows of one band bucket that one task joins; a larger bucket is cut into blocks, which are joined pair by pair.
BLOCK = 4_000
#: Node pairs of one level that are held in memory at once while two tries are traversed.
FRONTIER = 400_000
#: A band key is looked at as a hot one before the shuffle if it comes so often among LOCAL_KEYS keys of a task.
LOCAL_LEAST, LOCAL_KEYS = 16, 4_000_000
#: Records of one class, or links of one class, that one task expands into pairs.
PAIR_BLOCK = 2_000

WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20_240_607)
_MULT = (_RNG.integers(0, 1 << 32, BITS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, BITS, dtype=np.uint64).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Turns texts into sorted arrays of distinct 64-bit shingle hashes; remembers the hashes of up to WORDS words."""

    WORDS = 300_000

    def __init__(self, words: int) -> None:
        self.words, self.seen, self.table = words, {}, np.empty(4_096, np.uint64)

    def _number(self, word: str) -> int:
        import xxhash

        n = self.seen[word] = len(self.seen)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[n] = xxhash.xxh3_64_intdigest(word)
        return n

    def hashes(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        n = len(words) - self.words + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        if len(self.seen) > self.WORDS:
            self.seen.clear()
        get = self.seen.get
        at = list(map(get, words))
        if None in at:
            at = [self._number(w) if (i := get(w)) is None else i for w in words]
        h = self.table[np.array(at, np.int64)]
        s = np.zeros(n, np.uint64)
        for i in range(self.words):
            s = (s ^ h[i : i + n]) * _MIX
            s ^= s >> np.uint64(29)
        return np.unique(_mix(s))


def fingerprint(h: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band keys and the 128-bit fingerprint of one shingle set."""
    low = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    least = np.full(BITS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        v = low[i : i + 2048, None] * _MULT
        v += _ADD
        np.minimum(least, v.min(axis=0), out=least)
    # The minima are mixed once at the end, so that each bit depends on the whole minimum.
    mixed = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    mixed = (mixed ^ (mixed >> np.uint32(12))) * np.uint32(0x297A2D39)
    bits = np.packbits((mixed >> np.uint32(31)).astype(np.uint8)).tobytes()
    bands = least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for i in range(BAND_ROWS):
        key = _mix((key ^ bands[:, i]) * _MIX)
    return key.astype(np.int64), bits


def _set_key(h: np.ndarray) -> int:
    """One 64-bit key of a whole shingle set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64))


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            ids, sets, n, keys, bits = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = shingler.hashes(text)
                if len(h):
                    k, b = fingerprint(h)
                    ids.append(i), sets.append(_set_key(h)), n.append(len(h)), keys.append(k), bits.append(b)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.string()),
                    pa.array(sets, pa.int64()),
                    pa.array(n, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * BANDS, pa.int32()), pa.array(flat)),
                    pa.array(bits, pa.binary()),
                ],
                ["rec_id", "set_key", "n_shingles", "band_keys", "bits"],
            )

    return run


def signatures(records: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(rec_id, set_key, n_shingles, band_keys, bits) of each record with at least one shingle; null texts have none."""
    return (
        records.select(F.col(id_col).cast("string").alias("rec_id"), F.col(text_col).alias("body"))
        .where("rec_id is not null and body is not null")
        .mapInArrow(_signatures(words), "rec_id string, set_key long, n_shingles int, band_keys array<long>, bits binary")
    )


def _runs(*cols: np.ndarray) -> np.ndarray:
    """Where a new run of equal values begins in sorted columns."""
    new = np.zeros(len(cols[0]), bool)
    if len(new):
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def trie_join(key: np.ndarray, bits: np.ndarray, budget: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) with the same key whose fingerprints differ in at most budget bits.

    key: one trie a key. bits: n x 8 words of 16 bits, one word a stride of 16 trie levels. Node pairs of all tries go
    down one stride at a time; a node pair's children pairs inherit its error and are dropped beyond the budget. Two nodes of one row each
    are paths: what is left of their error is added up at once. The traversal goes depth first in slices of FRONTIER node pairs, of which
    a level holds one. With side (0 or 1), only pairs of rows of different sides are returned.
    """
    n, strides = len(key), bits.shape[1]
    order = np.lexsort([*(bits[:, k] for k in range(strides - 1, -1, -1)), key])
    key, bits = key[order], np.ascontiguousarray(bits[order])
    paths = bits.view(np.uint64)
    edges = [_runs(key)]
    for depth in range(1, strides + 1):
        edges.append(_runs(key, *(bits[:, k] for k in range(depth))))
    ends = [np.append(e[1:], n) for e in edges]
    out_a, out_b = [], []

    def found(i: np.ndarray, j: np.ndarray) -> None:
        keep = i < j if side is None else (i < j) & (side[order[i]] != side[order[j]])
        out_a.append(order[i[keep]]), out_b.append(order[j[keep]])

    def descend(depth: int, a: np.ndarray, b: np.ndarray, err: np.ndarray) -> None:
        start, size = edges[depth], ends[depth] - edges[depth]
        path = (size[a] == 1) & (size[b] == 1)
        i, j = start[a[path]], start[b[path]]
        near = np.bitwise_count(paths[i] ^ paths[j]).sum(1) <= budget
        found(i[near], j[near])
        a, b, err = a[~path], b[~path], err[~path]
        if depth == strides:  # leaves: nodes of equal fingerprints
            for _, i, j in _cross_slices(start[a], size[a], start[b], size[b]):
                found(i, j)
            return
        child = edges[depth + 1]
        first = np.searchsorted(child, start, "left")
        many = np.append(first[1:], len(child)) - first
        word = bits[child, depth]
        for of, i, j in _cross_slices(first[a], many[a], first[b], many[b]):
            e = err[of] + np.bitwise_count(word[i] ^ word[j])
            keep = (i <= j) & (e <= budget)
            if keep.any():
                descend(depth + 1, i[keep], j[keep], e[keep])

    roots = np.flatnonzero(ends[0] - edges[0] > 1)
    descend(0, roots, roots, np.zeros(len(roots), np.int16))
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _cross_slices(start_a: np.ndarray, n_a: np.ndarray, start_b: np.ndarray, n_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(k, i, j) of all pairs of start_a[k] .. + n_a[k] with start_b[k] .. + n_b[k], about FRONTIER pairs at a time; one k may take many slices."""
    rows = np.maximum(1, FRONTIER // np.maximum(n_b, 1))
    times = -(-n_a // rows)
    of = np.repeat(np.arange(len(n_a)), times)
    skip = (np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)) * rows[of]
    sa, na, sb, nb = start_a[of] + skip, np.minimum(rows[of], n_a[of] - skip), start_b[of], n_b[of]
    work, begin = np.cumsum(na * nb), 0
    while begin < len(of):
        done = work[begin - 1] if begin else 0
        s = slice(begin, max(begin + 1, int(np.searchsorted(work, done + FRONTIER, "right"))))
        total = na[s] * nb[s]
        at, width = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total), np.repeat(nb[s], total)
        yield np.repeat(of[s], total), np.repeat(sa[s], total) + at // width, np.repeat(sb[s], total) + at % width
        begin = s.stop


_JOINED = "key_a long, key_b long, grp long, set_key long, bits binary"


def _join_partition(budget: int, block: int | None):
    """Join the tries of a partition that is sorted by key; a trie may stretch over batches.

    Yields pairs (key_a, key_b). A key of more than `block` rows is not joined here: its rows come out as (grp, set_key, bits), to be cut
    into blocks; at most block + one batch of rows are held.
    """
    names = ["key_a", "key_b", "grp", "set_key", "bits"]

    def pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        group, ids, sides = (t.column(c).to_numpy() for c in ("grp", "set_key", "side"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), ">u2").reshape(-1, BITS // 16).astype(np.uint16)
        crossing = sides >= 0  # rows of two blocks: only pairs between the blocks
        for part, side in ((~crossing, None), (crossing, sides)):
            at = np.flatnonzero(part)
            if len(at) < 2:
                continue
            i, j = trie_join(group[at], bits[at], budget, None if side is None else side[at])
            a, b = ids[at[i]], ids[at[j]]
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                for k in range(0, len(pairs), 100_000):
                    p = pairs[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.nulls(len(p), pa.int64()), pa.nulls(len(p), pa.int64()), pa.nulls(len(p), pa.binary())], names)

    def hot(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in t.combine_chunks().to_batches():
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), b.column("grp"), b.column("set_key"), b.column("bits")], names)

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """All of t's keys are complete."""
        if block is not None:
            group = t.column("grp").to_numpy()
            edges = _runs(group)
            sizes = np.diff(np.append(edges, len(group)))
            if (sizes > block).any():
                large = np.repeat(sizes > block, sizes)
                yield from hot(t.filter(pa.array(large)))
                t = t.filter(pa.array(~large))
        yield from pairs_of(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        passing: int | None = None  # a key that is known to be hot and still goes on
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 50_000:
                continue
            t = pa.Table.from_batches(held)
            g = t.column("grp").to_numpy()
            last = int(g[-1])
            if passing is not None:
                n = int(np.searchsorted(g, passing, "right"))
                yield from hot(t.slice(0, n))
                t, g = t.slice(n), g[n:]
                passing = passing if len(g) == 0 else None
            at = int(np.searchsorted(g, last, "left")) if len(g) else 0  # the last key may go on in the next batch
            if at:
                yield from flush(t.slice(0, at))
            t = t.slice(at)
            if block is not None and t.num_rows > block:
                yield from hot(t)
                passing, t = last, t.slice(t.num_rows)
            held = t.combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held)
            if passing is not None:
                n = int(np.searchsorted(t.column("grp").to_numpy(), passing, "right"))
                yield from hot(t.slice(0, n))
                t = t.slice(n)
            yield from flush(t)

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, n) of the band keys that come LOCAL_LEAST times or more among every LOCAL_KEYS keys of the task."""
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held) if held else np.empty(0, np.int64), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys[n >= LOCAL_LEAST]), pa.array(n[n >= LOCAL_LEAST].astype(np.int64))], ["grp", "n"])

    for batch in batches:
        held.append(batch.column(0).flatten().to_numpy())
        if sum(map(len, held)) >= LOCAL_KEYS:
            yield flush()
    yield flush()


def _in_blocks(rows: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """The rows of hot keys, each once for every pair of blocks of its key that its own block belongs to. sizes: (grp, count)."""
    return (
        salted_join(rows, sizes.select("grp", F.ceil(F.col("count") / block).cast("int").alias("n")), "grp", "inner")
        .withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(
            F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")).alias("grp"),
            "set_key",
            "bits",
            F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        )
    )


def candidate_pairs(sketches: DataFrame, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """Distinct (key_a, key_b), key_a < key_b, of the sketches whose tries meet within the error budget.

    sketches: one row a set_key with band_keys and bits, checkpointed. Hot band keys are found by counts inside the tasks, counted exactly
    and split into blocks before anything is shuffled by band: each row goes to each of the block pairs it belongs to, and no task
    gets more than two blocks. A key that is spread so thin over the tasks that none of them notices passes its task unjoined and is split then.
    Nothing is capped: each pair of blocks is joined.
    """
    rows = sketches.select(F.explode("band_keys").alias("grp"), "set_key", "bits")
    join = lambda df, limit: df.repartition("grp").sortWithinPartitions("grp").mapInArrow(_join_partition(budget, limit), _JOINED)
    noticed = cut(sketches.select("band_keys").mapInArrow(_frequent, "grp long, n long").groupBy("grp").agg(F.sum("n").alias("n")).where(F.col("n") > block).select("grp"))
    cold, split = rows, []
    if noticed.limit(1).count():
        sizes = cut(rows.select("grp").join(small(noticed), "grp", "left_semi").groupBy("grp").count())
        cold = rows.join(small(noticed), "grp", "left_anti")
        split.append(_in_blocks(rows.join(small(noticed), "grp", "left_semi"), sizes, block))
    joined = cut(join(cold.withColumn("side", F.lit(-1)), block))
    pairs = joined.where("key_a is not null").select("key_a", "key_b")
    late = joined.where("grp is not null").select("grp", "set_key", "bits")
    sizes = cut(late.groupBy("grp").count())
    if sizes.limit(1).count():
        split.append(_in_blocks(late, sizes, block))
    for part in split:
        pairs = pairs.unionByName(join(part, None).select("key_a", "key_b"))
    return pairs.distinct()


def _shingle_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            keys, blobs = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(k), blobs.append(shingler.hashes(text).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["set_key", "hashes"])

    return run


def _exact(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, like = [], [], []
            for x, y, s, t in zip(*(c.to_pylist() for c in batch.columns)):
                u, v = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                j = both / (len(u) + len(v) - both)
                if j >= threshold:
                    a.append(x), b.append(y), like.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(like, pa.float64())], ["key_a", "key_b", "likeness"])

    return run


def near_duplicate_links(records: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, words: int = 5, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Membership (rec_id, set_key) and links (key_a, key_b, likeness) between the classes of equal shingle sets.

    Records with a null id or text, or with fewer words than a shingle has, are in no class. Repeated rows count once.
    Bodies with the same shingle set are one class, joined to each other by likeness 1 without any link row; the links
    are pairs of different classes alike to threshold or more. Extra columns of records are not read.
    """
    ensure_checkpoint_dir(records.sparkSession)
    signed = cut(signatures(records, id_col, text_col, words))
    members = signed.select("rec_id", "set_key").distinct()
    sketches = cut(signed.groupBy("set_key").agg(F.min("rec_id").alias("rep_id"), F.any_value("band_keys").alias("band_keys"), F.any_value("bits").alias("bits")))
    pairs = cut(candidate_pairs(sketches, budget))
    wanted = pairs.select(F.explode(F.array("key_a", "key_b")).alias("set_key")).distinct()
    reps = cut(wanted.join(sketches.select("set_key", "rep_id"), "set_key"))
    # One text for each class in question: the texts are read again. While the representatives in question are few, they
    # are broadcast and no text is shuffled before it is filtered.
    texts = (
        records.select(F.col(id_col).cast("string").alias("rep_id"), F.col(text_col).alias("body"))
        .where("body is not null")
        .join(small(reps), "rep_id")
        .select("set_key", "body")
        .mapInArrow(_shingle_rows(words), "set_key long, hashes binary")
    )
    # A record id may stand for several texts: keep the hashes that make up this very class.
    sets = cut(texts.where(F.expr("length(hashes) > 0")).mapInArrow(_own_set, "set_key long, hashes binary").dropDuplicates(["set_key"]))
    a, b = sets.toDF("key_a", "h_a"), sets.toDF("key_b", "h_b")
    links = (
        pairs.join(a, "key_a").join(b, "key_b").select("key_a", "key_b", "h_a", "h_b")
        .mapInArrow(_exact(threshold), "key_a long, key_b long, likeness double")
    )
    return members, links


def _own_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [_set_key(np.frombuffer(h, np.uint64)) == k for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield batch.filter(pa.array(keep, pa.bool_()))


def record_pairs(members: DataFrame, links: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """Every pair of different record ids that the classes and links stand for, the smaller id first.

    This lists what the caller asks for pair by pair; near_duplicate_groups() is the form that stays linear. The records of a
    class stand in blocks of about `block`; a link meets each pair of blocks of its two classes, and a class meets itself block by block.
    """
    n_blocks = cut(members.groupBy("set_key").agg(F.count("*").alias("n")).where("n > 1").select("set_key", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    large = n_blocks.where("blocks > 1").select("set_key", "blocks")
    blocked = salted_join(members, large, "set_key").withColumn("part", F.pmod(F.xxhash64("rec_id"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    a, b = blocked.toDF("key_a", "id_a", "part_a"), blocked.toDF("key_b", "id_b", "part_b")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.coalesce(name, F.lit(1)) - 1))
    met = salted_join(salted_join(links, large.toDF("key_a", "n_a"), "key_a"), large.toDF("key_b", "n_b"), "key_b")
    met = met.withColumn("part_a", every("n_a")).withColumn("part_b", every("n_b")).drop("n_a", "n_b")
    across = met.join(a, ["key_a", "part_a"]).join(b, ["key_b", "part_b"]).select("id_a", "id_b", "likeness")
    mine = salted_join(blocked, n_blocks.select("set_key", "blocks"), "set_key", "inner")
    inside = (
        mine.withColumn("other", every("blocks")).select("set_key", F.col("part").alias("p"), F.col("other").alias("q"), F.col("rec_id").alias("id_a"))
        .join(mine.withColumn("other", every("blocks")).select("set_key", F.col("other").alias("p"), F.col("part").alias("q"), F.col("rec_id").alias("id_b")), ["set_key", "p", "q"])
        .where("id_a < id_b").select("id_a", "id_b", F.lit(1.0).alias("likeness"))
    )
    both = across.unionByName(inside).where("id_a <> id_b")
    return both.groupBy(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).agg(F.max("likeness").alias("likeness"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of an undirected graph of (a, b) keys, root the smallest node of its component.

    Alternates large-star and small-star rounds, each one grouping step, until nothing changes, which takes about the logarithm of the
    longest path; a hub's neighbours are only aggregated, never collected, and its rows are salted. Each round is checkpointed.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = cut(salted_join(both, least, "a", "inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        linked = salted_join(down, low, "a", "inner")
        nxt = cut(
            linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(linked.select("a", F.col("m").alias("b"))).where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        )
        if now.count() == nxt.count() and nxt.exceptAll(now).limit(1).count() == 0:
            return nxt.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = nxt


def near_duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row a record: (rec_id, class_id, group_id, n_copies, n_links).

    class_id is the class of equal shingle sets, group_id the smallest class key of the component, n_copies the other
    records of the class, n_links the linked other classes.
    """
    kept = cut(links.select("key_a", "key_b"))
    degree = kept.select(F.explode(F.array("key_a", "key_b")).alias("set_key")).groupBy("set_key").agg(F.count("*").alias("n_links"))
    roots = connected(kept.toDF("a", "b")).toDF("set_key", "root")
    size = members.groupBy("set_key").agg(F.count("*").alias("n"))
    facts = size.join(degree, "set_key", "left").join(roots, "set_key", "left")
    return members.join(facts, "set_key").select(
        "rec_id",
        F.col("set_key").alias("class_id"),
        F.coalesce("root", "set_key").alias("group_id"),
        (F.col("n") - 1).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
