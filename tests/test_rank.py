import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from corvane.api import Profile, SearchRequest, search
from corvane.operators import index as ix
from corvane.operators import rank as rk

BODIES = {"aaa": "the quick brown fox jumps", "bbb": "quick brown dogs and the fox", "ccc": "a brown quick fox the the the", "ddd": "nothing here at all", "zzz": "the quick brown fox jumps"}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "title", b, "docs", "review", "stable", None, [f"{i}.md"], 0) for i, b in BODIES.items()]
    return spark.createDataFrame(rows, "atom_id string, title string, body string, x_domain string, atom_type string, status string, stale_after string, sources array<string>, origin_index int")


def queries(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query_text string")


def fts5(match):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, body, tokenize = 'unicode61')")
    con.executemany("INSERT INTO t VALUES (?, ?)", BODIES.items())
    return {i: -s for i, s in con.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", (match,))}


@pytest.mark.parametrize("text,match", [("fox", "fox"), ("quick-brown", '"quick brown"'), ("nothing fox", "nothing OR fox"), ("nothing nothing", "nothing OR nothing")])
def test_fts_scores_equal_sqlite(spark, corpus, text, match):
    fields = ix.indexed_fields(corpus)
    got = rk.fts_top(ix.placed_fields(fields, "nostem-fold", ("body",)), "nostem-fold", rk.disjuncts(queries(spark, text), "nostem-fold"), {"body": 1.0}, 100)
    got, want = {r.atom_id: r.score for r in got.collect()}, fts5(match)
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_linear_bm25_by_hand(spark, corpus):
    idx = ix.Index.build(corpus, "nostem-fold")
    got = {r.atom_id: r.score for r in rk.bm25(idx, rk.query_terms(queries(spark, "Brown brown"), "nostem-fold")).collect()}
    n, df, avg = 5, 4, (5 + 6 + 7 + 4 + 5) / 5
    want = lambda tf, length: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))
    assert got == {"aaa": round(want(1, 5), 9), "bbb": round(want(1, 6), 9), "ccc": round(want(1, 7), 9), "zzz": round(want(1, 5), 9)}


def test_ties_by_id_and_limits(spark, corpus):
    idx = ix.Index.build(corpus, "nostem-fold")
    top = rk.top_k(rk.bm25(idx, rk.query_terms(queries(spark, "jumps", "", "unknown"), "nostem-fold")), 1).collect()
    assert [(r.query_id, r.atom_id, r.rank) for r in top] == [("q0", "aaa", 1)]


def test_empty_corpus_and_null_bodies(spark, corpus):
    for c in (corpus.limit(0), corpus.withColumn("body", F.lit(None).cast("string"))):
        idx = ix.Index.build(c, "nostem-fold")
        assert rk.bm25(idx, rk.query_terms(queries(spark, "fox"), "nostem-fold")).count() == 0
        assert idx.stats().first().avg_len == 0


def test_feedback_weights_by_hand(spark):
    terms = spark.createDataFrame([("q", "a", 1)], "query_id string, term string, qtf long")
    ranked = spark.createDataFrame([("q", "d1", 1, 3.0), ("q", "d2", 2, 1.0)], "query_id string, atom_id string, rank int, score double")
    postings = spark.createDataFrame([("d1", 2, "a", 1), ("d1", 2, "b", 1), ("d2", 2, "b", 1), ("d2", 2, "c", 1)], "atom_id string, doc_len int, term string, tf long")
    got = {r.term: r.weight for r in rk.rm3_weights(terms, ranked, postings, 10, 2, 0.5).collect()}
    assert set(got) == {"a", "b"} and abs(got["a"] - 5 / 7) < 1e-9 and abs(got["b"] - 2 / 7) < 1e-9


def test_index_round_trip_refuses_another_analyzer(spark, corpus, tmp_path):
    ix.Index.build(corpus, "porter-fold").write(str(tmp_path))
    assert ix.Index.read(spark, str(tmp_path), "porter-fold").postings.count() > 0
    with pytest.raises(ValueError):
        ix.Index.read(spark, str(tmp_path), "nostem-fold")


def test_document_sums_need_no_shuffle(spark, corpus):
    idx = ix.Index.build(corpus, "nostem-fold")
    plan = rk.top_k(rk.bm25(idx, rk.query_terms(queries(spark, "fox"), "nostem-fold")), 2)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan
    assert not any("Exchange hashpartitioning(query_id" in line and "atom_id" in line.split("Exchange")[1].split("]")[0] for line in plan.splitlines())


def test_dense_search(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), ("c", [0.0, 0.0])], "query_id string, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.rank) for r in rk.dense_knn(vectors, q, 2, block=1, vector_block=2).orderBy("rank").collect()] == [("a", 1, 1), ("a", 2, 2)]
    assert [(r.query_id, r.vec_id, r.rank) for r in rk.dense_knn(vectors, q, 2, block=10).orderBy("rank").collect()] == [("a", 1, 1), ("a", 2, 2)]
    assert rk.dense_knn(vectors.limit(0), q, 2).count() == 0 and rk.dense_knn(vectors, q.limit(0), 2).count() == 0


@pytest.mark.parametrize("ranker", ["linear", "fts", "bm25plus", "body", "prf"])
def test_search(spark, corpus, ranker):
    stale = corpus.withColumn("status", F.when(F.col("atom_id") == "aaa", "deprecated").otherwise("stable")).withColumn("stale_after", F.when(F.col("atom_id") == "zzz", "2020-01-01"))
    got = search(queries(spark, "quick fox"), stale, SearchRequest(k=3, ranker=ranker, as_of="2024-01-01", analyzer="nostem-fold")).collect()
    assert {r.atom_id for r in got} <= {"bbb", "ccc"} and len(got) >= 1
    with pytest.raises(ValueError):
        search(queries(spark, "x"), corpus, SearchRequest(domains=[]))


def test_dense_and_hybrid_search(spark, corpus):
    vectors = spark.createDataFrame([("aaa", [1.0, 0.0]), ("bbb", [0.0, 1.0]), ("ccc", [0.7, 0.7]), ("ddd", [-1.0, 0.0])], "atom_id string, embedding array<double>")
    asked = spark.createDataFrame([("q0", [1.0, 0.1])], "query_id string, embedding array<double>")
    q = queries(spark, "fox")
    run = lambda **kw: [r.atom_id for r in search(q, corpus, SearchRequest(analyzer="nostem-fold", max_per_doc=None, **kw), vectors=vectors, query_vectors=asked).orderBy("rank").collect()]
    assert run(k=3, ranker="dense") == ["aaa", "ccc", "bbb"]
    assert run(k=2, ranker="hybrid") == ["aaa", "ccc"] and set(run(k=8, ranker="hybrid-full")) == {"aaa", "zzz", "bbb", "ccc", "ddd"}
    assert run(k=2, ranker="hybrid", domains=["docs"]) == ["aaa", "ccc"]
    assert set(run(k=10, ranker="fused", legs=("fts", "linear", "prf"))) == {"aaa", "bbb", "ccc", "zzz"}
    with pytest.raises(ValueError, match="vectors"):
        search(q, corpus, SearchRequest(ranker="dense"))


@pytest.mark.parametrize(("kw", "message"), [
    ({"types": ["review"], "exclude_types": ["plan"]}, "each state"), ({"types": ["reviews"]}, "unknown type"), ({"domains": ["dox"]}, "unknown domain"), ({"exclude_types": ["x"]}, "unknown type"), ({"ranker": "best"}, "unknown ranker"),
    ({"analyzer": "none"}, "unknown analyzer"), ({"ranker": "fused", "legs": ("fts",)}, "two or more"), ({"ranker": "fused", "legs": ("fts", "fts")}, "two or more"), ({"ranker": "fused", "legs": ("fts", "body")}, "unknown leg"),
    ({"exclude_types": ["review", "brainstorm"]}, "nothing could be searched"), ({"budget": 10, "overhead": 11}, "overhead"),
])
def test_requests_that_are_refused(spark, corpus, kw, message):
    with pytest.raises(ValueError, match=message):
        search(queries(spark, "fox"), corpus, SearchRequest(**kw), PROFILE)


PROFILE = Profile(("docs",), ("review", "brainstorm"), ("brainstorm",))


def test_the_profile_leaves_types_out(spark, corpus):
    mixed = corpus.withColumn("atom_type", F.when(F.col("atom_id") == "aaa", "brainstorm").otherwise("review"))
    run = lambda **kw: {r.atom_id for r in search(queries(spark, "fox"), mixed, SearchRequest(analyzer="nostem-fold", **kw), PROFILE).collect()}
    assert run() == {"bbb", "ccc", "zzz"} and run(include_history=True) == {"aaa", "bbb", "ccc", "zzz"}
    assert run(exclude_types=["review"]) == {"aaa"} == run(types=["brainstorm"])


def test_overhead_is_part_of_the_budget(spark, corpus):
    run = lambda overhead: search(queries(spark, "fox"), corpus, SearchRequest(analyzer="nostem-fold", budget=60, overhead=overhead)).count()
    assert run(0) == 2 and run(30) == 1 and run(60) == 0


def test_weights_beyond_the_broadcast_give_the_same_ranking(spark, corpus, monkeypatch):
    q = rk.query_terms(queries(spark, "quick fox", "the jumps", "nothing"), "nostem-fold")
    idx = ix.Index.build(corpus, "nostem-fold").stored()
    want = [tuple(r) for r in rk.bm25_top(idx, q, 3).orderBy("query_id", "rank").collect()]
    full = [tuple(r)[:3] for r in rk.top_k(rk.bm25(idx, q), 3).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(rk, "CELLS", 3)
    assert [tuple(r) for r in rk.bm25_top(idx, q, 3).orderBy("query_id", "rank").collect()] == want and [t[:3] for t in want] == full
    monkeypatch.setattr(rk, "BROADCAST_ROWS", 1)
    assert [tuple(r) for r in rk.bm25_top(idx, q, 3).orderBy("query_id", "rank").collect()] == want


def test_renderings_escape(spark):
    from corvane.operators import deliver as dv

    rows = spark.createDataFrame([("q", 2, "b", "d", None, 1.0, 'a <b> & "c"'), ("q", 1, "a'", "d", "T", None, None)], "query_id string, place int, atom_id string, document string, title string, score double, body string")
    one = lambda f: f(rows).first().rendered
    assert one(dv.render_xml) == '<atoms><atom place="1" id="a&apos;" document="d" title="T"></atom><atom place="2" id="b" document="d" title="">a &lt;b&gt; &amp; &quot;c&quot;</atom></atoms>'
    import json
    assert [x["atom_id"] for x in json.loads(one(dv.render_json))] == ["a'", "b"] and one(dv.render_text).startswith("1. T [a'] d\n\n\n2. b [b] d\na <b>")


def test_dense_search_in_blocks_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8))
    m[7] = m[3]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    n = m / np.linalg.norm(m, axis=1)[:, None]
    want = {(i, j) for i in range(0, 300, 20) for j in sorted(range(300), key=lambda j: (-round(float(n[i] @ n[j]), 9), j))[:5]}
    for kw in ({}, {"block": 4, "vector_block": 50}):
        assert {(r.query_id, r.vec_id) for r in rk.dense_knn(v, q, 5, **kw).collect()} == want


def test_a_grid_of_cells_equals_each_cell(spark, corpus, monkeypatch):
    q, idx = rk.query_terms(queries(spark, "quick fox", "the jumps", "nothing", "unknown"), "nostem-fold"), ix.Index.build(corpus, "nostem-fold")
    grid = spark.createDataFrame([(0.9, 0.4), (1.2, 0.75), (1.5, 0.4)], "k1 double, b double")
    want = {(c.k1, c.b, *r) for c in grid.collect() for r in rk.top_k(rk.bm25(idx, q, c.k1, c.b), 2).select("query_id", "atom_id", "score", "rank").collect()}
    for cells, limit in ((8_192, 100_000), (3, 100_000), (8_192, 1)):
        monkeypatch.setattr(rk, "CELLS", cells)
        monkeypatch.setattr(rk, "BROADCAST_ROWS", limit)
        assert {tuple(r) for r in rk.sweep_top(idx, q, grid, 2).collect()} == want


def test_a_task_leaves_its_k_best_over_all_its_blocks(spark, monkeypatch):
    from corvane.operators import blocks as bl
    import pyarrow as pa

    docs = pa.RecordBatch.from_pydict({"atom_id": [f"a{i % 7}{i:03d}" for i in range(300)], "doc_len": [5 + i % 3 for i in range(300)], "terms": [["x"] * (1 + i % 4) + ["y"] * (i % 2) for i in range(300)]})
    asked = bl.Asked.of(pa.table({"query_id": ["p", "q", "q"], "term": ["x", "x", "y"], "weight": [1.0, 1.0, 0.5]}))
    got = [[r for b in bl.best([docs], asked, bl.Scorer([(1.2, 0.75)], 6.0, 0.0, width), 4) for r in b.to_pylist()] for width in (300, 7)]
    assert got[0] == got[1] and len(got[0]) == 8  # not 4 a query and block


def test_ranks_of_pairs_are_those_of_the_whole_ranking(spark, corpus, monkeypatch):
    q, idx = rk.query_terms(queries(spark, "quick fox", "the jumps", "nothing", "unknown"), "nostem-fold"), ix.Index.build(corpus, "nostem-fold")
    wanted = spark.createDataFrame([(f"q{i}", a) for i in range(5) for a in ("aaa", "ccc", "zzz", "ddd", "none")], "query_id string, atom_id string")
    full = rk.top_k(rk.bm25(idx, q), 3).select("query_id", "atom_id", "rank").join(wanted, ["query_id", "atom_id"], "left_semi")
    want = {tuple(r) for r in full.collect()}
    assert ("q0", "zzz", 2) in want  # a tie with aaa
    for cells, limit in ((8_192, 100_000), (2, 100_000), (8_192, 1)):
        monkeypatch.setattr(rk, "CELLS", cells)
        monkeypatch.setattr(rk, "BROADCAST_ROWS", limit)
        assert {tuple(r) for r in rk.ranks_of(idx, q, wanted, 3).collect()} == want


def test_feedback_from_rows_equals_that_from_postings(spark, corpus):
    idx, words = ix.Index.build(corpus, "nostem-fold"), rk.query_terms(queries(spark, "quick fox", "nothing", "unknown fox fox"), "nostem-fold", distinct=False)
    terms, want = words.withColumn("qtf", F.lit(1).cast("long")), {}
    first = rk.bm25_top(idx, terms, 3)
    want = {(r.query_id, r.term): round(r.weight, 9) for r in rk.rm3_weights(words, first, idx.postings, 3, 4).collect()}
    assert {(r.query_id, r.term): round(r.weight, 9) for r in rk.rm3_weights(words, first, idx.rows, 3, 4).collect()} == want
    numbers, asked, names = rk.all_numbered(idx, words)
    again = rk.bm25_top(numbers, asked.withColumn("qtf", F.lit(1).cast("long")), 3)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in first.collect()}
    assert {(r.query_id, r.term): round(r.weight, 9) for r in rk.in_words(rk.rm3_weights(asked, again, numbers.rows, 3, 4), names).collect()} == want


def test_lean_atoms_are_the_current_ones(spark):
    atoms = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, None, "y"), ("b", 1, 3, "z"), (None, 1, None, "n")], "atom_id string, ingested_at int, removed_at int, body string")
    assert {tuple(r) for r in ix.lean_atoms(atoms).collect()} == {tuple(r) for r in ix.current_atoms(atoms).collect()} == {("a", 2, None, "y"), ("b", 1, 3, "z")}
