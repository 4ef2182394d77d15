import collections
import os

import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing, packing, tokens
from corvane.session import table


def test_counts_equal_another_implementation(spark, tiny):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    docs = table(spark, tiny, "documents").select("doc_id", F.col("text").alias("_text"))
    got = {r.doc_id: r.n_tokens for r in tokens.with_token_counts(docs, F.col("_text"), "/opt/tokenizers/byte_bpe_50k.tiktoken").collect()}
    for r in docs.collect():
        assert got[r.doc_id] == (len(other.encode(r._text, add_special_tokens=False).ids) if r._text else 0)


def test_counts_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "a" * 200_000), (4, "<|endoftext|>"), (5, "é😀\u0000")]
    got = {r.i: r.n_tokens for r in tokens.with_token_counts(spark.createDataFrame(rows, "i int, _text string"), F.col("_text")).collect()}
    enc = tokens.encoding(tokens.TOKENIZER)
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in rows}


def test_cube_totals(spark, tiny):
    docs, codes = table(spark, tiny, "documents"), table(spark, tiny, "lang_codes")
    cube = tokens.document_budget(docs, codes)
    total = cube.where("level = 7").first()
    enc = tokens.encoding(tokens.TOKENIZER)
    want = [len(enc.encode_ordinary(r.text)) if r.text else 0 for r in docs.select("text").collect()]
    assert total.n_docs == len(want) and total.n_tokens == sum(want)
    for level, keep in ((3, "source"), (5, "language"), (6, "x_domain")):
        assert cube.where(f"level = {level}").agg(F.sum("n_tokens")).first()[0] == sum(want), keep
    assert not {r.source for r in cube.where("level = 3").select("source").collect()} & {"HANDBOOK-MAIN", "velmar_queue_docs", None}


def test_budget_of_empty_tables(spark, tiny):
    docs, atoms, codes = (table(spark, tiny, t).limit(0) for t in ("documents", "atoms", "lang_codes"))
    assert all(r.n_docs in (None, 0) for r in tokens.token_budget(docs, atoms, codes).collect())


def test_counts_of_single_texts(spark, tiny):
    from corvane.llm import queries

    enc = tokens.encoding(tokens.TOKENIZER)
    size = lambda t: len(enc.encode_ordinary(t)) if t else 0
    rows = queries.queries()["p2_token_counts"](spark, tiny).collect()
    assert {r.doc_id: r.n_tokens for r in rows if r.slice_of == "documents"} == {r.doc_id: size(r.text) for r in table(spark, tiny, "documents").collect()}
    atoms = {(r.atom_id, r.ingested_at, r.removed_at, size(r.body)) for r in table(spark, tiny, "atoms").collect()}
    assert {(r.atom_id, r.ingested_at, r.removed_at, r.n_tokens) for r in rows if r.slice_of == "atoms"} == atoms
    cubes = {r.slice_of: r.n_tokens for r in queries.queries()["p2_token_budget"](spark, tiny).where("level = 7").collect()}
    assert cubes == {s: sum(r.n_tokens for r in rows if r.slice_of == s) for s in ("documents", "atoms")}


def checked(spark, sizes, **kw):
    rows = [(str(i), s) for i, s in enumerate(sizes)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc string, n long, container string, box int").repartition(3)
    out = packing.pack(df, "doc", "n", **kw).collect()
    capacity = kw.get("capacity", packing.CAPACITY)
    by_item, by_box = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by_item[r.item].append(r)
        if r.container is not None:
            by_box[r.container].append(r)
    assert set(by_item) == {i for i, _ in rows}
    for i, s in rows:
        parts = by_item[i]
        assert sum(p.size for p in parts) == max(s or 0, 0)
        if (s or 0) <= capacity:
            assert len(parts) == 1
        else:
            assert sorted(p.piece for p in parts) == list(range(len(parts))) and all(p.size == capacity for p in parts if p.piece < len(parts) - 1)
    for rs in by_box.values():
        rs.sort(key=lambda r: r.position)
        assert [r.position for r in rs] == list(range(len(rs)))
        at = 0
        for r in rs:
            assert r.start == at
            at += r.size
        assert at <= capacity and abs(rs[0].fill - at / capacity) < 1e-12
    return by_box


def test_packing_is_whole_and_tight(spark):
    import random

    rng = random.Random(5)
    sizes = [int(rng.lognormvariate(5, 1)) + 1 for _ in range(4_000)]
    boxes = checked(spark, sizes, capacity=1_000, open_windows=16, fan_in=2)
    least = -(-sum(sizes) // 1_000)
    assert len(boxes) <= 1.03 * least + 2


def test_packing_odd_items(spark):
    checked(spark, [0, None, 5, 10, 10, 11, 30, 35, 3, 3, 3], capacity=10, open_windows=2)
    checked(spark, [], capacity=10)
    checked(spark, [7] * 50, capacity=10, open_windows=1)
    with pytest.raises(ValueError):
        packing.pack(spark.range(1).selectExpr("id", "id n"), "id", "n", capacity=0)


def test_best_fit_prefers_the_tightest_window():
    fit = packing.BestFit(10, 2, "")
    assert fit.put(6)[0] == 0 and fit.put(5)[0] == 1
    assert fit.put(4)[0] == 0  # leaves nothing in the fuller one
    assert fit.put(8)[0] == 2  # a window is free now
    assert fit.put(9)[3] == 2  # none fits: the fullest goes


def test_mixture_meets_shares_and_caps(spark):
    rows = [(i, s, 10 + i % 7, "x") for s, n in (("big", 3_000), ("mid", 900), ("small", 120)) for i in range(n)]
    rows = [(f"{s}-{i}", s, t, x) for i, s, t, x in rows] + [("none-1", "untargeted", 50, "x"), ("null-1", None, 50, "x"), ("big-empty", "big", 0, "x")]
    sized = spark.createDataFrame(rows, "doc_id string, source string, n_tokens long, rate string").drop("rate")
    targets = spark.createDataFrame([("Big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 4), ("absent", 0.1, 9), ("nul", None, None)], "source string, target_share double, max_repeats int")
    rates = mixing.source_rates(sized, targets)
    mixture = mixing.mix(sized, rates, "doc_id")
    report = {r.source: r for r in mixing.mix_report(mixture, rates).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(report[s].actual_share - share) < 0.02
    assert report["absent"].actual_share == 0 and report["nul"].rate == 0
    most = {r.source: r.m for r in mixture.groupBy("doc_id", "source").agg(F.max("copy_no").alias("m")).groupBy("source").agg(F.max("m").alias("m")).collect()}
    assert most["big"] <= 1 and most["mid"] <= 3 and most["small"] <= 4 and "untargeted" not in most
    again = mixing.mix(sized.repartition(7), rates, "doc_id")
    assert again.exceptAll(mixture).count() == 0 and mixture.exceptAll(again).count() == 0


def test_mixture_of_given_size_stays_under_caps(spark):
    sized = spark.createDataFrame([(str(i), "a" if i % 10 else "b", 10) for i in range(1_000)], "doc_id string, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    rates = mixing.source_rates(sized, targets, total=10_000)
    assert {r.source: round(r.rate, 6) for r in rates.collect()} == {"a": round(5_000 / 9_000, 6), "b": 2.0}


def test_mixture_of_nothing(spark):
    sized = spark.createDataFrame([], "doc_id string, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2)], "source string, target_share double, max_repeats int")
    rates = mixing.source_rates(sized, targets)
    assert mixing.mix(sized, rates, "doc_id").count() == 0 and mixing.mix_report(mixing.mix(sized, rates, "doc_id"), rates).count() == 1


def test_tokenizers_are_not_in_the_repository():
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [f for _, _, fs in os.walk(os.path.join(here, "corvane")) for f in fs if f.endswith((".tiktoken", ".model", ".json"))]


def test_rows_that_differ_anywhere_stay_apart(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    row = lambda title, build, body="two words": ("a", "doc", title, "docs", ["s.md"], body, build, t, None, "x")
    rows = [row("t", 1), row("t", 1), row("u", 1), row("t", 2), row(None, 1), row("t", None), row("t", 1, "two wards"), row("t", 1, None)]
    atoms = spark.createDataFrame(rows, "atom_id string, atom_type string, title string, x_domain string, sources array<string>, body string, build_id long, ingested_at timestamp, removed_at timestamp, source string")
    assert tokens.atom_counts(atoms).count() == 7


def test_the_tokenizer_goes_to_the_workers(spark):
    from pyspark import SparkFiles

    tokens.ship(spark, tokens.TOKENIZER)
    assert os.path.exists(SparkFiles.get(os.path.basename(tokens.TOKENIZER))) and tokens._local("/nowhere/else.tiktoken") == "/nowhere/else.tiktoken"


def test_a_repeated_text_counts_once_for_its_cap(spark):
    rows = [(i, "a", "the same text stands here") for i in range(50)] + [(100 + i, "a", f"text number {i}") for i in range(50)] + [(200 + i, "b", f"other text {i}") for i in range(500)] + [(900, "a", None), (901, "a", None)]
    sized = mixing.sized_documents(spark.createDataFrame(rows, "doc_id long, source string, text string"), tokens.TOKENIZER)
    assert sized.where("source = 'a'").count() == 53 and sized.where("doc_id < 50").first().doc_id == 0
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    mixture = mixing.mix(sized, mixing.source_rates(sized, targets), "doc_id")
    assert mixture.where("doc_id < 50").count() <= 3
