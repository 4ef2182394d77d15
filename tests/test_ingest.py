import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import chunking as ch
from corvane.operators import ingest as ing
from corvane.operators import runs
from corvane.sources import evaluation as se
from corvane.sources import markdown as md


def chunks(text, **kw):
    return [(c.chain, c.title, c.body) for c in ch.chunk_markdown(text, **kw)]


def test_headings_and_preamble():
    long = "x" * 300
    assert chunks(f"{long}\n# A\n{long}\n## B\n{long}\n# C\n{long}") == [([], "(preamble)", long), (["A"], "A", long), (["A", "B"], "B", long), (["C"], "C", long)]
    assert [c[0] for c in chunks(f"# A\n{long}\n### D\n{long}")] == [["A"], ["A", "D"]]
    assert chunks("") == []


def test_fences_hide_headings():
    body = "```\n# no heading\n```\n" + "y" * 300
    assert chunks(f"# A\n{body}") == [(["A"], "A", body)]


def test_front_matter():
    text = "<!-- c -->\n\n---\ntitle: 'My page'\nkey: 1\n---\n# A\n" + "z" * 300
    assert ch.front_matter_title(text) == "My page" and len(chunks(text)) == 1
    assert ch.front_matter_title("---\nno keys\n---\n") is None


def test_small_sections_merge():
    long = "x" * 300
    assert chunks(f"# A\nshort\n## B\n{long}") == [(["A", "B"], "B", f"short\n\n{long}")]
    assert chunks(f"# A\n{long}\n## B\ntail") == [(["A"], "A", f"{long}\n\n## B\n\ntail")]
    assert len(chunks(f"# A\n{long}\n# B\ntail")) == 2


def test_oversize_splits_keep_limits_and_frames():
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'v' * 40} |" for i in range(300))
    parts = [b for _, _, b in chunks("# T\n" + table)]
    assert len(parts) > 2 and all(ch.units(p) <= ch.MAX_UNITS and p.startswith("| a | b |\n|---|---|") for p in parts)
    fence = "```py\n" + "\n".join("z" * 70 for _ in range(200)) + "\n```"
    parts = [b for _, _, b in chunks("# F\n" + fence)]
    assert all(p.startswith("```py") and p.rstrip().endswith("```") for p in parts) and len(parts) > 2
    assert len(chunks("# F\n```\n" + "z" * 6_000 + "\n```")) == 1
    assert all(ch.units(b) <= ch.MAX_UNITS for _, _, b in chunks("# L\n" + "😀" * 9_000))


DOCS = "source_path string, text string, domain string, doc_type string"


def test_ingest_end_to_end(spark):
    long = "Some words of a body. " * 20
    rows = [("docs/a.md", f"# Page\n{long}\n## Part\n{long}", "docs", None), ("docs/b.md", f"# Page\n{long}other", "docs", "review"), ("docs/c.md", None, "docs", None), (None, long, "docs", None)]
    atoms = ing.ingest(spark.createDataFrame(rows, DOCS)).collect()
    assert len(atoms) == 3 and len({a.atom_id for a in atoms}) == 3
    a = sorted((x for x in atoms if x.sources == ["docs/a.md"]), key=lambda x: x.origin_index)
    assert [(x.origin_index, x.origin_count) for x in a] == [(0, 2), (1, 2)] and a[1].body.startswith("# Page > Part\n\n")
    assert {x.atom_type for x in atoms} == {"knowledge", "review"}


def test_dedupe_and_provenance(spark):
    long = "b" * 300
    rows = [("z", long, "d1", ["d1"]), ("a", f"# T\n\n{long}", "d2", ["d2"]), ("m", long, "d3", ["d3", "d1"]), ("s1", "short", "d4", ["d4"]), ("s2", "short", "d5", ["d5"]), ("n", None, "d6", ["d6"])]
    df = spark.createDataFrame(rows, "atom_id string, body string, document string, sources array<string>")
    out = ing.dedupe_bodies(df)
    assert {r.atom_id: r.survivor_id for r in out.collect()} == {"z": "a", "a": "a", "m": "a", "s1": "s1", "s2": "s2", "n": "n"}
    assert {r.atom_id: r.sources for r in ing.merge_provenance(out).collect()}["a"] == ["d2", "d3", "d1"]
    judged = spark.createDataFrame([("d1",)], "document string")
    assert {r.atom_id: r.survivor_id for r in ing.dedupe_bodies(df, judged).collect()}["a"] == "z"
    both = spark.createDataFrame([("d1",), ("d3",)], "document string")
    kept = {r.atom_id: r.survivor_id for r in ing.dedupe_bodies(df, both).collect()}
    assert kept["z"] == "z" and kept["m"] == "m" and kept["a"] == "m"


def test_labels_by_longest_prefix(spark):
    rules = spark.createDataFrame([("docs/", "d"), ("docs/x/", "x"), ("docs/x/y.md", "file")], "prefix string, label string")
    df = spark.createDataFrame([("docs/a.md",), ("docs/x/b.md",), ("docs/x/y.md",), ("other",), (None,)], "p string")
    assert {r.p: r.l for r in ing.label_by_path(df, rules, "p", "l").collect()} == {"docs/a.md": "d", "docs/x/b.md": "x", "docs/x/y.md": "file", "other": None, None: None}


def test_refusals_collect_all_reasons(spark):
    df = spark.createDataFrame([("ok-1", "b", "docs", "review", ["s"]), ("Bad Id", "", "nope", None, []), ("dup", "b", "docs", "review", ["s"]), ("dup", "b", "docs", "review", ["s"]), (None, None, None, None, None)], "atom_id string, body string, x_domain string, atom_type string, sources array<string>")
    got = [(r.atom_id, r.reasons) for r in ing.refusals(df, ["docs"], ["review"]).collect()]
    assert ("ok-1", []) in got and [r for i, r in got if i == "Bad Id"][0] == ["id is no slug", "unknown domain", "unknown type", "no source", "empty body"]
    assert all(r == ["id is not unique"] for i, r in got if i == "dup") and len([r for i, r in got if i is None][0]) == 6


def test_markdown_reader_and_atom_files(spark, tmp_path):
    for name, text in (("a.md", "one"), ("sub/b.md", "two"), ("sub/c.txt", "no"), ("skip/d.md", "three")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = md.read_markdown(spark, [str(tmp_path), str(tmp_path / "a.md")], exclude=("skip/",), base=str(tmp_path))
    assert {(r.source_path, r.text) for r in got.collect()} == {("a.md", "one"), ("sub/b.md", "two")}
    with pytest.raises(Exception):
        md.read_markdown(spark, [str(tmp_path / "absent")])
    atom = {"atom_id": "x-1", "atom_type": "review", "title": 'A "b": c', "x_domain": "docs", "status": "stable", "summary": None, "heading_chain": "A > B", "origin_index": 1, "origin_count": 2, "stale_after": "2025-01-01", "verified_by": None, "verified_at": None, "sources": ["s.md"], "body": "text\nmore"}
    df = spark.createDataFrame([tuple(atom.values())], "atom_id string, atom_type string, title string, x_domain string, status string, summary string, heading_chain string, origin_index int, origin_count int, stale_after string, verified_by string, verified_at string, sources array<string>, body string")
    back = md.parse_atoms(md.serialise_atoms(df).toDF("source_path", "text")).first()
    assert back.ok and (back.id, back.title, back.heading_chain, back.origin_index, back.sources, back.body) == ("x-1", 'A "b": c', "A > B", "1", ["s.md"], "text\nmore")
    assert md.parse_atom("---\ncolour: red\n---\n")[1].startswith("unknown line") and md.parse_atom("no")[1] == "no front matter"
    md.write_atoms(df, str(tmp_path / "out"), "me")
    with pytest.raises(ValueError):
        md.write_atoms(df, str(tmp_path / "out"), "other")


def test_evaluation_readers(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d/1", "title": "T", "text": "x"}\n{"_id": "", "text": "y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "hello", "axis": ""}\n{"_id": "q2", "text": " "}\n')
    (tmp_path / "qrels.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td/1\t1\nq1\td/1\t2\nq2\td/1\t1\n")
    assert [tuple(r) for r in se.read_beir_corpus(spark, str(tmp_path / "corpus.jsonl")).collect()] == [("d_1", "T", "x")]
    q, qrels = se.read_beir_queries(spark, str(tmp_path / "queries.jsonl")), se.read_qrels(spark, str(tmp_path / "qrels.tsv"))
    assert {(r.query_id, r.doc_id, r.grade) for r in qrels.collect()} == {("q1", "d_1", 2), ("q2", "d_1", 1)}
    assert [r.query_id for r in se.topics_of(q, qrels).collect()] == ["q1"] and q.first().axis is None
    (tmp_path / "clash.jsonl").write_text('{"_id": "a/b"}\n{"_id": "a_b"}\n')
    with pytest.raises(ValueError):
        se.read_beir_corpus(spark, str(tmp_path / "clash.jsonl"))


def test_trec(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string").coalesce(1)
    assert [tuple(r) for r in se.parse_trec(lines("q Q0 d 1 2.5 tag", "")).collect()] == [("q", "d", 1, 2.5, "tag")]
    with pytest.raises(Exception, match="malformed run line"):
        se.parse_trec(lines("q Q0 d")).collect()
    assert [(r.doc_id, r["rank"]) for r in se.parse_trec(lines("q Q0 b", "q Q0 a"), strict=False).orderBy("rank").collect()] == [("b", 1), ("a", 2)]


def test_nested_questions(spark):
    nested = {"data": [{"title": "A", "paragraphs": [{"context": "one  text", "qas": [{"id": "1", "question": "q ?", "is_impossible": False}, {"id": "2", "question": "no", "is_impossible": True}]}, {"context": "one text", "qas": [{"id": "3", "question": "q  ?", "is_impossible": False}]}, {"context": "two", "qas": []}]}]}
    df = spark.createDataFrame([(json.dumps(nested),)], "j string").select(F.from_json("j", "struct<" + se.SQUAD_SCHEMA.replace("data ", "data:", 1) + ">").alias("x")).select("x.data")
    docs, queries, qrels = se.flatten_questions(df)
    assert {(r.doc_id, r.text) for r in docs.collect()} == {("A-1", "one text"), ("A-2", "two")}
    assert [tuple(r) for r in queries.collect()] == [("1", "q ?")] and [tuple(r) for r in qrels.collect()] == [("1", "A-1", 1)]


def test_sidecar_and_topic_files(spark, tmp_path):
    record = lambda i, short: json.dumps({"id": i, "key": "k", "short": short, "long": "l"})
    (tmp_path / "s.jsonl").write_text("\n".join([record("a", "1"), "not json", record("a", "2"), "{}"]))
    rows, bad = se.read_enrichment(spark, str(tmp_path / "s.jsonl"))
    assert [(r.id, r.short) for r in rows.collect()] == [("a", "2")] and bad.first().malformed == 2
    se.write_topic_metrics(spark.createDataFrame([("q", 0.5, None)], "query_id string, ndcg10 double, recall10 double").coalesce(1), str(tmp_path / "t"))
    back = se.read_topic_metrics(spark, str(tmp_path / "t"), ("ndcg10", "recall10")).first()
    assert back.ndcg10 == 0.5 and back.recall10 is None
    with pytest.raises(ValueError):
        se.read_topic_metrics(spark, str(tmp_path / "t"), ("mrr10",))


def test_synthetic_corpus_is_deterministic(spark):
    words = [f"w{i}" for i in range(32)]
    a = se.synthetic_corpus(spark, 20, 7, words, ["x", "y"]).collect()
    h = 2166136261
    for c in "7:3:0":
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    row = next(r for r in a if r.atom_id == "syn-7-000003")
    assert row.title.split()[0] == words[h % 32] and len(row.body.split()) == 48 and row.x_domain == "y"


def test_runs(spark):
    h = spark.createDataFrame([("d", 1, "a", None, 0.5), ("d", 2, "a", "7", 0.4), ("d", 3, "b", "7", None)], "dataset string, run_at int, corpus_digest string, pool string, ndcg10 double")
    got = {(r.run_at, r.field, r.kind, r.before, r.after) for r in runs.provenance_diff(h, ["corpus_digest", "pool"], {"pool": "7"}, ("corpus_digest",)).collect()}
    assert got == {(3, "corpus_digest", "scale", "a", "b")}
    assert [r.gate for r in runs.metric_deltas(h, ["ndcg10"]).orderBy("run_at").collect()] == ["first", "fail", "first"]
    p = spark.createDataFrame([("x/run-1",), ("x/run-2",)], "path string")
    assert runs.select_run(p, "run-2").count() == 1
    with pytest.raises(ValueError):
        runs.select_run(p, "run")
    a = spark.createDataFrame([(["a", "b", "c", "x", "a", "b"], ["z", "a", "b", "c"]), ([], ["a"])], "a array<string>, b array<string>")
    assert sorted(r.n for r in a.select(runs.longest_shared_run("a", "b").alias("n")).collect()) == [0, 3]


def test_streaming_ingest(spark, tmp_path):
    from corvane.streaming.ingest import stream_atoms, stream_documents, windowed_counts

    src = tmp_path / "src"
    src.mkdir()
    (src / "a.md").write_text("# A\n" + "text " * 100)
    for expected in (1, 2):
        q = stream_atoms(stream_documents(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"), "docs")
        q.awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
        (src / "b.md").write_text("# B\n" + "more " * 100)
    events = spark.createDataFrame([("2024-01-01 00:01:00", "x"), ("2024-01-01 00:02:00", "x")], "ts string, event_type string").selectExpr("cast(ts as timestamp) ts", "event_type")
    assert windowed_counts(events).first().n == 2


def test_document_titles(spark):
    from corvane.operators import chunking

    fence = "```sh\n# install it\n```\n# Real Title\ntext"
    assert chunking.document_title(fence) == "Real Title" and chunking.document_title("plain") is None
    assert chunking.document_title("<!-- c -->\n---\ntitle: 'From matter'\n---\n# H") == "From matter" and chunking.document_title("---\nno keys\n---\n## Deep") == "Deep"
    docs = spark.createDataFrame([("a/two-words.md", fence), ("a/two-words.md", "none"), ("b/x.y.md", None)], "source_path string, text string")
    assert sorted(r.doc_title for r in ing.with_document_title(docs, "text", "source_path", ["source_path"]).collect()) == ["Real Title", "two words", "x.y"]


def test_numbering_in_ranges_equals_one_window(spark):
    rows = [("hot", i * 7 % 500 if i % 9 else None, f"a{i:04d}") for i in range(2_000)] + [("cold", 3, "b1"), ("cold", 1, "b2"), (None, None, "c1"), (None, 5, "c2")]
    df = spark.createDataFrame(rows, "doc string, idx int, atom_id string")
    whole = {tuple(r) for r in ing.numbered(df, ["doc"], ["idx", "atom_id"]).select("doc", "idx", "atom_id", "_i", "_n").collect()}
    cut = {tuple(r) for r in ing.numbered(df, ["doc"], ["idx", "atom_id"], block=300).select("doc", "idx", "atom_id", "_i", "_n").collect()}
    assert whole == cut and ("cold", 1, "b2", 1, 2) in whole and ("hot", None, "a1998", 2_000, 2_000) in whole and (None, None, "c1", 2, 2) in whole
    assert ing.numbered(df.limit(0), ["doc"], ["idx"]).count() == 0


def test_path_mapping(spark):
    rules = lambda *r: spark.createDataFrame(r, "prefix string, label string")
    df = spark.createDataFrame([("docs/a.md", 1), ("docs/adr/b.md", 2), ("doc.md", 3), (None, 4), ("docs/x/adrs.md", 5)], "p string, domain_ int")
    got = {r.domain_: r for r in ing.map_paths(df, "p", rules(("docs/", "d"), ("docs/x", "x")), rules(("docs/a", "a")), [("adr", "adr"), ("x", "xx")], "other").collect()}
    assert [(got[i].domain, got[i].doc_type) for i in range(1, 6)] == [("d", "a"), ("d", "adr"), (None, "other"), (None, "other"), ("x", "xx")]
    assert got[1].skip_reason is None and "doc.md" in got[3].skip_reason and got[4].skip_reason


def test_longest_segment_prefix(spark):
    ids = spark.createDataFrame([("a-b-c",), ("a-bc",), ("ab",), (None,)], "i string")
    known = spark.createDataFrame([("a",), ("a-b",), ("a-b",), ("c",)], "doc_id string")
    assert {r.i: r.found_id for r in ing.longest_segment_prefix(ids, known, "i").collect()} == {"a-b-c": "a-b", "a-bc": "a", "ab": None, None: None}


def test_domain_census_names_what_was_dropped(spark):
    files = spark.createDataFrame([("docs", True), ("docs", False), ("notes", False), (None, True)], "domain string, ok boolean")
    got = {r.domain: (r.files, r.indexed, r.declared, r.dropped) for r in ing.domain_census(files, ["docs", "wiki"]).collect()}
    assert got == {"docs": (2, 1, True, False), "notes": (1, 0, False, True), "wiki": (0, 0, True, False)}


def test_passage_benchmark(spark, tmp_path):
    spark.createDataFrame([("d/1", "text"), (" ", "x")], "id string, content string").write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([("7", "why", ["d/1"], ["N/A"])], "id string, query string, gold_ids array<string>, excluded_ids array<string>").write.parquet(str(tmp_path / "ex"))
    docs, examples = se.read_passages(spark, str(tmp_path / "docs"), str(tmp_path / "ex"))
    qrels, excluded = se.passages_to_qrels(examples, "passage")
    assert [tuple(r) for r in docs.collect()] == [("d_1", "text")] and [tuple(r) for r in qrels.collect()] == [("7", "d_1", 1)] and excluded.count() == 0


def test_round_trip_failures(spark):
    schema = "atom_id string, atom_type string, title string, x_domain string, status string, summary string, heading_chain string, origin_index int, origin_count int, stale_after string, verified_by string, verified_at string, sources array<string>, body string"
    good = ("a-1", "review", 'T "q"', "docs", "stable", None, "A > B", 1, 2, "2025-01-01", None, None, ["s.md"], "\nbody\n")
    rows = [good, ("a-2", *good[1:4], "odd", *good[5:]), ("a-3", *good[1:9], "soon", *good[10:]), ("a-4", *good[1:2], "two\nlines", *good[3:]), ("a-5", *good[1:12], [" s.md "], "b")]
    got = {r.atom_id: r.error for r in md.round_trip_failures(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"a-2", "a-3", "a-4", "a-5"} and "unknown status" in got["a-2"] and "stale_after" in got["a-3"] and got["a-5"] == "changed: sources"
