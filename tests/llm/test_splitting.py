import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import splitting as sp
from corvane.session import table


def units(text):
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def check(text, limit, overlap):
    pieces = sp.split_text(text, limit, overlap)
    assert "".join(text[p["fresh"] : p["stop"]] for p in pieces) == text
    for p, before in zip(pieces, [None, *pieces]):
        piece = text[p["start"] : p["stop"]]
        assert units(piece) == p["units"] <= max(limit, 2) and p["overlap"] <= overlap
        assert units(text[p["start"] : p["fresh"]]) == p["overlap"]
        if before:
            assert p["fresh"] == before["stop"]
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .!?\n#|-😀é\r`")), max_size=400), st.integers(8, 60), st.integers(0, 6))
def test_round_trip_and_limits(text, limit, overlap):
    check(text, limit, overlap)


def test_cuts_prefer_headings_then_paragraphs_then_sentences():
    text = "# One\n\n" + "First sentence here. " * 3 + "\n\n# Two\n\n" + "Second part of it. " * 3
    pieces = check(text, 90, 0)
    assert [p["cut"] for p in pieces] == ["none", "section"]
    text = ("A paragraph of some words. " * 2).strip() + "\n\n" + ("Another paragraph of words. " * 2).strip()
    assert [p["cut"] for p in check(text, 70, 0)] == ["none", "paragraph"]
    assert {p["cut"] for p in check("One sentence stands here. " * 10, 60, 0)} == {"none", "sentence"}
    assert {p["cut"] for p in check("x" * 500, 60, 5)} == {"none", "character"}
    assert {p["cut"] for p in check("| a | b |\n" * 30, 60, 0)} == {"none", "line"}


def test_a_fence_has_no_sections_and_no_paragraphs():
    fence = "```sh\n" + "".join(f"# step {i}\n\nrun the thing number {i}\n" for i in range(20)) + "```\n"
    text = "# Real\n\nText before it.\n\n" + fence + "\n## Next\n\nText behind it.\n"
    sections, paragraphs, *_ = sp.boundaries(text)
    assert sections == [0, text.index("## Next")] and not any(text.index("```sh") < x < text.rindex("```") for x in paragraphs)
    assert {p["cut"] for p in check(text, 200, 0)} <= {"none", "line", "section", "paragraph"}
    assert check(text, 10_000, 0)[0]["cut"] == "none"


def test_packing_goes_over_levels_and_no_heading_stands_alone():
    text = "# A\n\n" + "Nine words of a sentence stand here in line. " * 110 + "\n\n## B\n\nA short one.\n\n## C\n\nA short one as well.\n"
    pieces = check(text, 4_000, 200)
    assert len(pieces) == 2 and pieces[0]["units"] > 3_000 and text[pieces[1]["fresh"] : pieces[1]["stop"]].endswith("as well.\n")
    text = "".join(f"## Part {i}\n\n" + "Some words stand here. " * (20 + 7 * i % 50) + "\n\n" for i in range(60))
    for p in check(text, 1_000, 100):
        assert not text[p["fresh"] : p["stop"]].rstrip().splitlines()[-1].startswith("#")
    text = "# Title\n\n" + "word " * 5_000
    assert all(p["units"] > 500 for p in check(text, 1_000, 0)[:-1])


def test_rebuilt_finds_what_is_wrong(spark):
    df = spark.createDataFrame([("a", "Sentence number one. " * 300, 1), ("b", "😀é" * 3_000, 2), (None, "z" * 9_000, 3), ("c", "short", 4), ("d", None, 5)], "atom_id string, body string, k int")
    pieces = sp.split_oversized(df, "body", ["atom_id", "k"])
    rows = sp.rebuilt(pieces, ["atom_id", "k"]).collect()
    want = {r.k: r for r in df.selectExpr("k", "md5(body) as m").collect()}
    assert {r.k for r in rows} == {1, 2, 3} and all(r.body_md5 == want[r.k].m and r.within_limit and r.overlaps_hold and r.all_there for r in rows)
    bad = {r.k: r for r in sp.rebuilt(pieces.where("not (k = 1 and piece_no = 1)"), ["atom_id", "k"]).collect()}
    assert not bad[1].all_there and bad[1].body_md5 != want[1].m and bad[2].all_there


def test_overlap_begins_at_a_boundary():
    pieces = check("Some words of a sentence. " * 40, 200, 60)
    text = "Some words of a sentence. " * 40
    assert all(p["overlap"] > 20 and text[p["start"] - 1].isspace() for p in pieces[1:])


def test_very_long_text_is_linear():
    check("word " * 400_000, 4_000, 200)
    check("y" * 1_000_000, 4_000, 200)
    check("😀" * 100_000, 4_000, 200)


def test_wrong_parameters():
    with pytest.raises(ValueError):
        sp.split_text("abc", 10, 10)


ATOMS = "atom_id string, heading_chain string, origin_index int, body string, piece string, n_units int"


def test_rows(spark):
    long = "Sentence number one. " * 300
    emoji = "😀" * 2_500
    rows = [("a", "A > B", 4, long, "x", 1), ("a", "A > B", 4, long, "x", 1), ("b", None, None, emoji, "x", 1), ("c", "C", 1, "short", "x", 1), ("d", None, None, None, "x", 1), ("e", "", 0, "", "x", 1), ("f", "F", 2, "é" * 4_000, "x", 1), (None, "N", 3, "z" * 4_001, "x", 1)]
    df = spark.createDataFrame(rows, ATOMS)
    pieces = sp.atom_pieces(df).collect()
    assert {p.atom_id for p in pieces} == {"a", "b", None}
    a = sorted((p for p in pieces if p.atom_id == "a"), key=lambda p: p.piece_no)
    assert [p.piece_no for p in a] == list(range(a[0].n_pieces)) and all(units(p.piece) == p.n_units <= 4_000 for p in pieces)
    assert all(4 <= p.piece_order < 5 and p.heading_chain == "A > B" for p in a)
    assert "".join(p.piece[p.overlap_units :] for p in a) == long
    assert sp.atom_pieces(df.limit(0)).count() == 0


def test_found_equals_the_definition(spark, tiny):
    from corvane.llm.queries import p5_found

    bodies = {(r.atom_id, r.body) for r in table(spark, tiny, "atoms").select("atom_id", "body").collect()}
    assert sorted(r.atom_id for r in p5_found(spark, tiny).collect()) == sorted({i for i, b in bodies if b and units(b) > 4_000})
