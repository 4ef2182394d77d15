import unicodedata

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.stemming import hungarian_light, porter

# Words and stems of the 1980 paper's own examples.
PORTER = dict(caresses="caress", ponies="poni", ties="ti", cats="cat", feed="feed", agreed="agre", plastered="plaster", motoring="motor", conflated="conflat", troubled="troubl", sized="size", hopping="hop", falling="fall", hissing="hiss", failing="fail", filing="file", happy="happi", sky="sky", relational="relat", rational="ration", digitizer="digit", operator="oper", decisiveness="decis", sensitiviti="sensit", triplicate="triplic", formalize="formal", goodness="good", revival="reviv", adjustable="adjust", replacement="replac", adoption="adopt", probate="probat", rate="rate", cease="ceas", controll="control", roll="roll")
HUNGARIAN = dict(naplokban="napl", kotelezettsegek="kotelezettseg", cimkekkel="cimk", adoszamat="adoszam", csoportokat="csoport", bevallashoz="beval", kozpont="kozpont", csoport="csoport")


@pytest.mark.parametrize("word,stem", PORTER.items())
def test_porter(word, stem):
    assert porter(word) == stem


@pytest.mark.parametrize("word,stem", HUNGARIAN.items())
def test_hungarian(word, stem):
    assert hungarian_light(word) == stem


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v


def test_fold_equals_decomposition_of_every_letter(spark):
    letters = [chr(c) for c in range(0x20, 0x10000) if chr(c).isalpha() and not 0xAC00 <= c <= 0xD7A3]
    got = spark.createDataFrame([(c,) for c in letters], "t string").select("t", tx.fold(F.col("t")).alias("v")).collect()
    want = lambda c: "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M"))
    bad = [r.t for r in got if r.v != want(r.t)]
    # Letters whose decomposition holds several base letters keep their form.
    assert all(len(want(c)) != 1 for c in bad), bad[:20]


def test_tokens(spark):
    assert value(spark, "Árvíz-tűrő  Tükör_fúró 42!", tx.tokenize) == ["arviz", "turo", "tukor", "furo", "42"]
    assert value(spark, "", tx.tokenize) == [] and value(spark, None, tx.tokenize) is None
    assert value(spark, "éa B", tx.split_tokens) == ["éa", "B"]
    assert value(spark, "Straße Łódź", tx.tokenize) == ["straße", "łodz"]


def test_identifiers(spark):
    terms = lambda t, a: [(x.term, x.whole) for x in value(spark, t, lambda c: tx.unstemmed_terms(c, a))]
    assert terms("parse/stale.ts now", "ident-porter-fold") == [("parse_stale_ts", True), ("parse", False), ("stale", False), ("ts", False), ("now", False)]
    assert terms("camelCase", "ident-porter-fold") == [("camelcase", False)]
    assert terms("a@b.c", "ident-porter-fold")[0] == ("aatb_c", True)
    with pytest.raises(ValueError):
        tx.plain_terms(F.lit("x"), "ident-porter-fold")


def test_stemming_of_distinct_terms_leaves_whole_terms(spark):
    df = spark.createDataFrame([(1, "running", False), (2, "running", True), (3, None, False)], "i int, term string, whole boolean")
    assert {r.i: r.term for r in tx.stem_terms(df, "porter-fold").collect()} == {1: "run", 2: "running", 3: None}


def test_shapes(spark):
    assert value(spark, 'See (fooBar), a_b, x/y, file.ts, --flag, 1.2.3, http://x, 5ms "NASA"; plain fooBar', tx.extract_entities) == ["fooBar", "a_b", "x/y", "file.ts", "--flag", "1.2.3", "http://x", "5ms", "NASA"]
    assert value(spark, "how to use std::move", tx.carries_rare_term) and not value(spark, "how to move a file", tx.carries_rare_term)
    assert value(spark, "\n  Hello, World: NOW!\nsecond", tx.normalise_rewrite) == "hello world now"


def test_neutralise(spark):
    assert value(spark, "a [INST] b\n system: x\nnot User: y", tx.neutralise) == "a [[neutralised:[INST]]] b\n [[neutralised:system:]] x\nnot User: y"
    assert value(spark, "<|im_start|><|im_end|>\nUser:", tx.marker_count) == 3


def test_windows_and_ids(spark):
    assert value(spark, "abcdefghij", lambda c: tx.extract_window(c, "headtail", 4)) == "ab\n...\nij"
    assert value(spark, "abcdefghij", lambda c: tx.extract_window(c, "tail", 4)) == "ghij" and value(spark, "abc", lambda c: tx.extract_window(c, "head", 4)) == "abc"
    assert value(spark, "Été à la Mer!", tx.slugify) == "ete-a-la-mer"
    assert value(spark, "aa-bb-cc", lambda c: tx.truncate_slug(c, 5)) == "aa-bb" and value(spark, "aa-bbb-cc", lambda c: tx.truncate_slug(c, 5)) == "aa"
    assert len(value(spark, "x" * 300, tx.safe_id)) == 200 and value(spark, "a b/c", tx.safe_id) == "a_b_c"
    assert value(spark, "é😀", tx.byte_size) == 6


def test_snippet(spark):
    body = "start " * 100 + "needle here and needle there " + "tail " * 100
    s = value(spark, body, lambda c: tx.snippet(c, F.array(F.lit("needle"))))
    assert len(s) <= 400 and s.startswith("needle") and body.find(s) >= 0
    assert value(spark, "short", lambda c: tx.snippet(c, F.array(F.lit("x")))) == "short"
    assert value(spark, "y" * 900, lambda c: tx.snippet(c, F.array(F.lit("x")))) == "y" * 400
