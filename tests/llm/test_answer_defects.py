import pytest

from corvane.llm import answer_defects as ad
from corvane.llm import languages as lg
from corvane.session import table

Q = ["What happens when the tokenizer restores the public load balancer?", "Why is there a second retry policy in the staging area?"]
GOOD = "The tokenizer restores the load balancer before the nightly run."
GOOD2 = "There is one retry policy that covers the staging area while the disk is full. The scheduler validates it afterwards."


@pytest.fixture(scope="module")
def judged(spark):
    d = "/root/testdata/sf0.01"
    model = lg.fit_text_model(table(spark, d, "documents"), table(spark, d, "lang_codes"))
    endings = ad.fit_endings(table(spark, d, "enrichment"), "record_no", ["short_desc", "long_desc"])

    def run(rows):
        df = spark.createDataFrame([(*r, "x", "y") for r in rows], "record_no long, short_desc string, long_desc string, keywords array<string>, questions array<string>, defect string, field_name string")
        return {(r.record_no, r.field_name, r.defect) for r in ad.answer_defects(df, model, endings).collect()}

    return run


def one(judged, short, kw=("load balancer", "retry policy"), questions=Q):
    return {(f, d) for _, f, d in judged([(1, short, GOOD2, list(kw) if kw is not None else None, questions)])}


def test_sound_record(judged):
    assert one(judged, GOOD) == set()


@pytest.mark.parametrize("text", [None, "", " \n", "...", "N/A", "TODO", "**Answer:**", "(empty)", "​", "[]", "–"])
def test_empty(judged, text):
    assert one(judged, text) == {("short_desc", "empty")}


@pytest.mark.parametrize("text", ["I'm sorry, but I can't help with that request.", "As a language model, I am unable to describe this content. Please provide more context.", "REGRETTABLY, I CANNOT SUMMARISE THIS SECTION.", "Request declined.", "Sajnálom, de nem tudom összefoglalni ezt a szakaszt.", "Leider kann ich dabei nicht helfen.", "Malheureusement, je ne suis pas en mesure de répondre.", "Lo siento, pero no puedo ayudar con eso.", "Desculpe, mas não posso ajudar com isso.", "Извините, но я не могу помочь с этим."])
def test_refusal(judged, text):
    assert one(judged, text) == {("short_desc", "refusal")}


@pytest.mark.parametrize("text", ["The parser declines any request that it is not able to verify.", 'The rule says that the gateway answers "I cannot help with that" when the quota is used up.', "Sorry pages are shown by the proxy while the index is being rebuilt."])
def test_no_refusal(judged, text):
    assert one(judged, text) == set()


@pytest.mark.parametrize(
    "text",
    ["Ezt a kérést a szabályaim miatt elutasítom.", "Erre a tartalomra nem adhatok választ.", "Diese Anfrage muss ich ablehnen.", "Cette demande est refusée.", "My rules leave me no room to comment on this section.", "Answering this would not be appropriate.", "The assistant does not respond to this kind of content.", "The section names a load balancer and a retry policy. I, regrettably, cannot say more about it.",
     "The passage describes a cache. I'm sorry, but I can't help with that.", "Unfortunately this request falls outside what I can provide.", "As an AI I'm not going to answer that.",
     "Thank you so much for the detailed section you sent over; after reading it carefully twice I regret that I cannot answer.",
     "I am so very sorry, but unfortunately, I am afraid, I regret to say that after reading the text I cannot answer the question.", "I cannot."],
)
def test_refusal_wherever_it_stands(text):
    assert ad.is_refusal(text)


@pytest.mark.parametrize("text", ["The gateway logs each request declined by the proxy.", "The gateway says that I cannot pass when the quota is used up.", "A log line of «je ne peux pas» ends the session.", "No hay problema, puedo verlo en el registro.", "Az átjáró a második próbálkozásra elutasítja a kérést.", "What if I cannot restore the gateway?", "This section describes why a reviewer must refuse a draft without sources.", "I cannot overstate how important caching is.", "We found that I cannot pass the gateway twice."])
def test_told_refusal_is_none(text):
    assert not ad.is_refusal(text)


@pytest.mark.parametrize("text", [Q[0], Q[0].upper(), f'"{Q[0]}"', f"{Q[0]} {Q[0]}", f"{Q[1]} {Q[0]}", Q[0].replace("?", "!"), "What happens when the slow tokenizer restores the public load balancer", f"Question: {Q[0]}"])
def test_copies(judged, text):
    assert one(judged, text) == {("short_desc", "copies_question")}


@pytest.mark.parametrize(("question", "answer", "copy"), [("Why cache?", "Why cache?", True), ("Why?", "why", True), ("为什么缓存", "为什么缓存", True), ("Why?", "Because it is small", False), ("Why cache?", "Why cache is used is told in the second section", False)])
def test_short_questions(question, answer, copy):
    assert ad.copies_question(ad.folded(answer), [ad.folded(question)]) is copy


def test_many_placeholders_are_empty():
    assert ad.is_empty("n/a, n/a; none. TODO tbd missing") and not ad.is_empty("n/a, but see the index")


@pytest.mark.parametrize(("text", "broken"), [("Steps follow: 1. the 2.", True), ("Steps:\n1.", True), ("The gateway has version 2.", False), ("It takes (see below. Then it ends. All is well.", False), ("It takes (see", True), ("The span `x. Then it ends.", False)])
def test_marks_tell(text, broken):
    assert (ad.ending(text) is True) is broken


def test_repeats_and_goes_on(judged):
    assert one(judged, f"{Q[0]} The load balancer follows the tokenizer and the scheduler rebuilds the index before the nightly run.") == set()


def test_other_language(judged):
    assert one(judged, "Die Bewertung behält die geprüfte Sicherung, und die nächtliche Freigabe bestätigt sie danach.") == {("short_desc", "other_language")}


@pytest.mark.parametrize("text", ["The tokenizer restores the load balancer before the", "There is one retry policy that cov…", "The scheduler validates the staging area,", "If `TOKEN_DRI", "The exporter stores it on a cold start (the"])
def test_truncated(judged, text):
    assert one(judged, text) == {("short_desc", "truncated")}


@pytest.mark.parametrize("text", ["The tokenizer restores the load balancer before the nightly run", "Do not assume that a handshake points to the mentor on the second attempt"])
def test_lacks_only_its_full_stop(judged, text):
    assert one(judged, text) == set()


def test_lists(judged):
    assert one(judged, GOOD, kw=None) == one(judged, GOOD, kw=[]) == one(judged, GOOD, kw=[None, " ", "N/A"]) == {("keywords", "empty")}
    assert one(judged, GOOD, kw=[Q[0][:-1], Q[0]]) == {("keywords", "copies_question")}
    assert one(judged, "", questions=[" ", None]) == {("questions", "empty")} == one(judged, GOOD, questions=None)


def test_repeated_long_and_no_records(judged):
    rows = [(1, "", GOOD2, ["a b"], Q)] * 3 + [(2, GOOD * 5_000, "x" * 300_000, ["k" * 10_000], Q)]
    assert (1, "short_desc", "empty") in judged(rows) and judged([]) == set()


def test_lcs():
    assert ad.lcs("abcbdab", "bdcaba") == 4 and ad.lcs([], "a") == 0


def test_every_record_tells_how_sentences_end(spark):
    rows = [(i, "The gateway keeps the quorvex of the index.", "") for i in range(25_000)] + [(25_000, "The gateway keeps the index of the velmarite.", "The gateway keeps the gatew.")]
    ends = ad.fit_endings(spark.createDataFrame(rows, "i long, a string, b string"), "i", ["a", "b"])
    assert tuple(ends.where("grp = 'velmarite'").select("final", "n").first()) == (1, 1) and ends.where("grp = 'index'").first().n == 25_001
    asked = spark.createDataFrame([(1, "velmarite", "the velmarite"), (2, "velma", "the velma"), (3, "quorvex", "the quorvex"), (4, "unheard", None), (5, "gatew", "the gatew")], "i int, last_word string, last_pair string")
    assert {r.i for r in ad.broken_off(asked, ends).collect()} == {2, 3, 5}
