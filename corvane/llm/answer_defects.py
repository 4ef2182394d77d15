"""Defective answers of prompt and response records: empty, refused, copied from the prompt, in another language, cut off.

Copies are found by shingle containment and then a longest-common-subsequence alignment with the questions, refusals by
alignment of refusal templates with every clause, languages by the text model, and broken-off ends by how often the last words end a
sentence in all of the records' own sentences.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import languages as lang
from corvane.session import cut, salted_join, small


#: Word groups that one task counts before it hands its counts on.
ENDING_BUFFER = 500_000
#: Share of a question's words that an answer must hold in order to copy it, and share of other words it may hold beside copies.
COPY_SHARE, COPY_REST = 0.8, 0.2
#: Nats by which an answer's language must beat the questions' one, and the other way round in the questions.
LANGUAGE_MARGIN = 5.0
#: Least odds of a whole sentence against a broken-off one for an answer without end mark.
WHOLE_ODDS = 0.1
#: Times that longer words with the same beginning must be as frequent as a word for it to count as a fragment of them.
FRAGMENT_RATE = 100

# Words that only hold the place of a value.
PLACEHOLDERS = frozenset(
    "n a na none null nil nan todo tbd tba fixme empty undefined unknown missing placeholder blank pending summary answer short long description "
    "keywords keyword question questions value text here no not available applicable provided nothing void xxx "
    "nincs üres hiányzik válasz összefoglaló leer keine fehlt antwort zusammenfassung vide aucun aucune manquant réponse résumé "
    "vacío ninguno ninguna falta respuesta resumen vazio nenhum nenhuma resposta resumo нет пусто отсутствует ответ резюме".split()
)
# Words with which a writer declines, in order, without accents, by language; '|' parts alternatives. After a '~' the
# template only says that the writer can or will not, so what is declined must follow (ACTS), unless the clause ends there or the text apologises.
REFUSALS = (
    "i cannot|cant|couldnt|wont ~", "i can not|t ~", "i could not ~", "i am|m not going ~", "i am|m unable ~", "i am|m not able|allowed|comfortable|permitted ~", "i won t ~", "i will not ~", "i must|have|need decline|refuse", "i decline|refuse", "i do not feel comfortable", "i don t feel comfortable", "i would|d|ll rather|prefer not", "i prefer not",
    "i have|must|need|will leave unanswered", "not something i can|could|may|will", "outside|beyond what i may|can|could", "not possible for me", "impossible for me", "we cannot help", "we are unable ~", "assistant does not respond|answer|comment this",
    "my rules|guidelines|instructions|policy|policies leave|leaves|give|gives me no", "my rules|guidelines|instructions|policy|policies forbid|forbids|prevent|prevents|prohibit|prohibits", "conflicts with my rules|guidelines|instructions|policy|policies", "against my rules|guidelines|instructions|policy|policies",
    "nem tudok segiteni|valaszolni", "nem tudom osszefoglalni|megvalaszolni|leirni", "nem valaszolhatok|valaszolnek|valaszolok|segithetek", "nem adhatok|adok valaszt", "vissza kell utasitanom", "el kell utasitanom", "nem all modomban", "nem vagyok kepes", "kerest|keresedet|kereset|valaszt elutasitom|megtagadom", "elutasitom|megtagadom kerest|keresedet|kereset|valaszt",
    "kann|darf|mochte|werde|will ich nicht ~", "ich kann|darf|mochte|werde|will nicht ~", "ist es mir nicht moglich", "es ist mir nicht moglich", "muss ich ablehnen|verweigern", "ich muss ablehnen|verweigern", "ich bin nicht in der lage", "bin ich nicht in der lage", "ich lehne ab", "lehne ich ab", "mochte ich mich nicht",
    "je ne peux|saurais|puis|souhaite ~", "je ne suis pas en mesure", "il m est impossible", "il ne m est pas possible", "je dois refuser|decliner", "je refuse|decline", "je prefere ne pas",
    "no puedo ~", "no me es posible", "no estoy en condiciones", "no soy capaz", "debo rechazar|declinar", "tengo que rechazar|declinar", "me es imposible", "prefiero no responder|contestar|comentar|describir|resumir", "rechazo esta|su|tu solicitud|peticion",
    "nao posso|consigo ~", "nao me e possivel", "nao sou capaz", "nao estou em condicoes", "devo recusar|declinar", "tenho de|que recusar", "e me impossivel", "prefiro nao responder|comentar|descrever|resumir", "recuso este|esse|o|seu pedido",
    "я не могу|смогу|буду ~", "не могу|смогу|буду помочь|ответить|отвечать|описать|обобщить|комментировать", "я не в состоянии", "вынужден|вынуждена отказаться|отказать|отклонить", "я должен|должна отказаться|отказать|отклонить", "мне невозможно", "предпочитаю не отвечать|комментировать", "я отклоняю|отказываюсь",
)
# Beginnings of the words for what a writer declines to do, without accents.
ACTS = (
    "help", "assist", "answer", "respond", "reply", "summar", "descri", "comment", "discuss", "provid", "produc", "writ", "generat", "creat", "complet", "fulfil", "comply", "process", "translat", "explain", "shar", "say", "tell", "speak", "do", "give", "offer", "continue", "proceed", "disclos", "engag", "support", "elaborat", "paraphras", "analy", "interpret",
    "helf", "beantwort", "antwort", "zusammen", "beschreib", "auser", "aussern", "komment", "liefer", "erstell", "geben", "bearbeit", "erfull", "unterstutz",
    "aider", "repond", "resum", "decri", "fourni", "trait", "partag", "donner", "produi", "acced",
    "ayudar", "contest", "describ", "coment", "proporcion", "dar", "atend", "compart",
    "ajudar", "descrev", "fornec",
    "помо", "ответ", "отвеч", "обобщ", "опис", "коммент", "предостав", "резюм", "сдела", "напис", "обсужд",
)
# Beginnings of words of apology, and of a model speaking of itself, without accents.
_APOLOGY = re.compile(r"\b(?:sorry|apolog|unfortunate|regret|sadly|language model|as an ai\b|sajn|elnez|nyelvi modell|leider|entschuld|tut mir leid|sprachmodell|desol|malheur|excuse|modele de langage|lo siento|lamento|lamentabl|modelo de l|desculp|infeliz|извин|сожал|прост|языков)")
# The same without a first person; they hold only as a short clause of their own, as texts also tell of declined requests.
REFUSED = (
    "request declined|denied|refused|rejected", "no summary|answer|description|comment will be given|provided|written", "answering|describing|summarising|summarizing|commenting|responding would not be appropriate|right|proper",
    "keres|kerest elutasitva|elutasitjuk", "anfrage abgelehnt|verweigert", "demande refusee|rejetee|declinee", "solicitud|peticion rechazada|denegada", "pedido recusado|negado|rejeitado", "запрос отклонен",
)
#: Words that may stand between two of a template, and those that may not, as they bring in another subject; further words of a short clause.
REFUSAL_GAP, REFUSED_REST = 3, 3
#: Among so many words after a template with '~' the act must stand.
ACT_REACH = 6
_OTHERS = frozenset("you he she they it that which who whether and or but if er sie wir dass und oder aber wenn tu il elle ils elles que qui et ou mais si y o pero ele ela eles mas ou он она они что и или но hogy vagy de aki".split())
#: Verbs of reported speech: what follows them in a sentence is not the writer's own, unless the writer is who speaks.
_SELF = frozenset("i ich je yo eu я en".split())
_REPORTS = frozenset("says said say states stated answers answered replies replied reports writes sagt sagte antwortet meldet schreibt lautet dit repond indique affirme dice responde indica diz afirma говорит отвечает пишет сообщает mondja valaszolja irja kozli".split())


def _templates(phrases: tuple[str, ...], whole: bool) -> Iterator[tuple[tuple[frozenset[str], ...], bool, bool]]:
    for phrase in phrases:
        words = phrase.split()
        acts = words[-1] == "~"
        yield tuple(frozenset(w.split("|")) for w in words[: len(words) - acts]), whole, acts


_CORES_BY_FIRST: dict[str, list[tuple[tuple[frozenset[str], ...], bool, bool]]] = {}
for _template in (*_templates(REFUSALS, False), *_templates(REFUSED, True)):
    for _word in _template[0][0]:
        _CORES_BY_FIRST.setdefault(_word, []).append(_template)

_QUOTED = re.compile(r"`[^`]*`|\"[^\"]*\"|“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|‘[^‘’]*’(?!\w)")
_CLAUSE = re.compile(r"[^.!?。！？؟;:\n]+[.!?。！？؟;:\n]?")
_WORD_OR_COMMA = re.compile(r"[^\W_]+|,")

_TOKEN = re.compile(r"[^\W_]+")
_END_MARK = re.compile(r"[.!?。！？؟](?:[\"'»”’)\]*_`\s​]*)$")
_BROKEN_MARK = re.compile(r"(?:[,;:(\[{/\\–—-]|…|\.\.\.)[\"'»”’)\]*_\s​]*$")
_BARE_NUMBER = re.compile(r"(?:^|[\s:])(\d{1,3})[.)]\s*$")
_CLOSERS = "\"'»”’)]*_ \t\r\n ​"


def without_accents(text: str) -> str:
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def folded(text: str) -> list[str]:
    """Lower-case tokens without accents."""
    return _TOKEN.findall(without_accents(text).lower())


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    words = _TOKEN.findall(text.lower())
    return all(w in PLACEHOLDERS for w in words)


def is_refusal(text: str) -> bool:
    """Some clause of the text, wherever it stands, aligns with a refusal template.

    Quoted words, questions and reported speech are not the writer's own. Between two words of a template up to REFUSAL_GAP others
    may stand, but no other subject and no lone comma. "I cannot" alone declines nothing: see ACTS.
    """
    text = text.strip()
    own = _QUOTED.sub(" ", text)
    if not _TOKEN.search(own):
        own = text.strip("\"“”„«»‘’`")  # all of it is quoted, as a decoration
    plain = without_accents(own).lower()
    sorry = _APOLOGY.search(plain) is not None
    for clause in _CLAUSE.findall(plain):
        if clause[-1] in "?？؟":
            continue
        tokens = _WORD_OR_COMMA.findall(clause)
        for at, token in enumerate(tokens):
            if token in _REPORTS and not _SELF.intersection(tokens[:at]):
                break
            for core, whole, acts in _CORES_BY_FIRST.get(token, ()):
                if whole and (at > 1 or len(tokens) > len(core) + REFUSED_REST):
                    continue
                stop = _aligned(core, tokens, at)
                if stop and (not acts or sorry or _declines(tokens[stop:])):
                    return True
    return False


def _declines(rest: list[str]) -> bool:
    """What follows "I cannot" is nothing, or soon the act."""
    words = [w for w in rest if w != ","]
    return not words or any(w.startswith(ACTS) for w in words[:ACT_REACH])


def _aligned(core: tuple[frozenset[str], ...], tokens: list[str], at: int) -> int:
    """Where the template ends that begins at tokens[at], each word at most REFUSAL_GAP words after the one before; 0 if it does not fit."""
    if len(core) == 1:
        return at + 1
    commas = 0
    for i in range(at + 1, min(len(tokens), at + 2 + REFUSAL_GAP)):
        if tokens[i] in core[1] and commas != 1 and (stop := _aligned(core[1:], tokens, i)):
            return stop
        if tokens[i] in _OTHERS:
            return 0
        commas += tokens[i] == ","
    return 0


def lcs(a, b) -> int:
    """Length of the longest common subsequence of two short token lists."""
    before = [0] * (len(b) + 1)
    for x in a:
        now, diagonal = [0], 0
        for j, y in enumerate(b):
            now.append(diagonal + 1 if x == y else max(before[j + 1], now[j]))
            diagonal = before[j + 1]
        before = now
    return before[-1]


def copies_question(answer: list[str], questions: list[list[str]]) -> bool:
    """The answer is made up of questions: their shingles cover most of it, and each stretch aligns with a whole question.

    Shingles are pairs of words, or single words where a text is too short to have enough pairs.
    """
    questions = [q for q in questions if q]
    if not answer or not questions:
        return False
    k = 2 if min(len(answer), *map(len, questions)) > 2 else 1
    known = {tuple(q[i : i + k]) for q in questions for i in range(len(q) - k + 1)}
    shingles = [tuple(answer[i : i + k]) for i in range(len(answer) - k + 1)]
    if sum(s in known for s in shingles) < 0.4 * len(shingles):
        return False
    spare = 2 if len(answer) >= 6 else len(answer) // 3
    allowed, rest, at, found = max(spare, int(COPY_REST * len(answer))), 0, 0, False
    while at < len(answer):
        best, best_stop, best_hits = 0.0, at, 0
        for q in questions:
            window = answer[at : at + len(q) + 3]
            hits = lcs(q, window)
            share = hits / len(q)
            if share >= COPY_SHARE and window[0] in q and share > best:
                stop = next(n for n in range(hits, len(window) + 1) if lcs(q, window[:n]) == hits)
                best, best_stop, best_hits = share, at + stop, hits
        if best:
            rest += best_stop - at - best_hits
            at, found = best_stop, True
        else:
            rest += 1
            at += 1
        if rest > allowed:
            return False
    return found


def ending(text: str) -> bool | tuple[str, str | None]:
    """Whether the text breaks off, by its marks; where they do not tell, its last word and last pair of words.

    A bracket or code span that is never closed tells only if no sentence ends behind it, a list number only if it is the next one of
    a list and has no item.
    """
    if _unclosed(text) or _BROKEN_MARK.search(text):
        return True
    if m := _BARE_NUMBER.search(text):
        before, n = text[: m.start(1)], int(m.group(1))
        if before.rstrip()[-1:] in (":", "") or (n > 1 and re.search(rf"(?:^|[\s:]){n - 1}[.)]\s", before)):
            return True
    if _END_MARK.search(text):
        return False
    bare = text.rstrip(_CLOSERS)
    if bare.endswith("`"):  # ends with code: how the words before it go on
        bare = bare[: bare.rstrip("`").rfind("`")].rstrip()
        return bool(_words(bare))
    words = _words(bare)
    return (words[-1], " ".join(words[-2:]) if len(words) > 1 else None) if words else False


def _unclosed(text: str) -> bool:
    """An opened bracket or code span stays open to the end of the text, and no sentence ends behind it."""
    at = text.rfind("`") if text.count("`") % 2 else -1
    depth = 0
    for m in reversed(list(re.finditer(r"[()]", text))):
        depth += 1 if m.group() == ")" else -1
        if depth < 0:
            at = max(at, m.start())
            break
    return at >= 0 and not re.search(r"[.!?。！？؟][\"'»”’)\]*_]*(?:\s+\S|\s*$)", text[at + 1 :])


def _words(text: str) -> list[str]:
    return [w.lower() for w in re.split(r"\s+", text.strip()) if w]


def _clean_word(word: str) -> str:
    return word.strip("\"'«»“”‘’()[]*_,;:.!?…`").lower()


def _ending_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    final, every = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        keys = list(every)
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([final[k] for k in keys], pa.int64()), pa.array([every[k] for k in keys], pa.int64())], ["grp", "final", "n"])
        final.clear(), every.clear()
        return out

    for batch in batches:
        for column in batch.columns:
            for text in column.to_pylist():
                for s, ended in (x for b in lang.prose_blocks(text or "") for x in lang.sentences(b)):
                    words = [w for w in map(_clean_word, s.split()) if w]
                    if not ended or len(words) < 3:
                        continue
                    groups = [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]
                    every.update(groups)
                    final.update((words[-1], f"{words[-2]} {words[-1]}"))
                if len(every) > ENDING_BUFFER:
                    yield flush()
    yield flush()


def fit_endings(records: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(grp, final, n): how often each word and pair of words ends a sentence, over all records that have an id; checkpointed."""
    counts = records.where(F.col(id_col).isNotNull()).select(*text_cols).mapInArrow(_ending_counts, "grp string, final long, n long")
    return cut(counts.groupBy("grp").agg(F.sum("final").alias("final"), F.sum("n").alias("n")))


def broken_off(undecided: DataFrame, endings: DataFrame) -> DataFrame:
    """The rows of undecided (.., last_word, last_pair) whose last words hardly ever end a sentence.

    The pair's counts lean on those of its last word. A word that is far rarer than the longer
    words that begin with it, or has no counts beside theirs, is a fragment: broken-off words with a full stop stand among the counts too.
    Only the groups asked for are looked up, so the table of endings may be of any size.
    """
    asked = undecided.select(F.explode(F.array("last_word", "last_pair")).alias("grp")).where("grp is not null").distinct()
    found = cut(endings.join(small(asked), "grp", "left_semi"))
    words = endings.where("instr(grp, ' ') = 0")
    lasts = undecided.select(F.col("last_word").alias("grp")).where("length(last_word) >= 2").distinct()
    lengths = lasts.select(F.length("grp").alias("k")).distinct()
    begun = words.join(F.broadcast(lengths), F.length("grp") > F.col("k")).select(F.expr("substring(grp, 1, k)").alias("grp"), "n").join(small(lasts), "grp", "left_semi").groupBy("grp").agg(F.sum("n").alias("longer"))
    of = lambda name, f, n: found.select(F.col("grp").alias(name), F.col("final").alias(f), F.col("n").alias(n))
    rows = salted_join(undecided, of("last_word", "f1", "n1"), "last_word")
    rows = salted_join(rows, of("last_pair", "f2", "n2"), "last_pair")
    rows = salted_join(rows, begun.withColumnRenamed("grp", "last_word"), "last_word")
    rows = rows.crossJoin(F.broadcast(words.agg((F.coalesce(F.sum("final"), F.lit(0)) + 1).alias("finals"), (F.coalesce(F.sum(F.col("n") - F.col("final")), F.lit(0)) + 1).alias("inners"))))  # one row
    f, n = F.coalesce("f2", F.lit(0)) + 4 * F.col("f1") / F.col("n1"), F.coalesce("n2", F.lit(0)) + 4
    odds = (f + 0.002) / F.col("finals") / ((n - f + 0.002) / F.col("inners"))
    return rows.where(F.when(FRAGMENT_RATE * F.coalesce("n1", F.lit(0)) <= F.col("longer"), True).otherwise(F.coalesce(odds < WHOLE_ODDS, F.lit(False)))).select(*undecided.columns)


def _defects(model):
    schema = pa.schema([("record_no", pa.int64()), *((c, pa.string()) for c in ("field_name", "defect", "last_word", "last_pair"))])

    def judge(m: lang.TextModel, short, long, keywords, questions) -> list[tuple]:
        asked = [q for q in questions or [] if not is_empty(q)]
        if not asked:
            return [("questions", "empty", None, None)]
        out = []
        q_tokens = [folded(q) for q in asked]
        q_scores = None
        for field, text in (("short_desc", short), ("long_desc", long)):
            if is_empty(text):
                out.append((field, "empty"))
                continue
            tokens = folded(text)
            if is_refusal(text):
                out.append((field, "refusal"))
            elif copies_question(tokens, q_tokens):
                out.append((field, "copies_question"))
            else:
                if q_scores is None:
                    q_scores = m.score([w for q in asked for w in lang.WORD.findall(lang.plain_prose(q).lower())])
                scores = m.score(lang.WORD.findall(lang.plain_prose(text).lower()))
                a, q = int(scores.argmax()), int(q_scores.argmax())
                if a != q and scores[a] - scores[q] >= LANGUAGE_MARGIN and q_scores[q] - q_scores[a] >= LANGUAGE_MARGIN:
                    out.append((field, "other_language"))
                elif end := ending(text):
                    out.append((field, "truncated") if end is True else (field, None, *end))
        kept = [k for k in keywords or [] if not is_empty(k)]
        if not kept:
            out.append(("keywords", "empty"))
        elif copies_question([t for k in kept for t in folded(k)], q_tokens):
            out.append(("keywords", "copies_question"))
        return [(*x, None, None) if len(x) == 2 else x for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            rows = [(no, *x) for no, *fields in zip(*(c.to_pylist() for c in batch.columns)) for x in judge(m, *fields)]
            cols = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def answer_defects(records: DataFrame, model, endings=None) -> DataFrame:
    """(record_no, field_name, defect): the first defect of each defective field of each record.

    records: record_no, short_desc, long_desc, keywords, questions; nulls are empty values, other columns are not read. A
    record whose questions are empty is reported for that only. Repeated record_nos are judged once. Whole texts are
    judged in one narrow stage with the model as a bounded broadcast; answers whose marks do not tell whether they break off are
    then joined with the table of endings.
    """
    if endings is None:
        endings = fit_endings(records, "record_no", ["short_desc", "long_desc"])
    rows = records.where("record_no is not null").select("record_no", "short_desc", "long_desc", "keywords", "questions")
    judged = cut(rows.mapInArrow(_defects(model), "record_no long, field_name string, defect string, last_word string, last_pair string").distinct())
    broken = broken_off(judged.where("defect is null").drop("defect"), endings).withColumn("defect", F.lit("truncated"))
    return judged.where("defect is not null").unionByName(broken).select("record_no", "field_name", "defect").distinct()


def defect_counts(defects: DataFrame) -> DataFrame:
    return defects.groupBy("field_name", "defect").agg(F.count("*").alias("n_records"))
