"""Languages of documents and of their sentences, by Bayesian fusion of text, label, address and host evidence.

The text likelihood is a naive Bayes model over words, backed by character trigrams for words it has not seen. It is
fitted on a bounded sample of labelled documents: SAMPLE_DOCS of each language in expectation, drawn by a hash of the id, and
VOCABULARY words of each language. All other statistics (label confusion, address suffixes, hosts) are grouped
aggregations over all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import cut, salted_join, small

#: The language codes of the result.
LANGUAGES = ("en", "hu", "de", "fr", "es", "pt", "ru")
SAMPLE_DOCS = 1_500
VOCABULARY = 10_000
#: Words a sentence needs before it counts as evidence of a further language.
SENTENCE_WORDS = 8
#: By how many nats a sentence's language must beat the next one.
SENTENCE_MARGIN = 4.0

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_FENCE = re.compile(r"^\s{0,3}(```+|~~~+)")
_MARKER = re.compile(r"^\s*(?:>\s*)*(?:[-*+•]\s+|\d+[.)]\s+|>\s*)?(?:\[[ xX]\]\s+)?")
_LIST = re.compile(r"^\s*(?:[-*+•]\s|\d+[.)]\s|>)")
_HEADING = re.compile(r"^\s{0,3}#{1,6}(?:\s|$)")
_RULE = re.compile(r"^\s*(?:-{3,}|={3,}|\*{3,}|_{3,})\s*$")
_INDENTED = re.compile(r"^(?: {4}|\t)")
_CODE_LINE = re.compile(r"^\s*(?:\$ \S|\[\d\d:\d\d|\"[^\"]*\":|[\w.\[\]]+\s*[-+*/]?=\s)")
_KEYWORD_LINE = re.compile(r"^\s*(?:const|let|var|def|import|from|return|class|function)\b.*[;=({:]")
#: So many words in a row are prose, whatever mark ends the line; a line that begins with a word of code needs more.
_WORDS_IN_A_ROW = re.compile(r"(?:[^\W\d_]{2,},?\s+){3}[^\W\d_]{2,}")
_MANY_WORDS_IN_A_ROW = re.compile(r"(?:[^\W\d_]{2,},?\s+){6}[^\W\d_]{2,}")
_LONG = re.compile(r"(?<!\S)\S{60,}")
_CODE = re.compile(r"`[^`\n]*`")
_ADDRESS = re.compile(r"!\[[^\[\]\n]*\]\([^()\s]*\)|\]\([^()\s]*\)|https?://\S+|[^\s@]+@\S+|</?[A-Za-z!][^<>\n]*>")
_ODD = re.compile("[​‌‍⁠﻿­]")
_BREAK = re.compile("\r\n|[\r  \x85\x0b\x0c]")
_END = re.compile(r"[.!?…]+[\"'»”’)\]*_]*(?=\s|$)|。+")


def _is_code(line: str, last: str) -> bool:
    """A line of code by its beginning, or by its last mark if no words in a row speak for prose."""
    if _CODE_LINE.search(line):
        return True
    if _KEYWORD_LINE.search(line):
        return not _MANY_WORDS_IN_A_ROW.search(line)
    return last in (";", "{", "}") and not _WORDS_IN_A_ROW.search(line)


def prose_blocks(text: str) -> list[str]:
    """The prose of a Markdown text, a block a paragraph or list item; code, tables and headings are left out."""
    text = _BREAK.sub("\n", _ODD.sub("", text))
    blocks: list[list[str]] = []
    fence, fresh = "", True
    for line in text.split("\n"):
        bare = line.lstrip()
        first = bare[:1]
        if fence:
            if bare.startswith(fence):
                fence = ""
            fresh = True
            continue
        if first in "`~" and (m := _FENCE.match(line)):
            fence, fresh = m.group(1)[:3], True
            continue
        if first in "|#-=*_" and (first in "|" or _HEADING.match(line) or _RULE.match(line)) or (first in '$["' or "=" in line or bare.rstrip()[-1:] in ";{}(:") and _is_code(line, bare.rstrip()[-1:]):
            fresh = True  # also a blank line, whose first character is empty
            continue
        listed = first in "-*+•>" or first.isdigit()
        listed = listed and _LIST.match(line) is not None
        if fresh and not listed and _INDENTED.match(line):
            continue  # an indented code block
        if fresh or listed:
            blocks.append([])
            line = line[_MARKER.match(line).end() :]
        blocks[-1].append(line)
        fresh = False
    return [" ".join(b) for b in blocks]


def plain_prose(block: str) -> str:
    """A block without inline code, addresses, tags and unbroken strings."""
    block = _LONG.sub(" ", block)
    if "`" in block:
        block = _CODE.sub(" ", block)
    if "](" in block or "://" in block or "@" in block or "<" in block:
        block = _ADDRESS.sub(" ", block)
    return block


def sentences(block: str) -> list[tuple[str, bool]]:
    """The sentences of a block's plain prose and whether each has an end mark."""
    plain, out, start = plain_prose(block), [], 0
    for m in _END.finditer(plain):
        out.append((plain[start : m.end()], True))
        start = m.end()
    if not plain[start:].isspace() and start < len(plain):
        out.append((plain[start:], False))
    return out


class TextModel:
    """Log-likelihoods of words under each language; bounded by its vocabulary, so it may be broadcast."""

    KNOWN, UNKNOWN, CACHE = 5.0, 1.5, 200_000

    def __init__(self, languages: tuple[str, ...], counts: dict[str, dict[str, int]]) -> None:
        self.languages = tuple(languages)
        k = len(self.languages)
        vocabulary = sorted({w for c in counts.values() for w in c})
        table = np.zeros((len(vocabulary), k))
        at = {w: i for i, w in enumerate(vocabulary)}
        for j, lang in enumerate(self.languages):
            for w, n in counts.get(lang, {}).items():
                table[at[w], j] += n
        grams: dict[str, np.ndarray] = {}
        for w, row in zip(vocabulary, table):
            for g in self._grams(w):
                grams[g] = grams.get(g, 0) + row
        total = table.sum(0) + 1.0
        self.grams = {g: np.log((v + 0.3) / (sum(v) + 0.3 * k)).astype(np.float32) for g, v in grams.items() if v.sum() >= 3}
        logs = np.log((table + 0.2) / total)
        self.words = at
        self.table = np.maximum(logs - logs.max(1, keepdims=True), -self.KNOWN).astype(np.float32)
        self.cache: dict[str, int] | None = None

    @staticmethod
    def _grams(word: str) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def _unseen(self, word: str) -> int:
        vector = np.zeros(len(self.languages), np.float32)
        for g in self._grams(word):
            if (v := self.grams.get(g)) is not None:
                vector += v
        vector = np.maximum((vector - vector.max()) / 2, -self.UNKNOWN)
        if len(self.cache) > len(self.words) + self.CACHE:
            self.cache, self.used = dict(self.words), len(self.words)
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.used] = vector
        self.cache[word] = self.used
        self.used += 1
        return self.used - 1

    def indices(self, words: list[str]) -> list[int]:
        """Row numbers of the words in self.rows; unseen words get rows of their own."""
        if self.cache is None:
            self.cache, self.used = dict(self.words), len(self.words)
            self.rows = np.concatenate([self.table, np.zeros((4_096, len(self.languages)), np.float32)])
        get = self.cache.get
        return [self._unseen(w) if (i := get(w)) is None else i for w in words]

    def score(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(len(self.languages))
        at = self.indices(words)
        return self.rows[at].sum(0, dtype=np.float64)

    def by_sentence(self, parts: list[list[str]]) -> np.ndarray:
        """One row of summed log-likelihoods for each non-empty list of words."""
        at = self.indices([w for p in parts for w in p])
        if not at:
            return np.zeros((0, len(self.languages)))
        starts = np.cumsum([0, *map(len, parts[:-1])])
        return np.add.reduceat(self.rows[at].astype(np.float64), starts, axis=0)


def label_language(label: Column | str, codes: DataFrame, docs: DataFrame, out: str = "label_lang") -> DataFrame:
    """docs with `out`, the language that the trimmed lower-case label stands for; null where the label is unknown."""
    key = F.lower(F.regexp_replace(F.col(label) if isinstance(label, str) else label, r"^[\s ​﻿]+|[\s ​﻿]+$", ""))
    known = codes.groupBy(F.lower(F.trim("label_text")).alias("_label")).agg(F.min("lang").alias(out))
    return docs.withColumn("_label", key).join(small(known), "_label", "left").drop("_label")


def _count_words(languages: tuple[str, ...], model=None):
    """Words of each language's labelled texts; with a model, only of sentences that it finds to be in that language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {lang: Counter() for lang in languages}
        m = model.value if model is not None else None
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [WORD.findall(s.lower()) for b in prose_blocks(text) for s, _ in sentences(b)]
                if m is not None and (parts := [p for p in parts if p]):
                    best = m.by_sentence(parts).argmax(1)
                    parts = [p for p, x in zip(parts, best) if languages[x] == lang]
                for p in parts:
                    counts[lang].update(p)
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

    return run


def fit_text_model(docs: DataFrame, codes: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample_docs: int = SAMPLE_DOCS, vocabulary: int = VOCABULARY):
    """A broadcast TextModel fitted on about sample_docs labelled documents of each language.

    Two passes: the first takes the labels at their word, the second only the sentences that the first model finds to
    be in the labelled language, so that wrong labels and mixed documents lose their influence.
    """
    labelled = label_language("lang", codes, docs.select("doc_id", "lang", "text")).where(F.col("label_lang").isin(*languages))
    rates = small(labelled.groupBy("label_lang").agg((F.lit(float(sample_docs)) / F.count("*")).alias("rate")))
    drawn = (
        labelled.join(rates, "label_lang")
        .where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0) < F.col("rate"))
        .where("text is not null")
        .select("label_lang", "text")
    )
    drawn = cut(drawn)
    spark, model = docs.sparkSession, None
    for _ in range(2):
        words = drawn.mapInArrow(_count_words(tuple(languages), model), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
        kept = words.withColumn("place", F.row_number().over(top)).where(F.col("place") <= vocabulary).collect()  # at most vocabulary words a language
        counts: dict[str, dict[str, int]] = {lang: {} for lang in languages}
        for r in kept:
            counts[r.lang][r.word] = r.n
        plain = {lang: dict(c) for lang, c in counts.items()}
        for lang, c in counts.items():  # texts that lost their accents
            for w, n in c.items():
                f = strip_accents(w)
                if f != w:
                    plain[lang][f] = plain[lang].get(f, 0) + max(1, n // 4)
        model = spark.sparkContext.broadcast(TextModel(tuple(languages), plain))
    return model


def strip_accents(word: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


#: The log-likelihoods of all sentences are kept only where clear enough sentences are in two or more languages by their text.
_EVIDENCE = "doc_id long, scores array<double>, n_words int, whole array<int>, sents array<struct<s:array<float>,n:int,ended:boolean>>"
#: Share of a document's sentences that need not follow the document's own evidence.
FREE_SENTENCES = 0.1


def _text_evidence(model, languages: tuple[str, ...], min_words: int, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: TextModel = model.value
        k = len(languages)
        schema = pa.schema([("doc_id", pa.int64()), ("scores", pa.list_(pa.float64())), ("n_words", pa.int32()), ("whole", pa.list_(pa.int32())), ("sents", pa.list_(pa.struct([("s", pa.list_(pa.float32())), ("n", pa.int32()), ("ended", pa.bool_())])))])
        for batch in batches:
            out: list[dict] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts, ended = [], []
                for block in prose_blocks(text or ""):
                    for s, end in sentences(block):
                        if words := WORD.findall(s.lower()):
                            parts.append(words), ended.append(end)
                whole, sents, total, n = [0] * k, [], np.zeros(k), 0
                if parts:
                    rows = m.by_sentence(parts)
                    sizes = np.array([len(p) for p in parts])
                    best, sure = _clear(rows, sizes, np.array(ended), min_words, margin)
                    for x in best[sure]:
                        whole[x] += 1
                    total, n = rows.sum(0), int(sizes.sum())
                    if len(set(best[(sizes >= min_words) & np.array(ended)])) > 1:
                        sents = [{"s": r, "n": size, "ended": e} for r, size, e in zip(rows.tolist(), sizes.tolist(), ended)]
                out.append({"doc_id": doc_id, "scores": total.tolist(), "n_words": n, "whole": whole, "sents": sents})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _clear(rows: np.ndarray, sizes: np.ndarray, ended: np.ndarray, min_words: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Each sentence's best language, and whether it is a whole sentence of enough words in which that language is clear."""
    ordered = np.sort(rows, axis=1)
    return rows.argmax(1), (ordered[:, -1] - ordered[:, -2] >= margin) & (sizes >= min_words) & ended


def _fused_sentences(languages: tuple[str, ...], base: list[float], min_words: int, margin: float, free: float):
    """Settles the documents that came with sentences: each sentence's likelihood times its prior, which is the document's (label,
    suffix, host) but for a share `free` that follows the distribution over all documents.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("label_lang", pa.string()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_words", pa.int32()), ("whole", pa.list_(pa.int32())), ("segments", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, segments = batch.column("whole").to_pylist(), []
            for i, (prior, sents) in enumerate(zip(batch.column("prior").to_pylist(), batch.column("sents").to_pylist())):
                segments.append([])
                if sents:
                    p = np.exp(np.array(prior) - max(prior))
                    prior = np.log((1 - free) * p / p.sum() + free * np.array(base))
                    sizes = np.array([x["n"] for x in sents])
                    fused = np.array([x["s"] for x in sents], np.float64) + prior
                    best, sure = _clear(fused, sizes, np.array([x["ended"] for x in sents]), min_words, margin)
                    whole[i] = np.bincount(best[sure], minlength=len(languages)).tolist()
                    if len(set(best[sure])) > 1:
                        segments[i] = _segments(fused, prior, sizes, sure, best, languages)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "label_lang", "lang", "confidence", "n_words")), pa.array(whole, schema.field("whole").type), pa.array(segments, schema.field("segments").type)], schema=schema)

    return run


def _segments(rows: np.ndarray, prior: np.ndarray, sizes: np.ndarray, sure: np.ndarray, best: np.ndarray, languages: tuple[str, ...]) -> list[dict]:
    """Runs of sentences of one language; a short or unclear sentence goes with the sentence before it."""
    runs: list[list[int]] = []
    current = None
    for i in range(len(rows)):
        if sure[i] and best[i] != current:
            if current is None and runs:
                runs[-1][1] = i + 1  # unclear sentences before the first clear one join it
            else:
                runs.append([i, i + 1])
            current = best[i]
        elif runs:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1])
    out = []
    for start, stop in runs:
        total = (rows[start:stop] - prior).sum(0) + prior  # the prior counts once a segment
        p = np.exp(total - total.max())
        x = int(total.argmax())
        out.append({"start": start, "stop": stop, "n_words": int(sizes[start:stop].sum()), "lang": languages[x], "confidence": float(p[x] / p.sum())})
    return out


def text_evidence(docs: DataFrame, model, languages: tuple[str, ...] = LANGUAGES, min_words: int = SENTENCE_WORDS, margin: float = SENTENCE_MARGIN) -> DataFrame:
    """(doc_id, scores, n_words, whole, sents): summed word log-likelihoods, clear whole sentences by language, sentences of documents that may be mixed."""
    return docs.select("doc_id", "text").mapInArrow(_text_evidence(model, tuple(languages), min_words, margin), _EVIDENCE)


#: A document with fewer words of prose is taken to hold none.
MIN_PROSE_WORDS = 4
#: Pseudo-counts with which a host's languages lean on its domain's, and a domain's on those of all documents.
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 20.0


def host_key(column: str) -> Column:
    """Spellings of one source brought together: outer white space, case, and '_' or blanks for '-'."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.col(column), r"[\s ​]+", " "))), "[_ ]+", "-")


def detect_languages(docs: DataFrame, codes: DataFrame, languages: tuple[str, ...] = LANGUAGES, model=None) -> DataFrame:
    """One row a document: (doc_id, label_lang, lang, confidence, n_words, whole, segments).

    posterior(l) ~ likelihood(text | l) x P(label | l) x P(suffix | l) / P(suffix) x prior(l | host), where the host prior leans on its
    domain's and that on the overall distribution. The sentences of documents that may be mixed are settled with the same prior. A null, blank or prose-free text has lang null and confidence null.
    Repeated doc_ids give a row each. Extra columns are ignored.
    """
    if model is None:
        model = fit_text_model(docs, codes, languages)
    k = len(languages)
    meta = docs.select(
        "doc_id", "lang", F.coalesce(host_key("source"), F.lit("")).alias("host"), F.coalesce(host_key("x_domain"), F.lit("")).alias("domain"),
        F.coalesce(F.regexp_extract(F.lower("source_path"), r"\.([a-z0-9]{1,8})\s*$", 1), F.lit("")).alias("suffix"), "text",
    )
    evidence = meta.mapInArrow(
        _with_meta(_text_evidence(model, tuple(languages), SENTENCE_WORDS, SENTENCE_MARGIN)),
        _EVIDENCE + ", lang_label string, host string, domain string, suffix string",
    )
    evidence = evidence.withColumn("best", F.expr("array_position(scores, array_max(scores))"))
    evidence = cut(label_language("lang_label", codes, evidence).drop("lang_label"))
    prose = evidence.where(F.col("n_words") >= MIN_PROSE_WORDS)
    # Grouped statistics of all documents; each is one row a host, domain, suffix or label, made with partial aggregation.
    counts = cut(prose.groupBy("host", "domain", "suffix", "label_lang", "best").agg(F.count("*").alias("n")))
    overall = {r.best: r.n for r in counts.groupBy("best").agg(F.sum("n").alias("n")).collect()}  # one row a language
    total = sum(overall.values()) + k
    base = [(overall.get(i + 1, 0) + 1) / total for i in range(k)]
    per = lambda key: counts.groupBy(key).agg(*(F.sum(F.when(F.col("best") == i + 1, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(k)), F.sum("n").alias("c"))
    array = lambda f: F.array(*(f(i) for i in range(k)))
    domains = per("domain").select("domain", array(lambda i: (F.col(f"c{i}") + DOMAIN_WEIGHT * base[i]) / (F.col("c") + DOMAIN_WEIGHT)).alias("p_domain"))
    hosts = per("host").select("host", *(F.col(f"c{i}").alias(f"h{i}") for i in range(k)), F.col("c").alias("h"))
    suffixes = per("suffix").select("suffix", array(lambda i: (F.col(f"c{i}") + DOMAIN_WEIGHT * base[i]) / (F.col("c") + DOMAIN_WEIGHT)).alias("p_suffix"))
    confusion = {(r.label_lang, r.best): r.n for r in counts.groupBy("label_lang", "best").agg(F.sum("n").alias("n")).where("label_lang is not null").collect()}  # codes x languages
    labels = sorted({x for x, _ in confusion})
    p_label = {x: [math.log((confusion.get((x, i + 1), 0) + 1.0) / (overall.get(i + 1, 0) + len(labels) + 1.0)) for i in range(k)] for x in labels}
    label_map = F.create_map(*(y for x in labels for y in (F.lit(x), F.array(*map(F.lit, p_label[x]))))) if labels else F.lit(None).cast("map<string,array<double>>")
    full = salted_join(salted_join(salted_join(evidence, hosts, "host"), domains, "domain"), suffixes, "suffix")
    def log_prior(i: int) -> Column:
        domain = F.coalesce(F.element_at("p_domain", i + 1), F.lit(base[i]))
        return F.log((F.coalesce(F.col(f"h{i}"), F.lit(0)) + HOST_WEIGHT * domain) / (F.coalesce(F.col("h"), F.lit(0)) + HOST_WEIGHT))
    def metadata(i: int) -> Column:
        label = F.when(F.col("label_lang").isNull(), 0.0).otherwise(F.coalesce(F.element_at(F.element_at(label_map, F.col("label_lang")), i + 1), F.lit(0.0)))
        suffix = F.coalesce(F.log(F.element_at("p_suffix", i + 1) / base[i]), F.lit(0.0))
        return log_prior(i) + label + suffix
    fused = full.withColumn("prior", array(metadata)).withColumn("post", F.zip_with("scores", "prior", lambda a, b: a + b)).withColumn("top", F.array_max("post"))
    codes_array = F.array(*map(F.lit, languages))
    has_prose = F.col("n_words") >= MIN_PROSE_WORDS
    settled = fused.select(
        "doc_id", "label_lang",
        F.when(has_prose, F.element_at(codes_array, F.array_position("post", F.col("top")).cast("int"))).alias("lang"),
        F.when(has_prose, 1.0 / F.aggregate("post", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))).alias("confidence"),
        "n_words", "whole", "prior", "sents",
    )
    return settled.mapInArrow(
        _fused_sentences(tuple(languages), base, SENTENCE_WORDS, SENTENCE_MARGIN, FREE_SENTENCES),
        "doc_id long, label_lang string, lang string, confidence double, n_words int, whole array<int>, segments array<struct<start:int,stop:int,n_words:int,lang:string,confidence:double>>",
    )


def _with_meta(run):
    """Lets a batch function that reads (doc_id, text) pass the other columns through."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in run(iter([pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], ["doc_id", "text"])])):
                yield pa.RecordBatch.from_arrays([*out.columns, *(batch.column(c) for c in ("lang", "host", "domain", "suffix"))], [*out.schema.names, "lang_label", "host", "domain", "suffix"])

    return wrapped


def language_cases(detected: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(doc_id, case_kind, lang): 'mixed' with a row a language, else 'missing' or 'wrong' with the text's language."""
    there = F.filter(F.arrays_zip(F.array(*map(F.lit, languages)).alias("lang"), F.col("whole").alias("n")), lambda x: x["n"] > 0)
    found = F.transform(there, lambda x: x["lang"])
    kind = F.when(F.size(found) > 1, "mixed").when(F.col("label_lang").isNull(), "missing").when(F.col("label_lang") != F.col("lang"), "wrong")
    return (
        detected.where("lang is not null")
        .select("doc_id", kind.alias("case_kind"), F.when(F.size(found) > 1, found).otherwise(F.array("lang")).alias("found"))
        .where("case_kind is not null")
        .select("doc_id", "case_kind", F.explode("found").alias("lang"))
    )
