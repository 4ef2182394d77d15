"""Text analysis as Column expressions; the two stemmers are Arrow UDFs, meant for distinct terms."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.stemming import hungarian_light, porter
from corvane.session import small

NON_WORD = r"[^\p{L}\p{N}]+"
NON_WORD_OR_MARK = r"[^\p{L}\p{N}\p{M}]+"


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base letter and combining marks, and those base letters, by rule."""
    source, target = [], []
    for code in range(0xC0, min(sys.maxunicode, 0xFFFF) + 1):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        base = "".join(x for x in parts if not unicodedata.category(x).startswith("M"))
        if parts != c and len(base) == 1 and base != c:
            source.append(c), target.append(base)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Without diacritics: precomposed letters become their base letter, combining marks go. Letters such as ß ø ł stay.

    Hangul syllables, which decompose to letters that are no marks, stay composed.
    """
    source, target = _fold_table()
    folded = F.regexp_replace(F.translate(text, source, target), r"\p{M}+", "")
    return F.when(text.rlike(r"[^\x00-\x7f]"), folded).otherwise(text)


def _words(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda t: t != "")


def tokenize(text: Column) -> Column:
    """Lower-case, folded words of letters and digits in order. Null gives null, a text without words an empty array."""
    return _words(fold(F.lower(text)), NON_WORD)


def split_tokens(text: Column) -> Column:
    """Words that may hold marks, as they stand."""
    return _words(text, NON_WORD_OR_MARK)


def lower_tokens(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def fold_tokens(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, fold), lambda t: t != "")


@F.pandas_udf(T.StringType())
def porter_stem(terms: pd.Series) -> pd.Series:
    return terms.map(porter, na_action="ignore")


@F.pandas_udf(T.StringType())
def hungarian_stem(terms: pd.Series) -> pd.Series:
    return terms.map(hungarian_light, na_action="ignore")


#: name: (fold, stemmer, identifiers as whole terms)
ANALYZERS: dict[str, tuple[bool, str | None, bool]] = {
    "porter-fold": (True, "porter", False),
    "porter-nofold": (False, "porter", False),
    "nostem-fold": (True, None, False),
    "nostem-nofold": (False, None, False),
    "ident-porter-fold": (True, "porter", True),
    "hulight-fold": (True, "hungarian", False),
    "ident-hulight-fold": (True, "hungarian", True),
}
#: The analyzer of an identifier's parts.
PARTS_ANALYZER = {"ident-porter-fold": "porter-fold", "ident-hulight-fold": "hulight-fold"}
DEFAULT_ANALYZER = "porter-fold"


def is_identifier(raw: Column) -> Column:
    return raw.rlike(r"[a-zA-Z0-9][/:_.-]+[a-zA-Z0-9]|[a-z][A-Z]")


def identifier_term(raw: Column) -> Column:
    """The one term an identifier is: lower case, folded, '@' as 'at', everything else joined by '_'; never stemmed."""
    slug = F.regexp_replace(F.regexp_replace(fold(F.lower(raw)), "@", "at"), "[^a-z0-9]+", "_")
    return F.regexp_replace(slug, "^_+|_+$", "")


def plain_terms(text: Column, analyzer: str = DEFAULT_ANALYZER) -> Column:
    """The terms of an analyzer without identifiers before stemming, as array<string>.

    Folding the whole text before the split gives the same words as folding each word after it, at one pass over the text.
    """
    folds, _, idents = ANALYZERS[analyzer]
    if idents:
        raise ValueError(f"{analyzer} makes whole terms of identifiers: use unstemmed_terms()")
    return tokenize(text) if folds else _words(F.lower(text), NON_WORD_OR_MARK)


def unstemmed_terms(text: Column, analyzer: str = DEFAULT_ANALYZER) -> Column:
    """The analyzer's terms before stemming, as array<struct<term, whole>>; whole terms of identifiers are not stemmed."""
    folds, _, idents = ANALYZERS[analyzer]
    plain = lambda x: tokenize(x) if folds else _words(F.lower(x), NON_WORD_OR_MARK)
    tag = lambda terms, whole: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(whole).alias("whole")))
    if not idents:
        return tag(plain(text), False)

    def one(raw: Column) -> Column:
        parts, whole = plain(raw), identifier_term(raw)
        redundant = (whole == "") | ((F.size(parts) == 1) & (F.get(parts, F.lit(0)) == whole))
        head = F.when(is_identifier(raw) & ~redundant, F.array(whole)).otherwise(F.array().cast("array<string>"))
        return F.concat(tag(head, True), tag(parts, False))

    return F.flatten(F.transform(_words(text, r"\s+"), one))


def stem_terms(df: DataFrame, analyzer: str, term: str = "term", whole: str | None = "whole") -> DataFrame:
    """df with `term` stemmed: the stemmer sees each distinct term once, and the stems are joined back.

    The vocabulary is broadcast only up to a checked size; beyond it, the join runs on the term, by which postings are
    partitioned anyway.
    """
    kind = ANALYZERS[analyzer][1]
    if kind is None:
        return df
    stemmer = porter_stem if kind == "porter" else hungarian_stem
    vocabulary = df.select(term).distinct().withColumn("_stem", stemmer(F.col(term)))
    stem = F.coalesce("_stem", F.col(term))
    if whole is not None:
        stem = F.when(F.col(whole), F.col(term)).otherwise(stem)
    return df.join(small(vocabulary), term, "left").withColumn(term, stem).drop("_stem")


# Shapes of technical entities and of terms that a rewrite must not touch.
ENTITY_SHAPES = (
    r"\p{Ll}\p{Lu}", r"[\p{L}\p{N}]_[\p{L}\p{N}]", r"[\p{L}\p{N}]/[\p{L}\p{N}]", r"^[\p{L}\p{N}_-]+\.[A-Za-z]{1,6}$", r"^--?[\p{L}\p{N}]",
    r"^v?\p{N}+(?:\.\p{N}+)+$", r"(?i)^[a-z][a-z0-9+.-]*://", r"^\p{N}+(?:[.,]\p{N}+)?(?:[\p{L}%]{1,8})$", r"^[A-Z][A-Z\p{N}]{2,}$",
)
RARE_SHAPES = (
    r"\p{Ll}\p{Lu}", r"[\p{L}\p{N}]_[\p{L}\p{N}]", r"[\p{L}\p{N}]/[\p{L}\p{N}]", r"[\p{L}\p{N}]\.[a-z]{1,5}$", r"^--?[\p{L}\p{N}]",
    r"[@#]|\+\+|::|[\p{L}\p{N}]:[\p{L}\p{N}]", r"^[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+$",
)


def _any_shape(token: Column, shapes: tuple[str, ...]) -> Column:
    found = token.rlike(shapes[0])
    for s in shapes[1:]:
        found = found | token.rlike(s)
    return found & (F.length(token) > 1)


# Marks that are trimmed off a token before its shape is looked at.
ENTITY_TRIM = (r"^[(\"'`\[\]{*_<]+", r"[?!.,;:)\"'`\[\]{}*_>]+$")
RARE_TRIM = ("^[(\"'`]+", "[?!.,;)\"'`]+$")


def _trimmed(tokens: Column, marks: tuple[str, str]) -> Column:
    return F.transform(tokens, lambda t: F.regexp_replace(F.regexp_replace(t, marks[0], ""), marks[1], ""))


def extract_entities(body: Column) -> Column:
    """Distinct entity-shaped tokens in order, without the marks around them."""
    bare = _trimmed(F.split(body, r"\s+"), ENTITY_TRIM)
    return F.array_distinct(F.filter(bare, lambda t: _any_shape(t, ENTITY_SHAPES)))


def carries_rare_term(query: Column) -> Column:
    bare = _trimmed(F.split(query, r"\s+"), RARE_TRIM)
    return F.exists(bare, lambda t: _any_shape(t, RARE_SHAPES))


def normalise_rewrite(raw: Column) -> Column:
    """The first line that is not blank, in lower case, without anything but letters, digits, marks and blanks, blanks collapsed."""
    first = F.get(F.filter(F.transform(F.split(raw, "\n"), F.trim), lambda x: x != ""), F.lit(0))
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(first, F.lit(""))), r"[^\p{L}\p{N}\p{M}\s]+", " "), r"\s+", " "))


# Markers of chat templates that must not reach a model as markers.
TEMPLATE_MARKERS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LINE_MARKERS = ("System:", "Assistant:", "User:", "Human:")


def _marker_patterns(extra: tuple[str, ...]) -> tuple[str, str]:
    import re

    return "|".join(map(re.escape, (*TEMPLATE_MARKERS, *extra))), "|".join(LINE_MARKERS)


def neutralise(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """The text with each template marker as [[neutralised:...]]; role markers only at the start of a line, in any case."""
    inline, line = _marker_patterns(extra)
    return F.regexp_replace(F.regexp_replace(text, f"({inline})", r"[[neutralised:$1]]"), rf"(?im)^([ \t]*)({line})", r"$1[[neutralised:$2]]")


def marker_count(text: Column, extra: tuple[str, ...] = ()) -> Column:
    inline, line = _marker_patterns(extra)
    return F.regexp_count(text, F.lit(inline)) + F.regexp_count(text, F.lit(rf"(?im)^[ \t]*(?:{line})"))


def escape_xml(text: Column) -> Column:
    """The five characters of markup as entities: safe as text and in an attribute."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def matched_terms(query_terms: Column, body_terms: Column) -> Column:
    return F.array_intersect(query_terms, body_terms)


def extract_window(text: Column, strategy: str, limit: int) -> Column:
    """What a reranker reads of a text: head, tail, headtail, maxfit (as head) or full."""
    if strategy == "full":
        return text
    cut = {
        "head": F.substring(text, 1, limit),
        "maxfit": F.substring(text, 1, limit),
        "tail": F.right(text, F.lit(limit)),
        "headtail": F.concat(F.substring(text, 1, limit // 2), F.lit("\n...\n"), F.right(text, F.lit(limit // 2))),
    }[strategy]
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def byte_size(text: Column) -> Column:
    """The budget measure: UTF-8 bytes."""
    return F.octet_length(text)


def slugify(text: Column) -> Column:
    """Lower-case ASCII letters and digits joined by '-', diacritics folded."""
    return F.regexp_replace(F.regexp_replace(fold(F.lower(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def truncate_slug(slug: Column, limit: int = 91) -> Column:
    """At most limit characters, cut at a '-' where there is one."""
    head = F.substring(slug, 1, limit)
    whole = F.substring(slug, limit + 1, 1) == "-"
    at_dash = F.regexp_replace(head, "-[^-]*$", "")
    return F.when(F.length(slug) <= limit, slug).when(whole, head).otherwise(at_dash)


def safe_id(raw: Column, limit: int = 200) -> Column:
    """An id of [A-Za-z0-9_-]; one that is longer than limit is cut and ends in 8 digits of its hash."""
    clean = F.regexp_replace(raw, "[^A-Za-z0-9_-]", "_")
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.substring(clean, 1, limit - 9), F.lit("-"), F.substring(F.sha2(raw, 256), 1, 8)))


def snippet(body: Column, terms: Column, size: int = 400) -> Column:
    """At most size characters from the densest match, cut at white space."""
    return _snippet(size)(body, terms)


def _snippet(size: int):
    import re

    word = re.compile(r"[^\W_]+")

    def plain(w: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c))

    def one(body: str | None, terms) -> str | None:
        if body is None or len(body) <= size:
            return body
        wanted = set(terms) if terms is not None else set()
        starts = [m.start() for m in word.finditer(body) if plain(m.group()) in wanted]
        if not starts:
            return body[:size]
        best, best_n, j = starts[0], 0, 0
        for i, s in enumerate(starts):
            while j < len(starts) and starts[j] < s + size:
                j += 1
            if j - i > best_n:
                best, best_n = s, j - i
        begin = best
        while begin > 0 and not body[begin - 1].isspace():
            begin -= 1
        end = min(len(body), begin + size)
        if end < len(body) and not body[end].isspace():
            back = end
            while back > begin and not body[back - 1].isspace():
                back -= 1
            end = back - 1 if back > begin else end
        return body[begin:end]

    @F.pandas_udf(T.StringType())
    def run(bodies: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([one(b, t) for b, t in zip(bodies, terms)], dtype=object)

    return run
