"""Texts beyond a size limit into pieces under it, cut at natural boundaries, with a stated overlap.

Sizes are UTF-16 code units. A recursive hierarchy of separators (section, paragraph, list item or table row, sentence, word,
character) is gone down only as far as a part is still too large. The parts, of whatever levels, are then packed greedily up to the
limit; of the boundaries in the last quarter of a piece the one of the highest level ends it. A fenced block has no sections and no
paragraphs, and a heading goes with what follows it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIMIT = 4_000
OVERLAP = 200

#: The separators in order.
LEVELS = ("section", "paragraph", "line", "sentence", "word", "character")
#: Share of a piece in which a boundary of a higher level is preferred to a later one.
SLACK = 0.25
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}#{1,6}(?:\s|$)")
_BLANK_LINES = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)+")
_SENTENCE = re.compile(r"[.!?…。][\"'»”’)\]*_]{0,8}\s+")
_WORD = re.compile(r"\s+")
_STARTS = (re.compile(r"\r\n|\r|\n"), _SENTENCE, _WORD)


class Measure:
    """UTF-16 sizes of spans of one text."""

    def __init__(self, text: str) -> None:
        self.total, self.at = len(text), None
        if not text.isascii() and max(text) > "\uffff":
            wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) > 0xFFFF
            self.at = np.concatenate([[0], np.cumsum(wide + 1)])
            self.total = int(self.at[-1])

    def units(self, a: int, b: int) -> int:
        return b - a if self.at is None else int(self.at[b] - self.at[a])

    def reach(self, a: int, units: int) -> int:
        """The furthest b with units(a, b) <= units."""
        return a + units if self.at is None else int(np.searchsorted(self.at, self.at[a] + units, "right")) - 1


def boundaries(text: str) -> list[list[int]]:
    """The places to cut at, by level from section to word, each list in order."""
    sections, lines, fences, opened, mark = [], [], [], 0, ""
    for m in _LINE.finditer(text):
        if m.start() == len(text):
            break
        fence = _FENCE.match(text, m.start(), m.end())
        if mark:
            if fence and fence.group(1)[0] == mark[0] and len(fence.group(1)) >= len(mark):
                fences.append((opened, m.end()))
                mark = ""
        elif fence:
            opened, mark = m.start(), fence.group(1)
        elif _HEADING.match(text, m.start(), m.end()):
            sections.append(m.start())
        lines.append(m.end())
    if mark:
        fences.append((opened, len(text)))
    opens = [a for a, _ in fences]

    def free(at: int) -> bool:
        i = bisect_left(opens, at) - 1
        return i < 0 or at >= fences[i][1]

    ends = lambda p: [x.end() for x in p.finditer(text)]
    return [sections, [x for x in ends(_BLANK_LINES) if free(x)], lines, ends(_SENTENCE), ends(_WORD)]


def _parts(cuts: list[list[int]], m: Measure, a: int, b: int, level: int, room: int) -> list[tuple[int, int, int]]:
    """(start, stop, level of the cut at start) of the parts of at most room units that make up the span a to b."""
    if level == len(cuts):
        out = []
        while a < b:
            e = min(b, max(a + 1, m.reach(a, room)))
            out.append((a, e, level))
            a = e
        return out
    at = cuts[level]
    edges = [a, *at[bisect_right(at, a) : bisect_left(at, b)], b]
    out = []
    for s, e in zip(edges, edges[1:]):
        if m.units(s, e) > room:
            deeper = _parts(cuts, m, s, e, level + 1, room)
            out.append((s, deeper[0][1], level))
            out.extend(deeper[1:])
        else:
            out.append((s, e, level))
    return out


def _with_headings(text: str, cuts: list[list[int]], m: Measure, parts: list[tuple[int, int, int]], room: int) -> list[tuple[int, int, int]]:
    """The parts, where one that is nothing but headings goes with the beginning of the next one."""
    sections, out = set(cuts[0]), []
    queue = parts[::-1]
    while queue:
        a, b, level = queue.pop()
        if a in sections and queue and all(not x.strip() or _HEADING.match(x) for x in text[a:b].splitlines()):
            s, e, inner = queue.pop()
            if s in sections or m.units(a, e) <= room:
                if m.units(a, e) <= room:
                    queue.append((a, e, level))
                    continue
            elif m.units(a, b) < room // 2:  # the next part is nearly as large as a piece: its first smaller part
                deeper = _parts(cuts, m, s, e, min(inner + 1, len(cuts)), room - m.units(a, b))
                queue.extend(deeper[:0:-1])
                out.append((a, deeper[0][1], level))
                continue
            queue.append((s, e, inner))
        out.append((a, b, level))
    return out


def _overlap_start(text: str, m: Measure, a: int, overlap: int) -> int:
    """Where the overlap before a begins: at a line, sentence or word among the last `overlap` units, if there is one."""
    if not a or not overlap:
        return a
    far = a
    if m.at is None:
        far = max(0, a - overlap)
    else:
        while far > 0 and m.units(far - 1, a) <= overlap:
            far -= 1
    if far == 0 or text[far - 1].isspace():
        return far
    last = a - max(1, (a - far) // 3)  # a boundary that leaves at least a third of the overlap
    return next((x.end() for p in _STARTS for x in p.finditer(text, far, a) if x.end() <= last), far)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[dict]:
    """Pieces of a text: start (with overlap), fresh (where new text begins), stop, in code points, and sizes in units.

    A text within the limit is one piece. text[fresh:stop] of all pieces, joined, is the text. The overlap begins at a
    line, sentence or word among the last `overlap` units before the piece, so it may be shorter than asked for.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    m = Measure(text)
    if m.total <= limit:
        return [{"start": 0, "fresh": 0, "stop": len(text), "units": m.total, "overlap": 0, "cut": "none"}]
    cuts, room = boundaries(text), limit - overlap
    parts = _with_headings(text, cuts, m, _parts(cuts, m, 0, len(text), 0, room), room)
    pieces, i = [], 0
    while i < len(parts):
        fresh, _, level = parts[i]
        start = _overlap_start(text, m, fresh, overlap)
        j = i + 1
        while j < len(parts) and m.units(start, parts[j][1]) <= limit:
            j += 1
        if j < len(parts):  # the highest level among the last boundaries, the later one of a level
            near = [k for k in range(i + 1, j + 1) if m.units(start, parts[k][0]) >= (1 - SLACK) * limit] or [j]
            j = min(near, key=lambda k: (parts[k][2], -k))
        stop = parts[j - 1][1]
        pieces.append({"start": start, "fresh": fresh, "stop": stop, "units": m.units(start, stop), "overlap": m.units(start, fresh), "cut": LEVELS[level] if fresh else "none"})
        i = j
    return pieces


def _split(limit: int, overlap: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            keep = [i for i in range(batch.num_columns) if i != at]
            rows, made = [], []
            for r, text in enumerate(batch.column(at).to_pylist()):
                if len(text) > limit or (not text.isascii() and Measure(text).total > limit):
                    pieces = split_text(text, limit, overlap)
                    for n, p in enumerate(pieces):
                        rows.append(r)
                        made.append((n, len(pieces), p["units"], p["overlap"], p["fresh"] - p["start"], p["cut"], text[p["start"] : p["stop"]] if with_text else None))
            cols = list(zip(*made)) or [()] * 7
            kinds = [*[pa.int32()] * 5, pa.string(), pa.string()]
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(taken.column(i) for i in keep), *(pa.array(c, k) for c, k in zip(cols, kinds))], [*(batch.schema.field(i).name for i in keep), "piece_no", "n_pieces", "n_units", "overlap_units", "overlap_chars", "cut_at", "piece"])

    return run


def split_oversized(items: DataFrame, text_col: str, keep: list[str], limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Pieces of the items whose text is longer than limit: the keep columns, piece_no, n_pieces, n_units, overlap_units, overlap_chars, cut_at, piece.

    Items within the limit, and null texts, give no rows. A piece never exceeds the limit, overlap included. The whole
    text is cut, however long; one narrow stage, no shuffle. Texts that can't be too long are dropped before Python.
    """
    big = items.where(F.octet_length(text_col) > limit).select(*keep, F.col(text_col).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*keep).schema.fields)
    schema = f"{kept}, piece_no int, n_pieces int, n_units int, overlap_units int, overlap_chars int, cut_at string, piece string"
    return big.mapInArrow(_split(limit, overlap, with_text), schema)


def atom_pieces(atoms: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """The pieces of each oversized atom, with heading_chain and an order that continues origin_index.

    piece_order = origin_index + piece_no / n_pieces lies before the next atom's origin_index; a null origin_index counts as 0
    there and stays null itself. An atom taken in more than once with the same body is cut once.
    """
    once = atoms.where(F.octet_length("body") > limit).select("atom_id", "heading_chain", "origin_index", "body").dropDuplicates(["atom_id", "body"]) if with_text else atoms
    pieces = split_oversized(once, "body", ["atom_id", "heading_chain", "origin_index"], limit, overlap, with_text)
    return pieces.withColumn("piece_order", F.coalesce("origin_index", F.lit(0)) + F.col("piece_no") / F.col("n_pieces"))


def rebuilt(pieces: DataFrame, key: list[str], limit: int = LIMIT) -> DataFrame:
    """One row a cut item: the key, body_md5 of what its pieces without their overlaps make up, within_limit, overlaps_hold.

    overlaps_hold: the overlap of each piece is what the piece before it ends with. An item's pieces, which make up one text, meet in
    one group.
    """
    w = Window.partitionBy(*key).orderBy("piece_no")
    before = F.lag("piece").over(w)
    held = F.coalesce(F.right(before, F.col("overlap_chars")) == F.left("piece", F.col("overlap_chars")), F.lit(True)) | (F.col("overlap_chars") == 0)
    rows = pieces.withColumn("_held", held)
    parts = F.sort_array(F.collect_list(F.struct("piece_no", F.substring("piece", F.col("overlap_chars") + 1, F.length("piece")).alias("t"))))
    return rows.groupBy(*key).agg(F.md5(F.array_join(F.transform(parts, lambda x: x["t"]), "")).alias("body_md5"), (F.max("n_units") <= limit).alias("within_limit"), F.bool_and("_held").alias("overlaps_hold"), (F.count("*") == F.max("n_pieces")).alias("all_there"))
