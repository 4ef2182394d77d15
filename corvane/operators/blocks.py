"""Kernels of ranking: blocks of documents against a batch of queries, inside Arrow batches.

A block holds, of each asked term, a row with what it adds to each document (a dense row if it stands in many of the block's documents). A query's
score is the sum of its terms' rows in the order of terms, so that a pair has the same score in whatever block it is met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DIGITS = 9
#: More than rounding to DIGITS moves a score.
NEAR = 2 * 10.0**-DIGITS
#: Terms of the documents of one block, over the cells of a grid.
BLOCK_TERMS = 2_000_000
#: A term in at least this part of a block's documents has a dense row.
DENSE = 1 / 16
#: Candidates that wait before the best of them are told.
WAITING = 1_000_000


@dataclass
class Asked:
    """A batch of queries: the terms of query i are terms[starts[i]:starts[i + 1]], in the order of names."""

    names: pa.Array
    ids: pa.Array
    starts: list[int]
    terms: list[int]
    weights: list[float]
    shared: np.ndarray | None  # the weight of each term, if all its queries give it the same

    @staticmethod
    def of(table: pa.Table) -> Asked:
        """table: (query_id, term, weight), a row a pair."""
        ordered = lambda c: (u := table.column(c).combine_chunks().unique()).take(pc.sort_indices(u))
        names, ids = ordered("term"), ordered("query_id")
        code = lambda c, known: pc.index_in(table.column(c).combine_chunks(), value_set=known).to_numpy(zero_copy_only=False)
        t, q = code("term", names), code("query_id", ids)
        order = np.lexsort([t, q])
        t, q, w = t[order], q[order], table.column("weight").to_numpy()[order]
        shared = np.zeros(len(names))
        shared[t] = w
        return Asked(names, ids, np.searchsorted(q, np.arange(len(ids) + 1)).tolist(), t.tolist(), w.tolist(), shared if (shared[t] == w).all() else None)


@dataclass
class Scorer:
    """How terms add up: cells (k1, b), the average length, the lower bound of BM25+, and documents in a block."""

    cells: list[tuple[float, float]]
    avg_len: float
    delta: float
    width: int

    def blocks(self, batches, asked: Asked) -> Iterator[Block]:
        """batches: (atom_id, doc_len, terms), terms being a document's terms, repeats included, or its (term, tf)."""
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy())
            at = 0
            while at < batch.num_rows:
                most = (ends[at - 1] if at else 0) + BLOCK_TERMS // len(self.cells)
                stop = min(at + self.width, batch.num_rows, max(at + 1, int(np.searchsorted(ends, most, "right"))))
                yield Block(self, asked, batch.slice(at, stop - at))
                at = stop


class Block:
    def __init__(self, how: Scorer, asked: Asked, rows: pa.RecordBatch) -> None:
        self.asked, self.ids, self.n = asked, rows.column(0), rows.num_rows
        n, lists, cells = self.n, rows.column(2), len(how.cells)
        flat = lists.flatten()
        doc = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        listed = not pa.types.is_struct(flat.type)
        found = pc.index_in(flat if listed else pc.struct_field(flat, [0]), value_set=asked.names)
        known = pc.is_valid(found).to_numpy(zero_copy_only=False)
        pair = pc.drop_null(found).to_numpy().astype(np.int64) * n + doc[known]  # by term, then by document
        if listed:
            pair, tf = np.unique(pair, return_counts=True)
        else:
            order = np.argsort(pair)
            pair, tf = pair[order], pc.struct_field(flat, [1]).to_numpy(zero_copy_only=False)[known][order].astype(np.float64)
        term, doc = pair // n, pair % n
        norm = rows.column(1).to_numpy(zero_copy_only=False).astype(np.float64)[doc] / how.avg_len if how.avg_len > 0 else np.zeros(len(doc))
        parts = np.stack([tf * (k1 + 1) / (tf + k1 * (1 - b + b * norm)) + how.delta for k1, b in how.cells])
        if asked.shared is not None:
            parts = asked.shared[term] * parts
        cuts = np.flatnonzero(np.diff(term, prepend=-1, append=-2)) if len(term) else np.zeros(1, np.int64)
        counts = np.diff(cuts)
        dense = counts >= n * DENSE
        slot, of = np.cumsum(dense) - 1, np.repeat(dense, counts)
        wide = np.zeros((int(dense.sum()), cells, n))
        wide[np.repeat(slot, counts)[of], :, doc[of]] = parts[:, of].T
        wide = wide.reshape(len(wide), cells * n)
        self.rows: list = [None] * len(asked.names)
        for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            self.rows[term[x]] = wide[slot[i]] if dense[i] else (doc[x:y], parts[:, x:y])
        self.scores = np.zeros((cells, n))
        self._flat, self._part = self.scores.reshape(-1), np.empty(cells * n)

    def add_up(self, q: int) -> np.ndarray:
        """The scores of query q, not rounded, in an array (cells, documents) that the next call overwrites."""
        a, flat, part = self.asked, self._flat, self._part
        flat.fill(0.0)
        if a.shared is not None:
            for t in a.terms[a.starts[q] : a.starts[q + 1]]:
                row = self.rows[t]
                if type(row) is tuple:
                    self.scores[:, row[0]] += row[1]
                elif row is not None:
                    np.add(flat, row, out=flat)
            return self.scores
        for i in range(a.starts[q], a.starts[q + 1]):
            row = self.rows[a.terms[i]]
            if row is None:
                continue
            if type(row) is tuple:
                self.scores[:, row[0]] += a.weights[i] * row[1]
            else:
                np.multiply(row, a.weights[i], out=part)
                np.add(flat, part, out=flat)
        return self.scores


class _Held:
    """The best k of each query and cell of what was met so far; ties by id."""

    def __init__(self, queries: int, cells: int, k: int) -> None:
        self.k, self.cells = k, cells
        self.least = np.full((queries, cells), 0.1 * 10.0**-DIGITS)  # scores that round to 0 do not count
        self.ids: list[pa.Array] = []
        self.docs = self.waiting = 0
        self.parts: list[list[np.ndarray]] = [[np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]]

    def take(self, block: Block) -> None:
        groups, docs, scores, k, n = [], [], [], self.k, block.n
        for q in range(len(self.least)):
            s = block.add_up(q)
            hits = np.flatnonzero(s >= self.least[q][:, None])
            if not len(hits):
                continue
            found = s.reshape(-1)[hits]
            cell = hits // n
            if len(hits) > 2 * k:  # more than k of one block tell a bound
                for c in np.flatnonzero(np.bincount(cell, minlength=self.cells) > k):
                    own = found[cell == c]
                    self.least[q, c] = max(self.least[q, c], np.partition(own, len(own) - k)[len(own) - k] - NEAR)
                keep = found >= self.least[q][cell]
                hits, found, cell = hits[keep], found[keep], cell[keep]
            groups.append(q * self.cells + cell)
            docs.append(hits - cell * n + self.docs)
            scores.append(found)
        self.ids.append(block.ids)
        self.docs += n
        if groups:
            self.parts.append([np.concatenate(groups), np.concatenate(docs), np.round(np.concatenate(scores), DIGITS)])
            self.waiting += len(self.parts[-1][0])
        if self.waiting > max(WAITING, len(self.parts[0][0])):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query x cells + cell, document, score), the best first."""
        group, doc, score = (np.concatenate(x) for x in zip(*self.parts))
        place = np.empty(self.docs, np.int64)
        if self.docs:
            place[pc.sort_indices(self.all_ids()).to_numpy()] = np.arange(self.docs)
        order = np.lexsort([place[doc], -score, group])
        group, doc, score = group[order], doc[order], score[order]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        rank = np.arange(len(group)) - np.repeat(first, np.diff(first, append=len(group)))
        last = rank == self.k - 1
        flat = self.least.reshape(-1)
        flat[group[last]] = np.maximum(flat[group[last]], score[last] - NEAR)
        keep = (rank < self.k) & (score > 0)
        self.parts, self.waiting = [[group[keep], doc[keep], score[keep]]], 0
        return tuple(self.parts[0])

    def all_ids(self) -> pa.Array:
        self.ids = [pa.concat_arrays(self.ids)]
        return self.ids[0]


def best(batches, asked: Asked, how: Scorer, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, atom_id, score) of the best k of each query; of a grid (query_id, atom_id, scores), null where a document is not among the best k of a cell."""
    cells = len(how.cells)
    held = _Held(len(asked.ids), cells, k)
    for block in how.blocks(batches, asked):
        held.take(block)
    group, doc, score = held.settle()
    if not len(group):
        return
    ids, query = held.all_ids(), group // cells
    if cells > 1:
        pair, at = np.unique(query * held.docs + doc, return_inverse=True)
        scores = np.full((len(pair), cells), np.nan)
        scores[at, group % cells] = score
        query, doc, score = pair // held.docs, pair % held.docs, scores
    for at in range(0, len(query), 50_000):
        part = slice(at, at + 50_000)
        if cells > 1:
            flat = score[part].reshape(-1)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, cells), pa.int32()), pa.array(flat, mask=np.isnan(flat)))
        else:
            values = pa.array(score[part])
        yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(query[part])), ids.take(pa.array(doc[part])), values], ["query_id", "atom_id", "scores" if cells > 1 else "score"])


def pair_scores(batches, asked: Asked, how: Scorer, query: np.ndarray, atom: pa.Array) -> Iterator[pa.RecordBatch]:
    """(pair, cell, score) of the pairs (query, atom) whose document is met; rounded, above 0."""
    known = atom.unique()
    wanted = (b.filter(pc.is_in(b.column(0), value_set=known)) for b in batches)
    for block in how.blocks(wanted, asked):
        doc = pc.index_in(atom, value_set=block.ids)
        here = np.flatnonzero(pc.is_valid(doc).to_numpy(zero_copy_only=False))
        doc, scores, last = pc.fill_null(doc, 0).to_numpy(), np.zeros((len(here), len(how.cells))), -1
        for i, p in enumerate(here):  # in the order of queries
            if query[p] != last:
                last = query[p]
                s = block.add_up(last)
            scores[i] = s[:, doc[p]]
        scores = np.round(scores, DIGITS)
        i, cell = np.nonzero(scores > 0)
        yield pa.RecordBatch.from_arrays([pa.array(here[i].astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(scores[i, cell])], ["pair", "cell", "score"])


def ahead(batches, asked: Asked, how: Scorer, query: np.ndarray, atom: pa.Array, scores: np.ndarray, depth: int) -> Iterator[pa.RecordBatch]:
    """(query_id, atom_id, cell, ahead): how many documents stand before a pair, a greater score or the same and a lower id; counted on until depth, from where on it does not matter.

    query: of each pair, ascending; scores: (pairs, cells), 0 where a pair has none.
    """
    n = np.zeros(scores.shape, np.int64)
    open_ = scores > 0
    first = np.searchsorted(query, np.arange(len(asked.ids) + 1))
    names = atom.to_pylist()
    for block in how.blocks(batches, asked):
        for q in np.unique(query[open_.any(axis=1)]):
            s = block.add_up(q)
            for p in range(first[q], first[q + 1]):
                for c in np.flatnonzero(open_[p]):
                    own, want = s[c], scores[p, c]
                    more, near = np.count_nonzero(own > want + NEAR), np.count_nonzero(own >= want - NEAR)
                    if near > more:
                        at = np.flatnonzero((own >= want - NEAR) & (own <= want + NEAR))
                        exact = np.round(own[at], DIGITS)
                        more += int((exact > want).sum()) + sum(x < names[p] for x in block.ids.take(pa.array(at[exact == want])).to_pylist())
                    n[p, c] += more
                    open_[p, c] = n[p, c] < depth
    p, c = np.nonzero(scores > 0)
    if len(p):
        yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(query[p])), atom.take(pa.array(p)), pa.array(c.astype(np.int32)), pa.array(n[p, c])], ["query_id", "atom_id", "cell", "ahead"])


def feedback_mass(batches, most: int, digits: int = 12) -> Iterator[pa.RecordBatch]:
    """(query_id, term, mass): of each query's feedback documents the `most` terms of the greatest sum of share x tf / doc_len, ties by term.

    batches: (query_id, docs array<struct<share, doc_len, terms>>), terms being listed with repeats.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            docs = batch.column(1).flatten()
            query = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy())
            lists = pc.struct_field(docs, [2])
            flat = lists.flatten()
            words = flat.unique()
            words = words.take(pc.sort_indices(words))
            doc = np.repeat(np.arange(len(docs)), pc.list_value_length(lists).to_numpy())
            pair, tf = np.unique(doc * max(1, len(words)) + pc.index_in(flat, value_set=words).to_numpy(), return_counts=True)
            doc, word = pair // max(1, len(words)), pair % max(1, len(words))
            share, length = pc.struct_field(docs, [0]).to_numpy(), pc.struct_field(docs, [1]).to_numpy()
            found, of = np.unique(query[doc] * max(1, len(words)) + word, return_inverse=True)
            mass = np.round(np.bincount(of, share[doc] * tf / length[doc], minlength=len(found)), digits)
            query, word = found // max(1, len(words)), found % max(1, len(words))
            order = np.lexsort([word, -mass, query])
            query, word, mass = query[order], word[order], mass[order]
            first = np.flatnonzero(np.diff(query, prepend=-1))
            keep = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query))) < most
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(query[keep])), words.take(pa.array(word[keep])), pa.array(mass[keep])], ["query_id", "term", "mass"])
