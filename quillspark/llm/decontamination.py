"""Operator 10: benchmark decontamination by latent semantic retrieval.

Words are hashed to 2**14 terms; one pass over all texts writes each word's term (two bytes) to a table in the shared folder, and
the three passes of the latent space read that. The first counts in how many documents each term is. The second gives
the randomised SVD's range finder: every passage (24 words, TF-IDF, length 1) is added with a random sign to one of 128
rows, and Spark adds up the rows of all tasks. The third is its Rayleigh-Ritz step: the Gram matrix of all passages in that
subspace, whose eigenvectors and eigenvalues give the singular vectors and values. The last pass slides windows of 24
words, 8 apart, over all texts, maps them to the latent space (each direction scaled to unit spread) and looks for pieces
of 16 words of the items (all of them, and the last 16 words) whose cosine reaches a bound. What that misses (a few thinned copies, whose
other words pull the window away) an exact search by words finds: a text with `paraphrase` of an item's n words has 3 at least of any n -
paraphrase * n + 3 of them, so stretches with 3 of the item's rarest so many are candidates, too. `found_by` tells for each row whether the
`latent` search had its place among its candidates, or only the search by `words`; tests hold the share of the former above 0.9. Candidates with fewer of an
item's words than the decision needs go (a table of hashed item words that never leaves one out); in each other the longest common subsequence of words decides: contaminated if, in a stretch of twice the item's words and 24 more, it has
`threshold` of the item's words, or if it has `paraphrase` of them and the item's answer is there too, all of its words in
order.

What comes to the driver has a fixed size: a count for each term, the 128 rows, one Gram matrix, and the benchmark.

The answer is the column `answer` of the benchmark if it has one, else the item's last five words.

Defined results: rows only for contaminated documents, one for each document row and item; a text that matches several items
equally well has a row for each, so there are no ties to decide. Null and empty texts and items match nothing. Items of fewer than
8 words match only where all their words stand in a row. Texts of any length are read whole, in slices of documents; one document
must fit in a task. Repeated rows of documents match alike, of items give one row; null ids pass, item ids keep their type. Empty
tables give an empty result. Other columns are ignored. Work grows with windows x pieces of items, so the benchmark is bounded:
MOST_ITEMS items and MOST_BYTES bytes, else an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _words
from ._common import checkpointed, python_ready, stored

TERMS, RANK = 1 << 14, 128
WINDOW, STRIDE, PIECE = 24, 8, 16
FEW = 3
MOST_ITEMS, MOST_BYTES = 200_000, 256 << 20
#: Tasks that add up sketches of 8 MB each, at most.
SKETCH_TASKS = 4096
MAYBE_BITS = 22


def _terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(50)).astype(np.uint16)


def _word_slices(batch: pa.RecordBatch):
    for i, j in _words.slices(batch.column("text")):
        h, rows, *_ = _words.words(batch.column("text").slice(i, j - i))
        yield i, h, rows


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of documents as the terms of their words and the words of each document."""
    for batch in batches:
        for _, h, rows in _word_slices(batch):
            yield pa.RecordBatch.from_arrays([pa.array([_terms(h).tobytes()], pa.binary()), pa.array([np.diff(rows).astype(np.int32).tobytes()], pa.binary())], ["terms", "sizes"])


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, index of each document's first word, one more than documents) of each slice."""
    for terms, sizes in zip(batch.column("terms"), batch.column("sizes"), strict=True):
        yield np.frombuffer(terms.as_buffer(), np.uint16), np.concatenate([[0], np.cumsum(np.frombuffer(sizes.as_buffer(), np.int32), dtype=np.int64)])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(TERMS + 1, np.int64), 0
    for batch in batches:
        for t, rows in _decoded(batch):
            k = len(rows) - 1
            owner = np.repeat(np.arange(k), np.diff(rows))
            for a in range(0, k, 64):  # one bit for each document and term
                seen = np.zeros((min(64, k - a), TERMS), bool)
                part = slice(rows[a], rows[min(a + 64, k)])
                seen[owner[part] - a, t[part]] = True
                df[:TERMS] += seen.sum(axis=0)
            n += k
    df[TERMS] = n
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["term", "n"])


def _sketch(idf: np.ndarray):
    """RANK rows that add up passages with random signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, cells, values, held = np.zeros(RANK * TERMS), [], [], 0

        def flush() -> None:
            nonlocal out, held
            if held:
                out += np.bincount(np.concatenate(cells), weights=np.concatenate(values), minlength=RANK * TERMS)
                cells.clear()
                values.clear()
                held = 0

        any_row = False
        for batch in batches:
            for t, rows in _decoded(batch):
                if not len(t):
                    continue
                any_row = True
                w = idf[t]
                inside = np.arange(len(t)) - np.repeat(rows[:-1], np.diff(rows))
                heads = np.flatnonzero(inside % WINDOW == 0)
                norms = np.sqrt(np.maximum(np.add.reduceat(w * w, heads), 1e-12))
                ends = np.minimum(heads + 2, len(t) - 1)
                dice = _words.mix(t[heads] + (t[ends].astype(np.uint64) << np.uint64(16)) + (inside[heads].astype(np.uint64) << np.uint64(32)))  # by two words and the place
                row = (dice >> np.uint64(32)).astype(np.int64) % RANK
                scale = np.where(dice & np.uint64(1), 1.0, -1.0) / norms
                sizes = np.diff(np.append(heads, len(t)))
                cells.append(np.repeat(row * TERMS, sizes) + t)
                values.append(w * np.repeat(scale, sizes))
                held += len(t)
                if held > 2_000_000:
                    flush()
        flush()
        if any_row:
            yield _parts(out.reshape(RANK, TERMS))

    return run


def _parts(matrix: np.ndarray) -> pa.RecordBatch:
    rows = matrix.astype(np.float32)
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["block", "part"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), strict=True):
            x = np.frombuffer(part, np.float32)
            total[k] = total[k] + x if k in total else x.astype(np.float64)
    for k, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["block", "part"])


def _sum_rows(parts: DataFrame, rows: int, width: int) -> np.ndarray:
    """The sum of the matrices of all tasks, by row: first in groups of tasks, then in all."""
    near = parts.withColumn("half", F.pmod(F.spark_partition_id(), F.lit(16)))
    summed = near.repartition(64, "block", "half").drop("half").mapInArrow(_added, "block int, part binary").repartition(16, "block").mapInArrow(_added, "block int, part binary")
    out = np.zeros((rows, width))
    for r in summed.collect():  # rows x width numbers
        out[r.block] += np.frombuffer(r.part, np.float32)
    return out


def _windows(latent: np.ndarray, t: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of several documents: (document, first word, sum of the words' latent vectors). latent has a row of zeros
    behind the last term, which fills each document's last block."""
    lens = np.diff(rows)
    blocks = -(-lens // STRIDE)
    starts = np.concatenate([[0], np.cumsum(blocks)])
    padded = np.full(starts[-1] * STRIDE, TERMS, np.int64)
    padded[np.arange(len(t)) + np.repeat(starts[:-1] * STRIDE - rows[:-1], lens)] = t
    words = np.take(latent, padded, axis=0).reshape(-1, STRIDE, latent.shape[1])
    sums = np.matmul(np.ones((1, STRIDE), np.float32), words)[:, 0]
    doc = np.repeat(np.arange(len(lens)), blocks)
    v = sums.copy()
    for k in range(1, WINDOW // STRIDE):
        v[:-k] += sums[k:]
        over = np.flatnonzero(doc[k:] != doc[:-k])  # the next document's blocks
        v[over] -= sums[over + k]
    return doc, np.repeat(rows[:-1], blocks) + (np.arange(starts[-1]) - np.repeat(starts[:-1], blocks)) * STRIDE, v


def _pieces(rows: np.ndarray, most: int = 1 << 12) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `most` words, or of one document."""
    k, n = 0, len(rows) - 1
    while k < n:
        j = max(k + 1, int(np.searchsorted(rows, rows[k] + most, "right")) - 1)
        yield k, j
        k = j


def _unit(v: np.ndarray) -> np.ndarray:
    return v * (1 / np.sqrt(np.maximum(np.einsum("ij,ij->i", v, v), 1e-24)))[:, None]


def _gram(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = sent.value
        total, n = np.zeros((RANK + 1, RANK)), 0
        for batch in batches:
            for t, rows in _decoded(batch):
                for k, j in _pieces(rows):
                    if rows[j] > rows[k]:
                        part = rows[k : j + 1] - rows[k]
                        doc, firsts, v = _windows(basis, t[rows[k] : rows[j]], part)
                        v = _unit(v[(firsts - part[doc]) % WINDOW == 0])  # passages from each document's first word on
                        total[:RANK] += v.T @ v
                        n += len(v)
        if n:
            total[RANK] = n
            yield _parts(total)

    return run


def latent_space(docs: DataFrame, items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The map from terms to the whitened latent space, from all texts of both tables, its last row zero; the idf of each term."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select("text").unionByName(items.select("text"))
    terms = stored(texts.mapInArrow(_coded, "terms binary, sizes binary"), "terms").coalesce(SKETCH_TASKS)
    counts = terms.mapInArrow(_document_counts, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df, total = np.zeros(TERMS), 0
    for r in counts.collect():  # at most TERMS + 1 rows
        if r.term == TERMS:
            total = r.n
        else:
            df[r.term] = r.n
    idf = np.log((total + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)
    rows = _sum_rows(terms.mapInArrow(_sketch(idf), "block int, part binary"), RANK, TERMS)
    basis = np.linalg.qr(rows.T)[0] * idf[:, None]
    basis = np.vstack([basis, np.zeros((1, RANK))]).astype(np.float32)
    found = _sum_rows(terms.mapInArrow(_gram(sc.broadcast(basis)), "block int, part binary"), RANK + 1, RANK)
    gram = found[:RANK] / max(found[RANK, 0], 1)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    spread = np.sqrt(np.maximum(values, 1e-6 * max(values[-1], 1e-12)))
    return (basis @ (vectors / spread)).astype(np.float32), idf


def places(words: list[int]) -> dict[int, int]:
    """The positions of each word, as bits."""
    out: dict[int, int] = {}
    for i, x in enumerate(words):
        out[x] = out.get(x, 0) | (1 << i)
    return out


def lcs(where: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence of n words at their places and another list, by bit-parallel rows."""
    row = full = (1 << n) - 1
    for x in other:
        m = where.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


class Searcher:
    def __init__(self, items: list[tuple], latent: np.ndarray, idf: np.ndarray, threshold: float, paraphrase: float, bound: float):
        self.latent = latent
        h, rows, *_ = _words.words(pa.array([t for _, t, _ in items], pa.string()))
        ha, rowa, *_ = _words.words(pa.array([a for *_, a in items], pa.string()))
        self.ids, self.words, self.answers, piece, owner, limits = [], [], [], [], [], []
        for k, (i, _, answer) in enumerate(items):
            w = h[rows[k] : rows[k + 1]]
            if not len(w):
                continue
            self.ids.append(i)
            self.words.append(w.tolist())
            self.answers.append((ha[rowa[k] : rowa[k + 1]] if answer is not None and rowa[k + 1] > rowa[k] else w[-5:]).tolist())
            n = len(w)
            for a in sorted({min(a, max(0, n - PIECE)) for a in (*range(0, n, PIECE), n)}):
                p = w[a : a + PIECE]
                piece.append(latent[_terms(p)].sum(axis=0))
                owner.append(len(self.ids) - 1)
                limits.append(bound * max(0.8, math.sqrt(min(1.0, len(p) / PIECE))))
        q = np.array(piece, np.float32).reshape(-1, latent.shape[1])
        self.owner, self.limits = np.array(owner, np.int64), np.array(limits, np.float32)
        self.queries = (_unit(q) / self.limits[:, None]).T.copy()
        self.places = [places(w) for w in self.words]
        sizes = [len(w) for w in self.words]
        self.spans = np.array([2 * n + WINDOW for n in sizes], np.int64)
        self.sure, self.enough = ([math.ceil(n * (share - 1e-9)) for n in sizes] for share in (threshold, paraphrase))
        self.least = [max(1, min(x)) for x in zip(self.sure, self.enough, strict=True)]
        self._index(idf)
        self.needed = np.array(self.least, np.int64)
        self.salts = (_words.mix(np.arange(len(sizes), dtype=np.uint64)) >> np.uint64(64 - MAYBE_BITS)).astype(np.int64)
        self.maybe = np.zeros(1 << MAYBE_BITS, bool)  # hashed (item, word)
        for k, w in enumerate(self.words):
            self.maybe[(np.array(w, np.uint64) >> np.uint64(64 - MAYBE_BITS)).astype(np.int64) ^ self.salts[k]] = True
        short = [k for k, w in enumerate(self.words) if len(w) < 8]
        self.short = {tuple(self.words[k]): k for k in short}
        self.heads = np.unique(np.array([self.words[k][0] for k in short], np.uint64))

    def _index(self, idf: np.ndarray) -> None:
        """For the exact search: the rarest words of the items of 8 words or more, and how many of an item's must meet."""
        rare: dict[int, list[int]] = {}
        self.few = np.array([min(FEW, n) for n in self.least], np.int64)
        for k, w in enumerate(self.words):
            if len(w) >= 8:
                order = np.argsort(-idf[_terms(np.array(w, np.uint64))], kind="stable")
                for x in {w[p] for p in order[: len(w) - self.least[k] + int(self.few[k])]}:
                    rare.setdefault(x, []).append(k)
        self.rare = np.array(sorted(rare), np.uint64)
        self.rare_items = np.array([k for x in sorted(rare) for k in rare[x]], np.int64)
        self.rare_ends = np.cumsum([len(rare[x]) for x in sorted(rare)], dtype=np.int64)
        self.rare_terms = np.zeros(TERMS, bool)
        self.rare_terms[_terms(self.rare)] = True

    def _by_words(self, h: np.ndarray, t: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, item, first word, word behind the last) of all stretches that can hold enough of an item's words."""
        at = np.flatnonzero(self.rare_terms[t])
        x = np.searchsorted(self.rare, h[at])
        same = self.rare[np.minimum(x, len(self.rare) - 1)] == h[at] if len(self.rare) else np.zeros(len(at), bool)
        at, x = at[same], x[same]
        n = np.diff(self.rare_ends, prepend=0)[x]
        i = self.rare_items[np.repeat(self.rare_ends[x] - np.cumsum(n), n) + np.arange(n.sum())]
        order = np.argsort(i, kind="stable")
        p, i = np.repeat(at, n)[order], i[order]
        d = np.searchsorted(rows, p, "right") - 1
        first = np.arange(len(p))
        last = first + self.few[i] - 1
        first, last = first[last < len(p)], last[last < len(p)]
        met = (i[first] == i[last]) & (d[first] == d[last]) & (p[last] - p[first] < self.spans[i[first]])
        first, last = first[met], last[met]
        i, d = i[first], d[first]
        return d, i, np.maximum(rows[d], p[last] - self.spans[i] + 1), np.minimum(rows[d + 1], p[first] + self.spans[i])

    def _regions(self, h: np.ndarray, d: np.ndarray, i: np.ndarray, low: np.ndarray, high: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, ...]:
        """Candidates of one row and item that touch, as one region with their highest cosine; without those of short items and those
        in which no stretch of the item's span has as many of its words as a copy needs."""
        long = np.array([len(w) >= 8 for w in self.words])[i] if len(i) else np.zeros(0, bool)
        order = np.flatnonzero(long)[np.lexsort((low[long], i[long], d[long]))]
        d, i, low, high, cosines = d[order], i[order], low[order], high[order], cosines[order]
        if not len(d):
            return d, i, low, high, cosines
        # the furthest end so far inside each row and item: groups are lifted above each other, so that one running maximum does
        group = np.cumsum(np.concatenate([[0], (d[1:] != d[:-1]) | (i[1:] != i[:-1])]))
        lift = group * (len(h) + 1)
        furthest = np.maximum.accumulate(high + lift)
        heads = np.flatnonzero(np.concatenate([[True], (low + lift)[1:] > furthest[:-1]]))
        low, high = low[heads], np.append(furthest[heads[1:] - 1], furthest[-1]) - lift[heads]
        d, i, cosines = d[heads], i[heads], np.maximum.reduceat(cosines, heads)
        enough = np.zeros(len(d), bool)
        sizes = high - low
        ends = np.cumsum(sizes)
        a = 0
        while a < len(d):  # about a million words at a time
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 20), "right")))
            n = sizes[a:b]
            at = np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            met = self.maybe[(h[at] >> np.uint64(64 - MAYBE_BITS)).astype(np.int64) ^ np.repeat(self.salts[i[a:b]], n)]
            first = np.cumsum(n) - n
            total = np.concatenate([[0], np.cumsum(met)])
            there = np.arange(len(met))
            held = total[np.minimum(there + np.repeat(self.spans[i[a:b]], n), np.repeat(first + n, n))] - total[there]
            enough[a:b] = np.maximum.reduceat(held, first) >= self.needed[i[a:b]]
            a = b
        return d[enough], i[enough], low[enough], high[enough], cosines[enough]

    def _answered(self, item: int, words: list[int]) -> bool:
        answer = self.answers[item]
        return lcs(places(answer), len(answer), words) == len(answer)

    def _decide(self, item: int, regions: list[list[int]]) -> tuple[int, bool]:
        """The longest common subsequence with the item in a stretch of its span, and whether a stretch is a copy."""
        where, size, span, least = self.places[item], len(self.words[item]), int(self.spans[item]), self.least[item]
        open_, best, hit = [], 0, False
        for region in regions:
            shared = [x for x in region if x in where]
            if len(shared) >= least and (most := lcs(where, size, shared)) >= least:
                open_.append((most, most >= self.sure[item] or self._answered(item, region), region))
        if not any(able for _, able, _ in open_):
            return 0, False
        for most, able, region in open_:
            counts = np.concatenate([[0], np.cumsum([x in where for x in region])])
            ends = np.minimum(np.arange(max(1, len(region) - span + 1)) + span, len(region))
            held = counts[ends] - counts[: len(ends)]
            for a in np.argsort(-held, kind="stable").tolist():  # the fullest stretches first
                if held[a] < least or ((hit or not able) and min(held[a], most) <= best):
                    break
                part = region[a : a + span]
                found = lcs(where, size, [x for x in part if x in where])
                best = max(best, found)
                hit = hit or found >= self.sure[item] or (found >= self.enough[item] and self._answered(item, part))
        return best, hit

    def _cosine(self, h: np.ndarray, item: int) -> float:
        """The highest cosine of a text's windows with the item's pieces."""
        mine = self.owner == item
        return float((_unit(_windows(self.latent, _terms(h), np.array([0, len(h)]))[2]) @ self.queries[:, mine] * self.limits[mine]).max())

    def search(self, h: np.ndarray, rows: np.ndarray) -> list[tuple[int, object, float, float, str]]:
        """(row, item id, share of the item in the longest common subsequence, cosine, search that found it)."""
        if not len(h) or not self.ids:
            return []
        near: list[tuple[np.ndarray, ...]] = []
        t = _terms(h)
        for k, j in _pieces(rows):
            if rows[j] == rows[k]:
                continue
            doc, firsts, v = _windows(self.latent, t[rows[k] : rows[j]], rows[k : j + 1] - rows[k])
            v = _unit(v)
            for a in range(0, len(v), 256):  # scores that fit the cache; queries are scaled so that the bound is 1
                score = v[a : a + 256] @ self.queries
                at = np.flatnonzero(score.ravel() >= 1)
                if len(at):
                    x, y = np.divmod(at, score.shape[1])
                    d, i, first = k + doc[a + x], self.owner[y], firsts[a + x] + rows[k]
                    size = (self.spans[i] - WINDOW) // 2
                    near.append((d, i, np.maximum(rows[d], first - size), np.minimum(rows[d + 1], first + WINDOW + size), score[x, y] * self.limits[y]))
        exact = self._by_words(h, t, rows)
        near.append((*exact, np.full(len(exact[0]), -np.inf)))
        d, i, low, high, cosines = (np.concatenate(c) for c in zip(*near, strict=True))
        d, i, low, high, cosines = self._regions(h, d, i, low, high, cosines)
        heads = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1])])) if len(d) else []
        ends = np.append(heads[1:], len(d)) if len(d) else []
        out = []
        for a, b in zip(heads, ends, strict=True):
            row, item = int(d[a]), int(i[a])
            best, hit = self._decide(item, [h[x:y].tolist() for x, y in zip(low[a:b].tolist(), high[a:b].tolist(), strict=True)])
            if hit:
                cosine = float(cosines[a:b].max())
                out.append((row, self.ids[item], best / len(self.words[item]), *((cosine, "latent") if cosine > -np.inf else (self._cosine(h[rows[row] : rows[row + 1]], item), "words"))))
        if len(self.heads):
            at = np.flatnonzero(np.isin(h, self.heads))
            seen = set()
            for p in at.tolist():
                d = int(np.searchsorted(rows, p, "right")) - 1
                for w, i in self.short.items():
                    if p + len(w) <= rows[d + 1] and (d, i) not in seen and tuple(h[p : p + len(w)].tolist()) == w:
                        seen.add((d, i))
                        out.append((d, self.ids[i], 1.0, 1.0, "words"))
        return sorted(out, key=lambda x: (x[0], str(x[1])))


def _search(sent, kind: pa.DataType, threshold: float, paraphrase: float, bound: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, latent, idf = sent.value
        s = Searcher(items, latent, idf, threshold, paraphrase, bound)
        for batch in batches:
            for i, h, rows in _word_slices(batch):
                found = s.search(h, rows)
                if found:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([i + f[0] for f in found])), pa.array([f[1] for f in found], kind), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.float64()), pa.array([f[4] for f in found], pa.string())], ["doc_id", "item_id", "lcs_share", "cosine", "found_by"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, paraphrase: float = 0.6, bound: float = 0.46) -> DataFrame:
    """Rows (doc_id, item_id, lcs_share, cosine, found_by) of docs (doc_id, text) and benchmark (item_id, text[, answer])."""
    spark = docs.sparkSession
    python_ready(spark)
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.where("text is not null").select("item_id", "text", answer.alias("answer")).distinct()
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text") + F.coalesce(F.octet_length("answer"), F.lit(0)))).first()
    if n > MOST_ITEMS or (size or 0) > MOST_BYTES:  # the benchmark is broadcast; its size is checked
        raise ValueError(f"{n} benchmark items of {size} bytes; search at most {MOST_ITEMS} items and {MOST_BYTES} bytes at a time")
    schema = f"doc_id {kind}, item_id {item_kind.simpleString()}, lcs_share double, cosine double, found_by string"
    if not n:
        return docs.select("doc_id").where("false").selectExpr("doc_id", f"cast(null as {item_kind.simpleString()}) item_id", "cast(null as double) lcs_share", "cast(null as double) cosine", "cast(null as string) found_by")
    latent, idf = latent_space(docs, items)
    rows = sorted(((r.item_id, r.text, r.answer) for r in items.collect()), key=repr)
    sent = spark.sparkContext.broadcast((rows, latent, idf))
    return docs.select("doc_id", "text").mapInArrow(_search(sent, to_arrow_type(item_kind), threshold, paraphrase, bound), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs, all their columns, that no benchmark item contaminates. Rows without a doc_id stay."""
    gone = checkpointed(contaminated(docs, benchmark, **how).where("doc_id is not null").select("doc_id").distinct())
    if gone.count() <= 2_000_000:  # at most 16 MB
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
