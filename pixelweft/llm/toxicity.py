"""Toxicity by the nearest labelled examples under exact TF-IDF cosine over all words.

The examples are a bounded sample of labelled documents; terms are all their words,
weighted by (1 + log tf), by idf, and by how far the examples' labels depend on the
word (a chi-square statistic above what chance gives), so that neighbours have in common
what tells the labels apart, and else what any texts have; vectors are scaled to length
one. The inverted index holds, for each term, its postings in blocks of examples with the
block's largest weight. For a text, the sums of those maxima bound every block's cosines;
the FIRST blocks of the highest bounds are opened, then all whose bound is not below the
k-th best cosine found there, so the k neighbours are exact.

Their votes, weighted by cosine, and the cosines' own size go through a logistic curve
fitted on every example twice: without itself among its neighbours, as an unseen text,
and with itself, as a copy; labels weigh as they are spread over all labelled rows, not
as they are in the sample. The neighbours are the evidence. An example's own row is no
neighbour of it.

Texts are scored in batches: the weights of frequent words meet as matrices, the
postings of all others in one pass, so what is done for each text alone is little.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fit_logistic, fold, logistic, sample

#: Labelled rows of either label that the index holds, at most; neighbours; examples of a block; blocks opened at first; votes.
SAMPLE, NEIGHBOURS, BLOCK, FIRST, FEATURES = 1500, 15, 64, 4, 4
#: Chi-square (one degree of freedom) that chance alone gives one word in twenty; what is above weighs in units of it.
CHANCE = 4.0
#: Words of one in so many examples are frequent; texts, and runs of postings, of a batch.
OFTEN, TEXTS, RUNS = 10, 256, 1 << 18

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _runs(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers from each of first up to, not including, its last, one run after the other."""
    n = last - first
    return np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())


class BlockMax:
    """Block-max inverted index of word counts over some of their words."""

    def __init__(self, counts: list[Counter], idf: dict[str, float]) -> None:
        self.number = {t: i for i, t in enumerate(sorted(idf))}
        self.idf = np.array([idf[t] for t in self.number])
        self.vectors = rows = [self.vector(c) for c in counts]
        # like examples next to each other, so that blocks differ: by their heaviest term
        self.order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i][0][int(rows[i][1].argmax())] if len(rows[i][0]) else len(idf), i)), int)
        self.place = np.argsort(self.order)
        self.blocks = -(-len(rows) // BLOCK)
        # postings by term, then place; entries are the runs of one term and block, with their largest weight
        term = np.concatenate([rows[i][0] for i in self.order] + [np.zeros(0, int)])
        at = np.repeat(np.arange(len(rows)), [len(rows[i][0]) for i in self.order])
        by_term = np.argsort(term, kind="stable")
        term, self.at = term[by_term], at[by_term].astype(np.int32)
        self.weight = np.concatenate([rows[i][1] for i in self.order] + [np.zeros(0)])[by_term]
        first = np.flatnonzero(np.diff(term * max(1, self.blocks) + self.at // BLOCK, prepend=-1))
        self.entry = np.append(first, len(term))
        self.entry_block = self.at[first] // BLOCK
        self.entry_most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.of_term = np.searchsorted(term[first], np.arange(len(idf) + 1))
        # frequent words have their weights as a row of a table besides, which is quicker to add
        n = np.bincount(term, minlength=len(idf))
        often = np.flatnonzero(n * OFTEN > max(1, len(rows)))
        self.row = np.full(len(idf), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.table = np.zeros((len(often), self.blocks * BLOCK))
        posted = self.row[term] >= 0
        self.table[self.row[term[posted]], self.at[posted]] = self.weight[posted]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "vectors"}  # the postings hold them

    def vector(self, text: Counter | str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of a text (or its counts) that the index holds, and their weights."""
        counts = text if isinstance(text, Counter) else Counter(words(text))
        number = self.number
        held = [(number[t], n) for t, n in counts.items() if t in number]
        if not held:
            return np.zeros(0, int), np.zeros(0)
        at, n = np.array(held).T
        w = (1 + np.log(n)) * self.idf[at]
        return at, w / np.sqrt(w @ w)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], but: np.ndarray | None = None, k: int = NEIGHBOURS) -> list[list[tuple[int, float]]]:
        """For each vector the k examples of highest cosine above zero (ties: in index order), but one (-1: none); exact."""
        but = np.full(len(vectors), -1) if but is None else but
        runs = np.cumsum([0, *((self.of_term[at + 1] - self.of_term[at]).sum() for at, _ in vectors)])
        out, a = [], 0
        while a < len(vectors):
            b = max(a + 1, min(a + TEXTS, int(np.searchsorted(runs, runs[a] + RUNS, side="right")) - 1))
            out += self._nearest(vectors[a:b], but[a:b], k)
            a = b
        return out

    def _nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], but: np.ndarray, k: int) -> list[list[tuple[int, float]]]:
        m, size = len(vectors), self.blocks * BLOCK
        text = np.repeat(np.arange(m), [len(at) for at, _ in vectors])
        at, w = (np.concatenate([v[j] for v in vectors]) for j in (0, 1))
        n = self.of_term[at + 1] - self.of_term[at]
        entries = _runs(self.of_term[at], self.of_term[at + 1])
        times, whose = np.repeat(w, n), np.repeat(text, n)
        place = whose * self.blocks + self.entry_block[entries]
        bound = np.bincount(place, times * self.entry_most[entries], m * self.blocks).reshape(m, self.blocks)
        row = self.row[at]
        often = np.zeros((m, len(self.table)))
        often[text[row >= 0], row[row >= 0]] = w[row >= 0]
        shared = (often @ self.table).reshape(m, self.blocks, BLOCK)
        sparse = np.repeat(row < 0, n)
        entries, times, whose, place = entries[sparse], times[sparse], whose[sparse], place[sparse]
        cosine = np.zeros((m, self.blocks, BLOCK))
        own = np.flatnonzero(but >= 0)
        mine = self.place[but[own]]
        opened = np.zeros((m, self.blocks), bool)
        least = np.zeros(m)
        for first in (True, False):
            new = np.zeros_like(opened)
            if first:
                np.put_along_axis(new, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST], True, axis=1)
            else:
                new = ~opened & (bound >= least[:, None] - 1e-9)
            new &= bound > 0
            chosen = new.ravel()[place]
            e = entries[chosen]
            begin, end = self.entry[e], self.entry[e + 1]
            p = _runs(begin, end)
            found = np.bincount(np.repeat(whose[chosen] * size, end - begin) + self.at[p], np.repeat(times[chosen], end - begin) * self.weight[p], m * size).reshape(cosine.shape)
            cosine[new] = np.round(found[new] + shared[new], 12)  # sums in another order differ beyond that
            cosine[own, mine // BLOCK, mine % BLOCK] = 0
            opened |= new
            if size > k:
                least = np.partition(cosine.reshape(m, size), size - k, axis=1)[:, -k]
        out = []
        for c, low in zip(cosine.reshape(m, size), least):
            hits = np.flatnonzero((c >= low) & (c > 0))
            best = hits[np.argsort(-c[hits], kind="stable")[:k]]
            out.append(list(zip(self.order[best].tolist(), c[best].tolist())))
        return out


def weights(counts: list[Counter], y: np.ndarray) -> dict[str, float]:
    """Weight of every word: its idf, more the more the labels depend on it."""
    n, n1 = len(counts), float(np.sum(y))
    df: Counter = Counter()
    pos: Counter = Counter()
    for c, label in zip(counts, y):
        df.update(c.keys())
        if label:
            pos.update(c.keys())
    out = {}
    for t, d in df.items():
        a, b = pos[t], d - pos[t]
        c, e = n1 - a, n - n1 - b
        below = (a + b) * (c + e) * (a + c) * (b + e)
        chi = n * (a * e - b * c) ** 2 / below if below else 0.0
        out[t] = (math.log((1 + n) / (1 + d)) + 1) * (1 + max(0.0, chi - CHANCE) / CHANCE)
    return out


class ToxicityIndex(BlockMax):
    """Index of labelled examples over all their words, and the curve from votes to a score."""

    def __init__(self, ids: np.ndarray, texts: list[str], y: np.ndarray, weight: np.ndarray | None = None) -> None:
        counts = [Counter(words(t)) for t in texts]
        self.ids, self.y = np.asarray(ids), np.asarray(y, float)
        self.of_id = {int(i): at for at, i in enumerate(self.ids)}
        super().__init__(counts, weights(counts, self.y))
        self.curve = self._calibrated(np.ones(len(self.y)) if weight is None else np.asarray(weight, float))

    def _votes(self, near: list[tuple[int, float]]) -> list[float]:
        """How near the neighbours are, toxic less other; the toxic share of the cosines; the cosines' sums for either label."""
        yes, total = sum(c for i, c in near if self.y[i]), sum(c for _, c in near)
        nearer = sum(c**4 if self.y[i] else -(c**4) for i, c in near)
        return [min(1.0, max(-1.0, nearer)), yes / total if total else 0.0, math.log1p(yes), math.log1p(max(0.0, total - yes))]

    def _calibrated(self, weight: np.ndarray) -> np.ndarray:
        if not len(self.y) or self.y.min() == self.y.max():
            p = np.clip(self.y.mean() if len(self.y) else 0.5, 0.01, 0.99)
            return np.array([0.0] * FEATURES + [np.log(p / (1 - p))])
        own = np.arange(len(self.y))
        votes = [self._votes(n) for near in (self.nearest(self.vectors, own), self.nearest(self.vectors)) for n in near]
        return fit_logistic(np.array(votes), np.concatenate([self.y, self.y]), np.concatenate([weight, weight]), l2=0.1)

    def score(self, texts: list[str | None], ids: list[int | None] | None = None) -> tuple[np.ndarray, list[list[int]]]:
        """Scores, and the ids of the neighbours of each, nearest first.

        Where ids are given, the example with a text's own id is left out.
        """
        own = np.array([self.of_id.get(i, -1) for i in ids or [None] * len(texts)], int)
        near = self.nearest([self.vector(t) for t in texts], own)
        x = np.array([self._votes(n) for n in near]).reshape(-1, FEATURES)
        return logistic(x, self.curve), [[int(self.ids[i]) for i, _ in n] for n in near]


def fit(rows: pd.DataFrame) -> ToxicityIndex:
    return ToxicityIndex(rows.doc_id.to_numpy(), rows.text.tolist(), rows.y.to_numpy(), rows.weight.to_numpy())


def scored(docs: DataFrame, index: ToxicityIndex, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (doc_ids of the neighbours) of every row of docs.

    Null and empty texts, and texts without any term, have no neighbours and the
    score of that. A null doc_id is not held out. Repeated rows get a row each; a
    document that is an example itself is scored without it. Other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                scores, near = index.score(part.column(2).to_pylist(), part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64()))], names=["doc_id", "held_out", "score", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double, evidence array<long>")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", each: int = SAMPLE) -> DataFrame:
    """scored() by an index of at most each labelled documents of either label outside the held-out fold."""
    return scored(docs, fit(sample(docs, labels, label, each, text)), text)
