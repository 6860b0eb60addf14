"""Hard negatives by exact inner products, several of which come out of one multiplication.

Components are shifted to be zero or more and are below 2^b, so an inner product of d
of them fits a field of so many bits. Candidates are packed: a word holds one component
of each of several candidates, a field each. An anchor's component times that word is
its product with all of them, and the sum over the components holds every candidate's
inner product in its own field, with none running over into the next; taking off what
the shifts added leaves the exact score. Words are whole numbers of 53 bits held in
doubles, so that a block of anchors meets a block of words as one matrix product; where
two fields need more, they are Python's whole numbers of any width.

Groups of packed candidates, each of few labels, and parts of the anchors meet in the
cells of a grid. A first round finds each anchor's positives among groups that hold its
label; their scores set a window for each, and a second round finds the best of other
labels in it. A cell holds one part of the anchors and one group at a time, and sends
on no more than it may contribute to an answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .topk import quantized

#: Candidates packed together; candidates of a slice and anchors of a part, about; anchors that meet a group at a time.
GROUP, SLICE, PART, BLOCK = 1024, 16_384, 16_384, 1024
#: Bits of a word of doubles; candidates of a word of any width.
DOUBLE, FIELDS = 53, 16
NONE = -np.iinfo(np.int64).max


@dataclass(frozen=True)
class Packing:
    """How vectors of d components from low to high are packed."""

    d: int
    low: int
    high: int

    @property
    def shift(self) -> int:
        return max(0, -self.low)

    @property
    def width(self) -> int:
        """Bits of a field: any sum of d products of two shifted components fits."""
        return max(1, (self.d * (max(0, self.high) + self.shift) ** 2).bit_length())

    @property
    def wide(self) -> bool:
        return 2 * self.width > DOUBLE

    @property
    def fields(self) -> int:
        return FIELDS if self.wide else DOUBLE // self.width

    def shifted(self, x: np.ndarray) -> np.ndarray:
        return np.array([[int(v) + self.shift for v in row] for row in x], object).reshape(len(x), self.d) if self.wide else x + self.shift

    def words(self, x: np.ndarray) -> np.ndarray:
        """Component by word; candidate i is in field i // words of word i % words."""
        n = -(-len(x) // self.fields)
        x = self.shifted(x)
        x = np.vstack([x, np.zeros((n * self.fields - len(x), self.d), x.dtype)]).reshape(self.fields, n, self.d)
        total = x[0].T.copy()
        for k in range(1, self.fields):
            total = total + x[k].T * (1 << k * self.width)
        return total

    def products(self, anchors: np.ndarray, words: np.ndarray, x: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Inner product of each of x (anchors are these, shifted) with each candidate, whose components' sums are given."""
        packed, mask = anchors @ words, (1 << self.width) - 1
        packed = packed if self.wide else packed.astype(np.int64)
        each = np.concatenate([(packed >> k * self.width) & mask for k in range(self.fields)], axis=1)[:, : len(sums)]
        extra = self.shift * (x.sum(axis=1) + self.d * self.shift)
        return (each - extra[:, None] - self.shift * sums).astype(np.int64)

    def exact(self, x: np.ndarray) -> np.ndarray:
        """x as whole numbers whose sums are exact."""
        return np.array([[int(v) for v in row] for row in x], object).reshape(len(x), self.d) if self.wide else x.astype(np.int64)


class Best:
    """The k best (score, id) of each slot: higher scores first, ties by smaller id."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.score = np.full((slots, k), NONE)
        self.id = np.full((slots, k), np.iinfo(np.int64).max)

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        better = (scores > self.score[slots, -1]) | ((scores == self.score[slots, -1]) & (ids < self.id[slots, -1]))
        slots, scores, ids = slots[better], scores[better], ids[better]
        if not len(slots):
            return
        own = np.unique(slots)
        slots = np.concatenate([slots, np.repeat(own, self.k)])
        scores, ids = np.concatenate([scores, self.score[own].ravel()]), np.concatenate([ids, self.id[own].ravel()])
        order = np.lexsort((ids, -scores, slots))
        slots = slots[order]
        place = np.arange(len(slots)) - np.searchsorted(slots, slots)
        best = place < self.k
        self.score[slots[best], place[best]] = scores[order][best]
        self.id[slots[best], place[best]] = ids[order][best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, at = np.nonzero(self.score > NONE)
        return slot, self.score[slot, at], self.id[slot, at]


def _among_best(hit: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """hit without what k others of its row are better than, where there is much of it."""
    if scores.shape[1] <= k or hit.sum() <= 4 * k * len(hit):
        return hit
    least = np.partition(np.where(hit, scores, NONE), scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return hit & (scores >= least[:, None])


class Anchors:
    """Anchors of one part and dimension; marks has, for each, the windows (low, high) of its positives."""

    def __init__(self, packing: Packing, rows: list[tuple], k: int, marks: int) -> None:
        self.packing, self.k = packing, k
        self.row, self.label = (np.array([r[j] for r in rows], np.int64) for j in (0, 1))
        x = np.array([r[2] for r in rows], float).reshape(len(rows), packing.d)
        self.x, self.shifted = packing.exact(x), packing.shifted(x)
        self.low, self.high = (np.full((len(rows), max(1, marks)), v) for v in (1, 0))
        for i, r in enumerate(rows):
            for j, (low, high) in enumerate(r[3]):
                self.low[i, j], self.high[i, j] = low, high
        self.marks = marks
        self.best = Best(len(rows) * max(1, marks), k)

    def meet(self, words: np.ndarray, sums: np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        held = np.unique(labels)
        if self.marks:
            wanted = np.flatnonzero(self.label != held[0]) if len(held) == 1 else np.arange(len(self.row))
        else:
            wanted = np.flatnonzero(np.isin(self.label, held))
        for k in range(0, len(wanted), BLOCK):
            some = wanted[k : k + BLOCK]
            scores = self.packing.products(self.shifted[some], words, self.x[some], sums)
            same = self.label[some][:, None] == labels
            if not self.marks:
                self._take(some, same & (self.row[some][:, None] != rows) & (scores >= self.best.score[some, -1][:, None]), scores, ids)
                continue
            for j in range(self.marks):
                slots = some * self.marks + j
                low = np.maximum(self.low[some, j], self.best.score[slots, -1])
                self._take(slots, ~same & (scores >= low[:, None]) & (scores <= self.high[some, j][:, None]), scores, ids)

    def _take(self, slots: np.ndarray, hit: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        at, of = np.nonzero(_among_best(hit, scores, self.k))
        self.best.add(slots[at], scores[at, of], ids[of])


def _packed(rows: DataFrame, packings: dict[int, Packing]) -> DataFrame:
    """Rows (d, row, vec_id, label, vec) as packed groups; each is of one task's rows, of few labels."""
    names = ["d", "group", "rows", "ids", "labels", "sums", "words"]
    schema = pa.schema([(n, pa.int64() if n in ("d", "group") else pa.binary()) for n in names])

    def group(d: int, members: list[tuple]) -> list:
        p = packings[d]
        x = np.array([m[3] for m in members], float).reshape(len(members), d)
        words, sums = p.words(x), p.exact(x).sum(axis=1)
        size = (p.width * p.fields + 7) // 8
        raw = b"".join(int(w).to_bytes(size, "little") for w in words.ravel()) if p.wide else words.astype(float).tobytes()
        return [d, members[0][0], *(np.array([m[j] for m in members], np.int64).tobytes() for j in (0, 1, 2)), sums.astype(np.int64).tobytes(), raw]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def cut(d: int) -> pa.RecordBatch:
            members = sorted(held.pop(d), key=lambda m: (m[2], m[0]))
            made = [group(d, members[k : k + GROUP]) for k in range(0, len(members), GROUP)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

        for batch in batches:
            d, row, vec_id, label = (batch.column(i).to_pylist() for i in range(4))
            flat, ends = batch.column(4).flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *d])
            for i, size in enumerate(d):
                mine = held.setdefault(size, [])
                mine.append((row[i], vec_id[i], label[i], flat[ends[i] : ends[i + 1]]))
                if len(mine) >= 8 * GROUP:
                    yield cut(size)
        for size in list(held):
            yield cut(size)

    return rows.select("d", "row", "vec_id", "label", "vec").mapInArrow(run, "d long, group long, rows binary, ids binary, labels binary, sums binary, words binary")


_CELL = ["part", "slice", "is_group", "d", "row", "label", "vec", "marks", "rows", "ids", "labels", "sums", "words"]


def _search(packings: dict[int, Packing], k: int, marks: int):
    """Rows of _CELL, anchors of a cell before its groups -> (row, mark, vec_id, score)."""
    schema = pa.schema([(n, pa.int64()) for n in ("row", "mark", "vec_id", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, anchors = None, {}, None

        def answers() -> Iterator[pa.RecordBatch]:
            for a in (anchors or {}).values():
                slot, score, vec_id = a.best.found()
                for n in range(0, len(slot), 1 << 16):
                    s = slot[n : n + (1 << 16)]
                    cols = [a.row[s // max(1, marks)], s % max(1, marks), vec_id[n : n + len(s)], score[n : n + len(s)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(_CELL)}
            vecs = cols["vec"].flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *(n or 0 for n in cols["vec"].value_lengths().to_pylist())])
            for i, (part, slice_, is_group, d) in enumerate(zip(*(cols[n].to_pylist() for n in ("part", "slice", "is_group", "d")))):
                if (part, slice_) != now:
                    yield from answers()
                    now, waiting, anchors = (part, slice_), {}, None
                if not is_group:
                    windows = [(m["low"], m["high"]) for m in cols["marks"][i].as_py() or []]
                    waiting.setdefault(d, []).append((cols["row"][i].as_py(), cols["label"][i].as_py(), vecs[ends[i] : ends[i + 1]], windows))
                    continue
                if anchors is None:
                    anchors = {size: Anchors(packings[size], rows, k, marks) for size, rows in waiting.items()}
                    waiting = {}
                if d in anchors:
                    p = packings[d]
                    rows, ids, labels, sums = (np.frombuffer(cols[n][i].as_py(), np.int64) for n in ("rows", "ids", "labels", "sums"))
                    raw, n = cols["words"][i].as_py(), -(-len(rows) // p.fields)
                    if p.wide:
                        size = (p.width * p.fields + 7) // 8
                        words = np.array([int.from_bytes(raw[j : j + size], "little") for j in range(0, d * n * size, size)] + [None], object)[:-1].reshape(d, n)
                    else:
                        words = np.frombuffer(raw, float).reshape(d, n)
                    anchors[d].meet(words, sums, rows, ids, labels)
        yield from answers()

    return run


def _met(groups: DataFrame, anchors: DataFrame, parts: int, slices: int, packings: dict[int, Packing], k: int, marks: int) -> DataFrame:
    """groups of _packed() and anchors (d, row, label, vec, marks) in the cells of a grid -> (row, mark, vec_id, score)."""
    part, slice_ = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("group"), F.lit(slices)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blank = [F.lit(None).cast("binary").alias(n) for n in _CELL[8:]]
    windows = "array<struct<low:long,high:long>>"
    asked = anchors.select(part.alias("part"), every(slices).alias("slice"), F.lit(False).alias("is_group"), "d", "row", "label", "vec", F.col("marks").cast(windows).alias("marks"), *blank)
    none = F.lit(None).cast("long")
    held = groups.select(every(parts).alias("part"), slice_.alias("slice"), F.lit(True).alias("is_group"), "d", none.alias("row"), none.alias("label"), F.lit(None).cast("array<double>").alias("vec"), F.lit(None).cast(windows).alias("marks"), *_CELL[8:])
    cells = asked.union(held).repartition("part", "slice").sortWithinPartitions("part", "slice", "is_group")
    return cells.mapInArrow(_search(packings, k, marks), "row long, mark long, vec_id long, score long")


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, anchor_every: int = 100, scale: int = 256, part: int = PART, slice_: int = SLICE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    vectors (vec_id, embedding, label): anchors are the rows whose vec_id is divisible
    by anchor_every. Scores are inner products of floor(scale x); higher ones come
    first, ties by smaller vec_id. An anchor's positives are its first other rows of
    its label; for each, the negatives are the first rows of other labels whose score
    is from low to high per cent of the positive's. Rows with a null id, label or
    vector, or with null or non-finite components, take no part; rows of another
    dimension than the anchor's are nothing to it. Repeated rows are rows of their
    own: an anchor's double is another row of its label, and an anchor too. Scores
    must fit 64 bits with a factor of high. Other columns are ignored; an empty table gives no rows.
    """
    ok = "vec_id is not null and label is not null"
    rows = quantized(vectors, scale, "label").where(ok).withColumn("label", F.col("label").cast("long"))
    rows = checkpointed(rows.withColumn("d", F.size("vec").cast("long")).withColumn("row", F.monotonically_increasing_id()))
    is_anchor = F.col("vec_id") % anchor_every == 0
    # a row for each dimension
    sizes = rows.groupBy("d").agg(F.min(F.array_min("vec")).alias("low"), F.max(F.array_max("vec")).alias("high"), F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors")).collect()
    packings = {r["d"]: Packing(r["d"], int(r["low"] or 0), int(r["high"] or 0)) for r in sizes}
    grid = [max(1, math.ceil(sum(r[c] for r in sizes) / most)) for c, most in (("anchors", part), ("n", slice_))]
    groups = checkpointed(_packed(rows, packings))
    anchors = rows.where(is_anchor).select("d", "row", "vec_id", "label", "vec")
    near = _met(groups, anchors.withColumn("marks", F.array()), *grid, packings, positives, 0)
    first = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    known = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives)
    down = lambda x: F.expr(f"({x} - pmod({x}, 100)) div 100")  # noqa: E731 of long numbers, exact at any size
    bounds = F.struct((-down(f"(-{low} * score)")).alias("low"), down(f"({high} * score)").alias("high"))
    marked = checkpointed(known.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), "score", bounds.alias("mark")))).alias("found")))
    asked = anchors.join(marked, "row").select("d", "row", "label", "vec", F.col("found.mark").alias("marks"))
    far = _met(groups, asked, *grid, packings, negatives, positives)
    best = Window.partitionBy("row", "mark").orderBy(F.col("score").desc(), "vec_id")
    ranked = far.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= negatives)
    named = anchors.select("row", F.col("vec_id").alias("anchor_id")).join(marked, "row").select("row", "anchor_id", F.posexplode("found").alias("mark", "of"))
    named = named.select("row", F.col("mark").cast("long").alias("mark"), "anchor_id", F.col("of.positive_id").alias("positive_id"), F.col("of.score").alias("positive_score"))
    out = ranked.join(named, ["row", "mark"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
