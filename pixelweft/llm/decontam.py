"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with every run of non-word characters
as one space, one at either end as well, so items match whole words. An item of n
characters may differ by k = n / EDIT_SHARE edits. It is split into pieces, of which
k + 1 are looked for: a passage within k edits holds at least one of them unchanged,
so exact hits of the pieces (one Aho-Corasick pass over a document) give all places
worth looking at. There Myers' bit-parallel distance decides. Where many items share
pieces, as those made from one template do, an item is cut finer and the pieces that
the fewest items have are taken; equal items are one.

A benchmark is read in blocks of PASS_CHARS characters, each broadcast for one scan
of the documents. A worker holds the automaton of one block, some 30 bytes a
character, and builds it once.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, if_small, text_key, wrapped

#: One edit is allowed for so many characters of an item.
EDIT_SHARE = 20
#: Characters of items that one automaton holds; a longer benchmark takes several passes over the documents.
PASS_CHARS = 16_000_000
#: Items that may share a piece before an item is cut finer, and the least length of finer pieces.
SHARED, FINE = 8, 12
#: Words that an item must have for a document to go because of it; shorter ones are also found in prose that never saw them.
LEAST_WORDS = 5

_GAPS = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """The words of a text in lower case, with a space before and after each; empty if there are none."""
    words = _GAPS.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def budget(item: str, edit_share: int = EDIT_SHARE) -> int:
    """Edits allowed for a normal item; the spaces at its ends don't count."""
    return max(0, len(item) - 2) // edit_share


def pieces(item: str, n: int) -> list[tuple[int, str]]:
    """(offset, piece) of n pieces of an item, in order, lengths as equal as they can be."""
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(item: str, window: str) -> tuple[int, int]:
    """Least edit distance of item to any substring of window, and where the first such one ends (Myers 1999)."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, ch in enumerate(item):
        peq[ch] = peq.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, ch in enumerate(window):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & full
        pv = mh << 1 & full | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Finds items (id, text) in documents."""

    def __init__(self, items: list[tuple[int, str]], edit_share: int = EDIT_SHARE) -> None:
        ids: dict[str, list[int]] = {}
        for i, text in items:
            if t := normal(text):
                ids.setdefault(t, []).append(i)
        self.items = [(of, t, budget(t, edit_share)) for t, of in ids.items()]
        coarse = Counter(piece for _, t, k in self.items for _, piece in pieces(t, k + 1))
        templated = [max(coarse[piece] for _, piece in pieces(t, k + 1)) > SHARED and len(t) // FINE > k + 1 for _, t, k in self.items]
        cut = [pieces(t, min(2 * (k + 1), len(t) // FINE) if fine else k + 1) for (_, t, k), fine in zip(self.items, templated)]
        shared = Counter(piece for found in cut for _, piece in found)
        where: dict[str, list[tuple[int, int]]] = {}
        for at, (found, (_, _, k)) in enumerate(zip(cut, self.items)):
            for offset, piece in sorted(found, key=lambda p: (shared[p[1]], p[0]))[: k + 1]:
                where.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, matched places) of each item in the text, places being windows that do not touch."""
        doc = normal(text)
        if self.empty or not doc:
            return []
        starts: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(doc):
            for at, offset in where:
                starts.setdefault(at, []).append(end + 1 - size - offset)
        out = []
        for at, begins in starts.items():
            ids, item, k = self.items[at]
            begins.sort()
            best, places, lo, hi = k + 1, 0, None, 0
            for b in [*begins, None]:
                # windows of neighbouring hits are one window
                if b is not None and lo is not None and b - k <= hi:
                    hi = max(hi, b + len(item) + k)
                    continue
                if lo is not None:
                    window = doc[max(0, lo) : hi]
                    d = 0 if item in window else best_match(item, window)[0]
                    places += d <= k
                    best = min(best, d)
                if b is not None:
                    lo, hi = b - k, b + len(item) + k
            if best <= k:
                out += [(i, best, places) for i in ids]
        return sorted(out)


_built: dict[str, Matcher] = {}


def _matcher(key: str, block: Broadcast, edit_share: int) -> Matcher:
    """The matcher of a block, kept by the worker until it meets another."""
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(block.value, edit_share)
    return _built[key]


def _passes(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most PASS_CHARS characters, one at least; one block is held at a time."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").toLocalIterator():
        if block and size + len(row[1]) > PASS_CHARS:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    yield block


_HITS = "doc_id long, text_key long, item_id long, distance int, n_places int"


def _scan(docs: DataFrame, block: Broadcast, text: str, edit_share: int) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, block, edit_share)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        for batch in batches:
            rows = [(d, k, *hit) for d, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)) for hit in matcher.find(t.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "text_key", "item_id", "distance", "n_places"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, _HITS)


def _hits(docs: DataFrame, blocks: Iterator[list[tuple[int, str]]], text: str, edit_share: int) -> DataFrame:
    """doc_id, text_key and what contaminated() finds. Several blocks are scanned one after the other, and each is let go before the next is drawn."""
    sc = docs.sparkSession.sparkContext
    out, block = None, next(blocks)
    while block is not None:
        held = sc.broadcast(block)
        found = _scan(docs, held, text, edit_share)
        block = next(blocks, None)
        if out is None and block is None:
            return found
        found = checkpointed(found)
        held.destroy()
        out = found if out is None else out.union(found)
    return out


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", edit_share: int = EDIT_SHARE) -> DataFrame:
    """doc_id, item_id, distance and n_places for every document and item (item_id, text) it holds.

    distance is the least edit distance of the item to a passage of the document,
    n_places the number of separate passages within the budget. An item of under
    EDIT_SHARE characters must stand there as whole words, unchanged. Null and empty
    texts or items match nothing; items without an id are left out; repeated rows
    of documents give their pairs each, repeated items too. Whole texts are read.
    """
    return _hits(docs, _passes(items), text, edit_share).drop("text_key")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", edit_share: int = EDIT_SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs without the rows whose text holds an item of least_words or more; all columns, nothing else is dropped.

    Rows with null or empty texts stay; rows that share an id are judged by their own texts.
    """
    long = items.where(F.size(F.filter(F.split("text", r"(?U)[\W_]+"), lambda w: w != "")) >= least_words)
    blocks = _passes(long)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        at, schema, key, held = docs.columns.index(text), docs.schema, uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(first)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, held, edit_share)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in batch.column(at)], pa.bool_()))

        return docs.mapInArrow(run, schema)

    def every() -> Iterator[list[tuple[int, str]]]:
        nonlocal first, second
        yield first
        first = None
        yield second
        second = None
        yield from blocks

    goes = checkpointed(_hits(docs, every(), text, edit_share).select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_")).distinct())
    same = F.col("row_.doc_id").cast("long").eqNullSafe(F.col("id_")) & (text_key(F.col(f"row_.{text}")) == F.col("key_"))
    return wrapped(docs).join(if_small(goes), same, "left_anti").select("row_.*")
