"""Periodic runs of words, found in tiles by octaves of periods and stitched by document and period.

A run is a maximal stretch of words whose smallest period is q and whose length is
LEAST or more and TIMES periods or more. For each octave P <= q < 2P a document is
cut into tiles of max(SPAN, 16P) words with 8P more on either side. Boundaries stand
at every P-th word. A stretch of four periods has a boundary from which three periods
are still to come, so the words' hashes in windows of 2P, at the boundary and q later,
are equal there: tiles without such a pair hold no run and are not sent anywhere. The
others are rows of their own, dealt out evenly whatever document they are of. At a
boundary two Z-functions, one to the right and one (reversed) to the left, tell for
every period of the octave how far it holds; a stretch whose first q words are a power
of a shorter word has a smaller period and is left. The stretches are fragments, cut
off at the tile's ends; fragments of one document and period that overlap by a period
are one stretch, so sorting them by document and period stitches the runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Least length of a run in words, and in periods.
LEAST, TIMES = 6, 4
#: Words of a tile's core where periods are short; cores and margins in lengths of the octave's least period.
SPAN, CORE, MARGIN = 1024, 16, 8
#: Rows of a task's batch that are worked on at a time.
ROWS = 256
RUN = "array<struct<start:long,length:long,period:long>>"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words of the list."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def _mixed(numbers: np.ndarray) -> np.ndarray:
    x = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _doubled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of 2 size words from those of size words."""
    return h[:-size] * np.uint64(0xD6E8FEB86659FD93 + 2 * size) + h[size:]


def _pairs(h: np.ndarray, p: int) -> np.ndarray:
    """Row k, column j: whether the windows at the boundary kp and at kp + p + j have equal hashes (h: of all windows)."""
    rows = -(-(len(h) - p) // p)
    later = np.zeros(rows * p, np.uint64)
    later[: len(h) - p] = h[p:]
    out = later.reshape(rows, p) == h[: rows * p : p, None]
    out[-1, len(h) - p - (rows - 1) * p :] = False
    return out


def octaves(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each octave's least period, and the boundaries where a stretch of it may be."""
    p, h = 1, _mixed(numbers)
    while TIMES * p <= len(numbers):
        h = _doubled(h, p)
        found = _pairs(h, p).any(axis=1)
        if found.any():
            yield p, np.flatnonzero(found) * p
        p *= 2


def may_repeat(numbers: np.ndarray) -> bool:
    """Whether any tile of any octave may hold a run."""
    return len(numbers) >= LEAST and next(octaves(numbers), None) is not None


def tiles(numbers: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(least period, first word, core's start and end within the tile, the tile's numbers) of the tiles that may hold a run."""
    for p, boundaries in octaves(numbers):
        core = max(SPAN, CORE * p)
        for k in np.unique(boundaries // core).tolist():
            first = max(0, k * core - MARGIN * p)
            yield p, first, k * core - first, min(len(numbers), (k + 1) * core) - first, numbers[first : (k + 1) * core + MARGIN * p]


def _z(a: list[int], upto: int) -> list[int]:
    """For each i below upto, how many elements from i on equal those from the start on."""
    n, z, left, right = len(a), [0] * upto, 0, 0
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and a[k] == a[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _reach(a: list[int], b: int, p: int) -> tuple[list[int], list[int]]:
    """For periods below 2p: how many words from b on equal those a period later, and how many before b do.

    The Z-functions look at 8p words at first, and at twice as many as long as a period of the octave holds to the end.
    """
    n, most = len(a), min(2 * p, len(a) - b)
    size = 8 * p
    while True:
        right = _z(a[b : b + size], most)
        if b + size >= n or all(q + right[q] < size for q in range(p, most)):
            break
        size *= 2
    size = 8 * p
    while True:
        before = a[max(0, b - size) : b][::-1]
        z = _z([*before, -1, *a[b : b + most][::-1], *before], len(before) + 1 + most)
        left = [0] + [z[len(before) + 1 + most - q] for q in range(1, most)]
        if size >= b or all(left[q] < size for q in range(p, most)):
            return right, left
        size *= 2


def _primitive(word: np.ndarray) -> bool:
    """Whether a word is no power of a shorter one."""
    q = rest = len(word)
    r = 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            d = q // r
            if (word[:-d] == word[d:]).all():
                return False
            while rest % r == 0:
                rest //= r
        r += 1
    return True


def solve(numbers: np.ndarray, p: int, start: int, end: int) -> list[tuple[int, int, int]]:
    """(period, first, last + 1) of stretches of three periods or more, cut off at the tile's ends, with a boundary in its core."""
    h, size = _mixed(numbers), 1
    while size < 2 * p and len(h) > size:
        h = _doubled(h, size)
        size *= 2
    if size < 2 * p or len(h) <= p:
        return []
    pairs = _pairs(h, p)
    pairs[: start // p] = False
    pairs[-(-end // p) :] = False
    a, out, at, seen = numbers.tolist(), [], -1, {}
    for k, j in zip(*(x.tolist() for x in pairs.nonzero())):
        b, q = k * p, p + j
        if b < seen.get(q, 0):  # in a stretch that another boundary found
            continue
        if k != at:
            at, (right, left) = k, _reach(a, b, p)
        first, last = b - left[q], b + q + right[q]
        seen[q] = last - 3 * q + 1
        if last - first >= 3 * q and _primitive(numbers[first : first + q]):
            out.append((q, first, last))
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(k, ROWS).columns))


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ROWS rows and about so many bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if len(held) >= ROWS or size >= most:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _kept(words: list[bytes], digest: bool) -> bytes:
    text = b" ".join(words)
    return hashlib.sha256(text).hexdigest().encode() if digest else text


def _screened(docs: DataFrame, digest: bool) -> DataFrame:
    """doc_id, n_words, text and may: the text itself where it may hold runs, else its words joined (or their digest)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("text", pa.binary()), ("may", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text in _texts(batches):
                words = text.split()  # of bytes: at ASCII white space alone
                may = may_repeat(word_numbers(words))
                yield doc_id, len(words), text if may else _kept(words, digest), may

        return _in_batches(rows(), schema)

    return docs.mapInArrow(run, "doc_id long, n_words long, text binary, may boolean")


def _tiled(texts: DataFrame) -> DataFrame:
    """uid, p, first, core_start, core_end and numbers of every tile that may hold a run."""
    schema = pa.schema([("uid", pa.int64()), ("p", pa.int64()), ("first", pa.int64()), ("core_start", pa.int64()), ("core_end", pa.int64()), ("numbers", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(((uid, p, first, a, b, n.tobytes()) for uid, text in _texts(batches) for p, first, a, b, n in tiles(word_numbers(text.split()))), schema)

    return texts.mapInArrow(run, "uid long, p long, first long, core_start long, core_end long, numbers binary")


def _solved(tiled: DataFrame) -> DataFrame:
    """uid, period, s and e (exclusive) of the fragments in each tile."""
    schema = pa.schema([("uid", pa.int64()), ("period", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(((uid, q, first + s, first + e) for uid, p, first, a, b, n in _texts(batches) for q, s, e in solve(np.frombuffer(n, np.int32), p, a, b)), schema)

    return tiled.mapInArrow(run, "uid long, period long, s long, e long")


def stitched(fragments: DataFrame) -> DataFrame:
    """uid, period, start and length of the runs that fragments of one document and period make, where they overlap by a period."""
    before = Window.partitionBy("uid", "period").orderBy("s", "e")
    past = F.max("e").over(before.rowsBetween(Window.unboundedPreceding, -1))
    parts = fragments.withColumn("new", F.coalesce((F.col("s") > past - F.col("period")).cast("int"), F.lit(1)))
    parts = parts.withColumn("part", F.sum("new").over(before))
    whole = parts.groupBy("uid", "period", "part").agg(F.min("s").alias("start"), (F.max("e") - F.min("s")).alias("length"))
    return whole.where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period"))).select("uid", "period", "start", "length")


def collapsed(words: list[bytes], runs: list[dict]) -> list[bytes]:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        change[r["start"] + r["period"]] += 1
        change[r["start"] + r["length"]] -= 1
    drop = np.cumsum(change)[:-1] > 0
    return [w for w, d in zip(words, drop) if not d]


def period_runs(docs: DataFrame, text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of every row of docs.

    Words are runs of anything but ASCII white space, numbered from 0. collapsed has
    the words that no run holds after its first period, joined by one space (with
    digest: the hex SHA-256 of that). Null texts count as empty: no words, no runs, an
    empty text. Null ids stay null, repeated rows get a row each, other columns are
    ignored. Only texts that may hold a run, their tiles and fragments are shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    seen = checkpointed(_screened(rows, digest).withColumn("uid", F.monotonically_increasing_id()))
    none = seen.where("not may").select("doc_id", "n_words", F.array().cast(RUN).alias("runs"), F.col("text").cast("string").alias("collapsed"))
    some = seen.where("may")
    dealt = _tiled(some.select("uid", "text")).repartition("uid", "p", "first")
    found = stitched(_solved(dealt)).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("found"))
    runs = F.transform(F.coalesce("found", F.array().cast("array<struct<start:long,period:long,length:long>>")), lambda r: F.struct(r["start"], r["length"], r["period"]))
    joined = some.join(found, "uid", "left").select("doc_id", "n_words", "text", runs.cast(RUN).alias("runs"))
    return none.union(_collapsed(joined, digest))


def _collapsed(joined: DataFrame, digest: bool) -> DataFrame:
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", run_type), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(((doc_id, n, runs, _kept(collapsed(text.split(), runs), digest).decode()) for doc_id, n, text, runs in _texts(batches)), schema)

    return joined.mapInArrow(run, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def repeated_from(doc_id: Column, text: Column) -> Column:
    """A text whose words repeat from a place on, for one id in ten; the others as they are.

    With h the CRC-32 of the id in decimal and g = h div 10: where h % 10 = 0, the n
    words from a = g % n on repeat the first 1 + (n - a) div (3 + g % 8) of them.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1))
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (F.size(words) > 0), F.concat_ws(" ", F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a))).otherwise(text)
