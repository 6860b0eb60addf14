"""SimHash near-duplicates, linked by pigeonring filtering.

The 64 bits are cut into budget + 1 segments on a ring. If two fingerprints differ
in at most budget bits, then some segment starts a chain of consecutive segments
whose cumulative differences never exceed the proportional budget: 0, 1, 2, ...
after 1, 2, 3, ... segments. The first links make the join key: the start segment
must be equal, and of the next ones, cut into parts, all but as many parts as bits
may differ there. The whole chains then prune candidates, and only what is left
gets the full Hamming check, so no pair within the distance is lost.

Copies share one fingerprint and are reduced to one row before anything is
paired. Rows that share a key are compared among themselves, and where most of
them are alike they are searched breadth first, which emits a spanning forest in
place of all pairs; keys with more than BLOCK rows are dealt out as pairs of
blocks, so no task ever holds more than two blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, if_small, text_key, wrapped
from .components import connected_components

BITS = 64
#: Rows of one key that are searched together, and rows up to which a group's pairs are looked at one by one.
BLOCK, FEW = 4096, 64
#: Words hashed at once; bounds the memory that a long text takes. Pairs looked at at once.
PIECE, PAIRS = 1 << 16, 1 << 17
#: Longs of a set's sketch.
SKETCH = 8
#: Shingles of the sets that a block may hold, 8 MB; a single set may have more.
SHINGLES = 1 << 20


def _mask(first: int, width: int) -> int:
    return ((1 << width) - 1) << first


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@dataclass(frozen=True)
class Ring:
    """Segments, join keys and chains for fingerprints within budget bits; guard, if any, bounds the distance of a second fingerprint.

    links is the number of segments that make a key, the start among them; the
    others are cut into parts, links - 1 of which may differ.
    """

    budget: int
    links: int = 2
    parts: int = 3
    guard: int = BITS

    @cached_property
    def segments(self) -> list[tuple[int, int]]:
        """(first bit, width) of each."""
        m = self.budget + 1
        cuts = [round(i * BITS / m) for i in range(m + 1)]
        return [(a, b - a) for a, b in zip(cuts, cuts[1:])]

    @cached_property
    def keys(self) -> list[tuple[int, int]]:
        """(start segment, mask of the bits that make the key)."""
        segs, out = self.segments, []
        for i, (first, width) in enumerate(segs):
            rest = [b for j in range(1, self.links) for b in range(*(lambda f, w: (f, f + w))(*segs[(i + j) % len(segs)]))]
            cuts = [round(j * len(rest) / self.parts) for j in range(self.parts + 1)]
            parts = [sum(1 << b for b in rest[a:b]) for a, b in zip(cuts, cuts[1:])]
            out += [(i, _mask(first, width) | sum(same)) for same in itertools.combinations(parts, self.parts - self.links + 1)]
        return out

    @cached_property
    def chains(self) -> np.ndarray:
        """For each start, the masks of the chains of two segments, three, and so on to all but one."""
        segs = self.segments
        return np.array([[sum(_mask(*segs[(i + j) % len(segs)]) for j in range(n)) for n in range(2, len(segs))] for i in range(len(segs))], dtype=np.uint64)

    def near(self, x: np.ndarray, start: np.ndarray | int, guards: np.ndarray) -> np.ndarray:
        """Positions in x (differences of fingerprints) and guards (of second ones) of the links: chains first, then the whole distance."""
        at = np.arange(len(x))
        for n in range(self.chains.shape[1]):
            mask = self.chains[start, n] if np.isscalar(start) else self.chains[start[at], n]
            at = at[np.bitwise_count(x[at] & mask) <= n + 1]
        at = at[np.bitwise_count(x[at]) <= self.budget]
        return at if self.guard >= BITS else at[np.bitwise_count(guards[at]) <= self.guard]


#: Four or fewer differing bits of the SimHash of four-word shingles.
STRICT = Ring(4)
#: Texts of a similarity of 0.8 or more on five-word shingles have most words in common, so the SimHashes of their different
#: words are close: within 8 bits; those of the shingles are within 18 then, and 32 apart in other texts.
LOOSE = Ring(8, links=3, parts=4, guard=18)


def split(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _ones(hashes: Iterator[list[int]]) -> tuple[np.ndarray, int]:
    """How many of the hashes have each bit, and their number."""
    ones, total = np.zeros(BITS, np.int64), 0
    for some in hashes:
        h = np.array(some, dtype="<u8")
        total += len(h)
        for k in range(0, len(h), 4096):
            ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones, total


def _majority(hashes: Iterator[list[int]]) -> int:
    ones, total = _ones(hashes)
    return int((np.packbits(2 * ones > total, bitorder="little")).view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned SimHash; 0 for a text without words."""
    return _of_shingles(split(text), shingle)


def _of_shingles(words: list[bytes], shingle: int) -> int:
    if not words:
        return 0
    digest, seed = xxhash.xxh64_intdigest, 42
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    total = len(words) - shingle + 1

    def hashes() -> Iterator[list[int]]:
        for at in range(0, total, PIECE):
            part = words[at : min(at + PIECE, total) + shingle - 1]
            joined = b" ".join(part)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            starts = np.concatenate(([0], ends[:-1]))[: len(part) - shingle + 1].tolist()
            stops = (ends[shingle - 1 :] - 1).tolist()
            yield [digest(joined[a:b], seed) for a, b in zip(starts, stops)]

    return _majority(hashes())


def strict_prints(text: str | None) -> tuple[int, int]:
    return fingerprint(text, 4), 0


def loose_prints(text: str | None) -> tuple[int, int]:
    """SimHash of the text's different words, and of its five-word shingles."""
    words = split(text)
    digest = xxhash.xxh64_intdigest
    return _majority(iter([[digest(w, 42) for w in set(words)]])), _of_shingles(words, 5)


def with_prints(docs: DataFrame, text: str = "text", prints: Callable[[str | None], tuple[int, int]] = strict_prints) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp and guard (signed longs) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [prints(t.as_py()) for t in part.column(2)]
                columns = [pa.array([_signed(f[i]) for f in found], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "text_key", "fp", "guard"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long, guard long")


def forest(fps: np.ndarray, guards: np.ndarray, start: int, ring: Ring) -> list[tuple[int, int]]:
    """Positions of linked fingerprints (unsigned) in one group, as a spanning forest of what the chains from start let through."""
    rest, out = np.arange(len(fps)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            ok = ring.near(fps[rest] ^ fps[node], start, guards[rest] ^ guards[node])
            if len(ok):
                near = rest[ok]
                out += [(node, y) for y in near]
                queue += list(near)
                rest = np.delete(rest, ok)
    return out


def _pairs(at: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, first, second) of all pairs of rows within each of the groups of sizes that begin at at, some groups a time."""
    done = np.cumsum(sizes * (sizes - 1) // 2)
    cuts = np.unique(np.searchsorted(done, np.arange(0, (done[-1] if len(done) else 0) + PAIRS, PAIRS)))
    for a, b in zip(cuts, [*cuts[1:], len(at)]):
        group = np.repeat(np.arange(a, b), sizes[a:b])
        row = np.arange(len(group)) - np.repeat(np.cumsum(sizes[a:b]) - sizes[a:b], sizes[a:b])  # within its group
        later = sizes[group] - 1 - row
        first = np.repeat(at[group] + row, later)
        step = np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)
        yield np.repeat(group, later), first, first + 1 + step


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first four columns again, in tables that cut no group of rows alike in these. Holds one group at most."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        same = np.logical_and.reduce([c == c[-1] for c in (rows.column(i).to_numpy() for i in range(4))])
        cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
        held = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut)
    if held is not None:
        yield held


def _starts(key: list[np.ndarray]) -> np.ndarray:
    """Where groups of rows alike in key begin."""
    new = np.ones(len(key[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in key])
    return np.flatnonzero(new)


def _search(ring: Ring, percent: int | None = None):
    """Rows (k int, v long, b1, b2 int, fp, guard long) sorted by the first four -> edges. Holds one group at most.

    With percent, rows hold part, size and sketch as well, and the edges are all links between rows
    of different parts whose sketches let their sets have percent hundredths of their union in common.
    """
    names = ["fp_a", "guard_a", "fp_b", "guard_b"]
    of_key = np.array([s for s, _ in ring.keys])

    def linked(a: list[np.ndarray], b: list[np.ndarray], fp: np.ndarray, guard: np.ndarray) -> pa.RecordBatch | None:
        a, b = (np.concatenate([np.zeros(0, int), *x]) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (fp[a], guard[a], fp[b], guard[b])], names=names) if len(a) else None

    def edges(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        key, fp, guard = cols[:4], cols[4], cols[5]
        if len(fp) < 2:
            return None
        at = _starts(key)
        sizes = np.diff(np.append(at, len(fp)))
        starts = of_key[key[0][at]]
        u, g, got_a, got_b = fp.view(np.uint64), guard.view(np.uint64), [], []
        large = sizes > FEW
        if percent is not None:
            part, size, sketch = cols[6], cols[7], cols[8:]

            def similar(a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
                apart = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int64) for w in sketch)
                return apart * (100 + percent) <= (100 - percent) * (size[a] + size[b])

            for group, a, b in _pairs(at[~large], sizes[~large]):
                across = np.flatnonzero(part[a] != part[b])
                group, a, b = group[across], a[across], b[across]
                ok = ring.near(u[a] ^ u[b], starts[~large][group], g[a] ^ g[b])
                ok = ok[similar(a[ok], b[ok])]
                got_a.append(a[ok])
                got_b.append(b[ok])
            for i, n, start in zip(at[large], sizes[large], starts[large]):
                for x in range(i, i + n - 1):
                    b = x + 1 + np.flatnonzero(part[x + 1 : i + n] != part[x])
                    b = b[ring.near(u[b] ^ u[x], start, g[b] ^ g[x])]
                    b = b[similar(x, b)]
                    got_a.append(np.full(len(b), x))
                    got_b.append(b)
            return linked(got_a, got_b, fp, guard)
        few = np.flatnonzero(~large & (sizes > 1))
        for group, a, b in _pairs(at[few], sizes[few]):
            ok = ring.near(u[a] ^ u[b], starts[few[group]], g[a] ^ g[b])
            n = np.bincount(group[ok], minlength=len(few))
            dense = n >= sizes[few]  # more links than a forest has
            large[few[dense]] = True
            ok = ok[~dense[group[ok]]]
            got_a.append(a[ok])
            got_b.append(b[ok])
        for i, n, start in zip(at[large], sizes[large], starts[large]):
            if pairs := forest(u[i : i + n], g[i : i + n], start, ring):
                p = np.array(pairs) + i
                got_a.append(p[:, 0])
                got_b.append(p[:, 1])
        return linked(got_a, got_b, fp, guard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            cols = [c.to_numpy() for c in rows.columns]
            cols[8:] = [c.view(np.uint64) for c in cols[8:]]
            if out := edges(cols):
                yield out

    return run


def similar_forest(fps: np.ndarray, guards: np.ndarray, sizes: np.ndarray, shingles: np.ndarray, ring: Ring, percent: int) -> list[tuple[int, int]]:
    """Positions of texts in one group that are linked and similar, as a spanning forest.

    Texts are linked if the ring links their fingerprints (unsigned), similar if their sets,
    sizes of shingles each, have percent hundredths of their union in common.
    """
    numbers, at = np.unique(shingles, return_inverse=True)
    starts, mine = np.cumsum(sizes) - sizes, np.zeros(len(numbers), bool)
    rest, out = np.arange(len(fps)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            ok = np.flatnonzero(np.bitwise_count(fps[rest] ^ fps[x]) <= ring.budget)
            ok = ok[np.bitwise_count(guards[rest[ok]] ^ guards[x]) <= ring.guard]
            n = sizes[rest[ok]]
            ok = ok[100 * np.minimum(n, sizes[x]) >= percent * np.maximum(n, sizes[x])]  # no set has more in common than the smaller one
            if not len(ok):
                continue
            n, own = sizes[rest[ok]], at[starts[x] : starts[x] + sizes[x]]
            ends = np.cumsum(n)
            mine[own] = True
            shared = np.concatenate(([0], np.cumsum(mine[at[np.arange(ends[-1]) + np.repeat(starts[rest[ok]] - ends + n, n)]])))
            mine[own] = False
            ok = ok[(shared[ends] - shared[ends - n]) * (100 + percent) >= percent * (n + sizes[x])]
            near = rest[ok]
            out += [(x, y) for y in near]
            queue += list(near)
            rest = np.delete(rest, ok)
    return out


def _search_similar(ring: Ring, percent: int):
    """Rows (k int, v long, b1, b2 int, fp, guard long, shingles array) sorted by the first four -> edges, similar_forest() of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            key, (fp, guard) = ([rows.column(i).to_numpy() for i in r] for r in (range(4), (4, 5)))
            sets = rows.column(6).combine_chunks()
            sizes, shingles = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), sets.flatten().to_numpy()
            ends = np.cumsum(sizes)
            at = _starts(key)
            for i, j in zip(at, [*at[1:], len(fp)]):
                own = shingles[ends[i] - sizes[i] : ends[j - 1]]
                if j - i > 1 and (pairs := similar_forest(fp[i:j].view(np.uint64), guard[i:j].view(np.uint64), sizes[i:j], own, ring, percent)):
                    a, b = (np.array(pairs) + i).T
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp[a], guard[a], fp[b], guard[b])], names=["fp_a", "guard_a", "fp_b", "guard_b"])

    return run


def node(fp: Column, guard: Column, ring: Ring) -> Column:
    """The number of a pair of fingerprints as a node; where there is no guard, the fingerprint."""
    return fp if ring.guard >= BITS else F.xxhash64(fp, guard)


def _keys(ring: Ring) -> Column:
    """The join keys (k, v) of a row's fp."""
    return F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for k, (_, m) in enumerate(ring.keys)])


def _dealt(rows: DataFrame, blocks: Column) -> DataFrame:
    """k, v, b1, b2 and the other columns of rows (k, v, fp, guard, ...): keys that take several blocks come as all pairs of these."""
    held = [c for c in rows.columns if c not in ("k", "v")]
    one = F.array(F.struct(F.lit(0).alias("b1"), F.lit(0).alias("b2")))
    hot = checkpointed(rows.groupBy("k", "v").agg(blocks.cast("int").alias("blocks")).where("blocks > 1"))
    if hot.isEmpty():
        return rows.select("k", "v", F.inline(one), *held)
    rows = rows.join(if_small(hot), ["k", "v"], "left")
    own = F.pmod(F.xxhash64("fp", "guard"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks").isNull(), one).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("own")),
            lambda j: F.struct(F.least(j, F.col("own")).alias("b1"), F.greatest(j, F.col("own")).alias("b2")),
        )
    )
    return rows.withColumn("own", own).select("k", "v", F.inline(pairs), *held)


def _edges(rows: DataFrame, search: Callable, ring: Ring) -> DataFrame:
    """Edges (a, b) of nodes that search finds in each group of rows alike in k, v, b1, b2."""
    order = ["k", "v", "b1", "b2"] + (["fp", "guard"] if ring.guard < BITS else [])  # forests of one group under different keys are alike then
    found = rows.repartition("k", "v", "b1", "b2").sortWithinPartitions(*order).mapInArrow(search, "fp_a long, guard_a long, fp_b long, guard_b long")
    return found.select(node(F.col("fp_a"), F.col("guard_a"), ring).alias("a"), node(F.col("fp_b"), F.col("guard_b"), ring).alias("b"))


def links(fps: DataFrame, ring: Ring = STRICT, block: int = BLOCK, percent: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp, guard) -> edges (a, b) of their nodes that connect all links.

    With percent, fps holds part (long) and what sketched() gives as well, and the edges are all links
    between different parts but those whose sketches show that their sets have less than percent
    hundredths of their union in common. These are pairs, as many as there are; similar_links() connects
    what is similar by fewer rows.
    """
    held = ["fp", "guard"] if percent is None else ["fp", "guard", "part", "size", *(f"s{i}" for i in range(SKETCH))]
    rows = _dealt(fps.select(*held, F.inline(_keys(ring))), F.ceil(F.count("*") / block))
    return _edges(rows, _search(ring, percent), ring)


def similar_links(sets: DataFrame, ring: Ring, block: int = BLOCK, percent: int = 80, shingles: int = SHINGLES) -> DataFrame:
    """Distinct fingerprints with the sets of their texts (fp, guard, component, shingles) -> edges (a, b) of their nodes that connect all links between similar sets.

    Links lie within a component. One of up to block rows and so many shingles is searched at once, a larger one by
    pairs of blocks, and where these are more than the ring's keys, its rows are dealt out by their keys first:
    so a row is sent in bounded copies, and a group gives less edges than it has rows.
    """
    rows = sets.withColumn("size", F.size("shingles").cast("long"))
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / shingles))
    whole = F.array(F.struct(F.lit(-1).alias("k"), F.col("component").alias("v")))
    large = checkpointed(rows.groupBy("component").agg(blocks.alias("blocks")).where("blocks > 1"))
    if large.isEmpty():
        rows = rows.select(F.inline(whole), F.lit(0).alias("b1"), F.lit(0).alias("b2"), "fp", "guard", "shingles")
    else:
        rows = rows.join(if_small(large), "component", "left")
        rows = rows.select("fp", "guard", "size", "shingles", F.inline(F.when(F.col("blocks") > len(ring.keys), _keys(ring)).otherwise(whole)))
        rows = _dealt(rows, blocks).drop("size")
    return _edges(rows, _search_similar(ring, percent), ring)


def _components(prints: DataFrame, ring: Ring, block: int, roots_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """prints (doc_id, fp, guard, ...) -> fp, guard, root and component_id of every distinct (fp, guard), kept in the shared folder.

    roots_of finds the roots of distinct fingerprints; without it they are those of all links.
    """
    reps = checkpointed(prints.groupBy("fp", "guard").agg(F.min("doc_id").alias("rep")))
    roots = roots_of(reps) if roots_of else connected_components(links(reps, ring, block))
    own = node(F.col("fp"), F.col("guard"), ring)
    joined = checkpointed(reps.withColumn("own", own).join(roots, F.col("own") == F.col("node"), "left").select("fp", "guard", "rep", F.coalesce("root", "own").alias("root")))
    first = checkpointed(joined.groupBy("root").agg(F.min("rep").alias("component_id")))
    return checkpointed(joined.drop("rep").join(first, "root"))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Hashes of the different shingles of a text's words, sorted; the words themselves are one if they are fewer, and a text without words has none."""
    words, digest = split(text), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([_signed(digest(b" ".join(words), 42))] if words else [], np.int64)
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle]), 42) for i in range(len(words) - shingle + 1)], np.uint64).view(np.int64))


def _shingle_sets(docs: DataFrame, text: str, prints: DataFrame, components: DataFrame, ring: Ring) -> DataFrame:
    """fp, guard, component and shingles of each node in components (node, root), by the text of the node with the smallest hash."""
    texts = prints.groupBy("fp", "guard").agg(F.min(F.struct("text_key", "doc_id")).alias("t")).select("fp", "guard", F.col("t.text_key").alias("key_"), F.col("t.doc_id").alias("id_"))
    wanted = checkpointed(texts.withColumn("node", node(F.col("fp"), F.col("guard"), ring)).join(components, "node").drop("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                sets = pa.array([shingle_set(t.as_py()) for t in part.column(3)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], sets], names=["fp", "guard", "component", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).cast("string").alias("text"))
    found = rows.join(if_small(wanted), (F.col("text_key") == F.col("key_")) & F.col("doc_id").eqNullSafe(F.col("id_"))).select("fp", "guard", "root", "text")
    sets = found.mapInArrow(run, "fp long, guard long, component long, shingles array<long>")
    return checkpointed(sets.groupBy("fp", "guard").agg(F.first("component").alias("component"), F.first("shingles").alias("shingles")))


def sketched(sets: DataFrame) -> DataFrame:
    """node, size of the set and s0, s1, ...: for each remainder that hashes of shingles have, a bit that tells whether their number is odd.

    Each shingle that only one of two sets holds turns one bit, so sketches differ in at most as many bits as sets in shingles.
    """
    names, bits = [f"s{i}" for i in range(SKETCH)], np.uint64(64 * SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                size = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                at = part.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64) % bits
                ones = np.bincount(np.repeat(np.arange(len(size)), size) * int(bits) + at.astype(np.int64), minlength=len(size) * int(bits)) % 2
                words = np.packbits(ones.astype(np.uint8).reshape(len(size), -1), axis=1, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), *(pa.array(np.ascontiguousarray(w)) for w in words.T)], names=["node", "size", *names])

    return sets.select("node", "shingles").mapInArrow(run, "node long, size long, " + ", ".join(f"{x} long" for x in names))


def similar_roots(docs: DataFrame, text: str, prints: DataFrame, reps: DataFrame, ring: Ring, block: int, percent: int) -> DataFrame:
    """node and root of the fingerprints in reps, linked where the ring links them and their texts' shingles are similar.

    The ring's links come as forests, which may leave out a link between similar texts
    for two between others. So they only tell which texts can be linked at all: each
    component of them is then searched by the shingle sets themselves, and what this
    leaves out is connected by links that were judged.
    """
    near = checkpointed(connected_components(links(reps, ring, block)))
    return connected_components(similar_links(_shingle_sets(docs, text, prints, near, ring), ring, block, percent))


def simhash_components(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (doc_id, text).

    Null and empty texts have fingerprint zero and are linked like any other.
    Repeated rows get the same result each; a null doc_id is kept, links others
    and is never a component_id unless its component has no other id. An empty
    table gives no rows; other columns are ignored.
    """
    prints = checkpointed(with_prints(docs, text).drop("text_key"))
    labels = _components(prints, STRICT, block).select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, text: str = "text", ring: Ring = LOOSE, prints: Callable[[str | None], tuple[int, int]] = loose_prints, block: int = BLOCK, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, with all their columns.

    Texts are linked where the ring links their fingerprints and their different
    five-word shingles have percent hundredths of their union in common, or more;
    texts alike in both fingerprints count as one.
    Of rows of one component with that same doc_id one is kept: of different texts
    the one with the smallest hash, of rows alike in id and text any. Rows with a
    null doc_id go if a row of their component has an id; else one of them stays.
    Null and empty texts are one component. An empty table gives no rows. Texts are
    not shuffled unless the ids that go are more than BROADCAST_ROWS.
    """
    found = checkpointed(with_prints(docs, text, prints))
    labels = _components(found, ring, block, lambda reps: similar_roots(docs, text, found, reps, ring, block, percent))
    each = checkpointed(found.join(labels, ["fp", "guard"]).groupBy("root", "component_id", "doc_id", "text_key").agg(F.count("*").alias("n")))
    # the copy that stays in each component, and how often it is there
    stays = checkpointed(each.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("text_key").alias("stays"), F.min_by("n", "text_key").alias("times")))
    judged = each.join(stays, "root").select("doc_id", "text_key", ((F.col("text_key") != F.col("stays")) | ~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("goes"), "times")
    changed = checkpointed(judged.where("goes or times > 1").select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), "goes"))
    same = F.col("row_.doc_id").cast("long").eqNullSafe(F.col("id_")) & (text_key(F.col(f"row_.{text}")) == F.col("key_"))
    out = wrapped(docs).join(if_small(changed), same, "left_anti")
    repeated = checkpointed(changed.where("not goes"))
    if not repeated.isEmpty():
        again = wrapped(docs).join(if_small(repeated), same).groupBy("id_", "key_").agg(F.min_by("row_", F.xxhash64(F.to_json("row_"))).alias("row_"))
        out = out.select("row_").union(again.select("row_"))
    return out.select("row_.*")
