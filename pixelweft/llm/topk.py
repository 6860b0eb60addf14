"""Exact inner-product top-k by norm-bucketed retrieval.

Candidates are grouped by length: a level holds lengths within a factor LEVEL of
each other, and a level of many rows is dealt into buckets of about BUCKET rows.
Every query first meets the longest bucket, whose k-th product is a lower bound on
its answer. That bound, divided by the lengths, is the cosine a vector of another
bucket must reach: where it is above one the bucket is skipped; where it is high
(COORDINATE or more) the few largest coordinates of the query confine the
candidates' coordinates to intervals; else lengths alone prune. What is left is
verified by exact products. Queries are dealt into parts by the length that their
bounds ask for, so a bucket is sent to the parts that may need it and to no others;
they are streamed past it in blocks, and only each bucket's best k of a query are sent
on.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

LEVEL = 1.05
#: Candidates that a task holds, about.
BUCKET = 16_384
#: Queries that meet the candidates at a time, and rows of one task of the first round.
QUERIES = 1024
#: Queries of one part, about.
PART = 16 * QUERIES
#: Local cosine from which on coordinates prune better than lengths do.
COORDINATE = 0.8
FOCUS = 4
#: Products below this are exact in doubles.
EXACT = float(1 << 53)


def quantized(vectors: DataFrame, scale: int = 256, *more: str) -> DataFrame:
    """vec_id, vec (floor(scale x), doubles), norm and more columns of vectors; rows with a null vector, or with null or non-finite components, are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * float(scale)).cast("double")).alias("vec"), *more)
    return rows.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, c: a + c * c)))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if len(x) and len(q) and float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] >= EXACT:
        return (q.astype(np.int64) @ x.astype(np.int64).T).astype(np.int64)
    return (q @ x.T).astype(np.int64)


class Bucket:
    """Candidates of one bucket, longest first; for one dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        norms = np.sqrt((x * x).sum(axis=1))
        order = np.lexsort((ids, -norms))
        self.rows, self.ids, self.x, self.norms = rows[order], ids[order], x[order], norms[order]
        self.unit = None

    def search(self, q_rows: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query's row, candidate's id, score) of each query's best k here that are not below its bound; a query's own row is none."""
        out: list[tuple[int, int, int]] = []
        if not len(self.ids):
            return out
        q_norm = np.sqrt((q * q).sum(axis=1))
        longest = q_norm * self.norms[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(longest > 0, bound / longest, np.where(bound > 0, np.inf, -np.inf))
        slack = 1 + 1e-9
        near = cosine <= slack
        by_coordinate = near & (cosine >= COORDINATE)
        for i in np.flatnonzero(by_coordinate):
            self._take(out, q_rows[i], self._by_coordinate(q[i] / q_norm[i], cosine[i] / slack), q[i], bound[i], k)
        rest = np.flatnonzero(near & ~by_coordinate)
        if len(rest):
            # a prefix of the bucket is long enough for some query of the block
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where((bound[rest] > 0) & (q_norm[rest] > 0), bound[rest] / q_norm[rest] / slack, 0).min()
            n = int(np.searchsorted(-self.norms, -need, side="right"))
            scores = _products(q[rest], self.x[:n])
            for i, row in zip(rest, scores):
                self._best(out, q_rows[i], slice(n), row, bound[i], k)
        return out

    def _by_coordinate(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Rows whose largest-coordinate values let them reach the cosine."""
        if self.unit is None:
            with np.errstate(divide="ignore", invalid="ignore"):
                self.unit = np.where(self.norms[:, None] > 0, self.x / self.norms[:, None], 0)
        rows = np.arange(len(self.ids))
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            spread = math.sqrt(max(0.0, (1 - cosine * cosine) * (1 - unit[f] * unit[f])))
            lo, hi = unit[f] * cosine - spread, unit[f] * cosine + spread
            # past the query's own direction an interval reaches to the end
            lo, hi = (-1.0 if unit[f] < 0 and -unit[f] > cosine else lo), (1.0 if unit[f] > cosine else hi)
            v = self.unit[rows, f]
            rows = rows[(v >= lo - 1e-9) & (v <= hi + 1e-9)]
        return rows

    def _take(self, out: list, q_row: int, places: np.ndarray, q: np.ndarray, bound: float, k: int) -> None:
        if len(places):
            self._best(out, q_row, places, _products(q[None], self.x[places])[0], bound, k)

    def _best(self, out: list, q_row: int, places: np.ndarray | slice, scores: np.ndarray, bound: float, k: int) -> None:
        ids = self.ids[places]
        at = np.flatnonzero((scores >= bound) & (self.rows[places] != q_row))
        if len(at) > k:
            least = np.partition(scores[at], len(at) - k)[len(at) - k]
            at = at[scores[at] >= least]
            at = at[np.lexsort((ids[at], -scores[at]))[:k]]
        out += [(q_row, int(ids[i]), int(scores[i])) for i in at]


def _search(k: int):
    """Rows (bucket, part, query, row, vec_id, vec, bound), candidates before queries -> (query_row, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, buckets, queue = None, [], None, []

        def answer() -> pa.RecordBatch | None:
            nonlocal queue
            rows, queue = queue, []
            out: list[tuple[int, int, int]] = []
            for d in {len(v) for _, v, _ in rows}:
                if d in buckets:
                    some = [r for r in rows if len(r[1]) == d]
                    out += buckets[d].search(np.array([r[0] for r in some]), np.array([r[1] for r in some], dtype=float).reshape(len(some), d), np.array([r[2] for r in some]), k)
            if out:
                cols = list(zip(*out))
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_row", "vec_id", "score"])
            return None

        for batch in batches:
            cols = batch.columns
            flat = cols[5].flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *cols[5].value_lengths().to_pylist()])
            for i, (b, p, is_query, row, vec_id, bound) in enumerate(zip(*(cols[j].to_pylist() for j in (0, 1, 2, 3, 4, 6)))):
                if (b, p) != now:
                    if queue and buckets is not None and (got := answer()):
                        yield got
                    now, held, buckets, queue = (b, p), [], None, []
                vec = flat[ends[i] : ends[i + 1]]
                if not is_query:
                    held.append((row, vec_id, vec))
                    continue
                if buckets is None:
                    buckets = {}
                    for d in {len(h[2]) for h in held}:
                        some = [h for h in held if len(h[2]) == d]
                        buckets[d] = Bucket(np.array([h[0] for h in some]), np.array([h[1] for h in some]), np.array([h[2] for h in some], dtype=float).reshape(-1, d))
                    held = []
                queue.append((row, vec, -math.inf if bound is None else bound))
                if len(queue) >= QUERIES and (got := answer()):
                    yield got
        if queue and buckets is not None and (got := answer()):
            yield got

    return run


def _met(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """candidates (bucket, part, row, vec_id, vec), queries (bucket, part, row, vec_id, vec, bound) -> (query_row, vec_id, score)."""
    rows = candidates.select("bucket", "part", F.lit(False).alias("query"), "row", "vec_id", "vec", F.lit(None).cast("double").alias("bound"))
    rows = rows.union(queries.select("bucket", "part", F.lit(True), "row", "vec_id", "vec", "bound"))
    return rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "query").mapInArrow(_search(k), "query_row long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query; the rank limit is applied before rows are sent (window group limit), too."""
    w = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _named(best: DataFrame, queries: DataFrame) -> DataFrame:
    """best with the queries' ids in place of their rows."""
    return best.join(queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id")), "query_row").select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, bucket: int = BUCKET) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best vectors.

    vectors (vec_id, embedding): queries are the rows whose vec_id is divisible by
    query_every, candidates all rows but the query's own. Ties go to
    the smaller vec_id. Rows with a null id, and vectors that are null or hold null
    or non-finite components, take no part; vectors of another dimension than the
    query's are no candidates of it. Repeated rows are rows of their own: each is a
    candidate, also of its double, and each query row has an answer. A query without
    candidates has no rows, an empty table gives none.
    """
    level = F.when(F.col("norm") > 0, F.floor(F.log("norm") / math.log(LEVEL)).cast("int")).otherwise(-1_000_000)
    rows = checkpointed(quantized(vectors, scale).where("vec_id is not null").withColumn("level", level).withColumn("row", F.monotonically_increasing_id()))
    # one row for each level: lengths are doubles, so there are at most some 15,000
    levels = [(r["level"], max(1, math.ceil(r["n"] / bucket))) for r in rows.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()]
    if not levels:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    first, ends = {}, []
    for level, n in levels:
        first[level] = sum(e[2] for e in ends)
        ends.append((level, first[level], n))
    spark = vectors.sparkSession
    table = spark.createDataFrame(ends, "level int, first int, n int")
    bucket_of = (F.col("first") + F.pmod(F.xxhash64("row"), F.col("n"))).cast("int")
    placed = rows.join(F.broadcast(table), "level").withColumn("bucket", bucket_of)
    queries = rows.where(F.col("vec_id") % query_every == 0).select("row", "vec_id", "vec", "norm")
    # first round: the longest bucket, for a bound on each answer
    parts = max(1, math.ceil(queries.count() / PART))
    dealt = lambda n: F.pmod(F.xxhash64("row", F.lit(1)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    start = _met(placed.where("bucket = 0").select("bucket", every(F.lit(parts)).alias("part"), "row", "vec_id", "vec"), queries.select(F.lit(0).alias("bucket"), dealt(F.lit(parts)).alias("part"), "row", "vec_id", "vec", F.lit(None).cast("double").alias("bound")), k)
    begun = checkpointed(_top(start, k))
    bounds = begun.groupBy("query_row").agg(F.count("*").alias("c"), F.min("score").alias("s")).where(F.col("c") == k).select(F.col("query_row").alias("row"), F.col("s").cast("double").alias("bound"))
    need = F.when((F.col("bound") > 0) & (F.col("norm") > 0), F.floor(F.log(F.col("bound") / F.col("norm")) / math.log(LEVEL)).cast("int")).otherwise(-1_000_000)
    bounded = checkpointed(queries.join(bounds, "row", "left").withColumn("need", need))
    # other rounds: all buckets that are long enough; parts stand by the length they need, so a bucket meets the first so many
    asked, low, n_parts = [], [], 0
    for level, n in sorted((r["need"], r["n"]) for r in bounded.groupBy("need").agg(F.count("*").alias("n")).collect()):  # a row a level again
        own = math.ceil(n / PART)
        asked.append((level, n_parts, own))
        low += [LEVEL**level * (1 - 1e-9) if level > -1_000_000 else 0.0] * own
        n_parts += own
    if not asked:
        return _named(begun, queries)
    longest = {lv: LEVEL ** (lv + 1) * (1 + 1e-9) if lv > -1_000_000 else 0.0 for lv, _, _ in ends}
    table = spark.createDataFrame([(lv, a, n, longest[lv], bisect.bisect_right(low, longest[lv])) for lv, a, n in ends], "level int, first int, n int, longest double, parts int")
    asking = spark.createDataFrame(asked, "need int, part int, own int")
    placed = rows.join(F.broadcast(table), "level").withColumn("bucket", bucket_of).where("bucket > 0 and parts > 0")
    reach = bounded.join(F.broadcast(asking), "need").select("row", "vec_id", "vec", "norm", "bound", (F.col("part") + dealt(F.col("own"))).alias("part"))
    reach = reach.join(F.broadcast(table), F.col("bound").isNull() | (F.col("norm") * F.col("longest") >= F.col("bound")))
    met = reach.select("row", "vec_id", "vec", "bound", "part", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("bucket")).where("bucket > 0")
    more = _met(placed.select("bucket", every(F.col("parts")).alias("part"), "row", "vec_id", "vec"), met, k)
    return _named(_top(begun.select("query_row", "vec_id", "score").union(more), k), queries)
