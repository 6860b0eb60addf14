from pathlib import Path

import duckdb
import numpy as np
import pytest

from pixelweft.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, negatives_=10, low=30, high=90, every=100):
    held = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, v, y) in enumerate(held):
        if i % every:
            continue
        met = [(-sum(a * b for a, b in zip(v, w)), j, z) for k, (j, w, z) in enumerate(held) if k != at and len(w) == len(v)]
        for s, j, _ in sorted(m for m in met if m[2] == y)[:positives]:
            window = sorted(m for m in met if m[2] != y and low * -s <= 100 * -m[0] <= high * -s)[:negatives_]
            out += [(i, j, n, m[1], -s, -m[0]) for n, m in enumerate(window, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("size,part,slice_", [(1.0, 16_384, 16_384), (1.0, 3, 50), (1e4, 16_384, 200), (1e6, 20, 200)])
def test_against_brute_force(spark, size, part, slice_):
    """Fields of doubles and of whole numbers of any width, near copies, ties, repeated rows, a label of a third of all rows."""
    r = np.random.default_rng(int(size))
    rows = []
    for i in range(500):
        v = (np.abs(r.normal(size=9)) * size * 0.3 if i % 2 else r.normal(size=9) * size * 0.3).tolist()
        if i % 5 == 4:
            v = rows[-1][1]
        rows.append((i, v, 0 if i % 3 == 0 else int(r.integers(6))))
    rows += rows[:40] + [(10, rows[10][1], 3), (20, rows[10][1], 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(negatives.hard_negatives(df, anchor_every=10, part=part, slice_=slice_)) == brute(rows, every=10)


@pytest.mark.parametrize("low,high", [(-3, 5), (0, 0), (0, 7), (-9, -2), (-200, 311), (-(2**28), 2**28), (0, 2**29)])
def test_packed_products_are_exact(low, high):
    r = np.random.default_rng(7)
    p = negatives.Packing(17, low, high)
    x, a = (r.integers(low, high, (n, 17), endpoint=True).astype(float) for n in (37, 5))
    x[0], a[0], x[1] = high, high, low  # the largest sums
    got = p.products(p.shifted(a), p.words(x), p.exact(a), p.exact(x).sum(axis=1))
    want = [[sum(int(i) * int(j) for i, j in zip(u, v)) for v in x] for u in a]
    assert got.tolist() == want
    assert p.fields >= 2


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (100, None, 1), (200, [nan, 1.0], 1), (300, [None, 1.0], 1), (400, [inf, 1.0], 1), (500, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (600, [], 1), (601, [], 2), (700, [1.0], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.25], 2), (2, [0.5, 0.25], 2), (3, [0.5, 0.25], 3), (4, [-1.0, 0.0], 1), (-100, [0.0, 0.0], 2), (5, [0.0, 0.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row", "2 AS d", "3 AS vec", "4 AS score", "5 AS rank", "6 AS part", "7 AS norm")
    got = rows_of(negatives.hard_negatives(df))
    assert got == brute(rows)
    assert len([g for g in got if g[0] == 0]) and {g[3] for g in got if g[0] == 0} == {2, 3}
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{Path(sf_dir) / 'embeddings.parquet'}'")
    want = con.execute(queries.ORACLE_SQL["op11_hard_negatives"])
    names = [c[0] for c in want.description]
    got = sorted(tuple(r) for r in queries.op11_hard_negatives(spark, sf_dir).select(*names).collect())
    assert got == sorted(want.fetchall()) and got
