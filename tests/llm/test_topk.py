import duckdb
import numpy as np
import pandas as pd
import pytest

from pixelweft.llm import queries, topk


def brute(rows, k=5, every=50):
    """Every query row against every other row; repeated rows count as often as they stand there."""
    q = [(i, np.floor(256 * np.array(v, dtype=float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(q):
        if i % every == 0:
            scores = sorted((-int(v @ w), j) for n, (j, w) in enumerate(q) if n != at and len(w) == len(v))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("bucket,part", [(16_384, 16_384), (40, 5)])
def test_against_brute_force(spark, monkeypatch, bucket, part):
    """Lengths over five orders, near copies (high cosines, so coordinates prune), ties and opposite vectors."""
    monkeypatch.setattr(topk, "PART", part)
    r = np.random.default_rng(4)
    vectors = []
    for i in range(600):
        v = r.normal(size=12) * 10 ** r.uniform(-2, 3)
        if i % 3 == 1:
            v = np.array(vectors[-1][1]) * r.uniform(0.9, 1.1) + r.normal(size=12) * 1e-3
        if i % 7 == 6:
            v = np.array(vectors[-1][1])
        vectors.append((i, [float(x) for x in v]))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert rows_of(topk.top_k(df, bucket=bucket, query_every=10)) == brute(vectors, every=10)


def test_coordinate_and_length_pruning_agree():
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(300, 8)) * 50)
    x[100:160] = x[0] + np.round(r.normal(size=(60, 8)))
    b = topk.Bucket(np.arange(300), np.arange(300), x)
    for i in (0, 5, 100):
        s = x @ x[i]
        order = np.lexsort((np.arange(300), -s))
        want = [(i, int(j), int(s[j])) for j in order if j != i][:5]
        for bound in (-np.inf, float(want[-1][2])):
            got = b.search(np.array([i]), x[i : i + 1], np.array([bound]), 5)
            assert sorted(got) == sorted(want)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, None), (100, [float("nan"), 1.0]), (150, [None, 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, [float("inf"), 0.0]), (5, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (200, [0.0, 0.0]), (-50, [-1.0, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS bucket", "2 AS vec", "3 AS score")
    assert rows_of(topk.top_k(df)) == brute(rows)
    assert topk.top_k(df.limit(0)).count() == 0


def test_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert rows_of(topk.top_k(df)) == brute([(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("bucket", [16_384, 3])
def test_repeated_rows_all_count(spark, bucket):
    """Rows of one id, equal or not, equal only after rounding, and repeated queries: as by hand, by brute force and by the SQL."""
    rows = [(50, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r[2] for r in rows_of(topk.top_k(df, bucket=bucket))] == [1, 1, 2]
    rows += [(1, [float(i), 1.0]) for i in range(8)] + [(2, [9.0, 0.0])] * 2 + [(3, [7.0001, 0.0]), (3, [7.0002, 0.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0]), (100, [2.0, -1.0]), (50, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = rows_of(topk.top_k(df, bucket=bucket))
    assert got == brute(rows)
    con = duckdb.connect()
    con.register("embeddings", pd.DataFrame(rows, columns=["vec_id", "embedding"]))
    assert got == sorted(con.execute(queries.ORACLE_SQL["op8_topk"]).fetchall())
