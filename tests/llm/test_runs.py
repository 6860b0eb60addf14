import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweft.llm import queries, runs


def brute(w):
    """(start, length, period) of every run, by looking at each period and place."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            u = w[i : j + q]
            if j > i and len(u) >= max(6, 4 * q) and not any(u[:-d] == u[d:] for d in range(1, q)):
                out.append((i, len(u), q))
            i = j + 1
    return sorted((s, m, q) for s, m, q in out)


def left(w, found):
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    return [x for i, x in enumerate(w) if i not in gone]


def periodic(r, n, k):
    w = [r.randrange(k) for _ in range(n)]
    for _ in range(r.randrange(3)):
        if n > 4:
            a, p, m = r.randrange(n), r.randrange(1, max(2, n // 4)), r.randrange(n)
            for i in range(a + p, min(n, a + m)):
                w[i] = w[i - p]
    return w


@pytest.mark.parametrize("span,core", [(1024, 16), (4, 1), (16, 2)])
def test_tiles_of_any_size(monkeypatch, span, core):
    """Fragments of tiles, stitched as the windows do it, are the runs of the whole."""
    monkeypatch.setattr(runs, "SPAN", span)
    monkeypatch.setattr(runs, "CORE", core)
    r = random.Random(span)
    for _ in range(300):
        w = periodic(r, r.randrange(120), r.choice([1, 2, 3, 5]))
        x, parts, got = np.array(w, np.int32), {}, []
        for p, first, a, b, t in runs.tiles(x):
            for q, s, e in runs.solve(t, p, a, b):
                parts.setdefault(q, set()).add((s + first, e + first))
        for q, found in parts.items():
            whole = []
            for s, e in sorted(found):
                if whole and s <= whole[-1][1] - q:
                    whole[-1][1] = max(whole[-1][1], e)
                else:
                    whole.append([s, e])
            got += [(s, e - s, q) for s, e in whole if e - s >= max(6, 4 * q)]
        assert sorted(got) == brute(w)
        assert runs.may_repeat(x) or not brute(w)


def test_against_brute_force(spark):
    r = random.Random(3)
    words = [periodic(r, r.randrange(150), r.choice([1, 2, 3, 40])) for _ in range(300)]
    long = [r.randrange(9) for _ in range(700)] * 9 + [3] * 2500 + list(range(4000)) * 5
    words += [long, [0] * 5, [0] * 6, [0, 1] * 4, [0, 1] * 3 + [0]]
    df = spark.createDataFrame([(i, " \n".join(map(str, w))) for i, w in enumerate(words)], "doc_id long, text string").repartition(7)
    for row in runs.period_runs(df).collect():
        w = words[row.doc_id]
        want = brute(w) if w is not long else [(0, 6300, 700), (6300, 2500, 1), (8800, 20_000, 4000)]
        got = [tuple(x) for x in row.runs]
        if w is long:  # some short ones lie in it by chance
            assert set(want) <= {x for x in got if x[1] > 2000} and len([x for x in got if x[1] > 2000]) == 3
        else:
            assert got == want, row.doc_id
        assert row.n_words == len(w)
        assert row.collapsed == " ".join(map(str, left(w, got)))


def test_many_periods_in_long_texts():
    """Work grows about in proportion to the text, periods or not."""
    for w in ([0] * 60_000, [i % 15_000 for i in range(60_000)], list(range(200_000))):
        x = np.array(w, np.int32)
        assert sum(len(runs.solve(t, p, a, b)) for p, _, a, b, t in runs.tiles(x)) < 200


def test_odd_rows(spark, odd_docs, no_docs):
    df = odd_docs.selectExpr("*", "1 AS runs", "2 AS uid", "3 AS period", "4 AS may", "5 AS found")
    df = df.unionByName(df.limit(1).withColumn("doc_id", F.lit(9).cast("long")).withColumn("text", F.lit("na " * 7)))
    rows = runs.period_runs(df).collect()
    assert len(rows) == df.count() and sum(r.doc_id == 1 for r in rows) == 2
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[4].n_words, by_id[4].runs, by_id[4].collapsed) == (0, [], "")
    assert (by_id[6].n_words, by_id[6].collapsed) == (0, "")
    assert [tuple(x) for x in by_id[9].runs] == [(0, 7, 1)] and by_id[9].collapsed == "na"
    assert by_id[7].collapsed == "naïve café ünïcode 日本語 😀 token: 'tok_123456'"
    assert runs.period_runs(no_docs).count() == 0
    assert {r.collapsed for r in runs.period_runs(df.where("doc_id = 9"), digest=True).collect()} == {hashlib.sha256(b"na").hexdigest()}


def test_texts_made_to_repeat(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 9 * 5))) for i in range(400)] + [(3, None), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for row in df.select("doc_id", "text", runs.repeated_from(F.col("doc_id"), F.col("text")).alias("new")).collect():
        w = (row.text or "").split()
        h = zlib.crc32(str(row.doc_id).encode()) if row.doc_id is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            assert row.new.split() == [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        else:
            assert row.new == row.text


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{Path(sf_dir) / 'documents.parquet'}'")
    want = con.execute(queries.ORACLE_SQL["op13_runs"])
    names = [c[0] for c in want.description]
    assert {tuple(r) for r in queries.op13_runs(spark, sf_dir).select(*names).collect()} == set(want.fetchall())
