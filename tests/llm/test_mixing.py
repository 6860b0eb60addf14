import re

from pyspark.sql import functions as F

from pixelweft.llm import mixing


def plain_targets(sizes, share=1.5, ceiling=2.0):
    """Share by weight, cap, and share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total, over = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * weight[s] / total
            if target[s] >= ceiling * sizes[s]:
                over += target[s] - ceiling * sizes[s]
                target[s] = ceiling * sizes[s]
                open_.discard(s)
        left = over
    return target


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()}
    sizes = {}
    for s, n in rows.values():
        sizes[s] = sizes.get(s, 0) + n
    want = plain_targets(sizes)
    got = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    taken, largest = {}, {}
    for r in got:
        assert (r.source, r.size) == rows[r.doc_id] and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) <= 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)


def test_levels_reruns_and_hot_source(spark):
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    one = mixing.mix(rows, group=16).toPandas().sort_values("doc_id").reset_index(drop=True)
    two = mixing.mix(rows.repartition(7), group=16).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert one.equals(two) and len(one) == 9000
    by = one.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "max"))
    assert ((by.taken - by.target).abs() <= by["size"] / 2 + 1).all()


def test_expectation_is_kept(spark):
    rows = spark.createDataFrame([(i, "w " * (5 if i % 2 else 50), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    total = {}
    for seed in range(3):
        for r in mixing.mix(rows, weights=(1.0, 3.0), share=1.0, seed=seed).collect():
            total.setdefault(r.source, []).append(r.taken / r.size)
    for s, v in total.items():
        r = next(x for x in mixing.mix(rows, weights=(1.0, 3.0), share=1.0).collect() if x.source == s)
        assert abs(sum(v) / len(v) - r.target / r.source_size) < 0.08


def test_odd_rows(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert {r.size for r in got if r.doc_id in (3, 4, 6)} == {0}
    assert mixing.mix(no_docs).count() == 0
    empty = no_docs.sparkSession.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(empty).collect()] == [(0.0, 0)] * 2


def test_rows_that_are_alike_never_meet_in_one_group(spark, monkeypatch):
    """A third of all rows alike, by repeated rows and by missing ids: counted, not collected, and their words come near the target."""
    monkeypatch.setattr(mixing, "SPREAD", 700)
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, None).otherwise(F.col("id")).alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 4 + 1).cast("int")).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    got = mixing.mix(rows).toPandas()
    assert len(got) == 9000 and mixing.mix(rows).toPandas().equals(got)
    assert sorted(got[["doc_id", "source", "size"]].fillna(-1).itertuples(index=False)) == sorted((float(-1 if r.doc_id is None else r.doc_id), r.source, len(r.text.split())) for r in rows.collect())
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "max"))
    assert ((by.taken - by.target).abs() <= by["size"] / 2 + 1).all()
    assert (got.taken <= 2 * got["size"]).all() and set(got[(got.doc_id == 5) & (got["size"] == 7) & (got.source == "b")].taken) == {7, 14}
