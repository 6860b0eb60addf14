import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import zstandard as zstd

from pixelweft.llm import labelled, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


def held_out(scores, labels, label):
    rows = scores.join(labels, "doc_id").where("held_out").toPandas()
    assert len(rows) > 30
    return rows.assign(right=rows.predicted == rows[label])


def test_folds(tables):
    got = tables[0].select("doc_id", labelled.fold().alias("f")).toPandas()
    assert all(f == zlib.crc32(str(d).encode()) % 5 for d, f in zip(got.doc_id, got.f))
    s = labelled.sample(*tables, "quality", 20)
    assert (s.groupby("y").size() <= 20).all() and all(zlib.crc32(str(d).encode()) % 5 for d in s.doc_id)
    assert s.equals(labelled.sample(*tables, "quality", 20))


def test_sample_of_repeated_ids(spark):
    docs = spark.createDataFrame([(i, t) for i in range(1, 40) for t in ("b", None, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] * 2 + [(7, 0), (8, None)], "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", 50)
    assert got.doc_id.is_unique and set(got.text) == {""} and 7 not in set(got.doc_id)


def test_quality(tables):
    scores = quality.quality_scores(*tables)
    rows = held_out(scores, tables[1], "quality")
    assert rows.right.mean() > 0.93 and scores.count() == tables[0].count()
    kept = quality.keep_good(*tables)
    assert kept.columns == tables[0].columns
    assert kept.count() == scores.where("predicted = 1").count()


def test_quality_scores_are_those_of_plain_compression(tables):
    """End to end against a plain version: dictionaries, sizes piece by piece, and a curve found by gradient steps."""
    rows = labelled.sample(*tables, "quality", quality.SAMPLE)
    pieces = lambda t: [(t or "").encode()[a : a + 2048] for a in range(0, len((t or "").encode()), 2048)]
    first, rest = rows[::2], rows[1::2]
    coders = [zstd.ZstdCompressor(level=3, dict_data=zstd.train_dictionary(40_000, [p for t in first[first.y == y].text for p in pieces(t)]), write_checksum=False, write_content_size=False, write_dict_id=False) for y in (1, 0)]

    def measured(t):
        good, bad = (sum(len(c.compress(p)) for p in pieces(t)) for c in coders)
        n = len((t or "").encode())
        return [(bad - good) / (bad + good), min(bad, good) / n, np.log1p(n)] if n else [0, 0, 0]

    x, y = np.array([measured(t) for t in rest.text]), rest.y.to_numpy(float)
    mean, std = x.mean(0), x.std(0)
    a, w = np.c_[(x - mean) / std, np.ones(len(x))], np.zeros(4)
    for _ in range(60_000):
        w += 4 * a.T @ (y - 1 / (1 + np.exp(-a @ w))) / len(a)
    got = {r.doc_id: r.score for r in quality.quality_scores(*tables).collect()}
    texts = {r.doc_id: r.text for r in tables[0].collect()}
    want = {i: 1 / (1 + np.exp(-(np.r_[(np.array(measured(t)) - mean) / std, 1] @ w))) for i, t in texts.items()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 0.01


def test_toxicity(tables):
    scores = toxicity.toxicity_scores(*tables)
    rows = held_out(scores, tables[1], "toxic")
    assert rows.right.mean() > 0.93
    assert rows[rows.toxic == 1].score.mean() > rows[rows.toxic == 0].score.mean() + 0.3
    assert scores.where("score >= 0.5 and size(evidence) = 0").count() == 0


def test_nearest_are_exact():
    """Blocks opened from the highest bound down find what comparing with all examples finds."""
    r = np.random.default_rng(0)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]
    texts = [" ".join(r.choice(vocabulary, size=r.integers(3, 30))) + (" badword" if i % 3 == 0 else "") + (" worse" if i % 6 == 0 else "") for i in range(400)]
    y = np.array([i % 3 == 0 for i in range(400)], int)
    index = toxicity.ToxicityIndex(np.arange(400), texts, y)
    dense = np.zeros((400, len(index.number)))
    for i, (at, w) in enumerate(index.vectors):
        dense[i, at] = w
    for t in texts[:60] + ["badword", "worse badword badword", "", "none of these"]:
        at, w = index.vector(t)
        q = np.zeros(len(index.number))
        q[at] = w
        cos = dense @ q
        want = [(i, cos[i]) for i in np.lexsort((np.arange(400), -np.round(cos, 12)))[: toxicity.NEIGHBOURS] if cos[i] > 0]
        (got,) = index.nearest([(at, w)])
        assert [i for i, _ in got] == [i for i, _ in want] or np.allclose([c for _, c in got], [c for _, c in want])
        assert np.allclose([c for _, c in got], [c for _, c in want])


def plain_scores(texts, y, weight, queries, own):
    """Scores by dense TF-IDF over the whole vocabulary, one text after the other; returns the neighbours, too."""
    tf = [Counter(re.findall(r"[^\W\d_]+", t.lower())) for t in texts]
    df = Counter(w for c in tf for w in c)
    n, n1 = len(texts), int(sum(y))

    def chi(w):
        a = sum(1 for c, label in zip(tf, y) if label and w in c)
        b = df[w] - a
        table = np.array([[a, b], [n1 - a, n - n1 - b]], float)
        want = table.sum(1, keepdims=True) * table.sum(0) / n
        return ((table - want) ** 2 / want).sum() if (want > 0).all() else 0.0

    at = {w: i for i, w in enumerate(sorted(df))}
    idf = {w: (np.log((1 + n) / (1 + df[w])) + 1) * (1 + max(0, chi(w) / 4 - 1)) for w in df}

    def vector(c):
        v = np.zeros(len(at))
        for w, k in c.items():
            if w in at:
                v[at[w]] = (1 + np.log(k)) * idf[w]
        return v / (np.linalg.norm(v) or 1)

    examples = np.array([vector(c) for c in tf])

    def best(t, but):
        cos = np.round(examples @ vector(Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))), 12)
        if but >= 0:
            cos[but] = 0
        order = sorted((i for i in range(n) if cos[i] > 0), key=lambda i: -cos[i])
        return [(i, cos[i]) for i in order[: toxicity.NEIGHBOURS]], {i for i in range(n) if len(order) >= toxicity.NEIGHBOURS and cos[i] == cos[order[toxicity.NEIGHBOURS - 1]]}

    def votes(near):
        yes, total = sum(c for i, c in near if y[i]), sum(c for _, c in near)
        return [np.clip(sum((1 if y[i] else -1) * c**4 for i, c in near), -1, 1), yes / total if total else 0, np.log1p(yes), np.log1p(max(0, total - yes))]

    x = [votes(best(t, i)[0]) for i, t in enumerate(texts)] + [votes(best(t, -1)[0]) for t in texts]
    curve = labelled.fit_logistic(np.array(x), np.array([*y, *y], float), np.array([*weight, *weight]), l2=0.1)
    near = [best(t, b) for t, b in zip(queries, own)]
    return labelled.logistic(np.array([votes(a[0]) for a in near]), curve), near


def test_scores_are_those_of_dense_cosines(tables):
    """End to end against brute force over the whole vocabulary: neighbours, votes, prior, curve, and an example without itself."""
    rows = labelled.sample(*tables, "toxic", 90)
    assert set(rows.y) == {0, 1} and rows.weight.max() > 1
    texts, y, weight = rows.text.tolist(), rows.y.tolist(), rows.weight.tolist()
    others = tables[0].where("doc_id % 17 = 3").select("text").limit(60).toPandas().text.tolist()
    queries, ids = others + [None, "", "12 34"] + texts[:30], [None] * (len(others) + 3) + rows.doc_id.tolist()[:30]
    want, near = plain_scores(texts, y, weight, queries, [-1] * (len(others) + 3) + list(range(30)))
    got, evidence = toxicity.fit(rows).score(queries, ids)
    # equal cosines at the end of a list (copies of one example) may stand for each other
    assert np.mean(np.abs(got - want) < 1e-6) > 0.97
    id_of = rows.doc_id.tolist()
    for e, (found, ties) in zip(evidence, near):
        sure = {id_of[i] for i, _ in found if i not in ties}
        assert sure <= set(e)
    assert all(i not in e for i, e in zip(ids[-30:], evidence[-30:]))


def test_prior_is_that_of_all_labels(tables):
    """A sample with as many of either label gives lower scores, nearer to the share of toxic texts, once its rows weigh as all labelled rows are spread."""
    rows = labelled.sample(*tables, "toxic", 25)
    known = tables[0].join(tables[1].where("toxic in (0, 1)"), "doc_id").where(labelled.fold() == 0).select("text", "toxic").toPandas()
    mean = [toxicity.fit(r).score(known.text.tolist())[0].mean() for r in (rows, rows.assign(weight=1.0))]
    assert mean[0] < mean[1]
    assert abs(mean[0] - known.toxic.mean()) < abs(mean[1] - known.toxic.mean())


def test_all_words_count():
    """A text without any telling word has the neighbours that its rare words give it, and a copy of an example follows its label."""
    r = np.random.default_rng(1)
    rare = lambda i: [f"rare{''.join(chr(97 + int(d)) for d in str(i * 40 + j))}" for j in range(40)]
    texts = [" ".join([*rare(i), *r.choice(["the", "of", "and"], 9), *["idiot"] * (i % 3 == 0 and i != 30)]) for i in range(300)]
    index = toxicity.ToxicityIndex(np.arange(300) + 1000, texts, np.array([i % 3 == 0 for i in range(300)], int))
    assert len(index.number) == 300 * 40 + 4
    copies = [" ".join(rare(30)[3:] + ["unheard", "of"]), " ".join(rare(31)[3:] + ["unheard", "of"])]
    scores, near = index.score(copies)
    assert [n[0] for n in near] == [1030, 1031] and scores[0] > 0.5 > scores[1]


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (5, 1, 0), (7, 0, 1), (7, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for op in (quality.quality_scores, toxicity.toxicity_scores):
        rows = op(odd_docs, labels).collect()
        assert len(rows) == odd_docs.count()
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert op(no_docs, labels).count() == 0
        assert op(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert quality.keep_good(odd_docs, labels).columns == odd_docs.columns


def test_calibration_of_one_label():
    rows = pd.DataFrame({"doc_id": [1, 2], "text": ["a", "b"], "y": [1, 1], "weight": [1.0, 1.0]})
    assert 0.5 < quality.fit(rows).score(["x", None])[0] < 1
    assert toxicity.fit(rows).score([""])[0][0] > 0.5
