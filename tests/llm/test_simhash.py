import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelweft.llm import components as graph
from pixelweft.llm import simhash
from pixelweft.llm.components import connected_components


def plain(text, n=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, budget=4):
    root = {f: f for f in set(fps)}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    u = sorted(root)
    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, f in zip(ids, fps):
        least[find(f)] = min(least.get(find(f), i), i)
    return [least[find(f)] for f in fps]


def test_fingerprints(spark, sf_dir):
    for text in (None, "", " \n", "one", "One two three", "a b c d", "A B C d e é É"):
        assert simhash.fingerprint(text) == plain(text)
    long = " ".join(str(i * 7919 % 1009) for i in range(simhash.PIECE + 70_000))
    assert simhash.fingerprint(long) == plain(long)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").toPandas().sort_values("doc_id")
    fps = [plain(t) for t in rows.text]
    want = dict(zip(rows.doc_id, zip((f"{f:016x}" for f in fps), components(rows.doc_id.tolist(), fps))))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == want


@pytest.mark.parametrize("block,budget,links,parts", [(8, 4, 2, 3), (1024, 4, 2, 3), (16, 8, 3, 4), (4096, 8, 3, 4)])
def test_links_lose_none(spark, block, budget, links, parts):
    """Dense groups, chains and pairs at every distance, with and without splitting of hot keys."""
    r = random.Random(3)
    fps = []
    for _ in range(12):
        base = r.getrandbits(64)
        for k in range(40):
            x = base
            for b in r.sample(range(64), r.randint(0, budget + 2)):
                x ^= 1 << b
            fps.append(x)
    chain = r.getrandbits(64)
    for b in range(0, 64, 4):
        chain ^= 0xF << b
        fps.append(chain)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash._signed(f), 0) for f in fps], "fp long, guard long")
    ring = simhash.Ring(budget, links, parts)
    got = {x.node: x.root for x in connected_components(simhash.links(df, ring, block)).collect()}
    want = components(fps, fps, budget)
    mine = [got.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    # the same partition of the nodes
    assert len(set(zip(want, mine))) == len(set(want)) == len(set(mine))


@pytest.mark.parametrize("ring", [simhash.STRICT, simhash.Ring(8, links=3, parts=4), simhash.Ring(6, links=4, parts=6)])
def test_every_pair_within_the_budget_meets(ring):
    r = random.Random(1)
    none = np.zeros(2, np.uint64)
    for _ in range(3000):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), r.randint(0, ring.budget)):
            b ^= 1 << k
        pair = np.array([a, b], dtype=np.uint64)
        assert any(a & m == b & m and simhash.forest(pair, none, s, ring) for s, m in ring.keys)
    far = np.array([0, (1 << ring.budget + 1) - 1], dtype=np.uint64)
    assert not any(simhash.forest(far, none, s, ring) for s in range(ring.budget + 1))


def similarity(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (simhash.split(a), simhash.split(b)))
    return len(x & y) / len(x | y)


def test_near_dedup_finds_similar_texts(spark):
    """Of copies with changed words, those of a similarity of 0.8 or more go; texts of other words stay."""
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(900)]
    rows, near = [], []
    for i in range(150):
        words = [vocabulary[int(899 * r.random() ** 2)] for _ in range(r.randint(60, 500))]
        rows.append((10 * i, " ".join(words)))
        for j in range(1, 4):
            copy = list(words)
            for at in r.sample(range(len(copy)), max(1, len(copy) * j // 130)):
                copy[at] = r.choice(vocabulary)
            rows.append((10 * i + j, " ".join(copy)))
            if similarity(rows[-1][1], " ".join(words)) >= 0.8:
                near.append(rows[-1][0])
    kept = {x.doc_id for x in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert {10 * i for i in range(150)} <= kept
    assert len(near) > 200 and len([i for i in near if i not in kept]) >= 0.97 * len(near)


@pytest.mark.parametrize("ring,block,seed", [(simhash.LOOSE, 4096, 1), (simhash.LOOSE, 20, 2), (simhash.Ring(20, links=2, parts=2, guard=32), 4096, 3), (simhash.Ring(20, links=2, parts=2, guard=32), 50, 4)])
def test_near_dedup_links_by_shingles(spark, ring, block, seed):
    """Among texts that fingerprints link in one dense group, those of 0.8 or more are found by brute force; forests hide none."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(400)]
    base = [r.choice(vocabulary) for _ in range(150)]
    texts = []
    for _ in range(9):  # a family keeps some changes of base, its members change a word or two more
        family = list(base)
        for at in r.sample(range(150), r.randint(2, 5)):
            family[at] = r.choice(vocabulary)
        for _ in range(10):
            words = list(family)
            for at in r.sample(range(150), r.randint(0, 2)):
                words[at] = r.choice(vocabulary)
            texts.append(" ".join(words))
    texts += ["", "a b c", "a b c d", " A b  c"]
    prints = [[int(x) for x in simhash.loose_prints(t)] for t in texts]
    first, pairs, refused = list(range(len(texts))), [], 0
    for i, (a, x) in enumerate(prints):
        for j, (b, y) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= ring.budget and (x ^ y).bit_count() <= ring.guard:
                alike = (a, x) == (b, y) or bool(texts[i] and texts[j]) and similarity(texts[i], texts[j]) >= 0.8
                pairs += [(i, j)] * alike
                refused += not alike
    for _ in texts:
        for i, j in pairs:
            first[i] = first[j] = min(first[i], first[j])
    assert refused
    kept = {x.doc_id for x in simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ring=ring, block=block).collect()}
    assert kept == set(first)


def test_near_dedup_of_one_id_and_none(spark):
    """Texts that share an id, or have none, are judged by their own components."""
    a, b, c = ("one two three four five six seven eight", "alpha beta gamma delta epsilon zeta eta theta", "red green blue cyan black white grey pink")
    rows = [(3, a), (5, a), (5, b), (None, c), (None, b), (7, c + " "), (None, "x y z"), (None, "p q r"), (9, "twice"), (9, "twice"), (None, "x y z")]
    kept = [(x.doc_id, x.text) for x in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([(3, a), (5, b), (7, c + " "), (None, "x y z"), (None, "p q r"), (9, "twice")], key=str)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.simhash_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == 1
    assert by[3].component_id == by[4].component_id == by[6].component_id == 3
    assert by[3].fingerprint == "0" * 16
    assert by[None].component_id is None
    assert simhash.simhash_components(no_docs).count() == 0


def test_near_dedup_keeps_one(spark, odd_docs, no_docs):
    kept = simhash.near_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(kept.select(F.coalesce("doc_id", F.lit(-1))).toPandas().iloc[:, 0])
    assert ids == [-1, 1, 3, 5, 7]
    assert simhash.near_dedup(no_docs).count() == 0


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 5), (9, 8), (None, 4), (8, 9)], "a long, b long")
    assert {r.node: r.root for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert connected_components(edges.limit(0)).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(120)], "a long, b long")
    assert {r.root for r in connected_components(path).collect()} == {0}


@pytest.mark.parametrize("held", [3, 50, graph.HELD])
def test_components_by_brute_force(spark, held):
    """Trees, cycles, hubs, chains and pairs over ids of both signs, however many edges a task looks at together."""
    r = random.Random(held)
    ids = [r.getrandbits(64) - (1 << 63) for _ in range(400)]
    edges = [(ids[0], x) for x in ids[1:60]] + list(zip(ids[60:200], ids[61:200])) + [(r.choice(ids[200:300]), r.choice(ids[200:300])) for _ in range(110)]
    edges += list(zip(ids[300::2], ids[301::2])) + [(ids[7], ids[7])]
    edges += [(b, a) for a, b in edges[::3]]
    r.shuffle(edges)
    root = {x: x for x in ids}
    for _ in ids:
        if not any([root.update({a: low, b: low}) or True for a, b in edges if root[a] != root[b] and (low := min(root[a], root[b])) is not None]):
            break
    want = {x: root[x] for x in {x for a, b in edges if a != b for x in (a, b)}}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), held).collect()
    assert len(got) == len(want) and {x.node: x.root for x in got} == want


def test_components_take_few_rounds(spark, monkeypatch):
    """Every table that is kept costs the driver some jobs, so long chains and many nodes must not take many of them."""
    kept, keep = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: kept.append(1) or keep(df))
    edges = spark.range(0, 20_000, numPartitions=4).selectExpr("id AS a", "id + 1 AS b").where("b % 1000 <> 0")
    found = connected_components(edges)
    assert found.groupBy("root").count().where("count = 1000").count() == 20
    assert len(kept) <= 10


def test_links_between_parts_are_not_all_pairs(spark):
    """Texts around one other: sketches rule out nearly all pairs that are not similar, and none that is."""
    r = random.Random(8)
    sets = []
    for base in (60, 300):
        center = r.sample(range(1 << 62), base)
        sets += [center] + [r.sample(center, base - base // 12) + r.sample(range(1 << 62), base // 12) for _ in range(150)]
    rows = [(i, sorted(x)) for i, x in enumerate(sets)] + [(len(sets), [])]
    fps = simhash.sketched(spark.createDataFrame(rows, "node long, shingles array<long>")).selectExpr("node AS fp", "0L AS guard", "node AS part", "size", *[f"s{i}" for i in range(simhash.SKETCH)])
    ring = simhash.Ring(20, links=2, parts=2, guard=32)
    number = {x.node: x.fp for x in fps.select("fp", simhash.node(F.col("fp"), F.col("guard"), ring).alias("node")).collect()}
    got = simhash.links(fps, ring, percent=80).distinct().collect()
    got = {frozenset((number[a], number[b])) for a, b in got}
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    want = {frozenset((i, j)) for i, j in pairs if len(set(sets[i]) & set(sets[j])) * 180 >= 80 * (len(sets[i]) + len(sets[j]))}
    assert want <= got and len(want) >= 300
    assert len(got) <= 0.05 * len(pairs)


def test_near_copies_are_not_all_pairs(spark, monkeypatch):
    """A large group of near copies, about half of whose pairs are similar: no table on the way holds the pairs, and the whole group goes."""
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(5000)]
    base, texts = [r.choice(vocabulary) for _ in range(200)], []
    for _ in range(500):
        words = list(base)
        for at in r.sample(range(200), r.randint(1, 4)):
            words[at] = r.choice(vocabulary)
        texts.append(" ".join(words))
    made, keep, connect = [], simhash.checkpointed, simhash.connected_components

    def kept(df):
        made.append((df := keep(df)).count())
        return df

    def connected(edges):
        made.append(edges.count())
        return connect(edges)

    monkeypatch.setattr(simhash, "checkpointed", kept)
    monkeypatch.setattr(simhash, "connected_components", connected)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.doc_id for x in simhash.near_dedup(docs).collect()] == [0]
    assert max(made) <= len(simhash.LOOSE.keys) * len(texts)


@pytest.mark.parametrize("block,shingles", [(4096, 1 << 20), (4096, 700), (7, 1 << 20), (1, 1 << 20)])
def test_similar_links_by_brute_force(spark, block, shingles):
    """Components that are one group, those of several blocks and those that are dealt out by keys: every link between similar sets is connected, by few rows."""
    r = random.Random(9)
    rows, ring = [], simhash.LOOSE
    for component in range(3):
        fp, guard, center = r.getrandbits(64), r.getrandbits(64), r.sample(range(1 << 62), 40)
        for _ in range(58):
            flip = lambda x, most: x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, most)))
            one = r.sample(center, 40 - (n := r.randint(0, 6))) + r.sample(range(1 << 62), n)
            rows.append((simhash._signed(flip(fp, 6)), simhash._signed(flip(guard, 11)), component, sorted(one)))
    rows += [(simhash._signed(fp ^ 1 << i), simhash._signed(guard), 2, []) for i in range(2)]
    sets = spark.createDataFrame(rows, "fp long, guard long, component long, shingles array<long>")
    number = {x.node: x.fp for x in sets.select("fp", simhash.node(F.col("fp"), F.col("guard"), ring).alias("node")).collect()}
    got = [(number[a], number[b]) for a, b in simhash.similar_links(sets, ring, block, 80, shingles).collect()]
    want = []
    for i, x in enumerate(rows):
        for y in rows[:i]:
            apart = [((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x[:2], y[:2])]
            if x[2] == y[2] and apart[0] <= ring.budget and apart[1] <= ring.guard and len(set(x[3]) & set(y[3])) * 180 >= 80 * (len(x[3]) + len(y[3])):
                want.append((x[0], y[0]))

    def roots(edges):
        root = {x[0]: x[0] for x in rows}
        for _ in rows:
            before = dict(root)
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
            if root == before:
                return root

    assert set(map(frozenset, got)) <= set(map(frozenset, want)) and roots(got) == roots(want)
    assert len(set(roots(want).values())) > 10
    if block > len(rows) and shingles > 100_000:
        assert len(got) < len(rows) < len(want)
