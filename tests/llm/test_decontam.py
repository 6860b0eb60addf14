import random

import pytest

from pixelweft.llm import decontam


def distance(item, window):
    """Least edit distance of item to a substring of window, by the textbook table."""
    row = [0] * (len(window) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(window, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_myers_is_the_table():
    r = random.Random(5)
    for _ in range(300):
        item = "".join(r.choices("abc ", k=r.randint(1, 90)))
        window = "".join(r.choices("abc ", k=r.randint(0, 120)))
        assert decontam.best_match(item, window)[0] == distance(item, window)


def edited(r, text, k):
    t = list(text)
    for _ in range(k):
        at = r.randrange(len(t))
        how = r.random()
        if how < 0.4:
            t[at] = "z"
        elif how < 0.7:
            del t[at]
        else:
            t.insert(at, "q")
    return "".join(t)


def test_no_passage_within_the_budget_is_lost():
    r = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    items = [(i, " ".join(r.choices(words, k=r.randint(5, 40)))) for i in range(20)]
    m = decontam.Matcher(items)
    for _ in range(40):
        i, item = r.choice(items)
        k = decontam.budget(decontam.normal(item))
        text = " ".join(r.choices(words, k=30)) + " " + edited(r, item, r.randint(0, k + 2)) + " " + " ".join(r.choices(words, k=30))
        want = {j: d for j, t in items if (d := distance(decontam.normal(t), decontam.normal(text))) <= decontam.budget(decontam.normal(t))}
        assert {j: d for j, d, _ in m.find(text)} == want


def test_case_punctuation_and_places():
    m = decontam.Matcher([(1, "Such a nice passage, of some length; really.")])
    assert m.find("xx SUCH!! A!! NICE!! PASSAGE,!! OF SOME\nLENGTH really yy") == [(1, 0, 1)]
    assert m.find("such a nice passage of some length really " * 3)[0][2] >= 1
    assert m.find("such a nice day") == [] == m.find(None) == m.find("")
    assert decontam.Matcher([(1, ""), (2, " ,.")]).find("text") == []


def test_tables(spark, sf_dir, odd_docs, no_docs):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    texts = {r.doc_id: decontam.normal(r.text) for r in docs.collect()}
    want = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if decontam.normal(r.text) in t}
    assert want and want <= got
    clean = decontam.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.select("doc_id").collect()} == set(texts) - {d for d, _ in got}
    hard = spark.createDataFrame([(7, "The quick brown fox jumps over the lazy dog"), (8, None), (None, "zzz"), (9, "")], "item_id long, text string")
    pairs = decontam.contaminated(odd_docs, hard).collect()
    assert sorted((r.doc_id, r.item_id) for r in pairs) == [(1, 7), (1, 7), (2, 7)]
    out = decontam.decontaminate(odd_docs, hard)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count() - 3
    assert decontam.contaminated(no_docs, hard).count() == 0 == decontam.decontaminate(no_docs, hard).count()
    assert decontam.contaminated(odd_docs, hard.limit(0)).count() == 0


def test_several_passes(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(decontam, "PASS_CHARS", 10)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["quick brown fox jumps", "lazy dog again", "nothing of the kind"])], "item_id long, text string")
    got = decontam.contaminated(odd_docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 0), (1, 0), (1, 1), (1, 1), (2, 0), (2, 1)]
    assert decontam.decontaminate(odd_docs, items, least_words=3).count() == odd_docs.count() - 3
    assert decontam.decontaminate(odd_docs, items, least_words=4).count() == odd_docs.count() - 3
    assert decontam.decontaminate(odd_docs, items).count() == odd_docs.count()


def test_short_items_match_whole_words(spark):
    m = decontam.Matcher([(1, "yes"), (2, "No."), (3, "forty-two")])
    assert m.find("His eyes were open; now") == [] and m.find("fortytwo") == []
    assert m.find("well, yes: forty two... no") == [(1, 0, 1), (2, 0, 1), (3, 0, 1)]
    docs = spark.createDataFrame([(1, "yes and no"), (2, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "and no")], "item_id long, text string")
    assert decontam.contaminated(docs, items).count() == 2
    assert decontam.decontaminate(docs, items).count() == 2


def test_templated_and_equal_items():
    """Items that share most of their text are found as surely, by what is their own; equal ones together."""
    r = random.Random(8)
    names = ["".join(r.choices("abcdefghijklmnop", k=9)) for _ in range(120)]
    frame = "which of the following statements about the city of {} is true when one asks the people who live close to {} and its river"
    items = [(i, frame.format(a, b)) for i, (a, b) in enumerate(zip(names[::2], names[1::2]))]
    m = decontam.Matcher([*items, (99, items[0][1].upper())])
    fan = [len(where) for piece in m.automaton for where in [m.automaton.get(piece)[1]]]
    assert sum(n > 10 for n in fan) < len(fan) / 3
    for i, item in items[:15]:
        text = "some words before " + edited(r, item, r.randint(0, 5)) + " and some after"
        want = {j: d for j, t in items if (d := distance(decontam.normal(t), decontam.normal(text))) <= decontam.budget(decontam.normal(t))}
        got = {j: d for j, d, _ in m.find(text)}
        assert (99 in got) == (0 in want) and {j: d for j, d in got.items() if j != 99} == want


@pytest.mark.parametrize("n", [1, 5, 39, 40, 400])
def test_pieces_cover(n):
    item = "x" * n
    k = decontam.budget(item)
    p = decontam.pieces(item, k + 1)
    assert len(p) == k + 1 and "".join(t for _, t in p) == item and all(t for _, t in p)
