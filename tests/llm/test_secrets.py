import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pixelweft.llm import secrets

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()


def test_base_spans(spark, sf_dir):
    hard = ["secret=token:abcdefghij", "PASSWORD = 'hunter22'", "api_key:==abc==", "x" * 10 + "AKIA" + "A1" * 12 + " AKIAshort", "0" * 23, "0" * 24 + "g" + "deadbeef" * 4, "😀 token: \"日本\" token=😀abcdef apikey='a.b/c+d=e-f_g'", "passwd=\npasswd=123456"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.union(spark.createDataFrame([(10_000 + i, t, "s") for i, t in enumerate(hard)], docs.schema))
    want = {r.doc_id: base(r.text) for r in docs.collect()}
    got = secrets.secret_scan(docs).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in w) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == digest(w)
        assert {f"{k}:{a}:{b}" for a, _, k, b in w} <= set(filter(None, r.spans.split(",")))


def test_ownership_tells_examples_from_own(spark):
    rows = [(i, "use password = examplepass1 here", f"s{i % 4}") for i in range(40)] + [(100, "password = onlymine99", "s1"), (101, "token: onlymine99", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.secret_scan(docs).collect()}
    assert all((got[i].n_live, got[i].n_shared) == (0, 1) for i in range(40))
    assert (got[100].n_live, got[101].n_live) == (1, 1)
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[100] == "password = [SECRET]" and clean[0] == rows[0][1]
    counts = {r.n_owners: r for r in secrets.verdicts(secrets.scanned(docs)).collect()}
    assert (counts[4].n_repositories, counts[4].n_rows, counts[1].n_repositories) == (40, 40, 2)


def test_odd_rows(spark, odd_docs, no_docs):
    got = secrets.secret_scan(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[4].base_sha256 == by[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[None].n_assign == by[7].n_assign == 1
    assert secrets.secret_scan(no_docs).count() == 0
    assert secrets.redact(odd_docs, most=0).count() == odd_docs.count()
    out = secrets.redact(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert secrets.redact(no_docs).count() == 0


def test_repeated_rows_keep_their_counts(spark):
    docs = spark.createDataFrame([(1, "token = abcdef1 token = ghijkl2", "s")] * 3, "doc_id long, text string, source string")
    assert [(r.n_assign, r.n_live) for r in secrets.secret_scan(docs).collect()] == [(2, 2)] * 3


def test_only_the_values_of_spans_are_masked(spark):
    hexes = "0123456789abcdef" * 2
    rows = [
        (1, "common words, token=common, é common", "s"),
        (2, f"é password: '{hexes}' and api_key={hexes}Z.", "s"),
        (2, "another text with passwd = abcdef99", "s"),
        (3, None, "s"),
        (None, "secret=nobody77 secret=nobody77", "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.text or "" for r in secrets.redact(docs).collect()))
    assert got == sorted(r.text or "" for r in secrets.redact(docs, most=0).collect())
    assert got == sorted(["common words, token=[SECRET], é common", "é password: '[SECRET]' and api_key=[SECRET]", "another text with passwd = [SECRET]", "", "secret=[SECRET] secret=[SECRET]"])


def test_private_keys_are_told_apart_and_masked(spark):
    """Keys are counted by their bodies, not by the begin line that all of them share, and a body is masked whole."""
    r = random.Random(5)
    lines = lambda n: ["".join(r.choices("ABCDEFGHabcdefgh0123456789+/", k=64)) for _ in range(n)] + ["Zm9vYmFy=="]
    block = lambda body, sep="\n", kind="RSA ", more="": f"-----BEGIN {kind}PRIVATE KEY-----{sep}{more}{sep.join(body)}{sep}-----END {kind}PRIVATE KEY-----"
    own = [lines(20) for _ in range(8)]
    shared = lines(3)
    rows = [(i, f"é key: {block(own[i])} end", f"s{i}") for i in range(4)]
    rows += [(4, f'"{block(own[4], chr(92) + "n", "")}"', "s4"), (5, block(own[5], "\r\n", "EC ", "Proc-Type: 4,ENCRYPTED\r\nDEK-Info: AES-128-CBC,0123456789ABCDEF\r\n\r\n"), "s5"), (6, block(own[6]).split("-----END")[0] + "that was it", "s6")]
    rows += [(7, "a file begins with -----BEGIN PRIVATE KEY----- and has lines, no more.", "s7"), (8, block(own[7]) + block(own[0]), "s8")]
    rows += [(20 + i, block(shared, ["\n", "\r\n", "\n  "][i]), f"s{i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in secrets.secret_scan(docs).collect()}
    pem = {i: sum(k.startswith("pem:") for k in x.spans.split(",")) for i, x in got.items()}
    assert pem == {i: {7: 0, 8: 2}.get(i, 1) for i, _, _ in rows}
    assert [(got[i].n_live, got[i].n_shared) for i in (0, 1, 4, 5, 6, 8)] == [(1, 0)] * 5 + [(2, 0)]
    assert [(got[i].n_live, got[i].n_shared) for i in (20, 21, 22)] == [(0, 1)] * 3
    assert f"pem:7:{len(rows[0][1]) - 4}" in got[0].spans
    clean = {x.doc_id: x.text for x in secrets.redact(docs).collect()}
    assert clean[0] == "é key: -----BEGIN RSA PRIVATE KEY-----\n[SECRET]-----END RSA PRIVATE KEY----- end"
    assert not any(line in clean[i] for i in range(9) for body in own for line in body)
    assert clean[6] == "-----BEGIN RSA PRIVATE KEY-----\n[SECRET]\nthat was it"
    assert all(clean[i] == t for i, t, _ in rows if i == 7 or i >= 20)


def test_long_key_like_texts(spark):
    """A begin line before much text neither fails nor takes prose along."""
    many = "-----BEGIN PRIVATE KEY-----\n" + "abcdefghijklmnopqrstuvwx yz " * 20_000
    docs = spark.createDataFrame([(1, many, "s"), (2, "-----BEGIN PRIVATE KEY-----\n" + "QUJD" * 100_000 + "\n-----END PRIVATE KEY-----", "s")], "doc_id long, text string, source string")
    assert {x.doc_id: x.text for x in secrets.redact(docs).collect()}[2] == "-----BEGIN PRIVATE KEY-----\n[SECRET]-----END PRIVATE KEY-----"


def test_other_texts_with_one_id_keep_their_own_counts(spark):
    rows = [(i, "token=examplepass1", f"s{i}") for i in range(3)] + [(None, "token=examplepass1", "s1"), (None, "token=examplepass2", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted((r.n_live, r.n_shared) for r in secrets.secret_scan(docs).where("doc_id is null").collect()) == [(0, 1), (1, 0)]


def test_copies_of_one_owner_and_order_of_ownership(spark):
    """Many documents make a value an example even where one owner has them all; the counts stand in the order of the spans."""
    rows = [(i, "token=examplepass1", "s") for i in range(secrets.SHARED_REPOSITORIES)] + [(100, "token=examplepass1 password=mineonly7", "t"), (101, "secret=mineonly7", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.secret_scan(docs).collect()}
    assert (got[0].n_live, got[0].n_shared) == (0, 1)
    assert (got[100].n_live, got[100].n_shared, got[100].ownership) == (1, 1, f"2/{len(rows) - 1},1/2")


def test_tokens_stand_alone(spark):
    jwt = "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK"
    docs = spark.createDataFrame([(1, f"é {jwt} {jwt},x{jwt}", "s"), (2, jwt, "s")], "doc_id long, text string, source string")
    got = {r.doc_id: r.spans for r in secrets.secret_scan(docs).collect()}
    assert got == {1: f"jwt:2:{2 + len(jwt)},jwt:{3 + len(jwt)}:{3 + 2 * len(jwt)}", 2: f"jwt:0:{len(jwt)}"}
    assert {r.text for r in secrets.redact(docs).collect()} == {f"é [SECRET] [SECRET],x{jwt}", "[SECRET]"}


def test_time_grows_in_proportion_to_the_text(spark):
    """A megabyte each of what used to be quadratic: many spans, long runs that begin like a token, a begin line before words."""
    r = random.Random(2)
    many = " ".join(f"{r.getrandbits(128):032x}" for _ in range(32_000))
    rows = [(1, many), (2, "eyJabcdef" * 120_000), (3, "-eyJabcdef" * 100_000), (4, "-----BEGIN PRIVATE KEY-----" + "n " * 500_000), (5, "password" * 130_000), (6, "token=" + " " * 1_000_000)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    began = time.time()
    got = {x.doc_id: x for x in secrets.secret_scan(docs).collect()}
    clean = {x.doc_id: x.text for x in secrets.redact(docs).collect()}
    assert time.time() - began < 60
    assert got[1].n_hex == got[1].n_live == 32_000
    assert got[1].spans.split(",")[-1] == f"hex:{len(many) - 32}:{len(many)}"
    assert clean[1] == " ".join(["[SECRET]"] * 32_000)
    assert all(clean[i] == t for i, t in rows if i != 1)


HOSTILE = {
    "assign": ["password" * 130_000, "token=" + " " * 1_000_000, "secret\" : " * 80_000, "api_key = '" * 90_000, "password=" + "=" * 1_000_000],
    "access": ["AKIA" * 250_000, "AKIAA" * 200_000 + "!", "AKIA0123456789ABCDE " * 50_000],
    "hex": ["0123456789abcdef0123456 " * 40_000, "a" * 1_000_000, "abcdefg" * 140_000],
    "pat": ["ghp_" * 250_000, "gho_abc " * 120_000, "ghp_" + "a_" * 500_000],
    "jwt": ["eyJabcdef" * 120_000, "-eyJabcdef" * 100_000, "eyJabcdefgh.eyJ" * 70_000, ("." + "eyJaaaaaaaa") * 90_000],
    "pem": [
        "-----BEGIN PRIVATE KEY-----" + "A: !" * 28,
        "-----BEGIN RSA PRIVATE KEY----- " + "Name: Host: Port: User: Path: " * 9 + "<missing>",
        "-----BEGIN PRIVATE KEY-----" + "A: !" * 250_000,
        "-----BEGIN RSA PRIVATE KEY----- " + "Name: Host: Port: " * 60_000 + "<missing>",
        "-----BEGIN PRIVATE KEY-----" + "\nA: b" * 200_000,
        "-----BEGIN PRIVATE KEY-----" + "n " * 500_000,
        "-----BEGIN PRIVATE KEY-----" + "n" * 1_000_000,
        "-----BEGIN PRIVATE KEY-----" + "\\n" * 300_000 + "+" * 300_000,
        "-----BEGIN PRIVATE KEY-----\n" * 35_000,
        "-----BEGIN " + "PRIVATE KEY " * 80_000,
        "-----BEGIN PRIVATE KEY-----\n" + ("a" * 16 + " ") * 60_000 + "-----END " + "PRIVATE KEY" * 1000,
    ],
}


@pytest.mark.parametrize("kind", sorted(HOSTILE))
def test_hostile_lines(spark, kind):
    """No line of any kind holds a task up: a megabyte of it takes seconds, a short one none that can be told."""
    texts = HOSTILE[kind]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).repartition(len(texts))
    secrets.secret_scan(docs.limit(1)).collect()
    began = time.time()
    assert secrets.secret_scan(docs).count() == len(texts)
    assert time.time() - began < 30


def test_headers_of_a_key_in_one_line(spark):
    body = "QUJD" * 16
    rows = [f"-----BEGIN RSA PRIVATE KEY-----{sep}Proc-Type: 4,ENCRYPTED{sep}DEK-Info: AES-128-CBC,0A1B{sep}{sep}{body}{sep}{body}{sep}-----END RSA PRIVATE KEY-----{tail}" for sep in ("\n", " ", "\\n", "\r\n") for tail in ("", "\n", " and more\n")]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("source", F.lit("s"))
    got = {r.doc_id: r.text for r in secrets.redact(docs, shared_owners=9, shared_repositories=99).collect()}
    assert all("QUJD" not in got[i] and got[i].startswith("-----BEGIN RSA PRIVATE KEY-----") for i in range(len(rows)))
