"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Spans come from two built-ins: the matches of a pattern (regexp_extract_all) and
the text between them (split), whose lengths add up to the positions. Each
candidate value is hashed; for every hash the distinct owners (source) and
repositories (document) are counted after one row for each hash, owner and
repository is left of each task. Values seen under SHARED_OWNERS owners or more,
or in SHARED_REPOSITORIES documents or more, are widely copied examples, the others
are live-looking credentials of an owner. Work in a text grows in proportion to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpointed, text_key, wrapped


@dataclass(frozen=True)
class Kind:
    """A pattern, the group of its value and the value's least length; lead is a group before the span, head one between its start and the value."""

    pattern: str
    value: int
    least: int
    lead: int = 0
    head: int = 0
    #: What the value has to be without to be told from others.
    between: str = ""


#: A key block: the begin line and headers (group 1), the key's characters (group 2), the end line; without an end line up to the last line of base64.
#: Headers stand after breaks, one a line or (in a text of one line) of one word each. Nothing that has been read is read in another way again, so a text of any kind takes time in proportion.
_BREAK = r"(?:\s|\\+[nrt])"
_RUN = r"[A-Za-z0-9+/=]"
PEM = (
    rf"(-----BEGIN [A-Z ]*+(?<=PRIVATE KEY)-----(?>{_BREAK}{{1,9}}+[A-Z][A-Za-z-]{{0,30}}+: (?>(?:(?!-----)[^\r\n\\]){{0,200}}+(?=[\r\n\\])|[^\s\\]++)){{0,9}}+(?:[\s\"',+]|\\+[nrt]){{0,60}}+)"
    rf"({_RUN}[A-Za-z0-9+/=\s\\\"',]*+(?=-----END [A-Z ]*PRIVATE KEY-----)|{_RUN}{{16,}}+(?:(?:\s|\\[nr]){{1,9}}{_RUN}{{16,}}+){{0,500}}(?:(?:[\r\n]|\\[nr]){{1,4}}[\x20\t]*+{_RUN}{{1,15}}+(?=[\s\"'\\]|$))?)"
    r"(?:-----END [A-Z ]*+(?<=PRIVATE KEY)-----)?"
)
#: The first three are the base kinds, in their order.
KINDS = {
    "assign": Kind(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": Kind(r"AKIA[A-Z0-9]+", 0, 20),
    "hex": Kind(r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so the length may stand in the pattern
    "pat": Kind(r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 40),
    "jwt": Kind(r"(^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 2, 29, lead=1),  # at the start of a run, so that none is read twice
    "pem": Kind(PEM, 2, 6, head=1, between=r"""\\[nrt]|[^A-Za-z0-9+/=]"""),
}
BASE = ("assign", "access", "hex")
#: What a text must hold for spans of a kind, where that is found sooner than the pattern is.
HINTS = {
    "assign": lambda text: reduce(lambda a, b: a | b, [F.lower(text).contains(part) for part in ("passw", "secret", "token", "api")]),
    "access": lambda text: text.contains("AKIA"),
    "jwt": lambda text: text.contains("eyJ"),
    "pem": lambda text: text.contains("-----BEGIN "),
}
#: Distinct owners, and distinct documents, from which on a value counts as a copied example.
SHARED_OWNERS, SHARED_REPOSITORIES = 3, 20
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string,from:int,to:int>>"
#: Numbers that a running total adds up at a time.
STEP = 64


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of value, which is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda x, y: x + y)


def _running(numbers: Column, total: Callable[[Column], Column] = _sum, add: Callable[[Column, Column], Column] = lambda x, y: x + y) -> Column:
    """Totals of numbers (a bound array of ints from zero up) so far; blockwise, so that no list is copied for each of them."""
    n = F.size(numbers)
    cut = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int")), lambda b: F.slice(numbers, b * STEP + 1, STEP))).otherwise(F.array().cast("array<array<int>>"))
    within = lambda one, base: F.transform(one, lambda x, j: add(base, total(F.slice(one, F.lit(1), j + 1))))
    return _let(cut, lambda blocks: _let(F.transform(blocks, total), lambda sums: F.flatten(F.transform(blocks, lambda one, b: _let(F.coalesce(total(F.slice(sums, F.lit(1), b)), F.lit(0)), lambda base: within(one, base))))))


def _may(text: Column, kind: str) -> Column:
    """Whether a text has a match of a kind."""
    found = text.rlike(KINDS[kind].pattern)
    return HINTS[kind](text) & found if kind in HINTS else found


def has_any(text: Column) -> Column:
    """Whether a text has a match of any kind."""
    return reduce(lambda a, b: a | b, [_may(text, kind) for kind in KINDS])


def _spans(text: Column, kind: str) -> Column:
    """Array of SPAN of the matches that pass; positions in code points, end exclusive; the value stands between from and to."""
    k, rank, none = KINDS[kind], list(KINDS).index(kind), F.array().cast(SPAN)
    whole, values, leads, heads = (F.regexp_extract_all(text, F.lit(k.pattern), F.lit(g)) for g in (0, k.value, k.lead, k.head))
    gaps = F.transform(F.split(text, k.pattern, -1), F.length)
    lengths = lambda found, wanted=True: F.transform(found, F.length) if wanted else F.transform(whole, lambda _: F.lit(0))
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), lengths(whole).alias("size"), values.alias("value"), lengths(leads, k.lead > 0).alias("lead"), lengths(heads, k.head > 0).alias("head"))

    def span(m: Column, end: Column) -> Column:
        start = end - m["size"] + m["lead"]
        # the value of a pattern without a head ends where its span does; a key is the same key however its lines are broken
        begin = start + m["head"] if k.head else end - F.length(m["value"])
        value = F.regexp_replace(m["value"], k.between, "") if k.between else m["value"]
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value"), begin.alias("from"), (begin + F.length(m["value"])).alias("to"))

    found = _let(rows, lambda r: _let(F.transform(r, lambda m: m["gap"] + m["size"]), lambda steps: _let(_running(steps), lambda ends: F.transform(r, lambda m, i: span(m, F.get(ends, i))))))
    return F.when(_may(text, kind), F.filter(found, lambda s: F.length(s["value"]) >= k.least).cast(SPAN)).otherwise(none)


def all_spans(text: Column) -> Column:
    """All spans of a text by start, then kind as KINDS lists them."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    found = F.array_sort(F.concat(*[_spans(text, kind) for kind in KINDS]))
    # lambdas are interpreted, and so is what stands around them; the condition is not
    return F.when(has_any(text), found).otherwise(F.array().cast(SPAN))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is_base(s: Column) -> Column:
    return s["kind"].isin(*BASE)


def value_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def ownership(candidates: DataFrame) -> DataFrame:
    """Rows (hash, owner, repository) -> (hash, n_owners, n_repositories, n_rows).

    Nulls count as one owner or repository. Counting goes by (hash, owner,
    repository), then (hash, owner), then hash, each combined before it is sent,
    so a value in a third of all rows is a few rows a task.
    """
    own, repo = F.coalesce(F.col("owner").cast("string"), F.lit("\u0000")), F.coalesce(F.col("repository").cast("string"), F.lit("\u0000"))
    one = candidates.groupBy("hash", own.alias("owner"), repo.alias("repository")).agg(F.count("*").alias("n"))
    two = one.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return two.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_rows"))


def scanned(docs: DataFrame, text: str = "text", owner: str = "source") -> DataFrame:
    """doc_id, owner, text_key (a hash of the text) and spans of each row, computed once and kept in the shared folder without the text."""
    return checkpointed(docs.select(F.col("doc_id"), F.col(owner).alias("owner"), text_key(F.col(text)).alias("text_key"), all_spans(F.col(text)).alias("spans")))


def verdicts(slim: DataFrame, shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """(hash, n_owners, n_repositories, n_rows, live) of every candidate value of scanned() rows."""
    candidates = slim.select("owner", F.col("doc_id").alias("repository"), F.explode("spans").alias("s")).select(value_hash(F.col("s.value")).alias("hash"), "owner", "repository")
    return checkpointed(ownership(candidates).withColumn("live", (F.col("n_owners") < shared_owners) & (F.col("n_repositories") < shared_repositories)))


def secret_scan(docs: DataFrame, text: str = "text", owner: str = "source", shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared and ownership of every row.

    n_live and n_shared count the spans (all kinds) by the verdict on their value:
    shared if it has shared_owners owners or shared_repositories documents or more.
    ownership has, for each span in order, its value's owners/documents. Null texts
    count as empty and give zeros, the digest of the empty string and empty strings.
    Repeated rows each get a row; the value of repeated documents counts once as a
    repository. Null owners and ids are values of their own. Other columns are
    ignored.
    """
    slim = scanned(docs, text, owner)
    live = verdicts(slim, shared_owners, shared_repositories)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = _joined(F.filter("spans", _is_base))
    rows = slim.select("doc_id", "text_key", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(base, 256).alias("base_sha256"), _joined(F.col("spans")).alias("all_spans"), F.transform("spans", lambda s: value_hash(s["value"])).alias("hashes"))
    zero = F.lit(0).cast("long")
    none = rows.where(F.size("hashes") == 0).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("all_spans").alias("spans"), zero.alias("n_live"), zero.alias("n_shared"), F.lit("").alias("ownership"))
    # equal rows of docs (copies with the same id and text) are one row with a count, and come back as many rows; spans travel with the ids alone
    key = ["doc_id", "text_key"]
    kept = ["n_assign", "n_access", "n_hex", "base_sha256", F.col("all_spans").alias("spans")]
    some = checkpointed(rows.where(F.size("hashes") > 0).groupBy(*rows.columns).agg(F.count("*").alias("times")))
    each = some.select(*key, F.posexplode("hashes").alias("at", "hash"))
    judged = each.join(live.select("hash", "live", F.concat_ws("/", F.col("n_owners").cast("string"), F.col("n_repositories").cast("string")).alias("owned")), "hash")
    found = judged.groupBy(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_")).agg(F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_shared"), F.array_sort(F.collect_list(F.struct("at", "owned"))).alias("owned"))
    found = some.join(found, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_")))
    found = found.select("doc_id", *kept, "n_live", "n_shared", F.array_join(F.col("owned.owned"), ",").alias("ownership"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("t")).drop("t")
    return none.union(found)


#: Characters of a piece that a masked text is cut from.
PIECE = 1024


def _masked(text: Column, places: Column, mask: str) -> Column:
    """text with mask in place of each of places (start, end); places that overlap are one. The text is cut up once, whatever the places are."""

    def between(pieces: Column, a: Column, b: Column) -> Column:
        """Characters a to b, b exclusive."""
        first = F.floor(a / PIECE).cast("int")
        some = F.slice(pieces, first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1)
        return F.when(b > a, F.substring(F.array_join(some, ""), a - first * PIECE + 1, b - a)).otherwise(F.lit(""))

    def cut(pieces: Column, size: Column, spots: Column, ends: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))
        parts = F.transform(spots, lambda p, i: F.concat(between(pieces, before(i), F.greatest(before(i), p["start"])), F.when(p["start"] >= before(i), F.lit(mask)).otherwise(F.lit(""))))
        return F.concat(F.array_join(parts, ""), between(pieces, F.element_at(ends, -1), size))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    ends = lambda spots: _let(F.transform(spots, lambda p: p["end"]), lambda e: _running(e, F.array_max, F.greatest))
    return _let(pieces, lambda x: _let(F.length(text), lambda size: _let(F.array_sort(places), lambda spots: _let(ends(spots), lambda e: cut(x, size, spots, e)))))


def redact(docs: DataFrame, text: str = "text", owner: str = "source", mask: str = "[SECRET]", shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES, most: int = BROADCAST_ROWS) -> DataFrame:
    """docs with mask in place of the value of every live-looking span; examples stay.

    Only the values' own places change: the same characters elsewhere in a text are
    prose. All rows and columns are kept. Up to most places to mask are broadcast;
    with more, the rows whose text has a candidate are joined with them by shuffle,
    and the others passed on where they are. Rows with a null text stay as they are;
    rows with one doc_id and different texts are each masked by their own spans.
    """
    slim = scanned(docs, text, owner)
    live = verdicts(slim, shared_owners, shared_repositories).where("live").select("hash")
    place = F.struct(F.col("s.from").alias("start"), F.col("s.to").alias("end"))
    values = slim.select("doc_id", "text_key", F.explode("spans").alias("s")).select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), place.alias("place"), value_hash(F.col("s.value")).alias("hash"))
    by_doc = checkpointed(values.join(live, "hash").groupBy("id_", "key_").agg(F.collect_set("place").alias("places_")))
    old, rows = F.col(f"row_.{text}"), wrapped(docs)
    same = F.col("row_.doc_id").eqNullSafe(F.col("id_")) & (text_key(old) == F.col("key_"))
    changed = [F.when(F.col("places_").isNotNull(), _masked(old, F.col("places_"), mask)).otherwise(old).alias(c) if c == text else F.col(f"row_.`{c}`").alias(c) for c in docs.columns]
    if (by_doc.agg(F.sum(F.size("places_") + 1)).first()[0] or 0) <= most:
        return rows.join(F.broadcast(by_doc), same, "left").select(*changed)
    may = F.coalesce(has_any(old.cast("string")), F.lit(False))
    return rows.where(~may).select("row_.*").union(rows.where(may).join(by_doc, same, "left").select(*changed))
