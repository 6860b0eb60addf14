"""URL filter: rules first, gradient-boosted trees over lexical features for all others.

The trees learn from labelled URLs, which are those that a rule judges. Features are
lengths, depth, ratios of digits and other characters, entropies, counts of parameters,
and suffix statistics: what share of the labelled URLs with the same end of the host
(one label, two, all), alone and with the path's first directory, is blocked, and how
many there are. Statistics cover all labelled URLs; they are counted by hashes in
BUCKETS buckets a kind, so the table that every task gets has a size that is known
beforehand, whatever hosts there are. A URL's own label is left out of the statistics
that it is trained with. The trees are fitted on a bounded sample.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .gbdt import BoostedTrees

#: Labelled URLs of either label that the trees are fitted on, at most; rules that every task holds, at most.
SAMPLE, RULES = 5000, 200_000
#: Kinds of suffix statistics, and buckets of each.
KINDS, BUCKETS = 6, 1 << 14
#: URLs that the prior counts for in a share.
PRIOR = 4.0
ALLOW, BLOCK = "allow", "block"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without a ://."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    end = next((i for i in range(stop, len(rest)) if rest[i] in "?#"), len(rest))
    return rest[:stop].translate(_LOWER), rest[stop:end]


class Rules:
    """Rules (host and path as one text, verdict) that fit a host, its subdomains, and all paths that start with theirs."""

    def __init__(self, rules: Sequence[tuple[str, str]]) -> None:
        if len(rules) > RULES:
            raise ValueError(f"at most {RULES} rules are held by each task, not {len(rules)}")
        self.of_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.of_host.setdefault(host, []).append((slash + path, rule, verdict))
        for known in self.of_host.values():
            known.sort(key=lambda r: (-len(r[0]), r))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, and its verdict; of rules of one length that with the longer host."""
        best: tuple[str | None, str | None] = (None, None)
        at = 0
        while host:
            for start, rule, verdict in self.of_host.get(host[at:], ()):
                if path.startswith(start):
                    if best[0] is None or len(rule) > len(best[0]):
                        best = (rule, verdict)
                    break
            at = host.find(".", at) + 1
            if not at:
                break
        return best


def _slots(host: str, path: str) -> list[int]:
    """Where the statistics of a URL stand, one place a kind."""
    labels = host.split(".")
    first = path[1:].partition("/")[0] if path.count("/") > 1 else ""
    ends = (labels[-1], ".".join(labels[-2:]), host)
    keys = [*ends, *(f"{e}/{first}" for e in ends[:2]), f"/{first}"]
    return [k * BUCKETS + zlib.crc32(key.encode()) % BUCKETS for k, key in enumerate(keys)]


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _share(text: str, what) -> float:
    return sum(map(what, text)) / len(text) if text else 0.0


@dataclass
class Statistics:
    """Labelled URLs, and blocked ones among them, by slot."""

    n: np.ndarray
    blocked: np.ndarray

    def features(self, slots: list[int], own: int | None = None) -> list[float]:
        """Share blocked and size of each slot, without a URL's own label where that is given."""
        less = own is not None
        total, bad = self.n[:BUCKETS].sum() - less, self.blocked[:BUCKETS].sum() - (own or 0)
        prior = bad / total if total > 0 else 0.5
        out = []
        for s in slots:
            n, b = self.n[s] - less, self.blocked[s] - (own or 0)
            out += [(b + PRIOR * prior) / (n + PRIOR), math.log1p(max(0.0, n))]
        return out


def features(url: str | None, host: str, path: str, known: Statistics, own: int | None = None) -> list[float]:
    url = url or ""
    query = url.partition("#")[0].partition("?")[2]
    pieces = [p for p in path.split("/") if p]
    params = [p for p in query.split("&") if p]
    return [
        len(url), len(host), len(path), len(query), len(url.partition("#")[2]), len(pieces), host.count(".") + 1 if host else 0, len(params),
        _share(url, str.isdigit), _share(host, str.isdigit), _share(path, str.isdigit), _share(url, lambda c: not c.isalnum()), host.count("-"),
        _entropy(url), _entropy(host), _entropy(path), max(map(len, pieces), default=0), max(map(len, host.split(".")), default=0),
        len(pieces[-1].rpartition(".")[2]) if pieces and "." in pieces[-1] else 0, float(url[:6].lower() == "https:"), *known.features(_slots(host, path), own),
    ]


@dataclass
class UrlModel:
    """Trees, statistics and the odds that the sample's own balance is off by."""

    trees: BoostedTrees | None
    known: Statistics
    shift: float

    def scores(self, urls: list[tuple[str | None, str, str]]) -> np.ndarray:
        """How likely each of (url, host, path) is to be blocked."""
        odds = np.full(len(urls), self.shift)
        if self.trees and urls:
            odds = odds + self.trees.log_odds(np.array([features(*u, self.known) for u in urls], float))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row; the last two are null where no rule fits."""
    book = Rules(rules)
    schema = pa.schema([("page_id", pa.int64()), *((n, pa.string()) for n in ("url", "host", "path", "rule", "verdict"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parts(u) for u in batch.column(1).to_pylist()]
            hits = [book.match(*f) for f in found]
            cols = [pa.array([x[i] for x in rows], pa.string()) for rows in (found, hits) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), *cols], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(url).cast("string").alias("url")).mapInArrow(run, "page_id long, url string, host string, path string, rule string, verdict string")


def statistics(labelled: DataFrame) -> Statistics:
    """Statistics of all rows (host, path, verdict); each task counts its own first, and there are KINDS x BUCKETS slots at most."""
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("blocked", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, blocked = np.zeros(KINDS * BUCKETS, np.int64), np.zeros(KINDS * BUCKETS, np.int64)
        for batch in batches:
            for host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                slots = _slots(host, path)
                n[slots] += 1
                blocked[slots] += verdict == BLOCK
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(blocked[at])], schema=schema)

    rows = labelled.select("host", "path", "verdict").mapInArrow(run, "slot int, n long, blocked long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).toPandas()
    out = Statistics(np.zeros(KINDS * BUCKETS), np.zeros(KINDS * BUCKETS))
    out.n[rows.slot], out.blocked[rows.slot] = rows.n, rows.blocked
    return out


def fit(labelled: DataFrame, each: int = SAMPLE) -> UrlModel:
    """The model of labelled rows (url, host, path, verdict): trees from at most each different URLs of either verdict, those with the smallest hashes.

    With one verdict alone, or none, there are no trees and every score is the share of
    blocked URLs.
    """
    known = statistics(labelled)
    total, bad = known.n[:BUCKETS].sum(), known.blocked[:BUCKETS].sum()
    share = np.clip(bad / total if total else 0.5, 1e-3, 1 - 1e-3)
    urls = labelled.groupBy("url", "host", "path", "verdict").agg(F.count("*").alias("times"))
    of = [urls.where(F.col("verdict") == v).orderBy(F.xxhash64("url"), "url").limit(each).select("url", "host", "path").collect() for v in (ALLOW, BLOCK)]
    if not all(of):
        return UrlModel(None, known, float(np.log(share / (1 - share))))
    x = np.array([features(*r, known, own) for own, rows in enumerate(of) for r in rows], float)
    y = np.repeat([0.0, 1.0], [len(rows) for rows in of])
    taken = y.mean()
    return UrlModel(BoostedTrees().fit(x, y), known, float(np.log(share / (1 - share)) - np.log(taken / (1 - taken))))


def scored(rows: DataFrame, model: UrlModel) -> DataFrame:
    """judged() rows with score (how likely a URL is to be blocked), and the verdict by it where no rule fits."""
    names = ["page_id", "host", "path", "rule", "verdict", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page_id, url, host, path, rule, verdict = batch.columns
            scores = model.scores(list(zip(url.to_pylist(), host.to_pylist(), path.to_pylist())))
            verdicts = [v or (BLOCK if s >= 0.5 else ALLOW) for v, s in zip(verdict.to_pylist(), scores)]
            yield pa.RecordBatch.from_arrays([page_id, host, path, rule, pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], names=names)

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", each: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and score of every row of pages.

    rules are (host/path, verdict); a rule fits its host and all subdomains where the
    path starts with the rule's, and the longest decides. Other URLs are judged by
    trees that learn from those which rules judge. Null URLs, and such without a ://,
    have an empty host and path, so no rule fits them; the trees judge them as empty
    texts. Repeated rows get a row each, null ids stay null, other columns are not
    read. An empty table gives no rows.
    """
    rows = checkpointed(judged(pages, rules, url))
    return scored(rows, fit(rows.where("rule is not null"), each))
