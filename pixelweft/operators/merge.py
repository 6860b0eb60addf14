"""Regions of like colour merged over their adjacency graph, in rounds of joins.

A node of the graph is a region with its number of cells and, for each channel, their
sum, least and largest value; an edge joins neighbours and carries both ends' numbers.
Two regions may merge if every cell of both is within the allowed difference of their
common mean in every channel, so a gradient falls into steps and does not run together.
In a round each region chooses the nearest of the neighbours that it may merge with;
where two choose each other they become one, and with them all that chose either, if
these may merge all together (so the specks on a ground go in one round); means are
taken anew, and the graph shrinks. The edge that is nearest of all is chosen from both
sides, so every round merges something until nothing may merge; equal distances are ordered by a mix of the
ends that changes from round to round, so that chains of them merge in many places at
once. The regions that lie in one tile go through their rounds first, in a kernel that
sees the tile's graph; what is left, across tiles, goes through them as joins of rows,
so no image need fit a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import with_id
from ..sources.store import stored
from .region import region_edges
from .tiles import TILE, tile_of

#: Distances between means are compared in thousandths of a square step.
SCALE = 1000
# Any numbers without a common factor mix the ends of an edge.
MIX = (7919, 104729, 15485863, 1000003)


def _sums() -> list[Column]:
    """n, and for each channel its sum, least and largest value, of cells' rgb."""
    part = {"r": F.shiftright("rgb", 16), "g": F.shiftright("rgb", 8).bitwiseAND(255), "b": F.col("rgb").bitwiseAND(255)}
    out = [F.count("*").alias("n")]
    for c, v in part.items():
        out += [F.sum(v).cast("long").alias(f"s{c}"), F.min(v).cast("long").alias(f"l{c}"), F.max(v).cast("long").alias(f"h{c}")]
    return out


_NAMES = ["n", *(f"{k}{c}" for c in "rgb" for k in "slh")]


_HOW = {"n": F.sum, "s": F.sum, "l": F.min, "h": F.max}


def _both(a: str = "sa", b: str = "sb") -> Column:
    """Numbers of two regions taken together."""
    how = {"s": lambda x, y: x + y, "l": F.least, "h": F.greatest, "n": lambda x, y: x + y}
    return F.struct(*[how[c[0]](F.col(f"{a}.{c}"), F.col(f"{b}.{c}")).alias(c) for c in _NAMES])


def _may(both: str, difference: int) -> Column:
    """Whether all cells are within difference of the mean, in whole numbers."""
    n, ok = F.col(f"{both}.n"), F.lit(True)
    for c in "rgb":
        s = F.col(f"{both}.s{c}")
        ok &= (F.col(f"{both}.h{c}") * n - s <= difference * n) & (s - F.col(f"{both}.l{c}") * n <= difference * n)
    return ok


def _apart() -> Column:
    """Squared distance of the means of both ends, in whole parts."""
    d = [F.col(f"sa.s{c}") / F.col("sa.n") - F.col(f"sb.s{c}") / F.col("sb.n") for c in "rgb"]
    return F.floor((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) * SCALE)


def _round(edges: DataFrame, difference: int, turn: int) -> DataFrame:
    """image_id, node, to (the smallest of a group) and s (the numbers of the whole group) of the nodes that merge in a round."""
    order = (F.col("a") * MIX[0] + F.col("b") * MIX[1] + turn * MIX[2]) % MIX[3]
    open_ = edges.withColumn("s", _both()).where(_may("s", difference)).withColumn("key", F.struct(_apart().alias("d"), order.alias("o"), "a", "b"))
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("target"), F.col("sa").alias("own")), F.struct(F.col("b").alias("node"), F.col("a").alias("target"), F.col("sb").alias("own")))
    chosen = open_.select("image_id", "key", "s", F.inline(ends)).groupBy("image_id", "node").agg(F.min_by(F.struct("key", "s", "target", "own"), "key").alias("c"))
    chosen = chosen.select("image_id", "node", "c.*")
    pairs = chosen.groupBy("image_id", "key.a", "key.b").agg(F.count("*").alias("k"), F.first("s").alias("pair")).where("k = 2")
    hubs = pairs.select("image_id", F.explode(F.array("a", "b")).alias("target"), "a", "b", "pair")
    members = chosen.join(hubs, ["image_id", "target"]).select("image_id", "node", "own", "a", "b", "pair")
    whole = members.groupBy("image_id", "a", "b").agg(F.min("node").alias("least"), F.first("pair").alias("pair"), F.struct(*[_HOW[c[0]](f"own.{c}").alias(c) for c in _NAMES]).alias("all"), F.collect_list("node").alias("nodes"))
    ok = _may("all", difference)
    groups = whole.withColumn("ok", ok).select("image_id", F.when(F.col("ok"), F.col("least")).otherwise(F.col("a")).alias("to"), F.when(F.col("ok"), F.col("all")).otherwise(F.col("pair")).alias("s"), F.explode(F.when(F.col("ok"), F.col("nodes")).otherwise(F.array("a", "b"))).alias("node"))
    return groups.select("image_id", "node", "to", "s")


def _rounds(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray, difference: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rounds of one tile's graph: edges and their ends' numbers (a row of _NAMES each) -> node, to, numbers of what it goes to, of nodes that merge."""
    ids, at = np.unique(np.concatenate([a, b]), return_index=True)
    s = np.concatenate([sa, sb])[at]
    i, j = np.searchsorted(ids, a), np.searchsorted(ids, b)
    to, turn = np.arange(len(ids)), 0
    total, least, most = ([k for k, c in enumerate(_NAMES) if c[0] == x] for x in "slh")
    while len(i):
        both = s[i] + s[j]
        both[:, least], both[:, most] = np.minimum(s[i][:, least], s[j][:, least]), np.maximum(s[i][:, most], s[j][:, most])
        n = both[:, :1]
        may = ((both[:, most] * n - both[:, total] <= difference * n) & (both[:, total] - both[:, least] * n <= difference * n)).all(axis=1)
        if not may.any():
            break
        d = s[i][:, total] / s[i][:, :1] - s[j][:, total] / s[j][:, :1]
        d = np.floor((d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]) * SCALE)
        mix = (ids[i] * MIX[0] + ids[j] * MIX[1] + turn * MIX[2]) % MIX[3]
        open_ = np.flatnonzero(may)
        rank = np.full(len(i), len(i))
        rank[open_[np.lexsort((j[open_], i[open_], mix[open_], d[open_]))]] = np.arange(len(open_))
        best = np.full(len(ids), len(i))
        for end in (i, j):
            np.minimum.at(best, end, rank)
        target = np.full(len(ids), -1)
        for end, other in ((i, j), (j, i)):
            mine = may & (best[end] == rank)
            target[end[mine]] = other[mine]
        pair = may & (best[i] == rank) & (best[j] == rank)
        group = np.full(len(ids), -1)  # of the hubs, then of all that chose them
        for end in (i, j):
            group[end[pair]] = i[pair]
        nodes = np.flatnonzero((target >= 0) & (group[target] >= 0))
        of = group[target[nodes]]
        whole, first = s.copy(), np.arange(len(ids))
        whole[np.ix_(i[pair], [0, *total])] = 0  # the hub counts among its members
        for k in range(len(_NAMES)):
            (np.minimum if k in least else np.maximum if k in most else np.add).at(whole[:, k], of, s[nodes, k])
        np.minimum.at(first, of, nodes)
        n = whole[:, :1]
        ok = ((whole[:, most] * n - whole[:, total] <= difference * n) & (whole[:, total] - whole[:, least] * n <= difference * n)).all(axis=1)
        s[i[pair]] = both[pair]
        to[j[pair]] = i[pair]
        good = ok[of]
        to[nodes[good]] = first[of[good]]
        s[first[of[good]]] = whole[of[good]]
        i, j = to[i], to[j]
        i, j = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)])[:, i != j], axis=1)
        turn += 1
    while (to[to] != to).any():
        to = to[to]
    moved = np.isin(to, to[to != np.arange(len(ids))])
    return ids[moved], ids[to[moved]], s[to[moved]]


def _within_tiles(edges: DataFrame, difference: int) -> DataFrame:
    """edges (image_id, a, b, sa, sb, home) -> image_id, node, to and s of the nodes that merge within their tile."""
    flat = edges.select("image_id", "home", "a", "b", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("sa", "sb") for c in _NAMES])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sa, sb = (pdf[[f"{e}_{c}" for c in _NAMES]].to_numpy(np.int64) for e in ("sa", "sb"))
        node, to, s = _rounds(pdf.a.to_numpy(np.int64), pdf.b.to_numpy(np.int64), sa, sb, difference)
        return pd.DataFrame({"node": node, "to": to, **{c: s[:, k] for k, c in enumerate(_NAMES)}}).assign(image_id=pdf.image_id.iloc[0])[["image_id", "node", "to", *_NAMES]]

    out = flat.groupBy("image_id", "home").applyInPandas(run, with_id(edges, "node long, to long, " + ", ".join(f"{c} long" for c in _NAMES)))
    return out.select("image_id", "node", "to", F.struct(*_NAMES).alias("s"))


def _moved(edges: DataFrame, to: DataFrame) -> DataFrame:
    """edges between what their ends went to."""
    for c in "ab":
        now = to.select("image_id", F.col("node").alias(c), F.col("to").alias("to_"), F.col("s").alias("s_"))
        edges = edges.join(now, ["image_id", c], "left").withColumn(c, F.coalesce("to_", c)).withColumn(f"s{c}", F.coalesce("s_", f"s{c}")).drop("to_", "s_")
    turned = F.col("a") > F.col("b")
    ends = {"a": F.least("a", "b"), "b": F.greatest("a", "b"), "sa": F.when(turned, F.col("sb")).otherwise(F.col("sa")), "sb": F.when(turned, F.col("sa")).otherwise(F.col("sb"))}
    return stored(edges.where("a <> b").select("image_id", *[v.alias(k) for k, v in ends.items()]).groupBy("image_id", "a", "b").agg(F.first("sa").alias("sa"), F.first("sb").alias("sb")))


def merged_roots(cells: DataFrame, difference: int, tile: int | None = TILE) -> DataFrame:
    """cells (image_id, x, y, rgb, region) -> image_id, region, root of the regions that merge into one of a smaller number.

    Without tile all rounds are joins; an image within one tile comes out the same.
    """
    home = tile_of("x", "y", tile or TILE)
    nodes = cells.groupBy("image_id", F.col("region").cast("long").alias("region")).agg(*_sums(), F.min(home).alias("home"), F.max(home).alias("last"))
    nodes = stored(nodes.select("image_id", "region", F.struct(*_NAMES).alias("s"), F.when(F.col("home") == F.col("last"), F.col("home")).alias("home")))
    ends = lambda c: nodes.select("image_id", F.col("region").alias(c), F.col("s").alias(f"s{c}"), F.col("home").alias(f"home_{c}"))
    edges = region_edges(cells).where("other is not null").select("image_id", F.least("region", "other").cast("long").alias("a"), F.greatest("region", "other").cast("long").alias("b")).distinct()
    edges = stored(edges.join(ends("a"), ["image_id", "a"]).join(ends("b"), ["image_id", "b"]))
    moved: list[DataFrame] = []
    if tile:
        to = stored(_within_tiles(edges.where("home_a = home_b").withColumn("home", F.col("home_a")), difference))
        moved.append(to.where("node <> to").select("image_id", "node", "to"))
        edges = _moved(edges.drop("home_a", "home_b"), to)
    turn = 0
    while True:
        to = stored(_round(edges, difference, turn))
        if to.isEmpty():
            break
        moved.append(to.where("node <> to").select("image_id", "node", "to"))
        edges, turn = _moved(edges, to), turn + 1
    if not moved:
        return nodes.select("image_id", "region", F.col("region").alias("root")).where(F.lit(False))
    found = moved.pop().select("image_id", F.col("node").alias("region"), F.col("to").alias("root"))
    while moved:
        # what moved in an earlier round follows where its new place went later; what moved later is new
        earlier = moved.pop().select("image_id", F.col("node").alias("region"), "to")
        later = found.select("image_id", F.col("region").alias("to"), F.col("root").alias("last"))
        found = stored(earlier.join(later, ["image_id", "to"], "left").select("image_id", "region", F.coalesce("last", "to").alias("root")).union(found))
    return found


def merged(cells: DataFrame, difference: int, tile: int | None = TILE) -> DataFrame:
    """cells with region and rgb of what they merge into: the smallest number, and the mean colour of all its cells."""
    roots = merged_roots(cells, difference, tile)
    out = cells.join(roots, ["image_id", "region"], "left").withColumn("region", F.coalesce("root", "region").cast(cells.schema["region"].dataType)).drop("root")
    mean = lambda c: F.expr(f"(2 * s{c} + n) div (2 * n)")
    color = out.groupBy("image_id", "region").agg(*_sums()).select("image_id", "region", (mean("r") * 65536 + mean("g") * 256 + mean("b")).cast("int").alias("rgb"))
    return out.drop("rgb").join(color, ["image_id", "region"]).select(*cells.columns)
