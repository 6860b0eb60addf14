"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A document of a source with rate r = target / size is taken floor(r) times, and
once more with a probability of the fraction. Within small groups those fractions,
counted in words, are paired: mass moves from one document to another, in a random
direction with odds that keep every expectation, until one of the two is taken or
dropped. Each group leaves at most one undecided document, and these meet in the
groups of the next level, so a source's words stay exact up to the last one. Groups
are bounded, every level is one shuffle, and the number of levels is the logarithm
of the largest source. Rows alike in id, source and size are counted first and paired
with each other by that count: as many are taken as their mass makes whole, and what
is left of it is one undecided document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, uniform

#: Weights of the sources by code point, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CEILING = 1.5, 2.0
#: Documents in a group, on average.
GROUP = 64
#: Sources up to which their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000

ITEM = "struct<doc_id:bigint,size:bigint,mass:double,times:bigint,base:bigint>"
DONE = "array<struct<doc_id:bigint,size:bigint,times:bigint,base:bigint,more:int>>"
#: Rows that one counted row becomes in a task at most.
SPREAD = 100_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, n) -> the same with target. Further columns are ignored.

    The sources share share x all sizes by their weights; what is above ceiling x
    a source's size is shared again among the others. The result is the level L at
    which the sum of least(ceiling x size, weight x L) is the whole, found from
    running sums over the sources by the level at which each one is full. One row
    a source: this table is as long as the list of sources, which is small beside
    any corpus.
    """
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("full_at", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(ceiling)) * F.col("source_size"))
    rows = rows.withColumn("full_at", F.col("cap") / F.col("weight")).withColumn("whole", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()))
    rows = rows.withColumn("below", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("whole") - F.col("below")) / F.col("open"))
    # the first source, by the level at which it is full, that the level of the rest does not fill
    rows = rows.withColumn("at", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(Window.partitionBy())["level"])
    return rows.select("source", "source_size", "n", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("at"))).alias("target"))


def _pair(level: int, seed: int):
    """The fold that pairs each item with the undecided one so far."""

    def done(item: Column, more: Column | int) -> Column:
        more = F.lit(more) if isinstance(more, int) else more
        return F.array(F.struct(*[item[c].alias(c) for c in ("doc_id", "size", "times", "base")], more.cast("int").alias("more")))

    def item(x: Column, mass: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), mass.alias("mass"), x["times"].alias("times"), x["base"].alias("base"))

    none = F.lit(None).cast(ITEM)

    def state(left: Column, out: Column) -> Column:
        return F.struct(left.cast(ITEM).alias("left"), out.cast(DONE).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        c, out = acc["left"], acc["out"]
        gap, room = c["size"].cast("double") - c["mass"], x["size"].cast("double") - x["mass"]
        to_c, to_x = F.least(gap, x["mass"]), F.least(c["mass"], room)
        u = uniform(c["doc_id"], c["size"], x["doc_id"], x["size"], F.lit(level), F.lit(seed))
        up = u * (to_c + to_x) < to_x  # towards c with odds that keep both expectations
        return (
            F.when(c.isNull(), state(x, out))
            .when(up & (x["mass"] < gap), state(item(c, c["mass"] + x["mass"]), F.concat(out, done(x, 0))))
            .when(up & (x["mass"] > gap), state(item(x, x["mass"] - gap), F.concat(out, done(c, 1))))
            .when(up, state(none, F.concat(out, done(c, 1), done(x, 0))))
            .when(c["mass"] < room, state(item(x, x["mass"] + c["mass"]), F.concat(out, done(c, 0))))
            .when(c["mass"] > room, state(item(c, c["mass"] - room), F.concat(out, done(x, 1))))
            .otherwise(state(none, F.concat(out, done(c, 0), done(x, 1))))
        )

    return lambda items: F.aggregate(items, state(none, F.array()), step)


def mix(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, group: int = GROUP, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words) of every row of docs.

    size is the number of words of the text, zero if null or empty; such rows are
    kept with taken 0. A null source is a source of its own, last in order. taken is
    a whole multiple of size, at most ceiling x size rounded up to a copy when the
    ceiling is whole; each source's sum is its target up to half of one document.
    Repeated rows and rows without an id are documents of their own; those that are
    alike in id, size and source may swap their results. Reruns agree. An empty
    table gives no rows.
    """
    size = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)))).cast("long")
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"))
    slim = checkpointed(each.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")))
    sizes = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("n"), F.max("times").alias("most"))
    aims = checkpointed(targets(sizes, weights, share, ceiling).join(sizes.select(F.col("source").alias("of"), "most"), F.col("source").eqNullSafe(F.col("of"))).drop("of"))
    n_sources, most, repeats = aims.agg(F.count("*"), F.max("n"), F.max("most")).first()
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(ceiling)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    aims = aims.withColumn("whole", F.floor(rate)).withColumn("part", rate - F.floor(rate)).withColumnRenamed("source", "source_").drop("most")
    side = F.broadcast(aims) if n_sources <= BROADCAST_SOURCES else aims
    rows = slim.join(side, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    rows = rows.withColumn("base", F.floor(F.col("part") * F.col("times"))).withColumn("mass", (F.col("part") * F.col("times") - F.col("base")) * F.col("size"))
    open_ = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    known = ["doc_id", "source", "size", "times", "base"]
    parts = [rows.where(~open_).select(*known, F.lit(0).alias("more"))]
    live = rows.where(open_).select("source", "n", F.struct("doc_id", "size", "mass", "times", "base").cast(ITEM).alias("item"))
    for level in range(max(1, math.ceil(math.log(max(most or 1, 2), group)))):
        last = (most or 1) <= group ** (level + 1)
        groups = F.lit(1).cast("long") if last else F.ceil(F.col("n") / float(group ** (level + 1)))
        dealt = F.pmod(F.xxhash64("item.doc_id", "item.size", F.lit(level), F.lit(seed)), groups)
        by_size = F.array_sort(F.collect_list(F.struct((-F.col("item.size")).alias("a"), F.xxhash64("item.doc_id", F.lit(seed)).alias("b"), F.col("item").alias("item"))))
        items = F.transform(by_size, lambda s: s["item"])
        folded = live.groupBy("source", "n", dealt.alias("group_")).agg(_pair(level, seed)(items).alias("s"))
        folded = checkpointed(folded.select("source", "n", "s.left", "s.out"))
        parts.append(folded.select("source", F.inline("out")).select(*known, "more"))
        live = folded.where("left is not null").select("source", "n", F.col("left").alias("item"))
        if last:
            break
    # a source's last undecided document is rounded to the nearer copy
    parts.append(live.select("source", "item.*").select(*known, (F.col("mass") * 2 >= F.col("size")).cast("int").alias("more")))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    out = every.join(side, F.col("source").eqNullSafe(F.col("source_")))
    if (repeats or 1) > SPREAD:
        out = out.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(SPREAD).cast("long")))).repartition("doc_id", "source", "size", "from")
    else:
        out = out.withColumn("from", F.lit(0).cast("long"))
    out = out.withColumn("no", F.explode(F.sequence(F.col("from"), F.least(F.col("times"), F.col("from") + SPREAD) - 1)))
    more = F.when(F.col("no") < F.col("base"), 1).when(F.col("no") == F.col("base"), F.col("more")).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", ((F.col("whole") + more) * F.col("size")).cast("long").alias("taken"))
