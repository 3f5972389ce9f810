"""Groups of linked nodes, without all pairs of a group.

``linked`` takes inverted lists (key, node): nodes that share a key are candidates.
Short lists give all their pairs. In a long list one node after another is the
pivot, tested against the nodes of the list that aren't yet connected with it, so
that a large group of copies costs a few pairs per member. What long lists still
hold in different components at the end is tested pair by pair: no link between
components is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, saved

#: Lists up to this length are expanded to pairs at once (at most SHORT / 2 pairs a row).
SHORT = 12
#: Rounds of pivots for longer lists before what is left is tested in full, and pivots a round:
#: the lists' nodes are dealt to so many lots, and each gives its first by rank.
PIVOTS = 2
PICKS = 4


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each end of ``edges`` (a, b): comp is the least node reachable.

    Alternating large-star and small-star steps; each is a grouped minimum and a join
    on the same key. Only counts of changed rows reach the driver.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        both = e.join(least, "a")
        moved = both.where(F.col("b") > F.col("a")) if large else both
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    e = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = None
    while True:
        old, e = e, saved(star(star(e, True), False))
        free(edges.sparkSession, [old])
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def linked(lists: DataFrame, verify: Callable[[DataFrame], DataFrame], fits: Callable[[Column, Column], Column] | None = None, refine: Callable[[DataFrame], DataFrame] | None = None, refined_fits: Callable[[Column, Column], Column] | None = None, rank: Callable[[Column], Column] = lambda info: F.lit(0), short: int = SHORT) -> DataFrame:
    """(node, comp) of the nodes that have links; comp is the least node reachable.

    lists: (key long, node long, info), distinct. verify: keeps those of the pairs (a, b),
    a < b, that are links. A pair is a candidate if it shares a key and ``fits`` holds for
    the infos of the two rows. refine: gives stricter lists, which lose no link, for the
    rows (key, node, info) of long lists, with a rule of their own. rank: of an info; nodes of low
    rank are pivots first. short: lists up to this length give all their pairs.
    """
    yes = lambda x, y: F.lit(True)
    fits, refined_fits = fits or yes, refined_fits or fits or yes

    def sized(rows: DataFrame) -> DataFrame:
        rows = saved(rows)
        return saved(rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"))

    def both(rows: DataFrame, fits: Callable[[Column, Column], Column], *more: str) -> DataFrame:
        side = lambda x: rows.select("key", F.col("node").alias(x), F.col("info").alias(f"i{x}"), *(F.col(m).alias(m + x) for m in more))
        apart = [F.col(m + "a") != F.col(m + "b") for m in more]
        on = reduce(lambda p, q: p & q, [F.col("l.key") == F.col("r.key"), F.col("a") < F.col("b"), fits(F.col("ia"), F.col("ib")), *apart])
        return side("a").alias("l").join(side("b").alias("r"), on).select("a", "b")

    first = sized(lists)
    pairs, long = both(first.where(F.col("n") <= short), fits), first.where(F.col("n") > short)
    if long.limit(1).count() == 0:
        return components(saved(verify(pairs.distinct())))
    if refine is not None:
        long, fits = sized(refine(long)), refined_fits
        pairs, long = pairs.union(both(long.where(F.col("n") <= short), fits)), long.where(F.col("n") > short)
    long = long.select("key", "node", "info")
    links = saved(verify(pairs.distinct()))
    found = components(links)
    for turn in range(PIVOTS + 1):
        state = long.join(found, "node", "left").select("key", "node", "info", F.coalesce("comp", "node").alias("comp"))
        lot = F.xxhash64("node", F.lit(turn))
        pivot = lambda i: F.min(F.when(F.pmod(lot, F.lit(PICKS)) == i, F.struct(rank(F.col("info")), lot, F.col("node"), F.col("comp"), F.col("info"))))  # noqa: E731, B023
        spread = state.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.array(*(pivot(i) for i in range(PICKS))).alias("pivots")).where("low != high")
        if turn < PIVOTS:
            picked = spread.select("key", F.explode(F.array_compact("pivots")).alias("p"))
            near = state.join(picked, "key").where((F.col("comp") != F.col("p.comp")) & fits(F.col("info"), F.col("p.info")))
            pairs = near.select(F.least(F.col("node"), F.col("p.node")).alias("a"), F.greatest(F.col("node"), F.col("p.node")).alias("b"))
        else:
            pairs = both(state.join(spread.select("key"), "key", "left_semi"), fits, "comp")
        fresh = saved(verify(pairs.distinct()))
        if fresh.limit(1).count():
            links = links.union(fresh)
            found = components(links)
        elif turn < PIVOTS and spread.limit(1).count() == 0:
            break
    return found
