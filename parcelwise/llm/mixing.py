"""Mixing sources to target weights by iterative proportional fitting.

Built-in functions only. Tokens are summed by source, language and topic; raking scales
the cells of that small table until their shares have the target marginals. A document
then stays with its cell's probability, decided by a hash of its id, so a run can be
repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, small

DIMS = ("source", "lang", "topic")
ROUNDS = 12
#: Difference of a marginal's share from its target at which raking ends, and rounds at most.
SETTLED = 1e-6
MOST_ROUNDS = 60
#: Share of all tokens to keep, and the power of each marginal's shares that is the target.
KEEP = 0.8
POWER = {"source": 0.7, "lang": 0.7, "topic": 1.0}
#: Cells that may be broadcast.
BROADCAST_CELLS = 20_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\r]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """The form of a text: table, symbols, contact or prose; null is prose."""
    has = lambda s: F.contains(text, F.lit(s))
    return F.when(has(" | "), "table").when(has("***") | has("###") | has("&&&"), "symbols").when(has("@"), "contact").otherwise("prose")


def features(docs: DataFrame, text_col: str = "text", topic: Column | None = None) -> dict[str, Column]:
    return {"__source": F.coalesce(F.col("source").cast("string"), F.lit("unknown")), "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("unknown")), "__topic": F.coalesce(topic_of(F.col(text_col)) if topic is None else topic, F.lit("unknown")), "__tokens": token_count(F.col(text_col))}


def raked(cells: DataFrame, power: dict[str, float] = POWER, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``: their share under the targets.

    targets: by marginal the wanted shares of categories, as {"lang": {"en": 0.5, "de": 0.3}};
    categories left out share the rest in proportion to their tokens (nothing, if none is left).
    A marginal without stated shares has those of its tokens to the given power. Shares are
    scaled to 1. Categories without tokens can't be raised and have no part in the targets.
    There are ``rounds`` of raking, and more until no marginal is off its target by over
    SETTLED, MOST_ROUNDS at most: targets that contradict each other never settle. The last
    marginal holds exactly.
    """
    total = W.partitionBy(F.lit(1))
    out = cells.where("tokens > 0").withColumn("weight", F.col("tokens") / F.sum("tokens").over(total))
    for d in DIMS:
        first = F.row_number().over(W.partitionBy(d).orderBy(*DIMS)) == 1
        share = F.sum("weight").over(W.partitionBy(d))
        if stated := (targets or {}).get(d):
            table = F.create_map(*(F.lit(x) for pair in stated.items() for x in (str(pair[0]), float(pair[1]))))
            out = out.withColumns({"s": table[F.col(d)], "m": share, "one": first})
            sums = lambda c, where: F.coalesce(F.sum(F.when(F.col("one") & where, c)).over(total), F.lit(0.0))
            rest = F.greatest(1 - sums(F.col("s"), F.col("s").isNotNull()), F.lit(0.0))
            left = sums(F.col("m"), F.col("s").isNull())
            out = out.withColumn("t", F.coalesce("s", F.try_divide(F.col("m") * rest, left))).withColumn("f", F.when(F.col("one"), F.col("t")).otherwise(0.0)).drop("s", "m", "one")
        else:
            out = out.withColumn("t", F.pow(share, F.lit(float(power[d])))).withColumn("f", F.when(first, F.col("t")).otherwise(0.0))
        out = out.withColumn(f"target_{d}", F.coalesce(F.try_divide(F.col("t"), F.sum("f").over(total)), F.lit(0.0))).drop("t", "f")
    turn = 0
    while True:
        for d in DIMS:
            out = out.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"target_{d}"), F.sum("weight").over(W.partitionBy(d))), F.lit(0.0)))
        turn += 1
        if turn % 4 == 0 or turn >= rounds:
            out = saved(out)
            if turn >= rounds and (turn >= MOST_ROUNDS or off_target(out) <= SETTLED):
                return out


def off_target(weighed: DataFrame) -> float:
    """The most that a category's share differs from its target, over all marginals; one number to the driver."""
    each = [weighed.groupBy(d).agg(F.abs(F.sum("weight") - F.first(f"target_{d}")).alias("off")).select("off") for d in DIMS]
    return reduce(DataFrame.union, each).agg(F.max("off")).first()[0] or 0.0


def probabilities(cells: DataFrame, keep: float = KEEP, power: dict[str, float] = POWER, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(source, lang, topic, tokens, weight, prob): prob is 1 for the cells most in demand,
    and in proportion to weight / tokens for the others, so that ``keep`` of all tokens stay
    (fewer where cells whose target is 0, of probability 0, hold more than the rest).
    """
    w = raked(cells, power, rounds, targets).withColumn("ratio", F.col("weight") / F.col("tokens"))
    order = W.orderBy(F.desc("ratio"), *DIMS)
    done = F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    scaled = w.withColumns({"s": F.try_divide(keep * total - done, left), "at": F.row_number().over(order)})
    fits = F.when(F.col("s") * F.col("ratio") <= 1, F.struct("at", "s"))
    scale = F.min(fits).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["s"]
    return scaled.withColumn("scale", scale).select(*DIMS, "tokens", "weight", F.round(F.least(F.lit(1.0), F.coalesce(F.col("scale") * F.col("ratio"), F.when(F.col("ratio") > 0, 1.0).otherwise(0.0))), 6).alias("prob"))


def draw(key: Column) -> Column:
    """A number from 0 to 1 that depends on the key alone."""
    return F.conv(F.substr(F.md5(key.cast("string")), F.lit(1), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def decided(docs: DataFrame, keep: float = KEEP, power: dict[str, float] = POWER, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None) -> DataFrame:
    """``docs`` with __source, __lang, __topic, __tokens, __prob and __kept.

    targets: shares that the kept tokens should have, see ``raked``; topic: a Column in place of
    the form of the text. Null sources and languages are the category ``unknown``; a null id draws by its text.
    Documents without tokens are in no cell that is raked and stay. Rows that repeat an id
    share its draw.
    """
    base = docs.withColumns(features(docs, text_col, topic))
    cells = saved(base.groupBy("__source", "__lang", "__topic").agg(F.sum("__tokens").alias("tokens")).toDF(*DIMS, "tokens"))
    probs = saved(probabilities(cells, keep, power, rounds, targets))
    probs = small(probs.select(*(F.col(d).alias(f"__p_{d}") for d in DIMS), F.col("prob").alias("__p")), BROADCAST_CELLS)
    on = reduce(lambda a, b: a & b, (F.col(f"__{d}") == F.col(f"__p_{d}") for d in DIMS))
    out = base.join(probs, on, "left").drop(*(f"__p_{d}" for d in DIMS))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text_col), F.lit(""))))
    out = out.withColumn("__prob", F.when(F.col("__tokens") == 0, 1.0).otherwise(F.coalesce("__p", F.lit(1.0)))).drop("__p")
    return out.withColumn("__kept", draw(key) < F.col("__prob"))
