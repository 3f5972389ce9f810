"""Road networks as edge tables (src, dst, cost)."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """A table in the folder of ``spark.checkpoint.dir``, which cuts the lineage.

    Where that is unset, a local session makes a temporary folder; others must set it, for
    executors don't see the driver's own. The table goes by ``freed``, or when the application ends.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="parcelwise-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def freed(*tables: DataFrame) -> None:
    """Delete tables of ``kept`` that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(table._kept_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows that a shuffle deals to a task, at least, before ``spread`` takes more tasks.
TASK_ROWS = 1_000_000


@contextmanager
def spread(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside have a task for each TASK_ROWS of ``rows``, where the session sets fewer.

    The session's number of shuffle partitions is fixed, so that a task's memory grows with the tables. Its
    settings stand again afterwards; what is computed inside must be ``kept``, for a plan takes them when it runs.
    """
    name, most = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before, size = spark.conf.get(name), spark.conf.get(most, None)
    tasks = -(-rows // TASK_ROWS)
    if tasks <= int(before):
        yield
        return
    spark.conf.set(name, str(tasks))
    spark.conf.set(most, "16m")  # else Spark draws several of them together
    try:
        yield
    finally:
        spark.conf.set(name, before)
        if size is None:
            spark.conf.unset(most)
        else:
            spark.conf.set(most, size)


def timed(edges: DataFrame, speeds: dict[int, dict[str, float]], flag: str = "builtup", kind: str = "class", length: str = "length") -> DataFrame:
    """``edges`` with speed (km/h) and time (s); unknown classes have speed 0, and such edges go."""
    rows = [(int(f), k, float(v)) for f, m in speeds.items() for k, v in m.items()]
    table = F.create_map(*(x for f, k, v in rows for x in (F.lit(f"{f}|{k}"), F.lit(v))))
    speed = F.coalesce(table[F.concat_ws("|", F.col(flag).cast("int").cast("string"), F.col(kind))], F.lit(0.0))
    return edges.withColumn("speed", speed).where("speed > 0").withColumn("time", F.col(length) / F.col("speed") * 3.6)


def directed(edges: DataFrame, oneway: Column, cost: str = "cost") -> DataFrame:
    """(src, dst, cost) with both directions where ``oneway`` is false; the cheapest of parallel edges."""
    both = edges.select("src", "dst", F.col(cost).alias("cost")).union(edges.where(~F.coalesce(oneway, F.lit(False))).select("dst", "src", F.col(cost)))
    return both.where("cost is not null and src != dst").groupBy("src", "dst").agg(F.min("cost").alias("cost"))


#: Tables of changed costs before they are drawn together.
LOGGED = 6
#: Targets whose costs stand side by side in a row.
BLOCK = 32
#: Edges for each vertex, on average, that are tried before the others: the cheapest.
LIGHT = 8
#: Edges up to which all are relaxed from the start: more rounds would cost more than they spare.
FEW = 2_000_000
_INF = float("inf")


def _light(back: DataFrame, edges: int) -> DataFrame | None:
    """The cheapest of the edges, about LIGHT for each vertex, where that is much less than all."""
    if edges <= FEW:
        return None
    vertices = back.agg(F.approx_count_distinct("v")).first()[0]
    if edges <= 2 * LIGHT * vertices:
        return None
    out = kept(back.where(F.col("c") <= back.approxQuantile("c", [LIGHT * vertices / edges], 0.005)[0]))
    if 2 * out.count() <= edges:
        return out
    freed(out)
    return None


def cost_matrix(edges: DataFrame, targets: DataFrame, target: str = "target", rounds: int = 10_000, width: float | None = None) -> DataFrame:
    """(target, v, cost): the cheapest way from each vertex to each of a few targets; costs of edges aren't negative.

    A vertex has a row for each BLOCK targets, with a cost for each of them. The reversed edges are relaxed from a
    frontier. A round writes only the costs that it lowered; a vertex's cost is the least of those written, and now
    and then the tables are drawn together and the old ones deleted. It ends when nothing gets cheaper, and raises
    an error if that takes more than ``rounds`` rounds (edges of a way, at least).

    Where there are more than FEW edges, and many to a vertex, the cheapest ones are relaxed to the end first. Then all others take their
    turn, but those that cost no less than any way already found to the vertex they lead to: none can
    make it cheaper. A vertex that some target hasn't reached keeps all its edges.

    width: the frontier takes the lowest costs first, a span of so much at a time, and
    goes on when nothing within the span gets cheaper, so that hardly a vertex is relaxed twice; all edges take
    part from the start. Without it everything that got cheaper goes on at once.
    """
    spark = edges.sparkSession
    goals = kept(targets.select(F.col(target).alias("target")).where("target is not null").distinct())
    n = goals.count()
    number = kept(spark.createDataFrame(goals.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])), f"target {goals.schema['target'].dataType.simpleString()}, i long"))
    costs = [f"d{k}" for k in range(max(1, min(n, BLOCK)))]
    lowest = lambda cols: F.least(*cols) if len(cols) > 1 else cols[0]
    low_of = lowest([F.col(d) for d in costs])
    # Columns that every round takes.
    mins, longer = [F.min(d).alias(d) for d in costs], [F.min(F.col(d) + F.col("c")).alias(d) for d in costs]
    was = [F.expr(f"{d} AS old_{d}") for d in costs]
    lowered = [F.expr(f"CASE WHEN old_{d} IS NULL OR {d} < old_{d} THEN {d} ELSE double('Infinity') END AS {d}") for d in costs]

    def least(log: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, log).groupBy("b", "v").agg(*mins)

    def within(df: DataFrame, begin: float, end: float) -> DataFrame:
        """Costs from ``begin`` to under ``end`` alone."""
        return df.select("b", "v", *(F.when((F.col(d) >= begin) & (F.col(d) < end), F.col(d)).otherwise(_INF).alias(d) for d in costs)).where(low_of < _INF)

    def roomy(back: DataFrame, state: DataFrame) -> DataFrame:
        """Edges that cost less than the dearest way found to where they lead (``room``)."""
        highest = [F.when(F.col("b") * BLOCK + k < n, F.col(d)).otherwise(0.0) for k, d in enumerate(costs)]
        far = state.groupBy(F.col("v").alias("src")).agg(F.max(F.greatest(*highest) if len(highest) > 1 else highest[0]).alias("far"), F.count(F.lit(1)).alias("blocks"))
        room = F.when(F.col("blocks") == -(-n // BLOCK), F.col("far")).otherwise(_INF)
        return back.join(far, "src", "left").select("v", "src", "c", room.alias("room")).where("c < room")

    back = kept(edges.select(F.col("dst").alias("v"), "src", F.col("cost").cast("double").alias("c")))
    m = back.count()
    with spread(spark, m):
        light = _light(back, m) if width is None else None
        whole = light is None
        used = (back if whole else light).withColumn("room", F.lit(_INF))
        block, place = F.floor(F.col("i") / BLOCK).cast("int").alias("b"), F.col("i") % BLOCK
        log = [kept(number.select(block, F.col("target").alias("v"), *(F.when(place == k, 0.0).otherwise(_INF).alias(d) for k, d in enumerate(costs))))]
        frontier, end = log[0], width
        for _ in range(rounds):
            reached = frontier.join(used, "v").where(low_of + F.col("c") < F.col("room"))
            step = reached.groupBy("b", F.col("src").alias("v")).agg(*longer)
            old = least(log).select("b", "v", *was)
            fresh = kept(step.join(old, ["b", "v"], "left").select("b", "v", *lowered).where(low_of < _INF))
            log.append(fresh)
            low = fresh.agg(F.min(low_of)).first()[0]
            if len(log) > LOGGED:
                drawn = kept(least(log))
                freed(*log[:-1])
                log = [drawn, fresh]
            if width is None:
                frontier = fresh
            elif low is not None and low < end:
                frontier = within(fresh, -_INF, end)
            else:  # nothing within the span is left: on to the next costs that haven't been relaxed
                low = within(least(log), end, _INF).agg(F.min(low_of)).first()[0]
                if low is not None:
                    begun, end = end, low + width
                    frontier = within(least(log), begun, end)
            if low is None and not whole:  # the light edges are done: on to the others
                whole, frontier = True, kept(least(log))
                used = kept(roomy(back, frontier))
                freed(light, *log)
                log = [frontier]
            elif low is None:
                known = least(log).select("v", "b", F.posexplode(F.array(*costs)).alias("k", "cost")).where(F.col("cost") < _INF)
                out = kept(known.join(F.broadcast(number), F.col("b") * BLOCK + F.col("k") == F.col("i")).select("target", "v", "cost"))
                freed(*log, back, goals, number, *([used] if light is not None else []))
                return out
    raise RuntimeError(f"costs still fall after {rounds} rounds; give more rounds")


def accessibility(costs: DataFrame, origins: DataFrame, origin: str = "v") -> DataFrame:
    """(origin, access): mean of all medians over the own median cost; unreached origins 0."""
    wanted = origins.select(F.col(origin).alias("v")).distinct()
    with spread(costs.sparkSession, costs.count()):
        own = kept(costs.select("v", "cost").join(wanted, "v", "left_semi").groupBy(F.col("v").alias(origin)).agg(F.median("cost").alias("m")))
    mean = own.agg(F.avg("m").alias("mean"))
    rated = own.crossJoin(F.broadcast(mean)).select(origin, F.coalesce(F.try_divide("mean", "m"), F.lit(0.0)).alias("access"))
    return origins.select(origin).distinct().join(rated, origin, "left").select(origin, F.coalesce("access", F.lit(0.0)).alias("access"))
