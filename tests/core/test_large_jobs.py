"""Jobs on large tables take more tasks than the session's, and give the same rows."""

import heapq
import random

import pytest

from parcelwise.jobs import network_queries, queries
from parcelwise.operators import allocate, network

SF = "/root/testdata/sf0.001"
PARTS = "spark.sql.shuffle.partitions"


def _tasks_of_kept(spark, monkeypatch, module, name, fn):
    """Shuffle partitions that stand when ``fn`` keeps tables, where a task takes 100 rows."""
    seen, plain = [], network.kept
    monkeypatch.setattr(network, "TASK_ROWS", 100)
    monkeypatch.setattr(module, name, lambda df: seen.append(int(spark.conf.get(PARTS))) or plain(df))
    before = spark.conf.get(PARTS)
    rows = sorted(map(str, fn(spark, SF).collect()))
    assert spark.conf.get(PARTS) == before
    monkeypatch.undo()
    assert rows == sorted(map(str, fn(spark, SF).collect()))
    return seen


def test_settings_stand_again(spark, monkeypatch):
    before, size = spark.conf.get(PARTS), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    with network.spread(spark, 10):
        assert spark.conf.get(PARTS) == before
    with pytest.raises(KeyError), network.spread(spark, 99_000_001):
        assert spark.conf.get(PARTS) == "100"
        raise KeyError
    assert (spark.conf.get(PARTS), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)) == (before, size)


def test_way_assembly_has_tasks_by_rows(spark, monkeypatch):
    rows = queries.t(spark, SF, "lineitem").count()
    for fn in (queries.way_assembly, network_queries.tagged_ways):
        assert _tasks_of_kept(spark, monkeypatch, network, "kept", fn) == [-(-rows // 100)]


def test_error_measures_have_tasks_by_rows(spark, monkeypatch):
    rows = queries.t(spark, SF, "lineitem").count()
    assert _tasks_of_kept(spark, monkeypatch, allocate, "kept", queries.error_measures) == [-(-rows // 100)]
    assert _tasks_of_kept(spark, monkeypatch, network, "kept", queries.allocate_orders) == [-(-rows // 100)]


def _dijkstra(edges, goal):
    into, best, todo = {}, {}, [(0.0, goal)]
    for a, b, c in edges:
        into.setdefault(b, []).append((a, c))
    while todo:
        cost, v = heapq.heappop(todo)
        if v not in best:
            best[v] = cost
            for a, c in into.get(v, []):
                heapq.heappush(todo, (cost + c, a))
    return {(goal, v): c for v, c in best.items()}


@pytest.mark.parametrize("block", [3, 32])
def test_costs_where_vertices_have_many_edges(spark, monkeypatch, block):
    """Two parts of 40 vertices with 20 edges each way: light edges first, few of the others after them, and no way lost."""
    draw = random.Random(7)
    edges = [(40 * part + a, 40 * part + b, float(draw.randint(1, 40))) for part in range(2) for a in range(40) for b in draw.sample(range(40), 20) if a != b]
    edges += [(80, 0, 900.0), (80, 1, 950.0), (0, 81, 0.0), (81, 80, 1.0)]  # dear edges that are the only way
    monkeypatch.setattr(network, "BLOCK", block)
    monkeypatch.setattr(network, "LIGHT", 3)
    monkeypatch.setattr(network, "FEW", 0)
    sizes, plain = [], network.kept
    monkeypatch.setattr(network, "kept", lambda df: sizes.append(df.count()) or plain(df) if set(df.columns) == {"v", "src", "c", "room"} else plain(df))
    goals = [3, 11, 19, 27]
    df = spark.createDataFrame(edges, "src long, dst long, cost double")
    want = {k: c for goal in goals for k, c in _dijkstra(edges, goal).items()}
    rows = network.cost_matrix(df, spark.createDataFrame([(g,) for g in goals], "target long")).collect()
    assert {(r["target"], r["v"]): r["cost"] for r in rows} == want and len(rows) == len(want)
    both = {k: c for goal in (3, 50) for k, c in _dijkstra(edges, goal).items()}
    found = network.cost_matrix(df, spark.createDataFrame([(3,), (50,)], "target long")).collect()
    assert {(r["target"], r["v"]): r["cost"] for r in found} == both, "no target is reached from both parts"
    assert len(sizes) == 2 and sizes[0] < len(edges) * 0.8, "of the part with all targets only edges that can matter are left"


def test_accessibility_has_tasks_by_rows(spark, monkeypatch):
    costs = spark.createDataFrame([(t, v, float(t + v)) for t in range(3) for v in range(200)], "target long, v long, cost double")
    origins = spark.range(150).select("id")
    seen, plain = [], network.kept
    monkeypatch.setattr(network, "TASK_ROWS", 100)
    monkeypatch.setattr(network, "kept", lambda df: seen.append(spark.conf.get(PARTS)) or plain(df))
    got = {r["id"]: r["access"] for r in network.accessibility(costs, origins, "id").collect()}
    assert seen == ["6"] and len(got) == 150 and got[0] == pytest.approx(sum(1 + v for v in range(150)) / 150)
