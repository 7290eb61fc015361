import numpy as np
import pytest

from partloom.operators import neighbors


def brute(points, k):
    """Neighbours by looking at every pair; ties go to the lower index, the first hit counts as the point itself."""
    out = {}
    for obj in {p[0] for p in points}:
        own = [p for p in points if p[0] == obj]
        for p in own:
            reach = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(p[2:], q[2:])))), q[1]) for q in own)
            out[(obj, p[1])] = reach[1 : k + 1]
    return out


def clouds():
    rng = np.random.default_rng(0)
    rows = []

    def add(obj, xyz):
        for p in xyz:
            rows.append((obj, len(rows), *[float(v) for v in p]))

    # A dense heap inside a wide sparse cloud, a heap of copies, a line, one lone point, a small object.
    add(1, np.concatenate([rng.normal(0, 1e-4, (150, 3)), rng.uniform(-5, 5, (80, 3))]))
    add(2, np.concatenate([np.zeros((120, 3)), rng.uniform(-1, 1, (40, 3))]))
    add(3, np.stack([np.linspace(0, 1, 90), np.zeros(90), np.zeros(90)], axis=1))
    add(4, [(1.0, 2.0, 3.0)])
    add(5, rng.normal(0, 1, (6, 3)))
    return rows


@pytest.mark.parametrize("k, leaf", [(1, 256), (8, 256), (1, 2), (8, 10), (4, 30)])
def test_neighbors_match_all_pairs(spark, k, leaf):
    rows = clouds()
    df = spark.createDataFrame(rows, "object_id bigint, point_idx bigint, x double, y double, z double")
    found = {}
    for r in neighbors.nearest_neighbors(df, k, leaf).collect():
        found.setdefault((r["object_id"], r["point_idx"]), {})[r["rank"]] = (r["distance"], r["neighbor_idx"])
    want = brute(rows, k)
    for key, expected in want.items():
        got = [found.get(key, {}).get(i + 1) for i in range(len(expected))]
        assert [g[1] for g in got] == [e[1] for e in expected], key
        assert np.allclose([g[0] for g in got], [e[0] for e in expected])
        assert len(found.get(key, {})) == len(expected)


def test_spacing_skips_heaps_of_copies(spark):
    rows = clouds()
    df = spark.createDataFrame(rows, "object_id bigint, point_idx bigint, x double, y double, z double")
    found = {r["object_id"]: r["local_spacing"] for r in neighbors.local_spacing(neighbors.nearest_neighbors(df, 1)).collect()}
    # Most points of object 2 are copies, so its median spacing is 0 and it drops out; object 4 has no neighbours.
    assert set(found) == {1, 3, 5}
    want = brute(rows, 1)
    for obj, spacing in found.items():
        assert np.isclose(spacing, np.median([v[0][0] for (o, _), v in want.items() if o == obj]))


def test_cells_are_bounded_by_count(spark):
    """However the points spread: far points, a dense cluster, a grid full of ties, points that share an axis."""
    rng = np.random.default_rng(1)
    clouds = {
        1: np.concatenate([rng.uniform(0, 1, (700, 3)), [[1e30, 1e30, 1e30], [-1e300, 0, 0]]]),
        2: np.concatenate([rng.normal(0, 1e-12, (500, 3)), rng.uniform(-1, 1, (100, 3))]),
        3: np.stack(np.meshgrid(*[np.arange(9.0)] * 3), axis=-1).reshape(-1, 3),
        4: np.stack([np.zeros(300), np.where(np.arange(300) < 299, 1.0, 0.0), np.arange(300.0)], axis=1),
        5: rng.uniform(0, 1, (5, 3)),
    }
    rows = [(o, *map(float, p)) for o, xyz in clouds.items() for p in np.unique(xyz, axis=0)]
    placed, tree, depth = neighbors.count_split(spark.createDataFrame(rows, "object_id bigint, x double, y double, z double"), "bigint", 20)
    sizes = {(r["object_id"], r["cell"]): r["count"] for r in placed.groupBy("object_id", "cell").count().collect()}
    assert max(sizes.values()) <= 20 and sum(sizes.values()) == len(rows) and depth <= 8
    cells = {(r["object_id"], r["cell"]): r for r in tree.read().collect()}
    for (obj, cell), r in cells.items():
        inside = [n for (o, c), n in sizes.items() if o == obj and c.startswith(cell)]
        assert r["places"] == sum(inside)


@pytest.mark.parametrize("shape", ["far", "grid", "cluster"])
def test_neighbors_in_trees_of_cells(spark, shape):
    rng = np.random.default_rng(2)
    xyz = {
        "far": np.concatenate([rng.uniform(0, 1, (600, 3)), [[1e6, 1e6, 1e6], [1e18, 0, 0]]]),
        "grid": np.stack(np.meshgrid(*[np.arange(8.0)] * 3), axis=-1).reshape(-1, 3),
        "cluster": np.concatenate([rng.normal(0, 1e-9, (400, 3)), rng.uniform(-1, 1, (150, 3)), np.full((60, 3), 0.5)]),
    }[shape]
    rows = [(1, i, *map(float, p)) for i, p in enumerate(xyz)]
    schema = "object_id bigint, point_idx bigint, x double, y double, z double"
    got = {}
    for r in neighbors.nearest_neighbors(spark.createDataFrame(rows, schema), 4, 16).collect():
        got.setdefault(r["point_idx"], {})[r["rank"]] = r["neighbor_idx"]
    want = brute(rows, 4)
    assert all([got[i][k + 1] for k in range(4)] == [n for _, n in want[(1, i)]] for i in range(len(rows)))


def test_points_without_a_place_have_no_neighbors(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, float("nan"), 0.0, 0.0), (1, 3, None, 0.0, 0.0), (1, 4, float("inf"), 0.0, 0.0)]
    got = neighbors.nearest_neighbors(spark.createDataFrame(rows, "object_id bigint, point_idx bigint, x double, y double, z double"), 3).collect()
    assert {(r["point_idx"], r["neighbor_idx"], r["distance"]) for r in got} == {(0, 1, 1.0), (1, 0, 1.0)}
    assert neighbors.nearest_neighbors(spark.createDataFrame([], "object_id bigint, point_idx bigint, x double, y double, z double"), 3).count() == 0


def test_the_search_in_cells_is_spread_over_tasks(spark, monkeypatch):
    """The rows of cells are few and small, their work is not."""
    files, store = {}, neighbors.checkpointed

    def counted(df, name="step"):
        stored = store(df, name)
        files[name] = sum(n > 0 for n in stored.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) if name == "own-cell" else 0
        return stored

    monkeypatch.setattr(neighbors, "checkpointed", counted)
    points = spark.range(1500).selectExpr("1L AS object_id", "id AS point_idx", "rand(1) AS x", "rand(2) AS y", "rand(3) AS z")
    assert neighbors.nearest_neighbors(points, 4).count() == 1500 * 4 and files["own-cell"] > 4


def test_many_copies_and_single_points_in_one_cell(spark):
    """Copies beyond k + 1 a place, ties between places, and single points."""
    places = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 2.0, 0.0)]
    rows = [(1, i, *places[i % 3]) for i in range(60)] + [(1, 60, *places[3])]
    got = {}
    for r in neighbors.nearest_neighbors(spark.createDataFrame(rows, "object_id int, point_idx int, x double, y double, z double"), 25).collect():
        got.setdefault(r["point_idx"], {})[r["rank"]] = r["neighbor_idx"]
    for _, i, *p in rows:
        order = sorted((sum((a - b) ** 2 for a, b in zip(p, q)), j) for _, j, *q in rows)
        assert [got[i][n] for n in range(1, 26)] == [j for _, j in order[1:26]]


def test_other_cells_are_met_place_by_place(spark, monkeypatch):
    """No visit maps and sorts the whole list of a cell, and no more than the wanted places are gathered."""
    plans, store = {}, neighbors.checkpointed

    def kept(df, name="step"):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return store(df, name)

    monkeypatch.setattr(neighbors, "checkpointed", kept)
    rng = np.random.default_rng(4)
    xyz = np.repeat(rng.uniform(0, 1, (150, 3)), 3, axis=0)
    rows = [(1, i, *map(float, p)) for i, p in enumerate(xyz)]
    got = {}
    for r in neighbors.nearest_neighbors(spark.createDataFrame(rows, "object_id bigint, point_idx bigint, x double, y double, z double"), 7, 16).collect():
        got.setdefault(r["point_idx"], {})[r["rank"]] = r["neighbor_idx"]
    want = brute(rows, 7)
    assert all([got[i][k + 1] for k in range(7)] == [n for _, n in want[(1, i)]] for i in range(len(rows)))
    assert "transform(_places" not in plans["nearest"] and "WindowGroupLimit" in plans["nearest"]
