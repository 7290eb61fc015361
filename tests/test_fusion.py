import math

import numpy as np
import pytest

from partloom.config import FusionConfig
from partloom.operators import fusion
from tests.test_neighbors import brute


def long_scores(objects):
    return [
        (obj, part, name, point, float(matrix[part][point]), int(visible[point]))
        for obj, (names, matrix, visible, _) in objects.items()
        for part, name in enumerate(names)
        for point in range(len(visible))
    ]


SCHEMA = "object_id bigint, part_idx bigint, part_name string, point_idx bigint, score double, visible_count bigint"


def scene(seed, points=120, parts=3):
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(0, 1, (points, 3))
    matrix = np.zeros((parts, points))
    for part in range(parts):
        centre = rng.uniform(0, 1, 3)
        near = np.linalg.norm(xyz - centre, axis=1) < 0.35
        matrix[part] = np.where(near & (rng.random(points) < 0.7), rng.choice([0.1, 0.4, 1.0], points), 0.0)
    visible = (rng.random(points) < 0.8).astype(int)
    return [f"part{p}" for p in range(parts)], matrix, visible, xyz


def brute_prune(names, matrix, cfg):
    sizes = [int((row > 0).sum()) for row in matrix]
    order = sorted(range(len(names)), key=lambda i: (sizes[i], names[i], i))
    kept, blamed = [], {}
    for part in order:
        rivals = [
            base
            for base in kept
            if sizes[base] > 0
            and sizes[part] > 0
            and abs(sizes[base] - sizes[part]) / max(sizes[base], sizes[part]) < cfg.duplicate_part_count_tolerance
            and ((matrix[base] > 0) & (matrix[part] > 0)).sum() / min(sizes[base], sizes[part]) > cfg.duplicate_part_overlap_threshold
        ]
        if rivals:
            blamed[part] = rivals[0]
        else:
            kept.append(part)
    return set(kept), blamed


def test_prune_follows_the_greedy_order(spark):
    cfg = FusionConfig()
    rng = np.random.default_rng(5)
    objects = {}
    for obj in range(6):
        # Chains: each part is the one before with a few points more, so dropped parts must not drop others.
        matrix = np.zeros((8, 200))
        for part in range(8):
            start = part * 4 if obj % 2 else int(rng.integers(0, 60))
            matrix[part, start : start + 40 + part] = 1.0
        matrix[7] = 0.0
        objects[obj] = ([f"p{(part * 3) % 8}" for part in range(8)], matrix, np.ones(200, int), None)
    df = spark.createDataFrame(long_scores(objects), SCHEMA)
    got = {(r["object_id"], r["part_idx"]): (r["kept"], r["base_idx"]) for r in fusion.prune_duplicates(df, cfg).collect()}
    dropped = 0
    for obj, (names, matrix, _, _) in objects.items():
        kept, blamed = brute_prune(names, matrix, cfg)
        dropped += len(blamed)
        for part in range(len(names)):
            assert got[(obj, part)] == (part in kept, blamed.get(part))
    assert dropped > 3


def brute_fill(matrix, visible, xyz, cfg):
    """Round by round over dense arrays."""
    n = len(visible)
    listed = brute([(0, i, *xyz[i]) for i in range(n)], cfg.hole_fill_knn_k)
    spacing = np.median([listed[(0, i)][0][0] for i in range(n)])
    near = {i: [j for dist, j in listed[(0, i)] if dist <= spacing * cfg.hole_fill_max_distance_factor] for i in range(n)}
    unknown = (visible <= 0) | (matrix.max(axis=0) < cfg.score_threshold)
    fills = {}
    for part, row in enumerate(matrix):
        state = {i: row[i] for i in range(n) if row[i] > 0}
        seeds = set(state)
        for turn in range(1, cfg.hole_fill_max_iterations + 1):
            added = {}
            for i in range(n):
                if not unknown[i] or i in state or len(near[i]) < cfg.hole_fill_min_support_neighbors:
                    continue
                support = [j for j in near[i] if j in state]
                if len(support) < max(cfg.hole_fill_min_support_neighbors, math.ceil(len(near[i]) * cfg.hole_fill_min_support_ratio)):
                    continue
                sure = [j for j in support if j in seeds] or support
                added[i] = sum(state[j] for j in sure) / len(sure)
            if not added:
                break
            state.update(added)
            fills.update({(part, i): (v, turn) for i, v in added.items()})
    return fills


@pytest.mark.parametrize("cfg", [FusionConfig(hole_fill_knn_k=8, hole_fill_max_distance_factor=2.5), FusionConfig(hole_fill_knn_k=6, hole_fill_max_iterations=2)])
def test_fill_matches_dense_rounds(spark, cfg):
    objects = {obj: scene(obj) for obj in range(3)}
    df = spark.createDataFrame(long_scores(objects), SCHEMA)
    points = spark.createDataFrame(
        [(obj, i, *map(float, p)) for obj, (_, _, _, xyz) in objects.items() for i, p in enumerate(xyz)],
        "object_id bigint, point_idx bigint, x double, y double, z double",
    )
    got = {(r["object_id"], r["part_idx"], r["point_idx"]): (r["fill_score"], r["round"]) for r in fusion.fill_holes(df, points, cfg).collect()}
    want = {
        (obj, *key): value
        for obj, (_, matrix, visible, xyz) in objects.items()
        for key, value in brute_fill(matrix, visible, xyz, cfg).items()
    }
    assert set(got) == set(want)
    assert max(turn for _, turn in want.values()) >= 2
    for key, (value, turn) in want.items():
        assert got[key][1] == turn and math.isclose(got[key][0], value, rel_tol=1e-12)


def test_fill_can_be_off(spark):
    df = spark.createDataFrame(long_scores({0: scene(0)}), SCHEMA)
    points = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0)], "object_id bigint, point_idx bigint, x double, y double, z double")
    assert fusion.fill_holes(df, points, FusionConfig(hole_fill_enabled=False)).count() == 0


def test_fused_points_that_no_view_saw_stay_unknown(spark):
    cfg = FusionConfig(hole_fill_knn_k=8, hole_fill_max_distance_factor=2.5)
    names, matrix, visible, xyz = scene(1)
    df = spark.createDataFrame(long_scores({0: (names, matrix, visible, xyz)}), SCHEMA)
    points = spark.createDataFrame(
        [(0, i, *map(float, p)) for i, p in enumerate(xyz)], "object_id bigint, point_idx bigint, x double, y double, z double"
    )
    fused = fusion.fuse_labels(df, points, cfg).collect()
    assert len(fused) == len(visible)
    healed = [r for r in fused if r["filled"]]
    assert healed and all(r["initial_unknown"] for r in healed)
    assert all(r["unknown"] for r in fused if r["visible_count"] <= 0)
    assert any(r["visible_count"] <= 0 and r["max_score"] >= 0.3 for r in healed)


def test_scores_that_are_no_numbers_count_for_nothing(spark):
    rows = [(1, 0, "a", 0, float("nan"), 1), (1, 0, "a", 1, 0.5, 1), (1, 0, "a", 2, float("inf"), 1), (1, 1, "b", 0, 0.5, 1), (1, 1, "b", 1, 0.5, 1)]
    scores = spark.createDataFrame(rows, SCHEMA)
    assert {r["part_idx"]: r["point_count"] for r in fusion.part_counts(scores).collect()} == {0: 1, 1: 2}
    assert [r["overlap_count"] for r in fusion.part_overlap(scores).collect()] == [1]


def test_points_of_objects_without_parts_are_unknown(spark):
    points = spark.createDataFrame([(o, i, float(i), float(o), 0.0) for o in (1, 2) for i in range(5)], "object_id bigint, point_idx bigint, x double, y double, z double")
    scores = spark.createDataFrame([(1, 0, "a", i, 0.9, 1) for i in range(5)], SCHEMA)
    got = fusion.fuse_labels(scores, points).collect()
    assert len(got) == 10
    for r in (r for r in got if r["object_id"] == 2):
        assert (r["best_part"], r["max_score"], r["low_confidence"], r["unknown"], r["initial_unknown"], r["filled"]) == (-1, 0.0, True, True, True, False)


def test_prune_follows_a_long_chain(spark):
    """Parts that each duplicate the next: every round settles one, and plans don't grow with them."""
    parts = 12
    rows = [(1, p, f"p{p:03d}", i, 1.0, 1) for p in range(parts) for i in range(p, p + 40)]
    cfg = FusionConfig()
    got = {r["part_idx"]: r["kept"] for r in fusion.prune_duplicates(spark.createDataFrame(rows, SCHEMA), cfg).collect()}
    names, matrix = [f"p{p:03d}" for p in range(parts)], np.zeros((parts, parts + 40))
    for p in range(parts):
        matrix[p, p : p + 40] = 1.0
    kept = brute_prune(names, matrix, cfg)[0]
    assert {p for p, k in got.items() if k} == set(kept)


def settle_by_hand(parts, rivals):
    kept = {}
    for p in sorted(parts):
        kept[p] = not any(kept[b] for b in rivals.get(p, ()))
    return kept


@pytest.mark.parametrize("shape", ["chain", "band", "random"])
def test_rivals_settle_in_few_rounds(spark, shape, monkeypatch):
    """Rounds follow the logarithm of a chain: 200 parts that each wait for the one before take at most 10."""
    rng = np.random.default_rng(3)
    n = 200 if shape == "chain" else 120
    rivals = {
        "chain": {p: [p - 1] for p in range(1, n)},
        "band": {p: list(range(max(0, p - 7), p)) for p in range(1, n)},
        "random": {p: sorted(set(rng.integers(0, p, rng.integers(1, 4)).tolist())) for p in range(1, n) if rng.random() < 0.9},
    }[shape]
    rounds = []

    class Counted(fusion.Flagged):
        def __init__(self, *args):
            rounds.append(args)
            super().__init__(*args)

    monkeypatch.setattr(fusion, "Flagged", Counted)
    parts = spark.createDataFrame([(1, p) for p in range(n)], "object_id bigint, part_idx bigint")
    pairs = spark.createDataFrame([(1, p, b) for p, own in rivals.items() for b in own], "object_id bigint, part_idx bigint, base_idx bigint")
    got = {r["part_idx"]: r["kept"] for r in fusion.settle_rivals(parts, pairs).collect()}
    assert got == settle_by_hand(range(n), rivals)
    assert len(rounds) - 1 <= (10 if shape == "chain" else 40)


def test_a_round_of_filling_is_three_jobs(spark):
    """One exchange, one small side sent to all tasks, one write; whether to go on is no job."""
    cfg = FusionConfig(hole_fill_knn_k=8, hole_fill_max_distance_factor=2.5)
    names, matrix, visible, xyz = scene(1)
    df = spark.createDataFrame(long_scores({0: (names, matrix, visible, xyz)}), SCHEMA)
    points = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(xyz)], "object_id bigint, point_idx bigint, x double, y double, z double")
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()

    def jobs(turns):
        group = f"fill-{turns}"
        context.setJobGroup(group, group)
        fusion.fill_holes(df, points, FusionConfig(**{**vars(cfg), "hole_fill_max_iterations": turns})).count()
        context.setJobGroup("rest", "rest")
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(3) - jobs(2) <= 3
