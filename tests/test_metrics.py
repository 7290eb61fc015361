import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.operators import metrics as met


def samples(seed=0):
    """Many ties, one long sample, one without positives, one without negatives."""
    rng = random.Random(seed)
    rows = []
    for sample, n in ((1, 700), (2, 60), (3, 40), (4, 30)):
        for pos in range(n):
            target = 0.0 if sample == 3 else 1.0 if sample == 4 else rng.choice([0.0, 0.0, 0.4, 1.0])
            rows.append((sample, f"c{sample % 2}", pos, rng.choice([0.0, 0.2, 0.5, 0.5, round(rng.random(), 3), 1.0]), target))
    return rows


SCHEMA = "sample_id bigint, category string, pos bigint, prob double, target double"


def brute_ap(rows):
    ordered = sorted(rows, key=lambda r: (-r[3], r[2]))
    hits, total = 0, []
    for n, r in enumerate(ordered, 1):
        if r[4] > 1e-6:
            hits += 1
            total.append(hits / n)
    return sum(total) / len(total) if total else 0.0


def brute_roc(rows):
    pos = [r[3] for r in rows if r[4] > 1e-6]
    neg = [r[3] for r in rows if r[4] <= 1e-6]
    if not pos or not neg:
        return 0.0
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_curves_with_ties(spark):
    rows = samples()
    df = spark.createDataFrame(rows, SCHEMA)
    ap = {r["sample_id"]: r["pr_auc"] for r in met.average_precision(df).collect()}
    roc = {r["sample_id"]: r["roc_auc"] for r in met.roc_auc(df).collect()}
    for sample in (1, 2, 3, 4):
        own = [r for r in rows if r[0] == sample]
        assert math.isclose(ap[sample], brute_ap(own), abs_tol=1e-12)
        assert math.isclose(roc[sample], brute_roc(own), abs_tol=1e-12)
    assert ap[3] == 0.0 and roc[3] == 0.0 and roc[4] == 0.0


def test_ordinal_auc(spark):
    rows = samples(1)
    df = spark.createDataFrame(rows, SCHEMA)
    order = sorted(rows, key=lambda r: (r[3], r[0], r[2]))
    ranks = [i for i, r in enumerate(order, 1) if r[4] > 0.5]
    p, n = len(ranks), len(rows)
    want = (sum(ranks) - p * (p + 1) / 2) / (p * (n - p))
    assert math.isclose(met.basic_auc(df).first()["auc"], want, rel_tol=1e-12)
    per = {r["category"]: r["auc"] for r in met.basic_auc(df, keys=["category"]).collect()}
    for category in ("c0", "c1"):
        order = sorted((r for r in rows if r[1] == category), key=lambda r: (r[3], r[0], r[2]))
        ranks = [i for i, r in enumerate(order, 1) if r[4] > 0.5]
        p, n = len(ranks), len(order)
        assert math.isclose(per[category], (sum(ranks) - p * (p + 1) / 2) / (p * (n - p)), rel_tol=1e-12)
    one_class = met.basic_auc(df.filter("sample_id = 3")).first()["auc"]
    assert math.isnan(one_class)


def test_soft_metrics_clip_but_mae_does_not(spark):
    df = spark.createDataFrame([(1, "c", 0, 1.5, 2.0), (1, "c", 1, 0.25, 0.0)], SCHEMA)
    row = met.formal_soft(df).first()
    assert row["weighted_iou"] == pytest.approx(1 / 1.25) and row["weighted_mae"] == 0.0
    assert row["mae"] == pytest.approx((0.5 + 0.25) / 2)
    assert row["support_score_mean"] == 1.0 and row["background_score_mean"] == 0.25


def test_similarity_of_empty_maps(spark):
    df = spark.createDataFrame([(1, "c", 0, 0.0, 0.0), (2, "c", 0, 0.3, 0.0), (3, "c", 0, 0.3, 0.9)], SCHEMA)
    assert {r["sample_id"]: r["sim"] for r in met.similarity(df).collect()} == {1: 1.0, 2: 0.0, 3: 1.0}


def test_two_ways_to_treat_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0), ("a", nan), ("a", 3.0), ("b", nan)], "k string, v double")
    merged = {r["k"]: r["v"] for r in met.merge_metrics(df, ["k"], "v").collect()}
    reduced = {r["k"]: r["v"] for r in met.reduce_metrics(df, ["k"], "v").collect()}
    assert merged["a"] == 2.0 and math.isnan(merged["b"])
    assert reduced["a"] == pytest.approx(4 / 3) and reduced["b"] == 0.0


def test_later_epoch_wins_ties(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("a", 3, nan), ("a", 4, 0.1), ("b", 1, nan)], "run string, epoch bigint, v double")
    best = met.best_epoch(df, ["run"], "v").collect()
    assert [(r["run"], r["best_epoch"], r["best_value"]) for r in best] == [("a", 2, 0.5)]
    assert met.best_epoch(df, ["run"], "v", "min").first()["best_epoch"] == 4
    with pytest.raises(ValueError):
        met.best_epoch(df, ["run"], "v", "mean")


def test_align_to_the_shorter_array(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2, 0.3], [1.0, 0.0])], "sample_id bigint, prob array<double>, target array<double>")
    assert [tuple(r) for r in met.align_arrays(df).orderBy("pos").collect()] == [(1, 0, 0.1, 1.0), (1, 1, 0.2, 0.0)]


def test_micro_metrics(spark):
    rows = samples(2)
    df = spark.createDataFrame(rows, SCHEMA)
    row = met.basic_metrics(df).first()
    hit = np.array([r[3] >= 0.5 for r in rows])
    label = np.array([r[4] > 0.5 for r in rows])
    assert math.isclose(row["iou"], (hit & label).sum() / (hit | label).sum())
    assert math.isclose(row["mae"], np.abs(np.array([r[3] for r in rows]) - label).mean())
    ious = []
    for category in ("c0", "c1"):
        own = np.array([r[1] == category for r in rows])
        ious.append((hit & label & own).sum() / max(((hit | label) & own).sum(), 1))
    assert math.isclose(row["miou"], sum(ious) / 2)


def test_delta_signs(spark):
    report = spark.createDataFrame([("s", 0.8, 0.1), ("u", 0.5, 0.3)], "split string, iou double, mae double")
    decoder = {r["metric"]: r["delta"] for r in met.decoder_deltas(report, "split", "s", "u").collect()}
    formal = {r["metric"]: r["delta"] for r in met.formal_deltas(report, "split", "s", "u").collect()}
    assert decoder["delta_iou"] == pytest.approx(0.3) and decoder["delta_mae"] == pytest.approx(-0.2)
    assert formal["delta_iou"] == pytest.approx(0.3) and formal["delta_mae"] == pytest.approx(0.2)
    assert met.decoder_deltas(report.filter("split = 's'"), "split", "s", "u").count() == 0


def test_report_lines(spark):
    from partloom.sources.writers import markdown_table

    long = met.metric_report(spark.createDataFrame([(0.5, 1.0)], "iou double, mae double"))
    assert sorted(r["line"] for r in markdown_table(long, ["metric", "value"]).collect()) == ["| iou | 0.500000 |", "| mae | 1.000000 |"]


def test_depth_ties_go_to_the_lower_index(spark):
    from partloom.operators import lifting

    rows = [(1, "v", 2, 2, 1.0, 7), (1, "v", 2, 2, 1.0, 3), (1, "v", 2, 2, 2.0, 1)]
    df = spark.createDataFrame(rows, "object_id bigint, view_id string, px bigint, py bigint, depth double, point_idx bigint")
    assert lifting.pixel_owners(df).first()["point_idx"] == 3


def test_pixels_are_clamped_and_half_even(spark):
    from partloom.operators import lifting

    df = spark.createDataFrame([(2.5, -7.0), (3.5, 99.0), (None, None)], "u double, v double")
    got = sorted((r["px"], r["py"]) for r in lifting.to_pixels(df, 8, 8).collect())
    assert got == [(2, 0), (4, 7)]


def test_first_part_wins_equal_scores(spark):
    from partloom.operators import lifting

    rows = [(1, 0, 5, 0.5, 1), (1, 1, 5, 0.5, 1), (1, 0, 6, 0.2, 1)]
    df = spark.createDataFrame(rows, "object_id bigint, part_idx bigint, point_idx bigint, score double, visible_count bigint")
    got = {r["point_idx"]: (r["best_part"], r["second_score"], r["ambiguous"]) for r in lifting.ambiguity(df).collect()}
    assert got == {5: (0, 0.5, True), 6: (0, 0.0, False)}


def test_opacity_tiers(spark):
    from partloom.operators import lifting

    rows = [(1, 0, 0.0, 9.0), (1, 1, 2.0, 9.0), (1, 2, 50.0, -9.0), (2, 3, 0.0, -9.0), (2, 4, 4.0, -9.0)]
    df = spark.createDataFrame(rows, "object_id bigint, point_idx bigint, x double, opacity double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    got = {r["point_idx"]: r["x"] for r in lifting.normalize_points(lifting.activate_geometry(df)).collect()}
    assert got == {0: -0.5, 1: 0.5, 2: 24.5, 3: -0.5, 4: 0.5}
