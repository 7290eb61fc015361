import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.config import GeometryConfig, QuotaConfig
from partloom.operators import instances as ins, masks as msk, quotas as quo
from partloom.operators.ordered import id_chunk
from partloom.plans import REGISTRY


def test_orphans_are_dropped(spark):
    ann = spark.createDataFrame([(1, 10, 5), (2, 99, 5), (3, 10, 9)], "annotation_id bigint, image_id bigint, category_id bigint")
    cats = spark.createDataFrame([(5, "cup")], "id bigint, name string")
    imgs = spark.createDataFrame([(10, 4, 4, "")], "id bigint, width bigint, height bigint, coco_url string")
    assert [r["annotation_id"] for r in ins.join_instances(ann, cats, imgs).collect()] == [1]


def test_allow_list(spark):
    df = spark.createDataFrame([("Cup",), ("pan",)], "category_name string")
    assert ins.allowed_categories(df, []).count() == 2
    assert [r[0] for r in ins.allowed_categories(df, ["CUP"]).collect()] == ["Cup"]
    listed = spark.createDataFrame([("PAN",)], "name string")
    assert [r[0] for r in ins.allowed_categories(df, listed).collect()] == ["pan"]


def test_ids_by_earlier_progress(spark):
    df = spark.createDataFrame([(7,), (3,)], "annotation_id bigint")
    old = spark.createDataFrame([("object_000001",)], "object_id string")
    new = spark.createDataFrame([("lvis_ann_00000009",)], "object_id string")
    assert sorted(r["object_id"] for r in ins.choose_object_ids(df, old, ["annotation_id"]).collect()) == ["object_000000", "object_000001"]
    assert "lvis_ann_00000007" in [r["object_id"] for r in ins.choose_object_ids(df, new, ["annotation_id"]).collect()]


def test_slice_rejects_negatives(spark):
    df = spark.createDataFrame([(0,)], "category_pos int")
    with pytest.raises(ValueError):
        ins.category_slice(df, -1, None)
    with pytest.raises(ValueError):
        ins.category_slice(df, 0, -2)


def test_mask_geometry_margin_is_half_even_and_empty_mask_is_infinite(spark):
    # 0.02 * 125 = 2.5 rounds to 2, not 3.
    frames = spark.createDataFrame([(1, 125, 125), (2, 125, 125), (3, 175, 300)], "object_id bigint, image_width bigint, image_height bigint")
    mask = spark.createDataFrame([(1, 60, 2), (1, 60, 5), (3, 150, 3)], "object_id bigint, y bigint, x bigint")
    got = {r["object_id"]: r for r in msk.mask_geometry(frames, mask).collect()}
    assert got[1]["border_margin_px"] == 2 and not got[1]["touches_left"]
    assert got[1]["aspect_ratio"] == 4.0 and got[1]["bbox_width"] == 4
    assert math.isinf(got[2]["aspect_ratio"]) and got[2]["mask_pixels"] == 0 and got[2]["border_touch_count"] == 0
    # 0.02 * 175 = 3.5 rounds to 4.
    assert got[3]["border_margin_px"] == 4 and got[3]["touches_left"]
    judged = {r["object_id"]: list(r["reasons"]) for r in msk.geometry_filter(msk.mask_geometry(frames, mask), GeometryConfig()).collect()}
    assert judged[2] == ["mask_too_small", "mask_aspect_too_large"]


@pytest.mark.parametrize("tile", [64, 4, 1])
def test_gradient_matches_dense_arrays(spark, tile):
    rng = np.random.default_rng(1)
    image = rng.random((9, 14))
    rows = [(1, y, x, float(image[y, x])) for y in range(9) for x in range(14)]
    df = spark.createDataFrame(rows, "object_id bigint, y bigint, x bigint, v double")
    gy, gx = np.gradient(image)
    got = msk.image_gradient(df, tile).collect()
    assert len(got) == image.size
    for r in got:
        assert math.isclose(r["gy"], gy[r["y"], r["x"]], abs_tol=1e-12)
        assert math.isclose(r["gx"], gx[r["y"], r["x"]], abs_tol=1e-12)
    mask = spark.createDataFrame([(1, y, x) for y in range(3, 8) for x in range(2, 9)] * 2, "object_id bigint, y bigint, x bigint")
    clear = msk.masked_clarity(df, mask, tile).first()
    assert clear["mask_pixels"] == 35 and math.isclose(clear["clarity_score"], np.hypot(gy, gx)[3:8, 2:9].mean())


def test_gradient_of_images_with_gaps(spark):
    rows = [(1, 0, 0, 1.0), (1, 0, 1, 3.0), (1, 0, 3, 7.0), (1, 2, 0, 9.0), (2, 0, 0, 5.0), (2, 0, 1, None)]
    got = {(r["object_id"], r["y"], r["x"]): (r["gy"], r["gx"]) for r in msk.image_gradient(spark.createDataFrame(rows, "object_id bigint, y bigint, x bigint, v double"), 2).collect()}
    assert got == {(1, 0, 0): (0.0, 2.0), (1, 0, 1): (0.0, 2.0), (1, 0, 3): (0.0, 0.0), (1, 2, 0): (0.0, 0.0), (2, 0, 0): (0.0, 0.0)}


def test_clarity_shuffles_pixels_and_mask_once(spark):
    pixels = spark.range(4096).selectExpr("id % 3 AS object_id", "id div 64 AS y", "id % 64 AS x", "CAST(id AS DOUBLE) AS v")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = msk.masked_clarity(pixels, pixels.filter("v > 100"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Both by tile at once; then partial sums by object.
    assert plan.count("Exchange hashpartitioning") == 2


def test_box_mean_over_tiles(spark):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 2, (40, 30))
    rows = [(1, y, x, int(image[y, x])) for y in range(40) for x in range(30)]
    df = spark.createDataFrame(rows, "object_id bigint, y bigint, x bigint, v bigint")
    total = {(r["y"], r["x"]): r["total"] for r in msk.summed_area(df, tile=7).collect()}
    want = image.cumsum(axis=0).cumsum(axis=1)
    assert all(total[(y, x)] == want[y, x] for y in range(40) for x in range(30))
    boxes = spark.createDataFrame([(1, 0, 0, 0, 4, 4), (1, 1, 3, 9, 17, 31)], "object_id bigint, box_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    got = {r["box_id"]: r["box_mean"] for r in msk.box_mean(df, boxes).collect()}
    assert math.isclose(got[0], image[0:5, 0:5].mean()) and math.isclose(got[1], image[9:32, 3:18].mean())


def walk(rows, quotas):
    """Categories tried row by row."""
    tried, passed = {}, {}
    out = []
    for category, seq, outcome in sorted(rows, key=lambda r: r[1]):
        if passed.get(category, 0) >= quotas.get(category, 0):
            continue
        tried[category] = tried.get(category, 0) + 1
        out.append((category, seq, tried[category], passed.get(category, 0) + 1))
        passed[category] = passed.get(category, 0) + (outcome == "pass")
    return sorted(out)


def test_selection_stops_at_quota_in_a_hot_category(spark):
    kinds = ["pass", "model_reject", "geometry_reject", "missing_image"]
    rows = [("hot" if i % 5 else f"c{i % 3}", i, kinds[(i * 7) % 4]) for i in range(3000)]
    quotas = {"hot": 300, "c0": 2, "c1": 0, "c2": 10_000}
    df = spark.createDataFrame(rows, "category_name string, seq bigint, outcome string")
    q = spark.createDataFrame(list(quotas.items()), "category_name string, selection_quota bigint")
    got = quo.quota_selection(df, q, ["seq"], id_chunk("seq", 100))
    found = sorted((r["category_name"], r["seq"], r["image_attempt_index"], r["selection_slot_index"]) for r in got.collect())
    assert found == walk(rows, quotas)


def walk_on(rows, quotas, state):
    """A second run row by row: `state` has (picks, attempts, rejects) per category and is updated."""
    out = []
    full = {c for c in quotas if len(state[c][0]) >= quotas[c]}
    tried = {}
    for category, seq, outcome in sorted(rows, key=lambda r: r[1]):
        picks, _, rejects = state[category]
        if category in full or len(picks) >= quotas[category]:
            continue
        tried[category] = state[category][1] = tried.get(category, 0) + 1
        name = f"o{seq}"
        skipped = name in picks
        out.append((category, seq, "already_selected" if skipped else outcome, tried[category], len(picks) + 1))
        if not skipped and outcome == "pass":
            picks.append(name)
        elif not skipped:
            rejects[outcome] = rejects.get(outcome, 0) + 1
    return sorted(out)


def test_selection_goes_on_from_half_filled_categories(spark):
    kinds = ["pass", "model_reject", "geometry_reject", "missing_image"]
    rows = [("hot" if i % 5 else f"c{i % 4}", i, kinds[(i * 7) % 4]) for i in range(2000)]
    names = ["hot", "c0", "c1", "c2", "c3"]
    first, second = dict(zip(names, (60, 3, 0, 2, 1000))), dict(zip(names, (250, 3, 5, 40, 1000)))
    df = spark.createDataFrame([(c, i, o, f"o{i}", "x") for c, i, o in rows], "category_name string, seq bigint, outcome string, object_id string, _picks string")

    def categories(quotas):
        return spark.createDataFrame([(c, True, q) for c, q in quotas.items()], "category_name string, interactive_object boolean, selection_quota bigint")

    state = {c: [[], 0, {}] for c in names}
    part = [r for r in rows if r[1] % 3 == 0]
    walk_on(part, first, state)
    attempts = quo.quota_selection(df.filter("seq % 3 = 0"), categories(first), ["seq"], id_chunk("seq", 50))
    records = quo.resumable_records(categories(first), attempts)
    for _ in range(2):  # going on, then once more with nothing left to fill but what lacks passes
        got = quo.quota_selection(df, categories(second), ["seq"], id_chunk("seq", 50), records)
        found = sorted((r["category_name"], r["seq"], r["outcome"], r["image_attempt_index"], r["selection_slot_index"]) for r in got.collect())
        assert got.columns == [*df.columns, "selection_quota", "image_attempt_index", "selection_slot_index"]
        assert found == walk_on(rows, second, state)
        records = quo.resumable_records(categories(second), got, records)
        for r in records.collect():
            picks, tried, rejects = state[r["category_name"]]
            assert r["selected_object_ids"] == picks and r["num_selected_objects"] == len(picks) and r["num_image_attempts"] == tried
            assert (r["num_missing_images"], r["num_geometry_rejects"], r["num_llm_rejects"]) == tuple(rejects.get(k, 0) for k in ("missing_image", "geometry_reject", "model_reject"))
            assert r["quota_state"] == ("completed" if len(picks) >= second[r["category_name"]] else "text_completed")


def test_keys_of_any_size_keep_their_order(spark, tmp_path):
    """Queries on annotation ids with order keys beyond 2^40, part and supplier keys beyond 2^33."""
    from partloom.plans import REGISTRY
    from tests.compare import TABLES, compare, connect

    for name in TABLES:
        frame = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        for column in frame.columns:
            far = {"orderkey": 1 << 40, "partkey": 1 << 33, "suppkey": 1 << 34}.get(column.split("_")[-1])
            if far:
                frame = frame.withColumn(column, F.col(column) * 7 + F.lit(far))
        frame.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        (tmp_path / f"{name}.parquet").rename(tmp_path / f"{name}.folder")
        next((tmp_path / f"{name}.folder").glob("part-*")).rename(tmp_path / f"{name}.parquet")
    con = connect(str(tmp_path))
    for name in ("instances", "ids", "dense_ids", "record_limit", "category_groups", "quota_selection", "quota_resume", "approval_gate", "object_index"):
        assert compare(spark, con, REGISTRY[name], str(tmp_path)) is None, name
    largest = REGISTRY["ids"].plan(spark, str(tmp_path)).agg(F.max("annotation_id")).first()[0]
    assert len(largest) == 59 and int(largest[:19]) > 1 << 40


def test_quotas_by_largest_remainder(spark):
    rows = [("a", True, 100), ("b", True, 25), ("c", True, 25), ("d", False, 999), ("e", True, 0)]
    df = spark.createDataFrame(rows, "category_name string, interactive_object boolean, num_available_images bigint")
    got = {r["category_name"]: r["selection_quota"] for r in quo.category_quotas(df, QuotaConfig(target_num_candidates=11)).collect()}
    # 7 left over 10 : 5 : 5 : 1, floors 3 1 1 0, two leftovers to the largest fractions 2/3 (c before b by name).
    assert got == {"a": 4, "b": 3, "c": 3, "d": 0, "e": 1}
    ones = {r["category_name"]: r["selection_quota"] for r in quo.category_quotas(df).collect()}
    assert ones == {"a": 1, "b": 1, "c": 1, "d": 0, "e": 1}
    with pytest.raises(Exception, match="too small"):
        quo.category_quotas(df, QuotaConfig(target_num_candidates=3)).collect()
    with pytest.raises(ValueError):
        quo.category_quotas(df, QuotaConfig(quota_min_per_category=-1))


def test_reused_quotas_must_be_positive(spark):
    df = spark.createDataFrame([("a", True, 0)], "category_name string, interactive_object boolean, selection_quota bigint")
    with pytest.raises(Exception, match="positive selection_quota"):
        quo.category_quotas(df, QuotaConfig(reuse_existing_selection_quotas=True)).collect()


def test_approval_needs_a_list(spark):
    passed = spark.createDataFrame([("a",), ("b",)], "object_id string")
    listed = spark.createDataFrame([("b", 0), ("a", 1), ("x", 2)], "object_id string, pos int")
    assert [r["object_id"] for r in quo.approval_gate(passed, listed, 1).collect()] == ["b"]
    with pytest.raises(Exception, match="no approved_object_ids"):
        quo.approval_gate(passed, listed.filter("pos > 5")).collect()


def test_reading_a_negative_id_fails(spark):
    from partloom.functions import names

    with pytest.raises(Exception, match="non-negative"):
        spark.createDataFrame([(-1,)], "i bigint").select(names.object_id(F.col("i"))).collect()


def test_default_cameras(spark):
    from partloom.config import LiftConfig
    from partloom.operators import cameras as cam

    seen = spark.createDataFrame([(1, 0, 1.0, None, 256), (1, 1, None, 60.0, 128)], "object_id bigint, pos int, radius double, fov_deg double, resolution int")
    objects = spark.createDataFrame([(1,), (2,)], "object_id bigint")
    got = {r["object_id"]: tuple(r)[1:] for r in cam.default_camera(seen, order="pos", objects=objects).collect()}
    assert got == {1: (1.5, 50.0, 256), 2: (2.0, 40.0, 512)}
    fixed = cam.default_camera(seen, order="pos", cfg=LiftConfig(visualization_radius=3.0)).first()
    assert fixed["radius"] == 3.0 and fixed["fov_deg"] == 50.0
    with pytest.raises(ValueError):
        cam.visibility_views(objects, LiftConfig(visualization_yaws_deg=(1.0,)))


def test_standard_views_must_fit(spark):
    from partloom.config import RenderConfig
    from partloom.operators import cameras as cam

    objects = spark.createDataFrame([(1,)], "object_id bigint")
    assert [r["canonical_view"] for r in cam.standard_views(objects, RenderConfig(num_views=2)).collect()] == ["front", "right"]
    with pytest.raises(ValueError):
        cam.standard_views(objects, RenderConfig(num_views=7))
    with pytest.raises(ValueError):
        cam.standard_views(objects, RenderConfig(yaws_deg=(0.0,)))


def test_pre_rotation_of_parallel_targets(spark):
    from partloom.operators import cameras as cam

    df = spark.createDataFrame([(0.0, 0.0, 2.0), (0.0, 0.0, -1.0), (1.0, 1.0, 1.0)], "tx double, ty double, tz double")
    rows = [tuple(r)[3:] for r in cam.pre_rotation(df).collect()]
    assert rows[0] == (1, 0, 0, 0, 1, 0, 0, 0, 1)
    assert rows[1] == (1, 0, 0, 0, -1, 0, 0, 0, -1)
    # +Z goes to the target direction.
    assert all(math.isclose(rows[2][i], 1 / math.sqrt(3)) for i in (2, 5, 8))
    with pytest.raises(Exception, match="non-zero"):
        cam.pre_rotation(spark.createDataFrame([(0.0, 0.0, 0.0)], "tx double, ty double, tz double")).collect()


def test_distinct_images_are_counted_in_partitions_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(ins, "IMAGE_ROWS", 100)
    rows = spark.range(3000).selectExpr("concat('c', id % 3) AS category_name", "id % 700 AS image_id", "id AS annotation_id")
    groups = ins.category_groups(rows, "annotation_id", 3000)
    assert "hashpartitioning(image_id" in groups._jdf.queryExecution().executedPlan().toString() and ", 30)" in groups._jdf.queryExecution().executedPlan().toString()
    assert groups.collect() == ins.category_groups(rows, "annotation_id").collect()
    assert [(r["num_available_objects"], r["num_available_images"], r["category_pos"]) for r in groups.orderBy("category_pos").collect()] == [(1000, 700, 0), (1000, 700, 1), (1000, 700, 2)]


def test_records_of_a_split_are_not_sent_to_one_task(spark):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "-1")
    try:
        index = REGISTRY["object_index"].plan(spark, "/root/testdata/sf0.001")
        plan = index._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(limit)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and index.count() > 0


def test_index_takes_little_room(spark, tmp_path, monkeypatch):
    """Ids and paths were shuffled by split and then stored in some 54 bytes a row; they are neither shuffled nor as large since."""
    import time

    import partloom.session
    from partloom.plans import tables as t
    from partloom.sources import writers

    num_lines, d = 20_000, str(tmp_path)
    spark.range(num_lines).selectExpr(
        "id * 7919 % 5003 AS l_orderkey", "id * 31 % 401 AS l_partkey", "id * 17 % 97 AS l_suppkey", "CAST(1 + id % 7 AS INT) AS l_linenumber", "CAST(id % 50 AS DOUBLE) AS l_quantity"
    ).write.parquet(f"{d}/lineitem.parquet")
    spark.range(5000).selectExpr("id AS o_orderkey").write.parquet(f"{d}/orders.parquet")
    spark.range(400).selectExpr("id AS p_partkey", "concat('name ', id % 9) AS p_name").write.parquet(f"{d}/part.parquet")
    for module in (partloom.session, writers):
        monkeypatch.setattr(module, "scratch_path", lambda spark, name: f"{d}/scratch/{name}", raising=False)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    before, limit = shuffled(), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "-1")
    try:
        plan = t.instances(spark, d)._jdf.queryExecution().optimizedPlan().toString()
        index = REGISTRY["object_index"].plan(spark, d)
        until = time.time() + 20
        while shuffled() - before and time.time() < until:
            time.sleep(0.2)
        left = shuffled() - before
    finally:
        spark.conf.unset(limit)
    assert "lpad" in plan and "lpad" not in plan.split("Join", 1)[1]
    assert not left
    assert [p.name for p in (tmp_path / "scratch").iterdir()] == ["object_index"]
    lines = [(i * 7919 % 5003, i * 31 % 401, i * 17 % 97, 1 + i % 7) for i in range(num_lines)]
    kept = [("val" if o % 10 == 0 else "train", f"{o:019}{n:02}{p:019}{s:019}") for o, p, s, n in lines if o < 5000 and p < 400]
    got = index.collect()
    assert sorted((r["split_name"], r["annotation_id"]) for r in got) == sorted(kept)
    counts = {split: sum(k[0] == split for k in kept) for split in ("train", "val")}
    assert all(r["num_records"] == counts[r["split_name"]] for r in got)
    assert all(r["object_id"] == r["object_dir"] == "lvis_ann_" + r["annotation_id"].lstrip("0") for r in got)
    assert sum(f.stat().st_size for f in (tmp_path / "scratch").rglob("*.parquet")) < 40 * len(kept)
