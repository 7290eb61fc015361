"""Curation: instances, masks, filters, quotas, selection, approval."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.config import GeometryConfig, QuotaConfig, RuleFilterConfig
from partloom.functions import names
from partloom.operators import instances as ins, masks as msk, quotas as quo
from partloom.operators.ordered import global_row_number
from partloom.plans import tables as t
from partloom.plans.registry import query
from partloom.plans.tables import SQL, q6, r6, views
from partloom.session import checkpointed, scratch_path
from partloom.sources.commits import CommitStore

IMAGES_ROOT = "data/images"
# Masks of 8 x 8 images need other bounds than full frames for every reason to occur.
SMALL_GEOMETRY = GeometryConfig(
    min_mask_area_ratio=0.22, max_mask_aspect_ratio=1.5, border_margin_min_px=1, max_border_touch_count=1
)
QUOTAS = QuotaConfig(target_num_candidates=1000)


@query(
    "instances",
    views("fx_instances")
    + """SELECT annotation_id, object_id, image_id, category_id, category_name, image_width, image_height,
  x, y, w, h, area FROM fx_instances""",
)
def instances(spark, d):
    return t.instances(spark, d).select(
        "annotation_id", "object_id", "image_id", "category_id", "category_name", "image_width", "image_height",
        "x", "y", "w", "h", "area",
    )


@query(
    "allowed_categories",
    views("fx_instances")
    + """SELECT annotation_id, category_name FROM fx_instances
WHERE lower(category_name) IN (SELECT lower(p_name) FROM part WHERE p_size > 45)
  AND lower(category_name) NOT IN ('blue ring', 'red widget')""",
)
def allowed_categories(spark, d):
    listed = t.table(spark, d, "part").filter("p_size > 45").select(F.upper("p_name"))
    by_table = ins.allowed_categories(t.instances(spark, d), listed)
    kept = by_table.join(ins.allowed_categories(by_table, ["Blue Ring", "RED widget"]), "annotation_id", "left_anti")
    return kept.select("annotation_id", "category_name")


SQL["fx_groups"] = """
SELECT category_name, count(*) AS num_available_objects, count(DISTINCT image_id) AS num_available_images,
  min(annotation_id) AS first_seen, row_number() OVER (ORDER BY min(annotation_id)) - 1 AS category_pos
FROM fx_instances GROUP BY category_name"""


@query("category_groups", views("fx_groups") + "SELECT * FROM fx_groups")
def category_groups(spark, d):
    return ins.category_groups(t.instances(spark, d), "annotation_id", t.num_annotations(spark, d))


@query(
    "category_slice",
    views("fx_groups")
    + "SELECT category_name, category_pos FROM fx_groups WHERE category_pos >= 10 AND category_pos < 40",
)
def category_slice(spark, d):
    groups = ins.category_groups(t.instances(spark, d), "annotation_id", t.num_annotations(spark, d))
    return ins.category_slice(groups, 10, 30).select("category_name", "category_pos")


SQL["fx_quotas"] = """
SELECT category_name, interactive_object, num_available_objects, num_available_images,
  CASE WHEN interactive_object THEN 1 + fl + CASE WHEN place <= rest - sum(fl) OVER (PARTITION BY interactive_object)
    THEN 1 ELSE 0 END ELSE 0 END AS selection_quota
FROM (SELECT *, row_number() OVER (PARTITION BY interactive_object ORDER BY raw - fl DESC, weight DESC, category_name DESC) AS place
FROM (SELECT *, floor(raw) AS fl
FROM (SELECT *, rest * (weight / sum(weight) OVER (PARTITION BY interactive_object)) AS raw
FROM (SELECT *, pow(greatest(num_available_images, 1), 0.5) AS weight,
  1000 - count(*) OVER (PARTITION BY interactive_object) AS rest FROM fx_decided ))))"""


@query(
    "category_quotas",
    views("fx_quotas")
    + """SELECT category_name, interactive_object, num_available_images, CAST(selection_quota AS BIGINT) AS selection_quota
FROM fx_quotas""",
)
def category_quotas(spark, d):
    quotas = quo.category_quotas(t.decided(t.instances(spark, d), t.num_annotations(spark, d)), QUOTAS)
    return quotas.select("category_name", "interactive_object", "num_available_images", "selection_quota")


def screened(spark, d):
    """Category table with quotas, and the attempted rows. Outcomes are stored once and read from there."""
    outcomes = checkpointed(t.outcomes(spark, d).drop("object_id"), "outcomes")
    quotas = checkpointed(quo.category_quotas(t.decided(outcomes, t.num_annotations(spark, d)), QUOTAS), "quotas")
    return quotas, quo.quota_selection(outcomes, quotas, ["annotation_id"], t.annotation_chunk())


SQL["fx_attempts"] = """
SELECT * FROM (SELECT o.*, CAST(selection_quota AS BIGINT) AS selection_quota,
  row_number() OVER w AS image_attempt_index,
  coalesce(count(*) FILTER (outcome = 'pass') OVER (PARTITION BY category_name ORDER BY annotation_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS selection_slot_index
FROM fx_outcomes o JOIN fx_quotas q USING (category_name) WHERE selection_quota > 0
WINDOW w AS (PARTITION BY category_name ORDER BY annotation_id))
WHERE selection_slot_index <= selection_quota"""


@query(
    "quota_selection",
    views("fx_attempts")
    + """SELECT annotation_id, category_name, outcome, selection_quota, image_attempt_index, selection_slot_index
FROM fx_attempts""",
)
def quota_selection(spark, d):
    return screened(spark, d)[1].select(
        "annotation_id", "category_name", "outcome", "selection_quota", "image_attempt_index", "selection_slot_index"
    )


@query(
    "candidate_screening",
    views("fx_attempts")
    + """SELECT category_name, interactive_object, num_available_objects, q.selection_quota::BIGINT AS selection_quota,
  count(outcome) AS num_image_attempts, count(*) FILTER (outcome = 'missing_image') AS num_missing_images,
  count(*) FILTER (outcome = 'geometry_reject') AS num_geometry_rejects,
  count(*) FILTER (outcome = 'model_reject') AS num_llm_rejects, count(*) FILTER (outcome = 'pass') AS num_selected_objects,
  CASE WHEN interactive_object AND count(*) FILTER (outcome = 'pass') < q.selection_quota THEN 'text_completed'
    ELSE 'completed' END AS quota_state
FROM fx_quotas q LEFT JOIN (SELECT category_name, outcome FROM fx_attempts ) a USING (category_name)
GROUP BY category_name, interactive_object, num_available_objects, q.selection_quota""",
)
def candidate_screening(spark, d):
    """The flagship: annotations to quota-bounded candidates per category, with reject counters."""
    quotas, chosen = screened(spark, d)
    return quo.category_records(quotas.drop("num_available_images"), quo.selection_counters(chosen))


# A first run that stopped: a third of the images, half of each quota.
SQL["fx_first_run"] = """
SELECT * FROM (SELECT o.*, half, coalesce(count(*) FILTER (outcome = 'pass') OVER (PARTITION BY category_name ORDER BY annotation_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS picked_before
  FROM fx_outcomes o JOIN (SELECT category_name, selection_quota::BIGINT // 2 AS half FROM fx_quotas ) q USING (category_name)
  WHERE image_id % 3 = 0 AND half > 0) WHERE picked_before < half"""

SQL["fx_first_records"] = """
SELECT category_name, list(object_id ORDER BY annotation_id) FILTER (outcome = 'pass') AS picks, count(*) AS attempts,
  count(*) FILTER (outcome = 'missing_image') AS missing, count(*) FILTER (outcome = 'geometry_reject') AS geometry,
  count(*) FILTER (outcome = 'model_reject') AS model FROM fx_first_run GROUP BY category_name"""

SQL["fx_second_run"] = """
SELECT * FROM (SELECT *, coalesce(count(*) FILTER (now = 'pass') OVER (PARTITION BY category_name ORDER BY annotation_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS picked_before
  FROM (SELECT o.*, selection_quota::BIGINT AS quota, coalesce(len(picks), 0) AS filled,
      CASE WHEN list_contains(coalesce(picks, []), object_id) THEN 'already_selected' ELSE outcome END AS now
    FROM fx_outcomes o JOIN fx_quotas q USING (category_name) LEFT JOIN fx_first_records f USING (category_name))
  WHERE filled < quota) WHERE filled + picked_before < quota"""


def resumed(spark, d):
    """Categories with quotas, the records of a first run that stopped half-way, and the attempts of the run that goes on."""
    outcomes = checkpointed(t.outcomes(spark, d), "outcomes")
    quotas = checkpointed(quo.category_quotas(t.decided(outcomes, t.num_annotations(spark, d)), QUOTAS), "quotas")
    half = quotas.withColumn("selection_quota", t.div(F.col("selection_quota"), 2))
    order, chunk = ["annotation_id"], t.annotation_chunk()
    first = quo.quota_selection(outcomes.filter("image_id % 3 = 0"), half, order, chunk)
    records = checkpointed(quo.resumable_records(half, first), "quota-records")
    return quotas, records, quo.quota_selection(outcomes, quotas, order, chunk, records)


@query(
    "quota_resume",
    views("fx_second_run")
    + """SELECT annotation_id, object_id, category_name, now AS outcome, quota AS selection_quota,
  row_number() OVER (PARTITION BY category_name ORDER BY annotation_id) AS image_attempt_index,
  filled + picked_before + 1 AS selection_slot_index FROM fx_second_run""",
)
def quota_resume(spark, d):
    """Attempts of a run that goes on from half-filled categories."""
    return resumed(spark, d)[2].select(
        "annotation_id", "object_id", "category_name", "outcome", "selection_quota", "image_attempt_index", "selection_slot_index"
    )


@query(
    "resumed_categories",
    views("fx_second_run", "fx_first_records")
    + """SELECT category_name, interactive_object, selection_quota::BIGINT AS selection_quota,
  coalesce(s.attempts, f.attempts, 0) AS num_image_attempts, coalesce(s.missing, 0) + coalesce(f.missing, 0) AS num_missing_images,
  coalesce(s.geometry, 0) + coalesce(f.geometry, 0) AS num_geometry_rejects, coalesce(s.model, 0) + coalesce(f.model, 0) AS num_llm_rejects,
  len(list_concat(coalesce(f.picks, []), coalesce(s.picks, []))) AS num_selected_objects,
  array_to_string(list_concat(coalesce(f.picks, []), coalesce(s.picks, [])), ',') AS selected_object_ids,
  CASE WHEN interactive_object AND len(list_concat(coalesce(f.picks, []), coalesce(s.picks, []))) < selection_quota
    THEN 'text_completed' ELSE 'completed' END AS quota_state
FROM fx_quotas q LEFT JOIN fx_first_records f USING (category_name) LEFT JOIN (
  SELECT category_name, list(object_id ORDER BY annotation_id) FILTER (now = 'pass') AS picks, count(*) AS attempts,
    count(*) FILTER (now = 'missing_image') AS missing, count(*) FILTER (now = 'geometry_reject') AS geometry,
    count(*) FILTER (now = 'model_reject') AS model FROM fx_second_run GROUP BY category_name) s USING (category_name)""",
)
def resumed_categories(spark, d):
    """Category records after both runs, with every picked object."""
    quotas, records, attempts = resumed(spark, d)
    merged = quo.resumable_records(quotas, checkpointed(attempts, "attempts"), records)
    return merged.select(
        "category_name", "interactive_object", "selection_quota", "num_image_attempts", *quo.REJECTS, "num_selected_objects",
        F.array_join("selected_object_ids", ",").alias("selected_object_ids"), "quota_state",
    )


@query(
    "dense_ids",
    views("fx_instances")
    + """SELECT annotation_id, printf('object_%06d', row_number() OVER (ORDER BY annotation_id) - 1) AS object_id
FROM fx_instances WHERE category_name <> 'small ring'""",
)
def dense_ids(spark, d):
    kept = t.instances(spark, d).filter("category_name <> 'small ring'").select("annotation_id")
    return ins.dense_object_ids(kept, ["annotation_id"])


@query(
    "record_limit",
    views("fx_instances") + "SELECT annotation_id, category_name FROM fx_instances ORDER BY annotation_id LIMIT 100",
)
def record_limit(spark, d):
    return ins.record_limit(t.instances(spark, d).select("annotation_id", "category_name"), ["annotation_id"], 100)


@query(
    "object_index",
    views("fx_instances")
    + """SELECT split_name, num_records, object_id, annotation_id, object_id AS object_dir,
  object_id || '/source/source_meta.json' AS source_meta_path
FROM (SELECT *, CASE WHEN image_id % 10 = 0 THEN 'val' ELSE 'train' END AS split_name FROM fx_instances )
JOIN (SELECT CASE WHEN image_id % 10 = 0 THEN 'val' ELSE 'train' END AS split_name, count(*) AS num_records
  FROM fx_instances GROUP BY ALL) USING (split_name)""",
)
def object_index(spark, d):
    """Written partitioned by split and read back, with the header count of each split."""
    from partloom.session import scratch_path
    from partloom.sources.writers import write_partitioned

    split = F.when(F.col("image_id") % 10 == 0, "val").otherwise("train")

    def located(rows):
        placed = ins.stable_object_ids(rows).withColumn(
            "image_path", names.image_path(F.col("coco_url"), F.col("image_id"), IMAGES_ROOT)
        )
        return ins.object_index(placed).withColumn("split_name", split)

    path = scratch_path(spark, "object_index")
    # Ids of objects and paths, four long texts of a row, are made where they are written.
    rows = t.instances(spark, d).select("annotation_id", "image_id", "category_name", "coco_url")
    write_partitioned(rows, path, ["split_name"], derived=located)
    stored = spark.read.parquet(path)
    header = stored.groupBy("split_name").agg(F.count(F.lit(1)).alias("num_records"))
    # One row per split; by a shuffle of the records all of a split would go to one task.
    return stored.join(F.broadcast(header), "split_name").select(
        "split_name", "num_records", "object_id", "annotation_id", "object_dir", "source_meta_path"
    )


SQL["fx_geometry"] = """
SELECT *, CASE WHEN mask_pixels > 0 THEN greatest(bbox_width / greatest(bbox_height, 1), bbox_height / greatest(bbox_width, 1))
    ELSE 1e9 END AS aspect_ratio,
  touches_top::INT + touches_bottom::INT + touches_left::INT + touches_right::INT AS border_touch_count
FROM (SELECT e.vec_id AS object_id, count(m.x) AS mask_pixels, count(m.x) / 64 AS mask_area_ratio,
  coalesce(max(m.x) - min(m.x) + 1, 0) AS bbox_width, coalesce(max(m.y) - min(m.y) + 1, 0) AS bbox_height,
  coalesce(bool_or(m.y < 1), false) AS touches_top, coalesce(bool_or(m.y >= 7), false) AS touches_bottom,
  coalesce(bool_or(m.x < 1), false) AS touches_left, coalesce(bool_or(m.x >= 7), false) AS touches_right
FROM embeddings e LEFT JOIN fx_masks m ON m.object_id = e.vec_id GROUP BY e.vec_id)"""


def geometry(spark, d):
    return msk.mask_geometry(t.frames(spark, d), t.masks(spark, d), SMALL_GEOMETRY)


@query(
    "mask_geometry",
    views("fx_geometry")
    + """SELECT object_id, mask_pixels, round(mask_area_ratio, 6) AS mask_area_ratio, bbox_width, bbox_height,
  round(aspect_ratio, 6) AS aspect_ratio, touches_top, touches_bottom, touches_left, touches_right,
  CAST(border_touch_count AS BIGINT) AS border_touch_count FROM fx_geometry""",
)
def mask_geometry(spark, d):
    aspect = F.least("aspect_ratio", F.lit(1e9))
    return geometry(spark, d).select(
        "object_id", "mask_pixels", r6(F.col("mask_area_ratio")).alias("mask_area_ratio"), "bbox_width", "bbox_height",
        r6(aspect).alias("aspect_ratio"), "touches_top", "touches_bottom", "touches_left", "touches_right",
        F.col("border_touch_count").cast("bigint").alias("border_touch_count"),
    )


@query(
    "geometry_filter",
    views("fx_geometry")
    + """SELECT object_id, reasons, reasons = '' AS passed FROM (SELECT object_id, array_to_string(list_filter([
  CASE WHEN mask_area_ratio < 0.22 THEN 'mask_too_small' END,
  CASE WHEN aspect_ratio > 1.5 THEN 'mask_aspect_too_large' END,
  CASE WHEN border_touch_count > 1 THEN 'touches_too_many_borders' END], lambda r: r IS NOT NULL), ',') AS reasons
FROM fx_geometry )""",
)
def geometry_filter(spark, d):
    judged = msk.geometry_filter(geometry(spark, d), SMALL_GEOMETRY)
    return judged.select("object_id", F.array_join("reasons", ",").alias("reasons"), "passed")


@query(
    "clarity",
    views("fx_masks")
    + """, g AS (SELECT object_id, y, x,
  (coalesce(lead(v) OVER c, v) - coalesce(lag(v) OVER c, v)) / CASE WHEN y BETWEEN 1 AND 6 THEN 2 ELSE 1 END AS gy,
  (coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) / CASE WHEN x BETWEEN 1 AND 6 THEN 2 ELSE 1 END AS gx
FROM fx_pixels WINDOW c AS (PARTITION BY object_id, x ORDER BY y), r AS (PARTITION BY object_id, y ORDER BY x))
SELECT e.vec_id AS object_id, round(coalesce(avg(sqrt(gx * gx + gy * gy)), 0), 6) AS clarity_score, count(gx) AS mask_pixels
FROM embeddings e LEFT JOIN (SELECT g.* FROM g SEMI JOIN fx_masks USING (object_id, y, x)) s ON s.object_id = e.vec_id
GROUP BY e.vec_id""",
)
def clarity(spark, d):
    scored = msk.masked_clarity(t.pixels(spark, d), t.masks(spark, d))
    return scored.select("object_id", r6(F.col("clarity_score")).alias("clarity_score"), "mask_pixels")


@query(
    "masked_pixels",
    "SELECT object_id, y, x, " + q6("CASE WHEN (abs(x - 3.5) <= 2 AND abs(y - 3.5) <= 2 AND v > -0.15) OR v > 0.22 THEN v ELSE 0 END") + """ AS v
FROM (SELECT vec_id AS object_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, v::DOUBLE AS v
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))""",
)
def masked_pixels(spark, d):
    shown = msk.masked_pixels(t.pixels(spark, d), t.masks(spark, d))
    return shown.select("object_id", "y", "x", r6(F.col("v")).alias("v"))


RULES = RuleFilterConfig(
    interactive_categories=("Small Ring", "red widget", "blue widget", "large ring", "green gear", "hot bolt"),
    min_area=4096.0, min_clarity_score=5.0, min_mask_pixels=600,
)


@query(
    "rule_filter",
    views("fx_instances")
    + """SELECT annotation_id, touches_border, reasons, reasons = '' AS passed FROM (
SELECT annotation_id, touches_border, array_to_string(list_filter([
  CASE WHEN category_name NOT IN ('small ring', 'red widget', 'blue widget', 'large ring', 'green gear', 'hot bolt')
    THEN 'non_interactive_category' END,
  CASE WHEN area < 4096 THEN 'small_area' END, CASE WHEN touches_border THEN 'touches_border' END,
  CASE WHEN mask_pixels < 600 THEN 'small_mask_pixels' END,
  CASE WHEN clarity_score < 5 THEN 'low_clarity' END], lambda r: r IS NOT NULL), ',') AS reasons
FROM (SELECT *, x <= 0 OR y <= 0 OR x + w >= 640 OR y + h >= 480 AS touches_border, floor(area / 8) AS mask_pixels,
  category_id % 13 AS clarity_score FROM fx_instances ))""",
)
def rule_filter(spark, d):
    measured = t.instances(spark, d).withColumns(
        {"mask_pixels": F.floor(F.col("area") / 8), "clarity_score": (F.col("category_id") % 13).cast("double")}
    )
    judged = msk.rule_filter(measured, RULES)
    return judged.select("annotation_id", "touches_border", F.array_join("reasons", ",").alias("reasons"), "passed")


CANDIDATE = "object_id string, category_name string, passed boolean, reasons array<string>, candidate_meta_path string"


@query(
    "candidate_summary",
    views("fx_outcomes")
    + """SELECT outcome, count(*) AS num_records, count(*) FILTER (outcome = 'pass') AS num_passed,
  min(object_id || '/candidate/candidate_meta.json') AS first_meta, (SELECT count(*) FROM fx_outcomes) AS total_records,
  (SELECT count(*) FROM fx_outcomes WHERE outcome = 'pass') AS num_reviews FROM fx_outcomes GROUP BY outcome""",
)
def candidate_summary(spark, d):
    """Candidate rows, their summary and the review list, committed together and read back."""
    results = checkpointed(t.outcomes(spark, d), "outcomes").withColumns(
        {"passed": F.col("outcome") == "pass", "reasons": F.array("outcome"), "short_reason": F.lit("")}
    )
    rows = msk.candidate_results(results)
    store = CommitStore(spark, scratch_path(spark, "candidates"))
    tables = {"candidates": rows, "summary": msk.candidate_summary(rows), "review": msk.review_list(results.filter("passed")).select("object_id", "source_image_path")}
    for _ in range(2):  # a retry adds nothing
        store.commit("candidates", tables)
    total = store.read("summary", "num_records bigint, num_passed bigint").agg(F.sum("num_records")).scalar()
    reviews = store.read("review", "object_id string, source_image_path string").agg(F.count(F.lit(1))).scalar()
    return (
        store.read("candidates", CANDIDATE)
        .groupBy(F.get("reasons", F.lit(0)).alias("outcome"))
        .agg(F.count(F.lit(1)).alias("num_records"), F.count_if("passed").alias("num_passed"), F.min("candidate_meta_path").alias("first_meta"))
        .withColumns({"total_records": total, "num_reviews": reviews})
    )


@query(
    "review_list",
    views("fx_attempts")
    + """SELECT object_id, category_name, 'slot ' || selection_slot_index AS short_reason, '' AS reasons, true AS passed,
  object_id || '/candidate/masked_instance.png' AS masked_view_path, object_id || '/source/image.png' AS source_image_path,
  object_id || '/source/instance_mask.png' AS source_mask_path, object_id || '/candidate/candidate_meta.json' AS candidate_meta_path
FROM fx_attempts WHERE outcome = 'pass'""",
)
def review_list(spark, d):
    """Selected candidates as a reviewer sees them."""
    chosen = ins.stable_object_ids(screened(spark, d)[1].filter("outcome = 'pass'"))
    judged = chosen.withColumns(
        {
            "passed": F.lit(True),
            "short_reason": F.concat(F.lit("slot "), F.col("selection_slot_index").cast("string")),
            "reasons": F.array().cast("array<string>"),
        }
    )
    return msk.review_list(judged).withColumn("reasons", F.array_join("reasons", ","))


@query(
    "box_mean",
    views("fx_pixels")
    + """SELECT b.object_id, CAST(box_id AS BIGINT) AS box_id, """ + q6("sum(v)") + " AS box_sum, " + q6("avg(v)") + """ AS box_mean
FROM (SELECT vec_id AS object_id, box_id, vec_id % 4 AS x0, box_id % 3 AS y0, vec_id % 4 + 1 + box_id AS x1, box_id % 3 + 2 AS y1
  FROM embeddings, range(3) r(box_id)) b
JOIN fx_pixels p ON p.object_id = b.object_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL""",
)
def box_mean(spark, d):
    boxes = (
        t.table(spark, d, "embeddings")
        .select(F.col("vec_id").alias("object_id"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("box_id"))
        .withColumn("box_id", F.col("box_id").cast("bigint"))
        .withColumns({"x0": F.col("object_id") % 4, "y0": F.col("box_id") % 3})
        .withColumns({"x1": F.col("x0") + 1 + F.col("box_id"), "y1": F.col("y0") + 2})
    )
    means = msk.box_mean(t.pixels(spark, d), boxes)
    return means.select(
        "object_id", "box_id", r6(F.col("box_sum")).alias("box_sum"), r6(F.col("box_mean")).alias("box_mean")
    )


@query(
    "approval_gate",
    views("fx_outcomes")
    + """SELECT object_id, category_name, approval_pos FROM fx_outcomes JOIN (
  SELECT object_id, row_number() OVER (ORDER BY annotation_id DESC) - 1 AS approval_pos FROM fx_outcomes
  WHERE image_id % 2 = 0) USING (object_id) WHERE outcome = 'pass' AND approval_pos < 5000""",
)
def approval_gate(spark, d):
    judged = t.outcomes(spark, d)
    listed = global_row_number(judged.filter("image_id % 2 = 0").select("object_id", "annotation_id"), [F.desc("annotation_id")], "pos")
    approvals = listed.select("object_id", (F.col("pos") - 1).alias("pos"))
    passed = judged.filter("outcome = 'pass'").select("object_id", "category_name")
    return quo.approval_gate(passed, approvals, 5000)


@query(
    "screening_totals",
    views("fx_attempts")
    + """SELECT count(*) AS num_categories_in_batch, count(*) FILTER (interactive_object) AS num_text_pass_categories,
  sum(num_available_objects)::BIGINT AS num_input_records, sum(n)::BIGINT AS num_selected_candidates,
  count(*) FILTER (NOT interactive_object OR n >= selection_quota) AS num_completed_categories
FROM (SELECT q.*, (SELECT count(*) FROM fx_attempts a WHERE a.category_name = q.category_name AND outcome = 'pass') AS n
  FROM fx_quotas q)""",
)
def screening_totals(spark, d):
    quotas, chosen = screened(spark, d)
    return quo.stage_totals(quo.category_records(quotas, quo.selection_counters(chosen)))
