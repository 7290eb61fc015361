"""Tables in the shape the operators expect, derived from the driver tables.

Every adapter exists twice: as a DataFrame and as a SQL view text for the check side.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from partloom.functions import names
from partloom.functions.numeric import clamp

SQL: dict[str, str] = {}

FRAME_WIDTH, FRAME_HEIGHT = 640, 480
# Annotation ids are the digits of (order, line, part, supplier), each padded to the width of its type: as text they
# sort like the four numbers, at any size of these.
ID_WIDTHS = {"l_orderkey": 19, "l_linenumber": 2, "l_partkey": 19, "l_suppkey": 19}


def views(*wanted: str) -> str:
    """`WITH` clause with the named adapter views and those they build on."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in SQL:
            if other != name and f" {other} " in f" {SQL[name]} ".replace("\n", " ").replace(",", " , ").replace(
                ")", " ) "
            ):
                visit(other)
        order.append(name)

    for name in wanted:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(value: Column | str) -> Column:
    """Six decimals, without a negative zero: the precision in which both sides are compared."""
    rounded = F.round(value, 6)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def q6(expression: str) -> str:
    """`r6` as SQL text."""
    rounded = f"round(CAST({expression} AS DOUBLE), 6)"
    return f"CASE WHEN {rounded} = 0 THEN CAST(0 AS DOUBLE) ELSE {rounded} END"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_fill(template: str, fields: dict[str, str]) -> str:
    """A `str.format` template as a SQL concatenation."""
    pieces = []
    for text, field, _, _ in string.Formatter().parse(template):
        if text:
            pieces.append(quoted(text))
        if field is not None:
            pieces.append(f"CAST({fields[field]} AS VARCHAR)")
    return "(" + " || ".join(pieces) + ")"


def div(value: Column, by: int) -> Column:
    """Whole-number division of non-negative values."""
    return F.call_function("div", value.cast("bigint"), F.lit(by))


# --- annotations and instances -------------------------------------------------------------------

SQL["fx_annotations"] = """
SELECT lpad(l_orderkey::VARCHAR, 19, '0') || lpad(l_linenumber::VARCHAR, 2, '0') || lpad(l_partkey::VARCHAR, 19, '0')
    || lpad(l_suppkey::VARCHAR, 19, '0') AS annotation_id,
  l_suppkey AS supplier_id, l_orderkey AS image_id, l_partkey AS category_id,
  CAST((l_partkey * 7) % 640 AS DOUBLE) AS x, CAST((l_suppkey * 11) % 480 AS DOUBLE) AS y,
  20 + l_quantity * 4 AS w, CAST(20 + l_linenumber * 20 AS DOUBLE) AS h,
  (20 + l_quantity * 4) * (20 + l_linenumber * 20) AS area,
  CASE WHEN l_suppkey % 5 = 0 THEN 'run_lengths' WHEN l_suppkey % 7 = 0 THEN 'none' ELSE 'polygons' END AS segmentation_kind,
  CAST(l_linenumber % 4 AS BIGINT) AS num_polygons, CAST(l_quantity AS BIGINT) AS first_polygon_len
FROM lineitem"""


def annotation_columns(of: Callable[[str], Column] = F.col) -> list[Column]:
    """Columns of an annotation, from those of a line: of a table, or of a record that `of` looks into."""
    width, height = 20 + of("l_quantity") * 4, (20 + of("l_linenumber") * 20).cast("double")
    ident = F.concat(*[F.lpad(of(c).cast("string"), width, "0") for c, width in ID_WIDTHS.items()])
    return [
        ident.alias("annotation_id"),
        of("l_suppkey").alias("supplier_id"),
        of("l_orderkey").alias("image_id"),
        of("l_partkey").alias("category_id"),
        ((of("l_partkey") * 7) % FRAME_WIDTH).cast("double").alias("x"),
        ((of("l_suppkey") * 11) % FRAME_HEIGHT).cast("double").alias("y"),
        width.alias("w"),
        height.alias("h"),
        (width * height).alias("area"),
        F.when(of("l_suppkey") % 5 == 0, "run_lengths").when(of("l_suppkey") % 7 == 0, "none").otherwise("polygons").alias("segmentation_kind"),
        (of("l_linenumber") % 4).cast("bigint").alias("num_polygons"),
        of("l_quantity").cast("bigint").alias("first_polygon_len"),
    ]


def annotations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*annotation_columns())


def categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


def images(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(
        F.col("o_orderkey") % 5 == 0, F.lit("")
    ).otherwise(F.concat(F.lit("http://images.example.com/val/"), F.col("o_orderkey").cast("string"), F.lit(".jpg/")))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.lit(FRAME_WIDTH).cast("bigint").alias("width"),
        F.lit(FRAME_HEIGHT).cast("bigint").alias("height"),
        url.alias("coco_url"),
    )


SQL["fx_instances"] = """
SELECT a.*, p_name AS category_name, CAST(640 AS BIGINT) AS image_width, CAST(480 AS BIGINT) AS image_height,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'http://images.example.com/val/' || o_orderkey || '.jpg/' END AS coco_url,
  'lvis_ann_' || ltrim(annotation_id, '0') AS object_id
FROM fx_annotations a JOIN part ON p_partkey = category_id JOIN orders ON o_orderkey = image_id"""


def instances(spark: SparkSession, d: str) -> DataFrame:
    """Lines meet their categories and images as they are; the columns of annotations are made of the joined ones.

    Four numbers take less room in a shuffle than an id of 59 digits.
    """
    from partloom.operators.instances import join_instances, stable_object_ids

    renamed = {"l_orderkey": "image_id", "l_partkey": "category_id"}
    lines = table(spark, d, "lineitem").select(*[F.col(c).alias(renamed.get(c, c)) for c in (*ID_WIDTHS, "l_quantity")])
    joined = join_instances(lines, categories(spark, d), images(spark, d))
    of_images = ["category_name", "image_width", "image_height", "coco_url"]
    return stable_object_ids(joined.select(*annotation_columns(lambda c: F.col(renamed.get(c, c))), *of_images))


def annotation_chunk() -> Column:
    """Order-preserving chunk of annotations: 1,024 images each."""
    return div(F.col("image_id"), 1024)


SQL["fx_outcomes"] = """
SELECT annotation_id, image_id, object_id, category_name,
  CASE WHEN image_id % 13 = 0 THEN 'missing_image'
       WHEN area < 4096 THEN 'geometry_reject'
       WHEN (category_id * 31 + supplier_id) % 4 = 0 THEN 'pass'
       ELSE 'model_reject' END AS outcome
FROM fx_instances"""


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What trying each instance would give: image missing, geometry or model reject, or a pass."""
    pick = (F.col("category_id") * 31 + F.col("supplier_id")) % 4
    outcome = (
        F.when(F.col("image_id") % 13 == 0, "missing_image")
        .when(F.col("area") < 4096, "geometry_reject")
        .when(pick == 0, "pass")
        .otherwise("model_reject")
    )
    return instances(spark, d).select(
        "annotation_id", "image_id", "object_id", "category_name", outcome.alias("outcome")
    )


SQL["fx_decided"] = """
SELECT category_name, count(*) AS num_available_objects, count(DISTINCT image_id) AS num_available_images,
  (length(category_name) % 3) <> 0 AS interactive_object
FROM fx_instances GROUP BY category_name"""


def num_annotations(spark: SparkSession, d: str) -> int:
    return table(spark, d, "lineitem").count()


def decided(rows: DataFrame, num_rows: int | None = None) -> DataFrame:
    """Categories of instance rows with their text decision."""
    from partloom.operators.instances import category_groups

    groups = category_groups(rows, "annotation_id", num_rows)
    return groups.select(
        "category_name",
        "num_available_objects",
        "num_available_images",
        ((F.length("category_name") % 3) != 0).alias("interactive_object"),
    )


# --- images, masks, points -----------------------------------------------------------------------

SQL["fx_pixels"] = """
SELECT vec_id AS object_id, CAST((p - 1) // 8 AS BIGINT) AS y, CAST((p - 1) % 8 AS BIGINT) AS x,
  CAST(embedding[p] AS DOUBLE) AS v, label
FROM embeddings, range(1, 65) AS r(p)"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding as an 8 x 8 grey image."""
    return (
        table(spark, d, "embeddings")
        .select("vec_id", "label", F.posexplode("embedding").alias("p", "v"))
        .select(
            F.col("vec_id").alias("object_id"),
            div(F.col("p"), 8).alias("y"),
            (F.col("p") % 8).cast("bigint").alias("x"),
            F.col("v").cast("double").alias("v"),
            "label",
        )
    )


SQL["fx_masks"] = """
SELECT object_id, y, x FROM fx_pixels
WHERE (abs(x - 3.5) <= 2 AND abs(y - 3.5) <= 2 AND v > -0.15) OR v > 0.22"""


def masks(spark: SparkSession, d: str) -> DataFrame:
    centre = (F.abs(F.col("x") - 3.5) <= 2) & (F.abs(F.col("y") - 3.5) <= 2) & (F.col("v") > -0.15)
    return pixels(spark, d).filter(centre | (F.col("v") > 0.22)).select("object_id", "y", "x")


def frames(spark: SparkSession, d: str) -> DataFrame:
    side = F.lit(8).cast("bigint")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("object_id"), side.alias("image_width"), side.alias("image_height")
    )


SQL["fx_points"] = """
SELECT CAST(label AS BIGINT) AS object_id, vec_id AS point_idx,
  4 * CAST(embedding[1] AS DOUBLE) AS x, 4 * CAST(embedding[2] AS DOUBLE) AS y, 4 * CAST(embedding[3] AS DOUBLE) AS z,
  4 * CAST(embedding[4] AS DOUBLE) - 3 AS scale_0, 4 * CAST(embedding[5] AS DOUBLE) - 3 AS scale_1,
  4 * CAST(embedding[6] AS DOUBLE) - 3 AS scale_2, 20 * CAST(embedding[7] AS DOUBLE) AS opacity
FROM embeddings"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """Each label is an object, each embedding one of its points."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, d, "embeddings").select(
        F.col("label").cast("bigint").alias("object_id"),
        F.col("vec_id").alias("point_idx"),
        (4 * at(0)).alias("x"),
        (4 * at(1)).alias("y"),
        (4 * at(2)).alias("z"),
        (4 * at(3) - 3).alias("scale_0"),
        (4 * at(4) - 3).alias("scale_1"),
        (4 * at(5) - 3).alias("scale_2"),
        (20 * at(6)).alias("opacity"),
    )


VIEW_RESOLUTION = 16
# Yaw, pitch, radius and field of view of the three views used for lifting.
VIEWS = (("view_000", 30.0, 15.0, 2.0, 40.0), ("view_001", 150.0, -10.0, 2.0, 40.0), ("view_002", 270.0, 20.0, 2.0, 40.0))

SQL["fx_views"] = """
SELECT * FROM (VALUES ('view_000', 30.0, 15.0, 2.0, 40.0), ('view_001', 150.0, -10.0, 2.0, 40.0),
  ('view_002', 270.0, 20.0, 2.0, 40.0)) v(view_id, yaw_deg, pitch_deg, radius, fov_deg)"""

_AXES = """
  SELECT *, sin(radians(yaw_deg)) * cos(radians(pitch_deg)) * radius AS ex,
    cos(radians(yaw_deg)) * cos(radians(pitch_deg)) * radius AS ey, sin(radians(pitch_deg)) * radius AS ez
  FROM {source}"""


def camera_sql(source: str) -> str:
    """Look-at matrices of a table of views: rows r (right), d (down), f (forward), translation t, focal."""
    return f"""
SELECT *, -(rx * ex + ry * ey + rz * ez) AS tx, -(dx * ex + dy * ey + dz * ez) AS ty,
  -(fx * ex + fy * ey + fz * ez) AS tz
FROM (SELECT *, fy * rz - fz * ry AS dx, fz * rx - fx * rz AS dy, fx * ry - fy * rx AS dz
FROM (SELECT *, fy / greatest(sqrt(fx * fx + fy * fy), 1e-6) AS rx, -fx / greatest(sqrt(fx * fx + fy * fy), 1e-6) AS ry,
  CAST(0 AS DOUBLE) AS rz
FROM (SELECT *, -ex / greatest(n, 1e-6) AS fx, -ey / greatest(n, 1e-6) AS fy, -ez / greatest(n, 1e-6) AS fz
FROM (SELECT *, sqrt(ex * ex + ey * ey + ez * ez) AS n, 0.5 / tan(radians(fov_deg) * 0.5) AS focal
FROM ({_AXES.format(source=source)})))))"""


SQL["fx_cameras"] = "SELECT * FROM (SELECT CAST(yaw_deg AS DOUBLE) AS yaw_deg, * EXCLUDE (yaw_deg) FROM (" + camera_sql(
    "(SELECT view_id, CAST(yaw_deg AS DOUBLE) AS yaw_deg, CAST(pitch_deg AS DOUBLE) AS pitch_deg, "
    "CAST(radius AS DOUBLE) AS radius, CAST(fov_deg AS DOUBLE) AS fov_deg FROM fx_views )"
) + "))"


def cameras(objects: DataFrame) -> DataFrame:
    """The three views of every object, posed."""
    from partloom.operators.cameras import look_at

    names_of = ("view_id", "yaw_deg", "pitch_deg", "radius", "fov_deg")
    specs = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names_of, view)]) for view in VIEWS])
    return look_at(objects.select("object_id", F.explode(specs).alias("_v")).select("object_id", "_v.*"))


# Points as cameras see them: unit-box points of `normalize_points`, projected with half-even pixels.
SQL["fx_unit_box"] = """
SELECT object_id,
  CASE WHEN count(*) FILTER (o > 0.9) > 0 THEN 0.9 WHEN count(*) FILTER (o > 0) > 0 THEN 0.0 ELSE -1.0 END AS tier
FROM (SELECT object_id, 1 / (1 + exp(-opacity)) AS o FROM fx_points ) GROUP BY object_id"""

SQL["fx_box"] = """
SELECT p.object_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1,
  greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z), 1e-6) AS side
FROM fx_points p JOIN fx_unit_box b ON p.object_id = b.object_id
WHERE 1 / (1 + exp(-opacity)) > tier GROUP BY p.object_id"""

SQL["fx_norm"] = """
SELECT p.object_id, point_idx, x / side - (x0 / side + x1 / side) * 0.5 AS x, y / side - (y0 / side + y1 / side) * 0.5 AS y,
  z / side - (z0 / side + z1 / side) * 0.5 AS z, side,
  exp(scale_0) / side AS s0, exp(scale_1) / side AS s1, exp(scale_2) / side AS s2
FROM fx_points p JOIN fx_box b ON p.object_id = b.object_id"""

SQL["fx_projected"] = """
SELECT object_id, point_idx, view_id, depth, s0, s1, s2, focal,
  CASE WHEN depth > 1e-6 THEN (focal * (cx / CASE WHEN depth > 1e-6 THEN depth ELSE 1 END) + 0.5) * 16 END AS u,
  CASE WHEN depth > 1e-6 THEN (focal * (cy / CASE WHEN depth > 1e-6 THEN depth ELSE 1 END) + 0.5) * 16 END AS v
FROM (SELECT object_id, point_idx, view_id, s0, s1, s2, focal, rx * x + ry * y + rz * z + tx AS cx,
  dx * x + dy * y + dz * z + ty AS cy, fx * x + fy * y + fz * z + tz AS depth FROM fx_norm , fx_cameras )"""

SQL["fx_owner"] = """
SELECT object_id, view_id, px, py, arg_min(point_idx, [depth, point_idx]) AS point_idx, min(depth) AS depth
FROM (SELECT *, CAST(least(greatest(round_even(u, 0), 0), 15) AS BIGINT) AS px,
  CAST(least(greatest(round_even(v, 0), 0), 15) AS BIGINT) AS py FROM fx_projected WHERE u IS NOT NULL)
GROUP BY object_id, view_id, px, py"""

SQL["fx_part_masks"] = """
SELECT object_id, view_id, part_idx, px, py
FROM (SELECT DISTINCT object_id FROM fx_points ), fx_views , range(4) p(part_idx), range(16) a(px), range(16) b(py)
WHERE CASE WHEN part_idx < 3 THEN px % 3 = part_idx ELSE px % 3 = 0 AND py < 12 END"""


def part_masks(objects: DataFrame) -> DataFrame:
    """Pixels of four parts per object and view; the fourth part lies inside the first."""
    side = F.sequence(F.lit(0), F.lit(VIEW_RESOLUTION - 1))
    grid = (
        objects.withColumn("view_id", F.explode(F.array(*[F.lit(v[0]) for v in VIEWS])))
        .withColumn("part_idx", F.explode(F.sequence(F.lit(0), F.lit(3))))
        .withColumn("px", F.explode(side))
        .withColumn("py", F.explode(side))
    )
    third = F.col("px") % 3
    inside = F.when(F.col("part_idx") < 3, third == F.col("part_idx")).otherwise((third == 0) & (F.col("py") < 12))
    return grid.filter(inside).select(
        "object_id", "view_id", *[F.col(c).cast("bigint").alias(c) for c in ("part_idx", "px", "py")]
    )


SQL["fx_visible"] = """
SELECT object_id, point_idx, count(DISTINCT view_id) AS visible_count FROM fx_owner GROUP BY object_id, point_idx"""

SQL["fx_votes"] = """
SELECT object_id, part_idx, point_idx, count(*) AS positive_count FROM fx_part_masks m
JOIN fx_owner o USING (object_id, view_id, px, py) GROUP BY object_id, part_idx, point_idx"""

SQL["fx_scores"] = """
SELECT g.object_id, part_idx, 'part_' || part_idx AS part_name, g.point_idx,
  coalesce(positive_count, 0) AS positive_count, coalesce(visible_count, 0) AS visible_count,
  coalesce(positive_count, 0) / CASE WHEN coalesce(visible_count, 0) > 0 THEN visible_count ELSE 1 END AS score
FROM (SELECT object_id, point_idx, part_idx FROM fx_points , range(4) r(part_idx)) g
LEFT JOIN fx_votes v USING (object_id, part_idx, point_idx) LEFT JOIN fx_visible s USING (object_id, point_idx)"""

SQL["fx_best"] = """
SELECT object_id, point_idx, max(score) AS max_score, arg_max(part_idx, [score, -part_idx]) AS best_part,
  any_value(visible_count) AS visible_count, coalesce(list_sort(list(score), 'DESC')[2], 0) AS second_score
FROM fx_scores GROUP BY object_id, point_idx"""


# --- detections, answers, instructions -----------------------------------------------------------

SQL["fx_detections"] = """
SELECT user_id AS object_id, event_type AS part_name, event_id AS seq, value / 500 AS score,
  value / 500 >= 0.1 AS has_mask, (event_id * 37) % 100 AS box_x0
FROM events"""


def detections(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("value") / 500
    return table(spark, d, "events").select(
        F.col("user_id").alias("object_id"),
        F.col("event_type").alias("part_name"),
        F.col("event_id").alias("seq"),
        score.alias("score"),
        (score >= 0.1).alias("has_mask"),
        ((F.col("event_id") * 37) % 100).alias("box_x0"),
    )


SQL["fx_answer_shape"] = """
SELECT event_id, user_id, event_type, value,
  CASE WHEN event_id % 11 = 0 THEN 'truncated' WHEN event_id % 5 = 0 THEN 'prose' WHEN event_id % 3 = 0 THEN 'fenced'
       WHEN event_id % 13 = 0 THEN 'list' WHEN event_id % 17 = 0 THEN 'trailing' ELSE 'plain' END AS shape,
  CASE WHEN event_id % 19 = 0 THEN 'no_parts' WHEN event_id % 23 = 0 THEN 'blank' ELSE 'text' END AS envelope,
  value >= 5 AS recognizable, value >= 10 AS clear_image, event_id % 7 = 0 OR value >= 60 AS cropped,
  event_id % 9 <> 0 AS interactive, value >= 20 AS passed
FROM events"""


def answer_shape(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    shape = (
        F.when(e % 11 == 0, "truncated").when(e % 5 == 0, "prose").when(e % 3 == 0, "fenced")
        .when(e % 13 == 0, "list").when(e % 17 == 0, "trailing").otherwise("plain")
    )
    envelope = F.when(e % 19 == 0, "no_parts").when(e % 23 == 0, "blank").otherwise("text")
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", "user_id", "event_type", "value", shape.alias("shape"), envelope.alias("envelope"),
        (v >= 5).alias("recognizable"), (v >= 10).alias("clear_image"),
        ((e % 7 == 0) | (v >= 60)).alias("cropped"), (e % 9 != 0).alias("interactive"), (v >= 20).alias("passed"),
    )


def answers(spark: SparkSession, d: str) -> DataFrame:
    """One model response per event, as JSON text, in six shapes and three envelopes.

    A crop flag of events divisible by 7 is the STRING "false", which counts as true.
    """

    def flag(name: str) -> Column:
        return F.when(F.col(name), F.lit("true")).otherwise(F.lit("false"))

    cropped = F.when(F.col("event_id") % 7 == 0, F.lit('"false"')).otherwise(flag("cropped"))
    decision = F.concat(
        F.lit('{"recognizable_from_mask_only": '), flag("recognizable"),
        F.lit(', "clear_not_blurry": '), flag("clear_image"),
        F.lit(', "severe_crop": '), cropped,
        F.lit(', "interactive_object": '), flag("interactive"),
        F.lit(', "pass": '), flag("passed"),
        F.lit(', "short_reason": "seen {'), F.col("event_type"), F.lit('} once"}'),
    )
    shaped = (
        F.when(F.col("shape") == "truncated", F.substring(decision, 1, 60))
        .when(F.col("shape") == "prose", F.concat(F.lit("Here is the answer:\n"), decision, F.lit("\nDone.")))
        .when(F.col("shape") == "fenced", F.concat(F.lit("```json\n"), decision, F.lit("\n```")))
        .when(F.col("shape") == "list", F.concat(F.lit("["), decision, F.lit(", 1]")))
        .when(F.col("shape") == "trailing", F.concat(decision, F.lit(" and more")))
        .otherwise(decision)
    )
    half = F.floor(F.length("answer") / 2).cast("int")
    pieces = F.when(F.col("envelope") == "blank", F.array(F.struct(F.lit("").alias("text")))).otherwise(
        F.array(
            F.struct(F.substring(F.col("answer"), F.lit(1), half).alias("text")),
            F.struct(F.substring(F.col("answer"), half + 1, F.length("answer")).alias("text")),
        )
    )
    candidate = F.struct(F.struct(pieces.alias("parts")).alias("content"))
    body = F.when(F.col("envelope") == "no_parts", F.lit('{"error": "busy"}')).otherwise(
        F.to_json(F.struct(F.array(candidate).alias("candidates")))
    )
    return answer_shape(spark, d).withColumn("answer", shaped).withColumn("response", body)


SQL["fx_instructions"] = """
SELECT conv_id, turn, role, CASE turn % 4 WHEN 0 THEN '- ' || text WHEN 1 THEN CASE WHEN conv_id % 2 = 0 THEN '1. 1. ' ELSE '1. ' END || text
  WHEN 2 THEN '  "' || text || '"' ELSE translate(text, 'aeiou', 'AEIOU') END AS raw
FROM conversations"""


def raw_instructions(spark: SparkSession, d: str) -> DataFrame:
    turn, text = F.col("turn") % 4, F.col("text")
    raw = (
        F.when(turn == 0, F.concat(F.lit("- "), text))
        .when(turn == 1, F.concat(F.when(F.col("conv_id") % 2 == 0, "1. 1. ").otherwise("1. "), text))
        .when(turn == 2, F.concat(F.lit('  "'), text, F.lit('"')))
        .otherwise(F.translate(text, "aeiou", "AEIOU"))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", "role", raw.alias("raw"))


# --- predictions, manifests, files, histories ----------------------------------------------------

SQL["fx_preds"] = """
SELECT object_id AS sample_id, CAST(label AS VARCHAR) AS category, y * 8 + x AS pos,
  round(1 / (1 + exp(-8 * v)), 2) AS prob,
  least(greatest(3 * v + 0.1 * (((y * 8 + x + 1) % 5) - 2), 0), 1) AS target
FROM fx_pixels"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding as one sample of 64 points with a predicted and a true score; many scores tie."""
    pos = F.col("y") * 8 + F.col("x")
    return pixels(spark, d).select(
        F.col("object_id").alias("sample_id"),
        F.col("label").cast("string").alias("category"),
        pos.alias("pos"),
        F.round(1 / (1 + F.exp(-8 * F.col("v"))), 2).alias("prob"),
        clamp(3 * F.col("v") + 0.1 * (((pos + 1) % 5) - 2)).alias("target"),
    )


SQL["fx_manifest"] = """
SELECT d.doc_id AS sample_id, 'object_' || (d.doc_id % 97) AS object_id, lang AS category_name, d.source AS part_name,
  CASE WHEN l.doc_id IS NULL THEN 'pseudo' ELSE 'real' END AS kind,
  CASE WHEN d.doc_id % 10 < 8 THEN 'train' WHEN d.doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS object_split,
  CASE WHEN d.doc_id % 3 = 0 THEN 'unseen' WHEN d.doc_id % 3 = 1 THEN 'seen' END AS instruction_split,
  CASE WHEN lang = 'fr' THEN 'unseen' ELSE 'seen' END AS category_split, n_chars,
  (d.doc_id % 7) AS target_index, d.doc_id // 50 AS pack
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Sample rows: labelled documents are real, the others pseudo-labelled."""
    labelled = table(spark, d, "labels").select("doc_id", F.lit(True).alias("labelled"))
    i = F.col("doc_id")
    return (
        table(spark, d, "documents")
        .select("doc_id", "lang", "source", "n_chars")
        .join(labelled, "doc_id", "left")
        .select(
            i.alias("sample_id"),
            F.concat(F.lit("object_"), (i % 97).cast("string")).alias("object_id"),
            F.col("lang").alias("category_name"),
            F.col("source").alias("part_name"),
            F.when(F.col("labelled"), "real").otherwise("pseudo").alias("kind"),
            F.when(i % 10 < 8, "train").when(i % 10 == 8, "val").otherwise("test").alias("object_split"),
            F.when(i % 3 == 0, "unseen").when(i % 3 == 1, "seen").alias("instruction_split"),
            F.when(F.col("lang") == "fr", "unseen").otherwise("seen").alias("category_split"),
            "n_chars",
            (i % 7).alias("target_index"),
            div(i, 50).alias("pack"),
        )
    )


SQL["fx_files"] = """
SELECT page_id AS file_id,
  regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')
    || CASE page_id % 6 WHEN 0 THEN '/page.html' WHEN 1 THEN '/__pycache__/page.pyc' WHEN 2 THEN '/weights.PTH'
       WHEN 3 THEN '/dist/page.html' WHEN 4 THEN '/notes.md' ELSE '/image.JPG' END AS path,
  CASE WHEN page_id % 17 = 0 THEN 12 * 1024 * 1024 ELSE strlen(html) END AS size,
  html || CASE WHEN page_id % 8 = 0 THEN ' api_key = "abcdef0123456789ABCDEF"' WHEN page_id % 10 = 0 THEN ' see /mnt/store'
       ELSE '' END AS content
FROM pages"""


def files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files of a release tree, some with a planted secret, machine path or odd place."""
    i = F.col("page_id")
    tail = F.element_at(
        F.array(*[F.lit(t) for t in (
            "/page.html", "/__pycache__/page.pyc", "/weights.PTH", "/dist/page.html", "/notes.md", "/image.JPG"
        )]),
        (i % 6 + 1).cast("int"),
    )
    root = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    planted = (
        F.when(i % 8 == 0, ' api_key = "abcdef0123456789ABCDEF"').when(i % 10 == 0, " see /mnt/store").otherwise("")
    )
    size = F.when(i % 17 == 0, F.lit(12 * 1024 * 1024)).otherwise(F.octet_length("html"))
    return table(spark, d, "pages").select(
        i.alias("file_id"),
        F.concat(root, tail).alias("path"),
        size.cast("bigint").alias("size"),
        F.concat("html", planted).alias("content"),
    )


SQL["fx_history"] = """
SELECT user_id AS run_id, event_id AS epoch, CASE WHEN event_id % 29 = 0 THEN NULL ELSE value END AS metric
FROM events"""


def history(spark: SparkSession, d: str) -> DataFrame:
    """One training run per user; metrics of some epochs are not a number."""
    metric = F.when(F.col("event_id") % 29 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("epoch"), metric.alias("metric")
    )


def object_name(column: str = "object_id") -> Column:
    return names.object_id(F.col(column))
