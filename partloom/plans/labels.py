"""Labels: detections, projection, votes, neighbours, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.config import FusionConfig
from partloom.operators import cameras as cam, detections as det, fusion, lifting, neighbors
from partloom.plans import tables as t
from partloom.plans.registry import query
from partloom.plans.tables import SQL, q6, r6, views
from partloom.session import SharedStages

SIZE = t.VIEW_RESOLUTION


class Lifted:
    """Stages of the lifting of one input, each computed once for all that a query takes from it."""

    def __init__(self, spark, d):
        self.spark, self.d, self.stage = spark, d, SharedStages()

    def points(self):
        return self.stage(t.points(self.spark, self.d), "points")

    def objects(self):
        return self.stage(self.points().select("object_id").distinct(), "objects")

    def active(self):
        return lifting.activate_geometry(self.points())

    def normalized(self):
        return lifting.normalize_points(self.active())

    def projected(self):
        return lifting.project_points(self.normalized(), t.cameras(self.objects()), SIZE, SIZE)

    def pixels(self):
        return lifting.to_pixels(self.projected(), SIZE, SIZE)

    def owners(self):
        return self.stage(lifting.pixel_owners(self.pixels()), "owners")

    def masks(self):
        return t.part_masks(self.objects())

    def parts(self):
        index = F.sequence(F.lit(0), F.lit(3))
        listed = self.objects().withColumn("part_idx", F.explode(index))
        part = F.col("part_idx").cast("bigint")
        return listed.select("object_id", part.alias("part_idx"), F.concat(F.lit("part_"), part.cast("string")).alias("part_name"))

    def visible(self):
        return lifting.visible_counts(self.owners(), lifting.masked_views(self.masks()))

    def votes(self):
        return lifting.part_votes(self.owners(), self.masks())

    def scores(self):
        return self.stage(lifting.part_scores(self.points(), self.parts(), self.votes(), self.visible()), "scores")


# --- detections ----------------------------------------------------------------------------------


@query(
    "segmentation_targets",
    """SELECT printf('object_%06d', user_id) AS object_id, printf('view_%03d', v) AS view_id, event_type AS part_name,
  'render/' || printf('view_%03d', v) || '.png' AS image_path,
  'seg2d/' || printf('view_%03d', v) || '/' || event_type || '_mask.png' AS mask_path,
  CASE WHEN user_id % 2 = 0 THEN 'the ' || event_type || ' of the chair' ELSE 'the thing' END AS prompt
FROM (SELECT DISTINCT user_id, event_type FROM events), range(6) r(v)""",
)
def segmentation_targets(spark, d):
    objects = t.table(spark, d, "events").select("user_id", "event_type").distinct()
    obj = t.object_name("user_id")
    views_of = cam.standard_views(objects.select(obj.alias("object_id")).distinct()).withColumn(
        "view_pos", F.substring("view_id", 6, 3).cast("int")
    )
    named = objects.select(
        obj.alias("object_id"),
        F.lit("chair").alias("object_name"),
        F.col("event_type").alias("part_name"),
        F.when(F.col("user_id") % 2 == 1, F.lit("the thing")).otherwise(F.lit("")).alias("prompt"),
        F.length("event_type").alias("part_pos"),
    )
    return det.segmentation_targets(views_of, named).select(
        "object_id", "view_id", "part_name", "image_path", "mask_path", "prompt"
    )


@query(
    "render_views",
    """SELECT doc_id AS object_id, view_id, canonical_view, yaw_deg::DOUBLE AS yaw_deg, pitch_deg::DOUBLE AS pitch_deg,
  2.0::DOUBLE AS radius, 40.0::DOUBLE AS fov_deg, 512::BIGINT AS resolution, 'render/' || view_id || '.png' AS image_path
FROM documents, (VALUES ('view_000', 'front', 0, 0), ('view_001', 'right', 90, 0), ('view_002', 'back', 180, 0),
  ('view_003', 'left', -90, 0), ('view_004', 'top', 0, 89), ('view_005', 'bottom', 0, -89)) v(view_id, canonical_view, yaw_deg, pitch_deg)""",
)
def render_views(spark, d):
    objects = t.table(spark, d, "documents").select(F.col("doc_id").alias("object_id"))
    return cam.standard_views(objects).withColumn("resolution", F.col("resolution").cast("bigint"))


@query(
    "default_camera",
    f"""SELECT user_id AS object_id, {q6('avg(CASE WHEN event_id % 4 = 0 THEN 2.0 ELSE value / 100 END)')} AS radius,
  {q6('avg(CASE WHEN event_id % 5 = 0 THEN 40.0 ELSE 30 + event_id % 20 END)')} AS fov_deg,
  arg_min(256 + 256 * (event_id % 3), event_id)::BIGINT AS resolution, 3::BIGINT AS num_views FROM events GROUP BY user_id""",
)
def default_camera(spark, d):
    e = F.col("event_id")
    source = t.table(spark, d, "events").select(
        F.col("user_id").alias("object_id"),
        "event_id",
        F.when(e % 4 != 0, F.col("value") / 100).alias("radius"),
        F.when(e % 5 != 0, 30.0 + e % 20).alias("fov_deg"),
        (256 + 256 * (e % 3)).alias("resolution"),
    )
    shown = cam.visibility_views(cam.default_camera(source, order="event_id"))
    return shown.groupBy("object_id", "radius", "fov_deg", "resolution").agg(F.count(F.lit(1)).alias("num_views")).select(
        "object_id", r6("radius").alias("radius"), r6("fov_deg").alias("fov_deg"), "resolution", "num_views"
    )


@query(
    "best_detection",
    views("fx_detections")
    + f"""SELECT object_id, part_name, {q6('score')} AS score, seq, score >= 0.1 AS has_mask, CASE WHEN score >= 0.1 THEN box_x0 END AS box_x0
FROM (SELECT *, row_number() OVER (PARTITION BY object_id, part_name ORDER BY score DESC, seq) AS n FROM fx_detections ) WHERE n = 1""",
)
def best_detection(spark, d):
    return det.best_detection(t.detections(spark, d)).withColumn("score", r6("score"))


SQL["fx_part_order"] = """
SELECT object_id, part_name, min(seq) AS first_seq, count(*) AS num_targets,
  row_number() OVER (PARTITION BY object_id ORDER BY min(seq)) - 1 AS part_pos FROM fx_detections GROUP BY object_id, part_name"""


@query("part_order", views("fx_part_order") + "SELECT * FROM fx_part_order")
def part_order(spark, d):
    return det.part_order(t.detections(spark, d)).withColumn("part_pos", F.col("part_pos").cast("bigint"))


@query(
    "mask_selection",
    views("fx_part_order")
    + """, m AS (SELECT *, row_number() OVER (PARTITION BY object_id, part_name ORDER BY seq) - 1 AS mask_pos FROM fx_detections WHERE has_mask),
s AS (SELECT object_id, part_name, row_number() OVER (PARTITION BY object_id ORDER BY part_pos) - 1 AS selected_pos
  FROM fx_part_order SEMI JOIN m USING (object_id, part_name))
SELECT object_id, part_name, seq, mask_pos, selected_pos FROM m JOIN s USING (object_id, part_name) WHERE mask_pos < 3 AND selected_pos < 3""",
)
def mask_selection(spark, d):
    return det.mask_selection(t.detections(spark, d)).select(
        "object_id", "part_name", "seq", "mask_pos", F.col("selected_pos").cast("bigint").alias("selected_pos")
    )


@query(
    "view_shape_check",
    """SELECT user_id AS object_id, event_type AS view_id, arg_min(480 + 16 * (user_id % 3 + (event_id % 97 = 0)::INT), event_id)::BIGINT AS height,
  640::BIGINT AS width, count(*) AS num_masks, count(DISTINCT event_id % 97 = 0) > 1 AS shape_mismatch FROM events WHERE value >= 50
GROUP BY user_id, event_type""",
)
def view_shape_check(spark, d):
    height = 480 + 16 * (F.col("user_id") % 3 + (F.col("event_id") % 97 == 0).cast("bigint"))
    masks = t.table(spark, d, "events").select(
        F.col("user_id").alias("object_id"), F.col("event_type").alias("view_id"), F.col("event_id").alias("seq"),
        height.alias("height"), F.lit(640).cast("bigint").alias("width"), (F.col("value") >= 50).alias("has_mask"),
    )
    return det.view_shape_check(masks)


# --- geometry and projection ---------------------------------------------------------------------


@query(
    "activate_geometry",
    views("fx_points")
    + "SELECT object_id, point_idx, "
    + ", ".join(f"{q6(f'exp(scale_{i})')} AS s{i}" for i in range(3))
    + f", {q6('1 / (1 + exp(-opacity))')} AS opacity FROM fx_points",
)
def activate_geometry(spark, d):
    return Lifted(spark, d).active().select("object_id", "point_idx", *[r6(c).alias(c) for c in ("s0", "s1", "s2", "opacity")])


_XYZS = ("x", "y", "z", "s0", "s1", "s2")


@query(
    "normalize_points",
    views("fx_norm") + f"SELECT object_id, point_idx, {', '.join(f'{q6(c)} AS {c}' for c in _XYZS)} FROM fx_norm",
)
def normalize_points(spark, d):
    return Lifted(spark, d).normalized().select("object_id", "point_idx", *[r6(c).alias(c) for c in _XYZS])


@query(
    "project_points",
    views("fx_projected")
    + f"SELECT object_id, point_idx, view_id, {q6('u')} AS u, {q6('v')} AS v, {q6('depth')} AS depth FROM fx_projected",
)
def project_points(spark, d):
    return Lifted(spark, d).projected().select("object_id", "point_idx", "view_id", *[r6(c).alias(c) for c in ("u", "v", "depth")])


SQL["fx_radius"] = """
SELECT *, CASE WHEN depth > 1e-6 THEN greatest(least(abs(focal) * 16.0 * max_scale / depth * 1.75, 12), 0) ELSE 0 END AS radius_px
FROM (SELECT *, greatest(s0, s1, s2) AS max_scale FROM fx_projected )"""


@query(
    "projected_radius",
    views("fx_radius")
    + f"SELECT object_id, point_idx, view_id, {q6('max_scale')} AS max_scale, {q6('radius_px')} AS radius_px FROM fx_radius",
)
def projected_radius(spark, d):
    sized = lifting.projected_radius(Lifted(spark, d).projected(), SIZE, SIZE)
    return sized.select("object_id", "point_idx", "view_id", r6("max_scale").alias("max_scale"), r6("radius_px").alias("radius_px"))


@query(
    "zbuffer",
    views("fx_owner") + f"SELECT object_id, view_id, px, py, point_idx, {q6('depth')} AS depth FROM fx_owner",
)
def zbuffer(spark, d):
    return Lifted(spark, d).owners().withColumn("depth", r6("depth"))


@query(
    "depth_buffer",
    views("fx_owner")
    + f"""SELECT object_id, view_id, px::BIGINT AS px, py::BIGINT AS py, {q6('coalesce(depth, 1e9)')} AS depth
FROM (SELECT DISTINCT object_id FROM fx_points ), fx_views , range(16) a(px), range(16) b(py)
LEFT JOIN fx_owner o USING (object_id, view_id, px, py)""".replace(
        "FROM (SELECT", "FROM (SELECT object_id, view_id, px, py FROM (SELECT", 1
    ).replace("range(16) b(py)", "range(16) b(py)) g", 1),
)
def depth_buffer(spark, d):
    objects = t.points(spark, d).select("object_id").distinct()
    side = F.sequence(F.lit(0), F.lit(SIZE - 1))
    grid = (
        objects.withColumn("view_id", F.explode(F.array(*[F.lit(v[0]) for v in t.VIEWS])))
        .withColumn("px", F.explode(side))
        .withColumn("py", F.explode(side))
        .withColumns({"px": F.col("px").cast("bigint"), "py": F.col("py").cast("bigint")})
    )
    return lifting.depth_buffer(Lifted(spark, d).pixels(), grid).withColumn("depth", r6(F.least("depth", F.lit(1e9))))


@query(
    "five_tap_visibility",
    views("fx_radius", "fx_owner")
    + """, p AS (SELECT *, CAST(least(greatest(round_even(u, 0), 0), 15) AS BIGINT) AS px, CAST(least(greatest(round_even(v, 0), 0), 15) AS BIGINT) AS py,
  greatest(ceil(radius_px * 0.5), 1)::BIGINT AS step, greatest(max_scale * 0.75, 1e-3) AS tol FROM fx_radius WHERE u IS NOT NULL)
SELECT p.object_id, p.view_id, p.point_idx, bool_or(o.depth IS NULL OR p.depth <= o.depth + tol) AS visible
FROM (SELECT p.*, least(greatest(px + mx * step, 0), 15) AS qx, least(greatest(py + my * step, 0), 15) AS qy
  FROM p, (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) m(mx, my)) p
LEFT JOIN fx_owner o ON o.object_id = p.object_id AND o.view_id = p.view_id AND o.px = qx AND o.py = qy GROUP BY ALL""",
)
def five_tap_visibility(spark, d):
    sized = lifting.projected_radius(Lifted(spark, d).projected(), SIZE, SIZE)
    return lifting.five_tap_visibility(lifting.to_pixels(sized, SIZE, SIZE), SIZE, SIZE)


SQL["fx_pose"] = """
SELECT DISTINCT object_id, 1 + object_id * 0.1 AS qw, 0.2 * object_id AS qx, 0.3 AS qy, -0.1 * object_id AS qz, 0.5 + object_id * 0.05 AS s,
  0.1 AS tx, -0.2 AS ty, 3.0 AS tz, 1.2 AS fx, 1.1 AS fy, 0.5 AS cx_px, 0.5 AS cy_px FROM fx_points"""

_Q = "2.0 / (qw * qw + qx * qx + qy * qy + qz * qz)"


@query(
    "source_projection",
    views("fx_pose")
    + f""", m AS (SELECT p.*, o.* EXCLUDE (object_id), ({_Q})::DOUBLE AS n FROM fx_points p JOIN (
  SELECT object_id, {', '.join(f'{c}::DOUBLE AS {c}' for c in ('qw', 'qx', 'qy', 'qz', 's', 'tx', 'ty', 'tz', 'fx', 'fy', 'cx_px', 'cy_px'))} FROM fx_pose) o USING (object_id)),
c AS (SELECT *, x * s * (1 - n * (qy * qy + qz * qz)) + y * s * n * (qx * qy + qz * qw) + z * s * n * (qx * qz - qy * qw) + tx AS px,
  x * s * n * (qx * qy - qz * qw) + y * s * (1 - n * (qx * qx + qz * qz)) + z * s * n * (qy * qz + qx * qw) + ty AS py,
  x * s * n * (qx * qz + qy * qw) + y * s * n * (qy * qz - qx * qw) + z * s * (1 - n * (qx * qx + qy * qy)) + tz AS pz FROM m)
SELECT object_id, point_idx, {q6('cx_px - fx * px / pz')} AS u, {q6('cy_px - fy * py / pz')} AS v FROM c""",
)
def source_projection(spark, d):
    i = F.col("object_id")
    points = t.points(spark, d)
    poses = points.select("object_id").distinct().select(
        "object_id",
        (1 + i * 0.1).alias("qw"), (0.2 * i).alias("qx"), F.lit(0.3).alias("qy"), (-0.1 * i).alias("qz"), (0.5 + i * 0.05).alias("s"),
        F.lit(0.1).alias("tx"), F.lit(-0.2).alias("ty"), F.lit(3.0).alias("tz"),
        F.lit(1.2).alias("fx"), F.lit(1.1).alias("fy"), F.lit(0.5).alias("cx_px"), F.lit(0.5).alias("cy_px"),
    )
    return lifting.source_projection(points, poses).select("object_id", "point_idx", r6("u").alias("u"), r6("v").alias("v"))


# --- votes and scores ----------------------------------------------------------------------------


@query("point_visibility", views("fx_visible") + "SELECT * FROM fx_visible")
def point_visibility(spark, d):
    return Lifted(spark, d).visible()


@query("part_votes", views("fx_votes") + "SELECT * FROM fx_votes")
def part_votes(spark, d):
    return Lifted(spark, d).votes()


@query(
    "part_scores",
    views("fx_scores")
    + f"""SELECT object_id, part_idx, part_name, sum(positive_count)::BIGINT AS positive_count_total, sum(visible_count)::BIGINT AS visible_count_total,
  {q6('avg(score)')} AS score_mean FROM fx_scores GROUP BY ALL""",
)
def part_scores(spark, d):
    return lifting.vote_summary(Lifted(spark, d).scores()).withColumn("score_mean", r6("score_mean"))


@query("best_part", views("fx_best") + f"SELECT object_id, point_idx, best_part, {q6('max_score')} AS max_score FROM fx_best")
def best_part(spark, d):
    lifted = Lifted(spark, d)
    best = lifting.add_pointless_objects(lifted.points(), lifting.best_part(lifted.scores()))
    return best.select("object_id", "point_idx", "best_part", r6("max_score").alias("max_score"))


@query(
    "ambiguity",
    views("fx_best")
    + f"SELECT object_id, point_idx, {q6('second_score')} AS second_score, max_score - second_score < 0.05 AS ambiguous FROM fx_best",
)
def ambiguity(spark, d):
    return lifting.ambiguity(Lifted(spark, d).scores()).select(
        "object_id", "point_idx", r6("second_score").alias("second_score"), "ambiguous"
    )


@query(
    "unknown_mask",
    views("fx_best")
    + """SELECT object_id, point_idx, visible_count <= 0 AS invisible, max_score < 0.3 AS low_confidence,
  visible_count <= 0 OR max_score < 0.3 AS unknown FROM fx_best""",
)
def unknown_mask(spark, d):
    return fusion.unknown_mask(lifting.best_part(Lifted(spark, d).scores())).select(
        "object_id", "point_idx", "invisible", "low_confidence", "unknown"
    )


_HASHED = "('0x' || md5('part_' || best_part)[1:4])::INT % 200"


@query(
    "visibility_pixels",
    views("fx_owner", "fx_best")
    + ", c AS (SELECT o.*, best_part, least(max_score, 1) AS score, " + _HASHED
    + """ AS h FROM fx_owner o JOIN fx_best USING (object_id, point_idx))
SELECT object_id, view_id, px, py, """
    + ", ".join(
        f"CASE WHEN score > 0 THEN floor((55 + (h * {k}) % 200) * score)::BIGINT ELSE 255 END AS {n}"
        for n, k in (("r", 37), ("g", 67), ("b", 97))
    )
    + ", CASE WHEN score > 0 THEN 255 ELSE 46 END::BIGINT AS alpha FROM c",
)
def visibility_pixels(spark, d):
    lifted = Lifted(spark, d)
    return lifting.visibility_pixels(lifted.owners(), lifting.best_part(lifted.scores()), lifted.parts())


@query(
    "bilinear_sample",
    views("fx_pixels")
    + f""", c AS (SELECT e.vec_id AS sample_id, p::BIGINT AS point_idx, w::BIGINT AS view_id, ((e.vec_id * 7 + p * 13 + w * 5) % 101) / 100.0::DOUBLE AS u,
  ((e.vec_id * 3 + p * 29 + w * 11) % 101) / 100.0::DOUBLE AS v, (e.vec_id + p + w) % 3 <> 0 AS visible FROM embeddings e, range(8) r(p), range(2) s(w)),
s AS (SELECT c.*, floor(v * 8 - 0.5) + dy AS gy, floor(u * 8 - 0.5) + dx AS gx,
  CASE WHEN dy = 1 THEN v * 8 - 0.5 - floor(v * 8 - 0.5) ELSE 1 - (v * 8 - 0.5 - floor(v * 8 - 0.5)) END *
  CASE WHEN dx = 1 THEN u * 8 - 0.5 - floor(u * 8 - 0.5) ELSE 1 - (u * 8 - 0.5 - floor(u * 8 - 0.5)) END AS weight
  FROM c, range(2) a(dy), range(2) b(dx))
SELECT s.sample_id, s.point_idx, {q6('coalesce(sum(CASE WHEN visible THEN weight * (p.v + view_id) END), 0) / greatest(any_value(seen), 1)')} AS value
FROM s JOIN (SELECT sample_id, point_idx, count(*) FILTER (visible) AS seen FROM c GROUP BY ALL) n USING (sample_id, point_idx)
LEFT JOIN fx_pixels p ON p.object_id = s.sample_id AND p.y = s.gy AND p.x = s.gx GROUP BY ALL""",
)
def bilinear_sample(spark, d):
    """Two views of each image, the second one brighter by one, sampled at eight points."""
    grid = (
        t.pixels(spark, d)
        .withColumn("view_id", F.explode(F.array(F.lit(0), F.lit(1))))
        .select(
            F.col("object_id").alias("sample_id"), F.col("view_id").cast("bigint").alias("view_id"),
            F.col("y").alias("gy"), F.col("x").alias("gx"), F.lit(0).alias("channel"), (F.col("v") + F.col("view_id")).alias("value"),
        )
    )
    i, p, w = F.col("sample_id"), F.col("point_idx"), F.col("view_id")
    coords = (
        t.table(spark, d, "embeddings")
        .select(F.col("vec_id").alias("sample_id"))
        .withColumn("point_idx", F.explode(F.sequence(F.lit(0), F.lit(7))))
        .withColumn("view_id", F.explode(F.sequence(F.lit(0), F.lit(1))))
        .withColumns({"point_idx": p.cast("bigint"), "view_id": w.cast("bigint")})
        .withColumns(
            {
                "u": ((i * 7 + p * 13 + w * 5) % 101) / 100.0,
                "v": ((i * 3 + p * 29 + w * 11) % 101) / 100.0,
                "visible": (i + p + w) % 3 != 0,
            }
        )
    )
    return lifting.bilinear_sample(grid, coords, 8).select("sample_id", "point_idx", r6("value").alias("value"))


# --- neighbours and fusion -----------------------------------------------------------------------

SQL["fx_knn"] = """
SELECT object_id, point_idx, rank - 1 AS rank, neighbor_idx, distance FROM (
SELECT a.object_id, a.point_idx, b.point_idx AS neighbor_idx,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance,
  row_number() OVER (PARTITION BY a.object_id, a.point_idx ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)
    + (a.z - b.z) * (a.z - b.z), b.point_idx) AS rank
FROM fx_points a JOIN fx_points b USING (object_id)) WHERE rank BETWEEN 2 AND 33"""

SQL["fx_spacing"] = "SELECT object_id, median(distance) AS local_spacing FROM fx_knn WHERE rank = 1 GROUP BY object_id"

K = FusionConfig().hole_fill_knn_k


@query("knn", views("fx_knn") + f"SELECT object_id, point_idx, rank, neighbor_idx, {q6('distance')} AS distance FROM fx_knn")
def knn(spark, d):
    found = neighbors.nearest_neighbors(t.points(spark, d), K)
    return found.withColumns({"rank": F.col("rank").cast("bigint"), "distance": r6("distance")})


@query("local_spacing", views("fx_spacing") + f"SELECT object_id, {q6('local_spacing')} AS local_spacing FROM fx_spacing")
def local_spacing(spark, d):
    found = neighbors.nearest_neighbors(t.points(spark, d), 1)
    return neighbors.local_spacing(found).withColumn("local_spacing", r6("local_spacing"))


@query(
    "knn_within_radius",
    views("fx_spacing")
    + """SELECT object_id, point_idx, neighbor_idx FROM fx_knn JOIN fx_spacing USING (object_id) WHERE distance <= local_spacing * 1.5""",
)
def knn_within_radius(spark, d):
    found = neighbors.nearest_neighbors(t.points(spark, d), K)
    return neighbors.within_radius(found, neighbors.local_spacing(found), 1.5).select("object_id", "point_idx", "neighbor_idx")


SQL["fx_overlap"] = """
SELECT a.object_id, a.part_idx AS part_a, b.part_idx AS part_b, count(*) AS overlap_count FROM fx_scores a
JOIN fx_scores b ON a.object_id = b.object_id AND a.point_idx = b.point_idx AND a.part_idx < b.part_idx
WHERE a.score > 0 AND b.score > 0 GROUP BY ALL"""


@query("part_overlap", views("fx_overlap") + "SELECT * FROM fx_overlap")
def part_overlap(spark, d):
    return fusion.part_overlap(Lifted(spark, d).scores())


# Greedy pruning as recursion: parts are taken in order, and each joins the kept list or not.
SQL["fx_counts"] = """
SELECT object_id, part_idx, part_name, count(*) FILTER (score > 0) AS point_count,
  row_number() OVER (PARTITION BY object_id ORDER BY count(*) FILTER (score > 0), part_name, part_idx) AS place
FROM fx_scores GROUP BY object_id, part_idx, part_name"""

SQL["fx_rivals"] = """
SELECT c.object_id, c.part_idx, c.place, list(o.base_idx) FILTER (o.base_idx IS NOT NULL) AS rivals FROM fx_counts c LEFT JOIN (
  SELECT x.object_id, x.part_idx, y.part_idx AS base_idx FROM fx_counts x JOIN fx_counts y ON x.object_id = y.object_id AND y.place < x.place
  JOIN fx_overlap v ON v.object_id = x.object_id AND v.part_a = least(x.part_idx, y.part_idx) AND v.part_b = greatest(x.part_idx, y.part_idx)
  WHERE x.point_count > 0 AND y.point_count > 0
    AND abs(x.point_count - y.point_count) / greatest(x.point_count, y.point_count) < 0.3
    AND overlap_count / least(x.point_count, y.point_count) > 0.5) o ON o.object_id = c.object_id AND o.part_idx = c.part_idx
GROUP BY c.object_id, c.part_idx, c.place"""

_PRUNED = """, walk AS (
  SELECT object_id, 0::BIGINT AS place, []::BIGINT[] AS kept FROM (SELECT DISTINCT object_id FROM fx_counts )
  UNION ALL SELECT r.object_id, r.place, CASE WHEN list_has_any(kept, coalesce(rivals, [])) THEN kept ELSE list_append(kept, r.part_idx) END
  FROM walk w JOIN fx_rivals r ON r.object_id = w.object_id AND r.place = w.place + 1),
final AS (SELECT object_id, arg_max(kept, place) AS kept FROM walk GROUP BY object_id)
"""


@query(
    "prune_duplicates",
    views("fx_rivals").replace("WITH ", "WITH RECURSIVE ", 1)
    + _PRUNED
    + """SELECT c.object_id, c.part_idx, c.point_count, list_contains(f.kept, c.part_idx) AS kept,
  CASE WHEN NOT list_contains(f.kept, c.part_idx) THEN (SELECT arg_min(b.part_idx, b.place) FROM fx_counts b
    WHERE b.object_id = c.object_id AND list_contains(f.kept, b.part_idx) AND list_contains(r.rivals, b.part_idx)) END AS base_idx
FROM fx_counts c JOIN final f USING (object_id) JOIN fx_rivals r ON r.object_id = c.object_id AND r.part_idx = c.part_idx""",
)
def prune_duplicates(spark, d):
    return fusion.prune_duplicates(Lifted(spark, d).scores()).select("object_id", "part_idx", "point_count", "kept", "base_idx")


# Looser settings than the defaults, so that filling takes several rounds on few points.
FILL = FusionConfig(hole_fill_knn_k=8, hole_fill_max_distance_factor=1.6, hole_fill_min_support_ratio=0.5)


def sql_fill_rounds(cells: str, k: int, factor: float, ratio: float) -> str:
    """Hole filling as recursion over the whole state: every round carries all cells on.

    `cells` is a view of (`object_id, part_idx, point_idx, score, visible_count`). The views end in `st`, whose
    last turn is the filled state.
    """
    return f""", near AS MATERIALIZED (SELECT object_id, point_idx, neighbor_idx FROM fx_knn JOIN fx_spacing USING (object_id)
  WHERE rank <= {k} AND distance <= local_spacing * {factor}),
need AS (SELECT object_id, point_idx, greatest(2, ceil(count(*) * {ratio})) AS need FROM near GROUP BY ALL HAVING count(*) >= 2),
unsure AS (SELECT object_id, point_idx FROM {cells} GROUP BY ALL HAVING max(visible_count) <= 0 OR max(score) < 0.3),
start AS MATERIALIZED (SELECT c.*, n.need, u.point_idx IS NOT NULL AS unsure FROM {cells} c LEFT JOIN need n USING (object_id, point_idx)
  LEFT JOIN unsure u USING (object_id, point_idx)),
st AS (SELECT object_id, part_idx, point_idx, need, score::DOUBLE AS s, score > 0 AS lit, score > 0 AS seed,
    unsure AND score <= 0 AND need IS NOT NULL AS open, 0 AS turn, 0 AS filled FROM start
  UNION ALL SELECT c.object_id, c.part_idx, c.point_idx, c.need,
    CASE WHEN NOT c.lit AND c.open AND a.sup >= c.need THEN coalesce(a.seed_sum / a.seed_sup, a.total / a.sup) ELSE c.s END,
    c.lit OR coalesce(c.open AND a.sup >= c.need, false), c.seed, c.open, c.turn + 1,
    CASE WHEN NOT c.lit AND c.open AND a.sup >= c.need THEN c.turn + 1 ELSE c.filled END
  FROM st c LEFT JOIN (SELECT b.object_id, b.part_idx, n.point_idx, count(*) AS sup, sum(b.s) AS total, sum(b.s) FILTER (b.seed) AS seed_sum,
      nullif(count(*) FILTER (b.seed), 0) AS seed_sup
    FROM st b JOIN near n ON n.object_id = b.object_id AND n.neighbor_idx = b.point_idx WHERE b.lit GROUP BY ALL) a
    ON a.object_id = c.object_id AND a.part_idx = c.part_idx AND a.point_idx = c.point_idx WHERE c.turn < 32)
"""


@query(
    "hole_fill",
    views("fx_spacing", "fx_scores").replace("WITH ", "WITH RECURSIVE ", 1)
    + sql_fill_rounds("fx_scores", 8, 1.6, 0.5)
    + f"SELECT object_id, part_idx, point_idx, {q6('s')} AS fill_score, filled AS round FROM st WHERE turn = 32 AND filled > 0",
)
def hole_fill(spark, d):
    lifted = Lifted(spark, d)
    fills = fusion.fill_holes(lifted.scores(), lifted.points(), FILL)
    return fills.withColumn("fill_score", r6("fill_score"))


@query(
    "fused_labels",
    views("fx_spacing", "fx_rivals").replace("WITH ", "WITH RECURSIVE ", 1)
    + _PRUNED.rstrip()
    + """,
cells AS MATERIALIZED (SELECT s.* FROM fx_scores s JOIN final f USING (object_id) WHERE list_contains(f.kept, s.part_idx))"""
    + sql_fill_rounds("cells", 32, 7.0, 0.3)
    + f"""SELECT object_id, point_idx, c.visible_count, best_part, {q6('max_score')} AS max_score, filled, c.visible_count <= 0 AS invisible,
  max_score < 0.3 AS low_confidence, c.visible_count <= 0 OR max_score < 0.3 AS unknown, u.point_idx IS NOT NULL AS initial_unknown,
  max_score - coalesce(second_score, 0) < 0.05 AS ambiguous, coalesce(filled_parts, '') AS filled_parts
FROM (SELECT object_id, point_idx, max(s) AS max_score, arg_max(part_idx, [s, -part_idx]) AS best_part, bool_or(filled > 0) AS filled,
    list_sort(list(s), 'DESC')[2] AS second_score, string_agg(part_idx, ',' ORDER BY part_idx) FILTER (filled > 0) AS filled_parts
  FROM st WHERE turn = 32 GROUP BY ALL) b
JOIN (SELECT object_id, point_idx, max(visible_count) AS visible_count FROM cells GROUP BY ALL) c USING (object_id, point_idx)
LEFT JOIN unsure u USING (object_id, point_idx)""",
)
def fused_labels(spark, d):
    lifted = Lifted(spark, d)
    fused = fusion.fuse_labels(lifted.scores(), lifted.points()).drop("second_score")
    return fused.withColumns({"max_score": r6("max_score"), "filled_parts": F.array_join("filled_parts", ",")})


@query(
    "membership_summary",
    views("fx_best")
    + """SELECT object_id, p.part_names, p.num_parts, p.num_points, num_unknown FROM (
  SELECT object_id, string_agg(DISTINCT part_name, ',' ORDER BY part_name) AS part_names, count(DISTINCT part_idx) AS num_parts,
    count(DISTINCT point_idx) AS num_points FROM fx_scores GROUP BY object_id) p JOIN (
  SELECT object_id, count(*) FILTER (max_score < 0.3) AS num_unknown FROM fx_best GROUP BY object_id) USING (object_id)""",
)
def membership_summary(spark, d):
    """Labels taken over from elsewhere: unseen points come without a visible count, which reads as 1."""
    taken = Lifted(spark, d).scores().withColumn("visible_count", F.nullif("visible_count", F.lit(0).cast("bigint")))
    return fusion.membership_summary(taken)
