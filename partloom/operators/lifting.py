"""From points and view masks to part scores per point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from partloom.config import LiftConfig
from partloom.functions.numeric import half_even, sigmoid
from partloom.operators.skew import split_join

AXES = ("x", "y", "z")


def activate_geometry(points: DataFrame) -> DataFrame:
    """Scales from their logarithms, opacity from its logit; absent columns read as 0 and 1."""
    present = set(points.columns)
    scales = [c for c in ("scale_0", "scale_1", "scale_2") if c in present]
    values = {
        f"s{i}": F.exp(c) if (c := f"scale_{i}") in scales else F.lit(0.0) for i in range(3)
    }
    opacity = sigmoid(F.col("opacity")) if "opacity" in present else F.lit(1.0)
    kept = points.drop(*scales, "opacity")
    return points.withColumns({**values, "_o": opacity}).select(*kept.columns, "s0", "s1", "s2", F.col("_o").alias("opacity"))


def normalize_points(active: DataFrame) -> DataFrame:
    """Points and scales in the unit box of the object's visible points.

    The box takes points with opacity above 0.9, else above 0, else all of them: three sets of bounds from
    one pass, the first that has any point wins.
    """
    tiers = (F.col("opacity") > 0.9, F.col("opacity") > 0.0, F.lit(True))
    bounds = []
    for i, tier in enumerate(tiers):
        bounds.append(F.count_if(tier).alias(f"_n{i}"))
        for a in AXES:
            bounds.append(F.min(F.when(tier, F.col(a))).alias(f"_lo_{a}{i}"))
            bounds.append(F.max(F.when(tier, F.col(a))).alias(f"_hi_{a}{i}"))

    def pick(name: str) -> Column:
        return (
            F.when(F.col("_n0") > 0, F.col(f"{name}0")).when(F.col("_n1") > 0, F.col(f"{name}1")).otherwise(F.col(f"{name}2"))
        )

    box = active.groupBy("object_id").agg(*bounds)
    box = box.select("object_id", *[pick(f"_{e}_{a}").alias(f"_{e}_{a}") for e in ("lo", "hi") for a in AXES])
    extent = F.greatest(*[F.col(f"_hi_{a}") - F.col(f"_lo_{a}") for a in AXES], F.lit(1e-6))
    sized = split_join(active, box.withColumn("side", extent), ["object_id"], ["point_idx"])
    side = F.col("side")
    moved = {a: F.col(a) / side - (F.col(f"_lo_{a}") / side + F.col(f"_hi_{a}") / side) * 0.5 for a in AXES}
    scaled = {f"s{i}": F.col(f"s{i}") / side for i in range(3)}
    return sized.withColumns({**moved, **scaled}).drop(*[f"_{e}_{a}" for e in ("lo", "hi") for a in AXES])


def project_points(points: DataFrame, cameras: DataFrame, width: int, height: int) -> DataFrame:
    """`u`, `v`, `depth` of every point in every view of its object; `u` and `v` are null unless depth > 1e-6."""
    paired = split_join(points, cameras, ["object_id"], ["point_idx"])

    def along(axis: str) -> Column:
        x, y, z = (F.col(a) for a in AXES)
        return F.col(f"{axis}x") * x + F.col(f"{axis}y") * y + F.col(f"{axis}z") * z

    seen = paired.withColumns(
        {
            "_cx": along("r") + F.col("tx"),
            "_cy": along("d") + F.col("ty"),
            "depth": along("f") + F.col("tz"),
        }
    )
    front = F.col("depth") > 1e-6
    safe = F.when(front, F.col("depth")).otherwise(F.lit(1.0))
    return seen.withColumns(
        {
            "u": F.when(front, (F.col("focal") * (F.col("_cx") / safe) + 0.5) * width),
            "v": F.when(front, (F.col("focal") * (F.col("_cy") / safe) + 0.5) * height),
        }
    ).drop("_cx", "_cy")


def to_pixels(projected: DataFrame, width: int, height: int) -> DataFrame:
    """Half-even pixels, clamped into the frame; points behind the camera go."""

    def pixel(value: str, size: int) -> Column:
        return F.greatest(F.least(half_even(F.col(value)), F.lit(size - 1)), F.lit(0)).cast("bigint")

    return projected.filter(F.col("u").isNotNull()).withColumns(
        {"px": pixel("u", width), "py": pixel("v", height)}
    )


def projected_radius(projected: DataFrame, width: int, height: int, cfg: LiftConfig = LiftConfig()) -> DataFrame:
    """Adds the largest scale and the footprint radius in pixels, 0 behind the camera."""
    front = F.col("depth") > 1e-6
    largest = F.greatest("s0", "s1", "s2")
    safe = F.when(front, F.col("depth")).otherwise(F.lit(1.0))
    radius = F.abs("focal") * float(max(width, height)) * F.col("max_scale") / safe * cfg.footprint_scale
    clipped = F.greatest(
        F.least(radius, F.lit(cfg.max_projected_radius_px)), F.lit(cfg.min_projected_radius_px)
    )
    return projected.withColumn("max_scale", largest).withColumn(
        "radius_px", F.when(front, clipped).otherwise(F.lit(0.0))
    )


def pixel_owners(pixels: DataFrame) -> DataFrame:
    """Nearest point per (object, view, pixel), the lowest index on equal depth: a map-side combined minimum."""
    nearest = F.min(F.struct("depth", "point_idx"))
    return (
        pixels.groupBy("object_id", "view_id", "px", "py")
        .agg(nearest.alias("_n"))
        .select("object_id", "view_id", "px", "py", F.col("_n.point_idx").alias("point_idx"), F.col("_n.depth").alias("depth"))
    )


def depth_buffer(pixels: DataFrame, grid: DataFrame) -> DataFrame:
    """Smallest depth of every pixel of `grid`, infinity where nothing projects."""
    nearest = pixels.groupBy("object_id", "view_id", "px", "py").agg(F.min("depth").alias("depth"))
    joined = grid.join(nearest, ["object_id", "view_id", "px", "py"], "left")
    return joined.withColumn("depth", F.coalesce("depth", F.lit(float("inf"))))


def five_tap_visibility(pixels: DataFrame, width: int, height: int, cfg: LiftConfig = LiftConfig()) -> DataFrame:
    """Whether a point is at most its tolerance behind the buffer at its pixel or at one of four taps.

    Needs `max_scale` and `radius_px`. A tap on an empty pixel reads infinity, so the point shows there.
    """
    step = F.greatest(F.ceil(F.col("radius_px") * 0.5), F.lit(1)).cast("bigint")
    tolerance = F.greatest(F.col("max_scale") * cfg.depth_tolerance_scale, F.lit(cfg.depth_tolerance_min))
    moves = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])

    def tap(base: str, move: str, size: int) -> Column:
        return F.greatest(F.least(F.col(base) + F.col(move) * F.col("_step"), F.lit(size - 1)), F.lit(0))

    taps = (
        pixels.select("object_id", "view_id", "point_idx", "px", "py", "depth", step.alias("_step"), tolerance.alias("_tol"))
        .withColumn("_m", F.explode(moves))
        .select(
            "object_id", "view_id", "point_idx", F.col("depth").alias("_d"), "_tol",
            tap("px", "_m.x", width).alias("px"), tap("py", "_m.y", height).alias("py"),
        )
    )
    nearest = pixels.groupBy("object_id", "view_id", "px", "py").agg(F.min("depth").alias("depth"))
    shown = F.col("depth").isNull() | (F.col("_d") <= F.col("depth") + F.col("_tol"))
    return (
        taps.join(nearest, ["object_id", "view_id", "px", "py"], "left")
        .groupBy("object_id", "view_id", "point_idx")
        .agg(F.bool_or(shown).alias("visible"))
    )


def masked_views(mask_files: DataFrame) -> DataFrame:
    """Views that have at least one mask; only they count for visibility."""
    return mask_files.select("object_id", "view_id").distinct()


def visible_counts(owners: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """Number of views in which a point owns a pixel."""
    counted = owners if views is None else owners.join(views, ["object_id", "view_id"], "left_semi")
    return (
        counted.select("object_id", "view_id", "point_idx")
        .distinct()
        .groupBy("object_id", "point_idx")
        .agg(F.count(F.lit(1)).alias("visible_count"))
    )


def part_votes(owners: DataFrame, mask_pixels: DataFrame) -> DataFrame:
    """Votes per (part, point): every mask pixel votes for the point that owns it."""
    return (
        mask_pixels.join(owners.drop("depth"), ["object_id", "view_id", "px", "py"])
        .groupBy("object_id", "part_idx", "point_idx")
        .agg(F.count(F.lit(1)).alias("positive_count"))
    )


def part_scores(points: DataFrame, parts: DataFrame, votes: DataFrame, visible: DataFrame) -> DataFrame:
    """Votes over visible views for every (part, point) pair; unseen points divide by 1.

    `parts` lists the few parts of each object, so the pairs are an equi-join on the object, hot objects cut.
    """
    pairs = split_join(points.select("object_id", "point_idx"), parts, ["object_id"], ["point_idx"])
    joined = pairs.join(votes, ["object_id", "part_idx", "point_idx"], "left").join(
        visible, ["object_id", "point_idx"], "left"
    )
    zero = F.lit(0).cast("bigint")
    counted = joined.withColumns(
        {"positive_count": F.coalesce("positive_count", zero), "visible_count": F.coalesce("visible_count", zero)}
    )
    return counted.withColumn(
        "score", F.col("positive_count") / F.when(F.col("visible_count") > 0, F.col("visible_count")).otherwise(1)
    )


def vote_summary(scores: DataFrame) -> DataFrame:
    """Totals per part and the mean score over ALL points."""
    return scores.groupBy("object_id", "part_idx", "part_name").agg(
        F.sum("positive_count").alias("positive_count_total"),
        F.sum("visible_count").alias("visible_count_total"),
        F.avg("score").alias("score_mean"),
    )


def best_part(scores: DataFrame) -> DataFrame:
    """Best part per point and its score, the first part on ties, and the second best score."""
    best = F.max(F.struct("score", (-F.col("part_idx")).alias("back")))
    top = (
        scores.groupBy("object_id", "point_idx")
        .agg(best.alias("_b"), F.max("visible_count").alias("visible_count"), F.count(F.lit(1)).alias("_parts"))
        .select(
            "object_id", "point_idx", "visible_count", "_parts",
            (-F.col("_b.back")).alias("best_part"), F.col("_b.score").alias("max_score"),
        )
    )
    return top.drop("_parts")


def ambiguity(scores: DataFrame, margin: float = 0.05) -> DataFrame:
    """Best part and score with the second best score (0 with a single part), `ambiguous` if they differ by less than `margin`.

    The parts of a point are few: its two best come from one short array, in one pass over the scores.
    """
    pair = F.struct(F.col("score").alias("score"), (-F.col("part_idx")).alias("back"))
    two = F.slice(F.sort_array(F.collect_list(pair), asc=False), 1, 2)
    top = scores.groupBy("object_id", "point_idx").agg(two.alias("_t"), F.max("visible_count").alias("visible_count"))
    best, second = F.col("_t")[0], F.try_element_at("_t", F.lit(2))
    return top.select(
        "object_id", "point_idx", "visible_count",
        (-best["back"]).alias("best_part"), best["score"].alias("max_score"), F.coalesce(second["score"], F.lit(0.0)).alias("second_score"),
    ).withColumn("ambiguous", (F.col("max_score") - F.col("second_score")) < margin)


def add_pointless_objects(points: DataFrame, best: DataFrame) -> DataFrame:
    """Points of objects without any part: best part -1, score 0."""
    joined = points.select("object_id", "point_idx").join(best, ["object_id", "point_idx"], "left")
    return joined.withColumns(
        {
            "best_part": F.coalesce("best_part", F.lit(-1).cast("bigint")),
            "max_score": F.coalesce("max_score", F.lit(0.0)),
        }
    )


def visibility_pixels(owners: DataFrame, best: DataFrame, parts: DataFrame, cfg: LiftConfig = LiftConfig()) -> DataFrame:
    """Colour of every owned pixel: part colour times score, white and faint where no part scores."""
    from partloom.functions.names import stable_part_color

    score = F.greatest(F.least(F.coalesce("max_score", F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    joined = (
        owners.join(best.select("object_id", "point_idx", "best_part", "max_score"), ["object_id", "point_idx"], "left")
        .join(
            parts.select("object_id", F.col("part_idx").alias("best_part"), stable_part_color(F.col("part_name")).alias("_rgb")),
            ["object_id", "best_part"],
            "left",
        )
        .withColumn("_score", score)
    )
    labelled = F.col("_rgb").isNotNull() & (F.col("_score") > 0)

    def channel(i: int) -> Column:
        shade = F.floor(F.get("_rgb", F.lit(i)) * F.col("_score"))
        return F.when(labelled, F.greatest(F.least(shade, F.lit(255)), F.lit(0))).otherwise(F.lit(255)).cast("bigint")

    def alpha(value: float) -> Column:
        return F.lit(min(max(round(value * 255.0), 0), 255)).cast("bigint")

    return joined.select(
        "object_id", "view_id", "px", "py",
        channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"),
        F.when(labelled, alpha(cfg.labeled_alpha)).otherwise(alpha(cfg.unlabeled_alpha)).alias("alpha"),
    )


def bilinear_sample(grid: DataFrame, coords: DataFrame, size: int) -> DataFrame:
    """Value of a `size` x `size` grid at (`u`, `v`) in [0, 1], mean over the views that see the point.

    `grid` has (`sample_id, view_id, gy, gx, channel, value`), `coords` (`sample_id, point_idx, view_id, u, v,
    visible`). Half-pixel centres; corners outside the grid count as 0.
    """
    gx, gy = F.col("u") * size - 0.5, F.col("v") * size - 0.5
    placed = coords.withColumns({"_x0": F.floor(gx), "_y0": F.floor(gy), "_ax": gx - F.floor(gx), "_ay": gy - F.floor(gy)})

    def corner(dy: int, dx: int) -> Column:
        wx = F.col("_ax") if dx else 1 - F.col("_ax")
        wy = F.col("_ay") if dy else 1 - F.col("_ay")
        return F.struct((F.col("_y0") + dy).alias("gy"), (F.col("_x0") + dx).alias("gx"), (wx * wy).alias("weight"))

    taps = (
        placed.filter("visible")
        .withColumn("_c", F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))))
        .select("sample_id", "point_idx", "view_id", "_c.*")
    )
    sampled = (
        taps.join(grid, ["sample_id", "view_id", "gy", "gx"])
        .groupBy("sample_id", "point_idx", "channel")
        .agg(F.sum(F.col("weight") * F.col("value")).alias("_sum"))
    )
    seen = coords.groupBy("sample_id", "point_idx").agg(F.count_if("visible").alias("_seen"))
    channels = grid.select("sample_id", "channel").distinct()
    return (
        seen.join(channels, "sample_id")
        .join(sampled, ["sample_id", "point_idx", "channel"], "left")
        .select(
            "sample_id", "point_idx", "channel",
            (F.coalesce("_sum", F.lit(0.0)) / F.greatest("_seen", F.lit(1))).alias("value"),
        )
    )


def source_projection(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Source-image coordinates: P = (xyz * scale) @ R(q) + t, u = cx - fx * Px / Pz, v = cy - fy * Py / Pz.

    `poses` has one row per object: quaternion `qw, qx, qy, qz`, scale `s`, translation `tx, ty, tz` and
    `fx, fy, cx, cy`.
    """
    w, x, y, z = (F.col(f"q{a}") for a in "wxyz")
    norm = 2.0 / (w * w + x * x + y * y + z * z)
    rows = (
        (1 - norm * (y * y + z * z), norm * (x * y - z * w), norm * (x * z + y * w)),
        (norm * (x * y + z * w), 1 - norm * (x * x + z * z), norm * (y * z - x * w)),
        (norm * (x * z - y * w), norm * (y * z + x * w), 1 - norm * (x * x + y * y)),
    )
    scaled = [F.col(a) * F.col("s") for a in AXES]
    camera = {
        f"c{a}": scaled[0] * rows[0][j] + scaled[1] * rows[1][j] + scaled[2] * rows[2][j] + F.col(f"t{a}")
        for j, a in enumerate(AXES)
    }
    depth = F.nullif(F.col("cz"), F.lit(0.0))
    return split_join(points, poses, ["object_id"], ["point_idx"]).withColumns(camera).withColumns(
        {
            "u": F.col("cx_px") - F.col("fx") * F.col("cx") / depth,
            "v": F.col("cy_px") - F.col("fy") * F.col("cy") / depth,
        }
    )
