"""Pixel tables: gradients, mask geometry, rule filters, box means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.config import GeometryConfig, RuleFilterConfig
from partloom.functions.numeric import half_even
from partloom.operators.skew import split_join


def masked_pixels(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixel value under the mask, 0 elsewhere. `mask` holds the positive pixels only."""
    marked = mask.select("object_id", "y", "x", F.lit(True).alias("_on"))
    joined = pixels.join(marked, ["object_id", "y", "x"], "left")
    return joined.withColumn("v", F.when(F.col("_on"), F.col("v")).otherwise(F.lit(0.0))).drop("_on")


TILE = 64
TILED = ["object_id", "_ty", "_tx"]


def _tile(column: str, tile: int) -> Column:
    return F.floor(F.col(column) / tile).cast("bigint")


def _tiled_gradient(pixels: DataFrame, tile: int, mask: DataFrame | None = None) -> DataFrame:
    """Gradient per pixel, and whether it is in the mask (`_on`).

    A tile gets the pixels along its four sides twice and the mask pixels inside it, so the shuffle is a little more
    than the two tables; what follows runs inside the tile.
    """

    def beyond(column: str, rest: int, dy: int, dx: int) -> Column:
        return F.when(F.pmod(F.col(column).cast("bigint"), F.lit(tile)) == rest, F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")))

    inside = F.struct(F.lit(0).alias("dy"), F.lit(0).alias("dx"))
    homes = F.array(inside, beyond("y", 0, -1, 0), beyond("y", tile - 1, 1, 0), beyond("x", 0, 0, -1), beyond("x", tile - 1, 0, 1))
    off = F.lit(False)
    dealt = pixels.select("object_id", "y", "x", "v", F.explode(F.filter(homes, lambda h: h.isNotNull())).alias("_h")).select(
        "object_id", (_tile("y", tile) + F.col("_h.dy")).alias("_ty"), (_tile("x", tile) + F.col("_h.dx")).alias("_tx"), "y", "x", "v",
        ((F.col("_h.dy") == 0) & (F.col("_h.dx") == 0)).alias("_own"), off.alias("_on"),
    )
    if mask is not None:
        no_value = F.lit(None).cast(pixels.schema["v"].dataType)
        marked = mask.select(
            "object_id", _tile("y", tile).alias("_ty"), _tile("x", tile).alias("_tx"), F.col("y").cast(pixels.schema["y"].dataType).alias("y"),
            F.col("x").cast(pixels.schema["x"].dataType).alias("x"), no_value.alias("v"), off.alias("_own"), F.lit(True).alias("_on"),
        )
        dealt = dealt.unionByName(marked)
    cells = (
        dealt.repartition(*TILED)
        .groupBy(*TILED, "y", "x")
        .agg(F.max("v").alias("v"), F.bool_or("_own").alias("_own"), F.bool_or("_on").alias("_on"))
        .filter(F.col("v").isNotNull())
    )

    def beside(axis: str, other: str, step: int) -> Column:
        line = Window.partitionBy(*TILED, other).orderBy(axis)
        near = F.lag if step < 0 else F.lead
        return F.when(near(axis).over(line) == F.col(axis) + step, near("v").over(line))

    stencil = cells.withColumns({"_left": beside("x", "y", -1), "_right": beside("x", "y", 1)}).withColumns(
        {"_up": beside("y", "x", -1), "_down": beside("y", "x", 1)}
    )

    def slope(before: str, after: str) -> Column:
        low, high = F.coalesce(before, "v"), F.coalesce(after, "v")
        both = F.col(before).isNotNull() & F.col(after).isNotNull()
        return (high - low) / F.when(both, F.lit(2.0)).otherwise(F.lit(1.0))

    return stencil.filter("_own").select("object_id", "y", "x", "v", slope("_up", "_down").alias("gy"), slope("_left", "_right").alias("gx"), "_on")


def image_gradient(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Central differences inside, one-sided at the edges, along both axes.

    Images are cut into tiles, so one of any size spreads over tasks and small ones stay whole.
    """
    return _tiled_gradient(pixels, tile).drop("_on")


def masked_clarity(pixels: DataFrame, mask: DataFrame, tile: int = TILE) -> DataFrame:
    """Mean gradient size over mask pixels and their number; 0 for an object without any."""
    size = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    return _tiled_gradient(pixels, tile, mask).groupBy("object_id").agg(
        F.coalesce(F.avg(F.when(F.col("_on"), size)), F.lit(0.0)).alias("clarity_score"), F.count_if(F.col("_on")).alias("mask_pixels")
    )


def mask_geometry(frames: DataFrame, mask: DataFrame, cfg: GeometryConfig = GeometryConfig()) -> DataFrame:
    """Size, extent, aspect and touched borders of each mask.

    `frames` has one row per object (`image_width`, `image_height`); `mask` the positive pixels. The margin
    is known before the join, so one pre-aggregated pass over the pixels is enough.
    """
    margin = F.greatest(
        half_even(F.least("image_height", "image_width") * cfg.border_margin_ratio).cast("bigint"),
        F.lit(cfg.border_margin_min_px).cast("bigint"),
    )
    sized = frames.withColumn("border_margin_px", margin)
    touched = {
        "touches_top": F.col("y") < F.col("border_margin_px"),
        "touches_bottom": F.col("y") >= F.col("image_height") - F.col("border_margin_px"),
        "touches_left": F.col("x") < F.col("border_margin_px"),
        "touches_right": F.col("x") >= F.col("image_width") - F.col("border_margin_px"),
    }
    extents = (
        split_join(
            mask, sized.select("object_id", "image_width", "image_height", "border_margin_px"), ["object_id"], ["y", "x"]
        )
        .groupBy("object_id")
        .agg(
            F.count(F.lit(1)).alias("mask_pixels"),
            (F.max("x") - F.min("x") + 1).alias("bbox_width"),
            (F.max("y") - F.min("y") + 1).alias("bbox_height"),
            *[F.bool_or(e).alias(n) for n, e in touched.items()],
        )
    )
    zero = F.lit(0).cast("bigint")
    joined = sized.join(extents, "object_id", "left")
    width, height = F.coalesce("bbox_width", zero), F.coalesce("bbox_height", zero)
    area = F.greatest(F.col("image_height") * F.col("image_width"), F.lit(1))
    aspect = F.greatest(
        width / F.greatest(height, F.lit(1)), height / F.greatest(width, F.lit(1))
    )
    flags = {n: F.coalesce(n, F.lit(False)) for n in touched}
    return joined.select(
        *frames.columns,
        "border_margin_px",
        F.coalesce("mask_pixels", zero).alias("mask_pixels"),
        (F.coalesce("mask_pixels", zero) / area).alias("mask_area_ratio"),
        width.alias("bbox_width"),
        height.alias("bbox_height"),
        F.when((width > 0) & (height > 0), aspect).otherwise(F.lit(float("inf"))).alias("aspect_ratio"),
        *[e.alias(n) for n, e in flags.items()],
        sum((e.cast("int") for e in flags.values()), F.lit(0)).alias("border_touch_count"),
    )


def _reasons(*cases: Column) -> Column:
    return F.filter(F.array(*cases), lambda r: r.isNotNull())


def geometry_filter(geometry: DataFrame, cfg: GeometryConfig = GeometryConfig()) -> DataFrame:
    reasons = _reasons(
        F.when(F.col("mask_area_ratio") < cfg.min_mask_area_ratio, F.lit("mask_too_small")),
        F.when(F.col("aspect_ratio") > cfg.max_mask_aspect_ratio, F.lit("mask_aspect_too_large")),
        F.when(F.col("border_touch_count") > cfg.max_border_touch_count, F.lit("touches_too_many_borders")),
    )
    return geometry.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def bbox_touches_border(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return (x <= 0) | (y <= 0) | (x + w >= width) | (y + h >= height)


def rule_filter(instances: DataFrame, cfg: RuleFilterConfig) -> DataFrame:
    """Five ordered reason codes; needs `area`, the box, the frame, `clarity_score` and `mask_pixels`."""
    wanted = sorted({name.lower() for name in cfg.interactive_categories})
    touches = bbox_touches_border(*[F.col(c) for c in ("x", "y", "w", "h", "image_width", "image_height")])
    known = F.lower("category_name").isin(wanted) if wanted else F.lit(False)
    reasons = _reasons(
        F.when(~known, F.lit("non_interactive_category")),
        F.when(F.col("area") < cfg.min_area, F.lit("small_area")),
        F.when(F.lit(cfg.reject_border_touch) & F.col("touches_border"), F.lit("touches_border")),
        F.when(F.col("mask_pixels") < cfg.min_mask_pixels, F.lit("small_mask_pixels")),
        F.when(F.col("clarity_score") < cfg.min_clarity_score, F.lit("low_clarity")),
    )
    flagged = instances.withColumn("touches_border", touches).withColumn("reasons", reasons)
    return flagged.withColumn("passed", F.size("reasons") == 0)


def candidate_results(results: DataFrame) -> DataFrame:
    meta = F.concat("object_id", F.lit("/candidate/candidate_meta.json"))
    return results.select("object_id", "category_name", "passed", "reasons", meta.alias("candidate_meta_path"))


def candidate_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("num_records"), F.count_if("passed").alias("num_passed")
    )


def review_list(results: DataFrame) -> DataFrame:
    """What a reviewer sees of each candidate: decision, reasons and the paths of its files."""

    def path(tail: str) -> Column:
        return F.concat("object_id", F.lit(tail))

    return results.select(
        "object_id",
        "category_name",
        "passed",
        "short_reason",
        "reasons",
        path("/candidate/masked_instance.png").alias("masked_view_path"),
        path("/source/image.png").alias("source_image_path"),
        path("/source/instance_mask.png").alias("source_mask_path"),
        path("/candidate/candidate_meta.json").alias("candidate_meta_path"),
    )


def summed_area(pixels: DataFrame, tile: int = 256) -> DataFrame:
    """`total` of `v` over all pixels above and to the left, the pixel itself included.

    Running sums go along each row, then along each column, in tiles, so no task holds a whole image.
    """
    from partloom.operators.ordered import id_chunk, running_sums

    across = running_sums(
        pixels, ["object_id", "y"], ["x"], id_chunk("x", tile), {"_across": F.col("v")}, inclusive=True
    )
    return running_sums(
        across, ["object_id", "x"], ["y"], id_chunk("y", tile), {"total": F.col("_across")}, inclusive=True
    ).drop("_across")


def box_mean(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Mean of `v` in inclusive boxes (`object_id, box_id, x0, y0, x1, y1`) from four corners each."""
    corners = F.array(
        F.struct(F.lit(1).alias("sign"), F.col("y1").alias("y"), F.col("x1").alias("x")),
        F.struct(F.lit(-1).alias("sign"), (F.col("y0") - 1).alias("y"), F.col("x1").alias("x")),
        F.struct(F.lit(-1).alias("sign"), F.col("y1").alias("y"), (F.col("x0") - 1).alias("x")),
        F.struct(F.lit(1).alias("sign"), (F.col("y0") - 1).alias("y"), (F.col("x0") - 1).alias("x")),
    )
    asked = boxes.withColumn("c", F.explode(corners)).select(
        *boxes.columns, F.col("c.sign").alias("sign"), F.col("c.y").alias("y"), F.col("c.x").alias("x")
    )
    table = summed_area(pixels).select("object_id", "y", "x", "total")
    # Corners before the first row or column find nothing and count as 0.
    area = F.greatest((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1), F.lit(1))
    return (
        asked.join(table, ["object_id", "y", "x"], "left")
        .groupBy(*boxes.columns)
        .agg(F.sum(F.col("sign") * F.coalesce("total", F.lit(0))).alias("box_sum"))
        .withColumn("box_mean", F.col("box_sum") / area)
    )
