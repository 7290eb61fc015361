"""Segmentation targets and the choice among detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from partloom.config import DetectionConfig
from partloom.functions import names
from partloom.operators.ordered import id_chunk, running_sums
from partloom.operators.prompts import keep_first


def segmentation_targets(views: DataFrame, parts: DataFrame) -> DataFrame:
    """Every view of an object with every part of it; `target_pos` orders views first, then parts."""
    prompt = names.part_prompt_or_default(F.col("prompt"), F.col("object_name"), F.col("part_name"))
    return views.join(parts, "object_id").select(
        "object_id", "view_id", "view_pos", "part_name", "part_pos",
        prompt.alias("prompt"),
        F.concat(F.lit("render/"), "view_id", F.lit(".png")).alias("image_path"),
        F.concat(F.lit("seg2d/"), "view_id", F.lit("/"), "part_name", F.lit("_mask.png")).alias("mask_path"),
    )


def best_detection(detections: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Highest score per target, the first index on ties; its box only if the score is accepted."""
    best = F.max_by(F.struct("score", "seq", "box_x0"), F.struct("score", -F.col("seq")))
    chosen = detections.groupBy("object_id", "part_name").agg(best.alias("_b"))
    accepted = F.col("_b.score") >= cfg.low_confidence_threshold
    return chosen.select(
        "object_id", "part_name", F.col("_b.score").alias("score"), F.col("_b.seq").alias("seq"),
        accepted.alias("has_mask"), F.when(accepted, F.col("_b.box_x0")).alias("box_x0"),
    )


def part_order(targets: DataFrame) -> DataFrame:
    """Parts of an object in the order of their first target. Parts of one object are few."""
    from pyspark.sql import Window

    first = targets.groupBy("object_id", "part_name").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("num_targets"))
    return first.withColumn("part_pos", F.row_number().over(Window.partitionBy("object_id").orderBy("first_seq")) - 1)


def mask_selection(detections: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Selected masks: per part the first successes, for the first parts that have any.

    Tries of a part end with its last allowed success, and parts after the last allowed part are never
    tried, so neither yields rows.
    """
    tried = running_sums(
        detections,
        ["object_id", "part_name"],
        ["seq"],
        id_chunk("seq"),
        {"_before": F.col("has_mask").cast("bigint")},
        needed=lambda start: start("_before") < cfg.max_masks_per_part,
    )
    masks = tried.filter(F.col("has_mask") & (F.col("_before") < cfg.max_masks_per_part))
    successful = part_order(detections).join(
        masks.select("object_id", "part_name").distinct(), ["object_id", "part_name"], "left_semi"
    )
    chosen = keep_first(successful, ["object_id"], "part_pos", cfg.max_selected_parts).select(
        "object_id", "part_name", (F.col("_place") - 1).alias("selected_pos")
    )
    return masks.join(chosen, ["object_id", "part_name"]).withColumn("mask_pos", F.col("_before")).drop("_before")


def view_shape_check(masks: DataFrame) -> DataFrame:
    """Reference shape per view that has a mask, and whether all its masks agree; views without masks drop out."""
    shapes = masks.filter("has_mask").groupBy("object_id", "view_id").agg(
        F.min_by(F.struct("height", "width"), "seq").alias("_ref"),
        F.min("height").alias("_h0"), F.max("height").alias("_h1"), F.min("width").alias("_w0"), F.max("width").alias("_w1"),
        F.count(F.lit(1)).alias("num_masks"),
    )
    agree = (F.col("_h0") == F.col("_h1")) & (F.col("_w0") == F.col("_w1"))
    return shapes.select(
        "object_id", "view_id", F.col("_ref.height").alias("height"), F.col("_ref.width").alias("width"), "num_masks",
        (~agree).alias("shape_mismatch"),
    )
