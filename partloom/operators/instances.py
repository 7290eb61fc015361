"""Annotation tables to instance rows: joins, category filter, ids, groups, slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.functions import names
from partloom.operators.ordered import global_row_number


def join_instances(annotations: DataFrame, categories: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations with their category and image; orphans of either side are dropped.

    Categories are few, so Spark broadcasts them once it has seen their size; images join by key.
    """
    named = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    framed = images.select(
        F.col("id").alias("image_id"),
        F.col("width").alias("image_width"),
        F.col("height").alias("image_height"),
        "coco_url",
    )
    return annotations.join(named, "category_id").join(framed, "image_id")


def allowed_categories(instances: DataFrame, allowed: Sequence[str] | DataFrame | None) -> DataFrame:
    """Case-insensitive allow list; an empty list allows everything. A table of names may be any size."""
    if isinstance(allowed, DataFrame):
        listed = allowed.select(F.lower(F.col(allowed.columns[0])).alias("_allowed")).distinct()
        return instances.join(listed, F.lower("category_name") == F.col("_allowed"), "left_semi")
    wanted = sorted({name.lower() for name in allowed or ()})
    return instances.filter(F.lower("category_name").isin(wanted)) if wanted else instances


def dense_object_ids(instances: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """`object_%06d` ids in scan order, counted after filtering."""
    numbered = global_row_number(instances, order, "_position")
    return numbered.withColumn("object_id", names.object_id(F.col("_position") - 1)).drop("_position")


def stable_object_ids(instances: DataFrame) -> DataFrame:
    return instances.withColumn("object_id", names.stable_object_id(F.col("annotation_id")))


def choose_object_ids(instances: DataFrame, progress: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Stable ids if any earlier record (column `object_id`) carries one, else ids by position."""
    stable = progress.filter(names.is_stable_object_id(F.col("object_id"))).limit(1).count() > 0
    return stable_object_ids(instances) if stable else dense_object_ids(instances, order)


def record_limit(instances: DataFrame, order: Sequence[str | Column], limit: int) -> DataFrame:
    return instances.orderBy(*order).limit(limit)


def source_meta(instances: DataFrame, split_name: str) -> DataFrame:
    """Per-object source record with its polygon summary and planned file paths.

    `segmentation` is as scanned: a run-length record or an absent one counts no polygons, and a first polygon that
    is no list has no points.
    """
    count, first_polygon_len = F.coalesce("segmentation.num_polygons", F.lit(0)), F.col("segmentation.first_polygon_len")
    return instances.select(
        "object_id",
        F.lit(split_name).alias("split_name"),
        "annotation_id",
        "image_id",
        "category_id",
        "category_name",
        F.col("image_path").alias("original_image_path"),
        F.struct(F.col("image_width").alias("width"), F.col("image_height").alias("height")).alias("image_size"),
        F.array("x", "y", "w", "h").alias("bbox_xywh"),
        "area",
        F.struct(
            count.cast("bigint").alias("num_polygons"),
            F.when(count > 0, F.floor(F.coalesce(first_polygon_len, F.lit(0)) / 2))
            .otherwise(F.lit(0))
            .cast("bigint")
            .alias("first_polygon_points"),
        ).alias("segmentation_summary"),
        F.struct(
            F.lit("source/image.png").alias("image"),
            F.lit("source/instance_mask.png").alias("instance_mask"),
            F.lit("source/source_meta.json").alias("meta"),
        ).alias("planned_source_paths"),
    )


def object_index(instances: DataFrame) -> DataFrame:
    """One index row per object, as exported next to the source files."""
    return instances.select(
        "object_id",
        "category_name",
        "annotation_id",
        "image_id",
        F.col("object_id").alias("object_dir"),
        F.concat("object_id", F.lit("/source/source_meta.json")).alias("source_meta_path"),
        F.col("image_path").alias("original_image_path"),
    )


def index_header(index: DataFrame, split_name: str) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("num_records")).withColumn("split_name", F.lit(split_name))


IMAGE_ROWS = 250_000


def category_groups(instances: DataFrame, order: str, rows: int | None = None) -> DataFrame:
    """One row per category: objects, distinct images, and its place by first appearance.

    Distinct images are told apart in memory. With `rows`, about how many instances there are, no task holds many more
    than `IMAGE_ROWS` of them, however few partitions a shuffle has; by itself its share grows with the input.
    """
    if rows is not None and rows > IMAGE_ROWS:
        instances = instances.select("category_name", "image_id", order).repartition(-(-rows // IMAGE_ROWS), "image_id")
    grouped = instances.groupBy("category_name").agg(
        F.count(F.lit(1)).alias("num_available_objects"),
        F.count_distinct("image_id").alias("num_available_images"),
        F.min(order).alias("first_seen"),
    )
    # Categories are a small table (hundreds), so one window over them is fine.
    place = Window.orderBy("first_seen")
    return grouped.withColumn("category_pos", (F.row_number().over(place) - 1).cast("bigint"))


def category_slice(groups: DataFrame, start: int, limit: int | None) -> DataFrame:
    if start < 0:
        raise ValueError("start_index must be non-negative")
    if limit is not None and limit < 0:
        raise ValueError("limit must be non-negative")
    kept = groups.filter(F.col("category_pos") >= start)
    return kept if limit is None else kept.filter(F.col("category_pos") < start + limit)
