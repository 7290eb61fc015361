"""Packages, completeness, resume, quality reports and dataset statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from partloom.config import PackagingConfig
from partloom.functions import names


def object_manifest(objects: DataFrame, num_render_views: int = 6, num_visibility_views: int = 3) -> DataFrame:
    """Artifact paths of each object as (`object_id`, `artifact`, `path`) rows."""
    # Where the artifacts of an object live.
    fixed = {
        "source.image": "source/image.png",
        "source.instance_mask": "source/instance_mask.png",
        "source.meta": "source/source_meta.json",
        "candidate.meta": "candidate/candidate_meta.json",
        "recon3d.gaussian": "recon3d/splat.ply",
        "recon3d.meta": "recon3d/recon_meta.json",
        "recon3d.camera_params": "recon3d/lifting_camera_params.json",
        "render.cameras": "render/cameras.json",
        "prompt.parts": "prompt/part_prompts.json",
        "seg2d.meta": "seg2d/seg_meta.json",
        "project3d.votes": "project3d/part_votes.json",
        "project3d.scores": "project3d/gaussian_part_scores.npz",
        "label3d.part_membership_scores": "label3d/part_membership_scores.npz",
        "label3d.unknown_mask": "label3d/unknown_mask.npz",
        "package.object_manifest": "package/object_manifest.json",
        "package.part_instances": "package/part_instances.json",
        "instruction.part_instructions": "instruction/part_instructions.json",
    }

    def entry(name: Column, path: Column) -> Column:
        return F.struct(name.alias("artifact"), path.alias("path"))

    def per_view(count: int, name: str, before: str, after: str) -> Column:
        return F.transform(
            names.view_names(count),
            lambda v: entry(F.concat(F.lit(name), v), F.concat(F.lit(before), v, F.lit(after))),
        )

    entries = F.concat(
        F.array(*[entry(F.lit(k), F.lit(v)) for k, v in fixed.items()]),
        per_view(num_render_views, "render.image.", "render/", ".png"),
        per_view(num_render_views, "render.seg_dir.", "seg2d/", ""),
        per_view(num_visibility_views, "project3d.visibility.", "project3d/visibility/", "_visibility.png"),
    )
    return objects.select("object_id", F.explode(entries).alias("_e")).select("object_id", "_e.*")


def packaged_parts(prompts: DataFrame, scored: DataFrame) -> DataFrame:
    """Prompted parts that have a score row, with their packaged id."""
    kept = prompts.join(scored.select("object_id", "part_name").distinct(), ["object_id", "part_name"], "left_semi")
    return kept.withColumn(
        "part_sample_id", names.part_sample_id(F.col("category_name"), F.col("object_id"), F.col("part_name"))
    )


def valid_objects(objects: DataFrame, files: DataFrame, instances: DataFrame) -> DataFrame:
    """Objects with a visualisation and at least one part instance."""
    drawn = files.filter(F.col("kind") == "visualization").select("object_id").distinct()
    parts = instances.filter(F.col("part_name").isNotNull()).select("object_id").distinct()
    return objects.join(drawn, "object_id", "left_semi").join(parts, "object_id", "left_semi")


def completeness(artifacts: DataFrame, meta: DataFrame, current_config: Column, cfg: PackagingConfig = PackagingConfig()) -> DataFrame:
    """Whether an object may be skipped: all required artifacts, a completed run, and the same settings.

    `artifacts` has (`object_id`, `kind`); `meta` has `status`, `config` and `num_prompt_parts` per object. The
    visualisation is asked for only when the object has parts.
    """

    def has(kind: str) -> Column:
        return F.bool_or(F.col("kind") == kind).alias(f"has_{kind}")

    kinds = ("part_instances", "membership", "unknown_mask", "colored_points", "visualization")
    present = artifacts.groupBy("object_id").agg(*[has(k) for k in kinds])
    joined = present.join(meta, "object_id", "left")
    matches = F.coalesce(F.col("status") == "completed", F.lit(False)) & F.col("config").eqNullSafe(current_config)
    done = F.col("has_part_instances") & F.col("has_membership") & F.col("has_unknown_mask") & matches
    if cfg.colored_points_enabled:
        done = done & F.col("has_colored_points")
    if cfg.visualization_enabled:
        done = done & ((F.coalesce("num_prompt_parts", F.lit(0)) == 0) | F.col("has_visualization"))
    return joined.select("object_id", matches.alias("config_matches"), done.alias("is_complete"))


def missing_inputs(objects: DataFrame, files: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per object and required kind that has no file."""
    wanted = objects.select("object_id", F.explode(F.array(*[F.lit(k) for k in required])).alias("kind"))
    return wanted.join(files.select("object_id", "kind").distinct(), ["object_id", "kind"], "left_anti")


def resume_pending(requested: DataFrame, progress: DataFrame, keys: Sequence[str], *, overwrite: bool = False) -> DataFrame:
    """Requested rows that are not yet completed; all of them when overwriting."""
    if overwrite:
        return requested
    finished = progress.filter(F.col("status") == "completed").select(*keys).distinct()
    return requested.join(finished, list(keys), "left_anti")


def run_status(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current state of an append-only status log: the last version wins."""
    rest = [c for c in log.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col("version"))
    return log.groupBy(*keys).agg(last.alias("_s")).select(*keys, *[f"_s.{c}" for c in rest])


def qc_report(samples: DataFrame, views: DataFrame, visibility: DataFrame, targets: DataFrame, unknown: DataFrame) -> DataFrame:
    """Counts per object. Each input is reduced to one row per object before the joins.

    `samples` (`object_id, part_pos, part_name`), `views` (`object_id, path`), `visibility` (`object_id, path`),
    `targets` (`object_id, has_mask`), `unknown` (`object_id, unknown`).
    """
    listed = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("part_pos", "part_name"))), lambda p: p["part_name"]), ","
    )
    parts = samples.groupBy("object_id").agg(F.count(F.lit(1)).alias("num_part_samples"), listed.alias("part_names"))
    rendered = views.groupBy("object_id").agg(F.count(F.lit(1)).alias("num_render_views"))
    drawn = visibility.select("object_id", "path").distinct().groupBy("object_id").agg(F.count(F.lit(1)).alias("num_visibility_files"))
    masks = targets.groupBy("object_id").agg(
        F.count(F.lit(1)).alias("num_segmentation_targets"), F.count_if("has_mask").alias("num_segmentation_masks")
    )
    unseen = unknown.groupBy("object_id").agg(F.count_if("unknown").alias("num_unknown"))
    report = parts
    for other in (rendered, drawn, masks, unseen):
        report = report.join(other, "object_id", "left")
    counts = [c for c in report.columns if c.startswith("num_")]
    return report.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def stage_counters(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Completed, skipped and failed units; `skipped_no_parts` counts as completed."""
    failed = F.col("error").isNotNull()
    skipped = ~failed & (F.col("status") == "skipped")
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_requested"),
        F.count_if(~failed & ~skipped).alias("num_completed"),
        F.count_if(skipped).alias("num_skipped"),
        F.count_if(failed).alias("num_failed"),
    )


def split_failures(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Completed rows and (`object_id`, `error`) rows of one result table."""
    good = results.filter(F.col("error").isNull()).drop("error")
    return good, results.filter(F.col("error").isNotNull()).select("object_id", "error")


def dataset_stats(samples: DataFrame) -> DataFrame:
    """Objects, parts, instructions, categories and part types of a packaged dataset."""

    def kinds(column: str) -> Column:
        """One distinct count on its own: together they would multiply the rows before the shuffle."""
        return samples.select(column).distinct().agg(F.count(column)).scalar()

    return samples.agg(F.sum("num_instructions").alias("instructions")).select(
        kinds("object_id").alias("objects"),
        kinds("part_sample_id").alias("parts"),
        "instructions",
        kinds("category_name").alias("categories"),
        kinds("part_name").alias("part_types"),
    )


def dataset_index(completed: DataFrame, samples: DataFrame) -> DataFrame:
    """Part samples of completed objects, next to the paths of their object; the index stays a table."""
    paths = completed.select(
        "object_id",
        F.concat(F.lit("objects/"), "object_id").alias("object_dir"),
        F.concat(F.lit("objects/"), "object_id", F.lit("/package/part_instances.json")).alias("part_instances_path"),
    )
    return samples.join(paths, "object_id")


def build_summary(requested: DataFrame, failed: DataFrame, samples: DataFrame) -> DataFrame:
    lost = failed.agg(F.count(F.lit(1)).alias("n"))
    parts = samples.agg(F.count(F.lit(1)).alias("n"))
    whole = requested.agg(F.count(F.lit(1)).alias("num_requested")).withColumns(
        {"num_failed": lost.scalar(), "num_part_samples": parts.scalar()}
    )
    return whole.withColumn("num_completed", F.col("num_requested") - F.col("num_failed"))


def benchmark_subset(requested: DataFrame, failed: DataFrame, samples: DataFrame) -> DataFrame:
    """Completed objects (requested and not failed) with at least one part."""
    done = requested.select("object_id").distinct().join(failed.select("object_id"), "object_id", "left_anti")
    return done.join(samples.select("object_id"), "object_id", "left_semi")


def first_nonempty_source(candidates: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Distinct values of the first source, by `priority`, that has any."""
    distinct = candidates.select(*group, "priority", value).distinct()
    if not group:
        return distinct.filter(F.col("priority") == candidates.agg(F.min("priority").alias("p")).scalar())
    best = candidates.groupBy(*group).agg(F.min("priority").alias("priority"))
    return distinct.join(best, [*group, "priority"], "left_semi")
