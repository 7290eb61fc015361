"""Category quotas and the ordered, quota-bounded selection of candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.config import QuotaConfig
from partloom.operators.ordered import running_sums
from partloom.session import broadcast_if_small


def category_quotas(categories: DataFrame, cfg: QuotaConfig = QuotaConfig()) -> DataFrame:
    """Adds `selection_quota`: a minimum each, the rest by image counts, leftovers by largest remainder.

    `categories` needs `category_name`, `interactive_object`, `num_available_images` (and
    `selection_quota` when existing quotas are reused). It has one row per category, hundreds at most,
    so windows over all of it are fine.
    """
    if cfg.quota_min_per_category < 0:
        raise ValueError("quota_min_per_category must be non-negative")
    if cfg.quota_image_count_power < 0:
        raise ValueError("quota_image_count_power must be non-negative")
    kept = F.coalesce("interactive_object", F.lit(False))
    if cfg.reuse_existing_selection_quotas:
        missing = F.raise_error(
            F.concat(
                F.lit("reuse_existing_selection_quotas requires positive selection_quota for category "),
                F.col("category_name"),
            )
        )
        reused = F.when(F.col("selection_quota") > 0, F.col("selection_quota")).otherwise(missing)
        return categories.withColumn("selection_quota", F.when(kept, reused).otherwise(0).cast("bigint"))
    if cfg.target_num_candidates is None:
        return categories.withColumn("selection_quota", kept.cast("bigint"))

    everyone = Window.partitionBy("_kept")
    target, least = F.lit(cfg.target_num_candidates), F.lit(cfg.quota_min_per_category)
    weighed = categories.withColumns(
        {
            "_kept": kept,
            "_weight": F.pow(
                F.greatest(F.col("num_available_images"), F.lit(1)).cast("double"),
                F.lit(cfg.quota_image_count_power),
            ),
        }
    ).withColumns(
        {"_members": F.count(F.lit(1)).over(everyone), "_all": F.sum("_weight").over(everyone)}
    )
    too_small = F.raise_error(F.lit("target_num_candidates is too small for the text-pass categories"))
    rest = F.when(
        F.col("_kept") & ((target < F.col("_members")) | (least * F.col("_members") > target)), too_small
    ).otherwise(target - least * F.col("_members"))
    shared = weighed.withColumn("_rest", rest.cast("bigint")).withColumn(
        "_raw", F.col("_rest") * (F.col("_weight") / F.col("_all"))
    )
    floored = shared.withColumn("_floor", F.floor("_raw")).withColumns(
        {
            "_left": F.col("_rest") - F.sum("_floor").over(everyone),
            "_place": F.row_number().over(
                everyone.orderBy(F.desc(F.col("_raw") - F.col("_floor")), F.desc("_weight"), F.desc("category_name"))
            ),
        }
    )
    quota = least + F.col("_floor") + (F.col("_place") <= F.col("_left")).cast("bigint")
    return floored.withColumn(
        "selection_quota", F.when(F.col("_kept"), quota).otherwise(0).cast("bigint")
    ).drop("_kept", "_weight", "_members", "_all", "_rest", "_raw", "_floor", "_left", "_place")


def quota_selection(
    rows: DataFrame, quotas: DataFrame, order: Sequence[str | Column], chunk: Column, earlier: DataFrame | None = None
) -> DataFrame:
    """Attempted rows only, in the order they are tried.

    `rows` carries `category_name` and an `outcome` (`missing_image`, `geometry_reject`, `model_reject`,
    `pass`). A category stops once its quota is filled. Adds `image_attempt_index` and
    `selection_slot_index` (the slot the row competes for). `rows` is read twice: pass a stored table if it
    is costly. Quotas are broadcast after a look at their number, so rows are not shuffled by category.

    `earlier` holds `category_records` of a run that stopped, with `selected_object_ids`; `rows` then needs an
    `object_id`. A category goes on from as many slots as it has picks, if that leaves any. The walk starts at its
    first row again: picked rows come out as `already_selected`, which count as attempts and take no slot, and
    rejected rows are tried again.
    """
    open_quotas = quotas.filter(F.col("selection_quota") > 0).select("category_name", "selection_quota")
    outcome, start = F.col("outcome"), F.lit(0)
    keys, tried = ["category_name", "selection_quota"], rows
    if earlier is not None:
        picks = earlier.select("category_name", F.coalesce("selected_object_ids", F.array()).alias("_picks"))
        open_quotas = open_quotas.join(picks.select("category_name", F.size("_picks").alias("_filled")), "category_name", "left")
        open_quotas = open_quotas.withColumn("_filled", F.coalesce("_filled", F.lit(0))).filter(F.col("_filled") < F.col("selection_quota"))
        # Quotas bound the picks of a category, so their arrays are short; a category may hold any number of rows.
        picked = picks.select("category_name", F.explode("_picks").alias("object_id")).distinct().withColumn("_picked", F.lit(True))
        tried = rows.join(picked, ["category_name", "object_id"], "left").withColumn(
            "outcome", F.when(F.col("_picked"), F.lit("already_selected")).otherwise(F.col("outcome"))
        )
        tried, start, keys = tried.select(*rows.columns), F.col("_filled"), [*keys, "_filled"]
    bounded = tried.join(broadcast_if_small(open_quotas), "category_name")
    counted = running_sums(
        bounded,
        keys,
        order,
        chunk,
        {"_seen": F.lit(1), "_passed": (outcome == "pass").cast("bigint")},
        needed=lambda before: start + before("_passed") < F.col("selection_quota"),
    )
    return counted.filter(start + F.col("_passed") < F.col("selection_quota")).select(
        *rows.columns,
        "selection_quota",
        (F.col("_seen") + 1).alias("image_attempt_index"),
        (start + F.col("_passed") + 1).cast("bigint").alias("selection_slot_index"),
    )


def selection_counters(attempts: DataFrame) -> DataFrame:
    """Counters per category over attempted rows."""

    def outcome(name: str) -> Column:
        return F.count_if(F.col("outcome") == name)

    return attempts.groupBy("category_name").agg(
        F.max("selection_quota").alias("selection_quota"),
        F.count(F.lit(1)).alias("num_image_attempts"),
        outcome("missing_image").alias("num_missing_images"),
        outcome("geometry_reject").alias("num_geometry_rejects"),
        outcome("model_reject").alias("num_llm_rejects"),
        outcome("pass").alias("num_selected_objects"),
    )


def selected_ids(attempts: DataFrame) -> DataFrame:
    """`(category_name, selected_object_ids)` in order of slots; the quota of a category bounds its list."""
    slot = F.struct("selection_slot_index", "object_id")
    listed = attempts.filter(F.col("outcome") == "pass").groupBy("category_name").agg(F.sort_array(F.collect_list(slot)).alias("_s"))
    return listed.select("category_name", F.transform("_s", lambda s: s["object_id"]).alias("selected_object_ids"))


def category_records(categories: DataFrame, counters: DataFrame) -> DataFrame:
    """Every category with its decision, quota and counters; rejected categories are complete at once."""
    names = [c for c in counters.columns if c not in ("category_name", "selection_quota")]
    joined = categories.join(counters.drop("selection_quota"), "category_name", "left")
    filled = joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})
    open_slots = F.col("interactive_object") & (F.col("num_selected_objects") < F.col("selection_quota"))
    return filled.withColumn(
        "quota_state", F.when(open_slots, F.lit("text_completed")).otherwise(F.lit("completed"))
    )


REJECTS = ("num_missing_images", "num_geometry_rejects", "num_llm_rejects")


def resumable_records(categories: DataFrame, attempts: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """`category_records` with `selected_object_ids`, from which a later run can go on.

    With the records of an `earlier` run rejects add up, as rejected rows were tried again, the number of attempts is
    that of the last walk of the category, and its picks follow the earlier ones.
    """
    counters = selection_counters(attempts).join(selected_ids(attempts), "category_name", "left").withColumnRenamed("num_selected_objects", "_new")
    joined = categories.join(counters.drop("selection_quota"), "category_name", "left")
    zero, none = F.lit(0).cast("bigint"), F.expr("CAST(array() AS array<string>)")
    picks = F.coalesce("selected_object_ids", none)
    if earlier is not None:
        old = earlier.select("category_name", *[F.col(c).alias(f"_old_{c}") for c in ("selected_object_ids", "num_image_attempts", *REJECTS)])
        joined = joined.join(old, "category_name", "left")
        picks = F.concat(F.coalesce("_old_selected_object_ids", none), picks)
        sums = {c: F.coalesce(c, zero) + F.coalesce(f"_old_{c}", zero) for c in REJECTS}
        walked = F.coalesce("num_image_attempts", "_old_num_image_attempts", zero)
    else:
        sums = {c: F.coalesce(c, zero) for c in REJECTS}
        walked = F.coalesce("num_image_attempts", zero)
    merged = joined.withColumns({**sums, "num_image_attempts": walked, "selected_object_ids": picks})
    merged = merged.withColumn("num_selected_objects", F.size("selected_object_ids").cast("bigint"))
    open_slots = F.col("interactive_object") & (F.col("num_selected_objects") < F.col("selection_quota"))
    return merged.select(
        *categories.columns, "num_image_attempts", *REJECTS, "num_selected_objects", "selected_object_ids",
        F.when(open_slots, F.lit("text_completed")).otherwise(F.lit("completed")).alias("quota_state"),
    )


def stage_totals(categories: DataFrame) -> DataFrame:
    return categories.agg(
        F.count(F.lit(1)).alias("num_categories_in_batch"),
        F.count_if("interactive_object").alias("num_text_pass_categories"),
        F.sum("num_available_objects").alias("num_input_records"),
        F.sum("num_selected_objects").alias("num_selected_candidates"),
        F.count_if(F.col("quota_state") == "completed").alias("num_completed_categories"),
    )


def approval_gate(passed: DataFrame, approvals: DataFrame, max_objects: int | None = None) -> DataFrame:
    """Approved objects in approval order. `approvals` has `object_id` and its list position `pos`.

    An empty approval list is an error.
    """
    if approvals.isEmpty():
        raise ValueError("approval file contains no approved_object_ids")
    listed = approvals.select("object_id", F.col("pos").alias("approval_pos"))
    if max_objects is not None:
        listed = listed.filter(F.col("approval_pos") < max_objects)
    return passed.join(listed, "object_id")


def approval_template(candidates: DataFrame) -> DataFrame:
    return candidates.filter("passed").select("object_id")
