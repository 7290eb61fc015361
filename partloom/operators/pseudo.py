"""Manifests of real and pseudo-labelled samples, their weights, refresh and loss reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.config import PseudoConfig
from partloom.functions.numeric import bce_with_logits, clamp, floored_ratio, focal_with_logits, sigmoid
from partloom.operators.ordered import smallest_k


def split_filter(manifest: DataFrame, *, column: str, value: str) -> DataFrame:
    """Rows of one split. A missing instruction split reads as seen; other splits match as they are."""
    split = F.coalesce(column, F.lit("seen")) if column == "instruction_split" else F.col(column)
    return manifest.filter(split == value)


def mixed_union(real: DataFrame, pseudo: DataFrame) -> DataFrame:
    """Real rows and pseudo rows with a source tag; columns one side lacks are null there."""
    return real.withColumn("source", F.lit("real")).unionByName(
        pseudo.withColumn("source", F.lit("pseudo")), allowMissingColumns=True
    )


def mixed_counts(mixed: DataFrame) -> DataFrame:
    return mixed.agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.count_if(F.col("source") == "real").alias("num_real"),
        F.count_if(F.col("source") == "pseudo").alias("num_pseudo"),
    )


def pseudo_sample(rows: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Exactly max(1, int(n * ratio)) rows, the same ones for the same seed; all rows from a ratio of 1 on.

    Rows are ordered by a seeded hash. Whole hash ranges are kept or dropped by their counts, and only
    the one range that holds the cut is sorted, so no task sees more than a small share of the table.
    """
    if ratio >= 1.0:
        return rows
    hashed = rows.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    size = rows.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(ratio))).alias("_size"))
    bucket = F.conv(F.substring("_hash", 1, 4), 16, 10).cast("bigint")
    return smallest_k(hashed, [], [F.col("_hash"), F.col(key)], bucket, size.scalar()).drop("_hash")


def manifest_offsets(manifests: DataFrame) -> DataFrame:
    """Running offset of each manifest in its order. `manifests` has (`manifest_pos`, `num_rows`), one row each."""
    before = Window.orderBy("manifest_pos").rowsBetween(Window.unboundedPreceding, -1)
    return manifests.withColumn("row_offset", F.coalesce(F.sum("num_rows").over(before), F.lit(0)))


def select_heatmap(rows: DataFrame) -> DataFrame:
    """Target map of each row: by target index, else the teacher of its part, else the maximum of all teachers, else zeros.

    Arrays: `targets` and `teachers` (maps of points), `part_names`, and the number of points `n`.
    """
    named = F.array_position("part_names", F.col("part_name")).cast("int") - 1
    any_teacher = F.size("teachers") > 0
    highest = F.aggregate(
        "teachers",
        F.array_repeat(F.lit(float("-inf")), F.col("n").cast("int")),
        lambda acc, t: F.zip_with(acc, t, lambda a, b: F.greatest(a, b)),
    )
    chosen = (
        F.when(F.col("target_index") < F.size("targets"), F.get("targets", F.col("target_index").cast("int")))
        .when((named >= 0) & any_teacher, F.get("teachers", named))
        .when(any_teacher, highest)
        .otherwise(F.array_repeat(F.lit(0.0), F.col("n").cast("int")))
    )
    return rows.withColumn("heatmap", F.transform(chosen, lambda v: clamp(v)))


def pseudo_confidence(points: DataFrame, cfg: PseudoConfig = PseudoConfig()) -> DataFrame:
    """Confidence per sample and its number of ignored points. Real samples weigh 1 and ignore nothing.

    `points` has (`sample_id`, `is_pseudo`, `heatmap`).
    """
    h = F.col("heatmap")
    ignored = F.col("is_pseudo") & (h < cfg.high_threshold) & (h > cfg.low_threshold)
    certainty = F.avg(F.abs(h - 0.5) * 2.0)
    return points.groupBy("sample_id", "is_pseudo").agg(
        F.when(F.col("is_pseudo"), clamp(certainty) * cfg.pseudo_weight).otherwise(F.lit(1.0)).alias("confidence"),
        F.count_if(ignored).alias("num_ignored"),
    )


def ignore_mask(heatmap: Column, is_pseudo: Column, cfg: PseudoConfig = PseudoConfig()) -> Column:
    return is_pseudo & (heatmap < cfg.high_threshold) & (heatmap > cfg.low_threshold)


def curriculum_weight(epoch: Column, *, start: int, rampup: int, weight: float) -> Column:
    """Pseudo weight of an epoch: 0 before `start`, a linear ramp, then `weight`."""
    ramp = F.when(epoch < start, F.lit(0.0))
    if rampup > 0:
        ramp = ramp.when(epoch < start + rampup, weight * ((epoch - start) / rampup))
    return ramp.otherwise(F.lit(weight))


def curriculum_confidence(confidence: Column, is_pseudo: Column, epoch_weight: Column, weight: float) -> Column:
    """Confidence in an epoch: only pseudo samples are scaled."""
    return F.when(is_pseudo, confidence * (epoch_weight / max(weight, 1e-8))).otherwise(confidence)


def smooth_label(label: Column, is_pseudo: Column, epsilon: float) -> Column:
    return F.when(is_pseudo, label * (1 - 2 * epsilon) + epsilon).otherwise(label)


def binarize(heatmap: Column, threshold: float) -> Column:
    return (heatmap > threshold).cast("double")


def pad_batches(samples: DataFrame) -> DataFrame:
    """Zero-padded arrays per sample and the point mask. A batch is as small as its configured size.

    `samples` has (`batch_id`, `sample_id`, `heatmap`). The longest length is joined back from a grouped maximum.
    """
    longest = samples.groupBy("batch_id").agg(F.max(F.size("heatmap")).alias("padded_length"))
    missing = F.col("padded_length") - F.size("heatmap")
    return samples.join(longest, "batch_id").select(
        *[c for c in samples.columns if c != "heatmap"],
        "padded_length",
        F.concat("heatmap", F.array_repeat(F.lit(0.0), missing)).alias("heatmap"),
        F.concat(F.array_repeat(F.lit(True), F.size("heatmap")), F.array_repeat(F.lit(False), missing)).alias("point_mask"),
    )


def manifest_lookup(manifest: DataFrame, geometry: DataFrame, tokens: DataFrame) -> DataFrame:
    """Manifest rows with their geometry (by path) and token rows (by path and index)."""
    return manifest.join(geometry, "geo_cache_path").join(tokens, ["vlm_cache_path", "vlm_cache_index"])


def refresh_heatmaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old maps with refreshed values where there are any; `refreshed` tells which."""
    fresh = new.select("sample_id", "pos", F.col("heatmap").alias("_new"))
    joined = old.join(fresh, ["sample_id", "pos"], "left")
    return joined.withColumns(
        {"heatmap": F.coalesce("_new", "heatmap"), "refreshed": F.col("_new").isNotNull()}
    ).drop("_new")


def refresh_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """Refreshed samples and the mean over them of their mean absolute change."""
    both = old.join(new.select("sample_id", "pos", F.col("heatmap").alias("_new")), ["sample_id", "pos"])
    per_sample = both.groupBy("sample_id").agg(F.avg(F.abs(F.col("_new") - F.col("heatmap"))).alias("_change"))
    return per_sample.agg(
        F.count(F.lit(1)).alias("refreshed_samples"),
        F.coalesce(F.avg("_change"), F.lit(0.0)).alias("mean_heatmap_change"),
    )


def _dice(rows: DataFrame, valid: Column) -> DataFrame:
    """Dice loss: per sample, then the mean."""
    prob, label = sigmoid(F.col("logit")) * valid, clamp(F.col("label")) * valid
    per_sample = rows.groupBy("sample_id").agg(
        F.sum(prob * label).alias("_i"), (F.sum(prob) + F.sum(label)).alias("_d")
    )
    return per_sample.agg((1 - F.avg((2.0 * F.col("_i") + 1.0) / (F.col("_d") + 1.0))).alias("dice_loss"))


def _weight(label: Column, valid: Column, configured: float) -> Column:
    """Weight of positives: as configured, else negatives over positives, at least 1."""
    if configured > 0:
        return F.lit(float(configured))
    return F.greatest(floored_ratio(F.sum((1 - label) * valid), F.sum(label * valid), 1.0), F.lit(1.0))


def loss_report(
    preds: DataFrame, *, positive_threshold: float = 0.5, pos_weight: float = 0.0, lambda_bce: float = 1.0,
    lambda_focal: float = 1.0, lambda_dice: float = 1.0, alpha: float = 0.25, gamma: float = 2.0,
) -> DataFrame:
    """Supervised loss terms over (`sample_id`, `logit`, `heatmap`): binary cross entropy, focal, dice, total."""
    rows = preds.withColumn("label", binarize(clamp(F.col("heatmap")), positive_threshold))
    label, one = F.col("label"), F.lit(1.0)
    # The cross entropy is linear in the weight, so its two sums and the weight come from one pass.
    sums = rows.agg(
        _weight(label, one, pos_weight).alias("pos_weight"),
        F.sum(label * bce_with_logits(F.col("logit"), F.lit(1.0))).alias("_hit"),
        F.sum((1 - label) * bce_with_logits(F.col("logit"), F.lit(0.0))).alias("_miss"),
        F.sum(focal_with_logits(F.col("logit"), label, alpha, gamma)).alias("_focal"),
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.avg(label).alias("truth_pos"),
    )
    terms = sums.select(
        "pos_weight",
        floored_ratio(F.col("pos_weight") * F.col("_hit") + F.col("_miss"), F.col("_n"), 1.0).alias("bce_loss"),
        floored_ratio(F.col("_focal"), F.col("_n"), 1.0).alias("focal_loss"),
        "truth_pos",
    )
    joined = terms.withColumn("dice_loss", _dice(rows, one).scalar())
    total = lambda_bce * F.col("bce_loss") + lambda_focal * F.col("focal_loss") + lambda_dice * F.col("dice_loss")
    return joined.withColumn("loss", total)


def mixed_loss_report(
    preds: DataFrame, *, use_soft_labels: bool = False, positive_threshold: float = 0.5, pos_weight: float = 0.0,
    lambda_bce: float = 1.0, lambda_focal: float = 1.0, lambda_dice: float = 1.0, alpha: float = 0.25, gamma: float = 2.0,
    pseudo_bce_scale: float = 0.3, pseudo_focal_scale: float = 1.0, label_smoothing: float = 0.0,
) -> DataFrame:
    """Loss terms over real and pseudo samples with confidences.

    `preds` has (`sample_id, is_pseudo, logit, heatmap, point_mask, ignored, confidence`). A point counts with
    mask * not ignored * confidence; a side without any weight contributes 0.
    """
    clipped = clamp(F.col("heatmap"))
    raw = clipped if use_soft_labels else binarize(clipped, positive_threshold)
    label = smooth_label(raw, F.col("is_pseudo"), label_smoothing) if label_smoothing > 0 else raw
    valid = F.col("point_mask").cast("double") * (~F.col("ignored")).cast("double") * clamp(F.col("confidence"))
    rows = preds.withColumns({"label": label, "_valid": valid})
    y, logit, w = F.col("label"), F.col("logit"), F.col("_valid")
    real = F.when(F.col("is_pseudo"), 0.0).otherwise(w)
    pseudo = F.when(F.col("is_pseudo"), w).otherwise(0.0)
    hit, miss = y * bce_with_logits(logit, F.lit(1.0)), (1 - y) * bce_with_logits(logit, F.lit(0.0))
    focal = focal_with_logits(logit, clamp(y), alpha, gamma)
    parts = {"real": real, "pseudo": pseudo}
    sums = [F.bool_or("is_pseudo").alias("_mixed"), F.sum(y * w).alias("_truth"), F.sum(w).alias("_all")]
    for name, weight in parts.items():
        sums += [
            F.sum(weight).alias(f"_w_{name}"),
            F.sum(hit * weight).alias(f"_hit_{name}"),
            F.sum(miss * weight).alias(f"_miss_{name}"),
            F.sum(focal * weight).alias(f"_focal_{name}"),
        ]
    sums.append(_weight(y, real, pos_weight).alias("_weight"))
    total = rows.agg(*sums)
    # Without any real weight the configured number itself is the weight.
    weight = F.when(F.col("_w_real") > 0, F.col("_weight")).otherwise(F.lit(float(pos_weight)))

    def bce(name: str) -> Column:
        loss = floored_ratio(F.col("_pw") * F.col(f"_hit_{name}") + F.col(f"_miss_{name}"), F.col(f"_w_{name}"), 1.0)
        return F.when(F.col(f"_w_{name}") > 0, loss).otherwise(0.0)

    def focal_of(name: str) -> Column:
        loss = floored_ratio(F.col(f"_focal_{name}"), F.col(f"_w_{name}"), 1.0)
        return F.when(F.col(f"_w_{name}") > 0, loss).otherwise(0.0)

    together = floored_ratio(F.col("_focal_real") + F.col("_focal_pseudo"), F.col("_all"), 1.0)
    split = focal_of("real") + (pseudo_focal_scale * focal_of("pseudo") if pseudo_focal_scale > 0 else F.lit(0.0))
    focal_loss = F.when(F.col("_mixed"), split).otherwise(together) if pseudo_focal_scale < 1.0 else together
    plain_bce = floored_ratio(F.col("_pw") * F.col("_hit_real") + F.col("_miss_real"), F.col("_w_real"), 1.0)
    terms = total.withColumn("_pw", F.when(F.col("_mixed"), weight).otherwise(F.col("_weight"))).select(
        F.when(F.col("_mixed"), bce("real") + pseudo_bce_scale * bce("pseudo")).otherwise(plain_bce).alias("bce_loss"),
        focal_loss.alias("focal_loss"),
        F.when(F.col("_mixed"), 0.0).otherwise(F.col("_pw")).alias("pos_weight"),
        floored_ratio(F.col("_truth"), F.col("_all"), 1.0).alias("truth_pos"),
    )
    joined = terms.withColumn("dice_loss", _dice(rows, F.col("_valid")).scalar())
    loss = lambda_bce * F.col("bce_loss") + lambda_focal * F.col("focal_loss") + lambda_dice * F.col("dice_loss")
    return joined.withColumn("loss", loss)


