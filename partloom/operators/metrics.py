"""Scores of predictions against targets: per sample, per category, per split, over everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from partloom import fixed_values as fixed
from partloom.config import MetricConfig
from partloom.functions.numeric import clamp, floored_ratio, score_bucket
from partloom.operators.ordered import global_row_number, id_chunk, running_sums
from partloom.operators.skew import split_join

NAN = float("nan")


def align(prob: DataFrame, target: DataFrame) -> DataFrame:
    """Predicted and true values at the positions both sides have."""
    return prob.join(target, ["sample_id", "pos"])


def align_arrays(pairs: DataFrame) -> DataFrame:
    """Long rows from two arrays per sample, cut to the shorter one."""
    count = F.least(F.size("prob"), F.size("target"))
    zipped = F.arrays_zip(F.slice("prob", F.lit(1), count).alias("prob"), F.slice("target", F.lit(1), count).alias("target"))
    kept = [c for c in pairs.columns if c not in ("prob", "target")]
    return pairs.select(*kept, F.posexplode(zipped).alias("pos", "_z")).select(
        *kept, F.col("pos").cast("bigint").alias("pos"), "_z.prob", "_z.target"
    )


def sample_metrics(preds: DataFrame, cfg: MetricConfig = MetricConfig(), keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Thresholded and soft metrics per sample from one pre-aggregated pass; unused ones are pruned away.

    All but `mae` clip both sides to 0..1 for the soft metrics.
    """
    hit, truth = F.col("prob") >= cfg.score_threshold, F.col("target") > cfg.support_eps
    p, t = clamp(F.col("prob")), clamp(F.col("target"))
    support, gap = t > cfg.support_eps, F.abs(p - t)
    sums = preds.groupBy(*keys).agg(
        F.count_if(hit & truth).cast("double").alias("_tp"),
        F.count_if(hit & ~truth).cast("double").alias("_fp"),
        F.count_if(~hit & truth).cast("double").alias("_fn"),
        F.sum(F.least(p, t)).alias("_inter"),
        F.sum(F.greatest(p, t)).alias("_union"),
        F.sum(t).alias("_mass"),
        F.sum(gap * t).alias("_weighted"),
        F.avg(gap).alias("_plain"),
        F.avg(F.when(support, gap)).alias("_support"),
        F.avg(F.when(support, p)).alias("_inside"),
        F.avg(F.when(~support, p)).alias("_outside"),
        F.avg(F.abs(F.col("prob") - F.col("target"))).alias("mae"),
    )
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    precision, recall = floored_ratio(tp, tp + fp, 1.0), floored_ratio(tp, tp + fn, 1.0)
    zero, heavy = F.lit(0.0), F.col("_mass") > 1e-8
    inside, outside = F.coalesce("_inside", zero), F.coalesce("_outside", zero)
    weighted = F.col("_weighted") / F.when(heavy, F.col("_mass")).otherwise(1.0)
    return sums.select(
        *keys,
        floored_ratio(tp, tp + fp + fn, 1.0).alias("iou"),
        precision.alias("precision"),
        recall.alias("recall"),
        floored_ratio(2.0 * precision * recall, precision + recall, 1e-8).alias("f1"),
        floored_ratio(F.col("_inter"), F.col("_union"), 1e-8).alias("weighted_iou"),
        F.when(heavy, weighted).otherwise(F.col("_plain")).alias("weighted_mae"),
        F.coalesce("_support", zero).alias("support_mae"),
        inside.alias("support_score_mean"),
        outside.alias("background_score_mean"),
        (inside - outside).alias("score_margin_mean"),
        "mae",
    )


BINARY_METRICS = ("iou", "precision", "recall", "f1")


def formal_binary(preds: DataFrame, cfg: MetricConfig = MetricConfig()) -> DataFrame:
    """IoU, precision, recall and F1 per sample."""
    return sample_metrics(preds, cfg).select("sample_id", *BINARY_METRICS)


def formal_soft(preds: DataFrame, cfg: MetricConfig = MetricConfig()) -> DataFrame:
    """Soft IoU, errors and score margins per sample."""
    return sample_metrics(preds, cfg).drop(*BINARY_METRICS)


def _tie_groups(preds: DataFrame, eps: float) -> DataFrame:
    """Rows and positives per (sample, score)."""
    return preds.groupBy("sample_id", "prob").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("target") > eps).alias("_p")
    )


def average_precision(preds: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Mean of the precision at each positive, in the order (score falling, position); 0 with no positives.

    Rows are first counted per distinct score. Running counts over scores and, inside one score, over
    positions are then cut into chunks, so a sample or a tied score of any size spreads over tasks.
    """
    ties = _tie_groups(preds, eps)
    ahead = running_sums(
        ties,
        ["sample_id"],
        [F.desc("prob")],
        -score_bucket(F.col("prob")),
        {"_n_ahead": F.col("_n"), "_p_ahead": F.col("_p")},
    ).select("sample_id", "prob", "_n_ahead", "_p_ahead")
    inside = running_sums(
        preds.withColumn("_hit", (F.col("target") > eps).cast("bigint")),
        ["sample_id", "prob"],
        ["pos"],
        id_chunk("pos"),
        {"_n_in": F.lit(1), "_p_in": F.col("_hit")},
        inclusive=True,
    ).filter(F.col("_hit") == 1)
    precision = (F.col("_p_ahead") + F.col("_p_in")) / (F.col("_n_ahead") + F.col("_n_in"))
    at_hits = inside.join(ahead, ["sample_id", "prob"]).groupBy("sample_id").agg(F.avg(precision).alias("pr_auc"))
    samples = ties.select("sample_id").distinct()
    return samples.join(at_hits, "sample_id", "left").withColumn("pr_auc", F.coalesce("pr_auc", F.lit(0.0)))


def roc_auc(preds: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Rank AUC per sample with average ranks on ties; 0 when a class is absent."""
    ties = _tie_groups(preds, eps)
    ahead = running_sums(
        ties, ["sample_id"], ["prob"], score_bucket(F.col("prob")), {"_below": F.col("_n")}
    )
    rank = F.col("_below") + (F.col("_n") + 1) / 2.0
    sums = ahead.groupBy("sample_id").agg(
        F.sum(rank * F.col("_p")).alias("_ranks"), F.sum("_p").alias("_pos"), F.sum("_n").alias("_all")
    )
    pos, neg = F.col("_pos"), F.col("_all") - F.col("_pos")
    both = (pos > 0) & (neg > 0)
    auc = (F.col("_ranks") - pos * (pos + 1) / 2.0) / F.when(both, pos * neg).otherwise(1)
    return sums.select("sample_id", F.when(both, auc).otherwise(F.lit(0.0)).alias("roc_auc"))


def formal_metrics(preds: DataFrame, cfg: MetricConfig = MetricConfig()) -> DataFrame:
    """All per-sample metrics."""
    return (
        sample_metrics(preds, cfg)
        .join(average_precision(preds, cfg.support_eps), "sample_id")
        .join(roc_auc(preds, cfg.support_eps), "sample_id")
    )


def formal_summary(per_sample: DataFrame, cfg: MetricConfig = MetricConfig()) -> DataFrame:
    """Plain mean of each metric over samples, with the constants and the number of samples."""
    names = [c for c in per_sample.columns if c != "sample_id"]
    return per_sample.agg(
        *[F.avg(n).alias(n) for n in names], F.count(F.lit(1)).alias("samples")
    ).withColumns({"score_threshold": F.lit(cfg.score_threshold), "support_eps": F.lit(cfg.support_eps)})


def category_sums(preds: DataFrame, *, threshold: float, positive_threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """Sums per category (of each key): the one pass over points that all micro metrics come from."""
    hit = (F.col("prob") >= threshold).cast("double")
    label = (clamp(F.col("target")) > positive_threshold).cast("double")
    return preds.groupBy(*keys, "category").agg(
        F.sum(hit * label).alias("_inter"),
        F.sum(F.greatest(hit, label)).alias("_union"),
        F.sum(F.abs(F.col("prob") - label)).alias("_error"),
        F.sum(hit).alias("_hits"),
        F.sum(label).alias("_labels"),
        F.sum("prob").alias("_prob"),
        F.max("prob").alias("_top"),
        F.count(F.lit(1)).cast("double").alias("_n"),
    )


def basic_metrics(
    preds: DataFrame, *, threshold: float = 0.5, positive_threshold: float = 0.5, keys: Sequence[str] = ()
) -> DataFrame:
    """Micro metrics over all points (of each key) and the mean IoU over categories."""
    sums = category_sums(preds, threshold=threshold, positive_threshold=positive_threshold, keys=keys)

    def share(name: str) -> Column:
        return F.sum(name) / F.greatest(F.sum("_n"), F.lit(1.0))

    return sums.groupBy(*keys).agg(
        floored_ratio(F.sum("_inter"), F.sum("_union"), 1.0).alias("iou"),
        F.avg(floored_ratio(F.col("_inter"), F.col("_union"), 1.0)).alias("miou"),
        share("_error").alias("mae"),
        share("_hits").alias("pred_pos"),
        share("_labels").alias("truth_pos"),
        share("_prob").alias("prob_mean"),
        F.max("_top").alias("prob_max"),
        F.lit(1.0).alias("valid_ratio"),
    )


def category_iou(
    preds: DataFrame, *, threshold: float = 0.5, positive_threshold: float = 0.5, keys: Sequence[str] = ()
) -> DataFrame:
    """Pooled IoU per category."""
    sums = category_sums(preds, threshold=threshold, positive_threshold=positive_threshold, keys=keys)
    return sums.select(*keys, "category", floored_ratio(F.col("_inter"), F.col("_union"), 1.0).alias("iou"))


def category_miou(per_category: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return per_category.groupBy(*keys).agg(F.avg("iou").alias("miou"))


def basic_auc(preds: DataFrame, *, positive_threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Rank AUC over all points with ordinal ranks: ties go by (sample, position); NaN for one class.

    Positions come from one range-partitioned order over (keys, score, sample, position). Inside a key
    they are the global positions less those of the keys before it, so only sums are needed.
    """
    label = (clamp(F.col("target")) > positive_threshold).cast("bigint")
    ranked = global_row_number(
        preds.select(*keys, "prob", "sample_id", "pos", label.alias("_label")),
        [*keys, "prob", "sample_id", "pos"],
        "_rank",
    )
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("_rank").cast("double") * F.col("_label")).alias("_ranks"),
        F.sum("_label").cast("double").alias("_pos"),
        F.count(F.lit(1)).cast("double").alias("_all"),
        F.min("_rank").cast("double").alias("_first"),
    )
    pos, neg = F.col("_pos"), F.col("_all") - F.col("_pos")
    both = (pos > 0) & (neg > 0)
    ranks = F.col("_ranks") - pos * (F.col("_first") - 1)
    auc = (ranks - pos * (pos + 1) / 2) / F.when(both, pos * neg).otherwise(1.0)
    return sums.select(*keys, F.when(both, auc).otherwise(F.lit(NAN)).alias("auc"))


def similarity(preds: DataFrame, keys: Sequence[str] = (), eps: float = 1e-8) -> DataFrame:
    """Overlap of the two normalised maps per sample; both empty 1, one empty 0.

    The sums of a sample are found first and joined back, then the minima are summed: both passes
    pre-aggregate, so a huge sample is no hot task.
    """
    clipped = preds.select(*keys, "sample_id", "pos", clamp(F.col("prob")).alias("_p"), clamp(F.col("target")).alias("_t"))
    mass = clipped.groupBy(*keys, "sample_id").agg(F.sum("_p").alias("_ps"), F.sum("_t").alias("_ts"))
    has_p, has_t = F.col("_ps") > eps, F.col("_ts") > eps
    norm_p = F.when(has_p, F.col("_p") / F.when(has_p, F.col("_ps")).otherwise(1.0)).otherwise(0.0)
    norm_t = F.when(has_t, F.col("_t") / F.when(has_t, F.col("_ts")).otherwise(1.0)).otherwise(0.0)
    shared = (
        split_join(clipped, mass, [*keys, "sample_id"], ["pos"])
        .groupBy(*keys, "sample_id")
        .agg(F.sum(F.least(norm_p, norm_t)).alias("_sim"), F.first("_ps").alias("_ps"), F.first("_ts").alias("_ts"))
    )
    value = F.when(has_p & has_t, F.col("_sim")).when(~has_p & ~has_t, 1.0).otherwise(0.0)
    return shared.select(*keys, "sample_id", value.alias("sim"))


def protocol_report(preds: DataFrame, split: str = "split", *, threshold: float = 0.5, positive_threshold: float = 0.5) -> DataFrame:
    """Metric set and number of samples of every split that has rows."""
    bounds = {"threshold": threshold, "positive_threshold": positive_threshold}
    keys = [split]
    sims = similarity(preds, keys).groupBy(split).agg(F.avg("sim").alias("sim"), F.count(F.lit(1)).alias("samples"))
    return (
        basic_metrics(preds, **bounds, keys=keys)
        .join(basic_auc(preds, positive_threshold=positive_threshold, keys=keys), split)
        .join(sims, split)
    )


def _side(metrics: DataFrame, split: str, value: str, names: Sequence[str], tag: str) -> DataFrame:
    return metrics.filter(F.col(split) == value).select(*[F.col(n).alias(f"{tag}_{n}") for n in names])


def decoder_deltas(report: DataFrame, split: str, seen: str, unseen: str) -> DataFrame:
    """Seen minus unseen for every metric, one row per metric."""
    names = [n for n in fixed.DECODER_DELTA_KEYS if n in report.columns]
    return _deltas(report, split, seen, unseen, {n: 1 for n in names})


def formal_deltas(report: DataFrame, split: str, seen: str, unseen: str) -> DataFrame:
    """Seen minus unseen for scores, unseen minus seen for errors."""
    signs = {n: 1 for n in fixed.FORMAL_SCORE_KEYS} | {n: -1 for n in fixed.FORMAL_ERROR_KEYS}
    return _deltas(report, split, seen, unseen, {n: s for n, s in signs.items() if n in report.columns})


def _deltas(report: DataFrame, split: str, seen: str, unseen: str, signs: dict[str, int]) -> DataFrame:
    long = metric_report(report.select(split, *signs), [split], digits=None)
    side = F.when(F.col(split) == seen, F.col("value")).when(F.col(split) == unseen, -F.col("value"))
    sign = F.element_at(F.create_map(*[F.lit(x) for pair in signs.items() for x in pair]), F.col("metric"))
    return (
        long.filter(F.col(split).isin(seen, unseen))
        .groupBy("metric")
        .agg(F.sum(side * sign).alias("delta"), F.count(F.lit(1)).alias("_sides"))
        .filter(F.col("_sides") == 2)
        .select(F.concat(F.lit("delta_"), F.col("metric")).alias("metric"), "delta")
    )


def metric_report(metrics: DataFrame, keys: Sequence[str] = (), digits: int | None = 6) -> DataFrame:
    """Wide metrics as long (`metric`, `value`) rows, rounded for the report."""
    names = [c for c in metrics.columns if c not in keys]
    long = metrics.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        list(keys), names, "metric", "value"
    )
    return long if digits is None else long.withColumn("value", F.round("value", digits))


def merge_metrics(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean with NaN left out of sum and count; NaN if nothing is left."""
    number = F.when(~F.isnan(value), F.col(value))
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(number), F.lit(NAN)).alias(value))


def reduce_metrics(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean with NaN left out of the sum but counted; NaN for no rows."""
    return rows.groupBy(*keys).agg((F.sum(F.nanvl(value, F.lit(0.0))) / F.count(F.lit(1))).alias(value))


def best_epoch(history: DataFrame, keys: Sequence[str], value: str, mode: str = "max") -> DataFrame:
    """Best epoch per run: NaN never wins, the later epoch wins ties."""
    if mode not in ("max", "min"):
        raise ValueError("mode must be max or min")
    sign: Column = F.col(value) if mode == "max" else -F.col(value)
    best = F.max(F.struct(sign.alias("v"), F.col("epoch")))
    return (
        history.filter(~F.isnan(value))
        .groupBy(*keys)
        .agg(best.alias("_b"))
        .select(*keys, F.col("_b.epoch").alias("best_epoch"), (F.col("_b.v") * (1 if mode == "max" else -1)).alias("best_value"))
    )
