"""Evaluation: per-sample, micro, per-category and per-split metrics, reports, training histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.operators import metrics as met
from partloom.operators.ordered import decayed_series, id_chunk, running_sums
from partloom.plans import tables as t
from partloom.plans.registry import query
from partloom.plans.tables import SQL, q6, r6, views


def rounded(df, *keys):
    """Every column but the keys in six decimals."""
    return df.select(*keys, *[r6(c).alias(c) if typ == "double" else F.col(c) for c, typ in df.dtypes if c not in keys])


SQL["fx_binary"] = """
SELECT sample_id, tp / greatest(tp + fp + fn, 1) AS iou, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall FROM (
SELECT sample_id, count(*) FILTER (prob >= 0.5 AND target > 1e-6) AS tp, count(*) FILTER (prob >= 0.5 AND target <= 1e-6) AS fp,
  count(*) FILTER (prob < 0.5 AND target > 1e-6) AS fn FROM fx_preds GROUP BY sample_id)"""

SQL["fx_soft"] = """
SELECT sample_id, sum(least(prob, target)) / greatest(sum(greatest(prob, target)), 1e-8) AS weighted_iou,
  CASE WHEN sum(target) > 1e-8 THEN sum(abs(prob - target) * target) / sum(target) ELSE avg(abs(prob - target)) END AS weighted_mae,
  coalesce(avg(abs(prob - target)) FILTER (target > 1e-6), 0) AS support_mae, coalesce(avg(prob) FILTER (target > 1e-6), 0) AS support_score_mean,
  coalesce(avg(prob) FILTER (target <= 1e-6), 0) AS background_score_mean, avg(abs(prob - target)) AS mae FROM fx_preds GROUP BY sample_id"""

SQL["fx_ap"] = """
SELECT sample_id, coalesce(avg(tp / n) FILTER (hit), 0) AS pr_auc FROM (
SELECT sample_id, target > 1e-6 AS hit, count(*) FILTER (target > 1e-6) OVER w AS tp, row_number() OVER w AS n
FROM fx_preds WINDOW w AS (PARTITION BY sample_id ORDER BY prob DESC, pos)) GROUP BY sample_id"""

SQL["fx_roc"] = """
SELECT sample_id, CASE WHEN p > 0 AND n > p THEN (r - p * (p + 1) / 2) / (p * (n - p)) ELSE 0 END AS roc_auc FROM (
SELECT sample_id, sum(rk) FILTER (hit) AS r, count(*) FILTER (hit) AS p, count(*) AS n FROM (
SELECT sample_id, target > 1e-6 AS hit, rank() OVER (PARTITION BY sample_id ORDER BY prob)
  + (count(*) OVER (PARTITION BY sample_id, prob) - 1) / 2 AS rk FROM fx_preds ) GROUP BY sample_id)"""

SQL["fx_formal"] = """
SELECT b.*, 2 * precision * recall / greatest(precision + recall, 1e-8) AS f1, s.* EXCLUDE (sample_id),
  support_score_mean - background_score_mean AS score_margin_mean, pr_auc, roc_auc
FROM fx_binary b JOIN fx_soft s USING (sample_id) JOIN fx_ap USING (sample_id) JOIN fx_roc USING (sample_id)"""

_FORMAL = (
    "iou", "precision", "recall", "f1", "weighted_iou", "weighted_mae", "support_mae", "support_score_mean",
    "background_score_mean", "score_margin_mean", "mae", "pr_auc", "roc_auc",
)


def _picked(*names, agg=None):
    return ", ".join(f"{q6(f'{agg}({n})' if agg else n)} AS {n}" for n in names)


@query(
    "align_arrays",
    """SELECT vec_id AS sample_id, p::BIGINT AS pos, """
    + q6("embedding[p + 1]") + " AS prob, " + q6("embedding[64 - p]")
    + """ AS target FROM embeddings, range(64) r(p) WHERE p < 40 + vec_id % 20""",
)
def align_arrays(spark, d):
    """A target of 64 values against predictions of 40 to 59: the shorter length counts."""
    emb = F.transform("embedding", lambda v: v.cast("double"))
    pairs = t.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.slice(emb, F.lit(1), (40 + F.col("vec_id") % 20).cast("int")).alias("prob"),
        F.reverse(emb).alias("target"),
    )
    return rounded(met.align_arrays(pairs), "sample_id", "pos")


@query("formal_binary", views("fx_formal") + "SELECT sample_id, " + _picked("iou", "precision", "recall", "f1") + " FROM fx_formal")
def formal_binary(spark, d):
    return rounded(met.formal_binary(t.predictions(spark, d)), "sample_id")


_SOFT = ("weighted_iou", "weighted_mae", "support_mae", "support_score_mean", "background_score_mean", "score_margin_mean", "mae")


@query("formal_soft", views("fx_formal") + "SELECT sample_id, " + _picked(*_SOFT) + " FROM fx_formal")
def formal_soft(spark, d):
    return rounded(met.formal_soft(t.predictions(spark, d)), "sample_id")


@query("formal_pr_auc", views("fx_ap") + "SELECT sample_id, " + _picked("pr_auc") + " FROM fx_ap")
def formal_pr_auc(spark, d):
    return rounded(met.average_precision(t.predictions(spark, d)), "sample_id")


@query("formal_roc_auc", views("fx_roc") + "SELECT sample_id, " + _picked("roc_auc") + " FROM fx_roc")
def formal_roc_auc(spark, d):
    return rounded(met.roc_auc(t.predictions(spark, d)), "sample_id")


@query(
    "formal_summary",
    views("fx_formal")
    + "SELECT " + _picked(*_FORMAL, agg="avg")
    + ", count(*) AS samples, 0.5::DOUBLE AS score_threshold, 0.000001::DOUBLE AS support_eps FROM fx_formal",
)
def formal_summary(spark, d):
    summary = met.formal_summary(met.formal_metrics(t.predictions(spark, d)))
    return summary.select(*[r6(n).alias(n) for n in _FORMAL], "samples", "score_threshold", "support_eps")


SQL["fx_labelled"] = """
SELECT *, CASE WHEN prob >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, CASE WHEN target > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS label_,
  CASE sample_id % 3 WHEN 0 THEN 'train_seen_instruction' WHEN 1 THEN 'train_unseen_instruction' ELSE 'test_unseen_object' END AS split
FROM fx_preds"""

_BASIC = """sum(hit * label_) / greatest(sum(greatest(hit, label_)), 1) AS iou, avg(abs(prob - label_)) AS mae, avg(hit) AS pred_pos,
  avg(label_) AS truth_pos, avg(prob) AS prob_mean, max(prob) AS prob_max, 1.0::DOUBLE AS valid_ratio"""


def splits(spark, d):
    i = F.col("sample_id") % 3
    split = (
        F.when(i == 0, "train_seen_instruction").when(i == 1, "train_unseen_instruction").otherwise("test_unseen_object")
    )
    return t.predictions(spark, d).withColumn("split", split)


_BASIC_NAMES = ("iou", "mae", "pred_pos", "truth_pos", "prob_mean", "prob_max", "valid_ratio")


@query("basic_metrics", views("fx_labelled") + f"SELECT {_picked(*_BASIC_NAMES)} FROM (SELECT {_BASIC} FROM fx_labelled )")
def basic_metrics(spark, d):
    return rounded(met.basic_metrics(t.predictions(spark, d)).drop("miou"))


@query(
    "category_miou",
    views("fx_labelled")
    + f"""SELECT category, {q6('iou')} AS iou, {q6('avg(iou) OVER ()')} AS miou FROM (
SELECT category, sum(hit * label_) / greatest(sum(greatest(hit, label_)), 1) AS iou FROM fx_labelled GROUP BY category)""",
)
def category_miou(spark, d):
    per_category = met.category_iou(t.predictions(spark, d))
    return rounded(per_category.withColumn("miou", met.category_miou(per_category).scalar()), "category")


SQL["fx_auc"] = """
SELECT split, CASE WHEN p > 0 AND n > p THEN (r - p * (p + 1) / 2) / (p * (n - p)) END AS auc FROM (
SELECT split, sum(rk) FILTER (label_ > 0) AS r, count(*) FILTER (label_ > 0) AS p, count(*) AS n FROM (
SELECT split, label_, row_number() OVER (PARTITION BY split ORDER BY prob, sample_id, pos)::DOUBLE AS rk FROM fx_labelled ) GROUP BY split)"""


@query(
    "basic_auc",
    views("fx_labelled")
    + f"""SELECT {q6('(r - p * (p + 1) / 2) / (p * (n - p))')} AS auc FROM (SELECT sum(rk) FILTER (label_ > 0) AS r, count(*) FILTER (label_ > 0) AS p,
  count(*) AS n FROM (SELECT label_, row_number() OVER (ORDER BY prob, sample_id, pos)::DOUBLE AS rk FROM fx_labelled ))""",
)
def basic_auc(spark, d):
    return rounded(met.basic_auc(t.predictions(spark, d)))


SQL["fx_sim"] = """
SELECT split, sample_id, CASE WHEN ps > 1e-8 AND ts > 1e-8 THEN sum(least(prob / ps, target / ts)) WHEN ps <= 1e-8 AND ts <= 1e-8 THEN 1 ELSE 0 END AS sim
FROM (SELECT *, sum(prob) OVER (PARTITION BY sample_id) AS ps, sum(target) OVER (PARTITION BY sample_id) AS ts FROM fx_labelled )
GROUP BY split, sample_id, ps, ts"""


@query("similarity", views("fx_sim") + "SELECT sample_id, " + _picked("sim") + " FROM fx_sim")
def similarity(spark, d):
    return rounded(met.similarity(t.predictions(spark, d)), "sample_id")


SQL["fx_protocol"] = f"""
SELECT b.*, miou, auc, sim, samples FROM (SELECT split, {_BASIC} FROM fx_labelled GROUP BY split) b
JOIN (SELECT split, avg(iou) AS miou FROM (SELECT split, category, sum(hit * label_) / greatest(sum(greatest(hit, label_)), 1) AS iou
  FROM fx_labelled GROUP BY split, category) GROUP BY split) USING (split) JOIN fx_auc USING (split)
JOIN (SELECT split, avg(sim) AS sim, count(*) AS samples FROM fx_sim GROUP BY split) USING (split)"""


@query(
    "protocol_report",
    views("fx_protocol") + "SELECT split, samples, " + _picked(*_BASIC_NAMES, "miou", "auc", "sim") + " FROM fx_protocol",
)
def protocol_report(spark, d):
    return rounded(met.protocol_report(splits(spark, d)), "split", "samples")


_LONG = " UNION ALL ".join(
    f"SELECT split, '{n}' AS metric, {q6(n)} AS value FROM fx_protocol" for n in (*_BASIC_NAMES, "miou", "auc", "sim", "samples")
)


@query("metric_report", views("fx_protocol") + _LONG)
def metric_report(spark, d):
    return met.metric_report(met.protocol_report(splits(spark, d)), ["split"]).withColumn("value", r6("value"))


_DELTAS = " UNION ALL ".join(
    f"SELECT 'decoder' AS kind, 'delta_{n}' AS metric, {q6(f's.{n} - u.{n}')} AS delta FROM s, u"
    for n in ("iou", "miou", "auc", "mae", "sim", "pred_pos", "truth_pos", "prob_mean", "prob_max", "valid_ratio")
)
_FORMAL_DELTAS = " UNION ALL ".join(
    [f"SELECT 'formal', 'delta_{n}', {q6(f's.{n} - u.{n}')} FROM fs s, fu u" for n in ("iou", "weighted_iou", "pr_auc", "roc_auc", "precision", "recall", "f1")]
    + [f"SELECT 'formal', 'delta_{n}', {q6(f'u.{n} - s.{n}')} FROM fs s, fu u" for n in ("mae", "weighted_mae", "support_mae")]
)
_AVG = ", ".join(f"avg({n}) AS {n}" for n in _FORMAL)


@query(
    "metric_deltas",
    views("fx_protocol", "fx_formal")
    + f""", s AS (SELECT * FROM fx_protocol WHERE split = 'train_seen_instruction'), u AS (SELECT * FROM fx_protocol WHERE split = 'train_unseen_instruction'),
fs AS (SELECT {_AVG} FROM fx_formal WHERE sample_id % 3 = 0), fu AS (SELECT {_AVG} FROM fx_formal WHERE sample_id % 3 = 1)
{_DELTAS} UNION ALL {_FORMAL_DELTAS}""",
)
def metric_deltas(spark, d):
    seen, unseen = "train_seen_instruction", "train_unseen_instruction"
    report = met.protocol_report(splits(spark, d))
    decoder = met.decoder_deltas(report, "split", seen, unseen).select(F.lit("decoder").alias("kind"), "metric", "delta")
    i = F.col("sample_id") % 3
    split = F.when(i == 0, seen).when(i == 1, unseen).otherwise("other")
    samples = met.formal_metrics(t.predictions(spark, d)).withColumn("split", split)
    means = samples.groupBy("split").agg(*[F.avg(n).alias(n) for n in _FORMAL])
    formal = met.formal_deltas(means, "split", seen, unseen).select(F.lit("formal").alias("kind"), "metric", "delta")
    return rounded(decoder.unionByName(formal), "kind", "metric")


@query(
    "merge_metrics",
    views("fx_history") + f"SELECT run_id, {q6('avg(metric)')} AS metric FROM fx_history GROUP BY run_id",
)
def merge_metrics(spark, d):
    return rounded(met.merge_metrics(t.history(spark, d), ["run_id"], "metric"), "run_id")


@query(
    "reduce_metrics",
    views("fx_history") + f"SELECT run_id, {q6('sum(coalesce(metric, 0)) / count(*)')} AS metric FROM fx_history GROUP BY run_id",
)
def reduce_metrics(spark, d):
    return rounded(met.reduce_metrics(t.history(spark, d), ["run_id"], "metric"), "run_id")


@query(
    "best_epoch",
    views("fx_history")
    + f"""SELECT run_id, arg_max(epoch, [metric, epoch]) AS best_epoch, {q6('max(metric)')} AS best_value,
  arg_min(epoch, [metric, -epoch]) AS lowest_epoch FROM fx_history WHERE metric IS NOT NULL GROUP BY run_id""",
)
def best_epoch(spark, d):
    runs = t.history(spark, d)
    lowest = met.best_epoch(runs, ["run_id"], "metric", "min").select("run_id", F.col("best_epoch").alias("lowest_epoch"))
    return rounded(met.best_epoch(runs, ["run_id"], "metric").join(lowest, "run_id"), "run_id")


@query(
    "ema_series",
    views("fx_history").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", h AS (SELECT run_id, epoch, coalesce(metric, 0) AS metric, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS i FROM fx_history ),
e AS (SELECT run_id, epoch, i, metric AS ema FROM h WHERE i = 1
  UNION ALL SELECT h.run_id, h.epoch, h.i, 0.9123456789 * e.ema + (1 - 0.9123456789::DOUBLE) * h.metric FROM e JOIN h ON h.run_id = e.run_id AND h.i = e.i + 1)
SELECT run_id, epoch, {q6('ema')} AS ema FROM e""",
)
def ema_series(spark, d):
    series = t.history(spark, d).withColumn("metric", F.nanvl("metric", F.lit(0.0)))
    numbered = running_sums(series, ["run_id"], ["epoch"], id_chunk("epoch"), {"i": F.lit(1)}, inclusive=True)
    return rounded(decayed_series(numbered, "run_id", "i", "metric", 0.9123456789).select("run_id", "epoch", "ema"), "run_id", "epoch")
