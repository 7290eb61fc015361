"""Pseudo-labels: mixing, sampling, confidences, curriculum, refresh, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions.numeric import clamp
from partloom.operators import pseudo as psd
from partloom.operators.skew import split_join
from partloom.plans import tables as t
from partloom.plans.evaluation import rounded
from partloom.plans.registry import query
from partloom.plans.tables import SQL, q6, r6, views


def halves(spark, d):
    rows = t.manifest(spark, d)
    real = rows.filter("kind = 'real'").drop("kind")
    return real, rows.filter("kind = 'pseudo'").drop("kind", "category_split")


@query(
    "split_filter",
    views("fx_manifest")
    + """SELECT sample_id, 'instruction' AS kind FROM fx_manifest WHERE coalesce(instruction_split, 'seen') = 'seen'
UNION ALL SELECT sample_id, 'object' FROM fx_manifest WHERE object_split = 'val'
UNION ALL SELECT sample_id, 'category' FROM fx_manifest WHERE category_split = 'unseen'""",
)
def split_filter(spark, d):
    rows = t.manifest(spark, d)
    picked = None
    for kind, value in (("instruction", "seen"), ("object", "val"), ("category", "unseen")):
        part = psd.split_filter(rows, column=f"{kind}_split", value=value).select("sample_id", F.lit(kind).alias("kind"))
        picked = part if picked is None else picked.unionByName(part)
    return picked


@query(
    "mixed_union",
    views("fx_manifest")
    + """SELECT sample_id, kind AS source, object_split, CASE WHEN kind = 'real' THEN category_split END AS category_split FROM fx_manifest""",
)
def mixed_union(spark, d):
    return psd.mixed_union(*halves(spark, d)).select("sample_id", "source", "object_split", "category_split")


@query(
    "mixed_manifest_counts",
    views("fx_manifest")
    + """SELECT count(*) AS num_rows, count(*) FILTER (kind = 'real') AS num_real, count(*) FILTER (kind = 'pseudo') AS num_pseudo FROM fx_manifest""",
)
def mixed_manifest_counts(spark, d):
    """Written by source, read back, counted."""
    from partloom.session import scratch_path
    from partloom.sources.writers import write_partitioned

    path = scratch_path(spark, "mixed")
    write_partitioned(psd.mixed_union(*halves(spark, d)), path, ["source"])
    return psd.mixed_counts(spark.read.parquet(path))


@query(
    "pseudo_sample",
    views("fx_manifest")
    + """SELECT sample_id, object_split FROM fx_manifest WHERE kind = 'pseudo' QUALIFY row_number() OVER (ORDER BY md5('42:' || sample_id), sample_id)
  <= greatest(1, floor(count(*) OVER () * 0.3))""",
)
def pseudo_sample(spark, d):
    _, rows = halves(spark, d)
    return psd.pseudo_sample(rows.select("sample_id", "object_split"), "sample_id", 0.3)


@query(
    "manifest_offsets",
    views("fx_manifest")
    + """SELECT manifest_pos, num_rows, coalesce(sum(num_rows) OVER (ORDER BY manifest_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_offset
FROM (SELECT n AS manifest_pos, count(*) AS num_rows FROM (SELECT sample_id % 8 AS n FROM fx_manifest ) GROUP BY n)""",
)
def manifest_offsets(spark, d):
    counts = t.manifest(spark, d).groupBy((F.col("sample_id") % 8).alias("manifest_pos")).agg(F.count(F.lit(1)).alias("num_rows"))
    return psd.manifest_offsets(counts)


# A geometry record per embedding: two target maps and three teacher maps of 16 points.
SQL["fx_maps"] = """
SELECT vec_id AS sample_id, vec_id % 5 AS target_index, vec_id % 4 = 3 AS bare, 'part_' || (vec_id % 6) AS part_name, embedding FROM embeddings"""


@query(
    "select_heatmap",
    views("fx_maps")
    + f""", p AS (SELECT *, i FROM fx_maps , range(16) r(i))
SELECT sample_id, i::BIGINT AS pos, {q6('''least(greatest(CASE WHEN target_index < 2 THEN embedding[target_index * 16 + i + 1] WHEN bare THEN 0
  WHEN part_name IN ('part_0', 'part_1') THEN embedding[(part_name[6]::INT + 2) * 16 + i + 1]
  ELSE greatest(embedding[32 + i + 1], embedding[48 + i + 1]) END, 0), 1)''')} AS heatmap FROM p""",
)
def select_heatmap(spark, d):
    e = F.transform("embedding", lambda v: v.cast("double"))
    cut = lambda k: F.slice("_e", k * 16 + 1, 16)
    i = F.col("vec_id")
    rows = t.table(spark, d, "embeddings").withColumn("_e", e).select(
        i.alias("sample_id"),
        (i % 5).alias("target_index"),
        F.concat(F.lit("part_"), (i % 6).cast("string")).alias("part_name"),
        F.array(cut(0), cut(1)).alias("targets"),
        F.when(i % 4 == 3, F.array().cast("array<array<double>>")).otherwise(F.array(cut(2), cut(3))).alias("teachers"),
        F.array(F.lit("part_0"), F.lit("part_1")).alias("part_names"),
        F.lit(16).alias("n"),
    )
    maps = psd.select_heatmap(rows).select("sample_id", F.posexplode("heatmap").alias("pos", "heatmap"))
    return maps.select("sample_id", F.col("pos").cast("bigint").alias("pos"), r6("heatmap").alias("heatmap"))


SQL["fx_maps_long"] = """
SELECT sample_id, pos, sample_id % 3 = 0 AS is_pseudo, target AS heatmap, prob FROM fx_preds"""


def heatmaps(spark, d):
    return t.predictions(spark, d).select(
        "sample_id", "pos", (F.col("sample_id") % 3 == 0).alias("is_pseudo"), F.col("target").alias("heatmap"), "prob"
    )


SQL["fx_confidence"] = """
SELECT sample_id, is_pseudo, CASE WHEN is_pseudo THEN least(greatest(avg(abs(heatmap - 0.5) * 2), 0), 1) * 0.5 ELSE 1 END AS confidence,
  count(*) FILTER (is_pseudo AND heatmap < 0.8 AND heatmap > 0.2) AS num_ignored FROM fx_maps_long GROUP BY sample_id, is_pseudo"""


@query(
    "pseudo_confidence",
    views("fx_confidence") + f"SELECT sample_id, is_pseudo, {q6('confidence')} AS confidence, num_ignored FROM fx_confidence",
)
def pseudo_confidence(spark, d):
    return rounded(psd.pseudo_confidence(heatmaps(spark, d)), "sample_id", "is_pseudo")


SQL["fx_epochs"] = """
SELECT epoch, CASE WHEN epoch < 5 THEN 0 WHEN epoch < 15 THEN 0.5 * ((epoch - 5) / 10) ELSE 0.5 END AS weight FROM range(1, 21) r(epoch)"""


@query(
    "curriculum",
    views("fx_confidence", "fx_epochs")
    + f"""SELECT sample_id, epoch, {q6('CASE WHEN is_pseudo THEN confidence * (weight / 0.5) ELSE confidence END')} AS confidence
FROM fx_confidence , fx_epochs""",
)
def curriculum(spark, d):
    """Confidences of every sample in twenty epochs of a ramp."""
    epochs = psd.pseudo_confidence(heatmaps(spark, d)).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(20))))
    weight = psd.curriculum_weight(F.col("epoch"), start=5, rampup=10, weight=0.5)
    scaled = psd.curriculum_confidence(F.col("confidence"), F.col("is_pseudo"), weight, 0.5)
    return epochs.select("sample_id", F.col("epoch").cast("bigint").alias("epoch"), r6(scaled).alias("confidence"))


@query(
    "soft_labels",
    views("fx_maps_long")
    + f"""SELECT sample_id, pos, {q6('CASE WHEN is_pseudo THEN heatmap * (1 - 2 * 0.05) + 0.05 ELSE heatmap END')} AS soft,
  CASE WHEN is_pseudo THEN CASE WHEN heatmap > 0.5 THEN 0.95 ELSE 0.05 END ELSE CASE WHEN heatmap > 0.5 THEN 1 ELSE 0 END END::DOUBLE AS hard FROM fx_maps_long""",
)
def soft_labels(spark, d):
    heat, fake = clamp(F.col("heatmap")), F.col("is_pseudo")
    return heatmaps(spark, d).select(
        "sample_id", "pos",
        r6(psd.smooth_label(heat, fake, 0.05)).alias("soft"),
        r6(psd.smooth_label(psd.binarize(heat, 0.5), fake, 0.05)).alias("hard"),
    )


@query(
    "pad_batches",
    """SELECT vec_id AS sample_id, vec_id // 16 AS batch_id, max(n) OVER (PARTITION BY vec_id // 16)::BIGINT AS padded_length, n::BIGINT AS valid_points, """
    + q6("list_sum(embedding[1:n])")
    + """ AS total FROM (SELECT *, 20 + (vec_id * 7) % 40 AS n FROM embeddings)""",
)
def pad_batches(spark, d):
    i = F.col("vec_id")
    heat = F.slice(F.transform("embedding", lambda v: v.cast("double")), F.lit(1), (20 + (i * 7) % 40).cast("int"))
    samples = t.table(spark, d, "embeddings").select(t.div(i, 16).alias("batch_id"), i.alias("sample_id"), heat.alias("heatmap"))
    padded = psd.pad_batches(samples)
    total = F.aggregate("heatmap", F.lit(0.0), lambda a, v: a + v)
    return padded.select(
        "sample_id", "batch_id", F.col("padded_length").cast("bigint").alias("padded_length"),
        F.size(F.filter("point_mask", lambda m: m)).cast("bigint").alias("valid_points"), r6(total).alias("total"),
    )


@query(
    "manifest_lookup",
    """SELECT doc_id AS sample_id, v.label AS geo_label, o_orderpriority AS token FROM documents
JOIN embeddings v ON v.vec_id = doc_id % 200 JOIN orders ON o_orderkey = (doc_id % 50) * 4 + doc_id % 4""",
)
def manifest_lookup(spark, d):
    i = F.col("doc_id")
    rows = t.table(spark, d, "documents").select(
        i.alias("sample_id"), F.concat(F.lit("geo/"), (i % 200).cast("string")).alias("geo_cache_path"),
        F.concat(F.lit("vlm/"), (i % 50).cast("string")).alias("vlm_cache_path"), (i % 4).alias("vlm_cache_index"),
    )
    geometry = t.table(spark, d, "embeddings").select(
        F.concat(F.lit("geo/"), F.col("vec_id").cast("string")).alias("geo_cache_path"), F.col("label").alias("geo_label")
    )
    k = F.col("o_orderkey")
    tokens = t.table(spark, d, "orders").select(
        F.concat(F.lit("vlm/"), t.div(k, 4).cast("string")).alias("vlm_cache_path"), (k % 4).alias("vlm_cache_index"),
        F.col("o_orderpriority").alias("token"),
    )
    return psd.manifest_lookup(rows, geometry, tokens).select("sample_id", "geo_label", "token")


def fresh(spark, d):
    """Refreshed maps of every fifth sample: its predictions."""
    return heatmaps(spark, d).filter("sample_id % 5 = 0").select("sample_id", "pos", F.col("prob").alias("heatmap"))


@query(
    "pseudo_refresh",
    views("fx_maps_long")
    + f"SELECT sample_id, pos, {q6('CASE WHEN sample_id % 5 = 0 THEN prob ELSE heatmap END')} AS heatmap, sample_id % 5 = 0 AS refreshed FROM fx_maps_long",
)
def pseudo_refresh(spark, d):
    return rounded(psd.refresh_heatmaps(heatmaps(spark, d).drop("prob", "is_pseudo"), fresh(spark, d)), "sample_id", "pos")


@query(
    "pseudo_refresh_stats",
    views("fx_maps_long")
    + f"""SELECT count(*) AS refreshed_samples, {q6('avg(change)')} AS mean_heatmap_change FROM (
SELECT sample_id, avg(abs(prob - heatmap)) AS change FROM fx_maps_long WHERE sample_id % 5 = 0 GROUP BY sample_id)""",
)
def pseudo_refresh_stats(spark, d):
    return rounded(psd.refresh_change(heatmaps(spark, d), fresh(spark, d)))


SQL["fx_logits"] = """
SELECT object_id AS sample_id, y * 8 + x AS pos, object_id % 3 = 0 AS is_pseudo, 8 * v AS logit,
  least(greatest(3 * v + 0.1 * (((y * 8 + x + 1) % 5) - 2), 0), 1) AS heatmap FROM fx_pixels"""


def logits(spark, d):
    pos = F.col("y") * 8 + F.col("x")
    return t.pixels(spark, d).select(
        F.col("object_id").alias("sample_id"), pos.alias("pos"), (F.col("object_id") % 3 == 0).alias("is_pseudo"),
        (8 * F.col("v")).alias("logit"), clamp(3 * F.col("v") + 0.1 * (((pos + 1) % 5) - 2)).alias("heatmap"),
    )


# Losses of a point for label 1 and label 0, and its probability.
_POINT = "ln(1 + exp(-abs(logit))) + greatest(-logit, 0) AS on_, ln(1 + exp(-abs(logit))) + greatest(logit, 0) AS off_, 1 / (1 + exp(-logit)) AS p"
_FOCAL = "(0.25 * y + 0.75 * (1 - y)) * pow(1 - (p * y + (1 - p) * (1 - y)), 2) * (y * on_ + (1 - y) * off_)"


@query(
    "loss_report",
    views("fx_logits")
    + f""", t AS (SELECT *, {_POINT}, CASE WHEN heatmap > 0.5 THEN 1 ELSE 0 END::DOUBLE AS y FROM fx_logits ),
w AS (SELECT greatest(sum(1 - y) / greatest(sum(y), 1), 1) AS pw FROM t),
b AS (SELECT any_value(pw) AS pos_weight, avg(pw * y * on_ + (1 - y) * off_) AS bce_loss, avg({_FOCAL}) AS focal_loss, avg(y) AS truth_pos FROM t, w),
g AS (SELECT 1 - avg(dice) AS dice_loss FROM (SELECT (2 * sum(p * y) + 1) / (sum(p) + sum(y) + 1) AS dice FROM t GROUP BY sample_id))
SELECT {', '.join(f'{q6(c)} AS {c}' for c in ('pos_weight', 'bce_loss', 'focal_loss', 'truth_pos', 'dice_loss'))},
  {q6('bce_loss + focal_loss + dice_loss')} AS loss FROM b, g""",
)
def loss_report(spark, d):
    return rounded(psd.loss_report(logits(spark, d)))


@query(
    "mixed_loss_report",
    views("fx_logits")
    + f""", c AS (SELECT sample_id, CASE WHEN is_pseudo THEN least(avg(abs(heatmap - 0.5) * 2), 1) * 0.5 ELSE 1 END AS conf FROM fx_logits GROUP BY sample_id, is_pseudo),
t AS (SELECT sample_id, is_pseudo, {_POINT}, CASE WHEN is_pseudo THEN heatmap * 0.9 + 0.05 ELSE heatmap END AS y,
  conf * (pos < 50 + sample_id % 10)::INT * (NOT (is_pseudo AND heatmap < 0.8 AND heatmap > 0.2))::INT AS w FROM fx_logits JOIN c USING (sample_id)),
q AS (SELECT greatest(sum((1 - y) * w) / greatest(sum(y * w), 1), 1) AS pw FROM t WHERE NOT is_pseudo),
m AS (SELECT is_pseudo, sum((pw * y * on_ + (1 - y) * off_) * w) / greatest(sum(w), 1) AS bce, sum({_FOCAL} * w) / greatest(sum(w), 1) AS focal FROM t, q GROUP BY is_pseudo),
b AS (SELECT sum(bce * CASE WHEN is_pseudo THEN 0.3 ELSE 1 END) AS bce_loss, sum(focal * CASE WHEN is_pseudo THEN 0.5 ELSE 1 END) AS focal_loss FROM m),
g AS (SELECT 1 - avg(dice) AS dice_loss FROM (SELECT (2 * sum(p * w * y * w) + 1) / (sum(p * w) + sum(y * w) + 1) AS dice FROM t GROUP BY sample_id)),
h AS (SELECT sum(y * w) / greatest(sum(w), 1) AS truth_pos FROM t)
SELECT {', '.join(f'{q6(c)} AS {c}' for c in ('bce_loss', 'focal_loss', 'dice_loss', 'truth_pos'))}, 0::DOUBLE AS pos_weight,
  {q6('bce_loss + focal_loss + dice_loss')} AS loss FROM b, g, h""",
)
def mixed_loss_report(spark, d):
    rows = logits(spark, d)
    confidence = psd.pseudo_confidence(rows).select("sample_id", "confidence")
    weighed = split_join(rows, confidence, ["sample_id"], ["pos"]).select(
        "sample_id", "is_pseudo", "logit", "heatmap", "confidence",
        (F.col("pos") < 50 + F.col("sample_id") % 10).alias("point_mask"),
        psd.ignore_mask(F.col("heatmap"), F.col("is_pseudo")).alias("ignored"),
    )
    return rounded(
        psd.mixed_loss_report(weighed, use_soft_labels=True, label_smoothing=0.05, pseudo_focal_scale=0.5)
    )
