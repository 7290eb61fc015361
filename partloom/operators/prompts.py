"""Part prompts and instructions: de-duplication, completion, reuse, and joins to model answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.functions import model_text, names


def first_per_slug(rows: DataFrame, keys: Sequence[str], slug: Column, pos: str) -> DataFrame:
    """First row per slug in `pos` order, found by a map-side combined minimum instead of a sort."""
    rest = [c for c in rows.columns if c not in (*keys, pos)]
    first = F.min_by(F.struct(pos, *rest), F.col(pos))
    return (
        rows.groupBy(*keys, slug.alias("slug")).agg(first.alias("_r")).select(*keys, "slug", f"_r.{pos}", *[f"_r.{c}" for c in rest])
    )


def keep_first(rows: DataFrame, keys: Sequence[str], pos: str, count: int) -> DataFrame:
    """The first `count` rows of each key; map tasks already drop all but their own first `count`."""
    order = Window.partitionBy(*keys).orderBy(pos)
    return rows.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= count)


def normalize_parts(
    parts: DataFrame, max_parts: int, keys: Sequence[str] = ("object_id",), *, drop_blank: bool = True
) -> DataFrame:
    """Part names as slugs, blanks dropped, first of equal slugs kept, cut to `max_parts` in order.

    On export names are canonicalised once more without the blank check: a blank then reads `unknown`.
    """
    named = parts.filter(names.strip(F.col("part_name")) != "") if drop_blank else parts
    unique = first_per_slug(named, keys, names.slug_ws(F.col("part_name")), "pos")
    kept = keep_first(unique, keys, "pos", max_parts)
    prompt = names.base_part_prompt(F.col("category_name"), F.col("slug"))
    return kept.select(
        *keys,
        (F.col("_place") - 1).alias("part_pos"),
        F.col("slug").alias("part_name"),
        prompt.alias("prompt"),
        prompt.alias("base_prompt"),
    )


def join_responses(seeds: DataFrame, responses: DataFrame, keys: Sequence[str] = ("object_id",)) -> DataFrame:
    """Part seeds with the instructions of the first response part of the same slug, or an empty list."""
    answered = first_per_slug(responses, keys, names.slug_ws(F.col("part_name")), "pos").select(
        *keys, "slug", F.col("instructions").alias("_found")
    )
    joined = seeds.withColumn("slug", names.slug_ws(F.col("part_name"))).join(answered, [*keys, "slug"], "left")
    empty = F.array().cast("array<string>")
    return joined.withColumn("instructions", F.coalesce("_found", empty)).drop("_found", "slug")


def complete_instructions(raw: DataFrame, parts: DataFrame, per_part: int = 3, key: str = "part_sample_id") -> DataFrame:
    """Up to `per_part` instructions per part: cleaned, unique ignoring case, then padded from the fallbacks.

    `raw` has (`key`, `pos`, `raw`), `parts` one row per key with `object_name`, `part_name`, `prompt`. Only the
    first `per_part` fallbacks are offered, so a part may stay short.
    """
    cleaned = raw.select(key, F.col("pos").cast("bigint").alias("pos"), model_text.normalize_instruction(F.col("raw")).alias("text"))
    given = cleaned.filter(F.col("text") != "").select(key, F.lit(0).alias("_source"), "pos", "text")
    spare = parts.select(
        key,
        F.posexplode(
            model_text.fallback_instructions(F.col("object_name"), F.col("part_name"), F.col("prompt"), per_part)
        ).alias("pos", "text"),
    ).select(key, F.lit(1).alias("_source"), F.col("pos").cast("bigint").alias("pos"), "text")
    both = given.unionByName(spare).withColumn("_order", F.struct("_source", "pos"))
    unique = both.groupBy(key, F.lower("text").alias("_low")).agg(F.min_by(F.struct("_order", "text"), "_order").alias("_r"))
    listed = unique.select(key, F.col("_r._order").alias("_order"), F.col("_r.text").alias("instruction"))
    kept = keep_first(listed, [key], "_order", per_part)
    return kept.select(
        key, (F.col("_place") - 1).cast("bigint").alias("instruction_pos"), "instruction",
        (F.col("_order._source") == 1).alias("is_fallback"),
    )


def reuse_prompts(wanted: DataFrame, stored: DataFrame, generated: DataFrame) -> DataFrame:
    """Stored prompt record if it parses to an object with a list `parts` (or none at all), else the generated one.

    `stored` and `generated` hold JSON text per object in `record`; `wanted` lists the objects.
    """
    value = F.try_parse_json("record")
    parts = model_text.field(F.col("_value"), "parts")
    usable = model_text.is_kind(F.col("_value"), "OBJECT") & (parts.isNull() | model_text.is_kind(parts, "ARRAY"))
    kept = stored.withColumn("_value", value).filter(usable).select("object_id", F.col("record").alias("_stored"))
    joined = wanted.join(kept, "object_id", "left").join(
        generated.select("object_id", F.col("record").alias("_new")), "object_id", "left"
    )
    return joined.select(
        *wanted.columns,
        F.coalesce("_stored", "_new").alias("record"),
        F.col("_stored").isNotNull().alias("reused"),
    )


def evidence_paths(files: DataFrame, num_views: int) -> DataFrame:
    """Ordered evidence per object: masked view, source image, then the first render views by name.

    `files` lists existing files as (`object_id`, `path`). Few files of an object can qualify, and render
    views are cut by rank before they are gathered.
    """
    fixed = (
        F.when(F.col("path") == "candidate/masked_instance.png", 0)
        .when(F.col("path") == "source/image.png", 1)
        .when(F.col("path").rlike(r"^render/view_[^/]*\.png$"), 2)
    )
    known = files.distinct().withColumn("_kind", fixed).filter(F.col("_kind").isNotNull())
    ranked = keep_first(known, ["object_id", "_kind"], "path", max(num_views, 1))
    kept = ranked.filter((F.col("_kind") < 2) | (F.col("_place") <= num_views))
    gathered = F.transform(
        F.sort_array(F.collect_list(F.struct("_kind", "path"))), lambda f: f["path"]
    )
    return kept.groupBy("object_id").agg(gathered.alias("evidence_paths"))


def masked_evidence(files: DataFrame) -> DataFrame:
    """The only evidence of instruction requests; an object without it is missing its input."""
    return files.filter(F.col("path") == "candidate/masked_instance.png").select("object_id", "path").distinct()
