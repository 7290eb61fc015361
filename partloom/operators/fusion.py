"""Score repair and labels: duplicate parts, hole filling, unknown points, membership summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from partloom.config import FusionConfig
from partloom.operators.lifting import add_pointless_objects, ambiguity, best_part
from partloom.operators.neighbors import local_spacing, nearest_neighbors, within_radius
from partloom.operators.skew import hot_keys, split_join
from partloom.session import Flagged, checkpointed

PART = ["object_id", "part_idx"]


def is_positive() -> Column:
    """Whether a score counts for its part; NaN and infinite scores don't, though they compare as above 0."""
    score = F.col("score")
    return F.coalesce((score > 0) & ~F.isnan(score) & (score < float("inf")), F.lit(False))


def part_counts(scores: DataFrame) -> DataFrame:
    """Positive points per part."""
    return scores.groupBy("object_id", "part_idx", "part_name").agg(
        F.count_if(is_positive()).alias("point_count")
    )


def part_overlap(scores: DataFrame) -> DataFrame:
    """Common positive points of each pair of parts of an object (`part_a` < `part_b`).

    The parts of one point are few, so the pairs come from a short array per point; the shuffle moves
    one row per point and then only pre-aggregated pair counts, however many points an object has.
    """
    positive = scores.filter(is_positive())
    held = positive.groupBy("object_id", "point_idx").agg(F.sort_array(F.collect_list("part_idx")).alias("_parts"))
    pairs = (
        held.filter(F.size("_parts") > 1)
        .select("object_id", "_parts", F.posexplode("_parts").alias("_i", "part_a"))
        .select("object_id", "part_a", F.explode(F.slice("_parts", F.col("_i") + 2, F.size("_parts"))).alias("part_b"))
    )
    return pairs.groupBy("object_id", "part_a", "part_b").agg(F.count(F.lit(1)).alias("overlap_count"))


def duplicate_pairs(counts: DataFrame, overlap: DataFrame, cfg: FusionConfig) -> DataFrame:
    """Pairs of parts close enough to be one: `base_idx` comes first by (points, name, index)."""
    place = F.struct("point_count", "part_name", "part_idx")
    side = counts.filter(F.col("point_count") > 0).withColumn("_place", place)

    def named(end: str) -> DataFrame:
        return side.select(
            "object_id",
            F.col("part_idx").alias(f"part_{end}"),
            F.col("point_count").alias(f"_count_{end}"),
            F.col("_place").alias(f"_place_{end}"),
        )

    low, high = F.least("_count_a", "_count_b"), F.greatest("_count_a", "_count_b")
    first = F.col("_place_a") < F.col("_place_b")
    return (
        overlap.join(named("a"), ["object_id", "part_a"])
        .join(named("b"), ["object_id", "part_b"])
        .withColumns({"count_diff_ratio": (high - low) / high, "overlap_ratio": F.col("overlap_count") / low})
        .filter(
            (F.col("count_diff_ratio") < cfg.duplicate_part_count_tolerance)
            & (F.col("overlap_ratio") > cfg.duplicate_part_overlap_threshold)
        )
        .select(
            "object_id",
            F.when(first, F.col("part_a")).otherwise(F.col("part_b")).alias("base_idx"),
            F.when(first, F.col("part_b")).otherwise(F.col("part_a")).alias("part_idx"),
            F.when(first, F.col("_place_a")).otherwise(F.col("_place_b")).alias("_base_place"),
            "overlap_count",
            "count_diff_ratio",
            "overlap_ratio",
        )
    )


def prune_duplicates(scores: DataFrame, cfg: FusionConfig = FusionConfig()) -> DataFrame:
    """Decision per part: `kept`, and for a dropped part the first kept part that drops it.

    Greedy rule: parts in the order (points, name, index); a part goes if an earlier KEPT part duplicates it.
    """
    counts = part_counts(scores)
    if not cfg.duplicate_part_prune_enabled:
        return counts.select(*counts.columns, F.lit(True).alias("kept"), F.lit(None).cast("bigint").alias("base_idx"))
    counts = checkpointed(counts)
    pairs = checkpointed(duplicate_pairs(counts, part_overlap(scores), cfg))
    settled = settle_rivals(counts.select(*PART), pairs.select(*PART, "base_idx"))
    blame = (
        pairs.join(
            settled.filter("kept").select("object_id", F.col("part_idx").alias("base_idx")), ["object_id", "base_idx"], "left_semi"
        )
        .groupBy(*PART)
        .agg(F.min(F.struct("_base_place", "base_idx", "overlap_count", "count_diff_ratio", "overlap_ratio")).alias("_b"))
        .select(*PART, "_b.base_idx", "_b.overlap_count", "_b.count_diff_ratio", "_b.overlap_ratio")
    )
    return counts.join(settled, PART).join(blame, PART, "left")


def settle_rivals(parts: DataFrame, rivals: DataFrame) -> DataFrame:
    """`kept` per part, where a part is kept if none of its rivals (`base_idx`, all earlier in some order) is kept.

    A part waits for literals: rivals, each plain or negated, none of which may hold. A part that waits for one literal
    only is as much as that literal's negation, so who waits for such a part can wait for the other instead. Every
    round replaces settled and such rivals at once, which doubles the reach of a chain: its rounds follow the
    logarithm of its length. What is settled in a round is stored with what is still open.
    """
    start = rivals.distinct().groupBy(*PART).agg(F.collect_set(F.struct("base_idx", F.lit(False).alias("negated"))).alias("waits"))
    first = parts.join(start, PART, "left").select(*PART, F.col("waits").isNull().alias("_free"), "waits")
    state = Flagged(first.select(*PART, F.when(F.col("_free"), F.lit(True)).alias("kept"), "waits", (~F.col("_free")).alias("open")), "open", "rivals")
    done = state.read().filter("kept is not null").select(*PART, "kept")
    while state.any():
        waiting = state.flagged().filter(F.size("waits") == 1).select(*PART, "kept", F.get("waits", F.lit(0)).alias("_for"))
        known = done.withColumn("_for", F.lit(None).cast(waiting.schema["_for"].dataType)).unionAll(waiting).withColumnRenamed("part_idx", "base_idx")
        each = state.flagged().select(*PART, F.explode("waits").alias("_w")).select(*PART, "_w.base_idx", "_w.negated")
        met = each.join(known, ["object_id", "base_idx"], "left")
        # A plain rival that holds drops the part; one that doesn't is no longer waited for.
        holds = F.col("kept") != F.col("negated")
        instead = F.struct(F.col("_for.base_idx").alias("base_idx"), (F.col("_for.negated") == F.col("negated")).alias("negated"))
        same = F.struct("base_idx", "negated")
        left = F.when(F.col("kept").isNull(), F.when(F.col("_for").isNotNull(), instead).otherwise(same))
        judged = met.groupBy(*PART).agg(F.coalesce(F.bool_or(holds), F.lit(False)).alias("_hit"), F.collect_set(left).alias("waits"))
        # A literal and its negation: one of them holds.
        either = F.size(F.array_distinct(F.transform("waits", lambda w: w["base_idx"]))) < F.size("waits")
        kept = F.when(F.col("_hit") | either, F.lit(False)).when(F.size("waits") == 0, F.lit(True))
        state = Flagged(judged.select(*PART, kept.alias("kept"), "waits", kept.isNull().alias("open")), "open", "rivals")
        done = done.unionAll(state.read().filter("kept is not null").select(*PART, "kept"))
    return done


def keep_parts(scores: DataFrame, decisions: DataFrame) -> DataFrame:
    return scores.join(decisions.filter("kept").select(*PART), PART, "left_semi")


def initial_unknown(scores: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Points no view saw or whose best score stays below `threshold`."""
    return (
        scores.groupBy("object_id", "point_idx")
        .agg(F.max("score").alias("max_score"), F.max("visible_count").alias("visible_count"))
        .filter((F.col("visible_count") <= 0) | (F.col("max_score") < threshold))
        .select("object_id", "point_idx")
    )


def fill_holes(scores: DataFrame, points: DataFrame, cfg: FusionConfig = FusionConfig()) -> DataFrame:
    """Scores given to unknown points by their neighbours, as (`object_id, part_idx, point_idx, fill_score, round`).

    Seeds are points with a score above 0. A round fills every candidate with enough support, all at once on the state
    before the round. The state holds one row per cell that anything was sent to: its support and sums so far, and
    the round that filled it. A round sends only the cells filled last to their neighbours, adds what arrives to the
    state and judges it, in one aggregation. `scores` is read twice: pass a stored table.
    """
    keys = [*PART, "point_idx"]
    if not cfg.hole_fill_enabled:
        return scores.sparkSession.createDataFrame([], "object_id bigint, part_idx bigint, point_idx bigint, fill_score double, round int")
    near = _open_neighbors(scores, points, cfg)
    # The lowest points of a heap of copies are neighbours of the whole heap.
    hubs = ["object_id", "neighbor_idx"]
    busy = checkpointed(hot_keys(near, hubs))
    busy = None if busy.isEmpty() else busy
    zero, nothing = F.lit(0).cast("bigint"), F.lit(None)

    def sent(sources: DataFrame, seeds: bool) -> DataFrame:
        """What `sources` send to the open cells that have them as neighbours."""
        given = sources.select("object_id", "part_idx", F.col("point_idx").alias("neighbor_idx"), "_s")
        reached = split_join(near, given, hubs, ["point_idx"], hot=busy).filter(F.array_contains("_parts", F.col("part_idx")))
        one = F.lit(1).cast("bigint")
        return reached.select(
            *keys, "_need", one.alias("_support"), F.col("_s").alias("_sum"),
            (one if seeds else zero).alias("_seeds"), (F.col("_s") if seeds else F.lit(0.0)).alias("_seed_sum"),
            nothing.cast("int").alias("round"), nothing.cast("double").alias("fill_score"),
        )

    arrivals = sent(scores.filter(is_positive()).select(*keys, F.col("score").alias("_s")), True)
    state = None
    for turn in range(1, max(cfg.hole_fill_max_iterations, 1) + 1):
        rows = arrivals if state is None else arrivals.unionByName(state.read().drop("news"))
        summed = rows.groupBy(*keys).agg(
            F.max("_need").alias("_need"), *[F.sum(c).alias(c) for c in ("_support", "_sum", "_seeds", "_seed_sum")],
            F.min("round").alias("round"), F.min("fill_score").alias("fill_score"),
        )
        news = F.col("round").isNull() & (F.col("_support") >= F.col("_need"))
        mean = F.when(F.col("_seeds") > 0, F.col("_seed_sum") / F.col("_seeds")).otherwise(F.col("_sum") / F.col("_support"))
        judged = summed.withColumn("news", news).withColumns(
            {"round": F.when(F.col("news"), F.lit(turn)).otherwise(F.col("round")), "fill_score": F.when(F.col("news"), mean).otherwise(F.col("fill_score"))}
        )
        before, state = state, Flagged(judged, "news", "fill-state")
        if before is not None:
            before.free()
        if not state.any():
            break
        arrivals = sent(state.flagged().select(*keys, F.col("fill_score").alias("_s")), False)
    return state.read().filter(F.col("round").isNotNull()).select(*keys, "fill_score", "round")


def _open_neighbors(scores: DataFrame, points: DataFrame, cfg: FusionConfig) -> DataFrame:
    """Neighbours of the unknown points that can ever be filled, stored once for all rounds.

    Each row names the `_parts` that have no score at the point (the parts of an object are few) and the support that a
    cell of it `_need`s.
    """
    neighbors = checkpointed(nearest_neighbors(points, cfg.hole_fill_knn_k), "neighbors")
    close = within_radius(neighbors, local_spacing(neighbors), cfg.hole_fill_max_distance_factor)
    listed = close.groupBy("object_id", "point_idx").agg(F.collect_list("neighbor_idx").alias("_near"))
    total = F.size("_near")
    need = F.greatest(F.lit(cfg.hole_fill_min_support_neighbors), F.ceil(total * cfg.hole_fill_min_support_ratio))
    unknown = (F.col("_visible") <= 0) | (F.col("_best") < cfg.score_threshold)
    open_points = (
        scores.groupBy("object_id", "point_idx")
        .agg(
            F.max("score").alias("_best"), F.max("visible_count").alias("_visible"),
            F.collect_set(F.when(~is_positive(), F.col("part_idx"))).alias("_parts"),
        )
        .filter(unknown & (F.size("_parts") > 0))
        .select("object_id", "point_idx", "_parts")
    )
    joined = listed.filter(total >= cfg.hole_fill_min_support_neighbors).join(open_points, ["object_id", "point_idx"])
    return checkpointed(joined.select("object_id", "point_idx", "_parts", need.alias("_need"), F.explode("_near").alias("neighbor_idx")), "open-neighbors")


def merge_fills(scores: DataFrame, fills: DataFrame) -> DataFrame:
    """Scores with fills merged by maximum; marks the filled cells."""
    joined = scores.join(fills.select(*PART, "point_idx", "fill_score"), [*PART, "point_idx"], "left")
    return joined.withColumns(
        {
            "score": F.greatest("score", F.coalesce("fill_score", F.col("score"))),
            "filled": F.col("fill_score").isNotNull(),
        }
    ).drop("fill_score")


def unknown_mask(best: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Diagnostics per point: `invisible`, `low_confidence` and their union, the unknown mask."""
    flagged = best.withColumns(
        {"invisible": F.col("visible_count") <= 0, "low_confidence": F.col("max_score") < threshold}
    )
    return flagged.withColumn("unknown", F.col("invisible") | F.col("low_confidence"))


def fuse_labels(scores: DataFrame, points: DataFrame, cfg: FusionConfig = FusionConfig()) -> DataFrame:
    """The whole fusion of part scores: prune, fill, merge, then best part, ambiguity and unknown mask per point.

    `filled_parts` lists the parts whose score a point got from its neighbours. Every point has a row: those
    of objects without parts have best part -1 and are unknown.
    """
    kept = checkpointed(keep_parts(scores, prune_duplicates(scores, cfg)))
    merged = checkpointed(merge_fills(kept, fill_holes(kept, points, cfg)))
    labels = unknown_mask(add_pointless_objects(points, ambiguity(merged)), cfg.score_threshold)
    before = initial_unknown(kept, cfg.score_threshold).withColumn("initial_unknown", F.lit(True))
    healed = merged.groupBy("object_id", "point_idx").agg(
        F.bool_or("filled").alias("filled"), F.array_sort(F.collect_list(F.when(F.col("filled"), F.col("part_idx")))).alias("filled_parts")
    )
    return (
        labels.join(healed, ["object_id", "point_idx"], "left")
        .join(before, ["object_id", "point_idx"], "left")
        .withColumns(
            {
                "filled": F.coalesce("filled", F.lit(False)),
                "filled_parts": F.coalesce("filled_parts", F.expr("CAST(array() AS array<bigint>)")),
                "ambiguous": F.coalesce("ambiguous", F.lit(False)),
                "invisible": F.coalesce("invisible", F.lit(False)),
                # A point of an object without parts has no score and is unknown from the start.
                "initial_unknown": F.coalesce("initial_unknown", F.col("best_part") < 0),
            }
        )
    )


def membership_summary(scores: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Part names, score shape and unknown points per object of a membership table taken over unchanged.

    A missing visible count reads as 1. The list of part names is as long as an object has parts.
    """
    counted = scores.withColumn("visible_count", F.coalesce("visible_count", F.lit(1)))
    parts = (
        counted.groupBy("object_id", "part_idx", "part_name")
        .agg(F.count(F.lit(1)).alias("_points"))
        .groupBy("object_id")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("part_idx", "part_name"))), lambda p: p["part_name"]), ","
            ).alias("part_names"),
            F.count(F.lit(1)).alias("num_parts"),
            F.max("_points").alias("num_points"),
        )
    )
    unknown = unknown_mask(best_part(counted), threshold).groupBy("object_id").agg(F.count_if("unknown").alias("num_unknown"))
    return parts.join(unknown, "object_id")
