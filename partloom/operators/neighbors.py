"""Exact nearest neighbours inside objects of any size and density.

The places of an object are cut into cells by count: a cell with more than `LEAF` places is parted at the octiles
of one axis, the axes in turn, until every cell holds few. Cells thus follow the crowd however far the points
spread. A place looks first among its own cell, which bounds how far its k nearest can be; it then visits only those
other cells that come nearer than that bound. They are found by going down the tree of cells with one bound per
cell. Points at one place share their neighbours (ties go to the lower index), so a heap of copies is searched
once, and only its lowest indices can be neighbours of anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.functions.numeric import size_bucket
from partloom.operators.ordered import exact_median
from partloom.operators.skew import split_join
from partloom.session import Rounds, broadcast_if_small, checkpointed

PLACE = ["object_id", "x", "y", "z"]
CELL = ["object_id", "cell"]
LEAF = 256  # most places of a cell that is not cut further
CUTS = 7
BLOCK = 16  # places that one row looks up in their own cell
MARGIN = 1 + 1e-9  # a hair for rounding
BOX = [f"{end}{a}" for a in "xyz" for end in ("lo", "hi")]


def _boxed(places: DataFrame) -> DataFrame:
    """Number of places and their bounding box per cell."""
    ends = [f(a).alias(f"{end}{a}") for a in "xyz" for end, f in (("lo", F.min), ("hi", F.max))]
    return places.groupBy(*CELL).agg(F.count(F.lit(1)).alias("places"), *ends)


def count_split(places: DataFrame, kind: str, leaf: int = LEAF) -> tuple[DataFrame, Rounds, int]:
    """Places with their `cell`, the table of all cells by depth (`turn`), and its depth.

    A cell is named by the digits of the way to it; the whole object is the cell with no digits. `places` are
    distinct (`object_id, x, y, z`, the id of type `kind`), so some axis always parts a crowd. Only crowded cells are
    read and written again at the next depth.
    """
    spark = places.sparkSession
    columns = f"object_id {kind}, x double, y double, z double, cell string"
    settled = Rounds(spark, "places", columns)
    tree = Rounds(spark, "cells", f"object_id {kind}, cell string, places bigint, " + ", ".join(f"{c} double" for c in BOX))
    active, depth = places.select(*PLACE, F.lit("").alias("cell")), 0
    while True:
        nodes = tree.add(_boxed(active), depth)
        crowded = nodes.filter(F.col("places") > leaf)
        if crowded.isEmpty():
            settled.add(active, depth)
            return settled.read().drop("turn"), tree, depth
        crowded = broadcast_if_small(crowded.select(*CELL))
        settled.add(active.join(crowded, CELL, "left_anti"), depth)
        busy = active.join(crowded, CELL, "left_semi")
        axis = "xyz"[depth % 3]
        octiles = F.percentile_approx(axis, F.array(*[F.lit(i / (CUTS + 1)) for i in range(1, CUTS + 1)]), F.lit(1000))
        # Where one value holds all octiles, the least value of the axis is a cut too.
        cuts = busy.groupBy(*CELL).agg(F.array_distinct(octiles).alias("_cuts"), F.min(axis).alias("_least"))
        cuts = cuts.select(*CELL, F.when(F.size("_cuts") > 1, F.col("_cuts")).otherwise(F.array_append("_cuts", F.col("_least"))).alias("_cuts"))
        digit = F.size(F.filter("_cuts", lambda c: c < F.col(axis))).cast("string")
        cut = busy.join(broadcast_if_small(cuts), CELL).withColumn("cell", F.concat("cell", digit))
        depth += 1
        active = checkpointed(cut.select(*PLACE, "cell"), "places-active")


def _nearest(x: Column, y: Column, z: Column, places: Column, wanted: int, bound: Column | None = None) -> Column:
    """The `wanted` nearest points at an array of places, as (`distance, neighbor_idx`), ties by index.

    With `bound` only places no farther than that are sorted. A place among whose points is one of the nearest is itself
    one of the `wanted` first places by distance and lowest index, so only their points are sorted.
    """

    def hit(p: Column) -> Column:
        dx, dy, dz = x - p["x"], y - p["y"], z - p["z"]
        return F.struct(F.sqrt(dx * dx + dy * dy + dz * dz).alias("distance"), p["ids"].alias("ids"))

    hits = F.transform(places, hit)
    if bound is not None:
        hits = F.filter(hits, lambda h: h["distance"] <= bound)
    first = F.slice(F.sort_array(hits), 1, wanted)

    def each(h: Column) -> Column:
        return F.transform(h["ids"], lambda i: F.struct(h["distance"].alias("distance"), i.alias("neighbor_idx")))

    return F.slice(F.sort_array(F.flatten(F.transform(first, each))), 1, wanted)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of little size and much work in as many tasks as a shuffle has; by their bytes they would be one or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _box_distance(axes: dict[str, tuple[Column, Column]], prefix: str = "") -> Column:
    """Distance from a box (`low, high` per axis; a point if they agree) to the box of a cell."""
    gaps = []
    for a, (low, high) in axes.items():
        gap = F.greatest(F.col(f"{prefix}lo{a}") - high, low - F.col(f"{prefix}hi{a}"), F.lit(0.0))
        gaps.append(gap * gap)
    return F.sqrt(gaps[0] + gaps[1] + gaps[2])


def _reached(asking: DataFrame, tree: DataFrame, depth: int, leaves: DataFrame) -> DataFrame:
    """For each asking cell (box and `reach`) the other leaf cells of its object that come within `reach`."""
    own = {a: (F.col(f"_lo{a}"), F.col(f"_hi{a}")) for a in "xyz"}
    start = asking.select("object_id", F.col("cell").alias("asker"), "reach", *[F.col(c).alias(f"_{c}") for c in BOX])
    found, open_pairs = None, start.withColumn("cell", F.lit(""))
    for d in range(1, depth + 1):
        below = tree.filter(F.col("turn") == d).select("object_id", F.expr("left(cell, length(cell) - 1)").alias("_above"), "cell", *BOX)
        pairs = open_pairs.withColumnRenamed("cell", "_above").join(below, ["object_id", "_above"])
        near = checkpointed(pairs.filter(_box_distance(own) <= F.col("reach") * MARGIN).select(*open_pairs.columns), "reached")
        hits = near.join(leaves, CELL, "left_semi").filter(F.col("cell") != F.col("asker")).select("object_id", "asker", "cell")
        found = hits if found is None else found.unionAll(hits)
        open_pairs = near
    return found


def nearest_neighbors(points: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """The `k` nearest points of each point's object, as (`object_id, point_idx, rank, neighbor_idx, distance`).

    `k` + 1 points are looked up and the first is dropped as the point itself, even if a copy of it with a
    lower index stands there. Smaller objects give as many neighbours as they have. Points with a coordinate that is
    null, NaN or infinite have no neighbours and are none.
    """
    wanted, leaf = k + 1, max(leaf, k + 1)
    kind = points.select("object_id").schema[0].dataType.simpleString()
    finite = F.lit(True)
    for a in "xyz":
        finite = finite & (F.abs(a) < float("inf"))
    base = points.select("object_id", *[F.col(a).cast("double").alias(a) for a in "xyz"], "point_idx").filter(finite)
    first = Window.partitionBy(*PLACE).orderBy("point_idx")
    lowest = base.withColumn("_copy", F.row_number().over(first)).filter(F.col("_copy") <= wanted)
    members = checkpointed(lowest.groupBy(*PLACE).agg(F.sort_array(F.collect_list("point_idx")).alias("ids")), "members")
    placed, tree, depth = count_split(members.select(*PLACE), kind, leaf)
    if depth:
        members = members.join(placed, PLACE)
    else:
        members = members.withColumn("cell", F.lit(""))
    # A cell holds at most `leaf` places, each with the indices of at most `k` + 1 copies.
    cells = members.groupBy(*CELL).agg(F.collect_list(F.struct("x", "y", "z", "ids")).alias("_places"))
    if depth:
        cells = checkpointed(cells, "cell-members")
    starts = F.sequence(F.lit(1), F.size("_places"), F.lit(BLOCK))
    blocks = _spread(cells.select(*CELL, "_places", F.explode(starts).alias("_start")), *CELL, "_start")
    asked = blocks.select(*CELL, "_places", F.explode(F.slice("_places", F.col("_start"), F.lit(BLOCK))).alias("_p")).select(
        *CELL, "_p.x", "_p.y", "_p.z", _nearest(F.col("_p.x"), F.col("_p.y"), F.col("_p.z"), F.col("_places"), wanted).alias("_hits")
    )
    asked = checkpointed(asked, "own-cell")
    if depth:
        asked = checkpointed(_with_other_cells(asked, cells, tree.read(), depth, wanted, leaf), "nearest")
    done = asked.select(*PLACE, F.posexplode("_hits").alias("rank", "_h")).filter(F.col("rank") > 0)
    done = done.select(*PLACE, "rank", "_h.neighbor_idx", "_h.distance")
    return split_join(base, done, PLACE, ["point_idx"]).select("object_id", "point_idx", "rank", "neighbor_idx", "distance")


def _with_other_cells(asked: DataFrame, cells: DataFrame, tree: DataFrame, depth: int, wanted: int, leaf: int) -> DataFrame:
    """Hits of places in their own cells, merged with those in the other cells that are near enough to matter.

    A cell with fewer members than wanted tells no bound; the nearest cell above it that holds enough places does:
    all of these lie within its farthest corner.
    """
    leaves = tree.filter(F.col("places") <= leaf).select(*CELL, *BOX)
    full = tree.filter((F.col("places") >= wanted) | (F.col("cell") == ""))
    above = leaves.select(*CELL, F.explode(F.sequence(F.lit(0), F.length("cell"))).alias("_n"))
    above = above.select(*CELL, F.expr("left(cell, _n)").alias("_up"))
    named = full.select("object_id", F.col("cell").alias("_up"), F.struct(F.length("cell").alias("_n"), *BOX).alias("_box"))
    cover = above.join(named, ["object_id", "_up"]).groupBy(*CELL).agg(F.max("_box").alias("_box")).select(*CELL, *[F.col(f"_box.{c}").alias(c) for c in BOX])
    corner = F.lit(0.0)
    for a in "xyz":
        far = F.greatest(F.abs(F.col(a) - F.col(f"lo{a}")), F.abs(F.col(a) - F.col(f"hi{a}")))
        corner = corner + far * far
    known = F.when(F.size("_hits") >= wanted, F.element_at("_hits", -1)["distance"])
    bounded = asked.join(cover, CELL).withColumn("_bound", F.least(known, F.sqrt(corner) * MARGIN)).drop(*BOX)
    bounded = checkpointed(bounded, "bounds")
    reach = bounded.groupBy(*CELL).agg(F.max("_bound").alias("reach")).join(leaves, CELL)
    pairs = _reached(reach, tree, depth, leaves.select(*CELL))
    visits = bounded.withColumnRenamed("cell", "asker").join(pairs, ["object_id", "asker"]).join(leaves, CELL)
    near = _box_distance({a: (F.col(a), F.col(a)) for a in "xyz"}) <= F.col("_bound") * MARGIN
    visits = _spread(visits.filter(near).select(*PLACE, "cell", "_bound"), *PLACE)
    # One row per place met, so that most of them go by their distance alone, before anything is gathered or sorted.
    met = visits.join(cells.select(*CELL, "_places"), CELL).select(*PLACE, "_bound", F.inline("_places").alias("_x", "_y", "_z", "ids"))
    dx, dy, dz = F.col("x") - F.col("_x"), F.col("y") - F.col("_y"), F.col("z") - F.col("_z")
    hits = met.select(*PLACE, F.sqrt(dx * dx + dy * dy + dz * dz).alias("distance"), "ids", "_bound")
    hits = hits.filter(F.col("distance") <= F.col("_bound") * MARGIN).drop("_bound")
    # Its nearest places hold its nearest points (see `_nearest`); a bound may let in any number of others.
    order = Window.partitionBy(*PLACE).orderBy("distance", "ids")
    first = hits.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= wanted)
    each = F.transform("ids", lambda i: F.struct(F.col("distance"), i.alias("neighbor_idx")))
    more = first.groupBy(*PLACE).agg(F.flatten(F.collect_list(each)).alias("_more"))
    both = bounded.select(*PLACE, "_hits").join(more, PLACE, "left")
    every = F.when(F.col("_more").isNull(), F.col("_hits")).otherwise(F.concat("_hits", "_more"))
    return both.select(*PLACE, F.slice(F.sort_array(every), 1, wanted).alias("_hits"))


def local_spacing(neighbors: DataFrame) -> DataFrame:
    """Median distance to the nearest neighbour per object; objects with none, or a spacing of 0, drop out."""
    nearest = neighbors.filter(F.col("rank") == 1)
    spacing = exact_median(nearest, ["object_id"], "distance", size_bucket(F.col("distance")), "local_spacing")
    valid = ~F.isnan("local_spacing") & (F.col("local_spacing") > 0) & (F.col("local_spacing") < float("inf"))
    return spacing.filter(valid)


def within_radius(neighbors: DataFrame, spacing: DataFrame, factor: float = 7.0) -> DataFrame:
    """Neighbours no farther than `factor` local spacings."""
    spaced = split_join(neighbors, spacing, ["object_id"], ["point_idx"])
    return spaced.filter(F.col("distance") <= F.col("local_spacing") * factor)
