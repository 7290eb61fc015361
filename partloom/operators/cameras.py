"""Camera tables: poses, rotations, standard views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from partloom.config import LiftConfig, RenderConfig
from partloom.functions.numeric import floored_ratio

Vector = tuple[Column, Column, Column]


def _dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cols(prefix: str) -> Vector:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def _vector(prefix: str, parts: Sequence[Column]) -> dict[str, Column]:
    return dict(zip((f"{prefix}x", f"{prefix}y", f"{prefix}z"), parts))


def look_at(views: DataFrame) -> DataFrame:
    """Pose of each view that looks at the origin with +Z up.

    Adds the rows of the rotation (`r` right, `d` down, `f` forward), the translation `t` and the focal
    length in frame widths; the principal point is the frame centre.
    """
    yaw, pitch = F.radians("yaw_deg"), F.radians("pitch_deg")
    placed = views.withColumns(
        _vector(
            "e",
            (
                F.sin(yaw) * F.cos(pitch) * F.col("radius"),
                F.cos(yaw) * F.cos(pitch) * F.col("radius"),
                F.sin(pitch) * F.col("radius"),
            ),
        )
    ).withColumn("focal", 0.5 / F.tan(F.radians("fov_deg") * 0.5))
    eye = _cols("e")
    distance = F.sqrt(_dot(eye, eye))
    aimed = placed.withColumns(_vector("f", [floored_ratio(-c, distance, 1e-6) for c in eye]))
    fx, fy, fz = _cols("f")
    flat = F.sqrt(fx * fx + fy * fy)
    sided = aimed.withColumns(
        _vector("r", (floored_ratio(fy, flat, 1e-6), floored_ratio(-fx, flat, 1e-6), F.lit(0.0)))
    )
    rx, ry, rz = _cols("r")
    posed = sided.withColumns(_vector("d", (fy * rz - fz * ry, fz * rx - fx * rz, fx * ry - fy * rx)))
    return posed.withColumns(_vector("t", [-_dot(_cols(axis), eye) for axis in "rdf"]))


def camera_matrices(cameras: DataFrame) -> DataFrame:
    """4 x 4 extrinsics and normalised 3 x 3 intrinsics of posed cameras."""
    zero, one, half = F.lit(0.0), F.lit(1.0), F.lit(0.5)
    rows = [F.array(*_cols(axis), F.col(t)) for axis, t in (("r", "tx"), ("d", "ty"), ("f", "tz"))]
    focal = F.col("focal")
    return cameras.withColumns(
        {
            "extrinsics": F.array(*rows, F.array(zero, zero, zero, one)),
            "intrinsics": F.array(
                F.array(focal, zero, half), F.array(zero, focal, half), F.array(zero, zero, one)
            ),
        }
    )


def pre_rotation(targets: DataFrame) -> DataFrame:
    """Rotation that turns +Z to the direction (`tx`, `ty`, `tz`), as nine columns `m00` … `m22`."""
    norm = F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty") + F.col("tz") * F.col("tz"))
    checked = F.when(norm <= 1e-6, F.raise_error(F.lit("rotation target vector must be non-zero"))).otherwise(norm)
    unit = targets.withColumn("_n", checked).withColumns(
        {f"_{a}": F.col(f"t{a}") / F.col("_n") for a in "xyz"}
    )
    # The turning axis is Z x target = (-y, x, 0).
    ax, ay = -F.col("_y"), F.col("_x")
    sine2 = ax * ax + ay * ay
    parallel = F.sqrt(sine2) <= 1e-6
    cosine = F.greatest(F.least(F.col("_z"), F.lit(1.0)), F.lit(-1.0))
    bend = (1 - cosine) / F.when(parallel, F.lit(1.0)).otherwise(sine2)
    flip = F.when(cosine < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    general = (
        (1 - bend * ay * ay, bend * ax * ay, ay),
        (bend * ax * ay, 1 - bend * ax * ax, -ax),
        (-ay, ax, 1 - bend * sine2),
    )
    straight = ((F.lit(1.0), F.lit(0.0), F.lit(0.0)), (F.lit(0.0), flip, F.lit(0.0)), (F.lit(0.0), F.lit(0.0), flip))
    entries = {
        f"m{i}{j}": F.when(parallel, straight[i][j]).otherwise(general[i][j]) for i in range(3) for j in range(3)
    }
    return unit.withColumns(entries).drop("_n", "_x", "_y", "_z")


def standard_views(objects: DataFrame, cfg: RenderConfig = RenderConfig()) -> DataFrame:
    """Every object with the first `num_views` standard views, exploded from one constant array."""
    if not len(cfg.view_names) == len(cfg.yaws_deg) == len(cfg.pitches_deg):
        raise ValueError("standard view names, yaws, and pitches must have the same length")
    if cfg.num_views > len(cfg.view_names):
        raise ValueError("num_views exceeds configured standard view definitions")
    specs = F.array(
        *[
            F.struct(
                F.lit(f"view_{i:03d}").alias("view_id"),
                F.lit(name).alias("canonical_view"),
                F.lit(float(yaw)).alias("yaw_deg"),
                F.lit(float(pitch)).alias("pitch_deg"),
            )
            for i, (name, yaw, pitch) in enumerate(
                list(zip(cfg.view_names, cfg.yaws_deg, cfg.pitches_deg))[: cfg.num_views]
            )
        ]
    )
    return objects.withColumn("_v", F.explode(specs)).select(
        *objects.columns,
        "_v.*",
        F.lit(cfg.radius).alias("radius"),
        F.lit(cfg.fov_deg).alias("fov_deg"),
        F.lit(cfg.resolution).alias("resolution"),
        F.concat(F.lit("render/"), F.col("_v.view_id"), F.lit(".png")).alias("image_path"),
    )


def default_camera(
    source_views: DataFrame, *, order: str, objects: DataFrame | None = None, cfg: LiftConfig = LiftConfig()
) -> DataFrame:
    """Visualisation camera per object: mean radius and field of view, resolution of the first view.

    Configured values win. With `objects`, those without any source view get the defaults.
    """
    # What an absent field, or an object without views, reads as.
    absent = {"radius": 2.0, "fov_deg": 40.0, "resolution": 512}
    found = source_views.groupBy("object_id").agg(
        F.avg(F.coalesce("radius", F.lit(absent["radius"]))).alias("radius"),
        F.avg(F.coalesce("fov_deg", F.lit(absent["fov_deg"]))).alias("fov_deg"),
        F.min_by(F.coalesce("resolution", F.lit(absent["resolution"])), F.col(order)).alias("resolution"),
    )
    if objects is not None:
        found = objects.select("object_id").distinct().join(found, "object_id", "left")
    set_values = {
        "radius": cfg.visualization_radius,
        "fov_deg": cfg.visualization_fov_deg,
        "resolution": cfg.visualization_resolution,
    }
    return found.withColumns(
        {n: F.coalesce(n, F.lit(absent[n])) if v is None else F.lit(v) for n, v in set_values.items()}
    )


def visibility_views(defaults: DataFrame, cfg: LiftConfig = LiftConfig()) -> DataFrame:
    """The views in which visibility is drawn, with each object's default camera."""
    if len(cfg.visualization_yaws_deg) != len(cfg.visualization_pitches_deg):
        raise ValueError("visualization_yaws_deg and visualization_pitches_deg must have the same length")
    angles = zip(cfg.visualization_yaws_deg, cfg.visualization_pitches_deg)
    specs = F.array(
        *[
            F.struct(
                F.lit(f"view_{i:03d}").alias("view_id"), F.lit(float(y)).alias("yaw_deg"), F.lit(float(p)).alias("pitch_deg")
            )
            for i, (y, p) in enumerate(angles)
        ]
    )
    return defaults.withColumn("_v", F.explode(specs)).select(*defaults.columns, "_v.*")
