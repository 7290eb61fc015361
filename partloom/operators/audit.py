"""Checks before a release: paths, secrets, sizes, required files, portable manifests, cache settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from partloom import fixed_values as fixed
from partloom.functions.names import suffix


def _any_segment(path: Column, banned: Sequence[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(b) for b in banned]))


def file_inventory(listing: DataFrame, ignored: Sequence[str] = fixed.IGNORED_DIRS) -> DataFrame:
    """Path, size and suffix of every file outside the ignored folders."""
    kept = listing.filter(~_any_segment(F.col("path"), ignored))
    return kept.withColumn("suffix", suffix(F.col("path")))


def release_audit(files: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """One (`path`, `violation`) row per broken rule.

    `files` needs `path`, `size`, `content` (null when the bytes are not UTF-8). `required` lists paths of files
    or folders that must exist. Text rules apply to text suffixes only. Where there is a column `is_link`, a
    link is a violation and nothing else of it is looked at.
    """
    linked = F.coalesce("is_link", F.lit(False)) if "is_link" in files.columns else F.lit(False)
    inventory = file_inventory(files)
    is_text = F.col("suffix").isin(*fixed.TEXT_SUFFIXES)
    content = F.coalesce("content", F.lit(""))
    broken = F.filter(
        F.array(
            F.when(_any_segment(F.col("path"), fixed.FORBIDDEN_DIRS), F.lit("generated directory is not allowed")),
            F.when(F.col("suffix").isin(*fixed.FORBIDDEN_SUFFIXES), F.lit("binary model or secret file is not allowed")),
            F.when(F.col("size") > fixed.MAX_FILE_BYTES, F.lit("file exceeds 10 MiB")),
            F.when(is_text & F.col("content").isNull(), F.lit("expected UTF-8 text file")),
            F.when(is_text & content.rlike(fixed.MACHINE_PATH_PATTERN), F.lit("machine-specific absolute path found")),
            F.when(is_text & content.rlike(fixed.SECRET_PATTERN), F.lit("possible embedded secret found")),
        ),
        lambda v: v.isNotNull(),
    )
    judged = F.when(linked, F.array(F.lit("symbolic link is not allowed"))).otherwise(broken)
    found = inventory.select("path", F.explode(judged).alias("violation"))
    if required is None:
        return found
    missing = required.join(existing_paths(files), "path", "left_anti")
    return found.unionByName(missing.select("path", F.lit("missing required path").alias("violation")))


def existing_paths(files: DataFrame) -> DataFrame:
    """All files and the folders above them."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.select(F.explode(above).alias("path")).distinct()


def metadata_audit(files: DataFrame, names: Sequence[str] = fixed.RELEASE_METADATA, strict: bool = False) -> DataFrame:
    """One row (`level`, `message`) if metadata files are missing at the top: an error if `strict`, else a warning."""
    here = files.filter(F.col("path").isin(*names)).agg(F.collect_set("path").alias("_here"))
    missing = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: ~F.array_contains("_here", n))
    message = F.concat(F.lit("missing publication metadata: "), F.array_join(missing, ", "))
    return here.filter(F.size(missing) > 0).select(F.lit("error" if strict else "warning").alias("level"), message.alias("message"))


def release_report(files: DataFrame, required: DataFrame | None = None, *, strict: bool = False) -> DataFrame:
    """All rules of a release in one report: (`level`, `message`).

    Broken row rules are errors. The rule on the whole release, that its metadata is there, is an error if `strict`
    and else a warning.
    """
    rows = release_audit(files, required).select(F.lit("error").alias("level"), F.concat("violation", F.lit(": "), "path").alias("message"))
    return rows.unionByName(metadata_audit(files, strict=strict))


def manifest_audit(rows: DataFrame, path_columns: Sequence[str], content: str | None = None) -> DataFrame:
    """Adds `absolute_paths` (how many path columns start with `/`) and the SHA-256 of the row's content."""
    absolute = sum((F.coalesce(F.col(c).startswith("/"), F.lit(False)).cast("int") for c in path_columns), F.lit(0))
    checked = rows.withColumn("absolute_paths", absolute)
    return checked if content is None else checked.withColumn("sha256", F.sha2(F.col(content), 256))


def cache_config_check(configs: DataFrame, hidden_size: int, num_views: int, grid_size: int) -> DataFrame:
    """Mismatch texts per cache configuration; an absent key matches, and so does an absent configuration."""
    tokens = num_views * grid_size * grid_size

    def differs(column: str, expected: int, label: str) -> Column:
        shown = F.concat(F.lit(f"{column}="), F.col(column).cast("string"), F.lit(f" != {label}={expected}"))
        return F.when(F.coalesce(column, F.lit(expected)) != expected, shown)

    found = F.filter(
        F.array(
            differs("hidden_size", hidden_size, "vlm_hidden_size"),
            differs("num_views", num_views, "num_views"),
            differs("total_visual_tokens", tokens, "num_views*grid_size^2"),
        ),
        lambda m: m.isNotNull(),
    )
    return configs.withColumn("mismatches", found)
