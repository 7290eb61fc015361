"""JSON sources: annotation documents, manifests, per-object sidecar files, file listings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from partloom.session import scratch_path
from partloom.sources import schemas
from partloom.sources.commits import CommitStore


@dataclass(frozen=True)
class Annotations:
    annotations: DataFrame
    categories: DataFrame
    images: DataFrame


def typed_segmentation(value: Column) -> Column:
    """A segmentation of either kind (VARIANT) as one struct: `polygons`, `run_lengths` or `none` by its `kind`.

    Run lengths are a list of counts or an encoded text. Polygons that are no lists of numbers read as null, and what
    is neither a list nor a record is `none`.
    """

    def at(path: str, kind: str) -> Column:
        return F.try_variant_get(value, path, kind)

    parts, record, counts = at("$", "array<variant>"), at("$", "map<string,variant>"), at("$.counts", "array<bigint>")
    first = F.try_variant_get(F.get(parts, F.lit(0)), "$", "array<variant>")
    kind = F.when(parts.isNotNull(), "polygons").when(record.isNotNull(), "run_lengths").otherwise("none")
    return F.struct(
        kind.alias("kind"),
        F.when(parts.isNotNull(), F.size(parts)).otherwise(0).cast("bigint").alias("num_polygons"),
        at("$", "array<array<double>>").alias("polygons"),
        F.when(first.isNotNull(), F.size(first)).otherwise(0).cast("bigint").alias("first_polygon_len"),
        counts.alias("counts"),
        F.when(counts.isNull(), at("$.counts", "string")).alias("encoded_counts"),
        at("$.size", "array<bigint>").alias("size"),
    ).cast(schemas.SEGMENTATION)


def scan_annotations(spark: SparkSession, path: str, *, one_document: bool = True, identifier: str = "bigint") -> Annotations:
    """Three tables of an annotation document; missing arrays read as empty.

    The documents are read once, into one stored table of tagged records; each of the three tables reads its own
    columns of it. `identifier` is the type of annotation ids. A single document cannot be split, so its scan is one task.
    Data of any size comes as many documents, one per line (`one_document=False`), in which an image or a category
    may be repeated.
    """
    read = schemas.annotation(identifier, "variant")
    document = f"images array<{schemas.IMAGE}>, categories array<{schemas.CATEGORY}>, annotations array<{read}>"
    docs = spark.read.schema(document).option("multiLine", one_document).json(path)
    kinds = {"image": schemas.IMAGE, "category": schemas.CATEGORY, "annotation": schemas.annotation(identifier, schemas.SEGMENTATION)}

    def tagged(kind: str, array: str, value: Callable[[Column], Column] = lambda r: r) -> Column:
        def record(r: Column) -> Column:
            own = [(value(r) if k == kind else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]
            return F.struct(F.lit(kind).alias("kind"), *own)

        return F.transform(F.coalesce(array, F.array()), record)

    def typed(r: Column) -> Column:
        fields = ("id", "image_id", "category_id", "bbox", "area")
        return F.struct(*[r[f].alias(f) for f in fields], typed_segmentation(r["segmentation"]).alias("segmentation"))

    every = F.concat(tagged("image", "images"), tagged("category", "categories"), tagged("annotation", "annotations", typed))
    stored = scratch_path(spark, "annotations-tagged")
    # Folders by kind would have every task sort its records, segmentations and all.
    docs.select(F.inline(every)).write.parquet(stored, compression="zstd")
    columns = ", ".join(f"{k} {t}" for k, t in kinds.items())
    records = spark.read.schema(f"{columns}, kind string").parquet(stored)

    def rows(kind: str) -> DataFrame:
        return records.filter(F.col("kind") == kind).select(f"{kind}.*")

    boxed = rows("annotation").select(
        F.col("id").alias("annotation_id"),
        "image_id",
        "category_id",
        *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x", "y", "w", "h"))],
        F.coalesce("area", F.lit(0.0)).alias("area"),
        "segmentation",
    )
    return Annotations(boxed, rows("category").dropDuplicates(["id"]), rows("image").dropDuplicates(["id"]))


def save_annotations(tables: Annotations, root: str) -> None:
    for name in ("annotations", "categories", "images"):
        getattr(tables, name).write.mode("errorifexists").parquet(f"{root}/{name}")


def scan_manifest(spark: SparkSession, path: str, row_schema: str = schemas.MANIFEST_ROW, *, one_document: bool = True) -> DataFrame:
    """Rows of manifests. `rows` that is there but is no list is an error; absent `rows` read as empty."""
    docs = spark.read.schema("rows string").option("multiLine", one_document).json(path)
    listed = F.startswith(F.ltrim("rows"), F.lit("["))
    checked = F.when(
        F.col("rows").isNotNull() & ~listed, F.raise_error(F.lit("manifest lacks a rows list"))
    ).otherwise(F.col("rows"))
    return docs.select(F.explode(F.from_json(checked, f"array<{row_schema}>")).alias("_r")).select("_r.*")


def scan_sidecars(spark: SparkSession, glob: str, schema: str, packs: str | None = None) -> DataFrame:
    """Per-object JSON files; `object_id` is the name of the folder the file (or its stage folder) is in.

    `packs` is a folder of packs, whose lines carry the path of each text; they are read beside the files of `glob`,
    of which there may then be none.
    """
    if packs is None:
        texts = sidecar_files(spark, glob)
    else:
        texts = sidecar_packs(spark, packs)
        if any_file(spark, glob):
            texts = sidecar_files(spark, glob).unionByName(texts)
    return texts.select("object_id", F.from_json("doc", schema).alias("doc"))


def any_file(spark: SparkSession, glob: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def sidecar_files(spark: SparkSession, glob: str) -> DataFrame:
    texts = spark.read.format("text").option("wholetext", True).load(glob)
    return texts.select(
        object_folder(F.col("_metadata.file_path")).alias("object_id"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("doc"),
    )


def sidecar_packs(spark: SparkSession, *paths: str) -> DataFrame:
    """Texts of packs. Their `path` is that of the pack, `#/`, and the path inside it; a pack is as old as its file."""
    inside = F.concat(F.col("_metadata.file_path"), F.lit("#/"), F.col("path"))
    return spark.read.schema("path string, doc string").json(list(paths)).select(
        object_folder(inside).alias("object_id"), inside.alias("path"), F.col("_metadata.file_modification_time").alias("modified"),
        F.octet_length("doc").cast("bigint").alias("size"), "doc",
    )


def object_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"/(?:object=)?([^/=]+)/(?:stage=)?(?:source|prompt|render|seg2d|project3d|label3d)/[^/]+$", 1)


SIDECAR = "object_id string, path string, modified timestamp, size bigint, doc string"


def compact_sidecars(spark: SparkSession, glob: str, store: CommitStore, kind: str, commit: str, packs: str | None = None) -> bool:
    """Gathers per-object files into bucketed records, one table per kind, with the files they come from.

    Files that the store holds with the same time and size are left out, so a later run takes what is new or changed;
    False if there is nothing. The listing alone decides that; texts are read only of what is taken. `packs` is a
    folder of packs, taken likewise: a pack that the store holds is not opened.
    """
    key = ["path", "modified", "size"]
    known = store.read(kind, SIDECAR).select(*key)
    rows = []
    if packs is None or any_file(spark, glob):
        listed = spark.read.format("binaryFile").load(glob).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
        if not listed.join(known, key, "left_anti").isEmpty():
            rows.append(sidecar_files(spark, glob).join(known, key, "left_anti"))
    if packs is not None:
        opened = known.select(F.substring_index("path", "#/", 1).alias("path"), "modified").distinct()
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json*").load(packs)
        files = files.select("path", F.col("modificationTime").alias("modified")).join(opened, ["path", "modified"], "left_anti")
        # A pack holds what one task wrote, so their names are few.
        fresh = [r["path"] for r in files.select("path").collect()]
        if fresh:
            rows.append(sidecar_packs(spark, *fresh).join(known, key, "left_anti"))
    if not rows:
        return False
    taken = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    return store.commit(commit, {kind: taken.select("object_id", "path", "modified", "size", "doc")}, bucket_by="object_id")


def read_sidecars(store: CommitStore, kind: str, schema: str) -> DataFrame:
    """`(object_id, doc, num_versions)`: the latest record of each object, parsed, and how many files it had."""
    latest = F.max_by("doc", F.struct("modified", "path")).alias("_doc")
    rows = store.read(kind, SIDECAR).groupBy("object_id").agg(latest, F.count(F.lit(1)).alias("num_versions"))
    return rows.select("object_id", F.from_json("_doc", schema).alias("doc"), "num_versions")


def exploded(docs: DataFrame, array: str, pos: str) -> DataFrame:
    """One row per entry of a nested list, with its position."""
    return docs.select("object_id", "doc", F.posexplode(f"doc.{array}").alias(pos, "_e")).select("object_id", "doc", pos, "_e.*")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths below `root` and sizes, without reading any content."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    )
    return listed.withColumn("path", relative_to(F.col("path"), root))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Like `list_files`, with the text of each file: null where the bytes are not UTF-8."""
    loaded = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return loaded.select(
        relative_to(F.col("path"), root).alias("path"),
        F.col("length").alias("size"),
        F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("content"),
    )


def relative_to(path: Column, root: str) -> Column:
    plain = F.regexp_replace(path, "^[a-z0-9]+:/*", "/")
    base = "/" + root.split("://")[-1].removeprefix("file:").strip("/") + "/"
    return F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 1 << 30)).otherwise(plain)
