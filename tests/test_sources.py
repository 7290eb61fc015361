import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from partloom.config import RetryConfig
from partloom.operators import audit, inference, packaging, pseudo
from partloom.plans import REGISTRY, sources
from partloom.sources import documents, schemas, writers
from partloom.sources.commits import CommitStore
from partloom.streaming import progress


def test_one_annotation_document(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "coco_url": "http://h/1.jpg", "width": 4, "height": 3, "extra": 0}],
        "annotations": [
            {"id": 5, "image_id": 1, "category_id": 2, "bbox": [0, 1, 2, 3], "segmentation": [[0, 0, 1, 1]]},
            {"id": 6, "image_id": 1, "category_id": 2, "bbox": [], "area": 2.5},
        ],
    }
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    read = documents.scan_annotations(spark, str(tmp_path / "a.json"))
    rows = {r["annotation_id"]: r for r in read.annotations.collect()}
    assert rows[5]["w"] == 2.0 and rows[5]["area"] == 0.0 and rows[6]["x"] is None and rows[6]["area"] == 2.5
    assert read.categories.count() == 0 and read.images.count() == 1
    documents.save_annotations(read, str(tmp_path / "saved"))
    assert spark.read.parquet(str(tmp_path / "saved" / "annotations")).count() == 2


def test_segmentations_of_every_kind(spark, tmp_path):
    values = {
        1: [[0, 0, 4, 0.5, 4, 4], [1, 1, 2, 2]], 2: {"counts": [3, 4, 5], "size": [2, 6]}, 3: {"counts": "abc", "size": [2, 6]},
        4: None, 5: [], 6: "text", 7: [1, 2, 3], 8: [[]], 9: {"size": [1, 1]},
    }
    rows = [{"id": i, "image_id": 1, "category_id": 2, "segmentation": v} for i, v in values.items()] + [{"id": 10, "image_id": 1, "category_id": 2}]
    docs = [{"annotations": rows[:4], "images": [{"id": 1}], "categories": [{"id": 2, "name": "c"}]}, {"annotations": rows[4:], "images": [{"id": 1}]}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, docs)))
    read = documents.scan_annotations(spark, str(tmp_path / "a.json"), one_document=False)
    got = {r["annotation_id"]: r["segmentation"] for r in read.annotations.collect()}
    assert {i: s["kind"] for i, s in got.items()} == {
        **dict.fromkeys((1, 5, 7, 8), "polygons"), **dict.fromkeys((2, 3, 9), "run_lengths"), **dict.fromkeys((4, 6, 10), "none")
    }
    assert got[1]["polygons"] == values[1] and got[2]["counts"] == [3, 4, 5] and got[2]["size"] == [2, 6]
    assert got[3]["counts"] is None and got[3]["encoded_counts"] == "abc" and got[2]["encoded_counts"] is None
    assert {i: (s["num_polygons"], s["first_polygon_len"]) for i, s in got.items() if s["kind"] == "polygons"} == {1: (2, 6), 5: (0, 0), 7: (3, 0), 8: (1, 0)}
    # Documents are scanned once, into a stored table; the three tables only read that.
    for table in (read.annotations, read.categories, read.images):
        assert "a.json" not in table._jdf.queryExecution().toString() and table.count() > 0


def test_annotation_documents_take_little_room(spark, tmp_path, monkeypatch):
    """Documents and their scan together: some 430 bytes an annotation when they were plain text, 70 since."""
    for module in (sources, documents):
        monkeypatch.setattr(module, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    read = sources.annotation_documents(spark, "/root/testdata/sf0.01")
    size = sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file())
    assert size < 150 * read.annotations.count()


def test_manifest_guards(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"rows": [{"sample_id": 1, "object_id": "o", "target_index": 2}], "stage": "x"}, indent=1))
    (tmp_path / "bad.json").write_text(json.dumps({"rows": {"sample_id": 1}}))
    (tmp_path / "none.json").write_text("{}")
    row = documents.scan_manifest(spark, str(tmp_path / "good.json")).first()
    assert (row["sample_id"], row["object_id"], row["target_index"], row["part_name"]) == (1, "o", 2, None)
    assert documents.scan_manifest(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(Exception, match="lacks a rows list"):
        documents.scan_manifest(spark, str(tmp_path / "bad.json")).collect()


def test_sidecars_take_the_id_from_the_folder(spark, tmp_path):
    for obj in ("object_000001", "object_000002"):
        folder = tmp_path / "objects" / obj / "prompt"
        folder.mkdir(parents=True)
        (folder / "part_prompts.json").write_text(json.dumps({"object_id": "wrong", "parts": [{"part_name": "seat"}, {"part_name": "leg"}]}, indent=1))
    docs = documents.scan_sidecars(spark, str(tmp_path / "objects" / "*" / "prompt" / "part_prompts.json"), schemas.PART_PROMPTS)
    got = sorted((r["object_id"], r["pos"], r["part_name"]) for r in documents.exploded(docs, "parts", "pos").collect())
    assert got == [(o, i, p) for o in ("object_000001", "object_000002") for i, p in enumerate(("seat", "leg"))]


def test_commits_are_whole_and_a_retry_adds_nothing(spark, tmp_path):
    store = CommitStore(spark, str(tmp_path / "store"))
    schema = "object_id bigint, v string"
    assert store.read("a", schema).count() == 0 and store.manifests().count() == 0
    one = spark.createDataFrame([(1, "x"), (2, "y")], schema)
    assert store.commit("first", {"a": one, "b": one.limit(0)}, bucket_by="object_id")
    assert not store.commit("first", {"a": one, "b": one})
    broken = one.withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.commit("second", {"a": one, "b": broken})
    # The half-written attempt is on disk, but no manifest names it.
    assert store.read("a", schema).count() == 2 and store.read("b", schema).count() == 0
    assert store.commit("second", {"a": one.withColumn("v", F.lit("z")), "b": one})
    assert sorted(tuple(r) for r in store.read("a", schema).collect()) == [(1, "x"), (1, "z"), (2, "y"), (2, "z")]
    assert store.read("a", schema, ["second"]).count() == 2
    assert {(r["commit"], r["name"]): r["rows"] for r in store.manifests().collect()} == {("first", "a"): 2, ("first", "b"): 0, ("second", "a"): 2, ("second", "b"): 2}


def test_sidecars_are_compacted_once(spark, tmp_path):
    store = CommitStore(spark, str(tmp_path / "store"))
    glob = str(tmp_path / "objects" / "*" / "prompt" / "*.json")

    def put(obj, names):
        folder = tmp_path / "objects" / obj / "prompt"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "part_prompts.json").write_text(json.dumps({"parts": [{"part_name": n} for n in names]}, indent=1))

    def held():
        return {r["object_id"]: ([p["part_name"] for p in r["doc"]["parts"]], r["num_versions"]) for r in documents.read_sidecars(store, "prompts", schemas.PART_PROMPTS).collect()}

    put("o1", ["seat"])
    put("o2", ["leg"])
    assert documents.compact_sidecars(spark, glob, store, "prompts", "c1") and held() == {"o1": (["seat"], 1), "o2": (["leg"], 1)}
    assert not documents.compact_sidecars(spark, glob, store, "prompts", "c2")
    put("o3", ["arm"])
    put("o2", ["leg", "back"])
    assert documents.compact_sidecars(spark, glob, store, "prompts", "c3")
    assert held() == {"o1": (["seat"], 1), "o2": (["leg", "back"], 2), "o3": (["arm"], 1)}
    assert {r["commit"]: r["rows"] for r in store.manifests().collect()} == {"c1": 2, "c3": 2}


def test_packs_hold_many_sidecars(spark, tmp_path):
    def put(folder, listed):
        rows = [(o, json.dumps({"parts": [{"part_name": p} for p in parts]})) for o, parts in listed.items()]
        writers.write_sidecar_packs(spark.createDataFrame(rows, "object_id string, value string"), f"{tmp_path}/{folder}", "prompt")

    def held():
        return {r["object_id"]: ([p["part_name"] for p in r["doc"]["parts"]], r["num_versions"]) for r in documents.read_sidecars(store, "prompts", schemas.PART_PROMPTS).collect()}

    put("one", {"o1": ["seat"], "o2": ["leg"]})
    loose = spark.createDataFrame([("o3", '{"parts": [{"part_name": "arm"}]}')], "object_id string, value string")
    writers.write_sidecars(loose, f"{tmp_path}/files", "prompt")
    glob, none = f"{tmp_path}/files/*/*", f"{tmp_path}/nothing/*/*"
    read = documents.scan_sidecars(spark, glob, schemas.PART_PROMPTS, f"{tmp_path}/one")
    assert sorted((r["object_id"], r["doc"]["parts"][0]["part_name"]) for r in read.collect()) == [("o1", "seat"), ("o2", "leg"), ("o3", "arm")]
    assert documents.scan_sidecars(spark, none, schemas.PART_PROMPTS, f"{tmp_path}/one").count() == 2
    store = CommitStore(spark, str(tmp_path / "store"))
    assert documents.compact_sidecars(spark, glob, store, "prompts", "c1", f"{tmp_path}/one")
    assert not documents.compact_sidecars(spark, glob, store, "prompts", "c2", f"{tmp_path}/one")
    assert held() == {"o1": (["seat"], 1), "o2": (["leg"], 1), "o3": (["arm"], 1)}
    put("two", {"o2": ["leg", "back"], "o4": []})
    assert documents.compact_sidecars(spark, none, store, "prompts", "c3", f"{tmp_path}/two")
    assert held() == {"o1": (["seat"], 1), "o2": (["leg", "back"], 2), "o3": (["arm"], 1), "o4": ([], 1)}


def test_a_scan_of_sidecars_writes_a_bounded_number_of_files(spark, monkeypatch):
    """A file per object, as for all 150 objects here, takes far longer than all the texts."""
    counts, write = [], writers.write_sidecars
    monkeypatch.setattr(writers, "write_sidecars", lambda df, root, stage: (counts.append(df.count()), write(df, root, stage)))
    read = REGISTRY["scan_sidecars"].plan(spark, "/root/testdata/sf0.01")
    assert read.select("object_id").distinct().count() > 100 and counts == [sources.LOOSE_OBJECTS]


def test_a_batch_reads_only_the_folders_of_its_keys(spark, tmp_path):
    finished = progress.FinishedUnits(spark, str(tmp_path / "finished"), ["unit"], 64)
    units = spark.range(5000).selectExpr("CAST(id AS STRING) AS unit")
    assert finished.among(units, 0).count() == 0
    finished.add(units, 0)
    few = units.filter("unit IN ('17', '4000')")
    read = finished.among(few, 1)
    assert len(read.inputFiles()) <= 2 and read.count() < 400
    assert few.join(read, "unit", "left_anti").count() == 0
    # What the batch itself has written in an earlier attempt doesn't count.
    assert finished.among(few, 0).count() == 0
    finished.add(few, 0)
    assert finished.among(units, 1).count() >= 5000 - 2 * 5000 // 32


def test_release_report_has_levels(spark):
    files = spark.createDataFrame([("a.py", 5, "cd /mnt/store"), ("LICENSE", 5, "terms")], "path string, size bigint, content string")
    got = [tuple(r) for r in audit.release_report(files).collect()]
    assert sorted(got) == [("error", "machine-specific absolute path found: a.py"), ("warning", "missing publication metadata: CITATION.cff")]
    assert {r["level"] for r in audit.release_report(files, strict=True).collect()} == {"error"}


def test_release_tree(spark, tmp_path):
    files = {
        "README.md": b"fine",
        "src/a.py": b'api_key = "0123456789abcdef0123"',
        "src/b.sh": b"cd /mnt/store",
        "src/c.txt": b"\xff\xfe\x00bad",
        "outputs/x.bin": b"x",
        "model.PT": b"x",
        "dist/a.py": b"cd /mnt/store",
        "notes": b"/disk/1",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    listed = {r["path"]: r["size"] for r in audit.file_inventory(documents.list_files(spark, str(tmp_path))).collect()}
    assert listed == {n: len(c) for n, c in files.items() if not n.startswith("dist/")}
    required = spark.createDataFrame([("README.md",), ("LICENSE",)], "path string")
    got = sorted(tuple(r) for r in audit.release_audit(documents.read_files(spark, str(tmp_path)), required).collect())
    assert got == sorted(
        [
            ("src/a.py", "possible embedded secret found"),
            ("src/b.sh", "machine-specific absolute path found"),
            ("src/c.txt", "expected UTF-8 text file"),
            ("outputs/x.bin", "generated directory is not allowed"),
            ("model.PT", "binary model or secret file is not allowed"),
            ("LICENSE", "missing required path"),
        ]
    )


def test_split_folders_are_pruned(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "val").otherwise("train").alias("split"))
    writers.write_partitioned(df, path, ["split"])
    stored = spark.read.parquet(path)
    assert stored.count() == 1000
    plan = pseudo.split_filter(stored, column="split", value="val")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_derived_columns_are_made_where_they_are_written(spark, tmp_path):
    """The same rows as of a plain write, also if a task meets more folders than it opens at once, and added twice."""
    split = F.when(F.col("id") % 7 > 0, F.concat(F.lit("a/b="), (F.col("id") % 7).cast("string")))
    wide = lambda rows: rows.select("id", F.repeat(F.col("id").cast("string"), 9).alias("text"), split.alias("split"))
    df = spark.range(3000).union(spark.range(100))
    settings = ("spark.sql.maxConcurrentOutputFileWriters", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = [spark.conf.get(k, None) for k in settings]
    assert writers.OPEN_FOLDERS < 7
    for _ in range(2):
        writers.write_partitioned(wide(df), str(tmp_path / "plain"), ["split"])
        writers.write_partitioned(df, str(tmp_path / "derived"), ["split"], derived=wide)
    plain, derived = (spark.read.parquet(str(tmp_path / n)) for n in ("plain", "derived"))
    assert derived.count() == 6200 and derived.schema == plain.schema
    assert derived.exceptAll(plain).isEmpty() and plain.exceptAll(derived).isEmpty()
    assert [spark.conf.get(k, None) for k in settings] == before


def test_bucketed_round_trip(spark, tmp_path):
    path = str(tmp_path / "b")
    df = spark.range(500).select((F.col("id") % 7).alias("object_id"), "id")
    writers.write_bucketed(df, path, "object_id", 4)
    back = writers.read_bucketed(spark, path)
    assert back.columns == df.columns and back.exceptAll(df).isEmpty() and back.count() == 500


def test_second_run_adds_nothing(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    seen = []

    def process(batch):
        seen.append(batch.count())
        return batch.select("unit", F.lit("completed").alias("status"), "num_records")

    def run():
        progress.run_incremental(
            spark, source, "unit string, num_records bigint", sink, state, keys=["unit"], process=process, progress_schema=schemas.PROGRESS
        )

    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "unit string, num_records bigint")
    rows.write.mode("append").parquet(source)
    run()
    run()
    rows.unionByName(spark.createDataFrame([("c", 3)], rows.schema)).write.mode("append").parquet(source)
    run()
    assert seen == [2, 1]
    assert sorted(r["unit"] for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]


def test_failing_rows_do_not_stop_a_run(spark):
    def infer(row):
        if row["v"] < 0:
            raise ValueError("negative")
        return {"root": row["v"] ** 0.5}

    df = spark.createDataFrame([(4.0,), (-1.0,)], "v double")
    out = inference.pluggable_scorer(df, infer, StructType([StructField("root", DoubleType())]), RetryConfig(2, 0.0))
    got = {r["v"]: (r["root"], r["attempts"], r["status"], r["error"]) for r in out.collect()}
    assert got == {4.0: (2.0, 1, "completed", None), -1.0: (None, 2, "failed", "negative")}


def test_counters_file_objects_without_parts_under_completed(spark):
    df = spark.createDataFrame(
        [("completed", None), ("skipped_no_parts", None), ("skipped", None), ("completed", "boom")], "status string, error string"
    )
    row = packaging.stage_counters(df).first()
    assert (row["num_requested"], row["num_completed"], row["num_skipped"], row["num_failed"]) == (4, 2, 1, 1)


def test_pseudo_sample_has_exact_size_and_repeats(spark):
    rows = spark.range(997).withColumnRenamed("id", "sample_id")
    first = sorted(r[0] for r in pseudo.pseudo_sample(rows, "sample_id", 0.3).collect())
    assert len(first) == 299 and first == sorted(r[0] for r in pseudo.pseudo_sample(rows.repartition(5), "sample_id", 0.3).collect())
    assert first != sorted(r[0] for r in pseudo.pseudo_sample(rows, "sample_id", 0.3, seed=7).collect())
    assert pseudo.pseudo_sample(rows, "sample_id", 0.00001).count() == 1
    assert pseudo.pseudo_sample(rows, "sample_id", 1.0).count() == 997


def test_curriculum_ramp(spark):
    weight = pseudo.curriculum_weight(F.col("id"), start=2, rampup=4, weight=0.5)
    assert [r[0] for r in spark.range(8).select(weight).collect()] == [0.0, 0.0, 0.0, 0.125, 0.25, 0.375, 0.5, 0.5]
    flat = pseudo.curriculum_weight(F.col("id"), start=1, rampup=0, weight=0.5)
    assert [r[0] for r in spark.range(3).select(flat).collect()] == [0.0, 0.5, 0.5]


def test_losses_of_real_rows_alone_agree(spark):
    """Without pseudo rows the mixed report is the supervised one."""
    rows = [(s, (s * 7 + p * 3) % 11 - 5.0, ((s + p) % 5) / 4) for s in range(6) for p in range(20)]
    df = spark.createDataFrame(rows, "sample_id bigint, logit double, heatmap double")
    plain = pseudo.loss_report(df).first().asDict()
    full = df.withColumns({"is_pseudo": F.lit(False), "point_mask": F.lit(True), "ignored": F.lit(False), "confidence": F.lit(1.0)})
    mixed = pseudo.mixed_loss_report(full).first().asDict()
    for name in ("loss", "bce_loss", "focal_loss", "dice_loss", "pos_weight", "truth_pos"):
        assert mixed[name] == pytest.approx(plain[name])


def test_empty_pseudo_side_contributes_nothing(spark):
    rows = [(s, s % 2 == 0, (s * 7 + p * 3) % 11 - 5.0, ((s + p) % 5) / 4, s % 2 == 0) for s in range(4) for p in range(10)]
    df = spark.createDataFrame(rows, "sample_id bigint, is_pseudo boolean, logit double, heatmap double, ignored boolean")
    df = df.withColumns({"point_mask": F.lit(True), "confidence": F.lit(1.0)})
    mixed = pseudo.mixed_loss_report(df, pseudo_focal_scale=0.5).first()
    real = pseudo.loss_report(df.filter("not is_pseudo")).first()
    assert mixed["bce_loss"] == pytest.approx(real["bce_loss"]) and mixed["focal_loss"] == pytest.approx(real["focal_loss"])
    assert mixed["pos_weight"] == 0.0


def test_required_folders_links_and_metadata(spark):
    files = spark.createDataFrame(
        [("models/a/README.md", 3, "hi", False), ("README.md", 3, "hi", False), ("LICENSE", 1, "x", False), ("docs/l.md", 1, "see /mnt/x", True)],
        "path string, size bigint, content string, is_link boolean",
    )
    required = spark.createDataFrame([("models/a",), ("models",), ("models/b",), ("README.md",)], "path string")
    got = sorted(tuple(r) for r in audit.release_audit(files, required).collect())
    assert got == [("docs/l.md", "symbolic link is not allowed"), ("models/b", "missing required path")]
    assert [tuple(r) for r in audit.metadata_audit(files).collect()] == [("warning", "missing publication metadata: CITATION.cff")]
    assert audit.metadata_audit(files, strict=True).first()["level"] == "error"
    assert audit.metadata_audit(files, ("LICENSE",)).count() == 0


def test_scorer_keeps_large_ids_and_gives_up_on_other_errors(spark):
    df = spark.createDataFrame([(2**60 + 1, None), (None, 1.0)], "id bigint, v double")

    def infer(row, attempt):
        if row["id"] is None:
            raise TypeError("no id")
        if attempt == 1:
            raise KeyError("later")
        return {"same": row["id"]}

    out = inference.pluggable_scorer(df, infer, StructType([StructField("same", LongType())]), RetryConfig(3, 0.0)).collect()
    assert {(r["id"], r["same"], r["attempts"], r["status"]) for r in out} == {(2**60 + 1, 2**60 + 1, 2, "completed"), (None, None, 1, "failed")}
