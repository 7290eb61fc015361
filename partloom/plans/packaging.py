"""Packages, resume, quality reports, statistics, audits."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from partloom import fixed_values as fixed
from partloom.config import FusionConfig
from partloom.functions import names
from partloom.operators import audit, packaging as pack, prompts
from partloom.plans import tables as t
from partloom.plans.registry import query
from partloom.plans.scalars import object_files
from partloom.plans.tables import SQL, sql_fill, views
from partloom.session import checkpointed, scratch_path
from partloom.sources import writers
from partloom.sources.commits import CommitStore

# Prompted parts of an object (one per event type) and the parts that have scores.
SQL["fx_prompted"] = """
SELECT user_id AS object_id, event_type AS part_name, CASE WHEN user_id % 2 = 0 THEN 'small ring' ELSE 'red widget' END AS category_name,
  min(event_id) AS part_pos, max(value) AS top FROM events GROUP BY user_id, event_type"""

SQL["fx_packaged"] = """
SELECT *, category_name || '__' || object_id || '__' || part_name AS part_sample_id FROM fx_prompted WHERE top >= 100"""


def prompted(spark, d):
    category = F.when(F.col("user_id") % 2 == 0, "small ring").otherwise("red widget")
    return (
        t.table(spark, d, "events")
        .groupBy(F.col("user_id").alias("object_id"), F.col("event_type").alias("part_name"), category.alias("category_name"))
        .agg(F.min("event_id").alias("part_pos"), F.max("value").alias("top"))
    )


def packaged(spark, d):
    scored = t.table(spark, d, "events").filter("value >= 100").select(
        F.col("user_id").alias("object_id"), F.col("event_type").alias("part_name")
    )
    return pack.packaged_parts(prompted(spark, d), scored)


@query("packaged_parts", views("fx_packaged") + "SELECT object_id, part_name, part_sample_id FROM fx_packaged")
def packaged_parts(spark, d):
    return packaged(spark, d).select("object_id", "part_name", "part_sample_id")


SQL["fx_kinds"] = """
SELECT doc_id AS object_id, kind FROM documents, (VALUES (0, 'part_instances'), (1, 'membership'), (2, 'unknown_mask'),
  (3, 'colored_points'), (4, 'visualization')) k(i, kind) WHERE (doc_id * 3 + i * 7) % 11 <> 0"""

_KINDS = ("part_instances", "membership", "unknown_mask", "colored_points", "visualization")


def kinds(spark, d):
    listed = F.array(*[F.lit(k) for k in _KINDS])
    rows = t.table(spark, d, "documents").select(F.col("doc_id").alias("object_id"), F.posexplode(listed).alias("i", "kind"))
    return rows.filter((F.col("object_id") * 3 + F.col("i") * 7) % 11 != 0).select("object_id", "kind")


@query(
    "missing_inputs",
    views("fx_kinds")
    + """SELECT doc_id AS object_id, kind FROM documents, (VALUES ('membership'), ('unknown_mask'), ('part_instances')) r(kind)
ANTI JOIN fx_kinds k ON k.object_id = doc_id AND k.kind = r.kind""".replace(
        "FROM documents, (VALUES", "FROM (SELECT doc_id, kind FROM documents, (VALUES", 1
    ).replace("r(kind)", "v(kind)) r", 1),
)
def missing_inputs(spark, d):
    objects = t.table(spark, d, "documents").select(F.col("doc_id").alias("object_id"))
    return pack.missing_inputs(objects, kinds(spark, d), ("membership", "unknown_mask", "part_instances"))


@query(
    "resume_pending",
    "SELECT event_id, user_id FROM events WHERE NOT (event_id % 2 = 0 AND event_id % 3 <> 0)",
)
def resume_pending(spark, d):
    events = t.table(spark, d, "events")
    status = F.when(F.col("event_id") % 3 == 0, "running").otherwise("completed")
    progress = events.filter("event_id % 2 = 0").select("event_id", status.alias("status"))
    return pack.resume_pending(events.select("event_id", "user_id"), progress, ["event_id"])


CONFIG = FusionConfig()


def config_struct(ratio):
    """Settings as a struct: equal only if every field is."""
    fields = {k: F.lit(v) for k, v in CONFIG.to_dict().items()} | {"score_threshold": ratio}
    return F.struct(*[c.alias(n) for n, c in sorted(fields.items())])


@query(
    "completeness",
    views("fx_kinds")
    + """, h AS (SELECT object_id, bool_or(kind = 'part_instances') AND bool_or(kind = 'membership') AND bool_or(kind = 'unknown_mask')
  AND bool_or(kind = 'colored_points') AS files, bool_or(kind = 'visualization') AS drawn FROM fx_kinds GROUP BY object_id)
SELECT object_id, ok AS config_matches, files AND ok AND (doc_id % 5 = 0 OR drawn) AS is_complete
FROM (SELECT *, doc_id % 3 <> 0 AND doc_id % 4 <> 0 AS ok FROM documents) JOIN h ON object_id = doc_id""",
)
def completeness(spark, d):
    i = F.col("doc_id")
    # Recorded settings arrive as JSON text and are parsed before they are compared as a whole.
    good = config_struct(F.lit(CONFIG.score_threshold))
    schema = "struct<" + ",".join(
        f"{k}:{'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double'}"
        for k, v in sorted(CONFIG.to_dict().items())
    ) + ">"
    text = json.dumps(CONFIG.to_dict())
    recorded = F.when(i % 4 == 0, F.replace(F.lit(text), F.lit('"score_threshold": 0.3'), F.lit('"score_threshold": 0.4'))).otherwise(
        F.lit(text)
    )
    meta = t.table(spark, d, "documents").select(
        i.alias("object_id"),
        F.when(i % 3 == 0, "running").otherwise("completed").alias("status"),
        F.from_json(recorded, schema).alias("config"),
        F.when(i % 5 == 0, 0).otherwise(2).alias("num_prompt_parts"),
    )
    return pack.completeness(kinds(spark, d), meta, good)


@query(
    "qc_report",
    views("fx_packaged", "fx_object_files")
    + """, s AS (SELECT object_id, count(*) AS num_part_samples, string_agg(part_name, ',' ORDER BY part_pos) AS part_names FROM fx_packaged GROUP BY 1),
v AS (SELECT object_id, count(*) FILTER (path LIKE 'render/view%.png') AS rv,
  count(DISTINCT path) FILTER (regexp_matches(path, '/view_[0-9]+_visibility.png$')) AS vf FROM fx_object_files GROUP BY 1),
g AS (SELECT user_id AS object_id, count(*) AS st, count(*) FILTER (value >= 50) AS sm, count(*) FILTER (event_id % 7 = 0) AS un FROM events GROUP BY 1)
SELECT s.*, coalesce(rv, 0) AS num_render_views, coalesce(vf, 0) AS num_visibility_files, st AS num_segmentation_targets,
  sm AS num_segmentation_masks, un AS num_unknown FROM s LEFT JOIN v USING (object_id) LEFT JOIN g USING (object_id)""",
)
def qc_report(spark, d):
    from partloom.functions.names import is_visibility_file

    files = object_files(spark, d)
    events = t.table(spark, d, "events").select(F.col("user_id").alias("object_id"), "event_id", "value")
    return pack.qc_report(
        packaged(spark, d),
        files.filter(F.col("path").rlike(r"^render/view.*\.png$")),
        files.filter(is_visibility_file(F.col("path"))),
        events.withColumn("has_mask", F.col("value") >= 50),
        events.withColumn("unknown", F.col("event_id") % 7 == 0),
    )


@query(
    "stage_counters",
    """SELECT event_type AS stage, count(*) AS num_requested, count(*) FILTER (event_id % 5 <> 0 AND event_id % 7 <> 0) AS num_completed,
  count(*) FILTER (event_id % 5 = 0 AND event_id % 7 <> 0) AS num_skipped, count(*) FILTER (event_id % 7 = 0) AS num_failed FROM events GROUP BY 1""",
)
def stage_counters(spark, d):
    e = F.col("event_id")
    status = F.when(e % 5 == 0, "skipped").when(e % 3 == 0, "skipped_no_parts").otherwise("completed")
    error = F.when(e % 7 == 0, F.lit("missing required input"))
    results = t.table(spark, d, "events").select(F.col("event_type").alias("stage"), status.alias("status"), error.alias("error"))
    return pack.stage_counters(results, ["stage"])


@query(
    "dataset_stats",
    views("fx_packaged")
    + """SELECT count(DISTINCT object_id) AS objects, count(DISTINCT part_sample_id) AS parts, (sum(3))::BIGINT AS instructions,
  count(DISTINCT category_name) AS categories, count(DISTINCT part_name) AS part_types FROM fx_packaged""",
)
def dataset_stats(spark, d):
    return pack.dataset_stats(packaged(spark, d).withColumn("num_instructions", F.lit(3)))


SAMPLE = "part_sample_id string, object_id string, part_name string, object_dir string, part_instances_path string"
BUILD = "num_requested bigint, num_failed bigint, num_part_samples bigint, num_completed bigint"


def committed_build(spark, d):
    """Dataset index, failure list and summary of a build, under one commit that is tried twice."""
    requested = t.table(spark, d, "events").select(F.col("user_id").alias("object_id")).distinct()
    failed = requested.filter("object_id % 9 = 0")
    text = F.col("object_id").cast("string")
    completed = requested.join(failed, "object_id", "left_anti").withColumn("object_id", text)
    index = pack.dataset_index(completed, packaged(spark, d).withColumn("object_id", text))
    tables = {
        "part_samples": index.select("part_sample_id", "object_id", "part_name", "object_dir", "part_instances_path"),
        "failures": failed.select(text.alias("object_id"), F.concat(F.lit("stage failed for "), text).alias("error")),
        "summary": pack.build_summary(requested, failed, index).select("num_requested", "num_failed", "num_part_samples", "num_completed"),
    }
    store = CommitStore(spark, scratch_path(spark, "dataset"))
    store.commit("build", tables, bucket_by="object_id")
    store.commit("build", tables, bucket_by="object_id")  # a retry adds nothing
    return store


@query(
    "dataset_index",
    views("fx_packaged")
    + """SELECT part_sample_id, 'objects/' || object_id AS object_dir, 'objects/' || object_id || '/package/part_instances.json' AS part_instances_path,
  (SELECT count(*) FROM fx_packaged WHERE object_id % 9 <> 0) AS num_part_samples,
  (SELECT count(DISTINCT user_id) FILTER (user_id % 9 <> 0) FROM events) AS num_completed,
  (SELECT count(DISTINCT user_id) FILTER (user_id % 9 = 0) FROM events) AS num_failed FROM fx_packaged WHERE object_id % 9 <> 0""",
)
def dataset_index(spark, d):
    store = committed_build(spark, d)
    names = ("num_part_samples", "num_completed", "num_failed")
    summary = store.read("summary", BUILD).select(F.struct(*names).alias("s")).scalar()
    return store.read("part_samples", SAMPLE).withColumn("_s", summary).select(
        "part_sample_id", "object_dir", "part_instances_path", *[f"_s.{n}" for n in names]
    )


@query(
    "build_failures",
    """SELECT user_id::VARCHAR AS object_id, 'stage failed for ' || user_id AS error, 1::BIGINT AS num_commits
FROM events WHERE user_id % 9 = 0 GROUP BY user_id""",
)
def build_failures(spark, d):
    """The failure list that the build left, with the number of commits that hold it."""
    store = committed_build(spark, d)
    commits = store.manifests().filter("name = 'failures'").agg(F.count(F.lit(1))).scalar()
    return store.read("failures", "object_id string, error string").withColumn("num_commits", commits)


PACKAGE = "object_id bigint, category_name string, object_dir string, num_part_samples bigint"
INSTANCE = "part_sample_id string, object_id bigint, part_name string, part_pos bigint"
INSTRUCTION = "part_sample_id string, object_id bigint, instruction_pos bigint, instruction string"


@query(
    "package_records",
    views("fx_packaged")
    + f"""SELECT object_id, category_name, count(*) AS num_part_samples, min(part_name) AS first_part, 3 * count(*) AS num_instructions,
  min({{first}}) AS first_instruction, 2::BIGINT AS num_commits FROM fx_packaged GROUP BY object_id, category_name""".replace(
        "{first}", sql_fill(fixed.FALLBACK_INSTRUCTIONS[0], {"object": "replace(category_name, '_', ' ')", "part": "replace(part_name, '_', ' ')", "prompt": "'the ' || part_name || ' of the ' || category_name"})
    ),
)
def package_records(spark, d):
    """Object manifests, part instances and instruction records, written in two commits and read back."""
    parts = packaged(spark, d).withColumn("prompt", names.base_part_prompt(F.col("category_name"), F.col("part_name")))
    none = parts.select("part_sample_id", F.lit(0).alias("pos"), F.lit("").alias("raw"))
    store = CommitStore(spark, scratch_path(spark, "packages"))
    for share in (0, 1):
        mine = checkpointed(parts.filter(F.pmod("object_id", F.lit(2)) == share), "package-parts")
        spoken = prompts.complete_instructions(none, mine.withColumn("object_name", F.col("category_name")), 3)
        manifest = mine.groupBy("object_id", "category_name").agg(F.count(F.lit(1)).alias("num_part_samples"))
        tables = {
            "object_manifest": manifest.select("object_id", "category_name", F.concat(F.lit("objects/"), "object_id").alias("object_dir"), "num_part_samples"),
            "part_instances": mine.select("part_sample_id", "object_id", "part_name", "part_pos"),
            "part_instructions": spoken.join(mine.select("part_sample_id", "object_id"), "part_sample_id").select("part_sample_id", "object_id", "instruction_pos", "instruction"),
        }
        for _ in range(2):  # a retry adds nothing
            store.commit(f"share-{share}", tables, bucket_by="object_id")
    listed = store.read("part_instances", INSTANCE).groupBy("object_id").agg(F.min("part_name").alias("first_part"))
    spoken = store.read("part_instructions", INSTRUCTION).groupBy("object_id").agg(
        F.count(F.lit(1)).alias("num_instructions"), F.min(F.when(F.col("instruction_pos") == 0, F.col("instruction"))).alias("first_instruction")
    )
    commits = store.manifests().select("commit").distinct().agg(F.count(F.lit(1))).scalar()
    whole = store.read("object_manifest", PACKAGE).drop("object_dir").join(listed, "object_id").join(spoken, "object_id")
    return whole.withColumn("num_commits", commits)


@query(
    "benchmark_subset",
    views("fx_packaged") + "SELECT DISTINCT object_id FROM fx_packaged WHERE object_id % 9 <> 0",
)
def benchmark_subset(spark, d):
    requested = t.table(spark, d, "events").select(F.col("user_id").alias("object_id"))
    return pack.benchmark_subset(requested, requested.filter("object_id % 9 = 0").distinct(), packaged(spark, d))


@query(
    "run_status",
    """SELECT user_id AS object_id, event_type AS stage, max(event_id) AS version, arg_max(CASE event_id % 3 WHEN 0 THEN 'planned'
  WHEN 1 THEN 'running' ELSE 'completed' END, event_id) AS status, arg_max(props, event_id) AS settings FROM events GROUP BY 1, 2""",
)
def run_status(spark, d):
    e = F.col("event_id") % 3
    status = F.when(e == 0, "planned").when(e == 1, "running").otherwise("completed")
    log = t.table(spark, d, "events").select(
        F.col("user_id").alias("object_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("version"),
        status.alias("status"), F.col("props").alias("settings"),
    )
    path = scratch_path(spark, "status")
    for kind in ("planned", "running", "completed"):
        writers.append_status(log.filter(F.col("status") == kind), path)
    return pack.run_status(spark.read.parquet(path), ["object_id", "stage"])


@query(
    "first_nonempty_source",
    """SELECT user_id AS batch, min_p AS priority, event_type AS object_dir FROM (SELECT DISTINCT user_id, event_type, p, min(p) OVER (PARTITION BY user_id) AS min_p
FROM (SELECT user_id, event_type, CASE WHEN value > 400 THEN 0 WHEN value > 150 THEN 1 ELSE 2 END AS p FROM events)) WHERE p = min_p""",
)
def first_nonempty_source(spark, d):
    v = F.col("value")
    priority = F.when(v > 400, 0).when(v > 150, 1).otherwise(2)
    found = t.table(spark, d, "events").select(
        F.col("user_id").alias("batch"), priority.alias("priority"), F.col("event_type").alias("object_dir")
    )
    return pack.first_nonempty_source(found, ["batch"], "object_dir")


SQL["fx_inventory"] = """
SELECT *, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS suffix FROM fx_files WHERE NOT list_has_any(string_split(path, '/'),
  ['.git', 'dist', 'node_modules', 'playwright-report', 'test-results'])"""


@query("file_inventory", views("fx_inventory") + "SELECT path, size, suffix FROM fx_inventory")
def file_inventory(spark, d):
    return audit.file_inventory(t.files(spark, d).select("path", "size"))


_TEXT = "suffix IN ('.cff', '.css', '.html', '.json', '.md', '.py', '.sh', '.svg', '.toml', '.ts', '.tsx', '.txt', '.yaml', '.yml')"


SQL["fx_violations"] = f"""SELECT path, 'generated directory is not allowed' AS violation FROM fx_inventory WHERE list_has_any(string_split(path, '/'),
  ['__pycache__', '.pytest_cache', 'artifacts', 'checkpoints', 'outputs'])
UNION ALL SELECT path, 'binary model or secret file is not allowed' FROM fx_inventory WHERE suffix IN ('.ckpt', '.pem', '.pth', '.pt', '.safetensors')
UNION ALL SELECT path, 'file exceeds 10 MiB' FROM fx_inventory WHERE size > 10485760
UNION ALL SELECT path, 'machine-specific absolute path found' FROM fx_inventory WHERE {_TEXT} AND regexp_matches(content, '/(?:disk|mnt)/')
UNION ALL SELECT path, 'possible embedded secret found' FROM fx_inventory WHERE {_TEXT} AND regexp_matches(content,
  '(?i)(?:api[_-]?key|access[_-]?token|secret)\\s*[:=]\\s*[''"][A-Za-z0-9_./+-]{{16,}}[''"]')
UNION ALL SELECT doc_id || '/README.md', 'missing required path' FROM documents WHERE doc_id % 100 = 0"""


@query("release_audit", views("fx_violations") + "SELECT path, violation FROM fx_violations")
def release_audit(spark, d):
    return audit.release_audit(t.files(spark, d), required_paths(spark, d))


def required_paths(spark, d):
    required = t.table(spark, d, "documents").filter("doc_id % 100 = 0").select(
        F.concat(F.col("doc_id").cast("string"), F.lit("/README.md")).alias("path")
    )
    # Folders of existing files are there, although no file has their path.
    folders = t.files(spark, d).select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()
    return required.unionByName(folders)


@query(
    "release_report",
    views("fx_violations")
    + """SELECT 'error' AS level, violation || ': ' || path AS message FROM fx_violations
UNION ALL SELECT 'warning', 'missing publication metadata: CITATION.cff'""",
)
def release_report(spark, d):
    """Row rules and the metadata rule in one report; of the metadata files only the license is there."""
    files = t.files(spark, d)
    smallest = files.agg(F.min(F.struct("path", *[c for c in files.columns if c != "path"])).alias("f"))
    license_file = smallest.select("f.*").withColumns({"path": F.lit("LICENSE"), "content": F.lit("terms"), "size": F.lit(5).cast(files.schema["size"].dataType)})
    return audit.release_report(files.unionByName(license_file.select(*files.columns)), required_paths(spark, d))


@query(
    "manifest_audit",
    """SELECT doc_id, (doc_id % 3 = 0)::INT + (doc_id % 5 = 0)::INT AS absolute_paths, sha256(text) AS sha256 FROM documents""",
)
def manifest_audit(spark, d):
    i, text = F.col("doc_id"), F.col("doc_id").cast("string")
    rows = t.table(spark, d, "documents").select(
        "doc_id", "text",
        F.concat(F.when(i % 3 == 0, "/home/").otherwise("geo/"), text).alias("geo_cache_path"),
        F.concat(F.when(i % 5 == 0, "/mnt/").otherwise("vlm/"), text).alias("vlm_cache_path"),
    )
    return audit.manifest_audit(rows, ["geo_cache_path", "vlm_cache_path"], "text").select("doc_id", "absolute_paths", "sha256")


@query(
    "cache_config_check",
    """SELECT s_suppkey, array_to_string(list_filter([
  CASE WHEN s_suppkey % 4 = 1 THEN 'hidden_size=1024 != vlm_hidden_size=2048' END,
  CASE WHEN s_suppkey % 3 = 1 THEN 'num_views=6 != num_views=1' END,
  CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 THEN 'total_visual_tokens=' || (144 + s_suppkey % 5) || ' != num_views*grid_size^2=144' END],
  lambda m: m IS NOT NULL), '; ') AS mismatches FROM supplier""",
)
def cache_config_check(spark, d):
    i = F.col("s_suppkey")
    configs = t.table(spark, d, "supplier").select(
        "s_suppkey",
        F.when(i % 4 == 1, 1024).when(i % 4 == 2, 2048).alias("hidden_size"),
        F.when(i % 3 == 1, 6).when(i % 3 == 2, 1).alias("num_views"),
        F.when(i % 7 != 0, 144 + i % 5).alias("total_visual_tokens"),
    )
    checked = audit.cache_config_check(configs, hidden_size=2048, num_views=1, grid_size=12)
    return checked.select("s_suppkey", F.array_join("mismatches", "; ").alias("mismatches"))
