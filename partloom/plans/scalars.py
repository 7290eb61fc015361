"""Ids, slugs, paths, prompts, payloads, cameras and artifact lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom import fixed_values as fixed
from partloom.functions import model_text, names
from partloom.operators import cameras as cam, packaging, prompts
from partloom.plans import tables as t
from partloom.plans.registry import query
from partloom.plans.tables import SQL, camera_sql, q6, quoted, r6, sql_fill, views

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_collapse(text: str, glue: str = " ") -> str:
    stripped = f"regexp_replace({text}, '^{WS}|{WS}$', '', 'g')"
    return f"regexp_replace({stripped}, '{WS}', '{glue}', 'g')"


def sql_unknown(text: str) -> str:
    return f"coalesce(nullif({text}, ''), 'unknown')"


def sql_humanize(text: str) -> str:
    return sql_unknown(sql_collapse(f"replace({text}, '_', ' ')"))


def sql_slug_ws(text: str) -> str:
    return sql_unknown(sql_collapse(f"lower({text})", "_"))


def sql_slug_ascii(text: str) -> str:
    return sql_unknown(f"trim(regexp_replace(lower({text}), '[^a-zA-Z0-9]+', '_', 'g'), '_')")


@query(
    "ids",
    views("fx_annotations")
    + """SELECT annotation_id, printf('object_%06d', image_id) AS object_id, 'lvis_ann_' || ltrim(annotation_id, '0') AS stable_id
FROM fx_annotations""",
)
def ids(spark, d):
    stable = names.stable_object_id(F.col("annotation_id"))
    return t.annotations(spark, d).select(
        "annotation_id", names.object_id(F.col("image_id")).alias("object_id"), stable.alias("stable_id")
    )


ODD_TEXT = "CASE turn % 3 WHEN 0 THEN '  _' || text || '__! ' WHEN 1 THEN translate(text, 'aeiou', 'AEIOU') ELSE ' ' || chr(160) || chr(9) END"


def odd_texts(spark, d):
    turn, text = F.col("turn") % 3, F.col("text")
    odd = (
        F.when(turn == 0, F.concat(F.lit("  _"), text, F.lit("__! ")))
        .when(turn == 1, F.translate(text, "aeiou", "AEIOU"))
        .otherwise(F.lit("  \t"))
    )
    return t.table(spark, d, "conversations").select("conv_id", "turn", odd.alias("odd"))


@query(
    "slugs",
    f"""SELECT conv_id, turn, {sql_slug_ascii('odd')} AS slug_ascii, {sql_slug_ws('odd')} AS slug_ws, {sql_humanize('odd')} AS human
FROM (SELECT conv_id, turn, {ODD_TEXT} AS odd FROM conversations)""",
)
def slugs(spark, d):
    odd = F.col("odd")
    return odd_texts(spark, d).select(
        "conv_id", "turn", names.slug_ascii(odd).alias("slug_ascii"), names.slug_ws(odd).alias("slug_ws"),
        names.humanize(odd).alias("human"),
    )


@query(
    "part_sample_ids",
    f"""SELECT p_partkey, p_name || '__' || printf('object_%06d', p_partkey) || '__' || p_type || ' ' || p_brand AS packaged_id,
  {sql_slug_ascii('p_name')} || '__' || printf('object_%06d', p_partkey) || '__' || {sql_slug_ascii("p_type || ' ' || p_brand")} AS spec_id
FROM part""",
)
def part_sample_ids(spark, d):
    obj = names.object_id(F.col("p_partkey"))
    part = F.concat("p_type", F.lit(" "), "p_brand")
    return t.table(spark, d, "part").select(
        "p_partkey",
        names.part_sample_id(F.col("p_name"), obj, part).alias("packaged_id"),
        names.part_sample_id(F.col("p_name"), obj, part, slugged=True).alias("spec_id"),
    )


@query(
    "image_paths",
    """SELECT o_orderkey AS id, 'data/images/' ||
  CASE WHEN o_orderkey % 5 = 0 THEN printf('%012d.jpg', o_orderkey) ELSE o_orderkey || '.jpg' END AS image_path FROM orders""",
)
def image_paths(spark, d):
    return t.images(spark, d).select("id", names.image_path(F.col("coco_url"), F.col("id"), "data/images").alias("image_path"))


SQL["fx_paths"] = f"""
SELECT page_id, [{', '.join(quoted(old) for old, _ in names.LEGACY_PREFIXES)}, '/abs/', 'other/'][page_id % 10 + 1]
  || regexp_replace(url, '^https?://', '') AS path FROM pages"""


def legacy_paths(spark, d):
    prefixes = F.array(*[F.lit(old) for old, _ in names.LEGACY_PREFIXES], F.lit("/abs/"), F.lit("other/"))
    prefix = F.get(prefixes, (F.col("page_id") % 10).cast("int"))
    return t.table(spark, d, "pages").select(
        "page_id", F.concat(prefix, F.regexp_replace("url", "^https?://", "")).alias("path")
    )


@query(
    "canonical_paths",
    views("fx_paths")
    + "SELECT page_id, CASE WHEN path LIKE '/%' THEN path "
    + " ".join(
        f"WHEN starts_with(path, {quoted(old)}) THEN {quoted(new)} || path[{len(old) + 1}:]"
        for old, new in names.LEGACY_PREFIXES
    )
    + " ELSE path END AS canonical FROM fx_paths",
)
def canonical_paths(spark, d):
    return legacy_paths(spark, d).select("page_id", names.canonical_path(F.col("path")).alias("canonical"))


@query(
    "remap_paths",
    """SELECT page_id, CASE WHEN regexp_matches(path, '^(?:.*/)?release(?:/.*)?$')
  THEN regexp_extract(path, '^(?:.*/)?release(?:/(.*))?$', 1) END AS inside FROM (
SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/home/a/release/x/release/' || page_id || '.json'
  WHEN 1 THEN '/data/released/' || page_id || '.json' WHEN 2 THEN '/home/release' ELSE 'release/models/' || page_id END AS path FROM pages)""",
)
def remap_paths(spark, d):
    i = F.col("page_id")
    text = i.cast("string")
    path = (
        F.when(i % 4 == 0, F.concat(F.lit("/home/a/release/x/release/"), text, F.lit(".json")))
        .when(i % 4 == 1, F.concat(F.lit("/data/released/"), text, F.lit(".json")))
        .when(i % 4 == 2, F.lit("/home/release"))
        .otherwise(F.concat(F.lit("release/models/"), text))
    )
    return t.table(spark, d, "pages").select("page_id", names.remap_external(path, "release").alias("inside"))


@query(
    "mime_types",
    views("fx_files")
    + """SELECT file_id, CASE WHEN regexp_matches(lower(path), '[^/]\\.(jpg|jpeg)$') THEN 'image/jpeg' ELSE 'image/png' END AS mime_type
FROM fx_files""",
)
def mime_types(spark, d):
    return t.files(spark, d).select("file_id", names.mime_type(F.col("path")).alias("mime_type"))


@query(
    "part_prompts",
    f"""SELECT p_partkey, 'the ' || {sql_humanize("replace(p_type, ' ', '_')")} || ' of the ' || {sql_humanize('p_name')} AS base_prompt,
  CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'the ' || {sql_humanize("replace(p_type, ' ', '_')")} || ' of the ' || {sql_humanize('p_name')} END AS prompt
FROM part""",
)
def part_prompts(spark, d):
    part = F.replace(F.col("p_type"), F.lit(" "), F.lit("_"))
    given = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 1, F.lit(""))
    return t.table(spark, d, "part").select(
        "p_partkey",
        names.base_part_prompt(F.col("p_name"), part).alias("base_prompt"),
        names.part_prompt_or_default(given, F.col("p_name"), part).alias("prompt"),
    )


# Parts of a category, in order: brands of its products.
SQL["fx_category_parts"] = f"""
SELECT p_name AS category_name, min(p_partkey) AS pos, p_brand AS part_name,
  'the ' || {sql_humanize('p_brand')} || ' of the ' || {sql_humanize('p_name')} AS prompt
FROM part GROUP BY p_name, p_brand"""


def category_parts(spark, d):
    """Parts are few per category: brands are a short list."""
    parts = t.table(spark, d, "part").groupBy(F.col("p_name").alias("category_name"), F.col("p_brand").alias("part_name"))
    listed = parts.agg(F.min("p_partkey").alias("pos")).withColumn(
        "prompt", names.base_part_prompt(F.col("category_name"), F.col("part_name"))
    )
    return listed.groupBy("category_name").agg(
        F.sort_array(
            F.collect_list(F.struct("pos", "part_name", "prompt", F.col("prompt").alias("base_prompt")))
        ).alias("parts")
    )


def _json_item(item: str) -> str:
    return (
        f"""'{{"part_name": "' || {item}.part_name || '", "prompt": "' || {item}.prompt || '", "base_prompt": "' || """
        f"""{item}.prompt || '"}}'"""
    )


@query(
    "prompt_texts",
    views("fx_category_parts")
    + f"""SELECT category_name, {sql_fill(fixed.CATEGORY_PROMPT, {'category': 'category_name'})} AS category_prompt,
  {sql_fill(fixed.CANDIDATE_PROMPT, {'category': 'category_name'})} AS candidate_prompt,
  {sql_fill(fixed.PART_PROMPT, {'category': 'category_name', 'max_parts': '5',
                                'seat_prompt': "'the seat of the ' || " + sql_humanize('category_name')})} AS part_prompt,
  md5({sql_fill(fixed.CONSISTENCY_PROMPT, {'category': 'category_name', 'parts_json': "'[' || json_list || ']'"})}) AS consistency_md5,
  md5({sql_fill(fixed.INSTRUCTION_PROMPT, {'object': sql_humanize('category_name'), 'per_part': '3', 'max_words': '14',
                                           'part_lines': 'part_lines'})}) AS instruction_md5
FROM (SELECT category_name, string_agg({_json_item('c')}, ', ' ORDER BY pos) AS json_list,
  string_agg('- part_name: ' || part_name || '; grounding_prompt: ' || prompt, chr(10) ORDER BY pos) AS part_lines
FROM fx_category_parts c GROUP BY category_name)""",
)
def prompt_texts(spark, d):
    category = F.col("category_name")
    return category_parts(spark, d).select(
        "category_name",
        model_text.category_prompt(category).alias("category_prompt"),
        model_text.candidate_prompt(category).alias("candidate_prompt"),
        model_text.part_list_prompt(category).alias("part_prompt"),
        F.md5(model_text.consistency_prompt(category, F.col("parts"))).alias("consistency_md5"),
        F.md5(model_text.instruction_prompt(category, F.col("parts"))).alias("instruction_md5"),
    )


@query(
    "request_payloads",
    f"""SELECT page_id, length(payload) AS payload_length, md5(payload) AS payload_md5 FROM (SELECT page_id,
  '{{"contents":[{{' || CASE WHEN page_id % 2 = 0 THEN '"role":"user",' ELSE '' END ||
  '"parts":[{{"inline_data":{{"mime_type":"image/jpeg","data":"' || to_base64(encode(html)) || '"}}}},{{"text":' ||
  to_json({sql_fill(fixed.CANDIDATE_PROMPT, {'category': 'url'})})::VARCHAR || '}}]}}],"generationConfig":{{"responseMimeType":"application/json"}}}}' AS payload
FROM pages)""",
)
def request_payloads(spark, d):
    parts = F.array(
        model_text.image_part(F.lit("view.JPG"), F.encode("html", "UTF-8")),
        model_text.text_part(model_text.candidate_prompt(F.col("url"))),
    )
    payload = F.when(F.col("page_id") % 2 == 0, model_text.request_payload(parts, "user")).otherwise(
        model_text.request_payload(parts)
    )
    rows = t.table(spark, d, "pages").select("page_id", payload.alias("payload"))
    return rows.select(
        "page_id", F.length("payload").cast("bigint").alias("payload_length"), F.md5("payload").alias("payload_md5")
    )


_MANIFEST_FIXED = {
    "source.image": "source/image.png", "source.instance_mask": "source/instance_mask.png",
    "source.meta": "source/source_meta.json", "candidate.meta": "candidate/candidate_meta.json",
    "recon3d.gaussian": "recon3d/splat.ply", "recon3d.meta": "recon3d/recon_meta.json",
    "recon3d.camera_params": "recon3d/lifting_camera_params.json", "render.cameras": "render/cameras.json",
    "prompt.parts": "prompt/part_prompts.json", "seg2d.meta": "seg2d/seg_meta.json",
    "project3d.votes": "project3d/part_votes.json", "project3d.scores": "project3d/gaussian_part_scores.npz",
    "label3d.part_membership_scores": "label3d/part_membership_scores.npz",
    "label3d.unknown_mask": "label3d/unknown_mask.npz", "package.object_manifest": "package/object_manifest.json",
    "package.part_instances": "package/part_instances.json",
    "instruction.part_instructions": "instruction/part_instructions.json",
}
_FIXED_ROWS = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in _MANIFEST_FIXED.items())


@query(
    "object_manifest",
    f"""SELECT printf('object_%06d', doc_id) AS object_id, artifact, path FROM documents, (
  SELECT * FROM (VALUES {_FIXED_ROWS}) v(artifact, path)
  UNION ALL SELECT printf('render.image.view_%03d', i), printf('render/view_%03d.png', i) FROM range(6) r(i)
  UNION ALL SELECT printf('render.seg_dir.view_%03d', i), printf('seg2d/view_%03d', i) FROM range(6) r(i)
  UNION ALL SELECT printf('project3d.visibility.view_%03d', i), printf('project3d/visibility/view_%03d_visibility.png', i)
    FROM range(3) r(i))""",
)
def object_manifest(spark, d):
    objects = t.table(spark, d, "documents").select(names.object_id(F.col("doc_id")).alias("object_id"))
    return packaging.object_manifest(objects)


SQL["fx_poses"] = """
SELECT s_suppkey, CAST((s_suppkey * 37) % 360 - 180 AS DOUBLE) AS yaw_deg, CAST((s_suppkey * 13) % 160 - 80 AS DOUBLE) AS pitch_deg,
  1 + (s_suppkey % 5) * 0.5::DOUBLE AS radius, CAST(30 + s_suppkey % 50 AS DOUBLE) AS fov_deg,
  CAST(s_suppkey % 3 - 1 AS DOUBLE) AS ax, CAST(s_suppkey % 5 - 2 AS DOUBLE) AS ay,
  CASE WHEN s_suppkey % 7 = 3 THEN -1.0::DOUBLE ELSE CAST(s_suppkey % 7 - 3 AS DOUBLE) END AS az FROM supplier"""

_TURN = "(1 - c) / CASE WHEN s2 <= 1e-12 THEN 1 ELSE s2 END"


@query(
    "cameras",
    views("fx_poses")
    + f""", c AS ({camera_sql('(SELECT * FROM fx_poses)')}),
u AS (SELECT s_suppkey, ax / n AS x, ay / n AS y, az / n AS c, (ax * ax + ay * ay) / (n * n) AS s2
  FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS n FROM fx_poses )),
k AS (SELECT *, {_TURN} AS b FROM u)
SELECT c.s_suppkey, {', '.join(q6(f'c.{n}') + f' AS {n}' for n in ('rx', 'ry', 'dx', 'dy', 'dz', 'fx', 'fy', 'fz', 'tx', 'ty', 'tz', 'focal'))},
  {q6("CASE WHEN s2 <= 1e-12 THEN 1 ELSE 1 - b * x * x END")} AS m00,
  {q6("CASE WHEN s2 <= 1e-12 THEN 0 ELSE -b * x * y END")} AS m01,
  {q6("CASE WHEN s2 <= 1e-12 THEN 0 ELSE x END")} AS m02,
  {q6("CASE WHEN s2 <= 1e-12 THEN CASE WHEN k.c < 0 THEN -1 ELSE 1 END ELSE 1 - b * y * y END")} AS m11,
  {q6("CASE WHEN s2 <= 1e-12 THEN 0 ELSE y END")} AS m12,
  {q6("CASE WHEN s2 <= 1e-12 THEN CASE WHEN k.c < 0 THEN -1 ELSE 1 END ELSE k.c END")} AS m22
FROM c JOIN k USING (s_suppkey)""",
)
def cameras(spark, d):
    """Poses and pre-rotations of one camera per supplier."""
    i = F.col("s_suppkey")
    poses = t.table(spark, d, "supplier").select(
        "s_suppkey",
        ((i * 37) % 360 - 180).cast("double").alias("yaw_deg"),
        ((i * 13) % 160 - 80).cast("double").alias("pitch_deg"),
        (1 + (i % 5) * 0.5).alias("radius"),
        (30 + i % 50).cast("double").alias("fov_deg"),
        (i % 3 - 1).cast("double").alias("ax"),
        (i % 5 - 2).cast("double").alias("ay"),
        F.when(i % 7 == 3, F.lit(-1.0)).otherwise((i % 7 - 3).cast("double")).alias("az"),
    )
    turned = cam.pre_rotation(poses.select("s_suppkey", *[F.col(f"a{a}").alias(f"t{a}") for a in "xyz"])).drop("tx", "ty", "tz")
    posed = cam.camera_matrices(cam.look_at(poses.drop("ax", "ay", "az"))).join(turned, "s_suppkey")
    wanted = ("rx", "ry", "dx", "dy", "dz", "fx", "fy", "fz", "tx", "ty", "tz", "focal", "m00", "m01", "m02", "m11", "m12", "m22")
    return posed.select("s_suppkey", *[r6(n).alias(n) for n in wanted])


# Files of an object: which of them exist depends on the document.
SQL["fx_object_files"] = """
SELECT doc_id AS object_id, path FROM documents, (VALUES (0, 'candidate/masked_instance.png'), (1, 'source/image.png'),
  (2, 'render/view_000.png'), (3, 'render/view_001.png'), (4, 'render/view_002.png'), (5, 'render/view_010.png'),
  (6, 'render/view_003.jpg'), (7, 'project3d/visibility/view_000_visibility.png'),
  (8, 'project3d/visibility/view_001_visibility.png'), (9, 'project3d/visibility/view_x_visibility.png'),
  (10, 'project3d/visibility/front_view_002_visibility.png')) f(i, path) WHERE (doc_id * 7 + i * 5) % 4 <> 0"""

_FILES = (
    "candidate/masked_instance.png", "source/image.png", "render/view_000.png", "render/view_001.png",
    "render/view_002.png", "render/view_010.png", "render/view_003.jpg", "project3d/visibility/view_000_visibility.png",
    "project3d/visibility/view_001_visibility.png", "project3d/visibility/view_x_visibility.png",
    "project3d/visibility/front_view_002_visibility.png",
)


def object_files(spark, d):
    listed = F.array(*[F.lit(p) for p in _FILES])
    rows = t.table(spark, d, "documents").select(F.col("doc_id").alias("object_id"), F.posexplode(listed).alias("i", "path"))
    return rows.filter((F.col("object_id") * 7 + F.col("i") * 5) % 4 != 0).select("object_id", "path")


@query(
    "evidence_paths",
    views("fx_object_files")
    + """, k AS (SELECT *, CASE WHEN path = 'candidate/masked_instance.png' THEN 0 WHEN path = 'source/image.png' THEN 1
  WHEN path LIKE 'render/view!_%.png' ESCAPE '!' THEN 2 END AS kind FROM fx_object_files ),
r AS (SELECT *, row_number() OVER (PARTITION BY object_id, kind ORDER BY path) AS n FROM k WHERE kind IS NOT NULL)
SELECT object_id, string_agg(path, ',' ORDER BY kind, path) AS evidence, bool_or(kind = 0) AS has_masked_view
FROM r WHERE kind < 2 OR n <= 2 GROUP BY object_id""",
)
def evidence_paths(spark, d):
    files = object_files(spark, d)
    masked = prompts.masked_evidence(files).select("object_id", F.lit(True).alias("has_masked_view"))
    return prompts.evidence_paths(files, 2).join(masked, "object_id", "left").select(
        "object_id", F.array_join("evidence_paths", ",").alias("evidence"),
        F.coalesce("has_masked_view", F.lit(False)).alias("has_masked_view"),
    )


@query(
    "visibility_files",
    views("fx_object_files")
    + """SELECT object_id, path FROM fx_object_files
WHERE regexp_full_match(regexp_extract(path, '[^/]*$'), 'view_\\d+_visibility\\.png')""",
)
def visibility_files(spark, d):
    return object_files(spark, d).filter(names.is_visibility_file(F.col("path")))
