"""Model answers and instructions: reading, parsing, joining, completing, calling, failing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from partloom import fixed_values as fixed
from partloom.config import RetryConfig
from partloom.functions import model_text
from partloom.operators import inference, packaging, prompts
from partloom.plans import tables as t
from partloom.plans.registry import query
from partloom.plans.scalars import sql_humanize, sql_slug_ws
from partloom.plans.tables import SQL, sql_fill, views


def texts(spark, d):
    read = model_text.response_text(F.col("response"))
    return t.answers(spark, d).withColumn("_r", read).withColumns({"text": F.col("_r.text"), "read_error": F.col("_r.error")})


# What the answer says, by construction of the responses.
SQL["fx_answers"] = """
SELECT *, '{"recognizable_from_mask_only": ' || recognizable || ', "clear_not_blurry": ' || clear_image || ', "severe_crop": '
  || CASE WHEN event_id % 7 = 0 THEN '"false"' ELSE cropped::VARCHAR END || ', "interactive_object": ' || interactive
  || ', "pass": ' || passed || ', "short_reason": "seen {' || event_type || '} once"}' AS decision,
  CASE envelope WHEN 'no_parts' THEN 'unsupported response structure' WHEN 'blank' THEN 'response content must include text' END AS read_error
FROM fx_answer_shape"""

SQL["fx_answer_texts"] = """
SELECT *, CASE WHEN read_error IS NULL THEN CASE shape WHEN 'truncated' THEN decision[1:60]
  WHEN 'prose' THEN 'Here is the answer:' || chr(10) || decision || chr(10) || 'Done.'
  WHEN 'fenced' THEN '```json' || chr(10) || decision || chr(10) || '```'
  WHEN 'list' THEN '[' || decision || ', 1]' WHEN 'trailing' THEN decision || ' and more' ELSE decision END END AS answer
FROM fx_answers"""


@query(
    "response_text",
    views("fx_answer_texts") + "SELECT event_id, trim(answer) AS text, read_error FROM fx_answer_texts",
)
def response_text(spark, d):
    return texts(spark, d).select("event_id", "text", "read_error")


@query(
    "parse_model_json",
    views("fx_answers")
    + """, k AS (SELECT *, read_error IS NULL AS readable, shape IN ('plain', 'fenced', 'list') AS clean FROM fx_answers)
SELECT event_id, readable AND clean AS none_ok, readable AND shape <> 'truncated' AS prefix_ok,
  readable AND shape <> 'truncated' AS slice_ok,
  CASE WHEN readable AND shape <> 'truncated' THEN 'seen {' || event_type || '} once' END AS short_reason,
  CASE WHEN NOT (readable AND clean) THEN 'invalid JSON' END AS none_error FROM k""",
)
def parse_model_json(spark, d):
    """Clean, recovered by prefix, recovered by slice: what each level makes of the same answers."""
    parsed = texts(spark, d).select("event_id", model_text.parse_at_levels(F.col("text"), ["none", "prefix", "slice"]).alias("_p")).select("event_id", "_p.*")
    return parsed.select(
        "event_id",
        *[F.col(f"{level}.error").isNull().alias(f"{level}_ok") for level in ("none", "prefix", "slice")],
        model_text.plain_text(model_text.field(F.col("prefix.value"), "short_reason")).alias("short_reason"),
        F.col("none.error").alias("none_error"),
    )


def decisions(spark, d):
    parsed = texts(spark, d).withColumn("_p", model_text.parse_model_json(F.col("text"), "prefix"))
    judged = parsed.withColumn("_d", model_text.parse_decision(F.col("_p.value")))
    flags = {n: F.col(f"_d.{n}") for n in model_text.DECISION_FLAGS}
    return judged.select("event_id", *[c.alias(n) for n, c in flags.items()], F.col("_d.short_reason").alias("short_reason"))


SQL["fx_decisions"] = """
SELECT event_id, CASE WHEN ok THEN recognizable END AS recognizable_from_mask_only, CASE WHEN ok THEN clear_image END AS clear_not_blurry,
  CASE WHEN ok THEN cropped END AS severe_crop, CASE WHEN ok THEN interactive END AS interactive_object,
  CASE WHEN ok THEN passed END AS "pass", CASE WHEN ok THEN 'seen {' || event_type || '} once' END AS short_reason
FROM (SELECT *, read_error IS NULL AND shape <> 'truncated' AS ok FROM fx_answers )"""


@query("parse_decisions", views("fx_decisions") + "SELECT * FROM fx_decisions")
def parse_decisions(spark, d):
    return decisions(spark, d)


@query(
    "decision_reasons",
    views("fx_decisions")
    + """SELECT event_id, CASE WHEN "pass" IS NULL THEN NULL WHEN reasons = '' AND NOT "pass" THEN 'model_rejected' ELSE reasons END AS reasons FROM (
SELECT event_id, "pass", array_to_string(list_filter([
  CASE WHEN NOT recognizable_from_mask_only THEN 'not_recognizable_from_mask_only' END,
  CASE WHEN NOT clear_not_blurry THEN 'not_clear' END, CASE WHEN severe_crop THEN 'severe_crop' END,
  CASE WHEN NOT interactive_object THEN 'non_interactive_object' END], lambda r: r IS NOT NULL), ',') AS reasons
FROM fx_decisions )""",
)
def decision_reasons(spark, d):
    reasons = model_text.decision_reasons(*[F.col(n) for n in model_text.DECISION_FLAGS])
    return decisions(spark, d).select(
        "event_id", F.when(F.col("pass").isNotNull(), F.array_join(reasons, ",")).alias("reasons")
    )


WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}|{WS}$', '', 'g')"


def sql_normalized(text: str) -> str:
    line = f"regexp_replace(regexp_replace({sql_strip(text)}, '{WS}', ' ', 'g'), '^[-*]+', '')"
    line = sql_strip(f"regexp_replace({line}, '^(1\\.)?(2\\.)?(3\\.)?', '')")
    return f"""regexp_replace({line}, '^[ \\t\\n\\r"]+|[ \\t\\n\\r"]+$', '', 'g')"""


@query(
    "normalize_instructions",
    views("fx_instructions") + f"SELECT conv_id, turn, {sql_normalized('raw')} AS instruction FROM fx_instructions",
)
def normalize_instructions(spark, d):
    return t.raw_instructions(spark, d).select(
        "conv_id", "turn", model_text.normalize_instruction(F.col("raw")).alias("instruction")
    )


# Each turn is given twice, the second time in other letters, and every third conversation gives nothing.
SQL["fx_given"] = """
SELECT conv_id, turn * 2 + twice AS pos, CASE WHEN conv_id % 3 = 0 THEN ' - ' WHEN twice = 1 THEN translate(raw, 'AEIOU', 'aeiou') ELSE raw END AS raw
FROM fx_instructions , range(2) r(twice)"""

_FIELDS = {"object": "'sofa bed'", "part": "'arm rest'", "prompt": "'the arm rest of the sofa bed'"}


@query(
    "complete_instructions",
    views("fx_given")
    + f""", a AS (SELECT conv_id, 0 AS source, pos, {sql_normalized('raw')} AS txt FROM fx_given
  UNION ALL SELECT DISTINCT conv_id, 1, i, [{', '.join(sql_fill(x, _FIELDS) for x in fixed.FALLBACK_INSTRUCTIONS)}][i + 1]
    FROM conversations, range(3) r(i)),
u AS (SELECT conv_id, arg_min(txt, [source, pos]) AS txt, min([source, pos]) AS place FROM a WHERE txt <> '' GROUP BY conv_id, lower(txt)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS n FROM u)
SELECT conv_id, n - 1 AS instruction_pos, txt AS instruction, place[1] = 1 AS is_fallback FROM r WHERE n <= 3""",
)
def complete_instructions(spark, d):
    raw = t.raw_instructions(spark, d).withColumn("twice", F.explode(F.array(F.lit(0), F.lit(1))))
    text = (
        F.when(F.col("conv_id") % 3 == 0, F.lit(" - "))
        .when(F.col("twice") == 1, F.translate(F.col("raw"), "AEIOU", "aeiou"))
        .otherwise(F.col("raw"))
    )
    given = raw.select("conv_id", (F.col("turn") * 2 + F.col("twice")).alias("pos"), text.alias("raw"))
    parts = raw.select("conv_id").distinct().withColumns(
        {
            "object_name": F.lit("sofa_bed"),
            "part_name": F.lit("arm_rest"),
            "prompt": F.lit("the arm rest of the sofa bed"),
        }
    )
    return prompts.complete_instructions(given, parts, 3, "conv_id")


# Parts a user asks for, and parts that answers speak of under loosely written names.
SQL["fx_named"] = """
SELECT user_id AS object_id, event_id AS pos,
  CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN '  ' || event_type || ' Part ' WHEN 2 THEN event_type || '  part' ELSE '   ' END AS part_name
FROM events"""


def named_parts(spark, d):
    e = F.col("event_id") % 4
    name = (
        F.when(e == 0, F.col("event_type"))
        .when(e == 1, F.concat(F.lit("  "), "event_type", F.lit(" Part ")))
        .when(e == 2, F.concat("event_type", F.lit("  part")))
        .otherwise(F.lit("   "))
    )
    return t.table(spark, d, "events").select(
        F.col("user_id").alias("object_id"), F.col("event_id").alias("pos"), name.alias("part_name")
    )


@query(
    "normalize_parts",
    views("fx_named")
    + f""", u AS (SELECT object_id, {sql_slug_ws('part_name')} AS slug, min(pos) AS pos FROM fx_named WHERE trim(part_name) <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY pos) AS n FROM u)
SELECT object_id, n - 1 AS part_pos, slug AS part_name, 'the ' || {sql_humanize('slug')} || ' of the big chair' AS prompt FROM r WHERE n <= 5""",
)
def normalize_parts(spark, d):
    named = named_parts(spark, d).withColumn("category_name", F.lit("big_chair"))
    return prompts.normalize_parts(named, 5).select(
        "object_id", F.col("part_pos").cast("bigint").alias("part_pos"), "part_name", "prompt"
    )


@query(
    "join_responses",
    views("fx_named")
    + f""", s AS (SELECT DISTINCT user_id AS object_id, event_type AS part_name FROM events),
a AS (SELECT object_id, {sql_slug_ws('part_name')} AS slug, arg_min(pos, pos) AS pos FROM fx_named WHERE pos % 3 <> 0 GROUP BY ALL)
SELECT s.object_id, s.part_name, CASE WHEN pos IS NULL THEN '' ELSE 'hold it ' || pos || '|lift it' END AS instructions,
  CASE WHEN pos IS NULL THEN 0 ELSE 2 END::BIGINT AS num_instructions
FROM s LEFT JOIN a ON a.object_id = s.object_id AND a.slug = {sql_slug_ws('s.part_name')}""",
)
def join_responses(spark, d):
    seeds = t.table(spark, d, "events").select(F.col("user_id").alias("object_id"), F.col("event_type").alias("part_name")).distinct()
    given = F.array(F.concat(F.lit("hold it "), F.col("pos").cast("string")), F.lit("lift it"))
    answered = named_parts(spark, d).filter("pos % 3 <> 0").withColumn("instructions", given)
    joined = prompts.join_responses(seeds, answered)
    return joined.select(
        "object_id", "part_name", F.array_join("instructions", "|").alias("instructions"),
        F.size("instructions").cast("bigint").alias("num_instructions"),
    )


@query(
    "prompt_reuse",
    """SELECT doc_id AS object_id, doc_id % 4 IN (0, 1) AS reused,
  CASE doc_id % 4 WHEN 0 THEN '{"parts": [], "doc": ' || doc_id || '}' WHEN 1 THEN '{"doc": ' || doc_id || '}'
  ELSE '{"parts": [{"part_name": "' || source || '"}]}' END AS record FROM documents""",
)
def prompt_reuse(spark, d):
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("object_id"), "source")
    text, kind = F.col("object_id").cast("string"), F.col("object_id") % 4
    record = (
        F.when(kind == 0, F.concat(F.lit('{"parts": [], "doc": '), text, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"doc": '), text, F.lit("}")))
        .otherwise(F.concat(F.lit('{"parts": "'), text))
    )
    stored = docs.filter(kind != 3).select("object_id", record.alias("record"))
    fresh = F.concat(F.lit('{"parts": [{"part_name": "'), "source", F.lit('"}]}'))
    return prompts.reuse_prompts(docs.select("object_id"), stored, docs.select("object_id", fresh.alias("record")))


@query(
    "pluggable_scorer",
    """SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN event_id % 50 = 0 THEN 3 WHEN event_id % 20 = 10 THEN 2 ELSE 1 END::BIGINT AS attempts,
  CASE WHEN event_id % 50 = 0 THEN 'no answer for ' || event_id END AS error,
  CASE WHEN event_id % 50 <> 0 THEN round(value / 500, 6) END AS score,
  CASE WHEN event_id % 50 <> 0 THEN value >= 50 END AS accepted FROM events""",
)
def pluggable_scorer(spark, d):
    """A caller's function that fails now and then: some rows succeed on the second try, some never do."""

    def infer(row: dict, attempt: int) -> dict:
        key = row["event_id"]
        if key % 50 == 0 or (key % 20 == 10 and attempt == 1):
            raise ValueError(f"no answer for {key}")
        return {"score": row["value"] / 500, "accepted": bool(row["value"] >= 50)}

    result = StructType([StructField("score", DoubleType()), StructField("accepted", BooleanType())])
    rows = t.table(spark, d, "events").select("event_id", "value")
    scored = inference.pluggable_scorer(rows, infer, result, RetryConfig(max_attempts=3, backoff_seconds=0.0))
    return scored.select(
        "event_id", "status", F.col("attempts").cast("bigint").alias("attempts"), "error", t.r6("score").alias("score"), "accepted"
    )


@query(
    "failure_rows",
    """SELECT user_id AS object_id, count(*) AS num_failed, min('missing key: k in ' || event_id) AS first_error FROM events
WHERE event_id % 6 = 1 GROUP BY user_id""",
)
def failure_rows(spark, d):
    """Rows whose work fails become (`object_id`, `error`) rows and the others go on."""
    events = t.table(spark, d, "events")
    props = F.when(F.col("event_id") % 6 == 1, F.lit('{"other": 1}')).otherwise(F.lit('{"k": 1}'))
    value = model_text.field(F.try_parse_json(props), "k")
    error = F.when(value.isNull(), F.concat(F.lit("missing key: k in "), F.col("event_id").cast("string")))
    results = events.select(F.col("user_id").alias("object_id"), "event_id", error.alias("error"))
    _, failed = packaging.split_failures(results)
    return failed.groupBy("object_id").agg(F.count(F.lit(1)).alias("num_failed"), F.min("error").alias("first_error"))


@query(
    "valid_objects",
    """SELECT DISTINCT user_id AS object_id FROM events SEMI JOIN (SELECT user_id FROM events WHERE event_type = 'click') USING (user_id)
SEMI JOIN (SELECT user_id FROM events WHERE value > 150) USING (user_id)""",
)
def valid_objects(spark, d):
    events = t.table(spark, d, "events").select(F.col("user_id").alias("object_id"), "event_type", "value")
    kind = F.when(F.col("event_type") == "click", "visualization").otherwise("other")
    parts = events.select("object_id", F.when(F.col("value") > 150, F.col("event_type")).alias("part_name"))
    return packaging.valid_objects(events.select("object_id").distinct(), events.withColumn("kind", kind), parts)


