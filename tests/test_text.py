import itertools
import json

import pytest
from pyspark.sql import functions as F

from partloom.functions import model_text, names
from partloom.operators import prompts


def column(spark, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in rows.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


def test_slugs_disagree_on_punctuation(spark):
    texts = ["  Coffee-Table!  ", "a\t b c", "", " 　 ", "__x__"]
    assert column(spark, texts, names.slug_ascii) == ["coffee_table", "a_b_c", "unknown", "unknown", "x"]
    assert column(spark, texts, names.slug_ws) == ["coffee-table!", "a_b_c", "unknown", "unknown", "__x__"]
    assert column(spark, texts, names.humanize) == ["Coffee-Table!", "a b c", "unknown", "unknown", "x"]


def test_paths(spark):
    assert column(spark, ["a/b.JPG", "a/.jpg", "b.jpeg/", "c.png", "jpg"], names.mime_type) == [
        "image/jpeg", "image/png", "image/jpeg", "image/png", "image/png",
    ]
    assert column(spark, ["dataset/x", "/dataset/x", "pipeline/outputs/a", "other"], names.canonical_path) == [
        "data/x", "/dataset/x", "research/pipeline/outputs/a", "other",
    ]
    paths = ["/a/repo/b/repo/c/d", "/a/repo", "x/repository/y", "repo/z"]
    assert column(spark, paths, lambda c: names.remap_external(c, "repo")) == ["c/d", "", None, "z"]
    urls = ["http://h/v/1.jpg", "http://h/v/2.jpg//", ""]
    assert column(spark, urls, lambda c: names.image_path(c, F.lit(7), "root/")) == [
        "root/1.jpg", "root/2.jpg", "root/000000000007.jpg",
    ]
    files = ["p/view_000_visibility.png", "p/view_x_visibility.png", "view_1_visibility.png.bak", "a_view_1_visibility.png"]
    assert column(spark, files, names.is_visibility_file) == [True, False, False, False]


def test_image_paths_are_those_of_a_plain_search(spark):
    """Odd slashes and line ends, which `$` also stops before."""
    urls = [None] + ["".join(u) for n in range(6) for u in itertools.product("a/\n\r", repeat=n)]
    rows = spark.createDataFrame([(u, i) for u in urls for i in (7, None)], "url string, id bigint")
    name = F.regexp_extract(F.coalesce("url", F.lit("")), "([^/]*)/*$", 1)
    plain = F.concat(F.lit("root/"), F.when(name == "", F.format_string("%012d.jpg", F.col("id"))).otherwise(name))
    assert rows.filter(~names.image_path(F.col("url"), F.col("id"), "root/").eqNullSafe(plain)).count() == 0


def test_view_names(spark):
    row = spark.range(1).select(names.view_names(3).alias("a"), names.view_names(0).alias("b")).first()
    assert row["a"] == ["view_000", "view_001", "view_002"] and row["b"] == []


def parse(spark, texts, level):
    rows = column(spark, texts, lambda c: F.struct(F.to_json(model_text.parse_model_json(c, level)["value"]), model_text.parse_model_json(c, level)["error"]))
    return [(json.loads(r[0]) if r[0] else None, r[1]) for r in rows]


ODD = [
    '{"a": 1}',
    '```json\n{"a": 1}\n```',
    'Sure: {"a": {"b": "}"}} end',
    '[{"a": 1}, 2]',
    "[1, 2]",
    '"text"',
    '{"a": 1',
    '{"a": 1} {"b": 2}',
    '{"a": 1}, 2',
    '{"a": 1}}',
    "",
    'x [{"a": 2}] y',
]


def test_strict_parsing(spark):
    got = parse(spark, ODD, "none")
    ok = {0: {"a": 1}, 1: {"a": 1}, 3: {"a": 1}}
    for i, (value, error) in enumerate(got):
        assert value == ok.get(i), ODD[i]
        assert (error is None) == (i in ok)
    assert got[4][1] == "response JSON list must contain an object"
    assert got[5][1] == "response JSON must decode to an object"


def test_prefix_recovery(spark):
    got = parse(spark, ODD, "prefix")
    ok = {0: {"a": 1}, 1: {"a": 1}, 2: {"a": {"b": "}"}}, 3: {"a": 1}, 7: {"a": 1}, 8: {"a": 1}, 9: {"a": 1}, 11: {"a": 2}}
    assert [v for v, _ in got] == [ok.get(i) for i in range(len(ODD))]


def test_slice_recovery(spark):
    got = parse(spark, ODD, "slice")
    ok = {0: {"a": 1}, 1: {"a": 1}, 2: {"a": {"b": "}"}}, 3: {"a": 1}, 7: {"a": 1}, 8: {"a": 1}, 9: {"a": 1}, 11: {"a": 2}}
    assert [v for v, _ in got] == [ok.get(i) for i in range(len(ODD))]


def test_truthiness_and_missing_keys(spark):
    base = {"recognizable_from_mask_only": "false", "clear_not_blurry": 0, "severe_crop": [], "interactive_object": None, "pass": 0.5, "short_reason": "r"}
    lacking = {k: v for k, v in base.items() if k != "pass"}
    rows = column(spark, [json.dumps(base), json.dumps(lacking), None], lambda c: model_text.parse_decision(F.try_parse_json(c)))
    assert tuple(rows[0]) == (True, False, False, False, True, "r", None)
    assert rows[1]["error"] == "missing key: pass" and rows[1]["short_reason"] is None
    assert rows[2]["error"] == "no object"


def test_response_text(spark):
    def answer(*parts):
        return json.dumps({"candidates": [{"content": {"parts": list(parts)}}]})

    texts = [answer({"text": " a"}, {"image": 1}, {"text": "b "}), answer({"text": "  "}), "{}", "not json", answer()]
    assert [tuple(r) for r in column(spark, texts, model_text.response_text)] == [
        ("a" + "b", None),
        (None, "response content must include text"),
        (None, "unsupported response structure"),
        (None, "unsupported response structure"),
        (None, "response content must include text"),
    ]
    assert tuple(column(spark, [texts[1]], lambda c: model_text.response_text(c, strip_first=False))[0]) == ("", None)


def test_decision_reasons(spark):
    df = spark.createDataFrame([(False, True, True, True, False), (True, True, False, True, False), (True, True, False, True, True)], "a boolean, b boolean, c boolean, d boolean, e boolean")
    got = [r[0] for r in df.select(model_text.decision_reasons(*[F.col(c) for c in "abcde"])).collect()]
    assert got == [["not_recognizable_from_mask_only", "severe_crop"], ["model_rejected"], []]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("- Open  the\tdoor ", "Open the door"),
        ("1. 2. Pull", "2. Pull"),
        ("1. 1. Grab it", "1. Grab it"),
        ("- 1. Turn", "1. Turn"),
        ("2. 1. Pull", "1. Pull"),
        ("3.1.2. Pull", "1.2. Pull"),
        ('-- "Push it"', "Push it"),
        ("1.1.1. Go", "1.1. Go"),
        ("4. Stay", "4. Stay"),
        ("  ", ""),
    ],
)
def test_normalize_instruction(spark, raw, clean):
    assert column(spark, [raw], model_text.normalize_instruction) == [clean]


def test_instructions_may_stay_short(spark):
    """Only the first n fallbacks are offered, so answers that repeat them leave gaps."""
    raw = spark.createDataFrame([("p", 0, "grab the cup by the HANDLE."), ("p", 1, "Use the handle on the cup.")], "k string, pos int, raw string")
    parts = spark.createDataFrame([("p", "cup", "handle", "the handle of the cup")], "k string, object_name string, part_name string, prompt string")
    got = prompts.complete_instructions(raw, parts, 2, "k").orderBy("instruction_pos").collect()
    assert [r["instruction"] for r in got] == ["grab the cup by the HANDLE.", "Use the handle on the cup."]
    one = prompts.complete_instructions(raw.filter("pos = 0"), parts, 1, "k").collect()
    assert [r["instruction"] for r in one] == ["grab the cup by the HANDLE."]


def test_prompts_follow_their_templates(spark):
    row = spark.range(1).select(
        model_text.part_list_prompt(F.lit("office_chair"), 4).alias("p"),
        model_text.consistency_prompt(
            F.lit("cup"),
            F.array(F.struct(F.lit("rim").alias("part_name"), F.lit('the "rim"').alias("prompt"), F.lit("b").alias("base_prompt"))),
        ).alias("c"),
    ).first()
    assert "Return at most 4 parts for the object category 'office_chair'." in row["p"]
    assert "'the seat of the office chair'" in row["p"] and '{"parts":[{"part_name":"...","prompt":"..."}]}' in row["p"]
    assert '[{"part_name": "rim", "prompt": "the \\"rim\\"", "base_prompt": "b"}]' in row["c"]


def test_levels_share_their_parsing(spark):
    texts = ["", " ", '{"a": 1}', '[{"a": 1}, 2]', "[1]", "7", '{"a": 1} more', 'so: {"a": 1}.', "```json\n{\"a\": 1}\n```", '{"a": ', "[", 'x [{"b": {}}] y', None]
    levels = ["none", "prefix", "slice"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, t string")
    shared = model_text.parse_at_levels(F.col("t"), levels)
    assert 0 < str(shared).count("parse_json") < sum(str(model_text.parse_model_json(F.col("t"), n)).count("parse_json") for n in levels)
    show = lambda c: F.struct(F.to_json(c["value"]).alias("value"), c["error"].alias("error"))
    both = df.select(shared.alias("s"), *[show(model_text.parse_model_json(F.col("t"), n)).alias(n) for n in levels])
    for r in both.select(*[show(F.col(f"s.{n}")).alias(f"s_{n}") for n in levels], *levels).collect():
        assert all(r[f"s_{n}"] == r[n] for n in levels)
