"""Prompts for, and answers from, a text model: everything as string and VARIANT expressions."""

from __future__ import annotations

import string
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from partloom import fixed_values as fixed
from partloom.functions.names import collapse, humanize, mime_type, strip

RESPONSE_SCHEMA = "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often `body` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fill(template: str, fields: Mapping[str, Column]) -> Column:
    """A `str.format` template as one `concat` of literals and columns."""
    pieces: list[Column] = []
    for text, field, _, _ in string.Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if field is not None:
            pieces.append(fields[field].cast("string"))
    return F.concat(*pieces)


def category_prompt(category: Column) -> Column:
    return fill(fixed.CATEGORY_PROMPT, {"category": category})


def candidate_prompt(category: Column) -> Column:
    return fill(fixed.CANDIDATE_PROMPT, {"category": category})


def part_list_prompt(category: Column, max_parts: int = 5) -> Column:
    seat = F.concat(F.lit("the seat of the "), humanize(category))
    return fill(fixed.PART_PROMPT, {"category": category, "max_parts": F.lit(max_parts), "seat_prompt": seat})


def consistency_prompt(category: Column, parts: Column) -> Column:
    """`parts` is an ordered array of (part_name, prompt, base_prompt) structs."""

    def quoted(text: Column) -> Column:
        return F.regexp_replace(F.to_json(F.struct(text.alias("t"))), r'^\{"t":|\}$', "")

    item = lambda p: F.concat(
        F.lit('{"part_name": '), quoted(p["part_name"]),
        F.lit(', "prompt": '), quoted(p["prompt"]),
        F.lit(', "base_prompt": '), quoted(p["base_prompt"]), F.lit("}"),
    )
    listed = F.concat(F.lit("["), F.array_join(F.transform(parts, item), ", "), F.lit("]"))
    return fill(fixed.CONSISTENCY_PROMPT, {"category": category, "parts_json": listed})


def instruction_prompt(obj: Column, parts: Column, per_part: int = 3, max_words: int = 14) -> Column:
    """`parts` is an ordered array of (part_name, prompt) structs."""
    line = lambda p: fill(fixed.PART_LINE, {"part": p["part_name"], "prompt": p["prompt"]})
    return fill(
        fixed.INSTRUCTION_PROMPT,
        {
            "object": humanize(obj),
            "per_part": F.lit(per_part),
            "max_words": F.lit(max_words),
            "part_lines": F.array_join(F.transform(parts, line), "\n"),
        },
    )


def one_line_base64(content: Column) -> Column:
    return F.translate(F.base64(content), "\r\n", "")


def image_part(path: Column, content: Column) -> Column:
    return F.struct(
        F.lit(None).cast("string").alias("text"),
        F.struct(mime_type(path).alias("mime_type"), one_line_base64(content).alias("data")).alias("inline_data"),
    )


def text_part(text: Column) -> Column:
    return F.struct(
        text.alias("text"),
        F.lit(None).cast("struct<mime_type:string,data:string>").alias("inline_data"),
    )


def request_payload(parts: Column, role: str | None = None) -> Column:
    """JSON request: `parts` in order, as a single content entry. Null fields are left out."""
    entry = [parts.alias("parts")]
    if role:
        entry.insert(0, F.lit(role).alias("role"))
    return F.to_json(
        F.struct(
            F.array(F.struct(*entry)).alias("contents"),
            F.struct(F.lit("application/json").alias("responseMimeType")).alias("generationConfig"),
        )
    )


def response_text(response: Column, *, strip_first: bool = True) -> Column:
    """`struct(text, error)`: the joined text parts of the first candidate.

    `strip_first` tells whether blank text counts as missing; the candidate reader tests before it strips.
    """
    parts = F.get(F.from_json(response, RESPONSE_SCHEMA)["candidates"], F.lit(0))["content"]["parts"]
    joined = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "")

    def judge(raw: Column) -> Column:
        tested = strip(raw) if strip_first else raw
        error = F.when(raw.isNull(), F.lit("unsupported response structure")).when(
            tested == "", F.lit("response content must include text")
        )
        return F.struct(F.when(tested != "", strip(raw)).alias("text"), error.alias("error"))

    return let(joined, judge)


def unfence(text: Column) -> Column:
    """The inside of a leading ``` fence without its `json` tag."""
    inside = strip(F.regexp_replace(F.get(F.split(text, "```"), F.lit(1)), "^json", ""))
    return F.when(text.startswith("```"), inside).otherwise(text)


def whole_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else, else null.

    The parser ignores what follows the first value, so the text is read inside an array and inside an
    object: trailing text breaks at least one of the two.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return let(in_object, lambda o: F.when(o.isNotNull() & in_array.isNotNull(), F.try_variant_get(o, "$.v", "variant")))


def _from_first(text: Column, mark: str) -> Column:
    """Value that starts at the first `mark`, whatever follows it."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.try_parse_json(F.substring(text, at, F.length(text))))


def _outermost(text: Column) -> Column:
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))


def is_kind(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def parse_model_json(text: Column, recovery: str = "none") -> Column:
    """`struct(value, error)` of a model answer; `value` is a VARIANT object.

    `none` accepts only clean JSON (category answers), `prefix` also a value after leading text or before
    trailing text (candidate and part answers), `slice` tries the text from its start, then from its first
    `{` to its last `}` (instruction answers). A list stands for its first element.
    """
    return parse_at_levels(text, [recovery])[recovery]


def parse_at_levels(text: Column, levels: Sequence[str]) -> Column:
    """`parse_model_json` at several levels, as a struct of that name each; what they share is computed once."""
    def found(value: Column, kind: Column | str) -> Column:
        return F.struct(value.alias("value"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))

    def prefix(body: Column, whole: Column) -> Column:
        from_list = found(_from_first(body, "["), "[")
        from_object = let(_from_first(body, "{"), lambda o: F.when(o.isNotNull(), found(o, "{")).otherwise(from_list))
        return F.when(whole.isNotNull(), found(whole, F.substring(body, 1, 1))).otherwise(from_object)

    def outer(body: Column, whole: Column | None) -> Column:
        # Clean JSON is also what starts the text.
        return let(
            F.try_parse_json(body) if whole is None else F.coalesce(whole, F.try_parse_json(body)),
            lambda w: F.when(w.isNotNull(), found(w, F.substring(body, 1, 1))).otherwise(found(_outermost(body), "{")),
        )

    # The kind of a value shows in the first character of its text.
    readers = {
        "none": lambda body, whole: found(whole, F.substring(body, 1, 1)),
        "prefix": prefix,
        "slice": outer,
    }

    def judge(parsed: Column) -> Column:
        value, listed = parsed["value"], parsed["kind"] == "["
        head = F.when(listed, F.try_variant_get(value, "$[0]", "variant")).otherwise(value)

        def verdict(first: Column) -> Column:
            fits = F.when(value.isNull(), False).when(listed, is_kind(first, "OBJECT")).otherwise(parsed["kind"] == "{")
            error = (
                F.when(value.isNull(), F.lit("invalid JSON"))
                .when(~fits & listed, F.lit("response JSON list must contain an object"))
                .when(~fits, F.lit("response JSON must decode to an object"))
            )
            return F.struct(F.when(fits, first).alias("value"), error.alias("error"))

        return let(head, verdict)

    def every(body: Column) -> Column:
        def read(whole: Column | None) -> Column:
            return F.struct(*[let(readers[n](body, whole), judge).alias(n) for n in levels])

        return read(None) if set(levels) == {"slice"} else let(whole_json(body), read)

    return let(unfence(strip(F.coalesce(text, F.lit("")))), every)


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def truthy(value: Column) -> Column:
    """Whether a JSON value counts as true: the string "false" does, empty and zero values do not."""
    text = F.to_json(value)
    # JSON texts that count as false.
    return ~text.isin("false", "null", '""', "[]", "{}", "0", "-0", "0.0", "-0.0")


def plain_text(value: Column) -> Column:
    """Text of a JSON value, strings without their quotes."""
    return F.try_variant_get(value, "$", "string")


DECISION_FLAGS = ("recognizable_from_mask_only", "clear_not_blurry", "severe_crop", "interactive_object", "pass")


def parse_decision(value: Column, flags: tuple[str, ...] = DECISION_FLAGS) -> Column:
    """`struct(<flags>, short_reason, error)`; every key is required."""

    def judge(found: Column) -> Column:
        error = F.when(found.isNull(), F.lit("no object"))
        for name in (*flags, "short_reason"):
            error = error.when(field(found, name).isNull(), F.lit(f"missing key: {name}"))

        def report(problem: Column) -> Column:
            columns = [F.when(problem.isNull(), truthy(field(found, name))).alias(name) for name in flags]
            reason = F.when(problem.isNull(), plain_text(field(found, "short_reason")))
            return F.struct(*columns, reason.alias("short_reason"), problem.alias("error"))

        return let(error, report)

    return let(value, judge)


def decision_reasons(recognizable: Column, clear: Column, cropped: Column, interactive: Column, passed: Column) -> Column:
    """Ordered reason codes of a decision; `model_rejected` only if nothing else explains a rejection."""
    listed = F.array(
        F.when(~recognizable, F.lit("not_recognizable_from_mask_only")),
        F.when(~clear, F.lit("not_clear")),
        F.when(cropped, F.lit("severe_crop")),
        F.when(~interactive, F.lit("non_interactive_object")),
    )
    lone = F.array(F.lit("model_rejected"))
    return let(
        F.filter(listed, lambda r: r.isNotNull()),
        lambda reasons: F.when(~passed & (F.size(reasons) == 0), lone).otherwise(reasons),
    )


def normalize_instruction(text: Column) -> Column:
    """One clean line: no list marks, no leading `1.` `2.` `3.` (each once, in this order, without gaps), no quotes."""
    line = F.regexp_replace(collapse(text), r"^[-*]+", "")
    line = strip(F.regexp_replace(line, r"^(1\.)?(2\.)?(3\.)?", ""))
    return F.regexp_replace(line, r'^[ \t\n\r"]+|[ \t\n\r"]+$', "")


def fallback_instructions(obj: Column, part: Column, prompt: Column, count: int) -> Column:
    """The first `count` fallback commands, in order."""
    fields = {"object": humanize(obj), "part": humanize(part), "prompt": prompt}
    return F.array(*[fill(t, fields) for t in fixed.FALLBACK_INSTRUCTIONS[: max(count, 0)]])
