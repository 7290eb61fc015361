"""Ids, slugs, paths and short text forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The characters that count as white space when text is split or stripped.
WHITE_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

# The same characters one by one, for trimming without a regular expression.
WHITE_CHARS = "".join(
    [" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2028\u2029\u202f\u205f\u3000", *[chr(c) for c in range(0x2000, 0x200B)]]
)

# Legacy prefixes and what replaces them, first match wins.
LEGACY_PREFIXES = (
    ("pipeline/outputs/", "research/pipeline/outputs/"),
    ("dataset/", "data/"),
    ("outline/", "docs/pipeline/"),
    ("sam-3d-objects/", "third_party/sam-3d-objects/"),
    ("sam3/", "third_party/sam3/"),
    ("website/", "apps/website/"),
    ("demo-ui/", "apps/demo-ui/"),
    ("demo-data/", "apps/demo-data/"),
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_CHARS))


def collapse(text: Column, glue: str = " ") -> Column:
    """Stripped text with every run of white space turned into `glue`."""
    return F.regexp_replace(strip(text), WHITE_SPACE, glue)


def or_unknown(text: Column) -> Column:
    return F.when(text == "", F.lit("unknown")).otherwise(text)


def slug_ascii(text: Column) -> Column:
    """Letters and digits only; everything between them becomes one underscore."""
    return or_unknown(F.trim(F.regexp_replace(F.lower(text), "[^a-zA-Z0-9]+", "_"), F.lit("_")))


def slug_ws(text: Column) -> Column:
    """Only white space becomes an underscore; punctuation stays."""
    return or_unknown(collapse(F.lower(text), "_"))


def humanize(text: Column) -> Column:
    return or_unknown(collapse(F.replace(text, F.lit("_"), F.lit(" "))))


def _numbered(prefix: str, number: Column, width: int, what: str) -> Column:
    """`prefix` and the number with leading zeros; padding is much cheaper than a format call.

    The number is a whole number or its digits as text, of any length.
    """
    text = number.cast("string")
    digits = F.ltrim(text, F.lit("0"))
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))
    return F.when(text.rlike("^[0-9]+$"), F.concat(F.lit(prefix), padded)).when(
        text.isNotNull(), F.raise_error(F.lit(f"{what} must be non-negative"))
    )


def object_id(index: Column) -> Column:
    return _numbered("object_", index, 6, "index")


def stable_object_id(annotation_id: Column) -> Column:
    return _numbered("lvis_ann_", annotation_id, 8, "annotation_id")


def is_stable_object_id(value: Column) -> Column:
    return F.coalesce(value.startswith("lvis_ann_"), F.lit(False))


def part_sample_id(category: Column, obj: Column, part: Column, *, slugged: bool = False) -> Column:
    """Packaged ids join the raw names; the data specification slugs both names."""
    if slugged:
        category, part = slug_ascii(category), slug_ascii(part)
    return F.concat_ws("__", category, obj, part)


def image_path(url: Column, image_id: Column, root: str) -> Column:
    # Tried at starts of segments only and never backwards; `nullif` has it evaluated once.
    name = F.regexp_extract(F.coalesce(url, F.lit("")), "(?<![^/])([^/]*+)/*+$", 1)
    fallback = F.format_string("%012d.jpg", image_id.cast("bigint"))
    return F.concat(F.lit(root.rstrip("/") + "/"), F.coalesce(F.nullif(name, F.lit("")), fallback))


def canonical_path(path: Column, prefixes: Sequence[tuple[str, str]] = LEGACY_PREFIXES) -> Column:
    """The first legacy prefix that matches is replaced; absolute paths stay as they are."""
    if not prefixes:
        return path
    chain = F.when(path.startswith("/"), path)
    for old, new in prefixes:
        chain = chain.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30)))
    return chain.otherwise(path)


def remap_external(path: Column, root_name: str) -> Column:
    """What follows the LAST path segment equal to `root_name`; null if there is none."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    behind = F.array_position(F.reverse(parts), root_name).cast("int") - 1
    tail = F.slice(parts, F.size(parts) - behind + 1, F.greatest(behind, F.lit(0)))
    return F.when(behind >= 0, F.array_join(tail, "/"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot, empty when the name has none or starts with its only dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)/*$", 1))


def mime_type(path: Column) -> Column:
    return F.when(suffix(path).isin(".jpg", ".jpeg"), F.lit("image/jpeg")).otherwise(F.lit("image/png"))


def base_part_prompt(category: Column, part: Column) -> Column:
    return F.concat(F.lit("the "), humanize(part), F.lit(" of the "), humanize(category))


def part_prompt_or_default(prompt: Column, category: Column, part: Column) -> Column:
    return F.coalesce(F.nullif(prompt, F.lit("")), base_part_prompt(category, part))


def view_names(count: int | Column) -> Column:
    count = F.lit(count) if isinstance(count, int) else count
    last = F.greatest(count, F.lit(1)) - 1
    names = F.transform(F.sequence(F.lit(0), last), lambda i: F.format_string("view_%03d", i))
    return F.when(count > 0, names).otherwise(F.array().cast("array<string>"))


def is_visibility_file(path: Column) -> Column:
    return base_name(path).rlike(r"^view_\d+_visibility\.png$")


def stable_part_color(name: Column) -> Column:
    """Three named colours, every other part a colour from the first four hex digits of its MD5."""
    hashed = F.conv(F.substring(F.md5(name), 1, 4), 16, 10).cast("int") % 200

    def channel(step: int) -> Column:
        return 55 + (hashed * step) % 200

    def rgb(*values: int) -> Column:
        return F.array(*[F.lit(v) for v in values])

    # Colours of the three named parts and the three channel steps.
    return (
        F.when(name == "seat", rgb(255, 80, 80))
        .when(name == "backrest", rgb(80, 180, 255))
        .when(name == "armrest", rgb(120, 255, 120))
        .otherwise(F.array(channel(37), channel(67), channel(97)))
    )
