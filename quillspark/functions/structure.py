"""JSON repair, extraction confidence and detection of extractions that merely copy the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.config import DEFAULTS
from quillspark.functions.text import strip

#: Field names that announce a copy of the text.
COPY_FIELDS = [
    "text", "content", "raw_text", "extracted_text", "full_text", "document_text", "ocr_text", "plain_text", "body",
    "full_content", "document_content", "original_text", "source_text", "text_content", "complete_text", "entire_text",
    "whole_text", "verbatim_text", "raw_content", "extracted_content", "page_content", "doc_text", "document_body",
    "full_body", "transcript",
]
#: Metadata keys that stay even when empty.
ALWAYS_KEPT = ("path", "error", "extension", "file_extension", "file_name", "file_path")
#: Fixed value: the first fenced block.
FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"


def strip_fences(c: Column) -> Column:
    return F.when(F.regexp_like(c, F.lit(FENCE)), strip(F.regexp_extract(c, FENCE, 1))).otherwise(c)


def fix_literals(c: Column) -> Column:
    for old, new in (("None", "null"), ("True", "true"), ("False", "false")):
        c = F.regexp_replace(c, rf"\b{old}\b", new)
    return c


def fix_single_quotes(c: Column) -> Column:
    """Outside double-quoted strings ' becomes ". The text is cut at each unescaped double quote; even cuts are outside."""
    pieces = F.split(c, r'(?<!\\)"')
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit("'"), F.lit('"'))).otherwise(p)), '"')


def fix_bare_keys(c: Column) -> Column:
    return F.regexp_replace(c, r'(?<!")(\b[a-zA-Z_][a-zA-Z0-9_]*\b)(?=\s*:)', '"$1"')


def fix_trailing_commas(c: Column) -> Column:
    return F.regexp_replace(c, r",\s*([}\]])", "$1")


def close_truncated(c: Column) -> Column:
    def missing(a: str, b: str) -> Column:
        count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
        return F.greatest(count(a) - count(b), F.lit(0))

    return F.concat(c, F.repeat(F.lit("}"), missing("{", "}")), F.repeat(F.lit("]"), missing("[", "]")))


REPAIRS = {"fences": strip_fences, "literals": fix_literals, "single_quotes": fix_single_quotes, "bare_keys": fix_bare_keys, "trailing_commas": fix_trailing_commas, "truncated": close_truncated}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with its argument evaluated once; plain nesting would repeat the value at each use and double the plan each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repaired(c: Column) -> Column:
    for step in REPAIRS.values():
        c = let(c, step)
    return c


def first_object(c: Column) -> Column:
    """From the first { to its partner, or to the end. Depth is a running count over the pieces that closing braces end."""
    from_brace = F.when(F.instr(c, "{") > 0, F.substr(c, F.instr(c, "{"))).otherwise(F.lit(""))
    pieces = F.split(from_brace, r"(?<=\})")
    seen = F.aggregate(
        pieces,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(False).alias("done")),
        lambda a, p: F.when(a["done"], a).otherwise(
            F.struct(
                F.concat(a["out"], p).alias("out"),
                (a["depth"] + F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit(""))) - F.when(F.endswith(p, F.lit("}")), 1).otherwise(0)).alias("depth"),
                (F.endswith(p, F.lit("}")) & (a["depth"] + F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit(""))) == 1)).alias("done"),
            )
        ),
    )
    return seen["out"]


def parse_directly(t: Column) -> Column:
    """Canonical JSON text of a text that is JSON as it stands, else null. Parsed inside brackets, since the parser ignores
    what follows a complete value."""
    v = let(t, lambda x: F.try_parse_json(F.when(strip(x) != "", F.concat(F.lit("["), x, F.lit("]")))))
    return let(v, lambda x: F.when(F.try_variant_get(x, "$[1]", "variant").isNull(), F.to_json(F.try_variant_get(x, "$[0]", "variant"))))


def parse_json(c: Column) -> Column:
    """Canonical JSON text of a parsed answer: as it is, repaired, or its first object; null if none parses."""
    return F.coalesce(parse_directly(c), parse_directly(repaired(c)), parse_directly(first_object(c)))


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys, ", " and ": " between members, other characters than ASCII as they are."""
    parts = F.regexp_extract_all(F.to_json(F.try_parse_json(c)), F.lit(r'"(?:[^"\\]|\\.)*"|[^"]+'), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit('"')), p).otherwise(F.replace(F.replace(p, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": ")))), "")


def content_key(c: Column) -> Column:
    """The cache key of a JSON value: SHA-256 of its canonical form."""
    return F.sha2(canonical_json(c), 256)


def repairs_needed(c: Column) -> Column:
    """Names of the repairs that change the text, each applied to the result of those before, and `first_object` if the
    first balanced object isn't the whole text."""
    t = strip(c)
    none = F.array().cast("array<string>")

    def after(state: Column, name: str, step: Callable[[Column], Column]) -> Column:
        def compared(s: Column) -> Column:
            return let(step(s["now"]), lambda x: F.struct(x.alias("now"), F.when(x != s["now"], F.concat(s["names"], F.array(F.lit(name)))).otherwise(s["names"]).alias("names")))

        return let(state, compared)

    state = F.struct(t.alias("now"), none.alias("names"))
    for name, step in REPAIRS.items():
        state = after(state, name, step)
    found = let(first_object(t), lambda f: F.when((f != "") & (f != t), F.array(F.lit("first_object"))).otherwise(none))
    return F.concat(state["names"], found)


def objects_closed(c: Column) -> Column:
    """How often the depth of braces comes back to 0 at a closing brace."""
    pieces = F.filter(F.split(c, r"(?<=\})"), lambda p: p != "")
    seen = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed")),
        lambda a, p: let(
            a["depth"] + F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit(""))) - F.when(F.endswith(p, F.lit("}")), 1).otherwise(0),
            lambda depth: F.struct(depth.alias("depth"), (a["closed"] + F.when(F.endswith(p, F.lit("}")) & (depth == 0), 1).otherwise(0)).alias("closed")),
        ),
    )
    return seen["closed"]


def response_format(c: Column) -> Column:
    """Flags of a model's answer: empty, direct, fences, text_before, text_after, several_objects.

    direct: it begins with a brace; text before: words, but no fence, before the first one; text after: anything after
    the last closing one, a fence too; several: the depth of braces comes back to 0 more than once.
    """
    t = strip(c)
    before = F.substring(t, F.lit(1), F.instr(t, "{") - 1)
    after = F.element_at(F.split(t, r"\}"), -1)
    flags = {
        "empty": t == "",
        "direct": F.startswith(t, F.lit("{")),
        "fences": F.contains(t, F.lit("```")),
        "text_before": (F.instr(t, "{") > 1) & (strip(before) != "") & ~F.contains(before, F.lit("```")),
        "text_after": F.contains(t, F.lit("}")) & (strip(after) != ""),
        "several_objects": objects_closed(t) > 1,
    }
    return F.array_compact(F.array(*[F.when(f, n) for n, f in flags.items()]))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").when(score >= 0, "low").otherwise("unknown")


def clamp(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def confidence_tier(fields: Column) -> Column:
    """Score of a map of fields by how many have a value; 0 and false are values, null, blank, [] and {} are not."""
    filled = F.size(F.map_filter(fields, lambda _, v: v.isNotNull() & ~v.isin("", "[]", "{}")))
    tier = F.when(filled == 0, 0.15).when(filled == 1, 0.30).when(filled == 2, 0.55).when(filled <= 4, 0.75).otherwise(0.90)
    return F.when(fields.isNull() | (F.size(fields) == 0), 0.0).otherwise(tier)


def mean_confidence(scores: Column) -> Column:
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return F.when(F.size(scores) == 0, 0.0).otherwise(F.floor(mean * 1000 + 0.5).cast("double") / 1000)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of a that windows of it found in b cover; windows overlap by half, so it may exceed 1."""
    n = F.length(a)
    width = F.least(F.lit(100), F.floor(n / 4).cast("int"))
    stride = F.greatest(F.lit(1), F.floor(width / 2).cast("int"))
    starts = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)), stride)
    hits = F.size(F.filter(starts, lambda i: F.contains(b, F.substring(a, i + 1, width))))
    return F.when(n < 20, F.contains(b, a).cast("double")).otherwise(hits * width / n.cast("double"))


def copies_text(fields: Column, nested: Column, original: Column, threshold: float = DEFAULTS.overlap_threshold) -> Column:
    """Whether a map of string fields merely repeats the original; nested: whether any field holds an object or a list."""
    text = strip(F.lower(original))
    values, n = F.map_values(fields), F.size(fields)
    bad = F.exists(F.map_keys(fields), lambda k: F.lower(k).isin(COPY_FIELDS))
    longest = F.coalesce(F.array_max(F.transform(values, lambda v: F.length(v))), F.lit(0))
    overlapping = F.exists(values, lambda v: (F.length(v) > 50) & (overlap_ratio(F.lower(v), text) > threshold))
    return (
        F.when(F.coalesce(F.length(original), F.lit(0)) < 50, False)
        .when(n >= 8, False)
        .when(bad, True)
        .when((n <= 2) & (longest > 500), True)
        .when(longest > F.length(text) * 0.5, True)
        .when(nested, False)
        .otherwise(F.coalesce(overlapping, F.lit(False)))
    )


def clean_metadata(m: Column, strip_empty: bool = True, sort_keys: bool = True, keep: tuple[str, ...] = ALWAYS_KEPT) -> Column:
    """A map of strings: keys and values trimmed, empty values dropped, the first of equal keys (any case) kept."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct(strip(e["key"]).alias("key"), strip(e["value"]).alias("value")))
    if strip_empty:
        entries = F.filter(entries, lambda e: e["key"].isin(*keep) | ~(e["value"].isNull() | (e["value"] == "")))
    keys = F.transform(entries, lambda e: F.lower(e["key"]))
    entries = F.filter(entries, lambda e, i: F.array_position(keys, F.lower(e["key"])) == i + 1)
    return F.map_from_entries(F.array_sort(entries) if sort_keys else entries)


def clean_nested_metadata(c: Column, strip_empty: bool = True, sort_keys: bool = True, keep: tuple[str, ...] = ALWAYS_KEPT) -> Column:
    """clean_metadata for JSON text of any depth: Spark has no recursive functions, so an Arrow UDF over whole objects.

    Keys and strings are trimmed, nulls in lists dropped; an empty, zero or false value goes unless its key is kept; of
    keys that differ in case the first stays, objects under them are merged, later members winning. Null gives {}, what
    isn't an object null.
    """
    import json

    def tidy(v):
        if isinstance(v, str):
            return v.strip()
        if isinstance(v, list):
            return [tidy(x) for x in v if x is not None]
        return {str(k).strip(): tidy(x) for k, x in v.items()} if isinstance(v, dict) else v

    def merged(a: dict, b: dict) -> dict:
        both = {k: merged(a[k], b[k]) for k in a.keys() & b.keys() if isinstance(a[k], dict) and isinstance(b[k], dict)}
        return {**a, **b, **both}

    def clean(raw: str | None) -> str | None:
        if raw is None:
            return "{}"
        try:
            given = json.loads(raw)
        except ValueError:
            return None
        if not isinstance(given, dict):
            return None
        out, names = {}, {}
        for k, v in given.items():
            k, v = k.strip(), tidy(v)
            if strip_empty and not v and k not in keep:
                continue
            first = names.setdefault(k.lower(), k)
            if first not in out:
                out[first] = v
            elif isinstance(v, dict) and isinstance(out[first], dict):
                out[first] = merged(out[first], v)
        return json.dumps(out, sort_keys=sort_keys, ensure_ascii=False)

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(clean)

    return run(c)
