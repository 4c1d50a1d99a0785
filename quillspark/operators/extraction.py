"""Structured extraction: schema registry, validation, field confidence, the guarded result with its fallback scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.config import DEFAULTS
from quillspark.functions import structure, text
from quillspark.sources import files


@dataclass(frozen=True)
class SchemaField:
    """One field: its type in DDL and its default; required if there is no default."""

    name: str
    ddl: str = "string"
    default: Any = None

    @property
    def optional(self) -> bool:
        return self.default is not None


@dataclass
class Registry:
    """Schemas by name. `custom` takes any object and has no fields of its own."""

    schemas: dict[str, list[SchemaField]] = field(default_factory=lambda: {"custom": []})

    def register(self, name: str, fields: list[SchemaField]) -> None:
        self.schemas[name] = list(fields)

    def fields(self, name: str) -> list[SchemaField]:
        if name not in self.schemas:
            raise KeyError(f"unknown schema type {name!r}")
        return self.schemas[name]

    def field_names(self, name: str) -> list[str]:
        return [f.name for f in self.fields(name)]

    def defaults(self, name: str) -> dict[str, Any]:
        return {f.name: f.default for f in self.fields(name)}

    def types(self) -> list[str]:
        return sorted(self.schemas)


REGISTRY = Registry()


def _member(data: Column, name: str, ddl: str = "string") -> Column:
    """A member of JSON text as a type; null if it is absent, null or of another type."""
    return F.try_variant_get(F.try_parse_json(data), f"$['{name}']", ddl)


def _present(data: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(data), F.lit(name)), F.lit(False))


def validation_errors(data: Column, fields: list[SchemaField]) -> Column:
    """`name: message` of each field that is missing or has another type than its schema says; data: JSON text.

    What isn't an object has one error, whatever the schema.
    """
    parsed = F.try_parse_json(data)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))
    tests = []
    for f in fields:
        missing = ~_present(data, f.name)
        wrong = _present(data, f.name) & (_member(data, f.name, f.ddl).isNull() if f.ddl != "string" else ~F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$['{f.name}']", "variant")) == "STRING", F.lit(False)))
        tests.append(F.when(F.lit(not f.optional) & missing, f"{f.name}: Field required").when(wrong, f"{f.name}: Input should be a valid {f.ddl}"))
    errors = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return F.when(is_object, errors).otherwise(F.array(F.lit("Input should be a valid dictionary")))


def field_scores(data: Column, fields: list[SchemaField]) -> Column:
    """array of struct(name, populated, score): a filled field 1, an empty optional one 0.5, an empty required one 0.

    Null, "", [], {}, 0 and false are empty here.
    """
    if not fields:
        return F.array().cast("array<struct<name:string,populated:boolean,score:double>>")
    out = []
    for f in fields:
        value = F.try_variant_get(F.try_parse_json(data), f"$['{f.name}']", "variant")
        shown = F.coalesce(F.to_json(value), F.lit("null"))
        populated = ~(shown.isin('""', "[]", "{}", "null", "false") | F.regexp_like(shown, F.lit(r"^-?0(\.0+)?([eE][+-]?\d+)?$")))
        out.append(F.struct(F.lit(f.name).alias("name"), populated.alias("populated"), F.when(populated, 1.0).otherwise(0.5 if f.optional else 0.0).alias("score")))
    return F.array(*out)


def enriched(data: Column, schema: str = "custom", registry: Registry = REGISTRY) -> Column:
    """struct(success, data, confidence, fields, validation_errors) of JSON text that has been parsed."""
    fields = registry.fields(schema)
    scores, errors = field_scores(data, fields), validation_errors(data, fields)
    return F.struct(
        (F.size(errors) == 0).alias("success"),
        data.alias("data"),
        structure.mean_confidence(F.transform(scores, lambda x: x["score"])).alias("confidence"),
        scores.alias("fields"),
        errors.alias("validation_errors"),
    )


#: The object that stands for an extraction that gave nothing, and the scores of its causes.
GENERIC = '{"document_type":"","extracted_data":{}}'
TEXT_DUMP, NO_DATA, NO_MODEL = 0.20, 0.15, 0.0


def extract(answers: DataFrame, schema: str = "custom", raw: str = "answer", registry: Registry = REGISTRY) -> DataFrame:
    """answers with `result`: parsed, repaired where needed, validated and scored; an error instead where nothing parses."""
    given = F.coalesce(F.col(raw), F.lit("")) != ""
    rows = answers.withColumn("__parsed", F.when(given, structure.parse_json(F.col(raw))))
    e = enriched(F.col("__parsed"), schema, registry)
    ok = F.col("__parsed").isNotNull()
    error = F.when(~given, "no input: neither an answer nor a working model").when(~ok, "no JSON in the answer after all repairs").otherwise(F.lit(""))
    result = F.struct(
        (ok & e["success"]).alias("success"),
        F.when(ok, e["data"]).alias("data"),
        F.when(ok, e["confidence"]).otherwise(0.0).alias("confidence"),
        F.when(ok, e["fields"]).otherwise(F.array().cast("array<struct<name:string,populated:boolean,score:double>>")).alias("fields"),
        F.when(ok, e["validation_errors"]).otherwise(F.array().cast("array<string>")).alias("validation_errors"),
        (ok & structure.parse_directly(F.col(raw)).isNull()).alias("repaired"),
        error.alias("error"),
    )
    return rows.withColumn("result", result).drop("__parsed")


def string_fields(data: Column) -> tuple[Column, Column]:
    """(map of the members that are strings, whether any member is an object or a list) of extracted_data or else of all."""
    inner = F.get_json_object(data, "$.extracted_data")
    held = F.when(F.startswith(F.ltrim(inner), F.lit("{")), inner).otherwise(data)
    members = F.from_json(held, "map<string,string>")
    nested = F.exists(F.map_values(members), lambda v: F.coalesce(F.regexp_like(v, F.lit(r"^[\[{]")), F.lit(False)))
    return members, nested


def guarded(rows: DataFrame, raw: str = "answer", original: str = "text", available: Column | None = None, failure: Column | None = None, schema: str = "custom", registry: Registry = REGISTRY) -> DataFrame:
    """rows with structured_json, confidence_score and error_message of the final record.

    An answer with data is kept with the score of its filled fields, unless it merely repeats the text: then, as with no
    data, no model (available false) or a failed call (failure not null), the generic object stands for it, with that
    cause's score.
    """
    has_model = F.lit(True) if available is None else F.coalesce(available, F.lit(False))
    fail = F.lit(None).cast("string") if failure is None else failure
    out = extract(rows, schema, raw, registry)
    data = F.col("result.data")
    members, nested = string_fields(data)
    good = F.col("result.success") & F.coalesce(F.size(F.json_object_keys(data)) > 0, F.lit(False))
    dump = structure.copies_text(members, nested, F.substring(F.col(original), 1, DEFAULTS.model_chars))
    tier = structure.confidence_tier(members)
    keep = fail.isNull() & has_model & good & ~F.coalesce(dump, F.lit(False))
    score = F.when(fail.isNotNull() | ~has_model, NO_MODEL).when(~good, NO_DATA).when(F.coalesce(dump, F.lit(False)), TEXT_DUMP).otherwise(structure.clamp(F.coalesce(tier, F.lit(0.0))))
    return out.withColumns(
        {
            "structured_json": F.when(keep, data).otherwise(F.lit(GENERIC)),
            "confidence_score": score.cast("double"),
            "error_message": F.when(fail.isNotNull(), F.concat(F.lit("AI inference failed: "), fail)).otherwise(F.lit("")),
        }
    )


def extract_with_model(docs: DataFrame, model: Callable[[str], str] | None, prompt: Callable[[Column], Column] | None = None, schema: str = "custom", text_column: str = "text", key: str = "doc_id", **retry) -> DataFrame:
    """doc_id, answer, structured_json, confidence_score, error_message: the model's answer to each text's prompt, guarded."""
    body = text.truncate_for_model(F.col(text_column))
    asked = docs.select(F.col(key).cast("long").alias("doc_id"), (prompt(body) if prompt else body).alias("prompt"), F.col(text_column).alias("text"))
    rows = files.infer(asked, model, "prompt", "doc_id", "text", **retry)
    out = guarded(rows, "answer", "text", F.lit(model is not None), F.when(F.lit(model is not None), F.col("error")), schema)
    return out.select("doc_id", "answer", "structured_json", "confidence_score", "error_message")
