"""The preprocessing pipeline: six optional steps in a fixed order, with the failing step named in the record."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import chunk, structure, text

#: The steps in their order.
STEPS = ("unicode_normalization", "text_cleaning", "ocr_correction", "chunking", "feature_extraction", "metadata_cleanup")
#: Steps that change the text; each takes and gives a column.
TEXT_STEPS: dict[str, Callable[[Column], Column]] = {"unicode_normalization": text.normalize_unicode, "text_cleaning": text.clean_text, "ocr_correction": text.correct_ocr}


def process(docs: DataFrame, column: str = "text", metadata: str | None = None, steps: Sequence[str] = STEPS, ocr: bool = True, corrections: dict[str, str] | None = None, chunk_size: int | None = None, chunk_overlap: int | None = None) -> DataFrame:
    """docs with `result`: struct(original_text, cleaned_text, chunks, features, cleaned_metadata, steps_applied, error).

    Steps run in the order given; unknown names do nothing. A step that can't run, because a row's text is null or its
    parameters don't fit, ends the row's pipeline: the error names it, the steps before it stay listed and their results kept,
    and cleaned_text is empty. metadata: a column of type map<string,string>.
    """
    made = {**TEXT_STEPS, "ocr_correction": lambda c: text.correct_ocr(c, corrections)}
    c, done = F.col(column), []
    chunks, features = F.array().cast("array<string>"), F.lit(None).cast(text.FEATURES)
    cleaned, error = F.create_map().cast("map<string,string>"), F.lit("")
    rows, failed = docs, None
    for step in steps:
        if step in TEXT_STEPS and (step != "ocr_correction" or ocr):
            # A column of its own, so later steps refer to the result and don't repeat its expression.
            rows = rows.withColumn("__text", made[step](c))
            c = F.col("__text")
        elif step == "chunking":
            try:
                chunks = chunk.chunks(c, chunk_size, chunk_overlap)
            except ValueError as e:
                failed = f"Pipeline failed at 'chunking': {e}"
                break
        elif step == "feature_extraction":
            rows = rows.withColumn("__words", text.words(c))
            features = text.features(c, F.col("__words"))
        elif step == "metadata_cleanup":
            cleaned = structure.clean_metadata(F.col(metadata)) if metadata else cleaned
        else:
            continue
        done.append(step)
    first = next((s for s in steps if s in STEPS[:5] and (s != "ocr_correction" or ocr)), None)
    is_null = F.col(column).isNull() if first else F.lit(False)
    before = [s for s in done if first is None or done.index(s) < done.index(first)] if first in done else done
    error = F.when(is_null, f"Pipeline failed at '{first}': the text is null").otherwise(F.lit(failed or ""))
    names = lambda s: F.array(*map(F.lit, s)).cast("array<string>")
    result = F.struct(
        F.col(column).alias("original_text"),
        F.when(error == "", c).otherwise("").alias("cleaned_text"),
        F.when(is_null, F.array().cast("array<string>")).otherwise(chunks).alias("chunks"),
        F.when(~is_null, features).alias("features"),
        F.coalesce(cleaned, F.create_map().cast("map<string,string>")).alias("cleaned_metadata"),
        F.when(is_null, names(before)).otherwise(names(done)).alias("steps_applied"),
        error.alias("error"),
    )
    return rows.withColumn("result", result).drop("__text", "__words")


def stored_text(result: Column, raw: Column) -> Column:
    """What the document store keeps: the cleaned text, or the raw one where cleaning leaves nothing."""
    return F.when(F.coalesce(result["cleaned_text"], F.lit("")) != "", result["cleaned_text"]).otherwise(raw)
