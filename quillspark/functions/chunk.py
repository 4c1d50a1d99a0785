"""Chunking of texts by characters, sentences and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.config import DEFAULTS
from quillspark.functions.text import strip

#: Where sentences and paragraphs part.
SENTENCE_GAP = r"(?U)(?<=[.!?])\s+(?=[A-Z0-9\"'(])"
PARAGRAPH_GAP = r"(?U)\n\s*\n"


def by_length(c: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    last = F.greatest(F.ceil((F.length(c) - size) / F.lit(float(step))), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(c, k * step + 1, F.lit(size)))


def packed(pieces: Column, size: int, separator: str) -> Column:
    """Pieces joined greedily up to size. A piece's length includes the separator if its chunk wasn't empty before it came,
    also when it then opens the next chunk."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("used"), F.lit(False).alias("any"))

    def add(a: Column, p: Column) -> Column:
        n = F.length(p) + F.when(a["any"], len(separator)).otherwise(0)
        full = a["any"] & (a["used"] + n > size)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"),
            F.when(full | ~a["any"], p).otherwise(F.concat(a["open"], F.lit(separator), p)).alias("open"),
            F.when(full, n).otherwise(a["used"] + n).alias("used"),
            F.lit(True).alias("any"),
        )

    return F.aggregate(pieces, empty, add, lambda a: F.when(a["any"], F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))


def split_clean(c: Column, gap: str) -> Column:
    return F.filter(F.transform(F.split(c, gap), strip), lambda p: p != "")


def by_sentence(c: Column, size: int, separator: str) -> Column:
    return packed(split_clean(c, SENTENCE_GAP), size, separator)


def by_paragraph(c: Column, size: int, separator: str) -> Column:
    pieces = split_clean(c, PARAGRAPH_GAP)
    return F.when(F.size(pieces) == 0, F.array(c)).otherwise(packed(pieces, size, separator))


def chunks(c: Column, size: int | None = None, overlap: int | None = None, method: str = "sentence", separator: str = DEFAULTS.chunk_separator) -> Column:
    """Chunks of a text; an empty text has none. Arguments are checked before the plan is built, whatever the method."""
    size = size or DEFAULTS.chunk_size
    overlap = DEFAULTS.chunk_overlap if overlap is None else overlap
    if size < 1 or not 0 <= overlap < size:
        raise ValueError(f"an overlap of {overlap} doesn't fit chunks of {size}")
    made = {"fixed": lambda: by_length(c, size, overlap), "sentence": lambda: by_sentence(c, size, separator), "paragraph": lambda: by_paragraph(c, size, separator)}
    if method not in made:
        raise ValueError(f"unknown chunk method {method!r}")
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(made[method]())
