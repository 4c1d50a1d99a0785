"""Fill-in-the-middle documents: prefix, suffix and middle of a text in another order, told apart by marks.

A text becomes a numpy array of UTF-32 code points. Its units are the runs of code points of one class (`unit`: char, where
each code point is a unit of its own, or word, where runs of letters and digits, of white space and of other characters are
units): classes of neighbours are compared, flatnonzero gives the boundaries, two ranks among them are chosen by a hash of
doc_id, and the slices between them are encoded again. A text that holds one of the marks, an empty text, and a share of the
others stays plain, so the original can always be restored: marks can't arise where a mark and a piece meet, since a mark
has its only `<` in front.

Null texts are empty. Null doc_ids are hashed as an empty number; rows of one doc_id have the same ranks. Repeated rows are
repeated; texts of any length are transformed whole (Arrow batches are bounded in bytes). An empty table gives an empty
result; other columns are ignored, whatever their names. Rows are independent: no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import batch_of, bounded_batches, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are transformed, and of 100 of these so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = 1

_SPACE = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def string(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A class of each code point; units are runs of one class."""
    if unit == "char":
        return np.arange(len(points)) & 1  # neighbours always differ
    if unit != "word":
        raise ValueError(f"unit must be char or word, not {unit}")
    ascii_letter = ((points >= 48) & (points <= 57)) | ((points | 32) >= 97) & ((points | 32) <= 122) & (points < 128) | (points == 95)
    return np.where(np.isin(points, _SPACE), 0, np.where(ascii_letter | (points >= 0xC0), 1, 2))


def boundaries(points: np.ndarray, unit: str = "char") -> np.ndarray:
    """Where units begin, and the text's end: n + 1 places for n units."""
    if not len(points):
        return np.zeros(1, np.int64)
    kind = classes(points, unit)
    return np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(points)]])


def numbers(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12)]


def arrange(text: str, h: list[int], unit: str = "char", transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and of middle, output of one text; h: four numbers."""
    points = codepoints(text)
    places = boundaries(points, unit)
    n = len(places) - 1
    if not n or h[2] % 100 >= transformed or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = places[sorted((h[0] % (n + 1), h[1] % (n + 1)))].tolist()
    prefix, middle, suffix = string(points[:low]), string(points[low:high]), string(points[high:])
    if h[3] % 100 < suffix_first:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


ARRANGED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, unit: str = "char", transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output for every row."""
    bounded_batches(docs.sparkSession)
    if unit not in ("char", "word"):
        raise ValueError(f"unit must be char or word, not {unit}")
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [arrange(t, numbers(seed, i), unit, transformed, suffix_first) for i, t in zip(ids, b.column(1).to_pylist(), strict=True)]
            yield batch_of(schema, [ids, *(list(c) for c in zip(*rows, strict=True))] if rows else [[]] * 6)

    return docs.select(F.col(f"`{key}`").cast("long"), text_or_empty(text)).mapInArrow(run, ARRANGED)


def restored(output: Column, form: Column) -> Column:
    """The original text, from output and form alone."""

    def cut(body: Column, mark: str) -> tuple[Column, Column]:
        head = F.substring_index(body, mark, 1)
        return head, F.substr(body, F.length(head) + len(mark) + 1)

    first, rest = cut(F.substr(output, F.lit(len(PREFIX) + 1)), SUFFIX)
    psm = F.concat(first, cut(rest, MIDDLE)[1], cut(rest, MIDDLE)[0])
    last, rest = cut(F.substr(output, F.lit(len(SUFFIX) + 1)), PREFIX)
    spm = F.concat(*cut(rest, MIDDLE), last)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transformation_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The columns of fill_in_middle with digests in place of output: output_sha256, and restored_sha256 of the text rebuilt from it."""
    made = fill_in_middle(docs, text=text, key=key)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
