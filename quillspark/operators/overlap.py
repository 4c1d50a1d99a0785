"""Overlap of many values with many texts, each with each, without comparing each with each.

structure.overlap_ratio for all pairs that share a window: windows of a value (a quarter of its length, 100 characters at
most, overlapping by half; the whole value if it has fewer than 20) are looked up among all windows of a text by a rolling
hash over its code points. All places of a text are asked for the windows' heads alone (16, 32 or 64 characters, shorter
windows whole), and whole windows only where a head is found, so a text costs time in proportion to its length for each length
of a head in use, of which there are 18 at most. What the hash finds is joined by the window's text, which decides. Hashes of at most BLOCK windows are sent to
the tasks at once; more take further passes over the texts. Pairs without a shared window have no row (their ratio is 0), nor
have null and empty values and texts. Repeated values and texts count once for each of their rows' keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows whose hashes (8 bytes each) go to every task in one pass.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Low bits of a hash that a bitmap tells before the sorted hashes are asked.
BITS = 16

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, n of them at least."""
    if len(_powers[0]) < n:
        for i, b in enumerate((BASE, INVERSE)):
            steps = np.full(2 * n, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of all windows of a text: equal windows have equal hashes wherever they stand."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.n = len(points)
        up, self.down = _up_to(self.n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * up, dtype=np.uint64)])

    def windows(self, width: int) -> np.ndarray:
        if width > self.n:
            return np.zeros(0, np.uint64)
        return (self.sums[width:] - self.sums[:-width]) * self.down[: self.n - width + 1]

    def at(self, places: np.ndarray, width: int) -> np.ndarray:
        return (self.sums[places + width] - self.sums[places]) * self.down[places]


def head_of(width: int) -> int:
    """Characters of a window that are looked up first."""
    return width if width < 16 else 1 << (width.bit_length() - 1)


def window_places(n: int) -> tuple[int, range]:
    """Width and starts of the windows of a value of n characters."""
    if n < 20:
        return n, range(1)
    width = min(100, n // 4)
    return width, range(0, n - width + 1, max(1, width // 2))


WINDOWS = "value_id {}, n int, width int, head long, hash long, window string"


def value_windows(values: DataFrame, value: str, key: str) -> DataFrame:
    """value_id, n (characters), width, hashes of its head and of all of it, window: a row for each window of each value."""
    kind = values.schema[key].dataType
    rows = values.select(F.col(key).alias("value_id"), F.col(value).alias("v")).filter("v <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                width, starts = window_places(len(v))
                rolling = Rolling(v)
                head, found = (rolling.at(np.array(starts), w).astype(np.int64).tolist() for w in (head_of(width), width))
                for column, new in zip(out, ([i] * len(starts), [len(v)] * len(starts), [width] * len(starts), head, found, [v[s : s + width] for s in starts]), strict=True):
                    column += new
            types = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["value_id", "n", "width", "head", "hash", "window"])

    return rows.mapInArrow(run, WINDOWS.format(kind.simpleString()))


def shared_windows(texts: DataFrame, text: str, key: str, wanted: dict[int, np.ndarray], heads: dict[int, np.ndarray]) -> DataFrame:
    """text_id, window: the distinct windows of each text whose width and hash (sorted, by width) are wanted; heads: the sorted
    hashes of their heads by length."""
    kind = texts.schema[key].dataType
    rows = texts.select(F.col(key).alias("text_id"), F.col(text).alias("t")).filter("t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = {}
        for length, hashes in heads.items():
            maps[length] = np.zeros(1 << BITS, bool)
            maps[length][(hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True

        def those(hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
            return hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h

        for b in batches:
            ids, found = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rolling, met = Rolling(t), set()
                for length, hashes in heads.items():
                    h = rolling.windows(length)
                    some = np.flatnonzero(maps[length][(h >> np.uint64(64 - BITS)).astype(np.int64)])
                    some = some[those(hashes, h[some])]
                    for width in (w for w in wanted if len(some) and head_of(w) == length):
                        fit = some[some + width <= rolling.n]
                        met.update(t[s : s + width] for s in fit[those(wanted[width], rolling.at(fit, width))].tolist())
                ids += [i] * len(met)
                found += met
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(found, pa.string())], names=["text_id", "window"])

    return rows.mapInArrow(run, f"text_id {kind.simpleString()}, window string")


def overlaps(values: DataFrame, texts: DataFrame, value: str = "value", text: str = "text", value_key: str = "value_id", text_key: str = "text_id", block: int = BLOCK) -> DataFrame:
    """text_id, value_id, ratio of all pairs that share a window. Keys must be distinct. Compare folded texts by folding them first."""
    windows = value_windows(values, value, value_key)
    blocks = max(1, -(-windows.count() // block))
    parts = []
    for i in range(blocks):
        mine = windows.filter(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == i)
        wanted: dict[int, set[int]] = {}
        heads: dict[int, set[int]] = {}
        for r in mine.select("width", "head", "hash").distinct().toLocalIterator():  # about `block` rows of numbers at most
            wanted.setdefault(r.width, set()).add(r.hash)
            heads.setdefault(head_of(r.width), set()).add(r.head)
        ordered = lambda found: {k: np.sort(np.array(list(h), np.int64).astype(np.uint64)) for k, h in found.items()}
        parts.append(shared_windows(texts, text, text_key, ordered(wanted), ordered(heads)).join(mine.drop("head"), "window"))
    met = reduce(DataFrame.unionAll, parts).groupBy("text_id", "value_id", "n", "width").agg(F.count(F.lit(1)).alias("hits"))
    return met.select("text_id", "value_id", (F.col("hits") * F.col("width") / F.col("n").cast("double")).alias("ratio"))
