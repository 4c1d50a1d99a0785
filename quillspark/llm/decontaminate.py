"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and underscores, lower-cased. A passage is aligned with a whole item (local alignment,
match 2, mismatch and gap -1); the score is divided by that of a perfect copy, and a document is contaminated by an item
from `threshold` on, so copies with changed, lost or added words count as well.

Seeds are pairs of neighbouring words of an item; a document has such a pair where the two words follow each other
directly or with one word between. That loses nothing at thresholds of 0.5 or more: let an alignment with score n or more
of 2n match m of the item's n words, with e words changed or left out inside, i added and u left out at the ends. Then
m >= 2e + i + u. Of the m - 1 steps from one match to the next at most e lie over a change and at most i / 2 over two added
words; all others are pairs that the document has. So at least m / 2 + u / 2 - 1 >= n / 3 - 1 pairs are found, and within
m + e + i <= 2n words of the document. Hence the rarest n - ceil(n / 3) + 1 of the n - 1 pairs (by the number of documents
that have them, counted over the whole corpus; ties included) hold one that is found: these are the rare seeds that join
passages to items. A passage is aligned if besides ceil(n / 3) - 1 pairs of the item lie within 2n words.

Both passes are maps over documents with the items' pairs at hand, so nothing but counts is shuffled and no document,
source or passage is hot. Items go out in blocks of BLOCK_ITEMS, or fewer if they are long, two passes over the corpus for
each block: what a task holds has a bound, and no item is left out. A document of any length is read whole; the work is in
proportion to its words and, for each item with a seed in it, to the passages that hold enough pairs.

Null and empty texts hold no passage. Items of fewer than LEAST_WORDS words are found by all their words in sequence alone,
with score 1; items without words match nothing. Repeated items are reported for each item_id, repeated rows of docs each.
Of passages with equal scores the first is reported. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import batch_of, small_batches, text_or_empty

LEAST_WORDS = 4
THRESHOLD = 0.5
BLOCK_ITEMS = 5_000
BLOCK_WORDS = 1 << 20
MATCH, OTHER = 2, 1
WORD_BITS = 31

words = re.compile(r"\w+").findall
#: A character beyond ASCII that is in no word.
other_mark = re.compile(r"[^\w\x00-\x7f]").search
#: Bytes to bytes: ASCII that is in no word to a space.
WORD_BYTES = bytes(b if b > 127 or chr(b).isalnum() or b == 95 else 32 for b in range(256))


def pairs_needed(n: int) -> int:
    """Pairs that a passage with half of a perfect copy's score has of an item of n words, at least."""
    return max(1, -(-n // 3) - 1)


class Items:
    """Test items of one block: words as small integers, pairs as sorted 64-bit keys, postings of items."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        self.vocab: dict[str, int] = {}
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(t.lower())], np.int64) for _, t in rows]
        self.raw = {w.encode("utf-8", "surrogatepass"): i for w, i in self.vocab.items()}
        keys = [np.unique(w[:-1] << WORD_BITS | w[1:]) if len(w) >= LEAST_WORDS else np.zeros(0, np.int64) for w in self.words]
        flat = np.concatenate([np.zeros(0, np.int64), *keys])
        self.pairs, of = np.unique(flat, return_inverse=True)
        self.pairs_of = np.split(of, np.cumsum([len(g) for g in keys])[:-1]) if keys else []
        #: Items below LEAST_WORDS words, by their first word.
        self.short: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            if 0 < len(w) < LEAST_WORDS:
                self.short.setdefault(int(w[0]), []).append(k)
        self.choose_seeds(np.zeros(len(self.pairs), np.int64))

    def encode(self, text: str) -> np.ndarray:
        """Numbers of the text's words, 0 for words that no item has."""
        low = text.lower()
        if not low.isascii() and other_mark(low):
            found = words(low)
            return np.fromiter(map(self.vocab.get, found, repeat(0)), np.int64, len(found))
        # Of other characters than ASCII there are word characters alone, so bytes can be split, which is faster.
        raw = low.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
        return np.fromiter(map(self.raw.get, raw, repeat(0)), np.int64, len(raw))

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the items' pairs in a document; places may repeat."""
        at, pair = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(self.pairs):
            for step in (1, 2):
                known = np.flatnonzero((w[:-step] > 0) & (w[step:] > 0))
                keys = w[known] << WORD_BITS | w[known + step]
                i = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
                good = self.pairs[i] == keys
                at.append(known[good])
                pair.append(i[good])
        return np.concatenate(at), np.concatenate(pair)

    def choose_seeds(self, df: np.ndarray) -> None:
        """df: in how many documents each pair is."""
        item, pair, seed = [], [], []
        for k, pairs in enumerate(self.pairs_of):
            if len(pairs):
                n = len(self.words[k])
                # A repeated pair of an item counts at each place, so fewer different ones are left out for it.
                spared = max(0, len(pairs) - (n - -(-n // 3) + 1))
                most = np.sort(df[pairs])[len(pairs) - 1 - spared]
                item.append(np.full(len(pairs), k))
                pair.append(pairs)
                seed.append(df[pairs] <= most)
        item, pair = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (item, pair))
        order = np.argsort(pair, kind="stable")
        self.item, self.is_seed = item[order], np.concatenate([np.zeros(0, bool), *seed])[order]
        self.first = np.searchsorted(pair[order], np.arange(len(self.pairs) + 1))
        self.need = np.array([pairs_needed(len(w)) for w in self.words], np.int64)

    def matches(self, w: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """(item, score, first word, word after the last, pairs) of the best passage for each item."""
        out = self.short_matches(w) if self.short else []
        at, pair = self.hits(w)
        if not len(at):
            return out
        found, of, times = np.unique(pair, return_inverse=True, return_counts=True)
        n = self.first[found + 1] - self.first[found]
        row = np.repeat(np.arange(len(found)), n)
        posting = self.first[found][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        items = self.item[posting]
        enough = np.bincount(items, weights=times[row], minlength=len(self.need)) >= self.need
        seeded = items[self.is_seed[posting]]
        for k in np.unique(seeded[enough[seeded]]).tolist():
            size, need = len(self.words[k]), int(self.need[k])
            mine = np.zeros(len(found), bool)
            mine[row[items == k]] = True
            places = np.sort(at[mine[of]])
            # From each place on: places within 2 * size words. Passages around those with enough are aligned.
            starts = places[np.searchsorted(places, places + 2 * size, "right") - np.arange(len(places)) >= need]
            if not len(starts):
                continue
            cuts = np.flatnonzero(np.diff(starts) > 4 * size) + 1
            best = (0.0, 0, 0)
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(starts)], strict=True):
                lo, hi = max(0, int(starts[s]) - 2 * size), min(len(w), int(starts[e - 1]) + 4 * size)
                score, x, y = align(self.words[k], w[lo:hi])
                if score > best[0]:
                    best = score, lo + x, lo + y
            out.append((k, *best, int(mine.sum())))
        return out

    def short_matches(self, w: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        out: dict[int, tuple] = {}
        for p in np.flatnonzero(np.isin(w, list(self.short))).tolist():
            for k in self.short[int(w[p])]:
                n = len(self.words[k])
                if k not in out and np.array_equal(w[p : p + n], self.words[k]):
                    out[k] = (k, 1.0, p, p + n, 1)
        return list(out.values())


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman: best local score as a share of a perfect copy's, and the aligned part of the passage.

    Row by row; gaps along a row are a running maximum, as each step costs the same.
    """
    if not len(item) or not len(passage):
        return 0.0, 0, 0
    n = len(passage)
    steps = np.arange(n + 1) * OTHER
    above, begin_above = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, x, y = 0, 0, 0
    for word in item:
        here = np.zeros(n + 1, np.int64)
        begin = np.arange(n + 1)
        diagonal = above[:-1] + np.where(passage == word, MATCH, -OTHER)
        up = above[1:] - OTHER
        here[1:] = np.maximum(np.maximum(diagonal, up), 0)
        begin[1:] = np.where(here[1:] == 0, begin[1:], np.where(diagonal >= up, begin_above[:-1], begin_above[1:]))
        run = here + steps
        source = np.maximum.accumulate(np.where(run == np.maximum.accumulate(run), np.arange(n + 1), 0))
        left = run[source] - steps
        begin = np.where(left > here, begin[source], begin)
        above, begin_above = np.maximum(here, left), begin
        top = int(above.argmax())
        if above[top] > best:
            best, x, y = int(above[top]), int(begin_above[top]), top
    return best / (MATCH * len(item)), x, y


def blocks(items: DataFrame, text: str, key: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks whose number of items and of words has a bound; streamed, never all at once."""
    block, size = [], 0
    for r in items.select(F.col(f"`{key}`").cast("long").alias("i"), text_or_empty(text).alias("t")).orderBy("i", "t").toLocalIterator():
        n = len(r.t) // 2 + 1
        if block and (len(block) >= BLOCK_ITEMS or size + n > BLOCK_WORDS):
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    if block:
        yield block


OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("pairs", pa.int64())])
DDL = "doc_id long, item_id long, score double, start_word long, end_word long, pairs long"


def _seeded(docs: DataFrame, rows: list[tuple[int, str]], text: str) -> Items:
    items = Items(rows)
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(items.pairs), np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                df[np.unique(items.hits(items.encode(t))[1])] += 1
        found = np.flatnonzero(df)
        yield batch_of(schema, [pa.array(found), pa.array(df[found])])

    df = np.zeros(len(items.pairs), np.int64)
    # At most one row for each pair of a bounded block.
    for r in docs.select(text_or_empty(text)).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        df[r.pair] = r.n
    items.choose_seeds(df)
    return items


def _check(threshold: float) -> None:
    if threshold < 0.5:
        raise ValueError("the seeds find all passages from a threshold of 0.5 on")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and item whose best alignment reaches the threshold, with the place of the passage."""
    _check(threshold)
    small_batches(docs.sparkSession)
    parts = []
    for rows in blocks(benchmark, item_text, item_key):
        items = _seeded(docs, rows, text)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    out += [(i, items.ids[k], round(s, 6), x, y, n) for k, s, x, y, n in items.matches(items.encode(t)) if s >= threshold]
                yield batch_of(OUT, list(map(list, zip(*out, strict=True))) if out else [[]] * len(OUT))

        parts.append(docs.select(F.col(f"`{key}`").cast("long"), text_or_empty(text)).mapInArrow(run, DDL))
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], DDL)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs in which no item reaches the threshold, all columns as they are."""
    _check(threshold)
    small_batches(docs.sparkSession)
    for rows in blocks(benchmark, item_text, item_key):
        items = _seeded(docs, rows, text)

        @F.pandas_udf("boolean")
        def clean(texts, items=items):
            import pandas as pd

            return pd.Series([all(m[1] < threshold for m in items.matches(items.encode(t))) for t in texts], dtype=bool)

        docs = docs.filter(clean(text_or_empty(text)))
    return docs
