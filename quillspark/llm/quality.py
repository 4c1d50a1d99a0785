"""Quality classifier by nearest-neighbour voting in a latent semantic space.

Terms are bigrams of byte classes (letters, upper case, digits, frequent marks, UTF-8 parts, all else) and words that repeat
the word before them (the same bytes in any order count as one word), by the share that they have of all words. Their
document frequencies are counted over all documents. A bounded sample of labelled documents (`per_class` of each label, in
the order of a hash of doc_id) is weighted by tf-idf and projected on its leading singular vectors. The labelled vectors,
whose number is bounded by that parameter, travel to every task, where blocks of BLOCK document vectors are multiplied with
all of them: exact cosines, no index. The `neighbours` most similar ones vote with similarity to the power `sharpness` as
weight. Similarities count to six decimals; of equal ones at the last place those with the smaller doc_id vote. Blocks are
filled up to one shape, so a document's score doesn't depend on the rows beside it.

Null and empty texts have a zero vector and score the share of label 1 in the sample. Labels that are null or without a
document are ignored; of repeated labelled rows one counts, with the larger label and text. Without any usable label the
score is 0.5. Score inputs are the texts alone; repeated rows score alike. Texts of any length are counted whole, in
fitting as in scoring. An empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import batch_of, slices, small_batches, text_or_empty, with_document

CLASSES = 64
BIGRAMS = CLASSES * CLASSES
#: Terms for words that repeat the word before them: term r counts them if they are over r / REPEATS of all words.
REPEATS = 16
TERMS = BIGRAMS + REPEATS
PER_CLASS = 1500
RANK = 32
NEIGHBOURS = 25
SHARPNESS = 8
THRESHOLD = 0.3
#: Document vectors that are multiplied at once.
BLOCK = 64


def byte_classes() -> np.ndarray:
    """The class of each byte: one for each small letter and each of 32 frequent marks, one for each other kind."""
    out = np.full(256, 1, np.int32)
    for c in range(26):
        out[97 + c] = 2 + c
    out[65:91], out[48:58] = 28, 29
    for i, mark in enumerate(b" \n\t.,;:!?'\"()[]{}<>|/\\-_*#$%&+=@"):
        out[mark] = 30 + i
    out[128:192], out[192:] = 62, 63
    return out


_CLASS = byte_classes()


def term_counts(texts: list[str]) -> np.ndarray:
    """One row of term counts for each text; bigrams and repeats don't cross texts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    n = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    out = np.zeros((len(raw), TERMS), np.float32)
    if len(data) < 2:
        return out
    cls = _CLASS[data]
    row = np.repeat(np.arange(len(raw)), n)
    same = row[1:] == row[:-1]
    term = (row[:-1] * BIGRAMS + cls[:-1] * CLASSES + cls[1:])[same]
    out[:, :BIGRAMS] = np.bincount(term, minlength=len(raw) * BIGRAMS).reshape(len(raw), BIGRAMS)
    # A word's mark is a sum over its bytes; words begin after white space and at a text's start.
    blank = (data == 32) | (data == 10) | (data == 9) | (data == 13)
    begins = ~blank
    begins[1:] &= blank[:-1] | ~same
    starts = np.flatnonzero(begins)
    if len(starts) > 1:
        wide = np.where(blank, 0, data.astype(np.int64))
        mark = np.add.reduceat(wide * wide * 31 + wide * 7919 + (wide > 0), starts)
        again = (mark[1:] == mark[:-1]) & (row[starts[1:]] == row[starts[:-1]])
        words = np.bincount(row[starts], minlength=len(raw))
        repeats = np.bincount(row[starts[1:]][again], minlength=len(raw))
        share = repeats / np.maximum(words, 1)
        for r in range(REPEATS):
            out[:, BIGRAMS + r] = np.where(share > r / REPEATS, repeats, 0)
    return out


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled rows x rank, of length 1 or 0
    labels: np.ndarray
    neighbours: int = NEIGHBOURS
    sharpness: float = SHARPNESS

    def project(self, counts: np.ndarray) -> np.ndarray:
        # In double precision the place of a row in its block can't change six decimals.
        return unit(weighted(counts, self.idf).astype(np.float64) @ self.axes.astype(np.float64))

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        return np.concatenate([self._block(counts[i : i + BLOCK]) for i in range(0, len(counts), BLOCK)] or [np.zeros(0)])

    def _block(self, counts: np.ndarray) -> np.ndarray:
        rows, n = len(counts), len(self.labels)
        near = self.project(np.pad(counts, ((0, BLOCK - rows), (0, 0)))) @ self.vectors.T
        k = min(self.neighbours, n)
        # Whole numbers that tell similarity first and then the place in the order of doc_id: no two are equal.
        rank = np.rint(np.clip(near, -1, 1) * 1e6).astype(np.int64) * n - np.arange(n)
        best = np.sort(np.argpartition(-rank, k - 1, axis=1)[:, :k], axis=1)
        weight = np.clip(np.rint(np.take_along_axis(near, best, 1) * 1e6) / 1e6, 0, 1).astype(np.float64) ** self.sharpness
        total = weight.sum(1)
        vote = (weight * self.labels[best]).sum(1)
        return np.where(total > 0, vote / np.where(total > 0, total, 1), self.labels.mean()).clip(0, 1)[:rows]


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(counts) * idf)


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Documents, and how many hold each term, over all rows. One row for each task and term is summed."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS, np.int64), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            n += len(texts)
            for s, e in slices(map(len, texts)):
                df += (term_counts(texts[s:e]) > 0).sum(0)
        found = np.flatnonzero(df)
        yield batch_of(schema, [pa.array(np.append(found, -1).astype(np.int32)), pa.array(np.append(df[found], n))])

    rows = docs.select(text_or_empty(text)).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = next((r.n for r in rows if r.term < 0), 0)
    df = np.zeros(TERMS, np.int64)
    for r in rows:
        if r.term >= 0:
            df[r.term] = r.n
    return n, df


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, text: str = "text", key: str = "doc_id", use: Column | None = None) -> DataFrame:
    """doc_id, y (0 or 1), text of at most per_class documents of each label, chosen by a hash of doc_id."""
    rows = labels.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    # Labels without a document go before the limit, so they take no other's place.
    rows = with_document(rows.filter(use if use is not None else F.lit(True)), docs, key)
    order = [F.xxhash64(F.col("id")), F.col("id")]
    picks = [rows.filter(F.col("y") == y).groupBy("id").agg(F.max("y").alias("y")).orderBy(*order).limit(per_class) for y in (0, 1)]
    picked = F.broadcast(picks[0].unionAll(picks[1]))  # at most 2 * per_class short rows
    found = docs.select(F.col(f"`{key}`").cast("long").alias("id"), text_or_empty(text).alias("t")).join(picked, "id")
    return found.groupBy("id").agg(F.max("y").alias("y"), F.max("t").alias("t"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, rank: int = RANK, text: str = "text", key: str = "doc_id") -> Model:
    small_batches(docs.sparkSession)
    n, df = document_frequencies(docs, text)
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0).astype(np.float32)
    sample = labelled_sample(docs, labels, label, per_class, text, key, ~held_out(F.col("id")))
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for s, e in slices(map(len, texts)):
                packed = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in term_counts(texts[s:e])]
                yield batch_of(schema, [b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), packed])

    rows = sorted(sample.mapInArrow(run, "id long, y int, counts binary").collect(), key=lambda r: r.id)
    y = np.array([r.y for r in rows], np.float64)
    if not rows:
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y)
    x = weighted(np.stack([np.frombuffer(zlib.decompress(r.counts), "<u4").astype(np.float32) for r in rows]), idf)
    axes = leading_axes(x, rank)
    return Model(idf, axes, unit(x.astype(np.float64) @ axes.astype(np.float64)), y)


def leading_axes(x: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 8, *x.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank].astype(np.float32)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            got = [model.scores(term_counts(texts[s:e])) for s, e in slices(map(len, texts))]
            yield batch_of(schema, [b.column(0), b.column(1), pa.array(np.concatenate([np.zeros(0), *got]))])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(held_out(F.col(f"`{key}`")), F.lit(False)), text_or_empty(text))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, all columns as they are."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scores(texts):
        texts = texts.tolist()
        got = [model.scores(term_counts(texts[s:e])) for s, e in slices(map(len, texts))]
        import pandas as pd

        return pd.Series(np.concatenate([np.zeros(0), *got]))

    return docs.filter(scores(text_or_empty(text)) >= threshold)
