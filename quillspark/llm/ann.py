"""Nearest neighbours by cosine with randomly rotated one-bit codes (RaBitQ; Gao and Long, 2024).

A unit vector is turned by a random orthogonal matrix into `bits` coordinates, of which only the signs are kept, packed, beside a
correction scalar: the inner product of the turned vector with its own sign vector. The inner product with a query is then
estimated from the bits, and lies within an error bound of the estimate with a probability that EPSILON sets and that doesn't
depend on the data. A block of codes is scanned with all queries of a block; the best by estimate are computed exactly, and
after them all vectors whose upper bound reaches the worst of these, so what is left out is, by its bound, no neighbour.
Scores are cosines of the original vectors in double precision, each summed in the same order, so equal vectors tie.

Every row is in the index; nothing is fitted to the data, so there is no sample. Blocks of vectors and of queries meet by a
co-grouping on both block numbers: a group holds at most about BLOCK_BYTES of vectors and as many of queries, each block goes out
once for every block of the other side, and each group gives back at most `k` rows for a query. Work is that of a scan: queries times
vectors, on codes of a fraction of the vectors' size.

Vectors that are null, zero, empty or hold null or non-finite components take no part, nor do rows without an id. Of rows of one
id the largest vector (component by component) counts, so repeated rows are one. Only vectors of the query's length are its
candidates. Ties go to the smaller id. A query with fewer candidates than k gets all of them. An empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillspark.llm.common import batch_of, bounded_batches, stored

NEIGHBOURS = 5
#: Signs kept for each component of a vector, and the least number of signs.
BITS_PER_DIM, LEAST_BITS = 4, 128
#: Standard deviations of the estimate that the error bound allows for.
EPSILON = 3.0
#: Bytes of vectors in one block, and rows in one at least and at most; small tables still give WIDE blocks.
BLOCK_BYTES, LEAST_ROWS, MOST_ROWS, WIDE = 16 << 20, 256, 1 << 16, 64
#: Vectors and queries whose estimates are held at once.
SCAN_ROWS, SCAN_QUERIES = 4096, 256


@lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    """Orthonormal columns, dim of them in code_bits(dim) dimensions, drawn from a fixed seed."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((code_bits(dim), dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def code_bits(dim: int) -> int:
    """Signs kept of a vector, in whole words of 64."""
    return -(-max(BITS_PER_DIM * dim, LEAST_BITS) // 64) * 64


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows in single precision at length 1; a power of two keeps squares of very large or small components finite."""
    scaled = vectors / np.exp2(np.floor(np.log2(np.abs(vectors).max(axis=1, keepdims=True))))
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(np.float32)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction scalars of rows of one length."""
    turned = unit(vectors) @ rotation(vectors.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of each row with the query in double precision."""
    def scaled(x: np.ndarray) -> np.ndarray:
        return x / np.exp2(np.floor(np.log2(np.abs(x).max(axis=-1, keepdims=True))))

    rows, query = scaled(rows), scaled(query)
    lengths = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum())
    return (rows * query).sum(axis=1) / lengths


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: components that are all finite, one not zero."""
    big = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < big), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


INDEX = "id long, vector binary, code binary, factor float"


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, vector (packed doubles), code, factor: one row for each id with a usable vector, as a table in the shared folder."""
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.max("v").alias("v"))
    schema = pa.schema([("id", pa.int64()), ("vector", pa.binary()), ("code", pa.binary()), ("factor", pa.float32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, column = b.column(0).to_numpy(), b.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes).tolist():
                which = np.flatnonzero(sizes == dim)
                x = np.ascontiguousarray(flat[at[which][:, None] + np.arange(dim)], "<f8")
                codes, factors = encode(x)
                yield batch_of(schema, [pa.array(ids[which]), [r.tobytes() for r in x], [c.tobytes() for c in codes], pa.array(factors.astype(np.float32))])

    return stored(rows.mapInArrow(run, INDEX), "codes")


class Best:
    """The k nearest of each query so far: score down, then id up."""

    def __init__(self, k: int, n: int):
        self.k = k
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.scores: list[np.ndarray] = [np.zeros(0)] * n

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[order], scores[order]

    def worst(self, q: int) -> float:
        return self.scores[q][-1] if len(self.ids[q]) == self.k else -np.inf


def scan(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, factors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, epsilon: float = EPSILON) -> Best:
    """The k nearest of each query among rows of one length, other ids than its own."""
    best = Best(k, len(query_ids))
    bits = code_bits(vectors.shape[1])
    turned = unit(queries) @ rotation(vectors.shape[1]).T / np.float32(np.sqrt(bits))
    for low in range(0, len(ids), SCAN_ROWS):
        part = slice(low, low + SCAN_ROWS)
        signs = np.unpackbits(codes[part], axis=1).astype(np.float32) * 2 - 1
        f = factors[part].astype(np.float32)
        margin = epsilon * np.sqrt(np.maximum(1 - f * f, 0)) / f / np.float32(np.sqrt(bits - 1)) + np.float32(1e-5)
        few = min(k + 1, len(f))  # the query's own row may be among them
        for q_low in range(0, len(query_ids), SCAN_QUERIES):
            estimate = (turned[q_low : q_low + SCAN_QUERIES] @ signs.T) / f
            first = np.argpartition(-estimate, few - 1, axis=1)[:, :few]
            for i in range(len(estimate)):
                q = q_low + i
                head = first[i] + low
                head = head[ids[head] != query_ids[q]]
                best.add(q, ids[head], cosines(vectors[head], queries[q]))
                again = np.flatnonzero(estimate[i] + margin >= best.worst(q)) + low
                again = np.setdiff1d(again[ids[again] != query_ids[q]], head, assume_unique=True)
                if len(again):
                    best.add(q, ids[again], cosines(vectors[again], queries[q]))
    return best


FOUND = "query_id long, vec_id long, score double"


def search(index: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query; both tables are of build_index's form, and a
    query isn't compared with the row of its own id."""
    size = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vector")).alias("bytes")).first()
    rows = max(LEAST_ROWS, min(MOST_ROWS, BLOCK_BYTES // max(size.bytes or 8, 8)))
    blocks = max(-(-size.n // rows), min(WIDE, -(-size.n // LEAST_ROWS)), 1)
    query_blocks = max(-(-queries.count() // rows), 1)
    number = F.xxhash64("id")
    left = index.withColumn("i", F.pmod(number, F.lit(blocks))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    # Not the hash that deals out the index: queries of one block are spread over all blocks of vectors.
    right = queries.select("id", "vector", F.pmod(F.xxhash64("id", F.lit("query")), F.lit(query_blocks)).cast("int").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("i"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def numbers(column: pa.ChunkedArray, kind: str, which: np.ndarray) -> np.ndarray:
        picked = column.take(pa.array(which)).combine_chunks()
        return np.frombuffer(b"".join(picked.to_pylist()), kind).reshape(len(which), -1)

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        ids, query_ids = vectors["id"].to_numpy(), asked["id"].to_numpy()
        sizes, query_sizes = (np.array([len(v) for v in t["vector"].to_pylist()], np.int64) for t in (vectors, asked))
        for n in np.intersect1d(sizes, query_sizes).tolist():
            which, wanted = np.flatnonzero(sizes == n), np.flatnonzero(query_sizes == n)
            best = scan(ids[which], numbers(vectors["vector"], "<f8", which), numbers(vectors["code"], "u1", which), vectors["factor"].to_numpy()[which], query_ids[wanted], numbers(asked["vector"], "<f8", wanted), k, epsilon)
            out[0] += [np.repeat(query_ids[wanted], [len(x) for x in best.ids])]
            out[1] += best.ids
            out[2] += best.scores
        return pa.table([np.concatenate([np.zeros(0, t), *c]) for t, c in zip((np.int64, np.int64, np.float64), out, strict=True)], schema=schema)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours_of_share(vectors: DataFrame, every: int = 50, k: int = NEIGHBOURS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The nearest found of each row whose id is divisible by `every`, among all other rows."""
    index = build_index(vectors, key, vector)
    return search(index, index.filter(F.col("id") % every == 0), k)
