"""Token ids in directly addressable codes (Brisaboa, Ladra and Navarro, 2009).

An id is cut into chunks of CHUNK_BITS bits, lowest first. Level k holds chunk k of every id that has one, packed; a bitmap
beside it says which of these ids go on in level k + 1, and a directory holds the number of set bits before each block of
512. Token i is read without its neighbours: chunk 0 at i, and while the bit there is set, the next chunk at the rank of
that bit. A run of tokens is read alike: its chunks of each level lie between the ranks of its ends. Readers never decode
a segment as a whole: document_report reads the ids of each document so, read_at single tokens of a file by number.

A token file is a table in the shared store; each row is a segment of up to SEGMENT_TOKENS ids (one document at least) of
consecutive documents in ascending doc_id: a blob with header, document ends and levels, and beside it bucket, position,
number of ids. Documents are dealt to ordered buckets by one shuffle; the start of a bucket is the sum over those before
it, of which there are 100,000 at most.

Null and empty texts have the end id alone. Repeated rows are repeated documents; rows without a doc_id come first; rows of
one doc_id are ordered by their texts. Extra columns are ignored; an empty table gives an empty file and result.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.bpe import NARROW, SPACE, WordCache, byte_alphabet, narrow_class
from quillspark.llm.common import batch_of, ordered_buckets, scratch_path, small_batches, text_or_empty

CHUNK_BITS = 8
BLOCK = 512
SEGMENT_TOKENS = 1 << 20
END_ID = 1
MAGIC = b"DAC1"


def encode(ids: np.ndarray) -> bytes:
    """Directly addressable code of unsigned 32-bit ids."""
    rest = np.ascontiguousarray(ids, np.uint32)
    levels = []
    while True:
        more = rest >> CHUNK_BITS
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
        directory = np.concatenate([[0], np.cumsum(np.bitwise_count(bits.view("<u8")).reshape(-1, BLOCK // 64).sum(1))]).astype("<u4")
        levels.append((rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + directory.tobytes())
        sizes = len(rest)
        levels[-1] = struct.pack("<I", sizes) + levels[-1]
        rest = more[goes_on]
        if not len(rest):
            return struct.pack("<I", len(levels)) + b"".join(levels)


class Codes:
    """Random access to encode()'s bytes."""

    def __init__(self, blob: bytes | memoryview):
        (n,), at, self.levels = struct.unpack_from("<I", blob), 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<I", blob, at)
            at += 4
            chunks = np.frombuffer(blob, np.uint8, size, at)
            at += size
            width = -(-size // BLOCK) * (BLOCK // 8)
            bits = np.frombuffer(blob, np.uint8, width, at)
            at += width
            directory = np.frombuffer(blob, "<u4", width // (BLOCK // 8) + 1, at)
            at += 4 * len(directory)
            self.levels.append((chunks, bits, directory))
        self.end = at

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, _ in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self.rank(shift // CHUNK_BITS, i)
            shift += CHUNK_BITS
        return value

    def rank(self, level: int, i: int) -> int:
        """Set bits before place i of a level, from the directory and one block at most."""
        _, bits, directory = self.levels[level]
        block = i // BLOCK
        if not i % BLOCK:
            return int(directory[block])
        inside = int.from_bytes(bits[block * (BLOCK // 8) : (i >> 3) + 1].tobytes(), "little") & ((1 << i - block * BLOCK) - 1)
        return int(directory[block]) + inside.bit_count()

    def run(self, start: int, end: int) -> np.ndarray:
        """Ids start to end - 1: their chunks of each level, and no others, are read."""
        if not 0 <= start <= end <= len(self):
            raise IndexError((start, end))
        spans = [(start, end)]
        while len(spans) < len(self.levels) and spans[-1][0] < spans[-1][1]:
            s, e = spans[-1]
            spans.append((self.rank(len(spans) - 1, s), self.rank(len(spans) - 1, e)))
        above = np.zeros(0, np.uint32)
        for (s, e), (chunks, bits, _) in reversed(list(zip(spans, self.levels, strict=False))):
            ids = chunks[s:e].astype(np.uint32)
            if len(above):
                on = np.flatnonzero(np.unpackbits(bits[s >> 3 : (e + 7) >> 3], bitorder="little")[s & 7 : (s & 7) + e - s])
                ids[on] |= above << np.uint32(CHUNK_BITS)
            above = ids
        return above

    def all(self) -> np.ndarray:
        return self.run(0, len(self))


def pack_segment(doc_ids: list, ends: np.ndarray, ids: np.ndarray) -> bytes:
    known = np.packbits([i is not None for i in doc_ids], bitorder="little").tobytes()
    keys = np.array([i or 0 for i in doc_ids], "<i8").tobytes()
    return MAGIC + struct.pack("<I", len(doc_ids)) + known + keys + ends.astype("<u8").tobytes() + encode(ids)


def unpack_segment(blob: bytes) -> tuple[list, np.ndarray, Codes]:
    """doc_ids, end of each document in the segment, the codes."""
    if blob[:4] != MAGIC:
        raise ValueError("not a token segment")
    (n,), at = struct.unpack_from("<I", blob, 4), 8
    known = np.unpackbits(np.frombuffer(blob, np.uint8, -(-n // 8), at), count=n, bitorder="little")
    at += -(-n // 8)
    keys, ends = np.frombuffer(blob, "<i8", n, at), np.frombuffer(blob, "<u8", n, at + 8 * n).astype(np.int64)
    return [int(k) if ok else None for k, ok in zip(keys, known, strict=True)], ends, Codes(memoryview(blob)[at + 16 * n :])


class WordTokenizer:
    """The tokenizers library behind a cache of words.

    The tokenizer file splits a lower-cased text into words that it encodes one by one, so each word goes through the library's
    model once. Only texts up to U+024F and without added tokens are split here, where normalisation is lower case alone;
    for all others the library encodes the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.wide = re.compile(rf"[^\x00-{chr(NARROW)}]").search
        letters, digits = narrow_class("L"), narrow_class("N")
        # The split of the word tokenizer's file: contractions, runs of letters, single digits, runs of other marks.
        self.split = re.compile(rf"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{digits}]|[^{SPACE}{letters}{digits}]+").findall
        # A word needs neither normaliser nor split any more: the library's model encodes it in its byte alphabet.
        alphabet, merge = byte_alphabet(), self.library.model.tokenize
        self.cache = WordCache(lambda w: array("I", [t.id for t in merge(w if w.isascii() and w.isprintable() else "".join([alphabet[b] for b in w.encode()]))]).tobytes())
        self.plain = self._splits_alike()

    def _splits_alike(self) -> bool:
        probe = "It's WE'LL naïve 12 a1b ... (x) é\tÀ\n--  don't_stop\x85a\xa0b"
        return self._by_words(probe.lower()) == self._whole(probe)

    def _by_words(self, lowered: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.split(lowered)))

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_bytes(self, text: str) -> bytes:
        lowered = text.lower()
        # A few letters up to U+024F have small forms beyond it.
        if not self.plain or self.wide(text) or self.wide(lowered) or any(t in text for t in self.added):
            return self._whole(text)
        return self._by_words(lowered)


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


FILE = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("blob", T.BinaryType())])
FILE_ARROW = pa.schema([("bucket", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("blob", pa.binary())])


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> None:
    """Encode every whole text and write the ids, with end_id after each document, as a token file at path."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), text_or_empty(text).alias("t"))
    bucket, n = ordered_buckets(rows, "id", F.octet_length("t"))
    dealt = rows.withColumn("b", bucket).repartitionById(n, F.col("b")).sortWithinPartitions("b", F.col("id").asc_nulls_first(), "t")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        bucket, segment, before, ids, parts, size = None, 0, 0, [], [], 0
        ends: list[int] = []

        def close() -> pa.RecordBatch:
            blob = pack_segment(ids, np.array(ends), np.frombuffer(b"".join(parts), "<u4"))
            return batch_of(FILE_ARROW, [[bucket], [segment], [before], [size], [blob]])

        for b in batches:
            for i, t, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and (k != bucket or size >= SEGMENT_TOKENS):
                    yield close()
                    segment, before = segment + 1, before + size
                    ids, parts, ends, size = [], [], [], 0
                if k != bucket:
                    bucket, segment, before = k, 0, 0
                code = tok.encode_bytes(t) + end
                size += len(code) // 4
                ids.append(i)
                parts.append(code)
                ends.append(size)
        if ids:
            yield close()

    dealt.select("id", "t", "b").mapInArrow(run, FILE).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a token file, with `start`: the ids in all segments before."""
    file = spark.read.schema(FILE).parquet(path)
    totals = sorted((r.bucket, r.n) for r in file.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect())
    offsets, total = [], 0
    for b, n in totals:
        offsets.append((b, total))
        total += n
    starts = spark.createDataFrame(offsets, "bucket int, offset long")
    return file.join(F.broadcast(starts), "bucket").select("bucket", "segment", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "blob")


REPORT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def document_report(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the ids as read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids, ends, codes = unpack_segment(blob.as_py())
                begins = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(codes.run(s, e).astype("<u4", copy=False)) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield batch_of(REPORT, [doc_ids, begins + start, ends - begins, crc])

    return segments.select("start", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_at(segments: DataFrame, wanted: DataFrame, place: str = "place") -> DataFrame:
    """place, id: the token at each number of `wanted` (from 0 over the whole file), read by itself from its segment.

    Numbers outside the file, and null, give no row; repeated ones one row. Of the segments only bounds take part in the
    search: bucket bounds (100,000 at most) are broadcast, then a number meets the segments of its bucket.
    """
    bounds = segments.select("bucket", "segment", "start", "n_tokens")
    buckets = bounds.groupBy("bucket").agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("n_tokens")).alias("high"))
    p = F.col("place")
    at = wanted.select(F.col(f"`{place}`").cast("long").alias("place")).distinct()
    at = at.join(F.broadcast(buckets), (p >= F.col("low")) & (p < F.col("high"))).select("place", "bucket")
    at = at.join(bounds, "bucket").filter((p >= F.col("start")) & (p < F.col("start") + F.col("n_tokens")))
    at = at.groupBy("bucket", "segment").agg(F.collect_list(p - F.col("start")).alias("at"))  # at most a segment's tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("place", pa.int64()), ("id", pa.int64())])
        for b in batches:
            for start, blob, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                *_, codes = unpack_segment(blob.as_py())
                yield batch_of(schema, [[start + i for i in places], [codes[i] for i in places]])

    return segments.join(at, ["bucket", "segment"]).select("start", "blob", "at").mapInArrow(run, "place long, id long")


def file_round_trip(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """Write a token file in the shared folder, read it back and report on each document."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, text, key, end_id)
    return document_report(read_tokens(spark, path))
