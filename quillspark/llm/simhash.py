"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is a ring of four 16-bit segments. If two fingerprints differ in at most `distance` bits, then from
some segment on every chain of l consecutive segments differs in at most l * distance / 4 bits (the strong form of the
pigeonring principle; Qin and Xiao, VLDB 2018). For distance 3 this means: segment i is equal, segments i and i+1
together differ in at most 1 bit, three of them in at most 2. The join key holds segment i whole and one half of segment
i+1: of two 8-bit halves with one differing bit at most, one is equal. In a bucket the chain budgets prune pairs before
the full Hamming check.

Near copies may be many, so a bucket never yields its pairs: it yields a star for each group linked inside it, at most
one row a member. A bucket of more than BLOCK members is cut into blocks, and pairs of blocks go to separate tasks, so
no task holds an unbounded bucket and no link is lost. Only distinct fingerprints take part; exact copies meet in a
group-by with map-side combine.

Null and empty texts and texts of white space alone have fingerprint zero and are linked like any other. Rows of one
doc_id are kept apart and each gets its class. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import batch_of, discard, free_name, scratch, small_batches, stored, text_or_empty
from quillspark.llm.components import connected_components

#: Fixed value: the seed of XXH64.
SEED = 42
SEGMENTS, SEGMENT_BITS = 4, 16
#: Members of one bucket that a task compares at once.
BLOCK = 4096
#: Ids of copies that a broadcast may hold, 32 MB with their rows' headers.
BROADCAST_IDS = 1 << 21

def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """The XXH64 values of the word shingles, repeats included; a text without words has that of the empty string.

    On bytes, lower() changes A-Z alone and split() parts words at U+0020 and U+0009 to U+000D alone.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    data = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(data, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(data)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[s:e], SEED) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts))


def fingerprint(text: str, shingle: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 values of the word shingles, repeats included."""
    return fingerprint_of(text, shingle_hashes(text, shingle))


def fingerprint_of(text: str, hashes: np.ndarray) -> int:
    """The fingerprint of a text whose shingles have these hashes."""
    return majority(hashes) if text.strip(" \t\n\v\f\r") else 0


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the values."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long)."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield batch_of(schema, [b.column(0), pa.array(fps.view(np.int64))])

    return docs.select(F.col(f"`{key}`").cast("long"), text_or_empty(text)).mapInArrow(run, "doc_id long, fp long")


def linked(x: np.ndarray, others: np.ndarray, segment: int, distance: int = 3) -> np.ndarray:
    """Which of `others` pass the chain budgets from `segment` on and then the full check against the fingerprint x."""
    ring = np.uint64((1 << SEGMENT_BITS) - 1)
    diff, total, ok = others ^ x, np.zeros(len(others), np.uint8), np.ones(len(others), bool)
    for step in range(SEGMENTS):
        at = np.uint64(SEGMENT_BITS * ((segment + step) % SEGMENTS))
        total += np.bitwise_count((diff >> at) & ring)
        ok &= total * SEGMENTS <= (step + 1) * distance
    return ok


def stars(fps: np.ndarray, segment: int, distance: int = 3) -> tuple[list, list]:
    """Edges (member, least member) of the groups that links inside a bucket connect."""
    rest, a, b = np.unique(fps), [], []
    while len(rest) > 1:
        root, queue = rest[0], [rest[0]]
        rest = rest[1:]
        while queue and len(rest):
            found = linked(queue.pop(), rest, segment, distance)
            if found.any():
                new = rest[found]
                rest = rest[~found]
                queue += list(new)
                a += new.tolist()
                b += [int(root)] * len(new)
    return a, b


def bucket_edges(distinct: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect whatever links of at most `distance` bits connect; distinct: a column fp without repeats."""
    if not 0 <= distance <= 3:
        raise ValueError("the bucket keys hold for distances of 0 to 3")
    keys = []
    for i in range(SEGMENTS):
        nxt = SEGMENT_BITS * ((i + 1) % SEGMENTS)
        whole = F.shiftrightunsigned("fp", SEGMENT_BITS * i).bitwiseAND(F.lit(0xFFFF))
        for half in (0, 1):
            part = F.shiftrightunsigned("fp", nxt + 8 * half).bitwiseAND(F.lit(0xFF))
            keys.append((F.lit((2 * i + half) << 24).cast("long") + F.shiftleft(part, 16) + whole).cast("int"))
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    wide = sizes.filter(F.col("n") > block).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    keyed = keyed.join(sizes.select("bucket"), "bucket", "left_semi").join(wide, "bucket", "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda j: F.struct(F.least(own, j).alias("p"), F.greatest(own, j).alias("q")))
    dealt = keyed.select("fp", "bucket", F.explode(meets).alias("pair")).select("fp", "bucket", "pair.p", "pair.q")
    # Runs of equal (bucket, p, q) lie together after the sort; each is at most two blocks long.
    dealt = dealt.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None
        for b in (*batches, None):
            if b is None:
                if kept is None:
                    return
                fp, code, last = *kept, True
            else:
                if not b.num_rows:
                    continue
                fp = b.column(0).to_numpy().view(np.uint64)
                code = np.stack([b.column(i).to_numpy() for i in (1, 2, 3)])
                if kept is not None:
                    fp, code = np.concatenate([kept[0], fp]), np.concatenate([kept[1], code], axis=1)
                last = False
            cuts = np.flatnonzero((code[:, 1:] != code[:, :-1]).any(axis=0)) + 1
            bounds = [0, *cuts.tolist(), *([len(fp)] if last else [])]
            x, y = [], []
            for s, e in zip(bounds, bounds[1:], strict=False):
                if e - s > 1:
                    found = stars(fp[s:e], int(code[0, s]) >> 25, distance)
                    x += found[0]
                    y += found[1]
            if not last:
                kept = fp[bounds[-1] :].copy(), code[:, bounds[-1] :].copy()
            if x:
                yield batch_of(schema, [pa.array(np.array(x, np.uint64).view(np.int64)), pa.array(np.array(y, np.uint64).view(np.int64))])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links can reach, itself included)."""
    with scratch(docs.sparkSession) as keep:
        fps = stored(fingerprints(docs, text, key, shingle), "simhash")
        edges = stored(bucket_edges(fps.groupBy("fp").agg(F.min("doc_id")).select("fp"), distance), "links")
        found = grouped(fps, edges).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
        return keep(stored(found, "groups"))


def grouped(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id of the group; fps and edges (between values of fp) are tables of stored()."""
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(edges)
    discard(edges)
    joined = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    moved = joined.join(roots.select("node"), joined.fp == roots.node, "left_semi")
    least = moved.groupBy("root").agg(F.min("least").alias("component"))
    moved = stored(moved.join(least, "root").filter("component < least").select("fp", "component"), "moved")
    classes = classes.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    # Both sides are plain tables, so AQE can split the hot class on the rows' side.
    return fps.join(stored(classes, "classes"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, distance: int = 3) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group. Rows of one doc_id are one document and stay or go
    together; rows with a null doc_id have no identity to compare and stay.
    """
    return without_copies(docs, near_duplicates(docs, text, key, shingle, distance), key)


def without_copies(docs: DataFrame, groups: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs but those that `groups` gives to another doc_id; docs may have columns of any names.

    The ids that go are written and counted first. Up to BROADCAST_IDS of them go to every task, so texts stay where they are;
    more are joined by a shuffle, which moves whole texts once (about 1 x input).
    """
    gone = groups.filter("doc_id is not null and component_id is not null and doc_id <> component_id").select("doc_id").distinct()
    name = free_name("gone", docs.columns)
    gone = stored(gone.withColumnRenamed("doc_id", name), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col(f"`{key}`").cast("long") == F.col(name), "left_anti")
