"""Near duplicates by the Jaccard similarity of word shingles: five words, 0.8 or more, checked on the whole sets.

Candidates come from two steps. Texts are near if their SimHash fingerprints over the same shingles differ in 3 bits at most,
which the pigeonring of simhash finds, as in op5. At similarity 0.8 fingerprints often differ in more bits (4 to 11 were
seen, about 10 are expected), for which no pigeonring key is selective; these pairs are found by minima: a set has ROWS x
BANDS minima of multiplied hashes; ROWS equal minima of one band make a bucket. A pair of similarity 0.8 has no bucket in
common with probability (1 - 0.8^4)^40 < 1e-9, a more similar one with less. Both give stars, and these give candidate
components, so each pair to link lies within one. Each candidate's set goes once to its
component's task, which links what truly has the similarity. Components of more than BLOCK members are dealt into blocks:
at first each block links its own members, then the largest group found is compared with the members left over, and these
with each other, but not with itself; so a large group of near copies costs about one more row a member.

Sets hold 64-bit hashes (XXH64). Words are those of simhash.fingerprint; a text of at most five words is one shingle, and
texts without words are equal. Rows without a doc_id are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import simhash
from quillspark.llm.common import batch_of, discard, scratch, small_batches, stored, text_or_empty
from quillspark.llm.components import connected_components
from quillspark.llm.digest import mix

WORDS = 5
ROWS, BANDS = 4, 40
#: Members of one candidate component that a task compares at once.
BLOCK = 1024
#: Candidates (three longs) that a broadcast may hold: about 60 MB with their rows' headers.
BROADCAST_ROWS = 1 << 20
#: Odd factors of the minima.
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, ROWS * BANDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.arange(BANDS, dtype=np.uint64)
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    return np.unique(simhash.shingle_hashes(text, words))


def name_of(found: np.ndarray) -> int:
    """64 bits that stand for a set."""
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), simhash.SEED)


def bands(found: np.ndarray) -> np.ndarray:
    """The bucket of a set in each band."""
    low = np.full(ROWS * BANDS, ~np.uint64(0))
    for at in range(0, len(found), 1024):
        np.minimum(low, (found[at : at + 1024] * _FACTORS[:, None]).min(axis=1), out=low)
    code = _BAND.copy()
    for row in low.reshape(ROWS, BANDS):
        code = mix(code ^ row)
    return code


def stars(names: np.ndarray, sets: list[np.ndarray]) -> tuple[list, list]:
    """Edges (member, root) of the groups that links of similarity 0.8 or more connect."""
    names, first = np.unique(names, return_index=True)
    sizes = np.array([len(sets[i]) for i in first])
    _, code, n = np.unique(np.concatenate([sets[i] for i in first]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(names)), sizes)
    owner, code = owner[n[code] > 1], code[n[code] > 1]
    bounds = np.searchsorted(owner, np.arange(len(names) + 1))
    free, a, b = np.ones(len(names), bool), [], []
    for root in range(len(names)):
        queue = [root] if free[root] else []
        free[root] = False
        while queue and free.any():
            x = queue.pop()
            mark = np.zeros(len(n), bool)
            mark[code[bounds[x] : bounds[x + 1]]] = True
            common = np.bincount(owner[mark[code]], minlength=len(names))
            # c / (m + n - c) >= 4 / 5
            new = np.flatnonzero(free & (9 * common >= 4 * (sizes + sizes[x])))
            free[new] = False
            queue += new.tolist()
            a += names[new].tolist()
            b += [int(names[root])] * len(new)
    return a, b


def linked(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """Edges inside each group of equal keys (longs); dealt: fp, found (the set) and the keys."""
    dealt = dealt.select(*keys, "fp", "found").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets = None, [], []

        def edges() -> Iterator[pa.RecordBatch]:
            if len(names) > 1:
                x, y = stars(np.array(names, np.int64), sets)
                yield batch_of(EDGES, [x, y])

        for b in batches:
            flat = b.column(len(keys) + 1)
            values, at = flat.values.to_numpy().view(np.uint64), flat.offsets.to_numpy()
            for i, (*key, name) in enumerate(zip(*(b.column(j).to_pylist() for j in range(len(keys) + 1)), strict=True)):
                if key != now:
                    yield from edges()
                    now, names, sets = key, [], []
                names.append(name)
                sets.append(values[at[i] : at[i + 1]].copy())
        yield from edges()

    return dealt.mapInArrow(run, "a long, b long")


def named(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the set's name), bits (its SimHash) and keys (its buckets); docs: doc_id and text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("bits", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            hashes = [simhash.shingle_hashes(t, words) for t in texts]
            bits = np.array([simhash.fingerprint_of(t, h) for t, h in zip(texts, hashes, strict=True)], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in hashes]
            fps = np.array([name_of(s) for s in sets], np.uint64).view(np.int64)
            yield batch_of(schema, [b.column(0), pa.array(fps), pa.array(bits), [bands(s).view(np.int64) for s in sets]])

    return docs.mapInArrow(run, "doc_id long, fp long, bits long, keys array<long>")


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """root, fp, found; docs: root, fp, text. A row whose text isn't the one that fp names (ids may repeat) gives none."""
    schema = pa.schema([("root", pa.int64()), ("fp", pa.int64()), ("found", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
            rows = [(root, fp, s) for root, fp, t in rows if name_of(s := shingle_set(t, words)) == fp % (1 << 64)]
            yield batch_of(schema, [[r[0] for r in rows], [r[1] for r in rows], [r[2].view(np.int64) for r in rows]])

    return docs.mapInArrow(run, "root long, fp long, found array<long>")


def ring_edges(fps: DataFrame) -> DataFrame:
    """(a, b) of sets: edges that connect those whose SimHash bits link by the pigeonring; fps: fp and bits."""
    sets = stored(fps.groupBy("fp").agg(F.min("bits").alias("bits")), "bits")
    # One set stands for all of equal bits.
    first = stored(sets.groupBy("bits").agg(F.min("fp").alias("b")), "ring-sets")
    same = sets.join(first, "bits").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    links = stored(simhash.bucket_edges(first.select(F.col("bits").alias("fp"))), "ring")
    one, other = first.toDF("a", "fp_a"), first.toDF("b", "fp_b")
    return same.unionAll(links.join(one, "a").join(other, "b").select("fp_a", "fp_b"))


def candidates(fps: DataFrame) -> DataFrame:
    """(node, root): candidate components of at least two sets; fps: fp, bits and keys."""
    keyed = fps.groupBy("fp").agg(F.first("keys").alias("keys")).select("fp", F.explode("keys").alias("bucket"))
    keyed = stored(keyed, "bands")
    # Written, so that the join reads two plain tables and AQE can split a hot bucket.
    least = stored(keyed.groupBy("bucket").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).filter("b < most").select("bucket", "b"), "buckets")
    edges = keyed.join(least, "bucket").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    edges = stored(ring_edges(fps).unionAll(edges).distinct(), "candidates")
    discard(keyed)
    discard(least)
    roots = connected_components(edges)
    discard(edges)
    return roots


def similar_edges(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges that connect whatever links connect inside each candidate component; members: root, fp, found (a table)."""
    wide = stored(members.groupBy("root").agg(F.count_distinct("fp").alias("n")).filter(F.col("n") > block), "wide")
    own = lambda n: F.pmod(F.xxhash64("fp"), F.ceil(n / block))
    # Small tables are broadcast, larger ones joined; a wide component's rows are dealt on by block.
    first = members.join(wide, "root", "left").withColumn("p", F.coalesce(own(F.col("n")), F.lit(0)).cast("long"))
    edges = stored(linked(first, ["root", "p"]), "links")
    if wide.isEmpty():
        return edges
    roots = stored(connected_components(edges).withColumnRenamed("root", "label"), "labels")
    rows = members.join(wide.select("root"), "root", "left_semi")
    labelled = stored(rows.join(roots, rows.fp == roots.node, "left").select("root", "fp", "found", F.coalesce("label", "fp").alias("label")), "labelled")
    each = labelled.groupBy("root", "label").agg(F.count_distinct("fp").alias("n"))
    parts = each.groupBy("root").agg(F.max(F.struct("n", "label")).alias("big"), F.sum("n").alias("n"))
    parts = parts.select("root", F.col("big.label").alias("big"), F.col("big.n").alias("n_big"), (F.col("n") - F.col("big.n")).alias("n_left")).filter("n_left > 0")
    dealt = labelled.join(parts, "root")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / block) - 1)
    mine = lambda n: own(F.col(n)).cast("long")
    to = lambda s, p, q: F.struct(F.lit(s).cast("long").alias("s"), p.alias("p"), q.alias("q"))
    in_big = F.transform(upto("n_left"), lambda q: to(0, mine("n_big"), q))
    in_left = F.concat(
        F.transform(upto("n_big"), lambda p: to(0, p, mine("n_left"))),
        F.transform(upto("n_left"), lambda q: to(1, F.least(q, mine("n_left")), F.greatest(q, mine("n_left")))),
    )
    dealt = dealt.withColumn("to", F.explode(F.when(F.col("label") == F.col("big"), in_big).otherwise(in_left)))
    return edges.unionAll(linked(dealt.select("root", "fp", "found", "to.*"), ["root", "s", "p", "q"]))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, fp (the set's name), component_id (the smallest doc_id that links of similarity 0.8 or more can reach)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text")).filter("doc_id is not null")
    with scratch(docs.sparkSession) as keep:
        fps = stored(named(rows, words), "sets")
        roots = candidates(fps)
        least = fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
        wanted = stored(least.join(roots, least.fp == roots.node).select("doc_id", "fp", "root"), "wanted")
        # Few candidates go to every task, so texts stay where they are; more are joined by a shuffle of the texts.
        asked = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        members = stored(sets_of(rows.join(asked, "doc_id").select("root", "fp", "text"), words), "members")
        edges = stored(similar_edges(members, block), "edges")
        discard(members)
        return keep(stored(simhash.grouped(fps.select("doc_id", "fp"), edges), "groups"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, as simhash.keep_one."""
    return simhash.without_copies(docs, near_duplicates(docs, text, key, words), key)
