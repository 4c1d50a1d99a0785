"""A stored inverted index of segments: added to, deleted from, merged, and searched for the best k without reading all of it.

A segment is two Parquet tables. `docs` has key, n_terms and the distinct terms of each document. `postings` has one row for
each block of up to BLOCK documents of a term: keys, hits, lengths and places as arrays, and beside them the most hits and the
least length in the block. Blocks hold the documents of a term from many hits to few, so the bounds of later blocks are low.
Blocks lie in folders by a hash of the term; tasks and folders follow the number of terms, and a frequent term is spread by its
keys. Tokens are packed by term in the tasks that read the texts, shuffled once, and put in order by tasks that hold RUN
documents of a term at most. Statistics (documents, terms) stand in the manifest, a small table written anew for each change; readers take the newest
complete one, and what it doesn't name is no part of the index until vacuum() removes it. There is one writer at a time.

Deleting writes the keys and, by term, how many documents went; readers leave those keys out and subtract those numbers, so
statistics and ranks are those of an index built anew. merge() joins segments of like size and drops what was deleted.

Queries of whole terms under AND and OR are ranked from blocks alone. top() first reads the blocks of highest bounds, which
gives the k-th best score so far; after that it reads the blocks that can still hold a better document (beside a much rarer
term nearly all of a frequent one, since the sums of the rare term's documents need them). Phrases, prefixes, fields
and NOT take all postings of their terms. Null texts count as empty; keys must be new and distinct, null keys are left out.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators import search
from quillspark.operators.arrow import bounded_batches

#: Documents of one posting block, terms (with repeats) for one write task, segments of one size that merge() joins.
BLOCK, TASK_TERMS, FANOUT = 128, 4_000_000, 4
#: Documents of a term that a write task orders at once.
RUN = 1 << 16
MANIFEST = "segment string, n_docs long, n_terms long, buckets int, fields array<string>, key_type string, gone array<string>"
#: For the key's type. A place is the number of the field times 2^32 plus the position; packed places are those of all keys in a row.
PACKED = "term string, key array<{0}>, hits array<int>, n_terms array<int>, places array<long>"
POSTINGS = "bucket int, term string, n int, most_hits int, least_terms long, key array<{0}>, hits array<int>, n_terms array<long>, places array<array<long>>"


def term_bucket(term: Column, buckets: int | Column) -> Column:
    return F.pmod(F.xxhash64(term), buckets if isinstance(buckets, Column) else F.lit(buckets)).cast("int")


# --- manifest ---------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _versions(spark: SparkSession, path: str) -> list[str]:
    return [v for v in _names(spark, f"{path}/manifest") if "_SUCCESS" in _names(spark, f"{path}/manifest/{v}")]


def available(spark: SparkSession, path: str) -> bool:
    """Whether there is an index at path."""
    return bool(_versions(spark, path))


def segments(spark: SparkSession, path: str) -> list[Row]:
    """The rows of the newest manifest, one for each segment."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no index at {path}")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/{versions[-1]}").orderBy("segment").collect()


def _publish(spark: SparkSession, path: str, rows: list[Row]) -> None:
    versions = _names(spark, f"{path}/manifest")
    number = int(versions[-1]) + 1 if versions else 0
    spark.createDataFrame([tuple(r) for r in rows], MANIFEST).coalesce(1).write.parquet(f"{path}/manifest/{number:08d}")


def vacuum(spark: SparkSession, path: str) -> None:
    """Remove what the newest manifest doesn't name. No reader of an older one may be at work."""
    rows = segments(spark, path)
    named = {"manifest": {_versions(spark, path)[-1]}, "segments": {r.segment for r in rows}, "gone": {g for r in rows for g in r.gone}}
    for kind, keep in named.items():
        for name in set(_names(spark, f"{path}/{kind}")) - keep:
            fs, at = _folder(spark, f"{path}/{kind}/{name}")
            fs.delete(at, True)


# --- writing ----------------------------------------------------------------------------------------------------------


def _tokens(docs: DataFrame, fields: list[str], key: str) -> DataFrame:
    """key and the terms of each field, in columns named f0, f1 and so on."""
    terms = [search.terms(F.col(f)).alias(f"f{i}") for i, f in enumerate(fields)]
    return docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), *terms)


def _lists(ends: np.ndarray, values: pa.Array | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _bounds(changed: np.ndarray) -> np.ndarray:
    """Where runs begin, and the end; changed: whether each element differs from the one before it."""
    return np.concatenate([[0], np.flatnonzero(changed) + 1, [len(changed) + 1]])


def _packed(tokens: DataFrame) -> DataFrame:
    """PACKED rows of _tokens(): one for each term of an Arrow batch of documents, with all its documents there. So a token is
    8 bytes of a shuffle, and not a row."""
    bounded_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [b.column(i) for i in range(1, b.num_columns)]
            sizes = [np.diff(c.offsets.to_numpy()) for c in lists]
            words = pa.concat_arrays([c.flatten().cast(pa.string()) for c in lists])
            if not len(words):
                continue
            doc = np.concatenate([np.repeat(np.arange(b.num_rows), n) for n in sizes])
            place = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (i << 32) for i, n in enumerate(sizes)])
            coded = words.dictionary_encode()
            pair = coded.indices.to_numpy().astype(np.int64) * b.num_rows + doc
            order = np.argsort(pair, kind="stable")  # fields and positions stay in order
            pair, place = pair[order], place[order]
            entries = _bounds(np.diff(pair) != 0)
            pair = pair[entries[:-1]]
            term, doc = pair // b.num_rows, pair % b.num_rows
            rows = _bounds(np.diff(term) != 0)
            columns = [coded.dictionary.take(pa.array(term[rows[:-1]])), _lists(rows, b.column(0).take(pa.array(doc))), _lists(rows, np.diff(entries).astype(np.int32)), _lists(rows, sum(sizes)[doc].astype(np.int32)), _lists(entries[rows], place)]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "key", "hits", "n_terms", "places"])

    return tokens.mapInArrow(run, PACKED.format(tokens.schema["key"].dataType.simpleString()))


def _blocked(packed: DataFrame, size: int, most: int) -> DataFrame:
    """POSTINGS of packed rows with their bucket, sorted by bucket and term. A term of more than `most` documents in a task is
    ordered in runs, so a task holds one run at a time."""
    bounded_batches(packed.sparkSession)

    def blocks(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        column = lambda name: t.column(name).combine_chunks()
        counts = np.diff(column("key").offsets.to_numpy())
        row = np.repeat(np.arange(t.num_rows), counts)
        terms = column("term").dictionary_encode()
        term = terms.indices.to_numpy()[row]
        hits, n_terms, key = column("hits").flatten().to_numpy(), column("n_terms").flatten().to_numpy().astype(np.int64), column("key").flatten()
        order = pc.sort_indices(pa.table({"t": term, "h": -hits, "n": n_terms, "k": key}), [(c, "ascending") for c in "thnk"])
        at = order.to_numpy()
        term, n_terms, starts = term[at], n_terms[at], np.cumsum(hits) - hits
        first = _bounds(np.diff(term) != 0)
        number = np.arange(len(at)) - np.repeat(first[:-1], np.diff(first))
        cuts = np.append(np.flatnonzero(number % size == 0), len(at))
        begin, length = cuts[:-1], hits[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        places = column("places").flatten().to_numpy()[np.repeat(starts[at] - ends[:-1], length) + np.arange(ends[-1])]
        columns = [column("bucket").take(pa.array(row[at[begin]])), terms.dictionary.take(pa.array(term[begin])), pa.array(np.diff(cuts), pa.int32()), pa.array(length[begin], pa.int32())]
        columns += [pa.array(np.minimum.reduceat(n_terms, begin)), _lists(cuts, key.take(order)), _lists(cuts, length), _lists(cuts, n_terms), _lists(cuts, _lists(ends, places))]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "term", "n", "most_hits", "least_terms", "key", "hits", "n_terms", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last term, of which more may come
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            cut = pc.index(t.column("term"), t.column("term")[-1]).as_py()
            if pc.sum(pc.list_value_length(t.column("key").slice(cut))).as_py() >= most:
                cut = t.num_rows
            if cut:
                yield blocks(t.slice(0, cut))
            held = t.slice(cut) if cut < t.num_rows else None
        if held is not None:
            yield blocks(held)

    return packed.mapInArrow(run, POSTINGS.format(packed.schema["key"].dataType.elementType.simpleString()))


def _write_segment(spark: SparkSession, path: str, documents: DataFrame, packed: DataFrame, fields: list[str]) -> Row:
    """A new segment of documents (key, n_terms, terms) and of packed rows, whose places number these fields."""
    name = uuid.uuid4().hex
    at = f"{path}/segments/{name}"
    documents.write.option("compression", "zstd").parquet(f"{at}/docs")
    size = spark.read.schema(documents.schema).parquet(f"{at}/docs").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    tasks = max(1, -(-size.terms // TASK_TERMS))
    salts = math.ceil(math.sqrt(tasks))
    buckets = -(-tasks // salts)
    # Any documents may share a block, so a frequent term is spread by the first key of each of its rows.
    dealt = packed.withColumn("bucket", term_bucket(F.col("term"), buckets)).repartition(buckets * salts, "bucket", F.pmod(F.xxhash64(F.col("key")[0]), F.lit(salts)))
    blocks = _blocked(dealt.sortWithinPartitions("bucket", "term"), BLOCK, RUN)
    blocks.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{at}/postings")
    kind = documents.schema["key"].dataType.simpleString()
    return Row(segment=name, n_docs=size.n, n_terms=size.terms, buckets=buckets, fields=fields, key_type=kind, gone=[])


def _segment_of(docs: DataFrame, path: str, fields: list[str], key: str) -> Row:
    tokens = _tokens(docs, fields, key)
    each = [f"f{i}" for i in range(len(fields))]
    n_terms = reduce(lambda a, b: a + b, [F.size(f) for f in each]).cast("long").alias("n_terms")
    documents = tokens.select("key", n_terms, F.array_distinct(F.concat(*each)).alias("terms"))
    return _write_segment(docs.sparkSession, path, documents, _packed(tokens), list(fields))


def write_index(docs: DataFrame, path: str, fields: list[str], key: str = "id") -> None:
    """Index the fields of docs at path; an index that was there is replaced as soon as the new one is whole."""
    _publish(docs.sparkSession, path, [_segment_of(docs, path, fields, key)])


#: The same: nothing of the old index, deletions included, stays in the manifest.
rebuild = write_index


def add_documents(docs: DataFrame, path: str, fields: list[str], key: str = "id") -> None:
    """Index more documents as a segment; their keys must be new, or deleted."""
    spark = docs.sparkSession
    _publish(spark, path, [*segments(spark, path), _segment_of(docs, path, fields, key)])


def _gone(spark: SparkSession, path: str, row: Row, table: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/gone/{g}/{table}") for g in row.gone])


def _live(table: DataFrame, spark: SparkSession, path: str, row: Row) -> DataFrame:
    """The rows of a segment's table whose key hasn't been deleted."""
    return table.join(_gone(spark, path, row, "keys").select("key"), "key", "left_anti") if row.gone else table


def _docs(spark: SparkSession, path: str, row: Row) -> DataFrame:
    return _live(spark.read.schema(f"key {row.key_type}, n_terms long, terms array<string>").parquet(f"{path}/segments/{row.segment}/docs"), spark, path, row)


def delete_documents(keys: DataFrame, path: str, key: str = "id") -> None:
    """Delete by key; keys that aren't there are ignored."""
    spark, rows = keys.sparkSession, []
    wanted = keys.select(F.col(key).alias("key")).filter("key is not null").distinct()
    for row in segments(spark, path):
        name, docs = uuid.uuid4().hex, _docs(spark, path, row)
        # The terms of documents are read for those that go, and take no part in the search for them.
        docs.select("key", "n_terms").join(wanted, "key", "left_semi").write.parquet(f"{path}/gone/{name}/keys")
        met = spark.read.schema(f"key {row.key_type}, n_terms long").parquet(f"{path}/gone/{name}/keys")
        size = met.agg(F.count(F.lit(1)).alias("n"), F.sum("n_terms").alias("terms")).first()
        if size.n:
            terms = docs.join(met.select("key"), "key", "left_semi").select(F.explode("terms").alias("term"))
            terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/gone/{name}/terms")
            row = Row(**{**row.asDict(), "n_docs": row.n_docs - size.n, "n_terms": row.n_terms - size.terms, "gone": [*row.gone, name]})
        if row.n_docs:
            rows.append(row)
    _publish(spark, path, rows)


def tiers(rows: list[Row], fanout: int = FANOUT) -> list[list[Row]]:
    """Segments of like size (within a factor of fanout) where there are fanout of them or more."""
    found: dict[int, list[Row]] = {}
    for r in rows:
        found.setdefault(int(math.log(max(r.n_docs, 1), fanout)), []).append(r)
    return [t for _, t in sorted(found.items()) if len(t) >= fanout]


def _repacked(spark: SparkSession, path: str, row: Row, fields: list[str]) -> DataFrame:
    """PACKED rows of a segment's live documents, whose places number `fields`."""
    blocks = _postings(spark, path, row)
    if row.gone:
        one = [F.array(c).alias(c) for c in ("key", "hits")]
        packed = _entries(spark, path, row, blocks, places=True).select("term", *one, F.array(F.col("n_terms").cast("int")).alias("n_terms"), "places")
    else:
        packed = blocks.select("term", "key", "hits", F.col("n_terms").cast("array<int>").alias("n_terms"), F.flatten("places").alias("places"))
    if row.fields == fields:
        return packed
    number = F.array(*[F.lit(fields.index(f)).cast("long") for f in row.fields])
    moved = lambda p: F.shiftleft(F.get(number, F.shiftright(p, 32).cast("int")), 32) + p.bitwiseAND((1 << 32) - 1)
    return packed.withColumn("places", F.transform("places", moved))


def merge(spark: SparkSession, path: str, fanout: int = FANOUT) -> int:
    """Join segments of like size until no size has fanout of them; how many joins that took. Readers see one manifest or
    the next."""
    joins = 0
    while full := tiers(rows := segments(spark, path), fanout):
        part = full[0]
        documents = reduce(DataFrame.unionByName, [_docs(spark, path, r) for r in part])
        fields = sorted({f for r in part for f in r.fields})
        packed = reduce(DataFrame.unionByName, [_repacked(spark, path, r, fields) for r in part])
        merged = _write_segment(spark, path, documents, packed, fields)
        _publish(spark, path, [*[r for r in rows if r not in part], merged])
        joins += 1
    return joins


# --- reading ----------------------------------------------------------------------------------------------------------


def _entries(spark: SparkSession, path: str, row: Row, blocks: DataFrame, places: bool = False) -> DataFrame:
    """term, key, hits, n_terms (and places) of the live documents in blocks; without places, these aren't read."""
    columns = ["key", "hits", "n_terms", *(["places"] if places else [])]
    out = blocks.select("term", F.explode(F.arrays_zip(*columns)).alias("e")).select("term", *[f"e.{c}" for c in columns])
    return _live(out, spark, path, row)


def sizes(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    rows = segments(spark, path)
    none = spark.createDataFrame([], "key long, n_terms long")
    return reduce(DataFrame.unionByName, [_docs(spark, path, r).select("key", "n_terms") for r in rows] or [none]).withColumnRenamed("key", key)


def statistics(rows: list[Row]) -> tuple[int, float]:
    """Documents, and mean number of terms."""
    n = sum(r.n_docs for r in rows)
    return n, sum(r.n_terms for r in rows) / n if n else 0.0


def _postings(spark: SparkSession, path: str, row: Row) -> DataFrame:
    # With its schema, since a segment without terms has no file.
    return spark.read.schema(POSTINGS.format(row.key_type)).parquet(f"{path}/segments/{row.segment}/postings")


def _blocks(spark: SparkSession, path: str, row: Row, whole: set[str], prefixes: set[str] = frozenset()) -> DataFrame:
    """The blocks of terms: whole ones name their folders, prefixes a range of terms in every folder."""
    tests = [(F.col("bucket") == term_bucket(F.lit(t), row.buckets)) & (F.col("term") == t) for t in sorted(whole)]
    tests += [F.startswith(F.col("term"), F.lit(p)) for p in sorted(prefixes)]
    return _postings(spark, path, row).filter(reduce(lambda a, b: a | b, tests, F.lit(False)))


def postings_of(spark: SparkSession, path: str, tree: tuple, key: str = "id") -> DataFrame:
    """key, field (its name where the query names it, else its number), pos, term, n_terms: the postings of a query's terms."""
    whole, prefixes, asked = set(), set(), set()

    def visit(t: tuple) -> None:
        if t[0] == "phrase":
            asked.add(t[3])
            for i, term in enumerate(t[1]):
                (prefixes if t[2] and i == len(t[1]) - 1 else whole).add(term)
        else:
            visit(t[1])
            visit(t[2])

    visit(tree)
    parts = []
    for r in segments(spark, path):
        rows = _entries(spark, path, r, _blocks(spark, path, r, whole, prefixes), places=True).select("key", "term", "n_terms", F.explode("places").alias("p"))
        number = F.shiftright("p", 32)
        field = reduce(lambda c, i: F.when(number == i, r.fields[i]).otherwise(c), [i for i, f in enumerate(r.fields) if f in asked], F.concat(F.lit("#"), number.cast("string")))
        parts.append(rows.select(F.col("key").alias(key), field.alias("field"), F.col("p").bitwiseAND((1 << 32) - 1).cast("int").alias("pos"), "term", "n_terms"))
    if not parts:
        return spark.createDataFrame([], f"{key} long, field string, pos int, term string, n_terms long")
    return reduce(DataFrame.unionByName, parts)


def find(spark: SparkSession, path: str, query: str, key: str = "id") -> DataFrame:
    """Keys of the documents that match; a blank query matches none."""
    if not query.strip():
        return sizes(spark, path, key).select(key).filter(F.lit(False))
    tree = search.parse(query)
    if (names := plain_terms(tree)) is not None and segments(spark, path):
        return _scored(spark, path, tree, names, key).select(key)
    return search.matching(postings_of(spark, path, tree, key), tree, key)


def count(spark: SparkSession, path: str, query: str, key: str = "id") -> DataFrame:
    return find(spark, path, query, key).agg(F.count(F.lit(1)).alias("matches"))


def plain_terms(tree: tuple) -> list[str] | None:
    """The terms of a query of whole terms under AND and OR in the order of search.phrases(); None for any other."""
    if tree[0] == "not":
        return None
    if tree[0] == "phrase":
        return tree[1] if len(tree[1]) == 1 and not tree[2] and tree[3] is None else None
    parts = [plain_terms(t) for t in tree[1:]]
    return None if None in parts else parts[0] + parts[1]


def _part(hits: Column, n_terms: Column, mean: float) -> Column:
    """A term's share of the score without its idf: more for more hits, less for longer documents."""
    return search.saturation(hits, n_terms, F.lit(mean))


def _weights(spark: SparkSession, path: str, rows: list[Row], names: list[str], mean: float) -> dict[str, Row]:
    """For each term of a query: df (live documents), top (the largest bound of a block without idf), blocks."""
    parts = []
    for r in rows:
        parts.append(_blocks(spark, path, r, set(names)).select("term", "n", _part(F.col("most_hits"), F.col("least_terms"), mean).alias("part"), F.lit(1).alias("block")))
        if r.gone:
            gone = _gone(spark, path, r, "terms").filter(F.col("term").isin(names))
            parts.append(gone.select("term", (-F.col("n")).alias("n"), F.lit(None).cast("double").alias("part"), F.lit(0).alias("block")))
    found = reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.sum("n").alias("df"), F.max("part").alias("top"), F.sum("block").alias("blocks"))
    return {r.term: r for r in found.collect()}  # one row for each term of the query


def _scored(spark: SparkSession, path: str, tree: tuple, names: list[str], key: str, weigh: dict[str, float] | None = None, mean: float = 0.0, keep=None) -> DataFrame:
    """key, and rank where terms have weights, of the documents that satisfy the tree by the blocks that `keep` leaves of each segment."""
    rows = segments(spark, path)
    parts = [_entries(spark, path, r, keep(_blocks(spark, path, r, set(names))) if keep else _blocks(spark, path, r, set(names))) for r in rows]
    entries = reduce(DataFrame.unionByName, parts)
    terms = sorted(set(names))
    have = [F.max(F.col("term") == t).alias(f"have_{i}") for i, t in enumerate(terms)]
    score = [(-F.sum(_by_term(weigh) * _part(F.col("hits"), F.col("n_terms"), mean))).alias("rank")] if weigh else []
    out = entries.groupBy("key").agg(*have, *score)
    met = search.needed(tree, [F.col(f"have_{terms.index(t)}") for t in names])
    return out.filter(met).select(F.col("key").alias(key), *(["rank"] if weigh else []))


def _by_term(values: dict[str, float]) -> Column:
    return reduce(lambda c, t: c.when(F.col("term") == t, F.lit(float(values[t]))), sorted(values), F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(0.0))


def rank(spark: SparkSession, path: str, query: str, key: str = "id") -> DataFrame:
    """key, rank: BM25 from the stored postings and statistics, for all documents that match."""
    rows = segments(spark, path)
    if not query.strip() or not rows:
        return sizes(spark, path, key).select(key, F.lit(0.0).alias("rank")).filter(F.lit(False))
    tree = search.parse(query)
    n, mean = statistics(rows)
    if (names := plain_terms(tree)) is None:
        return search.ranked(postings_of(spark, path, tree, key), None, tree, key, (n, mean))
    found = _weights(spark, path, rows, names, mean)
    return _scored(spark, path, tree, names, key, {t: names.count(t) * search.idf_of(n, found[t].df if t in found else 0) for t in names}, mean)


def bounded(spark: SparkSession, path: str, query: str, k: int, key: str = "id", allowed: DataFrame | None = None):
    """(scorer, keep) of a query of plain terms: scorer(keep) ranks the documents of the blocks that keep leaves, and keep
    leaves those that can hold one of the k best of `allowed` (keys; None: all). None for queries of other kinds."""
    rows = segments(spark, path)
    tree = search.parse(query)
    names = plain_terms(tree)
    if names is None or not rows:
        return None
    n, mean = statistics(rows)
    found = _weights(spark, path, rows, names, mean)
    weigh = {t: names.count(t) * search.idf_of(n, found[t].df if t in found else 0) for t in names}
    most = {t: weigh[t] * (found[t].top or 0.0) if t in found else 0.0 for t in weigh}
    bound = _by_term(weigh) * _part(F.col("most_hits"), F.col("least_terms"), mean)

    def scorer(keep) -> DataFrame:
        out = _scored(spark, path, tree, names, key, weigh, mean, keep)
        return out if allowed is None else out.join(allowed.select(key).distinct(), key, "left_semi")

    all_blocks = max((r.blocks for r in found.values()), default=0)
    first, least = -(-k // BLOCK) + 1, -math.inf
    while first < all_blocks:
        best = Window.partitionBy("term").orderBy(bound.desc())
        head = scorer(lambda b, m=first: b.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= m))
        # Sums over some of a document's terms are below its score, so the k-th of them is a score that k documents reach.
        kth = head.orderBy("rank").limit(k).agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("worst")).first()
        if kth.n == k:
            least = -kth.worst
            break
        first *= 16
    others = {t: sum(v for u, v in most.items() if u != t) for t in most}
    return scorer, lambda b: b.filter(bound + _by_term(others) >= least - 1e-9)


def top(spark: SparkSession, path: str, query: str, k: int, key: str = "id", allowed: DataFrame | None = None) -> DataFrame:
    """key, rank of the k best documents of `allowed` (keys; None: all), ties by key: what rank() has first."""
    if k < 1:
        raise ValueError("k must be 1 at least")
    if query.strip() and (plan := bounded(spark, path, query, k, key, allowed)):
        scorer, keep = plan
        return scorer(keep).orderBy("rank", key).limit(k)
    found = rank(spark, path, query, key)
    return (found if allowed is None else found.join(allowed.select(key).distinct(), key, "left_semi")).orderBy("rank", key).limit(k)


def blocks_read(spark: SparkSession, path: str, query: str, k: int) -> tuple[int, int]:
    """How many blocks top() reads in its last step, and how many the terms have."""
    _, keep = bounded(spark, path, query, k)
    parts = [_blocks(spark, path, r, set(plain_terms(search.parse(query)))) for r in segments(spark, path)]
    return sum(keep(p).count() for p in parts), sum(p.count() for p in parts)
