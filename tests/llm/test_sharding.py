import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import regex
from pyspark.sql import functions as F

from quillspark.llm import sharding

real = F.xxhash64


def brute_pack(vectors, shards):
    total = [sum(v[d] for v in vectors) for d in range(3)]
    items = [[v[d] / (total[d] / shards) for d in range(3)] for v in vectors]
    left, out = [[1.0] * 3 for _ in range(shards)], [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-max(items[i]), i)):
        dots = [sum(a * b for a, b in zip(left[k], items[i], strict=True)) for k in range(shards)]
        out[i] = dots.index(max(dots))
        left[out[i]] = [a - b for a, b in zip(left[out[i]], items[i], strict=True)]
    return out


def test_packing_by_brute_force():
    rnd = random.Random(2)
    v = [[rnd.randrange(1, 999), rnd.randrange(1, 99), rnd.randrange(1, 9)] for _ in range(200)]
    assert sharding.pack(np.array(v, float), 5).tolist() == brute_pack(v, 5)
    assert sharding.pack(np.zeros((0, 3)), 5).tolist() == []


def check(rows, texts):
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    by_id = {i: (t or "").encode() for i, t in texts}
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(by_id[r.doc_id]) + 1, zlib.crc32(by_id[r.doc_id]), "bytes", None) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    return sizes


def test_balance_groups_and_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 20)
    rnd = random.Random(4)
    texts = [(i, "".join(rnd.choice("ab é") for _ in range(int(rnd.paretovariate(1)) * 20 % 3000))) for i in range(3000)]
    texts += [(3000 + i, "copied text " * 9) for i in range(150)] + [(4000, None), (4001, "")]
    df = spark.createDataFrame([(i, t, 3) for i, t in texts], "doc_id long, text string, shard int")
    rows = sharding.assign(df).collect()
    sizes = check(rows, texts)
    assert max(sizes.values()) < 1.03 * min(sizes.values())
    where = defaultdict(set)
    for r in rows:
        where[dict(texts)[r.doc_id] or ""].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) < 1.2 * min(counts.values())


def test_group_larger_than_a_shard(spark):
    texts = [(i, "hot " * 50) for i in range(500)] + [(i, f"cold {i}") for i in range(500, 1500)]
    sizes = check(sharding.assign(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts)
    assert len(sizes) == 8 and max(sizes.values()) < 1.5 * min(sizes.values())


def test_written_shards_hold_every_row_once(spark, tmp_path):
    """Repeated rows and ids, null ids, and columns with the names that are added."""
    rows = [(i, f"text {i}", i, "s") for i in range(40)] + [(1, "text 1", 1, "s"), (1, "text 1", 99, "s"), (2, "other", 5, "s")]
    rows += [(None, None, i, "s") for i in range(30)] + [(None, "text 1", 7, "s"), (None, "long " * 400, 8, "s")] + [(None, "long " * 400, 8, "s")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, shard long, slot string")
    sharding.write_shards(df, f"file://{tmp_path}/out")
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard_].append(r.slot_)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard_ for r in got if r.text and r.text.startswith("long")}) > 1  # more bytes than a shard: in parts


def test_empty_and_odd_tables(spark):
    schema = "doc_id long, text string, shard int"
    df = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (None, None, 0)], schema)
    assert sharding.assign(df.limit(0)).count() == 0 and sharding.assign(df).count() == 3


def test_texts_that_share_a_hash(spark, monkeypatch):
    """Groups are told by hash, size and CRC, so texts whose hashes are equal still get their shards."""
    monkeypatch.setattr(sharding.F, "xxhash64", lambda *c: F.lit(5).cast("long") if len(c) == 1 else real(*c))
    texts = [(i, "x" * (i % 50)) for i in range(400)]
    rows = sharding.assign(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check(rows, texts)
    assert all(r.shard is not None for r in rows)


def spread(vectors, shards_of):
    """Largest over smallest shard for bytes, tokens, rows."""
    sums = [[0.0] * 3 for _ in range(8)]
    for v, k in zip(vectors, shards_of, strict=True):
        for d in range(3):
            sums[k][d] += v[d]
    return [max(s[d] for s in sums) / min(s[d] for s in sums) for d in range(3)]


def test_bundles_against_plain_packing(spark):
    """What packing small groups as bundles costs against placing each group by itself."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    groups = defaultdict(lambda: [0, 0, 0])
    texts = {r.doc_id: r.text for r in docs.collect()}
    count = lambda t: len(regex.findall(sharding.PIECES, t))
    for t in texts.values():
        groups[t] = [a + b for a, b in zip(groups[t], (len(t.encode()) + 1, count(t), 1), strict=True)]
    plain = spread(groups.values(), sharding.pack(np.array(list(groups.values()), float), 8))
    rows = sharding.assign(docs).collect()
    mine = spread([(r.size, count(texts[r.doc_id]), 1) for r in rows], [r.shard for r in rows])
    assert mine[0] < 1.03 and plain[0] < 1.03 and max(mine) < 1.1, (mine, plain)


def test_tokens_from_a_column(spark):
    rows = [(i, f"text {i} " * 20, 1 if i % 2 else 999) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = {r.doc_id: r.shard for r in sharding.assign(df, tokens="n").collect()}
    sums = Counter()
    for i, _, n in rows:
        sums[got[i]] += n
    assert len(sums) == 8 and max(sums.values()) < 1.1 * min(sums.values())
