import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import simhash
from quillspark.llm.components import connected_components


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """least doc_id reachable over links of at most 3 bits; fps: doc_id -> fingerprint."""
    ids, seen = sorted(fps), {}
    for root in ids:
        stack = [root] if root not in seen else []
        while stack:
            i = stack.pop()
            if i not in seen:
                seen[i] = root
                stack += [j for j in ids if j not in seen and (fps[i] ^ fps[j]).bit_count() <= 3]
    return seen


def test_fingerprints_by_the_definition():
    rnd = random.Random(2)
    for text in ["", " \t\n", "A", "a B", "É É É É", "x y z\x1cw q"] + [" ".join(rnd.choice(["Aa", "b", "ç", "d\n"]) for _ in range(rnd.randrange(1, 60))) for _ in range(60)]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_majority_in_blocks():
    h = np.random.default_rng(1).integers(0, 1 << 63, 40_001).astype(np.uint64)
    assert simhash.majority(h) == sum(1 << i for i in range(64) if 2 * int((h >> np.uint64(i) & np.uint64(1)).sum()) > len(h))


def near(fp, bits, rnd):
    for i in rnd.sample(range(64), bits):
        fp ^= 1 << i
    return fp


def clusters(n, rnd):
    fps = [0, (1 << 64) - 1]
    while len(fps) < n:
        fps.append(near(rnd.choice(fps), rnd.randrange(0, 5), rnd) if rnd.random() < 0.7 else rnd.getrandbits(64))
    return fps


@pytest.mark.parametrize("block", [4096, 3])
def test_links_are_complete(spark, block):
    rnd = random.Random(block)
    fps = dict(enumerate(dict.fromkeys(clusters(600, rnd))))
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps.values()], "fp long")
    edges = simhash.bucket_edges(rows, block=block)
    root = {r.node: r.root for r in connected_components(edges).collect()}
    signed = {i: f - (1 << 64) if f >> 63 else f for i, f in fps.items()}
    groups = {}
    for i, f in signed.items():
        groups.setdefault(root.get(f, f), set()).add(i)
    want = {}
    for i, c in brute_components(fps).items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_by_brute_force(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " ", "one", "ONE"] + [" ".join(rnd.choices(words, k=rnd.choice([2, 9, 120, 400]))) for _ in range(60)]
    texts += [t.replace(" w1 ", " changed ", 1).upper() if t else t for t in texts[5:45]]
    df = spark.createDataFrame([(1000 - i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = {1000 - i: brute_fingerprint(t or "") for i, t in enumerate(texts)}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == brute_components(fps)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(brute_components(fps).values())


def test_empty_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (7, None)], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert rows == [(-1, 3), (3, 3), (3, 3), (7, 7)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (900, 901), (901, 900), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}


@pytest.mark.parametrize("most", [0, 1 << 21])
def test_rows_that_go_whether_broadcast_or_shuffled(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BROADCAST_IDS", most)
    rows = [(3, "a b c d", 1), (3, "a b c d", 1), (5, "A b c d", 1), (None, "a b c d", 1), (7, None, 1), (9, "", 1), (11, "other words here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int")
    assert sorted((r.doc_id or -1, r.text, r.gone) for r in simhash.keep_one(df).select("doc_id", F.coalesce("text", F.lit("-")).alias("text"), "gone").collect()) == [(-1, "a b c d", 1), (3, "a b c d", 1), (3, "a b c d", 1), (7, "-", 1), (11, "other words here", 1)]
