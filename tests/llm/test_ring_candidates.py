"""The near-duplicate stage's candidates by SimHash and the pigeonring."""

import random

from quillspark.llm import shingles, simhash


def test_bits_are_the_fingerprints_of_the_same_shingles(spark):
    rnd = random.Random(1)
    texts = ["", " \n", "one", "One two"] + [" ".join(rnd.choices("abcdefgh", k=rnd.randrange(1, 60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.bits % (1 << 64) for r in shingles.named(df).collect()}
    assert got == {i: simhash.fingerprint(t, 5) for i, t in enumerate(texts)}


def test_fingerprints_of_three_bits_are_candidates_without_a_shared_bucket(spark):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(30)]
    rows, pairs = [], set()
    for i, x in enumerate(base):
        n = i % 5  # bits that the second of a pair differs in; 4 are too many
        y = x
        for b in rnd.sample(range(64), n):
            y ^= 1 << b
        rows += [(i, 2 * i, signed(x), [i]), (i, 2 * i + 1, signed(y), [1000 + i])]
        if n <= 3:
            pairs.add((2 * i, 2 * i + 1))
    fps = spark.createDataFrame(rows, "doc_id long, fp long, bits long, keys array<long>")
    groups = {}
    for r in shingles.candidates(fps).collect():
        groups.setdefault(r.root, set()).add(r.node)
    assert {tuple(sorted(g)) for g in groups.values()} == pairs
