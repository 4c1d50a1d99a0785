import random

import corpus_pipeline
import numpy as np
import pytest

from quillspark.llm import shingles


def parts(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute_groups(texts):
    """least doc_id reachable over links of similarity 0.8 or more; texts: doc_id -> text."""
    sets, seen = {i: parts(t) for i, t in sorted(texts.items())}, {}
    for root in sets:
        stack = [root] if root not in seen else []
        while stack:
            i = stack.pop()
            if i not in seen:
                seen[i] = root
                stack += [j for j in sets if j not in seen and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return seen


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " ", "One two", "one  TWO"] + [" ".join(rnd.choices(words, k=rnd.choice([6, 60, 150, 400]))) for _ in range(60)]
    hot = rnd.choices(words, k=100)
    for _ in range(240):
        w = hot[:] if rnd.random() < 0.4 else (rnd.choice(texts[5:]) or "").split()
        for _ in range(rnd.randrange(0, 1 + max(1, len(w) // 30))):
            w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return {3 * (1000 - i): t for i, t in enumerate(texts)}


@pytest.mark.parametrize(("block", "most"), [(1024, 1 << 20), (4, 1 << 20), (30, 0)])
def test_groups_by_brute_force(spark, monkeypatch, block, most):
    monkeypatch.setattr(shingles, "BROADCAST_ROWS", most)
    texts = corpus(block)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(df, block=block).collect()} == brute_groups(texts)


def test_stage_links_similar_texts_whatever_their_bits(spark):
    texts = corpus(7)
    rows = [(i, t, "x") for i, t in texts.items()] + [(None, "one two", "x"), (None, None, "x")]
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert kept.columns == ["doc_id", "text", "lang"]
    got = [r.doc_id for r in kept.collect()]
    assert got.count(None) == 2
    assert {i for i in got if i is not None} == set(brute_groups(texts).values())
    assert corpus_pipeline.near_duplicate_stage(spark, kept.limit(0), "").count() == 0


def test_buckets_of_pairs_at_the_threshold():
    rnd = np.random.default_rng(3)
    for n in (9, 90, 900):
        for _ in range(300):
            h = np.unique(rnd.integers(0, 1 << 63, n + n // 9, dtype=np.uint64) * np.uint64(2))
            x, y = h[rnd.permutation(len(h))][: len(h) - len(h) // 10], h
            assert (shingles.bands(np.sort(x)) == shingles.bands(y)).any()
