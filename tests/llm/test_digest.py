import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import common, digest


def entropy(w):
    return -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())


def prose(n, seed):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def test_entropies_by_the_definition():
    for text in (prose(60, 1).encode(), bytes(300), "éß🙂".encode() * 30, bytes(np.random.default_rng(1).integers(0, 256, 500, np.uint8))):
        got = digest.entropies(np.frombuffer(text, np.uint8))
        want = [entropy(text[i : i + digest.WINDOW]) * 32 for i in range(len(text) - digest.WINDOW + 1)]
        assert len(got) == len(want) and np.abs(got - want).max() <= 0.51


def test_selection_by_brute_force():
    raw = prose(120, 2).encode()
    h = digest.entropies(np.frombuffer(raw, np.uint8))
    rank = [1000 - abs(int(x) - digest.USUAL) if x >= digest.LEAST else 30000 for x in h]
    r = digest.REACH
    chosen = [i for i in range(len(rank)) if h[i] >= digest.LEAST and all(x > rank[i] for x in rank[max(0, i - r) : i]) and all(x >= rank[i] for x in rank[i + 1 : i + 1 + r])]
    assert len(chosen) > 5 and len(digest.select([raw])[0]) == len(chosen)


def test_batches_do_not_matter():
    texts = [prose(n, n) for n in (0, 1, 5, 40, 300)] + ["", "a" * 500, "é"]
    together = [digest.text_form(d) for d in digest.digests(texts * 3)]
    alone = [digest.text_form(digest.digests([t])[0]) for t in texts]
    assert together == alone * 3
    for form in alone:
        assert digest.text_form(digest.from_text(form)) == form


def test_likeness_follows_shared_text():
    a, b = prose(900, 3), prose(900, 4)
    mixed = [a, b, a + b, a[: len(a) // 2] + b[: len(a) // 2], b[7:]]
    da, db, dab, half, shifted = digest.digests(mixed)
    assert digest.likeness(da, da) == 1 and digest.likeness(da, db) < 0.1
    assert digest.likeness(da, dab) > 0.8 and 0.35 < digest.likeness(da, half) < 0.65
    assert digest.likeness(db, shifted) > 0.9 and digest.likeness(dab, da) == digest.likeness(da, dab)
    none, same, other = digest.digests(["", "short", "other"])
    assert digest.likeness(none, none) == 1 and digest.likeness(none, same) == 0 == digest.likeness(same, other)


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 900])
def test_report_by_brute_force(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(common.ordered_buckets, "__defaults__", (bucket_bytes,))
    texts = {i * 3: prose(random.Random(i).randrange(0, 60), i) for i in range(60)} | {500: None, 501: "", 502: "é🙂x"}
    df = spark.createDataFrame([(i, t, "b") for i, t in texts.items()], "doc_id long, text string, b string")
    got = {r.doc_id: r for r in digest.neighbour_report(df).collect()}
    assert set(got) == set(texts)
    order = sorted(texts, reverse=True)
    for i, j in zip(order, [*order[1:], order[0]], strict=True):
        t, u = texts[i] or "", texts[j] or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        dt, du, de = digest.digests([t, u, e])
        want = (len(t), hashlib.sha256(e.encode()).hexdigest(), digest.text_form(dt), digest.text_form(de), digest.likeness(dt, de), digest.likeness(dt, du))
        assert tuple(got[i])[1:] == want


def test_ties_single_rows_and_empty_tables(spark):
    schema = "doc_id long, text string"
    assert digest.neighbour_report(spark.createDataFrame([], schema)).count() == 0
    one = digest.neighbour_report(spark.createDataFrame([(4, "alone")], schema)).collect()
    assert [(r.doc_id, r.near_edited, r.near_next) for r in one] == [(4, 0.0, 1.0)]
    many = digest.neighbour_report(spark.createDataFrame([(4, "a"), (4, "a"), (4, "b"), (None, None), (None, "x")], schema)).collect()
    assert len(many) == 5
    assert digest.fingerprint(spark.createDataFrame([(4, "a"), (4, None)], schema)).count() == 2
