"""Neighbour votes against plain Python: naive term counts, naive cosines in full precision, ties by doc_id."""

import math
import random
import zlib

import numpy as np
import pytest

from quillspark.llm import quality

SF = "/root/testdata/sf0.01"


def naive_counts(text):
    """bigrams of byte classes, and the number of words like the one before (as multisets of bytes) by their share."""
    marks = b" \n\t.,;:!?'\"()[]{}<>|/\\-_*#$%&+=@"

    def cls(b):
        if 97 <= b <= 122:
            return 2 + b - 97
        if 65 <= b <= 90:
            return 28
        if 48 <= b <= 57:
            return 29
        if b in marks:
            return 30 + marks.index(b)
        return 62 if 128 <= b < 192 else 63 if b >= 192 else 1

    raw = text.encode()
    out = [0.0] * quality.TERMS
    if len(raw) < 2:
        return out
    for x, y in zip(raw, raw[1:], strict=False):
        out[cls(x) * 64 + cls(y)] += 1
    ws = [sorted(w) for w in raw.replace(b"\n", b" ").replace(b"\t", b" ").replace(b"\r", b" ").split(b" ") if w]
    again = sum(a == b for a, b in zip(ws, ws[1:], strict=False))
    for r in range(quality.REPEATS):
        if ws and again / len(ws) > r / quality.REPEATS:
            out[quality.BIGRAMS + r] = float(again)
    return out


def unit(v):
    n = math.sqrt(math.fsum(x * x for x in v))
    return [x / n for x in v] if n else v


def naive_score(model, counts):
    tf = unit([math.log1p(c) * float(i) for c, i in zip(counts, model.idf, strict=True)])
    v = np.array(unit((np.array(tf) @ model.axes.astype(float)).tolist()))
    near = [max(-1.0, min(1.0, float(v @ w.astype(float)))) for w in model.vectors]
    order = sorted(range(len(near)), key=lambda i: (-near[i], i))[: model.neighbours]
    weights = [max(near[i], 0.0) ** model.sharpness for i in order]
    total = sum(weights)
    return sum(w * y for w, y in zip(weights, model.labels[order], strict=True)) / total if total else float(model.labels.mean())


def test_every_mark_has_its_own_class():
    own = [b for b in range(128) if quality._CLASS[b] >= 30]
    assert len(own) == 32 == len({quality._CLASS[b] for b in own}) and max(quality._CLASS) == 63


def test_counts_by_brute_force():
    rnd = random.Random(3)
    texts = ["", "a", "no no no no", "a\nb a\tb ~^ ~^", "É é É", "x" * 200_000] + ["".join(rnd.choice("aB1 é~^.\n\t|z") for _ in range(rnd.randrange(0, 400))) for _ in range(80)]
    for got, t in zip(quality.term_counts(texts), texts, strict=True):
        assert got.tolist() == naive_counts(t), t[:40]


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, quality.fit(docs, labels)


def test_scores_by_naive_cosines(fitted):
    docs, _, model = fitted
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    far = [i for i, t in texts.items() if abs(got[i] - naive_score(model, naive_counts(t))) > 2e-3]
    # Single precision may change who is the last of the neighbours where similarities differ by less than 1e-6.
    assert len(far) <= len(texts) // 200
    assert all((naive_score(model, naive_counts(texts[i])) >= quality.THRESHOLD) == (got[i] >= quality.THRESHOLD) for i in texts if i not in far)


def test_scores_do_not_depend_on_the_rows_beside(fitted):
    docs, _, model = fitted
    counts = quality.term_counts([r.text for r in docs.limit(150).collect()])
    whole = model.scores(counts)
    assert np.array_equal(whole, np.concatenate([model.scores(counts[i : i + 7]) for i in range(0, 150, 7)]))
    assert np.array_equal(whole, model.scores(counts[::-1])[::-1])


def test_ties_are_for_the_smaller_id():
    same = np.ones((6, 1), np.float32)
    model = quality.Model(np.ones(quality.TERMS, np.float32), np.ones((quality.TERMS, 1), np.float32), same, np.array([1, 1, 0, 0, 0, 0.0]), neighbours=3)
    assert model.scores(quality.term_counts(["word"])).tolist() == [2 / 3]


def test_long_labelled_texts_have_one_vector(spark):
    """A labelled text is its own nearest neighbour, however long it is."""
    rows = [(i, "le chat dort " * (i + 1)) for i in range(1, 40)] + [(100, "a" * 200_000), (101, "b|" * 150_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 50)) for i, _ in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    ids = sorted(i for i, _ in rows if zlib.crc32(str(i).encode()) % 5)
    near = model.project(quality.term_counts([dict(rows)[i] for i in ids]))
    assert np.allclose((near * model.vectors).sum(1), 1, atol=1e-5)


def test_held_out_quality_and_odd_texts(spark, fitted):
    docs, labels, model = fitted
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    pairs = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(pairs) > 50 and sum(a == b for a, b in pairs) >= 0.95 * len(pairs)
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "a" * 100_000, "y")], "doc_id long, text string, score string")
    assert quality.score(odd, model).count() == 3 and quality.score(odd.limit(0), model).count() == 0
    assert quality.keep_good(odd, model).columns == odd.columns
    unlabelled = quality.fit(odd, labels.limit(0))
    assert [r.score for r in quality.score(odd, unlabelled).collect()] == [0.5] * 3


def test_labels_without_a_document_take_no_place_in_the_sample(spark):
    df = spark.createDataFrame([(500 * i, f"text {i}") for i in range(40)] + [(None, "x")], "doc_id long, text string")
    labels = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    labels = labels.unionAll(labels.selectExpr("doc_id", "1 as quality"))
    sample = quality.labelled_sample(df, labels, "quality", 15).collect()
    assert len(sample) >= 15 and {r.id for r in sample} <= {500 * i for i in range(40)}
    assert len(quality.labelled_sample(df, labels, "quality", 1500).collect()) == 40
