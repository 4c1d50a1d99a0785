import math

import numpy as np
import pytest

from quillspark.llm import ann
from quillspark.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.1"


def brute_force(rows, every=50, k=5):
    """{query: [(vec_id, score)]} by plain cosines in double precision."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        near = u @ u[q]
        order = np.lexsort((ids, -np.round(near, 12)))
        out[int(ids[q])] = [(int(ids[o]), float(near[o])) for o in order if ids[o] != ids[q]][:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_of_the_registered_query(spark):
    want = brute_force([(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()])
    got = found(QUERIES["op13_rotated_bit_codes"](spark, SF))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.99
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True) if a[0] == b[0])


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(8)
    good = [(i, rng.standard_normal(8).tolist()) for i in range(1, 120)] + [(0, base.tolist())]
    copies = [(i, (base * 2.0 ** (i % 5)).tolist()) for i in range(200, 260)]  # one direction: all tie, smaller ids first
    odd = [(300, None), (350, [0.0] * 8), (400, [math.nan] + [1.0] * 7), (450, [math.inf] + [1.0] * 7), (500, [None] + [1.0] * 7), (550, []), (None, base.tolist()), (600, [1.0, 2.0]), (650, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, b"") for i, v in good + copies + odd + copies[:3]], "vec_id long, embedding array<double>, id int, code binary").repartition(3)
    got = found(ann.neighbours_of_share(df))
    want = brute_force(good + copies)
    assert got.keys() == {*want, 600, 650}
    assert [i for i, _ in got[0]] == [200, 201, 202, 203, 204] and all(s == got[0][0][1] for _, s in got[0])
    assert [i for i, _ in got[200]] == [0, 201, 202, 203, 204]
    assert [i for i, _ in got[600]] == [650] and [i for i, _ in got[650]] == [600]
    for q in want:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)
    assert ann.neighbours_of_share(df.limit(0)).collect() == []


def test_of_rows_with_one_id_the_largest_vector_counts(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    (a, b), = found(ann.neighbours_of_share(df)).values()
    assert a[0] == 1 and a[1] > 0.99 and b[0] == 2


def test_huge_and_tiny_components(spark):
    df = spark.createDataFrame([(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1e300, 0.0])], "vec_id long, embedding array<double>")
    (a, b), = found(ann.neighbours_of_share(df)).values()
    assert a == (1, pytest.approx(1.0)) and b == (2, pytest.approx(math.sqrt(0.5)))


@pytest.mark.parametrize("dim", [3, 64, 200])
def test_estimates_keep_their_bound(dim):
    rng = np.random.default_rng(dim)
    x, q = rng.standard_normal((4000, dim)), rng.standard_normal((20, dim))
    codes, f = ann.encode(x)
    bits = ann.code_bits(dim)
    signs = (np.unpackbits(codes, axis=1).astype(np.float64) * 2 - 1) / math.sqrt(bits)
    estimate = (ann.unit(q) @ ann.rotation(dim).T @ signs.T) / f
    margin = ann.EPSILON * np.sqrt(1 - f * f) / f / math.sqrt(bits - 1)
    assert (np.abs(estimate - ann.unit(q) @ ann.unit(x).T) <= margin).mean() > 0.995


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, rng.standard_normal(16).tolist()) for i in range(1500)], "vec_id long, embedding array<double>")
    whole = found(ann.neighbours_of_share(df))
    for name, value in (("LEAST_ROWS", 8), ("MOST_ROWS", 8), ("WIDE", 5)):
        monkeypatch.setattr(ann, name, value)
    assert found(ann.neighbours_of_share(df)) == whole
