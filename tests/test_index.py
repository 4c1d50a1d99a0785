"""The segmented index against BM25 over texts that are tokenised on the spot."""

import random

import pytest

from quillspark.operators import index, search

QUERIES = ["w1", "w3 OR w40 OR w2", "(w0 OR w5) AND w2", "w2 w2 OR zzz"]
OTHERS = ["w0 NOT w1*", 'title:w1 OR "w0 w1"']
SCHEMA = "id long, title string, body string, status string"


def documents(n, seed=0, first=0):
    rnd = random.Random(seed)
    word = lambda: f"w{min(int(rnd.expovariate(0.15)), 60)}"
    return [(first + i, word(), " ".join(word() for _ in range(rnd.choice([0, 3, 8, 30, 90]))) or None, rnd.choice("ab")) for i in range(n)]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 4)
    monkeypatch.setattr(index, "TASK_TERMS", 2000)


def ranks(df):
    return {r.id: round(r.rank, 9) for r in df.collect()}


def whole(docs, q):
    return ranks(search.bm25(docs, search.postings(docs, ["title", "body"]), q, ["title", "body"]))


def is_best(got, want, k):
    """Whether rows are the k best of {id: rank}; documents of equal rank may stand for one another in its last digits."""
    rows = [(r.id, round(r.rank, 9)) for r in got.collect()]
    return [r for _, r in rows] == sorted(want.values())[:k] and all(want[i] == r for i, r in rows) and len({i for i, _ in rows}) == len(rows)


def test_ranks_and_best_pages_equal_full_bm25(spark, tmp_path, small_blocks):
    docs, path = spark.createDataFrame(documents(300), SCHEMA), f"file://{tmp_path}/i"
    index.write_index(docs, path, ["title", "body"])
    kept = docs.filter("status = 'a'").select("id")
    allowed = {r.id for r in kept.collect()}
    for q in QUERIES + OTHERS:
        want = whole(docs, q)
        assert ranks(index.rank(spark, path, q)) == want, q
        assert {r.id for r in index.find(spark, path, q).collect()} == set(want), q
        assert is_best(index.top(spark, path, q, 7), want, 7), q
        assert is_best(index.top(spark, path, q, 5, allowed=kept), {k: v for k, v in want.items() if k in allowed}, 5), q


def test_few_blocks_are_read_for_a_page(spark, tmp_path, small_blocks):
    docs, path = spark.createDataFrame(documents(300), SCHEMA), f"file://{tmp_path}/i"
    index.write_index(docs, path, ["title", "body"])
    one, there = index.blocks_read(spark, path, "w1", 5)
    assert 0 < one < there / 3
    two, there = index.blocks_read(spark, path, "w1 OR w2", 5)
    assert 0 < two < there


def test_changes_in_any_order_equal_a_rebuild(spark, tmp_path, small_blocks):
    rnd = random.Random(7)
    path, fields = f"file://{tmp_path}/i", ["title", "body"]
    there = {d[0]: d for d in documents(30)}
    index.write_index(spark.createDataFrame(list(there.values()), SCHEMA), path, fields)
    first = 100
    for step in ("add", "delete", "add", "merge", "delete", "add", "again", "merge", "delete"):
        if step == "merge":
            assert index.merge(spark, path, fanout=2) > 0
            assert not index.tiers(index.segments(spark, path), 2)
        elif step == "delete":
            gone = rnd.sample(sorted(there), len(there) // 3)
            index.delete_documents(spark.createDataFrame([(i,) for i in [*gone, *gone[:1], 10**9]], "id long"), path)
            for i in gone:
                del there[i]
        else:
            new = documents(20, seed=first, first=first) if step == "add" else [d for d in documents(30) if d[0] not in there][:4]
            first += 100
            index.add_documents(spark.createDataFrame(new, SCHEMA), path, fields)
            there |= {d[0]: d for d in new}
        docs = spark.createDataFrame(list(there.values()), SCHEMA)
        assert index.statistics(index.segments(spark, path))[0] == len(there)
        for q in ("w0 OR w1", '"w0 w0"'):
            want = whole(docs, q)
            assert ranks(index.rank(spark, path, q)) == want, (step, q)
            assert is_best(index.top(spark, path, q, 3), want, 3), (step, q)
    index.delete_documents(spark.createDataFrame([(i,) for i in there], "id long"), path)
    assert index.find(spark, path, "w0").count() == 0 == index.rank(spark, path, "w0 OR w1").count() == index.top(spark, path, "w0", 3).count()
    index.rebuild(spark.createDataFrame(documents(5), SCHEMA), path, fields)
    index.vacuum(spark, path)
    assert len(index._names(spark, f"{path}/segments")) == 1 and whole(spark.createDataFrame(documents(5), SCHEMA), "w0 OR w1") == ranks(index.rank(spark, path, "w0 OR w1"))


def test_search_takes_the_index_and_reads_no_text(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"f{i}", t, None, "a" if i % 2 else "b", 0.5, float(i)) for i, _, t, _ in documents(200)], "id long, filename string, extracted_text string, structured_json string, status string, confidence_score double, created_at double")
    docs.write.parquet(f"file://{tmp_path}/d")
    docs, path = spark.read.parquet(f"file://{tmp_path}/d"), f"file://{tmp_path}/i"
    index.write_index(docs, path, ["filename", "extracted_text", "structured_json"])
    for by in ("relevance", "created_at", "filename"):
        for q in ("w1", "w0 OR w5", '"w0 w1"'):
            ask = search.Query(q, search.Filters(status="a"), sort_by=by, page=2, page_size=5)
            page, total = search.search(docs, ask, index_path=path)
            want, n = search.search(docs, ask)
            assert [(r.id, round(r.rank, 9)) for r in page.collect()] == [(r.id, round(r.rank, 9)) for r in want.collect()]
            assert total.first().total == n.first().total
            plan = page.select("id", "filename", "rank")._jdf.queryExecution().executedPlan().toString()
            assert "extracted_text" not in plan and "regexp_extract_all" not in plan


def test_nothing_half_written_is_read(spark, tmp_path):
    docs, path = spark.createDataFrame(documents(10), SCHEMA), f"file://{tmp_path}/i"
    assert not index.available(spark, path)
    index.write_index(docs, path, ["title", "body"])
    (tmp_path / "i/manifest/00000001").mkdir()  # a writer that was lost
    assert len(index.segments(spark, path)) == 1 and index.available(spark, path)
    index.add_documents(spark.createDataFrame(documents(3, first=50), SCHEMA), path, ["title", "body"])
    assert len(index.segments(spark, path)) == 2
    index.write_index(docs.limit(0), path, ["title", "body"])
    assert index.find(spark, path, "w0").count() == 0


def test_tasks_follow_the_number_of_terms(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(documents(100), SCHEMA)
    index.write_index(docs, f"file://{tmp_path}/a", ["title", "body"])
    monkeypatch.setattr(index, "TASK_TERMS", 100)
    index.write_index(docs, f"file://{tmp_path}/b", ["title", "body"])
    assert index.segments(spark, f"file://{tmp_path}/a")[0].buckets == 1
    assert index.segments(spark, f"file://{tmp_path}/b")[0].buckets > 2
