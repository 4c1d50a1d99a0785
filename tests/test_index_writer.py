"""The index writer's single shuffle of packed rows."""

from quillspark.operators import index


def test_a_token_is_no_row_of_the_shuffle(spark):
    docs = spark.createDataFrame([(i, "a b a c " * 50, "b") for i in range(300)], "id long, body string, title string")
    rows = index._packed(index._tokens(docs.coalesce(1), ["title", "body"], "id")).collect()
    assert sorted(r.term for r in rows) == ["a", "b", "c"]
    for r in rows:
        n = {"a": 100, "b": 51, "c": 50}[r.term]
        assert r.key == list(range(300)) and r.hits == [n] * 300 and r.n_terms == [201] * 300 and len(r.places) == 300 * n
        want = {"a": [(1, 4 * i + j) for i in range(50) for j in (0, 2)], "b": [(0, 0)] + [(1, 4 * i + 1) for i in range(50)], "c": [(1, 4 * i + 3) for i in range(50)]}[r.term]
        assert [(p >> 32, p % (1 << 32)) for p in r.places[:n]] == want


def test_runs_of_a_frequent_term_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 4)
    monkeypatch.setattr(index, "RUN", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    docs = spark.createDataFrame([(str(i), "w " * (i % 9 + 1) + f"x{i % 5}", "w") for i in range(60)], "id string, body string, title string")
    try:
        index.write_index(docs, f"file://{tmp_path}/i", ["title", "body"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    row = index.segments(spark, f"file://{tmp_path}/i")[0]
    blocks = index._postings(spark, f"file://{tmp_path}/i", row).filter("term = 'w'").collect()
    assert {k: (h, n) for b in blocks for k, h, n in zip(b.key, b.hits, b.n_terms, strict=True)} == {str(i): (i % 9 + 2, i % 9 + 3) for i in range(60)}
    for b in blocks:
        assert b.n == len(b.key) <= 4 and b.most_hits == b.hits[0] == max(b.hits) and b.least_terms == min(b.n_terms) and list(map(len, b.places)) == b.hits
    assert index.find(spark, f"file://{tmp_path}/i", '"w x3"').count() == 12 and index.find(spark, f"file://{tmp_path}/i", "title:w").count() == 60
