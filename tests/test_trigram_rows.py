"""Stored trigrams: a row holds many documents."""

from quillspark.operators import substrings


def test_a_gram_is_a_row_for_many_documents(spark):
    docs = spark.createDataFrame([(i, "AbCd", "abc" if i % 2 else None) for i in range(500)], "id long, filename string, extracted_text string")
    rows = substrings._packed(docs.coalesce(1), ("filename", "extracted_text"), "id").collect()
    code = lambda s: int(substrings.trigrams(s)[0])
    assert {r.gram: sorted(r.key) for r in rows} == {code("abc"): list(range(500)), code("bcd"): list(range(500))} and len(rows) == 2
