"""Queries take in every row of their tables."""

import json

from quillspark.plans import catalogue


def run(spark, name, tables):
    read = {f"x/{t}.parquet": spark.createDataFrame(*rows) for t, rows in tables.items()}

    class Session:
        class read:
            parquet = staticmethod(read.__getitem__)

    return catalogue.QUERIES[name](Session, "x").collect()


def test_every_answer_is_parsed(spark):
    docs = [(i, f"src{i}", "en") for i in range(6)]
    got = run(spark, "json_repair_parse", {"documents": (docs, "doc_id long, source string, lang string")})
    # A comma stays before the brace that closes a truncated answer: the last repair comes after that of commas.
    want = {i: None if i % 2 else {"gone": None, "lang": "en", "n": [1, 2], "name": s, "ok": True} for i, s, _ in docs}
    assert len(got) == 6 and {r.doc_id: r.parsed and json.loads(r.parsed) for r in got} == want


def test_every_document_and_item_is_compared(spark):
    for items in ([5, 7, 9], list(range(90))):
        bench = [(i, f"{i} benchmark items are texts of their own") for i in items]
        docs = [(i, f"{bench[i % len(items)][1]} and more words follow here until it is long enough " * 2) for i in range(100)]
        tables = {"documents": (docs, "doc_id long, text string"), "benchmark": (bench, "item_id long, text string")}
        got = run(spark, "overlap_ratio", tables)
        assert sorted((r.doc_id, r.item_id) for r in got) == [(i, items[i % len(items)]) for i in range(100)]
        assert all(r.ratio > 0.9 for r in got)
        assert sorted(r.doc_id for r in run(spark, "text_dump_flag", tables)) == list(range(100))
