"""Substring search by trigrams against a scan, on random patterns."""

import random

from quillspark.operators import search, substrings


def test_random_patterns_equal_the_scan(spark, tmp_path):
    rnd = random.Random(6)
    texts = ["", None, "ab", "Straße ÉTÉ", "a%b_c\\d", "🙂🙂x🙂"] + ["".join(rnd.choice(["ab", "cd", "Ef", " ", "é", "🙂", "1"]) for _ in range(rnd.randrange(30))) for _ in range(150)]
    docs = spark.createDataFrame([(i, f"f{i}.TXT", t) for i, t in enumerate(texts)], "id long, filename string, extracted_text string")
    path = f"file://{tmp_path}/g"
    substrings.write_trigrams(docs, path)
    patterns = ["", "a", "txt", "F1", "traß", "été", "zzz", "%", "a%b", "b_c", "\\d", "🙂x"]
    patterns += ["".join(rnd.choice(["ab", "CD", "ef", "_", "%", "é"]) for _ in range(rnd.randrange(2, 5))) for _ in range(6)]
    for p in patterns:
        assert {r.id for r in substrings.like_search(docs, p, path).select("id").collect()} == {r.id for r in search.like_search(docs, p).select("id").collect()}, p
    few = substrings.candidates(spark, path, "f149.txt").count()
    assert 1 <= few < len(texts) / 5
    assert substrings.candidates(spark, path, "a_b") is None
    substrings.write_trigrams(docs.limit(0), path)
    assert substrings.like_search(docs, "abc", path).count() == 0
