"""Overlaps of all pairs against the column expression on each pair."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import structure
from quillspark.operators import overlap


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_all_pairs_equal_the_expression(spark, block):
    rnd = random.Random(4)
    bits = ["abc ", "éß", "🙂", "xyz", "  ", "12"]
    word = lambda n: "".join(rnd.choice(bits) for _ in range(n))
    texts = [word(rnd.randrange(1, 120)) for _ in range(40)] + ["", None]
    values = [t[rnd.randrange(5) :][: rnd.randrange(200)] + rnd.choice(["", word(20)]) for t in texts[:25]] + ["a", "🙂", "no such", "", None]
    t, v = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string"), spark.createDataFrame([(f"v{i}", x) for i, x in enumerate(values)], "value_id string, value string")
    got = {(r.text_id, r.value_id): round(r.ratio, 9) for r in overlap.overlaps(v, t, block=block).collect()}
    each = t.filter("text <> ''").crossJoin(v.filter("value <> ''")).select("text_id", "value_id", structure.overlap_ratio(F.col("value"), F.col("text")).alias("ratio"))
    want = {(r.text_id, r.value_id): round(r.ratio, 9) for r in each.collect() if r.ratio}
    assert got == want and 0 < len(got) < 40 * 28
    assert overlap.overlaps(v.limit(0), t).count() == 0 == overlap.overlaps(v, t.limit(0)).count()


def test_texts_of_a_megabyte_take_seconds(spark):
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(1_000_000))
    t = spark.createDataFrame([(1, text)], "text_id long, text string")
    v = spark.createDataFrame([(1, text[1000:]), (2, text[::-1])], "value_id long, value string")
    began = time.process_time(), time.time()
    got = {r.value_id: r.ratio for r in overlap.overlaps(v, t).collect()}
    assert list(got) == [1] and got[1] > 0.99 and time.time() - began[1] < 60
