import hashlib

import pytest

from quillspark.llm import fim

SF = "/root/testdata/sf0.001"


def expected(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    p, m, s = text[:low], text[low:high], text[high:]
    out, form = (f"<S>{s}<P>{p}<M>{m}", "spm") if h[3] % 100 < 20 else (f"<P>{p}<S>{s}<M>{m}", "psm")
    return (doc_id, n, form, low, high - low, sha(out), sha(text))


def test_whole_result_and_round_trip(spark):
    pieces = ["<", "<P", "P>", ">", "S>", "<<S", "é", "🙂", "́", "\n", "x", "\x00"]
    data = [(i, "".join(pieces[(i * 7 + j * j) % len(pieces)] for j in range(i % 23))) for i in range(400)]
    data += [(500, None), (501, ""), (502, "a<P>b"), (503, "a<M>"), (None, "no id"), (504, "x"), (504, "x"), (505, "long 🙂" * 300_000)]
    df = spark.createDataFrame([(*d, "clash") for d in data], "doc_id long, text string, output string")
    got = sorted((tuple(r) for r in fim.transformation_report(df).collect()), key=repr)
    assert got == sorted((expected(*d) for d in data), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fim.transformation_report(df.limit(0)).count() == 0


def test_units_of_words(spark):
    text = "two words, été 42!"
    places = fim.boundaries(fim.codepoints(text), "word").tolist()
    assert [text[a:b] for a, b in zip(places, places[1:], strict=False)] == ["two", " ", "words", ",", " ", "été", " ", "42", "!"]
    df = spark.createDataFrame([(i, text * 3) for i in range(200)], "doc_id long, text string")
    rows = fim.fill_in_middle(df, unit="word").collect()
    assert {r.n for r in rows} == {27}
    cuts = set(fim.boundaries(fim.codepoints(text * 3), "word").tolist())
    assert all(r.prefix_chars in cuts and r.prefix_chars + r.middle_chars in cuts for r in rows if r.form != "plain")
    assert {r.t for r in fim.fill_in_middle(df, unit="word").select(fim.restored(spark_col("output"), spark_col("form")).alias("t")).collect()} == {text * 3}
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, unit="line")


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_no_shuffle(spark):
    from quillspark.llm.queries import QUERIES

    assert "Exchange" not in QUERIES["op12_fill_in_middle"](spark, SF)._jdf.queryExecution().executedPlan().toString()
