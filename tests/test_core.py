import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import chunk, structure, text
from quillspark.operators import operations, recovery, search, store
from quillspark.sources import files, sinks
from quillspark.streaming import rolling


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def T(f, value):
    return lambda spark: one(spark, f(F.col("t")), t=value)


def test_cleaning(spark):
    for f, value, want in [
        (text.strip_tags, "<p>Hello</p>", "Hello"),
        (text.collapse_whitespace, "a\n\n\n\nb", "a\n\nb"),
        (text.collapse_whitespace, "  a \t b \n", "a b"),
        (text.remove_control, "Hello\x00World", "HelloWorld"),
        (text.strip_punctuation, "hé, wörld!", "hé wörld"),
        (lambda c: text.normalize_unicode(c, "NFKC"), "②", "2"),
        (text.correct_ocr, "ﬁle 0pen | am burn", "file 0pen I am burn"),
        (text.ocr_swaps, "| am", "I am"),
        (text.extension, "/a.b/.hidden", ""),
        (text.extension, "/a.b/x.tar.GZ", ".gz"),
        (text.size_label, 1536, "1.5 KB"),
        (text.size_label_all_units, 1536, "1.5 KB"),
        (text.type_label, "tax_form", "Tax Form"),
        (text.percent_label, 0.5, "50%"),
    ]:
        assert T(f, value)(spark) == want, value


def brute_pack(pieces, size, sep):
    done, cur, used = [], [], 0
    for p in pieces:
        n = len(p) + (len(sep) if cur else 0)
        if used + n > size and cur:
            done, cur, used = [*done, sep.join(cur)], [], 0
        cur, used = [*cur, p], used + n
    return done + ([sep.join(cur)] if cur else [])


def test_chunks(spark):
    c = F.col("t")
    fixed = T(lambda c: chunk.chunks(c, 30, 5, "fixed"), "a" * 100)(spark)
    assert len(fixed) == 4
    abc = T(lambda c: chunk.chunks(c, 10, 3, "fixed"), "abcdefghijklmnopqrstuvwxyz")(spark)
    assert all(x[-3:] == y[:3] for x, y in zip(abc, abc[1:], strict=False)) and abc[-1].endswith("z")
    sentences = [f"Sentence {i} " + "w" * (i * 7 % 60) + "." for i in range(40)]
    assert T(lambda c: chunk.chunks(c, 120, 0), " ".join(sentences))(spark) == brute_pack(sentences, 120, "\n\n")
    assert T(lambda c: chunk.chunks(c, method="paragraph"), "  \n ")(spark) == ["  \n "]
    assert T(lambda c: chunk.chunks(c), "  ")(spark) == [] == T(lambda c: chunk.chunks(c), "")(spark)
    for args in ({"overlap": -1}, {"size": 64, "overlap": 64}, {"method": "odd"}):
        with pytest.raises(ValueError):
            chunk.chunks(c, **args)


def test_features(spark):
    f = T(text.features, "Hi. There! a bb ccc")(spark)
    assert (f.word_count, f.sentence_count, f.max_word_length) == (5, 2, 5)
    assert T(text.features, "a bb ccc")(spark).avg_word_length == 2.0
    assert T(text.features, " ".join(["w"] * 238))(spark).reading_time_seconds == 60.0
    assert set(T(text.features, "")(spark)) == {0}


def test_json_repair(spark):
    for raw, want in [
        ('{"a": 1}', {"a": 1}),
        ("{a: 1}", {"a": 1}),
        ("{'a': 'b'}", {"a": "b"}),
        ('{"a": [1,],}', {"a": [1]}),
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ('{"a": None, "b": True}', {"a": None, "b": True}),
        ('{"a": {"b": 1', {"a": {"b": 1}}),
        ('so: {"a": {"b": 2}} and {"c": 3}', {"a": {"b": 2}}),
        ("plain prose", None),
        ("", None),
    ]:
        got = T(structure.parse_json, raw)(spark)
        assert (json.loads(got) if got else None) == want, raw
    assert T(structure.repairs_needed, "{'a': 1,}")(spark) == ["single_quotes", "trailing_commas"]
    assert T(structure.response_format, 'x {"a": 1} y')(spark) == ["text_before", "text_after"]


def test_confidence_and_metadata(spark):
    tiers = {0: 0.0, 1: 0.3, 2: 0.55, 3: 0.75, 5: 0.9}
    for n, want in tiers.items():
        m = F.from_json(F.lit(json.dumps({f"k{i}": 0 for i in range(n)})), "map<string,string>")
        assert one(spark, structure.confidence_tier(m)) == want
    assert one(spark, structure.confidence_tier(F.from_json(F.lit('{"a": "", "b": []}'), "map<string,string>"))) == 0.15
    assert len(set(structure.COPY_FIELDS)) == 25
    m = F.create_map(*[F.lit(x) for x in (" B ", " v ", "path", "", "b", "second", "gone", "")])
    assert one(spark, structure.clean_metadata(m)) == {"B": "v", "path": ""}


def library(spark):
    rows = [
        ("d1", "quarterly_report.pdf", 10, "application/pdf", "processed", 1000.0, 0.95, "Revenue grew 20 % in Budget"),
        ("d2", "meeting_notes.txt", 20, "text/plain", "processed", 2000.0, 0.88, "notes on project Alpha timeline"),
        ("d3", "invoice_2024.pdf", 30, "application/pdf", "processed", 1500.0, 0.75, "Invoice total due"),
        ("d4", "image_scan.png", 40, "image/png", "uploaded", 500.0, 0.0, ""),
        ("d5", "project_alpha_spec.pdf", 50, "application/pdf", "failed", 3000.0, 0.45, "Alpha project specification"),
    ]
    return spark.createDataFrame(rows, "id string, filename string, file_size long, mime_type string, status string, created_at double, confidence_score double, extracted_text string")


def ids(frame):
    return [r.id for r in frame.collect()]


def test_search(spark):
    docs, Q, Fl = library(spark), search.Query, search.Filters
    chunks = spark.createDataFrame([("d1", 3)], "id string, chunks_count long")

    def run(**kw):
        page, total = search.search(docs, Q(**kw), chunks)
        return ids(page), total.first().total

    assert run(keyword="Revenue") == (["d1"], 1)
    assert run(keyword="Alpha") == (["d5", "d2"], 2)
    assert run(keyword="revenue grew") == (["d1"], 1)
    assert run(keyword="  ")[1] == 5
    assert run(keyword='"project alpha"') == (["d5", "d2"], 2)
    assert run(keyword="alpha NOT timeline") == (["d5"], 1)
    assert run(keyword="inv*") == (["d3"], 1)
    assert run(keyword="report.pdf") == (["d1"], 1)  # outside the grammar: substring search
    assert run(filters=Fl(filename="quarterly")) == (["d1"], 1)
    assert sorted(run(filters=Fl(created_from=1000.0, created_to=2000.0))[0]) == ["d1", "d2", "d3"]
    assert run(filters=Fl(confidence_min=0.8))[1] == 2 == run(filters=Fl(confidence_max=0.7))[1]
    assert run(filters=Fl(has_text=True))[1] == 4 and run(filters=Fl(has_text=False)) == (["d4"], 1)
    assert run(keyword="Alpha", filters=Fl(status="processed", confidence_min=0.8)) == (["d2"], 1)
    assert run(page=3, page_size=2) == (["d4"], 5) and run(page=100, page_size=2) == ([], 5)
    assert search.page_count(5, 2) == 3 and search.page_count(0, 2) == 1
    with pytest.raises(ValueError):
        search.sort_page(docs, size=0)
    shown = docs.filter("id = 'd1'").select(search.snippet(F.col("extracted_text"), ["grew"]).alias("s")).first().s
    assert shown == "Revenue <b>grew</b> 20 % in Budget"


def test_store(spark):
    docs = library(spark)
    assert store.status_counts(docs.replace("processed", "stored", ["status"])).first() == (5, 3, 1, 1)
    up = store.upsert(docs.select("id", "created_at"), spark.createDataFrame([("d1", 1000.0), ("d2", 1.0), ("d9", 5.0)], "id string, created_at double"), ["id"], "created_at")
    assert {r.id: r.created_at for r in up.collect()} == {"d1": 1000.0, "d2": 2000.0, "d3": 1500.0, "d4": 500.0, "d5": 3000.0, "d9": 5.0}
    chunks = spark.createDataFrame([("d1",), ("zz",)], "document_id string")
    assert [r.document_id for r in store.orphans(chunks, docs).collect()] == ["zz"]


def test_lru_in_one_and_in_many_ranges(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else float(i * 37 % 50), i % 3 + 1) for i in range(80)], "id int, at double, size long")
    order = [F.col("at"), F.col("id")]
    plain = operations.evict_lru(rows, "size", F.lit(60), *order, ranges=1)
    cut = operations.evict_lru(rows, "size", F.lit(60), *order, ranges=9)
    assert sorted(ids(plain)) == sorted(ids(cut)) and 0 < plain.count() < 80


def test_page_and_transcript(spark):
    words = F.from_json(F.lit('[{"text":"a","conf":90},{"text":" ","conf":50},{"text":"b","conf":-1},{"text":"c","conf":70}]'), "array<struct<text:string,conf:double>>")
    assert one(spark, operations.ocr_page(words)) == ("a c", 0.8)
    assert one(spark, operations.transcript_confidence(F.lit(None).cast("double"), F.lit(0.4))) == 0.4


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.TXT").write_bytes("hé".encode() + b"\xff")
    (tmp_path / "in/b.pdf").write_bytes(b"%PDF")
    assert any(r.text == "hé�" for r in files.read_texts(spark, f"{tmp_path}/in").collect())
    info = {r.extension: r.category for r in files.file_info(spark, f"{tmp_path}/in").collect()}
    assert info == {".txt": "text", ".pdf": "pdf"}
    got = files.extract(spark.read.format("binaryFile").load(f"{tmp_path}/in"), {"text": lambda b: (b.decode("latin-1"), 1.0)}).collect()
    assert sorted((r.category, r.error) for r in got) == [("pdf", "no extractor for pdf"), ("text", None)]
    docs = library(spark).withColumns({"structured_json": F.lit('{"document_type": "memo"}'), "error_message": F.lit(None).cast("string")})
    assert sinks.export(docs, "json", f"{tmp_path}/x.json")["count"] == 5
    assert len(json.loads((tmp_path / "x.json").read_text())) == 5
    assert sinks.export(docs.limit(0), "csv", f"{tmp_path}/x.csv")["bytes"] == 0
    with pytest.raises(ValueError):
        sinks.export(docs, "zip", f"{tmp_path}/x")
    assert sinks.zip_file(docs, f"{tmp_path}/x.zip", [f"{tmp_path}/in/b.pdf", "/none"]) == ["documents.json", "metadata.json", "documents.csv", "report.txt", "originals/b.pdf"]
    assert b"memo" in zipfile.ZipFile(f"{tmp_path}/x.zip").read("report.txt")
    sinks.write_json_lines(sinks.metadata_only(docs), f"file://{tmp_path}/log")
    assert recovery.read_log(spark, f"file://{tmp_path}/log", "id string, status string, timestamp double").count() == 5
    assert [r.error for r in files.infer(spark.createDataFrame([(1, "t")], "doc_id long, text string"), None).collect()] == ["no model available"]


def test_streaming_means_keep_the_newest(spark, tmp_path):
    data = spark.createDataFrame([("a", float(i), float(i)) for i in range(10)] + [("b", 1.0, 4.0)], "operation string, timestamp double, duration_ms double")
    data.write.parquet(f"file://{tmp_path}/ev")
    stream = spark.readStream.schema(data.schema).parquet(f"file://{tmp_path}/ev")
    q = rolling.rolling_means(stream, n=3).writeStream.format("memory").queryName("means").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.operation, r.avg_ms, r.n) for r in spark.table("means").collect()} == {("a", 8.0, 3), ("b", 4.0, 1)}
