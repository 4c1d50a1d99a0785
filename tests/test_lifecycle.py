"""Operators of the record lifecycle that no query covers whole: files, folders, retries, streams, models."""

import datetime
import json
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import structure, text
from quillspark.operators import cache, extraction, index, ingest, monitor, operations, preprocess, recovery, search, store
from quillspark.sources import backup, files, media, models, sinks
from quillspark.streaming import rolling


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# --- search index -----------------------------------------------------------------------------------------------------


def corpus(spark):
    rows = [(1, "Red_fox.txt", "The quick red fox"), (2, "b", "a lazy dog, the dog"), (3, "c", "Café and fox-trot"), (4, "d", None), (5, "dog", "")]
    return spark.createDataFrame(rows, "id long, filename string, extracted_text string")


def test_stored_index_equals_the_plan_over_texts(spark, tmp_path):
    docs, path, fields = corpus(spark), f"file://{tmp_path}/ix", ["filename", "extracted_text"]
    assert not index.available(spark, path)
    index.write_index(docs, path, fields)
    assert index.available(spark, path)
    for q in ["fox", "dog the", "fox OR dog", "the NOT dog", '"lazy dog"', "d*", "filename:dog", "(fox OR cafe) AND and", "nothing", "do* OR caf*"]:
        whole = {r.id: round(r.rank, 9) for r in search.bm25(docs, search.postings(docs, fields), q, fields).collect()}
        assert {r.id: round(r.rank, 9) for r in index.rank(spark, path, q).collect()} == whole, q
        assert {r.id for r in index.find(spark, path, q).collect()} == set(whole) and index.count(spark, path, q).first().matches == len(whole)
    assert index.find(spark, path, "  ").count() == 0 == index.rank(spark, path, "").count()
    index.delete_documents(docs.filter("id = 2"), path)
    assert {r.id for r in index.find(spark, path, "dog").collect()} == {5}
    index.add_documents(spark.createDataFrame([(9, "new", "dog")], docs.schema), path, fields)
    assert {r.id for r in index.find(spark, path, "dog").collect()} == {5, 9}
    index.rebuild(docs, path, fields)
    assert {r.id for r in index.find(spark, path, "dog").collect()} == {2, 5}


def test_index_reads_the_folders_of_its_terms(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    index.write_index(corpus(spark), path, ["extracted_text"])
    plan = index.postings_of(spark, path, search.parse("fox"))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "EqualTo(term,fox)" in plan
    assert "regexp_extract_all" not in plan


def test_rank_reads_postings_once_a_phrase(spark):
    docs = corpus(spark)
    tree = search.parse("fox OR (dog the)")
    assert search.needed(tree, [F.lit(True)] * 3) is not None and search.needed(search.parse("fox NOT dog"), [F.lit(True)]) is None
    got = {r.id for r in search.bm25(docs, search.postings(docs, ["extracted_text"]), "fox OR (dog the)", ["extracted_text"]).collect()}
    assert got == {1, 2, 3}


def test_snippets(spark):
    filler = " ".join(f"w{i}" for i in range(100))
    show = lambda text, words, width=8: one(spark, search.snippet(F.lit(text), words, width))
    assert show("the quick fox", ["fox"]) == "the quick <b>fox</b>" and show("none here", ["fox"]) == "none here"
    got = show(f"fox {filler} fox dog {filler} fox fox fox", ["fox", "dog"])
    assert got.startswith("...") and got.endswith("...") and "<b>fox</b> <b>dog</b>" in got and len(got.replace("...", "").split()) == 8
    assert show(f"{filler} Foxes Fox!", ["fox"]).endswith("Foxes <b>Fox!</b>")
    assert show(f"fox {filler}", ["fox"]).startswith("<b>fox</b> w0") and show("", ["fox"]) == ""


# --- store ------------------------------------------------------------------------------------------------------------


def test_store_edits(spark, tmp_path):
    t = spark.createDataFrame([("a", 1.0, "stored"), ("b", 2.0, "stored")], "id string, updated_at double, status string")
    assert store.lookup(t, "id", "zz").count() == 0 and store.lookup(t, "id", "b").first().updated_at == 2.0
    after, row = store.updated(t, "id", "b", 9.0, status="failed", unknown=1)
    assert row.first() == ("b", 9.0, "failed") and after.filter("id = 'a'").first() == ("a", 1.0, "stored")
    assert store.updated(t, "id", "zz", 9.0, status="failed")[1].count() == 0
    with pytest.raises(ValueError, match="not unique"):
        store.insert(t, t.limit(1), ["id"])
    kept, gone = store.delete(t)
    assert kept.count() == 0 and gone.first().deleted == 2
    odd = store.record(spark.createDataFrame([(None, None, "weird")], t.schema)).first()
    assert odd == ("", 0.0, "failed")
    paths = [f"file://{tmp_path}/{n}" for n in "xy"]
    for p in paths:
        t.write.parquet(p)
    store.transaction(spark, {paths[0]: spark.read.parquet(paths[0]).filter("id = 'a'"), paths[1]: t.limit(0)})
    assert [spark.read.parquet(p).count() for p in paths] == [1, 0]
    bad = t.select(F.raise_error(F.lit("boom")).cast("string").alias("id"))
    with pytest.raises(Exception, match="boom"):
        store.transaction(spark, {paths[0]: t, paths[1]: bad})
    assert [spark.read.parquet(p).count() for p in paths] == [1, 0]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x", "y"]


def test_backups(spark, tmp_path):
    table, folder = f"file://{tmp_path}/t", f"file://{tmp_path}/b"
    assert backup.listed(spark, folder) == []
    spark.range(5).write.parquet(table)
    made = [backup.create(spark, table, folder, 3, datetime.datetime(2024, 1, d)) for d in (1, 2, 3, 4)]
    found = backup.listed(spark, folder)
    assert [b["created"][:8] for b in found] == ["20240104", "20240103", "20240102"] and all(b["size_bytes"] > 0 for b in found)
    assert backup.verify(spark, made[3]) and not backup.verify(spark, made[0])
    backup.replace(spark, spark.read.parquet(table).filter("id > 2"), table)
    assert spark.read.parquet(table).count() == 2
    assert backup.restore(spark, made[3], table) and spark.read.parquet(table).count() == 5
    spark.range(9).write.mode("append").parquet(made[2])  # damaged
    assert not backup.verify(spark, made[2]) and not backup.restore(spark, made[2], table) and spark.read.parquet(table).count() == 5
    assert backup.prune(spark, folder, 1) == 2 and len(backup.listed(spark, folder)) == 1


# --- ingest -----------------------------------------------------------------------------------------------------------


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in [("a.txt", b"one"), ("b.txt", b"one"), ("c.TXT", b"two"), ("d.exe", b"x"), ("noext", b"x"), ("e.txt", b"known")]:
        (tmp_path / "in" / name).write_bytes(body)
    arrived = ingest.arrivals(spark, f"file://{tmp_path}/in")
    known = arrived.filter("filename = 'e.txt'").select(F.lit("doc_old").alias("id"), "filename", F.sha2("content", 256).alias("file_hash"))
    got = {r.filename: r for r in ingest.ingest(arrived, known).collect()}
    assert {n: (r.success, r.error) for n, r in got.items() if not r.success} == {"d.exe": (False, "extension not allowed"), "noext": (False, "no extension")}
    assert got["e.txt"].duplicate_of == "doc_old" and got["b.txt"].duplicate_of == got["a.txt"].doc_id and got["c.TXT"].doc_id
    assert re.fullmatch(r"text/\d{4}-\d\d-\d\d/[0-9a-f]{12}_a\.txt", got["a.txt"].stored_path)
    assert ingest.ingest(arrived, known, check_duplicates=False).filter("doc_id is not null").count() == 4
    results = ingest.ingest(arrived, known)
    ingest.write_files(arrived, results, f"file://{tmp_path}/up")
    assert {bytes(r.content) for r in spark.read.parquet(f"file://{tmp_path}/up").collect()} == {b"one", b"two"}
    assert sorted(r.filename for r in ingest.registered(results, 1.0).collect()) == ["a.txt", "c.TXT"]
    watched = files.watch(spark, f"file://{tmp_path}/in").select("path", "length")
    q = watched.writeStream.format("memory").queryName("seen").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 6


def test_hot_contents_are_told_alike(spark, monkeypatch):
    rows = [(f"f{i}.txt", 5, f"h{0 if i < 40 else i % 7}") for i in range(90)] + [("x.exe", 5, "h0"), ("null.txt", 5, None)]
    batch = spark.createDataFrame(rows, "filename string, file_size long, file_hash string")
    known = spark.createDataFrame([("doc_a", "old.txt", "h3")], "id string, filename string, file_hash string")
    plain = sorted(map(repr, ingest.ingest(batch, known).collect()))
    monkeypatch.setattr(store, "HOT_ROWS", 20)
    assert sorted(map(repr, ingest.ingest(batch, known).collect())) == plain
    plan = ingest.ingest(batch, known)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_document_ids(spark):
    assert re.fullmatch(r"doc_\d{13}_[0-9a-f]{8}", one(spark, text.document_id()))


# --- caches -----------------------------------------------------------------------------------------------------------


def test_cache_life(spark):
    values = spark.createDataFrame([("json", '{"b":1,"a":2}', None), ("ocr", '{"t": "x"}', "own")], "entry_type string, value string, key string")
    held = cache.entries(values, 100.0, 10.0, key="key")
    rows = {r.entry_type: r for r in held.collect()}
    assert rows["json"].value == '{"a": 2, "b": 1}' and rows["ocr"].cache_key == "own" and rows["json"].expires_at == 110.0 and rows["json"].size_bytes == 16
    now_gone = cache.clear_expired(held, 110.0)
    assert now_gone[0].count() == 2 and cache.clear_expired(held, 110.5)[1].first().deleted == 2
    assert cache.clear(held, "ocr")[0].count() == 1 and cache.clear(held)[1].first().deleted == 2
    assert cache.delete(held, held.filter("entry_type = 'ocr'"))[1].first().deleted == 1
    empty = cache.snapshot(held.limit(0), 1.0).first()
    assert (empty.entries, empty.bytes, empty.is_full, empty.hits, empty.hit_ratio) == (0, 0, False, 0, 0.0)
    assert cache.cleanup(held, 100.0, 0.00001).count() == 1  # 10 bytes: the smaller entry fits
    assert cache.cleanup(held, 100.0, 0.000005).count() == 0


# --- preprocessing and extraction ---------------------------------------------------------------------------------------


def test_preprocess_steps(spark):
    df = spark.createDataFrame([(1, "<b>ﬁle</b>  one"), (2, None), (3, "")], "doc_id long, text string").withColumn("meta", F.create_map(F.lit(" K "), F.lit(" v ")))
    got = {r.doc_id: r.result for r in preprocess.process(df, metadata="meta").collect()}
    assert got[1].cleaned_text == "file one" and got[1].steps_applied == list(preprocess.STEPS) and got[1].cleaned_metadata == {"K": "v"} and got[1].features.word_count == 2
    assert got[2].error == "Pipeline failed at 'unicode_normalization': the text is null" and got[2].cleaned_text == "" and got[2].steps_applied == [] and got[2].chunks == []
    assert got[3].error == "" and got[3].chunks == []
    no_ocr = preprocess.process(df, ocr=False, steps=["text_cleaning", "ocr_correction", "other"]).filter("doc_id = 1").first().result
    assert no_ocr.cleaned_text == "ﬁle one" and no_ocr.steps_applied == ["text_cleaning"]
    bad = preprocess.process(df, steps=["metadata_cleanup", "chunking"], metadata="meta", chunk_size=5, chunk_overlap=9).filter("doc_id = 1").first().result
    assert bad.steps_applied == ["metadata_cleanup"] and bad.error.startswith("Pipeline failed at 'chunking'") and bad.cleaned_text == ""
    stored = preprocess.process(spark.createDataFrame([(1, "<a>")], "doc_id long, text string")).select(preprocess.stored_text(F.col("result"), F.col("text")).alias("t")).first().t
    assert stored == "<a>"


def test_registry():
    r = extraction.Registry()
    r.register("memo", [extraction.SchemaField("to"), extraction.SchemaField("tags", "array<string>", [])])
    assert r.types() == ["custom", "memo"] and r.field_names("memo") == ["to", "tags"] and r.defaults("memo") == {"to": None, "tags": []} and r.field_names("custom") == []
    with pytest.raises(KeyError):
        r.fields("invoice")


def test_extraction_with_and_without_a_model(spark):
    docs = spark.createDataFrame([(1, "some text " * 20), (2, "bad " * 20)], "doc_id long, text string")

    def model(prompt):
        if prompt.startswith("bad"):
            raise ValueError("no")
        return "{'document_type': 'memo', 'extracted_data': {'a': 'x', 'b': 'y', 'c': 'z'}}"

    got = {r.doc_id: r for r in extraction.extract_with_model(docs, model, sleep=lambda s: None).collect()}
    assert got[1].confidence_score == 0.75 and json.loads(got[1].structured_json)["document_type"] == "memo"
    assert got[2].confidence_score == 0.0 and got[2].error_message == "AI inference failed: ValueError: no" and got[2].structured_json == extraction.GENERIC
    none = extraction.extract_with_model(docs, None).filter("doc_id = 1").first()
    assert none.confidence_score == 0.0 and none.structured_json == extraction.GENERIC and none.error_message == ""
    r = extraction.extract(spark.createDataFrame([("{'a': 1}",), ("",), ("prose",), ('{"a": 1}',)], "answer string")).collect()
    assert [(x.result.success, x.result.repaired, x.result.error != "") for x in r] == [(True, True, False), (False, False, True), (False, False, True), (True, False, False)]


def test_nested_metadata(spark):
    clean = lambda raw, **kw: one(spark, structure.clean_nested_metadata(F.lit(raw).cast("string"), **kw))
    assert clean(None) == "{}" and clean("[1]") is None and clean("{") is None
    assert json.loads(clean('{"a": 0, "error": null, "B": {"x": {"y": 1}}, "b": {"x": {"z": 2}}}')) == {"error": None, "B": {"x": {"y": 1, "z": 2}}}
    assert json.loads(clean('{"z": "", "a": 1}', strip_empty=False)) == {"z": "", "a": 1}


# --- recovery and models ------------------------------------------------------------------------------------------------


def test_retries():
    waits, calls = [], []

    def failing(errors):
        calls.append(1)
        if len(calls) <= len(errors):
            raise errors[len(calls) - 1]
        return "done"

    def run(errors, **kw):
        waits.clear()
        calls.clear()
        return recovery.retried(failing, errors, sleep=waits.append, **kw)

    assert run([ValueError(), ValueError()]) == "done" and waits == [1.0, 2.0]
    assert run([recovery.HttpError(429, retry_after="7"), recovery.HttpError(429, retry_after="soon")]) == "done" and waits == [7.0, 2.0]
    assert run([ValueError()] * 9, attempts=10, cap=5.0) == "done" and waits == [1, 2, 4, 5, 5, 5, 5, 5, 5]
    for e, tries in ((recovery.HttpError(404), 1), (ValueError(), 3)):
        with pytest.raises(type(e)):
            run([e] * 5)
        assert len(calls) == tries


def test_log_and_states(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for at in (2.0, 1.0):
        recovery.append_log(spark.createDataFrame([(at, "ai", "d", True, 1, None, "info", None)], recovery.LOG), path)
    (tmp_path / "log" / "bad.json").write_text("not json\n")
    assert [r.timestamp for r in recovery.read_log(spark, path).collect()] == [1.0, 2.0]
    path = f"file://{tmp_path}/state"
    for at, stage in ((1.0, "extract"), (2.0, "clean")):
        recovery.save_state(spark, path, spark.createDataFrame([("a", stage, "{}", at, at), ("b", "extract", "{}", at, at + 5)], recovery.STATE))
    assert [(r.document_id, r.stage, r.created_at) for r in recovery.load_states(spark, path).collect()] == [("b", "extract", 1.0), ("a", "clean", 1.0)]
    recovery.delete_states(spark, path, spark.createDataFrame([("b",)], "document_id string"), 99.0)
    assert [r.document_id for r in recovery.load_states(spark, path).collect()] == ["a"]


def test_providers(spark):
    p = models.Provider(generate=str.upper, models=lambda: {"m": 5}, stream=lambda prompt: iter(["a ", "b"]))
    models.register("mine", lambda: p)
    assert models.create("mine") is p and p.available() and [tuple(r) for r in p.catalogue(spark).collect()] == [("m", "local", True, "m", 5)]
    assert p.model(spark, "m").count() == 1 and p.streamed("x") == {"text": "a b", "tokens_out": 2, "success": True, "error": ""}
    with pytest.raises(LookupError):
        p.model(spark, "it's")
    with pytest.raises(ValueError):
        models.create("other")

    def broken(*_):
        yield "part"
        raise OSError("gone")

    q = models.Provider(generate=str, models=lambda: 1 / 0, stream=broken, probe=lambda: 1 / 0)
    assert not q.available() and q.catalogue(spark).count() == 0 and q.streamed("x") == {"text": "part", "tokens_out": 1, "success": False, "error": "OSError: gone"}
    empty = files.infer(spark.createDataFrame([(1, "t")], "doc_id long, text string"), lambda t: "", sleep=lambda s: None).first()
    assert empty.answer is None and empty.error == "the model gave an empty answer"


# --- monitoring ---------------------------------------------------------------------------------------------------------


def test_monitor(spark):
    s = monitor.sample()
    assert set(s) == {"timestamp", *monitor.METRICS} and 0 <= s["ram_percent"] <= 100 and s["ram_total_gb"] > 0
    frame = monitor.snapshots(spark, [s, {**s, "timestamp": s["timestamp"] + 1}])
    assert monitor.metric_history(frame, 1).count() == len(monitor.METRICS)
    records = []
    with monitor.measured(records, "ocr", "d1"):
        pass
    with pytest.raises(ValueError), monitor.measured(records, "ai"):
        raise ValueError
    assert [(r[0], r[3], r[4]) for r in records] == [("ocr", "d1", True), ("ai", None, False)] and all(r[1] >= 0 for r in records)
    board = monitor.dashboard(monitor.timings(spark, records), frame, frame.limit(1))
    assert set(board) == {"operations", "recent_timings", "system", "system_history", "cache"} and board["system"].first().timestamp == s["timestamp"] + 1
    assert monitor.health(spark.createDataFrame([], "passed boolean")).first() == (True, "0/0 checks passed")
    assert rolling.sampler(spark, 5).isStreaming


def test_metric_stream(spark, tmp_path):
    q = rolling.metric_stream(spark, 1).writeStream.format("memory").queryName("metrics").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        for _ in range(60):
            if spark.table("metrics").count():
                break
            time.sleep(0.5)
        rows = spark.table("metrics").collect()
    finally:
        q.stop()
    assert rows and all(0 <= r.ram_percent <= 100 and r.disk_total_gb > 0 for r in rows)


# --- media and sinks ------------------------------------------------------------------------------------------------------


def test_pdf_image_and_video_extractors(tmp_path):
    direct = media.pdf_extractor(lambda b: ["x" * 30, "", "y" * 30], None)
    assert direct(b"") == ("x" * 30 + "\n\n" + "y" * 30, 1.0)
    scanned = media.pdf_extractor(lambda b: [" " * 80], lambda b: [(" one ", 0.5), ("  ", 0.0), ("two", 1.0)])
    assert scanned(b"") == ("one\n\ntwo", 0.75)
    assert media.pdf_extractor(lambda b: [], lambda b: [])(b"") == ("", 0.0)
    with pytest.raises(RuntimeError):
        media.pdf_extractor(lambda b: ["short"], None)(b"")
    image = media.image_extractor(lambda b: np.zeros((4, 4), np.uint8), lambda p: [(" a ", 90), ("", 80), ("b", -1), ("c d", 70)], False)
    assert image(b"") == ("a c d", 0.8)
    assert media.transcript([" a ", "", "b"], None, 0.4) == ("a b", 0.4) and media.transcript([], None, None) == ("", 0.0) and media.transcript(["a"], 0.5, None)[1] == 1.0
    with pytest.raises(RuntimeError, match="isn't installed"):
        media.video_extractor(lambda b: ("", 0.0), "no-such-program")(b"")
    tool = tmp_path / "tool"
    tool.write_text('#!/bin/sh\nfor last; do :; done\ncp "$2" "$last"\n')
    tool.chmod(0o755)
    assert media.video_extractor(lambda b: (b.decode(), 0.5), str(tool))(b"sound") == ("sound", 0.5)
    tool.write_text("#!/bin/sh\necho bad >&2; exit 3\n")
    with pytest.raises(RuntimeError, match="bad"):
        media.video_extractor(lambda b: ("", 0.0), str(tool))(b"")


def test_image_preprocessing():
    rnd = np.random.default_rng(1)
    page = np.full((200, 300), 220, np.uint8)
    for y in range(20, 180, 20):
        page[y : y + 6, 30:270] = 40
    noisy = page.copy()
    spots = rnd.integers(0, [200, 300], (300, 2))
    noisy[spots[:, 0], spots[:, 1]] = 0
    assert (media.median3(noisy) != page).mean() < 0.02
    clean = media.preprocessed(np.repeat(noisy[..., None], 3, 2))
    assert set(np.unique(clean)) == {0, 255} and ((clean == 0) == (page == 40)).mean() > 0.97
    assert abs(media.skew(page)) < 0.5
    leaning = media.rotated(page, -4.0)
    assert abs(media.skew(leaning) - 4.0) <= 0.5 or abs(media.skew(leaning) + 4.0) <= 0.5
    assert abs(media.skew(media.preprocessed(leaning, denoise=False))) < 0.6
    assert media.skew(np.full((50, 50), 255, np.uint8)) == 0.0


def test_export_names_and_report(spark, tmp_path):
    assert sinks.default_path("out", "csv", "all", datetime.datetime(2024, 5, 6, 7, 8, 9)) == "out/export_20240506_070809_all.csv"
    docs = spark.createDataFrame([("a", "f.txt", 10, "text/plain", "stored", 0.0, 60.0, 0.5, "bad", 1.25, "line\n" * 100, '{"type": "memo"}'), ("b", "g.txt", 2048, "text/plain", "failed", 0.0, 0.0, 0.0, None, 0.0, "", None)], "id string, filename string, file_size long, mime_type string, status string, created_at double, updated_at double, confidence_score double, error_message string, processing_time double, extracted_text string, structured_json string")
    made = sinks.export(docs, "txt", folder=str(tmp_path / "new"))
    body = open(made["path"]).read()
    assert made["count"] == 2 and "Document 1: f.txt" in body and "Document 2: g.txt" in body and "Documents: 2" in body and "Generated: 20" in body
    for line in ("  Updated:         1970-01-01 00:01:00", "  Processing time: 1.2s", "  Text length:     500 chars", "  Schema type:     memo", "  Error:           bad", "    line line"):
        assert line in body or line.replace("1.2s", "1.3s") in body, line
    assert sinks.export_one(docs, "b", "json", str(tmp_path / "one.json"))["count"] == 1
    with pytest.raises(RuntimeError, match="openpyxl"):
        sinks.export(docs, "xlsx", str(tmp_path / "x.xlsx"))


def test_clean_names_of_operations(spark):
    ev = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string")
    assert {(r.k, r.v) for r in operations.latest(ev, "k", ["t"]).collect()} == {(1, "b"), (2, "c")}
    assert {r.v for r in operations.beyond_newest(ev, "k", 1, F.col("t")).collect()} == {"a"}
