"""Each stage by itself against a brute-force version or the labels; each on what the stages before it kept."""

import hashlib
import struct

import corpus_pipeline
import numpy as np
import pytest
from tests.llm.test_shingles import brute_groups
from tokenizers import Tokenizer

from quillspark.llm import decontaminate
from quillspark.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """name -> (what came in, what went out), as doc_id -> text; of the last stage, the rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        before, rows = kept, docs.collect()
        if name != "bpe":
            assert docs.columns == columns
            kept = {r.doc_id: r.text for r in rows}
            assert len(kept) == len(rows) and all(before[i] == t for i, t in kept.items())
        out[name] = before, (rows if name == "bpe" else kept)
    return out


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_quality_stage(stages, labels):
    _, kept = stages["quality"]
    right = [(i in kept) == r.quality for i, r in labels.items()]
    assert sum(right) > 0.95 * len(right)


def test_toxicity_stage(stages, labels):
    before, kept = stages["toxicity"]
    mine = [r for i, r in labels.items() if i in before]
    assert sum(r.toxic and r.doc_id in kept for r in mine) <= 0.2 * max(5, sum(r.toxic for r in mine))
    assert sum(not r.toxic and r.doc_id not in kept for r in mine) <= 0.02 * len(mine)


def test_near_duplicate_stage(stages):
    """Five words, similarity 0.8 or more: the rule of the stage (op5's query has three words and three bits)."""
    before, kept = stages["near_duplicates"]
    assert set(kept) == set(brute_groups(before).values())


def test_decontamination_stage(spark, stages):
    before, kept = stages["decontamination"]
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    gone = set(before) - set(kept)
    assert {i for i, t in before.items() if any(b in t for b in bench.values())} <= gone
    for i in gone:
        ids = {}
        enc = lambda t: np.array([ids.setdefault(w, len(ids) + 1) for w in decontaminate.words(t.lower())])  # noqa: B023, E731
        assert any(decontaminate.align(enc(b), enc(before[i]))[0] >= decontaminate.THRESHOLD for b in bench.values())


def test_bpe_stage(stages):
    before, rows = stages["bpe"]
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    assert {r.doc_id for r in rows} == set(before)
    for r in rows:
        ids = library.encode(before[r.doc_id], add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()


def test_run_is_all_stages(spark, stages):
    _, rows = stages["bpe"]
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in rows}


def test_stages_on_an_odd_table(spark):
    """Null ids and texts, repeated rows and ids, a text of 2 MB, columns with the operators' own names."""
    rows = [(None, None, "x"), (None, "lone words without an id", "x"), (1, None, "x"), (2, "", "x"), (3, "le chat et la souris dorment bien", "x"), (3, "le chat et la souris dorment bien", "x"), (4, "le chat et la souris dorment bien", "x"), (5, "word and other " * 140_000, "x")]
    names = ("score", "fp", "shard", "__gone", "id", "t", "bucket", "root")
    docs = spark.createDataFrame([(*r[:2], *[r[2]] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        if name != "bpe":
            assert out.columns == docs.columns == empty.columns
        got = sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect())
        if name == "near_duplicates":
            assert got == [-1, -1, 1, 3, 3, 5]
        elif name in ("decontamination", "bpe"):
            assert got == [-1, -1, 1, 2, 3, 3, 4, 5]
