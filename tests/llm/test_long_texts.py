"""Every operator reads whole texts: one of megabytes beside short ones, against a direct computation of the same thing."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from tests.llm.test_simhash import brute_fingerprint
from tokenizers import Tokenizer

from quillspark.llm import bpe, chat, decontaminate, digest, quality, sharding, shingles, simhash, tokenfile, toxicity, warc
from quillspark.llm.queries import tokenizer_file

RND = random.Random(12)
SYLLABLES = ["then", "ing", "ar", "ö", "lich", "re", "ción", "x1", "."]
LONG = " ".join("".join(RND.choices(SYLLABLES, k=RND.randrange(1, 5))) for _ in range(345_000))
#: No white space at all, as base64 of a file would be.
SOLID = base64.b64encode(RND.randbytes(300_000)).decode()
TEXTS = {1: "short", 2: LONG, 3: SOLID, 4: LONG[:-20] + " vileword at the very end", 5: ""}


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > 2_500_000
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").repartition(3).cache()


def test_toxicity(spark, docs):
    rows = [(i, f"clean words {i} " + "vileword " * (i % 2) * 3) for i in range(100, 160)]
    sample = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.fit(sample, spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.p_toxic for r in toxicity.score(docs, chain).collect()}
    for i, t in TEXTS.items():
        assert got[i] == pytest.approx(chain.probabilities([t])[0, chain.names.index("toxic")])
    assert got[4] > got[2]  # its last words count


def test_warc(spark, docs):
    pages = docs.selectExpr("doc_id as page_id", "'u' as url", "text as html")
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    for i, t in TEXTS.items():
        assert got[i].payload_bytes == len(t.encode()) and got[i].payload_digest == base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()


def test_decontamination(spark, docs):
    item = "a passage of words that stands at the very end of one long text alone"
    rows = docs.selectExpr("doc_id", f"if(doc_id = 2, concat(text, ' {item}'), text) as text")
    got = decontaminate.contaminated(rows, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.score, r.end_word) for r in got] == [(2, 9, 1.0, len(decontaminate.words(f"{LONG} {item}")))]


def test_fingerprints(docs):
    got = {r.doc_id: r for r in digest.neighbour_report(docs).collect()}
    order = sorted(TEXTS, reverse=True)
    for i, nxt in zip(order, [*order[1:], order[0]], strict=True):
        changed = digest.edited(TEXTS[i], TEXTS[nxt])
        assert got[i].n_chars == len(TEXTS[i]) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        own, other, new = digest.digests([TEXTS[i], TEXTS[nxt], changed])
        assert got[i].fingerprint == digest.text_form(own) and got[i].edited_fingerprint == digest.text_form(new)
        assert got[i].near_edited == pytest.approx(digest.likeness(own, new)) and got[i].near_next == pytest.approx(digest.likeness(own, other))
    assert got[4].near_next < 0.2 and got[2].near_edited > 0.5


def test_simhash_and_shingles(docs):
    part = LONG[:200_000]
    assert simhash.fingerprint(part) == brute_fingerprint(part)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {i: int(f, 16) for i, (f, _) in got.items()} == {i: simhash.fingerprint(t) for i, t in TEXTS.items()}
    assert got[4][1] == 2  # two long texts but for their ends
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 2, 5: 5}


def test_bpe(docs):
    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.round_trip_digests(docs, path).collect()}
    for i, t in TEXTS.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_quality(spark, docs):
    labels = spark.createDataFrame([(i, int(i != 3)) for i in TEXTS], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert got == {i: float(model.scores(quality.term_counts([t]))[0]) for i, t in TEXTS.items()}


def test_token_file(docs):
    path = tokenizer_file("word_bpe_49k.json")
    library, start = Tokenizer.from_file(path), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.file_round_trip(docs, path).collect()}
    for i, t in sorted(TEXTS.items()):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_chat(spark, docs):
    rows = docs.selectExpr("7L as conv_id", "doc_id as turn", "'assistant' as role", "text")
    r = chat.written_report(rows).first()
    said = "".join(f"assistant\n{t}\n" for _, t in sorted(TEXTS.items()))
    loss = "".join(t for _, t in sorted(TEXTS.items()))
    assert (r.turns_sha256, r.loss_chars, r.loss_sha256) == (hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_sharding(docs):
    got = {r.doc_id: r for r in sharding.assign(docs).collect()}
    assert {i: (r.size, r.text_crc32) for i, r in got.items()} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in TEXTS.items()}
    assert all(r.shard in range(8) for r in got.values())
