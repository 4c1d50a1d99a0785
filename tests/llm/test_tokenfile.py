import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import common, tokenfile
from quillspark.llm.queries import tokenizer_file
from tests.llm.test_bpe import texts

PATH = tokenizer_file("word_bpe_49k.json")


def test_random_access_by_brute_force():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 5000):
        for top in (2, 200, 300, 50_000, 1 << 32):
            ids = rnd.integers(0, top, n).astype(np.uint32)
            blob = tokenfile.encode(ids)
            codes = tokenfile.Codes(blob)
            assert codes.end == len(blob) and np.array_equal(codes.all(), ids)
            assert all(codes[int(i)] == ids[i] for i in (rnd.integers(0, n, 200) if n else []))
            for a, b in [sorted(rnd.integers(0, n + 1, 2).tolist()) for _ in range(40)]:
                assert np.array_equal(codes.run(a, b), ids[a:b])
    with pytest.raises(IndexError):
        codes[5000]


def test_words_as_the_library_encodes_whole_texts():
    own, library = tokenfile.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    assert own.plain
    rnd = random.Random(6)
    more = ["".join(chr(rnd.randrange(1, 0x250)) for _ in range(60)) for _ in range(400)]
    for t in [*texts(), *more, "ΑΣ ΣΑΣ", "İI", "é", "<|startoftext|>x", "A'S it's 'LL", "a_b-c__d", "a\x1cb\x1fc \x1d", "x\x85y\xa0z", "Ÿ ß'S", "½ ² a²b", "\x0b\x0c"]:
        assert np.frombuffer(own.encode_bytes(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize(("bucket_bytes", "segment"), [(1 << 30, 1 << 20), (700, 40)])
def test_file_by_brute_force(spark, monkeypatch, bucket_bytes, segment):
    monkeypatch.setattr(common.ordered_buckets, "__defaults__", (bucket_bytes,))
    monkeypatch.setattr(tokenfile, "SEGMENT_TOKENS", segment)
    library, rnd = Tokenizer.from_file(PATH), random.Random(segment)
    rows = [(rnd.randrange(1000), "".join(rnd.choice("ab cé1.") for _ in range(rnd.randrange(200)))) for _ in range(80)] + [(5000, None), (-4, ""), (None, "no id")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in tokenfile.file_round_trip(df, PATH).collect()), key=lambda r: r[1])
    assert got == want


def test_tokens_by_number(spark, monkeypatch):
    """Single tokens of a file of many buckets and segments, by their number in the file."""
    monkeypatch.setattr(common.ordered_buckets, "__defaults__", (900,))
    monkeypatch.setattr(tokenfile, "SEGMENT_TOKENS", 50)
    library, rnd = Tokenizer.from_file(PATH), random.Random(8)
    rows = [(i, " ".join(rnd.choice(["word", "naïve", "x1", "..."]) for _ in range(rnd.randrange(60)))) for i in range(60)]
    path = common.scratch_path(spark, "t")
    tokenfile.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH)
    ids = [i for _, t in rows for i in [*library.encode(t, add_special_tokens=False).ids, 1]]
    wanted = spark.createDataFrame([(int(i), 0) for i in range(-3, len(ids) + 5, 3)] + [(0, 0), (None, 0)], "place long, id int")
    segments = tokenfile.read_tokens(spark, path)
    assert segments.count() > 10
    assert sorted((r.place, r.id) for r in tokenfile.read_at(segments, wanted).collect()) == [(i, ids[i]) for i in range(0, len(ids), 3)]


def test_empty_table(spark):
    assert tokenfile.file_round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
