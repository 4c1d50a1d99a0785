import random

import pytest
from tokenizers import Tokenizer

from quillspark.llm import bpe
from quillspark.llm.queries import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.ByteBPE(PATH), Tokenizer.from_file(PATH)


def texts():
    rnd = random.Random(5)
    pool = ["the ", "Straße", " été", "\n\n", "\t", "  ", "don't", "WE'LL", "12345", "日本語テキスト", "🙂👩‍👩‍👧", "\x00\x1c\x85 ", "<|endoftext|>", "<|endof", "!!!???", "ñ", "é", " ", "١٢٣", "a" * 9, "﻿", "ﬁ"]
    yield from ["", " ", "x", "<|endoftext|>", "a" * 5000, "ab" * 700, "the" * 300, "=" * 3000, "́" * 200]
    for n in (1, 2, 5, 20, 200):
        for _ in range(40):
            yield "".join(rnd.choice(pool) for _ in range(n))
    for _ in range(200):
        yield "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x250), rnd.randrange(0x370, 0x2FFF)])) for _ in range(30))


def test_same_ids_and_text_as_the_library(both):
    own, library = both
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_scan_and_heap_merge_alike(both):
    own, _ = both
    rnd = random.Random(1)
    for _ in range(300):
        word = "".join(rnd.choice("aethionrs") for _ in range(rnd.randrange(2, 100))).encode()
        assert own._encode_long([own.byte_ids[b] for b in word]) == own.encode_word(word)


def test_cache_is_bounded():
    cache = bpe.WordCache(str.upper, most=3)
    assert [cache[w] for w in "abcabcdefga"] == list("ABCABCDEFGA")
    assert len(cache) <= 3 and len(cache.old) <= 3


def test_tables(spark):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6), (2, None, 7), (None, "", 8)], "doc_id long, text string, ids int")
    rows = {(r.doc_id, r.n_tokens) for r in bpe.round_trip_digests(df, PATH).collect()}
    assert rows == {(1, 2), (2, 0), (None, 0)}
    assert sorted(r.text for r in bpe.decode_documents(bpe.encode_documents(df, PATH), PATH).collect()) == ["", "", "a b", "a b"]
    assert bpe.round_trip_digests(df.limit(0), PATH).count() == 0


def test_boundaries_cut_the_word_into_its_tokens():
    own = bpe.ByteBPE(tokenizer_file("byte_bpe_50k.json"))
    rnd = random.Random(9)
    for n in [0, 1, 2, 7, 40, 128, 129, 600]:
        for _ in range(20):
            word = "".join(rnd.choice("theandingé ") for _ in range(n)).encode()
            bounds, ids = own.parts(word)
            assert bounds[0] == 0 and bounds[-1] == len(word)
            assert [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)] == [own.pieces[i] for i in ids]


def test_the_cache_is_bounded_in_words_and_bytes():
    cache = bpe.WordCache(lambda w: w.encode() * 2, 50, 40_000)
    for i in range(3000):
        word = f"{i}" * (1 + i % 90)
        assert cache[word] == word.encode() * 2
        assert len(cache) <= 50 and len(cache.old) <= 50
        assert sum(4 * len(w) + len(v) + bpe.ENTRY_BYTES for w, v in cache.items()) == cache.bytes <= 40_000
    assert cache["x" * 10_000] == b"x" * 20_000 and "x" * 10_000 not in cache


def test_narrow_split_is_the_public_one():
    import regex

    own, public = bpe.ByteBPE(PATH), regex.compile(bpe.SPLIT).findall
    rnd = random.Random(4)
    some = "aé'stmdrevl 1²½.,-_\t\n\r\x0b\x0c\x1c\x1f\x85\xa0ªµºŉǅ"
    for k in range(4000):
        t = "".join(rnd.choice(some) if k % 2 else chr(rnd.randrange(0x250)) for _ in range(rnd.randrange(30)))
        assert own.split_narrow(t) == public(t), t


def test_every_code_point_is_split_as_the_library_does(both):
    own, library = both
    cut = library.pre_tokenizer.pre_tokenize_str
    assert own.odd  # the two follow different versions of Unicode
    points = [c for c in range(0x250, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x32000 or chr(c) in own.odd or c % 997 == 0)]
    for at in range(0, len(points), 64):
        for form in ("a{0}b1{0}2 {0}!{0} ", "'{0}' {0}\n{0}{0} s'{0}ll"):
            text = "".join(form.format(chr(c)) for c in points[at : at + 64])
            assert own.split(text) == [text[b:e] for _, (b, e) in cut(text)], hex(points[at])


def test_ids_with_letters_that_only_one_side_knows(both):
    own, library = both
    rnd = random.Random(11)
    odd = sorted(own.odd)
    pool = [*"ab 1!'\n", "龩", "\U00018f1a", "’", " the", "　"]
    for _ in range(3000):
        text = "".join(rnd.choice(odd) if rnd.random() < 0.3 else rnd.choice(pool) for _ in range(rnd.randrange(1, 12)))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert own.encode("a\U00018f1a鞩") == library.encode("a\U00018f1a鞩", add_special_tokens=False).ids


def test_batches_are_bounded_in_bytes(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200_000).alias("text"))
    bpe.bounded_batches(spark)
    sizes = df.mapInArrow(lambda bs: (type(b).from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()
    assert len(sizes) > 3 and max(r.n for r in sizes) <= bpe_bytes() + 2_000_000


def bpe_bytes():
    from quillspark.llm.common import ARROW_BYTES

    return ARROW_BYTES


def test_decoder_on_an_odd_table(spark):
    df = spark.createDataFrame([(1, [64, 275], "x"), (1, [64, 275], "y"), (None, None, "z"), (2, [], "z")], "doc_id long, ids array<int>, text string")
    one = bpe.decode_documents(df.limit(1), PATH).first().text
    rows = bpe.decode_documents(df, PATH).collect()
    assert len(rows) == 4 and {r.text for r in rows if r.doc_id in (None, 2)} == {""} and {r.text for r in rows if r.doc_id == 1} == {one}
    assert bpe.decode_documents(df.limit(0), PATH).count() == 0
