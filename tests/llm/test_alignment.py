import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillspark.llm import alignment, bpe
from quillspark.llm.queries import table, tokenizer_file

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute_force(texts, libraries):
    """One tuple (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each text, by the libraries and plain loops."""
    a, b = libraries
    back = {c: x for x, c in enumerate(bpe.byte_alphabet())}
    found = []
    for t in texts:
        if not t:
            found.append(None)
            continue
        ea, eb = a.encode(" " + t, add_special_tokens=False), b.encode(t)
        wa = [bytes(back[c] for c in a.id_to_token(i)) for i in ea.ids]
        wb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in eb]
        if b"".join(wa) != (" " + t).encode() or b"".join(wb) != (" " + t).encode():
            found.append(None)
            continue
        sides = []
        for ids, words in ((ea.ids, wa), (eb, wb)):
            end, out = 0, {}
            for i, w in zip(ids, words, strict=True):
                end += len(w)
                out[end] = i
            sides.append(out)
        both = sides[0].keys() & sides[1].keys()
        links = [(sides[0][end], sides[1][end]) for end in sorted(both)]
        parts = []
        for side in sides:
            parts.append([[]])
            for end, i in side.items():
                parts[-1][-1].append(str(i))
                if end in both:
                    parts[-1].append([])
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*parts, strict=True) if x]
        found.append((len(ea.ids), len(eb), links, ";".join(groups)))
    count = Counter(x for f in found if f for x in f[2])
    top = {}
    for (_, i), n in count.items():
        top[i] = max(top.get(i, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], len(f[2]), len(f[2]), sum(count[x] == top[x[1]] for x in f[2]), sum(count[x] for x in f[2]), hashlib.sha256(f[3].encode()).hexdigest()) for f in found]


def rows(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.orderBy("doc_id").collect()]


def odd_texts():
    rnd = random.Random(3)
    pool = ["the ", "Straße", "  ", " ", "\n\n", "▁", "<s>", "<0x41>", "<|endoftext|>", "日本語", "🙂👩‍👩‍👧", "\x00", "é", "é", "don't", "123,456", "\t", "　", "\U00018f1a", "\U0010ffff"]
    return ["", " ", "  ", "x", " x", "x ", "▁", "a▁b", "<|endoftext|>", "\x00", "=" * 500] + ["".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 30))) for _ in range(300)]


def test_units_give_the_library_s_ids(libraries):
    own = alignment.PieceTokenizer(B)
    assert own.by_units
    rnd = random.Random(8)
    texts = odd_texts() + ["".join(rnd.choice([*"ab ,.-'\"\n(1²’”–é", "the", "  "]) for _ in range(40)) for _ in range(2000)]
    plain = [t for t in texts if t and "▁" not in t]
    assert [x.tolist() for x in own.ids(plain)] == [libraries[1].encode(t) for t in plain]
    first = alignment.ByteTokenizer(A)
    assert first.whole is not None
    want = [libraries[0].encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in first.ids(texts)] == want
    first.whole = None
    assert [x.tolist() for x in first.ids(texts)] == want


@pytest.mark.parametrize("hot_pairs", [1 << 20, 50, 1])
def test_whole_result_against_brute_force(spark, libraries, hot_pairs):
    texts = odd_texts() + [r.text for r in table(spark, SF, "documents").orderBy("doc_id").limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert rows(alignment.alignment_report(df, A, B, hot_pairs=hot_pairs)) == brute_force(texts, libraries)


def test_registered_query_against_brute_force(spark, libraries):
    from quillspark.llm.queries import QUERIES

    texts = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").collect()]
    assert rows(QUERIES["op11_tokenizer_alignment"](spark, SF)) == brute_force(texts, libraries)


def test_nulls_repeats_empty_table_and_other_columns(spark, libraries):
    data = [(1, "the cat", 0), (1, "the cat", 0), (None, "the cat", 0), (2, None, 0), (3, "", 0), (None, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, row int").withColumnRenamed("row", "pair")
    got = alignment.alignment_report(df, A, B).collect()
    want = brute_force(["the cat"] * 3, libraries)[0]
    assert len(got) == 6 and sorted(r.doc_id or -1 for r in got) == [-1, -1, 1, 1, 2, 3]
    assert [tuple(r[1:]) for r in got if r.n_a] == [(*want[:6], want[6])] * 3
    assert all(tuple(r[1:]) == (0, 0, 0, 0, 0, 0, "") for r in got if not r.n_a)
    assert alignment.alignment_report(df.limit(0), A, B).collect() == []


def test_a_very_long_text(spark, libraries):
    text = "Some words, again and again; 12 of them.\n" * 20_000 + "x" * 5000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert rows(alignment.alignment_report(df, A, B)) == brute_force([text], libraries)


def test_python_only_tokenises(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = alignment.align(alignment.tokenise(df, A, B))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and "array_intersect" in plan
