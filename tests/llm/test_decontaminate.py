import random
import re

import numpy as np

from quillspark.llm import decontaminate as d


def brute_align(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best / (2 * len(a)) if a else 0


def test_alignment_scores_by_brute_force():
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ([rnd.randrange(1, 6) for _ in range(rnd.randrange(1, 14))] for _ in range(2))
        score, x, y = d.align(np.array(a), np.array(b))
        assert score == brute_align(a, b)
        assert 0 <= x <= y <= len(b) and brute_align(a, b[x:y]) == score


def corpus():
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)] + ["the", "of"] * 900
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = {i: text(rnd.randrange(15, 50)) for i in range(30)}
    docs = {i: text(rnd.randrange(30, 400)) for i in range(150)}
    for i in range(0, 150, 3):
        w = items[i % 30].split()
        for _ in range(i % 4):  # edits: change, drop or add words
            p = rnd.randrange(len(w))
            w[p : p + rnd.randrange(2)] = [rnd.choice(vocab)] * rnd.randrange(2)
        docs[i] = docs[i][: rnd.randrange(len(docs[i]))] + " " + " ".join(w).upper() + "! " + docs[i][:90]
    docs |= {i: items[7] for i in range(150, 200)} | {200: None, 201: ""}  # one passage in very many documents
    return items, docs


def brute(items, docs, threshold):
    ids, out = {}, set()
    enc = lambda t: [ids.setdefault(w, len(ids)) for w in re.findall(r"\w+", (t or "").lower())]
    for i, t in docs.items():
        w = enc(t)
        for k, x in items.items():
            if len(set(w) & set(enc(x))) * 3 > len(set(enc(x))) and brute_align(enc(x), w) >= threshold:
                out.add((i, k))
    return out


def test_whole_result_by_brute_force(spark):
    items, docs = corpus()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items.items()], "item_id long, text string, doc_id int")
    got = d.contaminated(df, bench).collect()
    want = brute(items, docs, d.THRESHOLD)
    assert len(want) > 90 and {(r.doc_id, r.item_id) for r in got} == want
    kept = {r.doc_id for r in d.keep_uncontaminated(df, bench).collect()}
    assert kept == set(docs) - {i for i, _ in want}


def test_blocks_give_the_same(spark, monkeypatch):
    items, docs = corpus()
    df = spark.createDataFrame(list(docs.items())[:60], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    whole = {(r.doc_id, r.item_id, r.score) for r in d.contaminated(df, bench).collect()}
    monkeypatch.setattr(d, "BLOCK_ITEMS", 7)
    assert whole and {(r.doc_id, r.item_id, r.score) for r in d.contaminated(df, bench).collect()} == whole


def test_odd_items_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "nothing here"), (2, "say Hello World now"), (2, "say Hello World now"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "hello world"), (2, None), (3, "..."), (4, "hello world")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.score) for r in d.contaminated(df, bench).collect()) == [(2, 1, 1.0)] * 2 + [(2, 4, 1.0)] * 2
    assert d.contaminated(df, bench.limit(0)).count() == 0 and d.contaminated(df.limit(0), bench).count() == 0
    assert d.keep_uncontaminated(df, bench.limit(0)).count() == 4


def edited(w, pattern, rnd):
    """A copy of the words w, changed by a pattern: replace, drop or add at a rate, or replace or add at every k-th."""
    kind, much = pattern
    out = []
    for i, x in enumerate(w):
        hit = rnd.random() < much if much < 1 else i % much == much - 1
        if kind == "replace":
            out.append(f"new{rnd.randrange(10**6)}" if hit else x)
        elif kind == "drop":
            out += [] if hit else [x]
        elif kind == "add":
            out += [x, f"new{rnd.randrange(10**6)}"] if hit else [x]
        else:  # a mixture
            out += [[], [x, f"new{rnd.randrange(10**6)}"], [f"new{rnd.randrange(10**6)}"]][rnd.randrange(3)] if hit else [x]
    return out if kind != "swap" else w


PATTERNS = [("replace", 3), ("replace", 4), ("replace", 0.15), ("replace", 0.25), ("replace", 0.34), ("add", 1), ("add", 2), ("add", 0.5), ("drop", 3), ("drop", 0.3), ("mixed", 3), ("mixed", 0.2), ("mixed", 0.3)]


def recall(bench, pattern, seed=5):
    """Copies in running text that exhaustive alignment scores 0.5 or more, and how many of them are found."""
    rnd = random.Random(seed)
    items = d.Items(list(enumerate(bench)))
    filler = [w for t in bench for w in d.words(t.lower())]
    due = found = 0
    for k, t in enumerate(bench):
        w = d.words(t.lower())
        text = " ".join([*rnd.choices(filler, k=60), *edited(w, pattern, rnd), *rnd.choices(filler, k=60)])
        code = items.encode(text)
        if brute_align(items.words[k].tolist(), code.tolist()) >= d.THRESHOLD:
            due += 1
            found += any(m[0] == k and m[1] >= d.THRESHOLD for m in items.matches(code))
    return due, found


def test_recall_of_edited_copies(spark):
    bench = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").collect()]
    due = {p: recall(bench, p) for p in PATTERNS}
    assert all(n == found for n, found in due.values()), due
    assert all(due[p][0] == len(bench) for p in [("replace", 3), ("replace", 4), ("replace", 0.15)])


def test_words_by_bytes_are_the_words():
    rnd = random.Random(7)
    some = "aZ_0é ßİıſ²½ªµ—’«\u00a0\u0307\u2028\t\n.,日本ǅ\x1c\x85"
    for k in range(3000):
        t = "".join(rnd.choice(some if k % 3 else some[:9]) if rnd.random() < 0.9 else chr(rnd.randrange(1, 0xD000)) for _ in range(rnd.randrange(40)))
        items = d.Items([(1, t)])
        assert items.encode(t).tolist() == [items.vocab[w] for w in d.words(t.lower())] == items.words[0].tolist(), t
