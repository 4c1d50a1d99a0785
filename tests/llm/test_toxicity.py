import random

import numpy as np

from quillspark.llm import toxicity


def test_tokens():
    words, four, _, _, _, five, *_ = toxicity.tokens("Été, STUPID-idiot 42!")
    assert words == {"Été".encode().replace(b"\xc3\xa9", b"\xc3\xa9"), b"stupid", b"idiot", b"42"} | {w for w in words if w[0] > 127}
    assert b"stup" in four and b"idiot" in five
    # shares: 1 of 250 words is 0.4 percent, 1 of 251 less
    enough, less = (toxicity.tokens("idiotic " + "w " * n) for n in (249, 250))
    assert b"idiotic" in enough[0] and b"idio" in enough[2] and b"idio" not in enough[3] and b"idio" in less[1] and b"idio" not in less[2]
    assert toxicity.tokens("") == [set()] * toxicity.KINDS


def test_indices_are_the_chosen_tokens():
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abé", k=rnd.randrange(1, 9))) for _ in range(60)]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(0, 300))) for _ in range(40)]
    pool = sorted({(k, t) for text in texts for k, found in enumerate(toxicity.tokens(text)) for t in found})
    vocab = [{} for _ in range(toxicity.KINDS)]
    for i, (k, t) in enumerate(rnd.sample(pool, 200)):
        vocab[k][t] = i
    chain = toxicity.Chain(["toxic"], vocab)
    for text in [*texts, ""]:
        want = [d[t] for d, found in zip(vocab, toxicity.tokens(text), strict=True) for t in d.keys() & found]
        assert sorted(chain.indices(text)) == sorted(want)


def test_later_models_use_out_of_fold_predictions():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 2, (400, 5)).astype(np.float32)
    first = x[:, 0].astype(np.float32)
    second = ((x[:, 0] + x[:, 1]) > 1).astype(np.float32)
    weights, bias, links = toxicity.fit_chain(x, [first, second], np.arange(400) % 5)
    assert links.shape == (2, 2) and links[1, 0] > 0 and links[0].sum() == 0
    # the second model's inputs are the first one's probabilities from models that haven't seen the row
    full = []
    for f in range(5):
        own = np.arange(400) % 5 == f
        w = toxicity.logistic(x[~own], first[~own])
        full.append((own, x[own] @ w[:-1] + w[-1]))
    unseen = np.zeros(400, np.float32)
    for own, z in full:
        unseen[own] = z
    w = toxicity.logistic(np.hstack([x, 1 / (1 + np.exp(-unseen[:, None]))]), second)
    assert np.allclose(weights[:, 1], w[:5]) and np.isclose(links[1, 0], w[5]) and np.isclose(bias[1], w[6])


def test_held_out_accuracy_and_odd_tables(spark):
    rnd = random.Random(1)
    clean = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = rnd.choices(clean, k=rnd.randrange(5, 80)) + rnd.choices(["vileman", "vilest", "CRUD"], k=2 * bad)
        rnd.shuffle(words)
        rows.append((i, " ".join(words), "x"))
        if i < 400:
            labels.append((i, i % 3 > 0, int(bad)))
    docs = spark.createDataFrame([*rows, (700, None, "x"), (701, "", "x"), (701, "", "x")], "doc_id long, text string, p_toxic string")
    marks = spark.createDataFrame([(i, int(q), t) for i, q, t in labels] + [(None, 1, 1), (9999, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    right = [got[i].is_toxic == (i % 4 == 0) for i in range(400, 600)]
    assert sum(right) >= 0.98 * len(right)
    assert got[700].is_toxic == 0 == got[701].is_toxic
    kept = toxicity.keep_clean(docs, chain)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.is_toxic}
    none = toxicity.fit(docs, marks.limit(0))
    assert toxicity.score(docs, none).filter("is_toxic = 1").count() == 0
    assert toxicity.score(docs.limit(0), chain).count() == 0


def naive_choice(rows, y, folds, out):
    """kind, token -> z of the features that a model without fold `out` chooses, by counting in plain Python."""
    seen = [i for i in range(len(rows)) if folds[i] != out]
    n, p = len(seen), sum(y[i] for i in seen)
    m, a = {}, {}
    for i in seen:
        for f in rows[i]:
            m[f] = m.get(f, 0) + 1
            a[f] = a.get(f, 0) + y[i]
    found = {}
    for f in m:
        if m[f] >= toxicity.LEAST_DOCS:
            b = m[f] - a[f]
            odds = np.log((a[f] + 0.5) * (n - p - b + 0.5) / ((b + 0.5) * (p - a[f] + 0.5)))
            found[f] = abs(odds / np.sqrt(1 / (a[f] + 0.5) + 1 / (b + 0.5) + 1 / (p - a[f] + 0.5) + 1 / (n - p - b + 0.5)))
    best = sorted((f for f in found if found[f] > 0), key=lambda f: (-round(found[f], 12), f))[:40]
    return {f: found[f] for f in best}


def test_whole_result_by_brute_force(spark):
    """Scores of fit() and score() against features counted, chosen and scaled one by one."""
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts, marks = [], []
    for i in range(150):
        toxic, junk = i % 3 == 0, i % 5 == 0
        words = rnd.choices(base, k=rnd.randrange(8, 40)) + rnd.choices(["vile", "vilest", "crudman"], k=2 * toxic) + ["###x"] * (6 * junk)
        rnd.shuffle(words)
        texts.append((i, " ".join(words)))
        marks.append((i, int(not junk), int(toxic)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels, features=40)
    got = {r.doc_id: [r[f"p_{n}"] for n in chain.names] for r in toxicity.score(docs, chain).collect()}

    folds = [r.f for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id, 'fold'), {toxicity.FOLDS}) as f").orderBy("doc_id").collect()]
    rows = [{(k, t) for k, found in enumerate(toxicity.tokens(t)) for t in found} for _, t in texts]
    ys = [[int(t and q) for _, q, t in marks], [int(t and not q) for _, q, t in marks], [t for _, _, t in marks]]
    every = sorted(set().union(*rows))
    at = {f: i for i, f in enumerate(every)}
    x = np.array([[f in r for f in every] for r in rows])

    def choice(j, out):
        best = sorted((at[f], min(1.0, z / toxicity.FULL_Z) ** 3) for f, z in naive_choice(rows, ys[j], folds, out).items())
        return np.array([i for i, _ in best]), np.array([v for _, v in best])

    weights, bias, links = toxicity.fit_chain(x, [np.array(y, np.float32) for y in ys], np.array(folds), choice)
    z = x @ weights + bias
    for j in range(1, 3):
        z[:, j] += toxicity.sigmoid(z[:, :j]) @ links[j, :j]
    want = toxicity.sigmoid(z)
    # Features of equal z at the last place may be others (sums in another order), so a few scores may differ slightly.
    far = [i for i in range(len(texts)) if np.abs(np.array(got[i]) - want[i]).max() > 1e-3]
    assert len(far) <= 3, far
    assert all((got[i][2] >= 0.5) == (want[i][2] >= 0.5) for i in range(len(texts)))


def test_labels_without_a_document_take_no_place_in_the_sample(spark):
    bad, good = "vile spleen rot", "calm river stone"
    df = spark.createDataFrame([(500 * i, f"{bad if i % 2 else good} {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.range(20_000).selectExpr("id as doc_id", "1 as quality", "cast(id div 500 % 2 as int) as toxic")
    chain = toxicity.fit(df, labels, per_class=20)
    got = {r.doc_id: r.is_toxic for r in toxicity.score(df, chain).collect()}
    assert got == {500 * i: i % 2 for i in range(40)}
