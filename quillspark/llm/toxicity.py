"""Toxicity by a classifier chain of linear models.

Features say whether a document holds a word, or words that begin with given 4, 5 or 7 bytes: any at all, or at least
0.4, 1 or 3 percent of its words. A bounded sample of labelled documents (`per_class` toxic and as many others, in the
order of a hash of doc_id) trains the chain. The categories are predicted one after the other by logistic regression:
each later model also gets the earlier categories' probabilities, in training those that models predicted for folds they
hadn't seen. Each model, those of the folds too, chooses its own `features` from the documents that it is trained on:
the ones whose log odds ratio is largest in standard errors. A feature of z standard errors enters with the value
min(1, z / FULL_Z) ** 3 in place of 1, so the penalty shrinks what a few documents alone support.

Null and empty texts have no features and get the intercepts' probabilities. A category with one class alone in the
sample has that class's share as a constant. Labels without a document are ignored; without labels nothing is toxic.
Repeated labels of one doc_id count once, with the largest marks; repeated documents of one doc_id are one of the
sample, with the largest text, and each of their rows is scored. Features of equal z are taken in the order of kind and
token, so equal tables give equal models. Texts of any length are read whole; the work is in proportion to their words.
An empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quillspark.llm.common import batch_of, discard, small_batches, stored, text_or_empty, with_document

PER_CLASS = 3000
FEATURES = 600
LEAST_DOCS = 2
#: Standard errors from which on a feature enters with its full value.
FULL_Z = 3.0
FOLDS = 5
THRESHOLD = 0.5
#: The chain of the registered query, in order: name -> condition on a row of labels.
CATEGORIES = {"toxic_prose": "toxic = 1 and quality = 1", "toxic_junk": "toxic = 1 and quality = 0", "toxic": "toxic = 1"}

#: Bytes to bytes: A-Z to small letters, other ASCII that is no letter or digit to a space.
TABLE = bytes(b + 32 if 65 <= b < 91 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))

#: Lengths of beginnings in bytes, and the shares of a document's words that they must reach.
BEGINNINGS = (4, 5, 7)
SHARES = (0.0, 0.004, 0.01, 0.03)
KINDS = 1 + len(BEGINNINGS) * len(SHARES)


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def tokens(text: str) -> list[set[bytes]]:
    """Distinct words, then for each length and share the beginnings of so many of the words."""
    words = split(text)
    times = Counter(words)
    out = [set(times)]
    for n in BEGINNINGS:
        begins: Counter[bytes] = Counter()
        for w, k in times.items():
            if len(w) >= n:
                begins[w[:n]] += k
        out += [{b for b, k in begins.items() if k >= share * len(words)} for share in SHARES]
    return out


@dataclass
class Chain:
    names: list[str]
    vocab: list[dict] = field(default_factory=lambda: [{} for _ in range(KINDS)])
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # features x categories
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    links: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # later x earlier

    def __post_init__(self):
        # For each length, the chosen beginnings with their shares and features.
        self.begins: list[tuple[int, dict[bytes, list[tuple[float, int]]]]] = []
        for n, first in zip(BEGINNINGS, range(1, KINDS, len(SHARES)), strict=True):
            known: dict[bytes, list[tuple[float, int]]] = {}
            for share, features in zip(SHARES, self.vocab[first : first + len(SHARES)], strict=True):
                for b, i in features.items():
                    known.setdefault(b, []).append((share, i))
            self.begins.append((n, known))

    def indices(self, text: str) -> list[int]:
        """The features of tokens(text) that the chain uses, without listing the others."""
        words = split(text)
        times = Counter(words)
        out = [self.vocab[0][w] for w in self.vocab[0].keys() & times.keys()]
        for n, known in self.begins:
            found: dict[bytes, int] = {}
            for w, k in times.items():
                if (b := w[:n]) in known:
                    found[b] = found.get(b, 0) + k
            out += [i for b, k in found.items() for share, i in known[b] if k >= share * len(words)]
        return out

    def probabilities(self, texts: list[str]) -> np.ndarray:
        if not len(self.bias):
            return np.zeros((len(texts), len(self.names)))
        z = np.empty((len(texts), len(self.names)))
        for i, t in enumerate(texts):
            z[i] = self.weights[sorted(self.indices(t))].sum(0) + self.bias
        for j in range(1, z.shape[1]):
            z[:, j] += sigmoid(z[:, :j]) @ self.links[j, :j]
        return sigmoid(z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 150) -> np.ndarray:
    """Weights and, last, the bias of an L2-penalised logistic regression by accelerated gradient steps."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w = np.zeros(x.shape[1] + 1, np.float32)
    w[-1] = np.log(share / (1 - share))
    if y.min() == y.max():
        return w
    v = np.random.default_rng(3).standard_normal(x.shape[1]).astype(np.float32)
    for _ in range(8):  # largest eigenvalue, for the step length
        v = x.T @ (x @ (v / np.linalg.norm(v)))
    step, ahead = 1 / (0.25 * (np.linalg.norm(v) + len(y)) + penalty), w.copy()
    for t in range(rounds):
        z = x @ ahead[:-1] + ahead[-1]
        d = sigmoid(z) - y
        g = np.append(x.T @ d + penalty * ahead[:-1], d.sum()).astype(np.float32)
        new = ahead - step * g
        ahead, w = new + t / (t + 3) * (new - w), new
    return w


#: Columns and their values for the model of a category (by number) that doesn't see a fold (None: sees all).
Choice = Callable[[int, int | None], tuple[np.ndarray, np.ndarray]]


def fit_chain(x: np.ndarray, ys: list[np.ndarray], folds: np.ndarray, choice: Choice | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """weights, bias, links of a chain over the columns ys; folds: the fold of each row, choice: all columns if None."""
    k = len(ys)
    weights, bias, links = np.zeros((x.shape[1], k)), np.zeros(k), np.zeros((k, k))
    earlier = np.zeros((len(x), 0), np.float32)
    choice = choice or (lambda j, fold: (np.arange(x.shape[1]), np.ones(x.shape[1])))

    def inputs(j: int, fold: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns, values = choice(j, fold)
        return columns, values, np.ascontiguousarray(np.hstack([x[:, columns] * values.astype(np.float32), earlier]))

    for j, y in enumerate(ys):
        columns, values, full = inputs(j, None)
        w = logistic(full, y)
        weights[columns, j], links[j, :j], bias[j] = w[: len(columns)] * values, w[len(columns) : -1], w[-1]
        unseen = np.zeros(len(x), np.float32)
        if j + 1 < k:
            for f in np.unique(folds):
                own = folds == f
                *_, full = inputs(j, int(f))
                wf = logistic(full[~own], y[~own]) if (~own).any() else w
                unseen[own] = full[own] @ wf[:-1] + wf[-1] if (~own).any() else bias[j]
        earlier = np.hstack([earlier, sigmoid(unseen)[:, None]])
    return weights, bias, links


def chosen_features(counted: DataFrame, totals: Row, k: int, features: int, least: int = LEAST_DOCS) -> list[Row]:
    """kind, token, model, z of the features of each model: 'j' for category j, 'j-f' for category j without fold f.

    counted and totals have n<f> and a<j>_<f>: documents of fold f with the token (in all), and how many are of category j.
    At most `features` rows for each of the k * (FOLDS + 1) models are returned.
    """
    models = []
    for j in range(k):
        for out in (None, *(range(FOLDS) if j + 1 < k else ())):
            seen = [f for f in range(FOLDS) if f != out]
            n, p = sum(totals[f"n{f}"] or 0 for f in seen), sum(totals[f"a{j}_{f}"] or 0 for f in seen)
            m, a = sum((F.col(f"n{f}") for f in seen), F.lit(0)), sum((F.col(f"a{j}_{f}") for f in seen), F.lit(0))
            b = m - a
            odds = F.log((a + 0.5) * (n - p - b + 0.5) / ((b + 0.5) * (p - a + 0.5)))
            error = F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (p - a + 0.5) + 1 / (n - p - b + 0.5))
            name = str(j) if out is None else f"{j}-{out}"
            models.append(F.when(m >= least, F.struct(F.lit(name).alias("model"), F.abs(odds / error).alias("z"))))
    each = counted.select("kind", "token", F.explode(F.array_compact(F.array(*models))).alias("s")).select("kind", "token", "s.model", "s.z").filter("z > 0")
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.col("z").desc(), "kind", "token"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= features).drop("rank").collect()


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, stratum: str = "toxic", per_class: int = PER_CLASS, features: int = FEATURES, text: str = "text", key: str = "doc_id", use: Column | None = None) -> Chain:
    """Fit on a bounded sample; stratum: the category whose two classes the sample balances."""
    spark, names = docs.sparkSession, list(categories)
    small_batches(spark)
    k = len(names)
    marks = [F.coalesce(F.expr(c), F.lit(False)).cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())]
    rows = labels.select(F.col(f"`{key}`").cast("long").alias("id"), *marks).filter("id is not null").filter(use if use is not None else F.lit(True))
    # Labels without a document go before the limit, so they take no other's place.
    rows = with_document(rows, docs, key).groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(k)])
    s = f"y{names.index(stratum)}"
    picks = [rows.filter(F.col(s) == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    picked = F.broadcast(picks[0].unionAll(picks[1]))  # at most 2 * per_class short rows
    found = docs.select(F.col(f"`{key}`").cast("long").alias("id"), text_or_empty(text).alias("t")).join(picked, "id")
    sample = found.groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(k)], F.max("t").alias("t"))
    sample = stored(sample.withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int")), "toxic-sample")

    ys = [f"y{i}" for i in range(k)]
    sums = [F.count_if(F.col("fold") == f).alias(f"n{f}") for f in range(FOLDS)]
    sums += [F.sum(F.when(F.col("fold") == f, F.col(ys[j])).otherwise(0)).alias(f"a{j}_{f}") for j in range(k) for f in range(FOLDS)]
    totals = sample.agg(*sums, F.count(F.lit(1)).alias("n"), F.sum(s).alias("p")).first()
    if not totals.n or not totals.p or totals.p == totals.n:
        discard(sample)
        return Chain(names)

    schema = pa.schema([("kind", pa.int32()), ("token", pa.binary()), ("fold", pa.int32()), *[(y, pa.int32()) for y in ys]])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, *marks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kinds = [list(found) for found in tokens(t)]
                n = sum(map(len, kinds))
                yield batch_of(schema, [[i for i, found in enumerate(kinds) for _ in found], [w for found in kinds for w in found], *([m] * n for m in marks)])

    listed = sample.select("t", "fold", *ys).mapInArrow(explode, "kind int, token binary, fold int, " + ", ".join(f"{y} int" for y in ys))
    counted = listed.groupBy("kind", "token").agg(*sums, F.count(F.lit(1)).alias("m")).filter(F.col("m") >= LEAST_DOCS)
    best = chosen_features(counted, totals, k, features)
    vocab: list[dict] = [{} for _ in range(KINDS)]
    models: dict[str, list[tuple[int, float]]] = {}
    numbers = {key: i for i, key in enumerate(sorted({(r.kind, bytes(r.token)) for r in best}))}
    for (kind, token), i in numbers.items():
        vocab[kind][token] = i
    for r in best:
        models.setdefault(r.model, []).append((numbers[r.kind, bytes(r.token)], min(1.0, r.z / FULL_Z) ** 3))

    def choice(j: int, fold: int | None) -> tuple[np.ndarray, np.ndarray]:
        found = sorted(models.get(str(j) if fold is None else f"{j}-{fold}", []))
        return np.array([i for i, _ in found], np.int64), np.array([v for _, v in found])

    chain = Chain(names, vocab)
    ix_schema = pa.schema([("id", pa.int64()), ("ix", pa.list_(pa.int32()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of(ix_schema, [b.column(0), [sorted(chain.indices(t)) for t in b.column(1).to_pylist()]])

    of = {r.id: r for r in sample.drop("t").collect()}
    rows = sorted(sample.select("id", "t").mapInArrow(index, "id long, ix array<int>").collect(), key=lambda r: r.id)
    discard(sample)
    x = np.zeros((len(rows), len(numbers)), np.bool_)
    for i, r in enumerate(rows):
        x[i, r.ix] = True
    targets = [np.array([of[r.id][y] for r in rows], np.float32) for y in ys]
    weights, bias, links = fit_chain(x, targets, np.array([of[r.id].fold for r in rows]), choice)
    # What no model of a whole category uses needn't be looked up.
    used = {i: n for n, i in enumerate(np.flatnonzero(weights.any(axis=1)).tolist())}
    vocab = [{t: used[i] for t, i in d.items() if i in used} for d in vocab]
    return Chain(names, vocab, weights[list(used)], bias, links)


def score(docs: DataFrame, chain: Chain, text: str = "text", key: str = "doc_id", decide: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a probability p_<category> for each category of the chain, and is_toxic (0 or 1)."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *[(f"p_{n}", pa.float64()) for n in chain.names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = chain.probabilities(b.column(1).to_pylist())
            yield batch_of(schema, [b.column(0), *[pa.array(p[:, j]) for j in range(p.shape[1])]])

    out = docs.select(F.col(f"`{key}`").cast("long"), text_or_empty(text)).mapInArrow(run, "doc_id long, " + ", ".join(f"p_{n} double" for n in chain.names))
    return out.withColumn("is_toxic", (F.col(f"p_{decide}") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, chain: Chain, text: str = "text", decide: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs below the threshold, all columns as they are."""
    small_batches(docs.sparkSession)
    at = chain.names.index(decide)

    @F.pandas_udf("double")
    def p(texts):
        import pandas as pd

        return pd.Series(chain.probabilities(texts.tolist())[:, at])

    return docs.filter(p(text_or_empty(text)) < threshold)


