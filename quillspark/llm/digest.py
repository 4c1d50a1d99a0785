"""Improbable-feature digests (similarity digests of statistically rare byte windows).

Every window of WINDOW bytes gets its Shannon entropy, exactly, from the counts of its bytes. Its rank is the lower the
farther that entropy is from USUAL, which running text mostly has: an entropy is taken to be the less probable the farther
off it is, in either direction. The rule is the same for all texts, prose or not (in base64 or code most windows are far
off, and the farthest are chosen), so a text has one digest whatever corpus it is in. The lowest rank within REACH windows
to either side, the leftmost of equals, selects a window as feature, so features follow content and not offsets. Windows
of almost no entropy (runs of one byte) are never features. A 64-bit hash of each feature sets 5 bits in a Bloom filter of 2,048 bits; after 160 features the
chain goes on with a new filter. Repeats of a feature within a text count once.

Likeness of two digests: each filter of the shorter chain takes its best normalised overlap with the other's (common bits
above those expected by chance, over the most possible), and these are averaged by features. Equal digests have likeness 1.
Each filter meets each of the other text's: for two texts of 10 MB about 1,300 times 1,300 comparisons of 256 bytes.

In a text of less than SHORT_TEXT bytes too few windows are selected to outlast an edit, so every SHORT bytes of it (but runs
of one byte) are features besides: half of a text of 7 bytes or more that stays in the other is seen. Below that, and above
for texts on different sides of SHORT_TEXT that share no selected window, nothing in common is found unless texts are equal.

Null and empty texts have a digest without features, whose likeness is 1 to its equals and 0 to others. A text shorter than
a window, or without a selected window, has its whole as feature. Extra columns are ignored; an empty table gives an
empty result; rows of one doc_id follow each other in the order of their texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import batch_of, ordered_buckets, small_batches, text_or_empty

WINDOW = 32
REACH = 24
SHORT, SHORT_TEXT = 4, 256
FILTER_BYTES, HASHES, PER_FILTER = 256, 5, 160
BITS = 8 * FILTER_BYTES
#: Bytes of which the windows are computed at once.
CHUNK = 1 << 18
#: C log2 c scaled to integers, so sums are exact and don't depend on what else is in a batch.
_G = np.rint([0] + [c * np.log2(c) * 4096 for c in range(1, WINDOW + 1)]).astype(np.int32)
_UP = np.append(_G[1:] - _G[:-1], 0).astype(np.int32)
#: Entropy in 1/32 bit of a window; running text has about USUAL of them, in each direction it gets rarer.
USUAL, LEAST = 122, 40
_MIX = np.uint64(0x9E3779B97F4A7C15)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy in 1/32 bit of every window of data: from one window to the next one byte leaves and one enters."""
    n = len(data) - WINDOW + 1
    ahead, behind = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for lag in range(1, WINDOW):
        same = (data[:-lag] == data[lag:]).view(np.uint8)
        ahead[:-lag] += same  # equal bytes among the next 31
        behind[lag:] += same  # equal bytes among the last 31
    total = np.empty(n, np.int64)
    total[0] = _G[np.bincount(data[:WINDOW], minlength=256)].sum()
    # Leaves: a byte with `ahead` equals in the rest of its window; enters: one with `behind` equals before it.
    total[1:] = _UP[behind[WINDOW:]].astype(np.int64) - _UP[ahead[: n - 1]]
    np.cumsum(total, out=total)
    return np.rint((np.log2(WINDOW) - total / (4096.0 * WINDOW)) * 32).astype(np.int32)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sliding_min(x: np.ndarray, reach: int) -> np.ndarray:
    """Least of x[i], ..., x[i + reach - 1]."""
    width = 1
    while width < reach:
        step = min(width, reach - width)
        x = np.minimum(x[: len(x) - step], x[step:])
        width += step
    return x


def select(texts: list[bytes]) -> list[np.ndarray]:
    """Feature hashes of each text in order of their place. Texts are joined into chunks; no window crosses two texts."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= CHUNK:
            size += len(texts[end])
            end += 1
        # A gap between texts: windows that touch it have rank "never", so that each text is treated as if alone.
        lengths = [len(t) for t in texts[at:end]]
        if max(lengths) >= WINDOW:
            data = np.frombuffer(b"".join(texts[at:end]), np.uint8)
            starts = np.cumsum([0, *lengths[:-1]])
            for k, found in enumerate(_select_joined(data, starts, np.array(lengths))):
                out[at + k] = found
        at = end
    for k, t in enumerate(texts):
        if len(t) and not len(out[k]):
            out[k] = np.frombuffer(hashlib.blake2b(t, digest_size=8).digest(), "<u8")
        if SHORT <= len(t) < SHORT_TEXT:
            out[k] = np.concatenate([out[k], short_features(t)])
    return out


def short_features(text: bytes) -> np.ndarray:
    """Hashes of all windows of SHORT bytes that aren't runs of one byte."""
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), SHORT)
    windows = windows[(windows != windows[:, :1]).any(axis=1)]
    return mix(mix(np.ascontiguousarray(windows).view("<u4")[:, 0].astype(np.uint64) + _MIX))


def _select_joined(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    h = entropies(data)
    own = np.zeros(len(h), bool)  # windows inside one text
    for s, n in zip(starts, lengths, strict=True):
        own[s : max(s, s + n - WINDOW + 1)] = True
    rank = np.where(h < LEAST, 30000, 1000 - np.abs(h - USUAL)).astype(np.int16)
    rank[~own] = 32000
    # Windows of other texts are at least WINDOW > REACH foreign windows away, so they never shadow each other.
    pad = np.full(REACH, 32000, np.int16)
    low = sliding_min(np.concatenate([pad, rank, pad]), REACH)
    chosen = np.flatnonzero(own & (h >= LEAST) & (rank < low[: len(rank)]) & (rank <= low[REACH + 1 :][: len(rank)]))
    # Hash the chosen windows alone.
    words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[chosen].astype(np.uint8).copy().view("<u8")
    code = np.zeros(len(chosen), np.uint64)
    for j in range(WINDOW // 8):
        code = mix((code ^ words[:, j]) + _MIX)
    bounds = np.searchsorted(chosen, np.append(starts, len(data)))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield code[a:b]


def build(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chained Bloom filters (k x FILTER_BYTES) and the features in each; a repeated feature counts at its first place."""
    if not len(features):
        return np.zeros((0, FILTER_BYTES), np.uint8), np.zeros(0, np.int64)
    _, first = np.unique(features, return_index=True)
    features = features[np.sort(first)]
    k = -(-len(features) // PER_FILTER)
    where = np.arange(len(features)) // PER_FILTER
    bits = np.zeros((k, BITS), np.uint8)
    for i in range(HASHES):
        bits[where, (features >> np.uint64(11 * i)).astype(np.int64) & (BITS - 1)] = 1
    return np.packbits(bits, axis=1), np.bincount(where, minlength=k)


Digest = tuple[np.ndarray, np.ndarray]


def text_form(d: Digest) -> str:
    """version:window:filter bytes:hashes:features a filter:features:filters in base64"""
    return f"ifd2:{WINDOW}:{FILTER_BYTES}:{HASHES}:{PER_FILTER}:{int(d[1].sum())}:" + base64.b64encode(d[0].tobytes()).decode()


def from_text(form: str) -> Digest:
    *_, n, filters = form.split(":")
    raw = np.frombuffer(base64.b64decode(filters), np.uint8).reshape(-1, FILTER_BYTES)
    counts = np.full(len(raw), PER_FILTER)
    if len(raw):
        counts[-1] = int(n) - PER_FILTER * (len(raw) - 1)
    return raw, counts


def likeness(x: Digest, y: Digest) -> float:
    """Normalised bit overlap of two digests, 0 to 1."""
    if x[0].shape == y[0].shape and np.array_equal(x[0], y[0]):
        return 1.0
    if not len(x[0]) or not len(y[0]):
        return 0.0
    if len(x[0]) > len(y[0]) or (len(x[0]) == len(y[0]) and int(x[1].sum()) > int(y[1].sum())):
        x, y = y, x
    a, b = x[0].view("<u8"), y[0].view("<u8")
    na, nb = np.bitwise_count(a).sum(1).astype(float), np.bitwise_count(b).sum(1).astype(float)
    best = np.zeros(len(a))
    for i in range(len(a)):
        common = np.bitwise_count(a[i] & b).sum(1)
        chance, most = na[i] * nb / BITS, np.minimum(na[i], nb)
        best[i] = (np.clip(common - chance, 0, None) / np.maximum(most - chance, 1)).max()
    return float(min(1.0, (best * x[1]).sum() / x[1].sum()))


def digests(texts: list[str]) -> list[Digest]:
    return [build(f) for f in select([t.encode("utf-8", "surrogatepass") for t in texts])]


def fingerprint(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and fingerprint of each whole text. No shuffle."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of(schema, [b.column(0), [text_form(d) for d in digests(b.column(1).to_pylist())]])

    return docs.select(F.col(f"`{key}`").cast("long"), text_or_empty(text)).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points give way to the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


NEIGHBOURS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
NEIGHBOURS_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbour_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each text's digest, that of its edited form, and its likeness to this and to the next text by descending doc_id.

    Rows are dealt to ordered buckets of doc_id by one shuffle; a bucket's first row goes to the bucket above it as well, so
    every row finds its next one in its own task. Rows without a doc_id come last.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), text_or_empty(text).alias("t"))
    bucket, n = ordered_buckets(rows, "id", F.octet_length("t"))
    rows = rows.withColumn("bucket", bucket)
    # One row for each bucket: the largest key, and the text's digest for ties. Empty buckets have none.
    heads = sorted(rows.groupBy("bucket").agg(F.max("id").alias("id")).collect(), key=lambda r: r.bucket)
    above = [(a.bucket, b.bucket, a.id) for a, b in zip(heads, [*heads[1:], *heads[:1]], strict=True)]
    # As many short rows as there are buckets, 100,000 at most.
    lifts = docs.sparkSession.createDataFrame(above, "bucket int, up int, top long")
    rows = rows.join(F.broadcast(lifts), "bucket", "left")
    lift = F.when(F.col("id").eqNullSafe(F.col("top")), F.col("up"))
    both = F.array_compact(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("extra")), F.when(lift.isNotNull(), F.struct(lift.alias("b"), F.lit(1).alias("extra")))))
    dealt = rows.select("id", "t", F.explode(both).alias("to")).select("id", "t", "to.b", "to.extra")
    dealt = dealt.repartitionById(n, F.col("b")).sortWithinPartitions(F.col("b"), F.col("extra"), F.col("id").desc_nulls_last(), F.col("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before, which waits for its next one

        def report(rows: list[tuple]) -> pa.RecordBatch:
            """rows: (id, text, digest, next text, next digest)"""
            changed = [edited(r[1], r[3]) for r in rows]
            new = digests(changed)
            sha = [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]
            near = [(likeness(r[2], d), likeness(r[2], r[4])) for r, d in zip(rows, new, strict=True)]
            return batch_of(NEIGHBOURS, [[r[0] for r in rows], [len(r[1]) for r in rows], sha, [text_form(r[2]) for r in rows], [text_form(d) for d in new], [a for a, _ in near], [b for _, b in near]])

        for b in batches:
            at = 0
            texts = b.column(1).to_pylist()
            size = 0
            for end, t in enumerate(texts, 1):
                size += len(t)
                if size < CHUNK and end < len(texts):
                    continue
                own = digests(texts[at:end])
                ready = []
                for i, d in zip(range(at, end), own, strict=True):
                    now = (b.column(0)[i].as_py(), texts[i], d, b.column(2)[i].as_py(), b.column(3)[i].as_py())
                    # A row that came from another bucket closes this one; further ones (ties) have nothing to close.
                    if held and held[3] == now[3] and not held[4]:
                        ready.append((held[0], held[1], held[2], now[1], now[2]))
                    held = now
                if ready:
                    yield report(ready)
                at, size = end, 0

    return dealt.mapInArrow(run, NEIGHBOURS_DDL)
