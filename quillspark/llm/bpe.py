"""Byte-level BPE encoding and decoding with a contiguous rank array.

A pre-token is held as contiguous arrays: the boundaries of its parts, the merge ranks of adjacent parts and, beside each
boundary, the id of the part that begins there. The encoder scans the ranks for the minimum, deletes the boundary between
the two parts and refreshes the two neighbouring ranks, until no merge is left. That is the fastest form for short words;
pre-tokens of more than LONG_WORD bytes, for which repeated scans would be quadratic, take a heap with the same order of
merges. Words are remembered per Python process in two generations that are bounded in words and in bytes, so memory
doesn't grow with the corpus.

Words are cut where the tokenizer file's own pre-tokenizer cuts them: a code point that the regex package puts into another
class stands as a character of the library's class while a text is split.

Null and empty texts give no ids. Added special tokens inside a text are single ids, as in the tokenizers library. Texts of any
length are encoded whole; Arrow batches are bounded in bytes, so that only a text that is itself longer makes a larger one.
Rows are independent: repeated rows and extra columns change nothing, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from struct import pack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import batch_of, bounded_batches, text_or_empty

#: Fixed value: the public split pattern of byte-level BPE, whose branches are tried in this order.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: From so many parts on a heap replaces the repeated scans.
LONG_WORD = 128
#: Words and bytes (of words and values, with ENTRY_BYTES for each) in one generation of the cache.
CACHE_WORDS, CACHE_BYTES, ENTRY_BYTES = 250_000, 64 << 20, 150
NO_RANK = 1 << 40


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


#: Texts up to this code point are split by character classes, which is twice as fast as by Unicode properties.
NARROW = 0x24F
#: Fixed value: white space of Unicode up to NARROW, as a character class.
SPACE = r"\t-\r \x85\xa0"


def narrow_class(category: str) -> str:
    """A character class of all characters up to NARROW in a general category (L or N)."""
    of = [unicodedata.category(chr(c))[0] == category for c in range(NARROW + 1)] + [False]
    edges = [c for c in range(1, NARROW + 2) if of[c] != of[c - 1]]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in zip(edges[::2], edges[1::2], strict=True))


def narrow_split():
    """SPLIT for texts up to NARROW; its branches begin with different characters, so their order is free."""
    letters, digits = narrow_class("L"), narrow_class("N")
    return re.compile(rf" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{digits}]+| ?[^{SPACE}{letters}{digits}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall


def classes_of(begins) -> list[tuple[int, int, str]]:
    """Ranges (first, last, L, N, S or O) of all code points as a pre-tokenizer of pattern SPLIT tells letters, numbers, white
    space and other characters apart. begins(text): how many pieces it cuts a text into. Ranges are halved until they are of one class."""
    out: list[tuple[int, int, str]] = []

    def go(low: int, high: int) -> None:
        block = "".join(chr(c) for c in range(low, high) if not 0xD800 <= c < 0xE000)
        if not block:
            return
        kind = next((k for k, first in (("O", "!"), ("L", "a"), ("N", "1")) if begins(first + block) == 1), "S" if high - low == 1 else None)
        if kind is None:
            go(low, (low + high) // 2)
            go((low + high) // 2, high)
        elif out and out[-1][1] == low - 1 and out[-1][2] == kind:
            out[-1] = (out[-1][0], high - 1, kind)
        else:
            out.append((low, high - 1, kind))

    for low in range(0, 0x110000, 4096):
        go(low, low + 4096)
    return out


@lru_cache(4)
def odd_characters(path: str) -> tuple[tuple[int, int, str], ...]:
    """Ranges (first, last, class) of the code points that the regex package puts into another class than the tokenizer
    file's own pre-tokenizer does in the tokenizers library; they follow different versions of Unicode."""
    import regex
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    split = regex.compile(SPLIT).findall
    ours = [k for first, last, k in classes_of(lambda t: len(split(t))) for _ in range(first, last + 1) if first < 0xD800 or first >= 0xE000]
    theirs = [k for first, last, k in classes_of(lambda t: len(cut(t))) for _ in range(first, last + 1) if first < 0xD800 or first >= 0xE000]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    out: list[tuple[int, int, str]] = []
    for c, mine, kind in zip(points, ours, theirs, strict=True):
        if mine != kind:
            if out and out[-1][1] == c - 1 and out[-1][2] == kind:
                out[-1] = (out[-1][0], c, kind)
            else:
                out.append((c, c, kind))
    return tuple(out)


#: A character of each class in the split pattern that is in no contraction.
STAND_IN = {"L": "a", "N": "1", "S": "\u3000", "O": "!"}


class WordCache(dict):
    """Two generations of word -> value: when the young one is full it becomes the old one, which is dropped."""

    def __init__(self, compute, most: int = CACHE_WORDS, most_bytes: int = CACHE_BYTES):
        super().__init__()
        self.compute, self.most, self.most_bytes, self.bytes, self.old = compute, most, most_bytes, 0, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        size = 4 * len(word) + len(value) + ENTRY_BYTES  # a character takes up to 4 bytes
        if 16 * size > self.most_bytes:
            return value
        if len(self) >= self.most or self.bytes + size > self.most_bytes:
            self.old, self.bytes = dict(self), 0
            self.clear()
        self.bytes += size
        self[word] = value
        return value


class ByteBPE:
    """Encoder and decoder for a tokenizer file of kind BPE with a byte-level pre-tokenizer and decoder."""

    def __init__(self, path: str, odd: tuple[tuple[int, int, str], ...] | None = None):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        to_byte = {c: b for b, c in enumerate(alphabet)}
        vocab: dict[str, int] = model["vocab"]
        self.byte_ids = [vocab[c] for c in alphabet]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left] << 32 | vocab[right]] = (rank, vocab[left + right])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        top = max([*vocab.values(), *self.added.values()])
        self.pieces: list[bytes] = [b""] * (top + 1)
        for token, i in vocab.items():
            self.pieces[i] = bytes(to_byte[c] for c in token)
        for token, i in self.added.items():
            self.pieces[i] = token.encode()
        pattern = regex.compile(SPLIT)
        self.split_any, self.spans, self.split_narrow = pattern.findall, pattern.finditer, narrow_split()
        self.stand_in = {c: STAND_IN[k] for first, last, k in (odd_characters(path) if odd is None else odd) for c in range(first, last + 1)}
        self.odd = frozenset(map(chr, self.stand_in))
        self.wide = re.compile(rf"[^\x00-{chr(NARROW)}]").search
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.cache = WordCache(lambda word: pack(f"<{len(ids := self.encode_word(word.encode()))}I", *ids))

    def split(self, text: str) -> list[str]:
        if not self.wide(text):
            return self.split_narrow(text)
        if self.odd.isdisjoint(text):
            return self.split_any(text)
        return [text[m.start() : m.end()] for m in self.spans(text.translate(self.stand_in))]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        return self.parts(word)[1]

    def parts(self, word: bytes) -> tuple[list[int], list[int]]:
        """Where the parts of a pre-token begin, with its length at the end, and their ids."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > LONG_WORD:
            ids = self._encode_long(ids)
            return [0, *accumulate(len(self.pieces[i]) for i in ids)], ids
        bounds = list(range(len(ids) + 1))
        merges, none = self.merges, (NO_RANK, 0)
        found = [merges.get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        ranks = [r for r, _ in found]
        made = [m for _, m in found]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)  # the leftmost of the lowest
            ids[i] = made[i]
            del bounds[i + 1], ids[i + 1], ranks[i], made[i]
            if i < len(ranks):
                ranks[i], made[i] = merges.get(ids[i] << 32 | ids[i + 1], none)
            if i:
                ranks[i - 1], made[i - 1] = merges.get(ids[i - 1] << 32 | ids[i], none)
        return bounds, ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get(ids[i] << 32 | ids[i + 1]))]
        heap = [(r, i, made, a, b) for r, made, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two parts has been merged meanwhile
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(made << 32 | ids[k]):
                    heapq.heappush(heap, (m[0], i, m[1], made, ids[k]))
            if (h := before[i]) >= 0 and (m := merges.get(ids[h] << 32 | made)):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], made))
        return [x for x in ids if x >= 0]

    def encode_bytes(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        if not self.special or not (hits := list(self.special.finditer(text))):
            return self.encode_plain_bytes(text)
        out, at = [], 0
        for hit in hits:
            out += map(self.cache.__getitem__, self.split(text[at : hit.start()]))
            out.append(pack("<I", self.added[hit[0]]))
            at = hit.end()
        out += map(self.cache.__getitem__, self.split(text[at:]))
        return b"".join(out)

    def encode_plain_bytes(self, text: str) -> bytes:
        """As encode_bytes, but the strings of added tokens are ordinary text."""
        return b"".join(map(self.cache.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_bytes(text)).cast("I").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        """The text of packed ids in UTF-8; byte sequences that aren't UTF-8 become U+FFFD."""
        raw = b"".join(map(self.pieces.__getitem__, memoryview(ids).cast("I")))
        return raw.decode("utf-8", "replace").encode()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(pack(f"<{len(ids)}I", *ids)).decode()


@lru_cache(2)
def tokenizer(path: str, odd: tuple[tuple[int, int, str], ...] | None = None) -> ByteBPE:
    return ByteBPE(path, odd)


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and `ids`, the ids of each whole text as an array of int. The file must lie at the same path on every machine."""
    bounded_batches(docs.sparkSession)
    odd = odd_characters(tokenizer_path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path, odd)
        for b in batches:
            yield batch_of(schema, [b.column(0), [bpe.encode(t) for t in b.column(1).to_pylist()]])

    return docs.select(F.col(f"`{key}`").cast("long"), text_or_empty(text)).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and `text` from what encode_documents gives."""
    bounded_batches(encoded.sparkSession)
    odd = odd_characters(tokenizer_path)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path, odd)
        for b in batches:
            yield batch_of(schema, [b.column(0), [bpe.decode(x or []) for x in b.column(1).to_pylist()]])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text that decoding those ids gives. No shuffle."""
    bounded_batches(docs.sparkSession)
    odd = odd_characters(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = tokenizer(tokenizer_path, odd), hashlib.sha256
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                ids = bpe.encode_bytes(t)
                n.append(len(ids) // 4)
                ids_sha.append(sha(ids).hexdigest())
                text_sha.append(sha(bpe.decode_bytes(ids)).hexdigest())
            yield batch_of(OUT, [b.column(0), n, ids_sha, text_sha])

    return docs.select(F.col(f"`{key}`").cast("long"), text_or_empty(text)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
