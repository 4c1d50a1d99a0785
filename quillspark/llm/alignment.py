"""Alignment of two tokenizers' tokens over the same bytes.

Python only tokenises: for each document it gives the ids of both tokenizers and the byte offsets at which their tokens end.
Everything after it is Spark: the ends that both have (array_intersect) cut the bytes into groups; the two tokens that end
at such a place are a link. A token entry has its end in the high bits and its id below, so sorting the entries of a side
together with marks made of the cuts (two ascending runs) puts a mark behind the last token of each group, and no step looks a
place up by search: work is linear in the tokens, also for very long texts.

An id pair's count is the number of links in the corpus that hold it. Counts of pairs are added in each task first. For the
way back each link meets its pair's count: pairs that make up at least one link in HOT_PAIRS are at most HOT_PAIRS many and are
broadcast; any other pair has less than that share of the links, so these are joined by a shuffle without a hot key. Where all
pairs are fewer than HOT_PAIRS, all are broadcast. The largest count of an id of the second tokenizer is one row for each id of
its vocabulary, which bounds that broadcast.

The first tokenizer is byte-level BPE and gets a space and the text; the second is a sentencepiece model, which adds the space
itself. Words are encoded once and remembered, whole texts where that is faster. Null and empty texts, and texts whose joined token bytes differ from space and text on either side, have
no tokens: zeros and an empty group text. Rows are documents of their own, whatever their doc_ids (repeated rows count as
often as they are there, null doc_ids stay null). Texts of any length are tokenised whole. An empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bpe
from quillspark.llm.common import batch_of, bounded_batches, slices, stored, text_or_empty

#: At most so many id pairs are broadcast.
HOT_PAIRS = 1 << 20

#: Bits of a token entry below its end: an id of up to 17 bits, and the mark of a cut.
ID_BITS = 18
MARK = 1 << (ID_BITS - 1)


class Words(dict):
    """Packed ids of words. Those that a slice of texts lacks are encoded together; a full table starts anew."""

    def __init__(self, encode, most: int = 150_000):
        super().__init__()
        self.encode, self.most = encode, most

    def learn(self, words: Iterable[str]) -> None:
        if len(self) > self.most:
            self.clear()
        new = [w for w in set(words) if w not in self]
        self.update(zip(new, self.encode(new), strict=True))

    def ids(self, words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<i4")


class ByteTokenizer:
    """A tokenizer file of byte-level BPE. Texts up to U+024F go to tiktoken as a whole, where ids follow the order of merges;
    in others each word that the file's own pre-tokenizer cuts off goes to the model of the tokenizers library."""

    def __init__(self, path: str, odd: tuple[tuple[int, int, str], ...] | None = None):
        self.path, self.odd, self.byte = path, odd, {c: b for b, c in enumerate(bpe.byte_alphabet())}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pieces = {bytes(self.byte[c] for c in token): i for token, i in vocab.items()}
        self.lengths = np.zeros(max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1, np.int64)
        self.lengths[list(pieces.values())] = [len(p) for p in pieces]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        self.wide = re.compile(rf"[^\x00-{chr(bpe.NARROW)}]").search
        self.whole = None
        if all(a < b for a, b in zip(made, made[1:], strict=False)) and max(vocab[c] for c in self.byte) < made[0]:
            import tiktoken

            encoding = tiktoken.Encoding("file", pat_str=bpe.SPLIT, mergeable_ranks=pieces, special_tokens={})
            self.whole = partial(encoding.encode_to_numpy, disallowed_special=())

    @cached_property
    def words(self) -> Words:
        from tokenizers import Tokenizer

        model, alphabet = Tokenizer.from_file(self.path).model, bpe.byte_alphabet()

        def ids(word: str) -> bytes:
            # Byte-level tokens of a word are its bytes, whatever the word.
            return array("I", [t.id for t in model.tokenize("".join([alphabet[b] for b in word.encode()]))]).tobytes()

        return Words(lambda new: map(ids, new))

    @cached_property
    def split(self):
        return bpe.ByteBPE(self.path, self.odd).split

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of a space and each text."""
        out = {i: self.whole(" " + t).astype(np.int32) for i, t in enumerate(texts) if self.whole and not self.wide(t)}
        units = {i: self.split(" " + t) for i, t in enumerate(texts) if i not in out}
        return [out[i] if i in out else x for i, x in zip(range(len(texts)), self._by_words(units, len(texts)), strict=True)]

    def _by_words(self, units: dict[int, list[str]], n: int) -> Iterator[np.ndarray]:
        if units:
            self.words.learn(chain.from_iterable(units.values()))
        return (self.words.ids(units[i]) if i in units else np.zeros(0, np.int32) for i in range(n))


class PieceTokenizer:
    """A sentencepiece model that encodes the units of a text one by one.

    A unit is a run of spaces and characters of one of two kinds. One kind has ASCII characters that aren't letters, and all that
    stand beside one of them in a piece; no piece spans two units then, so no merge does. A unit inside a line gets a line
    break in front while it is encoded, as the model puts a space before what it is given; both are taken off again.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.pieces = [bytes([int(n[3:5], 16)]) if m.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        whole = [n for i, n in enumerate(names) if not m.is_byte(i) and not m.is_control(i) and not m.is_unknown(i)]
        marks = {chr(c) for c in range(128) if not chr(c).isalpha() and c != 32}
        while more := {x for n in whole for a, b in zip(n, n[1:], strict=False) if "▁" not in (a, b) and (a in marks) != (b in marks) for x in (a, b)} - marks:
            marks |= more
        self.before = m.encode("\n")
        apart = not any("▁" in n.lstrip("▁") or "\n" in n for n in whole) and not any(c.isascii() and c.isalpha() for c in marks)
        self.by_units = apart and self.before == m.encode("\na")[: len(self.before)] and m.encode("  a") != m.encode("a")
        kind = "".join(map(re.escape, sorted(marks)))
        self.find = re.compile(f" *[{kind}]+| *[^ {kind}]+| +").findall
        self.words = Words(self._encode)

    def _encode(self, units: list[str]) -> list[bytes]:
        """Packed ids of each unit; none for a unit whose tokens have other bytes than it has."""
        given = [u[1:] if u[0] == " " and len(u) > 1 else "\n" + u for u in units]
        out = []
        for u, ids in zip(units, self.model.encode(given, num_threads=1), strict=True):
            if u[0] != " " or u == " ":
                ids = ids[len(self.before) :]
            same = b"".join(map(self.pieces.__getitem__, ids)) == u.encode()
            out.append(array("I", ids).tobytes() if same else b"")
        return out

    def units(self, text: str) -> list[str]:
        # The model takes this character for a space, so a text that has it loses bytes in any case.
        return [] if "▁" in text else self.find(" " + text) if self.by_units else [" " + text]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        units = [self.units(t) for t in texts]
        self.words.learn(chain.from_iterable(units))
        return [self.words.ids(u) for u in units]


@lru_cache(2)
def tokenizers(byte_path: str, piece_path: str, odd: tuple[tuple[int, int, str], ...]) -> tuple[ByteTokenizer, PieceTokenizer]:
    return ByteTokenizer(byte_path, odd), PieceTokenizer(piece_path)


TOKENS = "doc_id long, a array<long>, a_end array<int>, b array<long>, b_end array<int>"


def tokenise(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id; of the tokens of both tokenizers the entries (end times 2^ID_BITS plus id) and byte ends, empty where a text has none."""
    bounded_batches(docs.sparkSession)
    odd = bpe.odd_characters(byte_path)
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("a", longs), ("a_end", ints), ("b", longs), ("b_end", ints)])

    def lists(rows: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, rows)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([rows[0][:0], *rows])))

    def side(tokenizer: ByteTokenizer | PieceTokenizer, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(ends << ID_BITS | ids, ends.astype(np.int32)) for ids in tokenizer.ids(texts) for ends in [np.cumsum(tokenizer.lengths[ids])]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(byte_path, piece_path, odd)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int32)) * 2
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in slices(map(len, texts)):
                part = texts[start:end]
                rows = []
                for t, a, b in zip(part, *(side(x, part) for x in both), strict=True):
                    # Units have the bytes of their tokens or no token, so whole texts are told by their lengths.
                    n = len(t.encode()) + 1
                    rows.append((*a, *b) if t and len(a[0]) and len(b[0]) and a[1][-1] == b[1][-1] == n else none)
                yield batch_of(schema, [batch.column(0).slice(start, end - start), *map(lists, zip(*rows, strict=True))])

    return docs.select(F.col(f"`{key}`").cast("long"), text_or_empty(text)).mapInArrow(run, TOKENS)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def group_texts(entries: Column) -> Column:
    """The decimal ids of each group, joined by commas. A mark is a number that no id is, so it stands out in the joined text;
    what stands behind the last one (nothing, or the comma of a text without tokens) falls away."""
    ids = F.transform(entries, lambda v: v.bitwiseAND(2 * MARK - 1)).cast("array<string>")
    parts = F.split(F.replace(F.concat(F.array_join(ids, ","), F.lit(",")), F.lit(f",{MARK},"), F.lit(";")), ";")
    return let(parts, lambda p: F.slice(p, F.lit(1), F.size(p) - 1))


def last_id(group: Column) -> Column:
    return F.substring_index(group, ",", -1).cast("long")


def align(tokens: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b; groups: array of texts `a1,a2|b1`; links: array of pairs (id of a times 2^32 plus id of b)."""

    def both(marks: Column) -> Column:
        """The tokens of each side in order, with a mark behind the last one of each group."""
        return F.struct(F.sort_array(F.concat("a", marks)).alias("a"), F.sort_array(F.concat("b", marks)).alias("b"))

    def out(g: Column) -> Column:
        groups = F.zip_with(g["a"], g["b"], lambda x, y: F.concat(x, F.lit("|"), y))
        links = F.zip_with(g["a"], g["b"], lambda x, y: F.shiftleft(last_id(x), 32).bitwiseOR(last_id(y)))
        return F.struct(groups.alias("groups"), links.alias("links"))

    marks = F.transform(F.array_intersect("a_end", "b_end"), lambda e: F.shiftleft(e.cast("long"), ID_BITS).bitwiseOR(MARK))
    made = let(marks, lambda m: let(both(m), lambda e: let(F.struct(group_texts(e["a"]).alias("a"), group_texts(e["b"]).alias("b")), out)))
    sizes = [F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b")]
    return tokens.select("doc_id", *sizes, made.alias("made")).select("doc_id", "n_a", "n_b", "made.groups", "made.links")


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (links that hold it), best (1 if no pair of its b id has more): one row for each pair in `links` (column pair)."""
    counts = links.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    counts = stored(counts, "pair-counts")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))  # at most one row for each id of a vocabulary
    return counts.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))


def link_statistics(aligned: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """row, n_best, count_sum for each row of `aligned` (columns row and links) that has links."""
    links = aligned.select("row", F.explode("links").alias("pair"))
    counts = stored(pair_counts(links), "pairs")
    size = counts.agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("links")).first()
    least = 1 if size.pairs <= hot_pairs else -(-size.links // hot_pairs)
    found = links.join(F.broadcast(counts.filter(F.col("n") >= least)), "pair", "left" if least > 1 else "inner")
    sums = [F.sum("best").alias("n_best"), F.sum("n").alias("count_sum")]
    if least == 1:
        return found.groupBy("row").agg(*sums)
    rare = found.filter("n is null").groupBy("row", "pair").agg(F.count(F.lit(1)).alias("times"))
    rare = rare.join(counts.filter(F.col("n") < least), "pair").select("row", (F.col("best") * F.col("times")).alias("best"), (F.col("n") * F.col("times")).alias("n"))
    return found.filter("n is not null").select("row", "best", "n").unionByName(rare).groupBy("row").agg(*sums)


def alignment_report(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", key: str = "doc_id", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs."""
    made = align(tokenise(docs, byte_path, piece_path, text, key))
    digest = F.when(F.size("groups") > 0, F.sha2(F.array_join("groups", ";"), 256)).otherwise("")
    made = made.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", F.size("groups").cast("long").alias("n_groups"), F.size("links").cast("long").alias("n_links"), digest.alias("groups_sha256"), "links")
    # Read from the written table on, so that a row keeps its number.
    made = stored(made, "aligned")
    sums = link_statistics(made, hot_pairs)
    none = F.lit(0).cast("long")
    return made.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
