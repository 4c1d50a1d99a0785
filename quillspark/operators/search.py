"""Filters, sorting, paging and ranked keyword search over document tables."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.structure import let
from quillspark.operators import ordered

#: Sort names and their columns.
SORT_FIELDS = {"created_at": "created_at", "updated_at": "updated_at", "filename": "filename", "status": "status", "confidence": "confidence_score", "size": "file_size"}
#: Rows before a page from which on it counts ranges of the order first.
DEEP = 10_000
#: Fixed value: a term of the index.
TERM = r"[\p{L}\p{N}]+"


@dataclass
class Filters:
    filename: str | None = None
    mime_type: str | None = None
    status: str | None = None
    created_from: float | None = None
    created_to: float | None = None
    confidence_min: float | None = None
    confidence_max: float | None = None
    has_text: bool | None = None


@dataclass
class Query:
    keyword: str = ""
    filters: Filters = field(default_factory=Filters)
    sort_by: str = "created_at"
    descending: bool = True
    page: int = 1
    page_size: int = 20
    use_semantic: bool = False  # accepted, without effect


def like(c: Column, value: str) -> Column:
    """Case-insensitive substring match in which % and _ of the value are wildcards."""
    return F.ilike(c, F.lit("%" + value.replace("\\", "\\\\") + "%"))


def condition(f: Filters) -> Column:
    """The conjunction of the filters that are set."""
    has = F.coalesce(F.col("extracted_text"), F.lit("")) != ""
    tests = [
        f.filename and f.filename.strip() and like(F.col("filename"), f.filename),
        f.mime_type and F.col("mime_type") == f.mime_type,
        f.status and F.col("status") == f.status,
        None if f.created_from is None else F.col("created_at") >= f.created_from,
        None if f.created_to is None else F.col("created_at") <= f.created_to,
        None if f.confidence_min is None else F.col("confidence_score") >= f.confidence_min,
        None if f.confidence_max is None else F.col("confidence_score") <= f.confidence_max,
        None if f.has_text is None else (has if f.has_text else ~has),
    ]
    return reduce(lambda a, b: a & b, [t for t in tests if isinstance(t, Column)], F.lit(True))


def like_search(docs: DataFrame, text: str) -> DataFrame:
    return docs.filter(like(F.col("filename"), text) | like(F.col("extracted_text"), text))


def sort_page(docs: DataFrame, by: str = "created_at", descending: bool = True, page: int = 1, size: int = 20, key: str = "id") -> DataFrame:
    """One page in order, ties by key; a plan of top-k shape for the first pages, of later ones the ranges of the order that they
    touch are sorted. Pages below 1 count as 1."""
    if size < 1:
        raise ValueError("a page has one row at least")
    c = F.col(SORT_FIELDS.get(by, "created_at") if by != "rank" else "rank")
    start = (max(page, 1) - 1) * size
    if start > DEEP:
        return ordered.page(docs, [(c, descending), (F.col(key), False)], start, size)
    order = c.desc_nulls_last() if descending else c.asc_nulls_first()
    return docs.orderBy(order, F.col(key)).offset(start).limit(size)


def page_count(total: int, size: int) -> int:
    return max(1, -(-total // size))


def totals(docs: DataFrame, size: int = 20) -> DataFrame:
    """One row: total, and the number of pages, at least 1."""
    return docs.agg(F.count(F.lit(1)).alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / float(size))).cast("long").alias("pages"))


def fold(c: Column) -> Column:
    """Small letters without diacritics of the Latin ranges."""
    plain = {"áàâäãåā": "a", "çčć": "c", "éèêëē": "e", "íìîïī": "i", "ñń": "n", "óòôöõōø": "o", "úùûüū": "u", "ýÿ": "y", "šś": "s", "žźż": "z"}
    return F.translate(F.lower(c), "".join(plain), "".join(v * len(k) for k, v in plain.items()))


def terms(c: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(TERM), F.lit(0))


def postings(docs: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """The inverted index: key, field, pos, term."""
    parts = [docs.select(key, F.lit(f).alias("field"), F.posexplode(terms(F.col(f))).alias("pos", "term")) for f in fields]
    return reduce(DataFrame.unionAll, parts)


def lengths(docs: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    return docs.select(key, reduce(lambda a, b: a + b, [F.size(terms(F.col(f))) for f in fields]).cast("long").alias("n_terms"))


class QueryError(ValueError):
    """A keyword query outside the grammar; callers fall back to substring search."""


def parse(query: str) -> tuple:
    """A tree of ("and" | "or" | "not", left, right) over ("phrase", [terms], prefix, field).

    not binds closer than and, and closer than or; bare neighbours are joined by and.
    """
    found = re.findall(r'"([^"]*)"(\*?)|(\()|(\))|([^\s()"]+)', query)
    if query.count('"') % 2:
        raise QueryError("unterminated phrase")
    toks = [("phrase", a, b) if not (c or d or e) else ("(" if c else ")" if d else "word", e, "") for a, b, c, d, e in found]
    at = 0

    def peek() -> str:
        if at == len(toks):
            return ""
        kind, word, _ = toks[at]
        return word if kind == "word" and word in ("AND", "OR", "NOT") else kind

    def take() -> tuple:
        nonlocal at
        at += 1
        return toks[at - 1]

    def split(text: str) -> list[str]:
        return re.findall(r"[^\W_]+", text.lower())

    def atom() -> tuple:
        kind = peek()
        if kind == "(":
            take()
            inner = either()
            if peek() != ")":
                raise QueryError("missing )")
            take()
            return inner
        if kind == "phrase":
            _, text, star = take()
            return ("phrase", split(text), bool(star), None)
        if kind != "word":
            raise QueryError(f"unexpected {kind or 'end'}")
        word = take()[1]
        m = re.fullmatch(r"(?:(\w+):)?(\w+)(\*?)", word)
        if not m:
            raise QueryError(f"syntax error near {word}")
        return ("phrase", split(m[2]), bool(m[3]), m[1])

    def without() -> tuple:
        left = atom()
        while peek() == "NOT":
            take()
            left = ("not", left, atom())
        return left

    def both() -> tuple:
        left = without()
        while peek() in ("AND", "word", "phrase", "("):
            if peek() == "AND":
                take()
            left = ("and", left, without())
        return left

    def either() -> tuple:
        left = both()
        while peek() == "OR":
            take()
            left = ("or", left, both())
        return left

    tree = either()
    if at < len(toks):
        raise QueryError("unbalanced query")
    return tree


def phrases(tree: tuple) -> list[tuple]:
    """Phrases that count for the rank: all but those under not's right side."""
    if tree[0] == "phrase":
        return [tree]
    return phrases(tree[1]) + ([] if tree[0] == "not" else phrases(tree[2]))


def phrase_hits(index: DataFrame, phrase: tuple, key: str = "id") -> DataFrame:
    """key, hits: occurrences of a phrase; positions of its terms line up in one field."""
    _, ts, prefix, only = phrase
    rows = index if only is None else index.filter(F.col("field") == only)
    # Postings of a stored index bring the lengths of their documents along.
    size = [F.max("n_terms").alias("n_terms")] if "n_terms" in index.columns else []
    if not ts:
        return rows.filter(F.lit(False)).groupBy(key).agg(F.count(F.lit(1)).alias("hits"), *size)
    tests = [F.startswith(F.col("term"), F.lit(t)) if prefix and i == len(ts) - 1 else F.col("term") == t for i, t in enumerate(ts)]
    if len(ts) == 1:
        return rows.filter(tests[0]).groupBy(key).agg(F.count(F.lit(1)).alias("hits"), *size)
    spots = F.array_compact(F.array(*[F.when(t, i) for i, t in enumerate(tests)]))
    starts = rows.filter(reduce(lambda a, b: a | b, tests)).select(key, "field", "pos", *(["n_terms"] if size else []), F.explode(spots).alias("i"))
    starts = starts.groupBy(key, "field", (F.col("pos") - F.col("i")).alias("start")).agg(F.count_distinct("i").alias("n"), *size).filter(F.col("n") == len(ts))
    return starts.groupBy(key).agg(F.count(F.lit(1)).alias("hits"), *size)


def matching(index: DataFrame, tree: tuple, key: str = "id") -> DataFrame:
    """Keys of the documents that satisfy the tree."""
    if tree[0] == "phrase":
        return phrase_hits(index, tree, key).select(key)
    left, right = matching(index, tree[1], key), matching(index, tree[2], key)
    if tree[0] == "or":
        return left.unionAll(right).distinct()
    return left.join(right, key, "left_semi" if tree[0] == "and" else "left_anti")


def bm25(docs: DataFrame, index: DataFrame, query: str, fields: list[str], key: str = "id", sizes: DataFrame | None = None) -> DataFrame:
    """key, rank (negative, the lower the better) of the documents that match; k1 = 1.2, b = 0.75.

    sizes: key and n_terms of every document; without them the texts are tokenised for it.
    """
    if not query.strip():
        return docs.select(key, F.lit(0.0).alias("rank")).filter(F.lit(False))
    return ranked(index, lengths(docs, fields, key) if sizes is None else sizes, parse(query), key)


def saturation(hits: Column, n_terms: Column, mean: Column) -> Column:
    """A phrase's share of BM25 without its idf; k1 = 1.2, b = 0.75."""
    return hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * n_terms / mean))


def idf_of(n_docs: int, df: int) -> float:
    idf = math.log((n_docs - df + 0.5) / (df + 0.5))
    return 1e-6 if idf <= 0 else idf


def ranked(index: DataFrame, size: DataFrame | None, tree: tuple, key: str = "id", known: tuple[int, float] | None = None) -> DataFrame:
    """key, rank of the documents that satisfy the tree; where it joins phrases by AND or OR alone, matching is told from the
    same hits. known: number of documents and their mean length, if the postings bring the lengths (n_terms) along; else
    size has key and n_terms of every document."""
    counted = phrases(tree)
    parts = [phrase_hits(index, p, key).withColumn("p", F.lit(i)) for i, p in enumerate(counted)]
    hits = reduce(DataFrame.unionAll, parts)
    df = hits.groupBy("p").agg(F.count(F.lit(1)).alias("df"))  # one row a phrase
    met = needed(tree, [F.col("have").getItem(i) for i in range(len(counted))])
    if met is None:
        hits = hits.join(matching(index, tree, key), key, "left_semi")
    hits = hits.join(F.broadcast(df), "p")
    if known is None:
        # One row of statistics goes to every hit.
        stats = size.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_terms").alias("avg_terms"))
        hits = hits.join(size, key).crossJoin(F.broadcast(stats))
    else:
        hits = hits.withColumns({"n_docs": F.lit(known[0]), "avg_terms": F.lit(known[1])})
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    part = idf * saturation(F.col("hits"), F.col("n_terms"), F.col("avg_terms"))
    if met is None:
        return hits.groupBy(key).agg((-F.sum(part)).alias("rank"))
    have = F.array(*[F.max(F.col("p") == i) for i in range(len(counted))]).alias("have")
    return hits.groupBy(key).agg((-F.sum(part)).alias("rank"), have).filter(met).drop("have")


def needed(tree: tuple, have: list[Column]) -> Column | None:
    """Whether the phrases that a document has satisfy the tree, in the order of phrases(); None where the tree has a not."""
    left = iter(have)

    def visit(t: tuple) -> Column | None:
        if t[0] == "phrase":
            return next(left)
        if t[0] == "not":
            return None
        a, b = visit(t[1]), visit(t[2])
        return None if a is None or b is None else (a & b if t[0] == "and" else a | b)

    return visit(tree)


def snippet(text: Column, words: list[str], width: int = 32) -> Column:
    """`width` words around the window with the most different hits, then the most hits, the earliest of equals; hits are
    marked with <b> and lie in the window's middle. Words are what white space parts, so the cut is approximately that of
    an index's own tokens."""
    asked = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    which = lambda w: F.coalesce(F.array_max(F.transform(terms(w), lambda t: F.array_position(asked, t))), F.lit(0).cast("long"))

    def window(hits: Column) -> Column:
        """Where the best window begins, from 0; hits: array of struct(at, term) in order."""

        def rated(hit: Column, k: Column) -> Column:
            near = F.filter(F.slice(hits, k + 1, F.lit(width)), lambda x: x["at"] < hit["at"] + width)
            return let(near, lambda n: F.struct((F.size(F.array_distinct(F.transform(n, lambda x: x["term"]))) * 1000 + F.size(n)).alias("score"), (-hit["at"]).alias("early"), F.element_at(n, -1)["at"].alias("last")))

        return let(F.array_max(F.transform(hits, rated)), lambda best: -best["early"] - F.floor((width - (best["last"] + best["early"])) / 2).cast("int"))

    def shown(ws: Column) -> Column:
        hits = F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("at"), which(w).alias("term"))), lambda x: x["term"] > 0)
        start = F.greatest(F.least(F.coalesce(let(hits, window), F.lit(0)), F.size(ws) - width), F.lit(0))

        def cut(at: Column) -> Column:
            marked = F.transform(F.slice(ws, at + 1, F.lit(width)), lambda w: F.when(which(w) > 0, F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
            return F.concat(F.when(at > 0, "...").otherwise(""), F.array_join(marked, " "), F.when(F.size(ws) > at + width, "...").otherwise(""))

        return let(start, cut)

    return let(F.split(text, r"\s+"), shown)


def item(row: DataFrame) -> DataFrame:
    """The result item of each row: all columns, structured_json parsed (null if it isn't JSON), chunks_count 0 if unknown."""
    if "structured_json" in row.columns:
        row = row.withColumn("structured_json", F.try_parse_json("structured_json"))
    return row.fillna(0, ["chunks_count"]) if "chunks_count" in row.columns else row.withColumn("chunks_count", F.lit(0).cast("long"))


def search(docs: DataFrame, q: Query, chunk_counts: DataFrame | None = None, index: DataFrame | None = None, sizes: DataFrame | None = None, index_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(page, total): ranked if the keyword is in the grammar, substring search otherwise, a filtered scan if it is blank.

    index_path: a stored index of docs (operators.index). Texts are tokenised for the query only without it (or without
    index and sizes). A page by relevance then takes its documents from the blocks that can hold one of them.
    """
    fields = [f for f in ("filename", "extracted_text", "structured_json") if f in docs.columns]
    rows = docs
    if q.keyword.strip():
        try:
            if index_path:
                return _search_stored(docs, q, index_path, chunk_counts)
            ranks = bm25(docs, postings(docs, fields) if index is None else index, q.keyword, fields, sizes=sizes)
            rows = docs.join(ranks, "id")
        except QueryError:
            rows = like_search(docs, q.keyword)
    rows = rows.filter(condition(q.filters))
    if chunk_counts is not None:
        rows = rows.join(chunk_counts, "id", "left").fillna(0, ["chunks_count"])
    by, down = q.sort_by, q.descending
    if by == "relevance":
        by, down = ("rank", not q.descending) if "rank" in rows.columns else ("created_at", True)
    return sort_page(rows, by, down, q.page, q.page_size), rows.agg(F.count(F.lit(1)).alias("total"))


def _search_stored(docs: DataFrame, q: Query, path: str, chunk_counts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    from quillspark.operators import index

    spark = docs.sparkSession
    kept = docs.filter(condition(q.filters))
    total = kept.select("id").join(index.find(spark, path, q.keyword), "id", "left_semi").agg(F.count(F.lit(1)).alias("total"))
    by, down = ("rank", not q.descending) if q.sort_by == "relevance" else (q.sort_by, q.descending)
    if by == "rank" and not down:
        # Only documents that pass the filters are candidates; statistics are those of all documents.
        ranks = index.top(spark, path, q.keyword, max(q.page, 1) * q.page_size, allowed=None if q.filters == Filters() else kept)
    else:
        ranks = index.rank(spark, path, q.keyword)
    rows = kept.join(ranks, "id")
    if chunk_counts is not None:
        rows = rows.join(chunk_counts, "id", "left").fillna(0, ["chunks_count"])
    return sort_page(rows, by, down, q.page, q.page_size), total
