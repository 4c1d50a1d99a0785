"""Names of the core queries, their Spark plans and the same queries in DuckDB SQL.

Where the tables hold nothing that an operator would change, an expression that both engines evaluate alike adds it.
Long texts are returned as digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspark.functions import chunk, structure, text
from quillspark.operators import operations, ordered, overlap, search, store
from quillspark.sources import sinks
from quillspark.streaming import rolling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def spread_out(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, where its files give fewer (a table of one row group is one task). Larger
    tables have more tasks than cores and are read as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if 2 * df.rdd.getNumPartitions() > n else df.repartition(n)


def query(oracle: str = "") -> Callable:
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        def load(spark: SparkSession, sf_dir: str) -> Callable[..., DataFrame]:
            return lambda name, spread=False: (spread_out if spread else lambda df: df)(spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = lambda spark, sf_dir: f(load(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def library(documents: DataFrame) -> DataFrame:
    """documents in the shape of the document store."""
    i = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, [".pdf", ".txt", ".png", ".csv", ".exe"])), (i % 5 + 1).cast("int"))
    return documents.select(
        i.alias("id"),
        F.concat("source", F.lit("_"), i.cast("string"), ext).alias("filename"),
        (F.col("n_chars") * 1000).alias("file_size"),
        text.file_kind(ext, 1).alias("mime_type"),
        F.sha2("text", 256).alias("file_hash"),
        F.element_at(F.array(*map(F.lit, ["stored", "failed", "uploaded", "stored"])), (i % 4 + 1).cast("int")).alias("status"),
        (F.lit(1700000000) + i * 7919 % 100000).cast("double").alias("created_at"),
        ((i % 101) / F.lit(100.0)).alias("confidence_score"),
        F.when(i % 17 == 0, "").otherwise(F.col("text")).alias("extracted_text"),
    )


LIBRARY = """lib AS (SELECT doc_id AS id,
  source || '_' || doc_id || ['.pdf', '.txt', '.png', '.csv', '.exe'][doc_id % 5 + 1] AS filename,
  n_chars * 1000 AS file_size,
  ['application/pdf', 'text/plain', 'image/png', 'text/csv', 'application/octet-stream'][doc_id % 5 + 1] AS mime_type,
  sha256(text) AS file_hash, ['stored', 'failed', 'uploaded', 'stored'][doc_id % 4 + 1] AS status,
  CAST(1700000000 + doc_id * 7919 % 100000 AS DOUBLE) AS created_at, (doc_id % 101) / 100.0::DOUBLE AS confidence_score,
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE text END AS extracted_text FROM documents)"""

NOISE = "\x07 \t  x1l2l3 5O6O7 a0b0c vvv ﬁle №5 ™\n\n\n\n| y\x1f"


def noisy(c: str = "text") -> Column:
    return F.concat(F.substring(c, 1, 50), F.lit(NOISE), F.substr(F.col(c), F.lit(51)), F.lit("  \n "))


NOISY = "substr(text, 1, 50) || chr(7) || ' ' || chr(9) || '  x1l2l3 5O6O7 a0b0c vvv ﬁle №5 ™' || repeat(chr(10), 4) || '| y' || chr(31) || substr(text, 51) || '  ' || chr(10) || ' '"


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CONTROL = r"regexp_replace({}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"


def _collapse(x: str) -> str:
    return _STRIP.format(rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def _clean(x: str) -> str:
    return _collapse(_CONTROL.format(f"regexp_replace({x}, '<[^>]+>', '', 'g')"))


def _ligatures(x: str) -> str:
    for old, new in text.LIGATURES.items():
        x = f"replace({x}, '{old}', '{new}')"
    return x


def _swaps(x: str) -> str:
    for old, new in ((r"([0-9])l([0-9])", r"\11\2"), (r"([0-9])O([0-9])", r"\10\2"), (r"([a-z])0([a-z])", r"\1o\2"), (r"rn([a-z])", r"m\1"), (r"([a-z])cl([a-z])", r"\1d\2"), (r"(^|\s)[|](\s)", r"\1I\2")):
        for _ in range(2):
            x = f"regexp_replace({x}, '{old}', '{new}', 'g')"
    return f"replace({x}, 'vv', 'w')"


def _half_up(x: str, digits: int) -> str:
    return f"floor({x} * {float(10**digits)}::DOUBLE + 0.5::DOUBLE) / {float(10**digits)}::DOUBLE"


# --- text ---------------------------------------------------------------------------------------------------------


@query("SELECT page_id, sha256(regexp_replace(html, '<[^>]+>', '', 'g')) AS stripped FROM pages")
def text_strip_html(t):
    return t("pages").select("page_id", sha(text.strip_tags(F.col("html"))).alias("stripped"))


@query(f"SELECT doc_id, sha256({_CONTROL.format(NOISY)}) AS cleaned FROM documents")
def text_control_chars(t):
    return t("documents").select("doc_id", sha(text.remove_control(noisy())).alias("cleaned"))


@query(f"SELECT doc_id, sha256({_collapse(NOISY)}) AS cleaned FROM documents")
def text_collapse_ws(t):
    return t("documents").select("doc_id", sha(text.collapse_whitespace(noisy())).alias("cleaned"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '[^\p{L}\p{M}\p{N}_\s]', '', 'g')) AS cleaned FROM documents")
def text_punct(t):
    return t("documents").select("doc_id", sha(text.strip_punctuation(F.col("text"))).alias("cleaned"))


@query(f"SELECT doc_id, sha256({_clean(NOISY)}) AS cleaned FROM documents")
def text_clean(t):
    return t("documents", True).select("doc_id", sha(text.clean_text(noisy())).alias("cleaned"))


@query("SELECT doc_id, sha256(nfc_normalize(replace(text, 'é', 'e' || chr(769)))) AS normal FROM documents")
def nfc_normalise(t):
    return t("documents").select("doc_id", sha(text.normalize_unicode(F.replace("text", F.lit("é"), F.lit("é")))).alias("normal"))


@query(f"SELECT doc_id, sha256({_ligatures(NOISY)}) AS fixed FROM documents")
def ocr_ligatures(t):
    return t("documents").select("doc_id", sha(text.expand_ligatures(noisy())).alias("fixed"))


@query(f"SELECT doc_id, sha256({_swaps(NOISY)}) AS fixed FROM documents")
def ocr_swaps(t):
    return t("documents", True).select("doc_id", sha(text.ocr_swaps(noisy())).alias("fixed"))


@query("SELECT doc_id, sha256(replace(replace(text, 'the', 'teh'), 'te', 'to')) AS fixed FROM documents")
def ocr_custom_dict(t):
    return t("documents").select("doc_id", sha(text.custom_corrections(F.col("text"), {"the": "teh", "te": "to"})).alias("fixed"))


_FEATURES = rf"""f AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*') AS w,
  len(regexp_extract_all(text, '[.!?]+')) AS marks FROM documents),
g AS (SELECT *, CAST(len(w) AS DOUBLE) AS n, CAST(CASE WHEN marks > 0 THEN marks WHEN {_STRIP.format('text')} <> '' THEN 1 ELSE 0 END AS BIGINT) AS s,
  CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS DOUBLE) AS total,
  CAST(len(list_distinct(list_transform(w, lambda x: lower(x)))) AS BIGINT) AS v FROM f),
h AS (SELECT doc_id, lang, CAST(n AS BIGINT) AS word_count, CAST(length(text) AS BIGINT) AS char_count, CAST(length(replace(text, ' ', '')) AS BIGINT) AS char_count_no_spaces,
  s AS sentence_count, {_half_up('coalesce(total / nullif(n, 0), 0)', 2)} AS avg_word_length, {_half_up('(n / 238 * 60)', 1)} AS reading_time_seconds,
  v AS vocabulary_count, {_half_up('coalesce(v / nullif(n, 0), 0)', 4)} AS vocabulary_richness,
  CAST(coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS max_word_length,
  {_half_up('coalesce(n / nullif(CAST(s AS DOUBLE), 0), 0)', 1)} AS avg_sentence_length FROM g)"""


@query(f"WITH {_FEATURES} SELECT * EXCLUDE (lang) FROM h")
def features_all(t):
    return text.with_features(t("documents", True).select("doc_id", "text"), name="f").select("doc_id", "f.*")


@query(f"WITH {_FEATURES} SELECT lang, count(*) AS docs, CAST(sum(word_count) AS BIGINT) AS words, {_half_up('avg(avg_word_length)', 2)} AS mean_word_length FROM h GROUP BY lang")
def features_by_lang(t):
    rows = text.with_features(t("documents", True).select("lang", "text"), name="f")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("f.word_count").alias("words"), text.half_up(F.avg("f.avg_word_length"), 2).alias("mean_word_length"))


@query(rf"""WITH c AS (SELECT lang, {_swaps(_ligatures(_clean(NOISY)))} AS c FROM documents),
d AS (SELECT lang, length(c) AS n, len(regexp_extract_all(c, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*')) AS w FROM c)
SELECT lang, count(*) AS docs, CAST(sum(w) AS BIGINT) AS words, CAST(sum(n) AS BIGINT) AS chars FROM d GROUP BY lang""")
def corpus_profile(t):
    """Flagship: clean, correct, measure, sum up by language; one shuffle of a few partial sums."""
    c = t("documents", True).select("lang", text.correct_ocr(text.clean_text(noisy())).alias("c"))
    m = c.select("lang", F.length("c").alias("n"), F.size(text.words(F.col("c"))).alias("w"))
    return m.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("w").alias("words"), F.sum("n").alias("chars"))


@query("""WITH c AS (SELECT doc_id, text, CASE WHEN length(text) <= 512 THEN 1 ELSE CAST(1 + ceil((length(text) - 512) / 448.0) AS INT) END AS k FROM documents WHERE text <> '')
SELECT doc_id, CAST(i AS INT) AS chunk_index, sha256(substr(text, i * 448 + 1, 512)) AS chunk FROM c, unnest(range(k)) AS u(i)""")
def chunk_fixed(t):
    return t("documents").select("doc_id", F.posexplode(chunk.chunks(F.col("text"), method="fixed")).alias("chunk_index", "c")).select("doc_id", "chunk_index", sha(F.col("c")).alias("chunk"))


def _packed(pieces: str) -> str:
    return f"""WITH p AS (SELECT doc_id, list_filter(list_transform({pieces}, lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS ps FROM documents),
q AS (SELECT doc_id, list_reduce(list_transform(ps, lambda x: {{'done': []::VARCHAR[], 'open': x, 'used': CAST(length(x) AS BIGINT)}}),
  lambda a, x: CASE WHEN a.used + x.used + 2 > 512 THEN {{'done': list_append(a.done, a.open), 'open': x.open, 'used': x.used + 2}}
  ELSE {{'done': a.done, 'open': a.open || chr(10) || chr(10) || x.open, 'used': a.used + x.used + 2}} END) AS r FROM p WHERE len(ps) > 0)
SELECT doc_id, CAST(len(r.done) + 1 AS INT) AS n_chunks, sha256(array_to_string(list_append(r.done, r.open), '|')) AS chunks FROM q"""


def _chunked(t, method: str) -> DataFrame:
    c = t("documents", True).select("doc_id", chunk.chunks(F.when(F.lit(method == "paragraph"), F.regexp_replace("text", r"\. ", "\n \n")).otherwise(F.col("text")), method=method).alias("c"))
    return c.filter(F.size("c") > 0).select("doc_id", F.size("c").alias("n_chunks"), sha(F.array_join("c", "|")).alias("chunks"))


@query(_packed(r"""string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1))"""))
def chunk_sentence(t):
    return _chunked(t, "sentence")


@query(_packed(r"string_split_regex(regexp_replace(text, '\. ', chr(10) || ' ' || chr(10), 'g'), '\n\s*\n')"))
def chunk_paragraph(t):
    return _chunked(t, "paragraph")


@query("SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 WHEN length(text) <= 512 THEN 1 ELSE 1 + ceil((length(text) - 512) / 448.0) END AS BIGINT) AS chunks_count FROM documents")
def chunk_counts_join(t):
    docs = t("documents").select(F.col("doc_id").alias("id"), "text")
    chunks = docs.select(F.col("id").alias("document_id"), F.explode(chunk.chunks(F.col("text"), method="fixed")))
    return store.with_chunk_counts(docs.select("id"), chunks).select(F.col("id").alias("doc_id"), "chunks_count")


@query("SELECT doc_id, sha256('Summarise: $5 ' || substr(text, 1, 4000) || ' $unknown in ' || lang || '$') AS prompt FROM documents")
def prompt_render(t):
    return t("documents").select("doc_id", sha(text.render_prompt("Summarise: $$5 $text $unknown in ${lang}$$", text=text.truncate_for_model(F.col("text")), lang=F.col("lang"))).alias("prompt"))


@query(r"SELECT doc_id, trim(regexp_replace(' ..' || source || ':' || doc_id || '/a?b*' || lang || '. ', '[<>:""/\\|?*\x00-\x1F]', '_', 'g'), '. ') AS name FROM documents".replace('""', '"'))
def safe_filename(t):
    return t("documents").select("doc_id", text.safe_filename(F.concat(F.lit(" .."), "source", F.lit(":"), F.col("doc_id").cast("string"), F.lit("/a?b*"), "lang", F.lit(". "))).alias("name"))


@query("""SELECT doc_id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0::DOUBLE) WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576.0::DOUBLE) ELSE printf('%.2f GB', s / 1073741824.0::DOUBLE) END AS label
FROM (SELECT doc_id, n_chars * n_chars * (1 + doc_id % 7) AS s FROM documents)""")
def human_size(t):
    return t("documents").select("doc_id", text.size_label(F.col("n_chars") * F.col("n_chars") * (1 + F.col("doc_id") % 7)).alias("label"))


@query(f"WITH {LIBRARY} SELECT id, CASE WHEN filename LIKE '%.exe' THEN '' ELSE '' END || ['.pdf', '.txt', '.png', '.csv', '.exe'][id % 5 + 1] AS extension, ['pdf', 'text', 'image', 'data', 'unknown'][id % 5 + 1] AS category, mime_type FROM lib")
def mime_category(t):
    e = text.extension(F.concat(F.lit("/data.dir/"), F.upper("filename")))
    return library(t("documents")).select("id", e.alias("extension"), text.file_kind(e, 0).alias("category"), text.file_kind(e, 1).alias("mime_type"))


@query(f"WITH {LIBRARY} SELECT id, id % 5 < 4 AND file_size <= 2000000 AS valid, CASE WHEN id % 5 = 4 THEN 'extension not allowed' WHEN file_size > 2000000 THEN 'too large' END AS reason FROM lib")
def validate_upload(t):
    return library(t("documents")).select("id", store.validate_upload(F.col("filename"), F.col("file_size"), 2_000_000).alias("v")).select("id", "v.valid", "v.reason")


# --- store --------------------------------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS file_hash FROM documents GROUP BY sha256(text)")
def dedup_exact(t):
    return store.first_ids(t("documents"), text.content_hash(F.col("text")), "doc_id").select("doc_id", "file_hash")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def dedup_anti_new(t):
    d = t("documents").select("doc_id", sha(F.col("text")).alias("file_hash"))
    return store.new_only(d.filter("doc_id % 2 = 1"), d.filter("doc_id % 2 = 0")).select("doc_id")


@query(f"WITH {LIBRARY} SELECT id, filename FROM lib WHERE filename ILIKE '%src1%' AND mime_type = 'application/pdf' AND status = 'stored' AND created_at >= 1700010000 AND confidence_score >= 0.2 AND confidence_score <= 0.9 AND extracted_text <> ''")
def filter_combined(t):
    f = search.Filters(filename="SRC1", mime_type="application/pdf", status="stored", created_from=1700010000.0, confidence_min=0.2, confidence_max=0.9, has_text=True)
    return library(t("documents")).filter(search.condition(f)).select("id", "filename")


@query(f"WITH {LIBRARY} SELECT id FROM lib WHERE extracted_text = ''")
def filter_has_text(t):
    return library(t("documents")).filter(search.condition(search.Filters(has_text=False))).select("id")


@query(f"WITH {LIBRARY} SELECT id FROM lib WHERE filename ILIKE '%the_a%' OR extracted_text ILIKE '%the_a%'")
def like_search(t):
    return search.like_search(library(t("documents")), "the_a").select("id")


@query(f"WITH {LIBRARY} SELECT id, filename, created_at FROM lib ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def sort_page(t):
    return search.sort_page(library(t("documents")).select("id", "filename", "created_at"), page=3)


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 100 OFFSET 40000")
def deep_page(t):
    """Page 401 of 100 rows: one range of the order is sorted."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return ordered.page(rows, [(F.col("l_shipdate"), True), (F.col("l_orderkey"), False), (F.col("l_linenumber"), False)], 40000, 100)


@query("SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages FROM documents")
def total_pages(t):
    return search.totals(t("documents"))


@query(f"WITH {LIBRARY} SELECT count(*) AS total, count(*) FILTER (status = 'stored') AS stored, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status NOT IN ('stored', 'failed')) AS pending FROM lib")
def status_counts(t):
    return store.status_counts(library(t("documents")))


@query(f"WITH {LIBRARY} SELECT id, filename, file_size, mime_type, file_hash, status, created_at, confidence_score FROM lib")
def metadata_export(t):
    return sinks.metadata_only(library(t("documents")))


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS v, o_totalprice AS p FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, -o_totalprice FROM orders WHERE o_orderkey % 2 = 1)
SELECT k, v, p FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS r FROM o) WHERE r = 1""")
def upsert_latest(t):
    o = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_totalprice").alias("p"))
    return store.upsert(o.filter("v % 2 = 0"), o.filter("v % 2 = 1").withColumn("p", -F.col("p")), ["k"], "v")


@query("SELECT o_orderkey AS id, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY o_orderkey")
def delete_cascade(t):
    orders, lines = t("orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus"), t("lineitem").select(F.col("l_orderkey").alias("document_id"))
    _, kept = store.delete_cascade(orders, lines, orders.filter("o_orderstatus = 'F'"))
    return kept.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(t):
    return operations.latest(t("events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS status_from, event_type AS status_to FROM events")
def status_transitions(t):
    return operations.transitions(t("events"), "user_id", "event_type", F.col("ts"), F.col("event_id")).select("event_id", "user_id", "status_from", F.col("event_type").alias("status_to"))


# --- search -------------------------------------------------------------------------------------------------------

_FOLD_FROM, _FOLD_TO = "áàâäãåāçčćéèêëēíìîïīñńóòôöõōøúùûüūýÿšśžźż", "aaaaaaaccceeeeeiiiiinnooooooouuuuuyysszzz"
_INDEX = rf"""tok AS (SELECT doc_id, regexp_extract_all(translate(lower(text), '{_FOLD_FROM}', '{_FOLD_TO}'), '[\p{{L}}\p{{N}}]+') AS ts FROM documents),
post AS (SELECT doc_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM tok)"""


def _index(t) -> tuple[DataFrame, DataFrame]:
    docs = t("documents").select("doc_id", "text")
    return docs, search.postings(docs, ["text"], "doc_id")


def _has(term: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM post WHERE term = '{term}')"


@query(f"WITH {_INDEX} SELECT doc_id FROM documents WHERE {_has('hein')} AND {_has('the')}")
def fts_and(t):
    return search.matching(_index(t)[1], search.parse("hein the"), "doc_id")


@query(f"WITH {_INDEX} SELECT doc_id FROM documents WHERE {_has('hein')} OR doc_id IN (SELECT doc_id FROM post WHERE term LIKE 'onst%')")
def fts_or(t):
    return search.matching(_index(t)[1], search.parse("hein OR onst*"), "doc_id")


@query(f"WITH {_INDEX} SELECT doc_id FROM documents WHERE {_has('the')} AND NOT {_has('with')}")
def fts_not(t):
    return search.matching(_index(t)[1], search.parse("the NOT with"), "doc_id")


@query(f"WITH {_INDEX} SELECT DISTINCT a.doc_id FROM post a JOIN post b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'")
def fts_phrase(t):
    return search.matching(_index(t)[1], search.parse('"of the"'), "doc_id")


@query(f"""WITH {_INDEX}, hits AS (SELECT doc_id, term, count(*) AS f FROM post WHERE term IN ('thing', 'sein') GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM hits GROUP BY term), st AS (SELECT count(*) AS nd, avg(len(ts)) AS a FROM tok),
r AS (SELECT h.doc_id, -sum(CASE WHEN ln((nd - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((nd - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) END * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ts) / a))) AS rank
FROM hits h JOIN df USING (term) JOIN tok USING (doc_id), st GROUP BY h.doc_id) SELECT doc_id, {_half_up('rank', 5)} AS rank FROM r""")
def bm25_rank(t):
    docs, index = _index(t)
    return search.bm25(docs, index, "thing OR sein", ["text"], "doc_id").select("doc_id", text.half_up(F.col("rank"), 5).alias("rank"))


# --- structure ----------------------------------------------------------------------------------------------------

_FIELDS = "map_from_entries(list_transform(range(doc_id % 7), lambda i: {'key': 'f' || i, 'value': CASE WHEN (doc_id + i) % 3 = 0 THEN '' ELSE source END}))"


def _fields() -> Column:
    n = (F.col("doc_id") % 7).cast("int")
    entries = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.struct(F.concat(F.lit("f"), i.cast("string")).alias("key"), F.when((F.col("doc_id") + i) % 3 == 0, "").otherwise(F.col("source")).alias("value")))
    return F.map_from_entries(F.slice(entries, F.lit(1), n))


@query("""WITH x AS (SELECT doc_id, doc_id % 7 AS n, len(list_filter(range(doc_id % 7), lambda i: (doc_id + i) % 3 <> 0)) AS k FROM documents)
SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0.0 WHEN k = 0 THEN 0.15 WHEN k = 1 THEN 0.3 WHEN k = 2 THEN 0.55 WHEN k <= 4 THEN 0.75 ELSE 0.9 END AS DOUBLE) AS confidence FROM x""")
def confidence_tiers(t):
    return t("documents").select("doc_id", structure.confidence_tier(_fields()).alias("confidence"))


@query(f"WITH {LIBRARY} SELECT id, CASE WHEN confidence_score >= 0.8 THEN 'high' WHEN confidence_score >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM lib")
def confidence_level(t):
    return library(t("documents")).select("id", structure.confidence_level(F.col("confidence_score")).alias("level"))


_OVERLAP = """bench AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS turn, count(*) OVER () AS items FROM benchmark),
o AS (SELECT doc_id, item_id, lower(b.text) AS a, trim(lower(d.text)) AS b, length(b.text) AS n FROM documents d JOIN bench b ON d.doc_id % b.items = b.turn),
w AS (SELECT *, least(100, n // 4) AS wd FROM o), v AS (SELECT *, greatest(1, wd // 2) AS st FROM w),
z AS (SELECT doc_id, item_id, n, CASE WHEN n < 20 THEN CAST(contains(b, a) AS DOUBLE) ELSE len(list_filter(range(0, n - wd + 1, st), lambda i: contains(b, substr(a, i + 1, wd)))) * wd / CAST(n AS DOUBLE) END AS ratio, b FROM v)"""


def _pairs(t) -> DataFrame:
    """Each document with one benchmark item; by turns in the order of item_id, so that every item has its documents."""
    turns = t("benchmark").select("item_id", (F.row_number().over(W.orderBy("item_id")) - 1).alias("turn"))
    n = t("benchmark").agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    docs = t("documents", True).select("doc_id", F.col("text").alias("d")).crossJoin(F.broadcast(n)).select("doc_id", "d", F.pmod("doc_id", "n").alias("turn"))
    return docs.join(turns.select("item_id", "turn"), "turn").join(t("benchmark"), "item_id").drop("turn")


@query(f"WITH {_OVERLAP} SELECT doc_id, item_id, {_half_up('ratio', 4)} AS ratio FROM z")
def overlap_ratio(t):
    return _pairs(t).select("doc_id", "item_id", text.half_up(structure.overlap_ratio(F.lower("text"), F.trim(F.lower("d"))), 4).alias("ratio"))


@query(f"""WITH o AS (SELECT doc_id, item_id, lower(b.text) AS a, trim(lower(d.text)) AS b, length(b.text) AS n FROM documents d, benchmark b WHERE b.text <> ''),
w AS (SELECT *, CASE WHEN n < 20 THEN n ELSE least(100, n // 4) END AS wd FROM o), v AS (SELECT *, CASE WHEN n < 20 THEN n ELSE greatest(1, wd // 2) END AS st FROM w),
z AS (SELECT doc_id, item_id, len(list_filter(range(0, n - wd + 1, st), lambda i: contains(b, substr(a, i + 1, wd)))) * wd / CAST(n AS DOUBLE) AS ratio FROM v)
SELECT doc_id, item_id, {_half_up('ratio', 4)} AS ratio FROM z WHERE ratio > 0""")
def overlap_pairs(t):
    """Every document against every item, by the windows that they share."""
    docs = t("documents", True).select(F.col("doc_id").alias("text_id"), F.trim(F.lower("text")).alias("text"))
    items = t("benchmark").select(F.col("item_id").alias("value_id"), F.lower("text").alias("value"))
    return overlap.overlaps(items, docs).select(F.col("text_id").alias("doc_id"), F.col("value_id").alias("item_id"), text.half_up(F.col("ratio"), 4).alias("ratio"))


@query(f"""WITH {_OVERLAP} SELECT doc_id, CASE WHEN length(b) < 50 THEN false WHEN doc_id % 11 = 0 THEN true WHEN n > 500 THEN true WHEN n > length(b) * 0.5 THEN true WHEN doc_id % 13 = 0 THEN false ELSE n > 50 AND ratio > 0.4 END AS dump FROM z""")
def text_dump_flag(t):
    p = _pairs(t).withColumn("d", F.trim("d"))
    fields = F.create_map(F.when(F.col("doc_id") % 11 == 0, "Full_Text").otherwise("note"), F.col("text"))
    return p.select("doc_id", structure.copies_text(fields, F.col("doc_id") % 13 == 0, F.col("d")).alias("dump"))


_JSON = "'Sure:' || chr(10) || '```json' || chr(10) || '{name: ' || chr(39) || source || chr(39) || ', ok: True, gone: None, n: [1, 2,], lang: \"' || lang || '\",' || CASE WHEN doc_id % 2 = 0 THEN '}' ELSE '' END || chr(10) || '```'"


def _answers() -> Column:
    return F.concat(F.lit("Sure:\n```json\n{name: '"), "source", F.lit("', ok: True, gone: None, n: [1, 2,], lang: \""), "lang", F.lit('",'), F.when(F.col("doc_id") % 2 == 0, "}").otherwise(""), F.lit("\n```"))


_FENCED = "regexp_replace(regexp_extract({}, '(?s)```(?:json)?\\s*\\n?(.*?)\\n?```', 1), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT doc_id, {_FENCED.format(_JSON)} AS inner_text FROM documents")
def json_fence_strip(t):
    return t("documents").select("doc_id", structure.strip_fences(_answers()).alias("inner_text"))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace({_JSON}, ',\s*}}', '}}', 'g'), ',\s*]', ']', 'g') AS fixed FROM documents")
def json_trailing_commas(t):
    return t("documents").select("doc_id", structure.fix_trailing_commas(_answers()).alias("fixed"))


@query(f"SELECT doc_id, {_JSON} || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '}}' END AS fixed FROM documents")
def json_close_truncated(t):
    return t("documents").select("doc_id", structure.close_truncated(_answers()).alias("fixed"))


@query("SELECT doc_id, '{\"gone\":null,\"lang\":\"' || lang || '\",\"n\":[1,2],\"name\":\"' || source || '\",\"ok\":true}' AS parsed FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 2 = 1")
def json_repair_parse(t):
    return t("documents", True).select("doc_id", structure.parse_json(_answers()).alias("parsed"))


# --- operations ---------------------------------------------------------------------------------------------------


@query(f"SELECT event_type, {_half_up('avg(value)', 2)} AS avg_ms, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 360 GROUP BY event_type")
def rolling_window_avg(t):
    return operations.rolling_timings(t("events"), "event_type", "value", 360, F.col("ts").desc(), F.col("event_id").desc())


_CACHE = "c AS (SELECT event_id AS id, event_type AS entry_type, CAST(floor(value * 1000) AS BIGINT) AS size_bytes, CASE WHEN event_id % 9 = 0 THEN NULL ELSE epoch(ts) END AS last_accessed, event_id % 5 AS access_count, epoch(ts) + 3600 AS expires_at FROM events)"


def _cache(t) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return t("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("entry_type"), F.floor(F.col("value") * 1000).cast("long").alias("size_bytes"), F.when(F.col("event_id") % 9 != 0, seconds).alias("last_accessed"), (F.col("event_id") % 5).alias("access_count"), (seconds + 3600).alias("expires_at"))


@query(f"WITH {_CACHE}, r AS (SELECT id, coalesce(sum(size_bytes) OVER (ORDER BY last_accessed NULLS FIRST, access_count, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size_bytes) OVER () AS total FROM c) SELECT id, CAST(before AS BIGINT) AS before FROM r WHERE total - before > total / 2")
def lru_evict(t):
    out = operations.evict_lru(_cache(t), "size_bytes", F.col("total") / 2, F.col("last_accessed"), F.col("access_count"), F.col("id"))
    return out.select("id", "before")


@query(f"WITH {_CACHE} SELECT id FROM c WHERE expires_at < 1705000000")
def ttl_expired(t):
    return operations.expired(_cache(t), 1705000000.0).select("id")


@query(f"WITH {_CACHE} SELECT count(*) AS entries, CAST(sum(size_bytes) AS BIGINT) AS bytes, {_half_up('(CAST(sum(size_bytes) AS DOUBLE) / 1048576)', 2)} AS mb, sum(size_bytes) > 524288000 AS is_full, count(*) FILTER (expires_at < 1705000000) AS expired FROM c")
def cache_stats(t):
    return operations.cache_stats(_cache(t), 1705000000.0)


@query(f"WITH {_CACHE} SELECT entry_type, count(*) AS n FROM c GROUP BY entry_type")
def cache_by_type(t):
    return operations.count_by(_cache(t), "entry_type")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r > 5")
def retention_prune(t):
    return operations.beyond_newest(t("events").select("event_id", "user_id", "ts"), "user_id", 5, F.col("ts"), F.col("event_id")).select("event_id", "user_id")


def _log(t) -> DataFrame:
    return t("events").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("operation"), F.when(F.col("event_type") == "error", "critical").otherwise("info").alias("severity"), F.col("user_id").alias("document_id"))


@query("SELECT event_id AS id, user_id AS document_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 100")
def log_query(t):
    since, until = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-05", "2024-01-20"))
    return operations.log_query(_log(t), operation="error", severity="critical", since=since, until=until, order="id").select("id", "document_id")


@query("SELECT event_id AS id, event_type AS operation FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def log_tail(t):
    return operations.log_tail(_log(t), 20, F.col("timestamp").desc(), F.col("id").desc()).select("id", "operation")


@query("SELECT conv_id, count(*) AS n, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS history FROM conversations GROUP BY conv_id")
def chat_messages(t):
    rows = operations.chat_history(t("conversations"))
    said = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return rows.select("conv_id", F.size("messages").cast("long").alias("n"), sha(F.array_join(said, "\n")).alias("history"))


@query("SELECT conv_id, sha256(string_agg(text, ' ' ORDER BY turn)) AS transcript FROM conversations GROUP BY conv_id")
def transcript_join(t):
    return operations.assembled(t("conversations"), "conv_id", "turn", "text").select("conv_id", sha(F.col("text")).alias("transcript"))


@query("SELECT CAST(r_regionkey AS INT) AS attempt, least(1.0::DOUBLE * pow(2.0::DOUBLE, r_regionkey * 2), 60.0::DOUBLE) AS delay_s FROM region")
def backoff_schedule(t):
    return t("region").select(F.col("r_regionkey").cast("int").alias("attempt"), operations.backoff_delay(F.col("r_regionkey") * 2 + 1).alias("delay_s"))


@query("SELECT count(*) FILTER (event_type <> 'error') AS hits, count(*) FILTER (event_type = 'error') AS misses, " + _half_up("(count(*) FILTER (event_type <> 'error') / CAST(count(*) AS DOUBLE))", 4) + " AS hit_ratio FROM events")
def cache_hit_ratio(t):
    c = t("events").agg(F.count_if(F.col("event_type") != "error").alias("hits"), F.count_if(F.col("event_type") == "error").alias("misses"))
    return c.select("hits", "misses", operations.hit_ratio(F.col("hits"), F.col("misses")).alias("hit_ratio"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(t):
    """An extension of ours: the streaming count, run over a table."""
    return rolling.windowed_counts(t("events"))
