"""Text cleaning, OCR correction, features and small formatters as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import DEFAULTS, FILE_KINDS
from quillspark.operators.arrow import bounded_batches

#: Characters that scanners put for letter groups.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬀ": "ff", "℔": "lb", "№": "No", "℠": "SM", "™": "TM", "℡": "TEL"}
#: Frequent scanner errors, replaced in this order (Java patterns).
SWAPS = [
    (r"(?<=\d)l(?=\d)", "1"),
    (r"(?<=\d)O(?=\d)", "0"),
    (r"(?<=[a-z])0(?=[a-z])", "o"),
    (r"rn(?=[a-z])", "m"),
    (r"(?<=[a-z])cl(?=[a-z])", "d"),
    (r"(?U)(?:^|(?<=\s))[|](?=\s)", "I"),
    (r"vv", "w"),
]
#: Fixed value: a word.
WORD = r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*"


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def remove_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def collapse_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\w\s]", "")


def clean_text(c: Column, tags: bool = True, control: bool = True, whitespace: bool = True, punctuation: bool = False) -> Column:
    steps = [(tags, strip_tags), (control, remove_control), (whitespace, collapse_whitespace), (punctuation, strip_punctuation)]
    return reduce(lambda x, step: step[1](x) if step[0] else x, steps, c)


def normalize_unicode(c: Column, form: str = "NFC") -> Column:
    """Spark has no such function: an Arrow UDF, which gets only texts that may change. Below U+0300 every text is in NFC, and
    ASCII is in every form. Unknown forms count as NFC. Its batches are bounded, so a worker's memory doesn't follow the texts."""
    if spark := SparkSession.getActiveSession():
        bounded_batches(spark, 1000, 4 << 20)
    form = form if form in ("NFC", "NFD", "NFKC", "NFKD") else "NFC"

    @F.pandas_udf("string")
    def normal(texts):
        return texts.str.normalize(form)

    changes = F.regexp_like(c, F.lit(r"[^\x00-\x{2FF}]" if form == "NFC" else r"[^\x00-\x7F]"))
    return F.coalesce(normal(F.when(changes, c)), c)


def expand_ligatures(c: Column) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), c)


def ocr_swaps(c: Column) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, *rule), SWAPS, c)


def custom_corrections(c: Column, words: dict[str, str]) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), words.items(), c)


def correct_ocr(c: Column, words: dict[str, str] | None = None) -> Column:
    return custom_corrections(ocr_swaps(expand_ligatures(c)), words or {})


def collapse_all(c: Column) -> Column:
    """Each run of white space is one space."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def half_up(c: Column, digits: int) -> Column:
    """Rounding that other engines repeat exactly: floor(x * 10^n + 0.5) / 10^n."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5).cast("double") / scale


#: The measures of features() and their types.
FEATURES = "struct<word_count:bigint,char_count:bigint,char_count_no_spaces:bigint,sentence_count:bigint,avg_word_length:double,reading_time_seconds:double,vocabulary_count:bigint,vocabulary_richness:double,max_word_length:bigint,avg_sentence_length:double>"


def features(c: Column, listed: Column | None = None) -> Column:
    """Ten measures of a text as a struct; all are 0 for an empty text.

    listed: words(c) as a column of its own, so that the pattern runs once over the text; see with_features.
    """
    ws = words(c) if listed is None else listed
    n = F.size(ws).cast("long")
    lengths = F.transform(ws, F.length)
    distinct = F.size(F.array_distinct(F.transform(ws, F.lower))).cast("long")
    marks = F.regexp_count(c, F.lit("[.!?]+")).cast("long")
    sentences = F.when(marks > 0, marks).otherwise(F.when(strip(c) != "", 1).otherwise(0)).cast("long")
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return F.struct(
        n.alias("word_count"),
        F.length(c).cast("long").alias("char_count"),
        F.length(F.replace(c, F.lit(" "), F.lit(""))).cast("long").alias("char_count_no_spaces"),
        sentences.alias("sentence_count"),
        half_up(ratio(total, n), 2).alias("avg_word_length"),
        half_up(n.cast("double") / DEFAULTS.words_per_minute * 60, 1).alias("reading_time_seconds"),
        distinct.alias("vocabulary_count"),
        half_up(ratio(distinct, n), 4).alias("vocabulary_richness"),
        F.coalesce(F.array_max(lengths), F.lit(0)).cast("long").alias("max_word_length"),
        half_up(ratio(n, sentences), 1).alias("avg_sentence_length"),
    )


def with_features(df: DataFrame, column: str = "text", name: str = "features") -> DataFrame:
    """df with the struct of features(). The words are a column of their own, which Spark doesn't put back into each measure,
    so the pattern runs once over a text."""
    listed = df.withColumn("__words", words(F.col(column)))
    return listed.withColumn(name, features(F.col(column), F.col("__words"))).drop("__words")


def truncate_for_model(c: Column, most: int = DEFAULTS.model_chars) -> Column:
    return F.substring(c, 1, most)


def render_prompt(template: str, **values: Column) -> Column:
    """$name and ${name} give way to values, $$ to $; unknown names stay."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\$(?:(\$)|\{?([A-Za-z_]\w*)\}?)", template):
        put = F.lit("$") if m[1] else values.get(m[2])
        if put is not None:
            parts += [F.lit(template[at : m.start()]), put]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def safe_filename(name: Column, filler: str = "_") -> Column:
    out = F.btrim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', filler), F.lit(". "))
    return F.when(out == "", F.concat(F.lit("unnamed_"), F.unix_timestamp().cast("string"))).otherwise(out)


def extension(path: Column) -> Column:
    """Last suffix in small letters; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.].*?(\.[^.]+)$", 1))


def file_kind(ext: Column, which: int) -> Column:
    table = F.create_map(*[F.lit(x) for e, kind in FILE_KINDS.items() for x in (e, kind[which])])
    return F.coalesce(F.try_element_at(table, ext), F.lit(("unknown", "application/octet-stream")[which]))


def size_label(n: Column) -> Column:
    """Bytes whole, KB and MB with one decimal, GB with two; exact halves go to the even digit."""
    x = n.cast("double")
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(x < 1024.0**2, F.format_string("%.1f KB", F.bround(x / 1024, 1)))
        .when(x < 1024.0**3, F.format_string("%.1f MB", F.bround(x / 1024**2, 1)))
        .otherwise(F.format_string("%.2f GB", F.bround(x / 1024**3, 2)))
    )


def size_label_all_units(n: Column, last: str = "PB") -> Column:
    """One decimal at every unit up to the last one, which takes all that is larger; exact halves go to the even digit."""
    x, units = n.cast("double"), ["B", "KB", "MB", "GB", "TB", "PB"]
    top = units.index(last)
    out = F.format_string(f"%.1f {last}", F.bround(x / 1024.0**top, 1))
    for k, unit in reversed(list(enumerate(units[:top]))):
        out = F.when(F.abs(x) < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(x / 1024.0**k, 1))).otherwise(out)
    return out


def timestamp_label(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss")


def percent_label(score: Column) -> Column:
    return F.when(score.isNull(), "—").otherwise(F.format_string("%.0f%%", F.bround(score * 100, 0)))


def type_label(kind: Column) -> Column:
    return F.when(F.coalesce(kind, F.lit("")) == "", "Unknown").otherwise(F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def document_id() -> Column:
    return F.concat(F.lit("doc_"), F.unix_millis(F.current_timestamp()).cast("string"), F.lit("_"), F.substring(F.uuid(), 1, 8))
