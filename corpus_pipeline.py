"""Training-data pipeline: quality, toxicity, near duplicates, benchmark passages, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All stages but the last return the columns of documents.

In every stage null texts count as empty, rows without a doc_id are documents of their own (never copies of others), rows of
one doc_id are one document that stays or goes as one where copies are concerned and are judged by their own text
elsewhere; texts of any length are read whole; columns may have any names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, decontaminate, quality, shingles, toxicity
from quillspark.llm.common import discard, scratch, stored
from quillspark.llm.queries import table, tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the neighbours' votes call good."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the chain doesn't call toxic."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group (links: 0.8 or more of five-word shingles, asked of the
    pairs that SimHash with the pigeonring, or else shared minima, bring together)."""
    return shingles.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no benchmark item is found."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left: doc_id, n_tokens and digests of ids and decoded text."""
    return bpe.round_trip_digests(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: Fingerprints, learned models, alignments and BPE are beyond SQL; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over documents. Each stage's output is a table in the shared folder; what else a stage
    wrote, and the table before, go as soon as it is there. The last table stays until quillspark.llm.common.release()."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as keep:
            docs = keep(stored(stage(spark, before, sf_dir), name))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
