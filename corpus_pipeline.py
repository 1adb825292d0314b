"""A corpus pipeline; each stage's Parquet output is the next one's documents.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``:
quality rules drop rejected documents and frequent lines, the n-gram join leaves one document of each
group, suffix-array dedup cuts later copies of passages of 51 words or more out of the texts,
decontamination drops documents that hold a benchmark item, and packing returns the pieces of the
sequences.

Null, empty and wordless texts fail the quality rules and go there; so do texts of under 50 words. Rows
equal in id and text become one in the n-gram join, rows that share an id only are documents of their own, a
null id or source is a value like any other. Ties fall to the least id, then the least text hash. Other
columns, whatever their names, travel along to the last stage but one. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import decontaminate, ngram_join, packing, quality, suffix_dedup
from cohortloom.operators.scale import remove, scratch_path, temporary_steps

# passages of over 50 words; 51 words are often shorter than the 400 bytes of op9, hardly ever than these
PASSAGE_WORDS = 51
PASSAGE_BYTES, PASSAGE_SEED = 180, 32
# stretches of 329 bytes at most that one anchor's suffix order holds: 1.4 MB
PASSAGE_TEXTS = 4096


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept documents without the lines that too many documents of their host carry."""
    return quality.clean(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates; documents without links all stay."""
    return ngram_join.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; of passages that repeat, the first place keeps the words."""
    return suffix_dedup.clean(
        docs, PASSAGE_BYTES, PASSAGE_WORDS, seed=PASSAGE_SEED, most_texts=PASSAGE_TEXTS
    )


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.clean(docs, items)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their sequence and place."""
    return packing.packed(docs).drop("text_key")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

# token ids of a byte-pair vocabulary are not a SQL expression
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again.

    A stage's own step tables, and the output of the stage before, go as soon as its output is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with temporary_steps(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
