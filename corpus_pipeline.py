"""A training corpus from documents: quality rules, line dedup, near-duplicate join, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but
the last return the columns of documents. The mix returns the documents it takes, with the
words it takes of each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasift.llm import decontaminate, line_dedup, ngram_jaccard, quality_rules, source_mix
from stratasift.llm.common import materialise

#: Share of a document's code points (as numerator and denominator) whose loss as repeated lines makes the rest a fragment.
FRAGMENT = (2, 3)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Null and empty texts are rejected."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or nearly, are cut out; n_chars follows the text.

    Documents left without a word go, and so do fragments: documents that lose more than
    FRAGMENT of their code points are near copies of what stands earlier, and what is left
    of them is no document. Later stages would not know them as copies any more.
    """
    cut = line_dedup.dedup_lines(docs)
    whole = F.length("text") + F.col("n_cut")
    left = cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]") & (FRAGMENT[1] * F.col("n_cut") <= FRAGMENT[0] * whole))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of five-word shingles, the smallest doc_id stays.

    Rows of a null doc_id stay. Of the document that stays, each different text stays once.
    """
    found = ngram_jaccard.near_duplicate_components(docs, k=5, num=80, den=100)
    heads = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(heads, "doc_id", "left_semi").withColumn("text__", F.xxhash64("text"))
    named = named.dropDuplicates(["doc_id", "text__"]).drop("text__")
    return named.unionByName(docs.where("doc_id is null"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80% or more of a benchmark item's five-word shingles go."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source_size, target, size, taken."""
    return source_mix.taken_by_document(docs).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontaminate", benchmark),
    ("source_mix", mixture),
]

#: Connected components have no plain SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialise(docs)[0]
    return docs
