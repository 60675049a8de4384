"""One query an operator, over its whole table with production parameters, and SQL where SQL expresses it."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasift.llm import chat_format, decontaminate, html_extract, lattice_lm, license_scan, line_dedup, ngram_jaccard, quality_classifier, quality_rules, source_mix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicate_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_measures(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    done = chat_format.format_conversations(turns.unionByName(extra))
    read = done.select("conv_id", "n_turns", "formatted", chat_format.parse_turns(F.col("formatted")).alias("turns"), F.transform("loss_spans", lambda s: F.substr("formatted", s.start + 1, s.length)).alias("loss"))
    read = read.withColumn("loss_text", F.array_join(F.transform("loss", chat_format.unescape), ""))
    return read.select(
        "conv_id", "n_turns",
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken_by_document(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l') as body, replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c') as head from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, body)) as turns_sha256,
  coalesce(cast(sum(length(text)) filter (where role = 'assistant') as bigint), 0) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, body) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(head) + length(body) + 15) as bigint) as formatted_chars
from e group by conv_id
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def fold(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % n


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    weights = quality_classifier.train(docs, labels)
    return quality_classifier.score_quality(docs, weights).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


#: A public subword vocabulary; its folder can be set.
VOCABULARY = os.environ.get("STRATASIFT_TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 10) != 0).alias("train"))
    return lattice_lm.score_texts(docs, VOCABULARY)


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_quality_rules": op2_quality_rules,
    "op3_chat_format": op3_chat_format,
    "op4_html_extract": op4_html_extract,
    "op5_line_dedup": op5_line_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_lattice_lm": op9_lattice_lm,
    "op10_source_mix": op10_source_mix,
}
ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.ORACLE_SQL,
    "op3_chat_format": OP3_SQL,
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
    "op10_source_mix": source_mix.ORACLE_SQL,
}
