"""From raw documents to packed training sequences, stage by stage over whole tables.

Every stage takes documents (doc_id, text, lang, source, n_chars, and any more columns, whatever their names) and, but
for the last, returns the same columns. Null ids, texts, labels and sources, empty and very long texts, repeated rows
and rows that share an id are kept, changed or dropped as each stage says; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evtrace.llm import language, line_templates, near_dedup, packing, personal
from evtrace.llm.common import settle, settle_texts
from evtrace.llm.queries import packing_tokenizer


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fused evidence gives a language; lang becomes that language.

    A null, empty or letterless text has none and goes; a null label or source is no evidence; repeated rows stay alike;
    without any labelled row all go.
    """
    told = language.of_documents(docs).where("not rejected")
    return told.withColumn("lang", F.col("language")).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines whose template recurs across documents; n_chars is counted anew.

    A null text stays null, with 0 characters; of documents that share a template the smallest id keeps it, null ids
    last; rows that share id and text lose the same lines.
    """
    return _counted(line_templates.drop_recurring_lines(docs)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8; the smallest id stays.

    Null and blank texts are no duplicates and stay; of rows that share an id all stay or go together; rows without id go
    only with a kept copy under another id.
    """
    return near_dedup.keep_first(docs, words=5, similarity=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind; n_chars is counted anew; a null text stays null."""
    return _counted(settle_texts(personal.redact(docs))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a null or empty text is the end id alone."""
    return packing.pack(docs, packing_tokenizer())


STAGES = [
    ("language", identify_language),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Tokens, signatures and trained weights are beyond SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
