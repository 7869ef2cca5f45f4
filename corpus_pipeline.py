"""Cleaning and encoding a corpus: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again for the next. All but the last return the columns of
documents (doc_id, text, lang, source, n_chars).

1. Language ID: documents without a letter, or whose best language has under half
   of the posterior, go.
2. Line dedup: later copies of line runs are cut from the texts; a document whose
   lines are all copies goes, one that had no line with a word stays.
3. Near duplicates: of each class of similar texts the one with the least id stays.
4. Decontamination: documents with a window of a benchmark item go.
5. Byte-level BPE: ids of the texts, and whether they decode to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import bpe, langid, lines, similar, winnow
from veritrail.runtime import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SURE = 0.5
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    path = tokenizers.path(VOCABULARY)
    found = langid.identify(docs.select(*COLUMNS), langid.learn(docs, path), path)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SURE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(docs.select(*COLUMNS))
    return cut.filter("n_lines = 0 OR n_removed < n_lines").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnow.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    coded = bpe.encode_decode(docs.select("doc_id", "text"), tokenizers.path(VOCABULARY), tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "n_tokens", bpe.ids_array().alias("token_ids"), same.alias("round_trip"))


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encode", encode),
]

#: No SQL: the language model and the encoding have none; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
