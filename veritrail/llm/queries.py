"""Registered queries of the training-data operators and their DuckDB SQL, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import align, bpe, chat, ctw, divergence, langid, lines, pii, quality, repeats, similar, toxicity, winnow
from veritrail.llm.common import bucket_of_id
from veritrail.runtime import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2(F.col("token_ids").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLES["op5_winnowing"] = winnow.ORACLE


@query
def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.filter_quality(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query
def op10_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


ORACLES["op10_radix_repeats"] = repeats.ORACLE


@query
def op1_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    held = bucket_of_id("doc_id", toxicity.HELD_MOD) == toxicity.HELD
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("segments").alias("n_segments"))


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    vocabulary = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, vocabulary)
    found = langid.identify(docs.select("doc_id", "text"), model, vocabulary)
    return found.select("doc_id", (bucket_of_id("doc_id", langid.HELD_MOD) == langid.HELD).alias("held_out"), "lang_pred", "score")


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar.similar_classes(docs).select(F.col("_id").alias("doc_id"), "class_id", "n_links", "n_grams")


ORACLES["op6_ngram_jaccard"] = similar.ORACLE


@query
def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ctw.score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op2_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLES["op2_line_runs"] = lines.ORACLE


@query
def op9_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations")).drop("result_of")


#: The conversations have no tool messages; for plain ones SQL says the whole result.
ORACLES["op9_tool_linking"] = chat.ORACLE


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    def digest(aligned: DataFrame) -> DataFrame:
        groups = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
        return aligned.withColumn("groups_sha256", groups).drop("groups", "text")

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = map(tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = align.align(docs, *paths, tokenizers.PATTERN, keep=digest)
    return found.select("doc_id", *align.COUNTS, "n_best", "count_sum", "groups_sha256")


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLES["op12_source_divergence"] = divergence.ORACLE


@query
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn(docs))
    base = F.filter("pii", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))
