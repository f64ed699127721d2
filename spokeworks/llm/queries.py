"""The registered queries: each operator over its whole table, with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeworks.llm import (
    alignment,
    conversations,
    exact_search,
    language,
    line_dedup,
    mixing,
    near_vectors,
    ngram_join,
    packing,
    surrogates,
    token_counts,
    toxicity,
    tree_search,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, by: int):
    """Remainder of the checksum of an id as text; null ids have none."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token counts where it begins."""
    return token_counts.attribute_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), "start"
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumnsRenamed({"_lines": "n_lines", "_removed": "n_removed"})


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learnt from labelled documents that aren't held out."""
    learn = docs.where(remainder("doc_id", 3) != 1)
    return toxicity.train(toxicity.learn_rows(learn, table(spark, sf_dir, "labels")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", F.size("segments").alias("n_segments")
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    model = language.train(docs.where(remainder("doc_id", 4) != 2), vocabulary)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: The key is a parameter of the operator; this one makes runs of the query comparable.
SURROGATE_KEY = b"surrogates of the registered query"


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.anonymised(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return found.select("doc_id", "text", F.size("kinds").alias("n_entities"), "kinds")


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_attribution": op1_token_attribution,
        "op2_embedding_near_dedup": op2_embedding_near_dedup,
        "op3_source_mix": op3_source_mix,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_line_dedup": op5_line_dedup,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_toxicity": op7_toxicity,
        "op8_language_id": op8_language_id,
        "op9_pii_surrogates": op9_pii_surrogates,
        "op10_nearest_vectors": op10_nearest_vectors,
        "op11_exact_top_k": op11_exact_top_k,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_tokenizer_alignment": op13_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mix": mixing.ORACLE}
