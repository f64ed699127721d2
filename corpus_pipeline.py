"""From raw documents to packed training sequences, stage by stage.

Each stage takes all that the one before it kept, written as Parquet and read
again, so a lost executor costs work of one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeworks.llm import line_dedup, mixing, ngram_join, packing, queries, toxicity
from spokeworks.operators.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, by labels of some of them.

    Labels are those of documents that are there, and not of held-out ones. Columns, null
    texts and equal rows stay as they are.
    """
    return toxicity.without_toxic(docs, queries.toxicity_model(spark, docs, sf_dir))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines are cut out; documents that lose all their lines with words go.

    Null, empty and blank texts lose nothing and stay. ``n_chars`` is counted again for texts
    that lost lines.
    """
    _, removed = line_dedup.count_names(docs)
    found = line_dedup.without_repeats(docs).where((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    again = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return found.select(
        *(again.cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, kind in docs.dtypes)
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id.

    Documents without words or without an id stay; of rows that share an id one does.
    """
    return ngram_join.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it; null and empty texts count no words."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in the sequences; a null or empty text is an end token."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]

#: The toxicity model and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
