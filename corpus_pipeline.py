"""The corpus pipeline: quality rules, near copies, repeated passages, source weights, packed sequences.

Each stage is (spark, docs, sf_dir) -> DataFrame; all but the last keep the columns of `documents`. No stage can be
expressed in SQL as a whole, so the tests hold the first three against a brute-force version.

Null, empty and short texts: rejected by the first stage. Null ids: kept, never an earlier copy. Ties and repeated rows: one
of each group of copies stays. Very long texts: whole. Empty table: empty result. Extra columns, whatever their names:
handed through by all stages but the last, which returns pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import mixing, packing, quality, simhash, substring
from factloom.llm.common import materialize, read_table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.cut_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(docs, TOKENIZER)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
