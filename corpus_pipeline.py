"""The corpus pipeline: each stage takes (spark, docs, sf_dir), and its result, written as Parquet, is the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import fmdecon, gsaca, packing, simhash, toxcnn
from matchloom.llm.common import stash, table
from matchloom.llm.tokens import default_vocabulary

END_ID = 0
#: Bytes of a passage that repeats: some thirty words, so that one of over 50 words is found whatever its words.
PASSAGE = 200


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's threshold. The classifier learns from the labelled documents of its input."""
    model = toxcnn.train(toxcnn.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return toxcnn.keep_clean(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, Jaccard similarity of 0.8 at least."""
    return simhash.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of PASSAGE bytes that repeat."""
    return gsaca.remove(docs, PASSAGE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark."""
    return fmdecon.remove(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the packed sequences."""
    return packing.pack_sequences(packing.tokenized(docs, default_vocabulary(), END_ID))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontamination", decontamination), ("packing", pack)]

#: SQL expresses neither a trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
