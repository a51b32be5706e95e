"""Training-corpus pipeline: STAGES in order, each a call of one operator; run() applies them to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import toxicity as toxic_texts
from docspark.llm.common import written
from docspark.llm.contamination import drop_contaminated
from docspark.llm.exact import drop_exact
from docspark.llm.jaccard import drop_near
from docspark.llm.packing import pack
from docspark.llm.queries import table, tokenizer


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more by the lexicon learned from the labelled ones go."""
    return toxic_texts.drop_toxic(docs, toxic_texts.learn(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays."""
    return drop_exact(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of 0.8 or more of their five-word shingles the one with the smallest id stays."""
    return drop_near(docs, words=5, num=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents that are left, placed in sequences of 2048."""
    return pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The stages learn, cluster and pack: no SQL form. The tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all documents; every stage is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
