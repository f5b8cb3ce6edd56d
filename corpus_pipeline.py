"""From raw documents to packed training windows: filter, join near copies, decontaminate, mask secrets, pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from payrisk.llm import decontaminate, jaccard, packing, quality, secrets
from payrisk.llm.common import read_table, remove, store
from payrisk.llm.queries import WORD_BPE, WORD_END


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the rules learned from ``labels``; nothing learned rejects without labels.

    A null or empty text has no words and goes; very long texts are counted whole; repeated rows are judged each.
    """
    return quality.keep_good(docs, quality.learn(docs, read_table(spark, sf_dir, "labels")))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of documents that a similarity of 0.8 of their five-word shingles links.

    Texts without words are linked with nothing and stay; of repeated rows one stays.
    """
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of ``benchmark``; those that consist of them for the most part go.

    Null and empty texts stay; a very long text is streamed whole. Without items all stay.
    """
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by its kind. Null and empty texts stay as they are."""
    return secrets.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in one window of 2048, mixed by source. A null text has its end token only."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE), WORD_END)


STAGES = [
    ("quality rules", keep_good),
    ("jaccard join", join_near_copies),
    ("decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("packing", packed),
]

# The learned rules, the guess cost and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage stored goes as soon as the next one is stored. The last one's input stays."""
    docs, earlier = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if earlier:
            remove(earlier)
        earlier = docs
    return STAGES[-1][1](spark, docs, sf_dir)
