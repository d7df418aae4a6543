"""A corpus pipeline over `documents`: language ID, near duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the last adds the shard, the slot in it and what led to them. Language models of compression, the MinHash
join and the latent search have no SQL form, so the whole is tested against brute-force versions of its stages.

Defined results: documents with a null, empty or letterless text go in the first stage, as no language is found. Texts of any length are
read whole. Of near duplicates the smallest doc_id stays; rows without a doc_id stay there and are never taken for contaminated; repeated
rows of one doc_id become one. The mix draws by doc_id (by text without one), so ties and repeats share a fate. An empty table gives
an empty result. Other columns pass through all stages; those named like a column of the shard plan give way in the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, language_id, mixing, ngram_join, sharding
from quillspark.llm._common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those that are rejected go."""
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target weights."""
    return mixing.sample(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
