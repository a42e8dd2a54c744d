"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to
the shared folder and read again as the next stage's `docs`. All stages but the last return
the columns of `documents`.

ORACLE_SQL is None: the Jaccard join, the suffix automaton and the learned mixing weights have no
SQL form; tests/llm/test_models.py holds the rules against op9, the join, the decontamination and the
copies of the mixing against plain versions, and checks the order and sizes of the shards.

Defined cases: rows with a NULL text have no words and go in the first stage; repeated rows
stand or fall together; an empty table passes through all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldpulse.llm import decontaminate, jaccard_join, mixing, quality_rules, sharding
from fieldpulse.llm.registry import Query, ready, table
from fieldpulse.session import materialize

SHARDS = 24


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    ready(spark)
    return quality_rules.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every group linked by shingle similarity of 0.8 or more."""
    ready(spark)
    return jaccard_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark passages, unchanged."""
    ready(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their mixing rate gives copies."""
    ready(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", mixing.domain_of_labels().alias("domain"))
    return mixing.draw(docs, labels)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    ready(spark)
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality rules", good_texts),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole `documents` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERY = Query(run, ORACLE_SQL)
