"""A corpus pipeline of five stages over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.llm import queries as llm
from penumbra.llm.budgets import mix
from penumbra.llm.jaccard import keep_one
from penumbra.llm.ring import shard_rows
from penumbra.llm.shared import settle, table, unused
from penumbra.llm.suffixes import remove_contaminated
from penumbra.llm.toxicity import score

#: Documents of this score or more are rejected as toxic.
TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network doesn't reject. Null and empty texts stay unless the network's base score rejects them."""
    network = llm.toxicity_network(docs, table(spark, sf_dir, "labels"))
    (name,) = unused(docs, "toxicity")
    return score(docs, network, name=name).filter(F.col(name) < TOXIC).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), the one of the least id.

    Documents of null id or without words stay, as they link with nothing.
    """
    return keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts hold none and stay."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mix of 80 % of the tokens towards the target weights, each document at most once.

    Null languages and sources are leaves of their own. Columns of any name stay
    as they are.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", "lang", "source", llm.domain_of().alias("domain"))
    return mix(rows, ["domain", "lang", "source"], llm.mixing_weights(), share=0.8, max_epochs=1, seed=11).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot, which replace columns of those names."""
    text = F.coalesce("text", F.lit(""))
    return shard_rows(docs, [F.col("doc_id")], [F.crc32(text.cast("binary")), F.octet_length(text)], n_shards=8)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
    ("sharding", sharding),
]

#: SQL can express neither the network nor the budgets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's documents are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
