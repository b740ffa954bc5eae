"""A corpus pipeline of five operators: each stage takes what the one before kept and decides on all of it.

Toxic documents go; of every group of near copies one document stays; documents that hold a benchmark window go; sources are
mixed to their weights by whole documents, repeated where an epoch is not enough; the mix is placed in eight shards of equal
bytes. All stages but the last return the columns of ``documents`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillspark.llm import decontaminate, jaccard, mixing, sharding, toxicity
from tillspark.session import scratch_path

BATCH = 500  # documents that travel to Python together: a MB or two of text, where the default of 10,000 is many times that
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Bound the whole texts that a task, and its Python worker, hold at once."""
    if not 0 < int(spark.conf.get(_RECORDS)) <= BATCH:
        spark.conf.set(_RECORDS, str(BATCH))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the models are fitted on the labelled ones among ``docs``.

    A null or empty text has the score of no evidence, as a rule below the threshold. Repeated rows are judged alike.
    """
    _small_batches(spark)
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.75 or more.

    Null and empty texts link with nothing and stay. Rows that repeat doc_id and text are one document.
    """
    _small_batches(spark)
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item; null and empty texts stay."""
    _small_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is a source; documents without words fill no target."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix; a null text takes up one byte."""
    return sharding.place(docs, shards=8)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("mixing_sources", mixed),
    ("sharding", sharded),
]

ORACLE_SQL = None  # SQL can't express the fitted models of the first stage; tests/llm hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
