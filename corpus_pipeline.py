"""The corpus pipeline: documents become token ids of clean, distinct documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All stages but the last
return the columns of ``documents``.

A stage's plan is made when its result is written, so the stages set the rows of an
Arrow batch and of a batch of the Parquet reader for the session (BATCH_ROWS, if more
or no bound is set) and leave it so.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.bpe import encode_decode
from folioforge.llm.common import materialize, scratch_scope, table
from folioforge.llm.decontaminate import drop_contaminated
from folioforge.llm.exact_dedup import drop_exact_copies
from folioforge.llm.minhash import drop_near_copies
from folioforge.llm.quality import select_good, train

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Executors build Arrow batches of whole texts outside their heap, where memory stays with them;
#: the Parquet reader joins the texts of a batch in one array, which doubles as it grows.
BATCH_ROWS, BATCH_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
READER_KEY = "spark.sql.parquet.columnarReaderBatchSize"


def in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key in (BATCH_KEY, READER_KEY):
            if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
                spark.conf.set(key, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier does not reject."""
    return select_good(docs, train(docs, table(spark, sf_dir, "labels")))


@in_small_batches
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at five-word shingles and 0.8."""
    return drop_near_copies(docs, k=5, percent=80)


@in_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the digests of ids and decoded text."""
    return encode_decode(docs, with_ids=True, digests=True).drop("decoded")


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("tokenize", tokenize)]
#: The classifier is a fitted model and near duplicates are components; the
#: pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_scope(spark):  # what a stage has put aside goes with it
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return docs
