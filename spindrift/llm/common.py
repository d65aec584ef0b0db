"""Small helpers that every operator of this folder shares."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import remove, shared_folder, shipped, tidied


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which outlives lost executors. What was shuffled for it is deleted once it is written."""
    shared_folder(df.sparkSession)
    with tidied(df.sparkSession):
        # A plan of its own, so that no other one reads these shuffles.
        return df.select("*").checkpoint(eager=True)


def released(*dfs: DataFrame) -> None:
    """Deletes the files of checkpoints that no plan reads any more."""
    for df in dfs:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        remove(df.sparkSession, file.get())


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` by workers that are sure to have this package."""
    shipped(df.sparkSession)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle has here; the cluster sizes it, not the operator."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_small(left: DataFrame, small: DataFrame, on: Column, how: str, rows: int = 100_000) -> DataFrame:
    """Joins by broadcast only if ``small`` is counted to have at most ``rows`` narrow rows, else by a shuffle.

    ``small`` should be cheap to count: a checkpoint or a small aggregate.
    """
    if small.limit(rows + 1).count() <= rows:
        small = F.broadcast(small)
    return left.join(small, on, how)
