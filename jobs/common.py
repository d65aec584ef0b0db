"""What the jobs share: their command line, and tables that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table that is broadcast; a larger one is joined by a shuffle.
SMALL = 100_000


def options(argv: list[str] | None, config: Path, what: str) -> dict:
    """The config file (``--config``, by default the one beside the job) with what the command line says in its place: ``--name value`` for each of its names."""
    known = argparse.ArgumentParser(add_help=False)
    known.add_argument("--config", default=str(config))
    path, rest = known.parse_known_args(argv)
    values = json.loads(Path(path.config).read_text())
    parser = argparse.ArgumentParser(description=what, parents=[known])
    for name, value in values.items():
        parser.add_argument(f"--{name}", default=value, type=int if isinstance(value, int) else str, required=value == "")
    found = vars(parser.parse_args(rest))
    found.pop("config")
    return found


def main(argv: list[str] | None, job: str, config: Path, run: Callable, what: str) -> None:
    """Runs a job in a session of its own, which is stopped whatever happens."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    found = options(argv, config, what)
    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        run(spark, **found)
    finally:
        spark.stop()


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by its schema; an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def joined(left: DataFrame, small: DataFrame, on: str | Column, how: str) -> DataFrame:
    """A join that broadcasts ``small`` only where it is counted to have at most ``SMALL`` narrow rows."""
    return left.join(F.broadcast(small) if small.limit(SMALL + 1).count() <= SMALL else small, on, how)
