"""Nearest neighbours by exact distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, l2_distance
from . import pairs

DISTANCES = {"l2": l2_distance, "cosine": cosine_distance}


def distances(vectors: DataFrame, query: DataFrame | Sequence[float], metric: str = "cosine", id_: str = "vec_id") -> DataFrame:
    """``vectors`` with column ``distance`` to one query vector: a literal, or a one-row frame with column ``q``."""
    measure = DISTANCES[metric]
    if isinstance(query, DataFrame):
        near = vectors.join(F.broadcast(query.select("q")))
        return near.withColumn("distance", measure(F.col("embedding"), F.col("q"))).drop("q")
    return vectors.withColumn("distance", measure(F.col("embedding"), F.lit([float(x) for x in query])))


def nearest(vectors: DataFrame, query: DataFrame | Sequence[float], limit: int, metric: str = "cosine", keep: Column | None = None, mode: str = "before", id_: str = "vec_id") -> DataFrame:
    """The ``limit`` nearest rows by (distance, id), null distances left out.

    ``mode`` says when ``keep`` filters: ``before`` the search, which is exact, or ``after`` the nearest five
    times ``limit``, which may return fewer.
    """
    rows = vectors if keep is None or mode == "after" else vectors.where(keep)
    near = distances(rows, query, metric, id_).where("distance is not null")
    if keep is not None and mode == "after":
        near = near.orderBy("distance", id_).limit(5 * limit).where(keep)
    return near.orderBy("distance", id_).limit(limit)


def nearest_per_query(vectors: DataFrame, queries: DataFrame, limit: int, metric: str = "cosine", id_: str = "vec_id", block: int | None = None, places: int | None = None, other: bool = False) -> DataFrame:
    """(query_id, vec_id, distance, rank): the ``limit`` nearest rows of each query ``(query_id, q)``, by distance (rounded to ``places``), then id.

    Every query is held against all rows, in tiles of both (``pairs.nearest``). With ``other`` the row of a query's own id does not count.
    """
    whole = F.lit(0).alias("cell")
    return pairs.nearest(vectors.select(id_, "embedding", whole), queries.select("query_id", "q", whole), limit, metric, id_, places, other, block)
