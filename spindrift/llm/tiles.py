"""Splits large groups into bounded tiles, so that no task holds a whole group.

A group of at most ``limit`` rows is one tile. A larger one is dealt by a hash into
blocks of about ``limit`` rows, and tile (i, j) holds the blocks i and j; every pair of rows
of the group meets in exactly one tile. Nothing is dropped: a large group takes more tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, partitions, with_small


def dealt(rows: DataFrame, keys: list[str], member: str, limit: int, drop_single: bool = True) -> DataFrame:
    """``rows`` with tile (long) and side (0 or 1), dealt by (keys, tile) and sorted by them.

    In tile (i, j), i < j, side 0 is block i and side 1 block j, and only pairs across count;
    in (i, i) all are on side 0 and all pairs count. ``rows`` should be a checkpoint or
    cheap to read again; groups of one row have no pairs and are left out.
    """
    sizes = rows.groupBy(*keys).count()
    large = checkpointed(sizes.where(F.col("count") > limit).select(*[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("count") / limit).cast("long").alias("_blocks")))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    joined = with_small(rows, large, on, "left").drop(*[f"_{k}" for k in keys])
    blocks = F.coalesce("_blocks", F.lit(1))
    own = F.pmod(F.xxhash64(member), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_other")
    out = joined.withColumn("_own", own).select("*", other)
    tile = F.least("_own", "_other") * F.lit(1 << 31) + F.greatest("_own", "_other")
    out = out.withColumn("tile", tile).withColumn("side", (F.col("_own") > F.col("_other")).cast("int")).drop("_own", "_other", "_blocks")
    return out.repartition(partitions(rows.sparkSession), *keys, "tile").sortWithinPartitions(*keys, "tile")


def whole_tiles(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows (the last may be smaller) that never cut a tile."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = tile_starts(table, keys)
        if len(starts) > 1:
            yield table.slice(0, int(starts[-1]))
            rest = table.slice(int(starts[-1]))
            held, count = rest.to_batches(), rest.num_rows
        else:
            held = table.to_batches()
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def tile_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in [*keys, "tile"]:
        values = table.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)
