"""Approximate nearest neighbours by an inverted file: every vector lies in the cell of its nearest centre, a query reads a few cells."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.vectors import as_double
from ..shipping import shared_folder, shipped
from ..sources import tables
from . import pairs, semantic

#: The centres are fitted on so many vectors at most, in the order of a hash of the id; all vectors are indexed. Rounds of the fit.
SAMPLE, ROUNDS = 20_000, 10
#: How many cells a query reads is measured on the sample: as many as give this share of the nearest so many of so many of its vectors.
RECALL, NEAREST, TRIED = 0.95, 10, 200


#: How far bounds are moved apart for what rounding may take, in radians and as a share of a length.
SLACK = 1e-6


@dataclass(frozen=True)
class Cells:
    """Vectors with their cell, in a folder for each, the centres, how many cells a query reads, and what the vectors of each cell are within.

    ``reach`` has for each cell its number of vectors, the greatest angle and the greatest distance to the centre; ``zones`` (cell, and for each column of
    ``ZONES`` that vectors have its least and greatest value) is a table of few rows.
    """

    vectors: DataFrame
    centres: np.ndarray
    probes: int
    state: str = ""
    reach: np.ndarray | None = None
    zones: DataFrame | None = None


#: Columns by which a search may be filtered, whose least and greatest values are kept for each cell.
ZONES = ("dokumentart", "datum", "label")


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(len(flat), -1)


def _sample(vectors: DataFrame, id_: str, sample: int) -> np.ndarray:
    rows = vectors.where("embedding is not null and size(embedding) > 0").orderBy(F.xxhash64(id_), id_).limit(sample).select(F.transform("embedding", lambda v: v.cast("float")).alias("embedding")).toArrow()
    return _unit(_matrix(rows.column(0))) if rows.num_rows else np.zeros((0, 1), dtype=np.float32)


#: Rows of a sample that meet all centres at once, so that the driver holds no product of both.
_ROWS = 2_048


def _nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[k : k + _ROWS] @ c.T).argmax(axis=1) for k in range(0, len(x), _ROWS)])


def centres(x: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of at most ``cells`` cells by spherical k-means."""
    if not len(x):
        return np.zeros((1, 1), dtype=np.float32)
    c = x[: max(1, min(cells, len(x)))].copy()
    for _ in range(ROUNDS):
        own = _nearest_centre(x, c)
        held = np.bincount(own, minlength=len(c)) > 0
        for k in range(c.shape[1]):
            c[:, k] = np.where(held, np.bincount(own, weights=x[:, k], minlength=len(c)), c[:, k])
        c = _unit(c)
    return c


def probes_for(x: np.ndarray, c: np.ndarray, recall: float) -> int:
    """How many cells hold ``recall`` of the nearest of some vectors of a sample, by the sample itself."""
    if len(x) < 2:
        return len(c)
    own, asked = _nearest_centre(x, c), x[:: max(1, len(x) // TRIED)]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :NEAREST]
    order = np.argsort(np.argsort(-(asked @ c.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(order, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


#: Bytes of a batch of vectors that are repeated for each of their cells.
_BATCH = 8 << 20


def _slices(batch: pa.RecordBatch, times: int, dims: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts that are still bounded once each row is repeated for so many cells."""
    step = max(1, _BATCH // (8 * max(1, times) * (dims + 4)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def placed(vectors: DataFrame, known: np.ndarray, probes: int = 1, column: str = "embedding") -> DataFrame:
    """``vectors`` with ``cell``, a row for each of the ``probes`` nearest cells; a null or empty vector is in cell -1."""
    shipped(vectors.sparkSession)
    at = vectors.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in batches for part in _slices(b, min(probes, len(known)), known.shape[1])):
            values = b.column(at)
            sound = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(values), known.shape[1]), False).to_numpy(zero_copy_only=False))
            rows, cells = np.setdiff1d(np.arange(b.num_rows), sound), []
            cells.append(np.full(len(rows), -1))
            if len(sound):
                near = _unit(np.nan_to_num(_matrix(values.take(pa.array(sound))))) @ known.T
                n = min(probes, len(known))
                best = np.argpartition(-near, n - 1, axis=1)[:, :n]
                rows, cells = np.concatenate([rows, np.repeat(sound, n)]), [*cells, best.ravel()]
            taken = b.take(pa.array(rows.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(cells).astype(np.int32))], names=[*taken.schema.names, "cell"])

    return vectors.mapInArrow(run, StructType([*vectors.schema.fields, StructField("cell", IntegerType())]))


def _measured(rows: DataFrame, known: np.ndarray) -> DataFrame:
    """``rows(embedding, cell)`` with ``angle`` and ``reach``: how far each vector is from its centre as an angle and as a distance; all the way where it is not finite."""
    at, cell = rows.columns.index("embedding"), rows.columns.index("cell")
    known = known.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column(cell).to_numpy(zero_copy_only=False)
            sound = np.flatnonzero(cells >= 0)
            angle, reach = np.zeros(b.num_rows), np.zeros(b.num_rows)
            if len(sound):
                flat = b.column(at).take(pa.array(sound)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x, c = flat.reshape(len(sound), -1), known[cells[sound]]
                with np.errstate(all="ignore"):
                    cos = (x * c).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (c * c).sum(axis=1))
                    far = np.sqrt(((x - c) ** 2).sum(axis=1))
                angle[sound] = np.where(np.isfinite(cos), np.arccos(np.clip(cos, -1, 1)), np.pi)
                reach[sound] = np.where(np.isfinite(far), far, np.inf)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(angle), pa.array(reach)], names=[*b.schema.names, "angle", "reach"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("angle", DoubleType()), StructField("reach", DoubleType())]))


_NAMED = "part int, state string, probes int, schema string"
_OWN = ("cell", "angle", "reach", "segment", "part")


def _part(vectors: DataFrame, folder: str, id_: str, known: np.ndarray, number: int, segment: int) -> None:
    """A part of the vectors in folders by cell, and what each of its cells is within."""
    spark = vectors.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = _measured(placed(vectors.drop(*_OWN), known), known).withColumn("segment", F.lit(segment).cast("long"))
    # By ranges of (cell, id), so that a very large cell fills several tasks.
    rows.repartitionByRange(parts, "cell", id_).sortWithinPartitions("cell", id_).write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors/part={number}")
    own = spark.read.schema(_with_own(vectors.drop(*_OWN).schema)).parquet(f"{folder}/vectors").where(F.col("part") == number)
    zones = [f(F.col(c)).alias(f"{name}_{c}") for c in ZONES if c in vectors.columns for f, name in ((F.min, "least"), (F.max, "most"))]
    own.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle"), F.max("reach").alias("reach"), *zones).coalesce(1).write.mode("overwrite").parquet(f"{folder}/bounds/part={number}")


def _with_own(schema: StructType) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL("angle double, reach double, segment long, part int, cell int").fields])


def write(vectors: DataFrame, folder: str, cells: int | None = None, id_: str = "vec_id", recall: float = RECALL, state: str = "", segment: int = 0) -> None:
    """Indexes every row; about the square root of their number of cells, unless told. ``state`` and ``segment`` are kept with it for the caller."""
    spark, named = vectors.sparkSession, tables.load(vectors.sparkSession, f"{folder}/parts")
    number = 0 if named is None else 1 + max(r["part"] for r in named.collect())
    x = _sample(vectors, id_, SAMPLE)
    known = centres(x, cells or max(1, int(vectors.count() ** 0.5)))
    _part(vectors, folder, id_, known, number, segment)
    probes = probes_for(x, known, recall)
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(known)], "cell int, centre array<float>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres/part={number}")
    tables.replace(spark.createDataFrame([(number, state, probes, vectors.drop(*_OWN).schema.json())], _NAMED).coalesce(1), f"{folder}/parts")


def append(vectors: DataFrame, folder: str, id_: str = "vec_id", state: str = "", segment: int = 0) -> None:
    """Adds vectors in the cells of the centres that are there; what was written is not written again. A run that breaks off is overwritten by the next."""
    spark = vectors.sparkSession
    own, named = read(spark, folder), sorted(tables.load(spark, f"{folder}/parts").collect(), key=lambda r: r["part"])
    number = named[-1]["part"] + 1
    _part(vectors.select(*[f.name for f in StructType.fromJson(json.loads(named[0]["schema"])).fields]), folder, id_, own.centres, number, segment)
    rows = [*((r["part"], state, r["probes"], r["schema"]) for r in named), (number, state, own.probes, named[0]["schema"])]
    tables.replace(spark.createDataFrame(rows, _NAMED).coalesce(1), f"{folder}/parts")


def read(spark: SparkSession, folder: str) -> Cells | None:
    """The cells in a folder, or None. Its files are listed and its centres read once for each version."""
    version = tables.current(spark, f"{folder}/parts")
    if not version:
        return None
    held = spark.__dict__.setdefault("_spindrift_cells", {})
    known = held.get(folder)
    if known is None or known[0] != version:
        named = sorted(tables.load(spark, f"{folder}/parts").collect(), key=lambda r: r["part"])
        parts = [r["part"] for r in named]
        vectors = spark.read.schema(_with_own(StructType.fromJson(json.loads(named[0]["schema"])))).parquet(f"{folder}/vectors").where(F.col("part").isin(parts)).drop("angle", "reach", "part")
        rows = sorted(spark.read.parquet(f"{folder}/centres/part={parts[0]}").collect(), key=lambda r: r["cell"])
        centre = np.array([r["centre"] for r in rows], dtype=np.float32)
        bounds = spark.read.parquet(*[f"{folder}/bounds/part={p}" for p in parts])
        reach = np.zeros((len(centre), 3))
        # A row for each cell and part.
        for r in bounds.where("cell >= 0").collect():
            reach[r["cell"]] = reach[r["cell"], 0] + r["n"], max(reach[r["cell"], 1], r["angle"]), max(reach[r["cell"], 2], r["reach"])
        known = version, Cells(vectors, centre, named[0]["probes"], named[-1]["state"], reach, bounds)
        held[folder] = known
    return known[1]


def _bounds(index: Cells, q: np.ndarray, metric: str) -> np.ndarray:
    """For each query and cell a distance that no vector of the cell is nearer than."""
    q, c, held = q.astype(np.float64), index.centres.astype(np.float64), index.reach[:, 0] > 0
    if metric == "l2":
        squares = (q * q).sum(axis=1)[:, None] - 2 * q @ c.T + (c * c).sum(axis=1)
        away = np.sqrt(np.maximum(squares, 0))
        least = np.maximum(away * (1 - SLACK) - SLACK - index.reach[:, 2] * (1 + SLACK), 0)
    else:
        with np.errstate(all="ignore"):
            cos = (q @ c.T) / np.sqrt((q * q).sum(axis=1)[:, None] * (c * c).sum(axis=1))
        angle = np.where(np.isfinite(cos), np.arccos(np.clip(cos, -1, 1)), 0)
        least = 1 - np.cos(np.maximum(angle - index.reach[:, 1] - SLACK, 0))
    return np.where(held, least, np.inf)


def _able(index: Cells, may: Column | None) -> np.ndarray:
    """Which cells can hold a row that a filter keeps, by ``may`` over their least and greatest values (``least_c``, ``most_c``)."""
    if may is None:
        return index.reach[:, 0] > 0
    able = np.zeros(len(index.centres), dtype=bool)
    able[[r["cell"] for r in index.zones.where(may).where("cell >= 0").select("cell").distinct().collect()]] = True
    return able


def nearest_filtered(index: Cells, query: Sequence[float], limit: int, keep: Column, metric: str = "cosine", may: Column | None = None, id_: str = "vec_id") -> DataFrame:
    """The ``limit`` nearest of the rows that ``keep`` holds for, exactly as ``semantic.nearest`` filters before its search, from the cells that can hold one.

    Cells are read in the order of the least distance that their vectors can have: first as many as hold twice ``limit`` rows, then twice as many, until
    ``limit`` rows were found; then once more those that can hold a nearer row than the last of these.
    """
    least = np.where(_able(index, may), _bounds(index, np.array([list(query)], dtype=np.float64), metric)[0], np.inf)
    order = [int(c) for c in np.argsort(least, kind="stable") if np.isfinite(least[c])]
    found, at, step = None, 0, 1 + int(np.searchsorted(np.cumsum(index.reach[order, 0]), 2 * limit))
    while at < len(order):
        own = order[at : at + step]
        near = semantic.nearest(index.vectors.where(F.col("cell").isin(own)).drop("cell", "segment"), query, limit, metric, keep, "before", id_)
        # A few rows, told by the limit, so that the next cells can be chosen.
        both = near if found is None else found.unionByName(near).orderBy("distance", id_).limit(limit)
        rows = both.collect()
        found, at = index.vectors.sparkSession.createDataFrame(rows, both.schema), at + len(own)
        last = rows[-1]["distance"] if len(rows) >= limit else np.inf
        left = sum(1 for c in order[at:] if least[c] <= last)
        order, step = order[: at + left], left if len(rows) >= limit else 2 * step
    if found is None:
        found = semantic.nearest(index.vectors.where("false").drop("cell", "segment"), query, limit, metric, None, "before", id_)
    return found


def nearest_filtered_per_query(index: Cells, queries: DataFrame, limit: int, keep: Column, metric: str = "cosine", may: Column | None = None, id_: str = "vec_id", places: int | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank) of ``nearest_filtered`` for each of ``queries(query_id, q)``, in two rounds.

    In the first each query reads the cells nearest to it by bound; the last distance of its ``limit`` rows tells which others can hold a nearer one, and the
    second reads those alone; a query that found fewer reads all cells that can hold a row that ``keep`` holds for.
    """
    able, spark, probes = _able(index, may), queries.sparkSession, index.probes
    asked = checkpointed(queries.select("query_id", as_double(F.col("q")).alias("q")).where(F.size("q") == index.centres.shape[1]))

    def cells(rows: DataFrame, choose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """A row for each query of ``rows(query_id, q, last)`` and each cell that ``choose`` marks by bounds and last distances."""
        own = replace(index, vectors=None, zones=None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for b in _slices(b, len(own.centres), own.centres.shape[1]):
                    q = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    least = np.where(able, _bounds(own, q, metric), np.inf)
                    row, cell = np.nonzero(choose(least, b.column(2).fill_null(np.inf).to_numpy(zero_copy_only=False)))
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(row)).columns[:2], pa.array(cell.astype(np.int32))], names=["query_id", "q", "cell"])

        shipped(spark)
        return rows.mapInArrow(run, StructType([*rows.schema.fields[:2], StructField("cell", IntegerType())]))

    def first(least: np.ndarray, _: np.ndarray) -> np.ndarray:
        place = np.argsort(np.argsort(least, axis=1, kind="stable"), axis=1)
        return (place < probes) & np.isfinite(least)

    def found(asked: DataFrame) -> DataFrame:
        return pairs.nearest(index.vectors.where(keep).select(id_, "embedding", "cell"), asked, limit, metric, id_, places)

    probed = checkpointed(found(cells(asked.withColumn("last", F.lit(None).cast("double")), first)))
    # Rounded distances may hide half a unit of their last place.
    room = F.lit(0.0 if places is None else 10.0**-places)
    last = probed.groupBy("query_id").agg(F.when(F.count("*") >= limit, F.max("distance") + room).alias("last"))
    more = cells(asked.join(last, "query_id", "left").select("query_id", "q", "last"), lambda least, last: (least <= last[:, None]) & np.isfinite(least) & ~first(least, last))
    both = probed.drop("rank").unionByName(found(more).drop("rank"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_))).where(F.col("rank") <= limit)


def nearest(index: Cells, query: Sequence[float], limit: int, metric: str = "cosine", keep: Column | None = None, mode: str = "before", id_: str = "vec_id", probes: int | None = None) -> DataFrame:
    """``semantic.nearest`` among the vectors of the cells nearest to the query; other cells are not read."""
    q = _unit(np.array([list(query)], dtype=np.float32))
    cells = np.argsort(-(q @ index.centres.T)[0], kind="stable")[: probes or index.probes].tolist()
    return semantic.nearest(index.vectors.where(F.col("cell").isin([int(c) for c in cells])).drop("cell", "segment"), query, limit, metric, keep, mode, id_)


def nearest_per_query(index: Cells, queries: DataFrame, limit: int, metric: str = "cosine", id_: str = "vec_id", probes: int | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank) for many queries ``(query_id, q)``: each meets its cells by one join."""
    asked = placed(queries.select("query_id", as_double(F.col("q")).alias("q")), index.centres, probes or index.probes, "q")
    return pairs.nearest(index.vectors.select(id_, "embedding", "cell"), asked, limit, metric, id_)
