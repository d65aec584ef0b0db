"""The nearest rows of many queries: tiles of queries and rows that meet as products of matrices, so that no pair is a row of a plan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.vectors import as_double
from ..shipping import shipped

#: Bytes of one side of a tile, numbers of one product, and pairs that are measured at once.
TILE_BYTES, PRODUCT, PAIRS = 8 << 20, 1 << 21, 1 << 17
#: Components outside of this are measured pair by pair: products of them could overflow, or lose what the bound of the others leaves out.
ODD = 1e-100, 1e100


def _folded(a: np.ndarray, b: np.ndarray, squares: bool) -> np.ndarray:
    """Sums over components in their order, as Spark folds arrays: of products, or of squares of differences."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += np.square(a[:, k] - b[:, k]) if squares else a[:, k] * b[:, k]
    return total


def _is_odd(x: np.ndarray) -> np.ndarray:
    size = np.abs(x)
    return ~((size == 0) | ((size > ODD[0]) & (size < ODD[1]))).all(axis=1)


def _candidates(q: np.ndarray, x: np.ndarray, limit: int, metric: str, room: float, same: tuple[np.ndarray, np.ndarray] | None):
    """(i of q, j of x) by strips of queries: all pairs that can be among the ``limit`` nearest of a query, told by products and what their rounding may take."""
    err = 8 * (x.shape[1] + 8) * np.finfo(float).eps
    odd_q, odd_x, xx, qq = _is_odd(q), _is_odd(x), _folded(x, x, False), _folded(q, q, False)
    step = max(1, PRODUCT // max(1, len(x)))
    for at in range(0, len(q), step):
        own = slice(at, min(at + step, len(q)))
        least = q[own] @ x.T
        if metric == "l2":
            sums = qq[own, None] + xx
            most = (1 + err) * sums - 2 * least
            least = (1 - err) * sums - 2 * least
        else:
            least = 1 - least / (np.sqrt(qq[own])[:, None] * np.sqrt(xx)) - err
            most = least + 2 * err
        most[:, odd_x] = np.inf
        most[np.isnan(most)] = np.inf
        no = None if same is None else same[0][own, None] == same[1]
        if no is not None:
            most[no] = np.inf
        last = np.partition(most, limit - 1, axis=1)[:, limit - 1] if limit < len(x) else np.full(len(most), np.inf)
        last = np.square(np.sqrt(np.maximum(last, 0)) + room) * (1 + err) if metric == "l2" else last + room
        with np.errstate(invalid="ignore"):
            may = (least <= last[:, None]) | ~np.isfinite(last)[:, None] | odd_x | odd_q[own, None]
        i, j = np.nonzero(may if no is None else may & ~no)
        yield i + at, j


def _best(i: np.ndarray, j: np.ndarray, d: np.ndarray, place: np.ndarray, limit: int, room: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of measured pairs those that can be among the ``limit`` first of a query: by distance, then place of the id; if distances will be rounded, a few more."""
    order = np.lexsort((place[j], d, i))
    i, j, d = i[order], j[order], d[order]
    rank = lambda new: np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
    new = np.ones(len(i), dtype=bool)
    new[1:] = i[1:] != i[:-1]
    by_query = rank(new)
    if not room:
        keep = by_query < limit
    else:
        # Of equal distances the first ids are enough; others count up to where rounding may bring them level with the last.
        equal = new.copy()
        equal[1:] |= ~((d[1:] == d[:-1]) | (np.isnan(d[1:]) & np.isnan(d[:-1])))
        last = np.full(int(i.max()) + 1 if len(i) else 0, np.inf)
        at = by_query == limit - 1
        last[i[at]] = d[at]
        keep = (rank(equal) < limit) & ((by_query < limit) | (d <= last[i] + room) | ~np.isfinite(last[i]))
    return i[keep], j[keep], d[keep]


def tile_nearest(q: np.ndarray, x: np.ndarray, place: np.ndarray, limit: int, metric: str, room: float, same: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i of q, j of x, distance): what can be among the ``limit`` nearest of each query. Distances are folded in doubles, as Spark's columns have them.

    ``place`` orders the ids of x; pairs whose numbers in ``same`` are equal do not count.
    """
    out = []
    with np.errstate(all="ignore"):
        xn, qn = np.sqrt(_folded(x, x, False)), np.sqrt(_folded(q, q, False))
        for i, j in _candidates(q, x, limit, metric, room, same):
            d = np.empty(len(i))
            for at in range(0, len(i), PAIRS):
                p = slice(at, at + PAIRS)
                a, b = q[i[p]], x[j[p]]
                if metric == "l2":
                    d[p] = np.sqrt(_folded(a, b, True))
                else:
                    norms = xn[j[p]] * qn[i[p]]
                    # A distance from a vector without length is null and left out.
                    d[p] = np.where(norms == 0, -np.inf, 1.0 - _folded(a, b, False) / norms)
            if metric != "l2":
                keep = d != -np.inf
                i, j, d = i[keep], j[keep], d[keep]
            out.append(_best(i, j, d, place, limit, room))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def nearest(rows: DataFrame, queries: DataFrame, limit: int, metric: str = "cosine", id_: str = "vec_id", places: int | None = None, other: bool = False, block: int | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the ``limit`` nearest of ``rows(id, embedding, cell)`` for each of ``queries(query_id, q, cell)`` among the rows of its cells, by distance (rounded to ``places``), then id.

    Both sides of a cell are dealt into blocks of bounded bytes (``block`` queries at most) and each tile, a block of either, is one product of matrices in one
    task. What can still be among a query's nearest leaves it. With ``other`` a row of the query's own id does not count.
    """
    spark, room = shipped(rows.sparkSession), 0.0 if places is None else 10.0**-places
    rows = rows.select(F.col(id_).alias("id"), as_double(F.col("embedding")).alias("e"), "cell").where(F.forall("e", lambda v: v.isNotNull()))
    queries = queries.select("query_id", as_double(F.col("q")).alias("q"), "cell").where(F.forall("q", lambda v: v.isNotNull()))
    if other:
        rows, queries = rows.where("id is not null"), queries.where("query_id is not null")
    sizes = [t.groupBy("cell").agg(F.count("*").alias(n), F.max(F.size(c)).alias(f"{n}_dims")) for t, c, n in ((rows, "e", "n"), (queries, "q", "m"))]
    # A row for each cell: these are as many as the root of the rows, or one.
    held = F.ceil(F.lit(TILE_BYTES / 8) / F.greatest("n_dims", "m_dims", F.lit(1)))
    dealt = sizes[0].join(sizes[1], "cell").select("cell", F.ceil(F.col("n") / held).alias("a_blocks"), F.ceil(F.col("m") / (F.least(held, F.lit(block)) if block else held)).alias("b_blocks"))
    dealt = spark.createDataFrame(dealt.collect(), dealt.schema)
    tiles = dealt.agg(F.coalesce(F.sum(F.col("a_blocks") * F.col("b_blocks")), F.lit(0))).first()[0]
    # Cells of few rows share a task.
    parts = max(1, min(int(tiles), max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(tiles) // 8)))
    many = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    x = rows.join(F.broadcast(dealt), "cell").select("id", "e", "cell", F.pmod(F.xxhash64("id"), "a_blocks").alias("a"), many("b_blocks").alias("b"))
    y = queries.join(F.broadcast(dealt), "cell").select("query_id", "q", "cell", many("a_blocks").alias("a"), F.pmod(F.xxhash64("query_id"), "b_blocks").alias("b"))
    keys = ["cell", "a", "b"]
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField(id_, rows.schema["id"].dataType), StructField("distance", DoubleType())])

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        found = []
        if t.num_rows and s.num_rows:
            t, s = t.combine_chunks(), s.combine_chunks()
            dims = [pc.list_value_length(u.column(c)).to_numpy() for u, c in ((t, "e"), (s, "q"))]
            for n in np.intersect1d(*dims):
                own, asked = (u.take(pa.array(np.flatnonzero(k == n))) for u, k in ((t, dims[0]), (s, dims[1])))
                e, q = (u.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(u.num_rows, int(n)) for u, c in ((own, "e"), (asked, "q")))
                ids = pc.rank(own.column("id"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
                same = None
                if other:
                    at = pc.fill_null(pc.index_in(asked.column("query_id").cast(own.column("id").type), value_set=own.column("id").combine_chunks()), -1).to_numpy()
                    same = np.where(at < 0, -1, ids[at]), ids
                i, j, d = tile_nearest(q, e, ids, limit, metric, room, same)
                found.append([asked.column("query_id").take(pa.array(i)), own.column("id").take(pa.array(j)), pa.chunked_array([pa.array(d)])])
        columns = [pa.chunked_array([c for f in found for c in f[k].chunks], type=ty) for k, ty in enumerate((s.schema.field("query_id").type, t.schema.field("id").type, pa.float64()))]
        return pa.table(columns, names=["query_id", id_, "distance"])

    met = x.repartition(parts, *keys).groupBy(*keys).cogroup(y.repartition(parts, *keys).groupBy(*keys)).applyInArrow(run, schema)
    if places is not None:
        met = met.withColumn("distance", F.round("distance", places))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_))).where(F.col("rank") <= limit)
