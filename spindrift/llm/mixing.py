"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, partitions, table, with_small

#: Production parameters: targets are counts to this power, seed of the draws.
ALPHA, SEED = 0.5, 17
#: A mean is drawn in equal parts of at most this, each inverted from a table of 0 to so many events.
PART, EVENTS = 16, 96
#: Equal rows are numbered in blocks of so many.
BLOCK = 4096


def uniform(key: Column) -> Column:
    """52 bits of the MD5 of a string, as a double inside (0, 1)."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None, alpha: float, total: int | None, by: str) -> DataFrame:
    """(_by, _parts, _table) for each source: number of equal Poisson parts and the distribution function of one."""
    counts = checkpointed(docs.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n")))
    if weights is None:
        counts = counts.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(float(alpha))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "_key string, _w double")
        counts = counts.join(given, F.col("_by").cast("string").eqNullSafe(F.col("_key")), "left").select("_by", "_n", F.coalesce("_w", F.lit(0.0)).alias("_w"))
    n, w = counts.agg(F.sum("_n"), F.sum("_w")).first()
    aim = float(total if total is not None else n or 0)
    mean = F.lit(aim) * F.col("_w") / F.lit(float(w or 1.0)) / F.col("_n")
    parts = F.greatest(F.ceil(mean / PART), F.lit(1)).cast("int")

    def grown(acc: Column, k: Column) -> Column:
        p = acc["p"] * acc["m"] / k
        return F.struct(acc["m"].alias("m"), p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["t"], F.array(acc["c"] + p)).alias("t"))

    m = mean / parts
    start = F.struct(m.alias("m"), F.exp(-m).alias("p"), F.exp(-m).alias("c"), F.array(F.exp(-m)).alias("t"))
    steps = F.sequence(F.lit(1), F.lit(EVENTS))
    return checkpointed(counts.select("_by", parts.alias("_parts"), F.aggregate(steps, start, grown)["t"].alias("_table")))


def row_key(columns: Mapping[str, Column]) -> Column:
    """SHA-256 of some columns, in hex: each by name order as its length and value, or ``-`` for null; a text by its own SHA-256."""

    def part(name: str, c: Column) -> Column:
        value = F.sha2(c.cast("binary"), 256) if name == "text" else c.cast("string")
        return F.coalesce(F.concat(F.lit("+"), F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(n, columns[n]) for n in sorted(columns)]).cast("binary"), 256)


def distinct_rows(docs: DataFrame, by: str) -> DataFrame:
    """(_c0, _c1, ..., own_by, own_key, number) of every row of ``docs``: its columns by place, its source, key (doc_id, source and text) and, in decimal, its number among rows of its key.

    Equal rows are numbered from 0, and one whose key no other has is 0; where rows of a key differ in other columns, the number is led by the row's own digest, so that
    none takes another's. Keys are counted without their rows. Rows of repeated keys become one for each task before they are shuffled and are numbered from
    their count, in blocks, so that a row that makes up a third of the table is in no task more often than a block has numbers.
    """
    held = {n: f"_c{k}" for k, n in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{n}`").alias(c) for n, c in held.items()])
    key = row_key({n: F.col(held[n]) for n in {"doc_id", "text", by} & set(held)})
    rows = rows.select("*", F.col(held[by]).alias("own_by"), key.alias("own_key"))
    whole = F.xxhash64(*held.values())
    repeated = rows.groupBy("own_key").agg(F.count("*").alias("n"), F.min(whole).alias("lo"), F.max(whole).alias("hi")).where("n > 1")
    repeated = checkpointed(repeated.select(F.col("own_key").alias("again"), F.expr("lo <> hi").alias("differ")))
    none = F.lit("0").alias("number")
    if repeated.isEmpty():
        return rows.select("*", none)
    on = F.col("own_key") == F.col("again")
    once = with_small(rows, repeated, on, "left_anti").select("*", none)
    # Equal rows are combined where they are read, before they meet their numbers.
    own_row = row_key({n: F.col(c) for n, c in held.items()})
    many = with_small(rows, repeated, on, "inner").groupBy("own_key", "differ", own_row.alias("own_row")).agg(F.first(F.struct(*held.values(), "own_by")).alias("held"), F.count("*").alias("n"))
    blocks = many.select("held.*", "own_key", "differ", "own_row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("n") - 1, F.lit(BLOCK)))).alias("block"))
    dealt = blocks.repartition(partitions(docs.sparkSession), "own_key", "own_row", "block")
    place = F.explode(F.sequence(F.col("block") * BLOCK, F.least((F.col("block") + 1) * BLOCK, F.col("n")) - 1))
    placed = dealt.select(*held.values(), "own_by", "own_key", "differ", "own_row", place.alias("place"))
    number = F.when(F.col("differ"), F.concat("own_row", F.lit("/"), F.col("place").cast("string"))).otherwise(F.col("place").cast("string"))
    return once.unionByName(placed.select(*held.values(), "own_by", "own_key", number.alias("number")))


def replicated(docs: DataFrame, weights: Mapping[str | None, float] | None = None, *, alpha: float = ALPHA, total: int | None = None, seed: int = SEED, by: str = "source") -> DataFrame:
    """``docs`` with each row as often as its draw says, and columns ``copy_`` (from 1) and ``place_``; rows are not ordered.

    A source's share of the ``total`` (by default as many as there are rows) is its weight by all weights: those given
    (a source without one gets 0), else its count to the power ``alpha``. A row's number of copies is Poisson with mean total *
    share / count, by inversion of a uniform that is hashed from seed, doc_id, source, text and its number among rows that are equal in these, so it depends on
    nothing else, and rows of a null or repeated doc_id, or of equal texts, draw apart. Null is a source of its own. Means of 0
    drop a source: this is a sampling operator. Texts are carried as they are, null, empty or long; other columns stay
    too, but for those named ``copy_`` and ``place_``; columns of maps are not taken. An empty table gives no rows.
    """
    names = [n for n in docs.columns if n not in ("copy_", "place_")]
    docs = docs.select(*[F.col(f"`{n}`") for n in names])
    known = rates(docs, weights, alpha, total, by)
    d = with_small(distinct_rows(docs, by), known, F.col("own_by").eqNullSafe(known["_by"]), "left", rows=10_000)
    key = F.concat(F.lit(f"{seed}/"), F.col("own_key"), F.lit("/"), F.col("number"), F.lit("/"))

    # One-element transforms bind the uniform once, else it would be hashed for each entry of the table.
    def below(k: Column) -> Column:
        return F.transform(F.array(uniform(F.concat(key, k.cast("string")))), lambda u: F.size(F.filter(F.col("_table"), lambda c: c < u)))[0]

    draw = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda n, k: n + below(k))
    d = d.withColumn("_count", draw).where("_count > 0")
    held = [f"_c{k}" for k in range(len(names))]
    d = d.select(*held, key.alias("own_key"), F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("own_copy"))
    place = F.conv(F.substring(F.md5(F.concat(F.lit("place/"), F.col("own_key"), F.col("own_copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    return d.select(*[F.col(c).alias(n) for c, n in zip(held, names, strict=True)], F.col("own_copy").alias("copy_"), place.alias("place_"))


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, **options) -> DataFrame:
    """The replicated rows in one global random order: by place, a hash of seed, row, number and copy."""
    return replicated(docs, weights, **options).orderBy("place_", "doc_id", "copy_")


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, copy, place, text_sha256 of every copy, in shuffled order. Whole documents are replicated and shuffled."""
    docs = table(spark, sf_dir, "documents")
    return mixed(docs).select("doc_id", "source", F.col("copy_").alias("copy"), F.col("place_").alias("place"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def _part_sql(value: str) -> str:
    return f"coalesce('+' || length({value}) || ':' || {value}, '-')"


QUERY_SQL = f"""
with n as (select source, count(*) as n from documents group by source),
r as (select source, (select count(*) from documents) * sqrt(n) / (select sum(sqrt(n)) from n) / n as mean from n),
p as (select *, greatest(ceil(mean / {PART}), 1)::int as parts from r),
t as (select *, list_transform(range({EVENTS} + 1), lambda k: list_sum(list_transform(range(k + 1), lambda j: exp(-mean / parts + j * ln(mean / parts) - lgamma(j + 1))))) as cdf from p where mean > 0),
k as (select *, sha256(text) as text_sha256, sha256({" || ".join(_part_sql(v) for v in ("doc_id::varchar", "source", "sha256(text)"))}) as own,
  sha256({" || ".join(_part_sql(v) for v in ("doc_id::varchar", "lang", "n_chars::varchar", "source", "sha256(text)"))}) as whole from documents),
m as (select *, '{SEED}/' || own || '/' || case when min(whole) over (partition by own) <> max(whole) over (partition by own) then whole || '/' else '' end || (row_number() over (partition by own, whole) - 1) || '/' as key from k),
d as (select doc_id, m.source, text_sha256, key,
  list_sum(list_transform(range(1, parts + 1), lambda k: len(list_filter(cdf, lambda c: c < (('0x' || md5(key || k)[1:13])::bigint + 0.5) / {1 << 52}))))::int as copies
  from m join t on m.source is not distinct from t.source),
e as (select *, unnest(range(1, copies + 1))::int as copy from d)
select doc_id, source, text_sha256, copy, ('0x' || md5('place/' || key || copy)[1:15])::bigint as place from e"""
