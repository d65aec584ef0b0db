"""Parquet tables of the store: written under a new version, whole or some of their buckets, then named by a pointer that is replaced."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNKS = "chunk_id long, document_id long, position int, text string, redner string, rolle string, fraktion string"
FEEDBACK = "zeitpunkt timestamp, hilfreich boolean, frage string, suchbegriffe string, antwort string, belegte_dokumente array<string>, anzahl_stellen int, anmerkung string"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Bytes for each core below which a table is dealt out for dear expressions.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores. A file of one row group is one task however many cores are idle; large tables are left as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df


#: A pointer's file: ``CURRENT-`` and a number. It names the versions that make up the table, one a line.
_POINTER = "CURRENT-"


def _system(spark: SparkSession, folder: str):
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


def _pointers(spark: SparkSession, folder: str) -> list[str]:
    return folders(spark, folder, _POINTER)


def folders(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Names in a folder that start so; none where it does not exist."""
    system, kind = _system(spark, folder)
    if not system.exists(kind(folder)):
        return []
    return sorted(n for s in system.listStatus(kind(folder)) if (n := s.getPath().getName()).startswith(prefix))


def current(spark: SparkSession, folder: str) -> list[str]:
    """The versions that make up a table; none if there is no table."""
    folder = folder.rstrip("/")
    found = _pointers(spark, folder)
    return _named(spark, folder, found[-1]) if found else []


def _named(spark: SparkSession, folder: str, pointer: str) -> list[str]:
    return [x for x in _text(spark, f"{folder}/{pointer}").split("\n") if x]


def _text(spark: SparkSession, path: str) -> str:
    """A small file, read without a job."""
    system, kind = _system(spark, path)
    stream = system.open(kind(path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str) -> None:
    system, kind = _system(spark, path)
    out = system.create(kind(path), True)
    out.write(bytearray(text.encode()))
    out.close()


def load(spark: SparkSession, folder: str, only: Iterable[int] | None = None) -> DataFrame | None:
    """The table, by the schema that was written beside it, so that no file is opened to plan and an empty one is known too.

    Of a table in buckets ``only`` some can be loaded; of others all is.
    """
    folder, versions = folder.rstrip("/"), current(spark, folder)
    if not versions:
        return None
    schema = StructType.fromJson(json.loads(_text(spark, f"{folder}/{versions[0].split('/')[0]}.schema")))
    wanted = None if only is None else {f"bucket={k}" for k in only}
    versions = [v for v in versions if wanted is None or "/" not in v or v.split("/")[1] in wanted]
    return spark.read.schema(schema).parquet(*[f"{folder}/{v}" for v in versions]) if versions else spark.createDataFrame([], schema)


def _commit(spark: SparkSession, folder: str, versions: list[str]) -> None:
    """Names the versions by a new pointer: written aside, then renamed to the next number, which nothing else may have taken."""
    folder = folder.rstrip("/")
    system, kind = _system(spark, folder)
    found = _pointers(spark, folder)
    number = 1 + (int(found[-1].removeprefix(_POINTER)) if found else 0)
    aside, pointer = kind(f"{folder}/_{uuid.uuid4().hex}"), kind(f"{folder}/{_POINTER}{number:012d}")
    _put(spark, aside.toString(), "\n".join(versions))
    if system.exists(pointer) or not system.rename(aside, pointer):
        system.delete(aside, False)
        raise RuntimeError(f"{folder} was written by another job at the same time")
    # The one before stays for readers that have just listed it.
    for name in found[:-1]:
        system.delete(kind(f"{folder}/{name}"), False)


def _write(df: DataFrame, folder: str, partition_by: list[str] | None) -> str:
    version = f"v-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{folder.rstrip('/')}/{version}")
    fields = sorted(df.schema.fields, key=lambda f: f.name in (partition_by or []))
    _put(df.sparkSession, f"{folder.rstrip('/')}/{version}.schema", StructType(fields).json())
    return version


def replace(df: DataFrame, folder: str, partition_by: list[str] | None = None) -> str:
    """Writes a new version and then points to it, so a reader sees the old or the new table whole, also if ``df`` reads it."""
    version = _write(df, folder, partition_by)
    _commit(df.sparkSession, folder, [version])
    return version


def append(df: DataFrame, folder: str, partition_by: list[str] | None = None) -> str:
    """Adds a version to those of a table; what is there is not written again."""
    before = current(df.sparkSession, folder)
    version = _write(df, folder, partition_by)
    _commit(df.sparkSession, folder, [*before, version])
    return version


#: Buckets of a table that is written by them.
BUCKETS = 64


def bucket_of(key: Column) -> Column:
    """The bucket of a row by a key, such as its document's id."""
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(BUCKETS)).cast("int")


def by_buckets(spark: SparkSession, folder: str) -> bool:
    """Whether a table is in buckets; one that does not exist can be."""
    return all("/" in v for v in current(spark, folder))


def _put_buckets(df: DataFrame, folder: str, bucket: Column) -> list[str]:
    spark, version, folder = df.sparkSession, f"v-{uuid.uuid4().hex}", folder.rstrip("/")
    df.withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{folder}/{version}")
    _put(spark, f"{folder}/{version}.schema", df.schema.json())
    return [f"{version}/{name}" for name in folders(spark, f"{folder}/{version}", "bucket=")]


def replace_buckets(df: DataFrame, folder: str, bucket: Column, touched: Iterable[int]) -> list[str]:
    """Replaces the ``touched`` buckets by ``df``, which has rows of these alone; files of the others are neither read nor written. A table that is not in buckets is replaced whole."""
    spark, folder = df.sparkSession, folder.rstrip("/")
    gone = {f"bucket={k}" for k in touched}
    kept = [v for v in current(spark, folder) if v.split("/")[1] not in gone] if by_buckets(spark, folder) else []
    found = kept + _put_buckets(df, folder, bucket)
    if not found:  # no row at all: a table of one empty bucket
        version = _write(df.limit(0), folder, None)
        found = [f"{version}/"]
    _commit(spark, folder, found)
    return found


def append_buckets(df: DataFrame, folder: str, bucket: Column) -> list[str]:
    """Adds rows to the buckets of a table (or a version to one that is not in buckets); what is there is not written again."""
    spark, folder = df.sparkSession, folder.rstrip("/")
    before = current(spark, folder)
    if not by_buckets(spark, folder):
        return [append(df, folder)]
    found = _put_buckets(df, folder, bucket)
    if found or not before:
        _commit(spark, folder, before + found or [f"{_write(df.limit(0), folder, None)}/"])
    return found


def vacuum(spark: SparkSession, folder: str, grace_hours: float = 24.0) -> list[str]:
    """Deletes versions that no pointer names and that are older than the grace of readers; returns them."""
    folder = folder.rstrip("/")
    system, kind = _system(spark, folder)
    named = {v.split("/")[0] for p in _pointers(spark, folder) for v in _named(spark, folder, p)}
    oldest = time.time() * 1000 - grace_hours * 3_600_000
    gone = [n for s in system.listStatus(kind(folder)) if (n := s.getPath().getName()).startswith("v-") and n.removesuffix(".schema") not in named and s.getModificationTime() <= oldest] if system.exists(kind(folder)) else []
    for name in gone:
        system.delete(kind(f"{folder}/{name}"), True)
    return [n for n in gone if not n.endswith(".schema")]
