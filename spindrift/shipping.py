"""What executors need from the driver: the shared folder, files in it and this package."""

from __future__ import annotations

import hashlib
import io
import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. One of its own only on a local master, where all tasks run on this machine; a cluster must name one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.match(r"local(\[.*\])?$", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="spindrift-checkpoints-")
        context.setCheckpointDir(named)
        current = context.getCheckpointDir()
    return current.rstrip("/")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared folder with all that is in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's setting by which the files of a shuffle go with the action that made them.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Plans that are made within delete what they shuffled as their action ends, instead of at some collection of garbage; the setting is restored."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def listed(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Names of the folders in a folder that start so, in order; none where it does not exist."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith(prefix))


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a file into the shared folder under a name that stands for its contents; returns its path."""
    context = spark.sparkContext
    kind = context._jvm.org.apache.hadoop.fs.Path
    path = kind(f"{shared_folder(spark)}/{name}")
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not system.exists(path):
        own = kind(f"{path.toString()}.{os.getpid()}")
        out = system.create(own, True)
        out.write(bytearray(data))
        out.close()
        if not system.rename(own, path):
            system.delete(own, False)
    return path.toString()


#: Bytes of a batch that goes to a Python worker, unless the session says otherwise: batches are held several times over, in and outside of the heap.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shipped(spark: SparkSession) -> SparkSession:
    """Gives this package to the Python workers of every executor, later ones too; once for a context. Bounds batches of long texts."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if not getattr(context, "_spindrift_shipped", False):
        root = Path(__file__).resolve().parent
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for p in sorted(root.rglob("*.py")):
                # One date for all entries, so that equal sources are equal bytes.
                z.writestr(zipfile.ZipInfo(f"{root.name}/{p.relative_to(root)}"), p.read_bytes())
        data = held.getvalue()
        context.addPyFile(put(spark, f"{root.name}-{hashlib.sha256(data).hexdigest()[:16]}.zip", data))
        context._spindrift_shipped = True
    return spark
