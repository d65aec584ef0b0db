"""Raw records as JSON lines, read with a fixed schema: a folder for each kind and term, in it one for each harvest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import listed, remove

RAW = (
    "id string, dokumentart string, dokumentnummer string, drucksachetyp string, titel string, datum string, wahlperiode int, herausgeber string,"
    " aktualisiert string, text string, fundstelle struct<dokumentart:string, datum:string, pdf_url:string>"
)
#: A harvest's folder: its number, which grows with each harvest of any kind.
_HARVEST = r"/harvest-(\d{9})/[^/]+$"


def parsed(record: Column) -> Column:
    return F.from_json(record, RAW)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records with ``seq``, by which the later of two versions is the greater.

    It is the number of the harvest (0 for files that lie in none), the file's name, and the place in the file, so it needs no
    global sort and no clock. Lines that are no JSON objects are left out.
    """
    rows = spark.read.schema(RAW + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(path)
    harvest = F.coalesce(F.expr(f"try_cast(regexp_extract(_metadata.file_path, '{_HARVEST.replace(chr(92), chr(92) * 2)}', 1) as int)"), F.lit(0))
    order = F.struct(harvest.alias("harvest"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.withColumn("seq", order).where("id is not null").drop("_corrupt")


def write(records: DataFrame, raw: str, kind: str = "alle", term: int | None = None, since: str | None = None) -> str:
    """Adds a harvest of a kind and term as a folder of its own; a full one (no ``since``) then replaces the former of the same kind and term.

    Those are deleted when the new one is complete, so a harvest that fails leaves what was there. Returns its folder.
    """
    spark, own = records.sparkSession, f"{raw.rstrip('/')}/{kind}-{'alle' if term is None else term}"
    before = [f"{folder}/{name}" for folder in listed(spark, raw, "") for name in listed(spark, f"{raw.rstrip('/')}/{folder}", "harvest-")]
    number = 1 + max((int(name.rsplit("-", 1)[1]) for name in before), default=0)
    target = f"{own}/harvest-{number:09d}"
    former = listed(spark, own, "harvest-")
    records.write.json(target)
    for name in former if since is None else []:
        remove(spark, f"{own}/{name}")
    return target
