"""Fixed-window counters of requests, and feedback rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..profiles import LIMITS


def key(purpose: Column | str, address: Column, prefix: str = "limit") -> Column:
    """The first 32 hex digits of the SHA-256 of ``{prefix}:{purpose}:{address}``, so that no address is stored."""
    p = F.lit(purpose) if isinstance(purpose, str) else purpose
    return F.substring(F.sha2(F.concat(F.lit(f"{prefix}:"), p, F.lit(":"), address.cast("string")).cast("binary"), 256), 1, 32)


def counts(requests: DataFrame, width: str = "1 minute") -> DataFrame:
    """(kennung, fenster, anzahl) of ``requests(kennung, ts)``."""
    return requests.groupBy("kennung", F.window("ts", width).alias("w")).agg(F.count("*").alias("anzahl")).select("kennung", F.col("w.start").alias("fenster"), "anzahl")


def decisions(requests: DataFrame, limit: int | Column, width: str = "1 minute", order: str = "event_id") -> DataFrame:
    """Each request with fenster, anzahl so far, erlaubt, verbleibend and zuruecksetzen.

    A limit of 0 or less allows all, with verbleibend null. A window of one key is counted by one task:
    windows are short, so what one key sends in one bounds it.
    """
    w = requests.withColumn("_w", F.window("ts", width))
    n = F.row_number().over(Window.partitionBy("kennung", "_w").orderBy("ts", order))
    most = F.lit(limit) if isinstance(limit, int) else limit
    free = most <= 0
    return w.withColumn("anzahl", n).select(
        "*", F.col("_w.start").alias("fenster"), F.col("_w.end").alias("zuruecksetzen"),
        (free | (F.col("anzahl") <= most)).alias("erlaubt"), F.when(~free, F.greatest(F.lit(0), most - F.col("anzahl"))).alias("verbleibend"),
    ).drop("_w")


def decided(requests: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """``decisions`` for ``requests(event_id, purpose, address, ts)`` by the limit of each purpose in a minute; a purpose without one is free."""
    known = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    keyed = requests.withColumn("kennung", key(F.col("purpose"), F.col("address")))
    return decisions(keyed, F.coalesce(F.try_element_at(known, F.col("purpose")), F.lit(0)))


def retained(counted: DataFrame, now: Column, keep: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Windows that are not older than ``keep``."""
    return counted.where(F.col("fenster") >= now - F.expr(keep))


def feedback(raw: DataFrame) -> DataFrame:
    """Valid feedback rows with their texts cut to what is stored: hilfreich given, frage and antwort not blank."""
    filled = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    valid = raw.where(F.col("hilfreich").isNotNull() & filled("frage") & filled("antwort"))
    return valid.withColumns({
        "frage": F.left("frage", F.lit(2000)), "suchbegriffe": F.left("suchbegriffe", F.lit(2000)), "antwort": F.left("antwort", F.lit(20_000)),
        "belegte_dokumente": F.slice(F.coalesce("belegte_dokumente", F.array().cast("array<string>")), 1, 60), "anmerkung": F.nullif(F.left("anmerkung", F.lit(2000)), F.lit("")),
    })
