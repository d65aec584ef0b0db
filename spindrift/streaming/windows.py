"""Request counters and decisions over a stream, with late data bounded by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import shipped


def pattern(path: str) -> str:
    """A path as a pattern of itself: by a pattern a file stream takes a single file as well as a folder."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return path if set(path) & set("*?[{") else f"{folder}/{{{name}}}" if folder else f"{{{name}}}"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a file or a folder of event files; ``ts`` has no zone in them and is read as UTC."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(pattern(path)).withColumn("ts", F.col("ts").cast("timestamp"))


def counts(requests: DataFrame, width: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """(kennung, fenster, anzahl); state of a window is dropped once it is ``late`` behind the newest request."""
    w = requests.withWatermark("ts", late).groupBy("kennung", F.window("ts", width).alias("w"))
    return w.agg(F.count("*").alias("anzahl")).select("kennung", F.col("w.start").alias("fenster"), "anzahl")


def decisions(requests: DataFrame, limit: int, width: str = "1 minute", keep_seconds: int = 3600) -> DataFrame:
    """(event_id, kennung, fenster, zuruecksetzen, anzahl, erlaubt, verbleibend) of each of the streamed ``requests(event_id, kennung, ts)`` as it comes.

    The count of a key's window is state that outlives the batch, so how requests are split into batches makes no difference as long as those of a window come in the order of
    (ts, event_id) from one batch to the next; within one they are put in it. A window's state is dropped ``keep_seconds`` after its end by the watermark, and a request that is later than that
    behind the newest has no decision. A limit of 0 or less allows all. One task holds what one key sends in one window of a batch.
    """
    w = requests.withWatermark("ts", f"{keep_seconds} seconds").withColumn("_w", F.window("ts", width)).select("kennung", F.col("_w.start").alias("fenster"), F.col("_w.end").alias("zuruecksetzen"), "event_id", "ts")

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        before = state.get[0] if state.exists else 0
        state.update((before + len(rows),))
        end = int(rows["zuruecksetzen"].iloc[0].timestamp() * 1000)
        state.setTimeoutTimestamp(max(end + 1000 * keep_seconds, state.getCurrentWatermarkMs() + 1))
        n = pd.Series(range(before + 1, before + len(rows) + 1), index=rows.index, dtype="int64")
        left = (limit - n).clip(lower=0).astype("Int64") if limit > 0 else pd.Series([pd.NA] * len(rows), index=rows.index, dtype="Int64")
        yield pd.DataFrame({"event_id": rows["event_id"], "kennung": key[0], "fenster": rows["fenster"], "zuruecksetzen": rows["zuruecksetzen"], "anzahl": n, "erlaubt": (n <= limit) | (limit <= 0), "verbleibend": left})

    shipped(requests.sparkSession)
    out = "event_id long, kennung string, fenster timestamp, zuruecksetzen timestamp, anzahl long, erlaubt boolean, verbleibend long"
    return w.groupBy("kennung", "fenster").applyInPandasWithState(run, out, "anzahl long", "append", GroupStateTimeout.EventTimeTimeout)


def write_once(counted: DataFrame, folder: str, checkpoint: str):
    """Processes what is there and ends; finished windows are appended as Parquet, exactly once."""
    return counted.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
