"""Counters of captures by windows of event time, over a stream.

Refused captures go to a table of their own, with their reason: one that is more than ten minutes off the time it came in is stale. Accepted
ones are counted by kind in tumbling windows of the time they were captured. State of a window goes when the watermark has passed it. An
accepted capture may be as far behind as ahead of its coming, so the watermark waits for twice that: of captures that come in order
none is left out. Changed windows are put into a store (``sources.store``), where the newest count stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import ingest
from larder.sources.store import Store

SCHEMAS = {"windows": "kind string, start long, n long"}
CAPTURES = f"{ingest.ENVELOPE}, arrival_ord long, ingested_at long"


def counted(accepted: DataFrame, minutes: int = 10, skew_ms: int = ingest.MOST_SKEW_MS) -> DataFrame:
    """window, kind, n of a stream of accepted captures (kind, captured_at)."""
    timed = accepted.select("kind", F.timestamp_millis("captured_at").alias("at")).withWatermark("at", f"{2 * skew_ms} milliseconds")
    return timed.groupBy(F.window("at", f"{minutes} minutes"), "kind").agg(F.count(F.lit(1)).alias("n"))


def windows(spark: SparkSession, folder: str) -> DataFrame:
    """kind, start (milliseconds), n of all windows so far."""
    return Store(spark, f"{folder}/store", SCHEMAS).read("windows").drop("key")


def run(stream: DataFrame, folder: str, rules: DataFrame, minutes: int = 10) -> None:
    """Count all that the stream of ``CAPTURES`` holds now. Refused captures are below ``folder``/refused."""
    judged = ingest.validate_captures(stream, rules, F.col("ingested_at"), carried=("arrival_ord",))
    refused = judged.filter("reason IS NOT NULL").select("arrival_ord", "kind", "reason")
    letters = refused.writeStream.format("parquet").option("path", f"{folder}/refused").option("checkpointLocation", f"{folder}/checkpoint-refused").trigger(availableNow=True).start()

    def put(changed: DataFrame, number: int) -> None:
        start = F.unix_millis("window.start")
        rows = changed.select(F.concat_ws("/", "kind", F.lpad(start.cast("string"), 16, "0")).alias("key"), "kind", start.alias("start"), "n")
        Store(changed.sparkSession, f"{folder}/store", SCHEMAS, number).commit(number, {"windows": rows})

    counts = counted(judged.filter("reason IS NULL"), minutes)
    query = counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint-counts").trigger(availableNow=True).start()
    letters.awaitTermination()
    query.awaitTermination()
