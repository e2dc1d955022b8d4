"""Stateful streams over the given tables: each part of a stream is there, in as many files as it has, before the next comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.registered import lists
from larder.sources import tables
from larder.sources.snapshots import scratch, stored
from larder.sources.store import Store
from larder.streaming import followers

#: Memberships that wait in the state of one collection, so that others go through the table; silence that is waited for, and lateness.
HELD, DELAY = 2, "10 minutes"


def _fed(rows: DataFrame, order: str, parts: int, folder: str, run: Callable[[DataFrame], None], event_time: bool = False) -> None:
    """``rows`` come in ``parts`` by ranges of ``order``; ``run`` takes the stream up to what has come."""
    spark = rows.sparkSession
    rows = stored(rows, "fed")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    low, high = low or 0, high or 0
    part = F.least(F.floor((F.col(order) - low) * parts / max(1, high - low)), F.lit(parts - 1))
    own = followers.session(spark, event_time)
    for n in range(parts):
        rows.filter(part == n).write.mode("append").parquet(f"{folder}/in")
        run(own.readStream.schema(rows.schema).parquet(f"{folder}/in"))


def _to_files(found: DataFrame, folder: str) -> None:
    query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def _chains(spark: SparkSession, d: str) -> DataFrame:
    def make() -> DataFrame:
        folder = scratch(spark, "chains")
        _fed(lists.pages(spark, d).drop("captured_at"), "arrival_ord", 3, folder, lambda s: _to_files(followers.follow_chains(s, lists.LIST), folder))
        return spark.read.parquet(f"{folder}/out")

    return tables.once(spark, d, "chains", make)


def f3_stream_page_chain(spark, d):
    return _chains(spark, d).groupBy("run", "list", "segment").agg(F.count(F.lit(1)).alias("pages"), F.bool_or("gap").alias("gap"))


def f4_stream_completion(spark, d):
    return _chains(spark, d).groupBy("run", "list").agg(F.max_by("outcome", "arrival_ord").alias("outcome"))


def f8_stream_silences(spark, d):
    """Events as pages in the order of their time; what their last ten minutes will tell isn't settled yet."""
    folder = scratch(spark, "silences")
    rows = tables.captures(spark, d).select(F.col("viewer_id").alias("run"), "arrival_ord", F.timestamp_millis("captured_at").alias("at"), "captured_at", (F.col("arrival_ord") % 3).alias("items"))
    _fed(rows, "captured_at", 3, folder, lambda s: _to_files(followers.watch_silences(s.drop("captured_at"), ["run"], DELAY), folder), event_time=True)
    return spark.read.parquet(f"{folder}/out")


def f9_stream_memberships(spark, d):
    """Memberships by part of the order number; an order comes with a later part or, if it is pending, not at all."""
    folder = scratch(spark, "memberships")
    none = F.lit(None).cast("long")
    # a line comes at the hundreds of its order, the order itself up to three thousand later
    members = tables.memberships(spark, d).select("collection_id", F.lit("membership").alias("kind"), "external_id", F.col("position").cast("long").alias("position"), (F.col("collection_id") + F.col("position") * 500).alias("ord"))
    known = tables.read(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("collection_id"), F.lit("collection").alias("kind"), none.alias("external_id"), none.alias("position"), (F.col("o_orderkey") + F.col("o_custkey") % 7 * 500).alias("ord"))
    _fed(members.unionByName(known), "ord", 3, folder, lambda s: followers.keep_memberships(s.drop("ord"), folder, most=HELD, hold_ms=1000).awaitTermination())
    store = Store(spark, f"{folder}/store", followers.SCHEMAS)
    return store.read("memberships").select("collection_id", "external_id", "position")


_TICKS = """
e AS (SELECT user_id AS run, event_id AS n, epoch_us(ts) // 1000 AS "at", event_id % 3 AS items FROM events), w AS (SELECT max("at") - 600000 AS mark FROM e),
p AS (SELECT e.*, count(*) FILTER (items > 0) OVER (PARTITION BY run ORDER BY "at", n) AS island, coalesce(lead("at") OVER (PARTITION BY run ORDER BY "at", n), mark + 1) AS till FROM e, w WHERE "at" <= mark),
t AS (SELECT run, n, island, "at" + k * 120000 AS tick FROM (SELECT *, unnest(generate_series(1, least(4, (till - "at" - 1) // 120000))) AS k FROM p)),
r AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY tick, n) AS retries FROM t)
"""
ORACLES = {
    "f3_stream_page_chain": f"WITH {lists._P} SELECT run, list, segment::BIGINT AS segment, count(*) AS pages, bool_or(gap) AS gap FROM h GROUP BY run, list, segment",
    "f4_stream_completion": f"WITH {lists._P} SELECT * FROM outcomes",
    "f8_stream_silences": f"WITH {_TICKS} SELECT run, n AS after, tick AS at, retries::INT AS retries, CASE WHEN retries > 3 THEN 'attention' ELSE 'retrying' END AS state FROM r WHERE retries <= 4",
    "f9_stream_memberships": "SELECT l_orderkey AS collection_id, l_partkey AS external_id, min(l_linenumber)::BIGINT AS position FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY ALL",
}
QUERIES = {name: globals()[name] for name in ORACLES}
