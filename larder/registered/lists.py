"""Runs over paged lists: a user's events are the pages of a run, and each event type is a list of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.operators import ingest
from larder.registered.captures import envelopes
from larder.sources import tables
from larder.sources.snapshots import scratch
from larder.streaming import chains, runs

LIST = ["run", "list"]


def pages(spark: SparkSession, d: str) -> DataFrame:
    """run, list, arrival_ord, request, response, has_more: every fifth page starts again, every eleventh asks for something else, every third ends."""
    n = F.col("arrival_ord")
    before = F.lag("arrival_ord").over(Window.partitionBy("viewer_id", "kind").orderBy("arrival_ord"))
    request = F.when(n % 5 == 0, "0").when(n % 11 == 0, "9").otherwise(before.cast("string"))
    return tables.captures(spark, d).select(F.col("viewer_id").alias("run"), F.col("kind").alias("list"), "arrival_ord", "captured_at", request.alias("request"), n.cast("string").alias("response"), (n % 3 != 0).alias("has_more"))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A list is read from a start up to the next start; an end tells on the pages up to it."""
    start = F.coalesce(F.col("request") == "0", F.lit(True))
    w = Window.partitionBy(*LIST).orderBy("arrival_ord")
    rows = chains.page_segments(pages(spark, d), LIST, ["arrival_ord"], start)
    rows = rows.withColumn("_broken", ~start & ~F.col("request").eqNullSafe(F.lag("response").over(w)))
    upto = Window.partitionBy(*LIST, "segment").orderBy("arrival_ord").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("gap", F.max("_broken").over(upto) | (F.col("segment") == 0)).withColumn("ended", ~F.col("has_more"))
    return runs.list_outcomes(ends, LIST, "ended")


def f2_late_data(spark, d):
    """Captures that come more than ten minutes after their time."""
    rules = spark.createDataFrame([("shop", x) for x in ("click", "view", "purchase", "signup", "scroll", "error")], "platform string, kind string")
    rows = ingest.validate_captures(envelopes(spark, d), rules, F.col("now"), carried=("arrival_ord",))
    return rows.filter("reason = 'stale'").select("arrival_ord")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as the pages of one list."""
    w = Window.partitionBy("viewer_id").orderBy("arrival_ord")
    n = F.col("arrival_ord")
    return tables.captures(spark, d).select(
        "viewer_id", "arrival_ord", "captured_at", (F.col("kind") == "click").alias("start"), n.alias("response"), F.when(n % 7 != 0, F.lag(n).over(w)).alias("request"),
        (n % 3).alias("items"), F.when(n % 5 == 0, 1).otherwise(0).alias("inserted"), (n % 4 == 0).alias("ended"),
    )


def f3_track_page_chain(spark, d):
    by, order = ["viewer_id"], ["arrival_ord"]
    segments = chains.page_segments(_pages(spark, d), by, order, F.col("start"))
    return chains.chain_gaps(segments, by, order, F.col("start"), "request", "response")


def f5_incremental_stop(spark, d):
    return chains.stop_after_known(_pages(spark, d), ["viewer_id"], ["arrival_ord"], "items", "inserted", F.col("ended"))


def f8_detect_stalls(spark, d):
    return chains.stalls(_pages(spark, d), ["viewer_id"], ["arrival_ord"], "captured_at", runs.MOST_SILENCE_MS, "items", runs.MOST_STALL_RETRIES).select("viewer_id", "arrival_ord", "gap_ms", "retries", "state")


def f9_pending_buffer(spark, d):
    """A stream of memberships, and of the orders that they wait for."""
    folder = scratch(spark, "pending")
    members = tables.memberships(spark, d).select("collection_id", F.lit("membership").alias("kind"), "external_id", F.col("position").cast("long").alias("position"), F.col("external_id").alias("arrival_ord"))
    none = F.lit(None).cast("long")
    known = tables.read(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("collection_id"), F.lit("collection").alias("kind"), none.alias("external_id"), none.alias("position"), F.lit(1 << 40).alias("arrival_ord"))
    schema = "collection_id long, kind string, external_id long, position long, arrival_ord long"
    for rows in (members, known):  # each part of the stream is there, in as many files as it has, before the next comes
        rows.write.mode("append").parquet(f"{folder}/in")
        found = runs.hold_memberships(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema("collection_id long, external_id long, position long, outcome string").parquet(f"{folder}/out")


def f4_list_completion(spark, d):
    return _outcomes(spark, d)


def f6_pass_mode(spark, d):
    o = tables.read(spark, d, "orders")
    started = F.unix_date(F.col("o_orderdate").cast("date"))
    asked = o.select(F.col("o_custkey").alias("platform"), F.col("o_orderkey").alias("run"), started.alias("started_at"), F.when(F.col("o_orderkey") % 4 == 0, "full").otherwise("incremental").alias("asked"))
    complete = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("platform"), started.alias("at"))
    return runs.pass_modes(asked, complete).select("platform", "run", "mode")


def f7_collect_seen_ids(spark, d):
    rows = tables.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_returnflag").alias("list")).agg(F.collect_list("l_partkey").alias("ids"))
    return runs.seen_ids(rows, LIST, "ids")


def f10_failure_streaks(spark, d):
    kind = F.when(F.col("arrival_ord") % 5 < 2, "unreadable").when(F.col("arrival_ord") % 5 == 2, "store").otherwise("page")
    return runs.failure_streaks(tables.captures(spark, d).select("viewer_id", "arrival_ord", kind.alias("kind")), ["viewer_id"], "arrival_ord", "kind", {"unreadable": (2, "blocked"), "store": (3, "failed")})


def f11_run_totals(spark, d):
    totals = chains.running_totals(_pages(spark, d), ["viewer_id"], ["arrival_ord"], ["items", "inserted"])
    return totals.select("viewer_id", "arrival_ord", "pages_so_far", "items_so_far", "inserted_so_far")


def f11_page_cap(spark, d):
    """Lines as pages; a flag's lines are one run."""
    pages = tables.read(spark, d, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"))
    return runs.over_cap(chains.running_totals(pages, ["l_returnflag"], ["ord"], []), ["l_returnflag"], "ord")


def f12_absorb_collections(spark, d):
    """A customer's orders name collections: the priority is the id, the status the name."""
    lists = tables.read(spark, d, "orders").select(
        F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("arrival"), F.col("o_orderpriority").alias("id"), F.col("o_orderstatus").alias("name"),
        F.when(F.col("o_totalprice") > 100_000, F.floor("o_totalprice")).alias("declared_total"), (F.col("o_totalprice") > 400_000).alias("has_more"),
    )
    return runs.absorb_collections(lists)


def f13_attribute_pages(spark, d):
    rows = tables.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_suppkey").alias("tab_id"), F.col("l_partkey").alias("page"), F.col("l_returnflag").alias("list"))
    owners = tables.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.min("l_suppkey").alias("tab_id"))
    return runs.attribute_pages(rows, owners, F.col("list") == "N").select("run", "page")


def f14_run_report(spark, d):
    totals = tables.captures(spark, d).groupBy(F.col("viewer_id").alias("run")).agg(F.count(F.lit(1)).alias("pages"))
    return runs.run_report(_outcomes(spark, d), totals)


_EVENTS = """
p AS (SELECT user_id AS viewer_id, event_id AS arrival_ord, (epoch_us(ts) // 1000) AS captured_at, event_type = 'click' AS start, event_id AS response,
             CASE WHEN event_id % 7 <> 0 THEN lag(event_id) OVER w END AS request, event_id % 3 AS items, (event_id % 5 = 0)::INT AS inserted, event_id % 4 = 0 AS ended
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
"""
_P = """
p AS (SELECT user_id AS run, event_type AS list, event_id AS n, CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 11 = 0 THEN 9 ELSE lag(event_id) OVER w END AS request, lag(event_id) OVER w AS before, event_id % 3 = 0 AS ended
      FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)),
s AS (SELECT *, coalesce(request = 0, true) AS start FROM p),
g AS (SELECT *, sum(start::INT) OVER (PARTITION BY run, list ORDER BY n) AS segment FROM s),
h AS (SELECT *, bool_or(NOT start AND request IS DISTINCT FROM before) OVER (PARTITION BY run, list, segment ORDER BY n) OR segment = 0 AS gap FROM g),
outcomes AS (SELECT run, list, CASE WHEN bool_or(ended AND NOT gap) THEN 'complete' WHEN count(*) FILTER (ended AND gap) > 3 THEN 'partial' ELSE 'open' END AS outcome FROM h GROUP BY run, list)
"""

ORACLES = {
    "f2_late_data": "SELECT k AS arrival_ord FROM (SELECT event_id AS k, event_type FROM events) WHERE k % 31 <> 0 AND k % 37 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 AND k % 11 <> 0 AND k % 41 <> 0 AND k % 43 <> 0 AND k % 47 <> 0 AND k % 20 > 10 AND event_type IN ('click', 'view', 'purchase', 'signup', 'scroll', 'error')",
    "f3_track_page_chain": f"WITH {_EVENTS}, s AS (SELECT *, sum(start::INT) OVER w AS segment, lag(response) OVER w AS before FROM p WINDOW w AS (PARTITION BY viewer_id ORDER BY arrival_ord)) SELECT viewer_id, segment::BIGINT AS segment, count(*) AS pages, bool_or((NOT start AND request IS DISTINCT FROM before) OR segment = 0) AS gap FROM s GROUP BY viewer_id, segment",
    "f5_incremental_stop": f"WITH {_EVENTS}, k AS (SELECT *, inserted > 0 OR items = 0 AS resets FROM p), i AS (SELECT *, sum(resets::INT) OVER (PARTITION BY viewer_id ORDER BY arrival_ord) AS island FROM k), t AS (SELECT *, sum((NOT resets)::INT) OVER (PARTITION BY viewer_id, island ORDER BY arrival_ord) AS streak FROM i) SELECT viewer_id, min(arrival_ord) AS stop_at FROM t WHERE streak >= 2 AND NOT ended GROUP BY viewer_id",
    "f8_detect_stalls": f"WITH {_EVENTS}, g AS (SELECT *, lead(captured_at) OVER w - captured_at AS gap_ms, count(*) FILTER (items > 0) OVER w AS island FROM p WINDOW w AS (PARTITION BY viewer_id ORDER BY arrival_ord)), r AS (SELECT *, (sum(coalesce(gap_ms // 120000, 0)) OVER (PARTITION BY viewer_id, island ORDER BY arrival_ord))::BIGINT AS retries FROM g) SELECT viewer_id, arrival_ord, gap_ms, retries, CASE WHEN retries > 3 THEN 'attention' ELSE 'retrying' END AS state FROM r WHERE gap_ms > 120000",
    "f9_pending_buffer": "SELECT l_orderkey AS collection_id, l_partkey AS external_id, min(l_linenumber)::BIGINT AS position, 'applied' AS outcome FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY ALL",
    "f11_run_totals": f"WITH {_EVENTS} SELECT viewer_id, arrival_ord, count(*) OVER w AS pages_so_far, (sum(items) OVER w)::BIGINT AS items_so_far, (sum(inserted) OVER w)::BIGINT AS inserted_so_far FROM p WINDOW w AS (PARTITION BY viewer_id ORDER BY arrival_ord)",
    "f12_absorb_collections": "WITH w AS (SELECT o_custkey AS run, bool_or(o_totalprice > 400000) AS warning FROM orders GROUP BY o_custkey) SELECT run, o_orderpriority AS id, arg_max(o_orderstatus, o_orderkey) AS name, arg_max(floor(o_totalprice)::BIGINT, o_orderkey) FILTER (o_totalprice > 100000) AS declared_total, min(o_orderkey) AS first, 'pending' AS status, any_value(warning) AS warning FROM orders JOIN w ON run = o_custkey GROUP BY run, o_orderpriority",
    "f4_list_completion": f"WITH {_P} SELECT * FROM outcomes",
    "f6_pass_mode": "SELECT o_custkey AS platform, o_orderkey AS run, CASE WHEN o_orderkey % 4 <> 0 AND coalesce(f.at < o_orderdate::DATE, false) THEN 'incremental' ELSE 'full' END AS mode FROM orders LEFT JOIN (SELECT o_custkey, min(o_orderdate::DATE) AS at FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) f USING (o_custkey)",
    "f7_collect_seen_ids": "SELECT DISTINCT l_orderkey AS run, l_returnflag AS list, l_partkey AS external_id FROM lineitem",
    "f10_failure_streaks": """WITH e AS (SELECT user_id AS viewer_id, event_id AS n, CASE WHEN event_id % 5 < 2 THEN 'u' WHEN event_id % 5 = 2 THEN 's' ELSE 'p' END AS k FROM events),
i AS (SELECT *, sum((k = 'p')::INT) OVER (PARTITION BY viewer_id ORDER BY n) AS isl FROM e), c AS (SELECT *, sum((k = 'u')::INT) OVER w AS u, sum((k = 's')::INT) OVER w AS s FROM i WINDOW w AS (PARTITION BY viewer_id, isl ORDER BY n)),
t AS (SELECT viewer_id, n, CASE WHEN k = 'u' AND u = 2 THEN 'blocked' WHEN k = 's' AND s = 3 THEN 'failed' END AS state FROM c) SELECT viewer_id, min(n) AS at, arg_min(state, n) AS state FROM t WHERE state IS NOT NULL GROUP BY viewer_id""",
    "f11_page_cap": "SELECT l_returnflag, ord AS at FROM (SELECT l_returnflag, l_orderkey * 8 + l_linenumber AS ord, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 8 + l_linenumber) AS k FROM lineitem) WHERE k = 3000",
    "f13_attribute_pages": "SELECT l_orderkey AS run, l_partkey AS page FROM lineitem JOIN (SELECT l_orderkey, min(l_suppkey) AS tab FROM lineitem GROUP BY l_orderkey) USING (l_orderkey) WHERE l_returnflag = 'N' AND l_suppkey = tab",
    "f14_run_report": f"WITH {_P} SELECT run, count(*) AS lists, count(*) FILTER (outcome <> 'open') AS done, count(*) FILTER (outcome = 'partial') AS warnings, round(count(*) FILTER (outcome <> 'open') / count(*), 3) AS fraction, CASE WHEN count(*) FILTER (outcome <> 'open') < count(*) THEN 'running' WHEN count(*) FILTER (outcome = 'partial') > 0 THEN 'done_with_warnings' ELSE 'done' END AS phase, max(pages) AS pages FROM outcomes JOIN (SELECT user_id AS run, count(*) AS pages FROM events GROUP BY user_id) USING (run) GROUP BY run",
}
QUERIES = {name: globals()[name] for name in ORACLES}
