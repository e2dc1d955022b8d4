"""Captures and pages before they are parsed: validation, origins, classification, identity, metrics, and the stream of captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import normalized_tags
from larder.operators import changes, ingest, query
from larder.registered.payloads import detail_pages, item_pages
from larder.sources import tables
from larder.sources.snapshots import scratch
from larder.streaming import counters
from larder.streaming import ingest as stream


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Events as captures, every field of which is wrong now and then."""
    k = F.col("arrival_ord")
    return tables.captures(spark, d).select(
        "arrival_ord", F.when(k % 31 == 0, "page").otherwise(ingest.CHANNEL).alias("channel"), F.when(k % 37 == 0, 2).otherwise(1).alias("v"),
        F.when(k % 13 == 0, "Shop!").when(k % 17 == 0, "else").otherwise("shop").alias("platform"), "kind",
        F.when(k % 11 == 0, "x").when(k % 7 != 0, k.cast("string")).alias("request_cursor"),
        F.when(k % 41 == 0, F.lpad(k.cast("string"), 25, "1")).when(k % 3 == 0, k.cast("string")).alias("collection_id"),
        F.when(k % 47 != 0, F.col("captured_at")).alias("captured_at"), F.when(k % 53 != 0, F.col("body")).alias("body"),
        F.when(k % 43 == 0, "a b").otherwise(F.concat(F.lit("u"), "viewer_id")).alias("page_handle"), F.lit(None).cast("string").alias("viewer_handle"), F.col("viewer_id").cast("string").alias("viewer_id"),
        (F.col("captured_at") + (k % 20) * 60_000).alias("now"), F.lit("more").alias("attached"),
    )


def b1_validate_captures(spark, d):
    rules = spark.createDataFrame([("shop", x) for x in ("click", "view", "purchase")] + [("other", "click")], "platform string, kind string")
    found = ingest.validate_captures(envelopes(spark, d), rules, F.col("now"), carried=("arrival_ord",))
    return found.select("arrival_ord", F.coalesce("reason", F.lit("pass")).alias("reason"))


def b2_filter_origins(spark, d):
    return ingest.filter_origins(tables.read(spark, d, "pages"), "url", ["https://*.example.org/*", "http://ththsh.example.net/*", "https://example.com/*"]).select("page_id")


def b3_identity_guard(spark, d):
    c = tables.read(spark, d, "customer")
    k = F.col("c_custkey")
    viewer, none = F.when(k % 5 != 0, F.col("c_name")), F.lit(None).cast("string")
    account = query.match_account(none, viewer, none, F.when(k % 11 == 0, "someone").otherwise(F.upper("c_name")))
    reason = ingest.identity_reason(viewer, F.when(k % 3 == 0, F.upper("c_name")).otherwise(F.concat(F.when(k % 4 == 0, "other").otherwise(""), "c_name")), F.when(k % 7 == 0, F.lit("x")), account)
    return c.select("c_custkey", F.coalesce(reason, F.lit("pass")).alias("reason"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests: the status tells the origin, the priority the path."""
    k = F.col("o_orderkey")
    at = F.when(F.col("o_orderstatus") == "F", "https://www.example.com").when(F.col("o_orderstatus") == "O", "http://www.example.com").otherwise("https://www.example.com:8443")
    to = F.concat(F.lit("/api/"), F.lower(F.substring("o_orderpriority", 3, 4)), F.lit("/"))
    asked = F.concat(F.lit("?device=7&cursor="), F.when(k % 4 == 0, "x1").otherwise(k.cast("string")), F.lit("&collectionId="), F.when(k % 5 == 0, F.lpad(k.cast("string"), 25, "9")).otherwise(F.col("o_custkey").cast("string")))
    return tables.read(spark, d, "orders").select("o_orderkey", F.concat(at, to, asked).alias("url"))


def b4_classify_requests(spark, d):
    rules = spark.createDataFrame([("/api/urge/", "favorites"), ("/api/high/", "collection_items"), ("/api/medi/", "collection_list")], "path string, kind string")
    return ingest.classify_requests(_requests(spark, d), "url", rules, "https://www.example.com").select("o_orderkey", "kind", "request_cursor", "collection_id")


def b10_normalize_hashtags(spark, d):
    """Types and brands as they are written, twice, with a # now and then and in full-width letters."""
    raw = F.array(F.concat(F.lit(" #"), "p_type"), F.col("p_type"), F.col("p_brand"), F.lit("Ｃafé"), F.lit("#"), F.lower("p_brand"))
    return tables.read(spark, d, "part").select(F.col("p_partkey").alias("external_id"), F.array_join(normalized_tags(raw), ",").alias("tags"))


def b13_dedupe_within_page(spark, d):
    lines = tables.read(spark, d, "lineitem")
    return changes.flag_repeats(lines.select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey", "l_partkey"], "l_linenumber")


def _capped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A supplier's lines as one long page."""
    lines = tables.read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return changes.capped(lines, ["l_suppkey"], ["l_orderkey", "l_linenumber"], 300)


def b14_cap_page_rows(spark, d):
    return _capped(spark, d)[0]


def b14_page_excess(spark, d):
    return _capped(spark, d)[1]


def b19_drift_report(spark, d):
    return tables.captures(spark, d).select(F.explode(F.json_object_keys("body")).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def b21_content_hash(spark, d):
    hashed = tables.short_items(spark, d).withColumn("h", ingest.content_hash(["caption", "author_handle", "hashtags"]))
    return hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("external_id").alias("first_id")).drop("h")


def b24_classify_page_urls(spark, d):
    """Paths of orders' pages."""
    k = F.col("o_orderkey")
    handle = F.when(k % 7 == 0, "a%20b").when(k % 11 == 0, "a%2Eb").otherwise(F.concat(F.lit("u."), F.col("o_custkey").cast("string")))
    at = (
        F.when(k % 6 == 0, "/").when(k % 6 == 1, "/explore").when(k % 6 == 2, F.concat(F.lit("/@"), handle)).when(k % 6 == 3, F.concat(F.lit("/@"), handle, F.lit("/collection/"), "o_orderpriority", F.lit("-"), (k + 1_000_000).cast("string")))
        .when(k % 6 == 4, F.concat(F.lit("/@"), handle, F.lit("/collection/x-"), (k % 1000).cast("string"))).otherwise(F.concat(F.lit("/@"), handle, F.lit("/video/1")))
    )
    return tables.read(spark, d, "orders").select("o_orderkey", ingest.classify_page(at).alias("p")).select("o_orderkey", "p.kind", "p.handle", "p.collection_id")


def _processed(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages: refused if they are pending, with counts of what became of their lines."""
    lines = tables.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("l_returnflag") == "N").alias("inserted"), F.count_if(F.col("l_returnflag") == "A").alias("touched"), F.count_if(F.col("l_returnflag") == "R").alias("reindexed"))
    reason = F.when(F.col("o_orderstatus") == "P", F.when(F.col("o_totalprice") > 200_000, "too_large").otherwise("stale"))
    orders = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderpriority").alias("kind"), reason.alias("reason"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("captured_at"))
    return orders.join(lines, "page", "left").fillna(0, ["items", "inserted", "touched", "reindexed"])


def b26_capture_metrics(spark, d):
    return ingest.capture_metrics(_processed(spark, d), ["kind"])


def b26_rejections(spark, d):
    return ingest.rejection_counts(_processed(spark, d))


def _ingested(spark: SparkSession, d: str) -> stream.Store:
    """The library that a stream of two batches makes: pages of items, then details of the collections they are in. Pages of
    customers in debt are another's, one in 29 is of another account, and one in 31 of the same under a new name."""
    def make() -> stream.Store:
        folder = scratch(spark, "stream")
        k = F.col("page")
        me = F.when(k % 29 == 28, "else.one").when(k % 31 == 30, "me.new").otherwise("me.too")
        debt = tables.read(spark, d, "orders").join(tables.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("page"), (F.col("c_acctbal") < 0).alias("debt"))
        items, details = item_pages(spark, d), detail_pages(spark, d).withColumns({"body": F.regexp_replace("body", ',?"userName":"[^"]*"', ""), "request_cursor": F.lit(None).cast("string"), "captured_at": F.lit(1).cast("long")})
        rules = spark.createDataFrame([("shop", k) for k in (*stream.ITEM_KINDS, *stream.COLLECTION_KINDS, *stream.DETAIL_KINDS)], "platform string, kind string")
        both = ((items.withColumn("kind", F.when(F.col("collection_id").isNull(), "favorites").otherwise("collection_items")), 0), (details.withColumn("kind", F.lit("collection_detail")).withColumn("collection_id", F.lit(None).cast("string")), 1))
        for pages, n in both:
            rows = pages.join(debt, "page", "left").select(
                F.lit(ingest.CHANNEL).alias("channel"), F.lit(1).alias("v"), F.lit("shop").alias("platform"), "kind", "request_cursor", "collection_id", (F.col("captured_at") + n).alias("captured_at"), "body",
                F.when(F.col("debt"), "other").otherwise(me).alias("page_handle"), me.alias("viewer_handle"), F.when(k % 29 == 28, "88").otherwise("77").alias("viewer_id"), (F.col("page") * 2 + n).alias("arrival_ord"), (F.col("captured_at") + 1000).alias("ingested_at"),
            )
            rows.write.mode("append").parquet(f"{folder}/in")
            # all that has come is one batch, in as many files as it has
            stream.run(spark.readStream.schema(stream.CAPTURES).parquet(f"{folder}/in"), f"{folder}/out", rules).awaitTermination()
        return stream.Store(spark, f"{folder}/out")

    return tables.once(spark, d, "stream", make)


def f1_ingest_stream(spark, d):
    return _ingested(spark, d).read("items").select("item", "caption", "author_handle", "views", "media_type", "is_ad", "available", "saved_at", "saved_at_source", "first_seen_at", "last_seen_at")


def f1_ingest_accounts(spark, d):
    """The account at the end, and refusals by reason."""
    store = _ingested(spark, d)
    bound = store.read("accounts").select(F.concat_ws(":", "platform", "id", "handle").alias("what"), F.lit(1).cast("long").alias("n"))
    return bound.unionByName(spark.read.parquet(f"{store.folder}/rejected").groupBy(F.col("reason").alias("what")).agg(F.count(F.lit(1)).alias("n")))


def f1_ingest_memberships(spark, d):
    """How many memberships each collection holds, and how many wait for theirs."""
    store = _ingested(spark, d)
    held = store.read("collections").select("collection_id", "held", F.lit(False).alias("waits"))
    return held.unionByName(store.read("pending").groupBy("collection_id").agg(F.count(F.lit(1)).alias("held")).select("collection_id", "held", F.lit(True).alias("waits")))


def f1_ingest_metrics(spark, d):
    store = _ingested(spark, d)
    rows = spark.read.parquet(f"{store.folder}/metrics")
    return rows.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("pages", "rejected", "items", "inserted")])


def _counted(spark: SparkSession, d: str) -> str:
    """The folder of a stream of all events, in the order in which they came, in three files."""
    def make() -> str:
        folder = scratch(spark, "counters")
        rows = envelopes(spark, d).withColumnRenamed("now", "ingested_at").drop("attached")
        low, high = rows.agg(F.min("ingested_at"), F.max("ingested_at")).first()
        for n in range(3):
            third = F.least(F.floor((F.col("ingested_at") - low) * 3 / max(1, high - low)), F.lit(2)) == n
            rows.filter(third).select([c.split()[0] for c in counters.CAPTURES.split(", ")]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        rules = spark.createDataFrame([("shop", x) for x in ("click", "view", "purchase", "signup", "scroll", "error")], "platform string, kind string")
        pages = spark.readStream.schema(counters.CAPTURES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        counters.run(pages, f"{folder}/out", rules)
        return f"{folder}/out"

    return tables.once(spark, d, "counted", make)


def f2_windowed_counters(spark, d):
    """Accepted events of each kind in windows of ten minutes."""
    return counters.windows(spark, _counted(spark, d))


def f2_dead_letters(spark, d):
    """Refused events with their reason, as the stream put them aside."""
    return spark.read.parquet(f"{_counted(spark, d)}/refused").select("arrival_ord", "reason")


_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))"
_STREAM = """
debt AS (SELECT o_orderkey AS page, c_acctbal < 0 OR o_orderkey % 29 = 28 AS debt, c_acctbal < 0 AS poor FROM orders JOIN customer ON c_custkey = o_custkey),
l AS (SELECT l_orderkey AS page, l_linenumber AS line, p.*, coalesce(debt, false) AS debt FROM lineitem JOIN part p ON l_partkey = p_partkey LEFT JOIN debt ON page = l_orderkey),
ok AS (SELECT DISTINCT page, p_partkey, p_name, p_type, p_brand, p_size, p_retailprice FROM l WHERE page % 11 <> 0 AND line <> 4 AND NOT debt),
known AS (SELECT o_orderkey AS page FROM orders JOIN debt ON page = o_orderkey WHERE o_orderkey % 13 <> 0 AND NOT debt),
time_ AS (SELECT 1800000000000 AS captured),
rec AS (SELECT page, p_partkey, min((line, p_partkey)) AS o FROM l, time_ WHERE page % 11 <> 0 AND line <> 4 AND NOT debt GROUP BY page, p_partkey),
r1 AS (SELECT page, p_partkey, page % 3 <> 0 AS fav, row_number() OVER (PARTITION BY page ORDER BY o) - 1 AS i, count(*) OVER (PARTITION BY page) AS n,
  least(CASE WHEN page % 9 <> 0 THEN (page + 1700000000) * 1000 ELSE captured END, captured) AS hi, CASE WHEN page % 4 <> 0 THEN (page + 1700000000 - 600) * 1000 END AS lo, captured FROM rec, time_),
r2 AS (SELECT *, CASE WHEN NOT fav THEN captured WHEN lo < hi THEN floor(lo + ((n - 1 - i) / n) * (hi - lo) + 0.5) ELSE hi - (i + 1) * 1000 END::BIGINT AS t, CASE WHEN fav AND lo < hi THEN 1 ELSE 0 END AS rank_,
  row_number() OVER (PARTITION BY p_partkey ORDER BY page) = 1 AS fresh FROM r1),
r3 AS (SELECT *, fav AND page % 9 = 0 AND page > (SELECT min(page) FROM r2 WHERE rank_ > 0) AS dated, sum(fresh::INT) OVER (PARTITION BY page ORDER BY i) AS k FROM r2),
r4 AS (SELECT p_partkey, page, CASE WHEN fresh AND dated THEN captured - k * 1000 ELSE t END AS t, CASE WHEN fresh AND dated THEN 2 ELSE rank_ END AS rank_ FROM r3),
saved AS (SELECT p_partkey, arg_min(t, (-rank_, page))::BIGINT AS saved_at, max(rank_) AS best FROM r4 GROUP BY p_partkey)
"""

_JUDGED = """SELECT k, kind, captured, CASE WHEN k % 31 = 0 OR k % 37 = 0 OR k % 13 = 0 THEN 'malformed' WHEN k % 17 = 0 THEN 'wrong_platform' WHEN kind NOT IN ('click', 'view', 'purchase', 'signup', 'scroll', 'error') THEN 'unknown_kind'
 WHEN k % 11 = 0 OR (k % 7 <> 0 AND length(k::VARCHAR) > 16) OR k % 41 = 0 OR k % 43 = 0 OR k % 47 = 0 THEN 'malformed' WHEN k % 20 > 10 THEN 'stale' WHEN k % 53 = 0 OR coalesce(props, '') = '' THEN 'malformed' WHEN length(props) > 12000000 THEN 'too_large' END AS reason FROM (SELECT event_id AS k, event_type AS kind, epoch_us(ts) // 1000 AS captured, props FROM events)"""

ORACLES = {
    "f2_windowed_counters": f"SELECT kind, (captured // 600000) * 600000 AS start, count(*) AS n FROM ({_JUDGED}) WHERE reason IS NULL GROUP BY ALL",
    "f2_dead_letters": f"SELECT k AS arrival_ord, reason FROM ({_JUDGED}) WHERE reason IS NOT NULL",
    "b1_validate_captures": """WITH e AS (SELECT event_id AS k, event_type AS kind, epoch_us(ts) // 1000 AS at, props FROM events)
SELECT k AS arrival_ord, CASE WHEN k % 31 = 0 OR k % 37 = 0 OR k % 13 = 0 THEN 'malformed' WHEN k % 17 = 0 THEN 'wrong_platform' WHEN kind NOT IN ('click', 'view', 'purchase') THEN 'unknown_kind'
 WHEN k % 11 = 0 OR (k % 7 <> 0 AND length(k::VARCHAR) > 16) OR k % 41 = 0 OR k % 43 = 0 OR k % 47 = 0 THEN 'malformed' WHEN k % 20 > 10 THEN 'stale' WHEN k % 53 = 0 OR coalesce(props, '') = '' THEN 'malformed' WHEN length(props) > 12000000 THEN 'too_large' ELSE 'pass' END AS reason FROM e""",
    "b2_filter_origins": f"SELECT page_id FROM pages WHERE NOT regexp_matches(url, '^[a-z]+://[^/?#]*[:@]') AND ((starts_with(url, 'https://') AND ({_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org' OR {_HOST} = 'example.com')) OR (starts_with(url, 'http://') AND {_HOST} = 'ththsh.example.net'))",
    "b3_identity_guard": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'no_viewer' WHEN c_custkey % 3 <> 0 AND c_custkey % 4 = 0 THEN 'not_own_page' WHEN c_custkey % 7 = 0 THEN 'not_own_data' WHEN c_custkey % 11 = 0 THEN 'other_account' ELSE 'pass' END AS reason FROM customer",
    "b4_classify_requests": "WITH k AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'favorites' WHEN '2-HIGH' THEN 'collection_items' WHEN '3-MEDIUM' THEN 'collection_list' END END AS kind FROM orders) SELECT o_orderkey, kind, CASE WHEN kind IS NOT NULL AND o_orderkey % 4 <> 0 THEN o_orderkey::VARCHAR END AS request_cursor, CASE WHEN kind IS NOT NULL AND o_orderkey % 5 <> 0 THEN o_custkey::VARCHAR END AS collection_id FROM k",
    "b10_normalize_hashtags": "SELECT p_partkey AS external_id, lower(p_type) || ',' || lower(p_brand) || ',café' AS tags FROM part",
    "b13_dedupe_within_page": "SELECT l_orderkey, l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey, l_partkey",
    "b14_cap_page_rows": "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) <= 300",
    "b14_page_excess": "SELECT l_suppkey, count(*) AS delivered, count(*) - 300 AS excess FROM lineitem GROUP BY l_suppkey HAVING count(*) > 300",
    "b19_drift_report": "SELECT field, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS field FROM events) GROUP BY field",
    "b21_content_hash": "SELECT count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY p_name, p_brand, lower(p_type)",
    "b24_classify_page_urls": """WITH h AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'a.b' ELSE 'u.' || o_custkey END AS handle FROM orders)
SELECT k AS o_orderkey, CASE k % 6 WHEN 0 THEN 'home' WHEN 1 THEN 'home' WHEN 2 THEN 'profile' WHEN 3 THEN 'collection' ELSE 'other' END AS kind, CASE WHEN k % 6 IN (2, 3) THEN handle END AS handle, CASE WHEN k % 6 = 3 THEN (k + 1000000)::VARCHAR END AS collection_id FROM h""",
    "b26_capture_metrics": """WITH l AS (SELECT l_orderkey AS page, count(*) AS items, count(*) FILTER (l_returnflag = 'N') AS inserted, count(*) FILTER (l_returnflag = 'A') AS touched, count(*) FILTER (l_returnflag = 'R') AS reindexed FROM lineitem GROUP BY l_orderkey),
p AS (SELECT o_orderkey AS page, o_orderpriority AS kind, o_orderstatus <> 'P' AS ok, o_orderdate::DATE AS day, coalesce(items, 0) AS items, coalesce(inserted, 0) AS inserted, coalesce(touched, 0) AS touched, coalesce(reindexed, 0) AS reindexed FROM orders LEFT JOIN l ON page = o_orderkey)
SELECT kind, count(*) FILTER (ok) AS pages, count(*) FILTER (NOT ok) AS rejected, count(*) FILTER (ok AND items > 0 AND inserted = 0) AS duplicates, (sum(items) FILTER (ok))::BIGINT AS items, (sum(inserted) FILTER (ok))::BIGINT AS inserted, (sum(touched) FILTER (ok))::BIGINT AS touched, (sum(reindexed) FILTER (ok))::BIGINT AS reindexed, arg_max(page, (day, page)) FILTER (ok) AS last_page FROM p GROUP BY kind""",
    "b26_rejections": "SELECT CASE WHEN o_totalprice > 200000 THEN 'too_large' ELSE 'stale' END AS reason, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY reason",
    "f1_ingest_stream": f"""WITH {_STREAM} SELECT DISTINCT 'shop:10000' || p_partkey AS item, CASE WHEN p_partkey % 7 <> 0 THEN p_name ELSE p_type END AS caption, p_brand AS author_handle, CASE WHEN p_partkey % 4 <> 0 THEN floor(p_retailprice)::BIGINT ELSE p_size END AS views, CASE WHEN p_partkey % 5 = 0 THEN 'photo' ELSE 'video' END AS media_type,
 p_partkey % 8 = 0 AS is_ad, true AS available, saved_at, CASE best WHEN 2 THEN 'first_seen' WHEN 1 THEN 'interpolated' ELSE 'unknown' END AS saved_at_source, captured AS first_seen_at, captured AS last_seen_at FROM ok JOIN saved USING (p_partkey), time_""",
    "f1_ingest_accounts": f"""WITH {_STREAM}, item_pages AS (SELECT DISTINCT l_orderkey AS page, 0 AS n FROM lineitem), pg AS (SELECT page, n, coalesce(poor, false) AS poor, coalesce(debt, false) AS debt FROM (SELECT * FROM item_pages UNION ALL SELECT o_orderkey, 1 FROM orders) LEFT JOIN debt USING (page))
SELECT 'shop:77:' || arg_max(CASE WHEN page % 31 = 30 THEN 'me.new' ELSE 'me.too' END, (n, page)) AS what, 1 AS n FROM pg WHERE NOT debt
UNION ALL SELECT CASE WHEN poor THEN 'not_own_page' ELSE 'other_account' END AS what, count(*) FROM pg WHERE debt GROUP BY what""",
    "f1_ingest_memberships": f"WITH {_STREAM}, m AS (SELECT page, count(*) AS n FROM ok WHERE page % 3 = 0 GROUP BY page) SELECT 'shop:' || known.page AS collection_id, coalesce(n, 0) AS held, false AS waits FROM known LEFT JOIN m ON m.page = known.page UNION ALL SELECT 'shop:' || page, n, true FROM m WHERE page NOT IN (SELECT page FROM known)",
    "f1_ingest_metrics": f"""WITH {_STREAM}, pg AS (SELECT page, CASE WHEN page % 3 = 0 THEN 'collection_items' ELSE 'favorites' END AS kind, any_value(debt) AS debt FROM l GROUP BY page),
it AS (SELECT page, count(*) AS n, count(*) FILTER (fresh) AS f FROM r2 GROUP BY page)
SELECT kind, count(*) FILTER (NOT debt) AS pages, count(*) FILTER (debt) AS rejected, coalesce(sum(n), 0)::BIGINT AS items, coalesce(sum(f), 0)::BIGINT AS inserted FROM pg LEFT JOIN it USING (page) GROUP BY kind
UNION ALL SELECT 'collection_detail', count(*) FILTER (NOT debt), count(*) FILTER (debt), 0, 0 FROM debt""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
