"""Payload parsing over bodies of the given tables, written once in an application: one page an order, one item a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import cleaned, https_url, tolerant_long
from larder.operators import ingest
from larder.sources import payloads, tables
from larder.sources.snapshots import stored

EPOCH = 1_700_000_000


def item_pages(spark: SparkSession, d: str) -> DataFrame:
    return tables.once(spark, d, "item-pages", lambda: stored(_item_bodies(spark, d), "item-pages"))


def _item_bodies(spark: SparkSession, d: str) -> DataFrame:
    """page, body, request_cursor, collection_id, captured_at. Every eleventh order has no list, fourth lines no usable id."""
    def item(r):
        part = r["l_partkey"]
        return F.struct(
            F.when(r["l_linenumber"] == 4, "x").otherwise(F.concat(F.lit("10000"), part)).alias("id"),
            F.when(part % 7 != 0, r["p_name"]).alias("desc"), F.when(part % 7 == 0, F.array(F.struct(r["p_type"].alias("desc")))).alias("contents"),
            F.struct(F.concat(F.lit(" "), r["p_brand"]).alias("uniqueId")).alias("author"),
            F.when(part % 3 != 0, F.transform(F.split(r["p_type"], " "), lambda w: F.struct(F.concat(F.lit("#"), w).alias("title")))).alias("challenges"),
            F.array(F.struct((part % 2).alias("type"), r["p_brand"].alias("hashtagName"))).alias("textExtra"),
            F.when(part % 10 != 0, (part + EPOCH).cast("string")).alias("createTime"), F.struct(r["p_size"].alias("duration"), F.lit("http://a").alias("cover"), F.lit("https://b").alias("originCover")).alias("video"),
            F.when(part % 5 == 0, F.struct(F.lit(1).alias("n"))).alias("imagePost"), F.when(part % 4 != 0, F.struct(F.floor(r["p_retailprice"]).alias("playCount"))).alias("stats"),
            F.struct(r["p_size"].cast("string").alias("playCount")).alias("statsV2"), F.when(part % 6 == 0, "un").otherwise("en").alias("textLanguage"), (part % 8 == 0).alias("isAd"),
        )

    # what is gathered by page are the columns; items are written out of them where the page is
    columns = ["l_linenumber", "l_partkey", "p_name", "p_type", "p_brand", "p_size", "p_retailprice"]
    lines = tables.read(spark, d, "lineitem").join(tables.read(spark, d, "part").hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    grouped = lines.groupBy(F.col("l_orderkey").alias("page")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    page = F.col("page")
    body = F.struct(
        F.when(page % 11 != 0, F.transform("rows", item)).alias("itemList"), F.when(page % 4 == 0, "0").otherwise((page + EPOCH - 600).cast("string")).alias("cursor"),
        (page % 2 == 1).alias("hasMore"), F.lit(0).alias("statusCode"),
    )
    return grouped.select(
        "page", F.to_json(body).alias("body"), F.when(page % 9 != 0, (page + EPOCH).cast("string")).alias("request_cursor"),
        F.when(page % 3 == 0, page.cast("string")).alias("collection_id"), F.lit((EPOCH + 100_000_000) * 1000).alias("captured_at"),
    )


def _items(spark: SparkSession, d: str) -> DataFrame:
    return payloads.parse_items(payloads.item_records(item_pages(spark, d)))


def b5_parse_item_pages(spark, d):
    return _items(spark, d).select("page", "external_id", "author_handle", "language", "is_ad")


def b8_envelope_check(spark, d):
    return payloads.page_info(item_pages(spark, d)).select("page", "ok", F.col("delivered").cast("long").alias("delivered"), "has_more")


def b9_extract_hashtags(spark, d):
    return _items(spark, d).select("page", "external_id", F.array_join("hashtags", ",").alias("tags"))


def b12_first_available(spark, d):
    return _items(spark, d).select("page", "external_id", "caption", "stats.views", "thumbnail_url")


def b15_derive_media_fields(spark, d):
    return _items(spark, d).select("page", "external_id", "media_type", "duration_sec", "posted_at")


def b16_estimate_saved_at(spark, d):
    return payloads.estimate_saved_at(payloads.item_records(item_pages(spark, d))).select("page", "external_id", "saved_at", "saved_at_source")


def b17_assign_positions(spark, d):
    return payloads.memberships(payloads.item_records(item_pages(spark, d)))


def b18_head_of_list(spark, d):
    return payloads.page_info(item_pages(spark, d)).select("page", "head_of_list")


def b19_missing_fields(spark, d):
    return payloads.missing_fields(payloads.item_records(item_pages(spark, d)))


def b19_unknown_keys(spark, d):
    return payloads.unknown_keys(payloads.item_records(item_pages(spark, d)), ["id", "desc", "author", "video", "stats"])


def b20_problem_log(spark, d):
    return payloads.problems(item_pages(spark, d)).select("page", "code", F.col("ord").cast("long").alias("ord"))


def _collection_pages(spark: SparkSession, d: str) -> DataFrame:
    """One list of collections a customer; names of every thirteenth order are blank, every third names the owner."""
    key = F.col("o_orderkey")
    record = F.struct(key.alias("collectionId"), F.when(key % 13 != 0, F.concat("o_orderpriority", F.lit(" "))).otherwise(" ").alias("name"), F.floor("o_totalprice").cast("string").alias("total"), F.when(key % 3 == 0, F.concat(F.lit("u"), key)).alias("userName"))
    lists = tables.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.array_sort(F.collect_list(record)).alias("collectionList"))
    return lists.select("page", F.to_json(F.struct("collectionList")).alias("body"))


def b6_parse_collection_lists(spark, d):
    return payloads.parse_collections(_collection_pages(spark, d))[0].select("page", "collection_id", "name", "declared_total")


def b6_list_owners(spark, d):
    return payloads.parse_collections(_collection_pages(spark, d))[1]


def detail_pages(spark: SparkSession, d: str) -> DataFrame:
    """page, body of an order's details; every thirteenth lacks a name."""
    o = tables.read(spark, d, "orders")
    info = F.struct(F.col("o_orderkey").alias("collectionId"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")).alias("name"), F.col("o_custkey").alias("total"), F.col("o_orderstatus").alias("userName"))
    return o.select(F.col("o_orderkey").alias("page"), F.to_json(F.struct(info.alias("collectionInfo"))).alias("body"))


def b7_parse_collection_details(spark, d):
    return payloads.parse_collection_details(detail_pages(spark, d))


def b25_extract_viewer(spark, d):
    """Customers in debt have ill-formed handles, rich ones ids that are too long."""
    c = tables.read(spark, d, "customer")
    uid = F.when(F.col("c_acctbal") > 5000, F.lpad(F.col("c_custkey").cast("string"), 28, "1")).otherwise(F.col("c_custkey").cast("string"))
    name = F.when(F.col("c_acctbal") > 0, F.regexp_replace("c_name", "#", ".")).otherwise(F.col("c_name"))
    user = F.struct(F.when(F.col("c_custkey") % 5 != 0, uid).alias("uid"), F.when(F.col("c_custkey") % 7 != 0, name).alias("uniqueId"))
    scoped = F.to_json(F.struct(F.struct(F.struct(user.alias("user")).alias("webapp.app-context")).alias("__DEFAULT_SCOPE__")))
    bare = F.to_json(F.struct(F.struct(user.alias("user")).alias("webapp.app-context")))
    blobs = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, scoped).otherwise(bare).alias("blob"))
    return payloads.viewer(blobs, "blob").drop("blob")


def b11_coerce_fields(spark, d):
    """Whole numbers, decimals and exponents as texts, and the first word of each text."""
    n, raw = F.col("n_chars").cast("string"), F.regexp_extract("text", r"^(\s*\S*)", 1)
    url = F.concat(F.when(F.col("doc_id") % 2 == 0, "https://").otherwise("http://"), F.coalesce("lang", F.lit("")))
    return tables.read(spark, d, "documents").select(
        "doc_id", cleaned(F.col("source"), 5).alias("source"), tolerant_long(n).alias("n"), tolerant_long(F.concat(F.lit(" -"), n, F.lit(".7 "))).alias("decimal"),
        tolerant_long(F.concat(n, F.lit("e3"))).alias("exponent"), tolerant_long(F.concat(F.lit("x"), n)).alias("none"), https_url(url).alias("url"), tolerant_long(raw).isNull().alias("no_number"),
    )


def b22_build_search_docs(spark, d):
    names = tables.memberships(spark, d).join(tables.collections(spark, d), "collection_id").select("external_id", "name")
    return ingest.search_docs(tables.short_items(spark, d), names, "external_id").select("external_id", "caption_text", "hashtags_text", "collections_text")


def b23_canonical_urls(spark, d):
    items = tables.short_items(spark, d).withColumn("media_type", F.when(F.col("external_id") % 5 == 0, "photo").otherwise("video"))
    return items.select("external_id", ingest.canonical_url("https://example.org", F.nullif(F.lower(F.regexp_replace("author_handle", "#1.", "")), F.lit("brand")), F.col("media_type"), F.col("external_id")).alias("url"))


def b27_validate_accounts(spark, d):
    c = tables.read(spark, d, "customer")
    k = F.col("c_custkey")
    handle = F.when(k % 4 == 0, F.col("c_mktsegment")).when(k % 4 == 1, F.col("c_name")).otherwise(F.regexp_replace("c_name", "#", "_"))
    ident = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.when(F.col("c_acctbal") > 0, "a b").otherwise(F.lpad(k.cast("string"), 28, "1")))
    platform = F.when(k % 5 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    return c.filter(ingest.valid_account(handle, ident, platform)).select("c_custkey")


_LINES = """
l0 AS (SELECT l_orderkey AS page, l_linenumber AS line, p.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS ord
       FROM lineitem JOIN part p ON l_partkey = p_partkey),
l1 AS (SELECT *, row_number() OVER (PARTITION BY page, p_partkey ORDER BY ord) AS nth FROM l0 WHERE page % 11 <> 0 AND line <> 4),
r AS (SELECT *, '10000' || p_partkey AS external_id, row_number() OVER (PARTITION BY page ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY page) AS n FROM l1 WHERE nth = 1)
"""
_TAGS = "CASE WHEN p_partkey % 3 <> 0 THEN string_split(lower(p_type), ' ') ELSE [] END || CASE WHEN p_partkey % 2 = 1 THEN [trim(lower(p_brand), '#')] ELSE [] END"
_LISTS = "c AS (SELECT o_custkey AS page, o_orderkey, o_orderpriority, floor(o_totalprice)::BIGINT AS total FROM orders WHERE o_orderkey % 13 <> 0)"

ORACLES = {
    "b5_parse_item_pages": f"WITH {_LINES} SELECT page, external_id, p_brand AS author_handle, CASE WHEN p_partkey % 6 <> 0 THEN 'en' END AS language, p_partkey % 8 = 0 AS is_ad FROM r",
    "b8_envelope_check": "SELECT l_orderkey AS page, l_orderkey % 11 <> 0 OR l_orderkey % 2 = 0 AS ok, CASE WHEN l_orderkey % 11 <> 0 THEN count(*) ELSE 0 END AS delivered, l_orderkey % 2 = 1 AS has_more FROM lineitem GROUP BY l_orderkey",
    "b9_extract_hashtags": f"WITH {_LINES}, t AS (SELECT page, external_id, unnest({_TAGS}) AS tag, generate_subscripts({_TAGS}, 1) AS k FROM r), u AS (SELECT page, external_id, tag, min(k) AS k FROM t WHERE tag <> '' GROUP BY ALL), v AS (SELECT page, external_id, string_agg(tag, ',' ORDER BY k) AS tags FROM u GROUP BY ALL) SELECT page, external_id, coalesce(tags, '') AS tags FROM r LEFT JOIN v USING (page, external_id)",
    "b12_first_available": f"WITH {_LINES} SELECT page, external_id, CASE WHEN p_partkey % 7 <> 0 THEN p_name ELSE p_type END AS caption, CASE WHEN p_partkey % 4 <> 0 THEN floor(p_retailprice)::BIGINT ELSE p_size END AS views, 'https://b' AS thumbnail_url FROM r",
    "b15_derive_media_fields": f"WITH {_LINES} SELECT page, external_id, CASE WHEN p_partkey % 5 = 0 THEN 'photo' ELSE 'video' END AS media_type, CASE WHEN p_partkey % 5 <> 0 AND p_size > 0 THEN p_size::BIGINT END AS duration_sec, CASE WHEN p_partkey % 10 <> 0 THEN (p_partkey + {EPOCH}) * 1000 END AS posted_at FROM r",
    "b16_estimate_saved_at": f"WITH {_LINES}, b AS (SELECT *, CASE WHEN page % 9 <> 0 THEN page + {EPOCH} ELSE {EPOCH + 100_000_000} END * 1000 AS hi, CASE WHEN page % 4 <> 0 THEN (page + {EPOCH} - 600) * 1000 END AS lo FROM r) SELECT page, external_id, coalesce(floor(lo + ((n - 1 - i)::DOUBLE / n) * (hi - lo) + 0.5)::BIGINT, hi - (i + 1) * 1000) AS saved_at, CASE WHEN lo IS NULL THEN 'unknown' ELSE 'interpolated' END AS saved_at_source FROM b",
    "b17_assign_positions": f"WITH {_LINES} SELECT page::VARCHAR AS collection_id, external_id, CASE WHEN page % 9 <> 0 THEN page + {EPOCH} ELSE 0 END + i AS position FROM r WHERE page % 3 = 0",
    "b18_head_of_list": "SELECT DISTINCT l_orderkey AS page, l_orderkey % 9 = 0 AS head_of_list FROM lineitem",
    "b19_missing_fields": f"WITH {_LINES} SELECT * FROM (SELECT 'desc' AS field, count(*) FILTER (p_partkey % 7 = 0) AS n FROM r UNION ALL SELECT 'createTime', count(*) FILTER (p_partkey % 10 = 0) FROM r UNION ALL SELECT 'music.title', count(*) FROM r) WHERE n > 0",
    "b19_unknown_keys": f"WITH {_LINES} SELECT * FROM (SELECT unnest(['createTime', 'textExtra', 'statsV2', 'textLanguage', 'isAd', 'challenges', 'contents', 'imagePost']) AS key, unnest([count(*) FILTER (p_partkey % 10 <> 0), count(*), count(*), count(*), count(*), count(*) FILTER (p_partkey % 3 <> 0), count(*) FILTER (p_partkey % 7 = 0), count(*) FILTER (p_partkey % 5 = 0)]) AS n FROM r) WHERE n > 0",
    "b20_problem_log": f"WITH {_LINES} SELECT DISTINCT l_orderkey AS page, 'bad_envelope' AS code, NULL::BIGINT AS ord FROM lineitem WHERE l_orderkey % 11 = 0 AND l_orderkey % 2 = 1 UNION ALL SELECT page, 'bad_record', ord FROM l0 WHERE page % 11 <> 0 AND line = 4",
    "b6_parse_collection_lists": f"WITH {_LISTS} SELECT page, o_orderkey::VARCHAR AS collection_id, o_orderpriority AS name, total AS declared_total FROM c",
    "b6_list_owners": f"WITH {_LISTS} SELECT page, 'u' || min(o_orderkey) FILTER (o_orderkey % 3 = 0) AS owner FROM c GROUP BY page",
    "b7_parse_collection_details": "SELECT o_orderkey AS page, o_orderkey::VARCHAR AS collection_id, o_orderpriority AS name, o_custkey AS declared_total, o_orderstatus AS owner FROM orders WHERE o_orderkey % 13 <> 0",
    "b25_extract_viewer": "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 AND c_acctbal > 0 THEN replace(c_name, '#', '.') END AS viewer_handle, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_acctbal > 0 AND c_acctbal <= 5000 THEN c_custkey::VARCHAR END AS viewer_id FROM customer",
    "b11_coerce_fields": r"SELECT doc_id, nullif(left(trim(source), 5), '') AS source, n_chars AS n, -n_chars AS decimal, n_chars * 1000 AS exponent, NULL::BIGINT AS none, CASE WHEN doc_id % 2 = 0 THEN 'https://' || coalesce(lang, '') END AS url, NOT regexp_matches(coalesce(text, ''), '^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?(\s|$)') AS no_number FROM documents",
    "b22_build_search_docs": "WITH m AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem), n AS (SELECT l_partkey, string_agg(o_orderpriority, ' ' ORDER BY o_orderpriority) AS c FROM m JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL) SELECT p_partkey AS external_id, p_name AS caption_text, array_to_string(string_split(lower(p_type), ' '), ' ') AS hashtags_text, coalesce(c, '') AS collections_text FROM part LEFT JOIN n ON l_partkey = p_partkey",
    "b23_canonical_urls": "SELECT p_partkey AS external_id, CASE WHEN h <> 'brand' THEN 'https://example.org/@' || h || '/' || CASE WHEN p_partkey % 5 = 0 THEN 'photo' ELSE 'video' END || '/' || p_partkey END AS url FROM (SELECT p_partkey, lower(regexp_replace(p_brand, '#1.', '', 'g')) AS h FROM part)",
    "b27_validate_accounts": r"SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 1 AND c_custkey % 4 <> 1 AND c_custkey % 5 <> 0 AND length(c_custkey::VARCHAR) <= 24",
}
QUERIES = {name: globals()[name] for name in ORACLES}
