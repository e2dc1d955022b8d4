"""The library's tables as read from Parquet snapshots, and the roles that the given tables play.

Items are long texts (``documents``) or short ones (``part``), collections are ``orders``, memberships ``lineitem``, and
captures ``events``; see each function for the mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Long items: external_id, caption, author_handle, language, views, saved_order."""
    docs = read(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias("external_id"), F.col("text").alias("caption"), F.col("source").alias("author_handle"),
        F.col("lang").alias("language"), F.col("n_chars").alias("views"),
    )


def short_items(spark: SparkSession, folder: str) -> DataFrame:
    """Short items: external_id, caption, author_handle, hashtags, duration_sec, views."""
    return read(spark, folder, "part").select(
        F.col("p_partkey").alias("external_id"), F.col("p_name").alias("caption"), F.col("p_brand").alias("author_handle"),
        F.split(F.lower("p_type"), " ").alias("hashtags"), F.col("p_size").alias("duration_sec"), F.floor("p_retailprice").alias("views"),
    )


def collections(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").select(F.col("o_orderkey").alias("collection_id"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("declared_total"))


def memberships(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each item and collection, at its first position."""
    lines = read(spark, folder, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("external_id"), F.col("l_orderkey").alias("collection_id")).agg(F.min("l_linenumber").alias("position"))


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Capture envelopes: arrival order, viewer, kind, time in milliseconds, body."""
    return read(spark, folder, "events").select(
        F.col("event_id").alias("arrival_ord"), F.col("user_id").alias("viewer_id"), F.col("event_type").alias("kind"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("captured_at"), F.col("value"), F.col("props").alias("body"),
    )


def sold_items(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as items: external_id, caption, hashtags, author_handle, saved_at, views, collection (the supplier). Of lines that share
    their order and number the first by part and supplier counts."""
    lines = read(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")).alias("l")).select("l_orderkey", "l_linenumber", "l.*")
    return lines.join(read(spark, folder, "part").hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("external_id"), F.col("p_name").alias("caption"), F.array(F.lower("p_type")).alias("hashtags"),
        F.col("p_brand").alias("author_handle"), F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("saved_at"), F.floor("l_extendedprice").alias("views"), F.col("l_suppkey").alias("collection_id"),
    )


_made: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, folder: str, name: str, make):
    """What ``make`` gives for the tables of ``folder``: made once in an application, as an index is, and then read."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def library_stats(item_rows: DataFrame, collection_rows: DataFrame, membership_rows: DataFrame, tags: DataFrame, available: Column | None = None) -> DataFrame:
    """One row of counts, each from one aggregate; ``available``: which items are there still (all, if not told)."""
    counts = [rows.agg(F.count(F.lit(1)).alias(name)) for rows, name in ((item_rows, "items"), (collection_rows, "collections"), (membership_rows, "memberships"), (tags, "hashtags"))]
    counts.append(item_rows.agg(F.count_if(F.lit(True) if available is None else F.coalesce(available, F.lit(False))).alias("available")))
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # one row each
    return out


def list_collections(collection_rows: DataFrame, membership_rows: DataFrame) -> DataFrame:
    """Every collection with the number of items held, next to what it declares to hold, in order of name and id."""
    held = membership_rows.groupBy("collection_id").agg(F.count(F.lit(1)).alias("held"))
    total = F.col("declared_total") if "declared_total" in collection_rows.columns else F.lit(None).cast("long").alias("declared_total")
    return collection_rows.join(held, "collection_id", "left").select("collection_id", "name", total, F.coalesce("held", F.lit(0)).alias("held")).orderBy("name", "collection_id")


def account_of(accounts: DataFrame, platform: str) -> DataFrame:
    """The one account (platform, handle, id) that is bound on a platform: of several rows the smallest handle."""
    return accounts.filter(F.col("platform") == platform).orderBy("handle", "id").limit(1)


def read_lexicon(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Categories (category, ord, term) and aliases (alias, category) of a folder of JSON: ``categories`` holds category and
    terms, ``aliases`` alias and category. Rows without a name are left out."""
    categories = spark.read.schema("category string, terms array<string>").json(f"{folder}/categories").filter("category IS NOT NULL")
    aliases = spark.read.schema("alias string, category string").json(f"{folder}/aliases").filter("alias IS NOT NULL AND category IS NOT NULL")
    return categories.select("category", F.posexplode("terms").alias("ord", "term")), aliases.dropDuplicates(["alias"])


def write_lexicon(categories: DataFrame, aliases: DataFrame, folder: str) -> None:
    terms = F.transform(F.array_sort(F.collect_list(F.struct("ord", "term"))), lambda x: x["term"])
    categories.groupBy("category").agg(terms.alias("terms")).write.json(f"{folder}/categories")
    aliases.select("alias", "category").write.json(f"{folder}/aliases")
