"""Snapshots, bundles and change data over the given tables: every row of a table is stored, comes in, or both, and what differs
does so by its values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import folded_words
from larder.operators import changes, index, ingest, query
from larder.operators.segments import Segments
from larder.registered import roles
from larder.sources import snapshots, tables
from larder.sources.platforms import Platforms


def library(spark: SparkSession, d: str) -> snapshots.Library:
    """Parts as items, orders as collections, lines as memberships, and those of suppliers, which are no collections."""
    accounts = tables.read(spark, d, "customer").select(F.col("c_mktsegment").alias("platform"), F.when(F.col("c_acctbal") > 0, F.regexp_replace("c_name", "#", ".")).otherwise("a b").alias("handle"), F.lit(None).cast("string").alias("id"))
    loose = tables.read(spark, d, "lineitem").select(F.col("l_partkey").alias("external_id"), (-1 - F.col("l_suppkey")).alias("collection_id"), F.lit(0).alias("position")).distinct()
    members = tables.memberships(spark, d).withColumn("position", F.col("position").cast("int")).unionByName(loose)
    return snapshots.Library(tables.short_items(spark, d), tables.collections(spark, d), members, accounts)


def _bundle(spark: SparkSession, d: str) -> snapshots.Library:
    folder = snapshots.scratch(spark, "bundle")
    snapshots.export_bundle(library(spark, d), folder)
    return snapshots.import_bundle(spark, folder, ingest.valid_account(F.col("handle"), F.col("id")))


def a1_read_captures(spark, d):
    folder = snapshots.scratch(spark, "captures")
    tables.captures(spark, d).select("arrival_ord", "kind", "captured_at", "body").write.mode("overwrite").json(folder)
    return spark.read.schema("arrival_ord long, kind string, captured_at long, body string").json(folder)


def a2_read_library(spark, d):
    folder = snapshots.scratch(spark, "library")
    old = library(spark, d)
    snapshots.commit(old, folder, 1)
    kept = snapshots.read(spark, folder)
    snapshots.commit(snapshots.Library(kept.items.withColumn("views", F.col("views") + 1), kept.collections, kept.memberships, kept.accounts), folder, 2)
    return snapshots.read(spark, folder).items.select("external_id", "caption", "views")


def a2_replace_platform(spark, d):
    """Brands as platforms: one is written anew with other views; ``version`` tells where each item's platform stands."""
    items = tables.short_items(spark, d).withColumn("platform", F.col("author_handle")).select("platform", "external_id", "caption", "views")
    held = Platforms(spark, snapshots.scratch(spark, "platforms"), {"items": "external_id long, caption string, views long"})
    held.replace({"items": items})
    with held.open() as before:
        held.replace({"items": before.platform("items", "Brand#11").withColumn("views", F.col("views") + 1)}, ["Brand#11"])
    held.expire()
    now = held.open()
    return now.table("items").join(F.broadcast(now.versions()), "_part").drop("_part")


def a3_export_library(spark, d):
    return _bundle(spark, d).items.select("external_id", "caption", F.array_join("hashtags", ",").alias("tags"))


def a3_export_memberships(spark, d):
    return _bundle(spark, d).memberships.withColumn("position", F.col("position").cast("long"))


def a4_import_library(spark, d):
    held = _bundle(spark, d)
    return tables.list_collections(held.collections, held.memberships).select("collection_id", "held", "declared_total")


def a4_import_accounts(spark, d):
    return _bundle(spark, d).accounts.select("platform", "handle")


def a5_wipe_library(spark, d):
    """What stays of memberships when items of odd views and collections of urgent orders go."""
    folder = snapshots.scratch(spark, "library")
    snapshots.commit(library(spark, d), folder, 1)
    snapshots.wipe(spark, folder, 2, {"items": F.col("views") % 2 == 0, "collections": F.col("name") != "1-URGENT"})
    left = snapshots.read(spark, folder)
    return left.memberships.select("external_id", "collection_id").join(left.accounts.select("platform").limit(1), F.lit(True), "left").select("external_id", "collection_id", F.col("platform").alias("account"))


def a6_read_lexicon(spark, d):
    folder = snapshots.scratch(spark, "lexicon")
    tables.write_lexicon(*roles.lexicon(spark, d), folder)
    return tables.read_lexicon(spark, folder)[0].withColumn("ord", F.col("ord").cast("long"))


def a6_read_aliases(spark, d):
    folder = snapshots.scratch(spark, "lexicon")
    tables.write_lexicon(*roles.lexicon(spark, d), folder)
    return tables.read_lexicon(spark, folder)[1].select("alias", "category")


def a7_get_item(spark, d):
    found = snapshots.get_item(library(spark, d), 11)
    return found.select("external_id", "caption", F.array_join("hashtags", ",").alias("tags"), F.array_join("collections", "|").alias("collections"))


def a8_list_collections(spark, d):
    held = library(spark, d)
    return tables.list_collections(held.collections, held.memberships)


def a9_library_stats(spark, d):
    held = library(spark, d)
    tags = held.items.select(F.explode("hashtags")).distinct()
    return tables.library_stats(tables.short_items(spark, d), held.collections, held.memberships, tags, F.col("duration_sec") >= 10)


def a10_get_account(spark, d):
    return tables.account_of(library(spark, d).accounts, "BUILDING").select("platform", "handle")


def _offers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored: all parts. Incoming: each line tells something of its part, in order, and each supplier is new."""
    stored = tables.short_items(spark, d).select("external_id", "caption", "author_handle", "views")
    lines = tables.read(spark, d, "lineitem").select(
        F.col("l_partkey").alias("external_id"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("returned "), F.col("l_linenumber").cast("string"))).alias("caption"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), "").alias("author_handle"), F.when(F.col("l_linestatus") == "O", F.floor("l_extendedprice")).alias("views"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_suppkey")).alias("ord"),
    )
    new = tables.read(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000_000_000).alias("external_id"), F.col("s_name").alias("caption"), F.lit(None).cast("string").alias("author_handle"), F.floor("s_acctbal").alias("views"), F.lit(0).cast("long").alias("ord"))
    return stored, lines.unionByName(new)


def c1_upsert_items(spark, d):
    stored, incoming = _offers(spark, d)
    return changes.upsert_items(stored, incoming, ["caption", "author_handle"], ["views"], order="ord")


def c2_refresh_stats(spark, d):
    """Parts that were returned are seen again."""
    stored = tables.short_items(spark, d).select("external_id", "views", (F.col("duration_sec") > 25).alias("is_ad"), (F.col("duration_sec") > 10).alias("available"))
    back = tables.read(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("external_id")).agg(F.max("l_linenumber").alias("n"))
    incoming = back.select("external_id", F.when(F.col("n") > 2, F.col("n").cast("long")).alias("views"), (F.col("n") == 1).alias("is_ad"))
    return changes.refresh_stats(stored, incoming, ["views"])


def c3_merge_saved_at(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, changes.SAVED_AT_RANK)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = tables.read(spark, d, "lineitem").select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("saved_at"), kinds.alias("source"), F.col("l_linenumber").alias("batch_ord"))
    return changes.merge_saved_at(rows, "l_orderkey")


def c4_date_new_saves(spark, d):
    new = tables.read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("platform"), F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("ord"), (F.col("l_orderkey") % 2 == 0).alias("head_of_list"),
        F.when(F.col("l_linenumber") != 2, F.col("l_partkey")).alias("saved_at"), F.when(F.col("l_linenumber") != 3, "interpolated").alias("saved_at_source"), (F.col("l_orderkey") * 100_000).alias("synced_at"),
    )
    known = tables.read(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("platform"))
    return changes.date_new_saves(new, known, "platform", "ord").select("platform", "batch_id", "ord", "saved_at", "saved_at_source")


def _collections(spark: SparkSession, d: str) -> DataFrame:
    """Finished and open orders are stored; open and pending ones come in, some by another name, some without a total."""
    o = tables.read(spark, d, "orders")
    stored = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("collection_id"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("declared_total"))
    name = F.when(F.col("o_totalprice") > 200_000, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority"))
    incoming = o.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("collection_id"), name.alias("name"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey") + 1).alias("declared_total"))
    return changes.upsert_collections(stored, incoming)


def _memberships(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored (lines of finished orders), applicable and unknown memberships: all lines come in, while large parts and low orders
    aren't known yet."""
    every = tables.memberships(spark, d).withColumn("position", F.col("position").cast("long"))
    orders = tables.read(spark, d, "orders")
    stored = every.join(orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("collection_id")), "collection_id", "left_semi").select(every.columns)
    incoming = every.withColumn("position", F.col("position") + F.col("external_id") % 2)
    known = orders.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("collection_id"))
    return stored, *changes.split_memberships(incoming, tables.short_items(spark, d).filter("duration_sec < 40"), known)


def c5_upsert_collections(spark, d):
    return _collections(spark, d)


def c6_upsert_memberships(spark, d):
    stored, ok, _ = _memberships(spark, d)
    return changes.upsert_memberships(stored, ok)


def c6_skipped_memberships(spark, d):
    return _memberships(spark, d)[2]


def _retold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored parts, all of them come in again (small ones with another caption and tags), and what the upsert says."""
    stored = tables.short_items(spark, d).select("external_id", "caption", "views", "hashtags", "duration_sec")
    small = F.col("duration_sec") < 20
    incoming = stored.select("external_id", F.when(small, F.concat("caption", F.lit(" new"))).alias("caption"), "views", F.when(small & (F.col("views") % 2 == 0), F.slice("hashtags", 1, 0)).when(F.col("duration_sec") % 2 == 0, F.array(F.lower("caption"))).alias("hashtags"))
    return stored, incoming, changes.upsert_items(stored, incoming, ["caption"], ["views"])


def c7_replace_hashtags(spark, d):
    stored, incoming, now = _retold(spark, d)
    changed = now.filter(F.col("action").isin("inserted", "reindexed"))
    return changes.replace_hashtags(stored, incoming, changed).select("external_id", F.array_join("hashtags", ",").alias("tags"))


def c7_tag_dimension(spark, d):
    stored, incoming, _ = _retold(spark, d)
    return changes.grown_tags(stored.select(F.explode("hashtags").alias("tag")), incoming)


def c8_recount_collections(spark, d):
    """Finished orders are counted anew by the lines that weren't returned; others keep their count and time."""
    o = tables.read(spark, d, "orders")
    kept = o.select(F.col("o_orderkey").alias("collection_id"), F.lit(-1).cast("long").alias("held"), F.col("o_custkey").alias("last_synced"))
    members = tables.read(spark, d, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("collection_id"), F.col("l_partkey").alias("external_id"))
    return changes.recount_collections(kept, members, o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("collection_id")), F.lit(7).cast("long"))


def c9_affected_search_docs(spark, d):
    stored, ok, _ = _memberships(spark, d)
    return changes.affected_docs(_retold(spark, d)[2], changes.upsert_memberships(stored, ok), _collections(spark, d))


FIELDS = {"caption": "caption_text", "hashtags": "hashtags_text", "author": "author_text", "sound": "sound_text", "collections": "collections_text"}


def _grown(spark: SparkSession, d: str) -> index.Index:
    """An index of parts in all five fields that five batches change: each renames one part in 50, and the third takes one in 35 away."""
    def make() -> index.Index:
        docs = snapshots.stored(roles.short_texts(spark, d), "texts")
        grown = Segments(spark, snapshots.scratch(spark, "segments"), FIELDS, folded_words)
        grown.update(0, docs)
        for n in range(1, 6):
            incoming = docs.filter(F.col("external_id") % 50 == n).select("external_id", F.concat("caption_text", F.lit(f" again{n}")).alias("caption_text"))
            changed = changes.upsert_items(docs.select("external_id", "caption_text"), incoming, ["caption_text"], []).filter("action <> 'kept'")
            nothing = spark.createDataFrame([], "external_id long, collection_id long, action string")
            ids = changes.affected_docs(changed, nothing, nothing)
            now = docs.drop("caption_text").join(changed.select("external_id", "caption_text"), "external_id").join(ids, "external_id", "left_semi")
            grown.update(n, now, docs.filter(F.col("external_id") % 35 == 0).select("external_id").join(ids, "external_id", "left_anti") if n == 3 else None)
        return grown.index()

    return tables.once(spark, d, "grown", make)


def c9_incremental_index(spark, d):
    """Statistics of terms, summed over segments."""
    return _grown(spark, d).terms


def c9_incremental_postings(spark, d):
    """Postings by field and length of the document."""
    grown = _grown(spark, d)
    rows = grown.postings.join(grown.documents, "id")
    return rows.groupBy("field", "n_tokens").agg(F.count(F.lit(1)).alias("places"), F.count_distinct("id").alias("docs"), F.sum("pos").alias("positions"), F.sum(F.length("term").cast("long")).alias("letters"))


def c10_match_accounts(spark, d):
    c = tables.read(spark, d, "customer")
    given = F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") + F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0))
    bound = F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey"))
    handle = F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.upper("c_name"))
    return c.select("c_custkey", query.match_account(given, handle, bound, F.col("c_name")).alias("match"))


def c11_bind_accounts(spark, d):
    """Orders are batches of their customer: some without an id, some of another account, some under another handle."""
    o = tables.read(spark, d, "orders").join(tables.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    batches = o.select(F.col("c_custkey").alias("platform"), k.alias("batch_id"), F.when(k % 3 != 0, F.concat(F.lit("u"), F.col("c_custkey") + F.when(k % 11 == 0, 1).otherwise(0))).alias("id"), F.when(k % 7 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.upper("c_name")).alias("handle"))
    bound = tables.read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("platform"), F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("u"), "c_custkey")).alias("id"), F.col("c_name").alias("handle"))
    return changes.bind_accounts(batches, bound, query.match_account)


def _shelves(spark: SparkSession, d: str) -> DataFrame:
    """Lines on their supplier's shelf: shelf, id, available, and marks of a later pass."""
    return tables.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("shelf"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_linestatus") == "O").alias("available"), "l_returnflag")


def c12_reconcile_saved(spark, d):
    rows = _shelves(spark, d)
    out = changes.reconcile(rows.drop("l_returnflag"), rows.filter("l_returnflag <> 'R'"), ["shelf"], "id")
    return out.groupBy("shelf").agg(*[F.count_if(c).alias(c) for c in ("available", "revived", "newly_gone")])


def c13_reconcile_collection(spark, d):
    lines = tables.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("collection_id"), F.col("l_partkey").alias("external_id"), "l_returnflag")
    members = lines.select("collection_id", "external_id").distinct()
    read = tables.read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("collection_id"))
    out = changes.reconcile_collections(members, lines.filter("l_returnflag <> 'A'"), read)
    return out.groupBy("collection_id").agg(F.count_if("dropped").alias("dropped"), F.count_if(~F.col("dropped")).alias("held"))


def c14_guard_reconcile(spark, d):
    rows = _shelves(spark, d)
    return changes.guard_reconcile(rows, rows.filter("l_returnflag = 'N'"), "shelf")


def c14_guard_collections(spark, d):
    """Orders, with what their customer's number declares; only returned lines are seen."""
    lines = tables.read(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    declared = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 3).alias("total"))
    return changes.guard_reconcile(lines, lines.filter("l_returnflag = 'R'"), "l_orderkey", declared=declared)


def c15_commit_batch(spark, d):
    """Version 1 is committed and can't be made again; version 2 is broken off before its marker."""
    folder = snapshots.scratch(spark, "library")
    held = library(spark, d)
    snapshots.commit(held, folder, 1)
    held.items.limit(0).write.parquet(f"{folder}/v2/items")
    refused = False
    try:
        snapshots.commit(held, folder, 1)
    except ValueError:
        refused = True
    return snapshots.read(spark, folder).items.select("external_id", "caption", F.lit(refused).alias("refused"))


def c16_resolve_pending(spark, d):
    """Once all items are known, and all orders but those of odd customers."""
    known = tables.read(spark, d, "orders").filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("collection_id"))
    return changes.split_memberships(_memberships(spark, d)[2], tables.short_items(spark, d), known)[0]


def c17_check_index_consistency(spark, d):
    """A stored index of the parts that were sold, and of suppliers, which are no items; large parts have an old text there."""
    items = tables.short_items(spark, d)
    names = tables.memberships(spark, d).join(tables.collections(spark, d), "collection_id").select("external_id", "name")
    sold = items.join(tables.read(spark, d, "lineitem").select(F.col("l_partkey").alias("external_id")), "external_id", "left_semi")
    stored = ingest.search_docs(sold.withColumn("caption", F.when(F.col("duration_sec") > 40, "old").otherwise(F.col("caption"))), names, "external_id")
    left = tables.read(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000_000_000).alias("external_id"), *[F.lit("").alias(c) for c in stored.columns[1:]])
    return ingest.inconsistent_docs(stored.unionByName(left), ingest.search_docs(items, names, "external_id"), "external_id")


def c18_flag_duplicate_pages(spark, d):
    rows = tables.read(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 5 == 0, "inserted").otherwise("touched").alias("action"))
    return changes.flag_duplicate_pages(rows, "l_orderkey")


_M = "m AS (SELECT l_partkey AS external_id, l_orderkey AS collection_id, min(l_linenumber)::BIGINT AS position FROM lineitem GROUP BY ALL)"
_UP = f"""{_M}, st AS (SELECT m.* FROM m JOIN orders ON o_orderkey = collection_id WHERE o_orderstatus = 'F'),
inc AS (SELECT external_id, collection_id, position + external_id % 2 AS position, external_id IN (SELECT p_partkey FROM part WHERE p_size < 40) AND collection_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW') AS known FROM m),
mem AS (SELECT external_id, collection_id, coalesce(i.position, st.position) AS position, CASE WHEN i.position IS NULL THEN 'kept' WHEN st.position IS NULL THEN 'inserted' WHEN i.position <> st.position THEN 'moved' ELSE 'same' END AS action
        FROM st FULL JOIN (SELECT * FROM inc WHERE known) i USING (external_id, collection_id)),
col AS (SELECT o_orderkey AS collection_id, CASE WHEN o_orderstatus <> 'F' AND o_totalprice > 200000 THEN o_orderstatus ELSE o_orderpriority END AS name,
               CASE WHEN o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' THEN o_custkey + 1 WHEN o_orderstatus <> 'P' THEN o_custkey END AS declared_total,
               CASE o_orderstatus WHEN 'F' THEN 'kept' WHEN 'P' THEN 'inserted' ELSE CASE WHEN o_totalprice > 200000 THEN 'renamed' ELSE 'touched' END END AS action FROM orders)"""
_HANDLE = "CASE WHEN c_acctbal > 0 THEN replace(c_name, '#', '.') ELSE 'a b' END"
_LEX = """w AS (SELECT DISTINCT string_split(lower(p_name), ' ')[-1] AS category, lower(p_type) AS term FROM part)"""

_W = r"list_transform(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+'), lambda t: strip_accents(t))"
_GROWN = f"""m AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem), nm AS (SELECT l_partkey, string_agg(o_orderpriority, ' ' ORDER BY o_orderpriority) AS names FROM m JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey),
now_ AS (SELECT p.*, coalesce(names, '') AS names, p_name || CASE WHEN p_partkey % 50 BETWEEN 1 AND 5 THEN ' again' || p_partkey % 50 ELSE '' END AS caption FROM part p LEFT JOIN nm ON l_partkey = p_partkey WHERE p_partkey % 35 <> 0 OR p_partkey % 50 IN (3, 4, 5)),
f AS (SELECT p_partkey AS id, 'caption' AS field, {_W.format("caption")} AS w FROM now_ UNION ALL SELECT p_partkey, 'hashtags', {_W.format("p_type")} FROM now_ UNION ALL SELECT p_partkey, 'author', {_W.format("p_brand")} FROM now_
  UNION ALL SELECT p_partkey, 'sound', {_W.format("p_brand")} FROM now_ UNION ALL SELECT p_partkey, 'collections', {_W.format("names")} FROM now_),
post AS (SELECT id, field, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM f), dl AS (SELECT id, count(*) AS n_tokens FROM post GROUP BY id)"""

ORACLES = {
    "c9_incremental_index": f"WITH {_GROWN} SELECT term, count(DISTINCT id) AS n_docs, count(*) AS n_places FROM post GROUP BY term",
    "c9_incremental_postings": f"WITH {_GROWN} SELECT field, n_tokens, count(*) AS places, count(DISTINCT id) AS docs, sum(pos)::BIGINT AS positions, sum(length(term))::BIGINT AS letters FROM post JOIN dl USING (id) GROUP BY field, n_tokens",
    "a1_read_captures": "SELECT event_id AS arrival_ord, event_type AS kind, epoch_us(ts) // 1000 AS captured_at, props AS body FROM events",
    "a2_read_library": "SELECT p_partkey AS external_id, p_name AS caption, floor(p_retailprice)::BIGINT + 1 AS views FROM part",
    "a2_replace_platform": "SELECT p_brand AS platform, p_partkey AS external_id, p_name AS caption, floor(p_retailprice)::BIGINT + (p_brand = 'Brand#11')::INT AS views, CASE WHEN p_brand = 'Brand#11' THEN 2 ELSE 1 END AS version FROM part",
    "a3_export_library": "SELECT p_partkey AS external_id, p_name AS caption, array_to_string(list_sort(list_distinct(string_split(lower(p_type), ' '))), ',') AS tags FROM part",
    "a3_export_memberships": f"WITH {_M} SELECT external_id, collection_id, position FROM m WHERE external_id IN (SELECT p_partkey FROM part) AND collection_id IN (SELECT o_orderkey FROM orders)",
    "a4_import_library": f"WITH {_M} SELECT o_orderkey AS collection_id, count(external_id) AS held, any_value(o_custkey) AS declared_total FROM orders LEFT JOIN (SELECT * FROM m WHERE external_id IN (SELECT p_partkey FROM part)) ON o_orderkey = collection_id GROUP BY o_orderkey",
    "a4_import_accounts": "SELECT c_mktsegment AS platform, replace(c_name, '#', '.') AS handle FROM customer WHERE c_acctbal > 0",
    "a5_wipe_library": f"WITH {_M} SELECT external_id, collection_id, NULL::VARCHAR AS account FROM m JOIN part ON p_partkey = external_id JOIN orders ON o_orderkey = collection_id WHERE floor(p_retailprice)::BIGINT % 2 = 0 AND o_orderpriority <> '1-URGENT'",
    "a6_read_lexicon": f"WITH {_LEX} SELECT category, term, row_number() OVER (PARTITION BY category ORDER BY term) - 1 AS ord FROM w",
    "a6_read_aliases": "SELECT lower(p_brand) AS alias, min(string_split(lower(p_name), ' ')[-1]) AS category FROM part GROUP BY alias",
    "a7_get_item": f"WITH {_M} SELECT p_partkey AS external_id, p_name AS caption, array_to_string(list_sort(string_split(lower(p_type), ' ')), ',') AS tags, coalesce((SELECT string_agg(o_orderpriority, '|' ORDER BY o_orderpriority) FROM m JOIN orders ON o_orderkey = collection_id WHERE external_id = 11), '') AS collections FROM part WHERE p_partkey = 11",
    "a8_list_collections": f"WITH {_M} SELECT o_orderkey AS collection_id, o_orderpriority AS name, o_custkey AS declared_total, count(external_id) AS held FROM orders LEFT JOIN m ON o_orderkey = collection_id GROUP BY ALL",
    "a9_library_stats": f"WITH {_M}, loose AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT (SELECT count(*) FROM part) AS items, (SELECT count(*) FROM orders) AS collections, (SELECT count(*) FROM m) + (SELECT count(*) FROM loose) AS memberships, (SELECT count(DISTINCT t) FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS t FROM part)) AS hashtags, (SELECT count(*) FROM part WHERE p_size >= 10) AS available",
    "a10_get_account": f"SELECT c_mktsegment AS platform, {_HANDLE} AS handle FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY handle LIMIT 1",
    "c1_upsert_items": """WITH i AS (SELECT l_partkey AS external_id, CASE WHEN l_returnflag = 'R' THEN 'returned ' || l_linenumber END AS caption, CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN '' END AS author_handle, CASE WHEN l_linestatus = 'O' THEN floor(l_extendedprice)::BIGINT END AS views, (l_orderkey * 8 + l_linenumber) * 1000000 + l_suppkey AS ord FROM lineitem
 UNION ALL SELECT s_suppkey + 1000000000000, s_name, NULL, floor(s_acctbal)::BIGINT, 0 FROM supplier),
f AS (SELECT external_id, arg_max(caption, ord) FILTER (caption IS NOT NULL) AS caption, arg_max(author_handle, ord) FILTER (author_handle IS NOT NULL) AS author_handle, arg_max(views, ord) FILTER (views IS NOT NULL) AS views FROM i GROUP BY external_id),
st AS (SELECT p_partkey AS external_id, p_name AS caption, p_brand AS author_handle, floor(p_retailprice)::BIGINT AS views, true AS stored FROM part)
SELECT coalesce(f.external_id, st.external_id) AS external_id, coalesce(f.caption, st.caption) AS caption, coalesce(f.author_handle, st.author_handle) AS author_handle, coalesce(f.views, st.views) AS views,
CASE WHEN f.external_id IS NULL THEN 'kept' WHEN stored IS NULL THEN 'inserted' WHEN (f.caption IS NOT NULL AND f.caption IS DISTINCT FROM st.caption) OR (f.author_handle IS NOT NULL AND f.author_handle IS DISTINCT FROM st.author_handle) THEN 'reindexed' ELSE 'touched' END AS action
FROM st FULL JOIN f ON f.external_id = st.external_id""",
    "c2_refresh_stats": "WITH b AS (SELECT l_partkey AS k, max(l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) SELECT p_partkey AS external_id, CASE WHEN n > 2 THEN n ELSE floor(p_retailprice)::BIGINT END AS views, CASE WHEN n IS NULL THEN p_size > 25 ELSE n = 1 END AS is_ad, n IS NOT NULL OR p_size > 10 AS available FROM part LEFT JOIN b ON k = p_partkey",
    "c3_merge_saved_at": "SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS saved_at, source FROM (SELECT l_orderkey, l_shipdate, ['exact', 'first_seen', 'interpolated', 'unknown'][l_linenumber % 4 + 1] AS source, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 4, l_linenumber, l_shipdate DESC) AS r FROM lineitem) WHERE r = 1",
    "c4_date_new_saves": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber) AS nth, l_orderkey % 2 = 0 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AS head FROM lineitem) SELECT l_suppkey AS platform, l_orderkey AS batch_id, l_linenumber AS ord, CASE WHEN head THEN l_orderkey * 100000 - nth * 1000 WHEN l_linenumber = 2 THEN l_orderkey * 100000 ELSE l_partkey END AS saved_at, CASE WHEN head OR l_linenumber = 2 THEN 'first_seen' WHEN l_linenumber = 3 THEN 'unknown' ELSE 'interpolated' END AS saved_at_source FROM n",
    "c5_upsert_collections": f"WITH {_UP} SELECT * FROM col",
    "c6_upsert_memberships": f"WITH {_UP} SELECT * FROM mem",
    "c6_skipped_memberships": f"WITH {_UP} SELECT external_id, collection_id, position FROM inc WHERE NOT known",
    "c7_replace_hashtags": "SELECT p_partkey AS external_id, CASE WHEN p_size < 20 AND floor(p_retailprice)::BIGINT % 2 = 0 THEN '' WHEN p_size < 20 AND p_size % 2 = 0 THEN lower(p_name) ELSE lower(p_type).replace(' ', ',') END AS tags FROM part",
    "c7_tag_dimension": "SELECT unnest(string_split(lower(p_type), ' ')) AS tag FROM part UNION SELECT lower(p_name) FROM part WHERE p_size % 2 = 0 AND NOT (p_size < 20 AND floor(p_retailprice)::BIGINT % 2 = 0)",
    "c8_recount_collections": "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey) SELECT o_orderkey AS collection_id, CASE WHEN o_orderstatus = 'F' THEN coalesce(n, 0) ELSE -1 END AS held, CASE WHEN o_orderstatus = 'F' THEN 7 ELSE o_custkey END AS last_synced FROM orders LEFT JOIN n ON l_orderkey = o_orderkey",
    "c9_affected_search_docs": f"WITH {_UP} SELECT p_partkey AS external_id FROM part WHERE p_size < 20 UNION SELECT external_id FROM mem WHERE action = 'inserted' UNION SELECT external_id FROM mem JOIN col USING (collection_id) WHERE col.action = 'renamed'",
    "c10_match_accounts": """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey + (c_custkey % 7 = 0)::INT END AS a, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS b, c_custkey % 5 <> 0 AS same FROM customer)
SELECT c_custkey, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a <> b THEN 'different' WHEN same THEN 'same' ELSE 'renamed' END WHEN same THEN CASE WHEN b IS NULL AND a IS NOT NULL THEN 'upgraded' ELSE 'same' END ELSE 'different' END AS match FROM c""",
    # one batch after another, with the account as it is bound by then
    "c11_bind_accounts": """WITH RECURSIVE b AS (SELECT c_custkey AS platform, o_orderkey AS batch_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'u' || (c_custkey + (o_orderkey % 11 = 0)::INT) END AS id, lower(CASE WHEN o_orderkey % 7 = 0 THEN c_name || 'x' ELSE c_name END) AS handle,
 CASE WHEN c_acctbal > 0 THEN lower(c_name) END AS bh, CASE WHEN c_acctbal > 5000 THEN 'u' || c_custkey END AS bi, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey),
s AS (SELECT platform, n, batch_id, id, handle, CASE WHEN bh IS NULL THEN id ELSE bi END AS oi, coalesce(bh, handle) AS oh FROM b WHERE n = 1),
r AS (SELECT platform, n, batch_id, id, handle, oi, oh FROM s
 UNION ALL SELECT b.platform, b.n, b.batch_id, b.id, b.handle,
  CASE WHEN r.oi IS NULL AND r.id IS NOT NULL AND r.handle = r.oh THEN r.id ELSE r.oi END,
  CASE WHEN r.oi IS NOT NULL AND r.id = r.oi THEN r.handle ELSE r.oh END FROM r JOIN b ON b.platform = r.platform AND b.n = r.n + 1)
SELECT platform, batch_id, m AS match, m <> 'different' AS accepted FROM (SELECT platform, batch_id, CASE WHEN id IS NOT NULL AND oi IS NOT NULL THEN CASE WHEN id <> oi THEN 'different' WHEN handle = oh THEN 'same' ELSE 'renamed' END WHEN handle <> oh THEN 'different' WHEN oi IS NULL AND id IS NOT NULL THEN 'upgraded' ELSE 'same' END AS m FROM r)""",
    "c12_reconcile_saved": "WITH k AS (SELECT *, l_linestatus = 'O' AS before, bool_or(l_returnflag <> 'R') OVER (PARTITION BY l_suppkey, l_orderkey * 8 + l_linenumber) AS seen FROM lineitem) SELECT l_suppkey AS shelf, count(*) FILTER (seen) AS available, count(*) FILTER (seen AND NOT before) AS revived, count(*) FILTER (NOT seen AND before) AS newly_gone FROM k GROUP BY l_suppkey",
    "c13_reconcile_collection": "WITH k AS (SELECT l_orderkey AS collection_id, l_partkey, bool_or(l_returnflag <> 'A') AS seen, any_value(o_orderstatus) = 'F' AS read FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, l_partkey) SELECT collection_id, count(*) FILTER (read AND NOT seen) AS dropped, count(*) FILTER (NOT (coalesce(read, false) AND NOT seen)) AS held FROM k GROUP BY collection_id",
    "c14_guard_reconcile": "WITH g AS (SELECT l_suppkey AS shelf, count(*) AS stored, count(*) FILTER (l_returnflag = 'N') AS seen FROM lineitem GROUP BY l_suppkey) SELECT *, seen > 0 AND (stored < 20 OR 2 * seen >= stored) AS allowed FROM g",
    "c14_guard_collections": "WITH g AS (SELECT o_orderkey AS l_orderkey, count(l_orderkey) AS stored, count(*) FILTER (l_returnflag = 'R') AS seen, any_value(CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 3 END) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) SELECT l_orderkey, stored, seen, (seen > 0 OR coalesce(total, 0) = 0) AND (stored < 20 OR 2 * seen >= stored) AS allowed FROM g",
    "c15_commit_batch": "SELECT p_partkey AS external_id, p_name AS caption, true AS refused FROM part",
    "c16_resolve_pending": f"WITH {_UP} SELECT external_id, collection_id, position FROM inc WHERE NOT known AND external_id IN (SELECT p_partkey FROM part) AND collection_id IN (SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0)",
    "c17_check_index_consistency": "SELECT p_partkey AS external_id, CASE WHEN p_partkey NOT IN (SELECT l_partkey FROM lineitem) THEN 'missing' ELSE 'different' END AS problem FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) OR p_size > 40 UNION ALL SELECT s_suppkey + 1000000000000, 'left_over' FROM supplier",
    "c18_flag_duplicate_pages": "SELECT l_orderkey, count(*) FILTER (l_partkey % 5 = 0) = 0 AS duplicate FROM lineitem GROUP BY l_orderkey",
}
QUERIES = {name: globals()[name] for name in ORACLES}
