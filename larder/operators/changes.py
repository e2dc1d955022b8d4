"""Change data: upserts with provenance, memberships, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Better provenance of a saved time wins.
SAVED_AT_RANK = {"exact": 3, "first_seen": 2, "interpolated": 1, "unknown": 0}
#: Batches of a platform that one task reads in order, about.
STRETCH = 65_536


def folded(batch: DataFrame, columns: list[str], order: str, key: str = "external_id") -> DataFrame:
    """One row for each ``key`` of a batch: of each column the last value that was given, in ``order``."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return batch.groupBy(key).agg(*[last(c) for c in columns])


def upsert_items(stored: DataFrame, incoming: DataFrame, text: list[str], numbers: list[str], key: str = "external_id", order: str | None = None) -> DataFrame:
    """The new state of all items, with ``action``: inserted, reindexed (text changed), touched or kept.

    A null incoming value keeps the stored one; an empty text replaces it. An id that comes several times is applied in
    ``order`` (without one, ids must be unique): the last value given of each column counts."""
    if order:
        incoming = folded(incoming, text + numbers, order, key)
    s = stored.select(key, *[F.col(c).alias(f"_s_{c}") for c in text + numbers], F.lit(True).alias("_stored"))
    i = incoming.select(key, *[F.col(c).alias(f"_i_{c}") for c in text + numbers], F.lit(True).alias("_incoming"))
    changed = F.lit(False)
    for c in text:
        changed = changed | (F.col(f"_i_{c}").isNotNull() & ~F.col(f"_i_{c}").eqNullSafe(F.col(f"_s_{c}")))
    action = F.when(F.col("_incoming").isNull(), "kept").when(F.col("_stored").isNull(), "inserted").when(changed, "reindexed").otherwise("touched")
    return s.join(i, key, "full_outer").select(key, *[F.coalesce(f"_i_{c}", f"_s_{c}").alias(c) for c in text + numbers], action.alias("action"))


def merge_saved_at(versions: DataFrame, key: str) -> DataFrame:
    """Of all versions (key, saved_at, source, batch_ord) the best provenance, of equals the earliest batch, then the latest time."""
    rank = F.create_map(*[F.lit(x) for kv in SAVED_AT_RANK.items() for x in kv])[F.col("source")]
    best = F.max_by(F.struct("saved_at", "source"), F.struct(rank.alias("r"), (-F.col("batch_ord")).alias("b"), "saved_at"))
    return versions.groupBy(key).agg(best.alias("best")).select(key, "best.saved_at", "best.source")


def reconcile(stored: DataFrame, seen: DataFrame, scope: list[str], key: str) -> DataFrame:
    """After a complete pass over ``scope``: every stored row (scope, key, available) with available = it was seen, and
    ``revived`` or ``newly_gone`` where that is a change. Nothing is deleted."""
    marks = seen.select(*scope, key).distinct().withColumn("_seen", F.lit(True))
    now, before = F.col("_seen").isNotNull(), F.coalesce("available", F.lit(True))
    both = stored.join(marks, [*scope, key], "left").withColumn("revived", now & ~before).withColumn("newly_gone", ~now & before)
    return both.withColumn("available", now).drop("_seen")


def guard_reconcile(stored: DataFrame, seen: DataFrame, scope: str, least: int = 20, declared: DataFrame | None = None) -> DataFrame:
    """scope, stored, seen, allowed: refuse an empty pass, and one with under half of ``least`` or more stored rows.

    With ``declared`` (scope, total), collections are meant: one that is empty may have been emptied, unless it is said to
    hold something."""
    s = stored.groupBy(scope).agg(F.count(F.lit(1)).alias("stored"))
    n = seen.groupBy(scope).agg(F.count(F.lit(1)).alias("seen"))
    some = F.col("seen") > 0
    if declared is None:
        both = s.join(n, scope, "left").select(scope, "stored", F.coalesce("seen", F.lit(0)).alias("seen"))
    else:
        both = declared.select(scope, "total").join(s, scope, "left").join(n, scope, "left").select(scope, F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("seen", F.lit(0)).alias("seen"), "total")
        some = some | (F.coalesce("total", F.lit(0)) == 0)
    allowed = some & ((F.col("stored") < least) | (2 * F.col("seen") >= F.col("stored")))
    return both.select(scope, "stored", "seen", allowed.alias("allowed"))


def capped(rows: DataFrame, by: list[str], order: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows of each page, and the pages that have more (by, delivered, excess)."""
    first = Window.partitionBy(*by).orderBy(*order)
    kept = rows.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= most).drop("_nth")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("delivered")).filter(F.col("delivered") > most)
    return kept, sizes.withColumn("excess", F.col("delivered") - most)


def flag_repeats(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each ``by``."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter("_nth = 1").drop("_nth")


def refresh_stats(stored: DataFrame, incoming: DataFrame, numbers: list[str], key: str = "external_id") -> DataFrame:
    """Stored rows with given numbers taken, ``is_ad`` always replaced and seen rows available again."""
    i = incoming.select(key, *[F.col(c).alias(f"_i_{c}") for c in numbers], F.col("is_ad").alias("_ad"), F.lit(True).alias("_seen"))
    seen = F.col("_seen").isNotNull()
    return stored.join(i, key, "left").select(
        key, *[F.coalesce(f"_i_{c}", c).alias(c) for c in numbers], F.when(seen, F.coalesce("_ad", F.lit(False))).otherwise(F.col("is_ad")).alias("is_ad"), (seen | F.col("available")).alias("available")
    )


def date_new_saves(new_items: DataFrame, established: DataFrame, by: str, order: str) -> DataFrame:
    """New items with saved_at and source: on the head page of a list whose library (``established``: by) already has an
    order they are dated one second apart before ``synced_at``, in page order; others keep what they came with."""
    marked = new_items.join(established.select(by).distinct().withColumn("_old", F.lit(True)), by, "left")
    head = F.col("head_of_list") & F.col("_old").isNotNull()
    nth = F.row_number().over(Window.partitionBy(by, "batch_id").orderBy(order))
    given = F.coalesce("saved_at", "synced_at")
    source = F.when(F.col("saved_at").isNull(), "first_seen").otherwise(F.coalesce("saved_at_source", F.lit("unknown")))
    dated = marked.withColumn("_nth", nth)
    return dated.withColumns({"saved_at_source": F.when(head, "first_seen").otherwise(source), "saved_at": F.when(head, F.col("synced_at") - F.col("_nth") * 1000).otherwise(given)}).drop("_old", "_nth")


def upsert_collections(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """collection_id, name, declared_total, action: kept, inserted, renamed or touched; a missing total keeps the stored one."""
    s = stored.select("collection_id", F.col("name").alias("_n"), F.col("declared_total").alias("_t"), F.lit(True).alias("_s"))
    i = incoming.select("collection_id", "name", "declared_total", F.lit(True).alias("_i"))
    action = F.when(F.col("_i").isNull(), "kept").when(F.col("_s").isNull(), "inserted").when(~F.col("name").eqNullSafe(F.col("_n")), "renamed").otherwise("touched")
    return s.join(i, "collection_id", "full_outer").select("collection_id", F.coalesce("name", "_n").alias("name"), F.coalesce("declared_total", "_t").alias("declared_total"), action.alias("action"))


def split_memberships(incoming: DataFrame, items: DataFrame, collections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memberships that can be applied, and those whose item or collection is unknown."""
    marked = incoming.join(items.select("external_id").distinct().withColumn("_item", F.lit(True)), "external_id", "left").join(collections.select("collection_id").distinct().withColumn("_coll", F.lit(True)), "collection_id", "left")
    known = F.col("_item").isNotNull() & F.col("_coll").isNotNull()
    return marked.filter(known).select(incoming.columns), marked.filter(~known).select(incoming.columns)


def upsert_memberships(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """external_id, collection_id, position, action: kept, inserted, moved or same."""
    key = ["external_id", "collection_id"]
    s, i = stored.select(*key, F.col("position").alias("_s")), incoming.select(*key, F.col("position").alias("_i"))
    action = F.when(F.col("_i").isNull(), "kept").when(F.col("_s").isNull(), "inserted").when(F.col("_i") != F.col("_s"), "moved").otherwise("same")
    return s.join(i, key, "full_outer").select(*key, F.coalesce("_i", "_s").alias("position"), action.alias("action"))


def replace_hashtags(stored: DataFrame, incoming: DataFrame, changed: DataFrame, key: str = "external_id") -> DataFrame:
    """key, hashtags: where the searchable text is new or ``changed`` (key), given tags (an empty list too) replace the stored
    ones; null, or an unchanged text, keeps them."""
    marks = changed.select(key).distinct().withColumn("_changed", F.lit(True))
    both = stored.select(key, F.col("hashtags").alias("_s"), F.lit(True).alias("_stored")).join(incoming.select(key, F.col("hashtags").alias("_i")), key, "full_outer").join(marks, key, "left")
    taken = F.when(F.col("_changed").isNotNull() | F.col("_stored").isNull(), F.coalesce("_i", "_s")).otherwise(F.col("_s"))
    return both.select(key, taken.alias("hashtags"))


def grown_tags(known: DataFrame, tags: DataFrame) -> DataFrame:
    """tag: all tags that are known or used now (``tags``: hashtags); none is ever taken away."""
    return known.select("tag").unionByName(tags.select(F.explode("hashtags").alias("tag"))).filter("tag IS NOT NULL").distinct()


def recount_collections(collections: DataFrame, members: DataFrame, touched: DataFrame, synced_at: Column | None = None) -> DataFrame:
    """``collections`` (collection_id, held, last_synced) with ``held`` counted anew where ``touched`` (collection_id), 0 if nothing is
    left, and the time of this sync if one is given."""
    scope = touched.select("collection_id").distinct()
    counts = members.join(scope, "collection_id", "left_semi").groupBy("collection_id").agg(F.count(F.lit(1)).alias("_n"))
    both = collections.join(scope.withColumn("_touched", F.lit(True)), "collection_id", "left").join(counts, "collection_id", "left")
    mark = F.col("_touched").isNotNull()
    at = F.col("last_synced") if synced_at is None else F.when(mark, F.coalesce(synced_at, "last_synced")).otherwise(F.col("last_synced"))
    return both.select("collection_id", F.when(mark, F.coalesce("_n", F.lit(0))).otherwise(F.col("held")).alias("held"), at.alias("last_synced"))


def affected_docs(items: DataFrame, members: DataFrame, collections: DataFrame) -> DataFrame:
    """external_id of search documents to rebuild, from the results of the upserts: new or changed text, a new
    membership, or a member of a renamed collection."""
    text = items.filter(F.col("action").isin("inserted", "reindexed")).select("external_id")
    joined = members.filter("action = 'inserted'").select("external_id")
    renamed = members.join(collections.filter("action = 'renamed'").select("collection_id"), "collection_id", "left_semi").select("external_id")
    return text.unionByName(joined).unionByName(renamed).distinct()


def bind_accounts(batches: DataFrame, bound: DataFrame, match) -> DataFrame:
    """platform, batch_id, match, accepted of batches (platform, batch_id, id, handle), applied one after another.

    A platform that isn't ``bound`` (platform, id, handle) is bound by its first batch. A batch of a different account is refused
    whole; a new id of the same handle, and a new handle of the same id, are taken over and hold for the batches after it.
    ``match`` (id, handle, bound id, bound handle) says how two accounts stand. A platform is cut into stretches of batches, each read in
    order by itself; what they hand on is a row each. ``batches`` is read several times."""
    owner, at = F.struct("id", "handle"), F.col("batch_id")
    first = batches.groupBy("platform").agg(F.min_by(owner, "batch_id").alias("_first"), F.min(at).alias("_low"), F.greatest(F.lit(1), F.ceil((F.max(at) - F.min(at) + 1).cast("double") * STRETCH / F.count(F.lit(1)))).alias("_width"))
    start = first.join(bound.select("platform", owner.alias("_bound")), "platform", "left").select("platform", F.coalesce("_bound", "_first").alias("_own"), "_low", "_width")
    rows = batches.join(start, "platform").withColumn("_stretch", F.floor((at - F.col("_low")) / F.col("_width")))
    # without an id the handle can't change, until the first batch of that handle brings one
    same = F.lower("handle") == F.lower("_own.handle")
    brings = F.col("_own.id").isNull() & F.col("id").isNotNull() & same
    rows = rows.join(rows.filter(brings).groupBy("platform").agg(F.min("batch_id").alias("_since"), F.min_by("id", "batch_id").alias("_brought")), "platform", "left")
    known = F.when(F.col("_own.id").isNotNull(), F.col("_own.id")).when(F.col("batch_id") > F.col("_since"), F.col("_brought"))
    rows = rows.withColumn("_id", known)
    # with an id, the handle is that of the last batch of the id
    rows = rows.withColumn("_mine", F.when(F.col("_id").isNotNull() & (F.col("id") == F.col("_id")), F.col("handle")))
    last = lambda c, *by: F.last(c, ignorenulls=True).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1))
    ends = rows.groupBy("platform", "_stretch").agg(F.max_by("_mine", F.when(F.col("_mine").isNotNull(), at)).alias("_end"))
    rows = rows.join(ends.select("platform", "_stretch", last("_end", "platform", "_stretch").alias("_before")), ["platform", "_stretch"])
    rows = rows.withColumn("_handle", F.coalesce(last("_mine", "platform", "_stretch", "batch_id"), "_before", "_own.handle"))
    out = rows.withColumn("match", match(F.col("id"), F.col("handle"), F.col("_id"), F.col("_handle")))
    return out.select("platform", "batch_id", "match", (F.col("match") != "different").alias("accepted"))


def reconcile_collections(stored: DataFrame, seen: DataFrame, allowed: DataFrame) -> DataFrame:
    """Memberships with ``dropped``: in collections that were read completely (``allowed``: collection_id), those not seen."""
    scope = allowed.select("collection_id").distinct().withColumn("_read", F.lit(True))
    marks = seen.select("collection_id", "external_id").distinct().withColumn("_seen", F.lit(True))
    both = stored.join(scope, "collection_id", "left").join(marks, ["collection_id", "external_id"], "left")
    return both.withColumn("dropped", F.col("_read").isNotNull() & F.col("_seen").isNull()).drop("_read", "_seen")


def flag_duplicate_pages(rows: DataFrame, page: str) -> DataFrame:
    """page, duplicate: the page held items but inserted none (``action`` of its items)."""
    return rows.groupBy(page).agg((F.count_if(F.col("action") == "inserted") == 0).alias("duplicate"))
