"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in an order shuffled by a hash. A document's virtual finish time is the
source's words up to and including it, divided by the source's target; a source with a target beyond its size
starts over, up to three times. All documents, sorted by finish time, are taken until the total budget is
used up. So at any point each source has got its share.

Running sums never gather a source in one task: the order is cut into ranges of the hash (or of finish time),
ranges are summed, and only rows of one range stand in one window. Ranges are themselves summed in coarser
ones. Sources are ranked and filled up in sorted ranges, too, so there may be very many. The hash is of id, source and
text; rows that are the same in all three are interchangeable and stand in one range.

Size: the number of words ``[^\\x20\\x09-\\x0D]+``, 0 for a null text. A null source is a source of its own, last
in order. A null ``doc_id`` is kept; repeated rows are taken each. Sources of size 0 have target 0. Very long texts count
whole. Reruns give the same result. An empty table gives an empty mix. Columns of any name pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.workspace import Workspace, partitions_for

WORD = r"[^\x20\x09-\x0D]+"
#: A document is taken this often at most.
MOST_TIMES = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: Sources up to which their table is broadcast; beyond, documents are joined in salted groups.
BROADCAST_SOURCES = 10_000
SALTS = 64
#: Rows that a range of a running sum holds, about.
RANGE_ROWS = 512

_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _with_targets(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Join by source: a broadcast when the counted number of sources allows it, else in salted groups."""
    on = F.col("source").eqNullSafe(F.col("_source"))
    stats = stats.withColumnRenamed("source", "_source")
    if stats.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(stats), on).drop("_source")
    salted = rows.withColumn("_salt", F.pmod(F.col("_key"), F.lit(SALTS)))
    spread = stats.withColumn("_salt_of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, on & (F.col("_salt") == F.col("_salt_of"))).drop("_source", "_salt", "_salt_of")


def _running(ranges: DataFrame, group: list[str], n: str) -> DataFrame:
    """``_before``: the sum of ``n`` over all earlier ``_range`` of the group, by way of coarser ranges."""
    coarse = ranges.withColumn("_coarse", F.shiftright("_range", 10))
    inner = Window.partitionBy(*group, "_coarse").orderBy("_range").rowsBetween(*_BEFORE)
    outer = Window.partitionBy(*group).orderBy("_coarse").rowsBetween(*_BEFORE) if group else Window.orderBy("_coarse").rowsBetween(*_BEFORE)
    sums = coarse.groupBy(*group, "_coarse").agg(F.sum(n).alias("_n"))
    sums = sums.withColumn("_coarse_before", F.coalesce(F.sum("_n").over(outer), F.lit(0))).drop("_n")
    both = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "_coarse"]]
    left = coarse.withColumn("_inner_before", F.coalesce(F.sum(n).over(inner), F.lit(0))).alias("l")
    joined = left.join(sums.alias("r"), both)
    return joined.select(*[F.col(f"l.{c}") for c in ranges.columns], (F.col("_inner_before") + F.col("_coarse_before")).alias("_before"))


def _sorted(df: DataFrame, space: Workspace, name: str, *order: Column) -> DataFrame:
    """``df`` written in ranges of the order, numbered by ``_range``."""
    return space.write(df.repartitionByRange(partitions_for(df.sparkSession), *order).withColumn("_range", F.spark_partition_id().cast("long")), name)


def _sum_before(rows: DataFrame, n: Column, *order: Column) -> DataFrame:
    """``rows`` of ``_sorted`` with ``_before``: the sum of ``n`` over all earlier rows in the order."""
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(*_BEFORE)
    ranges = _running(rows.groupBy("_range").agg(F.sum(n).alias("_n")), [], "_n").select("_range", F.col("_before").alias("_of_range"))
    here = rows.withColumn("_of_row", F.coalesce(F.sum(n).over(within), F.lit(0)))
    return here.join(ranges, "_range").withColumn("_before", F.col("_of_row") + F.col("_of_range")).drop("_of_row", "_of_range")


def targets(sizes: DataFrame, space: Workspace, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Targets fill up like water: min(cap, level x weight) with the level at which they add up to all words.
    Sources that reach their cap come first by cap / weight, so running sums over the sources find it."""
    by_name = F.asc_nulls_last("source")
    ranked = _sum_before(_sorted(sizes, space, "by-name", by_name), F.lit(1).cast("long"), by_name)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod("_before", F.lit(len(weights))) + 1).cast("int"))
    caps = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most_times).alias("cap"))
    caps = caps.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = [F.col("ratio"), by_name]
    caps = _sorted(caps, space, "by-ratio", *by_ratio)
    total, all_weights = caps.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    filled = _sum_before(caps, F.col("cap"), *by_ratio).withColumnRenamed("_before", "_caps")
    filled = _sum_before(filled, F.col("weight"), *by_ratio).withColumn("_left", F.lit(total) - F.col("_caps")).withColumn("_weights", F.lit(all_weights) - F.col("_before"))
    place = F.struct("ratio", F.col("source").isNull().alias("a"), "source")
    fits = filled.filter(F.col("cap") * F.col("_weights") >= F.col("_left") * F.col("weight"))
    level = fits.agg(F.min(F.struct(place.alias("place"), "_left", "_weights")).alias("level")).first()["level"]  # the first source below its cap
    cap = F.col("cap").cast("double")
    if level is not None:
        shared = (F.col("weight") * F.lit(level["_left"])).cast("double") / F.lit(level["_weights"]).cast("double")
        kinds = (("ratio", "double"), ("a", "boolean"), ("source", sizes.schema["source"].dataType))
        first = F.struct(*[F.lit(level["place"][k]).cast(t).alias(k) for k, t in kinds])
        cap = F.when(place < first, cap).otherwise(shared)
    return caps.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(cap).alias("target"))


def shares(docs: DataFrame, space: Workspace, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES, payload: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target and ``times`` (how often the mix takes it) of every row of ``docs``
    (doc_id, text, source), with the ``payload`` columns beside them."""
    payload = payload or []
    kept = [F.col(c).alias(f"_payload_{i}") for i, c in enumerate(payload)]
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "source", "text"), 1)
    rows = space.write(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_key"), *kept), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sizes = space.write(sizes, "sources")
    n_rows, budget = sizes.agg(F.sum("_rows"), F.sum("source_size")).first()
    bits = max(0, ((n_rows or 0) // RANGE_ROWS).bit_length())
    stats = space.write(targets(sizes.drop("_rows"), space, weights, most_times), "targets")
    rows = _with_targets(rows, stats).withColumn("_range", F.shiftright("_key", 63 - bits))

    # words of the source up to and including each document, in the shuffled order
    by_range = rows.groupBy("source", "_range").agg(F.sum("size").alias("_n"))
    before = _running(by_range, ["source"], "_n").select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_before")
    order = ["_key", "doc_id", "size"]
    within = Window.partitionBy("source", "_range").orderBy(*order).rowsBetween(*_UP_TO_HERE)
    queued = rows.withColumn("_sum", F.sum("size").over(within)).join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    queued = queued.withColumn("_sum", F.col("_sum") + F.col("_before")).drop("_s", "_r", "_before", "_range", "_key")
    queued = space.write(queued, "queued")
    space.drop("sizes")  # the rows are in the queue now

    # the point of the global order at which the budget is used up
    finish = (F.col("_sum") + F.col("_round") * F.col("source_size")) / F.col("target")
    rounds = F.explode(F.sequence(F.lit(0), F.least(F.lit(most_times - 1), F.floor(F.col("target") / F.col("source_size")).cast("int"))))
    copies = queued.filter("size > 0 AND target > 0").select("doc_id", "source", "size", "_sum", "source_size", "target", rounds.alias("_round"))
    copies = copies.withColumn("_finish", finish).withColumn("_range", F.floor(F.col("_finish") * (1 << bits)))
    totals = _running(copies.groupBy("_range").agg(F.sum("size").alias("_n")), [], "_n")
    crossing = totals.filter((F.col("_before") < F.lit(budget or 0)) & (F.col("_before") + F.col("_n") >= F.lit(budget or 0)))
    last = ["_finish", "source", "doc_id", "_sum"]
    near = copies.join(F.broadcast(crossing.select("_range", "_before")), "_range")  # one row is broadcast
    in_order = Window.partitionBy("_range").orderBy("_finish", F.asc_nulls_last("source"), F.asc_nulls_last("doc_id"), "_sum").rowsBetween(*_UP_TO_HERE)
    over = near.withColumn("_all", F.col("_before") + F.sum("size").over(in_order)).filter(F.col("_all") > F.lit(budget or 0))
    cut = over.agg(F.min(F.struct("_finish", F.col("source").isNull().alias("a"), "source", F.col("doc_id").isNull().alias("b"), "doc_id", "_sum")).alias("cut")).first()["cut"]

    # a document is taken in each round in which it comes before that point
    if cut is None:
        rounds_before = F.lit(most_times)
    else:
        def earlier(r: int) -> Column:
            f = (F.col("_sum") + F.lit(r) * F.col("source_size")) / F.col("target")
            here = F.struct(f.alias("_finish"), F.col("source").isNull().alias("a"), F.col("source"), F.col("doc_id").isNull().alias("b"), F.col("doc_id"), F.col("_sum"))
            there = F.struct(*[F.lit(cut[k]).cast(t).alias(k) for k, t in (("_finish", "double"), ("a", "boolean"), ("source", docs.schema["source"].dataType), ("b", "boolean"), ("doc_id", docs.schema["doc_id"].dataType), ("_sum", "long"))])
            return F.when(here < there, 1).otherwise(0)

        rounds_before = sum((earlier(r) for r in range(most_times)), F.lit(0))
    possible = F.floor(F.col("target") / F.col("source_size")).cast("int") + 1
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), F.least(rounds_before, possible, F.lit(most_times))).otherwise(0)
    return queued.select("doc_id", "size", "source_size", "target", taken.cast("int").alias("times"), *[F.col(f"_payload_{i}").alias(c) for i, c in enumerate(payload) if c not in ("doc_id",)])


def mix(docs: DataFrame, space: Workspace, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as it is taken."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    numbered = space.write(docs.select(F.monotonically_increasing_id().alias("_n"), whole), "numbered")  # written, so that numbers stand
    narrow = numbered.select("_n", "_row.doc_id", "_row.text", "_row.source")
    taken = shares(narrow, space, seed, weights, most_times, ["_n"]).filter("times > 0").select("_n", "times")
    return numbered.join(taken, "_n").select("_row", F.explode(F.sequence(F.lit(1), "times")).alias("_time")).select("_row.*")
