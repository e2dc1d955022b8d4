"""The best documents of many queries without scoring all matches: posting blocks in order of impact, each with its maximum.

A word's documents lie in blocks of ``BLOCK``, the largest contributions first. A first pass reads the first block of each word that
is asked and finds a score that enough of a query's matches reach at least (its threshold). A block is read in the second pass
only if its maximum, with all that the query's other words can add, reaches the threshold; a document whose score does is in such
blocks with all its words, so its score is exact, and what lies in other blocks can't come among the best.

The contribution of several words of one prefix is that of their weighted numbers of places added up, which is at most the sum of
their contributions. Blocks lie in levels (the first block, the next 3, the next 12, ..), a folder each, so deep levels that no query
needs aren't opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.operators import bitmaps
from larder.operators.bitmaps import Words
from larder.operators.rank import B, K1
from larder.operators.terms import RELATED, RELATED_DISCOUNT
from larder.sources.snapshots import dropped, released, stored

#: Documents of a block.
BLOCK = 256
#: Scores are told to so many places; bounds leave a little room for sums of doubles in another order.
PLACES, SLACK = 6, 1e-5
HELD = "held array<struct<n: long, f: double, norm: double>>"


def contribution(f: Column, norm: Column) -> Column:
    """What a word adds to a document's score for each unit of its weight; ``norm`` is the document's by its length."""
    return f * (K1 + 1) / (f + norm)


@dataclass
class Impacts:
    """blocks: level, term, blk, most, held (array of n, f, norm); documents: id, n, norm; n_all documents with words."""

    words: Words
    blocks: DataFrame
    documents: DataFrame
    n_all: int


def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, _range, _blk, most, held of the rows of one range (term, n, f, norm, c, _range), which lie in order. The last block of what has come
    waits for its word's next rows."""
    rest, told = None, 0  # rows of the block that waits, and its number

    def blocks(rows: pa.Table, at: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        """``at``: where each block begins, and where the last one ends."""
        held = pa.StructArray.from_arrays([rows[c].combine_chunks() for c in ("n", "f", "norm")], names=["n", "f", "norm"])
        first = rows.take(pa.array(at[:-1]))
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), held)
        return pa.RecordBatch.from_arrays([first["term"].combine_chunks(), first["_range"].combine_chunks(), pa.array(numbers, pa.int64()), first["c"].combine_chunks(), lists], names=["term", "_range", "_blk", "most", "held"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch], rest.schema)])
        words = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        begins = np.concatenate([[0], np.flatnonzero(words[1:] != words[:-1]) + 1])
        nth = np.arange(len(words)) - np.repeat(begins, np.diff(np.append(begins, len(words))))
        at = np.flatnonzero(nth % BLOCK == 0)
        numbers = nth[at] // BLOCK
        if rest is not None:
            numbers[words[at] == words[0]] += told  # a word's rows lie together: only the one that waited
        if len(at) > 1:
            yield blocks(rows.slice(0, at[-1]), at, numbers[:-1])
        rest, told = rows.slice(at[-1]), int(numbers[-1])
    if rest is not None:
        yield blocks(rest, np.array([0, rest.num_rows]), np.array([told]))


def build(words: Words, folder: str) -> Impacts:
    """Write the blocks of all words of the index. Rows are sorted in ranges of (term, contribution), and blocks are cut within a range and
    numbered by the blocks of the ranges before, so a word that most documents hold is spread over ranges and tasks. What a step has
    shuffled goes before the next one, as the rows are many times the index."""
    spark = words.saved.rows.sparkSession
    mean = F.broadcast(words.idx.documents.agg(F.avg("n_tokens").alias("mean")))  # one row
    norm = F.lit(K1 * (1 - B)) + K1 * B * F.col("n_tokens") / F.col("mean")
    words.idx.documents.join(words.numbers, "id").crossJoin(mean).select("id", "n", norm.alias("norm")).write.parquet(f"{folder}/documents")
    documents = spark.read.parquet(f"{folder}/documents").hint("merge")  # as many as the corpus has
    rows = words.idx.weighed().join(documents.select("id", "n", "norm"), "id")
    rows = rows.select("term", "n", "f", "norm", contribution(F.col("f"), F.col("norm")).alias("c"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.desc("c"), F.col("n"))
    sorted_rows = rows.repartitionByRange(parts, "term", *order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions("term", *order)
    sorted_rows.mapInArrow(cut_blocks, f"term string, _range int, _blk long, most double, {HELD}").write.option("compression", "zstd").parquet(f"{folder}/ranges")
    released(spark)
    cut = spark.read.parquet(f"{folder}/ranges")
    sizes = cut.groupBy("term", "_range").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("term").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("_before", before).filter("_before > 0").select("term", "_range", "_before")  # of a range only the first word lies in earlier ones too
    blk = F.col("_blk") + F.coalesce("_before", F.lit(0))
    blocks = cut.join(F.broadcast(starts), ["term", "_range"], "left").select("term", blk.alias("blk"), "most", "held")
    level = F.when(F.col("blk") == 0, 0).otherwise(1 + F.floor(F.log(F.col("blk") + 0.5) / F.log(F.lit(4.0)))).cast("int")
    # in the file order of words, as they lie in ranges, so that a scan for some of them skips files and row groups
    ready = blocks.withColumn("level", level).sortWithinPartitions("level", "term", "blk")
    ready.write.partitionBy("level").option("compression", "zstd").parquet(f"{folder}/blocks")
    dropped(spark, f"{folder}/ranges")
    released(spark)
    return opened(spark, words, folder)


def opened(spark: SparkSession, words: Words, folder: str) -> Impacts:
    documents = spark.read.parquet(f"{folder}/documents").hint("merge")
    return Impacts(words, spark.read.schema(f"term string, blk long, most double, {HELD}, level int").parquet(f"{folder}/blocks"), documents, documents.count())


def _lower_bounds(entries: DataFrame, of: list[str]) -> DataFrame:
    """of, n, s: score by the places given (query_id, tier, chip, grp, part, w, n, f, norm)."""
    part = entries.groupBy(*of, "chip", "grp", "part", "w", "n").agg(F.sum("f").alias("_f"), F.first("norm").alias("norm"))
    return part.groupBy(*of, "n").agg(F.sum(F.col("w") * contribution(F.col("_f"), F.col("norm"))).alias("s"))


def asked_parts(parts: DataFrame, needs: DataFrame, spread: DataFrame, n_all: int) -> DataFrame:
    """query_id, tier, chip, grp, part, kind, unit, w: own words for tier 1, all for tier 2, weighed by how rare they are.
    ``spread``: kind, unit, n (documents); ``needs``: query_id, tier."""
    idf = F.greatest(F.log((F.lit(n_all) - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    rows = parts.join(spread, ["kind", "unit"]).join(needs.select("query_id", "tier"), "query_id").filter((F.col("tier") == 2) | (F.col("grp") < RELATED))
    return rows.select("query_id", "tier", "chip", "grp", "part", "kind", "unit", idf.alias("w"))


def kept_blocks(asked: DataFrame, heads: DataFrame, tails: DataFrame, thresholds: DataFrame) -> DataFrame:
    """query_id, tier, chip, grp, part, w, term, blk of the blocks that can reach their query's threshold. ``asked``: parts with their
    ``term``; ``heads``: term, most of first blocks; ``tails``: term, blk, most of all; ``thresholds``: query_id, tier, least (null: read all)."""
    key = ["query_id", "tier", "chip", "grp", "part"]
    # a phrase has no blocks: it is scored as it is found, and may add all that a word can
    tops = asked.join(heads.select("term", F.col("most").alias("top")), "term", "left").withColumn("top", F.when(F.col("kind") == "phrase", F.lit(K1 + 1)).otherwise(F.coalesce("top", F.lit(0.0))))
    of_part = tops.groupBy(*key, "w").agg(F.sum("top").alias("_tops")).withColumn("_part", F.col("w") * F.least(F.lit(K1 + 1), F.col("_tops")))
    whole = of_part.groupBy("query_id", "tier").agg(F.sum("_part").alias("_whole"))
    rows = tops.filter("kind <> 'phrase'").join(of_part.select(*key, "_tops", "_part"), key).join(whole, ["query_id", "tier"]).join(thresholds, ["query_id", "tier"])
    rows = rows.join(tails, "term")
    reach = F.col("_whole") - F.col("_part") + F.col("w") * F.least(F.lit(K1 + 1), F.col("most") + F.col("_tops") - F.col("top"))
    return rows.filter(F.col("least").isNull() | (reach >= F.col("least") - SLACK)).select(*key, "w", "term", "blk")


def best(parts: DataFrame, members: DataFrame, needs: DataFrame, spread: DataFrame, places: DataFrame, impacts: Impacts) -> DataFrame:
    """query_id, id, tier, score of at least the ``need`` best matches of each query and tier, ties included, all of them with exact scores.

    ``parts`` as ``bitmaps.parts_of`` gives them; ``members``: query_id, n, tier; ``needs``: query_id, tier, need, held (matches); ``spread``:
    kind, unit, n; ``places`` as ``bitmaps.phrase_places`` gives them."""
    idx, key = impacts.words.idx, ["query_id", "tier"]
    asked = asked_parts(parts, needs, spread, impacts.n_all)
    units = asked.select("kind", "unit").distinct()
    by_term = asked.join(bitmaps.terms_of(units, idx), ["kind", "unit"])
    phrases = asked.filter("kind = 'phrase'").withColumn("term", F.lit(None).cast("string"))
    wide = stored(by_term.unionByName(phrases), "asked-terms")
    members = stored(members, "members")

    # phrases are scored from their places
    runs = places.join(impacts.documents.select("id", "n", "norm"), "id")
    of_phrases = stored(wide.filter("kind = 'phrase'").join(runs, "unit").join(members, [*key, "n"]).select(*key, "chip", "grp", "part", "w", "n", "f", "norm"), "phrases")

    def entries(chosen: DataFrame, blocks: DataFrame) -> DataFrame:
        """Places in blocks of the matches of the queries that read them."""
        rows = chosen.join(blocks, ["term", "blk"]).select(*key, "chip", "grp", "part", "w", F.explode("held").alias("x")).select(*key, "chip", "grp", "part", "w", "x.*")
        return rows.join(members, [*key, "n"]).select(*key, "chip", "grp", "part", "w", "n", "f", "norm").unionByName(of_phrases)

    terms = wide.filter("kind <> 'phrase'")
    first = impacts.blocks.filter("level = 0")
    picky = needs.filter("held > need").select(*key, "need")
    opening = entries(terms.join(picky.select(*key), key, "left_semi").withColumn("blk", F.lit(0).cast("long")).drop("kind", "unit"), first.select("term", "blk", "held"))
    lower = _lower_bounds(opening, key).join(picky, key)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("s")))
    reached = lower.withColumn("_nth", nth).filter(F.col("_nth") <= F.col("need")).groupBy(*key).agg(F.min("s").alias("_s"), F.max("_nth").alias("_r"), F.first("need").alias("_need"))
    least = needs.select(*key).join(reached.filter("_r = _need").select(*key, F.col("_s").alias("least")), key, "left")
    kept = stored(kept_blocks(wide, first.select("term", "most"), impacts.blocks.select("term", "blk", "most"), stored(least, "thresholds")), "kept-blocks")
    deepest = kept.agg(F.max("blk")).first()[0]
    if deepest is None:
        scored = _lower_bounds(of_phrases, key)
    else:
        read = impacts.blocks.filter(F.col("blk") <= deepest).filter(F.col("level") <= _level(deepest))
        scored = _lower_bounds(entries(kept, read.select("term", "blk", "held")), key)
    discount = F.when(F.col("tier") == 1, F.col("s")).otherwise(F.col("s") * RELATED_DISCOUNT)
    return scored.join(impacts.documents.select("id", "n"), "n").select("query_id", "id", "tier", F.round(discount, PLACES).alias("score"))


def _level(blk: int) -> int:
    level = 0
    while blk >= 4**level:
        level += 1
    return level


def ranked(scored: DataFrame, needs: DataFrame) -> DataFrame:
    """``scored`` with rank: tier 1 by score, then tier 2, ``need`` of each; ties by id. ``needs``: query_id, tier, need."""
    within = Window.partitionBy("query_id", "tier").orderBy(F.desc("score"), "id")
    kept = scored.join(needs.select("query_id", "tier", "need"), ["query_id", "tier"]).withColumn("_nth", F.row_number().over(within)).filter(F.col("_nth") <= F.col("need"))
    order = Window.partitionBy("query_id").orderBy("tier", "_nth")
    return kept.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "tier", "score", "rank")


def tier_needs(counts: DataFrame, depth: Column) -> DataFrame:
    """query_id, tier, need, held: how many matches each tier gives to the first ``depth``; a tier that gives none has no row. ``counts``:
    query_id, n, n_direct."""
    rows = counts.withColumn("_depth", depth.cast("long"))
    one = F.least("n_direct", "_depth")
    two = F.least(F.col("n") - F.col("n_direct"), F.col("_depth") - one)
    each = F.array(F.struct(F.lit(1).alias("tier"), one.alias("need"), F.col("n_direct").alias("held")), F.struct(F.lit(2).alias("tier"), two.alias("need"), (F.col("n") - F.col("n_direct")).alias("held")))
    return rows.select("query_id", F.inline(each)).filter("need > 0")
