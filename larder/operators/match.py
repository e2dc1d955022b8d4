"""Matching of a table of query terms against postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import phrases
from larder.operators.index import Index
from larder.operators.query import MOST_CHIPS


#: Queries of one text have numbers from its id times this on.
PIECES = 1000


def query_chips(texts: DataFrame, id_column: str, text_column: str, words) -> DataFrame:
    """query_id, chip, term: the distinct words of a text as chips of one word. A query may have ``MOST_CHIPS``, so a longer text makes
    several: ``query_id`` is the text's id times ``PIECES`` and the number of the query. ``words`` is the analysis of the index."""
    rows = texts.select(F.col(id_column).alias("_id"), F.posexplode(F.array_distinct(words(F.col(text_column)))).alias("_nth", "term"))
    nth = F.col("_nth")
    return rows.select((F.col("_id") * PIECES + F.floor(nth / MOST_CHIPS)).alias("query_id"), (nth % MOST_CHIPS).alias("chip"), "term")


def term_hits(chips: DataFrame, post: DataFrame) -> DataFrame:
    """query_id, chip, id: documents that hold the chip's word in any field. A word is looked up once for all its chips."""
    held = post.join(chips.select("term").distinct(), "term", "left_semi").select("term", "id").distinct()
    return chips.select("query_id", "chip", "term").join(held, "term").select("query_id", "chip", "id")


def prefix_hits(chips: DataFrame, idx: Index) -> DataFrame:
    """As ``term_hits``, with the word as a prefix: the vocabulary is searched first, by its leading letters.

    A prefix is looked up once for all its chips: its documents are told apart before they are given to the chips, not once for each."""
    vocabulary = idx.terms.select("term", F.left("term", F.lit(3)).alias("lead"))
    words = chips.filter(F.length("term") >= 3).select("query_id", "chip", F.col("term").alias("prefix")).distinct()
    asked = words.select("prefix").distinct().withColumn("lead", F.left("prefix", F.lit(3)))
    found = asked.join(vocabulary, "lead").filter(F.col("term").startswith(F.col("prefix"))).select("term", "prefix")
    held = idx.weighed().select("term", "id").join(F.broadcast(found), "term").select("prefix", "id").distinct()  # as few as the queries' words and what they begin
    return held.join(F.broadcast(words), "prefix").select("query_id", "chip", "id")


def phrase_hits(chips: DataFrame, idx: Index) -> DataFrame:
    """query_id, id: documents in which all chips' words stand one after another in one field."""
    runs = phrases.begins(chips.select(F.col("query_id").alias("phrase"), F.col("chip").alias("part"), "term"), idx)
    return runs.select(F.col("phrase").alias("query_id"), "id").distinct()


def combine(hits: DataFrame, chips: DataFrame, mode: str) -> DataFrame:
    """query_id, id: documents hit by every chip (``all``) or by one at least (``any``)."""
    held = hits.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("held"))  # each chip and document once
    if mode == "any":
        return held.select("query_id", "id")
    sizes = chips.groupBy("query_id").agg(F.count_distinct("chip").alias("n"))
    return held.join(sizes, "query_id").filter("held = n").select("query_id", "id")


def substring_hits(words: DataFrame, docs: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """query_id, id: documents with every word of the query as a literal substring of one of ``columns`` (texts of the item, its
    tags and its collections' names).

    A theta join: the words of a query table are few; Spark broadcasts them if their size allows. Words of several queries
    are looked for once."""
    inside = F.lit(False)
    for c in columns:
        inside = inside | F.contains(F.lower(F.col(c)), F.col("word"))
    distinct = words.select("query_id", F.lower("word").alias("word")).distinct()
    held = docs.join(distinct.select("word").distinct(), inside).select(F.col(id_column).alias("id"), "word").distinct()
    found = held.join(distinct, "word").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("held"))
    sizes = distinct.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return found.join(sizes, "query_id").filter("held = n").select("query_id", "id")


def chip_counts(hits: DataFrame, chips: DataFrame, cap: int = 10_001) -> DataFrame:
    """query_id, chip, term, n: documents of each chip alone, counted up to ``cap``; 0 if there are none."""
    counted = hits.groupBy("query_id", "chip").agg(F.least(F.count_distinct("id"), F.lit(cap)).alias("n"))
    return chips.join(counted, ["query_id", "chip"], "left").select("query_id", "chip", "term", F.coalesce("n", F.lit(0)).alias("n"))


def narrowest_chip(counts: DataFrame) -> DataFrame:
    """query_id, chip: the chip with the fewest matches, the first of equals."""
    return counts.groupBy("query_id").agg(F.min_by("chip", F.struct("n", "chip")).alias("chip"))
