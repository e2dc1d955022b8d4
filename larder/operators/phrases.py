"""Places of phrases in postings, found from their rarest words, so that work follows the rare words and not the frequent ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.index import Index
from larder.sources.snapshots import stored

_PLACE = ["term", "id", "field", "pos"]


def begins(words: DataFrame, idx: Index) -> DataFrame:
    """phrase, id, field, begin of every place where the words of a phrase stand one after another in a field. ``words``: phrase (of any
    kind), part (from 0), term; a part once.

    Candidates are the places of each phrase's rarest word; those with the second rarest word beside it are asked for the rest. A
    frequent word's postings are read once for all phrases, and joined by whole places: no key of theirs is skewed."""
    counted = words.join(idx.terms.select("term", "n_places"), "term", "left")
    rarest = F.array_sort(F.collect_list(F.struct(F.coalesce("n_places", F.lit(0)).alias("n"), "part", "term")))
    by = counted.groupBy("phrase").agg(rarest.alias("_by")).filter(F.col("_by")[0]["n"] > 0)
    by = stored(by, "phrases")
    second, begin = F.get("_by", F.lit(1)), F.col("pos") - F.col("_at")
    first = by.select("phrase", F.col("_by")[0]["term"].alias("term"), F.col("_by")[0]["part"].alias("_at"), second["term"].alias("_term"), second["part"].alias("_part"))
    rows = first.join(idx.postings, "term").select("phrase", "id", "field", begin.alias("begin"), F.col("_term").alias("term"), (begin + F.col("_part")).alias("pos"))
    near = _found(rows.filter("begin >= 0"), first.select(F.col("_term").alias("term")), idx).filter("term IS NULL OR _there")
    others = by.select("phrase", F.explode_outer(F.slice("_by", 3, F.size("_by"))).alias("x")).select("phrase", "x.part", "x.term")
    asked = near.select("phrase", "id", "field", "begin").join(others, "phrase").withColumn("pos", F.col("begin") + F.col("part")).drop("part")
    held = _found(asked, others.select("term"), idx)
    whole = held.groupBy("phrase", "id", "field", "begin").agg(F.bool_and(F.col("term").isNull() | F.coalesce("_there", F.lit(False))).alias("_whole"))
    return whole.filter("_whole").drop("_whole")


def _found(rows: DataFrame, asked: DataFrame, idx: Index) -> DataFrame:
    """``rows`` with ``_there`` where a word stands at the place (term, id, field, pos)."""
    there = idx.postings.join(asked.filter("term IS NOT NULL").distinct(), "term", "left_semi").select(*_PLACE, F.lit(True).alias("_there"))
    return rows.join(there, _PLACE, "left")
