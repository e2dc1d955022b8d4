"""Scores, ranks, totals, facets and pages of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.index import Index, weight_of

K1, B = 1.2, 0.75
TOTAL_CAP = 10_001
RANK_DEPTH = 1000
#: Leading results that facets are counted over.
CANDIDATES = 300


#: Words of queries in documents that a task adds up, about.
TASK_HITS = 1 << 20


def bm25(chips: DataFrame, idx: Index, matches: DataFrame | None = None) -> DataFrame:
    """query_id, id, score: BM25 of the words of ``chips`` (query_id, term) in each document, or in each of ``matches``.

    What a word adds to a document's score is worked out once for all queries that hold the word. Places are dealt by document, to as many
    tasks as the hits ask for, and added up where they lie: no task holds a frequent word's documents, and hits are never shuffled. What is
    broadcast is as large as what is asked."""
    corpus = idx.documents.agg(F.count(F.lit(1)).alias("n_all"), F.avg("n_tokens").alias("mean"))
    asked = chips.select("query_id", "term").distinct()
    words = idx.terms.join(asked.groupBy("term").agg(F.count(F.lit(1)).alias("_asking")), "term")
    hits = words.agg(F.sum(F.col("n_docs") * F.col("_asking"))).first()[0] or 0
    parts = max(int(chips.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hits // TASK_HITS))
    places = idx.postings.join(F.broadcast(words.select("term", "n_docs")), "term").repartition(parts, "id")
    held = places.groupBy("term", "id", F.col("n_docs").alias("n")).agg(F.sum(weight_of(F.col("field"))).alias("f"))
    idf = F.greatest(F.log((F.col("n_all") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    norm = F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean"))
    added = held.join(idx.documents.hint("merge"), "id").crossJoin(F.broadcast(corpus)).select("term", "id", (idf * F.col("f") * (K1 + 1) / norm).alias("part"))  # one row
    scored = added.join(F.broadcast(asked), "term")
    if matches is not None:
        scored = scored.join(matches.select("query_id", "id"), ["query_id", "id"], "left_semi")
    return scored.groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def ranked(scores: DataFrame, depth: int) -> DataFrame:
    """The first ``depth`` documents of each query by score, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)


def sorted_page(matches: DataFrame, key: Column, page: int, after: tuple | None = None) -> DataFrame:
    """The first ``page`` matches of each query by ``key`` and id, both descending, after (key, id) if given."""
    rows = matches.withColumn("sort_key", F.coalesce(key, F.lit(0)))
    if after:
        rows = rows.filter((F.col("sort_key") < after[0]) | ((F.col("sort_key") == after[0]) & (F.col("id") < after[1])))
    order = Window.partitionBy("query_id").orderBy(F.desc("sort_key"), F.desc("id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= page)


def totals(matches: DataFrame, cap: int = TOTAL_CAP) -> DataFrame:
    """query_id, total, capped: matches counted up to ``cap``. Counts are added up map-side, so a cap saves nothing before."""
    return matches.groupBy("query_id").agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("total"), (F.count(F.lit(1)) >= cap).alias("capped"))


def facets(results: DataFrame, values: DataFrame, most: int, depth: int = CANDIDATES) -> DataFrame:
    """query_id, key, text, n: the most frequent ``values`` (id, key, text) among each query's leading results, ties by text.

    Values are counted by ``key``, so that two of the same text stay apart."""
    lead = results.filter(F.col("rank") <= depth).select("query_id", "id")
    counted = lead.join(values.filter("text <> ''"), "id").groupBy("query_id", "key", "text").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), "text", "key")
    return counted.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)


#: Most values of each kind of facet, and of suggestions.
FACETS = {"hashtag": 24, "collection": 8, "author": 8}
SUGGESTED = {"hashtag": 6, "collection": 3, "author": 3}
#: Tags that describe the platform, not the content.
NOISE_TAGS = ("fyp", "fypage", "foryou", "foryoupage", "fy", "viral", "trending", "trend", "tiktok", "xyzbca", "fypシ", "parati", "explore")


def all_facets(results: DataFrame, tags: DataFrame, collections: DataFrame, authors: DataFrame) -> DataFrame:
    """query_id, source, text, n, nth over the leading results. ``tags``, ``authors``: id, text; ``collections``: id, key, text."""
    by_text = lambda df: df.select("id", F.col("text").alias("key"), "text")
    out = None
    for source, values in (("hashtag", by_text(tags)), ("collection", collections.select("id", F.col("key").cast("string").alias("key"), "text")), ("author", by_text(authors))):
        one = facets(results, values, FACETS[source]).select("query_id", F.lit(source).alias("source"), "text", "n", "nth")
        out = one if out is None else out.unionByName(one)
    return out


def suggestions(counted: DataFrame, chips: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, source, text, n: facets worth adding as a chip: not a chip or one of its words already (``chips``: query_id,
    key), no noise tag, and seen twice at least where there are 20 leading results or more."""
    used = chips.select("query_id", F.explode(F.array_distinct(F.concat(F.array("key"), F.split("key", " ")))).alias("_used")).distinct()
    sample = results.filter(F.col("rank") <= CANDIDATES).groupBy("query_id").agg(F.count(F.lit(1)).alias("_sample"))
    worth = counted.join(sample, "query_id").filter(F.col("n") >= F.when(F.col("_sample") >= 20, 2).otherwise(1))
    worth = worth.filter(~((F.col("source") == "hashtag") & F.lower("text").isin(*NOISE_TAGS))).withColumn("_used", F.lower("text")).join(used, ["query_id", "_used"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("nth"))
    most = F.create_map(*[F.lit(x) for kv in SUGGESTED.items() for x in kv])[F.col("source")]
    return worth.withColumn("_k", nth).filter(F.col("_k") <= most).select("query_id", "source", "text", "n")


def vocabulary(tags: DataFrame, authors: DataFrame, collections: DataFrame, categories: DataFrame, aliases: DataFrame) -> DataFrame:
    """word: tags, handles, collection names (each a column ``text``) and the keys of the lexicon, once each, in lower case."""
    every = tags.select("text").unionByName(authors.select("text")).unionByName(collections.select("text"))
    keys = categories.select(F.col("category").alias("text")).unionByName(aliases.select(F.col("alias").alias("text")))
    return every.unionByName(keys).filter("text <> ''").select(F.lower("text").alias("word")).distinct()


def appended(shown: DataFrame, more: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``shown`` and what ``more`` adds to it: each ``key`` once, where it comes first; a row that is shown stays."""
    rows = shown.withColumn("_page", F.lit(0)).unionByName(more.withColumn("_page", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(key).orderBy("_page", *order))
    return rows.withColumn("_nth", first).filter("_nth = 1").drop("_nth", "_page")


def hydrated(results: DataFrame, items: DataFrame, names: DataFrame, id_column: str = "external_id") -> DataFrame:
    """``results`` (query_id, id, rank ..) with the columns of their items, tags in order and once, and their collections' names
    (``names``: id, text) in order."""
    wanted = results.select("id").distinct()
    shown = items.withColumnRenamed(id_column, "id").join(wanted, "id", "left_semi").withColumn("hashtags", F.array_sort(F.array_distinct("hashtags")))
    listed = names.join(wanted, "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("text")).alias("collections"))
    return results.join(shown, "id").join(listed, "id", "left").withColumn("collections", F.coalesce("collections", F.array().cast("array<string>")))


def retrieval_quality(matches: DataFrame, labelled: DataFrame) -> DataFrame:
    """query_id, hits, found, wanted from matches and labelled (query_id, id): what recall and precision are made of."""
    got, want = matches.select("query_id", "id", F.lit(1).alias("got")), labelled.select("query_id", "id", F.lit(1).alias("want"))
    both = got.join(want, ["query_id", "id"], "full_outer")
    return both.groupBy("query_id").agg(F.count_if(F.col("got").isNotNull() & F.col("want").isNotNull()).alias("hits"), F.count("got").alias("found"), F.count("want").alias("wanted"))


def quality_by_label(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """label, queries, hits, found, wanted, recall, precision of each label (``labels``: query_id, label) and, with a null label,
    of all queries, from ``retrieval_quality``. A ratio over nothing is null."""
    share = lambda part, whole: F.round(F.sum(part) / F.nullif(F.sum(whole), F.lit(0)), 6)
    sums = [F.count(F.lit(1)).alias("queries"), *[F.sum(c).alias(c) for c in ("hits", "found", "wanted")], share("hits", "wanted").alias("recall"), share("hits", "found").alias("precision")]
    return counts.join(labels, "query_id").groupingSets([["label"], []], "label").agg(*sums)
