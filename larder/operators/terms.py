"""Terms of a table of queries, their places in the index, and matches by own words and by related terms.

A term row is (query_id, chip, grp, kind, term, part, parts): the rows of one group must all be found in a document (in any
field; kind ``phrase`` one after another in one field), the groups of a chip are alternatives. Groups below ``RELATED`` hold
the chip's own words, higher ones its related terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators import phrases
from larder.operators.index import Index, weight_of
from larder.operators.rank import B, K1, RANK_DEPTH, TOTAL_CAP
from larder.sources.snapshots import stored

RELATED = 10
#: The last word of a chip is a prefix from this length on.
LEAST_PREFIX = 3
RELATED_DISCOUNT = 0.4
_ROW = ["query_id", "chip", "grp", "kind", "term", "part", "parts"]


def _rows(grp: Column | int, kind: Column | str, words: Column, parts: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.transform(words, lambda w, i: F.struct(lit(grp).cast("int").alias("grp"), lit(kind).alias("kind"), w.alias("term"), i.cast("int").alias("part"), lit(parts).cast("int").alias("parts")))


def own_terms(chips: DataFrame, words) -> DataFrame:
    """Term rows of chips (query_id, chip, text): every word, the last one as a prefix, or all words written as one.

    ``words`` is the analysis of the index that is asked."""
    w, n = F.col("_w"), F.size("_w")
    last = F.element_at("_w", -1)
    joined = F.when(n > 1, F.array(F.array_join(w, ""))).otherwise(F.array().cast("array<string>"))
    long_last = F.length(last) >= LEAST_PREFIX
    single = F.transform(_rows(0, "exact", w, n), lambda r: r.withField("kind", F.when((r["part"] == n - 1) & long_last, "prefix").otherwise("exact")))
    every = F.concat(single, _rows(1, "prefix", joined, 1))
    held = chips.select("query_id", "chip", words(F.col("text")).alias("_w")).filter(n > 0)
    return held.select("query_id", "chip", F.inline(every)).select(_ROW)


def related_terms(related: DataFrame, words) -> DataFrame:
    """Term rows of related terms (query_id, chip, ord, term): an exact word, or a phrase and its words written as one."""
    w, n, at = F.col("_w"), F.size("_w"), F.col("ord") * 2 + RELATED
    joined = F.when(n > 1, F.array(F.array_join(w, ""))).otherwise(F.array().cast("array<string>"))
    every = F.concat(_rows(at, F.when(n > 1, "phrase").otherwise("exact"), w, n), _rows(at + 1, "exact", joined, 1))
    return related.select("query_id", "chip", "ord", words(F.col("term")).alias("_w")).filter(n > 0).select("query_id", "chip", F.inline(every)).select(_ROW)


def whole_terms(terms: DataFrame, idx: Index) -> DataFrame:
    """``terms`` with prefixes replaced by the words of the vocabulary that begin so, looked up by their first letters."""
    lead = F.explode(F.array_distinct(F.array(F.left("term", F.lit(2)), F.left("term", F.lit(3)))))
    vocabulary = idx.terms.select("term", lead.alias("lead"))
    asked = terms.filter("kind = 'prefix'").withColumnRenamed("term", "prefix").withColumn("lead", F.left("prefix", F.lit(3)))
    found = asked.join(vocabulary, "lead").filter(F.col("term").startswith(F.col("prefix"))).select(_ROW)
    return terms.filter("kind <> 'prefix'").unionByName(found)


def placed(rows: DataFrame) -> DataFrame:
    """query_id, chip, grp, part, parts, id, field of whole terms at their places (``rows``: term rows with id, field, pos); a phrase
    is one part."""
    single = rows.filter("kind <> 'phrase'").select("query_id", "chip", "grp", "part", "parts", "id", "field")
    runs = rows.filter("kind = 'phrase'").groupBy("query_id", "chip", "grp", "parts", "id", "field", (F.col("pos") - F.col("part")).alias("_begin")).agg(F.count_distinct("part").alias("_held"))
    return single.unionByName(runs.filter("_held = parts").select("query_id", "chip", "grp", F.lit(0).alias("part"), F.lit(1).alias("parts"), "id", "field"))


def places(terms: DataFrame, idx: Index) -> DataFrame:
    """query_id, chip, grp, part, parts, id, f: the weighted number of a term's places in a document; a phrase is one part.

    Matches and scores all start from this one aggregate; write it once (``snapshots.stored``) before both are asked for."""
    held = ["query_id", "chip", "grp", "part", "parts", "id", "field"]
    single = whole_terms(terms.filter("kind <> 'phrase'"), idx).join(idx.postings, "term").select(held)
    words = terms.filter("kind = 'phrase'").select(F.struct("query_id", "chip", "grp").alias("phrase"), "part", "term")
    runs = phrases.begins(words, idx).select("phrase.*", F.lit(0).alias("part"), F.lit(1).alias("parts"), "id", "field")
    every = single.unionByName(runs)
    return every.groupBy("query_id", "chip", "grp", "part", "parts", "id").agg(F.sum(weight_of(F.col("field"))).alias("f"))


def explain(terms: DataFrame, results: DataFrame, related: DataFrame, chips: DataFrame, idx: Index) -> DataFrame:
    """query_id, id, chip, via, fields, term of each result (query_id, id) and chip (query_id, chip).

    ``via``: direct if the chip's own words are found, else related if a related term is, else none; ``fields``: those in
    which that is so within the field alone, in order; ``term``: the first related term that was found."""
    # only the words of the results are looked at, however many words a prefix has
    shown = results.select("query_id", "id").distinct()
    held = stored(idx.postings.join(shown.select("id").distinct(), "id", "left_semi"), "result-words")
    rows = placed(stored(whole_terms(terms, idx), "whole-terms").join(shown.join(held, "id"), ["query_id", "term"]))
    group = ["query_id", "chip", "grp", "parts", "id"]
    overall = rows.groupBy(*group).agg(F.count_distinct("part").alias("_held")).filter("_held = parts")
    inside = rows.groupBy(*group, "field").agg(F.count_distinct("part").alias("_held")).filter("_held = parts")
    ways = overall.groupBy("query_id", "chip", "id").agg(F.min("grp").alias("_least"), F.min(F.when(F.col("grp") >= RELATED, F.floor((F.col("grp") - RELATED) / 2))).alias("_ord"))
    own = inside.join(ways, ["query_id", "chip", "id"]).filter((F.col("_least") >= RELATED) | (F.col("grp") < RELATED))
    fields = own.groupBy("query_id", "chip", "id").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))
    asked = results.select("query_id", "id").distinct().join(chips.select("query_id", "chip").distinct(), "query_id")
    named = related.select("query_id", "chip", F.col("ord").cast("long").alias("_ord"), F.col("term"))
    told = asked.join(ways, ["query_id", "chip", "id"], "left").join(fields, ["query_id", "chip", "id"], "left")
    via = F.when(F.col("_least") < RELATED, "direct").when(F.col("_least").isNotNull(), "related").otherwise("none")
    told = told.withColumn("via", via).withColumn("_ord", F.when(F.col("via") == "related", F.col("_ord"))).join(named, ["query_id", "chip", "_ord"], "left")
    return told.select("query_id", "id", "chip", "via", F.coalesce("fields", F.lit("")).alias("fields"), "term")


def chip_matches(found: DataFrame) -> DataFrame:
    """query_id, chip, id, own: documents in which one of the chip's groups is complete; own = a group of its own words."""
    whole = found.groupBy("query_id", "chip", "grp", "parts", "id").agg(F.count_if(F.col("f") > 0).alias("_held")).filter("_held = parts")
    return whole.groupBy("query_id", "chip", "id").agg(F.max(F.col("grp") < RELATED).alias("own"))


def query_matches(hits: DataFrame, sizes: DataFrame, mode: str) -> DataFrame:
    """query_id, id, direct: documents that every chip (``all``) or one (``any``) matches; direct = by own words alone.

    ``hits`` (query_id, chip, id, own; each chip and id once) may come from ``chip_matches`` and from substring chips;
    ``sizes``: query_id, n_chips."""
    held = hits.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("_n"), F.count_if("own").alias("_own"))
    need = F.col("n_chips") if mode == "all" else F.lit(1)
    return held.join(sizes, "query_id").filter(F.col("_n") >= need).select("query_id", "id", (F.col("_own") >= need).alias("direct"))


def scores(found: DataFrame, matches: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, id, tier, score: weighted BM25 of own words for direct matches (tier 1), of all terms at a discount for others."""
    part = ["query_id", "chip", "grp", "part"]
    spread = found.groupBy(*part).agg(F.count_if(F.col("f") > 0).alias("n"))
    corpus = documents.agg(F.count(F.lit(1)).alias("n_all"), F.avg("n_tokens").alias("mean"))
    idf = F.greatest(F.log((F.col("n_all") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    value = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean")))
    rows = found.join(matches, ["query_id", "id"]).filter(~F.col("direct") | (F.col("grp") < RELATED))
    scored = rows.join(spread, part).join(documents, "id").crossJoin(F.broadcast(corpus))  # one row
    total = scored.groupBy("query_id", "id", "direct").agg(F.sum(value).alias("_s"))
    return total.select("query_id", "id", F.when(F.col("direct"), 1).otherwise(2).alias("tier"), F.round(F.when(F.col("direct"), F.col("_s")).otherwise(F.col("_s") * RELATED_DISCOUNT), 6).alias("score"))


def rank_tiers(scored: DataFrame, depth: int = RANK_DEPTH) -> DataFrame:
    """``scored`` with rank: own-word matches by score, then related ones, down to ``depth``; ties by id."""
    order = Window.partitionBy("query_id").orderBy("tier", F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)


def after(rest: DataFrame, depth: int) -> DataFrame:
    """query_id, id, rank of matches without a score (query_id, id, _last: the rank that they follow), by id, down to ``depth``."""
    order = Window.partitionBy("query_id").orderBy("id")
    first = rest.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= depth)
    return first.select("query_id", "id", (F.col("_nth") + F.coalesce("_last", F.lit(0))).cast("int").alias("rank")).filter(F.col("rank") <= depth)


def list_modes(matches: DataFrame, most: int = TOTAL_CAP - 1) -> DataFrame:
    """query_id, total, mode: ``direct`` (own-word matches alone are too many: those, newest saved first), ``full`` (all
    matches are: all of them, newest first) or ``relevance``. The total is counted up to one more than ``most``."""
    n = matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if("direct").alias("_d"))
    related = F.col("_n") > F.col("_d")
    mode = F.when(related & (F.col("_d") > most), "direct").when(F.col("_n") > most, "full").otherwise("relevance")
    return n.select("query_id", F.least("_n", F.lit(most + 1)).alias("total"), mode.alias("mode"))


def listed(matches: DataFrame, modes: DataFrame, saved: DataFrame, page: int) -> DataFrame:
    """query_id, id, rank of queries listed by saved time (``saved``: id, saved_at), newest first, ties by id descending."""
    rows = matches.join(modes.filter("mode <> 'relevance'"), "query_id").filter((F.col("mode") == "full") | F.col("direct")).join(saved, "id")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("saved_at", F.lit(0))), F.desc("id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= page).select("query_id", "id", "rank")


def offset_page(ranked: DataFrame, requests: DataFrame) -> DataFrame:
    """query_id, id, rank, next_cursor: the page of each request (query_id, at, page, total) and the cursor after it, if any."""
    need = F.col("at") + F.col("page")
    rows = ranked.join(requests, "query_id").filter((F.col("rank") > F.col("at")) & (F.col("rank") <= need))
    more = need < F.least("total", F.lit(RANK_DEPTH))
    return rows.select("query_id", "id", "rank", F.when(more, F.concat_ws(":", F.lit("r"), need, "total")).alias("next_cursor"))
