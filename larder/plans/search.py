"""The whole search for a table of requests: chips, related terms, matches, ranked or listed pages with cursors, snippets, facets,
suggestions, spelling. Each request has a mode, a sort, a limit and a cursor of its own.

Matches are bitmaps (``operators.bitmaps``), so totals, counts of chips and the decision to list instead of rank need no row for a match.
What is ranked is scored by impact blocks (``operators.impacts``); what is listed is read off bitmaps in the order of saved time, or
from a layout sorted by the column (``operators.layout``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import nfkc, tokens
from larder.operators import bitmaps, enrich, impacts, layout, match, query, rank, terms
from larder.operators.bitmaps import Words
from larder.operators.impacts import Impacts
from larder.operators.index import Index
from larder.operators.layout import Layout
from larder.sources.snapshots import scratch, stored

#: Columns of items by sort.
SORT_COLUMNS = {"recently_saved": "saved_at", "newest": "posted_at", "most_viewed": "views"}
REQUEST = "mode string, sort string, limit int, cursor string"
#: Rows of a list at most: the candidates of a first page or the longest page, and one that tells whether there are more.
MOST_LISTED = max(rank.CANDIDATES, query.MOST_LIMIT) + 1


@dataclass
class Library:
    """What is searched: the index, items (external_id, author_handle, hashtags, saved_at ..), names of their collections (id, key,
    text), texts for substrings (external_id and text columns), and the lexicon. Columns of other sorts may be missing: all items are equal
    by them. ``link`` makes a result's link from an item's columns."""

    idx: Index
    items: DataFrame
    names: DataFrame
    texts: DataFrame
    categories: DataFrame
    aliases: DataFrame
    link: Callable[[], Column] | None = None
    _made: dict = field(default_factory=dict, repr=False)

    def sort_key(self, sort: str) -> DataFrame:
        """id, key."""
        column = SORT_COLUMNS[sort]
        key = F.col(column) if column in self.items.columns else F.lit(0)
        return self.items.select(F.col("external_id").alias("id"), F.coalesce(key.cast("long"), F.lit(0)).alias("key")).hint("merge")

    def keyed(self, sort: str) -> DataFrame:
        """n, id, key: an item's number and its key of another sort side by side, made once."""
        if ("keyed", sort) not in self._made:
            self._made["keyed", sort] = stored(self.words.numbers.join(self.sort_key(sort), "id"), "keyed")
        return self._made["keyed", sort].hint("merge")

    @property
    def impacts(self) -> Impacts:
        """Impact blocks, made once and read by all searches that rank."""
        if "impacts" not in self._made:
            self._made["impacts"] = impacts.build(self.words, scratch(self.items.sparkSession, "search-impacts"))
        return self._made["impacts"]

    @property
    def words(self) -> Words:
        """The index with its documents numbered, made once: what is counted and listed asks for no more."""
        if "words" not in self._made:
            self._made["words"] = bitmaps.build(self.idx, self.sort_key("recently_saved").withColumnRenamed("key", "saved_at"), scratch(self.items.sparkSession, "search-words"))
        return self._made["words"]

    def layout(self, sort: str) -> Layout:
        if sort == "recently_saved":
            return self.words.saved
        if sort not in self._made:
            self._made[sort] = layout.build(self.sort_key(sort), f"{scratch(self.items.sparkSession, 'layout')}/{sort}")
        return self._made[sort]


class Search:
    """Frames of one search. Each is worked out when it is asked for, and then kept; none is made for another that isn't.

    Of requests that are refused only ``requests`` tells anything."""

    def __init__(self, sent: DataFrame, library: Library, requests: DataFrame | None = None, too_broad: int = rank.TOTAL_CAP - 1):
        self.sent, self.library, self.too_broad = sent, library, too_broad
        given = requests if requests is not None else sent.select("query_id").distinct()
        for c in REQUEST.split(", "):
            name, kind = c.split()
            if name not in given.columns:
                given = given.withColumn(name, F.lit(None).cast(kind))
        self._given = given

    # what is asked

    @cached_property
    def chips(self) -> DataFrame:
        """query_id, chip, text, key, expand, reason: refused ones too."""
        return stored(query.deduped_chips(self.sent), "chips")

    @cached_property
    def requests(self) -> DataFrame:
        """query_id, mode, sort, limit, n_chips, substring, reason (null if it is answered), and the parts of the cursor: offset, value,
        item, own (a list of own words' matches), told (its total)."""
        refusal = F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("chip")))
        sizes = self.chips.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chips"), F.max(query.needs_substring(F.col("text"))).alias("substring"), refusal.alias("_refused"))
        rows = self._given.join(sizes, "query_id", "left").withColumns({"n_chips": F.coalesce("n_chips", F.lit(0)), "substring": F.coalesce("substring", F.lit(False))})
        checked = query.checked_requests(rows)
        offset, total = query.offset_cursor(F.col("cursor"))
        # what only a substring finds can't be ranked
        other = F.when(F.col("substring") & (F.col("sort") == "relevance") & F.col("cursor").rlike("^[rd]:"), "other_cursor")
        checked = checked.withColumns({"reason": F.coalesce("reason", "_refused", other), "sort": F.when(F.col("substring") & (F.col("sort") == "relevance"), "recently_saved").otherwise(F.col("sort"))})
        checked = checked.withColumn("_k", query.keyset_cursor(F.col("cursor")))
        parts = {"offset": offset, "value": F.col("_k.value"), "item": F.col("_k.id"), "own": F.coalesce("_k.direct", F.lit(False)), "told": F.coalesce(total, "_k.total")}
        return stored(checked.withColumns(parts).select("query_id", "mode", "sort", F.col("limit").cast("int"), "n_chips", "substring", "reason", *parts), "requests")

    @cached_property
    def _open(self) -> DataFrame:
        return self.requests.filter("reason IS NULL")

    @cached_property
    def _asked(self) -> DataFrame:
        """Chips of requests that are answered."""
        return stored(self.chips.join(self._open.select("query_id"), "query_id", "left_semi").withColumn("substring", query.needs_substring(F.col("text"))), "asked-chips")

    @cached_property
    def related(self) -> DataFrame:
        """query_id, chip, ord, term: related terms within their query's budget."""
        worded = self._asked.filter("expand AND NOT substring").select("query_id", "chip", F.col("key").alias("term"))
        found = query.expand_terms(worded, self.library.categories, self.library.aliases)
        return stored(query.budgeted(found, self._asked.withColumn("words", F.size(tokens(F.col("text"))))), "related")

    @cached_property
    def term_rows(self) -> DataFrame:
        words = self.library.idx.words
        return stored(terms.own_terms(self._asked.filter("NOT substring"), words).unionByName(terms.related_terms(self.related, words)), "terms")

    @cached_property
    def parts(self) -> DataFrame:
        return stored(bitmaps.parts_of(self.term_rows), "parts")

    # what matches

    @cached_property
    def _phrases(self) -> DataFrame:
        return stored(bitmaps.phrase_places(self.parts.select("kind", "unit").distinct(), self.library.idx), "phrase-places")

    @cached_property
    def _units(self) -> DataFrame:
        return stored(bitmaps.unit_bits(self.parts.select("kind", "unit").distinct(), self.library.words, self._phrases), "units")

    @cached_property
    def _chip_bits(self) -> DataFrame:
        by_word = bitmaps.chip_bits(self.parts, self._units)
        parts = self._asked.filter("substring").select(F.struct("query_id", "chip").alias("query_id"), F.explode(F.split("text", " ")).alias("word"))
        texts = self.library.texts
        hits = match.substring_hits(parts, texts, "external_id", [c for c in texts.columns if c != "external_id"])
        by_part = bitmaps.bitmaps_of(hits.join(self.library.words.numbers, "id").select("query_id.query_id", "query_id.chip", "n"), "query_id", "chip")
        return stored(by_word.unionByName(by_part.select("query_id", "chip", "bucket", F.col("bits").alias("own"), "bits")), "chip-bits")

    @cached_property
    def _bits(self) -> DataFrame:
        return stored(bitmaps.query_bits(self._chip_bits, self._open.select("query_id", "n_chips", "mode")), "bits")

    @cached_property
    def _counts(self) -> DataFrame:
        """query_id, n, n_direct."""
        return stored(match_counts(self._bits), "counts")

    @property
    def matches(self) -> DataFrame:
        """query_id, id, direct: a row for each match."""
        return bitmaps.members(self._bits).join(self.library.words.numbers, "n").select("query_id", "id", "direct")

    # how it is answered

    @cached_property
    def _ways(self) -> DataFrame:
        """Answered requests with ``n``, ``n_direct``, ``mode_of``: ``relevance``, or a list: ``direct`` (own words alone are too many: those),
        ``full``, ``sorted`` (asked for), ``browse`` (no chips). ``known``: the count, capped; ``letter`` of its cursors."""
        c, most = self._open.join(self._counts, "query_id", "left").fillna(0, ["n", "n_direct"]), self.too_broad
        expanded = self.related.select("query_id").distinct().withColumn("_expanded", F.lit(True))
        c = c.join(expanded, "query_id", "left")
        ranked = F.col("sort") == "relevance"
        first = F.when((F.col("n") > F.col("n_direct")) & (F.col("n_direct") > most), "direct").when(F.col("n") > most, "full").otherwise("relevance")
        listed = F.col("value").isNotNull()
        how = F.when(F.col("n_chips") == 0, "browse").when(~ranked, "sorted").when(F.col("offset").isNotNull(), "relevance").when(listed & F.col("own"), "direct").when(listed, "full").otherwise(first)
        total = F.least(F.coalesce("told", "n"), F.lit(most + 1))
        own = F.when(listed, F.col("own")).otherwise(ranked & F.col("_expanded").isNotNull() & (F.col("n_direct") > most))
        sort = F.when(ranked & (how != "relevance"), "recently_saved").otherwise(F.col("sort"))
        return stored(c.withColumns({"mode_of": how, "known": total, "letter": F.when(own, "d").otherwise("k"), "by": sort}).drop("_expanded"), "ways")

    @cached_property
    def totals(self) -> DataFrame:
        """query_id, total, mode, ordered_by, too_broad of requests with a match; browsing counts all items."""
        every = self.library.items.limit(self.too_broad + 1).count()
        counted = F.when((F.col("mode_of") == "browse") & F.col("told").isNull(), F.lit(every)).otherwise(F.col("known"))
        rows = self._ways.withColumn("total", counted.cast("long")).filter("total > 0")
        return rows.select("query_id", "total", F.col("mode_of").alias("mode"), F.col("by").alias("ordered_by"), ((F.col("mode_of") != "relevance") & (F.col("total") > self.too_broad)).alias("too_broad"))

    @cached_property
    def _ranked(self) -> DataFrame:
        """query_id, id, rank, score, key of requests that are ranked, down to what their page or candidates need."""
        rows = self._ways.filter("mode_of = 'relevance'")
        if rows.isEmpty():  # no blocks are made for lists alone
            return rows.selectExpr("query_id", "0L AS id", "0 AS rank", "0D AS score", "CAST(NULL AS LONG) AS key")
        depth = F.least(F.lit(rank.RANK_DEPTH), F.greatest(F.lit(rank.CANDIDATES), F.coalesce("offset", F.lit(0)) + F.col("limit")))
        needs = stored(impacts.tier_needs(rows, depth), "needs")
        members = bitmaps.members(self._bits.join(needs.select("query_id").distinct(), "query_id", "left_semi"))
        members = members.select("query_id", "n", F.when(F.col("direct"), 1).otherwise(2).alias("tier"))
        members = members.join(needs.select("query_id", "tier"), ["query_id", "tier"], "left_semi")
        spread = bitmaps.counts(self._units, "kind", "unit")
        scored = impacts.best(self.parts, members, needs, spread, self._phrases, self.library.impacts)
        return stored(impacts.ranked(scored, needs).select("query_id", "id", "rank", "score", F.lit(None).cast("long").alias("key")), "ranked")

    @cached_property
    def _listed(self) -> DataFrame:
        """query_id, id, rank (within the page), score, key of requests that are listed: their page and one row more, or their candidates.

        Only the kinds of lists that are asked for are worked out, each by itself: one plan of all of them is what the driver holds most of."""
        most = F.when(F.col("value").isNull(), F.greatest(F.col("limit"), F.lit(rank.CANDIDATES))).otherwise(F.col("limit")) + 1
        rows = self._ways.filter("mode_of <> 'relevance'").withColumn("most", most)
        browse = F.col("mode_of") == "browse"
        out = self.requests.sparkSession.createDataFrame([], rows.select("query_id").schema).selectExpr("query_id", "0L AS id", "0 AS rank", "0L AS key")
        for kind in sorted(rows.select("by", browse.alias("free")).distinct().collect()):  # six at most
            mine = rows.filter((F.col("by") == kind["by"]) & (browse == kind["free"]))
            # without chips: pages of the sorted layout
            pages = self.library.layout(kind["by"]).pages(mine.select("query_id", "value", "item", "most")) if kind["free"] else self._timed(mine) if kind["by"] == "recently_saved" else self._sorted(mine, kind["by"])
            out = out.unionByName(stored(pages.select("query_id", "id", F.col("rank").cast("int"), "key"), "listed"))
        return out.select("query_id", "id", "rank", F.lit(None).cast("double").alias("score"), "key")

    def _timed(self, rows: DataFrame) -> DataFrame:
        """Matches by saved time: the first bits after the cursor's number."""
        saved = self.library.words.saved
        after = saved.after(rows.filter("value IS NOT NULL").select("query_id", "value", "item"))
        begin = stored(rows.join(after, "query_id", "left").select("query_id", "most", "after", "mode_of"), "cursors")
        chosen = self._bits.join(begin, "query_id")
        chosen = chosen.withColumn("bits", F.when(F.col("mode_of") == "direct", F.col("direct")).otherwise(F.col("bits")))
        return bitmaps.first_members(chosen, F.col("most"), F.col("after")).join(saved.rows.select("n", "id", "key").hint("merge"), "n")

    def _sorted(self, rows: DataFrame, sort: str) -> DataFrame:
        """Matches by another column. A page's bound is told as a number too, so that tasks keep no more of a query before they shuffle."""
        found = bitmaps.members(self._bits.join(rows.select("query_id"), "query_id", "left_semi")).select("query_id", "n")
        keyed = found.join(self.library.keyed(sort), "n").join(rows.select("query_id", "value", "item", "most"), "query_id")
        later = F.col("value").isNull() | (F.col("key") < F.col("value")) | ((F.col("key") == F.col("value")) & (F.col("id") < F.col("item")))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), F.desc("id")))
        return keyed.filter(later).withColumn("rank", nth).filter((F.col("rank") <= MOST_LISTED) & (F.col("rank") <= F.col("most")))

    @cached_property
    def leading(self) -> DataFrame:
        """query_id, id, rank: the first results of first pages, over which facets are counted."""
        firsts = self._ways.filter("coalesce(offset, 0) = 0 AND value IS NULL").select("query_id")
        both = self._ranked.select("query_id", "id", "rank").unionByName(self._listed.select("query_id", "id", "rank"))
        return stored(both.join(firsts, "query_id", "left_semi").filter(F.col("rank") <= rank.CANDIDATES), "leading")

    @cached_property
    def page(self) -> DataFrame:
        """query_id, id, rank (over all pages for ranked requests, within the page for lists), score, key, mode, next_cursor."""
        ways = self._ways.select("query_id", "limit", "offset", "known", "letter", "by", "mode_of", "told")
        upto = F.coalesce("offset", F.lit(0)) + F.col("limit")
        ranked = self._ranked.join(ways, "query_id").filter((F.col("rank") > F.coalesce("offset", F.lit(0))) & (F.col("rank") <= upto))
        ranked = ranked.withColumn("next_cursor", F.when(upto < F.least("known", F.lit(rank.RANK_DEPTH)), F.concat_ws(":", F.lit("r"), upto, "known")))
        listed = self._listed.join(ways, "query_id").join(self.totals.select("query_id", "total"), "query_id")
        letters = F.create_map(*[F.lit(x) for kv in query.SORT_LETTERS.items() for x in kv])
        last = listed.groupBy("query_id").agg(F.max(F.when(F.col("rank") == F.col("limit"), F.struct("letter", letters[F.col("by")].alias("s"), "key", "id", "total"))).alias("l"), F.count_if(F.col("rank") > F.col("limit")).alias("_more"))
        cursors = last.filter("_more > 0").select("query_id", F.concat_ws(":", "l.letter", "l.s", "l.key", "l.id", "l.total").alias("next_cursor"))
        listed = listed.filter(F.col("rank") <= F.col("limit")).join(cursors, "query_id", "left")
        columns = ["query_id", "id", "rank", "score", "key", F.col("mode_of").alias("mode"), "next_cursor"]
        return stored(ranked.select(columns).unionByName(listed.select(columns)), "page")

    @property
    def results(self) -> DataFrame:
        """The page with its items' columns, tags and collections in order."""
        return rank.hydrated(self.page, self.library.items, self.library.names)

    @property
    def snippets(self) -> DataFrame:
        """query_id, id, segments of the page's captions, and link if the library makes links."""
        marks = enrich.highlight_terms(self._asked.filter("key <> ''"), self.related, lambda t: tokens(nfkc(t)))
        shown = enrich.highlight(self.page, marks, self.library.items, "external_id", "caption")
        if self.library.link is None:
            return shown
        links = self.library.items.select(F.col("external_id").alias("id"), self.library.link().alias("link"))
        return shown.join(links, "id", "left").select("query_id", "id", "segments", "link")

    # what goes with it

    @cached_property
    def _values(self) -> tuple[DataFrame, DataFrame]:
        items = self.library.items
        return items.select(F.col("external_id").alias("id"), F.explode(F.array_distinct("hashtags")).alias("text")), items.select(F.col("external_id").alias("id"), F.col("author_handle").alias("text"))

    @cached_property
    def facets(self) -> DataFrame:
        tags, authors = self._values
        return stored(rank.all_facets(self.leading, tags, self.library.names, authors), "facets")

    @property
    def suggestions(self) -> DataFrame:
        return rank.suggestions(self.facets, self._asked, self.leading)

    @property
    def chip_info(self) -> DataFrame:
        """query_id, chip, n, capped, expanded, meant of every chip of an answered request."""
        counted = bitmaps.counts(self._chip_bits, "query_id", "chip").select("query_id", "chip", F.least("n", F.lit(rank.TOTAL_CAP)).alias("n"))
        chips = self._asked.select("query_id", "chip", F.col("key").alias("term")).join(counted, ["query_id", "chip"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        unknown = chips.filter("n = 0").filter(~F.col("term").contains(" ")).select(F.col("term").alias("word")).distinct()
        tags, authors = self._values
        words = rank.vocabulary(tags, authors, self.library.names, self.library.categories, self.library.aliases)
        expanded = self.related.groupBy("query_id", "chip").agg(F.count(F.lit(1)).alias("expanded"))
        info = chips.join(expanded, ["query_id", "chip"], "left").join(query.did_you_mean(unknown, words).withColumnRenamed("word", "term"), "term", "left")
        return info.select("query_id", "chip", "n", (F.col("n") >= rank.TOTAL_CAP).alias("capped"), F.coalesce("expanded", F.lit(0)).alias("expanded"), F.when(F.col("n") == 0, F.col("meant")).alias("meant"))

    @property
    def explanations(self) -> DataFrame:
        """query_id, id, chip, via, fields, term of the page."""
        return terms.explain(self.term_rows, self.page, self.related, self._asked.filter("NOT substring"), self.library.idx)


def search(sent: DataFrame, library: Library, mode: str | None = None, requests: DataFrame | None = None, too_broad: int = rank.TOTAL_CAP - 1) -> Search:
    """Chips sent (query_id, ord, text, expand) over a library. ``requests`` (query_id and any of mode, sort, limit, cursor) says how each
    query is asked, also those without chips; left out, every query with chips takes the defaults, or ``mode``."""
    if requests is None and mode:
        requests = sent.select("query_id").distinct().withColumn("mode", F.lit(mode))
    return Search(sent, library, requests, too_broad)


def chip_bits_of(term_rows: DataFrame, words: Words) -> tuple[DataFrame, ...]:
    """Parts, bitmaps of their units and of chips, and places of phrases, for term rows that are made elsewhere."""
    parts = stored(bitmaps.parts_of(term_rows), "parts")
    asked = parts.select("kind", "unit").distinct()
    phrases = stored(bitmaps.phrase_places(asked, words.idx), "phrase-places")
    units = stored(bitmaps.unit_bits(asked, words, phrases), "units")
    return parts, units, bitmaps.chip_bits(parts, units), phrases


def bits_of(term_rows: DataFrame, sizes: DataFrame, library: Impacts) -> tuple[DataFrame, ...]:
    """As ``chip_bits_of``, with bitmaps of queries before the places of phrases. ``sizes``: query_id, n_chips, mode."""
    parts, units, chips, phrases = chip_bits_of(term_rows, library.words)
    chips = stored(chips, "chip-bits")
    return parts, units, chips, stored(bitmaps.query_bits(chips, sizes), "bits"), phrases


def rank_terms(term_rows: DataFrame, sizes: DataFrame, library: Impacts, depth: int) -> DataFrame:
    """query_id, id, tier, score, rank: the ``depth`` best matches of each query, own words first."""
    return rank_bits(bits_of(term_rows, sizes, library), library, depth)


def rank_bits(made: tuple[DataFrame, ...], library: Impacts, depth: int, queries: DataFrame | None = None) -> DataFrame:
    """As ``rank_terms``, for what ``bits_of`` has made, of all its queries or of ``queries`` (query_id) alone."""
    parts, units, _, bits, phrases = made
    if queries is not None:
        bits = bits.join(queries, "query_id", "left_semi")
    needs = stored(impacts.tier_needs(match_counts(bits), F.lit(depth)), "needs")
    members = bitmaps.members(bits).select("query_id", "n", F.when(F.col("direct"), 1).otherwise(2).alias("tier")).join(needs.select("query_id", "tier"), ["query_id", "tier"], "left_semi")
    return impacts.ranked(impacts.best(parts, members, needs, bitmaps.counts(units, "kind", "unit"), phrases, library), needs)


def match_counts(bits: DataFrame) -> DataFrame:
    """query_id, n, n_direct: all matches of each query, and those by its own words."""
    return bits.groupBy("query_id").agg(F.sum(F.bitmap_count("bits")).alias("n"), F.sum(F.bitmap_count("direct")).alias("n_direct"))
