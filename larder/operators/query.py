"""Preparation of a table of queries: chips, related terms, budgets, cursors, spelling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from larder.functions.text import nfkc, stripped, tokens

MOST_CHARS = 64
MOST_TERMS = 30
#: Distinct chips of a query, and chips that may be sent.
MOST_CHIPS, MOST_SENT = 20, 40
#: Results of a page at most.
MOST_LIMIT = 100
#: Scripts without spaces between words, and the pictograph blocks.
SUBSTRING_SCRIPTS = (
    r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\x{A9}\x{AE}\x{2122}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F000}-\x{1FAFF}]"
)


def needs_substring(text: Column) -> Column:
    """Whether a chip (in normal form) is matched by substring instead of words."""
    return F.coalesce(text.rlike(SUBSTRING_SCRIPTS), F.lit(False))


def cleaned_chip(text: Column) -> Column:
    """In normal form, white space collapsed, leading # and @ away, lower case."""
    return F.lower(stripped(F.regexp_replace(stripped(F.regexp_replace(nfkc(text), r"\s+", " ")), "^[#@]+", "")))


def chip_reason(chip: Column) -> Column:
    """Why a cleaned chip is refused, or null: empty, too_long, no_text (neither words nor anything to find by substring)."""
    return F.when(chip == "", "empty").when(F.length(chip) > MOST_CHARS, "too_long").when((F.size(tokens(chip)) == 0) & ~needs_substring(chip), "no_text")


def chip_key(chip: Column) -> Column:
    """What makes two cleaned chips the same: their words, or the chip itself if it has none."""
    return F.coalesce(F.nullif(F.array_join(tokens(chip), " "), F.lit("")), chip)


def deduped_chips(sent: DataFrame) -> DataFrame:
    """query_id, chip, text, key, expand, reason of the chips sent (query_id, ord, text, expand; null expands).

    Of chips with the same key and setting the first stays. A refused chip keeps its reason; ``too_many`` stands at all chips of a
    query with more than ``MOST_SENT`` chips sent or ``MOST_CHIPS`` distinct ones. One query is one window partition: what is
    sent beyond the bound is counted, not ranked."""
    clean = sent.select("query_id", "ord", cleaned_chip(F.col("text")).alias("text"), F.coalesce("expand", F.lit(True)).alias("expand"))
    keyed = clean.withColumn("key", chip_key(F.col("text"))).withColumn("reason", chip_reason(F.col("text")))
    kept = keyed.groupBy("query_id", "key", "expand").agg(F.min(F.struct("ord", "text", "reason")).alias("first"), F.count(F.lit(1)).alias("_n"))
    sizes = kept.groupBy("query_id").agg(F.sum("_n").alias("_sent"), F.count(F.lit(1)).alias("_distinct"))
    rows = kept.join(sizes, "query_id")
    many = (F.col("_sent") > MOST_SENT) | (F.col("_distinct") > MOST_CHIPS)
    chip = F.row_number().over(Window.partitionBy("query_id").orderBy("first.ord")) - 1
    return rows.select("query_id", chip.alias("chip"), "first.text", "key", "expand", F.when(many, "too_many").otherwise(F.col("first.reason")).alias("reason"))


def split_pasted(rows: DataFrame, id_column: str, text: str) -> DataFrame:
    """One row for each part between commas, semicolons and line breaks."""
    parts = F.filter(F.transform(F.split(text, r"[,\n\r;]+"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(id_column, F.posexplode(parts).alias("ord", "part"))


#: Endings of crude base forms: (ending, what takes its place, letters that the word must have at least).
ENDINGS = (("ies", "y", 5), ("es", "", 4), ("s", "", 4), ("ing", "", 6))


def variants(key: Column) -> Column:
    """A word and its crude base forms, in order of trust; short words have none."""
    forms = [F.when(key.endswith(end) & (F.length(key) >= least), F.concat(F.left(key, F.length(key) - len(end)), F.lit(to))) for end, to, least in ENDINGS]
    return F.array_compact(F.array(key, *forms))


def expand_terms(chips: DataFrame, categories: DataFrame, aliases: DataFrame) -> DataFrame:
    """query_id, chip, ord, term: up to 30 terms of the category that the chip's word, or a base form, names.

    ``categories`` (category, ord, term) and ``aliases`` (alias, category): the first form that is known counts, a
    category before an alias. The chip's own words, repeats and terms that only a substring could find are left out."""
    forms = chips.select("query_id", "chip", "term", F.posexplode(variants(F.col("term"))).alias("form_ord", "form"))
    names = categories.select(F.col("category").alias("form"), "category", F.lit(0).alias("is_alias")).distinct()
    led = aliases.join(categories.select("category").distinct(), "category", "left_semi")  # an alias of nothing known counts for nothing
    names = names.unionByName(led.select(F.col("alias").alias("form"), "category", F.lit(1).alias("is_alias")))
    known = forms.join(names, "form").groupBy("query_id", "chip", "term").agg(F.min_by("category", F.struct("form_ord", "is_alias", "category")).alias("category"))
    plain = categories.select("category", "ord", stripped(F.lower(nfkc(F.col("term")))).alias("term")).groupBy("category", "term").agg(F.min("ord").alias("ord"))
    related = known.withColumnRenamed("term", "own").join(plain, "category").filter((F.col("term") != "") & (F.col("term") != F.col("own")) & ~F.array_contains(tokens(F.col("own")), F.col("term")) & ~needs_substring(F.col("term")))
    order = Window.partitionBy("query_id", "chip").orderBy("ord")
    return related.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= MOST_TERMS).select("query_id", "chip", F.col("nth").alias("ord"), "term")


def budgeted(related: DataFrame, chips: DataFrame) -> DataFrame:
    """Related terms cut to their query's budget, which all of its expanding chips share, those without related terms too. ``chips``:
    query_id, expand, words (how many)."""
    expanding = chips.groupBy("query_id").agg(F.count_if(F.col("expand") & (F.col("words") > 0)).alias("_chips"))
    return related.join(expanding, "query_id").filter(F.col("ord") <= term_budget(F.col("_chips"))).drop("_chips")


def term_budget(expanding: Column) -> Column:
    """Related terms of each chip, by the number of expanding chips of its query."""
    shared = F.greatest(F.lit(8), F.least(F.lit(MOST_TERMS), F.floor(60 / expanding)))
    return F.when(expanding <= 1, MOST_TERMS).otherwise(shared).cast("int")


def offset_cursor(cursor: Column, depth: int = 1000) -> tuple[Column, Column]:
    """Offset and total of an ``r:offset:total`` cursor, clamped; null if it isn't one."""
    part = lambda i, most: F.when(cursor.rlike(_OFFSET), F.least(F.regexp_extract(cursor, r"^r:(\d+):(\d+)$", i).cast("long"), F.lit(most)))
    return part(1, depth), part(2, 10_001)


def osa(a: str, b: str) -> int:
    """Optimal string alignment distance: neighbours that change places count once."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y) for x, y in zip(a, b)], dtype="int32")


def _shortened(word: Column) -> Column:
    """A word and all words that are left when one or two of its letters are taken away."""
    n = F.length(word)
    without = lambda w, i: F.concat(F.left(w, i), F.substring(w, i + 2, n))
    one = F.transform(F.sequence(F.lit(0), n - 1), lambda i: without(word, i))
    two = F.flatten(F.transform(one, lambda w: F.transform(F.sequence(F.lit(0), n - 2), lambda i: without(w, i))))
    return F.array_distinct(F.concat(F.array(word), one, two))


def did_you_mean(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, meant: the closest word of ``vocabulary`` (word) within distance 1 (up to 4 letters) or 2; words of 3 letters or more.

    Words within that distance are equal after two letters or fewer are taken from each, so candidates are joined on
    shortened forms. Ties: the same first letter, then the word itself."""
    asked = words.filter(F.length("word") >= 3).select("word", F.explode(_shortened(F.col("word"))).alias("form"))
    known = vocabulary.filter(F.length("word") >= 3).select(F.col("word").alias("meant"), F.explode(_shortened(F.col("word"))).alias("form"))
    near = asked.join(known, "form").filter(F.col("word") != F.col("meant")).select("word", "meant").distinct()
    near = near.withColumn("d", osa_distance("word", "meant")).filter(F.col("d") <= F.when(F.length("word") <= 4, 1).otherwise(2))
    best = F.min_by("meant", F.struct("d", (F.left("word", F.lit(1)) != F.left("meant", F.lit(1))).alias("other"), "meant"))
    return near.groupBy("word").agg(best.alias("meant"))


def match_account(id_new: Column, handle_new: Column, id_old: Column, handle_old: Column) -> Column:
    """How an incoming account stands to the bound one: the stable id wins, else the handle without case."""
    same_handle = F.lower(handle_new) == F.lower(handle_old)
    return (
        F.when(id_new.isNotNull() & id_old.isNotNull(), F.when(id_new != id_old, "different").when(same_handle, "same").otherwise("renamed"))
        .when(same_handle, F.when(id_old.isNull() & id_new.isNotNull(), "upgraded").otherwise("same"))
        .otherwise("different")
    )


SORTS, MODES = ("relevance", "recently_saved", "newest", "most_viewed"), ("all", "any")
SORT_LETTERS = {"recently_saved": "s", "newest": "n", "most_viewed": "v"}
#: The form of cursors that clients hold.
_OFFSET, _KEYSET = r"^r:\d{1,6}:\d{1,6}$", r"^([kd]):([snv]):(-?\d{1,16}):(\d{1,16}):(\d{1,6})$"


def checked_requests(requests: DataFrame) -> DataFrame:
    """Requests (mode, sort, limit, cursor, n_chips; null takes the default) with defaults filled in and ``reason`` if refused."""
    mode, limit = F.coalesce("mode", F.lit("all")), F.coalesce("limit", F.lit(30))
    asked = F.coalesce("sort", F.when(F.col("n_chips") > 0, "relevance").otherwise("recently_saved"))
    sort = F.when((F.col("n_chips") == 0) & (asked == "relevance"), "recently_saved").otherwise(asked)
    letter = F.create_map(*[F.lit(x) for kv in SORT_LETTERS.items() for x in kv])[sort]
    cursor, keyset = F.col("cursor"), F.col("cursor").rlike(_KEYSET)
    offset = cursor.rlike(_OFFSET)
    wrong = F.when(sort == "relevance", keyset & (F.regexp_extract("cursor", _KEYSET, 2) != "s")).otherwise(offset | (F.regexp_extract("cursor", _KEYSET, 1) == "d") | (F.regexp_extract("cursor", _KEYSET, 2) != letter))
    reason = (
        F.when(~mode.isin(*MODES), "mode").when(~asked.isin(*SORTS), "sort").when((limit < 1) | (limit > MOST_LIMIT), "limit")
        .when(cursor.isNotNull() & ~keyset & ~offset, "malformed_cursor").when(F.col("n_chips") > 20, "too_many_chips").when(cursor.isNotNull() & wrong, "other_cursor")
    )
    return requests.withColumns({"mode": mode, "sort": sort, "limit": limit, "reason": reason})


def keyset_cursor(cursor: Column, most: int = 10_001) -> Column:
    """direct, sort, value, id, total of a ``k`` or ``d`` cursor, the total clamped; null if it isn't one."""
    part = lambda i: F.regexp_extract(cursor, _KEYSET, i)
    fields = F.struct((part(1) == "d").alias("direct"), part(2).alias("sort"), part(3).try_cast("long").alias("value"), part(4).try_cast("long").alias("id"), F.least(part(5).try_cast("long"), F.lit(most)).alias("total"))
    return F.when(cursor.rlike(_KEYSET), fields)
