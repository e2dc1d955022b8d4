"""Chips with related terms on a handful of documents."""

from pyspark.sql import functions as F

from larder.functions.stem import stem
from larder.functions.text import folded_words, stemmed_words
from larder.operators import index, query, rank, terms
from larder.plans.search import Library, search

DOCS = [(1, "meal prep ideas", "#food"), (2, "mealprepping sunday", "x"), (3, "prep a meal", "x"), (4, "cooking dinner at home", "x"), (5, "dinner cooking", "x"), (6, "nothing", "x"), (7, None, None)]


def _search(spark, chips, related, mode="all", words=folded_words):
    docs = spark.createDataFrame(DOCS, "external_id long, caption string, tags string")
    idx = index.in_memory(docs, {"caption": "caption", "hashtags": "tags"}, words=words)
    asked = terms.own_terms(spark.createDataFrame(chips, "query_id int, chip int, text string"), words).unionByName(terms.related_terms(spark.createDataFrame(related, "query_id int, chip int, ord int, term string"), words))
    found = terms.places(asked, idx)
    sizes = spark.createDataFrame([(1, len(chips))], "query_id int, n_chips int")
    matches = terms.query_matches(terms.chip_matches(found), sizes, mode)
    return matches, terms.rank_tiers(terms.scores(found, matches, idx.documents))


def test_words_concatenation_and_phrases(spark):
    matches, ranked = _search(spark, [(1, 0, "Meal Prep")], [(1, 0, 0, "cooking dinner"), (1, 0, 1, "food")])
    assert sorted((r["id"], r["direct"]) for r in matches.collect()) == [(1, True), (2, True), (3, True), (4, False)]
    tiers = [(r["tier"], r["id"]) for r in ranked.orderBy("rank").collect()]
    assert [t for t, _ in tiers] == [1, 1, 1, 2] and tiers[-1][1] == 4


def test_modes_and_short_prefixes(spark):
    matches, _ = _search(spark, [(1, 0, "a"), (1, 1, "home")], [(1, 0, 0, "at")], "any")
    assert sorted((r["id"], r["direct"]) for r in matches.collect()) == [(3, True), (4, True)]
    assert [(r["total"], r["mode"]) for r in terms.list_modes(matches, most=1).collect()] == [(2, "full")]


def test_refused_requests(spark):
    kind = "mode string, sort string, limit int, cursor string, n_chips int"
    rows = [(None, None, None, None, 1), (None, "relevance", None, None, 0), ("x", None, None, None, 1), (None, None, 101, None, 1), (None, "newest", None, "k:s:1:2:3", 1), (None, None, None, "d:s:1:2:3", 1), (None, None, None, "r:1", 1)]
    got = query.checked_requests(spark.createDataFrame(rows, kind)).collect()
    assert [r["reason"] for r in got] == [None, None, "mode", "limit", "other_cursor", None, "malformed_cursor"]
    assert [(r["mode"], r["sort"], r["limit"]) for r in got[:2]] == [("all", "relevance", 30), ("all", "recently_saved", 30)]


def test_stems_and_folded_letters(spark):
    """The index finds other forms of a word, and words with or without diacritics; full-width letters are plain ones."""
    pairs = {"recipes": "recip", "recipe": "recip", "cooking": "cook", "hopping": "hop", "relational": "relat", "happy": "happi", "agreed": "agre", "caresses": "caress", "ponies": "poni", "feed": "feed", "controlling": "control", "adoption": "adopt", "probate": "probat", "sky": "sky", "is": "is"}
    assert {w: stem(w) for w in pairs} == pairs
    df = spark.createDataFrame([("Café CAFE\u0301 cafés Ｆｕｌｌ ﬁne",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(folded_words("t")).collect()] == [["cafe", "cafe", "cafes", "full", "fine"], [], []]
    assert df.select(stemmed_words("t")).first()[0] == ["cafe", "cafe", "cafe", "full", "fine"]
    matches, _ = _search(spark, [(1, 0, "Meals cooked")], [], words=stemmed_words)
    assert [r["id"] for r in matches.collect()] == []
    matches, _ = _search(spark, [(1, 0, "meals")], [], words=stemmed_words)
    assert sorted(r["id"] for r in matches.collect()) == [1, 2, 3]


def test_explanations_name_the_way_and_the_term(spark):
    docs = spark.createDataFrame(DOCS, "external_id long, caption string, tags string")
    idx = index.in_memory(docs, {"caption": "caption", "hashtags": "tags"}, words=folded_words)
    chips = spark.createDataFrame([(1, 0, "meal"), (1, 1, "home")], "query_id int, chip int, text string")
    related = spark.createDataFrame([(1, 0, 0, "sunday"), (1, 0, 1, "cooking dinner"), (1, 1, 0, "food")], "query_id int, chip int, ord int, term string")
    asked = terms.own_terms(chips, folded_words).unionByName(terms.related_terms(related, folded_words))
    told = terms.explain(asked, spark.createDataFrame([(1, 1), (1, 4), (1, 5)], "query_id int, id long"), related, chips, idx)
    assert sorted((r["id"], r["chip"], r["via"], r["fields"], r["term"]) for r in told.collect()) == [
        (1, 0, "direct", "caption", None), (1, 1, "related", "hashtags", "food"), (4, 0, "related", "caption", "cooking dinner"), (4, 1, "direct", "caption", None), (5, 0, "none", "", None), (5, 1, "none", "", None),
    ]


def _library(spark):
    rows = [(1, "red ring", ["fyp", "gold", "ring"], "ann", 10), (2, "ring of gold", ["gold"], "bob", 20), (3, "東京 ring", ["gold"], "ann", 30), (4, "necklace", ["silver"], "cy", 40)]
    items = spark.createDataFrame(rows, "external_id long, caption string, hashtags array<string>, author_handle string, saved_at long")
    texts = items.withColumn("tags", F.array_join("hashtags", " "))
    names = spark.createDataFrame([(1, 7, "jewels"), (2, 7, "jewels"), (3, 8, "jewels")], "id long, key long, text string")
    categories = spark.createDataFrame([("ring", 1, "Necklace"), ("ring", 2, "ring")], "category string, ord int, term string")
    aliases = spark.createDataFrame([("band", "ring")], "alias string, category string")
    idx = index.in_memory(texts, {"caption": "caption", "hashtags": "tags"}, words=folded_words)
    return Library(idx, items, names, texts.select("external_id", "caption", "tags"), categories, aliases)


def test_whole_search(spark):
    """Words, related terms, a substring chip, a mistyped one, a refused query, lists of too many, facets and suggestions."""
    sent = [(1, 0, " #Rings "), (1, 1, "rings"), (2, 0, "東京"), (2, 1, "ring"), (3, 0, "slver"), (4, 0, "!!"), (4, 1, "ring")]
    chips = spark.createDataFrame([(*r, True) for r in sent], "query_id int, ord int, text string, expand boolean")
    found = search(chips, _library(spark))
    assert sorted((r["query_id"], r["chip"], r["text"], r["reason"]) for r in found.chips.collect()) == [(1, 0, "rings", None), (2, 0, "東京", None), (2, 1, "ring", None), (3, 0, "slver", None), (4, 0, "!!", "no_text"), (4, 1, "ring", None)]
    results = {(r["query_id"], r["id"]): (r["rank"], r["mode"], r["collections"]) for r in found.results.collect()}
    assert results == {(1, 4): (1, "relevance", []), (1, 1): (2, "relevance", ["jewels"]), (1, 2): (3, "relevance", ["jewels"]), (1, 3): (4, "relevance", ["jewels"]), (2, 3): (1, "sorted", ["jewels"])}  # a substring has no score
    assert {(r["query_id"], r["chip"]): (r["n"], r["meant"]) for r in found.chip_info.collect()}[(3, 0)] == (0, "silver")
    ring = search(chips.filter("query_id = 2 AND ord = 1"), _library(spark))
    assert [r["id"] for r in ring.results.orderBy("rank").collect()][-1] == 4 and ring.results.count() == 4
    facets = sorted((r["source"], r["text"], r["n"]) for r in ring.facets.collect())
    assert facets == [("author", "ann", 2), ("author", "bob", 1), ("author", "cy", 1), ("collection", "jewels", 1), ("collection", "jewels", 2), ("hashtag", "fyp", 1), ("hashtag", "gold", 3), ("hashtag", "ring", 1), ("hashtag", "silver", 1)]
    assert sorted((r["source"], r["text"]) for r in ring.suggestions.collect() if r["source"] == "hashtag") == [("hashtag", "gold"), ("hashtag", "silver")]
    listed = search(chips.filter("query_id = 2 AND ord = 1"), _library(spark), too_broad=2)
    assert [(r["id"], r["mode"]) for r in listed.results.orderBy("rank").collect()] == [(3, "direct"), (2, "direct"), (1, "direct")]


def test_totals_stop_at_the_cap(spark):
    matches = spark.range(30).selectExpr("1 AS query_id", "id", "id < 5 AS direct")
    assert [tuple(r) for r in terms.list_modes(matches, most=10).collect()] == [(1, 11, "full")]
    assert [tuple(r) for r in rank.totals(matches, 20).collect()] == [(1, 20, True)]


def test_chips_are_deduped_and_counted(spark):
    sent = [(1, i, f"w{i % 19}", True) for i in range(40)] + [(2, i, f"w{i}", True) for i in range(21)] + [(3, i, "same", True) for i in range(41)] + [(4, 0, "Meal  Prep", None), (4, 1, "#meal prep", True), (4, 2, "meal prep", False), (4, 3, "x" * 65, True), (4, 4, "\U0001f600", True)]
    got = query.deduped_chips(spark.createDataFrame(sent, "query_id int, ord int, text string, expand boolean")).collect()
    assert {q: {r["reason"] for r in got if r["query_id"] == q} for q in (1, 2, 3)} == {1: {None}, 2: {"too_many"}, 3: {"too_many"}}
    assert sorted((r["chip"], r["key"][:9], r["expand"], r["reason"]) for r in got if r["query_id"] == 4) == [(0, "meal prep", True, None), (1, "meal prep", False, None), (2, "x" * 9, True, "too_long"), (3, "\U0001f600", True, None)]


def test_spelling_joins_on_shortened_words(spark):
    words = spark.createDataFrame([("fodo",), ("recipie",), ("abc",), ("zzzz",), ("recipes",)], "word string")
    known = spark.createDataFrame([("food",), ("recipe",), ("recipes",), ("abd",), ("acb",)], "word string")
    assert sorted(map(tuple, query.did_you_mean(words, known).collect())) == [("abc", "abd"), ("fodo", "food"), ("recipes", "recipe"), ("recipie", "recipe")]


def test_base_forms_need_letters(spark):
    df = spark.createDataFrame([("as",), ("es",), ("ies",), ("sing",), ("hobbies",), ("stocks",)], "w string")
    assert [r[0] for r in df.select(query.variants(F.col("w"))).collect()] == [["as"], ["es"], ["ies"], ["sing"], ["hobbies", "hobby", "hobbi", "hobbie"], ["stocks", "stock"]]
