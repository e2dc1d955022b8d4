"""Small cases of operators that the tables don't hold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from larder.functions.text import nfkc, normalized_tags, tolerant_long
from larder.operators import changes, enrich, ingest, match, query, rank
from larder.streaming import chains


def test_tags_lose_hash_case_and_repeats(spark):
    df = spark.createDataFrame([(["#Food", "food", " ##Cake ", "", "#"],)], "tags array<string>")
    assert df.select(normalized_tags(F.col("tags"))).first()[0] == ["food", "cake"]


def test_nfkc_and_tolerant_numbers(spark):
    df = spark.createDataFrame([("ﬁne", " 12 "), (None, "x")], "a string, b string")
    assert [tuple(r) for r in df.select(nfkc("a"), tolerant_long(F.col("b"))).collect()] == [("fine", 12), (None, None)]


def test_upsert_keeps_missing_and_takes_empty(spark):
    stored = spark.createDataFrame([(1, "old", 5), (2, "same", 6), (4, "gone", 1)], "external_id long, caption string, views long")
    incoming = spark.createDataFrame([(1, "", 7), (2, None, None), (3, "new", 1)], "external_id long, caption string, views long")
    once = changes.upsert_items(stored, incoming, ["caption"], ["views"])
    assert sorted(map(tuple, once.collect())) == [(1, "", 7, "reindexed"), (2, "same", 6, "touched"), (3, "new", 1, "inserted"), (4, "gone", 1, "kept")]
    twice = changes.upsert_items(once.drop("action"), incoming, ["caption"], ["views"])
    assert sorted(r["action"] for r in twice.collect()) == ["kept", "touched", "touched", "touched"]


def test_substring_matches_scripts_without_spaces(spark):
    docs = spark.createDataFrame([(1, "東京タワー"), (2, "大阪"), (3, None)], "external_id long, caption string")
    words = spark.createDataFrame([(9, "京タ"), (8, "%")], "query_id long, word string")
    assert [tuple(r) for r in match.substring_hits(words, docs, "external_id", ["caption"]).collect()] == [(9, 1)]


def test_guard_refuses_empty_and_small_passes(spark):
    stored = spark.createDataFrame([("a", i) for i in range(30)] + [("b", i) for i in range(5)], "scope string, id long")
    seen = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 1)], "scope string, id long")
    got = {r["scope"]: r["allowed"] for r in changes.guard_reconcile(stored, seen, "scope").collect()}
    assert got == {"a": False, "b": True}


@pytest.mark.parametrize(("requests", "gap"), [([None, 1, 2], False), ([None, 1, 9], True)])
def test_chain_needs_each_request_to_follow(spark, requests, gap):
    pages = spark.createDataFrame([("l", i + 1, r, i + 1) for i, r in enumerate(requests)], "list string, ord long, request long, response long")
    start = F.col("request").isNull()
    got = chains.chain_gaps(chains.page_segments(pages, ["list"], ["ord"], start), ["list"], ["ord"], start, "request", "response").collect()
    assert [(r["segment"], r["pages"], r["gap"]) for r in got] == [(1, 3, gap)]


def test_alignment_distance_counts_a_swap_once():
    assert [query.osa(a, b) for a, b in (("food", "fodo"), ("", "ab"), ("kitten", "sitting"), ("ca", "abc"))] == [1, 2, 3, 3]


def test_cursor_of_another_kind_is_refused(spark):
    df = spark.createDataFrame([("r:5:20000",), ("d:5:7",), (None,), ("r:x:1",)], "c string")
    assert [tuple(r) for r in df.select(*query.offset_cursor(F.col("c"))).collect()] == [(5, 10001), (None, None), (None, None), (None, None)]


def test_expansion_takes_the_first_known_form(spark):
    chips = spark.createDataFrame([(1, 0, "berries"), (1, 1, "cooking"), (2, 0, "none")], "query_id int, chip int, term string")
    categories = spark.createDataFrame([("berry", 1, "fruit"), ("berry", 2, "berry"), ("food", 1, "meal")], "category string, ord int, term string")
    aliases = spark.createDataFrame([("cook", "food")], "alias string, category string")
    assert sorted(map(tuple, query.expand_terms(chips, categories, aliases).collect())) == [(1, 0, 1, "fruit"), (1, 0, 2, "berry"), (1, 1, 1, "meal")]


def _segments(spark, text, prefixes=(), exact=(), parts=()):
    kinds = "caption string, prefixes array<string>, exact array<string>, parts array<string>"
    rows = spark.createDataFrame([(text, list(prefixes), list(exact), list(parts))], kinds).withColumn("ranges", enrich.ranges_of("caption", "prefixes", "exact", "parts"))
    return [tuple(x) for x in enrich.with_segments(rows, "caption", "ranges").first()["segments"]]


@pytest.mark.parametrize("caption", ["Cooking a meal, cook!", "", None, "nothing", "cook " * 10])
def test_highlight_keeps_the_caption(spark, caption):
    parts = _segments(spark, caption, ["cook"])
    assert "".join(t for t, _ in parts) == (caption or "")
    assert [t.lower()[:4] for t, hit in parts if hit] == ["cook"] * (caption or "").lower().count("cook")


@pytest.mark.parametrize(("text", "marks", "hits"), [
    ("Recipes for a hobby", (["recipe"], ["hobbies"], []), ["Recipes", "hobby"]),
    ("we baked and bake cakes", ([], ["baking"], []), ["baked", "bake"]),
    ("fruit cake and Fruit  cake", ([], [], ["fruit cake"]), ["fruit cake"]),
    ("fruit cake", (["cake"], [], ["fruit cake"]), ["fruit cake"]),
    ("簡単レシピ集", ([], [], ["レシピ"]), ["レシピ"]),
    ("meal prepping", (["mealprep", "prep"], [], []), ["meal", "prepping"]),
    ("İx cake", ([], [], ["cake"]), []),
])
def test_highlight_forms_phrases_and_substrings(spark, text, marks, hits):
    assert [t for t, hit in _segments(spark, text, *marks) if hit] == hits


def test_long_captions_are_cut_around_the_first_hit(spark):
    parts = _segments(spark, "x " * 300 + "cook" + " y" * 300, ["cook"])
    assert parts[0][0].startswith("…") and parts[-1][0].endswith("…") and ("cook", True) in parts and sum(len(t) for t, _ in parts) == enrich.WINDOW_CHARS + 2


def test_highlight_takes_all_kinds_of_terms(spark):
    chips = spark.createDataFrame([(1, "meal prep", False), (1, "東京", True)], "query_id int, text string, substring boolean")
    related = spark.createDataFrame([(1, "slow cooker"), (1, "Food")], "query_id int, term string")
    from larder.functions.text import tokens

    terms = enrich.highlight_terms(chips, related, tokens)
    assert sorted((r["kind"], r["term"]) for r in terms.collect()) == [("exact", "food"), ("phrase", "meal prep"), ("phrase", "slow cooker"), ("prefix", "meal"), ("prefix", "prep"), ("substring", "東京")]
    docs = spark.createDataFrame([(5, "Foods in 東京: a slow cooker")], "external_id long, caption string")
    shown = enrich.highlight(spark.createDataFrame([(1, 5)], "query_id int, id long"), terms, docs, "external_id", "caption").first()
    assert [x["text"] for x in shown["segments"] if x["hit"]] == ["Foods", "東京", "slow cooker"]


def test_numbers_in_texts_are_cut(spark):
    df = spark.createDataFrame([(x,) for x in ("12.7", "1e3", " 5 ", "-2.9", "x", "", None, "9007199254740993", "0x1", "NaN")], "t string")
    assert [r[0] for r in df.select(tolerant_long(F.col("t"))).collect()] == [12, 1000, 5, -2, None, None, None, 9007199254740993, None, None]


def test_batches_are_folded_in_order(spark):
    stored = spark.createDataFrame([(1, "old", 5)], "external_id long, caption string, views long")
    incoming = spark.createDataFrame([(1, "b", None, 2), (1, "a", 7, 1), (2, None, 1, 1), (2, "new", None, 2)], "external_id long, caption string, views long, ord int")
    got = changes.upsert_items(stored, incoming, ["caption"], ["views"], order="ord")
    assert sorted(map(tuple, got.collect())) == [(1, "b", 7, "reindexed"), (2, "new", 1, "inserted")]


def _capture(**changed):
    good = {"channel": ingest.CHANNEL, "v": 1, "platform": "p", "kind": "k", "request_cursor": "1", "collection_id": None, "captured_at": 1_000_000, "body": "{}", "page_handle": "a.b", "viewer_handle": None, "viewer_id": "9" * 24}
    return tuple((good | changed).values())


def test_captures_fail_their_first_check(spark):
    cases = [({}, None), ({"channel": "x"}, "malformed"), ({"channel": None}, "malformed"), ({"v": 2}, "malformed"), ({"platform": "P"}, "malformed"), ({"platform": "q"}, "wrong_platform"), ({"kind": "z"}, "unknown_kind"), ({"kind": None}, "unknown_kind"),
             ({"request_cursor": "1a"}, "malformed"), ({"request_cursor": "1" * 17}, "malformed"), ({"viewer_id": "9" * 25}, "malformed"), ({"page_handle": "a b"}, "malformed"), ({"captured_at": None}, "malformed"), ({"captured_at": 1}, "stale"),
             ({"body": ""}, "malformed"), ({"body": None}, "malformed"), ({"body": "x" * 11}, "too_large"), ({"captured_at": 1, "body": ""}, "stale")]
    rows = spark.createDataFrame([(*_capture(**c), i) for i, (c, _) in enumerate(cases)], f"{ingest.ENVELOPE}, n int")
    rules = spark.createDataFrame([("p", "k")], "platform string, kind string")
    got = ingest.validate_captures(rows, rules, F.lit(1_000_001), most_chars=10, carried=("n",)).collect()
    assert {r["n"]: r["reason"] for r in got} == {i: reason for i, (_, reason) in enumerate(cases)}


def test_origins_need_scheme_and_host(spark):
    urls = ["https://a.example.org/x", "https://example.org", "http://example.org/", "https://badexample.org/", "https://example.org:443/", "https://u@example.org/", "HTTPS://B.Example.Org/?q", None]
    rows = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    assert sorted(r["i"] for r in ingest.filter_origins(rows, "url", ["https://*.example.org/*"]).collect()) == [0, 1, 6]


def test_a_pass_must_not_be_empty_unless_nothing_is_declared(spark):
    none = spark.createDataFrame([], "scope string, id long")
    declared = spark.createDataFrame([("a", 0), ("b", 3), ("c", None)], "scope string, total int")
    got = changes.guard_reconcile(none, none, "scope", declared=declared).collect()
    assert {r["scope"]: r["allowed"] for r in got} == {"a": True, "b": False, "c": True}


def test_pages_are_appended_once(spark):
    shown, more = spark.createDataFrame([("x", 2), ("y", 3)], "id string, n int"), spark.createDataFrame([("x", 1), ("z", 1), ("z", 2)], "id string, n int")
    assert sorted(map(tuple, rank.appended(shown, more, "id", ["n"]).collect())) == [("x", 2), ("y", 3), ("z", 1)]


def test_tags_change_with_the_text_only(spark):
    kind = "external_id long, hashtags array<string>"
    stored = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["c"])], kind)
    incoming = spark.createDataFrame([(1, []), (2, ["x"]), (3, None), (4, ["n"])], kind)
    changed = spark.createDataFrame([(1,), (3,), (4,)], "external_id long")
    assert sorted((r[0], r[1]) for r in changes.replace_hashtags(stored, incoming, changed).collect()) == [(1, []), (2, ["b"]), (3, ["c"]), (4, ["n"])]


def test_emptied_collections_are_counted(spark):
    kept = spark.createDataFrame([(1, 5, 10), (2, 6, 20), (3, 7, 30)], "collection_id long, held long, last_synced long")
    members = spark.createDataFrame([(1, 9), (3, 9)], "collection_id long, external_id long")
    touched = spark.createDataFrame([(1,), (2,)], "collection_id long")
    assert sorted(map(tuple, changes.recount_collections(kept, members, touched, F.lit(99)).collect())) == [(1, 1, 99), (2, 0, 99), (3, 7, 30)]
    assert sorted(map(tuple, changes.recount_collections(kept, members, touched).collect())) == [(1, 1, 10), (2, 0, 20), (3, 7, 30)]


def test_accounts_are_bound_over_stretches_of_a_platform(spark, monkeypatch):
    monkeypatch.setattr(changes, "STRETCH", 3)
    g = random.Random(7)
    rows = [(p, b * 5 + 2, g.choice([None, "1", "1", "2"]), g.choice(["a", "A", "b", "c"])) for p in "pqr" for b in range(40)] + [("s", 2**50, None, "x"), ("s", 2**50 + 1, "9", "X"), ("s", 2**51, "9", "y"), ("s", 2**51 + 1, None, "y")]
    bound = [("q", None, "b"), ("r", "1", "z")]

    def stands(i, h, old_i, old_h):
        if i and old_i:
            return "different" if i != old_i else "same" if h.lower() == old_h.lower() else "renamed"
        return ("upgraded" if i and not old_i else "same") if h.lower() == old_h.lower() else "different"

    wanted, own = {}, {p: [i, h] for p, i, h in bound}
    for p, b, i, h in sorted(rows, key=lambda r: r[:2]):
        mine = own.setdefault(p, [i, h])
        wanted[p, b] = told = stands(i, h, *mine)
        if told in ("renamed", "upgraded") or told == "same" and i and i == mine[0]:
            own[p] = [i or mine[0], h]
    made = changes.bind_accounts(spark.createDataFrame(rows, "platform string, batch_id long, id string, handle string"), spark.createDataFrame(bound, "platform string, id string, handle string"), query.match_account)
    assert {(r["platform"], r["batch_id"]): r["match"] for r in made.collect()} == wanted
    # no task reads all batches of a platform in order
    windows = re.findall(r"Window \[last\(_mine#\d+[^\n]*", made._jdf.queryExecution().optimizedPlan().toString())
    assert windows and all(re.search(r"\[platform#\d+, _stretch#\d+L?\], \[batch_id", w) for w in windows)
