"""Bitmaps, impact blocks and sorted layouts against plain matches, scores and sorts; requests of their own modes, sorts and cursors."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from larder.functions.text import folded_words
from larder.operators import bitmaps, impacts, index, layout, terms
from larder.plans import search as plan
from larder.registered import searches
from larder.sources.snapshots import scratch
from larder.sources.snapshots import stored as store


@pytest.fixture(scope="module")
def library(spark):
    g = random.Random(4)
    rows = []
    for i in range(6000):
        words = ["often"] * g.randint(-6, 5) + [f"w{int(g.paretovariate(0.9))}" for _ in range(g.randint(1, 12))]
        g.shuffle(words)
        rows.append((i * 3, " ".join(words), g.randint(0, 50)))
    docs = spark.createDataFrame(rows, "external_id long, caption string, saved_at long").repartition(4)
    idx = index.in_memory(docs, {"caption": "caption"}, words=folded_words)
    words = bitmaps.build(idx, docs.select(F.col("external_id").alias("id"), "saved_at"), scratch(spark, "bits"))
    return idx, impacts.build(words, scratch(spark, "impacts")), docs


def _asked(spark, chips, related=()):
    own = terms.own_terms(spark.createDataFrame(chips, "query_id int, chip int, text string"), folded_words)
    return own.unionByName(terms.related_terms(spark.createDataFrame(list(related), "query_id int, chip int, ord int, term string"), folded_words))


@pytest.mark.parametrize("mode", ["all", "any"])
def test_best_equal_all_scored(spark, library, mode):
    """Words, prefixes, phrases and related terms; as many as asked for, and all."""
    idx, lib, _ = library
    chips = [(1, 0, "often"), (2, 0, "often"), (2, 1, "w1"), (3, 0, "w2 w1"), (4, 0, "w7"), (5, 0, "w44"), (5, 1, "w5"), (6, 0, "oft"), (7, 0, "nowhere")]
    asked = _asked(spark, chips, [(4, 0, 0, "often"), (4, 0, 1, "w1 w1"), (5, 0, 0, "w3")])
    sizes = spark.createDataFrame([(q, len([c for c in chips if c[0] == q]), mode) for q in range(1, 8)], "query_id int, n_chips int, mode string")
    found = terms.places(asked, idx)
    matches = terms.query_matches(terms.chip_matches(found), sizes, mode)
    plain = sorted((r["query_id"], r["rank"], r["id"], r["tier"], r["score"]) for r in terms.rank_tiers(terms.scores(found, matches, idx.documents), 10_000).collect())
    assert {(r["query_id"], r["id"], r["direct"]) for r in bitmaps.members(plan.bits_of(asked, sizes, lib)[3]).join(lib.words.numbers, "n").collect()} == {(r["query_id"], r["id"], r["direct"]) for r in matches.collect()}
    for depth in (20, 10_000):
        got = sorted((r["query_id"], r["rank"], r["id"], r["tier"], r["score"]) for r in plan.rank_terms(asked, sizes, lib, depth).collect())
        wanted = [p for p in plain if p[1] <= depth]
        assert [g[:4] for g in got] == [w[:4] for w in wanted]
        assert all(abs(g[4] - w[4]) < 1e-5 for g, w in zip(got, wanted))


def test_most_blocks_of_a_frequent_word_are_never_read(spark, library, monkeypatch):
    idx, lib, _ = library
    asked = _asked(spark, [(1, 0, "often"), (2, 0, "often"), (2, 1, "w1")])
    kept = []
    monkeypatch.setattr(impacts, "kept_blocks", lambda *a, real=impacts.kept_blocks: kept.append(real(*a)) or kept[-1])
    sizes = spark.createDataFrame([(1, 1, "all"), (2, 2, "any")], "query_id int, n_chips int, mode string")
    assert plan.rank_terms(asked, sizes, lib, 10).count() == 20
    blocks = lib.blocks.filter("term = 'often'").count()
    read = {(r["query_id"], r["term"]): r["n"] for r in kept[0].groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert blocks > 8 and read[(1, "often")] <= 2 and read[(2, "often")] < blocks / 2
    assert lib.blocks.filter("level > 1").count() > 0


def test_first_bits_are_the_newest(spark, library):
    _, lib, docs = library
    asked = _asked(spark, [(1, 0, "often")])
    bits = plan.bits_of(asked, spark.createDataFrame([(1, 1, "all")], "query_id int, n_chips int, mode string"), lib)[3]
    held = sorted(((-r["saved_at"], -r["external_id"]) for r in docs.collect() if "often" in r["caption"].split()))
    for at in (None, 700, len(held) - 3):
        cursor = spark.createDataFrame([(1, *(-x for x in held[at]))] if at is not None else [], "query_id int, value long, item long")
        after = lib.words.saved.after(cursor)
        page = bitmaps.first_members(bits.join(after, "query_id", "left"), F.lit(25), F.col("after")).join(lib.words.numbers, "n").orderBy("rank").collect()
        start = 0 if at is None else at + 1
        assert [-r["id"] for r in page] == [i for _, i in held[start : start + 25]]


def test_pages_open_the_parts_around_their_cursors(spark):
    rows = [(i, (i * 7919) % 500) for i in range(5000)] + [(9000, None)]
    made = layout.build(spark.createDataFrame(rows, "id long, key long"), scratch(spark, "layout"), part_rows=250)
    assert len(made.manifest) > 12
    wanted = sorted(((k or 0), i) for i, k in rows)[::-1]
    asked = [(1, None, None, 30), (2, 250, 2500, 30), (3, 0, 1, 30), (4, 10**6, 5, 10), (5, 251, -1, 400), (6, -5, 0, 3)]
    requests = spark.createDataFrame(asked, "query_id int, value long, item long, most int")
    found = made.pages(requests).orderBy("query_id", "rank").collect()
    for q, value, item, most in asked:
        page = [x for x in wanted if value is None or x < (value, item)][:most]
        assert [(r["key"], r["id"]) for r in found if r["query_id"] == q] == page
    few = made.chosen(requests.filter("query_id IN (2, 4)")).select("part").distinct().count()
    assert few <= 5
    plan_text = made.pages(requests.filter("query_id = 2"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan_text and "part#" in plan_text.split("PartitionFilters: [")[1][:200]
    assert layout.build(spark.createDataFrame([], "id long, key long"), scratch(spark, "layout")).pages(requests).count() == 0


def test_requests_of_their_own(spark):
    """Refusals, browsing, cursors from page to page, and totals."""
    rows = [(i, f"red {'ring' if i % 2 else 'box'}", ["t"], "ann", i // 3, i * 7 % 11) for i in range(40)]
    items = spark.createDataFrame(rows, "external_id long, caption string, hashtags array<string>, author_handle string, saved_at long, views long")
    idx = index.in_memory(items, {"caption": "caption"}, words=folded_words)
    none = spark.createDataFrame([], "id long, key long, text string")
    lib = plan.Library(idx, items, none, items.select("external_id", "caption"), spark.createDataFrame([], "category string, ord int, term string"), spark.createDataFrame([], "alias string, category string"))
    sent = spark.createDataFrame([(q, 0, w, True) for q, w in ((1, "ring"), (2, "red"), (3, "ring"), (4, "ring"), (5, "ring"))], "query_id int, ord int, text string, expand boolean")
    asked = [(1, None, "newest", 5, None), (2, None, "most_viewed", 6, None), (3, "none", None, None, None), (4, None, None, 4, "r:4:20"), (5, None, "most_viewed", 3, "k:s:1:2:3"), (6, None, None, 7, None), (7, None, "most_viewed", 3, None)]
    kind = "query_id int, mode string, sort string, limit int, cursor string"
    found = plan.search(sent, lib, requests=spark.createDataFrame(asked, kind), too_broad=30)
    assert {r["query_id"]: r["reason"] for r in found.requests.collect() if r["reason"]} == {3: "mode", 5: "other_cursor"}
    told = {r["query_id"]: (r["total"], r["mode"], r["ordered_by"], r["too_broad"]) for r in found.totals.collect()}
    assert told == {1: (20, "sorted", "newest", False), 2: (31, "sorted", "most_viewed", True), 4: (20, "relevance", "relevance", False), 6: (31, "browse", "recently_saved", True), 7: (31, "browse", "most_viewed", True)}
    keys = {2: [(-r[5], -r[0]) for r in rows], 6: [(-r[4], -r[0]) for r in rows], 7: [(-r[5], -r[0]) for r in rows]}
    pages, cursors = {q: [] for q in keys}, {q: None for q in keys}
    for _ in range(3):
        now = [(q, None, {2: "most_viewed", 7: "most_viewed"}.get(q), {2: 6, 6: 7, 7: 3}[q], cursors[q]) for q in keys]
        page = plan.search(sent.filter("query_id = 2"), lib, requests=spark.createDataFrame(now, kind), too_broad=30).page.orderBy("rank").collect()
        for q in keys:
            pages[q] += [-r["id"] for r in page if r["query_id"] == q]
            cursors[q] = next(r["next_cursor"] for r in page if r["query_id"] == q)
    for q, key in keys.items():
        assert pages[q] == [i for _, i in sorted(key)][: len(pages[q])] and len(pages[q]) == 3 * {2: 6, 6: 7, 7: 3}[q]
    assert sorted(r["id"] for r in found.page.filter("query_id = 4").collect()) == sorted([9, 11, 13, 15]) and found.page.filter("query_id = 4").first()["next_cursor"] == "r:8:20"
    assert found.snippets.filter("query_id = 6").count() == 7 and found.snippets.filter("query_id = 1").first()["segments"][1]["hit"]


def test_a_page_ranks_to_its_end_and_counts_all_matches(spark, monkeypatch):
    """Bitmaps are made once for all queries that rank the same matches; a page by offset is ranked no deeper than it goes."""
    made, depths = [], []
    monkeypatch.setattr(plan, "bits_of", lambda *a, real=plan.bits_of: made.append(1) or real(*a))
    monkeypatch.setattr(impacts, "tier_needs", lambda counts, depth, real=impacts.tier_needs: depths.append(depth._jc.toString()) or real(counts, depth))
    folder = tempfile.mkdtemp(prefix="spark-") + "/tables"
    os.symlink("/root/testdata/sf0.001", folder)  # nothing is kept by this path
    page = searches.d23_offset_page(spark, folder).collect()
    searches.d32_explain_matches(spark, folder)
    searches.d38_search_related(spark, folder)
    assert len(made) == 1 and depths == ["8", "30", "30"]
    # more matches than the page holds are counted
    assert {r["rank"] for r in page} == {4, 5, 6, 7, 8} and max(int(r["next_cursor"].split(":")[2]) for r in page if r["next_cursor"]) > 8


def test_lists_make_no_blocks_and_no_plan_of_all_sorts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b" if i % 2 else "a", ["t"], "x", i, i % 7) for i in range(60)], "external_id long, caption string, hashtags array<string>, author_handle string, saved_at long, views long")
    idx = index.in_memory(docs, {"caption": "caption"}, words=folded_words)
    none = spark.createDataFrame([], "category string, ord int, term string"), spark.createDataFrame([], "alias string, category string")
    lib = plan.Library(idx, docs, spark.createDataFrame([], "id long, key long, text string"), docs.select("external_id", "caption"), *none)
    sent = spark.createDataFrame([(1, 0, "b", True), (2, 0, "a", True)], "query_id int, ord int, text string, expand boolean")
    asked = spark.createDataFrame([(1, "most_viewed", 3), (2, "most_viewed", 4), (3, "recently_saved", 2)], "query_id int, sort string, limit int")
    made = []
    monkeypatch.setattr(plan, "stored", lambda df, name: (made.append(name), store(df, name))[1])
    found = plan.search(sent, lib, requests=asked)
    views = lambda ids: sorted(ids, key=lambda i: (-(i % 7), -i))
    wanted = {1: views(range(1, 60, 2))[:3], 2: views(range(60))[:4], 3: [59, 58]}
    assert {(r["query_id"], r["rank"]): r["id"] for r in found.page.collect()} == {(q, k + 1): i for q, ids in wanted.items() for k, i in enumerate(ids)}
    assert "impacts" not in lib._made and made.count("listed") == 2  # one for each kind that is asked
