"""What must not grow beyond the input: broadcasts of corpus tables, shuffles of records, lists of words in Python, places of frequent words."""

import json
import math
import random
import re

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.functions import text
from larder.operators import bitmaps, impacts, index, match, phrases, rank
from larder.sources import payloads
from larder.sources.snapshots import scratch


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_document_numbers_are_never_broadcast(spark):
    docs = spark.createDataFrame([(i, "a b", i) for i in range(50)], "external_id long, caption string, saved_at long")
    idx = index.build(docs, {"caption": "caption"}, scratch(spark, "index"), words=text.folded_words)
    words = bitmaps.build(idx, docs.select(F.col("external_id").alias("id"), "saved_at"), scratch(spark, "bits"))
    matches = spark.range(1000).select(F.col("id").alias("n"))
    assert "BroadcastHashJoin" in plan_of(matches.join(words.saved.rows, "n"))  # so small are the files
    assert "Broadcast" not in plan_of(matches.join(words.numbers, "n"))


def test_records_of_a_page_are_told_without_a_shuffle(spark):
    items = [{"id": "11111"}, 3, {"id": "22222"}, {"id": "11111"}, {"id": 33333}, {"id": "x"}]
    kind = "page int, body string, request_cursor string, collection_id string, captured_at long"
    pages = spark.createDataFrame([(1, json.dumps({"itemList": items, "cursor": 5}), "40", "7", 9), (2, json.dumps({"itemList": []}), None, None, 9), (3, "{", None, None, 9)], kind)
    records = payloads.item_records(pages)
    assert sorted((r["page"], r["ord"], r["external_id"], r["nth"], r["of"]) for r in records.drop("raw").collect()) == [(1, 0, "11111", 0, 3), (1, 2, "22222", 1, 3), (1, 4, "33333", 2, 3)]
    for df in (payloads.memberships(records), payloads.estimate_saved_at(records), payloads.problems(pages)):
        assert "Exchange" not in plan_of(df) and "Sort" not in plan_of(df)
    assert sorted((r["page"], r["code"], r["ord"]) for r in payloads.problems(pages).collect() if r["ord"] is not None) == [(1, "bad_record", 1), (1, "bad_record", 5)]


def test_problems_are_cut_at_fifty_of_a_page(spark):
    body = json.dumps({"itemList": [0] * 400})
    found = payloads.problems(spark.createDataFrame([(1, body)], "page int, body string")).collect()
    assert len(found) == 50 and found[0]["ord"] is None and [r["ord"] for r in found[1:]] == list(range(49))


def test_words_leave_python_as_one_text(spark):
    assert text._folded.func(pd.Series(["Ça va_bien", None])).tolist() == ["ca va bien", ""]
    texts = ["", None, "Plain Text_x 12", "Ça été", "ＡＢ ﬁne", "— …", "Ñ\u0000é"]
    got = [r["w"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.folded_words("t").alias("w")).collect()]
    # a null text has no words: nothing is exploded of it
    assert [w or [] for w in got] == [[], [], ["plain", "text", "x", "12"], ["ca", "ete"], ["ab", "fine"], [], ["n", "e"]]
    assert spark.createDataFrame([("ﬁ",), ("a",), (None,)], "t string").select(text.nfkc("t").alias("t")).collect() == [("fi",), ("a",), (None,)]


def test_phrases_equal_a_plain_search(spark):
    g = random.Random(3)
    docs = [(i, " ".join(g.choice("aaabbcd") for _ in range(30))) for i in range(200)] + [(7, "a b c d")]  # an id twice
    idx = index.in_memory(spark.createDataFrame(docs, "external_id long, caption string"), {"caption": "caption"}, words=text.folded_words)
    asked = ["a", "a a", "c d", "a b c", "d a b c", "b zz", "zz", "a b a b a"]
    words = spark.createDataFrame([(p, i, w) for p in asked for i, w in enumerate(p.split())], "phrase string, part int, term string")
    found = sorted((r["phrase"], r["id"], r["begin"]) for r in phrases.begins(words, idx).collect())
    plain = set()
    for p in asked:
        w = p.split()
        for i, t in docs:
            ws = t.split()
            plain |= {(p, i, b) for b in range(len(ws) - len(w) + 1) if ws[b : b + len(w)] == w}
    assert found == [x for x in sorted(plain)]


def test_scores_are_added_up_by_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    g = random.Random(5)
    docs = [(i, " ".join(g.choice("aaaaabcd") for _ in range(g.randint(1, 9)))) for i in range(60)]
    idx = index.in_memory(spark.createDataFrame(docs, "external_id long, caption string"), {"caption": "caption"}, words=text.folded_words)
    chips = [(q, w) for q in range(7) for w in "abd"[: 1 + q % 3]] + [(0, "a"), (9, "zz")]
    monkeypatch.setattr(rank, "TASK_HITS", 20)
    scored = rank.bm25(spark.createDataFrame(chips, "query_id long, term string"), idx)
    held = {i: t.split() for i, t in docs}
    mean, n = sum(map(len, held.values())) / len(held), {w: sum(w in ws for ws in held.values()) for w in "abd"}
    hits = sum(n.get(w, 0) for _, w in set(chips))
    # a query and document stay with the document's task
    assert scored.rdd.getNumPartitions() == -(-hits // 20) > 4
    part = lambda w, ws: max(math.log((60 - n[w] + 0.5) / (n[w] + 0.5)), 1e-6) * (f := 2.0 * ws.count(w)) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ws) / mean))
    plain = {(q, i): sum(part(w, ws) for w in {w for p, w in chips if p == q and w in ws}) for q in range(7) for i, ws in held.items()}
    assert {(r["query_id"], r["id"]): r["score"] for r in scored.collect()} == pytest.approx({k: v for k, v in plain.items() if v > 0})


def test_an_index_is_sorted_by_as_many_tasks_as_it_has_places_for(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a a b c") for i in range(100)], "external_id long, caption string")
    monkeypatch.setattr(index, "TASK_PLACES", 40)
    made = index.build(docs, {"caption": "caption"}, scratch(spark, "index"), words=text.folded_words)
    # a word that all documents hold twice lies in several files
    assert len(made.postings.filter("term = 'a'").inputFiles()) >= 8
    assert sorted((r["term"], r["n_docs"], r["n_places"]) for r in made.terms.collect()) == [("a", 100, 200), ("b", 100, 100), ("c", 100, 100)]


def test_an_index_keeps_no_unsorted_copy_and_tells_pairs_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i, "a a b" if i % 2 else "b c", "a") for i in range(40)] + [(7, "c", None)], "external_id long, caption string, author string")  # an id twice
    folder = scratch(spark, "index")
    made = index.build(docs, {"caption": "caption", "author": "author"}, folder, words=text.folded_words)
    plain = index.in_memory(docs, {"caption": "caption", "author": "author"}, words=text.folded_words)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/unsorted")
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    assert "Exchange" not in plan_of(made.weighed())
    for a, b in ((made.weighed(), plain.weighed()), (made.terms, plain.terms), (made.documents, plain.documents), (made.postings, plain.postings)):
        assert sorted(a.collect()) == sorted(b.select(a.columns).collect())


def test_blocks_are_cut_in_the_sorted_ranges(spark, monkeypatch):
    monkeypatch.setattr(impacts, "BLOCK", 4)
    sizes = {"a": 1, "b": 4, "c": 5, "d": 17, "e": 8}
    rows = pa.table({"term": [t for t, n in sizes.items() for _ in range(n)], "n": [i for n in sizes.values() for i in range(n)]})
    ones = pa.array([1.0] * len(rows))
    rows = rows.append_column("f", ones).append_column("norm", ones).append_column("c", pa.array([-float(i) for i in rows["n"].to_pylist()])).append_column("_range", pa.array([3] * len(rows), pa.int32()))
    for size in (1, 3, 4, 7, 100):
        made = [x for b in impacts.cut_blocks(iter(rows.to_batches(max_chunksize=size))) for x in b.to_pylist()]
        assert [(x["term"], x["_blk"], x["most"], [y["n"] for y in x["held"]]) for x in made] == [(t, k // 4, -float(k), [*range(k, min(n, k + 4))]) for t, n in sizes.items() for k in range(0, n, 4)]


def test_blocks_are_numbered_over_ranges_and_leave_no_copy(spark, monkeypatch):
    monkeypatch.setattr(impacts, "BLOCK", 4)
    docs = spark.createDataFrame([(i, "a " * (1 + i % 9) + ("b" if i % 3 else ""), i) for i in range(100)], "external_id long, caption string, saved_at long")
    idx = index.build(docs, {"caption": "caption"}, scratch(spark, "index"), words=text.folded_words)
    folder = scratch(spark, "impacts")
    made = impacts.build(bitmaps.build(idx, docs.select(F.col("external_id").alias("id"), "saved_at"), scratch(spark, "bits")), folder)
    blocks = {t: [r for r in made.blocks.orderBy("term", "blk").collect() if r["term"] == t] for t in "ab"}
    for t, n in (("a", 100), ("b", 66)):
        assert [r["blk"] for r in blocks[t]] == [*range(len(blocks[t]))] and len({h["n"] for r in blocks[t] for h in r["held"]}) == sum(len(r["held"]) for r in blocks[t]) == n
        by_block = [[h["f"] * (impacts.K1 + 1) / (h["f"] + h["norm"]) for h in r["held"]] for r in blocks[t]]
        assert [max(c) for c in by_block] == pytest.approx([r["most"] for r in blocks[t]]) and all(min(x) >= max(y) - 1e-9 for x, y in zip(by_block, by_block[1:]))
        assert all(r["level"] == impacts._level(r["blk"]) for r in blocks[t])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/ranges")
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_a_prefix_is_looked_up_once_for_all_its_chips(spark):
    docs = [(1, "abcd abce x"), (2, "abce abce"), (3, "abd xyz"), (4, "ab")]
    idx = index.build(spark.createDataFrame(docs, "external_id long, caption string"), {"caption": "caption"}, scratch(spark, "index"), words=text.folded_words)
    chips = [(q, c, w) for q in (1, 2) for c, w in enumerate(["abc", "abce", "xyz", "ab"])]
    hits = match.prefix_hits(spark.createDataFrame(chips, "query_id long, chip int, term string"), idx)
    plain = sorted((q, c, i) for q, c, w in chips if len(w) >= 3 for i, t in docs if any(x.startswith(w) for x in t.split()))
    assert sorted(tuple(r) for r in hits.collect()) == plain
    # what is dealt out to be told apart has no query yet
    assert all("query_id" not in x and "chip" not in x for x in re.findall(r"Exchange hashpartitioning\(prefix[^\n]*", plan_of(hits))) and not re.search(r"Exchange hashpartitioning\(query_id#\d+L?, chip#\d+, id", plan_of(hits))
