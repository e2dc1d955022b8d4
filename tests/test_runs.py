"""Stateful streams against plain folds, and the stream of captures."""

import json

from larder.operators.ingest import CHANNEL
from larder.streaming import chains, followers, ingest, runs


def _stream(spark, tmp_path, batches, schema, build):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = build(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_lists_are_followed_across_batches(spark, tmp_path):
    schema = "run string, list string, arrival_ord long, request string, response string, has_more boolean"
    first = [("r", "a", 1, None, "x", True), ("r", "b", 2, None, "x", True), ("r", "c", 3, "q", "x", False)]
    second = [("r", "a", 5, "x", "0", False), ("r", "b", 6, "other", "0", False)]
    third = [("r", "b", 7, "0", "y", True), ("r", "b", 8, "y", None, False), ("r", "c", 9, "q", "x", False), ("r", "c", 10, "q", "x", False), ("r", "c", 11, "q", "x", False)]
    out = _stream(spark, tmp_path, [first, second, third], schema, runs.follow_lists)
    assert sorted((r["list"], r["outcome"], r["at"]) for r in out.collect()) == [("a", "complete", 5), ("b", "complete", 8), ("c", "partial", 11)]


def test_memberships_wait_for_their_collection(spark, tmp_path):
    schema = "collection_id long, kind string, external_id long, position long, arrival_ord long"
    first = [(1, "membership", 10, 0, 1), (1, "membership", 11, 1, 2), (2, "collection", None, None, 3), (2, "membership", 12, 0, 4)]
    second = [(1, "collection", None, None, 5), (1, "membership", 13, 2, 6), (3, "membership", 14, 0, 7)]
    out = _stream(spark, tmp_path, [first, second], schema, runs.hold_memberships)
    assert sorted((r["collection_id"], r["external_id"], r["position"]) for r in out.collect()) == [(1, 10, 0), (1, 11, 1), (1, 13, 2), (2, 12, 0)]


def test_memberships_are_held_by_buckets_and_keep_their_digits(spark, tmp_path):
    schema, big = "collection_id long, kind string, external_id long, position long, arrival_ord long", 2**53 + 1
    rows = [(c, "membership", big + c, 0, c) for c in range(-40, 40)] + [(c, "collection", None, None, 100) for c in range(-40, 20)]
    out = _stream(spark, tmp_path, [rows, [(c, "collection", None, None, 200) for c in range(40)]], schema, runs.hold_memberships)
    assert sorted((r["collection_id"], r["external_id"], r["outcome"]) for r in out.collect()) == [(c, big + c, "applied") for c in range(-40, 40)]
    # Python is called for a bucket, not for a collection
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "seen"))
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "seen"))
    for held in (runs.hold_memberships(events), followers.held_memberships(events)):
        assert "bucket" in held._jdf.queryExecution().analyzed().toString()


def _row(n, kind, body, **changed):
    row = {"channel": CHANNEL, "v": 1, "platform": "p", "kind": kind, "request_cursor": "0", "collection_id": None, "captured_at": 10_000 + n, "body": json.dumps(body), "page_handle": "me", "viewer_handle": "Me", "viewer_id": "7", "arrival_ord": n, "ingested_at": 10_000 + n}
    return tuple((row | changed).values())


def _items(*ids, **more):
    return {"itemList": [{"id": str(10_000 + i), "desc": f"item {i}", "author": {"uniqueId": "a"}, **more} for i in ids], "hasMore": False}


def test_captures_are_applied_to_all_tables(spark, tmp_path):
    rules = spark.createDataFrame([("p", k) for k in (*ingest.ITEM_KINDS, *ingest.COLLECTION_KINDS)], "platform string, kind string")
    batches = [
        [_row(1, "favorites", _items(1, 2)), _row(2, "collection_items", _items(2, 3), collection_id="5"), _row(3, "favorites", _items(9), page_handle="other"), _row(4, "nothing", _items(9)), _row(5, "favorites", _items(9), viewer_handle=None)],
        [_row(6, "collection_list", {"collectionList": [{"collectionId": "5", "name": "five", "total": 2}]}), _row(7, "favorites", _items(1, desc="changed")), _row(8, "favorites", _items(9), viewer_id="8")],
        [_row(9, "favorites", _items(1, desc="changed"))],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, ingest.CAPTURES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.run(spark.readStream.schema(ingest.CAPTURES).parquet(str(tmp_path / "in")), str(tmp_path / "out"), rules).awaitTermination()
        store = ingest.Store(spark, str(tmp_path / "out"))
        if n == 0:
            assert sorted(r["external_id"] for r in store.read("pending").collect()) == ["p:10002", "p:10003"] and store.read("memberships").count() == 0
    assert sorted((r["item"], r["caption"]) for r in store.read("items").collect()) == [("p:10001", "changed"), ("p:10002", "item 2"), ("p:10003", "item 3")]
    assert [(r["collection_id"], r["name"], r["declared_total"], r["held"]) for r in store.read("collections").collect()] == [("p:5", "five", 2, 2)]
    assert sorted((r["external_id"], r["position"]) for r in store.read("memberships").collect()) == [("p:10002", 0), ("p:10003", 1)] and store.read("pending").count() == 0
    assert [tuple(r) for r in store.read("accounts").drop("key").collect()] == [("p", "7", "Me")]
    rejected = {r["arrival_ord"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "out" / "rejected")).collect()}
    assert rejected == {3: "not_own_page", 4: "unknown_kind", 5: "no_viewer", 8: "other_account"}
    metrics = {(r["number"], r["kind"]): (r["pages"], r["rejected"], r["items"], r["inserted"], r["reindexed"], r["duplicates"]) for r in spark.read.parquet(str(tmp_path / "out" / "metrics")).collect()}
    assert metrics[(0, "favorites")] == (1, 2, 2, 2, 0, 0) and metrics[(1, "favorites")] == (1, 1, 1, 0, 1, 1) and metrics[(2, "favorites")] == (1, 0, 1, 0, 0, 1)
    before = ingest.Store(spark, str(tmp_path / "out"), before=1)
    assert {r["caption"] for r in before.read("items").collect()} == {"item 1", "item 2", "item 3"}


def test_an_ending_page_stops_nothing(spark):
    rows = [("a", 1, 3, 0, False), ("a", 2, 3, 0, True), ("a", 3, 3, 0, False), ("b", 1, 3, 0, False), ("b", 2, 0, 0, False), ("b", 3, 3, 0, False), ("b", 4, 3, 0, True)]
    pages = spark.createDataFrame(rows, "list string, ord int, items int, inserted int, ended boolean")
    got = chains.stop_after_known(pages, ["list"], ["ord"], "items", "inserted", pages["ended"]).collect()
    assert [tuple(r) for r in got] == [("a", 3)]


def test_silence_is_retried_then_reported(spark):
    at = [0, 130, 150, 400, 1000]
    pages = spark.createDataFrame([("r", i, t * 1000, 1 if i in (0, 2) else 0) for i, t in enumerate(at)], "run string, ord int, at long, items int")
    got = chains.stalls(pages, ["run"], ["ord"], "at", 120_000, "items").orderBy("ord").collect()
    assert [(r["ord"], r["retries"], r["state"]) for r in got] == [(0, 1, "retrying"), (2, 2, "retrying"), (3, 7, "attention")]
    state = type("State", (), {"exists": False, "hasTimedOut": False, "get": (0, -1), "update": lambda s, v: (setattr(s, "get", v), setattr(s, "exists", True)), "setTimeoutDuration": lambda s, ms: setattr(s, "ms", ms)})()
    watch = runs._watch(120_000, 3)
    state.hasTimedOut, told = True, []
    for _ in range(4):
        told += next(watch(("r",), iter(()), state)).values.tolist()
    assert [t[1:] for t in told] == [["retrying", 1], ["retrying", 2], ["retrying", 3], ["attention", 4]]


def test_a_run_fails_at_its_cap(spark):
    totals = spark.createDataFrame([("r", i, i) for i in (2999, 3000, 3001)], "run string, ord int, pages_so_far int")
    assert [tuple(r) for r in runs.over_cap(totals, ["run"], "ord").collect()] == [("r", 3000)]


def test_lists_of_collections_are_absorbed(spark):
    rows = [("r", 1, "a", "old", 5, False), ("r", 2, "a", "new", None, True), ("r", 3, "b", "b", None, None), ("q", 1, "a", "x", None, False), ("q", 2, None, None, None, False)]
    got = runs.absorb_collections(spark.createDataFrame(rows, "run string, arrival int, id string, name string, declared_total long, has_more boolean")).collect()
    assert sorted(tuple(r) for r in got) == [("q", "a", "x", None, 1, "pending", False), ("r", "a", "new", 5, 1, "pending", True), ("r", "b", "b", None, 3, "pending", True)]
