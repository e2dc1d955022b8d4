"""Followers with timers: what they tell doesn't depend on how batches fall, and nothing that waits is lost."""

import datetime as dt

from pyspark.sql import functions as F

from larder.sources.store import Store
from larder.streaming import followers


def _run(spark, folder, batches, schema, build, event_time=False):
    own = followers.session(spark, event_time)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        q = build(own.readStream.schema(schema).parquet(f"{folder}/in")).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").collect()


PAGES = "run string, list string, arrival_ord long, request string, response string, has_more boolean"


def test_chains_go_on_across_batches(spark, tmp_path):
    first = [("r", "a", 2, "x", "y", True), ("r", "a", 1, None, "x", True), ("r", "b", 1, "q", "x", False), (None, "a", 1, "0", None, None)]
    second = [("r", "a", 3, "y", None, False), ("r", "a", 2, "x", "y", True), ("r", "b", 2, "0", "z", True), ("r", "b", 3, "other", "z", False), (None, "a", 2, None, None, False)]
    got = _run(spark, str(tmp_path), [first, second], PAGES, lambda s: followers.follow_chains(s, ["run", "list"]))
    assert sorted(((r["run"] or "", r["list"], r["arrival_ord"], r["segment"], r["gap"], r["outcome"]) for r in got)) == [
        ("", "a", 1, 1, False, "open"), ("", "a", 2, 2, False, "complete"),
        ("r", "a", 1, 1, False, "open"), ("r", "a", 2, 1, False, "open"), ("r", "a", 3, 1, False, "complete"),
        ("r", "b", 1, 0, True, "open"), ("r", "b", 2, 1, False, "open"), ("r", "b", 3, 1, True, "open"),
    ]


def test_silences_are_the_same_however_batches_fall(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("r", 1, at(0), 1), ("r", 3, at(130), 0), ("r", 2, at(120), None), ("r", 4, at(1000), 0), ("r", 5, at(1010), 2), ("s", 1, at(1300), 1), ("s", 2, None, 1), (None, 1, at(1180), 1)]
    schema, build = "run string, arrival_ord long, at timestamp, items long", lambda s: followers.watch_silences(s, ["run"], "60 seconds")
    zero = int(at(0).replace(tzinfo=dt.timezone.utc).timestamp())
    told = {}
    for name, batches in {"one": [rows], "three": [rows[:3], rows[3:5], rows[5:]]}.items():
        found = _run(spark, str(tmp_path / name), batches, schema, build, event_time=True)
        told[name] = sorted((r["run"] or "", r["after"], r["at"] // 1000 - zero, r["retries"], r["state"]) for r in found)
    # a page at the moment of a timer comes before it; attention ends the count, a page without items doesn't start it again
    assert told["one"] == [("r", 3, 250, 1, "retrying"), ("r", 3, 370, 2, "retrying"), ("r", 3, 490, 3, "retrying"), ("r", 3, 610, 4, "attention"), ("r", 5, 1130, 1, "retrying")]
    assert told["three"] == told["one"]


EVENTS = "collection_id long, kind string, external_id long, position long"


def _kept(spark, tmp_path, batches, **bounds):
    folder, own = str(tmp_path), followers.session(spark, False)
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        followers.keep_memberships(own.readStream.schema(EVENTS).parquet(f"{folder}/in"), folder, **bounds).awaitTermination()
    store = Store(spark, f"{folder}/store", followers.SCHEMAS)
    return [sorted((r["collection_id"], r["external_id"], r["position"]) for r in store.read(t).collect()) for t in ("memberships", "waiting")]


def test_no_membership_is_lost_in_state_or_table(spark, tmp_path):
    member = lambda c, i, p=0: (c, "membership", i, p)
    named = lambda c: (c, "collection", None, None)
    batches = [
        [member(1, i, i) for i in range(5)] + [member(2, 7), named(2), member(3, 8), member(3, 9)],
        [named(1), member(1, 9), member(2, 8), member(1, 4, 2)],
        [member(4, 1), named(1)],
    ]
    members, waiting = _kept(spark, tmp_path / "cap", batches, most=2)
    assert members == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 2), (1, 9, 0), (2, 7, 0), (2, 8, 0)] and waiting == []
    # what waits too long goes to the table, where a collection that comes later, or was forgotten by the state, finds it
    members, waiting = _kept(spark, tmp_path / "time", [[member(1, 1), member(10, 2), named(5)], [member(3, 3)], [named(1), named(3)], [member(5, 6)]], hold_ms=1, ttl_ms=1)
    assert members[:2] == [(1, 1, 0), (3, 3, 0)] and waiting == [(10, 2, 0)]


def test_rows_are_read_by_the_first_part_of_their_key(spark, tmp_path):
    rows = spark.createDataFrame([(k, k) for k in ("1/2", "10/1", "1/9", "9/1", "-3/1", "2")], "key string, name string")
    store = Store(spark, str(tmp_path), {"t": "name string"}, 0)
    store.commit(0, {"t": rows})
    keys = spark.createDataFrame([("1",), ("-3",), ("7",)], "key string")
    assert sorted(r["key"] for r in Store(spark, str(tmp_path), {"t": "name string"}).read("t", keys, prefix=True).collect()) == ["-3/1", "1/2", "1/9"]
    assert Store(spark, str(tmp_path), {"t": "name string"}).read("t", keys.filter(F.lit(False)), prefix=True).count() == 0
