"""A saved index is searched without moving its postings."""

import pytest
from pyspark.sql import functions as F

from larder.operators import index, ingest, match
from larder.sources import snapshots


def test_saved_postings_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "external_id long, caption string")
    made = index.postings(docs, {"caption": "caption"})
    spark.sql("DROP TABLE IF EXISTS larder_test_postings")
    saved = index.save_postings(made, "larder_test_postings", 4)
    try:
        assert sorted(map(tuple, saved.collect())) == sorted(map(tuple, made.collect()))
        chips = spark.createDataFrame([(7, 0, "b")], "query_id int, chip int, term string")
        joined = saved.hint("merge").join(chips, "term")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert sorted(r["id"] for r in match.term_hits(chips, saved).collect()) == [1, 2]
    finally:
        spark.sql("DROP TABLE larder_test_postings")


def _library(spark):
    items = spark.createDataFrame([(1, "one", "h", ["b", "a", "b"], 5), (2, None, None, None, None)], snapshots.ITEM)
    collections = spark.createDataFrame([(7, "seven", 2)], snapshots.COLLECTION)
    members = spark.createDataFrame([(1, 7, 0), (1, 8, 0), (9, 7, 1)], snapshots.MEMBERSHIP)
    return snapshots.Library(items, collections, members, spark.createDataFrame([("p", "ok", None), ("p", "not ok", None), ("q", "ok", "x")], snapshots.ACCOUNT))


def _valid():
    return ingest.valid_account(F.col("handle"), F.col("id"))


def test_bundles_drop_what_hangs_loose(spark, tmp_path):
    snapshots.export_bundle(_library(spark), str(tmp_path / "b"))
    back = snapshots.import_bundle(spark, str(tmp_path / "b"), _valid())
    assert [tuple(r) for r in back.memberships.collect()] == [(1, 7, 0)]
    assert [r["hashtags"] for r in back.items.orderBy("external_id").collect()] == [["a", "b"], None]
    assert [tuple(r) for r in back.accounts.collect()] == [("p", "ok", None)]


def test_bundles_of_other_kinds_are_refused(spark, tmp_path):
    for n, header in enumerate([{"format": "other", "version": 1}, {"format": snapshots.FORMAT, "version": 99}]):
        spark.createDataFrame([header]).write.json(str(tmp_path / str(n) / "header"))
        with pytest.raises(ValueError):
            snapshots.import_bundle(spark, str(tmp_path / str(n)), _valid())


def test_a_library_is_replaced_by_its_marker(spark, tmp_path):
    folder = str(tmp_path / "l")
    snapshots.commit(_library(spark), folder, 1)
    _library(spark).items.limit(0).write.parquet(f"{folder}/v2/items")  # a commit that died before its marker
    assert snapshots.newest(spark, folder) == 1 and snapshots.read(spark, folder).items.count() == 2
    snapshots.wipe(spark, folder, 2)
    assert {name: t.count() for name, t in snapshots.read(spark, folder).tables().items()} == dict.fromkeys(snapshots.SCHEMAS, 0)
    one = snapshots.get_item(snapshots.read(spark, folder, 1), 1).first()
    assert (one["hashtags"], one["collections"]) == (["a", "b", "b"], ["seven"])


def test_a_committed_version_is_not_made_again(spark, tmp_path):
    folder = str(tmp_path / "l")
    snapshots.commit(_library(spark), folder, 1)
    with pytest.raises(ValueError):
        snapshots.commit(_library(spark), folder, 1)
    _library(spark).items.limit(0).write.parquet(f"{folder}/v2/items")  # broken off before the marker
    assert snapshots.read(spark, folder).items.count() == 2
    snapshots.commit(_library(spark), folder, 2)
    assert snapshots.committed(spark, folder) == {1, 2}


def test_a_written_index_is_the_same(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Recipes again", "x"), (2, "a recipe", None), (3, None, "recipe recipe")], "external_id long, caption string, tags string")
    fields = {"caption": "caption", "hashtags": "tags"}
    made, plain = index.build(docs, fields, str(tmp_path / "i")), index.in_memory(docs, fields)
    for name in ("postings", "documents", "terms"):
        assert sorted(map(tuple, getattr(made, name).collect())) == sorted(map(tuple, getattr(plain, name).collect()))
    assert {r["term"]: (r["n_docs"], r["n_places"]) for r in index.opened(spark, str(tmp_path / "i")).terms.collect()}["recip"] == (3, 4)


def test_a_search_reads_the_index_and_no_text(spark):
    """Plans of searches scan postings and statistics; nothing is tokenised again."""
    from larder.registered import searches

    folder = "/root/testdata/sf0.001"
    searches.d18_rank(spark, folder).count()
    for name in ("d18_rank", "d14_combine_chips_all", "d13_match_chips"):
        plan = searches.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan
