"""An index that grows by segments is the one that is built at once over the new state."""

from pathlib import Path

from pyspark.sql import functions as F

from larder.functions.text import folded_words
from larder.operators import index, segments
from larder.operators.segments import FANOUT, Segments


def _same(one, other):
    for name in ("postings", "documents", "terms"):
        columns = sorted(getattr(one, name).columns)
        assert sorted(map(tuple, getattr(one, name).select(columns).collect())) == sorted(map(tuple, getattr(other, name).select(columns).collect()))


def test_updates_equal_a_new_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SMALL_PLACES", 12)
    fields = {"caption": "caption", "hashtags": "tags"}
    docs = lambda rows: spark.createDataFrame(rows, "external_id long, caption string, tags string")
    grown, state = Segments(spark, str(tmp_path / "s"), fields, folded_words), {}
    batches = [
        ([(i, f"red ring {i}", "gold red") for i in range(12)], []),
        ([(3, "blue box", "gold"), (20, "red", None)], [5]),
        ([(5, "back again", "x x")], [20, 999]),
        ([(3, None, None)], []),
        ([(21, "red red", "z")], [0]),
        ([(22, "ring", "z")], []),
    ]
    touched = 0
    for n, (rows, gone) in enumerate(batches):
        before = {str(p): p.stat().st_mtime_ns for p in Path(tmp_path / "s").rglob("*.parquet")}
        for _ in range(2 if n == 2 else 1):  # a batch may be run again
            grown.update(n, docs(rows), spark.createDataFrame([(g,) for g in gone], "external_id long") if gone else None)
        state = {k: v for k, v in state.items() if k not in gone} | {r[0]: r for r in rows}
        _same(grown.index(), index.in_memory(docs(list(state.values())), fields, words=folded_words))
        live = grown.live()
        assert len(live) < FANOUT + 2
        if n < FANOUT - 1:
            assert all(p.stat().st_mtime_ns == before[str(p)] for p in Path(tmp_path / "s" / "segment-0").rglob("*.parquet") if str(p) in before)
            touched += 1
    assert touched and any(s.segment.startswith("merged") for s in grown.live())


def test_nothing_and_then_something(spark, tmp_path):
    grown = Segments(spark, str(tmp_path / "s"), {"caption": "caption"}, folded_words)
    assert grown.index().postings.count() == 0
    grown.update(0, spark.createDataFrame([], "external_id long, caption string"), spark.createDataFrame([(1,)], "external_id long"))
    grown.update(1, spark.createDataFrame([(1, "a a b"), (2, None)], "external_id long, caption string"))
    assert sorted(map(tuple, grown.index().terms.select("term", "n_docs", "n_places").collect())) == [("a", 1, 2), ("b", 1, 1)]
    assert [r["n_tokens"] for r in grown.index().documents.filter(F.col("id") == 1).collect()] == [3]
