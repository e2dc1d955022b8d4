"""Libraries of several platforms: what a commit writes, what readers see, what is expired."""

from pathlib import Path

import pytest

from larder.sources.platforms import Platforms

SCHEMAS = {"items": "id long, caption string", "members": "id long, position int"}


def _files(folder):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(folder).rglob("*.parquet")}


def _held(reading):
    return sorted((r["platform"] if r["platform"] is not None else "-", r["id"], r["caption"]) for r in reading.table("items").collect())


def test_a_commit_leaves_other_platforms_and_open_readers_alone(spark, tmp_path):
    held = Platforms(spark, str(tmp_path / "lib"), SCHEMAS)
    assert held.open().table("items").count() == 0 and held.expire() == []
    rows = lambda *r: spark.createDataFrame(list(r), "platform string, id long, caption string, extra int")
    held.replace({"items": rows(("a/b=c", 1, "x", 0), ("a/b=c", 1, "x", 0), ("", 2, None, 0), (None, 3, "n", 0), ("q", 4, "q", 0))})
    first, before = held.open(), _files(tmp_path / "lib")
    assert _held(first) == [("", 2, None), ("-", 3, "n"), ("a/b=c", 1, "x"), ("a/b=c", 1, "x"), ("q", 4, "q")]
    held.replace({"items": rows(("q", 5, "new", 0))}, ["q", None])  # of rows without a platform nothing is left
    after = _files(tmp_path / "lib")
    assert all(after[p] == v for p, v in before.items()) and all("/v2/" in p for p in set(after) - set(before))
    assert _held(held.open()) == [("", 2, None), ("a/b=c", 1, "x"), ("a/b=c", 1, "x"), ("q", 5, "new")] and len(_held(first)) == 5
    assert [r["id"] for r in held.open().platform("items", "q").collect()] == [5] and held.open().platform("items", None).count() == 0
    with pytest.raises(ValueError, match="aren't named"):
        held.replace({"items": rows(("z", 1, "z", 0))}, ["q"])
    with pytest.raises(ValueError, match="committed"):
        held.replace({}, ["q"], number=2)
    assert held.versions() == [1, 2]


def test_versions_are_expired_unless_held_open(spark, tmp_path):
    held = Platforms(spark, str(tmp_path / "lib"), SCHEMAS)
    rows = lambda n: spark.createDataFrame([("p", n, "x"), *([("old", 0, "y")] if n == 1 else [])], "platform string, id long, caption string")
    held.replace({"items": rows(1)})
    readers = {}
    for n in range(2, 7):
        held.replace({"items": rows(n)}, ["p"])
        if n == 3:
            readers[n] = held.open()
    assert held.expire(keep=2) == [2, 4] and held.versions() == [3, 5, 6]  # 1 holds another platform's rows, 3 is read
    assert _held(readers[3]) == [("old", 0, "y"), ("p", 3, "x")]
    readers[3].close()
    assert held.expire(keep=2) == [3] and _held(held.open()) == [("old", 0, "y"), ("p", 6, "x")]
    with pytest.raises(ValueError, match="kept"):
        held.open(3)
    held.open(5, lease_ms=-1)
    assert held.expire(keep=1) == [5] and held.versions() == [6]
