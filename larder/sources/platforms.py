"""Libraries of several platforms: a commit writes the platforms that it changes and leaves the files of others as they are.

Each version is a folder of tables partitioned by platform, holding only what that commit changed, and a manifest that says for every platform in
which version its rows stand. The manifest is written beside and moved to its name by one rename, so readers see a commit whole or not at all.
(Overwriting partitions in place would show half of a commit, and take files from under readers.) A reader that holds a version open keeps
it from being expired, for as long as its lease lasts. There is one row a platform in a manifest: some dozens, read by the driver.

A platform may be null or empty or hold any character; rows without one are a platform of their own. Repeated rows stay.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEEP, LEASE_MS = 3, 3_600_000
NO_PLATFORM = "none"


def _part(platform: Column) -> Column:
    """The name of a platform's folder; Spark escapes what a path can't hold."""
    return F.coalesce(F.concat(F.lit("p-"), platform), F.lit(NO_PLATFORM))


def _part_of(platform: str | None) -> str:
    return NO_PLATFORM if platform is None else f"p-{platform}"


class Reading:
    """One version, held open until ``close`` (or the end of a ``with``)."""

    def __init__(self, library: Platforms, version: int, lease: str):
        self.library, self.version, self._lease = library, version, lease
        self.stands = library._manifest(version)

    def table(self, name: str) -> DataFrame:
        """All rows of a table, with ``platform``; a filter on ``_part`` or ``platform`` opens no other platform's files where it is on ``_part``."""
        lib, schema = self.library, f"platform string, {self.library.schemas[name]}, _part string"
        out = None
        for version in sorted(set(self.stands.values())):
            parts = [p for p, v in self.stands.items() if v == version]
            one = lib.spark.read.schema(schema).parquet(f"{lib.folder}/v{version}/{name}").filter(F.col("_part").isin(parts))
            out = one if out is None else out.unionByName(one)
        return lib.spark.createDataFrame([], schema) if out is None else out

    def platform(self, name: str, platform: str | None) -> DataFrame:
        """A table's rows of one platform, from its own files only."""
        return self.table(name).filter(F.col("_part") == _part_of(platform)).drop("_part")

    def versions(self) -> DataFrame:
        """_part, version in which the platform was written last."""
        return self.library.spark.createDataFrame(sorted(self.stands.items()), "_part string, version long")

    def close(self) -> None:
        files, path = self.library._at(self._lease)
        files.delete(path, False)

    def __enter__(self) -> Reading:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Platforms:
    """Tables below ``folder`` by ``schemas`` (table to schema, without the platform)."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str]):
        self.spark, self.folder, self.schemas = spark, folder, schemas

    def _at(self, path: str) -> tuple:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        files, at = self._at(path)
        return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []

    def _put(self, path: str, text: str) -> None:
        """A small file that is there whole or not at all; an existing one is refused."""
        files, at = self._at(f"{self.folder}/_new/{uuid.uuid4().hex}")
        out = files.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()
        _, to = self._at(path)
        files.mkdirs(to.getParent())
        if files.exists(to) or not files.rename(at, to):
            files.delete(at, False)
            raise ValueError(f"{path} is committed")

    def _manifest(self, version: int) -> dict[str, int]:
        if not version:
            return {}
        rows = self.spark.read.text(f"{self.folder}/manifests/{version:012d}", wholetext=True).collect()
        return json.loads(rows[0]["value"])

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.folder}/manifests") if n.isdigit())

    def replace(self, tables: dict[str, DataFrame], platforms: list[str | None] | None = None, number: int | None = None) -> int:
        """Commit the rows of ``platforms`` (of all that ``tables`` hold or the library has, if not told) as the next version, or version ``number``; rows of other
        platforms are refused. A platform that is named and has no rows goes; a table that isn't given has none of it. Of two commits of one number the
        later is refused. ``tables`` may be read from this library."""
        last = (self.versions() or [0])[-1]
        number = last + 1 if number is None else number
        if number <= last:
            raise ValueError(f"version {number} is committed")
        stands = self._manifest(last)
        given: set[str] = set()
        allowed = None if platforms is None else {_part_of(p) for p in platforms}
        for name, schema in self.schemas.items():
            columns = [c.split()[0].rstrip(":") for c in schema.split(", ")]
            rows = tables.get(name, self.spark.createDataFrame([], f"platform string, {schema}")).select("platform", *columns, _part(F.col("platform")).alias("_part"))
            # a platform's rows go to as many files as they fill: no shuffle brings a large platform to one task
            path = f"{self.folder}/v{number}/{name}"
            rows.write.mode("overwrite").option("compression", "zstd").partitionBy("_part").parquet(path)
            held = self.spark.read.schema(f"platform string, {schema}, _part string").parquet(path).select("_part").distinct()
            given |= {r["_part"] for r in held.collect()}
        if allowed is not None and given - allowed:
            raise ValueError(f"rows of platforms that aren't named: {sorted(given - allowed)[:5]}")
        left = {} if allowed is None else {p: v for p, v in stands.items() if p not in allowed}
        self._put(f"{self.folder}/manifests/{number:012d}", json.dumps(left | dict.fromkeys(sorted(given), number)))
        return number

    def open(self, version: int | None = None, lease_ms: int = LEASE_MS) -> Reading:
        """The newest version, or one of those kept."""
        version = (self.versions() or [0])[-1] if version is None else version
        lease = f"{self.folder}/leases/{version}-{int(time.time() * 1000) + lease_ms}-{uuid.uuid4().hex}"
        self._put(lease, "")
        if version and version not in self.versions():
            raise ValueError(f"version {version} isn't kept")
        return Reading(self, version, lease)

    def expire(self, keep: int = KEEP) -> list[int]:
        """Delete manifests beyond the newest ``keep`` that no reader holds, and versions that none of those left names. Folders of a commit that failed or
        is under way are newer than all manifests and stay. Gives the deleted versions."""
        versions, now = self.versions(), time.time() * 1000
        leases = [n.split("-") for n in self._names(f"{self.folder}/leases")]
        held = {int(v) for v, until, _ in leases if int(until) >= now}
        kept = set(versions[-keep:]) | (held & set(versions))
        named = {v for version in kept for v in self._manifest(version).values()}
        for version in set(versions) - kept:
            files, at = self._at(f"{self.folder}/manifests/{version:012d}")
            files.delete(at, False)
        gone = [v for v in (int(n[1:]) for n in self._names(self.folder) if n[:1] == "v" and n[1:].isdigit()) if v not in named and v < max(versions, default=0) and v not in kept]
        for version in gone:
            files, at = self._at(f"{self.folder}/v{version}")
            files.delete(at, True)
        return sorted(gone)
