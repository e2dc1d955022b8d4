"""Libraries on disk: committed Parquet snapshots, and bundles of JSON for moving a library elsewhere.

A commit writes every table below a folder of its own and then one marker, in one small job; readers take the newest marked version, so
a library is seen whole or not at all. A commit that failed can be run again; one that is marked can't be made again.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT, VERSION = "larder-bundle", 1
ITEM = "external_id long, caption string, author_handle string, hashtags array<string>, views long"
COLLECTION = "collection_id long, name string, declared_total long"
MEMBERSHIP = "external_id long, collection_id long, position int"
ACCOUNT = "platform string, handle string, id string"
#: Seconds after which a step lets go of what others have left: collecting takes a few tenths of one.
RELEASE_S = 10
SCHEMAS = {"items": ITEM, "collections": COLLECTION, "memberships": MEMBERSHIP, "accounts": ACCOUNT}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or a local one where that is unset and one
    machine does all. The driver's file system deletes it when it closes."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-larder-")
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def dropped(spark: SparkSession, folder: str) -> None:
    """Delete a folder below ``scratch`` that no frame reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_last_released = 0.0


def released(spark: SparkSession, after: float = 0.0) -> None:
    """Let go of what finished steps have left: shuffle files stay on the executors' disks, and the driver's heap as large as plans have made
    it, until its garbage is collected. Not more often than ``after`` seconds, unless the heap has grown to half of its limit."""
    global _last_released
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if time.time() - _last_released >= after or 2 * runtime.totalMemory() >= runtime.maxMemory():
        gc.collect()
        runtime.gc()
        _last_released = time.time()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch folder and read again: later steps start from the files and compute nothing twice."""
    folder = f"{scratch(df.sparkSession, name)}/table"
    df.write.option("compression", "zstd").parquet(folder)
    released(df.sparkSession, RELEASE_S)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@dataclass
class Library:
    """The tables of one library."""

    items: DataFrame
    collections: DataFrame
    memberships: DataFrame
    accounts: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}


def empty(spark: SparkSession) -> Library:
    return Library(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})


def commit(library: Library, folder: str, number: int) -> None:
    """Make ``library`` version ``number``; it may be derived from earlier versions, not from this one. A committed number is
    refused: its files are what readers read."""
    if number in committed(library.items.sparkSession, folder):
        raise ValueError(f"version {number} is committed")
    for name, table in library.tables().items():
        table.selectExpr(*[c.split()[0] for c in SCHEMAS[name].split(", ")]).write.mode("overwrite").parquet(f"{folder}/v{number}/{name}")
    spark = library.items.sparkSession
    spark.range(number, number + 1).select(F.col("id").alias("version")).write.mode("append").parquet(f"{folder}/committed")


def committed(spark: SparkSession, folder: str) -> set[int]:
    """The committed versions (markers are one row a commit)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/committed")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return set()
    return {r["version"] for r in spark.read.schema("version long").parquet(f"{folder}/committed").distinct().collect()}


def newest(spark: SparkSession, folder: str) -> int:
    return max(committed(spark, folder))


def read(spark: SparkSession, folder: str, version: int | None = None) -> Library:
    at = newest(spark, folder) if version is None else version
    return Library(**{name: spark.read.schema(schema).parquet(f"{folder}/v{at}/{name}") for name, schema in SCHEMAS.items()})


def wipe(spark: SparkSession, folder: str, number: int, keep: dict[str, Column] | None = None) -> None:
    """Commit a library without rows, or with the items, collections and accounts that ``keep`` holds (table to condition; a table
    that isn't named is emptied) and the memberships between them."""
    if keep is None:
        return commit(empty(spark), folder, number)
    old = read(spark, folder)
    items, collections, accounts = (getattr(old, t).filter(keep.get(t, F.lit(False))) for t in ("items", "collections", "accounts"))
    members = old.memberships.join(items.select("external_id"), "external_id", "left_semi").join(collections.select("collection_id"), "collection_id", "left_semi")
    commit(Library(items, collections, members, accounts), folder, number)


def get_item(library: Library, external_id: int) -> DataFrame:
    """One item with its tags in order and its collections by name."""
    named = library.memberships.filter(F.col("external_id") == external_id).join(library.collections, "collection_id")
    names = named.groupBy("external_id").agg(F.array_sort(F.collect_list("name")).alias("collections"))
    item = library.items.filter(F.col("external_id") == external_id).withColumn("hashtags", F.array_sort("hashtags"))
    return item.join(names, "external_id", "left").withColumn("collections", F.coalesce("collections", F.expr("array()").cast("array<string>")))


def export_bundle(library: Library, folder: str) -> None:
    """JSON lines of every table below ``folder``, tags in order, with a header row."""
    tables = library.tables() | {"items": library.items.withColumn("hashtags", F.array_sort(F.array_distinct("hashtags")))}
    for name, table in tables.items():
        table.write.json(f"{folder}/{name}")
    spark = library.items.sparkSession
    spark.range(1).select(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version")).write.json(f"{folder}/header")


def import_bundle(spark: SparkSession, folder: str, valid_account: Column) -> Library:
    """The library of a bundle: memberships of unknown items or collections and invalid accounts are left out.

    An unknown format or a newer version is refused before anything else is read."""
    header = spark.read.schema("format string, version int").json(f"{folder}/header").first()
    if header is None or header["format"] != FORMAT:
        raise ValueError("not a bundle of this kind")
    if header["version"] > VERSION:
        raise ValueError(f"bundle of a newer version ({header['version']})")
    t = {name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in SCHEMAS.items()}
    known = t["memberships"].join(t["items"].select("external_id"), "external_id", "left_semi").join(t["collections"].select("collection_id"), "collection_id", "left_semi")
    return Library(t["items"], t["collections"], known.dropDuplicates(["external_id", "collection_id"]).select(t["memberships"].columns), t["accounts"].filter(valid_account))
