"""An index that grows by segments: each batch of changed documents adds one, and older ones stay as they are.

A segment holds the postings of its documents, the ids that it replaces in older segments (its own documents and those that are gone), and
what it changes in the statistics of terms: added by its documents, taken away by what it replaces. An open index is the union of all
segments without what newer ones replace; statistics are sums. Segments of about one size are merged into one of the next when there are
``FANOUT``, so a document is written again a few times in all. A manifest, written last, names the live segments.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import stemmed_words
from larder.operators import index
from larder.operators.index import Index

#: Segments of one size that are merged, and places (words of documents) that a segment of the lowest size holds at most.
FANOUT, SMALL_PLACES = 4, 100_000
_MANIFEST = "segment string, number long, places long"
_TABLES = {"postings": "term string, id long, field string, pos int", "documents": "id long, n_tokens long", "replaced": "id long", "terms": "term string, n_docs long, n_places long"}


@dataclass(frozen=True)
class Segment:
    segment: str
    number: int
    places: int

    @property
    def size(self) -> int:
        return max(0, math.ceil(math.log(max(self.places, 1) / SMALL_PLACES, FANOUT)))


class Segments:
    """The index below ``folder``; ``fields`` names the text column of each field, ``words`` analyses texts."""

    def __init__(self, spark: SparkSession, folder: str, fields: dict[str, str], words: Callable[[Column], Column] = stemmed_words):
        self.spark, self.folder, self.fields, self.words = spark, folder, fields, words

    def live(self) -> list[Segment]:
        """Segments of the newest manifest, oldest first."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        numbers = [int(s.getPath().getName().partition("=")[2]) for s in files.listStatus(path) if files.exists(done(f"{s.getPath()}/_SUCCESS"))]
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/commits/number={max(numbers)}").collect() if numbers else []
        return sorted((Segment(r["segment"], r["number"], r["places"]) for r in rows), key=lambda s: s.number)

    def _table(self, name: str, segment: Segment) -> DataFrame:
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.folder}/{segment.segment}/{name}")

    def _current(self, name: str, segments: list[Segment]) -> DataFrame:
        """Rows with an id, without those that newer segments replace."""
        out = self.spark.createDataFrame([], _TABLES[name])
        for i, s in enumerate(segments):
            rows = self._table(name, s)
            if newer := segments[i + 1 :]:
                gone = self._table("replaced", newer[0])
                for n in newer[1:]:
                    gone = gone.unionByName(self._table("replaced", n))
                rows = rows.join(gone.distinct(), "id", "left_anti").select(rows.columns)
            out = out.unionByName(rows)
        return out

    def _terms(self, segments: list[Segment]) -> DataFrame:
        out = self.spark.createDataFrame([], _TABLES["terms"])
        for s in segments:
            out = out.unionByName(self._table("terms", s))
        return out.groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_places").alias("n_places"))

    def index(self) -> Index:
        """The index as it is now; every search reads it like one that was built at once."""
        segments = self.live()
        return Index(self._current("postings", segments), self._current("documents", segments), self._terms(segments).filter("n_docs > 0"), self.words)

    def _write(self, name: str, postings: DataFrame, documents: DataFrame, replaced: DataFrame, terms: DataFrame) -> int:
        at, parts = f"{self.folder}/{name}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        postings.repartitionByRange(parts, "term", "id").sortWithinPartitions("term", "id", "field", "pos").write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/postings")
        documents.write.mode("overwrite").parquet(f"{at}/documents")
        replaced.write.mode("overwrite").parquet(f"{at}/replaced")
        terms.write.mode("overwrite").parquet(f"{at}/terms")
        return self.spark.read.parquet(f"{at}/documents").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]

    def update(self, number: int, docs: DataFrame, gone: DataFrame | None = None, key: str = "external_id") -> None:
        """Index ``docs`` (key and text columns), which replace those of the same ids, and forget ``gone`` (key). ``number`` rises from batch
        to batch; one that failed can be run again."""
        segments = [s for s in self.live() if s.number < number]
        name = f"segment-{number}"
        made = index.postings(docs, self.fields, key, self.words)
        made.write.mode("overwrite").parquet(f"{self.folder}/{name}/unsorted")
        made = self.spark.read.schema(_TABLES["postings"]).parquet(f"{self.folder}/{name}/unsorted")
        ids = docs.select(F.col(key).cast("long").alias("id"))
        ids = (ids if gone is None else ids.unionByName(gone.select(F.col(key).cast("long").alias("id")))).distinct()
        old = index.term_stats(self._current("postings", segments).join(ids, "id", "left_semi"))
        changed = index.term_stats(made).unionByName(old.select("term", (-F.col("n_docs")).alias("n_docs"), (-F.col("n_places")).alias("n_places")))
        changed = changed.groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_places").alias("n_places")).filter("n_docs <> 0 OR n_places <> 0")
        places = self._write(name, made, index.document_stats(made), ids, changed)
        self._commit(number, self._merged([*segments, Segment(name, number, places)], number))

    def _merged(self, segments: list[Segment], number: int) -> list[Segment]:
        while True:
            tail: list[Segment] = []
            for s in reversed(segments):
                if tail and s.size > max(x.size for x in tail):
                    break
                tail.insert(0, s)
            if len(tail) < FANOUT:
                return segments
            replaced = self._table("replaced", tail[0])
            for s in tail[1:]:
                replaced = replaced.unionByName(self._table("replaced", s))
            replaced = replaced.distinct() if len(tail) < len(segments) else replaced.limit(0)  # nothing older is left to replace
            name = f"merged-{number}-{tail[0].number}"
            places = self._write(name, self._current("postings", tail), self._current("documents", tail), replaced, self._terms(tail).filter("n_docs <> 0 OR n_places <> 0"))
            segments = [*segments[: -len(tail)], Segment(name, tail[-1].number, places)]

    def _commit(self, number: int, segments: list[Segment]) -> None:
        rows = [(s.segment, s.number, s.places) for s in segments]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/number={number}")
