"""The inverted index: postings, document and term statistics, built once and read by every search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.text import stemmed_words
from larder.sources.snapshots import dropped, released

#: Weights of the fields in a document's score.
FIELD_WEIGHTS = {"caption": 2.0, "hashtags": 4.0, "author": 1.5, "sound": 1.0, "collections": 0.5}

#: Places that a task sorts or counts, about: with more places there are more tasks, not larger ones.
TASK_PLACES = 1 << 20


@dataclass
class Index:
    """postings: term, id, field, pos; documents: id, n_tokens; terms: term, n_docs, n_places.

    ``words`` is the analysis of texts that the index was built with; queries go through the same. ``pairs`` (term, id, f: weighted number of
    places) is there if the index was written, as read from its postings without a shuffle."""

    postings: DataFrame
    documents: DataFrame
    terms: DataFrame
    words: Callable[[Column], Column] = stemmed_words
    pairs: DataFrame | None = None

    def weighed(self) -> DataFrame:
        """term, id, f of every word and document."""
        return self.pairs if self.pairs is not None else self.postings.groupBy("term", "id").agg(F.sum(weight_of(F.col("field"))).alias("f"))


def weight_of(field: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in FIELD_WEIGHTS.items() for x in kv])[field], F.lit(1.0))


def postings(docs: DataFrame, fields: dict[str, str], id_column: str = "external_id", words: Callable[[Column], Column] = stemmed_words) -> DataFrame:
    """term, id, field, pos of every word. ``fields``: field name to text column. Each document is read once."""
    parsed = docs.select(F.col(id_column).alias("id"), *[words(F.col(column)).alias(field) for field, column in fields.items()])
    rows = None
    for field in fields:
        one = parsed.select("id", F.lit(field).alias("field"), F.posexplode(F.col(field)).alias("pos", "term"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("term", "id", "field", "pos")


def document_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("id").agg(F.count(F.lit(1)).alias("n_tokens"))


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count_distinct("id").alias("n_docs"), F.count(F.lit(1)).alias("n_places"))


def in_memory(docs: DataFrame, fields: dict[str, str], id_column: str = "external_id", words: Callable[[Column], Column] = stemmed_words) -> Index:
    """An index that isn't written: for a handful of documents."""
    post = postings(docs, fields, id_column, words)
    return Index(post, document_stats(post), term_stats(post), words)


def build(docs: DataFrame, fields: dict[str, str], folder: str, id_column: str = "external_id", words: Callable[[Column], Column] = stemmed_words) -> Index:
    """Write the index of ``docs`` below ``folder`` and open it.

    Texts are analysed once. Postings lie in ranges of (term, id), sorted, so that scans for terms skip most files and
    groups, and a word that most documents hold is spread over several files. A word's first place in a document is marked as it is
    sorted, and documents are counted before, where their words lie together: statistics shuffle a row for each word or document of a task."""
    spark = docs.sparkSession
    post = postings(docs, fields, id_column, words)
    post.write.option("compression", "zstd").parquet(f"{folder}/unsorted")
    read = spark.read.schema(post.schema).parquet(f"{folder}/unsorted")
    document_stats(read).write.parquet(f"{folder}/documents")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read.count() // TASK_PLACES))
    # the ranges hold a word and document together: the window asks for no other shuffle
    pair = Window.partitionBy("term", "id").orderBy("field", "pos")
    whole = pair.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = read.repartitionByRange(parts, "term", "id").withColumns({"first": F.row_number().over(pair) == 1, "f": F.sum(weight_of(F.col("field"))).over(whole)})
    marked = marked.withColumn("f", F.when(F.col("first"), F.col("f")))
    marked.sortWithinPartitions("term", "id", "field", "pos").write.option("compression", "zstd").parquet(f"{folder}/postings")
    dropped(spark, f"{folder}/unsorted")
    places = spark.read.parquet(f"{folder}/postings")
    places.groupBy("term").agg(F.count_if("first").alias("n_docs"), F.count(F.lit(1)).alias("n_places")).write.parquet(f"{folder}/terms")
    released(spark)
    return opened(spark, folder, words)


def opened(spark: SparkSession, folder: str, words: Callable[[Column], Column] = stemmed_words) -> Index:
    post, *stats = [spark.read.parquet(f"{folder}/{name}") for name in ("postings", "documents", "terms")]
    return Index(post.select("term", "id", "field", "pos"), *stats, words, post.filter("first").select("term", "id", "f"))


def save_postings(post: DataFrame, table: str, buckets: int) -> DataFrame:
    """Write postings as a table bucketed and sorted by term; searches of it shuffle their own terms only.

    Postings of one document field are written from the task that tokenised it, so nothing is gathered by document."""
    post.repartition(buckets, "term").write.bucketBy(buckets, "term").sortBy("term").mode("overwrite").saveAsTable(table)
    return post.sparkSession.table(table)
