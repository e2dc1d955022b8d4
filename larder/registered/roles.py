"""What the registered searches ask and search, made of the given tables: indexes are built once in an application and read by all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.text import folded_words
from larder.operators import bitmaps, impacts, index, ingest, match, terms
from larder.plans.search import Library
from larder.sources import tables
from larder.sources.snapshots import scratch, stored


def documents(spark: SparkSession, d: str) -> index.Index:
    """Captions and authors of ``documents``."""
    make = lambda: index.build(tables.items(spark, d), {"caption": "caption", "author": "author_handle"}, scratch(spark, "index"), words=folded_words)
    return tables.once(spark, d, "documents-index", make)


def document_words(spark: SparkSession, d: str, column: str = "views") -> bitmaps.Words:
    """Bitmaps of that index; documents lie in the order of a column: ``views`` (their number of characters), ``newest`` or ``saved``."""
    def make() -> bitmaps.Words:
        order = {"views": F.col("views"), "newest": F.length("language"), "saved": F.col("external_id")}[column]
        saved = tables.items(spark, d).select(F.col("external_id").alias("id"), order.cast("long").alias("saved_at"))
        return bitmaps.build(documents(spark, d), saved, scratch(spark, "document-words"))

    return tables.once(spark, d, f"document-words-{column}", make)


def document_impacts(spark: SparkSession, d: str) -> impacts.Impacts:
    """Bitmaps and impact blocks of that index."""
    return tables.once(spark, d, "document-impacts", lambda: impacts.build(document_words(spark, d), scratch(spark, "document-impacts")))


def chips(spark: SparkSession, d: str) -> DataFrame:
    """query_id, chip, term: the words of the whole ``benchmark`` texts, a query for each 20 of a text (the most that one may have)."""
    return match.query_chips(tables.read(spark, d, "benchmark"), "item_id", "text", folded_words)


def chip_terms(spark: SparkSession, d: str) -> DataFrame:
    """Those chips as term rows of one exact word each."""
    return chips(spark, d).select("query_id", "chip", F.lit(0).alias("grp"), F.lit("exact").alias("kind"), "term", F.lit(0).alias("part"), F.lit(1).alias("parts"))


def lexicon(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Categories are the last words of part names, their terms the types that parts of the name have; brands are aliases."""
    words = tables.read(spark, d, "part").select(F.lower("p_brand").alias("brand"), F.element_at(F.split(F.lower("p_name"), " "), -1).alias("category"), F.lower("p_type").alias("term"))
    categories = words.select("category", "term").distinct().withColumn("ord", F.row_number().over(Window.partitionBy("category").orderBy("term")))
    return categories.select("category", "ord", "term"), words.groupBy(F.col("brand").alias("alias")).agg(F.min("category").alias("category"))


def sold(spark: SparkSession, d: str) -> Library:
    """Order lines as a library: names as captions, types as tags, suppliers as collections."""
    def make() -> Library:
        items = stored(tables.sold_items(spark, d), "sold")
        texts = items.withColumn("tags", F.array_join("hashtags", " "))
        idx = index.build(texts, {"caption": "caption", "hashtags": "tags"}, scratch(spark, "index"), words=folded_words)
        suppliers = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("collection_id"), F.col("s_name").alias("text"))
        names = stored(items.join(suppliers, "collection_id").select(F.col("external_id").alias("id"), F.col("collection_id").alias("key"), "text"), "names")
        return Library(idx, items, names, texts.select("external_id", "caption", "author_handle", "tags"), *lexicon(spark, d), link=lambda: ingest.canonical_url("https://example.com", F.col("author_handle"), F.lit(None), F.col("external_id").cast("string")))

    return tables.once(spark, d, "sold", make)


def asked(spark: SparkSession, d: str) -> DataFrame:
    """query_id, ord, text, expand: for each size, the words of its first part's name as chips, and the name without its second
    letter, which no item holds."""
    named = tables.read(spark, d, "part").groupBy(F.col("p_size").alias("query_id")).agg(F.min_by("p_name", "p_partkey").alias("name"))
    return named.select("query_id", F.posexplode(F.split("name", " ")).alias("ord", "text"), F.lit(True).alias("expand"))


def mistyped(spark: SparkSession, d: str) -> DataFrame:
    """As ``asked``, with words that lack their second letter."""
    return asked(spark, d).withColumn("text", F.concat(F.left("text", F.lit(1)), F.substring("text", 3, 64)))


def short_texts(spark: SparkSession, d: str) -> DataFrame:
    """external_id and the five texts of parts in which substrings are looked for."""
    names = tables.memberships(spark, d).join(tables.collections(spark, d), "collection_id").select("external_id", "name")
    return ingest.search_docs(tables.short_items(spark, d), names, "external_id", ("author_handle",))


def related_chips(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chips (query_id, chip, text) and related terms (query_id, chip, ord, term) out of whole ``benchmark`` texts: the first word
    and the last two are chips; the longest word, and the two words in the middle as a phrase, are related to the first."""
    w = folded_words(F.col("text"))
    rows = tables.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), w.alias("w")).filter(F.size("w") >= 4)
    longest = F.array_sort(F.transform("w", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))[0]["x"]
    middle = F.floor(F.size("w") / 2).cast("int")
    chips = rows.select("query_id", F.posexplode(F.array(F.col("w")[0], F.array_join(F.slice("w", -2, 2), " "))).alias("chip", "text"))
    return chips, rows.select("query_id", F.lit(0).alias("chip"), F.posexplode(F.array(longest, F.array_join(F.slice("w", middle, 2), " "))).alias("ord", "term"))


def related_terms(spark: SparkSession, d: str) -> DataFrame:
    own, related = related_chips(spark, d)
    return terms.own_terms(own, folded_words).unionByName(terms.related_terms(related, folded_words))
