"""Exact duplicates of whole normalised texts by a distributed content sort.

Sampled splitters range-partition the texts by the first characters of their normalised content, and by its digest where
many texts begin alike. Each partition is sorted by the whole content, which places equals side by side, and neighbours
are compared in full. Texts that very many rows hold are found first, by counts of digests, and dealt to ``SALTS`` parts,
each sorted for itself; what a part retains is then sorted and compared in full with what the other parts retain. All
other texts are settled within one sort.

Normalised: without space and the characters 9 to 13. A null text counts as empty. Of equal texts the row with the most
code points in the original text stays, then the smallest ``doc_id`` (nulls last). Repeated rows are told apart by their
place in the sort, so exactly one of them stays. Very long texts are compared to their end. Empty tables give empty
results; columns of any name pass through ``drop_duplicates`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.workspace import Workspace, partitions_for

#: The characters that are deleted.
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Characters of a normalised text that splitters are sampled from.
HEAD = 64
#: Parts that the rows of one frequent text are dealt to.
SALTS = 64
#: A text is dealt to parts if its rows come to more than a shuffle partition's share over this.
SHARE = 8


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _frequent(digests: DataFrame, space: Workspace) -> DataFrame:
    """Digests of the texts that are to be dealt: SHARE times the number of shuffle partitions at most."""
    counts = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counts = space.write(counts, "counts")
    n_rows = digests.count()
    return counts.filter(F.col("n") * (SHARE * partitions_for(space.spark)) > n_rows).select("digest")


def _ranked(docs: DataFrame, space: Workspace, whole: bool) -> DataFrame:
    """Every row with the digest of its content, its rank among equals, their number, and who stays of them.

    With ``whole`` the rows themselves go along as ``row``, and only the first of equals come out."""
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256))
    frequent = _frequent(space.write(docs.select(digest.alias("digest")), "digests"), space)
    content = normalised(F.col("text"))
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if whole else content.alias("content")
    rows = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("points"), carried, F.substring(content, 1, HEAD).alias("head"), digest.alias("digest"))
    # frequent texts are few; rows of one are told apart by id and input partition
    rows = rows.withColumn("part", F.spark_partition_id()).join(F.broadcast(frequent.withColumn("dealt", F.lit(True))), "digest", "left")
    salt = F.when(F.col("dealt"), F.pmod(F.xxhash64("doc_id", "part"), F.lit(SALTS))).otherwise(-1).cast("int")
    dealt = rows.withColumn("salt", salt).drop("part", "dealt").repartitionByRange(partitions_for(docs.sparkSession), "head", "digest", "salt")
    if whole:
        dealt = dealt.withColumn("content", normalised(F.col("row.text")))
    same = Window.partitionBy("head", "digest", "salt", "content")
    order = same.orderBy(F.desc("points"), F.asc_nulls_last("doc_id"))
    ranked = dealt.withColumn("nth", F.row_number().over(order)).withColumn("size", F.count(F.lit(1)).over(same)).withColumn("keep_id", F.first("doc_id").over(order))
    # only the retained rows of dealt texts need their content again
    content = F.when((F.col("nth") == 1) & (F.col("salt") >= 0), F.col("content"))
    out = ranked.select("doc_id", "points", "digest", "salt", "nth", "size", "keep_id", content.alias("content"), "row" if whole else F.lit(None).cast("boolean").alias("row"))
    ranked = space.write(out.filter("nth = 1") if whole else out, "ranked")
    space.drop("digests")
    space.drop("counts")
    return ranked


def _settled(docs: DataFrame, space: Workspace, whole: bool) -> DataFrame:
    """row, doc_id, keep_id, group_size, kept, digest of what ``_ranked`` gives."""
    ranked = _ranked(docs, space, whole)
    within = ranked.filter("salt < 0").select("row", "doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("nth") == 1).alias("kept"), "digest")
    # the retained rows of the parts of one text: SALTS at most, compared by their whole content
    retained = ranked.filter("salt >= 0 AND nth = 1").select("doc_id", "points", "digest", "salt", "size", "content")
    equal = Window.partitionBy("digest", "content")
    first = F.min(F.struct((-F.col("points")).alias("fewer"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "salt")).over(equal)
    parts = retained.select("digest", "salt", first.alias("first"), F.sum("size").over(equal).alias("group_size"))
    parts = parts.select("digest", "salt", F.col("first.doc_id").alias("first_id"), (F.col("first.salt") == F.col("salt")).alias("wins"), "group_size")
    across = ranked.filter("salt >= 0").select("row", "doc_id", "digest", "salt", "nth").join(parts, ["digest", "salt"])
    across = across.select("row", "doc_id", F.col("first_id").alias("keep_id"), "group_size", ((F.col("nth") == 1) & F.col("wins")).alias("kept"), "digest")
    return within.unionByName(across)


def find_duplicates(docs: DataFrame, space: Workspace) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text)."""
    found = _settled(docs.select("doc_id", "text"), space, whole=False)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, space: Workspace) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return _settled(docs, space, whole=True).filter("kept").select("row.*")
