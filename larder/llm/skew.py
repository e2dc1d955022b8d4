"""Joins with a table of unique keys, where one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.workspace import partitions_for

#: Parts that the rows of a frequent key are dealt to.
SALTS = 64
#: A key is frequent if its rows come to more than a shuffle partition's share over this.
SHARE = 8


def frequent_keys(rows: DataFrame, key: str, n_rows: int) -> DataFrame:
    """Keys that hold more than 1 / (SHARE x partitions) of all ``n_rows`` rows: so many at most, however long the table."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter((F.col("_n") > 1) & (F.col("_n") * (SHARE * partitions_for(rows.sparkSession)) > n_rows)).select(key)


def lookup(rows: DataFrame, unique: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` (a written table) joined with ``unique`` by ``key``. Rows of frequent keys are dealt to salts by ``spread``,
    and the one row that such a key has in ``unique`` goes to each salt."""
    hot = F.broadcast(frequent_keys(rows, key, rows.count()).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = unique.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")
