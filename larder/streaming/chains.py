"""Paged lists as they arrive: chains of pages, early stops, stalls, running totals (batch forms).

Arrival order within a list comes from an explicit ordinal. Each list is one window partition; its pages are
bounded by the page cap of a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_order(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def page_segments(pages: DataFrame, by: list[str], order: list[str], is_start: Column) -> DataFrame:
    """Pages with ``segment``: how many starts there have been in their list."""
    upto = _in_order(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("segment", F.sum(is_start.cast("int")).over(upto))


def chain_gaps(segments: DataFrame, by: list[str], order: list[str], is_start: Column, request: str, response: str) -> DataFrame:
    """Each segment with ``pages`` and ``gap``: a page that isn't the start must ask for what the page before answered."""
    before = F.lag(response).over(_in_order(by, order))
    broken = ~is_start & ~F.col(request).eqNullSafe(before)
    marked = segments.withColumn("_broken", broken | ((F.col("segment") == 0) & F.lit(True)))
    return marked.groupBy(*by, "segment").agg(F.count(F.lit(1)).alias("pages"), F.max("_broken").alias("gap"))


def stop_after_known(pages: DataFrame, by: list[str], order: list[str], items: str, inserted: str, ended: Column, streak: int = 2) -> DataFrame:
    """by and the first page at which ``streak`` pages in a row, or more, had items but none new. A page that ends its list
    (``ended``) stops nothing: the list is complete then."""
    w = _in_order(by, order).rowsBetween(Window.unboundedPreceding, 0)
    resets = (F.col(inserted) > 0) | (F.col(items) == 0)
    islands = pages.withColumn("_island", F.sum(resets.cast("int")).over(w)).withColumn("_known", (~resets).cast("int")).withColumn("_ended", F.coalesce(ended, F.lit(False)))
    inside = Window.partitionBy(*by, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    reached = islands.withColumn("_streak", F.sum("_known").over(inside)).filter((F.col("_streak") >= streak) & ~F.col("_ended"))
    return reached.groupBy(*by).agg(F.min(order[-1]).alias("stop_at"))


def stalls(pages: DataFrame, by: list[str], order: list[str], at: str, limit_ms: int, items: str | None = None, most_retries: int = 3) -> DataFrame:
    """Pages after which nothing came for more than ``limit_ms``, with ``gap_ms``.

    With ``items``, ``retries`` tells how often the list has been loaded anew by then (once for each full ``limit_ms`` of
    silence, from 0 after a page with items), and ``state`` is attention once that is more than ``most_retries``."""
    gap = F.lead(at).over(_in_order(by, order)) - F.col(at)
    rows = pages.withColumn("gap_ms", gap)
    if items:
        w = _in_order(by, order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_island", F.count_if(F.col(items) > 0).over(w)).withColumn("_ticks", F.coalesce(F.floor(F.col("gap_ms") / limit_ms), F.lit(0)))
        inside = Window.partitionBy(*by, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("retries", F.sum("_ticks").over(inside)).withColumn("state", F.when(F.col("retries") > most_retries, "attention").otherwise("retrying")).drop("_island", "_ticks")
    return rows.filter(F.col("gap_ms") > limit_ms)


def running_totals(pages: DataFrame, by: list[str], order: list[str], sums: list[str]) -> DataFrame:
    w = _in_order(by, order).rowsBetween(Window.unboundedPreceding, 0)
    out = pages.withColumn("pages_so_far", F.count(F.lit(1)).over(w))
    for c in sums:
        out = out.withColumn(f"{c}_so_far", F.sum(c).over(w))
    return out
