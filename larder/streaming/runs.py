"""Reading runs over paged lists: outcomes of lists, streaks of failures, passes, seen ids, and reports of runs.

Batch forms over a table of page events in arrival order, and a stateful stream that decides when a list is complete.
Windows are over one list of one run, whose pages the page cap bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Reads of a list that end with a gap before the list counts as partial.
MOST_RETRIES = 3
PAGE_CAP = 3000


def list_outcomes(segments: DataFrame, by: list[str], ended: str, gap: str = "gap") -> DataFrame:
    """by, outcome: complete if a segment that reached the end has no gap, partial after four gapped ends, else open."""
    ends = F.count_if(F.col(ended) & F.col(gap))
    whole = F.coalesce(F.bool_or(F.col(ended) & ~F.col(gap)), F.lit(False))
    return segments.groupBy(*by).agg(F.when(whole, "complete").when(ends > MOST_RETRIES, "partial").otherwise("open").alias("outcome"))


def pass_modes(runs: DataFrame, complete: DataFrame) -> DataFrame:
    """Runs (platform, run, started_at, asked) with mode: incremental only if a complete pass (platform, at) came before."""
    first = complete.groupBy("platform").agg(F.min("at").alias("_first"))
    known = F.coalesce(F.col("_first") < F.col("started_at"), F.lit(False))
    return runs.join(first, "platform", "left").withColumn("mode", F.when((F.col("asked") == "incremental") & known, "incremental").otherwise("full")).drop("_first")


def seen_ids(pages: DataFrame, by: list[str], ids: str) -> DataFrame:
    """by and external_id: every id that a list gave, once."""
    return pages.select(*by, F.explode(ids).alias("external_id")).distinct()


def failure_streaks(events: DataFrame, by: list[str], order: str, kind: str, limits: dict[str, tuple[int, str]]) -> DataFrame:
    """by, at, state: the first event at which a kind of failure came ``n`` times in a row. ``limits``: kind to (n, state).

    A success (any kind not in ``limits``) ends every streak."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("_island", F.sum((~F.col(kind).isin(*limits)).cast("int")).over(w))
    inside = Window.partitionBy(*by, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    state = F.lit(None).cast("string")
    for name, (n, to) in limits.items():
        count = f"_{name}"
        rows = rows.withColumn(count, F.count_if(F.col(kind) == name).over(inside))
        state = F.coalesce(state, F.when((F.col(kind) == name) & (F.col(count) == n), to))
    hit = rows.withColumn("state", state).filter("state IS NOT NULL")
    return hit.groupBy(*by).agg(F.min(order).alias("at"), F.min_by("state", order).alias("state"))


def attribute_pages(pages: DataFrame, runs: DataFrame, fits: Column) -> DataFrame:
    """Pages that come from their run's own tab (``runs``: run, tab_id) and that ``fits`` its current list."""
    return pages.filter(fits).join(runs.select("run", "tab_id"), ["run", "tab_id"], "left_semi")


def over_cap(totals: DataFrame, by: list[str], order: str, cap: int = PAGE_CAP) -> DataFrame:
    """by, at: the page at which a run has read as many as it may, and fails. ``totals`` holds pages_so_far."""
    return totals.filter(F.col("pages_so_far") == cap).select(*by, F.col(order).alias("at"))


def run_report(outcomes: DataFrame, totals: DataFrame) -> DataFrame:
    """One row a run: lists, done, fraction, phase, and its pages and items. ``outcomes``: run, list, outcome; ``totals``: run, pages, items."""
    n, done, partial = F.count(F.lit(1)), F.count_if(F.col("outcome") != "open"), F.count_if(F.col("outcome") == "partial")
    phase = F.when(done < n, "running").when(partial > 0, "done_with_warnings").otherwise("done")
    rows = outcomes.groupBy("run").agg(n.alias("lists"), done.alias("done"), partial.alias("warnings"), F.round(done / n, 3).alias("fraction"), phase.alias("phase"))
    return rows.join(totals, "run", "left")


def absorb_collections(lists: DataFrame) -> DataFrame:
    """run, id, name, declared_total, first, status of the collections that the lists of runs named (run, arrival, id, name,
    declared_total, has_more): the last name and the last total given, in order of first arrival, each pending; ``warning`` where
    a list of the run says that it has more than it gave."""
    known = lists.filter("id IS NOT NULL").groupBy("run", "id").agg(
        F.max_by("name", "arrival").alias("name"), F.max_by("declared_total", F.when(F.col("declared_total").isNotNull(), F.col("arrival"))).alias("declared_total"), F.min("arrival").alias("first")
    )
    more = lists.groupBy("run").agg(F.coalesce(F.bool_or("has_more"), F.lit(False)).alias("warning"))
    return known.join(more, "run").select("run", "id", "name", "declared_total", "first", F.lit("pending").alias("status"), "warning")


_STATE = "response string, any boolean, gap boolean, gapped_ends int, outcome string, seen_to long"
_OUT = "run string, list string, outcome string, at long"


def _follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One list: each page must ask for what the page before answered; an end without a gap completes the list."""
    response, some, gap, ends, outcome, upto = state.get if state.exists else (None, False, False, 0, "open", -1)
    decided = []
    for page in pd.concat(list(parts)).sort_values("arrival_ord").itertuples(index=False):
        if page.arrival_ord <= upto or outcome != "open":  # delivered again, or decided
            continue
        request = None if pd.isna(page.request) else page.request
        if request is None or request == "0":
            gap = False
        elif not some or request != response:
            gap = True
        response, some, upto = None if pd.isna(page.response) else page.response, True, int(page.arrival_ord)
        if page.has_more is not None and not pd.isna(page.has_more) and not page.has_more:
            ends += gap
            outcome = "complete" if not gap else "partial" if ends > MOST_RETRIES else "open"
            if outcome != "open":
                decided.append((*key, outcome, upto))
    state.update((response, some, gap, int(ends), outcome, upto))
    yield pd.DataFrame(decided, columns=["run", "list", "outcome", "at"])


def follow_lists(pages: DataFrame) -> DataFrame:
    """A stream of pages (run, list, arrival_ord, request, response, has_more) to the outcome of every list, once.

    State is one short row a list. Pages of a list are expected in arrival order from batch to batch; within a batch
    they are put in order."""
    return pages.groupBy("run", "list").applyInPandasWithState(_follow, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


_STALL_STATE = "retries int, upto long"
_STALL_OUT = "run string, state string, retries int"
MOST_SILENCE_MS, MOST_STALL_RETRIES = 120_000, 3


def _watch(limit_ms: int, most: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        retries, upto = state.get if state.exists else (0, -1)
        out = []
        if state.hasTimedOut:
            retries += 1
            out.append((key[0], "attention" if retries > most else "retrying", retries))
        else:
            for page in pd.concat(list(parts)).sort_values("arrival_ord").itertuples(index=False):
                if page.arrival_ord > upto:
                    upto = int(page.arrival_ord)
                    retries = 0 if page.items > 0 else retries
        state.update((int(retries), upto))
        if retries <= most:
            state.setTimeoutDuration(limit_ms)
        yield pd.DataFrame(out, columns=["run", "state", "retries"])

    return run


def watch_stalls(pages: DataFrame, limit_ms: int = MOST_SILENCE_MS, most_retries: int = MOST_STALL_RETRIES) -> DataFrame:
    """A stream of pages (run, arrival_ord, items) to what a timer does about silence: ``retrying`` after each ``limit_ms`` without a
    page, ``attention`` after ``most_retries`` of them; a page with items starts the count again."""
    return pages.groupBy("run").applyInPandasWithState(_watch(limit_ms, most_retries), _STALL_OUT, _STALL_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


_PENDING_STATE = "known array<long>, collections array<long>, ids array<long>, positions array<long>"
#: Memberships held in memory for one collection that isn't known yet. What doesn't fit is given out as overflow, for a table of
#: pending rows: ``changes.split_memberships`` takes them up from there, as ``streaming.ingest`` does for all of its own.
MOST_PENDING = 1000
#: Groups that collections are dealt to by hash: a call to Python for each collection would take far longer than what it does. A group's
#: state is read and written whole when one of its collections comes. A checkpoint keeps the number it was begun with.
BUCKETS = 1024


def bucketed(events: DataFrame) -> DataFrame:
    """``events`` with the ``bucket`` of their collection."""
    # numbers next to nulls are doubles in Python, which don't hold all of them
    whole = {c: F.when(F.col("kind") == "collection", 0).otherwise(F.col(c)) for c in ("external_id", "position")}
    return events.withColumns(whole).withColumn("bucket", F.pmod(F.xxhash64("collection_id"), F.lit(BUCKETS)).cast("int"))


def as_long(x: float | int | None) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


def given(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["collection_id", "external_id", "position", "outcome"], dtype=object)


def _hold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The collections of one bucket: memberships wait until their collection itself has come."""
    known, out = set(), []
    waiting: dict[int | None, list[tuple[int | None, int | None]]] = {}
    if state.exists:
        held = state.get
        known = set(held[0])
        for collection, *member in zip(*held[1:]):
            waiting.setdefault(collection, []).append(tuple(member))
    for row in pd.concat(list(parts)).sort_values("arrival_ord").itertuples(index=False):
        collection = as_long(row.collection_id)
        if row.kind == "collection":
            known.add(collection)
            out += [(collection, *member, "applied") for member in waiting.pop(collection, ())]
        elif collection in known:
            out.append((collection, as_long(row.external_id), as_long(row.position), "applied"))
        elif len(mine := waiting.setdefault(collection, [])) < MOST_PENDING:
            mine.append((as_long(row.external_id), as_long(row.position)))
        else:
            out.append((collection, as_long(row.external_id), as_long(row.position), "overflow"))
    kept = [(collection, *member) for collection, members in waiting.items() for member in members]
    state.update((list(known), *([r[i] for r in kept] for i in range(3))))
    yield given(out)


def hold_memberships(events: DataFrame) -> DataFrame:
    """A stream of events (collection_id, kind: collection or membership, external_id, position, arrival_ord) to memberships
    that can be applied, in order; those that came before their collection follow it. Overflow is given out, never lost."""
    out = "collection_id long, external_id long, position long, outcome string"
    return bucketed(events).groupBy("bucket").applyInPandasWithState(_hold, out, _PENDING_STATE, "append", GroupStateTimeout.NoTimeout)
