"""Stateful streams with timers: chains of pages, silences of runs, memberships that wait for their collection.

State lies in RocksDB beside the executors and in the checkpoint; ``session`` gives a session set for it. Each follower keeps one short row a
key, or a list of what hasn't been settled yet. A batch's rows of one key are put in order in memory: a run has at most ``runs.PAGE_CAP`` pages.
Rows without a key are one key. A page that is delivered again (same place in the order) counts once for chains.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from larder.sources.snapshots import stored
from larder.sources.store import Store
from larder.streaming.runs import MOST_PENDING, MOST_RETRIES, MOST_SILENCE_MS, MOST_STALL_RETRIES, as_long, bucketed, given

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WEEK_MS = 7 * 24 * 3600 * 1000


def session(spark: SparkSession, event_time: bool) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB; the given one stays as it is set.

    Timers of event time need a batch without data at the end; with those of processing time such batches would follow each other without end,
    and a stream of what is there now never stop."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", event_time)
    return own


def _schema(rows: DataFrame, keys: list[str], more: str) -> StructType:
    kinds = StructType([rows.schema[k] for k in keys])
    for field in StructType.fromDDL(more):
        kinds = kinds.add(field)
    return kinds


class _Chains(StatefulProcessor):
    """One list: a page that asks for the start begins a segment; any other must ask for what the page before answered."""

    def __init__(self, keys: list[str], ttl_ms: int):
        self.keys, self.ttl_ms = keys, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chain = handle.getValueState("chain", "response string, segment long, gap boolean, gapped_ends int, outcome string, upto long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        # before any start all pages are a gap, whatever they ask for
        response, segment, gap, ends, outcome, upto = self.chain.get() or (None, 0, True, 0, "open", None)
        for page in sorted(rows, key=lambda r: r["arrival_ord"]):
            if upto is not None and page["arrival_ord"] <= upto:
                continue
            if page["request"] is None or page["request"] == "0":
                segment, gap = segment + 1, False
            else:
                gap = gap or page["request"] != response
            response, upto = page["response"], page["arrival_ord"]
            if page["has_more"] is False:
                ends += gap
                if outcome != "complete":
                    outcome = "complete" if not gap else "partial" if ends > MOST_RETRIES else "open"
            yield Row(**dict(zip(self.keys, key)), arrival_ord=upto, segment=segment, gap=gap, outcome=outcome)
        self.chain.update((response, segment, gap, ends, outcome, upto))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        return iter(())

    def close(self) -> None:
        pass


def follow_chains(pages: DataFrame, keys: list[str], ttl_ms: int = WEEK_MS) -> DataFrame:
    """A stream of pages (keys, arrival_ord, request, response, has_more) to keys, arrival_ord, segment (0 before any start), gap and
    outcome (of the list by then: complete, partial or open) of every page.

    Pages of a list come in order from batch to batch. The state of a list that has been silent for ``ttl_ms`` goes: if it comes back,
    its pages count as a gap up to the next start."""
    out = _schema(pages, keys, "arrival_ord long, segment long, gap boolean, outcome string")
    return pages.groupBy(*keys).transformWithState(_Chains(keys, ttl_ms), out, "Append", "ProcessingTime")


class _Silence(StatefulProcessor):
    """One run: pages wait until the watermark has passed them, so that what is told doesn't depend on how batches fall."""

    def __init__(self, keys: list[str], limit_ms: int, most: int):
        self.keys, self.limit_ms, self.most = keys, limit_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, arrival_ord long, items long")
        self.clock = handle.getValueState("clock", "since long, after long, retries int")
        self.due = handle.getValueState("due", "at long")

    def _wake(self, at: int | None) -> None:
        """The one timer of the run stands at ``at``."""
        if old := self.due.get():
            if old[0] == at:
                return
            self.handle.deleteTimer(old[0])
        if at is None:
            self.due.clear()
        else:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [(r["at_ms"], r["arrival_ord"], r["items"] or 0) for r in rows]
        self.waiting.appendList(new)
        first = min(at for at, _, _ in new)
        due = self.due.get()
        if due is None or first < due[0]:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        pages = sorted(tuple(p) for p in self.waiting.get())
        rest = [p for p in pages if p[0] > passed]
        since, after, retries = self.clock.get() or (None, None, 0)
        # the watermark stands for a page that hasn't come: ticks up to it, itself included, are silences
        for at, order, items in [p for p in pages if p[0] <= passed] + [(passed + 1, None, 0)]:
            while since is not None and since + self.limit_ms < at and retries <= self.most:
                since, retries = since + self.limit_ms, retries + 1
                yield Row(**dict(zip(self.keys, key)), after=after, at=since, retries=retries, state="attention" if retries > self.most else "retrying")
            if order is not None:
                since, after, retries = max(at, since or at), order, 0 if items > 0 else retries
        if since is not None:
            self.clock.update((since, after, retries))
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.due.clear()
        times = [p[0] for p in rest[:1]] + ([since + self.limit_ms] if since is not None and retries <= self.most else [])
        self._wake(min(times) if times else None)

    def close(self) -> None:
        pass


def watch_silences(pages: DataFrame, keys: list[str], delay: str, limit_ms: int = MOST_SILENCE_MS, most_retries: int = MOST_STALL_RETRIES) -> DataFrame:
    """A stream of pages (keys, arrival_ord, at: timestamp, items) to what timers of event time do about silence: a row (keys, after: the
    last page, at in milliseconds, retries, state) for each ``limit_ms`` without a page, ``attention`` when ``most_retries`` didn't help. Then
    nothing more is told until a page with items starts the count again. A page at the very moment of a timer comes before it.

    Times count to the millisecond. Pages later than ``delay`` behind the newest of all runs are left out, as the watermark has it; those of
    one moment stand in order of arrival. Pages without a time are left out."""
    timed = pages.filter("at IS NOT NULL").withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    out = _schema(pages, keys, "after long, at long, retries int, state string")
    return timed.groupBy(*keys).transformWithState(_Silence(keys, limit_ms, most_retries), out, "Append", "EventTime")


class _Holder(StatefulProcessor):
    """The collections of one bucket: memberships wait for theirs, at most ``most`` of each and for at most ``hold_ms``; others go out as
    overflow. A bucket has one state and one timer, at the first moment at which something of it has waited or been known for too long."""

    def __init__(self, most: int, hold_ms: int, ttl_ms: int):
        self.most, self.hold_ms, self.ttl_ms = most, hold_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # collections that have come, and until when that is kept; memberships that wait, and until when; the timer
        self.held = handle.getValueState("held", "known array<long>, until array<long>, waiting array<long>, ids array<long>, positions array<long>, due array<long>, wake long")

    def _read(self) -> tuple[dict, dict, int | None]:
        """Known collections to their end, waiting ones to their end and memberships, and when the timer stands."""
        held = self.held.get()
        if held is None:
            return {}, {}, None
        known, until, waiting, ids, positions, due, wake = held
        members: dict = {}
        for collection, at, *member in zip(waiting, due, ids, positions):
            members.setdefault(collection, (at, []))[1].append(tuple(member))
        return dict(zip(known, until)), members, wake

    def _write(self, known: dict, members: dict, wake: int | None, now: int) -> None:
        at = min([*known.values(), *(due for due, _ in members.values())], default=None)
        at = at and max(at, now + 1)
        if wake is not None and wake != at:
            self.handle.deleteTimer(wake)
        if at is None:
            return self.held.clear()
        if wake != at:
            self.handle.registerTimer(at)
        rows = [(collection, *member, due) for collection, (due, found) in members.items() for member in found]
        self.held.update((list(known), list(known.values()), *([r[i] for r in rows] for i in range(4)), at))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        known, members, wake = self._read()
        known = {collection: until for collection, until in known.items() if until > now}
        for part in rows:
            out = []
            for row in part.itertuples(index=False):
                collection = as_long(row.collection_id)
                if row.kind == "collection":
                    if collection not in known:
                        known[collection] = now + self.ttl_ms
                        out.append((collection, None, None, "known"))
                        out += [(collection, *member, "applied") for member in members.pop(collection, (0, ()))[1]]
                elif collection in known:
                    out.append((collection, as_long(row.external_id), as_long(row.position), "applied"))
                elif len(mine := members.setdefault(collection, (now + self.hold_ms, []))[1]) < self.most:
                    mine.append((as_long(row.external_id), as_long(row.position)))
                else:
                    out.append((collection, as_long(row.external_id), as_long(row.position), "overflow"))
            if out:
                yield given(out)
        self._write(known, {c: m for c, m in members.items() if m[1]}, wake, now)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        known, members, _ = self._read()
        if out := [(c, *member, "overflow") for c, (due, found) in members.items() if due <= now for member in found]:
            yield given(out)
        # the timer that expired is gone
        self._write({c: until for c, until in known.items() if until > now}, {c: m for c, m in members.items() if m[0] > now}, None, now)

    def close(self) -> None:
        pass


def held_memberships(events: DataFrame, most: int = MOST_PENDING, hold_ms: int = 600_000, ttl_ms: int = WEEK_MS) -> DataFrame:
    """A stream of events (collection_id, kind: collection or membership, external_id, position) to collection_id, external_id, position,
    outcome: ``applied``, ``overflow``, or ``known`` for a collection that the state didn't know.

    State is bounded in a collection by ``most``, and in collections by what comes within ``hold_ms`` of processing time, and within ``ttl_ms``
    for those that are known. What goes out as overflow is taken up by ``keep_memberships``. Collections share buckets (``runs.BUCKETS``)."""
    out = StructType.fromDDL("collection_id long, external_id long, position long, outcome string")
    return bucketed(events).groupBy("bucket").transformWithStateInPandas(_Holder(most, hold_ms, ttl_ms), out, "Append", "ProcessingTime")


#: What is kept of memberships; keys begin with the collection.
SCHEMAS = {"collections": "collection_id long", "memberships": "collection_id long, external_id long, position long", "waiting": "collection_id long, external_id long, position long"}


def _put(batch: DataFrame, number: int, folder: str) -> None:
    """Overflow waits in a table until its collection comes, in this batch or a later one; what is applied no longer waits."""
    library = Store(batch.sparkSession, folder, SCHEMAS, number)
    named = lambda *columns: F.concat_ws("/", *[c.cast("string") for c in columns])
    rows = stored(batch, "held")  # timers of processing time would tell another story if they were asked again
    known = rows.filter("outcome = 'known'").select("collection_id").distinct()
    given = rows.filter("outcome IN ('applied', 'overflow')").groupBy("collection_id", "external_id").agg(F.min("position").alias("position"), F.bool_or(F.col("outcome") == "applied").alias("_applied"))
    over = given.filter("NOT _applied").drop("_applied")
    wanted = over.select(named(F.col("collection_id")).alias("key")).distinct()
    there = known.unionByName(library.read("collections", wanted).select("collection_id")).distinct()
    woken = library.read("waiting", known.select(named(F.col("collection_id")).alias("key")), prefix=True).select(*over.columns)
    ready = given.filter("_applied").drop("_applied").unionByName(over.join(there, "collection_id", "left_semi")).unionByName(woken)
    ready = ready.groupBy("collection_id", "external_id").agg(F.min("position").alias("position"))
    key = named(F.col("collection_id"), F.col("external_id"))
    before = library.read("memberships", ready.select(key.alias("key"))).select("key", F.col("position").alias("_before"))
    placed = ready.withColumn("key", key).join(before, "key", "left").filter("_before IS NULL OR position < _before").drop("_before")
    still = over.join(there, "collection_id", "left_anti").withColumn("_gone", F.lit(False)).unionByName(woken.withColumn("_gone", F.lit(True))).withColumn("key", key)
    library.commit(number, {"collections": known.withColumn("key", named(F.col("collection_id"))), "memberships": placed, "waiting": still})


def keep_memberships(events: DataFrame, folder: str, **bounds: int) -> StreamingQuery:
    """Apply all that a stream of events for ``held_memberships`` (``bounds`` are its own) holds now to the tables of ``SCHEMAS`` below
    ``folder``: no membership is lost, whether it waits in the state or in the table, and of several the smallest position stays."""
    writer = held_memberships(events, **bounds).writeStream.foreachBatch(lambda batch, number: _put(batch, number, f"{folder}/store"))
    return writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
