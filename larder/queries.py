"""All registered queries of the library over the given tables, and their SQL for DuckDB; see ``larder.sources.tables`` for the roles
that the tables play."""

from __future__ import annotations

from larder.registered import captures, library, lists, payloads, requests, searches, streams

entry = searches.entry
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _subject in (searches, requests, captures, payloads, library, lists, streams):
    QUERIES |= _subject.QUERIES
    ORACLES |= _subject.ORACLES
