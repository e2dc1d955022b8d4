"""Secret scans with an incremental ledger of blobs.

Every version of a document is addressed by the SHA-256 of its text (its blob). A ledger, a folder of Parquet batches
below one name of the rules' version, holds one row for each blob that was scanned: the blob and all spans
found in it. A scan addresses its versions, takes the blobs that the ledger lacks under this version of the rules, scans
one text of each, appends them as one batch, and joins the ledger back to all versions, so that a text found in a thousand
paths or commits is scanned once, and never again until the rules change. A batch becomes visible as a
whole (Spark's commit of one write), so a scan that dies leaves the ledger as it was; two scans at the
same time may both scan a blob, and readers take one of the equal rows.

Texts are read twice and only those of unseen blobs travel, one for each blob and input partition: a first filter by
``SLOTS`` slots of the unseen blobs' addresses (so many small numbers at most are broadcast) drops nearly all texts that are
known, the exact join on addresses the rest.

Rules are regular expressions. ``BASE`` are fixed; ``MORE`` are this library's own. Matches of a kind are leftmost and don't
overlap; those that are shorter than the kind's least length are dropped afterwards. Offsets are code points, ends exclusive.

Null texts are empty, and empty texts are blobs like others. Texts are scanned whole, however long, one at a time. Rows of
equal or null ids are versions of their own; an empty table gives an empty result (and an empty batch). Other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.skew import lookup
from larder.llm.words import utf8
from larder.llm.workspace import Workspace

#: Slots of blob addresses that the first filter tells apart.
SLOTS = 1 << 18


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``letters`` of the pattern are ASCII; ``group`` must have ``least`` characters; ``hints`` are lower-case
    strings of which a text with a match holds one."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    hints: tuple[str, ...] = ()


#: Fixed values.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True, ("passw", "secret", "token", "apikey", "api_key")),
    Rule("access", "AKIA[A-Z0-9]+", 16, hints=("akia",)),
    Rule("hex", "[0-9a-f]+", 32),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("private key",)),
    Rule("login", r"[a-z][a-z0-9+.-]*://[^\s/?#:@]+:[^\s/?#@]+@", hints=("://",)),
    Rule("bearer", r"Bearer [A-Za-z0-9._~+/-]+=*", 27, any_case=True, hints=("bearer ",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30, hints=("eyj",)),
)
RULES = BASE + MORE
_LONG_HEX = re.compile("[0-9a-f]{32,}")


def version_of(rules: tuple[Rule, ...]) -> str:
    """A name for exactly these rules."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def spans_of(text: bytes, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all matches, by start, then in the order of the rules."""
    low, found, whole = text.lower(), [], None
    for i, rule in enumerate(rules):
        if rule.hints and not any(h.encode() in low for h in rule.hints):
            continue
        whole = text.decode("utf-8", "replace") if whole is None else whole
        if rule == BASE[2]:  # runs are maximal, so the least length may go into the pattern
            matches = _LONG_HEX.finditer(whole)
        else:
            matches = re.finditer(rule.pattern, whole, re.ASCII | (re.IGNORECASE if rule.any_case else 0))
        found += [(m.start(), i, m.end()) for m in matches if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [(rules[i].kind, start, end) for start, i, end in sorted(found)]


class Ledger:
    """Blobs scanned so far, with their spans, for one version of the rules."""

    def __init__(self, spark: SparkSession, folder: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.rules = spark, rules
        self.folder = f"{folder}/rules-{version_of(rules)}"

    SCHEMA = "blob binary, spans array<struct<kind: string, start: int, end: int>>"

    def batches(self) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        written = [str(s.getPath()) for s in files.listStatus(path) if s.isDirectory()]
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(w for w in written if files.exists(done(f"{w}/_SUCCESS")))

    def read(self) -> DataFrame:
        """One row for each blob."""
        rows = self._rows()
        return rows if len(self.batches()) < 2 else rows.dropDuplicates(["blob"])

    def _rows(self) -> DataFrame:
        batches = self.batches()
        return self.spark.read.schema(self.SCHEMA).parquet(*batches) if batches else self.spark.createDataFrame([], self.SCHEMA)

    def unseen(self, versions: DataFrame) -> DataFrame:
        """Distinct blobs of ``versions`` that this version of the rules hasn't scanned."""
        blobs = versions.select("blob").distinct()
        return blobs.join(self._rows().select("blob"), "blob", "left_anti") if self.batches() else blobs

    def append(self, texts: DataFrame) -> None:
        """Scan ``texts`` (blob, text), one row a blob, and add them as a batch."""
        rules = self.rules

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            for batch in batches:
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t, rules)] for t in utf8(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kinds)], names=["blob", "spans"])

        texts.select("blob", "text").mapInArrow(run, self.SCHEMA).write.option("compression", "zstd").parquet(f"{self.folder}/batch-{uuid.uuid4().hex}")


def scan(versions: DataFrame, ledger: Ledger, space: Workspace, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, blob and spans of every row of ``versions``; what the ledger lacks is scanned first."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    addressed = versions.select(F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
    paths = versions.select(F.col(f"`{id_column}`").alias("id"), F.unhex(F.sha2(text, 256)).alias("blob"), F.monotonically_increasing_id().alias("nth"))
    paths = space.write(paths, "paths")
    unseen = space.write(ledger.unseen(paths), "unseen")
    slot = F.pmod(F.xxhash64("blob"), F.lit(SLOTS)).cast("int").alias("slot")
    slots = unseen.select(slot).distinct()  # SLOTS rows at most
    likely = addressed.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
    texts = likely.groupBy("blob").agg(F.first("text").alias("text")).join(unseen.hint("shuffle_hash"), "blob", "left_semi")
    ledger.append(texts)
    return lookup(paths, ledger.read(), "blob", "nth").select("id", "blob", "spans")


def told(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans: the spans of :func:`scan` as texts."""
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = [r.kind for r in base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(as_text(of_base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same without ledger: texts cut at matches, whose places are sums of lengths."""
    any_case = lambda p: re.sub(r"[A-Za-z]", lambda m: f"[{m[0].lower()}{m[0].upper()}]", p)
    parts = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        if r.any_case and r.group == 2:
            head, tail = p.split(")", 1)
            p = any_case(head) + ")" + tail
        elif r.any_case:
            p = any_case("Bearer") + p.removeprefix("Bearer")
        of_group = f"list_transform(regexp_extract_all(t, '{p}', {r.group}), lambda x: length(x))"
        parts.append(f"""SELECT n, '{r.kind}' AS kind, {i} AS o, unnest(range(len(m))) AS k, list_transform(m, lambda x: length(x)) AS l, list_transform(c, lambda x: length(x)) AS gaps, g, {r.least} AS least
      FROM (SELECT n, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS c, {of_group} AS g FROM d)""")
    counts = ", ".join(f"count(kind) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
     m AS ({" UNION ALL ".join(parts)}),
     s AS (SELECT n, kind, o, list_sum(gaps[:k + 1])::BIGINT + coalesce(list_sum(l[:k]), 0)::BIGINT AS a, l[k + 1] AS size, g[k + 1] AS held, least FROM m),
     f AS (SELECT n, o, kind, a, kind || ':' || a || ':' || (a + size) AS span FROM s WHERE held >= least)
SELECT doc_id, {counts},
       sha256(coalesce(string_agg(span, ',' ORDER BY a, o) FILTER (kind IN ({base})), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY a, o), '') AS spans
FROM d LEFT JOIN f USING (n) GROUP BY n, doc_id
"""
