"""Chat formatting of conversations whose turns hold typed content parts.

A turn's content is a list of parts (kind, text, ref, units). A visitor flattens it in order: text parts are
escaped and kept, image, audio and document parts become placeholders, and each attachment's reference, place
and expanded number of tokens is recorded. A plain ``text`` column is one text part.

The formatted output has one row for each turn, in order ``seq`` within a conversation; rows joined in order
are the conversation's string. A turn reads ``<|turn|>role\\ntext<|end|>\\n``; the first begins with ``<s>``, the last
ends with ``</s>``. Control strings inside texts get a backslash after their first character, and one more if they
have backslashes there already, so reading back takes one away: the escape is reversible and no text can
forge a mark. ``loss_start`` and ``loss_end`` mark the assistant's text in the row, in code points.

Nulls: a null text, role or part is empty; rows with a null ``turn`` come first, rows with a null ``conv_id`` are one
conversation. Rows of equal turn are ordered by role, then text, and repeated rows stay. Very long texts are kept whole.
An empty table gives an empty output. Other columns aren't read; typed parts are read from the column named as such.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.workspace import partitions_for

#: What follows the first character of each control string.
CONTROL = r"/?s>|/?INST\]|/?SYS\]|\|(?:turn|end|image|audio|document)\|>"
OPENERS = r"[<\[]"
#: Tokens of one unit of an attachment: an image tile, a second of sound, a page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 1024}
ATTACHMENTS = "array<struct<kind:string,ref:string,position:int,tokens:long>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"({OPENERS})(\\*)(?={CONTROL})", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"({OPENERS})\\(\\*)(?={CONTROL})", r"$1$2")


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """The string of a turn's parts, and its attachments. Parts of unknown kind are taken as text."""
    attached = lambda p: p["kind"].isin(*TOKENS_PER_UNIT)
    show = lambda p: F.when(attached(p), F.concat(F.lit("<|"), p["kind"], F.lit("|>"))).otherwise(escaped(F.coalesce(p["text"], F.lit(""))))
    per_unit = F.create_map(*[F.lit(x) for pair in TOKENS_PER_UNIT.items() for x in pair])
    note = lambda p, i: F.struct(
        p["kind"].alias("kind"), p["ref"].alias("ref"), i.alias("position"), (per_unit[p["kind"]] * F.coalesce(p["units"], F.lit(1))).cast("long").alias("tokens")
    )
    notes = F.filter(F.transform(parts, lambda p, i: F.when(attached(p), note(p, i))), lambda x: x.isNotNull())
    return F.array_join(F.transform(parts, show), ""), notes.cast(ATTACHMENTS)


def _unescaped_role(role: Column) -> Column:
    """Pairs of backslashes are one, and a backslash with ``n`` a new line, from left to right."""
    lines = F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(lines, "\\")


def format_chat(turns: DataFrame, assistant: str = "assistant", parts_column: str | None = None) -> DataFrame:
    """conv_id, seq, rendered, loss_start, loss_end, attachments of ``turns`` (conv_id, turn, role, and text or typed parts)."""
    if parts_column:
        parts = F.coalesce(F.col(parts_column), F.array())
    else:
        parts = F.array(F.struct(F.lit("text").alias("kind"), "text", F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))
    text, notes = flatten_parts(parts)
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), text.alias("body"), notes.alias("attachments"), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("plain"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "plain", "body")
    placed = rows.withColumn("seq", F.row_number().over(order)).withColumn("_more", F.lead("seq").over(order).isNotNull())
    head = F.concat(F.when(F.col("seq") == 1, F.lit("<s>")).otherwise(F.lit("")), F.lit("<|turn|>"), escaped_role(escaped(F.col("role"))), F.lit("\n"))
    tail = F.concat(F.lit("<|end|>\n"), F.when(F.col("_more"), F.lit("")).otherwise(F.lit("</s>")))
    learns = F.col("role") == assistant
    return placed.select(
        "conv_id", "seq", F.concat(head, "body", tail).alias("rendered"),
        F.when(learns, F.length(head)).alias("loss_start"), F.when(learns, F.length(head) + F.length("body")).alias("loss_end"), "attachments",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, seq, role, text, loss_text (null without loss) and n_chars, parsed from the formatted rows."""
    pattern = r"(?s)^(?:<s>)?<\|turn\|>([^\n]*)\n(.*)<\|end\|>\n(?:</s>)?$"
    role = F.regexp_extract("rendered", pattern, 1)
    role = _unescaped_role(role)
    masked = F.substring("rendered", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    return formatted.select(
        "conv_id", "seq", unescaped(role).alias("role"), unescaped(F.regexp_extract("rendered", pattern, 2)).alias("text"),
        unescaped(masked).alias("loss_text"), F.length("rendered").cast("long").alias("n_chars"),
    )


def digests(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``read_back`` rows: counts and SHA-256 digests.

    Rows come sorted, and a conversation is digested as it streams by, so its length doesn't matter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state, seen = None, None, False

        def row() -> tuple:
            return (name, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            done = []
            for conv, role, text, loss, n in zip(batch["conv_id"], batch["role"], batch["text"], batch["loss_text"], batch["n_chars"]):
                conv = None if pd.isna(conv) else int(conv)
                if not seen or conv != name:
                    if seen:
                        done.append(row())
                    name, state, seen = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += n
            if done:
                yield pd.DataFrame(done, columns=columns).astype({"conv_id": "Int64"})
        if seen:
            yield pd.DataFrame([row()], columns=columns).astype({"conv_id": "Int64"})

    ordered = turns.repartition(partitions_for(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.select("conv_id", "role", "text", "loss_text", "n_chars").mapInPandas(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
