"""Text columns: normal form, tokens, index words, hashtags, tolerant numbers, URLs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larder.functions.stem import stem

TOKEN = r"[\p{L}\p{N}]+"
#: A decimal number, with or without an exponent.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_WORD = re.compile(r"[^\W_]+")


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(texts: Column | str) -> Column:
    """Unicode normal form KC, for which Spark has no function: Python sees only what isn't ASCII."""
    t = F.col(texts) if isinstance(texts, str) else texts
    return F.when(_is_ascii(t), t).otherwise(_nfkc(F.when(~_is_ascii(t), t)))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order, of a text in normal form."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


@lru_cache(1 << 17)
def _without_marks(word: str) -> str:
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


@lru_cache(1 << 17)
def _stemmed(word: str) -> str:
    return stem(_without_marks(word))


def _joined(text: str | None, of_word) -> str:
    if not text:
        return ""
    plain = text if text.isascii() else unicodedata.normalize("NFKC", text)
    return " ".join(map(of_word, _WORD.findall(plain.lower())))


# words leave Python as one text a row: lists of them for a whole batch would take ten times its size
@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: _joined(x, _without_marks))


@F.pandas_udf(StringType())
def _stems(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: _joined(x, _stemmed))


def _listed(joined: Column) -> Column:
    return F.filter(F.split(joined, " "), lambda w: w != "")


def folded_words(texts: Column | str) -> Column:
    """Index words: tokens of the normal form, lower case, without diacritics. Python sees only what isn't ASCII."""
    t = F.col(texts) if isinstance(texts, str) else texts
    plain = F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(_is_ascii(t), plain).otherwise(_listed(_folded(F.when(~_is_ascii(t), t))))


def stemmed_words(texts: Column | str) -> Column:
    """As ``folded_words``, each reduced to its stem."""
    return _listed(_stems(texts))


def cleaned(text: Column, most: int) -> Column:
    """Trimmed and cut; empty is null."""
    return F.nullif(F.left(F.trim(text), F.lit(most)), F.lit(""))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tolerant_number(text: Column) -> Column:
    """A number out of a number or a numeric string, decimals and exponents too; null otherwise."""
    bare = stripped(text.cast("string"))
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def tolerant_long(text: Column) -> Column:
    """As ``tolerant_number``, cut to a whole number towards zero. Whole numbers beyond doubles keep their digits."""
    bare = stripped(text.cast("string"))
    return F.when(bare.rlike(r"^[+-]?\d+$"), bare.try_cast("long")).otherwise(tolerant_number(text).cast("long"))


def normalized_tags(tags: Column) -> Column:
    """Lower-case tags in normal form without a leading #, empties and repeats; the first of equals stays."""
    plain = F.split(nfkc(F.array_join(tags, "\u0001")), "\u0001")
    bare = F.transform(plain, lambda t: F.lower(F.regexp_replace(F.trim(t), "^#+", "")))
    return F.array_distinct(F.filter(bare, lambda t: t != ""))


def https_url(url: Column, most: int = 2048) -> Column:
    return F.when(url.startswith("https://") & (F.length(url) <= most), url)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PATH"))


def origin(url: Column) -> Column:
    """Scheme and host of an http or https URL, in lower case; null with a port or user, or for anything else."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^([Hh][Tt][Tt][Pp][Ss]?://[^/?#:@\\]+)(?:[/?#].*)?$", 1)), F.lit(""))
