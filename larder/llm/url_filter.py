"""URL filtering by host rules and a weighted vocabulary.

Rules (host, path) decide first: a rule fits its host and all subdomains if the URL's path starts with the
rule's path; the longest rule wins. Other URLs are scanned once by an Aho-Corasick automaton for strict and
soft terms that stand between characters other than ASCII letters and digits; one strict term, or several distinct
soft terms whose weights add up to the limit, reject the URL. Vocabularies can be read from a table.

A null URL, or one without ``://``, has an empty host and path; a null URL has no terms and is allowed. Very long URLs
are scanned to their end in one pass. Repeated rows are judged each; an empty table gives an empty result; other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Terms that reject a URL alone.
STRICT = (
    "blowjob", "camgirl", "camgirls", "creampie", "escort", "escorts", "gangbang", "hentai", "milf", "porn", "porno", "pornhub", "pornos",
    "redtube", "upskirt", "warez", "xhamster", "xnxx", "xvideos", "xxx", "youporn",
)
#: Soft terms and their weights.
SOFT = {
    "adult": 1, "adults": 1, "apuestas": 2, "betting": 2, "bingo": 1, "bookmaker": 2, "casino": 2, "casinos": 2, "cialis": 2, "crack": 1,
    "cracked": 1, "dating": 1, "desnuda": 2, "erotic": 2, "erotica": 2, "erotik": 2, "erotique": 2, "fetish": 2, "gambling": 2, "hookup": 2,
    "jackpot": 1, "kasino": 2, "keygen": 2, "lingerie": 1, "nackt": 2, "nude": 2, "nudes": 2, "pharmacy": 1, "pills": 1, "poker": 1,
    "replica": 1, "roulette": 1, "serial": 1, "sex": 2, "sexe": 2, "sexo": 2, "sexy": 1, "slots": 1, "torrent": 1, "torrents": 1, "viagra": 2,
    "wetten": 1,
}
#: Sum of the weights of distinct soft terms that rejects a URL, and how many of them it takes at least.
SOFT_LIMIT, SOFT_TERMS = 3, 2
#: Terms that a vocabulary read from a table may have at most; every task builds an automaton of them.
MOST_TERMS = 1_000_000


def read_vocabulary(terms: DataFrame) -> tuple[tuple, dict]:
    """Strict and soft terms of a table (term, weight): a null weight makes a strict term. Repeated terms count once,
    at the strictest weight; null and empty terms are left out."""
    usable = terms.filter("term IS NOT NULL AND term <> ''").groupBy("term").agg(F.max("weight").alias("weight"), F.count_if(F.col("weight").isNull()).alias("strict"))
    rows = usable.limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    strict = {low(r["term"]) for r in rows if r["strict"]}
    soft: dict = {}
    for r in rows:
        if (t := low(r["term"])) not in strict:
            soft[t] = max(soft.get(t, r["weight"]), r["weight"])
    return tuple(sorted(strict)), soft


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    lowered = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


class Judge:
    def __init__(self, rules: tuple, strict: tuple, soft: dict, limit: int, least: int):
        self.limit, self.least = limit, least
        self.longest = max((len(host) for _, host, _ in rules), default=0)
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, host + path, verdict))
        self.words = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            self.words.add_word(term, (term, None if term in strict else soft[term]))
        if len(self.words):
            self.words.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule and its verdict: hosts are looked up by those of their suffixes that a rule could have."""
        best, at = None, 0
        if len(host) > self.longest:  # begin after a dot
            at = host.find(".", len(host) - self.longest - 1) + 1
            if not at:
                return None
        while True:
            for start, name, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best is None or len(name) > len(best[0])):
                    best = (name, verdict)
            at = host.find(".", at) + 1
            if not at:
                return best

    def terms(self, url: str | None) -> tuple[list[str], list[str], bool]:
        """Distinct strict and soft terms of a URL, and whether they reject it."""
        if not url or not len(self.words):
            return [], [], False
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in url)
        strict, soft = set(), {}
        inside = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()
        for end, (term, weight) in self.words.iter(text):
            if not inside(end + 1) and not inside(end - len(term)):
                if weight is None:
                    strict.add(term)
                else:
                    soft[term] = weight
        return sorted(strict), sorted(soft), bool(strict) or len(soft) >= self.least and sum(soft.values()) >= self.limit


def judge_urls(pages: DataFrame, rules: tuple = RULES, strict: tuple = STRICT, soft: dict | None = None, limit: int = SOFT_LIMIT, least: int = SOFT_TERMS) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_terms and soft_terms of every row of ``pages`` (page_id, url)."""
    soft = SOFT if soft is None else soft

    @F.pandas_udf("rule string, verdict string, strict_terms array<string>, soft_terms array<string>")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = Judge(rules, strict, soft, limit, least)
        for urls, hosts, paths in parts:
            rows = []
            for url, host, path in zip(urls, hosts, paths):
                found = own.rule(host, path)
                hard, mild, rejected = own.terms(url)
                rows.append((found[0] if found else None, found[1] if found else "block" if rejected else "allow", hard, mild))
            yield pd.DataFrame(rows, columns=["rule", "verdict", "strict_terms", "soft_terms"])

    parts = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.withColumn("_judged", judge("url", "host", "path")).select("page_id", "host", "path", "_judged.*")
