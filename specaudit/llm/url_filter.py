"""URL filtering: rules on host and path, and a weighted vocabulary of terms.

The vocabulary gives each term a weight: strict or soft. An Aho-Corasick automaton finds all terms in one pass
over the URL; a hit counts where no letter or digit stands beside it. One strict hit, or soft hits of several
distinct terms, block the URL. Longest-match rules for hosts and paths come first.

The vocabulary is a dictionary or a table ``term, weight`` of any size: it is read in parts of PART_TERMS terms,
each a broadcast and an automaton of its own, and the hits of the parts add up.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from itertools import batched

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small_batches

STRICT, SOFT = 2, 1

#: Terms of a part of the vocabulary: some 100 bytes each in a worker's automaton.
PART_TERMS = 200_000

#: Fixed vocabulary of common words, for those who bring none.
VOCABULARY = {
    "casino": STRICT,
    "escort": STRICT,
    "hentai": STRICT,
    "jackpot": STRICT,
    "payday": STRICT,
    "phishing": STRICT,
    "porn": STRICT,
    "porno": STRICT,
    "sex": STRICT,
    "viagra": STRICT,
    "warez": STRICT,
    "xxx": STRICT,
    "ads": SOFT,
    "adult": SOFT,
    "bet": SOFT,
    "bets": SOFT,
    "bonus": SOFT,
    "cheap": SOFT,
    "click": SOFT,
    "crack": SOFT,
    "dating": SOFT,
    "discount": SOFT,
    "free": SOFT,
    "hot": SOFT,
    "loan": SOFT,
    "loans": SOFT,
    "nude": SOFT,
    "pills": SOFT,
    "poker": SOFT,
    "slots": SOFT,
    "spam": SOFT,
    "torrent": SOFT,
    "track": SOFT,
    "win": SOFT,
}

#: Fixed rules: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_AUTOMATA: dict = {}


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without one or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the host or a domain above it and whose path starts the path, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, f"{h}{p}").otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def automaton_of(terms: Sequence[tuple[str, int]], key: object):
    """The automaton of some terms and weights; a worker keeps the last few."""
    import ahocorasick

    found = _AUTOMATA.get(key)
    if found is None:
        while len(_AUTOMATA) > 3:
            _AUTOMATA.pop(next(iter(_AUTOMATA)))
        found = _AUTOMATA[key] = ahocorasick.Automaton()
        for term, weight in terms:
            found.add_word(term, (term, weight))
        found.make_automaton()
    return found


def count_terms(url: str | None, vocabulary: Mapping[str, int] = VOCABULARY) -> tuple[int, int]:
    """Numbers of distinct strict and of distinct soft terms that stand alone in a URL."""
    terms = tuple(sorted(vocabulary.items()))
    return _count(url, automaton_of(terms, terms))


def _count(url: str | None, automaton) -> tuple[int, int]:
    text = (url or "").lower()
    found = set()
    for end, (term, weight) in automaton.iter(text):
        start = end - len(term)
        if (start < 0 or not text[start].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
            found.add((term, weight))
    strict = sum(w >= STRICT for _, w in found)
    return strict, len(found) - strict


def vocabulary_parts(pages: DataFrame, vocabulary: Mapping[str, int] | DataFrame, part_terms: int = PART_TERMS) -> Iterator[Broadcast]:
    """The vocabulary in broadcast parts; the driver holds one part at a time.

    Terms are lower-cased; null and empty ones, and null weights, are left out, and of a repeated term the largest
    weight counts.
    """
    if isinstance(vocabulary, DataFrame):
        terms = vocabulary.select(F.lower(F.col("term").cast("string")).alias("term"), F.col("weight").cast("int").alias("weight")).filter("term <> '' AND weight IS NOT NULL")
        rows = ((r["term"], r["weight"]) for r in terms.groupBy("term").agg(F.max("weight").alias("weight")).toLocalIterator())
    else:
        rows = iter(sorted(vocabulary.items()))
    for part in batched(rows, part_terms):
        yield pages.sparkSession.sparkContext.broadcast(part)


def judge_urls(pages: DataFrame, vocabulary: Mapping[str, int] | DataFrame = VOCABULARY, rules: Sequence[tuple[str, str, str]] = RULES, max_soft: int = 1, part_terms: int = PART_TERMS) -> DataFrame:
    """``page_id, host, path, rule, verdict, n_strict, n_soft``, a row for each row of pages.

    A null URL, or one without ``://``, has an empty host and path and no rule; the vocabulary judges it, so
    null is allowed. Null ids and repeated rows are kept; other columns, html included, are not read. An empty
    vocabulary allows what no rule blocks.
    """

    def adding(part: Broadcast):
        key = uuid.uuid4().hex  # a worker keeps the automaton from task to task

        def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = automaton_of(part.value, key)
            for b in batches:
                hits = [_count(u, automaton) for u in b.column("url").to_pylist()]
                counts = [pa.array([h[k] + n for h, n in zip(hits, b.column(c).to_pylist(), strict=True)], pa.int64()) for k, c in enumerate(("n_strict", "n_soft"))]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *counts], ["page_id", "url", "n_strict", "n_soft"])

        return terms

    small_batches(pages.sparkSession)
    zero = F.lit(0).cast("long")
    counted = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), zero.alias("n_strict"), zero.alias("n_soft"))
    for part in vocabulary_parts(pages, vocabulary, part_terms):
        counted = counted.mapInArrow(adding(part), "page_id long, url string, n_strict long, n_soft long")
    parts = counted.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, kind = rule_of(F.col("host"), F.col("path"), rules)
    vote = F.when((F.col("n_strict") > 0) | (F.col("n_soft") > max_soft), "block").otherwise("allow")
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(kind, vote).alias("verdict"), "n_strict", "n_soft")


def _oracle_sql() -> str:
    host = "translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    longest = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", f"{h}{p}", v) for v, h, p in longest]
    hits = {w: " + ".join(f"CAST(regexp_matches(lower(coalesce(url, '')), '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])') AS BIGINT)" for t, x in VOCABULARY.items() if x == w) for w in (STRICT, SOFT)}
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    return f"""
WITH p AS (SELECT page_id, url, {host} AS host, {path} AS path FROM pages),
c AS (SELECT *, {case(1)} AS rule, {case(2)} AS kind, {hits[STRICT]} AS n_strict, {hits[SOFT]} AS n_soft FROM p)
SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN n_strict > 0 OR n_soft > 1 THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM c
"""


ORACLE_SQL = _oracle_sql()
