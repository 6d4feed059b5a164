"""Removal of passages that repeat within and across documents, by winnowing over word or line hashes.

By word, a passage is any run of PASSAGE_WORDS words, wherever it starts and ends. Grams of GRAM_WORDS words are
winnowed over each window of PASSAGE_WORDS, and the windows in a row that choose the same gram make a block. Equal
windows choose equal grams, so repeats are looked for only among blocks of one gram. Equal blocks hold equal
windows: the first stays and the others go whole. Where a gram has several different blocks (at the ends of a
match) the windows of the first of each are compared one by one, which extends the match to its last word.

By line, only whole lines count, as follows.

Lines are what ends with a newline or with a sentence's end mark and a space. From each line start, GRAM_WORDS
words of whole lines make a gram, and PASSAGE_WORDS words of whole lines make a window; another window goes back
as far from each line's end. In the window at a line start the gram with the least hash is the fingerprint, so
two equal windows have the same fingerprint, and so has any repeated run of lines with PASSAGE_WORDS words,
which holds the window at its first line. Fingerprints that occur once drop out; around the others the windows
are compared, and equal windows, forwards from a run's first line and backwards from its last, make a match's
full extent. The first occurrence of a window, by document id and place, stays;
later ones are deleted.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, row_key, slices, small_batches, text_of, tidy

PASSAGE_WORDS = 50
GRAM_WORDS = 20
#: Words that must be left of a document that loses a passage; with fewer, a rule on length would reject it.
MIN_WORDS = 10

#: Bytes of text whose words are hashed at once: a character takes some 60 bytes of a worker's memory then.
SLICE = 1 << 19

#: Scripts written without spaces, where each character counts as a word: Thai, Lao, Tibetan, Burmese, Khmer, Chinese,
#: Japanese, Yi and their wide forms.
UNSPACED = ((0x0E00, 0x10A0), (0x1780, 0x1800), (0x2E80, 0x3000), (0x3001, 0xA4D0), (0xF900, 0xFB00), (0xFF00, 0xFFA0), (0x1AFF0, 0x1B170), (0x20000, 0x32400))

#: Odd multipliers of the sequence hashes.
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
SEPARATOR = "\x1f"


def lines_of(text: str) -> list[str]:
    """Lines with what ends them; joined, they are the text."""
    if SEPARATOR in text:
        return [x for x in re.split(r"(?<=\n)|(?<=[.!?] )", text) if x]
    marked = text.replace("\n", "\n" + SEPARATOR)
    for mark in (". ", "! ", "? "):
        marked = marked.replace(mark, mark + SEPARATOR)
    return [x for x in marked.split(SEPARATOR) if x]


@functools.lru_cache(maxsize=2)
def powers_of_base(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, below size."""
    powers, inverse = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    return np.multiply.accumulate(powers), np.multiply.accumulate(inverse)


def sequence_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs h[start:end], all at once, from prefix sums."""
    powers, inverse = powers_of_base(1 << max(len(h).bit_length(), 19))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers[: len(h)], dtype=np.uint64)))
    x = (sums[end] - sums[start]) * inverse[start]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


def range_minimum(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where the least of values[first..last] is, the rightmost of equals, for short ranges."""
    at, place = np.arange(len(first)), first.copy()
    step = 1
    while len(at := at[first[at] + step <= last[at]]):
        better = values[first[at] + step] <= values[place[at]]
        place[at[better]] = first[at[better]] + step
        step += 1
    return place


def fingerprints(texts: list[str], passage: int = PASSAGE_WORDS, gram: int = GRAM_WORDS) -> tuple[np.ndarray, ...]:
    """Of all windows of some texts, by start: text, start and end in characters, hash, place and hash of the fingerprint."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    hashes, words, starts, ends, counts = [], [], [], [], []
    for t in texts:
        at, n = 0, 0
        for line in lines_of(t):
            parts = line.split()
            if parts:
                hashes.append(digest(" ".join(parts)))
                words.append(len(parts))
                starts.append(at)
                ends.append(at + len(line))
                n += 1
            at += len(line)
        counts.append(n)
    h = np.array(hashes, np.uint64)
    before = np.concatenate(([0], np.cumsum(np.array(words, np.int64))))
    doc = np.repeat(np.arange(len(texts)), counts)
    limit = np.repeat(np.cumsum(counts), counts)  # where each line's text ends
    end_gram = np.searchsorted(before, before[:-1] + gram, "left")
    end_window = np.searchsorted(before, before[:-1] + passage, "left")
    i = np.flatnonzero(end_window <= limit)
    grams = np.full(len(h), np.iinfo(np.uint64).max)
    whole = np.flatnonzero(end_gram <= limit)
    grams[whole] = sequence_hashes(h, whole, end_gram[whole])
    # grams of a window: those that end within it
    last = np.searchsorted(end_gram, end_window[i], "right") - 1
    place = np.zeros(len(h), np.int64)
    place[i] = range_minimum(grams, i, last)
    # windows back from each line's end; the one forwards from where they start lies in them
    back = np.searchsorted(before, before[1:] - passage, "right") - 1
    j = np.flatnonzero((back >= 0) & (doc[np.maximum(back, 0)] == doc))
    j = j[end_window[back[j]] != j + 1]
    begin, end = np.concatenate((i, back[j])), np.concatenate((end_window[i], j + 1))
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    starts, ends = np.array(starts, np.int64), np.array(ends, np.int64)
    return doc[begin], starts[begin], ends[end - 1], sequence_hashes(h, begin, end), place[begin], grams[place[begin]]


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``key, starts, ends``: for each document with later occurrences, the disjoint ranges of characters to delete.

    A document is known by :func:`common.row_key`; the order of documents is by id, nulls last.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = "fp long, doc_id long, key binary, windows array<struct<start:int,end:int,h:long>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                doc, start, end, h, place, fp = fingerprints(batch.column("text").to_pylist())
                if not len(doc):
                    continue
                first = np.flatnonzero(np.diff(place, prepend=-1))  # places never go back
                windows = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(h.view(np.int64))], ["start", "end", "h"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), windows)
                at = pa.array(doc[first])
                yield pa.RecordBatch.from_arrays([pa.array(fp[first].view(np.int64)), batch.column("doc_id").take(at), batch.column("key").take(at), lists], ["fp", "doc_id", "key", "windows"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs).alias("key"), text_of(docs).alias("text"))
    prints = materialise(rows.mapInArrow(scan, schema), "fingerprints")
    # both inputs of each join are plain tables, so that a very common fingerprint's partition can be split
    common = materialise(prints.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "common")
    met = prints.join(common, "fp", "left_semi").select("fp", "doc_id", "key", F.explode("windows").alias("w"))
    met = materialise(met.select("fp", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", F.col("w.start").alias("start"), F.col("w.end").alias("end")).alias("at"), F.col("w.h").alias("h")), "windows")
    first = materialise(met.groupBy("fp", "h").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").select("fp", "h", "first"), "first")
    ranges = materialise(disjoint(later(met, first, "first.end")), "ranges")
    release(prints, common, met, first)
    return ranges


def later(all_of: DataFrame, firsts: DataFrame, end_of_first: str) -> DataFrame:
    """``key, start, end`` of the places that aren't the first of their kind, without what the first covers."""
    by = [c for c in firsts.columns if c != "first"]
    start = F.when(F.col("at.key") == F.col("first.key"), F.greatest("at.start", end_of_first)).otherwise(F.col("at.start"))
    cut = all_of.join(firsts, by).filter(F.col("at") != F.col("first"))
    return cut.select(F.col("at.key").alias("key"), start.alias("start"), F.col("at.end").alias("end")).filter("start < end").distinct()


def disjoint(ranges: DataFrame) -> DataFrame:
    """``key, starts, ends``: ranges ``key, start, end`` with those that meet merged, in order."""
    by_start = Window.partitionBy("key").orderBy("start", "end")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = ranges.select("*", F.when(F.col("start") <= before, 0).otherwise(1).alias("new"))
    runs = fresh.select("*", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    runs = runs.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    ordered = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("r"))
    return ordered.select("key", F.col("r.start").alias("starts"), F.col("r.end").alias("ends"))


@functools.cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 1 for white space, as str.split has it, and 2 for a character that is a word; and a hash."""
    kinds = np.zeros(0x110000, np.uint8)
    kinds[[c for c in range(0x3001) if chr(c).isspace()]] = 1
    for a, b in UNSPACED:
        kinds[a:b] = 2
    x = np.arange(1, len(kinds) + 1, dtype=np.uint64) * np.uint64(BASE)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return kinds, x ^ (x >> np.uint64(31))


def words_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of all words of some texts: hash, text, and place in characters of the word and of the next one (or the text's end)."""
    kinds, values = characters()
    code = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    kind = kinds[code]
    plain, space = kind == 0, np.ones(1, bool)
    at = np.flatnonzero((kind == 2) | (plain & np.concatenate((space, ~plain[:-1]))))
    end = np.flatnonzero((kind == 2) | (plain & np.concatenate((~plain[1:], space[: len(plain)])))) + 1
    h = sequence_hashes(values[code], at, end)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(size + 1) - size - 1
    doc = np.repeat(np.arange(len(texts)), np.diff(np.append(np.searchsorted(at, first), len(at))))
    follows = np.append(doc[1:] == doc[:-1], False)[: len(at)]
    after = np.where(follows, np.append(at[1:], 0)[: len(at)], first[doc] + size[doc])
    return h, doc, at - first[doc], after - first[doc]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of values[i : i + width] is, the rightmost of equals, for each i that has so many."""
    place, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = place[:-step], place[step:]
        place, have = np.where(values[b] <= values[a], b, a), have + step
    return place


class Blocks:
    """Windows of some texts by word, and their blocks: runs of windows that choose the same gram."""

    def __init__(self, texts: list[str], passage: int = PASSAGE_WORDS, gram: int = GRAM_WORDS):
        self.h, doc, self.at, self.after = words_of(texts)
        self.passage = passage
        n = max(len(self.h) - passage + 1, 0)
        self.begin = np.flatnonzero(doc[:n] == doc[passage - 1 :]) if n else np.zeros(0, np.int64)
        i = np.arange(max(len(self.h) - gram + 1, 0))
        grams = sequence_hashes(self.h, i, i + gram)
        place = sliding_minimum(grams, passage - gram + 1)[self.begin] if n else self.begin
        self.first = np.flatnonzero(np.diff(place, prepend=-1))  # places never go back
        self.count = np.diff(np.append(self.first, len(place)))
        p, q = self.begin[self.first], self.begin[self.first + self.count - 1] + passage
        self.doc, self.fp, self.span = doc[p], grams[place[self.first]], sequence_hashes(self.h, p, q)
        self.start, self.mid, self.end = self.at[p], self.after[p + passage - 1], self.after[q - 1]

    def windows(self, blocks: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, start and end in characters, and the block's and an own hash of all windows of some blocks."""
        count = self.count[blocks]
        i = self.begin[np.repeat(self.first[blocks] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        return np.repeat(self.doc[blocks], count), self.at[i], self.after[i + self.passage - 1], np.repeat(self.fp[blocks], count), sequence_hashes(self.h, i, i + self.passage)


def repeated_word_ranges(docs: DataFrame) -> DataFrame:
    """``key, starts, ends`` as of :func:`repeated_ranges`, for runs of PASSAGE_WORDS words wherever they start and end."""
    spark = docs.sparkSession
    small_batches(spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                b = Blocks(batch.column("text").to_pylist())
                if len(b.doc):
                    at, whole_numbers = pa.array(b.doc), (pa.array(x.astype(np.int32)) for x in (b.start, b.mid, b.end))
                    yield pa.RecordBatch.from_arrays([pa.array(b.fp.view(np.int64)), pa.array(b.span.view(np.int64)), batch.column("doc_id").take(at), batch.column("key").take(at), *whole_numbers], ["fp", "span", "doc_id", "key", "start", "mid", "end"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                b = Blocks(batch.column("text").to_pylist())
                starts = batch.column("starts")
                wanted = starts.flatten().to_numpy() + (np.repeat(np.arange(len(starts)), starts.value_lengths().to_numpy()) << 32)
                doc, start, end, fp, h = b.windows(np.flatnonzero(np.isin(b.start + (b.doc << 32), wanted)))
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(h.view(np.int64)), batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["fp", "h", "doc_id", "key", "start", "end"])

    def ordered(*more: str):
        return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "start", *more).alias("at")

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs).alias("key"), text_of(docs).alias("text"))
    prints = materialise(rows.mapInArrow(scan, "fp long, span long, doc_id long, key binary, start int, mid int, end int"), "fingerprints")
    # both inputs of each join are plain tables, so that a very common fingerprint's partition can be split
    common = materialise(prints.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "common")
    met = materialise(prints.join(common, "fp", "left_semi").select("fp", "span", ordered("mid", "end")), "blocks")
    release(prints, common)
    classes = materialise(met.groupBy("fp", "span").agg(F.min("at").alias("first"), F.count("*").alias("n")), "classes")
    cut = materialise(later(met, classes.filter("n > 1").select("fp", "span", "first"), "first.mid"), "cut")
    mixed = materialise(classes.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "mixed")
    wanted = classes.join(mixed, "fp", "left_semi").groupBy(F.col("first.key").alias("key")).agg(F.collect_list("first.start").alias("starts"))
    wanted = materialise(wanted, "wanted")
    release(met, classes, mixed)
    tidy(spark)
    each = materialise(rows.join(wanted, "key").mapInArrow(windows, "fp long, h long, doc_id long, key binary, start int, end int").select("fp", "h", ordered("end")), "windows")
    first = materialise(each.groupBy("fp", "h").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").select("fp", "h", "first"), "first")
    ranges = materialise(disjoint(cut.unionByName(later(each, first, "first.end"))), "ranges")
    release(cut, wanted, each, first)
    tidy(spark)
    return ranges


def without(text: Column, starts: Column, ends: Column) -> Column:
    """A text without some disjoint ranges of its characters, in order; null ranges leave it as it is."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(texts, firsts, lasts, strict=True):
            out.append(None if t is None else "".join([t[x:y] for x, y in zip([0, *b], [*a, len(t)], strict=True)]))
        return pd.Series(out, dtype=object)

    # texts that stay aren't sent to Python
    once = cut.asNondeterministic()  # a filter on the result must not bring a second call
    return F.when(starts.isNull(), text).otherwise(once(F.when(starts.isNotNull(), text), starts, ends))


def cut_rows(docs: DataFrame, by_word: bool = True) -> DataFrame:
    """``row, text``: each row of docs as a struct, and its text without later repeats."""
    ranges = repeated_word_ranges(docs) if by_word else repeated_ranges(docs)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), row_key(docs).alias("key"))
    return rows.join(ranges, "key", "left").select("row", without(F.col("row.text").cast("string"), F.col("starts"), F.col("ends")).alias("text"))


def remove_repeats(docs: DataFrame, by_word: bool = False) -> DataFrame:
    """docs with later repeats cut out of ``text``, and ``n_removed``, the number of characters that went.

    by_word, passages may start and end anywhere; otherwise they are runs of whole lines.
    Null and empty texts stay as they are. Rows that repeat both id and text count as one document and are cut
    alike. Null ids come last in the order of occurrences. Other columns stay; one named n_removed is replaced.
    """
    removed = F.coalesce(F.length("row.text") - F.length("text"), F.lit(0)).cast("long")
    cut = cut_rows(docs, by_word)
    return cut.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "n_removed"), removed.alias("n_removed"))


def keep_rest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later repeats cut out of ``text``; of documents that lose text, those with fewer than min_words words left go.

    All columns of docs stay, whatever their names. Documents that lose nothing stay as they are, null texts too.
    """
    cut = cut_rows(docs)
    words = F.size(F.array_remove(F.split("text", r"[\x20\t-\r]+"), ""))
    stays = F.col("row.text").isNull() | (F.length("row.text") == F.length("text")) | (words >= min_words)
    return cut.filter(stays).select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
