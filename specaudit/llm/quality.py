"""Line-first cleaning and document quality rules, as DataFrame expressions only.

Each line is judged by rules on punctuation, navigation, symbols and boilerplate; failing lines go. A document
goes if what is left is too small a part of it, if it has too few words, or if it repeats itself too much.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Fixed values of the base rules.
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"

#: Fixed values of the line rules: bars that make a line navigation, words below which a line needs an end mark,
#: percent of symbols, percent of word characters that may go with failing lines, and phrases of page furniture.
NAVIGATION_BARS = 2
SHORT_LINE = 5
MAX_SYMBOL_PERCENT = 10
MAX_LOST_PERCENT = 50
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "forgot your password",
    "log in",
    "privacy policy",
    "share on facebook",
    "sign up",
    "subscribe to our newsletter",
    "terms of service",
)
END_MARKS = ".!?:;…\"')]»”。！？：；」』）؟۔।॥"
#: Words above which a line is prose, whatever phrase it holds.
PHRASE_LINE = 20


def words_of(text: Column) -> Column:
    """Runs of characters other than the six ASCII white-space characters."""
    rare = text.rlike(r"[\t\x0B\f\r]")
    return F.array_remove(F.when(rare, F.split(text, r"[\x20\t-\r]")).otherwise(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")), "")


def blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(WHITE)) == ""


def n_chars(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_fails(line: Column, has_phrase: Column, has_symbol: Column) -> Column:
    """True for a line of page furniture: navigation bars, mostly symbols, a boilerplate phrase in a line of at most
    PHRASE_LINE words, or a fragment without an end mark.

    What holds for the whole text (it has one of the phrases, one of the symbols) spares a look at its lines.
    """
    phrase = F.lower(line).rlike(f"(?:^|[^a-z0-9])(?:{'|'.join(BOILERPLATE)})(?:$|[^a-z0-9])") & (F.size(words_of(line)) <= PHRASE_LINE)
    fragment = ~F.substring(F.rtrim(line, F.lit(WHITE)), -1, 1).isin(*END_MARKS) & (F.size(words_of(line)) < SHORT_LINE)
    bars = count_of(line, "|") >= NAVIGATION_BARS
    symbols = 100 * count_of(line, SYMBOLS) > MAX_SYMBOL_PERCENT * n_chars(words_of(line))
    return fragment | (has_symbol & (bars | symbols)) | (has_phrase & phrase)


def _measured(docs: DataFrame, clean: bool) -> DataFrame:
    """``row`` (the row of docs as a struct), the counts of :func:`judge_quality`, its verdict, and maybe ``clean_text``."""
    text = text_of(docs)
    own = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if clean else [F.struct(docs["doc_id"].cast("long").alias("doc_id")).alias("row")]
    t = docs.select(*own, text.alias("t")).select("*", words_of(F.col("t")).alias("w"), F.split("t", "\n").alias("raw"), F.lower("t").alias("lower"))
    has_phrase = F.lit(False)
    for p in BOILERPLATE:
        has_phrase = has_phrase | F.col("lower").contains(p)
    last = F.size("w") - WINDOW
    window = lambda i: F.xxhash64(*(F.get(F.col("w"), i + k) for k in range(WINDOW)))
    t = t.select(
        *(c for c in t.columns if c != "lower"),
        F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)).alias("h"),
        F.filter("raw", lambda x: ~blank(x)).alias("lines"),
        has_phrase.alias("has_phrase"),
        F.col("t").rlike("[" + SYMBOLS + "]").alias("has_symbol"),
    )
    sorted_windows = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    good = F.filter("raw", lambda x: blank(x) | ~line_fails(x, F.col("has_phrase"), F.col("has_symbol")))
    t = t.select(*(c for c in t.columns if c not in ("h", "w")), F.size("w").alias("n_words"), n_chars(F.col("w")).alias("word_chars"), F.when(F.size(F.array_distinct("h")) < F.size("h"), sorted_windows).alias("s"), good.alias("good"))
    same = lambda k, e: F.coalesce(F.get(F.col("s"), k)["x"] == e["x"], F.lit(False))
    again = F.transform("s", lambda e, k: F.when(same(k - 1, e) | same(k + 1, e), e["i"]))
    t = t.select("*", F.array_sort(F.filter(again, lambda x: x.isNotNull())).alias("at"), (F.size("raw") - F.size("good")).alias("n_bad"))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")), lambda a: a["n"])
    long = lambda c, name: c.cast("long").alias(name)
    t = t.select(
        "row",
        long(F.col("n_words"), "n_words"),
        long(F.col("word_chars"), "word_chars"),
        long(F.when(F.col("has_symbol"), count_of(F.col("t"), SYMBOLS)).otherwise(0), "n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        long(F.coalesce(covered, F.lit(0)), "n_repeat_words"),
        long(F.col("n_bad"), "n_bad_lines"),
        F.when(F.col("n_bad") > 0, n_chars(words_of(F.array_join("good", " ")))).otherwise(F.col("word_chars")).alias("left_chars"),
        *([F.when(F.col("n_bad") > 0, F.array_join("good", "\n")).otherwise(F.col("t")).alias("clean_text")] if clean else []),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    t = t.withColumn("base_failed", failed)
    return t.withColumn("kept", ~F.col("base_failed") & (100 * (F.col("word_chars") - F.col("left_chars")) <= MAX_LOST_PERCENT * F.col("word_chars")))


def judge_quality(docs: DataFrame, keep_columns: bool = False) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_bad_lines``.

    A row for each row of docs, without a shuffle. A null or empty text has no words and fails; null ids and
    repeated rows are kept as they are. With ``keep_columns``, ``kept`` and ``clean_text`` (the text without its
    failing lines) are added to all columns of docs instead. Repeated windows are told by 64-bit hashes of
    their words, sorted within the text, so long texts cost no more than a sort.
    """
    if keep_columns:
        names = [c for c in docs.columns if c not in ("kept", "clean_text")]
        return _measured(docs, True).select(*(F.col("row")[c].alias(c) for c in names), "kept", "clean_text")
    return _measured(docs, False).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines")


def keep_clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of docs, their failing lines cut out of ``text``.

    A plain filter would be moved below the projections and repeat all they compute; a generator isn't.
    """
    row = F.struct(*(F.col("clean_text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
    return _measured(docs, True).select(F.explode(F.when(F.col("kept"), F.array(row)).otherwise(F.array())).alias("row")).select("row.*")


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \\t-\\r]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS raw FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM s)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win), range(0, {WINDOW}) AS r(k) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, pos, line, regexp_replace(line, '[ \\t-\\r]', '', 'g') AS bare, len(list_filter(regexp_split_to_array(line, '[ \\t-\\r]+'), lambda x: x <> '')) AS nw
      FROM (SELECT doc_id, unnest(raw) AS line, generate_subscripts(raw, 1) AS pos FROM s)),
j AS (SELECT *, bare <> '' AND (len(regexp_replace(line, '[^|]', '', 'g')) >= {NAVIGATION_BARS}
        OR 100 * len(regexp_replace(bare, '[^#*$%&|<>]', '', 'g')) > {MAX_SYMBOL_PERCENT} * len(bare)
        OR (nw <= {PHRASE_LINE} AND regexp_matches(lower(line), '(^|[^a-z0-9])({"|".join(BOILERPLATE)})($|[^a-z0-9])'))
        OR (NOT list_contains([{", ".join("'" + c.replace("'", "''") + "'" for c in END_MARKS)}], right(bare, 1)) AND nw < {SHORT_LINE})) AS bad FROM l),
a AS (SELECT doc_id, count(*) FILTER (bare <> '') - count(DISTINCT line) FILTER (bare <> '') AS n_dup_lines, count(*) FILTER (bad) AS n_bad_lines, sum(len(bare)) FILTER (NOT bad) AS left_chars, sum(len(bare)) AS word_chars FROM j GROUP BY doc_id),
r AS (SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(a.word_chars AS BIGINT) AS word_chars, CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, a.n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, a.n_bad_lines, coalesce(a.left_chars, 0) AS left_chars
      FROM s JOIN a USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * (word_chars - left_chars) <= {MAX_LOST_PERCENT} * word_chars AS kept, n_bad_lines FROM b
"""
