"""Benchmark decontamination, as DataFrame expressions only.

Benchmark items become windows of WINDOW normalised words (a shorter item is one window). The hashes of the windows'
first words are a hash set in the scan's expression, or, if they are many, a filter of bits that is a constant of the plan; each training text is scanned window by
window, the few places whose first words could be those of a benchmark window are verified word for word, and
documents or spans with hits are removed. Texts never travel, whatever the size of the benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, text_of

WINDOW = 13
#: Words of a window that the scan looks up before the window is verified.
ANCHOR = 4
#: Largest set of anchors that goes into the scan as it is; beyond, a filter with two bits for each does, of BITS_EACH bits an
#: anchor at least, so that one place in a hundred goes on, up to 32 MB for 14 million anchors; with more of them more goes on. Larger
#: tables of windows than MAX_BROADCAST_BYTES are shuffled.
MAX_ANCHORS = 50_000
BITS_EACH = 20
MAX_BITS = 1 << 28
BLOCK_WORDS = 1 << 16
MAX_BROADCAST_BYTES = 32 << 20
#: A document is contaminated if hits cover one word in so many.
HIT_SHARE = 20

WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(ascii_lower(text), WORD_BREAKS), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``gram, n, anchor, items``: distinct windows, their length, hash of first words, and the items that hold them."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), item_words(text_of(benchmark)).alias("w"))
    w = w.filter(F.size("w") > 0).select("*", F.least(F.size("w"), F.lit(window)).alias("n"))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice(F.col("w"), i, F.col("n")))
    rows = w.select("item", "n", F.explode(cut).alias("g"))
    anchor = F.coalesce(*(F.when(F.col("n") == k, F.xxhash64(*(F.get("g", F.lit(i)) for i in range(k)))) for k in range(1, ANCHOR)), F.xxhash64(*(F.get("g", F.lit(i)) for i in range(ANCHOR))))
    rows = rows.select("item", "n", F.array_join("g", " ").alias("gram"), anchor.alias("anchor"))
    return rows.groupBy("gram", "n", "anchor").agg(F.collect_set("item").alias("items"))


def filter_bits(anchors: int) -> int:
    """Bits of the filter of so many anchors: a power of two, at least BITS_EACH for each up to MAX_BITS."""
    bits = 1 << 12
    while bits < min(BITS_EACH * anchors, MAX_BITS):
        bits *= 2
    return bits


def bit_places(anchor: Column, bits: int) -> tuple[Column, Column]:
    """The two bits of an anchor, from its low and its high half."""
    return anchor.bitwiseAND(F.lit(bits - 1)), F.shiftright(anchor, 32).bitwiseAND(F.lit(bits - 1))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def anchor_filter(windows: DataFrame, n: int, bits: int) -> Column:
    """A scalar subquery: the filter of the anchors of windows of n words, as blocks of at most BLOCK_WORDS 64-bit words.

    Spark evaluates it once, and it is a constant of the plan: no row carries it.
    """
    own = windows.filter(F.col("n") == n).select(F.explode(F.array(*bit_places(F.col("anchor"), bits))).alias("at"))
    known = own.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(_bit(F.col("at"))).alias("bits"))
    grid = known.sparkSession.range(bits // 64).select(F.col("id").alias("word"))
    words = grid.join(known, "word", "left").select((F.col("word") / BLOCK_WORDS).cast("long").alias("block"), F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    blocks = words.groupBy("block").agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("bits"))  # BLOCK_WORDS entries
    one = blocks.agg(F.array_sort(F.collect_list(F.struct("block", "bits"))).alias("b"))  # MAX_BITS bits at most
    return one.select(F.transform("b", lambda b: b["bits"])).scalar()


def _lookup(words: Column, bits: Column, n_bits: int, n: int) -> Column:
    """Places whose first words' hash is in the filter, in an array of words."""

    def head(i: Column) -> Column:
        return F.xxhash64(*(F.get(words, i + k) for k in range(min(n, ANCHOR))))

    def within(blocks: Column, h: Column) -> Column:
        held = F.lit(True)
        for place in bit_places(h, n_bits):
            word = F.shiftright(place, 6)
            block = F.get(blocks, (word / BLOCK_WORDS).cast("int"))
            held = held & (F.get(block, word.bitwiseAND(F.lit(BLOCK_WORDS - 1)).cast("int")).bitwiseAND(_bit(place)) != 0)
        return held

    all_of = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.struct(i.alias("i"), head(i).alias("h")))
    return F.get(F.transform(F.array(bits), lambda b: F.transform(F.filter(all_of, lambda x: within(b, x["h"])), lambda x: x["i"])), F.lit(0))


def _filtered_places(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``key, doc_id, n_words, p``: of each row a place of its own and those that the filters of all lengths let through.

    A filter is named in one projection and used once in the next, so Spark makes one of the two and the filter stays a constant in it.
    """
    each = {r["n"]: filter_bits(r["c"]) for r in windows.groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most WINDOW rows
    named = docs.select(row_key(docs).alias("key"), docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), *(anchor_filter(windows, n, bits).alias(f"filter_{n}") for n, bits in each.items()))
    kind = "array<struct<at:int,n:int,gram:string>>"

    def of(w: Column) -> Column:
        found = []
        for n, bits in each.items():
            gram = F.transform(_lookup(w, F.col(f"filter_{n}"), bits, n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(w, i + 1, n), " ").alias("gram")))  # noqa: B023
            found.append(F.when(F.size(w) >= n, gram).otherwise(F.array().cast(kind)))
        own = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("gram")))
        return F.struct(F.size(w).alias("n_words"), F.concat(own, *found).alias("p"))

    looked = named.select("key", "doc_id", F.get(F.transform(F.array(item_words(F.col("text"))), of), F.lit(0)).alias("s"))
    return looked.select("key", "doc_id", "s.n_words", F.explode("s.p").alias("p"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``key, doc_id, n_rows, n_words, hits, items``; hits are disjoint (start, end) in words, in order.

    key is :func:`common.row_key`; rows that repeat id and text are one row here, with their number. Only the places
    found, never whole texts, are shuffled.
    """
    windows = benchmark_windows(benchmark, window)
    size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("gram") + 64 * F.size("items")), F.lit(0))).first()
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most WINDOW rows
    anchors: dict[int, list[int]] = {n: [] for n in lengths}
    rows = docs.select(row_key(docs).alias("key"), docs["doc_id"].cast("long").alias("doc_id"), item_words(text_of(docs)).alias("w"))
    if few := size[0] <= MAX_ANCHORS:
        for r in windows.select("n", "anchor").distinct().collect():
            anchors[r["n"]].append(r["anchor"])
    found = []
    for n in lengths if few else ():
        head = "xxhash64(" + ", ".join(f"w[i + {k}]" for k in range(min(n, ANCHOR))) + ")"
        places = f"sequence(0, greatest(size(w) - {n}, 0))"
        places = f"filter({places}, i -> {head} IN ({', '.join(f'{a}L' if a != -(2**63) else '(-9223372036854775807L - 1L)' for a in anchors[n])}))"
        found.append(F.expr(f"CASE WHEN size(w) >= {n} THEN transform({places}, i -> struct(i AS at, {n} AS n, array_join(slice(w, i + 1, {n}), ' ') AS gram)) ELSE array() END"))
    # a place of its own for each row says how often it is there
    row = F.expr("array(struct(-1 AS at, 0 AS n, CAST(NULL AS STRING) AS gram))")
    places = rows.select("key", "doc_id", F.size("w").alias("n_words"), F.explode(F.concat(row, *found)).alias("p")) if few else _filtered_places(docs, windows)
    places = places.select("key", "doc_id", "n_words", F.col("p.at").alias("at"), F.col("p.n").alias("n"), F.col("p.gram").alias("gram"))
    grams = windows.select("gram", F.col("n").alias("gn"), "items")
    if size[1] <= MAX_BROADCAST_BYTES:
        grams = F.broadcast(grams)
    hits = places.join(grams, (places["gram"] == grams["gram"]) & (places["n"] == grams["gn"]), "left")
    hit = F.when(F.col("items").isNotNull(), F.struct(F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end")))
    by_doc = hits.groupBy("key", "doc_id", "n_words").agg(F.count_if(F.col("at") < 0).alias("n_rows"), F.array_sort(F.collect_set(hit)).alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    start = F.array().cast("array<struct<start:int,end:int>>")
    joined = F.aggregate("h", F.struct(start.alias("done"), F.lit(None).cast("struct<start:int,end:int>").alias("open")), _extend, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return by_doc.select("key", "doc_id", "n_rows", "n_words", joined.alias("hits"), "items")


def _extend(state: Column, x: Column) -> Column:
    """Merge the next span, by start, into the open one, or close that."""
    span = "struct<start:int,end:int>"
    done, now = state["done"], state["open"]
    meets = now.isNotNull() & (x["start"] <= now["end"])
    merged = F.struct(now["start"].alias("start"), F.greatest(now["end"], x["end"]).alias("end"))
    return F.struct(
        F.when(now.isNull() | meets, done).otherwise(F.concat(done, F.array(now))).cast(f"array<{span}>").alias("done"),
        F.when(meets, merged).otherwise(x).cast(span).alias("open"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, a row for each row of docs.

    A null or empty text has no words and no hits; null ids and repeated rows are kept, and items with a null
    or empty text have no windows. A null item id is left out of the items. An empty benchmark hits nothing.
    """
    found = find_hits(docs, benchmark)
    n_hit = F.aggregate("hits", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    out = found.select("n_rows", "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    verdict = ((F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    return out.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows"))).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", verdict)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, spans: bool = False) -> DataFrame:
    """docs without contaminated documents; with ``spans``, all documents, those without their hit words.

    Span removal takes the words of the hits out of a contaminated document's text; what stands between words
    goes with the word after it. A document is known by its id and text: rows that repeat both fare alike.
    """
    key = row_key(docs)
    found = find_hits(docs, benchmark)
    n_hit = F.aggregate("hits", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    bad = found.filter((n_hit > 0) & (HIT_SHARE * n_hit >= F.col("n_words"))).select(F.col("key").alias("bad_key"), "hits")
    rows = docs.select(key.alias("key"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    if not spans:
        return rows.join(bad, rows["key"] == bad["bad_key"], "left_anti").select("row.*")
    hit = rows.join(bad, rows["key"] == bad["bad_key"], "left")
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    left = F.filter(pieces, lambda x, i: ~F.exists(F.col("hits"), lambda h: (i >= h["start"]) & (i < h["end"])))
    cut = F.when(F.col("hits").isNull(), F.col("row.text")).otherwise(F.ltrim(F.array_join(left, "")))
    return hit.select(F.col("row").withField("text", cut).alias("row")).select("row.*")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
nh AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {HIT_SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""
