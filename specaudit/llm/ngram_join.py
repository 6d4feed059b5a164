"""Jaccard similarity join of documents on word n-grams, by T-occurrence search with DivideSkip.

A document's set holds its distinct n-grams. Documents with equal sets are one class; the join runs on classes.

1. Of each class, the n-grams with the least hashes (some 40 % of them) go to buckets by their hash. Classes that
   link have at least a fifth of the smaller set in common among these, so a class whose n-grams other classes
   hold too seldom drops out. N-grams that very many classes hold don't travel: they count as held by others.
2. The whole sets of the classes left go the same way; each must share as many as any link needs.
3. N-grams of the classes left then are ordered by the number of classes that hold them. Two classes that link share
   one of the first few of each. The inverted lists of those, with length and position bounds, give candidates.
4. Each list first proposes only one query, the class with the fewest n-grams of its own, to its other members.
   Members are searched in blocks: a block builds inverted lists over its members' whole sets, merges the short
   lists of a query's n-grams by a heap, drops members short of T - L occurrences, and looks for the others in the
   L long lists by binary search.
5. Links give components. Lists whose members are all in one component are done. In the others, each class outside
   the list's largest component searches the blocks that hold members of other components, and of what it finds one
   link to each component is enough. Components are exact; pairs within a group are never listed.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, row_key, slices, small_batches, text_of, tidy
from .components import connected
from .wordcodes import word_codes

N = 5
#: Documents link when MIN_PERCENT of the union is shared.
MIN_PERCENT = 80
#: N-grams of a bucket, and members, queries and n-grams of either that a block holds, if it has more than one; the
#: numbers of buckets and blocks follow the data.
BUCKET_GRAMS = 1_000_000
BLOCK_MEMBERS = 200
BLOCK_QUERIES = 1_000
BLOCK_GRAMS = 200_000
#: N-grams that so many classes hold aren't dealt; they are looked for, by a sample of classes, once there are as many.
HOT = 1_000_000
HOT_SAMPLE = 20_000

BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93


def gram_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct word n-grams; of a shorter text, of all its words as one."""
    import pyarrow.compute as pc
    import xxhash

    words, codes, offsets = word_codes(pc.ascii_lower(texts.cast(pa.large_string())), None)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))[codes] if len(codes) else np.zeros(0, np.uint64)
    base = np.uint64(BASE)

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
        return x ^ (x >> np.uint64(29))

    m = max(0, len(h) - n + 1)
    x = h[:m].copy()
    for k in range(1, n):
        x = x * base + h[k : m + k]
    x = mixed(x)
    out = []
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        if b - a >= n:
            out.append(np.unique(x[a : b - n + 1]))
        elif b > a:
            y = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                y = y * base + h[k]
            out.append(mixed(y))
        else:
            out.append(x[:0])
    return out


def class_id(grams: np.ndarray) -> bytes:
    """16-byte id of a set: 96 bits of its hash and its size."""
    import xxhash

    return xxhash.xxh3_128_digest(grams.tobytes())[:12] + len(grams).to_bytes(4, "little")


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash by its highest bits, so that the 48 low ones still tell n-grams of one bucket apart."""
    return (((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def pack_low(grams: np.ndarray) -> bytes:
    """The low 48 bits of each hash."""
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack_low(packed: bytes, bucket: int) -> np.ndarray:
    """Hashes of a bucket from their low 48 bits; the bucket's number stands for the others."""
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel() | np.uint64((bucket & 0xFFFF) << 48)


def needed(x: int, y: int, percent: int = MIN_PERCENT) -> int:
    """Least overlap of sets of sizes x and y that link."""
    return -(-percent * (x + y) // (100 + percent))


def head_size(n: int, percent: int = MIN_PERCENT) -> int:
    """How many of a set's n least n-grams are dealt."""
    return min(n, n + -(-n * (100 - percent) // 100) - -(-n * percent // 100))


def head_bound(n: Column, percent: int = MIN_PERCENT) -> Column:
    """How many n-grams the :func:`head_size` least of a class and of any class that links with it share at least.

    Of sets of x and y n-grams that link, each holds at least ceil(0.8 x) and ceil(0.8 y) of the other, so the k
    least n-grams that they share are among the first x - ceil(0.8 x) + k of the one, and likewise of the other;
    k is the least of ceil(0.2 x) and ceil(0.2 y), and y is 0.8 x at least.
    """
    return F.greatest(F.lit(1), F.ceil(n * percent * (100 - percent) / 10_000.0 - 1e-9)).cast("long")


def t_occurrence(query: np.ndarray, index: Index, percent: int = MIN_PERCENT, wanted: Callable[[int], bool] = lambda k: True) -> list[int]:
    """Members of an index that are wanted and link with a query, a sorted array of n-grams, by DivideSkip."""
    ordered = index.lists(query)
    t = needed(len(query), max(index.least, -(-len(query) * percent // 100)), percent)
    if len(ordered) < t:
        return []
    # long lists to set aside: T / (mu log M + 1), below T
    n_long = min(t - 1, int(t / (0.01 * math.log2(len(ordered[-1]) + 1) + 1)))
    short, long = ordered[: len(ordered) - n_long], ordered[len(ordered) - n_long :]
    found, count, now = [], 0, -1

    def settle(k: int, seen: int) -> None:
        goal = needed(len(query), index.sizes[k], percent)
        if seen < goal - n_long or not wanted(k):
            return
        for left, x in enumerate(long):
            if seen >= goal or seen + n_long - left < goal:
                break
            at = bisect_left(x, k)
            seen += at < len(x) and x[at] == k
        if seen >= goal:
            found.append(k)

    for k in heapq.merge(*short):
        if k != now:
            if now >= 0:
                settle(now, count)
            now, count = k, 0
        count += 1
    if now >= 0:
        settle(now, count)
    return found


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(values), 1), bool), values[1:] != values[:-1])))


class Index:
    """Inverted lists over the members of a block: for each n-gram, the places of the members that hold it, in order."""

    def __init__(self, members: list[np.ndarray]):
        self.sizes = [len(m) for m in members]
        self.least = min(self.sizes, default=1)
        flat = np.concatenate(members) if members else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        self.places = owner[order]
        first = starts_of(flat)
        self.grams, self.ends = flat[first], np.append(first, len(flat))

    def lists(self, query: np.ndarray) -> list[list[int]]:
        """The lists of a query's n-grams, shortest first."""
        if not len(self.grams):
            return []
        at = np.minimum(np.searchsorted(self.grams, query), len(self.grams) - 1)
        at = at[self.grams[at] == query]
        at = at[np.argsort(self.ends[at + 1] - self.ends[at], kind="stable")]
        return [self.places[a:b].tolist() for a, b in zip(self.ends[at].tolist(), self.ends[at + 1].tolist(), strict=True)]


def _document_classes(rows: DataFrame, n: int, percent: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()  # of copies that one task meets, one carries the n-grams
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                sets = gram_sets(batch.column("text"), n)
                ids = [class_id(x) if len(x) else None for x in sets]
                heads = []
                for x, cid in zip(sets, ids, strict=True):
                    new = cid is not None and cid not in sent
                    heads.append(x[: head_size(len(x), percent)].tobytes() if new else None)
                    if new:
                        sent.add(cid)
                if len(sent) > 200_000:
                    sent.clear()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("own"), pa.array([len(x) for x in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(heads, pa.binary())], ["doc_id", "key", "own", "n", "cid", "head"])

    return rows.mapInArrow(scan, "doc_id long, key binary, own boolean, n long, cid binary, head binary")


def _numbered(classes: DataFrame) -> Column:
    """64 bits that tell the classes apart: a hash of the 128 of their ids, with a seed that gives no two the same."""
    for seed in range(100):
        c = F.xxhash64(F.lit(seed), "cid")
        known = classes.filter("cid IS NOT NULL").select("cid", c.alias("c"))
        if known.groupBy("c").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).filter("a <> b").isEmpty():
            return c
    raise ValueError("no hash tells the classes apart")


def _hot_grams(heads: DataFrame, total: int) -> np.ndarray:
    """N-grams that some HOT classes hold, by a sample of classes; none if there are fewer classes.

    It only decides what travels, not what links. Some HOT classes hold each, so there are about as many as all
    heads' n-grams over HOT at most.
    """
    if total <= HOT:
        return np.zeros(0, np.uint64)
    share = min(1.0, max(1, HOT_SAMPLE) / HOT)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("grams").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64))], ["g"])

    some = heads.filter(F.pmod(F.xxhash64(F.lit("hot"), "c"), F.lit(1 << 20)) < share * (1 << 20)).select("grams")
    found = some.mapInArrow(unpack, "g long").groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT * share).select("g").collect()
    return np.sort(np.array([r["g"] for r in found], np.int64).view(np.uint64))


def _shared_grams(sets: DataFrame, buckets: int, hot: np.ndarray, lists: bool) -> DataFrame:
    """``c, n_hot, k, h`` of ``c, grams``: for classes and buckets, how many n-grams another class has too, and these
    with the number of classes that have them.

    A bucket and 48 bits of the hash name an n-gram from here on. An entry takes 14 bytes, whatever the number of
    buckets; these grow in number with the data, not in size, since no n-gram that very many classes hold is dealt.
    Rows with n_hot say how many of a class's n-grams were not. Without ``lists`` the n-grams themselves are left out.
    """
    sent = sets.sparkSession.sparkContext.broadcast(hot)  # see _hot_grams for its bound
    entry = pa.list_(pa.struct([("df", pa.int64()), ("g", pa.int64())]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("cs", pa.binary()), ("grams", pa.binary())])
        for whole in batches:
            for batch in slices(whole, "grams", 4 << 20):
                own = batch.column("grams").to_pylist()
                flat = np.frombuffer(b"".join(own), np.uint64)
                owner = np.repeat(batch.column("c").to_numpy(), [len(x) // 8 for x in own])
                if len(hot_ := sent.value):
                    is_hot = hot_[np.minimum(np.searchsorted(hot_, flat), len(hot_) - 1)] == flat
                    who, times = np.unique(owner[is_hot], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"bucket": (-1 - who % buckets).tolist(), "cs": [c.tobytes() for c in who], "grams": [t.astype("<i8").tobytes() for t in times]}, schema=schema)
                    flat, owner = flat[~is_hot], owner[~is_hot]
                bucket = bucket_of(flat, buckets)
                order = np.argsort(bucket, kind="stable")
                flat, owner, bucket = flat[order], owner[order], bucket[order]
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(first, len(flat)).tolist()
                parts = list(zip(ends, ends[1:], strict=False))
                yield pa.RecordBatch.from_pydict({"bucket": bucket[first].tolist(), "cs": [owner[a:b].tobytes() for a, b in parts], "grams": [pack_low(flat[a:b]) for a, b in parts]}, schema=schema)

    def shared(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        owner = np.frombuffer(b"".join(table["cs"].to_pylist()), np.int64)
        packed = b"".join(table["grams"].to_pylist())
        if bucket < 0:
            who, at = np.unique(owner, return_index=True)
            return pa.table({"c": pa.array(who), "n_hot": pa.array(np.frombuffer(packed, "<i8")[at]), "k": pa.array(np.zeros(len(who), np.int64)), "h": pa.array([[]] * len(who), entry)})
        flat = unpack_low(packed, bucket)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        first = starts_of(flat)
        several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        keep = np.repeat(several, np.diff(np.append(first, len(flat))))
        flat, owner = flat[keep], owner[keep]
        order = np.lexsort((flat, owner))
        flat, owner = flat[order], owner[order]
        new = np.ones(len(flat), bool)  # copies that different tasks have dealt count once
        new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
        flat, owner = flat[new], owner[new]
        begin = starts_of(owner)
        ends = np.append(begin, len(owner))
        if lists:
            _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
            pairs = pa.StructArray.from_arrays([pa.array(times[code].astype(np.int64)), pa.array(flat.view(np.int64))], ["df", "g"])
            h = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs).cast(entry)
        else:
            h = pa.array([[]] * len(begin), entry)
        return pa.table({"c": pa.array(owner[begin], pa.int64()), "n_hot": pa.array(np.zeros(len(begin), np.int64)), "k": pa.array(np.diff(ends)), "h": h})

    dealt = sets.select("c", "grams").mapInArrow(deal, "bucket int, cs binary, grams binary")
    return dealt.groupBy("bucket").applyInArrow(shared, "c long, n_hot long, k long, h array<struct<df:long,g:long>>")


def _hot_lists(held: DataFrame, sets: DataFrame, hot: np.ndarray) -> DataFrame:
    """``g, c, n, rest, share`` of the hot n-grams that belong to a class's first ones; they come after all others."""
    sent = held.sparkSession.sparkContext.broadcast(hot)
    schema = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("rest", pa.int64()), ("share", pa.float64())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                grams = np.frombuffer(r["grams"], np.int64)
                grams = grams[np.isin(grams.view(np.uint64), sent.value)][: r["reach"] - r["cold"]]
                pos = r["cold"] + np.arange(len(grams))
                yield pa.RecordBatch.from_pydict({"g": grams, "c": [r["c"]] * len(pos), "n": [r["n"]] * len(pos), "rest": r["n"] - r["alone"] - pos, "share": [r["alone"] / r["n"]] * len(pos)}, schema=schema)

    far = held.withColumn("cold", F.size("h")).filter("reach > cold").select("c", "n", "alone", "reach", "cold")
    return far.join(sets, "c").mapInArrow(pick, "g long, c long, n long, rest long, share double")


def _search(lists: DataFrame, queries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that queries ``g, c, n, rest, label`` find among the members ``g, c, n, rest, label, size`` of their lists.

    A member lies in one block, with others of the longest among its lists (``size``), so that a large group fills few
    blocks, whatever else its members share with one or two classes; a query goes once to each block
    that holds members of its lists which it could link with. What is linked already, by its label or by a link of
    the block, isn't looked at again, so a block gives fewer links than it has labels.
    """

    def parts(most: int) -> Column:
        return F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / BLOCK_GRAMS)).alias("parts")

    home = lists.groupBy("c").agg(F.max(F.struct("size", "g"))["g"].alias("home"), F.min("label").alias("label"), F.min("n").alias("n"))
    home = materialise(home, "homes")
    room = materialise(home.groupBy("home").agg(parts(BLOCK_MEMBERS)).filter("parts > 1"), "room")
    part = F.pmod(F.xxhash64("c"), F.coalesce("parts", F.lit(1).cast("long")))
    placed = materialise(home.join(room, "home", "left").select("c", "label", F.xxhash64("home", part).alias("block")), "placed")
    inside = lists.select("g", "c", "n", "rest").join(placed, "c").groupBy("g", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("most"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    inside = materialise(inside, "inside")
    least = F.ceil(F.col("n") * percent / 100)
    fits = (F.col("hi") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("lo") * percent) & (F.least("rest", "most") >= least) & ((F.col("l0") != F.col("label")) | (F.col("l1") != F.col("label")))
    visits = materialise(queries.join(inside, "g").filter(fits).select("block", F.col("c").alias("q"), "label", queries["n"]).distinct(), "visits")
    crowd = materialise(visits.groupBy("block").agg(parts(BLOCK_QUERIES)), "crowd")
    asked = visits.join(crowd, "block").select("block", F.pmod(F.xxhash64("q"), F.col("parts")).alias("part"), F.lit(True).alias("asks"), F.col("q").alias("c"), "label")
    members = placed.join(crowd, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), "c", "label")
    everyone = materialise(members.unionByName(asked), "blocks")

    def search(table: pa.Table) -> pa.Table:
        c, label, grams, asks = (table[x].to_pylist() for x in ("c", "label", "grams", "asks"))
        own = [k for k, x in enumerate(asks) if not x]
        index = Index([np.frombuffer(grams[k], np.uint64) for k in own])
        above = {x: x for x in label}

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        out = []
        for k in (k for k, x in enumerate(asks) if x):
            if all(top(label[m]) == top(label[k]) for m in own):
                continue
            for m in t_occurrence(np.frombuffer(grams[k], np.uint64), index, percent, lambda m: top(label[own[m]]) != top(label[k])):  # noqa: B023
                if (a := top(label[own[m]])) != (b := top(label[k])):
                    above[max(a, b)] = min(a, b)
                    out.append((c[k], c[own[m]]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    links = materialise(everyone.join(sets, "c").groupBy("block", "part").applyInArrow(search, "a long, b long"), "links")
    release(home, room, placed, inside, visits, crowd, everyone)
    return links


def similar_classes(docs: DataFrame, n: int = N, percent: int = MIN_PERCENT, also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with their class ``doc_id, key, own, n, c``, and links ``a, b`` that join the classes of each component.

    Rows of ``also`` take part with ``own`` false. key is :func:`common.row_key`; c is null for texts without words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    of = lambda d, own: d.select(d["doc_id"].cast("long").alias("doc_id"), row_key(d).alias("key"), F.lit(own).alias("own"), text_of(d).alias("text"))
    rows = of(docs, True) if also is None else of(docs, True).unionAll(of(also, False))
    classes = materialise(_document_classes(rows, n, percent), "classes")
    named = classes.withColumn("c", F.when(F.col("cid").isNotNull(), _numbered(classes)))
    heads = named.filter("head IS NOT NULL").select("c", F.col("head").alias("grams"))
    named = materialise(named.select("doc_id", "key", "own", "n", "c"), "rows")
    size = heads.agg(F.coalesce(F.sum(F.octet_length("grams")), F.lit(0)), F.count("*")).first()
    hot = _hot_grams(heads, size[1])
    buckets = lambda total: max(64, total // 8 // BUCKET_GRAMS)
    counts = materialise(_shared_grams(heads, buckets(size[0]), hot, lists=False).groupBy("c").agg(F.sum(F.col("n_hot") + F.col("k")).alias("k")), "counts")
    one = named.filter("c IS NOT NULL").groupBy("c").agg(F.min("n").alias("n"), F.min("key").alias("key"))
    wanted = materialise(counts.join(one, "c").filter(F.col("k") >= head_bound(F.col("n"), percent)).select("c", "n", "key"), "wanted")
    release(classes, counts)
    del heads
    tidy(spark)

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array([x.tobytes() for x in gram_sets(batch.column("text"), n)], pa.binary())], ["c", "grams"])

    # one plan at every size: texts meet the classes that are wanted by a shuffle; rows that repeat id and text do on its map side
    texts = rows.groupBy("key").agg(F.first("text").alias("text"))
    found = texts.join(wanted.select("key", "c").hint("shuffle_merge"), "key").select("c", "text")
    sets = materialise(found.mapInArrow(whole_sets, "c long, grams binary"), "sets")
    del texts, found
    tidy(spark)
    size = sets.agg(F.coalesce(F.sum(F.octet_length("grams")), F.lit(0))).first()
    shared = materialise(_shared_grams(sets, buckets(size[0]), hot, lists=True), "shared")
    least = F.ceil(F.col("n") * percent / 100)
    enough = shared.groupBy("c").agg(F.sum("n_hot").alias("n_hot"), F.sum("k").alias("k")).join(wanted.select("c", "n"), "c").filter(F.col("k") + F.col("n_hot") >= least)
    enough = materialise(enough.select("c", "n", (F.col("n") - F.col("k") - F.col("n_hot")).alias("alone")), "enough")
    tidy(spark)
    ordered = shared.join(enough.select("c"), "c", "left_semi").groupBy("c").agg(F.array_sort(F.flatten(F.collect_list("h"))).alias("o"))
    held = enough.join(ordered, "c").select("c", "n", "alone", F.transform("o", lambda x: x["g"]).alias("h"))
    # the first n-grams in order of rarity, own ones first: a link needs one of them in common
    held = held.withColumn("reach", F.greatest(F.col("n") - least + 1 - F.col("alone"), F.lit(0)).cast("int"))
    held = materialise(held.filter("reach > 0").select("c", "n", "alone", "reach", F.slice("h", 1, F.col("reach")).alias("h")), "held")
    release(wanted, shared, enough)
    lists = held.select("c", "n", "alone", F.posexplode("h")).select(F.col("col").alias("g"), "c", "n", (F.col("n") - F.col("alone") - F.col("pos")).alias("rest"), (F.col("alone") / F.col("n")).alias("share"))
    if len(hot):
        lists = lists.unionByName(_hot_lists(held, sets, hot))
    lists = materialise(lists, "lists")
    release(held)
    tidy(spark)
    hubs = lists.groupBy("g").agg(F.min(F.struct("share", "c", "n", "rest")).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    hubs = materialise(hubs.select("g", "hub.c", "hub.n", "hub.rest", F.col("hub.c").alias("label"), "size"), "hubs")
    own = materialise(lists.join(hubs.select("g", "size"), "g").select("g", "c", "n", "rest", F.col("c").alias("label"), "size"), "members")
    links = _search(own, hubs, sets, percent)
    tidy(spark)
    labels = connected(links)
    named_lists = materialise(own.drop("label").join(labels.withColumnRenamed("node", "c"), "c", "left").select("g", "c", "n", "rest", F.coalesce("label", "c").alias("label"), "size"), "named")
    release(lists, hubs, own, labels)
    counted = named_lists.groupBy("g", "label").agg(F.count("*").alias("k"))
    main = materialise(counted.groupBy("g").agg(F.max(F.struct("k", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1").select("g", F.col("most.label").alias("main")), "main")
    rest = materialise(named_lists.join(main, "g"), "open")
    more = _search(rest.drop("main"), rest.filter("label <> main").drop("main"), sets, percent)
    release(named_lists, main, rest, sets)
    return named, links.unionAll(more)


def _labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes with ``label``: the component of the class."""
    labels = connected(links)
    return classes.filter("own").join(labels.withColumnRenamed("node", "c"), "c", "left").select("doc_id", "key", "n", F.coalesce("label", "c").alias("label"))


def components(docs: DataFrame, n: int = N, percent: int = MIN_PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id``, a row for each row of docs.

    component_id is the least doc_id reachable by links. A null or empty text, or one without words, has no
    n-grams and is its own component. Rows that repeat an id are linked by their texts like any others; a null
    id is never a component's id unless all its ids are null. N-grams are told by hashes: of 64 bits within a set,
    by a bucket and 48 bits where only candidates are looked for.
    """
    named = materialise(_labelled(*similar_classes(docs, n, percent)), "components")
    least = materialise(named.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    out = named.join(least, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = N, percent: int = MIN_PERCENT, also: DataFrame | None = None) -> DataFrame:
    """docs with one document of each component: that with the least id, of several rows with it one by text.

    Documents without words stay. Of rows that repeat both id and text, one stays, whatever their other columns hold.
    also (``doc_id, text``) gives other texts of the same documents, as they were before something was cut out of
    them: documents link by any of their texts. An id that isn't unique there or in docs gets none.
    """
    if also is None:
        classes, links = similar_classes(docs, n, percent)
    else:
        text = lambda d: d.select(d["doc_id"].cast("long").alias("doc_id"), text_of(d).alias("text"))
        one = lambda d: text(d).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(F.xxhash64("text")).alias("h")).filter("rows = 1").select("doc_id", "h")
        now, then = one(docs), one(also).withColumnRenamed("h", "before")
        changed = materialise(now.join(then, "doc_id").filter("h <> before").select("doc_id"), "changed")
        before = materialise(text(also).join(changed, "doc_id", "left_semi"), "before")
        release(changed)
        classes, links = similar_classes(docs, n, percent, before)
        ties = classes.filter("own").select("doc_id", F.col("c").alias("a")).join(classes.filter("NOT own").select("doc_id", F.col("c").alias("b")), "doc_id")
        links = links.unionAll(ties.filter("a <> b").select("a", "b"))
    named = materialise(_labelled(classes, links), "components")
    chosen = named.filter("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("best"))
    others = named.join(chosen, "label").filter(F.col("key") != F.col("best.key"))
    goes = materialise(others.select("key").distinct(), "others")
    again = materialise(named.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").select("key"), "again")
    release(named)
    tidy(docs.sparkSession)
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), row_key(docs).alias("key")).join(goes, "key", "left_anti")
    if again.isEmpty():
        return row.select("row.*")
    # rows that repeat id and text: the first of each
    twice = row.join(again, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
    return row.join(again, "key", "left_anti").select("row.*").unionAll(twice.select("row.*"))


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), {N}) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {N - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= {MIN_PERCENT} * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""
