"""Token counts through a digest cache.

The cache is a Parquet table ``(content, tokenizer, n_tokens)``: digests of the normalised content and of the
tokenizer file, and the count. Digests are joined to it first; only distinct contents without an entry move and are
encoded, and their counts are appended. Normalising replaces null by the empty text and nothing else, since
any other change could change a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_path, release, slices, small_batches, text_of
from .wordcodes import JoinedEncoder, WordCache, used_codes, word_codes

_CACHES: dict = {}
#: Digests of contents without an entry that are broadcast (some 80 bytes each), so that other texts stay where they are.
MAX_BROADCAST_DIGESTS = 200_000


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


#: White space as the pre-tokenizers see it, for RE2.
_WS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


class ChunkCounter:
    """Counts of a byte-level BPE tokenizer whose pre-tokens never cross a lone space or newline.

    Such a tokenizer starts a pre-token at a single space or newline between two other characters, so a text's
    count is the sum over the pieces between those places, a newline being one token. Texts with other white
    space beside a space or newline, or with a special token's string, go to the tokenizer whole. The library
    counts every piece.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        if len(newline) != 1:
            raise ValueError("a newline must be one token")
        encode = JoinedEncoder(self.tokenizer, "\n", newline[0], lambda t: not t or t[-1].isspace() or t[0].isspace() and t[0] != " ")
        self.cache = WordCache(lambda words: [len(x) // 4 for x in encode(words)])

    def counts(self, texts: pa.Array) -> np.ndarray:
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, f"[ \\n][{_WS}]|[{_WS}][ \\n]|[ \\n]$|^[ \\n]")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        result = np.zeros(len(texts), np.int64)
        if odd.any():
            where = np.flatnonzero(odd)
            result[where] = [len(e) for e in self.tokenizer.encode_batch_fast(texts.take(pa.array(where)).to_pylist(), add_special_tokens=False)]
        where = np.flatnonzero(~odd)
        if len(where):
            # lines are coded one by one: the first word of each has no space before it
            kept = texts.take(pa.array(where))
            lines = pc.split_pattern(kept, "\n")
            of_line = np.asarray(lines.offsets, dtype=np.int64)
            words, codes, offsets = word_codes(lines.flatten(), " ")
            first = np.zeros(len(codes), bool)
            first[offsets[:-1]] = True
            n = np.zeros(len(codes), np.int64)
            for part, prefix in ((first, ""), (~first, " ")):
                used = used_codes(codes[part], len(words))
                table = np.zeros(len(words), np.int64)
                table[used] = self.cache.get([prefix + words[c] for c in used.tolist()])
                n[part] = table[codes[part]]
            sums = np.concatenate(([0], np.cumsum(n)))[offsets]  # by line
            of_line -= of_line[0]
            result[where] = sums[of_line[1:]] - sums[of_line[:-1]] + np.diff(of_line) - 1
        return result


def _counter(path: str) -> ChunkCounter:
    if path not in _CACHES:
        _CACHES[path] = ChunkCounter(path)
    return _CACHES[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, max_tokens: int = 1024) -> DataFrame:
    """Tokens of every text: ``doc_id, n_bytes, n_tokens, over_limit``, a row for each row of docs.

    Null texts count as empty and have 0 tokens; null ids and repeated rows are kept as they are; other
    columns of docs are not read. ``cache_path`` names the cache table to use and to append to; without it a
    fresh one is made in the shared folder.
    """
    spark = docs.sparkSession
    small_batches(spark)
    version = file_digest(tokenizer_path)
    cache_path = cache_path or new_path(spark, "token-counts")
    schema = "content string, tokenizer string, n_tokens long"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache_path)

    text = text_of(docs)
    digest = F.sha2(text, 256)
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("content"))
    keyed = materialise(keyed, "digests")
    own = materialise(keyed.select("content").distinct(), "contents")

    def cached() -> DataFrame:
        # this run's digests; one count for each even if two runs have appended it
        table = spark.read.schema(schema).parquet(cache_path).filter(F.col("tokenizer") == version)
        return table.join(own, "content", "left_semi").groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    unknown = materialise(own.join(cached(), "content", "left_anti"), "unknown")
    texts = docs.select(digest.alias("content"), text.alias("text"))
    # copies meet in the map-side part of the aggregate, so a text with many copies isn't sent many times
    one = lambda t: t.groupBy("content").agg(F.first("text").alias("text"))
    missing = unknown.count()
    misses = one(texts.join(F.broadcast(unknown), "content", "left_semi")) if missing <= MAX_BROADCAST_DIGESTS else one(texts).join(unknown, "content", "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, "text"):
                n = counter.counts(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("content").cast(pa.string()), pa.array([version] * len(n), pa.string()), pa.array(n)], ["content", "tokenizer", "n_tokens"])

    if missing:
        misses.mapInArrow(encode, schema).write.mode("append").parquet(cache_path)
    # plain tables, so that the partition of a text with many copies can be split
    counts = materialise(cached(), "counts")
    release(own, unknown)
    return keyed.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
