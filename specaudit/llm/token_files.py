"""Token-id files: flat unsigned integers beside 64-bit document offsets, read by memory map.

A folder holds shards, in order of ``doc_id``. Shard files, all little-endian:

* ``NAME.bin``: the token ids of its documents end to end, ``uint16`` if all ids of the tokenizer fit, else ``uint32``,
* ``NAME.idx``: ``int64`` offsets into it, one more than there are documents,
* ``NAME.ids``: the ``int64`` document ids, and ``NAME.nul``: a byte for each, 1 where the id was null.

``manifest`` is a Parquet table with a row for each shard: its name, place, bytes of an id, and numbers of
documents and tokens. A shard's first token has as its global number the sum of the tokens of all shards before it (a prefix
sum over the manifest, which has as many rows as there were tasks). Each attempt of a task writes files of its
own; only those of the attempt that succeeded are in the manifest, so lost or repeated tasks do no harm, and the
others are deleted at the end. Shards hold some SHARD_BYTES of text each.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, slices, small_batches, text_of
from .wordcodes import JoinedEncoder, WordCache, ragged, ragged_take, word_codes

_ENCODERS: dict = {}
_MANIFEST = "shard long, name string, width long, n_docs long, n_tokens long"


#: Text of a shard, in bytes.
SHARD_BYTES = 256 << 20
#: Schemes of Spark's file systems that pyarrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "wasb": "abfs", "wasbs": "abfss", "dbfs": "hdfs"}


def arrow_uri(uri: str) -> str:
    """A folder's name as pyarrow knows it; one without a scheme is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return f"file://{uri}"
    scheme, colon, rest = uri.partition(":")
    return SCHEMES.get(scheme, scheme) + colon + rest


def open_folder(uri: str):
    """File system and path of a folder; any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(uri))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b for b in range(256)]
    rest = iter(range(256, 512))
    return [chr(b) if ok else chr(next(rest)) for b, ok in enumerate(printable)]


class WordEncoder:
    """Ids of a tokenizer that drops white space, so that a text's ids are those of its words end to end.

    The library encodes each distinct word; texts with a special token's string, or with a capital sigma (its
    lower case could depend on the word's end), go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.size = t.get_vocab_size()
        self.special = [x.content for x in t.get_added_tokens_decoder().values()]
        bar = t.encode("|", add_special_tokens=False).ids
        if len(bar) != 1 or t.encode("a \n\t b", add_special_tokens=False).ids != t.encode("a", add_special_tokens=False).ids + t.encode("b", add_special_tokens=False).ids:
            raise ValueError("the tokenizer must drop white space")
        self.joined = JoinedEncoder(t, " | ", bar[0], lambda w: "|" in w)
        # letters that normalising leaves or lower-cases one by one, as the characters that stand for their bytes
        of_bytes = byte_alphabet()
        self.letters = {ord(c): "".join(of_bytes[b] for b in c.lower().encode()) for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "ªºµ"}
        self.plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)").fullmatch
        self.stops = {"": b"", **{c: self.joined([c])[0] for c in ".,"}}
        sample = ["Straße", "Élan.", "a,", "ÿÞ", "the"]
        self.direct = True
        self.direct = self.encode_words(sample) == self.joined(sample)
        self.cache = WordCache(self.encode_words)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Words of Latin letters, perhaps with a stop, are one pre-token (and the stop another) and go to the
        library's merges directly; all others through its whole pipeline."""
        out: list = [None] * len(words)
        merge, letters, plain, stops = self.tokenizer.model.tokenize, self.letters, self.plain, self.stops
        if self.direct:
            for i, w in enumerate(words):
                if m := plain(w):
                    out[i] = array("I", [t.id for t in merge(m[1].translate(letters))]).tobytes() + stops[m[2]]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.joined([words[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        import pyarrow.compute as pc

        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring(texts, "Σ")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        words, codes, offsets = word_codes(pc.replace_substring(plain, "\n", " "), " ")
        flat, starts, lengths = ragged(self.cache.get(words))
        ids = ragged_take(flat, starts, lengths, codes)
        ends = np.concatenate(([0], np.cumsum(lengths[codes])))[offsets]
        if not odd.any():
            return ids, np.diff(ends)
        whole = {i: np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32).tobytes() for i in np.flatnonzero(odd).tolist()}
        rows = [whole[i] if i in whole else ids[a:b].tobytes() for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
        flat, _, lengths = ragged(rows)
        return flat, lengths


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, partitions: int | None = None) -> str:
    """Encode every text, end each document with ``end_id`` and write the folder; returns the folder.

    Documents are ranged by (doc_id, text), nulls first, so repeated ids and rows are all written, in a defined
    order. Null texts count as empty and have the end id alone. Empty tables give a folder without shards.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "tokens")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_of(docs))), F.lit(0))).first()[0]
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    # the hash spreads rows that share an id over range boundaries and orders them
    ranged = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        encoder = _encoder(tokenizer_path)
        width = 2 if max(encoder.size, end_id + 1) <= 1 << 16 else 4
        n_docs = n_tokens = 0
        files = {x: system.open_output_stream(f"{path}/{name}.{x}") for x in ("bin", "idx", "ids", "nul")}
        try:
            files["idx"].write(np.zeros(1, "<i8").tobytes())
            for whole in batches:
                for batch in slices(whole, "text"):
                    ids, lengths = encoder.encode(batch.column("text"))
                    ends = np.cumsum(lengths + 1)
                    out = np.full(int(ends[-1]), end_id, f"<u{width}")
                    inner = np.ones(len(out), bool)
                    inner[ends - 1] = False
                    out[inner] = ids
                    files["bin"].write(out.tobytes())
                    files["idx"].write((ends + n_tokens).astype("<i8").tobytes())
                    keys = batch.column("doc_id")
                    files["ids"].write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    files["nul"].write(keys.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
                    n_docs, n_tokens = n_docs + len(lengths), n_tokens + len(out)
        finally:
            for f in files.values():
                f.close()
        if n_docs:
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "name": [name], "width": [width], "n_docs": [n_docs], "n_tokens": [n_tokens]}, schema=pa.schema([("shard", pa.int64()), ("name", pa.string()), ("width", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ranged.select("doc_id", "text").mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    drop_orphans(spark, folder)
    return folder


def drop_orphans(spark: SparkSession, folder: str) -> int:
    """Delete the shard files of attempts that aren't in the manifest; returns how many there were."""
    from pyarrow import fs

    system, path = open_folder(folder)
    known = {r["name"] for r in spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("name").toLocalIterator()}  # a name for each shard
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    lost = [f.path for f in found if f.type == fs.FileType.File and f.base_name.partition(".")[0] not in known and f.extension in ("bin", "idx", "ids", "nul")]
    for f in lost:
        system.delete_file(f)
    return len(lost)


def shard_bases(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with the global number of each shard's first document and token."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    return shards.select("*", F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("token_base"))


class Shard:
    """The files of a shard: memory maps on a mounted store; elsewhere only what is asked for is read."""

    def __init__(self, folder: str, name: str, width: int):
        self.system, path = open_folder(folder)
        self.path, self.width = f"{path}/{name}", width

    def read(self, kind: str, dtype: str, first: int, last: int) -> np.ndarray:
        """Numbers first to last of a file."""
        from pyarrow import fs

        at, size = f"{self.path}.{kind}", np.dtype(dtype).itemsize
        if last <= first:
            return np.zeros(0, dtype)
        if isinstance(self.system, fs.LocalFileSystem):
            return np.memmap(at, dtype, "r", offset=first * size, shape=(last - first,))
        with self.system.open_input_file(at) as f:
            f.seek(first * size)
            return np.frombuffer(f.read((last - first) * size), dtype)

    def offsets(self, first: int, last: int) -> np.ndarray:
        return self.read("idx", "<i8", first, last + 1)

    def tokens(self, first: int, last: int) -> np.ndarray:
        return self.read("bin", f"<u{self.width}", first, last)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """What the files say of each document: ``doc_id, start, n_tokens, ids_crc32``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                files, n = Shard(folder, shard["name"], shard["width"]), shard["n_docs"]
                for a in range(0, n, 10_000):
                    b = min(a + 10_000, n)
                    offsets = files.offsets(a, b)
                    ids, null = files.read("ids", "<i8", a, b), files.read("nul", "u1", a, b)
                    crc = []
                    for c in range(0, b - a, 500):  # a piece of the tokens at a time
                        ends = offsets[c : c + 501] - offsets[c]
                        tokens = files.tokens(int(offsets[c]), int(offsets[min(c + 500, b - a)])).astype("<u4")
                        crc += [zlib.crc32(tokens[x:y]) for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(offsets[:-1] + shard["token_base"]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    bases = shard_bases(spark, folder)
    tasks = max(1, bases.count())
    spread = bases.select("name", "width", "n_docs", "token_base").repartition(tasks, "name")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(folder: str, name: str, width: int, document: int) -> np.ndarray:
    """Ids of one document of a shard, without reading the rest of it."""
    shard = Shard(folder, name, width)
    first, last = shard.offsets(document, document + 1)
    return shard.tokens(int(first), int(last))
