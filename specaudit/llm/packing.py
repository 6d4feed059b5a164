"""Packing of documents into sequences of a fixed number of tokens, by sums of squares.

Every document's ids end with an end id; only documents longer than a sequence are cut, into pieces as long as a
sequence. Pieces are dealt into shards of like size by their row numbers, so neither a key nor a group of copies meets in one task, and
each shard is packed by one task from the lengths of its pieces alone. A piece goes, the longest first, into that open
sequence whose choice makes the sum of the squared counts of open sequences over all gaps smallest; of equal ones into
that with the smallest gap. A new sequence is opened only when no open one has room, for in decreasing order it
would take the place of gaps that later, shorter pieces fill. A shard wastes what its last one or two open sequences lack, some
0.03 % of a shard, at any size of the table.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, small_batches, text_of
from .token_files import WordEncoder

#: Pieces that one task packs together.
SHARD_PIECES = 10_000


@functools.cache
def _encoder(path: str) -> WordEncoder:
    """A worker's encoder of a tokenizer file."""
    return WordEncoder(path)


def cut_ends(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of so many ids, cut: for each piece the document's place, the piece's number and its length."""
    pieces = -(-lengths // capacity)
    document = np.repeat(np.arange(len(lengths)), pieces)
    number = np.arange(len(document)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return document, number, np.minimum(capacity, lengths[document] - number * capacity)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if wanted, ``ids array<long>``, a row for each piece.

    ``start`` counts the document's ids before the piece. Null texts count as empty: their only id is the end id. Repeated ids and
    rows are documents of their own.
    """
    if capacity < 1:
        raise ValueError("a sequence must hold one token at least")
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, lengths = encoder.encode(batch.column("text"))
                ends = np.cumsum(lengths + 1)
                flat = np.full(int(ends[-1]), end_id, "<u4")
                inner = np.ones(len(flat), bool)
                inner[ends - 1] = False
                flat[inner] = ids
                document, number, length = cut_ends(lengths + 1, capacity)
                stops = np.cumsum(length)  # pieces lie end to end, as documents do
                memory = memoryview(flat.tobytes())
                crc = [zlib.crc32(memory[a:b]) for a, b in zip(((stops - length) * 4).tolist(), (stops * 4).tolist(), strict=True)]
                columns = [batch.column("doc_id").take(pa.array(document)), pa.array(number, pa.int32()), pa.array(number * capacity, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stops)), pa.int32()), pa.array(flat, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    names = [k.split()[0] for k in kinds.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(cut, kinds)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece of the lengths given (from 1 to capacity), the longest placed first.

    ``open_[g]`` counts the open sequences with gap g. A piece of length s that goes into gap g changes the sum of squares
    by 2 (open_[g - s] - open_[g] + 1), or by 1 - 2 open_[g] where it fills the gap, since full sequences do not count.
    """
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_ = np.zeros(capacity, np.int64)
    with_gap: dict[int, list[int]] = defaultdict(list)
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        gap = capacity
        if s < capacity:
            there = np.flatnonzero(open_[s:])
            if len(there):
                change = 2 * (open_[there] - open_[there + s] + 1)
                if there[0] == 0:
                    change[0] = 1 - 2 * open_[s]
                gap = int(there[change.argmin()]) + s
        if gap == capacity:
            at, n = n, n + 1
        else:
            at = with_gap[gap].pop()
            open_[gap] -= 1
        sequence[i], offset[i] = at, capacity - gap
        if gap > s:
            with_gap[gap - s].append(at)
            open_[gap - s] += 1
    return sequence, offset


def place(cut: DataFrame, capacity: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces (``length`` and any other columns) with ``sequence_id`` and ``offset``, their place in it.

    Pieces as long as a sequence are one by themselves and aren't dealt. Each shard's rows are known by numbers written with them, so a task that
    runs again packs the same rows the same way. Of an ``ids`` column nothing is sent to the shards: places are joined with it by row.
    """
    if clash := {"sequence_id", "offset", "row_", "shard_"} & set(cut.columns):
        raise ValueError(f"columns {sorted(clash)} are names of the result")
    numbered = materialise(cut.withColumn("row_", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-numbered.filter(F.col("length") < capacity).count() // shard_pieces))
    light = numbered.drop("ids")
    whole = light.filter(F.col("length") >= capacity).select("*", (F.col("row_") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = light.filter(F.col("length") < capacity).withColumn("shard_", F.pmod(F.xxhash64("row_"), F.lit(shards)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["row_"].to_numpy())))
        sequence, offset = sum_of_squares(table["length"].to_numpy(), capacity)
        ids = ((int(table["shard_"][0].as_py()) << 32) + sequence) * 2 + 1
        return table.drop_columns(["shard_"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in light.schema) + ", sequence_id long, offset long"
    placed = whole.unionAll(rest.groupBy("shard_").applyInArrow(pack, schema))
    if "ids" in cut.columns:
        placed = placed.join(numbered.select("row_", "ids"), "row_")
    return placed.drop("row_")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``): where each piece of each document lies.

    An empty table gives no pieces. Other columns of docs are not carried.
    """
    return place(pieces(docs, tokenizer_path, end_id, capacity, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, input_ids array<long>, doc_ids array<long>, starts array<long>``: the sequences to train on, from packed
    pieces with their ids. A sequence has as many rows as it has documents, at most its capacity. ``starts`` are the offsets of its
    documents, for attention that must not cross them."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), rows.alias("p_")).select("sequence_id", "n_tokens", F.flatten(F.col("p_.ids")).alias("input_ids"), F.col("p_.doc_id").alias("doc_ids"), F.col("p_.offset").alias("starts"))
