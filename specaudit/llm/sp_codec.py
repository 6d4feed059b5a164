"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

One pass over a text's chunks: at each position the automaton gives all pieces that end there, longest first
and then along its output links, and each is relaxed against the best result at the place where it starts.

* A unigram model relaxes sums of scores (Viterbi).
* A BPE model's scores are merge ranks, and their sum does not give the ids of its merges. There the state of a
  position is the last piece of the encoding of the text up to it, and a piece is admitted if the merges leave
  it and the piece before it apart. Exactly one piece is admitted at each position, and following them back
  gives the merges' own encoding.

No piece has a space mark after another character, so encodings of chunks that start with a space mark are
independent, and each distinct chunk is encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches
from .wordcodes import WordCache, ragged, ragged_take, word_codes

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: What the library takes off the lowest score for a character without a piece.
UNKNOWN_PENALTY = 10.0
_CODECS: dict = {}


class PieceCodec:
    """Encoder and decoder for a model file; ``kind`` overrides the model's own type."""

    def __init__(self, path: str, kind: int | None = None):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only models that leave the text as it is are handled")
        self.kind = kind or model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are handled")
        types = pb.ModelProto.SentencePiece
        self.unknown, self.bytes, self.surface = 0, [-1] * 256, []
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i, p in enumerate(model.pieces):
            if p.type == types.USER_DEFINED:
                raise ValueError("user-defined pieces are not handled")
            if p.type == types.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == types.NORMAL:
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError("a piece spans words")
                self.id[p.piece], self.score[p.piece] = i, p.score
                self.surface.append(p.piece.replace(MARK, " ").encode())
            else:
                self.surface.append(model.trainer_spec.unk_surface.encode() if p.type == types.UNKNOWN else b"")
            if p.type == types.UNKNOWN:
                self.unknown = i
        self.piece = {i: p for p, i in self.id.items()}
        self.byte_fallback = min(self.bytes) >= 0
        self.low = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self.kind == UNIGRAM or len(p) == 1 or self.merge(p) == [p]:
                self.automaton.add_word(p, (i, len(p), self.score[p]))
        self.automaton.make_automaton()
        self.pairs: dict = {}
        self.cache = WordCache(lambda words: [np.array(self.encode_chunk(MARK + w), np.uint32).tobytes() for w in words], 150_000)
        self.longest = max((len(p) for p in self.id if not p.strip(MARK)), default=1)
        self.runs: dict[int, list[int]] = {}
        self.odd = f"  |^ | $|{MARK}"

    def merge(self, text: str) -> list[str]:
        """The model's merges, done one by one: the best adjacent pair that makes a piece, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[m], -k) for k in range(len(parts) - 1) if (m := parts[k] + parts[k + 1]) in self.score), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def apart(self, a: int, b: int) -> bool:
        """Whether the merges leave two pieces side by side as they are."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 250_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge((x := self.piece[a]) + (y := self.piece[b])) == [x, y]
        return found

    def fallback(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode()] if self.byte_fallback else [self.unknown]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a chunk: space marks, if any, then other characters."""
        n = len(chunk)
        last: list = [None] * (n + 1)  # id and length of the best piece that ends here; None: a character of its own
        reached = 1
        if self.kind == UNIGRAM:
            best = [0.0] + [-np.inf] * n
            single = [False] * n
            for end, (i, size, score) in self.automaton.iter(chunk):
                end += 1
                while reached < end:  # no piece ends there
                    self._unknown(best, last, single, reached)
                    reached += 1
                if reached == end:
                    self._unknown(best, last, single, end)
                    reached += 1
                total = best[end - size] + score
                if size == 1:
                    single[end - 1] = True
                    if last[end] is None:
                        best[end] = -np.inf  # a character with a piece is never unknown
                if total > best[end]:
                    best[end], last[end] = total, (i, size)
            while reached <= n:
                self._unknown(best, last, single, reached)
                reached += 1
        else:
            for end, (i, size, _) in self.automaton.iter(chunk):
                end += 1
                if last[end] is None:
                    start = end - size
                    before = last[start]
                    if before is None or self.apart(before[0], i):
                        last[end] = (i, size)
        out: list[list[int]] = []
        while n:
            if last[n] is None:
                n -= 1
                out.append(self.fallback(chunk[n]))
            else:
                out.append([last[n][0]])
                n -= last[n][1]
        return [i for ids in reversed(out) for i in ids]

    def _unknown(self, best: list, last: list, single: list, end: int) -> None:
        best[end], last[end] = best[end - 1] + self.low, None

    def spaces(self, n: int) -> list[int]:
        """Ids of n space marks alone."""
        if self.kind == UNIGRAM:
            return self.encode_chunk(MARK * n)
        longest = self.longest

        def ids(k: int) -> list[int]:
            if k not in self.runs:
                if len(self.runs) > 1000:
                    self.runs.clear()
                self.runs[k] = [i for p in self.merge(MARK * k) for i in ([self.id[p]] if p in self.id else self.fallback(p))]
            return self.runs[k]

        if n > 2 * longest and ids(2 * longest + n % longest) == 2 * ids(longest) + ids(n % longest) and len(ids(longest)) == 1:
            return ids(longest) * (n // longest) + ids(n % longest)
        return ids(n)

    def encode_odd(self, text: str) -> list[int]:
        """Ids of a text with runs of spaces, or with space marks of its own."""
        out: list[int] = []
        for chunk in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK)) if text else []:
            rest = chunk.lstrip(MARK)
            marks = len(chunk) - len(rest)
            if not rest:
                out += self.spaces(marks)
            elif self.kind == UNIGRAM:
                out += self.encode_chunk(chunk)
            else:
                ids = np.frombuffer(self.cache.get([rest])[0], np.uint32).tolist()
                if alone := ids[0] == self.id.get(MARK):
                    ids = ids[1:]
                out += (self.spaces(marks - 1 + alone) if marks - 1 + alone else []) + ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has; null and empty texts have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.or_(pc.match_substring_regex(texts, self.odd), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        words, codes, offsets = word_codes(pc.if_else(pa.array(odd), "", texts), " ")
        flat, starts, lengths = ragged(self.cache.get(words))
        ids = ragged_take(flat, starts, lengths, codes)
        ends = np.concatenate(([0], np.cumsum(lengths[codes])))[offsets]
        if not odd.any():
            return ids, np.diff(ends)
        rows = [np.array(self.encode_odd(texts[i].as_py()), np.uint32).tobytes() if odd[i] else ids[ends[i] : ends[i + 1]].tobytes() for i in range(len(texts))]
        flat, _, lengths = ragged(rows)
        return flat, lengths

    def decode(self, ids: list[int]) -> str:
        if not ids:
            return ""
        parts = itemgetter(*ids)(self.surface) if len(ids) > 1 else (self.surface[ids[0]],)
        return b"".join(parts).decode("utf-8", "replace").removeprefix(" ")


def codec(path: str, kind: int | None = None) -> PieceCodec:
    if (path, kind) not in _CODECS:
        _CODECS[path, kind] = PieceCodec(path, kind)
    return _CODECS[path, kind]


def encode_documents(docs: DataFrame, model_path: str, kind: int | None = None) -> DataFrame:
    """docs with ``ids array<int>``, ``n_tokens long`` and ``round_trip boolean`` (decoding gives the text back).

    A null text counts as empty: no ids, and a round trip. Rows, null ids, repeated rows and other columns stay
    as they are; columns of docs with the names of the new ones are replaced. No shuffle.
    """
    small_batches(docs.sparkSession)
    new = ("ids", "n_tokens", "round_trip")
    rows = docs.select(*(docs[c] for c in docs.columns if c not in new))
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    rows = rows.withColumn("text", F.col("text").cast("string"))
    schema["text"].dataType = T.StringType()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(model_path, kind)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                ids, lengths = model.encode(batch.column("text"))
                offsets = np.concatenate(([0], np.cumsum(lengths)))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                same = [model.decode(ids[a:b].tolist()) == (t or "") for a, b, t in zip(offsets.tolist(), offsets[1:].tolist(), batch.column("text").to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(lengths), pa.array(same)], [*batch.schema.names, *new])

    return rows.mapInArrow(encode, schema)


def decode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with ``text`` decoded from ``ids``; null ids give an empty text."""
    rows = docs.select(*(docs[c] for c in docs.columns if c != "text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(model_path)
        for b in batches:
            texts = pa.array([model.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "text"])

    return rows.mapInArrow(decode, schema)
