"""Vectorised work on the words of a batch of texts: code each distinct word once, then gather by code."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def word_codes(texts: pa.Array, separator: str | None = " ") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Split texts and code their words: distinct words, a code for each word, and offsets of the texts.

    With a separator, splitting keeps empty strings as ``str.split(separator)`` does. With None, words are
    runs of characters other than the six ASCII white-space characters.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    parts = pc.ascii_split_whitespace(texts) if separator is None else pc.split_pattern(texts, separator)
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary.to_pylist()
    offsets = np.asarray(parts.offsets, dtype=np.int64) - parts.offsets[0].as_py()
    if separator is None and "" in words:
        keep = codes != words.index("")
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
    return words, codes, offsets


def ragged(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of 32-bit ids laid end to end, with the start and length of each."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(rows) else lengths
    return np.frombuffer(b"".join(rows), np.uint32), starts, lengths


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The rows named by codes, laid end to end."""
    n = lengths[codes]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(starts[codes], n)]


def used_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """The distinct codes below n, in order, without a sort of all of them."""
    return np.flatnonzero(np.bincount(codes, minlength=n))


class JoinedEncoder:
    """The library's ids of many short strings, as bytes of 32-bit integers, encoded in few calls.

    Strings are joined by a separator that the tokenizer always gives as one token of its own and that no
    string holds; the ids are then cut at that token. Strings for which ``alone`` is true are encoded singly.
    """

    def __init__(self, tokenizer, separator: str, token: int, alone: Callable[[str], bool]):
        self.tokenizer, self.separator, self.token, self.alone = tokenizer, separator, token, alone

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        single = [i for i, t in enumerate(texts) if self.alone(t)]
        for i, e in zip(single, self.tokenizer.encode_batch_fast([texts[i] for i in single], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32).tobytes()
        rest = [i for i, x in enumerate(out) if x is None]
        for a in range(0, len(rest), 2000):
            some = rest[a : a + 2000]
            joined = self.separator.join([texts[i] for i in some]) + self.separator
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == self.token)
            if len(at) != len(some):
                raise ValueError("the separator is not a token of its own")
            before, raw = 0, ids.tobytes()
            for i, end in zip(some, at.tolist(), strict=True):
                out[i] = raw[4 * before : 4 * end]
                before = end + 1
        return out


class WordCache:
    """What a pure function gives for words, kept in two generations of at most ``size`` entries each.

    A full young generation becomes the old one; words that are met again move back. Memory is bounded and
    frequent words stay, in whatever order texts come.
    """

    def __init__(self, function: Callable[[list[str]], list], size: int = 250_000):
        self.function, self.size = function, size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, words: list[str]) -> list:
        young, old = self.young, self.old
        found = [young.get(w) for w in words]
        missing = []
        for i, value in enumerate(found):
            if value is None:
                value = old.get(words[i])
                if value is None:
                    missing.append(i)
                else:
                    found[i] = young[words[i]] = value
        if missing:
            new = [words[i] for i in missing]
            for i, w, value in zip(missing, new, self.function(new), strict=True):
                found[i] = young[w] = value
        if len(young) > self.size:
            self.old, self.young = young, {}
        return found
