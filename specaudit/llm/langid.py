"""Language identification with unigram piece models that sum over all segmentations.

Each language has probabilities for the pieces of a fixed public vocabulary. A word's likelihood in a language is the
sum over every way to cut it into pieces, which a forward pass gives: alpha[j] = sum of alpha[i] * p(piece i..j) over
the pieces that end at j. An Aho-Corasick automaton finds those pieces, and all languages and all distinct words of a
batch go through the pass together. The probabilities are learned from the words of labelled texts in the same way:
from longest-match counts, EM_STEPS rounds of expected counts over all segmentations, forwards and backwards.

A group of the learning holds one language's distinct words; models are used in blocks of BLOCK_LANGUAGES, of which
a worker holds one at a time, so any number of languages is taken.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, slices, small_batches
from .wordcodes import WordCache, used_codes, word_codes

MARK = "▁"
UNKNOWN = "und"
#: Labelled texts that a language's model is fitted on: of more, about so many are taken by a hash of their ids.
MAX_TEXTS_PER_LANGUAGE = 4_000
#: Languages whose probabilities (a number for each piece) the driver and a worker hold at a time.
BLOCK_LANGUAGES = 200
#: Rounds of expected counts after the first ones.
EM_STEPS = 2
#: Added to each piece's count, and the probability of a character without a piece.
SMOOTHING = 0.1
UNSEEN = 1e-9
#: Characters times languages that go through a forward pass together, and characters between rescalings of its sums.
CELLS = 1_600_000
RESCALE = 8


def fold(doc_id: Column) -> Column:
    """The remainder that splits documents: 2 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def _clean(texts: pa.Array) -> pa.Array:
    """Lower-cased, with everything but letters and marks as spaces."""
    return pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), r"[^\p{L}\p{M}]+", " ")


def vocabulary(path: str) -> list[str]:
    """Pieces with letters only, after a word mark or not; the position in this list is the piece's number."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return sorted(p for p in pieces if p == MARK or p.removeprefix(MARK).isalpha())


def automaton_of(pieces: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, p in enumerate(pieces):
        found.add_word(p, (k, len(p)))
    found.make_automaton()
    return found


def matches(automaton, words: list[str]) -> tuple[np.ndarray, ...]:
    """Word, start, end and piece of every match in the words with their marks."""
    text = "".join(MARK + w for w in words)
    found = np.array([(end + 1, size, k) for end, (k, size) in automaton.iter(text)], np.int64).reshape(-1, 3)
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    base = np.cumsum(lengths) - lengths
    word = np.searchsorted(base, found[:, 0], "left") - 1
    end = found[:, 0] - base[word]
    return word, end - found[:, 1], end, found[:, 2]


def expected_counts(automaton, words: list[str], times: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How often each piece is used in all segmentations of words that occur so many times, weighted by their probabilities.

    Forwards and backwards in logarithms, words of like length together.
    """
    total, logs = np.zeros(len(p)), np.log(p)
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    a = 0
    for b in range(1, len(order) + 1):
        if b < len(order) and (b + 1 - a) * (len(words[order[b]]) + 1) <= CELLS // 4:
            continue
        some = [words[k] for k in order[a:b]]
        word, start, end, piece = matches(automaton, some)
        lengths = np.fromiter((len(w) + 1 for w in some), np.int64, len(some))
        longest = int(lengths.max())
        # characters without a piece of their own are cut off alone
        bare = np.arange(1, longest + 1) <= lengths[:, None]
        bare[word[end - start == 1], end[end - start == 1] - 1] = False
        w0, e0 = np.nonzero(bare)
        w, s, e = np.concatenate((word, w0)), np.concatenate((start, e0)), np.concatenate((end, e0 + 1))
        arc = np.concatenate((logs[piece], np.full(len(w0), np.log(UNSEEN))))
        forward, backward = np.full((2, len(some), longest + 1), -np.inf)
        forward[:, 0] = 0.0
        backward[np.arange(len(some)), lengths] = 0.0
        for table, here, there, steps in ((forward, e, s, range(1, longest + 1)), (backward, s, e, range(longest - 1, -1, -1))):
            by = np.lexsort((w, here))
            cuts = np.searchsorted(here[by], np.arange(longest + 2))
            for j in steps:
                at = by[cuts[j] : cuts[j + 1]]
                if len(at):
                    first = np.flatnonzero(np.diff(w[at], prepend=-1))
                    table[w[at][first], j] = np.logaddexp.reduceat(table[w[at], there[at]] + arc[at], first)
        share = np.exp(forward[word, start] + logs[piece] + backward[word, end] - forward[word, lengths[word]])
        total += np.bincount(piece, weights=share * times[order[a:b]][word], minlength=len(p))
        a = b
    return total


class ForwardModel:
    """Word scores: log likelihoods in each language, by the forward pass."""

    def __init__(self, pieces: list[str], probabilities: np.ndarray, automaton=None):
        self.p = probabilities  # pieces x languages
        self.longest = max(map(len, pieces), default=1)
        self.automaton = automaton or automaton_of(pieces)
        self.cache = WordCache(self.score, 480_000 // max(4, probabilities.shape[1]))

    def score(self, words: list[str]) -> list[np.ndarray]:
        """Log likelihoods of words of any length, those of like length together."""
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        out = np.zeros((len(words), self.p.shape[1]))
        a = 0
        for b in range(1, len(order) + 1):
            if b == len(order) or (b + 1 - a) * (len(words[order[b]]) + 1) * max(4, self.p.shape[1]) > CELLS:
                out[order[a:b]] = self._forward([words[k] for k in order[a:b]])
                a = b
        return list(out)

    def _forward(self, words: list[str]) -> np.ndarray:
        word, start, end, piece = matches(self.automaton, words)
        lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        single = np.zeros((len(words), lengths.max() + 1), bool)
        single[word[end - start == 1], end[end - start == 1]] = True
        rows = self.longest + 1  # no piece looks further back
        alpha = np.zeros((rows, len(words), self.p.shape[1]))
        alpha[0] = 1.0
        scale, out = np.zeros(alpha.shape[1:]), np.zeros(alpha.shape[1:])
        order = np.argsort(end, kind="stable")
        word, start, end, piece = word[order], start[order], end[order], piece[order]
        cuts = np.searchsorted(end, np.arange(lengths.max() + 2))
        for j in range(1, lengths.max() + 1):
            w, s, k = word[cuts[j] : cuts[j + 1]], start[cuts[j] : cuts[j + 1]], piece[cuts[j] : cuts[j + 1]]
            by_word = np.argsort(w, kind="stable")
            w, terms = w[by_word], (alpha[s % rows, w] * self.p[k])[by_word]
            new = np.where(single[:, j, None], 0.0, alpha[(j - 1) % rows] * UNSEEN)
            if len(w):
                first = np.flatnonzero(np.diff(w, prepend=-1))
                new[w[first]] += np.add.reduceat(terms, first, axis=0)
            alpha[j % rows] = new
            done = lengths == j
            if done.any():
                out[done] = np.log(np.maximum(new[done], 1e-300)) + scale[done]
            if j % RESCALE == 0:
                by = np.where((lengths > j)[:, None] & (new > 0), new, 1.0)
                alpha /= by
                scale += np.log(by)
        return out

    def totals(self, texts: pa.Array) -> np.ndarray:
        """Log likelihoods of texts in each language."""
        words, codes, offsets = word_codes(_clean(texts), None)
        n = np.diff(offsets)
        sums = np.zeros((len(n), self.p.shape[1]))
        if len(codes):
            used = used_codes(codes, len(words))
            table = np.zeros((len(words), self.p.shape[1]))
            table[used] = self.cache.get([words[c] for c in used.tolist()])
            sums[n > 0] = np.add.reduceat(table[codes], offsets[:-1][n > 0], axis=0)
        return sums


def has_letters(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(texts.cast(pa.large_string()).fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)


def learn(docs: DataFrame, model_path: str, max_texts: int = MAX_TEXTS_PER_LANGUAGE) -> tuple[list[str], list[str], DataFrame]:
    """Languages, pieces, and a table ``language, piece, n`` of expected counts, from labelled documents that aren't held out.

    Documents with a null text or lang teach nothing; those with a null id do. The table has a language by its number.
    """
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(fold(F.col("doc_id")) != 2, F.lit(True))).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = materialise(labelled.groupBy("lang").count(), "languages")
    languages = sorted(r["lang"] for r in sizes.select("lang").toLocalIterator())  # names alone
    pieces = vocabulary(model_path)
    scale = 1 << 20
    share = F.least(F.lit(scale), F.ceil(F.lit(max_texts * scale) / F.col("count")))
    taken = labelled.join(sizes, "lang").filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(scale)) < share).select("lang", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                for lang in pc.unique(batch.column("lang")).to_pylist():
                    found, codes, _ = word_codes(_clean(batch.column("text").filter(pc.equal(batch.column("lang"), lang))), None)
                    n = np.bincount(codes, minlength=len(found))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(n.astype(np.int64))], ["lang", "word", "n"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        own, times = table["word"].to_pylist(), table["n"].to_numpy()
        known = {p: k for k, p in enumerate(pieces)}
        longest = max(map(len, pieces), default=1)
        counts = np.zeros(len(pieces))
        for w, n in zip(own, times.tolist(), strict=True):
            w, i = MARK + w, 0
            while i < len(w):
                size = next((x for x in range(min(longest, len(w) - i), 0, -1) if w[i : i + x] in known), 0)
                if size:
                    counts[known[w[i : i + size]]] += n
                i += size or 1
        automaton = automaton_of(pieces)
        for _ in range(EM_STEPS):
            p = counts + SMOOTHING
            counts = expected_counts(automaton, own, times, p / p.sum())
        at = np.flatnonzero(counts > 1e-6)
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(at), pa.string()), "piece": pa.array(at, pa.int64()), "n": pa.array(np.round(counts[at], 6))})

    found = taken.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return languages, pieces, materialise(found.groupBy("lang").applyInArrow(fit, "lang string, piece long, n double"), "pieces")


def blocks_of(languages: list[str], pieces: list[str], counts: DataFrame, size: int = BLOCK_LANGUAGES) -> Iterator[tuple[list[str], np.ndarray]]:
    """Names and probabilities (pieces x languages) of so many languages at a time."""
    for names in batched(languages, size):
        p = np.full((len(pieces), len(names)), SMOOTHING)
        place = {x: k for k, x in enumerate(names)}
        for r in counts.filter(F.col("lang").between(names[0], names[-1])).toLocalIterator():
            p[r["piece"], place[r["lang"]]] += r["n"]
        yield list(names), p / p.sum(0)


_MODELS: dict = {}


def identify(docs: DataFrame, model_path: str, max_texts: int = MAX_TEXTS_PER_LANGUAGE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, a row for each row of docs.

    A null text, or one without letters, is ``und`` with score 0, as is everything if there is nothing to learn
    from. A null id isn't held out. Repeated rows are kept; lang, source and doc_id are no inputs of a prediction.
    Of languages that fit equally well the first by name counts.
    """
    spark = docs.sparkSession
    languages, pieces, counts = learn(docs, model_path, max_texts)
    key = uuid.uuid4().hex  # a worker keeps a model, and its cache of words, from task to task
    vocabulary_ = spark.sparkContext.broadcast(pieces)
    sent = [spark.sparkContext.broadcast(block) for block in blocks_of(languages, pieces, counts, BLOCK_LANGUAGES)]
    release(counts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def model_of(k: int) -> tuple[list[str], ForwardModel]:
        if (key, k) not in _MODELS:
            automaton = next((m.automaton for (x, _), (_, m) in _MODELS.items() if x == key), None)
            _MODELS.clear()
            names, p = sent[k].value
            _MODELS[key, k] = names, ForwardModel(vocabulary_.value, p, automaton)
            if len(sent) > 1:
                sent[k].__dict__.pop("_value", None)  # read again when its turn comes
        return _MODELS[key, k]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = batch.column("text")
                labels = np.full(len(texts), UNKNOWN, object)
                best, mass = np.full(len(texts), -np.inf), np.zeros(len(texts))
                for k in range(len(sent)):
                    names, model = model_of(k)
                    sums = model.totals(texts)
                    top = np.maximum(best, sums.max(1))
                    mass = mass * np.exp(np.where(mass > 0, best - top, 0.0)) + np.exp(sums - top[:, None]).sum(1)
                    labels = np.where(sums.max(1) > best, np.array(names, object)[sums.argmax(1)], labels)
                    best = top
                known = has_letters(texts) & (mass > 0)
                labels, score = np.where(known, labels, UNKNOWN), np.where(known, 1 / np.maximum(mass, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(labels.tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
