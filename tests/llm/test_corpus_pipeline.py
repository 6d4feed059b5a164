"""The pipeline, and each of its stages against a plain version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from specaudit.llm import quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WHITE = r"[ \t-\r]+"


def text(rng, n, base=100_000):
    return " ".join(f"w{rng.randrange(base)}" + ("." if k % 9 == 8 else "") for k in range(n)) + "."


def table(spark, folder, texts, item="no such passage anywhere in these documents"):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return docs


def test_pipeline_on_planted_documents(spark, tmp_path):
    rng = random.Random(0)
    clean = [text(rng, 120) for _ in range(20)]
    passage = text(rng, 60)
    item = text(rng, 30)
    near = clean[0].split()
    near[50] = "changed"
    # of the first of these, 55 words are a repeated passage and go, and what is left looks like no other document
    half = clean[2].split()
    half[56:57], half[90:91] = ["other"], ["words"]
    docs = dict(enumerate(clean))
    docs |= {100: clean[1], 101: " ".join(near), 102: text(rng, 80) + " " + passage, 103: text(rng, 80) + " " + passage + " " + text(rng, 50), 104: text(rng, 40) + " " + item, 105: "too short", 106: "again and again. " * 40, 107: None, 108: " ".join(half)}
    table(spark, tmp_path, docs.items(), item)
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(20)) | {102, 103}
    assert all(out[i]["text"] == clean[i] and out[i]["n_chars"] == len(clean[i]) for i in range(20))
    assert passage in out[102]["text"] and passage not in out[103]["text"]
    assert all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] > 0 for r in out.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]


def plain_quality(t):
    """The text that is left, or None."""
    words = lambda x: [w for w in re.split(WHITE, x) if w]
    w = words(t or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    again = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    if len(w) < 10 or 100 * len(again) > 20 * len(w):
        return None
    good = []
    for line in (t or "").split("\n"):
        lw, bare = words(line), "".join(words(line))
        phrase = len(lw) <= quality.PHRASE_LINE and re.search("(?:^|[^a-z0-9])(?:" + "|".join(quality.BOILERPLATE) + ")(?:$|[^a-z0-9])", line.lower())
        symbols = sum(c in quality.SYMBOLS for c in line)
        if not bare or not (line.count("|") >= 2 or 100 * symbols > 10 * len(bare) or phrase or (bare[-1] not in quality.END_MARKS and len(lw) < 5)):
            good.append(line)
    left = sum(len("".join(words(x))) for x in good)
    return "\n".join(good) if 100 * (len("".join(w)) - left) <= 50 * len("".join(w)) else None


def plain_passages(docs, passage=50, least=10):
    """Later occurrences of any 50 words cut out; of documents that lose some, those with too little left go."""
    seen, out = {}, {}
    for i, t in docs:
        found = [(m.start(), m[0]) for m in re.finditer(r"\S+", t)]
        at, words, cut = [a for a, _ in found] + [len(t)], [w for _, w in found], set()
        for k in range(len(words) - passage + 1):
            first = seen.setdefault(tuple(words[k : k + passage]), (i, at[k], at[k + passage]))
            if first[:2] != (i, at[k]):
                cut.update(range(max(at[k], first[2]) if i == first[0] else at[k], at[k + passage]))
        left = "".join(c for k, c in enumerate(t) if k not in cut)
        if not cut or len(left.split()) >= least:
            out[i] = left
    return out


def plain_groups(texts, percent=80):
    """Ids of documents that stay; texts holds the texts of each document."""

    def grams(t):
        w = [x for x in re.split(WHITE, t.lower()) if x]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: [grams(t) for t in ts] for i, ts in texts.items()}
    group = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and any(100 * len(a & b) >= percent * len(a | b) > 0 for a in sets[i] for b in sets[j]):
                old, new = group[j], group[i]
                group = {k: min(old, new) if g in (old, new) else g for k, g in group.items()}
    return {i for i, g in group.items() if i == min(k for k, h in group.items() if h == g)}


def test_every_stage_equals_a_plain_version(spark, tmp_path):
    import sentencepiece

    rng = random.Random(3)
    pool = [text(rng, rng.randint(55, 90), 3000) for _ in range(6)]
    junk = ["Home | About | Contact", "Click here to log in", "### *** $$$", "Menu", "All rights reserved.", "日本語の短い行。", ""]
    texts = []
    for i in range(90):
        kind = i % 6
        body = text(rng, rng.randint(5, 120), 3000)
        if kind == 1:
            body += "\n" + rng.choice(junk) + "\n" + text(rng, 20)
        if kind == 2:
            body += " " + rng.choice(pool) + " " + text(rng, rng.randint(1, 40))
        if kind == 3 and i > 10:
            w = texts[i - 3][1].split(" ")
            w[len(w) // 2] = "changed"
            body = " ".join(w)
        if kind == 4 and i > 10:
            body = texts[i - 7][1]
        texts.append((i, body))
    item = text(rng, 16)
    texts += [(90, text(rng, 60) + " " + item), (91, "a catalog in the analog inputs " * 3 + text(rng, 40)), (92, "Please click here. " + text(rng, 60))]
    docs = table(spark, tmp_path, texts, item)
    stages, d = dict(corpus_pipeline.STAGES), str(tmp_path)
    got = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    one = stages["quality_rules"](spark, docs, d)
    want = {i: x for i, t in texts if (x := plain_quality(t)) is not None}
    assert got(one) == want and len(want) < len(texts)
    two = stages["line_dedup"](spark, one, d)
    cut = plain_passages(sorted(want.items()))
    assert got(two) == cut and any(cut[i] != want[i] for i in cut)
    three = stages["near_duplicates"](spark, two, d)
    first = dict(texts)
    stay = plain_groups({i: [t, first[i]] for i, t in cut.items()})
    assert got(three) == {i: cut[i] for i in stay} and len(stay) < len(cut)
    four = stages["decontamination"](spark, three, d)
    assert set(got(four)) == stay - {90}
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    five = {r["doc_id"]: r for r in stages["sentencepiece"](spark, four, d).collect()}
    assert set(five) == stay - {90}
    assert all(r["ids"] == sp.encode(r["text"]) and r["text"] == cut[i] and r["n_chars"] == len(r["text"]) for i, r in five.items())


def test_stages_take_odd_tables(spark, tmp_path):
    """Columns with the names of the operators' own, nulls, repeated rows, long texts and empty tables."""
    long = text(random.Random(1), 30_000)
    rows = [(1, text(random.Random(2), 60)), (2, None), (3, ""), (4, long), (4, long), (None, text(random.Random(4), 50)), (None, None), (5, text(random.Random(5), 40)), (5, text(random.Random(6), 40))]
    docs = table(spark, tmp_path, rows)
    extra = ("kept", "clean_text", "n_removed", "row", "key", "starts", "ends", "c", "h", "label", "w", "own", "cid", "head")
    wide = docs
    for k, name in enumerate(extra):
        wide = wide.withColumn(name, F.lit(k))
    d = str(tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide.limit(0), d).count() == 0, name
        out = stage(spark, wide, d)
        assert out.columns == wide.columns, name
        found = out.collect()
        assert {r["doc_id"] for r in found} >= {1, 4, 5, None} and all(r[x] == k for r in found for k, x in enumerate(extra)), name
        if name in ("line_dedup", "decontamination"):
            assert len(found) == len(rows), name
        assert hashlib.sha256(long.encode()).digest() in {hashlib.sha256((r["text"] or "").encode()).digest() for r in found}, name
    last = corpus_pipeline.STAGES[-1][1](spark, wide.withColumn("ids", F.lit(1)), d)
    assert last.count() == len(rows) and last.columns.count("ids") == 1
    assert corpus_pipeline.STAGES[-1][1](spark, wide.limit(0), d).count() == 0
