"""Personal data in texts, as DataFrame expressions only.

Regular expressions propose spans; validators (Luhn, mod 97, ranges, digit counts) confirm them; words nearby add
to a span's score or take from it. Spans of the base kinds are reported whatever their score; those of the added
kinds count from MIN_SCORE, and words nearby can lift or lower each kind across it. Expressions are written so that the regex engine never goes back
over a long run of characters (possessive repeats, and starts only where a run starts or a match ended); they
match what the plain forms named beside them match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Characters on both sides that are searched for context words, and the score (of 100) from which a span counts.
CONTEXT = 40
MIN_SCORE = 50
SPAN = "struct<start:int,rank:int,kind:string,end:int,score:int>"
#: Fixed words that speak against real data.
DOUBT = "example|sample|dummy|placeholder|fake|test"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.reverse(F.split(number, "")), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code (country, check digits, account) leaves 1 modulo 97 in its numeric form."""
    bare = F.regexp_replace(code, " ", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(a: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (a * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.length(bare).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


def small_parts(address: Column) -> Column:
    """Whether all parts of a dotted number are at most 255."""

    def fits(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return (F.length(bare) <= 3) & (F.when(F.length(bare) <= 3, bare).otherwise("999").cast("int") <= 255)

    return F.forall(F.split(address, "[.]"), fits)


@dataclass(frozen=True)
class Kind:
    name: str
    regex: str
    #: Cheap test that a text can hold a match at all.
    possible: Callable[[Column], Column]
    valid: Callable[[Column], Column] | None = None
    #: Score of 100 without context, and what context words (regexes on lower-cased text) add to it or take from it.
    score: int = 60
    context: str = ""
    bonus: int = 30
    doubt: str = DOUBT
    malus: int = 30


#: Base kinds, in the order in which spans with one start are listed.
BASE = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), score=90, context="mail|contact|write to", bonus=10),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), small_parts, context="host|server|address|login", doubt="version|release|firmware|section"),
    # [0-9]([\x20-]?[0-9])+, 14 to 19 digits passing Luhn
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), lambda m: F.length(digits(m)).between(14, 19) & luhn(digits(m)), score=70, context="card|visa|credit|payment|karte|tarjeta|carte"),
    # \+[0-9][\x20().0-9-]+[0-9], 10 to 15 digits
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]"), lambda m: F.length(digits(m)).between(10, 15), score=70, context="phone|call|tel|mobile|fax"),
)
#: Kinds that the method adds.
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), mod97, 60, "iban|account|konto|compte|cuenta|bank"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda m: ~m.rlike("^(?:000|666|9)|^...-00|-0000$"), 30, "ssn|social security|tax id", 50),
    Kind("secret", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:\b(?:password|passwd|secret|token|api[_-]?key)\b)\x20?[=:]\x20?[\x22']?[A-Za-z0-9+/_.-]{8,}", lambda t: t.contains("AKIA") | t.rlike("(?i)password|passwd|secret|token|api[_-]?key"), None, 70, "login|credential|aws", 20),
)


def _spans_of(k: Kind, rank: int) -> Column:
    """The spans of one kind, from its matches and the texts between them."""
    m, g = F.col(f"m_{k.name}_"), F.col(f"g_{k.name}_")
    none = F.array().cast(f"array<{SPAN}>")

    end_of = lambda x, n: F.substring(F.coalesce(x, F.lit("")), -n, n)

    def step(a: Column, i: Column) -> Column:
        match = F.get(m, i)
        start = a["at"] + F.length(F.get(g, i))
        end = start + F.length(match)
        # what stands beside it, back to the match before the last and on to the next one
        before = end_of(F.concat(end_of(F.get(g, i - 1), CONTEXT), end_of(F.get(m, i - 1), CONTEXT), end_of(F.get(g, i), CONTEXT)), CONTEXT)
        around = F.lower(F.concat(before, match, F.substring(F.get(g, i + 1), 1, CONTEXT)))
        score = F.lit(k.score) + F.when(around.rlike(k.context), k.bonus).otherwise(0) - F.when(around.rlike(k.doubt), k.malus).otherwise(0)
        ok = (F.lit(rank < len(BASE)) | (score >= MIN_SCORE)) & (k.valid(match) if k.valid else F.lit(True))
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(k.name).alias("kind"), end.alias("end"), score.alias("score")))
        return F.struct(end.alias("at"), F.when(ok, F.concat(a["out"], one)).otherwise(a["out"]).cast(f"array<{SPAN}>").alias("out"))

    first = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(F.size(m) > 0, F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), first, step, lambda a: a["out"])).otherwise(none)


def _count(rank: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")


def find_spans(text: Column, docs: DataFrame, kinds: tuple[Kind, ...] = (*BASE, *ADDED)) -> DataFrame:
    """docs with ``spans``: an array of (start, rank, kind, end, score) by start, then kind; ends are exclusive.

    Starts and ends count code points. Spans of one kind do not overlap; those of different kinds can.
    """
    names = [n for n in docs.columns if n not in ("t_", "spans")]
    t = docs.select(*names, text.alias("t_"))
    empty = F.array().cast("array<string>")
    for k in kinds:
        could = k.possible(F.col("t_"))
        t = t.withColumn(f"m_{k.name}_", F.when(could, F.regexp_extract_all("t_", F.lit(k.regex), F.lit(0))).otherwise(empty))
    # the texts between matches say where these start
    t = t.select("*", *(F.when(F.size(f"m_{k.name}_") > 0, F.split("t_", k.regex, -1)).otherwise(empty).alias(f"g_{k.name}_") for k in kinds))
    spans = [_spans_of(k, rank) for rank, k in enumerate(kinds)]
    return t.select(*names, F.array_sort(F.concat(*spans)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, n_ssn, n_secret, max_score,
    has_personal_data``, a row for each row of docs.

    A span's score (0 to 1) comes from its kind and the words nearby; has_personal_data says that one is at least
    MIN_SCORE. A null text counts as empty and has no spans, and max_score 0. Null ids and repeated rows are kept;
    other columns are not read. No shuffle.
    """
    found = find_spans(F.col("text"), docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    counts = [_count(rank).alias(f"n_{k.name}") for rank, k in enumerate((*BASE, *ADDED))]
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0))
    out = found.select("doc_id", *counts[: len(BASE)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *counts[len(BASE) :], best.alias("best"))
    return out.select("*", (F.col("best") / 100.0).alias("max_score"), (F.col("best") >= MIN_SCORE).alias("has_personal_data")).drop("best")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of their texts replaced by its kind in angle brackets; of overlapping spans the first counts."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"].cast("string").alias("text"))
    found = find_spans(F.coalesce("text", F.lit("")), rows)

    def step(a: Column, s: Column) -> Column:
        text = F.col("text")
        free = s["start"] >= a["at"]
        piece = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.when(free, s["end"]).otherwise(a["at"]).alias("at"), F.when(free, piece).otherwise(a["out"]).alias("out"))

    end = lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))
    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, end)
    new = F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))
    return found.select(*(new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
