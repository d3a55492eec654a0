"""Personal data by patterns, checksums and context, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    mark: what a text must match for the kind to be looked for at all. pattern: proposes spans, with possessive
    quantifiers so that no text costs more than linear time. valid: confirms a proposed string. prior: score of a
    confirmed span, to which words in the context before it add. base: kept whatever the score.
    """

    name: str
    mark: str
    pattern: str
    valid: Callable[[Column], Column]
    context: str
    prior: float
    base: bool


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def figures(x: Column) -> Column:
    """A string of digits as an array of numbers."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.substring(x, i, F.lit(1)).cast("int"))


def luhn(x: Column) -> Column:
    """From the right, every second digit counts double (its digits summed); the sum ends in 0."""
    weighted = F.transform(F.reverse(figures(x)), lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(weighted, F.lit(0), lambda total, d: total + d) % 10 == 0


def mod97(x: Column) -> Column:
    """ISO 7064: the first four characters go last, letters count from 10, and the number leaves 1 modulo 97."""
    chars = F.split(F.concat(F.substring(x, 5, 64), F.substring(x, 1, 4)), "")
    return F.aggregate(
        F.filter(chars, lambda c: c != ""),
        F.lit(0),
        lambda rest, c: F.when(c.between("0", "9"), (rest * 10 + c.try_cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97),
    ) == 1


def parts_at_most_255(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(9)).try_cast("int"), F.lit(0)) <= 255))


# Characters of an account number by country, from the public registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
#: The length follows from the country, so that what stands after a number isn't taken for a part of it.
IBAN = "|".join(rf"(?:{x.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, x in IBAN_LENGTHS.items())


# The kinds of the contract, in its order, then those that the method adds.
KINDS = (
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda x: F.lit(True), r"mail|contact|write to", 0.9, True),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+", parts_at_most_255, r"\bip\b|address|host|server", 0.7, True),
    Kind("card", r"[0-9](?:[ -]?[0-9]){13}", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", lambda x: luhn(digits(x)), r"card|visa|credit|pay", 0.8, True),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", lambda x: F.length(digits(x)).between(10, 15), r"tel|phone|call|mobile|fax", 0.6, True),
    Kind("iban", r"[A-Z]{2}[0-9]{2}", rf"(?<![A-Za-z0-9])(?:{IBAN})(?![A-Za-z0-9])", lambda x: mod97(F.regexp_replace(x, " ", "")), r"iban|account|bank", 0.6, False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda x: F.lit(True), r"\bssn\b|social security", 0.2, False),
)
#: What a context word adds to a score, the characters before a span (back to the one before it) that are searched, and
#: the score of a span that counts.
CONTEXT_GAIN, CONTEXT_CHARS, LEAST_SCORE = 0.4, 48, 0.5
#: Ends of matches are summed in blocks of so many, so that a text with very many matches doesn't cost their square.
BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)


def spans_of(text: Column, rank: int, kind: Kind) -> Column:
    """The kind's confirmed spans as array<struct<start, rank, end, kind, score>>, in code points.

    The pieces between matches (split) and the matches themselves (regexp_extract_all) alternate, so their lengths give
    the places.
    """
    found = F.struct(F.split(text, kind.pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits"))

    def placed(x: Column) -> Column:
        steps = F.transform(x["hits"], lambda hit, i: (F.length(hit) + F.length(F.get(x["between"], i))).cast("long"))
        return let(F.struct(x["hits"].alias("hits"), x["between"].alias("between"), steps.alias("steps")), in_blocks)

    def in_blocks(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["hits"]) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(x["steps"], b * BLOCK + 1, F.lit(BLOCK))))
        return let(F.struct(x["hits"].alias("hits"), x["between"].alias("between"), x["steps"].alias("steps"), blocks.alias("blocks")), ends)

    def ends(x: Column) -> Column:
        def end(i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            return total(F.slice(x["blocks"], F.lit(1), b)) + total(F.slice(x["steps"], b * BLOCK + 1, i % BLOCK + 1))

        return F.transform(x["hits"], lambda hit, i: F.struct(hit.alias("hit"), end(i).alias("end"), F.right(F.get(x["between"], i), F.lit(CONTEXT_CHARS)).alias("before")))

    def scored(x: Column) -> Column:
        start = x["end"] - F.length(x["hit"])
        score = F.least(F.lit(kind.prior) + F.when(F.lower(x["before"]).rlike(kind.context), CONTEXT_GAIN).otherwise(0.0), F.lit(1.0))
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))

    every = let(found, lambda x: F.when(F.size(x["hits"]) > 0, placed(x)))
    spans = F.transform(F.filter(every, lambda x: kind.valid(x["hit"])), scored)
    spans = spans if kind.base else F.filter(spans, lambda x: x["score"] >= LEAST_SCORE)
    none = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, kind: string, score: double>>")
    return F.coalesce(F.when(text.rlike(kind.mark), spans), none)


def counted(name: str) -> Column:
    return F.size(F.filter("found", lambda x: x["kind"] == name)).cast("long")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data in each whole text: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found.

    found holds (start, rank, end, kind, score) of every span by start and kind, in code points, ends exclusive; base
    kinds count whatever their score, the added ones (iban by mod 97, ssn by its context) from a score of 0.5.

    A null text counts as empty; a null doc_id stays null; repeated rows are searched each for itself; other columns
    are ignored. All of it is one projection: nothing is shuffled and nothing leaves the JVM.
    """
    text = F.col("text")
    spans = F.array_sort(F.concat(*(spans_of(text, rank, kind) for rank, kind in enumerate(KINDS))))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).select("doc_id", spans.alias("found"))
    base = F.filter("found", lambda x: x["rank"] < sum(kind.base for kind in KINDS))
    counts = [counted(kind.name).alias(f"n_{kind.name}") for kind in KINDS if kind.base]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "found")
