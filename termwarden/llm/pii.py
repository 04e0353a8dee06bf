"""Personal data by patterns, checksums and the words around them.

Patterns propose maximal spans; what a span's text has to fulfil (numbers in range, a
count of digits, the Luhn sum of cards and personal numbers, mod-97 of account numbers)
confirms it, else it is dropped; words just before and after it raise or lower its score.
Emails, addresses, cards and phone numbers are base spans and stay whatever their score.
Account numbers, social security numbers, personal numbers and phone numbers without a
country code are added if their score reaches `LEAST_SCORE` and they touch no base span
and none that begins before them. A proposal that fails is not tried again at another place.

Patterns are written so that a run of characters is tried once, where it begins: cost is
linear in the text, also for long runs of digits. Spans are `kind:start:end` in code
points, the end exclusive, by start and then in the order of `KINDS`. All of it is one
projection in column expressions. Null and empty texts have no spans; repeated rows are
scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwarden.llm.spans import located, scan, written

#: Characters before and after a span that are searched for words.
BEFORE, AFTER = 48, 24
LEAST_SCORE = 60


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, and what being proposed, confirmed and named is worth."""

    name: str
    pattern: str
    proposed: int
    confirmed: int
    named: int
    words: str


#: The base patterns, with runs tried at their start only.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
SSN = r"(?<![0-9])[0-9]++-[0-9]++-[0-9]++"
PERSONAL = r"[0-9]{6}(?:[0-9]{2})?[-+]?[0-9]{4}"
LOCAL_PHONE = r"\(?[0-9]{3}\)?[-.\x20]{0,2}[0-9]{3}[-.\x20][0-9]{4}"

KINDS = (
    Kind("email", EMAIL, 60, 30, 10, r"e-?mail|contact|kontakt|write|address"),
    Kind("ip", IP, 40, 30, 20, r"\bip\b|host|server|addr|login"),
    Kind("card", CARD, 40, 40, 20, r"card|visa|master|amex|karte|kort|carte|tarjeta|payment"),
    Kind("phone", PHONE, 50, 30, 20, r"tel|phone|call|mobil|fax|whatsapp|ring|anruf"),
    Kind("iban", IBAN, 20, 50, 20, r"iban|account|bank|konto|compte|cuenta"),
    Kind("ssn", SSN, 25, 15, 35, r"ssn|social security|tax"),
    Kind("personal", PERSONAL, 20, 25, 30, r"personnummer|personal (?:id|number)|born|identity|id no"),
    Kind("local_phone", LOCAL_PHONE, 25, 15, 30, r"tel|phone|call|mobil|fax|whatsapp|ring|anruf"),
)
NAMES = tuple(kind.name for kind in KINDS)
BASE = 4

#: Words that speak against a span, and what they cost.
AGAINST, LESS = r"order|invoice|article|isbn|serial|version|sku|part no|item no", 25

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""
    reverse = F.split(F.reverse(digits), "", F.length(digits))

    def counted(digit: Column, place: Column) -> Column:
        doubled = (F.ascii(digit) - 48) * (place % 2 + 1)
        return doubled - F.when(doubled > 9, 9).otherwise(0)

    return F.aggregate(F.transform(reverse, counted), F.lit(0), lambda total, d: total + d) % 10 == 0


def mod_97(value: Column) -> Column:
    """The remainder by 97 of an account number, its first four characters moved to the end."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(rest: Column, character: Column) -> Column:
        code = F.ascii(character)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, "", F.length(moved)), F.lit(0), step)


def _sized(digits: Column, least: int, most: int) -> Column:
    return F.length(digits).between(least, most)


def _alone(match: Column) -> Column:
    """Whether no letter or digit stands right before or after."""
    beside = F.concat(F.right(match["before"], F.lit(1)), F.left(match["after"], F.lit(1)))
    return ~beside.rlike("[A-Za-z0-9]")


def _confirmed(name: str, match: Column) -> Column:
    """Whether the text of a proposed span fulfils what its kind asks for."""
    value = match["value"]
    digits = digits_of(value)
    if name == "email":
        return F.lit(True)
    if name == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if name == "card":
        return _sized(digits, 12, 19) & luhn(digits)
    if name == "phone":
        return _sized(digits, 9, 15)
    if name == "iban":
        return _alone(match) & (mod_97(value) == 1)
    if name == "ssn":
        allowed = r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"
        return value.rlike(allowed) & _alone(match)
    if name == "personal":
        dated = r"^(?:[0-9]{2})?[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[-+]?[0-9]{4}$"
        return value.rlike(dated) & _alone(match) & luhn(F.right(digits, F.lit(10)))
    return value.rlike(r"^\(?[2-9]") & _alone(match)


def _proposed(text: Column, number: int) -> Column:
    """Spans of one kind: the confirmed of a base kind, those above the score of another."""
    kind = KINDS[number]

    def scored(match: Column) -> Column:
        around = F.lower(F.concat_ws(" ", match["before"], match["after"]))
        score = (
            F.lit(kind.proposed + kind.confirmed)
            + F.when(around.rlike(kind.words), kind.named).otherwise(0)
            - F.when(around.rlike(AGAINST), LESS).otherwise(0)
        )
        return F.struct(
            match["start"].alias("start"), F.lit(number).alias("kind"), match["end"].alias("end"), score.alias("score")
        )

    found = located(text, kind.pattern, 0, BEFORE, AFTER)
    confirmed = F.transform(F.filter(found, lambda m: _confirmed(kind.name, m)), scored)
    return confirmed if number < BASE else F.filter(confirmed, lambda s: s["score"] >= LEAST_SCORE)


def _apart(spans: Column) -> Column:
    """Of spans in order all base ones, and the others that overlap none of those and none
    that begins before."""

    based = lambda span: span["kind"] < BASE

    def onward(furthest: Column, span: Column) -> Column:
        clear = based(span) | (span["start"] >= furthest)
        return F.struct(span.alias("span"), clear.alias("clear"))

    def back(nearest: Column, entry: Column) -> Column:
        clear = entry["clear"] & (based(entry["span"]) | (entry["span"]["end"] <= nearest))
        return F.struct(entry["span"].alias("span"), clear.alias("clear"))

    beyond = F.lit(2**31 - 1)
    after_others = scan(spans, lambda s: s["end"], F.greatest, F.lit(0), onward)
    begins = lambda e: F.when(based(e["span"]), e["span"]["start"]).otherwise(beyond)
    before_base = scan(F.reverse(after_others), begins, F.least, beyond, back)
    return F.transform(F.filter(F.reverse(before_base), lambda e: e["clear"]), lambda e: e["span"])


def scanned(docs: DataFrame) -> DataFrame:
    """The columns of `docs` but `text`, with `found`: an array of spans.

    A span is `(start, kind, end, score)`, the kind a place in `NAMES`; the first `BASE`
    kinds are base ones. A column named `found` is replaced.
    """
    text = F.coalesce("text", F.lit(""))
    kept = [c for c in docs.columns if c not in ("found", "text")]
    every = F.array_sort(F.concat(*(_proposed(text, number) for number in range(len(KINDS)))))
    return docs.select(*kept, _apart(every).alias("found"))


def span_digests(docs: DataFrame) -> DataFrame:
    """`(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`."""
    count = lambda n: F.size(F.filter("found", lambda s: s["kind"] == n)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < BASE)
    return scanned(docs.select("doc_id", "text")).select(
        "doc_id",
        *(count(n).alias(f"n_{NAMES[n]}") for n in range(BASE)),
        F.sha2(written(base, NAMES), 256).alias("base_sha256"),
        written(F.col("found"), NAMES).alias("spans"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """The columns of `docs` with every found span in `text` replaced by its kind in brackets."""
    kept = [c for c in docs.columns if c != "text"]
    named = F.array(*map(F.lit, NAMES))
    carried = docs.select(F.struct(*kept).alias("_doc"), "text", F.col("text").alias("_text"))

    def piece(at: Column, span: Column) -> Column:
        # Base spans that overlap are written as one mark each.
        gap = F.substring(F.col("_text"), at + 1, F.greatest(span["start"] - at, F.lit(0)))
        return F.concat(gap, F.lit("["), F.element_at(named, span["kind"] + 1), F.lit("]"))

    marked = scan(F.col("found"), lambda s: s["end"], F.greatest, F.lit(0), piece)
    ends = F.array_max(F.transform("found", lambda s: s["end"]))
    rest = F.substring(F.col("_text"), F.coalesce(ends, F.lit(0)) + 1, F.length("_text"))
    whole = F.when(F.col("_text").isNotNull(), F.concat(F.array_join(marked, ""), rest))
    found = scanned(carried).select("_doc.*", whole.alias("text"))
    return found.select(*docs.columns)
