"""Secret scans in column expressions: patterns, and entropy of sliding windows.

Three patterns give base spans: assignments of values to names like `password`, access
keys, and long hex strings. Besides, every maximal run of at least 20 letters, digits and
`+/_=-` with a digit in it is a candidate. Allow-listed parts (placeholders, UUIDs, checksums
that say so) suppress the windows that overlap them: they cut a candidate into pieces. A window
of 20 characters slides over each piece; the counts of the window's characters, and with them
its Shannon entropy, change by the one that enters and the one that leaves. Windows above the
threshold of the piece's class (hex, letters and digits, or with signs) are joined to spans;
those inside a base span are not added. Cost is linear in the text, also for one long run.

Spans are `kind:start:end` in code points, the end exclusive, by start and then in the
order of `KINDS`. All of it is one projection: no Python, no shuffle, no state between
rows. Null and empty texts have no spans; repeated rows are scanned each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwarden.llm.spans import bound, located, scan, written

#: The base patterns.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

WINDOW = 20
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: A run with a digit, tried only where a run begins.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])" + RUN
#: Bits per character that a window of each class has at least.
THRESHOLDS = {"entropy_hex": 3.05, "entropy_alnum": 3.55, "entropy_base64": 3.75}
KINDS = ("assign", "access", "hex", *THRESHOLDS)

#: Parts of values that are no secrets, in lower case.
ALLOWED = (
    r"example|sample|placeholder|changeme|dummy|lorem|xxxx|0000000|1234567|abcdefg|deadbeef"
    r"|sha(1|256|384|512)-|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
)

#: A candidate that is a base span of the kind hex itself; its windows add nothing.
PLAIN_HEX = "^[0-9a-f]{24,}$"


def _span(start: Column, kind: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), kind.alias("kind"), end.alias("end"))


def _of_kind(text: Column, pattern: str, kind: str, value_group: int = 0, least: int = 0) -> Column:
    found = F.filter(located(text, pattern, value_group), lambda m: F.length(m["value"]) >= least)
    return F.transform(found, lambda m: _span(m["start"], F.lit(KINDS.index(kind)), m["end"]))


def _gain(count: int) -> float:
    """What one more of a character that occurs so often adds to the sum of c log2 c."""
    return (count + 1) * math.log2(count + 1) - (count * math.log2(count) if count else 0.0)


def _class(value: Column) -> Column:
    """Number of the candidate's kind."""
    return (
        F.when(value.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), KINDS.index("entropy_hex"))
        .when(value.rlike("^[A-Za-z0-9]+$"), KINDS.index("entropy_alnum"))
        .otherwise(KINDS.index("entropy_base64"))
    )


def _threshold(kind: Column) -> Column:
    least = F.lit(0.0)
    for name, bits in THRESHOLDS.items():
        least = F.when(kind == KINDS.index(name), F.lit(bits)).otherwise(least)
    return least


def _pieces(match: Column) -> Column:
    """`(start, value)` of what allow-listed parts leave of a candidate, if a window fits in."""
    allowed = located(F.lower(match["value"]), ALLOWED, 0)

    def cut(parts: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(parts, lambda p: p["end"]))
        ends = F.concat(F.transform(parts, lambda p: p["start"]), F.array(F.length(match["value"])))
        return F.arrays_zip(starts.alias("start"), ends.alias("end"))

    left = F.filter(bound(allowed, cut), lambda p: p["end"] - p["start"] >= WINDOW)
    return F.transform(
        left,
        lambda p: F.struct(
            (match["start"] + p["start"]).alias("start"),
            F.substring(match["value"], p["start"] + 1, p["end"] - p["start"]).alias("value"),
        ),
    )


def _dense_windows(piece: Column) -> Column:
    """Spans of a piece's windows above the threshold of its class.

    The counts of a window differ from those of the one before by the character that enters
    and the one that leaves, and so does the sum of c log2 c. What a place changes is found in
    the window before it; running sums of the changes give every window's entropy.
    """
    size = F.length(piece["value"])
    codes = F.transform(F.split(piece["value"], "", size), F.ascii)

    gains = F.array(*(F.lit(_gain(count)) for count in range(WINDOW)))

    def changes(array: Column) -> Column:
        def change(code: Column, at: Column) -> Column:
            # The characters that stay from the window before; the one that leaves was its first.
            stay = F.slice(array, F.greatest(at - WINDOW + 2, F.lit(1)), F.least(at, F.lit(WINDOW - 1)))
            leaves = F.get(array, at - WINDOW)
            # A character's share, by how often it is among those that stay.
            worth = lambda c: F.get(gains, F.size(stay) - F.size(F.array_remove(stay, c)))
            return worth(code) - F.when(at >= WINDOW, worth(leaves)).otherwise(0.0)

        return F.transform(array, change)

    entropies = scan(
        bound(codes, changes), lambda x: x, lambda a, b: a + b, F.lit(0.0), lambda before, x: before + x
    )

    def ends(kind: Column, threshold: Column) -> Column:
        """Ends of dense windows, of which those that overlap or touch are one span."""
        dense = lambda weight, at: F.when(
            (at >= WINDOW - 1) & (math.log2(WINDOW) - weight / WINDOW >= threshold), at + 1
        )
        places = F.filter(F.transform(entropies, dense), lambda end: end.isNotNull())
        return bound(places, lambda found: joined(found, kind))

    def joined(places: Column, kind: Column) -> Column:
        begins = F.filter(places, lambda e, i: (i == 0) | (e - F.get(places, i - 1) > WINDOW))
        stops = F.filter(
            places, lambda e, i: (i == F.size(places) - 1) | (F.get(places, i + 1) - e > WINDOW)
        )
        return F.transform(
            F.arrays_zip(begins.alias("begin"), stops.alias("stop")),
            lambda s: _span(piece["start"] + s["begin"] - WINDOW, kind, piece["start"] + s["stop"]),
        )

    return bound(_class(piece["value"]), lambda kind: bound(_threshold(kind), lambda t: ends(kind, t)))


def _candidates(text: Column) -> Column:
    worth = F.filter(located(text, CANDIDATE, 0), lambda m: ~m["value"].rlike(PLAIN_HEX))
    return F.transform(worth, lambda m: F.struct(m["start"].alias("start"), m["value"].alias("value")))


def _added(base: Column, dense: Column) -> Column:
    """The dense spans that lie in no base span; both are sorted by start.

    A base span that begins at or before a dense one holds it if it ends as late; of those
    the one that ends last decides.
    """
    both = F.array_sort(
        F.concat(
            F.transform(base, lambda s: F.struct(s["start"], F.lit(0).alias("dense"), s["kind"], s["end"])),
            F.transform(dense, lambda s: F.struct(s["start"], F.lit(1).alias("dense"), s["kind"], s["end"])),
        )
    )
    of_base = lambda s: F.when(s["dense"] == 0, s["end"]).otherwise(0)
    judged = lambda furthest, s: F.struct(s.alias("span"), (s["end"] > furthest).alias("free"))
    marked = scan(both, of_base, lambda a, b: F.greatest(a, b), F.lit(0), judged)
    free = F.filter(marked, lambda m: m["free"] & (m["span"]["dense"] == 1))
    return F.transform(free, lambda m: _span(m["span"]["start"], m["span"]["kind"], m["span"]["end"]))


def scanned(docs: DataFrame) -> DataFrame:
    """The columns of `docs` but `text`, with `base` and `found`: arrays of spans.

    A span is `(start, kind, end)`, the kind a place in `KINDS`; `found` holds all spans,
    base ones included. Columns of these names are replaced.
    """
    text = F.coalesce("text", F.lit(""))
    base = F.array_sort(
        F.concat(
            _of_kind(text, ASSIGN, "assign", 2, LEAST_VALUE),
            _of_kind(text, ACCESS, "access"),
            _of_kind(text, HEX, "hex"),
        )
    )
    kept = [c for c in docs.columns if c not in ("base", "found", "text")]
    carried = F.struct(*kept).alias("_doc") if kept else F.struct(F.lit(0).alias("_none")).alias("_doc")
    # Step by step: one expression of all this is too deep for the analyser.
    marked = docs.select(carried, base.alias("base"), _candidates(text).alias("runs"))
    cut = marked.select("_doc", "base", F.flatten(F.transform("runs", _pieces)).alias("pieces"))
    dense = F.flatten(F.transform("pieces", _dense_windows))
    scanned = cut.select("_doc", "base", dense.alias("dense"))
    added = _added(F.col("base"), F.col("dense"))
    found = scanned.select("_doc", "base", F.array_sort(F.concat("base", added)).alias("found"))
    return found.select("_doc.*", "base", "found").select(*kept, "base", "found")


def span_digests(docs: DataFrame) -> DataFrame:
    """`(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return scanned(docs.select("doc_id", "text")).select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(written(F.col("base"), KINDS), 256).alias("base_sha256"),
        written(F.col("found"), KINDS).alias("spans"),
    )
