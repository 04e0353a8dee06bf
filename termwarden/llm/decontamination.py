"""Benchmark decontamination by templates with typed slots.

Words lose their case and outer punctuation; numbers, units of measure and names (words
inside a sentence whose only capital is the first letter) become typed placeholders. Windows of eight such tokens
of documents and benchmark items are hash-joined, so a question with other numbers or
names in it still matches. For every document, item and alignment (the difference of the
two positions) the slots are then compared: a benchmark value must always stand for the
same document value and the other way round, else the match is chance and is dropped.

Where less than five eighths of a window are literal words, its template says too little:
such windows match only with the very same words. So do, beside the template, all others,
whatever their case: a lower-cased copy has no names to replace. Same words never contradict
each other, so exact matches stay where slots are torn.

A document contains an item if half of the item's windows match, or 13 of them (20 words),
or half of those that have a template. Shorter items are one window; those below four words
match only with the very same words. An item of one word is in every document that has the
word. Items with the same text are one, by the smallest id; ids may be of any type or null.

Documents meet an item only over its rarest windows, by the number of items that have them:
so many that none can contain the item without one. The other windows are compared for the
pairs that were found. Before the join, tasks drop document windows whose hash is not in a bitmap of the
benchmark's hashes. The bitmap has a fixed size (`BITS`), whatever the benchmark's; if
many windows fill it, more rows reach the join, and none is lost. The join shuffles or
broadcasts as Spark sees fit, and a frequent passage is split by the adaptive skew join.

Null and empty texts contain nothing and no item. Repeated rows and equal texts share
their fate. Null ids are kept. An empty benchmark or table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termwarden.llm.common import mixed, numbered, pieces, texts_of, with_facts, work_folder
from termwarden.sources.scratch import WorkFolder

WINDOW, SHORTEST, BITS = 8, 4, 22
#: Share of an item's windows that must match, and the number that always is enough.
SHARE, ENOUGH = 0.5, 13

#: Units of measure.
UNITS = frozenset(
    "mm cm m km mg g kg t ml l s sec min h hr day days week weeks month months year years "
    "hour hours minute minutes second seconds inch inches ft feet mile miles lb lbs oz gallon "
    "gallons meter meters metre metres liter liters litre litres gram grams kilogram kilograms "
    "dollar dollars cent cents euro euros pound pounds usd eur gbp percent % $ € £ °c °f".split()
)
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "%$") + "“”‘’«»…–—"
NUMBER = r"^[-+$€£]?[0-9]+([.,:/][0-9]+)*(%|st|nd|rd|th)?$"
LITERAL, NUMERIC, UNIT, NAME = 0, 1, 2, 3
MARKS = mixed(np.arange(101, 105, dtype=np.uint64))


class Tokens:
    """Template tokens of some texts, in order: row, hash, type and the word itself."""

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.ascii_split_whitespace(texts)
        rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        encoded = pc.list_flatten(lists).dictionary_encode()
        words = encoded.dictionary
        cores = pc.utf8_trim(words, EDGES)
        self.values = pc.utf8_lower(cores)
        plain = self.values.to_pylist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in plain), np.uint64, len(plain))
        kind = np.where(_mask(pc.match_substring_regex(cores, NUMBER)), NUMERIC, LITERAL)
        kind[np.fromiter((w in UNITS for w in plain), bool, len(plain))] = UNIT
        capital = _mask(pc.match_substring_regex(cores, r"^\p{Lu}[^\p{Lu}]*$")) & (kind == LITERAL)
        ends = _mask(pc.match_substring_regex(words, r"[.!?:]\W*$"))
        index = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        filled = np.fromiter((bool(w) for w in plain), bool, len(plain))[index] if len(index) else np.zeros(0, bool)
        rows, index = rows[filled], index[filled]
        inside = np.zeros(len(rows), bool)
        inside[1:] = (rows[1:] == rows[:-1]) & ~ends[index[:-1]]
        self.row, self.index = rows, index
        self.kind = np.where(inside & capital[index], NAME, kind[index])
        self.exact = hashes[index]
        self.hash = np.where(self.kind == LITERAL, self.exact, MARKS[self.kind])
        first = np.searchsorted(rows, rows)
        self.place = np.arange(len(rows)) - first

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows, their hashes as words and as templates, and whether
        they have enough literal words for a template."""
        n = len(self.row) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
        literal = np.concatenate([[0], np.cumsum(self.kind == LITERAL)])
        enough = (literal[length:] - literal[:-length]) * 8 >= 5 * length
        start = np.flatnonzero(self.row[:n] == self.row[length - 1 :])
        hashes = []
        for parts in (self.exact, self.hash):
            rolled = np.zeros(n, np.uint64)
            for k in range(length):
                rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + parts[k : k + n]
            hashes.append(mixed(rolled[start] + np.uint64(length)))
        return start, *hashes, enough[start] & (length >= SHORTEST)

    def slots(self, start: int, length: int) -> list[str]:
        """`<type>:<value>` of the placeholders of a window."""
        at = np.flatnonzero(self.kind[start : start + length] != LITERAL) + start
        return [f"{self.kind[i]}:{self.values[self.index[i]].as_py()}" for i in at.tolist()]


def _mask(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False).astype(bool)


_WINDOWS = (
    "row long, place long, hash long, slots array<string>, length int, windows long, "
    "open boolean, opens long"
)


def _windows(rows: DataFrame, lengths: list[int] | None, bitmap: np.ndarray | None) -> DataFrame:
    """Windows of `(row, text)`. Items (no lengths given) have windows of `WINDOW` tokens,
    or one of all their tokens if they are shorter.

    A window is there as its words, without slots, and once more as a template if it has
    slots and is `open`, that is, has enough literal words. `opens` counts the text's windows
    with enough of them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                tokens = Tokens(texts_of(piece))
                sizes = np.bincount(tokens.row, minlength=piece.num_rows)
                rows = piece.column("row").to_numpy()
                placeholders = np.concatenate([[0], np.cumsum(tokens.kind != LITERAL)])
                for length in lengths or range(1, WINDOW + 1):
                    start, exact, template, open_ = tokens.windows(length)
                    if lengths is None and length < WINDOW:
                        whole = sizes[tokens.row[start]] == length
                        start, exact, template, open_ = (x[whole] for x in (start, exact, template, open_))
                    opens = np.bincount(tokens.row[start[open_]], minlength=piece.num_rows)
                    slotted = open_ & (placeholders[start + length] > placeholders[start])
                    some = np.repeat([False, True], [len(start), slotted.sum()])
                    hashes = np.concatenate([exact, template[slotted]])
                    start, open_ = (np.concatenate([x, x[slotted]]) for x in (start, open_))
                    if bitmap is not None:
                        high = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
                        seen = (bitmap[high >> 3] >> (high & 7).astype(np.uint8)) & 1 == 1
                        start, hashes, open_, some = start[seen], hashes[seen], open_[seen], some[seen]
                    columns = [
                        pa.array(rows[tokens.row[start]]),
                        pa.array(tokens.place[start]),
                        pa.array(hashes.view(np.int64)),
                        pa.array(
                            [tokens.slots(s, length) if x else [] for s, x in zip(start.tolist(), some.tolist(), strict=True)],
                            pa.list_(pa.string()),
                        ),
                        pa.array(np.full(len(start), length, np.int32)),
                        pa.array(np.maximum(1, sizes[tokens.row[start]] - length + 1)),
                        pa.array(open_),
                        pa.array(opens[tokens.row[start]].astype(np.int64)),
                    ]
                    names = ["row", "place", "hash", "slots", "length", "windows", "open", "opens"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(cut, _WINDOWS)


def numbered_items(benchmark: DataFrame, work: WorkFolder) -> DataFrame:
    """`(item, item_id, copies, text)`: one row per text of the benchmark, with a number.

    `item_id` is the smallest id of the items with that text, of whatever type ids are; it is
    null if none has an id. `copies` counts the items.
    """
    items = (
        benchmark.where(F.col("text").isNotNull())
        .groupBy("text")
        .agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("copies"))
    )
    return work.write("benchmark", items.withColumn("item", F.monotonically_increasing_id()))


def item_members(benchmark: DataFrame, items: DataFrame) -> DataFrame:
    """`(item_id, item)`: which of the numbered items each item of the benchmark is."""
    return benchmark.select("item_id", "text").join(items.select("item", "text"), "text").drop("text")


def _needed(number: str) -> Column:
    """Of so many windows those that must match at least."""
    return F.ceil(F.col(number) * SHARE)


def _probes(wanted: DataFrame, work: WorkFolder) -> DataFrame:
    """`(hash, item)` of the windows by which candidates are found.

    Who matches k of n windows matches one of the n-k+1 that fewest items have, and who matches
    enough of the open windows one of the rarest of those. So a prompt that many items begin
    with brings no documents together with all of them, and no item is lost.
    """
    items_of = wanted.select("hash", "row").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("items"))
    places = work.write(
        "places",
        wanted.join(items_of, "hash")
        .groupBy("row", "place", "open", "windows", "opens")
        .agg(F.sum("items").alias("items")),
    )
    of_all = Window.partitionBy("row").orderBy("items", "place")
    of_open = Window.partitionBy("row", "open").orderBy("items", "place")
    ranked = places.withColumns(
        {"_rank": F.row_number().over(of_all), "_open_rank": F.row_number().over(of_open)}
    )
    least = F.least(_needed("windows"), F.lit(ENOUGH))
    probing = (F.col("_rank") <= F.col("windows") - least + 1) | (
        F.col("open") & (F.col("_open_rank") <= F.col("opens") - _needed("opens") + 1)
    )
    chosen = ranked.where(probing).select("row", "place")
    hashes = wanted.join(chosen, ["row", "place"], "left_semi").select("hash", F.col("row").alias("item"))
    return work.write("probes", hashes.distinct())


def leaks(texts: DataFrame, benchmark: DataFrame, work: WorkFolder) -> DataFrame:
    """`(row, item, item_id, copies, matched, windows, coverage, reparameterised)` per item
    that a text contains.

    `texts` has `text` and a long `row` that equal texts may share. `reparameterised`
    tells that a slot has another value in the document than in the item.
    """
    items = numbered_items(benchmark, work)
    texts_of_items = items.select(F.col("item").alias("row"), "text")
    wanted = work.write("items", _windows(texts_of_items, None, None))
    lengths = sorted(r.length for r in wanted.select("length").distinct().collect())
    high = F.shiftrightunsigned("hash", 64 - BITS)
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    # At most 2^BITS positions, whatever the size of the benchmark.
    positions = wanted.select(high.alias("p")).distinct().toArrow()["p"].to_numpy()
    np.bitwise_or.at(bitmap, positions >> 3, np.left_shift(1, positions & 7).astype(np.uint8))
    found = work.write(
        "found", _windows(texts.select("row", "text"), lengths or [WINDOW], bitmap)
    )
    probes = _probes(wanted, work)
    candidates = work.write(
        "candidates",
        found.select("row", "hash").distinct().join(probes, "hash").select("row", "item").distinct(),
    )
    matched = (
        found.select("row", "hash", F.col("place").alias("_at"), F.col("slots").alias("_slots"))
        .join(candidates, "row")
        .join(
            wanted.select(
                F.col("row").alias("item"), "hash", "place", "slots", "windows", "open", "opens"
            ),
            ["item", "hash"],
        )
    )
    matched = work.write("matched", matched.withColumn("_line", F.col("_at") - F.col("place")))
    line = ["row", "item", "_line"]
    pairs = matched.where(F.size("slots") > 0).select(
        *line, F.explode(F.arrays_zip("slots", "_slots")).alias("_pair")
    )
    pairs = pairs.select(*line, "_pair.slots", "_pair._slots").distinct()
    torn = (
        pairs.groupBy(*line, "slots")
        .agg(F.count(F.lit(1)).alias("n"))
        .unionByName(
            pairs.groupBy(*line, F.col("_slots").alias("slots")).agg(F.count(F.lit(1)).alias("n"))
        )
        .where("n > 1")
        .select(*line)
        .distinct()
    )
    torn = work.write("torn", torn)
    # Exact matches have no slots that could contradict each other.
    places = (
        matched.where(F.size("slots") == 0)
        .unionByName(matched.where(F.size("slots") > 0).join(torn, line, "left_anti"))
        .groupBy("row", "item", "place")
        .agg(
            F.first("windows").alias("windows"),
            F.first("opens").alias("opens"),
            F.first("open").alias("open"),
            F.max(F.col("slots") != F.col("_slots")).alias("reparameterised"),
        )
    )
    whole = places.groupBy("row", "item").agg(
        F.count(F.lit(1)).alias("matched"),
        F.count_if("open").alias("_open"),
        F.first("windows").alias("windows"),
        F.first("opens").alias("opens"),
        F.max("reparameterised").alias("reparameterised"),
    )
    enough = (
        (F.col("matched") >= F.ceil(F.col("windows") * SHARE))
        | (F.col("matched") >= ENOUGH)
        | ((F.col("_open") > 0) & (F.col("_open") >= F.ceil(F.col("opens") * SHARE)))
    )
    return whole.where(enough).join(items.select("item", "item_id", "copies"), "item").select(
        "row",
        "item",
        "item_id",
        "copies",
        "matched",
        "windows",
        (F.col("matched") / F.col("windows")).alias("coverage"),
        "reparameterised",
    )


def _by_text(docs: DataFrame) -> DataFrame:
    """What a text contains depends on nothing else, so its hash stands for the rows."""
    return docs.withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))


def leaked_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`(doc_id, item_id, copies, matched, windows, coverage, reparameterised)`.

    Items with the same text are one, by the smallest id; `copies` counts them.
    """
    work = work_folder(docs)
    rows = _by_text(docs.select("doc_id", "text"))
    found = work.write("leaks", leaks(rows, benchmark, work))
    return rows.select("doc_id", "row").join(found, "row").drop("row", "item")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, work: WorkFolder | None = None
) -> DataFrame:
    """The rows of `docs` that contain no benchmark item. Texts stay where they are read."""
    work = work or work_folder(docs)
    stored = numbered(docs, work)
    texts = _by_text(stored.select("_row", "_doc.text"))
    flagged = work.write("flagged", leaks(texts, benchmark, work).select("row").distinct())
    kept = texts.select("_row", "row").join(flagged, "row", "left_anti").select("_row")
    return with_facts(stored, kept, work, "kept")
