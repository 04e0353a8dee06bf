"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes disguises word by word: case, look-alike letters of other scripts and full
width, digits and signs in place of letters (`1d10t`, `tr@sh`), zero-width characters and
punctuation around the word. The lexicon is learned from labelled training documents:
words and beginnings of words (`term*`) whose share among toxic documents is far above that
among others, taken greedily so that each explains toxic documents that no earlier term does
(words that merely come with a repeated toxic document add nothing), until none explains
`LEAST_DOCS` more. Phrases of a term and a word beside it become exceptions if so many
clean documents have them and their share among toxic ones is no higher. An automaton finds
the terms on word boundaries; matches inside an exception phrase do not count. The matched
weight and its density, normalised by the document's length, go through a logistic
function fitted on the same sample.

Learning uses at most `LABELLED` labelled rows (the first in the order of a hash of the
id), so what reaches the driver is bounded by them: their labels, the terms that stand out
among them and a short row for each. Nothing else is cut off, whatever the number of terms.
Scores cover every row. Null texts count as empty; texts without matches get the score of
zero weight. Without any toxic label the lexicon is empty and every score low. Labels that
are null are no labels; of several labels of a document the largest counts. Repeated
documents are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwarden.llm.common import fold_of, pieces, texts_of, work_folder
from termwarden.sources.scratch import WorkFolder

#: At most so many labelled rows are used for learning.
LABELLED = 200_000
#: A term's least toxic documents, also beyond those of earlier terms, and least log odds; an
#: exception's least clean documents.
LEAST_DOCS, LEAST_WEIGHT = 3, 2.0
#: Bits of the positions in a bitmap of term hashes, whose size they fix.
BITS = 24
#: Lengths of the word beginnings that can be terms besides whole words.
PREFIXES = range(3, 9)

#: Letters that look like Latin ones, with what they look like.
LOOK_ALIKES = str.maketrans(
    "абвгеѕіјкмнорстухьԁԛԝһαβεικνορτυχω",
    "abbresijkmhopctyxbdqwhabeiknoptuxw",
    "\u200b\u200c\u200d\u2060\ufeff\u00ad",
)
#: Full-width forms of the printable ASCII characters.
FULL_WIDTH = {0xFF01 + i: 0x21 + i for i in range(94)}
#: Digits and signs written for letters.
SUBSTITUTES = str.maketrans("013457@$!|", "oieastasii")

#: Phrases in which a term is harmless, besides those that are learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish")


def folded(word: str) -> str:
    """A word without disguise: its letters, or nothing."""
    if word.isascii():
        word = word.lower()
        if word.isalpha():
            return word
    else:
        word = word.translate(FULL_WIDTH).lower().translate(LOOK_ALIKES)
    start, end = 0, len(word)
    while start < end and not word[start].isalnum() and word[start] not in "@$":
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    word = word[start:end]
    if word.isalpha() or not any(c.isalpha() for c in word):
        return word
    word = word.translate(SUBSTITUTES)
    return " ".join("".join(c if c.isalnum() or c == "'" else " " for c in word).split())


@dataclass
class FoldedWords:
    """Words of some texts: the row of each, its number among the distinct folded ones."""

    row: np.ndarray
    number: np.ndarray
    distinct: list[str]


def fold_words(texts: pa.Array) -> FoldedWords:
    lists = pc.ascii_split_whitespace(texts)
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = pc.list_flatten(lists).dictionary_encode()
    number_of: dict[str, int] = {"": 0}
    numbers = np.fromiter(
        (number_of.setdefault(folded(w), len(number_of)) for w in encoded.dictionary.to_pylist()),
        np.int64,
        len(encoded.dictionary),
    )
    number = numbers[encoded.indices.to_numpy(zero_copy_only=False)] if len(encoded) else np.zeros(0, np.int64)
    filled = number > 0
    return FoldedWords(rows[filled], number[filled], list(number_of))


def folded_texts(piece: pa.RecordBatch) -> Iterator[tuple[str, int]]:
    """Each text of a piece folded, with its number of words."""
    words = fold_words(texts_of(piece))
    distinct = np.array(words.distinct, dtype=object)
    counts = np.bincount(words.row, minlength=piece.num_rows)
    for part in np.split(words.number, np.cumsum(counts)[:-1]):
        yield " ".join(distinct[part]), len(part)


def term_pairs(
    words: FoldedWords,
    number_of: dict[str, int],
    grow: bool,
    bitmap: bytes | None = None,
) -> np.ndarray:
    """Distinct `(row, term)` of the texts; with `grow`, new terms get a number, those alone
    that may be in the bitmap if there is one."""
    pairs = np.unique(words.row * len(words.distinct) + words.number)
    row, number = np.divmod(pairs, len(words.distinct))
    found = []
    for size in (0, *PREFIXES):
        names = (w if not size else f"{w[:size]}*" if len(w) >= size else "" for w in words.distinct)
        if bitmap is not None:
            names = (t if t and _may_hold(bitmap, t) else "" for t in names)
        if grow:
            ids = (number_of.setdefault(t, len(number_of)) if t else -1 for t in names)
        else:
            ids = (number_of.get(t, -1) for t in names)
        term = np.fromiter(ids, np.int64, len(words.distinct))[number]
        found.append((row << 32 | term)[term >= 0])
    pairs = np.unique(np.concatenate(found))
    return np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1)


@dataclass
class ToxicityModel:
    """Weights of terms, exception phrases, and the logistic function's coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, float, float]

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            pattern = f" {term[:-1]}" if term.endswith("*") else f" {term} "
            found.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            pattern = f" {' '.join(filter(None, map(folded, phrase.split())))} "
            found.add_word(pattern, (len(pattern), None))
        if len(found):
            found.make_automaton()
        return found

    def score(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = features(weight, words) @ np.array(self.coefficients)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    level = np.log1p(np.maximum(weight, 0))
    return np.stack([np.ones_like(level), level, level / np.log(np.e + words)], axis=1)


def matched_weight(automaton, text: str) -> float:
    """Weight of the terms in a folded text: of a word the heaviest, of exceptions none."""
    if not len(automaton):
        return 0.0
    hits: dict[int, float] = {}
    safe = []
    for last, (length, weight) in automaton.iter(f" {text} "):
        start = last + 1 - length
        if weight is None:
            safe.append((start, last))
        else:
            hits[start] = max(weight, hits.get(start, 0.0))
    return sum(w for at, w in hits.items() if not any(a <= at < b for a, b in safe))


def term_hits(automaton, text: str) -> list[tuple[float, str, str]]:
    """Weight of every match that counts, with the phrases of it and the word on either side."""
    if not len(automaton):
        return []
    padded = f" {text} "
    best: dict[int, float] = {}
    safe = []
    for last, (length, weight) in automaton.iter(padded):
        start = last + 1 - length
        if weight is None:
            safe.append((start, last))
        else:
            best[start] = max(weight, best.get(start, 0.0))
    out = []
    for start, weight in best.items():
        if any(a <= start < b for a, b in safe):
            continue
        end = padded.index(" ", start + 1)
        before, after = padded.rfind(" ", 0, start), padded.find(" ", end + 1)
        left = padded[before + 1 : end] if before >= 0 else ""
        right = padded[start + 1 : after] if after >= 0 else ""
        out.append((weight, left, right))
    return out


def _log_odds(toxic: Column, clean: Column, toxic_rows: int, clean_rows: int) -> Column:
    return F.log((toxic + 0.5) / (toxic_rows + 1)) - F.log((clean + 0.5) / (clean_rows + 1))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    held_out_fold: int = 0,
    exceptions: Sequence[str] = EXCEPTIONS,
    work: WorkFolder | None = None,
) -> ToxicityModel:
    """A model from the labelled documents that are not in the held-out fold."""
    work = work or work_folder(docs)
    sample = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("_toxic"))
        .where(fold_of(F.col("doc_id")) != held_out_fold)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(LABELLED)
    )
    sample = work.write("labels", sample)
    # Bounded by LABELLED rows of two numbers.
    training = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    by_label = dict(map(tuple, sample.groupBy("_toxic").count().collect()))
    bad, good = by_label.get(1, 0), by_label.get(0, 0)
    of_toxic = work.write(
        "toxic_terms",
        _document_counts(training.where("_toxic = 1"), None).where(F.col("docs") >= LEAST_DOCS),
    )
    of_clean = _document_counts(training.where("_toxic = 0"), _bitmap(of_toxic))
    rated = of_toxic.join(of_clean.withColumnRenamed("docs", "clean"), "term", "left").select(
        "term",
        "docs",
        _log_odds(F.col("docs"), F.coalesce("clean", F.lit(0)), bad, good).alias("weight"),
    )
    # Terms that stand out among the labelled rows.
    rows = rated.where(F.col("weight") >= LEAST_WEIGHT).collect()
    candidates = [
        (term, weight) for _, term, weight in sorted(((r.docs * r.weight, r.term, r.weight) for r in rows), reverse=True)
    ]
    found = _found_terms(training.where("_toxic = 1"), candidates)
    chosen = _chosen(np.array([weight for _, weight in candidates]), found)
    weights = {candidates[c][0]: candidates[c][1] for c in chosen}
    model = ToxicityModel(weights, tuple(exceptions), (0.0, 0.0, 0.0))
    return _fitted(model, _described(training, model), bad, good)


def _document_counts(rows: DataFrame, bitmap: np.ndarray | None) -> DataFrame:
    """`(term, docs)`: texts that have each term; with a bitmap only terms that may be in it."""

    held = None if bitmap is None else bitmap.tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                number_of: dict[str, int] = {}
                pairs = term_pairs(fold_words(texts_of(piece)), number_of, True, held)
                seen, counts = np.unique(pairs[:, 1], return_counts=True)
                names = list(number_of)
                columns = [pa.array([names[i] for i in seen], pa.string()), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "docs"])

    counted = rows.select("text").mapInArrow(count, "term string, docs long")
    return counted.groupBy("term").agg(F.sum("docs").alias("docs"))


def _may_hold(bitmap: bytes, term: str) -> bool:
    place = xxhash.xxh64_intdigest(term.encode(), 42) >> (64 - BITS)
    return bool(bitmap[place >> 3] >> (place & 7) & 1)


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Where the hashes of the terms lie among 2^BITS, in a map of that size."""
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    high = F.shiftrightunsigned(F.xxhash64("term"), 64 - BITS)
    places = terms.select(high.alias("p")).distinct().toArrow()["p"].to_numpy()
    np.bitwise_or.at(bitmap, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))
    return bitmap


def _found_terms(rows: DataFrame, candidates: list[tuple[str, float]]) -> list[np.ndarray]:
    """For each row the numbers of the candidates in it."""
    number_of = {term: i for i, (term, _) in enumerate(candidates)}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                pairs = term_pairs(fold_words(texts_of(piece)), number_of, False)
                ends = np.cumsum(np.bincount(pairs[:, 0], minlength=piece.num_rows))[:-1]
                found = [part.tolist() for part in np.split(pairs[:, 1], ends)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["found"])

    if not candidates:
        return []
    found = rows.select("text").mapInArrow(find, "found array<int>").toArrow()["found"]
    return [np.array(f, np.int64) for f in found.to_pylist()]


def _chosen(weights: np.ndarray, rows: list[np.ndarray]) -> list[int]:
    """Candidates in the order of the weight they add over rows not yet explained."""
    left = np.zeros(len(weights), np.int64)
    holders: dict[int, list[int]] = {}
    for at, row in enumerate(rows):
        left[row] += 1
        for term in row.tolist():
            holders.setdefault(term, []).append(at)
    explained, chosen = np.zeros(len(rows), bool), []
    while len(weights):
        best = int(np.argmax(np.where(left >= LEAST_DOCS, left * weights, 0)))
        if left[best] < LEAST_DOCS:
            break
        chosen.append(best)
        for at in holders[best]:
            if not explained[at]:
                explained[at] = True
                left[rows[at]] -= 1
    return chosen


def _described(rows: DataFrame, model: ToxicityModel) -> pa.Table:
    """`(toxic, words, hits)` of each row; a hit is a weight and two phrases."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        hit = pa.struct([("weight", pa.float64()), ("left", pa.string()), ("right", pa.string())])
        for batch in batches:
            for piece in pieces(batch):
                words, found = [], []
                for text, size in folded_texts(piece):
                    words.append(size)
                    names = ("weight", "left", "right")
                    found.append([dict(zip(names, h, strict=True)) for h in term_hits(automaton, text)])
                columns = [piece.column("_toxic"), pa.array(words, pa.int64()), pa.array(found, pa.list_(hit))]
                yield pa.RecordBatch.from_arrays(columns, names=["toxic", "words", "hits"])

    schema = "toxic int, words long, hits array<struct<weight:double,left:string,right:string>>"
    # One short row per labelled row, LABELLED at most.
    return rows.select("text", "_toxic").mapInArrow(describe, schema).toArrow()


def _fitted(model: ToxicityModel, rows: pa.Table, bad: int, good: int) -> ToxicityModel:
    """The model with exceptions and coefficients learned from the described rows."""
    toxic = rows["toxic"].to_numpy().astype(bool)
    hits = rows["hits"].to_pylist()
    seen: dict[str, list[int]] = {}
    for bad_row, row in zip(toxic.tolist(), hits, strict=True):
        for phrase in {p for h in row for p in (h["left"], h["right"]) if p}:
            seen.setdefault(phrase, [0, 0])[bad_row] += 1
    harmless = {
        phrase
        for phrase, (clean, toxic_rows) in seen.items()
        if clean >= LEAST_DOCS and (toxic_rows + 0.5) / (bad + 1) <= (clean + 0.5) / (good + 1)
    }
    weight = np.array(
        [sum(h["weight"] for h in row if not {h["left"], h["right"]} & harmless) for row in hits], float
    )
    words = rows["words"].to_numpy().astype(float)
    coefficients = _logistic(features(weight, words), toxic)
    return ToxicityModel(model.weights, (*model.exceptions, *sorted(harmless)), coefficients)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """Newton's method with a small ridge, which also settles separable data."""
    b = np.zeros(3)
    penalty = np.diag([ridge / 100, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ b
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        b = b - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    if not y.any():
        b = np.array([-4.0, 1.0, 0.0])
    return tuple(b.tolist())


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The columns of `docs` with `score` (0 to 1) and `predicted` (1 from 0.5 on)."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            for piece in pieces(batch):
                texts = list(folded_texts(piece))
                weight = np.array([matched_weight(automaton, text) for text, _ in texts])
                score = model.score(weight, np.array([size for _, size in texts], float))
                columns = [piece.column(c) for c in kept]
                columns += [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*kept).mapInArrow(judge, schema)
