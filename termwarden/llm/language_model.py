"""An interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped.

Counting: tasks reduce the n-grams of their texts to distinct ones and pass them on as
packed arrays, one per range of the n-gram's hash; ranges are uniform, so no word or n-gram
is hot. Each range merges its arrays into a file of sorted hashes and counts, and passes on
what the n-grams one word shorter need to know: of each context the total and how many
followers came once, twice or more often, of each ending how often it came and after how
many different words. Those are merged by their own ranges into files of sorted hashes and
statistics, and so on down to the words. Memory per task is bounded by the size of a range,
which the session's number of shuffle partitions sets.

Scoring: workers memory-map the files and look hashes up in order. Only pages that are
needed are read, and workers of a machine share them. Files must therefore be in a folder
that executors reach by path; `spark.checkpoint.dir` has to name one (a mounted shared
folder, with or without `file:`), else a ValueError says so. A model knows which files it has;
one that is not there is an error, not a set of unknown words. Files go with `delete`, or when
the session ends.

    p(w | v u) = max(a(v u w) - D(a(v u w)), 0) / a(v u) + gamma(v u) * p(w | u)
    p(w)       = max(n(w) - d(n(w)), 0) / n + gamma * 1 / (V + 1)

a is the count of an n-gram of full length or from the begin of a text, else the number of
different words before it; a(v u) is the sum over all that follow. n(w) is the number of
different words before w, V the number of distinct training tokens; the last slot is for
unknown words. The discounts of each length for 1, 2, 3 and more come from counts of counts,
and are 0.5 where those have gaps. After a context never seen, the shorter one alone decides.
A text is its words and one end, after a begin mark that is never scored; contexts do not
reach beyond it.

Null and empty texts are an end alone. Repeated rows count each time. Null ids are in fold
0. Without training texts every token has probability one (V is zero).
"""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwarden.llm.common import mixed, pieces, split_words, texts_of
from termwarden.sources.scratch import WorkFolder, shared_folder

#: Hashes of the end of a text, of the mark before its begin, and of what is before that.
END, BEGIN, NONE = (np.uint64(x) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D))

#: Words of n-grams that a counting task holds before it passes them on.
HELD = 16_000_000

#: What is known of an n-gram: followers' total, those seen once, twice, more often; own count,
#: different words before.
STATS = ("after", "ones", "twos", "more", "count", "before")


def local_path(folder: str) -> str:
    """A folder as executors' file systems know it."""
    path = re.sub(r"^file:/*", "/", folder)
    if not path.startswith("/"):
        raise ValueError(f"memory mapping needs a mounted shared folder, not {folder}")
    return path


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the texts, none of them null, begins and ends, and the bytes of all."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if not len(texts) or not data:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return ends - ends[0], np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]


def _lowered(texts: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case: Arrow's ascii_lower spoils longer letters in some sliced arrays."""
    ends, data = _bytes_of(texts)
    # No byte of a longer letter is in the range.
    data = data + (((data >= 65) & (data <= 90)).view(np.uint8) << np.uint8(5))
    buffers = [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_string(), len(texts), buffers)


def _each(words: pa.Array) -> Iterator[bytes]:
    ends, data = _bytes_of(words)
    whole, ends = data.tobytes(), ends.tolist()
    return (whole[a:b] for a, b in zip(ends, ends[1:], strict=False))


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all tokens, an end after the words of each row."""
    rows, words = split_words(_lowered(texts))
    encoded = words.dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, _each(encoded.dictionary)), np.uint64, len(encoded.dictionary))
    at = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(texts)
    place = np.arange(len(rows)) + rows
    tokens = np.full(len(rows) + n, END, np.uint64)
    if len(rows):
        tokens[place] = hashes[at]
    token_rows = np.repeat(np.arange(n), np.bincount(rows, minlength=n) + 1)
    return token_rows, tokens


def grams(rows: np.ndarray, tokens: np.ndarray, order: int) -> np.ndarray:
    """Per token its n-gram, a column per word: what is before the begin mark is NONE."""
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    out = np.full((len(tokens), order), NONE, np.uint64)
    out[:, -1] = tokens
    for back in range(1, order):
        column = out[:, order - 1 - back]
        inside = place >= back
        column[inside] = tokens[: len(tokens) - back][inside[back:]]
        column[place == back - 1] = BEGIN
    return out


def gram_hash(words: np.ndarray) -> np.ndarray:
    """Hash of each n-gram, a row of words; that of one word is the word's own."""
    out = words[:, 0]
    for column in range(1, words.shape[1]):
        longer = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[:, column])
        out = np.where(words[:, column - 1] == NONE, words[:, column], longer)
    return out


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Equal ranges of the hash, in order."""
    return (((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _ranges(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """The part of sorted keys in each range that has some."""
    bounds = np.searchsorted(range_of(keys, ranges), np.arange(ranges + 1))
    for r in np.flatnonzero(np.diff(bounds)).tolist():
        yield r, slice(bounds[r], bounds[r + 1])


def _row(r: int, n: int, *arrays: np.ndarray) -> pa.RecordBatch:
    """Compressed arrays of a range as one row."""
    import zstandard

    blob = zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))
    columns = [pa.array([r], pa.int32()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["range", "n", "data"])


def _planes(numbers: np.ndarray) -> np.ndarray:
    """Small numbers byte by byte: the high bytes, mostly zero, come together."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _packed(r: int, words: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """N-grams in the order of their first word, words as places in a list of those in use.

    `values` has a column or more per n-gram.
    """
    used, at = np.unique(words, return_inverse=True)
    at = at.reshape(words.shape)
    order = np.argsort(at[:, 0], kind="stable")
    at, values = at[order], np.ascontiguousarray(values[order].T)
    steps = np.diff(at[:, 0], prepend=0)
    places = [_planes(column) for column in (steps, *at.T[1:])]
    head = np.array([len(used), words.shape[1], len(values)])
    if values.max(initial=0) < 2**32:
        return _row(r, len(words), head, used, *places, *map(_planes, values))
    return _row(r, len(words), -head, used, *places, values.astype(np.int64))


def _unpacked(n: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams and their values, as they were packed."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    head = np.frombuffer(data, np.int64, 3)
    size, width, columns = np.abs(head).tolist()
    used, at = np.frombuffer(data, np.uint64, size, 24), 24 + 8 * size

    def planes(count: int) -> list[np.ndarray]:
        nonlocal at
        found = np.frombuffer(data, np.uint8, 4 * n * count, at).reshape(count, 4, n)
        at += 4 * n * count
        return [np.ascontiguousarray(p.T).view("<u4")[:, 0] for p in found]

    steps, *rest = planes(width)
    words = np.stack([used[np.cumsum(steps)], *(used[p] for p in rest)], axis=1)
    if head[0] >= 0:
        values = np.stack(planes(columns), axis=1).astype(np.int64)
    else:
        values = np.frombuffer(data, np.int64, n * columns, at).reshape(columns, n).T
    return words, values


def _saved(path: str, array: np.ndarray) -> None:
    """Written aside and renamed: a task that runs again leaves the same file."""
    aside = f"{path}.{os.getpid()}.{np.random.default_rng().integers(1 << 62)}"
    with open(aside, "wb") as file:
        array.tofile(file)
    os.replace(aside, path)


def _file(folder: str, level: int, r: int, what: str) -> str:
    return f"{folder}/{level}-{r:05d}.{what}"


PACKED = "range int, n long, data binary"


def _merged(words: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct n-grams, their words, and the sums of their values."""
    keys = gram_hash(words)
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    total = np.add.reduceat(values[order], starts, axis=0) if len(keys) else values
    return keys[starts], words[order[starts]], total


def _sent(words: np.ndarray, values: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """The n-grams summed and packed for the range that each belongs to."""
    keys, words, values = _merged(words, values)
    for r, part in _ranges(keys, ranges):
        yield _packed(r, words[part], values[part])


def _count(order: int, ranges: int):
    """Task: texts to packed distinct n-grams with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = np.concatenate(held)
            yield from _sent(words, np.ones((len(words), 1), np.int64), ranges)

        for batch in batches:
            for piece in pieces(batch):
                held.append(grams(*token_hashes(texts_of(piece)), order))
                size += held[-1].size
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _summary(level: int, r: int, *numbers: int) -> pa.RecordBatch:
    """A row about the files of a range, which later steps hand on."""
    data = np.array([level, *numbers], np.int64).tobytes()
    columns = [pa.array([r], pa.int32()), pa.array([-1], pa.int64()), pa.array([data], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["range", "n", "data"])


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _merge(folder: str, ranges: int, level: int, order: int):
    """Task: n-grams of a length and range to files, and statistics of those one word shorter."""

    def shorter(words: np.ndarray, counts: np.ndarray, adjusted: np.ndarray) -> Iterator[pa.RecordBatch]:
        # What begins with NONE is a shorter one that begins a text: it is counted, as it is, there.
        full = words[:, 0] != NONE
        a, none = adjusted[full], np.zeros(int(full.sum()), np.int64)
        as_context = np.stack([a, a == 1, a == 2, a > 2, none, none], axis=1)
        as_ending = np.stack([none, none, none, none, counts[full], none + 1], axis=1)
        none = np.zeros(int((~full).sum()), np.int64)
        as_begin = np.stack([none, none, none, none, counts[~full], counts[~full]], axis=1)
        sent = [(words[full, :-1], as_context), (words[full, 1:], as_ending), (words[~full, 1:], as_begin)]
        yield from _sent(*(np.concatenate(x) for x in zip(*sent, strict=True)), ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            about_files = pc.less(batch.column("n"), 0)
            if pc.any(about_files).as_py():
                yield batch.filter(about_files)
            for row in batch.filter(pc.invert(about_files)).to_pylist():
                found.setdefault(row["range"], []).append(_unpacked(row["n"], row["data"]))
        while found:
            r, parts = found.popitem()
            keys, words, values = _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            if level == 1:
                count, before = values[:, 4], values[:, 5]
                _saved(_file(folder, 1, r, "hash"), keys)
                _saved(_file(folder, 1, r, "values"), values)
                more = (count.sum(), (count > 0).sum(), before.sum(), (before >= 3).sum())
                yield _summary(1, r, len(keys), *_counts_of_counts(before), *map(int, more))
                continue
            counts, adjusted = (values[:, 0],) * 2 if level == order else (values[:, 4], values[:, 5])
            yield from shorter(words, counts, adjusted)
            kept = words[:, 0] != NONE
            if kept.any():
                top = level == order
                wide = top and counts.max() >= 2**32
                stored = counts.astype("u8" if wide else "u4") if top else values
                _saved(_file(folder, level, r, "hash"), keys[kept])
                _saved(_file(folder, level, r, "values"), stored[kept])
                yield _summary(level, r, int(kept.sum()), *_counts_of_counts(adjusted[kept]))

    return run


@dataclass(frozen=True)
class NgramModel:
    """Where the files are, and the few numbers that hold for all words.

    `discounts` are those of each length from one word on, `filled` the ranges of each that
    have files.
    """

    folder: str
    order: int
    ranges: int
    discounts: tuple[tuple[float, float, float], ...]
    filled: tuple[frozenset[int], ...]
    tokens: int
    distinct: int
    types: int
    spare: float

    def reader(self) -> Reader:
        return Reader(self)

    def delete(self) -> None:
        """Remove the files; nothing can be scored after that."""
        shutil.rmtree(self.folder, ignore_errors=True)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    if not (n1 and n2 and n3):
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d < k + 1 else 0.5 for k, d in enumerate(raw))


def train(texts: DataFrame, order: int = 2) -> NgramModel:
    """A model of the texts in column `text`, its files in the shared folder."""
    if order < 2:
        raise ValueError("a model has n-grams of two words at least")
    spark = texts.sparkSession
    shared = shared_folder(spark)
    local_path(shared)
    folder = local_path(WorkFolder(spark, shared).path)
    work = WorkFolder(spark, shared)
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = texts.select("text").mapInArrow(_count(order, ranges), PACKED)
    for level in range(order, 0, -1):
        dealt = rows.repartitionById(ranges, F.col("range"))
        rows = dealt.mapInArrow(_merge(folder, ranges, level, order), PACKED)
    # A few numbers per range and length.
    known = [(r.range, *np.frombuffer(bytes(r.data), np.int64).tolist()) for r in work.write("ranges", rows).collect()]
    work.delete()

    def total(level: int, at: int) -> int:
        return sum(row[at] for row in known if row[1] == level)

    of_level = [discounts(*(total(level, at) for at in range(3, 7))) for level in range(1, order + 1)]
    filled = tuple(frozenset(row[0] for row in known if row[1] == level) for level in range(1, order + 1))
    tokens, distinct, types, many = (total(1, at) for at in range(7, 11))
    n1, n2, d = total(1, 3), total(1, 4), of_level[0]
    spare = (d[0] * n1 + d[1] * n2 + d[2] * many) / types if types else 1.0
    return NgramModel(folder, order, ranges, tuple(of_level), filled, tokens, distinct, types, spare)


class Reader:
    """Look-ups in the mapped files, for one task."""

    def __init__(self, model: NgramModel) -> None:
        self.model = model
        self._open: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _files(self, level: int, r: int) -> tuple[np.ndarray, np.ndarray]:
        if (level, r) not in self._open:
            keys, values = (_file(self.model.folder, level, r, what) for what in ("hash", "values"))
            if not os.path.exists(keys):
                raise FileNotFoundError(f"the model's file is out of reach: {keys}")
            mapped = np.memmap(keys, "u8", "r")
            if level == self.model.order:
                stored = np.memmap(values, f"u{os.path.getsize(values) // len(mapped)}", "r")
            else:
                stored = np.memmap(values, "i8", "r").reshape(-1, len(STATS))
            # Plain arrays over the maps: parts of a `memmap` take longer to make than to read.
            self._open[level, r] = np.asarray(mapped), np.asarray(stored)
        return self._open[level, r]

    def look_up(self, level: int, keys: np.ndarray) -> np.ndarray:
        """Values of the n-grams, zero for unknown ones; keys are visited in order."""
        wanted, at_wanted = np.unique(keys, return_inverse=True)
        shape = (len(wanted),) if level == self.model.order else (len(wanted), len(STATS))
        out = np.zeros(shape, np.int64)
        bounds = np.searchsorted(range_of(wanted, self.model.ranges), np.arange(self.model.ranges + 1))
        for r in np.flatnonzero(np.diff(bounds)).tolist():
            if r not in self.model.filled[level - 1]:
                continue
            files = self._files(level, r)
            part = np.arange(bounds[r], bounds[r + 1])
            at = np.minimum(np.searchsorted(files[0], wanted[part]), len(files[0]) - 1)
            known = files[0][at] == wanted[part]
            out[part[known]] = files[1][at[known]]
        return out[at_wanted]

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Per text: tokens, known ones, base score and model score."""
        m, n = self.model, len(texts)
        rows, tokens = token_hashes(texts)
        words = grams(rows, tokens, m.order)
        own = shorter = self.look_up(1, tokens)
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        d = m.discounts[0]
        probability = np.maximum(own[:, 5] - _off(own[:, 5], d), 0) / max(m.types, 1)
        probability = probability + m.spare / (m.distinct + 1)
        for level in range(2, m.order + 1):
            part, d = words[:, m.order - level :], m.discounts[level - 1]
            keys = gram_hash(part)
            found = self.look_up(level, keys)
            adjusted = found if level == m.order else found[:, 5]
            # The context of a token is the n-gram one word shorter that the token before it ends.
            context = np.roll(shorter, 1, axis=0)
            context[first] = self.look_up(level - 1, gram_hash(part[first, :-1]))
            shorter = found
            total, weight = context[:, 0], context[:, 1:4] @ np.array(d)
            high = np.maximum(adjusted - _off(adjusted, d), 0) / np.maximum(total, 1)
            longer = high + weight / np.maximum(total, 1) * probability
            # A context that was never seen, or that would begin before the text, says nothing.
            there = (total > 0) & (part[:, 0] != NONE)
            probability = np.where(there, longer, probability)
        base = (own[:, 4] + 0.5) / (m.tokens + 0.5 * (m.distinct + 1))
        return {
            "n_tokens": np.bincount(rows, minlength=n),
            "n_known": np.bincount(rows, own[:, 4] > 0, n).astype(np.int64),
            "base_score": np.bincount(rows, np.log10(base), n),
            "score": np.bincount(rows, np.log10(probability), n),
        }


def _off(counts: np.ndarray, of: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *of])[np.minimum(counts, 3)]


def scored(docs: DataFrame, model: NgramModel) -> DataFrame:
    """The columns of `docs` but `text`, with tokens, known tokens, both scores and the
    perplexity per token. Columns of these names are replaced."""
    made = ("n_tokens", "n_known", "base_score", "score", "perplexity")
    kept = [c for c in docs.columns if c not in (*made, "text")]
    schema = docs.select(*kept).schema
    for name in made:
        schema = schema.add(name, "long" if name.startswith("n_") else "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            for piece in pieces(batch):
                found = reader.score(texts_of(piece))
                found["perplexity"] = 10 ** np.minimum(-found["score"] / found["n_tokens"], 300)
                columns = [piece.column(c) for c in kept] + [pa.array(found[c]) for c in made]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*kept, "text").mapInArrow(run, schema)
