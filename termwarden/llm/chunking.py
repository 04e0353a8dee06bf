"""Substring deduplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text: the last 32 bytes decide it. A chunk
ends where the hash's top `MASK_BITS` bits are zero, once it has `LEAST` bytes, and at
`MOST` bytes at the latest, so an insertion moves only the chunk ends around it and the
chunks after it are the same again. Chunks are compared by a 128-bit digest.

The first occurrence of a chunk, by the number of the row and the place in it, stays;
later ones are repeats. Runs of neighbouring chunks that several rows have and that together
have `PASSAGE` bytes are reported as passages: a repeated passage of 50 words (some 250
bytes) holds several whole chunks, a single repeated line does not. Where first occurrences
and repeats meet in a run, it is cut in two: the part of first occurrences is `kept`, the
part of repeats is not, and only that is cut out of a text. So what is in a passage stays
somewhere, also if its first occurrence adjoins a repeat.

Digests are counted and reduced to their first occurrence on the map side, and joined back
to their occurrences, which the adaptive skew join splits where one digest has many.
Offsets are bytes of the text's UTF-8. Null and empty texts have no chunk. Repeated rows
repeat all their chunks. Null ids are reported as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termwarden.llm.common import mixed, numbered, pieces, texts_of, with_facts
from termwarden.sources.scratch import WorkFolder

#: Bytes of a chunk at least and at most, and zero bits at its end: 8 + 32 on average.
LEAST, MOST, MASK_BITS = 8, 160, 5
#: Bytes of neighbouring repeated chunks that make a passage.
PASSAGE = 130

GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
#: Any ASCII white space counts as a blank, so that re-wrapped passages stay the same.
BLANKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")
#: Bytes hashed at a time.
SPAN = 1 << 20


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    codes, candidates = np.frombuffer(data, np.uint8), []
    for start in range(0, len(codes), SPAN):
        lead = min(31, start)
        rolled = GEAR[codes[start - lead : start + SPAN]]
        for width in (1, 2, 4, 8, 16):
            rolled[width:] += rolled[:-width].copy() << np.uint32(width)
        ends = np.flatnonzero(rolled[lead:] >> np.uint32(32 - MASK_BITS) == 0)
        candidates += (ends + start + 1).tolist()
    ends, last, whole = [], 0, len(codes)
    for end in [*candidates, whole]:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST or (end == whole and end > last):
            last = end
            ends.append(last)
    return ends


def chunks(docs: DataFrame, row: str = "_row") -> DataFrame:
    """`(<row>, doc_id, chunk, start, end, high, low)`: chunks with 128-bit digests."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for piece in pieces(batch):
                counts, ends, digests = [], [], []
                for text in texts_of(piece).to_pylist():
                    data, last = text.encode("utf-8", "surrogatepass").translate(BLANKS), 0
                    points = cut_points(data)
                    counts.append(len(points))
                    ends += points
                    for end in points:
                        digests.append(digest(data[last:end]))
                        last = end
                counts = np.array(counts, np.int64)
                first = np.cumsum(counts) - counts
                at = np.repeat(np.arange(len(counts)), counts)
                chunk = np.arange(len(at)) - first[at]
                end = np.array(ends, np.int64)
                start = np.where(chunk > 0, np.concatenate([[0], end[:-1]]) if len(end) else end, 0)
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                columns = [piece.column(c).take(pa.array(at)) for c in (row, "doc_id")]
                columns += [pa.array(x) for x in (chunk, start, end, halves[:, 0], halves[:, 1])]
                names = [row, "doc_id", "chunk", "start", "end", "high", "low"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = docs.select(row, "doc_id").schema
    for name in ("chunk", "start", "end", "high", "low"):
        schema = schema.add(name, "long")
    return docs.select(row, "doc_id", "text").mapInArrow(cut, schema)


def repeated_passages(docs: DataFrame, work: WorkFolder, within: bool = True) -> DataFrame:
    """`(_row, doc_id, start, end, chunks, repeats, first_row, kept)` per part of a passage.

    `docs` has a long column `_row` that tells its rows apart. `repeats` counts the chunks
    that are no first occurrence, all or none of a part; `first_row` is the smallest row that
    has one of the part's chunks. Chunks that repeat in one row alone count unless `within`
    is false.
    """
    rows = F.min("_row") != F.max("_row")
    found = work.write("chunks", chunks(docs))
    shared = work.write(
        "shared",
        found.groupBy("high", "low")
        .agg(
            ((F.count(F.lit(1)) > 1) & (rows | F.lit(within))).alias("_shared"),
            F.min(F.struct("_row", "chunk")).alias("first"),
        )
        .where("_shared")
        .drop("_shared"),
    )
    again = found.join(shared, ["high", "low"]).select(
        "_row",
        "doc_id",
        "chunk",
        "start",
        "end",
        F.col("first._row").alias("first_row"),
        ((F.col("first._row") != F.col("_row")) | (F.col("first.chunk") != F.col("chunk"))).alias("repeat"),
    )
    # One text's chunks meet here; a run is a stretch of consecutive numbers, a span one of
    # first occurrences or repeats alone.
    in_text = Window.partitionBy("_row").orderBy("chunk")
    turns = F.col("repeat") != F.lag("repeat", 1, False).over(in_text)
    runs = again.withColumns(
        {"_run": F.col("chunk") - F.row_number().over(in_text), "_turns": turns.cast("int")}
    ).withColumn("_span", F.sum("_turns").over(in_text))
    spans = runs.groupBy("_row", "_run", "_span").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.count(F.lit(1)).alias("chunks"),
        F.count_if("repeat").alias("repeats"),
        F.min("first_row").alias("first_row"),
    )
    in_run = Window.partitionBy("_row", "_run")
    length = F.max("end").over(in_run) - F.min("start").over(in_run)
    return (
        spans.withColumn("_length", length)
        .where(F.col("_length") >= PASSAGE)
        .withColumn("kept", F.col("repeats") == 0)
        .drop("_run", "_span", "_length")
    )


def without_repeats(docs: DataFrame, work: WorkFolder) -> DataFrame:
    """The rows with repeats in passages cut out of their texts, first occurrences left.

    Rows come in the order in which `docs` is read. Cuts are at chunk ends, and leave whole
    characters: a character that a cut would split is kept. Null texts stay null. Ids may be
    null or of any type; rows are told apart by numbers of their own. Texts stay where they
    are read; only the spans to cut are looked up there.
    """
    stored = numbered(docs, work)
    light = stored.select("_row", "_doc.doc_id", "_doc.text")
    passages = repeated_passages(light, work).where("not kept")
    spans = passages.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans")
    )
    whole = stored.select("_row", F.struct("_doc").alias("_doc"))
    marked = with_facts(whole, spans, work, "spans", every=True)
    marked = marked.select("_doc", F.col("_doc.text").alias("_text"), "_spans")
    schema = marked.select("_doc", "_text").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("_text"), batch.column("_spans")
            if spans.null_count < batch.num_rows:
                rows = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
                texts = pa.array([t if s is None else rest_of(t, s) for t, s in rows], texts.type)
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), texts], names=schema.names)

    left = marked.mapInArrow(cut, schema)
    return left.select(F.col("_doc").withField("text", F.col("_text")).alias("_doc")).select("_doc.*")


def rest_of(text: str, spans: list[dict[str, int]]) -> str:
    """A text without spans of its bytes."""
    data, last, parts = text.encode("utf-8", "surrogatepass"), 0, []
    for span in spans:
        start, end = span["start"], span["end"]
        while start < end and data[start] & 0xC0 == 0x80:
            start += 1
        while end < len(data) and end > start and data[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(data[last:start])
        last = end
    return b"".join([*parts, data[last:]]).decode("utf-8", "surrogatepass")
