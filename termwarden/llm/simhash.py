"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint of eight bytes is listed under bytes at fixed positions. Two fingerprints that
differ in at most R <= 4 bits share at least 8 - R positional bytes, the guaranteed minimum.
Tallying every list of a single byte would visit a 256th of all pairs, so lists are
refined to triples of positions that any four shared positions contain one of: 20 of the
56 do (`triples`, a Turan covering), and a list then holds one in 2^24. Within a list, the
shared positional bytes of each pair are tallied, pairs below the minimum go, and the rest
is verified bit by bit. No link is lost.

Equal fingerprints are collapsed before that. Lists are counted, all of them and exactly.
Those with more than `BLOCK` entries are refined once more, by each further position, as
every linked pair shares a fourth one. What is still crowded then is cut into blocks: first
each block is compared in itself, and links become components; only lists whose entries are
not all in one component by then are compared across blocks, and there only what is in
different ones. Tasks pass on a spanning forest of the links of a list, never its pairs.

Null texts count as empty; texts without words have fingerprint zero and are linked like
any other. Null ids are below all others. Repeated rows have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwarden.llm.common import pieces, texts_of
from termwarden.llm.components import components
from termwarden.sources.scratch import WorkFolder

#: Shingles hashed at a time.
SHINGLES = 16_384

#: Bytes of a fingerprint, entries of a list or of a block of one that a task compares, and
#: differing bits up to which `triples` covers all that two fingerprints share.
WIDTH, BLOCK, MOST_BITS = 8, 512, 4


def triples(positions: int = 8) -> list[tuple[int, ...]]:
    """Triples of positions of which any four positions contain one.

    Positions are dealt to three classes in a circle; a triple is in if it lies in one
    class, or has two members in a class and one in the next.
    """
    kept = []
    for triple in combinations(range(positions), 3):
        classes = sorted(p % 3 for p in triple)
        if classes in ([0, 0, 0], [1, 1, 1], [2, 2, 2], [0, 0, 1], [1, 1, 2], [0, 2, 2]):
            kept.append(triple)
    return kept


def fingerprint(text: str, words: int) -> bytes:
    """SimHash of the word shingles, big-endian, repeats counted."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return bytes(WIDTH)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(parts))
    starts, ends = starts[: len(parts) - size + 1].tolist(), ends[size - 1 :].tolist()
    total, digest = np.zeros(WIDTH * 8, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES):
        spans = zip(starts[at : at + SHINGLES], ends[at : at + SHINGLES], strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], ">u8")
        table = hashes.view(np.uint8).reshape(len(hashes), WIDTH)
        total += np.unpackbits(table, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(starts)).tobytes()


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """The other columns of `docs` with `fingerprint` (binary) in place of `text`."""
    kept = [c for c in docs.columns if c not in ("text", "fingerprint")]
    schema = docs.select(*kept).schema.add("fingerprint", "binary")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                marks = [fingerprint(t, words) for t in texts_of(piece).to_pylist()]
                columns = [piece.column(c) for c in kept] + [pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*kept, "text").mapInArrow(compute, schema)


_ENTRY = "list long, node long, fingerprint binary"


def _listed(marks: DataFrame) -> DataFrame:
    """Every `(node, fingerprint)` once per triple: `list` numbers the triple and its bytes."""
    sets = triples()

    def enlist(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _matrix(batch.column("fingerprint"))
            for number, positions in enumerate(sets):
                value = np.full(len(table), number, np.int64)
                for p in positions:
                    value = (value << 8) | table[:, p].astype(np.int64)
                columns = [pa.array(value), batch.column("node"), batch.column("fingerprint")]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "node", "fingerprint"])

    return marks.select("node", "fingerprint").mapInArrow(enlist, _ENTRY)


def _refined(entries: DataFrame) -> DataFrame:
    """Entries of triples once per further position, listed under its byte as well."""
    sets = np.array(triples())

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _matrix(batch.column("fingerprint"))
            value = batch.column("list").to_numpy()
            of_set = sets[value >> 24]
            for p in range(WIDTH):
                other = np.flatnonzero((of_set != p).all(axis=1))
                finer = (value[other] << 11) | (p << 8) | table[other, p].astype(np.int64)
                rest = batch.take(pa.array(other))
                # Bit 62 keeps numbers of finer lists apart from those of triples.
                columns = [pa.array(finer | 1 << 62), rest.column("node"), rest.column("fingerprint")]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "node", "fingerprint"])

    return entries.select("list", "node", "fingerprint").mapInArrow(refine, _ENTRY)


def _matrix(column: pa.Array) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(-1, WIDTH)


def _forest(most_bits: int):
    """Task: entries grouped by list and block pair to edges of spanning forests.

    Entries of the same `root` are known to be linked and are not compared.
    """
    least_bytes = WIDTH - most_bits

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for batch in batches:
            if batch.num_rows:
                for at, name in enumerate(("list", "pair", "node", "root")):
                    columns[at].append(batch.column(name).to_numpy())
                columns[4].append(_matrix(batch.column("fingerprint")))
        if not columns[0]:
            return
        lists, pairs, nodes, known, table = (np.concatenate(c) for c in columns)
        order = np.lexsort((nodes, pairs, lists))
        lists, pairs, nodes, known, table = (x[order] for x in (lists, pairs, nodes, known, table))
        marks = np.ascontiguousarray(table).view(np.uint64).reshape(len(table))
        fresh = np.concatenate([[True], (np.diff(lists) != 0) | (np.diff(pairs) != 0)])
        group = np.cumsum(fresh)
        root = np.arange(len(nodes))
        step, left = 1, np.flatnonzero(group[:-1] == group[1:])
        while left.size:
            for part in np.array_split(left, -(-left.size // 1_000_000)):
                a, b = part, part + step
                apart = known[a] != known[b]
                a, b = a[apart], b[apart]
                differ = marks[a] ^ marks[b]
                shared = (differ.view(np.uint8).reshape(len(a), WIDTH) == 0).sum(axis=1)
                enough = shared >= least_bytes
                a, b, differ = a[enough], b[enough], differ[enough]
                near = np.bitwise_count(differ) <= most_bits
                _unite(root, a[near], b[near])
            step += 1
            left = left[left + step < len(nodes)]
            left = left[group[left] == group[left + step]]
        root = _roots(root)
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        linked = linked[nodes[linked] != nodes[root[linked]]]
        edges = [pa.array(nodes[linked]), pa.array(nodes[root[linked]])]
        yield pa.RecordBatch.from_arrays(edges, names=["a", "b"])

    return link


def _roots(root: np.ndarray) -> np.ndarray:
    while not np.array_equal(root, above := root[root]):
        root = above
    return root


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i]; roots are the smallest positions."""
    while a.size:
        root[:] = _roots(root)
        a, b = root[a], root[b]
        apart = a != b
        a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
        np.minimum.at(root, a, b)


def _crowded(entries: DataFrame, work: WorkFolder, name: str) -> DataFrame:
    """Lists with more entries than a block, `(list, blocks)`; counted on the map side first."""
    counted = entries.groupBy("list").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK)
    return work.write(name, counted.select("list", F.ceil(F.col("_n") / BLOCK).cast("long").alias("blocks")))


def linked_components(marks: DataFrame, work: WorkFolder, most_bits: int = MOST_BITS) -> DataFrame:
    """`(node, root)` of the nodes that have a link.

    `marks` holds distinct fingerprints, `(node long, fingerprint binary)`, stored.
    """
    if not 0 <= most_bits <= MOST_BITS:
        raise ValueError(f"lists cover up to {MOST_BITS} differing bits")
    parts = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = F.lit(0).cast("long")

    def compared(entries: DataFrame) -> DataFrame:
        dealt = entries.select("list", "pair", "node", "root", "fingerprint")
        return dealt.repartition(parts, "list", "pair").mapInArrow(_forest(most_bits), "a long, b long")

    def as_list(entries: DataFrame) -> DataFrame:
        return entries.withColumns({"pair": whole, "root": F.col("node")})

    # Nodes are few bytes each, their twenty entries are not: deal them before they are listed.
    listed = _listed(marks.repartition(parts, "node"))
    crowded = _crowded(listed, work, "crowded")
    found = compared(as_list(listed.join(crowded, "list", "left_anti")))
    if crowded.isEmpty():
        return components(work.write("links", found), work)
    finer = work.write("finer", _refined(listed.join(crowded, "list", "left_semi")))
    still = _crowded(finer, work, "still")
    found = found.unionByName(compared(as_list(finer.join(still, "list", "left_anti"))))
    own = F.pmod(F.xxhash64("node"), "blocks")
    blocks = work.write("blocks", finer.join(still, "list").withColumn("own", own))
    found = found.unionByName(compared(blocks.withColumns({"pair": F.col("own"), "root": F.col("node")})))
    first = work.write("links", found)
    roots = components(first, work)
    # A list whose entries are in one component by now needs no comparison across blocks.
    rooted = blocks.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = work.write("rooted_blocks", rooted)
    several = rooted.groupBy("list").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b")
    torn = rooted.join(several.select("list"), "list", "left_semi")
    across = torn.withColumn("_other", F.explode(F.sequence(whole, F.col("blocks") - 1))).where("_other <> own")
    low, high = F.least("own", "_other"), F.greatest("own", "_other")
    more = compared(across.withColumn("pair", low * F.col("blocks") + high))
    return components(first.unionByName(work.write("more_links", more)), WorkFolder(work.spark, work.path))


def near_duplicates(
    docs: DataFrame, work: WorkFolder, words: int = 4, most_bits: int = MOST_BITS
) -> DataFrame:
    """The other columns of `docs` with `fingerprint`, `component_id` and `component`
    (replaced if there).

    `component_id` is the smallest id of all documents whose fingerprints are linked with
    the row's, directly or over others. Ids may be null or stand for several texts;
    `component` is the number of the component itself. `text` is not returned.
    """
    marked = work.write("marked", fingerprints(docs.drop("component_id", "component"), words))
    # One node per distinct fingerprint. Numbers follow the written files.
    distinct = work.write(
        "distinct", marked.groupBy("fingerprint").agg(F.min("doc_id").alias("_smallest"))
    )
    nodes = work.write("nodes", distinct.withColumn("node", F.monotonically_increasing_id()))
    roots = linked_components(nodes, work, most_bits)
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = work.write("rooted", rooted)
    smallest = work.write(
        "smallest", rooted.groupBy("root").agg(F.min("_smallest").alias("component_id"))
    )
    named = work.write(
        "named",
        rooted.join(smallest, "root").select(
            "fingerprint", "component_id", F.col("root").alias("component")
        ),
    )
    return marked.join(named, "fingerprint")
