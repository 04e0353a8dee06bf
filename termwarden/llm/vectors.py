"""Vector codes: product quantisation by k-means over anchors-hierarchy metric trees.

Vectors are cut into parts, and each part position has a codebook of integer entries that
a few rounds of k-means improve. Vectors stay where they are read: each task packs them
into blocks, and of every block and part builds a metric tree once. Anchors are placed far
from each other and take over the parts nearer to them, those that half the distance of
two anchors rules out are not even looked at; anchors are then merged pairwise into larger
balls, upwards to the root, and split again inside where they hold many parts (middle-out).
A ball keeps its centre, radius, number and sum of parts.

A round sends the codebooks down the trees. A ball inherits the entries that its parent
could not rule out and drops those that lie, for all its parts, behind the plane half-way
to the entry nearest its centre. When one is left it owns the ball, and the cached sum and
number are all that is added; parts are compared one by one only in balls without children.
Tasks pass on one sum per entry. Codebooks, at most 256 entries a part, are all that
reaches the driver. Bounds are widened by more than their rounding error, and distances
that decide are exact integers, so results do not depend on blocks or trees.

Rows are dropped whose vector is null or has null or non-finite components; null ids come
last among equals, equal ids are ordered by their vectors. All vectors must have one
length, a multiple of the number of parts; another raises, as do components so large that
squared distances pass 63 bits. Fewer vectors than entries give smaller codebooks, an
empty table an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termwarden.sources.scratch import WorkFolder

#: Vectors of a block, and parts below which a ball is not split.
BLOCK, LEAF = 4096, 48
#: By how much bounds are widened: more than doubles lose on the way.
SLACK = 1e-9


_UNEVEN = "all vectors must have {} components, as the first one"


@dataclass
class Tree:
    """Balls over the rows `lo` to `hi` of `points`; `left` is -1 for those without children."""

    points: np.ndarray
    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data), allow_pickle=False) as held:
            return cls(**{f.name: held[f.name] for f in fields(cls)})


def anchors(points: np.ndarray) -> list[np.ndarray]:
    """Rows of `points` by the anchor that owns them; about the root of their number."""
    wanted = int(np.sqrt(len(points))) + 1
    owner = np.zeros(len(points), np.int64)
    gap = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    places = [0]
    while len(places) < wanted:
        new = int(gap.argmax())
        if gap[new] == 0:
            break
        between = np.sqrt(((points[places] - points[new]) ** 2).sum(axis=1))
        # A part nearer to its anchor than half-way to the new one stays.
        near = np.flatnonzero(gap * 2 >= between[owner] * (1 - SLACK))
        to_new = np.sqrt(((points[near] - points[new]) ** 2).sum(axis=1))
        taken = to_new < gap[near]
        owner[near[taken]], gap[near[taken]] = len(places), to_new[taken]
        places.append(new)
    groups = [np.flatnonzero(owner == at) for at in range(len(places))]
    return [g for g in groups if len(g)]


def merged(points: np.ndarray, groups: list[np.ndarray]):
    """The groups as a binary tree of nested pairs: the two that make the smallest ball first."""
    nodes: list = [(g,) for g in groups]
    centre = np.array([points[g].mean(axis=0) for g in groups])
    size = np.array([len(g) for g in groups], float)
    reach = np.array(
        [np.sqrt(((points[g] - c) ** 2).sum(axis=1)).max() for g, c in zip(groups, centre, strict=True)]
    )

    def across(at: int) -> np.ndarray:
        far = np.sqrt(((centre - centre[at]) ** 2).sum(axis=1))
        out = np.maximum((far + reach + reach[at]) / 2, np.maximum(reach, reach[at]))
        out[at] = np.inf
        return out

    cost = np.array([across(at) for at in range(len(nodes))])
    for _ in range(len(nodes) - 1):
        a, b = np.unravel_index(int(cost.argmin()), cost.shape)
        both = size[a] + size[b]
        new = (centre[a] * size[a] + centre[b] * size[b]) / both
        far = [np.sqrt(((new - centre[x]) ** 2).sum()) + reach[x] for x in (a, b)]
        nodes[a], nodes[b] = (nodes[a], nodes[b]), None
        centre[a], size[a], reach[a] = new, both, max(far)
        gone = np.array([n is None for n in nodes])
        cost[b, :] = cost[:, b] = np.inf
        cost[a, :] = np.where(gone, np.inf, across(a))
        cost[:, a] = cost[a, :]
    return next(n for n in nodes if n is not None)


def planted(points: np.ndarray) -> Tree:
    """The tree over integer points, which it holds in the order of its leaves."""
    real = points.astype(np.float64)
    lo, hi, left, right, order = [], [], [], [], []

    def plant(node) -> int:
        """Number of the ball for a nested pair, or for the rows of one anchor."""
        at = len(lo)
        for column in (lo, hi, left, right):
            column.append(-1)
        lo[at] = len(order)
        if len(node) == 2:
            left[at], right[at] = plant(node[0]), plant(node[1])
        else:
            groups = anchors(real[node[0]]) if LEAF < len(node[0]) else []
            if len(groups) > 1:
                inner = merged(real, [node[0][g] for g in groups])
                left[at], right[at] = plant(inner[0]), plant(inner[1])
            else:
                order.extend(node[0].tolist())
        hi[at] = len(order)
        return at

    # Far outliers make chains of balls, at most one link per row.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * len(points) + 1000))
    plant((np.arange(len(points)),))
    rows = np.array(order, np.int64)
    real, points = real[rows], points[rows]
    spans = list(zip(lo, hi, strict=True))
    centre = np.array([real[a:b].mean(axis=0) for a, b in spans])
    radius = np.array(
        [np.sqrt(((real[a:b] - c) ** 2).sum(axis=1)).max() for (a, b), c in zip(spans, centre, strict=True)]
    )
    total = np.array([points[a:b].sum(axis=0, dtype=np.int64) for a, b in spans])
    small = len(points) and points.size and np.abs(points).max() < 2**31
    return Tree(
        points.astype(np.int32) if small else points,
        rows.astype(np.int32),
        *(np.array(c, np.int32) for c in (lo, hi, left, right)),
        centre,
        radius,
        total,
    )


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to integer entries."""
    most = max((int(np.abs(x).max()) for x in (points, entries) if x.size), default=0)
    bound = 4 * most * most * max(points.shape[1], 1)
    if bound < 2**52:
        a, b = points.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    if bound >= 2**63:
        raise ValueError("components are too large for squared distances of 63 bits")
    a, b = points.astype(np.int64), entries.astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    for at, entry in enumerate(b):
        out[:, at] = ((a - entry) ** 2).sum(axis=1)
    return out


@dataclass
class Codebook:
    """Entries of one part position, with what pruning needs of them."""

    entries: np.ndarray

    def __post_init__(self) -> None:
        self.real = self.entries.astype(np.float64)
        # Of equal entries only the first can ever be the nearest.
        _, first = np.unique(self.entries, axis=0, return_index=True) if self.entries.shape[1] else (0, [0])
        self.distinct = np.sort(first)
        self.apart = np.sqrt(((self.real[:, None, :] - self.real[None, :, :]) ** 2).sum(axis=2))


def balls(tree: Tree, book: Codebook) -> Iterator[tuple[int, np.ndarray]]:
    """The balls that decide, each with the entries left for it, in ascending order.

    One entry owns the ball; where several are left, the ball has no children.
    """
    waiting = [(0, book.distinct)]
    while waiting:
        ball, entries = waiting.pop()
        far = ((book.real[entries] - tree.centre[ball]) ** 2).sum(axis=1)
        nearest = int(far.argmin())
        lead = far - far[nearest]
        need = 2 * tree.radius[ball] * book.apart[entries[nearest], entries]
        left = entries[lead <= need + SLACK * (far + need) + SLACK]
        if len(left) == 1 or tree.left[ball] < 0:
            yield ball, left
        else:
            waiting += [(int(tree.left[ball]), left), (int(tree.right[ball]), left)]


def sums(tree: Tree, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the parts that are nearest to each entry."""
    total = np.zeros(book.entries.shape, np.int64)
    count = np.zeros(len(book.entries), np.int64)
    for ball, left in balls(tree, book):
        lo, hi = tree.lo[ball], tree.hi[ball]
        if len(left) == 1:
            total[left[0]] += tree.total[ball]
            count[left[0]] += hi - lo
            continue
        nearest = left[squares(tree.points[lo:hi], book.entries[left]).argmin(axis=1)]
        np.add.at(total, nearest, tree.points[lo:hi])
        np.add.at(count, nearest, 1)
    return total, count


def assigned(tree: Tree, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each part, in the order the block had."""
    codes, errors = np.zeros(len(tree.order), np.int64), np.zeros(len(tree.order), np.int64)
    for ball, left in balls(tree, book):
        rows = tree.order[tree.lo[ball] : tree.hi[ball]]
        far = squares(tree.points[tree.lo[ball] : tree.hi[ball]], book.entries[left])
        best = far.argmin(axis=1)
        codes[rows], errors[rows] = left[best], far[np.arange(len(rows)), best]
    return codes, errors


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """Components as integers: the floor of `scale` times each."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if scaled.size and np.abs(scaled).max() >= 2**31:
        raise ValueError("components are too large for squared distances of 63 bits")
    return scaled.astype(np.int64)


def _finite(vector: Column) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd)


@dataclass
class Codes:
    """Codebooks by part, and the stored codes `(vec_id, label, codes, error)`."""

    books: list[np.ndarray]
    rows: DataFrame

    def digest(self) -> str:
        """SHA-256 of all entries' components in decimal, by part, entry and position."""
        numbers = (str(x) for book in self.books for x in book.ravel().tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compressed(
    vectors: DataFrame,
    work: WorkFolder,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> Codes:
    """Codes of `vectors`, `(vec_id, embedding, label)`, after that many rounds of k-means.

    `codes` of the result is an array with an entry's number for each part, `error` the sum
    of the parts' squared distances to their entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has to fit into a byte")
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.where(_finite(F.col("embedding")))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries)
    start = [r.embedding for r in first.collect()]
    out = StructType().add(vectors.schema["vec_id"]).add(vectors.schema["label"])
    out = out.add("codes", "binary").add("error", "long")
    if not start:
        empty = vectors.sparkSession.createDataFrame([], out)
        return Codes([], empty)
    length = len(start[0])
    if any(len(vector) != length for vector in start):
        raise ValueError(_UNEVEN.format(length))
    if length % parts:
        raise ValueError(f"vectors of {length} components do not make {parts} equal parts")
    books = whole(np.array(start), scale).reshape(len(start), parts, length // parts).transpose(1, 0, 2)
    trees = _trees(kept, out, parts, length, scale, work)
    for _ in range(rounds):
        books = _improved(trees, books)
    codes = work.write("codes", trees.mapInArrow(_assign(out, books), out))
    return Codes(list(books), codes)


def _trees(kept: DataFrame, out: StructType, parts: int, length: int, scale: int, work: WorkFolder) -> DataFrame:
    """Stored blocks: ids and labels of their vectors, and a tree for each part."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, BinaryType

    schema = StructType()
    for field in out.fields[:2]:
        schema = schema.add(field.name, ArrayType(field.dataType))
    schema = schema.add("trees", ArrayType(BinaryType()))
    arrow = to_arrow_schema(schema)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            vectors = table.column("embedding").combine_chunks()
            sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            if (sizes != length).any():
                raise ValueError(_UNEVEN.format(length))
            values = whole(vectors.flatten().to_numpy(zero_copy_only=False), scale)
            cut = values.reshape(table.num_rows, parts, length // parts)
            trees = [planted(np.ascontiguousarray(cut[:, p])).packed() for p in range(parts)]
            row = {name: [table.column(name).to_pylist()] for name in schema.names[:2]}
            return pa.RecordBatch.from_pydict(row | {"trees": [trees]}, schema=arrow)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                room = BLOCK - sum(b.num_rows for b in held)
                held.append(batch.slice(at, room))
                at += room
                if sum(b.num_rows for b in held) == BLOCK:
                    yield block()
                    held.clear()
        if held:
            yield block()

    return work.write("trees", kept.mapInArrow(plant, schema))


def _improved(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: entries become the floor of their parts' mean."""
    schema = "part int, entry int, number long, total array<long>"

    def rows(totals: dict[tuple[int, int], list]) -> pa.RecordBatch:
        out = [
            {"part": p, "entry": e, "number": n, "total": t.tolist()} for (p, e), (n, t) in totals.items()
        ]
        kinds = [("part", pa.int32()), ("entry", pa.int32()), ("number", pa.int64()), ("total", pa.list_(pa.int64()))]
        return pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Codebook(b) for b in books]
        total = np.zeros(books.shape, np.int64)
        count = np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for held in batch.column("trees"):
                for part, tree in enumerate(held):
                    more, n = sums(Tree.unpacked(tree.as_py()), known[part])
                    total[part] += more
                    count[part] += n
        used = np.argwhere(count)
        yield rows({(int(p), int(e)): [int(count[p, e]), total[p, e]] for p, e in used})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held = totals.setdefault((row["part"], row["entry"]), [0, np.zeros(books.shape[2], np.int64)])
                held[0] += row["number"]
                held[1] += np.array(row["total"], np.int64)
        yield rows(totals)

    # One row per entry and task, then one per entry.
    summed = trees.select("trees").mapInArrow(descend, schema).repartition("part", "entry")
    better = books.copy()
    for row in summed.mapInArrow(gather, schema).collect():
        better[row.part, row.entry] = [x // row.number for x in row.total]
    return better


def _assign(out: StructType, books: np.ndarray):
    """Task: the rows of a block's vectors with their codes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Codebook(b) for b in books]
        for batch in batches:
            for row in range(batch.num_rows):
                trees = [Tree.unpacked(t.as_py()) for t in batch.column("trees")[row]]
                found = [assigned(tree, book) for tree, book in zip(trees, known, strict=True)]
                codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                columns = [pa.array(batch.column(n)[row].as_py(), arrow.field(n).type) for n in out.names[:2]]
                columns.append(pa.array([c.tobytes() for c in codes], pa.binary()))
                columns.append(pa.array(sum(e for _, e in found)))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return assign


def code_digests(vectors: DataFrame, work: WorkFolder) -> DataFrame:
    """`(vec_id, code, error, label_error, codebooks_sha256)` of every vector kept."""
    found = compressed(vectors, work)
    # Labels are summed on the map side; a label may have any share of the vectors.
    by_label = found.rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    by_label = work.write("labels", by_label)
    return found.rows.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id",
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(found.digest()).alias("codebooks_sha256"),
    )
