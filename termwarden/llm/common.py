"""What the text operators share: words, folds, row numbers, prefix sums, Arrow batches.

Words are runs of anything but ASCII white space, and only A-Z are lower-cased, so that
results do not depend on a locale. Tasks cut their Arrow batches into pieces of bounded
size, because one batch may hold many long texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termwarden.sources.scratch import WorkFolder, shared_folder

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits of a row's number that count within the task that wrote it.
ROWS_OF_PART = 33

#: Bytes of text that a task works on at a time; a longer text is a piece of its own.
PIECE_BYTES = 2 << 20


def work_folder(df: DataFrame) -> WorkFolder:
    spark = df.sparkSession
    return WorkFolder(spark, shared_folder(spark))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's digits, modulo the number of folds; a null id is in fold 0."""
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return (crc % folds).cast("int")


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `PIECE_BYTES` of text each, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + PIECE_BYTES, side="right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def give_back() -> None:
    """Return memory that was freed to the system: workers live on and share a machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """Texts with null as empty."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For every word the row it is in, and the words, all in order."""
    lists = pc.ascii_split_whitespace(texts)
    rows, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    filled = pc.greater(pc.binary_length(words), 0)
    return (
        pc.filter(rows, filled).to_numpy(zero_copy_only=False).astype(np.int64),
        pc.filter(words, filled),
    )


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered(docs: DataFrame, work: WorkFolder, name: str = "numbered") -> DataFrame:
    """`(_doc, _row)`: rows as structs with a number of their own that stays.

    Rows that are read from files as they are have the number of their file and their place in
    it, and are not written again; others are stored with numbers first.
    """
    if not _read_from_files(docs):
        rows = docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row"))
        return work.write(name, rows)
    path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    # One row per file, as many as the planner lists.
    found = sorted(r[0] for r in docs.select(path).distinct().collect())
    files = docs.sparkSession.createDataFrame(list(enumerate(found)), "_file long, _path string")
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), path.alias("_path"), place.alias("_place"))
    number = F.shiftleft("_file", ROWS_OF_PART) + F.col("_place")
    return rows.join(F.broadcast(files), "_path").select("_doc", number.alias("_row"))


def _read_from_files(docs: DataFrame) -> bool:
    """Whether these are the rows of Parquet files, once each and all of them."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() == "Project":
        columns = plan.projectList()
        if any(columns.apply(i).getClass().getSimpleName() != "AttributeReference" for i in range(columns.size())):
            return False
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString()


def with_facts(
    stored: DataFrame, facts: DataFrame, work: WorkFolder, name: str, every: bool = False
) -> DataFrame:
    """The columns of the numbered rows that have a fact, with the facts' other columns.

    With `every` all rows, with nulls for those that have none.

    `stored` comes from `numbered`; `facts` has one row per `_row` at most. A row's number
    tells which file it is in or which task stored it, so facts are stored by that, sorted,
    and whoever reads rows looks their facts up there: rows as wide as texts are never shuffled.
    What a task holds are the facts of the rows of one file.
    """
    facts = facts if len(facts.columns) > 1 else facts.withColumn("_there", F.lit(True))
    added = [c for c in facts.columns if c != "_row"]
    if clash := set(added) & {"_doc", "_row"}:
        raise ValueError(f"facts cannot be called {', '.join(sorted(clash))}")
    path = f"{work.path}/{name}"
    listed = facts.withColumn("_part", F.shiftright("_row", ROWS_OF_PART))
    listed.repartition("_part").sortWithinPartitions("_part", "_row").write.partitionBy("_part").parquet(path)
    kind = StructType([facts.schema[column] for column in added])

    @F.arrow_udf(kind)
    def fact_of(rows: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        fields = list(to_arrow_type(kind))
        number = rows.to_numpy()
        of_part = []
        bounds = np.flatnonzero(np.diff(number >> ROWS_OF_PART)) + 1
        for run in np.split(number, bounds):
            known = _part_of(path, int(run[0] >> ROWS_OF_PART) if len(run) else 0, ("_row", *added))
            there = known.column("_row").to_numpy()
            at = np.minimum(np.searchsorted(there, run), max(len(there) - 1, 0))
            missing = there[at] != run if len(there) else np.ones(len(run), bool)
            found = known.take(pa.array(at, mask=missing))
            columns = [found.column(f.name).combine_chunks().cast(f.type) for f in fields]
            of_part.append(pa.StructArray.from_arrays(columns, fields=fields, mask=pa.array(missing)))
        return pa.concat_arrays(of_part)

    # Only numbers go to Python; rows wait for their facts where they are.
    found = stored.withColumn("_fact", fact_of.asNondeterministic()("_row"))
    if not every:
        found = found.where("_fact IS NOT NULL")
    return found.select("_doc.*", *(f"_fact.{c}" for c in added if c != "_there"))


_held: dict[tuple[str, int, tuple[str, ...]], pa.Table] = {}


def _part_of(path: str, part: int, columns: tuple[str, ...]) -> pa.Table:
    """The facts of a part; a worker holds those that it read last."""
    key = (path, part, columns)
    if key not in _held:
        _held.clear()
        _held[key] = read_part(path, part, columns)
    return _held[key]


def read_part(path: str, part: int, columns: Sequence[str]) -> pa.Table:
    """What a task reads of a table stored by `_part`, through the storage's own interface."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    if "://" in path:
        files, root = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    else:
        files, root = fs.LocalFileSystem(), path.removeprefix("file:")
    # A folder that cannot be reached is not one without facts.
    if files.get_file_info(root).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no such folder for this task: {path}")
    folder = f"{root}/_part={part}"
    if files.get_file_info(folder).type != fs.FileType.Directory:
        return pa.table({c: pa.array([], pa.int64() if c == "_row" else pa.null()) for c in columns})
    found = pq.ParquetDataset(folder, filesystem=files, partitioning=None).read(columns=list(columns))
    return found.combine_chunks()


def running_sums(
    df: DataFrame, order: Sequence[Column | str], sums: Sequence[str], work: WorkFolder, name: str
) -> DataFrame:
    """The rows with `<column>_before`: the sum of that long column over all rows before.

    Rows are range-partitioned and sorted by `order`; each task sums within its range, and
    only the totals of the ranges, one row per task, meet in the driver. `order` should
    tell all rows apart that differ in a column. Nothing is gathered by key, so one value
    of a column may have any share of the rows.
    """
    spark, names = df.sparkSession, df.columns
    schema = StructType(list(df.schema))
    for column in (*sums, "_at"):
        schema = schema.add(f"{column}_before", "long")
    tie = "_tie"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(k) if isinstance(k, str) else k for k in order]

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, so_far = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            out = [batch.column(c) for c in names]
            for column in sums:
                values = batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(values) + so_far[column]
                out.append(pa.array(ends - values))
                so_far[column] = int(ends[-1]) if len(ends) else so_far[column]
            out.append(pa.array(np.full(batch.num_rows, part, np.int64)))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    ranged = (
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys, tie)
        .sortWithinPartitions(*keys, tie)
        .drop(tie)
    )
    stored = work.write(name, ranged.mapInArrow(sum_up, schema))
    totals = sorted(
        tuple(row)
        for row in stored.groupBy("_at_before")
        .agg(*(F.sum(c).alias(c) for c in sums))
        .select("_at_before", *sums)
        .collect()
    )
    before, offsets = [0] * len(sums), []
    for part, *values in totals:
        offsets.append((part, *before))
        before = [a + (b or 0) for a, b in zip(before, values, strict=True)]
    offset = spark.createDataFrame(
        offsets, "_at_before long, " + ", ".join(f"_o{i} long" for i in range(len(sums)))
    )
    # One row per range, so the broadcast is bounded by the number of tasks.
    joined = stored.join(F.broadcast(offset), "_at_before")
    return joined.select(
        *names,
        *((F.col(f"{c}_before") + F.col(f"_o{i}")).alias(f"{c}_before") for i, c in enumerate(sums)),
    )
