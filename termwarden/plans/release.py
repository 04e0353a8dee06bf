"""A release: its full tables and everything derived from them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from copy import copy
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from termwarden.context import CheckContext
from termwarden.operators import closure, hierarchies, names, refsets, skew, terms, versions
from termwarden.schemas import FULL_TABLES
from termwarden.sources.packages import Package, load_full, release_name
from termwarden.session import configure
from termwarden.sources.catalog import CatalogStore
from termwarden.sources.scratch import WorkFolder, shared_folder
from termwarden.sources.store import WRITING, ReleaseStore

Store = ReleaseStore | CatalogStore

_SNAPSHOTS = {f"{table}_snap": table for table in FULL_TABLES if table != "owlrefsets"}

#: Derived tables, with the folder for steps of the derivation.
_DERIVED: dict[str, Callable[[Release, WorkFolder], DataFrame]] = {
    "concepts_snap2": lambda r, work: names.with_names(
        r.table("concepts_snap"), r.table("descriptions_snap"), r.context
    ),
    "transitiveclosure": lambda r, work: closure.transitive_closure(
        r.table("concepts_snap"), r.table("relationships_snap"), r.context, work
    ),
    "hierarchies": lambda r, work: hierarchies.hierarchies(
        r.spark,
        r.table("relationships_snap"),
        r.table("descriptions"),
        r.table("languagerefsets"),
        r.context,
        work,
    ),
    "hierarchy_members": lambda r, work: hierarchies.hierarchy_members(
        r.table("transitiveclosure"), r.table("hierarchies")
    ),
    "extension_changes": lambda r, work: versions.extension_changes(
        r.table("concepts"), r.context.release_date, r.context.extension_module
    ),
    "refsets": lambda r, work: refsets.refsets_in_use(
        {
            "language": r.table("languagerefsets_snap"),
            "simple": r.table("simplerefsets_snap"),
        }
    ),
    "refset_terms": lambda r, work: refsets.refset_terms(
        r.table("refsets"),
        r.table("descriptions_snap"),
        r.table("languagerefsets_snap"),
        r.context,
        work,
    ),
    "refset_concepts": lambda r, work: refsets.refset_concepts(
        r.table("refsets"), r.table("concepts_snap2")
    ),
    "language_terms": lambda r, work: versions.language_terms(r.table("descriptions"), r.context),
}

#: Tables that hang on how terms are compared.
_BY_TERM: dict[str, Callable[[Release, WorkFolder], DataFrame]] = {
    "term_index": lambda r, work: terms.term_index(
        r.table("descriptions_snap"),
        r.table("concepts_snap2"),
        r.table("hot_concepts_described"),
        r.context,
        work,
    ),
    "term_keys": lambda r, work: terms.term_keys(r.by_term("term_index"), r.context),
    "hot_terms": lambda r, work: skew.hot_keys(
        r.by_term("term_index"), "key", r.rows_per_task
    ).repartition(1),
}

#: What a release that was added to another derives from that one and the new rows alone.
_ADDED: dict[str, Callable[[Release, Release, WorkFolder], DataFrame]] = {
    **{
        snapshot: lambda r, before, work, snapshot=snapshot, table=table: versions.merged(
            before.table(snapshot), r.published(table)
        )
        for snapshot, table in _SNAPSHOTS.items()
    },
    "concepts_snap2": lambda r, before, work: names.renamed(
        before.table("concepts_snap2"),
        r.table("concepts_snap"),
        r.table("descriptions_snap"),
        before.table("descriptions_snap"),
        r.published("concepts"),
        r.published("descriptions"),
        r.context,
        work,
    ),
    "transitiveclosure": lambda r, before, work: closure.updated_closure(
        before.table("transitiveclosure"),
        closure.changed_subtypes(
            before.table("concepts_snap"),
            r.table("concepts_snap"),
            before.table("relationships_snap"),
            r.table("relationships_snap"),
            r.published("concepts"),
            r.published("relationships"),
            r.context,
        ),
        r.table("concepts_snap"),
        r.table("relationships_snap"),
        r.context,
        work,
    ),
    "language_terms": lambda r, before, work: versions.added_counts(
        before.table("language_terms"),
        versions.language_terms(r.published("descriptions"), r.context),
        "conceptId",
        "terms",
    ),
}

#: Full tables whose new rows decide how much of a table of `_ADDED` changes.
_ADDED_BY = {snapshot: (table,) for snapshot, table in _SNAPSHOTS.items()} | {
    "concepts_snap2": ("concepts", "descriptions"),
    "transitiveclosure": ("concepts", "relationships"),
    "language_terms": ("descriptions",),
}

#: Up to so many new rows their ids are broadcast. With more, what they leave as it was would be
#: shuffled several times to be told apart: such tables are derived from the full ones.
FEW_ROWS = 500_000

#: Columns that checks join row by row, and of which one value may hold many rows.
_HOT_COLUMNS = {
    "hot_concepts_described": ("descriptions_snap", "conceptId"),
    "hot_language_members": ("languagerefsets_snap", "referencedComponentId"),
    "hot_language_refsets": ("languagerefsets_snap", "refsetId"),
    "hot_simple_members": ("simplerefsets_snap", "referencedComponentId"),
    "hot_simple_refsets": ("simplerefsets_snap", "refsetId"),
}

#: Everything a complete release holds, in an order that derives nothing twice.
TABLES = (*FULL_TABLES, *_SNAPSHOTS, *_DERIVED, *_HOT_COLUMNS, *_BY_TERM)

_PARTITIONS = (
    dict.fromkeys(FULL_TABLES, ("effectiveTime",))
    | dict.fromkeys(_SNAPSHOTS, ("active",))
    | {"concepts_snap2": ("active",)}
)


class Release:
    """Tables of one release by name.

    `full` gives the component tables, as DataFrames or as functions that make them;
    `dated` says that they are stored by date already, so that they are not stored on the
    way.
    A table is derived when first asked for, stored, and read from the store from then
    on: checks share the snapshots and the closure instead of repeating them. Each object
    that derives tables is a build of its own in the store; other builds of the release
    are left alone, and `build` lists it in place of the one listed before.
    """

    def __init__(
        self,
        spark: SparkSession,
        name: str,
        full: Mapping[str, DataFrame | Callable[[], DataFrame]],
        context: CheckContext | None = None,
        store: Store | None = None,
        rows_per_task: int = skew.ROWS_PER_TASK,
        dated: bool = False,
    ) -> None:
        configure(spark)
        self.spark = spark
        self.name = name
        self.context = context or CheckContext.for_release(name)
        self._own: WorkFolder | None = None
        self.store = store or ReleaseStore(spark, self.own_folder().path)
        self.rows_per_task = rows_per_task
        self.ordered = True
        #: Whether full tables are brought together by date before they are stored: fewer
        #: files for one more shuffle, where dates are many and tasks as well.
        self.gathered = False
        #: Rows of checks that share a scan, once it has been made.
        self.shared: DataFrame | None = None
        self._built_collation = self.context.collation
        self._full = full
        self._tables: dict[str, DataFrame] = {}
        #: Full tables whose rows are stored with the mark of latest versions.
        self._marked: dict[str, DataFrame] = {}
        self._locks: defaultdict[str, Lock] = defaultdict(Lock)
        self._build_id = self.store.new_build()
        self._before: Release | None = None
        #: The release whose tables are read instead of own ones, except for hot values.
        self._shared_tables: Release | None = None
        #: Whether the full tables given come by date, as those of another release do.
        self.dated = dated
        self._earlier: tuple[tuple[str, str], ...] = ()
        self._published: dict[str, DataFrame] = {}

    @classmethod
    def load(
        cls,
        spark: SparkSession,
        base: Package,
        extension: Package | None = None,
        store: Store | None = None,
        **overrides,
    ) -> Release:
        """Release from package folders; `overrides` go to its context."""
        name = release_name(base, extension)
        full = {
            table: lambda table=table: load_full(spark, table, base, extension, marks=True)
            for table in FULL_TABLES
        }
        return cls(spark, name, full, CheckContext.for_release(name, **overrides), store)

    @classmethod
    def load_next(
        cls, before: Release, base: Package, extension: Package | None = None, **overrides
    ) -> Release:
        """The release after `before`, from package folders.

        Of their full tables only rows since `before`'s last base release are ranked.
        """
        since = before.context.base_release_date
        published = {
            table: lambda table=table: load_full(before.spark, table, base, extension, since)
            for table in FULL_TABLES
        }
        return cls.added(before, release_name(base, extension), published, **overrides)

    @classmethod
    def added(
        cls,
        before: Release,
        name: str,
        published: Mapping[str, DataFrame | Callable[[], DataFrame]],
        dated: bool = False,
        **overrides,
    ) -> Release:
        """The release that `published` rows make of the stored release `before`.

        Its full tables are those of `before` and the rows whose keys are new, which alone
        are stored. Snapshots, names and the closure are changed where the new rows ask for
        it; the history is not ranked again unless they are more than `FEW_ROWS`. What they
        were built with cannot change.
        """
        context = before.context.at_release(name, overrides)
        options = {"rows_per_task": before.rows_per_task, "dated": dated}
        release = cls(before.spark, name, published, context, before.store, **options)
        release._before = before
        release._earlier = (*before._earlier, (before.name, before._build_id))
        return release

    @classmethod
    def open(cls, store: Store, name: str, **overrides) -> Release:
        """A release the store holds complete, with the context it was built with.

        `overrides` may change what only checks read; another value for a field that
        stored tables depend on raises.
        """
        listing = store.listing(name)
        if listing is None:
            raise KeyError(f"no such release: {name}")
        built = CheckContext.from_json(listing.context)
        release = cls(store.spark, name, {}, built.reopened(overrides), store)
        release._built_collation = built.collation
        release._build_id, release._earlier = listing.build, listing.earlier
        for table in TABLES:
            release._tables[table] = store.read(table, name, _schema_of(table), listing)
        return release

    def table(self, name: str) -> DataFrame:
        """A stored table; the first caller derives it, others wait for that table only."""
        if self._shared_tables is not None and not name.startswith("hot_"):
            return self._shared_tables.table(name)
        with self._locks[name]:
            if name not in self._tables:
                work = self.work()
                stored = self.store.write(
                    name,
                    self.name,
                    self._build_id,
                    self._derive(name, work),
                    _PARTITIONS.get(name, ()),
                    gather=name in FULL_TABLES and self.gathered and not self.dated,
                )
                if name in FULL_TABLES and self._before is not None:
                    self._published[name] = stored
                    stored = self._before.table(name).unionByName(stored)
                if versions.LATEST in stored.columns:
                    self._marked[name] = stored
                    stored = stored.drop(versions.LATEST)
                self._tables[name] = stored
                work.delete()
            return self._tables[name]

    def cut_at(self, rows_per_task: int) -> Release:
        """This release with values called hot from other numbers of rows on.

        Its other tables are this one's, derived when first asked for.
        """
        other = Release(self.spark, self.name, {}, self.context, rows_per_task=rows_per_task)
        other._shared_tables = self
        return other

    def source(self, table: str) -> DataFrame:
        """Rows of a full table given to this release: read if they are stored already.

        For a copy made once, which would otherwise have them stored twice.
        """
        return self.marked(table).drop(versions.LATEST)

    def marked(self, table: str) -> DataFrame:
        """`source` with the mark of latest versions, where rows come with it."""
        if self._shared_tables is not None:
            return self._shared_tables.marked(table)
        if table not in self._tables and table in self._full:
            given = self._full[table]
            return given() if callable(given) else given
        rows = self.table(table)
        if table not in self._full and not self._earlier and table not in self._marked:
            # Of an opened release; one that was added to another has no marks of its own.
            stored = self.store.read_part(table, self.name, self._build_id)
            if versions.LATEST in stored.columns:
                fields = [*FULL_TABLES[table], stored.schema[versions.LATEST]]
                stored = self.store.read_part(table, self.name, self._build_id, StructType(fields))
                self._marked[table] = stored
        return self._marked.get(table, rows)

    def published(self, table: str) -> DataFrame:
        """The rows of a full table that this release adds to the one before."""
        self.table(table)
        return self._published[table]

    def _adds_few(self, tables: Sequence[str]) -> bool:
        return all(self.published(table).count() <= FEW_ROWS for table in tables)

    def build(self, parallel: int = 4) -> Release:
        """Derive and store every table, then list the release as complete.

        Tables are started in an order in which each comes after those it reads, so some
        can be made side by side without a wait that never ends.
        """
        with ThreadPoolExecutor(parallel) as pool:
            list(pool.map(self.table, TABLES))
        self.store.add_release(
            self.name, self.context.to_json(), self._build_id, self._earlier
        )
        return self

    def unordered(self) -> Release:
        """This release for reports that have no use for the order of a check's rows."""
        other = copy(self)
        other.ordered = False
        return other

    def in_order(self, rows: DataFrame, *order: Column | str) -> DataFrame:
        return rows.orderBy(*order) if self.ordered else rows

    def work(self) -> WorkFolder:
        """A fresh folder for the steps of one derivation."""
        return WorkFolder(self.spark, shared_folder(self.spark), WRITING)

    def own_folder(self) -> WorkFolder:
        """The folder of what lives as long as this object."""
        if self._own is None:
            self._own = self.work()
        return self._own

    def kept(
        self, name: str, make: Callable[[], DataFrame], partition_by: Sequence[str] = ()
    ) -> DataFrame:
        """A result stored beside the release, made when first asked for."""
        with self._locks[f"kept {name}"]:
            if name not in self._tables:
                self._tables[name] = self.own_folder().write(name, make(), partition_by)
            return self._tables[name]

    def by_term(self, name: str) -> DataFrame:
        """A table of terms under the comparison of this release's context.

        Those stored have the comparison of the build; under another one they are made
        anew and kept beside the release.
        """
        if self.context.collation == self._built_collation:
            return self.table(name)
        work = self.work()
        made = self.kept(f"{name} {self.context.collation}", lambda: _BY_TERM[name](self, work))
        work.delete()
        return made

    def close(self) -> None:
        """Remove what was stored for this object alone."""
        if self._own is not None:
            self._own.delete()
            self._own = None

    def _derive(self, name: str, work: WorkFolder) -> DataFrame:
        if name in self._full:
            source = self._full[name]
            rows = source() if callable(source) else source
            if self._before is not None:
                rows = rows.drop(versions.LATEST)
                loaded = rows if self.dated else work.write("loaded", rows)
                return versions.unpublished(self._before.table(name), loaded)
            return rows
        if self._before is not None and name in _ADDED and self._adds_few(_ADDED_BY[name]):
            return _ADDED[name](self, self._before, work)
        if name in _SNAPSHOTS:
            table = _SNAPSHOTS[name]
            if self._before is not None:
                return versions.reranked(self._before.table(table), self.published(table))
            rows = self.table(table)
            if table in self._marked:
                return versions.latest(self._marked[table])
            return versions.snapshot(rows)
        if name in _DERIVED:
            return _DERIVED[name](self, work)
        if name in _BY_TERM:
            return _BY_TERM[name](self, work)
        if name in _HOT_COLUMNS:
            table, column = _HOT_COLUMNS[name]
            # At most a five-millionth of the rows: one file, which joins broadcast. They are
            # shuffled for it, as one task would otherwise count the values of all rows.
            return skew.hot_keys(self.table(table), column, self.rows_per_task).repartition(1)
        raise KeyError(f"no such table: {name}; there are {', '.join(TABLES)}")


def _schema_of(table: str) -> StructType | None:
    """Schema of a table whose columns are in the order of a component table."""
    if table == "concepts_snap2":
        named = (StructField(name, StringType()) for name in ("fsn", "semtag"))
        return StructType([*FULL_TABLES["concepts"], *named])
    return FULL_TABLES.get(_SNAPSHOTS.get(table, table))
