"""The catalogue: checks by id, and how one is run on a release."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termwarden.plans.checks import concepts, descriptions, refsets
from termwarden.plans.release import Release

Param = int | str


@dataclass(frozen=True)
class CheckSpec:
    """A check of the catalogue.

    A nested check builds a relation with a `param` column and is asked for one value
    of it, or, as a second argument, for the values of a frame with that column.
    `param_type` converts what callers pass, typically text. A check with a `lookup` has a
    shorter way to the rows of one value.
    """

    id: str
    description: str
    build: Callable[..., DataFrame]
    nested: bool = False
    param_type: type = str
    lookup: Callable[[Release, Param], DataFrame] | None = None
    sql: str | None = field(default=None, repr=False)

    @property
    def needs_param(self) -> bool:
        return self.nested


class Catalogue:
    """Checks by id, in a fixed order."""

    def __init__(self, checks: Iterable[CheckSpec] = ()) -> None:
        self._checks: dict[str, CheckSpec] = {}
        for check in checks:
            self.register(check)

    def __iter__(self) -> Iterator[CheckSpec]:
        return iter(self._checks.values())

    def register(self, check: CheckSpec) -> CheckSpec:
        if check.id in self._checks:
            raise ValueError(f"check exists already: {check.id}")
        self._checks[check.id] = check
        return check

    def get(self, check_id: str) -> CheckSpec:
        if check_id not in self._checks:
            raise KeyError(f"no such check: {check_id}; there are {', '.join(self._checks)}")
        return self._checks[check_id]

    def listed(self) -> list[CheckSpec]:
        """Checks that run on a release alone, without a parameter."""
        return [check for check in self if not check.needs_param]

    def listing(self, spark: SparkSession) -> DataFrame:
        """The listed checks, `(check_id, description)`."""
        rows = [(check.id, check.description) for check in self.listed()]
        return spark.createDataFrame(rows, "check_id string, description string")

    def run(self, check_id: str, release: Release, param: Param | None = None) -> DataFrame:
        """Rows of a check. A missing parameter is an error, a needless one ignored.

        The parameter is a literal of the plan; it is never pasted into SQL.
        """
        check = self.get(check_id)
        if not check.needs_param:
            return check.build(release)
        if param is None or param == "":
            raise ValueError(f"check {check_id} needs a parameter")
        value = check.param_type(param)
        if check.lookup:
            return check.lookup(release, value)
        return check.build(release).where(F.col("param") == F.lit(value)).drop("param")

    def explain(
        self,
        check_id: str,
        release: Release,
        param: Param | None = None,
        mode: str = "formatted",
    ) -> str:
        """What will be run: the SQL of a check written in it, and the plan."""
        check = self.get(check_id)
        rows = self.run(check_id, release, param)
        view = f"explained_{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(view)
        try:
            plan = release.spark.sql(f"EXPLAIN {mode.upper()} SELECT * FROM {view}").first()[0]
        finally:
            release.spark.catalog.dropTempView(view)
        return f"{check.sql.strip()}\n\n{plan}" if check.sql else plan


def sql_check(
    check_id: str,
    description: str,
    sql: str,
    nested: bool = False,
    param_type: type = str,
) -> CheckSpec:
    """A check written in SQL, for catalogues that users extend.

    `{name}` stands for a table of the release; `:release` and `:base_release` are bound
    to its dates. A nested check selects a `param` column.
    """
    tables = [name for _, name, _, _ in Formatter().parse(sql) if name]

    def build(release: Release) -> DataFrame:
        dates = {
            "release": release.context.release_date,
            "base_release": release.context.base_release_date,
        }
        return release.spark.sql(
            sql, args=dates, **{name: release.table(name) for name in tables}
        )

    return CheckSpec(check_id, description, build, nested, param_type, sql=sql)


# The ids of the checks.
CATALOGUE = Catalogue(
    [
        CheckSpec(
            "new-concepts",
            "New concepts of the release, by hierarchy",
            concepts.new_concepts,
        ),
        CheckSpec(
            "changed-concepts",
            "Concepts changed or inactivated since the previous release",
            concepts.changed_concepts,
        ),
        CheckSpec(
            "promoted-concepts",
            "Concepts promoted to the core module since the previous release",
            concepts.promoted_concepts,
        ),
        CheckSpec(
            "descriptions",
            "New and inactivated descriptions",
            descriptions.description_changes,
        ),
        CheckSpec(
            "funky-chars",
            "Irregular characters in terms",
            descriptions.irregular_characters,
        ),
        CheckSpec(
            "non-translated",
            "Concepts without a translation, by hierarchy",
            concepts.non_translated,
        ),
        CheckSpec(
            "refsets-with-inactive",
            "Refsets with inactive concepts",
            refsets.refsets_with_inactive,
        ),
        CheckSpec(
            "refsets-with-inactive2",
            "Refsets and their number of inactive concepts, zero included",
            refsets.refsets_with_or_without_inactive,
        ),
        CheckSpec(
            "inactive-concepts-in-refsets",
            "Inactive concepts that are active members of refsets",
            refsets.inactive_concepts_in_refsets,
        ),
        CheckSpec(
            "concept-refset-inactive",
            "Descriptions of one concept",
            refsets.concept_descriptions,
            nested=True,
            param_type=int,
        ),
        CheckSpec(
            "duplicate-descriptions",
            "Preferred terms used more than once within a semantic tag",
            descriptions.duplicate_terms,
        ),
        CheckSpec(
            "descriptions-spaces",
            "Stray spaces in terms",
            descriptions.stray_spaces,
        ),
        CheckSpec(
            "concept-duplicate",
            "Concepts that have one term",
            descriptions.concepts_with_term,
            nested=True,
            lookup=descriptions.concepts_of_term,
        ),
        CheckSpec(
            "active-langrefset-en-descriptions",
            "Active extension language-refset members on base-language descriptions",
            refsets.base_language_members,
        ),
        CheckSpec(
            "active-langrefset-inactive-descriptions",
            "Active language-refset members on inactive descriptions",
            refsets.members_on_inactive_descriptions,
        ),
        CheckSpec(
            "active-langrefset-multiple-descriptions",
            "Active descriptions that a language refset holds more than once",
            refsets.repeated_members,
        ),
        CheckSpec(
            "multi-desc-lang-refset",
            "Members of one language refset that share a description",
            refsets.members_of_repeated_components,
            nested=True,
            param_type=int,
        ),
        CheckSpec(
            "missing-refset-descriptors",
            "Refsets without a refset descriptor",
            refsets.refsets_without_descriptor,
        ),
        CheckSpec(
            "non-concept-refset-ids",
            "Refset ids that are not active concepts",
            refsets.refsets_not_concepts,
        ),
        CheckSpec(
            "se-module-with-non-se-ids",
            "Extension rows whose identifiers are not the extension's",
            concepts.identifiers_outside_namespace,
        ),
    ]
)

#: Release statistics that are not part of the catalogue.
STATISTICS = Catalogue(
    [
        CheckSpec(
            "inactivated-concepts",
            "Number of inactivated concepts",
            concepts.inactivated_concepts,
        ),
        CheckSpec(
            "inactivated-descriptions",
            "Number of inactivated descriptions",
            descriptions.inactivated_descriptions,
        ),
        CheckSpec(
            "new-concepts-by-status",
            "New concepts by definition status",
            concepts.new_concepts_by_status,
        ),
        CheckSpec(
            "new-concepts-by-term",
            "New concepts by term of their hierarchy",
            concepts.new_concepts_by_term,
        ),
        CheckSpec(
            "new-synonyms",
            "Number of new synonyms, all versions of terms counted",
            descriptions.new_synonyms_over_history,
        ),
    ]
)
