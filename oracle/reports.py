"""Reports over several checks."""

from __future__ import annotations

from oracle.checks import NESTED
from harness.fixtures import RELEASE
from oracle.tables import RELEASE as RELEASE_DATE
from termwarden.plans.catalogue import CATALOGUE

_DRILLS = {
    "drill_inactive_concepts": ("inactive_concepts_in_refsets", "id", "concept_refset_inactive"),
    "drill_duplicate_terms": ("duplicate_descriptions", "term", "concept_duplicate"),
    "drill_repeated_members": (
        "active_langrefset_multiple_descriptions",
        "refsetId",
        "multi_desc_lang_refset",
    ),
}


def reports(checks: dict[str, str]) -> dict[str, str]:
    listed = {
        check.id: (check.description.replace("'", "''"), checks[check.id.replace("-", "_")])
        for check in CATALOGUE.listed()
    }
    envelopes = " UNION ALL ".join(
        f"SELECT '{name}' AS queryId, '{RELEASE}' AS release,"
        f" CAST(NULL AS VARCHAR) AS parameter, CAST(to_json(r) AS VARCHAR) AS result FROM ({sql}) r"
        for name, (_, sql) in listed.items()
    )
    counts = " UNION ALL ".join(
        f"SELECT '{name}' AS check_id, '{text}' AS description, count(*) AS rows FROM ({sql})"
        for name, (text, sql) in listed.items()
    )
    drills = {
        name: f"SELECT * FROM ({NESTED[child][0]})"
        f" WHERE param IN (SELECT {column} FROM ({checks[parent]}))"
        for name, (parent, column, child) in _DRILLS.items()
    }
    run_all = f"SELECT check_id, rows, rows AS stored FROM ({counts})"
    sliced = {
        f"sliced_{name}": checks[name]
        for name in (
            "inactive_concepts_in_refsets",
            "concept_refset_inactive",
            "concept_duplicate",
            "active_langrefset_en_descriptions",
            "active_langrefset_multiple_descriptions",
            "multi_desc_lang_refset",
        )
    }
    stored = {
        name: "SELECT true AS complete, count(*) AS concepts FROM concepts"
        for name in ("listed_releases_files", "listed_releases_catalog")
    }
    rebuilt = {
        f"read_while_rebuilt_{kind}": """
            SELECT 'before' AS reader, count(*) AS concepts FROM (
                FROM concepts SELECT id, active WHERE effectiveTime <= 20001130
                QUALIFY row_number() OVER (PARTITION BY id ORDER BY effectiveTime DESC) = 1)
            WHERE active = 1
            UNION ALL
            SELECT 'after', count(*) FROM concepts_snap WHERE active = 1"""
        for kind in ("files", "catalog")
    }
    own = {
        "sql_check_published": f"""
            SELECT moduleId, count(*) AS ct FROM concepts
            WHERE effectiveTime = {RELEASE_DATE} GROUP BY moduleId""",
        "sql_check_terms_of": f"""
            SELECT id, term FROM descriptions
            WHERE conceptId = 20001000052105 AND effectiveTime < {RELEASE_DATE}""",
    }
    all_of_them = {"all_envelopes": envelopes, "check_counts": counts, "run_all_checks": run_all}
    return all_of_them | drills | sliced | stored | rebuilt | own
