"""What loading the packages written from the raw rows gives."""

from __future__ import annotations

from oracle.tables import BASE_RELEASE, COLUMNS, CORE, FSN, IS_A, ORDER, PLACE, _first

_COMPONENT = f"referencedComponentId // {PLACE}"
_LANGUAGE = f"CASE WHEN {_COMPONENT} % 10 % 2 = 1 THEN 'en' ELSE 'sv' END"

_FILE = {
    "concepts": f"CASE WHEN moduleId = {CORE} THEN 0 ELSE 1 END",
    "relationships": f"CASE WHEN moduleId = {CORE} THEN 0 ELSE 1 END",
    "descriptions": f"CASE WHEN languageCode = 'sv' THEN 2 WHEN moduleId = {CORE} THEN 0 ELSE 1 END",
    "languagerefsets": f"CASE WHEN {_LANGUAGE} = 'sv' THEN 2 WHEN moduleId = {CORE} THEN 0 ELSE 1 END",
    "simplerefsets": f"""CASE WHEN refsetId // {PLACE} % 2 = 0 THEN 0
                              WHEN refsetId // {PLACE} < 6 THEN 1 ELSE 2 END""",
    "refsetdescriptors": f"CASE WHEN {_COMPONENT} % 2 = 0 THEN 0 ELSE 1 END",
    "owlrefsets": f"CASE WHEN {_COMPONENT} % 3 = 0 THEN 0 ELSE 1 END",
}


def _full(table: str) -> str:
    source = f"{table}_raw" if table in ORDER else table
    order = f"{_FILE[table]}, {ORDER[table]}" if table in ORDER else _FILE[table]
    return _first(source, COLUMNS[table], order)


def _snapshot(table: str) -> str:
    """Base package (core rows up to the base release), then the extension's."""
    source = "relationships" if table == "stated" else table
    base = f"moduleId = {CORE} AND effectiveTime <= {BASE_RELEASE}"
    if table == "descriptions":
        in_base_file = "languageCode = 'en'"
    elif table == "languagerefsets":
        in_base_file = f"{_LANGUAGE} = 'en'"
    else:
        in_base_file = "true"
    latest = "row_number() OVER (PARTITION BY id ORDER BY effectiveTime DESC) = 1"
    both = f"""
        SELECT *, 0 AS package FROM
            (SELECT {COLUMNS[source]} FROM {source} WHERE {base} QUALIFY {latest})
        WHERE {in_base_file}
        UNION ALL
        SELECT *, 1 FROM
            (SELECT {COLUMNS[source]} FROM {source} QUALIFY {latest})"""
    if table == "languagerefsets":
        return f"SELECT {COLUMNS[source]} FROM ({both})"
    return _first(f"({both})", COLUMNS[source], "package", "id")


_SNAPSHOT_TABLES = ("concepts", "descriptions", "relationships", "stated", "languagerefsets")

PACKAGE_TABLES = {f"package_{table}": _snapshot(table) for table in _SNAPSHOT_TABLES} | {
    "package_edges": f"""
        SELECT DISTINCT sourceId AS sub, destinationId AS super
        FROM package_relationships WHERE typeId = {IS_A} AND active = 1""",
    "package_pairs": """
        SELECT sub, super FROM package_edges
        UNION
        SELECT package_pairs.sub, package_edges.super
        FROM package_pairs JOIN package_edges ON package_pairs.super = package_edges.sub""",
    "package_closure": """
        SELECT id AS sub, id AS super FROM package_concepts WHERE active = 1
        UNION SELECT sub, super FROM package_pairs""",
    "package_names": _first(
        f"(SELECT * FROM package_descriptions WHERE active = 1 AND typeId = {FSN})",
        "conceptId, term AS fsn",
        "languageCode <> 'en', effectiveTime DESC, id",
        "conceptId",
    ),
}

PACKAGES = (
    {f"load_full_{table}": _full(table) for table in COLUMNS}
    | {f"load_snapshot_{table}": f"FROM package_{table}" for table in _SNAPSHOT_TABLES}
    | {
        "package_concepts_named": """
            SELECT c.*, coalesce(fsn, '') AS fsn,
                   CASE WHEN active = 1
                        THEN rtrim(split_part(coalesce(fsn, ''), '(', -1), ')') END AS semtag,
                   (SELECT CAST(nullif(count(*), 0) AS INTEGER) FROM package_closure
                    WHERE super = c.id) AS descendants
            FROM package_concepts c LEFT JOIN package_names ON conceptId = c.id""",
        "release_packages": f"""
            SELECT CASE moduleId WHEN {CORE} THEN '19990731' ELSE 'SE1000052_20000531' END
                       AS package,
                   CASE moduleId WHEN {CORE} THEN 19990731 ELSE 20000531 END AS packageDate,
                   moduleId <> {CORE} AS beta,
                   count(*) AS ct
            FROM concepts_raw GROUP BY moduleId""",
    }
)
