"""Release tables over the driver's tables, and the derived ones."""

from __future__ import annotations

SE = 45991000052106
CORE = 900000000000207008
PREFERRED = 900000000000548007
FSN = 900000000000003001
IS_A = 116680003
ROOT = 1000052105
RELEASE = 20000531
BASE_RELEASE = 19990731
PLACE = 10_000_000_000


def _release_of(date: str) -> str:
    return (
        f"CAST(year({date}) * 10000 + CASE WHEN month({date}) <= 5 THEN 531 ELSE 1130 END"
        " AS INTEGER)"
    )


def _concept_id(k: str) -> str:
    return f"({k}) * {PLACE} + CASE WHEN ({k}) % 4 < 3 THEN 1000052105 ELSE 5 END"


_DESCRIPTION_ID = (
    f"(l_orderkey * 10 + l_linenumber) * {PLACE}"
    " + CASE WHEN l_orderkey % 17 = 0 THEN 13 ELSE 1000052113 END"
)
_LINE_MODULE = f"CASE WHEN l_suppkey % 4 = 0 THEN {CORE} ELSE {SE} END"

RAW = {
    "concepts_raw": f"""
        SELECT {_concept_id('o_orderkey // 2')} AS id,
               {_release_of('o_orderdate')} AS effectiveTime,
               CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS active,
               CASE WHEN o_custkey % 3 = 0 THEN {CORE} ELSE {SE} END AS moduleId,
               CASE WHEN o_totalprice > 250000 THEN 900000000000073002
                    ELSE 900000000000074008 END AS definitionStatusId,
               o_orderkey
        FROM orders WHERE o_orderkey % 2 = 0 OR o_custkey % 2 = 0""",
    "descriptions_raw": f"""
        SELECT {_DESCRIPTION_ID} AS id,
               {_release_of('l_shipdate')} AS effectiveTime,
               CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS active,
               {_LINE_MODULE} AS moduleId,
               {_concept_id('l_orderkey // 2')} AS conceptId,
               CASE WHEN l_linenumber % 2 = 1 THEN 'en' ELSE 'sv' END AS languageCode,
               CASE WHEN l_linenumber = 1 THEN {FSN} ELSE 900000000000013009 END AS typeId,
               p_name || CASE WHEN l_suppkey % 11 = 0 THEN '  '
                              WHEN l_suppkey % 13 = 0 THEN '! '
                              ELSE ' ' END
                      || '(' || lower(p_type) || ')' AS term,
               900000000000448009 AS caseSignificanceId,
               l_partkey, l_suppkey
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "languagerefsets_raw": f"""
        SELECT 'lr-' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey % 6
                     || '-' || l_partkey % 2 AS id,
               {_release_of('l_shipdate')} AS effectiveTime,
               CASE WHEN l_discount > 0.02 THEN 1 ELSE 0 END AS active,
               {_LINE_MODULE} AS moduleId,
               {_concept_id('l_suppkey % 6')} AS refsetId,
               {_DESCRIPTION_ID} AS referencedComponentId,
               CASE WHEN l_quantity >= 25 THEN {PREFERRED}
                    ELSE 900000000000549004 END AS acceptabilityId,
               l_partkey, l_suppkey, l_extendedprice
        FROM lineitem WHERE l_suppkey % 5 <> 0""",
    "simplerefsets_raw": f"""
        SELECT 'sr-' || o_orderkey // 2 AS id,
               {_release_of('o_orderdate')} AS effectiveTime,
               CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END AS active,
               {SE} AS moduleId,
               {_concept_id('CASE WHEN o_custkey % 12 = 11 THEN 90000000 ELSE o_custkey % 12 END')}
                   AS refsetId,
               CASE WHEN o_custkey % 12 = 5 THEN (o_orderkey * 10 + 1) * {PLACE} + 1000052113
                    ELSE {_concept_id('o_orderkey // 2')} END AS referencedComponentId,
               o_orderkey
        FROM orders""",
}


def _first(source: str, columns: str, order: str, key: str = "id, effectiveTime") -> str:
    return (
        f"SELECT {columns} FROM {source}"
        f" QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"
    )


HEADER = "id, effectiveTime, active, moduleId"
COLUMNS = {
    "concepts": f"{HEADER}, definitionStatusId",
    "descriptions": f"{HEADER}, conceptId, languageCode, typeId, term, caseSignificanceId",
    "relationships": (
        f"{HEADER}, sourceId, destinationId, relationshipGroup, typeId,"
        " characteristicTypeId, modifierId"
    ),
    "languagerefsets": f"{HEADER}, refsetId, referencedComponentId, acceptabilityId",
    "simplerefsets": f"{HEADER}, refsetId, referencedComponentId",
    "refsetdescriptors": (
        f"{HEADER}, refsetId, referencedComponentId, attributeDescription,"
        " attributeType, attributeOrder"
    ),
    "owlrefsets": f"{HEADER}, refsetId, referencedComponentId, owlExpression",
}
ORDER = {
    "concepts": "o_orderkey",
    "descriptions": "l_partkey, l_suppkey, term",
    "languagerefsets": "l_partkey, l_suppkey, l_extendedprice",
    "simplerefsets": "o_orderkey",
}

FULL = {
    table: _first(f"{table}_raw", COLUMNS[table], ORDER[table]) for table in ORDER
} | {
    "relationships": f"""
        SELECT (k * 10 + j) * {PLACE} + CASE WHEN k % 4 < 3 THEN 1000052126 ELSE 26 END AS id,
               effectiveTime, active, moduleId, sourceId,
               {_concept_id('CASE j WHEN 0 THEN (k - 1) // 8 ELSE (k - 1) // 5 END')}
                   AS destinationId,
               CAST(0 AS SMALLINT) AS relationshipGroup,
               CAST({IS_A} AS BIGINT) AS typeId,
               900000000000011006 AS characteristicTypeId,
               900000000000451002 AS modifierId
        FROM (SELECT *, id AS sourceId, id // {PLACE} AS k FROM concepts),
             (VALUES (0), (1)) AS branch(j)
        WHERE k > 0 AND (j = 0 OR k % 3 = 0)""",
    "refsetdescriptors": f"""
        SELECT 'rd-' || n_nationkey AS id, 20000531 AS effectiveTime, 1 AS active,
               {SE} AS moduleId, 900000000000456007 AS refsetId,
               {_concept_id('CAST(n_nationkey AS BIGINT)')} AS referencedComponentId,
               CAST(449608002 AS BIGINT) AS attributeDescription,
               900000000000461009 AS attributeType, 0 AS attributeOrder
        FROM nation WHERE n_nationkey % 3 <> 1""",
    "owlrefsets": f"""
        SELECT 'ow-' || o_orderkey AS id, {_release_of('o_orderdate')} AS effectiveTime,
               CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS active,
               {SE} AS moduleId, CAST(733073007 AS BIGINT) AS refsetId,
               {_concept_id('o_orderkey // 2')} AS referencedComponentId,
               'SubClassOf(:' || o_custkey || ')' AS owlExpression
        FROM orders""",
}

SNAPSHOTS = {
    f"{table}_snap": _first(table, "*", "effectiveTime DESC", "id")
    for table in COLUMNS
    if table != "owlrefsets"
}

_TAG = "rtrim(split_part(fsn, '(', -1), ')')"
_NAME_ORDER = "languageCode <> 'en', effectiveTime DESC, id"

TABLES = (
    RAW
    | FULL
    | SNAPSHOTS
    | {
        "names": _first(
            f"(SELECT * FROM descriptions_snap WHERE active = 1 AND typeId = {FSN})",
            "conceptId, term AS fsn",
            _NAME_ORDER,
            "conceptId",
        ),
        "concepts_snap2": f"""
            SELECT c.*, fsn, {_TAG} AS semtag
            FROM concepts_snap c JOIN names ON conceptId = id""",
        "edges": f"""
            SELECT DISTINCT sourceId AS sub, destinationId AS super
            FROM relationships_snap WHERE typeId = {IS_A} AND active = 1""",
        "walks": """
            SELECT sub, super, 1 AS steps FROM edges
            UNION
            SELECT walks.sub, edges.super, steps + 1
            FROM walks JOIN edges ON walks.super = edges.sub""",
        "transitiveclosure": """
            SELECT subtypeId, supertypeId, CAST(min(n) AS INTEGER) AS pathLength
            FROM (SELECT id AS subtypeId, id AS supertypeId, 0 AS n
                  FROM concepts_snap WHERE active = 1
                  UNION ALL SELECT sub, super, steps FROM walks)
            GROUP BY ALL""",
        "tops": f"""
            SELECT CAST({ROOT} AS BIGINT) AS conceptId, CAST(1 AS INTEGER) AS displayOrder
            UNION ALL
            SELECT sub, CAST(1 + row_number() OVER (ORDER BY sub) AS INTEGER)
            FROM edges WHERE super = {ROOT}""",
        "hierarchies": f"""
            SELECT conceptId,
                   (SELECT arg_min(d.term, d.id) FROM descriptions_snap d
                    WHERE d.conceptId = tops.conceptId AND d.active = 1
                      AND d.languageCode = 'en' AND d.typeId = {FSN}) AS fsn,
                   (SELECT arg_min(d.term, d.id) FROM descriptions_snap d
                    WHERE d.conceptId = tops.conceptId AND d.active = 1
                      AND d.languageCode = 'sv'
                      AND EXISTS (FROM languagerefsets_snap l
                                  WHERE l.referencedComponentId = d.id AND l.active = 1
                                    AND l.acceptabilityId = {PREFERRED})) AS term,
                   displayOrder
            FROM tops""",
    }
)

_DESCENDANTS = """
    SELECT supertypeId AS id, CAST(count(subtypeId) AS INTEGER) AS descendants
    FROM transitiveclosure GROUP BY ALL"""

DERIVED = (
    {f"snapshot_{table}": f"SELECT * FROM {table}_snap" for table in COLUMNS if table != "owlrefsets"}
    | {f"extended_snapshot_{table}": f"SELECT * FROM {table}_snap" for table in COLUMNS if table != "owlrefsets"}
    | {
        "extended_closure": "SELECT * FROM transitiveclosure",
        "extended_named_concepts": "SELECT * FROM concepts_snap2",
        "extended_language_terms": """
            SELECT conceptId, count(*) AS terms FROM descriptions
            WHERE active = 1 AND languageCode = 'sv' GROUP BY conceptId""",
        "extended_rows_reopened": """
            SELECT effectiveTime, count(*) AS rows FROM descriptions GROUP BY effectiveTime""",
        "keyed_descriptions": "SELECT * FROM descriptions",
        "named_concepts": "SELECT * FROM concepts_snap2",
        "ambiguous_names": f"""
            SELECT conceptId, count(*) AS names FROM descriptions_snap
            WHERE active = 1 AND typeId = {FSN} GROUP BY ALL HAVING count(*) > 1""",
        "semantic_tags": """
            SELECT semtag, count(*) AS ct FROM concepts_snap2 GROUP BY ALL""",
        "closure_selves": """
            SELECT id AS subtypeId, id AS supertypeId, CAST(0 AS INTEGER) AS pathLength
            FROM concepts_snap WHERE active = 1""",
        "closure_edges": "SELECT sub AS subtypeId, super AS supertypeId FROM edges",
        "transitive_closure": "SELECT * FROM transitiveclosure",
        "descendant_counts": _DESCENDANTS,
        "top_concepts": "SELECT * FROM tops",
        "hierarchies": "SELECT * FROM hierarchies",
        "version_counts": f"""
            SELECT c.id, versions, active, definitionStatusId
            FROM concepts c
            JOIN (SELECT id, count(*) AS versions FROM concepts GROUP BY id) counted
              ON c.id = counted.id
            WHERE effectiveTime = {RELEASE} AND moduleId = {SE}""",
        "refsets_in_use": """
            SELECT 'language' AS kind, refsetId, count(*) AS members,
                   count(*) FILTER (active = 1) AS activeMembers
            FROM languagerefsets_snap GROUP BY ALL
            UNION ALL
            SELECT 'simple', refsetId, count(*), count(*) FILTER (active = 1)
            FROM simplerefsets_snap GROUP BY ALL""",
        "release_dates": """
            SELECT name AS release, date AS releaseDate,
                   CAST(CASE WHEN date % 10000 = 531 THEN (date // 10000 - 1) * 10000 + 731
                             ELSE date // 10000 * 10000 + 131 END AS INTEGER) AS baseReleaseDate
            FROM (SELECT DISTINCT 'snomed_full_SE1000052_' || effectiveTime AS name,
                         effectiveTime AS date FROM concepts)""",
        "matching_releases": """
            SELECT release FROM (
                SELECT DISTINCT CASE effectiveTime // 10000 % 4
                           WHEN 0 THEN 'snomed_full_' WHEN 1 THEN 'xsnomed_full_SE1000052_'
                           WHEN 2 THEN 'x_beta_snomed_ext_full_' ELSE 'snomed_' END
                       || effectiveTime AS release
                FROM concepts)
            WHERE release NOT LIKE 'snomed\\_1%' ESCAPE '\\'
              AND release NOT LIKE 'snomed\\_2%' ESCAPE '\\'""",
    }
)
