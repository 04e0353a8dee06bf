"""The checks of the catalogue and the release statistics."""

from __future__ import annotations

from oracle.tables import BASE_RELEASE, CORE, PREFERRED, RELEASE, SE

_PUBLISHED = f"c.effectiveTime = {RELEASE} AND c.moduleId = {SE}"
_VERSIONS = "(SELECT count(*) FROM concepts v WHERE v.id = c.id)"
_FOREIGN = "(NOT contains(CAST({0} AS VARCHAR), '1000052') AND NOT contains(CAST({0} AS VARCHAR), '1000057'))"


def _new_per_hierarchy(label: str) -> str:
    return f"""
        SELECT h.{label} AS {label}, count(*) AS ct
        FROM hierarchies h, transitiveclosure t, concepts c
        WHERE h.conceptId = t.supertypeId AND t.subtypeId = c.id
          AND {_PUBLISHED} AND c.active = 1 AND {_VERSIONS} = 1
        GROUP BY h.conceptId, h.{label}"""


_INACTIVATED_CONCEPTS = f"""
    SELECT count(*) AS ct FROM concepts c
    WHERE {_PUBLISHED} AND c.active = 0 AND {_VERSIONS} > 1"""

_INACTIVATED_DESCRIPTIONS = f"""
    SELECT count(*) AS ct FROM descriptions
    WHERE effectiveTime = {RELEASE} AND moduleId = {SE} AND languageCode = 'sv' AND active = 0"""


def _synonyms(source: str) -> str:
    return f"""
        SELECT count(*) AS ct FROM descriptions d
        WHERE d.effectiveTime = {RELEASE} AND d.active = 1
          AND (SELECT count(*) FROM {source} s
               WHERE s.conceptId = d.conceptId AND s.active = 1 AND s.languageCode = 'sv') > 1"""


_TRANSLATIONS = f"""
    SELECT count(*) AS ct FROM descriptions d
    WHERE d.effectiveTime = {RELEASE} AND d.moduleId = {SE}
      AND d.languageCode = 'sv' AND d.active = 1
      AND EXISTS (FROM concepts c WHERE c.id = d.conceptId AND c.moduleId <> {SE})
      AND NOT EXISTS (FROM descriptions e WHERE e.id = d.id AND e.moduleId = {SE}
                      AND e.effectiveTime < {RELEASE})"""

_MARKED_MEMBERS = f"""
    simplerefsets_snap m
    JOIN descriptions_snap d
      ON d.conceptId = m.refsetId AND d.active = 1 AND d.languageCode = 'sv'
    JOIN languagerefsets_snap l
      ON l.referencedComponentId = d.id AND l.acceptabilityId = {PREFERRED}"""

_CONCEPT_DESCRIPTIONS = f"""
    SELECT c.id AS param, c.id, d.term, c.fsn
    FROM concepts_snap2 c JOIN descriptions_snap d ON d.conceptId = c.id
    WHERE d.moduleId = {SE}"""

_TERM_CONCEPTS = f"""
    SELECT d.term AS param, c.id, d.term, c.fsn
    FROM concepts_snap2 c JOIN descriptions_snap d ON d.conceptId = c.id
    WHERE c.active = 1 AND d.active = 1 AND d.moduleId = {SE}"""


def _prefixed(columns: str, alias: str, prefix: str) -> str:
    return ", ".join(f"{alias}.{c} AS {prefix}{c}" for c in columns.split(", "))


_REPEATED_MEMBERS = f"""
    SELECT l.refsetId AS param,
           {_prefixed("id, effectiveTime, active, moduleId, refsetId, referencedComponentId, acceptabilityId", "l", "member_")},
           {_prefixed("id, effectiveTime, active, moduleId, conceptId, languageCode, typeId, term, caseSignificanceId", "d", "desc_")}
    FROM (SELECT *, count(*) OVER (PARTITION BY refsetId, referencedComponentId) AS held
          FROM languagerefsets_snap) l
    JOIN descriptions_snap d ON d.id = l.referencedComponentId
    WHERE held > 1 AND l.active = 1 AND d.active = 1"""

#: Nested checks as relations with the value they are asked for.
NESTED = {
    "concept_refset_inactive": (_CONCEPT_DESCRIPTIONS, "20001000052105"),
    "concept_duplicate": (_TERM_CONCEPTS, "'red widget (economy)'"),
    "multi_desc_lang_refset": (_REPEATED_MEMBERS, "1000052105"),
}


def _foreign_rows(kind: str, table: str, tested: str, term: str) -> str:
    return f"""
        SELECT '{kind}' AS typ, CAST(id AS VARCHAR) AS id, CAST({term} AS VARCHAR) AS term,
               effectiveTime
        FROM {table}
        WHERE moduleId = {SE} AND active = 1 AND {_FOREIGN.format(tested)}"""


CHECKS = {
    "new_concepts": _new_per_hierarchy("fsn"),
    "changed_concepts": f"""
        SELECT label, count(c.id) AS ct
        FROM (VALUES ('changed', 1), ('inactivated', 0)) AS wanted(label, flag)
        LEFT JOIN (FROM concepts c SELECT id, active WHERE {_PUBLISHED} AND {_VERSIONS} > 1) c
          ON c.active = flag
        GROUP BY label""",
    "reopened_changed_concepts": f"""
        SELECT label, count(c.id) AS ct
        FROM (VALUES ('changed', 1), ('inactivated', 0)) AS wanted(label, flag)
        LEFT JOIN (FROM concepts c SELECT id, active
                   WHERE c.effectiveTime = {RELEASE} AND c.moduleId = {CORE} AND {_VERSIONS} > 1) c
          ON c.active = flag
        GROUP BY label""",
    "promoted_concepts": f"""
        SELECT c.id, c.fsn FROM concepts_snap2 c
        WHERE contains(CAST(c.id AS VARCHAR), '1000052')
          AND c.moduleId = {CORE} AND c.effectiveTime > {BASE_RELEASE}
          AND NOT EXISTS (FROM concepts o WHERE o.id = c.id AND o.moduleId = {CORE}
                          AND o.effectiveTime <= {BASE_RELEASE})
          AND EXISTS (FROM concepts o WHERE o.id = c.id AND o.moduleId = {SE}
                      AND o.effectiveTime < {RELEASE})""",
    "descriptions": f"""
        SELECT 'new translations' AS label, ct FROM ({_TRANSLATIONS})
        UNION ALL SELECT 'new synonyms', ct FROM ({_synonyms("descriptions_snap")})
        UNION ALL SELECT 'inactivated descriptions', ct FROM ({_INACTIVATED_DESCRIPTIONS})""",
    # Fixed value: the characters that terms may hold.
    "funky_chars": rf"""
        SELECT id, conceptId, term, languageCode FROM descriptions_snap
        WHERE active = 1 AND moduleId = {SE}
          AND NOT regexp_full_match(term, '[\[\]0-9A-Za-zÅÄÖåäöÜüÉé (-.,=;:%/<>^µ''{{}}]*')""",
    "non_translated": """
        SELECT h.fsn, count(*) AS ct
        FROM hierarchies h, transitiveclosure t, concepts_snap c
        WHERE h.conceptId = t.supertypeId AND t.subtypeId = c.id AND c.active = 1
          AND NOT EXISTS (FROM descriptions_snap d WHERE d.conceptId = c.id
                          AND d.active = 1 AND d.languageCode = 'sv')
        GROUP BY h.conceptId, h.fsn""",
    "refsets_with_inactive": f"""
        SELECT m.refsetId, d.term, count(*) AS ct
        FROM {_MARKED_MEMBERS} JOIN concepts_snap c ON c.id = m.referencedComponentId
        WHERE m.active = 1 AND c.active = 0
        GROUP BY ALL""",
    "refsets_with_inactive2": f"""
        SELECT m.refsetId, d.term, count(c.id) AS ct
        FROM {_MARKED_MEMBERS}
        LEFT JOIN (FROM concepts_snap WHERE active = 0) c ON c.id = m.referencedComponentId
        WHERE m.active = 1
        GROUP BY ALL""",
    "inactive_concepts_in_refsets": f"""
        SELECT m.refsetId, d.term, c.id
        FROM {_MARKED_MEMBERS} JOIN concepts_snap c ON c.id = m.referencedComponentId
        WHERE m.active = 1 AND c.active = 0""",
    "duplicate_descriptions": f"""
        SELECT d.term, c.semtag, count(*) AS ct
        FROM descriptions_snap d, concepts_snap2 c, languagerefsets_snap l
        WHERE d.conceptId = c.id AND l.referencedComponentId = d.id
          AND d.languageCode = 'sv' AND d.active = 1 AND c.active = 1
          AND l.refsetId = 1000052105 AND l.active = 1 AND l.acceptabilityId = {PREFERRED}
        GROUP BY ALL HAVING count(*) > 1""",
    "descriptions_spaces": f"""
        SELECT id, term FROM descriptions_snap
        WHERE moduleId = {SE} AND active = 1
          AND (term <> trim(term) OR contains(term, '  '))""",
    "active_langrefset_en_descriptions": f"""
        SELECT d.term, l.referencedComponentId, l.refsetId
        FROM descriptions_snap d JOIN languagerefsets_snap l ON l.referencedComponentId = d.id
        WHERE d.active = 1 AND d.languageCode = 'en' AND d.moduleId = {SE}
          AND l.active = 1 AND l.refsetId NOT IN (11000052105, 21000052105)""",
    "active_langrefset_inactive_descriptions": """
        SELECT count(*) AS ct FROM languagerefsets_snap l
        WHERE l.active = 1
          AND EXISTS (FROM descriptions_snap d
                      WHERE d.id = l.referencedComponentId AND d.active = 0)""",
    "active_langrefset_multiple_descriptions": f"""
        SELECT l.refsetId, c.fsn, l.referencedComponentId, d.term
        FROM languagerefsets_snap l, concepts_snap2 c, descriptions_snap d
        WHERE l.refsetId = c.id AND l.referencedComponentId = d.id
          AND l.moduleId = {SE} AND l.active = 1 AND c.active = 1 AND d.active = 1
        GROUP BY ALL HAVING count(*) > 1""",
    "missing_refset_descriptors": """
        SELECT c.id, c.fsn FROM concepts_snap2 c
        WHERE (EXISTS (FROM languagerefsets_snap l WHERE l.refsetId = c.id)
               OR EXISTS (FROM simplerefsets_snap s WHERE s.refsetId = c.id))
          AND NOT EXISTS (FROM refsetdescriptors_snap r WHERE r.referencedComponentId = c.id)""",
    "non_concept_refset_ids": """
        SELECT refsetId FROM simplerefsets_snap WHERE active = 1
        EXCEPT SELECT id FROM concepts_snap WHERE active = 1""",
    "se_module_with_non_se_ids": " UNION ".join(
        [
            _foreign_rows("begrepp", "concepts_snap2", "id", "fsn"),
            _foreign_rows("beskrivning", "descriptions_snap", "id", "term"),
            _foreign_rows("relation", "relationships_snap", "id", "sourceId"),
            _foreign_rows(
                "lang-refset",
                "languagerefsets_snap",
                "referencedComponentId",
                "referencedComponentId",
            ),
            _foreign_rows(
                "axiom",
                "owlrefsets",
                "referencedComponentId",
                "referencedComponentId || ' : ' || owlExpression",
            ),
        ]
    ),
    "stat_inactivated_concepts": _INACTIVATED_CONCEPTS,
    "stat_inactivated_descriptions": _INACTIVATED_DESCRIPTIONS,
    "stat_new_concepts_by_status": f"""
        SELECT c.definitionStatusId, count(*) AS ct FROM concepts c
        WHERE {_PUBLISHED} AND c.active = 1 AND {_VERSIONS} = 1
        GROUP BY ALL""",
    "stat_new_concepts_by_term": _new_per_hierarchy("term"),
    "stat_new_synonyms": _synonyms("descriptions"),
    "term_index": f"""
        SELECT d.term AS key, d.id, d.conceptId, d.term, c.fsn
        FROM concepts_snap2 c JOIN descriptions_snap d ON d.conceptId = c.id
        WHERE c.active = 1 AND d.active = 1 AND d.moduleId = {SE}""",
    "collated_concept_duplicate": f"""
        SELECT * EXCLUDE (param) FROM ({_TERM_CONCEPTS})
        WHERE lower(param) = 'red widget (economy)'""",
    "collated_concepts_with_terms": f"""
        SELECT * FROM ({_TERM_CONCEPTS}) WHERE upper(param) IN (
            SELECT upper(d.term) FROM descriptions_snap d JOIN concepts_snap2 c ON c.id = d.conceptId
            WHERE c.id % 3 = 0)""",
} | {
    name: f"SELECT * EXCLUDE (param) FROM ({sql}) WHERE param = {value}"
    for name, (sql, value) in NESTED.items()
}
