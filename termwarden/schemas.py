"""Explicit schemas of the release tables. Nothing is inferred.

`active` stays an integer flag, as in the files: ANSI mode refuses `BOOLEAN = 1`.
"""

from __future__ import annotations

from pyspark.sql.types import (
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
)


def _table(id_type, *columns) -> StructType:
    header = [
        ("id", id_type),
        ("effectiveTime", IntegerType()),
        ("active", IntegerType()),
        ("moduleId", LongType()),
    ]
    return StructType([StructField(name, kind) for name, kind in (*header, *columns)])


_MEMBER = (("refsetId", LongType()), ("referencedComponentId", LongType()))

CONCEPTS = _table(LongType(), ("definitionStatusId", LongType()))
DESCRIPTIONS = _table(
    LongType(),
    ("conceptId", LongType()),
    ("languageCode", StringType()),
    ("typeId", LongType()),
    ("term", StringType()),
    ("caseSignificanceId", LongType()),
)
RELATIONSHIPS = _table(
    LongType(),
    ("sourceId", LongType()),
    ("destinationId", LongType()),
    ("relationshipGroup", ShortType()),
    ("typeId", LongType()),
    ("characteristicTypeId", LongType()),
    ("modifierId", LongType()),
)
LANGUAGE_REFSETS = _table(StringType(), *_MEMBER, ("acceptabilityId", LongType()))
SIMPLE_REFSETS = _table(StringType(), *_MEMBER)
REFSET_DESCRIPTORS = _table(
    StringType(),
    *_MEMBER,
    ("attributeDescription", LongType()),
    ("attributeType", LongType()),
    ("attributeOrder", IntegerType()),
)
OWL_REFSETS = _table(StringType(), *_MEMBER, ("owlExpression", StringType()))

#: Component tables of a release, as loaded (all versions).
FULL_TABLES: dict[str, StructType] = {
    "concepts": CONCEPTS,
    "descriptions": DESCRIPTIONS,
    "relationships": RELATIONSHIPS,
    "languagerefsets": LANGUAGE_REFSETS,
    "simplerefsets": SIMPLE_REFSETS,
    "refsetdescriptors": REFSET_DESCRIPTORS,
    "owlrefsets": OWL_REFSETS,
}

#: Tables of a snapshot package (one row per component).
SNAPSHOT_PACKAGE_TABLES: dict[str, StructType] = {
    "concepts": CONCEPTS,
    "descriptions": DESCRIPTIONS,
    "relationships": RELATIONSHIPS,
    "stated": RELATIONSHIPS,
    "languagerefsets": LANGUAGE_REFSETS,
}
