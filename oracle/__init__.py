"""SQL twins of the registered queries, for DuckDB over the driver's tables.

They are written apart from the DataFrame versions and in another style (QUALIFY,
EXISTS, a recursive query), so that agreement means something.
"""

from __future__ import annotations

import re

from oracle.checks import CHECKS
from oracle.packages import PACKAGE_TABLES, PACKAGES
from oracle.reports import reports
from oracle.tables import DERIVED, TABLES

_CTES = TABLES | PACKAGE_TABLES


def with_tables(query: str) -> str:
    """`query` behind the definitions of the tables it uses, directly or not."""
    seen: set[str] = set()
    needed: list[str] = []

    def add(sql: str) -> None:
        for name in _CTES:
            if name not in seen and re.search(rf"\b{name}\b", sql):
                seen.add(name)
                add(_CTES[name])
                needed.append(name)

    add(query)
    if not needed:
        return query
    tables = ",\n".join(f"{name} AS ({_CTES[name]})" for name in needed)
    return f"WITH RECURSIVE {tables}\n{query}"


def oracle_queries() -> dict[str, str]:
    plain = DERIVED | CHECKS | PACKAGES
    return {name: with_tables(sql) for name, sql in (plain | reports(CHECKS)).items()}
