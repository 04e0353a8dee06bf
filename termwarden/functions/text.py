"""Text of terms and identifiers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a term may consist of.
ALLOWED_CHARACTERS = (
    "0123456789"
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    "abcdefghijklmnopqrstuvwxyz"
    "ÅÄÖåäöÜüÉé"
    " ()*+,-.=;:%/<>^µ'{}[]"
)

# Blank at either end, or two blanks in a row.
STRAY_SPACES = r"^\s|\s$|\s{2,}"


def semantic_tag(fsn: Column) -> Column:
    """Text after the last `(` without closing parentheses; all of it without one."""
    return F.rtrim(F.substring_index(fsn, "(", -1), F.lit(")"))


def has_irregular_characters(term: Column) -> Column:
    """True where some character lies outside the allowed ones.

    Removing the allowed ones is several times as fast as searching with a bracket
    expression that has this many parts.
    """
    return F.translate(term, ALLOWED_CHARACTERS, "") != ""


def has_stray_spaces(term: Column) -> Column:
    """True for leading, trailing or repeated whitespace."""
    return term.rlike(STRAY_SPACES)


def in_namespace(component_id: Column, namespaces: Iterable[str]) -> Column:
    """True where the digits of an identifier contain one of the namespaces."""
    digits = component_id.cast("string")
    return reduce(Column.__or__, [digits.contains(ns) for ns in namespaces])
