"""Spelling of names and numbers in Spark SQL text."""

from __future__ import annotations

import math

Sql = str


def ident(name: str) -> Sql:
    """A column by its exact name, dots and blanks included."""
    return "`" + name.replace("`", "``") + "`"


def string(value: str) -> Sql:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double(value: float) -> Sql:
    """A double literal with every digit."""
    value = float(value)
    if math.isfinite(value):
        # in brackets if negative: two minus signs in a row start a comment
        return f"{value!r}D" if math.copysign(1.0, value) > 0 else f"({value!r}D)"
    return f"double('{value}')"


def sql(value: float | Sql) -> Sql:
    """A number as a literal; text is taken as an expression."""
    return value if isinstance(value, str) else double(value)
