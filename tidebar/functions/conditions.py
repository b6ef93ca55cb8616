"""Conditions given as a mapping, compiled to one column.

"field": text or number equals; "field": true or false is a flag; "field_in": one of a list; "field_between": two bounds, both
included. All must hold; a missing value never does (a missing text counts as UNKNOWN).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(field: str) -> Column:
    return F.coalesce(F.col(field).cast("string"), F.lit("UNKNOWN"))


def one(key: str, expected) -> Column:
    if key.endswith("_in"):
        return _text(key.removesuffix("_in")).isin(*(str(x) for x in expected))
    if key.endswith("_between"):
        low, high = expected
        return F.coalesce(F.col(key.removesuffix("_between")).cast("double").between(float(low), float(high)), F.lit(False))
    if isinstance(expected, bool):
        return F.coalesce(F.col(key).cast("boolean"), F.lit(False)) == expected
    return _text(key) == str(expected)


def compiled(conditions: Mapping[str, object]) -> Column:
    out = F.lit(True)
    for key, expected in conditions.items():
        out &= one(key, expected)
    return out


def failed(conditions: Mapping[str, object]) -> Column:
    """The keys of the conditions that don't hold, in their order."""
    return F.filter(F.array(*(F.when(~one(k, x), F.lit(k)) for k, x in conditions.items())), lambda k: k.isNotNull())
