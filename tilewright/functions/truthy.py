"""Fallback chains in which empty strings, zeros and empty arrays count as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMERIC = {"int", "integer", "bigint", "long", "double", "float", "smallint", "tinyint"}


def truthy(col: Column, kind: str) -> Column:
    """True when ``col`` would count as a value: not null and not empty or zero.

    ``kind`` is ``string``, a numeric type name, ``boolean``, ``array`` or ``struct``.
    """
    if kind == "string":
        test = col != ""
    elif kind in _NUMERIC:
        test = col != 0
    elif kind == "boolean":
        test = col
    elif kind == "array":
        test = F.size(col) > 0
    elif kind == "struct":
        test = F.lit(True)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return col.isNotNull() & F.coalesce(test, F.lit(False))


def truthy_coalesce(kind: str, *cols: Column) -> Column:
    """First truthy column; when none is, the last column as it stands."""
    picks = [F.when(truthy(c, kind), c) for c in cols[:-1]]
    return F.coalesce(*picks, cols[-1])
