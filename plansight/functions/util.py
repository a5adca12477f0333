"""Small Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Orders of a later class start here: no plan, file or object has so many entries of an earlier one.
LATER = 1 << 40


def at(container, key) -> Column:
    """Element of an array (1-based, negative from the end) or map value;
    NULL - not an error under ANSI mode - when the index or key is absent."""
    c = F.col(container) if isinstance(container, str) else container
    k = key if isinstance(key, Column) else F.lit(key)
    return F.try_element_at(c, k)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once: an expression used in many places stands once in the plan."""
    return at(F.transform(F.array(value), body), 1)
