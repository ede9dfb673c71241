"""Items as numbers: entities and predicates as longs, which sort, join and count faster than strings and take less room."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number has so many digits at most.
DIGITS = 17


def of_entity(n: Column) -> Column:
    """The code of entity Q<n>: not negative, and in the order of the names as strings; null for a null or negative n."""
    n = n.cast("long")
    text = n.cast("string")
    other = F.when(F.length(text) > DIGITS, F.raise_error(F.lit("an entity's number has too many digits"))).otherwise(F.rpad(text, DIGITS, "0").cast("long") * 20 + F.length(text))
    return F.when((n >= 10**9) & (n < 10**10), n * 200_000_000 + 10).when(n >= 0, other)


def of_predicate(n: int) -> int:
    return -n - 1


def of_item(item: Column) -> Column:
    """The code of an item's name; null for literals, and for names that no code stands for (leading zeros, too many digits)."""
    digits = F.substring(item, 2, DIGITS)
    number = f"(0|[1-9][0-9]{{0,{DIGITS - 1}}})$"
    entity = F.rpad(digits, DIGITS, "0").cast("long") * 20 + F.length(digits)
    return F.when(item.rlike(f"^Q{number}"), entity).when(item.rlike(f"^P{number}"), -digits.cast("long") - 1)


def to_item(code: Column) -> Column:
    """The name that a code stands for."""
    div = lambda n: F.call_function("div", code, F.lit(n)).cast("string")
    other = F.concat(F.lit("Q"), F.substring(F.lpad(div(20), DIGITS, "0"), F.lit(1), (code % 20).cast("int")))
    return F.when(code < 0, F.concat(F.lit("P"), (-code - 1).cast("string"))).when(code % 20 == 10, F.concat(F.lit("Q"), div(200_000_000))).otherwise(other)
