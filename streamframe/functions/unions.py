"""Union types as struct columns.

A one-of value is ``struct<type_index, t0, t1, ...>`` with one case set; an any-of value
carries the set of its indices; an all-of value must satisfy every member type.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cases(types: Sequence[str], values: Mapping[int, Column]) -> list[Column]:
    return [(values[i].cast(t) if i in values else F.lit(None).cast(t)).alias(f"t{i}") for i, t in enumerate(types)]


def one_of(types: Sequence[str], index: int, value: Column) -> Column:
    """The value as the case ``index`` of ``types``."""
    if not 2 <= len(types) <= 4:
        raise ValueError("a one-of has two to four types")
    return F.struct(F.lit(index).alias("type_index"), *_cases(types, {index: value}))


def one_of_when(types: Sequence[str], cases: Sequence[tuple[Column, Column]]) -> Column:
    """The first case whose condition holds, null if none does."""
    out = None
    for i, (condition, value) in enumerate(cases):
        item = one_of(types, i, value)
        out = F.when(condition, item) if out is None else out.when(condition, item)
    return out


def is_type(union: Column, index: int) -> Column:
    return F.coalesce(union["type_index"] == index, F.lit(False))


def as_type(union: Column, index: int) -> Column:
    """The case's value; another case is an error."""
    return F.when(is_type(union, index), union[f"t{index}"]).otherwise(F.raise_error(F.concat(F.lit(f"the value is not of case {index} but "), F.coalesce(union["type_index"].cast("string"), F.lit("null")))))


def try_get(union: Column, index: int) -> Column:
    """The case's value, null for another case."""
    return F.when(is_type(union, index), union[f"t{index}"])


def match(union: Column, *handlers: Callable[[Column], Column]) -> Column:
    """One handler for each case, in order."""
    out = None
    for i, h in enumerate(handlers):
        out = F.when(union["type_index"] == i, h(union[f"t{i}"])) if out is None else out.when(union["type_index"] == i, h(union[f"t{i}"]))
    return out


def any_of(types: Sequence[str], values: Mapping[int, Column]) -> Column:
    """A value that is of several types at once; cases whose value is null are not set."""
    if not 2 <= len(types) <= 4:
        raise ValueError("an any-of has two to four types")
    cases = _cases(types, values)
    held = F.filter(F.array(*[F.when(values[i].isNotNull(), F.lit(i)) for i in sorted(values)]), lambda i: i.isNotNull())
    return F.struct(held.alias("type_indices"), *cases)


def has_type(union: Column, index: int) -> Column:
    return F.coalesce(F.array_contains(union["type_indices"], index), F.lit(False))


def match_first(union: Column, *handlers: Callable[[Column], Column]) -> Column:
    """The handler of the first set case, in declared order."""
    out = None
    for i, h in enumerate(handlers):
        item = h(union[f"t{i}"])
        out = F.when(has_type(union, i), item) if out is None else out.when(has_type(union, i), item)
    return out


def matching_types(union: Column, names: Sequence[str]) -> Column:
    """The names of the set cases, in declared order."""
    return F.transform(F.array_sort(union["type_indices"]), lambda i: F.element_at(F.array(*map(F.lit, names)), i + 1))


def all_of(value: Column, members: Sequence[Sequence[str]]) -> Column:
    """The struct itself, if every field of every member type is set; else an error."""
    if not 1 <= len(members) <= 3:
        raise ValueError("an all-of has one to three types")
    return F.when(satisfies(value, members), value).otherwise(F.raise_error(F.lit("the value does not satisfy all types")))


def satisfies(value: Column, members: Sequence[Sequence[str]]) -> Column:
    out = value.isNotNull()
    for fields in members:
        for f in fields:
            out = out & value[f].isNotNull()
    return out
