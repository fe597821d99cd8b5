"""Predicates on tags with two-valued logic.

A point either has a tag (and a value) or hasn't. Equality, order and patterns are false for a missing tag; inequality is true. No
predicate is ever null, so `not` is the exact complement.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class Predicate:
    """A condition; combine with &, | and ~."""

    def __init__(self, column: Column):
        self.column = column

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate(self.column & other.column)

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate(self.column | other.column)

    def __invert__(self) -> Predicate:
        return Predicate(~self.column)


class Tag:
    """A tag by name; its comparisons make predicates."""

    def __init__(self, name: str):
        self.value = F.col(name)

    def _holds(self, condition: Column, missing: bool = False) -> Predicate:
        return Predicate(F.coalesce(condition, F.lit(missing)))

    def __eq__(self, other: object) -> Predicate:  # type: ignore[override]
        return self._holds(self.value == other)

    def __ne__(self, other: object) -> Predicate:  # type: ignore[override]
        return self._holds(self.value != other, missing=True)

    __hash__ = None  # type: ignore[assignment]

    def __lt__(self, other: object) -> Predicate:
        return self._holds(self.value < other)

    def __le__(self, other: object) -> Predicate:
        return self._holds(self.value <= other)

    def __gt__(self, other: object) -> Predicate:
        return self._holds(self.value > other)

    def __ge__(self, other: object) -> Predicate:
        return self._holds(self.value >= other)

    def matches(self, pattern: str) -> Predicate:
        """A regular expression found anywhere in the value."""
        return self._holds(self.value.cast("string").rlike(pattern))


def tag(name: str) -> Tag:
    return Tag(name)


def everything() -> Predicate:
    return Predicate(F.lit(True))


def all_equal(tags: dict[str, object]) -> Predicate:
    """Every given tag has the given value."""
    return reduce(lambda a, b: a & b, (tag(k) == v for k, v in tags.items()), everything())


def exact_set(tags: dict[str, object], names: tuple[str, ...]) -> Predicate:
    """The given tags have the given values, and a point has no other tag of `names`."""
    others = (Predicate(F.col(n).isNull()) for n in names if n not in tags)
    return reduce(lambda a, b: a & b, others, all_equal(tags))
