"""Filters as boolean columns. A filter on what a row lacks is false, also where it is negated."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sure(condition: Column) -> Column:
    """Null as false."""
    return F.coalesce(condition, F.lit(False))


def both(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def either(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def negated(condition: Column) -> Column:
    return ~sure(condition)


def prop(name: str, column: str = "properties") -> Column:
    """A property of the map, null if it is missing."""
    return F.try_element_at(F.col(column), F.lit(name))


def compare(left: Column, op: str, right) -> Column:
    """One of = != < > <= >= contains regex in between."""
    ops = {
        "=": lambda: left == right, "!=": lambda: left != right, "<": lambda: left < right, ">": lambda: left > right,
        "<=": lambda: left <= right, ">=": lambda: left >= right, "contains": lambda: F.contains(left, F.lit(right)),
        "regex": lambda: left.rlike(right), "in": lambda: left.isin(list(right)), "between": lambda: left.between(*right),
    }
    return sure(ops[op]())


def matches_node(kind: str | None = None, label_contains: str | None = None, properties: dict | None = None, labels: list | None = None) -> Column:
    """Type, part of the label, properties that must be equal, and labels that must all be there."""
    parts = []
    if kind is not None:
        parts.append(F.col("type") == kind)
    if label_contains is not None:
        parts.append(F.contains("label", F.lit(label_contains)))
    parts += [prop(k) == str(v) for k, v in (properties or {}).items()]
    parts += [F.array_contains("labels", x) for x in labels or []]
    return sure(both(*parts))


def weight_between(low: float | None = None, high: float | None = None, column: str = "weight") -> Column:
    """Inclusive at both ends; an end that is not given is open."""
    parts = ([F.col(column) >= low] if low is not None else []) + ([F.col(column) <= high] if high is not None else [])
    return sure(both(*parts))


def wildcard(column: str, pattern: str) -> Column:
    """A pattern with * for any characters and ? for one."""
    return sure(F.col(column).rlike("^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$"))


def filter_input(**given) -> Column:
    """types, labels, created_after, created_before, weight_min, weight_max, confidence_min, confidence_max, sources, tags."""
    make = {
        "types": lambda v: F.col("type").isin(v), "labels": lambda v: both(*(F.array_contains("labels", x) for x in v)),
        "created_after": lambda v: F.col("created") > F.lit(v), "created_before": lambda v: F.col("created") < F.lit(v),
        "weight_min": lambda v: F.col("weight") >= v, "weight_max": lambda v: F.col("weight") <= v,
        "confidence_min": lambda v: F.col("confidence") >= v, "confidence_max": lambda v: F.col("confidence") <= v,
        "sources": lambda v: F.col("source").isin(v), "tags": lambda v: both(*(F.array_contains("tags", x) for x in v)),
    }
    return sure(both(*(make[k](v) for k, v in given.items() if v is not None)))


def has_all(required: Column, given: Column) -> Column:
    """Whether every element of one array is in another."""
    return sure(F.size(F.array_except(required, given)) == 0)


def path_constraint(path: str = "path", least: int | None = None, most: int | None = None) -> Column:
    """Bounds on a path's number of edges."""
    length = F.size(path) - 1
    return sure(both(*([length >= least] if least is not None else []), *([length <= most] if most is not None else [])))
