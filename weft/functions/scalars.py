"""Scalar functions: text, numbers, dates, arrays, maps, vectors, bits and checks, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_set(text: str | Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(_c(text)), r"\s+"), ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_jaccard(a: str | Column, b: str | Column) -> Column:
    return jaccard(word_set(a), word_set(b))


def set_cosine(a: Column, b: Column) -> Column:
    n = F.size(a) * F.size(b)
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(n.cast("double")))


def dot(a: str | Column, b: str | Column) -> Column:
    """Of two arrays of numbers, summed as doubles."""
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def add(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def multiply(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x * y)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def euclidean(a: str | Column, b: str | Column) -> Column:
    squares = F.zip_with(_c(a), _c(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def merge(base: str | Column, over: str | Column) -> Column:
    """Two maps as one; where both have a key, the second's value."""
    base, over = _c(base), _c(over)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def maps_equal(a: str | Column, b: str | Column) -> Column:
    return F.sort_array(F.map_entries(_c(a))) == F.sort_array(F.map_entries(_c(b)))


def map_hash(m: str | Column) -> Column:
    """The same for maps with the same entries in any order."""
    return F.xxhash64(F.sort_array(F.map_entries(_c(m))).cast("string"))


def popcount(x: str | Column) -> Column:
    return F.bit_count(_c(x))


def leading_zeros(x: str | Column) -> Column:
    """Of a 64-bit number."""
    return F.when(_c(x) == 0, 64).otherwise(64 - F.length(F.bin(_c(x))))


def first_set(x: str | Column) -> Column:
    """Place of the lowest bit that is set, from 0; null if none is."""
    return F.when(_c(x) != 0, F.bit_count(F.bitwise_not(_c(x)).bitwiseAND(_c(x) - 1)))


def position(sorted_array: str | Column, x) -> Column:
    """Place in an array, from 0; -1 if it is not there."""
    return (F.array_position(_c(sorted_array), x) - 1).cast("int")


def compare_arrays(a: str | Column, b: str | Column) -> Column:
    """-1, 0 or 1 in the order of elements."""
    return F.when(_c(a) < _c(b), -1).when(_c(a) > _c(b), 1).otherwise(0)


def clean(text: str | Column) -> Column:
    """Without control characters and outer spaces."""
    return F.trim(F.regexp_replace(_c(text), r"\p{Cntrl}", ""))


def stable_id(text: str | Column) -> Column:
    """A UUID made of the text's digest."""
    h = F.sha2(_c(text).cast("binary"), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def literal(x: str | Column, kind: str) -> Column:
    """A value as text with its type: "text", 1, true or null."""
    x = _c(x)
    said = F.concat(F.lit('"'), F.regexp_replace(x.cast("string"), r'([\\"])', r"\\$1"), F.lit('"')) if kind == "string" else x.cast("string")
    return F.coalesce(said, F.lit("null"))


def valid_name(x: str | Column) -> Column:
    return F.coalesce(_c(x).rlike(r"^[A-Za-z_][A-Za-z0-9_]{0,63}$"), F.lit(False))


def size_of(x: str | Column, kind: str) -> Column:
    """Bytes that a value takes: its text's, or its type's."""
    fixed = {"long": 8, "double": 8, "int": 4, "boolean": 1, "timestamp": 8}
    return F.when(_c(x).isNull(), 0).otherwise(F.lit(fixed[kind]) if kind in fixed else F.octet_length(_c(x)))


def complex_multiply(a: str | Column, b: str | Column) -> Column:
    """Of structs (re, im)."""
    a, b = _c(a), _c(b)
    return F.struct((a.re * b.re - a.im * b.im).alias("re"), (a.re * b.im + a.im * b.re).alias("im"))


def magnitude(a: str | Column) -> Column:
    return F.hypot(_c(a).re, _c(a).im)


def phase(a: str | Column) -> Column:
    return F.atan2(_c(a).im, _c(a).re)


def decayed(confidence: str | Column, valid: str | Column, by: float = 0.8) -> Column:
    """Confidence, less where validation failed."""
    return F.when(F.coalesce(_c(valid), F.lit(False)), _c(confidence)).otherwise(_c(confidence) * by)


def level_score(level: str | Column) -> Column:
    """Scores of levels of expertise; null for any other."""
    scores = {"expert": 10, "advanced": 8, "intermediate": 6, "beginner": 3}  # fixed values
    return F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])[F.lower(_c(level))]


def spatial_key(x: str | Column, y: str | Column, cell: float = 100) -> Column:
    """The grid's cell, or 'unknown' where a coordinate is missing (0 is a coordinate)."""
    key = F.concat_ws("_", F.floor(_c(x) / cell).cast("string"), F.floor(_c(y) / cell).cast("string"))
    return F.when(_c(x).isNull() | _c(y).isNull(), "unknown").otherwise(key)


def day_key(t: str | Column) -> Column:
    return F.date_format(_c(t), "yyyy-MM-dd")


def from_micros(x: str | Column) -> Column:
    return F.timestamp_micros(_c(x).cast("long"))


def to_micros(t: str | Column) -> Column:
    return F.unix_micros(_c(t).cast("timestamp"))


def period_start(t: str | Column, period: str) -> Column:
    return F.date_trunc(period, _c(t))


def period_end(t: str | Column, period: str) -> Column:
    """The last microsecond of the year or month."""
    months = {"year": 12, "month": 1, "quarter": 3}[period]
    return F.date_trunc(period, _c(t)) + F.make_ym_interval(F.lit(0), F.lit(months)) - F.expr("interval 1 microsecond")
