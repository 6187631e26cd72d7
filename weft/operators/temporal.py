"""Facts with valid times (closed intervals, null ends are open) and versions (half-open intervals)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.plans.lineage import broadcast_if_small


def _t(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("timestamp")


def valid_at(t, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Whether a closed interval holds a time; a null start or end is open."""
    a, b = F.col(start), F.col(end)
    return (a.isNull() | (a <= _t(t))) & (b.isNull() | (b >= _t(t)))


def version_at(t, start: str = "valid_from", end: str = "valid_to") -> Column:
    a, b = F.col(start), F.col(end)
    return (a.isNull() | (a <= _t(t))) & (b.isNull() | (b > _t(t)))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether two closed intervals share a time."""
    before = lambda s, e: s.isNull() | e.isNull() | (s <= e)
    return before(s1, e2) & before(s2, e1)


def before(e1: Column, s2: Column) -> Column:
    return F.coalesce(e1 < s2, F.lit(False))


def after(s1: Column, e2: Column) -> Column:
    return F.coalesce(s1 > e2, F.lit(False))


def during(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether the first lies within the second."""
    return (s2.isNull() | F.coalesce(s1 >= s2, F.lit(False))) & (e2.isNull() | F.coalesce(e1 <= e2, F.lit(False)))


def meets(e1: Column, s2: Column) -> Column:
    return F.coalesce(e1 == s2, F.lit(False))


def relation(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """One of before, after, meets, met_by, equal, during, contains, overlaps."""
    return (
        F.when(before(e1, s2), "before").when(after(s1, e2), "after").when(meets(e1, s2), "meets").when(meets(e2, s1), "met_by")
        .when(s1.eqNullSafe(s2) & e1.eqNullSafe(e2), "equal").when(during(s1, e1, s2, e2), "during").when(during(s2, e2, s1, e1), "contains").otherwise("overlaps")
    )


def snapshot(facts: DataFrame, t) -> DataFrame:
    return facts.filter(valid_at(t))


def changes(facts: DataFrame, t1, t2, key: list[str]) -> DataFrame:
    """Facts (by key) that hold at one of two times only, with change added or removed."""
    both = facts.select(*key, valid_at(t1).alias("a"), valid_at(t2).alias("b")).groupBy(*key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.filter(F.col("a") != F.col("b")).select(*key, F.when(F.col("b"), "added").otherwise("removed").alias("change"))


def timeline(facts: DataFrame, by: list[str], value: str, start: str = "valid_from") -> DataFrame:
    """Facts with the value before, and nth, along time; ties go by value."""
    w = Window.partitionBy(*by).orderBy(start, value)
    return facts.withColumns({"nth": F.row_number().over(w), "previous": F.lag(value).over(w)})


def bounded(rows: DataFrame, bounds: DataFrame, on: list[str], start: str, end: str) -> DataFrame:
    """rows with open ends put at their key's bounds (low, high); the others as they are."""
    open_ = F.col(start).isNull() | F.col(end).isNull()
    met = rows.filter(open_).join(bounds, on)
    closed = met.withColumns({start: F.coalesce(start, F.least("_low", end)), end: F.coalesce(end, F.greatest("_high", start))}).select(*rows.columns)
    return rows.filter(~open_).unionByName(closed)


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], days: int = 30, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Pairs with equal `on` whose closed intervals overlap, each once; b's other columns get the prefix b_. Null ends are open.

    Intervals are cut into the periods of some days that they touch, so the join is on equal keys and period; a pair is
    kept in the later of its two first periods. For that an open end is put at the first or last time of its key on
    either side, beyond which nothing is to be met; intervals that end before they begin are left out.
    """
    number = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / (86400 * days))
    cut = lambda df, s, e: df.withColumn("_period", F.explode(F.sequence(number(F.col(s)), number(F.col(e)))))
    times = a.select(*on, start, end).unionByName(b.select(*on, start, end))
    some = F.array_compact(F.array(start, end))
    bounds = times.select(*on, F.array_min(some).alias("_low"), F.array_max(some).alias("_high")).groupBy(*on).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    never = F.lit("1970-01-01").cast(a.schema[start].dataType)  # of keys without any time all is open
    bounds = bounds.withColumns({"_low": F.coalesce("_low", never), "_high": F.coalesce("_high", never)})
    marked = lambda df: df.withColumns({"_start": F.col(start), "_end": F.col(end)})
    left = bounded(marked(a), bounds, on, "_start", "_end").filter(F.col("_start") <= F.col("_end"))
    right = bounded(marked(b), bounds, on, "_start", "_end").filter(F.col("_start") <= F.col("_end"))
    right = right.select(*on, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in on], F.col("_start").alias("_b_start"), F.col("_end").alias("_b_end"))
    met = cut(left, "_start", "_end").join(cut(right, "_b_start", "_b_end"), [*on, "_period"])
    met = met.filter((F.col("_start") <= F.col("_b_end")) & (F.col("_b_start") <= F.col("_end")))
    return met.filter(F.col("_period") == F.greatest(number(F.col("_start")), number(F.col("_b_start")))).drop("_period", "_start", "_end", "_b_start", "_b_end")


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], time: str, right_time: str, values: list[str], tie: str | None = None) -> DataFrame:
    """left with the values of the last right row at or before its time (null if there is none).

    Both sides in one sort by key and time, instead of a join on a range: each left row takes the last right row above it.
    """
    order = [F.col(tie)] if tie else []
    none = F.lit(None)
    payload = F.struct(F.col(right_time).alias("_at"), *values)
    kind = right.select(payload.alias("p")).schema["p"].dataType
    l = left.select(*by, F.col(time).alias("_time"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), none.cast(kind).alias("_right"), *([none.cast(right.schema[tie].dataType).alias("_tie")] if tie else []))
    r = right.select(*by, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), none.cast(l.schema["_row"].dataType).alias("_row"), payload.alias("_right"), *[o.alias("_tie") for o in order])
    w = Window.partitionBy(*by).orderBy("_time", "_side", *(["_tie"] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_last", F.last("_right", ignorenulls=True).over(w))
    return both.filter("_side = 1").select("_row.*", F.col("_last._at").alias(f"{right_time}_as_of"), *[F.col(f"_last.{v}").alias(v) for v in values])


def exclusive_conflicts(facts: DataFrame, key: list[str], value: str, days: int = 30) -> DataFrame:
    """Pairs of different values of the same exclusive fact whose intervals overlap; each pair once."""
    met = overlap_join(facts, facts, key, days)
    return met.filter(F.col(value) < F.col(f"b_{value}"))


def impossible_sequences(facts: DataFrame, by: list[str], first: Column, then: Column, time: str = "valid_from") -> DataFrame:
    """Keys of which something that must follow comes before what it follows: (first_time, then_time)."""
    at = facts.groupBy(*by).agg(F.min(F.when(first, F.col(time))).alias("first_time"), F.min(F.when(then, F.col(time))).alias("then_time"))
    return at.filter(F.col("then_time") < F.col("first_time"))


def causal_pairs(events: DataFrame, rules: DataFrame, by: list[str], time: str, kind: str, within_seconds: int) -> DataFrame:
    """(by, cause, effect, cause_time, effect_time): an effect within some seconds of the last cause before it.

    rules: (cause, effect), a short list of types.
    """
    effects = events.join(broadcast_if_small(rules), F.col(kind) == F.col("effect")).select(*by, "cause", "effect", F.col(time).alias("effect_time"))
    causes = events.select(*by, F.col(kind).alias("cause"), F.col(time).alias("cause_time"))
    met = as_of_join(effects, causes.withColumn("_t", F.col("cause_time")), [*by, "cause"], "effect_time", "cause_time", ["_t"])
    near = met.filter(F.unix_micros(F.col("effect_time").cast("timestamp")) - F.unix_micros(F.col("cause_time_as_of").cast("timestamp")) <= within_seconds * 1_000_000)
    return near.select(*by, "cause", "effect", F.col("cause_time_as_of").alias("cause_time"), "effect_time")


def versions(rows: DataFrame, key: list[str], created: str, tie: str) -> DataFrame:
    """Rows with version, valid_from and valid_to: each is valid until the next is created."""
    w = Window.partitionBy(*key).orderBy(created, tie)
    return rows.withColumns({"version": F.row_number().over(w), "valid_from": F.col(created), "valid_to": F.lead(created).over(w)})


def version_links(rows: DataFrame, key: list[str], created: str, tie: str) -> DataFrame:
    """(src, dst, type): each version and the one before it, PREVIOUS_VERSION."""
    w = Window.partitionBy(*key).orderBy(created, tie)
    return rows.select(F.col(tie).alias("src"), F.lag(tie).over(w).alias("dst"), F.lit("PREVIOUS_VERSION").alias("type")).filter("dst is not null")


def predicted(events: DataFrame, by: list[str], time: str, tie: str) -> DataFrame:
    """(by, n, last, next): when a key's next event is due, its last one and the mean gap between its events."""
    w = Window.partitionBy(*by).orderBy(time, tie)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    gaps = events.withColumn("_t", micros).withColumn("_gap", micros - F.lag(micros).over(w))
    out = gaps.groupBy(*by).agg(F.count("*").alias("n"), F.max("_t").alias("_last"), F.avg("_gap").alias("_mean"))
    return out.select(*by, "n", F.timestamp_micros("_last").alias("last"), F.timestamp_micros((F.col("_last") + F.round("_mean")).cast("long")).alias("next"))


def version_as_of(rows: DataFrame, key: list[str], created: str, tie: str, t) -> DataFrame:
    """Of each key the last row created at or before a time, without sorting: one aggregate."""
    known = rows.filter(F.col(created) <= _t(t))
    return known.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(created, tie)).alias("r")).select(*key, "r.*")


def next_version(version: str | Column, kind: str = "semantic", now: Column | None = None) -> Column:
    """semantic: the third number one up; sequential: the number one up; timestamp: the given time's seconds."""
    v = F.col(version) if isinstance(version, str) else version
    if kind == "sequential":
        return (v.cast("long") + 1).cast("string")
    if kind == "timestamp":
        return F.unix_seconds(now if now is not None else F.current_timestamp()).cast("string")
    n = F.split(v, "\\.")
    return F.concat_ws(".", n[0], n[1], (n[2].cast("long") + 1).cast("string"))


def resolved(facts: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of contradicting facts the one that comes first in an order, such as confidence, authority or time."""
    return facts.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_nth = 1").drop("_nth")


def consensus(facts: DataFrame, key: list[str], value: str) -> DataFrame:
    """The value that most facts give; ties go to the greatest sum of confidence, then the least value."""
    votes = facts.groupBy(*key, value).agg(F.count("*").alias("votes"), F.sum("confidence").alias("sum_confidence"))
    return resolved(votes, key, [F.desc("votes"), F.desc("sum_confidence"), F.asc(value)])
