"""Counts, grouped sums, buckets, percentiles by index, periods and gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.plans.lineage import broadcast_if_small, table
from weft.sources.tables import Graph


def count_graph(graph: Graph) -> DataFrame:
    """(nodes, edges, total)."""
    n = graph.nodes.agg(F.count("*").alias("nodes"), F.lit(0).cast("long").alias("edges"))
    e = graph.edges.agg(F.lit(0).cast("long").alias("nodes"), F.count("*").alias("edges"))
    return n.unionByName(e).agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges")).withColumn("total", F.col("nodes") + F.col("edges"))


def grouped(rows: DataFrame, by: list[str], **named: tuple[str, str]) -> DataFrame:
    """Aggregates name=(function, column): count, sum, avg, min, max, distinct."""
    make = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "distinct": F.countDistinct}
    return rows.groupBy(*by).agg(*[make[f](c).alias(name) for name, (f, c) in named.items()])


def bucketed(rows: DataFrame, value: str, width: float = 0.1) -> DataFrame:
    """Rows by bucket of a value: (bucket, n, least, most)."""
    bucket = F.round(F.floor(F.col(value) / width + 1e-9) * width, 6)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


#: Cells of equal width that a group's values are counted in before any are put in order.
CELLS = 4096


def percentiles(rows: DataFrame, by: list[str], value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """count, mean, min, max, population deviation, and the ordered values at index floor(n p) of each group.

    Values are counted in cells first; only those in the cell that holds an index are put in order, so that a group with
    very many rows is not one task's sort.
    """
    known = rows.filter(F.col(value).isNotNull())
    v = F.col(value).cast("double")
    bounds = known.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_pop(v).alias("deviation"))
    named = bounds.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("n").alias("_all"), F.col("least").cast("double").alias("_low"), F.col("most").cast("double").alias("_high"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True))
    width = F.nullif((F.col("_high") - F.col("_low")) / CELLS, F.lit(0.0))
    placed = known.join(broadcast_if_small(table(named, "bounds")), same).withColumn("_cell", F.coalesce(F.floor((v - F.col("_low")) / width), F.lit(0)))
    cells = placed.groupBy(*by, "_cell").agg(F.count("*").alias("_n"), F.first("_all").alias("_all"))
    along = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # at most CELLS + 1 rows
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0)))
    index = lambda p: F.least(F.floor(F.col("_all") * p), F.col("_all") - 1)
    held = [F.when((index(p) >= F.col("_before")) & (index(p) < F.col("_before") + F.col("_n")), index(p) - F.col("_before")) for p in at]
    wanted = cells.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_cell").alias("_at"), F.array(*held).alias("_want")).filter(F.exists("_want", lambda x: x.isNotNull()))
    inner = placed.drop(*[f"_{c}" for c in by]).join(broadcast_if_small(table(wanted, "wanted")), same & (F.col("_cell") == F.col("_at")))
    nth = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(value)) - 1
    found = inner.withColumn("_nth", nth).groupBy(*by).agg(*[F.max(F.when(F.col("_nth") == F.col("_want")[i], F.col(value))).alias(f"p{round(p * 100)}") for i, p in enumerate(at)])
    found = found.withColumnsRenamed({c: f"_{c}" for c in by})
    return bounds.join(found, same).drop(*[f"_{c}" for c in by])


def by_period(rows: DataFrame, by: list[str], time: str, value: str, period: str = "month") -> DataFrame:
    """avg, count and the most recent value (ties: the largest) of each period."""
    return rows.groupBy(*by, F.date_trunc(period, F.col(time)).alias("period")).agg(F.avg(value).alias("average"), F.count("*").alias("n"), F.max_by(value, F.struct(time, value)).alias("most_recent"))


def mean_gap(rows: DataFrame, by: list[str], time: str, tie: str) -> DataFrame:
    """Mean seconds between consecutive rows of a group, and their number; rows that tie follow by `tie`."""
    w = Window.partitionBy(*by).orderBy(time, tie)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    gap = (micros - F.lag(micros).over(w)) / 1e6
    return rows.withColumn("_gap", gap).groupBy(*by).agg(F.avg("_gap").alias("mean_gap"), F.count("_gap").alias("gaps"))


def set_of(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sort_array(F.collect_set(value)).alias("values"))


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def approximate(rows: DataFrame, value: str, quality: float = 0.95) -> DataFrame:
    """Distinct count and median, each with an error of 1 - quality."""
    return rows.agg(F.approx_count_distinct(value, 1 - quality).alias("distinct_values"), F.percentile_approx(value, 0.5, int(1 / (1 - quality) ** 2)).alias("median"))


def numbered(rows: DataFrame, order: list[Column], name: str = "nth") -> DataFrame:
    """rows with their number, from 1, in an order of all: ranges are sorted apart and begin after those before them."""
    placed = table(rows.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()), "ordered")
    part, at = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    before, n = [], 0
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["part"]):  # a row a range
        before.append((r["part"], n))
        n += r["n"]
    offsets = placed.sparkSession.createDataFrame(before, "_part long, _before long")
    met = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return met.withColumn(name, F.col("_before") + at + 1).drop("_row", "_part", "_before")
