"""Mixing sources to target weights by capped water-filling.

Sizes are counts of words `[^\\x20\\x09-\\x0D]+` (null text: 0). Each source's target is its weight's share of all words,
clamped at `epochs` times its own size; what the clamp leaves over is dealt again by weight until none is above.
A document is then taken floor(target / size of its source) times whole, and the rest of the target is taken from the
source's documents in a seeded order: whole ones, until the last one gives the words that are still missing.

Sources are numbered by sorting them in ranges and adding up the ranges' sizes, and the clamp is found round by round, each
an aggregate over the sources: those whose share exceeds their cap at the present level are clamped and the level rises,
until none is. So there may be as many sources as there are domains.

The seeded order is the digest of id and text, so runs agree. No step holds one source's rows together: sums by the
digest's first digits are put in order (at most 256 a source at a time), then those within the part in which the target is
reached, and so on to a single digest; only rows of this digest, which are alike, are numbered, and dealt to parts for that.
Null sources are one source of their own, the last. Repeated rows each count. A source without words has target 0.
An empty table gives an empty result; extra columns stay unless they have the name of one that is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, broadcast_if_small, table

EPOCHS = 3
SEED = "mix-1"
#: Hex digits of the seeded digest that are looked at together, and that it has; parts that alike rows are numbered in.
STEP, DIGITS, PARTS = 2, 32, 256
#: Sources beyond this many are joined by a shuffle instead of a broadcast.
MOST_BROADCAST = 100_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Adds weights 1, 2, ..., cycle, repeating, by code point of the source, null last. One row a source."""
    placed = table(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("__mix_row", F.monotonically_increasing_id()), "mix-sources")
    part, nth = F.shiftright("__mix_row", 33), F.col("__mix_row").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # a row a range
    before, at = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        before[r["part"]], at = at, at + r["n"]
    offsets = placed.sparkSession.createDataFrame(list(before.items()), "__mix_part long, __mix_before long")
    met = placed.withColumn("__mix_part", part).join(F.broadcast(offsets), "__mix_part")
    return met.withColumn("weight", ((F.col("__mix_before") + nth) % cycle + 1).cast("long")).drop("__mix_row", "__mix_part", "__mix_before")


def targets(sources: DataFrame, epochs: int = EPOCHS, total: int | None = None) -> DataFrame:
    """sources: (source, source_size, weight), one row a source. Adds target.

    left words over a sum of weights is the level; it only rises, so what is clamped stays so, and in the end no free
    source's share is above its cap. Shares are compared as whole numbers.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    cap, weight = F.col("source_size") * epochs, F.coalesce("weight", F.lit(0))
    sums = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0)), F.count("*")).first()
    whole = int(sums[0]) if total is None else total
    left, over, clamped = whole, int(sums[1]), 0
    while over:
        above = wide(weight) * F.lit(left).cast("decimal(38,0)") > wide(cap) * F.lit(over).cast("decimal(38,0)")
        n, caps, rest = sources.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, weight)), F.lit(0))).first()
        if n == clamped or not rest:
            over = over if rest else 0
            break
        clamped, left, over = n, whole - int(caps), int(rest)
    if not over:
        return sources.withColumn("target", F.when(weight > 0, cap).otherwise(0).cast("double"))
    above = wide(weight) * F.lit(left).cast("decimal(38,0)") > wide(cap) * F.lit(over).cast("decimal(38,0)")
    return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise((weight * F.lit(left)).cast("double") / F.lit(over)))


def mix(docs: DataFrame, epochs: int = EPOCHS, seed: str = SEED, weights: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None, mark: str | None = None) -> DataFrame:
    """docs with size, source_size, target (of the source) and taken (words that the mix takes, repeats counted).

    weights: (source, weight); else 1, 2, 3, repeating. size, mark: columns of docs with the word counts and the texts' md5,
    if they are known.
    """
    added = ["size", "source_size", "target", "taken"]
    own = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")) if mark is None else F.col(mark)
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), own).cast("binary"))
    counted = word_count(text) if size is None else F.col(size)
    sized = docs.withColumns({"__mix_size": counted, "__mix_order": digest}).drop(*added).withColumnRenamed("__mix_size", "size")
    keys = table(sized.select(F.col(source).alias("source"), "__mix_order", "size"), "mix-keys")
    per_source = table(keys.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    if weights is None:
        weighed = cycled_weights(per_source)
    else:
        weighed = per_source.join(weights.select(F.col("source").alias("__mix_s"), F.col("weight").cast("long")), F.col("source").eqNullSafe(F.col("__mix_s")), "left").drop("__mix_s").fillna({"weight": 0})
    plan = targets(table(weighed, "mix-weights"), epochs).withColumn("target", F.coalesce("target", F.lit(0.0)))
    of = F.col("source_size")
    want = F.least(F.round("target").cast("long"), of * epochs)
    plan = plan.withColumn("__mix_whole", F.when(of > 0, F.floor(want / of)).otherwise(0).cast("long")).withColumn("__mix_rest", want - F.col("__mix_whole") * of)
    plan = table(plan.withColumnRenamed("source", "__mix_s"), "mix-plan")
    same = F.col("source").eqNullSafe(F.col("__mix_s"))
    cut = plan.filter("__mix_rest > 0").select("__mix_s", "__mix_rest", F.lit(0).cast("long").alias("__mix_before"), F.lit("").alias("__mix_cut"))
    for digits in (STEP, 2 * STEP, 4 * STEP, DIGITS):
        inner = keys.join(broadcast_if_small(table(cut, "mix-cut"), MOST_BROADCAST), same).filter(F.col("__mix_order").startswith(F.col("__mix_cut")))
        inner = inner.groupBy("__mix_s", F.substring("__mix_order", 1, digits).alias("__mix_part")).agg(F.sum("size").alias("__mix_words"), F.first("__mix_rest").alias("__mix_rest"), F.first("__mix_before").alias("__mix_start"))
        along = Window.partitionBy("__mix_s").orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1)
        upto = inner.withColumn("__mix_before", F.col("__mix_start") + F.coalesce(F.sum("__mix_words").over(along), F.lit(0)))
        upto = upto.filter((F.col("__mix_before") < F.col("__mix_rest")) & (F.col("__mix_before") + F.col("__mix_words") >= F.col("__mix_rest")))
        cut = upto.select("__mix_s", "__mix_rest", "__mix_before", F.col("__mix_part").alias("__mix_cut"))
    plan = plan.join(cut.select(F.col("__mix_s").alias("__mix_t"), "__mix_before", "__mix_cut"), F.col("__mix_s").eqNullSafe(F.col("__mix_t")), "left").drop("__mix_t", "weight")
    plan = broadcast_if_small(table(plan, "mix-plan"), MOST_BROADCAST)
    joined = sized.join(plan, F.col(source).eqNullSafe(F.col("__mix_s")), "left").drop("__mix_s")
    inside = F.col("__mix_cut").isNotNull() & (F.col("__mix_order") == F.col("__mix_cut"))
    # Rows of one digest are alike in id and text, and there may be many of them.
    edge = table(joined.filter(inside).withColumn("__mix_row", F.monotonically_increasing_id()), "mix-edge")
    edge = edge.withColumn("__mix_dealt", F.pmod(F.xxhash64("__mix_row"), F.lit(PARTS)))
    parts = edge.groupBy(F.col(source).alias("__mix_s"), F.col("__mix_dealt").alias("__mix_d")).agg(F.sum("size").alias("__mix_words"))
    along = Window.partitionBy("__mix_s").orderBy("__mix_d").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__mix_start", F.coalesce(F.sum("__mix_words").over(along), F.lit(0))).drop("__mix_words")
    edge = edge.join(parts, F.col(source).eqNullSafe(F.col("__mix_s")) & (F.col("__mix_dealt") == F.col("__mix_d"))).drop("__mix_s", "__mix_d")
    within = Window.partitionBy(source, "__mix_dealt").orderBy("__mix_row").rowsBetween(Window.unboundedPreceding, -1)
    mine = F.col("__mix_before") + F.col("__mix_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    edge = edge.withColumn("__mix_mine", mine).withColumn("__mix_extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("__mix_rest") - F.col("__mix_mine")))).drop("__mix_mine", "__mix_row", "__mix_dealt", "__mix_start")
    sure = joined.filter(~inside).withColumn("__mix_extra", F.when(F.col("__mix_order") < F.col("__mix_cut"), F.col("size")).otherwise(F.lit(0)))
    out = sure.unionByName(edge).withColumn("taken", (F.col("size") * F.col("__mix_whole") + F.col("__mix_extra")).cast("long"))
    return out.drop("__mix_order", "__mix_cut", "__mix_before", "__mix_whole", "__mix_rest", "__mix_extra")


def repetitions(mixed: DataFrame, text: str = "text") -> DataFrame:
    """A row for each repetition that the mix takes (repeat from 0; words); the last one's text is cut after its words."""
    n, words = F.col("size"), F.col("taken")
    times = F.when((n > 0) & (words > 0), F.sequence(F.lit(0), F.ceil(words / n).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    rows = mixed.withColumn("repeat", F.explode(times)).withColumn("words", F.least(n, words - F.col("repeat") * n))
    pieces = F.split(F.ltrim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")), " ")
    return rows.withColumn(text, F.when(F.col("words") < n, F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), " ")).otherwise(F.col(text)))
