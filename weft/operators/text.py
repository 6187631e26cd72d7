"""Search over texts and vectors, entities, schemas, alternatives with probabilities, and results from many providers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.scalars import cosine, word_set
from weft.operators import vectors
from weft.operators.analytics import connected_components
from weft.plans.lineage import broadcast_if_small, table

#: Queries that are broadcast at once.
BLOCK = 10_000


def terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): lower-cased words of letters and digits with their counts."""
    words = F.explode(F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), ""))
    return docs.select(key, words.alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf_search(docs: DataFrame, key: str, text: str, query: str, k: int = 10) -> DataFrame:
    """(key, score): the best by sum of tf ln(1 + N / df) over the query's words; only their postings are kept."""
    wanted = docs.sparkSession.createDataFrame([(w,) for w in sorted(set(query.lower().split()))], "term string")
    n = docs.count()
    listed = terms(docs, key, text).join(F.broadcast(wanted), "term")  # as many as the query has words
    df = listed.groupBy("term").agg(F.count("*").alias("df"))
    scored = listed.join(F.broadcast(df), "term").groupBy(key).agg(F.sum(F.col("tf") * F.log1p(F.lit(float(n)) / F.col("df"))).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), key).limit(k)


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, neighbor, similarity, rank): exact nearest by cosine of a stated set of queries.

    Whole-numbered rows with finite vectors of one length meet in products of blocks (weft.operators.vectors). Else queries are
    broadcast, in blocks, against all rows, a pass for each block; each task keeps its best k a query before anything is shuffled.
    """
    dim = vectors.regular(rows, key, vector)
    if dim and rows.schema[key].dataType == queries.schema[key].dataType and vectors.regular(queries, key, vector) == dim:
        return vectors.nearest(rows, queries, key, vector, k, dim)
    return _broadcast(rows, queries, key, vector, k)


def _broadcast(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    q = queries.select(F.col(key).alias("query"), F.col(vector).alias("_q"))
    n = -(-q.count() // BLOCK)
    if n <= 1:
        return _nearest(rows, q, key, vector, k)
    # All of a query's copies are in one block, and half as many again are made so that one seldom exceeds BLOCK.
    n += n // 2 + 1
    dealt = table(q.withColumn("_block", F.pmod(F.xxhash64("query"), F.lit(n))), "queries")
    found = [table(_nearest(rows, dealt.filter(F.col("_block") == i).drop("_block"), key, vector, k), "nearest") for i in range(n)]
    return reduce(DataFrame.unionByName, found)


def _nearest(rows: DataFrame, q: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    met = rows.select(F.col(key).alias("neighbor"), F.col(vector).alias("_v")).join(F.broadcast(q), F.col("neighbor") != F.col("query"))
    scored = met.select("query", "neighbor", F.round(cosine("_q", "_v"), 9).alias("similarity"))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbor")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuzzy_search(rows: DataFrame, column: str, query: str, most: int = 2) -> DataFrame:
    """Rows within an edit distance of the query, nearest first."""
    d = F.levenshtein(F.lower(F.col(column)), F.lit(query.lower()))
    return rows.withColumn("distance", d).filter(F.col("distance") <= most)


def hybrid_search(text_hits: DataFrame, vector_hits: DataFrame, key: str, text_weight: float = 0.5) -> DataFrame:
    """(key, score) of two scored lists, each score over its list's best."""
    top = lambda df: df.join(F.broadcast(df.agg(F.max("score").alias("_m"))), F.col("score") <= F.col("_m")).select(key, (F.col("score") / F.col("_m")).alias("score"))
    a, b = top(text_hits).withColumn("score", F.col("score") * text_weight), top(vector_hits).withColumn("score", F.col("score") * (1 - text_weight))
    return a.unionByName(b).groupBy(key).agg(F.sum("score").alias("score"))


def similar_texts(rows: DataFrame, key: str, text: str, least: float = 0.9) -> DataFrame:
    """(a, b, similarity), a < b: pairs whose word sets have a Jaccard similarity above `least`.

    Prefix filter: of two such sets one of each one's first n - ceil(least n) + 1 words, rarest first, is the same, so only
    rows that share such a word meet.
    """
    sets = rows.select(F.col(key).alias("id"), word_set(text).alias("w")).filter(F.size("w") > 0)
    each = sets.select("id", F.explode("w").alias("t"))
    order = each.join(each.groupBy("t").agg(F.count("*").alias("df")), "t")
    ranked = order.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("o"))
    ranked = ranked.select("id", F.transform("o", lambda x: x["t"]).alias("w"))
    n = F.size("w")
    prefix = ranked.select("id", "w", F.explode(F.slice("w", F.lit(1), (n - F.ceil(n * least) + 1).cast("int"))).alias("t"))
    met = prefix.alias("a").join(prefix.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.id") < F.col("b.id")) & (F.size("a.w") * least <= F.size("b.w")) & (F.size("b.w") * least <= F.size("a.w")))
    pairs = met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.w").alias("x"), F.col("b.w").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    scored = pairs.withColumn("similarity", common / (F.size("x") + F.size("y") - common)).filter(F.col("similarity") > least)
    return scored.groupBy("a", "b").agg(F.first("similarity").alias("similarity"))


def merge_entities(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """(entity, names, confidence, attributes) of (id, name, type, confidence, attributes map).

    Entities of a type are one if their names are equal but for case, or have similar word sets, and so are those linked
    through others; the greatest confidence and all attributes are kept, of a key that several have the surest one's.
    """
    named = rows.withColumn("_n", F.lower(F.trim("name")))
    first = named.groupBy("type", "_n").agg(F.min("id").alias("rep"))
    reps = first.select(F.col("rep").alias("id"), F.col("_n"), "type")
    alike = similar_texts(reps, "id", "_n", least).join(reps.select(F.col("id").alias("a"), F.col("type").alias("ta")), "a").join(reps.select(F.col("id").alias("b"), F.col("type").alias("tb")), "b").filter("ta = tb")
    linked = connected_components(alike.select(F.col("a").alias("src"), F.col("b").alias("dst")), reps.select(F.col("id").alias("node")))
    whole = named.join(first, ["type", "_n"]).join(linked.select(F.col("node").alias("rep"), F.col("component").alias("entity")), "rep")
    attrs = whole.select("entity", "confidence", "id", F.explode("attributes").alias("k", "v")).groupBy("entity", "k").agg(F.min_by("v", F.struct((-F.col("confidence")).alias("c"), "id")).alias("v"))
    maps = attrs.groupBy("entity").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    out = whole.groupBy("entity").agg(F.sort_array(F.collect_set("name")).alias("names"), F.max("confidence").alias("confidence"))
    return out.join(maps, "entity", "left")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule, a column that must hold, that a row breaks; a null breaks nothing."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values of columns that should be unique and are not, with their number."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def expected_values(alternatives: DataFrame, by: list[str], value: str, probability: str) -> DataFrame:
    """(by, expected, most_likely, entropy) of alternatives with weights, scaled to add up to 1 in each group."""
    p = F.col(probability)
    total = F.sum(p)
    entropy = F.log(total) - F.sum(p * F.log(p)) / total
    return alternatives.filter(p > 0).groupBy(*by).agg((F.sum(F.col(value) * p) / total).alias("expected"), F.max_by(value, F.struct(probability, value)).alias("most_likely"), entropy.alias("entropy"))


def observe(alternatives: DataFrame, by: list[str], value: str, probability: str, seed: int = 7) -> DataFrame:
    """One alternative of each group, drawn with its probability; the draw depends on seed and group alone. Values of a group differ."""
    w = Window.partitionBy(*by).orderBy(value)
    upto = F.sum(probability).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(probability).over(Window.partitionBy(*by))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in by]).cast("binary"))
    u = F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") / float(1 << 28)
    return alternatives.withColumns({"_upto": upto, "_u": u}).filter("_u < _upto").groupBy(*by).agg(F.min_by(value, "_upto").alias(value))


def federated(results: DataFrame, providers: DataFrame, k: int) -> DataFrame:
    """(item, score, provider): results (provider, item, score) weighed by reputation; of an item the best one; the k best."""
    met = results.join(broadcast_if_small(providers), "provider").withColumn("score", F.col("score") * F.col("reputation"))
    best = met.groupBy("item").agg(F.max(F.struct("score", "provider")).alias("b")).select("item", "b.score", "b.provider")
    return best.orderBy(F.desc("score"), "item").limit(k)


def federated_average(parts: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    return parts.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("average"))


def provenance(rows: DataFrame, by: list[str], order: str, content: str) -> DataFrame:
    """Rows with chain: each row's digest is over the chain before it and its own digest, along the order.

    A chain is one sequence: it is carried along, a value a row, not gathered again for each.
    """
    own = F.sha2(F.col(content).cast("string").cast("binary"), 256)
    listed = rows.withColumn("_own", own).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*[c for c in rows.columns if c not in by]).alias("_row"), "_own"))).alias("_all"))
    empty = F.array().cast("array<string>")
    chained = F.aggregate("_all", F.struct(F.lit("").alias("last"), empty.alias("out")), lambda s, x: F.struct(F.sha2(F.concat(s["last"], x["_own"]).cast("binary"), 256).alias("last"), F.array_append(s["out"], F.sha2(F.concat(s["last"], x["_own"]).cast("binary"), 256)).alias("out")))["out"]
    each = listed.select(*by, F.explode(F.arrays_zip(F.col("_all._row").alias("r"), chained.alias("chain"))).alias("z"))
    return each.select(*by, F.col("z.r.*"), F.col("z.chain").alias("chain")).select(*rows.columns, "chain")


def trust(rows: DataFrame, by: str, good: Column, prior: float = 1.0) -> DataFrame:
    """(by, trust, n): the share of good outcomes, drawn towards a half by a prior."""
    return rows.groupBy(by).agg(((F.count_if(good) + prior) / (F.count("*") + 2 * prior)).alias("trust"), F.count("*").alias("n"))


def blinded_intersection(a: DataFrame, b: DataFrame, key: str, salt: str) -> DataFrame:
    """(token): digests, under a salt that both sides share, of the keys that both have; neither gives its keys away."""
    token = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")).cast("binary"), 256).alias("token")
    return a.select(token).distinct().join(b.select(token).distinct(), "token")


def chunks(docs: DataFrame, key: str, text: str, words: int = 200, overlap: int = 20) -> DataFrame:
    """(key, chunk, n_words, content): texts in pieces of so many words, each beginning with the last ones of the one before."""
    w = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), "")
    step = words - overlap
    cut = docs.select(key, w.alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("_w") - words) / step)).cast("int"))
    each = cut.select(key, "_w", F.explode(starts).alias("chunk"))
    piece = F.slice("_w", F.col("chunk") * step + 1, F.lit(words))
    return each.select(key, "chunk", F.size(piece).alias("n_words"), F.array_join(piece, " ").alias("content"))


def crossover(a: DataFrame, b: DataFrame, seed: str = "cross") -> DataFrame:
    """(src, dst): a graph bred from two: an edge of both is kept, one of a single parent if a seeded draw falls to it."""
    sides = a.select("src", "dst").distinct().withColumn("p", F.lit(1)).unionByName(b.select("src", "dst").distinct().withColumn("p", F.lit(2)))
    met = sides.groupBy("src", "dst").agg(F.sum("p").alias("p"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("src").cast("string"), F.col("dst").cast("string")).cast("binary")), 1, 1), 16, 10).cast("int")
    return met.filter((F.col("p") == 3) | ((F.col("p") == 1) & (draw < 8)) | ((F.col("p") == 2) & (draw >= 8))).select("src", "dst")


def mutated(edges: DataFrame, share: float, seed: str = "mutate") -> DataFrame:
    """(src, dst): without a seeded share of the edges."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("src").cast("string"), F.col("dst").cast("string")).cast("binary")), 1, 4), 16, 10).cast("int") / 65536
    return edges.filter(draw >= share).select("src", "dst")
