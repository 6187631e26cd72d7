"""Near copies by word shingles: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Words are those of simhash. A text of fewer words is one shingle, one without words the empty set; equal sets are copies
and count once. Pairs are proposed, then compared exactly. SimHash proposes: the fingerprints of the sets meet in the
vantage-point trees of simhash, which give every pair within 3 bits. But at a similarity of 0.8 two fingerprints differ in
9.7 of 64 bits on average, a distance at which trees part nothing any more, so SimHash alone can't give right results
here, and MinHash proposes too: 32 bands of 4 values, so a pair at 0.8 shares no band with a probability of
(1 - 0.8^4)^32 = 5e-8, and less above. Members of a bucket are linked to its least one and the stars joined to candidate
groups, which hold every proposed pair. A group's texts meet in one task, which compares the sets exactly: each document
with those that are not yet linked, over the postings of its shingles. A group of more than GROUP sets is dealt to blocks,
and each two blocks meet in a task. What is linked through others is one group.

Null texts count as empty, null ids as in simhash; repeated rows are copies. Extra columns are kept.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, broadcast_if_small, map_batches, table, utf8
from .simhash import MOST_BROADCAST, SEED, components, keep_least, links, majority, signed

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 32, 4
#: Sets of a candidate group that one task compares.
GROUP = 4_000
_ODD = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, k: int = WORDS) -> np.ndarray:
    """The hashes of a text's shingles, each once, in order."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends)]
    return np.unique(np.array(list(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, ends[k - 1 :], strict=False)], repeat(SEED))), np.uint64))


def set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64)) if len(s) else 0


def bands(s: np.ndarray) -> np.ndarray:
    """A hash for each band of the least values of the shingles under BANDS * ROWS orders."""
    if not len(s):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        least = np.minimum(least, (s[i : i + 512, None] * _ODD[0]).min(0))
    return ((least ^ (least >> np.uint64(29))) * _ODD[1]).reshape(BANDS, ROWS).sum(1, dtype=np.uint64).view(np.int64)


def linked(sets: list[np.ndarray], least: float = LEAST) -> list[int]:
    """For each set the number of the first one that it is linked to, itself or through others."""
    root = list(range(len(sets)))
    sizes = np.array([len(s) for s in sets], np.int64)
    terms = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
    each = np.split(terms, np.cumsum(sizes)[:-1]) if sets else []
    alive, listed = np.ones(len(sets), bool), 0
    starts = members = np.zeros(0, np.int64)

    def index() -> None:  # the postings of those that are not yet linked
        nonlocal starts, members
        owner = np.repeat(np.arange(len(sets)), sizes)
        keep = alive[owner]
        order = np.argsort(terms[keep], kind="stable")
        members = owner[keep][order]
        starts = np.concatenate([[0], np.cumsum(np.bincount(terms[keep], minlength=terms.max(initial=-1) + 1))])

    for first in range(len(sets)):
        if not alive[first]:
            continue
        alive[first] = False
        todo = [first]
        while todo and (left := int(alive.sum())):
            if not listed or left < listed // 2:
                index()
                listed = left
            x = todo.pop()
            a, n = starts[each[x]], starts[each[x] + 1] - starts[each[x]]
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(members[at], minlength=len(sets))
            near = np.flatnonzero(alive & (common > 0) & (common >= least * (sizes[x] + sizes - common) - 1e-9))
            alive[near] = False
            for i in near.tolist():
                root[i] = first
            todo += near.tolist()
    return root


def proposed(distinct: DataFrame) -> DataFrame:
    """(fp, other), fp > other: stars that join all sets that share a band, or whose fingerprints are 3 bits apart or less."""
    buckets = distinct.select("fp", F.explode("bands").alias("band"))
    least = buckets.groupBy("band").agg(F.min("fp").alias("other"), F.count("*").alias("n")).filter("n > 1").select("band", "other")
    by_band = buckets.join(least, "band").select("fp", "other")
    heads = table(distinct.groupBy("sim").agg(F.min("fp").alias("head")), "heads")
    alike = distinct.select("fp", "sim").join(heads, "sim").select("fp", F.col("head").alias("other"))
    near = links(heads.select(F.col("sim").alias("fp"))).select(F.col("fp").alias("sim"), F.col("other").alias("to"))
    near = near.join(heads, "sim").join(heads.select(F.col("sim").alias("to"), F.col("head").alias("at")), "to").select(F.greatest("head", "at").alias("fp"), F.least("head", "at").alias("other"))
    return by_band.unionByName(alike).unionByName(near).filter("fp > other").distinct()


def clusters(docs: DataFrame, prints: DataFrame, text: str) -> DataFrame:
    """(fp, root) of every set in prints (id, mark, fp, sim, bands); docs has their texts under the same id and mark."""
    distinct = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("first"), F.first("sim").alias("sim"), F.first("bands").alias("bands"))
    distinct = table(distinct.select("fp", "first.id", "first.mark", "sim", "bands"), "distinct")
    stars = components(proposed(distinct))
    stars = table(stars.unionByName(stars.select(F.col("root").alias("fp"), "root").distinct()), "stars")
    large = table(stars.groupBy("root").agg(F.ceil(F.count("*") / (GROUP / 2)).cast("int").alias("k")).filter(F.col("k") > 2), "large")
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    met = stars.join(broadcast_if_small(large, MOST_BROADCAST), "root", "left").withColumn("own", F.coalesce(own, F.lit(0)))
    met = met.withColumn("to", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).select("root", "fp", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"))
    wanted = distinct.select("fp", F.col("id").alias("__near_id"), F.col("mark").alias("__near_mark")).join(met.groupBy("fp").agg(F.first("root").alias("root"), F.collect_list(F.struct("i", "j")).alias("blocks")), "fp")
    given = docs.select(F.col("id").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    on = F.col("id").eqNullSafe(F.col("__near_id")) & (F.col("mark") == F.col("__near_mark"))
    met = given.join(broadcast_if_small(table(wanted, "wanted"), MOST_BROADCAST), on).select("root", "fp", "text", F.inline("blocks"))

    def pairs(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy()
        fps, at = np.unique(fps, return_index=True)  # a repeated row comes once
        texts = group.column("text")
        root = linked([shingles((texts[int(i)].as_py() or "").encode()) for i in at])
        return pa.table({"fp": fps, "root": fps[root]})

    joined = table(met.groupBy("root", "i", "j").applyInArrow(pairs, "fp long, root long"), "compared")
    if not large.isEmpty():  # a set of a large group was in many tasks
        found = components(joined.filter("fp <> root").select(F.greatest("fp", "root").alias("fp"), F.least("fp", "root").alias("other")).distinct())
        joined = found.unionByName(joined.select("fp").distinct().join(found, "fp", "left_anti").select("fp", F.col("fp").alias("root")))
    return table(distinct.select("fp").join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "near")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one of each group of near copies: the one of the least id; of rows that tie on it, one."""
    kind = docs.schema[key].dataType.simpleString()

    def f(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in utf8(batch.column(2))]
        return {"id": batch.column(0), "mark": batch.column(1), "fp": [set_id(s) for s in sets], "sim": [signed(majority(s)) for s in sets], "bands": [bands(s) for s in sets]}

    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), text)
    prints = table(map_batches(rows, f, f"id {kind}, mark long, fp long, sim long, bands array<long>"), "prints")
    found = clusters(docs.select(F.col(key).alias("id"), text), prints, text)
    return keep_least(docs, prints.select("id", "mark", "fp"), found, key, text)
