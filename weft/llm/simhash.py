"""Near-duplicates by SimHash: fingerprints, vantage-point trees for all pairs within 3 bits, connected components.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; features are 3-word shingles with repeats (fewer words:
the whole sequence), hashed with XXH64, seed 42. Texts without words have fingerprint 0, which links like any other.

Equal fingerprints count once. Two that differ in 3 bits or fewer differ in at most one bit of one of their halves, so a
forest of two vantage-point trees, one for the Hamming distance on each half, is searched with radius 1: at a vantage point
p and a radius m, points with d(p, x) <= m go inside and those with d(p, x) >= m outside. By the triangle inequality no
pair within 1 is parted, since what lies on the boundary goes to both sides. The upper levels, from a bounded sample,
deal fingerprints to shards; shards that are still large get trees of their own, each from a sample of its own, until none
is; each shard's task goes on until few points are left to compare.
Only a spanning forest of a shard's links is returned, never all its pairs, so a group of many near copies costs no more
rows than it has fingerprints; and a point is compared only with those that are not yet linked.

Null texts count as empty. Null ids link like others and are passed over for component_id unless there is no other.
Repeated rows are copies. An empty table gives an empty result. Extra columns are left out, or kept by deduplicate().
"""

from __future__ import annotations

import pickle
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, broadcast_if_small, map_batches, table, utf8

SHINGLE, SEED, BITS = 3, 42, 3
HALVES = (0x00000000FFFFFFFF, 0xFFFFFFFF00000000)
#: Fingerprints that the upper levels are drawn from at most, and those of a shard; fingerprints wanted in a shard, points
#: compared at the end; vantage points tried where the first ones part nothing.
SAMPLE, SHARD_SAMPLE, SHARD, FEW, MANY_TRIES = 65_536, 4_096, 20_000, 512, 64
#: Rows up to which a side of a join is broadcast.
MOST_BROADCAST = 200_000


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    if len(words) <= k:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = [0, *(e + 1 for e in ends)]
        hashes = list(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, ends[k - 1 :], strict=False)], repeat(SEED)))
    return majority(np.array(hashes, np.uint64))


def majority(h: np.ndarray) -> int:
    """The number whose bits are those that more than half of the numbers have."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        counts += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mark, fp): a hash of the text, and the fingerprint as a signed 64-bit number."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.xxhash64(text).alias("mark"), text)
    return map_batches(rows, lambda b: {key: b.column(0), "mark": b.column(1), "fp": [signed(fingerprint(t)) for t in utf8(b.column(2))]}, f"`{key}` {kind}, mark long, fp long")


def split(x: np.ndarray, mask: int, radius: int, tries: int = 3) -> tuple[int, int] | None:
    """A vantage point and radius that part x best, or None if none leaves both sides clearly smaller."""
    best, found = 0.9 * len(x), None
    for i in range(tries):
        p = x[(i * 7919 + len(x) // 2) % len(x)]
        counts = np.bincount(np.bitwise_count((x ^ p) & np.uint64(mask)), minlength=65)
        below = np.cumsum(counts)
        inside, outside = below, len(x) - np.concatenate(([0] * radius, below[: 65 - radius]))
        worst = np.maximum(inside, outside)
        if worst.min() < best:
            best, found = worst.min(), (int(p), int(worst.argmin()))
    return found


def sides(x: np.ndarray, at: tuple[int, int], mask: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.bitwise_count((x ^ np.uint64(at[0])) & np.uint64(mask))
    return d <= at[1], d > at[1] - radius


def grow(sample: np.ndarray, mask: int, depth: int) -> dict | int:
    """The upper levels: {vantage point, radius, inside, outside}, and at the leaves their numbers."""
    numbers = iter(range(1 << 30))

    def node(x: np.ndarray, depth: int):
        at = split(x, mask, 1) if depth and len(x) >= 8 else None
        if at is None:
            return next(numbers)
        a, b = sides(x, at, mask, 1)
        return {"at": at, "in": node(x[a], depth - 1), "out": node(x[b], depth - 1)}

    return node(sample, depth)


def deal(x: np.ndarray, tree: dict | int, mask: int) -> list[tuple[int, np.ndarray]]:
    """(leaf, the fingerprints that belong there); those on a boundary belong to both sides."""
    if isinstance(tree, int):
        return [(tree, x)] if len(x) else []
    a, b = sides(x, tree["at"], mask, 1)
    return deal(x[a], tree["in"], mask) + deal(x[b], tree["out"], mask)


def linked(x: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Connected groups of two or more among few points: each point is compared with those not yet linked."""
    out, rest = [], x
    while len(rest):
        group, todo, rest = [rest[:1]], [rest[0]], rest[1:]
        while todo and len(rest):
            near = np.bitwise_count(rest ^ todo.pop()) <= bits
            if near.any():
                more, rest = rest[near], rest[~near]
                group.append(more)
                todo += list(more)
        if len(group) > 1:
            out.append(np.concatenate(group))
    return out


def search(x: np.ndarray, mask: int, few: int = FEW) -> list[np.ndarray]:
    """Linked groups that hold every pair of x within 1 on the masked half and 3 in all."""
    out, todo = [], [(x, mask, 1)]
    while todo:
        x, mask, radius = todo.pop()
        at = split(x, mask, radius) if len(x) > few else None
        if at is None and len(x) > few and radius == 1:  # halves that are all alike: the whole distance can part them
            mask, radius = (1 << 64) - 1, BITS
            at = split(x, mask, radius)
        if at is None and len(x) > few:
            at = split(x, mask, radius, MANY_TRIES)
        if at is None:
            out += linked(x)
            continue
        a, b = sides(x, at, mask, radius)
        todo += [(x[a], mask, radius), (x[b], mask, radius)]
    return out


def links(distinct: DataFrame, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(fp, other): a forest that joins all fingerprints linked by steps of 3 bits or fewer within a shard; fp > other."""
    some = np.array([r["fp"] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64)
    n = distinct.count()
    wanted = int(np.ceil(np.log2(max(1.0, n / shard))))
    depth = min(int(np.log2(max(1, sample // 16))), wanted)
    trees = [grow(some, m, depth) for m in HALVES]

    def f(batch: pa.RecordBatch) -> dict:
        x = batch.column(0).to_numpy().view(np.uint64)
        parts = [(2 * leaf + half, part) for half, m in enumerate(HALVES) for leaf, part in deal(x, trees[half], m)]
        if not parts:
            return {"shard": [], "fp": []}
        return {"shard": np.concatenate([np.full(len(p), k) for k, p in parts]), "fp": np.concatenate([p for _, p in parts]).view(np.int64)}

    def pairs(group: pa.Table) -> pa.Table:
        half = group.column("shard")[0].as_py() % 2
        found = search(group.column("fp").to_numpy().view(np.uint64), HALVES[half])
        least = [g.view(np.int64).min() for g in found]
        a = np.concatenate([g.view(np.int64) for g in found]) if found else np.zeros(0, np.int64)
        b = np.repeat(np.array(least, np.int64), [len(g) for g in found])
        return pa.table({"fp": a[a != b], "other": b[a != b]})

    dealt = map_batches(distinct.select("fp"), f, "shard long, fp long")
    if depth < wanted:
        dealt = deeper(table(dealt, "dealt"), shard)
    return dealt.groupBy("shard").applyInArrow(pairs, "fp long, other long").distinct()


def deeper(dealt: DataFrame, shard: int, few: int = SHARD_SAMPLE) -> DataFrame:
    """(shard, fp) with large shards dealt again, by a tree from a sample of each, until none is large that can be parted."""
    dealt = dealt.withColumn("rests", F.lit(False))
    parts = 1_000_000
    while True:
        large = table(dealt.filter("not rests").groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * shard), "large")
        if large.isEmpty():
            return dealt.drop("rests")
        some = dealt.join(broadcast_if_small(large, MOST_BROADCAST), "shard").filter(F.pmod(F.xxhash64("fp", "shard"), F.lit(parts)) < F.ceil(F.lit(parts * few) / F.col("n")))

        def tree(group: pa.Table) -> pa.Table:
            s, n = group.column("shard")[0].as_py(), group.column("n")[0].as_py()
            depth = int(np.ceil(np.log2(n / shard)))
            found = grow(np.sort(group.column("fp").to_numpy().view(np.uint64)), HALVES[s % 2], min(depth, int(np.log2(max(2, few // 16)))))
            return pa.table({"shard": pa.array([s], pa.int64()), "tree": pa.array([pickle.dumps(found)], pa.binary())})

        trees = table(some.select("shard", "fp", "n").groupBy("shard").applyInArrow(tree, "shard long, tree binary"), "trees")

        def deal_again(batch: pa.RecordBatch) -> dict:
            shards, fps, blobs = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2)
            out: list[tuple[int, np.ndarray, bool]] = []
            for s in np.unique(shards).tolist():
                at = np.flatnonzero(shards == s)
                own = pickle.loads(blobs[int(at[0])].as_py())
                for leaf, part in deal(fps[at], own, HALVES[s % 2]):  # a shard's number keeps the half as its last bit
                    name = s if isinstance(own, int) else (xxhash.xxh64_intdigest(f"{s}/{leaf}") >> 2 << 1) | (s % 2)
                    out.append((name, part, isinstance(own, int)))
            return {"shard": [k for k, p, _ in out for _ in p], "fp": np.concatenate([p for _, p, _ in out]).view(np.int64) if out else [], "rests": [r for _, p, r in out for _ in p]}

        met = dealt.join(broadcast_if_small(trees, MOST_BROADCAST), "shard", "left")
        again = map_batches(met.filter("tree is not null").select("shard", "fp", "tree"), deal_again, "shard long, fp long, rests boolean")
        dealt = table(met.filter("tree is null").select("shard", "fp", "rests").unionByName(again), "dealt")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the least fingerprint that each linked one reaches. Large and small stars in turn, until both rest."""
    now, before = table(edges.select(F.col("fp").alias("a"), F.col("other").alias("b")), "edges"), None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == before:
            return now.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        before = seen["n"], seen["s"]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = table(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")


def clusters(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """(fp, root, component_id) of every fingerprint in prints (key, fp)."""
    distinct = table(prints.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    roots = components(links(distinct))
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return table(rooted.select("fp", "root").join(ids, "root").select("fp", "root", "component_id"), "clusters")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id)."""
    prints = table(fingerprints(docs, key, text), "prints")
    found = broadcast_if_small(clusters(prints, key), MOST_BROADCAST)
    return prints.join(found, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one of each component: the one of the least id; of rows that tie on it, one."""
    prints = table(fingerprints(docs, key, text).withColumnRenamed(key, "id"), "prints")
    return keep_least(docs, prints, clusters(prints, "id").select("fp", "root"), key, text)


def ordered(docs: DataFrame, column: str) -> Column:
    """A column to put rows in order by: as text where its type has no order, as maps and variants have none."""
    kind = docs.schema[column].dataType.simpleString()
    return F.to_json(F.struct(F.col(f"`{column}`"))) if any(x in kind for x in ("map<", "variant")) else F.col(f"`{column}`")


def keep_least(docs: DataFrame, prints: DataFrame, clustered: DataFrame, key: str, text: str) -> DataFrame:
    """docs without all but the least id of each root; prints has (id, mark, fp), clustered (fp, root)."""
    named = F.struct(F.col("id").isNull().alias("unnamed"), "id", "mark")
    # What stays is found by fingerprint, of which each is there once; documents meet it in one join that may be split.
    found = clustered.join(prints.groupBy("fp").agg(F.min(named).alias("least")), "fp")
    first = found.groupBy("root").agg(F.min("least").alias("first"))
    stay = table(found.select("fp", "root").join(first, "root").select("fp", "first"), "stay")
    judged = prints.join(stay, "fp").groupBy("id", "mark").agg(F.first(named == F.col("first")).alias("stays"), F.count("*").alias("n"))
    rows = table(judged.withColumnsRenamed({"id": "__sim_id", "mark": "__sim_mark"}), "judged")
    on = F.col(key).eqNullSafe(F.col("__sim_id")) & (F.xxhash64(text) == F.col("__sim_mark"))
    gone = rows.filter("not stays").select("__sim_id", "__sim_mark")
    stays = docs.join(broadcast_if_small(gone, MOST_BROADCAST), on, "left_anti")
    again = rows.filter("stays and n > 1").select("__sim_id", "__sim_mark")
    if again.isEmpty():
        return stays
    again = broadcast_if_small(again, MOST_BROADCAST)
    tied = stays.join(again, on, "left_semi").withColumn("__sim_text", F.xxhash64(text))
    w = Window.partitionBy(key, "__sim_text").orderBy(*[ordered(docs, c) for c in docs.columns])
    tied = tied.withColumn("__sim_nth", F.row_number().over(w)).filter("__sim_nth = 1")
    return stays.join(again, on, "left_anti").unionByName(tied.select(*docs.columns))
