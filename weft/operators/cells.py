"""Large sparse matrices and graphs as cells of files, for results that are made of paths of two edges.

Such paths are far more than edges, so they are never rows of a DataFrame: nothing that a path makes is shuffled. Nodes are
dealt to blocks by a hash, entries (i, j) to cells by the blocks of both. Each entry is written once to files of the shared
folder; a task takes the rows of one block and meets the columns of all blocks in turn, each read from its cells, in pieces
of CHUNK paths. It holds two blocks and a few numbers a node at a time, whatever the number of paths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.aggregate import numbered
from weft.plans.arrays import Writer, reader_of
from weft.plans.lineage import shared_path, table

#: Entries of a block; blocks that a graph has if it has SOME entries for each; entries that a task holds when it writes.
BLOCK, LEAST, SOME, HELD = 8_000_000, 16, 250_000, 4_000_000
#: Paths of a piece, and rows of a batch.
CHUNK, BATCH = 2_000_000, 500_000
#: Whole numbers below this are their own ids; other nodes are numbered.
DIRECT = 1 << 26
LOW = (1 << 32) - 1


def block_of(x: np.ndarray, blocks: int) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks


def spans(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of weights that sum up to most, or have one."""
    total, cuts = np.cumsum(weights), [0]
    while cuts[-1] < len(weights):
        before = int(total[cuts[-1] - 1]) if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, before + most, "right"))))
    return pairwise(cuts)


def indptr_of(rows: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int64)


@dataclass
class Cells:
    """Files of entries (i, j), each below n, in order of their cell; with values, if they were given."""

    folder: str
    names: list[str]
    blocks: int
    n: int
    spark: SparkSession | None = field(repr=False)
    ids: DataFrame | None = field(repr=False)  # (node, id), where nodes were numbered
    simple: DataFrame | None = field(default=None, repr=False)  # of an undirected graph: (i, j), i < j,
    degree: DataFrame | None = field(default=None, repr=False)  # (i, j): each node's degree,
    degrees: Cells | None = field(default=None, repr=False)  # and the same as a file

    def __getstate__(self):
        return {**self.__dict__, "spark": None, "ids": None, "simple": None, "degree": None}

    def read(self, cells: np.ndarray, values: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """i << 32 | j of these cells, not in order, and the values."""
        keys, found = [], []
        for name in self.names:
            reader = reader_of(self.folder, name)
            own = reader.index[0]

            def part(of: str, lo: int, hi: int) -> np.ndarray:
                at, _, width = own[of]  # noqa: B023
                return np.frombuffer(reader.bytes(at + lo * width, (hi - lo) * width), f"u{width}")  # noqa: B023

            at = part("at", 0, self.blocks**2 + 1).astype(np.int64)
            for lo, hi in stretches(at[cells], at[cells + 1]):
                keys.append(part("i", lo, hi).astype(np.int64) << 32 | part("j", lo, hi))
                if values:
                    found.append(part("v", lo, hi).view(np.float64) if "v" in own else part("w", lo, hi).astype(np.float64))
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *keys]), np.concatenate([np.zeros(0), *found]) if values else None

    def rows(self, r: int) -> np.ndarray:
        return np.sort(self.read(r * self.blocks + np.arange(self.blocks))[0])

    def columns(self, c: int) -> np.ndarray:
        return np.sort(self.read(np.arange(self.blocks) * self.blocks + c)[0])

    def both(self, r: int) -> np.ndarray:
        """The rows of a block where entries hold both ways."""
        across, down = self.read(r * self.blocks + np.arange(self.blocks))[0], self.read(np.arange(self.blocks) * self.blocks + r)[0]
        down = down[down >> 32 != down & LOW]
        return np.unique(np.concatenate((across, swapped(down))))

    def weighted(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of a block where entries hold both ways, not in order and not yet summed, and their values; loops once."""
        (across, v), (down, w) = self.read(r * self.blocks + np.arange(self.blocks), True), self.read(np.arange(self.blocks) * self.blocks + r, True)
        other = down >> 32 != down & LOW
        return np.concatenate((across, swapped(down[other]))), np.concatenate((v, w[other]))

    def run(self, work: Callable[[Cells, int], Iterator[dict[str, np.ndarray]]], schema: str) -> DataFrame:
        """Rows that work makes of each block of rows, a task for each."""
        spark, cells = self.spark, self
        types = T._parse_datatype_string(schema)
        arrow = pa.schema([(f.name, {"bigint": pa.int64(), "double": pa.float64()}[f.dataType.simpleString()]) for f in types])

        def task(batches):
            for batch in batches:
                for r in batch.column(0).to_pylist():
                    for made in work(cells, r):
                        whole = pa.table([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)
                        yield from whole.to_batches(BATCH)

        return spark.range(0, self.blocks, 1, self.blocks).mapInArrow(task, types)

    def named(self, df: DataFrame, *columns: str) -> DataFrame:
        """df with nodes for ids."""
        if self.ids is None:
            return df
        order = df.columns
        for c in columns:
            df = df.join(self.ids.select(F.col("id").alias(c), F.col("node").alias("_node")), c).withColumn(c, F.col("_node")).drop("_node")
        return df.select(*order)


def stretches(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int]]:
    """Those that are not empty, joined where one begins at the other's end."""
    some = hi > lo
    lo, hi = lo[some], hi[some]
    new = np.concatenate(([True], lo[1:] != hi[:-1]))[: len(lo)]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(lo) - 1]))[: len(first)]
    return zip(lo[first].tolist(), hi[last].tolist(), strict=True)


def swapped(keys: np.ndarray) -> np.ndarray:
    return (keys & LOW) << 32 | keys >> 32


def coded(e: DataFrame, name: str) -> tuple[DataFrame, int, DataFrame | None]:
    """A written table's columns i and j as ids in the nodes' order, a bound of the ids, and (node, id) if they were numbered."""
    whole = all(e.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in ("i", "j"))
    if whole:
        low, high = e.agg(F.min(F.least("i", "j")), F.max(F.greatest("i", "j"))).first()
        if low is None or (low >= 0 and high < DIRECT):
            return e.withColumns({c: F.col(c).cast("long") for c in ("i", "j")}), (high or 0) + 1, None
    nodes = e.select(F.explode(F.array("i", "j")).alias("node")).distinct()
    ids = table(numbered(nodes, [F.asc("node")], "id").select("node", F.col("id").cast("long").alias("id")), f"{name}-ids")
    n = ids.count() + 1
    if n >= 1 << 31:
        raise ValueError("more nodes than 31 bits number")
    for c in ("i", "j"):
        e = e.join(ids.select(F.col("node").alias(c), F.col("id").alias("_id")), c).withColumn(c, F.col("_id")).drop("_id")
    return e, n, ids


def write(e: DataFrame, n: int, ids: DataFrame | None, name: str, blocks: int | None = None, count: int | None = None, turned=None, values: str | None = None) -> Cells:
    """Cells of (i, j) and, if it is named, a column of values; turned maps a batch's (i, j) before.

    Entries that are given several times become one, with the sum of their values, where they are held together; readers
    unite or add the rest. So edges need not be grouped before.
    """
    if blocks is None:
        count = e.count() if count is None else count
        blocks = max(-(-count // BLOCK), min(LEAST, -(-count // SOME)), 1)
    folder = shared_path(e.sparkSession, name)
    columns = ["i", "j"] + ([values] if values else [])

    def task(batches):
        from pyspark import TaskContext

        part, held, size, names = TaskContext.get().partitionId(), [], 0, []

        def flush():
            i, j = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            if turned is not None:
                i, j = turned(i, j)
            keys = i.astype(np.int64) << 32 | j.astype(np.int64)
            keys, at = np.unique(keys, return_inverse=True) if values else (np.unique(keys), None)
            i, j = keys >> 32, keys & LOW
            cell = (block_of(i, blocks) * blocks + block_of(j, blocks)).astype(np.uint16 if blocks <= 256 else np.int64)
            order = np.argsort(cell, kind="stable")
            begin = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=blocks**2))))
            arrays = {"at": begin, "i": i[order].astype(np.uint32), "j": j[order].astype(np.uint32)}
            if values:
                v = np.bincount(at, np.concatenate([x[2] for x in held]), len(keys))[order]
                small = bool(np.all((v >= 0) & (v < LOW) & (v == np.floor(v)) & ~np.signbit(v)))
                arrays |= {"w": v.astype(np.int64)} if small else {"v": v.view(np.uint64)}
            out = Writer(folder, f"{part}-{len(names)}")
            out.add(0, **arrays)
            out.close()
            names.append(f"{part}-{len(names)}")

        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(columns))])
            size += batch.num_rows
            if size >= HELD:
                flush()
                held, size = [], 0
        if size:
            flush()
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})

    names = sorted(r["name"] for r in e.select(*columns).mapInArrow(task, "name string").collect())  # one for millions of entries
    return Cells(folder, names, blocks, n, e.sparkSession, ids)


def closed(keys: np.ndarray, sought: np.ndarray, indptr: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of entries x, u (keys, in order) and each u's ends v: (place in keys, place in sought) where x, v is in sought, in order.

    Paths meet a table of hashed bits first; those that it lets through are looked up.
    """
    x, u = keys >> 32, keys & LOW
    start = indptr[u]
    n = indptr[u + 1] - start
    for lo, hi in spans(n, CHUNK):
        first, last = np.searchsorted(sought, [x[lo] << 32, (x[hi - 1] + 1) << 32])
        own, many = sought[first:last], n[lo:hi]
        end = np.cumsum(many)
        if not len(own) or not end[-1]:
            continue
        bits = min(26, (16 * len(own)).bit_length())
        shift, a, b = np.uint32(32 - bits), np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
        hashed = np.zeros(1 << bits, bool)
        hashed[((own >> 32).astype(np.uint32) * a + (own & LOW).astype(np.uint32) * b) >> shift] = True
        v = ends[np.arange(end[-1]) + np.repeat(start[lo:hi] - (end - many), many)]
        hit = np.flatnonzero(hashed[(np.repeat(x[lo:hi].astype(np.uint32) * a, many) + v * b) >> shift])
        entry = lo + np.searchsorted(end, hit, "right")
        wanted = x[entry] << 32 | v[hit]
        at = np.searchsorted(own, wanted)
        at[at == len(own)] = 0
        right = own[at] == wanted
        yield entry[right], first + at[right]


def closed_in(cells: Cells, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Triangles of some rows (keys, in order) of an oriented graph: places in keys of x, u and of x, v, where u, v is an edge."""
    of = block_of(keys & LOW, cells.blocks)
    for c in range(cells.blocks):
        columns, own = cells.columns(c), np.flatnonzero(of == c)
        if not len(columns) or not len(own):
            continue
        indptr, ends = indptr_of(columns >> 32, cells.n), (columns & LOW).astype(np.uint32)
        del columns
        for entry, at in closed(keys, keys[own], indptr, ends):
            yield entry, own[at]


def triangle_rows(cells: Cells, r: int) -> Iterator[dict[str, np.ndarray]]:
    keys = cells.rows(r)
    for p, q in closed_in(cells, keys):
        t = np.sort(np.stack((keys[p] >> 32, keys[p] & LOW, keys[q] & LOW)), axis=0)
        yield {"a": t[0], "b": t[1], "c": t[2]}


def node_counts(cells: Cells, r: int) -> Iterator[dict[str, np.ndarray]]:
    """Triangles at each node, of those that begin in a block."""
    keys, total, held, size = cells.rows(r), np.zeros(cells.n, np.int64), [], 0
    for p, q in closed_in(cells, keys):
        held += [keys[p] >> 32, keys[p] & LOW, keys[q] & LOW]
        size += 3 * len(p)
        if size > max(CHUNK, cells.n):
            total, held, size = total + np.bincount(np.concatenate(held), minlength=cells.n), [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=cells.n)
    node = np.flatnonzero(total)
    yield {"node": node, "triangles": total[node]}


def oriented_cells(edges: DataFrame, blocks: int | None = None) -> Cells:
    """Each undirected edge once, from the end of lower degree, then id: no node has more than the root of 2m followers."""
    from weft.operators.match import canonical

    e = table(canonical(edges).select(F.col("a").alias("i"), F.col("b").alias("j")), "simple")
    count = e.count()
    e, n, ids = coded(e, "simple")
    degree = e.select(F.explode(F.array("i", "j")).alias("i")).groupBy("i").agg(F.count("*").alias("j"))
    degree = table(degree, "degree")
    degrees = write(degree, n, None, "degrees", 1)

    def turned(i, j):
        d = degrees_in(degrees)
        low = (d[i] < d[j]) | ((d[i] == d[j]) & (i < j))
        return np.where(low, i, j), np.where(low, j, i)

    found = write(e, n, ids, "oriented", blocks, count, turned)
    found.simple, found.degree, found.degrees = e, degree, degrees
    return found


_degrees: dict = {}


def degrees_in(written: Cells) -> np.ndarray:
    """Of every node, 4 bytes each, kept by a worker for as long as it works on one graph."""
    if written.folder not in _degrees:
        _degrees.clear()
        keys = written.read(np.arange(1))[0]
        d = np.zeros(written.n, np.uint32)
        d[keys >> 32] = keys & LOW
        _degrees[written.folder] = d
    return _degrees[written.folder]


def triangles(edges: DataFrame, blocks: int | None = None) -> DataFrame:
    """(a, b, c), a < b < c."""
    cells = oriented_cells(edges, blocks)
    return cells.named(cells.run(triangle_rows, "a long, b long, c long"), "a", "b", "c")


def triangle_counts(edges: DataFrame, blocks: int | None = None) -> DataFrame:
    """(node, triangles) of nodes in any."""
    cells = oriented_cells(edges, blocks)
    return cells.named(counts_of(cells), "node")


def counts_of(cells: Cells) -> DataFrame:
    """(node, triangles) of an oriented graph, by id."""
    return cells.run(node_counts, "node long, triangles long").groupBy("node").agg(F.sum("triangles").alias("triangles"))


def wholes(cells: Cells, r: int) -> Iterator[dict[str, np.ndarray]]:
    yield {"n": np.array([sum(len(p) for p, _ in closed_in(cells, cells.rows(r)))], np.int64)}


def cliques(cells: Cells, r: int) -> Iterator[dict[str, np.ndarray]]:
    """Cliques of four that begin in a block: triangles among what follows a node in triangles.

    Triangles of x are edges between its entries. Rows whose triangles would be more than BLOCK are parted.
    """
    total, parts = 0, [cells.rows(r)]
    while parts:
        keys = parts.pop()
        found, size = [], 0
        for p, q in closed_in(cells, keys):
            found.append(p << 32 | q)
            size += len(p)
            if size > BLOCK and keys[0] >> 32 != keys[-1] >> 32:
                break
        else:
            edges = np.sort(np.concatenate([np.zeros(0, np.int64), *found]))
            del found
            indptr = indptr_of(edges >> 32, len(keys))
            total += sum(len(p) for p, _ in closed(edges, edges, indptr, (edges & LOW).astype(np.uint32)))
            continue
        middle = np.searchsorted(keys, (keys[len(keys) // 2] >> 32) << 32)
        middle = middle or np.searchsorted(keys, ((keys[0] >> 32) + 1) << 32)
        parts += [keys[:middle], keys[middle:]]
    yield {"n": np.array([total], np.int64)}


def paths(cells: Cells, r: int) -> Iterator[dict[str, np.ndarray]]:
    """Of an oriented graph: paths of three edges by the one in the middle, closed ones too."""
    keys, d = cells.rows(r), degrees_in(cells.degrees).astype(np.int64)
    yield {"n": np.array([((d[keys >> 32] - 1) * (d[keys & LOW] - 1)).sum()], np.int64)}


def shared(keys: np.ndarray, indptr: np.ndarray, ends: np.ndarray, names: np.ndarray, above: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of entries x, m (keys, in order) and each m's ends (places in names, in order): (x, y, paths from x to y), in order of x
    and y; if above, only of x < y."""
    x, m = keys >> 32, keys & LOW
    start = indptr[m]
    many = indptr[m + 1] - start
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))[: len(x)]
    if not len(first):
        return
    last = np.concatenate((first[1:], [len(x)]))
    own, least = x[first], np.searchsorted(names, x[first], "right") if above else np.zeros(len(first), np.int64)
    for lo, hi in spans(np.add.reduceat(many, first), CHUNK):
        a, z = first[lo], last[hi - 1]
        n = many[a:z]
        end = np.cumsum(n)
        if not end[-1]:
            continue
        kind = np.uint32 if (hi - lo) * len(names) <= LOW else np.int64
        row = np.repeat(np.arange(hi - lo), last[lo:hi] - first[lo:hi])
        key = ends[np.arange(end[-1]) + np.repeat(start[a:z] - (end - n), n)].astype(kind)
        if above:
            high = key >= np.repeat(least[lo:hi].astype(kind)[row], n)
            key = (key + np.repeat((row * len(names)).astype(kind), n))[high]
        else:
            key += np.repeat((row * len(names)).astype(kind), n)
        key.sort()
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
        if not len(new):
            continue
        key, n = key[new], np.diff(new, append=len(key))
        row = np.repeat(np.arange(hi - lo), np.diff(np.searchsorted(key, np.arange(hi - lo + 1, dtype=np.int64) * len(names))))
        yield own[lo + row], names[key - (row * len(names)).astype(kind)], n


def neighbors_met(cells: Cells, r: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, n, degree of a, degree of b), a < b, a in a block: nodes with n neighbours in common, of an undirected graph."""
    keys = cells.both(r)
    degree = np.bincount(keys >> 32, minlength=cells.n)
    for c in range(cells.blocks):
        other = keys if c == r else cells.both(c)
        names, at, degree_b = np.unique(other >> 32, return_inverse=True, return_counts=True)
        by_m = np.sort((other & LOW) << 32 | at)
        del other, at
        indptr, ends = indptr_of(by_m >> 32, cells.n), (by_m & LOW).astype(np.uint32)
        del by_m
        db = np.zeros(cells.n, np.int64)
        db[names] = degree_b
        for a, b, n in shared(keys, indptr, ends, names, True):
            yield a, b, n, degree[a], db[b]


def similar(cells: Cells, r: int) -> Iterator[dict[str, np.ndarray]]:
    for a, b, n, da, db in neighbors_met(cells, r):
        yield {"a": a, "b": b, "similarity": n / (da + db - n)}


def similar_rows(cells: Cells, r: int) -> Iterator[dict[str, np.ndarray]]:
    count, most, total = np.zeros(cells.n, np.int64), np.zeros(cells.n), np.zeros(cells.n)
    for a, _, n, da, db in neighbors_met(cells, r):
        s = n / (da + db - n)
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        own = a[first]
        count[own] += np.diff(first, append=len(a))
        most[own] = np.maximum(most[own], np.maximum.reduceat(s, first))
        total[own] += np.add.reduceat(s, first)
    a = np.flatnonzero(count)
    yield {"a": a, "n": count[a], "most": most[a], "total": total[a]}


def quads(cells: Cells, r: int) -> Iterator[dict[str, np.ndarray]]:
    """Sums over pairs of nodes with n common neighbours: n (n - 1) / 2 of all, and of edges; and n (degree - 2) of edges, of both ends."""
    every, edges, paws = 0, 0, 0
    keys = cells.both(r)
    for a, b, n, da, db in neighbors_met(cells, r):
        two = n > 1
        every += int((n[two] * (n[two] - 1) // 2).sum())
        pair = a << 32 | b
        lo, hi = np.searchsorted(keys, [a[0] << 32, (a[-1] + 1) << 32])
        at = np.searchsorted(pair, keys[lo:hi])  # fewer than pairs
        at[at == len(pair)] = 0
        at = at[pair[at] == keys[lo:hi]]
        n = n[at]
        edges += int((n * (n - 1) // 2).sum())
        paws += int((n * (da[at] + db[at] - 4)).sum())
    yield {"every": np.array([every]), "edges": np.array([edges]), "paws": np.array([paws])}


def undirected_cells(edges: DataFrame, blocks: int | None = None) -> Cells:
    """Each undirected edge, loops too; edges given several times are united in tasks, so they are not shuffled."""
    e = edges.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).filter("src is not null and dst is not null")
    e, n, ids = coded(table(e, "undirected"), "undirected")
    return write(e, n, ids, "both", blocks)


def structural_similarity(edges: DataFrame, blocks: int | None = None) -> DataFrame:
    """(a, b, similarity): Jaccard over neighbours, of nodes a < b that share one."""
    cells = undirected_cells(edges, blocks)
    return cells.named(cells.run(similar, "a long, b long, similarity double"), "a", "b")


def similarity_rows(edges: DataFrame, blocks: int | None = None) -> DataFrame:
    """(a, n, most, total): of all rows of structural_similarity, how many there are of each a, the greatest, and the sum."""
    cells = undirected_cells(edges, blocks)
    return cells.named(cells.run(similar_rows, "a long, n long, most double, total double"), "a")


def product_rows(a: DataFrame, b: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """(i, n, total): of each row of the product of two sparse matrices (i, j, value; b: a itself), entries and their sum."""
    joined = a.withColumn("_of", F.lit(0))
    joined = table(joined if b is None else joined.unionByName(b.withColumn("_of", F.lit(1))), "matrices")
    e, n, ids = coded(joined, "matrices")
    left = write(e.filter("_of = 0"), n, ids, "left", blocks, values="value")
    right = left if b is None else write(e.filter("_of = 1"), n, None, "right", left.blocks, values="value")

    def work(cells: Cells, r: int) -> Iterator[dict[str, np.ndarray]]:
        keys, value = cells.read(r * cells.blocks + np.arange(cells.blocks), True)
        order = np.argsort(keys)
        keys, value = keys[order], value[order]
        count, total = np.zeros(cells.n, np.int64), np.zeros(cells.n)
        for c in range(cells.blocks):
            met, own = right.read(np.arange(cells.blocks) * cells.blocks + c, True)
            total += np.bincount(keys >> 32, value * np.bincount(met >> 32, own, cells.n)[keys & LOW], cells.n)
            names, at = np.unique(met & LOW, return_inverse=True)
            by_k = np.sort((met >> 32) << 32 | at)
            del met, own, at
            for x, _, _ in shared(keys, indptr_of(by_k >> 32, cells.n), (by_k & LOW).astype(np.uint32), names, False):
                first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
                count[x[first]] += np.diff(first, append=len(x))
        i = np.flatnonzero(count)
        yield {"i": i, "n": count[i], "total": total[i]}

    return left.named(left.run(work, "i long, n long, total double"), "i")


_kept: dict = {}


def node_values(written: Cells, name: str, weights: bool = False) -> np.ndarray:
    """A number of every node, kept by a worker until another of this name is asked for: values, or else the entries' j."""
    if _kept.get(name, (None,))[0] != written.folder:
        keys, v = written.read(np.arange(1), weights)
        x = np.zeros(written.n, np.float64 if weights else np.uint32)
        x[keys >> 32] = v if weights else keys & LOW
        _kept[name] = written.folder, x
    return _kept[name][1]


def strengths(cells: Cells, r: int) -> Iterator[dict[str, np.ndarray]]:
    """The sum of the values at each node of a block, loops twice."""
    keys, v = cells.weighted(r)
    i, loop = keys >> 32, keys >> 32 == keys & LOW
    node = np.unique(i)
    yield {"i": node, "j": np.zeros(len(node), np.int64), "value": np.bincount(i, np.where(loop, 2 * v, v), cells.n)[node]}


def best_moves(cells: Cells, at: Cells, strength: Cells, total: float, resolution: float) -> Callable[[Cells, int], Iterator[dict[str, np.ndarray]]]:
    """Nodes of a block that gain by another community, ties to the least one; and, as node -1, what modularity is made of."""

    def work(cells: Cells, r: int) -> Iterator[dict[str, np.ndarray]]:
        own, k = node_values(at, "at"), node_values(strength, "strength", True)
        sums = np.bincount(own, k, cells.n)
        keys, v = cells.weighted(r)
        loop = keys >> 32 == keys & LOW
        inside, keys, v = float(v[loop].sum()), keys[~loop], v[~loop]
        key = keys >> 32 << 32 | own[keys & LOW]
        del keys
        order = np.argsort(key)
        key, v = key[order], v[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
        squares = np.array([float((sums**2).sum()) if r == 0 else 0.0])
        if not len(first):
            yield {"node": np.array([-1]), "to": np.array([-1]), "inside": np.array([inside]), "squares": squares}
            return
        into, key = np.add.reduceat(v, first), key[first]
        u, c = key >> 32, key & LOW
        home = c == own[u]
        inside += float(into[home].sum()) / 2
        gain = np.round(into - resolution * k[u] * (sums[c] - np.where(home, k[u], 0.0)) / (2 * total), 9)
        start = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
        node, many = u[start], np.diff(start, append=len(u))
        best = np.maximum.reduceat(gain, start)
        to = np.minimum.reduceat(np.where(gain == np.repeat(best, many), c, LOW), start)
        # A node that has no neighbour in its own community may stay there alone.
        kn, mine = k[node], own[node].astype(np.int64)
        stay = np.round(-resolution * kn * (sums[mine] - kn) / (2 * total), 9)
        alone = ~np.logical_or.reduceat(home, start)
        to = np.where(alone & ((stay > best) | ((stay == best) & (mine < to))), mine, to)
        moved = to != mine
        node, to = np.concatenate(([-1], node[moved])), np.concatenate(([-1], to[moved]))
        none = np.zeros(len(node) - 1)
        yield {"node": node, "to": to, "inside": np.concatenate(([inside], none)), "squares": np.concatenate((squares, none))}

    return work


def contracted(at: Cells) -> Callable[[Cells, int], Iterator[dict[str, np.ndarray]]]:
    """Entries of a block between communities in place of nodes, the lesser first."""

    def work(cells: Cells, r: int) -> Iterator[dict[str, np.ndarray]]:
        own = node_values(at, "at")
        keys, v = cells.read(r * cells.blocks + np.arange(cells.blocks), True)
        a, b = own[keys >> 32].astype(np.int64), own[keys & LOW].astype(np.int64)
        key, where = np.unique(np.minimum(a, b) << 32 | np.maximum(a, b), return_inverse=True)
        yield {"i": key >> 32, "j": key & LOW, "value": np.bincount(where, v, len(key))}

    return work


def communities(edges: DataFrame, rounds: int, levels: int, resolution: float, blocks: int | None = None) -> DataFrame:
    """(node, community) of (src, dst, w): see analytics.louvain. Only nodes and moves are rows of a DataFrame."""
    e = edges.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("value"))
    e, kind = table(e.filter("i is not null"), "louvain"), edges.schema["src"].dataType
    e, n, ids = coded(e, "louvain")
    cells = write(e, n, ids, "louvain", blocks, values="value")
    found = names = None
    for _ in range(levels):
        k = table(cells.run(strengths, "i long, j long, value double"), "strength")
        strength, total = write(k, n, None, "strength", 1, values="value"), (k.agg(F.sum("value")).first()[0] or 0.0) / 2 or 1.0
        if names is None:
            names = k.select("i", F.col("i").cast(kind).alias("node")) if ids is None else k.select("i").join(ids.select(F.col("id").alias("i"), "node"), "i")
            names = table(names, "louvain-names")
        at, best, moves, kept = None, None, None, None
        for step in range(rounds + 1):
            if moves is None:
                new = k.select("i", F.col("i").alias("j"))
            else:
                side = names.filter(F.pmod(F.xxhash64("node", F.lit(step - 1)), F.lit(2)) == 0).select("i")
                new = at.join(moves.join(side, "i"), "i", "left").select("i", F.coalesce("to", "j").alias("j"))
            new = table(new, "moves")
            written = write(new, n, None, "moves", 1)
            made = table(cells.run(best_moves(cells, written, strength, total, resolution), "node long, to long, inside double, squares double"), "best-moves")
            inside, squares = made.filter("node = -1").agg(F.sum("inside"), F.sum("squares")).first()
            q = inside / total - resolution * squares / (4 * total * total)
            if best is None or q > best + 1e-9:
                at, best, kept, moves = new, q, written, made.filter("node >= 0").select(F.col("node").alias("i"), "to")
            elif step > 1:
                break
        found = at if found is None else table(found.withColumnRenamed("j", "_at").join(at.withColumnRenamed("i", "_at"), "_at").select("i", "j"), "louvain")
        if at.filter("i != j").isEmpty():
            break
        cells = write(cells.run(contracted(kept), "i long, j long, value double"), n, None, "louvain", cells.blocks, values="value")
    of = names.select(F.col("i").alias("j"), F.col("node").alias("community"))
    return found.join(names, "i").join(of, "j").select("node", "community")
