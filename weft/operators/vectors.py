"""Exact nearest vectors by products of blocks.

Queries are written to files of the shared folder once. A task holds some rows and meets all queries with them, block by block,
by single-precision products of unit vectors. What is within MARGIN of the k-th best there, more than the products can be wrong
by, is computed again in double precision, so results are those of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.plans.arrays import Writer, reader_of
from weft.plans.lineage import shared_path, table

#: Rows that a task holds, and of these and of queries those of a product.
HELD, SIDE, QUERIES = 400_000, 2048, 1024
MARGIN = 2e-5


def regular(rows: DataFrame, key: str, vector: str) -> int | None:
    """The length of all vectors, if keys are whole numbers and vectors finite and of one length; else None."""
    kind = rows.schema[vector].dataType.simpleString()
    if rows.schema[key].dataType.typeName() not in ("integer", "long") or kind not in ("array<float>", "array<double>"):
        return None
    v = F.col(vector)
    odd = F.coalesce(~F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < 1e15)), F.lit(True)) | F.col(key).isNull()
    low, high, bad = rows.agg(F.min(F.size(v)), F.max(F.size(v)), F.count_if(odd)).first()
    return low if low and low == high and not bad else None


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and vectors of length 1 (or 0) in single precision."""
    wide = x.astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", wide, wide))
    return length, (wide / np.where(length > 0, length, 1)[:, None]).astype(np.float32)


def least_ids(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among a query's k best: of equal vectors, the k + 1 least ids, of each k rows."""
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, group = np.unique(raw, return_inverse=True)
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    at = np.arange(len(g))
    new_group = np.concatenate(([True], g[1:] != g[:-1]))
    new_id = new_group | np.concatenate(([True], i[1:] != i[:-1]))
    nth_id = np.cumsum(new_id)
    nth_id = nth_id - np.maximum.accumulate(np.where(new_group, nth_id, 0))
    nth_row = at - np.maximum.accumulate(np.where(new_id, at, 0))
    return np.sort(order[(nth_id <= k) & (nth_row < k)])


def best(q: np.ndarray, score: np.ndarray, k: int, margin: float, *ties: np.ndarray) -> np.ndarray:
    """Of candidates, those that are within margin of their query's k-th; with ties, the first k in order."""
    order = np.lexsort((*ties, -score, q))
    ordered = q[order]
    at = np.arange(len(q))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], ordered[1:] != ordered[:-1])), at, 0)) if len(q) else at
    if ties:
        return order[at - first < k]
    kth = np.full(int(q.max(initial=0)) + 1, -np.inf)
    is_kth = at - first == k - 1
    kth[ordered[is_kth]] = score[order[is_kth]]
    return np.flatnonzero(score >= kth[q] - margin)


def met(qi: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, length: np.ndarray, unit: np.ndarray, k: int):
    """(query, neighbor, similarity): each query's k best of the rows."""
    q_length, q_unit = units(q)
    by_id = np.argsort(qi, kind="stable")
    none = np.zeros(0, np.int64)
    a, b, s, least = none, none, np.zeros(0, np.float32), np.full(len(qi), -np.inf, np.float32)
    for lo in range(0, len(ids), SIDE):
        product = q_unit @ unit[lo : lo + SIDE].T
        own = ids[lo : lo + SIDE]
        left, right = np.searchsorted(qi[by_id], own, "left"), np.searchsorted(qi[by_id], own, "right")
        for j in np.flatnonzero(right > left):
            product[by_id[left[j] : right[j]], j] = -2
        if lo == 0 and product.shape[1] > k:
            least = np.partition(product, -k, axis=1)[:, -k]
        bar = np.maximum(least - np.float32(MARGIN), np.float32(-1.5))
        some = np.flatnonzero(product.max(axis=1) >= bar)  # few, once the bars are high
        x, y = np.nonzero(product[some] >= bar[some, None])
        x = some[x]
        a, b, s = np.concatenate((a, x)), np.concatenate((b, y + lo)), np.concatenate((s, product[x, y]))
        if len(a) > 3 * k * len(qi):
            keep = best(a, s, k, MARGIN)
            a, b, s = a[keep], b[keep], s[keep]
            order = np.lexsort((-s, a))
            begin = np.searchsorted(a[order], np.arange(len(qi)))
            full = begin + k <= np.append(begin[1:], len(a))
            least[full] = np.maximum(least[full], s[order][begin[full] + k - 1])
    keep = best(a, s, k, MARGIN)
    a, b = a[keep], b[keep]
    exact = np.empty(len(a))
    for lo in range(0, len(a), 100_000):
        z = slice(lo, lo + 100_000)
        over = q_length[a[z]] * length[b[z]]
        dot = np.einsum("ij,ij->i", q[a[z]].astype(np.float64), rows[b[z]].astype(np.float64))
        exact[z] = np.round(np.where(over > 0, dot / np.where(over > 0, over, 1), 0.0), 9)
    top = best(a, exact, k, 0.0, ids[b])
    return qi[a[top]], ids[b[top]], exact[top]


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, dim: int) -> DataFrame:
    """(query, neighbor, similarity, rank) of regular rows and queries."""
    folder, wide = shared_path(rows.sparkSession, "queries"), rows.schema[vector].dataType.simpleString() == "array<double>"
    kind = np.float64 if wide else np.float32
    whole = lambda df: df.select(F.col(key).cast("long"), F.col(vector).cast("array<double>" if wide else "array<float>"))

    def held(batches, most):
        ids, found, size = [], [], 0
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            found.append(matrix(batch.column(1), dim))
            size += batch.num_rows
            if size >= most:
                yield np.concatenate(ids), np.concatenate(found)
                ids, found, size = [], [], 0
        if size:
            yield np.concatenate(ids), np.concatenate(found)

    def write(batches):
        from pyspark import TaskContext

        names = []
        for ids, x in held(batches, HELD):
            names.append(f"{TaskContext.get().partitionId()}-{len(names)}")
            out = Writer(folder, names[-1])
            out.add(0, ids=ids.view(np.uint64), vectors=x.astype(kind).ravel().view(np.uint64 if wide else np.uint32))
            out.close()
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})

    names = sorted(r["name"] for r in whole(table(queries.select(key, vector), "queries")).mapInArrow(write, "name string").collect())  # one for HELD queries

    def search(batches):
        for ids, x in held(batches, HELD):
            some = least_ids(ids, x, k)
            ids, x = ids[some], x[some]
            length, unit = units(x)
            for name in names:
                arrays = reader_of(folder, name).arrays(0)
                qi, q = arrays["ids"].view(np.int64), arrays["vectors"].view(kind).reshape(-1, dim)
                for lo in range(0, len(qi), QUERIES):
                    found = met(np.array(qi[lo : lo + QUERIES]), np.array(q[lo : lo + QUERIES]), ids, x, length, unit, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query", "neighbor", "similarity"])

    found = whole(rows).mapInArrow(search, "query long, neighbor long, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbor")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
