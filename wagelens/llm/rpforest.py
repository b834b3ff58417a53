"""Approximate nearest neighbours: a forest of random-projection trees.

The trees are fitted on a bounded sample; every vector is then led down every
tree. A query walks all trees through one priority queue, ordered by the
smallest margin met on the way, and takes leaves until they hold enough
vectors; the vectors of these leaves are ranked exactly, by cosine.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut
from .grid import BATCH_ROWS, BLOCK_ROWS, _flat, finite, search

#: Trees; vectors of the sample in a leaf; bounds of the sample (rows, bytes of doubles); share of all
#: vectors (each tree's leaves counted) that a query's leaves hold, and the least number.
TREES, LEAF, SAMPLE_ROWS, SAMPLE_BYTES, SHARE, LEAST, SEED = 32, 64, 20_000, 64 << 20, 0.6, 2_000, 11


class Forest:
    """Trees for vectors of one length: inner node i has a normal, a threshold and two children; leaf l is ~l."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        rng = np.random.default_rng([seed, sample.shape[1]])
        self.dim, self.leaves = sample.shape[1], 0
        normals, at, child = [], [], []
        self.roots = []
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)

        def grow(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                for _ in range(3):
                    a, b = rng.choice(len(rows), 2, replace=False)
                    v = unit[rows[a]] - unit[rows[b]]
                    size = np.linalg.norm(v)
                    if size < 1e-12:
                        continue
                    p = unit[rows] @ (v / size)
                    t = float(np.median(p))
                    right = p >= t
                    if right.all() or not right.any():
                        continue
                    i = len(normals)
                    normals.append(v / size)
                    at.append(t)
                    child.append(None)
                    child[i] = (grow(rows[~right]), grow(rows[right]))
                    return i
            self.leaves += 1
            return -self.leaves
        for _ in range(trees):
            self.roots.append(grow(np.arange(len(sample))))
        self.normals = np.array(normals).reshape(len(normals), self.dim)
        self.at, self.child = np.array(at), child

    def place(self, vecs: np.ndarray) -> np.ndarray:
        """(rows, trees) leaves of some vectors."""
        unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
        out = np.zeros((len(vecs), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(vecs)))]
            while todo:
                i, rows = todo.pop()
                if i < 0:
                    out[rows, t] = -i - 1
                elif len(rows):
                    right = unit[rows] @ self.normals[i] >= self.at[i]
                    todo += [(self.child[i][0], rows[~right]), (self.child[i][1], rows[right])]
        return out

    def walk(self, vecs: np.ndarray, sizes: np.ndarray, enough: float) -> list[list[int]]:
        """The leaves that each vector visits, nearest margins first, until they hold ``enough`` vectors."""
        unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
        out = []
        for row in unit:
            margin = self.normals @ row - self.at if len(self.at) else np.zeros(0)
            queue = [(-np.inf, r) for r in self.roots]
            heapq.heapify(queue)
            got, total = [], 0
            while queue and total < enough:
                p, i = heapq.heappop(queue)
                if i < 0:
                    got.append(-i - 1)
                    total += sizes[-i - 1]
                    continue
                m = margin[i]
                left, right = self.child[i]
                heapq.heappush(queue, (max(p, -m), right))
                heapq.heappush(queue, (max(p, m), left))
            out.append(got)
        return out


def fit(every: DataFrame, trees: int = TREES, leaf: int = LEAF, sample_rows: int = SAMPLE_ROWS,
        seed: int = SEED) -> dict[int, Forest]:
    """A forest for each vector length, from the first rows in hash order (bounded: rows and bytes)."""
    dims = {r[0]: r[1] for r in every.groupBy("dim").count().collect()}
    out = {}
    for dim, n in sorted(dims.items()):
        rows = min(sample_rows, max(2, SAMPLE_BYTES // (8 * max(dim, 1))))
        got = (every.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id", "vector")
               .select("vector").limit(rows).toPandas()["vector"])
        out[dim] = Forest(np.array(got.tolist(), float).reshape(len(got), dim), trees, leaf, seed)
    return out


def _exact(query: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each row computed alike."""
    dot = (vecs * query).sum(axis=1)
    return dot / (np.sqrt((vecs * vecs).sum(axis=1)) * np.sqrt((query * query).sum()))


def _cell(k: int, trees: int):
    def prepare(dim: int, block: dict):
        ids, vecs = block["ids"], block["vecs"]
        unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
        leaves = block["extra"].reshape(len(ids), trees).T
        flat = leaves.ravel()
        order = np.argsort(flat, kind="stable")
        members, count = (order % len(ids)).astype(np.int32), np.bincount(flat)
        starts = np.concatenate([[0], np.cumsum(count)])

        def run(batch: dict):
            ends = np.cumsum(batch["extra_n"])
            out = []
            for q, (own, query) in enumerate(zip(batch["ids"].tolist(), batch["vecs"])):
                visit = batch["extra"][ends[q] - batch["extra_n"][q]:ends[q]]
                visit = visit[visit < len(count)]
                seen = np.zeros(len(ids), bool)
                for l in visit.tolist():
                    seen[members[starts[l]:starts[l + 1]]] = True
                at = int(np.searchsorted(ids, own))
                if at < len(ids) and ids[at] == own:
                    seen[at] = False
                rows = np.flatnonzero(seen)
                if len(rows) > k:
                    near = unit[rows] @ (query / np.linalg.norm(query))
                    rows = rows[near >= np.partition(near, -k)[-k] - 1e-9]
                score = _exact(query, vecs[rows])
                best = np.lexsort((ids[rows], -score))[:k]
                out.append((np.full(len(best), own, np.int64), ids[rows[best]], score[best]))
            return tuple(np.concatenate(c) for c in zip(*out))
        return run
    return prepare


def nearest(rows: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            trees: int = TREES, leaf: int = LEAF, share: float = SHARE, sample_rows: int = SAMPLE_ROWS,
            block_rows: int = BLOCK_ROWS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each query row, by cosine in double precision.

    Vectors that are null, zero or hold null or non-finite components take no
    part. Of an id that several rows bear, the least vector stands. Vectors of
    different lengths do not meet; with fewer than ``k`` candidates found all
    are returned; an empty table gives an empty result; only the two named
    columns are read. Every row is in the index; only the trees' planes come
    from the sample (``sample_rows``).
    """
    every = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"),
                        queries.alias("asks")).where(F.col("vec_id").isNotNull() & finite(F.col(vec_col)))
    every = every.where(F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))
    forest = fit(every, trees, leaf, sample_rows)
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(forest)       # bounded by the sample: planes of trees * sample / leaf nodes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            extra: list = [None] * b.num_rows
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                vecs = _flat(b.column("vector").take(pa.array(at)), float, dim)
                for i, l in zip(at.tolist(), sent.value[dim].place(vecs).tolist()):
                    extra[i] = l
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(extra, pa.list_(pa.int32()))],
                                             [*b.schema.names, "extra"])
    placed = cut(every.mapInArrow(place, "vec_id long, vector array<double>, asks boolean, dim int, extra array<int>"),
                 "forest-placed")
    sizes = {dim: np.zeros(f.leaves, np.int64) for dim, f in forest.items()}
    counts = placed.select("dim", F.explode("extra").alias("l")).groupBy("dim", "l").count()
    for r in counts.collect():                        # one row for each leaf: bounded by the sample
        sizes[r["dim"]][r["l"]] = r["count"]
    total = {dim: int(s.sum()) / max(trees, 1) for dim, s in sizes.items()}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            extra: list = [None] * b.num_rows
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                vecs = _flat(b.column("vector").take(pa.array(at)), float, dim)
                paths = sent.value[dim].walk(vecs, sizes[dim], max(LEAST, share * total[dim]))
                for i, l in zip(at.tolist(), paths):
                    extra[i] = l
            yield pa.RecordBatch.from_arrays([b.column("dim"), b.column("vec_id"), b.column("vector"),
                                              pa.array(extra, pa.list_(pa.int32()))], ["dim", "vec_id", "vector", "extra"])
    asked = placed.where("asks").select("dim", "vec_id", "vector").mapInArrow(
        walk, "dim int, vec_id long, vector array<double>, extra array<int>")
    return search(placed.select("dim", "vec_id", "vector", "extra"), cut(asked, "forest-asked"), k, _cell(k, trees),
                  "float64", "double", extra=True, block_rows=block_rows, batch_rows=batch_rows)
