"""Exact top-k search by inner product on a bit-sliced index.

Each dimension of a block of vectors is kept as slices: bitmaps over the rows,
one for each binary digit. A query adds the slices of its dimensions, shifted
by the digits of its own components, with carry-save adders on whole bitmaps;
the sum is again a bit-sliced number, the scores of all rows. Rows are chosen
from the most significant slice downward; the rows that tie at the border are
resolved exactly, by score and id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .grid import BATCH_ROWS, BLOCK_ROWS, finite, search

#: Components are quantised to floor(SCALE * x); rows with one beyond LARGEST (2^24) are scored apart from the index.
SCALE, LARGEST = 64, 1 << 24


def quantised(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) as doubles: from 2^52 on every double is whole (and may not fit a long)."""
    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)
    return F.transform(vec, whole)


def exact_scores(vecs: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products in Python integers, whatever their size."""
    q = [int(x) for x in query.tolist()]
    return [sum(int(x) * y for x, y in zip(v, q)) for v in vecs.tolist()]


class Slices:
    """The index of a block: for each dimension the digits of x - min and of max - x, as bitmaps over the rows."""

    def __init__(self, vecs: np.ndarray):
        self.vecs, (n, dim) = vecs, vecs.shape
        self.words = max(1, -(-n // 64))
        self.low = vecs.min(axis=0) if n else np.zeros(dim, np.int64)
        self.high = vecs.max(axis=0) if n else np.zeros(dim, np.int64)
        self.up = [self._digits(vecs[:, d] - self.low[d], int(self.high[d] - self.low[d])) for d in range(dim)]
        self.down = [self._digits(self.high[d] - vecs[:, d], int(self.high[d] - self.low[d])) for d in range(dim)]

    def bitmap(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 64, bool)
        out[:len(rows)] = rows
        return np.packbits(out, bitorder="little").view(np.uint64)

    def _digits(self, x: np.ndarray, most: int) -> list[np.ndarray]:
        return [self.bitmap((x >> j) & 1 == 1) for j in range(most.bit_length())]

    def add(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of sum |q| * (x - min or max - x): the score less a constant of the query."""
        columns: list[list[np.ndarray]] = []
        for d, q in enumerate(query.tolist()):
            digits = self.up[d] if q > 0 else self.down[d]
            q, b = abs(q), 0
            while q:
                if q & 1:
                    for j, bits in enumerate(digits):
                        while len(columns) <= b + j:
                            columns.append([])
                        columns[b + j].append(bits)
                q >>= 1
                b += 1
        out, e = [], 0
        xor, both, either = np.bitwise_xor, np.bitwise_and, np.bitwise_or
        while e < len(columns):
            col, carry = columns[e], []
            while len(col) >= 3:
                x, y, z = col.pop(), col.pop(), col.pop()
                part = xor(x, y)
                more = both(x, y)
                col.append(xor(part, z))
                both(part, z, out=part)
                either(more, part, out=more)
                carry.append(more)
                if len(col) >= 3 and len(col) % 3 == 0:
                    col.insert(0, col.pop())
            if len(col) == 2:
                x, y = col
                carry.append(both(x, y))
                col = [xor(x, y)]
            if carry:
                if e + 1 == len(columns):
                    columns.append([])
                columns[e + 1] += carry
            out.append(col[0] if col else np.zeros(self.words, np.uint64))
            e += 1
        return out

    def top(self, slices: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
        """Rows of the ``k`` largest sums among ``allowed`` (a bitmap), ties to the first rows."""
        sure, tied = np.zeros(self.words, np.uint64), allowed
        for s in reversed(slices):
            high = tied & s
            n = int(np.bitwise_count(sure).sum()) + int(np.bitwise_count(high).sum())
            if n > k:
                tied = high
            else:
                sure, tied = sure | high, tied & ~s
                if n == k:
                    tied = np.zeros_like(tied)
                    break
        rows = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
        sure = rows(sure)
        return np.concatenate([sure, rows(tied)[:k - len(sure)]]) if len(sure) < k else sure


def _cell(k: int):
    def prepare(dim: int, block: dict):
        every, whole = block["ids"], block["vecs"]
        far = (np.abs(whole) > LARGEST).any(axis=1)
        ids, vecs, far_ids, far_vecs = every[~far], whole[~far].astype(np.int64), every[far], whole[far]
        index = Slices(vecs)
        everyone = index.bitmap(np.ones(len(ids), bool))
        most = int(np.abs(vecs).max(initial=0))

        def run(batch: dict):
            out = []
            for q, query in zip(batch["ids"].tolist(), batch["vecs"]):
                found: list[tuple[int, int]] = []
                largest = int(np.abs(query).max(initial=0))
                if largest <= LARGEST and most * largest * dim < 1 << 63:
                    own = query.astype(np.int64)
                    allowed = everyone
                    at = int(np.searchsorted(ids, q))
                    if at < len(ids) and ids[at] == q:
                        me = np.zeros(len(ids), bool)
                        me[at] = True
                        allowed = everyone & ~index.bitmap(me)
                    rows = index.top(index.add(own), allowed, k)
                    if not len(far_ids):
                        out.append((np.full(len(rows), q, np.int64), ids[rows], vecs[rows] @ own))
                        continue
                    found += zip((vecs[rows] @ own).tolist(), ids[rows].tolist())
                else:
                    found += zip(exact_scores(vecs, query), ids.tolist())
                found += zip(exact_scores(far_vecs, query), far_ids.tolist())
                best = sorted(((-s, i) for s, i in found if i != q))[:k]
                if any(abs(s) >= 1 << 63 for s, _ in best):
                    raise OverflowError(f"a score of query {q} does not fit a long")
                out.append((np.full(len(best), q, np.int64), np.array([i for _, i in best], np.int64),
                            np.array([-s for s, _ in best], np.int64)))
            return tuple(np.concatenate(c) for c in zip(*out))
        return run
    return prepare


def top_k(rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE, block_rows: int = BLOCK_ROWS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest integer inner products of each query with all other rows.

    ``queries`` marks the query rows. Components count as floor(scale * x).
    Vectors that are null or hold null or non-finite components take no part.
    Rows with a component beyond 2^24 after scaling are scored in whole
    numbers of any size; a score among the best of a block that does not fit a
    long fails the query. Of an id that several rows bear, the least vector stands.
    Vectors of different lengths do not meet; fewer than ``k`` candidates are
    all returned; an empty table gives an empty result; only the two named
    columns are read.
    """
    every = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vector"),
                        queries.alias("asks")).where(F.col("vec_id").isNotNull() & finite(F.col("vector")))
    every = every.withColumn("vector", quantised(F.col("vector"), scale)).withColumn("dim", F.size("vector"))
    return search(every.drop("asks"), every.where("asks").drop("asks"), k, _cell(k), "float64", "long",
                  block_rows=block_rows, batch_rows=batch_rows)
