"""A stated query set against all vectors, in blocks.

Candidates are dealt into blocks of a bounded number of rows and bytes,
queries into groups, and every (block, group) cell is one task: equal pieces
of work, whose results are merged by a window over at most ``k`` rows of each
cell. Vectors are shuffled as rows, never as packs: a cell's candidates come
first and are kept, its queries follow and pass by in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import tidy

#: Rows and bytes (as doubles) of a block; about the least and the most queries of a group; cells wanted for each core.
BLOCK_ROWS, BLOCK_BYTES, BATCH_ROWS, GROUP_ROWS, CELLS_A_CORE = 32_768, 64 << 20, 512, 16_384, 8


def finite(vec: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    return F.coalesce(vec.isNotNull() & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def _flat(column, kind, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _first(ids: np.ndarray, before: int | None) -> np.ndarray:
    """Marks the first row of each id; ids are sorted and follow on ``before``."""
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    first[0] = before is None or int(ids[0]) != before
    return first


def _vectors(rows: pa.RecordBatch, dim: int, kind: str, extra: bool, before: int | None) -> dict:
    """The rows as arrays: ids, vecs[, extra, extra_n]; of an id that several rows bear, the first one."""
    ids = rows.column("vec_id").to_numpy()
    first = _first(ids, before)
    out = {"ids": ids[first], "vecs": _flat(rows.column("vector"), kind, dim)[first]}
    if extra:
        more = rows.column("extra").filter(pa.array(first))
        out["extra"] = more.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        out["extra_n"] = np.diff(np.asarray(more.offsets)).astype(np.int32)
    return out


def _walk(cell: Callable, kind: str, extra: bool):
    """Over rows sorted by (cell, side, vec_id, vector): what ``cell`` finds in each block for each batch of its queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, find, last = None, [], None, None
        for batch in batches:
            place = 2 * batch.column("cell").to_numpy().astype(np.int64) + batch.column("side").to_numpy()
            ends = [*(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)] if len(place) else []
            begin = 0
            for end in ends:
                rows, at, begin = batch.slice(begin, end - begin), int(place[begin]), end
                if now != at:
                    if now is None or now // 2 != at // 2:
                        parts, find = [], None
                    now, last = at, None
                dim = rows.column("dim")[0].as_py()
                got = _vectors(rows, dim, kind, extra, last)
                last = rows.column("vec_id")[-1].as_py()
                if not len(got["ids"]):
                    continue
                if at % 2 == 0:
                    parts.append(got)
                    continue
                if find is None and parts:
                    block = {c: np.concatenate([x[c] for x in parts]) for c in got}
                    parts = []
                    find = cell(dim, block)
                if find is not None:
                    a, b, s = find(got)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s)],
                                                     ["query_id", "vec_id", "score"])
    return run


def search(candidates: DataFrame, queries: DataFrame, k: int, cell: Callable, kind: str, score: str,
           extra: bool = False, block_rows: int = BLOCK_ROWS, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of each query, ties to the smaller vec_id.

    ``cell(dim, block)`` gives a function that returns (query ids, vec_ids,
    scores) arrays for a batch of queries; block and batch are dicts of
    arrays, the block's ids ascending. Only vectors of the same length meet.
    A candidate is sent once to each group of queries, a query once to each
    block.
    """
    spark = candidates.sparkSession
    count = lambda df: {r[0]: r[1] for r in df.groupBy("dim").count().collect()}
    n, q = count(candidates), count(queries)
    blocks = {d: -(-c // max(1, min(block_rows, BLOCK_BYTES // (8 * max(d, 1))))) for d, c in n.items() if d in q}
    if not blocks:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score}")
    wanted = -(-CELLS_A_CORE * spark.sparkContext.defaultParallelism // sum(blocks.values()))
    groups = {d: min(-(-q[d] // batch_rows), max(-(-q[d] // GROUP_ROWS), wanted)) for d in blocks}
    begins, cells = {}, 0
    for d in blocks:
        begins[d], cells = cells, cells + blocks[d] * groups[d]
    of = lambda x: F.create_map(*(F.lit(v) for kv in x.items() for v in kv))[F.col("dim")]
    dealt = lambda x: F.pmod(F.xxhash64("vec_id"), of(x)).cast("int")
    every = lambda x: F.explode(F.sequence(F.lit(0), of(x) - 1))

    def placed(rows: DataFrame, side: int, block: Column, group: Column) -> DataFrame:
        rows = rows.where(F.col("dim").isin(*blocks)).withColumn("block", block).withColumn("group", group)
        return rows.select((of(begins) + F.col("block") * of(groups) + F.col("group")).cast("int").alias("cell"),
                           F.lit(side).alias("side"), "dim", "vec_id", "vector", *["extra"] * extra)
    rows = placed(candidates, 0, dealt(blocks), every(groups)).unionAll(placed(queries, 1, every(blocks), dealt(groups)))
    rows = rows.repartitionById(cells, "cell").sortWithinPartitions("cell", "side", "vec_id", "vector")
    best = rows.mapInArrow(tidy(_walk(cell, kind, extra)), f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
