"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is cut into blocks by the hash of its documents' ids. A source's
target says how many of its words the mix takes: whole rounds over all its
blocks, and for the rest a run of blocks in hash order that ends inside one
block, at the document nearest the target. The drawn blocks, so many for each
source, are dealt to the output shards by a binary tree: at each node the
quotas of the sources are split between the two halves of the node's shards
by one multivariate-hypergeometric draw, so every shard gets its exact number
of blocks and every source its exact quota. The blocks of a source, in a
permuted order, then go to the shards quota after quota, and each shard
orders its documents by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import cut, tidy

#: Weights of the sources in code point order (null last), repeating; words of the mix to words there are.
WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2
#: Blocks of a source (2 to this power), blocks of a shard, seed of all draws.
BLOCK_BITS, SHARD_BLOCKS, SEED = 10, 256, 17

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def count_words(text: pa.Array, step: int = 1 << 22) -> np.ndarray:
    """Runs of characters other than blank and U+0009 to U+000D in each text (null: 0).

    Counted on the bytes of about ``step`` at a time, so that memory stays small.
    """
    text = pc.fill_null(text, "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    offsets = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)
    offsets = offsets[text.offset:text.offset + len(text) + 1].astype(np.int64)
    out = np.zeros(len(text), np.int64)
    if not len(text) or offsets[-1] == offsets[0]:
        return out
    raw = np.frombuffer(text.buffers()[2], np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + step, side="right")) - 1)
        solid = ~_SPACE[raw[offsets[a]:offsets[b]]]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        at = offsets[a:b] - offsets[a]
        at = at[at < len(solid)]
        first[at] = solid[at]
        total = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
        out[a:b] = total[offsets[a + 1:b + 1] - offsets[a]] - total[offsets[a:b] - offsets[a]]
        a = b
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("source"), pa.array(count_words(b.column("text")), pa.int64())],
            ["doc_id", "source", "size"])


def _place(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def _block(place: Column, bits: int) -> Column:
    return F.shiftright(F.conv(F.substring(place, 1, 8), 16, 10).cast("long"), 32 - bits).cast("int")


def sized(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = SEED,
          bits: int = BLOCK_BITS) -> DataFrame:
    """doc_id, source, size (words), place (hash), block: one narrow row per document."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.col(text_col).alias("text"))
    rows = rows.mapInArrow(_sizes, f"doc_id {kind}, source string, size long")
    rows = rows.withColumn("place", _place(F.col("doc_id"), seed))
    return rows.withColumn("block", _block(F.col("place"), bits))


def targets(sizes: list[tuple], weights=WEIGHTS, total: float = TOTAL, most: int = MOST) -> dict:
    """source -> target words. ``sizes``: (source, words); excess over ``most`` times a source is reshared by weight."""
    names = sorted((s for s, _ in sizes if s is not None)) + [s for s, _ in sizes if s is None]
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    size = dict(sizes)
    left, open_, out = total * sum(size.values()), list(names), {}
    while open_:
        w = sum(weigh[s] for s in open_)
        full = [s for s in open_ if left * weigh[s] / w > most * size[s]]
        if not full:
            return out | {s: left * weigh[s] / w for s in open_}
        out |= {s: float(most * size[s]) for s in full}
        left -= sum(most * size[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources) blocks: ``quotas`` dealt exactly by a tree of multivariate-hypergeometric draws."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        a, b, q = todo.pop()
        if b - a == 1:
            out[a] = q
            continue
        mid = (a + b) // 2
        take = int(q.sum()) * (mid - a) // (b - a)
        draw = np.random.default_rng([seed, a, b]).multivariate_hypergeometric(q, take, method="marginals") \
            if len(q) else q
        todo += [(a, mid, draw), (mid, b, q - draw)]
    return out


@dataclass
class Plan:
    """What a mix draws. ``sources``: one row per source; ``draws``: one row per drawn block of a source."""
    sources: DataFrame
    draws: DataFrame
    shards: int
    quotas: dict


def plan(rows: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: int = MOST, seed: int = SEED,
         shard_blocks: int = SHARD_BLOCKS) -> Plan:
    """The plan of a mix of ``rows`` (of ``sized``). The driver sees one small row for each source, no documents."""
    spark = rows.sparkSession
    blocks = cut(rows.groupBy("source", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    stats = [(r[0], int(r[1] or 0)) for r in blocks.groupBy("source").agg(F.sum("words")).collect()]
    target = targets(stats, weights, total, most)
    table = []
    for s, words in stats:
        rounds = int(min(target[s] // words, most)) if words else 0
        table.append((s, words, float(target[s]), rounds, target[s] - rounds * words))
    sources = spark.createDataFrame(table, "source string, source_size long, target double, rounds int, rest double")
    # the run of blocks for the rest: all before the border block, and part of that one
    order = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = blocks.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    known = known.join(sources, known["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    known = known.where((F.col("before") < F.col("rest")) | (F.col("rounds") > 0))
    known = known.withColumn("in_rest", F.col("before") < F.col("rest"))
    border = (known.where("in_rest").groupBy("source")
              .agg(F.max("block").alias("last"), F.max_by("before", "block").alias("gone"), F.first("rest").alias("rest")))
    inside = rows.join(border, rows["source"].eqNullSafe(border["source"]) & (rows["block"] == border["last"]))
    inside = inside.select(rows["source"], "place", "size", "gone", "rest")
    upto = Window.partitionBy("source").orderBy("place", "size")
    same = Window.partitionBy("source", "place", "size")
    edge = (inside.withColumn("upto", F.col("gone") + F.sum("size").over(upto)).withColumn("own", F.sum("size").over(same))
            .where(2 * F.col("upto") - F.col("own") <= 2 * F.col("rest"))
            .groupBy("source").agg(F.max(F.struct("place", "size")).alias("edge")))
    ends = border.join(edge, border["source"].eqNullSafe(edge["source"]), "left").select(border["source"], "last", "edge")
    ends = [(r["source"], r["last"], r["edge"]["place"] if r["edge"] else None, r["edge"]["size"] if r["edge"] else None)
            for r in ends.collect()]
    ends = {r[0]: r[1:] for r in ends}
    sources = spark.createDataFrame([(*r, *ends.get(r[0], (-1, None, None))) for r in table],
                                    "source string, source_size long, target double, rounds int, rest double, "
                                    "last int, edge_place string, edge_size long")
    # block draws: every round takes all blocks of its source, the rest a run of them
    times = F.explode(F.expr(f"filter(sequence(0, {most}), c -> c < rounds OR (c = rounds AND in_rest))"))
    drawn = cut(known.select("source", "block", times.alias("copy")), "mix-drawn")
    count = {r[0]: r[1] for r in drawn.groupBy("source").count().collect()}
    names = [s for s, *_ in table if count.get(s)]
    shards = max(1, -(-sum(count.values()) // shard_blocks))
    dealt = split_tree(np.array([count[s] for s in names], np.int64), shards, seed)
    ends_at = np.cumsum(dealt, axis=0)
    quota = spark.createDataFrame(
        [(s, k, int(ends_at[k, i] - dealt[k, i]) + 1, int(ends_at[k, i]))
         for i, s in enumerate(names) for k in range(shards) if dealt[k, i]],
        "source string, shard int, first long, final long")
    quota = quota.select("source", "shard", F.explode(F.sequence("first", "final")).alias("rank"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(
        F.xxhash64(F.lit(seed), "source", "copy", "block"), "copy", "block")).cast("long")
    drawn = drawn.withColumn("rank", rank)
    draws = (drawn.join(quota, drawn["source"].eqNullSafe(quota["source"]) & (drawn["rank"] == quota["rank"]))
             .groupBy(drawn["source"], "block").agg(F.collect_list(F.struct("copy", "shard")).alias("copies")))
    return Plan(sources, cut(draws, "mix-draws"), shards,
                {s: dealt[:, i].tolist() for i, s in enumerate(names)})


def draw(rows: DataFrame, made: Plan) -> DataFrame:
    """``rows`` (with source, block, place, size) plus source_size, target, copies [(copy, shard)]."""
    s = made.sources.withColumnRenamed("source", "_source")
    d = made.draws.select(F.col("source").alias("_of"), F.col("block").alias("_block"), F.col("copies").alias("_copies"))
    got = rows.join(s, rows["source"].eqNullSafe(s["_source"]), "left")
    got = got.join(d, got["source"].eqNullSafe(d["_of"]) & (got["block"] == d["_block"]), "left")
    # a copy of the rest takes only what lies before the edge in the last block
    whole = (F.col("block") < F.col("last")) | (
        (F.col("block") == F.col("last"))
        & F.coalesce(F.struct("place", "size") <= F.struct(F.col("edge_place"), F.col("edge_size")), F.lit(False)))
    got = got.withColumn("_whole", whole & F.coalesce(F.col("edge_place").isNotNull() | (F.col("block") < F.col("last")), F.lit(False)))
    return got.withColumn("copies", F.expr(
        "filter(coalesce(_copies, array()), c -> c.copy < rounds OR _whole)")).drop("_whole", "_copies", "_of", "_block", "_source")


def counted(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = SEED, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies: one row per input row, drawn or not.

    A null or empty text has size 0 and takes 0 words; a null source is a
    source of its own, the last; equal rows of one doc_id are drawn alike; an
    empty table gives an empty result; only the three named columns are read.
    The same input gives the same draws.
    """
    rows = cut(sized(docs, id_col, text_col, source_col, seed), "mix-sized")
    got = draw(rows, plan(rows, seed=seed, **how))
    return got.select("doc_id", "source", "size", "source_size", "target",
                      (F.col("size") * F.size("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = SEED, **how) -> DataFrame:
    """The rows of the mix: ``docs`` with each document as often as it is drawn, in shuffled shards.

    All columns as they were; the partitions of the result are the shards,
    each ordered by hash. Documents that are not drawn are not there.
    """
    rows = cut(sized(docs, id_col, text_col, source_col, seed), "mix-sized")
    made = plan(rows, seed=seed, **how)
    names = docs.columns
    own = [f"_c{i}" for i in range(len(names))]           # the caller's columns, under names that cannot clash
    at = names.index(text_col)

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(count_words(b.column(at)), pa.int64())],
                                             [*own, "size"])
    plain = docs.select(*(docs[c].alias(o) for c, o in zip(names, own)))
    kind = T.StructType([*plain.schema.fields, T.StructField("size", T.LongType())])
    kept = plain.mapInArrow(tidy(size), kind).withColumn("source", F.col(own[names.index(source_col)]).cast("string"))
    kept = kept.withColumn("place", _place(F.col(own[names.index(id_col)]), seed))
    kept = kept.withColumn("block", _block(F.col("place"), BLOCK_BITS))
    got = draw(kept, made).select(*own, "place", F.explode("copies").alias("c"))
    got = got.repartition(made.shards, "c.shard").sortWithinPartitions(
        "c.shard", F.xxhash64(F.lit(seed), "place", "c.copy"), "place", "c.copy")
    return got.select(*(F.col(o).alias(c) for c, o in zip(names, own)))
