"""Jaccard join on word n-grams by grouped prefixes.

A document is its set of distinct shingles (``words`` words, A-Z
lower-cased), as 64-bit hashes in one global order, rarest first. Sets that
are similar enough share one of their first shingles (the prefix), at places
that leave room for the rest.

Equal sets are one vertex. Vertices of the same size and the same prefix are
one group, so candidates are found and filtered between groups: a group's
prefix is indexed once, however many members it has. The pairs of groups that
pass are expanded to their members and verified on the whole sets.

Only the components of the links are asked for, so the work goes in two
rounds. First every shared shingle links its groups to one of them, the one
where it stands foremost (of copies of a text, the text with nothing of its
own before it), and every group its members to its first one. Then exactly:
all candidates that are still in different components; those within a large
group by a second prefix, the shingles behind the first.

The order goes by a fixed number of counters over all texts; shingles that
share a counter are ordered by their hash. Any order gives the same links.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wagelens.functions.sizing import estimated_bytes

from .common import cut, doc_columns
from .neardup import components

#: Words of a shingle; links have PERCENT * union <= 100 * intersection.
WORDS, PERCENT = 5, 80
#: Counters of the order: one for each so many bytes of input, within these powers of two; their tables' rows.
BYTES_A_COUNTER, FEWEST, MOST, CHUNK = 512, 16, 24, 4_096
#: Groups up to this size are compared each with each in the second round, larger ones by a second prefix.
SMALL = 24
#: Keys of this number and below are sent to all tasks instead of shuffling what they are joined with.
FEW = 500_000
WINDOW = 4 << 20

_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a lower-cased text, window by window; no word is cut."""
    parts, a = [], 0
    while a < len(text):
        b = min(len(text), a + WINDOW)
        if b < len(text):
            m = _SPACE.search(text, b)
            b = m.start() if m else len(text)
        found = text[a:b].split()                       # bytes.split: blank, tab, line feed, 0B, 0C, return
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, found), _U, len(found)))
        a = b
    return np.concatenate(parts) if parts else np.zeros(0, _U)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of the shingles of a text, repeats included; of a shorter text its one sequence."""
    h = word_hashes(text.lower())                       # bytes.lower touches A-Z alone
    if not len(h):
        return h
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, _U(n))            # a short sequence differs from a longer one's start
        for j in range(n):
            out = out * _K + h[j:len(h) - n + 1 + j]
        return _spread(out)


def least_shared(x, y, percent: int = PERCENT):
    """The least number of shingles that sets of sizes x and y share if they are linked."""
    return -(-percent * (x + y) // (100 + percent))


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size - -(-percent * size // 100) + 1


def _slot(e: np.ndarray, slots: int) -> np.ndarray:
    return (e >> _U(64 - (slots.bit_length() - 1))).astype(np.int64)


def ordered(e: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A sorted set in the global order: by its counter's level, then by hash."""
    return e[np.argsort(levels[_slot(e, len(levels))], kind="stable")]


def _texts(batch):
    column = batch.column("text").view(pa.binary())
    return (column[i].as_py() for i in range(batch.num_rows))


def levels_of(texts: DataFrame, slots: int, words: int) -> np.ndarray:
    """How frequent the shingles of each counter are, over all texts: steps of a twelfth of a power of two, one byte each.

    Tasks send whole tables of counters, added up in two steps so that no
    group holds those of more than a 64th of the tasks.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(slots, np.int32)
        for batch in batches:
            for text in _texts(batch):
                e = shingles(text, words)
                if len(e) * 16 > slots:
                    n += np.bincount(_slot(e, slots), minlength=slots).astype(np.int32)
                else:
                    np.add.at(n, _slot(e, slots), 1)
        chunks = n.reshape(-1, min(CHUNK, slots))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(chunks), dtype=np.int32)),
             pa.array(np.full(len(chunks), TaskContext.get().partitionId() % 64, np.int32)),
             pa.array([c.tobytes() for c in chunks], pa.binary())], ["chunk", "part", "counts"])

    def add(kind):
        def run(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py(), kind).astype(np.int64) for x in table.column("counts"))
            return pa.table([table.column("chunk")[:1], pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])
        return run

    def rank(table: pa.Table) -> pa.Table:
        n = np.frombuffer(add(np.int64)(table).column("counts")[0].as_py(), np.int64)
        level = np.minimum(np.round(12 * np.log2(1.0 + n)), 255).astype(np.uint8)
        return pa.table([table.column("chunk")[:1], pa.array([level.tobytes()], pa.binary())], ["chunk", "level"])
    got = (texts.select("text").mapInArrow(count, "chunk int, part int, counts binary")
           .groupBy("chunk", "part").applyInArrow(add(np.int32), "chunk int, counts binary")
           .groupBy("chunk").applyInArrow(rank, "chunk int, level binary").toArrow())
    out = np.zeros(slots, np.uint8)
    for chunk, level in zip(got["chunk"].to_pylist(), got["level"].to_pylist()):
        out[chunk * len(level):(chunk + 1) * len(level)] = np.frombuffer(level, np.uint8)
    return out


def _flat(lists: list[np.ndarray]) -> pa.ListArray:
    at = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(lists) if lists else np.zeros(0, _U)).view(pa.int64()))


def signed(texts: DataFrame, levels, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, same, like, prefix; ``same`` tells equal sets, ``like`` equal sizes and prefixes."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            size, same, like, prefix = [], [], [], []
            for text in _texts(batch):
                e = np.unique(shingles(text, words))
                first = ordered(e, level)[:prefix_length(len(e), percent)] if len(e) else e
                size.append(len(e))
                same.append(hashlib.blake2b(e.tobytes(), digest_size=16).digest() if len(e) else None)
                like.append(hashlib.blake2b(b"%d:" % len(e) + first.tobytes(), digest_size=16).digest() if len(e) else None)
                prefix.append(first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(size, pa.int64()), pa.array(same, pa.binary()),
                 pa.array(like, pa.binary()), _flat(prefix)], ["doc_id", "text_key", "n_shingles", "same", "like", "prefix"])
    return texts.mapInArrow(run, f"doc_id {kind}, text_key binary, n_shingles long, same binary, like binary, prefix array<long>")


def _sent(keys: DataFrame) -> DataFrame:
    """Keys to be sent to all tasks where they are few, else joined by a shuffle."""
    return F.broadcast(keys) if keys.count() <= FEW else keys


def sets_of(texts: DataFrame, needed: DataFrame, repeated: bool, words: int = WORDS) -> DataFrame:
    """vertex, elements (sorted) of the vertices ``needed`` (vertex, pick: doc_id and text_key of one of its rows).

    The texts are read again and joined where they lie; only where rows of one
    id and text are ``repeated`` they are shuffled, to keep one of each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.unique(shingles(t, words)) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("vertex"), _flat(got)], ["vertex", "elements"])
    keys = needed.select("vertex", F.col("pick.doc_id").alias("_id"), F.col("pick.text_key").alias("_key"))
    on = (texts["text_key"] == F.col("_key")) & texts["doc_id"].eqNullSafe(F.col("_id"))
    chosen = texts.join(_sent(keys), on).select("vertex", "text")
    chosen = chosen.dropDuplicates(["vertex"]) if repeated else chosen
    return chosen.mapInArrow(run, "vertex long, elements array<long>")


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; joins on b first, so that a hot a is split by AQE."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("ea"), batch.column("eb")
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                both = np.sort(np.concatenate([p, q]), kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * inter >= percent * (len(both) - inter)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))
    ea = sets.select(F.col("vertex").alias("a"), F.col("elements").alias("ea"))
    eb = sets.select(F.col("vertex").alias("b"), F.col("elements").alias("eb"))
    return pairs.join(eb, "b").join(ea, "a").select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long")


def _may_link(l: str, r: str, percent: int):
    """Whether entries of one shingle leave room: ``l`` no larger than ``r``, sizes near enough, enough behind their places."""
    c = F.col
    return ((100 * c(f"{l}.size") >= percent * c(f"{r}.size"))
            & ((c(f"{l}.size") < c(f"{r}.size")) | ((c(f"{l}.size") == c(f"{r}.size")) & (c(f"{l}.gid") < c(f"{r}.gid"))))
            & ((100 + percent) * F.least(c(f"{l}.size") - c(f"{l}.at"), c(f"{r}.size") - c(f"{r}.at"))
               >= percent * (c(f"{l}.size") + c(f"{r}.size"))))


def entries_of(groups: DataFrame) -> DataFrame:
    """element, gid, size, at: every shingle of the groups' prefixes."""
    return groups.select("gid", "size", F.posexplode("prefix").alias("at", "element"))


def hub_pairs(entries: DataFrame, hubs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) groups: each shingle's groups with the one where it stands foremost."""
    l, r = entries.alias("l"), hubs.alias("r")
    swapped = _may_link("l", "r", percent) | _may_link("r", "l", percent)
    return (l.join(r, (F.col("l.element") == F.col("r.element")) & swapped)
            .select(F.least("l.gid", "r.gid").alias("a"), F.greatest("l.gid", "r.gid").alias("b")).distinct())


def open_pairs(entries: DataFrame, rooted: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(ga, ra, gb, rb): the parts (group, root) of different groups and roots whose prefixes allow a link."""
    rows = entries.join(rooted, "gid")
    mixed = (rows.groupBy("element").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("lo < hi").select("element"))
    rows = cut(rows.join(_sent(cut(mixed, "ngram-mixed")), "element", "left_semi"), "ngram-open")
    l, r = rows.alias("l"), rows.alias("r")
    return (l.join(r, (F.col("l.element") == F.col("r.element")) & (F.col("l.root") != F.col("r.root"))
                   & _may_link("l", "r", percent))
            .select(F.col("l.gid").alias("ga"), F.col("l.root").alias("ra"), F.col("r.gid").alias("gb"),
                    F.col("r.root").alias("rb")).distinct())


def second_prefix_pairs(large: DataFrame, levels, percent: int = PERCENT) -> DataFrame:
    """(a, b) of different roots within the groups of ``large`` (vertex, gid, root, size, elements).

    Members share their prefix and size, so linked ones differ in at most
    size - least_shared shingles and share one of so many and one more behind
    the prefix.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            els = batch.column("elements")
            found = []
            for i in range(batch.num_rows):
                e = ordered(els[i].values.to_numpy().view(_U), level)
                behind = prefix_length(len(e), percent)
                found.append(e[behind:behind + len(e) - least_shared(len(e), len(e), percent) + 1])
            row = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("gid").take(row), batch.column("vertex").take(row), batch.column("root").take(row),
                 pa.array(np.concatenate(found) if found else np.zeros(0, _U)).view(pa.int64())],
                ["gid", "vertex", "root", "element"])
    rows = cut(large.select("vertex", "gid", "root", "elements").mapInArrow(run, "gid long, vertex long, root long, element long"),
               "ngram-second")
    l, r, c = rows.alias("l"), rows.alias("r"), F.col
    return (l.join(r, (c("l.gid") == c("r.gid")) & (c("l.element") == c("r.element")) & (c("l.vertex") < c("r.vertex"))
                   & (c("l.root") != c("r.root")))
            .select(c("l.vertex").alias("a"), c("r.vertex").alias("b")).distinct())


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
           small: int = SMALL, slots: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the component), one row per input row.

    Linked: documents with 100 * intersection >= ``percent`` * union of their
    sets. A text without words (null, empty, blank) has an empty set and is
    linked with nothing: its component is its own id. Repeated rows share a
    component; rows of one id with different texts are documents of their
    own; a null id takes part, its component is the least id there (null
    where none has one); an empty table gives an empty one. Whole texts are
    used; only the two named columns are read, so others may clash.
    """
    spark, c = docs.sparkSession, F.col
    texts = doc_columns(docs, id_col, text_col).withColumn("text_key", F.unhex(F.md5("text")))
    if slots is None:
        slots = 1 << min(MOST, max(FEWEST, (estimated_bytes(docs) // BYTES_A_COUNTER).bit_length()))
    levels = spark.sparkContext.broadcast(levels_of(texts, slots, words))
    all_ = cut(signed(texts, levels, words, percent), "ngram-signed")
    some = all_.where("n_shingles > 0")
    # vertices: one for each set; groups: one for each size and prefix
    groups = cut(some.groupBy("like").agg(F.first("n_shingles").alias("size"), F.first("prefix").alias("prefix"))
                 .withColumn("gid", F.monotonically_increasing_id()), "ngram-groups")
    vertices = cut(some.groupBy("same").agg(F.first("like").alias("like"), F.min(F.struct("doc_id", "text_key")).alias("pick"),
                                            F.min("doc_id").alias("least")).join(groups.select("like", "gid", "size"), "like")
                   .drop("like").withColumn("vertex", F.monotonically_increasing_id()), "ngram-vertices")
    repeated = not some.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty()

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        ends = pairs.select(c("a").alias("vertex")).unionByName(pairs.select(c("b").alias("vertex"))).distinct()
        needed = cut(vertices.select("vertex", "pick").join(ends, "vertex", "left_semi"), f"{name}-needed")
        return cut(linked(pairs, cut(sets_of(texts, needed, repeated, words), f"{name}-sets"), percent), name)
    firsts = vertices.groupBy("gid").agg(F.min("vertex").alias("vertex"), F.count("*").alias("members"))
    firsts = cut(firsts, "ngram-firsts")
    # shingles that several groups begin with, and where each stands foremost
    entries = entries_of(groups)
    spot = F.shiftleft(c("at").cast("long"), 40) + c("gid")
    shared = cut(entries.groupBy("element").agg(F.min(spot).alias("spot"), F.count("*").alias("n")).where("n > 1"), "ngram-shared")
    entries = cut(entries.join(shared.select("element"), "element", "left_semi"), "ngram-entries")
    hubs = (shared.select("element", F.shiftright("spot", 40).cast("int").alias("at"), (c("spot").bitwiseAND((1 << 40) - 1)).alias("gid"))
            .join(groups.select("gid", "size"), "gid"))
    first = lambda at, to: firsts.select(c("gid").alias(at), c("vertex").alias(to))           # noqa: E731
    near = hub_pairs(entries, hubs, percent).join(first("a", "va"), "a").join(first("b", "vb"), "b").select(
        F.least("va", "vb").alias("a"), F.greatest("va", "vb").alias("b"))
    inside = (vertices.select("gid", c("vertex").alias("b")).join(firsts.where("members > 1").select("gid", c("vertex").alias("a")), "gid")
              .where("a <> b").select("a", "b"))
    near = cut(near.unionByName(inside), "ngram-hub-pairs")
    links = compared(near, "ngram-links")
    roots = components(links)
    # second round: candidates that are still apart
    touched = entries.select("gid").unionByName(firsts.where("members > 1").select("gid")).distinct()
    members = cut(vertices.select("vertex", "gid", "size", "pick").join(roots, "vertex", "left")
                  .withColumn("root", F.coalesce("root", "vertex")).join(touched, "gid", "left_semi"), "ngram-members")
    parts = members.select("gid", "root").distinct()
    apart = cut(open_pairs(entries, parts, percent), "ngram-open-pairs")
    side = lambda g, r, v: members.select(c("gid").alias(g), c("root").alias(r), c("vertex").alias(v))
    pairs = apart.join(side("ga", "ra", "a"), ["ga", "ra"]).join(side("gb", "rb", "b"), ["gb", "rb"]).select("a", "b")
    split = parts.groupBy("gid").count().where("count > 1").select("gid").join(firsts.select("gid", "members"), "gid")
    within = cut(members.join(split, "gid"), "ngram-within")
    few = within.where(c("members") <= small)
    l, r = few.alias("l"), few.alias("r")
    pairs = pairs.unionByName(l.join(r, (c("l.gid") == c("r.gid")) & (c("l.vertex") < c("r.vertex")) & (c("l.root") != c("r.root")))
                              .select(c("l.vertex").alias("a"), c("r.vertex").alias("b")))
    many = within.where(c("members") > small)
    if not many.isEmpty():
        sets = cut(sets_of(texts, many.select("vertex", "pick"), repeated, words), "ngram-many")
        pairs = pairs.unionByName(second_prefix_pairs(many.select("vertex", "gid", "root").join(sets, "vertex"), levels, percent))
    more = compared(cut(pairs.distinct(), "ngram-pairs2"), "ngram-links2")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    levels.unpersist()
    named = vertices.join(roots, "vertex", "left").select("same", "least", F.coalesce("root", "vertex").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("same", "component")
    return all_.select("doc_id", "n_shingles", "same").join(named, "same", "left").select(
        "doc_id", "n_shingles", F.when(c("n_shingles") > 0, c("component")).otherwise(c("doc_id")).cast("long").alias("component_id"))
