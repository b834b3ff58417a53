"""Near duplicates by DartMinHash signatures and banded joining.

A document is a weighted set: its shingles of five words with their counts.
Darts are thrown by hash: the weight axis of an element is cut in cells of one
unit, the rank axis in levels, and each (cell, level) gets a Poisson number of
darts with a coordinate, a weight and a rank of their own. A dart hits when it
lies under the element's weight; of each coordinate the hit of lowest rank is
kept. Two documents agree on a coordinate with the probability of their
weighted Jaccard similarity, and a signature costs about as many darts as
k log k plus the size of the set.

Equal texts are one vertex throughout. Documents that share a band are
compared with the band's first document; where a bucket holds several
components after that, its members are compared with one another, in small
buckets each with each, those of large ones by an exact prefix-filter join on
their rarest shingles. Every link is verified on the shingles themselves, and
the links' components are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, doc_columns, tidy

#: Words of a shingle, least weighted Jaccard similarity of a link.
WORDS, SIMILAR = 5, 0.8
#: Coordinates of a band, bands: a pair at 0.8 is missed by all with probability (1 - 0.8^6)^42 = 3e-6.
ROWS, BANDS = 6, 42
#: Buckets up to this size are compared each with each in the second round; members of larger ones by their rarest shingles.
SMALL = 24
#: Counters of the shingles' frequencies (a power of two), documents of a block of a hot shingle.
COUNTERS, HOT_BLOCK = 1 << 20, 4_096
#: Binary digits of the counters of a chunk, which travel in one row; what is told of a counter.
CHUNK_BITS, _FIGURES = 12, ("n", "lo", "hi")

_U = np.uint64
GOLD, M1, M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
#: Poisson(1): probability of at most 0, 1, ... darts.
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, n + 1)) for n in range(12)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash (splitmix finaliser), wrapping."""
    with np.errstate(over="ignore"):
        x = x + GOLD
        x = (x ^ (x >> _U(30))) * M1
        x = (x ^ (x >> _U(27))) * M2
        return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0 ** -53


def shingles(words: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, element, weight) of the documents whose word hashes lie between ``offsets``.

    A document of fewer than ``n`` words is one shingle of all its words; one
    without words has none. Weight: how often the shingle occurs.
    """
    words = words.astype(_U)
    size = np.diff(offsets)
    base = mix(words)
    with np.errstate(over="ignore"):
        total = np.zeros(max(len(words), 1), _U)[:len(words)]
        for j in range(n):
            part = np.zeros(len(words), _U)
            part[:max(len(words) - j, 0)] = base[j:]
            if j:
                # words beyond the end of a document take no part
                end = np.repeat(offsets[1:], size)
                inside = np.arange(len(words)) + j < end
                part = np.where(inside, part, _U(0))
            total = mix(total * _U(31) + part + _U(j + 1))
    owner = np.repeat(np.arange(len(size)), size)
    first = np.arange(len(words)) - np.repeat(offsets[:-1], size)
    keep = first <= np.repeat(np.maximum(size - n, 0), size)
    owner, total = owner[keep], total[keep]
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (total[1:] != total[:-1])
    at = np.flatnonzero(new)
    return owner[at], total[at], np.diff(np.append(at, len(owner))).astype(np.float64)


def darts(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray,
          k: int, seed: int = 1):
    """(owner, coordinate, rank, dart) of the darts that hit with rank in [low, high) of their document.

    Which darts there are depends on the element, the cell and the level
    alone, so documents that share an element share its darts.
    """
    cells = np.ceil(weight).astype(np.int64)
    e = np.repeat(np.arange(len(element)), cells)
    cell = np.arange(len(e)) - np.repeat(np.cumsum(cells) - cells, cells)
    first, last = np.floor(low[owner[e]]).astype(np.int64), np.ceil(high[owner[e]]).astype(np.int64)
    levels = np.maximum(last - first, 0)
    p = np.repeat(np.arange(len(e)), levels)
    level = first[p] + np.arange(len(p)) - np.repeat(np.cumsum(levels) - levels, levels)
    with np.errstate(over="ignore"):
        h = mix(mix(mix(element[e] ^ _U(seed)) + cell.astype(_U))[p] + level.astype(_U) * GOLD)
        n = np.searchsorted(_POISSON, unit(h), side="right")
        d = np.repeat(np.arange(len(p)), n)
        number = (np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)).astype(_U)
        dart = mix(h[d] + (number + _U(1)) * M2)
    own = owner[e[p[d]]]
    rank = level[d] + unit(dart)
    place = mix(dart)
    hit = (rank < high[own]) & (rank >= low[own])
    fraction = weight[e[p[d]]] - cell[p[d]]
    part = fraction < 1.0
    if part.any():
        hit &= ~part | (unit(mix(place ^ M1)) < fraction)
    own, rank, dart, place = own[hit], rank[hit], dart[hit], place[hit]
    return own, (place % _U(k)).astype(np.int64), rank, dart


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int, seed: int = 1):
    """(docs, k) of darts: the lowest-ranked hit of every coordinate; documents without elements keep zeros."""
    out = np.zeros((docs, k), _U)
    total = np.bincount(owner, weights=weight, minlength=docs)
    todo = total > 0
    low = np.zeros(docs)
    high = np.where(todo, k * (np.log(k) + 2.0) / np.maximum(total, 1e-12), 0.0)
    best = np.full(docs * k, np.inf)
    flat = out.reshape(-1)
    while todo.any():
        use = todo[owner]
        own, at, rank, dart = darts(owner[use], element[use], weight[use], low, high, k, seed)
        key = own * k + at
        was = best.copy() if len(key) else best
        np.minimum.at(best, key, rank)
        win = (rank == best[key]) & (rank < was[key])
        flat[key[win]] = dart[win]
        empty = np.isinf(best.reshape(docs, k)).any(axis=1)
        todo &= empty
        low, high = high, high * 2.0          # throw on, beyond what was thrown
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(docs, bands) hashes of the bands, the band's number included."""
    bands = sig.shape[1] // rows
    out = np.zeros((len(sig), bands), _U)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(sig), mix(np.array([b], _U))[0])
            for r in range(rows):
                h = mix(h ^ sig[:, b * rows + r])
            out[:, b] = h
    return out.view(np.int64)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    return values[offsets[0]:offsets[-1]].view(np.int64), offsets - offsets[0]


def _parts(offsets: np.ndarray, each: int = 0, most: int = 400_000):
    """Ranges of documents of about ``most`` words and darts, to bound the memory of a step."""
    cost = offsets + each * np.arange(len(offsets))
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(cost, cost[a] + most, side="right")) - 1)
        yield a, b
        a = b


def _sign(k: int, rows: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch.column("words"))
            for a, b in _parts(offsets, int(k * (np.log(k) + 2))):
                own, el, w = shingles(values[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], words)
                keys = band_keys(signatures(own, el, w, b - a, k), rows)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * keys.shape[1]),
                                                pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("vertex")[a:b], flat], ["vertex", "bands"])
    return run


def _elements(words: int):
    """Each document's shingles as sorted 32-bit hashes, one for each count, for the exact comparison."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch.column("words"))
            for a, b in _parts(offsets):
                own, el, w = shingles(values[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], words)
                n = w.astype(np.int64)
                with np.errstate(over="ignore"):
                    rep = np.repeat(np.arange(len(el)), n)
                    nth = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
                    h = (mix(el[rep] + nth.astype(_U) * GOLD) >> _U(32)).astype(np.uint32)
                order = np.lexsort((h, own[rep]))
                cuts = np.searchsorted(own[rep], np.arange(b - a + 1)).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(cuts), pa.array(h[order].view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("vertex")[a:b], flat], ["vertex", "elements"])
    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted lists without repeats (counts are in the hashes): shared over all."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same) if len(both) else 0.0


def _verify(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, xo = _lists32(batch.column("ea"))
            y, yo = _lists32(batch.column("eb"))
            sim = np.array([jaccard(x[xo[i]:xo[i + 1]], y[yo[i]:yo[i + 1]]) for i in range(batch.num_rows)])
            ok = pa.array(sim >= similar, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim, pa.float64())],
                                             ["a", "b", "similarity"]).filter(ok)
    return run


def _lists32(column) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    return values[offsets[0]:offsets[-1]], offsets - offsets[0]


def _words(text):
    """Hashes of the words of a text, lower case."""
    return F.transform(F.filter(F.split(F.lower(text), r"[\s]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def verified(pairs: DataFrame, elements: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """a, b, similarity of the pairs that are similar enough; joins on b first, so that a hot a is split by AQE."""
    ea = elements.select(F.col("vertex").alias("a"), F.col("elements").alias("ea"))
    eb = elements.select(F.col("vertex").alias("b"), F.col("elements").alias("eb"))
    # the sizes alone rule out many pairs
    both = pairs.join(eb, "b").join(ea, "a")
    small, large = F.least(F.size("ea"), F.size("eb")), F.greatest(F.size("ea"), F.size("eb"))
    return both.where(small >= similar * large).mapInArrow(_verify(similar), "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """vertex, root: the least vertex of each component of ``links`` (a, b); vertices without a link are not there.

    Rounds of the least neighbour's root with pointer jumping, the tables
    written to the shared folder between rounds; a hub's neighbours meet only
    in partial minima. Every round but the last lowers some root, so it ends.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                "cc-edges")
    root = cut(edges.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("m"))
               .select("vertex", F.least("vertex", "m").alias("root")), "cc-root")
    while True:
        jump = root.select(F.col("vertex").alias("root"), F.col("root").alias("up"))
        jumped = root.join(jump, "root").select("vertex", F.col("up").alias("root"))
        near = (edges.join(jumped.select(F.col("vertex").alias("b"), "root"), "b")
                .groupBy(F.col("a").alias("vertex")).agg(F.min("root").alias("near")))
        new = cut(jumped.join(near, "vertex", "left").select(
            "vertex", F.least("root", F.coalesce("near", "root")).alias("root")), "cc-root")
        was, now = (t.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0] for t in (root, new))
        root = new
        if was == now:
            return root


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, bands: int = BANDS,
           words: int = WORDS) -> DataFrame:
    """doc_id, text_key, bands: the band hashes of every document; text_key is null where it has no words."""
    kind = docs.schema[id_col].dataType.simpleString()
    each = doc_columns(docs, id_col, text_col).select(
        "doc_id", F.md5("text").alias("text_key"), _words(F.col("text")).alias("words")).withColumn(
        "text_key", F.when(F.size("words") > 0, F.col("text_key")))
    sign = _sign(rows * bands, rows, words)

    def run(batches):
        for batch in batches:
            at = 0
            for part in sign(iter([pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("words")], ["vertex", "words"])])):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), batch.column("text_key")[at:at + part.num_rows], part.column(1)],
                    ["doc_id", "text_key", "bands"])
                at += part.num_rows
    return each.mapInArrow(tidy(run), f"doc_id {kind}, text_key string, bands array<long>")


def hub_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b): the members of each bucket with its least vertex."""
    return buckets.where("vertex <> hub").select(F.col("hub").alias("a"), F.col("vertex").alias("b")).distinct()


def with_hub(buckets: DataFrame) -> DataFrame:
    """Buckets (key, vertex, ...) of two members or more, with their least vertex and their size."""
    hubs = buckets.groupBy("key").agg(F.min("vertex").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return buckets.join(hubs, "key")


def open_buckets(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The buckets whose members lie in several components, with each member's root."""
    known = buckets.join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    known = cut(known, "dup-rooted")
    mixed = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return known.join(mixed, "key", "left_semi")


def each_with_each(buckets: DataFrame) -> DataFrame:
    """(a, b) of different components in buckets of a bounded size."""
    l, r = buckets.select("key", "vertex", "root").alias("l"), buckets.select("key", "vertex", "root").alias("r")
    return (l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.vertex") < F.col("r.vertex"))
                   & (F.col("l.root") != F.col("r.root")))
            .select(F.col("l.vertex").alias("a"), F.col("r.vertex").alias("b")).distinct())


def _slots(elements: np.ndarray) -> np.ndarray:
    return elements.view(np.uint32) >> np.uint32(32 - (COUNTERS.bit_length() - 1))


def _told(slots: np.ndarray, *counts: np.ndarray) -> pa.RecordBatch:
    """One row a chunk of counters: the counters (sorted) and what is known of each, as lists."""
    chunk, at = np.unique(slots >> CHUNK_BITS, return_index=True)
    ends = pa.array(np.append(at, len(slots)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk), *(pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (slots, *counts))],
        ["chunk", "slot", *_FIGURES[:len(counts)]])


def _added(table: pa.Table, figures: int) -> list[np.ndarray]:
    """The counters of a chunk from all tasks, each once: numbers added, least and greatest roots."""
    cols = [np.concatenate([x.values.to_numpy() for x in table.column(c)]) for c in ("slot", *_FIGURES[:figures])]
    order = np.argsort(cols[0], kind="stable")
    slots = cols[0][order]
    first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1]))
    how = (np.add, np.minimum, np.maximum)
    return [slots[first], *(f.reduceat(x[order], first) for f, x in zip(how, cols[1:]))]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many elements of a task fall on each counter."""
    n = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        values, _ = _lists32(batch.column("elements"))
        n += np.bincount(_slots(values), minlength=COUNTERS)
    at = np.flatnonzero(n)
    if len(at):
        yield _told(at, n[at])


def _all_frequencies(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_told(*_added(table, 1))])


def _open_leads(table: pa.Table) -> pa.Table:
    """Of the counters that lead anywhere and hold several roots, how often they lead."""
    slots, n, lo, hi = _added(table, 3)
    keep = (n > 0) & (lo < hi)
    return pa.Table.from_batches([_told(slots[keep], n[keep])])


def _rarest(batch: pa.RecordBatch, n: np.ndarray, similar: float, m: np.ndarray | None = None):
    """(row, element, place, size, lead) of the rarest elements of a batch's vertices, as many as can hold the first one
    shared with a similar vertex; with ``m`` only those of counters that have any there.

    ``lead``: the element can be the first shared one also with a vertex that
    is no smaller; of a pair's first shared element the smaller vertex leads.
    """
    values, offsets = _lists32(batch.column("elements"))
    found, at, sizes = [], [], np.diff(offsets)
    for i in range(batch.num_rows):
        own = values[offsets[i]:offsets[i + 1]]
        order = np.lexsort((own, n[_slots(own)]))[:len(own) - int(np.ceil(similar * len(own) - 1e-9)) + 1]
        place = np.arange(len(order))
        if m is not None:
            place = place[m[_slots(own[order])] > 0]
        found.append(own[order[place]])
        at.append(place)
    row = np.repeat(np.arange(batch.num_rows), [len(x) for x in at])
    el, at = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (found, at))
    size = sizes[row]
    return row, el, at, size, at <= size - np.ceil(2 * similar / (1 + similar) * size - 1e-9)


def _leads(counts, similar: float, most: int = 1_000_000):
    """How many rarest elements lead on each counter, and the range of their roots; added up in the task."""
    def told(slot, lead, root) -> pa.RecordBatch:
        slot, lead, root = map(np.concatenate, (slot, lead, root))
        order = np.argsort(slot, kind="stable")
        slot, lead, root = slot[order], lead[order], root[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        return _told(slot[first], np.add.reduceat(lead, first), np.minimum.reduceat(root, first), np.maximum.reduceat(root, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, leads, roots, held = [], [], [], 0
        for batch in batches:
            row, el, _, _, lead = _rarest(batch, counts.value, similar)
            slots.append(_slots(el).astype(np.int64))
            leads.append(lead.astype(np.int64))
            roots.append(batch.column("root").to_numpy()[row])
            held += len(el)
            if held >= most:
                yield told(slots, leads, roots)
                slots, leads, roots, held = [], [], [], 0
        if held:
            yield told(slots, leads, roots)
    return run


def _prefixes(counts, similar: float, leads, block: int = 1):
    """The rarest elements of each vertex on counters that ``leads`` has a number for, in as many blocks as those need."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = leads.value
        for batch in batches:
            row, el, at, size, lead = _rarest(batch, counts.value, similar, m)
            yield pa.RecordBatch.from_arrays(
                [pa.array(el), batch.column("vertex").take(pa.array(row)), batch.column("root").take(pa.array(row)),
                 pa.array(size.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(lead),
                 pa.array((1 + m[_slots(el)] // block).astype(np.int32))],
                ["element", "vertex", "root", "size", "at", "lead", "blocks"])
    return run


def prefix_pairs(large: DataFrame, similar: float = SIMILAR, block: int = HOT_BLOCK) -> DataFrame:
    """(a, b) of different roots: every pair of ``large`` (vertex, root, elements) that may be similar enough.

    Exact: elements stand in one order, rarest first, and two vertices that
    share enough of them share one among the first of both, at places that
    leave room for the rest. The order goes by counters that several elements
    may share, which costs pairs to verify but loses none. Elements of one
    root alone, or that never lead, make no pair; the vertices that lead with
    a hot element are dealt into blocks of about ``block``.
    """
    sent, c = large.sparkSession.sparkContext.broadcast, F.col

    def dense(found) -> np.ndarray:                    # at most one number a counter
        out = np.zeros(COUNTERS, np.int64)
        for slots, n in zip(found["slot"], found["n"]):
            out[slots.values.to_numpy()] = n.values.to_numpy()
        return out
    kind = "element int, vertex long, root long, size int, at int, lead boolean, blocks int"
    told = "chunk long, slot array<long>, n array<long>"
    counts = sent(dense(large.select("elements").mapInArrow(_frequencies, told)
                        .groupBy("chunk").applyInArrow(_all_frequencies, told).toArrow()))
    leads = sent(dense(large.select("root", "elements").mapInArrow(_leads(counts, similar), f"{told}, lo array<long>, hi array<long>")
                       .groupBy("chunk").applyInArrow(_open_leads, told).toArrow()))
    rows = cut(large.mapInArrow(_prefixes(counts, similar, leads, block), kind), "dup-prefixes")
    counts.destroy()
    leads.destroy()
    l = rows.where("lead").withColumn("block", F.pmod(F.xxhash64("vertex"), c("blocks")).cast("int")).alias("l")
    once = rows.where("blocks = 1").withColumn("block", F.lit(0))
    hot = rows.where("blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0), c("blocks") - 1)))
    r = once.unionByName(hot).alias("r")
    room = F.least(c("l.size") - c("l.at"), c("r.size") - c("r.at"))
    return (l.join(r, (c("l.element") == c("r.element")) & (c("l.block") == c("r.block")) & (c("l.root") != c("r.root"))
                   & ((c("l.size") < c("r.size")) | ((c("l.size") == c("r.size")) & (c("l.vertex") < c("r.vertex"))))
                   & (c("l.size") >= similar * c("r.size") - 1e-6)
                   & (room >= similar / (1 + similar) * (c("l.size") + c("r.size")) - 1e-6))
            .select(F.least("l.vertex", "r.vertex").alias("a"), F.greatest("l.vertex", "r.vertex").alias("b")).distinct())


#: Vertices of texts that have no doc_id to themselves lie from here on, above all ids.
UNNAMED = 1 << 62


def _rooted(docs: DataFrame, id_col: str, text_col: str, similar: float, rows: int, bands: int, words: int,
            small: int) -> tuple[DataFrame, DataFrame]:
    """(everything, rooted): doc_id, text_key of every row; text_key, least, root of every text with words.

    A text's vertex is its least doc_id; where a text has no id, or shares
    its least one with another text, it is a hash above all ids.
    """
    everything = cut(signed(docs, id_col, text_col, rows, bands, words), "dup-signed")
    sig = everything.where(F.col("text_key").isNotNull())
    named = sig.groupBy("text_key").agg(F.min("doc_id").cast("long").alias("least"))
    owner = named.groupBy(F.col("least").alias("_least")).agg(F.min("text_key").alias("_owner"))
    apart = F.col("least").isNull() | (F.col("text_key") != F.col("_owner"))
    unnamed = F.xxhash64("text_key").bitwiseAND(UNNAMED - 1).bitwiseOR(UNNAMED)
    reps = cut(named.join(owner, F.col("least") == F.col("_least"), "left")
               .select("text_key", "least", F.when(apart, unnamed).otherwise(F.col("least")).alias("vertex")), "dup-vertices")
    # one set of bands for each vertex
    own = (sig.join(reps, "text_key").where(F.col("doc_id").eqNullSafe(F.col("least")))
           .groupBy("text_key", "vertex").agg(F.first("bands").alias("bands")))
    own = cut(own.select("vertex", "bands"), "dup-bands")
    buckets = cut(with_hub(own.select("vertex", F.explode("bands").alias("key")).distinct()), "dup-buckets")
    # the shingles of the vertices that share a bucket
    needed = cut(buckets.select("vertex").distinct().join(reps, "vertex").select("vertex", "text_key", "least"), "dup-needed")
    texts = doc_columns(docs, id_col, text_col).withColumn("text_key", F.md5("text"))
    few = needed.count() <= 200_000                     # at most 200,000 rows of 70 bytes are sent to all tasks
    chosen = texts.join(F.broadcast(needed) if few else needed, "text_key").where(F.col("doc_id").eqNullSafe(F.col("least")))
    elements = cut(chosen.select("vertex", _words(F.col("text")).alias("words"))
                   .mapInArrow(tidy(_elements(words)), "vertex long, elements array<int>").dropDuplicates(["vertex"]),
                   "dup-elements")
    links = cut(verified(hub_pairs(buckets), elements, similar), "dup-links")
    roots = components(links)
    # second round: what is still apart in a bucket
    left = cut(open_buckets(buckets, roots), "dup-open")
    pairs = each_with_each(left.where(F.col("n") <= small))
    large = cut(left.where(F.col("n") > small).select("vertex", "root").distinct().join(elements, "vertex"), "dup-large")
    if not large.isEmpty():
        pairs = pairs.unionByName(prefix_pairs(large, similar)).distinct()
    more = cut(verified(pairs, elements, similar), "dup-links2")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    return everything.select("doc_id", "text_key"), reps.join(roots, "vertex", "left").select(
        "text_key", "least", F.coalesce("root", "vertex").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR,
            rows: int = ROWS, bands: int = BANDS, words: int = WORDS, small: int = SMALL) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), one row per input row.

    Linked: texts that are equal, and texts whose shingles (``words`` words,
    lower case, weighted by their counts) have a weighted Jaccard similarity
    of ``similar`` or more; classes are the components of the links. A text
    without words (null, empty, blank) is never linked: its class is its own
    id. Repeated rows share a class; rows of one doc_id with different texts
    are documents of their own; a null id with words gets the class of its
    text (a number above all ids where no document of the class has one); an
    empty table gives an empty one. Whole texts are used; only the two named
    columns are read.
    """
    each, rooted = _rooted(docs, id_col, text_col, similar, rows, bands, words, small)
    # a root is the least id of its class, but where a vertex without an id of its own is one
    unnamed = cut(rooted.where(F.col("root") >= UNNAMED).groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("_id")),
                  "dup-unnamed")
    named = each.join(rooted.select("text_key", "root"), "text_key", "left")
    if not unnamed.isEmpty():
        named = named.join(_sent(unnamed), F.col("root") == F.col("_root"), "left").withColumn("root", F.coalesce("_id", "root"))
    return named.select("doc_id", F.coalesce("root", F.col("doc_id").cast("long")).alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR,
                rows: int = ROWS, bands: int = BANDS, words: int = WORDS, small: int = SMALL) -> DataFrame:
    """One row of ``docs`` for each class: of its least id (nulls last) and, of that one's, least text hash; columns as they were.

    Texts without words are all kept. Rows of one id are told apart by their
    texts, so a text that is like no other always stays.
    """
    each, rooted = _rooted(docs, id_col, text_col, similar, rows, bands, words, small)
    # of each text the row of its least id, of each class one text
    place = F.struct(F.col("least").isNull().alias("none"), "least", "text_key")
    chosen = rooted.groupBy("root").agg(F.min(place).alias("_p")).select(F.col("_p.text_key").alias("text_key"))
    texts = cut(rooted.select("text_key", "least").join(chosen.withColumn("_stays", F.lit(True)), "text_key", "left"), "dup-chosen")
    several = each.where("text_key IS NOT NULL").groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1").select("text_key")
    key = F.md5(F.coalesce(docs[text_col], F.lit("")))
    go = cut(texts.where("_stays IS NULL").select(F.col("text_key").alias("_go")), "dup-go")
    stay = docs.join(_sent(go), key == F.col("_go"), "left_anti")
    # of texts on several rows, one row of the least id
    again = _sent(cut(texts.where("_stays").join(several, "text_key")
                      .select(F.col("text_key").alias("_again"), F.col("least").alias("_least")), "dup-again"))
    kept = (stay.join(again, key == F.col("_again"), "left")
            .where(F.col("_again").isNull() | docs[id_col].cast("long").eqNullSafe(F.col("_least"))).select(*(docs[c] for c in docs.columns)))
    # rows that repeat their id and text too
    twice = cut(each.where("text_key IS NOT NULL").groupBy("doc_id", "text_key").count().where("count > 1")
                .select(F.col("text_key").alias("_twice")).distinct(), "dup-twice")
    if twice.isEmpty():
        return kept
    twice, key = _sent(twice), F.md5(F.coalesce(kept[text_col], F.lit("")))
    first = (kept.join(twice, key == F.col("_twice")).groupBy("_twice")
             .agg(F.min_by(F.struct(*(kept[c] for c in docs.columns)), F.lit(0)).alias("_row")))
    return kept.join(twice, key == F.col("_twice"), "left_anti").unionByName(
        first.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns)))


def _sent(ids: DataFrame) -> DataFrame:
    """Keys to be sent to all tasks where they are few (40 MB), else joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= 1_000_000 else ids
