"""Spelling variants by a dictionary of trie-node pairs.

Every word is a path in two tries: forward, whose node p(i) stands for its
first i code points, and reversed, whose node s(i) stands for what follows
them. The nodes are numbered, and a word's integer pairs (prefix node, suffix
node) tell its neighbours at one edit exactly:

* position i skipped gives (p(i), s(i + 1)); words that share it differ in
  that code point alone (replaced);
* nothing skipped gives (p(i), s(i)); a word that has another one's skipped
  pair in this form is the other one without that code point (inserted,
  deleted).

No string is built or compared for a pair, so a word costs as many pairs as it
has code points, however long it is. The words that share a skipped pair are
as many as there are letters, at most, so no key is hot.

The tries are built from sorted ranges of the vocabulary: in sorted order a
node is new where a word leaves the path of the one before it. Nodes on the
path from one range into the next are numbered by the range and depth where
they begin, which the first and last words of the ranges tell.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, doc_columns

#: Share of occurrences that lose a code point (1 in DROP), least code points and occurrences of a word.
DROP, LEAST_CHARS, LEAST_N = 97, 5, 3
#: A form occurs at least so many times as often as its variant.
RATIO = 2
#: Words of a sorted range (one task's work), distinct runs counted before they are handed on.
RANGE, HELD = 100_000, 200_000
#: Bytes of a text whose runs are listed at once.
WINDOW = 4 << 20
#: A run of letters in UTF-8: a-z after lower-casing, U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
SHIFT = 40


def runs(text: bytes) -> Iterator[Counter]:
    """The runs of a lower-cased text, counted window by window; no run is cut."""
    if len(text) <= WINDOW:
        yield Counter(RUN.findall(text))
        return
    held: Counter = Counter()
    for m in RUN.finditer(text):
        held[m.group()] += 1
        if len(held) >= HELD:
            yield held
            held = Counter()
    yield held


def dropped(run: bytes, h: int) -> bytes:
    """``run`` without its code point ``h`` modulo its length."""
    s = run.decode()
    i = h % len(s)
    return (s[:i] + s[i + 1:]).encode()


def _count(drop: int, least: int):
    def emit(n: dict) -> pa.RecordBatch:
        words = [(w.decode(), k) for w, k in n.items()]
        words = [(w, k) for w, k in words if len(w) >= least]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()),
                                           pa.array([k for _, k in words], pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, n = zlib.crc32, {}
        for batch in batches:
            texts = batch.column("text").view(pa.binary())
            for i, d in enumerate(batch.column("doc_id").to_pylist()):
                start = crc(f"{'' if d is None else d}:".encode())
                for found in runs(texts[i].as_py().lower()):        # bytes.lower() touches A-Z alone
                    for w, k in found.items():
                        h = crc(w, start)
                        if h % drop == 0:
                            w = dropped(w, h)
                        n[w] = n.get(w, 0) + k
                    if len(n) >= HELD:
                        yield emit(n)
                        n = {}
        yield emit(n)
    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop: int = DROP,
               least_chars: int = LEAST_CHARS, least_n: int = LEAST_N) -> DataFrame:
    """word, n: the distinct runs of letters, A-Z lower-cased, some occurrences short of one code point."""
    return (doc_columns(docs, id_col, text_col).mapInArrow(_count(drop, least_chars), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n))


def shared(a: str, b: str) -> int:
    """How many code points two words begin with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n                      # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def crossings(ends: list[tuple[int, str, str]]) -> dict[int, list[int]]:
    """For each range (number, first word, last word) the ranges where the nodes begin that reach into it from before.

    One number for each depth, from 1 on.
    """
    out: dict[int, list[int]] = {}
    for k, (part, first, _) in enumerate(ends):
        if not k:
            out[part] = []
            continue
        before, its_first, its_last = ends[k - 1]
        old = out[before][:shared(its_first, its_last)]
        deep = shared(its_last, first)
        out[part] = (old + [before] * max(0, deep - len(old)))[:deep]
    return out


def paths(words: list[str], part: int, into: list[int], beyond: list[int]) -> tuple[array, array]:
    """The nodes of sorted words, root first, one after the other; and where each word's begin.

    ``into`` and ``beyond`` name the ranges where the nodes begin that come
    from the range before and go on into the next.
    """
    flat, at = array("q"), array("q", [0])
    number, prev, last, held = part << SHIFT, "", words[-1] if words else "", array("q", [0])
    for k, w in enumerate(words):
        same = shared(prev, w) if k else 0
        del held[same + 1:]
        known, names = (min(len(into), len(w)), into) if not k else (min(len(beyond), shared(w, last)), beyond)
        if not k:                                        # the first word may lie on both paths
            both = min(len(beyond), shared(w, last))
            if both > known:
                known, names = both, beyond
        for i in range(same + 1, known + 1):
            held.append(-(names[i - 1] << SHIFT | i))
        new = len(w) + 1 - len(held)
        held.extend(range(number + 1, number + 1 + new))
        number += new
        flat.extend(held)
        at.append(len(flat))
        prev = w
    return flat, at


def numbered(words: DataFrame, key: str, each: int = RANGE) -> DataFrame:
    """``key``, place, nodes: each distinct string's place in sorted order and the numbers of its trie nodes, root first."""
    ranges = max(1, -(-words.count() // each))
    sorted_ = cut(words.select(F.col(key).alias("key")).repartitionByRange(ranges, "key")
                  .select(F.spark_partition_id().alias("part"), "key"), "spell-ranges")
    ends = [tuple(r) for r in sorted_.groupBy("part").agg(F.min("key"), F.max("key")).orderBy("part").collect()]
    into = crossings(ends)
    order = [part for part, *_ in ends]
    beyond = {part: into[after] for part, after in zip(order, order[1:])}

    def run(table: pa.Table) -> pa.Table:
        part, mine = table.column("part")[0].as_py(), sorted(table.column("key").to_pylist())
        flat, at = paths(mine, part, into[part], beyond.get(part, []))
        nodes = pa.ListArray.from_arrays(pa.array(np.frombuffer(at, np.int64).astype(np.int32)),
                                         pa.array(np.frombuffer(flat, np.int64)))
        place = (part << SHIFT) + np.arange(len(mine), dtype=np.int64)
        return pa.table([pa.array(mine, pa.string()), pa.array(place), nodes], [key, "place", "nodes"])
    return sorted_.groupBy("part").applyInArrow(run, f"{key} string, place long, nodes array<long>")


def tries(words: DataFrame, each: int = RANGE) -> DataFrame:
    """word, n, id (place in code-point order), prefix and suffix nodes p(0..length), s(0..length)."""
    ahead = numbered(words, "word", each).withColumnsRenamed({"place": "id", "nodes": "p"})
    back = numbered(words.select(F.reverse("word").alias("drow")), "drow", each).select(
        F.reverse("drow").alias("word"), F.reverse("nodes").alias("s"))
    return words.join(ahead, "word").join(back, "word")


def pairs(trie: DataFrame) -> DataFrame:
    """p, s, id, n, skips, drops: a word's pairs with a position skipped and with none.

    ``drops``: of equal code points in a row the last one is skipped, so that
    a word without one of them counts once.
    """
    c = F.col
    length = F.size("p") - 1
    letters = F.split("word", "")
    skipped = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(
        F.get("p", i).alias("p"), F.get("s", i + 1).alias("s"), F.lit(True).alias("skips"),
        (F.get("letters", i) != F.coalesce(F.get("letters", i + 1), F.lit(""))).alias("drops")))
    whole = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(
        F.get("p", i).alias("p"), F.get("s", i).alias("s"), F.lit(False).alias("skips"), F.lit(False).alias("drops")))
    return (trie.withColumn("letters", letters).select("id", "n", F.explode(F.concat(skipped, whole)).alias("x"))
            .select(c("x.p").alias("p"), c("x.s").alias("s"), "id", "n", c("x.skips").alias("skips"), c("x.drops").alias("drops")))


def neighbours(pairs_: DataFrame) -> DataFrame:
    """id, n_near, best (n, -id of the near word of largest n, the smaller one of equals), for words that have any.

    Each shared pair tells its words how many others bear it and which is the
    best, by the two best alone: work in proportion to the pairs.
    """
    c, me = F.col, F.struct(F.col("n").alias("n"), (-F.col("id")).alias("id"))
    groups = (pairs_.groupBy("p", "s").agg(
        F.collect_list(F.when(c("skips"), F.struct(c("n").alias("n"), (-c("id")).alias("id"), c("drops").alias("drops")))).alias("ws"),
        F.max(F.when(~c("skips"), me)).alias("u"))
        .where((F.size("ws") > 1) | (c("u").isNotNull() & (F.size("ws") > 0))))
    groups = groups.select("u", F.sort_array("ws", asc=False).alias("ws"))
    plain = lambda x: F.struct(x["n"].alias("n"), x["id"].alias("id"))                    # noqa: E731
    none = F.lit(None).cast("struct<n:bigint,id:bigint>")
    shorter = F.filter("ws", lambda x: x["drops"])
    told = F.transform("ws", lambda x: F.struct(
        x["id"].alias("id"), (F.size("ws") - 1 + F.when(x["drops"] & c("u").isNotNull(), 1).otherwise(0)).cast("long").alias("n_near"),
        F.greatest(F.when(F.size("ws") > 1, F.when(x["id"] == c("ws")[0]["id"], plain(F.get("ws", F.lit(1)))).otherwise(plain(c("ws")[0]))),
                   F.when(x["drops"], c("u"))).alias("best")))
    to_u = F.when(c("u").isNotNull() & (F.size(shorter) > 0), F.array(F.struct(
        c("u.id").alias("id"), F.size(shorter).cast("long").alias("n_near"), plain(F.get(shorter, F.lit(0))).alias("best"))))
    rows = groups.select(F.explode(F.concat(told, F.coalesce(to_u, F.array().cast(
        "array<struct<id:bigint,n_near:bigint,best:struct<n:bigint,id:bigint>>>")))).alias("x"))
    return (rows.select((-c("x.id")).alias("id"), c("x.n_near").alias("n_near"), F.coalesce(c("x.best"), none).alias("best"))
            .groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best")).where("n_near > 0"))


def followed(forms: DataFrame) -> DataFrame:
    """id, root: from each id (id, form) along the forms to the last one, by doubling the steps.

    A form is at least twice as frequent as its variant, so chains are short:
    the rounds are the logarithm of their length.
    """
    now = cut(forms.select("id", F.col("form").alias("root"), F.lit(True).alias("moved")), "spell-roots")
    while True:
        step = now.select(F.col("id").alias("root"), F.col("root").alias("on"))
        now = cut(now.join(step, "root", "left").select("id", F.coalesce("on", "root").alias("root"),
                                                        F.col("on").isNotNull().alias("moved")), "spell-roots")
        if now.where("moved").isEmpty():
            return now.select("id", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop: int = DROP,
             least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, ratio: float = RATIO, each: int = RANGE) -> DataFrame:
    """word, form, root, n, n_near, form_n: the words of all texts with their near words' count and their form.

    Near: one inserted, deleted or replaced code point apart. Form: the near
    word of largest n (ties: the smallest in code-point order), where its n
    is at least ``ratio`` times the word's; else null. Root: the last form
    that the forms lead to, the word itself where it has none. ``ratio`` is
    above 1, so that forms cannot lead in circles. Null and empty texts have
    no words; a null id counts as an empty one in the hash; repeated rows
    count again; an empty table gives an empty one; only the two named
    columns are read. Whole texts are read, in windows where they are long.
    """
    if ratio <= 1 or least_chars < 1:
        raise ValueError("ratio must be above 1, least_chars at least 1")
    words = cut(vocabulary(docs, id_col, text_col, drop, least_chars, least_n), "spell-words")
    trie = cut(tries(words, each), "spell-tries")
    near = neighbours(pairs(trie))
    c = F.col
    known = cut(trie.select("id", "word", "n").join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(c("best.n") >= ratio * c("n"), -c("best.id")).alias("form_id"),
        F.when(c("best.n") >= ratio * c("n"), c("best.n")).alias("form_n")), "spell-near")
    roots = followed(known.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("form")))
    names = known.select("id", "word")
    forms = names.select(c("id").alias("form_id"), c("word").alias("form"))
    lasts = names.select(c("id").alias("root_id"), c("word").alias("root"))
    return (known.join(roots.withColumnRenamed("root", "root_id"), "id", "left").join(forms, "form_id", "left")
            .join(lasts, "root_id", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
