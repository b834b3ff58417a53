"""N-gram Jaccard join by grouped prefixes, against comparing all that share a shingle."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from wagelens.llm import ngramjoin, queries  # noqa: E402
from wagelens.session import ship_package  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "'x' AS same", "1 AS size", "2L AS vertex", "'y' AS text_key", "3 AS gid", "4 AS root")


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def family(rng, n, words, edits, base=None):
    """Texts on one template, each with a few words of its own."""
    base = base or [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(words), rng.choice(edits)):
            w[at] = f"own{rng.randrange(10 ** 9)}"
        out.append(" ".join(w))
    return out


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op13_ngramjoin(spark, DIR)) == brute.jaccard_components(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_families_near_the_border(spark, seed):
    """Pairs just under and just above the bound, exact copies, sets that are equal though the texts are not."""
    rng = random.Random(seed)
    texts = family(rng, 120, 100, [0, 1, 2, 3]) + family(rng, 80, 60, [1]) + family(rng, 40, 12, [0, 1])
    texts += ["a b c d e " * 3, "a b c d e " * 4, "A B\tc D e " * 5, "a b c", "A b\nC", "a b c d"] + texts[:30]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute.jaccard_components(rows)
    assert len({c for _, _, c in want}) < len(rows)
    assert result(ngramjoin.joined(frame(spark, rows))) == want
    assert result(ngramjoin.joined(frame(spark, rows), small=2, slots=1 << 6)) == want


def test_large_groups_of_equal_prefix_and_size(spark):
    """Common shingles alone tell the members apart, so they share prefix and size and fall into many components."""
    rng = random.Random(4)
    rare = " ".join(f"rare{i}" for i in range(30))
    blocks = [" ".join(f"b{k}x{i}" for i in range(8)) for k in range(40)]
    texts = [f"{rare} " + " ".join(rng.sample(blocks, 8)) for _ in range(60)]
    texts += [" ".join(blocks[k:] + blocks[:k]) for k in range(40)] * 3       # make the blocks frequent
    texts += [f"{t} tail" for t in texts[:20]]
    rows = list(enumerate(texts))
    want = brute.jaccard_components(rows)
    for small in (24, 1):
        assert result(ngramjoin.joined(frame(spark, rows), small=small, percent=80)) == want
    assert result(ngramjoin.joined(frame(spark, rows), small=1, percent=55, words=3)) == brute.jaccard_components(rows, 55, 3)


def test_second_prefix_finds_every_link(spark):
    """Members of one group by construction: equal size and prefix, some pairs linked."""
    rng = random.Random(6)
    levels = np.zeros(1 << 6, np.uint8)
    first = np.sort(np.array([rng.randrange(1, 1 << 40) for _ in range(21)], np.uint64))    # foremost in the order
    sets = []
    for k in range(40):
        tail = {rng.randrange(1 << 50, 1 << 51) for _ in range(79)} if k % 4 == 0 else set(sets[-1][21:])
        tail = sorted(tail)
        for _ in range(rng.randrange(0, 16)):
            tail[rng.randrange(79)] = rng.randrange(1 << 50, 1 << 51)
        tail = sorted(set(tail) | {rng.randrange(1 << 50, 1 << 51) for _ in range(79 - len(set(tail)))})
        sets.append([*map(int, first), *tail])
    rows = [(k, 7, k, sorted(s)) for k, s in enumerate(sets)]
    large = spark.createDataFrame(rows, "vertex long, gid long, root long, elements array<long>")
    got = {tuple(r) for r in ngramjoin.second_prefix_pairs(large, spark.sparkContext.broadcast(levels)).collect()}
    linked = {(a, b) for a in range(40) for b in range(a + 1, 40)
              if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    assert linked and linked <= got


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "same text here"), (4, "same text here"), (5, "SAME\ttext here"),
            (None, "same text here"), (None, "nobody has this one"), (None, None), (6, "w" * 70_000), (6, "other text"),
            (7, "word " * 30_000), (8, "Word " * 10), (9, "É é"), (10, "é é"), (11, "x y"), (12, "x y")]
    assert result(ngramjoin.joined(frame(spark, rows))) == brute.jaccard_components(rows)
    assert ngramjoin.joined(frame(spark, rows).limit(0)).count() == 0
    assert result(ngramjoin.joined(frame(spark, [(1, None), (2, " ")]))) == [(1, 0, 1), (2, 0, 2)]


def test_long_texts_go_by_windows(monkeypatch):
    text = b" alpha beta\ngamma  delta" * 40 + b"x" * 50 + b"\t"
    whole = ngramjoin.word_hashes(text)
    monkeypatch.setattr(ngramjoin, "WINDOW", 16)
    assert (ngramjoin.word_hashes(text) == whole).all() and len(whole) == 160
