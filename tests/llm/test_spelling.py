"""Spelling variants by trie-node pairs, against comparing every word with every other."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from wagelens.llm import queries, spelling  # noqa: E402
from wagelens.session import ship_package  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "'x' AS word", "1 AS n", "2L AS id", "'f' AS form", "3 AS part", "'k' AS key")


def result(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op11_spelling(spark, DIR)) == brute.spelling(rows)


@pytest.mark.parametrize("each", [3, 40])
def test_ranges_do_not_change_the_result(spark, each):
    """Few letters make long shared paths, which cross the borders of many small ranges; runs of equal letters tie."""
    rng = random.Random(each)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ÉÉÉÉÉ"]
    rows = [(i, " ".join(rng.choice(words).swapcase() for _ in range(60))) for i in range(20)]
    assert result(spelling.variants(frame(spark, rows), each=each)) == brute.spelling(rows)
    got = result(spelling.variants(frame(spark, rows), drop=5, least_n=1, ratio=3, each=each))
    assert got == brute.spelling(rows, drop=5, occurrences=1, ratio=3)


def test_node_numbers_tell_prefixes(spark):
    """Equal numbers if and only if equal prefixes (suffixes), whatever the ranges."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(300)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    name, seen = {}, {}
    for r in spelling.tries(df, each=20).collect():
        for i, (p, s) in enumerate(zip(r["p"], r["s"])):
            for kind, node, part in (("p", p, r["word"][:i]), ("s", s, r["word"][i:])):
                assert name.setdefault((kind, node), part) == part
                assert seen.setdefault((kind, part), node) == node
    places = [r["word"] for r in spelling.tries(df, each=20).orderBy("id").collect()]
    assert places == words


def test_chain_of_forms_leads_to_the_last(spark):
    rows = [(i, " ".join(["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["abbbb"] * 48 + ["bbbbb"] * 96)) for i in (1,)]
    got = {r["word"]: r for r in spelling.variants(frame(spark, rows), drop=10 ** 9).collect()}
    assert got["aaaaa"]["root"] == got["abbbb"]["root"] == got["bbbbb"]["root"] == "bbbbb"
    assert got["bbbbb"]["form"] is None and got["bbbbb"]["n_near"] == 1


def test_ties_go_to_the_smallest_word(spark):
    rows = [(1, " ".join(["spell"] * 2 + ["spalt", "smell", "shell", "spelt"] * 4))]
    got = {r["word"]: r for r in spelling.variants(frame(spark, rows), drop=10 ** 9, least_n=1).collect()}
    assert got["spell"]["form"] == "shell" and got["spell"]["form_n"] == 4 and got["spell"]["n_near"] == 3


def test_odd_rows(spark):
    long_run = "q" * 60_000
    rows = [(1, None), (2, ""), (3, " \n12 ..."), (None, "lostword " * 5), (4, "repeated rows"), (4, "repeated rows"),
            (4, "repeated rows"), (5, f"{long_run} {long_run}x " * 3), (6, "naïve×naïve÷naive " * 4)]
    assert result(spelling.variants(frame(spark, rows), each=2)) == brute.spelling(rows)
    assert spelling.variants(frame(spark, rows).limit(0)).count() == 0


def test_long_texts_go_by_windows(monkeypatch):
    text = b"alpha beta " * 50 + b"a" * 30
    whole = list(spelling.runs(text))
    monkeypatch.setattr(spelling, "WINDOW", 16)
    monkeypatch.setattr(spelling, "HELD", 2)
    parts = list(spelling.runs(text))
    assert len(parts) > 1 and sum(parts, start=type(whole[0])()) == whole[0]
