"""Fill-in-middle by block rotation, against plain slicing, and exact restoration."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from wagelens.llm import fim, queries  # noqa: E402
from wagelens.session import ship_package  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "'x' AS output", "'y' AS form", "1 AS n", "'r' AS restored")


def test_rotation_exchanges_segments(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(fim, "STEP", 7)
    for _ in range(500):
        data = bytes(rng.randrange(256) for _ in range(rng.randint(0, 120)))
        a, mid, b = sorted(rng.randint(0, len(data)) for _ in range(3))
        buf = bytearray(data)
        fim.rotate(buf, a, mid, b)
        assert buf == data[:a] + data[mid:b] + data[a:mid] + data[b:]


def test_arranged_and_restored():
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "é", "🙂", "\n", "<", ">", "P", "S>", "<M", "<S"]) for _ in range(rng.randint(1, 30))).encode()
        if any(m in text for m in fim.SENTINELS):
            continue
        a, b = sorted(rng.randint(0, len(text)) for _ in range(2))
        for form in ("psm", "spm"):
            out = bytes(fim.arranged(text, a, b, form))
            assert all(out.count(m) == 1 for m in fim.SENTINELS)
            assert fim.restored(out, form) == text


def test_query_against_slicing(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    made = fim.restore(fim.transform(spark.read.parquet(f"{DIR}/documents.parquet"))).collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in made}
    assert got == {d: (*brute.fim(d, t), t or "") for d, t in rows}
    assert {r["form"] for r in made} >= {"psm", "spm"}
    assert queries.op12_fim(spark, DIR).count() == len(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "one line"), (6, "has <M> inside\nx"), (7, "<S\n>P\n<"),
            (8, "é🙂\nß" * 50_000), (None, "no id\nat all\n"), (9, "twice\nthe same\n"), (9, "twice\nthe same\n"),
            (10, "x" * 300_000), (11, "a\r\nb\x0bc\x85d e")]
    got = sorted((tuple(r) for r in fim.restore(fim.transform(frame(spark, rows))).collect()), key=repr)
    assert got == sorted(((d, *brute.fim(d, t), t or "") for d, t in rows), key=repr)
    assert fim.digest(frame(spark, rows).limit(0)).count() == 0


def test_rates_and_seed(spark):
    rows = [(i, f"line {i}\n" * 7) for i in range(300)]
    got = {r["doc_id"]: r for r in fim.transform(frame(spark, rows), seed=3, rate=40, spm_rate=10).collect()}
    assert all((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute.fim(d, t, 3, 40, 10)
               for (d, t), r in zip(rows, (got[d] for d, _ in rows)))
    forms = [r["form"] for r in got.values()]
    assert forms.count("plain") > forms.count("psm") > forms.count("spm") > 0


def test_a_column_named_restored_is_refused(spark):
    """A column named as the result's is refused, not overwritten."""
    made = fim.transform(frame(spark, [(1, "a\nb\n")]))
    with pytest.raises(ValueError):
        fim.restore(fim.restore(made))
