"""Personal data: base patterns, and bootstrapped contextual extraction.

One pass finds the base spans (email, ip, card, phone) and every
identifier-like string with its lexical contexts. The strings that a base
pattern found are seeds; their contexts are patterns. Spark scores the graph
of patterns and strings in a few rounds: a pattern by the share of its strings
that are known as one kind, a string by the noisy-or of its patterns. What a
high-confidence pattern extracts and no base pattern covers is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wagelens.functions.sizing import broadcast_if_small

from .common import cut, doc_columns, tidy

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the contract; where a match must be longest, possessive, so that no text costs more than a pass.
AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN, WORD = re.compile(r"[0-9@]"), re.compile(r"\S+")
EDGE = ".,;:!?\"'()[]{}<>|"
#: Smoothing of a pattern's share, distinct seeds that it needs, confidence from which it extracts, rounds.
SMOOTH, MIN_SEEDS, CONFIDENT, ROUNDS = 1.0, 3, 0.8, 3
#: Bytes of added spans, as written, that are sent to all tasks.
SENT_BYTES = 8 << 20
#: Longer contexts and strings are known by their hash.
LONGEST = 48

FOUND = ("doc_id {id}, mark long, n_email long, n_ip long, n_card long, n_phone long, "
         "base array<struct<start:int,k:int,end:int>>, "
         "seen array<struct<start:int,end:int,k:int,item:string,ctx:array<string>>>")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, ordered; leftmost and non-overlapping for each kind."""
    out, last = [], 0
    if "@" in text:
        for m in AT.finditer(text):
            a = m.start()
            while a > last and LOCAL.match(text, a - 1):
                a -= 1
            if a < m.start():
                out.append((a, 0, last := m.end()))
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _short(s: str) -> str:
    if len(s) <= LONGEST:
        return s
    import hashlib
    return "#" + hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=12).hexdigest()


def contexts(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Identifier-like strings (neighbouring words that hold a digit or an @) and their lexical contexts."""
    if not SIGN.search(text):
        return []
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    like = [bool(SIGN.search(text, a, b)) for a, b in words]
    out, i, at = [], 0, 0
    norm = lambda k: _short(text[words[k][0]:words[k][1]].strip(EDGE).lower()) if 0 <= k < len(words) else "^"
    while i < len(words):
        if not like[i]:
            i += 1
            continue
        j = i
        while j + 1 < len(words) and like[j + 1] and words[j + 1][0] == words[j][1] + 1:
            j += 1
        a, b = words[i][0], words[j][1]
        while a < b and text[a] in EDGE:
            a += 1
        while b > a and text[b - 1] in EDGE:
            b -= 1
        while at < len(base) and base[at][2] <= a:
            at += 1
        hit = next((s for s in base[at:at + 4] if s[0] < b and s[2] > a), None)
        if b > a:
            p, pp, n = norm(i - 1), norm(i - 2), norm(j + 1)
            out.append({"start": a, "end": b, "k": -1 if hit is None else hit[1], "item": _short(text[a:b]),
                        "ctx": [f"{p} _", f"{pp} {p} _", f"{p} _ {n}"]})
        i = j + 1
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("k", pa.int32()), ("end", pa.int32())]))
    seen = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("k", pa.int32()), ("item", pa.string()),
                               ("ctx", pa.list_(pa.string()))]))
    for batch in batches:
        spans, other, n = [], [], [[] for _ in KINDS]
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            spans.append([{"start": a, "k": k, "end": b} for a, k, b in base])
            other.append(contexts(text, base))
            for k in range(len(KINDS)):
                n[k].append(sum(s[1] == k for s in base))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), *(pa.array(x, pa.int64()) for x in n),
             pa.array(spans, span), pa.array(other, seen)],
            ["doc_id", "mark", *(f"n_{k}" for k in KINDS), "base", "seen"])


def score_patterns(seen: DataFrame, rounds: int = ROUNDS, smooth: float = SMOOTH,
                   min_seeds: int = MIN_SEEDS) -> DataFrame:
    """pattern, k, conf: scores of the graph of patterns and strings after some rounds.

    ``seen`` has k (kind or -1), item, ctx. All tables are aggregated by
    pattern or by string with partial sums, so a word before a third of all
    strings costs one row a task; joins are left to AQE, which splits hot keys.
    """
    edges = cut(seen.select("item", "k", F.explode("ctx").alias("pattern"))
                .groupBy("pattern", "item").agg(F.max("k").alias("k")), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.where("k >= 0").select("item", "k").distinct().withColumn("score", F.lit(1.0))
    known, conf = seeds, None
    for r in range(rounds):
        hits = (edges.select("pattern", "item").join(known, "item")
                .groupBy("pattern", "k").agg(F.sum("score").alias("hits"),
                                             F.sum((F.col("score") == 1.0).cast("int")).alias("sure")))
        conf = (hits.where(F.col("sure") >= min_seeds).join(sizes, "pattern")
                .select("pattern", "k", (F.col("hits") / (F.col("n") + smooth)).alias("conf")))
        if r + 1 == rounds:
            break
        conf = cut(conf, "pii-patterns")
        told = (edges.select("pattern", "item").join(conf, "pattern").groupBy("item", "k")
                .agg((1 - F.exp(F.sum(F.log(1 - F.least("conf", F.lit(0.999)))))).alias("score")))
        known = cut(told.unionByName(seeds).groupBy("item", "k").agg(F.max("score").alias("score")), "pii-items")
    return conf


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confident: float = CONFIDENT,
           rounds: int = ROUNDS, smooth: float = SMOOTH, min_seeds: int = MIN_SEEDS) -> tuple[DataFrame, DataFrame]:
    """(rows, added). rows: doc_id, mark, n_<kind>, base (spans), one row per input row.

    added: doc_id, mark, spans - what patterns discovered beside the base
    spans, one row per document that has any; ``mark`` is the hash of the text
    and tells rows of one doc_id apart. A null or empty text has no spans; an
    empty table gives empty ones; repeated rows stay repeated; whole texts are
    read; only the two named columns are used.
    """
    rows = doc_columns(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = cut(rows.mapInArrow(tidy(_find), FOUND.format(id=kind)), "pii-found")
    seen = found.select("doc_id", "mark", F.explode("seen").alias("s")).select("doc_id", "mark", "s.*")
    conf = score_patterns(seen, rounds, smooth, min_seeds).where(F.col("conf") >= confident)
    hits = (seen.where("k < 0").select("doc_id", "mark", "start", "end", F.explode("ctx").alias("pattern"))
            .join(conf, "pattern")
            .groupBy("doc_id", "mark", "start", "end")
            .agg(F.max(F.struct("conf", (-F.col("k")).alias("k"))).alias("best")))
    added = hits.groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_set(F.struct("start", (-F.col("best.k")).alias("k"), "end"))).alias("spans"))
    return found.drop("seen"), added


def join_spans(spans) -> "F.Column":
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_<kind>, base, spans (base and added), base_text, all_text; one row per input row (see ``detect``)."""
    rows, added = detect(docs, id_col, text_col, **how)
    more = added.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("spans").alias("more"))
    both = rows.join(more, rows["doc_id"].eqNullSafe(more["d"]) & (rows["mark"] == more["m"]), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.expr("cast(array() AS array<struct<start:int,k:int,end:int>>)"))))
    return both.select("doc_id", *(f"n_{k}" for k in KINDS), "base", spans.alias("spans")).withColumns(
        {"base_text": join_spans(F.col("base")), "all_text": join_spans(F.col("spans"))})


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with every base and added span of the text replaced by ``[kind]``; other columns stay.

    Overlapping spans are replaced together, by the kind of the first. Rows
    without spans are untouched (a null text stays null).
    """
    _, added = detect(docs, id_col, text_col, **how)
    # added spans are few beside the texts: written, and sent to where the texts are unless they are many
    more = broadcast_if_small(cut(added.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), F.col("spans").alias("_more")),
                                  "pii-added"), SENT_BYTES)
    mark = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    both = docs.join(more, docs[id_col].eqNullSafe(more["_d"]) & (mark == more["_m"]), "left")
    both = both.select(*(docs[c] for c in docs.columns), more["_more"])

    def run(batches):
        for batch in batches:
            texts = []
            at = batch.schema.get_field_index(text_col)
            for text, extra in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                spans = base_spans(text or "")
                if extra:
                    spans = sorted(spans + [(s["start"], s["k"], s["end"]) for s in extra])
                if spans:
                    out, end = [], 0
                    for a, k, b in spans:
                        if a >= end:
                            out += [text[end:a], f"[{KINDS[k].upper()}]"]
                        end = max(end, b)
                    text = "".join(out) + text[end:]
                texts.append(text)
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])
    return both.mapInArrow(tidy(run), docs.schema)
