"""Secret scan with multipart credential linking, in DataFrame functions only.

Parts are found by regular expressions, with their places: strong secrets
(kinds ``assign``, ``access``, ``hex``), and weak parts that alone say little:
random-looking strings, login names and endpoints. An interval join links the
parts of a document whose scopes touch. A weak part is reported only where its
complement is there too: a random-looking string beside an access identifier
(access key or login), a login beside a secret and an endpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, doc_columns

#: kind -> (pattern, group whose length counts, least length). Fixed values of the contract.
BASE = {
    "assign": (r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: Weak parts: reported only when linked.
WEAK = {
    "random": (r"(?<![A-Za-z0-9+/_=-])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])(?=[A-Za-z+/_=-]*[0-9])"
               r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
    "login": (r"""((?i)user|username|login|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]+)""", 2, 3),
}
#: Complements that are never reported themselves.
CONTEXT = {
    "endpoint": (r"""(?i)(?:https?://|(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9][A-Za-z0-9.:/_-]+""", 0, 4),
}
#: Cheap tests that any text with a match passes.
HINTS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": None, "hex": r"[0-9a-f]{32}",
         "random": r"[A-Za-z0-9+/_=-]{20}", "login": r"(?i)(?:user|login|client_?id|key_?id)", "endpoint": r"(?i)(?:https?://|host|endpoint|server|url)"}
#: Parts are linked when at most so many characters lie between them.
SCOPE = 256
KINDS = [*BASE, *WEAK]
SPANS = "array<struct<start:bigint,end:bigint>>"


def places(text: Column, pattern: str, group: int, least: int) -> Column:
    """[(start, end)] in code points of the leftmost non-overlapping matches whose group is long enough.

    The matches and what ``split`` leaves between them alternate, so a start
    is a sum of lengths; sums run over blocks of 256 so that a text with very
    many matches costs little more than one pass.
    """
    as_text = pattern.replace("\\", "\\\\").replace('"', '\\"')
    q = f'"{as_text}"'
    lens = (f"transform(array(struct(split(_text, {q}, -1) AS gaps, regexp_extract_all(_text, {q}, 0) AS hits, "
            f"regexp_extract_all(_text, {q}, {group}) AS told)), x -> struct("
            "transform(x.gaps, g -> cast(length(g) AS bigint)) AS gap, "
            "transform(x.hits, h -> cast(length(h) AS bigint)) AS hit, "
            "transform(x.told, h -> length(h)) AS told))")
    steps = f"transform({lens}, x -> struct(x.gap, x.hit, x.told, transform(x.hit, (h, i) -> h + x.gap[i]) AS step))"
    sums = (f"transform({steps}, x -> struct(x.gap, x.hit, x.told, x.step, aggregate(transform(sequence(0, size(x.step) div 256), "
            "b -> aggregate(slice(x.step, b * 256 + 1, 256), 0L, (s, v) -> s + v)), array(0L), "
            "(a, v) -> concat(a, array(element_at(a, -1) + v))) AS before))")
    made = (f"transform({sums}, x -> filter(transform(x.hit, (h, i) -> struct("
            "x.before[i div 256] + aggregate(slice(x.step, i div 256 * 256 + 1, i % 256), 0L, (s, v) -> s + v) + x.gap[i] AS start, "
            f"h AS n, x.told[i] AS told)), m -> m.told >= {least}))[0]")
    found = F.expr(f"transform({made}, m -> struct(m.start AS start, m.start + m.n AS end))")
    return found


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, for each kind of part, the places found in the whole text; no shuffle."""
    rows = doc_columns(docs, id_col, text_col).withColumnRenamed("text", "_text")
    none = F.expr(f"cast(array() AS {SPANS})")
    cols = []
    for kind, (pattern, group, least) in (BASE | WEAK | CONTEXT).items():
        hint = F.col("_text").contains("AKIA") if HINTS[kind] is None else F.col("_text").rlike(HINTS[kind])
        cols.append(F.when(hint, places(F.col("_text"), pattern, group, least)).otherwise(none).alias(kind))
    return rows.select("doc_id", *cols)


def _tagged(kinds: list[str]) -> Column:
    """All spans of some kinds as structs (start, number of the kind, end), ordered."""
    each = [F.expr(f"transform({k}, s -> struct(s.start AS start, {KINDS.index(k)} AS k, s.end AS end))") for k in kinds]
    return F.array_sort(F.concat(*each))


def _joined(tagged: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(tagged, lambda s: F.concat_ws(
        ":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, mark, k, start, end of the weak parts whose complements lie within ``scope``.

    ``mark`` tells rows of one doc_id apart. Weak parts and their possible
    complements meet in bins of ``scope`` characters of their own document, so
    a task sees as many pairs as a bin has parts: bounded by its characters.
    """
    own = F.concat(*(F.expr(f"transform({k}, s -> struct('{k}' AS kind, s.start AS start, s.end AS end))")
                     for k in (*BASE, *WEAK, *CONTEXT)))
    weak = F.concat("random", "login")
    each = (found.where((F.size(weak) > 0) & (F.size(F.concat("access", "login")) > 0))
            .select("doc_id", "mark", F.explode(own).alias("p")).select("doc_id", "mark", "p.*").distinct())
    near = F.explode(F.sequence(F.expr(f"(start - {scope}) div {scope} - 1"), F.expr(f"(end + {scope}) div {scope}")))
    left = each.where(F.col("kind").isin(*WEAK)).withColumn("bin", near)
    right = each.select("doc_id", "mark", F.col("kind").alias("kind2"), F.col("start").alias("start2"),
                        F.col("end").alias("end2")).withColumn(
        "bin", F.explode(F.sequence(F.expr(f"start2 div {scope}"), F.expr(f"end2 div {scope}"))))
    l, r = left.alias("l"), right.alias("r")
    pairs = l.join(r, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.mark") == F.col("r.mark"))
                   & (F.col("l.bin") == F.col("r.bin"))
                   & (F.col("end2") >= F.col("l.start") - scope) & (F.col("start2") <= F.col("l.end") + scope))
    met = lambda *kinds: F.max(F.col("kind2").isin(*kinds).cast("int"))
    apart = (F.col("end2") <= F.col("l.start")) | (F.col("start2") >= F.col("l.end"))
    seen = pairs.groupBy(F.col("l.doc_id").alias("doc_id"), F.col("l.mark").alias("mark"), F.col("l.kind").alias("kind"),
                         F.col("l.start").alias("start"), F.col("l.end").alias("end")).agg(
        F.max(F.when(apart, F.col("kind2").isin("access", "login").cast("int"))).alias("id"),
        F.max(F.when(apart, F.col("kind2").isin("assign", "hex", "random").cast("int"))).alias("secret"),
        met("endpoint").alias("endpoint"),
        F.max((~apart & F.col("kind2").isin(*BASE)).cast("int")).alias("inside_base"))
    good = seen.where((F.col("inside_base") == 0)
                      & (((F.col("kind") == "random") & (F.col("id") == 1))
                         | ((F.col("kind") == "login") & (F.col("secret") == 1) & (F.col("endpoint") == 1))))
    number = F.when(F.col("kind") == "random", KINDS.index("random")).otherwise(KINDS.index("login"))
    return good.select("doc_id", "mark", F.struct("start", number.alias("k"), "end").alias("s"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (spans), added (spans), base_text, all_text.

    One row per input row, repeated rows included; a null or empty text has
    no spans (empty strings); an empty table gives an empty one; whole texts
    are scanned; only the two named columns are read. Spans are structs
    (start, k, end) with k the place of the kind in ``KINDS``, ordered by
    start, then kind.
    """
    found = cut(parts(docs, id_col, text_col), "secret-parts")
    found = found.withColumn("mark", F.xxhash64(*BASE, *WEAK, *CONTEXT))
    more = linked(found, scope).groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(
        F.collect_list("s").alias("more"))                # at most the weak parts of one document
    kind = "array<struct<start:bigint,k:int,end:bigint>>"
    rows = found.join(more, found["doc_id"].eqNullSafe(more["d"]) & (found["mark"] == more["m"]), "left")
    rows = rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
                       _tagged(list(BASE)).cast(kind).alias("base"),
                       F.array_sort(F.coalesce(F.col("more").cast(kind), F.expr(f"cast(array() AS {kind})"))).alias("added"))
    return rows.withColumns({"base_text": _joined(F.col("base")),
                             "all_text": _joined(F.array_sort(F.concat("base", "added")))})
