"""Language identification by compression.

Each language gets a zstandard raw-content dictionary made of whole labelled
texts. A text is compressed once with each dictionary; the language with the
smallest result wins, and a narrow margin marks the row as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import doc_columns, tidy

UNKNOWN = "und"
#: Bounds of the learning sample: rows a language, characters up to which a row is preferred, bytes of a dictionary.
SAMPLE_ROWS, SAMPLE_CHARS, DICT_BYTES = 160, 4_000, 131_072
LEVEL = 6
#: Narrowest accepted margin between the best and the second language: bytes, and share of the best size. Set on
#: learnable rows of sf0.1 alone (600 outside the dictionaries): 0.02 rejects 0.5% of them and 83% with their language left out, 0.03 0.5% and 94%.
MIN_MARGIN, MIN_SHARE = 1, 0.025


def learn(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS,
          dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw-content dictionary of each language.

    Sample (bounded, documented): of the ``learnable`` rows with a language
    and a letter, the ``sample_rows`` first of each language, those of at most
    ``sample_chars`` characters before longer ones (these only where the
    short ones hold fewer bytes than that), each in the order of the hash of their ids; a dictionary takes whole texts of them up to
    ``dict_bytes``, or the beginning of the first where none fits whole. Only
    ids are sorted; the texts of the chosen ids (bounded, cut behind
    ``dict_bytes`` characters) are fetched afterwards.
    """
    from pyspark.sql import Window

    usable = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                         F.col(text_col).alias("text"), learnable.alias("ok"))
    usable = usable.where(F.col("ok") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn(
        "long", F.length("text") > sample_chars)
    in_class = Window.partitionBy("lang", "long").orderBy(F.xxhash64("id"), "id")
    ids = usable.select("id", "lang", "long").withColumn("r", F.row_number().over(in_class))
    # more long rows than these never fit a dictionary
    chosen = ids.where(F.col("r") <= F.when(F.col("long"), min(sample_rows, dict_bytes // max(sample_chars, 1) + 1))
                       .otherwise(sample_rows)).select("id", "lang", "long").distinct()
    rows = (usable.join(F.broadcast(chosen), ["id", "lang", "long"], "left_semi")   # at most 2 * sample_rows ids a language
            .select("lang", "long", "id", F.substring("text", 1, dict_bytes).alias("text")).distinct()
            .withColumn("o", F.xxhash64("id")).orderBy("lang", "long", "o", "id", "text").collect())
    out: dict[str, bytes] = {}
    first: dict[str, bytes] = {}
    seen: dict[str, set] = {}
    short: dict[str, int] = {}
    for r in rows:
        had = seen.setdefault(r["lang"], set())
        if r["text"] in had or len(had) == sample_rows:
            continue
        had.add(r["text"])
        text = r["text"].lower().encode("utf-8", "replace")
        first.setdefault(r["lang"], text)
        have = out.get(r["lang"], b"")
        if not r["long"]:
            short[r["lang"]] = len(have) + len(text)
        elif short.get(r["lang"], 0) >= sample_chars:
            continue
        if len(have) + len(text) < dict_bytes:
            out[r["lang"]] = have + text + b"\n"
    for lang, text in first.items():
        if lang not in out:
            out[lang] = text[:dict_bytes].decode("utf-8", "ignore").encode()
    return {k: v for k, v in sorted(out.items()) if len(v) >= 8}


def _classify(model: dict[str, bytes], level: int, min_margin: int, min_share: float):
    names = list(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import zstandard as z

        letter = regex.compile(r"\p{L}")
        packers = []
        for name in names:
            d = z.ZstdCompressionDict(model[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            packers.append(z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False))
        for batch in batches:
            langs, scores, margins, least = [], [], [], []
            for text in batch.column("text").to_pylist():
                best, score, margin, need = UNKNOWN, 0.0, 0, min_margin
                if packers and letter.search(text):
                    raw = text.lower().encode("utf-8", "replace")
                    sizes = [len(p.compress(raw)) for p in packers]
                    order = np.argsort(sizes, kind="stable")
                    best = names[order[0]]
                    margin = int(sizes[order[1]] - sizes[order[0]]) if len(sizes) > 1 else len(raw)
                    need = max(min_margin, min_share * sizes[order[0]]) if len(sizes) > 1 else min_margin
                    score = 1.0 - 2.0 ** (-margin / 4.0)
                langs.append(best)
                scores.append(score)
                margins.append(margin)
                least.append(need)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(margins, pa.int64()),
                 pa.array([p == UNKNOWN or m < n for p, m, n in zip(langs, margins, least)], pa.bool_())],
                ["doc_id", "lang_pred", "score", "margin", "rejected"])
    return run


def classify(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
             level: int = LEVEL, min_margin: int = MIN_MARGIN, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, lang_pred, score, margin (bytes), rejected; one row per input row.

    ``und``, score 0, rejected: a null or empty text, one without letters, or
    a model without languages. Ties go to the language first by name and are
    rejected (margin 0), and so are margins below ``min_share`` of the text's
    compressed size: it is then hardly nearer to one language than to another. Whole texts are compressed, however long. Only the
    two named columns are read. The model's size is bounded: ``dict_bytes``
    for each language.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return doc_columns(docs, id_col, text_col).mapInArrow(
        _classify(model, level, min_margin, min_share),
        f"doc_id {kind}, lang_pred string, score double, margin long, rejected boolean")


def accepted(docs: DataFrame, model: dict[str, bytes], text_col: str = "text",
             level: int = LEVEL, min_margin: int = MIN_MARGIN, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of ``docs`` that ``classify`` does not reject, all columns as they were."""
    def run(batches):
        judge = _classify(model, level, min_margin, min_share)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col)).fill_null("")
            pair = pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), text], ["doc_id", "text"])
            for verdict in judge(iter([pair])):
                yield batch.filter(pa.compute.invert(verdict.column("rejected")))
    return docs.mapInArrow(tidy(run), docs.schema)
