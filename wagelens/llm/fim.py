"""Fill-in-the-middle by in-place block rotation.

A text is a bytearray: its lines are scanned for the two cuts, the sentinels
are inserted in front of prefix, middle and suffix, and neighbouring segments
are exchanged where they lie, by three reversals (reverse each of the two,
then both together). The same rotation read backwards restores the text: the
sentinels are found, the segments rotated back, the sentinels taken out.

Sentinels are ``<``, one byte, ``>``. Texts that hold one of them stay plain,
and a sentinel cannot arise where a text meets another sentinel, so each
stands exactly once in an output and the way back is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import doc_columns

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Parameters of the mix: seed, percent of transformed texts, percent of those with the suffix first.
SEED, RATE, SPM_RATE = 7, 100, 50
#: Bytes exchanged at once by a reversal; bytes of text written out at once.
STEP, FLUSH = 1 << 16, 8 << 20


def numbers(doc_id, seed: int = SEED) -> list[int]:
    """The first four 32-bit numbers of the sha256 of ``seed:doc_id`` (a null id: empty)."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]


def scan(buf, n_cuts: tuple[int, int] | None = None):
    """Number of lines; with two line numbers instead the bytes after which they end."""
    at = np.flatnonzero(np.frombuffer(buf, np.uint8) == 10) + 1
    if len(buf) and (not len(at) or at[-1] != len(buf)):
        at = np.append(at, len(buf))
    if n_cuts is None:
        return len(at)
    return tuple(int(at[c - 1]) if c else 0 for c in n_cuts)


def reverse(view: np.ndarray, a: int, b: int) -> None:
    """Reverse ``view[a:b]`` in place, a bounded step from both ends at a time."""
    while b - a > 1:
        n = min(STEP, (b - a) // 2)
        head = view[a:a + n].copy()
        view[a:a + n] = view[b - n:b][::-1]
        view[b - n:b] = head[::-1]
        a, b = a + n, b - n


def rotate(buf: bytearray, a: int, mid: int, b: int) -> None:
    """Exchange the neighbouring segments ``buf[a:mid]`` and ``buf[mid:b]`` in place, by three reversals."""
    view = np.frombuffer(buf, np.uint8)
    reverse(view, a, mid)
    reverse(view, mid, b)
    reverse(view, a, b)


def arranged(text: bytes, first: int, second: int, form: str) -> bytearray:
    """``text`` with prefix ``[:first]`` and middle ``[first:second]`` in the order of ``form`` (psm, spm)."""
    buf = bytearray(text)
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):       # from the back: earlier places stay
        buf[at:at] = mark
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(buf, middle if form == "psm" else 0, suffix, len(buf))
    return buf


def restored(output: bytes, form: str) -> bytes:
    """The text that ``arranged`` made ``output`` of."""
    if form == "plain":
        return output
    buf = bytearray(output)
    if form == "psm":                                   # <P>prefix <S>suffix <M>middle
        rotate(buf, buf.index(SUFFIX), buf.index(MIDDLE), len(buf))
    else:                                               # <S>suffix <P>prefix<M>middle
        rotate(buf, 0, buf.index(PREFIX), len(buf))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buf.rindex(mark)
        del buf[at:at + len(mark)]
    return bytes(buf)


def form_of(text: bytes, h3: int, h4: int, rate: int = RATE, spm_rate: int = SPM_RATE) -> str:
    if not text or any(m in text for m in SENTINELS) or h3 % 100 >= rate:
        return "plain"
    return "spm" if h4 % 100 < spm_rate else "psm"


def chars(text: bytes) -> int:
    """Code points of a stretch of UTF-8: the bytes that do not continue one."""
    b = np.frombuffer(text, np.uint8)
    return int(((b & 0xC0) != 0x80).sum())


def _flushed(rows, names, types):
    """Record batches of ``rows`` (tuples whose ``out`` field is large), sent on after some megabytes of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += max((len(x) for x in row if isinstance(x, bytes)), default=0)
        if size >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _bytes(column, i: int) -> bytes:
    v = column[i].as_buffer()
    return v.to_pybytes() if v is not None else b""


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
              spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output: one row each.

    Cuts and form follow from the id and the seed alone. A null or empty text
    has no lines and stays plain (output empty); a null id counts as empty in
    the hash; repeated rows give repeated results; an empty table an empty
    one. Only the two named columns are read, so others may clash. Texts are
    taken whole; a worker holds a few copies of one text and ``FLUSH`` bytes.
    """
    each = doc_columns(docs, id_col, text_col)
    kind = each.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").view(pa.binary())
            for i, d in enumerate(ids.to_pylist()):
                text = _bytes(texts, i)
                n, (h1, h2, h3, h4) = scan(text), numbers(d, seed)
                form = form_of(text, h3, h4, rate, spm_rate)
                if form == "plain":
                    yield d, n, form, None, None, text
                    continue
                first, second = scan(text, tuple(sorted((h1 % (n + 1), h2 % (n + 1)))))
                yield (d, n, form, chars(text[:first]), chars(text[first:second]),
                       bytes(arranged(text, first, second, form)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        types = [first.schema.field("doc_id").type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def again():
            yield first
            yield from batches
        for out in _flushed(rows(again()), names, types):
            yield out.set_column(5, "output", out.column(5).view(pa.string()))
    return each.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``made`` with a further column ``restored``: the text rebuilt from output and form alone."""
    if "restored" in made.columns:
        raise ValueError("the table has a column 'restored' already")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema) + ", restored string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, forms = batch.column(output_col).view(pa.binary()), batch.column(form_col).to_pylist()
            at, size = 0, 0
            back: list[bytes] = []
            for i, form in enumerate(forms):
                back.append(restored(_bytes(texts, i), form))
                size += len(back[-1])
                if size >= FLUSH or i == len(forms) - 1:
                    part = batch.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(back, pa.binary()).view(pa.string())],
                                                     [*part.schema.names, "restored"])
                    at, size, back = i + 1, 0, []
    return made.mapInArrow(run, schema)


def digest(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    got = restore(transform(docs, **how))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2("restored", 256).alias("restored_sha256"))
