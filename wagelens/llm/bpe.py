"""BPE encoding and decoding by tree concatenation.

A text is cut at blanks and line feeds (no token of the vocabulary spans
them), and each distinct piece of a batch is encoded once. Texts longer than
``spread_chars`` are handled as unsplit: they are cut in equal slices
*anywhere*, also inside words, the slices are encoded in parallel by Spark,
and neighbouring results are joined pairwise up a tree. At each join a window
around the border is encoded again and grown until it shares a run of tokens
(same id, same place) with the left and with the right side; everything
between the two runs comes from the window. Inside a task the same tree
joins the halves of a single piece longer than ``unsplit_chars``.

Why one shared run on either side is enough: a BPE result is right if every
adjacent pair of tokens is what the merges give for that pair; with a shared
run each adjacent pair of the joined list was adjacent in one of the three
encodings.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import doc_columns, tidy

TOKENIZER_FILE = "word_bpe_49k.json"
#: Texts longer than this are sliced and encoded by several tasks.
SPREAD_CHARS = 50_000
#: Pieces without a blank longer than this are encoded by halves.
UNSPLIT_CHARS = 4_096
#: First window on either side of a join, and tokens that must agree.
WINDOW_CHARS, AGREE_TOKENS = 48, 4
#: Words that a Python worker remembers before it forgets older ones (memory bound only; results do not depend on it).
REMEMBERED = 100_000
#: Trailing marks that are looked up apart from the word before them.
MARKS = ".,;:!?|*%$&#"

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKENS = "doc_id long, ids array<int>"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER_FILE)


_LOADED: dict = {}


def load(path: str | None):
    """The tokenizer of a file, loaded once per Python worker."""
    path = path or default_tokenizer()
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LOADED[path] = (tok, Pieces(tok))
    return _LOADED[path]


# ---- tree concatenation -----------------------------------------------------

def encode_at(tok, text: str, shift: int = 0) -> list[tuple[int, int, int]]:
    """Tokens as (id, start, end), places counted in code points of the whole text."""
    enc = tok.encode(text, add_special_tokens=False)
    return [(i, a + shift, b + shift) for i, (a, b) in zip(enc.ids, enc.offsets)]


def _starts(text: str, tokens: list, k: int) -> bool:
    """Token k begins on a character that no earlier token touches and that never combines with one before it."""
    if k and tokens[k][1] < tokens[k - 1][2]:
        return False
    c = text[tokens[k][1]:tokens[k][1] + 1]
    return bool(c) and unicodedata.category(c)[0] != "M" and not "\u1160" <= c <= "\u11ff"


def _agree_left(text: str, left: list, win: list, agree: int, limit: int):
    """(i, j): left[i:i+agree] == win[j:j+agree], the first such run, ending before ``limit``."""
    at = {t: j for j, t in enumerate(win) if _starts(text, win, j)}
    lo = next((i for i in range(len(left) - 1, -1, -1) if left[i][1] < win[0][1]), -1) + 1 if win else len(left)
    for i in range(max(lo, 0), len(left) - agree + 1):
        j = at.get(left[i])
        if j is not None and j > 0 and _starts(text, left, i) and left[i:i + agree] == win[j:j + agree] \
                and left[i + agree - 1][2] <= limit:
            return i, j
    return None


def _agree_right(text: str, right: list, win: list, agree: int, limit: int):
    """(i, j): runs that end alike, right[i-agree:i] == win[j-agree:j], the first after ``limit``."""
    at = {t: j for j, t in enumerate(win) if _starts(text, win, j)}
    for i in range(len(right) - agree):
        if not win or right[i][1] > win[-1][2]:
            break
        j = at.get(right[i])
        if j is not None and right[i][1] >= limit and _starts(text, right, i) and _starts(text, right, i + agree) \
                and j + agree < len(win) and right[i:i + agree] == win[j:j + agree]:
            return i + agree, j + agree
    return None


def join_at(tok, text: str, left: list, right: list, mid: int,
            window: int = WINDOW_CHARS, agree: int = AGREE_TOKENS) -> list:
    """Tokens of ``text`` from those of text[:mid] and text[mid:].

    ``text`` starts at place 0 of both lists; the window grows until both
    sides agree with it, at the worst to the whole text.
    """
    n = len(text)
    while True:
        a = next((t[1] for t in reversed(left) if t[1] <= mid - window), 0)
        b = next((t[2] for t in right if t[2] >= mid + window), n)
        win = encode_at(tok, text[a:b], a)
        head = (0, 0) if a == 0 else _agree_left(text, left, win, agree, mid)
        tail = (len(right), len(win)) if b == n else _agree_right(text, right, win, agree, mid)
        if head and tail and head[1] <= tail[1]:
            return left[:head[0]] + win[head[1]:tail[1]] + right[tail[0]:]
        window *= 2


def encode_tree(tok, text: str, leaf: int = UNSPLIT_CHARS, window: int = WINDOW_CHARS) -> list:
    """Tokens of a text by halves: encode, join, upwards."""
    if len(text) <= max(leaf, 1):
        return encode_at(tok, text)
    mid = len(text) // 2
    left, right = encode_tree(tok, text[:mid], leaf, window), encode_tree(tok, text[mid:], leaf, window)
    return join_at(tok, text, left, [(i, a + mid, b + mid) for i, a, b in right], mid, window)


def join_slices(tok, slices: list[tuple[str, list]], window: int = WINDOW_CHARS) -> list:
    """Tokens of the text cut into ``slices`` [(text, tokens from 0)], joined pairwise up a tree."""
    while len(slices) > 1:
        up = []
        for k in range(0, len(slices) - 1, 2):
            (s, left), (t, right) = slices[k], slices[k + 1]
            up.append((s + t, join_at(tok, s + t, left, [(i, a + len(s), b + len(s)) for i, a, b in right],
                                      len(s), window)))
        slices = up + slices[len(slices) - len(slices) % 2:]
    return slices[0][1] if slices else []


# ---- whole texts --------------------------------------------------------------

def _byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


ALPHABET = _byte_alphabet()


def has_word_ends(tok) -> bool:
    """The vocabulary lowers text, drops blanks and ends words: the shortcuts by piece and word hold."""
    made = json.loads(tok.to_str())
    steps = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])]
    split = [n.get("type") for n in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return (steps == ["NFC", "Replace", "Lowercase"] and split == ["Split", "ByteLevel"]
            and made["model"].get("end_of_word_suffix") == "</w>"
            and made["pre_tokenizer"]["pretokenizers"][0].get("invert") is True)


def _lowered() -> dict[int, str]:
    """For each character below U+0250 what stands for its lower case in the model's alphabet; NUL where that is no letter."""
    return {c: "".join([ALPHABET[b] for b in low.encode()]) if (low := chr(c).lower()).isalpha() else "\0" for c in range(0x250)}


LOWERED = _lowered()


def _letters(word: str) -> str | None:
    """The one pre-token of a word of Latin letters in the model's alphabet; None for any other word."""
    if word.isascii():
        return word if word.isalpha() else None
    if max(word) >= "\u0250":
        return None
    low = word.translate(LOWERED)
    return None if "\0" in low else low


class Pieces:
    """Encodings of the words that a Python worker has met, the least recent forgotten.

    A blank-free piece is looked up as it is, then as its word and its
    trailing marks: a letter before a mark always ends a word of the
    vocabulary. ASCII words are looked up in lower case, as the tokenizer
    lowers them.
    """

    def __init__(self, tok):
        self.tok, self.model, self.new, self.old = tok, tok.model, {}, {}
        self.by_piece = has_word_ends(tok)

    def _one(self, w: str):
        """Entry (ids as text, tokens as text, count) of a word, or None where the whole tokenizer is needed."""
        e = self.new.get(w) or self.old.get(w)
        if e is None:
            one = _letters(w)
            if one is None:
                return None
            got = self.model.tokenize(one)
            if len(got) == 1:
                e = (str(got[0].id), got[0].value, 1)
            else:
                e = (" ".join([str(t.id) for t in got]), " ".join([t.value for t in got]), len(got))
        self.new[w] = e
        return e

    def entries(self, pieces) -> dict[str, tuple[str, str, int]]:
        """The entry of each distinct piece; pieces without a token are left out."""
        new, old, out, apart, miss = self.new, self.old, {}, [], set()
        for p in pieces:
            e = new.get(p)
            if e is None:
                e = old.get(p)
                if e is None:
                    apart.append(p)
                    continue
                new[p] = e
            out[p] = e
        waiting, one = [], self._one
        for p in apart:
            if p.isascii() and p.isalpha():
                out[p] = one(p.lower())
                continue
            w, tail = _parts(p)
            e = one(w) if w else NO_TOKENS
            t = one(tail) if tail else NO_TOKENS
            if e is None or t is None:
                miss.update(x for x, y in ((w, e), (tail, t)) if y is None)
                waiting.append((p, w, tail))
            else:
                out[p] = _with_tail(e, t)
        miss = list(miss)
        for k in range(0, len(miss), 20_000):
            part = miss[k:k + 20_000]
            for w, e in zip(part, self.tok.encode_batch(part, add_special_tokens=False)):
                ids = e.ids
                new[w] = (" ".join(map(str, ids)), " ".join(e.tokens), len(ids))
        for p, w, tail in waiting:
            out[p] = _with_tail(new[w] if w else NO_TOKENS, new[tail] if tail else NO_TOKENS)
        if len(new) > REMEMBERED:
            self.old, self.new = new, {}
        for p in [p for p, e in out.items() if not e[2]]:
            del out[p]
        return out


NO_TOKENS = ("", "", 0)


def _with_tail(e: tuple, t: tuple) -> tuple:
    if not t[2]:
        return e
    return (f"{e[0]} {t[0]}", f"{e[1]} {t[1]}", e[2] + t[2]) if e[2] else t


def _parts(piece: str) -> tuple[str, str]:
    """The word of a piece and its trailing marks, as they are looked up."""
    word = piece.rstrip(MARKS)
    if len(word) < len(piece) and not word[-1:].lower().isalpha():
        word = piece
    tail = piece[len(word):]
    return (word.lower() if word.isascii() else word), tail


def known_pieces(known: Pieces, texts: list[list[str]], unsplit: int) -> dict[str, tuple[str, str, int]]:
    """Entry of every distinct piece of some split texts; pieces without a token are left out."""
    pieces = set().union(*texts) if texts else set()
    pieces.discard("")
    long = [p for p in pieces if len(p) > unsplit]
    pieces.difference_update(long)
    out = known.entries(pieces)
    for p in long:
        e = _entry(known.tok, encode_tree(known.tok, p, unsplit))
        if e[2]:
            out[p] = e
    return out


def _entry(tok, tokens: list) -> tuple[str, str, int]:
    ids = [t[0] for t in tokens]
    return " ".join(map(str, ids)), " ".join(map(tok.id_to_token, ids)), len(ids)


def encode_texts(known: Pieces, texts: list[str], unsplit: int = UNSPLIT_CHARS) -> list[list[tuple[str, str, int]]]:
    """The entries of each text's pieces, in order."""
    if not known.by_piece:
        return [[_entry(known.tok, encode_tree(known.tok, t, unsplit))] if t else [] for t in texts]
    split = [t.replace("\n", " ").split(" ") for t in texts]
    here = known_pieces(known, split, unsplit)
    return [list(filter(None, map(here.get, s))) for s in split]


def _ids(entries: list[tuple[str, str, int]]) -> list[int]:
    return [int(i) for e in entries if e[2] for i in e[0].split(" ")]


def digest(tok, ids: list[int]) -> tuple[int, str, str]:
    """Count, sha256 of the ids as text, sha256 of the decoded text."""
    back = tok.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())


_EMPTY = hashlib.sha256(b"").hexdigest()


def _digest(tok, entries: list[tuple[str, str, int]]) -> tuple[int, str, str]:
    """``digest`` of a text's entries; a tokenizer without a decoder joins its tokens by blanks."""
    if tok.decoder is not None:
        return digest(tok, _ids(entries))
    if not entries:
        return 0, _EMPTY, _EMPTY
    ids, tokens, _ = zip(*entries)
    ids = " ".join(ids)
    return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(" ".join(tokens).encode()).hexdigest()


def _chunks(texts: list[str], chars: int = 2_000_000):
    """Ranges of rows holding about ``chars`` characters, to bound the memory of a step."""
    a = n = 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield a, k + 1
            a, n = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _encode_rows(path: str | None, unsplit: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known = load(path)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in _chunks(texts):
                got = encode_texts(known, texts[a:b], unsplit)
                if full:
                    yield pa.RecordBatch.from_arrays(
                        [ids[a:b], pa.array([_ids(g) for g in got], pa.list_(pa.int32()))], ["doc_id", "ids"])
                    continue
                cols = list(zip(*(_digest(tok, g) for g in got)))
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b], pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _encode_slices(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, _ = load(path)
        for batch in batches:
            got = [encode_at(tok, s) for s in batch.column("slice").to_pylist()]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "mark", "k", "slice")),
                 *(pa.array([[t[f] for t in g] for g in got], kind) for f in range(3))],
                ["doc_id", "mark", "k", "slice", "ids", "a", "b"])
    return run


def _join_doc(path: str | None, full: bool):
    def run(rows: pa.Table) -> pa.Table:
        tok, _ = load(path)
        rows = rows.sort_by("k")
        ks = rows["k"].to_pylist()
        times = ks.count(0)                     # the same row may be there several times
        keep = [j for j, k in enumerate(ks) if j == 0 or k != ks[j - 1]]
        cols = [rows[c].to_pylist() for c in ("slice", "ids", "a", "b")]
        slices = [(cols[0][j], list(zip(cols[1][j], cols[2][j], cols[3][j]))) for j in keep]
        ids = [t[0] for t in join_slices(tok, slices)]
        doc = pa.array([rows["doc_id"][0].as_py()] * times, pa.int64())
        if full:
            return pa.table([doc, pa.array([ids] * times, pa.list_(pa.int32()))], ["doc_id", "ids"])
        n, x, y = digest(tok, ids)
        return pa.table([doc, pa.array([n] * times, pa.int64()), pa.array([x] * times), pa.array([y] * times)],
                        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _encode(docs: DataFrame, id_col: str, text_col: str, path, spread: int, unsplit: int, full: bool) -> DataFrame:
    rows = doc_columns(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = TOKENS if full else RESULT
    short = rows.where(F.length("text") <= spread).mapInArrow(tidy(_encode_rows(path, unsplit, full)), schema)
    cuts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / F.lit(spread)).cast("int"))
    slices = (rows.where(F.length("text") > spread)
              .select("doc_id", F.xxhash64("text").alias("mark"), "text", F.explode(cuts).alias("k"))
              .select("doc_id", "mark", "k", F.expr(f"substring(text, k * {spread} + 1, {spread})").alias("slice"))
              .repartition("doc_id", "mark", "k"))
    parts = slices.mapInArrow(
        tidy(_encode_slices(path)),
        "doc_id long, mark long, k int, slice string, ids array<int>, a array<int>, b array<int>")
    long = parts.groupBy("doc_id", "mark").applyInArrow(_join_doc(path, full), schema)
    return short.unionByName(long)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           spread_chars: int = SPREAD_CHARS, unsplit_chars: int = UNSPLIT_CHARS) -> DataFrame:
    """doc_id, ids: token ids of every whole text, special tokens not added.

    One row per input row; repeated rows stay repeated; a null or empty text
    gives an empty list; an empty table an empty one; only the two named
    columns are read. ``path``: the tokenizer's file (None: the public one).
    """
    return _encode(docs, id_col, text_col, path, spread_chars, unsplit_chars, True)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id, text: the tokenizer's own decoding of each list of ids (null: empty)."""
    def run(batches):
        tok, _ = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([tok.decode(i or [], skip_special_tokens=False)
                                            for i in batch.column(1).to_pylist()], pa.string())],
                ["doc_id", "text"])
    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, f"doc_id {kind}, text string")


def encode_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                  spread_chars: int = SPREAD_CHARS, unsplit_chars: int = UNSPLIT_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode`` and ``decode`` in one pass, digested.

    The same defined results as ``encode``; the lists of ids stay in the task.
    """
    return _encode(docs, id_col, text_col, path, spread_chars, unsplit_chars, False)
