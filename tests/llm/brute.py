"""Brute-force versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 if d < 5 else d * 2 - 9
    return total % 10 == 0


def pii_spans(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def secret_spans(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    return sorted([(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 8]
                  + [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if m.end() - m.start() >= 16]
                  + [(m.start(), 2, m.end()) for m in HEX.finditer(t) if m.end() - m.start() >= 32])


def joined(spans, kinds) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, kinds=("EMAIL", "IP", "CARD", "PHONE")) -> str | None:
    out, end = [], 0
    for a, k, b in pii_spans(text):
        if a >= end:
            out += [text[end:a], f"[{kinds[k]}]"]
        end = max(end, b)
    return text if text is None else "".join(out) + text[end:]


def shingle_counts(text: str | None, n: int = 5) -> Counter:
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if x]
    return Counter(tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))) if w else Counter()


def near_classes(rows: list[tuple[int, str | None]], similar: float = 0.8) -> dict[int, int]:
    """doc_id -> least doc_id of its class, comparing all that share a shingle."""
    sets = [shingle_counts(t) for _, t in rows]
    size = [sum(s.values()) for s in sets]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    where = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter()
        for k, v in s.items():
            for j, u in where[k]:
                shared[j] += min(u, v)
            where[k].append((i, v))
        for j, m in shared.items():
            if m / (size[i] + size[j] - m) >= similar:
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    return {d: min(g) for g in groups.values() for d in g}


def n_words(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mix_targets(size: dict, weights=(5, 2, 1)) -> dict:
    names = sorted(s for s in size if s is not None) + [s for s in size if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target = {s: 1.5 * sum(size.values()) * w[s] / sum(w.values()) for s in names}
    for _ in range(1000):
        over = sum(max(0.0, target[s] - 2 * size[s]) for s in names)
        if over < 1e-9:
            break
        target = {s: min(target[s], 2.0 * size[s]) for s in names}
        room = [s for s in names if target[s] < 2 * size[s]]
        for s in room:
            target[s] += over * w[s] / sum(w[r] for r in room)
    return target


def mix_copies(rows: list[tuple], seed: int = 17) -> list[int]:
    """How often each (doc_id, source, text) is drawn."""
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += n_words(t)
    target = mix_targets(size)
    out = [0] * len(rows)
    for s in size:
        mine = sorted((hashlib.md5(f"{seed}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(),
                       n_words(rows[i][2]), i) for i in range(len(rows)) if rows[i][1] == s)
        rounds = min(2, int((target[s] + 1e-6) // size[s])) if size[s] else 0
        rest = target[s] - rounds * size[s]
        gone = 0
        for _, n, i in mine:
            out[i] = rounds + (1 if rest > 1e-6 and 2 * gone + n <= 2 * rest else 0)
            gone += n
    return out


def language(texts: list[str | None], model: dict[str, bytes], level: int) -> list[tuple[str, int]]:
    """(language, margin in bytes) by compressing each text with each dictionary."""
    import zstandard as z
    out = []
    for t in texts:
        if not any(c.isalpha() for c in t or ""):
            out.append(("und", 0))
            continue
        sizes = []
        for name, raw in model.items():
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            c = z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)
            sizes.append((len(c.compress(t.lower().encode())), name))
        sizes.sort()
        out.append((sizes[0][1], sizes[1][0] - sizes[0][0]))
    return out


def language_kept(texts: list[str | None], model: dict[str, bytes], level: int, min_margin: int, min_share: float) -> list[bool]:
    """Whether each text's margin reaches the least one, in bytes and as a share of its smallest compressed size."""
    import zstandard as z
    out = []
    for t in texts:
        if not any(c.isalpha() for c in t or ""):
            out.append(False)
            continue
        sizes = []
        for raw in model.values():
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            c = z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)
            sizes.append(len(c.compress(t.lower().encode())))
        sizes.sort()
        out.append(sizes[1] - sizes[0] >= max(min_margin, min_share * sizes[0]))
    return out


def crc_fold(doc_id, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def digest(tok, text: str | None) -> tuple[int, str, str]:
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def spelling_words(rows, drop: int = 97, least: int = 5, occurrences: int = 3) -> dict[str, int]:
    """The words of (doc_id, text) rows and how often they occur, some occurrences short of one code point."""
    n: Counter = Counter()
    low = {i: i + 32 for i in range(65, 91)}
    for d, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(low)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            if h % drop == 0:
                i = h % len(r)
                r = r[:i] + r[i + 1:]
            n[r] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= occurrences}


def near_words(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelling(rows, ratio: float = 2, **how) -> list[tuple]:
    """(word, form, root, n, n_near, form_n), comparing every word with every other."""
    n = spelling_words(rows, **how)
    out, form, count = [], {}, {}
    for w in n:
        near = [x for x in n if near_words(w, x)]
        count[w] = len(near)
        best = min(near, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], count[w], n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def fim(doc_id, text: str | None, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) by plain slicing."""
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, t
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return len(units), form, len(p), len(m), out


def shingle_set(text: str | None, n: int = 5) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def jaccard_components(rows, percent: int = 80, n: int = 5) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows, comparing all that share a shingle."""
    sets = [shingle_set(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    where = defaultdict(list)
    for i, s in enumerate(sets):
        both: Counter = Counter()
        for e in s:
            both.update(where[e])
            where[e].append(i)
        for j, k in both.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                up[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)
