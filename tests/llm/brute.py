"""Plain-Python results of the operators' contracts, for comparison in tests."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def pieces(docs: dict[int, str | None], path: str, capacity: int = 2048) -> dict[tuple[int, int], tuple[int, int, int]]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    out = {}
    for doc, text in docs.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out[doc, i] = (at, len(part), zlib.crc32(part.tobytes()))
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    text, found = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    w, text = words(text), text or ""
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, hit = Counter(tri), set()
    for i, t in enumerate(tri):
        if n[t] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def shingles(text: str | None, k: int) -> set:
    w = words((text or "").translate(ASCII_LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def components(docs: dict[int, str | None], k: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t, k) for d, t in docs.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where: dict = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    for d in sets:
        near: Counter = Counter()
        for x in sets[d]:
            near.update(o for o in where[x] if o > d)
        for o, c in near.items():
            if 100 * c >= percent * (len(sets[d]) + len(sets[o]) - c):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def base_scores(docs: dict[int, str | None]) -> dict[int, tuple[bool, int, int, int, float]]:
    tokens = {d: [*words((t or "").translate(ASCII_LOWER)), None] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in docs}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, ws in tokens.items()}


def tiktoken_ids(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("brute", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def licenses(text: str | None) -> tuple[int, int, int | None, int | None, str]:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    at, labels = [], set()
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))
