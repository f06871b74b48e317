"""Plain Python versions of the operators, and documents that try their edges."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Columns that clash with names the operators could use inside.
EXTRA = ("key", "n", "token", "node", "comp", "hits", "words", "slot", "shard", "blob", "start", "__bucket", "rank")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def prose(seed: int, words: int, vocabulary: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary):x}o" for _ in range(words))


def frame(spark, rows):
    """Documents (id, text) with lang, source and clashing columns."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(EXTRA)) for i, t in rows], SCHEMA)


def edge_rows():
    """(id, text): null, empty and blank texts, a long one, near and exact copies, repeated rows, gaps in ids."""
    base = prose(1, 300)
    near = base.split()
    near[7], near[150] = "changed", "words"
    far = base.split()[:150] + prose(2, 150).split()
    rows = [(3, base), (5, " ".join(near)), (9, base.upper()), (11, " ".join(far)), (12, None), (13, ""), (14, " \n\t "), (15, "a"), (16, "a"),
            (17, "Ünï cödé     text É"), (21, prose(3, 60_000)), (22, "x" * 5000), (23, "one two three four"), (24, "ONE two\tthree  four"),
            (40, "tie tie tie tie tie tie tie tie tie tie tie tie")]
    return rows + [(60 + i, prose(100 + i, 40)) for i in range(30)] + [(100 + i, " ".join(near[i:])) for i in range(12)]


def contamination(docs, items, span=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(_UPPER))
        size = min(span, len(w))
        if i is not None and w:
            for s in range(len(w) - size + 1):
                windows.setdefault(tuple(w[s:s + size]), set()).add(str(i))
    sizes, out = {len(w) for w in windows}, {}
    for d, t in docs:
        w, hit, found = word.findall((t or "").translate(_UPPER)), set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                if got := windows.get(tuple(w[s:s + size])):
                    hit.update(range(s, s + size))
                    found |= got
        out[d] = (len(w), len(hit), sorted(found))
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(docs, percent=80):
    """id -> (set size, smallest id reachable by links)."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def base_secrets(text):
    text = text or ""
    rules = (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
             ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16))
    return sorted((m.start(), k, m.end(), kind) for k, (kind, pattern, group, least) in enumerate(rules)
                  for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least)


def token_ids(text, end):
    return np.array([*_TOKENIZER.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def crc(ids):
    return zlib.crc32(ids.tobytes())
