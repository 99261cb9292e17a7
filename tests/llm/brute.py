"""Plain Python versions of the operators' contracts."""

import hashlib
import re
from collections import Counter

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(SPACES, text or "")


def decontaminate(docs, items):
    """[(n_words, n_hit, items)] of texts, for (item_id, text) items."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = cut(text)
        if item is not None:
            for i in range(max(1, len(w) - 7) if w else 0):
                windows.setdefault(tuple(w[i : i + 8]), set()).add(item)
    out = []
    for text in docs:
        w, hit, found = cut(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out.append((len(w), len(hit), sorted(found)))
    return out


def secrets(text):
    """Base spans as (start, kind's place, end, kind)."""
    kinds = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
        "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
    }
    return sorted(
        (m.start(), k, m.end(), name)
        for k, (name, (pattern, group, least)) in enumerate(kinds.items())
        for m in pattern.finditer(text or "")
        if len(m[group]) >= least
    )


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    count = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


def simhash(text):
    w = words((text or "").translate(LOWER))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """doc_id -> smallest reachable, for {doc_id: fingerprint}."""
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def substrings(docs, size=20):
    """[(n_words, n_removed, sha256)] of texts in order of rank."""
    seen, out = set(), []
    for text in docs:
        w = words(text)
        cover = [False] * len(w)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if k in seen:
                cover[i : i + size] = [True] * size
            seen.add(k)
        kept = [x for x, c in zip(w, cover) if not c]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out
