"""Plain Python versions of the operators, for small fixtures."""

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND_ORDER = {"assign": 0, "access": 1, "hex": 2}


def repetition(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, shares by n, dup line share)."""
    text = text or ""
    words = WORD.findall(text)

    def windows(n):
        return [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]

    count, inside = Counter(windows(5)), set()
    for i, w in enumerate(windows(5)):
        if count[w] > 1:
            inside |= set(range(i, i + 5))
    shares = {}
    for n in range(5, 11):
        seen, covered = set(), set()
        for i, w in enumerate(windows(n)):
            if w in seen:
                covered |= set(range(i, i + n))
            seen.add(w)
        shares[n] = sum(len(words[i]) for i in covered) / max(1, sum(map(len, words)))
    seen, dup, dup_chars, all_chars = set(), 0, 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            all_chars += len(line)
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + len(line)
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), shares, dup_chars / max(1, all_chars))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(s):
    return re.sub("[^0-9]", "", s)


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(_digits(m)) <= 15),
]


def personal(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in PERSONAL for m in re.finditer(p, text or "") if ok(m[0])]


ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_spans(text):
    text, spans = text or "", []
    spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def sha(items):
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < n else frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def near_components(texts):
    """{id: smallest id reachable} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def poisson_count(doc_id, mean, seed=0):
    u = int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    if mean == 0:
        return 0
    total, k = 0.0, 0
    while True:
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        if u < total:
            return k
        k += 1


def mixing_means(rows, weights, other, epochs=1.0):
    """{group: mean} of (source, text) rows; None is the group of all other sources."""
    chars = Counter()
    for source, text in rows:
        chars[source if source in weights else None] += len(text or "")
    share = {g: weights.get(g, other) for g, n in chars.items() if n}
    return {g: epochs * share[g] / sum(share.values()) * sum(chars.values()) / n if n else epochs for g, n in chars.items()}
