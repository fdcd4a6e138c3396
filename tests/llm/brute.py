"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def unigram(rows):
    """{doc_id: (n_tokens, n_known, base)} and the number of training tokens."""
    counts = Counter()
    for doc_id, text in rows:
        if fold(doc_id) != 1:
            counts.update([*words(text), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for doc_id, text in rows:
        tokens = [*words(text), None]
        out[doc_id] = (len(tokens), sum(t in counts for t in tokens),
                       sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
    return out, n


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def near_components(rows, k, percent=80):
    sets = {d: shingles(t, k) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def exact_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return groups


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
       "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
       "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k in PII for m in re.finditer(PII[k], text or "") if holds(k, m.group())]


def paragraphs(text):
    return set(re.findall(r"[^ \t\n\x0b\f\r]+(?:[ \t]+[^ \t\n\x0b\f\r]+){0,15}", text))


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0
