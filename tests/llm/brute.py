"""Plain-Python statements of what the corpus operators return."""
import hashlib
import re
from collections import Counter, defaultdict


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def near_components(docs, k, percent=80):
    """doc_id -> least doc_id reachable, by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets}


def contamination(docs, items, n=13):
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            grams[tuple(w[i:i + n])].add(str(item))
    sizes = {len(g) for g in grams}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for s in sizes:
            for i in range(len(w) - s + 1):
                if owners := grams.get(tuple(w[i:i + s])):
                    found |= owners
                    hit |= set(range(i, i + s))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def repeats(docs, length):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen = Counter()
    for _, t in docs:
        b = (t or "").encode()
        seen.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = {}
    for doc, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    """[(kind, start, end)] of the base patterns."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    find = lambda p, ok: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])]
    kinds = {
        "email": find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": find(r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and _luhn(digits(s))),
        "phone": find(r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return [(k, a, b) for k, found in kinds.items() for a, b in found]
