"""Plain single-machine versions of the operators' contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def shingles(text, size=4):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near_groups(rows, size=4, percent=80):
    """(doc_id, set size, component) per row; rows are (doc_id, text)."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    return [(doc, len(s), min(least[find(i)], default=None) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def without_repeats(texts, length=400):
    """(bytes kept, spans) per text."""
    values = [(t or "").encode() for t in texts]
    names = [[hashlib.blake2b(v[p:p + length], digest_size=12).digest() for p in range(len(v) - length + 1)] for v in values]
    seen = Counter(n for of in names for n in of)
    out = []
    for v, of in zip(values, names):
        gone, to = bytearray(len(v)), 0
        for p, n in enumerate(of):
            if seen[n] > 1:
                gone[max(p, to):p + length] = b"\1" * (p + length - max(p, to))
                to = p + length
        spans = sum(1 for q in range(len(v)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((bytes(b for b, g in zip(v, gone) if not g), spans))
    return out


class Katz:
    """A bigram model from (text) training rows, by the formulas of the operator's docstring."""

    def __init__(self, texts, k, large, discounts):
        self.k, self.large = k, large
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            w = words(t) + [None]
            self.uni.update(w)
            self.bi.update(zip([0] + w[:-1], w))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.d1, self.d2 = discounts(Counter(self.uni.values())), discounts(Counter(self.bi.values()))
        self.unknown = sum(self.taken(c, self.d1) for c in self.uni.values()) / self.n if self.n else 1.0
        self.after, self.count = defaultdict(list), Counter()
        for (h, w), r in self.bi.items():
            self.after[h].append((w, r))
            self.count[h] += r
        self.alpha = {h: sum(self.taken(r, self.d2) for _, r in seen) / self.count[h] / (1 - sum(self.p1(w) for w, _ in seen))
                      for h, seen in self.after.items()}

    def taken(self, r, d):
        return self.large if r > self.k else d[r]

    def p1(self, w):
        return (self.uni[w] - self.taken(self.uni[w], self.d1)) / self.n if self.uni.get(w) else self.unknown

    def p2(self, h, w):
        if h not in self.count:
            return self.p1(w)
        r = self.bi.get((h, w), 0)
        return (r - self.taken(r, self.d2)) / self.count[h] if r else self.alpha[h] * self.p1(w)

    def score(self, text):
        w = words(text) + [None]
        return (len(w), sum(x in self.uni for x in w), sum(math.log10((self.uni[x] + 1) / (self.n + self.v + 1)) for x in w),
                sum(math.log10(self.p2(h, x)) for h, x in zip([0] + w[:-1], w)))


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def edited(text, following):
    k = len(text) // 2
    return text[:len(text) - k] + following[:k]


def sha(value):
    return hashlib.sha256(value.encode() if isinstance(value, str) else value).hexdigest()
