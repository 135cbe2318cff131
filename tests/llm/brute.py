"""Plain restatements of the operators, for small inputs."""

from collections import Counter
from hashlib import sha256


def windows_earlier(rows, length):
    """rows (id, text) -> id: (n_words, n_removed, kept_sha256)."""
    seen, out, rows = set(), {}, sorted((i, t or "") for i, t in rows)
    for i, t in rows:
        w = t.encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            k = tuple(w[a : a + length])
            if k in seen:
                gone[a : a + length] = [True] * length
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), sha256(kept).hexdigest())
    return out


def bytes_elsewhere(rows, length):
    """rows (id, text) -> sorted (id, n_bytes, n_removed, n_spans, kept_sha256)."""
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[a : a + length] for _, b in data for a in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for a in range(len(b) - length + 1):
            if count[b[a : a + length]] > 1:
                gone[a : a + length] = [True] * length
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((i, len(b), sum(gone), spans, sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


class Sets:
    """Union-find."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near(rows, n=5, threshold=0.8):
    """rows (id, text) -> id: (class_id, n_links)."""
    grams = {}
    for i, t in rows:
        w = (t or "").encode().split()
        grams[i] = frozenset(tuple(w[a : a + n]) for a in range(max(1, len(w) - n + 1)))
    s, links = Sets(), Counter()
    ids = sorted(grams)
    for x in ids:
        s.find(x)
        for y in ids:
            if y > x and jaccard(grams[x], grams[y]) >= threshold:
                s.join(x, y)
                links[x] += 1
                links[y] += 1
    return {i: (s.find(i), links[i]) for i in ids}


def lines(rows, k=5, threshold=0.8):
    """rows (id, text) -> id: kept text."""
    at, rows = {}, sorted((i, t or "") for i, t in rows)
    for i, t in rows:
        for n, line in enumerate(t.split("\n")):
            if line.strip(" \t\r\f\v"):
                at.setdefault(line, []).append((i, n))
    grams = {x: frozenset(x[a : a + k] for a in range(max(1, len(x) - k + 1))) for x in at}
    s, every = Sets(), sorted(at)
    for a in every:
        s.find(a)
        for b in every:
            if a < b and jaccard(grams[a], grams[b]) >= threshold:
                s.join(a, b)
    first = {}
    for x in every:
        r = s.find(x)
        first[r] = min(first.get(r, (1 << 62, 0)), min(at[x]))
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if x not in at or first[s.find(x)] == (i, n)) for i, t in rows}


def share_out(sizes, weights, most):
    """100 % of all sizes by weight; targets stop at ``most`` times their size and the excess is shared again."""
    targets, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = most * float(sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in over]
    return targets


def cheapest(patterns, targets, most):
    """Least cost of the greatest flow, by trying all: patterns (members, words) to quotas, copy number c costs (c - 1) squared a word."""
    from itertools import product

    best = None
    options = []
    for members, words in patterns:
        options.append([x for x in product(*[range(most * words + 1) for _ in members]) if sum(x) <= most * words])
    for pick in product(*options):
        got = dict.fromkeys(targets, 0)
        cost = 0
        for (members, words), x in zip(patterns, pick):
            n = sum(x)
            cost += sum(c * c * min(words, max(0, n - c * words)) for c in range(most))
            for s, k in zip(members, x):
                got[s] += k
        if all(got[s] <= targets[s] for s in targets):
            key = (-sum(got.values()), cost)
            best = key if best is None or key < best else best
    return -best[0], best[1]
