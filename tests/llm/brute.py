"""Slow forms of the operators, written apart from them."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return [w.lower() for w in WORD.findall((text or "").encode())]


def shingles(text, k):
    w = words(text)
    if not w:
        return set()
    if len(w) < k:
        return {tuple(w)}
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def groups(rows, k, percent=80):
    """{doc_id: (set size, least reachable id)} for rows of distinct ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    above = {i: i for i, _ in rows}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i, _ in rows}


def contained(text, items, k=5, percent=80):
    """Ids of the items that the text holds."""
    own = shingles(text, k)
    out = []
    for i, t in items:
        s = shingles(t, k)
        if s and 100 * len(s & own) >= percent * len(s):
            out.append(i)
    return sorted(out)


def line_dedup(texts, least=10):
    def key(line):
        line = line.strip(" \t\n\x0b\f\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    split = [(t or "").split("\n") for t in texts]
    held = Counter(k for ls in split for k in {key(x) for x in ls})
    bad = {k for k, n in held.items() if k and n >= least}
    return ["\n".join(x for x in ls if key(x) not in bad) for ls in split]


def katz(rows, learns, discounts):
    """(id, tokens, known, N, base, score) of each text, and the sum of a context's probabilities."""
    texts = [words(t) + [None] for _, t in rows]
    one, two, context = Counter(), Counter(), Counter()
    for (i, _), t in zip(rows, texts):
        if learns(i):
            for h, w in zip([0, *t], t):
                one[w] += 1
                two[h, w] += 1
                context[h] += 1
    n, v = sum(one.values()), len(one)
    whole = n + 0.1 * (v + 1)
    of = Counter(two.values())
    d = discounts([of[r] for r in range(1, 7)])
    factor = lambda r: d[r] if r <= 5 else 1.0
    low = lambda w: (one.get(w, 0) + 0.1) / whole
    after = defaultdict(list)
    for (h, w), r in two.items():
        after[h].append((w, r))
    alpha = {
        h: (1 + sum((1 - factor(r)) * r for _, r in a)) / (context[h] + 1) / (1 - sum(low(w) for w, _ in a))
        for h, a in after.items()
    }

    def p(h, w):
        r = two.get((h, w))
        return factor(r) * r / (context[h] + 1) if r else alpha.get(h, 1.0) * low(w)

    sums = [sum(p(h, w) for w in one) + alpha[h] * 0.1 / whole for h, _ in context.most_common(3)]
    out = [
        (
            i, len(t), sum(w in one for w in t), n, sum(math.log10(low(w)) for w in t),
            sum(math.log10(p(h, w)) for h, w in zip([0, *t], t)),
        )
        for (i, _), t in zip(rows, texts)
    ]
    return out, sums


def crc_mod(i, of):
    return zlib.crc32(str(i).encode()) % of
