"""Plain versions of the operators, for small tables."""

import hashlib
import itertools
import random

WORDS = "al bo ci du el fo gi ha iv jo ka lu me no op pa qu ro su ti ur va wo xe yo za".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def corpus(seed=1):
    """(doc_id, text): near and exact copies, shared passages, nulls, empties, short and long texts."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(30, 120)) for _ in range(12)]
    texts = list(base)
    for t in base[:5]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
        texts.append(t)
        texts.append(t.upper())
    passage = sentence(rng, 40)
    texts += [sentence(rng, 15) + " " + passage + " " + sentence(rng, 9) for _ in range(6)]
    texts += [None, "", "   \n\t ", "one", "one two three", "one two three", "é" * 70, "é" * 60 + "x", "a " * 90, "ab" * 80, sentence(rng, 6000)]
    texts.append(texts[-1][:9000] + " end")
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(rows, over=85):
    s = {i: shingles(t) for i, t in rows}
    edges = [(a, b) for a, b in itertools.combinations(s, 2) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= over * len(s[a] | s[b])]
    r = roots(s, edges)
    return {i: (len(s[i]), r[i], r[i] == i) for i in s}


def repeats(rows, width, words):
    """doc -> (symbols, removed, sha of the rest)."""
    out, first = {}, {}
    for i, t in sorted(rows):
        s = (t or "").encode()
        s = s.split() if words else s
        gone, new = set(), []
        for p in range(len(s) - width + 1):
            k = tuple(s[p : p + width])
            if k in first:
                gone.update(range(p, p + width))
            elif words:
                first[k] = i
            else:
                new.append(k)
        for k in new:
            first[k] = i
        kept = [s[k : k + 1] if not words else s[k] for k in range(len(s)) if k not in gone]
        out[i] = (len(s), len(gone), hashlib.sha256((b" " if words else b"").join(kept)).hexdigest())
    return out
