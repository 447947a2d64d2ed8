"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re
from fractions import Fraction

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def phrase_places(text, phrases):
    w = alnum_words(text)
    found = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), sorted(found)


def line_dedup(docs):
    """docs: (id, text); None ids are greatest. Returns for each row (lines, dropped, kept text)."""
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOW)
    rank = lambda d: math.inf if d is None else d
    holders = collections.defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(rank(d))
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == rank(d)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def contamination(text, items):
    w, hit, found = alnum_words(text), set(), set()
    for i, t in items:
        x = alnum_words(t)
        n = min(10, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[k : k + n]:
                    hit.update(range(j, j + n))
                    found.add(i)
    return len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)


def shingles(text, k):
    w = space_words((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(docs, k, percent):
    """docs: (id, text) with ids of their own. Returns id -> (size, component)."""
    sets = {d: shingles(t, k) for d, t in docs}
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def pagerank(edges, seeds, damping):
    """edges: {(src, dst): links}; seeds: {host: mass}. Ranks after so many rounds that nothing changes; who has no link keeps its rank."""
    out = collections.Counter()
    for (s, _), n in edges.items():
        out[s] += n
    hosts = {h for e in edges for h in e} | set(seeds)
    edges = dict(edges) | {(h, h): 1 for h in hosts if not out[h]}
    out.update({h: 1 for h in hosts if not out[h]})
    ranks = dict(seeds)
    for _ in range(100):
        new = collections.defaultdict(float, {h: (1 - damping) * m for h, m in seeds.items()})
        for (s, t), n in edges.items():
            new[t] += damping * ranks.get(s, 0.0) * n / out[s]
        ranks = dict(new)
    return ranks


def shares(sizes, weights=(5, 2, 1), cap=3):
    """Targets of the mix in fractions: water is poured by weight, and what is above a cap is poured again."""
    left, out, full = Fraction(sum(sizes)), [Fraction(0)] * len(sizes), set()
    while left > 0 and len(full) < len(sizes):
        open_ = [i for i in range(len(sizes)) if i not in full]
        part = {i: left * weights[i % 3] / sum(weights[j % 3] for j in open_) for i in open_}
        over = [i for i in open_ if part[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = part[i]
            break
        for i in over:
            out[i] = Fraction(cap * sizes[i])
            left -= out[i]
            full.add(i)
    return [float(x) for x in out]


def cheapest_flow(offers, reach, quota):
    """(amount, cost) of the cheapest maximal flow, by Bellman and Ford, one unit at a time."""
    arcs = {}
    for p, levels in enumerate(offers):
        for r, n in enumerate(levels):
            arcs["root", ("offer", p, r)] = [n, r]
            arcs[("offer", p, r), ("p", p)] = [n, 0]
        for s, n in reach[p].items():
            arcs[("p", p), ("s", s)] = [n, 0]
    for s, n in enumerate(quota):
        arcs[("s", s), "sink"] = [n, 0]
    for (a, b), (_, c) in list(arcs.items()):
        arcs[b, a] = [0, -c]
    amount = total = 0
    while True:
        far, via = {"root": 0}, {}
        for _ in range(len(arcs)):
            for (a, b), (n, c) in arcs.items():
                if n > 0 and a in far and far[a] + c < far.get(b, math.inf):
                    far[b], via[b] = far[a] + c, a
        if "sink" not in far:
            return amount, total
        v = "sink"
        while v != "root":
            arcs[via[v], v][0] -= 1
            arcs[v, via[v]][0] += 1
            v = via[v]
        amount, total = amount + 1, total + far["sink"]
