"""How well two graphs match: the injective mapping of variables under which most triples agree. Pure Python.

Triples that count: a concept of each variable, an attribute for each constant, a relation for each edge between
variables, and the top. Hill climbing from a greedy start and seeded restarts gives a mapping, the same on every run; where
simple counts don't show that none is better, branch and bound goes on from it until the best is found, in at most NODES
steps. ``proved`` says whether it was; else the number is a lower bound.
"""

from __future__ import annotations

import random
from collections import Counter
from typing import NamedTuple

from .penman import INSTANCE

RESTARTS = 2
#: Most steps of branch and bound for a pair, and most variables it is tried for.
NODES, MOST = 3000, 400


class Counts(NamedTuple):
    matched: int
    n_pred: int
    n_gold: int
    proved: bool = True


class _Parts:
    def __init__(self, triples, top: str | None) -> None:
        self.vars = list(dict.fromkeys(s for s, r, _ in triples if r == INSTANCE))
        at = {v: i for i, v in enumerate(self.vars)}
        self.unary: list[Counter] = [Counter() for _ in self.vars]
        self.edges: Counter = Counter()
        for s, r, t in triples:
            if s not in at:
                continue
            if r == INSTANCE:
                self.unary[at[s]][("concept", (t or "").lower())] += 1
            elif t in at:
                self.edges[(r.lower(), at[s], at[t])] += 1
            else:
                self.unary[at[s]][(r.lower(), (t or "").lower())] += 1
        top = top if top in at else (self.vars[0] if self.vars else None)
        if top is not None:
            self.unary[at[top]][("top", "")] += 1
        self.total = sum(sum(u.values()) for u in self.unary) + sum(self.edges.values())


def match(pred, gold, pred_top: str | None = None, gold_top: str | None = None, seed: int = 0) -> Counts:
    """Matched triples of the best mapping found, and the triples of both graphs."""
    a, b = _Parts(pred, pred_top), _Parts(gold, gold_top)
    swap = len(a.vars) > len(b.vars)
    x, y = (b, a) if swap else (a, b)
    n, m = len(x.vars), len(y.vars)
    if not n:
        return Counts(0, a.total, b.total)
    single = [[0] * m for _ in range(n)]
    holders: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for j, v in enumerate(y.unary):
        for key, k in v.items():
            holders.setdefault(key, []).append((j, k))
    for i, u in enumerate(x.unary):
        for key, k in u.items():
            for j, k2 in holders.get(key, ()):
                single[i][j] += min(k, k2)
    # what a pair of mapped variables gains: edges of one role between both
    by_role: dict[str, list] = {}
    for (r, s, t), k in y.edges.items():
        by_role.setdefault(r, []).append((s, t, k))
    double: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
    for (r, s, t), k in x.edges.items():
        for s2, t2, k2 in by_role.get(r, ()):
            gain = min(k, k2)
            if s == t:
                if s2 == t2:
                    single[s][s2] += gain
                continue
            if s2 == t2:
                continue
            for p, q in (((s, s2), (t, t2)), ((t, t2), (s, s2))):
                d = double.setdefault(p, {})
                d[q] = d.get(q, 0) + gain

    def gain_of(i: int, j: int, to: list[int]) -> int:
        return single[i][j] + sum(g for (k, l), g in double.get((i, j), {}).items() if to[k] == l)

    # variables of one name and concept begin together; no mapping matches more than what both graphs hold of each kind
    at = {v: j for j, v in enumerate(y.vars)}
    start = [at[v] if v in at and single[i][at[v]] else -1 for i, v in enumerate(x.vars)]
    bound = sum((_kinds(x) & _kinds(y)).values())
    best, proved = _climb(n, m, single, double, gain_of, seed, start, bound), True
    if best < bound:
        best, proved = _prove(n, m, single, double, best)
    return Counts(best, a.total, b.total, proved)


def _kinds(p: _Parts) -> Counter:
    """How often a graph holds each concept, attribute and role."""
    out: Counter = Counter()
    for u in p.unary:
        out.update(u)
    for (r, _, _), k in p.edges.items():
        out["edge", r] += k
    return out


def _prove(n: int, m: int, single, double, best: int) -> tuple[int, bool]:
    """(best score, whether it is proved) by branch and bound from a score that is known to be reached.

    The bound of a partial mapping: what each variable left can gain at most, with edges to mapped variables in full and half
    of those to variables that are left too, for these count at both ends.
    """
    if n > MOST:
        return best, False
    near: list[dict[int, dict[int, dict[int, int]]]] = [{j: {} for j in range(m) if single[i][j]} for i in range(n)]
    for (i, j), gains in double.items():
        own = near[i].setdefault(j, {})
        for (k, l), g in gains.items():
            own.setdefault(k, {})[l] = g
    to, used = [-2] * n, [False] * m  # -2: not decided, -1: mapped to nothing
    steps = 0

    def options(i: int) -> list[tuple[float, int, int]]:
        """(most it can gain, what it gains at once, variable of the other graph) of the ways to map a variable."""
        out = [(0.0, 0, -1)]
        for j, around in near[i].items():
            if used[j]:
                continue
            now, later = single[i][j], 0
            for k, gains in around.items():
                if to[k] >= 0:
                    now += gains.get(to[k], 0)
                elif to[k] == -2:
                    later += max((g for l, g in gains.items() if not used[l] and l != j), default=0)
            out.append((now + later / 2, now, j))
        out.sort(reverse=True)
        return out

    def walk(score: int, left: frozenset) -> bool:
        nonlocal best, steps
        best = max(best, score)
        if not left:
            return True
        steps += 1
        if steps > NODES:
            return False
        ways = {i: options(i) for i in left}
        if score + int(sum(w[0][0] for w in ways.values())) <= best:
            return True
        rest = sum(w[0][0] for w in ways.values())
        # the variable whose second way is the furthest behind its first
        i = max(left, key=lambda i: (ways[i][0][0] - ways[i][1][0] if len(ways[i]) > 1 else 1e9, ways[i][0][0], -i))
        for most, now, j in ways[i]:
            if score + int(rest - ways[i][0][0] + most) <= best:
                break
            to[i] = j
            if j >= 0:
                used[j] = True
            done = walk(score + now, left - {i})
            if j >= 0:
                used[j] = False
            to[i] = -2
            if not done:
                return False
        return True

    proved = walk(0, frozenset(range(n)))
    return best, proved


def _climb(n: int, m: int, single, double, gain_of, seed: int, start: list[int], bound: int) -> int:
    """Best score of hill climbing by moves and swaps; stops where no mapping can be better than the one found."""
    rng = random.Random(seed)
    useful = [sorted({j for j in range(m) if single[i][j]} | {j for k, j in double if k == i}) for i in range(n)]
    top = 0
    for attempt in range(1 + RESTARTS):
        to, owner = [-1] * n, [-1] * m
        if attempt == 0:
            for i, j in enumerate(start):
                if j >= 0:
                    to[i], owner[j] = j, i
        order = list(range(n))
        if attempt:
            rng.shuffle(order)
        for i in order:
            if to[i] < 0:
                free = [j for j in useful[i] if owner[j] < 0]
                if free:
                    j = max(free, key=lambda j: (gain_of(i, j, to), -abs(i - j) if attempt == 0 else rng.random()))
                    to[i], owner[j] = j, i

        def value(i: int) -> int:
            return gain_of(i, to[i], to) if to[i] >= 0 else 0

        def score() -> int:
            return sum(single[i][to[i]] for i in range(n) if to[i] >= 0) + sum(g for i in range(n) for (k, l), g in double.get((i, to[i]), {}).items() if k > i and to[k] == l)

        improved = score() < bound
        while improved:
            improved = False
            for i in range(n):
                best, move = 0, None
                here, old = value(i), to[i]
                for j in useful[i]:
                    k = owner[j]
                    if k == i:
                        continue
                    if k < 0:
                        to[i] = -1
                        change = gain_of(i, j, to) - here
                        to[i] = old
                    else:
                        to[i] = -1
                        before = here + value(k)
                        to[k] = -1
                        after = gain_of(i, j, to)
                        to[i] = j
                        if old >= 0:
                            after += gain_of(k, old, to)
                        to[i], to[k] = old, j
                        change = after - before
                    if change > best:
                        best, move = change, (j, k)
                if move:
                    j, k = move
                    if old >= 0:
                        owner[old] = -1
                    if k >= 0:
                        to[k] = old
                        if old >= 0:
                            owner[old] = k
                    to[i], owner[j] = j, i
                    improved = True
        top = max(top, score())
        if top >= bound:
            break
    return top


def scores(c: Counts) -> tuple[float, float, float]:
    """Precision, recall and F1 in percent."""
    p = 100.0 * c.matched / c.n_pred if c.n_pred else 0.0
    r = 100.0 * c.matched / c.n_gold if c.n_gold else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0
