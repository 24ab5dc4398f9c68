"""The rounds of one alignment over lists, triplet by triplet: what the tables of rounds must give."""

from __future__ import annotations

from dataclasses import replace
from itertools import combinations

import numpy as np

from tractus.operators.events import METHOD_ORDER
from tractus.operators.kernels import consensus, outlier
from tractus.operators.kernels.common import inside
from tractus.operators.scan import PRIMARY, detect


def overlap(b1, e1, b2, e2, length):
    x, y = inside(length, b1, e1), inside(length, b2, e2)
    return 2 * (x & y).sum() / (x.sum() + y.sum())


class Cycle:
    def __init__(self, states, o, methods=PRIMARY):
        n = len(states)
        self.rows, self.origin, self.born = {i: np.array(s, np.int8) for i, s in enumerate(states)}, {i: i for i in range(n)}, {}
        self.length, self.n = len(states[0]), n
        self.o = replace(o, tests=max(1, n * (n - 1) * (n - 2) // 6) if o.correction else 1)
        self.methods, self.known, self.events, self.ran, self.dirty = methods, {}, [], [], None

    def usable(self, row):
        return (row > 0).sum() >= max(5, self.o.rdp_window, -(-self.length // 100))

    def find(self, t, methods, split):
        live = sorted(i for i in self.rows if self.usable(self.rows[i]))
        held = np.stack([self.rows[i] for i in live])
        at, fourth = [live.index(i) for i in t], None
        if "SISCAN" in methods:
            k = outlier.nearest(at, held, *outlier.similarities(held), [self.origin[i] for i in live])
            fourth = None if k is None else held[k]
        found = detect(held[at], self.o, methods, fourth)
        return [s for f in found if (s := consensus.split(f, held[at], self.o) if split and f.method == "3SEQ" else f)]

    def round(self, number):
        split = bool(self.events)
        live = sorted(i for i in self.rows if self.usable(self.rows[i]))
        three = [t for t in combinations(live, 3) if len({self.origin[i] for i in t}) == 3]
        run = three if self.dirty is None else [t for t in three if set(t) & self.dirty]
        self.scheduled = len(three)
        self.known = {t: s for t, s in self.known.items() if not set(t) & (self.dirty or set())}
        if number == 2:
            for t, s in self.known.items():
                self.known[t] = [x for x in s if x.method != "3SEQ"] + self.find(t, [m for m in self.methods if m == "3SEQ"], True)
        for t in run:
            if found := self.find(t, self.methods, split):
                self.known[t] = found
        self.ran.append(run)
        used = {i for t, s in self.known.items() if s for i in t}
        for i in [i for i, b in self.born.items() if i in self.rows and b == number - 1 and i not in used]:
            del self.rows[i]
        signals = [(s.corrected_p, s.local_p, METHOD_ORDER.index(s.method), t, s) for t, found in self.known.items() for s in found]
        return sorted(signals, key=lambda x: (*x[:4], x[4].begin, x[4].end))

    def erase(self, row, begin, end, number):
        held = inside(self.length, begin, end)
        piece = np.where(held, self.rows[row], 0)
        self.rows[row] = np.where(held, 0, self.rows[row])
        self.dirty = {row}
        if self.usable(piece) and not any((r == piece).all() for r in self.rows.values()):
            new = self.n + number
            self.rows[new], self.origin[new], self.born[new] = piece, self.origin[row], number
            self.dirty.add(new)

    def run(self, most=64):
        for number in range(1, most + 1):
            found = self.round(number)
            chosen = next((t for t in found if (self.rows[t[3][t[4].recombinant]][inside(self.length, t[4].begin, t[4].end)] > 0).any()), None)
            if chosen is None:
                break
            *_, t, s = chosen
            own = {self.origin[i] for i in t}
            backing = [x for x in found if len(own & {self.origin[i] for i in x[3]}) >= 2 and overlap(x[4].begin, x[4].end, s.begin, s.end, self.length) > 0.3]
            role = lambda k, t=t: self.origin[t[k]]
            self.events.append((number, s.method, role(s.recombinant), role(s.major), role(s.minor), s.begin, s.end, round(s.corrected_p, 12), len(backing), ",".join(m for m in METHOD_ORDER if any(x[4].method == m for x in backing)), self.scheduled, len(self.ran[-1])))
            self.erase(t[s.recombinant], s.begin, s.end, number)
        return self.events
