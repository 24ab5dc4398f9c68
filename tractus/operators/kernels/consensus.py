"""Evidence that joins methods: distance correlations, missing data, split tracts and support shares."""

from __future__ import annotations

import itertools
import math

import numpy as np

from . import threeseq
from .common import Candidate, Options, Variable, inside

#: Runs of missing sites that count as erased.
LEAST_GAP = 10


def pearson6(x, y) -> tuple[float, float]:
    """Correlation of six pairs of numbers and its two-sided probability (Student's t with four degrees of freedom, in
    closed form); 0 and 1 where one of them does not vary."""
    x, y = np.asarray(x, float) - np.mean(x), np.asarray(y, float) - np.mean(y)
    norm = math.sqrt((x @ x) * (y @ y))
    if not norm > 0:
        return 0.0, 1.0
    r = max(-1.0, min(1.0, float(x @ y) / norm))
    if abs(r) == 1:
        return r, 0.0
    t = abs(r) * math.sqrt(4 / (1 - r * r))
    u = t / math.sqrt(1 + t * t / 4)
    return r, max(0.0, 1 - 2 * (3 / 8 * u * (1 - u * u / 12)))


def relabelled(profile: np.ndarray, own: np.ndarray) -> tuple[float, float, tuple[int, int, int]]:
    """profile, own: distances to three members in two regions (2 x 3). Best correlation of own with the profile over all
    labellings of the members, its probability, and the labelling; ties go to the one that comes first."""
    best = None
    for order in itertools.permutations(range(3)):
        r, p = pearson6(profile[:, order].ravel(), own.ravel())
        if best is None or r > best[0]:
            best = (r, p, order)
    return best


def gaps(row: np.ndarray, least: int = LEAST_GAP) -> np.ndarray:
    """Which sites lie in runs of at least so many missing ones."""
    miss = row == 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], miss.astype(int), [0]])))
    out = np.zeros(len(row), bool)
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a >= least:
            out[a:b] = True
    return out


def pieces(begin: int, end: int, erased: np.ndarray) -> list[tuple[int, int]]:
    """A tract without its erased sites: the ranges that are left, in the tract's order."""
    n = len(erased)
    sites = (np.arange(begin - 1, begin - 1 + ((end - begin) % n) + 1)) % n
    keep = ~erased[sites]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(int), [0]])))
    return [(int(sites[a]) + 1, int(sites[b - 1]) + 1) for a, b in zip(edges[::2], edges[1::2])]


def split(c: Candidate, states: np.ndarray, o: Options) -> Candidate | None:
    """A 3SEQ tract that runs through erased data: its best piece alone, scored by the excursion of that piece; None
    where no piece passes. A tract without erased data stays as it is."""
    erased = np.any([gaps(r) for r in states], axis=0)
    parts = pieces(c.begin, c.end, erased)
    if len(parts) <= 1 and not erased[inside(len(erased), c.begin, c.end)].any():
        return c
    v = Variable(states)
    one, two = next((a, b) for t, a, b, _, _ in threeseq.TARGETS if t == c.recombinant)
    step = v.match[one] - v.match[two]
    plus, minus = int((step == 1).sum()), int((step == -1).sum())
    best = None
    for b, e in parts:
        change = int(step[inside(v.length, b, e)[v.pos - 1]].sum()) if b != e else 0
        p, m, drop = (plus, minus, -change) if change < 0 else (minus, plus, change)
        if drop > 1 and p and m:
            raw = threeseq.probability(p, m, drop)[0]
            if 0 < raw and (best is None or raw < best[0]):
                best = (raw, b, e)
    if best is None or threeseq.corrected(best[0], o) > o.cutoff:
        return None
    raw, b, e = best
    return Candidate(c.method, c.recombinant, c.major, c.minor, b, e, raw, threeseq.corrected(raw, o), c.sites, c.detail | {"split": True})


def support_shares(states: np.ndarray, begin: int, end: int) -> tuple[float, float]:
    """Of rows recombinant, major, minor: share of sites inside where only the minor parent matches the recombinant, and
    outside where only the major one does, among sites where exactly one parent matches."""
    v = Variable(states)
    held = inside(v.length, begin, end)[v.pos - 1]
    major, minor = v.match[0] == 1, v.match[1] == 1
    one = major != minor
    share = lambda hit, where: float((hit & where & one).sum() / max(1, (where & one).sum()))
    return share(minor, held), share(major, ~held)
