"""RDP, BootScan and SISCAN: methods that look at a triplet through sliding windows."""

from __future__ import annotations

import math

import numpy as np

from .common import LEAST_P, MEMBERS, Candidate, Options, Variable, binomial_tail, bootstrap_weights, inside, normal_tail, roles, vertical_prefix, window_sums


def tract_p(hits: int, size: int, rate: float, n: int) -> float:
    """Binomial chance of so many matches in a tract, times the number of places for it; tracts from 170 sites on are
    scaled to 169 and the probability is raised to the scale."""
    scale = 1.0
    if size >= 170:
        scale, hits, size = size / 169, round(hits * 169 / size), 169
    p = min(1.0, binomial_tail(size, hits, round(rate, 12)) * n / size)
    return max(LEAST_P, p**scale) if p > 0 else LEAST_P


def rdp(states: np.ndarray, o: Options, variable: Variable | None = None) -> list[Candidate]:
    """Windows of information-rich sites (exactly one pair agrees). The two pairs that are less alike overall are looked
    at where their count is above both others; a tract is a maximal run of such windows. Choices that are not published
    are ours: one rotation, and bounds halfway to the next information-rich site."""
    v = variable or Variable(states)
    rich = v.match.sum(axis=0) == 1
    m, pos = v.match[:, rich], v.pos[rich]
    n, h = len(pos), o.rdp_window // 2
    if n < 2 * h + 1:
        return []
    counts = np.stack([np.roll(window_sums(r, 2 * h + 1), h) for r in m])
    out = []
    for pair in np.argsort(-m.sum(axis=1), kind="stable")[1:].tolist():
        others = [q for q in range(3) if q != pair]
        over = (counts[pair] > counts[others[0]]) & (counts[pair] > counts[others[1]])
        if over.all() or not over.any():
            continue
        shift = int(np.flatnonzero(~over)[0])  # starting outside a run, no run is cut at the origin
        turned = np.roll(over, -shift)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], turned.astype(int), [0]])))
        for a, b in zip(edges[::2], edges[1::2] - 1):
            held = (np.arange(a, b + 1) + shift) % n
            if len(held) <= 2:
                continue
            # Trimmed to matches at both ends.
            hit = np.flatnonzero(m[pair][held])
            if not len(hit):
                continue
            held = held[hit[0] : hit[-1] + 1]
            if not o.circular and held[0] > held[-1] or len(held) <= 2:
                continue
            rate = m[pair].sum() / n
            p = tract_p(int(m[pair][held].sum()), len(held), float(rate), n)
            c = o.corrected(p)
            if c < o.cutoff:
                first, last = held[0], held[-1]
                before, after = pos[first - 1] - (v.length if first == 0 else 0), pos[(last + 1) % n] + (v.length if last == n - 1 else 0)
                begin, end = (int(before) + int(pos[first])) // 2 + 1, (int(pos[last]) + int(after)) // 2
                if not o.circular:
                    begin, end = max(1, begin), min(v.length, end)
                mask = np.zeros(n, bool)
                mask[held] = True
                r, major, minor = roles(m, mask, pair)
                out.append(Candidate("RDP", r, major, minor, (begin - 1) % v.length + 1, (end - 1) % v.length + 1, p, c, n, {"pair": pair, "tract_sites": len(held)}))
    return out


def window_geometry(length: int, window: int, step: int) -> tuple[int, int, int]:
    window = min(window, length // 2)
    step = max(1, min(step, length // 4, window // 2))
    return window, step, length // step + 1


def pair_profile(x: np.ndarray, y: np.ndarray, o: Options) -> np.ndarray:
    """Jukes-Cantor distances[window, replicate] of two rows in single precision, saturating at 10. The sample itself is
    the first replicate; the last one that is drawn is thrown away."""
    length = len(x)
    window, step, last = window_geometry(length, o.boot_window, o.boot_step)
    weights = bootstrap_weights(window, o.boot_replicates, o.seed)[:, :-1]
    at = (np.arange(last + 1)[:, None] * step - window // 2 + np.arange(window)) % length
    both = ((x > 0) & (y > 0)).astype(np.float32)
    # Sums of small whole numbers are exact in single precision.
    valid, differ = both[at] @ weights.astype(np.float32), (both * (x != y))[at] @ weights.astype(np.float32)
    with np.errstate(divide="ignore", invalid="ignore"):
        same = ((valid.astype(float) - differ) / valid).astype(np.float32)
        d = np.float32(-0.75) * np.log((4 * same - 1) / np.float32(3))
    return np.where((valid > 0) & (same > 0.25) & np.isfinite(d), d, 10)


def pair_profiles(states: np.ndarray, o: Options, held: dict | None = None, rows=(0, 1, 2)) -> tuple[np.ndarray, int, int]:
    """The distances of the three pairs, step and window. held: profiles of pairs of rows that were measured before."""
    held, out = {} if held is None else held, []
    for i, j in MEMBERS:
        key = (rows[i], rows[j])
        if key not in held:
            held[key] = pair_profile(states[i], states[j], o)
        out.append(held[key])
    window, step, _ = window_geometry(states.shape[1], o.boot_window, o.boot_step)
    return np.stack(out), step, window


def support(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes of each pair in each window for being strictly the closest, and which windows have any usable replicate."""
    usable = (distances < 2).all(axis=0)
    order = np.sort(distances, axis=0)
    strict = usable & (order[0] < order[1])
    votes = np.stack([(strict & (distances[k] == order[0])).sum(axis=1) for k in range(3)])
    return votes, usable.any(axis=1)


def bootscan(states: np.ndarray, o: Options, variable: Variable | None = None, held: dict | None = None, rows=(0, 1, 2)) -> list[Candidate]:
    """Regions of windows in which one pair has the wanted support; they go on through windows in which the pair leads
    with more than 40 %, as many in a row as windows overlap."""
    v = variable or Variable(states)
    length, n = v.length, len(v)
    if length < 10 or min(o.boot_window, length // 2) < 5 or not n:
        return []
    distances, step, window = pair_profiles(states, o, held, rows)
    votes, usable = support(distances)
    last, gap = votes.shape[1] - 1, max(1, round(window / step))
    out = []
    for pair in range(3):
        full = votes[pair] >= o.boot_support * o.boot_replicates
        others = [q for q in range(3) if q != pair]
        leads = usable & (votes[pair] > votes[others[0]]) & (votes[pair] > votes[others[1]]) & (votes[pair] > 0.4 * o.boot_replicates)
        seen = np.zeros(last + 1, bool)
        for seed in range(1, last + 1):
            if seen[seed] or not full[seed]:
                continue
            region = [seed]
            for way in (-1, 1):
                misses, w = 0, seed
                while len(region) < last:
                    w = (w - 1 + way) % last + 1 if o.circular else w + way
                    if not 1 <= w <= last or w in region:
                        break
                    misses = 0 if full[w] else misses + 1
                    if not full[w] and not leads[w] or misses > gap:
                        break
                    region.insert(0, w) if way < 0 else region.append(w)
            seen[region] = True
            if len(region) >= last or not usable[region].any():
                continue
            place = lambda w: (w * step - 1) % length + 1 if o.circular else min(length, max(1, w * step))
            begin, end = place(region[0]), place(region[-1])
            if not o.circular:
                begin, end = 1 if region[0] == 1 else begin, length if region[-1] == last else end
            if begin == end:
                continue
            lo, hi = int(np.searchsorted(v.pos, begin, "right")), int(np.searchsorted(v.pos, end, "right"))
            held = inside(n, lo, hi) if lo != hi else np.zeros(n, bool)
            if held.sum() <= 2:
                continue
            rate = 1.0 if held.all() else float(v.match[pair].mean())
            p = tract_p(int(v.match[pair][held].sum()), int(held.sum()), rate, n)
            c = o.corrected(p)
            if 0 < c < o.cutoff:
                r, major, minor = roles(v.match, held, pair)
                out.append(Candidate("BootScan", r, major, minor, begin, end, p, c, n, {"pair": pair, "support": float(votes[pair][region].mean() / o.boot_replicates)}))
    return sorted(out, key=lambda c: (c.corrected_p, c.local_p, c.begin, c.detail["pair"]))


#: Pattern of four sequences by the relation of the first three (rows) and whom the outlier matches.
PATTERNS = np.array([[0, 0, 0, 0, 0, 0], [0, 4, 6, 7, 1, 1], [0, 12, 2, 8, 2, 2], [0, 13, 9, 3, 3, 3], [0, 10, 14, 5, 5, 5], [0, 15, 11, 11, 11, 11]])
#: Patterns that support the pairs 12, 13, 23.
SUPPORT = ((2, 8, 12), (3, 9, 13), (5, 10, 14))
BACKS = np.array([[p in s for p in range(16)] for s in SUPPORT], np.int16)


def relation(states: np.ndarray) -> np.ndarray:
    x, y, z = states
    r = np.where(x == y, np.where(x == z, 5, 2), np.where(x == z, 3, np.where(y == z, 4, 1)))
    return np.where((x > 0) & (y > 0) & (z > 0), r, 0)


def patterns(states: np.ndarray, outlier: np.ndarray) -> np.ndarray:
    rel = relation(states)
    x, y, z = states == outlier
    column = np.where(x, 1, np.where(rel == 1, np.where(y, 2, np.where(z, 3, 4)), np.where(rel == 2, np.where(z, 3, 4), np.where((rel == 3) | (rel == 4), np.where(y, 2, 4), 4))))
    p = PATTERNS[rel, column]
    return np.where((p == 11) | (p == 15), 0, p)


def permuted(p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Vertical permutation: a pattern becomes another one of its class, as the draw (1 to 12) says."""
    return MOVED[p, draws]


def _moved(p: int, draw: int) -> int:
    for low, high in ((2, 7), (8, 10), (11, 14)):
        if low <= p <= high:
            p = low + (draw - 1) % (high - low + 1)
            break
    return 0 if p in (11, 15) else p


MOVED = np.array([[_moved(p, d) for d in range(13)] for p in range(16)], np.int8)


#: How far a draw moves the support of each pair: of the pattern p, drawn d, BACKED[pair, p, d] tells whether it has any.
BACKED = BACKS[:, MOVED]


def window_scores(p: np.ndarray, permutations: int, prefix: np.ndarray) -> np.ndarray:
    """Of the support for each pair in windows of patterns (one a row): against permutations, 0 without support or
    variance. Each window meets the same draws."""
    n = p.shape[1]
    draws = prefix[(np.arange(permutations)[:, None] * n + np.arange(n)) % len(prefix)]
    seen = BACKS[:, p].sum(axis=-1, dtype=np.int64).T
    null = np.stack([BACKED[k][p[:, None, :], draws[None]].sum(axis=-1, dtype=np.int64) for k in range(3)], axis=1)
    sd = null.std(axis=2)
    return np.where((seen > 0) & (sd > 0), (seen - null.mean(axis=2)) / np.where(sd > 0, sd, 1), 0.0)


def z_scores(p: np.ndarray, permutations: int, prefix: np.ndarray) -> np.ndarray:
    """As window_scores, of one window."""
    return window_scores(p[None, :], permutations, prefix)[0]


def siscan(states: np.ndarray, o: Options, variable: Variable | None = None, outlier: np.ndarray | None = None) -> list[Candidate]:
    """Windows in which another pair than overall has the highest z-score; they never wrap. outlier: a fourth sequence,
    by default the consensus of the three shifted by one state, which no two of them share."""
    length = states.shape[1]
    if length < 6 or o.sis_window >= length or o.sis_step > o.sis_window // 2:
        return []
    if outlier is None:
        top = np.where(states[0] == states[1], states[0], np.where(states[1] == states[2], states[1], states[2]))
        outlier = np.where(top > 0, top % 4 + 1, 0)
    p, prefix = patterns(states, outlier), vertical_prefix(4096, o.seed)
    overall = int(BACKS[:, p].sum(axis=-1).argmax())
    starts = np.arange(0, length - o.sis_window, o.sis_step)
    z = window_scores(p[starts[:, None] + np.arange(o.sis_window)], o.sis_permutations, prefix)
    best = list(zip(z.argmax(axis=1).tolist(), z.max(axis=1).tolist(), strict=True))
    out, i = [], 0
    v = variable or Variable(states)
    while i < len(best):
        pair, z = best[i]
        j = i
        while j + 1 < len(best) and best[j + 1][0] == pair:
            j += 1
            z = max(z, best[j][1])
        if pair != overall and z > 0:
            a, b = i * o.sis_step, j * o.sis_step + o.sis_window
            hits = np.flatnonzero(np.isin(p[a:b], SUPPORT[pair]))
            if len(hits) > 2:
                begin, end = a + int(hits[0]) + 1, a + int(hits[-1]) + 1
                region = float(z_scores(p[begin - 1 : end], o.sis_permutations, prefix)[pair])
                local = min(1.0, normal_tail(-region) * length / max(1, end - begin)) if region > 0 else 1.0
                c = o.corrected(min(1.0, local * length / o.sis_window)) if o.correction else local
                if c < o.cutoff and len(v):
                    r, major, minor = roles(v.match, (v.pos >= begin) & (v.pos <= end), pair)
                    out.append(Candidate("SISCAN", r, major, minor, begin, end, local, c, len(v), {"pair": pair, "z": region}))
        i = j + 1
    return out


def expected_distance(count: int, length: int) -> float:
    """Least recommended distance of a data set."""
    return 2 * math.log(4 * count) / length
