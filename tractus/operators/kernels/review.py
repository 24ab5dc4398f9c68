"""Rechecks and plots: what each method says about a given tract, and its profile along the sites."""

from __future__ import annotations

import numpy as np

from . import geneconv, maxchi, threeseq, windows
from .common import Options, Variable, chi_p, chi_square, inside, window_sums


def supported(states: np.ndarray, begin: int, end: int, o: Options) -> bool:
    """BootScan's gate: in a window of the tract, or next to it, any pair has the wanted support of the replicates."""
    length = states.shape[1]
    if length < 10 or min(o.boot_window, length // 2) < 5:
        return False
    distances, step, _ = windows.pair_profiles(states, o)
    votes, usable = windows.support(distances)
    last = length // step - 1
    if last < 1:
        return False
    at = lambda site: int(site / step + 0.5)
    first, final = min(last, max(1, at(begin) - 1)), min(last, max(1, at(end) + 1))
    w = np.arange(1, last + 1)
    w = w[(w >= first) & (w <= final)] if begin < end else w[(w >= first) | (w <= final)]
    return bool(usable[w].any() and (votes[:, w] >= o.boot_support * o.boot_replicates).any())


def recheck(method: str, states: np.ndarray, begin: int, end: int, o: Options, fourth: np.ndarray | None = None) -> float:
    """The method's corrected p-value of a tract whose bounds stay where they are; 1 where it has nothing to say.
    fourth: SISCAN's nearest outlier."""
    v = Variable(states)
    n = len(v)
    if n < 4:
        return 1.0
    held = inside(states.shape[1], begin, end)[v.pos - 1]
    k = int(held.sum())
    if not 0 < k < n:
        return 1.0
    if method in ("MaxChi", "CHIMAERA"):
        best = 0.0
        for row, kept in [(r, np.ones(n, bool)) for r in v.match] if method == "MaxChi" else [(v.match[p], v.match[p] != v.match[q]) for p, q in ((0, 1), (0, 2), (1, 2))]:
            a, b = row[held & kept], row[~held & kept]
            h = min(len(a), len(b))
            if h >= 6:
                best = max(best, float(chi_square(h, a.mean() * h, b.mean() * h)))
        return o.corrected(min(1.0, chi_p(best) * n / max(1, min(k, n - k)) * 3)) if best else 1.0
    if method == "GENECONV":
        cat = geneconv.categories(v)
        out = 1.0
        for track in range(6):
            good = geneconv.positive(track, cat)
            different = max(1, int((~good).sum()))
            penalty = int(n * o.gscale / different) + 1
            found = geneconv.lambda_k(different, n, penalty)
            score = int(good[held].sum()) - penalty * int((~good)[held].sum())
            if found and score > 3:
                out = min(out, geneconv.fragment_p(score, *found, n))
        return o.corrected(out)
    if method == "3SEQ":
        out = 1.0
        for _, one, two, _, _ in threeseq.TARGETS:
            step = v.match[one] - v.match[two]
            plus, minus = int((step == 1).sum()), int((step == -1).sum())
            change = int(step[held].sum())
            for p, m, drop in ((plus, minus, -change), (minus, plus, change)):
                if drop > 1 and p and m:
                    raw = threeseq.probability(p, m, drop)[0]
                    out = min(out, raw) if raw > 0 else out
        return threeseq.corrected(out, o)
    if method == "BootScan" and not supported(states, begin, end, o):
        return 1.0
    if method in ("RDP", "BootScan"):
        rich = v.match.sum(axis=0) == 1 if method == "RDP" else np.ones(n, bool)
        size, total = int((held & rich).sum()), int(rich.sum())
        if size <= 2 or size >= total:
            return 1.0
        return o.corrected(min(windows.tract_p(int(m[held & rich].sum()), size, float(m[rich].mean()), total) for m in v.match))
    p = windows.patterns(states, np.where(states[0] > 0, states[0] % 4 + 1, 0) if fourth is None else fourth)
    z = windows.z_scores(p[inside(states.shape[1], begin, end)], o.sis_permutations, windows.vertical_prefix(4096, o.seed))
    return o.corrected(windows.normal_tail(-float(z.max()))) if z.max() > 0 else 1.0


def plot(method: str, states: np.ndarray, o: Options, fourth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and one value for each pair (3SEQ: for each target) at each of them."""
    v = Variable(states)
    n = len(v)
    none = np.zeros(0, int), np.zeros((3, 0))
    if method in ("MaxChi", "CHIMAERA"):
        chosen = maxchi.choose_window(n, o.maxchi_window if method == "MaxChi" else o.chimaera_window, 1.0) if n else None
        return (v.pos, np.stack([maxchi.smooth(maxchi.profile(m, chosen[0], 0, o.circular)) for m in v.match])) if chosen else none
    if method == "3SEQ":
        return v.pos, np.stack([np.cumsum(v.match[one] - v.match[two]) for _, one, two, _, _ in sorted(threeseq.TARGETS)])
    if method == "RDP":
        rich = v.match.sum(axis=0) == 1
        w = 2 * (o.rdp_window // 2) + 1
        return (v.pos[rich], np.stack([np.roll(window_sums(m, w), w // 2) / w for m in v.match[:, rich]])) if rich.sum() >= w else none
    if method == "BootScan":
        if states.shape[1] < 10:
            return none
        d, step, _ = windows.pair_profiles(states, o)
        votes, _ = windows.support(d)
        return np.arange(votes.shape[1]) * step, votes / o.boot_replicates
    if method == "SISCAN":
        p = windows.patterns(states, np.where(states[0] > 0, states[0] % 4 + 1, 0) if fourth is None else fourth)
        starts = np.arange(0, max(0, states.shape[1] - o.sis_window), o.sis_step)
        prefix = windows.vertical_prefix(4096, o.seed)
        return (starts + o.sis_window // 2, np.stack([windows.z_scores(p[s : s + o.sis_window], o.sis_permutations, prefix) for s in starts], 1)) if len(starts) else none
    out = np.zeros((3, n))
    if n >= 4:
        cat = geneconv.categories(v)
        for track in range(6):
            for p, _, b, e, _ in geneconv.fragments(track, cat, Options(cutoff=1.0, correction=False, circular=o.circular)):
                at = np.arange(b, e + 1) if b <= e else np.r_[b:n, 0 : e + 1]
                row = track if track < 3 else 5 - track
                out[row, at] = np.maximum(out[row, at], -np.log10(max(p, 1e-300)))
    return v.pos, out
