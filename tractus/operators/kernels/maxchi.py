"""MaxChi and CHIMAERA: chi-square peaks of matches on both sides of a boundary, grown and turned into tracts.

Both run the same search over profiles: MaxChi over the three pairs of a triplet, CHIMAERA over each target's choice
between its two parents. A peak is taken in the order of the smoothed chi-square; its window grows while chi-square does
not fall; the tract lies on the side whose half differs more from what is beyond it, and the far boundary moves to
where that contrast is largest. Used-up regions of a profile are set to zero.
"""

from __future__ import annotations

import numpy as np

from .common import MEMBERS, Candidate, Options, Variable, chi_p, chi_square, critical_difference, inside, roles, window_sums


def choose_window(n: int, fixed: int, p: float) -> tuple[int, int] | None:
    """Half window and critical difference, or None where there are too few variable sites."""
    h = int(fixed / 2 + 0.51)
    critical = critical_difference(h, p)
    if n < max(7, 2 * critical):
        return None
    if 2 * h > n:
        h = max(0, int(n * 0.375 + 0.51) - 1)
    if h <= critical:
        h = max(0, int(n / 2 + 0.51) - 1)
    return (h, critical) if h >= 6 and 2 * h <= n else None


def profile(flags: np.ndarray, h: int, critical: int, circular: bool, cuts: np.ndarray | None = None) -> np.ndarray:
    """Chi-square at boundary i, between the h sites before i and the h sites from i on; 0 where the difference is not
    above the critical one, or, if linear, where a window would wrap. cuts[i]: erased data lie between the sites i - 1
    and i; windows with a cut inside are banned, a cut at the boundary itself is not inside."""
    right = window_sums(flags, h)
    left = np.roll(right, h)
    chi = np.where(np.abs(left - right) > critical, chi_square(h, left, right), 0.0)
    if cuts is not None and cuts.any():
        ban = np.roll(window_sums(cuts.astype(np.int64), max(1, h - 1)), -1) > 0
        chi[ban | np.roll(ban, h)] = 0
    if not circular:
        chi[:h] = 0
        chi[len(chi) - h + 1 :] = 0
    return chi


def cuts(states: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which variable sites have erased data (a long run of missing sites in any row) between them and the one before."""
    from .consensus import gaps

    erased = np.cumsum(np.any([gaps(r) for r in states], axis=0))
    at = erased[pos - 1]
    before = np.concatenate([[at[-1] - erased[-1]], at[:-1]]) if len(at) else at
    return at > before


def smooth(chi: np.ndarray) -> np.ndarray:
    """Sum of twelve values, from five before to six after, over eleven; circular."""
    return sum(np.roll(chi, -k) for k in range(-5, 7)) / 11


def grow(flags: np.ndarray, boundary: int, h: int, chi: float) -> tuple[float, int]:
    """Best chi-square and half window around a boundary: windows from about h / 4 on are tried, and the search ends
    after a run of failures. A smaller window than h wins if its chi-square is as large."""
    n = len(flags)
    start = min(max(6, int(h / 4 + 0.51)), h, n // 2)
    if not start:
        return chi, h
    i = np.arange(n // 2)
    left = np.cumsum(flags[(boundary - 1 - i) % n])
    right = np.cumsum(flags[(boundary + i) % n])
    failures, most, best = 0, max(1, min(2 * h, (n - 2 * start) // 2)), (chi, h)
    for w in range(start + 1, n // 2 + 1):
        value = float(chi_square(w, left[w - 1], right[w - 1]))
        if value >= best[0]:
            best, failures = (value, w), 0
        else:
            failures += 1
            if failures > most:
                break
    return best


def tract(flags: np.ndarray, boundary: int, w: int) -> tuple[int, int, bool]:
    """Begin and end, as 1-based indices of variable sites, of the half of a peak that stands out from what lies beyond
    it (ties: the left half); the outer end is where the contrast with the next w sites is largest."""
    n = len(flags)
    total = np.concatenate([[0], np.cumsum(np.tile(flags, 3))])
    share = lambda a, size: total[a + n + size] - total[a + n]
    left = (share(boundary - w, w), share(boundary - 2 * w, w)) if 2 * w <= n else (share(boundary - w, w), share(boundary, w))
    right = (share(boundary, w), share(boundary + w, w)) if 2 * w <= n else (share(boundary, w), share(boundary - w, w))
    use_left = chi_square(w, *left) >= chi_square(w, *right)
    best, size, misses = -1.0, w, 0
    for s in range(max(2, w // 2), min(n - w, 3 * w) + 1):  # how far the tract reaches
        near, far = (share(boundary - s, s), share(boundary - s - w, w)) if use_left else (share(boundary, s), share(boundary + s, w))
        gain = abs(near / s - far / w) * np.sqrt(s * w / (s + w))
        if gain > best:
            best, size, misses = gain, s, 0
        else:
            misses += 1
            if misses > max(1, w // 10) and s > w:
                break
    begin, end = (boundary - size, boundary - 1) if use_left else (boundary, boundary + size - 1)
    return begin % n + 1, end % n + 1, bool(use_left)


def search(method: str, flags: np.ndarray, v_pos: np.ndarray, match: np.ndarray, pairs: list[int], window: int, o: Options, fixed: int | None = None, banned: np.ndarray | None = None) -> list[Candidate]:
    """flags: one row for each profile; pairs: the pair that each profile stands for; fixed: the target, for CHIMAERA;
    banned: cuts()."""
    n = len(v_pos)
    chosen = choose_window(n, window, o.cutoff) if n else None
    if chosen is None:
        return []
    h, critical = chosen
    chi = np.stack([profile(f, h, critical, o.circular, banned) for f in flags])
    if chi_p(float(chi.max())) * n / h * 3 > o.cutoff:  # the largest value cannot pass, so none can
        return []
    level, out, wasted = np.stack([smooth(c) for c in chi]), [], 0
    for _ in range(o.attempts):
        live = np.where(chi > 0, level, 0)
        if not live.max() > 0:
            break
        at, row = np.unravel_index(live.T.argmax(), live.T.shape)  # ties: first boundary, then first profile
        best, w = grow(flags[row], int(at), h, float(chi[row, at]))
        local = min(1.0, chi_p(best) * n / max(1, min(h, w)) * 3)
        p = o.corrected(local)
        emitted = False
        if p < o.cutoff:
            b, e, _ = tract(flags[row], int(at), min(w, n // 3))
            if o.circular or b < e:
                held = inside(n, b, e)
                r, major, minor = roles(match, held, pairs[row])
                if fixed is not None and r != fixed:
                    r, minor = fixed, next(m for m in MEMBERS[pairs[row]] if m != fixed)
                    major = 3 - r - minor
                out.append(Candidate(method, r, major, minor, int(v_pos[b - 1]), int(v_pos[e - 1]), local, p, n, {"chi": best, "window": w, "pair": pairs[row]}))
                emitted, wasted = True, 0
            chi[row, held if emitted else inside(n, b, e)] = 0
        chi[row, (np.arange(at - h, at + h + 1)) % n] = 0
        if not emitted:
            wasted += 1
            if wasted >= o.wasted:
                break
    return out


def discover(states: np.ndarray, o: Options, variable: Variable | None = None) -> list[Candidate]:
    v = variable or Variable(states)
    return search("MaxChi", v.match, v.pos, v.match, [0, 1, 2], o.maxchi_window, o, None, cuts(states, v.pos))


def chimaera(states: np.ndarray, o: Options, variable: Variable | None = None) -> list[Candidate]:
    """For each target only sites where it matches one parent and not the other."""
    v = variable or Variable(states)
    out = []
    for target, (one, two) in enumerate(((0, 1), (0, 2), (1, 2))):
        kept = v.match[one] != v.match[two]
        if kept.sum() >= 7:
            out += search("CHIMAERA", v.match[one : one + 1, kept], v.pos[kept], v.match[:, kept], [one], o.chimaera_window, o, target, cuts(states, v.pos[kept]))
    return out
