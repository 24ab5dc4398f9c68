"""Chinese-restaurant seating of many dishes at once, with random numbers that follow from a dish and not from its place.

Given the restaurant's concentration and its parent's probabilities, a dish with c customers has a rate x, and a seating
is a path: for each customer, whether a table was opened. A path's weight is the product of x for openings and of
m - d t for the others, where the customer finds m others at t tables. Paths are drawn customer by customer with the
chance x w / (x w + m - d t), w = (m / c) ** d: early tables make later openings dearer, and w foresees that. A drawn path
is off by the product of its normalisers over that of its w, so moving from one path to another is accepted by the ratio
of these: a Metropolis step for each dish that leaves its conditional distribution as it is, whatever its size.

Uniform numbers are hashes of (dish, sweep, customer). A path need not be stored: the rate and the sweep it was drawn
with give it again. Results do not depend on how dishes are dealt to tasks.
"""

from __future__ import annotations

import numpy as np

_GOLD, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S30, _S27, _S31, _S11 = (np.uint64(x) for x in (30, 27, 31, 11))
#: How customers are taken: one of every dish at a time up to this number, then the rest of each dish in blocks. Both
#: ways evaluate the same rule with the same numbers.
ABREAST, BLOCK = 1000, 8192


def mixed(x: np.ndarray) -> np.ndarray:
    x = x + _GOLD
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def keyed(seed: np.ndarray, number) -> np.ndarray:
    """A new seed from a seed and a number (or an array of them)."""
    return mixed(seed ^ (np.asarray(number, np.uint64) * _M2))


def uniform(seed: np.ndarray, number) -> np.ndarray:
    """Between 0 and 1, without both."""
    return ((keyed(seed, number) >> _S11).astype(np.float64) + 0.5) * 2.0**-53


def gamma(shape: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Gamma variates of scale 1 (0 where the shape is 0), by squeezed normals."""
    shape = np.asarray(shape, np.float64)
    out = np.zeros(len(shape))
    live, turn = np.flatnonzero(shape > 0), 0
    a = np.where(shape < 1, shape + 1, shape) - 1 / 3
    while len(live):
        s, al = seed[live], a[live]
        z = np.sqrt(-2 * np.log(uniform(s, 3 * turn + 1))) * np.cos(2 * np.pi * uniform(s, 3 * turn + 2))
        v = (1 + z / np.sqrt(9 * al)) ** 3
        good = v > 0
        good[good] = np.log(uniform(s[good], 3 * turn + 3)) < 0.5 * z[good] ** 2 + al[good] * (1 - v[good] + np.log(v[good]))
        out[live[good]] = (al * v)[good]
        live, turn = live[~good], turn + 1
    low = (shape > 0) & (shape < 1)
    out[low] *= uniform(seed[low], 0) ** (1 / shape[low])
    return out


def seat(c: np.ndarray, x: np.ndarray, at: np.ndarray, seed: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each dish's path drawn with rate x, and the log of the path's correction for draws with the rate at."""
    c = np.asarray(c, np.int64)
    tables, log_z = (c > 0).astype(np.int64), np.zeros(len(c))
    order = np.argsort(-c, kind="stable")
    sizes = c[order]
    live = int(np.searchsorted(-sizes, -1, "left"))  # those with two customers or more
    order, sizes = order[:live], sizes[:live]
    rates, seeds = (np.ascontiguousarray(v[order]) for v in (at, seed))
    scale = np.power(sizes, -d, dtype=np.float64)
    logs = np.log(scale)
    xs, rates = x[order] * scale, rates * scale
    t, z = np.ones(live), np.zeros(live)
    m = 1
    while live and m < ABREAST:
        rest, w = m - d * t[:live], float(m) ** d
        opened = uniform(seeds[:live], m) * (xs[:live] * w + rest) < xs[:live] * w
        z[:live] += np.log(rates[:live] * w + rest) - opened * (logs[:live] + np.log(w))
        t[:live] += opened
        m += 1
        live = int(np.searchsorted(-sizes, -m, "left"))
    for i in range(live):
        t[i], z[i] = _onwards(int(sizes[i]), xs[i], rates[i], logs[i], seeds[i : i + 1], m, t[i], z[i], d)
    tables[order], log_z[order] = t.astype(np.int64), z
    return tables, log_z


def _onwards(c: int, x: float, at: float, log: float, seed: np.ndarray, m: int, t: float, z: float, d: float) -> tuple[float, float]:
    """One dish from its customer m on. Within a block, openings are found from the tables before them and these from
    the openings, until both agree; a table only adds openings, so that ends with the path."""
    for a in range(m, c, BLOCK):
        i = np.arange(a, min(c, a + BLOCK))
        u, w = uniform(seed, i), i.astype(np.float64) ** d
        opened = u * (x * w + i - d * t) < x * w
        while True:
            before = t + np.cumsum(opened) - opened
            now = u * (x * w + i - d * before) < x * w
            if (now == opened).all():
                break
            opened = now
        z += float(np.log(at * w + i - d * before).sum() - (log * opened.sum() + np.log(w[opened]).sum()))
        t += float(opened.sum())
    return t, z


def moved(c, x_old, k_old, x_new, seed, sweep: int, d: float):
    """One step for each dish: tables before and after it, and rate and sweep of the path now in force.

    x_old, k_old: rate (float32) and sweep of the path before; sweep 0 stands for none, and the new path is taken.
    """
    x_new = x_new.astype(np.float32)
    rate = x_new.astype(np.float64)
    one, z_one = seat(c, rate, rate, keyed(seed, sweep), d)
    two, z_two = seat(c, x_old.astype(np.float64), rate, keyed(seed, k_old), d)
    take = (np.asarray(k_old) == 0) | (np.log(uniform(keyed(seed, sweep), 0)) < z_one - z_two)
    return two, np.where(take, one, two), np.where(take, x_new, x_old), np.where(take, sweep, k_old).astype(np.int16)
