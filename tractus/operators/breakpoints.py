"""Breakpoint ranges from a hidden Markov model over a triplet's information-rich sites."""

from __future__ import annotations

import numpy as np

from .kernels.common import Variable

STATES, SYMBOLS, STARTS, UPDATES, PSEUDO = 3, 3, 21, 100, 0.01
LEVELS = (0.995, 0.999)


def symbols(states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of information-rich sites and which pair agrees."""
    v = Variable(states)
    rich = v.match.sum(axis=0) == 1
    return v.pos[rich], v.match[:, rich].argmax(axis=0)


def viterbi(obs: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, float]:
    """Most likely path and its log probability; all tables are logarithms."""
    back = np.zeros((len(obs), STATES), int)
    score = start + emit[:, obs[0]]
    for t in range(1, len(obs)):
        step = score[:, None] + move
        back[t] = step.argmax(axis=0)
        score = step.max(axis=0) + emit[:, obs[t]]
    path = np.empty(len(obs), int)
    path[-1] = score.argmax()
    for t in range(len(obs) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path, float(score.max())


def posterior(obs, start, move, emit) -> np.ndarray:
    """Probability of each state at each site, by scaled forward and backward sums."""
    a, m, e = np.exp(start), np.exp(move), np.exp(emit)
    n = len(obs)
    f, b = np.zeros((n, STATES)), np.ones((n, STATES))
    f[0] = a * e[:, obs[0]]
    f[0] /= f[0].sum()
    for t in range(1, n):
        f[t] = (f[t - 1] @ m) * e[:, obs[t]]
        f[t] /= f[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = m @ (e[:, obs[t + 1]] * b[t + 1])
        b[t] /= b[t].sum()
    p = f * b
    return p / p.sum(axis=1, keepdims=True)


def fit(obs: np.ndarray, seed: int = 3):
    """Tables of the best of several starts, each refined by Viterbi training until its path stays the same."""
    rng = np.random.default_rng(seed)
    best = None
    for k in range(STARTS):
        emit = np.full((STATES, SYMBOLS), 0.15) + np.eye(STATES) * 0.55 if k == 0 else rng.dirichlet(np.ones(SYMBOLS), STATES)
        emit /= emit.sum(axis=1, keepdims=True)
        move = np.full((STATES, STATES), 0.01) + np.eye(STATES) * 0.97
        start, old = np.full(STATES, 1 / STATES), None
        for _ in range(UPDATES):
            path, score = viterbi(obs, np.log(start), np.log(move), np.log(emit))
            if old is not None and (path == old).all():
                break
            old = path
            count = np.full((STATES, STATES), PSEUDO)
            np.add.at(count, (path[:-1], path[1:]), 1)
            seen = np.full((STATES, SYMBOLS), PSEUDO)
            np.add.at(seen, (path, obs), 1)
            move, emit = count / count.sum(axis=1, keepdims=True), seen / seen.sum(axis=1, keepdims=True)
        if best is None or score > best[0]:
            best = (score, path, np.log(start), np.log(move), np.log(emit))
    return best


def ranges(states: np.ndarray, seed: int = 3) -> list[dict]:
    """For each change of the path: where it is, and around it the sites at which neither side's state is certain at each
    level."""
    pos, obs = symbols(states)
    if len(obs) < 3:
        return []
    _, path, start, move, emit = fit(obs, seed)
    p = posterior(obs, start, move, emit)
    out = []
    for t in np.flatnonzero(np.diff(path)):
        row = {"position": int(pos[t] + pos[t + 1]) // 2, "from": int(path[t]), "to": int(path[t + 1])}
        for level in LEVELS:
            lo, hi = t, t + 1
            while lo > 0 and p[lo, path[t]] < level and path[lo - 1] == path[t]:
                lo -= 1
            while hi < len(pos) - 1 and p[hi, path[t + 1]] < level and path[hi + 1] == path[t + 1]:
                hi += 1
            row[f"range_{level}"] = (int(pos[lo]), int(pos[hi]))
        out.append(row)
    return out
