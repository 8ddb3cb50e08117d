"""Seatings of Pitman-Yor restaurants: the Gibbs steps, on numpy arrays.

A restaurant is described by its dishes' customers n and tables t. Given the
tables of all other dishes and the parent's probability of a dish, the tables
that the dish's n customers occupy have the law

    P(t) ~ S_d(n, t) * prod_{i < t} (theta + d * (rest + i)) * base

where S_d are generalised Stirling numbers: who sits where is summed out. A
sweep takes one dish after another and draws its tables from this law.
"""

from __future__ import annotations

import functools
import math

import numpy as np

#: Dishes of up to this many customers are drawn from the exact law; for more,
#: the Stirling numbers are approximate.
EXACT = 1024
#: A restaurant's dishes are drawn in at most this many steps a sweep; dishes
#: of one step do not see each other's change.
STEPS = 16
_FEW = 24

_FINE = 64  # seatings are counted by (n, t) up to here, for the parameters
_BINS = 512
N_SUMS = (_FINE + 1) ** 2 + 3 + 2 * _BINS
#: The values between which discount and strength are sampled.
DISCOUNTS = np.arange(1, 20) / 20
STRENGTHS = 2.0 ** np.arange(-10, 13)

lgamma = np.vectorize(math.lgamma, otypes=[float])


@functools.lru_cache(3)
def log_stirling(d: float, size: int = EXACT) -> np.ndarray:
    """log S_d(n, t) for n, t up to ``size``; S(n + 1, t) = S(n, t - 1) + (n - t d) S(n, t)."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(size + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(size):
            stay = out[n] + np.log(np.maximum(n - t * d, 0))
            stay[t > n] = -np.inf
            out[n + 1, 1:] = np.logaddexp(stay[1:], out[n, :-1])
    return out


def draw(n, rest, base, theta: float, d: float, rng) -> np.ndarray:
    """Tables of dishes with ``n`` customers (up to ``EXACT``) from the exact law."""
    out = np.minimum(n, 1).astype(np.int64)
    todo = np.flatnonzero(n > 1)
    if not len(todo):
        return out
    wide = int(n.max())
    if wide == 2:
        x = (theta + d * (rest[todo] + 1)) * base[todo]
        out[todo] += rng.random(len(todo)) * (x + 1 - d) < x
        return out
    table = log_stirling(d)
    # Few tables first; what lies beyond them is looked at where it matters.
    for most in (_FEW, wide) if wide > _FEW else (wide,):
        rows, later = max(1, (1 << 19) // most), []
        for k in range(0, len(todo), rows):
            i = todo[k : k + rows]
            step = np.log(theta + d * (rest[i][:, None] + np.arange(most)))
            step += np.log(base[i])[:, None]
            weight = np.cumsum(step, axis=1)
            weight += table[n[i], 1 : most + 1]
            weight -= weight.max(1, keepdims=True)
            if most < wide:
                # Below one part in 10**12 of the likeliest, and falling.
                done = (weight[:, -1] < -28) & (weight[:, -1] < weight[:, -2] - 0.5) | (n[i] <= most)
                later.append(i[~done])
                i, weight = i[done], weight[done]
            weight = np.cumsum(np.exp(weight), axis=1)
            out[i] = 1 + (weight < rng.random(len(i))[:, None] * weight[:, -1:]).sum(1)
        todo = np.concatenate(later) if later else todo[:0]
    return np.minimum(out, n)


@functools.lru_cache(48)
def _saddle(d: float):
    """log(n / t), log y and log b at the saddle point of
    S_d(n, t) = n! / (t! d^t) [z^n] (1 - (1 - z)^d)^t, where y is 1 - z."""
    y = np.exp(np.linspace(-60, -1e-7, 6000))
    rho = d * y ** (d - 1) * (1 - y) / -np.expm1(d * np.log(y))
    # z d rho / dz, per table.
    b = (1 - y) * -np.gradient(rho, y)
    return np.log(rho[::-1]), np.log(y[::-1]), np.log(np.maximum(b[::-1], 1e-300))


def log_gamma(x):
    z = x + 7
    shift = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5) + np.log(x + 6)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) - shift


def _by_saddle(n, t, d: float):
    at, log_y, log_b = _saddle(d)
    rho = np.log(np.maximum(n / t, 1 + 1e-6))
    y, b = np.interp(rho, at, log_y), np.interp(rho, at, log_b)
    f = t * np.log(-np.expm1(d * y)) - n * np.log(-np.expm1(y)) - 0.5 * (np.log(2 * np.pi * t) + b)
    return f - log_gamma(t + 1.0) - t * math.log(d)


@functools.lru_cache(48)
def _bend(d: float) -> np.ndarray:
    """How far log S_d(EXACT, t) / S_d(EXACT, 1) is from its limit for many customers."""
    t = np.arange(1.0, EXACT + 1)
    row = log_stirling(d)[EXACT, 1:]
    return row - row[0] + log_gamma(t) + (t - 1) * math.log(d)


def log_stirling_near(n, t, d: float):
    """log S_d(n, t) / S_d(n, 1) for n >= ``EXACT``. It depends on t / n^d
    alone while t is far below n, so it follows from the last exact row; for
    more tables by the saddle point, where the two meet at t / n^d = 200 / EXACT^d."""
    near = lambda t, s: np.interp(s, np.arange(1, EXACT + 1), _bend(d)) - log_gamma(t) - (t - 1) * math.log(d)
    scale = (EXACT / n) ** d
    meet = np.minimum(200 / scale, n)
    return np.where(t <= meet, near(t, t * scale), _by_saddle(n, t, d) - _by_saddle(n, meet, d) + near(meet, meet * scale))


def crowd(n, rest, base, theta: float, d: float, rng) -> np.ndarray:
    """``draw`` for many customers: numbers of tables are drawn by ranges, one
    number each up to 32, then 5 % wide."""
    out = np.minimum(n, 1).astype(np.int64)
    todo = np.flatnonzero(n > 1)
    if not len(todo):
        return out
    low = [*range(1, 33)]
    while low[-1] < n.max():
        low.append(int(low[-1] * 1.05) + 1)
    low = np.array(low, np.int64)
    width = np.diff(low)
    low = low[:-1]
    mid = low + (width - 1) / 2
    for k in range(0, len(todo), 1024):
        i = todo[k : k + 1024]
        t = np.minimum(mid, n[i][:, None].astype(float))
        x = theta / d + rest[i][:, None]
        log = log_stirling_near(n[i][:, None].astype(float), t, d)
        log += log_gamma(x + t) - log_gamma(x) + t * (math.log(d) + np.log(base[i])[:, None])
        log += np.log(width) + np.where(low > n[i][:, None], -np.inf, 0.0)
        weight = np.cumsum(np.exp(log - log.max(1, keepdims=True)), axis=1)
        at = (weight < rng.random(len(i))[:, None] * weight[:, -1:]).sum(1)
        out[i] = np.minimum(low[at] + (rng.random(len(i)) * width[at]).astype(np.int64), n[i])
    return out


def sweeps(restaurant, n, tables, base, theta: float, d: float, rng, rounds: int, fixed: int | None = None, before=None):
    """``rounds`` sweeps over dishes (restaurant number, n > 1 customers), at
    ``before`` tables, or at one table each. ``tables`` counts each restaurant's tables, these
    dishes' included, and is updated, except from number ``fixed`` on:
    restaurants spread over many tasks keep the count of the round before.
    Returns t."""
    t = np.ones(len(n), np.int64) if before is None else before.copy()
    if not len(n):
        return t
    fixed = len(tables) if fixed is None else fixed
    # Each restaurant's dishes in random order, cut into steps.
    order = np.lexsort((rng.random(len(n)), restaurant))
    first = np.flatnonzero(np.concatenate(([True], np.diff(restaurant[order]) != 0)))
    size = np.diff(np.append(first, len(n)))
    place = np.arange(len(n)) - np.repeat(first, size)
    many = np.repeat(size, size)
    step = np.empty(len(n), np.int64)
    step[order] = np.where(many > STEPS, place * STEPS // many, place)
    step[restaurant >= fixed] = 0
    width = np.ceil(np.log2(n)).astype(np.int64)
    width[n > EXACT] = 63
    code = step * 64 + width
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) != 0)))
    groups = np.split(order, cuts[1:])
    for _ in range(rounds):
        for i in groups:
            r = restaurant[i]
            rest = np.maximum(tables[r] - t[i], 0)
            new = (crowd if width[i[0]] == 63 else draw)(n[i], rest, base[i], theta, d, rng)
            own = r < fixed
            np.add.at(tables, r[own], (new - t[i])[own])
            t[i] = new
    return t


# --- discount and strength ---------------------------------------------------


def _bin(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 1).astype(float)
    return np.where(x < 256, x, np.minimum(256 + np.floor(16 * np.log2(x / 256)), _BINS - 1)).astype(np.int64)


_AT = np.concatenate((np.arange(256.0), 256 * 2.0 ** ((np.arange(_BINS - 256) + 0.5) / 16)))
_AT[0] = 1


def sums(n, t, restaurant_tables, restaurant_customers) -> np.ndarray:
    """What seatings tell of discount and strength, in ``N_SUMS`` numbers that
    add up over restaurants."""
    n, t = np.asarray(n, np.int64), np.asarray(t, np.int64)
    fine = n <= _FINE
    seen = np.bincount(n[fine] * (_FINE + 1) + t[fine], minlength=(_FINE + 1) ** 2)
    big = [(~fine).sum(), (t[~fine] - 1).sum(), np.log(np.maximum(n[~fine], 1)).sum()]
    some = np.asarray(restaurant_customers) > 0
    return np.concatenate((seen, big, np.bincount(_bin(np.asarray(restaurant_tables)[some]), minlength=_BINS), np.bincount(_bin(np.asarray(restaurant_customers)[some]), minlength=_BINS))).astype(float)


def log_likelihood(s: np.ndarray, theta: float, d: float) -> float:
    """log P of seatings with these ``sums``, up to what depends on neither
    parameter. Dishes of more than 64 customers by the limit of S_d for many."""
    k = (_FINE + 1) ** 2
    seen, big, tables, customers = s[:k], s[k : k + 3], s[k + 3 : k + 3 + _BINS], s[k + 3 + _BINS :]
    used = np.flatnonzero(seen)
    out = float(seen[used] @ log_stirling(d, _FINE).ravel()[used])
    out += -big[0] * math.lgamma(1 - d) - big[1] * math.log(d) - big[2] * d
    i = np.flatnonzero(tables)
    out += float(tables[i] @ (_AT[i] * math.log(d) + lgamma(theta / d + _AT[i]) - math.lgamma(theta / d)))
    i = np.flatnonzero(customers)
    return out - float(customers[i] @ (lgamma(theta + _AT[i]) - math.lgamma(theta)))


def sample_parameters(s: np.ndarray, rng) -> tuple[float, float]:
    """(strength, discount) drawn from their posterior on the grid, all values
    equally likely before."""
    grid = [(theta, d) for d in DISCOUNTS.tolist() for theta in STRENGTHS.tolist()]
    log = np.array([log_likelihood(s, *g) for g in grid])
    p = np.exp(log - log.max())
    return grid[rng.choice(len(grid), p=p / p.sum())]
