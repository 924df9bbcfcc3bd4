"""Draws at how many tables the customers of a dish sit, given all else, in a Pitman-Yor restaurant.

The chance of t tables for c customers is in proportion to S_d(c, t) times the product over i < t of
(start + d i) parent, where S_d are generalised Stirling numbers of the discount d. Up to SMALL customers
these come from their recursion. Beyond, from their generating function: sum over c of S_d(c, t) x^c / c!
is ((1 - (1-x)^d) / d)^t / t!, whose coefficient is an integral along a path through the saddle point, and
that converges exponentially in the number of its points. Both give the same distribution, whatever the number
of customers: log weights differ by less than 1e-4, and by 0.01 at most where all but a few customers sit alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SMALL = 128
#: Points of an integral, of a window of table counts, and halvings that find a saddle point.
NODES, POINTS, HALVINGS = 32, 24, 24
#: Cells of a block of windows, small enough for a processor's cache.
CELLS = 20_000


@lru_cache(maxsize=4)
def stirling(d: float, most: int = SMALL) -> np.ndarray:
    """log S_d(c, t) for c, t up to `most`: ways to seat c customers at t tables, weighted by the discount."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(most + 1)
    for c in range(1, most):
        stay = np.where(c - d * t > 0, np.log(np.maximum(c - d * t, 1e-300)), -np.inf) + out[c]
        out[c + 1] = np.logaddexp(stay, np.r_[-np.inf, out[c, :-1]])
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _sides(logit: np.ndarray, d: float):
    """Of z = 1 - x by its logit: log z, log (1 - z), log (1 - z^d)."""
    z, rest = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    return z, rest, np.log(-np.expm1(d * z))


def _halved(up, shape) -> np.ndarray:
    """The logit where `up` turns false."""
    low, high = np.full(shape, -700.0), np.full(shape, 60.0)
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        more = up(middle)
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    return (low + high) / 2


def _log_tables(logit: np.ndarray, c: np.ndarray, d: float) -> np.ndarray:
    """log of the table count whose saddle point lies there."""
    z, rest, f = _sides(logit, d)
    return np.log(c + 1) + f + (1 - d) * z - np.log(d) - rest


def log_stirling(c: np.ndarray, t: np.ndarray, d: float, logit: np.ndarray | None = None) -> np.ndarray:
    """log S_d(c, t), any size; t need not be whole.

    The path is z = z0 (1 + iu)^2 through the saddle point z0. Where z0 is so small that the power is
    nearly 1 all along, 1 is taken off it, which adds nothing to the coefficient, and z0 is 1 / c. A logit
    of z0 near the saddle point may be given, as every path yields the same.
    """
    c, t = np.broadcast_arrays(np.asarray(c, float), np.asarray(t, float))
    want = np.log(t)
    if logit is None:
        logit = _halved(lambda x: _log_tables(x, c, d) < want, c.shape)
    flat = (t * np.exp(d * _sides(logit, d)[0]) < 0.5) & (t * (c + 1) ** -d < 3)
    m = np.where(flat, np.maximum(logit, -np.log(c)), logit)
    log_z, log_rest, f = _sides(m, d)
    z, rest = np.exp(log_z), np.exp(log_rest)
    slope = d * np.exp(d * log_z - f)
    bend = t * (slope * (1 - d) - slope**2) + (c + 1) * (z / rest) ** 2
    width = np.minimum(1, 0.5 / np.sqrt(np.maximum(bend, 1e-300)))
    step = np.arcsinh(8 * np.maximum(1, 1 / np.sqrt(c * z)) / width) / NODES
    top = t * f - (c + 1) * log_rest
    total = np.zeros(c.shape)
    for k in range(NODES + 1):
        u = width * np.sinh(step * k)
        # (1 - z^d)^t and (1 - z)^-(c + 1) by size and angle
        turn, grown = np.arctan(u), np.expm1(d * (log_z + np.log1p(u * u)))
        half = np.sin(d * turn)
        re, im = 2 * (1 + grown) * half * half - grown, -2 * (1 + grown) * half * np.cos(d * turn)
        far, side = rest + z * u * u, -2 * u * z
        other, angle = -(c + 1) * 0.5 * np.log(far * far + side * side) - top, -(c + 1) * np.arctan2(side, far)
        size, whole = np.exp(t * 0.5 * np.log(re * re + im * im) + other), t * np.arctan2(im, re) + angle
        value = size * (np.cos(whole) - u * np.sin(whole))
        if flat.any():
            value -= np.where(flat, np.exp(np.where(flat, other, 0)) * (np.cos(angle) - u * np.sin(angle)), 0)
        total += (0.5 if k == 0 else 1.0) * value * width * np.cosh(step * k)
    found = log_gamma(c + 1) - log_gamma(t + 1) - t * np.log(d) + top + np.log(2 / np.pi * z * step * np.abs(total))
    pairs = np.log(np.maximum((1 - d) * c * (c - 1) / 2, 1e-300))  # one table of two
    return np.where(t == c, 0.0, np.where(t == c - 1, pairs, found))


def _weights(c, t, start, parent, d):
    # saddle points of the window's ends and middle; between them they are all but a parabola in log t
    ends = np.log(np.stack([t[:, 0], np.sqrt(t[:, 0] * t[:, -1]), t[:, -1]], axis=1))
    found = _halved(lambda x: _log_tables(x, c, d) < ends, ends.shape)
    x = (np.log(t) - ends[:, :1]) / np.maximum(ends[:, 2:] - ends[:, :1], 1e-12)
    logit = found[:, :1] * (2 * x - 1) * (x - 1) + found[:, 1:2] * 4 * x * (1 - x) + found[:, 2:] * x * (2 * x - 1)
    return log_stirling(c, t, d, logit) + t * np.log(d * parent) + log_gamma(start / d + t) - log_gamma(start / d)


def _window(c: np.ndarray, start: np.ndarray, parent: np.ndarray, d: float):
    """About the likeliest table count and its spread, from the saddle points alone."""

    def lean(x):
        f, t = _sides(x, d)[2], np.exp(_log_tables(x, c, d))
        return np.log((start + d * t) * parent) + f - np.log(d * t), t

    m = _halved(lambda x: lean(x)[0] > 0, c.shape)
    (a, low), (b, high) = lean(m - 0.05), lean(m + 0.05)
    spread = np.sqrt(np.maximum((high - low) / np.maximum(a - b, 1e-12), 0.0))
    return np.clip(np.exp(_log_tables(m, c, d)), 1, c), np.clip(spread, 1, c)


def _drawn_many(c: np.ndarray, start: np.ndarray, parent: np.ndarray, d: float, rng) -> np.ndarray:
    """Log weights at evenly spaced points of a window that holds all but a millionth, cubics between them."""
    c = c.astype(float)
    middle, spread = _window(c, start, parent, d)
    out, todo = np.zeros(len(c), np.int64), np.arange(len(c))
    while len(todo):
        low = np.maximum(1, np.floor(middle[todo] - 8 * spread[todo] - 8))
        high = np.minimum(c[todo], np.ceil(middle[todo] + 8 * spread[todo] + 8))
        order = np.argsort(high - low)
        todo, low, high = todo[order], low[order], high[order]
        again = []
        cuts = np.flatnonzero(np.diff(np.cumsum(np.maximum(high - low + 1, POINTS)) // CELLS, prepend=0))
        for rows in np.split(np.arange(len(todo)), cuts):
            if not len(rows):
                continue
            own, a, b = todo[rows], low[rows, None], high[rows, None]
            step = np.maximum(1.0, (b - a) / (POINTS - 1))
            at = a + step * np.arange(POINTS)
            inside = at <= b + 1e-6
            near = np.where(inside, np.minimum(at, b), b)
            weight = _weights(c[own, None], near, start[own, None], parent[own, None], d)
            weight = np.where(inside, weight, -np.inf)
            best = weight.max(1)
            last = weight[np.arange(len(own)), inside.sum(1) - 1]
            open_ = ((a[:, 0] > 1) & (weight[:, 0] > best - 16)) | ((b[:, 0] < c[own]) & (last > best - 16))
            again.append(own[open_])
            t = a + np.arange(int((b - a).max()) + 1)
            x = np.minimum((t - a) / step, POINTS - 1)
            i = np.clip(np.floor(x).astype(np.int64), 1, POINTS - 3)
            y = x - i
            p = [np.take_along_axis(np.maximum(weight, -1e300), i + k, 1) for k in (-1, 0, 1, 2)]
            with np.errstate(over="ignore", invalid="ignore"):
                cubic = (
                    -p[0] * y * (y - 1) * (y - 2) / 6 + p[1] * (y + 1) * (y - 1) * (y - 2) / 2
                    - p[2] * (y + 1) * y * (y - 2) / 2 + p[3] * (y + 1) * y * (y - 1) / 6
                )
            whole = np.take_along_axis(weight, np.clip(x.astype(np.int64), 0, POINTS - 1), 1)
            log_p = np.where(step == 1.0, whole, cubic)
            log_p = np.where(t <= b, log_p, -np.inf)
            out[own] = t[np.arange(len(own)), np.argmax(log_p - np.log(-np.log(rng.random(log_p.shape))), axis=1)]
        todo = np.concatenate(again)
        spread[todo] *= 2
    return out


def drawn_tables(c: np.ndarray, start: np.ndarray, parent: np.ndarray, d: float, table: np.ndarray, rng) -> np.ndarray:
    """Tables of c customers of one dish each; start: strength and discounted tables of other dishes, parent: the dish's chance above."""
    t = np.minimum(c, 1)
    for size in np.unique(c[(c > 1) & (c <= SMALL)]).tolist():
        rows = np.flatnonzero(c == size)
        for part in np.array_split(rows, max(1, len(rows) * size // 2_000_000)):
            step = np.log(start[part, None] + d * np.arange(size)) + np.log(parent[part, None])
            weight = np.cumsum(step, axis=1) + table[size, 1 : size + 1]
            t[part] = 1 + np.argmax(weight - np.log(-np.log(rng.random(weight.shape))), axis=1)
    many = np.flatnonzero(c > SMALL)
    if len(many):
        t[many] = _drawn_many(c[many], start[many], parent[many], d, rng)
    return t
