"""Special functions from public formulas: numpy for kernels, columns where rows need them, scalars for reports."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_2PI = math.log(2 * math.pi)
NODES = 64
#: Beyond this the trapezoid loses digits and the asymptotic series has them.
LARGE = 40.0


def digamma(x):
    """Recurrence to x + 8, then the asymptotic series."""
    x = np.asarray(x, float)
    y = x + 8
    out = np.log(y) - 1 / (2 * y)
    for power, c in ((2, -1 / 12), (4, 1 / 120), (6, -1 / 252), (8, 1 / 240), (10, -5 / 660), (12, 691 / 32760), (14, -1 / 12)):
        out = out + c / y**power
    return out - sum(1 / (x + i) for i in range(8))


def digamma_column(x: Column) -> Column:
    y = x + 8
    out = F.log(y) - 1 / (2 * y)
    for power, c in ((2, -1 / 12), (4, 1 / 120), (6, -1 / 252), (8, 1 / 240), (10, -5 / 660), (12, 691 / 32760), (14, -1 / 12)):
        out = out + F.lit(c) / F.pow(y, F.lit(float(power)))
    return out - sum((1 / (x + i) for i in range(1, 8)), 1 / x)


lgamma = np.vectorize(math.lgamma, otypes=[float])


def _series(x: np.ndarray, order: int) -> np.ndarray:
    """Asymptotic series of I_order(x) e^-x sqrt(2 pi x)."""
    term, total = np.ones_like(x), np.ones_like(x)
    for k in range(1, 12):
        term = -term * (4 * order * order - (2 * k - 1) ** 2) / (k * 8 * x)
        total = total + term
    return total


def _summed_log_i0(x: np.ndarray) -> np.ndarray:
    """log I0(x), x >= 0: the trapezoid rule near, the asymptotic series far out."""
    small = np.minimum(x, LARGE)
    c = np.cos((np.arange(NODES) + 0.5) * (math.pi / NODES))
    near = np.log(np.exp(small[..., None] * (c - 1)).mean(-1)) + small
    big = np.maximum(x, LARGE)
    far = big - 0.5 * np.log(2 * math.pi * big) + np.log(_series(big, 0))
    return np.where(x < LARGE, near, far)


def _log_series(terms: int) -> list[float]:
    """Coefficients, in powers of 1 / x from the first on, of the logarithm of I0's asymptotic series."""
    s, out = [1.0], [0.0]
    for k in range(1, terms + 1):
        s.append(s[-1] * (2 * k - 1) ** 2 / (8 * k))
        out.append(s[k] - sum(j * out[j] * s[k - j] for j in range(1, k)) / k)
    return out[1:]


_FAR = _log_series(12)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log I0(x) - x and its two derivatives: sums near, the asymptotic series far out."""
    near, far = np.minimum(x, LARGE), np.maximum(x, LARGE)
    ratio = a1(near)
    bend = 1 - ratio * ratio - np.divide(ratio, near, out=np.full_like(near, 0.5), where=near > 0)
    value, slope, curve = -0.5 * np.log(2 * math.pi * far), -0.5 / far, 0.5 / far**2
    for k, c in enumerate(_FAR, 1):
        value, slope, curve = value + c / far**k, slope - k * c / far ** (k + 1), curve + k * (k + 1) * c / far ** (k + 2)
    small = x < LARGE
    return np.where(small, _summed_log_i0(near) - near, value), np.where(small, ratio - 1, slope), np.where(small, bend, curve)


#: Cells of the table between a power of two of x + 1 and the next, as a power of two, and how many such stretches it has.
CELL_BITS, OCTAVES = 7, 30
_table: list[np.ndarray] = []


def _cells() -> list[np.ndarray]:
    """Coefficients, lowest first, of each cell's polynomial: log I0(x) - x with two derivatives right at both of its ends."""
    if not _table:
        h = np.repeat(2.0 ** (np.arange(OCTAVES) - CELL_BITS), 1 << CELL_BITS)
        start = np.concatenate([[0.0], np.cumsum(h)])
        value, slope, bend = _scaled(start)
        left, right, b, c = h * slope[:-1], h * slope[1:], h * h * bend[:-1], h * h * bend[1:]
        rise = value[1:] - value[:-1]
        in_steps = [value[:-1], left, b / 2, 10 * rise - 6 * left - 4 * right - 1.5 * b + 0.5 * c, -15 * rise + 8 * left + 7 * right + 1.5 * b - c, 6 * rise - 3 * (left + right) - 0.5 * (b - c)]
        _table.extend(v / h**k for k, v in enumerate(in_steps))
    return _table


#: Where the table ends.
BEYOND = 2.0**OCTAVES - 1


def tabled_log_i0(x: np.ndarray) -> np.ndarray:
    """log I0(x) of an array of 0 <= x < ``BEYOND``, from a table of polynomials of degree 5 whose cell the leading bits of x + 1 name."""
    t = x + 1
    cell = t.view(np.int64) >> (52 - CELL_BITS)
    t -= (cell << (52 - CELL_BITS)).view(float)
    cell -= 1023 << CELL_BITS
    c = _cells()
    out = c[5].take(cell, mode="clip")
    own = np.empty_like(out)
    for k in (4, 3, 2, 1, 0):
        out *= t
        c[k].take(cell, mode="clip", out=own)
        out += own
    out += x
    return out


def log_i0(x):
    """log I0(x) of any real x: ``tabled_log_i0`` of |x|, the asymptotic series beyond the table."""
    x = np.abs(np.asarray(x, float))
    out = tabled_log_i0(np.atleast_1d(x)).reshape(x.shape)
    far = x >= BEYOND
    if far.any():
        v = np.maximum(x, LARGE)
        out = np.where(far, v - 0.5 * np.log(2 * math.pi * v) + _FAR[0] / v, out)
    return out


def a1(x):
    """I1(x) / I0(x), 0 at 0."""
    x = np.asarray(x, float)
    tiny, small, big = np.minimum(x, 0.5), np.clip(x, 0.5, LARGE), np.maximum(x, LARGE)
    h = (tiny / 2) ** 2
    up, down, t1, t0 = np.ones_like(h), np.ones_like(h), np.ones_like(h), np.ones_like(h)
    for k in range(1, 12):
        t1, t0 = t1 * h / (k * (k + 1)), t0 * h / (k * k)
        up, down = up + t1, down + t0
    c = np.cos((np.arange(NODES) + 0.5) * (math.pi / NODES))
    e = np.exp(small[..., None] * (c - 1))
    return np.where(x < 0.5, tiny / 2 * up / down, np.where(x < LARGE, (e * c).mean(-1) / e.mean(-1), _series(big, 1) / _series(big, 0)))


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = np.max(x, axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0.0)
    return np.squeeze(m, axis) + np.log(np.sum(np.exp(x - m), axis=axis))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t, by bisection on the tail."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while t_two_sided(high, df) / 2 > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) / 2 > 1 - p else (low, mid)
    return (low + high) / 2
