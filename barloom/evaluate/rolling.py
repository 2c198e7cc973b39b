"""Correlations of sliding windows at a cost that does not grow with the window, for one run of values in time order."""

from __future__ import annotations

import numpy as np

#: Values that are ranked at once.
_BLOCK = 1 << 20
#: Windows of a block at least.
BLOCK_WINDOWS = 64
#: Windows up to this size are ranked each by itself.
SMALL = 256
#: A spread below this share of what it is the difference of is taken from the window's values themselves.
DOUBTFUL = 1e-9


def window_ranks(values: np.ndarray) -> np.ndarray:
    """Average ranks within each row."""
    order = np.argsort(values, axis=1, kind="stable")
    ordered, width = np.take_along_axis(values, order, 1), values.shape[1]
    new = np.concatenate([np.ones((len(values), 1), bool), ordered[:, 1:] != ordered[:, :-1]], 1)
    place = np.broadcast_to(np.arange(width), values.shape)
    first = np.maximum.accumulate(np.where(new, place, 0), 1)
    ends = np.concatenate([new[:, 1:], np.ones((len(values), 1), bool)], 1)
    last = np.minimum.accumulate(np.where(ends, place, width)[:, ::-1], 1)[:, ::-1]
    out = np.empty(values.shape)
    np.put_along_axis(out, order, (first + last) / 2, 1)
    return out


def _ratio(xy: np.ndarray, xx: np.ndarray, yy: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((xx > 0) & (yy > 0), xy / np.sqrt(xx * yy), np.nan)


def rolling_rank_correlation(x: np.ndarray, y: np.ndarray, window: int) -> np.ndarray:
    """The rank correlation of each ``window`` values that follow each other, NaN where one side is constant."""
    if window > SMALL:
        return _ratio(*_rank_products(x, y, window))
    out, rows = [], max(1, _BLOCK // window)
    xs, ys = (np.lib.stride_tricks.sliding_window_view(v, window) for v in (x, y))
    for a in range(0, len(xs), rows):
        u, v = (window_ranks(w[a : a + rows]) - (window - 1) / 2 for w in (xs, ys))
        out.append(_ratio((u * v).sum(1), (u * u).sum(1), (v * v).sum(1)))
    return np.concatenate([np.array([]), *out])


def _above(sorted_values: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How many of the values lie below each of ``v``, equal ones by half."""
    return (np.searchsorted(sorted_values, v, "left") + np.searchsorted(sorted_values, v, "right")) / 2


class _Side:
    """One side of a block of windows: ranks are numbers of values below. The core stands in every window, the others come and go."""

    def __init__(self, core: np.ndarray, others: np.ndarray, window: int):
        self.order = np.argsort(core, kind="stable")
        self.sorted, self.core, self.others = core[self.order], core, others
        self.core_rank = _above(self.sorted, core) - window / 2
        self.own = _above(self.sorted, others) - window / 2
        self.among = (others[:, None] > others[None, :]) + (others[:, None] == others[None, :]) / 2
        self.marks, self.at = np.unique(others, return_inverse=True)
        #: Marks at most equal to each core value, and below it.
        self.upto, self.below = np.searchsorted(self.marks, core, "right"), np.searchsorted(self.marks, core, "left")

    def sums_above(self, weights: np.ndarray) -> np.ndarray:
        """For each of the others the weights of the core values above it, equal ones by half."""
        tail = np.concatenate([np.cumsum(weights[self.order][::-1])[::-1], [0.0]])
        return (tail[np.searchsorted(self.sorted, self.others, "left")] + tail[np.searchsorted(self.sorted, self.others, "right")]) / 2


def _product(p: _Side, q: _Side, present: np.ndarray) -> np.ndarray:
    """The sum over each window of the products of both centred ranks."""
    fixed = p.core_rank @ q.core_rank
    linear = present @ (q.sums_above(p.core_rank) + p.sums_above(q.core_rank))
    # core values above two of the others, one on each side: a table of counts, summed up from its far corner
    rows, cols = len(p.marks) + 1, len(q.marks) + 1
    table = sum(np.bincount(a * cols + b, minlength=rows * cols) for a in (p.upto, p.below) for b in (q.upto, q.below)).reshape(rows, cols) / 4
    both = table[::-1, ::-1].cumsum(0).cumsum(1)[::-1, ::-1][1:, 1:][np.ix_(p.at, q.at)]
    square = ((present @ both) * present).sum(1)
    moving = (present * (p.own + present @ p.among.T) * (q.own + present @ q.among.T)).sum(1)
    return fixed + linear + square + moving


def _rank_products(x: np.ndarray, y: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of products of centred ranks (xy, xx, yy) of all windows.

    Windows are taken in blocks of about the root of their size. What all windows of a block share is ranked once, the rest is few.
    All terms are multiples of a quarter, so that the sums are exact.
    """
    n, size, out = len(x) - window + 1, min(window, max(BLOCK_WINDOWS, int(window**0.5))), []
    for a in range(0, max(0, n), size):
        m = min(size, n - a)
        core, others = slice(a + m - 1, a + window), np.r_[a : a + m - 1, a + window : a + window + m - 1]
        step = np.arange(m - 1)
        left, right = step[None, :] >= np.arange(m)[:, None], step[None, :] < np.arange(m)[:, None]
        present = np.concatenate([left, right], 1).astype(float)
        p, q = _Side(x[core], x[others], window), _Side(y[core], y[others], window)
        out.append(np.stack([_product(p, q, present), _product(p, p, present), _product(q, q, present)]))
    found = np.concatenate([np.empty((3, 0)), *out], 1)
    return found[0], found[1], found[2]


def _constant(v: np.ndarray, window: int) -> np.ndarray:
    """Whether all values of each window are equal."""
    place = np.arange(len(v))
    begun = np.maximum.accumulate(np.where(np.concatenate([[True], v[1:] != v[:-1]]), place, 0))
    return (place - begun + 1 >= window)[window - 1 :]


def rolling_correlation(x: np.ndarray, y: np.ndarray, window: int) -> np.ndarray:
    """The correlation of each ``window`` values that follow each other, NaN where one side is constant.

    Sums from the start of a block on, of values less the block's mean, are subtracted from each other; windows whose spread is
    lost in that are computed by themselves.
    """
    n, out = len(x) - window + 1, []
    for a in range(0, max(0, n), window):
        b = min(n, a + window)
        u, v = (np.asarray(s[a : b + window - 1], np.longdouble) for s in (x, y))
        u, v = u - u.mean(), v - v.mean()

        def moving(z: np.ndarray, count: int = b - a) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(z)])
            return total[window : window + count] - total[:count]

        su, sv, suu, svv, suv = moving(u), moving(v), moving(u * u), moving(v * v), moving(u * v)
        xx, yy, xy = suu - su * su / window, svv - sv * sv / window, suv - su * sv / window
        whole_x, whole_y = (u * u).sum(), (v * v).sum()
        ic = np.array(_ratio(xy, xx, yy), float)
        doubtful = np.flatnonzero((xx <= DOUBTFUL * whole_x) | (yy <= DOUBTFUL * whole_y))
        for part in np.array_split(doubtful, max(1, len(doubtful) * window // _BLOCK)):
            if len(part):
                near = part[:, None] + np.arange(window)[None, :] + a
                c, d = x[near], y[near]
                c, d = c - c[:, :1], d - d[:, :1]  # exact where values lie close together
                c, d = c - c.mean(1, keepdims=True), d - d.mean(1, keepdims=True)
                ic[part] = _ratio((c * d).sum(1), (c * c).sum(1), (d * d).sum(1))
        out.append(ic)
    found = np.concatenate([np.array([]), *out])
    if n > 0:
        found[_constant(x, window) | _constant(y, window)] = np.nan
    return np.clip(found, -1, 1)
