"""Sums of squared displacements of many tracks for all lags, without a row for each pair of detections."""

from __future__ import annotations

import numpy as np

#: Lags from which on a track's sums come from Fourier transforms instead of one comparison for each lag.
MANY_LAGS = 128


def merged(group: np.ndarray, frame: np.ndarray, x: np.ndarray, y: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """group, frame, own, and of each the number of detections, sums of x and y, and of their squares; rows come sorted by group and frame."""
    fresh = np.append(True, (group[1:] != group[:-1]) | (frame[1:] != frame[:-1]))[: len(group)]
    at = np.flatnonzero(fresh)
    total = lambda v: np.add.reduceat(v, at) if len(at) else v
    return group[at], frame[at], own[at], total(np.ones(len(x), np.int64)), total(x), total(y), total(x * x + y * y)


def compared(rows: tuple[np.ndarray, ...], max_lag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """group, lag, sum, number over pairs of merged() rows, one comparison of all rows for each distance between them."""
    group, frame, own, n, x, y, q = rows
    out_g, out_l, out_s, out_n = [], [], [], []
    for k in range(1, max_lag + 1):  # frames of a group differ, so a lag is no less than the distance
        if k >= len(group):
            break
        lag = frame[k:] - frame[:-k]
        i = np.flatnonzero((group[k:] == group[:-k]) & (lag <= max_lag) & own[:-k])
        if not len(i):
            continue
        j = i + k
        out_g.append(group[i])
        out_l.append(lag[i])
        out_s.append(n[i] * q[j] + n[j] * q[i] - 2 * (x[i] * x[j] + y[i] * y[j]))
        out_n.append(n[i] * n[j])
    if not out_g:
        return tuple(np.zeros(0, d) for d in (np.int64, np.int64, x.dtype, np.int64))
    g, lags, s, c = (np.concatenate(v) for v in (out_g, out_l, out_s, out_n))
    key = g * (max_lag + 1) + lags
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    return g[order][begin], lags[order][begin], np.add.reduceat(s[order], begin), np.add.reduceat(c[order], begin)


def correlated(rows: tuple[np.ndarray, ...], max_lag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lag, sum, number for one group's merged() rows, from masked correlations: of the counts, the sums and the squares.

    sum (x' - x)² over pairs is sum x'² + sum x² - 2 sum x' x, each of which is a correlation with the mask of frames that have
    detections. Whole numbers give whole sums, as long as these are below 2**44.
    """
    _, frame, own, n, x, y, q = rows
    at = frame - frame[0]
    size = 1 << int(2 * (at[-1] + 1) - 1).bit_length()

    def spread(v: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(size)
        out[at] = v if mask is None else np.where(mask, v, 0)
        return np.fft.rfft(out)

    starts, ends = [spread(v, own) for v in (n, x, y, q)], [spread(v) for v in (n, x, y, q)]
    pairs = lambda a, b: np.fft.irfft(np.conj(a) * b, size)[: max_lag + 1]
    count = np.rint(pairs(starts[0], ends[0])).astype(np.int64)
    s = pairs(starts[0], ends[3]) + pairs(starts[3], ends[0]) - 2 * (pairs(starts[1], ends[1]) + pairs(starts[2], ends[2]))
    lag = np.flatnonzero(count[1:] > 0) + 1
    return lag, np.rint(s[lag]).astype(np.int64) if x.dtype.kind == "i" else np.maximum(s[lag], 0.0), count[lag]


def lag_sums(group: np.ndarray, frame: np.ndarray, x: np.ndarray, y: np.ndarray, own: np.ndarray, max_lag: int, many: int = MANY_LAGS) -> tuple[np.ndarray, ...]:
    """group, lag, sum of squared displacements, number of pairs, for lags from 1 to max_lag.

    Rows come sorted by group and frame. Pairs begin at rows that are own; a group's other rows only end them. Positions
    are taken relative to their group's first one, so that sums stay small.
    """
    if not len(group):
        return tuple(np.zeros(0, d) for d in (np.int64, np.int64, x.dtype, np.int64))
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    whose = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(group))))
    rows = merged(group, frame, x - x[first][whose], y - y[first][whose], own)
    if max_lag < many:
        return compared(rows, max_lag)
    edges = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1])).tolist()
    parts = []
    for a, b in zip(edges, [*edges[1:], len(rows[0])], strict=True):
        one = tuple(v[a:b] for v in rows)
        # few detections, or whole numbers too large for transforms, are compared pair by pair
        if b - a < many or (x.dtype.kind == "i" and float(one[6].sum()) * float(one[3].sum()) >= 2.0**44):
            parts.append(compared(one, max_lag))
        else:
            lag, s, n = correlated(one, max_lag)
            parts.append((np.full(len(lag), one[0][0]), lag, s, n))
    return tuple(np.concatenate(v) for v in zip(*parts, strict=True))
