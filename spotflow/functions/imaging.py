"""Per-frame numerics in numpy: kernels, band pass, centroids, maxima, refinement, photometry."""

from __future__ import annotations

import math

import numpy as np


def disc(radius: float) -> np.ndarray:
    """Offsets (di, dj) with di² + dj² <= radius²."""
    r = math.floor(radius)
    i, j = np.mgrid[-r : r + 1, -r : r + 1]
    inside = i * i + j * j <= radius * radius
    return np.stack([i[inside], j[inside]], axis=1)


def annulus(inner: float, outer: float) -> np.ndarray:
    """Offsets with inner² <= di² + dj² <= outer², both ends included."""
    both = disc(outer)
    return both[(both**2).sum(axis=1) >= inner * inner]


def gaussian_kernel(variance: float, radius: int) -> np.ndarray:
    x = np.arange(-radius, radius + 1)
    return np.exp(-x * x / (2.0 * variance))


def normalise(kernel: np.ndarray) -> np.ndarray:
    return kernel / kernel.sum()


def box_kernel(size: int) -> np.ndarray:
    return np.full(size, 1.0 / size)


def band_kernel(variance: float, size: int) -> np.ndarray:
    """Gaussian less box, both of one size, as one two-dimensional kernel."""
    g = normalise(gaussian_kernel(variance, size // 2))
    return np.outer(g, g) - np.outer(box_kernel(size), box_kernel(size))


def filter_axis(image: np.ndarray, kernel: np.ndarray, axis: int, boundary: str) -> np.ndarray:
    """Symmetric kernel along an axis; boundary: zero, reflect (d c b a | a b c d) or replicate."""
    r = len(kernel) // 2
    mode = {"zero": "constant", "reflect": "symmetric", "replicate": "edge"}[boundary]
    wide = np.pad(image, [(r, r) if a == axis else (0, 0) for a in range(image.ndim)], mode=mode)
    n = image.shape[axis]
    return sum(k * np.take(wide, range(i, i + n), axis=axis) for i, k in enumerate(kernel))


def blur(image: np.ndarray, sigma: float, boundary: str = "reflect") -> np.ndarray:
    """Gaussian blur, cut off at four standard deviations."""
    kernel = normalise(gaussian_kernel(sigma * sigma, int(4 * sigma + 0.5)))
    return filter_axis(filter_axis(image, kernel, 0, boundary), kernel, 1, boundary)


def bandpass(image: np.ndarray, variance: float, size: int, threshold: float = 0.0, replicate: bool = False) -> np.ndarray:
    """Gaussian less local mean, separably; what is below the threshold, and negative, becomes 0.

    The Gaussian is as wide as the box and counts nothing beyond the frame though its weights do, so
    borders darken; the mean is mirrored there. With replicate, the Gaussian reaches to four standard
    deviations and the mean repeats the border.
    """
    g = normalise(gaussian_kernel(variance, int(4 * math.sqrt(variance) + 0.5) if replicate else size // 2))
    smooth = filter_axis(filter_axis(image, g, 1, "zero"), g, 0, "zero")
    edge = "replicate" if replicate else "reflect"
    ones = np.ones(size)
    mean = filter_axis(filter_axis(image, ones, 1, edge), ones, 0, edge) / (size * size)
    out = smooth - mean
    return np.where(out >= threshold, np.maximum(out, 0.0), 0.0)


def shifted(image: np.ndarray, di: int, dj: int, fill: float) -> np.ndarray:
    """image[u + di, v + dj], fill beyond the frame."""
    out = np.full(image.shape, fill, image.dtype)
    h, w = image.shape
    if abs(di) < h and abs(dj) < w:
        out[max(0, -di) : h - max(0, di), max(0, -dj) : w - max(0, dj)] = image[max(0, di) : h - max(0, -di), max(0, dj) : w - max(0, -dj)]
    return out


def centres(image: np.ndarray, diameter: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mass and centroid offsets of the disc round every pixel; 0 where the disc leaves the frame."""
    r = diameter // 2
    mass, down, right = (np.zeros(image.shape) for _ in range(3))
    for i, j in disc((diameter - 1) / 2):
        part = shifted(image, i, j, 0.0)
        mass += part
        down += i * part
        right += j * part
    inside = np.zeros(image.shape, bool)
    inside[r : image.shape[0] - r, r : image.shape[1] - r] = True
    mass = np.where(inside, mass, 0.0)
    full = mass != 0
    safe = np.where(full, mass, 1.0)
    return mass, np.where(full, down / safe, 0.0), np.where(full, right / safe, 0.0)


def window_size(separation: float) -> int:
    """Side of the square in which a maximum stands alone."""
    return int(2 * separation / math.sqrt(2))


def maxima(image: np.ndarray, separation: float) -> np.ndarray:
    """Pixels that no pixel of their window exceeds; ties keep both."""
    k = window_size(separation)
    before = int(k / 2 - 0.5)
    top = image
    for axis in (1, 0):
        steps = [shifted(top, d if axis == 0 else 0, d if axis == 1 else 0, -np.inf) for d in range(-before, k - before)]
        top = np.max(steps, axis=0) if steps else top
    return image >= top


def walk(u: np.ndarray, v: np.ndarray, planes: tuple[np.ndarray, np.ndarray, np.ndarray], iterations: int, shift: float = 0.6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, x and mass of candidates after whole-pixel steps towards their centroids.

    A walk that uses up its steps has moved once more than it has looked, as the contract of results has it.
    """
    mass, down, right = planes
    u, v = u.copy(), v.copy()
    h, w = mass.shape
    c0, c1, m = down[u, v], right[u, v], mass[u, v]
    going = np.ones(len(u), bool)
    for _ in range(iterations):
        c0, c1, m = np.where(going, down[u, v], c0), np.where(going, right[u, v], c1), np.where(going, mass[u, v], m)
        du = np.where((c0 > shift) & (u < h - 1), 1, np.where((c0 < -shift) & (u > 0), -1, 0)) * going
        dv = np.where((c1 > shift) & (v < w - 1), 1, np.where((c1 < -shift) & (v > 0), -1, 0)) * going
        u, v = u + du, v + dv
        going = (du != 0) | (dv != 0)
        if not going.any():
            break
    return u + c0, v + c1, m


def refine(image: np.ndarray, u: np.ndarray, v: np.ndarray, radius: int, iterations: int = 10, shift: float = 0.6) -> tuple[np.ndarray, ...]:
    """y, x, mass and signal (the largest pixel) after steps of a pixel towards the centroid of the disc round each place.

    The centroid is taken anew after each step; places are held within the frame less the radius, unlike in
    walk(). A disc without mass stays where it is.
    """
    h, w = image.shape
    offsets = np.array([(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius])
    u, v = np.clip(u, radius, max(radius, h - 1 - radius)), np.clip(v, radius, max(radius, w - 1 - radius))
    going = np.ones(len(u), bool)
    for k in range(iterations + 1):
        values = np.nan_to_num(disc_values(image, u, v, offsets))
        mass = values.sum(axis=1)
        down, right = (np.where(mass > 0, values @ offsets[:, axis] / np.where(mass > 0, mass, 1.0), 0.0) for axis in (0, 1))
        if k == iterations:
            break
        du, dv = (np.where(going & (np.abs(c) > shift), np.sign(c), 0).astype(int) for c in (down, right))
        nu, nv = np.clip(u + du, radius, max(radius, h - 1 - radius)), np.clip(v + dv, radius, max(radius, w - 1 - radius))
        going = (nu != u) | (nv != v)
        if not going.any():
            break
        u, v = nu, nv
    return u + down, v + right, mass, values.max(axis=1, initial=0.0)


def disc_values(image: np.ndarray, u: np.ndarray, v: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Pixel values round each position, NaN beyond the frame."""
    a, b = u[:, None] + offsets[:, 0], v[:, None] + offsets[:, 1]
    inside = (a >= 0) & (a < image.shape[0]) & (b >= 0) & (b < image.shape[1])
    return np.where(inside, image[np.clip(a, 0, image.shape[0] - 1), np.clip(b, 0, image.shape[1] - 1)], np.nan)


def character(processed: np.ndarray, u: np.ndarray, v: np.ndarray, mass: np.ndarray, diameter: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Radius of gyration, eccentricity and peak of the discs round the candidates, over the given masses."""
    offsets = disc((diameter - 1) / 2)
    p = np.nan_to_num(disc_values(processed, u, v, offsets))
    theta = np.arctan2(offsets[:, 1], offsets[:, 0])
    with np.errstate(divide="ignore", invalid="ignore"):
        rg = np.sqrt((p * (offsets**2).sum(axis=1)).sum(axis=1) / mass)
        ecc = np.hypot((p * np.sin(2 * theta)).sum(axis=1), (p * np.cos(2 * theta)).sum(axis=1)) / (mass - processed[u, v])
    return rg, ecc, np.maximum(p.max(axis=1, initial=0.0), 0.0)


def close_losers(y: np.ndarray, x: np.ndarray, mass: np.ndarray, separation: float) -> np.ndarray:
    """Points with a neighbour nearer than separation that has more mass, or the same and came first.

    All points judge, losers included. Neighbours are looked up in cells of side separation.
    """
    lost = np.zeros(len(y), bool)
    cells: dict[tuple[int, int], list[int]] = {}
    keys = list(zip((y // separation).astype(int).tolist(), (x // separation).astype(int).tolist(), strict=True))
    for i, k in enumerate(keys):
        cells.setdefault(k, []).append(i)
    for i, (a, b) in enumerate(keys):
        near = np.array([j for da in (-1, 0, 1) for db in (-1, 0, 1) for j in cells.get((a + da, b + db), ()) if j != i], int)
        if len(near):
            close = (y[near] - y[i]) ** 2 + (x[near] - x[i]) ** 2 < separation**2
            lost[i] = (close & ((mass[near] > mass[i]) | ((mass[near] == mass[i]) & (near < i)))).any()
    return lost


def half_away(a: np.ndarray) -> np.ndarray:
    """Rounded, halves away from 0."""
    return (np.sign(a) * np.floor(np.abs(a) + 0.5)).astype(int)


def row_medians(values: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Median of the counted values of each row, NaN where there are none."""
    n = counted.sum(axis=1)
    if not values.shape[1]:
        return np.full(len(values), np.nan)
    ordered = np.sort(np.where(counted, values, np.inf), axis=1)
    rows = np.arange(len(values))
    with np.errstate(invalid="ignore"):
        return np.where(n > 0, (ordered[rows, np.maximum(n - 1, 0) // 2] + ordered[rows, np.minimum(n // 2, values.shape[1] - 1)]) / 2, np.nan)


def native_roi(image: np.ndarray, y: np.ndarray, x: np.ndarray, signal: float, background: float | None = None, gap: float = 0.0) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Disc sum, annulus median and sum less median times the disc's full pixel count."""
    u, v = half_away(y), half_away(x)
    offsets = disc(signal)
    total = np.nansum(disc_values(image, u, v, offsets), axis=1)
    if background is None:
        return total, None, None
    ring = disc_values(image, u, v, annulus(signal + gap, background))
    median = row_medians(ring, ~np.isnan(ring))
    return total, median, total - median * len(offsets)


def lab_roi(image: np.ndarray, y: float, x: float, int_r2: float, bg_r2: float, gap_r2: float) -> dict:
    """Sums and medians within squared radii of a sub-pixel position, clipped at the frame."""
    reach = math.ceil(math.sqrt(bg_r2))
    rows = np.arange(max(0, int(y) - reach + 1), min(image.shape[0], int(y) + reach + 1))
    cols = np.arange(max(0, int(x) - reach + 1), min(image.shape[1], int(x) + reach + 1))
    d2 = (rows[:, None] - y) ** 2 + (cols[None, :] - x) ** 2
    part = image[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1] if len(rows) and len(cols) else np.zeros(d2.shape)
    own, ring = part[d2 <= int_r2], part[(d2 <= bg_r2) ^ (d2 <= int_r2 + gap_r2)]
    median = float(np.median(ring)) if len(ring) else math.nan
    return {"int": float(own.sum()), "bg": median, "sig_pixel_size": len(own), "int_mean": float(own.mean()) if len(own) else math.nan, "bg_mean": float(ring.mean()) if len(ring) else math.nan, "int_corrected": float(own.sum()) - median * len(own)}


def lab_rois(image: np.ndarray, y: np.ndarray, x: np.ndarray, int_r2: float, bg_r2: float, gap_r2: float, chunk: int = 4096) -> dict[str, np.ndarray]:
    """lab_roi of many positions at once; its masks have one shape, so that all are measured together."""
    reach = math.ceil(math.sqrt(bg_r2))
    span = np.arange(-reach + 1, reach + 1)
    parts: list[dict[str, np.ndarray]] = []
    for a in range(0, len(y), chunk):
        b, c = np.asarray(y[a : a + chunk], float)[:, None], np.asarray(x[a : a + chunk], float)[:, None]
        u, v = np.trunc(b).astype(np.int64) + span, np.trunc(c).astype(np.int64) + span
        inside = ((u >= 0) & (u < image.shape[0]))[:, :, None] & ((v >= 0) & (v < image.shape[1]))[:, None, :]
        d2 = ((u - b) ** 2)[:, :, None] + ((v - c) ** 2)[:, None, :]
        values = image[np.clip(u, 0, image.shape[0] - 1)[:, :, None], np.clip(v, 0, image.shape[1] - 1)[:, None, :]].astype(float)
        own, ring = inside & (d2 <= int_r2), inside & ((d2 <= bg_r2) ^ (d2 <= int_r2 + gap_r2))
        flat = lambda m: m.reshape(len(m), -1)
        size, around = flat(own).sum(axis=1), flat(ring).sum(axis=1)
        total, background = flat(np.where(own, values, 0.0)).sum(axis=1), flat(np.where(ring, values, 0.0)).sum(axis=1)
        median = row_medians(flat(values), flat(ring))
        with np.errstate(invalid="ignore", divide="ignore"):
            parts.append({"int": total, "bg": median, "sig_pixel_size": size, "int_mean": total / size, "bg_mean": background / around, "int_corrected": total - median * size})
    names = ("int", "bg", "sig_pixel_size", "int_mean", "bg_mean", "int_corrected")
    return {k: np.concatenate([np.zeros(0, np.int64 if k == "sig_pixel_size" else float), *(p[k] for p in parts)]) for k in names}
