"""Shape of one series: change points, decomposition, peaks, envelope, scalogram, warping."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from chronoloom.kernels.noise import acf


def detrended(x: np.ndarray) -> np.ndarray:
    t = np.arange(len(x))
    return x - np.polyval(np.polyfit(t, x, 1), t) if len(x) > 1 else x - x.mean()


def _median_gap(x: np.ndarray) -> float:
    """Median squared difference of all pairs of points, in memory of O(n): differences are counted, not listed."""
    x = np.sort(x)
    n = len(x)
    own = np.arange(n)
    pairs = n * (n - 1) // 2

    def ends(t: float) -> np.ndarray:
        return np.maximum(np.searchsorted(x, x + t, "right"), own + 1)

    def nth(k: int) -> float:
        """The k-th smallest difference: bisection over the bits of a double, then the nearest one that occurs."""
        low, high = -1, int(np.float64(x[-1] - x[0]).view(np.int64))
        while high - low > 1:
            middle = (low + high) // 2
            if (ends(np.int64(middle).view(np.float64)) - own - 1).sum() >= k:
                high = middle
            else:
                low = middle
        t = np.int64(high).view(np.float64)
        end = ends(t)
        near = np.concatenate([(x[np.minimum(end, n - 1)] - x)[end < n], (x[end - 1] - x)[end - 1 > own]])
        return float(near[np.abs(near - t).argmin()])

    middle = nth((pairs + 1) // 2)
    return (middle**2 + (middle if pairs % 2 else nth(pairs // 2 + 1)) ** 2) / 2


def change_points(x: np.ndarray, penalty_factor: float = 3.0, jump: int = 5) -> dict:
    """Penalised optimal segmentation under a radial-basis cost, with pruning.

    The kernel's sum over [s, e) squared is kept for each open start s and grows by one strip of columns as e
    moves on, so memory is O(n) at any length; time is O(n^2), as each pair of points is met once.
    """
    n = len(x)
    if n < 4:
        raise ValueError("too short")
    least, penalty = max(2, n // 20), penalty_factor * math.log(n)
    middle = _median_gap(x)
    inside = np.zeros(-(-n // jump))
    best, origin, starts, before = np.zeros(len(inside) + 1), {0: 0}, np.array([0]), 0
    best[0] = -penalty
    for e in [*range(jump, n, jump), n]:
        first = int(starts.min())
        rows = np.zeros(e - first)
        for column in x[before:e]:
            gap = (x[first:e] - column) ** 2
            rows += np.exp(-np.clip(gap / middle if middle > 0 else gap, 1e-2, 1e2))
        strips = np.add.reduceat(rows, np.arange(0, len(rows), jump))
        inside[first // jump : before // jump + 1] += 2 * strips[::-1].cumsum()[::-1] - strips[-1]
        size = e - starts
        usable = size >= least
        if usable.any():
            # A point's kernel with itself is exp(-0.01), the clipped gap.
            costs = size * math.exp(-1e-2) - inside[starts // jump] / size
            totals = np.where(usable, best[starts // jump] + costs + penalty, np.inf)
            at = int(totals.argmin())
            best[-(-e // jump)], origin[e] = totals[at], int(starts[at])
            starts = np.append(starts[~usable | (totals <= totals[at] + penalty)], e)
        before = e
    breaks, e = [], n
    while e > 0:
        breaks.append(e)
        e = origin.get(e, 0)
    bounds = [0, *sorted(breaks)]
    parts = [x[a:b] for a, b in itertools.pairwise(bounds)]
    means, stds = [float(p.mean()) for p in parts], [float(p.std()) for p in parts]
    shift = lambda v: max((abs(b - a) for a, b in itertools.pairwise(v)), default=0.0)
    return {
        "n_breakpoints": len(parts) - 1, "breakpoint_positions": [b / n for b in bounds[1:-1]], "segment_means": means, "segment_stds": stds,
        "largest_mean_shift": shift(means), "largest_std_shift": shift(stds),
    }


def _segment_trend(y: np.ndarray) -> tuple[float | None, float | None, str, str]:
    """Slope, r2, direction and best of the linear, exponential and logarithmic fits; ties go to the earlier."""
    if len(y) < 3:
        return None, None, "flat", "linear"
    t = np.arange(len(y), dtype=float)

    def r2(u: np.ndarray, v: np.ndarray) -> float:
        return float(np.corrcoef(u, v)[0, 1] ** 2) if np.ptp(v) > 0 else 0.0

    slope = float(np.polyfit(t, y, 1)[0]) if np.ptp(y) > 0 else 0.0
    flat = abs(slope) < (1e-4 * y.std() if y.std() > 0 else 1e-10)
    fits = {"linear": r2(t, y)} | ({"exponential": r2(t, np.log(y))} if y.min() > 0 else {}) | {"logarithmic": r2(np.log(t + 1), y)}
    return slope, fits["linear"], "flat" if flat else "upward" if slope > 0 else "downward", max(fits, key=fits.get)


def trend_segments(x: np.ndarray) -> dict:
    """Change points under a penalty of 10 ln n, against too many segments, and the trend of each segment."""
    found = change_points(x, 10.0)
    bounds = [0, *[round(p * len(x)) for p in found["breakpoint_positions"]], len(x)]
    slopes, r2s, directions, kinds = (list(c) for c in zip(*[_segment_trend(x[a:b]) for a, b in itertools.pairwise(bounds)], strict=True))
    return found | {
        "n_segments": len(slopes), "segment_slopes": slopes, "segment_r2s": r2s, "segment_directions": directions, "segment_best_fits": kinds,
    }


#: Numbers that a step of a decomposition works on at once: some MB, so that windows stay near the processor.
BLOCK = 1 << 18


def _windows(n: int, span: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For local fits at positions ``at`` of points 0 .. n - 1: the points of each window, their tricube weights, and how far they are."""
    width = min(span, n)
    start = np.clip(np.round(at - (width - 1) / 2).astype(int), 0, n - width)
    near = start[:, None] + np.arange(width)[None]
    far = near - at[:, None]
    reach = np.maximum(np.abs(far).max(axis=1), 1e-9) * (1.0 if span <= n else span / n) + 1e-9
    return near, (1 - np.minimum(np.abs(far) / reach[:, None], 1) ** 3) ** 3, far


def _smoother(n: int, span: int, at: np.ndarray, rows: int) -> Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]]:
    """Local linear fits with tricube weights at positions ``at`` of points 0 .. n - 1, for some rows at a time: from weights of points to a function of values.

    A fit is a weighted sum of its window.  These sums' weights are kept, or, where they are many, found again block by block.
    """
    step = max(1, BLOCK // (rows * min(span, n)))
    windows = [_windows(n, span, at)] if len(at) <= step else None

    def sums(weights: np.ndarray, near: np.ndarray, tricube: np.ndarray, t: np.ndarray) -> np.ndarray:
        w = weights.take(near, axis=1)
        w *= tricube
        total = w.sum(axis=2, keepdims=True)
        total[total <= 0] = 1e-300
        w /= total
        mean = np.einsum("bmw,mw->bm", w, t)[:, :, None]
        far = t - mean
        spread = np.einsum("bmw,bmw,bmw->bm", w, far, far)[:, :, None]
        far *= np.where(spread > 1e-12, -mean / np.maximum(spread, 1e-12), 0.0)
        far += 1
        w *= far
        return w

    def weighted(weights: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        if windows:
            near, w = windows[0][0], sums(weights, *windows[0])
            return lambda y: np.einsum("bmw,bmw->bm", np.broadcast_to(w, (len(y), *w.shape[1:])), y.take(near, axis=1))

        def fits(y: np.ndarray) -> np.ndarray:
            out = np.empty((len(y), len(at)))
            for a in range(0, len(at), step):
                window = _windows(n, span, at[a : a + step])
                w = sums(weights, *window)
                out[:, a : a + step] = np.einsum("bmw,bmw->bm", np.broadcast_to(w, (len(y), *w.shape[1:])), y.take(window[0], axis=1))
            return out

        return fits

    return weighted


def stl_together(x: np.ndarray, period: int, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Robust seasonal-trend decompositions by loess of series of one length and period, a row each: trend, seasonal, residual."""
    rows, n = x.shape
    odd = lambda v: int(math.ceil(v)) | 1
    trend_span, low_span = odd(1.5 * period / (1 - 1.5 / 7)), odd(period + 1)
    if rows > 1 and (most := max(1, BLOCK // (n * min(n, max(7, trend_span))))) < rows:
        parts = [stl_together(x[a : a + most], period, inner, outer) for a in range(0, rows, most)]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
    trend, seasonal, robust = np.zeros((rows, n)), np.zeros((rows, n)), np.ones((rows, n))
    mean = lambda v, w: np.einsum("bmw->bm", sliding_window_view(v, w, axis=1)) / w
    points = np.arange(n, dtype=float)
    lowly, trendly = _smoother(n, low_span, points, rows)(np.ones((1, n))), _smoother(n, trend_span, points, rows)
    # Seasons that begin in the first n % period positions have a point more than others.
    phases = [(m, a + np.arange(b - a)[:, None] + period * np.arange(m + 2)) for a, b, m in ((0, n % period, n // period + 1), (n % period, period, n // period)) if a < b]
    phases = [(m, i[:, :m], i, _smoother(m, 7, np.arange(-1, m + 1, dtype=float), rows * len(i))) for m, i in phases]
    for _ in range(outer + 1):
        seasons = [(i, every, fits(robust.take(i, axis=1).reshape(-1, m))) for m, i, every, fits in phases]
        trends = trendly(robust)
        for _ in range(inner):
            rest = x - trend
            cycle = np.empty((rows, n + 2 * period))
            for i, every, fits in seasons:
                cycle[:, every] = fits(rest.take(i, axis=1).reshape(-1, i.shape[1])).reshape(rows, *every.shape)
            low = lowly(mean(mean(mean(cycle, period), period), 3))
            seasonal = cycle[:, period : period + n] - low
            trend = trends(x - seasonal)
        e = np.abs(x - trend - seasonal)
        h = 6 * np.median(e, axis=1, keepdims=True)
        robust = np.where(h > 0, (1 - np.minimum(e / np.where(h > 0, h, 1), 1) ** 2) ** 2, 1.0)
    return trend, seasonal, x - trend - seasonal


def stl(x: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Robust seasonal-trend decomposition by loess: trend, seasonal, residual."""
    trend, season, rest = stl_together(x[None], period)
    return trend[0], season[0], rest[0]


def season_length(x: np.ndarray) -> int:
    """The first significant autocorrelation peak after detrending, else a tenth of the series."""
    n = len(x)
    r = acf(detrended(x), max(1, n // 2 - 1))
    for k in range(2, len(r) - 1):
        if r[k] > r[k - 1] and r[k] > r[k + 1] and r[k] > 2 / math.sqrt(n):
            return k
    return max(2, n // 10)


def _fitting(n: int, period: int) -> int:
    return max(2, n // 4) if n < 2 * period else period


def decompositions(series: list[np.ndarray], kernels: list[str]) -> list[tuple | None]:
    """For each series of at least 8 points its period, seasonal part, trend, residual, and residual of its logarithm (where decomposition_type asks for it).

    Series of one length and period go together, bit by bit as they would alone; one without a period has none.
    """
    found: list[tuple | None] = [None] * len(series)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, x in enumerate(series):
        if len(x) >= 8:
            try:
                groups.setdefault((len(x), _fitting(len(x), season_length(x))), []).append(k)
            except (ValueError, np.linalg.LinAlgError):
                continue
    for (n, period), members in groups.items():
        x = np.stack([series[k] for k in members])
        trends, seasons, rests = stl_together(x, period)
        positive = np.flatnonzero((x.min(axis=1) > 0) & ("decomposition_type" in kernels and n >= 16)).tolist()
        logged = dict(zip(positive, stl_together(np.log(x[positive]), period)[2], strict=True)) if positive else {}
        for i, k in enumerate(members):
            found[k] = period, trends[i], seasons[i], rests[i], logged.get(i)
    return found


def seasonal(x: np.ndarray, period: int | None = None, known: tuple | None = None) -> dict:
    """``known``: of ``decompositions``."""
    n = len(x)
    if n < 8:
        raise ValueError("too short")
    if known is None:
        period = _fitting(n, period or season_length(x))
        known = period, *stl(x, period)
    period, trend, season, rest = known[:4]
    strength = lambda c: max(0.0, 1 - rest.var() / (c + rest).var()) if (c + rest).var() > 0 else 0.0
    return {"stl_period_used": period, "seasonal_strength": strength(season), "trend_strength": strength(trend), "residual_std": float(rest.std())}


def decomposition_type(x: np.ndarray, known: tuple | None = None) -> dict:
    """Additive or multiplicative, by two votes: which scale leaves less residual, and whether spread follows level.  ``known``: of ``decompositions``."""
    n = len(x)
    if n < 16:
        raise ValueError("too short")
    if known is None:
        period = _fitting(n, season_length(x))
        known = period, *stl(x, period), stl(np.log(x), period)[2] if x.min() > 0 else None
    period, _, _, rest, logged = known
    share = lambda v, left: float(left.var() / v.var()) if v.var() > 0 else 0.0
    votes = []
    if x.min() > 0:
        votes.append("multiplicative" if share(np.log(x), logged) < 0.95 * share(x, rest) else "additive")
    size = max(4, 2 * period)
    starts = range(0, n - size + 1, max(1, size // 2))
    spread, level = np.array([x[s : s + size].std() for s in starts]), np.array([x[s : s + size].mean() for s in starts])
    follow = float(np.corrcoef(spread, level)[0, 1]) if len(starts) > 2 and spread.std() > 0 and level.std() > 0 else 0.0
    votes.append("multiplicative" if follow > 0.5 else "additive")
    kind = votes[0] if len(set(votes)) == 1 else "unknown"
    return {"decomp_type": kind, "decomp_confidence": 0.9 if len(votes) == 2 and kind != "unknown" else 0.5, "amplitude_trend_corr": follow}


def hilbert_envelope(x: np.ndarray) -> dict:
    """Smoothed envelope of the detrended series, its trend and the ratio of its halves."""
    n = len(x)
    if n < 8:
        raise ValueError("too short")
    f = np.fft.fft(detrended(x))
    f[1 : (n + 1) // 2] *= 2
    f[n // 2 + 1 :] = 0
    w = max(3, n // 50)
    envelope = np.convolve(np.abs(np.fft.ifft(f)), np.ones(w) / w, "same")
    t = np.arange(n)
    slope, base = np.polyfit(t, envelope, 1)
    explained = 1 - ((envelope - slope * t - base) ** 2).sum() / max(((envelope - envelope.mean()) ** 2).sum(), 1e-300)
    ratio = envelope[n // 2 :].mean() / max(envelope[: n // 2].mean(), 1e-12)
    change = slope * n / max(envelope.mean(), 1e-12)
    trend = "stable" if explained < 0.05 or abs(change) < 0.1 else "increasing" if change > 0 else "decreasing"
    return {"amplitude_ratio": float(ratio), "amplitude_change": "increasing" if ratio > 1.2 else "decreasing" if ratio < 0.8 else "stable", "amplitude_trend": trend}


def peaks(x: np.ndarray, prominence: float) -> list[int]:
    """Local maxima (plateaus by their middle) that rise at least ``prominence`` above both bases."""
    edges = np.flatnonzero(np.diff(x) != 0)
    starts = np.concatenate([[0], edges + 1])
    ends = np.concatenate([edges, [len(x) - 1]])
    out = []
    for i in range(1, len(starts) - 1):
        v = x[starts[i]]
        if x[starts[i - 1]] < v > x[starts[i + 1]]:
            left = x[: starts[i]]
            higher = np.flatnonzero(left > v)
            left_base = left[higher[-1] + 1 if len(higher) else 0 :].min()
            right = x[ends[i] + 1 :]
            higher = np.flatnonzero(right > v)
            right_base = right[: higher[0] if len(higher) else len(right)].min()
            if v - max(left_base, right_base) >= prominence:
                out.append((starts[i] + ends[i]) // 2)
    return out


def shape_features(x: np.ndarray) -> dict:
    if len(x) < 5 or np.ptp(x) == 0:
        raise ValueError("too short or constant")
    tops, bottoms = peaks(x, 0.05 * np.ptp(x)), peaks(-x, 0.05 * np.ptp(x))
    gaps = np.diff(tops)
    cv = gaps.std() / gaps.mean() if len(gaps) > 1 else None
    rises = [t - max(b for b in bottoms if b < t) for t in tops if any(b < t for b in bottoms)]
    falls = [min(b for b in bottoms if b > t) - t for t in tops if any(b > t for b in bottoms)]
    rise_fall = float(np.mean(rises) / np.mean(falls)) if rises and falls else None
    hint = "unknown" if rise_fall is None else "sawtooth" if not 0.5 <= rise_fall <= 2 else "symmetric"
    return {
        "peak_count": len(tops), "trough_count": len(bottoms), "peak_regularity": float(1 / (1 + cv)) if cv is not None else None,
        "rise_fall_ratio": rise_fall, "waveform_hint": hint,
    }


def scalogram(x: np.ndarray, w0: float = 5.0) -> np.ndarray:
    """Magnitudes of a Morlet transform, one row per width 1 .. min(64, n / 2) - 1."""
    n = len(x)
    d = (x - x.mean()) / (x.std() or 1.0)
    rows = []
    for width in range(1, max(2, min(64, n // 2))):
        t = np.arange(min(10 * width, n)) - (min(10 * width, n) - 1) / 2
        z = t / width
        wavelet = math.pi**-0.25 * np.exp(1j * w0 * z) * np.exp(-0.5 * z**2) / math.sqrt(width)
        rows.append(np.abs(np.convolve(d, np.conj(wavelet)[::-1], "same"))[:n])
    return np.stack(rows)


def warping(a: np.ndarray, b: np.ndarray) -> dict:
    """Dynamic time warping of the standardised series within a band, per step of the path."""
    z = lambda v: (v - v.mean()) / v.std() if v.std() > 0 else np.zeros(len(v))
    a, b = z(a), z(b)
    n, m = len(a), len(b)
    band = max(10, min(n, m) // 10)
    band = band if abs(n - m) <= band else max(n, m)  # no path leaves the corner otherwise
    # The last three anti-diagonals by i, and the steps of the path to each cell: memory is O(n) at any length.
    d, steps = np.full((3, n + 2), np.inf), np.zeros((3, n + 2), int)
    d[0, 0] = 0
    for s in range(2, n + m + 1):
        low, high = max(1, s - m, -((band - s) // 2)), min(n, s - 1, (s + band) // 2)
        this, one, two = s % 3, (s - 1) % 3, (s - 2) % 3
        d[this, low - 1], d[this, high + 1] = np.inf, np.inf
        own, up = slice(low, high + 1), slice(low - 1, high)
        choices = np.stack([d[two, up], d[one, up], d[one, own]])
        chosen = choices.argmin(axis=0)
        d[this, own] = np.abs(a[low - 1 : high] - b[s - high - 1 : s - low][::-1]) + choices.min(axis=0)
        steps[this, own] = 1 + np.choose(chosen, [steps[two, up], steps[one, up], steps[one, own]])
    distance = float(d[(n + m) % 3, n] / max(1, steps[(n + m) % 3, n]))
    return {"dtw_distance": distance, "dtw_similarity": 1 - math.tanh(distance)}


def jigsaw(segments: list[np.ndarray]) -> list[int]:
    """The order of at most 8 segments with the least total junction cost; the first of equals."""
    if len(segments) > 8:
        raise ValueError("too many segments")

    def cost(a: np.ndarray, b: np.ndarray) -> float:
        gap = (b[0] - a[-1]) ** 2
        return gap + 0.5 * ((b[1] - b[0]) - (a[-1] - a[-2])) ** 2 if min(len(a), len(b)) > 1 else gap

    table = [[cost(a, b) for b in segments] for a in segments]
    return list(min(itertools.permutations(range(len(segments))), key=lambda p: sum(table[a][b] for a, b in itertools.pairwise(p))))
