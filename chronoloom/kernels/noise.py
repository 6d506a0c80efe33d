"""Tests of one series: unit root, stationarity, whiteness, partial autocorrelation, conditional variance.

Published-method equivalents (MacKinnon's response surface, Hobijn's lag choice, Durbin-Levinson, Engle's LM).
"""

from __future__ import annotations

import math

import numpy as np

from chronoloom.kernels.tails import chi2_tail, f_tail, normal_cdf


def acf(x: np.ndarray, lags: int) -> np.ndarray:
    d = x - x.mean()
    total = d @ d
    return np.array([1.0] + [d[:-k] @ d[k:] / total if total > 0 else 0.0 for k in range(1, lags + 1)])


def pacf(x: np.ndarray) -> dict:
    """Partial autocorrelations and the kind of process their cut-off suggests."""
    n = len(x)
    lags = min(20, n // 2 - 1)
    if lags < 1 or x.var() == 0:
        raise ValueError("too short or constant")
    r = acf(x, lags)
    phi, out = np.zeros(0), [1.0]
    for k in range(1, lags + 1):
        top = r[k] - phi @ r[k - 1 : 0 : -1][: k - 1] if k > 1 else r[1]
        bottom = 1 - phi @ r[1:k] if k > 1 else 1.0
        last = top / bottom if bottom else 0.0
        phi = np.append(phi - last * phi[::-1], last)
        out.append(float(last))
    bound = 2 / math.sqrt(n)
    big_p = [k for k in range(1, lags + 1) if abs(out[k]) > bound]
    big_a = [k for k in range(1, lags + 1) if abs(r[k]) > bound]
    kind = "white" if not big_p and not big_a else "AR" if len(big_p) < len(big_a) else "MA" if len(big_a) < len(big_p) else "ARMA"
    return {"pacf_at_lag1": out[1], "pacf_at_lag2": out[2] if lags > 1 else None, "process_type_hint": kind, "acf_at_lag1": float(r[1])}


def ljung_box(x: np.ndarray) -> dict:
    n = len(x)
    lags = max(1, min(20, n // 4))
    r = acf(x, lags)
    q = n * (n + 2) * np.cumsum(r[1:] ** 2 / (n - np.arange(1, lags + 1)))
    p = [chi2_tail(float(v), k) for k, v in enumerate(q, 1)]
    return {"lb_pval_min": min(p), "is_white_noise": min(p) >= 0.05}


def _ols(y: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
    a = np.stack(columns, axis=1)
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    residual = y - a @ beta
    return beta, a, float(residual @ residual)


def adf(x: np.ndarray) -> tuple[float, float, int]:
    """t statistic, p and lags of the augmented Dickey-Fuller test with a constant, lags by AIC."""
    n, most = len(x), 0
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 3)
    if most < 0 or np.ptp(x) == 0:
        raise ValueError("too short or constant")
    d = np.diff(x)

    def design(lags: int, skip: int) -> tuple[np.ndarray, list[np.ndarray]]:
        rows = len(d) - skip
        return d[skip:], [x[skip:-1], *[d[skip - i : skip - i + rows] for i in range(1, lags + 1)], np.ones(rows)]

    def aic(lags: int) -> float:
        y, columns = design(lags, most)
        ssr = _ols(y, columns)[2]
        return len(y) * math.log(max(ssr, 1e-300) / len(y)) + 2 * len(columns)

    lags = min(range(most + 1), key=aic)
    y, columns = design(lags, lags)
    beta, a, ssr = _ols(y, columns)
    spread = ssr / (len(y) - a.shape[1]) * np.linalg.pinv(a.T @ a)[0, 0]
    t = float(beta[0] / math.sqrt(max(spread, 1e-300)))
    if t < -18.83 or t > 2.74:
        return t, float(t > 2.74), lags
    # MacKinnon's surface for a constant, below and above its bend.
    surface = (2.1659, 1.4412, 0.038269) if t <= -1.61 else (1.7339, 0.93202, -0.12745, -0.010368)
    return t, normal_cdf(sum(c * t**i for i, c in enumerate(surface))), lags


def kpss(x: np.ndarray) -> tuple[float, float, int]:
    """Statistic, p (within .01 and .10) and lags of the level-stationarity test."""
    n = len(x)
    e = x - x.mean()
    reach = int(n ** (2 / 9))
    products = [float(e[i:] @ e[: n - i]) for i in range(reach + 1)]
    s0 = products[0] / n + sum(2 * p / n for p in products[1:])
    s1 = sum(2 * i * p / n for i, p in enumerate(products) if i)
    lags = int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)) if s0 else 0
    lags = min(lags, n - 1)
    variance = products[0] / n + sum(2 * (1 - i / (lags + 1)) * float(e[i:] @ e[: n - i]) / n for i in range(1, lags + 1))
    statistic = float((np.cumsum(e) ** 2).sum() / n**2 / variance) if variance > 0 else 0.0
    # Critical values and their p.
    return statistic, float(np.interp(statistic, (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01))), lags


def stationarity(x: np.ndarray) -> dict:
    a, k = adf(x)[1], kpss(x)[1]
    return {"adf_pval": a, "kpss_pval": k, "is_stationary": a < 0.05 and k >= 0.05}


def arch_lm(x: np.ndarray, lags: int = 12) -> dict:
    """Engle's LM test on the squared, demeaned series."""
    if len(x) < max(20, lags + 5) or x.var() == 0:
        raise ValueError("too short or constant")
    u = (x - x.mean()) ** 2
    y = u[lags:]
    ssr = _ols(y, [np.ones(len(y)), *[u[lags - i : -i] for i in range(1, lags + 1)]])[2]
    total = float(((y - y.mean()) ** 2).sum())
    lm = len(y) * (1 - ssr / total) if total > 0 else 0.0
    p = chi2_tail(lm, lags)
    return {"arch_lm_stat": lm, "arch_pvalue": p, "arch_effect_detected": p < 0.05}


def granger(a: np.ndarray, b: np.ndarray, lag: int) -> float:
    """p of the F test that past values of ``a`` help to predict ``b``; 1 where they don't."""
    keep = ~(np.isnan(a) | np.isnan(b))
    a, b = a[keep], b[keep]
    if len(b) < 3 * lag + 1:
        raise ValueError("too short")
    y = b[lag:]
    own = [np.ones(len(y)), *[b[lag - i : -i] for i in range(1, lag + 1)]]
    restricted = _ols(y, own)[2]
    full = _ols(y, own + [a[lag - i : -i] for i in range(1, lag + 1)])[2]
    free = len(y) - 2 * lag - 1
    if full >= restricted or free <= 0:
        return 1.0
    return f_tail((restricted - full) / lag / (max(full, 1e-300) / free), lag, free)


def granger_lag(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The order of the vector autoregression of both with the least AIC."""

    def aic(p: int) -> float:
        y = np.stack([a[p:], b[p:]], axis=1)
        x = np.stack([np.ones(len(y)), *[s[p - i : -i] for i in range(1, p + 1) for s in (a, b)]], axis=1)
        residual = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        return float(np.linalg.slogdet(residual.T @ residual / len(y))[1]) + 2 * 2 * x.shape[1] / len(y)

    return min(range(1, most + 1), key=aic) if most >= 1 else 1


def causality(a: np.ndarray, b: np.ndarray) -> dict:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    lag = granger_lag(a, b, min(5, n // 20))
    forth, back = granger(a, b, lag), granger(b, a, lag)
    direction = "bidirectional" if max(forth, back) < 0.05 else "a->b" if forth < 0.05 else "b->a" if back < 0.05 else "none"
    return {"granger_best_lag": lag, "pval_12": forth, "pval_21": back, "direction": direction}
