"""Kernels against independent recomputation and published anchors."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from chronoloom.kernels import noise, shape, tails
from chronoloom.operators import kernels


def test_tails():
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    even = math.exp(-5) * sum(5**i / math.factorial(i) for i in range(6))
    assert tails.chi2_tail(10, 12) == pytest.approx(even, abs=1e-12)
    assert tails.f_tail(4.0, 1, 10) == pytest.approx(0.0734, abs=1e-4)


def test_unit_root_and_stationarity_disagree_on_the_anchor():
    x = np.random.default_rng(5).normal(0, 1, 200)
    t, p, lags = noise.adf(x)
    statistic, k, reach = noise.kpss(x)
    assert lags == 2 and t == pytest.approx(-7.758, abs=0.01) and p < 1e-9
    assert reach == 2 and statistic == pytest.approx(0.5151, abs=1e-3) and k == pytest.approx(0.0383, abs=1e-3)
    assert not noise.stationarity(x)["is_stationary"]


def test_granger_finds_the_cause():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=200), np.zeros(200)
    for t in range(2, 200):
        y[t] = 0.9 * x[t - 2] + rng.normal() * 0.1
    assert noise.granger(x, y, 3) < 1e-6
    assert noise.granger(y, x, 3) > 0.001


def test_decomposition_adds_up_and_finds_the_season():
    t = np.arange(120)
    x = 0.05 * t + np.sin(2 * np.pi * t / 12) + np.random.default_rng(1).normal(0, 0.05, 120)
    trend, season, rest = shape.stl(x, 12)
    assert np.allclose(trend + season + rest, x)
    assert shape.season_length(x) in (11, 12, 13)
    assert shape.seasonal(x, 12)["seasonal_strength"] > 0.9


def test_series_are_decomposed_together_as_alone(monkeypatch):
    rng = np.random.default_rng(4)
    series = [np.abs(rng.normal(5, 1, n)) + 2 * np.sin(np.arange(n) * 2 * np.pi / 6) + (4 if k % 3 else -9) for k, n in enumerate([60] * 30 + [61] * 5 + [7, 9])]
    alone = [None if len(x) < 8 else (shape.seasonal(x), shape.decomposition_type(x) if len(x) >= 16 else None) for x in series]
    calls, plain = [], shape.stl_together
    monkeypatch.setattr(shape, "stl_together", lambda x, *a: calls.append(len(x)) or plain(x, *a))
    known = shape.decompositions(series, ["seasonal", "decomposition_type"])
    assert len(calls) < 20 and max(calls) > 20  # 36 series, raw and logged
    for x, k, told in zip(series, known, alone, strict=True):
        assert (k is None) == (told is None) and (k is None or shape.seasonal(x, known=k) == told[0])
        assert len(x) < 16 or shape.decomposition_type(x, k) == told[1]
    monkeypatch.setattr(shape, "BLOCK", 64)  # a long series in blocks
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(plain(series[0][None], known[0][0]), known[0][1:4], strict=True))


def test_rows_are_gathered_across_batches(monkeypatch):
    monkeypatch.setattr(kernels, "HELD", 10)
    rows = [(k, None if k == 3 else [float(k)] * (k % 5) + [None, float("nan")]) for k in range(40)]
    table = pa.table({"series_id": pa.array([k for k, _ in rows]), "values": pa.array([v for _, v in rows], pa.list_(pa.float64()))})
    for size in (1, 7, 40):
        got = list(kernels._gathered(iter(table.to_batches(max_chunksize=size))))
        assert [k for keys, _ in got for k in keys.to_pylist()] == list(range(40)) and 5 < len(got) < 12
        assert [x.tolist() for _, cells in got for (x,) in cells] == [[] if k == 3 else [float(k)] * (k % 5) for k in range(40)]
    assert list(kernels._gathered(iter(table.slice(0, 0).to_batches()))) == []


def test_change_point():
    x = np.concatenate([np.zeros(60), np.full(60, 5.0)]) + np.random.default_rng(2).normal(0, 0.1, 120)
    found = shape.change_points(x)
    assert found["n_breakpoints"] == 1 and found["breakpoint_positions"] == [0.5]


def test_warping_against_plain_dynamic_programming():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=20), rng.normal(size=23)
    z = lambda v: (v - v.mean()) / v.std()
    p, q = z(a), z(b)
    d = np.full((21, 24), np.inf)
    d[0, 0] = 0
    for i, j in itertools.product(range(1, 21), range(1, 24)):
        if abs(i - j) <= 10:
            d[i, j] = abs(p[i - 1] - q[j - 1]) + min(d[i - 1, j - 1], d[i - 1, j], d[i, j - 1])
    got = shape.warping(a, b)["dtw_distance"]
    assert any(got == pytest.approx(d[20, 23] / steps) for steps in range(20, 44))
    assert shape.warping(a, a)["dtw_distance"] == 0


def test_long_series_are_not_refused():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 2500), rng.normal(4, 1, 2000), rng.normal(-3, 1, 1500)])
    assert shape.change_points(x)["breakpoint_positions"] == pytest.approx([2500 / 6000, 4500 / 6000], abs=0.002)
    n = 4100
    a, b = rng.normal(size=n).cumsum(), rng.normal(size=n).cumsum()
    z = lambda v: ((v - v.mean()) / v.std()).tolist()
    p, q = z(a), z(b)
    far, band = (math.inf, 0), n // 10
    row = [(0.0, 0)] + [far] * n
    for i in range(1, n + 1):
        new = [far] * (n + 1)
        for j in range(max(1, i - band), min(n, i + band) + 1):
            d, steps = min(row[j - 1], row[j], new[j - 1], key=lambda c: c[0])
            new[j] = (d + abs(p[i - 1] - q[j - 1]), steps + 1)
        row = new
    assert shape.warping(a, b)["dtw_distance"] == pytest.approx(row[n][0] / row[n][1])


def test_change_points_against_all_segmentations():
    rng = np.random.default_rng(8)
    for n in (23, 60, 101):
        x = np.round(rng.normal(size=n) + 3 * (np.arange(n) > n // 2), 1)
        gap = (x[:, None] - x[None]) ** 2
        gram = np.exp(-np.clip(gap / np.median(gap[np.triu_indices(n, 1)]), 1e-2, 1e2))
        best = {0: (0.0, [])}
        for e in [*range(5, n, 5), n]:
            cost = lambda s: np.trace(gram[s:e, s:e]) - gram[s:e, s:e].sum() / (e - s)  # noqa: B023, E731
            ways = [(best[s][0] + cost(s) + 3 * math.log(n) * (s > 0), [*best[s][1], e]) for s in best if e - s >= max(2, n // 20)]
            if ways:
                best[e] = min(ways)
        assert shape.change_points(x)["breakpoint_positions"] == [e / n for e in best[n][1][:-1]]


def test_peaks_and_jigsaw():
    x = np.array([0, 1, 0, 3, 3, 0, 2, 0.0])
    assert shape.peaks(x, 0.5) == [1, 3, 6]
    assert shape.jigsaw([np.array([2.0, 3]), np.array([4.0, 5]), np.array([0.0, 1])]) == [2, 0, 1]
    with pytest.raises(ValueError):
        shape.seasonal(np.ones(3))
