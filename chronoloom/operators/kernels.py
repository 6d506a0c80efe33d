"""Numpy kernels over series in array form: one Arrow pass runs all kernels asked for on each series.

A kernel that fails nulls its own fields and says why in ``status``; a task never fails for a series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoloom.kernels import noise, shape

#: Result fields of each kernel, in order.
FIELDS = {
    "stationarity": "adf_pval double, kpss_pval double, is_stationary boolean",
    "pacf": "acf_at_lag1 double, pacf_at_lag1 double, pacf_at_lag2 double, process_type_hint string",
    "ljung_box": "lb_pval_min double, is_white_noise boolean",
    "arch_lm": "arch_lm_stat double, arch_pvalue double, arch_effect_detected boolean",
    "change_points": "n_breakpoints long, breakpoint_positions array<double>, segment_means array<double>, segment_stds array<double>, largest_mean_shift double, largest_std_shift double",
    "trend_segments": "n_breakpoints long, breakpoint_positions array<double>, segment_means array<double>, segment_stds array<double>, largest_mean_shift double, largest_std_shift double, "
    "n_segments long, segment_slopes array<double>, segment_r2s array<double>, segment_directions array<string>, segment_best_fits array<string>",
    "seasonal": "stl_period_used long, seasonal_strength double, trend_strength double, residual_std double",
    "decomposition_type": "decomp_type string, decomp_confidence double, amplitude_trend_corr double",
    "hilbert_envelope": "amplitude_ratio double, amplitude_change string, amplitude_trend string",
    "shape_features": "peak_count long, trough_count long, peak_regularity double, rise_fall_ratio double, waveform_hint string",
}
PAIR_FIELDS = {
    "warping": "dtw_distance double, dtw_similarity double",
    "causality": "granger_best_lag long, pval_12 double, pval_21 double, direction string",
}
#: Kernels that use a decomposition, which is found once and for many series together, and values that a task holds for that.
DECOMPOSED, HELD = {"seasonal", "decomposition_type"}, 1 << 20
_KINDS = {"double": pa.float64(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


def _kernel(name: str):
    return getattr(noise, name, None) or getattr(shape, name)


def _finite(values: list | None) -> np.ndarray:
    x = np.array([np.nan if v is None else v for v in values or []], float)
    return x[np.isfinite(x)]


def _finite_together(cells: tuple) -> list[np.ndarray]:
    """The finite values of the inputs; two of the same length lose both ends of a point, so that they stay aligned."""
    if len(cells) == 2 and None not in cells and len(cells[0]) == len(cells[1]):
        a, b = (np.array([np.nan if v is None else v for v in c], float) for c in cells)
        good = np.isfinite(a) & np.isfinite(b)
        return [a[good], b[good]]
    return [_finite(c) for c in cells]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[list[np.ndarray]]]]:
    """Keys and finite inputs of rows with about ``HELD`` values together."""
    keys, rows, size = [], [], 0
    for batch in batches:
        first = 0
        for i, cells in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)):
            rows.append(_finite_together(cells))
            size += sum(map(len, rows[-1]))
            if size >= HELD:
                yield pa.concat_arrays([*keys, batch.column(0)[first : i + 1]]), rows
                keys, rows, size, first = [], [], 0, i + 1
        if first < batch.num_rows:
            keys.append(batch.column(0)[first:])
    if rows:
        yield pa.concat_arrays(keys), rows


def _run(df: DataFrame, key: str, inputs: list[str], names: list[str], fields: dict[str, str]) -> DataFrame:
    columns = [tuple(f.split()) for name in names for f in fields[name].split(", ")]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, cells in _gathered(batches):
            decomposed = shape.decompositions([s[0] for s in cells], names) if DECOMPOSED & set(names) else [None] * len(cells)
            rows = []
            for series, known in zip(cells, decomposed, strict=True):
                found, notes = {}, []
                for name in names:
                    try:
                        found |= _kernel(name)(*series, **{"known": known} if name in DECOMPOSED else {})
                    except (ValueError, IndexError, ZeroDivisionError, TypeError, np.linalg.LinAlgError) as e:
                        notes.append(f"{name}: {e}")
                rows.append([*[found.get(c) for c, _ in columns], "; ".join(notes) or "ok"])
            made = [pa.array([r[i] for r in rows], _KINDS[t]) for i, (_, t) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([keys, *made, pa.array([r[-1] for r in rows], pa.string())], names=[key, *[c for c, _ in columns], "status"])

    schema = ", ".join([f"{key} {kind}", *[f"{c} {t}" for c, t in columns], "status string"])
    return df.select(key, *inputs).mapInArrow(run, schema)


def series_kernels(arrays: DataFrame, names: list[str]) -> DataFrame:
    """``series_id``, the fields of the kernels named, and ``status``, from ``series_id, values``."""
    return _run(arrays, "series_id", ["values"], names, FIELDS)


def pair_kernels(pairs: DataFrame, names: list[str]) -> DataFrame:
    """The same for pairs ``pair_id, a, b`` of arrays."""
    return _run(pairs, "pair_id", ["a", "b"], names, PAIR_FIELDS)


def scalograms(arrays: DataFrame) -> DataFrame:
    """Matrix rows ``series_id, width, magnitudes``."""
    kind = arrays.schema["series_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = _finite(values)
                if len(x) >= 4:
                    m = shape.scalogram(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(m), batch.schema.types[0]), pa.array(range(1, len(m) + 1), pa.int64()), pa.array(list(m), pa.list_(pa.float64()))],
                        names=["series_id", "width", "magnitudes"],
                    )

    return arrays.select("series_id", "values").mapInArrow(run, f"series_id {kind}, width long, magnitudes array<double>")


def jigsaw_orders(arrays: DataFrame, parts: int = 5) -> DataFrame:
    """The best order of each series' reversed equal parts: ``series_id, order``."""
    kind = arrays.schema["series_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders = []
            for values in batch.column(1).to_pylist():
                x = _finite(values)
                orders.append(shape.jigsaw(np.array_split(x, parts)[::-1]) if len(x) >= parts else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(orders, pa.list_(pa.int64()))], names=["series_id", "order"])

    return arrays.select("series_id", "values").mapInArrow(run, f"series_id {kind}, order array<long>")
