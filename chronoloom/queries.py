"""The registered queries over the given tables and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import guards
from chronoloom.operators import anomaly, answers, branches, channels, evidence, experiment, heads, kernels, local, loops, pairwise, replies, reports, resampling, shape, spectral, stats, trend, verify
from chronoloom.plans import numeric, stress
from chronoloom.sources import ingest, series

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

_PTS = """pts AS (
  SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value FROM events
)"""
_PAIR = """spread AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS hour, sum(value) AS value FROM events GROUP BY 1, 2),
span AS (SELECT series_id, min(hour) AS a, max(hour) AS b FROM spread GROUP BY 1),
grid AS (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM span),
hourly AS (
  SELECT g.series_id, row_number() OVER (PARTITION BY g.series_id ORDER BY g.hour) - 1 AS pos, s.value
  FROM grid g LEFT JOIN spread s ON s.series_id = g.series_id AND s.hour = g.hour
), pair AS (
  SELECT a.series_id || '~' || b.series_id AS pair_id, a.pos, coalesce(a.value, 0) AS a, coalesce(b.value, 0) AS b
  FROM hourly a JOIN hourly b ON a.pos = b.pos AND a.series_id < b.series_id
)"""
_ARMS = """arms AS (
  SELECT d.doc_id, d.lang, d.source, l.quality AS correct, 1 - l.toxic AS correct_t FROM documents d JOIN labels l USING (doc_id)
)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


def query(sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Registers a query under its function's name; doubles are rounded, as in its SQL."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the hourly series of event types, gaps as 0; there are as many as pairs of types."""
    hourly = series.hourly_type(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit(0.0)))
    names = series.table(spark, sf_dir, "events").select(F.col("event_type").alias("a_id")).distinct()
    pairs = names.join(names.select(F.col("a_id").alias("b_id")), F.col("a_id") < F.col("b_id"))
    return pairwise.aligned(hourly, hourly, pairs.withColumn("pair_id", F.concat_ws("~", "a_id", "b_id")))


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = series.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("correct"), (1 - F.col("toxic")).alias("correct_t"))
    return series.table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(labels, "doc_id")


@query(f"""WITH {_PTS}
SELECT series_id, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std,
  round(var_pop(value), 6) AS var, round(min(value), 6) AS min, round(max(value), 6) AS max, round(max(value) - min(value), 6) AS range,
  round(sum(value), 6) AS sum, round(max(abs(value)), 6) AS abs_max, round(quantile_cont(value, 0.25), 6) AS q1,
  round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr,
  round(arg_min(value, pos), 6) AS first, round(arg_max(value, pos), 6) AS last,
  round((sum(value*value*value)/count(*) - 3*avg(value)*sum(value*value)/count(*) + 2*avg(value)*avg(value)*avg(value)) / (var_pop(value)*stddev_pop(value)), 6) AS skewness,
  round(kurtosis_pop(value), 6) AS kurtosis
FROM pts GROUP BY series_id""")
def basic_stats(spark, sf_dir):
    return stats.basic_stats(series.user_values(spark, sf_dir))


@query(f"WITH {_PTS} SELECT series_id, round(quantile_cont(value, 0.9), 6) AS value FROM pts GROUP BY series_id")
def percentile_q(spark, sf_dir):
    return stats.percentile(series.user_values(spark, sf_dir), 90)


@query(f"""WITH {_PTS}, m AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM pts)
SELECT series_id, round(max(CASE WHEN pos = n - 3 THEN value END), 6) AS value,
  CASE WHEN max(CASE WHEN pos = n - 3 THEN value END) IS NULL THEN 'index out of range' ELSE 'ok' END AS note FROM m GROUP BY series_id""")
def value_at_index(spark, sf_dir):
    return stats.value_at(series.user_values(spark, sf_dir), -3)


@query(f"WITH {_PTS} SELECT series_id, count(*) FILTER (value >= 20) AS n FROM pts GROUP BY series_id")
def count_threshold(spark, sf_dir):
    return stats.count_threshold(series.user_values(spark, sf_dir), ">=", 20)


@query(f"""WITH {_PTS}, m AS (SELECT *, max(value) OVER s AS hi, min(value) OVER s AS lo FROM pts WINDOW s AS (PARTITION BY series_id))
SELECT series_id, min(pos) FILTER (value = hi) AS argmax, min(pos) FILTER (value = lo) AS argmin FROM m GROUP BY series_id""")
def argmax_argmin(spark, sf_dir):
    return stats.argmax_argmin(series.user_values(spark, sf_dir))


@query(f"""WITH {_PTS}, m AS (SELECT *, lag(value) OVER s AS a, lead(value) OVER s AS b FROM pts WINDOW s AS (PARTITION BY series_id ORDER BY pos))
SELECT series_id, count(*) FILTER (value > a AND value > b) AS n_max, count(*) FILTER (value < a AND value < b) AS n_min FROM m GROUP BY series_id""")
def local_extrema(spark, sf_dir):
    return stats.local_extrema(series.user_values(spark, sf_dir))


@query(f"WITH {_PTS} SELECT series_id, pos, round(value + 1.5, 6) AS shifted, round(value * 2, 6) AS scaled FROM pts")
def shift_scale(spark, sf_dir):
    return stats.shift_scale(series.user_values(spark, sf_dir), 1.5, 2)


@query(f"WITH {_PTS} SELECT series_id, pos, round(lag(value, 3, 0) OVER (PARTITION BY series_id ORDER BY pos), 6) AS value FROM pts")
def lag_series(spark, sf_dir):
    return stats.lagged(series.user_values(spark, sf_dir), 3, 0.0)


@query(f"""WITH {_PTS} SELECT series_id, pos - 4 AS pos, round(v, 6) AS value FROM (
  SELECT series_id, pos, avg(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v FROM pts) WHERE pos >= 4""")
def moving_average(spark, sf_dir):
    return stats.moving_average(series.user_values(spark, sf_dir), 5)


@query(f"""WITH {_PTS} SELECT series_id, pos - 2 AS pos, round(v, 6) AS value FROM (
  SELECT series_id, pos, value - 2 * lag(value) OVER s + lag(value, 2) OVER s AS v FROM pts WINDOW s AS (PARTITION BY series_id ORDER BY pos)) WHERE v IS NOT NULL""")
def difference(spark, sf_dir):
    return stats.difference(series.user_values(spark, sf_dir), 2)


@query(f"""WITH {_PTS}, f AS (SELECT series_id, regr_slope(value, pos) AS b, regr_intercept(value, pos) AS a FROM pts GROUP BY 1)
SELECT series_id, pos, round(value - a - b * pos, 5) AS value FROM pts JOIN f USING (series_id)""", digits=5)
def detrend(spark, sf_dir):
    return stats.detrended(series.user_values(spark, sf_dir))


_CHUNKED = "chunked AS (SELECT *, CAST(least(pos // (count(*) OVER (PARTITION BY series_id) // 4), 3) AS INTEGER) AS chunk FROM pts)"


@query(f"""WITH {_PTS}, {_CHUNKED}
SELECT series_id, chunk, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM chunked GROUP BY 1, 2""")
def chunk_stats(spark, sf_dir):
    return stats.chunk_stats(series.user_values(spark, sf_dir), 4)


@query(f"WITH {_PTS} SELECT series_id, pos, round((value - avg(value) OVER s) / stddev_pop(value) OVER s, 6) AS value FROM pts WINDOW s AS (PARTITION BY series_id)")
def zscore(spark, sf_dir):
    return stats.zscores(series.user_values(spark, sf_dir))


@query(f"""WITH {_PAIR}, k AS (
  SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS ap, last_value(value IGNORE NULLS) OVER b AS av,
    first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS bp, first_value(value IGNORE NULLS) OVER f AS bv FROM hourly
  WINDOW b AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_id, pos, round(CASE WHEN ap IS NULL THEN bv WHEN bp IS NULL OR bp = ap THEN av ELSE av + (bv - av) * (pos - ap) / (bp - ap) END, 6) AS value FROM k""")
def interpolate_gaps(spark, sf_dir):
    return stats.interpolated(series.hourly_type(spark, sf_dir))


@query(f"""WITH {_PTS}, n AS (SELECT series_id, count(*) AS n FROM pts GROUP BY 1),
w AS (SELECT series_id, n, unnest(range(least(n, 16))) AS i FROM n),
p AS (SELECT series_id, i, CAST(CASE WHEN n <= 16 THEN i ELSE round_even(CAST(i * (n - 1) AS DOUBLE) / 15, 0) END AS BIGINT) AS pos FROM w)
SELECT series_id, i, pos, round(value, 6) AS value FROM p JOIN pts USING (series_id, pos)""")
def subsample(spark, sf_dir):
    return stats.subsampled(series.user_values(spark, sf_dir), 16)


_FIT = """f AS (
  SELECT series_id, regr_slope(value, pos) AS slope, regr_intercept(value, pos) AS intercept, regr_r2(value, pos) AS r2, stddev_pop(value) AS std,
    CASE WHEN min(value) > 0 THEN regr_r2(ln(greatest(value, 1e-300)), pos) END AS exp_r2, regr_r2(value, ln(pos + 1)) AS log_r2,
    avg(value) AS mean, max(abs(value)) AS top, corr(value, pos) AS best_corr FROM pts GROUP BY 1),
fit AS (SELECT *, CASE WHEN abs(slope) < CASE WHEN std > 0 THEN 1e-4 * std ELSE 1e-10 END THEN 'flat' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
  CASE WHEN r2 >= coalesce(exp_r2, -1) AND r2 >= log_r2 THEN 'linear' WHEN coalesce(exp_r2, -1) >= log_r2 THEN 'exponential' ELSE 'log' END AS best_fit FROM f)"""


@query(f"""WITH {_PTS}, {_FIT} SELECT series_id, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(exp_r2, 6) AS exp_r2,
  round(log_r2, 6) AS log_r2, direction, best_fit FROM fit""")
def trend_fit(spark, sf_dir):
    return trend.trend_fit(series.user_values(spark, sf_dir))


@query(f"""WITH {_PTS}, f AS (SELECT series_id, regr_slope(value, pos) AS s, count(*) AS n, stddev_pop(value) AS sd FROM pts GROUP BY 1)
SELECT series_id, CASE WHEN n < 2 THEN 'Global OLS Slope = 0.00, indicating an undefined/flat trend (insufficient data).'
  WHEN sd = 0 THEN 'Global OLS Slope = 0.00, indicating a flat trend (zero variance).'
  ELSE printf('Global OLS Slope = %.2f, indicating a %s trend.', s, CASE WHEN s > 0 THEN 'upward' WHEN s < 0 THEN 'downward' ELSE 'flat' END) END AS summary FROM f""")
def ols_summary(spark, sf_dir):
    return trend.ols_summary(series.user_values(spark, sf_dir))


@query(f"""WITH {_PTS}, {_CHUNKED} SELECT series_id, chunk, round(regr_slope(value, pos), 6) AS slope, round(regr_r2(value, pos), 6) AS r2 FROM chunked GROUP BY 1, 2""")
def chunk_trend(spark, sf_dir):
    return trend.chunk_trend(series.user_values(spark, sf_dir))


@query(f"""WITH {_PTS}, {_CHUNKED}, s AS (SELECT series_id, chunk, regr_slope(value, pos) AS slope FROM chunked GROUP BY 1, 2)
SELECT series_id, round(max(slope) FILTER (chunk = 3) - max(slope) FILTER (chunk = 0), 6) AS acceleration FROM s GROUP BY 1""")
def slope_acceleration(spark, sf_dir):
    return trend.slope_acceleration(series.user_values(spark, sf_dir))


@query(f"""WITH {_PTS}, c AS (SELECT series_id, pos, value - avg(value) OVER (PARTITION BY series_id) AS v FROM pts),
s AS (SELECT series_id, pos + 1 AS split, sum(v) OVER (PARTITION BY series_id ORDER BY pos) AS s, sum(v) OVER (PARTITION BY series_id) AS t,
  count(*) OVER (PARTITION BY series_id) AS n FROM c),
g AS (SELECT series_id, split, round(s * s / split + (t - s) * (t - s) / (n - split) - t * t / n, 9) AS gain FROM s WHERE split < n),
b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY gain DESC, split) AS rn FROM g)
SELECT series_id, split, round(gain, 6) AS gain FROM b WHERE rn = 1""")
def best_split(spark, sf_dir):
    return trend.best_split(series.user_values(spark, sf_dir))


_ACF = """c AS (SELECT series_id, pos, value - avg(value) OVER (PARTITION BY series_id) AS v, count(*) OVER (PARTITION BY series_id) AS n FROM pts),
tot AS (SELECT series_id, sum(v * v) AS total FROM c GROUP BY 1),
acf AS (SELECT a.series_id, CAST(b.pos - a.pos AS BIGINT) AS lag, max(a.n) AS n, sum(a.v * b.v) / max(total) AS acf
  FROM c a JOIN c b ON a.series_id = b.series_id AND b.pos - a.pos BETWEEN 1 AND {lag} AND b.pos - a.pos <= a.n // 2 - 1 JOIN tot ON tot.series_id = a.series_id GROUP BY 1, 2)"""


@query(f"WITH {_PTS}, {_ACF.format(lag=50)} SELECT series_id, lag, round(acf, 6) AS acf, n FROM acf")
def autocorr(spark, sf_dir):
    return spectral.autocorrelation(series.user_values(spark, sf_dir))


@query(f"""WITH {_PTS}, {_ACF.format(lag=50)}, m AS (SELECT *, lag(acf) OVER w AS a, lead(acf) OVER w AS b FROM acf WINDOW w AS (PARTITION BY series_id ORDER BY lag)),
p AS (SELECT series_id, CASE WHEN acf > a AND acf > b AND acf > 2 / sqrt(n) THEN lag END AS l, acf FROM m)
SELECT series_id, coalesce(min(l), 0) AS lag, round(arg_min(acf, l), 6) AS strength FROM p GROUP BY 1""")
def acf_first_peak(spark, sf_dir):
    peaks = spectral.first_peak(spectral.autocorrelation(series.user_values(spark, sf_dir)))
    return peaks.withColumn("lag", F.coalesce("lag", F.lit(0).cast("long")))  # 0: none


@query(f"""WITH {_PTS}, {_ACF.format(lag=20)}
SELECT series_id, lag, round(n * (n + 2) * sum(acf * acf / (n - lag)) OVER (PARTITION BY series_id ORDER BY lag), 6) AS q FROM acf""")
def ljung_box_q(spark, sf_dir):
    return spectral.ljung_box(series.user_values(spark, sf_dir))


@query(f"""WITH {_PTS}, f AS (SELECT series_id, count(*) AS n, regr_slope(value, pos) AS b, regr_intercept(value, pos) AS a FROM pts GROUP BY 1),
r AS (SELECT series_id, pos, n, value - a - b * pos AS v FROM pts JOIN f USING (series_id)),
x AS (SELECT series_id, pos, n, v, unnest(range(1, n // 2 + 1)) AS bin FROM r),
s AS (SELECT series_id, bin, max(n) AS n, sqrt(power(sum(v * cos(2 * pi() * ((bin * pos) % n) / n)), 2) + power(sum(v * sin(2 * pi() * ((bin * pos) % n) / n)), 2)) AS m FROM x GROUP BY 1, 2),
t AS (SELECT series_id, max(n) AS n, arg_max(bin, m) AS k, sum(m) AS total, count(*) AS bins, sum(m * ln(m)) AS mlnm FROM s GROUP BY 1)
SELECT series_id, round(n / k, 6) AS period, round((ln(total) - mlnm / total) / ln(bins + 1), 6) AS entropy FROM t""")
def dft_period(spark, sf_dir):
    return spectral.dominant_period(series.user_values(spark, sf_dir))


@query(f"""WITH {_PTS}, z AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM pts), w AS (SELECT *, greatest(4, least(200, n // 10)) AS w FROM z),
f AS (SELECT a.series_id, a.pos - a.w + 1 AS place, a.n - a.w + 1 AS m, stddev_pop(b.value) AS std FROM w a JOIN w b ON a.series_id = b.series_id AND b.pos BETWEEN a.pos - a.w + 1 AND a.pos
  WHERE a.pos >= a.w - 1 GROUP BY a.series_id, a.pos, a.w, a.n),
h AS (SELECT series_id, avg(std) FILTER (place < m // 2) AS f, avg(std) FILTER (place >= m // 2) AS s FROM f GROUP BY 1)
SELECT series_id, round(s / f, 6) AS ratio, CASE WHEN s / f > 1.2 THEN 'increasing' WHEN s / f < 0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM h""")
def rolling_std(spark, sf_dir):
    return spectral.rolling_std(series.user_values(spark, sf_dir))


@query(f"""WITH {_PTS}, n AS (SELECT series_id, count(*) AS n FROM pts GROUP BY 1 HAVING count(*) >= 20),
l AS (SELECT series_id, n, unnest(range(2, least(n // 2, 100))) AS lag FROM n),
c AS (SELECT p.series_id, lag, pos, pos // lag AS part, value FROM pts p JOIN l USING (series_id) WHERE (pos // lag + 1) * lag <= n),
d AS (SELECT *, value - avg(value) OVER (PARTITION BY series_id, lag, part) AS d FROM c),
w AS (SELECT *, sum(d) OVER (PARTITION BY series_id, lag, part ORDER BY pos) AS c FROM d),
p AS (SELECT series_id, lag, part, max(c) - min(c) AS r, stddev_samp(d) AS s FROM w GROUP BY 1, 2, 3),
m AS (SELECT series_id, lag, avg(r / s) AS rs FROM p WHERE s > 0 GROUP BY 1, 2),
h AS (SELECT series_id, regr_slope(ln(rs), ln(lag)) AS h FROM m WHERE rs > 0 GROUP BY 1)
SELECT series_id, round(h, 6) AS hurst, CASE WHEN h > 0.55 THEN 'persistent' WHEN h < 0.45 THEN 'anti-persistent' ELSE 'random walk' END AS label FROM h""")
def hurst(spark, sf_dir):
    return trend.hurst(series.user_values(spark, sf_dir))


@query(f"""WITH {_PTS}, z AS (SELECT series_id, pos, (value - avg(value) OVER s) / stddev_samp(value) OVER s AS z FROM pts WINDOW s AS (PARTITION BY series_id))
SELECT series_id, pos, round(z, 6) AS z FROM z WHERE abs(z) > 3""")
def zscore_outliers(spark, sf_dir):
    return anomaly.zscore_outliers(series.user_values(spark, sf_dir))


_FENCES = """q AS (SELECT series_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, count(*) AS n FROM pts GROUP BY 1),
f AS (SELECT series_id, a - 1.5 * (b - a) AS low, b + 1.5 * (b - a) AS high, CASE WHEN n < 4 THEN 'too short' WHEN b = a THEN 'no spread' ELSE 'ok' END AS status FROM q)"""


@query(f"""WITH {_PTS}, {_FENCES}
SELECT series_id, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN status = 'ok' THEN count(*) FILTER (value < low OR value > high) END AS outliers, status,
  CASE WHEN status = 'ok' THEN coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (value < low OR value > high), '') END AS positions
FROM pts JOIN f USING (series_id) GROUP BY series_id, low, high, status""")
def iqr_outliers(spark, sf_dir):
    return anomaly.iqr_outliers(series.user_values(spark, sf_dir)).withColumn("positions", F.array_join("positions", ","))


@query(f"""WITH {_PTS}, {_FENCES}, z AS (SELECT series_id, greatest(max(value) - avg(value), avg(value) - min(value)) / stddev_pop(value) AS z FROM pts GROUP BY 1),
o AS (SELECT series_id, count(*) FILTER (status = 'ok' AND (value < low OR value > high)) AS o FROM pts JOIN f USING (series_id) GROUP BY 1)
SELECT series_id, round(z, 6) AS max_deviation, o AS outlier_count FROM z JOIN o USING (series_id)""")
def anomaly_score(spark, sf_dir):
    return anomaly.anomaly_score(series.user_values(spark, sf_dir))


@query(f"""WITH {_PAIR}, x AS (SELECT p.pair_id, b.pos - p.pos AS lag, p.a, b.b FROM pair p JOIN pair b ON p.pair_id = b.pair_id AND b.pos - p.pos BETWEEN -12 AND 12),
r AS (SELECT pair_id, lag, corr(a, b) AS r, count(*) AS n FROM x GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY round(abs(r), 9) DESC, lag = 0 DESC, lag) AS rn FROM r WHERE n >= 3 AND NOT isnan(r))
SELECT pair_id, max(lag) FILTER (rn = 1) AS best_lag, round(max(r) FILTER (rn = 1), 6) AS best_corr, round(max(r) FILTER (lag = 0), 6) AS corr_at_zero FROM o GROUP BY 1""")
def lag_corr(spark, sf_dir):
    return pairwise.lag_correlation(_pairs(spark, sf_dir), 12)


@query(f"""WITH {_PAIR}, s AS (SELECT pair_id, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, max(a) - min(a) AS ra, max(b) - min(b) AS rb,
  regr_slope(a, pos) AS ta, regr_slope(b, pos) AS tb FROM pair GROUP BY 1),
d AS (SELECT *, CASE WHEN abs(ta) < 1e-4 * sa THEN 0 ELSE sign(ta) END = CASE WHEN abs(tb) < 1e-4 * sb THEN 0 ELSE sign(tb) END AS alike, least(ra, rb) / greatest(ra, rb) AS r,
  least(sa, sb) / greatest(sa, sb) AS v FROM s)
SELECT pair_id, CASE WHEN alike AND abs(ta - tb) < 0.1 THEN 'high' WHEN alike OR abs(ta - tb) < 0.5 THEN 'medium' ELSE 'low' END AS trend,
  CASE WHEN abs(ma - mb) < 0.1 THEN 'high' WHEN abs(ma - mb) < 1 THEN 'medium' ELSE 'low' END AS level, CASE WHEN r > 0.8 THEN 'high' WHEN r > 0.5 THEN 'medium' ELSE 'low' END AS range,
  CASE WHEN v > 0.85 THEN 'high' ELSE 'low' END AS variance, CASE WHEN v > 0.85 THEN 'same' WHEN sa > sb THEN 'series_1' ELSE 'series_2' END AS higher_variance, round(v, 6) AS std_ratio FROM d""")
def similarity_labels(spark, sf_dir):
    return pairwise.similarity_labels(_pairs(spark, sf_dir))


@query(f"""WITH {_PAIR}, sides AS (SELECT pair_id, 1 AS side, pos, a - avg(a) OVER (PARTITION BY pair_id) AS v FROM pair UNION ALL SELECT pair_id, 2, pos, b - avg(b) OVER (PARTITION BY pair_id) FROM pair),
lags AS (SELECT unnest(range(1, 21)) AS lag), total AS (SELECT pair_id, side, sum(v * v) AS t FROM sides GROUP BY ALL),
acf AS (SELECT x.pair_id, x.side, lag, sum(x.v * y.v) / any_value(t) AS r FROM sides x CROSS JOIN lags JOIN sides y ON y.pair_id = x.pair_id AND y.side = x.side AND y.pos = x.pos + lag
  JOIN total t ON t.pair_id = x.pair_id AND t.side = x.side GROUP BY x.pair_id, x.side, lag),
sided AS (SELECT a.pair_id, a.lag, a.r AS ra, b.r AS rb FROM acf a JOIN acf b ON a.pair_id = b.pair_id AND a.lag = b.lag AND a.side = 1 AND b.side = 2)
SELECT pair_id, round(corr(ra, rb), 6) AS acf_corr, arg_max(lag, round(abs(ra), 9) * 1000 - lag / 1e9) AS peak_lag_1, arg_max(lag, round(abs(rb), 9) * 1000 - lag / 1e9) AS peak_lag_2,
  CASE WHEN corr(ra, rb) > 0.8 THEN 'high' WHEN corr(ra, rb) > 0.5 THEN 'medium' ELSE 'low' END AS autocorr_similarity FROM sided GROUP BY 1""")
def acf_similarity(spark, sf_dir):
    return pairwise.acf_similarity(_pairs(spark, sf_dir))


@query(f"""WITH {_PAIR}, m AS (SELECT pair_id, sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb FROM pair GROUP BY 1),
s AS (SELECT pair_id, ab / (bb + 1e-12) AS s12, ab / (aa + 1e-12) AS s21, round(sqrt(greatest(0, 1 - ab * ab / (aa * bb))), 9) AS error FROM m)
SELECT pair_id, round(error, 6) AS error, error < 0.15 AND abs(s12 - 1) > 0.15 AS scaled,
  CASE WHEN error < 0.15 AND abs(s12 - 1) > 0.15 THEN 'series_1_scaled_from_series_2' ELSE 'none' END AS direction, CASE WHEN error < 0.15 AND abs(s12 - 1) > 0.15 THEN round(s12, 6) END AS factor FROM s""")
def scaled_version(spark, sf_dir):
    return pairwise.scaled_version(_pairs(spark, sf_dir))


@query(f"WITH {_PAIR} SELECT pair_id, round(corr(a, b), 6) AS direct, -corr(a, b) > 0.85 AS flipped FROM pair GROUP BY 1")
def flipped_version(spark, sf_dir):
    return pairwise.flipped_version(_pairs(spark, sf_dir))


@query(f"""WITH {_PAIR}, d AS (SELECT pair_id, (a - avg(a) OVER s) / stddev_pop(a) OVER s - (b - avg(b) OVER s) / stddev_pop(b) OVER s AS d FROM pair WINDOW s AS (PARTITION BY pair_id))
SELECT pair_id, round(sqrt(sum(d * d)) / count(*), 6) AS distance FROM d GROUP BY 1""")
def euclidean(spark, sf_dir):
    return pairwise.euclidean(_pairs(spark, sf_dir))


@query(f"""WITH {_PTS}, {_CHUNKED}, s AS (
  SELECT series_id, chunk, count(*) AS n, arg_min(value, pos) AS head, arg_max(value, pos) AS tail, arg_min(nxt - value, pos) AS hs, arg_max(value - prv, pos) AS ts
  FROM (SELECT *, lead(value) OVER w AS nxt, lag(value) OVER w AS prv FROM chunked WINDOW w AS (PARTITION BY series_id, chunk ORDER BY pos)) GROUP BY 1, 2)
SELECT a.series_id AS "group", a.chunk AS left, b.chunk AS right, round((b.head - a.tail) * (b.head - a.tail) + 0.5 * (b.hs - a.ts) * (b.hs - a.ts), 6) AS cost
FROM s a JOIN s b ON a.series_id = b.series_id AND a.chunk <> b.chunk""")
def junction_cost(spark, sf_dir):
    pts = series.user_values(spark, sf_dir)
    placed = pts.withColumn("n", F.count("*").over(stats.whole())).withColumn("chunk", stats.chunk_of(F.col("n"), 4))
    w = stats.W.partitionBy("series_id", "chunk").orderBy("pos")
    near = placed.withColumns({"nxt": F.lead("value").over(w), "prv": F.lag("value").over(w)})
    first, last = (lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("pos")))), (lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("pos"))))
    v = F.col("value")
    edges = near.groupBy(F.col("series_id").alias("group"), F.col("chunk").alias("seg")).agg(
        F.count("*").alias("n"), first(v).alias("head"), last(v).alias("tail"), first(F.col("nxt") - v).alias("head_slope"), last(v - F.col("prv")).alias("tail_slope")
    )
    return pairwise.junction_costs(edges)


@query(f"""WITH {_PTS}, {_CHUNKED}, seg AS (SELECT series_id AS g, chunk AS seg, pos - min(pos) OVER (PARTITION BY series_id, chunk) AS pos, value, count(*) OVER (PARTITION BY series_id, chunk) AS size FROM chunked),
m AS (SELECT g, seg, r.pos - s.pos AS start, size, avg((s.value - r.value) * (s.value - r.value)) AS mse, count(*) AS n FROM seg s JOIN pts r ON r.series_id = g AND r.pos >= s.pos GROUP BY 1, 2, 3, 4),
b AS (SELECT g, seg, start, row_number() OVER (PARTITION BY g, seg ORDER BY round(mse, 9), start) AS rn FROM m WHERE n = size)
SELECT g AS "group", seg, start, row_number() OVER (PARTITION BY g ORDER BY start, seg) - 1 AS place FROM b WHERE rn = 1""")
def jigsaw_ref(spark, sf_dir):
    pts = series.user_values(spark, sf_dir)
    placed = pts.withColumn("n", F.count("*").over(stats.whole())).withColumn("seg", stats.chunk_of(F.col("n"), 4))
    own = F.col("pos") - F.min("pos").over(stats.W.partitionBy("series_id", "seg"))
    segments = placed.select(F.col("series_id").alias("group"), "seg", own.alias("pos"), "value")
    return pairwise.jigsaw_by_reference(segments, pts.select(F.col("series_id").alias("group"), "pos", "value"))


@query(f"""WITH {_PTS}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM pts),
k AS (SELECT series_id, n, arg_min(value, pos) AS f, arg_max(value, pos) AS l FROM n WHERE pos < n - 8 AND n > 9 GROUP BY 1, 2),
e AS (SELECT k.series_id, avg((k.l - p.value) * (k.l - p.value)) AS persistence, avg(power(k.l + (k.l - k.f) / (k.n - 9) * (p.pos - k.n + 9) - p.value, 2)) AS drift
  FROM k JOIN n p ON p.series_id = k.series_id AND p.pos >= p.n - 8 GROUP BY 1)
SELECT series_id, CASE WHEN round(drift, 8) <= round(persistence, 8) THEN 'drift' ELSE 'persistence' END AS method, round(least(drift, persistence), 8) AS mse FROM e""", digits=8)
def forecast_rank(spark, sf_dir):
    return verify.forecast_rank(series.to_arrays(series.user_values(spark, sf_dir)))


# Options of event questions, and how these ask; picked by a row's number.
_EVENT_OPTIONS = ("Yes|No", "No|Yes", "It does not occur|It occurs", "True|False", "maybe|perhaps", "only one")
_EVENT_ASKS = ("Does it go above 60?", "Is any value less than 1.5", "Does the series exceed 55.5 at least once?", "Is it <= -3?", "Is it rising?", "Are there values at least 2e1?")


def _pick_sql(values: tuple[str, ...], at: str) -> str:
    return f"CASE {at} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _any_sql(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_EVENT_ROWS = f"""SELECT question_id, question_id AS series_id, {_pick_sql(_EVENT_ASKS, "question_id % 6")} AS question,
  {_pick_sql(_EVENT_OPTIONS, "CAST(floor(question_id / 6) AS BIGINT) % 6")} AS texts FROM {{users}}"""


@query(f"""WITH {_PTS}, users AS (SELECT DISTINCT user_id AS question_id FROM events), rows AS ({_EVENT_ROWS.format(users="users")}),
ends AS (SELECT series_id, max(value) AS hi, min(value) AS lo FROM pts GROUP BY 1),
t AS (SELECT r.*, hi, lo, string_split(texts, '|') AS o, CASE WHEN contains(texts, '|') THEN CAST(nullif(regexp_extract(question,
  '(?i)(?:greater than|more than|above|exceeds?|>=|at least|less than|below|under|<=|at most)\\s*([-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?)', 1), '') AS DOUBLE) END AS threshold FROM rows r LEFT JOIN ends USING (series_id)),
e AS (SELECT *, CASE WHEN {_any_sql("lower(question)", verify.LOW)} THEN lo <= threshold ELSE hi >= threshold END AS event FROM t),
f AS (SELECT *, list_position(list_transform(o, lambda x: CASE WHEN event THEN {_any_sql("lower(x)", verify.POSITIVE)} ELSE {_any_sql("lower(x)", verify.NEGATIVE)} END), true) AS spot FROM e)
SELECT question_id, CASE WHEN event IS NOT NULL AND spot > 0 THEN chr(CAST(64 + spot AS INTEGER)) END AS letter, CASE WHEN event THEN 'yes' WHEN NOT event THEN 'no' END AS event, threshold FROM f""")
def event_threshold(spark, sf_dir):
    users = series.table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id")).distinct()
    rows = users.selectExpr("question_id", "question_id AS series_id", f"{_pick_sql(_EVENT_ASKS, 'question_id % 6')} AS question", f"split({_pick_sql(_EVENT_OPTIONS, 'CAST(floor(question_id / 6) AS BIGINT) % 6')}, '[|]') AS options")
    found = verify.event_head(rows, series.user_values(spark, sf_dir))
    return found.withColumn("event", F.when(F.col("event"), "yes").when(~F.col("event"), "no"))


# Questions are made of operands, forms and preambles, picked by a row's number: every rung, synonym, bare noun and form occurs, and phrases that no parser knows.
_OPERANDS = (
    "the standard deviation", "the variance", "the median", "the mean value", "the average value", "the range", "the minimum value", "the maximum value",
    "the skewness", "the kurtosis", "the slope", "the 90th percentile", "the 12.5 percentile", "how spread out it is", "the dispersion", "the typical value",
    "the central tendency", "the middle value", "the smallest value", "the peak value", "the foo", "the index of the maximum", "the index of the minimum", "the number of local maxima",
    "how many local minima there are", "the skew",
)
_FORMS = (
    "What is {a} of the sequence?", "Tell me {a}", "What is the difference between {a} and {b}?", "the ratio of {a} to {b}", "Ratio between {a} and {b}",
    "What is the sum of {a} and {b} of the sequence?", "the product of {a} and {b}", "{a} divided by {b}", "What is {a} minus {b}?", "{a} plus {b}, please",
    "Where does the global maximum occur?", "Is there a season in it?",
)
_PREAMBLES = ("", "Time series 1 and time series 2 are shown. For Time Series 2: ", "Given time series 2, look at time series 1. ")


def _question_sql(k: str, operands: tuple[str, ...]) -> str:
    """The text of question number ``k``, in SQL that both engines read."""
    pick = lambda values, at: f"CASE {at} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
    n = len(operands)
    a, b = pick(operands, f"(({k}) % {n})"), pick(operands, f"(({k}) * 7 + 3) % {n}")
    form = f"replace(replace({pick(_FORMS, f'(CAST(floor(({k}) / {n}) AS BIGINT) + ({k})) % {len(_FORMS)}')}, '{{a}}', {a}), '{{b}}', {b})"
    return f"concat({pick(_PREAMBLES, f'({k}) % 3')}, {form})"


def _ladder_sql(q: str) -> str:
    has = lambda words: " OR ".join(f"contains({q}, '{w}')" for w in words)
    index = [
        f"WHEN contains({q}, 'where does the global {end}') OR (contains({q}, 'index') AND contains({q}, '{end}') AND NOT contains({q}, 'how many')) THEN '{name}'"
        for end, name in (("maximum", "argmax"), ("minimum", "argmin"))
    ]
    phrase = lambda table: [f"WHEN {has(words)} THEN '{name}'" for name, words in table]
    return f"CASE {' '.join([*index, *phrase(numeric.COUNTS), f"WHEN regexp_matches({q}, '{numeric.PERCENTILE}') THEN 'percentile'", *phrase(numeric.SUMMARIES)])} END"


def _parsed_sql(questions: str) -> str:
    """Plan columns by the rules of the language, but for typing errors (the questions have none)."""
    syn = "{q}"
    for old, new in sorted(numeric.SYNONYMS, key=lambda x: -len(x[0])):
        syn = f"replace({syn}, '{old}', '{new}')"
    bare = "CASE " + " ".join(f"WHEN regexp_matches({{q}}, '\\b{noun}\\b') THEN '{name}'" for noun, name in numeric.BARE) + " END"
    forms = [f"WHEN regexp_matches(q, '{p}') THEN {{}}" for _, p in numeric.PREFIX_FORMS] + [f"WHEN contains(q, '{t}') THEN {{}}" for _, t in numeric.INFIX_FORMS]
    said = lambda results: "CASE " + " ".join(f.format(r) for f, r in zip(forms, results, strict=True)) + " END"
    ops = [f"'{op}'" for op, _ in (*numeric.PREFIX_FORMS, *numeric.INFIX_FORMS)]
    side = lambda i: [f"regexp_extract(q, '{p}', {i})" for _, p in numeric.PREFIX_FORMS]
    left = side(1) + [f"substr(q, 1, strpos(q, '{t}') - 1)" for _, t in numeric.INFIX_FORMS]
    right = side(2) + [f"substr(q, strpos(q, '{t}') + {len(t)})" for _, t in numeric.INFIX_FORMS]
    match = lambda c: f"coalesce({_ladder_sql(c)}, {bare.format(q=c)})"
    param = lambda c, name: f"CASE WHEN {name} = 'percentile' THEN CAST(regexp_extract({c}, '{numeric.PERCENTILE}', 1) AS DOUBLE) END"
    return f"""questions AS ({questions}), lowered AS (SELECT *, lower(question) AS q, regexp_extract_all(lower(question), 'time series\\s*(\\d+)', 1)[-1] AS last FROM questions),
formed AS (SELECT *, {said(ops)} AS form, {said(left)} AS l, {said(right)} AS r FROM lowered),
spans AS (SELECT *, {syn.format(q="coalesce(l, q)")} AS sl, {syn.format(q="r")} AS sr FROM formed),
named AS (SELECT *, {match("sl")} AS lq, CASE WHEN form IS NOT NULL THEN {match("sr")} END AS rq FROM spans),
plans AS (SELECT * EXCLUDE (op, left_q, right_q), op, left_q, right_q, {param("sl", "left_q")} AS left_p, {param("sr", "right_q")} AS right_p,
  CASE WHEN last = '2' THEN 'ts2' ELSE 'primary' END AS series FROM (
    SELECT *, CASE WHEN lq IS NOT NULL AND rq IS NOT NULL THEN form END AS op, CASE WHEN form IS NULL OR (lq IS NOT NULL AND rq IS NOT NULL) THEN lq END AS left_q,
      CASE WHEN lq IS NOT NULL THEN rq END AS right_q FROM named))"""


_ASKED = f"SELECT conv_id, turn, {_question_sql('conv_id * 8 + turn', _OPERANDS)} AS question FROM conversations"


@query(f"WITH {_parsed_sql(_ASKED)} SELECT conv_id, turn, question, op, left_q, left_p, right_q, right_p, series FROM plans")
def plan_parse(spark, sf_dir):
    asked = series.table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_question_sql('conv_id * 8 + turn', _OPERANDS)} AS question")
    return numeric.parse(asked)


@query(f"""WITH q AS ({_ASKED}), l AS (SELECT *, {_ladder_sql("lower(question)")} AS quantity FROM q)
SELECT conv_id, turn, quantity, CASE WHEN quantity = 'percentile' THEN CAST(regexp_extract(lower(question), '{numeric.PERCENTILE}', 1) AS DOUBLE) END AS param FROM l""")
def plan_parse_exact(spark, sf_dir):
    """The exact arm."""
    asked = series.table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_question_sql('conv_id * 8 + turn', _OPERANDS)} AS question")
    return numeric.parse(asked, arm="A0").select("conv_id", "turn", F.col("left_q").alias("quantity"), F.col("left_p").alias("param"))


@query()
def typo_parse(spark, sf_dir):
    """Questions with two letters changed over: the parser's repairs (tested against a plain loop)."""
    asked = series.table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_question_sql('conv_id * 8 + turn', _OPERANDS)} AS question")
    swapped = F.regexp_replace("question", r"(?i)\b(\w{3})(\w)(\w)(\w*)", "$1$3$2$4")
    return numeric.parse(asked.withColumn("question", swapped))


_PAIRED = f"SELECT question_id, question_id AS series_id, question_id + 1 AS series_2_id, {_question_sql('question_id', _OPERANDS)} AS question FROM (SELECT DISTINCT user_id AS question_id FROM events)"


@query(f"""WITH {_PTS}, {_parsed_sql(_PAIRED)}, near AS (SELECT *, lag(value) OVER s AS p, lead(value) OVER s AS f FROM pts WINDOW s AS (PARTITION BY series_id ORDER BY pos)),
st AS (SELECT series_id, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std, var_pop(value) AS var, min(value) AS min, max(value) AS max, max(value) - min(value) AS range,
  (sum(value*value*value)/count(*) - 3*avg(value)*sum(value*value)/count(*) + 2*avg(value)*avg(value)*avg(value)) / (var_pop(value)*stddev_pop(value)) AS skewness, kurtosis_pop(value) AS kurtosis,
  regr_slope(value, pos) AS slope, CAST(arg_max(pos, value) AS DOUBLE) AS argmax, CAST(arg_min(pos, value) AS DOUBLE) AS argmin,
  CAST(count(*) FILTER (value > p AND value > f) AS DOUBLE) AS count_local_max, CAST(count(*) FILTER (value < p AND value < f) AS DOUBLE) AS count_local_min,
  quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.125) AS p125 FROM near GROUP BY series_id),
every AS (UNPIVOT st ON COLUMNS(* EXCLUDE series_id) INTO NAME quantity VALUE value),
chosen AS (SELECT p.*, CASE WHEN series = 'ts2' AND s.series_id IS NOT NULL THEN series_2_id ELSE p.series_id END AS of FROM plans p LEFT JOIN st s ON s.series_id = p.series_2_id),
got AS (SELECT c.*, l.value AS a, r.value AS b FROM chosen c
  LEFT JOIN every l ON l.series_id = of AND l.quantity = CASE WHEN left_q = 'percentile' THEN CASE left_p WHEN 90 THEN 'p90' ELSE 'p125' END ELSE left_q END
  LEFT JOIN every r ON r.series_id = of AND r.quantity = CASE WHEN right_q = 'percentile' THEN CASE right_p WHEN 90 THEN 'p90' ELSE 'p125' END ELSE right_q END)
SELECT question_id, round(CASE op WHEN 'subtract' THEN a - b WHEN 'add' THEN a + b WHEN 'product' THEN a * b WHEN 'ratio' THEN CASE WHEN b <> 0 THEN a / b END ELSE a END, 6) AS value,
  CASE WHEN left_q IS NULL THEN 'abstain' WHEN op = 'ratio' AND b = 0 THEN 'composition:divzero' WHEN op IS NOT NULL THEN 'composition:' || op WHEN left_q = 'slope' THEN 'regression:ols'
    WHEN left_q LIKE 'count_local%' THEN 'method_sensitive:strict_interior' ELSE 'closed_form' END AS note FROM got""")
def plan_eval(spark, sf_dir):
    users = series.table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id")).distinct()
    asked = users.selectExpr("question_id", "question_id AS series_id", "question_id + 1 AS series_2_id", f"{_question_sql('question_id', _OPERANDS)} AS question")
    return numeric.evaluate(numeric.parse(asked), series.user_values(spark, sf_dir))


# Planner replies dealt by a number: plans of depth 0 to 3, with missing operands, divisions by zero, and plans outside the registry.
_NESTED = (
    '{"quantity": "std"}',
    '{"op": "ratio", "args": [{"op": "subtract", "args": [{"quantity": "max"}, {"quantity": "min"}]}, {"quantity": "std"}]}',
    '{"op": "abs_diff", "args": [{"op": "add", "args": [{"quantity": "mean"}, {"op": "product", "args": [{"quantity": "std"}, {"quantity": "slope"}]}]}, {"quantity": "percentile", "param": 12.5}]}',
    '{"op": "ratio", "args": [{"quantity": "mean"}, {"op": "subtract", "args": [{"quantity": "var"}, {"quantity": "var"}]}]}',
    '{"op": "add", "args": [{"quantity": "median", "series": "ts2"}, {"op": "ratio", "args": [{"quantity": "range"}, {"quantity": "argmax", "series": "ts2"}]}]}',
    '{"op": "power", "args": [{"quantity": "mean"}, {"quantity": "std"}]}',
    '{"op": "add", "args": [{"quantity": "mean"}]}',
    '{"op": "product", "args": [{"op": "add", "args": [{"quantity": "bogus"}, {"quantity": "mean"}]}, {"quantity": "max"}]}',
    '{"quantity": null}',
    '{"op": "subtract", "args": [{"quantity": "percentile", "param": 90}, {"op": "add", "args": [{"quantity": "count_local_max"}, {"op": "abs_diff", "args": [{"quantity": "min"}, {"quantity": "median"}]}]}]}',
    '{"op": "add", "args": [{"quantity": "percentile", "param": 101}, 3]}',
    '{"op": "product", "args": [{"op": "power", "args": []}, {"quantity": "mean"}]}',
)
_REGISTERED = ", ".join(f"'{q}'" for q in numeric.REGISTRY)
_OPS = ", ".join(f"'{op}'" for op in numeric.OPS)


def _levels_sql(deepest: int) -> str:
    """Values of plan nodes from the deepest level up: nodes of level d take those of d + 1."""
    op = "json_extract_string(t.j, '$.op')"
    out = []
    for d in range(deepest, -1, -1):
        child = lambda i, c: f"(SELECT {c} FROM level{d + 1} c WHERE c.id = t.id AND c.path = t.path || '{i}')" if d < deepest else "NULL"  # noqa: B023, E731
        out.append(f"""level{d} AS (SELECT id, path, CASE WHEN bad IS NOT NULL THEN NULL WHEN NOT is_op THEN v ELSE CASE {op}
    WHEN 'subtract' THEN a - b WHEN 'add' THEN a + b WHEN 'product' THEN a * b WHEN 'ratio' THEN CASE WHEN b <> 0 THEN a / b END ELSE abs(a - b) END END AS v,
  CASE WHEN bad IS NOT NULL THEN bad WHEN NOT is_op THEN leaf_note WHEN a IS NULL OR b IS NULL THEN 'composition:operand_unavailable'
    WHEN {op} = 'ratio' AND b = 0 THEN 'composition:divzero' ELSE 'composition:' || {op} END AS note,
  coalesce(ar, br, CASE WHEN bad IS NOT NULL THEN bad WHEN NOT is_op AND v IS NULL THEN leaf_note WHEN is_op AND {op} = 'ratio' AND b = 0 THEN 'composition:divzero' END) AS reason
  FROM (SELECT t.*, {child(0, "v")} AS a, {child(1, "v")} AS b, {child(0, "reason")} AS ar, {child(1, "reason")} AS br FROM leaves t WHERE length(path) = {d}) t)""")
    return ", ".join(out)


_NESTED_SQL = f"""WITH RECURSIVE {_PTS}, near AS (SELECT *, lag(value) OVER s AS p, lead(value) OVER s AS f FROM pts WINDOW s AS (PARTITION BY series_id ORDER BY pos)),
st AS (SELECT series_id, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std, var_pop(value) AS var, min(value) AS min, max(value) AS max, max(value) - min(value) AS range,
  regr_slope(value, pos) AS slope, CAST(arg_max(pos, value) AS DOUBLE) AS argmax, CAST(count(*) FILTER (value > p AND value > f) AS DOUBLE) AS count_local_max,
  quantile_cont(value, 0.9) AS "p90.0", quantile_cont(value, 0.125) AS "p12.5" FROM near GROUP BY series_id),
every AS (UNPIVOT st ON COLUMNS(* EXCLUDE series_id) INTO NAME quantity VALUE value),
q AS (SELECT user_id AS id, CAST({_pick_sql(_NESTED, f"user_id % {len(_NESTED)}")} AS JSON) AS j FROM (SELECT DISTINCT user_id FROM events)),
t AS (SELECT id, '' AS path, j FROM q UNION ALL
  SELECT id, path || CAST(i AS VARCHAR), json_extract(j, '$.args[' || i || ']') FROM t, range(2) r(i)
  WHERE json_type(j) = 'OBJECT' AND json_extract_string(j, '$.op') IN ({_OPS}) AND json_array_length(j, '$.args') = 2),
said AS (SELECT *, json_type(j) = 'OBJECT' AND json_extract(j, '$.op') IS NOT NULL AS is_op, json_extract_string(j, '$.quantity') AS quantity, json_extract_string(j, '$.param') AS param,
  CASE WHEN json_type(j) <> 'OBJECT' THEN 'invalid_plan' WHEN json_extract(j, '$.op') IS NOT NULL AND json_extract_string(j, '$.op') NOT IN ({_OPS}) THEN 'invalid_op:' || json_extract_string(j, '$.op')
    WHEN json_extract(j, '$.op') IS NOT NULL AND json_array_length(j, '$.args') <> 2 THEN 'composition:arity'
    WHEN json_extract(j, '$.op') IS NULL AND (json_extract(j, '$.quantity') IS NULL OR json_type(j, '$.quantity') = 'NULL') THEN 'invalid_leaf' END AS bad FROM t),
chosen AS (SELECT said.*, CASE WHEN json_extract_string(j, '$.series') = 'ts2' AND st.series_id IS NOT NULL THEN id + 1 ELSE id END AS of FROM said LEFT JOIN st ON st.series_id = id + 1),
leaves AS (SELECT c.*, e.value AS v, CASE WHEN c.quantity = 'slope' THEN 'regression:ols' WHEN c.quantity LIKE 'count_local%' THEN 'method_sensitive:strict_interior'
    WHEN c.quantity = 'percentile' AND CAST(param AS DOUBLE) > 100 THEN 'error:percentile' WHEN c.quantity IN ({_REGISTERED}) THEN 'closed_form' ELSE 'unknown_quantity' END AS leaf_note
  FROM chosen c LEFT JOIN every e ON e.series_id = of AND e.quantity = CASE WHEN c.quantity = 'percentile' THEN 'p' || CAST(CAST(param AS DOUBLE) AS VARCHAR) ELSE c.quantity END),
{_levels_sql(3)},
formed AS (SELECT id, count(*) FILTER (bad IS NOT NULL OR (NOT is_op AND quantity NOT IN ({_REGISTERED}))) = 0 AS well_formed, count(*) AS n_nodes FROM said GROUP BY id)
SELECT id AS question_id, well_formed, n_nodes, round(v, 6) AS value, note, reason FROM level0 JOIN formed USING (id)"""


@query(_NESTED_SQL)
def nested_plan_eval(spark, sf_dir):
    """Planner replies with plans inside plans, found in prose and run over each user's series and the next user's."""
    users = series.table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id")).distinct()
    plan = _pick_sql(_NESTED, f"question_id % {len(_NESTED)}")
    said = users.selectExpr("question_id", "question_id AS series_id", "question_id + 1 AS series_2_id", f"concat('Plan: ', {plan}, ' or else {{\"quantity\": \"min\"}}.') AS reply")
    read = said.withColumn("nodes", numeric.plan_nodes(numeric.first_object(F.col("reply"))))
    done = numeric.evaluate_nodes(read, series.user_values(spark, sf_dir))
    return done.select("question_id", numeric.well_formed(F.col("nodes")).alias("well_formed"), F.size("nodes").cast("long").alias("n_nodes"), "value", "note", "reason")


_FALLBACK = (
    "conv_id", "turn", f"CASE WHEN turn % 3 = 0 THEN 'How concentrated is it?' ELSE {_question_sql('conv_id * 8 + turn', _OPERANDS)} END AS question",
    f"{_pick_sql((*_NESTED, 'no plan'), f'(conv_id + turn) % {len(_NESTED) + 1}')} AS reply",
)
#: Nodes of the plans above that are of the registry, by their number.
_WELL_FORMED = {0: 1, 1: 5, 2: 7, 3: 5, 4: 5, 9: 7}


@query(f"""WITH {_parsed_sql(f"SELECT {', '.join(_FALLBACK)} FROM conversations")}, a AS (SELECT *, (conv_id + turn) % {len(_NESTED) + 1} AS k, CASE WHEN op IS NOT NULL THEN 3 WHEN left_q IS NOT NULL THEN 1 END AS own FROM plans)
SELECT conv_id, turn, CASE WHEN own IS NULL THEN 'llm_planner' ELSE 'deterministic' END AS parser, own IS NULL AS planner_asked,
  CAST(coalesce(own, CASE k {' '.join(f"WHEN {k} THEN {n}" for k, n in _WELL_FORMED.items())} END) AS BIGINT) AS n_nodes FROM a""")
def planner_fallback(spark, sf_dir):
    """The third arm: planner replies are read only where the parser abstains."""
    asked = series.table(spark, sf_dir, "conversations").selectExpr(*_FALLBACK)
    done = numeric.with_planner(numeric.parse(asked))
    return done.select("conv_id", "turn", "parser", "planner_asked", F.when(F.col("nodes").isNotNull(), F.size("nodes")).cast("long").alias("n_nodes"))


@query("""WITH s AS (SELECT user_id AS u, avg(value) AS gold, median(value) AS predicted FROM events GROUP BY 1)
SELECT u AS series_id, round(gold, 6) AS gold, round(predicted, 6) AS predicted, CASE WHEN abs(predicted - gold) / abs(gold) <= 0.1 THEN 1 ELSE 0 END AS correct,
  round(greatest(1 - abs(predicted - gold) / abs(gold), 0), 6) AS rel_acc FROM s""")
def numeric_score(spark, sf_dir):
    s = stats.basic_stats(series.user_values(spark, sf_dir)).select("series_id", F.col("mean").alias("gold"), F.col("median").alias("predicted"))
    return experiment.numeric_score(s)


@query("""WITH s AS (SELECT user_id % 5 AS part, avg(value) AS g, median(value) AS p FROM events GROUP BY user_id, 1), t AS (SELECT unnest([0.01, 0.05, 0.10, 0.20])::DOUBLE AS tolerance)
SELECT part, round(avg(CASE WHEN abs(p - g) / abs(g) <= tolerance THEN 1.0 ELSE 0.0 END), 6) AS accuracy, tolerance FROM s, t GROUP BY 1, 3""")
def tolerance_sweep(spark, sf_dir):
    s = stats.basic_stats(series.user_values(spark, sf_dir))
    return experiment.tolerance_sweep(s.select(F.pmod("series_id", F.lit(5)).alias("part"), F.col("mean").alias("gold"), F.col("median").alias("predicted")), "part")


_WILSON = """(p + 1.96 * 1.96 / (2 * n) {s} 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)"""


@query(f"""WITH {_ARMS}, s AS (SELECT lang, count(*) AS n, sum(correct) AS hits, avg(CAST(correct AS DOUBLE)) AS p FROM arms GROUP BY 1)
SELECT lang, n, CAST(hits AS BIGINT) AS hits, round(p, 6) AS accuracy, round({_WILSON.format(s="-")}, 6) AS low, round({_WILSON.format(s="+")}, 6) AS high FROM s""")
def accuracy_by_stratum(spark, sf_dir):
    return experiment.accuracy_by(_arms(spark, sf_dir), "lang")


@query(f"""WITH {_ARMS}, s AS (SELECT lang, count(*) AS n, sum(correct) AS h FROM arms GROUP BY 1)
SELECT round(avg(h / n), 6) AS macro, round(sum(h) / sum(n), 6) AS micro, count(*) AS strata FROM s""")
def overall_accuracy(spark, sf_dir):
    return experiment.overall_accuracy(_arms(spark, sf_dir), "lang")


@query(f"""WITH {_ARMS}, s AS (SELECT lang, count(*) AS n, avg(CAST(correct AS DOUBLE)) AS ab, avg(CAST(correct_t AS DOUBLE)) AS tr,
  count(*) FILTER (correct = 1 AND correct_t = 0) AS b, count(*) FILTER (correct = 0 AND correct_t = 1) AS c FROM arms GROUP BY 1),
t AS (SELECT lang, unnest(range(least(b, c) + 1)) AS i, b + c AS m FROM s),
p AS (SELECT lang, sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2))) AS tail FROM t GROUP BY 1)
SELECT lang, n, round(ab, 6) AS acc_base, round(tr, 6) AS acc_treat, b, c, round(tr - ab, 6) AS delta, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * tail) END, 6) AS p FROM s JOIN p USING (lang)""")
def paired_stats(spark, sf_dir):
    return experiment.paired_stats(_arms(spark, sf_dir), "lang")


@query(f"""WITH {_ARMS}, s AS (SELECT source AS name, count(*) FILTER (correct = 1 AND correct_t = 0) AS b, count(*) FILTER (correct = 0 AND correct_t = 1) AS c FROM arms GROUP BY 1),
t AS (SELECT name, unnest(range(least(b, c) + 1)) AS i, b + c AS m FROM s), q AS (SELECT name, CASE WHEN max(m) = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2)))) END AS p FROM t GROUP BY 1),
h AS (SELECT name, round(p, 9) AS p, (count(*) OVER () - row_number() OVER (ORDER BY round(p, 9), name) + 1) * round(p, 9) AS x FROM q)
SELECT name, round(p, 6) AS p, round(least(1, max(x) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM h""")
def holm(spark, sf_dir):
    per = experiment.paired_stats(_arms(spark, sf_dir), "source").select(F.col("source").alias("name"), F.round("p", 9).alias("p"))
    return experiment.holm(per)


@query(f"""WITH {_ARMS}, s AS (SELECT source, sum(correct) AS b, sum(correct_t) AS t, count(*) AS n FROM arms GROUP BY 1)
SELECT source, n, round((sum(t) OVER () - t - sum(b) OVER () + b) / (sum(n) OVER () - n), 6) AS delta_without FROM s""")
def cluster_loo(spark, sf_dir):
    return experiment.cluster_leave_one_out(_arms(spark, sf_dir), "source")


@query(f"""WITH {_ARMS}, s AS (SELECT source, sum(correct) AS b, sum(correct_t) AS t, count(*) AS n, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS k FROM arms GROUP BY 1),
d AS (SELECT rep, CAST(('0x' || substr(md5('boot:' || rep || ':' || i), 1, 8)) AS BIGINT) % k AS i FROM s, range(200) r(rep)),
x AS (SELECT rep, (sum(t) - sum(b)) / sum(n) AS delta FROM d JOIN s USING (i) GROUP BY 1)
SELECT round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high, round(avg(delta), 6) AS mean FROM x""")
def hash_bootstrap(spark, sf_dir):
    return experiment.cluster_bootstrap(_arms(spark, sf_dir), "source")


@query(f"WITH {_ARMS} SELECT lang, count(*) FILTER (correct = 0) AS \"0\", count(*) FILTER (correct = 1) AS \"1\" FROM arms GROUP BY 1")
def crosstab(spark, sf_dir):
    return experiment.crosstab(_arms(spark, sf_dir), "lang", "correct", [0, 1])


_FLAGS = """f AS (SELECT correct, list_filter([CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN n_chars > 3000 THEN 'long' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS flags
  FROM (SELECT quality AS correct, n_chars, toxic FROM documents JOIN labels USING (doc_id)))"""


@query(f"""WITH {_FLAGS}, t AS (SELECT count(*) AS r, count(*) FILTER (correct = 0) AS w FROM f), x AS (SELECT correct, unnest(flags) AS flag FROM f),
g AS (SELECT flag, count(*) AS fired, count(*) FILTER (correct = 0) AS caught FROM x GROUP BY 1)
SELECT flag, fired, round(caught / fired, 6) AS precision, round(caught / w, 6) AS recall, round((caught / fired) / (w / r), 6) AS lift, round(fired / r, 6) AS fire_rate FROM g, t""")
def flag_precision_recall(spark, sf_dir):
    labels = series.table(spark, sf_dir, "labels")
    rows = series.table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id")
    tests = [F.when(F.col("n_chars") < 500, "short"), F.when(F.col("n_chars") > 3000, "long"), F.when(F.col("toxic") == 1, "toxic")]
    return experiment.flag_diagnostics(rows.select(F.col("quality").alias("correct"), F.array_compact(F.array(*tests)).alias("flags")))


@query(f"""WITH {_ARMS}, v AS (SELECT source, upper(lang) AS v, count(*) AS n FROM arms GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, v) AS rn FROM v)
SELECT source, v AS vote, n FROM o WHERE rn = 1""")
def majority_vote(spark, sf_dir):
    return experiment.majority_vote(_arms(spark, sf_dir), "source", "lang")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return experiment.resume(series.table(spark, sf_dir, "documents").select("doc_id", "source"), series.table(spark, sf_dir, "labels"), "doc_id")


_GAINS = f"""WITH {_ARMS}, per AS (SELECT lang AS subset, source AS branch, sum(correct_t - correct) AS g, count(*) AS n FROM arms GROUP BY 1, 2),
means AS (SELECT p.subset AS fold, p.branch, p.g, p.n, (SELECT sum(q.g) / sum(q.n) FROM per q WHERE q.subset <> p.subset AND q.branch IS NOT DISTINCT FROM p.branch) AS mean FROM per p
  WHERE EXISTS (SELECT 1 FROM per q WHERE q.subset <> p.subset)),
grid AS (SELECT *, CAST((i - 30) / 100.0 AS DOUBLE) AS tau FROM means, range(61) r(i)),
folds AS (SELECT fold, tau, sum(CASE WHEN mean IS NULL OR mean > tau THEN g ELSE 0 END) / sum(n) AS gain, sum(CASE WHEN mean IS NULL OR mean > tau THEN n ELSE 0 END) / sum(n) AS look FROM grid GROUP BY 1, 2),
curve AS (SELECT tau, avg(gain) AS gain, avg(look) AS look_rate FROM folds GROUP BY 1)"""


def _gains(spark, sf_dir):
    return _arms(spark, sf_dir).select(F.col("lang").alias("subset"), F.col("source").alias("branch"), (F.col("correct_t") - F.col("correct")).alias("gain"))


@query(f"{_GAINS} SELECT round(tau, 6) AS tau, round(gain, 6) AS gain, round(look_rate, 6) AS look_rate FROM curve")
def loso_cv(spark, sf_dir):
    """Gain of each threshold, mean over the held-out subsets."""
    return experiment.tau_curve(_gains(spark, sf_dir))


@query(f"""{_GAINS}, basin AS (SELECT min(tau) AS low, max(tau) AS high FROM curve WHERE abs(gain - (SELECT max(gain) FROM curve)) < 1e-9),
star AS (SELECT CASE WHEN low <= 0 AND high >= 0 THEN 0.0 ELSE low END AS tau FROM basin), pooled AS (SELECT branch, sum(n) AS n, sum(g) / sum(n) AS mean FROM per GROUP BY 1)
SELECT branch, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(CAST(tau AS DOUBLE), 6) AS tau, mean > tau AS fires FROM pooled, star""")
def tau_rule(spark, sf_dir):
    """Which branches fire at the threshold that held-out subsets choose."""
    return experiment.tau_rule(_gains(spark, sf_dir))


# Questions for routing and gates, with words of every branch; picked by a row's number.
_ROUTE_ASKS = (
    "Is there an upward drift?", "Which seasonal cycle repeats?", "Is there an outlier or a spike?", "White noise or stationary?", "Does x Granger-cause y, with what lag?",
    "Do the shapes resemble each other?", "Describe it.", "Plot the waveform and its frequency", "Does the trend predict a jump, and is the series stationary or not?",
    "Is this series stationary", "Compare the variance level, the slope and the period", "",
)
_BRANCH_OF = ("trend", "periodicity", "anomaly", "noise", "similarity", "causality", "TREND", "unknown")


def _routes_sql(q: str, primary: str) -> str:
    hits = ", ".join(f"CASE WHEN {_any_sql(f'lower({q})', words)} THEN '{branch}' END" for branch, words in verify.BRANCH_WORDS)
    known = ", ".join(f"'{b}'" for b in verify.BRANCHES)
    first = f"CASE WHEN lower({primary}) IN ({known}) THEN lower({primary}) END"
    return f"array_to_string(list_filter([{first}, {hits}], lambda x, i: x IS NOT NULL AND list_position([{first}, {hits}], x) = i)[1:3], ',')"


_ROUTED = f"SELECT conv_id, turn, {_pick_sql(_ROUTE_ASKS, '(conv_id + turn) % 12')} AS question, {_pick_sql(_BRANCH_OF, 'conv_id % 8')} AS primary_branch FROM conversations"


@query(f"WITH r AS ({_ROUTED}) SELECT conv_id, turn, question, {_routes_sql('question', 'primary_branch')} AS routes FROM r")
def keyword_route(spark, sf_dir):
    rows = series.table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_pick_sql(_ROUTE_ASKS, '(conv_id + turn) % 12')} AS question", f"{_pick_sql(_BRANCH_OF, 'conv_id % 8')} AS primary_branch")
    return rows.select("conv_id", "turn", "question", F.array_join(verify.keyword_routes(F.col("question"), F.col("primary_branch")), ",").alias("routes"))


# A router's answers: plain, fenced, within prose, with values that don't exist, and broken ones.
_ROUTER_SAYS = (
    '{"branch": "B", "scope": "local", "series_type": "dual", "subtype": "direction"}', 'Sure: ```json\n{"branch": "B", "subtype": "waveform_type", "scope": "far"}\n``` ',
    'I think {"branch": " B ", "expected_schema": "numerical", "series_type": "many"} fits', '{"branch": "B", "subtype": "Shape"', 'no idea', '{"scope": "local"}',
)


def _router_sql() -> str:
    return f"replace({_pick_sql(_ROUTER_SAYS, '(conv_id * 5 + turn) % 6')}, 'B', {_pick_sql(_BRANCH_OF, 'conv_id % 8')})"


def _parsed_route_sql() -> str:
    said = lambda f: f"trim(lower(coalesce(json_extract_string(j, '$.{f}'), '')))"
    allowed = " OR ".join(f"(branch = '{b}' AND subtype IN ({', '.join(repr(x) for x in known)}))" for b, known in verify.SUBTYPES.items())
    known = ", ".join(f"'{b}'" for b in verify.BRANCHES)
    return f"""SELECT conv_id, turn, CASE WHEN ok THEN branch END AS branch, CASE WHEN ok AND scope IN ('global', 'local') THEN scope ELSE 'global' END AS scope,
  CASE WHEN ok AND series_type IN ('single', 'dual') THEN series_type ELSE 'single' END AS series_type, CASE WHEN ok AND ({allowed}) THEN subtype END AS subtype,
  CASE WHEN ok AND expected_schema IN ('mcq', 'numerical', 'categorical') THEN expected_schema ELSE 'mcq' END AS expected_schema, ok AS parse_success
FROM (SELECT conv_id, turn, {', '.join(f'{said(f)} AS {f}' for f in ('branch', 'scope', 'series_type', 'subtype', 'expected_schema'))},
    coalesce({said('branch')} IN ({known}), false) AS ok
  FROM (SELECT conv_id, turn, CASE WHEN json_valid(inside) THEN inside END AS j FROM (SELECT conv_id, turn, regexp_extract(raw, '(?s)\\{{.*\\}}') AS inside FROM
    (SELECT conv_id, turn, {_router_sql()} AS raw FROM conversations))))"""


@query(_parsed_route_sql())
def route_parse(spark, sf_dir):
    rows = series.table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_router_sql()} AS raw")
    return rows.select("conv_id", "turn", verify.parse_routing(F.col("raw")).alias("r")).select("conv_id", "turn", "r.*")


# Options and answers in all forms; picked by a row's number.
_SHAPE_OPTIONS = ("1|2.5|3,000", "up|down", "[1, 2]|[3, 4]", "1 to 2|3-4", "only", "", "a series|b", "5-6|7")
_SHAPE_ANSWERS = ("A", "3.5", "1,200", "rising", "", " UP ", "nan", "e")
_SHAPE_KINDS = ("", "single choice", "numeric", "open text")


def _shape_columns() -> list[str]:
    reply = (" Confidence: HIGH", " confidence=0.75", " confidently", " confidence - 1.0")
    return [
        "conv_id", "turn", f"{_pick_sql(_SHAPE_OPTIONS, '(conv_id + 3 * turn) % 8')} AS texts", f"{_pick_sql(_SHAPE_ANSWERS, '(conv_id * 3 + turn) % 8')} AS answer",
        f"{_pick_sql(_SHAPE_KINDS, 'CAST(floor(conv_id / 8) AS BIGINT) % 4')} AS kind", f"{_pick_sql(_ROUTE_ASKS, '(conv_id + turn) % 12')} AS question",
        f"concat({_pick_sql(_SHAPE_ANSWERS, 'turn % 8')}, {_pick_sql(reply, 'conv_id % 4')}) AS reply",
    ]


@query(f"""WITH r AS (SELECT {", ".join(_shape_columns())} FROM conversations), o AS (SELECT *, CASE WHEN texts = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(texts, '|') END AS options,
  TRY_CAST(replace(trim(answer), ',', '') AS DOUBLE) IS NOT NULL AS number FROM r),
t AS (SELECT *, CASE WHEN len(options) >= 2 THEN 'mcq' WHEN {_any_sql("lower(question)", verify.LABEL_QUESTIONS)} THEN 'categorical' ELSE 'numerical' END AS schema,
  CASE WHEN len(options) >= 2 OR contains(kind, 'choice') THEN 'mcq' WHEN contains(kind, 'numeric') OR number THEN 'numerical' WHEN trim(answer) <> '' THEN 'categorical' ELSE 'open' END AS answer_type,
  CASE WHEN texts = '' THEN 'none' WHEN regexp_matches(texts, '\\[|\\]|series') THEN 'trajectory' WHEN texts = '1|2.5|3,000' THEN 'scalar' WHEN texts = '1 to 2|3-4' THEN 'range' ELSE 'categorical_text' END AS option_type
  FROM o)
SELECT conv_id, turn, schema, answer_type, option_type, CASE schema WHEN 'mcq' THEN upper(trim(answer)) IN ('A', 'B', 'C', 'D') WHEN 'categorical' THEN trim(answer) <> ''
    ELSE coalesce(isfinite(TRY_CAST(answer AS DOUBLE)), false) END AS complies,
  nullif(lower(regexp_extract(reply, '(?i)\\bconfidence\\s*[:=-]\\s*(high|medium|low|0(?:\\.\\d+)?|1(?:\\.0+)?)\\b', 1)), '') AS confidence,
  CASE WHEN list_position(list_transform(options, lambda x: trim(lower(x))), trim(lower(answer))) > 0 THEN chr(CAST(64 + list_position(list_transform(options, lambda x: trim(lower(x))), trim(lower(answer))) AS INTEGER)) END AS gold_letter
FROM t""")
def answer_shapes(spark, sf_dir):
    rows = series.table(spark, sf_dir, "conversations").selectExpr(*_shape_columns())
    options = F.when(F.col("texts") == "", F.array().cast("array<string>")).otherwise(F.split("texts", "[|]"))
    rows = rows.withColumn("options", options).withColumn("schema", verify.expected_schema(F.col("options"), F.col("question")))
    return rows.select(
        "conv_id", "turn", "schema", verify.answer_type(F.col("options"), F.col("answer"), F.col("kind")).alias("answer_type"), verify.option_type(F.col("options")).alias("option_type"),
        verify.complies(F.col("answer"), F.col("schema")).alias("complies"), verify.stated_confidence(F.col("reply")).alias("confidence"),
        verify.gold_letter(F.col("options"), F.col("answer")).alias("gold_letter"),
    )


@query(f"""WITH {_PTS}, users AS (SELECT DISTINCT user_id AS question_id FROM events), w AS (SELECT question_id, 20 + (question_id % 5) * 8 AS a, 4 + question_id % 9 AS b FROM users),
ends AS (SELECT series_id, count(*) AS n, arg_min(value, pos) AS f, arg_max(value, pos) AS l FROM pts GROUP BY 1),
centred AS (SELECT series_id, pos, value - avg(value) OVER (PARTITION BY series_id) AS v, count(*) OVER (PARTITION BY series_id) AS n FROM pts),
bins AS (SELECT series_id, n, unnest(range(1, n // 2 + 1)) AS bin, pos, v FROM centred),
mags AS (SELECT series_id, n, bin, sqrt(pow(sum(v * cos(2 * pi() * ((bin * pos) % n) / n)), 2) + pow(sum(v * sin(2 * pi() * ((bin * pos) % n) / n)), 2)) AS m FROM bins GROUP BY ALL),
per AS (SELECT series_id, any_value(n) AS n, round_even(any_value(n) / arg_max(bin, m), 0) AS p FROM mags GROUP BY 1),
back AS (SELECT e.*, CASE WHEN p BETWEEN 2 AND e.n // 2 THEN (SELECT value FROM pts x WHERE x.series_id = e.series_id AND x.pos = e.n - CAST(p AS BIGINT)) END AS s FROM ends e JOIN per USING (series_id)),
points AS (SELECT series_id, unnest([l, l + (l - f) / greatest(n - 1, 1), coalesce(s, l)]) AS x, unnest([0, -1, -2]) AS place FROM back),
opts AS (SELECT question_id, unnest([0, 1, 2, 3]) AS i, unnest([a, a + b, a - b, a + 3 * b]) AS lo, unnest([a + b, a + 2 * b, a, a + 5 * b]) AS hi FROM w),
sc AS (SELECT question_id, i, place, CASE WHEN x BETWEEN lo AND hi THEN 1.0 ELSE round(-abs(x - (lo + hi) / 2) / (hi - lo), 9) END AS score FROM opts JOIN points ON series_id = question_id),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, i, place DESC) = 1)
SELECT question_id, chr(CAST(65 + i AS INTEGER)) AS letter, CASE place WHEN 0 THEN 'persistence' WHEN -1 THEN 'drift' ELSE 'seasonal_naive' END AS method FROM best""")
def forecast_range(spark, sf_dir):
    """Range options ranked against forecasts of each user's next value."""
    users = series.table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id")).distinct()
    a, b = F.lit(20) + (F.col("question_id") % 5) * 8, F.lit(4) + F.col("question_id") % 9
    said = lambda lo, hi: F.concat_ws(" to ", lo.cast("string"), hi.cast("string"))
    rows = users.select("question_id", F.col("question_id").alias("series_id"), F.array(said(a, a + b), said(a + b, a + 2 * b), said(a - b, a), said(a + 3 * b, a + 5 * b)).alias("options"))
    return verify.range_head(rows, series.user_values(spark, sf_dir))


_FIRED = ("trend", "periodicity")


def _evidence_sql() -> str:
    """Evidence of each user's series, with a branch, subtype and question picked by its number."""
    return f"""{_PTS}, {_FIT}, parts AS (SELECT series_id, pos * 4 // count(*) OVER (PARTITION BY series_id) AS part, value FROM pts),
chunks AS (SELECT series_id, list(m ORDER BY part) AS means, max(CASE WHEN part = 3 THEN v END) / max(CASE WHEN part = 0 THEN v END) AS variance_ratio
  FROM (SELECT series_id, part, avg(value) AS m, var_pop(value) AS v FROM parts GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT series_id, max(abs(value - mean) / std) AS max_deviation, count(*) FILTER (abs(value - mean) / std > 3) AS outlier_count FROM pts JOIN f USING (series_id) GROUP BY 1),
ev AS (SELECT *, abs(best_corr) AS pval_12, 1 - abs(best_corr) AS pval_21, {_pick_sql(_BRANCH_OF, "series_id % 8")} AS branch, {_pick_sql(("waveform_type", "variance_level", "direction"), "series_id % 3")} AS subtype,
  {_pick_sql(_ROUTE_ASKS, "series_id % 12")} AS question FROM fit JOIN chunks USING (series_id) JOIN z USING (series_id)),
tested AS (SELECT *, list_filter([CASE WHEN branch = 'trend' AND r2 < 0.65 THEN 'low_r2' END, CASE WHEN branch = 'causality' AND direction = 'none' THEN 'granger_not_significant' END,
  CASE WHEN abs(best_corr) < 0.2 THEN 'weak_correlation' END, CASE WHEN std / abs(mean) > 1.5 THEN 'high_volatility' END,
  CASE WHEN branch IN ('periodicity', 'noise', 'similarity', 'causality') OR (branch = 'trend' AND slope IS NULL) OR branch = 'anomaly' THEN 'evidence_incomplete' END], lambda x: x IS NOT NULL) AS flags FROM ev)"""


@query(f"""WITH {_evidence_sql()}, p AS (SELECT *, least(1, 0.12 * len(list_filter(flags, lambda x: x <> 'evidence_incomplete')) + CASE WHEN list_contains(flags, 'evidence_incomplete') THEN 0.3 ELSE 0 END) AS penalty,
  CASE branch WHEN 'trend' THEN 1.0 WHEN 'periodicity' THEN 0.0 WHEN 'anomaly' THEN 2 / 3.0 WHEN 'noise' THEN 0.0 WHEN 'similarity' THEN 0.0 WHEN 'causality' THEN 4 / 5.0 ELSE 1.0 END AS complete,
  CASE WHEN r2 >= 0.75 THEN 1.0 WHEN r2 >= 0.5 THEN 0.7 ELSE 0.4 END AS math FROM tested),
q AS (SELECT *, greatest(0, least(1, 0.35 * complete + 0.3 * (1 - penalty) + 0.2 * math)) AS score FROM p)
SELECT series_id, branch, array_to_string(flags, ',') AS flags, round(score, 4) AS quality, round(score, 9) >= 0.55 AS passed, round(complete, 6) AS completeness, round(penalty, 6) AS penalty, round(math, 6) AS math FROM q""")
def verifier_flags(spark, sf_dir):
    """Flags and quality of evidence on each user's series."""
    e, fields = _evidence(spark, sf_dir)
    judged = e.withColumn("q", verify.quality_gate(fields, F.col("flags"), F.col("branch"), F.lit(0.0)))
    return judged.select("series_id", "branch", F.array_join("flags", ",").alias("flags"), F.col("q.score").alias("quality"), "q.passed", "q.completeness", "q.penalty", "q.math")


@query(f"""WITH {_evidence_sql()}, r AS (SELECT *, list_sort(list_filter([r2, exp_r2, log_r2], lambda x: x IS NOT NULL), 'DESC') AS fits, lower(question) AS q FROM tested),
s AS (SELECT *, len(flags) AS k, list_contains(flags, 'evidence_incomplete') AS incomplete, {_any_sql("q", verify.VISUAL_WORDS)} AS explicit,
  [fits[1] < 0.65, fits[1] - fits[2] < 0.05, (pval_12 BETWEEN 0.04 AND 0.1) OR (pval_21 BETWEEN 0.04 AND 0.1), abs(best_corr) >= 0.3 AND greatest(pval_12, pval_21) >= 0.1,
   variance_ratio >= 1.5 OR variance_ratio <= 0.67 OR (len(means) >= 3 AND CASE WHEN list_avg(means) = 0 THEN list_stddev_pop(means) > 0 ELSE abs(list_stddev_pop(means) / list_avg(means)) > 0.5 END),
   {_any_sql("q", verify.ANOMALY_WORDS)} AND max_deviation < 2] AS t FROM r),
c AS (SELECT *, greatest(0, least(1, 1 - 0.15 * k - CASE WHEN incomplete THEN 0.25 ELSE 0 END - CASE WHEN t[1] THEN 0.2 ELSE 0 END - CASE WHEN t[2] THEN 0.15 ELSE 0 END - CASE WHEN t[3] THEN 0.15 ELSE 0 END
    - CASE WHEN t[4] THEN 0.15 ELSE 0 END - CASE WHEN t[5] THEN 0.15 ELSE 0 END - CASE WHEN t[6] THEN 0.1 ELSE 0 END)) AS score,
  list_concat(list_sort(flags), list_filter([CASE WHEN t[1] THEN 'low_fit' END, CASE WHEN t[2] THEN 'fit_ambiguous' END, CASE WHEN t[3] THEN 'pval_marginal' END, CASE WHEN t[4] THEN 'corr_granger_conflict' END,
    CASE WHEN t[5] THEN 'chunk_variance' END, CASE WHEN t[6] THEN 'weak_anomaly_signal' END], lambda x: x IS NOT NULL)) AS reasons,
  k = 0 AND ((fits[1] >= 0.75 AND (fits[2] IS NULL OR fits[1] - fits[2] >= 0.1)) OR (abs(best_corr) >= 0.3 AND least(pval_12, pval_21) <= 0.01)) AS sure FROM s),
g AS (SELECT *, CASE WHEN sure AND NOT explicit THEN false ELSE k >= 2 OR (incomplete AND branch = 'unknown') OR round(score, 9) <= 0.85 OR explicit END AS fires,
  CASE WHEN subtype = 'waveform_type' THEN 'line_plot' WHEN {_any_sql("q", verify.SPECTROGRAM_WORDS)} OR list_has_any(reasons, {list(verify.SPECTROGRAM_REASONS)}) THEN 'spectrogram'
    WHEN {_any_sql("q", verify.SHAPE_WORDS)} OR list_has_any(reasons, {list(verify.LINE_REASONS)}) THEN 'line_plot' WHEN branch IN ('periodicity', 'noise', 'causality') THEN 'spectrogram' ELSE 'line_plot' END AS kind FROM c)
SELECT series_id, fires AS triggered, CASE WHEN fires THEN kind END AS viz_type, round(score, 6) AS confidence, array_to_string(reasons, ',') AS reasons,
  fires AND branch NOT IN ('anomaly', 'noise', 'similarity', 'causality') AS learned, CASE WHEN branch IN ('anomaly', 'noise', 'similarity', 'causality') THEN 'suppress' WHEN fires THEN 'keep' ELSE 'keep_skip' END AS policy_decision FROM g""")
def visual_gate(spark, sf_dir):
    """The additive gate and the learned one over the same evidence."""
    e, fields = _evidence(spark, sf_dir)
    gated = e.withColumn("g", verify.visual_gate(fields, F.col("flags"), F.col("branch"), F.col("subtype"), F.col("question"), [F.col("means")]))
    gated = gated.withColumn("l", verify.learned_gate(F.col("g"), F.col("branch"), [b for b in verify.BRANCHES if b not in _FIRED]))
    return gated.select("series_id", "g.triggered", "g.viz_type", "g.confidence", F.array_join("g.reasons", ",").alias("reasons"), F.col("l.triggered").alias("learned"), "l.policy_decision")


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    pts = series.user_values(spark, sf_dir)
    n = F.count("*").over(stats.whole())
    parts = pts.withColumn("part", F.floor(F.col("pos") * 4 / n)).groupBy("series_id", "part").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    part = lambda k: F.max(F.when(F.col("part") == k, F.col("v")))
    chunks = parts.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "m"))), lambda c: c["m"]).alias("means"), (part(3) / part(0)).alias("variance_ratio"))
    sums = pts.groupBy("series_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.corr("value", "pos").alias("best_corr"))
    e = trend.trend_fit(pts).join(chunks, "series_id").join(sums, "series_id")
    e = e.withColumn("max_deviation", F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")) / F.col("std"))
    e = e.withColumns({"pval_12": F.abs("best_corr"), "pval_21": 1 - F.abs("best_corr"), "outlier_count": F.lit(0)})
    e = e.selectExpr(
        "*", f"{_pick_sql(_BRANCH_OF, 'series_id % 8')} AS branch", f"{_pick_sql(('waveform_type', 'variance_level', 'direction'), 'series_id % 3')} AS subtype", f"{_pick_sql(_ROUTE_ASKS, 'series_id % 12')} AS question"
    )
    names = ("slope", "direction", "r2", "exp_r2", "log_r2", "mean", "std", "best_corr", "pval_12", "pval_21", "variance_ratio", "max_deviation", "outlier_count")
    fields = {c: F.col(c) for c in names}
    fields["best_lag"] = F.lit(None)
    return e.withColumn("flags", verify.row_flags(fields, F.col("branch"))), fields


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT vec_id AS series_id, CAST(len(e) AS INTEGER) AS n, round(e[1], 6) AS first, round(list_sum(list_transform(e, lambda x: round(x, 4))), 4) AS total FROM v""")
def array_parse(spark, sf_dir):
    e = series.embedding_series(spark, sf_dir)
    text = F.concat(F.lit("["), F.array_join(F.transform("values", lambda v: v.cast("string")), ", "), F.lit("]"))
    parsed = e.select("series_id", ingest.parse_array(text).alias("v"))
    total = F.round(F.aggregate(F.transform("v", lambda v: F.round(v, 4)), F.lit(0.0), lambda a, b: a + b), 4)
    return parsed.select("series_id", F.size("v").alias("n"), F.col("v")[0].alias("first"), total.alias("total"))


# Options in every form; other turns are read as they are.
_OPTION_TEXTS = (
    '["up", " down "]', '["x", "y", "z"]', "A) first B) second C) third", "(A) not a mark, so commas", "A. one. B. two", "pre A: x B: y", " , a,, b ", "[broken", "", "A) "
)
_OPTION_SQL = f"CASE WHEN turn % 2 = 0 THEN {_pick_sql(_OPTION_TEXTS, '(conv_id + turn) % 10')} ELSE text END"


@query(f"""WITH r AS (SELECT conv_id, turn, regexp_replace({_OPTION_SQL}, '^\\s+|\\s+$', '', 'g') AS t FROM conversations),
l AS (SELECT *, CASE WHEN starts_with(t, '[') AND json_valid(replace(t, chr(39), '"')) THEN list_transform(CAST(CAST(replace(t, chr(39), '"') AS JSON) AS VARCHAR[]), lambda x: trim(x)) END AS listed,
  list_filter(list_transform(regexp_split_to_array(t, '(?:^|\\s)[A-D][).:]\\s+')[2:], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS lettered,
  list_filter(list_transform(string_split(t, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS plain FROM r),
o AS (SELECT conv_id, turn, t, coalesce(listed, CASE WHEN len(lettered) > 0 THEN lettered END, plain) AS o, coalesce(array_to_string(listed, ', '), t) AS joined FROM l)
SELECT conv_id, turn, CAST(len(o) AS INTEGER) AS n, array_to_string(o, '|') AS options, joined FROM o""")
def options_parse(spark, sf_dir):
    rows = series.table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_OPTION_SQL} AS t")
    options = ingest.parse_options(F.col("t"))
    return rows.select("conv_id", "turn", F.size(options).alias("n"), F.array_join(options, "|").alias("options"), ingest.joined_list(F.col("t")).alias("joined"))


@query("""WITH r AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT vec_id AS id, CASE WHEN label % 2 = 0 THEN 'unknown' ELSE 'cat' END AS category, CASE WHEN label % 3 = 0 THEN 'down' WHEN label % 3 = 1 THEN 'Z' ELSE 'flat' END AS answer,
  CASE WHEN label % 2 = 1 THEN round(list_sum(list_transform(e[1:3], lambda x: round(x, 4))), 4) END AS ts_sum, CASE WHEN label % 2 = 0 THEN round(round(e[1], 4) + round(e[2], 4), 4) END AS ts1_sum,
  CASE WHEN label % 2 = 0 THEN round(e[3], 4) END AS ts2_sum FROM r""")
def runner_rows(spark, sf_dir):
    """Question rows with one series or two, gold letters or texts."""
    e = series.table(spark, sf_dir, "embeddings")
    n = lambda i: F.col("embedding")[i].cast("double").cast("string")
    single, dual = F.concat(F.lit("["), n(0), F.lit(", "), n(1), F.lit(", "), n(2), F.lit("]")), F.concat(F.lit("[["), n(0), F.lit(","), n(1), F.lit("],["), n(2), F.lit("]]"))
    rows = e.select(
        F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 1, "cat").otherwise("").alias("category"), F.lit("q").alias("question"), F.lit("A) up B) down C) flat").alias("option"),
        F.expr("CASE label % 3 WHEN 0 THEN ' b ' WHEN 1 THEN 'Z' ELSE 'flat' END").alias("answer"), F.when(F.col("label") % 2 == 0, dual).otherwise(single).alias("value"),
    )
    total = lambda c: F.round(F.aggregate(F.transform(c, lambda v: F.round(v, 4)), F.lit(0.0), lambda a, b: a + b), 4)
    r = ingest.runner_rows(rows)
    return r.select("id", "category", "answer", total("ts").alias("ts_sum"), total("ts1").alias("ts1_sum"), total("ts2").alias("ts2_sum"))


@query("""WITH c AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'EN' WHEN 'de' THEN 'DE' END AS category FROM documents)
SELECT doc_id, category FROM c WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5('sample:' || doc_id), doc_id) <= 25""")
def exam_rows(spark, sf_dir):
    """Rows of known categories under their codes, some of each."""
    d = series.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"))
    return ingest.exam_rows(d, {"en": "EN", "de": "DE"}, per_category=25, key="doc_id").select("doc_id", "category")


@query(f"""WITH {_PTS}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY md5('ctl:' || pos), value) - 1 AS place FROM pts)
SELECT series_id, place AS pos, round(value, 6) AS value FROM k""")
def input_shuffle(spark, sf_dir):
    mixed = ingest.shuffled(series.to_arrays(series.user_values(spark, sf_dir)), "ctl")
    return series.to_points(mixed)


# Answers of every type: letters, option texts, numbers in words, labels with dashes, errors and abstentions.
_SCORE_TYPES = ("mcq", "numerical", "categorical", "open", "textual")
_SCORE_PREDICTED = ("A", "second option", "11", "about 9.7 units", "Trend Up", "b", "1,000", "z", "nothing", "-3e1")
_SCORE_GOLD = ("B", "10", "trend-up", "second option", "1000", "first option", "-30.5", "0")


def _score_columns() -> list[str]:
    return [
        "doc_id", f"{_pick_sql(_SCORE_TYPES, 'doc_id % 5')} AS answer_type", f"CASE WHEN doc_id % 11 = 0 THEN NULL ELSE {_pick_sql(_SCORE_PREDICTED, 'CAST(floor(doc_id / 5) AS BIGINT) % 10')} END AS predicted",
        f"{_pick_sql(_SCORE_GOLD, 'CAST(floor(doc_id / 3) AS BIGINT) % 8')} AS gold", "CASE WHEN doc_id % 13 = 0 THEN 'timeout' END AS error",
    ]


def _number_sql(t: str) -> str:
    first = f"regexp_extract(replace(trim({t}), ',', ''), '([-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?)', 1)"
    return f"coalesce(TRY_CAST(replace(trim({t}), ',', '') AS DOUBLE), TRY_CAST(nullif({first}, '') AS DOUBLE))"


_SCORED = f"""r AS (SELECT {", ".join(_score_columns())} FROM documents),
n AS (SELECT *, {_number_sql("predicted")} AS x, {_number_sql("gold")} AS y, ['First Option', 'Second-Option', 'third'] AS options, regexp_replace(lower(trim(predicted)), '[\\s_-]', '', 'g') AS pl,
  regexp_replace(lower(trim(gold)), '[\\s_-]', '', 'g') AS gl, CASE WHEN regexp_full_match(predicted, '[A-Za-z]') THEN ascii(upper(predicted)) - 64 END AS pi, CASE WHEN regexp_full_match(gold, '[A-Za-z]') THEN ascii(upper(gold)) - 64 END AS gi FROM r),
m AS (SELECT *, CASE answer_type WHEN 'mcq' THEN CASE WHEN pi IS NOT NULL AND gi IS NOT NULL THEN pi = gi
      WHEN pi IS NOT NULL THEN pi <= 3 AND ['firstoption', 'secondoption', 'third'][pi] = gl WHEN gi <= 3 THEN pl = ['firstoption', 'secondoption', 'third'][gi] ELSE pl = gl END
    WHEN 'numerical' THEN CASE WHEN abs(y) < 1e-9 THEN abs(x - y) <= 1e-9 ELSE abs(x - y) / abs(y) <= 0.1 END ELSE pl = gl END AS good FROM n),
o AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN answer_type IN ('open', 'textual') THEN 'open' WHEN predicted IS NULL THEN 'abstain' WHEN good THEN 'correct' ELSE 'incorrect' END AS outcome,
  CASE WHEN error IS NULL AND answer_type = 'numerical' AND predicted IS NOT NULL THEN CASE WHEN abs(y) < 1e-9 THEN CASE WHEN abs(x - y) <= 1e-9 THEN 1.0 ELSE 0.0 END
    WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(1 - abs(x - y) / abs(y), 0) END END AS rel_acc FROM m)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.table(spark, sf_dir, "documents").selectExpr(*_score_columns())
    return experiment.score_predictions(rows.withColumn("options", F.array(F.lit("First Option"), F.lit("Second-Option"), F.lit("third"))))


@query(f"WITH {_SCORED} SELECT doc_id, answer_type, predicted, gold, outcome, round(rel_acc, 6) AS rel_acc FROM o")
def score_rows(spark, sf_dir):
    """Typed scoring, row by row."""
    return _scored(spark, sf_dir).select("doc_id", "answer_type", "predicted", "gold", "outcome", "rel_acc")


@query(f"""WITH {_SCORED} SELECT count(*) AS total, count(*) FILTER (answer_type NOT IN ('open', 'textual')) AS eligible, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'incorrect') AS incorrect,
  count(*) FILTER (outcome = 'open') AS open_excluded, count(*) FILTER (outcome = 'abstain') AS abstained, count(*) FILTER (outcome = 'error') AS errors FROM o""")
def score_summary(spark, sf_dir):
    return experiment.score_summary(_scored(spark, sf_dir))


_LOOKS = "looks AS (SELECT lang, correct AS m, correct_t AS v, CASE WHEN doc_id % 2 = 0 THEN correct ELSE correct_t END AS f FROM arms)"


@query(f"""WITH {_ARMS}, {_LOOKS}, g AS (SELECT lang, count(*) AS n_fired, count(*) FILTER (m <> v) AS n_disc, count(*) FILTER (m <> v AND f = v) AS fo, count(*) FILTER (m <> v AND v = 1) AS vr,
  count(*) FILTER (m = 0 AND f = 1) - count(*) FILTER (m = 1 AND f = 0) AS net FROM looks GROUP BY 1)
SELECT lang, n_fired, n_disc, round(fo / nullif(n_disc, 0), 6) AS follow_rate, round(vr / nullif(n_disc, 0), 6) AS p_vision, net FROM g""")
def trust_table(spark, sf_dir):
    rows = _arms(spark, sf_dir).select("lang", F.col("correct").alias("m"), F.col("correct_t").alias("v"), F.expr("IF(doc_id % 2 = 0, correct, correct_t)").alias("f"))
    return experiment.trust_table(rows, "lang")


@query(f"""WITH {_ARMS} SELECT lang, count(*) FILTER (correct = 1 AND correct_t = 0) AS harmful, count(*) FILTER (correct = 0 AND correct_t = 1) AS helpful,
  count(*) FILTER (correct = correct_t) AS neutral FROM arms GROUP BY 1""")
def gate_efficiency(spark, sf_dir):
    return experiment.gate_efficiency(_arms(spark, sf_dir).select("lang", F.col("correct").alias("base"), F.col("correct_t").alias("gated")), "lang")


@query("""WITH c AS (SELECT role AS model, length(text) AS i, length(text) // 2 AS o FROM conversations), s AS (SELECT model, count(*) AS calls, sum(i) AS i, sum(o) AS o FROM c GROUP BY 1)
SELECT model, calls, CAST(i AS BIGINT) AS tokens_in, CAST(o AS BIGINT) AS tokens_out, round(CASE model WHEN 'user' THEN i * 0.25::DOUBLE + o * 1.5::DOUBLE WHEN 'assistant' THEN i * 1.0::DOUBLE + o * 2.0::DOUBLE END / 1e6, 6) AS cost FROM s""")
def spend_report(spark, sf_dir):
    n = F.length("text").cast("long")
    calls = series.table(spark, sf_dir, "conversations").select(F.col("role").alias("model"), n.alias("tokens_in"), F.floor(n / 2).alias("tokens_out"))
    prices = spark.createDataFrame([("user", 0.25, 1.5), ("assistant", 1.0, 2.0)], "model string, price_in double, price_out double")
    return experiment.spend(calls, prices)


# A run's result table on the documents' labels; further columns are picked by a row's number.
_RUN_COLUMNS = [
    "doc_id", "source AS subset", "lang AS category", "quality AS correct", "1 - toxic AS correct_t", "CASE WHEN quality + toxic > 0 THEN 1 ELSE 0 END AS correct_p",
    f"CASE WHEN doc_id % 17 = 0 THEN NULL ELSE {_pick_sql(_BRANCH_OF[:6], 'doc_id % 6')} END AS branch", f"CASE WHEN doc_id % 13 = 0 THEN NULL ELSE {_pick_sql(_BRANCH_OF[:6], '(doc_id + CAST(floor(doc_id / 9) AS BIGINT) % 2) % 6')} END AS branch_t",
    f"{_pick_sql(('direction', 'shape', 'lag_value'), 'doc_id % 3')} AS subtype", f"{_pick_sql(verify.SCHEMAS, 'CAST(floor(doc_id / 2) AS BIGINT) % 3')} AS schema",
    f"{_pick_sql(('numerical value', 'single choice', 'open', 'Binary Choice'), 'doc_id % 4')} AS qa_type", f"CASE WHEN doc_id % 7 = 6 THEN NULL ELSE {_pick_sql(('a', 'B ', 'C', 'D', 'nan', 'E'), 'doc_id % 6')} END AS gold",
    f"CASE WHEN doc_id % 5 = 4 THEN NULL ELSE {_pick_sql(('A', 'b', 'C', 'D'), 'CAST(floor(doc_id / 3) AS BIGINT) % 4')} END AS pred", f"{_pick_sql(('A', 'B', ' c', 'none'), 'CAST(floor(doc_id / 4) AS BIGINT) % 4')} AS look_s",
    f"{_pick_sql(('D', 'B', 'C', 'A'), 'CAST(floor(doc_id / 5) AS BIGINT) % 4')} AS look_p", f"{_pick_sql(('A', 'C', 'D'), 'CAST(floor(doc_id / 6) AS BIGINT) % 3')} AS math",
    f"{_pick_sql(('True', 'no', '1', '0', 'yes', '1.0'), 'CAST(floor(doc_id / 2) AS BIGINT) % 6')} AS fired", f"{_pick_sql(('HIGH', ' low', 'medium', 'sure', ''), 'doc_id % 5')} AS confidence",
    f"{_pick_sql(('low_r2|arch_effects', '', 'weak_correlation', 'low_r2'), 'doc_id % 4')} AS flag_text", f"CASE WHEN doc_id % 9 = 0 THEN NULL ELSE {_pick_sql(('std', 'slope', 'period', 'max'), 'doc_id % 4')} END AS quantity",
    f"{_pick_sql(('1.5', '', ' ', '7'), 'CAST(floor(doc_id / 7) AS BIGINT) % 4')} AS predicted_value", "CASE WHEN doc_id % 8 = 0 THEN NULL ELSE (doc_id % 11) / CAST(10 AS DOUBLE) END AS rel_acc",
    "CASE WHEN doc_id % 10 = 0 THEN NULL ELSE (doc_id % 21) / CAST(20 AS DOUBLE) END AS quality_score",
    f"""{_pick_sql(('["redo", "zoom"]', '[]', '["zoom"]', ''), 'CAST(floor(doc_id / 3) AS BIGINT) % 4')} AS executed""", "doc_id % 3 = 0 AS looked", "doc_id % 4 = 0 AS looked_t",
]
_RUNS = f"runs AS (SELECT {', '.join(_RUN_COLUMNS)} FROM documents JOIN labels USING (doc_id))"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.table(spark, sf_dir, "documents").join(series.table(spark, sf_dir, "labels"), "doc_id")
    return rows.selectExpr(*_RUN_COLUMNS)


_NORM = """CASE WHEN upper(trim(coalesce({0}, ''))) IN ('NAN', 'NONE') THEN '' ELSE upper(trim(coalesce({0}, ''))) END"""


@query(f"""WITH {_RUNS} SELECT doc_id, lower(trim(fired)) IN ('true', '1', '1.0', 'yes') AS wide, lower(trim(fired)) IN ('true', '1', '1.0') AS narrow, {_NORM.format("gold")} AS letter,
  CASE WHEN lower(trim(confidence)) IN ('high', 'medium', 'low') THEN lower(trim(confidence)) ELSE 'other' END AS bucket FROM runs""")
def normalised_cells(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return r.select("doc_id", reports.truthy(F.col("fired")).alias("wide"), reports.truthy(F.col("fired"), wide=False).alias("narrow"), reports.normal_letter(F.col("gold")).alias("letter"), reports.confidence_bucket(F.col("confidence")).alias("bucket"))


@query(f"WITH {_RUNS} SELECT doc_id, gold, branch FROM runs WHERE {_NORM.format('gold')} IN ('A', 'B', 'C', 'D') AND schema = 'mcq' AND branch IN ('trend', 'noise')")
def scoreable_choices(spark, sf_dir):
    """Rows with a letter as gold, asked as a choice, of enabled branches."""
    return reports.scoreable(_runs(spark, sf_dir)).filter(F.col("schema") == "mcq").filter(F.col("branch").isin("trend", "noise")).select("doc_id", "gold", "branch")


@query(f"""WITH {_RUNS}, g AS (SELECT *, lower(trim(fired)) IN ('true', '1', '1.0', 'yes') AS fell FROM runs WHERE gold IS NOT NULL),
d AS (SELECT 'overall' AS dim, 'all' AS key, * FROM g UNION ALL SELECT 'category', coalesce(nullif(category, ''), 'unknown'), * FROM g UNION ALL SELECT 'branch', coalesce(branch, 'fallback'), * FROM g
  UNION ALL SELECT 'flag', f, g.* FROM g, unnest(CASE WHEN flag_text = '' THEN [] ELSE string_split(flag_text, '|') END) u(f))
SELECT dim, key, count(*) AS total, CAST(sum(correct) AS BIGINT) AS correct, count(*) FILTER (pred IS NULL) AS parse_failures, count(*) FILTER (fell) AS fallbacks,
  CASE WHEN dim = 'overall' THEN (SELECT count(*) FROM runs WHERE gold IS NULL) END AS no_gold FROM d GROUP BY 1, 2""")
def run_metrics(spark, sf_dir):
    flags = F.when(F.col("flag_text") == "", F.array().cast("array<string>")).otherwise(F.split("flag_text", "[|]"))
    return reports.metrics(_runs(spark, sf_dir).withColumns({"flags": flags, "used_fallback": reports.truthy(F.col("fired"))}))


@query(f"""WITH {_RUNS} SELECT CASE WHEN grouping(subset) = 1 THEN 'OVERALL' ELSE coalesce(subset, 'unknown') END AS subset, CASE WHEN grouping(category) = 1 THEN 'OVERALL' ELSE coalesce(category, 'unknown') END AS category,
  count(*) AS n, round(avg(correct), 6) AS accuracy FROM runs GROUP BY ROLLUP (subset, category)""")
def accuracy_rollup(spark, sf_dir):
    return reports.accuracy_rollup(_runs(spark, sf_dir), "subset", "category")


@query(f"WITH {_RUNS} SELECT category, count(*) AS n, round(avg(CASE WHEN branch IS DISTINCT FROM branch_t THEN 1.0 ELSE 0.0 END), 6) AS rate FROM runs GROUP BY 1")
def router_disagreement(spark, sf_dir):
    return reports.router_disagreement(_runs(spark, sf_dir), "category", "branch", "branch_t")


@query(f"WITH {_RUNS} SELECT branch, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, branch NULLS LAST) AS INTEGER) AS place FROM runs GROUP BY 1")
def value_counts(spark, sf_dir):
    return reports.value_counts(_runs(spark, sf_dir), "branch")


@query(f"""WITH {_RUNS} SELECT CASE WHEN grouping(schema) = 0 THEN 'schema' WHEN grouping(subtype) = 0 THEN 'branch_subtype' ELSE 'branch' END AS level, branch, subtype, schema, count(*) AS n
FROM runs GROUP BY GROUPING SETS ((branch), (branch, subtype), (schema))""")
def routing_audit(spark, sf_dir):
    return reports.routing_audit(_runs(spark, sf_dir))


def _uniform_sql(seed: str, *names: str) -> str:
    return f"((CAST(('0x' || substr(md5('{seed}:' || {" || ':' || ".join(names)}), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def _binomial_sql(source: str, name: str, n: str, p: str, seed: str) -> str:
    """CTEs that end in ``{name}``: the rows of ``source`` (with ``rep``) and ``k``, a binomial draw by the rules of the operator."""
    tail = lambda x: f"CASE WHEN {x} <= 9 THEN ([{', '.join(map(repr, resampling.STIRLING))}])[CAST(least({x}, 9) AS INTEGER) + 1] ELSE (1 / 12.0 - (1 / 360.0 - 1 / 1260.0 / (({x} + 1) * ({x} + 1))) / (({x} + 1) * ({x} + 1))) / ({x} + 1) END"
    u, v, w = (_uniform_sql(seed, "rep", f"'{name}'", *more) for more in (("t", "'u'"), ("t", "'v'"), ()))
    return f"""{name}_q AS (SELECT *, CAST({n} AS DOUBLE) AS nn, CAST({p} AS DOUBLE) AS pp, least(CAST({p} AS DOUBLE), 1 - CAST({p} AS DOUBLE)) AS q FROM {source}),
{name}_s AS (SELECT *, 1.15 + 2.53 * sqrt(nn * q * (1 - q)) AS bb, floor((nn + 1) * q) AS mode, q / (1 - q) AS odds FROM {name}_q WHERE nn > 0 AND pp > 0 AND pp < 1),
{name}_t AS (SELECT *, -0.0873 + 0.0248 * bb + 0.01 * q AS aa, (2.83 + 5.1 / bb) * sqrt(nn * q * (1 - q)) AS alpha, {u} - 0.5 AS u, {v} AS v FROM {name}_s, range({resampling.TRIES}) r(t) WHERE nn * q >= 10),
{name}_c AS (SELECT *, floor((2 * aa / (0.5 - abs(u)) + bb) * u + nn * q + 0.5) AS k FROM {name}_t),
{name}_a AS (SELECT rep, arg_min(k, t) AS k FROM {name}_c WHERE k BETWEEN 0 AND nn AND ((0.5 - abs(u) >= 0.07 AND v <= 0.92 - 4.2 / bb)
  OR ln(v * alpha / (aa / ((0.5 - abs(u)) * (0.5 - abs(u))) + bb)) <= (mode + 0.5) * ln((mode + 1) / (odds * (nn - mode + 1))) + (nn + 1) * ln((nn - mode + 1) / (nn - k + 1)) + (k + 0.5) * ln(odds * (nn - k + 1) / (k + 1))
    + {tail("mode")} + {tail("(nn - mode)")} - {tail("k")} - {tail("(nn - k)")}) GROUP BY rep),
{name}_d AS (SELECT DISTINCT nn, q FROM {name}_s WHERE nn * q < 10),
{name}_i AS (SELECT nn, q, x.k, sum(exp(lgamma(nn + 1) - lgamma(x.k + 1) - lgamma(nn - x.k + 1) + x.k * ln(q) + (nn - x.k) * ln(1 - q))) OVER (PARTITION BY nn, q ORDER BY x.k) AS reached FROM {name}_d, range(111) x(k) WHERE x.k <= nn),
{name}_l AS (SELECT rep, min(i.k) AS k FROM {name}_s s JOIN {name}_i i ON s.nn = i.nn AND s.q = i.q WHERE reached >= {w} GROUP BY rep),
{name} AS (SELECT s.* EXCLUDE (nn, pp, q), CASE WHEN nn <= 0 OR pp <= 0 THEN 0 WHEN pp >= 1 THEN nn WHEN pp > 0.5 THEN nn - coalesce(a.k, l.k) ELSE coalesce(a.k, l.k) END AS {name}_k FROM {name}_q s LEFT JOIN {name}_a a USING (rep) LEFT JOIN {name}_l l USING (rep))"""


def _paired_sql(seed: str, reps: int = 10_000) -> str:
    return f"""counts AS (SELECT count(*) FILTER (correct IS NOT NULL AND correct_t IS NOT NULL) AS n, count(*) FILTER (correct = 1 AND correct_t = 0) AS b, count(*) FILTER (correct = 0 AND correct_t = 1) AS c FROM runs),
reps AS (SELECT counts.*, rep FROM counts, range({reps}) r(rep) WHERE n > 0), {_binomial_sql("reps", "b", "n", "b / n", seed)},
{_binomial_sql("b", "c", "n - b_k", "CASE WHEN n - b > 0 THEN c / (n - b) ELSE 0 END", seed)}, boot AS (SELECT (c_k - b_k) / n AS delta FROM c)"""


_ENDS = "round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high, round(avg(delta), 6) AS mean"


@query(f"WITH {_RUNS}, {_paired_sql('pair')} SELECT {_ENDS} FROM boot")
def paired_bootstrap(spark, sf_dir):
    return resampling.paired_bootstrap(_runs(spark, sf_dir))


@query(f"""WITH {_RUNS}, counts AS (SELECT count(correct_t) AS n, count(*) FILTER (correct_t = 1) AS hits FROM runs), reps AS (SELECT counts.*, rep FROM counts, range(10000) r(rep) WHERE n > 0),
{_binomial_sql("reps", "k", "n", "hits / n", "one")}, boot AS (SELECT k_k / n AS delta FROM k) SELECT {_ENDS} FROM boot""")
def single_bootstrap(spark, sf_dir):
    return resampling.single_bootstrap(_runs(spark, sf_dir), "correct_t")


@query(f"""WITH {_RUNS}, counts AS (SELECT count(*) FILTER (correct IS NOT NULL AND correct_t IS NOT NULL) AS n, count(*) FILTER (correct = 1 AND correct_t = 0) AS b, count(*) FILTER (correct = 0 AND correct_t = 1) AS c FROM runs),
reps AS (SELECT counts.*, rep FROM counts, range(5000) r(rep) WHERE n > 0), {_binomial_sql("reps", "s", "b + c", "0.5", "flip")}
SELECT round(any_value((c - b) / n), 6) AS observed, round((count(*) FILTER (abs(2 * s_k - b - c) >= abs(c - b)) + 1) / 5001, 6) AS p FROM s""")
def paired_permutation(spark, sf_dir):
    return resampling.paired_permutation(_runs(spark, sf_dir))


@query(f"""WITH {_RUNS}, {_paired_sql('verdict')}, ends AS (SELECT quantile_cont(delta, 0.025) AS low FROM boot),
a AS (SELECT count(*) AS n, avg(correct_t - correct) AS delta, count(*) FILTER (looked) AS looks, count(*) FILTER (looked_t) AS looks_t, avg(CASE WHEN branch IS DISTINCT FROM branch_t THEN 1.0 ELSE 0.0 END) AS drift FROM runs),
h AS (SELECT quantile_cont(delta, 0.975) AS high FROM boot),
p AS (SELECT branch, avg(correct_t - correct) AS d, count(*) FILTER (correct = 1 AND correct_t = 0) AS b, count(*) FILTER (correct = 0 AND correct_t = 1) AS c FROM runs GROUP BY 1),
w AS (SELECT count(*) FILTER (d < 0 AND CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM range(least(b, c) + 1) r(i))) END < 0.05) AS regressions FROM p)
SELECT n, round(delta, 6) AS delta, looks, looks_t, round(drift, 6) AS drift, round(low, 6) AS low, round(high, 6) AS high, regressions, low >= -0.005 AND looks_t < looks AS h1, regressions = 0 AS h2 FROM a, ends, h, w""")
def gate_verdict(spark, sf_dir):
    return reports.gate_verdict(_runs(spark, sf_dir))


@query(f"""WITH {_RUNS}, l AS (SELECT *, {_NORM.format("look_s")} AS ls, {_NORM.format("look_p")} AS lp, {_NORM.format("math")} AS m, {_NORM.format("gold")} AS g, {_NORM.format("pred")} AS p FROM runs),
w AS (SELECT *, ls <> '' AND m <> '' AND ls <> m AND g <> '' AND ls <> g AS ws, lp <> '' AND m <> '' AND lp <> m AND g <> '' AND lp <> g AS wp FROM l)
SELECT branch, count(*) AS n, round(avg(correct_t - correct), 6) AS net_s, count(*) FILTER (ws) AS wrong_s, round(count(*) FILTER (ws AND p = ls) / nullif(count(*) FILTER (ws), 0), 6) AS sycophancy_s,
  round(avg(correct_p - correct), 6) AS net_p, count(*) FILTER (wp) AS wrong_p, round(count(*) FILTER (wp AND p = lp) / nullif(count(*) FILTER (wp), 0), 6) AS sycophancy_p FROM w GROUP BY 1""")
def net_value(spark, sf_dir):
    r = _runs(spark, sf_dir)
    rows = r.select("branch", F.col("correct").alias("correct_off"), F.col("correct_t").alias("correct_s"), "correct_p", "look_s", "look_p", F.col("pred").alias("pred_s"), F.col("pred").alias("pred_p"), "math", "gold")
    return reports.net_value(rows, "branch")


@query(f"""WITH {_RUNS}, c AS (SELECT *, CASE WHEN quantity IS NULL THEN 'none' WHEN quantity = 'period' THEN 'method_sensitive' WHEN quantity = 'slope' THEN 'regression' ELSE 'closed_form' END AS quantity_class,
  trim(coalesce(predicted_value, '')) = '' AS gone FROM runs WHERE schema = 'numerical')
SELECT quantity_class, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(rel_acc), 6) AS rel_acc, round(avg(CASE WHEN gone THEN 1.0 ELSE 0.0 END), 6) AS abstain_rate,
  round(avg(correct) FILTER (NOT gone), 6) AS accuracy_attempted FROM c GROUP BY 1""")
def numeric_audit(spark, sf_dir):
    return reports.numeric_audit(_runs(spark, sf_dir))


@query(f"""WITH {_RUNS}, t AS (SELECT schema, CASE WHEN contains(lower(qa_type), 'numerical') THEN 'numerical' WHEN contains(lower(qa_type), 'choice') THEN 'mcq' END AS kind FROM runs)
SELECT count(*) AS n, round(avg(CASE WHEN schema = kind THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM t WHERE kind IS NOT NULL""")
def schema_agreement(spark, sf_dir):
    return reports.schema_agreement(_runs(spark, sf_dir))


@query(f"""WITH {_RUNS}, e AS (SELECT *, executed LIKE '["%' AS ran FROM runs)
SELECT count(*) AS n, count(quality_score) AS scored, count(*) FILTER (quality_score < 0.55) AS gated, count(*) FILTER (lower(fired) IN ('true', '1', '1.0', 'yes')) AS fired, count(*) FILTER (ran) AS executed,
  count(*) FILTER (ran AND correct = 0 AND correct_t = 1) AS corrected, count(*) FILTER (ran AND correct = 1 AND correct_t = 0) AS broken FROM e""")
def agency_counts(spark, sf_dir):
    return reports.agency(_runs(spark, sf_dir))


@query(f"""WITH {_RUNS} SELECT a AS action, count(*) AS n FROM runs, unnest(CASE WHEN json_valid(executed) THEN CAST(CAST(executed AS JSON) AS VARCHAR[]) END) u(a) GROUP BY 1""")
def action_counts(spark, sf_dir):
    return reports.actions(_runs(spark, sf_dir))


@query(f"""WITH {_RUNS}, own AS (SELECT category, avg(correct) AS accuracy FROM runs GROUP BY 1), base(name, category, baseline) AS (VALUES ('first', 'en', 0.5), ('first', 'de', 0.6), ('second', 'en', 0.7)),
names AS (SELECT DISTINCT name FROM base)
SELECT name, category, round(accuracy, 6) AS accuracy, baseline, round(accuracy - baseline, 6) AS delta FROM own CROSS JOIN names LEFT JOIN base USING (name, category)""")
def delta_matrix(spark, sf_dir):
    base = spark.createDataFrame([("first", "en", 0.5), ("first", "de", 0.6), ("second", "en", 0.7)], "name string, category string, accuracy double")
    return reports.delta_matrix(_runs(spark, sf_dir), base)


@query(f"""WITH {_RUNS} SELECT a.doc_id, a.correct, b.correct_t, c.correct_p FROM runs a JOIN runs b USING (doc_id) JOIN runs c USING (doc_id) WHERE a.doc_id % 2 = 0 AND b.doc_id % 3 = 0 AND c.doc_id % 5 <> 0""")
def three_arms(spark, sf_dir):
    """Documents that three runs have; each run answered some."""
    r = _runs(spark, sf_dir)
    arm = lambda c, which: r.filter(which).select("doc_id", c)
    return reports.three_arms(arm("correct", "doc_id % 2 = 0"), arm("correct_t", "doc_id % 3 = 0"), arm("correct_p", "doc_id % 5 <> 0"), "doc_id")


@query(f"""WITH {_RUNS} SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN d.lang END, r.category) AS category, r.gold FROM documents d LEFT JOIN runs r ON r.doc_id = d.doc_id AND r.subset = d.source""")
def enriched_rows(spark, sf_dir):
    """Documents with half of their languages missing and no gold, filled from the run by source and id."""
    d = series.table(spark, sf_dir, "documents").selectExpr("doc_id", "source AS subset", "CASE WHEN doc_id % 2 = 0 THEN lang END AS category", "CAST(NULL AS STRING) AS gold")
    return reports.enriched(d, _runs(spark, sf_dir), ["doc_id", "subset"], ["category", "gold"]).select("doc_id", "category", "gold")


@query("""SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('sample:' || doc_id), doc_id) <= 20""")
def stratified_sample(spark, sf_dir):
    return reports.stratified_sample(series.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 20)


@query(f"""WITH {_PTS}, f AS (SELECT series_id, regr_slope(value, pos) AS s, regr_intercept(value, pos) AS i, regr_r2(value, pos) AS r, count(*) AS n FROM pts WHERE pos % 5 <> 2 GROUP BY 1)
SELECT series_id, round(s, 6) AS slope, round(i, 6) AS intercept, round(r, 6) AS r_squared, CASE WHEN abs(s) < 1e-10 THEN 'stationary' WHEN s > 0 THEN 'upward' ELSE 'downward' END AS direction, 'ok' AS status FROM f""")
def linear_trend(spark, sf_dir):
    """Every fifth value is a NaN, whose place stays."""
    pts = series.user_values(spark, sf_dir).withColumn("value", F.when(F.col("pos") % 5 == 2, float("nan")).otherwise(F.col("value")))
    return trend.linear_trend(pts)


@query(f"""WITH {_PTS}, near AS (SELECT *, lag(value) OVER s AS a, lead(value) OVER s AS b FROM pts WINDOW s AS (PARTITION BY series_id ORDER BY pos)),
t AS (SELECT series_id, pos FROM near WHERE value < a AND value < b), p AS (SELECT series_id, pos FROM near WHERE value > a AND value > b),
x AS (SELECT p.series_id, p.pos, p.pos - t.pos AS rise FROM p ASOF JOIN t ON p.series_id = t.series_id AND p.pos > t.pos),
y AS (SELECT x.*, t.pos - x.pos AS fall FROM x ASOF JOIN t ON x.series_id = t.series_id AND x.pos < t.pos)
SELECT series_id, pos, rise, fall FROM y""")
def peak_flanks(spark, sf_dir):
    return stats.peak_flanks(series.user_values(spark, sf_dir))


@query(f"""WITH {_PTS}, near AS (SELECT *, lag(value) OVER s AS a, lead(value) OVER s AS b FROM pts WINDOW s AS (PARTITION BY series_id ORDER BY pos)),
t AS (SELECT series_id, pos FROM near WHERE value < a AND value < b), p AS (SELECT series_id, pos FROM near WHERE value > a AND value > b),
x AS (SELECT p.series_id, p.pos, p.pos - t.pos AS rise FROM p ASOF JOIN t ON p.series_id = t.series_id AND p.pos > t.pos),
y AS (SELECT x.*, t.pos - x.pos AS fall FROM x ASOF JOIN t ON x.series_id = t.series_id AND x.pos < t.pos), s AS (SELECT series_id, avg(rise) / avg(fall) AS ratio, count(*) AS peaks FROM y GROUP BY 1)
SELECT series_id, round(coalesce(ratio, 1.0), 6) AS ratio, CAST(coalesce(peaks, 0) AS BIGINT) AS peaks FROM (SELECT DISTINCT series_id FROM pts) LEFT JOIN s USING (series_id)""")
def rise_fall_ratio(spark, sf_dir):
    return stats.rise_fall_ratio(series.user_values(spark, sf_dir))


@query(f"""WITH {_PTS}, centred AS (SELECT series_id, pos, value - avg(value) OVER w AS v, count(*) OVER w AS n FROM pts WINDOW w AS (PARTITION BY series_id)),
bins AS (SELECT series_id, n, unnest(range(1, n // 2 + 1)) AS bin, pos, v FROM centred),
mags AS (SELECT series_id, n, bin, sqrt(pow(sum(v * cos(2 * pi() * ((bin * pos) % n) / n)), 2) + pow(sum(v * sin(2 * pi() * ((bin * pos) % n) / n)), 2)) AS m FROM bins GROUP BY ALL)
SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY round(m, 9) DESC, bin) AS INTEGER) AS place, bin, round(bin / n, 6) AS frequency, round(n / bin, 6) AS period, round(m, 6) AS magnitude
FROM mags QUALIFY place <= 3""")
def strongest_bins(spark, sf_dir):
    return spectral.strongest_bins(series.user_values(spark, sf_dir), detrend=False)


@query(f"""WITH {_PTS}, c AS (SELECT series_id, pos, value - avg(value) OVER w AS v, count(*) OVER w AS n FROM pts WINDOW w AS (PARTITION BY series_id)),
s AS (SELECT series_id, pos + 1 AS spot, n, sum(v) OVER (PARTITION BY series_id ORDER BY pos) AS s, sum(v) OVER (PARTITION BY series_id) AS t FROM c),
one AS (SELECT series_id, spot, n FROM s WHERE spot < n AND n >= 4 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(s * s / spot + (t - s) * (t - s) / (n - spot) - t * t / n, 9) DESC, spot) = 1),
seg AS (SELECT p.series_id, p.pos, p.value, CASE WHEN p.pos >= o.spot THEN o.spot ELSE 0 END AS start, o.spot AS first, o.n AS total FROM pts p JOIN one o USING (series_id)),
c2 AS (SELECT series_id, start, first, total, pos, value - avg(value) OVER w AS v, count(*) OVER w AS m FROM seg WINDOW w AS (PARTITION BY series_id, start)),
s2 AS (SELECT series_id, start, first, total, m, pos + 1 - start AS spot, sum(v) OVER (PARTITION BY series_id, start ORDER BY pos) AS s, sum(v) OVER (PARTITION BY series_id, start) AS t FROM c2),
two AS (SELECT series_id, first, total, start + spot AS second FROM s2 WHERE m >= 4 AND spot < m
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(s * s / spot + (t - s) * (t - s) / (m - spot) - t * t / m, 9) DESC, start, spot) = 1)
SELECT series_id, least(first, second) || ',' || greatest(first, second) || ',' || total AS breaks FROM two""")
def binary_segmentation(spark, sf_dir):
    return trend.binary_segmentation(series.user_values(spark, sf_dir), 2).withColumn("breaks", F.array_join("breaks", ","))


@query(f"""WITH {_PTS}, c AS (SELECT series_id, pos, value - avg(value) OVER w AS v, count(*) OVER w AS n FROM pts WINDOW w AS (PARTITION BY series_id)), total AS (SELECT series_id, sum(v * v) AS t FROM c GROUP BY 1),
acf AS (SELECT a.series_id, b.pos - a.pos AS lag, any_value(a.n) AS n, sum(a.v * b.v) / any_value(t) AS r FROM c a JOIN c b ON a.series_id = b.series_id AND b.pos - a.pos BETWEEN 1 AND 20 JOIN total t ON t.series_id = a.series_id GROUP BY 1, 2),
q AS (SELECT series_id, lag, n * (n + 2) * sum(r * r / (n - lag)) OVER (PARTITION BY series_id ORDER BY lag) AS q FROM acf WHERE lag <= n // 2 - 1)
SELECT series_id, lag, round(q, 6) AS q, round(exp(-q / 2) * list_sum(list_transform(range(lag // 2), lambda k: pow(q / 2, k) / gamma(k + 1))), 6) AS p FROM q WHERE lag % 2 = 0""")
def ljung_box_p(spark, sf_dir):
    return spectral.ljung_box_p(series.user_values(spark, sf_dir))


@query()
def pacf_lags(spark, sf_dir):
    """Partial autocorrelations (tested against the Yule-Walker equations)."""
    return spectral.partial_autocorrelation(series.user_values(spark, sf_dir))


# Replies in every state; B stands for a branch. Picked by a row's number.
_REPLIES = (
    '{"action": "B", "reason": " because ", "branch": "B"}', 'Here: ```json\n{"action": " Vision", "reason": "look", "branch": "noise"}\n``` done', 'so {"action": "B", "reason": "  "} it is',
    '{"action": "guess", "reason": "x", "branch": "zzz"}', "Take the B branch, not noise", '{"branch": "B"', '{"pattern_type": "wave", "confidence": 0.7, "summary": " rising ", "anomaly_regions": ["a", "b"]}', "", '{"action": "numeric_head"}',
)


def _reply_sql() -> str:
    return f"replace({_pick_sql(_REPLIES, '(conv_id * 3 + turn) % 9')}, 'B', {_pick_sql(_BRANCH_OF, 'conv_id % 8')})"


_INSIDE = """CASE WHEN regexp_extract(trim(raw), '(?is)```(?:json)?\\s*(.*?)\\s*```', 1) <> '' THEN regexp_extract(trim(raw), '(?is)```(?:json)?\\s*(.*?)\\s*```', 1)
  WHEN regexp_extract(trim(raw), '(?s)\\{.*\\}') <> '' THEN regexp_extract(trim(raw), '(?s)\\{.*\\}') ELSE trim(raw) END"""


@query(f"""WITH r AS (SELECT conv_id, turn, {_reply_sql()} AS raw FROM conversations), i AS (SELECT *, {_INSIDE} AS inside FROM r), j AS (SELECT *, CASE WHEN json_valid(inside) THEN inside END AS j FROM i),
a AS (SELECT *, trim(lower(json_extract_string(j, '$.action'))) AS action, trim(json_extract_string(j, '$.reason')) AS reason, trim(lower(json_extract_string(j, '$.branch'))) AS branch FROM j)
SELECT conv_id, turn, CASE WHEN action IN ({", ".join(repr(x) for x in replies.ACTIONS)}) AND reason <> '' THEN action END AS action,
  CASE WHEN action IN ({", ".join(repr(x) for x in replies.ACTIONS)}) AND reason <> '' THEN reason END AS reason,
  CASE WHEN branch IN ('trend', 'noise') THEN branch WHEN contains(lower(raw), 'trend') THEN 'trend' WHEN contains(lower(raw), 'noise') THEN 'noise' END AS chosen FROM a""")
def reply_choices(spark, sf_dir):
    """Proposed actions, and the critic's choice between two branches."""
    rows = series.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_reply_sql().replace("\n", "\\n")).alias("raw"))
    said = rows.withColumns({"p": replies.proposal(F.col("raw")), "chosen": replies.critic_choice(F.col("raw"), F.array(F.lit("trend"), F.lit("noise")))})
    return said.select("conv_id", "turn", "p.action", "p.reason", "chosen")


@query(f"""WITH r AS (SELECT conv_id, turn, {_reply_sql()} AS raw FROM conversations), i AS (SELECT *, regexp_extract(regexp_replace(raw, '```[A-Za-z]*|```', '', 'g'), '(?s)\\{{.*\\}}') AS inside FROM r),
j AS (SELECT *, CASE WHEN inside <> '' AND json_valid(inside) THEN inside END AS j FROM i)
SELECT conv_id, turn, json_extract_string(j, '$.pattern_type') AS pattern_type, coalesce(CAST(json_extract_string(j, '$.confidence') AS DOUBLE), 0) AS confidence,
  CASE WHEN j IS NULL THEN trim(raw) ELSE trim(json_extract_string(j, '$.summary')) END AS summary, CAST(coalesce(json_array_length(j, '$.anomaly_regions'), 0) AS INTEGER) AS regions, j IS NOT NULL AS parsed FROM j""")
def look_replies(spark, sf_dir):
    rows = series.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_reply_sql().replace("\n", "\\n")).alias("raw"))
    said = rows.withColumn("l", replies.look(F.col("raw")))
    return said.select("conv_id", "turn", "l.pattern_type", "l.confidence", "l.summary", F.size("l.anomaly_regions").alias("regions"), "l.parsed")


@query(f"""WITH {_RUNS}, o AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS s, branch, looked, fired, doc_id % 2 AS k FROM runs)
SELECT doc_id, CASE WHEN s IS NULL THEN NULL WHEN k = 0 THEN CASE WHEN s THEN 'Stationary ' ELSE 'Non Stationary' END WHEN s THEN 'stationary' ELSE 'non-stationary' END AS label0,
  CASE WHEN s IS NULL THEN 'categorical:no_signal' WHEN k = 0 THEN 'categorical:stationarity:mapped' ELSE 'categorical:stationarity' END AS note,
  CASE WHEN branch = 'noise' THEN false ELSE looked OR coalesce(branch = 'trend', false) OR lower(fired) IN ('true', '1', '1.0', 'yes') END AS triggered,
  CASE WHEN branch = 'noise' OR NOT (looked OR coalesce(branch = 'trend', false) OR lower(fired) IN ('true', '1', '1.0', 'yes')) THEN NULL WHEN branch = 'trend' THEN 'line_plot' WHEN looked THEN 'given'
    WHEN branch IN ('periodicity', 'causality') THEN 'spectrogram' ELSE 'line_plot' END AS viz_type,
  CASE WHEN branch = 'noise' THEN 'suppressed' WHEN lower(fired) IN ('true', '1', '1.0', 'yes') THEN 'proposed' WHEN branch = 'trend' THEN 'forced' ELSE 'gate' END AS why FROM o""")
def labels_and_overrides(spark, sf_dir):
    """Stationarity labels mapped to options, and looks after forced, shut and proposed ones."""
    r = _runs(spark, sf_dir)
    options = F.when(F.col("doc_id") % 2 == 0, F.array(F.when(F.col("doc_id") % 3 == 1, F.lit("up")).otherwise("Non Stationary"), F.lit("Stationary "))).otherwise(F.array().cast("array<string>"))
    s = F.expr("CASE doc_id % 3 WHEN 0 THEN CAST(NULL AS BOOLEAN) WHEN 1 THEN true ELSE false END")
    o = replies.look_override(F.col("looked"), F.lit("given"), F.col("branch"), reports.truthy(F.col("fired")), forced=["trend"], shut=["noise"])
    rows = r.select("doc_id", replies.stationarity_label(s, options).alias("l"), o.alias("o"))
    label = F.when(F.col("l.label") == "Stationary", F.lit("Stationary ")).otherwise(F.col("l.label"))
    return rows.select("doc_id", label.alias("label0"), "l.note", "o.triggered", "o.viz_type", "o.why")


@query(f"""WITH {_RUNS}, s AS (SELECT doc_id, branch, quality_score AS score FROM runs WHERE branch IS NOT NULL AND quality_score IS NOT NULL UNION ALL
  SELECT doc_id, 'noise', (doc_id % 7) / 6.0 FROM runs WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 'anomaly', (doc_id % 5) / 5.0 FROM runs),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, branch) AS place FROM s)
SELECT doc_id, max(branch) FILTER (place = 1) AS branch, round(max(score) FILTER (place = 1), 6) AS score, max(branch) FILTER (place = 2) AS second,
  coalesce(round(max(score) FILTER (place = 1) - max(score) FILTER (place = 2), 9) < 0.1 OR max(score) FILTER (place = 1) < 0.55, false) AS asks_critic FROM k GROUP BY 1""")
def arbitration(spark, sf_dir):
    r = _runs(spark, sf_dir)
    own = r.filter("branch IS NOT NULL AND quality_score IS NOT NULL").select("doc_id", "branch", F.col("quality_score").alias("score"))
    noise = r.filter("doc_id % 4 <> 0").select("doc_id", F.lit("noise").alias("branch"), F.expr("CAST(doc_id % 7 AS DOUBLE) / 6").alias("score"))
    anomaly_ = r.select("doc_id", F.lit("anomaly").alias("branch"), F.expr("CAST(doc_id % 5 AS DOUBLE) / 5").alias("score"))
    return replies.arbitrated(own.union(noise).union(anomaly_), "doc_id")


@query(f"""WITH {_RUNS} SELECT doc_id, sha256('{{"answer":' || coalesce('"' || pred || '"', 'null') || ',"branch":' || coalesce('"' || branch || '"', 'null') || ',"score":' || coalesce(CAST(CAST(round(quality_score, 6) AS DECIMAL(38, 6)) AS VARCHAR), 'null') || '}}') AS trace FROM runs""")
def trace_hashes(spark, sf_dir):
    r = _runs(spark, sf_dir)
    fields = {"branch": F.col("branch"), "answer": F.col("pred"), "score": F.col("quality_score"), "timestamp": F.current_timestamp()}
    return r.select("doc_id", replies.trace_hash(fields, ["score"]).alias("trace"))


def _chunk_sql(k: int, source: str = "pts") -> str:
    return f"""sized AS (SELECT *, count(*) OVER (PARTITION BY series_id) // {k} AS size FROM {source}),
chunks AS (SELECT series_id, CAST(least(pos // size, {k - 1}) AS INTEGER) AS chunk, pos - least(pos // size, {k - 1}) * size AS pos, value FROM sized)"""


@query(f"""WITH {_PTS}, {_chunk_sql(4)}, f AS (SELECT series_id, chunk, regr_slope(value, pos) AS slope, regr_r2(value, pos) AS r2, stddev_pop(value) AS std,
  CASE WHEN min(value) > 0 THEN regr_r2(ln(greatest(value, 1e-300)), pos) END AS exp_r2, regr_r2(value, ln(pos + 1)) AS log_r2 FROM chunks GROUP BY 1, 2)
SELECT series_id, chunk, round(slope, 6) AS slope, CASE WHEN abs(slope) < 1e-4 * std THEN 'flat' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, round(r2, 6) AS r2,
  CASE WHEN r2 >= coalesce(exp_r2, -1) AND r2 >= log_r2 THEN 'linear' WHEN coalesce(exp_r2, -1) >= log_r2 THEN 'exponential' ELSE 'log' END AS best_fit FROM f""")
def local_trends(spark, sf_dir):
    return local.trends(series.user_values(spark, sf_dir))


@query(f"""WITH {_PTS}, {_chunk_sql(4)}, q AS (SELECT series_id, chunk, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, avg(value) AS m, stddev_pop(value) AS sd, max(value) AS hi, min(value) AS lo FROM chunks GROUP BY 1, 2)
SELECT series_id, chunk, count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers,
  coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)), '') AS positions,
  round(any_value(CASE WHEN sd > 0 THEN greatest(hi - m, m - lo) / sd ELSE 0 END), 6) AS max_deviation FROM chunks JOIN q USING (series_id, chunk) GROUP BY 1, 2""")
def local_outliers(spark, sf_dir):
    return local.outliers(series.user_values(spark, sf_dir)).withColumn("positions", F.array_join("positions", ","))


@query(f"WITH {_PTS}, {_chunk_sql(3)} SELECT series_id, chunk, round(var_pop(value), 6) AS variance FROM chunks GROUP BY 1, 2")
def local_variances(spark, sf_dir):
    return local.variances(series.user_values(spark, sf_dir))


@query(f"""WITH {_PTS}, {_chunk_sql(2)} SELECT series_id, chunk, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
  round(max(value) - min(value), 6) AS range, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM chunks GROUP BY 1, 2""")
def local_amplitudes(spark, sf_dir):
    return local.amplitudes(series.user_values(spark, sf_dir))


@query(f"""WITH {_PTS}, {_chunk_sql(2)}, lines AS (SELECT series_id, chunk, regr_slope(value, pos) AS s, regr_intercept(value, pos) AS i, count(*) AS n FROM chunks GROUP BY 1, 2),
bins AS (SELECT c.series_id, c.chunk, n, unnest(range(1, greatest(n // 2, 1) + 1)) AS bin, pos, value - s * pos - i AS v FROM chunks c JOIN lines l ON l.series_id = c.series_id AND l.chunk = c.chunk),
mags AS (SELECT series_id, chunk, n, bin, sqrt(pow(sum(v * cos(2 * pi() * ((bin * pos) % n) / n)), 2) + pow(sum(v * sin(2 * pi() * ((bin * pos) % n) / n)), 2)) AS m FROM bins GROUP BY ALL)
SELECT series_id, chunk, round(any_value(n) / arg_max(bin, m), 6) AS period, round(arg_max(bin, m) / any_value(n), 6) AS frequency FROM mags GROUP BY 1, 2""")
def local_periods(spark, sf_dir):
    return local.periods(series.user_values(spark, sf_dir))


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.to_arrays(series.user_values(spark, sf_dir))


def _array_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda p: p[c])
    return _pairs(spark, sf_dir).groupBy("pair_id").agg(pack("a").alias("a"), pack("b").alias("b"))


@query()
def adf_kpss(spark, sf_dir):
    return kernels.series_kernels(_arrays(spark, sf_dir), ["stationarity"])


@query()
def pacf(spark, sf_dir):
    return kernels.series_kernels(_arrays(spark, sf_dir), ["pacf", "ljung_box"])


@query()
def arch_lm(spark, sf_dir):
    return kernels.series_kernels(_arrays(spark, sf_dir), ["arch_lm"])


@query()
def pelt(spark, sf_dir):
    return kernels.series_kernels(_arrays(spark, sf_dir), ["change_points"])


@query()
def stl(spark, sf_dir):
    return kernels.series_kernels(_arrays(spark, sf_dir), ["seasonal"])


@query()
def decomp_type(spark, sf_dir):
    return kernels.series_kernels(_arrays(spark, sf_dir), ["decomposition_type"])


@query()
def hilbert(spark, sf_dir):
    return kernels.series_kernels(_arrays(spark, sf_dir), ["hilbert_envelope"])


@query()
def shape_features(spark, sf_dir):
    return kernels.series_kernels(_arrays(spark, sf_dir), ["shape_features"])


@query()
def cwt(spark, sf_dir):
    return kernels.scalograms(_arrays(spark, sf_dir))


@query()
def jigsaw_perm(spark, sf_dir):
    return kernels.jigsaw_orders(_arrays(spark, sf_dir))


@query()
def dtw(spark, sf_dir):
    return kernels.pair_kernels(_array_pairs(spark, sf_dir), ["warping"])


@query()
def granger(spark, sf_dir):
    return kernels.pair_kernels(_array_pairs(spark, sf_dir), ["causality"])


@query()
def branch_trend(spark, sf_dir):
    return branches.trend_branch(series.user_values(spark, sf_dir))


@query()
def branch_periodicity(spark, sf_dir):
    return branches.periodicity_branch(series.user_values(spark, sf_dir))


@query()
def branch_anomaly(spark, sf_dir):
    return branches.anomaly_branch(series.user_values(spark, sf_dir))


@query()
def branch_noise(spark, sf_dir):
    return branches.noise_branch(series.user_values(spark, sf_dir))


@query()
def branch_similarity(spark, sf_dir):
    return branches.similarity_branch(_pairs(spark, sf_dir), _array_pairs(spark, sf_dir))


@query()
def branch_causality(spark, sf_dir):
    return branches.causality_branch(_pairs(spark, sf_dir), _array_pairs(spark, sf_dir))


# ---- loops over evidence: the branches are run on users' series, routes and proposals are dealt by a number.
_LOOP_REPLIES = (
    '{"branch": "trend", "scope": "global"}', 'no JSON', '{"branch": "anomaly", "scope": "local"}', '{"branch": "similarity"}', '{"branch": "periodicity"}', '{"branch": "noise"}', '{"branch": "causality"}',
)
_LOOP_ACTIONS = (
    '{"action": "trend", "reason": "r"}', '{"action": "vision", "reason": "look"}', 'no JSON', '{"action": "numeric_head", "reason": "exact"}', '{"action": "noise", "reason": "test"}',
    '{"action": "periodicity", "reason": "r"}', '{"action": "anomaly", "reason": ""}', '{"action": "causality", "reason": "lag"}', '{"action": "similarity", "reason": "r"}',
)
_LOOP_BRANCHES = ("trend", "periodicity", "anomaly", "noise", "similarity", "causality")
_ENABLED, _LOOPING, _TRIGGERS = ("trend", "anomaly", "noise", "similarity", "causality"), ("trend", "noise", "causality", "anomaly"), ("low_r2", "evidence_incomplete", "weak_correlation")


def _loop_runner(spark, sf_dir):
    """A runner of branches over users' series: a fit for trend and causality, deviations for anomaly, nothing for noise, no answer for similarity."""
    points = series.user_values(spark, sf_dir)
    fit = points.groupBy("series_id").agg(
        guards.r_squared(F.col("value"), F.col("pos")).alias("r2"), guards.slope(F.col("value"), F.col("pos")).alias("slope"), guards.correlation(F.col("pos"), F.col("value")).alias("corr"), F.count("*").alias("n")
    )
    fit = fit.filter("n >= 3").select(F.col("series_id").alias("question_id"), "r2", "slope", "corr")

    def run(asked):
        on = asked.filter("branch != 'similarity'").join(fit, "question_id")
        is_ = lambda b: F.col("branch") == b
        flag = (
            F.when(is_("trend") & (F.col("r2") < 0.65), "low_r2").when(is_("noise"), "evidence_incomplete").when(is_("causality") & (F.abs("corr") < 0.2), "weak_correlation")
            .when(is_("periodicity") & (F.col("question_id") % 2 == 1), "fft_unreliable")
        )
        has = lambda *pairs: F.create_map(*[x for k, v in pairs for x in (F.lit(k), v.cast("string"))])
        evidence = (
            F.when(is_("trend"), has(("slope", F.col("slope")), ("direction", F.lit("up")), ("r2", F.col("r2")))).when(is_("anomaly"), has(("outlier_count", F.lit(0)), ("max_deviation", F.col("slope"))))
            .when(is_("causality"), has(("best_corr", F.col("corr")))).otherwise(F.create_map().cast("map<string,string>"))
        )
        return on.select("question_id", F.array_compact(F.array(flag)).alias("flags"), evidence.alias("evidence"))

    return fit.select("question_id"), run


def _loop_rows(spark, sf_dir):
    users, run = _loop_runner(spark, sf_dir)
    rows = users.selectExpr("question_id", f"{_pick_sql(_ROUTE_ASKS, 'question_id % 12')} AS question", f"{_pick_sql(_LOOP_BRANCHES, 'CAST(floor(question_id / 3) AS BIGINT) % 6')} AS branch", "'global' AS scope")
    first = rows.join(run(rows.select("question_id", "branch", "scope")), "question_id", "left")
    flags = F.coalesce("flags", F.array(F.lit("branch_error")))
    return first.withColumns({"flags": flags, "evidence": F.coalesce("evidence", F.create_map().cast("map<string,string>"))}), run


_LOOP_SQL = f"""WITH {_PTS}, fit AS (SELECT series_id AS id, CASE WHEN var_pop(value) > 0 THEN regr_r2(value, pos) ELSE 0 END AS r2, corr(pos, value) AS c FROM pts GROUP BY series_id HAVING count(*) >= 3),
ev AS (SELECT id, b AS branch, CASE WHEN b = 'trend' AND r2 < 0.65 THEN ['low_r2'] WHEN b = 'noise' THEN ['evidence_incomplete'] WHEN b = 'causality' AND abs(c) < 0.2 THEN ['weak_correlation']
    WHEN b = 'periodicity' AND id % 2 = 1 THEN ['fft_unreliable'] WHEN b = 'similarity' THEN ['branch_error'] ELSE CAST([] AS VARCHAR[]) END AS flags,
  round(CASE b WHEN 'trend' THEN 0.35 + 0.3 * (1 - CASE WHEN r2 < 0.65 THEN 0.12 ELSE 0 END) + 0.2 * CASE WHEN r2 >= 0.75 THEN 1 WHEN r2 >= 0.5 THEN 0.7 ELSE 0.4 END
    WHEN 'anomaly' THEN 0.35 * 2 / 3 + 0.5 WHEN 'noise' THEN 0.3 * 0.7 + 0.2 WHEN 'periodicity' THEN 0.3 * (1 - CASE WHEN id % 2 = 1 THEN 0.12 ELSE 0 END) + 0.2 WHEN 'similarity' THEN 0.5
    ELSE 0.35 / 5 + 0.3 * (1 - CASE WHEN abs(c) < 0.2 THEN 0.12 ELSE 0 END) + 0.2 * least(1, abs(c) * 2) END, 4) AS score
  FROM fit, (SELECT unnest([{', '.join(f"'{b}'" for b in _LOOP_BRANCHES)}]) AS b)),
rows AS (SELECT id, {_pick_sql(_ROUTE_ASKS, 'id % 12')} AS question, {_pick_sql(_LOOP_BRANCHES, 'CAST(floor(id / 3) AS BIGINT) % 6')} AS branch FROM fit),
s0 AS (SELECT rows.*, flags, score FROM rows JOIN ev USING (id, branch))"""
_in = lambda known: "(" + ", ".join(f"'{x}'" for x in known) + ")"
_ROUTE_TO = f"CASE (id + {{turn}}) % 7 {' '.join(f"WHEN {i} THEN '{b}'" for i, b in ((0, 'trend'), (2, 'anomaly'), (3, 'similarity'), (4, 'periodicity'), (5, 'noise'), (6, 'causality')))} END"


def _reroute_sql(most: int) -> str:
    trigger = f"list_filter(flags, lambda x: x IN {_in(_TRIGGERS)})"
    out = f"""r0 AS (SELECT id, branch, flags, used, used AS onn, 0 AS depth, CASE WHEN used THEN trig END AS trig, CASE WHEN used THEN branch END AS original, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS stopped
  FROM (SELECT *, {trigger} AS trig, branch IN {_in(_LOOPING)} AND len({trigger}) > 0 AS used FROM s0))"""
    for turn in range(most):
        last = "true" if turn + 1 == most else "false"
        out += f""", a{turn} AS (SELECT r.*, {_ROUTE_TO.format(turn=turn)} AS target, (id + {turn}) % 11 = 10 AS lost FROM r{turn} r),
b{turn} AS (SELECT *, CASE WHEN NOT onn THEN NULL WHEN lost THEN 'reroute_exception' WHEN target IS NULL THEN 'reroute_parse_failed' WHEN target <> branch AND target NOT IN {_in(_ENABLED)} THEN 'branch_' || target || '_disabled'
    WHEN target <> branch AND target = 'similarity' THEN 'branch_error' END AS err FROM a{turn}),
c{turn} AS (SELECT b.*, onn AND err IS NULL AND target = b.branch AS same, onn AND err IS NULL AND target <> b.branch AS moved, ev.flags AS nf, list_filter(ev.flags, lambda x: x IN {_in(_TRIGGERS)}) AS nt
  FROM b{turn} b LEFT JOIN ev ON ev.id = b.id AND ev.branch = target),
r{turn + 1} AS (SELECT id, CASE WHEN moved THEN target ELSE branch END AS branch, CASE WHEN moved THEN nf ELSE flags END AS flags, used, moved AND len(nt) > 0 AND NOT {last} AND target IN {_in(_LOOPING)} AS onn,
  CASE WHEN moved THEN {turn + 1} ELSE depth END AS depth, CASE WHEN moved AND len(nt) > 0 THEN nt ELSE trig END AS trig, original, coalesce(error, err) AS error,
  CASE WHEN same THEN 'same_branch_noop' WHEN moved AND len(nt) > 0 AND {last} THEN 'max_depth' ELSE stopped END AS stopped FROM c{turn})"""
    return f"""{_LOOP_SQL}, {out} SELECT id AS question_id, branch, array_to_string(flags, ',') AS flags, used AS loop_used, CAST(depth AS BIGINT) AS loop_depth, array_to_string(trig, ',') AS loop_trigger_flags,
  original AS loop_original_branch, CASE WHEN used THEN branch END AS loop_final_branch, error AS loop_error, stopped AS loop_stopped FROM r{most}"""


@query(_reroute_sql(2))
def loop_reroute(spark, sf_dir):
    """Rows with trigger flags ask for another route twice at most; one reply in eleven is lost."""
    rows, run = _loop_rows(spark, sf_dir)
    reply = f"CASE WHEN (question_id + turn) % 11 <> 10 THEN {_pick_sql(_LOOP_REPLIES, '(question_id + turn) % 7')} END AS reply"
    done = loops.reroute(rows, lambda asked: asked.selectExpr("question_id", reply), run, _ENABLED, _LOOPING, _TRIGGERS, most=2)
    joined = {c: F.array_join(c, ",") for c in ("flags", "loop_trigger_flags")}
    return done.withColumns({**joined, "loop_depth": F.col("loop_depth").cast("long")}).drop("question", "scope", "evidence")


def _refine_sql(most: int, threshold: float) -> str:
    usable = _in([b for b in _LOOPING if b in _ENABLED])
    out = f"""k0 AS (SELECT s.id, s.branch, s.flags, CASE WHEN branch IN {_in(_LOOPING)} THEN score END AS score, CAST([] AS VARCHAR[]) AS used, CASE WHEN branch IN {_in(_LOOPING)} THEN [score] END AS trace,
  string_split({_routes_sql('question', 'branch').replace('[1:3]', f'[1:{most + 1}]')}, ',') AS words FROM s0 s)"""
    for i in range(most + 1):
        out += f""", k{i + 1} AS (SELECT k.id, k.branch, CASE WHEN ask THEN list_concat(k.flags, list_filter(ev.flags, lambda x: NOT list_contains(k.flags, x))) ELSE k.flags END AS flags,
  CASE WHEN ask THEN greatest(k.score, ev.score) ELSE k.score END AS score, CASE WHEN ask THEN list_append(used, words[{i + 1}]) ELSE used END AS used, CASE WHEN ask THEN list_append(trace, greatest(k.score, ev.score)) ELSE trace END AS trace, words
  FROM (SELECT *, coalesce(score < {threshold} AND len(used) < {most - 1} AND words[{i + 1}] IN {usable} AND words[{i + 1}] <> branch, false) AS ask FROM k{i}) k LEFT JOIN ev ON ev.id = k.id AND ev.branch = words[{i + 1}])"""
    return f"""{_LOOP_SQL}, {out} SELECT id AS question_id, branch, array_to_string(flags, ',') AS flags, score AS quality_score, len(used) > 0 AS refine_fired, array_to_string(used, ',') AS refine_branches,
  array_to_string(list_transform(trace, lambda x: CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR)), ',') AS trace FROM k{most + 1}"""


@query(_refine_sql(3, 0.75))
def loop_refine(spark, sf_dir):
    """Rows of weak evidence add that of branches which their question's words name, at most two."""
    rows, run = _loop_rows(spark, sf_dir)
    done = loops.refine(rows, run, _ENABLED, _LOOPING, most=3, threshold=0.75)
    trace = F.array_join(F.transform("refine_quality_trace", lambda x: F.round(x * 10000).cast("long").cast("string")), ",")
    return done.select("question_id", "branch", F.array_join("flags", ",").alias("flags"), "quality_score", "refine_fired", F.array_join("refine_branches", ",").alias("refine_branches"), trace.alias("trace"))


def _propose_sql(most: int, threshold: float) -> str:
    out = f"p0 AS (SELECT id, branch, flags, CASE WHEN branch IN {_in(_LOOPING)} THEN score END AS score, CAST([] AS VARCHAR[]) AS done, CAST([] AS VARCHAR[]) AS fell, branch IN {_in(_LOOPING)} AND score < {threshold} AS onn FROM s0)"
    actions = ((0, "trend"), (1, "vision"), (3, "numeric_head"), (4, "noise"), (5, "periodicity"), (7, "causality"), (8, "similarity"))
    for turn in range(most):
        action = f"CASE (id + {turn} * 5) % 9 {' '.join(f"WHEN {i} THEN '{a}'" for i, a in actions)} END"
        out += f""", q{turn} AS (SELECT *, CASE WHEN NOT onn THEN NULL WHEN (id + {turn}) % 13 = 12 THEN 'proposer_exception' WHEN act IS NULL THEN 'invalid_proposal' WHEN act = branch OR list_contains(done, act) THEN 'already_run:' || act
    WHEN act = 'numeric_head' THEN 'numeric_head_unavailable_on_mcq' WHEN act <> 'vision' AND act NOT IN {_in(_ENABLED)} THEN 'action_disabled:' || act END AS fb FROM (SELECT *, {action} AS act FROM p{turn})),
p{turn + 1} AS (SELECT q.id, q.branch, CASE WHEN onn AND fb IS NULL AND act <> 'vision' THEN list_concat(q.flags, list_filter(ev.flags, lambda x: NOT list_contains(q.flags, x))) ELSE q.flags END AS flags, q.score,
  CASE WHEN onn AND fb IS NULL THEN list_append(done, act) ELSE done END AS done, CASE WHEN fb IS NOT NULL THEN list_append(fell, fb) ELSE fell END AS fell, onn AND fb IS NULL AS onn
  FROM q{turn} q LEFT JOIN ev ON ev.id = q.id AND ev.branch = act)"""
    return f"""{_LOOP_SQL}, {out} SELECT id AS question_id, branch, array_to_string(flags, ',') AS flags, score AS propose_quality_score, len(done) > 0 AS propose_fired, array_to_string(done, ',') AS propose_executed,
  list_contains(done, 'vision') AS propose_force_vision, array_to_string(fell, ',') AS propose_fallbacks FROM p{most}"""


@query(_propose_sql(2, 0.75))
def loop_propose(spark, sf_dir):
    """Rows of weak evidence ask a proposer twice at most; one reply in thirteen is lost."""
    rows, run = _loop_rows(spark, sf_dir)
    reply = f"CASE WHEN (question_id + turn) % 13 <> 12 THEN {_pick_sql(_LOOP_ACTIONS, '(question_id + turn * 5) % 9')} END AS reply"
    done = loops.propose_actions(rows, lambda asked: asked.selectExpr("question_id", reply), run, _ENABLED, _LOOPING, most=2, threshold=0.75)
    return done.withColumns({c: F.array_join(c, ",") for c in ("flags", "propose_executed", "propose_fallbacks")}).drop("question", "scope", "evidence")


# ---- free answers: replies dealt by a row's number, and the table's own texts.
_FREE = (
    "E", "I choose E", "So\n**C**", "b) as it rises", "The answer is D because it falls", "the variance is A", "Option: c", "A bad day", "", "it rises\n(d)", "selected=z", ".5", "3 of 50%", "- 3.14", "−3.14",
    "Minus 3.14 units", "about 1,234.5", "12 %", "none", "Answer: = 7", "1e3", "size5", "no\nthen 4", "1,2345", "Answer: Stationary", "It is non-stationary.", "x\n YES ", "slowly rising", "so\nfalling fast", "Result = no",
)
_FREE_LABELS = ("stationary|non-stationary", "yes|no", "slowly  rising|falling", "a b||the")


def _free_rows(spark, sf_dir):
    said = series.table(spark, sf_dir, "conversations")
    dealt = said.selectExpr("conv_id", "turn", "'dealt' AS kind", f"{_pick_sql(_FREE, f'(conv_id * 7 + turn) % {len(_FREE)}')} AS reply")
    rows = dealt.union(said.selectExpr("conv_id", "turn", "'own'", "text"))
    return rows.withColumn("allowed", F.expr(f"split({_pick_sql(_FREE_LABELS, '(conv_id + turn) % 4')}, '[|]')"))


_FREE_SQL = rf"""free AS (SELECT conv_id, turn, 'dealt' AS kind, {_pick_sql(_FREE, f'(conv_id * 7 + turn) % {len(_FREE)}')} AS reply FROM conversations UNION ALL SELECT conv_id, turn, 'own', text FROM conversations),
cut AS (SELECT *, regexp_split_to_array(reply, '\r\n|[\n\r\x0B\x0C]') AS parts, regexp_replace(reply, '^\s+|\s+$', '', 'g') AS whole, string_split({_pick_sql(_FREE_LABELS, '(conv_id + turn) % 4')}, '|') AS allowed FROM free),
said AS (SELECT *, list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM cut)"""


@query(rf"""WITH {_FREE_SQL}, tried AS (SELECT *, regexp_extract(lines[1] || ' ', '(?i)^\s*([A-Z])[.):\s]', 1) AS a,
  regexp_extract(substr(reply, 1, 80), '(?i)\b(?:answer|option|letter|choose|select|selected)\b(?:\s+(?:is|was))?\s*[:=\-]?\s*([A-Z])\b', 1) AS b, regexp_extract(lines[-1], '(?i)^[^\pL\pN_]*([A-Z])[^\pL\pN_]*$', 1) AS c FROM said)
SELECT conv_id, turn, kind, CASE WHEN coalesce(whole, '') = '' THEN NULL ELSE upper(coalesce(nullif(a, ''), nullif(b, ''), nullif(c, ''))) END AS letter FROM tried""")
def answer_letters(spark, sf_dir):
    """Option letters of free answers, by four tries."""
    return _free_rows(spark, sf_dir).select("conv_id", "turn", "kind", answers.answer_letter(F.col("reply")).alias("letter"))


def _number_sql(text: str) -> str:
    bare = rf"regexp_replace(regexp_replace({text}, '^\s*(?:answer|result|value)\s*[:=]?\s*', '', 'i'), '^\s*=?\s*', '')"
    bare = rf"regexp_replace(regexp_replace(replace({bare}, '−', '-'), '\bminus\s+([0-9.])', '-\1', 'gi'), '([+-])\s+([0-9.])', '\1\2', 'g')"
    token = r"[-+]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)?(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?(?:\s*%)?"
    return f"list_filter(regexp_extract_all({bare}, '{token}'), lambda t: regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '^[-+]?[eE]'))[1]"


@query(rf"""WITH {_FREE_SQL}, t AS (SELECT *, {_number_sql('lines[1]')} AS one, {_number_sql('reply')} AS two FROM said), n AS (SELECT *, coalesce(one, two) AS token FROM t)
SELECT conv_id, turn, kind, round(CAST(regexp_replace(token, '[,%\s]', '', 'g') AS DOUBLE) / CASE WHEN token LIKE '%\%' ESCAPE '\' THEN 100 ELSE 1 END, 6) AS value FROM n""")
def answer_numbers(spark, sf_dir):
    """Numbers of free answers."""
    return _free_rows(spark, sf_dir).select("conv_id", "turn", "kind", answers.answer_number(F.col("reply")).alias("value"))


_PLAIN = r"regexp_replace(lower(regexp_replace({x}, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"


def _label_sql() -> str:
    plain = lambda x: _PLAIN.format(x=x)
    return rf"""WITH {_FREE_SQL}, heads AS (SELECT *, {plain(r"regexp_replace(lines[1], '^\s*(?:answer|result|value)\s*[:=]?\s*', '', 'i')")} AS head, {plain('reply')} AS body, list_transform(lines, lambda x: {plain('x')}) AS each FROM said),
labels AS (SELECT conv_id, turn, kind, head, body, each, unnest(allowed) AS label, generate_subscripts(allowed, 1) AS place FROM heads WHERE len(lines) > 0),
tried AS (SELECT *, {plain('label')} AS p FROM labels WHERE trim(label) <> ''),
ranked AS (SELECT *, CASE WHEN p = head THEN 1 WHEN list_contains(each, p) THEN 2 WHEN contains(head, p) OR (head <> '' AND contains(p, head)) THEN 3 WHEN contains(body, p) THEN 4 END AS try FROM tried),
best AS (SELECT * FROM ranked WHERE try IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn, kind ORDER BY try, CASE WHEN try > 2 THEN -length(p) ELSE 0 END, place) = 1)
SELECT s.conv_id, s.turn, s.kind, b.label AS label FROM said s LEFT JOIN best b USING (conv_id, turn, kind)"""


@query(_label_sql())
def answer_labels(spark, sf_dir):
    """Which of a row's labels its free answer names."""
    return _free_rows(spark, sf_dir).select("conv_id", "turn", "kind", answers.answer_label(F.col("reply"), F.col("allowed")).alias("label"))


# ---- several series of a row: each embedding and its own alterations.
_VECTORS = "vectors AS (SELECT vec_id AS question_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(f"""WITH {_VECTORS}, c AS (SELECT question_id, CASE WHEN question_id % 3 = 0 THEN NULL ELSE e[1:question_id % 7 + 5] END AS ts1, CASE WHEN question_id % 2 = 0 THEN list_reverse(e) ELSE CAST([] AS DOUBLE[]) END AS ts2, e AS ts FROM vectors),
a AS (SELECT question_id, coalesce(len(ts1), 0) > 0 AS h1, len(ts2) > 0 AS h2, ts1, ts2, ts FROM c),
x AS (SELECT question_id, 'ts1' AS channel, unnest(ts1) AS v, generate_subscripts(ts1, 1) - 1 AS pos FROM a WHERE h1 UNION ALL SELECT question_id, 'ts2', unnest(ts2), generate_subscripts(ts2, 1) - 1 FROM a WHERE h2
  UNION ALL SELECT question_id, 'ts', unnest(ts), generate_subscripts(ts, 1) - 1 FROM a WHERE NOT h1 AND NOT h2),
s AS (SELECT question_id, channel, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, regr_slope(v, pos) AS slope FROM x GROUP BY 1, 2),
w AS (SELECT question_id, string_agg(channel, ',' ORDER BY channel) AS keys, string_agg(CAST(n AS VARCHAR), ',' ORDER BY channel) AS lengths, count(*) AS k, arg_min(struct_pack(n := n, mean := mean, std := std, slope := slope), channel) AS f,
  max(CASE WHEN channel = 'ts1' THEN mean END) AS m1, max(CASE WHEN channel = 'ts2' THEN mean END) AS m2, max(CASE WHEN channel = 'ts2' THEN slope END) AS s2 FROM s GROUP BY 1)
SELECT question_id, f.n AS n, round(f.mean, 6) AS mean, round(f.std, 6) AS std, round(f.slope, 6) AS slope, CASE WHEN k > 1 THEN 'multi' ELSE 'single' END AS series_mode, keys AS series_keys, lengths AS series_lengths,
  round(CASE WHEN k > 1 THEN m1 END, 6) AS ts1_mean, round(CASE WHEN k > 1 THEN m2 END, 6) AS ts2_mean, round(CASE WHEN k > 1 THEN s2 END, 6) AS ts2_slope FROM w""")
def multi_series(spark, sf_dir):
    """One operator over one, two or three series of each embedding: its beginning, its reverse, or itself where it has neither."""
    e = series.embedding_series(spark, sf_dir)
    rows = e.select(
        F.col("series_id").alias("question_id"), F.when(F.col("series_id") % 3 != 0, F.slice("values", F.lit(1), (F.col("series_id") % 7 + 5).cast("int"))).alias("ts1"),
        F.when(F.col("series_id") % 2 == 0, F.reverse("values")).otherwise(F.array().cast("array<double>")).alias("ts2"), F.col("values").alias("ts"),
    )

    def noise(points):
        v, x = F.col("value"), F.col("pos").cast("double")
        return points.groupBy("series_id").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), guards.slope(v, x).alias("slope"))

    wide = channels.over_channels(rows, noise, "noise")
    keys, lengths = F.array_join("series_keys", ","), F.array_join(F.transform(F.map_values("series_lengths"), lambda n: n.cast("string")), ",")
    picked = {"ts1_mean": F.col("ts1_noise.mean"), "ts2_mean": F.col("ts2_noise.mean"), "ts2_slope": F.col("ts2_noise.slope")}
    return wide.select("question_id", "n", "mean", "std", "slope", "series_mode", keys.alias("series_keys"), lengths.alias("series_lengths"), *[c.alias(name) for name, c in picked.items()])


@query(f"""WITH {_VECTORS}, c AS (SELECT question_id, e, [list_reverse(e), list_transform(e, lambda x: 2 * x + 1), e[1:5], CAST([] AS DOUBLE[]), CAST(NULL AS DOUBLE[]), list_concat(e[2:], [0.0])] AS cs FROM vectors),
each AS (SELECT question_id, e, unnest(cs) AS k, generate_subscripts(cs, 1) - 1 AS candidate FROM c), sized AS (SELECT *, CASE WHEN k IS NULL THEN 0 ELSE least(len(e), len(k)) END AS n FROM each),
p AS (SELECT question_id, candidate, unnest(e[1:n]) AS a, unnest(k[1:n]) AS b FROM sized WHERE n > 0),
m AS (SELECT question_id, candidate, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, count(*) AS n, CASE WHEN count(*) > 1 AND var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END AS r FROM p GROUP BY 1, 2),
d AS (SELECT p.question_id, p.candidate, any_value(r) AS correlation, sqrt(sum(pow(CASE WHEN sa > 0 THEN (a - ma) / sa ELSE 0 END - CASE WHEN sb > 0 THEN (b - mb) / sb ELSE 0 END, 2))) / any_value(n) AS distance
  FROM p JOIN m USING (question_id, candidate) GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(distance, 9), round(coalesce(correlation, -2), 9) DESC, candidate) AS place FROM d)
SELECT s.question_id, CAST(s.candidate AS BIGINT) AS candidate, chr(CAST(65 + s.candidate AS INTEGER)) AS letter, CAST(s.n AS BIGINT) AS n, round(correlation, 6) AS correlation, round(distance, 6) AS distance, place, CASE WHEN place IS NULL THEN 'similarity_error' END AS error
FROM sized s LEFT JOIN o USING (question_id, candidate)""")
def reference_candidates(spark, sf_dir):
    """Each embedding against six candidates made of it, two of them without points."""
    e = series.embedding_series(spark, sf_dir)
    made = F.expr("array(reverse(values), transform(values, x -> 2 * x + 1), slice(values, 1, 5), CAST(array() AS array<double>), CAST(NULL AS array<double>), concat(slice(values, 2, size(values) - 1), array(0D)))")
    done = channels.against_candidates(e.select(F.col("series_id").alias("question_id"), F.col("values").alias("reference"), made.alias("candidates")))
    return done.select("question_id", F.col("candidate").cast("long"), "letter", F.col("n").cast("long"), "correlation", "distance", F.col("place").cast("long"), "error")


# ---- evidence in JSON, made of each user's series, with a branch and subtype dealt by its number.
_TOPICS = (*evidence.FIELDS, ("trend", "unknown"))


def _topic_sql(at: str, part: int) -> str:
    return _pick_sql(tuple(t[part] for t in _TOPICS), at)


_EVIDENCE_SQL = f"""WITH {_PTS}, e AS (SELECT series_id AS question_id, {_topic_sql(f"series_id % {len(_TOPICS)}", 0)} AS branch, {_topic_sql(f"series_id % {len(_TOPICS)}", 1)} AS subtype, regr_slope(value, pos) AS slope, var_pop(value) AS variance,
  min(value) AS low, max(value) AS high, count(*) AS n FROM pts GROUP BY 1), f AS (SELECT unnest([{', '.join(f"struct_pack(b := '{b}', s := '{s}', keys := [{', '.join(repr(k) for k in keys)}])" for (b, s), keys in evidence.FIELDS.items())}], recursive := true)),
have AS (SELECT question_id, branch, subtype, slope, variance, low, high, n, unnest(['branch', 'flags', 'slope', 'variance', 'segment_slopes', 'acf_values', 'outlier_count', 'vision_text', 'direction', 'is_stationary', 'envelope_slope', 'best_lag', 'zscore', 'shape_similarity']) AS k FROM e)"""


def _evidence_rows(spark, sf_dir):
    v, x = F.col("value"), F.col("pos").cast("double")
    e = series.user_values(spark, sf_dir).groupBy(F.col("series_id").alias("question_id")).agg(
        guards.slope(v, x).alias("slope"), F.var_pop(v).alias("variance"), F.min(v).alias("low"), F.max(v).alias("high"), F.count("*").alias("n")
    )
    topic = lambda part: F.expr(_topic_sql(f"question_id % {len(_TOPICS)}", part))
    e = e.withColumns({"branch": topic(0), "subtype": topic(1)})
    both = F.array("low", "high")
    made = F.struct(
        "branch", F.array(F.lit("low_r2")).alias("flags"), "slope", "variance", both.alias("segment_slopes"), both.alias("acf_values"), F.col("n").alias("outlier_count"), F.lit("looks flat").alias("vision_text"),
        F.lit("up").alias("direction"), (F.col("n") > 50).alias("is_stationary"), F.struct("low").alias("envelope_slope"), F.lit(0).alias("best_lag"), F.lit(1.5).alias("zscore"), F.lit("high").alias("shape_similarity"),
    )
    return e.withColumn("math", evidence.fields(F.to_json(made)))


@query(f"""{_EVIDENCE_SQL}, kept AS (SELECT h.*, (f.b IS NULL OR list_contains(f.keys, k) OR k IN {tuple(evidence.CORE)}) AND k NOT IN {tuple(evidence.LONG)} AS stays FROM have h LEFT JOIN f ON f.b = h.branch AND f.s = h.subtype)
SELECT question_id, any_value(branch) AS branch, any_value(subtype) AS subtype, string_agg(k, ',' ORDER BY k) FILTER (stays) AS fields, count(*) FILTER (stays) AS n FROM kept GROUP BY 1""")
def evidence_prune(spark, sf_dir):
    """The fields of each user's evidence that an answer to its subtype sees."""
    kept = evidence.pruned(_evidence_rows(spark, sf_dir))
    return kept.select("question_id", "branch", "subtype", F.array_join(F.array_sort(F.map_keys("math")), ",").alias("fields"), F.size("math").cast("long").alias("n"))


@query(f"""{_EVIDENCE_SQL}, s AS (SELECT question_id, k, CASE k WHEN 'slope' THEN round(slope, 6) WHEN 'outlier_count' THEN n WHEN 'best_lag' THEN 0 END AS v, branch, n FROM have WHERE k IN {tuple(evidence.SUMMARY)})
SELECT question_id, string_agg(k, ',' ORDER BY k) AS fields, max(v) FILTER (k = 'slope') AS slope, CAST(max(v) FILTER (k = 'outlier_count') AS BIGINT) AS outlier_count, '"' || any_value(branch) || '"' AS branch,
  CASE WHEN any_value(n) > 50 THEN 'true' ELSE 'false' END AS is_stationary, CAST(13 AS BIGINT) AS math_fields, 'looks flat' AS vision_text, false AS parse_success, 'low_r2' AS flags FROM s GROUP BY 1""")
def evidence_summary(spark, sf_dir):
    """Summary and bundle of each user's evidence."""
    rows = _evidence_rows(spark, sf_dir).select("question_id", evidence.summary(F.col("math")).alias("s"), evidence.bundle(F.col("math")).alias("b"))
    at = lambda k: F.element_at("s", F.lit(k))
    return rows.select(
        "question_id", F.array_join(F.array_sort(F.map_keys("s")), ",").alias("fields"), at("slope").cast("double").alias("slope"), at("outlier_count").cast("long").alias("outlier_count"), at("branch").alias("branch"),
        at("is_stationary").alias("is_stationary"), F.size("b.math_evidence").cast("long").alias("math_fields"), "b.vision_text", "b.vision_suggestion.parse_success", F.array_join("b.flags", ",").alias("flags"),
    )


# ---- trajectories: options of different lengths, made of a user's number.
_TRACKS = ("[40, 44, 48]", "30 then 35, 40, 45, 50", "[55]", "(60, 52.5, 61e0, 50, 49, 48, 47)", "20 and 25", "[45, 45.5]", "no numbers", "[10, 90, 10, 90]")


def _tracks_sql(i: int) -> str:
    return _pick_sql(_TRACKS, f"CAST(floor(question_id / {i + 1}) AS BIGINT) % 8 + 0 * {i}")


@query(rf"""WITH {_PTS}, users AS (SELECT DISTINCT user_id AS question_id FROM events), ends AS (SELECT series_id, count(*) AS n, arg_min(value, pos) AS f, arg_max(value, pos) AS l FROM pts GROUP BY 1),
centred AS (SELECT series_id, pos, value - avg(value) OVER (PARTITION BY series_id) AS v, count(*) OVER (PARTITION BY series_id) AS n FROM pts),
bins AS (SELECT series_id, n, unnest(range(1, n // 2 + 1)) AS bin, pos, v FROM centred),
mags AS (SELECT series_id, n, bin, round(sqrt(pow(sum(v * cos(2 * pi() * ((bin * pos) % n) / n)), 2) + pow(sum(v * sin(2 * pi() * ((bin * pos) % n) / n)), 2)), 9) AS m FROM bins GROUP BY ALL),
per AS (SELECT series_id, n, CAST(round_even(n / bin, 0) AS BIGINT) AS p FROM mags QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY m DESC, bin) = 1),
seas AS (SELECT e.*, CASE WHEN e.n >= 8 AND p BETWEEN 2 AND e.n // 2 THEN p END AS p FROM ends e LEFT JOIN per USING (series_id)),
o AS (SELECT question_id, unnest([0, 1, 2]) AS i, unnest([{_tracks_sql(0)}, {_tracks_sql(1)}, {_tracks_sql(2)}]) AS t FROM users),
l AS (SELECT *, list_transform(regexp_extract_all(t, '[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?'), lambda x: CAST(x AS DOUBLE)) AS xs FROM o),
good AS (SELECT question_id FROM l GROUP BY 1 HAVING bool_and(len(xs) >= 2 OR (len(xs) = 1 AND t LIKE '[%'))),
steps AS (SELECT question_id, i, unnest(xs) AS x, generate_subscripts(xs, 1) AS step FROM l SEMI JOIN good USING (question_id)),
fc AS (SELECT s.*, unnest([0, 1, 2]) AS m, unnest([l, l + (l - f) / greatest(n - 1, 1) * step, coalesce((SELECT value FROM pts y WHERE y.series_id = s.question_id AND y.pos = n - p + (step - 1) % p), l)]) AS y
  FROM steps s JOIN seas ON series_id = question_id WHERE n >= 2),
err AS (SELECT question_id, i, m, round(avg((x - y) * (x - y)), 9) AS mse FROM fc GROUP BY 1, 2, 3), best AS (SELECT * FROM err QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY mse, i, m) = 1)
SELECT question_id, chr(CAST(65 + i AS INTEGER)) AS letter, ['persistence', 'drift', 'seasonal_naive'][m + 1] AS method, round(mse, 6) AS mse FROM best""")
def trajectory_rank(spark, sf_dir):
    """Options of several lengths ranked against forecasts of each user's series."""
    users = series.table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id")).distinct()
    rows = users.select("question_id", F.col("question_id").alias("series_id"), F.array(*[F.expr(_tracks_sql(i)) for i in range(3)]).alias("options"))
    return heads.trajectory_head(rows, series.to_arrays(series.user_values(spark, sf_dir)))


# ---- the verifier and the gates over every field: evidence of both scopes, made of a user's number and fit, with nulls.
_SCOPED = {
    "scope": "CASE k % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'global' END", "branch": _pick_sql(_LOOP_BRANCHES, "CAST(floor(k / 2) AS BIGINT) % 6"), "slope": "CASE WHEN k % 7 <> 0 THEN fit_slope END",
    "direction": "CASE k % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'up' WHEN 2 THEN '1 -> 2' END", "r2": "fit_r2", "n": "fit_n", "dominant_period_fft": "CASE WHEN k % 5 <> 0 THEN fit_n * (k % 4) / 5.0 END",
    "dominant_freq": "CASE WHEN k % 6 <> 0 THEN 0.1 END", "period_reconciled": "CAST(k % 9 AS DOUBLE)", "outlier_indices": "CASE WHEN k % 3 <> 1 THEN '[]' END", "outlier_count": "k % 4", "max_deviation": "CAST(k % 5 AS DOUBLE)",
    "adf_pval": "CASE k % 4 WHEN 0 THEN 0.01 WHEN 1 THEN 0.2 WHEN 2 THEN 0.5 END", "kpss_pval": "CASE k % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.01 END", "is_stationary": "k % 2 = 0", "is_white_noise": "CASE WHEN k % 11 <> 0 THEN k % 3 = 0 END",
    "amp_stats_1": "'s'", "amp_stats_2": "CASE WHEN k % 4 <> 3 THEN 's' END", "trend_1": "'up'", "trend_2": "'up'", "best_lag": "k % 10", "best_corr": "CASE WHEN k % 6 <> 1 THEN (k % 11 - 5) / 10.0 END",
    "pval_12": "CASE k % 5 WHEN 0 THEN 0.05 WHEN 1 THEN 0.001 WHEN 2 THEN 0.5 WHEN 3 THEN 0.2 END", "pval_21": "CASE k % 2 WHEN 0 THEN 0.3 END", "arch_effect_detected": "CASE k % 5 WHEN 0 THEN true WHEN 1 THEN false END",
    "mean_1": "CASE WHEN k % 8 = 0 THEN 0.0 ELSE 2.0 END", "std_1": "CAST(k % 4 AS DOUBLE)", "seasonal_strength": "(k % 10) / 10.0", "trend_strength": "CASE WHEN k % 3 <> 0 THEN (k % 8) / 10.0 END", "exp_r2": "CASE WHEN k % 4 <> 1 THEN (k % 10) / 10.0 END",
    "vision": "(k % 4) / 4.0", "question": _pick_sql(_ROUTE_ASKS, "k % 12"), "subtype": _pick_sql(("waveform_type", "variance_level", "direction"), "k % 3"),
}
_CHUNKS = {"r2s": "array(0.5D + 0.1D * (k % 5), NULL, 0.9D)", "chunk_periods": "array(10D + k % 7, NULL, 3D)", "slopes": "CASE WHEN k % 13 <> 0 THEN array(1D) END", "directions": "array('up')", "chunk_outlier_counts": "CASE WHEN k % 5 <> 2 THEN array(0) END"}


def _scoped_sql() -> str:
    ks = "'low_r2', 'fft_unreliable', 'adf_kpss_disagree', 'granger_not_significant', 'weak_correlation', 'arch_effects', 'high_volatility'"
    need = {**{b: (f, verify.LOCAL_REQUIRED.get(b, f)) for b, f in verify.REQUIRED.items()}}
    lacks = lambda fields: "(" + " OR ".join(f"{f} IS NULL" for f in fields) + ")"
    missing = " ".join(f"WHEN '{b}' THEN CASE WHEN scope = 'local' THEN {lacks(loc)} ELSE {lacks(glo)} END" for b, (glo, loc) in need.items())
    share = " ".join(f"WHEN '{b}' THEN ({' + '.join(f'CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END' for f in glo)}) / {len(glo)}.0::DOUBLE" for b, (glo, _) in need.items())
    return f"""WITH {_PTS}, fit AS (SELECT series_id AS k, regr_slope(value, pos) AS fit_slope, CASE WHEN var_pop(value) > 0 THEN regr_r2(value, pos) ELSE 0 END AS fit_r2, count(*) AS fit_n FROM pts GROUP BY 1 HAVING count(*) >= 3),
e AS (SELECT k, {', '.join(f'{c} AS {name}' for name, c in _SCOPED.items())}, [0.5 + 0.1 * (k % 5), NULL, 0.9]::DOUBLE[] AS r2s, [10 + k % 7, NULL, 3]::DOUBLE[] AS chunk_periods, true AS chunk_edges, CASE WHEN k % 13 <> 0 THEN true END AS slopes,
  true AS directions, CASE WHEN k % 5 <> 2 THEN true END AS chunk_outlier_counts FROM fit),
f AS (SELECT *, list_filter([CASE WHEN branch = 'trend' AND CASE WHEN scope = 'local' THEN r2s[1] < 0.65 ELSE r2 < 0.65 END THEN 'low_r2' END,
  CASE WHEN coalesce(dominant_period_fft > n / 2, false) OR (branch = 'periodicity' AND scope = 'local' AND chunk_periods[1] > 12.5) THEN 'fft_unreliable' END,
  CASE WHEN (adf_pval < 0.1) <> (kpss_pval >= 0.05) THEN 'adf_kpss_disagree' END, CASE WHEN branch = 'causality' AND direction = 'none' THEN 'granger_not_significant' END, CASE WHEN abs(best_corr) < 0.2 THEN 'weak_correlation' END,
  CASE WHEN arch_effect_detected THEN 'arch_effects' END, CASE WHEN CASE WHEN mean_1 = 0 THEN std_1 > 0 ELSE std_1 / 2 > 1.5 END THEN 'high_volatility' END, CASE WHEN CASE branch {missing} END THEN 'evidence_incomplete' END], lambda x: x IS NOT NULL) AS flags FROM e),
qq AS (SELECT *, least(1, 0.12 * len(list_intersect(flags, [{ks}])) + CASE WHEN list_contains(flags, 'evidence_incomplete') THEN 0.3 ELSE 0 END) AS penalty, CASE branch {share} END AS complete,
  CASE WHEN r2 IS NOT NULL THEN CASE WHEN r2 >= 0.75 THEN 1 WHEN r2 >= 0.5 THEN 0.7 ELSE 0.4 END WHEN adf_pval IS NOT NULL AND kpss_pval IS NOT NULL THEN CASE WHEN (adf_pval < 0.1) = (kpss_pval >= 0.05) THEN 1 ELSE 0.5 END
    WHEN best_corr IS NOT NULL THEN least(1, abs(best_corr) * 2) ELSE 1 END AS math, list_sort(list_filter([r2, exp_r2], lambda x: x IS NOT NULL), 'DESC') AS fits, lower(question) AS q, coalesce(pval_12, 1) AS p12, coalesce(pval_21, 1) AS p21 FROM (SELECT * REPLACE (CASE WHEN k % 4 <> 2 THEN r2 END AS r2) FROM f)),
s AS (SELECT *, list_filter([CASE WHEN fits[1] < 0.65 THEN 'low_fit' END, CASE WHEN fits[1] - fits[2] < 0.05 THEN 'fit_ambiguous' END, CASE WHEN p12 BETWEEN 0.04 AND 0.1 OR p21 BETWEEN 0.04 AND 0.1 THEN 'pval_marginal' END,
  CASE WHEN arch_effect_detected THEN 'arch_effects' END, CASE WHEN adf_pval > 0.1 THEN 'adf_high_pval' END, CASE WHEN abs(best_corr) >= 0.3 AND greatest(p12, p21) >= 0.1 THEN 'corr_granger_conflict' END,
  CASE WHEN {_any_sql("q", verify.SEASON_WORDS)} AND seasonal_strength < 0.2 THEN 'weak_seasonal_signal' END, CASE WHEN {_any_sql("q", verify.SEASON_WORDS)} AND trend_strength < 0.2 THEN 'weak_trend_signal' END,
  CASE WHEN {_any_sql("q", verify.ANOMALY_WORDS)} AND max_deviation < 2 THEN 'weak_anomaly_signal' END], lambda x: x IS NOT NULL) AS terms FROM qq),
c AS (SELECT *, greatest(0, 1 - 0.15 * len(flags) - CASE WHEN list_contains(flags, 'evidence_incomplete') THEN 0.25 ELSE 0 END - list_sum(list_concat([0.0], list_transform(terms, lambda x: CASE WHEN x IN ('low_fit', 'arch_effects') THEN 0.2
  WHEN x IN ('weak_seasonal_signal', 'weak_anomaly_signal') THEN 0.1 WHEN x = 'weak_trend_signal' THEN 0.05 ELSE 0.15 END)))) AS confidence FROM s)
SELECT k AS series_id, branch, array_to_string(flags, ',') AS flags, round(greatest(0, least(1, 0.35 * complete + 0.3 * (1 - penalty) + 0.2 * math + 0.15 * vision)), 4) AS quality, round(math, 6) AS math, round(confidence, 6) AS confidence,
  array_to_string(list_concat(list_sort(flags), terms), ',') AS reasons FROM c"""


@query(_scoped_sql())
def verifier_scopes(spark, sf_dir):
    """Flags, quality and the gate's terms over evidence with every field, of both scopes."""
    v, x = F.col("value"), F.col("pos").cast("double")
    fit = series.user_values(spark, sf_dir).groupBy(F.col("series_id").alias("k")).agg(guards.slope(v, x).alias("fit_slope"), guards.r_squared(v, x).alias("fit_r2"), F.count("*").alias("fit_n")).filter("fit_n >= 3")
    edges = "array(named_struct('start', 0, 'end', 25), named_struct('start', 25, 'end', 50), named_struct('start', 50, 'end', 75)) AS chunk_edges"
    e = fit.selectExpr("k", *[f"{c} AS {name}" for name, c in {**_SCOPED, **_CHUNKS}.items()], edges)
    fields = {c: F.col(c) for c in (*_SCOPED, *_CHUNKS, "chunk_edges") if c not in ("scope", "branch", "question", "subtype", "vision")}
    e = e.withColumn("flags", verify.row_flags(fields, F.col("branch"), F.col("scope")))
    less = {**fields, "r2": F.when(F.col("k") % 4 != 2, F.col("r2"))}  # without a fit the tests or the correlation speak
    e = e.withColumn("q", verify.quality_gate(less, F.col("flags"), F.col("branch"), F.col("vision"))).withColumn("g", verify.visual_gate(less, F.col("flags"), F.col("branch"), F.col("subtype"), F.col("question")))
    return e.select(F.col("k").alias("series_id"), "branch", F.array_join("flags", ",").alias("flags"), F.col("q.score").alias("quality"), "q.math", "g.confidence", F.array_join("g.reasons", ",").alias("reasons"))


# ---- spectrograms of the hourly series of event types.
_FRAMES_SQL = """WITH spread AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS hour, sum(value) AS value FROM events GROUP BY 1, 2), span AS (SELECT series_id, min(hour) AS a, max(hour) AS b FROM spread GROUP BY 1),
grid AS (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM span),
x AS (SELECT g.series_id, row_number() OVER (PARTITION BY g.series_id ORDER BY g.hour) - 1 AS pos, coalesce(s.value, 0) AS v FROM grid g LEFT JOIN spread s ON s.series_id = g.series_id AND s.hour = g.hour),
z AS (SELECT series_id, pos, (v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w > 0 THEN stddev_pop(v) OVER w ELSE 1 END AS v, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY series_id)),
s AS (SELECT *, least(n, 256) AS m, least(n, 256) // 8 AS o FROM z),
f AS (SELECT *, pos - frame * (m - o) AS i FROM (SELECT *, unnest(range((n - o) // (m - o))) AS frame FROM s) WHERE pos BETWEEN frame * (m - o) AND frame * (m - o) + m - 1),
t AS (SELECT *, v - avg(v) OVER (PARTITION BY series_id, frame) AS c, CASE WHEN i <= m // 8 THEN 0.5 * (1 + cos(pi() * (-1 + 8.0 * i / m))) WHEN i < m - m // 8 THEN 1 ELSE 0.5 * (1 + cos(pi() * (-8 + 1 + 8.0 * i / m))) END AS w FROM f),
p AS (SELECT series_id, frame, k, any_value(m) AS m, (pow(sum(c * w * cos(2 * pi() * ((k * i) % m) / m)), 2) + pow(sum(c * w * sin(2 * pi() * ((k * i) % m) / m)), 2)) / sum(w * w) AS e FROM t, range(129) r(k) WHERE k <= m // 2 GROUP BY 1, 2, 3)
SELECT series_id, frame, k AS bin, round(10 * log10(e * CASE WHEN k > 0 AND NOT (m % 2 = 0 AND k = m // 2) THEN 2 ELSE 1 END + 1e-10), 4) AS db FROM p WHERE k > 0"""


@query(_FRAMES_SQL, digits=4)
def spectrogram_rows(spark, sf_dir):
    """Power by frame and frequency of each event type's hours; the bin of the mean, which detrending empties, is left out."""
    points = series.hourly_type(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit(0.0)))
    return spectral.spectrogram(points).filter("bin > 0").select("series_id", "frame", "bin", "db")


# ---- peaks with prominence: nearest higher points by comparison with all others of a series.
@query(f"""WITH {_PTS}, c AS (SELECT *, CASE WHEN value <> lag(value) OVER w THEN 1 ELSE 0 END AS fresh FROM pts WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY pos) AS run FROM c), runs AS (SELECT series_id, run, min(pos) AS p0, max(pos) AS p1, any_value(value) AS v FROM n GROUP BY 1, 2),
k AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b, (p0 + p1) // 2 AS pos FROM runs WINDOW w AS (PARTITION BY series_id ORDER BY run)),
x AS (SELECT series_id, pos, v, p0, p1, 1 AS sign FROM k WHERE v > a AND v > b UNION ALL SELECT series_id, pos, v, p0, p1, -1 FROM k WHERE v < a AND v < b),
bound AS (SELECT x.*, coalesce((SELECT max(y.pos) FROM pts y WHERE y.series_id = x.series_id AND y.pos < x.p0 AND y.value * x.sign > x.v * x.sign), -1) AS lo,
  coalesce((SELECT min(y.pos) FROM pts y WHERE y.series_id = x.series_id AND y.pos > x.p1 AND y.value * x.sign > x.v * x.sign), 1000000000) AS hi FROM x),
prom AS (SELECT b.*, v * sign - greatest((SELECT min(y.value * b.sign) FROM pts y WHERE y.series_id = b.series_id AND y.pos > lo AND y.pos <= b.p0), (SELECT min(y.value * b.sign) FROM pts y WHERE y.series_id = b.series_id AND y.pos < hi AND y.pos >= b.p1)) AS p FROM bound b),
ends AS (SELECT series_id, max(value) AS most, min(value) AS least FROM pts GROUP BY 1), good AS (SELECT prom.* FROM prom JOIN ends USING (series_id) WHERE round(p, 12) >= round(0.05 * (most - least), 12)),
f AS (SELECT *, (SELECT max(t.pos) FROM good t WHERE t.series_id = g.series_id AND t.sign = -1 AND t.pos < g.pos) AS before, (SELECT min(t.pos) FROM good t WHERE t.series_id = g.series_id AND t.sign = -1 AND t.pos > g.pos) AS after,
  pos - (SELECT max(t.pos) FROM good t WHERE t.series_id = g.series_id AND t.sign = 1 AND t.pos < g.pos) AS gap FROM good g),
per AS (SELECT series_id, count(*) FILTER (sign = 1) AS peaks, count(*) FILTER (sign = -1) AS troughs, avg(v) FILTER (sign = 1) AS peak, avg(v) FILTER (sign = -1) AS trough, avg(gap) FILTER (sign = 1) AS gap, stddev_pop(gap) FILTER (sign = 1) AS spread,
  avg(pos - before) FILTER (sign = 1 AND before IS NOT NULL AND after IS NOT NULL) AS rise, avg(after - pos) FILTER (sign = 1 AND before IS NOT NULL AND after IS NOT NULL) AS fall FROM f GROUP BY 1),
o AS (SELECT series_id, coalesce(peaks, 0) AS peak_count, coalesce(troughs, 0) AS trough_count, coalesce(peak, most) AS top, coalesce(trough, least) AS bottom, CASE WHEN peaks >= 2 THEN spread / gap ELSE 0 END AS cv,
  coalesce(peaks >= 2 AND rise IS NOT NULL, false) AS known, rise / fall AS r FROM ends LEFT JOIN per USING (series_id))
SELECT series_id, peak_count, trough_count, round(top, 6) AS mean_peak_value, round(bottom, 6) AS mean_trough_value, round(top - bottom, 6) AS peak_to_trough_amp, round(cv, 6) AS inter_peak_cv, round(CASE WHEN peak_count >= 2 THEN 1 / (1 + cv) ELSE 0 END, 6) AS peak_regularity,
  round(CASE WHEN known THEN r ELSE 1 END, 6) AS rise_fall_ratio, CASE WHEN NOT known THEN 'insufficient_peaks' WHEN cv > 0.4 THEN 'irregular' WHEN r > 2 THEN 'slow_rise_fast_fall' WHEN r < 0.5 THEN 'fast_rise_slow_fall' ELSE 'symmetric' END AS waveform_hint FROM o""")
def shape_summary(spark, sf_dir):
    """Peaks and troughs of each user's series by prominence."""
    return shape.shape_summary(series.user_values(spark, sf_dir))


# ---- the stress set of the parsers over users' series.
_OTHER_WORDS = {"std": "How tightly do the numbers huddle together?", "mean": "What would each number be if all were level?", "max": "How far up does it ever get?", "min": "How deep does it ever go?"}


def _stress_sql() -> str:
    at = lambda layer, name, n: f"CAST(('0x' || substr(md5('stress:{layer}:{name}:' || id), 1, 7)) AS BIGINT) % {n}"
    pick = lambda values, i: f"([{', '.join(repr(v) for v in values)}])[{i} + 1]"
    names, phrases, typos = list(stress.PHRASES), list(stress.PHRASES.values()), list(stress.TYPOS)
    of = {p: q for q, p in stress.PHRASES.items()}
    mended = [t for t in stress.TYPOS.items() if t[1] != "maen value"]  # three of four letters in common are too few for a repair
    said = lambda x: f"'Based on the Time Series 1 data, what is ' || {x} || ' of the sequence?'"
    return f"""{_PTS}, ids AS (SELECT DISTINCT user_id AS id FROM events),
k AS (SELECT id, {at("clean", "q", 7)} AS cq, {at("compositional", "a", 7)} AS ca, {at("compositional", "b", 6)} AS cb, {at("compositional", "form", 4)} AS cf, {at("typo", "q", 6)} AS tq, {at("paraphrase", "q", 4)} AS pq FROM ids),
set0 AS (SELECT id, 'clean' AS layer, {said(f"'the ' || {pick(phrases, 'cq')}")} AS raw, NULL AS gop, {pick(names, 'cq')} AS gl, NULL AS gr FROM k
  UNION ALL SELECT id, 'compositional', {said(f"replace(replace({pick([f for _, f in stress.FORMS], 'cf')}, '{{a}}', {pick(phrases, 'ca')}), '{{b}}', {pick(phrases, '((ca + 1 + cb) % 7)')})")}, {pick([op for op, _ in stress.FORMS], 'cf')}, {pick(names, 'ca')}, {pick(names, '((ca + 1 + cb) % 7)')} FROM k
  UNION ALL SELECT id, 'typo', {said(f"'the ' || {pick(list(stress.TYPOS.values()), 'tq')}")}, NULL, {pick([of[t] for t in typos], 'tq')}, NULL FROM k
  UNION ALL SELECT id, 'paraphrase', {pick(list(_OTHER_WORDS.values()), 'pq')}, NULL, {pick(list(_OTHER_WORDS), 'pq')}, NULL FROM k),
{_parsed_sql("SELECT *, " + "replace(" * len(mended) + "raw" + "".join(f", '{bad}', '{good}')" for good, bad in mended) + " AS question FROM set0")},
arms AS (SELECT id, layer, 'gold' AS arm, gop AS o, gl AS l0, gr AS r0, left_q IS NULL AS asked FROM plans UNION ALL SELECT id, layer, 'A0', NULL, {_ladder_sql("lower(raw)")}, NULL, left_q IS NULL FROM plans
  UNION ALL SELECT id, layer, 'A1', op, left_q, right_q, left_q IS NULL FROM plans UNION ALL SELECT id, layer, 'A2', op, coalesce(left_q, CASE WHEN id % 2 = 0 THEN gl END), right_q, left_q IS NULL FROM plans),
st AS (SELECT series_id, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std, var_pop(value) AS var, min(value) AS min, max(value) AS max, max(value) - min(value) AS range FROM pts GROUP BY 1),
every AS (UNPIVOT st ON COLUMNS(* EXCLUDE series_id) INTO NAME quantity VALUE value),
val AS (SELECT id, layer, arm, asked, CASE o WHEN 'subtract' THEN x.value - y.value WHEN 'add' THEN x.value + y.value WHEN 'ratio' THEN CASE WHEN y.value <> 0 THEN x.value / y.value END ELSE x.value END AS v
  FROM arms LEFT JOIN every x ON x.series_id = id AND x.quantity = l0 LEFT JOIN every y ON y.series_id = id AND y.quantity = r0),
w AS (SELECT id, layer, bool_or(asked) AS asked, max(CASE WHEN arm = 'gold' THEN v END) AS g, max(CASE WHEN arm = 'A0' THEN v END) AS a0, max(CASE WHEN arm = 'A1' THEN v END) AS a1, max(CASE WHEN arm = 'A2' THEN v END) AS a2 FROM val GROUP BY 1, 2),
ok AS (SELECT layer, asked, coalesce(abs(a0 - g) <= 0.1 * abs(g), false)::INT AS a0, coalesce(abs(a1 - g) <= 0.1 * abs(g), false)::INT AS a1, coalesce(abs(a2 - g) <= 0.1 * abs(g), false)::INT AS a2 FROM w WHERE g IS NOT NULL),
s AS (SELECT layer, count(*) AS n, avg(a0) AS A0, avg(a1) AS A1, avg(a2) AS A2, count(*) FILTER (a1 = 1 AND a2 = 0) AS b, count(*) FILTER (a1 = 0 AND a2 = 1) AS c, avg(asked::INT) AS fire FROM (SELECT * FROM ok UNION ALL SELECT 'OVERALL', asked, a0, a1, a2 FROM ok) GROUP BY 1)"""


@query(f"""WITH {_stress_sql()} SELECT layer, n, round(A0, 6) AS a0, round(A1, 6) AS a1, round(A2, 6) AS a2, b, c, round(fire, 6) AS fire_rate, round(A1 - A0, 6) AS a1_a0, round(A2 - A1, 6) AS a2_a1,
  round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM range(least(b, c) + 1) r(i))) END, 6) AS p FROM s""")
def parser_stress(spark, sf_dir):
    """Three arms of the parser over questions of four layers; the planner answers for every other series."""
    points = series.user_values(spark, sf_dir)
    users = series.table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id")).distinct()
    asked = stress.stress_set(users, paraphrases=_OTHER_WORDS).withColumn("reply", F.when(F.col("series_id") % 2 == 0, F.concat(F.lit("Plan: "), F.col("intent"))))
    told = stress.three_arms(stress.arm_rows(asked, points))
    return told.select("layer", "n", *[F.col(a).alias(a.lower()) for a in ("A0", "A1", "A2")], "b", "c", "fire_rate", "a1_a0", "a2_a1", "p")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
