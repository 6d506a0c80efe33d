"""Autocorrelation, discrete spectrum, rolling spread and the portmanteau test, as joins on positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators.stats import by_pos, detrended, whole


def autocorrelation(pts: DataFrame, max_lag: int = 50, half: bool = True) -> DataFrame:
    """Biased autocorrelation at lags 1 .. ``max_lag``, below n / 2 with ``half`` (else below n); null for a constant series.

    All lags are windows over one partitioning by series and one aggregate of it: the points are shuffled once.
    """
    centred = pts.select("series_id", "pos", (F.col("value") - F.avg("value").over(whole())).alias("v"))
    lags = range(1, max_lag + 1)
    near = centred.select("series_id", "v", *[F.lag("v", k).over(by_pos()).alias(f"v{k}") for k in lags])
    sums = near.groupBy("series_id").agg(
        F.count("*").alias("n"), F.sum(F.col("v") * F.col("v")).alias("total"), F.array(*[F.sum(F.col("v") * F.col(f"v{k}")) for k in lags]).alias("sums")
    )
    long = sums.select("series_id", "n", "total", F.posexplode("sums").alias("at", "s")).withColumn("lag", (F.col("at") + 1).cast("long"))
    long = long.filter("lag <= n DIV 2 - 1" if half else "lag <= n - 1")
    return long.select("series_id", "lag", F.when(F.col("total") > 0, F.col("s") / F.col("total")).alias("acf"), "n")


def first_peak(acf: DataFrame) -> DataFrame:
    """The first strict local maximum above 2 / sqrt(n)."""
    w = W.partitionBy("series_id").orderBy("lag")
    near = acf.withColumns({"a": F.lag("acf").over(w), "b": F.lead("acf").over(w)})
    peaks = near.withColumn("peak", F.when((F.col("acf") > F.col("a")) & (F.col("acf") > F.col("b")) & (F.col("acf") > 2 / F.sqrt("n")), F.struct("lag", "acf")))
    return peaks.groupBy("series_id").agg(F.min("peak").alias("p")).select("series_id", F.col("p.lag").alias("lag"), F.col("p.acf").alias("strength"))


def ljung_box(pts: DataFrame, max_lag: int = 20) -> DataFrame:
    """Q statistic at each lag."""
    w = W.partitionBy("series_id").orderBy("lag").rowsBetween(W.unboundedPreceding, 0)
    term = F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))
    return autocorrelation(pts, max_lag).select("series_id", "lag", (F.col("n") * (F.col("n") + 2) * F.sum(term).over(w)).alias("q"))


def ljung_box_p(pts: DataFrame, max_lag: int = 20) -> DataFrame:
    """Q and its p at even lags, where the chi-square tail is a finite sum: exp(-q / 2) sum of (q / 2)^k / k! below half the lag."""
    half = F.col("q") / 2

    def add(done: Column, k: Column) -> Column:
        term = F.when(k == 0, F.exp(-half)).otherwise(done["term"] * half / k)
        return F.struct(term.alias("term"), (done["sum"] + term).alias("sum"))

    steps = F.sequence(F.lit(0), (F.col("lag") / 2 - 1).cast("int"))
    start = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("sum"))
    return ljung_box(pts, max_lag).filter("lag % 2 = 0").select("series_id", "lag", "q", F.aggregate(steps, start, add, lambda d: d["sum"]).alias("p"))


def partial_autocorrelation(pts: DataFrame, max_lag: int = 20) -> DataFrame:
    """Partial autocorrelations at lags 1 .. below n / 2 by the Durbin-Levinson recursion over the adjusted autocorrelations (n / (n - lag) times the biased ones)."""
    adjusted = (F.col("acf") * F.col("n") / (F.col("n") - F.col("lag"))).alias("r")
    rows = autocorrelation(pts, max_lag).filter("acf IS NOT NULL").groupBy("series_id").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("lag", adjusted))), lambda x: x["r"]).alias("r"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    none = F.array().cast("array<double>")

    def step(done: Column, k: Column) -> Column:
        phi = done["phi"]
        near = F.slice("r", F.lit(1), k - 1)
        last = (F.element_at("r", k) - dot(phi, F.reverse(near))) / (1 - dot(phi, near))
        longer = F.concat(F.zip_with(phi, F.reverse(phi), lambda x, y: x - last * y), F.array(last))
        return F.struct(longer.alias("phi"), F.concat(done["out"], F.array(last)).alias("out"))

    folded = F.aggregate(F.sequence(F.lit(1), F.size("r")), F.struct(none.alias("phi"), none.alias("out")), step, lambda d: d["out"])
    long = rows.select("series_id", "n", F.posexplode(folded).alias("at", "pacf"))
    return long.select("series_id", (F.col("at") + 1).cast("long").alias("lag"), "pacf", (F.abs("pacf") > 2 / F.sqrt("n")).alias("significant"))


def spectrum(pts: DataFrame, detrend: bool = True) -> DataFrame:
    """Magnitude of the real discrete Fourier transform at bins 1 .. n / 2, as a join with bins.

    Quadratic in a series' length, for short series.
    """
    base = detrended(pts) if detrend else pts.select("series_id", "pos", (F.col("value") - F.avg("value").over(whole())).alias("value"))
    n = F.count("*").over(whole())
    bins = base.withColumn("n", n).withColumn("bin", F.explode(F.expr("sequence(1, CAST(greatest(n DIV 2, 1) AS INT))")))
    angle = F.lit(2.0) * F.pi() * ((F.col("bin") * F.col("pos")) % F.col("n")) / F.col("n")
    sums = bins.groupBy("series_id", "bin").agg(
        F.max("n").alias("n"), F.sum(F.col("value") * F.cos(angle)).alias("re"), F.sum(F.col("value") * F.sin(angle)).alias("im")
    )
    return sums.select("series_id", F.col("bin").cast("long").alias("bin"), "n", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("magnitude"))


def strongest_bins(pts: DataFrame, k: int = 3, detrend: bool = True) -> DataFrame:
    """The ``k`` strongest bins of each spectrum with frequency and period; of equals the lower bin."""
    rank = F.row_number().over(W.partitionBy("series_id").orderBy(F.desc(F.round("magnitude", 9)), "bin"))
    top = spectrum(pts, detrend).withColumn("place", rank).filter(F.col("place") <= k)
    return top.select("series_id", "place", "bin", (F.col("bin") / F.col("n")).alias("frequency"), (F.col("n") / F.col("bin")).alias("period"), "magnitude")


def dominant_period(pts: DataFrame, detrend: bool = True) -> DataFrame:
    """n / k of the strongest bin, and the entropy of the spectrum (1 if there is none)."""
    s = spectrum(pts, detrend)
    total = s.groupBy("series_id").agg(
        F.max(F.struct("magnitude", (-F.col("bin")).alias("b"), "n")).alias("top"), F.sum("magnitude").alias("total"), F.count("*").alias("bins"),
        F.sum(F.when(F.col("magnitude") > 0, F.col("magnitude") * F.ln("magnitude")).otherwise(0.0)).alias("mlnm"),
    )
    entropy = F.when(F.col("total") > 1e-12, (F.ln("total") - F.col("mlnm") / F.col("total")) / F.ln(F.col("bins") + 1)).otherwise(1.0)
    return total.select("series_id", (F.col("top.n") / -F.col("top.b")).alias("period"), entropy.alias("entropy"))


def rolling_std(pts: DataFrame) -> DataFrame:
    """Mean rolling deviation of the halves, with windows of clip(n / 10, 4, 200) points, and its trend.

    From running sums of the centred values and their squares, each met with that of one window before.
    """
    sized = pts.select("series_id", "pos", (F.col("value") - F.avg("value").over(whole())).alias("v"), F.count("*").over(whole()).alias("n"))
    so_far = by_pos().rowsBetween(W.unboundedPreceding, 0)
    sums = sized.select(
        "series_id", "pos", "n", F.greatest(F.lit(4), F.least(F.lit(200), F.floor(F.col("n") / 10))).alias("w"),
        F.sum("v").over(so_far).alias("s"), F.sum(F.col("v") * F.col("v")).over(so_far).alias("q"),
    )
    before = sums.select("series_id", (F.col("pos") + F.col("w")).alias("pos"), F.col("s").alias("s0"), F.col("q").alias("q0"))
    full = sums.filter("pos >= w - 1").join(before, ["series_id", "pos"], "left")
    mean = (F.col("s") - F.coalesce("s0", F.lit(0.0))) / F.col("w")
    square = (F.col("q") - F.coalesce("q0", F.lit(0.0))) / F.col("w")
    std = F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))
    full = full.select("series_id", std.alias("std"), (F.col("pos") - F.col("w") + 1).alias("place"), (F.col("n") - F.col("w") + 1).alias("m"))
    half = lambda cond: F.avg(F.when(cond, F.col("std")))
    halves = full.groupBy("series_id").agg(half(F.expr("place < m DIV 2")).alias("first"), half(F.expr("place >= m DIV 2")).alias("second"))
    ratio = F.when(F.col("first") > 0, F.col("second") / F.col("first"))
    label = F.when(ratio > 1.2, "increasing").when(ratio < 0.8, "decreasing").otherwise("stable")
    return halves.select("series_id", ratio.alias("ratio"), label.alias("trend"))


def spectrogram(pts: DataFrame, frame: int = 256) -> DataFrame:
    """``series_id, frame, bin, frequency, power, db``: power densities of overlapping frames of the standardised series.

    Frames have ``frame`` points (all of a shorter series) and share an eighth with the next; each loses its mean and is tapered over a quarter
    (a cosine at both ends); only whole frames count.  A point goes to its one or two frames, and a frame is one row of at most ``frame`` values that is
    transformed there, bin by bin, so nothing grows with the series but the number of rows.  Null and NaN points are dropped first.
    """
    present = pts.filter("value IS NOT NULL AND NOT isnan(value)")
    spread = F.stddev_pop("value").over(whole())
    z = present.select(
        "series_id", (F.row_number().over(W.partitionBy("series_id").orderBy("pos")) - 1).alias("pos"), ((F.col("value") - F.avg("value").over(whole())) / F.when(spread > 0, spread).otherwise(1.0)).alias("v"),
        F.least(F.count("*").over(whole()), F.lit(frame)).alias("m"), F.count("*").over(whole()).alias("n"),
    )
    hop = F.expr("m - m DIV 8")
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - F.col("m")) / hop) + 1)
    last = F.least(F.floor(F.col("pos") / hop), F.floor((F.col("n") - F.expr("m DIV 8")) / hop) - 1)
    framed = z.filter(first <= last).select("series_id", "m", "pos", "v", F.explode(F.sequence(first, last)).alias("frame"))
    held = framed.groupBy("series_id", "frame", "m").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.col("m")
    edge = lambda turn: 0.5 * (1 + F.cos(F.pi() * turn))
    taper = lambda i: F.when(i <= F.expr("m DIV 8"), edge(-1 + 8 * i / F.col("m"))).when(i < F.col("m") - F.expr("m DIV 8"), 1.0).otherwise(edge(-7 + 8 * i / F.col("m")))
    held = held.withColumn("c", F.transform(F.array(mean), lambda a: F.transform("v", lambda x, i: F.struct(((x - a) * taper(i)).alias("x"), taper(i).alias("w"), i.alias("i"))))[0])
    bins = held.select("series_id", "frame", "m", "c", F.aggregate("c", F.lit(0.0), lambda s, p: s + p["w"] * p["w"]).alias("norm"), F.explode(F.sequence(F.lit(0), F.expr("CAST(m DIV 2 AS INT)"))).alias("bin"))
    angle = lambda p: F.lit(2.0) * F.pi() * ((F.col("bin") * p["i"]) % F.col("m")) / F.col("m")
    wave = lambda f: F.aggregate("c", F.lit(0.0), lambda s, p: s + p["x"] * f(angle(p)))
    both_sides = F.when((F.col("bin") > 0) & ~((F.col("m") % 2 == 0) & (F.col("bin") == F.expr("m DIV 2"))), 2.0).otherwise(1.0)
    power = bins.select("series_id", F.col("frame").cast("long").alias("frame"), F.col("bin").cast("long").alias("bin"), (F.col("bin") / F.col("m")).alias("frequency"), (both_sides * (F.pow(wave(F.cos), F.lit(2)) + F.pow(wave(F.sin), F.lit(2))) / F.col("norm")).alias("power"))
    return power.withColumn("db", 10 * F.log10(F.col("power") + 1e-10))
