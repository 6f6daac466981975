"""Time-series expressions over ordered groups; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def session_index(df: DataFrame, keys: list[str], order: list[str], out: str = "SESSION_INDEX") -> DataFrame:
    """1-based row number in each group; order must be total for a defined result."""
    return df.withColumn(out, F.row_number().over(ordered(keys, order)))


def ewma(df: DataFrame, value: str, keys: list[str], order: list[str], out: str, alpha: float = 0.5) -> DataFrame:
    """Exponentially weighted mean with normalised weights; a null keeps its place but adds nothing, and takes the mean so far.

    Weighted sums over 2, 4, 8 ... rows come from two sums over half as many, so a row costs a few steps whatever
    the number of terms; all steps share one order.  Weights below 1e-18 of a row's own are left out.
    """
    w = ordered(keys, order)
    terms = max(2, math.ceil(math.log(1e-18) / math.log(1 - alpha)) + 1)
    rows = df.withColumns({"__n": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "__d": F.when(F.col(value).isNotNull(), 1.0).otherwise(0.0)})
    for k in range((terms - 1).bit_length()):
        far = F.lit((1 - alpha) ** (1 << k))
        rows = rows.withColumns({c: F.col(c) + far * F.lag(c, 1 << k, 0.0).over(w) for c in ("__n", "__d")})
    rows = rows.withColumn("__e", F.when(F.col(value).isNotNull(), F.col("__n") / F.col("__d")))
    return rows.withColumn(out, F.last("__e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__n", "__d", "__e")


def polynomial_rows(window: int, derivative: int = 0) -> list[list[float]]:
    """For each place of a window, the weights whose dot product with the window's values is the fitted parabola (or its slope) there."""
    half = window // 2
    x = range(-half, half + 1)
    s2, mean2 = sum(v * v for v in x), sum(v * v for v in x) / window
    spread = sum((v * v - mean2) ** 2 for v in x)
    rows = []
    for at in x:
        if derivative:
            rows.append([v / s2 + 2 * at * (v * v - mean2) / spread for v in x])
        else:
            rows.append([1 / window + v * at / s2 + (v * v - mean2) * (at * at - mean2) / spread for v in x])
    return rows


def polynomial_weight(window: Column, at: Column, place: Column, derivative: int = 0) -> Column:
    """The weight of the value at `place` for the parabola (or its slope) fitted to a window at `at`; both count from the middle of the window."""
    w, a, v = (c.cast("double") for c in (window, at, place))
    squares, mean = w * (w * w - 1) / 12, (w * w - 1) / 12
    spread = w * (w * w - 1) * (w * w - 4) / 180
    if derivative:
        return v / squares + 2 * a * (v * v - mean) / spread
    return 1 / w + v * a / squares + (v * v - mean) * (a * a - mean) / spread


def alpha_window(alpha: Column, scale: float = 2.0, low: int = 5, high: int = 21) -> Column:
    """The odd window that goes with an EWMA's alpha: scale / alpha between low and high, the next odd number up."""
    w = F.floor(F.least(F.greatest(scale / alpha, F.lit(float(low))), F.lit(float(high)))).cast("int")
    return w + F.when(w % 2 == 0, 1).otherwise(0)


def polynomial_filter(df: DataFrame, value: str, keys: list[str], order: list[str], out: str, window: int | Column = 7, derivative: int = 0, most: int = 21, short: str = "shrink") -> DataFrame:
    """Savitzky-Golay smoothing (or slope) of order 2; the first and last half windows use the fit of the outermost window.

    window is an odd number, or a column with one for each group (`most` at most); weights follow from it by formula.
    Groups of n < window use the largest odd window up to n ("shrink"), or stay as they are ("value"); groups of
    fewer than 3 stay in any case.
    """
    w = ordered(keys, order)
    wanted, reach = (F.lit(window), window - 1) if isinstance(window, int) else (window, most - 1)
    own = F.least(wanted, F.col("__n")) if short == "shrink" else wanted
    own = own - F.when(own % 2 == 0, 1).otherwise(0)
    rows = (
        df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int"))
        .withColumn("__i", (F.row_number().over(w) - 1).cast("int"))
        .withColumn("__v", F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))).over(w.rowsBetween(-reach, reach)))
        .withColumn("__w", own.cast("int"))
        .withColumn("__s", F.greatest(F.lit(0), F.least(F.col("__i") - F.floor(F.col("__w") / 2), F.col("__n") - F.col("__w"))).cast("int"))
    )
    half = F.floor(F.col("__w") / 2)
    part = F.slice("__v", F.col("__s") - F.greatest(F.lit(0), F.col("__i") - reach) + 1, F.col("__w"))
    weighed = F.transform(part, lambda y, j: y * polynomial_weight(F.col("__w"), F.col("__i") - F.col("__s") - half, j - half, derivative))
    dot = F.aggregate(weighed, F.lit(0.0), lambda a, b: a + b)
    fits = (F.col("__n") >= 3) & (F.col("__n") >= F.col("__w"))
    return rows.withColumn(out, F.when(~fits, F.col(value).cast("double")).otherwise(F.nanvl(dot, F.lit(None).cast("double")))).drop("__n", "__i", "__v", "__w", "__s")


def _smoother(v: Column, window: int):
    """(the number of values, the smoothed value at a place) of an array of at least 3 values."""
    tables = F.array(*[F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in polynomial_rows(s)]) for s in range(3, window + 1, 2)])
    n = F.size(v)
    w = F.least(F.lit(window), n) - F.when(F.least(F.lit(window), n) % 2 == 0, 1).otherwise(0)

    def at(i: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(i - F.floor(w / 2), n - w)).cast("int")
        weights = F.get(F.get(tables, ((w - 3) / 2).cast("int")), i - start)
        return F.aggregate(F.zip_with(F.slice(v, start + 1, w.cast("int")), weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    return n, at


def smoothed_array(v: Column, window: int = 7) -> Column:
    """Each value of an array after smoothing, as polynomial_filter does with a group's values."""
    n, at = _smoother(v, window)
    return F.when(n < 3, v).otherwise(F.transform(v, lambda _, i: at(i)))


def smoothed_head(v: Column, window: int = 7, places: int = 2) -> Column:
    """The first values of smoothed_array, without the others."""
    n, at = _smoother(v, window)
    return F.when(n < 3, v).otherwise(F.transform(F.slice(v, 1, places), lambda _, i: at(i)))


def smoothed_tail(v: Column, window: int = 7, places: int = 7) -> Column:
    """The last values of smoothed_array, without the others."""
    n, at = _smoother(v, window)
    first = F.greatest(n - places, F.lit(0))
    return F.when(n < 3, v).otherwise(F.transform(F.slice(v, first + 1, F.lit(places)), lambda _, i: at(first + i)))


def last_slope(v: Column, window: int = 7) -> Column:
    """The slope that rolling_slope gives the last value of an array; null if it is empty."""
    last = F.slice(v, F.greatest(F.size(v) - window + 1, F.lit(1)), F.lit(window))
    slopes = F.flatten(F.transform(last, lambda a, i: F.transform(F.slice(last, i + 2, F.lit(window)), lambda b, k: (b - a) / (k + 1))))
    return F.when(F.size(v) == 0, None).when(F.size(v) == 1, F.lit(0.0)).otherwise(array_median(slopes))


def last_mean(v: Column, alpha: float = 0.5) -> Column:
    """The exponentially weighted mean at the end of an array, as ewma gives it; null without values."""
    start = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"), F.lit(1.0).alias("fade"))

    def step(a: Column, x: Column) -> Column:
        num, den, fade = a["num"] * a["fade"] + x, a["den"] * a["fade"] + 1, a["fade"] * (1 - alpha)
        on = F.struct(num.alias("num"), den.alias("den"), F.lit(1 - alpha).alias("fade"))
        return F.when(x.isNotNull(), on).otherwise(F.struct(a["num"].alias("num"), a["den"].alias("den"), fade.alias("fade")))

    return F.aggregate(v, start, step, lambda a: F.when(a["den"] > 0, a["num"] / a["den"]))


def array_median(a: Column) -> Column:
    """Median of an array by position; null if it is empty."""
    s = F.array_sort(a)
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def rolling_slope(df: DataFrame, value: str, index: str, keys: list[str], out: str, window: int = 7) -> DataFrame:
    """Median of all pairwise slopes in the trailing window; 0 at a group's first row."""
    frame = Window.partitionBy(*keys).orderBy(index).rowsBetween(1 - window, 0)
    rows = df.withColumn("__p", F.collect_list(F.struct(F.col(index).cast("double").alias("i"), F.col(value).cast("double").alias("y"))).over(frame))
    later = lambda a, k: F.transform(F.slice("__p", k + 2, F.lit(window)), lambda b: (b["y"] - a["y"]) / (b["i"] - a["i"]))
    slopes = F.flatten(F.transform("__p", later))
    return rows.withColumn(out, F.when(F.size("__p") < 2, F.lit(0.0)).otherwise(array_median(slopes))).drop("__p")


def first_difference(df: DataFrame, value: str, keys: list[str], order: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(value) - F.lag(value).over(ordered(keys, order)), F.lit(0.0)))


def nth_row(df: DataFrame, keys: list[str], order: list[str], n: int, required: str) -> DataFrame:
    """The row of 0-based number n of each group (from the end if negative), unless `required` is null there."""
    by = [F.col(c).asc() if n >= 0 else F.col(c).desc() for c in order]
    number = n + 1 if n >= 0 else -n
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("__k") == number).drop("__k").na.drop(subset=[required])


def changed(df: DataFrame, value: str, keys: list[str], order: list[str], out: str) -> DataFrame:
    """True where the value differs from the row before; true for the first row."""
    return df.withColumn(out, F.coalesce(F.col(value) != F.lag(value).over(ordered(keys, order)), F.lit(True)))


def cumulative(df: DataFrame, value: str, keys: list[str], order: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
