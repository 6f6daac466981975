"""Cohort analytics over sessions and scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restora.constants import BY_PP
from restora.functions.hashing import FACTORS
from restora.functions.series import ewma, first_difference
from restora.operators.sessions import first_of


def by_patient():
    return Window.partitionBy("PATIENT_ID")


def day_index(df: DataFrame) -> DataFrame:
    return df.withColumn("DAY_INDEX", F.datediff("SESSION_DATE", F.min("SESSION_DATE").over(by_patient())))


def study_range(df: DataFrame, days: int = 43) -> DataFrame:
    """The first `days` days of each patient."""
    return day_index(df).where(F.col("DAY_INDEX") < days)


def week_bins(df: DataFrame) -> DataFrame:
    """WEEK: 1-based bins of 7 days from the patient's first session; RELATIVE_WEEK: its dense rank."""
    rows = day_index(df).withColumn("WEEK", (F.floor(F.col("DAY_INDEX") / 7) + 1).cast("int"))
    return rows.withColumn("RELATIVE_WEEK", F.dense_rank().over(by_patient().orderBy("WEEK")))


def mean_and_spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, standard deviation, standard error, count and distinct patients by key."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("MEAN"),
        F.stddev_samp(value).alias("STD"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("SE"),
        F.count(value).alias("N"),
        F.count_distinct("PATIENT_ID").alias("PATIENTS"),
    )


def timepoints(df: DataFrame, keys: list[str], name: str, value: str, order: str) -> DataFrame:
    """One row per timepoint: distinct names, mean value, and name and value of the first row in order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias("NAMES"), F.avg(value).alias("MEAN"), F.min_by(name, order).alias("FIRST_NAME"), F.min_by(value, order).alias("FIRST_VALUE"))


def protocol_start_values(sessions: DataFrame, deltas: DataFrame) -> DataFrame:
    """Mean adherence and mean progress of each protocol; 0 where there is none."""
    a = sessions.groupBy("PROTOCOL_ID").agg(F.avg("ADHERENCE").alias("ADHERENCE"))
    d = deltas.groupBy("PROTOCOL_ID").agg(F.avg("DELTA_DM").alias("DM_DELTA"))
    return a.join(d, "PROTOCOL_ID", "left").fillna(0.0, subset=["ADHERENCE", "DM_DELTA"])


def weekly_change(df: DataFrame, value: str) -> DataFrame:
    """Sum by patient and week, then first, last and their difference."""
    weekly = df.groupBy("PATIENT_ID", "WEEK").agg(F.sum(value).alias("TOTAL"))
    out = weekly.groupBy("PATIENT_ID").agg(F.min_by("TOTAL", "WEEK").alias("FIRST"), F.max_by("TOTAL", "WEEK").alias("LAST"))
    return out.withColumn("DELTA", F.col("LAST") - F.col("FIRST"))


def trend(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Slope of y on x by group; null with fewer than two rows or without spread of x."""
    ok = (F.count(y) > 1) & (F.stddev_pop(x) > 0)
    return df.where(f"{y} is not null and {x} is not null").groupBy(*keys).agg(F.when(ok, F.regr_slope(y, x)).alias("SLOPE"))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts in bins of equal width; the largest value is in the last bin."""
    place = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(*keys, place.alias("BIN")).agg(F.count("*").alias("N"))


def cohort_summary(sessions: DataFrame, fits: DataFrame) -> DataFrame:
    """One row per patient: sessions, total duration of distinct sessions, day span, mean fit per session, protocols, mean slope, mean adherence."""
    once = sessions.where("SESSION_ID is not null").dropDuplicates(["PATIENT_ID", "SESSION_ID"])
    slopes = trend(day_index(once), BY_PP, "DM_VALUE", "DAY_INDEX").groupBy("PATIENT_ID").agg(F.avg("SLOPE").alias("MEAN_SLOPE"))
    rows = once.join(fits.select(*BY_PP, "PPF"), BY_PP, "left")
    out = rows.groupBy("PATIENT_ID").agg(
        F.count("*").alias("SESSIONS"),
        F.sum("DM_VALUE").alias("TOTAL"),
        F.datediff(F.max("SESSION_DATE"), F.min("SESSION_DATE")).alias("SPAN"),
        F.avg("PPF").alias("MEAN_PPF"),
        F.count_distinct("PROTOCOL_ID").alias("PROTOCOLS"),
        F.avg("ADHERENCE").alias("MEAN_ADHERENCE"),
    )
    return out.join(slopes, "PATIENT_ID", "left")


def average_rank(df: DataFrame, column: str, out: str, parts: int = 64) -> DataFrame:
    """Average ranks of the non-null values of a numeric column.

    Counts of distinct values are dealt into ranges by approximate quantiles and summed inside each; what
    lies before a range is one number for each of at most `parts` ranges.
    """
    bounds = sorted(set(df.select(F.col(column).cast("double").alias("v")).approxQuantile("v", [k / parts for k in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    limits = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__c"))
    counts = counts.withColumn("__part", F.size(F.filter(limits, lambda b: b < F.col(column))))
    before = counts.groupBy(F.col("__part").alias("__p")).agg(F.sum("__c").alias("__s"))
    before = before.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__b"))  # at most `parts` rows
    ranked = counts.join(F.broadcast(before), F.col("__part") == F.col("__p")).withColumn("__e", F.col("__b") + F.sum("__c").over(Window.partitionBy("__part").orderBy(column)))
    return df.join(ranked.select(F.col(column).alias("__v"), (F.col("__e") - (F.col("__c") - 1) / 2).alias(out)), F.col(column) == F.col("__v")).drop("__v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    rows = average_rank(average_rank(df.select(x, y).na.drop(), x, "__x"), y, "__y")
    return rows.agg(F.corr("__x", "__y").alias("RHO"), F.count("*").alias("N"))


def normal_equations(df: DataFrame, y: str, xs: list[str]) -> tuple[list[list[float]], list[float], int, float]:
    """X'X, X'y, the rows and y'y with an intercept first; one pass, (k + 1) squared numbers."""
    columns = ["1.0", *xs]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = [F.sum(F.expr(f"({columns[i]}) * ({columns[j]})")).alias(f"x{i}_{j}") for i, j in pairs]
    sums += [F.sum(F.expr(f"({c}) * ({y})")).alias(f"y{i}") for i, c in enumerate(columns)]
    r = df.select(y, *xs).na.drop().agg(*sums, F.count("*").alias("n"), F.sum(F.expr(f"({y}) * ({y})")).alias("yy")).first()
    xx = [[float(r[f"x{min(i, j)}_{max(i, j)}"] or 0) for j in range(len(columns))] for i in range(len(columns))]
    return xx, [float(r[f"y{i}"] or 0) for i in range(len(columns))], r["n"], float(r["yy"] or 0)


def two_sided_p(t: float, freedom: int) -> float:
    """Probability of a larger |t| under Student's distribution, from the incomplete beta function's continued fraction."""
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    if x <= 0:
        return 1.0 if flip else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 0.0  # from the innermost term of the fraction outwards
    for k in range(400, 0, -1):
        m = k // 2
        term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = term / (1 + value)
    part = front / (1 + value)
    return 1 - part if flip else part


def linear_model(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """TERM, COEFFICIENT, STD_ERROR, T, P (two-sided) and R2 of ordinary least squares; none if the system has no solution."""
    import numpy as np

    xx, xy, n, yy = normal_equations(df, y, xs)
    a, b = np.array(xx), np.array(xy)
    spark, schema = df.sparkSession, "TERM string, COEFFICIENT double, STD_ERROR double, T double, P double, R2 double"
    if n <= len(b) or np.linalg.matrix_rank(a) < len(b):
        return spark.createDataFrame([], schema)
    beta, inverse = np.linalg.solve(a, b), np.linalg.inv(a)
    rest, spread = yy - float(beta @ b), yy - b[0] ** 2 / n
    error = np.sqrt(np.maximum(rest / (n - len(b)) * np.diag(inverse), 0))
    r2 = 1 - rest / spread if spread > 0 else float("nan")
    rows = [(t, float(c), float(e), float(c / e) if e > 0 else None, two_sided_p(float(c / e), n - len(b)) if e > 0 else None, float(r2)) for t, c, e in zip(["(intercept)", *xs], beta, error, strict=True)]
    return spark.createDataFrame(rows, schema)


def diagnostics(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """FITTED, RESIDUAL, LEVERAGE, STUDENTIZED and COOKS of every row with all values."""
    import numpy as np

    xx, xy, n, yy = normal_equations(df, y, xs)
    a, b = np.array(xx), np.array(xy)
    beta, inverse = np.linalg.solve(a, b), np.linalg.inv(a)
    mse = (yy - float(beta @ b)) / (n - len(b))
    terms: list[Column] = [F.lit(1.0), *[F.col(x) for x in xs]]
    fitted, h = F.lit(0.0), F.lit(0.0)
    for i, u in enumerate(terms):
        fitted = fitted + F.lit(float(beta[i])) * u
        for j, v in enumerate(terms):
            h = h + F.lit(float(inverse[i, j])) * u * v
    rows = df.na.drop(subset=[y, *xs]).withColumns({"FITTED": fitted, "LEVERAGE": h}).withColumn("RESIDUAL", F.col(y) - F.col("FITTED"))
    student = F.col("RESIDUAL") / F.sqrt(F.lit(mse) * (1 - F.col("LEVERAGE")))
    cooks = F.pow(F.col("STUDENTIZED"), 2) * F.col("LEVERAGE") / (1 - F.col("LEVERAGE")) / len(b)
    return rows.withColumn("STUDENTIZED", student).withColumn("COOKS", cooks)


def partial_residuals(df: DataFrame, y: str, x: str, others: list[str]) -> DataFrame:
    """Residuals of y and of x after regression on the others."""
    rows = df.na.drop(subset=[y, x, *others])
    first = diagnostics(rows, y, others).withColumn("Y_RESIDUAL", F.col("RESIDUAL")).select(*df.columns, "Y_RESIDUAL")
    return diagnostics(first, x, others).select(*df.columns, "Y_RESIDUAL", F.col("RESIDUAL").alias("X_RESIDUAL"))


#: Names of the moments that mediation needs: the weight, and weighted sums and products of x, m and y.
MOMENTS = ("n", "sx", "sm", "sy", "sxx", "sxm", "sxy", "smm", "smy")


def _effects(t: DataFrame, keys: list[str]) -> DataFrame:
    """A, B, DIRECT and INDIRECT from rows (keys, MOMENTS)."""
    cov = lambda a, b: F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("n")
    det = cov("x", "x") * cov("m", "m") - cov("x", "m") * cov("x", "m")
    out = t.where(F.col("n") > 2).withColumns({
        "A": F.try_divide(cov("x", "m"), cov("x", "x")),
        "B": F.try_divide(cov("m", "y") * cov("x", "x") - cov("x", "m") * cov("x", "y"), det),
        "DIRECT": F.try_divide(cov("x", "y") * cov("m", "m") - cov("x", "m") * cov("m", "y"), det),
    })
    return out.withColumn("INDIRECT", F.col("A") * F.col("B")).select(*keys, "A", "B", "DIRECT", "INDIRECT")


def mediation_terms(df: DataFrame, keys: list[str], x: str, m: str, y: str, weight: Column | None = None) -> DataFrame:
    """A (x on m), B (m on y beside x), DIRECT and INDIRECT effects by group, from weighted moments."""
    w = F.lit(1.0) if weight is None else weight
    rows = df.na.drop(subset=[x, m, y]).select(*keys, w.cast("double").alias("__w"), *[F.col(c).cast("double").alias(f"__{n}") for n, c in zip("xmy", (x, m, y), strict=True)])
    sums = [F.sum(F.expr(" * ".join(["__w", *(f"__{c}" for c in name[1:])] if name != "n" else ["__w"]))).alias(name) for name in MOMENTS]
    return _effects(rows.groupBy(*keys).agg(*sums), keys)


def draw_weights(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Poisson(1) numbers (keys x draws) from functions.hashing.mixed of each key and draw."""
    h = (keys % (1 << 31)).astype(np.uint32)[:, None] * np.uint32(FACTORS[0]) + draws.astype(np.uint32)[None, :] * np.uint32(FACTORS[1])
    spare = np.empty_like(h)
    for shift, factor in ((15, FACTORS[2]), (13, FACTORS[3]), (16, 1)):
        np.right_shift(h, np.uint32(shift), out=spare)
        h ^= spare
        h *= np.uint32(factor)
    out, hit = np.zeros(h.shape, dtype=np.uint8), np.empty(h.shape, dtype=bool)
    for bound in POISSON:
        np.greater_equal(h, np.uint32(bound), out=hit)
        out += hit.view(np.uint8)
    return out


#: Where the 32-bit hash of a draw passes from k to k + 1: 2^32 times the share of Poisson(1) numbers up to k.
POISSON = tuple(int((1 << 32) * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8))


#: Rows of a block of draws: its arrays stay in a core's cache.
DRAWN = 64


def draw_moments(df: DataFrame, x: str, m: str, y: str, key: str, draws: int) -> DataFrame:
    """DRAW and the MOMENTS of every bootstrap draw.

    A task holds the moments of all draws as one array, to which it adds blocks of rows (as a product of weights and
    values), and gives them out at its end: what is shuffled is tasks x draws x 9 numbers, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = np.arange(1, draws + 1), np.zeros((draws, len(MOMENTS)))
        for batch in batches:
            for start in range(0, batch.num_rows, DRAWN):
                k, a, b, c = (batch.column(i).slice(start, DRAWN).to_numpy() for i in range(4))
                values = np.column_stack([np.ones(len(k)), a, b, c, a * a, a * b, a * c, b * b, b * c])
                total += draw_weights(k, number).T.astype(np.float64) @ values
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), *(pa.array(c) for c in total.T.copy())], names=["DRAW", *MOMENTS])

    rows = df.na.drop(subset=[x, m, y, key]).select(F.col(key).cast("long").alias("k"), *[F.col(c).cast("double").alias(c2) for c, c2 in ((x, "a"), (m, "b"), (y, "c"))])
    each = rows.mapInArrow(run, "DRAW int, " + ", ".join(f"{n} double" for n in MOMENTS))
    return each.groupBy("DRAW").agg(*[F.sum(n).alias(n) for n in MOMENTS])


def mediation_interval(df: DataFrame, x: str, m: str, y: str, key: str, draws: int = 5000, level: float = 0.95) -> DataFrame:
    """LOW and HIGH of the bootstrap interval of the indirect effect, and the number of DRAWS that gave one; rows without a key take no part."""
    each = _effects(draw_moments(df, x, m, y, key, draws), ["DRAW"])
    tail = (1 - level) / 2
    return each.agg(F.percentile("INDIRECT", F.lit(tail)).alias("LOW"), F.percentile("INDIRECT", F.lit(1 - tail)).alias("HIGH"), F.count("INDIRECT").alias("DRAWS"))


def signal_to_noise(df: DataFrame, keys: list[str], fit: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.try_divide(F.var_pop(fit), F.var_pop(F.col(value) - F.col(fit))).alias("SNR"))


def protocol_counts(df: DataFrame, protocols: list[int]) -> DataFrame:
    """Rows by patient, with a column for each protocol; 0 where there is none."""
    return df.groupBy("PATIENT_ID").pivot("PROTOCOL_ID", protocols).count().fillna(0)


def adherence_matrix(df: DataFrame, protocols: list[int]) -> DataFrame:
    """Mean adherence by patient and protocol; 0 where there is none."""
    return df.groupBy("PATIENT_ID").pivot("PROTOCOL_ID", protocols).agg(F.avg("ADHERENCE")).fillna(0.0)


def matrix_margins(df: DataFrame) -> DataFrame:
    """AXIS, KEY and MEAN: the means of the matrix's known cells by patient and by protocol."""
    cells = df.groupBy(*BY_PP).agg(F.avg("ADHERENCE").alias("__a"))
    by = lambda axis, key: cells.groupBy(F.lit(axis).alias("AXIS"), F.col(key).alias("KEY")).agg(F.avg("__a").alias("MEAN"))
    return by("patient", "PATIENT_ID").unionByName(by("protocol", "PROTOCOL_ID"))


def session_weeks(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """rows (PATIENT_ID, SESSION_ID, ...) with the WEEK of their session in the patient's trial; null where the session is unknown."""
    weeks = week_bins(sessions.where("SESSION_ID is not null")).groupBy("PATIENT_ID", "SESSION_ID").agg(F.min("WEEK").alias("WEEK"))
    return rows.join(weeks, ["PATIENT_ID", "SESSION_ID"], "left")


def axis_order(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rank of each key by its mean; keys are few (an axis)."""
    means = df.groupBy(key).agg(F.avg(value).alias("MEAN"))
    return means.withColumn("PLACE", F.row_number().over(Window.orderBy(F.desc("MEAN"), key)))


def z_scores(df: DataFrame, value: str) -> DataFrame:
    """(value - mean) / population deviation over all rows; the two numbers come from one aggregate row."""
    stats = df.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.join(stats).withColumn("Z", F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def min_max(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn(out, F.try_divide(F.col(value) - F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)))


def log_growth(df: DataFrame, keys: list[str], y: str, index: str) -> DataFrame:
    """a ln(x + 1) + b by group, with R2; x counts from 1."""
    x = F.ln(F.col(index) + 1)
    rows = df.withColumn("__x", x).where(f"{y} is not null")
    return rows.groupBy(*keys).agg(F.regr_slope(y, "__x").alias("A"), F.regr_intercept(y, "__x").alias("B"), F.regr_r2(y, "__x").alias("R2"), F.count("*").alias("N"))


#: Grids of the growth fits: rates per length of a series, and midpoints as shares of it.
RATES, STEEPNESS, MIDDLES = [2.0 ** (k / 2) for k in range(-6, 12)], [2.0 ** (k / 2) for k in range(-2, 14)], [k / 8 for k in range(-4, 13)]


def _series(df: DataFrame, keys: list[str], y: str, index: str) -> DataFrame:
    """keys, XS and YS of each series of three or more, in order of index; a series is as long as a patient's sessions of one protocol."""
    rows = df.where(f"{y} is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(index).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("__r"))
    return rows.select(*keys, F.transform("__r", lambda r: r["x"]).alias("XS"), F.transform("__r", lambda r: r["y"]).alias("YS")).where(F.size("YS") > 2)


#: Values of whole series that are fitted at a time, so that the arrays of one step stay in a core's cache.
BLOCK = 1 << 15


class _Block:
    """Whole series one behind another: their values, and sums by series."""

    def __init__(self, x: np.ndarray, y: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.y, self.starts, self.sizes, self.n = y, starts, sizes, sizes.astype(np.float64)
        self.low = np.minimum.reduceat(x, starts)
        self.span = np.maximum(np.maximum.reduceat(x, starts) - self.low, 1.0)
        self.x, self.sy, self.syy = x, self.sum(y), self.sum(y * y)
        self.spread = self.syy - self.sy * self.sy / self.n

    def each(self, v: np.ndarray) -> np.ndarray:
        """A value of each series beside all values of the series."""
        return np.repeat(v, self.sizes)

    def sum(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, self.starts)


class _Least:
    """The fit of least error (to nine digits) of each series among those offered; ties go to the smaller parameters."""

    def __init__(self, many: int, parameters: int, others: int):
        self.error, self.values = np.full(many, np.inf), [np.full(many, np.inf) for _ in range(parameters)] + [np.zeros(many) for _ in range(others)]
        self.sse, self.parameters = np.full(many, np.nan), parameters

    def offer(self, sse: np.ndarray, *values: np.ndarray) -> None:
        error = np.round(sse, 9)
        error[np.isnan(error)] = np.inf
        better, even = error < self.error, error == self.error
        for new, old in zip(values[: self.parameters], self.values, strict=False):
            better, even = better | (even & (new < old)), even & (new == old)
        for old, new in zip([self.error, self.sse, *self.values], [error, sse, *values], strict=True):
            np.copyto(old, new, where=better)


def _exponential(b: _Block, rounds: int) -> list[np.ndarray]:
    """A, B, C and SSE of the series of a block."""

    def search(rates: list[np.ndarray]) -> _Least:
        best = _Least(len(b.n), 1, 2)
        for rate in rates:
            e = np.exp(-b.each(rate) * b.x)
            se, see, sey = b.sum(e), b.sum(e * e), b.sum(e * b.y)
            det, slope = see - se * se / b.n, sey - se * b.sy / b.n
            a = np.divide(slope, det, out=np.zeros_like(det), where=det > 1e-12)
            best.offer(np.maximum(b.spread - a * slope, 0.0), rate, a, (b.sy - a * se) / b.n)
        return best

    best = search([r / b.span for r in RATES])
    for k in range(rounds):
        step, rate = 2.0 ** (0.25 / 2**k), best.values[0]
        best = search([rate / step, rate, rate * step])
    rate, a, c = best.values
    return [a, rate, c, best.sse]


def _logistic(b: _Block, rounds: int) -> list[np.ndarray]:
    """K, X0, L and SSE of the series of a block."""

    def offer(best: _Least, e: np.ndarray, k: np.ndarray, x0: np.ndarray) -> None:
        s = 1 / (1 + e)
        ss, sys = b.sum(s * s), b.sum(s * b.y)
        top = np.divide(sys, ss, out=np.zeros_like(ss), where=ss > 1e-12)
        best.offer(np.maximum(b.syy - top * sys, 0.0), k, x0, top)

    best, x = _Least(len(b.n), 2, 1), b.x - b.each(b.low)
    for q in STEEPNESS:
        k = q / b.span
        fall = np.exp(-b.each(k) * x)  # for all midpoints
        for m in MIDDLES:  # k (x0 - first x) is q m for every series
            offer(best, fall * math.exp(q * m), k, b.low + m * b.span)
    for r in range(rounds):
        step, move, (k0, x0, _) = 2.0 ** (0.25 / 2**r), b.span / (16.0 * 2**r), best.values
        best = _Least(len(b.n), 2, 1)
        for k in (k0 / step, k0, k0 * step):
            fall = np.exp(-b.each(k) * x)
            for at in (x0 - move, x0, x0 + move):
                offer(best, fall * b.each(np.exp(k * (at - b.low))), k, at)
    return [*best.values, best.sse]


def _fitted(rows: DataFrame, keys: list[str], fit: Callable[[_Block, int], list[np.ndarray]], rounds: int, names: tuple[str, ...]) -> DataFrame:
    """keys, what fit finds for each series under names, R2 and N.  Tasks fit blocks of whole series at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            xs, ys = batch.column(len(keys)), batch.column(len(keys) + 1)
            offsets = ys.offsets.to_numpy()
            offsets, x, y = offsets - offsets[0], xs.flatten().to_numpy(zero_copy_only=False), ys.flatten().to_numpy(zero_copy_only=False)
            cuts, parts = [0], []
            while cuts[-1] < batch.num_rows:
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offsets, offsets[cuts[-1]] + BLOCK, "right")) - 1))
            for i, j in zip(cuts, cuts[1:], strict=False):
                low, high = offsets[i], offsets[j]
                b = _Block(x[low:high], y[low:high], offsets[i:j] - low, np.diff(offsets[i : j + 1]))
                with np.errstate(all="ignore"):
                    found = fit(b, rounds)
                    r2 = np.where(b.spread > 0, 1 - found[-1] / b.spread, np.nan)
                parts.append([*found, r2])
            values = [np.concatenate(v) for v in zip(*parts, strict=True)]
            r2 = pa.array(values[-1], mask=np.isnan(values[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(v) for v in values[:-1]), r2, pa.array(np.diff(offsets).astype(np.int64))], names=[*keys, *names, "R2", "N"])

    fields = [T.StructField(n, T.DoubleType()) for n in (*names, "R2")]
    schema = T.StructType([*[rows.schema[k] for k in keys], *fields, T.StructField("N", T.LongType())])
    return rows.select(*keys, "XS", "YS").mapInArrow(run, schema)


def exponential_growth(df: DataFrame, keys: list[str], y: str, index: str, rounds: int = 12) -> DataFrame:
    """a e^(-b x) + c by group with R2, for groups of three or more; the rate b is searched, the rest is linear.

    The grid of rates follows the length of a series; each further round looks half as far around the best.
    """
    return _fitted(_series(df, keys, y, index), keys, _exponential, rounds, ("A", "B", "C", "SSE"))


def logistic_growth(df: DataFrame, keys: list[str], y: str, index: str, rounds: int = 12) -> DataFrame:
    """L / (1 + e^(-k (x - x0))) by group with R2, for groups of three or more; k and x0 are searched, L is in closed form."""
    return _fitted(_series(df, keys, y, index), keys, _logistic, rounds, ("K", "X0", "L", "SSE"))


def filled_daily(df: DataFrame, keys: list[str], day: str, value: str, order: str) -> DataFrame:
    """The last value of each day, on all days between a group's first and last, carried forward."""
    last = df.groupBy(*keys, day).agg(F.max_by(value, order).alias(value))
    days = last.groupBy(*keys).agg(F.explode(F.sequence(F.min(day), F.max(day))).alias(day))
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return days.join(last, [*keys, day], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


def cumulative_weeks(df: DataFrame) -> DataFrame:
    """Every row once for each week of its patient from its own on, as UP_TO: a replay of all weeks in one table."""
    weeks = df.select("PATIENT_ID", F.col("WEEK").alias("UP_TO")).distinct()
    return df.join(weeks, "PATIENT_ID").where("WEEK <= UP_TO")


def outcome_change(scores: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Change of SCORE from one evaluation to another."""
    return scores.groupBy(*keys).agg((F.max(F.when(F.col("EVALUATION") == after, F.col("SCORE"))) - F.max(F.when(F.col("EVALUATION") == before, F.col("SCORE")))).alias("CHANGE"))


def weighted_profile(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key and RATIO of total weighted scores after and before, from rows (key, SCORE, WEIGHT)."""
    a = before.groupBy(key).agg(F.sum(F.col("SCORE") * F.col("WEIGHT")).alias("__b"))
    b = after.groupBy(key).agg(F.sum(F.col("SCORE") * F.col("WEIGHT")).alias("__a"))
    return a.join(b, key).select(key, F.try_divide("__a", "__b").alias("RATIO"))


def completed_share(done: Column, prescribed: Column) -> Column:
    """Adherence as completed over prescribed duration, 1 at most; null where nothing is prescribed or done is unknown."""
    return F.when((prescribed > 0) & done.isNotNull(), F.least(done / prescribed, F.lit(1.0)))


def composite(ppf: Column, delta: Column, adherence: Column, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    """a * fit + b * progress + c * adherence of a timepoint."""
    return F.lit(weights[0]) * ppf + F.lit(weights[1]) * delta + F.lit(weights[2]) * adherence


def early_scores(fits: DataFrame, sessions: DataFrame, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """SCORE of every pair from its last known values; pairs never played count as fully adherent without progress."""
    order = F.struct("SESSION_DATE", "event_id")
    last = sessions.groupBy(*BY_PP).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("ADHERENCE", "DM_VALUE")])
    rows = fits.join(last, BY_PP, "left").fillna({"ADHERENCE": 1.0, "DM_VALUE": 0.0})
    return rows.withColumn("SCORE", composite(F.col("PPF"), F.col("DM_VALUE"), F.col("ADHERENCE"), weights))


def session_metrics(sessions: DataFrame, alpha: float = 0.5) -> DataFrame:
    """The last row of each session, with the weighted mean, the difference and the difference of weighted means of its pair's series."""
    rows = sessions.where("SESSION_ID is not null and DM_VALUE is not null")
    order = ["SESSION_DATE", "SESSION_ID", "event_id"]
    rows = first_difference(ewma(rows, "DM_VALUE", BY_PP, order, "DM_EWMA", alpha), "DM_VALUE", BY_PP, order, "DM_DELTA")
    rows = first_difference(rows, "DM_EWMA", BY_PP, order, "EWMA_DELTA")
    return first_of(rows, [*BY_PP, "SESSION_ID"], ["event_id"], last=True)
