"""Feature table, imputation and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restora.constants import BY_PP, EWMA_ALPHA, SLOPE_WINDOW, SMOOTH_WINDOW, WEIGHTS
from restora.functions.series import last_mean, last_slope, smoothed_head, smoothed_tail
from restora.operators.sessions import last_week, skipped_days_blank, with_weeks


def pair_metrics(sessions: DataFrame, patients: DataFrame, scoring_date: Column, alpha: float = EWMA_ALPHA, smooth: int = SMOOTH_WINDOW, window: int = SLOPE_WINDOW) -> DataFrame:
    """One row per pair with sessions: usage, last week's usage and days, and where its series have got to.

    LAST_ADHERENCE and LAST_DELTA are the metrics of the last row, SECOND_DELTA is the progress at the
    second row of the pair's sessions joined with its difficulty values by date.  One grouping brings the
    rows of a pair together; its series are arrays, as long as a patient's sessions of one protocol.
    """
    week = last_week(patients, scoring_date)
    rows = skipped_days_blank(sessions).join(week, "PATIENT_ID", "left")
    recent = F.expr("SESSION_DATE >= WEEK_START and SESSION_DATE < WEEK_END")
    known = F.expr("SESSION_ID is not null and SESSION_DATE is not null and DM_VALUE is not null")
    one = rows.groupBy(*BY_PP).agg(
        F.array_sort(F.collect_set(F.when(recent, F.col("WEEKDAY_INDEX")))).alias("DAYS"),
        F.array_sort(F.collect_list(F.struct("SESSION_DATE", "WEEKDAY_INDEX", "PRESCRIPTION_ID", "SESSION_ID", F.col("ADHERENCE").cast("double").alias("x"), F.coalesce(recent, F.lit(False)).alias("w")))).alias("__s"),
        F.array_sort(F.collect_list(F.when(known, F.struct("SESSION_DATE", "SESSION_ID", F.col("DM_VALUE").cast("double").alias("x"))))).alias("__d"),
    )
    values = F.transform("__d", lambda r: r["x"])
    one = one.withColumns({"__head": smoothed_head(values, smooth), "__tail": smoothed_tail(values, smooth, window)})
    second = _second(F.col("__s"), F.col("__d"), F.col("__head"))
    # distinct counts as aggregates would copy every row for each of them, and shuffle the copies
    ids = lambda s: F.size(F.array_compact(F.array_distinct(F.transform(s, lambda r: r["SESSION_ID"])))).cast("bigint")
    return one.select(
        *BY_PP, ids(F.col("__s")).alias("USAGE"), ids(F.filter("__s", lambda r: r["w"])).alias("USAGE_WEEK"), "DAYS", F.size("__s").alias("SESSION_INDEX"),
        last_mean(F.transform("__s", lambda r: r["x"]), alpha).alias("LAST_ADHERENCE"),
        last_slope(F.col("__tail"), window).alias("LAST_DELTA"), second.alias("SECOND_DELTA"),
    )


def _second(s: Column, d: Column, head: Column) -> Column:
    """Progress at the second row of sessions s joined by date with difficulty values d, whose first smoothed values are in head."""
    first_day, second_day = (F.get(s, F.lit(k))["SESSION_DATE"] for k in (0, 1))
    dated = lambda k, day: F.get(d, F.lit(k))["SESSION_DATE"] == day
    step = F.get(head, F.lit(1)) - F.get(head, F.lit(0))
    at_second = F.when(dated(0, second_day), F.lit(0.0)).when(dated(1, second_day), step)
    return F.when(dated(0, first_day) & dated(1, first_day), step).when(F.size(s) > 1, at_second)


def replayed_metrics(sessions: DataFrame, patients: DataFrame, days: tuple[int, ...], alpha: float = EWMA_ALPHA, smooth: int = SMOOTH_WINDOW, window: int = SLOPE_WINDOW) -> DataFrame:
    """pair_metrics on each of the ascending days after the start (DAY), without a copy of the history for each.

    A pair's rows come together once, in order; one fold goes over them, carries the weighted mean along and sets
    down, on each of the days, how far it has come.  Usage, the last week and the slope are read off the rows up
    to there.
    """
    start = patients.groupBy("PATIENT_ID").agg(F.min("CLINICAL_TRIAL_START_DATE").alias("__start"))
    rows = skipped_days_blank(sessions).join(start, "PATIENT_ID").withColumn("o", F.datediff("SESSION_DATE", "__start"))
    known = F.expr("SESSION_ID is not null and SESSION_DATE is not null and DM_VALUE is not null")
    one = rows.groupBy(*BY_PP).agg(
        F.array_sort(F.collect_list(F.struct("SESSION_DATE", "WEEKDAY_INDEX", "PRESCRIPTION_ID", "SESSION_ID", F.col("ADHERENCE").cast("double").alias("x"), "o"))).alias("__s"),
        F.array_sort(F.collect_list(F.when(known, F.struct("SESSION_DATE", "SESSION_ID", F.col("DM_VALUE").cast("double").alias("x"), "o")))).alias("__d"),
    )
    marks = F.array(*[F.struct(F.lit(d).alias("o"), F.lit(True).alias("mark"), F.lit(0).alias("i"), F.lit(None).cast("double").alias("x")) for d in days])
    events = F.array_sort(F.concat(F.transform("__s", lambda r, i: F.struct(r["o"].alias("o"), F.lit(False).alias("mark"), i.alias("i"), r["x"].alias("x"))), marks))
    begin = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"), F.lit(1.0).alias("fade"), F.lit(0).alias("n"), F.array().cast("array<struct<DAY:int,N:int,MEAN:double>>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        seen = F.struct(e["o"].alias("DAY"), a["n"].alias("N"), F.when(a["den"] > 0, a["num"] / a["den"]).alias("MEAN"))
        hit = ~e["mark"] & e["x"].isNotNull()
        fade = F.when(hit, F.lit(1 - alpha)).when(e["mark"], a["fade"]).otherwise(a["fade"] * (1 - alpha))
        return F.struct(
            F.when(hit, a["num"] * a["fade"] + e["x"]).otherwise(a["num"]).alias("num"), F.when(hit, a["den"] * a["fade"] + 1).otherwise(a["den"]).alias("den"), fade.alias("fade"),
            (a["n"] + F.when(e["mark"], 0).otherwise(1)).alias("n"), F.when(e["mark"], F.array_append(a["out"], seen)).otherwise(a["out"]).alias("out"),
        )

    reached = F.filter(F.aggregate(events, begin, step)["out"], lambda m: m["N"] > 0)
    # one row for each day from here on, still in the task that has the pair; each step is a column of its own, so that nothing is computed twice
    on = one.withColumn("__out", reached).select(*BY_PP, "__s", "__d", F.inline("__out"))
    on = on.withColumns({"__s": F.slice("__s", F.lit(1), F.col("N")), "__v": F.filter("__d", lambda r: r["o"] <= F.col("DAY")), "__to": 7 * F.floor(F.col("DAY") / 7)})
    on = on.withColumns({"__w": F.filter("__s", lambda r: (r["o"] >= F.col("__to") - 7) & (r["o"] < F.col("__to"))), "__x": F.transform("__v", lambda r: r["x"])})
    on = on.withColumns({"__head": smoothed_head(F.col("__x"), smooth), "__tail": smoothed_tail(F.col("__x"), smooth, window)})
    ids = lambda c: F.size(F.array_compact(F.array_distinct(F.col(f"{c}.SESSION_ID")))).cast("bigint")
    return on.select(
        *BY_PP, "DAY", ids("__s").alias("USAGE"), ids("__w").alias("USAGE_WEEK"), F.array_sort(F.array_compact(F.array_distinct(F.col("__w.WEEKDAY_INDEX")))).alias("DAYS"),
        F.col("N").alias("SESSION_INDEX"), F.col("MEAN").alias("LAST_ADHERENCE"), last_slope(F.col("__tail"), window).alias("LAST_DELTA"), _second(F.col("__s"), F.col("__v"), F.col("__head")).alias("SECOND_DELTA"),
    )


def features(fits: DataFrame, sessions: DataFrame, patients: DataFrame, scoring_date: Column) -> DataFrame:
    """All pairs of fits with their metrics (nulls for pairs without sessions) and the patient's weeks."""
    return fits.join(pair_metrics(sessions, patients, scoring_date), BY_PP, "left").join(with_weeks(patients, scoring_date), "PATIENT_ID", "left")


def imputed(table: DataFrame, keys: tuple[str, ...] = ("PATIENT_ID",)) -> DataFrame:
    """Defaults for what is missing: 0 and no days; for DELTA_DM the patient's median of the pairs' second rows, for ADHERENCE_RECENT that of their last rows."""
    patient = Window.partitionBy(*keys)
    out = table.fillna(0, subset=["USAGE", "USAGE_WEEK", "WEEKS_SINCE_START", "SESSION_INDEX"]).withColumns({
        "DAYS": F.coalesce("DAYS", F.array().cast("array<int>")),
        "DELTA_DM": F.coalesce("LAST_DELTA", F.median("SECOND_DELTA").over(patient)),
        "ADHERENCE_RECENT": F.coalesce("LAST_ADHERENCE", F.median("LAST_ADHERENCE").over(patient)),
    })
    return out.drop("LAST_DELTA", "LAST_ADHERENCE", "SECOND_DELTA")


def replayed_features(fits: DataFrame, sessions: DataFrame, patients: DataFrame, days: tuple[int, ...]) -> DataFrame:
    """The feature table of all pairs on each of the ascending days after the patient's start (DAY).

    Fits, states and start come together by patient; days are only dealt out after that, so nothing is shuffled once a day.
    """
    names = ["USAGE", "USAGE_WEEK", "DAYS", "SESSION_INDEX", "LAST_ADHERENCE", "LAST_DELTA", "SECOND_DELTA"]
    state = F.struct(F.struct("PROTOCOL_ID", "DAY").alias("k"), F.struct(*names).alias("v"))
    pairs = replayed_metrics(sessions, patients, days).groupBy("PATIENT_ID").agg(F.map_from_entries(F.collect_list(state)).alias("__of"))
    own = [c for c in fits.columns if c not in BY_PP]
    wanted = fits.groupBy("PATIENT_ID").agg(F.collect_list(F.struct("PROTOCOL_ID", *own)).alias("__fits"))  # as many as protocols
    known = patients.select("PATIENT_ID").distinct().withColumn("__known", F.lit(True))
    rows = wanted.join(known, "PATIENT_ID", "left").join(pairs, "PATIENT_ID", "left").select("PATIENT_ID", "__of", "__known", F.inline("__fits"))
    rows = rows.withColumn("DAY", F.explode(F.array(*[F.lit(d) for d in days]))).withColumn("__one", F.try_element_at("__of", F.struct("PROTOCOL_ID", "DAY")))
    weeks = F.when(F.col("__known"), F.floor(F.col("DAY") / 7).cast("int")).alias("WEEKS_SINCE_START")
    return rows.select(*BY_PP, *own, "DAY", *[F.col(f"__one.{c}").alias(c) for c in names], weeks)


def scored(table: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """SCORE, the weighted sum of adherence, progress and fit; missing parts count as 0."""
    parts = [F.coalesce(F.col(c), F.lit(0.0)) * F.lit(float(w)) for c, w in zip(("ADHERENCE_RECENT", "DELTA_DM", "PPF"), weights, strict=True)]
    return table.withColumn("SCORE", parts[0] + parts[1] + parts[2])
