"""Session operators: expected sessions, trial window, recent adherence, progress, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restora.constants import BY_PP, EWMA_ALPHA, NOT_PERFORMED, SLOPE_WINDOW, SMOOTH_WINDOW
from restora.functions.dates import expected_dates, weeks_since
from restora.functions.series import ewma, polynomial_filter, rolling_slope, session_index

PRESCRIBED = ["PRESCRIPTION_ID", "PATIENT_ID", "PROTOCOL_ID", "PRESCRIPTION_STARTING_DATE", "PRESCRIPTION_ENDING_DATE", "WEEKDAY_INDEX"]
IN_ORDER = ["SESSION_DATE", "WEEKDAY_INDEX", "PRESCRIPTION_ID", "SESSION_ID"]


def first_of(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in order."""
    by = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("__k = 1").drop("__k")


def expected_sessions(sessions: DataFrame, today: Column) -> DataFrame:
    """PRESCRIBED columns and SESSION_DATE of every date that a prescription asks for, up to the patient's last session (or today)."""
    last = sessions.where("SESSION_DATE is not null").groupBy("PATIENT_ID").agg(F.max("SESSION_DATE").alias("LAST_DATE"))
    own = sessions.select(*PRESCRIBED).distinct().na.drop(subset=["PRESCRIPTION_STARTING_DATE", "PRESCRIPTION_ENDING_DATE", "WEEKDAY_INDEX"])
    end = F.least("PRESCRIPTION_ENDING_DATE", F.coalesce("LAST_DATE", today))
    dates = expected_dates(F.col("PRESCRIPTION_STARTING_DATE"), end, F.col("WEEKDAY_INDEX"))
    return own.join(last, "PATIENT_ID", "left").select(*PRESCRIBED, F.explode(dates).alias("SESSION_DATE"))


def with_missing_sessions(sessions: DataFrame, today: Column) -> DataFrame:
    """Dated sessions, and a NOT_PERFORMED row for each expected date on which the prescription has none.

    One pass over the sessions of each patient: a prescription's first row brings the dates that it lacks.
    """
    prescription = Window.partitionBy("PATIENT_ID", "PRESCRIPTION_ID")
    no_dates = F.array().cast("array<date>")
    rows = sessions.withColumns({
        "__last": F.max("SESSION_DATE").over(Window.partitionBy("PATIENT_ID")),
        "__performed": F.when(F.col("PRESCRIPTION_ID").isNotNull(), F.collect_set("SESSION_DATE").over(prescription)).otherwise(no_dates),
        "__row": F.row_number().over(Window.partitionBy("PATIENT_ID", *[c for c in PRESCRIBED if c != "PATIENT_ID"]).orderBy("SESSION_DATE")),
    })
    end = F.least("PRESCRIPTION_ENDING_DATE", F.coalesce("__last", today))
    dates = expected_dates(F.col("PRESCRIPTION_STARTING_DATE"), end, F.col("WEEKDAY_INDEX"))
    whole = F.expr("PRESCRIPTION_STARTING_DATE is not null and PRESCRIPTION_ENDING_DATE is not null and WEEKDAY_INDEX is not null")
    lacking = F.when((F.col("__row") == 1) & whole, F.array_except(dates, "__performed")).otherwise(no_dates)
    own = F.when(F.col("SESSION_DATE").isNotNull(), F.array("SESSION_DATE")).otherwise(no_dates)
    each = F.concat(F.transform(own, lambda d: F.struct(d.alias("day"), F.lit(True).alias("real"))), F.transform(lacking, lambda d: F.struct(d.alias("day"), F.lit(False).alias("real"))))
    out = rows.withColumn("__d", F.explode(each))
    fixed = {"STATUS": F.lit(NOT_PERFORMED), "ADHERENCE": F.lit(0.0)} | {c: F.lit(0) for c in ("SESSION_DURATION", "REAL_SESSION_DURATION") if c in sessions.columns}
    filled = lambda c: F.when(F.col("__d.real"), F.col(c)).otherwise(fixed[c]) if c in fixed else F.when(F.col("__d.real"), F.col(c))
    columns = [F.col("__d.day").alias(c) if c == "SESSION_DATE" else F.col(c) if c in PRESCRIBED else filled(c).cast(sessions.schema[c].dataType).alias(c) for c in sessions.columns]
    return out.select(*columns)


def in_trial(sessions: DataFrame, patients: DataFrame, scoring_date: Column) -> DataFrame:
    """Sessions between the start of the trial and its end or the scoring date, whichever is first."""
    dates = patients.select("PATIENT_ID", "CLINICAL_TRIAL_START_DATE", "CLINICAL_TRIAL_END_DATE")
    both = sessions.join(dates, "PATIENT_ID")
    return both.where(F.col("SESSION_DATE").between(F.col("CLINICAL_TRIAL_START_DATE"), F.least("CLINICAL_TRIAL_END_DATE", scoring_date)))


def skipped_days_blank(sessions: DataFrame) -> DataFrame:
    """ADHERENCE becomes null on days on which the patient performed nothing."""
    skipped = F.bool_and(F.coalesce(F.col("STATUS") == NOT_PERFORMED, F.lit(False))).over(Window.partitionBy("PATIENT_ID", "SESSION_DATE"))
    return sessions.withColumn("ADHERENCE", F.when(~skipped, F.col("ADHERENCE")))


def recent_adherence(sessions: DataFrame, alpha: float = EWMA_ALPHA) -> DataFrame:
    """BY_PP, SESSION_DATE, STATUS, SESSION_INDEX and ADHERENCE_RECENT of every session row."""
    rows = session_index(skipped_days_blank(sessions), BY_PP, IN_ORDER)
    return ewma(rows, "ADHERENCE", BY_PP, ["SESSION_INDEX"], "ADHERENCE_RECENT", alpha).select(*BY_PP, "SESSION_DATE", "STATUS", "SESSION_INDEX", "ADHERENCE_RECENT")


def progress(sessions: DataFrame, smooth: int = SMOOTH_WINDOW, window: int = SLOPE_WINDOW) -> DataFrame:
    """BY_PP, SESSION_DATE, DM_INDEX, DM_SMOOTH and DELTA_DM of sessions with a difficulty value."""
    rows = sessions.select(*BY_PP, "SESSION_ID", "SESSION_DATE", "DM_VALUE").na.drop()
    rows = session_index(rows, BY_PP, ["SESSION_DATE", "SESSION_ID"], "DM_INDEX")
    rows = polynomial_filter(rows, "DM_VALUE", BY_PP, ["DM_INDEX"], "DM_SMOOTH", smooth)
    rows = rolling_slope(rows, "DM_SMOOTH", "DM_INDEX", BY_PP, "DELTA_DM", window)
    return rows.select(*BY_PP, "SESSION_DATE", "DM_INDEX", "DM_SMOOTH", F.coalesce("DELTA_DM", F.lit(0.0)).alias("DELTA_DM"))


def usage(sessions: DataFrame) -> DataFrame:
    """Distinct performed sessions of each patient and protocol."""
    return sessions.groupBy(*BY_PP).agg(F.count_distinct("SESSION_ID").alias("USAGE"))


def with_weeks(patients: DataFrame, scoring_date: Column) -> DataFrame:
    """PATIENT_ID and WEEKS_SINCE_START, one row per patient."""
    own = patients.groupBy("PATIENT_ID").agg(F.min("CLINICAL_TRIAL_START_DATE").alias("__s"), F.max(scoring_date).alias("__d"))
    return own.select("PATIENT_ID", weeks_since(F.col("__s"), F.col("__d")).alias("WEEKS_SINCE_START"))


def last_week(patients: DataFrame, scoring_date: Column) -> DataFrame:
    """PATIENT_ID, WEEK_START and WEEK_END (exclusive) of the last completed week of the trial; none before the first is over."""
    own = patients.groupBy("PATIENT_ID").agg(F.min("CLINICAL_TRIAL_START_DATE").alias("__s"), F.max(scoring_date).alias("__d"))
    weeks = own.withColumn("__w", weeks_since(F.col("__s"), F.col("__d"))).where("__w > 0")
    return weeks.select("PATIENT_ID", F.date_add("__s", (F.col("__w") - 1) * 7).alias("WEEK_START"), F.date_add("__s", F.col("__w") * 7).alias("WEEK_END"))


def week_usage(sessions: DataFrame, patients: DataFrame, scoring_date: Column) -> DataFrame:
    """USAGE_WEEK and DAYS (sorted weekdays) of the last completed week, in one aggregation."""
    both = sessions.join(last_week(patients, scoring_date), "PATIENT_ID").where("SESSION_DATE >= WEEK_START and SESSION_DATE < WEEK_END")
    return both.groupBy(*BY_PP).agg(F.count_distinct("SESSION_ID").alias("USAGE_WEEK"), F.array_sort(F.collect_set("WEEKDAY_INDEX")).alias("DAYS"))


def total_prescribed(sessions: DataFrame, order: list[str] = IN_ORDER) -> DataFrame:
    """TOTAL_PRESCRIBED: the sessions of the pair up to each row, in the given order."""
    return session_index(sessions, BY_PP, order, "TOTAL_PRESCRIBED")
