"""What keeps patients from being scored, as rows (PATIENT_ID, REASON) instead of errors, so that a run goes on with the others.

Each check reads its table once.  Reasons are fixed phrases with the name of what is at fault.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restora.constants import SCALE_FEATURES
from restora.operators import fit


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with columns cast to `types`, and ERROR: the columns whose value is there but can't be cast (null if there are none)."""
    cast = lambda c, t: F.expr(f"try_cast(`{c}` as {t})")
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & cast(c, t).isNull(), F.lit(c)) for c, t in types.items()]))
    marked = df.withColumn("ERROR", F.when(F.size(bad) > 0, F.concat(F.lit("bad "), F.array_join(bad, ", "))))
    return marked.withColumns({c: cast(c, t) for c, t in types.items()})


def of_rows(df: DataFrame) -> DataFrame:
    """The reasons of rows with an ERROR."""
    return df.where("ERROR is not null").select("PATIENT_ID", F.col("ERROR").alias("REASON")).distinct()


def of_dates(patients: DataFrame) -> DataFrame:
    """Patients without a start date, and those whose trial ends before it starts."""
    start, end = F.min("CLINICAL_TRIAL_START_DATE"), F.max("CLINICAL_TRIAL_END_DATE")
    reason = F.when(start.isNull(), "no start date").when(end < start, "trial ends before it starts")
    return patients.groupBy("PATIENT_ID").agg(reason.alias("REASON")).where("REASON is not null")


def unknown(wanted: DataFrame, patients: DataFrame) -> DataFrame:
    """Wanted patients that the table of patients doesn't have."""
    return wanted.select("PATIENT_ID").distinct().join(patients.select("PATIENT_ID"), "PATIENT_ID", "left_anti").withColumn("REASON", F.lit("unknown patient"))


def clinical_scores(patients: DataFrame, column: str = "CLINICAL_SCORES") -> DataFrame:
    """PATIENT_ID, SCALE (canonical), SCORE, DEFICIT and ERROR of the last evaluation of each patient's document.

    A document that is missing or can't be read, a score that is no number, and a scale without a maximum give a
    row with an ERROR and without a DEFICIT.
    """
    last = F.try_element_at(F.from_json(column, "array<map<string,string>>"), F.lit(-1))
    read = patients.select("PATIENT_ID", F.col(column).isNull().alias("__none"), last.alias("__m"))
    parts = F.filter(F.map_entries("__m"), lambda e: F.coalesce(e["value"].startswith("{"), F.lit(False)))
    inner = lambda e: F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda s: F.struct(F.concat_ws(".", e["key"], s["key"]).alias("SCALE"), s["value"].alias("TEXT")))
    rows = read.select("PATIENT_ID", "__none", F.col("__m").isNull().alias("__bad"), F.explode_outer(F.flatten(F.transform(parts, inner))).alias("s"))
    rows = fit.canonical_scales(rows.select("PATIENT_ID", "__none", "__bad", "s.SCALE", "s.TEXT"))
    rows = rows.join(F.broadcast(fit.maxima(patients.sparkSession)), "SCALE", "left").withColumn("SCORE", F.expr("try_cast(TEXT as double)"))  # a fixed table
    error = (
        F.when(F.col("__none"), "no clinical scores")
        .when(F.col("__bad"), "unreadable clinical scores")
        .when(F.col("SCALE").isNull(), "no clinical scores")
        .when(F.col("TEXT").isNotNull() & F.col("SCORE").isNull(), F.concat(F.lit("no number for scale "), "SCALE"))
        .when(F.col("MAXIMUM").isNull(), F.concat(F.lit("no maximum for scale "), "SCALE"))
    )
    return rows.select("PATIENT_ID", "SCALE", "SCORE", (1 - F.col("SCORE") / F.col("MAXIMUM")).alias("DEFICIT"), error.alias("ERROR"))


def checked_fits(patients: DataFrame, attributes: DataFrame, column: str = "CLINICAL_SCORES", scales: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(fits, reasons): fits of the patients whose documents have one good score for every mapped scale, and what is wrong with the others."""
    scales = sorted(scales or SCALE_FEATURES)
    rows = clinical_scores(patients, column)
    of = lambda s: F.when(F.col("SCALE") == s, F.col("DEFICIT"))
    one = rows.groupBy("PATIENT_ID").agg(
        F.array(*[F.max(of(s)) for s in scales]).alias("VECTOR"),
        F.array_compact(F.array(*[F.when(F.count(of(s)) > 1, F.lit(f"two scores for scale {s}")) for s in scales])).alias("__two"),
        F.array_sort(F.collect_set("ERROR")).alias("__errors"),
    )
    names = F.array(*[F.lit(s) for s in scales])
    lacking = F.filter(F.zip_with(names, "VECTOR", lambda s, d: F.when(d.isNull(), s)), lambda s: s.isNotNull())
    # a document with a fault isn't also blamed for what the fault took from it
    found = F.concat("__errors", "__two")
    reasons = F.when(F.size(found) > 0, found).when(F.size(lacking) > 0, F.array(F.concat(F.lit("no score for scale "), F.array_join(lacking, ", ")))).otherwise(F.array().cast("array<string>"))
    one = one.withColumn("__reasons", reasons)
    good = one.where(F.size("__reasons") == 0).select("PATIENT_ID", "VECTOR")
    protocols = fit.as_vector(fit.scale_attributes(attributes), "PROTOCOL_ID", scales, "VALUE")
    return fit.fits(good, protocols), one.select("PATIENT_ID", F.explode("__reasons").alias("REASON"))


def reasons(*faults: DataFrame) -> DataFrame:
    """PATIENT_ID and REASON: all of a patient's reasons in one text."""
    both = reduce(DataFrame.unionByName, faults)
    return both.groupBy("PATIENT_ID").agg(F.array_join(F.array_sort(F.collect_set("REASON")), "; ").alias("REASON"))


def without(df: DataFrame, faulty: DataFrame) -> DataFrame:
    """Rows of patients that nothing is wrong with."""
    return df.join(faulty.select("PATIENT_ID"), "PATIENT_ID", "left_anti")


def statuses(wanted: DataFrame, faulty: DataFrame, recommended: DataFrame) -> DataFrame:
    """PATIENT_ID, STATUS (ok or failed), REASON and RECOMMENDATIONS, one row for each wanted patient."""
    given = recommended.groupBy("PATIENT_ID").agg(F.count("*").alias("N"))
    rows = wanted.select("PATIENT_ID").distinct().join(faulty, "PATIENT_ID", "left").join(given, "PATIENT_ID", "left")
    reason: Column = F.coalesce("REASON", F.when(F.col("N").isNull(), "no scores"))
    return rows.select("PATIENT_ID", F.when(reason.isNull(), "ok").otherwise("failed").alias("STATUS"), reason.alias("REASON"), F.coalesce("N", F.lit(0)).alias("RECOMMENDATIONS"))
