"""Checks: rules, session quality, audited joins, uniqueness and consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SESSION_RULES = {
    "patient_positive": "PATIENT_ID > 0",
    "protocol_positive": "PROTOCOL_ID > 0",
    "weekday": "WEEKDAY_INDEX between 0 and 6",
    "status": "STATUS in ('CLOSED', 'NOT_PERFORMED')",
    "adherence_share": "ADHERENCE between 0 and 1",
    "dm_share": "DM_VALUE between 0 and 1",
}
#: What must be there in a session row, besides; `X is not null` never is null itself.
SESSION_KEYS = {
    "patient_present": "PATIENT_ID is not null",
    "prescription_present": "PRESCRIPTION_ID is not null",
    "start_present": "PRESCRIPTION_STARTING_DATE is not null",
    "end_present": "PRESCRIPTION_ENDING_DATE is not null",
    "dates_in_order": "PRESCRIPTION_STARTING_DATE <= PRESCRIPTION_ENDING_DATE",
}
DURATION_RULES = {f"{c.lower()}_not_negative": f"{c} >= 0" for c in ("REAL_SESSION_DURATION", "PRESCRIBED_SESSION_DURATION", "SESSION_DURATION")}
TIMESERIES_RULES = {"patient_positive": "PATIENT_ID > 0", "session_positive": "SESSION_ID > 0", "protocol_positive": "PROTOCOL_ID > 0", "seconds_not_negative": "SECONDS_FROM_START >= 0"}
FIT_RULES = {
    "patient_present": "PATIENT_ID is not null",
    "protocol_present": "PROTOCOL_ID is not null",
    "ppf_present": "PPF is not null",
    "contributions_present": "CONTRIB is not null",
    "contributions_add_up": "abs(aggregate(CONTRIB, 0D, (a, x) -> a + x) - PPF) < 1e-6",
}
SIMILARITY_RULES = {"a_present": "PROTOCOL_A is not null", "b_present": "PROTOCOL_B is not null", "similarity_present": "SIMILARITY is not null", "similarity_share": "SIMILARITY between 0 and 1"}
SCORE_RULES = {
    "patient_positive": "PATIENT_ID > 0",
    "protocol_positive": "PROTOCOL_ID > 0",
    "adherence_share": "ADHERENCE_RECENT between 0 and 1",
    "ppf_share": "PPF between 0 and 1",
    "score_not_negative": "SCORE >= 0",
    "usage_not_negative": "USAGE >= 0",
    "days_in_week": "forall(DAYS, d -> d between 0 and 6)",
}
UNITS = {"sessions": SESSION_RULES | SESSION_KEYS, "timeseries": TIMESERIES_RULES, "ppf": FIT_RULES, "protocol_similarity": SIMILARITY_RULES, "scores": SCORE_RULES}


def broken(rules: dict[str, str]) -> Column:
    """The names of the rules that a row breaks, in order of their names; a null breaks only rules that ask for a value."""
    return F.array_compact(F.array(*[F.when(~F.expr(rule), F.lit(name)) for name, rule in sorted(rules.items())]))


def checked(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """df with BROKEN, the rules that each row breaks."""
    return df.withColumn("BROKEN", broken(rules))


def rule_counts(marked: DataFrame, rules: dict[str, str]) -> DataFrame:
    """RULE and N from rows with BROKEN; rules that no row breaks have 0."""
    return marked.agg(*[F.count_if(F.array_contains("BROKEN", name)).alias(name) for name in rules]).unpivot([], list(rules), "RULE", "N")


def quarantine(df: DataFrame, rules: dict[str, str], path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good rows, bad rows with BROKEN, RULE and N): df is read and checked once, and written in two partitions that the results are read from."""
    checked(df, rules).withColumn("GOOD", F.size("BROKEN") == 0).write.partitionBy("GOOD").parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField("BROKEN", T.ArrayType(T.StringType())), T.StructField("GOOD", T.BooleanType())])
    written = df.sparkSession.read.schema(schema).parquet(path)
    bad = written.where(~F.col("GOOD")).drop("GOOD")
    return written.where("GOOD").drop("GOOD", "BROKEN"), bad, rule_counts(bad, rules)


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """RULE and N, the rows that break it; a null breaks no rule (nullable columns)."""
    counts = df.agg(*[F.count_if(~F.expr(rule)).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "RULE", "N")


def type_faults(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """COLUMN and N, the non-null values that can't be cast to its type; columns with nulls only pass, as does an empty table."""
    bad = [F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as {t})").isNull()).alias(c) for c, t in types.items()]
    return df.agg(*bad).unpivot([], list(types), "COLUMN", "N")


def session_quality(sessions: DataFrame) -> DataFrame:
    """QUALITY of every row: no_prescription, no_adherence or clean."""
    return sessions.withColumn("QUALITY", F.when(F.col("PRESCRIPTION_ID").isNull(), "no_prescription").when(F.col("ADHERENCE").isNull(), "no_adherence").otherwise("clean"))


def audited(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of both sides with MATCH: matched, left_only or right_only."""
    a, b = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))
    match = F.when(F.col("__l") & F.col("__r"), "matched").when(F.col("__l"), "left_only").otherwise("right_only")
    return a.join(b, keys, "full_outer").withColumn("MATCH", match).drop("__l", "__r")


def audited_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the join, rows of left alone, rows of right alone), all from one audited join."""
    rows = audited(left, right, keys)
    keep = {"inner": ["matched"], "left": ["matched", "left_only"], "right": ["matched", "right_only"], "outer": ["matched", "left_only", "right_only"]}[how]
    return rows.where(F.col("MATCH").isin(keep)).drop("MATCH"), rows.where("MATCH = 'left_only'"), rows.where("MATCH = 'right_only'")


def export_audit(left: DataFrame, right: DataFrame, keys: list[str], path: str, how: str = "inner") -> tuple[DataFrame, DataFrame, DataFrame]:
    """audited_join, joined once: all rows are written to path by MATCH, and each of the three tables reads its own partitions of that."""
    rows = audited(left, right, keys)
    rows.write.partitionBy("MATCH").parquet(path)
    whole = T.StructType([*[f for f in rows.schema.fields if f.name != "MATCH"], T.StructField("MATCH", T.StringType())])
    written = left.sparkSession.read.schema(whole).parquet(path)
    keep = {"inner": ["matched"], "left": ["matched", "left_only"], "right": ["matched", "right_only"], "outer": ["matched", "left_only", "right_only"]}[how]
    of = lambda *kinds: written.where(F.col("MATCH").isin(*kinds))
    return of(*keep).drop("MATCH"), of("left_only"), of("right_only")


def not_unique(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one value."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("N")).where("N > 1")


def consistency(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """COLUMN with the distinct values of both sides and of their differences."""
    out = None
    for c in columns:
        both = audited(left.select(c).distinct().na.drop(), right.select(c).distinct().na.drop(), [c])
        row = both.agg(F.lit(c).alias("COLUMN"), F.count_if(F.col("MATCH") != "right_only").alias("IN_LEFT"), F.count_if(F.col("MATCH") != "left_only").alias("IN_RIGHT"), F.count_if(F.col("MATCH") == "left_only").alias("LEFT_ONLY"), F.count_if(F.col("MATCH") == "right_only").alias("RIGHT_ONLY"))
        out = row if out is None else out.unionByName(row)
    return out
