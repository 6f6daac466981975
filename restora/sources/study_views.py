"""Study-shaped tables derived from the event and embedding tables, for queries and benches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from restora.constants import SCALE_ALIASES, SCALE_FEATURES, SCALE_MAXIMA

SCORING_DATE = "2024-01-29"


#: Rows of a part of parted().
PART = 100_000


def parted(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of the events' patients dealt by patient into parts of PART events or so, at least one for each core.

    Scored sessions and clinical scores go through many sorts by patient in one task.  Left to itself Spark merges parts by their
    compressed bytes, up to one for each core, so a task's memory would grow with the table.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-events.count() // PART)), "PATIENT_ID")


def sessions(spark: SparkSession, sf_dir: str, by_five: bool = True, deal: bool = False) -> DataFrame:
    """A session row for every event; with by_five there are 25 protocols, else 5 with longer series.  With deal they come parted() by patient."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = events.select("event_id", F.col("ts").cast("date").alias("SESSION_DATE"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    protocol = 200 + 5 * kind + F.col("k") % 5 if by_five else 200 + kind
    skipped = F.col("k") % 10 == 0
    out = e.select(
        (F.col("user_id") + 1).cast("bigint").alias("PATIENT_ID"),
        protocol.cast("bigint").alias("PROTOCOL_ID"),
        F.when(~skipped, F.col("event_id")).alias("SESSION_ID"),
        "SESSION_DATE",
        (F.datediff("SESSION_DATE", F.lit("2024-01-01").cast("date")) % 7).cast("int").alias("WEEKDAY_INDEX"),
        F.when(skipped, "NOT_PERFORMED").otherwise("CLOSED").alias("STATUS"),
        F.when(skipped, F.lit(0.0)).otherwise(F.col("k") / F.lit(100.0)).alias("ADHERENCE"),
        F.when(~skipped, F.col("value") / F.lit(600.0)).alias("DM_VALUE"),
        "event_id",
    )
    out = parted(out, events) if deal else out
    own = Window.partitionBy("PATIENT_ID", "PROTOCOL_ID", "WEEKDAY_INDEX")
    return out.withColumns({
        "PRESCRIPTION_ID": F.col("PATIENT_ID") * 1000 + (F.col("PROTOCOL_ID") - 200) * 10 + F.col("WEEKDAY_INDEX"),
        "PRESCRIPTION_STARTING_DATE": F.min("SESSION_DATE").over(own),
        "PRESCRIPTION_ENDING_DATE": F.lit("2100-01-01").cast("date"),
    })


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per patient, with the first session as start of the trial."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy((F.col("user_id") + 1).cast("bigint").alias("PATIENT_ID")).agg(F.min(F.col("ts").cast("date")).alias("CLINICAL_TRIAL_START_DATE")).withColumn("CLINICAL_TRIAL_END_DATE", F.lit("2024-03-01").cast("date"))


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PATIENT_ID and STUDY_ID (0..4), the kind of the patient's first event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    return e.groupBy((F.col("user_id") + 1).cast("bigint").alias("PATIENT_ID")).agg(F.min_by(kind, "event_id").alias("STUDY_ID"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(PATIENT_ID, VECTOR) and (PROTOCOL_ID, VECTOR) from the embeddings."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("VECTOR"))
    own = v.where("vec_id >= 25").select((F.col("vec_id") - 24).cast("bigint").alias("PATIENT_ID"), "VECTOR")
    return own, v.where("vec_id < 25").select((F.col("vec_id") + 200).cast("bigint").alias("PROTOCOL_ID"), "VECTOR")


def clinical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PATIENT_ID and a JSON array of two evaluations, from customer numbers."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    body = lambda n: F.concat(F.lit('{"evaluation_date":"2024-01-0'), F.lit(n), F.lit('","condition":"x","MoCA":{"Attention":'), ((F.col("c_custkey") + n) % 7).cast("string"), F.lit(',"Naming":'), ((F.col("c_custkey") + n) % 4).cast("string"), F.lit('},"ARAT":{"Grasp":'), ((F.col("c_custkey") + n) % 16).cast("string"), F.lit("}}"))
    return c.select(F.col("c_custkey").cast("bigint").alias("PATIENT_ID"), F.concat(F.lit("["), body(1), F.lit(","), body(2), F.lit("]")).alias("CLINICAL_SCORES"))


def clinical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PATIENT_ID and CLINICAL_SCORES with every mapped scale, from customer numbers; some nations' documents have faults.

    Nations 0 to 2: cut off in the middle; 3 to 5: a scale that nobody knows; 9 to 11: a word for a number.
    """
    c, nation = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_nationkey")
    names = [(s, a[0]) for s, a in SCALE_ALIASES.items() if s in SCALE_FEATURES]
    parts = []
    for test in sorted({a.split(".")[0] for _, a in names}):
        fields = [F.concat(F.lit(f'"{a.split(".")[1]}":'), F.when(nation.between(9, 11) & F.lit(s == "ARAT_GRIP"), '"good"').otherwise(((F.col("c_custkey") + k + 3) % (SCALE_MAXIMA[s] + 1)).cast("string"))) for k, (s, a) in enumerate(names) if a.split(".")[0] == test]
        odd = F.when(nation.between(3, 5) & F.lit(test == "ARAT"), ',"Dance":3').otherwise("")
        parts.append(F.concat(F.lit(f'"{test}":{{'), F.concat_ws(",", *fields), odd, F.lit("}")))
    whole = F.concat(F.lit('[{"ARAT":{"Grip":1}},{"when":"2024-01-02",'), F.concat_ws(",", *parts), F.lit("}]"))
    return c.select(F.col("c_custkey").cast("bigint").alias("PATIENT_ID"), "c_nationkey", F.when(nation <= 2, F.substring(whole, 1, 60)).otherwise(whole).alias("CLINICAL_SCORES"))


def clinical_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patients() with CLINICAL_SCORES; those of nations 6 to 8 have no start date."""
    both = patients(spark, sf_dir).join(clinical_documents(spark, sf_dir), "PATIENT_ID")
    return both.withColumn("CLINICAL_TRIAL_START_DATE", F.when(~F.col("c_nationkey").between(6, 8), F.col("CLINICAL_TRIAL_START_DATE"))).drop("c_nationkey")


def logged_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sessions() with dates as text, as a log has them; missed sessions of patients of nations 12 and 13 have no readable date."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("PATIENT_ID"), "c_nationkey")
    rows = sessions(spark, sf_dir).drop("event_id").join(c, "PATIENT_ID", "left")
    lost = F.col("c_nationkey").between(12, 13) & (F.col("STATUS") == "NOT_PERFORMED")
    return rows.withColumn("SESSION_DATE", F.when(lost, "not noted").otherwise(F.col("SESSION_DATE").cast("string"))).drop("c_nationkey")
