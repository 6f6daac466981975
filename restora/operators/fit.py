"""Patient-protocol fit and protocol similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from restora.constants import SCALE_ALIASES, SCALE_FEATURES, SCALE_MAXIMA
from restora.functions.vectors import product, total, unit


def aliases(spark: SparkSession, names: dict[str, list[str]] = SCALE_ALIASES) -> DataFrame:
    """(ALIAS, CANONICAL), a dimension of tens of rows."""
    return spark.createDataFrame([(a, c) for c, each in names.items() for a in each], "ALIAS string, CANONICAL string")


def canonical_scales(scores: DataFrame) -> DataFrame:
    """SCALE under its canonical name; unknown names stay."""
    names = F.broadcast(aliases(scores.sparkSession))  # a fixed table
    return scores.join(names, scores.SCALE == names.ALIAS, "left").withColumn("SCALE", F.coalesce("CANONICAL", "SCALE")).drop("ALIAS", "CANONICAL")


def maxima(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in SCALE_MAXIMA.items()], "SCALE string, MAXIMUM double")


def deficits(scores: DataFrame) -> DataFrame:
    """DEFICIT = 1 - SCORE / MAXIMUM, which may be negative; a scale without a maximum is an error."""
    rows = scores.join(F.broadcast(maxima(scores.sparkSession)), "SCALE", "left")  # a fixed table
    known = F.coalesce("MAXIMUM", F.raise_error(F.concat(F.lit("no maximum for scale "), F.coalesce("SCALE", F.lit("null")))).cast("double"))
    return rows.withColumn("DEFICIT", 1 - F.col("SCORE") / known).drop("MAXIMUM")


def scale_attributes(attributes: DataFrame, combine: Callable[[Column], Column] = F.avg, mapping: dict[str, list[str]] = SCALE_FEATURES) -> DataFrame:
    """(PROTOCOL_ID, SCALE, VALUE): combined attributes of each scale, from wide attributes; nulls don't count."""
    features = sorted({f for each in mapping.values() for f in each if f in attributes.columns})
    long = attributes.select("PROTOCOL_ID", *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["PROTOCOL_ID"], features, "FEATURE", "VALUE")
    pairs = attributes.sparkSession.createDataFrame([(s, f) for s, each in mapping.items() for f in each], "SCALE string, FEATURE string")
    return long.join(F.broadcast(pairs), "FEATURE").groupBy("PROTOCOL_ID", "SCALE").agg(combine(F.col("VALUE")).alias("VALUE"))


def as_vector(long: DataFrame, key: str, scales: list[str], value: str) -> DataFrame:
    """(key, VECTOR) with one place for each scale; a scale that is missing or null makes its place null."""
    m = long.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("SCALE", value))).alias("m"))
    return m.select(key, F.array(*[F.try_element_at("m", F.lit(s)) for s in scales]).alias("VECTOR"))


#: Rows up to which a catalogue of protocols is sent to every task.
CATALOGUE = 10_000


def catalogue(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small; a larger one is joined by Spark's other ways."""
    return F.broadcast(df) if df.select(df.columns[0]).limit(CATALOGUE + 1).count() <= CATALOGUE else df


def fits(patients: DataFrame, protocols: DataFrame) -> DataFrame:
    """PPF (cosine) and CONTRIB (its terms) of each patient with each protocol; pairs without a PPF are left out.

    patients: (PATIENT_ID, VECTOR); protocols: (PROTOCOL_ID, VECTOR), a catalogue of tens of rows.
    """
    # dealt out first, as few files hold many vectors
    a = patients.repartition("PATIENT_ID").select("PATIENT_ID", unit(F.col("VECTOR")).alias("__a"))
    b = catalogue(protocols.select("PROTOCOL_ID", unit(F.col("VECTOR")).alias("__b")))
    # made and judged in one array of one, so that neither the terms nor their sum are computed again for the filter
    made = F.transform(F.array(product(F.col("__a"), F.col("__b"))), lambda c: F.struct(total(c).alias("PPF"), c.alias("CONTRIB")))
    known = F.filter(made, lambda m: m["PPF"].isNotNull() & ~F.isnan(m["PPF"]))
    return a.crossJoin(b).select("PATIENT_ID", "PROTOCOL_ID", F.inline(known)).select("PATIENT_ID", "PROTOCOL_ID", "PPF", "CONTRIB")


def similarity(long: DataFrame, one_hot_prefix: str | None = None) -> DataFrame:
    """(PROTOCOL_A, PROTOCOL_B, SIMILARITY): 1 minus the range-scaled mean difference of (PROTOCOL_ID, FEATURE, VALUE).

    Features whose name begins with one_hot_prefix share the weight of one.  A feature without range counts as equal.
    """
    ranges = long.groupBy("FEATURE").agg((F.max("VALUE") - F.min("VALUE")).alias("RANGE"))
    if one_hot_prefix:
        hot = F.startswith("FEATURE", F.lit(one_hot_prefix))
        many = ranges.agg(F.count_if(hot).alias("HOT"))
        ranges = ranges.join(many).withColumn("WEIGHT", F.when(hot, 1 / F.col("HOT")).otherwise(F.lit(1.0))).drop("HOT")
    else:
        ranges = ranges.withColumn("WEIGHT", F.lit(1.0))
    rows = long.join(ranges, "FEATURE")
    a = rows.select(F.col("PROTOCOL_ID").alias("PROTOCOL_A"), "FEATURE", F.col("VALUE").alias("A"), "RANGE", "WEIGHT")
    b = long.select(F.col("PROTOCOL_ID").alias("PROTOCOL_B"), "FEATURE", F.col("VALUE").alias("B"))
    apart = F.when(F.col("RANGE") > 0, F.abs(F.col("A") - F.col("B")) / F.col("RANGE")).otherwise(F.lit(0.0))
    return a.join(b, "FEATURE").groupBy("PROTOCOL_A", "PROTOCOL_B").agg((1 - F.sum(F.col("WEIGHT") * apart) / F.sum("WEIGHT")).alias("SIMILARITY"))


def require_scales(scores: DataFrame, required: list[str]) -> DataFrame:
    """scores, if every required scale has a row."""
    lacking = sorted(r.SCALE for r in missing_scales(scores, required).collect())  # at most the required names
    if lacking:
        raise ValueError(f"no scores for the scales {', '.join(lacking)}")
    return scores


def missing_scales(scores: DataFrame, required: list[str]) -> DataFrame:
    """Required scales that no row has."""
    return scores.sparkSession.createDataFrame([(s,) for s in required], "SCALE string").join(scores.select("SCALE").distinct(), "SCALE", "left_anti")
