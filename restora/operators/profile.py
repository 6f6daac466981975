"""Patient and protocol profiles: embeddings of unit sum over the subscales, and how a profile moves on with success."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restora.functions.vectors import total


def share(v: Column) -> Column:
    """v divided by its sum; zeros stay zeros."""
    s = total(v)
    return F.transform(v, lambda x: F.when(s == 0, F.lit(0.0)).otherwise(x / s))


def deficiency(scores: Column, maxima: list[float]) -> Column:
    """What each score lacks of its maximum; never below 0."""
    return F.zip_with(F.array(*[F.lit(float(m)) for m in maxima]), scores, lambda m, s: F.greatest(m - s, F.lit(0.0)))


def patient_embedding(scores: Column, maxima: list[float]) -> Column:
    return share(deficiency(scores, maxima))


def protocol_embedding(ratings: Column) -> Column:
    return share(ratings)


def weighted_embeddings(successes: DataFrame, protocols: DataFrame, size: int) -> DataFrame:
    """PATIENT_ID, TIME and E: the sum over the diagnostic protocols of success rate times protocol embedding.

    successes: (PATIENT_ID, PROTOCOL_ID, TIME, RATE); protocols: (PROTOCOL_ID, RATINGS), a place for each subscale.
    """
    q = protocols.select("PROTOCOL_ID", protocol_embedding(F.col("RATINGS")).alias("__q"))
    rows = successes.join(q, "PROTOCOL_ID")
    places = [F.sum(F.col("RATE") * F.get("__q", F.lit(i))).alias(f"__{i}") for i in range(size)]  # summed place by place, before anything is shuffled
    return rows.groupBy("PATIENT_ID", "TIME").agg(*places).select("PATIENT_ID", "TIME", F.array(*[F.col(f"__{i}") for i in range(size)]).alias("E"))


def updated_profiles(profiles: DataFrame, successes: DataFrame, protocols: DataFrame, maxima: list[float], times: list[int]) -> DataFrame:
    """PATIENT_ID, TIME, RATIO, SCORES and EMBEDDING of every patient at each of the times, the first of which is the assessment.

    profiles: (PATIENT_ID, SCORES).  Scores go on by the ratio of summed weighted embeddings from one time to the next,
    up to their maxima; deficiencies and embedding follow.  Without an earlier or later embedding (or with one of
    sum 0) a profile stays as it is, with a null RATIO.
    """
    e = weighted_embeddings(successes, protocols, len(maxima))
    sums = e.groupBy("PATIENT_ID").agg(*[F.max(F.when(F.col("TIME") == t, total(F.col("E")))).alias(f"__e{i}") for i, t in enumerate(times)])
    rows = profiles.join(sums, "PATIENT_ID", "left")
    top = F.array(*[F.lit(float(m)) for m in maxima])
    start = F.struct(F.lit(times[0]).alias("TIME"), F.lit(None).cast("double").alias("RATIO"), F.transform("SCORES", lambda x: x.cast("double")).alias("SCORES"))

    def after(states: list[Column], i: int) -> list[Column]:
        ratio = F.try_divide(F.col(f"__e{i}"), F.col(f"__e{i - 1}"))
        last = states[-1]["SCORES"]
        moved = F.when(ratio.isNull(), last).otherwise(F.zip_with(last, top, lambda s, m: F.least(s * ratio, m)))
        return [*states, F.struct(F.lit(times[i]).alias("TIME"), ratio.alias("RATIO"), moved.alias("SCORES"))]

    states = reduce(after, range(1, len(times)), [start])
    each = rows.select("PATIENT_ID", F.inline(F.array(*states)))
    return each.withColumn("EMBEDDING", patient_embedding(F.col("SCORES"), maxima))
