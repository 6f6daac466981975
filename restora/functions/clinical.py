"""Clinical scores from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_evaluation(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys, SCALE (`Assessment.Subscale`) and SCORE of the last evaluation; members that are no objects are left out.

    A null, empty or broken document gives no rows.
    """
    last = F.try_element_at(F.from_json(column, "array<map<string,string>>"), F.lit(-1))
    parts = df.select(*keys, F.explode(last).alias("assessment", "body")).where(F.col("body").startswith("{"))
    return parts.select(*keys, "assessment", F.explode(F.from_json("body", "map<string,double>")).alias("sub", "SCORE")).select(*keys, F.concat_ws(".", "assessment", "sub").alias("SCALE"), "SCORE")
