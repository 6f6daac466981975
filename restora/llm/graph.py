"""Joins that stay splittable under skew, lineage cuts, scratch tables, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark deletes a query's shuffle files when the query has ended, if this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_top(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one on a local master only."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(top)
    return top


def shared_folder(spark: SparkSession, name: str = "table") -> str:
    """A new path in the cluster's shared checkpoint folder."""
    return f"{shared_top(spark)}/{name}_{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind; for a DataFrame's own actions it must be made inside, too."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    spark: SparkSession = df.sparkSession
    shared_top(spark)
    with tidy(spark):
        return df.select("*").checkpoint()  # a plan made in here: one made before keeps its shuffle files


def stored(df: DataFrame) -> DataFrame:
    """As cut, in compressed columns: for tables of many rows.  The files stay until forget() or until the shared folder is cleared."""
    spark = df.sparkSession
    path = shared_folder(spark)
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def keyed_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """An equi-join that shuffles both sides anew, so that adaptive execution can split a hot key's partition."""
    on = (F.xxhash64(left[left_key]) == F.xxhash64(right[right_key])) & (left[left_key] == right[right_key])
    return left.join(right, on, how)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b): component is the smallest node reachable.

    Labels flow along the edges and then jump to their label's label, so the number of rounds is
    logarithmic in the longest path.  No hub's neighbours meet in one task: joins can be split, and
    minima are pre-aggregated.
    """
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("component")))
    while True:
        seen = keyed_join(both, labels, "u", "node").select(F.col("v").alias("node"), "component").unionByName(labels)
        low = cut(seen.groupBy("node").agg(F.min("component").alias("component")))
        up = low.select(F.col("node").alias("over"), F.col("component").alias("top"))
        new = cut(keyed_join(low, up, "component", "over").select("node", F.col("top").alias("component")))
        old = labels.select("node", F.col("component").alias("was"))
        with tidy(edges.sparkSession):
            if new.join(old, "node").where("component <> was").isEmpty():
                return new
        labels = new
