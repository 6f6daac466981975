"""Sinks: versions behind a pointer, tables of runs that can be written again, ordered files, staging rows, metrics, previews and summaries."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restora.constants import BY_PP, METRICS

#: Files that one table of one run is written to, at most.
FILES = 32


def upserted(existing: DataFrame | None, new: DataFrame, keys: list[str] = BY_PP) -> DataFrame:
    """Rows of new, and those of existing whose keys new doesn't have; columns of either side are kept."""
    if existing is None:
        return new
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


class Files:
    """The file system of a path, whatever store it is in."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.system = self.path(path).getFileSystem(self.conf)

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.system.exists(self.path(path))

    def write(self, path: str, content: str) -> None:
        out = self.system.create(self.path(path), False)
        out.write(bytearray(content.encode("utf-8")))
        out.close()

    def read(self, path: str) -> str:
        size = self.system.getFileStatus(self.path(path)).getLen()
        stream = self.system.open(self.path(path))
        try:
            return bytes(stream.readNBytes(int(size))).decode("utf-8")
        finally:
            stream.close()

    def replace(self, source: str, target: str) -> None:
        """Renames source to target in one step, over a target that is there."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(target).toUri(), self.conf)
        option = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        context.rename(context.makeQualified(self.path(source)), context.makeQualified(self.path(target)), options)

    def delete(self, path: str) -> None:
        self.system.delete(self.path(path), True)

    def names(self, path: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.system.listStatus(self.path(path))) if self.exists(path) else []


class Versions:
    """A table whose versions lie beside one another in a folder; a pointer file says which is in force.

    publish() writes a whole new version and then renames a new pointer over the old one, in one step.  A reader
    keeps the version that was in force when it opened the table, since no version is written to again; a write that
    is cut off leaves the old one in force.  There is one writer at a time: one that finds another version in force
    than it started from raises instead of losing the other's rows.  sweep() deletes old versions and what broken
    writes left.
    """

    POINTER = "_current"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.top, self.files = spark, path.rstrip("/"), Files(spark, path)

    def current(self) -> str | None:
        """The name of the version in force."""
        pointer = f"{self.top}/{self.POINTER}"
        return self.files.read(pointer) if self.files.exists(pointer) else None

    def read(self) -> DataFrame | None:
        """The version in force; None before the first."""
        name = self.current()
        return None if name is None else self.spark.read.parquet(f"{self.top}/{name}")

    def publish(self, df: DataFrame, started_from: str | None) -> str:
        """Writes df as the next version, which it puts in force if `started_from` still is."""
        number = 1 + int(started_from.split("-")[1]) if started_from else 1
        name = f"v-{number:06d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.top}/{name}")
        if self.current() != started_from:
            raise RuntimeError(f"another version came into force while {name} was written")
        pointer = f"{self.top}/.{name}"
        self.files.write(pointer, name)
        self.files.replace(pointer, f"{self.top}/{self.POINTER}")
        return name

    def upsert(self, new: DataFrame, keys: list[str] = BY_PP) -> str | None:
        """Puts a version in force in which rows of new stand in for those of their keys; without rows of new nothing changes."""
        before = self.current()
        if before is not None and new.isEmpty():
            return before
        existing = None if before is None else self.spark.read.parquet(f"{self.top}/{before}")
        return self.publish(upserted(existing, new, keys), before)

    def sweep(self, keep: int = 2) -> None:
        """Deletes all but the version in force and the `keep` - 1 before it."""
        now = self.current()
        old = [n for n in self.files.names(self.top) if n.startswith("v-") and n != now]
        done = [n for n in old if now is not None and n < now and self.files.exists(f"{self.top}/{n}/_SUCCESS")]
        for n in set(old) - set(done[::-1][: keep - 1]):
            self.files.delete(f"{self.top}/{n}")


def write_upsert(existing: DataFrame | None, new: DataFrame, path: str, keys: list[str] = BY_PP) -> None:
    """Writes the merged table to a new path; Versions does this and points readers at it as well."""
    upserted(existing, new, keys).write.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_ordered(df: DataFrame, path: str, keys: list[str], files: int = FILES, kind: str = "parquet") -> None:
    """Writes rows in order of keys: each file holds a range of them in order, and names of files follow the ranges.

    A row's equals in all keys are in one file; ranges come from a sample that Spark takes, their order is exact.
    """
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.format(kind).option("header", "true").save(path)


def staging(recommendations: DataFrame, run_id: Column | str, trial_start: str = "CLINICAL_TRIAL_START_DATE", valid_days: int = 7) -> DataFrame:
    """One row per patient, protocol and weekday, valid from the current week of the trial; without days the weekday is null."""
    start = F.date_add(trial_start, 7 * F.coalesce("WEEKS_SINCE_START", F.lit(0)).cast("int"))
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    days = recommendations.select("PATIENT_ID", "PROTOCOL_ID", start.alias("STARTING_DATE"), F.explode_outer("DAYS").alias("WEEKDAY"))
    return days.select(run.alias("RUN_ID"), "PATIENT_ID", "PROTOCOL_ID", "STARTING_DATE", F.date_add("STARTING_DATE", valid_days).alias("ENDING_DATE"), "WEEKDAY")


def metrics(recommendations: DataFrame, run_id: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Long form (KEY, VALUE) of the numeric metrics."""
    names = names or [m for m in METRICS if m != "DAYS"]
    wide = recommendations.select(*BY_PP, *[F.col(n).cast("double").alias(n) for n in names])
    out = wide.unpivot(BY_PP, names, "KEY", "VALUE")
    return out if run_id is None else out.withColumn("RUN_ID", F.lit(run_id))


def append(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def replace_run(df: DataFrame, path: str, run_id: str, files: int = FILES, kind: str = "parquet") -> None:
    """Writes the rows of one run; written again, they take the place of those before, and other runs stay.

    Rows of a patient go to one of `files` files by a hash, so files don't grow in number with patients.
    """
    own = df.withColumn("RUN_ID", F.lit(run_id))
    rows = own.repartition(files, "PATIENT_ID") if "PATIENT_ID" in df.columns else own.coalesce(files)
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", "true").partitionBy("RUN_ID").format(kind).save(path)
    if not seen.get["n"]:  # nothing overwrites what was there
        folder = df.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run_id)
        Files(df.sparkSession, path).delete(f"{path}/RUN_ID={folder}")


def read_run(spark: SparkSession, path: str, schema: T.StructType, run_id: str) -> DataFrame:
    """The rows of one run, by the partition of that name."""
    whole = T.StructType([*[f for f in schema.fields if f.name != "RUN_ID"], T.StructField("RUN_ID", T.StringType())])
    try:
        return spark.read.schema(whole).parquet(path).where(F.col("RUN_ID") == run_id)
    except AnalysisException:  # no run has had a row
        return spark.createDataFrame([], whole)


def flat(df: DataFrame) -> DataFrame:
    """df with arrays as JSON, for text files."""
    return df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields])


def artifacts(tables: dict[str, DataFrame], path: str, run_id: str, kind: str = "parquet", files: int = FILES) -> None:
    """Tables of a run, each in a folder by run, as often as wanted."""
    for name, df in tables.items():
        replace_run(flat(df) if kind == "csv" else df, f"{path}/{name}", run_id, files, kind)


def preview(df: DataFrame, order: list[str], rows: int = 5, digits: int = 3) -> DataFrame:
    """The first rows in order, with rounded numbers and the table's row count."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    top = df.orderBy(*order).limit(rows).withColumns({c: F.round(c, digits) for c in numeric})
    return top.join(df.agg(F.count("*").alias("ROW_COUNT")))


def run_summary(statuses: DataFrame) -> DataFrame:
    """Totals and an overall status from one row (PATIENT_ID, STATUS, and RECOMMENDATIONS if known) per patient; STATUS is ok or failed."""
    done, failed = F.count_if(F.col("STATUS") == "ok"), F.count_if(F.col("STATUS") != "ok")
    word = F.when(done + failed == 0, "warning").when(failed == 0, "success").when(done == 0, "failure").otherwise("partial_success")
    given = [F.coalesce(F.sum("RECOMMENDATIONS"), F.lit(0)).alias("RECOMMENDATIONS")] if "RECOMMENDATIONS" in statuses.columns else []
    return statuses.agg(F.count("*").alias("PATIENTS"), done.alias("SUCCEEDED"), failed.alias("FAILED"), word.alias("OVERALL"), *given)
