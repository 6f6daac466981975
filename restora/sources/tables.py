"""Scans: session, patient, subscale, fit, similarity and attribute tables from Parquet, CSV or JDBC."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restora.functions.clinical import last_evaluation
from restora.operators.fit import catalogue

_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "date": T.DateType(), "array<double>": T.ArrayType(T.DoubleType())}


def schema_of(text: str) -> T.StructType:
    """A schema from `name type` pairs; it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(","))])


SESSIONS = schema_of(
    "PATIENT_ID bigint, PRESCRIPTION_ID bigint, SESSION_ID bigint, PROTOCOL_ID bigint, PRESCRIPTION_STARTING_DATE date, PRESCRIPTION_ENDING_DATE date, "
    "SESSION_DATE date, WEEKDAY_INDEX int, STATUS string, REAL_SESSION_DURATION int, PRESCRIBED_SESSION_DURATION int, SESSION_DURATION int, ADHERENCE double, DM_VALUE double"
)
TIMESERIES = schema_of("PATIENT_ID bigint, SESSION_ID bigint, PROTOCOL_ID bigint, GAME_MODE string, SECONDS_FROM_START int, DM_KEY string, DM_VALUE double, PE_KEY string, PE_VALUE double")
FITS = schema_of("PATIENT_ID bigint, PROTOCOL_ID bigint, PPF double, CONTRIB array<double>")
SIMILARITY = schema_of("PROTOCOL_A bigint, PROTOCOL_B bigint, SIMILARITY double")


@dataclass(frozen=True)
class Table:
    """A named DataFrame with its key columns, and a schema to check it against."""

    name: str
    data: DataFrame
    keys: tuple[str, ...]
    schema: T.StructType | None = None
    notes: dict[str, str] = field(default_factory=dict)


class Loader(Protocol):
    """What scoring needs to read; each method may take a DataFrame of wanted patients."""

    def sessions(self, patients: DataFrame | None = None) -> DataFrame: ...
    def timeseries(self, patients: DataFrame | None = None) -> DataFrame: ...
    def patients(self, patients: DataFrame | None = None) -> DataFrame: ...
    def subscales(self, patients: DataFrame | None = None) -> DataFrame: ...
    def fits(self, patients: DataFrame | None = None) -> DataFrame: ...
    def similarity(self) -> DataFrame: ...
    def attributes(self) -> DataFrame: ...


def of_patients(df: DataFrame, patients: DataFrame | list[int] | None, key: str = "PATIENT_ID") -> DataFrame:
    """Rows of the given patients: a pushed-down list, or a semi-join for a table of them."""
    if patients is None:
        return df
    if isinstance(patients, list):
        return df.where(F.col(key).isin(patients))
    return df.join(patients.select(F.col(key)).distinct(), key, "left_semi")


class FileLoader:
    """Tables under one folder, as Parquet or as CSV with a header."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "parquet"):
        self.spark, self.folder, self.kind = spark, folder, kind

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        path = f"{self.folder}/{name}.{self.kind}"
        if self.kind == "csv":
            flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in schema.fields])
            df = self.spark.read.schema(flat).csv(path, header=True)
            return df.select(*[F.from_json(f.name, f.dataType).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in schema.fields])
        return self.spark.read.schema(schema).parquet(path)

    def sessions(self, patients=None):
        return of_patients(self._read("sessions", SESSIONS), patients)

    def timeseries(self, patients=None):
        return of_patients(self._read("timeseries", TIMESERIES), patients)

    def patients(self, patients=None):
        schema = schema_of("PATIENT_ID bigint, CLINICAL_TRIAL_START_DATE date, CLINICAL_TRIAL_END_DATE date, CLINICAL_SCORES string")
        return of_patients(self._read("patient", schema), patients)

    def subscales(self, patients=None):
        return last_evaluation(self.patients(patients), "CLINICAL_SCORES", ["PATIENT_ID"])

    def fits(self, patients=None):
        stored = self._read("ppf", FITS)
        return stored if patients is None else completed_fits(stored, patients)

    def similarity(self):
        return self._read("protocol_similarity", SIMILARITY)

    def attributes(self, path: str | None = None, default: str | None = None):
        """Protocol attributes: from path, else from the folder, else from default."""
        for where in (path, f"{self.folder}/protocol_attributes.{self.kind}", default):
            try:
                if where is not None:
                    return self.spark.read.csv(where, header=True, inferSchema=True) if where.endswith(".csv") else self.spark.read.parquet(where)
            except AnalysisException:
                if where == path:
                    raise  # what was asked for by name must be there
        raise ValueError("no protocol attributes")

    def wide_subscales(self):
        """Subscales as a CSV with a column for each, without the study column, in long form."""
        wide = subscale_csv(self.spark, f"{self.folder}/subscales.csv")
        scales = [c for c in wide.columns if c != "PATIENT_ID"]
        return wide.select("PATIENT_ID", *[F.col(f"`{c}`").cast("double").alias(c) for c in scales]).unpivot(["PATIENT_ID"], [F.col(f"`{c}`") for c in scales], "SCALE", "SCORE").na.drop()


def id_ranges(key: str, low: int | None, high: int | None, parts: int) -> list[str]:
    """Predicates that split ids from low to high in equal ranges; the first and last are open, and null ids have one of their own."""
    if low is None or high is None or parts < 2:
        return [f"{key} is not null", f"{key} is null"]
    step = max(1, -(-(high - low + 1) // parts))
    cuts = list(range(low + step, high + 1, step))
    edges = [None, *cuts, None]
    inside = [" and ".join([*([f"{key} >= {a}"] if a is not None else []), *([f"{key} < {b}"] if b is not None else [])]) or f"{key} is not null" for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [*inside, f"{key} is null"]


def jdbc(spark: SparkSession, url: str, table: str, patients: DataFrame | list[int] | None = None, key: str = "PATIENT_ID", parts: int = 16, chunk: int = 500, **options: str) -> DataFrame:
    """A database table, read over as many connections as it has partitions; filters and columns are pushed down by the source.

    A list of patients is asked for in chunks of ids, each a partition.  Otherwise the table is split in ranges of ids
    between the smallest and the largest, which the database is asked for first; a table of patients is then joined.
    A row's id must be a whole number or null.
    """
    if isinstance(patients, list):
        ids = sorted({int(p) for p in patients})
        wanted = [f"{key} in ({', '.join(map(str, ids[k : k + chunk]))})" for k in range(0, len(ids), chunk)] or ["1 = 0"]
        return spark.read.jdbc(url, table, predicates=wanted, properties=options)
    ends = spark.read.format("jdbc").options(url=url, query=f"select min({key}) as LOW, max({key}) as HIGH from {table}", **options).load().first()
    rows = spark.read.jdbc(url, table, predicates=id_ranges(key, *(None if e is None else int(e) for e in ends), parts), properties=options)
    return of_patients(rows, patients, key)


def subscale_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide subscales (PATIENT_ID and a column for each), without the study column."""
    return spark.read.csv(path, header=True, inferSchema=True).drop("STUDY_ID")


def cohort(studies: DataFrame, study_ids: list[int] | None = None) -> DataFrame:
    """Distinct patients of the given studies, from rows (STUDY_ID, PATIENT_ID); none at all is an error."""
    rows = studies if study_ids is None else studies.where(F.col("STUDY_ID").isin(study_ids))
    return require_rows(rows.select("PATIENT_ID"), f"no patients in the studies {study_ids}").distinct()


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def completed_fits(fits: DataFrame, patients: DataFrame, required: bool = True) -> DataFrame:
    """Fits of the wanted patients; those without any get a row with nulls for each known protocol.  If none has any it is an error where they are required."""
    wanted = patients.select("PATIENT_ID").distinct()
    own = fits.join(wanted, "PATIENT_ID", "left_semi")
    own = require_rows(own, "none of the patients has a fit") if required else own
    missing = wanted.join(fits, "PATIENT_ID", "left_anti")
    protocols = catalogue(fits.select("PROTOCOL_ID").distinct())
    blank = missing.crossJoin(protocols).withColumns({c: F.lit(None).cast(fits.schema[c].dataType) for c in fits.columns if c not in ("PATIENT_ID", "PROTOCOL_ID")})
    return own.unionByName(blank.select(*own.columns))


def union_modes(sources: dict[str, DataFrame], column: str = "MODE") -> DataFrame:
    """All rows of several sources, with the source's name; missing columns are null."""
    out = None
    for name, df in sources.items():
        part = df.withColumn(column, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_or_empty(spark: SparkSession, read: Callable[[], DataFrame], schema: T.StructType) -> DataFrame:
    """The table, or an empty one of the declared columns if it can't be resolved or lacks columns."""
    try:
        return read().select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    except AnalysisException:
        return spark.createDataFrame([], schema)


def parsed(columns: dict[str, str]) -> list[Column]:
    """Casts that raise on bad values (ANSI mode), by column and type."""
    return [F.col(c).cast(t).alias(c) for c, t in columns.items()]
