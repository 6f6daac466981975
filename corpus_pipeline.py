"""A training-corpus pipeline: each stage works on what its predecessor kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of docs, whatever they are called.
A stage's result is written as Parquet and read again before the next one.  Rows are told apart by doc_id and
text, so rows that share a doc_id, or have none, are each judged; equal rows stay or go together; null texts
have no language and are dropped by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restora.llm import bpe, decontaminate, langid, minhash
from restora.llm import secrets as secret_scan
from restora.llm.graph import keyed_join, shared_folder, tidy


def _shielded(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the used ones under names that no operator has, and what gives the names back."""
    names = {c: c if c in used else f"__own_{i}" for i, c in enumerate(docs.columns)}
    column = lambda c: F.col(f"`{c}`")
    return docs.select(*[column(c).alias(own) for c, own in names.items()]), lambda df: df.select(*[column(own).alias(c) for c, own in names.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Documents whose language is recognised with a posterior of at least `least`."""
    languages, p = langid.learn(docs.select("doc_id", "text", "lang"))
    own, back = _shielded(docs, ("doc_id", "text"))
    return back(langid.predict(own, languages, p).where((F.col("lang_pred") != "und") & (F.col("score") >= least)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates (five words, similarity 0.8)."""
    kept = minhash.near_duplicates(docs.select("doc_id", "text"), k=5, percent=80).where("kept").select(F.col("row_key").alias("kept_key")).distinct()
    own, back = _shielded(docs, ("doc_id", "text"))
    own = own.withColumn("__key", minhash.row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return back(keyed_join(own, kept, "__key", "kept_key", "left_semi"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    own, back = _shielded(docs, ("doc_id", "text"))
    return back(decontaminate.covered(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~F.col("contaminated")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of secrets; n_chars follows the text."""
    own, back = _shielded(docs, ("doc_id", "text"))
    out = back(secret_scan.scanned(own, redact=True))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes."""
    return bpe.encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level BPE", encode_tokens),
]

#: Learned models and exact near-duplicate classes are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = stage(spark, docs, sf_dir)
        with tidy(spark):
            kept.write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
