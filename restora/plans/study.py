"""End-to-end compositions: score tables and recommendations for a study."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restora.constants import DAYS, PER_DAY, TOP_N, WEIGHTS
from restora.operators import faults, fit
from restora.operators.recommend import allowed, recommended
from restora.operators.scoring import features, imputed, replayed_features, scored
from restora.operators.sessions import in_trial, with_missing_sessions
from restora.sources import sinks
from restora.sources.tables import Loader, cohort, completed_fits


def score_table(fits: DataFrame, sessions: DataFrame, patients: DataFrame, scoring_date: Column, weights: tuple[float, float, float] = WEIGHTS, build: Callable[..., DataFrame] = features, fill: Callable[[DataFrame], DataFrame] = imputed, score: Callable[..., DataFrame] = scored) -> DataFrame:
    """One row per pair of fits with its metrics and SCORE; without sessions the score is the fit alone.

    build, fill and score can be replaced: build(fits, sessions, patients, scoring_date) gives the feature table,
    fill(table) completes it, and score(table, weights) adds SCORE.
    """
    rows = in_trial(with_missing_sessions(sessions, scoring_date), patients, scoring_date)
    return score(fill(build(fits, rows, patients, scoring_date)), weights)


def scores_at(fits: DataFrame, sessions: DataFrame, patients: DataFrame, days: tuple[int, ...], weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Score tables of all patients at several days after their start, with DAY.  Sessions are read and expanded once, up to the last of the days."""
    days = tuple(sorted(days))
    start = patients.groupBy("PATIENT_ID").agg(F.min("CLINICAL_TRIAL_START_DATE").alias("__start"))
    dated = sessions.join(start, "PATIENT_ID").withColumn("__until", F.date_add("__start", days[-1]))
    rows = in_trial(with_missing_sessions(dated, F.col("__until")).drop("__start", "__until"), patients, F.date_add("CLINICAL_TRIAL_START_DATE", days[-1]))
    return scored(imputed(replayed_features(fits, rows, patients, days), ("PATIENT_ID", "DAY")), weights)


def prepared(fits: DataFrame, sessions: DataFrame, similarity: DataFrame, protocols: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without protocols that are not on the allow-list."""
    return allowed(fits, ["PROTOCOL_ID"], protocols), allowed(sessions, ["PROTOCOL_ID"], protocols), allowed(similarity, ["PROTOCOL_A", "PROTOCOL_B"], protocols)


def patients_run(
    loader: Loader, wanted: DataFrame, scoring_date: Column, run_id: str = "run", n: int = TOP_N, days: int = DAYS, per_day: int = PER_DAY,
    fits_of: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
    deal: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> dict[str, DataFrame]:
    """faults, scores, recommendations, staging, metrics, statuses and summary of the wanted patients.

    What is wrong with a patient's own data doesn't stop the run: the patient has status failed and the reason, and no
    rows in the other tables.  fits_of(patients) gives (fits, reasons); by default stored fits are completed.
    keep(name, table) may write a table and give back what was written, which all later ones are then made of.
    deal(sessions) may part the sessions by patient before they are scored, so that a task's share doesn't grow with the table.
    """
    people = loader.patients(wanted)
    fits, bad = (_stored_fits(loader, wanted), None) if fits_of is None else fits_of(people)
    logged = loader.sessions(wanted)
    fits, sessions, similarity = prepared(fits, logged, loader.similarity())
    # stored fits are enough for a patient that the table of patients doesn't have
    checks = [faults.of_dates(people), *([] if bad is None else [bad, faults.unknown(wanted, people)])]
    checks += [faults.of_rows(t) for t in (people, logged) if "ERROR" in t.columns]
    faulty = keep("faults", faults.reasons(*checks))
    good = lambda df: faults.without(df.drop("ERROR"), faulty)
    scores = keep("scores", score_table(good(fits), deal(good(sessions)), good(people), scoring_date))
    chosen = keep("recommendations", recommended(scores, similarity, n, days, per_day))
    starts = people.groupBy("PATIENT_ID").agg(F.min("CLINICAL_TRIAL_START_DATE").alias("CLINICAL_TRIAL_START_DATE"))
    out = {
        "faults": faulty,
        "scores": scores,
        "recommendations": chosen,
        "staging": keep("staging", sinks.staging(chosen.join(starts, "PATIENT_ID"), run_id)),
        "metrics": keep("metrics", sinks.metrics(chosen, run_id)),
        "statuses": keep("statuses", faults.statuses(wanted, faulty, chosen)),
    }
    return out | {"summary": sinks.run_summary(out["statuses"])}


def _stored_fits(loader: Loader, wanted: DataFrame) -> DataFrame:
    return completed_fits(loader.fits(), wanted, required=False)


def study_run(loader: Loader, studies: DataFrame, study_ids: list[int], scoring_date: Column, run_id: str = "run", **options) -> dict[str, DataFrame]:
    """patients_run for the patients of the studies; none at all is an error."""
    return patients_run(loader, cohort(studies, study_ids), scoring_date, run_id, **options)


def kept_in(path: str, run_id: str) -> Callable[[str, DataFrame], DataFrame]:
    """Writes each table of a run once, in the place of what the same run wrote before, and goes on with what was written."""

    def keep(name: str, df: DataFrame) -> DataFrame:
        sinks.replace_run(df, f"{path}/{name}", run_id)
        return sinks.read_run(df.sparkSession, f"{path}/{name}", df.schema, run_id).select(*[c for c in df.columns if c != "RUN_ID"], *(["RUN_ID"] if "RUN_ID" in df.columns else []))

    return keep


def write_study(path: str, loader: Loader, wanted: DataFrame, scoring_date: Column, run_id: str, **options) -> dict[str, DataFrame]:
    """Runs and writes: tables by run as Parquet, and the summary as JSON.  The same run written again leaves the same rows."""
    out = patients_run(loader, wanted, scoring_date, run_id, keep=kept_in(path, run_id), **options)
    out["summary"].coalesce(1).write.mode("overwrite").json(f"{path}/summary/RUN_ID={run_id}")
    return out


def write_run(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Writes tables of a run that are there already, by run, and the summary as JSON."""
    sinks.artifacts({k: v for k, v in tables.items() if k != "summary"}, path, run_id)
    tables["summary"].coalesce(1).write.mode("overwrite").json(f"{path}/summary/RUN_ID={run_id}")


def patient_fits(subscales: DataFrame, attributes: DataFrame) -> DataFrame:
    """PPF and CONTRIB from long subscales (PATIENT_ID, SCALE, SCORE) and wide protocol attributes, over the mapped scales.

    Scales without a maximum, and mapped scales that no patient has, are errors.
    """
    values = fit.scale_attributes(attributes)
    scales = sorted(fit.SCALE_FEATURES)
    deficits = fit.deficits(fit.require_scales(fit.canonical_scales(subscales), scales))
    return fit.fits(fit.as_vector(deficits, "PATIENT_ID", scales, "DEFICIT"), fit.as_vector(values, "PROTOCOL_ID", scales, "VALUE"))


def protocol_similarity(attributes: DataFrame) -> DataFrame:
    long = fit.scale_attributes(attributes).select("PROTOCOL_ID", F.col("SCALE").alias("FEATURE"), "VALUE")
    return fit.similarity(long)
