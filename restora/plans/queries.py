"""The registered queries: each applies operators to whole tables; SQL beside it gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from restora.constants import ALLOWED_PROTOCOLS, BY_PP, NOT_PERFORMED, SCALE_ALIASES, SCALE_FEATURES, SCALE_MAXIMA
from restora.functions import clinical, dates, series, vectors
from restora.operators import cohort, faults, fit, profile, quality, recommend, scoring, sessions
from restora.plans import oracles as sql
from restora.plans import study
from restora.sources import sinks, study_views, tables
from restora.sources.scratch import scratch_folder
from restora.streaming.usage import weekly_usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def day():
    return F.lit(study_views.SCORING_DATE).cast("date")


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle.replace(", 6)", " + 1e-10, 6)")  # as in r6
        return f

    return add


def text(c: str, out: str | None = None):
    """An array as text."""
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(out or c)


def r6(x):
    """Six digits; the shift keeps halves of the last digit from falling either way with the order of a sum."""
    return F.round(x + 1e-10, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


def r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" for c in columns)


def s25(spark, d):
    return study_views.sessions(spark, d)


def s5(spark, d):
    return study_views.sessions(spark, d, by_five=False)


def parts25(spark, d):
    """As s25 without event_id, in parts by patient that don't grow with the table, for what goes through many sorts."""
    return study_views.sessions(spark, d, deal=True).drop("event_id")


def trial(spark, d, rows):
    return sessions.in_trial(sessions.with_missing_sessions(rows.drop("event_id"), day()), study_views.patients(spark, d), day())


def similarities(spark, d):
    _, p = study_views.vectors(spark, d)
    long = p.select("PROTOCOL_ID", F.posexplode("VECTOR").alias("FEATURE", "VALUE")).withColumn("FEATURE", F.col("FEATURE").cast("string"))
    return fit.similarity(long)


def of_studies(spark, d, *ids):
    return study_views.studies(spark, d).where(F.col("STUDY_ID").isin(*ids)).select("PATIENT_ID")


def fits(spark, d):
    return fit.fits(*study_views.vectors(spark, d))


def scores(spark, d):
    return study.score_table(fits(spark, d), parts25(spark, d), study_views.patients(spark, d), day())


# --- A: scans, sources, sinks ------------------------------------------------------------------------


@query("a01_session_scan", f"WITH {sql.BASE} SELECT PATIENT_ID, count(*) AS N, count(SESSION_ID) AS DONE FROM s25 WHERE PATIENT_ID IN (SELECT PATIENT_ID FROM stud WHERE STUDY_ID = 2) GROUP BY 1")
def session_scan(spark, d):
    wanted = study_views.studies(spark, d).where("STUDY_ID = 2")
    return tables.of_patients(s25(spark, d), wanted).groupBy("PATIENT_ID").agg(F.count("*").alias("N"), F.count("SESSION_ID").alias("DONE"))


@query("a04_subscale_scan", """WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS PATIENT_ID, c_custkey + 2 AS n FROM customer) SELECT PATIENT_ID, 'MoCA.Attention' AS SCALE, CAST(n % 7 AS DOUBLE) AS SCORE FROM c UNION ALL SELECT PATIENT_ID, 'MoCA.Naming', CAST(n % 4 AS DOUBLE) FROM c UNION ALL SELECT PATIENT_ID, 'ARAT.Grasp', CAST(n % 16 AS DOUBLE) FROM c""")
def subscale_scan(spark, d):
    return clinical.last_evaluation(study_views.clinical_json(spark, d), "CLINICAL_SCORES", ["PATIENT_ID"])


@query("a05_cohort", f"WITH {sql.BASE} SELECT PATIENT_ID FROM stud WHERE STUDY_ID IN (1, 2)")
def cohort_ids(spark, d):
    return tables.cohort(study_views.studies(spark, d), [1, 2])


@query("a09_completed_fits", f"""WITH {sql.BASE}, {sql.VECTORS}, have AS (SELECT * FROM fits WHERE PATIENT_ID NOT IN (SELECT PATIENT_ID FROM stud WHERE STUDY_ID = 3)) SELECT PATIENT_ID, PROTOCOL_ID, round(PPF, 6) AS PPF FROM have WHERE PATIENT_ID IN (SELECT PATIENT_ID FROM pat)
UNION ALL SELECT PATIENT_ID, PROTOCOL_ID, NULL FROM (SELECT PATIENT_ID FROM pat WHERE PATIENT_ID NOT IN (SELECT PATIENT_ID FROM have)), (SELECT DISTINCT PROTOCOL_ID FROM have)""")
def completed(spark, d):
    have = fits(spark, d).join(of_studies(spark, d, 3), "PATIENT_ID", "left_anti")
    return rounded(tables.completed_fits(have, study_views.patients(spark, d)).select("PATIENT_ID", "PROTOCOL_ID", "PPF"), "PPF")


@query("a13_union_modes", f"WITH {sql.BASE} SELECT MODE, count(*) AS N, count(DM_VALUE) AS DM FROM (SELECT 'app' AS MODE, DM_VALUE FROM s25 UNION ALL SELECT 'plus', NULL FROM s5) GROUP BY 1")
def union_modes(spark, d):
    both = tables.union_modes({"app": s25(spark, d), "plus": s5(spark, d).drop("DM_VALUE")})
    return both.groupBy("MODE").agg(F.count("*").alias("N"), F.count("DM_VALUE").alias("DM"))


@query("a14_read_or_empty", f"WITH {sql.BASE} SELECT count(*) AS N FROM s25")
def read_or_empty(spark, d):
    schema = tables.schema_of("PATIENT_ID bigint, SESSION_ID bigint")
    lost = tables.read_or_empty(spark, lambda: spark.read.parquet(f"{d}/no_such_table.parquet"), schema)
    return tables.read_or_empty(spark, lambda: s25(spark, d), schema).unionByName(lost).agg(F.count("*").alias("N"))


@query("a15_upsert", f"""WITH {sql.BASE}, {sql.VECTORS}, new AS (SELECT PATIENT_ID, PROTOCOL_ID, PPF + 1 AS PPF FROM fits WHERE PATIENT_ID IN (SELECT PATIENT_ID FROM stud WHERE STUDY_ID IN (0, 1))) SELECT PATIENT_ID, PROTOCOL_ID, round(PPF, 6) AS PPF FROM new UNION ALL SELECT PATIENT_ID, PROTOCOL_ID, round(PPF, 6) FROM fits WHERE PATIENT_ID NOT IN (SELECT PATIENT_ID FROM new)""")
def upsert(spark, d):
    f = fits(spark, d).drop("CONTRIB")
    new = f.join(of_studies(spark, d, 0, 1), "PATIENT_ID", "left_semi").withColumn("PPF", F.col("PPF") + 1)
    return rounded(sinks.upserted(f, new), "PPF")


@query("a17_staging", f"""WITH {sql.BASE}, {sql.weeks("s25")}, j AS (SELECT PATIENT_ID, PROTOCOL_ID, WEEKS_SINCE_START, DAYS, st FROM us LEFT JOIN wu USING (PATIENT_ID, PROTOCOL_ID) JOIN wk USING (PATIENT_ID))
SELECT 'run1' AS RUN_ID, PATIENT_ID, PROTOCOL_ID, st + 7 * WEEKS_SINCE_START AS STARTING_DATE, st + 7 * WEEKS_SINCE_START + 7 AS ENDING_DATE, WEEKDAY FROM (SELECT PATIENT_ID, PROTOCOL_ID, WEEKS_SINCE_START, st, unnest(CASE WHEN DAYS IS NULL THEN [NULL] ELSE DAYS END) AS WEEKDAY FROM j)""")
def staging(spark, d):
    s, p = s25(spark, d), study_views.patients(spark, d)
    rows = sessions.usage(s).join(sessions.week_usage(s, p, day()), BY_PP, "left").join(sessions.with_weeks(p, day()), "PATIENT_ID").join(p, "PATIENT_ID")
    return sinks.staging(rows, "run1")


_METRICS = ("PPF", "ADHERENCE_RECENT", "DELTA_DM", "WEEKS_SINCE_START", "SESSION_INDEX", "USAGE", "USAGE_WEEK", "SCORE")


@query("a18_metrics", f"WITH {sql.SCORES} SELECT PATIENT_ID, PROTOCOL_ID, KEY, round(VALUE, 6) AS VALUE, 'r' AS RUN_ID FROM (" + " UNION ALL ".join(f"SELECT PATIENT_ID, PROTOCOL_ID, '{m}' AS KEY, CAST({m} AS DOUBLE) AS VALUE FROM sc" for m in _METRICS) + ")")
def metrics(spark, d):
    return rounded(sinks.metrics(scores(spark, d), "r"), "VALUE")


@query("a20_preview", f"WITH {sql.BASE} SELECT PATIENT_ID, event_id, round(ADHERENCE, 3) AS ADHERENCE, (SELECT count(*) FROM s25) AS ROW_COUNT FROM s25 ORDER BY event_id LIMIT 7")
def preview(spark, d):
    return sinks.preview(s25(spark, d).select("PATIENT_ID", "event_id", "ADHERENCE"), ["event_id"], 7)


@query("a21_run_summary", f"WITH {sql.BASE}, s AS (SELECT PATIENT_ID, CASE WHEN count(SESSION_ID) > 60 THEN 'ok' ELSE 'failed' END AS st FROM s25 GROUP BY 1) SELECT count(*) AS PATIENTS, count(*) FILTER (st = 'ok') AS SUCCEEDED, count(*) FILTER (st <> 'ok') AS FAILED, CASE WHEN count(*) = 0 THEN 'warning' WHEN count(*) FILTER (st <> 'ok') = 0 THEN 'success' WHEN count(*) FILTER (st = 'ok') = 0 THEN 'failure' ELSE 'partial_success' END AS OVERALL FROM s")
def run_summary(spark, d):
    return sinks.run_summary(s25(spark, d).groupBy("PATIENT_ID").agg(F.when(F.count("SESSION_ID") > 60, "ok").otherwise("failed").alias("STATUS")))


# --- B: filters --------------------------------------------------------------------------------------


@query("b01_allow_list", f"WITH {sql.BASE} SELECT PROTOCOL_ID, count(*) AS N FROM s25 WHERE PROTOCOL_ID IN (200,201,202,203,204,205,206,208,209,210,214,215,217,218,219,221,222,223,224,225,226,227,231) GROUP BY 1")
def allow_list(spark, d):
    return recommend.allowed(s25(spark, d), ["PROTOCOL_ID"]).groupBy("PROTOCOL_ID").agg(F.count("*").alias("N"))


@query("b02_trial_window", f"WITH {sql.BASE} SELECT PATIENT_ID, count(*) AS N, max(SESSION_DATE) AS LAST_DATE FROM s25 JOIN pat USING (PATIENT_ID) WHERE SESSION_DATE >= CLINICAL_TRIAL_START_DATE AND SESSION_DATE <= least(CLINICAL_TRIAL_END_DATE, {sql.DAY}) GROUP BY 1")
def trial_window(spark, d):
    return sessions.in_trial(s25(spark, d), study_views.patients(spark, d), day()).groupBy("PATIENT_ID").agg(F.count("*").alias("N"), F.max("SESSION_DATE").alias("LAST_DATE"))


@query("b04_study_range", f"WITH {sql.BASE}, x AS (SELECT *, datediff('day', min(SESSION_DATE) OVER (PARTITION BY PATIENT_ID), SESSION_DATE) AS di FROM s25) SELECT PATIENT_ID, count(*) AS N, max(di) AS LAST_DAY FROM x WHERE di < 10 GROUP BY 1")
def study_range(spark, d):
    return cohort.study_range(s25(spark, d), 10).groupBy("PATIENT_ID").agg(F.count("*").alias("N"), F.max("DAY_INDEX").cast("bigint").alias("LAST_DAY"))


@query("b05_drop_nulls", f"WITH {sql.BASE} SELECT PROTOCOL_ID, count(*) AS N FROM s25 WHERE SESSION_ID IS NOT NULL AND DM_VALUE IS NOT NULL GROUP BY 1")
def drop_nulls(spark, d):
    return s25(spark, d).na.drop(subset=["SESSION_ID", "DM_VALUE"]).groupBy("PROTOCOL_ID").agg(F.count("*").alias("N"))


@query("b06_dedupe", f"WITH {sql.BASE} SELECT PRESCRIPTION_ID, SESSION_DATE, event_id FROM (SELECT *, row_number() OVER (PARTITION BY PRESCRIPTION_ID, SESSION_DATE ORDER BY event_id DESC) AS k FROM s25) WHERE k = 1")
def dedupe(spark, d):
    return sessions.first_of(s25(spark, d), ["PRESCRIPTION_ID", "SESSION_DATE"], ["event_id"], last=True).select("PRESCRIPTION_ID", "SESSION_DATE", "event_id")


@query("b07_active_prescriptions", f"WITH {sql.BASE}, {sql.weeks('s25')} SELECT PATIENT_ID, PROTOCOL_ID, array_to_string(DAYS, ',') AS DAYS FROM wu WHERE len(DAYS) > 0")
def active(spark, d):
    s = s25(spark, d)
    rows = sessions.usage(s).join(sessions.week_usage(s, study_views.patients(spark, d), day()), BY_PP, "left")
    return recommend.prescriptions(rows).select(*BY_PP, text("DAYS"))


@query("b08_patient_status", f"WITH {sql.BASE}, {sql.VECTORS} SELECT PATIENT_ID, CASE WHEN PATIENT_ID IN (SELECT PATIENT_ID FROM fits) AND PATIENT_ID NOT IN (SELECT PATIENT_ID FROM stud WHERE STUDY_ID = 4) THEN 'ok' ELSE 'failed' END AS STATUS FROM pat")
def patient_status(spark, d):
    return recommend.patient_status(study_views.patients(spark, d), fits(spark, d).join(of_studies(spark, d, 4), "PATIENT_ID", "left_anti"))


@query("b10_dates", f"WITH {sql.BASE} SELECT event_id, SESSION_DATE AS D, CAST(NULL AS DATE) AS BAD FROM s25")
def as_dates(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", dates.as_date(F.col("ts")).alias("D"), dates.as_date(F.concat(F.lit("x"), F.col("event_type"), F.lit("xxxxxxxxx"))).alias("BAD"))


@query("b11_missing_scales", "WITH c AS (SELECT 'Nation.' || c_nationkey AS SCALE FROM customer WHERE c_custkey % 7 >= 3 UNION ALL SELECT 'MoCA.Attention' FROM customer) SELECT SCALE FROM (SELECT unnest(list_transform(range(30), lambda i: 'Nation.' || i)) AS SCALE UNION ALL SELECT unnest(['MoCA.Attention', 'MoCA.Recall'])) WHERE SCALE NOT IN (SELECT SCALE FROM c)")
def missing_scales(spark, d):
    """Required scales that no document has; a patient with a high score for attention has one named after the nation as well."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("PATIENT_ID"), "c_nationkey", (F.col("c_custkey") % 7).alias("k"))
    nation = F.when(F.col("k") >= 3, F.concat(F.lit(',"Nation":{"'), "c_nationkey", F.lit('":1}'))).otherwise("")
    documents = c.select("PATIENT_ID", F.concat(F.lit('[{"MoCA":{"Attention":'), "k", F.lit("}"), nation, F.lit("}]")).alias("CLINICAL_SCORES"))
    return fit.missing_scales(clinical.last_evaluation(documents, "CLINICAL_SCORES", ["PATIENT_ID"]), [*(f"Nation.{i}" for i in range(30)), "MoCA.Attention", "MoCA.Recall"])


@query("b12_aliases", "WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS PATIENT_ID, c_custkey + 2 AS n FROM customer) SELECT PATIENT_ID, 'MOCA_ATTENTION' AS SCALE, CAST(n % 7 AS DOUBLE) AS SCORE FROM c UNION ALL SELECT PATIENT_ID, 'MOCA_NAMING', CAST(n % 4 AS DOUBLE) FROM c UNION ALL SELECT PATIENT_ID, 'ARAT_GRASP', CAST(n % 16 AS DOUBLE) FROM c")
def alias_names(spark, d):
    return fit.canonical_scales(subscale_scan(spark, d))


# --- C: joins ----------------------------------------------------------------------------------------


@query("c05_expected_not_performed", f"WITH {sql.BASE}, {sql.expanded('s25')} SELECT PRESCRIPTION_ID, SESSION_DATE FROM lacking")
def expected_not_performed(spark, d):
    s = s25(spark, d)
    return sessions.with_missing_sessions(s, day()).where("event_id is null").select("PRESCRIPTION_ID", "SESSION_DATE")


@query("c07_audited_join", f"WITH {sql.BASE}, {sql.VECTORS}, u AS (SELECT PATIENT_ID, PROTOCOL_ID, count(*) AS n FROM s25 WHERE SESSION_ID IS NOT NULL GROUP BY 1, 2) SELECT CASE WHEN n IS NOT NULL AND PPF IS NOT NULL THEN 'matched' WHEN n IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS \"MATCH\", count(*) AS N FROM u FULL JOIN fits USING (PATIENT_ID, PROTOCOL_ID) GROUP BY 1")
def audited_join(spark, d):
    used = s25(spark, d).where("SESSION_ID is not null").groupBy(*BY_PP).count()
    return quality.audited(used, fits(spark, d), BY_PP).groupBy("MATCH").agg(F.count("*").alias("N"))


@query("c12_sessions_timeseries", f"WITH {sql.BASE} SELECT a.PATIENT_ID, count(*) AS N, round(sum(a.ADHERENCE * b.DM_VALUE), 6) AS S FROM s25 a JOIN s5 b ON a.PATIENT_ID = b.PATIENT_ID AND a.SESSION_ID = b.SESSION_ID GROUP BY 1")
def sessions_timeseries(spark, d):
    b = s5(spark, d).select("PATIENT_ID", "SESSION_ID", "DM_VALUE")
    both = s25(spark, d).drop("DM_VALUE").join(b, ["PATIENT_ID", "SESSION_ID"])
    return both.groupBy("PATIENT_ID").agg(F.count("*").alias("N"), r6(F.sum(F.col("ADHERENCE") * F.col("DM_VALUE"))).alias("S"))


@query("c13_outcome_change", "SELECT CAST(c_custkey AS BIGINT) AS PATIENT_ID, CAST((c_custkey + 2) % 7 - (c_custkey + 1) % 7 AS DOUBLE) AS CHANGE FROM customer")
def outcome_change(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    rows = c.select(F.col("c_custkey").cast("bigint").alias("PATIENT_ID"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).select("PATIENT_ID", F.concat(F.lit("T"), F.col("n") - 1).alias("EVALUATION"), ((F.col("PATIENT_ID") + F.col("n")) % 7).cast("double").alias("SCORE"))
    return cohort.outcome_change(rows, ["PATIENT_ID"], "T0", "T1")


@query("c14_session_weeks", f"WITH {sql.BASE}, w AS (SELECT PATIENT_ID, SESSION_ID, CAST(datediff('day', min(SESSION_DATE) OVER (PARTITION BY PATIENT_ID), SESSION_DATE) // 7 + 1 AS INT) AS WEEK FROM s25 WHERE SESSION_ID IS NOT NULL) SELECT t.event_id, w.WEEK FROM s5 t LEFT JOIN w ON w.PATIENT_ID = t.PATIENT_ID AND w.SESSION_ID = t.SESSION_ID")
def session_weeks(spark, d):
    return cohort.session_weeks(s5(spark, d).select("PATIENT_ID", "SESSION_ID", "event_id"), s25(spark, d)).select("event_id", "WEEK")


@query("c15_user_names", "WITH n AS (SELECT c_custkey AS K, CASE WHEN c_nationkey < 12 THEN 'IT_A_' ELSE 'ES_B_' END || c_name AS n FROM customer), u AS (SELECT K, CASE WHEN starts_with(n, 'IT') THEN lower(replace(n, '_', '')) ELSE n END AS U FROM n), o AS (SELECT o_custkey, CASE WHEN c_nationkey < 12 THEN 'ita' || lower(replace(c_name, '_', '')) ELSE 'ES_B_' || c_name END AS U FROM orders JOIN customer ON c_custkey = o_custkey) SELECT K, count(*) AS ORDERS FROM u JOIN o USING (U) GROUP BY 1")
def user_names(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    prefix = F.when(F.col("c_nationkey") < 12, "IT_A_").otherwise("ES_B_")
    names = c.select(F.col("c_custkey").alias("K"), dates.user_name(F.concat(prefix, "c_name")).alias("U"))
    plain = F.when(F.col("c_nationkey") < 12, F.concat(F.lit("ita"), F.lower(F.replace("c_name", F.lit("_"), F.lit(""))))).otherwise(F.concat(F.lit("ES_B_"), "c_name"))
    orders = spark.read.parquet(f"{d}/orders.parquet").join(c, F.col("o_custkey") == F.col("c_custkey")).select(plain.alias("U"))
    return names.join(orders, "U").groupBy("K").agg(F.count("*").alias("ORDERS"))


# --- D: aggregations ---------------------------------------------------------------------------------


@query("d01_usage", f"WITH {sql.BASE}, {sql.weeks('s25')} SELECT * FROM us")
def usage(spark, d):
    return sessions.usage(s25(spark, d))


@query("d02_week_usage_days", f"WITH {sql.BASE}, {sql.weeks('s25')} SELECT PATIENT_ID, PROTOCOL_ID, USAGE_WEEK, array_to_string(DAYS, ',') AS DAYS FROM wu")
def week_usage(spark, d):
    return sessions.week_usage(s25(spark, d), study_views.patients(spark, d), day()).select(*BY_PP, "USAGE_WEEK", text("DAYS"))


@query("d07_skipped_days", f"WITH {sql.BASE}, {sql.adherence('s25')} SELECT event_id, round(A, 6) AS ADHERENCE FROM blank")
def skipped_days(spark, d):
    return rounded(sessions.skipped_days_blank(s25(spark, d)).select("event_id", "ADHERENCE"), "ADHERENCE")


@query("d08_week_states", f"WITH {sql.SCORES} SELECT PATIENT_ID, bool_or(len(DAYS) > 0) AS HAS_PLAN, coalesce(bool_and(USAGE_WEEK = 0) FILTER (len(DAYS) > 0), false) AS WEEK_SKIPPED, NOT coalesce(bool_or(USAGE_WEEK >= len(DAYS)) FILTER (len(DAYS) > 0), false) AS PARTLY_SKIPPED FROM sc GROUP BY 1")
def week_states(spark, d):
    return recommend.week_states(scores(spark, d))


@query("d10_scale_attributes", """WITH a AS (SELECT CAST(p_partkey AS BIGINT) AS PROTOCOL_ID, CAST(p_size % 5 AS DOUBLE) AS x, CAST(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 4 END AS DOUBLE) AS y FROM part)
SELECT PROTOCOL_ID, 'ARAT_GRASP' AS SCALE, round(CASE WHEN y IS NULL THEN x ELSE (x + y) / 2 END, 6) AS VALUE FROM a UNION ALL SELECT PROTOCOL_ID, 'ARAT_GRIP', x FROM a""")
def scale_attributes(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    wide = p.select(F.col("p_partkey").cast("bigint").alias("PROTOCOL_ID"), (F.col("p_size") % 5).cast("double").alias("REACHING"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 4).cast("double").alias("GRASPING"), (F.col("p_size") % 5).cast("double").alias("OBJECT_MANIPULATION"))
    return rounded(fit.scale_attributes(wide, F.avg, {"ARAT_GRASP": ["REACHING", "GRASPING"], "ARAT_GRIP": ["OBJECT_MANIPULATION"]}), "VALUE")


@query("d11_timepoints", f"WITH {sql.BASE} SELECT PATIENT_ID, PROTOCOL_ID, STATUS AS MODE, WEEKDAY_INDEX AS SECOND, array_to_string(list_sort(list(DISTINCT CAST(SESSION_DATE AS VARCHAR))), ',') AS NAMES, round(avg(DM_VALUE), 6) AS MEAN, CAST(arg_min(SESSION_DATE, event_id) AS VARCHAR) AS FIRST_NAME FROM s25 GROUP BY 1, 2, 3, 4")
def timepoints(spark, d):
    return rounded(cohort.timepoints(s25(spark, d).select(*BY_PP, F.col("STATUS").alias("MODE"), F.col("WEEKDAY_INDEX").alias("SECOND"), F.col("SESSION_DATE").cast("string").alias("name"), "DM_VALUE", "event_id"), [*BY_PP, "MODE", "SECOND"], "name", "DM_VALUE", "event_id").select(*BY_PP, "MODE", "SECOND", text("NAMES"), "MEAN", "FIRST_NAME"), "MEAN")


@query("d12_protocol_start_values", f"WITH {sql.BASE}, {sql.progress('s5')}, a AS (SELECT PROTOCOL_ID, avg(ADHERENCE) AS ADHERENCE FROM s5 GROUP BY 1), b AS (SELECT PROTOCOL_ID, avg(DELTA_DM) AS DM_DELTA FROM del GROUP BY 1) SELECT PROTOCOL_ID, round(ADHERENCE, 6) AS ADHERENCE, round(coalesce(DM_DELTA, 0), 6) AS DM_DELTA FROM a LEFT JOIN b USING (PROTOCOL_ID)")
def protocol_start_values(spark, d):
    s = s5(spark, d)
    return rounded(cohort.protocol_start_values(s, sessions.progress(s)), "ADHERENCE", "DM_DELTA")


_BINS = "wb AS (SELECT *, datediff('day', min(SESSION_DATE) OVER (PARTITION BY PATIENT_ID), SESSION_DATE) AS DAY_INDEX FROM s25), wb2 AS (SELECT *, CAST(DAY_INDEX // 7 + 1 AS INT) AS WEEK FROM wb), wb3 AS (SELECT *, dense_rank() OVER (PARTITION BY PATIENT_ID ORDER BY WEEK) AS RELATIVE_WEEK FROM wb2)"


@query("d13_weekly_spread", f"WITH {sql.BASE}, {_BINS} SELECT CAST(RELATIVE_WEEK AS BIGINT) AS WEEK, round(avg(ADHERENCE), 6) AS MEAN, round(stddev_samp(ADHERENCE), 6) AS STD, round(stddev_samp(ADHERENCE) / sqrt(count(ADHERENCE)), 6) AS SE, count(ADHERENCE) AS N, count(DISTINCT PATIENT_ID) AS PATIENTS FROM wb3 GROUP BY 1")
def weekly_spread(spark, d):
    rows = cohort.mean_and_spread(cohort.week_bins(s25(spark, d)), ["RELATIVE_WEEK"], "ADHERENCE")
    return rounded(rows.select(F.col("RELATIVE_WEEK").cast("bigint").alias("WEEK"), "MEAN", "STD", "SE", "N", "PATIENTS"), "MEAN", "STD", "SE")


@query("d15_daily_means", f"WITH {sql.BASE}, {_BINS} SELECT CAST(DAY_INDEX AS BIGINT) AS DAY, round(avg(ADHERENCE), 6) AS MEAN, round(stddev_samp(ADHERENCE) / sqrt(count(ADHERENCE)), 6) AS SE, count(ADHERENCE) AS N FROM wb GROUP BY 1")
def daily_means(spark, d):
    rows = cohort.mean_and_spread(cohort.day_index(s25(spark, d)), ["DAY_INDEX"], "ADHERENCE")
    return rounded(rows.select(F.col("DAY_INDEX").cast("bigint").alias("DAY"), "MEAN", "SE", "N"), "MEAN", "SE")


@query("d16_weekly_change", f"WITH {sql.BASE}, {_BINS}, t AS (SELECT PATIENT_ID, WEEK, sum(ADHERENCE) AS TOTAL FROM wb2 GROUP BY 1, 2) SELECT PATIENT_ID, round(arg_min(TOTAL, WEEK), 6) AS FIRST, round(arg_max(TOTAL, WEEK), 6) AS LAST, round(arg_max(TOTAL, WEEK) - arg_min(TOTAL, WEEK), 6) AS DELTA FROM t GROUP BY 1")
def weekly_change(spark, d):
    return rounded(cohort.weekly_change(cohort.week_bins(s25(spark, d)), "ADHERENCE"), "FIRST", "LAST", "DELTA")


@query("d17_trend", f"WITH {sql.BASE}, {_BINS} SELECT PATIENT_ID, round(CASE WHEN count(*) > 1 AND stddev_pop(DAY_INDEX) > 0 THEN regr_slope(DM_VALUE, DAY_INDEX) END, 6) AS SLOPE FROM wb WHERE DM_VALUE IS NOT NULL GROUP BY 1")
def trends(spark, d):
    return rounded(cohort.trend(cohort.day_index(s25(spark, d)), ["PATIENT_ID"], "DM_VALUE", "DAY_INDEX"), "SLOPE")


@query("d18_upper_quantile", f"WITH {sql.VECTORS} SELECT PATIENT_ID, PROTOCOL_ID FROM (SELECT *, quantile_cont(PPF, 0.85) OVER (PARTITION BY PATIENT_ID) AS q FROM fits) WHERE PPF > q")
def upper_quantile(spark, d):
    return recommend.upper_quantile(fits(spark, d).withColumnRenamed("PPF", "SCORE")).select(*BY_PP)


@query("d19_histogram", f"WITH {sql.BASE} SELECT PROTOCOL_ID, CAST(least(floor(DM_VALUE / (CAST(1 AS DOUBLE) / 15)), 14) AS INT) AS BIN, count(*) AS N FROM s5 WHERE DM_VALUE BETWEEN 0 AND 1 GROUP BY 1, 2")
def histogram(spark, d):
    return cohort.histogram(s5(spark, d), ["PROTOCOL_ID"], "DM_VALUE", 15)


@query("d20_cohort_summary", f"""WITH {sql.BASE}, {sql.VECTORS}, once AS (SELECT * FROM s25 WHERE SESSION_ID IS NOT NULL), di AS (SELECT *, datediff('day', min(SESSION_DATE) OVER (PARTITION BY PATIENT_ID), SESSION_DATE) AS x FROM once),
sl AS (SELECT PATIENT_ID, avg(s) AS ms FROM (SELECT PATIENT_ID, PROTOCOL_ID, CASE WHEN count(*) > 1 AND stddev_pop(x) > 0 THEN regr_slope(DM_VALUE, x) END AS s FROM di GROUP BY 1, 2) GROUP BY 1)
SELECT PATIENT_ID, SESSIONS, TOTAL, SPAN, MEAN_PPF, PROTOCOLS, MEAN_ADHERENCE, round(ms, 6) AS MEAN_SLOPE FROM (SELECT PATIENT_ID, count(*) AS SESSIONS, round(sum(DM_VALUE), 6) AS TOTAL, datediff('day', min(SESSION_DATE), max(SESSION_DATE)) AS SPAN, round(avg(PPF), 6) AS MEAN_PPF, count(DISTINCT PROTOCOL_ID) AS PROTOCOLS, round(avg(ADHERENCE), 6) AS MEAN_ADHERENCE FROM once LEFT JOIN fits USING (PATIENT_ID, PROTOCOL_ID) GROUP BY 1) LEFT JOIN sl USING (PATIENT_ID)""")
def cohort_summary(spark, d):
    rows = cohort.cohort_summary(s25(spark, d), fits(spark, d)).withColumn("SPAN", F.col("SPAN").cast("bigint"))
    return rounded(rows, "TOTAL", "MEAN_PPF", "MEAN_ADHERENCE", "MEAN_SLOPE")


@query("d21_spearman", f"WITH {sql.BASE}, x AS (SELECT ADHERENCE AS a, DM_VALUE AS b FROM s25 WHERE DM_VALUE IS NOT NULL), k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x) SELECT round(corr(ra, rb), 6) AS RHO, count(*) AS N FROM k")
def spearman(spark, d):
    return rounded(cohort.spearman(s25(spark, d), "ADHERENCE", "DM_VALUE"), "RHO")


@query("d22_linear_model", f"WITH {sql.BASE}, x AS (SELECT * FROM s25 WHERE DM_VALUE IS NOT NULL) SELECT '(intercept)' AS TERM, round(regr_intercept(DM_VALUE, ADHERENCE), 6) AS COEFFICIENT, round(regr_r2(DM_VALUE, ADHERENCE), 6) AS R2 FROM x UNION ALL SELECT 'ADHERENCE', round(regr_slope(DM_VALUE, ADHERENCE), 6), round(regr_r2(DM_VALUE, ADHERENCE), 6) FROM x")
def linear_model(spark, d):
    return rounded(cohort.linear_model(s25(spark, d), "DM_VALUE", ["ADHERENCE"]).select("TERM", "COEFFICIENT", "R2"), "COEFFICIENT", "R2")


@query("d23_mediation", f"""WITH {sql.BASE}, x AS (SELECT PROTOCOL_ID, CAST(WEEKDAY_INDEX AS DOUBLE) AS x, ADHERENCE AS m, DM_VALUE AS y FROM s5 WHERE DM_VALUE IS NOT NULL), c AS (SELECT PROTOCOL_ID, covar_pop(x, m) AS xm, covar_pop(x, y) AS xy, covar_pop(m, y) AS my, var_pop(x) AS xx, var_pop(m) AS mm FROM x GROUP BY 1)
SELECT PROTOCOL_ID, round(xm / xx, 6) AS A, round((my * xx - xm * xy) / (xx * mm - xm * xm), 6) AS B, round((xy * mm - xm * my) / (xx * mm - xm * xm), 6) AS DIRECT, round(xm / xx * (my * xx - xm * xy) / (xx * mm - xm * xm), 6) AS INDIRECT FROM c""")
def mediation(spark, d):
    rows = s5(spark, d).withColumn("W", F.col("WEEKDAY_INDEX").cast("double"))
    return rounded(cohort.mediation_terms(rows, ["PROTOCOL_ID"], "W", "ADHERENCE", "DM_VALUE"), "A", "B", "DIRECT", "INDIRECT")


_DRAWN = " + ".join(f"CASE WHEN h >= {b} THEN 1 ELSE 0 END" for b in cohort.POISSON)


@query("d23_mediation_interval", f"""WITH {sql.BASE}, x AS (SELECT event_id, CAST(WEEKDAY_INDEX AS DOUBLE) AS x, ADHERENCE AS m, DM_VALUE AS y FROM s25 WHERE DM_VALUE IS NOT NULL),
d AS (SELECT DRAW, {sql.mixed("event_id", "DRAW")} AS h, x, m, y FROM x, (SELECT unnest(range(1, 5001)) AS DRAW)), w AS (SELECT DRAW, {_DRAWN} AS w, x, m, y FROM d),
t AS (SELECT DRAW, sum(w) AS n, sum(w * x) AS sx, sum(w * m) AS sm, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * m) AS sxm, sum(w * x * y) AS sxy, sum(w * m * m) AS smm, sum(w * m * y) AS smy FROM w GROUP BY 1),
c AS (SELECT DRAW, sxx - sx * sx / n AS xx, sxm - sx * sm / n AS xm, sxy - sx * sy / n AS xy, smm - sm * sm / n AS mm, smy - sm * sy / n AS my FROM t WHERE n > 2),
e AS (SELECT xm / xx * (my * xx - xm * xy) / (xx * mm - xm * xm) AS i FROM c) SELECT round(quantile_cont(i, 0.025), 6) AS LOW, round(quantile_cont(i, 0.975), 6) AS HIGH, count(i) AS DRAWS FROM e""")
def mediation_interval(spark, d):
    rows = s25(spark, d).withColumn("W", F.col("WEEKDAY_INDEX").cast("double"))
    return rounded(cohort.mediation_interval(rows, "W", "ADHERENCE", "DM_VALUE", "event_id", 5000), "LOW", "HIGH")


@query("d24_partial_residuals", f"WITH {sql.BASE}, x AS (SELECT event_id, DM_VALUE AS y, ADHERENCE AS x, CAST(WEEKDAY_INDEX AS DOUBLE) AS z FROM s25 WHERE DM_VALUE IS NOT NULL), c AS (SELECT regr_slope(y, z) AS b1, regr_intercept(y, z) AS a1, regr_slope(x, z) AS b2, regr_intercept(x, z) AS a2 FROM x) SELECT event_id, round(y - a1 - b1 * z, 6) AS Y_RESIDUAL, round(x - a2 - b2 * z, 6) AS X_RESIDUAL FROM x, c")
def partial_residuals(spark, d):
    rows = s25(spark, d).select("event_id", "DM_VALUE", "ADHERENCE", F.col("WEEKDAY_INDEX").cast("double").alias("W"))
    return rounded(cohort.partial_residuals(rows, "DM_VALUE", "ADHERENCE", ["W"]).select("event_id", "Y_RESIDUAL", "X_RESIDUAL"), "Y_RESIDUAL", "X_RESIDUAL")


@query("d25_diagnostics", f"""WITH {sql.BASE}, x AS (SELECT event_id, DM_VALUE AS y, ADHERENCE AS x FROM s25 WHERE DM_VALUE IS NOT NULL), c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS m, sum(x * x) - count(*) * avg(x) * avg(x) AS s, count(*) AS n FROM x),
f AS (SELECT event_id, a + b * x AS fit, y - a - b * x AS res, 1.0 / n + (x - m) * (x - m) / s AS h, n FROM x, c), g AS (SELECT sum(res * res) / (any_value(n) - 2) AS mse FROM f)
SELECT event_id, round(fit, 6) AS FITTED, round(res, 6) AS RESIDUAL, round(h, 6) AS LEVERAGE, round(res / sqrt(mse * (1 - h)), 4) AS STUDENTIZED, round(res * res / (mse * (1 - h)) * h / (1 - h) / 2, 6) AS COOKS FROM f, g""")
def diagnostics(spark, d):
    rows = cohort.diagnostics(s25(spark, d).select("event_id", "DM_VALUE", "ADHERENCE"), "DM_VALUE", ["ADHERENCE"])
    return rounded(rows.select("event_id", "FITTED", "RESIDUAL", "LEVERAGE", F.round("STUDENTIZED", 4).alias("STUDENTIZED"), "COOKS"), "FITTED", "RESIDUAL", "LEVERAGE", "COOKS")


@query("d26_signal_to_noise", f"WITH {sql.BASE}, {sql.progress('s5')} SELECT PROTOCOL_ID, round(var_pop(DM_SMOOTH) / nullif(var_pop(DELTA_DM - DM_SMOOTH), 0), 6) AS SNR FROM del GROUP BY 1")
def snr(spark, d):
    return rounded(cohort.signal_to_noise(sessions.progress(s5(spark, d)), ["PROTOCOL_ID"], "DM_SMOOTH", "DELTA_DM"), "SNR")


@query("d27_protocol_counts", f"WITH {sql.BASE} SELECT PATIENT_ID, " + ", ".join(f"count(*) FILTER (PROTOCOL_ID = {p}) AS \"{p}\"" for p in range(200, 205)) + " FROM s5 GROUP BY 1")
def protocol_counts(spark, d):
    return cohort.protocol_counts(s5(spark, d), list(range(200, 205)))


@query("d28_consistency", f"WITH {sql.BASE}, a AS (SELECT DISTINCT PROTOCOL_ID AS v FROM s25), b AS (SELECT DISTINCT PROTOCOL_ID AS v FROM s5) SELECT 'PROTOCOL_ID' AS \"COLUMN\", (SELECT count(*) FROM a) AS IN_LEFT, (SELECT count(*) FROM b) AS IN_RIGHT, (SELECT count(*) FROM a WHERE v NOT IN (SELECT v FROM b)) AS LEFT_ONLY, (SELECT count(*) FROM b WHERE v NOT IN (SELECT v FROM a)) AS RIGHT_ONLY FROM (SELECT count(*) FROM events)")
def consistency(spark, d):
    return quality.consistency(s25(spark, d), s5(spark, d), ["PROTOCOL_ID"])


# --- E: windows and time series ----------------------------------------------------------------------


@query("e01_session_index", f"WITH {sql.BASE} SELECT event_id, row_number() OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY SESSION_DATE, WEEKDAY_INDEX, PRESCRIPTION_ID, SESSION_ID NULLS FIRST, event_id) AS SESSION_INDEX FROM s25")
def session_index(spark, d):
    return series.session_index(s25(spark, d), BY_PP, [*sessions.IN_ORDER, "event_id"]).select("event_id", F.col("SESSION_INDEX").cast("bigint").alias("SESSION_INDEX"))


@query("e03_ewma", f"WITH {sql.BASE}, q AS (SELECT *, row_number() OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY event_id) AS i FROM s5) SELECT t.event_id, round(sum(pow(0.5, t.i - u.i) * u.DM_VALUE) / sum(CASE WHEN u.DM_VALUE IS NOT NULL THEN pow(0.5, t.i - u.i) END), 6) AS DM_EWMA FROM q t JOIN q u ON t.PATIENT_ID = u.PATIENT_ID AND t.PROTOCOL_ID = u.PROTOCOL_ID AND u.i <= t.i GROUP BY 1")
def ewma(spark, d):
    return rounded(series.ewma(s5(spark, d), "DM_VALUE", BY_PP, ["event_id"], "DM_EWMA").select("event_id", "DM_EWMA"), "DM_EWMA")


@query("e04_smooth_slope", f"WITH {sql.BASE}, {sql.progress('s5')} SELECT PATIENT_ID, PROTOCOL_ID, DM_INDEX, {r('DM_SMOOTH', 'DELTA_DM')} FROM del")
def smooth_slope(spark, d):
    return rounded(sessions.progress(s5(spark, d)).select(*BY_PP, F.col("DM_INDEX").cast("bigint").alias("DM_INDEX"), "DM_SMOOTH", "DELTA_DM"), "DM_SMOOTH", "DELTA_DM")


@query("e06_nth_row", f"WITH {sql.BASE} SELECT PATIENT_ID, PROTOCOL_ID, event_id FROM (SELECT *, row_number() OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY event_id) AS k FROM s5) WHERE k = 2 AND DM_VALUE IS NOT NULL")
def nth(spark, d):
    return series.nth_row(s5(spark, d), BY_PP, ["event_id"], 1, "DM_VALUE").select(*BY_PP, "event_id")


@query("e08_recent_adherence", f"WITH {sql.BASE}, {sql.expanded('s5')}, {sql.adherence('tr')} SELECT PATIENT_ID, PROTOCOL_ID, SESSION_INDEX, round(ADHERENCE_RECENT, 6) AS ADHERENCE_RECENT FROM adh")
def recent_adherence(spark, d):
    rows = sessions.recent_adherence(trial(spark, d, s5(spark, d)))
    return rounded(rows.select(*BY_PP, F.col("SESSION_INDEX").cast("bigint").alias("SESSION_INDEX"), "ADHERENCE_RECENT"), "ADHERENCE_RECENT")


@query("e10_last_week", f"WITH {sql.BASE}, {sql.weeks('s25')} SELECT wk.PATIENT_ID, WEEKS_SINCE_START, WEEK_START, WEEK_END FROM wk LEFT JOIN lw USING (PATIENT_ID)")
def last_week(spark, d):
    p = study_views.patients(spark, d)
    return sessions.with_weeks(p, day()).join(sessions.last_week(p, day()), "PATIENT_ID", "left")


@query("e11_first_difference", f"WITH {sql.BASE} SELECT event_id, round(coalesce(DM_VALUE - lag(DM_VALUE) OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY event_id), 0), 6) AS D FROM s5")
def first_difference(spark, d):
    return rounded(series.first_difference(s5(spark, d), "DM_VALUE", BY_PP, ["event_id"], "D").select("event_id", "D"), "D")


@query("e12_ewma_of_differences", f"WITH {sql.BASE}, p AS (SELECT *, coalesce(DM_VALUE - lag(DM_VALUE) OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY event_id), 0) AS x FROM s5), q AS (SELECT *, row_number() OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY event_id) AS i FROM p) SELECT t.event_id, round(sum(pow(0.2, t.i - u.i) * u.x) / sum(pow(0.2, t.i - u.i)), 6) AS E FROM q t JOIN q u ON t.PATIENT_ID = u.PATIENT_ID AND t.PROTOCOL_ID = u.PROTOCOL_ID AND u.i <= t.i GROUP BY 1")
def ewma_of_differences(spark, d):
    rows = series.first_difference(s5(spark, d), "DM_VALUE", BY_PP, ["event_id"], "x")
    return rounded(series.ewma(rows, "x", BY_PP, ["event_id"], "E", 0.8).select("event_id", "E"), "E")


def _slopes(w):
    return "[" + ",".join("[" + ",".join(repr(float(c)) for c in row) + "]" for row in series.polynomial_rows(w, 1)) + "]"


@query("e13_smooth_derivative", f"WITH {sql.BASE}, {sql.progress('s5')} SELECT PATIENT_ID, PROTOCOL_ID, DM_INDEX, round(CASE WHEN n < 3 THEN DM_VALUE WHEN w = 3 THEN list_dot_product(vs[st + 1 : st + 3], CAST(({_slopes(3)})[DM_INDEX - st] AS DOUBLE[])) WHEN w = 5 THEN list_dot_product(vs[st + 1 : st + 5], CAST(({_slopes(5)})[DM_INDEX - st] AS DOUBLE[])) ELSE list_dot_product(vs[st + 1 : st + 7], CAST(({_slopes(7)})[DM_INDEX - st] AS DOUBLE[])) END, 6) AS SLOPE FROM dp")
def smooth_derivative(spark, d):
    values = series.session_index(s5(spark, d).where("SESSION_ID is not null and DM_VALUE is not null"), BY_PP, ["SESSION_DATE", "SESSION_ID"], "DM_INDEX")
    out = series.polynomial_filter(values, "DM_VALUE", BY_PP, ["DM_INDEX"], "SLOPE", 7, derivative=1)
    return rounded(out.select(*BY_PP, F.col("DM_INDEX").cast("bigint").alias("DM_INDEX"), "SLOPE"), "SLOPE")


@query("e16_calendar_weeks", f"WITH {sql.BASE} SELECT event_id, CAST(strftime(SESSION_DATE, '%W') AS INT) AS WEEK, WEEKDAY_INDEX >= 5 AS WEEKEND FROM s25")
def calendar_weeks(spark, d):
    return s25(spark, d).select("event_id", dates.monday_week(F.col("SESSION_DATE")).alias("WEEK"), dates.is_weekend(F.col("WEEKDAY_INDEX")).alias("WEEKEND"))


@query("e17_relative_weeks", f"WITH {sql.BASE}, {_BINS} SELECT event_id, WEEK, CAST(RELATIVE_WEEK AS INT) AS RELATIVE_WEEK FROM wb3")
def relative_weeks(spark, d):
    return cohort.week_bins(s25(spark, d)).select("event_id", "WEEK", "RELATIVE_WEEK")


@query("e18_weekly_replay", f"WITH {sql.BASE}, {_BINS}, w AS (SELECT DISTINCT PATIENT_ID, WEEK AS UP_TO FROM wb2) SELECT PATIENT_ID, UP_TO, count(*) AS N, round(avg(ADHERENCE), 6) AS MEAN FROM wb2 JOIN w USING (PATIENT_ID) WHERE WEEK <= UP_TO GROUP BY 1, 2")
def weekly_replay(spark, d):
    rows = cohort.cumulative_weeks(cohort.week_bins(s25(spark, d)))
    return rounded(rows.groupBy("PATIENT_ID", "UP_TO").agg(F.count("*").alias("N"), F.avg("ADHERENCE").alias("MEAN")), "MEAN")


def _scores_at(days):
    columns = f"PATIENT_ID, PROTOCOL_ID, {r('ADHERENCE_RECENT', 'DELTA_DM', 'SCORE')}, WEEKS_SINCE_START, USAGE, USAGE_WEEK"
    return " UNION ALL ".join(f"SELECT * FROM (WITH {sql.SCORES.replace(sql.DAY, f'(CLINICAL_TRIAL_START_DATE + {n})')} SELECT {n} AS \"DAY\", {columns} FROM sc)" for n in days)


def scores_at(spark, d, days):
    s, p = parts25(spark, d), study_views.patients(spark, d)
    rows = study.scores_at(fits(spark, d), s, p, days)
    return rounded(rows.select("DAY", *BY_PP, "ADHERENCE_RECENT", "DELTA_DM", "SCORE", "WEEKS_SINCE_START", "USAGE", "USAGE_WEEK"), "ADHERENCE_RECENT", "DELTA_DM", "SCORE")


@query("e18_replayed_scores", _scores_at((7, 14, 21, 28)))
def replayed_scores(spark, d):
    return scores_at(spark, d, (7, 14, 21, 28))


@query("e20_scoring_dates", _scores_at((7, 14)))
def scoring_dates(spark, d):
    return scores_at(spark, d, (7, 14))


@query("e21_changes", f"WITH {sql.BASE} SELECT event_id, coalesce(STATUS <> lag(STATUS) OVER (PARTITION BY PATIENT_ID ORDER BY event_id), true) AS CHANGED FROM s25")
def changes(spark, d):
    return series.changed(s25(spark, d), "STATUS", ["PATIENT_ID"], ["event_id"], "CHANGED").select("event_id", "CHANGED")


@query("e22_filled_daily", f"WITH {sql.BASE}, l AS (SELECT PATIENT_ID, PROTOCOL_ID, SESSION_DATE, arg_max(ADHERENCE, event_id) AS a FROM s5 GROUP BY 1, 2, 3), dd AS (SELECT PATIENT_ID, PROTOCOL_ID, CAST(unnest(generate_series(min(SESSION_DATE), max(SESSION_DATE), INTERVAL 1 DAY)) AS DATE) AS SESSION_DATE FROM l GROUP BY 1, 2) SELECT PATIENT_ID, PROTOCOL_ID, SESSION_DATE, round(last_value(a IGNORE NULLS) OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY SESSION_DATE ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS ADHERENCE FROM dd LEFT JOIN l USING (PATIENT_ID, PROTOCOL_ID, SESSION_DATE)")
def filled_daily(spark, d):
    return rounded(cohort.filled_daily(s5(spark, d), BY_PP, "SESSION_DATE", "ADHERENCE", "event_id"), "ADHERENCE")


@query("e23_z_scores", f"WITH {sql.BASE}, m AS (SELECT PROTOCOL_ID, avg(ADHERENCE) AS MEAN FROM s25 GROUP BY 1) SELECT PROTOCOL_ID, round((MEAN - (SELECT avg(MEAN) FROM m)) / (SELECT stddev_pop(MEAN) FROM m), 6) AS Z FROM m")
def z_scores(spark, d):
    means = s25(spark, d).groupBy("PROTOCOL_ID").agg(F.avg("ADHERENCE").alias("MEAN"))
    return rounded(cohort.z_scores(means, "MEAN").select("PROTOCOL_ID", "Z"), "Z")


_SERIES = "g AS (SELECT PATIENT_ID, PROTOCOL_ID, DM_VALUE AS y, CAST(row_number() OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY event_id) AS DOUBLE) AS i FROM s5 WHERE DM_VALUE IS NOT NULL)"


def numbered(spark, d):
    rows = s5(spark, d).where("DM_VALUE is not null")
    return rows.withColumn("i", F.row_number().over(series.ordered(BY_PP, ["event_id"])).cast("double"))


@query("e24_log_growth", f"WITH {sql.BASE}, {_SERIES} SELECT PATIENT_ID, PROTOCOL_ID, round(regr_slope(y, ln(i + 1)), 6) AS A, round(regr_intercept(y, ln(i + 1)), 6) AS B, round(regr_r2(y, ln(i + 1)), 6) AS R2, count(*) AS N FROM g GROUP BY 1, 2 HAVING count(*) > 2")
def log_growth(spark, d):
    return rounded(cohort.log_growth(numbered(spark, d), BY_PP, "DM_VALUE", "i").where("N > 2"), "A", "B", "R2")


_GRID = f"{sql.BASE}, {_SERIES}, m AS (SELECT *, count(*) OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID) - 1 AS span FROM g), t AS (SELECT PATIENT_ID, PROTOCOL_ID, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy FROM g GROUP BY 1, 2 HAVING count(*) > 2)"
_LEAST = "SELECT PATIENT_ID, PROTOCOL_ID, round(min(SSE), 6) AS SSE, round(CASE WHEN any_value(syy - sy * sy / n) > 0 THEN 1 - min(SSE) / any_value(syy - sy * sy / n) END, 6) AS R2, any_value(n) AS N FROM f GROUP BY 1, 2"


@query("e25_exponential_grid", f"WITH {_GRID}, h AS (SELECT PATIENT_ID, PROTOCOL_ID, q, sum(e) AS se, sum(e * e) AS see, sum(e * y) AS sey FROM (SELECT *, exp(-q / span * i) AS e FROM m, (SELECT unnest({cohort.RATES}) AS q)) GROUP BY 1, 2, 3), f AS (SELECT PATIENT_ID, PROTOCOL_ID, n, sy, syy, greatest(0, syy - sy * sy / n - CASE WHEN see - se * se / n > 1e-12 THEN (sey - se * sy / n) * (sey - se * sy / n) / (see - se * se / n) ELSE 0 END) AS SSE FROM h JOIN t USING (PATIENT_ID, PROTOCOL_ID)) {_LEAST}")
def exponential_grid(spark, d):
    return rounded(cohort.exponential_growth(numbered(spark, d), BY_PP, "DM_VALUE", "i", 0).select(*BY_PP, "SSE", "R2", "N"), "SSE", "R2")


@query("e25_logistic_grid", f"WITH {_GRID}, h AS (SELECT PATIENT_ID, PROTOCOL_ID, q, x0, sum(s * s) AS ss, sum(s * y) AS ys FROM (SELECT *, 1 / (1 + exp(-q / span * (i - (1 + x0 * span)))) AS s FROM m, (SELECT unnest({cohort.STEEPNESS}) AS q), (SELECT unnest({cohort.MIDDLES}) AS x0)) GROUP BY 1, 2, 3, 4), f AS (SELECT PATIENT_ID, PROTOCOL_ID, n, sy, syy, greatest(0, syy - CASE WHEN ss > 1e-12 THEN ys * ys / ss ELSE 0 END) AS SSE FROM h JOIN t USING (PATIENT_ID, PROTOCOL_ID)) {_LEAST}")
def logistic_grid(spark, d):
    return rounded(cohort.logistic_growth(numbered(spark, d), BY_PP, "DM_VALUE", "i", 0).select(*BY_PP, "SSE", "R2", "N"), "SSE", "R2")


@query("e25_exponential_growth")
def exponential_growth(spark, d):
    return cohort.exponential_growth(numbered(spark, d), BY_PP, "DM_VALUE", "i")


@query("e25_logistic_growth")
def logistic_growth(spark, d):
    return cohort.logistic_growth(numbered(spark, d), BY_PP, "DM_VALUE", "i")


@query("e26_cumulative", f"WITH {sql.BASE} SELECT event_id, round(sum(ADHERENCE) OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS C FROM s5")
def cumulative(spark, d):
    return rounded(series.cumulative(s5(spark, d), "ADHERENCE", BY_PP, ["event_id"], "C").select("event_id", "C"), "C")


# --- F, G, H: top-k, reshaping, functions ------------------------------------------------------------


@query("f01_top_protocols", f"WITH {sql.VECTORS} SELECT PATIENT_ID, PROTOCOL_ID, CAST(k AS INT) AS \"RANK\" FROM (SELECT *, row_number() OVER (PARTITION BY PATIENT_ID ORDER BY PPF DESC, PROTOCOL_ID) AS k FROM fits) WHERE k <= 10")
def top_protocols(spark, d):
    return recommend.top(fits(spark, d), 10, ["PATIENT_ID"], "PPF", "PROTOCOL_ID", "RANK").select(*BY_PP, "RANK")


@query("f02_top_similar", f"WITH {sql.SIMILARITY} SELECT PROTOCOL_A, PROTOCOL_B FROM (SELECT *, row_number() OVER (PARTITION BY PROTOCOL_A ORDER BY SIMILARITY DESC, PROTOCOL_B) AS k FROM sim WHERE PROTOCOL_A <> PROTOCOL_B) WHERE k <= 5")
def top_similar(spark, d):
    s = similarities(spark, d).where("PROTOCOL_A <> PROTOCOL_B")
    return recommend.top(s, 5, ["PROTOCOL_A"], "SIMILARITY", "PROTOCOL_B").select("PROTOCOL_A", "PROTOCOL_B")


@query("f05_least_used", f"WITH {sql.BASE}, {sql.weeks('s25')} SELECT PATIENT_ID, PROTOCOL_ID FROM (SELECT *, rank() OVER (PARTITION BY PATIENT_ID ORDER BY USAGE) AS k FROM us) WHERE k = 1")
def least_used(spark, d):
    rows = sessions.usage(s25(spark, d))
    return rows.withColumn("k", F.rank().over(Window.partitionBy("PATIENT_ID").orderBy("USAGE"))).where("k = 1").select(*BY_PP)


@query("f10_axis_order", f"WITH {sql.BASE}, m AS (SELECT PROTOCOL_ID, avg(ADHERENCE) AS MEAN FROM s25 GROUP BY 1) SELECT PROTOCOL_ID, round(MEAN, 6) AS MEAN, CAST(row_number() OVER (ORDER BY MEAN DESC, PROTOCOL_ID) AS INT) AS PLACE FROM m")
def axis_order(spark, d):
    return rounded(cohort.axis_order(s25(spark, d), "PROTOCOL_ID", "ADHERENCE"), "MEAN")


@query("g06_adherence_matrix", f"WITH {sql.BASE} SELECT PATIENT_ID, " + ", ".join(f"coalesce(round(avg(ADHERENCE) FILTER (PROTOCOL_ID = {p}), 6), 0) AS \"{p}\"" for p in range(200, 205)) + " FROM s5 GROUP BY 1")
def adherence_matrix(spark, d):
    return rounded(cohort.adherence_matrix(s5(spark, d), list(range(200, 205))), *[str(p) for p in range(200, 205)])


@query("g06_margins", f"WITH {sql.BASE}, c AS (SELECT PATIENT_ID, PROTOCOL_ID, avg(ADHERENCE) AS a FROM s5 GROUP BY 1, 2) SELECT 'patient' AS AXIS, PATIENT_ID AS KEY, round(avg(a), 6) AS MEAN FROM c GROUP BY 2 UNION ALL SELECT 'protocol', PROTOCOL_ID, round(avg(a), 6) FROM c GROUP BY 2")
def matrix_margins(spark, d):
    return rounded(cohort.matrix_margins(s5(spark, d)), "MEAN")


@query("h02_deficits", "WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS PATIENT_ID, c_custkey + 2 AS n FROM customer) SELECT PATIENT_ID, 'MOCA_ATTENTION' AS SCALE, round(1 - (n % 7) / 6.0, 6) AS DEFICIT FROM c UNION ALL SELECT PATIENT_ID, 'MOCA_NAMING', round(1 - (n % 4) / 3.0, 6) FROM c UNION ALL SELECT PATIENT_ID, 'ARAT_GRASP', round(1 - (n % 16) / 15.0, 6) FROM c")
def deficits(spark, d):
    return rounded(fit.deficits(fit.canonical_scales(subscale_scan(spark, d))).select("PATIENT_ID", "SCALE", "DEFICIT"), "DEFICIT")


@query("h03_expected_dates", f"WITH {sql.BASE}, {sql.expanded('s25')} SELECT PRESCRIPTION_ID, SESSION_DATE FROM wanted")
def expected_dates(spark, d):
    return sessions.expected_sessions(s25(spark, d), day()).select("PRESCRIPTION_ID", "SESSION_DATE")


@query("h10_min_max", f"WITH {sql.BASE} SELECT event_id, round((DM_VALUE - min(DM_VALUE) OVER w) / nullif(max(DM_VALUE) OVER w - min(DM_VALUE) OVER w, 0), 6) AS X, round(CASE WHEN DM_VALUE IS NOT NULL THEN greatest(0, least(1, DM_VALUE * 2)) END, 6) AS Y FROM s5 WINDOW w AS (PARTITION BY PATIENT_ID)")
def min_max(spark, d):
    rows = cohort.min_max(s5(spark, d), ["PATIENT_ID"], "DM_VALUE", "X")
    return rounded(rows.select("event_id", "X", vectors.clip(F.col("DM_VALUE") * 2).alias("Y")), "X", "Y")


# --- I: domain operators -----------------------------------------------------------------------------


@query("i01_missing_sessions", f"WITH {sql.BASE}, {sql.expanded('s25')} SELECT PATIENT_ID, PROTOCOL_ID, STATUS, count(*) AS N, round(sum(ADHERENCE), 6) AS A FROM ex GROUP BY 1, 2, 3")
def missing_sessions(spark, d):
    rows = sessions.with_missing_sessions(parts25(spark, d), day())
    return rows.groupBy(*BY_PP, "STATUS").agg(F.count("*").alias("N"), r6(F.sum("ADHERENCE")).alias("A"))


@query("i02_patient_fit", f"WITH {sql.VECTORS}, c AS (SELECT CAST(p.vec_id - 24 AS BIGINT) AS PATIENT_ID, CAST(q.vec_id + 200 AS BIGINT) AS PROTOCOL_ID, list_sum(list_transform(range(1, 65), lambda i: i * p.u[i] * q.u[i])) AS C FROM units p, units q WHERE p.vec_id >= 25 AND q.vec_id < 25) SELECT PATIENT_ID, PROTOCOL_ID, round(PPF, 6) AS PPF, round(C, 6) AS PLACED FROM fits JOIN c USING (PATIENT_ID, PROTOCOL_ID)")
def patient_fit(spark, d):
    placed = F.aggregate(F.transform("CONTRIB", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)  # each contribution counts by its place
    return rounded(fits(spark, d).select(*BY_PP, "PPF", placed.alias("PLACED")), "PPF", "PLACED")


#: Some of the attributes that the scales are made of: at least one for each scale.
_ATTRIBUTES = sorted({f for each in SCALE_FEATURES.values() for f in each[:2]})[:20]


def attributes(spark, d):
    """Wide protocol attributes in 0..1, from the protocols' vectors; one in eight is blank."""
    value = lambda i: F.when(F.abs(F.get("VECTOR", F.lit(i + 20))) > 0.02, F.abs(F.get("VECTOR", F.lit(i))))
    return study_views.vectors(spark, d)[1].select("PROTOCOL_ID", *[value(i).alias(a) for i, a in enumerate(_ATTRIBUTES)])


def all_scores(spark, d):
    """Clinical scores of every mapped scale, in long form, as they come out of JSON, from customer numbers."""
    names = {s: a[0] for s, a in SCALE_ALIASES.items() if s in fit.SCALE_FEATURES}
    body = lambda n: F.to_json(F.map_from_entries(F.array(*[F.struct(F.lit(v.split(".")[1]), ((F.col("c_custkey") + k + n) % (SCALE_MAXIMA[s] + 1)).cast("double")) for k, (s, v) in enumerate(names.items())])))
    text_ = F.concat(F.lit('[{"Old":{"X":1}},{"when":"2024-01-02","Test":'), body(3), F.lit("}]"))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("PATIENT_ID"), text_.alias("CLINICAL_SCORES"))
    long = clinical.last_evaluation(rows, "CLINICAL_SCORES", ["PATIENT_ID"])
    alias = F.create_map(*[F.lit(x) for v in names.values() for x in ("Test." + v.split(".")[1], v)])
    return long.withColumn("SCALE", F.coalesce(F.try_element_at(alias, F.col("SCALE")), F.col("SCALE")))


def _fit_sql():
    names = [s for s in SCALE_ALIASES if s in fit.SCALE_FEATURES]
    value = lambda i: f"CASE WHEN abs(v[{i + 21}]) > 0.02 THEN abs(v[{i + 1}]) END"
    scale = lambda s: "list_avg(list_filter([" + ", ".join(value(_ATTRIBUTES.index(a)) for a in fit.SCALE_FEATURES[s] if a in _ATTRIBUTES) + "], lambda x: x IS NOT NULL))"
    order = sorted(fit.SCALE_FEATURES)
    deficit = lambda s: f"1 - ((c_custkey + {names.index(s) + 3}) % {SCALE_MAXIMA[s] + 1}) / CAST({SCALE_MAXIMA[s]} AS DOUBLE)"
    unit = lambda a: f"list_transform({a}, lambda x: x / (CASE WHEN list_sum(list_transform({a}, lambda y: y * y)) = 0 THEN 1e-10 ELSE sqrt(list_sum(list_transform({a}, lambda y: y * y))) END))"
    q = f"q AS (SELECT CAST(vec_id + 200 AS BIGINT) AS PROTOCOL_ID, [{', '.join(scale(s) for s in order)}] AS b FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) WHERE vec_id < 25)"
    p = f"p AS (SELECT CAST(c_custkey AS BIGINT) AS PATIENT_ID, [{', '.join(deficit(s) for s in order)}] AS a FROM customer)"
    return f"WITH {q}, {p}, q2 AS (SELECT PROTOCOL_ID, {unit('b')} AS b FROM q WHERE len(list_filter(b, lambda x: x IS NULL)) = 0), p2 AS (SELECT PATIENT_ID, {unit('a')} AS a FROM p)"


@query("i02_fit_from_scores", _fit_sql() + " SELECT PATIENT_ID, PROTOCOL_ID, round(list_dot_product(a, b), 6) AS PPF FROM p2, q2")
def fit_from_scores(spark, d):
    return rounded(study.patient_fits(all_scores(spark, d), attributes(spark, d)).select(*BY_PP, "PPF"), "PPF")


@query("i03_similarity", f"WITH {sql.SIMILARITY} SELECT PROTOCOL_A, PROTOCOL_B, round(SIMILARITY, 6) AS SIMILARITY FROM sim")
def protocol_similarity(spark, d):
    return rounded(similarities(spark, d), "SIMILARITY")


@query("i03_one_hot", f"WITH {sql.SIMILARITY}, w AS (SELECT f, CASE WHEN f > 55 THEN CAST(1 AS DOUBLE) / 9 ELSE 1 END AS w FROM spans) SELECT a.PROTOCOL_ID AS PROTOCOL_A, b.PROTOCOL_ID AS PROTOCOL_B, round(1 - sum(w * CASE WHEN r > 0 THEN abs(a.x - b.x) / r ELSE 0 END) / sum(w), 6) AS SIMILARITY FROM dims a JOIN dims b USING (f) JOIN spans USING (f) JOIN w USING (f) GROUP BY 1, 2")
def one_hot_similarity(spark, d):
    long = study_views.vectors(spark, d)[1].select("PROTOCOL_ID", F.posexplode("VECTOR").alias("i", "VALUE"))
    long = long.select("PROTOCOL_ID", F.concat(F.when(F.col("i") >= 55, "HOT_").otherwise("F_"), F.col("i").cast("string")).alias("FEATURE"), "VALUE")
    return rounded(fit.similarity(long, "HOT_"), "SIMILARITY")


@query("i03_similarity_of_attributes", _fit_sql() + """, long AS (SELECT PROTOCOL_ID, unnest(range(len(b))) AS f, unnest(b) AS x FROM q), spans AS (SELECT f, max(x) - min(x) AS r FROM long GROUP BY 1)
SELECT a.PROTOCOL_ID AS PROTOCOL_A, c.PROTOCOL_ID AS PROTOCOL_B, round(1 - sum(CASE WHEN r > 0 THEN abs(a.x - c.x) / r ELSE 0 END) / count(*), 6) AS SIMILARITY FROM long a JOIN long c USING (f) JOIN spans USING (f) GROUP BY 1, 2""")
def similarity_of_attributes(spark, d):
    return rounded(study.protocol_similarity(attributes(spark, d)), "SIMILARITY")


@query("i06_scores", f"WITH {sql.SCORES} SELECT PATIENT_ID, PROTOCOL_ID, {r('PPF', 'ADHERENCE_RECENT', 'DELTA_DM', 'SCORE')}, WEEKS_SINCE_START, SESSION_INDEX, USAGE, USAGE_WEEK, array_to_string(DAYS, ',') AS DAYS FROM sc")
def score_rows(spark, d):
    rows = scores(spark, d).select(*BY_PP, "PPF", "ADHERENCE_RECENT", "DELTA_DM", "SCORE", "WEEKS_SINCE_START", F.col("SESSION_INDEX").cast("bigint").alias("SESSION_INDEX"), "USAGE", "USAGE_WEEK", text("DAYS"))
    return rounded(rows, "PPF", "ADHERENCE_RECENT", "DELTA_DM", "SCORE")


@query("i06_bootstrap_scores", f"WITH {sql.VECTORS} SELECT PATIENT_ID, PROTOCOL_ID, round(PPF, 6) AS SCORE FROM fits")
def bootstrap_scores(spark, d):
    none = s25(spark, d).drop("event_id").where("false")
    return rounded(study.score_table(fits(spark, d), none, study_views.patients(spark, d), day()).select(*BY_PP, "SCORE"), "SCORE")


@query("i07_new_schedule", f"""WITH {sql.VECTORS}, t AS (SELECT *, row_number() OVER (PARTITION BY PATIENT_ID ORDER BY PPF DESC, PROTOCOL_ID) - 1 AS r FROM fits), x AS (SELECT PATIENT_ID, PROTOCOL_ID, unnest(range(r, 35, 12)) % 7 AS dd FROM t WHERE r < 12)
SELECT PATIENT_ID, PROTOCOL_ID, array_to_string(list_sort(list(DISTINCT dd)), ',') AS DAYS FROM x GROUP BY 1, 2""")
def new_schedule(spark, d):
    return recommend.new_schedule(fits(spark, d).withColumnRenamed("PPF", "SCORE")).select(*BY_PP, text("DAYS"))


@query("i08_swaps", f"WITH {sql.SCORES}, {sql.SWAPS} SELECT PATIENT_ID, PROTOCOL_ID FROM sw")
def swaps(spark, d):
    return recommend.swaps(scores(spark, d)).select(*BY_PP)


@query("i09_substitutions", f"WITH RECURSIVE {sql.SCORES}, {sql.SIMILARITY}, {sql.CHAIN} SELECT PATIENT_ID, OLD, NEW FROM chain WHERE k > 0")
def substitutions(spark, d):
    return recommend.substitutions(scores(spark, d), similarities(spark, d))


@query("i11_recommend", f"WITH RECURSIVE {sql.SCORES}, {sql.SIMILARITY}, {sql.RECOMMENDED} SELECT PATIENT_ID, PROTOCOL_ID, BRANCH, round(SCORE, 6) AS SCORE, array_to_string(DAYS, ',') AS DAYS FROM rec")
def recommend_all(spark, d):
    rows = recommend.recommended(scores(spark, d), similarities(spark, d))
    return rounded(rows.select(*BY_PP, "BRANCH", "SCORE", text("DAYS")), "SCORE")


@query("i13_shuffled_schedule", f"""WITH {sql.VECTORS}, t AS (SELECT *, row_number() OVER (PARTITION BY PATIENT_ID ORDER BY PPF DESC, PROTOCOL_ID) AS k FROM fits), m AS (SELECT PATIENT_ID, PROTOCOL_ID, row_number() OVER (PARTITION BY PATIENT_ID ORDER BY {sql.mixed("PATIENT_ID", "PROTOCOL_ID", 7)}, PROTOCOL_ID) - 1 AS r FROM t WHERE k <= 12)
SELECT PATIENT_ID, PROTOCOL_ID, array_to_string(list_sort(list_distinct(list_transform(range(r, 35, 12), lambda i: CAST(i % 7 AS INT)))), ',') AS DAYS FROM m""")
def shuffled(spark, d):
    return recommend.shuffled_schedule(fits(spark, d).withColumnRenamed("PPF", "SCORE"), 7).select(*BY_PP, text("DAYS"))


@query("i14_quantile_swaps", f"""WITH {sql.SCORES}, {sql.SIMILARITY}, plan AS (SELECT * FROM sc WHERE len(DAYS) > 0), q AS (SELECT PATIENT_ID, PROTOCOL_ID FROM (SELECT *, quantile_cont(SCORE, 0.85) OVER (PARTITION BY PATIENT_ID) AS q FROM sc) WHERE SCORE > q),
low AS (SELECT PATIENT_ID, PROTOCOL_ID AS OLD FROM plan WHERE (PATIENT_ID, PROTOCOL_ID) NOT IN (SELECT PATIENT_ID, PROTOCOL_ID FROM q)), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY PROTOCOL_A ORDER BY SIMILARITY DESC, PROTOCOL_B) AS k FROM sim WHERE PROTOCOL_A <> PROTOCOL_B) WHERE k <= 5),
c AS (SELECT low.PATIENT_ID, OLD, PROTOCOL_B, USAGE FROM low JOIN near ON PROTOCOL_A = OLD JOIN sc ON sc.PATIENT_ID = low.PATIENT_ID AND sc.PROTOCOL_ID = PROTOCOL_B WHERE len(sc.DAYS) = 0) SELECT PATIENT_ID, OLD, PROTOCOL_B AS NEW FROM (SELECT *, row_number() OVER (PARTITION BY PATIENT_ID, OLD ORDER BY USAGE, PROTOCOL_B) AS k FROM c) WHERE k = 1""")
def quantile_swaps(spark, d):
    return recommend.swapped_below_quantile(scores(spark, d), similarities(spark, d))


@query("i15_weighted_profile", f"WITH {sql.BASE} SELECT PATIENT_ID, round(sum(ADHERENCE * (k + 1)) FILTER (h = 1) / nullif(sum(ADHERENCE * (k + 1)) FILTER (h = 0), 0), 6) AS RATIO FROM (SELECT PATIENT_ID, ADHERENCE, PROTOCOL_ID - 200 AS k, event_id % 2 AS h FROM s5) GROUP BY 1 HAVING count(*) FILTER (h = 0) > 0 AND count(*) FILTER (h = 1) > 0")
def weighted_profile(spark, d):
    rows = s5(spark, d).select("PATIENT_ID", F.col("ADHERENCE").alias("SCORE"), (F.col("PROTOCOL_ID") - 199).alias("WEIGHT"), (F.col("event_id") % 2).alias("h"))
    return rounded(cohort.weighted_profile(rows.where("h = 0"), rows.where("h = 1"), "PATIENT_ID"), "RATIO")


@query("i16_completed_share", "SELECT l_orderkey AS K, l_linenumber AS L, round(l_quantity * l_discount, 4) AS Q, round(CASE WHEN l_tax > 0 THEN least(l_discount / l_tax, 1) END, 6) AS SHARE FROM lineitem")
def completed_share(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("K"), F.col("l_linenumber").alias("L"), F.round(F.col("l_quantity") * F.col("l_discount"), 4).alias("Q"), r6(cohort.completed_share(F.col("l_discount"), F.col("l_tax"))).alias("SHARE"))


@query("i18_adherence_dataset", f"WITH {sql.BASE}, {sql.expanded('s25')}, x AS (SELECT *, datediff('day', min(SESSION_DATE) OVER (PARTITION BY PATIENT_ID), SESSION_DATE) AS di FROM ex), y AS (SELECT *, row_number() OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID, PRESCRIPTION_ID, SESSION_DATE ORDER BY SESSION_ID NULLS FIRST) AS k FROM x WHERE di < 43) SELECT PATIENT_ID, count(*) AS N, round(sum(ADHERENCE), 6) AS A, CAST(max(di) AS BIGINT) AS LAST_DAY FROM y WHERE k = 1 GROUP BY 1")
def adherence_dataset(spark, d):
    rows = cohort.study_range(sessions.with_missing_sessions(parts25(spark, d), day()))
    once = sessions.first_of(rows, [*BY_PP, "PRESCRIPTION_ID", "SESSION_DATE"], ["SESSION_ID"])
    return once.groupBy("PATIENT_ID").agg(F.count("*").alias("N"), r6(F.sum("ADHERENCE")).alias("A"), F.max("DAY_INDEX").cast("bigint").alias("LAST_DAY"))


# --- K, M: streaming form and checks -----------------------------------------------------------------


@query("k01_windowed_usage", "WITH once AS (SELECT CAST(user_id + 1 AS BIGINT) AS PATIENT_ID, event_type AS PROTOCOL_ID, min(ts) AS ts FROM events WHERE event_id IS NOT NULL GROUP BY 1, 2, event_id) SELECT PATIENT_ID, PROTOCOL_ID, CAST(floor(epoch(ts)) AS BIGINT) // 604800 AS WEEK, count(*) AS USAGE FROM once WHERE ts IS NOT NULL GROUP BY 1, 2, 3")
def windowed_usage(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") + 1).cast("bigint").alias("PATIENT_ID"), F.col("event_type").alias("PROTOCOL_ID"), F.col("event_id").alias("SESSION_ID"), "ts")
    return weekly_usage(e).select(*BY_PP, F.floor(F.unix_timestamp("WEEK_START") / 604800).cast("bigint").alias("WEEK"), "USAGE")


@query("m01_rule_violations", f"WITH {sql.BASE}, x AS (SELECT *, ADHERENCE * 1.2 AS A2, CASE WHEN WEEKDAY_INDEX = 6 THEN 'LOST' ELSE STATUS END AS S2 FROM s25) SELECT 'patient_positive' AS RULE, count(*) FILTER (NOT (PATIENT_ID > 0)) AS N FROM x UNION ALL SELECT 'protocol_positive', count(*) FILTER (NOT (PROTOCOL_ID > 0)) FROM x UNION ALL SELECT 'weekday', count(*) FILTER (NOT (WEEKDAY_INDEX BETWEEN 0 AND 6)) FROM x UNION ALL SELECT 'status', count(*) FILTER (NOT (S2 IN ('CLOSED', 'NOT_PERFORMED'))) FROM x UNION ALL SELECT 'adherence_share', count(*) FILTER (NOT (A2 BETWEEN 0 AND 1)) FROM x UNION ALL SELECT 'dm_share', count(*) FILTER (NOT (DM_VALUE BETWEEN 0 AND 1)) FROM x")
def rule_violations(spark, d):
    rows = s25(spark, d).withColumn("ADHERENCE", F.col("ADHERENCE") * 1.2).withColumn("STATUS", F.when(F.col("WEEKDAY_INDEX") == 6, "LOST").otherwise(F.col("STATUS")))
    return quality.violations(rows, quality.SESSION_RULES)


@query("m02_type_faults", "SELECT 'event_type' AS \"COLUMN\", count(*) AS N FROM events WHERE event_type IS NOT NULL UNION ALL SELECT 'event_id', CAST(0 AS BIGINT) FROM (SELECT count(*) FROM events)")
def type_faults(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.col("event_id").cast("string").alias("event_id"))
    return quality.type_faults(e, {"event_type": "double", "event_id": "bigint"})


@query("m03_session_quality", f"WITH {sql.BASE} SELECT CASE WHEN WEEKDAY_INDEX = 6 THEN 'no_prescription' WHEN SESSION_ID IS NULL THEN 'no_adherence' ELSE 'clean' END AS QUALITY, count(*) AS N FROM s25 GROUP BY 1")
def session_quality(spark, d):
    rows = s25(spark, d).withColumn("PRESCRIPTION_ID", F.when(F.col("WEEKDAY_INDEX") != 6, F.col("PRESCRIPTION_ID"))).withColumn("ADHERENCE", F.when(F.col("STATUS") != NOT_PERFORMED, F.col("ADHERENCE")))
    return quality.session_quality(rows).groupBy("QUALITY").agg(F.count("*").alias("N"))


@query("m04_not_unique", f"WITH {sql.BASE} SELECT PRESCRIPTION_ID, count(DISTINCT STATUS) AS N FROM s25 GROUP BY 1 HAVING count(DISTINCT STATUS) > 1")
def not_unique(spark, d):
    return quality.not_unique(s25(spark, d), ["PRESCRIPTION_ID"], "STATUS")


@query("m05_schedule_days", f"""WITH {sql.VECTORS}, t AS (SELECT *, row_number() OVER (PARTITION BY PATIENT_ID ORDER BY PPF DESC, PROTOCOL_ID) - 1 AS r FROM fits), x AS (SELECT DISTINCT PATIENT_ID, PROTOCOL_ID, CAST(unnest(range(r, 35, 12)) % 7 AS INT) AS "DAY" FROM t WHERE r < 12) SELECT PATIENT_ID, "DAY", count(*) AS N FROM x GROUP BY 1, 2""")
def schedule_days(spark, d):
    return recommend.day_counts(recommend.new_schedule(fits(spark, d).withColumnRenamed("PPF", "SCORE")))


# --- further compositions ----------------------------------------------------------------------------


@query("b03_half_open_week", f"WITH {sql.BASE}, {sql.weeks('s25')} SELECT PATIENT_ID, count(*) AS N FROM s25 JOIN lw USING (PATIENT_ID) WHERE SESSION_DATE >= WEEK_START AND SESSION_DATE < WEEK_END GROUP BY 1")
def half_open_week(spark, d):
    rows = s25(spark, d).join(sessions.last_week(study_views.patients(spark, d), day()), "PATIENT_ID")
    return rows.where("SESSION_DATE >= WEEK_START and SESSION_DATE < WEEK_END").groupBy("PATIENT_ID").agg(F.count("*").alias("N"))


@query("b09_score_lookup", f"WITH {sql.VECTORS} SELECT PATIENT_ID, PROTOCOL_ID, round(PPF, 6) AS PPF FROM fits WHERE PROTOCOL_ID = 200 + PATIENT_ID % 25")
def score_lookup(spark, d):
    wanted = study_views.patients(spark, d).select("PATIENT_ID").unionByName(study_views.vectors(spark, d)[0].select("PATIENT_ID")).distinct().select("PATIENT_ID", (200 + F.col("PATIENT_ID") % 25).alias("PROTOCOL_ID"))
    return rounded(fits(spark, d).join(wanted, BY_PP).select(*BY_PP, "PPF"), "PPF")


@query("d04_last_dates", f"WITH {sql.BASE} SELECT PATIENT_ID, max(SESSION_DATE) AS LAST_DATE FROM s25 GROUP BY 1")
def last_dates(spark, d):
    return s25(spark, d).groupBy("PATIENT_ID").agg(F.max("SESSION_DATE").alias("LAST_DATE"))


@query("e02_total_prescribed", f"WITH {sql.BASE} SELECT event_id, row_number() OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY event_id) AS TOTAL_PRESCRIBED FROM s25")
def total_prescribed(spark, d):
    return sessions.total_prescribed(s25(spark, d), ["event_id"]).select("event_id", F.col("TOTAL_PRESCRIBED").cast("bigint").alias("TOTAL_PRESCRIBED"))


@query("e14_composite", f"WITH {sql.BASE}, {sql.VECTORS} SELECT event_id, round(0.5 * PPF + 2.0 * coalesce(DM_VALUE, 0) + ADHERENCE, 6) AS SCORE FROM s25 JOIN fits USING (PATIENT_ID, PROTOCOL_ID)")
def composite(spark, d):
    rows = s25(spark, d).join(fits(spark, d).select(*BY_PP, "PPF"), BY_PP)
    score = cohort.composite(F.col("PPF"), F.coalesce("DM_VALUE", F.lit(0.0)), F.col("ADHERENCE"), (0.5, 2.0, 1.0))
    return rounded(rows.select("event_id", score.alias("SCORE")), "SCORE")


@query("e19_weekly_slices", f"WITH {sql.BASE}, {_BINS} SELECT PATIENT_ID, WEEK, count(*) AS N, round(avg(ADHERENCE), 6) AS MEAN FROM wb2 GROUP BY 1, 2")
def weekly_slices(spark, d):
    return rounded(cohort.week_bins(s25(spark, d)).groupBy("PATIENT_ID", "WEEK").agg(F.count("*").alias("N"), F.avg("ADHERENCE").alias("MEAN")), "MEAN")


@query("f04_lowest_prescription", f"WITH {sql.SCORES} SELECT PATIENT_ID, arg_min(PROTOCOL_ID, (SCORE, PROTOCOL_ID)) AS PROTOCOL_ID FROM sc WHERE len(DAYS) > 0 GROUP BY 1")
def lowest_prescription(spark, d):
    return recommend.top(recommend.prescriptions(scores(spark, d)), 1, ["PATIENT_ID"], "SCORE", "PROTOCOL_ID", ascending=True).select(*BY_PP)


@query("f06_unused_protocols", f"WITH {sql.SCORES} SELECT PATIENT_ID, PROTOCOL_ID FROM sc WHERE USAGE = 0")
def unused_protocols(spark, d):
    return scores(spark, d).where("USAGE = 0").select(*BY_PP)


@query("g02_difference", f"WITH {sql.BASE}, {sql.VECTORS} SELECT DISTINCT PATIENT_ID FROM fits WHERE PATIENT_ID NOT IN (SELECT PATIENT_ID FROM pat)")
def difference(spark, d):
    return fits(spark, d).select("PATIENT_ID").distinct().join(study_views.patients(spark, d), "PATIENT_ID", "left_anti")


@query("g05_long_contributions", f"WITH {sql.VECTORS} SELECT CAST(p.vec_id - 24 AS BIGINT) AS PATIENT_ID, CAST(q.vec_id + 200 AS BIGINT) AS PROTOCOL_ID, CAST(unnest(range(0, 64)) AS INT) AS PLACE, round(unnest(list_transform(range(1, 65), lambda i: p.u[i] * q.u[i])), 6) AS C FROM units p, units q WHERE p.vec_id >= 25 AND q.vec_id < 25")
def long_contributions(spark, d):
    rows = fits(spark, d).select(*BY_PP, F.posexplode("CONTRIB").alias("PLACE", "C"))
    return rounded(rows.na.drop(), "C")


#: As s25, but patients of study 1 perform nothing from 2024-01-20 on.
_IDLE = sql.SCORES.replace("s25_0 AS (SELECT PATIENT_ID,", "s25_1 AS (SELECT PATIENT_ID,").replace("s25 AS (SELECT *,", "s25_0 AS (SELECT PATIENT_ID, PROTOCOL_ID, CASE WHEN idle THEN NULL ELSE SESSION_ID END AS SESSION_ID, SESSION_DATE, WEEKDAY_INDEX, CASE WHEN idle THEN 'NOT_PERFORMED' ELSE STATUS END AS STATUS, CASE WHEN idle THEN 0 ELSE ADHERENCE END AS ADHERENCE, CASE WHEN idle THEN NULL ELSE DM_VALUE END AS DM_VALUE, event_id FROM (SELECT *, SESSION_DATE >= DATE '2024-01-20' AND PATIENT_ID IN (SELECT PATIENT_ID FROM (SELECT PATIENT_ID, arg_min(kind, event_id) AS s FROM ev GROUP BY 1) WHERE s = 1) AS idle FROM s25_1)),\ns25 AS (SELECT *,")


def idle_scores(spark, d):
    s = parts25(spark, d)
    idle = F.col("__idle") & (F.col("SESSION_DATE") >= F.lit("2024-01-20").cast("date"))
    rows = s.join(of_studies(spark, d, 1).withColumn("__idle", F.lit(True)), "PATIENT_ID", "left").withColumn("__idle", F.coalesce(idle, F.lit(False)))
    blank = {"SESSION_ID": None, "STATUS": NOT_PERFORMED, "ADHERENCE": 0.0, "DM_VALUE": None}
    rows = rows.withColumns({c: F.when(~F.col("__idle"), F.col(c)).otherwise(F.lit(v)) for c, v in blank.items()}).select(*s.columns)
    return study.score_table(fits(spark, d), rows, study_views.patients(spark, d), day())


@query("i10_repeats", f"WITH {_IDLE}, st AS (SELECT PATIENT_ID, coalesce(bool_and(USAGE_WEEK = 0) FILTER (len(DAYS) > 0), false) AS skipped FROM sc GROUP BY 1) SELECT PATIENT_ID, PROTOCOL_ID, array_to_string(DAYS, ',') AS DAYS FROM sc JOIN st USING (PATIENT_ID) WHERE skipped AND len(DAYS) > 0")
def repeats(spark, d):
    rows = recommend.recommended(idle_scores(spark, d), similarities(spark, d))
    return rows.where("BRANCH = 'repeat'").select(*BY_PP, text("DAYS"))


class Views:
    """The study's tables as a loader gives them."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d

    def sessions(self, patients=None):
        return tables.of_patients(parts25(self.spark, self.d), patients)

    def patients(self, patients=None):
        return tables.of_patients(study_views.patients(self.spark, self.d), patients)

    def fits(self, patients=None):
        return fits(self.spark, self.d)

    def similarity(self):
        return similarities(self.spark, self.d)


@query("i12_study_statuses", f"WITH {sql.BASE}, {sql.VECTORS} SELECT PATIENT_ID, CASE WHEN PATIENT_ID IN (SELECT PATIENT_ID FROM fits) THEN 'ok' ELSE 'failed' END AS STATUS FROM stud WHERE STUDY_ID IN (1, 2)")
def study_statuses(spark, d):
    return study.study_run(Views(spark, d), study_views.studies(spark, d), [1, 2], day())["statuses"].select("PATIENT_ID", "STATUS")


_RUN = sql.allowed_only(f"WITH RECURSIVE {sql.SCORES}, {sql.SIMILARITY},\n{sql.RECOMMENDED}", ALLOWED_PROTOCOLS)


@query("i12_study_run", f"{_RUN}, {sql.STAGED} SELECT 'run1' AS RUN_ID, * FROM staged")
def study_run(spark, d):
    """The staging rows of a run over all studies."""
    return study.study_run(Views(spark, d), study_views.studies(spark, d), [0, 1, 2, 3, 4], day(), "run1")["staging"]


class ClinicalViews(Views):
    """Patients with clinical documents, and a log of sessions; both have faults."""

    def sessions(self, patients=None):
        return tables.of_patients(faults.typed(study_views.logged_sessions(self.spark, self.d), {"SESSION_DATE": "date"}), patients)

    def patients(self, patients=None):
        return tables.of_patients(study_views.clinical_patients(self.spark, self.d), patients)


_FAULTS = f"""nat AS (SELECT CAST(c_custkey AS BIGINT) AS PATIENT_ID, c_nationkey AS n FROM customer),
own_reasons AS (SELECT PATIENT_ID, CASE WHEN n <= 2 THEN 'unreadable clinical scores' WHEN n <= 5 THEN 'no maximum for scale ARAT.Dance' WHEN n <= 8 THEN 'no start date' WHEN n BETWEEN 9 AND 11 THEN 'no number for scale ARAT_GRIP' WHEN n <= 13 AND PATIENT_ID IN (SELECT PATIENT_ID FROM ev WHERE k % 10 = 0) THEN 'bad SESSION_DATE' END AS REASON FROM pat JOIN nat USING (PATIENT_ID))"""


def _faulty_run_sql():
    own = f"{_fit_sql()[5:]}, {_FAULTS},\nfits AS (SELECT PATIENT_ID, PROTOCOL_ID, list_dot_product(a, b) AS PPF FROM p2, q2 WHERE PATIENT_ID IN (SELECT PATIENT_ID FROM own_reasons WHERE REASON IS NULL))"
    return sql.allowed_only(f"WITH RECURSIVE {sql.SCORES.replace(sql.VECTORS, own)}, {sql.SIMILARITY},\n{sql.RECOMMENDED}", ALLOWED_PROTOCOLS)


def faulty_run(spark, d):
    """A run over all patients, some of whom have faults of every kind."""
    loader = ClinicalViews(spark, d)
    deal = lambda rows: study_views.parted(rows, spark.read.parquet(f"{d}/events.parquet"))
    return study.patients_run(loader, study_views.patients(spark, d), day(), "run1", fits_of=lambda people: faults.checked_fits(deal(people), attributes(spark, d)), deal=deal)


@query("i12_faulty_statuses", f"{_faulty_run_sql()} SELECT PATIENT_ID, CASE WHEN REASON IS NULL THEN 'ok' ELSE 'failed' END AS STATUS, REASON, (SELECT count(*) FROM rec WHERE rec.PATIENT_ID = r.PATIENT_ID) AS RECOMMENDATIONS FROM own_reasons r")
def faulty_statuses(spark, d):
    return faulty_run(spark, d)["statuses"]


@query("i12_faulty_staging", f"{_faulty_run_sql()}, {sql.STAGED} SELECT 'run1' AS RUN_ID, * FROM staged")
def faulty_staging(spark, d):
    return faulty_run(spark, d)["staging"]


@query("i12_faulty_metrics", f"{_faulty_run_sql()}, {sql.measured(_METRICS)} SELECT PATIENT_ID, PROTOCOL_ID, KEY, round(VALUE, 6) AS VALUE, 'run1' AS RUN_ID FROM measured")
def faulty_metrics(spark, d):
    return rounded(faulty_run(spark, d)["metrics"], "VALUE")


@query("i12_faulty_summary", f"WITH {sql.BASE}, {_FAULTS} SELECT count(*) AS PATIENTS, count(*) FILTER (REASON IS NULL) AS SUCCEEDED, count(REASON) AS FAILED, CASE WHEN count(*) = count(REASON) THEN 'failure' WHEN count(REASON) = 0 THEN 'success' ELSE 'partial_success' END AS OVERALL FROM own_reasons")
def faulty_summary(spark, d):
    return faulty_run(spark, d)["summary"].drop("RECOMMENDATIONS")


@query("i17_early_scores", f"WITH {sql.BASE}, {sql.VECTORS}, l AS (SELECT PATIENT_ID, PROTOCOL_ID, arg_max(ADHERENCE, event_id) AS a, arg_max(DM_VALUE, event_id) FILTER (DM_VALUE IS NOT NULL) AS m FROM (SELECT *, row_number() OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY SESSION_DATE, event_id) AS seq FROM s25) GROUP BY 1, 2) SELECT PATIENT_ID, PROTOCOL_ID, round(PPF + coalesce(m, 0) + coalesce(a, 1), 6) AS SCORE FROM fits LEFT JOIN l USING (PATIENT_ID, PROTOCOL_ID)".replace("arg_max(ADHERENCE, event_id)", "arg_max(ADHERENCE, seq)").replace("arg_max(DM_VALUE, event_id)", "arg_max(DM_VALUE, seq)"))
def early_scores(spark, d):
    return rounded(cohort.early_scores(fits(spark, d), s25(spark, d)).select(*BY_PP, "SCORE"), "SCORE")


@query("i19_session_metrics", f"WITH {sql.BASE}, q AS (SELECT *, row_number() OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY SESSION_DATE, SESSION_ID) AS i FROM s5 WHERE DM_VALUE IS NOT NULL), w AS (SELECT t.PATIENT_ID, t.PROTOCOL_ID, t.SESSION_ID, t.i, any_value(t.DM_VALUE) AS x, sum(pow(0.5, t.i - u.i) * u.DM_VALUE) / sum(pow(0.5, t.i - u.i)) AS m FROM q t JOIN q u ON t.PATIENT_ID = u.PATIENT_ID AND t.PROTOCOL_ID = u.PROTOCOL_ID AND u.i <= t.i GROUP BY 1, 2, 3, 4) SELECT SESSION_ID, round(m, 6) AS DM_EWMA, round(coalesce(x - lag(x) OVER p, 0), 6) AS DM_DELTA, round(coalesce(m - lag(m) OVER p, 0), 6) AS EWMA_DELTA FROM w WINDOW p AS (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY i)")
def session_metrics(spark, d):
    return rounded(cohort.session_metrics(s5(spark, d)).select("SESSION_ID", "DM_EWMA", "DM_DELTA", "EWMA_DELTA"), "DM_EWMA", "DM_DELTA", "EWMA_DELTA")


# --- tables that are written and read again, and later additions --------------------------------------


@query("a15_versions", f"""WITH {sql.BASE}, {sql.VECTORS}, new AS (SELECT PATIENT_ID, PROTOCOL_ID, PPF + 1 AS PPF FROM fits WHERE PATIENT_ID IN (SELECT PATIENT_ID FROM stud WHERE STUDY_ID IN (0, 1)))
SELECT 1 AS VERSION, PATIENT_ID, PROTOCOL_ID, round(PPF, 6) AS PPF FROM fits UNION ALL SELECT 2, PATIENT_ID, PROTOCOL_ID, round(PPF, 6) FROM new UNION ALL SELECT 2, PATIENT_ID, PROTOCOL_ID, round(PPF, 6) FROM fits WHERE (PATIENT_ID, PROTOCOL_ID) NOT IN (SELECT PATIENT_ID, PROTOCOL_ID FROM new)""")
def versions(spark, d):
    """A table read before and after an upsert; the first reader keeps its version."""
    table, f = sinks.Versions(spark, scratch_folder(spark, "versions")), fits(spark, d).drop("CONTRIB")
    table.upsert(f)
    before = table.read()
    table.upsert(f.join(of_studies(spark, d, 0, 1), "PATIENT_ID", "left_semi").withColumn("PPF", F.col("PPF") + 1))
    return rounded(before.withColumn("VERSION", F.lit(1)).unionByName(table.read().withColumn("VERSION", F.lit(2))), "PPF")


@query("a17_repeated_runs", f"WITH {sql.BASE}, {sql.weeks('s25')}, j AS (SELECT PATIENT_ID, PROTOCOL_ID, st + 7 * WEEKS_SINCE_START AS STARTING_DATE, unnest(CASE WHEN DAYS IS NULL THEN [NULL] ELSE DAYS END) AS WEEKDAY FROM us LEFT JOIN wu USING (PATIENT_ID, PROTOCOL_ID) JOIN wk USING (PATIENT_ID)) SELECT RUN_ID, PATIENT_ID, PROTOCOL_ID, STARTING_DATE, STARTING_DATE + 7 AS ENDING_DATE, WEEKDAY FROM j, (SELECT unnest(['run1', 'run2']) AS RUN_ID)")
def repeated_runs(spark, d):
    """Two runs written to one table, the first of them twice."""
    path, rows = scratch_folder(spark, "staging"), staging(spark, d)
    for run in ("run1", "run2", "run1"):
        sinks.replace_run(rows, path, run)
    return sinks.read_run(spark, path, rows.schema, "run1").unionByName(sinks.read_run(spark, path, rows.schema, "run2"))


@query("c07_audit_exports", f"WITH {sql.BASE} SELECT 'joined' AS OUTPUT, a.event_id AS L, b.event_id AS R FROM s25 a JOIN s5 b USING (PATIENT_ID, SESSION_ID) UNION ALL SELECT 'left_only', event_id, NULL FROM s25 WHERE SESSION_ID IS NULL UNION ALL SELECT 'right_only', NULL, event_id FROM s5 WHERE SESSION_ID IS NULL")
def audit_exports(spark, d):
    """Sessions and their series, joined once; matched rows and those of one side alone are read from its partitions."""
    keys = ["PATIENT_ID", "SESSION_ID"]
    left, right = (rows.select(*keys, F.col("event_id").alias(name)) for rows, name in ((s25(spark, d), "L"), (s5(spark, d), "R")))
    outputs = zip(("joined", "left_only", "right_only"), quality.export_audit(left, right, keys, scratch_folder(spark, "audit")), strict=True)
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("OUTPUT"), "L", "R") for name, rows in outputs])


def _two_predictors():
    terms = "count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(y) AS yy"
    rows = "SELECT '(intercept)' AS TERM, my - p * ma - q * mb AS C, sqrt(s2 * (1 / CAST(n AS DOUBLE) + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / (n * det))) AS E, r2 FROM g UNION ALL SELECT 'ADHERENCE', p, sqrt(s2 * bb / (n * det)), r2 FROM g UNION ALL SELECT 'W', q, sqrt(s2 * aa / (n * det)), r2 FROM g"
    return f"""WITH {sql.BASE}, x AS (SELECT DM_VALUE AS y, ADHERENCE AS a, CAST(WEEKDAY_INDEX AS DOUBLE) AS b FROM s25 WHERE DM_VALUE IS NOT NULL), c AS (SELECT {terms} FROM x), e AS (SELECT *, aa * bb - ab * ab AS det FROM c), f AS (SELECT *, (ya * bb - yb * ab) / det AS p, (yb * aa - ya * ab) / det AS q FROM e),
g AS (SELECT *, (p * ya + q * yb) / yy AS r2, n * (yy - p * ya - q * yb) / (n - 3) AS s2 FROM f), o AS ({rows}) SELECT TERM, round(C, 6) AS COEFFICIENT, round(E, 6) AS STD_ERROR, round(C / E, 6) AS T, round(r2, 6) AS R2 FROM o"""


@query("d22_two_predictors", _two_predictors())
def two_predictors(spark, d):
    rows = s25(spark, d).withColumn("W", F.col("WEEKDAY_INDEX").cast("double"))
    out = cohort.linear_model(rows, "DM_VALUE", ["ADHERENCE", "W"])
    return rounded(out.select("TERM", "COEFFICIENT", "STD_ERROR", "T", "R2"), "COEFFICIENT", "STD_ERROR", "T", "R2")


_ALPHAS = (0.1, 0.25, 0.5)


@query("e13_alpha_windows", f"""WITH {sql.BASE}, x AS (SELECT PATIENT_ID, DM_VALUE AS y, row_number() OVER (PARTITION BY PATIENT_ID ORDER BY SESSION_DATE, SESSION_ID) - 1 AS i, count(*) OVER (PARTITION BY PATIENT_ID) AS n FROM s25 WHERE DM_VALUE IS NOT NULL),
a AS (SELECT unnest({list(_ALPHAS)}) AS ALPHA, unnest([21, 9, 5]) AS w), t AS (SELECT *, w // 2 AS h, greatest(0, least(i - w // 2, n - w)) AS st FROM x, a),
c AS (SELECT t.PATIENT_ID, ALPHA, w, t.i, t.n, t.y, u.y AS uy, CAST(u.i - st - h AS DOUBLE) AS v, CAST(t.i - st - h AS DOUBLE) AS p, (w * w - 1) / CAST(12 AS DOUBLE) AS mean FROM t JOIN x u ON u.PATIENT_ID = t.PATIENT_ID AND u.i >= st AND u.i < st + w)
SELECT PATIENT_ID, CAST(ALPHA AS DOUBLE) AS ALPHA, CAST(w AS INT) AS WIDTH, i AS PLACE, round(CASE WHEN n < w THEN y ELSE s END, 6) AS SLOPE FROM (SELECT PATIENT_ID, ALPHA, w, i, any_value(n) AS n, any_value(y) AS y, sum(uy * (v / (w * mean) + 2 * p * (v * v - mean) / (w * mean * (w * w - 4) / 15))) AS s FROM c GROUP BY ALL)""")
def alpha_windows(spark, d):
    """Slopes of each patient's difficulty values, once for each alpha; windows of 21, 9 and 5."""
    rows = s25(spark, d).where("DM_VALUE is not null").select("PATIENT_ID", "SESSION_DATE", "SESSION_ID", "DM_VALUE", F.explode(F.array(*[F.lit(a) for a in _ALPHAS])).alias("ALPHA"))
    rows = series.session_index(rows.withColumn("WIDTH", series.alpha_window(F.col("ALPHA"))), ["PATIENT_ID", "ALPHA"], ["SESSION_DATE", "SESSION_ID"], "PLACE")
    out = series.polynomial_filter(rows, "DM_VALUE", ["PATIENT_ID", "ALPHA"], ["PLACE"], "SLOPE", F.col("WIDTH"), derivative=1, short="value")
    return rounded(out.select("PATIENT_ID", "ALPHA", "WIDTH", (F.col("PLACE") - 1).cast("bigint").alias("PLACE"), "SLOPE"), "SLOPE")


@query("f07_ordered_output", f"WITH {sql.BASE} SELECT count(*) AS N, CAST(0 AS BIGINT) AS OUT_OF_ORDER FROM s25")
def ordered_output(spark, d):
    """Rows of an ordered output, and how many come before a smaller key in their file or in a file before."""
    path = scratch_folder(spark, "ordered")
    sinks.write_ordered(s25(spark, d), path, ["PATIENT_ID", "PROTOCOL_ID", "event_id"], files=7)
    rows = spark.read.parquet(path).withColumns({"f": F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), "at": F.monotonically_increasing_id(), "key": F.struct("PATIENT_ID", "PROTOCOL_ID", "event_id")})
    inside = rows.withColumn("bad", F.coalesce(F.col("key") < F.lag("key").over(Window.partitionBy("f").orderBy("at")), F.lit(False)))
    each = inside.groupBy("f").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.min("key").alias("low"), F.max("key").alias("high"))
    files = each.withColumn("early", F.coalesce(F.col("low") < F.lag("high").over(Window.orderBy("f")), F.lit(False)))  # a row for each file
    return files.agg(F.sum("n").alias("N"), (F.sum("bad") + F.count_if("early")).alias("OUT_OF_ORDER"))


@query("i13_slot_schedule", f"""WITH {sql.VECTORS}, t AS (SELECT *, row_number() OVER (PARTITION BY PATIENT_ID ORDER BY PPF DESC, PROTOCOL_ID) - 1 AS r FROM fits), s AS (SELECT PATIENT_ID, PROTOCOL_ID, unnest(range(r, 35, 12)) AS slot FROM t WHERE r < 12),
o AS (SELECT *, (row_number() OVER (PARTITION BY PATIENT_ID ORDER BY {sql.mixed("PATIENT_ID", "slot", 5)}, slot) - 1) % 7 AS dd FROM s) SELECT PATIENT_ID, PROTOCOL_ID, array_to_string(list_sort(list(DISTINCT CAST(dd AS INT))), ',') AS DAYS FROM o GROUP BY 1, 2""")
def slot_schedule(spark, d):
    return recommend.slot_schedule(fits(spark, d).withColumnRenamed("PPF", "SCORE"), 5).select(*BY_PP, text("DAYS"))


_MOCA = [s for s in SCALE_MAXIMA if s.startswith("MOCA_") and s != "MOCA_TOTAL"]


@query("i15_profile_update", f"""WITH {sql.BASE}, p AS (SELECT CAST(c_custkey AS BIGINT) AS PATIENT_ID, [{", ".join(f"CAST((c_custkey + {k}) % {SCALE_MAXIMA[s] + 1} AS DOUBLE)" for k, s in enumerate(_MOCA))}] AS s0, CAST({[SCALE_MAXIMA[s] for s in _MOCA]} AS DOUBLE[]) AS mx FROM customer),
q AS (SELECT CAST(vec_id + 200 AS BIGINT) AS PROTOCOL_ID, list_transform(embedding[1:7], lambda x: abs(CAST(x AS DOUBLE))) AS r FROM embeddings WHERE vec_id < 25), a AS (SELECT PATIENT_ID, PROTOCOL_ID, least(datediff('day', CLINICAL_TRIAL_START_DATE, SESSION_DATE) // 10, 2) AS t, avg(ADHERENCE) AS rate FROM s25 JOIN pat USING (PATIENT_ID) GROUP BY ALL),
e AS (SELECT PATIENT_ID, sum(rate * list_sum(list_transform(r, lambda x: x / list_sum(r)))) FILTER (t = 0) AS e0, sum(rate) FILTER (t = 1) AS e1, sum(rate) FILTER (t = 2) AS e2 FROM a JOIN q USING (PROTOCOL_ID) GROUP BY 1),
r AS (SELECT p.*, CASE WHEN e0 <> 0 THEN e1 / e0 END AS r1, CASE WHEN e1 <> 0 THEN e2 / e1 END AS r2 FROM p LEFT JOIN e USING (PATIENT_ID)), s1 AS (SELECT *, list_transform(range(1, 8), lambda i: CASE WHEN r1 IS NULL THEN s0[i] ELSE least(s0[i] * r1, mx[i]) END) AS s1 FROM r), s2 AS (SELECT *, list_transform(range(1, 8), lambda i: CASE WHEN r2 IS NULL THEN s1[i] ELSE least(s1[i] * r2, mx[i]) END) AS s2 FROM s1),
u AS (SELECT PATIENT_ID, 0 AS t, CAST(NULL AS DOUBLE) AS r, s0 AS s, mx FROM s2 UNION ALL SELECT PATIENT_ID, 1, r1, s1, mx FROM s2 UNION ALL SELECT PATIENT_ID, 2, r2, s2, mx FROM s2), d AS (SELECT *, list_transform(range(1, 8), lambda i: greatest(mx[i] - s[i], 0)) AS d FROM u)
SELECT PATIENT_ID, CAST(t AS INT) AS "TIME", round(r, 6) AS RATIO, CAST(unnest(range(7)) AS INT) AS PLACE, round(unnest(s), 6) AS SCORE, round(unnest(list_transform(d, lambda x: CASE WHEN list_sum(d) = 0 THEN 0 ELSE x / list_sum(d) END)), 6) AS SHARE FROM d""")
def profile_update(spark, d):
    """MoCA profiles of all customers, moved on twice by the success with the diagnostic protocols in the ten days before."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    maxima = [SCALE_MAXIMA[s] for s in _MOCA]
    assessed = c.select(F.col("c_custkey").cast("bigint").alias("PATIENT_ID"), F.array(*[((F.col("c_custkey") + k) % (m + 1)).cast("double") for k, m in enumerate(maxima)]).alias("SCORES"))
    ratings = study_views.vectors(spark, d)[1].select("PROTOCOL_ID", F.transform(F.slice("VECTOR", 1, 7), F.abs).alias("RATINGS"))
    s = s25(spark, d).join(study_views.patients(spark, d), "PATIENT_ID")
    when = F.least(F.floor(F.datediff("SESSION_DATE", "CLINICAL_TRIAL_START_DATE") / 10), F.lit(2)).cast("int")
    rates = s.groupBy(*BY_PP, when.alias("TIME")).agg(F.avg("ADHERENCE").alias("RATE"))
    out = profile.updated_profiles(assessed, rates, ratings, maxima, [0, 1, 2])
    long = out.select("PATIENT_ID", "TIME", "RATIO", F.posexplode(F.arrays_zip("SCORES", "EMBEDDING")).alias("PLACE", "x"))
    return rounded(long.select("PATIENT_ID", "TIME", "RATIO", "PLACE", F.col("x.SCORES").alias("SCORE"), F.col("x.EMBEDDING").alias("SHARE")), "RATIO", "SCORE", "SHARE")


def _odd_sessions(spark, d):
    rows = s25(spark, d).withColumn("ADHERENCE", F.col("ADHERENCE") * 1.2).withColumn("STATUS", F.when(F.col("WEEKDAY_INDEX") == 6, "LOST").otherwise(F.col("STATUS")))
    return rows.withColumn("PRESCRIPTION_ID", F.when(F.col("WEEKDAY_INDEX") != 5, F.col("PRESCRIPTION_ID")))


_BROKEN = f"WITH {sql.BASE}, b AS (SELECT event_id, list_filter([CASE WHEN NOT (ADHERENCE * 1.2 BETWEEN 0 AND 1) THEN 'adherence_share' END, CASE WHEN NOT (DM_VALUE BETWEEN 0 AND 1) THEN 'dm_share' END, CASE WHEN WEEKDAY_INDEX = 5 THEN 'prescription_present' END, CASE WHEN WEEKDAY_INDEX = 6 THEN 'status' END], lambda x: x IS NOT NULL) AS r FROM s25)"


@query("m01_broken_rows", f"{_BROKEN} SELECT event_id, array_to_string(r, ',') AS BROKEN FROM b WHERE len(r) > 0")
def broken_rows(spark, d):
    rules = quality.UNITS["sessions"]
    _, bad, _ = quality.quarantine(_odd_sessions(spark, d), rules, scratch_folder(spark, "checked"))
    return bad.select("event_id", text("BROKEN"))


@query("m01_quarantine_counts", f"{_BROKEN} SELECT RULE, (SELECT count(*) FROM b WHERE list_contains(r, RULE)) AS N, (SELECT count(*) FROM b WHERE len(r) = 0) AS GOOD FROM (SELECT unnest({sorted(quality.UNITS['sessions'])}) AS RULE)")
def quarantine_counts(spark, d):
    good, _, counts = quality.quarantine(_odd_sessions(spark, d), quality.UNITS["sessions"], scratch_folder(spark, "checked"))
    return counts.join(good.agg(F.count("*").alias("GOOD")))


@query("m01_unit_rules", f"""WITH {sql.SCORES}, {sql.SIMILARITY}, ts AS (SELECT PATIENT_ID, SESSION_ID, PROTOCOL_ID - 200 AS PROTOCOL_ID, k - 10 AS SECONDS_FROM_START FROM s5),
n AS (SELECT 'timeseries' AS UNIT, 'patient_positive' AS RULE, count(*) FILTER (PATIENT_ID <= 0) AS N FROM ts UNION ALL SELECT 'timeseries', 'session_positive', count(*) FILTER (SESSION_ID <= 0) FROM ts UNION ALL SELECT 'timeseries', 'protocol_positive', count(*) FILTER (PROTOCOL_ID <= 0) FROM ts UNION ALL SELECT 'timeseries', 'seconds_not_negative', count(*) FILTER (SECONDS_FROM_START < 0) FROM ts
UNION ALL SELECT 'ppf', unnest(['patient_present', 'protocol_present', 'ppf_present', 'contributions_present', 'contributions_add_up']), 0 UNION ALL SELECT 'protocol_similarity', unnest(['a_present', 'b_present', 'similarity_present']), 0 UNION ALL SELECT 'protocol_similarity', 'similarity_share', count(*) FILTER (NOT (SIMILARITY * 1.5 BETWEEN 0 AND 1)) FROM sim
UNION ALL SELECT 'scores', unnest(['patient_positive', 'protocol_positive', 'usage_not_negative', 'days_in_week']), 0 UNION ALL SELECT 'scores', 'adherence_share', count(*) FILTER (NOT (ADHERENCE_RECENT BETWEEN 0 AND 1)) FROM sc UNION ALL SELECT 'scores', 'ppf_share', count(*) FILTER (NOT (PPF BETWEEN 0 AND 1)) FROM sc UNION ALL SELECT 'scores', 'score_not_negative', count(*) FILTER (SCORE < 0) FROM sc) SELECT UNIT, RULE, N FROM n""".replace("CASE WHEN k % 10 = 0 THEN NULL ELSE value / CAST(600 AS DOUBLE) END AS DM_VALUE, event_id FROM ev", "CASE WHEN k % 10 = 0 THEN NULL ELSE value / CAST(600 AS DOUBLE) END AS DM_VALUE, event_id, k FROM ev"))
def unit_rules(spark, d):
    """The rules of the other tables: series whose times and protocols are moved, similarities that are stretched, fits and scores as they are."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("e"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    ts = s5(spark, d).join(e, F.col("event_id") == F.col("e")).select("PATIENT_ID", "SESSION_ID", (F.col("PROTOCOL_ID") - 200).alias("PROTOCOL_ID"), (F.col("k") - 10).alias("SECONDS_FROM_START"))
    units = {"timeseries": ts, "ppf": fits(spark, d), "protocol_similarity": similarities(spark, d).withColumn("SIMILARITY", F.col("SIMILARITY") * 1.5), "scores": scores(spark, d)}
    return reduce(DataFrame.unionByName, [quality.rule_counts(quality.checked(df, quality.UNITS[u]), quality.UNITS[u]).withColumn("UNIT", F.lit(u)) for u, df in units.items()])


# --- scans of stored tables ---------------------------------------------------------------------------


def stored_tables(spark, d, kind, *names):
    """A loader over a folder that holds the study's tables of these names, as Parquet or CSV."""
    path = scratch_folder(spark, "study")
    make = {
        "sessions": lambda: s25(spark, d).select(*[F.col(f.name).cast(f.dataType) if f.name in study_columns else F.lit(None).cast(f.dataType).alias(f.name) for f in tables.SESSIONS.fields]),
        "timeseries": lambda: s5(spark, d).select("PATIENT_ID", "SESSION_ID", "PROTOCOL_ID", F.lit("app").alias("GAME_MODE"), (F.col("WEEKDAY_INDEX") * 10).alias("SECONDS_FROM_START"), F.lit("speed").alias("DM_KEY"), "DM_VALUE", F.lit("hits").alias("PE_KEY"), F.col("ADHERENCE").alias("PE_VALUE")),
        "patient": lambda: study_views.patients(spark, d).join(study_views.clinical_json(spark, d), "PATIENT_ID", "left"),
        "ppf": lambda: fits(spark, d),
        "protocol_similarity": lambda: similarities(spark, d),
        "protocol_attributes": lambda: attributes(spark, d),
    }
    study_columns = set(s25(spark, d).columns)
    for name in names:
        df = make[name]()
        (sinks.flat(df) if kind == "csv" else df).write.format(kind).option("header", "true").save(f"{path}/{name}.{kind}")
    return tables.FileLoader(spark, path, kind)


_OF_STUDY_2 = "PATIENT_ID IN (SELECT PATIENT_ID FROM stud WHERE STUDY_ID = 2)"


@query("a02_timeseries_scan", f"WITH {sql.BASE} SELECT PATIENT_ID, SESSION_ID, PROTOCOL_ID, CAST(WEEKDAY_INDEX * 10 AS INT) AS SECONDS_FROM_START, round(DM_VALUE, 6) AS DM_VALUE, round(ADHERENCE, 6) AS PE_VALUE FROM s5 WHERE {_OF_STUDY_2}")
def timeseries_scan(spark, d):
    rows = stored_tables(spark, d, "parquet", "timeseries").timeseries(of_studies(spark, d, 2))
    return rounded(rows.select("PATIENT_ID", "SESSION_ID", "PROTOCOL_ID", "SECONDS_FROM_START", "DM_VALUE", "PE_VALUE"), "DM_VALUE", "PE_VALUE")


@query("a03_patient_scan", f"WITH {sql.BASE} SELECT PATIENT_ID, CLINICAL_TRIAL_START_DATE, CLINICAL_TRIAL_END_DATE, CAST(c_custkey IS NOT NULL AS INT) AS DOCUMENTS FROM pat LEFT JOIN customer ON c_custkey = PATIENT_ID WHERE {_OF_STUDY_2}")
def patient_scan(spark, d):
    rows = stored_tables(spark, d, "parquet", "patient").patients(of_studies(spark, d, 2))
    return rows.select("PATIENT_ID", "CLINICAL_TRIAL_START_DATE", "CLINICAL_TRIAL_END_DATE", F.col("CLINICAL_SCORES").isNotNull().cast("int").alias("DOCUMENTS"))


@query("a06_csv_sessions", f"WITH {sql.BASE} SELECT PATIENT_ID, PROTOCOL_ID, PRESCRIPTION_ID, SESSION_ID, SESSION_DATE, WEEKDAY_INDEX, STATUS, round(ADHERENCE, 6) AS ADHERENCE, round(DM_VALUE, 6) AS DM_VALUE FROM s25 WHERE {_OF_STUDY_2}")
def csv_sessions(spark, d):
    rows = stored_tables(spark, d, "csv", "sessions").sessions(of_studies(spark, d, 2))
    return rounded(rows.select(*BY_PP, "PRESCRIPTION_ID", "SESSION_ID", "SESSION_DATE", "WEEKDAY_INDEX", "STATUS", "ADHERENCE", "DM_VALUE"), "ADHERENCE", "DM_VALUE")


@query("a07_csv_fits", f"WITH {sql.BASE}, {sql.VECTORS} SELECT PATIENT_ID, PROTOCOL_ID, round(PPF, 6) AS PPF, 64 AS PARTS FROM fits WHERE PATIENT_ID IN (SELECT PATIENT_ID FROM pat)")
def csv_fits(spark, d):
    rows = stored_tables(spark, d, "csv", "ppf").fits(study_views.patients(spark, d))
    return rounded(rows.select(*BY_PP, "PPF", F.size("CONTRIB").alias("PARTS")), "PPF")


@query("a08_csv_similarity", f"WITH {sql.SIMILARITY} SELECT PROTOCOL_A, PROTOCOL_B, round(SIMILARITY, 6) AS SIMILARITY FROM sim")
def csv_similarity(spark, d):
    return rounded(stored_tables(spark, d, "csv", "protocol_similarity").similarity(), "SIMILARITY")


@query("a10_stored_similarity", f"WITH {sql.SIMILARITY} SELECT PROTOCOL_A, PROTOCOL_B, round(SIMILARITY, 6) AS SIMILARITY FROM sim")
def stored_similarity(spark, d):
    return rounded(stored_tables(spark, d, "parquet", "protocol_similarity").similarity(), "SIMILARITY")


@query("a11_attribute_scan", "WITH v AS (SELECT CAST(vec_id + 200 AS BIGINT) AS PROTOCOL_ID, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id < 25) " + " UNION ALL ".join(f"SELECT PROTOCOL_ID, '{a}' AS FEATURE, round(abs(v[{i + 1}]), 6) AS VALUE FROM v WHERE abs(v[{i + 21}]) > 0.02" for i, a in enumerate(_ATTRIBUTES)))
def attribute_scan(spark, d):
    """Attributes of the folder, as no path is given; there is a default that isn't read."""
    wide = stored_tables(spark, d, "csv", "protocol_attributes").attributes(default=f"{d}/no_such_table.parquet")
    names = [c for c in wide.columns if c != "PROTOCOL_ID"]
    long = wide.select(F.col("PROTOCOL_ID").cast("bigint").alias("PROTOCOL_ID"), *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["PROTOCOL_ID"], names, "FEATURE", "VALUE").na.drop()
    return rounded(long, "VALUE")


@query("a12_wide_subscales", "SELECT CAST(c_custkey AS BIGINT) AS PATIENT_ID, 'FM_A' AS SCALE, CAST(c_custkey % 37 AS DOUBLE) AS SCORE FROM customer UNION ALL SELECT CAST(c_custkey AS BIGINT), 'MoCA.Naming', CAST(c_nationkey % 4 AS DOUBLE) FROM customer WHERE c_nationkey % 5 <> 0")
def wide_subscales(spark, d):
    path = scratch_folder(spark, "subscales")
    c = spark.read.parquet(f"{d}/customer.parquet")
    rows = c.select((F.col("c_nationkey") % 3).alias("STUDY_ID"), F.col("c_custkey").cast("bigint").alias("PATIENT_ID"), (F.col("c_custkey") % 37).alias("FM_A"), F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey") % 4).alias("MoCA.Naming"))
    sinks.write_csv(rows, f"{path}/subscales.csv")
    return tables.FileLoader(spark, path, "csv").wide_subscales().withColumn("PATIENT_ID", F.col("PATIENT_ID").cast("bigint"))


@query("a16_similarity_csv", f"WITH {sql.SIMILARITY} SELECT CAST(count(*) AS BIGINT) AS N, 'PROTOCOL_A,PROTOCOL_B,SIMILARITY' AS HEADER, round(sum(SIMILARITY), 6) AS TOTAL FROM sim")
def similarity_csv(spark, d):
    """The similarity table as CSV: its rows, header and sum, read as text and as numbers."""
    path = scratch_folder(spark, "similarity")
    sinks.write_csv(similarities(spark, d), path)
    head = spark.read.text(path).where("value like 'PROTOCOL_A%'").agg(F.max("value").alias("HEADER"))
    rows = spark.read.schema(tables.SIMILARITY).csv(path, header=True)
    return rounded(rows.agg(F.count("*").alias("N"), F.sum("SIMILARITY").alias("TOTAL")).join(head), "TOTAL")


@query("b13_casts", f"WITH {sql.BASE} SELECT event_id, SESSION_DATE, round(ADHERENCE, 6) AS ADHERENCE, WEEKDAY_INDEX FROM s25")
def casts(spark, d):
    """Columns read as text and cast with errors."""
    text_ = s25(spark, d).select(*[F.col(c).cast("string").alias(c) for c in ("event_id", "SESSION_DATE", "ADHERENCE", "WEEKDAY_INDEX")])
    return rounded(text_.select(*tables.parsed({"event_id": "bigint", "SESSION_DATE": "date", "ADHERENCE": "double", "WEEKDAY_INDEX": "int"})), "ADHERENCE")


@query("l01_own_parts", f"WITH {sql.SCORES} SELECT PATIENT_ID, PROTOCOL_ID, round(coalesce(PPF, 0) * 2 + CASE WHEN USAGE > 0 THEN 1 ELSE 0 END, 6) AS SCORE FROM sc")
def own_parts(spark, d):
    """A score table with a scorer of one's own."""
    own = lambda table, weights: table.withColumn("SCORE", F.coalesce("PPF", F.lit(0.0)) * 2 + F.when(F.col("USAGE") > 0, 1).otherwise(0))
    rows = study.score_table(fits(spark, d), parts25(spark, d), study_views.patients(spark, d), day(), score=own)
    return rounded(rows.select(*BY_PP, "SCORE"), "SCORE")


@query("l02_weights", f"WITH {sql.SCORES} SELECT PATIENT_ID, PROTOCOL_ID, round(0.5 * coalesce(ADHERENCE_RECENT, 0) + 2 * coalesce(DELTA_DM, 0) + 0.25 * coalesce(PPF, 0), 6) AS SCORE FROM sc")
def other_weights(spark, d):
    rows = study.score_table(fits(spark, d), parts25(spark, d), study_views.patients(spark, d), day(), weights=(0.5, 2.0, 0.25))
    return rounded(rows.select(*BY_PP, "SCORE"), "SCORE")
