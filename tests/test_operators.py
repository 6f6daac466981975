import datetime as dt
import itertools
import json
import math
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from restora import constants
from restora.functions import clinical, dates, series, vectors
from restora.operators import cohort, fit, quality, recommend, scoring, sessions
from restora.plans import study
from restora.sources import sinks, tables
from restora.streaming.usage import weekly_usage

D = dt.date
COLUMNS = "PATIENT_ID bigint, PRESCRIPTION_ID bigint, SESSION_ID bigint, PROTOCOL_ID bigint, PRESCRIPTION_STARTING_DATE date, PRESCRIPTION_ENDING_DATE date, SESSION_DATE date, WEEKDAY_INDEX int, STATUS string, ADHERENCE double, DM_VALUE double"
#: The trial of every patient of the made-up study begins on a Wednesday.
START, END = D(2031, 10, 1), D(2031, 11, 5)


def day(s):
    return F.lit(str(s)).cast("date")


def made_up_sessions(seed=3, patients=(41, 57, 86), protocols=(203, 219, 226)):
    """Random sessions: some not performed, some protocols twice a day, one patient without any in the last weeks."""
    draw, rows = np.random.default_rng(seed), []
    for p, q in itertools.product(patients, protocols):
        for weekday in sorted(draw.choice(7, size=2, replace=False).tolist()):
            first = START + dt.timedelta(days=int(draw.integers(0, 5)))
            for n in range(35):
                d = START + dt.timedelta(days=n)
                if d.weekday() != weekday or d < first or draw.random() < 0.3 or (p == 86 and n > 10):
                    continue
                for _ in range(1 + (draw.random() < 0.2)):
                    played = draw.random() < 0.75
                    rows.append((p, 10 * p + weekday, int(draw.integers(10**6, 10**7)) if played else None, q, first, END, d, weekday, "CLOSED" if played else "NOT_PERFORMED", round(float(draw.random()), 3) if played else 0.0, round(float(draw.random()), 3) if played else None))
    return rows


@pytest.fixture
def session_rows(spark):
    return spark.createDataFrame(made_up_sessions(), COLUMNS)


@pytest.fixture
def patient_rows(spark):
    rows = [(p, START, END) for p in (41, 57, 86)]
    return spark.createDataFrame([*rows, rows[1]], "PATIENT_ID bigint, CLINICAL_TRIAL_START_DATE date, CLINICAL_TRIAL_END_DATE date")


def test_usage_and_weeks(session_rows, patient_rows):
    rows, low = made_up_sessions(), START + dt.timedelta(days=14)
    pairs = {(r[0], r[3]) for r in rows}
    used = {k: len({r[2] for r in rows if (r[0], r[3]) == k} - {None}) for k in pairs}
    assert {(r.PATIENT_ID, r.PROTOCOL_ID): r.USAGE for r in sessions.usage(session_rows).collect()} == used
    inside = [r for r in rows if low <= r[6] < low + dt.timedelta(days=7)]
    want = {(r[0], r[3]): (len({x[2] for x in inside if (x[0], x[3]) == (r[0], r[3])} - {None}), sorted({x[7] for x in inside if (x[0], x[3]) == (r[0], r[3])})) for r in inside}
    now = day(low + dt.timedelta(days=9))
    assert {(r.PATIENT_ID, r.PROTOCOL_ID): (r.USAGE_WEEK, r.DAYS) for r in sessions.week_usage(session_rows, patient_rows, now).collect()} == want
    assert {r.WEEKS_SINCE_START for r in sessions.with_weeks(patient_rows, now).collect()} == {3}
    assert sessions.week_usage(session_rows, patient_rows, day(START + dt.timedelta(days=6))).isEmpty()
    assert {r.WEEKS_SINCE_START for r in sessions.with_weeks(patient_rows, day(START - dt.timedelta(days=8))).collect()} == {-2}


def smoothed_by_hand(values, window=7, derivative=0):
    """Least-squares parabolas by numpy: the fit of the nearest whole window at each place."""
    n = len(values)
    if n < 3:
        return list(values)
    w = min(window, n)
    w -= 1 - w % 2
    out = []
    for i in range(n):
        start = max(0, min(i - w // 2, n - w))
        c = np.polyfit(np.arange(w), values[start : start + w], 2)
        out.append(float(np.polyval(np.polyder(c) if derivative else c, i - start)))
    return out


def slope_by_hand(values, window=7):
    own = list(enumerate(values))[-window:]
    slopes = [(y - x) / (j - i) for (i, x), (j, y) in itertools.combinations(own, 2)]
    return statistics.median(slopes) if slopes else 0.0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 12])
def test_smoothing_and_slope(spark, n):
    values = [round(float(v), 3) for v in np.random.default_rng(n).normal(size=n)]
    df = spark.createDataFrame([(9, 77, 500 + i, D(2030, 3, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)], "PATIENT_ID bigint, PROTOCOL_ID bigint, SESSION_ID bigint, SESSION_DATE date, DM_VALUE double")
    rows = sessions.progress(df).orderBy("DM_INDEX").collect()
    smooth = smoothed_by_hand(values)
    assert [r.DM_SMOOTH for r in rows] == pytest.approx(smooth)
    assert [r.DELTA_DM for r in rows] == pytest.approx([slope_by_hand(smooth[: k + 1]) for k in range(n)])
    arrays = spark.createDataFrame([(values,)], "v array<double>").select(series.smoothed_array(F.col("v")).alias("s"))
    row = arrays.select("s", series.last_slope(F.col("s")).alias("d")).first()
    assert row.s == pytest.approx(smooth) and row.d == pytest.approx(slope_by_hand(smooth))
    numbered = df.withColumn("i", F.col("SESSION_ID"))
    steep = series.polynomial_filter(numbered, "DM_VALUE", ["PATIENT_ID"], ["i"], "s", 7, derivative=1).orderBy("i").collect()
    assert [r.s for r in steep] == pytest.approx(smoothed_by_hand(values, derivative=1))


def mean_by_hand(values, alpha):
    known = [(i, x) for i, x in enumerate(values) if x is not None]
    weights = [(1 - alpha) ** (len(values) - i) for i, _ in known]
    return sum(w * x for w, (_, x) in zip(weights, known, strict=True)) / sum(weights) if known else None


@pytest.mark.parametrize("alpha", [0.5, 0.8])
def test_ewma_nulls(spark, alpha):
    values = [None, None, 0.3, None, 0.9, 0.1, None, None, 0.4, None]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, x double")
    got = [r.e for r in series.ewma(df, "x", ["k"], ["i"], "e", alpha).orderBy("i").collect()]
    want = [mean_by_hand(values[: k + 1], alpha) for k in range(len(values))]
    assert got[:2] == want[:2] == [None, None] and got[2:] == pytest.approx(want[2:])
    array = spark.createDataFrame([(values,), ([None] * 3000 + [0.7] + [None] * 3000,), ([],), ([None],)], "v array<double>")
    assert [r.e for r in array.select(series.last_mean(F.col("v"), alpha).alias("e")).collect()] == [pytest.approx(want[-1]), pytest.approx(0.7), None, None]


def test_expected_dates(spark):
    cases = [(D(2028, 2, 1) + dt.timedelta(days=a), D(2028, 2, 1) + dt.timedelta(days=a + n), w) for a in (0, 3) for n in (-4, 0, 1, 6, 7, 20) for w in (-1, 0, 2, 6, 7)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a date, b date, w int")
    got = {r.i: r.d for r in df.select("i", dates.expected_dates(F.col("a"), F.col("b"), F.col("w")).alias("d")).collect()}
    for i, (a, b, w) in enumerate(cases):
        assert got[i] == [a + dt.timedelta(days=k) for k in range((b - a).days + 1) if (a + dt.timedelta(days=k)).weekday() == w]


def missing_by_hand(rows, today):
    """(prescription, patient, protocol, date) that is expected but has no row."""
    last, have = {}, {(r[1], r[6]) for r in rows if r[6] is not None}
    for r in rows:
        if r[6] is not None:
            last[r[0]] = max(last.get(r[0], r[6]), r[6])
    out = set()
    for p, pr, q, a, b, w in {(r[0], r[1], r[3], r[4], r[5], r[7]) for r in rows}:
        if None in (a, b, w):
            continue
        end = min(b, last.get(p, today))
        out |= {(pr, p, q, a + dt.timedelta(days=k)) for k in range((end - a).days + 1) if (a + dt.timedelta(days=k)).weekday() == w and (pr, a + dt.timedelta(days=k)) not in have}
    return out


def test_missing_sessions(spark, session_rows):
    today = END + dt.timedelta(days=9)
    unplayed = [(99, 990, None, 203, START, END, None, 3, None, None, None), (99, 991, None, 203, START, None, None, 4, None, None, None)]
    rows = [*made_up_sessions(), *unplayed]
    got = sessions.with_missing_sessions(spark.createDataFrame(rows, COLUMNS), day(today)).collect()
    lacking = [r for r in got if r.STATUS == "NOT_PERFORMED" and r.SESSION_ID is None and (r.PRESCRIPTION_ID, r.SESSION_DATE) not in {(x[1], x[6]) for x in rows}]
    want = missing_by_hand(rows, today)
    assert {(r.PRESCRIPTION_ID, r.PATIENT_ID, r.PROTOCOL_ID, r.SESSION_DATE) for r in lacking} == want and len(lacking) == len(want)
    assert any(x[1] == 99 for x in want) and all(r.ADHERENCE == 0.0 and r.DM_VALUE is None for r in lacking)
    assert len(got) - len(lacking) == len(made_up_sessions())
    assert sessions.with_missing_sessions(session_rows.where("false"), day(today)).isEmpty()


def test_pair_metrics_against_rows(spark, session_rows, patient_rows):
    """The one-pass metrics equal those of the row-wise operators joined by date."""
    now = day(START + dt.timedelta(days=30))
    rows = sessions.in_trial(sessions.with_missing_sessions(session_rows, now), patient_rows.distinct(), now)
    got = {(r.PATIENT_ID, r.PROTOCOL_ID): r for r in scoring.pair_metrics(rows, patient_rows, now).collect()}
    joined = sessions.recent_adherence(rows).join(sessions.progress(rows).select(*constants.BY_PP, "SESSION_DATE", "DM_INDEX", "DELTA_DM"), [*constants.BY_PP, "SESSION_DATE"], "left").collect()
    for key in {(r.PATIENT_ID, r.PROTOCOL_ID) for r in joined}:
        own = sorted((r for r in joined if (r.PATIENT_ID, r.PROTOCOL_ID) == key), key=lambda r: (r.SESSION_INDEX, r.DM_INDEX or 0))
        deltas = [r.DELTA_DM for r in own if r.DELTA_DM is not None]
        r = got[key]
        assert r.SESSION_INDEX == own[-1].SESSION_INDEX
        assert r.LAST_ADHERENCE == pytest.approx(own[-1].ADHERENCE_RECENT)
        assert r.LAST_DELTA == pytest.approx(deltas[-1] if deltas else None)
        assert r.SECOND_DELTA == pytest.approx(own[1].DELTA_DM if len(own) > 1 else None)


def test_score_with_nulls_and_hooks(spark):
    rows = [(0.25, 3.0, 0.5), (None, -2.0, 0.125), (None, None, 0.75), (0.5, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "ADHERENCE_RECENT double, DELTA_DM double, PPF double")
    weights = (2.0, 0.5, 4.0)
    want = [sum(w * (x or 0.0) for w, x in zip(weights, r, strict=True)) for r in rows]
    assert [r.SCORE for r in scoring.scored(df, weights).collect()] == pytest.approx(want)
    fits = spark.createDataFrame([(41, 203, 0.5, [0.5]), (41, 300, 0.2, [0.2])], tables.FITS)
    out = study.score_table(fits, spark.createDataFrame([], COLUMNS), spark.createDataFrame([(41, START, END)], "PATIENT_ID bigint, CLINICAL_TRIAL_START_DATE date, CLINICAL_TRIAL_END_DATE date"), day(END))
    assert {r.PROTOCOL_ID: r.SCORE for r in out.collect()} == {203: 0.5, 300: 0.2}
    hooked = study.score_table(fits, spark.createDataFrame([], COLUMNS), spark.createDataFrame([(41, START, END)], "PATIENT_ID bigint, CLINICAL_TRIAL_START_DATE date, CLINICAL_TRIAL_END_DATE date"), day(END), build=lambda f, *_: f, fill=lambda t: t.withColumn("FILLED", F.lit(True)), score=lambda t, w: t.withColumn("SCORE", F.col("PPF") * 10))
    assert {r.PROTOCOL_ID: (r.SCORE, r.FILLED) for r in hooked.collect()} == {203: (5.0, True), 300: (2.0, True)}


def test_upsert_and_its_file(spark, tmp_path):
    schema = "PATIENT_ID int, PROTOCOL_ID string, PPF double, OTHER string"
    old = spark.createDataFrame([(4, "p", 0.31, "left"), (5, "q", 0.32, "old")], schema)
    new = spark.createDataFrame([(5, "q", 0.77), (6, "r", 0.11)], "PATIENT_ID int, PROTOCOL_ID string, PPF double")
    want = {(4, "p"): (0.31, "left"), (5, "q"): (0.77, None), (6, "r"): (0.11, None)}
    as_map = lambda df: {(r.PATIENT_ID, r.PROTOCOL_ID): (r.PPF, r.OTHER) for r in df.collect()}
    assert as_map(sinks.upserted(old, new)) == want
    assert sinks.upserted(old, new.where("false")).count() == 2 and sinks.upserted(None, new).count() == 2
    old.write.parquet(str(tmp_path / "v1"))
    sinks.write_upsert(spark.read.parquet(str(tmp_path / "v1")), new, str(tmp_path / "v2"))
    assert as_map(spark.read.parquet(str(tmp_path / "v2"))) == want and spark.read.parquet(str(tmp_path / "v1")).count() == 2


def test_clinical_json_and_errors(spark):
    text = json.dumps([{"MoCA": {"Naming": 3}}, {"when": "x", "MoCA": {"Language": 1, "Total": 12}, "Fugl-Meyer": {"FM_D": 9}}])
    df = spark.createDataFrame([(8, text), (9, None), (10, "[]"), (11, "[{]")], "PATIENT_ID int, j string")
    scores = fit.canonical_scales(clinical.last_evaluation(df, "j", ["PATIENT_ID"]))
    assert {(r.PATIENT_ID, r.SCALE): r.DEFICIT for r in fit.deficits(scores).collect()} == pytest.approx({(8, "MOCA_LANGUAGE"): 2 / 3, (8, "MOCA_TOTAL"): 0.6, (8, "FM_D"): -0.5})
    strange = spark.createDataFrame([(8, "NO_SUCH_SCALE", 1.0)], "PATIENT_ID int, SCALE string, SCORE double")
    with pytest.raises(Exception, match="no maximum for scale NO_SUCH_SCALE"):
        fit.deficits(strange).collect()
    assert fit.require_scales(scores, ["FM_D"]).count() == 3
    with pytest.raises(ValueError, match="MOCA_RECALL"):
        fit.require_scales(scores, ["FM_D", "MOCA_RECALL"])
    attributes = spark.createDataFrame([(203, 0.5)], "PROTOCOL_ID bigint, GRASPING double")
    with pytest.raises(ValueError, match="no scores for the scales"):
        study.patient_fits(scores, attributes)
    texts = spark.createDataFrame([("1.5", "x")], "a string, b string")
    assert texts.select(*tables.parsed({"a": "double"})).first().a == 1.5
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        texts.select(*tables.parsed({"b": "double"})).collect()


@pytest.mark.parametrize(("n", "days", "per_day"), [(5, 7, 5), (12, 7, 5), (3, 4, 2), (9, 2, 3)])
def test_new_schedule_matches_slots(spark, n, days, per_day):
    df = spark.createDataFrame([(1, 200 + i, float(-i)) for i in range(n)], "PATIENT_ID bigint, PROTOCOL_ID bigint, SCORE double")
    expected = {}
    for slot in range(days * per_day):
        expected.setdefault(200 + slot % n, set()).add(slot % days)
    plan = recommend.new_schedule(df, n, days, per_day)
    assert {r.PROTOCOL_ID: r.DAYS for r in plan.collect()} == {k: sorted(v) for k, v in expected.items()}
    counts = recommend.day_counts(plan).collect()
    assert len(counts) == days and max(r.N for r in counts) <= per_day
    assert recommend.broken_schedules(plan, days, per_day).isEmpty()
    mixed = recommend.shuffled_schedule(df, 4, n, days, per_day)
    assert {r.PROTOCOL_ID: r.DAYS for r in mixed.collect()} == {r.PROTOCOL_ID: r.DAYS for r in recommend.shuffled_schedule(df, 4, n, days, per_day).collect()}
    assert sorted((r.DAY, r.N) for r in recommend.day_counts(mixed).collect()) == sorted((r.DAY, r.N) for r in counts)


def score_frame(spark, rows):
    return spark.createDataFrame(rows, "PATIENT_ID bigint, PROTOCOL_ID bigint, SCORE double, USAGE bigint, USAGE_WEEK bigint, DAYS array<int>")


def substitutes_by_hand(rows, similarity, top=5):
    """{(patient, old): new}, one swap after another."""
    out = {}
    for p in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == p}
        plan = {q: r for q, r in own.items() if r[5]}
        if not plan:
            continue
        mean = sum(r[2] for r in plan.values()) / len(plan)
        low = sorted(q for q, r in plan.items() if r[2] < mean) or [min(plan, key=lambda q: (plan[q][2], q))]
        taken, free = set(plan), any(r[3] == 0 for r in own.values())
        for old in low:
            near = [b for _, b in sorted((-s, b) for a, b, s in similarity if a == old and b != old and b not in taken)]
            if free:
                pick = next((b for b in near if b in own and own[b][3] == 0), old)
            else:
                close = [b for b in near[:top] if b in own]
                least = min((own[b][3] for b in close), default=None)
                pick = next((b for b in close if own[b][3] == least), old)
            taken.add(pick)
            out[p, old] = pick
    return out


@pytest.mark.parametrize("seed", range(4))
def test_substitution_chain(spark, seed):
    draw = np.random.default_rng(seed)
    protocols = list(range(30, 42))
    sim = [(a, b, round(float(draw.random()), 2)) for a in protocols for b in protocols if a != b]
    rows = []
    for p in range(12):
        for q in protocols[: int(draw.integers(6, 13))]:
            planned = draw.random() < 0.5
            rows.append((p, q, round(float(draw.normal()), 3), int(draw.integers(1 if p % 3 else 0, 5)), 1, sorted(draw.choice(7, size=2, replace=False).tolist()) if planned else []))
    similarity = spark.createDataFrame(sim, "PROTOCOL_A bigint, PROTOCOL_B bigint, SIMILARITY double")
    scores = score_frame(spark, rows)
    want = substitutes_by_hand(rows, sim)
    assert {(r.PATIENT_ID, r.OLD): r.NEW for r in recommend.substitutions(scores, similarity).collect()} == want
    plan = {(r[0], r[1]): r[5] for r in rows if r[5]}
    after = {(p, want.get((p, q), q)): d for (p, q), d in plan.items()}
    got = {(r.PATIENT_ID, r.PROTOCOL_ID): r.DAYS for r in recommend.recommended(scores, similarity).where("BRANCH = 'update'").collect()}
    assert got == after


def test_skipped_week_repeats_and_new_patients(spark):
    sim = spark.createDataFrame([(61, 62, 0.4)], "PROTOCOL_A bigint, PROTOCOL_B bigint, SIMILARITY double")
    rows = score_frame(spark, [(3, 61, 0.3, 2, 0, [1, 4, 6]), (3, 62, 0.9, 0, 0, []), (5, 61, 0.8, 0, 0, []), (5, 62, 0.6, 0, 0, [])])
    got = {(r.PATIENT_ID, r.PROTOCOL_ID): (r.BRANCH, r.DAYS) for r in recommend.recommended(rows, sim).collect()}
    assert got[3, 61] == ("repeat", [1, 4, 6]) and (3, 62) not in got
    assert got[5, 61][0] == "new" and got[5, 62][1] == list(range(7))


def test_audited_join_and_rules(spark):
    a = spark.createDataFrame([(14, 1.25), (15, 0.5), (16, None)], "k int, ADHERENCE double")
    b = spark.createDataFrame([(15, "x"), (17, "y")], "k int, v string")
    for how, n in (("inner", 1), ("left", 3), ("right", 2), ("outer", 4)):
        both, left, right = quality.audited_join(a, b, ["k"], how)
        assert (both.count(), left.count(), right.count()) == (n, 2, 1)
    assert quality.violations(a, {"share": "ADHERENCE between 0 and 1"}).first().N == 1
    assert quality.violations(a.where("false"), {"share": "ADHERENCE between 0 and 1"}).first().N == 0


def test_completed_fits_and_errors(spark):
    fits = spark.createDataFrame([(21, 70, 0.4, [0.4]), (21, 80, 0.3, [0.3])], tables.FITS)
    wanted = spark.createDataFrame([(21,), (22,)], "PATIENT_ID bigint")
    got = {(r.PATIENT_ID, r.PROTOCOL_ID): r.PPF for r in tables.completed_fits(fits, wanted).collect()}
    assert got == {(21, 70): 0.4, (21, 80): 0.3, (22, 70): None, (22, 80): None}
    with pytest.raises(ValueError, match="none of the patients has a fit"):
        tables.completed_fits(fits, wanted.where("PATIENT_ID = 22"))
    assert tables.read_or_empty(spark, lambda: fits.select("nothing"), tables.FITS).isEmpty()
    studies = spark.createDataFrame([(1, 21), (1, 21), (2, 22)], "STUDY_ID int, PATIENT_ID bigint")
    assert [r.PATIENT_ID for r in tables.cohort(studies, [1]).collect()] == [21]
    with pytest.raises(ValueError, match="no patients"):
        tables.cohort(studies, [3])
    many = spark.range(fit.CATALOGUE + 1).select(F.col("id").alias("PROTOCOL_ID"), F.array(F.lit(1.0)).alias("VECTOR"))
    pairs = fit.fits(wanted.withColumn("VECTOR", F.array(F.lit(1.0))), many)  # a large catalogue is not broadcast, and gives its rows all the same
    assert pairs.count() == wanted.count() * (fit.CATALOGUE + 1) and pairs.where("PPF <> 1").isEmpty()
    assert "ResolvedHint (strategy=broadcast)" not in pairs._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_loader_reads_what_sinks_write(spark, session_rows, tmp_path, kind):
    folder = str(tmp_path)
    full = session_rows.withColumns({c: F.lit(60) for c in ("REAL_SESSION_DURATION", "PRESCRIBED_SESSION_DURATION", "SESSION_DURATION")}).select([f.name for f in tables.SESSIONS.fields])
    series_ = session_rows.select("PATIENT_ID", "SESSION_ID", "PROTOCOL_ID", F.lit("calm").alias("GAME_MODE"), F.lit(7).alias("SECONDS_FROM_START"), F.lit("k").alias("DM_KEY"), "DM_VALUE", F.lit("e").alias("PE_KEY"), F.lit(0.5).alias("PE_VALUE"))
    patients = spark.createDataFrame([(41, START, END, json.dumps([{"ARAT": {"Grip": 4}}])), (57, START, END, None)], "PATIENT_ID bigint, CLINICAL_TRIAL_START_DATE date, CLINICAL_TRIAL_END_DATE date, CLINICAL_SCORES string")
    fits = spark.createDataFrame([(41, 203, 0.5, [0.2, 0.3])], tables.FITS)
    near = spark.createDataFrame([(203, 219, 0.25)], tables.SIMILARITY)
    attributes = spark.createDataFrame([(203, 0.5), (217, None)], "PROTOCOL_ID bigint, GRASPING double")
    for name, df in {"sessions": full, "timeseries": series_, "patient": patients, "ppf": fits, "protocol_similarity": near, "protocol_attributes": attributes}.items():
        path = f"{folder}/{name}.{kind}"
        if kind == "csv":
            sinks.write_csv(df.withColumn("CONTRIB", F.to_json("CONTRIB")) if name == "ppf" else df, path) if name != "patient" else df.write.option("escape", '"').csv(path, header=True)
        else:
            df.write.parquet(path)
    loader = tables.FileLoader(spark, folder, kind)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(loader.sessions(), full) and same(loader.timeseries(), series_) and same(loader.similarity(), near) and same(loader.fits(), fits)
    assert same(loader.sessions([57]), full.where("PATIENT_ID = 57"))
    assert same(loader.timeseries(spark.createDataFrame([(86,)], "PATIENT_ID bigint")), series_.where("PATIENT_ID = 86"))
    assert "In(PATIENT_ID, [41,57])" in loader.sessions([41, 57])._jdf.queryExecution().toString() or kind == "csv"
    if kind == "parquet":
        assert {(r.PATIENT_ID, r.SCALE, r.SCORE) for r in loader.subscales().collect()} == {(41, "ARAT.Grip", 4.0)}
    assert {r.PROTOCOL_ID: r.GRASPING for r in loader.attributes().collect()} == {203: 0.5, 217: None}
    assert loader.fits(spark.createDataFrame([(41,), (57,)], "PATIENT_ID bigint")).count() == 2


def test_attribute_paths_and_wide_subscales(spark, tmp_path):
    (tmp_path / "own.csv").write_text("PROTOCOL_ID,GRASPING\n204,0.75\n")
    loader = tables.FileLoader(spark, str(tmp_path / "empty"), "csv")
    assert loader.attributes(str(tmp_path / "own.csv")).first().GRASPING == 0.75
    assert loader.attributes(default=str(tmp_path / "own.csv")).first().PROTOCOL_ID == 204
    with pytest.raises(ValueError):
        loader.attributes()
    (tmp_path / "subscales.csv").write_text("STUDY_ID,PATIENT_ID,FM_A,MoCA.Naming\n1,41,12,\n1,57,30,2\n")
    rows = tables.FileLoader(spark, str(tmp_path), "csv").wide_subscales().collect()
    assert {(r.PATIENT_ID, r.SCALE): r.SCORE for r in rows} == {(41, "FM_A"): 12.0, (57, "FM_A"): 30.0, (57, "MoCA.Naming"): 2.0}
    with pytest.raises(Exception, match=r"(?i)driver|ClassNotFound|No suitable"):
        tables.jdbc(spark, "jdbc:none:x", "sessions").count()


def test_study_run_is_written_and_read_back(spark, session_rows, patient_rows, tmp_path):
    class Own:
        def sessions(self, patients=None):
            return tables.of_patients(session_rows, patients)

        def patients(self, patients=None):
            return tables.of_patients(patient_rows.distinct(), patients)

        def fits(self, patients=None):
            return spark.createDataFrame([(p, q, 0.1 * k + 0.01 * p, [0.1]) for p in (41, 57, 86) for k, q in enumerate((203, 219, 226, 204, 207))], tables.FITS)

        def similarity(self):
            return spark.createDataFrame([(a, b, 1 / (1 + abs(a - b))) for a in (203, 219, 226, 204) for b in (203, 219, 226, 204)], tables.SIMILARITY)

    studies = spark.createDataFrame([(1, 41), (1, 57), (1, 86), (1, 999)], "STUDY_ID int, PATIENT_ID bigint")
    run = study.study_run(Own(), studies, [1], day(START + dt.timedelta(days=21)), "r7")
    study.write_run(run, str(tmp_path), "r7")
    back = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    chosen = back("recommendations").collect()
    assert {r.PATIENT_ID for r in chosen} == {41, 57, 86, 999} and {r.PROTOCOL_ID for r in chosen} <= set(constants.ALLOWED_PROTOCOLS)
    staged = back("staging").where("PATIENT_ID < 999").collect()
    assert len(staged) == sum(len(r.DAYS) for r in chosen if r.PATIENT_ID < 999)
    assert {(r.STARTING_DATE, r.ENDING_DATE) for r in staged} == {(START + dt.timedelta(days=21), START + dt.timedelta(days=28))}
    assert back("metrics").count() == 8 * len(chosen)
    summary = spark.read.json(f"{tmp_path}/summary").first()
    assert (summary.PATIENTS, summary.SUCCEEDED, summary.FAILED, summary.OVERALL) == (4, 4, 0, "success")
    study.write_run(run, str(tmp_path), "r8")
    assert back("statuses").groupBy("RUN_ID").count().count() == 2
    sinks.append(run["metrics"].limit(3), str(tmp_path / "more"), ["PATIENT_ID"])
    assert spark.read.parquet(str(tmp_path / "more")).count() == 3


def test_similarity_and_models(spark):
    long = spark.createDataFrame([(6, "a", 0.2), (6, "b", 0.5), (6, "x1", 1.0), (6, "x2", 0.0), (9, "a", 0.6), (9, "b", 0.5), (9, "x1", 0.0), (9, "x2", 1.0)], "PROTOCOL_ID bigint, FEATURE string, VALUE double")
    as_map = lambda df: {(r.PROTOCOL_A, r.PROTOCOL_B): r.SIMILARITY for r in df.collect()}
    assert as_map(fit.similarity(long)) == pytest.approx({(6, 6): 1.0, (6, 9): 0.25, (9, 6): 0.25, (9, 9): 1.0})
    assert as_map(fit.similarity(long, "x"))[6, 9] == pytest.approx(1 - 2 / 3)
    draw = np.random.default_rng(12)
    x = draw.normal(size=(40, 2))
    y = 1.5 - x[:, 0] + 0.25 * x[:, 1] + draw.normal(size=40)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "u double, v double, y double")
    full = np.c_[np.ones(40), x]
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    rest = y - full @ beta
    error = np.sqrt(rest @ rest / 37 * np.diag(np.linalg.inv(full.T @ full)))
    terms = cohort.linear_model(df, "y", ["u", "v"]).collect()
    assert [t.COEFFICIENT for t in terms] == pytest.approx(beta.tolist()) and [t.STD_ERROR for t in terms] == pytest.approx(error.tolist())
    for t in terms:  # the tail by numerical integration of the density
        s = np.linspace(abs(t.T), abs(t.T) + 400, 4_000_001)
        density = math.exp(math.lgamma(19) - math.lgamma(18.5)) / math.sqrt(37 * math.pi) * (1 + s * s / 37) ** -19
        assert t.P == pytest.approx(2 * float(((density[1:] + density[:-1]) / 2).sum() * (s[1] - s[0])), rel=1e-4)
    assert cohort.diagnostics(df, "y", ["u", "v"]).agg(F.sum("LEVERAGE")).first()[0] == pytest.approx(3.0)
    assert cohort.linear_model(df.limit(1), "y", ["u"]).isEmpty()


def test_growth_fits_reach_a_dense_search(spark):
    draw, rows, x = np.random.default_rng(5), [], np.arange(1, 15, dtype=float)
    made = {1: 3 * np.exp(-0.31 * x) + 1, 2: 2 / (1 + np.exp(-0.9 * (x - 6.3))), 3: draw.random(14), 4: np.full(14, 0.5)}
    for g, y in made.items():
        rows += [(g, float(a), float(b)) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame([*rows, (5, 1.0, 1.0), (5, 2.0, 2.0)], "g int, i double, y double")
    exp = {r.g: r for r in cohort.exponential_growth(df, ["g"], "y", "i").collect()}
    log = {r.g: r for r in cohort.logistic_growth(df, ["g"], "y", "i").collect()}
    assert set(exp) == set(log) == {1, 2, 3, 4}
    assert (exp[1].A, exp[1].B, exp[1].C, exp[1].R2) == pytest.approx((3, 0.31, 1, 1), rel=1e-2)
    assert (log[2].L, log[2].K, log[2].X0, log[2].R2) == pytest.approx((2, 0.9, 6.3, 1), rel=1e-2)
    assert exp[4].SSE == pytest.approx(0, abs=1e-9) and exp[4].R2 is None
    for g, y in made.items():
        spread = ((y - y.mean()) ** 2).sum()
        best = min(spread - (np.cov(np.exp(-b * x), y, bias=True)[0, 1] * 14) ** 2 / max((np.exp(-b * x).var() * 14), 1e-12) for b in np.geomspace(0.01, 3.4, 4000))
        assert exp[g].SSE <= max(best, 0) * 1.01 + 1e-6
        sigmoids = (1 / (1 + np.exp(-k * (x - m))) for k in np.geomspace(0.04, 6, 150) for m in np.linspace(-5, 20, 150))
        best = min((y @ y) - (s @ y) ** 2 / (s @ s) for s in sigmoids)
        assert log[g].SSE <= best * 1.05 + 1e-3


def test_fits_of_long_vectors(spark):
    """The work of a fit grows with a vector's length, not with its square; null, NaN and zero vectors stay as they were."""
    draw = np.random.default_rng(4)
    p, q = draw.random((24, 4000)), draw.random((2, 4000))
    odd = [(30, None), (31, [None] + [1.0] * 3999), (32, [float("nan")] * 4000), (33, [0.0] * 4000)]
    people = spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(p)], *odd], "PATIENT_ID bigint, VECTOR array<double>")
    begun = time.monotonic()
    rows = fit.fits(people, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "PROTOCOL_ID bigint, VECTOR array<double>")).select(*constants.BY_PP, "PPF").collect()
    assert time.monotonic() - begun < 10
    got, cosine = {(r.PATIENT_ID, r.PROTOCOL_ID): r.PPF for r in rows}, (p @ q.T) / np.outer(np.linalg.norm(p, axis=1), np.linalg.norm(q, axis=1))
    assert got == pytest.approx({(i, j): cosine[i, j] for i in range(24) for j in range(2)} | {(33, j): 0.0 for j in range(2)})


def test_pair_metrics_copy_no_rows(spark):
    """Distinct sessions are counted where a pair's rows are; ids that are missing or come twice count as before."""
    kinds = "PATIENT_ID bigint, PROTOCOL_ID bigint, PRESCRIPTION_ID bigint, SESSION_ID bigint, SESSION_DATE date, WEEKDAY_INDEX int, STATUS string, ADHERENCE double, DM_VALUE double"
    rows = [(41, 203, 9, i, D(2031, 10, d), 2, "CLOSED", 0.5, 0.1) for i, d in ((7, 1), (7, 2), (None, 9), (8, 9), (8, 10), (9, 22))]
    people = spark.createDataFrame([(41, START, END)], "PATIENT_ID bigint, CLINICAL_TRIAL_START_DATE date, CLINICAL_TRIAL_END_DATE date")
    out = scoring.pair_metrics(spark.createDataFrame(rows, kinds), people, day(D(2031, 10, 16)))
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    one = out.first()
    assert (one.USAGE, one.USAGE_WEEK, one.DAYS, one.SESSION_INDEX) == (3, 1, [2], 6)


def test_repeated_sessions_in_weeks(spark):
    """Sessions of different pairs that share an id all count; a repeated session of a pair counts once, in the week of its earliest time."""
    at = lambda d: dt.datetime(2031, 10, d)
    rows = [(p, q, 7, at(d)) for p in (41, 57, 86) for q in (203, 219) for d in (23, 12, 30)] + [(41, 203, 8, at(13)), (41, 203, None, at(13))]
    df = spark.createDataFrame(rows, "PATIENT_ID bigint, PROTOCOL_ID bigint, SESSION_ID bigint, ts timestamp").repartition(5)
    got = {(r.PATIENT_ID, r.PROTOCOL_ID, r.WEEK_START, r.USAGE) for r in weekly_usage(df).collect()}
    assert got == {(p, q, at(9), 2 if (p, q) == (41, 203) else 1) for p in (41, 57, 86) for q in (203, 219)}


def test_growth_fits_of_many_series(spark, monkeypatch):
    """Series are fitted together: thousands take seconds, and where a block ends makes no difference."""
    draw = np.random.default_rng(8)
    made = [(g, float(i), float(v)) for g in range(40) for i, v in enumerate(draw.random(3 + g % 20), 1)]
    df = spark.createDataFrame(made, "g int, i double, y double")
    many = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(150)))).repartition(8, "g", "k")
    begun = time.monotonic()
    for fit_of, names in ((cohort.exponential_growth, "ABC"), (cohort.logistic_growth, ("K", "X0", "L"))):
        with monkeypatch.context() as small:
            small.setattr(cohort, "BLOCK", 7)  # shorter than a series
            one = {r.g: r for r in fit_of(df, ["g"], "y", "i").collect()}
        rows = fit_of(many, ["g", "k"], "y", "i").collect()
        assert len(one) == 40 and len(rows) == 6000
        for r in rows:
            assert (r.N, r.SSE, r.R2) == pytest.approx((one[r.g].N, one[r.g].SSE, one[r.g].R2))
            assert [r[c] for c in names] == pytest.approx([one[r.g][c] for c in names])
    assert time.monotonic() - begun < 60


def test_ranks_shares_and_clips(spark):
    draw = np.random.default_rng(2)
    v = [float(x) for x in draw.integers(0, 40, size=500)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(v, draw.normal(size=500).tolist(), strict=True))] + [(999, None, 1.0)], "i int, x double, y double")
    for parts in (1, 4, 64):
        got = {r.i: r.k for r in cohort.average_rank(df, "x", "k", parts).collect()}
        assert got == {i: sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for i, a in enumerate(v)}
    plan = cohort.average_rank(df, "y", "k")._jdf.queryExecution().toString()
    assert "windowspecdefinition(__part" in plan
    shares = spark.createDataFrame([(5.0, 10.0), (12.0, 10.0), (3.0, 0.0), (3.0, None), (None, 10.0)], "a double, b double")
    assert [r.s for r in shares.select(cohort.completed_share(F.col("a"), F.col("b")).alias("s")).collect()] == [0.5, 1.0, None, None, None]
    assert [r.s for r in shares.select(vectors.clip(F.col("a") / 10, 0.35).alias("s")).collect()] == [0.5, 1.0, 0.35, 0.35, None]
    names = spark.createDataFrame([("Tuesday",), ("SUNDAY",), ("nil",)], "n string")
    assert [r.k for r in names.select(dates.weekday_number(F.col("n")).alias("k")).collect()] == [1, 6, -1]


def test_streaming_usage(spark, tmp_path):
    rows = [(12, 31, 901, dt.datetime(2029, 5, 2)), (12, 31, 901, dt.datetime(2029, 5, 2)), (12, 31, 902, dt.datetime(2029, 5, 2)), (12, 31, 903, dt.datetime(2029, 5, 20)), (12, 31, None, dt.datetime(2029, 5, 2))]
    schema = "PATIENT_ID bigint, PROTOCOL_ID bigint, SESSION_ID bigint, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = weekly_usage(stream).writeStream.format("memory").queryName("weekly").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.USAGE for r in spark.table("weekly").groupBy("WEEK_START").agg(F.max("USAGE").alias("USAGE")).collect()) == [1, 2]
