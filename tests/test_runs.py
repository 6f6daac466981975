"""Study runs, writes that can be repeated, versions, database scans, and operators that came with them."""

import datetime as dt
import json
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from restora import constants
from restora.functions import hashing, series
from restora.operators import cohort, faults, profile, quality, recommend
from restora.plans import study
from restora.sources import sinks, tables

START = dt.date(2023, 5, 1)  # a Monday
SCALES = {"ARAT": {"Grasp": 9, "Grip": 4, "Pinch": 11, "Gross movement": 6}, "MoCA": {"Visuospatial/Executive": 3, "Naming": 2, "Attention": 4, "Language": 1, "Abstraction": 1, "Delayed Recall": 2, "Orientation": 5}}
PROTOCOLS = (203, 219, 226, 204)


def document(**changes):
    body = {k: dict(v) for k, v in SCALES.items()}
    for place, value in changes.items():
        test, name = place.split("__")
        body[test][name.replace("_", " ")] = value
    return json.dumps([{"ARAT": {"Grip": 1}}, {"when": "2023-04-28", **body}])


@pytest.fixture(scope="module")
def loader(spark):
    day = lambda n: START + dt.timedelta(days=n)
    people = [(7, START, day(80), document()), (8, START, day(80), document(ARAT__Dance=3)), (9, START, day(80), document()[:50]), (11, None, day(80), document()), (12, START, day(80), document(ARAT__Grip="fair")), (13, START, day(80), None), (14, START, day(80), document()), (15, START, day(-1), document())]
    played = [(p, 50 + p * 10 + k, 1000 + p * 100 + d, q, START, day(60), "soon" if p == 14 and d == 5 else str(day(d)), d % 7, "CLOSED", 0.5 + 0.01 * d, 0.2 + 0.02 * d) for p in (7, 8, 11, 14) for k, q in enumerate(PROTOCOLS[:2]) for d in (k, k + 3, k + 5, k + 9)]
    names = "PATIENT_ID bigint, PRESCRIPTION_ID bigint, SESSION_ID bigint, PROTOCOL_ID bigint, PRESCRIPTION_STARTING_DATE date, PRESCRIPTION_ENDING_DATE date, SESSION_DATE string, WEEKDAY_INDEX int, STATUS string, ADHERENCE double, DM_VALUE double"
    wide = sorted({f for x in constants.SCALE_FEATURES.values() for f in x})
    attributes = spark.createDataFrame([(q, *[0.1 + ((i * 7 + k * 3) % 10) / 12 for i in range(len(wide))]) for k, q in enumerate(PROTOCOLS)], "PROTOCOL_ID bigint, " + ", ".join(f"{c} double" for c in wide))

    class Own:
        def sessions(self, patients=None):
            return tables.of_patients(faults.typed(spark.createDataFrame(played, names), {"SESSION_DATE": "date"}), patients)

        def patients(self, patients=None):
            return tables.of_patients(spark.createDataFrame(people, "PATIENT_ID bigint, CLINICAL_TRIAL_START_DATE date, CLINICAL_TRIAL_END_DATE date, CLINICAL_SCORES string"), patients)

        def similarity(self):
            return spark.createDataFrame([(a, b, 1 / (1 + abs(a - b))) for a in PROTOCOLS for b in PROTOCOLS], tables.SIMILARITY)

        fits_of = staticmethod(lambda people: faults.checked_fits(people, attributes))

    return Own()


def run(spark, loader, ids, **options):
    wanted = spark.createDataFrame([(i,) for i in ids], "PATIENT_ID bigint")
    return study.patients_run(loader, wanted, F.lit(START + dt.timedelta(days=15)), "r1", fits_of=loader.fits_of, **options)


def test_faulty_patients_do_not_stop_the_others(spark, loader, tmp_path):
    out = run(spark, loader, [7, 8, 9, 11, 12, 13, 14, 15, 99], keep=study.kept_in(str(tmp_path / "all"), "r1"))
    got = {r.PATIENT_ID: (r.STATUS, r.REASON) for r in out["statuses"].collect()}
    assert got == {
        7: ("ok", None), 8: ("failed", "no maximum for scale ARAT.Dance"), 9: ("failed", "unreadable clinical scores"), 11: ("failed", "no start date"), 12: ("failed", "no number for scale ARAT_GRIP"),
        13: ("failed", "no clinical scores"), 14: ("failed", "bad SESSION_DATE"), 15: ("failed", "trial ends before it starts"), 99: ("failed", "unknown patient"),
    }
    summary = out["summary"].first()
    assert (summary.PATIENTS, summary.SUCCEEDED, summary.FAILED, summary.OVERALL) == (9, 1, 8, "partial_success") and summary.RECOMMENDATIONS > 0
    alone = run(spark, loader, [7], keep=study.kept_in(str(tmp_path / "one"), "r1"))
    for name in ("scores", "recommendations", "staging", "metrics"):
        assert sorted(map(repr, out[name].collect())) == sorted(map(repr, alone[name].collect())) != []


def test_runs_of_nobody_and_of_failures_only(spark, loader):
    assert run(spark, loader, [])["summary"].first().OVERALL == "warning"
    out = run(spark, loader, [9, 99])
    assert out["summary"].first().OVERALL == "failure" and out["staging"].isEmpty() and out["scores"].isEmpty()


def test_two_scores_and_missing_ones_are_reasons(spark, loader):
    rows = [(1, document(ARAT__Grasp=None)), (2, json.dumps([{"ARAT": {"Grasp": 3}, "MoCA": {}}])), (3, json.dumps([{"BI": 3}])), (4, json.dumps([{"MoCA": SCALES["MoCA"] | {"DelayedRecall": 1}, "ARAT": SCALES["ARAT"]}])), (5, "[]"), (6, "")]
    people = spark.createDataFrame(rows, "PATIENT_ID bigint, CLINICAL_SCORES string")
    fits, bad = loader.fits_of(people)
    reasons = {r.PATIENT_ID: r.REASON for r in faults.reasons(bad).collect()}
    assert fits.isEmpty() and reasons[1] == "no score for scale ARAT_GRASP" and reasons[2].startswith("no score for scale ARAT_GRIP, ARAT_GROSS") and reasons[4] == "two scores for scale MOCA_RECALL"
    assert {reasons[p] for p in (3, 5, 6)} <= {"no clinical scores", "unreadable clinical scores"}


def test_a_run_written_twice_leaves_the_same_rows(spark, loader, tmp_path):
    wanted = spark.createDataFrame([(7,), (9,)], "PATIENT_ID bigint")
    write = lambda ids, name: study.write_study(str(tmp_path), loader, ids, F.lit(START + dt.timedelta(days=15)), name, fits_of=loader.fits_of)
    rows = lambda n: spark.read.parquet(f"{tmp_path}/{n}").collect() if any((tmp_path / n).glob("RUN_ID=*")) else []
    read = lambda: {n: sorted(map(repr, rows(n))) for n in ("faults", "scores", "recommendations", "staging", "metrics", "statuses")}
    write(wanted, "r1")
    once = read()
    write(wanted, "r1")
    assert read() == once and all(once.values())
    write(wanted.where("PATIENT_ID = 9"), "r1")  # now nobody is scored: no row of the run stays but the reason and the status
    assert {n: len(x) for n, x in read().items()} == {n: int(n in ("faults", "statuses")) for n in once}
    assert [json.loads(x) for x in Path(next((tmp_path / "summary/RUN_ID=r1").glob("*.json"))).read_text().splitlines()][0]["OVERALL"] == "failure"


def test_files_of_a_run_do_not_grow_with_patients(spark, tmp_path):
    many = spark.range(5000).select(F.col("id").alias("PATIENT_ID"), F.col("id").alias("VALUE"))
    for _ in range(2):
        sinks.artifacts({"values": many}, str(tmp_path), "a b/c", files=6)
    files = [f for _, _, names in os.walk(tmp_path / "values") for f in names if f.endswith(".parquet")]
    assert len(files) <= 6 and spark.read.parquet(f"{tmp_path}/values").count() == 5000
    sinks.artifacts({"values": many.limit(2)}, str(tmp_path / "text"), "x", kind="csv")
    assert spark.read.csv(f"{tmp_path}/text/values", header=True).count() == 2
    sinks.replace_run(many.limit(0), f"{tmp_path}/values", "a b/c")
    assert sinks.read_run(spark, f"{tmp_path}/values", many.schema, "a b/c").isEmpty()


def test_versions_swap_in_one_step(spark, tmp_path):
    table = sinks.Versions(spark, str(tmp_path / "ppf"))
    rows = lambda *x: spark.createDataFrame(list(x), "PATIENT_ID bigint, PROTOCOL_ID bigint, PPF double")
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert table.read() is None
    first = table.upsert(rows((1, 2, 0.5), (3, 4, 0.25)))
    held = table.read()
    table.upsert(rows((1, 2, 0.75), (5, 6, 1.0)))
    assert plain(held) == [(1, 2, 0.5), (3, 4, 0.25)]
    now = [(1, 2, 0.75), (3, 4, 0.25), (5, 6, 1.0)]
    assert plain(table.read()) == now
    before = table.current()
    assert table.upsert(rows((1, 2, 9.0)).where("false")) == before  # nothing new
    with pytest.raises(Exception, match="cut off"):
        table.upsert(rows((1, 2, 3.0)).withColumn("PPF", F.raise_error(F.lit("cut off")).cast("double")))
    assert table.current() == before and plain(table.read()) == now
    with pytest.raises(RuntimeError):
        table.publish(rows((0, 0, 0.0)), first)  # started from an older version
    assert plain(table.read()) == now
    table.upsert(rows((7, 8, 0.125)))
    table.sweep(keep=2)
    kept = [n for n in os.listdir(tmp_path / "ppf") if n.startswith("v-")]
    assert len(kept) == 2 and plain(table.read()) == [*now, (7, 8, 0.125)]


def test_database_scans_are_partitioned(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/base;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(i, f"s{i}") for i in range(40, 140, 3)] + [(None, "lost")]
    spark.createDataFrame(rows, "PATIENT_ID bigint, NOTE string").write.option("createTableColumnTypes", "NOTE varchar(20)").jdbc(url, "notes", properties=driver)
    whole = tables.jdbc(spark, url, "notes", parts=4, **driver)
    assert whole.rdd.getNumPartitions() == 5 and sorted(map(repr, whole.collect())) == sorted(repr(r) for r in spark.createDataFrame(rows, whole.schema).collect())
    ids = [40, 43, 46, 100, 101, 43]
    some = tables.jdbc(spark, url, "notes", ids, chunk=2, **driver)
    assert some.rdd.getNumPartitions() == 3 and sorted(r.PATIENT_ID for r in some.collect()) == [40, 43, 46, 100]
    plan = whole.where("NOTE = 's43'").select("PATIENT_ID")
    text = plan._jdf.queryExecution().toString()
    assert "PushedFilters: [*IsNotNull(NOTE), *EqualTo(NOTE,s43)]" in text and [r.PATIENT_ID for r in plan.collect()] == [43]
    joined = tables.jdbc(spark, url, "notes", spark.createDataFrame([(40,), (43,), (43,)], "PATIENT_ID bigint"), parts=3, **driver)
    assert sorted(r.PATIENT_ID for r in joined.collect()) == [40, 43]
    assert tables.jdbc(spark, url, "notes", [], **driver).count() == 0
    spark.createDataFrame([], "PATIENT_ID bigint").write.jdbc(url, "nothing", properties=driver)
    assert tables.jdbc(spark, url, "nothing", **driver).count() == 0


def test_ranges_cover_every_id_once():
    for low, high, parts in ((0, 0, 4), (5, 7, 9), (-10, 300, 7), (None, None, 3)):
        ranges = tables.id_ranges("k", low, high, parts)
        assert ranges[-1] == "k is null"
        for k in range((low or 0) - 2, (high or 0) + 3):
            assert sum(eval(p.replace("k is not null", "True").replace("k is null", "False"), {"k": k}) for p in ranges) == 1  # noqa: S307


def test_audit_exports_join_once_and_prune(spark, tmp_path):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k bigint, x string")
    b = spark.createDataFrame([(2, 0.5), (3, 1.5), (None, 2.5)], "k bigint, y double")
    for how, n in (("inner", 2), ("left", 4), ("right", 4), ("outer", 6)):
        both, left, right = quality.export_audit(a, b, ["k"], str(tmp_path / how), how)
        assert both.count() == n and sorted(r.x for r in left.collect()) == ["a", "d"] and sorted(r.y for r in right.collect()) == [1.5, 2.5]
    plan = left._jdf.queryExecution().toString()
    assert "Join" not in plan and "PartitionFilters: [isnotnull(MATCH" in plan
    assert {p.name for p in (tmp_path / "outer").iterdir() if p.is_dir()} == {"MATCH=matched", "MATCH=left_only", "MATCH=right_only"}
    empty = quality.export_audit(a.where("false"), b.where("false"), ["k"], str(tmp_path / "none"))
    assert [t.count() for t in empty] == [0, 0, 0]


def test_quarantine_splits_rows_and_counts_rules(spark, tmp_path):
    rules = {"share": "x between 0 and 1", "there": "k is not null", "small": "k < 10"}
    rows = spark.createDataFrame([(1, 0.5), (2, 1.5), (None, 2.0), (12, -1.0), (3, None)], "k bigint, x double")
    good, bad, counts = quality.quarantine(rows, rules, str(tmp_path / "q"))
    assert sorted((r.k, r.x) for r in good.collect()) == [(1, 0.5), (3, None)] and good.columns == rows.columns
    assert {r.k: r.BROKEN for r in bad.collect()} == {2: ["share"], None: ["share", "there"], 12: ["share", "small"]}
    assert {r.RULE: r.N for r in counts.collect()} == {"share": 3, "there": 1, "small": 1}
    assert {r.RULE: r.N for r in quality.violations(rows, rules).collect()} == {"share": 3, "there": 1, "small": 1}
    none = quality.quarantine(rows.where("false"), rules, str(tmp_path / "r"))
    assert none[0].isEmpty() and none[1].isEmpty() and {r.N for r in none[2].collect()} == {0}


@pytest.mark.parametrize("derivative", [0, 1])
def test_polynomial_windows_follow_groups(spark, derivative):
    draw = np.random.default_rng(3)
    groups = {g: draw.normal(size=n) for g, n in (("a", 30), ("b", 21), ("c", 12), ("d", 2))}
    widths = {"a": 21, "b": 9, "c": 21, "d": 5}
    df = spark.createDataFrame([(g, i, float(y), widths[g]) for g, v in groups.items() for i, y in enumerate(v)], "g string, i int, y double, w int")
    for short in ("value", "shrink"):
        out = series.polynomial_filter(df, "y", ["g"], ["i"], "s", F.col("w"), derivative, short=short)
        got = {(r.g, r.i): r.s for r in out.collect()}
        for g, v in groups.items():
            n, w = len(v), widths[g]
            w = min(w, n) - (min(w, n) % 2 == 0) if short == "shrink" else w
            for i in range(n):
                at = max(0, min(i - w // 2, n - w))
                fit = np.polynomial.Polynomial.fit(np.arange(at, at + w), v[at : at + w], 2) if n >= max(w, 3) else None
                want = v[i] if fit is None else (fit.deriv()(i) if derivative else fit(i))
                assert got[g, i] == pytest.approx(want, abs=1e-9), (g, i, short)
    windows = spark.createDataFrame([(a,) for a in (0.01, 0.1, 0.2, 0.25, 0.3, 1.0)], "a double").select(series.alpha_window(F.col("a")).alias("w")).collect()
    assert [r.w for r in windows] == [21, 21, 11, 9, 7, 5]


def test_weighted_means_carry_over_long_gaps(spark):
    values = [1.0, None, 3.0] + [None] * 150 + [0.5, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").withColumn("k", F.lit(1))
    got = [r.e for r in series.ewma(df, "x", ["k"], ["i"], "e", 0.4).orderBy("i").collect()]
    for i in range(len(values)):
        known = [(0.6 ** (i - j), v) for j, v in enumerate(values[: i + 1]) if v is not None]
        assert got[i] == pytest.approx(sum(w * v for w, v in known) / sum(w for w, _ in known), abs=1e-12)


def test_draws_are_those_of_the_spark_hash(spark):
    keys, draws = np.array([0, 5, 2**31 + 7, 123_456_789_012]), np.array([1, 2, 5000])
    rows = spark.createDataFrame([(int(k), int(d)) for k in keys for d in draws], "k bigint, d int").select("k", "d", hashing.mixed(F.col("k"), F.col("d")).alias("h")).collect()
    weights = cohort.draw_weights(keys, draws)
    for r in rows:
        assert weights[list(keys).index(r.k), list(draws).index(r.d)] == sum(r.h >= b for b in cohort.POISSON)
    many = cohort.draw_weights(np.arange(4000), np.arange(1, 200))
    assert abs(many.mean() - 1) < 0.01 and abs(many.var() - 1) < 0.03 and abs(np.corrcoef(many[:, 3], many[:, 4])[0, 1]) < 0.06


def test_draws_take_a_byte_each():
    """A block of draws and its hashes stay in a core's cache."""
    weights = cohort.draw_weights(np.arange(cohort.DRAWN), np.arange(1, 5001))
    assert weights.nbytes == cohort.DRAWN * 5000 and 5 * weights.nbytes <= 2 << 20


def test_bootstrap_moments_are_weighted_sums(spark):
    draw = np.random.default_rng(8)
    x, m, y = draw.normal(size=(3, 1500))
    rows = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, m, y, strict=True))] + [(9999, None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], "k bigint, x double, m double, y double")
    got = {r.DRAW: r for r in cohort.draw_moments(rows.repartition(3), "x", "m", "y", "k", 40).collect()}
    w = cohort.draw_weights(np.arange(1500), np.arange(1, 41))
    for d in (1, 17, 40):
        assert got[d].n == w[:, d - 1].sum() and got[d].sxm == pytest.approx((w[:, d - 1] * x * m).sum()) and got[d].smy == pytest.approx((w[:, d - 1] * m * y).sum())
    assert cohort.mediation_interval(rows.where("false"), "x", "m", "y", "k", 10).first().DRAWS == 0


def test_slots_are_shuffled_and_days_have_no_repeats(spark):
    df = spark.createDataFrame([(p, q, float(q % 7)) for p in (1, 2, 3) for q in range(200, 200 + 4 * p)], "PATIENT_ID bigint, PROTOCOL_ID bigint, SCORE double")
    plans = [{(r.PATIENT_ID, r.PROTOCOL_ID): r.DAYS for r in recommend.slot_schedule(df, seed, n=6, days=5, per_day=3).collect()} for seed in (1, 1, 2)]
    assert plans[0] == plans[1] != plans[2]
    for plan in plans:
        for p, n in ((1, 4), (2, 6), (3, 6)):
            own = {q: d for (a, q), d in plan.items() if a == p}
            assert len(own) == n and all(d == sorted(set(d)) and set(d) <= set(range(5)) for d in own.values())
            assert max(sum(k in d for d in own.values()) for k in range(5)) <= 3 and sum(map(len, own.values())) <= 15
    assert recommend.slot_schedule(df, 1, n=6, days=1, per_day=2).groupBy("PATIENT_ID").count().where("count <> 2").isEmpty()


def test_profiles_move_with_success(spark):
    maxima = [5, 3, 6]
    people = spark.createDataFrame([(1, [4.0, 1.0, 3.0]), (2, [5.0, 3.0, 6.0]), (3, [1.0, 1.0, 1.0])], "PATIENT_ID bigint, SCORES array<double>")
    ratings = spark.createDataFrame([(200, [1.0, 1.0, 2.0]), (201, [0.0, 0.0, 0.0])], "PROTOCOL_ID bigint, RATINGS array<double>")
    success = spark.createDataFrame([(1, 200, 0, 0.5), (1, 200, 1, 0.75), (1, 201, 1, 0.9), (2, 200, 0, 0.4), (2, 200, 1, 0.2)], "PATIENT_ID bigint, PROTOCOL_ID bigint, TIME int, RATE double")
    got = {(r.PATIENT_ID, r.TIME): r for r in profile.updated_profiles(people, success, ratings, maxima, [0, 1]).collect()}
    assert got[1, 0].EMBEDDING == pytest.approx([1 / 6, 2 / 6, 3 / 6]) and got[1, 0].RATIO is None
    assert got[1, 1].RATIO == pytest.approx(1.5) and got[1, 1].SCORES == pytest.approx([5.0, 1.5, 4.5]) and got[1, 1].EMBEDDING == pytest.approx([0, 0.5, 0.5])
    assert got[2, 0].EMBEDDING == [0, 0, 0] and got[2, 1].SCORES == pytest.approx([2.5, 1.5, 3.0])
    assert got[3, 1].RATIO is None and got[3, 1].SCORES == [1, 1, 1]


def test_files_in_order_of_names_hold_keys_in_order(spark, tmp_path):
    draw = np.random.default_rng(4)
    keys = [(int(a), int(b)) for a, b in draw.integers(0, 50, size=(3000, 2))] + [(7, 7)] * 1000
    sinks.write_ordered(spark.createDataFrame(keys, "a int, b int").repartition(5), str(tmp_path / "o"), ["a", "b"], files=6)
    files = sorted((tmp_path / "o").glob("*.parquet"))
    read = [tuple(r) for f in files for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    assert len(files) > 1 and read == sorted(keys)


def test_similarities_beyond_the_broadcast_limit_give_the_same_swaps(spark, monkeypatch):
    draw = np.random.default_rng(6)
    rows = [(p, q, float(draw.normal()), int(draw.integers(0, 3)) if p > 3 else int(draw.integers(1, 3)), int(draw.integers(0, 2)), sorted(set(map(int, draw.integers(0, 7, size=draw.integers(0, 4)))))) for p in range(1, 9) for q in range(200, 212)]
    scores = spark.createDataFrame(rows, "PATIENT_ID bigint, PROTOCOL_ID bigint, SCORE double, USAGE int, USAGE_WEEK int, DAYS array<int>")
    similarity = spark.createDataFrame([(a, b, float(draw.random())) for a in range(200, 212) for b in range(200, 212)], tables.SIMILARITY)
    near = sorted(map(repr, recommend.recommended(scores, similarity).collect()))
    monkeypatch.setattr(recommend, "PAIRS", 10)
    assert sorted(map(repr, recommend.recommended(scores, similarity).collect())) == near


def test_replays_equal_score_tables_of_each_day(spark, loader):
    sessions, people = loader.sessions().where("ERROR is null").drop("ERROR"), loader.patients().where("PATIENT_ID in (7, 8, 14)").drop("CLINICAL_SCORES")
    fits = spark.createDataFrame([(p, q, 0.1 * k + 0.01 * p, [0.1]) for p in (7, 8, 14, 70) for k, q in enumerate(PROTOCOLS)], tables.FITS)
    plain = lambda df: sorted((r.PATIENT_ID, r.PROTOCOL_ID, r.USAGE, r.USAGE_WEEK, tuple(r.DAYS), r.SESSION_INDEX, r.WEEKS_SINCE_START, *(None if x is None else round(x, 9) for x in (r.ADHERENCE_RECENT, r.DELTA_DM, r.SCORE))) for r in df.collect())
    replay = study.scores_at(fits, sessions, people, (3, 7, 9, 21)).cache()
    for day in (3, 7, 9, 21):
        assert plain(replay.where(F.col("DAY") == day)) == plain(study.score_table(fits, sessions, people, F.lit(START + dt.timedelta(days=day))))


def test_runs_deal_sessions_after_the_faulty_are_out(spark, loader):
    """What is dealt are the good patients' sessions, once, and the rows of a run stay what they were."""
    seen = []

    def deal(rows):
        seen.append({r.PATIENT_ID for r in rows.select("PATIENT_ID").distinct().collect()})
        return rows.repartition(13, "PATIENT_ID")

    dealt, before = run(spark, loader, [7, 8, 14], deal=deal), run(spark, loader, [7, 8, 14])
    assert seen == [{7}]
    assert dealt["scores"]._jdf.queryExecution().executedPlan().toString().count(", 13), REPARTITION_BY_NUM") == 1
    assert sorted(map(repr, dealt["metrics"].collect())) == sorted(map(repr, before["metrics"].collect()))
