"""Recommendations for whole cohorts: new schedules, repeats and substitutions, without a loop over patients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restora.constants import ALLOWED_PROTOCOLS, BY_PP, DAYS, PER_DAY, TOP_N
from restora.functions.hashing import mixed


def by_patient():
    return Window.partitionBy("PATIENT_ID")


def allowed(df: DataFrame, columns: list[str], protocols: list[int] | None = None) -> DataFrame:
    """Rows whose protocols are all on the allow-list."""
    for c in columns:
        df = df.where(F.col(c).isin(ALLOWED_PROTOCOLS if protocols is None else protocols))
    return df


def top(df: DataFrame, n: int, keys: list[str], value: str, tie: str, rank: str | None = None, ascending: bool = False) -> DataFrame:
    """The n rows of largest (or smallest) value per key; ties go to the smaller `tie`."""
    by = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    out = df.withColumn(rank or "__r", F.row_number().over(Window.partitionBy(*keys).orderBy(by, F.col(tie)))).where(F.col(rank or "__r") <= n)
    return out if rank else out.drop("__r")


def prescriptions(scores: DataFrame) -> DataFrame:
    """Rows that have days this week."""
    return scores.where(F.col("DAYS").isNotNull() & (F.size("DAYS") > 0))


def week_states(scores: DataFrame) -> DataFrame:
    """PATIENT_ID, HAS_PLAN, WEEK_SKIPPED (nothing of the plan was used) and PARTLY_SKIPPED (no prescription was used as often as planned)."""
    planned = F.size(F.coalesce("DAYS", F.array().cast("array<int>"))) > 0
    return scores.groupBy("PATIENT_ID").agg(
        F.bool_or(planned).alias("HAS_PLAN"),
        F.coalesce(F.bool_and(F.when(planned, F.col("USAGE_WEEK") == 0)), F.lit(False)).alias("WEEK_SKIPPED"),
        (~F.coalesce(F.bool_or(F.when(planned, F.col("USAGE_WEEK") >= F.size("DAYS"))), F.lit(False))).alias("PARTLY_SKIPPED"),
    )


def schedule_days(rank: Column, n: Column, days: int = DAYS, per_day: int = PER_DAY) -> Column:
    """Sorted days of the protocol of 0-based rank among n, when slots are dealt round robin."""
    return F.array_sort(F.array_distinct(F.transform(F.sequence(rank, F.lit(days * per_day - 1), n), lambda i: (i % days).cast("int"))))


def new_schedule(scores: DataFrame, n: int = TOP_N, days: int = DAYS, per_day: int = PER_DAY) -> DataFrame:
    """The top n protocols of each patient, each with its DAYS."""
    best = top(scores, n, ["PATIENT_ID"], "SCORE", "PROTOCOL_ID", "__r")
    rank, many = F.col("__r") - 1, F.count(F.lit(1)).over(by_patient()).cast("int")
    rows = best.withColumn("__n", many).where(rank < days * per_day)
    return rows.withColumn("DAYS", schedule_days(rank, F.col("__n"), days, per_day)).drop("__r", "__n")


def swaps(scores: DataFrame) -> DataFrame:
    """Prescriptions below the patient's mean score; the lowest one where none is below."""
    own = prescriptions(scores).withColumn("__low", F.col("SCORE") < F.avg("SCORE").over(by_patient()))
    own = own.withColumn("__any", F.bool_or("__low").over(by_patient())).withColumn("__r", F.row_number().over(by_patient().orderBy("SCORE", "PROTOCOL_ID")))
    return own.where(F.col("__low") | (~F.col("__any") & (F.col("__r") == 1))).drop("__low", "__any", "__r")


#: Pairs of protocols up to which all similarities go to every task; beyond, each patient gets those of the protocols to be swapped.
PAIRS = 40_000


def _by_patient(scores: DataFrame) -> DataFrame:
    """One row per patient: ROWS (the patient's scores, by protocol) and PLAN (those with days)."""
    rest = [c for c in scores.columns if c not in BY_PP]
    rows = scores.groupBy("PATIENT_ID").agg(F.array_sort(F.collect_list(F.struct("PROTOCOL_ID", *rest))).alias("ROWS"))  # as many as protocols
    return rows.withColumn("PLAN", F.filter("ROWS", lambda r: F.coalesce(F.size(r["DAYS"]) > 0, F.lit(False))))


def _with_near(rows: DataFrame, similarity: DataFrame, most: int | None = None) -> DataFrame:
    """rows (PATIENT_ID, LOW) with NEAR, the protocols most similar to each of LOW (`most` of them)."""
    each = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("SIMILARITY")).alias("s"), F.col("PROTOCOL_B").alias("b")))), lambda x: x["b"])
    near = similarity.where("PROTOCOL_A <> PROTOCOL_B").groupBy(F.col("PROTOCOL_A").alias("OLD")).agg((each if most is None else F.slice(each, 1, most)).alias("NEAR"))
    as_map = F.map_from_entries(F.collect_list(F.struct("OLD", "NEAR"))).alias("NEAR")
    if similarity.limit(PAIRS + 1).count() <= PAIRS:
        return rows.join(F.broadcast(near.agg(as_map)))  # one row of PAIRS numbers at most
    wanted = rows.select("PATIENT_ID", F.explode("LOW").alias("OLD")).join(near, "OLD").groupBy("PATIENT_ID").agg(as_map)
    return rows.join(wanted, "PATIENT_ID", "left").withColumn("NEAR", F.coalesce("NEAR", F.create_map().cast("map<bigint,array<bigint>>")))


def _decided(scores: DataFrame, similarity: DataFrame, top_similar: int) -> DataFrame:
    """One row per patient: ROWS, PLAN, BRANCH, and SWAPS (OLD, NEW), chosen one after another."""
    rows = _by_patient(scores)
    mean = F.aggregate("PLAN", F.lit(0.0), lambda a, r: a + r["SCORE"]) / F.size("PLAN")
    low = F.transform(F.filter("PLAN", lambda r: r["SCORE"] < mean), lambda r: r["PROTOCOL_ID"])
    least_ = F.array_min(F.transform("PLAN", lambda r: F.struct(r["SCORE"].alias("s"), r["PROTOCOL_ID"].alias("p"))))["p"]
    none = F.array().cast("array<bigint>")
    idle = F.forall("PLAN", lambda r: F.coalesce(r["USAGE_WEEK"] == 0, F.lit(True))) & F.exists("PLAN", lambda r: r["USAGE_WEEK"].isNotNull())
    use_of = F.map_from_entries(F.transform("ROWS", lambda r: F.struct(r["PROTOCOL_ID"].alias("p"), F.coalesce(r["USAGE"], F.lit(0)).cast("bigint").alias("u"))))
    rows = rows.withColumns({
        "LOW": F.when(F.size("PLAN") == 0, none).when(F.size(low) > 0, low).otherwise(F.array(least_)),
        "BRANCH": F.when(F.size("PLAN") == 0, "new").when(idle, "repeat").otherwise("update"),
        "USES": use_of, "FREE": F.exists("ROWS", lambda r: F.coalesce(r["USAGE"], F.lit(0)) == 0),
    })
    rows = _with_near(rows, similarity)

    def use(b):
        return F.try_element_at("USES", b)

    def step(acc, old):
        open_ = F.filter(F.coalesce(F.try_element_at("NEAR", old), none), lambda b: ~F.array_contains(acc["taken"], b))
        unused = F.get(F.filter(open_, lambda b: F.coalesce(use(b) == 0, F.lit(False))), F.lit(0))
        close = F.filter(F.slice(open_, 1, top_similar), lambda b: use(b).isNotNull())
        least = F.array_min(F.transform(close, use))
        rare = F.get(F.filter(close, lambda b: use(b) == least), F.lit(0))
        new = F.coalesce(F.when(F.col("FREE"), unused).otherwise(rare), old)
        return F.struct(F.array_append(acc["taken"], new).alias("taken"), F.array_append(acc["out"], F.struct(old.alias("OLD"), new.alias("NEW"))).alias("out"))

    start = F.struct(F.transform("PLAN", lambda r: r["PROTOCOL_ID"]).alias("taken"), F.array().cast("array<struct<OLD:bigint,NEW:bigint>>").alias("out"))
    return rows.withColumn("SWAPS", F.aggregate("LOW", start, step)["out"])


def substitutions(scores: DataFrame, similarity: DataFrame, top_similar: int = 5) -> DataFrame:
    """PATIENT_ID, OLD and NEW of every swap, chosen one after another in order of PROTOCOL_ID.

    Left out are the patient's prescriptions and substitutes chosen before.  If the patient has protocols
    without use, the most similar of them is taken, and none if all those are left out; otherwise the most
    similar of the least used among the top_similar.  Without a choice the protocol stays.
    """
    return _decided(scores, similarity, top_similar).select("PATIENT_ID", F.inline("SWAPS"))


def recommended(scores: DataFrame, similarity: DataFrame, n: int = TOP_N, days: int = DAYS, per_day: int = PER_DAY, top_similar: int = 5) -> DataFrame:
    """Next week's rows of all patients, with BRANCH new, repeat or update; a substitute takes over the days.

    Scores are grouped by patient once, and everything is decided inside the group.
    """
    rows = _decided(scores, similarity, top_similar)
    row_of = lambda p: F.get(F.filter("ROWS", lambda r: r["PROTOCOL_ID"] == p), F.lit(0))
    given = lambda r, d: F.struct(r.alias("r"), d.cast("array<int>").alias("d"))
    best = F.slice(F.array_sort(F.transform("ROWS", lambda r: F.struct(F.coalesce(-r["SCORE"], F.lit(float("inf"))).alias("s"), r["PROTOCOL_ID"].alias("p"), r.alias("r")))), 1, min(n, days * per_day))
    many = F.least(F.size("ROWS"), F.lit(n))
    new = F.transform(best, lambda x, i: given(x["r"], schedule_days(i, many, days, per_day)))
    kept = F.transform("PLAN", lambda r: given(r, r["DAYS"]))
    stay = F.filter(kept, lambda x: ~F.array_contains("LOW", x["r"]["PROTOCOL_ID"]))
    changed = F.transform("SWAPS", lambda x: given(row_of(x["NEW"]), row_of(x["OLD"])["DAYS"]))
    chosen = F.when(F.col("BRANCH") == "new", new).when(F.col("BRANCH") == "repeat", kept).otherwise(F.concat(stay, changed))
    out = rows.select("PATIENT_ID", "BRANCH", F.explode(chosen).alias("x"))
    return out.select(*[F.col("x.d").alias(c) if c == "DAYS" else F.col(c) if c == "PATIENT_ID" else F.col(f"x.r.{c}").alias(c) for c in scores.columns], "BRANCH")


def patient_status(requested: DataFrame, scores: DataFrame) -> DataFrame:
    """PATIENT_ID and STATUS: failed for requested patients without scores, else ok."""
    known = scores.select("PATIENT_ID").distinct().withColumn("__k", F.lit(True))
    return requested.select("PATIENT_ID").distinct().join(known, "PATIENT_ID", "left").select("PATIENT_ID", F.when(F.col("__k"), "ok").otherwise("failed").alias("STATUS"))


def shuffled_schedule(scores: DataFrame, seed: int, n: int = TOP_N, days: int = DAYS, per_day: int = PER_DAY) -> DataFrame:
    """As new_schedule, with the top n in an order that depends on the seed."""
    best = top(scores, n, ["PATIENT_ID"], "SCORE", "PROTOCOL_ID")
    dealt = best.withColumn("__r", F.row_number().over(by_patient().orderBy(mixed(F.col("PATIENT_ID"), F.col("PROTOCOL_ID"), seed), "PROTOCOL_ID")) - 1)
    dealt = dealt.withColumn("__n", F.count(F.lit(1)).over(by_patient()).cast("int")).where(F.col("__r") < days * per_day)
    return dealt.withColumn("DAYS", schedule_days(F.col("__r"), F.col("__n"), days, per_day)).drop("__r", "__n")


def slot_schedule(scores: DataFrame, seed: int, n: int = TOP_N, days: int = DAYS, per_day: int = PER_DAY) -> DataFrame:
    """The top n protocols of each patient with DAYS, from slots in an order that depends on the seed.

    The days x per_day slots are filled with the protocols in turn, shuffled, and dealt to the days one after another; a
    protocol that comes to a day a second time is dropped there, so days may hold fewer than per_day.
    """
    best = top(scores, n, ["PATIENT_ID"], "SCORE", "PROTOCOL_ID", "__r")
    best = best.withColumn("__n", F.count(F.lit(1)).over(by_patient()).cast("int"))
    turns = F.when(F.col("__r") <= days * per_day, F.sequence(F.col("__r") - 1, F.lit(days * per_day - 1), F.col("__n")))
    slots = best.select("PATIENT_ID", "PROTOCOL_ID", F.explode(turns).alias("SLOT"))  # as many as slots in a week
    order = Window.partitionBy("PATIENT_ID").orderBy(mixed(F.col("PATIENT_ID"), F.col("SLOT"), seed), "SLOT")
    dealt = slots.withColumn("DAY", ((F.row_number().over(order) - 1) % days).cast("int"))
    plan = dealt.groupBy(*BY_PP).agg(F.array_sort(F.collect_set("DAY")).alias("DAYS"))
    return best.drop("__r", "__n", "DAYS").join(plan, BY_PP)


def upper_quantile(scores: DataFrame, q: float = 0.85) -> DataFrame:
    """Rows above the patient's quantile of SCORE."""
    return scores.withColumn("__q", F.percentile("SCORE", F.lit(q)).over(by_patient())).where("SCORE > __q").drop("__q")


def swapped_below_quantile(scores: DataFrame, similarity: DataFrame, q: float = 0.85, top_similar: int = 5) -> DataFrame:
    """PATIENT_ID, OLD, NEW: prescriptions outside the upper quantile, with the least used of the most similar that is not prescribed.

    Decided inside one grouping of the scores; a patient's rows are as many as protocols.
    """
    rows = _by_patient(scores.select(*BY_PP, "SCORE", "USAGE", "DAYS"))
    known = F.array_sort(F.filter(F.transform("ROWS", lambda r: r["SCORE"]), lambda x: x.isNotNull()))
    rows = rows.withColumn("__k", known).withColumn("__at", (F.size("__k") - 1) * F.lit(q))
    low, high = (F.get("__k", f("__at").cast("int")) for f in (F.floor, F.ceil))
    rows = rows.withColumn("__q", low + (F.col("__at") - F.floor("__at")) * (high - low))
    old = F.transform(F.filter("PLAN", lambda r: ~F.coalesce(r["SCORE"] > F.col("__q"), F.lit(False))), lambda r: r["PROTOCOL_ID"])
    free = F.map_from_entries(F.transform(F.filter("ROWS", lambda r: ~F.coalesce(F.size(r["DAYS"]) > 0, F.lit(False))), lambda r: F.struct(r["PROTOCOL_ID"].alias("p"), F.struct(r["USAGE"].alias("u")))))
    rows = _with_near(rows.withColumns({"LOW": old, "FREE": free}).select("PATIENT_ID", "LOW", "FREE"), similarity, top_similar)
    swap = rows.select("PATIENT_ID", "FREE", "NEAR", F.explode("LOW").alias("OLD"))
    open_ = F.filter(F.try_element_at("NEAR", F.col("OLD")), lambda b: F.try_element_at("FREE", b).isNotNull())
    best = F.array_min(F.transform(open_, lambda b: F.struct(F.try_element_at("FREE", b)["u"].alias("u"), b.alias("b"))))["b"]
    return swap.select("PATIENT_ID", "OLD", best.alias("NEW")).where("NEW is not null")


def day_counts(recommendations: DataFrame) -> DataFrame:
    """Protocols of each patient on each day."""
    return recommendations.select("PATIENT_ID", F.explode("DAYS").alias("DAY")).groupBy("PATIENT_ID", "DAY").agg(F.count("*").alias("N"))


def broken_schedules(recommendations: DataFrame, days: int = DAYS, per_day: int = PER_DAY) -> DataFrame:
    """Patients whose schedule leaves a day empty or puts more than per_day on one."""
    return day_counts(recommendations).groupBy("PATIENT_ID").agg(F.count("*").alias("FILLED"), F.max("N").alias("MOST")).where((F.col("FILLED") < days) | (F.col("MOST") > per_day))
