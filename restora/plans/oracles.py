"""Parts of the DuckDB SQL that the registered queries are compared with."""

from restora.functions.hashing import FACTORS, MASK


def mixed(a: str, b: str = "0", seed: int = 0) -> str:
    """functions.hashing.mixed, for a and b from 0."""
    h = f"((({a}) % {1 << 31} * {FACTORS[0]} + CAST({b} AS BIGINT) * {FACTORS[1]} + {seed}) & {MASK})"
    h = f"(xor({h}, {h} >> 15) * {FACTORS[2]} & {MASK})"
    h = f"(xor({h}, {h} >> 13) * {FACTORS[3]} & {MASK})"
    return f"xor({h}, {h} >> 16)"


_EV = """ev AS (SELECT event_id, ts, CAST(ts AS DATE) AS SESSION_DATE, CAST(user_id + 1 AS BIGINT) AS PATIENT_ID, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS kind,
  CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) % 7 AS INT) AS WEEKDAY_INDEX FROM events)"""


def _sessions(name: str, protocol: str) -> str:
    return f"""{name}_0 AS (SELECT PATIENT_ID, CAST({protocol} AS BIGINT) AS PROTOCOL_ID, CASE WHEN k % 10 = 0 THEN NULL ELSE event_id END AS SESSION_ID, SESSION_DATE, WEEKDAY_INDEX,
  CASE WHEN k % 10 = 0 THEN 'NOT_PERFORMED' ELSE 'CLOSED' END AS STATUS, CASE WHEN k % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE k / CAST(100 AS DOUBLE) END AS ADHERENCE,
  CASE WHEN k % 10 = 0 THEN NULL ELSE value / CAST(600 AS DOUBLE) END AS DM_VALUE, event_id FROM ev),
{name} AS (SELECT *, PATIENT_ID * 1000 + (PROTOCOL_ID - 200) * 10 + WEEKDAY_INDEX AS PRESCRIPTION_ID,
  min(SESSION_DATE) OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID, WEEKDAY_INDEX) AS PRESCRIPTION_STARTING_DATE, DATE '2100-01-01' AS PRESCRIPTION_ENDING_DATE FROM {name}_0)"""


SESSIONS = _EV + ",\n" + _sessions("s25", "200 + 5 * kind + k % 5") + ",\n" + _sessions("s5", "200 + kind")
PATIENTS = "pat AS (SELECT PATIENT_ID, min(SESSION_DATE) AS CLINICAL_TRIAL_START_DATE, DATE '2024-03-01' AS CLINICAL_TRIAL_END_DATE FROM ev GROUP BY PATIENT_ID)"
BASE = SESSIONS + ",\n" + PATIENTS + ",\nstud AS (SELECT PATIENT_ID, arg_min(kind, event_id) AS STUDY_ID FROM ev GROUP BY PATIENT_ID)"
DAY = "DATE '2024-01-29'"

VECTORS = """vecs AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
units AS (SELECT vec_id, list_transform(v, lambda x: x / (CASE WHEN list_sum(list_transform(v, lambda y: y * y)) = 0 THEN 1e-10 ELSE sqrt(list_sum(list_transform(v, lambda y: y * y))) END)) AS u FROM vecs),
fits AS (SELECT CAST(p.vec_id - 24 AS BIGINT) AS PATIENT_ID, CAST(q.vec_id + 200 AS BIGINT) AS PROTOCOL_ID, list_dot_product(p.u, q.u) AS PPF FROM units p, units q WHERE p.vec_id >= 25 AND q.vec_id < 25)"""

SIMILARITY = """dims AS (SELECT CAST(vec_id + 200 AS BIGINT) AS PROTOCOL_ID, unnest(range(1, 65)) AS f, unnest(v) AS x FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) WHERE vec_id < 25),
spans AS (SELECT f, max(x) - min(x) AS r FROM dims GROUP BY f),
sim AS (SELECT a.PROTOCOL_ID AS PROTOCOL_A, b.PROTOCOL_ID AS PROTOCOL_B, 1 - sum(CASE WHEN r > 0 THEN abs(a.x - b.x) / r ELSE 0 END) / count(*) AS SIMILARITY FROM dims a JOIN dims b USING (f) JOIN spans USING (f) GROUP BY 1, 2)"""


def expanded(source: str) -> str:
    """ex: dated sessions and missing ones; tr: those in the trial."""
    return f"""lastd AS (SELECT PATIENT_ID, max(SESSION_DATE) AS LAST_DATE FROM {source} GROUP BY PATIENT_ID),
presc AS (SELECT DISTINCT PRESCRIPTION_ID, PATIENT_ID, PROTOCOL_ID, PRESCRIPTION_STARTING_DATE AS sd, PRESCRIPTION_ENDING_DATE AS ed, WEEKDAY_INDEX FROM {source}),
wanted AS (SELECT PRESCRIPTION_ID, PATIENT_ID, PROTOCOL_ID, sd, ed, WEEKDAY_INDEX, CAST(unnest(generate_series(sd + CAST(((WEEKDAY_INDEX - (isodow(sd) - 1)) % 7 + 7) % 7 AS INT), least(ed, LAST_DATE), INTERVAL 7 DAY)) AS DATE) AS SESSION_DATE FROM presc JOIN lastd USING (PATIENT_ID)),
lacking AS (SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM {source} s WHERE s.PRESCRIPTION_ID = w.PRESCRIPTION_ID AND s.SESSION_DATE = w.SESSION_DATE)),
ex AS (SELECT PATIENT_ID, PROTOCOL_ID, PRESCRIPTION_ID, SESSION_ID, SESSION_DATE, WEEKDAY_INDEX, STATUS, ADHERENCE, DM_VALUE FROM {source} UNION ALL
  SELECT PATIENT_ID, PROTOCOL_ID, PRESCRIPTION_ID, NULL, SESSION_DATE, WEEKDAY_INDEX, 'NOT_PERFORMED', CAST(0 AS DOUBLE), NULL FROM lacking),
tr AS (SELECT ex.* FROM ex JOIN pat USING (PATIENT_ID) WHERE SESSION_DATE >= CLINICAL_TRIAL_START_DATE AND SESSION_DATE <= least(CLINICAL_TRIAL_END_DATE, {DAY}))"""


def adherence(source: str) -> str:
    """adh: SESSION_INDEX and ADHERENCE_RECENT of every row of source."""
    return f"""blank AS (SELECT *, CASE WHEN bool_and(coalesce(STATUS = 'NOT_PERFORMED', false)) OVER (PARTITION BY PATIENT_ID, SESSION_DATE) THEN NULL ELSE ADHERENCE END AS A FROM {source}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY SESSION_DATE, WEEKDAY_INDEX, PRESCRIPTION_ID, SESSION_ID NULLS FIRST) AS SESSION_INDEX FROM blank),
adh AS (SELECT t.PATIENT_ID, t.PROTOCOL_ID, t.SESSION_INDEX, any_value(t.SESSION_DATE) AS SESSION_DATE, any_value(t.STATUS) AS STATUS, sum(pow(0.5, t.SESSION_INDEX - i.SESSION_INDEX) * i.A) / sum(CASE WHEN i.A IS NOT NULL THEN pow(0.5, t.SESSION_INDEX - i.SESSION_INDEX) END) AS ADHERENCE_RECENT
  FROM numbered t JOIN numbered i ON i.PATIENT_ID = t.PATIENT_ID AND i.PROTOCOL_ID = t.PROTOCOL_ID AND i.SESSION_INDEX <= t.SESSION_INDEX GROUP BY t.PATIENT_ID, t.PROTOCOL_ID, t.SESSION_INDEX)"""


_W3 = "[[1.0,0,0],[0,1.0,0],[0,0,1.0]]"
_W5 = "[[31.0,9,-3,-5,3],[9,13,12,6,-5],[-3,12,17,12,-3],[-5,6,12,13,9],[3,-5,-3,9,31]]"
_W7 = "[[32.0,15,3,-4,-6,-3,5],[15,12,9,6,3,0,-3],[3,9,12,12,9,3,-6],[-4,6,12,14,12,6,-4],[-6,3,9,12,12,9,3],[-3,0,3,6,9,12,15],[5,-3,-6,-4,3,15,32]]"


def progress(source: str) -> str:
    """sm: DM_INDEX and DM_SMOOTH; del: and DELTA_DM of rows of source with a difficulty value."""
    return f"""dm AS (SELECT PATIENT_ID, PROTOCOL_ID, SESSION_ID, SESSION_DATE, DM_VALUE, row_number() OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY SESSION_DATE, SESSION_ID) AS DM_INDEX, count(*) OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID) AS n FROM {source} WHERE SESSION_ID IS NOT NULL AND DM_VALUE IS NOT NULL),
dl AS (SELECT PATIENT_ID, PROTOCOL_ID, list(DM_VALUE ORDER BY DM_INDEX) AS vs FROM dm GROUP BY 1, 2),
dw AS (SELECT dm.*, vs, CASE WHEN n >= 7 THEN 7 WHEN n >= 5 THEN 5 ELSE 3 END AS w FROM dm JOIN dl USING (PATIENT_ID, PROTOCOL_ID)),
dp AS (SELECT *, greatest(0, least(DM_INDEX - 1 - w // 2, n - w)) AS st FROM dw),
sm AS (SELECT PATIENT_ID, PROTOCOL_ID, SESSION_DATE, DM_INDEX, CASE WHEN n < 3 THEN DM_VALUE
  WHEN w = 3 THEN list_dot_product(vs[st + 1 : st + 3], CAST(({_W3})[DM_INDEX - st] AS DOUBLE[])) WHEN w = 5 THEN list_dot_product(vs[st + 1 : st + 5], CAST(({_W5})[DM_INDEX - st] AS DOUBLE[])) / 35
  ELSE list_dot_product(vs[st + 1 : st + 7], CAST(({_W7})[DM_INDEX - st] AS DOUBLE[])) / 42 END AS DM_SMOOTH FROM dp),
sl AS (SELECT t.PATIENT_ID, t.PROTOCOL_ID, t.DM_INDEX, median((b.DM_SMOOTH - a.DM_SMOOTH) / (b.DM_INDEX - a.DM_INDEX)) AS s FROM sm t JOIN sm a ON a.PATIENT_ID = t.PATIENT_ID AND a.PROTOCOL_ID = t.PROTOCOL_ID AND a.DM_INDEX BETWEEN t.DM_INDEX - 6 AND t.DM_INDEX
  JOIN sm b ON b.PATIENT_ID = t.PATIENT_ID AND b.PROTOCOL_ID = t.PROTOCOL_ID AND b.DM_INDEX > a.DM_INDEX AND b.DM_INDEX <= t.DM_INDEX GROUP BY 1, 2, 3),
del AS (SELECT sm.*, coalesce(s, 0) AS DELTA_DM FROM sm LEFT JOIN sl USING (PATIENT_ID, PROTOCOL_ID, DM_INDEX))"""


def weeks(source: str) -> str:
    """us, wk, wu: usage, weeks since start, usage and days of the last completed week."""
    return f"""us AS (SELECT PATIENT_ID, PROTOCOL_ID, count(DISTINCT SESSION_ID) AS USAGE FROM {source} GROUP BY 1, 2),
wk AS (SELECT PATIENT_ID, CAST(floor(datediff('day', CLINICAL_TRIAL_START_DATE, {DAY}) / 7) AS INT) AS WEEKS_SINCE_START, CLINICAL_TRIAL_START_DATE AS st FROM pat),
lw AS (SELECT PATIENT_ID, st + (WEEKS_SINCE_START - 1) * 7 AS WEEK_START, st + WEEKS_SINCE_START * 7 AS WEEK_END FROM wk WHERE WEEKS_SINCE_START > 0),
wu AS (SELECT PATIENT_ID, PROTOCOL_ID, count(DISTINCT SESSION_ID) AS USAGE_WEEK, list_sort(list(DISTINCT WEEKDAY_INDEX)) AS DAYS FROM {source} JOIN lw USING (PATIENT_ID) WHERE SESSION_DATE >= WEEK_START AND SESSION_DATE < WEEK_END GROUP BY 1, 2)"""


#: sc: the score table of the 25-protocol study.
SCORES = f"""{BASE},
{VECTORS},
{expanded("s25")},
{adherence("tr")},
{progress("tr")},
{weeks("tr")},
sf AS (SELECT adh.*, del.DM_INDEX, DELTA_DM FROM adh LEFT JOIN del USING (PATIENT_ID, PROTOCOL_ID, SESSION_DATE)),
ft AS (SELECT PATIENT_ID, PROTOCOL_ID, PPF, SESSION_DATE, SESSION_INDEX, DM_INDEX, ADHERENCE_RECENT, DELTA_DM FROM fits LEFT JOIN sf USING (PATIENT_ID, PROTOCOL_ID)),
o AS (SELECT *, row_number() OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY SESSION_DATE, SESSION_INDEX, DM_INDEX NULLS FIRST) AS seq, row_number() OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY SESSION_INDEX, DM_INDEX NULLS FIRST) AS up, row_number() OVER (PARTITION BY PATIENT_ID, PROTOCOL_ID ORDER BY SESSION_INDEX DESC, DM_INDEX DESC NULLS LAST) AS down FROM ft),
lastv AS (SELECT PATIENT_ID, PROTOCOL_ID, any_value(PPF) AS PPF, arg_max(ADHERENCE_RECENT, seq) FILTER (ADHERENCE_RECENT IS NOT NULL) AS A, arg_max(DELTA_DM, seq) FILTER (DELTA_DM IS NOT NULL) AS D, max(SESSION_INDEX) AS SI FROM o GROUP BY 1, 2),
md AS (SELECT PATIENT_ID, median(DELTA_DM) AS m FROM o WHERE up = 2 AND SESSION_INDEX IS NOT NULL AND DELTA_DM IS NOT NULL GROUP BY 1),
ma AS (SELECT PATIENT_ID, median(ADHERENCE_RECENT) AS m FROM o WHERE down = 1 AND SESSION_INDEX IS NOT NULL AND ADHERENCE_RECENT IS NOT NULL GROUP BY 1),
sc AS (SELECT lastv.PATIENT_ID, lastv.PROTOCOL_ID, PPF, coalesce(A, ma.m) AS ADHERENCE_RECENT, coalesce(D, md.m) AS DELTA_DM, coalesce(WEEKS_SINCE_START, 0) AS WEEKS_SINCE_START, coalesce(SI, 0) AS SESSION_INDEX, coalesce(USAGE, 0) AS USAGE, coalesce(USAGE_WEEK, 0) AS USAGE_WEEK, coalesce(DAYS, []) AS DAYS,
  coalesce(A, ma.m, 0) + coalesce(D, md.m, 0) + coalesce(PPF, 0) AS SCORE FROM lastv LEFT JOIN md USING (PATIENT_ID) LEFT JOIN ma USING (PATIENT_ID) LEFT JOIN us USING (PATIENT_ID, PROTOCOL_ID) LEFT JOIN wu USING (PATIENT_ID, PROTOCOL_ID) LEFT JOIN wk USING (PATIENT_ID))"""


#: sw: the prescriptions to be swapped.
SWAPS = """plan AS (SELECT *, SCORE < avg(SCORE) OVER (PARTITION BY PATIENT_ID) AS low, row_number() OVER (PARTITION BY PATIENT_ID ORDER BY SCORE, PROTOCOL_ID) AS k FROM sc WHERE len(DAYS) > 0),
plan2 AS (SELECT *, bool_or(low) OVER (PARTITION BY PATIENT_ID) AS anylow FROM plan), sw AS (SELECT PATIENT_ID, PROTOCOL_ID FROM plan2 WHERE low OR (NOT anylow AND k = 1))"""

#: chain: the substitutions of each patient, one after another; the statement that holds it must say WITH RECURSIVE.
CHAIN = f"""{SWAPS},
nears AS (SELECT PROTOCOL_A AS OLD, list(PROTOCOL_B ORDER BY SIMILARITY DESC, PROTOCOL_B) AS NEAR FROM sim WHERE PROTOCOL_A <> PROTOCOL_B GROUP BY 1),
own AS (SELECT PATIENT_ID, list(PROTOCOL_ID ORDER BY PROTOCOL_ID) AS PS, list(USAGE ORDER BY PROTOCOL_ID) AS US, coalesce(list(PROTOCOL_ID) FILTER (len(DAYS) > 0), []) AS PLANNED, bool_or(USAGE = 0) AS FREE FROM sc GROUP BY 1),
st AS (SELECT sw.PATIENT_ID, PROTOCOL_ID AS OLD, row_number() OVER (PARTITION BY sw.PATIENT_ID ORDER BY PROTOCOL_ID) AS k, coalesce(NEAR, []) AS NEAR, PS, US, FREE FROM sw LEFT JOIN nears ON OLD = PROTOCOL_ID JOIN own ON own.PATIENT_ID = sw.PATIENT_ID),
chain AS (SELECT PATIENT_ID, CAST(0 AS BIGINT) AS k, PLANNED AS taken, CAST(NULL AS BIGINT) AS OLD, CAST(NULL AS BIGINT) AS NEW FROM own UNION ALL
  SELECT PATIENT_ID, k, list_append(taken, NEW), OLD, NEW FROM (
    SELECT *, coalesce(CASE WHEN FREE THEN list_filter(opn, lambda b: list_contains(PS, b) AND US[list_position(PS, b)] = 0)[1] ELSE list_filter(close, lambda b: US[list_position(PS, b)] = least_used)[1] END, OLD) AS NEW FROM (
      SELECT *, list_min(list_transform(close, lambda b: US[list_position(PS, b)])) AS least_used FROM (
        SELECT *, list_filter(opn[1:5], lambda b: list_contains(PS, b)) AS close FROM (
          SELECT r.PATIENT_ID, st.k, r.taken, st.OLD, PS, US, FREE, list_filter(NEAR, lambda b: NOT list_contains(r.taken, b)) AS opn FROM chain r JOIN st ON st.PATIENT_ID = r.PATIENT_ID AND st.k = r.k + 1)))))"""

#: rec: next week's rows of all patients.
RECOMMENDED = f"""{CHAIN},
states AS (SELECT PATIENT_ID, bool_or(len(DAYS) > 0) AS has_plan, coalesce(bool_and(USAGE_WEEK = 0) FILTER (len(DAYS) > 0), false) AS skipped FROM sc GROUP BY 1),
named AS (SELECT sc.*, CASE WHEN NOT has_plan THEN 'new' WHEN skipped THEN 'repeat' ELSE 'update' END AS BRANCH FROM sc JOIN states USING (PATIENT_ID)),
fresh AS (SELECT *, row_number() OVER (PARTITION BY PATIENT_ID ORDER BY SCORE DESC NULLS LAST, PROTOCOL_ID) - 1 AS rk, least(12, count(*) OVER (PARTITION BY PATIENT_ID)) AS n FROM named WHERE BRANCH = 'new'),
rec AS (SELECT PATIENT_ID, PROTOCOL_ID, BRANCH, SCORE, list_sort(list_distinct(list_transform(range(rk, 35, n), lambda i: CAST(i % 7 AS INT)))) AS DAYS FROM fresh WHERE rk < n
  UNION ALL SELECT PATIENT_ID, PROTOCOL_ID, BRANCH, SCORE, DAYS FROM named WHERE BRANCH = 'repeat' AND len(DAYS) > 0
  UNION ALL SELECT PATIENT_ID, PROTOCOL_ID, BRANCH, SCORE, DAYS FROM named WHERE BRANCH = 'update' AND len(DAYS) > 0 AND NOT EXISTS (SELECT 1 FROM sw WHERE sw.PATIENT_ID = named.PATIENT_ID AND sw.PROTOCOL_ID = named.PROTOCOL_ID)
  UNION ALL SELECT named.PATIENT_ID, named.PROTOCOL_ID, named.BRANCH, named.SCORE, o.DAYS FROM chain JOIN named ON named.PATIENT_ID = chain.PATIENT_ID AND named.PROTOCOL_ID = chain.NEW JOIN sc o ON o.PATIENT_ID = chain.PATIENT_ID AND o.PROTOCOL_ID = chain.OLD WHERE named.BRANCH = 'update')"""


def allowed_only(statement: str, protocols: list[int]) -> str:
    """The statement, where sessions, fits and similarities are those of the allowed protocols."""
    names = "(" + ", ".join(map(str, protocols)) + ")"
    statement = statement.replace("FROM s25_0)", f"FROM s25_0 WHERE PROTOCOL_ID IN {names})").replace("sim AS (", "sim_all AS (")
    statement = statement.replace("fits AS (", "fits_all AS (").replace(f",\n{expanded('s25')}", f",\nfits AS (SELECT * FROM fits_all WHERE PROTOCOL_ID IN {names}),\n{expanded('s25')}")
    return statement.replace(f",\n{SWAPS}", f",\nsim AS (SELECT * FROM sim_all WHERE PROTOCOL_A IN {names} AND PROTOCOL_B IN {names}),\n{SWAPS}")


#: staged and measured: what a run writes of rec.
STAGED = """staged AS (SELECT PATIENT_ID, PROTOCOL_ID, st + 7 * WEEKS_SINCE_START AS STARTING_DATE, st + 7 * WEEKS_SINCE_START + 7 AS ENDING_DATE, CAST(WEEKDAY AS INT) AS WEEKDAY FROM (SELECT PATIENT_ID, PROTOCOL_ID, unnest(CASE WHEN len(DAYS) = 0 THEN [NULL] ELSE DAYS END) AS WEEKDAY FROM rec) JOIN wk USING (PATIENT_ID))"""


def measured(names: tuple[str, ...]) -> str:
    return "measured AS (" + " UNION ALL ".join(f"SELECT PATIENT_ID, PROTOCOL_ID, '{m}' AS KEY, CAST(sc.{m} AS DOUBLE) AS VALUE FROM rec JOIN sc USING (PATIENT_ID, PROTOCOL_ID)" for m in names) + ")"
