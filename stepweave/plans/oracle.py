"""The query catalogue again, as plain ANSI-style SQL for an independent check.

Each query lists the common table expressions it needs; they follow the
definitions literally (range joins, enumerated steps, all pairs) instead of the
rewrites the operators use.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
SQL: dict[str, str] = {}


def _r(expr: str, name: str | None = None) -> str:
    return f"round({expr} + 1e-9, 6) + 0.0 AS {name or expr}"


def _clip(expr: str, low: float, high: float) -> str:
    return f"CASE WHEN ({expr}) IS NULL THEN NULL ELSE least(greatest({expr}, {low}), {high}) END"


# --- cohort

CTES["cohort_base"] = """
SELECT o.o_custkey AS subject_id, o.o_orderkey AS hadm_id, o.o_orderkey AS stay_id, o.o_orderdate AS intime,
  l.outtime, date_diff('microsecond', o.o_orderdate, l.outtime) / 3.6e9 AS los_hours,
  CASE WHEN c.c_acctbal >= 0 THEN CAST(floor(c.c_acctbal / 100) AS INTEGER) END AS anchor_age,
  CASE WHEN c.c_mktsegment <> 'MACHINERY' THEN c.c_mktsegment END AS gender,
  CAST(NULL AS TIMESTAMP) AS deathtime, CAST(o.o_orderstatus = 'F' AS INTEGER) AS hospital_expire_flag
FROM orders o
LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS outtime FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON c.c_custkey = o.o_custkey"""

CTES["cohort_rules"] = """
SELECT *, CASE WHEN anchor_age < 18 THEN 'age_below_minimum' WHEN anchor_age > 90 THEN 'age_above_maximum'
  WHEN los_hours IS NULL OR los_hours < 24 THEN 'los_below_minimum_hours'
  WHEN anchor_age IS NULL OR gender IS NULL THEN 'missing_demographics' END AS rule
FROM cohort_base"""

CTES["cohort"] = """
SELECT * EXCLUDE (rule), CASE WHEN rule IS NOT NULL THEN rule
  WHEN row_number() OVER (PARTITION BY subject_id, rule IS NULL ORDER BY intime, stay_id) > 1
  THEN 'readmission_not_first_stay' END AS exclusion_reason
FROM cohort_rules"""

_COHORT = (
    "subject_id, hadm_id, stay_id, intime, outtime, round(los_hours + 1e-9, 6) + 0.0 AS los_hours, anchor_age, gender, "
    "deathtime, hospital_expire_flag"
)
SQL["cohort_included"] = f"SELECT {_COHORT} FROM cohort WHERE exclusion_reason IS NULL"
SQL["cohort_excluded"] = f"SELECT {_COHORT}, exclusion_reason FROM cohort WHERE exclusion_reason IS NOT NULL"
SQL["cohort_audit"] = """
SELECT count(*) AS total_stays, count(*) FILTER (exclusion_reason IS NULL) AS included,
  count(exclusion_reason) AS excluded,
  round(count(*) FILTER (exclusion_reason IS NULL) / CAST(count(*) AS DOUBLE) * 100, 2) AS inclusion_rate_pct,
  count(DISTINCT subject_id) FILTER (exclusion_reason IS NULL) AS unique_patients
FROM cohort"""
SQL["exclusion_summary"] = """
SELECT exclusion_reason, count(*) AS "count", round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 2) AS pct
FROM cohort WHERE exclusion_reason IS NOT NULL GROUP BY 1"""
SQL["completeness"] = """
SELECT violation, rows FROM (
  SELECT 'count_mismatch' AS violation,
    (SELECT count(*) FROM cohort) - (SELECT count(*) FROM cohort_base) AS rows
  UNION ALL
  SELECT 'duplicate_included_stay', count(*) - count(DISTINCT stay_id) FROM cohort WHERE exclusion_reason IS NULL
) WHERE rows <> 0"""

SQL["completeness_faults"] = """
SELECT violation, rows FROM (
  SELECT 'count_mismatch' AS violation, count(*) FILTER (exclusion_reason IS NULL AND stay_id % 7 = 0)
    - count(*) FILTER (exclusion_reason IS NOT NULL AND stay_id % 10 = 0) AS rows FROM cohort
  UNION ALL SELECT 'null_exclusion_reason',
    count(*) FILTER (exclusion_reason IS NOT NULL AND stay_id % 10 > 0 AND stay_id % 6 = 0) FROM cohort
  UNION ALL SELECT 'duplicate_included_stay', count(*) FILTER (exclusion_reason IS NULL AND stay_id % 7 = 0) FROM cohort
) WHERE rows <> 0"""

# --- events, anchors and onset

CTES["ev"] = """
SELECT event_id, user_id AS stay_id, user_id AS hadm_id, user_id // 2 AS subject_id, ts AS charttime,
  event_type AS itemid, value AS valuenum, props
FROM events"""
CTES["stays"] = """
SELECT stay_id, hadm_id, subject_id, min(charttime) AS intime, max(charttime) AS outtime FROM ev GROUP BY ALL"""
CTES["deaths"] = """
SELECT hadm_id, max(charttime) AS deathtime FROM ev WHERE itemid = 'error' AND stay_id % 4 = 0 GROUP BY 1"""
CTES["anchors"] = """
SELECT a.hadm_id, min(least(a.charttime, b.charttime)) AS anchor_time
FROM ev a JOIN ev b ON a.hadm_id = b.hadm_id
WHERE a.itemid = 'purchase' AND b.itemid = 'signup'
  AND abs(date_diff('microsecond', a.charttime, b.charttime)) <= 72 * 3600000000
GROUP BY 1"""
CTES["scores"] = """
SELECT subject_id, hadm_id, stay_id, charttime,
  CAST(coalesce(CAST(e < 80 AS INTEGER), 0) + coalesce(CAST(v < 70 AS INTEGER), 0)
    + coalesce(CAST(c < 70 AS INTEGER), 0) AS INTEGER) AS sofa_score
FROM (
  SELECT subject_id, hadm_id, stay_id, CAST(date_trunc('day', charttime) AS TIMESTAMP) AS charttime,
    min(valuenum) FILTER (itemid = 'error') AS e, min(valuenum) FILTER (itemid = 'view') AS v,
    min(valuenum) FILTER (itemid = 'click') AS c
  FROM ev WHERE itemid IN ('error', 'view', 'click') AND valuenum IS NOT NULL GROUP BY 1, 2, 3, 4
)"""
CTES["cand"] = """
SELECT s.stay_id, a.anchor_time, s.charttime, s.sofa_score
FROM scores s JOIN anchors a USING (hadm_id)
WHERE s.sofa_score >= 2 AND s.charttime >= a.anchor_time - INTERVAL 72 HOUR
  AND s.charttime <= a.anchor_time + INTERVAL 120 HOUR"""
CTES["onset_all"] = """
SELECT s.*, a.anchor_time, coalesce(c.n, 0) AS n_candidates, c.t AS first_time, c.score AS first_score,
  least(a.anchor_time, c.t) AS onset,
  CASE WHEN a.anchor_time IS NULL THEN 'no_suspected_infection_time'
    WHEN c.n IS NULL THEN 'no_sofa_increase_within_window'
    WHEN least(a.anchor_time, c.t) < s.intime - INTERVAL 6 HOUR OR least(a.anchor_time, c.t) > s.outtime
    THEN 'onset_outside_icu_stay' END AS unusable_reason
FROM stays s LEFT JOIN anchors a USING (hadm_id)
LEFT JOIN (SELECT stay_id, CAST(count(*) AS INTEGER) AS n, min(charttime) AS t, first(sofa_score ORDER BY charttime) AS score
  FROM cand GROUP BY 1) c ON c.stay_id = s.stay_id"""
SQL["anchor_pairs"] = "SELECT hadm_id, anchor_time FROM anchors"
SQL["dysfunction_score"] = "SELECT * FROM scores"
SQL["onset_usable"] = """
SELECT stay_id, subject_id, hadm_id, onset AS onset_time, first_score AS sofa_score_at_onset, n_candidates
FROM onset_all WHERE unusable_reason IS NULL"""
SQL["onset_unusable"] = """
SELECT stay_id, subject_id, hadm_id, unusable_reason, n_candidates FROM onset_all WHERE unusable_reason IS NOT NULL"""
SQL["onset_candidates"] = """
SELECT c.stay_id, c.anchor_time, c.charttime AS sofa_time, c.sofa_score, least(c.anchor_time, c.charttime) AS onset_time,
  o.unusable_reason IS NULL AND c.charttime = o.first_time AS selected
FROM cand c JOIN onset_all o ON o.stay_id = c.stay_id"""
SQL["onset_audit"] = """
SELECT coalesce(unusable_reason, 'usable') AS outcome, count(*) AS episodes,
  round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 2) AS pct
FROM onset_all GROUP BY 1"""


# --- grid

def _grid(suffix: str, hours: int, onsets: str = "onset_all", deaths: str = "deaths") -> None:
    n = 72 // hours
    CTES[f"windows{suffix}"] = f"""
SELECT o.stay_id, o.subject_id, o.hadm_id, o.onset AS onset_time, o.intime, o.outtime, d.deathtime,
  o.onset - INTERVAL 24 HOUR AS window_start, o.onset + INTERVAL 48 HOUR AS window_end,
  least(o.onset + INTERVAL 48 HOUR, o.outtime, coalesce(d.deathtime, o.outtime)) AS actual_end
FROM {onsets} o LEFT JOIN {deaths} d ON d.hadm_id = o.hadm_id WHERE o.unusable_reason IS NULL"""
    CTES[f"steps{suffix}"] = f"""
SELECT stay_id, step_index, step_start, least(step_start + INTERVAL {hours} HOUR, actual_end) AS step_end,
  CAST(-24 + {hours} * step_index AS INTEGER) AS hours_relative, step_start < onset_time AS is_pre_onset
FROM (
  SELECT w.*, CAST(g.i AS INTEGER) AS step_index, w.window_start + to_hours({hours} * g.i) AS step_start
  FROM windows{suffix} w CROSS JOIN (SELECT unnest(range({n})) AS i) g
)
WHERE step_start < actual_end
  AND (step_start >= greatest(window_start, intime) OR step_start + INTERVAL {hours} HOUR > greatest(window_start, intime))"""
    CTES[f"grid{suffix}"] = f"""
SELECT w.stay_id, w.subject_id, w.hadm_id, w.onset_time, w.window_start, w.window_end, w.actual_end,
  CAST(coalesce(s.n, 0) AS INTEGER) AS n_steps, coalesce(s.n, 0) < {n} AS is_truncated,
  CASE WHEN coalesce(s.n, 0) >= {n} THEN 'not_truncated' WHEN w.deathtime < w.window_end THEN 'death'
    WHEN w.outtime < w.window_end THEN 'icu_discharge' WHEN w.intime > w.window_start THEN 'onset_near_icu_start'
    ELSE 'not_truncated' END AS truncation_reason,
  CASE WHEN s.n < {n} THEN s.last_step END AS truncation_step
FROM windows{suffix} w
LEFT JOIN (SELECT stay_id, count(*) AS n, max(step_index) AS last_step FROM steps{suffix} GROUP BY 1) s USING (stay_id)"""


_grid("", 4)
SQL["grid_steps"] = "SELECT * FROM steps"
SQL["grid_episodes"] = "SELECT * FROM grid"


def _grid_audit(source: str) -> str:
    return f"""
SELECT count(*) AS total_episodes, count(*) FILTER (NOT is_truncated) AS full_length,
  count(*) FILTER (is_truncated) AS truncated,
  round(count(*) FILTER (is_truncated) / CAST(count(*) AS DOUBLE) * 100, 2) AS truncated_pct,
  round(avg(n_steps), 2) AS avg_steps, min(n_steps) AS min_steps, max(n_steps) AS max_steps
FROM {source}"""


SQL["grid_audit"] = _grid_audit("grid")
SQL["truncation_reasons"] = """
SELECT truncation_reason, count(*) AS episodes,
  round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 2) AS pct
FROM grid WHERE is_truncated GROUP BY 1"""
SQL["limit_stays"] = "SELECT stay_id, onset_time, n_steps FROM grid ORDER BY stay_id LIMIT 20"

# --- scans

SQL["scan_points_filtered"] = """
SELECT event_id, stay_id, charttime, itemid, valuenum FROM ev
WHERE itemid IN ('view', 'error') AND charttime >= TIMESTAMP '2024-01-05' AND charttime < TIMESTAMP '2024-01-20'
  AND stay_id % 2 = 0"""
SQL["scan_intervals_filtered"] = """
SELECT stay_id, starttime, coalesce(endtime, starttime) AS endtime, amount FROM (
  SELECT stay_id, starttime, CASE WHEN amount >= 5 THEN endtime END AS endtime, amount, itemid FROM infusions)
WHERE itemid = 'purchase' AND starttime < TIMESTAMP '2024-01-20'
  AND (endtime IS NULL OR endtime >= TIMESTAMP '2024-01-05')"""
SQL["scan_orders_keyword"] = """
SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders
WHERE (upper(o_orderpriority) LIKE '%HIGH%' OR upper(o_orderpriority) LIKE '%URGENT%') AND o_orderdate IS NOT NULL"""

# --- typed text sources

SQL["source_stays"] = f"""
SELECT subject_id, hadm_id, stay_id, 'A, B' AS first_careunit, intime, outtime, {_r('los_hours')} FROM cohort_base"""
SQL["source_patients"] = """
SELECT c_custkey AS subject_id, c_mktsegment AS gender,
  CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 100) AS INTEGER) END AS anchor_age FROM customer"""
SQL["source_admissions"] = """
SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS deathtime,
  CAST(o_totalprice > 150000 AS INTEGER) AS hospital_expire_flag FROM orders WHERE o_orderstatus = 'F'"""
SQL["source_cultures"] = """
SELECT subject_id, hadm_id, charttime, coalesce(charttime, day) AS culture_time FROM (
  SELECT subject_id, hadm_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', charttime) END AS charttime,
    CAST(date_trunc('day', charttime) AS TIMESTAMP) AS day
  FROM ev WHERE itemid = 'signup' AND event_id % 10 > 0)"""
CTES["coded"] = """
SELECT event_id, subject_id, hadm_id, stay_id, date_trunc('second', charttime) AS charttime,
  list_position(['view', 'click', 'error', 'purchase', 'signup'], itemid)::BIGINT AS itemid,
  CASE WHEN event_id % 13 <> 0 THEN valuenum END AS valuenum FROM ev"""
SQL["source_labs"] = """
SELECT hadm_id, charttime, itemid, valuenum FROM coded
WHERE itemid IN (2, 3) AND charttime >= TIMESTAMP '2024-01-03' AND charttime < TIMESTAMP '2024-01-25'
  AND hadm_id IN (SELECT hadm_id FROM grid WHERE hadm_id % 3 > 0)"""
SQL["source_scores"] = """
SELECT subject_id, hadm_id, stay_id, charttime, itemid, valuenum FROM coded
WHERE itemid IN (1, 3) AND valuenum IS NOT NULL"""
SQL["source_malformed"] = """
SELECT 'keep' AS policy, count(*) AS rows, count(*) FILTER (o_orderkey % 11 = 0 OR o_orderkey % 17 > 0) AS with_drug
FROM orders
UNION ALL SELECT 'drop', count(*), count(*) FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey % 17 > 0
UNION ALL SELECT 'set aside', count(*), count(*) FILTER (o_orderkey % 11 = 0) FROM orders
WHERE o_orderkey % 11 = 0 OR o_orderkey % 17 = 0"""

# --- split


def _split(name: str, ids: str, source: str = "grid") -> None:
    CTES[name] = f"""
SELECT id, CASE WHEN rn <= n_train THEN 'train' WHEN rn <= n_train + n_val THEN 'validation' ELSE 'test' END AS split
FROM (
  SELECT id, row_number() OVER (ORDER BY md5('42:' || CAST(id AS VARCHAR))) AS rn,
    round_even(count(*) OVER () * CAST(0.7 AS DOUBLE), 0) AS n_train,
    round_even(count(*) OVER () * CAST(0.15 AS DOUBLE), 0) AS n_val
  FROM (SELECT DISTINCT {ids} AS id FROM {source})
)"""


_split("splits", "subject_id")
_split("stay_splits", "stay_id")
SQL["split_assign"] = "SELECT id AS subject_id, split FROM splits"
SQL["split_manifest"] = """
SELECT g.subject_id, s.split, g.stay_id, count(*) OVER (PARTITION BY g.subject_id) AS n_episodes
FROM grid g JOIN splits s ON s.id = g.subject_id"""
SQL["manifest_reload"] = f"SELECT * FROM ({SQL['split_manifest']}) WHERE split = 'validation'"
SQL["manifest_summary"] = """
SELECT s.split, count(DISTINCT g.subject_id) AS n_keys, count(*) AS n_episodes, CAST(42 AS BIGINT) AS seed,
  '1' AS spec_version, TRUE AS leakage_free
FROM grid g JOIN splits s ON s.id = g.subject_id GROUP BY 1"""
SQL["manifest_arrays"] = """
SELECT g.subject_id, s.split,
  string_agg(CAST(g.stay_id AS VARCHAR), ',' ORDER BY g.stay_id) AS episode_keys, count(*) AS n_episodes
FROM grid g JOIN splits s ON s.id = g.subject_id GROUP BY 1, 2"""
SQL["split_stats"] = """
SELECT s.split, count(DISTINCT g.subject_id) AS n_patients, count(*) AS n_episodes,
  round(count(DISTINCT g.subject_id) FILTER (g.subject_id % 2 = 1)
    / CAST(count(DISTINCT g.subject_id) AS DOUBLE), 4) AS mortality_rate
FROM grid g JOIN splits s ON s.id = g.subject_id GROUP BY 1"""
SQL["leakage_check"] = """
SELECT g.subject_id, count(DISTINCT s.split) AS n_splits FROM grid g JOIN stay_splits s ON s.id = g.stay_id
GROUP BY 1 HAVING count(DISTINCT s.split) > 1"""
SQL["step_context"] = """
SELECT g.stay_id, g.subject_id, g.hadm_id, g.onset_time, round(c.c_acctbal / 100 + 1e-9, 6) + 0.0 AS age_years,
  round(w.weight_kg + 1e-9, 6) + 0.0 AS weight_kg, s.split, l.mortality_90d
FROM grid g LEFT JOIN customer c ON c.c_custkey = g.subject_id LEFT JOIN weights w ON w.stay_id = g.stay_id
JOIN labels l ON l.stay_id = g.stay_id
JOIN splits s ON s.id = g.subject_id"""

# --- state

CTES["infusions"] = """
SELECT stay_id, charttime AS starttime,
  charttime + to_microseconds(CAST(round(valuenum * 900) AS BIGINT) * 1000000) AS endtime, itemid, valuenum AS amount,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS rate,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS patientweight
FROM ev"""
CTES["weights"] = """
SELECT stay_id, quantile_cont(patientweight, 0.5) AS weight_kg FROM infusions WHERE itemid = 'purchase' GROUP BY 1"""
CTES["placed"] = """
SELECT e.*, s.step_index FROM ev e JOIN steps s
  ON e.stay_id = s.stay_id AND e.charttime >= s.step_start AND e.charttime < s.step_end"""
CTES["early"] = """
SELECT e.*, CAST(floor(date_diff('microsecond', w.window_start, e.charttime) / 14400000000) AS INTEGER) AS step_index
FROM ev e JOIN windows w ON w.stay_id = e.stay_id AND e.charttime >= w.window_start AND e.charttime < w.actual_end
WHERE EXISTS (SELECT 1 FROM steps s WHERE s.stay_id = e.stay_id)"""


def _feature(source: str, name: str, items: str, value: str, low: float | None, high: float | None) -> str:
    ok = "valuenum IS NOT NULL" if low is None else f"valuenum BETWEEN {low} AND {high}"
    value = value.replace("?", f"FILTER ({ok})")
    return f"""SELECT stay_id, step_index, '{name}' AS feature, {value} AS value, count(*) FILTER ({ok}) AS n_valid
FROM {source} WHERE itemid IN ({items}) GROUP BY 1, 2"""


CTES["long"] = "\nUNION ALL\n".join(
    [
        _feature("placed", "view_last", "'view'", "last(valuenum ORDER BY charttime, event_id) ?", 0.5, 200),
        _feature("placed", "click_min", "'click'", "min(valuenum) ?", 0.1, 180),
        _feature("placed", "error_max", "'error'", "max(valuenum) ?", 0, 160),
        _feature("placed", "purchase_mean", "'purchase'", "avg(valuenum) ?", None, None),
        _feature("placed", "signup_sum", "'signup'", "sum(valuenum)", 0, 120),
        _feature("early", "paid_total", "'click', 'purchase'", "sum(valuenum)", 0, 150),
    ]
)
_EVENT_FEATURES = ("view_last", "click_min", "error_max", "purchase_mean", "signup_sum")
CTES["wide"] = (
    "SELECT s.stay_id, s.step_index, s.step_start, s.step_end, s.hours_relative, "
    + ", ".join(
        f"max(l.value) FILTER (l.feature = '{f}') AS {f}, "
        f"coalesce(max(l.n_valid) FILTER (l.feature = '{f}'), 0) AS {f}_n"
        for f in _EVENT_FEATURES
    )
    + """,
  (SELECT sum(e.valuenum) FROM ev e JOIN windows w ON w.stay_id = e.stay_id
    WHERE e.stay_id = s.stay_id AND e.itemid IN ('click', 'purchase')
      AND e.charttime >= w.window_start AND e.charttime < s.step_end) AS paid_total
FROM steps s LEFT JOIN long l ON l.stay_id = s.stay_id AND l.step_index = s.step_index
GROUP BY s.stay_id, s.step_index, s.step_start, s.step_end, s.hours_relative"""
)
CTES["enriched"] = """
SELECT w.*, g.subject_id, c.c_acctbal / 100 AS age_years, sp.split
FROM wide w JOIN grid g ON g.stay_id = w.stay_id LEFT JOIN customer c ON c.c_custkey = g.subject_id
JOIN splits sp ON sp.id = g.subject_id"""

_FEATURES = (
    "view_last", "click_min", "error_max", "purchase_mean", "signup_sum", "paid_total", "age_years", "click_error",
    "view_error", "hours_since_onset",
)
_CLIP = {
    "view_last": (1, 150), "click_min": (0.5, 120), "error_max": (0.2, 140), "purchase_mean": (1, 160),
    "signup_sum": (0, 300), "paid_total": (0, 900), "age_years": (18, 110), "click_error": (0.05, 10),
    "view_error": (0, 5), "hours_since_onset": (-24, 48),
}


def _imputed(name: str, medians: bool) -> None:
    def m(feature: str) -> str:
        return f"m.{feature}" if medians else "CAST(NULL AS DOUBLE)"

    def ff(col: str) -> str:
        return f"last_value({col} IGNORE NULLS) OVER (PARTITION BY stay_id ORDER BY step_index)"

    base = {
        "view_last": f"coalesce({ff('view_last')}, {m('view_last')}, 45)",
        "click_min": f"coalesce({ff('click_min')}, {m('click_min')}, 40)",
        "error_max": f"coalesce(error_max, {m('error_max')}, 35)",
        "purchase_mean": f"coalesce(purchase_mean, {m('purchase_mean')}, 42)",
        "signup_sum": "coalesce(signup_sum, 0)",
        "paid_total": "coalesce(paid_total, 0)",
        "age_years": f"coalesce(age_years, {m('age_years')})",
        "hours_since_onset": "CAST(hours_relative AS DOUBLE)",
    }
    source = "enriched CROSS JOIN medians m" if medians else "enriched"
    raw = [f"{f}" for f in ("view_last", "click_min", "error_max", "purchase_mean", "signup_sum", "paid_total", "age_years")]
    plain = ", ".join(f"e.{c} AS {c}" for c in raw)
    ms = ", ".join(f"m.{f} AS m_{f}" for f in _FEATURES) if medians else "1 AS one"
    base = {k: v.replace("m.", "m_") if medians else v for k, v in base.items()}
    filled = ", ".join(f"{_clip(expr, *_CLIP[f])} AS {f}" for f, expr in base.items())
    med_ce, med_ve = ("m_click_error", "m_view_error") if medians else ("CAST(NULL AS DOUBLE)",) * 2
    keep_ms = ", m_click_error, m_view_error" if medians else ""
    CTES[name] = f"""
SELECT * EXCLUDE (ce, ve), {_clip(f'coalesce(ce, {med_ce}, 1)', *_CLIP['click_error'])} AS click_error,
  {_clip(
      f'coalesce(last_value(ve IGNORE NULLS) OVER (PARTITION BY stay_id ORDER BY step_index), {med_ve}, 0.6)',
      *_CLIP['view_error'],
  )} AS view_error
FROM (
  SELECT *, CASE WHEN error_max > 0 THEN click_min / error_max END AS ce,
    CASE WHEN error_max > 0 THEN view_last / error_max END AS ve
  FROM (
    SELECT stay_id, step_index, subject_id, split, {filled},
      CAST(view_last_n = 0 AS INTEGER) AS view_last_missing, CAST(click_min_n = 0 AS INTEGER) AS click_min_missing,
      CAST(error_max_n = 0 AS INTEGER) AS error_max_missing, CAST(signup_sum_n = 0 AS INTEGER) AS signup_sum_missing,
      CAST(1 AS INTEGER) AS click_error_missing{keep_ms}
    FROM (
      SELECT e.stay_id, e.step_index, e.subject_id, e.split, e.hours_relative, {plain}, e.view_last_n, e.click_min_n,
        e.error_max_n, e.signup_sum_n, {ms}
      FROM {source.replace('enriched', 'enriched e')}
    )
  )
)"""


_imputed("pass1", False)
CTES["medians"] = (
    "SELECT "
    + ", ".join(f"coalesce(quantile_cont({f}, 0.5), 0) AS {f}" for f in _FEATURES)
    + " FROM pass1 WHERE split = 'train'"
)
_imputed("pass2", True)
CTES["state"] = """
SELECT *, CAST(view_last < 30 AS INTEGER) + CAST(click_min < 25 AS INTEGER) + CAST(error_max < 40 AS INTEGER)
  AS sofa_score
FROM pass2"""
CTES["labels"] = """
SELECT g.stay_id, CAST(d.deathtime IS NOT NULL AND d.deathtime <= g.onset_time + INTERVAL 90 DAY AS INTEGER)
  AS mortality_90d
FROM grid g LEFT JOIN deaths d ON d.hadm_id = g.hadm_id"""

_FLAGGED = ("view_last", "click_min", "error_max", "signup_sum", "click_error")
_COLUMNS = [c for f in _FEATURES for c in ((f, f"{f}_missing") if f in _FLAGGED else (f,))]


def _state_list(names) -> str:
    return ", ".join(c if c.endswith("_missing") else _r(c) for c in names)


SQL["feature_long"] = f"SELECT stay_id, step_index, feature, {_r('value')}, n_valid FROM long"
_DICTIONARY = [
    ("view_last", "events", "last", "forward_fill"), ("click_min", "events", "min", "forward_fill"),
    ("error_max", "events", "max", "median_train"), ("purchase_mean", "events", "mean", "median_train"),
    ("signup_sum", "events", "sum", "zero"), ("paid_total", "events", "cumulative", "zero"),
    ("age_years", "static", "last", "median_train"), ("click_error", "derived", "last", "median_train"),
    ("view_error", "derived", "last", "forward_fill"), ("hours_since_onset", "grid", "last", "normal_value"),
]
SQL["registry_coverage"] = f"""
SELECT k.kind, k.value, count(DISTINCT k.feature) AS features, count(l.value) AS steps,
  CAST(coalesce(sum(l.n_valid), 0) AS BIGINT) AS events
FROM (VALUES {', '.join(f"('{f}', '{kind}', '{v}')" for f, *vs in _DICTIONARY
                        for kind, v in zip(("source", "agg", "missing"), vs))}) k(feature, kind, value)
LEFT JOIN long l ON l.feature = k.feature GROUP BY 1, 2"""
SQL["state_raw"] = (
    "SELECT stay_id, step_index, step_start, step_end, " + ", ".join(_r(f) for f in _EVENT_FEATURES) + " FROM wide"
)
SQL["cumulative_exposure"] = (
    "SELECT stay_id, step_index, round(coalesce(paid_total, 0) + 1e-9, 6) + 0.0 AS paid_total FROM wide"
)
SQL["missing_flags"] = (
    "SELECT stay_id, step_index, " + ", ".join(c for c in _COLUMNS if c.endswith("_missing")) + " FROM pass1"
)
SQL["state_first_pass"] = f"SELECT stay_id, step_index, {_state_list(_FEATURES)} FROM pass1"
SQL["state_imputed"] = f"SELECT stay_id, step_index, split, {_state_list(_COLUMNS)}, sofa_score FROM state"
SQL["derived_ratios"] = f"SELECT stay_id, step_index, {_r('click_error')}, {_r('view_error')} FROM state"
SQL["state_problems"] = """
SELECT DISTINCT stay_id // 3 AS stay_id, 'duplicate_step_index' AS violation FROM wide
GROUP BY stay_id // 3, step_index HAVING count(*) > 1
UNION ALL
SELECT w.stay_id // 3, 'several_subjects' FROM wide w JOIN grid g ON g.stay_id = w.stay_id
GROUP BY 1 HAVING count(DISTINCT g.subject_id) > 1"""
SQL["outcome_label"] = "SELECT * FROM labels"
SQL["train_medians"] = "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, {_r(f, 'median')} FROM medians" for f in _FEATURES
)


def _bounded(feature: str) -> str:
    return _clip(f"coalesce(s.{feature}, m.{feature})", *_CLIP[feature])


SQL["nested_ratio"] = f"""
SELECT stay_id, step_index, {_r('click_error')}, {_r(_clip('coalesce(known, 1.5)', 0.1, 20), 'ratio_of_ratios')},
  CAST(1 AS INTEGER) AS ratio_of_ratios_missing
FROM (
  SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY stay_id ORDER BY step_index) AS known
  FROM (SELECT *, CASE WHEN view_error > 0 THEN click_error / view_error END AS own FROM pass2))"""
_OWN = ("view_high", "view_low", "click_span", "error_peak")
SQL["own_rules"] = f"""
SELECT s.stay_id, s.step_index, {_r('avg(CAST(v > 50 AS INTEGER)) FILTER (w)', 'view_high')},
  {_r('avg(CAST(v > 20 AS INTEGER)) FILTER (w)', 'view_low')}, {_r('max(v) FILTER (c) - min(v) FILTER (c)', 'click_span')},
  {_r("max((SELECT max(e.valuenum) FROM ev e WHERE e.stay_id = s.stay_id AND e.itemid = 'error' "
      "AND e.valuenum BETWEEN 0 AND 160 AND e.charttime >= g.window_start AND e.charttime < s.step_end))", 'error_peak')},
  count(v) FILTER (w) AS view_high__n, count(v) FILTER (w) AS view_low__n, count(v) FILTER (c) AS click_span__n,
  count(v) FILTER (p) AS error_peak__n
FROM steps s JOIN windows g ON g.stay_id = s.stay_id
LEFT JOIN (SELECT stay_id, step_index, valuenum AS v, itemid = 'view' AND valuenum BETWEEN 0.5 AND 200 AS w,
    itemid IN ('click', 'view') AND valuenum BETWEEN 0.1 AND 180 AS c, itemid = 'error' AND valuenum BETWEEN 0 AND 160 AS p
  FROM placed) p ON p.stay_id = s.stay_id AND p.step_index = s.step_index
GROUP BY s.stay_id, s.step_index"""
SQL["last_without_tie"] = f"""
SELECT e.stay_id, s.step_index, 'last_seen' AS feature,
  {_r("last(v ORDER BY t, list_position(['view', 'click', 'error'], itemid), v) FILTER (v BETWEEN 1 AND 150)", 'value')},
  count(*) FILTER (v BETWEEN 1 AND 150) AS n_valid
FROM (SELECT stay_id, itemid, valuenum AS v, CAST(date_trunc('day', charttime) AS TIMESTAMP) AS t FROM ev
  WHERE itemid IN ('view', 'click', 'error')) e
JOIN steps s ON s.stay_id = e.stay_id AND e.t >= s.step_start AND e.t < s.step_end GROUP BY 1, 2"""

# one pass: mean and deviation of every feature in one row
CTES["scales"] = (
    "SELECT "
    + ", ".join(
        f"avg({f}) AS {f}_mean, CASE WHEN stddev_pop({f}) <= 1e-12 THEN 1.0 ELSE stddev_pop({f}) END AS {f}_scale"
        for f in _FEATURES
    )
    + " FROM (SELECT "
    + ", ".join(f"{_bounded(f)} AS {f}" for f in _FEATURES)
    + " FROM state s CROSS JOIN medians m WHERE s.split = 'train')"
)
CTES["scaler"] = "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, m.{f} AS median, w.{f}_mean AS mean, w.{f}_scale AS scale, "
    f"CAST({_CLIP[f][0]} AS DOUBLE) AS clip_low, CAST({_CLIP[f][1]} AS DOUBLE) AS clip_high "
    f"FROM medians m CROSS JOIN scales w"
    for f in _FEATURES
)
SQL["scaler_fit"] = (
    f"SELECT feature, {_r('median')}, {_r('mean')}, {_r('scale')}, {_r('clip_low')}, {_r('clip_high')} FROM scaler"
)
CTES["normal"] = (
    "SELECT s.stay_id, s.step_index, "
    + ", ".join(
        c if c.endswith("_missing") else f"({_bounded(c)} - w.{c}_mean) / w.{c}_scale AS {c}" for c in _COLUMNS
    )
    + " FROM state s CROSS JOIN medians m CROSS JOIN scales w"
)
SQL["state_normalised"] = f"SELECT stay_id, step_index, {_state_list(_COLUMNS)} FROM normal"
SQL["static_weight"] = f"SELECT stay_id, {_r('weight_kg')} FROM weights"

# --- actions

CTES["rates"] = """
SELECT stay_id, starttime, endtime, itemid,
  CASE itemid WHEN 'purchase' THEN 'alpha' WHEN 'error' THEN 'beta' ELSE 'gamma' END AS agent,
  coalesce(rate, 0) * CASE itemid WHEN 'purchase' THEN 1.0 WHEN 'error' THEN 2.5 ELSE 0.1 END AS standard_rate
FROM infusions WHERE itemid IN ('purchase', 'error', 'signup')"""
CTES["cuts"] = """
SELECT s.stay_id, s.step_index, r.standard_rate,
  date_diff('microsecond', greatest(r.starttime, s.step_start), least(r.endtime, s.step_end)) / 3.6e9 AS h
FROM steps s JOIN rates r ON r.stay_id = s.stay_id AND r.starttime < s.step_end AND r.endtime > s.step_start"""
CTES["vaso"] = """
SELECT s.stay_id, s.step_index, coalesce(o.dose, 0.0) AS vaso_dose_4h
FROM steps s LEFT JOIN (SELECT stay_id, step_index, sum(standard_rate * h) / sum(h) AS dose FROM cuts
  WHERE h > 0 GROUP BY 1, 2) o ON o.stay_id = s.stay_id AND o.step_index = s.step_index"""
CTES["fluid"] = """
SELECT s.stay_id, s.step_index, coalesce(sum(p.valuenum), 0.0) AS fluid_volume_4h
FROM steps s LEFT JOIN placed p ON p.stay_id = s.stay_id AND p.step_index = s.step_index AND p.itemid = 'click'
GROUP BY 1, 2"""
CTES["doses"] = """
SELECT v.*, f.fluid_volume_4h, sp.split FROM vaso v
JOIN fluid f ON f.stay_id = v.stay_id AND f.step_index = v.step_index
JOIN grid g ON g.stay_id = v.stay_id JOIN splits sp ON sp.id = g.subject_id"""


def _bins(suffix: str, n_bins: int, doses: str = "doses") -> None:
    cuts = n_bins - 1

    def raw(column: str, i: int) -> str:
        values = f"list({column} ORDER BY {column}) FILTER ({column} > 0)"
        rank = f"CAST(floor((count(*) FILTER ({column} > 0) - 1) * CAST({i / cuts!r} AS DOUBLE) + 0.5) AS BIGINT)"
        return f"({values})[{rank} + 1]"

    fields = [
        f"{raw(column, i)} AS {short}{i}"
        for column, short in (("vaso_dose_4h", "v"), ("fluid_volume_4h", "f"))
        for i in range(1, cuts)
    ]
    CTES[f"edges{suffix}"] = f"SELECT {', '.join(fields)} FROM {doses} WHERE split = 'train'"

    def code(column: str, short: str) -> str:
        above = " + ".join(f"CAST({column} > e.{short}{i} AS INTEGER)" for i in range(1, cuts))
        return f"CASE WHEN {column} > 0 THEN 1 + {above} ELSE 0 END"

    CTES[f"actions{suffix}"] = f"""
SELECT stay_id, step_index, vaso_bin, fluid_bin, CAST(vaso_bin * {n_bins} + fluid_bin AS INTEGER) AS action_id FROM (
  SELECT d.stay_id, d.step_index, CAST({code('d.vaso_dose_4h', 'v')} AS INTEGER) AS vaso_bin,
    CAST({code('d.fluid_volume_4h', 'f')} AS INTEGER) AS fluid_bin
  FROM {doses} d CROSS JOIN edges{suffix} e)"""


for _suffix, _n in (("", 5), ("3", 3), ("7", 7)):
    _bins(_suffix, _n)

_LABEL = (
    "CASE WHEN {a} // 5 = 0 THEN 'no_vaso' ELSE 'vaso_Q' || CAST({a} // 5 AS VARCHAR) END || '×' || "
    "CASE WHEN {a} % 5 = 0 THEN 'no_fluid' ELSE 'fluid_Q' || CAST({a} % 5 AS VARCHAR) END"
)
SQL["rate_standardised"] = f"SELECT stay_id, starttime, endtime, itemid, agent, {_r('standard_rate')} FROM rates"
SQL["interval_weighted_mean"] = f"SELECT stay_id, step_index, {_r('vaso_dose_4h')} FROM vaso"
SQL["point_sum"] = f"SELECT stay_id, step_index, {_r('fluid_volume_4h')} FROM fluid"
SQL["bin_edges"] = "\nUNION ALL\n".join(
    f"SELECT '{dose}' AS dose, CAST({i} AS INTEGER) AS edge, {_r(f'{short}{i}', 'value')} FROM edges"
    for dose, short in (("vaso", "v"), ("fluid", "f"))
    for i in (1, 2, 3)
)
SQL["action_ids"] = "SELECT * FROM actions"
SQL["action_labels"] = (
    f"SELECT stay_id, step_index, {_LABEL.format(a='action_id')} AS action_label, action_id AS recoded FROM actions"
)
SQL["action_histogram"] = 'SELECT action_id, count(*) AS "count" FROM actions GROUP BY 1'

# --- rewards

CTES["reward_base"] = """
SELECT s.stay_id, s.step_index, s.split, CAST(s.sofa_score AS DOUBLE) AS sofa, s.error_max AS lact, s.view_last AS pres,
  lag(s.sofa_score) OVER w AS sofa0, lag(s.error_max) OVER w AS lact0,
  first_value(l.mortality_90d) OVER w AS died,
  s.step_index = max(s.step_index) OVER (PARTITION BY s.stay_id) AS is_terminal
FROM state s JOIN labels l ON l.stay_id = s.stay_id
WINDOW w AS (PARTITION BY s.stay_id ORDER BY s.step_index)"""


def _rewards(name: str, sofa: bool, full: bool) -> None:
    shaped = "coalesce(-0.025 * (sofa - sofa0), 0)" if sofa else "CAST(0 AS DOUBLE)"
    lact = "CASE WHEN lact0 > 0 THEN 0.5 * (lact0 - lact) / lact0 ELSE 0 END" if full else "CAST(0 AS DOUBLE)"
    pres = "CASE WHEN pres < 40 THEN -0.01 * (40 - pres) ELSE 0 END" if full else "CAST(0 AS DOUBLE)"
    CTES[name] = f"""
SELECT *, terminal + sofa_shaping + lactate_shaping + map_shaping AS reward_total FROM (
  SELECT stay_id, step_index, split,
    CAST(CASE WHEN NOT is_terminal THEN 0 WHEN died = 0 THEN 15 ELSE -15 END AS DOUBLE) AS terminal,
    {shaped} AS sofa_shaping, {lact} AS lactate_shaping, {pres} AS map_shaping, is_terminal
  FROM reward_base)"""


_rewards("rew_sparse", False, False)
_rewards("rew_sofa", True, False)
_rewards("rew_full", True, True)
for _variant in ("sparse", "sofa", "full"):
    SQL[f"rewards_{_variant}"] = (
        "SELECT stay_id, step_index, is_terminal, "
        + ", ".join(_r(c) for c in ("terminal", "sofa_shaping", "lactate_shaping", "map_shaping", "reward_total"))
        + f" FROM rew_{_variant}"
    )
SQL["reward_summary"] = f"""
SELECT count(DISTINCT stay_id) AS n_episodes, count(*) AS n_transitions,
  count(*) FILTER (is_terminal AND terminal > 0) AS n_survived,
  count(*) FILTER (is_terminal AND terminal < 0) AS n_died, {_r('avg(reward_total)', 'mean_total')},
  {_r('stddev_pop(reward_total)', 'std_total')}, {_r('avg(sofa_shaping)', 'mean_sofa_shaping')},
  {_r('avg(terminal)', 'mean_terminal')}
FROM rew_sofa"""

# --- transitions

CTES["trans"] = (
    "SELECT s.split, s.stay_id, s.step_index, a.action_id AS action, r.reward_total AS reward, r.is_terminal AS done, "
    + ", ".join(f"CAST(coalesce(s.{c}, 0) AS DOUBLE) AS s_{c}" for c in _COLUMNS)
    + " FROM state s JOIN actions a ON a.stay_id = s.stay_id AND a.step_index = s.step_index "
    + "JOIN rew_sofa r ON r.stay_id = s.stay_id AND r.step_index = s.step_index"
)
CTES["linked"] = (
    "SELECT t.*, "
    + ", ".join(f"coalesce(n.s_{c}, t.s_{c}) AS ns_{c}" for c in _COLUMNS)
    + " FROM trans t LEFT JOIN trans n ON n.stay_id = t.stay_id AND n.step_index = t.step_index + 1"
)
SQL["transitions"] = (
    f"SELECT split, stay_id, step_index, action, {_r('reward')}, done, "
    + ", ".join(_r(f"{p}_{c}") for p in ("s", "ns") for c in _COLUMNS)
    + " FROM linked"
)
SQL["replay_reload"] = f"SELECT * FROM ({SQL['transitions']}) WHERE split = 'validation'"
SQL["replay_layout"] = """
SELECT stay_id, CAST(1 AS BIGINT) AS files, count(*) AS steps, TRUE AS in_order FROM trans GROUP BY 1"""
SQL["artifact_reload"] = (
    f"SELECT n.stay_id, n.step_index, a.action_id, {_r('r.reward_total', 'reward_total')}, "
    + ", ".join(f"n.{c}" if c.endswith("_missing") else _r(f"n.{c}", c) for c in _COLUMNS)
    + " FROM normal n JOIN actions a ON a.stay_id = n.stay_id AND a.step_index = n.step_index "
    + "JOIN rew_sofa r ON r.stay_id = n.stay_id AND r.step_index = n.step_index"
)
SQL["transitions_normalised"] = (
    f"SELECT t.split, t.stay_id, t.step_index, t.action, {_r('t.reward', 'reward')}, t.done, "
    + ", ".join(_r(f"CAST(n.{c} AS DOUBLE)", f"s_{c}") for c in _COLUMNS)
    + ", "
    + ", ".join(_r(f"CAST(coalesce(x.{c}, n.{c}) AS DOUBLE)", f"ns_{c}") for c in _COLUMNS)
    + " FROM trans t JOIN normal n ON n.stay_id = t.stay_id AND n.step_index = t.step_index "
    + "LEFT JOIN normal x ON x.stay_id = t.stay_id AND x.step_index = t.step_index + 1"
)
SQL["dataset_meta"] = f"""
SELECT split, count(DISTINCT stay_id) AS n_episodes, count(*) AS n_transitions,
  CAST({len(_COLUMNS)} AS INTEGER) AS state_dim, CAST(25 AS INTEGER) AS n_actions, '1' AS spec_version,
  '1' AS action_spec_version, '1' AS reward_spec_version, CAST(42 AS INTEGER) AS manifest_seed,
  '{",".join(_COLUMNS)}' AS feature_columns FROM trans GROUP BY 1"""
SQL["transition_violations"] = """
WITH cut AS (
  SELECT stay_id, step_index, done, action + CASE WHEN stay_id % 7 = 0 THEN 25 ELSE 0 END AS action,
    step_index = max(step_index) OVER (PARTITION BY stay_id) AS is_last
  FROM trans WHERE NOT (done AND stay_id % 2 = 0))
SELECT stay_id, step_index, 'last_not_done' AS violation FROM cut WHERE is_last AND NOT done
UNION ALL SELECT stay_id, step_index, 'early_done' FROM cut WHERE done AND NOT is_last
UNION ALL SELECT stay_id, step_index, 'action_range' FROM cut WHERE action < 0 OR action >= 25"""

# --- baselines


def _baseline(by: str) -> str:
    lead = f"{by}, " if by else ""
    return f"""
SELECT {lead}count(*) AS n_episodes, CAST(sum(n) AS BIGINT) AS n_transitions,
  {_r('avg(ret)', 'mean_episode_return')}, {_r('stddev_pop(ret)', 'std_episode_return')},
  {_r('sum(ret) / sum(n)', 'mean_reward')},
  {_r('count(*) FILTER (last_reward < 0) / CAST(count(*) AS DOUBLE)', 'mortality_rate')}
  {'' if by else ', CAST(0 AS INTEGER) AS action'}
FROM (SELECT {lead}stay_id, sum(reward) AS ret, count(*) AS n, max(reward) FILTER (done) AS last_reward
  FROM trans GROUP BY ALL) {f'GROUP BY {by}' if by else ''}"""


SQL["clinician_baseline"] = _baseline("split")
SQL["no_treatment_baseline"] = _baseline("")
SQL["behaviour_cloning"] = f"""
SELECT (SELECT count(*) FROM trans WHERE split = 'train') AS n_train, n_transitions AS n_eval, mean_episode_return,
  std_episode_return, mortality_rate, TRUE AS at_least_majority FROM ({_baseline('split')}) WHERE split = 'test'"""
SQL["episode_returns"] = f"""
SELECT stay_id, {_r('sum(pow(CAST(0.99 AS DOUBLE), step_index) * reward)', 'episode_return')}, count(*) AS n_steps,
  {_r('sum(reward)', 'reward_sum')}, {_r('max(reward) FILTER (done)', 'terminal_reward')}
FROM trans GROUP BY 1"""

_BIN = (
    "CAST(CAST({t}s_view_last > 25 AS INTEGER) + CAST({t}s_view_last > 60 AS INTEGER) AS VARCHAR) || '-' || "
    "CAST(CAST({t}s_error_max > 30 AS INTEGER) + CAST({t}s_error_max > 70 AS INTEGER) AS VARCHAR)"
)
_RULE = "CAST(CASE WHEN s_view_last < 30 THEN 6 WHEN s_error_max > 60 THEN 12 ELSE 0 END AS INTEGER)"
CTES["support"] = f"""
SELECT state_bin, action, count(*) AS support_count,
  count(*) / CAST(sum(count(*)) OVER (PARTITION BY state_bin) AS DOUBLE) AS support_prob
FROM (SELECT {_BIN.format(t='')} AS state_bin, action FROM trans WHERE split = 'train') GROUP BY 1, 2"""
SQL["behaviour_support"] = f"SELECT state_bin, action, support_count, {_r('support_prob')} FROM support"

_BINNED = {"view_last": 4, "error_max": 3, "paid_total": 4}
CTES["learned"] = (
    "SELECT "
    + ", ".join(
        f"list_sort(list_distinct([{', '.join(f'quantile_cont(s_{c}, {i}::DOUBLE / {n})' for i in range(1, n))}])) AS {c}"
        for c, n in _BINNED.items()
    )
    + " FROM trans WHERE split = 'train'"
)
SQL["state_cuts"] = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS component, i::INTEGER AS edge, {_r(f'{c}[i]', 'value')} "
    f"FROM (SELECT {c}, unnest(range(1, len({c}) + 1)) AS i FROM learned)"
    for c in _BINNED
)
_LEARNED_BIN = " || '-' || ".join(f"CAST(len(list_filter(l.{c}, lambda e: s_{c} > e)) AS VARCHAR)" for c in _BINNED)
SQL["learned_support"] = f"""
SELECT state_bin, action, count(*) AS support_count,
  {_r('count(*) / CAST(sum(count(*)) OVER (PARTITION BY state_bin) AS DOUBLE)', 'support_prob')}
FROM (SELECT {_LEARNED_BIN} AS state_bin, action FROM trans CROSS JOIN learned l WHERE split = 'train') GROUP BY 1, 2"""

# --- off-policy evaluation

CTES["held"] = f"""
SELECT t.*, t.stay_id AS episode_id, {_BIN.format(t='t.')} AS state_bin, {_RULE} AS policy_action,
  coalesce(p.support_prob, 0.01) AS behavior_action_prob
FROM trans t LEFT JOIN support p ON p.state_bin = {_BIN.format(t='t.')} AND p.action = t.action
WHERE t.split = 'test'"""
SQL["held_out_violations"] = """
WITH cut AS (
  SELECT episode_id, step_index, done,
    CASE WHEN episode_id % 5 = 0 THEN 0.0 ELSE behavior_action_prob END AS prob,
    step_index = max(step_index) OVER (PARTITION BY episode_id) AS is_last
  FROM held WHERE NOT (done AND episode_id % 3 = 0))
SELECT episode_id, step_index, 'behavior_prob' AS violation FROM cut WHERE NOT (prob > 0 AND prob <= 1)
UNION ALL SELECT episode_id, step_index, 'early_done' FROM cut WHERE done AND NOT is_last
UNION ALL SELECT episode_id, step_index, 'last_not_done' FROM cut WHERE is_last AND NOT done"""


def _weights(prob: str, cap: bool) -> str:
    ratio = f"({prob}) / behavior_action_prob"
    ratio = f"least({ratio}, 5.0)" if cap else ratio
    return f"""
SELECT episode_id, sum(pow(CAST(0.99 AS DOUBLE), step_index) * reward) AS g, product({ratio}) AS w,
  count(*) FILTER (({prob}) > 0) AS matched, count(*) AS n
FROM held GROUP BY 1"""


_HIT = "CASE WHEN action = policy_action THEN CAST(1 AS DOUBLE) ELSE 0 END"
CTES["ope_mixed"] = _weights(f"0.7 * behavior_action_prob + 0.3 * {_HIT}", True)
CTES["ope_rule"] = _weights(_HIT, False)
SQL["ope_episode"] = f"""
SELECT episode_id, {_r('g', 'discounted_return')}, {_r('ln(w)', 'log_weight')}, matched AS matched_steps, n AS n_steps,
  {_r('matched / CAST(n AS DOUBLE)', 'matched_step_fraction')} FROM ope_mixed"""


def _wis(source: str, weight_sum: str) -> str:
    return f"""{_r('CASE WHEN sum(w) > 0 THEN sum(w * g) / sum(w) ELSE 0 END', 'wis')},
  {_r('CASE WHEN sum(w) > 0 AND sum(w * w) > 0 THEN sum(w) * sum(w) / sum(w * w) ELSE 0 END', 'ess')},
  count(*) AS n_episodes, {_r(weight_sum, 'wis_weight_sum')}, count(*) FILTER (w > 0) AS wis_nonzero_episodes,
  {_r('avg(g)', 'mean_behavior_return')}"""


SQL["ope_wis_ess"] = f"SELECT {_wis('ope_mixed', 'ln(sum(w))')} FROM ope_mixed"

_Q = (
    "list_transform(range(0, 25), lambda a: {p}_view_last * 4e-3 * (a % 5) - {p}_error_max * 2e-3 * (a // 5) "
    "+ 1e-1 * ((a * 7) % 5))"
)
CTES["scored"] = f"""
SELECT *, list_transform(q, lambda x: x * 2.0) AS logits, s_view_last * 8e-3 AS v FROM (
  SELECT *, {_Q.format(p='s')} AS q, {_Q.format(p='ns')} AS q_next FROM linked)"""
CTES["soft"] = """
SELECT *, list_transform(logits, lambda x: exp(x - top) / mass) AS probs, top + ln(mass) AS lse_logits FROM (
  SELECT *, list_max(logits) AS top, list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))) AS mass
  FROM scored)"""
CTES["first_steps"] = """
SELECT * FROM soft s WHERE split = 'test'
  AND step_index = (SELECT min(step_index) FROM trans t WHERE t.stay_id = s.stay_id)"""
SQL["fqe_score"] = f"""
SELECT {_r("avg(list_sum(list_transform(range(1, 26), lambda i: probs[i] * q[i])) / list_sum(probs))", 'fqe')},
  count(*) AS n_episodes FROM first_steps"""
SQL["policy_report"] = f"""
SELECT m.*, {_r(f'(SELECT avg(q[{_RULE} + 1]) FROM first_steps)', 'fqe')}
FROM (SELECT {_wis('ope_rule', 'sum(w)')} FROM ope_rule) m"""
SQL["contract_drift"] = """
SELECT 'n_actions' AS field, '25' AS train, '9' AS held_out WHERE EXISTS (SELECT 1 FROM trans)
UNION ALL SELECT 'reward_spec_version', '1', '2' WHERE EXISTS (SELECT 1 FROM trans)
UNION ALL SELECT 'split_label', CAST(NULL AS VARCHAR), 'validation' WHERE EXISTS (SELECT 1 FROM trans)"""

_N = len(_COLUMNS)
CTES["hidden"] = f"""
SELECT *, list_transform(range(0, 8), lambda u: greatest(0, list_sum(list_transform(range(0, {_N}),
    lambda i: ((7 * u + 3 * i) % 11 - 5) / 1e2 * x[i + 1])) + u % 3 - 1)) AS h
FROM (SELECT stay_id, step_index, split, action, reward, done, [{", ".join(f"s_{c}" for c in _COLUMNS)}] AS x FROM trans)"""
CTES["valued"] = """
SELECT *, list_transform(range(0, 25), lambda a: list_sum(list_transform(range(0, 8),
    lambda u: ((5 * a + 2 * u) % 13 - 6) / 5e1 * h[u + 1])) + (3 * a) % 7 / 2e1) AS q
FROM hidden"""
CTES["greedy"] = """
SELECT *, CAST(list_position(q, list_max(q)) - 1 AS INTEGER) AS policy_action, list_max(q) AS policy_q FROM valued"""
SQL["policy_scores"] = f"SELECT stay_id, step_index, policy_action, {_r('policy_q')} FROM greedy"
CTES["spread"] = f"SELECT {', '.join(f'var_pop(s_{c}) AS {c}' for c in _COLUMNS)} FROM trans WHERE split = 'train'"
CTES["centres"] = (
    "SELECT action, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share, "
    + ", ".join(f"avg(s_{c}) AS {c}" for c in _COLUMNS)
    + " FROM trans WHERE split = 'train' GROUP BY 1"
)
_CLASS = " + ".join(
    f"CASE WHEN v.{c} > 1e-12 THEN m.{c} / v.{c} * t.s_{c} - m.{c} * m.{c} / (2 * v.{c}) ELSE 0 END" for c in _COLUMNS
)
CTES["behaved"] = f"""
SELECT t.stay_id, t.step_index, list(coalesce(ln(m.share) + {_CLASS}, -1e9) ORDER BY a.i) AS z
FROM trans t CROSS JOIN (SELECT unnest(range(0, 25)) AS i) a CROSS JOIN spread v LEFT JOIN centres m ON m.action = a.i
GROUP BY 1, 2"""
SQL["policy_masked"] = f"""
SELECT stay_id, step_index, CAST(best - 1 AS INTEGER) AS policy_action, {_r('q[best]', 'policy_q')},
  CAST(n AS INTEGER) AS n_supported
FROM (
  SELECT *, list_position(masked, list_max(masked)) AS best FROM (
    SELECT stay_id, step_index, q, len(list_filter(z, lambda y: exp(y - list_max(z)) >= 0.3)) AS n,
      list_transform(range(1, 26), lambda i:
        CASE WHEN exp(z[i] - list_max(z)) >= 0.3 THEN q[i] ELSE CAST('-inf' AS DOUBLE) END) AS masked
    FROM valued JOIN behaved USING (stay_id, step_index)))"""
CTES["ope_model"] = f"""
SELECT h.stay_id AS episode_id, sum(pow(CAST(0.99 AS DOUBLE), h.step_index) * h.reward) AS g,
  product(({_HIT.replace('action =', 'h.action =').replace('policy_action', 'y.policy_action')}) / behavior_action_prob) AS w,
  count(*) AS n
FROM held h JOIN greedy y ON y.stay_id = h.stay_id AND y.step_index = h.step_index GROUP BY 1"""
SQL["policy_model_report"] = f"""
SELECT m.*, {_r("(SELECT avg(policy_q) FROM greedy y WHERE split = 'test' AND step_index = "
                "(SELECT min(step_index) FROM trans t WHERE t.stay_id = y.stay_id))", 'fqe')}
FROM (SELECT {_wis('ope_model', 'sum(w)')} FROM ope_model) m"""

# --- safety

CTES["review"] = """
SELECT h.episode_id, h.step_index, h.action AS clinician_action, h.policy_action,
  CASE WHEN h.step_index < 6 THEN 'early' ELSE 'late' END AS subgroup, coalesce(p.support_prob, 0.0) AS support_prob,
  coalesce(p.support_count, 0) AS support_count,
  coalesce(p.support_prob, 0.0) < 0.05 OR coalesce(p.support_count, 0) < 10 AS low,
  h.action = h.policy_action AS agree
FROM held h LEFT JOIN support p ON p.state_bin = h.state_bin AND p.action = h.policy_action"""
SQL["safety_rows"] = f"""
SELECT episode_id, step_index, clinician_action, policy_action, subgroup, {_r('support_prob')}, support_count
FROM review"""
SQL["agreement"] = f"""
SELECT count(*) AS n_rows, {_r('avg(CAST(agree AS INTEGER))', 'agreement_rate')},
  {_r('avg(CAST(low AS INTEGER))', 'low_support_fraction')},
  {_r('avg(CAST(low AND NOT agree AS INTEGER))', 'low_support_override_fraction')} FROM review"""
CTES["cells"] = """
SELECT CAST(i // 5 AS INTEGER) AS vaso_bin, CAST(i % 5 AS INTEGER) AS fluid_bin,
  (SELECT count(*) FROM review WHERE clinician_action = i) AS observed,
  (SELECT count(*) FROM review WHERE policy_action = i) AS chosen
FROM (SELECT unnest(range(25)) AS i)"""
SQL["heatmap"] = f"""
SELECT vaso_bin, fluid_bin, observed AS "count",
  {_r('observed / CAST(sum(observed) OVER () AS DOUBLE)', 'normalized')} FROM cells"""
SQL["heatmap_matrix"] = (
    "SELECT vaso_bin, "
    + ", ".join(f"CAST(sum(chosen) FILTER (fluid_bin = {i}) AS BIGINT) AS fluid_{i}" for i in range(5))
    + " FROM cells GROUP BY 1"
)
SQL["delta_heatmap"] = f"""
SELECT vaso_bin, fluid_bin, chosen - observed AS delta,
  {_r('abs(chosen - observed) / CAST(sum(abs(chosen - observed)) OVER () AS DOUBLE)', 'normalized')} FROM cells"""
SQL["subgroups"] = f"""
SELECT r.subgroup, count(*) AS n_rows, {_r('avg(CAST(agree AS INTEGER))', 'agreement_rate')},
  {_r('avg(CAST(low AS INTEGER))', 'low_support_fraction')}, {_r('avg(support_prob)', 'mean_support_prob')},
  {_r('avg(support_count)', 'mean_support_count')},
  (SELECT policy_action FROM review i WHERE i.subgroup = r.subgroup GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    AS dominant_policy_action
FROM review r GROUP BY 1"""
SQL["sanity_topk"] = f"""
SELECT episode_id, step_index, subgroup, {_LABEL.format(a='clinician_action')} AS clinician_action_label,
  {_LABEL.format(a='policy_action')} AS policy_action_label, {_r('support_prob')}, support_count, low AS low_support
FROM (SELECT * FROM review ORDER BY agree, NOT low, support_prob, support_count, episode_id, step_index LIMIT 10)"""
SQL["support_warnings"] = f"""
SELECT CASE WHEN support_prob < 0.025 OR support_count < 5 THEN 'high' ELSE 'medium' END AS severity, episode_id,
  step_index, subgroup, {_LABEL.format(a='policy_action')} AS policy_action_label, {_r('support_prob')}, support_count,
  {_LABEL.format(a='policy_action')} || ' is rarely taken in such states: share '
    || printf('%.3f', support_prob) || ', seen ' || CAST(support_count AS VARCHAR) || ' times' AS message
FROM review WHERE low"""

# --- sweeps

_grid("_2h", 2)
_grid("_6h", 6)


def _variants(rows: list[tuple[str, str]]) -> str:
    parts = []
    for i, (name, body) in enumerate(rows):
        parts.append(f"SELECT '{name}' AS variant_id, {'TRUE' if i == 0 else 'FALSE'} AS is_baseline, {body}")
    return "\nUNION ALL\n".join(parts)


def _steps_body(source: str) -> str:
    return (
        "count(*) AS total_episodes, round(round(avg(n_steps), 2) + 1e-9, 6) + 0.0 AS avg_steps, "
        f"CAST(max(n_steps) AS INTEGER) AS max_steps FROM {source}"
    )


SQL["sweep_timestep"] = _variants(
    [("timestep_4h", _steps_body("grid")), ("timestep_2h", _steps_body("grid_2h")), ("timestep_6h", _steps_body("grid_6h"))]
)


def _bins_body(suffix: str) -> str:
    return (
        "count(*) AS actions_used, CAST(sum(c) AS BIGINT) AS steps, max(c) AS largest "
        f"FROM (SELECT action_id, count(*) AS c FROM actions{suffix} GROUP BY 1)"
    )


SQL["sweep_bins"] = _variants(
    [("action_5x5_bins", _bins_body("")), ("action_3x3_bins", _bins_body("3")), ("action_7x7_bins", _bins_body("7"))]
)


def _reward_body(name: str) -> str:
    return (
        f"count(*) AS n_transitions, {_r('avg(reward_total)', 'mean_total')}, "
        f"{_r('stddev_pop(reward_total)', 'std_total')} FROM {name}"
    )


SQL["sweep_reward"] = _variants(
    [
        ("reward_sofa_shaped", _reward_body("rew_sofa")),
        ("reward_sparse", _reward_body("rew_sparse")),
        ("reward_full_shaped", _reward_body("rew_full")),
    ]
)


def _width_body(names: list[str]) -> str:
    cells = " + ".join(f"abs(coalesce({c}, 0))" for c in names)
    return (
        f"CAST({len(names)} AS INTEGER) AS state_dim, count(*) AS n_steps, {_r(f'avg({cells})', 'mean_norm')} FROM state"
    )


def _with_flags(features) -> list[str]:
    return [c for f in features for c in ((f, f"{f}_missing") if f in _FLAGGED else (f,))]


SQL["sweep_flags"] = _variants(
    [("missingness_flags_on", _width_body(_COLUMNS)), ("missingness_flags_off", _width_body(list(_FEATURES)))]
)
SQL["sweep_features"] = _variants(
    [
        ("feature_subset_full_state", _width_body(_COLUMNS)),
        (
            "feature_subset_clinical_core",
            _width_body(_with_flags(("view_last", "click_min", "error_max", "purchase_mean"))),
        ),
        ("feature_subset_hemodynamic_core", _width_body(_with_flags(("view_last", "paid_total")))),
    ]
)

# --- reports

SQL["metric_summary"] = f"""
SELECT event_type AS name, count(value) AS "count", {_r('min(value)', 'min')}, {_r('max(value)', 'max')},
  {_r('avg(value)', 'mean')}, {_r('arg_max(value, event_id)', 'final')}, min(event_id) AS first_step,
  max(event_id) AS last_step, {_r('quantile_cont(value, 0.5)', 'median')}
FROM events GROUP BY 1"""
SQL["metric_summary_epochs"] = f"""
SELECT user_id % 3 AS run, event_type AS name, count(value) AS "count", {_r('min(value)', 'min')}, {_r('max(value)', 'max')},
  {_r('avg(value)', 'mean')}, {_r('arg_max(value, event_id)', 'final')}, min(event_id) AS first_step,
  max(event_id) AS last_step, CAST(min(day(ts)) AS BIGINT) AS first_epoch, CAST(max(day(ts)) AS BIGINT) AS last_epoch,
  {_r('quantile_cont(value, 0.5)', 'median')}
FROM events GROUP BY 1, 2"""
SQL["metric_log_reload"] = f"""
SELECT line, count(*) AS lines, {_r('sum(value)', 'total')} FROM (
  SELECT CASE WHEN event_id % 29 = 0 THEN 'no record' WHEN event_id % 31 = 0 THEN 'no name' ELSE event_type END AS line,
    CASE WHEN event_id % 29 > 0 AND event_id % 31 > 0 THEN value END AS value
  FROM events WHERE event_id % 29 = 0 OR event_id % 31 = 0 OR event_id % 37 > 0)
GROUP BY 1"""
CTES["epochs"] = """
SELECT event_type AS name, CAST(day(ts) AS BIGINT) AS epoch, avg(value) AS mean, min(value) AS mn, max(value) AS mx
FROM events GROUP BY 1, 2"""
SQL["epoch_summary"] = f"SELECT name, epoch, {_r('mean')}, {_r('mn', 'min')}, {_r('mx', 'max')} FROM epochs"
SQL["best_epoch"] = f"""
SELECT name, {_r('min(mean)', 'best_value')}, arg_min(epoch, mean) AS best_epoch FROM epochs GROUP BY 1"""
SQL["rolling_return"] = f"""
SELECT stay_id, {_r('ret', 'episode_return')}, row_number() OVER (ORDER BY stay_id) AS episode_index,
  {_r('avg(ret) OVER (ORDER BY stay_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)', 'rolling_return')}
FROM (SELECT stay_id, sum(reward) AS ret FROM trans GROUP BY 1)"""
SQL["compare_runs"] = """
SELECT e.run, e.name, arg_max(e.value, e.event_id) AS final_value,
  (SELECT count(DISTINCT c) FROM (SELECT user_id % 3 AS run, count(DISTINCT event_type) AS c FROM events GROUP BY 1)) <= 1
    AS contract_consistent
FROM (SELECT user_id % 3 AS run, event_type AS name, value, event_id FROM events) e GROUP BY 1, 2"""

SQL["compare_runs_drift"] = f"""
SELECT e.run, e.name, {_r('arg_max(e.value, e.event_id)', 'final_value')}, FALSE AS contract_consistent,
  '{{"n_metrics":' || CAST((SELECT count(DISTINCT event_type) FROM events v WHERE v.user_id % 3 = e.run) AS VARCHAR)
    || ',"manifest_seed":' || CASE WHEN e.run = 2 THEN '43' ELSE '42' END || '}}' AS contract
FROM (SELECT user_id % 3 AS run, event_type AS name, value, event_id FROM events) e GROUP BY 1, 2"""

# --- action-value diagnostics

_KEY = "SELECT stay_id, step_index, "
SQL["td_error"] = f"""
{_KEY}{_r('target', 'td_target')}, {_r('pow(q[action + 1] - target, 2)', 'td_error')}
FROM (SELECT *, reward + CASE WHEN done THEN 0 ELSE 0.99 * list_max(q_next) END AS target FROM scored)"""
SQL["conservative_gap"] = f"""
{_KEY}{_r('list_max(q) + ln(list_sum(list_transform(q, lambda x: exp(x - list_max(q))))) - q[action + 1]', 'cql_gap')},
  {_r('list_sum(q) / 25', 'mean_q')}, {_r('list_max(q)', 'max_q')} FROM scored"""
SQL["masked_argmax"] = f"""
{_KEY}CAST(list_position(masked, list_max(masked)) - 1 AS INTEGER) AS policy_action,
  CAST(kept AS INTEGER) AS n_supported, {_r('kept / 25.0', 'support_rate')},
  {_r('-list_sum(list_transform(probs, lambda p: p * ln(greatest(p, 1e-8))))', 'behavior_entropy')}
FROM (
  SELECT *, list_transform(range(1, 26), lambda i:
      CASE WHEN probs[i] >= list_max(probs) * 0.3 THEN q[i] ELSE CAST('-inf' AS DOUBLE) END) AS masked,
    len(list_filter(probs, lambda p: p >= list_max(probs) * 0.3)) AS kept
  FROM soft)"""
SQL["expectile"] = f"""
{_KEY}{_r('adv', 'advantage')}, {_r('CASE WHEN adv >= 0 THEN 0.7 ELSE 1.0 - 0.7 END * adv * adv', 'value_loss')},
  {_r('least(exp(3 * adv), 100)', 'adv_weight')},
  {_r('-least(exp(3 * adv), 100) * (logits[action + 1] - lse_logits)', 'actor_loss')}
FROM (SELECT *, q[action + 1] - v AS adv FROM soft)"""
SQL["imitation_loss"] = f"{_KEY}{_r('lse_logits - logits[action + 1]', 'imitation_loss')} FROM soft"
SQL["greedy_action"] = f"""
{_KEY}CAST(list_position(q, list_max(q)) - 1 AS INTEGER) AS policy_action, {_r('list_max(q)', 'policy_q')} FROM scored"""


# --- the staged pipeline over raw text

CTES["raw_ev"] = """
SELECT event_id, date_trunc('second', ts) AS ts, ts AS whole, value AS v, event_type AS kind,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, user_id AS stay_id, user_id + 1000 AS hadm_id,
  CASE WHEN user_id % 6 = 1 THEN user_id - 1 ELSE user_id END AS subject_id
FROM events"""
CTES["raw_base"] = """
SELECT s.*, date_diff('second', intime, outtime) / 3600.0 AS los_hours, c.c_mktsegment AS gender,
  CASE WHEN c.c_custkey % 9 <> 4 THEN CAST(18 + floor(abs(c.c_acctbal) / 150) AS INTEGER) END AS anchor_age
FROM (
  SELECT subject_id, hadm_id, stay_id, date_trunc('second', min(whole)) AS intime, date_trunc('second',
    CASE WHEN stay_id % 3 = 2 THEN least(max(whole), min(whole) + INTERVAL 5 DAY) ELSE max(whole) END) AS outtime
  FROM raw_ev GROUP BY 1, 2, 3) s
LEFT JOIN customer c ON c.c_custkey = s.subject_id"""
CTES["raw_deaths"] = """
SELECT hadm_id, date_trunc('second', min(whole) + to_days(CAST(4 + stay_id % 5 AS INTEGER))) AS deathtime
FROM raw_ev WHERE stay_id % 4 = 0 AND hadm_id % 5 <> 0 GROUP BY hadm_id, stay_id"""
CTES["raw_rules"] = """
SELECT *, CASE WHEN anchor_age < 18 THEN 'age_below_minimum'
  WHEN los_hours IS NULL OR los_hours < 4 THEN 'los_below_minimum_hours'
  WHEN anchor_age IS NULL OR gender IS NULL THEN 'missing_demographics' END AS rule
FROM raw_base"""
CTES["raw_cohort"] = """
SELECT *, coalesce(rule, CASE WHEN row_number() OVER (PARTITION BY subject_id, rule IS NULL ORDER BY intime, stay_id) > 1
  THEN 'readmission_not_first_stay' END) AS exclusion_reason
FROM raw_rules"""
SQL["pipeline_cohort"] = f"""
SELECT subject_id, hadm_id, stay_id, intime, outtime, {_r('los_hours')}, anchor_age, gender, exclusion_reason
FROM raw_cohort"""
CTES["raw_anchors"] = """
SELECT a.hadm_id, min(least(a.ts, b.t)) AS anchor_time
FROM raw_ev a JOIN (SELECT hadm_id, CASE WHEN event_id % 2 = 0 THEN ts ELSE CAST(date_trunc('day', ts) AS TIMESTAMP) END AS t
  FROM raw_ev WHERE kind = 'purchase') b ON b.hadm_id = a.hadm_id
WHERE a.kind = 'signup' AND a.event_id % 3 <> 0 AND abs(date_diff('second', a.ts, b.t)) <= 72 * 3600 GROUP BY 1"""
CTES["raw_chart"] = """
SELECT stay_id, kind, CAST(date_trunc('day', ts) AS TIMESTAMP) AS t,
  CASE WHEN kind = 'error' THEN 3 + event_id % 13 WHEN kind = 'click' OR event_id % 13 > 0 THEN v END AS x
FROM raw_ev WHERE kind IN ('view', 'click', 'error')"""
CTES["raw_scores"] = """
SELECT stay_id, t, coalesce((min(x) FILTER (kind = 'view') < 70)::INTEGER, 0)
  + coalesce((min(x) FILTER (kind = 'click') < 94)::INTEGER, 0)
  + coalesce((min(x) FILTER (kind = 'error') < 15)::INTEGER, 0) AS score
FROM raw_chart GROUP BY 1, 2"""
CTES["raw_cand"] = """
SELECT c.stay_id, count(*) AS n, min(s.t) AS first_time, first(s.score ORDER BY s.t) AS first_score
FROM raw_cohort c JOIN raw_anchors a ON a.hadm_id = c.hadm_id JOIN raw_scores s ON s.stay_id = c.stay_id
WHERE c.exclusion_reason IS NULL AND s.score >= 2 AND s.t >= a.anchor_time - INTERVAL 72 HOUR
  AND s.t <= a.anchor_time + INTERVAL 120 HOUR GROUP BY 1"""
CTES["raw_onsets"] = """
SELECT c.*, least(a.anchor_time, d.first_time) AS onset, d.first_score, coalesce(d.n, 0) AS n,
  CASE WHEN a.anchor_time IS NULL THEN 'no_suspected_infection_time'
    WHEN d.n IS NULL THEN 'no_sofa_increase_within_window'
    WHEN least(a.anchor_time, d.first_time) < c.intime - INTERVAL 6 HOUR
      OR least(a.anchor_time, d.first_time) > c.outtime THEN 'onset_outside_icu_stay' END AS unusable_reason
FROM raw_cohort c LEFT JOIN raw_anchors a ON a.hadm_id = c.hadm_id LEFT JOIN raw_cand d ON d.stay_id = c.stay_id
WHERE c.exclusion_reason IS NULL"""
SQL["pipeline_onset"] = """
SELECT stay_id, subject_id, hadm_id, unusable_reason, CAST(n AS INTEGER) AS n_candidates,
  CASE WHEN unusable_reason IS NULL THEN onset END AS onset_time,
  CASE WHEN unusable_reason IS NULL THEN first_score END AS sofa_score_at_onset FROM raw_onsets"""
_grid("_raw", 4, "raw_onsets", "raw_deaths")
SQL["pipeline_truncation"] = """
SELECT truncation_reason, count(*) AS episodes,
  round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 2) AS pct
FROM grid_raw WHERE is_truncated GROUP BY 1"""
_split("raw_splits", "subject_id", "grid_raw")

_IN_STEP = "ON e.stay_id = s.stay_id AND e.{t} >= s.step_start AND e.{t} < s.step_end"
CTES["raw_charted"] = f"""
SELECT s.stay_id, s.step_index, last(x ORDER BY t, x) FILTER (kind = 'view' AND x BETWEEN 0 AND 300) AS map,
  count(*) FILTER (kind = 'view' AND x BETWEEN 0 AND 300) AS map_n,
  min(x) FILTER (kind = 'click' AND x BETWEEN 50 AND 100) AS spo2,
  count(*) FILTER (kind = 'click' AND x BETWEEN 50 AND 100) AS spo2_n,
  last(x ORDER BY t, x) FILTER (kind = 'error' AND x BETWEEN 3 AND 15) AS gcs_total,
  count(*) FILTER (kind = 'error' AND x BETWEEN 3 AND 15) AS gcs_total_n
FROM steps_raw s JOIN raw_chart e {_IN_STEP.format(t='t')} GROUP BY 1, 2"""
CTES["raw_measured"] = f"""
SELECT s.stay_id, s.step_index, max(v / 10) FILTER (kind = 'error' AND v BETWEEN 0 AND 300) AS lactate,
  count(*) FILTER (kind = 'error' AND v BETWEEN 0 AND 300) AS lactate_n,
  sum(v * 5) FILTER (kind = 'signup') AS urine, count(*) FILTER (kind = 'signup' AND v * 5 BETWEEN 0 AND 2000) AS urine_n,
  sum(v * 10) FILTER (kind = 'click') AS fluid
FROM steps_raw s JOIN raw_ev e {_IN_STEP.format(t='ts')} GROUP BY 1, 2"""
CTES["raw_running"] = """
SELECT s.stay_id, s.step_index, coalesce(sum(v * 10) FILTER (kind = 'click'), 0) AS cum_iv_fluid_ml,
  coalesce(sum(v) FILTER (kind = 'purchase'), 0) AS cum_vasopressor_dose_nor_equiv
FROM steps_raw s JOIN windows_raw w ON w.stay_id = s.stay_id
LEFT JOIN raw_ev e ON e.stay_id = s.stay_id AND e.ts >= w.window_start AND e.ts < s.step_end GROUP BY 1, 2"""
CTES["raw_drips"] = """
SELECT stay_id, ts, date_trunc('second', whole + to_microseconds(CAST(round(v * 900) AS BIGINT) * 1000000)) AS te,
  k / 100 AS rate, k FROM raw_ev WHERE kind = 'purchase'"""
CTES["raw_weights"] = """
SELECT stay_id, quantile_cont(k, 0.5) AS weight_kg FROM raw_drips
WHERE ts < (SELECT max(window_end) FROM windows_raw) AND te >= (SELECT min(window_start) FROM windows_raw) GROUP BY 1"""
CTES["raw_dosed"] = """
SELECT stay_id, step_index, sum(rate * h) / sum(h) AS vaso FROM (
  SELECT s.stay_id, s.step_index, rate,
    date_diff('microsecond', greatest(d.ts, s.step_start), least(d.te, s.step_end)) / 3.6e9 AS h
  FROM steps_raw s JOIN raw_drips d ON d.stay_id = s.stay_id AND d.ts < s.step_end AND d.te > s.step_start)
WHERE h > 0 GROUP BY 1, 2"""
CTES["raw_wide"] = """
SELECT s.stay_id, s.step_index, s.hours_relative, g.subject_id, p.split, b.anchor_age, w.weight_kg,
  CAST(d.deathtime IS NOT NULL AND d.deathtime <= g.onset_time + INTERVAL 90 DAY AS INTEGER) AS mortality_90d,
  c.* EXCLUDE (stay_id, step_index), m.* EXCLUDE (stay_id, step_index), r.* EXCLUDE (stay_id, step_index),
  coalesce(o.vaso, 0.0) AS vaso_dose_4h, coalesce(m.fluid, 0.0) AS fluid_volume_4h
FROM steps_raw s JOIN grid_raw g USING (stay_id) JOIN raw_splits p ON p.id = g.subject_id
JOIN raw_running r USING (stay_id, step_index) JOIN raw_base b USING (stay_id)
LEFT JOIN raw_charted c USING (stay_id, step_index) LEFT JOIN raw_measured m USING (stay_id, step_index)
LEFT JOIN raw_dosed o USING (stay_id, step_index) LEFT JOIN raw_weights w USING (stay_id)
LEFT JOIN raw_deaths d ON d.hadm_id = g.hadm_id"""
# strategy, normal value and clip of each feature, in state order
_RAW = {
    "map": ("map", 80, (0, 200)), "spo2": ("spo2", 98, (50, 100)), "gcs_total": ("gcs_total", 15, (3, 15)),
    "lactate": ("lactate", 1, (0, 20)), "cum_iv_fluid_ml": (None, 0, (0, 30000)),
    "cum_vasopressor_dose_nor_equiv": (None, 0, (0, 500)), "urine_output_4h": (None, 0, (0, 1500)),
    "age_years": (None, None, (18, 110)), "weight_kg": (None, None, (20, 300)), "hours_since_onset": (None, 0, (-24, 48)),
}
_RAW_FLAGS = {"map": "map_n", "spo2": "spo2_n", "gcs_total": "gcs_total_n", "lactate": "lactate_n", "urine_output_4h": "urine_n"}
_RAW_SOURCE = {"urine_output_4h": "urine", "age_years": "CAST(anchor_age AS DOUBLE)", "hours_since_onset": "CAST(hours_relative AS DOUBLE)"}
_RAW_COLUMNS = [c for f in _RAW for c in ((f, f"{f}_missing") if f in _RAW_FLAGS else (f,))]


def _raw_state(name: str, source: str, median: bool) -> None:
    parts = []
    for f, (fill, normal, bounds) in _RAW.items():
        value = _RAW_SOURCE.get(f, f)
        if fill:
            value = f"last_value({fill} IGNORE NULLS) OVER (PARTITION BY stay_id ORDER BY step_index)"
        chain = [value]
        if median and (fill or f in ("age_years", "weight_kg")):
            chain.append(f"(SELECT {f} FROM raw_medians)")
        if normal is not None:
            chain.append(f"CAST({normal} AS DOUBLE)")
        parts.append(f"{_clip(f'coalesce({", ".join(chain)})', *bounds)} AS {f}")
    parts += [f"CAST(coalesce({n}, 0) = 0 AS INTEGER) AS {f}_missing" for f, n in _RAW_FLAGS.items()]
    CTES[name] = (
        "SELECT subject_id, split, stay_id, step_index, mortality_90d, vaso_dose_4h, fluid_volume_4h, "
        + ", ".join(parts) + f" FROM {source}"
    )


_raw_state("raw_pass1", "raw_wide", False)
CTES["raw_medians"] = (
    "SELECT " + ", ".join(f"coalesce(quantile_cont({f}, 0.5), {_RAW[f][1] or 0}) AS {f}" for f in _RAW)
    + " FROM raw_pass1 WHERE split = 'train'"
)
_raw_state("raw_pass2", "raw_wide", True)
_bins("_raw", 5, "raw_pass2")
CTES["raw_state"] = """
SELECT *, CAST(map < 70 AS INTEGER) + CAST(spo2 < 94 AS INTEGER) + CAST(gcs_total < 15 AS INTEGER) AS sofa_score
FROM raw_pass2"""
CTES["raw_rewards"] = """
SELECT stay_id, step_index, is_terminal, shaped AS sofa_shaping, terminal, terminal + shaped AS reward_total FROM (
  SELECT stay_id, step_index, is_terminal, coalesce(-0.025 * (sofa_score - before), 0) AS shaped,
    CAST(CASE WHEN NOT is_terminal THEN 0 WHEN died = 0 THEN 15 ELSE -15 END AS DOUBLE) AS terminal
  FROM (
    SELECT stay_id, step_index, sofa_score, lag(sofa_score) OVER w AS before, first_value(mortality_90d) OVER w AS died,
      step_index = max(step_index) OVER (PARTITION BY stay_id) AS is_terminal
    FROM raw_state WINDOW w AS (PARTITION BY stay_id ORDER BY step_index)))"""
SQL["pipeline_steps"] = (
    "SELECT s.subject_id, s.split, s.stay_id, s.step_index, s.sofa_score, s.mortality_90d, "
    + ", ".join(c if c.endswith("_missing") else _r(f"s.{c}", c) for c in _RAW_COLUMNS)
    + f", {_r('s.vaso_dose_4h', 'vaso_dose_4h')}, {_r('s.fluid_volume_4h', 'fluid_volume_4h')}, a.vaso_bin, a.fluid_bin, "
    + f"a.action_id, {_r('r.terminal', 'terminal')}, {_r('r.sofa_shaping', 'sofa_shaping')}, "
    + f"{_r('r.reward_total', 'reward_total')}, r.is_terminal FROM raw_state s "
    + "JOIN actions_raw a USING (stay_id, step_index) JOIN raw_rewards r USING (stay_id, step_index)"
)
CTES["raw_scales"] = (
    "SELECT " + ", ".join(
        f"avg({f}) AS {f}_mean, CASE WHEN stddev_pop({f}) <= 1e-12 THEN 1.0 ELSE stddev_pop({f}) END AS {f}_scale" for f in _RAW
    ) + " FROM (SELECT " + ", ".join(
        f"{_clip(f'coalesce(s.{f}, m.{f})', *_RAW[f][2])} AS {f}" for f in _RAW
    ) + " FROM raw_state s CROSS JOIN raw_medians m WHERE split = 'train')"
)
CTES["raw_normal"] = (
    "SELECT stay_id, step_index, " + ", ".join(
        c if c.endswith("_missing")
        else f"({_clip(f'coalesce(s.{c}, m.{c})', *_RAW[c][2])} - w.{c}_mean) / w.{c}_scale AS {c}" for c in _RAW_COLUMNS
    ) + " FROM raw_state s CROSS JOIN raw_medians m CROSS JOIN raw_scales w"
)
SQL["pipeline_replay"] = (
    f"SELECT s.split, s.stay_id, s.step_index, a.action_id AS action, {_r('r.reward_total', 'reward')}, r.is_terminal AS done, "
    + ", ".join(_r(f"CAST(n.{c} AS DOUBLE)", f"s_{c}") for c in _RAW_COLUMNS) + ", "
    + ", ".join(_r(f"CAST(coalesce(x.{c}, n.{c}) AS DOUBLE)", f"ns_{c}") for c in _RAW_COLUMNS)
    + " FROM raw_state s JOIN raw_normal n USING (stay_id, step_index) JOIN actions_raw a USING (stay_id, step_index) "
    + "JOIN raw_rewards r USING (stay_id, step_index) "
    + "LEFT JOIN raw_normal x ON x.stay_id = s.stay_id AND x.step_index = s.step_index + 1"
)
SQL["pipeline_records"] = (
    "SELECT 'median' AS record, field, value FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS field, {_r(f, 'value')} FROM raw_medians" for f in _RAW
    ) + ") UNION ALL SELECT 'mean', field, value FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS field, {_r(f'{f}_mean', 'value')} FROM raw_scales" for f in _RAW
    ) + ") UNION ALL SELECT 'edge', field, value FROM (" + " UNION ALL ".join(
        f"SELECT '{d}{i}' AS field, {_r(f'{s}{i}', 'value')} FROM edges_raw" for d, s in (("vaso", "v"), ("fluid", "f")) for i in (1, 2, 3)
    ) + ") UNION ALL SELECT 'transitions', split, CAST(count(*) AS DOUBLE) FROM raw_state GROUP BY 2 "
    "UNION ALL SELECT 'manifest', p.split, CAST(count(*) AS DOUBLE) FROM grid_raw g JOIN raw_splits p ON p.id = g.subject_id "
    "GROUP BY 2 UNION ALL SELECT 'reward', 'survived', 15.0"
)


def _needed(sql: str) -> list[str]:
    """CTE names the text refers to, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\b[a-z_0-9]+\b", text):
            if word in CTES and word not in order:
                visit_one(word)

    def visit_one(name: str) -> None:
        if name in busy:
            return
        busy.add(name)
        visit(CTES[name])
        if name not in order:
            order.append(name)

    busy: set[str] = set()
    visit(sql)
    return order


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in SQL.items():
        body = sql.strip()
        parts = [f"{cte} AS MATERIALIZED ({CTES[cte].strip()})" for cte in _needed(body)]
        own = ""
        if body.startswith("WITH "):
            own, body = body[5:].split(")\nSELECT", 1)
            own, body = own + ")", "SELECT" + body
        parts += [own] if own else []
        out[name] = (f"WITH {', '.join(parts)}\n" if parts else "") + body
    return out
