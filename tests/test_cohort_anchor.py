import random
from datetime import timedelta

import pytest
from conftest import T0, at, rows_of
from pyspark.sql import functions as F

from stepweave.operators import anchor
from stepweave.operators import cohort as coh

BASE = (
    "subject_id long, hadm_id long, stay_id long, anchor_age int, gender string, los_hours double, "
    "intime timestamp_ntz, outtime timestamp_ntz, deathtime timestamp_ntz, hospital_expire_flag int"
)


def stay(subject=1, hadm=100, stay=1000, age=55, gender="M", los=48.0, start=0):
    return (subject, hadm, stay, age, gender, los, at(start), at(start + 48), None, 0)


def reasons(spark, rows, rules=coh.CohortRules()):
    df = spark.createDataFrame(rows, BASE)
    return {r.stay_id: r.exclusion_reason for r in coh.label_exclusions(df, rules).collect()}


def test_each_rule_and_first_failure_wins(spark):
    rows = [
        stay(1, stay=1),
        stay(2, stay=2, age=17, los=1.0),
        stay(3, stay=3, los=1.0),
        stay(4, stay=4, gender=None),
        stay(5, stay=5, age=None),
        stay(6, stay=6, age=95),
        stay(7, stay=7, los=None),
    ]
    got = reasons(spark, rows, coh.CohortRules(max_age=90))
    assert got == {
        1: None, 2: coh.AGE_BELOW_MIN, 3: coh.LOS_TOO_SHORT, 4: coh.MISSING_DEMOGRAPHICS, 5: coh.MISSING_DEMOGRAPHICS,
        6: coh.AGE_ABOVE_MAX, 7: coh.LOS_TOO_SHORT,
    }


def test_null_policy_drop_loses_null_ages(spark):
    got = reasons(spark, [stay(1, stay=1), stay(2, stay=2, age=None)], coh.CohortRules(null_policy="drop"))
    assert got == {1: None}


def test_first_stay_is_chosen_among_survivors(spark):
    rows = [stay(1, stay=10, start=0, los=1.0), stay(1, stay=11, start=24), stay(1, stay=12, start=48)]
    got = reasons(spark, rows)
    assert got == {10: coh.LOS_TOO_SHORT, 11: None, 12: coh.READMISSION}
    kept_all = reasons(spark, rows, coh.CohortRules(first_stay_only=False))
    assert kept_all[12] is None


def test_funnel_is_complete_and_audited(spark):
    rows = [stay(i % 7, stay=i, age=10 + i % 50, los=float(i % 30), start=i) for i in range(100)]
    base = spark.createDataFrame(rows, BASE)
    included, excluded = coh.cohort_funnel(base)
    assert coh.funnel_completeness(included, excluded, base).count() == 0
    assert included.count() + excluded.count() == 100
    audit = coh.cohort_audit(coh.label_exclusions(base)).first()
    assert audit.included == included.count() and audit.unique_patients == audit.included
    summary = coh.exclusion_summary(excluded).collect()
    assert sum(r["count"] for r in summary) == excluded.count()
    assert [r["count"] for r in summary] == sorted((r["count"] for r in summary), reverse=True)
    doubled = coh.funnel_completeness(included.union(included), excluded, base)
    assert {r.violation for r in doubled.collect()} == {"count_mismatch", "duplicate_included_stay"}


def test_merge_base_keeps_stays_without_a_patient(spark):
    stays = spark.createDataFrame([(1, 5, 9), (None, 6, 10)], "subject_id long, hadm_id long, stay_id long")
    people = spark.createDataFrame([(1, 40, "F")], "subject_id long, anchor_age int, gender string")
    adm = spark.createDataFrame([(5, None, 0)], "hadm_id long, deathtime timestamp_ntz, hospital_expire_flag int")
    got = {r.stay_id: (r.anchor_age, r.hospital_expire_flag) for r in coh.merge_base(stays, people, adm).collect()}
    assert got == {9: (40, 0), 10: (None, None)}


def brute_anchor(a, b, gap):
    best = {}
    for k, x in a:
        for j, y in b:
            if k == j and abs(x - y) <= gap:
                best[k] = min(best.get(k, x), x, y)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_anchor_equals_all_pairs(spark, seed):
    rng = random.Random(seed)

    def orders(n):
        return [(rng.randrange(12), T0 + timedelta(hours=rng.choice([24, 72, 1]) * rng.randrange(20))) for _ in range(n)]

    a, b = orders(40), orders(25)
    # exactly at, and just beyond, the gap
    a += [(90, T0), (91, T0), (92, T0), (92, T0 + timedelta(hours=100))]
    b += [(90, T0 + timedelta(hours=72)), (91, T0 + timedelta(hours=72, seconds=1)), (92, T0 + timedelta(hours=120))]
    schema = "k long, t timestamp_ntz"
    got = anchor.suspected_anchor(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "k", "t")
    assert {r.k: r.anchor_time for r in got.collect()} == brute_anchor(a, b, timedelta(hours=72))


def test_anchor_with_a_key_holding_most_orders(spark):
    rng = random.Random(1)
    a = [(0, T0 + timedelta(minutes=rng.randrange(500_000))) for _ in range(300)] + [(1, T0)]
    b = [(0, T0 + timedelta(minutes=rng.randrange(500_000))) for _ in range(300)]
    schema = "k long, t timestamp_ntz"
    got = anchor.suspected_anchor(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "k", "t")
    assert {r.k: r.anchor_time for r in got.collect()} == brute_anchor(a, b, timedelta(hours=72))


def test_dysfunction_score(spark):
    events = [
        (1, 1, 1, T0, 1, 60.0), (1, 1, 1, T0, 1, 90.0), (1, 1, 1, T0, 2, 99.0), (1, 1, 1, T0, 3, 14.0),
        (1, 1, 1, at(1), 2, 93.0), (1, 1, 1, at(1), 2, None),
    ]
    df = spark.createDataFrame(
        events, "subject_id long, hadm_id long, stay_id long, charttime timestamp_ntz, itemid long, valuenum double"
    )
    got = anchor.dysfunction_score(df, {"a": ((1,), 70), "b": ((2,), 94), "c": ((3,), 15)})
    assert {r.charttime: r.sofa_score for r in got.collect()} == {T0: 2, at(1): 1}


def onset(spark, scores, anchors=((1, 0),), start=-48, end=96):
    stays = spark.createDataFrame(
        [(1, 1, 1, at(start), at(end)), (2, 2, 2, at(start), at(end))],
        "stay_id long, subject_id long, hadm_id long, intime timestamp_ntz, outtime timestamp_ntz",
    )
    anchors = spark.createDataFrame([(h, at(t)) for h, t in anchors], "hadm_id long, anchor_time timestamp_ntz")
    frame = spark.createDataFrame(
        [(s, at(t), v) for s, t, v in scores], "stay_id long, charttime timestamp_ntz, sofa_score int"
    )
    anchored = anchor.attach_anchor(stays, anchors)
    classified = anchor.classify_onset(anchored, frame)
    return {r.stay_id: r for r in classified.collect()}, anchor.onset_candidates(anchored, frame, classified)


def test_onset_window_is_inclusive_and_earliest_wins(spark):
    got, cands = onset(spark, [(1, -24, 2), (1, 24, 4), (1, -24.1, 3), (1, 25, 3), (1, 3, 1)])
    assert got[1].onset_time == at(-24) and got[1].n_candidates == 2 and got[1].sofa_score_at_onset == 2
    assert got[2].unusable_reason == anchor.NO_ANCHOR
    assert [(r.sofa_time, r.selected) for r in cands.orderBy("sofa_time").collect()] == [(at(-24), True), (at(24), False)]


def test_onset_is_the_anchor_when_scores_come_later(spark):
    got, _ = onset(spark, [(1, 5, 2)])
    assert got[1].onset_time == at(0)


def test_onset_reasons_and_grace(spark):
    got, _ = onset(spark, [(1, 0, 1)])
    assert got[1].unusable_reason == anchor.NO_SCORE
    got, cands = onset(spark, [(1, 0, 3)], start=7)
    assert got[1].unusable_reason == anchor.OUTSIDE_STAY and got[1].n_candidates == 1
    assert not any(r.selected for r in cands.collect())
    got, _ = onset(spark, [(1, 0, 3)], start=6)
    assert got[1].unusable_reason is None


def test_onset_audit_shares(spark):
    stays = spark.createDataFrame([(1, None), (2, "x"), (3, "x"), (4, None)], "stay_id long, unusable_reason string")
    assert rows_of(anchor.onset_audit(stays)) == [("usable", 2, 50.0), ("x", 2, 50.0)]
