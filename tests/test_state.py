import pytest
from conftest import at
from pyspark.sql import functions as F

from stepweave.operators import actions as act
from stepweave.operators import features as ft
from stepweave.operators import grid, rewards, scaling
from stepweave.operators import transitions as tr
from stepweave.operators.features import EventSource, FeatureSpec
from stepweave.presets import clinical

EVENTS = "stay_id long, itemid long, valuenum double, charttime timestamp_ntz"


def episodes(spark, inn=-24, out=48, stays=(1,)):
    onsets = spark.createDataFrame(
        [(s, s, s, at(0)) for s in stays], "stay_id long, subject_id long, hadm_id long, onset_time timestamp_ntz"
    )
    bounds = spark.createDataFrame(
        [(s, at(inn), at(out)) for s in stays], "stay_id long, intime timestamp_ntz, outtime timestamp_ntz"
    )
    return grid.grid_episodes(onsets, bounds)


def state(spark, specs, events, medians=None, impute=True, tie=None, **kw):
    registry = ft.make_registry(specs)
    frame = spark.createDataFrame([(1, i, v, at(t)) for i, v, t in events], EVENTS)
    wide = ft.raw_state({"chart": EventSource(frame, "charttime", "valuenum")}, episodes(spark, **kw), registry)
    out = ft.impute_state(wide, registry, medians, impute)
    return [r.asDict() for r in out.orderBy("step_index").collect()]


HR = FeatureSpec("hr", "chart", (1,), "last", ft.FORWARD_FILL, (0, 350), (0, 300), 75.0)
MAP = FeatureSpec("map", "chart", (2,), "last", ft.FORWARD_FILL, (0, 300), (0, 200), 80.0, True)


def test_forward_fill_then_last_value(spark):
    got = state(spark, [HR], [(1, 88.0, -24), (1, 90.0, -23)])
    assert [r["hr"] for r in got] == [90.0] * 18


def test_median_then_normal_at_episode_start(spark):
    assert state(spark, [HR], [(1, 90.0, 0)], {"hr": 55.0})[0]["hr"] == 55.0
    assert state(spark, [HR], [(1, 90.0, 0)])[0]["hr"] == 75.0
    assert state(spark, [HR], [(1, 90.0, 0)], impute=False)[0]["hr"] is None


def test_out_of_range_counts_as_missing(spark):
    got = state(spark, [MAP], [(2, 68.0, -24), (2, 9999.0, -20)])
    assert [r["map"] for r in got[:3]] == [68.0] * 3
    assert [r["map_missing"] for r in got[:3]] == [0, 1, 1]


@pytest.mark.parametrize("rule, want", [("last", 4.0), ("mean", 3.0), ("max", 4.0), ("min", 2.0), ("sum", 9.0)])
def test_rules(spark, rule, want):
    spec = FeatureSpec("x", "chart", (1,), rule, ft.ZERO, (0, 10), (0, 100))
    got = state(spark, [spec], [(1, 3.0, 0), (1, 2.0, 1), (1, 4.0, 2), (1, 50.0, 3)])
    assert got[6]["x"] == want and got[7]["x"] == 0.0


def test_equal_times_are_ordered_by_tie(spark):
    registry = ft.make_registry([HR])
    frame = spark.createDataFrame(
        [(1, 7, 1, 80.0, at(0)), (1, 9, 1, 60.0, at(0)), (1, 8, 1, 70.0, at(0))], "stay_id long, id long, " + EVENTS[14:]
    )
    long = ft.feature_long(EventSource(frame, "charttime", "valuenum", tie="id"), episodes(spark), [HR])
    assert long.first().value == 60.0
    plain = ft.feature_long(EventSource(frame, "charttime", "valuenum"), episodes(spark), [HR])
    assert plain.first().value == 80.0
    assert registry


def test_running_total_includes_time_before_the_first_step(spark):
    spec = FeatureSpec("total", "chart", (1,), "cumulative", ft.ZERO, (0, 50), (0, 1000), check_range=False)
    got = state(spark, [spec], [(1, 5.0, -24), (1, 500.0, -10), (1, 7.0, 1), (1, 9.0, -24.5)], inn=-2)
    assert got[0]["step_index"] == 5
    assert [r["total"] for r in got[:3]] == [505.0, 512.0, 512.0]


@pytest.mark.parametrize("times", [(-20, -19, -18), (-20, -19, -14), (-20, -14, -13), (-14, -20, -8), (-8, -14, -20)])
def test_running_total_does_not_depend_on_the_steps_of_its_events(spark, times):
    spec = FeatureSpec("total", "chart", (1,), "cumulative", ft.ZERO, (0, 50), (0, 1000), check_range=False)
    got = state(spark, [spec], [(1, v, t) for v, t in zip((0.1, 0.2, 0.3), times)])
    assert got[-1]["total"] == 0.6


def test_derived_ratio_uses_imputed_parents(spark):
    a = FeatureSpec("a", "chart", (1,), "last", ft.FORWARD_FILL, (0, 100), (0, 50), 10)
    b = FeatureSpec("b", "chart", (2,), "last", ft.FORWARD_FILL, (0, 10), (0, 5), 2)
    r = FeatureSpec("r", "derived", (), "last", ft.MEDIAN, (0, 1), (0, 20), 7.0, True, ("a", "b"))
    got = state(spark, [r, a, b], [(1, 90.0, -24), (2, 0.0, -20)])
    assert got[0]["r"] == 20.0 and got[1]["r"] == 7.0 and {x["r_missing"] for x in got} == {1}


def test_rows_follow_the_grid_without_events(spark):
    got = state(spark, [MAP], [], out=10)
    assert len(got) == 9 and {r["map"] for r in got} == {80.0} and {r["map_missing"] for r in got} == {1}


def test_registry_rules():
    with pytest.raises(ValueError, match="normal value"):
        ft.make_registry([FeatureSpec("x", "s", (1,), missing=ft.NORMAL)])
    with pytest.raises(ValueError, match="range"):
        ft.make_registry([FeatureSpec("x", "s", (1,), valid=(2, 1))])
    with pytest.raises(ValueError, match="twice"):
        ft.make_registry([HR, HR])
    with pytest.raises(ValueError, match="parent"):
        ft.make_registry([FeatureSpec("x", "derived", parents=("a", "b"))])


def test_ratio_of_ratios_in_any_order(spark):
    a = FeatureSpec("a", "chart", (1,), "last", ft.FORWARD_FILL, (0, 100), (0, 50), 10)
    b = FeatureSpec("b", "chart", (2,), "last", ft.FORWARD_FILL, (0, 10), (0, 5), 2)
    up = FeatureSpec("up", "derived", (), "last", ft.MEDIAN, (0, 1), (0, 20), 7.0, parents=("a", "b"))
    down = FeatureSpec("down", "derived", (), "last", ft.MEDIAN, (0, 1), (0, 20), 4.0, parents=("b", "a"))
    both = FeatureSpec("both", "derived", (), "last", ft.MEDIAN, (0, 1), (0, 400), 1.0, True, ("up", "down"))
    top = FeatureSpec("top", "derived", (), "last", ft.MEDIAN, (0, 1), (0, 900), 1.0, False, ("both", "up"))
    registry = ft.make_registry([top, both, down, up, b, a])
    assert ft.derived_levels(registry) == [["down", "up"], ["both"], ["top"]]
    got = state(spark, [top, both, down, up, b, a], [(1, 30.0, -24), (2, 4.0, -24), (2, 0.0, -20)])
    assert got[0]["up"] == 7.5 and got[0]["down"] == pytest.approx(4 / 30)
    assert got[0]["both"] == pytest.approx(7.5 / (4 / 30)) and got[0]["top"] == pytest.approx(7.5 / (4 / 30) / 7.5)
    # b = 0: up takes its normal value, down is 0, both its own normal value
    assert (got[1]["up"], got[1]["down"], got[1]["both"]) == (7.0, 0.0, 1.0)
    assert {r["both_missing"] for r in got} == {1}


def test_cycles_are_reported():
    def ratio_of(name, *parents):
        return FeatureSpec(name, "derived", parents=parents)

    with pytest.raises(ValueError, match="depend on each other: .*->"):
        ft.make_registry([HR, ratio_of("x", "y", "hr"), ratio_of("y", "z", "hr"), ratio_of("z", "x", "hr")])
    with pytest.raises(ValueError, match="depend on each other: x -> x"):
        ft.make_registry([HR, ratio_of("x", "x", "hr")])
    with pytest.raises(ValueError, match="both items and parents"):
        ft.make_registry([HR, FeatureSpec("x", "derived", (1,), parents=("hr", "hr"))])


def test_an_item_may_serve_several_features(spark):
    low = FeatureSpec("low", "chart", (1, 2), "min", ft.ZERO, (0, 50), (0, 100))
    got = state(spark, [HR, low, MAP], [(1, 88.0, -24), (1, 20.0, -23), (2, 40.0, -23), (2, 9999.0, -22)])
    assert (got[0]["hr"], got[0]["low"], got[0]["map"]) == (20.0, 20.0, 40.0)


def test_dictionary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(ft, "MAX_DICTIONARY", 1)
    with pytest.raises(ValueError, match="too large"):
        ft.item_dictionary(spark, [HR, MAP], ft.RULES, "long")


def test_feature_of_a_source_not_given_is_never_observed(spark):
    lab = FeatureSpec("lab", "lab", (9,), "last", ft.NORMAL, normal=3.0, flag=True)
    got = state(spark, [HR, lab], [(1, 88.0, -24), (9, 1.0, -24)])
    assert {(r["lab"], r["lab_missing"]) for r in got} == {(3.0, 1)}


def test_equal_times_without_tie_go_by_item_then_value(spark):
    spec = FeatureSpec("x", "chart", (5, 3, 4), "last", ft.ZERO, (-1e9, 1e9))
    for values, want in (
        ([(5, 9.0), (3, 1.0), (4, -7.0)], -7.0),
        ([(3, -1.0), (3, -2.0)], -1.0),
        ([(3, 0.1), (3, 0.1 + 2e-17), (3, 0.30000000000000004), (3, 0.3)], 0.30000000000000004),
        ([(4, None), (4, 1e10), (3, 5.0)], 5.0),
        ([(4, float("nan")), (3, -5e-324), (3, -1.0)], -5e-324),
    ):
        got = state(spark, [spec], [(i, v, 0) for i, v in values], impute=False)
        raw = {r["x"] for r in got if r["x"] is not None}
        assert raw == {want}


def test_sortable_orders_doubles(spark):
    import random
    import struct

    from stepweave.functions.scalars import sortable

    rng = random.Random(1)
    values = [struct.unpack("d", rng.randbytes(8))[0] for _ in range(3_000)]
    values += [2.0**k * f for k in range(-1074, 1024, 7) for f in (1, -1)] + [2.0**k - 2.0 ** (k - 53) for k in range(-900, 900, 11)]
    values += [0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf")]
    values = sorted({v for v in values if v == v})
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    keys = [r.k for r in frame.select("i", sortable(F.col("v")).alias("k")).orderBy("i").collect()]
    assert all(a < b for a, b in zip(keys, keys[1:]))
    none = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert [r[0] for r in none.select(sortable(F.col("v"))).collect()] == [None, None]


def test_registered_rules_get_their_parameters(spark):
    rules = ft.with_rules(
        spark,
        {
            "above": ft.Rule(lambda value, order, weight, limit, unit=1.0: F.sum((value > limit).cast("double") * unit)),
            "peak": ft.Rule(lambda value, order, weight: F.max(value), running=F.max),
        },
        trial={"above": {"limit": 1.0}},
    )
    specs = [
        FeatureSpec("over3", "chart", (1,), "above", ft.ZERO, params=(("limit", 3.0),)),
        FeatureSpec("over1", "chart", (1,), "above", ft.ZERO, params=(("limit", 1.0), ("unit", 10.0))),
        FeatureSpec("peak", "chart", (1,), "peak", ft.ZERO),
    ]
    registry = ft.make_registry(specs, rules)
    frame = spark.createDataFrame([(1, 1, v, at(t)) for v, t in ((2.0, -24), (5.0, -23), (4.0, -20))], EVENTS)
    wide = ft.raw_state({"chart": EventSource(frame, "charttime", "valuenum")}, episodes(spark), registry, rules=rules)
    got = wide.orderBy("step_index").collect()
    assert [(r.over3, r.over1) for r in got[:3]] == [(1.0, 20.0), (1.0, 10.0), (None, None)]
    assert [r.peak for r in got[:3]] == [5.0, 5.0, 5.0]
    for params, message in (((), "needs"), ((("limit", 1.0), ("more", 2)), "takes")):
        with pytest.raises(ValueError, match=message):
            ft.make_registry([FeatureSpec("x", "chart", (1,), "above", params=params)], rules)


def test_rules_that_cannot_be_merged_are_refused(spark):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def median(v: pd.Series) -> float:
        return float(v.median())

    for rule, message in (
        (lambda value, order, weight: F.element_at(F.collect_list(value), 1), "gathers"),
        (lambda value, order, weight: F.percentile(value, 0.5), "gathers"),
        (lambda value, order, weight: median(value), "cannot be merged"),
        (lambda value, order, weight: value + 1, "not an aggregate"),
    ):
        with pytest.raises(ValueError, match=message):
            ft.with_rules(spark, {"own": ft.Rule(rule)})
    with pytest.raises(ValueError, match="defined already"):
        ft.with_rules(spark, {"last": ft.RULES["last"]})
    assert ft.rule_problem(spark, ft.RULES["last"], {}) is None


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_events_treatments_and_steps_meet_in_one_exchange_by_stay(spark):
    specs = [HR, MAP, FeatureSpec("total", "chart", (1,), "cumulative", ft.ZERO)]
    registry = ft.make_registry(specs)
    frame = spark.createDataFrame([(1, 1, 5.0, at(0))], EVENTS)
    drips = spark.createDataFrame(
        [(1, 7, at(0), at(1), 100.0, 1.0)],
        "stay_id long, itemid long, starttime timestamp_ntz, endtime timestamp_ntz, amount double, standard_rate double",
    )
    eps = episodes(spark)
    given = act.treatments(drips, drips, eps, (7,))
    wide = ft.raw_state({"chart": EventSource(frame, "charttime", "valuenum")}, eps, registry, placed=given)
    plan = exchanges(wide)
    assert "SortAggregate" not in plan
    # each input is dealt by stay once, below the union; nothing is dealt again above it
    lines = plan.splitlines()
    dealt = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(" in line]
    assert dealt and all("step_index" not in lines[i] for i in dealt)
    assert min(dealt) > next(i for i, line in enumerate(lines) if line.strip().endswith("Union"))

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stored = spark.createDataFrame(
            [(1, 0, 1, 0, 80.0, 1, 60.0, 1, 1.0, 1, 1.0, 0.0, 0, "train")],
            "stay_id long, step_index int, mortality_90d int, hours_relative int, hr double, hr__n long, map double, "
            "map__n long, total double, total__n long, vaso_dose_4h double, fluid_volume_4h double, sofa int, split string",
        )
        acted = act.assign_bins(stored, act.ActionBins((1.0,), (1.0,), 3))
        imputed = ft.impute_state(acted, registry).withColumn("sofa_score", F.lit(1))
        rewarded = rewards.with_rewards(imputed, lactate="total")
        linked = exchanges(tr.build_transitions(rewarded, ft.feature_columns(registry)))
        assert linked.count("Exchange hashpartitioning") == 1 and linked.count("Sort [") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_feature_selection():
    registry = ft.make_registry([HR, MAP])
    warned = []
    assert list(ft.select_features(registry, ["map"])) == ["map"]
    assert list(ft.select_features(registry, exclude=["hr", "zz"], warn=warned.append)) == ["map"] and warned
    with pytest.raises(ValueError):
        ft.select_features(registry, ["zz"])
    assert ft.feature_columns(registry) == ["hr", "map", "map_missing"]
    assert ft.feature_columns(ft.select_features(registry, flags=False)) == ["hr", "map"]
    assert ft.feature_columns(ft.select_features(registry, flags=True)) == ["hr", "hr_missing", "map", "map_missing"]


def test_clinical_dictionary(spark):
    registry = clinical.clinical_registry()
    assert len(registry) == 37 and len(ft.feature_columns(registry)) == 62
    assert registry["pf_ratio"].parents == ("pao2", "fio2_vent") and registry["spo2"].agg == "min"
    assert ft.items_of(registry, "lab")[0] == 50802
    summary = {(r.kind, r.value): r.features for r in ft.registry_summary(ft.registry_frame(spark, registry)).collect()}
    assert summary["agg", "cumulative"] == 2 and summary["source", "lab"] == 19


def test_static_weight_is_the_median(spark):
    df = spark.createDataFrame([(1, 70.0), (1, 80.0), (1, 90.0), (1, None), (2, 60.0), (2, 61.0)], "stay_id long, patientweight double")
    assert {r.stay_id: r.weight_kg for r in ft.static_weight(df).collect()} == {1: 80.0, 2: 60.5}


def test_outcome_label(spark):
    eps = episodes(spark, stays=(1, 2, 3))
    deaths = spark.createDataFrame([(1, at(90 * 24)), (2, at(90 * 24 + 1)), (3, None)], "hadm_id long, deathtime timestamp_ntz")
    assert {r.stay_id: r.mortality_90d for r in ft.outcome_label(eps, deaths).collect()} == {1: 1, 2: 0, 3: 0}


def test_proxy_score(spark):
    df = spark.createDataFrame([(60.0, 90.0, 15.0)], "map double, spo2 double, gcs_total double")
    assert ft.clinical_proxy(df, clinical.PROXY_LIMITS).first().sofa_score == 2


TRAIN = "subject_id long, stay_id long, step_index int, split string, heart_rate double, heart_rate_missing int"
SPEC = {"heart_rate": FeatureSpec("heart_rate", "chart", (1,), clip=(0, 100), normal=75.0)}


def fit(spark, rows):
    df = spark.createDataFrame([(i, i, 0, s, v, 1) for i, (s, v) in enumerate(rows)], TRAIN)
    medians = scaling.fit_medians(scaling.train_rows(df), SPEC)
    return df, medians, scaling.fit_scaler(scaling.train_rows(df), SPEC, medians)


def test_scaler_is_fitted_on_train_rows_only(spark):
    rows = [("train", 10.0), ("train", 20.0), ("train", 30.0), ("test", 1000.0), ("validation", -500.0)]
    df, medians, fitted = fit(spark, rows)
    assert medians == {"heart_rate": 20.0}
    assert fitted[0].mean == 20.0 and fitted[0].scale == pytest.approx((200 / 3) ** 0.5)
    again = fit(spark, rows[:3] + [("test", 7.0)])[2]
    assert again == fitted
    out = scaling.apply_scaler(df, fitted).orderBy("stay_id").collect()
    assert out[3].heart_rate == pytest.approx((100 - 20) / fitted[0].scale) and out[3].heart_rate_missing == 1


def test_scaler_fills_clips_and_guards(spark):
    df, medians, fitted = fit(spark, [("train", 400.0), ("train", 400.0), ("train", None)])
    assert medians["heart_rate"] == 400.0 and fitted[0].mean == 100.0 and fitted[0].scale == 1.0
    _, medians, _ = fit(spark, [("train", None), ("test", 3.0)])
    assert medians["heart_rate"] == 75.0


def test_scaler_artifact_round_trip(spark):
    fitted = fit(spark, [("train", 10.0), ("train", 30.0)])[2]
    assert scaling.artifact_from(scaling.artifact_frame(spark, fitted)) == fitted


def test_missing_feature_column_is_an_error(spark):
    with pytest.raises(ValueError):
        scaling.fit_medians(spark.range(1), SPEC)


def test_state_problems(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 0, 5), (2, 0, 5), (2, 1, 6)], "stay_id long, step_index int, subject_id long")
    assert {(r.stay_id, r.violation) for r in ft.state_problems(df).collect()} == {
        (1, "duplicate_step_index"), (2, "several_subjects"),
    }
