import math

import pytest
from conftest import at, rows_of
from pyspark.sql import functions as F

from stepweave.operators import actions as act
from stepweave.operators import baselines, features, grid, ope, qdiag, report, rewards, safety, sweep
from stepweave.operators import transitions as tr
from stepweave.presets import clinical


def episodes(spark):
    onsets = spark.createDataFrame([(1, 1, 1, at(0))], "stay_id long, subject_id long, hadm_id long, onset_time timestamp_ntz")
    stays = spark.createDataFrame([(1, at(-4), at(8))], "stay_id long, intime timestamp_ntz, outtime timestamp_ntz")
    return grid.grid_episodes(onsets, stays)


# --- actions


def test_standardised_rates(spark):
    df = spark.createDataFrame(
        [(221906, 0.2), (221289, 0.1), (221662, 10.0), (222315, 2.0), (222042, 0.04), (999, 5.0), (221906, None)],
        "itemid long, rate double",
    )
    got = act.standardise_rate(df, clinical.AGENT_ITEMS, clinical.AGENT_FACTORS).collect()
    assert sorted(round(r.standard_rate, 6) for r in got) == [0.0, 0.1, 0.1, 0.1, 0.2, 0.2]
    assert {r.agent for r in got} == set(clinical.AGENT_FACTORS)


def test_interval_mean_averages_concurrent_rates(spark):
    eps = episodes(spark)
    rows = spark.createDataFrame(
        [(1, at(0), at(4), 0.2), (1, at(0), at(2), 0.5), (1, at(3), at(6), 0.8)],
        "stay_id long, starttime timestamp_ntz, endtime timestamp_ntz, standard_rate double",
    )
    got = act.interval_weighted_mean(rows, eps, grid.grid_steps(eps)).orderBy("step_index").collect()
    assert [r.vaso_dose_4h for r in got] == pytest.approx([0.0, (0.8 + 1.0 + 0.8) / 7, 0.8])


def test_point_sum_and_combined_levels(spark):
    eps = episodes(spark)
    steps = grid.grid_steps(eps)
    rows = spark.createDataFrame(
        [(1, 7, at(0), at(1), 100.0, 1.0), (1, 7, at(3.9), at(4), 50.0, 1.0), (1, 7, at(4), at(5), 25.0, 3.0), (1, 8, at(4), at(5), 9.0, 3.0)],
        "stay_id long, itemid long, starttime timestamp_ntz, endtime timestamp_ntz, amount double, standard_rate double",
    )
    got = act.point_sum(rows, eps, steps, items=(7,)).orderBy("step_index").collect()
    assert [r.fluid_volume_4h for r in got] == [0.0, 150.0, 25.0]
    given = act.treatments(rows, rows, eps, (7,))
    both = features.raw_state({}, eps, {}, placed=given).orderBy("step_index").collect()
    assert [(r.vaso_dose_4h, r.fluid_volume_4h) for r in both] == [
        (0.0, 0.0), (pytest.approx(1.0), 150.0), (pytest.approx(3.0), 25.0),
    ]


def test_bins_fit_on_positive_doses(spark):
    df = spark.createDataFrame([(float(i), float(i % 5)) for i in range(9)], "vaso_dose_4h double, fluid_volume_4h double")
    bins = act.fit_bins(df, seed=42)
    assert bins.first_edges == (3.0, 5.0, 6.0) and bins.n_first == 8
    assert act.bins_from(act.bins_frame(spark, bins)) == bins
    got = act.assign_bins(df, bins).orderBy("vaso_dose_4h").collect()
    assert [r.vaso_bin for r in got] == [0, 1, 1, 1, 2, 2, 3, 4, 4]
    assert all(r.action_id == r.vaso_bin * 5 + r.fluid_bin for r in got)


def test_equal_edges_are_moved_apart_and_few_doses_fail(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 6, "vaso_dose_4h double, fluid_volume_4h double")
    assert act.fit_bins(df).first_edges == (1.0, 1.0 + 1e-9, 1.0 + 1e-9 + 1e-9)
    with pytest.raises(ValueError, match="positive doses"):
        act.fit_bins(df.limit(3))


# --- rewards

STATE = "stay_id long, step_index int, sofa_score double, lactate double, map double, mortality_90d int"


def reward_rows(spark, cfg, died=1, **change):
    sofa, lact, pres = [4.0, 6.0, 8.0, 7.0, 5.0], [2.0, 3.5, 4.0, 3.0, 2.5], [75.0, 60.0, 55.0, 68.0, 72.0]
    sofa = change.get("sofa", sofa)
    df = spark.createDataFrame([(1, i, sofa[i], lact[i], pres[i], died) for i in range(5)], STATE)
    return rewards.step_rewards(df, cfg).orderBy("step_index")


def test_sparse_reward_only_at_the_end(spark):
    got = [r.reward_total for r in reward_rows(spark, rewards.RewardConfig(rewards.SPARSE)).collect()]
    assert got == [0, 0, 0, 0, -15]
    assert reward_rows(spark, rewards.RewardConfig(rewards.SPARSE), died=0).collect()[-1].reward_total == 15
    assert reward_rows(spark, rewards.RewardConfig(rewards.SPARSE), died=None).collect()[-1].reward_total == 0


def test_shaped_rewards(spark):
    got = [r.reward_total for r in reward_rows(spark, rewards.RewardConfig()).collect()]
    assert got == pytest.approx([0, -0.05, -0.05, 0.025, 0.05 - 15])
    cfg = rewards.RewardConfig(rewards.FULL_SHAPED, lactate_weight=1.0, map_weight=0.1)
    rows = reward_rows(spark, cfg).collect()
    assert [r.lactate_shaping for r in rows] == pytest.approx([0, -0.75, -0.5 / 3.5, 0.25, 0.5 / 3])
    assert [r.map_shaping for r in rows] == pytest.approx([0, -0.5, -1.0, 0, 0])
    default = [r.reward_total for r in reward_rows(spark, rewards.RewardConfig(rewards.FULL_SHAPED)).collect()]
    assert default == pytest.approx(got)


def test_nan_input_switches_the_term_off(spark):
    got = reward_rows(spark, rewards.RewardConfig(), sofa=[4.0, float("nan"), 8.0, None, 5.0]).collect()
    assert [r.sofa_shaping for r in got] == [0, 0, 0, 0, 0]


def test_reward_summary(spark):
    s = rewards.reward_summary(reward_rows(spark, rewards.RewardConfig(rewards.SPARSE))).first()
    assert (s.n_episodes, s.n_transitions, s.n_survived, s.n_died, s.mean_total) == (1, 5, 0, 1, -3.0)
    assert s.std_total == pytest.approx(6.0)
    with pytest.raises(ValueError):
        rewards.RewardConfig("other")


# --- transitions


def merged(spark, rows=((1, 0, 3, 1.0, 5.0), (1, 1, 4, 2.0, None), (2, 0, 0, -15.0, float("nan")))):
    return spark.createDataFrame(list(rows), "stay_id long, step_index int, action_id int, reward_total double, f double").withColumn(
        "g", F.lit(1.0)
    )


def test_transitions_link_and_absorb(spark):
    t = tr.build_transitions(merged(spark), ["f", "g"])
    got = {(r.stay_id, r.step_index): r for r in t.collect()}
    assert got[1, 0].state == [5.0, 1.0] and got[1, 0].next_state == [0.0, 1.0] and not got[1, 0].done
    assert got[1, 1].next_state == got[1, 1].state and got[1, 1].done
    assert got[2, 0].done and got[2, 0].state == [0.0, 1.0]
    assert tr.validate_transitions(t, 2).count() == 0
    meta = tr.dataset_meta(t).first()
    assert (meta.n_episodes, meta.n_transitions, meta.state_dim, meta.n_actions) == (2, 3, 2, 25)
    flat = tr.flatten(t, ["f", "g"])
    assert tr.replay_features(flat) == ["f", "g"]
    assert rows_of(tr.unflatten(flat, ["f", "g"]).select(*t.columns)) == rows_of(t)
    with pytest.raises(ValueError, match="lacks"):
        tr.unflatten(flat.drop("done"), ["f"])
    nested = {r.stay_id: [s.step_index for s in r.transitions] for r in tr.nested_episodes(t).collect()}
    assert nested == {1: [0, 1], 2: [0]}


def test_missing_action_fails_and_missing_reward_is_zero(spark):
    with pytest.raises(Exception, match="without an action"):
        tr.build_transitions(merged(spark, [(1, 0, None, 0.0, 1.0)]), ["f"]).collect()
    without = merged(spark, [(1, 0, 7, None, 1.0)])
    assert tr.build_transitions(without, ["f"]).first().reward == 0.0


def test_violations(spark):
    t = tr.build_transitions(merged(spark), ["f", "g"])
    broken = t.withColumn("done", ~F.col("done")).withColumn("action", F.col("action") + 22)
    got = {(r.stay_id, r.step_index, r.violation) for r in tr.validate_transitions(broken, 3).collect()}
    assert {(1, 0, "early_done"), (1, 1, "last_not_done"), (2, 0, "last_not_done"), (1, 0, "action_range")} <= got
    assert (1, 0, "state_dim") in got and (1, 0, "next_state_dim") in got and (2, 0, "action_range") not in got


# --- baselines


def test_baselines(spark):
    t = tr.build_transitions(merged(spark), ["f", "g"])
    c = baselines.clinician_baseline(t).first()
    assert (c.n_episodes, c.n_transitions, c.mean_episode_return, c.std_episode_return) == (2, 3, -6.0, 9.0)
    assert c.mortality_rate == 0.5 and c.mean_reward == -4.0
    n = baselines.no_treatment_baseline(t).first()
    assert n.action == 0 and n.mean_episode_return == -6.0
    assert {r.stay_id: r.episode_return for r in baselines.episode_returns(t, 0.5).collect()} == {1: 2.0, 2: -15.0}
    assert baselines.clinician_baseline(t.limit(0)).first().n_episodes == 0


def test_behaviour_cloning_learns_a_separable_rule(spark):
    rows = spark.range(300).select(
        (F.col("id") % 60).alias("stay_id"), F.floor(F.col("id") / 60).cast("int").alias("step_index"),
        F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("state"), (F.col("id") % 3).cast("int").alias("action"),
        F.lit(1.0).alias("reward"), (F.floor(F.col("id") / 60) == 4).alias("done"),
    )
    out, policy = baselines.behaviour_cloning_report(rows, max_iter=60)
    r = out.first()
    assert r.train_accuracy == r.eval_accuracy == 1.0 and r.n_train == 300 and r.mean_episode_return == 5.0
    probs = policy.score(rows).first().policy_probs
    assert sum(probs) == pytest.approx(1.0)


def test_support_shares(spark):
    rows = spark.createDataFrame([([1.0], 0), ([1.5], 0), ([1.0], 1), ([9.0], 1)], "state array<double>, action int")
    got = baselines.behaviour_support(rows, baselines.discretise(F.col("state"), [(0, (5.0,))]))
    assert rows_of(got) == [("0", 0, 2, pytest.approx(2 / 3)), ("0", 1, 1, pytest.approx(1 / 3)), ("1", 1, 1, 1.0)]


# --- off-policy evaluation


def held_out(spark):
    rows = [
        ("a", 0, [0.0], 0, 1.0, False, 0.5), ("a", 1, [1.0], 1, 2.0, True, 0.5),
        ("b", 0, [0.0], 1, 0.0, False, 0.5), ("b", 1, [1.0], 0, 1.0, True, 0.5),
    ]
    df = spark.createDataFrame(
        rows, "episode_id string, step_index int, state array<double>, action int, reward double, done boolean, behavior_action_prob double"
    )
    return df.withColumn("policy_action", F.col("state")[0].cast("int"))


def frozen(spark):
    return spark.createDataFrame([("a", [2.0, 0.0]), ("b", [2.0, 1.0])], "episode_id string, q array<double>")


def test_pinned_evaluation(spark):
    r = ope.evaluate_policy(held_out(spark), frozen(spark), "train", n_actions=2).first()
    assert (r.wis, r.ess, r.fqe, r.mean_behavior_return, r.wis_nonzero_episodes) == (3.0, 1.0, 2.0, 2.0, 1)
    prob = ope.policy_prob(F.col("action"), F.col("policy_action"))
    w = {e.episode_id: e for e in ope.episode_weights(held_out(spark), prob).collect()}
    assert (w["a"].importance_weight, w["b"].importance_weight) == (4.0, 0.0)
    assert w["a"].matched_step_fraction == 1.0 and w["b"].matched_step_fraction == 0.0
    capped = {e.episode_id: e for e in ope.episode_weights(held_out(spark), prob, 0.5, 1.5).collect()}
    assert capped["a"].importance_weight == 2.25 and capped["a"].discounted_return == 2.0


def test_no_weight_left_gives_zero(spark):
    never = held_out(spark).withColumn("policy_action", F.lit(7))
    w = ope.episode_weights(never, ope.policy_prob(F.col("action"), F.col("policy_action")))
    r = ope.wis_ess(w).first()
    assert (r.wis, r.ess) == (0.0, 0.0)


def test_stochastic_policy(spark):
    steps = held_out(spark).withColumn("pi", F.array(F.lit(0.25), F.lit(0.75)))
    r = ope.evaluate_policy(steps, frozen(spark), "train", n_actions=2, policy_probs="pi").first()
    assert r.fqe == pytest.approx((0.5 + 1.25) / 2) and r.wis == 2.0 and r.ess == pytest.approx(2.0)


def test_fqe_rejections(spark):
    initial = ope.initial_steps(held_out(spark), ["policy_action"])
    with pytest.raises(ValueError):
        ope.fqe_score(initial, frozen(spark), " Test ", 2, "policy_action")
    with pytest.raises(Exception, match="wrong width"):
        ope.fqe_score(initial, frozen(spark), "train", 3, "policy_action").collect()
    with pytest.raises(Exception, match="missing"):
        ope.fqe_score(initial, frozen(spark).limit(1), "train", 2, "policy_action").collect()


def test_held_out_rules(spark):
    good = held_out(spark)
    assert ope.held_out_violations(good, 1).count() == 0
    bad = good.withColumn("behavior_action_prob", F.lit(1.5)).withColumn("done", ~F.col("done")).union(good.where("episode_id = 'a'"))
    kinds = {r.violation for r in ope.held_out_violations(bad, 2).collect()}
    assert kinds == {"behavior_prob", "early_done", "last_not_done", "state_dim", "step_order"}


def test_contract(spark):
    meta = "n_actions int, state_dim int, manifest_seed int, split_label string"
    fields = ("n_actions", "state_dim", "manifest_seed")
    a = spark.createDataFrame([(25, 62, 42, "train")], meta)
    assert ope.contract_check(a, spark.createDataFrame([(25, 62, 42, " TEST ")], meta), fields).count() == 0
    drift = ope.contract_check(a, spark.createDataFrame([(25, 33, None, "train")], meta), fields)
    assert {r.field for r in drift.collect()} == {"state_dim", "manifest_seed", "split_label"}
    with pytest.raises(ValueError, match="feature_columns"):
        ope.contract_check(a, a)


def test_evaluation_rejects_broken_input(spark):
    good = held_out(spark).withColumn("policy_action", F.lit(0))
    values = good.select("episode_id").distinct().withColumn("q", F.array_repeat(F.lit(1.0), 25))
    assert ope.evaluate_policy(good, values, "train").count() == 1
    with pytest.raises(ValueError, match="behavior_prob"):
        ope.evaluate_policy(good.withColumn("behavior_action_prob", F.lit(1.5)), values, "train")
    for steps, q, what in ((good.limit(0), values, "no held-out"), (good, values.union(values), "several rows")):
        with pytest.raises(Exception, match=what):
            ope.evaluate_policy(steps, q, "train").collect()


def test_heat_map_rejects_an_action_outside_the_grid(spark):
    for action in (25, -1, None):
        rows = spark.createDataFrame([(0, 3), (action, 3)], "clinician_action int, policy_action int")
        for made in (safety.heatmap(rows, "clinician_action"), safety.delta_heatmap(rows)):
            with pytest.raises(Exception, match="no cell for action"):
                made.collect()


# --- safety


def review(spark):
    rows = [("a", 0, 0, 0, "low", 0.6, 40), ("a", 1, 6, 6, "low", 0.04, 9), ("b", 0, 1, 1, "high", 0.5, 30), ("b", 1, 2, 8, "high", 0.01, 2)]
    return spark.createDataFrame(
        rows, "episode_id string, step_index int, clinician_action int, policy_action int, subgroup string, support_prob double, support_count long"
    )


def test_safety_review(spark):
    out = safety.safety_review(review(spark))
    a = out["agreement"].first()
    assert (a.n_rows, a.agreement_rate, a.low_support_fraction, a.low_support_override_fraction) == (4, 0.75, 0.5, 0.25)
    assert rows_of(out["warnings"].select("severity", "episode_id", "step_index")) == [("high", "b", 1), ("medium", "a", 1)]
    assert "vaso_Q1×fluid_Q3" in out["warnings"].where("severity = 'high'").first().message
    cases = out["sanity_cases"].collect()
    assert (cases[0].episode_id, cases[0].step_index) == ("b", 1) and cases[1].low_support and len(cases) == 4
    cells = {(r.vaso_bin, r.fluid_bin): (r["count"], r.normalized) for r in out["policy_heatmap"].collect()}
    assert len(cells) == 25 and cells[1, 3] == (1, 0.25) and cells[4, 4] == (0, 0.0)
    delta = {(r.vaso_bin, r.fluid_bin): (r.delta, r.normalized) for r in out["delta_heatmap"].collect()}
    assert delta[1, 3] == (1, 0.5) and delta[0, 2] == (-1, 0.5) and delta[0, 0] == (0, 0.0)
    groups = {r.subgroup: r for r in out["subgroups"].collect()}
    assert groups["high"].dominant_policy_action == 1 and groups["high"].agreement_rate == 0.5
    wide = {r.vaso_bin: r.fluid_3 for r in safety.heatmap_matrix(out["policy_heatmap"]).collect()}
    assert wide == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0}


def test_unseen_action_has_no_support(spark):
    support = spark.createDataFrame([("0", 0, 5, 1.0)], "state_bin string, action int, support_count long, support_prob double")
    got = safety.safety_rows(held_out(spark), support, F.lit("0")).collect()
    assert {(r.policy_action, r.support_prob, r.support_count) for r in got} == {(0, 1.0, 5), (1, 0.0, 0)}


# --- action-value diagnostics


def test_diagnostics(spark):
    q = [1.0, 2.0, 0.0]
    df = spark.createDataFrame(
        [(q, [0.5, 4.0, 1.0], [0.0, -5.0, 0.0], 1, 1.0, False, 1.5), (q, q, [0.0, 0.0, 0.0], 0, 2.0, True, 3.0)],
        "q array<double>, q_next array<double>, logits array<double>, action int, reward double, done boolean, value double",
    )
    td = qdiag.td_error(df, 0.5).collect()
    assert [r.td_target for r in td] == [3.0, 2.0] and [r.td_error for r in td] == [1.0, 1.0]
    gap = qdiag.conservative_gap(df).first()
    assert gap.cql_gap == pytest.approx(math.log(math.e + math.e**2 + 1) - 2) and (gap.mean_q, gap.max_q) == (1.0, 2.0)
    masked = qdiag.masked_argmax(df).collect()
    assert [r.policy_action for r in masked] == [0, 1] and [r.n_supported for r in masked] == [2, 3]
    assert masked[1].behavior_entropy == pytest.approx(math.log(3))
    ex = qdiag.actor_loss(qdiag.expectile(df)).collect()
    assert ex[0].value_loss == pytest.approx(0.7 * 0.25) and ex[1].value_loss == pytest.approx(0.3 * 4.0)
    assert ex[0].adv_weight == pytest.approx(math.exp(1.5))
    assert ex[1].actor_loss == pytest.approx(math.exp(-6) * math.log(3))
    assert [r.policy_action for r in qdiag.greedy_action(df).collect()] == [1, 1]


# --- sweeps and reports


def test_sweep_plan():
    plan = sweep.SweepPlan(subsets={"full_state": None, "clinical_core": ("a",), "hemodynamic_core": ("b",)})
    assert [len(plan.of(d)) for d in sweep.DIMENSIONS] == [3, 3, 3, 2, 3] and len(sweep.VARIANTS) == 14
    setups = [plan.setup(v) for v in plan.variants]
    assert setups[4].n_bins == 3 and setups[7].step_hours == 2 and setups[12].features == ("a",)
    with pytest.raises(ValueError):
        plan.of("other")
    with pytest.raises(ValueError):
        plan.setup(sweep.Variant("x", "timestep_choice", 0))
    with pytest.raises(TypeError):
        plan.setup(sweep.Variant("x", "missingness_flags", "yes"))


def test_sweep_needs_every_metric(spark):
    plan = sweep.SweepPlan()
    good = sweep.run_sweep(plan, "timestep_choice", lambda s: spark.range(1).select(F.lit(s.step_hours).alias("m")), ["m"])
    assert rows_of(good) == [("timestep_2h", False, 2), ("timestep_4h", True, 4), ("timestep_6h", False, 6)]
    with pytest.raises(ValueError, match="lacks metrics"):
        sweep.run_sweep(plan, "timestep_choice", lambda s: spark.range(1), ["m"])


def test_metric_reports(spark):
    log = spark.createDataFrame(
        [(1, 1, "a", 4.0, 0.0), (2, 1, "a", 2.0, 0.0), (3, 2, "a", 1.0, 0.0), (4, 3, "a", 1.0, 0.0), (1, 1, "b", 5.0, 0.0)],
        "step long, epoch long, name string, value double, timestamp double",
    )
    s = {r.name: r for r in report.metric_summary(log).collect()}
    assert (s["a"]["count"], s["a"].median, s["a"].final, s["a"].mean, s["a"].last_step) == (4, 1.5, 1.0, 2.0, 4)
    assert rows_of(report.best_epoch(log)) == [("a", 1.0, 2), ("b", 5.0, 1)]
    runs = log.withColumn("run", F.col("name"))
    metas = spark.createDataFrame([("a", 25, 1), ("b", 25, 2)], "run string, n_actions int, seed int")
    same = report.compare_runs(metas, runs, ["n_actions"]).collect()
    assert {(r.run, r.final_value, r.contract_consistent) for r in same} == {("a", 1.0, True), ("b", 5.0, True)}
    assert not report.compare_runs(metas, runs, ["n_actions", "seed"]).first().contract_consistent
