"""Named queries over the bundled tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions.scalars import decode_action, encode_action, steady
from stepweave.operators import actions as act
from stepweave.operators import anchor, baselines, discretise, features, grid, ope, policy, qdiag, report, rewards
from stepweave.operators import cohort as coh
from stepweave.operators import safety, scaling, split
from stepweave.operators import transitions as tr
from stepweave.operators.sweep import Setup, run_sweep
from stepweave.plans import pipeline
from stepweave.plans.study import FULL, ITEMS, NESTED, ONSET, OWN_RULES, OWN_SPECS, REGISTRY, RULES, SEED, Study
from stepweave.plans.study import sweep_plan
from stepweave.session import cut_lineage, scratch_path
from stepweave.sources import artifacts, readers, writers
from stepweave.sources.readers import first_stays, orders_matching, scan_intervals, scan_points

Query = Callable[[Study], DataFrame]
CATALOG: dict[str, Query] = {}


def query(fn: Query) -> Query:
    CATALOG[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round computed doubles so that summation order does not show."""
    return df.select(
        *[steady(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes]
    )


# --- scans


@query
def scan_points_filtered(s: Study) -> DataFrame:
    owners = s.stays.where(F.pmod("stay_id", F.lit(2)) == 0)
    rows = scan_points(s.events, ("view", "error"), "2024-01-05 00:00:00", "2024-01-20 00:00:00", owners)
    return rows.select("event_id", "stay_id", "charttime", "itemid", "valuenum")


@query
def scan_intervals_filtered(s: Study) -> DataFrame:
    rows = s.infusions.withColumn("endtime", F.when(F.col("amount") >= 5, F.col("endtime")))
    return scan_intervals(rows, ("purchase",), "2024-01-05 00:00:00", "2024-01-20 00:00:00").select(
        "stay_id", "starttime", "endtime", "amount"
    )


@query
def scan_orders_keyword(s: Study) -> DataFrame:
    rows = orders_matching(s.table("orders"), ("high", "urgent"), "o_orderpriority", "o_orderdate")
    return rows.select("o_orderkey", "o_orderpriority", "o_orderdate")


@query
def limit_stays(s: Study) -> DataFrame:
    return first_stays(s.episodes, 20).select("stay_id", "onset_time", "n_steps")


# --- typed text sources: written as gzip CSV, read back with casts


@query
def source_stays(s: Study) -> DataFrame:
    rows = readers.read_stays(s.spark, s.text_stays)
    return rounded(rows.select("subject_id", "hadm_id", "stay_id", "first_careunit", "intime", "outtime", "los_hours"))


@query
def source_patients(s: Study) -> DataFrame:
    return readers.raw_table(s.spark, s.text_patients, "patients", required=("subject_id", "anchor_age"))


@query
def source_admissions(s: Study) -> DataFrame:
    return readers.raw_table(s.spark, s.text_admissions, "admissions", required=("hadm_id", "deathtime"))


@query
def source_cultures(s: Study) -> DataFrame:
    return readers.read_cultures(s.spark, s.text_cultures).select("subject_id", "hadm_id", "charttime", "culture_time")


@query
def source_labs(s: Study) -> DataFrame:
    """Events of two items read as lab results: landed sorted by item, bound in time, owned by admission."""
    landed = scratch_path(s.spark, "labs")
    writers.land_events(readers.raw_table(s.spark, s.text_events, "labevents"), landed, key="hadm_id")
    labs = readers.raw_table(s.spark, landed, "labevents", "parquet")
    owners = s.episodes.where(F.pmod("hadm_id", F.lit(3)) > 0)
    items = [ITEMS.index(i) + 1 for i in ("click", "error")]
    return scan_points(labs, items, "2024-01-03 00:00:00", "2024-01-25 00:00:00", owners, key="hadm_id")


@query
def source_scores(s: Study) -> DataFrame:
    chart = readers.raw_table(s.spark, s.text_events, "chartevents")
    return readers.scan_scores(chart, [ITEMS.index("view") + 1, ITEMS.index("error") + 1])


@query
def source_malformed(s: Study) -> DataFrame:
    """What becomes of rows that do not fit the header: counts of kept, dropped and set aside rows."""
    kept = readers.raw_table(s.spark, s.ragged_orders, "prescriptions", malformed=readers.KEEP)
    left = readers.raw_table(s.spark, s.ragged_orders, "prescriptions", malformed=readers.DROP)
    aside = readers.malformed_rows(s.spark, s.ragged_orders)

    def counted(rows: DataFrame, policy_name: str, drug: Column) -> DataFrame:
        return rows.agg(
            F.lit(policy_name).alias("policy"), F.count(F.lit(1)).alias("rows"), F.count(drug).alias("with_drug")
        )

    return (
        counted(kept, "keep", F.col("drug"))
        .unionByName(counted(left, "drop", F.col("drug")))
        .unionByName(counted(aside, "set aside", F.when(F.col("malformed").contains("more"), True)))
    )


# --- cohort


@query
def cohort_included(s: Study) -> DataFrame:
    return rounded(coh.cohort_funnel(s.cohort_base, RULES)[0])


@query
def cohort_excluded(s: Study) -> DataFrame:
    return rounded(coh.cohort_funnel(s.cohort_base, RULES)[1])


@query
def cohort_audit(s: Study) -> DataFrame:
    return coh.cohort_audit(coh.label_exclusions(s.cohort_base, RULES))


@query
def exclusion_summary(s: Study) -> DataFrame:
    return coh.exclusion_summary(coh.cohort_funnel(s.cohort_base, RULES)[1])


@query
def completeness(s: Study) -> DataFrame:
    included, excluded = coh.cohort_funnel(s.cohort_base, RULES)
    return coh.funnel_completeness(included, excluded, s.cohort_base)


@query
def completeness_faults(s: Study) -> DataFrame:
    """A funnel with lost, doubled and unexplained stays, to have something to find."""
    included, excluded = coh.cohort_funnel(s.cohort_base, RULES)
    doubled = included.unionByName(included.where(F.pmod("stay_id", F.lit(7)) == 0))
    kept = excluded.where(F.pmod("stay_id", F.lit(10)) > 0)
    reason = F.when(F.pmod("stay_id", F.lit(6)) > 0, F.col("exclusion_reason"))
    return coh.funnel_completeness(doubled, kept.withColumn("exclusion_reason", reason), s.cohort_base)


# --- anchor and onset


@query
def anchor_pairs(s: Study) -> DataFrame:
    return s.anchors


@query
def dysfunction_score(s: Study) -> DataFrame:
    return s.scores


@query
def onset_usable(s: Study) -> DataFrame:
    return anchor.onset_usable(s.classified)


@query
def onset_unusable(s: Study) -> DataFrame:
    return anchor.onset_unusable(s.classified)


@query
def onset_candidates(s: Study) -> DataFrame:
    return anchor.onset_candidates(s.anchored, s.scores, s.classified, ONSET)


@query
def onset_audit(s: Study) -> DataFrame:
    return anchor.onset_audit(s.classified)


# --- grid


@query
def grid_steps(s: Study) -> DataFrame:
    return s.steps


@query
def grid_episodes(s: Study) -> DataFrame:
    return s.episodes.drop("first_step", "last_step")


@query
def grid_audit(s: Study) -> DataFrame:
    return grid.grid_audit(s.episodes)


@query
def truncation_reasons(s: Study) -> DataFrame:
    return grid.truncation_reasons(s.episodes)


# --- split


@query
def split_assign(s: Study) -> DataFrame:
    return s.splits


@query
def split_manifest(s: Study) -> DataFrame:
    return split.split_manifest(s.episodes, s.splits)


@query
def manifest_arrays(s: Study) -> DataFrame:
    rows = split.manifest_arrays(split.split_manifest(s.episodes, s.splits))
    return rows.withColumn("episode_keys", F.array_join(F.col("episode_keys").cast("array<string>"), ","))


def _stored_manifest(s: Study) -> str:
    root = scratch_path(s.spark, "split")
    writers.write_manifest(split.split_manifest(s.episodes, s.splits), root, SEED, "1")
    return root


@query
def manifest_reload(s: Study) -> DataFrame:
    """One split of a stored manifest, read by its folder and checked against the summary."""
    return readers.read_manifest(s.spark, _stored_manifest(s), "validation", "1")[0]


@query
def manifest_summary(s: Study) -> DataFrame:
    summary = readers.read_manifest(s.spark, _stored_manifest(s))[1]
    rows = [
        (name, summary["n_keys"][name], n, summary["seed"], summary["spec_version"], summary["leakage_free"])
        for name, n in summary["n_episodes"].items()
    ]
    schema = "split string, n_keys long, n_episodes long, seed long, spec_version string, leakage_free boolean"
    return s.spark.createDataFrame(rows, schema)


@query
def split_stats(s: Study) -> DataFrame:
    rows = s.episodes.withColumn("died", F.pmod("subject_id", F.lit(2)))
    return split.split_stats(rows, s.splits, outcome="died")


@query
def leakage_check(s: Study) -> DataFrame:
    """Splits drawn per stay instead of per subject, to have something to find."""
    per_stay = split.group_split(s.episodes, "stay_id", SEED)
    return split.leakage_check(s.episodes.select("stay_id", "subject_id").join(per_stay, "stay_id"))


@query
def step_context(s: Study) -> DataFrame:
    weights = features.static_weight(s.infusions.where(F.col("itemid") == "purchase"))
    return rounded(features.step_context(s.episodes, s.ages, weights, s.splits, s.labels))


# --- state


@query
def feature_long(s: Study) -> DataFrame:
    specs = [f for f in s.registry.values() if f.is_event]
    return rounded(features.feature_long(s.source, s.episodes, specs, s.cfg))


@query
def state_raw(s: Study) -> DataFrame:
    names = ["view_last", "click_min", "error_max", "purchase_mean", "signup_sum"]
    return rounded(s.raw.select("stay_id", "step_index", "step_start", "step_end", *names))


@query
def missing_flags(s: Study) -> DataFrame:
    flags = [c for c in s.columns if c.endswith("_missing")]
    return features.impute_state(s.wide, s.registry).select("stay_id", "step_index", *flags)


@query
def cumulative_exposure(s: Study) -> DataFrame:
    return rounded(s.raw.select("stay_id", "step_index", F.coalesce("paid_total", F.lit(0.0)).alias("paid_total")))


@query
def state_first_pass(s: Study) -> DataFrame:
    rows = features.impute_state(s.wide, s.registry)
    return rounded(rows.select("stay_id", "step_index", *s.registry))


@query
def state_imputed(s: Study) -> DataFrame:
    return rounded(s.state.select("stay_id", "step_index", "split", *s.columns, "sofa_score"))


@query
def derived_ratios(s: Study) -> DataFrame:
    return rounded(s.state.select("stay_id", "step_index", "click_error", "view_error"))


@query
def nested_ratio(s: Study) -> DataFrame:
    """A ratio of two ratios, declared before its parents."""
    registry = features.make_registry([NESTED, *REGISTRY.values()])
    rows = features.impute_state(s.wide, registry, s.medians)
    return rounded(rows.select("stay_id", "step_index", "click_error", NESTED.name, f"{NESTED.name}_missing"))


@query
def registry_coverage(s: Study) -> DataFrame:
    """The feature dictionary by source, rule and strategy, with what the events deliver for it."""
    dictionary = features.registry_frame(s.spark, s.registry)
    specs = [f for f in s.registry.values() if f.is_event]
    found = features.feature_long(s.source, s.episodes, specs, s.cfg)
    per_feature = found.groupBy("feature").agg(F.count("value").alias("steps"), F.sum("n_valid").alias("events"))
    kinds = F.array(
        *(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("source", "agg", "missing"))
    )
    rows = dictionary.join(per_feature, "feature", "left").select("steps", "events", F.inline(kinds))
    summary = features.registry_summary(dictionary)
    seen = rows.groupBy("kind", "value").agg(
        F.coalesce(F.sum("steps"), F.lit(0)).alias("steps"), F.coalesce(F.sum("events"), F.lit(0)).alias("events")
    )
    return summary.join(seen, ["kind", "value"])


@query
def own_rules(s: Study) -> DataFrame:
    """Features under registered rules with parameters."""
    rules = features.with_rules(s.spark, OWN_RULES, trial={"share_above": {"limit": 0.0}})
    registry = features.make_registry(OWN_SPECS, rules)
    rows = features.raw_state({"events": s.source}, s.episodes, registry, s.cfg, rules)
    return rounded(rows.select("stay_id", "step_index", *registry, *(f"{n}__n" for n in registry)))


@query
def last_without_tie(s: Study) -> DataFrame:
    """Last values of a source without a tie column: equal times go by item, then by value."""
    days = s.events.withColumn("charttime", F.date_trunc("day", "charttime").cast("timestamp_ntz"))
    spec = features.FeatureSpec("last_seen", "events", ("view", "click", "error"), "last", valid=(1, 150))
    source = features.EventSource(days, "charttime", "valuenum")
    return rounded(features.feature_long(source, s.episodes, [spec], s.cfg))


@query
def state_problems(s: Study) -> DataFrame:
    """Two stays folded into one id: repeated steps and two subjects show up."""
    folded = s.raw.join(s.context.select("stay_id", "subject_id"), "stay_id").withColumn(
        "stay_id", F.floor(F.col("stay_id") / 3)
    )
    return features.state_problems(folded)


@query
def outcome_label(s: Study) -> DataFrame:
    return s.labels


@query
def train_medians(s: Study) -> DataFrame:
    rows = [(name, float(value)) for name, value in s.medians.items()]
    return rounded(s.spark.createDataFrame(rows, "feature string, median double"))


@query
def scaler_fit(s: Study) -> DataFrame:
    return rounded(scaling.artifact_frame(s.spark, s.scaler))


@query
def state_normalised(s: Study) -> DataFrame:
    rows = scaling.apply_scaler(s.state, s.scaler)
    return rounded(rows.select("stay_id", "step_index", *s.columns))


@query
def static_weight(s: Study) -> DataFrame:
    return rounded(features.static_weight(s.infusions.where(F.col("itemid") == "purchase")))


# --- actions


@query
def rate_standardised(s: Study) -> DataFrame:
    return rounded(s.rates.select("stay_id", "starttime", "endtime", "itemid", "agent", "standard_rate"))


@query
def interval_weighted_mean(s: Study) -> DataFrame:
    return rounded(s.vaso)


@query
def point_sum(s: Study) -> DataFrame:
    return rounded(s.fluid)


@query
def bin_edges(s: Study) -> DataFrame:
    edges = [("vaso", i + 1, e) for i, e in enumerate(s.bins.first_edges)]
    edges += [("fluid", i + 1, e) for i, e in enumerate(s.bins.second_edges)]
    return rounded(s.spark.createDataFrame(edges, "dose string, edge int, value double"))


@query
def action_ids(s: Study) -> DataFrame:
    return s.actions.select("stay_id", "step_index", "vaso_bin", "fluid_bin", "action_id")


@query
def action_labels(s: Study) -> DataFrame:
    first, second = decode_action(F.col("action_id"))
    rows = act.label_actions(s.actions)
    return rows.select("stay_id", "step_index", "action_label", encode_action(first, second).alias("recoded"))


@query
def action_histogram(s: Study) -> DataFrame:
    return act.action_histogram(s.actions)


# --- rewards


@query
def rewards_sparse(s: Study) -> DataFrame:
    return rounded(s.rewards_for(rewards.RewardConfig(rewards.SPARSE)))


@query
def rewards_sofa(s: Study) -> DataFrame:
    return rounded(s.rewards_for(rewards.RewardConfig(rewards.SOFA_SHAPED)))


@query
def rewards_full(s: Study) -> DataFrame:
    return rounded(s.rewards_for(FULL))


@query
def reward_summary(s: Study) -> DataFrame:
    return rounded(rewards.reward_summary(s.rewards_for(s.reward_config)))


# --- transitions


@query
def transitions(s: Study) -> DataFrame:
    return rounded(tr.flatten(s.transitions, s.columns))


def _description(s: Study, reward_version: str = "1") -> dict[str, object]:
    return {
        "spec_version": "1",
        "action_spec_version": "1",
        "reward_spec_version": reward_version,
        "manifest_seed": SEED,
        "feature_columns": ",".join(s.columns),
    }


@query
def dataset_meta(s: Study) -> DataFrame:
    return tr.dataset_meta(s.transitions, by=["split"], description=_description(s))


@query
def transition_violations(s: Study) -> DataFrame:
    """Last steps removed and every seventh action shifted, to have something to find."""
    cut = s.transitions.where(~(F.col("done") & (F.pmod("stay_id", F.lit(2)) == 0)))
    shifted = F.col("action") + F.when(F.pmod("stay_id", F.lit(7)) == 0, 25).otherwise(0)
    return tr.validate_transitions(cut.withColumn("action", shifted), len(s.columns))


@query
def replay_reload(s: Study) -> DataFrame:
    """The flat replay table, one folder per split, read back through its column contract."""
    path = scratch_path(s.spark, "replay")
    writers.write_replay(s.transitions, path, s.columns)
    return rounded(tr.flatten(readers.read_replay(s.spark, path, s.columns, split="validation"), s.columns))


@query
def replay_layout(s: Study) -> DataFrame:
    """Where the replay sink puts an episode: in one file, its steps one after the other and in order."""
    path = scratch_path(s.spark, "replay")
    writers.write_replay(s.transitions, path, s.columns)
    stored = s.spark.read.parquet(path).select("stay_id", "step_index", "_metadata.file_path", "_metadata.row_index")
    shift = F.col("row_index") - F.col("step_index")
    return stored.groupBy("stay_id").agg(
        F.count_distinct("file_path").alias("files"),
        F.count(F.lit(1)).alias("steps"),
        (F.max(shift) == F.min(shift)).alias("in_order"),
    )


@query
def artifact_reload(s: Study) -> DataFrame:
    """Stored medians, scaler, bins and rewards, reloaded and applied."""
    stored = s.fitted
    medians = stored["medians"]["values"]
    scaler = [scaling.FeatureTransform(**t) for t in stored["scaler"]["features"]]
    record = stored["action_bins"]
    edges = {k: tuple(record[k]) for k in ("first_edges", "second_edges")}
    acted = act.assign_bins(s.wide, act.ActionBins(**{**record, **edges}))
    state = s.imputed_with(acted, medians)
    rewarded = s.rewarded(state, rewards.RewardConfig(**stored["reward_config"]))
    return rounded(
        scaling.apply_scaler(rewarded, scaler).select("stay_id", "step_index", "action_id", "reward_total", *s.columns)
    )


@query
def transitions_normalised(s: Study) -> DataFrame:
    """Transitions over z-scored states; actions and rewards come from the raw ones."""
    rows = s.rewarded(s.imputed(act.assign_bins(s.wide, s.bins)), s.reward_config)
    linked = tr.build_transitions(scaling.apply_scaler(rows, s.scaler), s.columns)
    return rounded(tr.flatten(linked, s.columns))


# --- baselines


@query
def clinician_baseline(s: Study) -> DataFrame:
    return rounded(baselines.clinician_baseline(s.transitions, by=["split"]))


@query
def no_treatment_baseline(s: Study) -> DataFrame:
    return rounded(baselines.no_treatment_baseline(s.transitions))


@query
def behaviour_cloning(s: Study) -> DataFrame:
    """The fit itself has no SQL; what is fixed, and that it beats the majority action on train, has."""
    train = s.part("train")
    rows = baselines.behaviour_cloning_report(train, s.part("test"))[0]
    most = train.groupBy("action").count().agg((F.max("count") / F.sum("count")).alias("share")).first()["share"]
    fixed = rows.withColumn("at_least_majority", F.col("train_accuracy") >= most - 1e-9)
    return rounded(fixed.drop("train_accuracy", "eval_accuracy"))


@query
def behaviour_support(s: Study) -> DataFrame:
    return rounded(s.support)


@query
def state_cuts(s: Study) -> DataFrame:
    rows = [(c.component, i + 1, e) for c in s.cuts for i, e in enumerate(c.edges)]
    return rounded(s.spark.createDataFrame(rows, "component string, edge int, value double"))


@query
def learned_support(s: Study) -> DataFrame:
    """Behaviour support on state bins learned from the train rows."""
    return rounded(baselines.behaviour_support(s.part("train"), discretise.state_bin(s.cuts)))


@query
def episode_returns(s: Study) -> DataFrame:
    return rounded(baselines.episode_returns(s.transitions, gamma=0.99))


# --- off-policy evaluation


@query
def held_out_violations(s: Study) -> DataFrame:
    """Probabilities zeroed on some steps and last steps cut, to have something to find."""
    prob = F.when(F.pmod("episode_id", F.lit(5)) == 0, 0.0).otherwise(F.col("behavior_action_prob"))
    cut = s.held_out.where(~(F.col("done") & (F.pmod("episode_id", F.lit(3)) == 0)))
    return ope.held_out_violations(cut.withColumn("behavior_action_prob", prob), len(s.columns))


@query
def ope_episode(s: Study) -> DataFrame:
    log_weight = F.log("importance_weight").alias("log_weight")
    return rounded(
        s.weights.select("episode_id", "discounted_return", log_weight, "matched_steps", "n_steps", "matched_step_fraction")
    )


@query
def ope_wis_ess(s: Study) -> DataFrame:
    return rounded(ope.wis_ess(s.weights).withColumn("wis_weight_sum", F.log("wis_weight_sum")))


@query
def fqe_score(s: Study) -> DataFrame:
    return rounded(ope.fqe_score(s.initial_probs, s.frozen_values, "train", policy_probs="policy_probs"))


@query
def policy_report(s: Study) -> DataFrame:
    return rounded(ope.evaluate_policy(s.held_out, s.frozen_values, "train", gamma=0.99))


@query
def policy_scores(s: Study) -> DataFrame:
    """Greedy actions of a stored network, scored in batches."""
    greedy = policy.StoredPolicy(s.policy.values)
    return _keys(policy.score_policy(s.transitions, greedy), "policy_action", "policy_q")


@query
def policy_masked(s: Study) -> DataFrame:
    """Actions of a stored network among those a fitted behaviour network supports."""
    rows = policy.score_policy(s.transitions, s.policy)
    limit = s.policy.threshold * F.array_max("policy_probs")
    supported = F.size(F.filter("policy_probs", lambda p: p >= limit))
    return _keys(rows.withColumn("n_supported", supported), "policy_action", "policy_q", "n_supported")


@query
def policy_model_report(s: Study) -> DataFrame:
    """Off-policy evaluation of a stored network on the held-out split."""
    greedy = policy.StoredPolicy(s.policy.values)
    steps = policy.score_policy(s.held_out.drop("policy_action"), greedy)
    values = ope.initial_steps(steps.withColumnRenamed("q_values", "q"), ["q"])
    return rounded(ope.evaluate_policy(steps, values, "train", gamma=0.99))


@query
def contract_drift(s: Study) -> DataFrame:
    def described(label: str, bins: int, reward_version: str) -> DataFrame:
        description = {**_description(s, reward_version), "split_label": label}
        return tr.dataset_meta(s.part(label), bins * bins, description=description)

    return ope.contract_check(described("train", 5, "1"), described("validation", 3, "2"))


# --- safety


@query
def safety_rows(s: Study) -> DataFrame:
    return rounded(s.review)


@query
def agreement(s: Study) -> DataFrame:
    return rounded(safety.agreement_summary(s.review))


@query
def heatmap(s: Study) -> DataFrame:
    return rounded(safety.heatmap(s.review, "clinician_action"))


@query
def heatmap_matrix(s: Study) -> DataFrame:
    return safety.heatmap_matrix(safety.heatmap(s.review, "policy_action"))


@query
def delta_heatmap(s: Study) -> DataFrame:
    return rounded(safety.delta_heatmap(s.review))


@query
def subgroups(s: Study) -> DataFrame:
    return rounded(safety.subgroup_summary(s.review))


@query
def sanity_topk(s: Study) -> DataFrame:
    return rounded(safety.sanity_cases(s.review))


@query
def support_warnings(s: Study) -> DataFrame:
    return rounded(safety.support_warnings(s.review))


# --- sweeps


def _sweep(s: Study, dimension: str, metrics: Sequence[str], measure: Callable[[Study], DataFrame]) -> DataFrame:
    studies: dict[Setup, Study] = {s.setup: s}

    def run(setup: Setup) -> DataFrame:
        if setup not in studies:
            fresh = Study(s.spark, s.sf_dir, setup)
            if setup.step_hours == s.setup.step_hours:
                # the variant changes nothing before these stages
                fresh.episodes, fresh.wide, fresh.medians = s.episodes, s.wide, s.medians
            studies[setup] = fresh
        return measure(studies[setup])

    return rounded(run_sweep(sweep_plan(), dimension, run, metrics))


@query
def sweep_timestep(s: Study) -> DataFrame:
    return _sweep(s, "timestep_choice", ["total_episodes", "avg_steps", "max_steps"], lambda v: grid.grid_audit(v.episodes))


@query
def sweep_bins(s: Study) -> DataFrame:
    def used(v: Study) -> DataFrame:
        counts = act.action_histogram(v.actions)
        return counts.agg(
            F.count(F.lit(1)).alias("actions_used"), F.sum("count").alias("steps"), F.max("count").alias("largest")
        )

    return _sweep(s, "action_granularity", ["actions_used", "steps", "largest"], used)


@query
def sweep_reward(s: Study) -> DataFrame:
    return _sweep(
        s, "reward_shaping", ["n_transitions", "mean_total", "std_total"],
        lambda v: rewards.reward_summary(v.rewards_for(v.reward_config)),
    )


def _width(v: Study) -> DataFrame:
    cells = sum((F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in v.columns), F.lit(0.0))
    return v.state_view.agg(
        F.lit(len(v.columns)).alias("state_dim"), F.count(F.lit(1)).alias("n_steps"), F.avg(cells).alias("mean_norm")
    )


@query
def sweep_flags(s: Study) -> DataFrame:
    return _sweep(s, "missingness_flags", ["state_dim", "n_steps", "mean_norm"], _width)


@query
def sweep_features(s: Study) -> DataFrame:
    return _sweep(s, "feature_subset", ["state_dim", "n_steps", "mean_norm"], _width)


# --- reports


@query
def metric_summary(s: Study) -> DataFrame:
    return rounded(report.metric_summary(s.metric_log))


@query
def metric_summary_epochs(s: Study) -> DataFrame:
    """Metric curves per run with their first and last epoch."""
    return rounded(report.metric_summary(s.metric_log, ["run", "name"], epochs=True))


@query
def metric_log_reload(s: Study) -> DataFrame:
    """A metric log written as JSON lines, some of them broken, and what its reader makes of them."""
    path = scratch_path(s.spark, "log")
    n = F.col("step")
    record = F.to_json(F.struct("step", "epoch", "name", "value", F.lit(0.5).alias("timestamp")))
    line = (
        F.when(n % 29 == 0, F.substring(record, 1, 20))
        .when(n % 31 == 0, F.to_json(F.struct("step", "epoch", "value")))
        .when(n % 37 == 0, F.lit(""))
        .otherwise(record)
    )
    s.metric_log.select(line).write.text(path)
    judged = readers.read_metric_log(s.spark, path, readers.KEEP)
    fine = F.col("malformed").isNull()
    kinds = F.when(fine, F.col("name")).when(F.col("malformed").contains('"value"'), "no name").otherwise("no record")
    return rounded(
        judged.groupBy(kinds.alias("line"))
        .agg(F.count(F.lit(1)).alias("lines"), F.sum(F.when(fine, F.col("value"))).alias("total"))
    )


@query
def epoch_summary(s: Study) -> DataFrame:
    return rounded(report.epoch_summary(s.metric_log))


@query
def best_epoch(s: Study) -> DataFrame:
    return rounded(report.best_epoch(s.metric_log))


@query
def rolling_return(s: Study) -> DataFrame:
    return rounded(report.rolling_return(s.transitions))


@query
def compare_runs(s: Study) -> DataFrame:
    metas = s.metric_log.groupBy("run").agg(
        F.count_distinct("name").alias("n_metrics"), F.lit(SEED).alias("manifest_seed")
    )
    rows = report.compare_runs(metas, s.metric_log, ["n_metrics", "manifest_seed"])
    return rows.drop("contract")


@query
def compare_runs_drift(s: Study) -> DataFrame:
    """Runs whose dataset descriptions have drifted apart: one has another seed, two other metrics."""
    seed = F.when(F.col("run") == 2, SEED + 1).otherwise(SEED)
    metas = s.metric_log.groupBy("run").agg(F.count_distinct("name").alias("n_metrics"))
    rows = report.compare_runs(metas.withColumn("manifest_seed", seed), s.metric_log, ["n_metrics", "manifest_seed"])
    return rounded(rows)


# --- the staged pipeline, from gzip CSV to the replay table


@query
def pipeline_cohort(s: Study) -> DataFrame:
    r = s.from_text
    parts = pipeline.cohort_stage(r.raw["stays"], r.raw["patients"], r.raw["admissions"], r.config)
    both = parts["cohort"].unionByName(parts["cohort_excluded"], allowMissingColumns=True)
    return rounded(both.drop("deathtime", "hospital_expire_flag"))


def _onsets(s: Study) -> dict[str, DataFrame]:
    r = s.from_text
    cohort = pipeline.cohort_stage(r.raw["stays"], r.raw["patients"], r.raw["admissions"], r.config)["cohort"]
    tables = (r.raw["cultures"], r.raw["prescriptions"], r.raw["chartevents"])
    return pipeline.onset_stage(cut_lineage(cohort), *tables, r.config)


@query
def pipeline_onset(s: Study) -> DataFrame:
    parts = _onsets(s)
    return parts["onset"].unionByName(parts["onset_unusable"], allowMissingColumns=True)


@query
def pipeline_truncation(s: Study) -> DataFrame:
    r = s.from_text
    onsets = cut_lineage(_onsets(s)["onset"])
    return pipeline.grid_stage(onsets, r.raw["stays"], r.raw["admissions"], r.config)["truncation_reasons"]


@query
def pipeline_steps(s: Study) -> DataFrame:
    """Imputed state, doses, actions and rewards of every step."""
    r = s.from_text
    on = ["stay_id", "step_index"]
    rewards_of = r.stage("rewards").drop("lactate_shaping", "map_shaping")
    return rounded(r.stage("state_raw").join(r.stage("actions"), on).join(rewards_of, on))


@query
def pipeline_replay(s: Study) -> DataFrame:
    """The stored replay table of normalised states, read through its contract."""
    r = s.from_text
    return rounded(tr.flatten(readers.read_replay(s.spark, r.paths["replay"], r.columns), r.columns))


@query
def pipeline_records(s: Study) -> DataFrame:
    """Numbers from the stored JSON records and the manifest of a pipeline run."""
    r = s.from_text

    def stored(kind: str) -> dict:
        return artifacts.load(s.spark, r.paths["artifacts"], kind)

    bins = stored("action_bins")
    rows = [("median", f, v) for f, v in stored("medians")["values"].items()]
    rows += [("mean", t["feature"], t["mean"]) for t in stored("scaler")["features"]]
    for name, at in (("vaso", "first"), ("fluid", "second")):
        rows += [("edge", f"{name}{i}", e) for i, e in enumerate(bins[f"{at}_edges"], 1)]
    rows += [("transitions", p["split"], float(p["n_transitions"])) for p in stored("dataset_meta")["splits"]]
    rows.append(("reward", "survived", stored("reward_config")["survived"]))
    summary = readers.read_manifest(s.spark, r.paths["split"], spec_version=pipeline.SPEC_VERSION)[1]
    rows += [("manifest", split_name, float(n)) for split_name, n in summary["n_episodes"].items()]
    return rounded(s.spark.createDataFrame(rows, "record string, field string, value double"))


# --- action-value diagnostics


def _keys(df: DataFrame, *names: str) -> DataFrame:
    return rounded(df.select("stay_id", "step_index", *names))


@query
def td_error(s: Study) -> DataFrame:
    return _keys(qdiag.td_error(s.scored), "td_target", "td_error")


@query
def conservative_gap(s: Study) -> DataFrame:
    return _keys(qdiag.conservative_gap(s.scored), "cql_gap", "mean_q", "max_q")


@query
def masked_argmax(s: Study) -> DataFrame:
    return _keys(
        qdiag.masked_argmax(s.scored, 0.3), "policy_action", "n_supported", "support_rate", "behavior_entropy"
    )


@query
def expectile(s: Study) -> DataFrame:
    rows = qdiag.actor_loss(qdiag.expectile(s.scored))
    return _keys(rows, "advantage", "value_loss", "adv_weight", "actor_loss")


@query
def imitation_loss(s: Study) -> DataFrame:
    return _keys(qdiag.imitation_loss(s.scored), "imitation_loss")


@query
def greedy_action(s: Study) -> DataFrame:
    return _keys(qdiag.greedy_action(s.scored), "policy_action", "policy_q")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(Study(spark, sf_dir))

    return {name: bound(fn) for name, fn in CATALOG.items()}
