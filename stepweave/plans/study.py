"""The operators wired to the bundled test tables.

``events`` plays the long event table: a user is a stay, two neighbouring users
are one subject, the event type is the item. ``orders``, ``customer`` and
``lineitem`` play stays, patients and discharge times for the cohort funnel.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions.scalars import micros_between
from stepweave.functions.skew import skew_join
from stepweave.functions.vectors import softmax
from stepweave.operators import actions as act
from stepweave.operators import anchor, baselines, discretise, features, grid, ope, policy, rewards, safety, scaling
from stepweave.operators import split
from stepweave.operators import cohort as coh
from stepweave.operators import transitions as tr
from stepweave.operators.features import FORWARD_FILL, MEDIAN, NORMAL, ZERO, EventSource, FeatureSpec
from stepweave.operators.grid import GridConfig
from stepweave.operators.sweep import Setup, SweepPlan
from stepweave.plans.raw_study import RawStudy
from stepweave.session import configure, cut_lineage, scratch_path
from stepweave.sources import artifacts, writers

SEED = 42

COMPONENTS = {"low_error": (("error",), 80), "low_view": (("view",), 70), "low_click": (("click",), 70)}
ONSET = anchor.OnsetConfig(lookback_hours=72, lookahead_hours=120)
PROXY = {"view_last": 30.0, "click_min": 25.0, "error_max": 40.0}
AGENTS = {"purchase": "alpha", "error": "beta", "signup": "gamma"}
FACTORS = {"alpha": 1.0, "beta": 2.5, "gamma": 0.1}
FLUID = ("click",)
RULES = coh.CohortRules(min_age=18, max_age=90, min_los_hours=24)
REWARD_COLUMNS = {"sofa": "sofa_score", "lactate": "error_max", "pressure": "view_last"}
FULL = rewards.RewardConfig(rewards.FULL_SHAPED, lactate_weight=0.5, map_weight=0.01, map_threshold=40.0)
STATE_CUTS = ((0, (25.0, 60.0)), (4, (30.0, 70.0)))
N_ACTIONS = 25
# Behaviour probability of an action never seen in a state bin
UNSEEN_PROB = 0.01

REGISTRY = features.make_registry(
    [
        FeatureSpec("view_last", "events", ("view",), "last", FORWARD_FILL, (0.5, 200), (1, 150), 45, True),
        FeatureSpec("click_min", "events", ("click",), "min", FORWARD_FILL, (0.1, 180), (0.5, 120), 40, True),
        FeatureSpec("error_max", "events", ("error",), "max", MEDIAN, (0, 160), (0.2, 140), 35, True),
        FeatureSpec("purchase_mean", "events", ("purchase",), "mean", MEDIAN, (None, None), (1, 160), 42),
        FeatureSpec("signup_sum", "events", ("signup",), "sum", ZERO, (0, 120), (0, 300), 0, True, check_range=False),
        FeatureSpec(
            "paid_total", "events", ("click", "purchase"), "cumulative", ZERO, (0, 150), (0, 900), 0, check_range=False
        ),
        FeatureSpec("age_years", "static", (), "last", MEDIAN, (18, 120), (18, 110)),
        FeatureSpec(
            "click_error", "derived", (), "last", MEDIAN, (0.05, 20), (0.05, 10), 1, True, ("click_min", "error_max")
        ),
        FeatureSpec(
            "view_error", "derived", (), "last", FORWARD_FILL, (0, 10), (0, 5), 0.6, False, ("view_last", "error_max")
        ),
        FeatureSpec("hours_since_onset", "grid", (), "last", NORMAL, (-24, 48), (-24, 48), 0),
    ]
)
# A ratio of two ratios, listed before its parents
NESTED = FeatureSpec(
    "ratio_of_ratios", "derived", (), "last", FORWARD_FILL, (0, 50), (0.1, 20), 1.5, True, ("click_error", "view_error")
)
# Features under rules of the caller's own
OWN_RULES = {
    "share_above": features.Rule(lambda value, order, weight, limit: F.avg((value > limit).cast("double"))),
    "span": features.Rule(lambda value, order, weight: F.max(value) - F.min(value)),
    "largest_so_far": features.Rule(lambda value, order, weight: F.max(value), running=F.max),
}
OWN_SPECS = (
    FeatureSpec("view_high", "events", ("view",), "share_above", ZERO, (0.5, 200), params=(("limit", 50.0),)),
    FeatureSpec("view_low", "events", ("view",), "share_above", ZERO, (0.5, 200), params=(("limit", 20.0),)),
    FeatureSpec("click_span", "events", ("click", "view"), "span", ZERO, (0.1, 180)),
    FeatureSpec("error_peak", "events", ("error",), "largest_so_far", ZERO, (0, 160)),
)
# State components that get learned bins, and how many
BINNED = {"view_last": 4, "error_max": 3, "paid_total": 4}
SUBSETS = {
    "full_state": None,
    "clinical_core": ("view_last", "click_min", "error_max", "purchase_mean"),
    "hemodynamic_core": ("view_last", "paid_total"),
}


class Study:
    """Lazily built stages over one data directory.

    ``anchored``, ``episodes``, ``wide`` and ``transitions`` feed several consumers
    each and are written once to the shared checkpoint folder.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, setup: Setup = Setup()):
        self.spark, self.sf_dir, self.setup = configure(spark), sf_dir, setup
        self.cfg = GridConfig(step_hours=setup.step_hours)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def from_text(self) -> RawStudy:
        """The staged pipeline over raw text tables."""
        return RawStudy(self.spark, self.sf_dir)

    # --- cohort over orders, customer and lineitem

    @cached_property
    def cohort_base(self) -> DataFrame:
        shipped = self.table("lineitem").groupBy(F.col("l_orderkey").alias("stay_id")).agg(
            F.max("l_shipdate").alias("outtime")
        )
        orders = self.table("orders")
        stays = orders.select(
            F.col("o_custkey").alias("subject_id"),
            F.col("o_orderkey").alias("hadm_id"),
            F.col("o_orderkey").alias("stay_id"),
            F.col("o_orderdate").alias("intime"),
        ).join(shipped, "stay_id", "left")
        stays = stays.withColumn("los_hours", micros_between(F.col("intime"), F.col("outtime")) / 3.6e9)
        patients = self.table("customer").select(
            F.col("c_custkey").alias("subject_id"),
            F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 100).cast("int")).alias("anchor_age"),
            F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("gender"),
        )
        admissions = orders.select(
            F.col("o_orderkey").alias("hadm_id"),
            F.lit(None).cast("timestamp_ntz").alias("deathtime"),
            (F.col("o_orderstatus") == "F").cast("int").alias("hospital_expire_flag"),
        )
        return coh.merge_base(stays, patients, admissions)

    # --- episodes over events

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            F.col("user_id").alias("stay_id"),
            F.col("user_id").alias("hadm_id"),
            F.floor(F.col("user_id") / 2).alias("subject_id"),
            F.col("ts").alias("charttime"),
            F.col("event_type").alias("itemid"),
            F.col("value").alias("valuenum"),
            "props",
        )

    @cached_property
    def stays(self) -> DataFrame:
        return self.events.groupBy("stay_id", "hadm_id", "subject_id").agg(
            F.min("charttime").alias("intime"), F.max("charttime").alias("outtime")
        )

    @cached_property
    def deaths(self) -> DataFrame:
        fatal = self.events.where((F.col("itemid") == "error") & (F.pmod("stay_id", F.lit(4)) == 0))
        return fatal.groupBy("hadm_id").agg(F.max("charttime").alias("deathtime"))

    @cached_property
    def anchors(self) -> DataFrame:
        a = self.events.where(F.col("itemid") == "purchase")
        b = self.events.where(F.col("itemid") == "signup")
        return anchor.suspected_anchor(a, b, "hadm_id", "charttime")

    @cached_property
    def scores(self) -> DataFrame:
        daily = self.events.withColumn("charttime", F.date_trunc("day", "charttime").cast("timestamp_ntz"))
        return anchor.dysfunction_score(daily, COMPONENTS)

    @cached_property
    def anchored(self) -> DataFrame:
        return cut_lineage(anchor.attach_anchor(self.stays, self.anchors))

    @cached_property
    def classified(self) -> DataFrame:
        return anchor.classify_onset(self.anchored, self.scores, ONSET)

    @cached_property
    def episodes(self) -> DataFrame:
        onsets = anchor.onset_usable(self.classified)
        bounds = self.classified.select("stay_id", "intime", "outtime")
        return cut_lineage(grid.grid_episodes(onsets, bounds, self.deaths, self.cfg))

    @cached_property
    def steps(self) -> DataFrame:
        return grid.grid_steps(self.episodes, self.cfg)

    @cached_property
    def splits(self) -> DataFrame:
        return split.group_split(self.episodes, seed=SEED)

    # --- state

    @cached_property
    def registry(self) -> features.Registry:
        return features.select_features(REGISTRY, self.setup.features, flags=None if self.setup.flags else False)

    @cached_property
    def columns(self) -> list[str]:
        return features.feature_columns(self.registry)

    @cached_property
    def source(self) -> EventSource:
        return EventSource(self.events, "charttime", "valuenum", tie="event_id")

    @cached_property
    def ages(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("subject_id"), (F.col("c_acctbal") / 100).alias("age_years")
        )

    @cached_property
    def context(self) -> DataFrame:
        return features.step_context(self.episodes, ages=self.ages, splits=self.splits, outcomes=self.labels)

    @cached_property
    def raw(self) -> DataFrame:
        return features.raw_state({"events": self.source}, self.episodes, REGISTRY, self.cfg)

    @cached_property
    def wide(self) -> DataFrame:
        """Observed features and treatment levels per step, aggregated together."""
        given = act.treatments(self.rates, self.infusions, self.episodes, FLUID, cfg=self.cfg)
        rows = features.raw_state({"events": self.source}, self.episodes, REGISTRY, self.cfg, placed=given)
        rows = rows.join(self.context.drop("hadm_id", "onset_time"), "stay_id")
        return cut_lineage(rows.withColumn("hours_since_onset", F.col("hours_relative").cast("double")))

    @cached_property
    def medians(self) -> dict[str, float]:
        first_pass = features.impute_state(self.wide, REGISTRY, {})
        return scaling.fit_medians(scaling.train_rows(first_pass), REGISTRY)

    def imputed_with(self, rows: DataFrame, medians: dict[str, float]) -> DataFrame:
        return features.clinical_proxy(features.impute_state(rows, REGISTRY, medians), PROXY)

    def imputed(self, rows: DataFrame) -> DataFrame:
        return self.imputed_with(rows, self.medians)

    @cached_property
    def state(self) -> DataFrame:
        return self.imputed(self.wide)

    @cached_property
    def state_view(self) -> DataFrame:
        """The state restricted to the features and flags of this setup."""
        return self.state.select("stay_id", "step_index", *self.columns)

    @cached_property
    def labels(self) -> DataFrame:
        return features.outcome_label(self.episodes, self.deaths)

    @cached_property
    def scaler(self) -> list[scaling.FeatureTransform]:
        return scaling.fit_scaler(scaling.train_rows(self.state), REGISTRY, self.medians)

    # --- actions

    @cached_property
    def infusions(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").try_cast("double")
        return self.events.select(
            "stay_id",
            F.col("charttime").alias("starttime"),
            (F.col("charttime") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(F.col("valuenum") * 900)))
            .alias("endtime"),
            "itemid",
            F.col("valuenum").alias("amount"),
            (k / 100).alias("rate"),
            k.alias("patientweight"),
        )

    @cached_property
    def rates(self) -> DataFrame:
        return act.standardise_rate(self.infusions, AGENTS, FACTORS)

    @cached_property
    def vaso(self) -> DataFrame:
        return act.interval_weighted_mean(self.rates, self.episodes, self.steps, cfg=self.cfg)

    @cached_property
    def fluid(self) -> DataFrame:
        return act.point_sum(self.infusions, self.episodes, self.steps, items=FLUID, cfg=self.cfg)

    @cached_property
    def doses(self) -> DataFrame:
        return self.wide.select("stay_id", "step_index", "split", "vaso_dose_4h", "fluid_volume_4h")

    @cached_property
    def bins(self) -> act.ActionBins:
        return act.fit_bins(scaling.train_rows(self.doses), n_bins=self.setup.n_bins, seed=SEED)

    @cached_property
    def actions(self) -> DataFrame:
        return act.assign_bins(self.doses, self.bins)

    # --- rewards and transitions

    @cached_property
    def reward_config(self) -> rewards.RewardConfig:
        if self.setup.reward == rewards.FULL_SHAPED:
            return FULL
        return rewards.RewardConfig(self.setup.reward)

    def rewards_for(self, cfg: rewards.RewardConfig) -> DataFrame:
        return rewards.step_rewards(self.state, cfg, **REWARD_COLUMNS)

    def rewarded(self, state: DataFrame, cfg: rewards.RewardConfig) -> DataFrame:
        return rewards.with_rewards(state, cfg, **REWARD_COLUMNS)

    @cached_property
    def transitions(self) -> DataFrame:
        """Actions are a projection of the raw rows, so imputation, rewards and
        successors share one exchange and one sort by stay.
        """
        acted = act.assign_bins(self.wide, self.bins)
        rewarded = self.rewarded(self.imputed(acted), self.reward_config)
        return cut_lineage(tr.build_transitions(rewarded, self.columns))

    def part(self, label: str) -> DataFrame:
        return self.transitions.where(F.col("split") == label)

    # --- stored policies and learned state bins

    @cached_property
    def policy(self) -> policy.StoredPolicy:
        """Action values of a fixed network and a behaviour network fitted on train rows, stored and read back."""
        width = len(self.columns)
        values = policy.dense(
            (width, 8, N_ACTIONS),
            lambda layer, u, i: ((5 * u + 2 * i) % 13 - 6) / 50 if layer else ((7 * u + 3 * i) % 11 - 5) / 100,
            lambda layer, u: (3 * u) % 7 / 20 if layer else u % 3 - 1,
        )
        fitted = policy.fit_behaviour_network(self.part("train"), N_ACTIONS)
        path = scratch_path(self.spark, "policy")
        writers.write_table(policy.policy_frame(self.spark, policy.StoredPolicy(values, fitted)), path)
        return policy.policy_from(self.spark.read.parquet(path))

    @cached_property
    def cuts(self) -> list[discretise.Cut]:
        """Learned edges of some state components, stored and read back."""
        root = scratch_path(self.spark, "cuts")
        fitted = discretise.fit_cuts(self.part("train"), BINNED, self.columns)
        artifacts.save(self.spark, root, "state_cuts", {"cuts": [artifacts.dataclass_record(c) for c in fitted]})
        stored = artifacts.load(self.spark, root, "state_cuts")["cuts"]
        cuts = [discretise.Cut(c["component"], c["at"], tuple(c["edges"])) for c in stored]
        discretise.check_places(cuts, self.columns)
        return cuts

    @cached_property
    def fitted(self) -> dict[str, dict]:
        """Medians, scaler, action bins and reward configuration, stored and read back."""
        root = scratch_path(self.spark, "fitted")
        records = {
            "medians": {"values": self.medians},
            "scaler": {"features": [artifacts.dataclass_record(t) for t in self.scaler]},
            "action_bins": artifacts.dataclass_record(self.bins),
            "reward_config": artifacts.dataclass_record(self.reward_config),
        }
        for kind, record in records.items():
            artifacts.save(self.spark, root, kind, record)
        return {kind: artifacts.load(self.spark, root, kind) for kind in records}

    # --- text tables, as raw data come

    def as_text(self, name: str, rows: DataFrame) -> str:
        """``rows`` as a gzip CSV file of text; returns its path."""
        path = scratch_path(self.spark, name)
        writers.write_text(rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns)), path)
        return path

    @cached_property
    def text_stays(self) -> str:
        base = self.cohort_base
        los = (F.col("los_hours") / 24).alias("los")
        return self.as_text(
            "stays",
            base.select(
                "subject_id", "hadm_id", "stay_id", F.lit("A, B").alias("first_careunit"), F.lit("note").alias("note"),
                _stamp("intime").alias("intime"), _stamp("outtime").alias("outtime"), los,
            ),
        )

    @cached_property
    def text_patients(self) -> str:
        """Negative balances make ages that do not parse."""
        customer = self.table("customer")
        age = F.floor(F.col("c_acctbal") / 100).cast("string")
        return self.as_text(
            "patients",
            customer.select(
                F.lit(2150).alias("anchor_year"), F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("gender"),
                F.when(F.col("c_acctbal") < 0, F.lit("n/a")).otherwise(age).alias("anchor_age"),
            ),
        )

    @cached_property
    def text_admissions(self) -> str:
        """Every seventh death time is broken."""
        orders = self.table("orders").where("o_orderstatus = 'F'")
        broken = F.pmod("o_orderkey", F.lit(7)) == 0
        return self.as_text(
            "admissions",
            orders.select(
                F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"),
                F.when(broken, F.lit("31/12/2150")).otherwise(_stamp("o_orderdate")).alias("deathtime"),
                (F.col("o_totalprice") > 150000).cast("int").alias("hospital_expire_flag"),
            ),
        )

    @cached_property
    def text_cultures(self) -> str:
        """Odd events have a date only, every tenth one neither."""
        rows = self.events.where(F.col("itemid") == "signup")
        return self.as_text(
            "cultures",
            rows.select(
                "subject_id", "hadm_id", F.lit("BLOOD").alias("spec_type_desc"),
                F.when(F.col("event_id") % 10 > 0, F.date_format("charttime", "yyyy-MM-dd")).alias("chartdate"),
                F.when((F.col("event_id") % 2 == 0) & (F.col("event_id") % 10 > 0), _stamp("charttime")).alias("charttime"),
            ),
        )

    @cached_property
    def text_events(self) -> str:
        """Item codes instead of names; every thirteenth value does not parse."""
        codes = F.array(*(F.lit(i) for i in ITEMS))
        value = F.when(F.col("event_id") % 13 == 0, F.lit("> 99")).otherwise(F.col("valuenum").cast("string"))
        return self.as_text(
            "events",
            self.events.select(
                "event_id", "subject_id", "hadm_id", "stay_id", _stamp("charttime").alias("charttime"),
                F.array_position(codes, F.col("itemid")).alias("itemid"), value.alias("valuenum"),
            ),
        )

    @cached_property
    def ragged_orders(self) -> str:
        """Drug orders in which some rows have a field too many or too few."""
        path = scratch_path(self.spark, "orders")
        orders = self.table("orders")
        fields = ["o_custkey", "o_orderkey", _stamp("o_orderdate"), _stamp("o_orderdate"), "o_orderpriority"]
        whole = F.concat_ws(",", *(F.col(f).cast("string") if isinstance(f, str) else f for f in fields), F.lit("IV"))
        n = F.col("o_orderkey")
        line = (
            F.when(n % 11 == 0, F.concat_ws(",", whole, F.lit("more")))
            .when(n % 17 == 0, F.substring_index(whole, ",", 3))
            .otherwise(whole)
        )
        header = "subject_id,hadm_id,starttime,stoptime,drug,route"
        # a column named like the header, so that every file begins with it; no line holds the separator
        orders.select(line.alias(header)).write.option("header", True).option("sep", "\u0001").csv(path)
        return path

    # --- evaluation

    @property
    def state_bin(self) -> Column:
        return baselines.discretise(F.col("state"), STATE_CUTS)

    @property
    def rule(self) -> Column:
        """The fixed target policy."""
        view, error = F.col("state")[0], F.col("state")[4]
        return F.when(view < 30, 6).when(error > 60, 12).otherwise(0).cast("int")

    @cached_property
    def support(self) -> DataFrame:
        return baselines.behaviour_support(self.part("train"), self.state_bin)

    @cached_property
    def held_out(self) -> DataFrame:
        """Test steps with the behaviour probability of the logged action."""
        rows = self.part("test").withColumn("state_bin", self.state_bin).withColumn("policy_action", self.rule)
        table = self.support.select("state_bin", "action", "support_prob")
        joined = skew_join(rows, table, ["state_bin", "action"], "left")
        return joined.select(
            F.col("stay_id").alias("episode_id"), "step_index", "state", "action", "reward", "done", "policy_action",
            F.coalesce("support_prob", F.lit(UNSEEN_PROB)).alias("behavior_action_prob"),
        )

    @property
    def target_prob(self) -> Column:
        """A stochastic target: mostly the behaviour policy, partly the rule."""
        hit = ope.policy_prob(F.col("action"), F.col("policy_action"))
        return 0.7 * F.col("behavior_action_prob") + 0.3 * hit

    @cached_property
    def weights(self) -> DataFrame:
        return ope.episode_weights(self.held_out, self.target_prob, gamma=0.99, cap=5.0)

    @cached_property
    def review(self) -> DataFrame:
        band = F.when(F.col("step_index") < 6, "early").otherwise("late")
        return safety.safety_rows(self.held_out, self.support, self.state_bin, band)

    @cached_property
    def scored(self) -> DataFrame:
        """Transitions with action values and behaviour logits of a linear policy."""

        def values(state: Column) -> Column:
            ids = F.sequence(F.lit(0), F.lit(N_ACTIONS - 1))
            view, error = state[0], state[4]
            return F.transform(
                ids,
                lambda a: view * 0.004 * F.pmod(a, F.lit(5)) - error * 0.002 * F.floor(a / 5)
                + 0.1 * F.pmod(a * 7, F.lit(5)),
            )

        value = F.col("state")[0] * 0.008
        logits = F.transform(values(F.col("state")), lambda q: q * 2.0)
        return self.transitions.withColumns(
            {"q": values(F.col("state")), "q_next": values(F.col("next_state")), "logits": logits, "value": value}
        )

    @cached_property
    def frozen_values(self) -> DataFrame:
        q = self.scored.where(F.col("split") == "test").select(
            F.col("stay_id").alias("episode_id"), "step_index", "q"
        )
        return ope.initial_steps(q, ["q"])

    @cached_property
    def initial_probs(self) -> DataFrame:
        rows = self.scored.where(F.col("split") == "test").select(
            F.col("stay_id").alias("episode_id"), "step_index", softmax(F.col("logits")).alias("policy_probs")
        )
        return ope.initial_steps(rows, ["policy_probs"])

    @cached_property
    def metric_log(self) -> DataFrame:
        """A metric log: the event type is the metric, the user the run."""
        return self.table("events").select(
            F.col("event_id").alias("step"),
            F.dayofmonth("ts").cast("long").alias("epoch"),
            F.col("event_type").alias("name"),
            "value",
            F.pmod("user_id", F.lit(3)).alias("run"),
        )


# Item codes of the text tables, by place
ITEMS = ("view", "click", "error", "purchase", "signup")


def _stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def sweep_plan() -> SweepPlan:
    return SweepPlan(subsets=SUBSETS)
