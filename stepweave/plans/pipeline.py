"""The staged pipeline over raw clinical tables.

Each stage maps DataFrames to named result tables; :func:`run` chains them and
writes every stage as parquet, so the next stage starts from files.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions.skew import skew_join
from stepweave.operators import actions as act
from stepweave.operators import anchor, cohort, features, grid, rewards, scaling, split
from stepweave.operators import transitions as tr
from stepweave.operators.features import EventSource, Registry
from stepweave.operators.grid import GridConfig
from stepweave.presets import clinical
from stepweave.session import configure, cut_lineage
from stepweave.sources import artifacts, readers, writers

Tables = dict[str, DataFrame]
SPEC_VERSION = "1"


@dataclass(frozen=True)
class PipelineConfig:
    rules: cohort.CohortRules = cohort.CohortRules()
    onset: anchor.OnsetConfig = anchor.OnsetConfig()
    grid: GridConfig = GridConfig()
    reward: rewards.RewardConfig = rewards.RewardConfig()
    registry: Registry = field(default_factory=clinical.clinical_registry)
    seed: int = 42
    train: float = 0.70
    val: float = 0.15
    n_bins: int = 5
    # "imputed" fits the medians on a first imputed pass, "observed" on measured values only
    fit_on: str = "imputed"
    limit_stays: int | None = None


def cohort_stage(stays: DataFrame, patients: DataFrame, admissions: DataFrame, cfg: PipelineConfig) -> Tables:
    base = cut_lineage(cohort.merge_base(stays, patients, admissions))
    labelled = cohort.label_exclusions(base, cfg.rules)
    included, excluded = cohort.cohort_funnel(base, cfg.rules)
    return {
        "cohort": included,
        "cohort_excluded": excluded,
        "cohort_audit": cohort.cohort_audit(labelled),
        "exclusion_summary": cohort.exclusion_summary(excluded),
    }


def onset_stage(
    stays: DataFrame, cultures: DataFrame, antibiotics: DataFrame, chart: DataFrame, cfg: PipelineConfig
) -> Tables:
    """Onset per cohort stay from culture and antibiotic orders and score events."""
    admissions = stays.select("hadm_id").distinct()

    def orders(frame: DataFrame, time: str) -> DataFrame:
        rows = frame.select("hadm_id", F.col(time).alias("order_time"))
        return rows.join(admissions, "hadm_id", "left_semi")

    anchors = anchor.suspected_anchor(
        orders(antibiotics, "starttime"), orders(cultures, "culture_time"), "hadm_id", "order_time"
    )
    anchored = cut_lineage(anchor.attach_anchor(stays, anchors))
    # only stays with an anchor are searched for an onset
    wanted = anchored.where(F.col("anchor_time").isNotNull()).select("stay_id").distinct()
    measured = skew_join(readers.scan_scores(chart, clinical.SCORE_ITEMS), wanted, "stay_id", "left_semi")
    scores = cut_lineage(anchor.dysfunction_score(measured, clinical.SCORE_COMPONENTS))
    classified = cut_lineage(anchor.classify_onset(anchored, scores, cfg.onset))
    return {
        "onset": anchor.onset_usable(classified),
        "onset_unusable": anchor.onset_unusable(classified),
        "onset_candidates": anchor.onset_candidates(anchored, scores, classified, cfg.onset),
        "onset_audit": anchor.onset_audit(classified),
    }


def grid_stage(onsets: DataFrame, stays: DataFrame, admissions: DataFrame | None, cfg: PipelineConfig) -> Tables:
    episodes = cut_lineage(grid.grid_episodes(onsets, stays, admissions, cfg.grid))
    return {
        "episodes": episodes,
        "steps": grid.grid_steps(episodes, cfg.grid),
        "grid_audit": grid.grid_audit(episodes),
        "truncation_reasons": grid.truncation_reasons(episodes),
    }


def split_stage(episodes: DataFrame, cfg: PipelineConfig) -> Tables:
    splits = cut_lineage(split.group_split(episodes, seed=cfg.seed, train=cfg.train, val=cfg.val))
    return {
        "splits": splits,
        "manifest": split.split_manifest(episodes, splits),
        "split_stats": split.split_stats(episodes, splits),
        "leakage": split.leakage_check(episodes.select("subject_id", "stay_id").join(splits, "subject_id"), "stay_id"),
    }


def time_bounds(episodes: DataFrame) -> tuple[object, object]:
    """Earliest window start and latest window end, as literals for the scans."""
    return tuple(episodes.agg(F.min("window_start"), F.max("window_end")).first())


def event_sources(
    raw: Mapping[str, DataFrame], registry: Registry, episodes: DataFrame | None = None
) -> dict[str, EventSource]:
    """Sources of the preset, restricted to the items the registry uses and, with
    ``episodes``, to their owners and the time they span.
    """
    start, end = (None, None) if episodes is None else time_bounds(episodes)

    def wanted(table: str, source: str) -> DataFrame:
        return readers.scan_points(
            raw[table],
            features.items_of(registry, source),
            start,
            end,
            episodes,
            key="hadm_id" if table == "labevents" else "stay_id",
            time="starttime" if table == "inputevents" else "charttime",
        )

    return {
        "chart": EventSource(wanted("chartevents", "chart"), "charttime", "valuenum"),
        "lab": EventSource(wanted("labevents", "lab"), "charttime", "valuenum", key="hadm_id"),
        "input": EventSource(wanted("inputevents", "input"), "starttime", "amount"),
        "output": EventSource(wanted("outputevents", "output"), "charttime", "value"),
    }


def trajectory_stage(
    raw: Mapping[str, DataFrame],
    episodes: DataFrame,
    splits: DataFrame,
    ages: DataFrame,
    admissions: DataFrame,
    cfg: PipelineConfig,
) -> tuple[Tables, dict[str, dict[str, Any]], list[str]]:
    """State, actions, rewards and transitions; returns the tables, what was fitted as records, and the state columns."""
    registry = cfg.registry
    if cfg.limit_stays is not None:
        episodes = cut_lineage(readers.first_stays(episodes, cfg.limit_stays))
    start, end = time_bounds(episodes)
    listed = sorted({*features.items_of(registry, "input"), *clinical.FLUID_ITEMS, *clinical.AGENT_ITEMS})
    infused = readers.scan_intervals(raw["inputevents"], listed, start, end, episodes)
    weights = features.static_weight(infused)
    labels = features.outcome_label(episodes, admissions)
    context = features.step_context(episodes, ages, weights, splits, labels)
    drugs = readers.scan_intervals(raw["inputevents"], list(clinical.AGENT_ITEMS), start, end, episodes)
    rates = act.standardise_rate(drugs, clinical.AGENT_ITEMS, clinical.AGENT_FACTORS)
    fluids = readers.scan_points(
        raw["inputevents"], clinical.FLUID_ITEMS, start, end, episodes, time="starttime"
    )
    given = act.treatments(rates, fluids, episodes, clinical.FLUID_ITEMS, cfg=cfg.grid)
    sources = event_sources(raw, registry, episodes)
    measured = features.raw_state(sources, episodes, registry, cfg.grid, placed=given)
    wide = measured.join(context.drop("hadm_id", "onset_time"), "stay_id")
    wide = cut_lineage(wide.withColumn("hours_since_onset", F.col("hours_relative").cast("double")))

    train = scaling.train_rows(wide)
    first = features.impute_state(train, registry, {}, impute=cfg.fit_on == "imputed")
    medians = scaling.fit_medians(first, registry)
    bins = act.fit_bins(train, n_bins=cfg.n_bins, seed=cfg.seed)
    acted = act.assign_bins(wide, bins)
    state = features.clinical_proxy(features.impute_state(acted, registry, medians), clinical.PROXY_LIMITS)
    scaler = scaling.fit_scaler(scaling.train_rows(state), registry, medians)
    # rewards read the raw state, transitions the normalised one
    rewarded = rewards.with_rewards(state, cfg.reward)
    columns = features.feature_columns(registry)
    rows = cut_lineage(rewarded)
    normalised = scaling.apply_scaler(rows, scaler)
    transitions = tr.build_transitions(normalised, columns)
    records = {
        "medians": {"values": medians},
        "scaler": {"features": [artifacts.dataclass_record(t) for t in scaler]},
        "action_bins": artifacts.dataclass_record(bins),
        "reward_config": artifacts.dataclass_record(cfg.reward),
    }
    tables = {
        "state_raw": rows.select(
            "subject_id", "split", "stay_id", "step_index", *columns, "sofa_score", "mortality_90d"
        ),
        "state": normalised.select("subject_id", "split", "stay_id", "step_index", *columns),
        "actions": rows.select(
            "stay_id", "step_index", "vaso_dose_4h", "fluid_volume_4h", "vaso_bin", "fluid_bin", "action_id"
        ),
        "rewards": rows.select("stay_id", "step_index", *rewards.TERMS, "reward_total", "is_terminal"),
        "transitions": transitions,
        "reward_summary": rewards.reward_summary(rows),
    }
    return tables, records, columns


def run(
    spark: SparkSession, raw: Mapping[str, DataFrame], root: str, cfg: PipelineConfig = PipelineConfig()
) -> dict[str, str]:
    """All stages from raw tables to the replay table; returns the written paths.

    Tables go to parquet. What is fitted goes to versioned JSON records under
    ``artifacts``, the manifest to ``split`` with its summary record.
    ``raw`` holds the tables of :mod:`stepweave.sources.schemas` by name, with
    ``cultures`` and ``prescriptions`` as the order readers deliver them.
    """
    configure(spark)
    paths: dict[str, str] = {}

    def store(tables: Tables) -> None:
        paths.update(writers.write_stage(tables, root))

    def load(name: str) -> DataFrame:
        return spark.read.parquet(paths[name])

    store(cohort_stage(raw["stays"], raw["patients"], raw["admissions"], cfg))
    store(onset_stage(load("cohort"), raw["cultures"], raw["prescriptions"], raw["chartevents"], cfg))
    store(grid_stage(load("onset"), raw["stays"], raw["admissions"], cfg))
    divided = split_stage(load("episodes"), cfg)
    manifest = divided.pop("manifest")
    store(divided)
    paths["split"] = f"{root}/split"
    writers.write_manifest(manifest, paths["split"], cfg.seed, SPEC_VERSION)
    ages = raw["patients"].select("subject_id", F.col("anchor_age").cast("double").alias("age_years"))
    tables, records, columns = trajectory_stage(raw, load("episodes"), load("splits"), ages, raw["admissions"], cfg)
    transitions = tables.pop("transitions")
    store(tables)
    paths["artifacts"] = f"{root}/artifacts"
    for kind, record in records.items():
        artifacts.save(spark, paths["artifacts"], kind, record)
    paths["replay"] = f"{root}/replay"
    writers.write_replay(transitions, paths["replay"], columns)
    description = {
        "spec_version": SPEC_VERSION,
        "action_spec_version": SPEC_VERSION,
        "reward_spec_version": SPEC_VERSION,
        "manifest_seed": cfg.seed,
        "feature_columns": ",".join(columns),
    }
    replay = readers.read_replay(spark, paths["replay"], columns)
    meta = tr.dataset_meta(replay, cfg.n_bins**2, ["split"], description)
    store({"meta": meta.withColumn("split_label", F.col("split"))})
    counted = ("split", "n_episodes", "n_transitions", "state_dim")
    record = {k: v for k, v in description.items() if k != "feature_columns"} | {
        "feature_columns": columns,
        "n_actions": cfg.n_bins**2,
        # one row per split
        "splits": [{k: r[k] for k in counted} for r in load("meta").orderBy("split").collect()],
    }
    artifacts.save(spark, paths["artifacts"], "dataset_meta", record)
    return paths
