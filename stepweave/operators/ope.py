"""Off-policy evaluation on held-out trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.scalars import normal_split
from stepweave.functions.skew import skew_join
from stepweave.functions.vectors import dot, pick, total

# Labels of a held-out split
HELD_OUT = ("eval", "evaluation", "heldout", "holdout", "test")

# Fields two dataset descriptions must share
CONTRACT_FIELDS = (
    "spec_version", "n_actions", "state_dim", "action_spec_version",
    "reward_spec_version", "manifest_seed", "feature_columns",
)


def held_out_violations(steps: DataFrame, state_dim: int | None = None, key: str = "episode_id") -> DataFrame:
    """Broken trajectory rules, one row each: ``key, step_index, violation``."""
    shape = steps.groupBy(key).agg(F.max("step_index").alias("_last"))
    repeats = (
        steps.groupBy(key, "step_index")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where((F.col("_rows") > 1) | (F.col("step_index") < 0))
        .select(key, "step_index", F.lit("step_order").alias("violation"))
    )
    prob = F.col("behavior_action_prob")
    is_last = F.col("step_index") == F.col("_last")
    wrong_dim = F.lit(False) if state_dim is None else F.col("_dim") != state_dim
    broken = F.array_compact(
        F.array(
            F.when(prob.isNull() | F.isnan(prob) | ~((prob > 0) & (prob <= 1)), F.lit("behavior_prob")),
            F.when(wrong_dim, F.lit("state_dim")),
            F.when(~is_last & F.col("done"), F.lit("early_done")),
            F.when(is_last & ~F.col("done"), F.lit("last_not_done")),
        )
    )
    rows = skew_join(
        steps.select(key, "step_index", "done", "behavior_action_prob", F.size("state").alias("_dim")), shape, key
    ).select(key, "step_index", F.explode(broken).alias("violation"))
    return rows.unionByName(repeats)


def policy_prob(action: Column, policy_action: Column | None = None, policy_probs: Column | None = None) -> Column:
    """Probability the target policy gives the logged action."""
    if policy_probs is not None:
        prob = pick(policy_probs, action)
        return F.when((prob >= 0) & (prob <= 1), prob).otherwise(
            F.raise_error(F.lit("policy probability outside [0, 1]")).cast("double")
        )
    chosen = F.when(policy_action >= 0, policy_action).otherwise(
        F.raise_error(F.lit("policy chose a negative action")).cast("int")
    )
    return F.when(chosen == action, 1.0).otherwise(0.0)


def episode_weights(
    steps: DataFrame, probability: Column, gamma: float = 1.0, cap: float | None = None, key: str = "episode_id"
) -> DataFrame:
    """Return, importance weight and matched steps per episode.

    The weight is the product of ``min(π/b, cap)``; it is a mergeable aggregate.
    """
    rows = steps.withColumn("_pi", probability)
    step_ratio = F.col("_pi") / F.col("behavior_action_prob")
    if cap is not None:
        step_ratio = F.least(step_ratio, F.lit(float(cap)))
    weighted = F.pow(F.lit(float(gamma)), F.col("step_index")) * F.col("reward")
    return rows.groupBy(key).agg(
        F.sum(weighted).alias("discounted_return"),
        F.product(step_ratio).alias("importance_weight"),
        F.count_if(F.col("_pi") > 0).alias("matched_steps"),
        F.count(F.lit(1)).alias("n_steps"),
    ).withColumn("matched_step_fraction", F.col("matched_steps") / F.col("n_steps"))


def wis_ess(weights: DataFrame) -> DataFrame:
    """One row of weighted importance sampling metrics; 0 where no weight is left."""
    w, g = F.col("importance_weight"), F.col("discounted_return")
    sums = weights.agg(
        F.sum(w).alias("_w"), F.sum(w * w).alias("_w2"), F.sum(w * g).alias("_wg"),
        F.count(F.lit(1)).alias("n_episodes"), F.count_if(w > 0).alias("nonzero"), F.avg(g).alias("mean_return"),
    )
    return sums.select(
        F.when(F.col("_w") > 0, F.col("_wg") / F.col("_w")).otherwise(0.0).alias("wis"),
        F.when((F.col("_w") > 0) & (F.col("_w2") > 0), F.col("_w") * F.col("_w") / F.col("_w2"))
        .otherwise(0.0)
        .alias("ess"),
        "n_episodes",
        F.col("_w").alias("wis_weight_sum"),
        F.col("nonzero").alias("wis_nonzero_episodes"),
        F.col("mean_return").alias("mean_behavior_return"),
    )


def initial_steps(steps: DataFrame, columns: Sequence[str], key: str = "episode_id") -> DataFrame:
    """The named columns of each episode's first step."""
    first = steps.groupBy(key).agg(F.min("step_index").alias("step_index"))
    return steps.select(key, "step_index", *columns).join(first, [key, "step_index"], "left_semi").drop("step_index")


def fqe_score(
    initial: DataFrame,
    values: DataFrame,
    fitted_split: str,
    n_actions: int = 25,
    policy_action: str | None = None,
    policy_probs: str | None = None,
    key: str = "episode_id",
) -> DataFrame:
    """Mean frozen action value of the policy in the initial states.

    ``initial`` has one row per episode with the policy's action or
    probabilities, ``values`` one row per episode with ``q`` (n_actions wide).
    Values fitted on a held-out split, a wrong width or an episode without
    values are errors.
    """
    if fitted_split.strip().lower() in HELD_OUT:
        raise ValueError("frozen values must not be fitted on the held-out split")
    q = F.when(F.size("q") == n_actions, F.col("q")).otherwise(
        F.raise_error(F.lit("action values missing or of wrong width")).cast("array<double>")
    )
    once = F.when(F.count(F.lit(1)) == 1, F.first("q")).otherwise(
        F.raise_error(F.lit("several rows of action values for one episode")).cast("array<double>")
    )
    rows = initial.join(values.groupBy(key).agg(once.alias("q")), key, "left").withColumn("q", q)
    if policy_probs is not None:
        mass = total(F.col(policy_probs))
        safe = F.when(mass > 0, mass).otherwise(F.raise_error(F.lit("policy without probability mass")).cast("double"))
        value = dot(F.col(policy_probs), F.col("q")) / safe
    else:
        value = pick(F.col("q"), F.col(policy_action))
    return rows.agg(F.avg(value).alias("fqe"), F.count(F.lit(1)).alias("n_episodes"))


def contract_check(train_meta: DataFrame, held_meta: DataFrame, fields: Sequence[str] = CONTRACT_FIELDS) -> DataFrame:
    """Drift between two one-row dataset descriptions: ``field, train, held_out``.

    Both must have all ``fields``.
    """
    for name, meta in (("train", train_meta), ("held-out", held_meta)):
        absent = sorted(set(fields) - set(meta.columns))
        if absent:
            raise ValueError(f"the {name} description lacks contract fields: {absent}")

    def long(meta: DataFrame, name: str) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields]
        )
        return meta.select(F.inline(pairs))

    drift = long(train_meta, "train").join(long(held_meta, "held_out"), "field")
    drift = drift.where(~F.col("train").eqNullSafe(F.col("held_out")))
    if "split_label" not in held_meta.columns:
        return drift
    wrong = held_meta.where(~normal_split(F.col("split_label")).isin(list(HELD_OUT))).select(
        F.lit("split_label").alias("field"),
        F.lit(None).cast("string").alias("train"),
        F.col("split_label").alias("held_out"),
    )
    return drift.unionByName(wrong)


def evaluate_policy(
    steps: DataFrame,
    values: DataFrame,
    fitted_split: str,
    gamma: float = 1.0,
    cap: float | None = None,
    n_actions: int = 25,
    policy_action: str | None = "policy_action",
    policy_probs: str | None = None,
    key: str = "episode_id",
    train_meta: DataFrame | None = None,
    held_meta: DataFrame | None = None,
) -> DataFrame:
    """Combined one-row report: importance sampling metrics plus ``fqe``.

    Trajectories that break a rule, no trajectory at all, and drift between
    ``train_meta`` and ``held_meta``, if given, are errors.
    """
    broken = held_out_violations(steps, key=key).first()
    if broken is not None:
        raise ValueError(f"held-out trajectories break a rule: {broken.asDict()}")
    if train_meta is not None and held_meta is not None:
        drift = contract_check(train_meta, held_meta).collect()  # one row per field
        if drift:
            raise ValueError(f"dataset descriptions differ: {[r.asDict() for r in drift]}")
    chosen = policy_probs or policy_action
    prob = policy_prob(
        F.col("action"),
        F.col(policy_action) if policy_probs is None else None,
        F.col(policy_probs) if policy_probs else None,
    )
    metrics = wis_ess(episode_weights(steps, prob, gamma, cap, key))
    fqe = fqe_score(
        initial_steps(steps, [chosen], key), values, fitted_split, n_actions,
        None if policy_probs else policy_action, policy_probs, key,
    )
    # two one-row tables put side by side
    both = metrics.unionByName(fqe.select("fqe"), allowMissingColumns=True)
    row = both.agg(*[F.max(c).alias(c) for c in both.columns])
    some = F.when(F.col("n_episodes") > 0, F.col("n_episodes")).otherwise(
        F.raise_error(F.lit("no held-out episodes")).cast("long")
    )
    return row.withColumn("n_episodes", some)
