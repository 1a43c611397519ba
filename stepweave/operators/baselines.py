"""Baseline policies: observed behaviour, no treatment, behaviour cloning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def episode_returns(
    transitions: DataFrame, gamma: float = 1.0, key: str = "stay_id", keep: Sequence[str] = ()
) -> DataFrame:
    """Discounted return, length and final reward per episode.

    The discount exponent is the absolute step index.
    """
    weight = F.lit(1.0) if gamma == 1.0 else F.pow(F.lit(float(gamma)), F.col("step_index"))
    return transitions.groupBy(*keep, key).agg(
        F.sum(weight * F.col("reward")).alias("episode_return"),
        F.count(F.lit(1)).alias("n_steps"),
        F.sum("reward").alias("reward_sum"),
        F.max_by("reward", F.when(F.col("done"), F.col("step_index"))).alias("terminal_reward"),
    )


def _summary(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    zero = F.lit(0.0)
    return returns.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.coalesce(F.sum("n_steps"), F.lit(0)).alias("n_transitions"),
        F.coalesce(F.avg("episode_return"), zero).alias("mean_episode_return"),
        F.coalesce(F.stddev_pop("episode_return"), zero).alias("std_episode_return"),
        F.coalesce(F.try_divide(F.sum("reward_sum"), F.sum("n_steps")), zero).alias("mean_reward"),
        F.coalesce(
            F.try_divide(F.count_if(F.col("terminal_reward") < 0).cast("double"), F.count(F.lit(1))), zero
        ).alias("mortality_rate"),
    )


def clinician_baseline(transitions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Statistics of the observed actions. ``by`` gives one row per group."""
    return _summary(episode_returns(transitions, keep=by), by)


def no_treatment_baseline(transitions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The observed rewards with every action set to 0."""
    return _summary(episode_returns(transitions, keep=by), by).withColumn("action", F.lit(0))


@dataclass
class BehaviourCloning:
    """Linear softmax policy; scoring is a JVM-side model transform."""

    model: LogisticRegressionModel
    n_actions: int

    def score(self, transitions: DataFrame) -> DataFrame:
        rows = self.model.transform(transitions.withColumn("features", array_to_vector("state")))
        return rows.withColumns(
            {
                # actions above the largest one seen have no class in the model
                "policy_probs": F.concat(
                    vector_to_array("probability"),
                    F.array_repeat(F.lit(0.0), self.n_actions - self.model.numClasses),
                ),
                "policy_action": F.col("prediction").cast("int"),
            }
        ).drop("features", "rawPrediction", "probability", "prediction")


def fit_behaviour_cloning(
    train: DataFrame, n_actions: int = 25, max_iter: int = 30, reg: float = 1e-4
) -> BehaviourCloning:
    """Multinomial logistic regression of the action on the state, fitted by
    tree-aggregated gradients over the partitions.
    """
    action = F.col("action")
    outside = F.raise_error(F.concat(F.lit("action outside the grid: "), action.cast("string"))).cast("double")
    label = F.when((action >= 0) & (action < n_actions), action.cast("double")).otherwise(outside)
    rows = train.select(array_to_vector("state").alias("features"), label.alias("label"))
    learner = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg, standardization=True)
    return BehaviourCloning(learner.fit(rows), n_actions)


def _accuracy(scored: DataFrame) -> float:
    hit = (F.col("policy_action") == F.col("action")).cast("double")
    return scored.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("a")).first()["a"]


def behaviour_cloning_report(
    train: DataFrame, evaluation: DataFrame | None = None, n_actions: int = 25, max_iter: int = 30
) -> tuple[DataFrame, BehaviourCloning]:
    """Top-1 accuracy on both sets and the return summary of the evaluated one."""
    policy = fit_behaviour_cloning(train, n_actions, max_iter)
    target = train if evaluation is None else evaluation
    scored = policy.score(target)
    report = _summary(episode_returns(target)).select(
        F.lit(train.count()).alias("n_train"),
        F.col("n_transitions").alias("n_eval"),
        F.lit(_accuracy(policy.score(train))).alias("train_accuracy"),
        F.lit(_accuracy(scored)).alias("eval_accuracy"),
        "mean_episode_return",
        "std_episode_return",
        "mortality_rate",
    )
    return report, policy


def discretise(state: Column, cuts: Sequence[tuple[int, Sequence[float]]]) -> Column:
    """Text code of a state: for each ``(index, edges)`` the number of edges below
    the component.
    """
    parts = []
    for index, edges in cuts:
        value = F.element_at(state, index + 1)
        above = sum((F.when(value > F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(0))
        parts.append(above.cast("string"))
    return F.concat_ws("-", *parts)


def behaviour_support(transitions: DataFrame, state_bin: Column) -> DataFrame:
    """``state_bin, action, support_count, support_prob`` of the observed actions.

    Shares come from two combined counts; the table has one row per observed
    (bin, action) however many transitions a bin holds.
    """
    counts = (
        transitions.withColumn("state_bin", state_bin)
        .groupBy("state_bin", "action")
        .agg(F.count(F.lit(1)).alias("support_count"))
    )
    totals = counts.groupBy("state_bin").agg(F.sum("support_count").alias("_all"))
    return counts.join(totals, "state_bin").select(
        "state_bin", "action", "support_count", (F.col("support_count") / F.col("_all")).alias("support_prob")
    )
