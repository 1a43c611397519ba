"""Stored policies scored in batches: small networks, written as tables and applied inside tasks.

A network is a stack of dense layers. Stored, it is a table with one row per
unit, so it is written and read by Spark like any other result. Scoring sends
the weights to the executors once, after their number is checked, and multiplies
one Arrow batch of states at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a policy may hold, as a bound on the broadcast: 32 MB of doubles.
MAX_PARAMETERS = 4_000_000
VALUES, BEHAVIOUR = "values", "behaviour"
ACTIVATIONS = ("relu", "tanh", "linear")

# Bias of an action never seen, and the variance below which a component is constant
UNSEEN = -1e9
NO_SPREAD = 1e-12

UNITS = "net string, layer int, unit int, activation string, bias double, weights array<double>"


@dataclass(frozen=True)
class Layer:
    """``activation(weights @ x + bias)``; ``weights`` has one row per unit."""

    weights: np.ndarray
    bias: np.ndarray
    activation: str = "linear"

    def __post_init__(self) -> None:
        if self.weights.ndim != 2 or self.bias.shape != (len(self.weights),):
            raise ValueError("a layer needs a matrix of weights and one bias per unit")
        if self.activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {self.activation!r}")
        if not (np.isfinite(self.weights).all() and np.isfinite(self.bias).all()):
            raise ValueError("a layer holds weights that are not finite")


@dataclass(frozen=True)
class Network:
    layers: tuple[Layer, ...]

    def __post_init__(self) -> None:
        if not self.layers:
            raise ValueError("a network needs a layer")
        for before, after in zip(self.layers, self.layers[1:]):
            if after.weights.shape[1] != len(before.weights):
                raise ValueError("neighbouring layers do not fit")

    @property
    def inputs(self) -> int:
        return self.layers[0].weights.shape[1]

    @property
    def outputs(self) -> int:
        return len(self.layers[-1].weights)

    @property
    def parameters(self) -> int:
        return sum(layer.weights.size + layer.bias.size for layer in self.layers)


@dataclass(frozen=True)
class StoredPolicy:
    """Action values and, for a masked policy, a behaviour network with the share ``threshold``
    of the likeliest action's probability that an action needs to be taken.
    """

    values: Network
    behaviour: Network | None = None
    threshold: float = 0.3

    def __post_init__(self) -> None:
        if self.behaviour is not None:
            if (self.behaviour.inputs, self.behaviour.outputs) != (self.values.inputs, self.values.outputs):
                raise ValueError("the networks of a policy need equal inputs and actions")
        if self.parameters > MAX_PARAMETERS:
            raise ValueError(f"a policy of {self.parameters} parameters is too large to broadcast")

    @property
    def nets(self) -> dict[str, Network]:
        return {VALUES: self.values} | ({BEHAVIOUR: self.behaviour} if self.behaviour else {})

    @property
    def parameters(self) -> int:
        return sum(net.parameters for net in self.nets.values())


def policy_frame(spark: SparkSession, policy: StoredPolicy) -> DataFrame:
    """One row per unit of every layer."""
    rows = [
        (name, i, unit, layer.activation, float(layer.bias[unit]), layer.weights[unit].tolist())
        for name, net in policy.nets.items()
        for i, layer in enumerate(net.layers)
        for unit in range(len(layer.bias))
    ]
    return spark.createDataFrame(rows, UNITS)


def policy_from(stored: DataFrame, threshold: float = 0.3, most: int = MAX_PARAMETERS) -> StoredPolicy:
    """Read a stored policy back. Its size is checked before anything comes to the driver."""
    size = stored.agg(F.sum(F.size("weights") + 1)).first()[0] or 0
    if size > most:
        raise ValueError(f"a policy of {size} parameters is too large to broadcast")
    found: dict[str, dict[int, dict[int, tuple]]] = {}
    for r in stored.collect():
        units = found.setdefault(r["net"], {}).setdefault(r["layer"], {})
        if r["unit"] in units:
            raise ValueError(f"unit {r['unit']} of layer {r['layer']} is stored twice")
        units[r["unit"]] = (r["activation"], r["bias"], r["weights"])
    if VALUES not in found:
        raise ValueError("the stored policy has no action values")
    return StoredPolicy(
        network_of(found[VALUES]), network_of(found[BEHAVIOUR]) if BEHAVIOUR in found else None, threshold
    )


def network_of(layers: Mapping[int, Mapping[int, tuple]]) -> Network:
    """A network from ``layer -> unit -> (activation, bias, weights)``, complete and in order."""
    built = []
    for i in range(len(layers)):
        units = layers.get(i, {})
        if not units or set(units) != set(range(len(units))):
            raise ValueError(f"layer {i} of a stored network is incomplete")
        rows = [units[u] for u in range(len(units))]
        if len({len(w) for _, _, w in rows}) != 1 or len({a for a, _, _ in rows}) != 1:
            raise ValueError(f"the units of layer {i} do not fit each other")
        built.append(Layer(np.array([w for _, _, w in rows]), np.array([b for _, b, _ in rows]), rows[0][0]))
    return Network(tuple(built))


def score_policy(rows: DataFrame, policy: StoredPolicy, state: str = "state") -> DataFrame:
    """``rows`` with ``policy_action``, ``policy_q``, ``q_values`` and, for a masked policy, ``policy_probs``.

    The action is the first of the best ones among those the behaviour network
    supports. A null state gives nulls; a state of another width, or one with a
    missing or NaN component, fails the job.
    """
    width, share = policy.values.inputs, min(max(policy.threshold, 0.0), 1.0)
    masked = policy.behaviour is not None
    plain = {
        name: [(layer.weights, layer.bias, layer.activation) for layer in net.layers]
        for name, net in policy.nets.items()
    }
    sent = rows.sparkSession.sparkContext.broadcast(plain)
    added = [
        T.StructField("policy_action", T.IntegerType()),
        T.StructField("policy_q", T.DoubleType()),
        T.StructField("q_values", T.ArrayType(T.DoubleType())),
        *([T.StructField("policy_probs", T.ArrayType(T.DoubleType()))] if masked else []),
    ]
    taken = {f.name for f in added} & set(rows.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")
    schema = T.StructType([*rows.schema.fields, *added])

    # everything a task needs is nested, so executors need nothing but numpy and pyarrow
    def forward(layers: list[tuple], x: np.ndarray) -> np.ndarray:
        for weights, bias, activation in layers:
            x = x @ weights.T + bias
            if activation == "relu":
                x = np.maximum(x, 0)
            elif activation == "tanh":
                x = np.tanh(x)
        return x

    def lists(matrix: np.ndarray, fine: np.ndarray) -> pa.Array:
        sizes = np.where(fine, matrix.shape[1], 0)
        ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), mask=np.r_[~fine, False])
        return pa.ListArray.from_arrays(ends, pa.array(matrix.ravel()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets = sent.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(state))
            fine = ~column.is_null().to_numpy(zero_copy_only=False)
            given = column.filter(pa.array(fine))
            flat = given.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(float)
            if any(len(s) != width for s in given) or flat.null_count or np.isnan(x).any():
                raise ValueError(f"a state needs {width} numbers")
            x = x.reshape(-1, width)
            q = forward(nets["values"], x)
            choice = q
            if masked:
                logits = forward(nets["behaviour"], x)
                probs = np.exp(logits - logits.max(1, keepdims=True))
                probs /= probs.sum(1, keepdims=True)
                choice = np.where(probs >= share * probs.max(1, keepdims=True), q, -np.inf)
            best = choice.argmax(1)
            action, value = np.zeros(len(fine), np.int32), np.zeros(len(fine))
            action[fine], value[fine] = best, q[np.arange(len(q)), best]
            columns = [pa.array(action, mask=~fine), pa.array(value, mask=~fine), lists(q, fine)]
            if masked:
                columns.append(lists(probs, fine))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    return rows.mapInArrow(score, schema)


def fit_behaviour_network(train: DataFrame, n_actions: int = 25, state: str = "state") -> Network:
    """A linear softmax network of the observed actions: the discriminant of normal classes that
    share one diagonal covariance.

    It is fitted by two aggregations, per (action, component) and per component.
    A component without spread has no weight; an action never seen is out of
    reach of every other.
    """
    entries = train.select("action", F.posexplode(state).alias("at", "x"))
    means = entries.groupBy("action", "at").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n")).collect()
    spread = {r["at"]: r["var"] for r in entries.groupBy("at").agg(F.var_pop("x").alias("var")).collect()}
    outside = sorted({r["action"] for r in means if not 0 <= r["action"] < n_actions})
    if outside:
        raise ValueError(f"actions outside the grid: {outside}")
    if not means:
        raise ValueError("no transitions to fit a behaviour network on")
    weights, bias = np.zeros((n_actions, len(spread))), np.full(n_actions, UNSEEN)
    total = sum(r["n"] for r in means if r["at"] == 0)
    for r in means:
        if r["at"] == 0:
            bias[r["action"]] = np.log(r["n"] / total)
    for r in means:
        if spread[r["at"]] > NO_SPREAD:
            weights[r["action"], r["at"]] = r["mean"] / spread[r["at"]]
            bias[r["action"]] -= r["mean"] ** 2 / (2 * spread[r["at"]])
    return Network((Layer(weights, bias),))


def dense(sizes: Sequence[int], weight, bias, hidden: str = "relu") -> Network:
    """A network of given layer sizes from rules ``weight(layer, unit, input)`` and ``bias(layer, unit)``."""
    layers = []
    for i, (inputs, units) in enumerate(zip(sizes, sizes[1:])):
        matrix = np.array([[weight(i, u, k) for k in range(inputs)] for u in range(units)], float)
        last = i == len(sizes) - 2
        layers.append(Layer(matrix, np.array([bias(i, u) for u in range(units)], float), "linear" if last else hidden))
    return Network(tuple(layers))
