import numpy as np
import pytest

from stepweave.operators import baselines, discretise, policy
from stepweave.operators.policy import Layer, Network, StoredPolicy

ROWS = "stay_id long, step_index int, state array<double>, action int"


def net(seed, sizes=(3, 5, 4), hidden="relu"):
    rng = np.random.default_rng(seed)
    return policy.dense(sizes, lambda layer, u, i: rng.normal(), lambda layer, u: rng.normal(), hidden)


def by_hand(network, x):
    for layer in network.layers:
        x = [sum(w * v for w, v in zip(row, x)) + b for row, b in zip(layer.weights.tolist(), layer.bias.tolist())]
        if layer.activation == "relu":
            x = [max(0.0, v) for v in x]
        elif layer.activation == "tanh":
            x = [float(np.tanh(v)) for v in x]
    return x


def states(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i // 5, i % 5, rng.normal(size=3).tolist(), int(rng.integers(4))) for i in range(n)]
    return rows, spark.createDataFrame(rows, ROWS).repartition(3)


@pytest.mark.parametrize("hidden", policy.ACTIVATIONS)
def test_scores_equal_a_plain_forward_pass(spark, hidden):
    network = net(3, hidden=hidden)
    rows, frame = states(spark)
    got = {(r.stay_id, r.step_index): r for r in policy.score_policy(frame, StoredPolicy(network)).collect()}
    for stay, step, x, _ in rows:
        q = by_hand(network, x)
        r = got[stay, step]
        assert r.q_values == pytest.approx(q) and r.policy_action == q.index(max(q)) and r.policy_q == pytest.approx(max(q))


def test_masked_policy_takes_supported_actions_only(spark):
    values, behaviour = net(4), net(5)
    rows, frame = states(spark)
    scored = policy.score_policy(frame, StoredPolicy(values, behaviour, 0.5)).collect()
    got = {(r.stay_id, r.step_index): r for r in scored}
    differ = 0
    for stay, step, x, _ in rows:
        q, z = by_hand(values, x), by_hand(behaviour, x)
        p = [np.exp(v) / sum(np.exp(z)) for v in z]
        allowed = [i for i in range(4) if p[i] >= 0.5 * max(p)]
        best = max(allowed, key=lambda i: q[i])
        assert got[stay, step].policy_action == best and got[stay, step].policy_probs == pytest.approx(p)
        differ += best != q.index(max(q))
    assert differ


def test_first_of_equal_actions_and_null_states(spark):
    flat = Network((Layer(np.zeros((4, 3)), np.array([1.0, 2.0, 2.0, 0.0])),))
    frame = spark.createDataFrame([(1, 0, [0.0, 0.0, 0.0], 0), (1, 1, None, 0)], ROWS)
    rows = {r.step_index: r for r in policy.score_policy(frame, StoredPolicy(flat)).collect()}
    assert (rows[0].policy_action, rows[0].policy_q) == (1, 2.0)
    assert (rows[1].policy_action, rows[1].policy_q, rows[1].q_values) == (None, None, None)
    empty = spark.createDataFrame([], ROWS)
    assert policy.score_policy(empty, StoredPolicy(flat)).collect() == []


@pytest.mark.parametrize("state", [[1.0, 2.0], [1.0, 2.0, None], [1.0, 2.0, float("nan")]])
def test_unfit_states_fail(spark, state):
    frame = spark.createDataFrame([(1, 0, state, 0)], ROWS)
    with pytest.raises(Exception, match="3 numbers"):
        policy.score_policy(frame, StoredPolicy(net(1))).collect()


def test_store_and_reload(spark, tmp_path):
    stored = StoredPolicy(net(6, hidden="tanh"), net(7, (3, 4)), 0.2)
    policy.policy_frame(spark, stored).repartition(3).write.parquet(f"{tmp_path}/policy")
    back = policy.policy_from(spark.read.parquet(f"{tmp_path}/policy"), 0.2)
    for name in stored.nets:
        for a, b in zip(stored.nets[name].layers, back.nets[name].layers, strict=True):
            assert a.activation == b.activation and (a.weights == b.weights).all() and (a.bias == b.bias).all()
    with pytest.raises(ValueError, match="too large"):
        policy.policy_from(spark.read.parquet(f"{tmp_path}/policy"), most=10)


def test_broken_stores_are_found(spark):
    frame = policy.policy_frame(spark, StoredPolicy(net(6)))
    for broken, message in (
        (frame.where("layer <> 0"), "layer 0"),
        (frame.where("NOT (layer = 1 AND unit = 2)"), "layer 1"),
        (frame.unionByName(frame), "twice"),
        (frame.where("false"), "no action values"),
        (frame.where("NOT (layer = 0 AND unit = 4)"), "do not fit"),
    ):
        with pytest.raises(ValueError, match=message):
            policy.policy_from(broken)


def test_networks_that_do_not_fit():
    with pytest.raises(ValueError, match="neighbouring"):
        Network((Layer(np.ones((2, 3)), np.ones(2)), Layer(np.ones((2, 3)), np.ones(2))))
    with pytest.raises(ValueError, match="finite"):
        Layer(np.array([[np.nan]]), np.ones(1))
    with pytest.raises(ValueError, match="equal inputs"):
        StoredPolicy(net(1), net(1, (2, 4)))
    with pytest.raises(ValueError, match="too large"):
        StoredPolicy(Network((Layer(np.zeros((2_001, 2_000)), np.zeros(2_001)),)))


def test_behaviour_network_is_the_diagonal_discriminant(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        action = int(rng.choice([0, 2, 3], p=[0.5, 0.3, 0.2]))
        rows.append((i, 0, [float(action), rng.normal() + 3 * (action == 2), 7.0], action))
    frame = spark.createDataFrame(rows, ROWS)
    network = policy.fit_behaviour_network(frame, 4)
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    var = x.var(0)
    for a in (0, 2, 3):
        mean = x[y == a].mean(0)
        weights = np.where(var > 1e-12, mean / np.where(var > 1e-12, var, 1), 0)
        bias = np.log((y == a).mean()) - (np.where(var > 1e-12, mean**2 / np.where(var > 1e-12, var, 1), 0) / 2).sum()
        assert network.layers[0].weights[a] == pytest.approx(weights) and network.layers[0].bias[a] == pytest.approx(bias)
    hit = policy.score_policy(frame, StoredPolicy(network)).where("policy_action = action").count()
    assert hit > 0.95 * len(rows)
    assert network.layers[0].bias[1] == policy.UNSEEN
    with pytest.raises(ValueError, match="outside"):
        policy.fit_behaviour_network(frame, 3)
    with pytest.raises(ValueError, match="no transitions"):
        policy.fit_behaviour_network(frame.where("false"), 4)


def test_learned_cuts_are_exact_quantiles_and_merge(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 0, [float(rng.normal()), float(i % 2), float("nan") if i else 1.0], 0) for i in range(101)]
    frame = spark.createDataFrame(rows, ROWS)
    cuts = discretise.fit_cuts(frame, {"a": 4, "b": 5, "a2": 2}, ["a", "b", "a2"])
    first = np.quantile([r[2][0] for r in rows], [0.25, 0.5, 0.75])
    assert cuts[0].edges == pytest.approx(first) and (cuts[0].component, cuts[0].at) == ("a", 0)
    assert cuts[1].edges == (0.0, 1.0)
    codes = frame.select(discretise.state_bin(cuts[:2]).alias("c")).distinct().collect()
    assert {r.c.split("-")[0] for r in codes} == {"0", "1", "2", "3"}
    counts = baselines.behaviour_support(frame, discretise.state_bin(cuts[:1])).collect()
    assert max(r.support_count for r in counts) - min(r.support_count for r in counts) <= 1
    discretise.check_places(cuts, ["a", "b", "a2"])
    with pytest.raises(ValueError, match="not where"):
        discretise.check_places(cuts, ["b", "a", "a2"])
    with pytest.raises(ValueError, match="unknown"):
        discretise.fit_cuts(frame, {"z": 3}, ["a"])
    with pytest.raises(ValueError, match="two bins"):
        discretise.fit_cuts(frame, {"a": 1}, ["a"])
    assert discretise.fit_cuts(frame.where("false"), {"a": 3}, ["a"])[0].edges == ()
