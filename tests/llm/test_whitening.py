import numpy as np
import pytest
from pyspark.sql import types as T

from stepweave.llm import queries
from stepweave.llm import whitening as wh

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
     *(T.StructField(c, T.StringType()) for c in ("id", "x", "v", "n", "component", "at"))]
)


def table_of(spark, rows, partitions=3):
    full = [(i, None if v is None else [None if c is None else float(c) for c in v], *"abcdef") for i, v in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def by_hand(vectors):
    x = [[int(np.floor(wh.SCALE * c)) + wh.SHIFT for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    scaled = [[n * c - s for c, s in zip(row, sums)] for row in x]
    centred = np.array(scaled, object).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return [sum(c * c for c in row) for row in scaled], centred, values[::-1], axes[:, ::-1]


def check(found, ids, vectors, components, tolerance=1e-9):
    deviations, centred, values, axes = by_hand(vectors)
    k = min(components, int((values > 1e-12 * values.sum()).sum()))
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    rows = {(r["vec_id"], r["component"]): r for r in found}
    assert len(rows) == len(found) == len(ids) * k
    sign = [np.sign(sum(rows[i, c + 1]["whitened"] * want[j, c] for j, i in enumerate(ids))) for c in range(k)]
    for j, i in enumerate(ids):
        for c in range(k):
            r = rows[i, c + 1]
            assert (r["n"], r["deviation"]) == (len(ids), deviations[j])
            assert abs(r["whitened"] * sign[c] - want[j, c]) < tolerance
            assert abs(r["explained"] - values[c] / values.sum()) < 1e-12
            assert r["identity_error"] < 1e-9


def test_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(4)
    for dims, components in ((5, 32), (60, 32), (80, 3)):
        vectors = (rng.standard_normal((120, dims)) * np.linspace(3, 1, dims)).tolist()
        frame = table_of(spark, list(enumerate(vectors)))
        found = wh.digest(wh.whiten(frame, components=components))
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        check(found.collect(), list(range(120)), vectors, components)


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(5)
    good = rng.standard_normal((40, 6)).tolist()
    bad = [(100, None), (101, []), (102, [1, None, 1, 1, 1, 1]), (103, [1, float("nan"), 1, 1, 1, 1]),
           (104, [1, float("inf"), 1, 1, 1, 1]), (105, [1, 2, 3]), (None, None)]
    found = wh.digest(wh.whiten(table_of(spark, list(enumerate(good)) + bad))).collect()
    check(found, list(range(40)), good, 32)


def test_repeated_rows_equal_ids_and_null_ids(spark):
    rows = [(1, [1, 0]), (1, [1, 0]), (None, [0, 3]), (2, [-2, 1]), (2, [5, 5])]
    found = wh.whiten(table_of(spark, rows)).collect()
    assert len(found) == 10 and sum(r["id"] is None for r in found) == 2
    assert {r["n"] for r in found} == {5}
    twice = [r["whitened"] for r in found if r["id"] == 1 and r["component"] == 1]
    assert twice[0] == twice[1]
    assert abs(sum(r["whitened"] ** 2 for r in found if r["component"] == 1) / 5 - 1) < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, [1, 2])], [(1, [1, 2]), (2, [1, 2])], [(1, None)]])
def test_no_variance_gives_no_rows(spark, rows):
    assert wh.whiten(table_of(spark, rows, 1)).collect() == []


def test_directions_without_variance_are_left_out(spark):
    rows = [(i, [i % 7, 2 * (i % 7), 4, (i * i) % 5]) for i in range(50)]
    found = wh.digest(wh.whiten(table_of(spark, rows))).collect()
    assert {r["component"] for r in found} == {1, 2}
    check(found, list(range(50)), [v for _, v in rows], 32)


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [1e300 * (-1) ** i, i, -1e12 * i]) for i in range(6)]
    found = wh.whiten(table_of(spark, rows)).collect()
    assert max(r["deviation"] for r in found) == 2**63 - 1
    assert all(np.isfinite(r["whitened"]) for r in found)
    centre = wh.Centre(3, [10, 20], 2**60)
    x = np.array([[2**60, -(2**60)]], np.int64)
    assert centre.scaled(x).tolist() == [[3 * 2**60 - 10, -3 * 2**60 - 20]]


@pytest.mark.parametrize(
    "spectrum",
    [np.r_[1e6, 1e3, np.linspace(3, 1, 148)], 10.0 ** -np.arange(150), np.ones(150), np.r_[np.ones(5), np.zeros(145)], np.linspace(2, 1.9, 150)],
    ids=["outliers", "steep", "equal", "low rank", "flat"],
)
def test_iteration_certifies_the_leading_pairs(spectrum):
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((150, 150)))[0]
    v = (q * spectrum) @ q.T
    passes = []

    def times(block):
        passes.append(block.shape[1])
        return v @ block

    values, axes, residual = wh.leading(times, 150, 32)
    assert np.abs(values - spectrum[:32]).max() < 1e-12 * spectrum[0]
    assert np.abs(axes.T @ axes - np.eye(32)).max() < 1e-12
    assert residual <= wh.CERTIFIED * spectrum[0]
    assert len(passes) < 250 and max(passes) <= 48


def test_query_on_the_bundled_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = queries.op11_whitening(spark, sf_dir).collect()
    check(found, [i for i, _ in rows], [v for _, v in rows], 32, 1e-6)
