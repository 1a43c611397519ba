import math

import numpy as np

from stepweave.llm import cover_tree


def by_hand(rows, asked, k):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {q: v for q, v in whole if q in asked}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def rows():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8))
    out = [(i, (centres[i % 6] + rng.normal(size=8) * [0.01, 0.3][i % 2]).tolist()) for i in range(400)]
    out += [(1000 + i, out[7][1]) for i in range(60)]
    out += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [math.nan] * 8), (2003, [math.inf] * 8), (None, [0.1] * 8)]
    out += [(2100, [1.0, 2.0]), (2200, [0.5, -2.0]), (2300, []), (2400, [0.0] * 8), (2500, [3e6] * 8), (2600, [-1e5] * 8)]
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS dim", "1 AS db", "2 AS v").repartition(3)


def test_equals_brute_force(spark, monkeypatch):
    data = rows()
    vectors = frame(spark, data)
    for block in (10_000, 90):
        monkeypatch.setattr(cover_tree, "DATA_BLOCK", block)
        monkeypatch.setattr(cover_tree, "QUERY_BLOCK", block // 20)
        got = sorted(map(tuple, cover_tree.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10).collect()))
        assert got == by_hand(data, {i for i, _ in data if i is not None and i % 100 == 0}, 10)


def test_few_and_no_candidates(spark):
    one = frame(spark, [(0, [1.0, 1.0])])
    assert cover_tree.top_k(one, one).count() == 0
    two = frame(spark, [(0, [1.0, 1.0]), (3, [0.5, 0.25])])
    assert [tuple(r) for r in cover_tree.top_k(two, two.where("vec_id = 0")).collect()] == [(0, 1, 3, 1024 * 768)]
    none = one.where("vec_id = 99")
    assert cover_tree.top_k(none, none).count() == 0


def test_tree_covers_and_prunes():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 5
    points = np.floor(1024 * (centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16)) * 0.05))
    tree = cover_tree.Tree(points, 48)
    for n in range(len(tree.low)):
        inside = tree.points[tree.low[n] : tree.high[n]]
        assert (np.sqrt(((inside - tree.centres[n]) ** 2).sum(1)) <= tree.radius[n]).all()
        if len(tree.children[n]):
            assert sum(tree.high[c] - tree.low[c] for c in tree.children[n]) == len(inside)
    search = cover_tree.DualSearch(points[:40], np.arange(40), points, np.arange(4000), 5)
    read = []
    plain = search._score
    search._score = lambda a, b, r: (read.append((b - a) * len(r)), plain(a, b, r))
    search.run()
    assert sum(read) < 0.5 * 40 * 4000


def test_small_queries_and_large_data(spark, monkeypatch):
    rng = np.random.default_rng(11)
    sizes = [2.0**10, 2.0**18, 2.0**14, 1.0]
    data = [(i, (rng.normal(size=4) * sizes[i % 4]).tolist()) for i in range(1, 400)]
    # scores that differ in the last place of large numbers
    base = [2.0**18, 1.0, -(2.0**18), 3.0]
    data += [(1000 + i, [base[0], base[1], base[2], base[3] + i / 1024]) for i in range(1, 40)]
    data += [(i * 5000, (rng.normal(size=4) * s).tolist()) for i, s in ((1, 1.0), (2, 2.0**10), (3, 2.0**-8), (4, 2.0**17))]
    data += [(25_000, [1.0, 1.0, 1.0, 1.0])]
    vectors = frame(spark, data)
    for block in (10_000, 90):
        monkeypatch.setattr(cover_tree, "DATA_BLOCK", block)
        monkeypatch.setattr(cover_tree, "QUERY_BLOCK", max(1, block // 45))
        got = sorted(map(tuple, cover_tree.top_k(vectors, vectors.where("vec_id % 5000 = 0"), k=10).collect()))
        want = by_hand(data, {5000, 10_000, 15_000, 20_000, 25_000}, 10)
        assert got == want


def test_exactness_is_decided_per_pair_of_blocks():
    small, large = [[3.0, 1.0]], [[2.0**40, 5.0]]
    assert cover_tree._matrices(small, small)[0].dtype == float and cover_tree._matrices(small, large)[0].dtype == float
    q, d = cover_tree._matrices([[2.0**20, 1.0]], large)
    assert q.dtype == d.dtype == object and (q @ d.T)[0, 0] == 2**60 + 5
