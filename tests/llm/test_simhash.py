import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stepweave.llm import simhash as sh
from stepweave.llm.near_copies import words_of


def print_by_hand(text):
    words = words_of(text or "")
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints, ids, radius=4):
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for g, i in zip(group, ids):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [least.get(g) for g in group]


def corpus():
    rng = random.Random(3)
    rows = []
    for base in range(25):
        words = [f"v{rng.randrange(400)}" for _ in range(rng.choice([3, 4, 5, 40, 200, 700]))]
        for copy in range(8):
            edited = list(words)
            for _ in range(copy % 4):
                edited[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((100 * base + copy, " ".join(edited)))
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "One two"), (5004, "one TWO"), (5005, "a b a b a b a b")]
    rows += [(5006, rows[40][1]), (5006, rows[40][1]), (None, rows[40][1]), (None, "only null ids here to see"), (-1, "É é É é É é")]
    return rows


def test_equals_brute_force(docs_of):
    rows = corpus()
    got = sorted((tuple(r) for r in sh.digest(sh.near_copies(docs_of(rows))).collect()), key=str)
    prints = [print_by_hand(t) for _, t in rows]
    roots = components_by_hand(prints, [i for i, _ in rows])
    assert got == sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, roots)), key=str)
    assert len(set(roots)) < len(set(prints)) - 20


def test_shingle_hash_is_xxh64_of_the_same_bytes(spark):
    text = "Größe two three four"
    hashes = sh.shingle_hashes(text.encode().split())
    assert hashes.view(np.int64).tolist() == [spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]]


def test_long_texts_are_read_whole(monkeypatch):
    words = [f"w{i % 97}".encode() for i in range(3_000)]
    whole = sh.fingerprint(words)
    monkeypatch.setattr(sh, "HASHES_AT_ONCE", 100)
    assert sh.fingerprint(words) == whole == print_by_hand(" ".join(w.decode() for w in words))


def ball(rng, centre, n, bits):
    out = set()
    while len(out) < n:
        x = centre
        for b in rng.sample(range(64), rng.randrange(bits + 1)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("leaf", [1, 3, 16])
def test_tree_search_equals_scan(leaf):
    rng = random.Random(leaf)
    prints = np.array(sorted({rng.getrandbits(64) for _ in range(300)} | set(ball(rng, 77, 300, 6))), np.uint64)
    members, queries = np.arange(0, len(prints), 2), np.arange(1, len(prints), 2)
    tree = sh.BKTree(prints, members, leaf)
    for radius in (0, 4, 9):
        got = sorted((m, int(q)) for m, near in tree.search(queries, radius) for q in near)
        assert got == [(int(m), int(q)) for m in members for q in queries if int(prints[m] ^ prints[q]).bit_count() <= radius]


def test_search_leaves_out_subtrees():
    rng = random.Random(1)
    prints = np.array(sorted({rng.getrandbits(64) for _ in range(20_000)}), np.uint64)
    tree = sh.BKTree(prints, np.arange(10_000))
    read = 0
    for at in range(10_000, 10_050):
        todo = [(tree.root, True)]
        while todo:
            node, _ = todo.pop()
            if len(node) == 1:
                read += len(node[0])
                continue
            read += 1
            away = int(prints[at] ^ prints[node[0]]).bit_count()
            todo += [(c, True) for k, c in zip(node[1].tolist(), node[2]) if abs(k - away) <= 4]
    assert read < 0.5 * 50 * 10_000


def test_every_near_pair_shares_a_shard():
    rng = random.Random(2)
    for blocks, radius in ((6, 4), (5, 4), (8, 4), (3, 2)):
        masks = [m & (2**64 - 1) for m in sh.run_masks(blocks, radius)]
        for _ in range(500):
            flip = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(flip & m == 0 for m in masks)


def test_large_shards_are_cut_into_parts(spark):
    rng = random.Random(9)
    values = ball(rng, 2**63 + 12345, 400, 5) + ball(rng, 999, 100, 3)
    prints = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "print long").repartition(5)
    for shard in (20, 10_000):
        found = [(a % 2**64, b % 2**64) for a, b in sh.links(prints, shard=shard).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in found)
        group = {v: v for v in values}

        def root(v):
            while group[v] != v:
                v = group[v]
            return v

        for a, b in found:
            group[root(a)] = root(b)
        want = components_by_hand(values, list(range(len(values))))
        names = [root(v) for v in values]
        assert len(set(zip(names, want))) == len(set(names)) == len(set(want))


def test_groups_go_on_across_batches():
    rows = [(0, 5, 0, 0, 0, 1), (0, 5, 0, 0, 0, 3), (0, 5, 0, 0, 0, 7), (1, 5, 0, 0, 0, 1), (1, 5, 0, 0, 0, 2**40 - 1)]
    names = ["runs", "bits", "i", "j", "part", "print"]
    for size in (1, 2, 5):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + size])], names)
            for at in range(0, len(rows), size)
        ]
        found = [r for b in sh._links_of_groups(iter(batches), 4) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(map(sorted, found)) == [[1, 3], [1, 7]]


def test_empty_table(docs_of):
    assert sh.digest(sh.near_copies(docs_of([]))).count() == 0


def test_too_few_runs_fail(spark):
    with pytest.raises(ValueError, match="runs of bits"):
        sh.links(spark.createDataFrame([], "print long"), radius=4, blocks=4)
