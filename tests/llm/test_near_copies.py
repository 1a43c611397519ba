import random

import numpy as np

from stepweave.llm import near_copies as nc


def by_hand(rows):
    sets = [nc.shingle_set(nc.words_of(t or "")) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and nc.similar(sets[a], sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    least = {}
    for a, (i, _) in enumerate(rows):
        if sets[a] and i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    out = []
    for a, (i, _) in enumerate(rows):
        c = least.get(find(a)) if sets[a] else i
        out.append((i, len(sets[a]), c, i == c))
    return sorted(out, key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**9)}"
    return words


def corpus():
    rng = random.Random(5)
    fresh = lambda n: [f"v{rng.randrange(500)}" for _ in range(n)]
    rows = []
    for base in range(6):
        words = fresh([6, 12, 60, 150, 400, 900][base])
        for copy in range(12):
            # some copies are linked only through others
            rows.append((100 * base + copy, " ".join(edited(rng, words, copy % 4 * len(words) // 50))))
    passage = fresh(80)
    rows += [(1000 + i, " ".join(fresh(60) + passage + fresh(60))) for i in range(30)]
    chain = fresh(200)
    for i in range(8):
        rows.append((2000 + i, " ".join(chain)))
        chain = chain[6:] + fresh(6)
    rows += [(3000, None), (3001, ""), (3002, " \n\t"), (3003, "One two"), (3004, "one TWO"), (3005, "one two three")]
    rows += [(3006, rows[30][1]), (3006, rows[30][1]), (None, rows[30][1]), (None, "only null ids here"), (3007, "É é É é É é")]
    return rows


def test_groups_equal_brute_force(docs_of):
    rows = corpus()
    got = sorted((tuple(r) for r in nc.digest(nc.near_copies(docs_of(rows))).collect()), key=str)
    want = by_hand(rows)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == [r[3] for r in want]


def test_one_of_each(docs_of):
    rows = [(4, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (7, None), (7, None), (9, ""), (5, "x y")]
    docs = docs_of(rows)
    kept = nc.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"]) == [(2, "A b c d e f"), (5, "x y")]
    assert kept.where("doc_id IN (7, 9)").count() == 3


def test_empty_table(docs_of):
    assert nc.digest(nc.near_copies(docs_of([]))).count() == 0


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    for size in (5, 40, 3000):
        for share in (0.5, 0.75, 0.9):
            found = []
            for _ in range(30):
                common = rng.integers(0, 2**63, max(1, round(size * share)), dtype=np.uint64)
                rest = rng.integers(0, 2**63, 2 * (size - len(common)), dtype=np.uint64)
                half = len(rest) // 2
                a, b = np.unique(np.r_[common, rest[:half]]), np.unique(np.r_[common, rest[half:]])
                found.append(nc.estimate((nc.registers(a) == nc.registers(b)).sum()) - len(common) / (size + half))
            assert abs(np.mean(found)) < 0.05


def test_a_large_group_is_weighed_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(nc, "BLOCK", 5)
    rows = corpus()
    got = sorted((tuple(r)[:3] for r in nc.digest(nc.near_copies(docs_of(rows))).collect()), key=str)
    assert got == [r[:3] for r in by_hand(rows)]
