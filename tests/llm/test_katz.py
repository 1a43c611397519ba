import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepweave.llm import katz


def rows():
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    out = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    out += [(200, None), (201, ""), (202, " \n"), (203, "w1 " * 20_000), (None, "w1 W2\tw3"), (204, "É é unseen"), (205, "w1"), (205, "w1")]
    return out


def learns(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 1


def level(data, classes):
    """The model by plain counting: probability of a token after a token."""
    texts = [katz.tokens_of(t or "") for i, t in data if learns(i)]
    count = Counter(w for t in texts for w in t)
    total = sum(count.values())
    n = Counter(count.values())

    def ratio(table, r):
        excess = 6 * table[6] / table[1]
        found = ((r + 1) * table[r + 1] / table[r] / r - excess) / (1 - excess) if excess < 1 and table[r] else 0
        taken = table[1] / (table[1] + 2 * table[2]) if table[2] else 0.5
        return found if 0 < found < 1 else (r - taken) / r

    d = {r: ratio(n, r) for r in range(1, 6)}
    word = lambda w: d.get(count[w], 1) * count[w] / total if count[w] else unseen
    unseen = 1 - sum(d.get(c, 1) * c for c in count.values()) / total
    top = sorted((w for w in count if w), key=lambda w: (-count[w], w))[: classes - 2]
    own = {b"", *top}
    of = lambda w: w if w in own else None
    share = {w: word(w) for w in own}
    share[None] = 1 - sum(share.values())
    pair = Counter((a, b) for t in texts for a, b in zip(["<", *map(of, t)], map(of, t)))
    after = Counter()
    for (a, _), c in pair.items():
        after[a] += c
    m = Counter(pair.values())
    e = {r: ratio(m, r) for r in range(1, 6)}

    def of_class(a, b):
        if not after[a]:
            return share[b]
        explicit = {y: e.get(c, 1) * c / after[a] for (x, y), c in pair.items() if x == a}
        if len(explicit) == len(share):  # nothing to back off to
            return explicit[b] / sum(explicit.values())
        if sum(explicit.values()) > 1 - 1e-12:  # nothing was taken off
            return (1 - 1e-6) * explicit.get(b, 0) + 1e-6 * share[b]
        if b in explicit:
            return explicit[b]
        return (1 - sum(explicit.values())) / sum(s for y, s in share.items() if y not in explicit) * share[b]

    def p(a, w):
        b = of(w)
        return of_class(a, b) * (1 if b is not None else word(w) / share[None])

    return count, total, own, of, p


def test_scores_equal_plain_recursion(docs_of):
    data = rows()
    count, total, _, of, p = level(data, 12)
    got = katz.score(docs_of(data), ~katz.held_out("doc_id"), classes=12).collect()
    assert len(got) == len(data)
    by = {}
    for r in got:
        by.setdefault((r["id"], r["n_tokens"]), r)
    for i, t in data:
        words = katz.tokens_of(t or "")
        r = by[i, len(words)]
        assert r["learns"] == learns(i) and r["train_tokens"] == total
        assert r["n_known"] == sum(count[w] > 0 for w in words)
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in words)
        assert r["base_score"] == pytest.approx(base)
        want = sum(math.log10(p(a, w)) for a, w in zip(["<", *map(of, words)], words))
        assert r["score"] == pytest.approx(want, rel=1e-9)


def test_pairs_of_all_words_count(docs_of, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_BYTES", 20_000)  # several blocks and pair partitions
    rng = random.Random(6)
    data = [(i, " ".join(f"r{rng.randrange(3_000)} s{rng.randrange(3)} the" for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    data += rows()[120:]
    count, total, _, _, p = level(data, 10**9)  # every training word is a symbol
    assert len(count) > 2_048
    scores = {}
    for r in katz.score(docs_of(data), ~katz.held_out("doc_id")).collect():
        scores.setdefault((r["id"], r["n_tokens"]), r["score"])
    assert len(scores) == len({(i, len(katz.tokens_of(t or ""))) for i, t in data})
    for i, t in data:
        words = katz.tokens_of(t or "")
        want = sum(math.log10(p(a, w)) for a, w in zip(["<", *(w if count[w] else None for w in words)], words))
        assert scores[i, len(words)] == pytest.approx(want, rel=1e-9)


def test_every_context_sums_to_one():
    rng = np.random.default_rng(0)
    share = rng.dirichlet(np.ones(30))
    ratios = katz.discounts({1: 40, 2: 20, 3: 9, 4: 5, 5: 3, 6: 2})
    for counts in (*rng.poisson(0.3, (30, 30)), np.zeros(30), np.full(30, 9), np.eye(30)[3] * 9, np.eye(30)[4]):
        assert np.allclose((10 ** katz.context_logs(counts.astype(float), ratios, share)).sum(), 1)


def test_word_level_sums_to_one():
    for counts in ([1, 1, 1, 2, 2, 3, 9], [5, 5], [1], []):
        n = Counter(counts)
        words = katz.Words.fit(sum(counts), len(counts), n)
        assert words.probability(np.array(counts, float)).sum() + words.unseen == pytest.approx(1)


def test_no_training_rows_and_no_rows(docs_of):
    got = katz.score(docs_of([(1, "a b"), (2, None)]), F.lit(False)).orderBy("id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(r["score"] == pytest.approx(0, abs=1e-6) for r in got)
    assert katz.digest(katz.score(docs_of([]), F.lit(True))).count() == 0


@pytest.mark.parametrize("bits", [20, 62])
def test_distinct_codes(bits):
    codes = np.random.default_rng(1).integers(0, 1 << 10, 600_000) << (bits - 10)
    found, places = np.unique(codes, return_inverse=True)
    got = katz.distinct(codes.copy(), bits)
    assert (got[0] == found).all() and (got[1] == places).all()


def test_memory_of_a_block():
    rng = np.random.default_rng(2)
    drawn = rng.zipf(1.3, 1_000_000) % 100_000
    texts = [" ".join(map(str, x)) for x in np.split(drawn, 1_000)]
    count = Counter(w for t in texts for w in katz.tokens_of(t))
    block = pa.table({"whole": texts})
    columns = {"word": pa.array(list(count), pa.binary()), "c": list(count.values()), "number": range(2, len(count) + 2)}
    answers = pa.table(columns)
    symbols = katz.Symbols.fit(katz.Words.fit(sum(count.values()), len(count), Counter(count.values())), None)
    del texts, count
    tracemalloc.start()
    try:
        tokens = katz.Tokens.of(block, answers, symbols)
        for _ in tokens.parts(70, tokens.numbers[:9]):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 * len(tokens.place)
