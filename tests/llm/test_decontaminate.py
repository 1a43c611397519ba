import hashlib
import random
import re

from stepweave.llm import decontaminate

WORD = re.compile(decontaminate.WORD)


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items):
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            v = words(t)
            for s in range(max(1, len(v) - 12) if v else 0):
                win = v[s : s + 13]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add("" if item is None else str(item))
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), ids, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, win string, at string").repartition(2)


def test_equals_brute_force(spark, docs_of):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "straße", "the"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([13, 14, 30, 12, 5, 2, 1, 60])]
    items += [(10, items[0][1]), (2, items[2][1]), (11, ""), (12, None), (None, text(20)), (100, text(15)), (20, text(13))]
    docs = [(i, text(rng.choice([1, 10, 60, 300]))) for i in range(25)]
    for k in range(12):
        planted = words(items[k % 8][1])
        cut = rng.randrange(0, 3)
        docs.append((30 + k, text(40) + " " + " ".join(planted[cut:]).upper() + ", " + text(30)))
    docs += [(50, None), (51, ""), (52, items[3][1]), (52, items[3][1]), (None, items[7][1] + " " + text(3000)), (53, "...")]
    docs.append((54, items[0][1] + " " + items[0][1]))
    rows = [(i, t, "x", "y") for i, t in items]
    found = decontaminate.digest(decontaminate.decontaminate(docs_of(docs), table(spark, rows)))
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == by_hand(docs, items)
    assert sum(r[5] for r in got) > 10


def test_empty_tables(spark, docs_of):
    none = table(spark, [])
    assert [tuple(r)[:4] for r in decontaminate.digest(decontaminate.decontaminate(docs_of([(1, "a b")]), none)).collect()] == [(1, 2, 0, 0)]
    some = table(spark, [(1, "a b c", "x", "y")])
    assert decontaminate.digest(decontaminate.decontaminate(docs_of([]), some)).count() == 0
