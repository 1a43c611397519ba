import random

import pytest

from stepweave.llm.components import components


def by_hand(links):
    group = {}

    def find(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        group[max(x, y)] = min(x, y)
    return {x: find(x) for pair in links for x in pair if pair[0] != pair[1]}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "ties"])
def test_every_node_gets_the_least_it_reaches(spark, kind):
    rng = random.Random(1)
    links = {
        "chain": [(i, i + 1) for i in rng.sample(range(300), 300) if i != 150],
        "star": [(7, i) for i in range(8, 400)] + [(3, 399)],
        "random": [(rng.randrange(500), rng.randrange(500)) for _ in range(260)],
        "ties": [(5, 5), (1, 2), (2, 1), (1, 2), (-9, 2)],
    }[kind]
    frame = spark.createDataFrame(links, "a long, b long").repartition(3)
    rows = components(frame, "a", "b").collect()
    got = {r["node"]: r["root"] for r in rows}
    assert len(rows) == len(got) and got == by_hand(links)


def test_text_nodes_and_no_links(spark):
    frame = spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "y")], "a string, b string")
    assert {tuple(r) for r in components(frame, "a", "b").collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert components(frame.where("false"), "a", "b").collect() == []
    assert components(spark.createDataFrame([(1, 1)], "a long, b long"), "a", "b").collect() == []
