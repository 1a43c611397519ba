import itertools
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm import filter_audit as fa
from stepweave.llm import queries

LABEL = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType()),
     T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n", T.StringType())]
)


def failures(rows):
    out = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        out.append((i, part or "", {f for f in failed if failed[f]}))
    return out


def by_hand(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    failed, out = failures(rows), {}
    for part in {p for _, p, _ in failed}:
        mine = [(i, f) for i, p, f in failed if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in f for _, f in mine) - len(gone), sum(f == {name} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), name,
                ]
        for key in out:
            if key[0] == part:
                out[key][-1] = shapley[out[key][-1]]
    return out


def documents(docs_of, rows):
    langs = docs_of([(i, t) for i, t, _ in rows], 1).drop("lang")
    # lang by place: rows repeat, so ids do not identify them
    return langs.sparkSession.createDataFrame(
        [(*r, p) for r, (_, _, p) in zip(langs.collect(), rows)], langs.schema.add("lang", "string")
    ).repartition(3)


long = " ".join(f"w{i}" for i in range(200))
ROWS = [
    (1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long.upper(), "en"), (4, "a b c", "en"), (5, "a b c", "de"),
    (6, "a a a a", "de"), (7, None, "de"), (8, "", None), (9, " \n\t", ""), (None, "a b c", "en"), (None, None, None),
    (10, long + " 50%", "en"), (11, long + " A" * 400, "en"), (12, " ".join(["x y"] * 300), "de"), (13, long.replace("w1", "É1"), "de"),
    (-4, "a b c", "fr"), (14, long[:-5], "fr"), (15, "a|b", "fr"), (16, " one word", "fr"), (17, long.replace(" ", "\x0b"), "fr"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, 1, None), (5, None, 1), (None, 1, 1), (99, 1, 1), (11, 1, 1), (7, 0, 0)]


def test_audit_equals_running_every_order(spark, docs_of):
    labels = spark.createDataFrame([(*x, "t", "l", "n") for x in LABELS], LABEL)
    found = fa.digest(fa.audit(fa.document_counts(documents(docs_of, ROWS), labels)))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in found.collect()}
    assert got == by_hand(ROWS, LABELS)
    assert {r[0] for r in got} == {"en", "de", "fr", ""}


def test_empty_tables(spark, docs_of):
    no_labels = spark.createDataFrame([], LABEL)
    assert fa.audit(fa.document_counts(docs_of([]), no_labels)).count() == 0
    rows = fa.digest(fa.audit(fa.document_counts(docs_of([(1, "a b")]), no_labels))).collect()
    assert len(rows) == 600 and all(r["good_lost"] == r["toxic_lost"] == 0 for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_lattice_counts_every_order(n):
    edges = fa.lattice(n)
    assert len(edges) == n * 2 ** (n - 1)
    through = dict.fromkeys(((s, f) for s, f, _, _ in edges), 0)
    for order in itertools.permutations(range(n)):
        state = 0
        for f in order:
            through[state, f] += 1
            state |= 1 << f
    assert through == {(s, f): orders for s, f, _, orders in edges}
    assert sum(orders for s, _, _, orders in edges if s == 0) == math.factorial(n)


def test_other_filters_and_flags(spark):
    counts = spark.createDataFrame([("p", 0, 5, 1), ("p", 1, 3, 2), ("p", 3, 4, 0)], "part string, mask int, n long, rare long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["lost_rare"], r["shapley"])
           for r in fa.audit(counts, "XY", ["rare"]).collect()}
    assert got == {("XY", 1): (5, 7, 0, 2, 10), ("XY", 2): (5, 0, 4, 0, 4), ("YX", 1): (8, 4, 0, 0, 4), ("YX", 2): (5, 3, 4, 2, 10)}


def test_query_equals_its_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.op12_filter_audit(spark, sf_dir)
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({fa.ORACLE})").fetchall())
    assert df.where(F.col("shapley") > 0).count() > 0
