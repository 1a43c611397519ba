"""The pipeline's stages on a small table against plain Python, and every query against its SQL."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from stepweave.llm import near_copies, queries
from tests.llm.test_decontaminate import by_hand as contaminated_by_hand
from tests.llm.test_line_dedup import by_sql, long_line

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(12)
    line = lambda: " ".join(f"v{rng.randrange(900)}" for _ in range(25))
    rows = [(i, "\n".join(line() for _ in range(4))) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace("v1", "w1", 1)) for i in range(5)]  # near copies, of lines that differ
    rows += [(200 + i, line() + "\n" + long_line(77) + "\n" + line()) for i in range(4)]
    rows += [(300 + i, line() + " ghastly vile " + line()) for i in range(20)]
    item = " ".join(f"v{rng.randrange(900)}" for _ in range(30))
    rows += [(400, line() + " " + item), (401, None), (402, ""), (403, long_line(77))]
    labels = [(i, 0, int(300 <= i < 400)) for i, _ in rows if i is not None]
    sf = tmp_path_factory.mktemp("sf")
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return str(sf), rows, [(7, item)]


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages(spark, corpus):
    sf, rows, items = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near copies", "decontamination", "sentence pieces"]

    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns
    assert texts(clean) == sorted(((i, t) for i, t in rows if not 300 <= i < 400), key=str)

    cut = stages["line dedup"](spark, clean, sf)
    assert cut.columns == docs.columns
    want = [(i, t) for i, _, n, t in by_sql(texts(clean)) if n == 0 or t]
    assert texts(cut) == sorted(want, key=str)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut.collect())

    once = stages["near copies"](spark, cut, sf)
    assert once.columns == docs.columns
    sets = {i: near_copies.shingle_set(near_copies.words_of(t or "")) for i, t in texts(cut)}
    kept = {i for i, _ in texts(once)}
    assert all(i in kept or any(j < i and near_copies.similar(sets[i], sets[j]) for j in sets) for i in sets)
    assert not any(near_copies.similar(sets[i], sets[j]) for i in kept for j in kept if i < j)

    pure = stages["decontamination"](spark, once, sf)
    assert pure.columns == docs.columns
    bad = {r[0] for r in contaminated_by_hand(texts(once), items) if r[5]}
    assert bad == {400} and texts(pure) == [x for x in texts(once) if x[0] not in bad]

    coded = stages["sentence pieces"](spark, pure, sf)
    assert sorted(((r["doc_id"], r["decoded"]) for r in coded.collect()), key=str) == sorted(((i, t or "") for i, t in texts(pure)), key=str)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, coded.collect()))


def test_exact_copies_of_short_lines_go_whole(spark, docs_of):
    rng = random.Random(5)
    line = lambda: " ".join(f"u{rng.randrange(900)}" for _ in range(6))
    bodies = ["\n".join(line() for _ in range(12)) for _ in range(15)]
    rows = [(100 * k + i, t) for k in range(3) for i, t in enumerate(bodies)]
    rows += [(None, bodies[3]), (900, "one line"), (901, "one line"), (902, None), (903, ""), (904, ""), (905, bodies[0] + "\nmore")]
    rows += [(7, bodies[7])]  # the same row twice
    got = corpus_pipeline.drop_repeated_passages(spark, docs_of(rows), "")
    left = texts(got)
    kept = [(None if i == 3 else i, t) for i, t in enumerate(bodies)] + [(7, bodies[7])]
    kept += [(900, "one line"), (902, None), (903, ""), (904, "")]
    assert [r for r in left if r[0] != 905] == sorted(kept, key=str)
    assert any(r[0] == 905 for r in left)  # holds a line of its own


def folder_of(spark, path, labels, items):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


ODD = [(1, None), (1, None), (2, ""), (3, " \n"), (None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (5, "x")]


@pytest.mark.parametrize("rows", [[], [(None, None)], ODD], ids=["no rows", "nulls", "odd"])
@pytest.mark.parametrize("others", ["none", "null"])
def test_stages_keep_columns_and_clean_rows_of_odd_tables(spark, docs_of, tmp_path, rows, others):
    """Without labels and items, or with null ones, nothing is toxic or contaminated; clashing columns stay."""
    empty = others == "none"
    labels = [] if empty else [(None, None, 1), (1, None, None), (99, 1, 1), (2, 0, 0)]
    sf = folder_of(spark, tmp_path, labels, [] if empty else [(None, None), (3, "")])
    docs = docs_of(rows)
    given = sorted(map(str, docs.collect()))
    stages = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "decontamination"):
        out = stages[name](spark, docs, sf)
        assert out.columns == docs.columns and sorted(map(str, out.collect())) == given
    # of equal texts the one of the least id stays, null first; texts without words all stay
    cut = stages["line dedup"](spark, docs, sf)
    assert cut.columns == docs.columns
    once = stages["near copies"](spark, docs, sf)
    assert once.columns == docs.columns
    if rows is ODD:
        wordless = [(1, None), (1, None), (2, ""), (3, " \n")]
        assert texts(cut) == sorted([*wordless, (None, "a b c d e f"), (None, "a b c d e f"), (5, "x")], key=str)
        assert texts(once) == sorted([*wordless, (4, "a b c d e f"), (5, "x")], key=str)
    coded = stages["sentence pieces"](spark, docs, sf)
    assert coded.columns == ["doc_id", "n_tokens", "ids", "decoded"] and coded.count() == len(rows)
    assert {r["n_tokens"] for r in coded.collect() if not (r["decoded"] or "").strip()} <= {0, 1, 2}


@pytest.mark.skipif(not os.path.isdir(SF), reason="bundled tables not present")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(columns).collect()))) == sorted(map(str, want))


def test_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert [n.split("_")[0] for n in queries.queries()] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
