import random

import duckdb

from stepweave.llm import line_dedup


def long_line(seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(1000)}" for _ in range(55))


def corpus():
    rng = random.Random(4)
    line = lambda: f"line {rng.randrange(10**6)} of some words"
    block = [line() for _ in range(30)]
    rows = [(i, "\n".join([line() for _ in range(i % 5)] + block[i % 3 :] + [line() for _ in range(3)])) for i in range(12)]
    rows += [(20 + i, f"{line()}\n{long_line(1)}\n{line()}") for i in range(4)]
    rows += [(30, long_line(2)), (31, long_line(2)), (32, long_line(2) + "\n" + long_line(2))]
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, "short"), (44, "short"), (45, long_line(3) + "\n")]
    rows += [(None, long_line(1)), (46, "é" * 90_000 + "\n" + long_line(1))]
    return rows


def by_sql(rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.sql(line_dedup.ORACLE).fetchall(), key=str)


def test_equals_sql(docs_of):
    rows = corpus()
    got = sorted((tuple(r) for r in line_dedup.digest(line_dedup.dedup_lines(docs_of(rows))).collect()), key=str)
    assert got == by_sql(rows)
    text = {r[0]: r[3] for r in got}
    removed = {r[0]: r[2] for r in got}
    assert text[None] == long_line(1) and all(long_line(1) not in text[20 + i] for i in range(4))
    assert text[30] == long_line(2) and text[31] == "" and text[32] == ""
    assert (text[40], text[41], text[43], text[44]) == (None, "", "short", "short")
    # the shared block is found at whatever offset it stands
    assert all(removed[i] >= 2 for i in range(3, 12))


def test_repeated_rows_are_treated_alike(docs_of):
    twice = [(1, long_line(9)), (1, long_line(9)), (2, long_line(9))]
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs_of(twice)).select("doc.doc_id", "text").collect())
    assert got == [(1, long_line(9)), (1, long_line(9)), (2, "")]


def test_empty_table(docs_of):
    assert line_dedup.dedup_lines(docs_of([])).count() == 0
