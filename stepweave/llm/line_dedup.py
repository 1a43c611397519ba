"""Removal of passages that repeat, by content-defined chunks of lines.

A text's lines are cut into chunks where a rolling hash over the hashes of
neighbouring lines has the value 0, so the cuts inside a passage are the same
wherever it stands. A line of ``LONG`` words or more is a passage by itself and
always a chunk of its own. Chunks of several lines, and long lines, that occur
more than once in the whole table are removed but for their first occurrence (by
id, then by place). Single short lines stay.

Chunks are first counted by a hash, over narrow rows. The texts of those that
occur twice or more are then compared byte by byte.

Cases: a null or empty text stays as it is. A text all of whose chunks are
removed becomes empty. A null id comes before all others. Repeated rows (same id
and text) are treated alike: either all keep a chunk or none. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import bind
from stepweave.session import cut_lineage

LONG = 40
MODULUS = 4
FACTOR = 31
HEX = "0123456789abcdef"


def _line_hash(line: Column) -> Column:
    """0 to 255, from the first two hexadecimal digits of the MD5."""
    digest = F.md5(line)
    return F.instr(F.lit(HEX), F.substring(digest, 1, 1)) * 16 + F.instr(F.lit(HEX), F.substring(digest, 2, 1)) - 17


def _is_long(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1 >= LONG


def chunks_of(text: Column) -> Column:
    """Array of ``(pos, text, passage)``; ``passage`` marks chunks that may be removed."""

    def cut(lines: Column, marks: Column) -> Column:
        n = F.size(lines)

        def starts_here(i: Column) -> Column:
            here, prior = F.get(marks, i), F.get(marks, i - 1)
            rolled = (prior["hash"] * FACTOR + here["hash"]) % MODULUS
            return (i == 0) | here["long"] | prior["long"] | (rolled == 0)

        starts = F.filter(F.sequence(F.lit(0), n - 1), starts_here)

        def chunk(all_starts: Column) -> Column:
            def one(start: Column, k: Column) -> Column:
                size = F.coalesce(F.get(all_starts, k + 1), n) - start
                return F.struct(
                    start.alias("pos"),
                    F.array_join(F.slice(lines, start + 1, size), "\n").alias("text"),
                    ((size > 1) | F.get(marks, start)["long"]).alias("passage"),
                )

            return F.transform(all_starts, one)

        return bind(starts, chunk)

    def mark(lines: Column) -> Column:
        marks = F.transform(lines, lambda x: F.struct(_line_hash(x).alias("hash"), _is_long(x).alias("long")))
        return F.struct(lines.alias("lines"), marks.alias("marks"))

    return bind(bind(F.split(text, "\n", -1), mark), lambda m: cut(m["lines"], m["marks"]))


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc, text, n_chunks, n_removed``: all columns of a row as a struct, and its text without repeats."""
    keyed = (
        docs.select(F.struct("*").alias("doc"))
        .withColumn("id", F.col("doc")[id_col])
        .withColumn("whole", F.col("doc")[text].cast("string"))
        .withColumn("key", F.xxhash64("id", "whole"))
    )
    passages = F.filter(chunks_of(F.col("whole")), lambda c: c["passage"])
    hashed = F.transform(passages, lambda c: F.struct(c["pos"].alias("pos"), F.xxhash64(c["text"]).alias("hash")))
    places = cut_lineage(keyed.select("key", F.inline(hashed)))
    repeated = places.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    asked = places.join(repeated, "hash", "left_semi").groupBy("key").agg(F.collect_set("pos").alias("asked"))

    mine = F.filter(chunks_of(F.col("whole")), lambda c: F.array_contains("asked", c["pos"]))
    seen = cut_lineage(
        keyed.select("key", "id", "whole").join(asked, "key").select("key", "id", F.explode(mine).alias("c")).select(
            "key", "id", "c.pos", "c.text"
        )
    )
    firsts = seen.groupBy("text").agg(F.min(F.struct("id", "key", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    removed = (
        seen.join(firsts.where("n > 1"), "text")
        .where((F.col("key") != F.col("first.key")) | (F.col("pos") != F.col("first.pos")))
        .groupBy("key")
        .agg(F.collect_set("pos").alias("removed"))
    )

    def clean(chunks: Column) -> Column:
        gone = F.coalesce("removed", F.array().cast("array<int>"))
        left = F.filter(chunks, lambda c: ~F.array_contains(gone, c["pos"]))
        return F.struct(
            F.array_join(F.transform(left, lambda c: c["text"]), "\n").alias("text"), F.size(chunks).alias("n_chunks")
        )

    n_chunks = F.coalesce(F.size(chunks_of(F.col("whole"))), F.lit(0))
    as_it_is = F.struct(F.col("whole").alias("text"), n_chunks.alias("n_chunks"))
    return (
        keyed.select("key", "doc", "whole")
        .join(removed, "key", "left")
        .select(
            "doc",
            F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
            F.when(F.col("removed").isNull(), as_it_is)
            .otherwise(bind(chunks_of(F.col("whole")), clean))
            .alias("cleaned"),
        )
        .select("doc", "cleaned.text", F.col("cleaned.n_chunks").cast("long").alias("n_chunks"), "n_removed")
    )


def digest(cleaned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return cleaned.select(F.col("doc")[id_col].alias(id_col), "n_chunks", "n_removed", "text")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT r, doc_id, i, l[i + 1] AS line FROM (SELECT r, doc_id, l, unnest(range(0, len(l))) AS i FROM d)),
h AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 >= {LONG} AS long,
    instr('{HEX}', substr(md5(line), 1, 1)) * 16 + instr('{HEX}', substr(md5(line), 2, 1)) - 17 AS hash FROM e),
b AS (SELECT *, i = 0 OR long OR lag(long) OVER w OR (lag(hash) OVER w * {FACTOR} + hash) % {MODULUS} = 0 AS starts
    FROM h WINDOW w AS (PARTITION BY r ORDER BY i)),
c AS (SELECT *, sum(starts::INT) OVER (PARTITION BY r ORDER BY i) AS chunk FROM b),
k AS (SELECT r, doc_id, chunk, min(i) AS pos, string_agg(line, chr(10) ORDER BY i) AS t,
    count(*) > 1 OR bool_or(long) AS passage FROM c GROUP BY ALL),
o AS (SELECT *, passage AND row_number() OVER (PARTITION BY t, passage ORDER BY doc_id NULLS FIRST, pos) > 1 AS gone FROM k),
f AS (SELECT r, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS left_text FROM o GROUP BY r)
SELECT doc_id, coalesce(n_chunks, 0)::BIGINT AS n_chunks, coalesce(n_removed, 0)::BIGINT AS n_removed,
    CASE WHEN text IS NULL THEN NULL ELSE left_text END AS text FROM d LEFT JOIN f USING (r)"""
