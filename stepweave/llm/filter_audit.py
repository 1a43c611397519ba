"""Audit of how filters overlap, over all orders in which they may run, by path counting in the subset lattice.

A state is the set of filters that have run, an edge adds one filter, and an
order is a path from the empty set to the full one. What an edge removes depends
on its state only, not on the order in which the state was reached. So rows are
counted once per state (those that fail none of its filters), an edge removes
the difference of its two ends, and

* the Shapley sum of a filter weighs each of its edges with the number of orders
  through it: those that reach its state (counted forward) times those that
  leave its other end (counted backward);
* a step of an order is read off the edge it takes.

Rows are reduced to counts per part and set of failed filters; the lattice of
``n`` filters has 2^n states whatever the table's size.

Cases: a null text is empty and has no words (it fails A). A null part and an
empty one are the same part. A null id has no smaller one and fails no repeat
filter, but its text counts for nobody else either. Repeated rows count once
each; rows of one id and text do not make each other repeats. Of several labels
of one id, one that says 1 is enough; null labels, and labels of null or unknown
documents, say nothing. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import bind
from stepweave.session import cut_lineage

FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PER_CENT = 50
CAPITALS_PER_CENT = 3
MARKS = "[#$%&*|]"


def text_failures(text: Column) -> list[Column]:
    """Conditions A to D on a text that is not null."""

    def count(words: Column) -> Column:
        return F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct"))

    words = bind(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), ""), count)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")

    return [
        words["n"] < LEAST_WORDS,
        100 * words["distinct"].cast("long") < DISTINCT_PER_CENT * words["n"].cast("long"),
        100 * capitals > CAPITALS_PER_CENT * F.length(text).cast("long"),
        text.rlike(MARKS),
    ]


def _mask(failures: Sequence[Column]) -> Column:
    """The failed filters as bits, the first filter's lowest."""
    out = F.lit(0)
    for i, failed in enumerate(failures):
        out = out + F.when(failed, 1 << i).otherwise(0)
    return out.cast("int")


def document_counts(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    part: str = "lang",
    flags: Sequence[str] = ("quality", "toxic"),
) -> DataFrame:
    """``part, mask, n`` and a count per flag (rows labelled 1): documents by part and failed filters A to E.

    Equal texts are found by their SHA-256. Rows meet the first of their text by
    id and digest together, and equal rows meet it once, so a large group of
    copies is no hot key.
    """
    read = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("whole"),
    )
    digest_of, mask_of = F.unhex(F.sha2("whole", 256)), _mask(text_failures(F.col("whole")))
    marked = cut_lineage(read.select("id", "part", digest_of.alias("digest"), mask_of.alias("mask")))
    firsts = marked.groupBy("digest").agg(F.min("id").alias("id")).where("id IS NOT NULL")
    repeated = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << len(FILTERS) - 1).otherwise(0)
    counted = cut_lineage(
        marked.groupBy("id", "digest", "part", "mask")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(firsts.withColumn("first", F.lit(True)), ["id", "digest"], "left")
        .withColumn("mask", F.col("mask") + repeated)
        .groupBy("id", "part", "mask")
        .agg(F.sum("n").alias("n"))
    )
    marks = [F.max(F.when(F.col(f"`{f}`") == 1, 1).otherwise(0)).cast("long").alias(f"flag_{f}") for f in flags]
    labelled = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(*marks)
    flagged = (
        counted.join(labelled, "id")
        .groupBy("part", "mask")
        .agg(*(F.sum(F.col("n") * F.col(f"flag_{f}")).alias(f) for f in flags))
    )
    totals = counted.groupBy("part", "mask").agg(F.sum("n").alias("n"))
    return totals.join(flagged, ["part", "mask"], "left").na.fill(0, list(flags))


def lattice(n: int) -> list[tuple[int, int, int, int]]:
    """``state, filter, state after, orders through`` of every edge.

    Orders are counted forward from the empty state and backward from the full
    one; an edge lies on the product of both.
    """
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    edges = [(s, f, s | 1 << f) for s in range(full + 1) for f in range(n) if not s >> f & 1]
    for before, _, after in edges:
        reach[after] += reach[before]
    for before, _, after in reversed(edges):
        leave[before] += leave[after]
    return [(before, f, after, reach[before] * leave[after]) for before, f, after in edges]


def audit(counts: DataFrame, filters: str = FILTERS, flags: Sequence[str] = ("quality", "toxic")) -> DataFrame:
    """One row per part, order and step: what the step keeps and removes, alone, in vain, and on average.

    ``counts`` holds ``part, mask, n`` and one count per flag; bit ``i`` of
    ``mask`` says that the rows fail the filter ``filters[i]``. Columns:
    ``part, filter_order, step, kept, removed, redundant, unique_fails,
    lost_<flag>..., shapley``, the last summed over all orders.
    """
    spark, n = counts.sparkSession, len(filters)
    sums = ["n", *flags]
    states = F.explode(F.array(*(F.lit(s) for s in range(1 << n)))).alias("state")
    clean = F.col("state").bitwiseAND(F.col("mask")) == 0
    nodes = cut_lineage(
        counts.select("*", states)
        .groupBy("part", "state")
        .agg(*(F.sum(F.when(clean, F.col(f"`{c}`")).otherwise(0)).alias(c) for c in sums))
    )
    edges = spark.createDataFrame(
        [(s, filters[f], after, orders) for s, f, after, orders in lattice(n)],
        "state int, filter string, after int, orders long",
    )
    ends = nodes.select("part", F.col("state").alias("after"), *(F.col(f"`{c}`").alias(f"left_{c}") for c in sums))
    # both fixed tables have as many rows as the filters have edges and orders
    taken = cut_lineage(
        nodes.join(F.broadcast(edges), "state")
        .join(ends, ["part", "after"])
        .select(
            "part", "state", "filter", "after", "orders", F.col("left_n").alias("kept"),
            *((F.col(f"`{c}`") - F.col(f"left_{c}")).alias(f"lost_{c}") for c in sums),
        )
    )
    by_filter = taken.groupBy("part", "filter").agg(
        F.sum(F.col("orders") * F.col("lost_n")).alias("shapley"),
        F.sum(F.when(F.col("state") == 0, F.col("lost_n"))).alias("fails"),
        F.sum(F.when(F.col("after") == (1 << n) - 1, F.col("lost_n"))).alias("unique_fails"),
    )
    walks = []
    for order in permutations(range(n)):
        state, name = 0, "".join(filters[f] for f in order)
        for step, f in enumerate(order, 1):
            walks.append((name, step, state, filters[f]))
            state |= 1 << f
    steps = spark.createDataFrame(walks, "filter_order string, step int, state int, filter string")
    return (
        taken.join(by_filter, ["part", "filter"])
        .join(F.broadcast(steps), ["state", "filter"])
        .select(
            "part", "filter_order", "step", "kept", F.col("lost_n").alias("removed"),
            (F.col("fails") - F.col("lost_n")).alias("redundant"), "unique_fails",
            *(F.col(f"lost_{f}") for f in flags), "shapley",
        )
    )


def digest(audited: DataFrame) -> DataFrame:
    return audited.withColumnsRenamed({"lost_quality": "good_lost", "lost_toxic": "toxic_lost"})


ORACLE = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, part, (len(words) < {LEAST_WORDS})::INT
    + 2 * (100 * len(list_distinct(words)) < {DISTINCT_PER_CENT} * len(words))::INT
    + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > {CAPITALS_PER_CENT} * length(x))::INT
    + 8 * regexp_matches(x, '{MARKS}')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic
    FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
k AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM k a, k b, k c, k d, k e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[:i - 1]), 0)::INT AS earlier
    FROM (SELECT *, unnest(range(1, 6)) AS i FROM o)),
r AS (SELECT part, filter_order, step, bit,
    sum(n) FILTER (mask & (earlier | bit) = 0) AS kept,
    sum(n) FILTER (mask & earlier = 0 AND mask & bit > 0) AS removed,
    sum(n) FILTER (mask & earlier > 0 AND mask & bit > 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & earlier = 0 AND mask & bit > 0) AS good_lost,
    sum(toxic) FILTER (mask & earlier = 0 AND mask & bit > 0) AS toxic_lost
    FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
    coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
    coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r"""
