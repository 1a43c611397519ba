"""Secret scans through a trigram inverted index.

Each rule's pattern gives a Boolean trigram query: literal strings that every
match must contain, combined by AND, each a choice by OR. The index maps
trigrams to texts (by hash). Intersecting the postings of a query leaves the
candidate texts of its rule; the pattern then verifies them. A rule without
mandatory trigrams is verified on every text.

Only trigrams that some query asks for are posted: a new rule set needs a new
pass over the texts, which verification makes anyway.

Cases: a null text counts as an empty one and has no spans. Every input row
gives one output row, repeated rows and rows with a null id included. Whole
texts are scanned. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import bind

_parse = re._parser  # the standard library's own pattern parser
MOST_STRINGS = 64
MOST_CLASS = 8


@dataclass(frozen=True)
class Rule:
    """``pattern`` must read alike in Java, Python and RE2.

    Matches are leftmost and do not overlap. A match counts if its group
    ``group`` has at least ``least`` characters.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base rules.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)

# Further formats of published tokens.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + MORE_RULES

# AND of clauses; a clause is an OR of alternatives; an alternative is an AND of trigrams.
Query = tuple[tuple[frozenset[str], ...], ...]


def _strings(op, value) -> set[str] | None:
    """All texts one parsed item can match, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value)}
    if name == "IN":
        out: set[str] = set()
        for kind, what in value:
            if str(kind) == "LITERAL":
                out.add(chr(what))
            elif str(kind) == "RANGE" and what[1] - what[0] < MOST_CLASS:
                out.update(map(chr, range(what[0], what[1] + 1)))
            else:
                return None
        return out if len(out) <= MOST_CLASS else None
    if name == "SUBPATTERN":
        return _sequence_strings(value[-1])
    if name == "BRANCH":
        parts = [_sequence_strings(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if name == "MAX_REPEAT":
        low, high, inner = value
        one = _sequence_strings(inner)
        if one is None or high > 2:
            return None
        return {"".join(x) for n in range(low, high + 1) for x in itertools.product(one, repeat=n)}
    return None


def _sequence_strings(items) -> set[str] | None:
    out = {""}
    for op, value in items:
        one = _strings(op, value)
        if one is None or len(out) * len(one) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def _grams(text: str) -> frozenset[str]:
    text = text.lower()
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a pattern, over lower-case text; empty if nothing is mandatory."""
    clauses: list[tuple[frozenset[str], ...]] = []
    run = {""}

    def close() -> None:
        nonlocal run
        if all(len(x) >= 3 for x in run):
            asked = {_grams(x) for x in run}
            clauses.append(tuple(sorted((a for a in asked if not any(b < a for b in asked)), key=sorted)))
        run = {""}

    def walk(items) -> None:
        nonlocal run
        for op, value in items:
            one = _strings(op, value)
            if one is not None and len(run) * len(one) <= MOST_STRINGS:
                run = {a + b for a in run for b in one}
                continue
            close()
            if str(op) == "SUBPATTERN":
                walk(value[-1])
                close()
            elif one is not None:
                run = one

    walk(_parse.parse(pattern))
    close()
    return tuple(clauses)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Array of ``(start, rank, end)`` of one rule, from the pieces between its matches."""
    pattern = F.lit(rule.pattern)

    def positions(pieces: Column, found: Column, judged: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(pieces, i))
            end = start + F.length(F.get(found, i))
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
            holds = F.length(F.get(judged, i)) >= rule.least
            return F.struct(
                end.alias("at"), F.when(holds, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans")
            )

        none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
        walked = F.aggregate(
            F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).alias("at"), none.alias("spans")), step
        )
        return F.when(F.size(found) > 0, walked["spans"]).otherwise(none)

    return bind(
        F.struct(
            F.split(text, rule.pattern, -1).alias("pieces"),
            F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"),
            F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("judged"),
        ),
        lambda m: positions(m["pieces"], m["found"], m["judged"]),
    )


def build_postings(docs: DataFrame, text: str, rules: Sequence[Rule]) -> DataFrame:
    """The index: ``(gram, key)``, one row for each asked trigram and text hash."""
    asked = sorted({g for r in rules for clause in trigram_query(r.pattern) for alt in clause for g in alt})
    if not asked:
        return docs.sparkSession.createDataFrame([], "gram string, key long")
    grams = F.array(*[F.lit(g) for g in asked])
    held = bind(F.lower(text), lambda low: F.filter(grams, lambda g: F.contains(low, g)))
    return docs.select(F.xxhash64(text).alias("key"), F.explode(held).alias("gram")).distinct().select("gram", "key")


def candidates(postings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(key, rules)``: the rules whose query a text's postings meet.

    An alternative holds where the intersection of its posting lists does: the
    text occurs in as many of them as it names. The table of queries is fixed by
    the rule set.
    """
    asked = [
        (gram, rule.kind, c, a, len(alternative))
        for rule in rules
        for c, clause in enumerate(trigram_query(rule.pattern))
        for a, alternative in enumerate(clause)
        for gram in alternative
    ]
    sizes = [(rule.kind, len(trigram_query(rule.pattern))) for rule in rules]
    spark = postings.sparkSession
    wanted = spark.createDataFrame(asked, "gram string, rule string, clause int, alternative int, grams int")
    needs = spark.createDataFrame(sizes, "rule string, clauses int")
    return (
        postings.join(F.broadcast(wanted), "gram")
        .groupBy("key", "rule", "clause", "alternative", "grams")
        .agg(F.count(F.lit(1)).alias("met"))
        .where("met = grams")
        .groupBy("key", "rule")
        .agg(F.countDistinct("clause").alias("met"))
        .join(F.broadcast(needs), "rule")
        .where("met = clauses")
        .groupBy("key")
        .agg(F.collect_set("rule").alias("rules"))
    )


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``id_col`` and ``spans``, an array of ``(start, rank, end, kind)`` in order of start and rule.

    Positions are code points, ends exclusive.
    """
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("whole")
    )
    found = candidates(build_postings(narrow, "whole", rules), rules)
    keyed = narrow.withColumn("key", F.xxhash64("whole")).join(found, "key", "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    parts = []
    for rank, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            worth = F.array_contains("rules", rule.kind)
        else:
            worth = F.col("whole").rlike(rule.pattern)
        parts.append(F.when(worth, _spans(F.col("whole"), rule, rank)).otherwise(none))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    named = F.transform(
        F.array_sort(F.flatten(F.array(*parts))),
        lambda s: F.struct(s["start"], s["rank"], s["end"], F.get(kinds, s["rank"]).alias("kind")),
    )
    return keyed.select(F.col("id").alias(id_col), named.alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame, id_col: str = "doc_id", base: Sequence[Rule] = BASE_RULES) -> DataFrame:
    """Counts and hashes of the base spans, and all spans as text."""
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in base]
    of_base = F.filter(spans, lambda s: s["rank"] < len(base))
    return scanned.select(
        id_col, *counts, F.sha2(_joined(of_base), 256).alias("base_sha256"), _joined(spans).alias("spans")
    )


def oracle(rules: Sequence[Rule] = RULES, base: int = len(BASE_RULES)) -> str:
    """The digest as DuckDB SQL: every rule over every text, without an index."""
    parts = []
    for rank, rule in enumerate(rules):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"""SELECT r, {rank} AS rank, '{rule.kind}' AS kind, s AS start, s + len(m) AS stop FROM (
  SELECT r, unnest(found) AS m, unnest(judged) AS j, unnest(list_transform(range(1, len(found) + 1), lambda i:
    list_sum(list_transform(pieces[1:i], lambda p: len(p))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda p: len(p))), 0)
  )) AS s FROM (
    SELECT r, regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '{pattern}', {rule.group}) AS judged,
      string_split_regex(t, '{pattern}') AS pieces FROM d)) WHERE len(j) >= {rule.least}"""
        )
    counts = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in rules[:base])
    sums = ", ".join(f"count(*) FILTER (rank = {i}) AS n_{r.kind}" for i, r in enumerate(rules[:base]))
    text = "concat_ws(':', kind, start::BIGINT, stop::BIGINT)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT r, {sums}, string_agg({text}, ',' ORDER BY start, rank) FILTER (rank < {base}) AS b,
  string_agg({text}, ',' ORDER BY start, rank) AS a FROM s GROUP BY r)
SELECT doc_id, {counts}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN g USING (r)"""
