"""Benchmark decontamination by a prefix-filtered join.

An item's windows are runs of ``window`` consecutive words; an item with fewer
words is one window. A document word inside any occurrence of a window is hit.

Containing a window exactly means containing all of its shingles, so a prefix
of one shingle is enough: each window is looked up by its rarest shingle in the
corpus. The shingle's place in window and document fixes where the window would
start (positional bound) and where it would end (length bound); what is left is
compared word by word.

Documents are read twice, once for their shingles and once to verify. Only
shingles that also occur in the benchmark leave the first scan. The benchmark's
shingle table is joined without a hint: Spark broadcasts it while it is under
the broadcast threshold and shuffles beyond.

Cases: a null or empty text has no words and no hits. Items without words have
no windows. An item with a null id counts as one with an empty id. Items with
the same id count as one. Repeated documents give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import ascii_lower, bind
from stepweave.session import cut_lineage

# Fixed value: a word is a run of 0-9, a-z and characters beyond ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 3


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _shingles(words: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` words, in order."""
    starts = F.sequence(F.lit(0), F.size(words) - length)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(length)]))
    return F.when(F.size(words) >= length, hashed).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, text: str, id_col: str, window: int) -> DataFrame:
    """``(item, win, words)``: every distinct window of every item; ``win`` is a hash of its words."""
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - (window - 1)))
    return (
        items.select(
            F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"),
            words_of(F.col(f"`{text}`")).alias("words"),
        )
        .where(n > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i, window))).alias("words"))
        .distinct()
        .select("item", F.xxhash64("words").alias("win"), "words")
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    item_text: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """``doc, n_words, hits, items``: all columns of a row as a struct, and what was found in it.

    ``hits`` are the positions of hit words, ``items`` the sorted ids of the
    items with an occurring window.
    """
    windows = cut_lineage(item_windows(benchmark, item_text, item_col, window))
    wanted = windows.select("win", "words").distinct()
    length = F.least(F.size("words"), F.lit(shingle))
    lengths = sorted(r[0] for r in wanted.select(length.alias("n")).distinct().collect())  # at most `shingle`

    whole_text = F.col("doc")[text].cast("string")
    keyed = docs.select(F.struct("*").alias("doc")).select(
        "doc", F.xxhash64(F.col("doc")[id_col], whole_text).alias("key")
    )
    parts = [
        wanted.where(length == n).select("win", F.lit(n).alias("len"), F.posexplode(_shingles(F.col("words"), n)))
        for n in lengths
    ]
    if not parts:
        none = F.array()
        return keyed.select(
            "doc",
            F.size(words_of(whole_text)).alias("n_words"),
            none.cast("array<int>").alias("hits"),
            none.cast("array<string>").alias("items"),
        )
    in_windows = parts[0]
    for part in parts[1:]:
        in_windows = in_windows.unionByName(part)
    in_windows = cut_lineage(
        in_windows.select("win", "len", F.col("pos").alias("at"), F.xxhash64("len", "col").alias("shingle"))
    )

    asked = cut_lineage(in_windows.select("shingle").distinct())

    def placed(words: Column, n: int) -> Column:
        return F.transform(
            _shingles(words, n), lambda h, i: F.struct(i.alias("pos"), F.xxhash64(F.lit(n), h).alias("shingle"))
        )

    whole = bind(
        words_of(whole_text),
        lambda w: F.struct(F.size(w).alias("n_words"), F.concat(*[placed(w, n) for n in lengths]).alias("shingles")),
    )
    met = cut_lineage(
        keyed.select("key", whole.alias("doc"))
        .select("key", "doc.n_words", F.inline("doc.shingles"))
        .join(asked, "shingle", "left_semi")
    )

    counts = met.groupBy("shingle").agg(F.count(F.lit(1)).alias("seen"))
    prefix = (
        in_windows.join(counts, "shingle")
        .groupBy("win")
        .agg(
            F.min(F.struct("seen", "at", "shingle")).alias("rarest"),
            F.countDistinct("at").alias("met"),
        )
        .join(wanted, "win")
        # a shingle that no document holds rules its window out
        .where(F.col("met") == F.size("words") - F.least(F.size("words"), F.lit(shingle)) + 1)
        .select("win", "rarest.at", "rarest.shingle", "words")
    )
    start = F.col("pos") - F.col("at")
    candidates = (
        met.join(prefix, "shingle")
        .where((start >= 0) & (start + F.size("words") <= F.col("n_words")))
        .select("key", start.alias("start"), "win", "words")
        .distinct()
        .groupBy("key")
        .agg(F.collect_list(F.struct("start", "win", "words")).alias("candidates"))
    )

    def verified(words: Column) -> Column:
        same = F.filter(
            F.coalesce(F.col("candidates"), F.array().cast("array<struct<start:int,win:bigint,words:array<string>>>")),
            lambda c: F.slice(words, c["start"] + 1, F.size(c["words"])) == c["words"],
        )
        found = F.transform(
            same, lambda c: F.struct(c["start"].alias("start"), c["win"].alias("win"), F.size(c["words"]).alias("len"))
        )
        return F.struct(F.size(words).alias("n_words"), found.alias("found"))

    checked = keyed.join(candidates, "key", "left").select(
        "key", "doc", bind(words_of(whole_text), verified).alias("v")
    )
    spans = F.transform(F.col("v.found"), lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1))
    checked = cut_lineage(
        checked.select(
            "key",
            "doc",
            "v.n_words",
            F.array_distinct(F.flatten(spans)).alias("hits"),
            F.array_distinct(F.col("v.found.win")).alias("wins"),
        )
    )
    items = (
        checked.where(F.size("wins") > 0)
        .select("key", F.explode("wins").alias("win"))
        .distinct()
        .join(windows.select("item", "win"), "win")
        .groupBy("key")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return checked.join(items, "key", "left").select(
        "doc", "n_words", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n_hit = F.size("hits").cast("long")
    return found.select(
        F.col("doc")[id_col].alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def contaminated() -> Column:
    """At least one hit, and hits make up a twentieth of the words."""
    n_hit = F.size("hits").cast("long")
    return (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, w[s:s + 12] AS words FROM (
    SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(words) AS n FROM win),
placed AS (SELECT r, n, s, w[s:s + n - 1] AS words FROM (
    SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT r, n, s, item FROM placed JOIN win USING (words)),
per AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN per USING (r) LEFT JOIN its USING (r)"""
