"""Near copies by SimHash fingerprints and BK-trees.

A fingerprint has a bit set where more than half of the text's shingle hashes
(XXH64, seed 42, of four words, repeats included) have it set. Documents are
linked where fingerprints differ in at most ``RADIUS`` bits.

1. Distinct fingerprints are dealt to shards. Of ``BLOCKS`` runs of bits, two
   fingerprints within the radius share ``BLOCKS - RADIUS`` at least, so every
   choice of that many runs names a set of shards, and linked fingerprints meet
   in one of them with certainty.
2. A shard is a BK-tree: children are keyed by their distance to the node, and a
   search follows only the edges whose key is within the radius of the query's
   distance. A shard of more than ``SHARD`` fingerprints is cut into several
   trees of bounded size; each goes to every other part of its shard, a pair of
   parts a group of its own.
3. A group emits as many links as it takes to join what it joins, less than it
   has fingerprints. Components of the links carry the least id.

Fingerprints of very large tables want more runs: one more run makes shards
hundreds of times smaller and rows a few times more.

Cases: a text of fewer than four words is one shingle; a null text, or one
without words, has the fingerprint 0, which is linked like any other. Repeated
rows and equal texts share a fingerprint. A null id is in its component but
never names it; a component whose ids are all null has a null id. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import join_spread, ship
from stepweave.llm.components import components
from stepweave.llm.near_copies import words_of
from stepweave.llm.pieces import text_groups
from stepweave.session import cut_lineage

SHINGLE = 4
SEED = 42
BITS = 64
RADIUS = 4
BLOCKS = 6
SHARD = 8_192
LEAF = 16
HASHES_AT_ONCE = 65_536


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of every shingle, in order, with repeats."""
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) < SHINGLE:
        return np.array([digest(line, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - SHINGLE].tolist()
    cut = zip(starts, ends[SHINGLE - 1 :].tolist())
    return np.fromiter((digest(line[a:b], SEED) for a, b in cut), np.uint64, len(starts))


def fingerprint(words: list[bytes]) -> int:
    hashes = shingle_hashes(words)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """``id, print`` per row, the fingerprint as a signed 64-bit number."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("whole"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_groups(batches, "whole"):
            prints = np.array([fingerprint(words_of(x)) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(prints)], ["id", "print"])

    schema = T.StructType([T.StructField("id", narrow.schema["id"].dataType), T.StructField("print", T.LongType())])
    return narrow.mapInArrow(sign, schema)


class BKTree:
    """A BK-tree over distinct fingerprints; subtrees of up to ``leaf`` of them are kept as lists."""

    def __init__(self, prints: np.ndarray, members: np.ndarray, leaf: int = LEAF):
        self.prints, self.leaf = prints, leaf
        self.root = self._build(members)

    def _build(self, members: np.ndarray) -> tuple:
        """``(members,)`` of a leaf, or ``(node, distances, children)``."""
        if len(members) <= self.leaf:
            return (members,)
        node, rest = members[0], members[1:]
        away = np.bitwise_count(self.prints[rest] ^ self.prints[node])
        order = np.argsort(away, kind="stable")
        keys, starts = np.unique(away[order], return_index=True)
        return node, keys.astype(int), [self._build(x) for x in np.split(rest[order], starts[1:])]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For members of the tree, the queries within ``radius``. Queries go down together."""
        todo = [(self.root, queries)]
        while todo:
            node, asked = todo.pop()
            if len(node) == 1:
                away = np.bitwise_count(self.prints[node[0]][:, None] ^ self.prints[asked])
                near = away <= radius
                for i in np.flatnonzero(near.any(1)):
                    yield int(node[0][i]), asked[near[i]]
                continue
            away = np.bitwise_count(self.prints[asked] ^ self.prints[node[0]]).astype(int)
            near = asked[away <= radius]
            if len(near):
                yield int(node[0]), near
            for key, child in zip(node[1].tolist(), node[2]):
                goes = asked[np.abs(away - key) <= radius]
                if len(goes):
                    todo.append((child, goes))


def joins(prints: np.ndarray, parts: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what lies within ``radius``: inside one part, or between the first part and the other."""
    first = np.flatnonzero(parts == parts.min())
    others = np.flatnonzero(parts != parts.min())
    group = np.arange(len(prints))
    links = []
    for member, near in BKTree(prints, first).search(others if len(others) else first, radius):
        while True:
            apart = near[group[near] != group[member]]
            if not len(apart):
                break
            links.append((int(prints[member]), int(prints[apart[0]])))
            group[group == group[apart[0]]] = group[member]
    return links


KEY = ["runs", "bits", "i", "j"]


def _links_of_groups(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of consecutive rows of one key; a key may go on in the next batch."""

    def links(columns: dict[str, np.ndarray], low: int, high: int) -> list[tuple[int, int]]:
        return joins(columns["print"][low:high].view(np.uint64), columns["part"][low:high], radius)

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

    left: dict[str, np.ndarray] | None = None
    for batch in batches:
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if left is not None:
            columns = {c: np.r_[left[c], columns[c]] for c in columns}
        new = np.zeros(len(columns["print"]), bool)
        for c in KEY:
            new[1:] |= columns[c][1:] != columns[c][:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        found = []
        for low, high in zip(starts, starts[1:]):
            found += links(columns, low, high)
        left = {c: x[starts[-1] :] for c, x in columns.items()}
        yield batch_of(found)
    if left is not None:
        yield batch_of(links(left, 0, len(left["print"])))


def run_masks(blocks: int, radius: int) -> list[int]:
    """Signed 64-bit masks of every choice of ``blocks - radius`` runs of bits."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    runs = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    return [int(np.uint64(sum(c)).view(np.int64)) for c in combinations(runs, blocks - radius)]


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``print`` that join all those within the radius."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("more runs of bits than differing bits are needed")
    places = [
        F.struct(F.lit(i).alias("runs"), F.col("print").bitwiseAND(F.lit(mask)).alias("bits"))
        for i, mask in enumerate(run_masks(blocks, radius))
    ]
    keyed = prints.select("print", F.inline(F.array(*places)))
    sizes = (
        keyed.groupBy("runs", "bits")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("runs", "bits", F.ceil(F.col("n") / shard).cast("int").alias("parts"))
    )
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")),
    )
    dealt = (
        keyed.join(sizes, ["runs", "bits"])
        .withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
        .select("runs", "bits", "part", "print", F.inline(pairs))
    )
    grouped = dealt.repartition(*KEY).sortWithinPartitions(*KEY)
    return grouped.mapInArrow(lambda batches: _links_of_groups(batches, radius), "a long, b long")


def near_copies(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """``id, print, component_id`` per row: its fingerprint and the least id it reaches."""
    ship(docs.sparkSession)
    signed = cut_lineage(fingerprints(docs, text, id_col))
    least = cut_lineage(signed.groupBy("print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(least.select("print"), radius, blocks), "a", "b")
    linked = cut_lineage(
        least.join(roots.select(F.col("node").alias("print"), "root"), "print").select("print", "root", "least", "n")
    )
    groups = cut_lineage(
        linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    )
    named = join_spread(linked.select("print", "root", F.col("n").alias("rows")), groups, "root")
    alone = least.join(linked.select("print"), "print", "left_anti")
    of_print = cut_lineage(
        named.select("print", "component_id", F.col("rows").alias("n")).unionByName(
            alone.select("print", F.col("least").alias("component_id"), "n")
        )
    )
    return join_spread(signed, of_print, "print").select("id", "print", "component_id")


def digest(grouped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return grouped.select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )
