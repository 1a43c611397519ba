"""Minimax contiguous partition of atomic groups of equal texts into shards.

Groups of equal texts are ordered by a hash of the text. The smallest shard
capacity for which a greedy pass over the ordered group sizes needs at most
``shards`` shards is found by binary search, and the order is cut there.

The group sizes never reach the driver as a whole. They are summed over at most
``CELLS`` ranges of the order; the driver knows between which capacities the
answer lies and which ranges may hold a cut for them, and only those are split
further, until no cut can fall inside a range. Each round is one aggregation
over a narrow table, and there are at most 64 / 7 rounds or so.

Cases: a null text counts as an empty one (size 1, CRC 0). An empty table gives
no rows. Repeated rows are rows of their own, in the shard of their text. A
null id is kept. Fewer groups than shards leave shards empty.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.session import cut_lineage

CELLS = 1 << 16
SLOT_CELLS = 4096


@dataclass
class Cell:
    """A range of the order: all hashes that start with ``prefix`` (``bits`` long)."""

    prefix: int
    bits: int
    size: int
    single: bool

    @property
    def first(self) -> int:
        return self.prefix << (64 - self.bits)


def _greedy_ends(sums: list[int], cells: list[Cell], capacity: int, shards: int, divisible: bool) -> list[int]:
    """Where each shard ends, in size units from the start, filled one after the other."""
    ends, at = [], 0
    for _ in range(shards):
        target = at + capacity
        i = bisect_right(sums, target) - 1
        at = sums[i]
        if divisible and i < len(cells) and not cells[i].single:
            at = target
        at = max(at, ends[-1] if ends else 0)
        ends.append(min(at, sums[-1]))
    return ends


def _least_capacity(sums: list[int], cells: list[Cell], shards: int, divisible: bool) -> int:
    low, high = -(-sums[-1] // shards), sums[-1]
    while low < high:
        middle = (low + high) // 2
        if _greedy_ends(sums, cells, middle, shards, divisible)[-1] == sums[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def _sums(cells: list[Cell]) -> list[int]:
    out = [0]
    for cell in cells:
        out.append(out[-1] + cell.size)
    return out


def _cell_sizes(sized: DataFrame, bits: int) -> list[Cell]:
    rows = (
        sized.groupBy(F.shiftright("h", 64 - bits).alias("prefix") if bits < 64 else F.col("h").alias("prefix"))
        .agg(F.sum("size").alias("size"), (F.min("h") == F.max("h")).alias("single"))
        .collect()
    )
    return [Cell(r["prefix"], bits, r["size"], r["single"]) for r in rows]


def minimax_cuts(sized: DataFrame, shards: int, cells: int = CELLS) -> tuple[list[int], int]:
    """First hash of each shard but the first, and the shard capacity, from rows ``(h, size)``."""
    if shards == 1:
        return [], 0
    bits = cells.bit_length() - 1
    found = sorted(_cell_sizes(sized, bits), key=lambda c: c.first)
    if not found:
        return [], 0
    while True:
        sums = _sums(found)
        low = _least_capacity(sums, found, shards, divisible=True)
        high = _least_capacity(sums, found, shards, divisible=False)
        split = set()
        starts = _greedy_ends(sums, found, low, shards, divisible=False)
        stops = _greedy_ends(sums, found, high, shards, divisible=True)
        for start, stop in zip(starts, stops):
            first, last = bisect_right(sums, start) - 1, bisect_right(sums, stop) - 1
            split.update(i for i in range(first, min(last, len(found) - 1) + 1) if not found[i].single)
        if not split:
            break
        step = max(1, (cells // len(split)).bit_length() - 1)
        finer = []
        for width in sorted({found[i].bits for i in split}):
            mine = [found[i].prefix for i in split if found[i].bits == width]
            inside = sized.where(F.shiftright("h", 64 - width).isin(mine))
            finer += _cell_sizes(inside, min(64, width + step))
        found = sorted([c for i, c in enumerate(found) if i not in split] + finer, key=lambda c: c.first)
    ends = _greedy_ends(sums, found, high, shards, divisible=False)
    cuts = [found[bisect_right(sums, end) - 1].first for end in ends[:-1] if end < sums[-1]]
    return cuts, high


def _shard_of(h: Column, cuts: list[int]) -> Column:
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (h >= F.lit(cut)).cast("int")
    return shard


def shard_documents(
    docs: DataFrame, shards: int = 16, text: str = "text", id_col: str = "doc_id", cells: int = CELLS
) -> DataFrame:
    """``id_col, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    Slots count rows from 0 inside a shard. They come from fixed slices of a
    shard, dealt by a hash of id and text: slice totals give each slice its
    offset, so no task orders a whole shard or a whole group of copies.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    sized = cut_lineage(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            (F.octet_length(whole) + F.lit(1)).cast("long").alias("size"),
            F.crc32(whole).alias("crc"),
            F.xxhash64(whole).alias("h"),
        )
    )
    cuts, _ = minimax_cuts(sized, shards, cells)
    dealt = sized.select(
        "*",
        _shard_of(F.col("h"), cuts).alias("shard"),
        F.pmod(F.xxhash64("id", "h"), F.lit(SLOT_CELLS)).alias("slice"),
    )
    totals = dealt.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("slice")) - F.col("rows")
    offsets = totals.select("shard", "slice", before.alias("before"))  # shards * SLOT_CELLS rows at most
    place = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("id", "h", "size"))
    return (
        dealt.withColumn("place", place)
        .join(F.broadcast(offsets), ["shard", "slice"])
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("before") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
