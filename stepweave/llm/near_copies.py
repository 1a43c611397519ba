"""Near copies by HyperMinHash.

A document's set are its distinct shingles of five words. Documents are linked
where the sets' Jaccard similarity is at least 0.75, and linked documents form
groups.

1. Each document gets the hash of its set and its registers: one per bucket of
   the hash range, holding the leading zeros of the bucket's least hash and the
   mantissa bits behind them. Empty buckets borrow from others in a fixed random
   order, so small sets keep the collision probability of their similarity.
2. Documents with equal sets become one class.
3. Bands of registers bring classes together. Inside a band's bucket each class
   is paired with the bucket's first class, not with all others.
4. Pairs are weighed by the share of equal registers, corrected for chance
   collisions, and then confirmed on the full sets.
5. Where a bucket still holds classes of different groups, the pairs across
   groups are weighed as well, in blocks of bounded size; classes with a pair
   that may be similar enough get their full sets, and the block confirms such
   pairs until they add nothing to the groups. So a link is not lost because
   both ends differ from the first class, and no more links leave a block than
   it has classes. A pair is weighed in the first band its ends share.

A link is missed if no band agrees, at a similarity of 0.75 with a probability
of 3e-6, or if its estimate is five standard deviations too low.

Cases: a document without words (or null) has an empty set and is linked with
nothing. Fewer than five words are one shingle. Repeated rows and equal texts
are in one group. A row with a null id is grouped like others; a group whose ids
are all null has a null group id. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import ship
from stepweave.llm.components import components
from stepweave.llm.pieces import text_groups
from stepweave.session import cut_lineage

SHINGLE = 5
BANDS = 48
ROWS = 5
BUCKETS = BANDS * ROWS
MANTISSA = 10
PER_CENT = 75
# Chance that registers of unrelated sets of equal size agree.
COLLISION = 0.17 / (1 << MANTISSA)
# Five standard deviations of the estimate below the threshold.
LEAST_ESTIMATE = PER_CENT / 100 - 5 * (PER_CENT / 100 * (1 - PER_CENT / 100) / BUCKETS) ** 0.5
BLOCK = 2_000

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
VALUE_BITS = 52


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased, cut at ASCII white space."""
    return text.encode("utf-8", "replace").translate(LOWER).split()


def shingle_hashes(words: list[bytes], length: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    digest = xxhash.xxh3_64_intdigest
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < length:
        return np.array([digest(b" ".join(words))], np.uint64)
    of_words = np.fromiter(map(digest, words), np.uint64, len(words))
    n = len(words) - length + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(length):
        mixed = (mixed ^ of_words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def shingle_set(words: list[bytes], length: int = SHINGLE) -> set[bytes]:
    if len(words) < length:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(length)))))


def similar(a: set, b: set) -> bool:
    common = len(a & b)
    return common > 0 and 100 * common >= PER_CENT * (len(a) + len(b) - common)


_BORROW = np.array([np.random.default_rng(j).permutation(BUCKETS) for j in range(BUCKETS)])


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the least value of each bucket, as 16-bit numbers."""
    bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    value = (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - VALUE_BITS)
    order = np.lexsort((value, bucket))
    bucket, value = bucket[order], value[order]
    first = np.r_[True, bucket[1:] != bucket[:-1]]
    held = np.zeros(BUCKETS, bool)
    held[bucket[first]] = True
    mantissa, exponent = np.frexp(np.maximum(value[first], np.uint64(1)).astype(np.float64))
    out = np.zeros(BUCKETS, np.uint16)
    bits = ((mantissa * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    out[bucket[first]] = ((VALUE_BITS - exponent.astype(np.int64)) << MANTISSA) | bits
    empty = np.flatnonzero(~held)
    if len(empty):
        order = _BORROW[empty]
        out[empty] = out[order[np.arange(len(empty)), held[order].argmax(1)]]
    return out


def estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal registers, corrected for chance collisions."""
    return (equal / BUCKETS - COLLISION) / (1 - COLLISION)


def _signatures(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """``id, row, n_shingles, set, registers`` per document; set and registers null without words."""
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("whole")
    ).withColumn("row", F.xxhash64("id", "whole"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_groups(batches, "whole"):
            counts, sets, regs = [], [], []
            for x in texts:
                hashes = shingle_hashes(words_of(x))
                counts.append(len(hashes))
                sets.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                regs.append(registers(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("id"),
                    rows.column("row"),
                    pa.array(counts, pa.int64()),
                    pa.array(sets, pa.binary()),
                    pa.array(regs, pa.binary()),
                ],
                ["id", "row", "n_shingles", "set", "registers"],
            )

    schema = T.StructType(
        [
            T.StructField("id", narrow.schema["id"].dataType),
            T.StructField("row", T.LongType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("set", T.BinaryType()),
            T.StructField("registers", T.BinaryType()),
        ]
    )
    return narrow.mapInArrow(sign, schema)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A hash of each band of registers, different for each place: one row per class, one column per band."""
    parts = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    place = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
    key = np.broadcast_to(place, parts.shape[:2]).copy()
    for r in range(ROWS):
        key = (key ^ parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _bands(classes: DataFrame) -> DataFrame:
    """``set, band`` for each band of each class."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                keys = band_keys(_stacked(part.column("registers")))
                sets = part.column("set").take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))
                yield pa.RecordBatch.from_arrays([sets, pa.array(keys.ravel())], ["set", "band"])

    return classes.select("set", "registers").mapInArrow(cut, "set binary, band long")


def _stacked(registers) -> np.ndarray:
    return np.frombuffer(b"".join(registers.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _with_registers(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    a = classes.select(F.col("set").alias("a"), F.col("registers").alias("ra"))
    b = classes.select(F.col("set").alias("b"), F.col("registers").alias("rb"))
    return pairs.join(a, "a").join(b, "b")


def _weigh(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose estimated similarity may reach the threshold."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            equal = (_stacked(batch.column("ra")) == _stacked(batch.column("rb"))).sum(1)
            good = pa.array(estimate(equal) >= LEAST_ESTIMATE)
            yield batch.select(["a", "b"]).filter(good)

    return _with_registers(pairs, classes).select("a", "b", "ra", "rb").mapInArrow(weigh, "a binary, b binary")


def _texts(sets: DataFrame, classes: DataFrame, docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """``set, whole``: the text of one document of each class asked for."""
    asked = sets.distinct().join(classes.select("set", "row"), "set")
    whole = F.col(f"`{text}`").cast("string")
    return (
        docs.select(F.xxhash64(F.col(f"`{id_col}`"), whole).alias("row"), whole.alias("whole"))
        .join(asked, "row")
        .select("set", "whole")
    )


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """The pairs whose full shingle sets are similar enough, from the texts of one document of each class."""
    asked = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set")))
    texts = cut_lineage(_texts(asked, classes, docs, text, id_col))
    a = texts.select(F.col("set").alias("a"), F.col("whole").alias("ta"))
    b = texts.select(F.col("set").alias("b"), F.col("whole").alias("tb"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, set()
        for batch in batches:
            good = []
            for ta, tb in zip(batch.column("ta"), batch.column("tb")):
                ta = ta.as_py()
                if ta != last:
                    last, of_last = ta, shingle_set(words_of(ta))
                good.append(similar(of_last, shingle_set(words_of(tb.as_py()))))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb")
    return joined.mapInArrow(confirm, "a binary, b binary").distinct()


class _Block:
    """Classes of one bucket, or of two of its blocks, and the pairs across groups worth a look."""

    def __init__(self, key: tuple, table: pa.Table):
        self.sets = table.column("set").to_pylist()
        self.regs = _stacked(table.column("registers"))
        names = {r: n for n, r in enumerate(dict.fromkeys(table.column("root").to_pylist()))}
        self.group = np.array([names[r] for r in table.column("root").to_pylist()])
        self.block = table.column("block").to_numpy()
        band, low, high = (k.as_py() for k in key)
        self.within = low == high
        self.place = int(np.flatnonzero(band_keys(self.regs[:1])[0] == band)[0]) if self.sets else 0

    def near(self, x: int) -> np.ndarray:
        """Partners of ``x`` behind it, of another group, most similar first."""
        same = self.regs == self.regs[x]
        found = estimate(same.sum(1))
        fine = (found >= LEAST_ESTIMATE) & (self.group != self.group[x])
        if self.within:
            fine[: x + 1] = False
        else:
            fine &= self.block > self.block[x]
        at = np.flatnonzero(fine)
        first = same[at].reshape(-1, BANDS, ROWS).all(2).argmax(1) == self.place
        at = at[first]
        return at[np.argsort(-found[at], kind="stable")]


def _suspects(key: tuple, table: pa.Table) -> pa.Table:
    """The classes of a block that have such a pair."""
    block = _Block(key, table)
    held = np.zeros(len(block.sets), bool)
    for x in range(len(block.sets)):
        near = block.near(x)
        if len(near):
            held[x] = True
            held[near] = True
    return table.filter(pa.array(held))


def _links(key: tuple, table: pa.Table) -> pa.Table:
    """Confirmed pairs of a block, as many as it takes to join the groups they join."""
    block = _Block(key, table)
    hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    parent = list(range(int(block.group.max()) + 1)) if block.sets else []

    def find(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    a, b = [], []
    for x in range(len(block.sets)):
        for y in block.near(x).tolist():
            mine, theirs = find(int(block.group[x])), find(int(block.group[y]))
            if mine == theirs:
                continue
            common = len(np.intersect1d(hashes[x], hashes[y], assume_unique=True))
            if 100 * common >= PER_CENT * (len(hashes[x]) + len(hashes[y]) - common):
                parent[mine] = theirs
                a.append(block.sets[x])
                b.append(block.sets[y])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _across(
    shared: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, text: str, id_col: str
) -> DataFrame:
    """Links between classes in one bucket that are in different groups so far.

    A bucket of many classes is cut into blocks; each pair of blocks is weighed
    on its own.
    """
    grouped = shared.join(roots, shared["set"] == roots["node"], "left").select(
        "set", "band", F.coalesce("root", "set").alias("root")
    )
    mixed = (
        grouped.groupBy("band")
        .agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low <> high")
        .select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    mine = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")),
    )
    dealt = (
        grouped.join(mixed, "band")
        .withColumn("block", mine)
        .select("set", "band", "root", "block", F.inline(others))
        .join(classes.select("set", "registers"), "set")
        .select("band", "i", "j", "block", "set", "root", "registers")
    )
    suspects = cut_lineage(dealt.groupBy("band", "i", "j").applyInArrow(_suspects, dealt.schema))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_groups(batches, "whole"):
            found = [shingle_hashes(words_of(x)).tobytes() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("set"), pa.array(found, pa.binary())], ["set", "hashes"])

    texts = _texts(suspects.select("set"), classes, docs, text, id_col)
    full = cut_lineage(texts.mapInArrow(hashed, "set binary, hashes binary").dropDuplicates(["set"]))
    return suspects.join(full, "set").groupBy("band", "i", "j").applyInArrow(_links, "a binary, b binary").distinct()


def near_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id, row, n_shingles, root, component_id, kept`` per document.

    ``row`` is a hash of id and text, ``root`` names the group and is null
    without words; ``component_id`` is the least id of the group, ``kept`` marks the rows that
    carry it.
    """
    ship(docs.sparkSession)
    signed = cut_lineage(_signatures(docs, text, id_col))
    classes = cut_lineage(
        signed.where("n_shingles > 0")
        .groupBy("set")
        .agg(F.min("row").alias("row"), F.first("registers").alias("registers"))
    )
    bands = _bands(classes)
    firsts = bands.groupBy("band").agg(F.min("set").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut_lineage(bands.join(firsts.select("band", "first"), "band"))
    pairs = shared.where("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b")).distinct()
    links = cut_lineage(_confirm(cut_lineage(_weigh(pairs, classes)), classes, docs, text, id_col))
    roots = components(links, "a", "b")
    more = cut_lineage(_across(shared.select("set", "band"), roots, classes, docs, text, id_col))
    if not more.isEmpty():
        roots = components(links.unionByName(more), "a", "b")
    rooted = (
        signed.select("id", "row", "n_shingles", "set")
        .join(roots.select(F.col("node").alias("set"), "root"), "set", "left")
        .select("id", "row", "n_shingles", F.coalesce("root", "set").alias("root"))
    )
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"))
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least"))
    return rooted.join(least, "root", "left").select(
        "id",
        "row",
        "n_shingles",
        "root",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.col("id").isNull() & component.isNull()).alias("kept"),
    )


def one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group, of the least id; rows without words all stay."""
    grouped = cut_lineage(near_copies(docs, text, id_col))
    chosen = grouped.where("kept AND root IS NOT NULL").groupBy("root").agg(F.min("row").alias("row"))
    wordless = grouped.where("root IS NULL").select("row", F.lit(False).alias("once")).distinct()
    stays = chosen.select("row", F.lit(True).alias("once")).unionByName(wordless)
    keyed = docs.select(F.struct("*").alias("doc")).withColumn(
        "row", F.xxhash64(F.col("doc")[id_col], F.col("doc")[text].cast("string"))
    )
    place = F.row_number().over(Window.partitionBy("row").orderBy("row"))
    placed = keyed.join(stays, "row").withColumn("place", place)
    return placed.where(~F.col("once") | (F.col("place") == 1)).select("doc.*")


def digest(grouped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return grouped.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")
