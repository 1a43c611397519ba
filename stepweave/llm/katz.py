"""Katz back-off language model over words, with an open vocabulary.

A token is a word or the end of a text. The model has three levels, each
normalised exactly:

* words: Good-Turing discounted counts; what the discounts free is the
  probability of a word never seen in training, which counts as one symbol;
* symbols: each training word is one, all unseen words share one. With
  ``classes``, only that many of the most frequent tokens are symbols of their
  own, and all other words share one, inside which a word keeps its share;
* pairs of a context symbol and a symbol: Good-Turing discounted counts where
  the pair was seen, else the back-off weight of the context times the
  probability of the symbol. The weight is what the discounts freed in that
  context, over the probability of all symbols the context was not seen with.

A token's probability is found by that recursion: pair, or weight times symbol,
then the word within its symbol.

The word and pair tables grow with the corpus; they are stored in partitions and
never sent anywhere whole. Texts are dealt into blocks of bounded size. A block
asks for the counts of its own words, and for those of its own pairs and the sums
of their contexts; its texts meet the answers in one task. A pair's partition
follows from its context, for the most frequent contexts (sent to every task,
fewer than there are partitions) from both its words. Pairs are held under the
numbers of their two words in the word table.

Cases: a null or empty text is the end token alone. A null id counts as a
training row. Without training rows every word has the probability of an unseen
one, 1. Repeated rows are learned from, and scored, each.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.common import blocks_for, ship
from stepweave.llm.near_copies import LOWER
from stepweave.llm.pieces import text_groups
from stepweave.session import cut_lineage

LARGEST_DISCOUNTED = 5
BLOCK_BYTES = 24 << 20
END = b""  # no word is empty
SUMS = LARGEST_DISCOUNTED + 2  # of a context: tokens, pairs seen once to LARGEST_DISCOUNTED times, probability held
START, OTHER, FIRST = 0, 1, 2  # numbers: before a text, the class of all others, the first of a word


def tokens_of(text: str) -> list[bytes]:
    """Words cut at ASCII white space, A-Z lower-cased, then the end."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    words.append(END)
    return words


def discounts(counts_of_counts: dict[int, int], largest: int = LARGEST_DISCOUNTED) -> np.ndarray:
    """Good-Turing discount ratios for counts 1 to ``largest`` (index 0 is unused).

    Where a small or saturated table leaves a ratio outside (0, 1), the same
    share of a count is taken off instead: n1 / (n1 + 2 n2), or a half.
    """
    n = [counts_of_counts.get(r, 0) for r in range(largest + 2)]
    taken = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    out = np.ones(largest + 1)
    excess = (largest + 1) * n[largest + 1] / n[1] if n[1] else 1.0
    for r in range(1, largest + 1):
        ratio = ((r + 1) * n[r + 1] / n[r] / r - excess) / (1 - excess) if n[r] and excess < 1 else 0
        out[r] = ratio if 0 < ratio < 1 else (r - taken) / r
    return out


def discounted(counts: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    return counts * np.where(counts < len(ratios), ratios[np.minimum(counts, len(ratios) - 1).astype(int)], 1.0)


@dataclass
class Words:
    """The word level: what is needed to turn a count into a probability."""

    total: int
    types: int
    ratios: np.ndarray
    unseen: float
    scale: float

    @classmethod
    def fit(cls, total: int, types: int, counts_of_counts: dict[int, int]) -> Words:
        if not total:
            return cls(0, 0, np.ones(LARGEST_DISCOUNTED + 1), 1.0, 1.0)
        ratios = discounts(counts_of_counts)
        freed = sum((1 - ratios[r]) * r * counts_of_counts.get(r, 0) for r in range(1, len(ratios))) / total
        if freed > 0:
            return cls(total, types, ratios, freed, 1.0)
        # nothing was discounted: an unseen word gets half a count
        unseen = 0.5 / (total + 0.5)
        return cls(total, types, ratios, unseen, 1 - unseen)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        seen = self.scale * discounted(counts, self.ratios) / max(self.total, 1)
        return np.where(counts > 0, seen, self.unseen)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.types + 1)))


def pair_logs(
    counts: np.ndarray, totals: np.ndarray, left: np.ndarray, free: np.ndarray, ratios: np.ndarray, share: np.ndarray
) -> np.ndarray:
    """Log10 of the probability of symbols after their contexts.

    ``counts`` are those of the pairs, ``totals`` those of the contexts, ``left``
    is the share of a context that the discounts freed, ``free`` the probability
    of all symbols it was not seen with. The probabilities sum to 1: a context
    without pairs, or one that leaves nothing to back off to, falls back to
    symbols alone or is scaled to 1.
    """
    explicit = discounted(counts, ratios) / np.maximum(totals, 1)
    backs_off = (left > 1e-12) & (free > 1e-12)
    seen_or_less = np.where(counts > 0, explicit, left / np.maximum(free, 1e-12) * share)
    alone = explicit / np.maximum(1 - left, 1e-12)
    mixed = np.where(free > 1e-12, (1 - 1e-6) * alone + 1e-6 * share, alone)  # every symbol stays possible
    return _log(np.where(totals > 0, np.where(backs_off, seen_or_less, mixed), share))


def context_logs(counts: np.ndarray, ratios: np.ndarray, of_class: np.ndarray) -> np.ndarray:
    """``pair_logs`` of every symbol after one context, from the counts of what followed it."""
    total = counts.sum()
    left = 1 - discounted(counts, ratios).sum() / max(total, 1)
    free = of_class[counts == 0].sum()
    return pair_logs(counts, *(np.full(len(counts), x) for x in (total, left, free)), ratios, of_class)


def _log(p: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(p, 1e-300))


def _blocks(docs: DataFrame, text: str, id_col: str, learns: Column) -> tuple[DataFrame, int]:
    whole = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), whole.alias("whole"), learns.alias("learns"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("whole"), F.lit(0)) + 1)).first()[0] or 1
    n = blocks_for(size, BLOCK_BYTES)
    return rows.withColumn("block", F.pmod(F.xxhash64("id", "whole"), F.lit(n)).cast("int")), n


def _block_words(blocks: DataFrame) -> DataFrame:
    """``block, word, c``: every word of a block with its count in the block's training rows."""

    def count(table: pa.Table) -> pa.Table:
        learned, asked = Counter(), set()
        learns = iter(table.column("learns").to_pylist())
        # few texts at a time, as a block's texts take several times their bytes as Python's
        for _, texts in text_groups(iter(table.select(["whole"]).to_batches(max_chunksize=256)), "whole"):
            for x in texts:
                words = tokens_of(x)
                if next(learns):
                    learned.update(words)
                else:
                    asked.update(words)
        asked.difference_update(learned)
        words = [*learned, *asked]
        counts = [*learned.values(), *([0] * len(asked))]
        block = table.column("block")[0].as_py() if table.num_rows else 0
        return pa.table(
            [pa.array([block] * len(words), pa.int32()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())],
            names=["block", "word", "c"],
        )

    return blocks.groupBy("block").applyInArrow(count, "block int, word binary, c long")


@dataclass
class Symbols:
    """What turns words into symbols; ``own`` has the words that are one, or is None where all training words are."""

    level: Words
    own: frozenset[bytes] | None
    scale: float
    other: float

    @classmethod
    def fit(cls, level: Words, ranked: list[tuple[bytes, int]] | None) -> Symbols:
        if ranked is None:
            return cls(level, None, 1.0, level.unseen)
        kept = level.probability(np.array([c for _, c in ranked], float)).sum() if ranked else 0.0
        other = max(1 - kept, level.unseen)
        return cls(level, frozenset(w for w, _ in ranked), 1 / (kept + other), other / (kept + other))

    def share(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of symbols from their words' counts, which are 0 for the class of all others."""
        return np.where(counts > 0, self.level.probability(counts) * self.scale, self.other)


@dataclass
class Tokens:
    """The tokens of a block: each with its training count, and its place among the block's distinct pairs."""

    sizes: np.ndarray
    place: np.ndarray  # of each token among the block's distinct words
    counts: np.ndarray  # of the words
    apart: np.ndarray  # whether a word is a symbol of its own
    numbers: np.ndarray  # of the symbols, ascending
    known: np.ndarray  # of the symbols: the word's count, 0 for the class of all others
    contexts: np.ndarray  # of the distinct pairs, ascending, as places in numbers
    nexts: np.ndarray
    pair: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, answers: pa.Table, symbols: Symbols) -> Tokens:
        index: dict[bytes, int] = {w: i for i, w in enumerate(answers.column("word").to_pylist())}
        sizes, places = [], []
        # few texts at a time: a block's words and pairs take several times its bytes
        for _, texts in text_groups(iter(table.select(["whole"]).to_batches(max_chunksize=256)), "whole"):
            tokens = list(map(tokens_of, texts))
            sizes.extend(map(len, tokens))
            flat = list(chain.from_iterable(tokens))
            fresh = set(flat).difference(index)
            index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
            places.append(np.fromiter(map(index.__getitem__, flat), np.int32, len(flat)))
        del tokens, flat, fresh
        c = np.zeros(len(index), np.int64)
        c[: answers.num_rows] = answers.column("c").to_numpy()
        own = symbols.own
        apart = c > 0 if own is None else np.fromiter((w in own for w in index), bool, len(index))
        del index
        number = np.full(len(c), OTHER, np.int64)
        number[: answers.num_rows] = answers.column("number").to_numpy()
        place = np.concatenate(places)
        del places
        numbers, of = np.unique(np.append(np.where(apart, number, OTHER), START), return_inverse=True)
        known = np.zeros(len(numbers), np.int64)
        known[of[:-1]] = np.where(apart, c, 0)
        of, width = of.astype(np.int32), len(numbers).bit_length()
        code = np.empty(len(place), np.int64)
        code[1:] = of[place[:-1]]
        code[np.r_[0, np.cumsum(sizes)[:-1]]] = of[-1]
        code <<= width
        code |= of[place]
        codes, pair = distinct(code, 2 * width)
        del code
        contexts, nexts = (codes >> width).astype(np.int32), (codes & ((1 << width) - 1)).astype(np.int32)
        return cls(np.array(sizes), place, c, apart, numbers, known, contexts, nexts, pair)

    def parts(self, n: int, frequent: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The partitions of the pairs, each with the places of its pairs, ascending."""
        spread = np.isin(self.numbers, frequent)
        keys = self.numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = np.empty(len(self.contexts), np.min_scalar_type(n))
        for start in range(0, len(part), 1 << 18):  # so that what lies between stays small
            some = slice(start, start + (1 << 18))
            at = self.contexts[some]
            mixed = np.where(spread[at], keys[self.nexts[some]] >> np.uint64(1), np.uint64(0))
            part[some] = ((keys[at] ^ mixed) >> np.uint64(24)) % np.uint64(n)
        order = np.argsort(part, kind="stable").astype(np.int32)
        ends = np.cumsum(np.bincount(part, minlength=n))
        del part
        starts = np.r_[0, ends[:-1]]
        return ((i, order[starts[i] : ends[i]]) for i in np.flatnonzero(ends > starts).tolist())


def _pack(*arrays: np.ndarray) -> bytes:
    raw = pickle.dumps(arrays, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes | pa.Buffer) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True))


def distinct(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, ascending, and the place of each code among them; ``codes`` (below 2^bits) are overwritten.

    Where a code and its position fit one number, those are sorted in place,
    which takes less memory than ``np.unique``.
    """
    width = len(codes).bit_length()
    if bits + width > 63:
        found, places = np.unique(codes, return_inverse=True)
        return found, places.astype(np.int32)
    step = 1 << 18  # so that what lies between stays small
    codes <<= width
    for start in range(0, len(codes), step):
        codes[start : start + step] |= np.arange(start, min(start + step, len(codes)))
    codes.sort()
    places, found, n = np.empty(len(codes), np.int32), [], 0
    last = -1
    for start in range(0, len(codes), step):
        some = codes[start : start + step] >> width
        fresh = np.diff(some, prepend=last) > 0
        places[codes[start : start + step] & ((1 << width) - 1)] = n - 1 + np.cumsum(fresh)
        found.append(some[fresh])
        n, last = n + len(found[-1]), some[-1]
    return np.concatenate(found), places


def _sum_texts(values: np.ndarray, places: np.ndarray, sizes: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """Per text the sum of its tokens' values; a text has one token at least."""
    return np.add.reduceat(values[places], np.r_[0, np.cumsum(sizes)[:-1]], dtype=kind)


def _least(values: np.ndarray) -> np.ndarray:
    """As unsigned integers no wider than needed."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def tally(table: pa.Table, symbols: Symbols, frequent: np.ndarray) -> pa.Table:
    """One partition of the pair table: its counts as answers to each block, sums of frequent contexts, a histogram.

    Rows of block -1 hold sums of a frequent context, the row of block -2 how many pairs were seen 0, 1, ... times.
    """
    asked = [_unpack(x) for x in table.column("packed").to_pylist()]
    ends = np.cumsum([len(x[0]) for x in asked])[:-1]
    contexts, context = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
    words, first, word = np.unique(np.concatenate([x[2] for x in asked]), return_index=True, return_inverse=True)
    share = symbols.share(np.concatenate([x[3] for x in asked])[first])
    mine = np.split(context, ends)
    theirs = np.split(word, np.cumsum([len(x[2]) for x in asked])[:-1])
    width = len(words).bit_length()
    code = np.concatenate([np.repeat(m, x[1]) << width | t[x[4]] for m, t, x in zip(mine, theirs, asked)])
    codes, pair = distinct(code, width + len(contexts).bit_length())
    del code
    counts = np.bincount(pair, np.concatenate([x[5] for x in asked])).astype(np.int64)
    of, n = codes >> width, len(contexts)
    sums = np.zeros((n, SUMS))
    sums[:, 0] = np.bincount(of, counts, n)
    for r in range(1, LARGEST_DISCOUNTED + 1):
        sums[:, r] = np.bincount(of[counts == r], minlength=n)
    sums[:, -1] = np.bincount(of, np.where(counts > 0, share[codes & ((1 << width) - 1)], 0), n)
    answers = np.split(counts[pair], np.cumsum([len(x[4]) for x in asked])[:-1])
    packed = [
        _pack(_least(c), *(_least(sums[m, i]) for i in range(SUMS - 1)), sums[m, -1]) for c, m in zip(answers, mine)
    ]
    often = np.flatnonzero(np.isin(contexts, frequent))
    seen = np.bincount(np.minimum(counts, LARGEST_DISCOUNTED + 2), minlength=LARGEST_DISCOUNTED + 3)
    extra = [-1] * len(often) + [-2]
    return pa.table(
        {
            "block": pa.array(table.column("block").to_pylist() + extra, pa.int32()),
            "part": pa.array([table.column("part")[0].as_py()] * (len(packed) + len(extra)), pa.int32()),
            "packed": pa.array(packed + [None] * len(extra), pa.binary()),
            "context": pa.array([None] * len(packed) + contexts[often].tolist() + [None], pa.int64()),
            "sums": pa.array([None] * len(packed) + sums[often].tolist() + [seen.tolist()], pa.list_(pa.float64())),
        }
    )


def score(
    docs: DataFrame, learns: Column, text: str = "text", id_col: str = "doc_id", classes: int | None = None
) -> DataFrame:
    """``id, learns, n_tokens, n_known, train_tokens, base_score, score`` per document.

    ``learns`` marks the rows that train the model; all rows are scored. With
    ``classes``, pairs are counted between that many classes instead of words.
    """
    spark = docs.sparkSession
    ship(spark)
    blocks, n_blocks = _blocks(docs, text, id_col, learns)
    by_word = Window.partitionBy("word")
    # at most one row per block and word; the first block of a word stands for it in the word table
    counted = _block_words(blocks).select(
        "block",
        "word",
        F.sum("c").over(by_word).alias("c"),
        (F.min("block").over(by_word) == F.col("block")).alias("first"),
    )
    # all rows of a word are in one partition, so the least of their numbers is its own
    numbered = counted.withColumn("number", F.monotonically_increasing_id())
    words = cut_lineage(numbered.withColumn("number", F.min("number").over(by_word)))
    table = words.where("first AND c > 0")
    of_counts = table.groupBy(F.least("c", F.lit(LARGEST_DISCOUNTED + 2)).alias("r")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("c").alias("tokens"), F.max(F.shiftright("number", 33)).alias("last")
    )
    rows = of_counts.collect()  # at most LARGEST_DISCOUNTED + 2 rows
    fitted = Words.fit(
        sum(r["tokens"] for r in rows),
        sum(r["n"] for r in rows),
        {r["r"]: r["n"] for r in rows if r["r"] <= LARGEST_DISCOUNTED + 1},
    )
    ranked = None
    if classes is not None:
        ordered = table.orderBy(F.desc(F.octet_length("word") == 0), F.desc("c"), "word").limit(classes - 1)
        ranked = [(bytes(r["word"]), r["c"]) for r in ordered.select("word", "c").collect()]
    symbols = Symbols.fit(fitted, ranked)
    n_parts = n_blocks
    # Spark's numbers hold the partition above 33 bits: closed up, they take half the bytes
    row = F.col("number").bitwiseAND((1 << 33) - 1)
    number = row * (max((r["last"] for r in rows), default=0) + 1) + F.shiftright("number", 33) + FIRST
    # fewer than n_parts rows
    often = table.where(F.col("c") > fitted.total // n_parts).select(number.alias("number")).collect()
    frequent = np.unique([START, OTHER, *(r["number"] for r in often)])
    shared = spark.sparkContext.broadcast((symbols, frequent))
    answers = words.where("c > 0").select("block", "word", "c", number.alias("number"), F.lit(-1).alias("part"))

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        symbols, frequent = shared.value
        tokens = Tokens.of(table, answers, symbols)
        learns = np.repeat(np.array(table.column("learns").to_pylist(), bool), tokens.sizes)
        counts = np.bincount(tokens.pair[learns], minlength=len(tokens.contexts)).astype(np.int32)
        tokens.place = tokens.pair = learns = None
        found, packed = [], []
        for part, at in tokens.parts(n_parts, frequent):
            context, lengths = np.unique(tokens.contexts[at], return_counts=True)
            word, place = np.unique(tokens.nexts[at], return_inverse=True)
            found.append(part)
            packed.append(
                _pack(
                    _least(tokens.numbers[context]), _least(lengths), _least(tokens.numbers[word]), _least(tokens.known[word]),
                    _least(place), _least(counts[at]),
                )
            )
        block = table.column("block")[0].as_py()
        return pa.table(
            [pa.array([block] * len(found), pa.int32()), pa.array(found, pa.int32()), pa.array(packed, pa.binary())],
            names=["block", "part", "packed"],
        )

    asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, "block int, part int, packed binary")
    tallied = cut_lineage(
        asked.groupBy("part").applyInArrow(
            lambda table: tally(table, *shared.value),
            "block int, part int, packed binary, context long, sums array<double>",
        )
    )
    total = [F.sum(F.col("sums")[r]).alias(str(r)) for r in range(LARGEST_DISCOUNTED + 3)]
    seen = tallied.where("block = -2").agg(*total).first()
    ratios = discounts({r: int(seen[r] or 0) for r in range(1, LARGEST_DISCOUNTED + 2)})
    rows = tallied.where("block = -1").groupBy("context").agg(*total[:SUMS]).collect()  # at most as many as frequent
    sums_of = {r["context"]: [r[str(i)] for i in range(SUMS)] for r in rows}
    weights = spark.sparkContext.broadcast((ratios, np.array([sums_of.get(h, [0.0] * SUMS) for h in frequent.tolist()])))

    def judge(table: pa.Table, answers: pa.Table) -> pa.Table:
        symbols, frequent = shared.value
        ratios, of_frequent = weights.value
        level = symbols.level
        of_words = pc.less(answers.column("part"), 0)
        tokens = Tokens.of(table, answers.filter(of_words), symbols)
        of_pairs = answers.filter(pc.invert(of_words))
        packed = dict(zip(of_pairs.column("part").to_pylist(), of_pairs.column("packed")))
        del answers, of_pairs
        counts = np.zeros(len(tokens.contexts), np.int32)
        sums = np.zeros((len(tokens.numbers), SUMS))
        for part, at in tokens.parts(n_parts, frequent):
            found, *columns = _unpack(packed.pop(part).as_buffer())
            counts[at] = found
            sums[np.unique(tokens.contexts[at])] = np.column_stack(columns)
        often = np.flatnonzero(np.isin(tokens.numbers, frequent))
        sums[often] = of_frequent[np.searchsorted(frequent, tokens.numbers[often])]
        totals = sums[:, 0]
        taken = sums[:, 1:-1] @ (np.arange(1, LARGEST_DISCOUNTED + 1) * (1 - ratios[1:]))
        left, free = taken / np.maximum(totals, 1), 1 - sums[:, -1]
        totals = totals.copy()
        del sums
        logs, shares = np.empty(len(counts)), symbols.share(tokens.known)
        for start in range(0, len(counts), 1 << 18):  # so that what lies between stays small
            some = slice(start, start + (1 << 18))
            at = tokens.contexts[some]
            share = shares[tokens.nexts[some]]
            logs[some] = pair_logs(counts[some], totals[at], left[at], free[at], ratios, share)
        del counts
        within = np.log10(level.probability(tokens.counts)) - np.log10(symbols.other)
        sizes, place = tokens.sizes, tokens.place
        score = _sum_texts(logs, tokens.pair, sizes) + _sum_texts(np.where(tokens.apart, 0, within), place, sizes)
        base = _sum_texts(level.base(tokens.counts), place, sizes)
        n_known = _sum_texts(tokens.counts > 0, place, sizes, np.int64)
        return pa.table(
            {
                "id": table.column("id"),
                "learns": table.column("learns"),
                "n_tokens": pa.array(sizes, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([level.total] * table.num_rows, pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    of_pairs = tallied.where("block >= 0").select("block", "part", "packed")
    both = answers.unionByName(of_pairs, allowMissingColumns=True)
    kind = blocks.schema["id"].dataType.simpleString()
    return (
        blocks.groupBy("block")
        .cogroup(both.groupBy("block"))
        .applyInArrow(
            judge,
            f"id {kind}, learns boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )


def held_out(id_col: str) -> Column:
    """Whether a row is kept from training: CRC-32 of its id as text leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 1, F.lit(False))


def digest(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return scored.select(
        F.col("id").alias(id_col),
        (~F.col("learns")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )
