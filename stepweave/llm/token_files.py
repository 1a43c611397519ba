"""Token ids as Parquet files that can be read in parts.

One row per document, in ascending id order across and within files: the id, the
row's place, the number of ids and the ids as a list column. Ids are dictionary
encoded, ids and counts of documents delta encoded; row groups and pages are
bounded, and Parquet's page indexes let a reader skip to the documents it wants
or read counts without touching any token.

The texts are dealt by id range and sorted before encoding, so that the ids, the
larger data, are written where they are made and never shuffled. Where a
document starts in the whole stream follows from per-file totals.

Cases: a null or empty text has the end id alone. A null document id comes
first. Rows with equal ids follow each other in order of their texts. An empty
table gives an empty dataset.
"""

from __future__ import annotations

import string
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import ship
from stepweave.session import _shared_folder

END_ID = 2
SPACE_SIGN = "\u0120"
WHITE = "".join(w for w in map(chr, range(0x3001)) if w.isspace())
# Pieces a worker remembers, some 60 bytes each, and the most ids that one may have
CACHE_ENTRIES = 800_000
CACHE_IDS = 64
# Texts encoded at a time (one at least)
GROUP_BYTES = 2_000_000
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000

LETTER_OR_DIGIT = np.zeros(256, bool)
LETTER_OR_DIGIT[list((string.ascii_letters + string.digits).encode())] = True
# first bytes of U+00C0 to U+027F, all letters but the signs of times and division, and of U+00C0 to U+07FF, none white
LATIN_LEAD = np.zeros(256, bool)
LATIN_LEAD[0xC3:0xCA] = True
PRINTED = np.zeros(256, bool)
PRINTED[0x21:0x7F] = True
PRINTED_OR_LEAD = PRINTED.copy()
PRINTED_OR_LEAD[0xC3:0xE0] = True


def _strings(chunks: pa.StringArray) -> list[str]:
    """A list by way of numpy, many times faster than Arrow's own."""
    return chunks.to_numpy(zero_copy_only=False).tolist()


def _white_ends(chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each chunk starts and ends with white space; an empty one does both."""
    empty = pc.equal(chunks, "")
    starts = pc.or_(empty, pc.not_equal(pc.utf8_ltrim(chunks, WHITE), chunks))
    ends = pc.or_(empty, pc.not_equal(pc.utf8_rtrim(chunks, WHITE), chunks))
    return starts.to_numpy(zero_copy_only=False), ends.to_numpy(zero_copy_only=False)


def _gather(
    stored: np.ndarray, begins: np.ndarray, sizes: np.ndarray, order: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``stored`` in the given order, and where each one ends."""
    lengths = sizes[order]
    upto = np.cumsum(lengths, dtype=np.int32)
    # a run's entries follow each other: a running number, moved to where the run is stored
    at = np.repeat(begins[order] - (upto - lengths), lengths)
    at += np.arange(len(at), dtype=np.int32)
    return stored[at], upto


def _joined(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and how many each entry has."""
    return np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int32, len(packed)) // 4


def _utf8(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (and the last ends)."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.empty(0, np.uint8) if buffer is None else np.frombuffer(buffer, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


class PieceTable:
    """Ids of pieces in flat arrays, found by a hash of their bytes; equal bytes decide.

    When it is full, the half that was asked for last stays, and long pieces are
    not remembered. Sizes and equal hashes change no result.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], entries: int):
        self.encode, self.entries, self.time = encode, max(2, entries), 0
        self.factors = np.random.default_rng(0).integers(0, 1 << 63, 64, np.uint64) * 2 + 1
        self.keys, self.ids = pa.array([], pa.string()), np.empty(0, "<u4")
        self.begins, self.sizes, self.used = (np.empty(0, np.int32) for _ in range(3))
        # sorted, each with its row
        self.hashes, self.rows = np.empty(0, np.uint64), np.empty(0, np.int32)

    def _hashes(self, pieces: pa.StringArray) -> np.ndarray:
        data, bounds = _utf8(pieces)
        at = np.arange(len(data), dtype=np.int32) - np.repeat(bounds[:-1], np.diff(bounds))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + 1) * self.factors[at % len(self.factors)], out=sums[1:])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def find(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct pieces, and how many each has."""
        if not len(pieces):
            return np.empty(0, "<u4"), np.empty(0, np.int32)
        hashes = self._hashes(pieces)
        order = np.argsort(hashes)
        ordered = hashes[order]
        at = np.searchsorted(self.hashes, ordered)
        hit = np.zeros(len(pieces), bool)
        inside = at < len(self.hashes)
        hit[inside] = self.hashes[at[inside]] == ordered[inside]
        rows = np.full(len(pieces), -1, np.int32)
        rows[order[hit]] = self.rows[at[hit]]
        asked = np.flatnonzero(rows >= 0)
        same = pc.equal(self.keys.take(pa.array(rows[asked])), pieces.take(pa.array(asked)))
        rows[asked[~same.to_numpy(zero_copy_only=False)]] = -1

        missing = np.flatnonzero(rows < 0)
        rows[missing] = np.arange(len(self.keys), len(self.keys) + len(missing), dtype=np.int32)
        if len(missing):
            self._add(pieces.take(pa.array(missing)))
            # where they go among the sorted hashes; of equal ones the first is found again
            new = ~hit
            new[1:] &= ordered[1:] != ordered[:-1]
            self.hashes = np.insert(self.hashes, at[new], ordered[new])
            self.rows = np.insert(self.rows, at[new], rows[order[new]])
        self.time += 1
        self.used[rows] = self.time
        ids, _ = _gather(self.ids, self.begins, self.sizes, rows)
        sizes = self.sizes[rows]
        if len(missing) and (len(self.keys) > self.entries or self.sizes[rows[missing]].max() > CACHE_IDS):
            self._forget()
        return ids, sizes

    def _add(self, pieces: pa.StringArray) -> None:
        ids, sizes = _joined(self.encode(_strings(pieces)))
        begins = np.cumsum(sizes, dtype=np.int32) - sizes + np.int32(len(self.ids))
        self.keys = pa.concat_arrays([self.keys, pieces])
        self.ids, self.begins = np.r_[self.ids, ids], np.r_[self.begins, begins]
        self.sizes, self.used = np.r_[self.sizes, sizes], np.r_[self.used, np.zeros_like(sizes)]

    def _forget(self) -> None:
        kept = np.flatnonzero(self.sizes <= CACHE_IDS)
        if len(kept) > self.entries:
            kept = np.sort(kept[np.argsort(self.used[kept], kind="stable")[-(self.entries // 2) :]])
        row_of = np.full(len(self.keys), -1, np.int32)
        row_of[kept] = np.arange(len(kept), dtype=np.int32)
        self.keys = self.keys.take(pa.array(kept))
        self.ids, upto = _gather(self.ids, self.begins, self.sizes, kept)
        self.sizes, self.used = self.sizes[kept], self.used[kept]
        self.begins = upto - self.sizes
        rows = row_of[self.rows]
        self.hashes, self.rows = self.hashes[rows >= 0], rows[rows >= 0]


class ByteLevelCodec:
    """Ids of whole texts by the tokenizers library, each distinct piece encoded once.

    The byte-level splitting pattern always cuts before a single space that has
    no other white space beside it, so chunks cut there are encoded on their own.
    Texts with other spaces are encoded whole.

    Inside a chunk it always cuts between a letter or digit and a mark or line
    end, and behind a single line end between printed characters. Pieces cut
    there are encoded on their own too, but for marks of added tokens, which the
    library looks for before it splits.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        # ids whose piece starts with the sign of a space
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.starts_spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts_spaced[[i for piece, i in vocabulary.items() if piece.startswith(SPACE_SIGN)]] = True
        self.line_end = self._encode_alone(["\n"])[0].ids
        added = {c for token in self.library.get_added_tokens_decoder().values() for c in token.content}
        self.cut_before = np.zeros(256, bool)
        self.cut_before[[ord(c) for c in string.punctuation + "\n" if c not in added]] = True
        self.spaced = PieceTable(lambda pieces: self._encode_chunks(pieces, True), CACHE_ENTRIES)
        self.unspaced = PieceTable(lambda pieces: self._encode_chunks(pieces, False), CACHE_ENTRIES // 8)

    def _encode_chunks(self, chunks: list[str], spaced: bool) -> list[bytes]:
        if spaced:
            return self._encode_joined(chunks, " ")
        plain = [c.split() == [c] for c in chunks]
        joined = iter(self._encode_joined([c for c, p in zip(chunks, plain) if p], "\n"))
        alone = iter(self._encode_alone([c for c, p in zip(chunks, plain) if not p]))
        return [next(joined) if p else np.array(next(alone).ids, "<u4").tobytes() for p in plain]

    def _encode_joined(self, chunks: list[str], mark: str) -> list[bytes]:
        """Ids of chunks without white space at their ends, with a space before them or with none.

        One text of all of them, cut again at the ids that start with a space, as
        only chunks do, or at the line ends between them.
        """
        if not chunks:
            return []
        ids = np.array(self._encode_alone([mark + mark.join(chunks)])[0].ids, "<u4")
        cuts = np.flatnonzero(self.starts_spaced[ids] if mark == " " else ids == self.line_end[0]).tolist()
        if len(cuts) != len(chunks) or len(self.line_end) != 1:
            before = " " if mark == " " else ""
            return [np.array(x.ids, "<u4").tobytes() for x in self._encode_alone([before + c for c in chunks])]
        cuts.append(len(ids))
        whole, left_out = ids.tobytes(), 0 if mark == " " else 1
        return [whole[4 * (a + left_out) : 4 * b] for a, b in zip(cuts, cuts[1:])]

    def _encode_alone(self, texts: list[str]) -> list:
        return self.library.encode_batch_fast(texts, add_special_tokens=False)

    def _begins(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pieces begin in the UTF-8 bytes of chunks, and the end of the last."""
        begins = np.zeros(len(data) + 1, bool)
        begins[bounds] = True
        marks = np.flatnonzero(self.cut_before[data])
        marks = marks[marks > 0]
        left, second = data[marks - 1], data[marks - 2]
        sign = (second == 0xC3) & ((left == 0x97) | (left == 0xB7))
        begins[marks[LETTER_OR_DIGIT[left] | (LATIN_LEAD[second] & ~sign)]] = True
        if self.cut_before[ord("\n")]:
            lines = np.flatnonzero(data[1:-1] == ord("\n")) + 1
            begins[lines[PRINTED[data[lines - 1]] & PRINTED_OR_LEAD[data[lines + 1]]] + 1] = True
        return begins

    def _chunks_inside(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct chunks with a space before them, and how many each has.

        No chunk is empty or has white space at its ends.
        """
        if not len(chunks):
            return np.empty(0, "<u4"), np.empty(0, np.int32)
        data, bounds = _utf8(chunks)
        begins = self._begins(data, bounds)
        cuts = np.flatnonzero(begins).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))
        first = np.cumsum(begins, dtype=np.int32)[bounds[:-1]] - 1
        leads = np.zeros(len(pieces), bool)
        leads[first] = True
        with_space = pieces.filter(pa.array(leads)).dictionary_encode()
        without = pieces.filter(pa.array(~leads)).dictionary_encode()
        ids, sizes = self.spaced.find(with_space.dictionary)
        more, more_sizes = self.unspaced.find(without.dictionary)
        stored, sizes = np.r_[ids, more], np.r_[sizes, more_sizes]
        order = np.empty(len(pieces), np.int32)
        order[leads] = with_space.indices.to_numpy()
        order[~leads] = without.indices.to_numpy() + len(with_space.dictionary)
        ids, upto = _gather(stored, np.cumsum(sizes, dtype=np.int32) - sizes, sizes, order)
        return ids, np.diff(upto[np.r_[first[1:], len(pieces)] - 1], prepend=np.int32(0))

    def encode_flat(self, texts: pa.StringArray, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, ``end`` behind each, and where each begins (and the last ends).

        Chunks are cut and numbered by Arrow, so that only the distinct ones of
        these texts are looked up; the ids are gathered by their numbers.
        """
        if not len(texts):
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        cut = pc.split_pattern(texts, " ")
        flat, bounds = cut.flatten(), cut.offsets.to_numpy()
        numbered = flat.dictionary_encode()
        number, chunks = numbered.indices.to_numpy(), numbered.dictionary
        first, last = bounds[:-1], bounds[1:] - 1

        # a text with white space beside a space is encoded whole
        starts_odd, ends_odd = _white_ends(chunks)
        odd = starts_odd[number]
        odd[first] = False
        beside = ends_odd[number]
        beside[last] = False
        whole = np.logical_or.reduceat(odd | beside, first)
        sizes_of = np.diff(bounds)
        kept = ~np.repeat(whole, sizes_of)
        inner = kept.copy()
        inner[first] = False

        # places: distinct chunks, distinct first chunks, texts encoded whole, the end
        asked = np.zeros(len(chunks), bool)
        asked[number[inner]] = True
        place = (np.cumsum(asked, dtype=np.int32) - 1)[number]
        inside, inside_sizes = self._chunks_inside(chunks.filter(pa.array(asked)))
        heads = flat.take(pa.array(first[~whole])).dictionary_encode()
        place[first[~whole]] = len(inside_sizes) + heads.indices.to_numpy()
        leading, leading_sizes = self.unspaced.find(heads.dictionary)
        others = [np.array(self._encode_alone([texts[i].as_py()])[0].ids, "<u4").tobytes() for i in np.flatnonzero(whole)]
        others.append(end)
        outside, outside_sizes = _joined(others)
        stored, stored_sizes = np.r_[inside, leading, outside], np.r_[inside_sizes, leading_sizes, outside_sizes]

        steps = np.where(whole, 1, sizes_of) + 1
        ends = np.cumsum(steps)
        the_end = len(stored_sizes) - 1
        order = np.full(ends[-1], the_end, np.int32)
        filled = np.repeat(~whole, steps)
        filled[ends - 1] = False
        order[filled] = place[kept]
        order[ends[whole] - 2] = np.arange(the_end - len(others) + 1, the_end)
        ids, upto = _gather(stored, np.cumsum(stored_sizes, dtype=np.int32) - stored_sizes, stored_sizes, order)
        return ids, np.r_[0, upto[ends - 1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, starts = self.encode_flat(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(starts, starts[1:])]


def _text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
    """Slices of a batch with their texts, null as empty, of a bounded number of bytes."""
    texts = pc.fill_null(batch.column(column), "")
    upto = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(texts):
        done = upto[at - 1] if at else 0
        size = int(np.searchsorted(upto, done + GROUP_BYTES)) + 1 - at
        yield batch.slice(at, size), texts.slice(at, size)
        at += size


@lru_cache(maxsize=2)
def _codec(tokenizer_file: str) -> ByteLevelCodec:
    return ByteLevelCodec(tokenizer_file)


def write_tokens(
    docs: DataFrame,
    tokenizer_file: str,
    path: str | None = None,
    text: str = "text",
    id_col: str = "doc_id",
    end_id: int = END_ID,
) -> str:
    """Encode every whole text, append ``end_id``, write the files and return their folder."""
    spark = docs.sparkSession
    ship(spark)
    path = path or f"{_shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    ordered = (
        docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("whole"))
        .repartitionByRange("id")
        .sortWithinPartitions("id", "whole")
    )
    end = np.array([end_id], "<u4").tobytes()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer_file)
        part, row = TaskContext.get().partitionId(), 0
        for rows, texts in (x for batch in batches for x in _text_slices(batch, "whole")):
            ids, begins = codec.encode_flat(texts, end)
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("id"),
                    pa.array([part] * n, pa.int32()),
                    pa.array(range(row, row + n), pa.int64()),
                    pa.array(np.diff(begins).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids.view(np.int32))),
                ],
                ["id", "part", "row", "n_tokens", "tokens"],
            )
            row += n

    schema = T.StructType(
        [
            T.StructField("id", ordered.schema["id"].dataType),
            T.StructField("part", T.IntegerType()),
            T.StructField("row", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("tokens", T.ArrayType(T.IntegerType())),
        ]
    )
    (
        ordered.mapInArrow(code, schema)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#id", "false")
        .option("parquet.enable.dictionary#row", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path)
    )
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``id, part, row, n_tokens, tokens``; columns and id ranges that aren't asked for aren't read."""
    return spark.read.parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, row, start``: ids of all documents before each one, from the counts alone.

    Running sums are inside one file; the global order is over one total per file.
    """
    counts = read_tokens(spark, path).select("part", "row", "n_tokens")
    totals = counts.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = totals.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return counts.withColumn("inside", inside).join(before, "part").select(
        "part", "row", (F.col("before") + F.col("inside")).alias("start")
    )


def digest(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Start, count and CRC of each document's ids, read back from the files."""
    ship(spark)
    stored = read_tokens(spark, path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            values = np.asarray(tokens.values).astype("<u4", copy=False)
            offsets = tokens.offsets.to_pylist()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            names = ["id", "part", "row", "n_tokens"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(crc, pa.int64())], [*names, "crc"]
            )

    schema = T.StructType(
        [*(f for f in stored.schema if f.name != "tokens"), T.StructField("crc", T.LongType())]
    )
    return (
        stored.mapInArrow(sums, schema)
        .join(starts(spark, path), ["part", "row"])
        .select(F.col("id").alias(id_col), "start", "n_tokens", F.col("crc").alias("ids_crc32"))
    )
