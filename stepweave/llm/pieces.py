"""Encoding of texts chunk by chunk, with a bounded cache of encoded chunks."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import pyarrow as pa

CACHE_ENTRIES = 600_000
GROUP_CHARS = 2_000_000


class ChunkCache:
    """Ids of chunks as little-endian 32-bit words.

    A text is cut before each space; ``encode_many(chunks, spaced)`` gives the
    ids of distinct chunks: the first of a text has no space before it, the
    others have one. ``tails`` are marks with ids of their own wherever they
    end a chunk behind a letter or digit, so ``word`` and ``word,`` are encoded
    once.

    The cache has two generations: when the younger is full it becomes the
    older, and what is still in use moves over. Sizes change no result.
    """

    def __init__(
        self,
        encode_many: Callable[[list[str], bool], list[bytes]],
        entries: int = CACHE_ENTRIES,
        tails: dict[str, bytes] | None = None,
    ):
        self.encode_many = encode_many
        self.half = max(1, entries // 2)
        self.tails = tails or {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def unspaced(self, heads: list[str]) -> list[bytes]:
        asked = list(set(heads).difference(self.heads))
        if len(self.heads) + len(asked) > self.half // 8:
            self.heads = {}
            asked = list(set(heads))
        self.heads.update(zip(asked, self.encode_many(asked, False)))
        return [self.heads[h] for h in heads]

    def _find(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks that are not in the younger generation."""
        older, tails = self.older, self.tails
        found, split, asked = {}, [], set()
        for c in chunks:
            ids = older.get(c)
            if ids is not None:
                found[c] = ids
            elif c[-1:] in tails and c[-2:-1].isalnum():
                split.append(c)
                asked.add(c[:-1])
            else:
                asked.add(c)
        cores = {}
        for c in asked:
            ids = self.known.get(c) or found.get(c) or older.get(c)
            if ids is not None:
                cores[c] = ids
        fresh = list(asked.difference(cores))
        found.update(cores)
        found.update(zip(fresh, self.encode_many(fresh, True)))
        for c in split:
            found[c] = found[c[:-1]] + tails[c[-1]]
        return found

    def spaced(self, chunks: Sequence[str]) -> list[bytes]:
        """Ids of chunks with a space before them."""
        ids = list(map(self.known.get, chunks))
        gaps = [i for i, x in enumerate(ids) if x is None]
        if gaps:
            found = self._find({chunks[i] for i in gaps})
            for i in gaps:
                ids[i] = found[chunks[i]]
            if len(self.known) + len(found) > self.half:
                self.older, self.known = self.known, found
            else:
                self.known.update(found)
        return ids

    def texts(self, texts: Sequence[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        heads = self.unspaced([s[0] for s in split])
        ids = self.spaced(list(chain.from_iterable(s[1:] for s in split)))
        out, at = [], 0
        for head, s in zip(heads, split):
            end = at + len(s) - 1
            out.append(head + b"".join(ids[at:end]))
            at = end
        return out


def grouped(texts: Iterable[str], chars: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Consecutive texts, about ``chars`` characters at a time (one text at least)."""
    out: list[str] = []
    size = 0
    for text in texts:
        out.append(text)
        size += len(text)
        if size >= chars:
            yield out
            out, size = [], 0
    if out:
        yield out


def text_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with their texts, null as empty, of a bounded number of characters.

    The cyclic collector is off meanwhile: millions of short-lived strings and
    no cycles.
    """
    gc.disable()
    try:
        for batch in batches:
            at = 0
            texts = (t or "" for t in batch.column(column).to_pylist())
            for group in grouped(texts):
                yield batch.slice(at, len(group)), group
                at += len(group)
    finally:
        gc.enable()


def list_column(packed: Sequence[bytes]) -> pa.ListArray:
    """A list<int32> column from little-endian 32-bit words."""
    offsets = [0]
    for x in packed:
        offsets.append(offsets[-1] + len(x) // 4)
    values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
