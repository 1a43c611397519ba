"""Encoding and decoding with merge-type (BPE) piece vocabularies.

The pieces and scores come from the model file; the merging is done here. An
agenda holds the adjacent symbol pairs that form a piece, ordered by score and
then by position; the best is merged, and the pairs it makes enter the agenda. A
symbol that is no piece falls back to its bytes.

Chunks of a text between which no piece can reach are merged on their own, many
at a time: a chunk is a row, its agenda the row's pair ranks, and every step
merges the best pair of each row that has one. Long chunks use a heap.

Every encoded chunk is compared with the sentencepiece library.
"""

from __future__ import annotations

import heapq
import re

import numpy as np

from stepweave.llm.pieces import CACHE_ENTRIES, ChunkCache

SPACE = "▁"
WIDTHS = (6, 8, 10, 12, 16, 24, 40)
STEP_ROWS = 20_000
NO_PAIR = np.int32(2**31 - 1)


class PieceCodec:
    def __init__(self, model_file: str, entries: int = CACHE_ENTRIES, checked: bool = True):
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=model_file)
        self.n = n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(n)]
        byte = [lib.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(names) if not special[i] and not byte[i]}
        self.order = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if byte[i]}
        self.unknown = lib.unk_id()
        self.surface = [b"" if special[i] else names[i].replace(SPACE, " ").encode() for i in range(n)]
        for value, i in self.bytes.items():
            self.surface[i] = bytes([value])
        # chunks are independent where no piece holds a space mark behind another character
        self.independent = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.checked = checked
        self._pair_table()
        # marks that no piece holds behind a letter or digit
        tails = [c for c in ",.;:!?" if c in self.ids and not any(re.search(rf"\w{re.escape(c)}", p) for p in self.ids)]
        self.cache = ChunkCache(self._encode_chunks, entries, {c: _packed([self.ids[c]]) for c in tails})

    def _pair_table(self) -> None:
        """Sorted keys of the symbol pairs that form a piece, with the piece and its rank."""
        symbol = np.arange(0x110000, dtype=np.int64) + self.n  # no piece: above all ids
        for c, i in self.ids.items():
            if len(c) == 1:
                symbol[ord(c)] = i
        for c in range(128):
            if chr(c) not in self.ids and c in self.bytes:
                symbol[c] = self.bytes[c]
        self.symbol, self.base = symbol, 0x110000 + self.n + 1
        ranks = {s: r for r, s in enumerate(sorted(set(self.order.values())))}
        rows = [
            (self.ids[p[:k]] * self.base + self.ids[p[k:]], i, ranks[self.order[p]])
            for p, i in self.ids.items()
            for k in range(1, len(p))
            if p[:k] in self.ids and p[k:] in self.ids
        ]
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
        self.keys = np.append(table[:, 0], np.iinfo(np.int64).max)
        self.made = np.append(table[:, 1], 0)
        self.rank = np.append(table[:, 2], NO_PAIR).astype(np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], NO_PAIR), self.made[at]

    def _merge_rows(self, chunks: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of at most ``width`` symbols: one flat array and the number for each chunk."""
        n = len(chunks)
        lengths = np.fromiter(map(len, chunks), np.int64, n)
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        cells = np.arange(width)[None, :] < lengths[:, None]
        pad = self.base - 1
        symbols = np.full((n, width), pad, np.int64)
        symbols[cells] = self.symbol[points]
        done = symbols.copy()
        rows = np.arange(n)
        ranks, made = self._pairs(symbols[:, :-1], symbols[:, 1:])
        columns = np.arange(width)[None, :]
        while len(rows):
            best = ranks.argmin(1)
            each = np.arange(len(rows))
            open_ = ranks[each, best] != NO_PAIR
            if not open_.all():
                done[rows[~open_]] = symbols[~open_]
                rows, symbols, ranks, made, best = rows[open_], symbols[open_], ranks[open_], made[open_], best[open_]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            lengths[rows] -= 1
            merged = made[each, best]
            later = columns + (columns > best[:, None])
            symbols = np.take_along_axis(symbols, np.minimum(later, width - 1), 1)
            symbols[:, -1] = pad
            symbols[each, best] = merged
            shifted = np.minimum(later[:, :-1], width - 2)
            ranks, made = np.take_along_axis(ranks, shifted, 1), np.take_along_axis(made, shifted, 1)
            ranks[:, -1] = NO_PAIR
            inner = np.minimum(best, width - 2)
            ranks[each, inner], made[each, inner] = self._pairs(symbols[each, inner], symbols[each, inner + 1])
            prior = np.maximum(best - 1, 0)
            ranks[each, prior], made[each, prior] = self._pairs(symbols[each, prior], symbols[each, prior + 1])
        return done[np.arange(width)[None, :] < lengths[:, None]], lengths

    def merge(self, symbols: str) -> list[str]:
        """Pieces of one marked text, by a heap; stale entries are skipped."""
        order = self.order
        parts: list[str | None] = list(symbols)
        n = len(parts)
        agenda = [(order[p], i, p) for i, p in enumerate(map(str.__add__, symbols, symbols[1:])) if p in order]
        heapq.heapify(agenda)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while agenda:
            _, left, pair = heapq.heappop(agenda)
            mine, right = parts[left], after[left]
            if mine is None or right >= n or mine + parts[right] != pair:
                continue
            parts[left], parts[right] = pair, None
            right = after[left] = after[right]
            around = [(before[left], left)]
            if right < n:
                before[right] = left
                around.append((left, right))
            for a, b in around:
                if a >= 0 and (new := parts[a] + parts[b]) in order:
                    heapq.heappush(agenda, (order[new], a, new))
        return [p for p in parts if p is not None]

    def _fallback(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def ids_of(self, marked: str) -> list[int]:
        return [i for piece in self.merge(marked) for i in self._fallback(piece)]

    def _encode_chunks(self, chunks: list[str], spaced: bool) -> list[bytes]:
        """All chunks carry a mark: the first of a text gets the model's dummy prefix."""
        out: list[bytes] = [b""] * len(chunks)
        marked = [SPACE + c.replace(" ", SPACE) for c in chunks]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        low = 0
        for width in WIDTHS:
            picked = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for at in range(0, len(picked), STEP_ROWS):
                mine = picked[at : at + STEP_ROWS].tolist()
                flat, lengths = self._merge_rows([marked[i] for i in mine], width)
                ends = np.cumsum(lengths)
                odd = set()
                if len(flat) and flat.max() >= self.n:
                    odd = set(np.searchsorted(ends, np.flatnonzero(flat >= self.n), "right").tolist())
                whole = flat.astype("<u4").tobytes()
                start = 0
                for k, (i, end) in enumerate(zip(mine, (ends * 4).tolist())):
                    out[i] = whole[start:end] if k not in odd else _packed(self.ids_of(marked[i]))
                    start = end
        for i in np.flatnonzero(sizes > low).tolist():
            out[i] = _packed(self.ids_of(marked[i]))
        if self.checked:
            self.check(chunks, out)
        return out

    def check(self, texts: list[str], packed: list[bytes]) -> None:
        """Compare with the library, which puts the same mark before each text."""
        given = [(t, x) for t, x in zip(texts, packed) if t]
        theirs = self.library.encode([t for t, _ in given], num_threads=1)
        flat = np.fromiter((i for x in theirs for i in x), np.uint32)
        if flat.tobytes() != b"".join([x for _, x in given]):
            wrong = next(t for (t, x), y in zip(given, theirs) if x != _packed(y))
            raise ValueError(f"the merged pieces differ from the library's for {wrong[:80]!r}")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit words; an empty text has none."""
        out: list[bytes] = [b""] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if not text:
                continue
            # runs of marks can merge across chunks, so such a text is merged as one
            if self.independent and "  " not in text and text[0] != " " and text[-1] != " " and SPACE not in text:
                plain.append(i)
            else:
                out[i] = self._encode_chunks([text], False)[0]
        for i, ids in zip(plain, self.cache.texts([texts[i] for i in plain])):
            out[i] = ids
        return out

    def decode(self, ids) -> str:
        """Text of ids: byte pieces joined to characters, marks to spaces, the dummy prefix dropped."""
        surface = self.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _packed(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()
