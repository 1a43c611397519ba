import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from stepweave.llm import sentencepieces, token_files
from stepweave.llm.common import vocabulary
from stepweave.llm.piece_codec import PieceCodec
from stepweave.llm.token_files import ByteLevelCodec

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b \t c\n\n d ", "Hello, wörld! It's 42.", "x" * 500, "日本語 テキスト 𝄞",
    "tab\tand\nnewline\r\n end\n ", "▁ marked ▁▁text", "<s> </s> <unk> <0x41>", "don't we'll ²³ ½ ª", " nbsp  em", "\x00\x1f\x85 ",
    "word " * 30_000, "aaaa" * 20 + " " + "ab" * 40, "ends with newline\n", "\n starts", "é combining", "<|endoftext|> inside <|endoftext|>",
    "same", "same",
]


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(vocabulary("piece_bpe_32k.model"))


def test_pieces_equal_the_library(codec):
    texts = [t or "" for t in TEXTS]
    for round_ in range(2):  # the second time from the cache
        got = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]
        want = codec.library.encode(texts, num_threads=1)
        assert got == want
        assert [codec.decode(x) for x in got] == [codec.library.decode(x) for x in want]


def test_heap_and_rows_agree(codec):
    words = ["in", "thereof", "überschaubar", "antidisestablishment", "ab\ncd", "日本", "a" * 40, "", "!?"]
    rows = [np.frombuffer(x, "<u4").tolist() for x in codec._encode_chunks(words, True)]
    assert rows == [codec.ids_of("▁" + w) for w in words]


def test_a_full_cache_changes_nothing():
    small = PieceCodec(vocabulary("piece_bpe_32k.model"), entries=3)
    texts = ["one two three four", "five six one", "two seven eight nine one"] * 3
    for t in texts:
        assert np.frombuffer(small.encode([t])[0], "<u4").tolist() == small.library.encode(t)


def test_a_wrong_merge_is_noticed(codec):
    with pytest.raises(ValueError, match="differ"):
        codec.check(["ab"], [b"\0\0\0\0"])


def test_encode_decode(docs_of, codec):
    rows = list(enumerate(TEXTS)) + [(None, "null id")]
    coded = sentencepieces.encode_decode(docs_of(rows), vocabulary("piece_bpe_32k.model"))
    got = sorted((tuple(r) for r in sentencepieces.digest(coded).collect()), key=str)
    want = []
    for i, t in rows:
        ids = codec.library.encode(t or "")
        texts = ",".join(map(str, ids)), codec.library.decode(ids)
        want.append((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in texts)))
    assert got == sorted(want, key=str)
    assert sentencepieces.digest(sentencepieces.encode_decode(docs_of([]), vocabulary("piece_bpe_32k.model"))).count() == 0


def test_byte_level_ids_equal_the_library():
    codec = ByteLevelCodec(vocabulary("byte_bpe_50k.json"))
    texts = [t or "" for t in TEXTS]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]
        assert got == [x.ids for x in codec.library.encode_batch(texts, add_special_tokens=False)]


def test_white_space_beside_spaces_is_encoded_in_its_context():
    codec = ByteLevelCodec(vocabulary("byte_bpe_50k.json"))
    texts = ["a\n \nb", "a\n b", "a \nb", "a b", "x a\n", "\nb y", "a\u00a0 b", "a \u3000b c", "a\t b a\n", "Ġa b Ġc", "a <|endoftext|> b"]
    for order in (texts, texts[::-1]):
        found = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(order)]
        assert found == [x.ids for x in codec.library.encode_batch(order, add_special_tokens=False)]


def test_a_word_is_encoded_once_whatever_marks_and_line_ends_follow(monkeypatch):
    given, encode = {True: [], False: []}, ByteLevelCodec._encode_chunks

    def watched(self, chunks, spaced):
        given[spaced] += chunks
        return encode(self, chunks, spaced)

    monkeypatch.setattr(ByteLevelCodec, "_encode_chunks", watched)
    codec = ByteLevelCodec(vocabulary("byte_bpe_50k.json"))
    texts = ["a tree, tree. tree*** tree%%% tree's forêt", "a forêt! tree.\nForest forêt.\nForest tree.\nA forêt\nForest"]
    got = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]
    assert got == [x.ids for x in codec.library.encode_batch(texts, add_special_tokens=False)]
    assert sorted(given[True]) == ["forêt", "tree"]
    assert len(given[False]) == len(set(given[False]))
    assert set(given[False]) == {"a", "A", "Forest", ",", ".", "!", "***", "%%%", "'s", ".\n", "\n"}


def test_pieces_inside_chunks_equal_the_library():
    codec = ByteLevelCodec(vocabulary("byte_bpe_50k.json"))
    texts = [
        "x don't, we'll'll 'tis x's'table x.'s", "x a×. b÷! é×÷ ×a÷.", "x 3.14, 1_000 v2.\nNext ½. ²,", "x a.\n\nB c.\r\nD e\n\n\nF g.\nÉ",
        "x a.\n\u00a0b c.\n\u3000d e\u0085\nf g\u2028.\nh", "x a.<|endoftext|>.b c<|endoftext|>,d <|x|>.\n<|endoftext|>\ne", "x e\u0301. 日。\n本. ʰ! ɏ.",
    ]
    for order in (texts, texts[::-1], texts + ["x a. b."], []):
        found = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(order)]
        assert found == [x.ids for x in codec.library.encode_batch(order, add_special_tokens=False)]


@pytest.mark.parametrize("entries, factor", [(3, None), (10, 0), (100_000, 0), (100_000, None)])
def test_forgotten_pieces_and_equal_hashes_change_nothing(monkeypatch, entries, factor):
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", entries)
    codec = ByteLevelCodec(vocabulary("byte_bpe_50k.json"))
    if factor is not None:
        for table in (codec.spaced, codec.unspaced):
            table.factors[:] = factor
    texts = ["one two, three four.", "five six\none two", "two seven " + "x" * 900 + " eight, nine! one", "y" * 900, ""] * 2
    for batch in [[t] for t in texts] + [texts, texts[::-1]]:
        found = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(batch)]
        assert found == [x.ids for x in codec.library.encode_batch(batch, add_special_tokens=False)]
    assert codec.spaced.sizes.max() <= token_files.CACHE_IDS and len(codec.spaced.keys) <= max(entries, 2)


def test_token_files(spark, docs_of, tmp_path):
    rows = [(50 - i, t) for i, t in enumerate(TEXTS)] + [(50, "tie b"), (50, "tie a"), (None, "null id")]
    path = token_files.write_tokens(docs_of(rows), vocabulary("byte_bpe_50k.json"), str(tmp_path / "tokens"))
    got = token_files.digest(spark, path).orderBy("start").collect()
    library = ByteLevelCodec(vocabulary("byte_bpe_50k.json")).library
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_layout_of_token_files(spark, docs_of, tmp_path):
    rows = [(i, f"text number {i} " * 5) for i in range(300)]
    path = token_files.write_tokens(docs_of(rows), vocabulary("byte_bpe_50k.json"), str(tmp_path / "tokens"))
    file = next((tmp_path / "tokens").glob("*.parquet"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    tokens = next(c for name, c in columns.items() if name.startswith("tokens"))
    assert any("DICTIONARY" in e for e in tokens.encodings)
    assert "DELTA_BINARY_PACKED" in columns["id"].encodings and tokens.has_column_index and tokens.has_offset_index
    some = token_files.read_tokens(spark, path).where("id = 17").select("n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,17)" in plan and "tokens:array" not in plan.split("ReadSchema")[1]
    assert token_files.digest(spark, token_files.write_tokens(docs_of([]), vocabulary("byte_bpe_50k.json"))).count() == 0
