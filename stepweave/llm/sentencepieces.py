"""SentencePiece encoding and decoding of a text column.

Texts are encoded in Arrow batches by :class:`~stepweave.llm.piece_codec.PieceCodec`,
which merges by an agenda of adjacent pairs and compares every encoded chunk
with the library. Ids are decoded again by the same codec.

Cases: a null or empty text has no ids and decodes to an empty text. Very long
texts are encoded alone and whole. Repeated rows and rows with null ids give
rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import ship
from stepweave.llm.piece_codec import PieceCodec
from stepweave.llm.pieces import list_column, text_groups


@lru_cache(maxsize=2)
def _codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def encode_decode(docs: DataFrame, model_file: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id, ids, decoded``: the ids of each whole text and the text they decode to.

    ``model_file`` must be readable on every executor.
    """
    ship(docs.sparkSession)
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("whole"))
    id_type = narrow.schema["id"].dataType

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_file)
        for rows, texts in text_groups(batches, "whole"):
            packed = codec.encode(texts)
            decoded = [codec.decode(np.frombuffer(x, "<u4").tolist()) for x in packed]
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), list_column(packed), pa.array(decoded, pa.string())], ["id", "ids", "decoded"]
            )

    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.StringType()),
        ]
    )
    return narrow.mapInArrow(code, schema)


def digest(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return coded.select(
        F.col("id").alias(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
