"""Token ids by a tokenizer file: its bytes are broadcast, so that executors need no path of their own."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_LOADED: dict[str, object] = {}


def _processor(model: bytes):
    import sentencepiece

    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _LOADED[key]


def model_bytes(path: str) -> bytes:
    """A sentencepiece model file, read by the driver."""
    with open(path, "rb") as f:
        return f.read()


def ids(spark: SparkSession, text: Column, model: bytes) -> Column:
    """The token ids of a text as array<int>; a null text has none."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = _processor(held.value)
        for texts in batches:
            yield pa.array([made.encode(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return encoded(text)


def count(spark: SparkSession, text: Column, model: bytes) -> Column:
    """The number of tokens of a text."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("int")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = _processor(held.value)
        for texts in batches:
            yield pa.array([len(made.encode(t or "")) for t in texts.to_pylist()], pa.int32())

    return counted(text)


def fingerprint(model: bytes) -> str:
    """A digest of what the tokenizer does: each id with its piece and kind, in order; two files of one vocabulary agree."""
    sp, digest = _processor(model), hashlib.sha256()
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i).encode()
        digest.update(i.to_bytes(8, "big") + len(piece).to_bytes(8, "big") + piece + bytes([sp.is_control(i), sp.is_byte(i), sp.is_unknown(i)]))
    return digest.hexdigest()


def byte_lengths(model: bytes) -> list[int]:
    """The bytes of text that each id stands for; 0 for control ids."""
    sp = _processor(model)
    return [1 if sp.is_byte(i) else 0 if sp.is_control(i) or sp.is_unknown(i) else len(sp.id_to_piece(i).replace("▁", " ").encode()) for i in range(sp.get_piece_size())]
