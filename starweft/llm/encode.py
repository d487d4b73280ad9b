"""Token ids of a whole corpus.

Defined results: a null or empty text has an empty list; every input row gives one output row, repeated and null ids
included; texts are encoded whole, however long; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Decoder, StreamingEncoder, Vocabulary, loaded, uncollected

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECE_CHARS = 1 << 16  # characters that go to the streaming encoder at a time


def vocabulary_bytes(path: str) -> bytes:
    """Read on the driver and sent to the tasks (under 1 MB), so executors need no copy of the file."""
    with open(path, "rb") as f:
        return f.read()


def shared_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary's lines and the tokens that its merges can build, worked out once on the driver."""
    lines = vocabulary_bytes(path)
    return spark.sparkContext.broadcast((lines, loaded(lines).built))


def encode_text(v: Vocabulary, text: str | None) -> list[int]:
    if not text:
        return []
    e, out = StreamingEncoder(v), []
    for at in range(0, len(text), PIECE_CHARS):
        out += e.feed(text[at : at + PIECE_CHARS])
    return out + e.finish()


def list_array(lists: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids)"""
    shared = shared_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(*shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):  # keeps the lists of one output batch small
                part = b.slice(at, 1000)
                with uncollected():
                    ids = [encode_text(v, t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(ids)], ["doc_id", "ids"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)


def decode(tokens: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text)"""
    shared = shared_vocabulary(tokens.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(*shared.value)
        for b in batches:
            texts = []
            for x in b.column(1).to_pylist():
                d = Decoder(v)
                texts.append("".join([d.feed(x[at : at + 65536]) for at in range(0, len(x or []), 65536)]) + d.finish())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = tokens.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{ids}`").alias("ids"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema)
