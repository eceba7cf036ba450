"""Embedding chunks in bounded batches, with retries; vectors as stored bytes; a stand-in embedder."""

from __future__ import annotations

import hashlib
import struct
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

BATCH, RETRIES, FIRST_WAIT, MOST_WAIT = 100, 5, 2.0, 60.0
EmbedBatch = Callable[[list[str]], list[list[float]]]


class CountMismatch(ValueError):
    """A provider gave another number of vectors than of texts (ERR_EMBED_COUNT_MISMATCH)."""


def with_retries(call: EmbedBatch, texts: list[str], wait: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """call(texts), again after 2, 4, 8 ... seconds on ConnectionError; an error's retry_after says otherwise."""
    delay = FIRST_WAIT
    for attempt in range(RETRIES + 1):
        try:
            out = call(texts)
            break
        except ConnectionError as e:
            if attempt == RETRIES:
                raise
            wait(min(getattr(e, "retry_after", delay), MOST_WAIT))
            delay *= 2
    if len(out) != len(texts):
        raise CountMismatch(f"{len(out)} vectors for {len(texts)} texts")
    return out


def embed(pieces: DataFrame, call: EmbedBatch, text: str = "text", batch: int = BATCH) -> DataFrame:
    """pieces with embedding; at most batch texts a call, in order."""
    schema = T.StructType([*pieces.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            texts = rows[text].fillna("").tolist()
            vectors = [v for k in range(0, len(texts), batch) for v in with_retries(call, texts[k : k + batch])]
            yield rows.assign(embedding=vectors)

    return pieces.mapInPandas(run, schema)


def stand_in(dims: int = 64) -> EmbedBatch:
    """A deterministic unit vector for each text, seeded by its hash."""

    def call(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little")).normal(size=dims)
            out.append([float(x) for x in v / np.linalg.norm(v)])
        return out

    return call


def to_bytes(vector: list[float]) -> bytes:
    return struct.pack(f"<{len(vector)}f", *vector)


def from_bytes(blob: bytes) -> list[float]:
    if len(blob) % 4:
        raise ValueError("a vector's bytes come in fours")
    return list(struct.unpack(f"<{len(blob) // 4}f", blob))


@arrow_udf(T.BinaryType())
def packed(vector: pa.Array) -> pa.Array:
    """Vectors as little-endian 32-bit floats: a batch's numbers are its bytes already, only cut elsewhere."""
    sizes = np.nan_to_num(pc.list_value_length(vector).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    data = np.ascontiguousarray(vector.flatten().to_numpy(zero_copy_only=False), "<f4")
    cuts = np.concatenate([[0], np.cumsum(4 * sizes)]).astype(np.int64)
    out = pa.Array.from_buffers(pa.large_binary(), len(vector), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    return pc.if_else(vector.is_valid(), out, pa.scalar(None, pa.large_binary())).cast(pa.binary())


@arrow_udf(T.ArrayType(T.FloatType()))
def unpacked(blob: pa.Array) -> pa.Array:
    """The vectors of such bytes; null where their number is no multiple of four."""
    size = pc.fill_null(pc.binary_length(blob), 1)
    good = np.asarray(size.to_numpy(zero_copy_only=False) % 4 == 0)
    kept = blob.filter(pa.array(good))
    sizes = pc.binary_length(kept).to_numpy(zero_copy_only=False) // 4
    data = np.frombuffer(b"".join(kept.to_pylist()), "<f4")
    cuts = np.zeros(len(blob) + 1, np.int32)
    cuts[1:][good] = sizes
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(cuts, dtype=np.int32)), pa.array(data))
    return pc.if_else(pa.array(good), lists, pa.scalar(None, lists.type))


def thumbnail_name(path: Column) -> Column:
    """The file name of a path's thumbnail: 16 hexadecimal digits of its hash."""
    return F.concat(F.substring(F.sha2(path.cast("binary"), 256), 1, 16), F.lit(".jpg"))
