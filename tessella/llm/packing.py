"""Best-fit packing of tokenized documents into sequences, in hierarchical rounds.

Each partition tokenizes its documents, cuts longer ones and packs its pieces best-fit decreasing. Nearly full bins are
final. Underfull bins are the items of the next round: nodes of bounded size pack them best-fit again, and the nodes
grow fewer round by round, as a tree, until one is left or a round brings no more.

Bounds: a local packing holds at most BLOCK pieces, a node about NODE bins, a bin at most limit items.

Defined results: a null text is an empty one, whose only id is the end mark; only documents longer than the limit are cut;
repeated rows are packed each; an empty table gives an empty result. Columns other than those named are ignored, whatever their names.
A very long text is one row's work: beside its ids (4 bytes each) it needs its distinct words. Sequence ids are arbitrary but distinct; a sequence's offsets have no gaps.
"""

from __future__ import annotations

import functools
import math
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.common import checkpoint, slices, table

LIMIT, END = 4096, 1
#: A bin with at most so much room is final; a local packing's pieces; a node's bins.
NEARLY, BLOCK, NODE = 16, 200_000, 100_000
#: A round that leaves more than this share of its bins was the last.
GAIN = 0.9
#: Words whose ids a task remembers.
REMEMBERED = 1_000_000


@functools.lru_cache(maxsize=65_536)
def parted(c: str) -> bool:
    """Whether the tokenizer always parts letter c from a mark after it: its lower case in normal form ends in a letter, not in a sign of one's own."""
    return unicodedata.normalize("NFC", c.lower())[-1].isalpha()


class Ids:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer never joins characters across a blank, so a text's ids are those of its blank-separated parts in
    turn, and the parts recur. A text that holds a special token's opening goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        # the model's letters for bytes; a run of small Latin-1 letters needs no more than these and the merges
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model, self.letters = self.tokenizer.model, {c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100)}

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def merged(self, stem: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(stem if stem.isascii() else stem.translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def of(self, text: str) -> bytes:
        if "<|" in text:
            return self.encoded([text])[0]
        try:
            text.encode("latin-1")
            text, latin = text.lower(), True  # the tokenizer does so too; only where no table of letters can differ
        except UnicodeEncodeError:
            latin = False
        parts, known = text.replace("\n", " ").split(" "), self.known
        new = [p for p in set(parts) if p not in known]
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(parts))
            stems = [p[:-1] if p[-1:] in (".", ",") and p[:-1].isalpha() and parted(p[-2]) else p for p in new]
            rest = {x for x in ".," if x not in known}
            for s in stems:
                if s not in known:
                    if latin and s.isalpha():
                        known[s] = self.merged(s)
                    else:
                        rest.add(s)
            known.update(zip(rest, self.encoded(list(rest)), strict=True))
            for p, s in zip(new, stems, strict=True):
                if p is not s:
                    known[p] = known[s] + known[p[-1]]
        return b"".join([known[p] for p in parts])


def best_fit(sizes: list[int], limit: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: each item's bin and offset, and the bins' fills."""
    bins, offsets, fills = [0] * len(sizes), [0] * len(sizes), []
    rooms: list[list[int]] = [[] for _ in range(limit + 1)]
    mask = 0  # bit r is set if some bin has room r
    for i in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist():
        size = sizes[i]
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            k, room = len(fills), limit
            fills.append(0)
        bins[i], offsets[i] = k, fills[k]
        fills[k] += size
        if room > size:
            rooms[room - size].append(k)
            mask |= 1 << (room - size)
    return bins, offsets, fills


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents' pieces, packed within their partitions; ids (array<int>) on request."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType.fromDDL(PIECES + ", ids array<int>" * keep_ids)
    arrow = to_arrow_schema(schema)
    mark = np.asarray([end], "<u4").tobytes()

    def packed(rows: list[tuple], first: int) -> tuple[Iterator[pa.RecordBatch], int]:
        bins, offsets, fills = best_fit([r[3] for r in rows], limit)
        columns = [list(x) for x in zip(*rows, strict=True)]
        columns[5:5] = [[first + b for b in bins], offsets, [fills[b] for b in bins]]
        whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        return (whole.slice(k, 20_000) for k in range(0, len(rows), 20_000)), first + len(fills)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the words are remembered for one task: workers live on, and would hold them beside what runs next
        ids, rows, first = Ids(path), [], TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = ids.of(x) + mark
                for k, at in enumerate(range(0, len(raw), 4 * limit)):
                    part = raw[at : at + 4 * limit]
                    rows.append((d, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if keep_ids else [])))
                if len(rows) >= BLOCK:
                    out, first = packed(rows, first)
                    rows = []
                    yield from out
        if rows:
            yield from packed(rows, first)[0]

    return base.mapInArrow(run, schema)


def merge_round(bins: DataFrame, nodes: int, limit: int) -> DataFrame:
    """(bin, fill) packed within nodes: (bin, parent, shift, fill of the parent, top: whether bin is its parent)."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin", ignore_index=True)
        to, shift, fills = best_fit(rows["fill"].tolist(), limit)
        first: dict[int, int] = {}
        for b, k, o in zip(rows["bin"].tolist(), to, shift, strict=True):
            if o == 0:
                first[k] = b
        return pd.DataFrame({"bin": rows["bin"], "parent": [first[k] for k in to], "shift": shift, "fill": [fills[k] for k in to]})

    out = bins.groupBy(F.pmod(F.xxhash64("bin"), F.lit(nodes)).alias("node")).applyInPandas(f, "bin long, parent long, shift long, fill long")
    return out.withColumn("top", F.col("bin") == F.col("parent"))


def pack(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])."""
    out = checkpoint(pieces(docs, path, limit, end, keep_ids, doc_id, text))
    open_ = lambda df: df.filter(F.col("fill") < limit - min(NEARLY, limit // 64))
    residue = open_(out.filter(F.col("offset") == 0)).select("bin", "fill")
    n = residue.count()
    while n > 1:
        nodes = math.ceil(n / NODE)
        merged = checkpoint(merge_round(residue, nodes, limit))
        moved = merged.filter(~F.col("top")).select(F.col("bin").alias("__bin"), "parent", "shift")
        x = out.join(moved, F.col("bin") == F.col("__bin"), "left")
        out = x.withColumns({"bin": F.coalesce("parent", "bin"), "offset": F.col("offset") + F.coalesce("shift", F.lit(0))}).drop("__bin", "parent", "shift")
        residue = open_(merged.filter("top")).select("bin", "fill")
        before, n = n, residue.count()
        if nodes == 1 or n > GAIN * before:
            break
    return out.withColumnRenamed("bin", "sequence_id").drop("fill")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths) of a packing with ids; a sequence holds at most limit ids."""
    own = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(own.alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents packed into sequences of at most LIMIT ids; a null text is its end mark alone."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
