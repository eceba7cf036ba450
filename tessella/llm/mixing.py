"""Mixing sources to target weights.

Each source's words, document after document, are packed into blocks of BLOCK words (its last one may be shorter). The
mix is a run of slots, dealt to output shards of equal size; each slot holds one block of one source.

* A shard's source counts are a multinomial draw, conditioned on all shards together giving every source exactly its
  slots. The draw splits the slots of a range of shards between its halves (multivariate hypergeometric), down to the
  shard, so that any task finds its own shard's counts and slot numbers without seeing others.
* A source's slot k reads block P(k mod n) of its n blocks, P being a pseudorandom permutation of the indices (a Feistel
  network with cycle walking) of its own for each source and pass; no order is stored or shuffled. A pass ends before
  the next begins, so no block is read more than once above another.
* Blocks and slots meet in a join on (source, block index).

The driver holds one number pair a source, never documents, blocks or slots.

Defined results: null or empty texts have size 0 and are never taken; null is a source of its own, after all others;
repeated rows are documents of their own; very long texts are cut into blocks like all others; an empty table gives an empty mix. The same table and seed give the same mix.
Columns other than those named, also of clashing names, are ignored (mixed_documents keeps them).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, checkpoint, map_columns, n_words, table

#: Words of a block, slots of an output shard, the weights that sources in order repeat, and the most passes.
BLOCK, SHARD, WEIGHTS, PASSES = 128, 8192, (3.0, 1.0, 2.0), 2.0


def targets(sizes: dict[str | None, int], share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, passes: float = PASSES) -> dict[str | None, float]:
    """Words wanted of each source: share of all sizes by weight, none above passes times its source's size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > passes * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: passes * sizes[s] for s in over}
        left -= sum(passes * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return {s: out[s] for s in order}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A pseudorandom permutation of range(n), by name: at(k) and its inverse, on arrays, without storing it."""

    def __init__(self, n: int, name: str):
        self.n, self.half = n, np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.frombuffer(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=32).digest(), np.uint64)

    def _walk(self, k, step) -> np.ndarray:
        x = step(np.atleast_1d(np.asarray(k)).astype(np.uint64))
        while (out := np.flatnonzero(x >= np.uint64(self.n))).size:
            x[out] = step(x[out])
        return x.astype(np.int64)

    def _there(self, x):
        a, b = x >> self.half, x & self.mask
        for key in self.keys:
            a, b = b, a ^ (_mixed(b ^ key) & self.mask)
        return (a << self.half) | b

    def _back(self, x):
        a, b = x >> self.half, x & self.mask
        for key in self.keys[::-1]:
            a, b = b ^ (_mixed(a ^ key) & self.mask), a
        return (a << self.half) | b

    def at(self, k) -> np.ndarray:
        return self._walk(k, self._there)

    def where(self, x) -> np.ndarray:
        return self._walk(x, self._back)


@dataclass(frozen=True)
class Source:
    """slots: how many the source gets; the last one is cut to last words (0: not cut)."""

    key: str
    size: int
    target: float
    blocks: int
    slots: int
    last: int


def source(key: str, size: int, target: float, block: int, seed: int) -> Source:
    wanted, n = int(target), -(-size // block)
    if not size or not wanted:
        return Source(key, size, target, n, 0, 0)
    whole, rest = divmod(wanted, size)
    if not rest:
        return Source(key, size, target, n, whole * n, 0)
    short = block - (size - (n - 1) * block)  # what the last block lacks
    at = int(Permutation(n, f"{seed}/{whole}/{key}").where(n - 1)[0])
    words = lambda m: m * block - (short if at < m else 0)
    m = -(-rest // block)
    m += words(m) < rest
    own = words(m) - words(m - 1)
    cut = own - (words(m) - rest)
    return Source(key, size, target, n, whole * n + m, cut if cut < own else 0)


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many good ones are among n drawn without replacement, of any size: rejection by the ratio of uniforms.

    The hat is that of a table mountain about the mean; with log-gamma values the acceptance follows the true probabilities.
    """
    total = good + bad
    if good > bad:  # the rarer kind is drawn
        return n - hypergeometric(bad, good, n, rng)
    if 2 * n > total:  # and the smaller part
        return good - hypergeometric(good, bad, total - n, rng)
    if n < 10:
        left, out = good, 0
        for k in range(n):
            hit = rng.integers(total - k) < left
            out, left = out + int(hit), left - int(hit)
        return out
    p = good / total
    mean, deviation = n * p + 0.5, math.sqrt((total - n) / (total - 1) * n * p * (1 - p) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * deviation + 3 - 2 * math.sqrt(3 / math.e)
    mode = (n + 1) * (good + 1) // (total + 2)
    log = lambda x: math.lgamma(x + 1) + math.lgamma(good - x + 1) + math.lgamma(n - x + 1) + math.lgamma(bad - n + x + 1)
    highest = log(mode)
    while True:
        u, v = rng.random(), rng.random()
        x = math.floor(mean + width * (v - 0.5) / u) if u else -1
        if 0 <= x <= min(n, good) and 2 * math.log(u) <= highest - log(x):
            return x


def _split(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each colour are among n drawn without replacement."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        if not n:
            break
        rest -= c
        least, most = max(0, n - rest), min(c, n)
        if least == most:
            x = least
        else:
            x = hypergeometric(c, rest, n, rng)
        out[i] = x = min(max(x, least), most)
        n -= x
    return out


def shard_draw(slots: np.ndarray, shard: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's counts by source, and the number of the first slot it takes of each."""
    total = int(slots.sum())
    lo, hi = 0, -(-total // size)
    counts, first = slots.copy(), np.zeros_like(slots)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, lo], counter=[hi, 0, 0, 0]))
        left = _split(counts, mid * size - lo * size, rng)
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, counts, first = mid, counts - left, first + left
    return counts, first


def slots(spark: SparkSession, sources: list[Source], block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """(shard, place, key, pass, block, words): every slot of the mix; words is its block's length at most."""
    wanted = np.array([s.slots for s in sources], np.int64)
    n = -(-int(wanted.sum()) // shard)
    schema = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("key", pa.string()), ("pass", pa.int64()), ("block", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                counts, first = shard_draw(wanted, i, shard, seed)
                blocks, passes, words = [], [], []
                for s, c, f in zip(sources, counts.tolist(), first.tolist(), strict=True):
                    k = np.arange(f, f + c)
                    turn = k // max(1, s.blocks)
                    own = np.zeros(c, np.int64)
                    for t in np.unique(turn):
                        here = turn == t
                        own[here] = Permutation(s.blocks, f"{seed}/{t}/{s.key}").at(k[here] % s.blocks)
                    length = np.minimum(block, s.size - own * block)
                    if s.last and f + c == s.slots and c:
                        length[-1] = s.last
                    blocks.append(own)
                    passes.append(turn)
                    words.append(length)
                order = np.random.Generator(np.random.Philox(key=[seed, i], counter=[0, 1, 0, 0])).permutation(int(counts.sum()))
                key = np.repeat(np.array([s.key for s in sources], object), counts)
                cat = lambda x: np.concatenate(x)[order]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), i)), pa.array(np.arange(len(order))), pa.array(key[order], pa.string()), pa.array(cat(passes)), pa.array(cat(blocks)), pa.array(cat(words))], schema=schema)

    return spark.range(n).mapInArrow(run, "shard long, place long, key string, pass long, block long, words long")


def placed(docs: DataFrame, keep: list[str], source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """keep's columns and each document's place: key (its source), part, number, size and hash.

    (key, part, number) names a row; a source's documents come by part, then number. Parts are 4096 ranges of hashes,
    so that a source of any size is ordered part by part.
    """
    x = docs.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)],
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("key"),
        n_words(F.col(text)).alias("size"), F.xxhash64(F.col(doc_id), F.col(text)).alias("hash"), F.xxhash64(F.col(text)).alias("__t"),
    ).withColumn("part", F.shiftright("hash", 52).cast("int"))
    by = Window.partitionBy("key", "part").orderBy("hash", "size", "__t")
    return x.withColumn("number", F.row_number().over(by)).select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "key", "part", "number", "size", "hash")


@dataclass
class Mix:
    """sources by key; documents: (doc_id, key, part, number, size, start); pieces: what slots hold of documents.

    pieces: (shard, place, pass, key, block, doc_id, part, number, from_word, to_word), the end exclusive; a slot's pieces
    are in the order of from_word's documents in their source.
    """

    sources: dict[str | None, Source]
    documents: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, passes: float = PASSES, block: int = BLOCK, shard: int = SHARD, seed: int = 0, source_: str = "source", text: str = "text", doc_id: str = "doc_id") -> Mix:
    spark = docs.sparkSession
    own = checkpoint(placed(docs.select(F.col(doc_id).alias("doc_id"), F.col(source_).alias("source"), F.col(text).alias("text")), ["doc_id"]))
    parts = own.groupBy("key", "part").agg(F.sum("size").alias("words"))
    sizes = {(r["key"][1:] if r["key"][0] == "s" else None): r["words"] for r in parts.groupBy("key").agg(F.sum("words").alias("words")).collect()}
    wanted = targets(sizes, share, weights, passes)
    keys = {s: "n" if s is None else f"s{s}" for s in wanted}
    sources = {s: source(keys[s], sizes[s], t, block, seed) for s, t in wanted.items()}
    # a part's start among its source's words: at most 4096 parts a source
    before = F.sum("words").over(Window.partitionBy("key").orderBy("part")) - F.col("words")
    starts = parts.select("key", "part", before.alias("base"))
    within = F.sum("size").over(Window.partitionBy("key", "part").orderBy("number")) - F.col("size")
    documents = own.withColumn("within", within).join(starts, ["key", "part"]).withColumn("start", F.col("base") + F.col("within")).drop("within", "base", "hash")
    b = F.lit(block)
    held = documents.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
    at = F.col("block") * b
    held = held.select("key", "block", "doc_id", "part", "number", F.greatest("start", at).alias("a"), F.least(F.col("start") + F.col("size"), at + b).alias("z"), "start")
    s = slots(spark, [x for x in sources.values() if x.slots], block, shard, seed)
    joined = s.hint("merge").join(held, ["key", "block"])
    z = F.least("z", at + F.col("words"))
    pieces = joined.select("shard", "place", "pass", "key", "block", "doc_id", "part", "number", (F.col("a") - F.col("start")).alias("from_word"), (z - F.col("start")).alias("to_word")).filter("to_word > from_word")
    return Mix(sources, documents, pieces)


def source_table(spark: SparkSession, m: Mix) -> DataFrame:
    return spark.createDataFrame([(x.key, x.size, float(x.target)) for x in m.sources.values()], "key string, source_size long, target double")


def taken(m: Mix) -> DataFrame:
    """(doc_id, key, size, taken) of every document: the words that the mix holds of it, repeats counted."""
    row = ["key", "part", "number", "doc_id"]
    none = m.documents.select(*row, "size", F.lit(0).cast("long").alias("n"))
    some = m.pieces.select(*row, F.lit(0).cast("long").alias("size"), (F.col("to_word") - F.col("from_word")).alias("n"))
    return none.unionByName(some).groupBy(*row).agg(F.sum("size").alias("size"), F.sum("n").alias("taken"))


def mixed_documents(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, passes: float = PASSES, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """What the mix holds, as documents with the columns of docs: a row for each pass that takes words of a document.

    A pass that takes all words keeps the text as it is; otherwise the taken runs, each as it stands in the
    text, are joined by a line break. n_chars, where there, follows the text.
    """
    m = mix(docs, share, weights, passes, block, seed=seed)
    runs = m.pieces.groupBy("key", "part", "number", "pass").agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("__runs"))
    names = docs.columns
    full = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(names)], F.col("source").alias("__s"), F.col("text").alias("__x"), F.col("doc_id").alias("__d"))
    whole = placed(full, [f"__c{i}" for i in range(len(names))], "__s", "__x", "__d")
    x = whole.join(runs, ["key", "part", "number"]).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)], F.col("__runs"), F.col("size").alias("__size"))

    def cut(text: str, runs: list[dict], size: int) -> str:
        joined: list[list[int]] = []
        for r in runs:
            if joined and joined[-1][1] == r["from_word"]:
                joined[-1][1] = r["to_word"]
            else:
                joined.append([r["from_word"], r["to_word"]])
        if joined == [[0, size]]:
            return text
        spans = [w.span() for w in WORD.finditer(text)]
        return "\n".join(text[spans[a][0] : spans[z - 1][1]] for a, z in joined)

    def f(cols):
        runs, size = cols.pop("__runs"), cols.pop("__size")
        cols["text"] = [cut(*r) for r in zip(cols["text"], runs, size, strict=True)]
        if "n_chars" in cols:
            cols["n_chars"] = [len(t) for t in cols["text"]]
        return cols

    return map_columns(x, lambda: f, docs.schema)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every row of documents; null and empty texts have none, null is the last source."""
    m = mix(table(spark, sf_dir, "documents"))
    return taken(m).join(source_table(spark, m), "key").select("doc_id", "size", "source_size", "target", "taken")
