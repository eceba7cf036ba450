"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation, components.

1. Texts with equal shingle sets are one class; later steps see one row a class, so exact copies cost nothing.
2. Each class's signature is cut into BANDS bands of ROWS minima; classes that share a band are candidates.
   A pair of similarity 0.8 shares no band with probability (1 - 0.8^ROWS)^BANDS < 3e-9.
3. Candidates are compared signature batch by batch. With a uniform prior on the similarity, a pair is pruned once the
   posterior probability of reaching the threshold is under MISS. Survivors are confirmed on full shingle sets.
4. Links make components. A band's members are not paired with each other: first each class meets the member it shares
   most bands with among the bands' hubs, then all its hubs outside its component, and only then what is left between
   different components of a band. Pairs that earlier links already connect can't change a component and are left out;
   no pair that could is.
   Before that last step, the shingles of the classes left are counted: one that no other of them has can't be common
   to a pair, which bounds the similarity of any pair from its two counts and rules most out, exactly, without meeting.
   In bands of more than SMALL members the last step compares signatures block by block: first to find each member's
   best match, then, where components are still apart, all, each pair in the first band that it shares. Members of the hub's
   component meet the others only, not each other. Survivors whose
   shingle hashes fall short are dropped there, so that few pairs ever leave a block. A block is bounded in rows and bytes.

Components come from label propagation with pointer jumping; every round is checkpointed, nothing but counts reaches the
driver.

Defined results: a text of fewer words than a shingle is one shingle of all its words; null texts and texts without words
have an empty set, link with nothing and are their own component; repeated rows and rows of equal texts share a
component; a null doc_id is no candidate for the smallest, and such a row is not kept; an empty table gives an empty
result; very long texts are compared whole. Columns other than those named, also of clashing names, are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint, map_columns, table

WIDTH, PERCENT = 4, 80
BANDS, ROWS = 50, 5
#: Signature bytes compared at a time, and the chosen miss probability.
BATCH, MISS = 50, 1e-7
#: Members up to which a band's remaining pairs are listed; beyond it, blocks of so many members, or of so many bytes
#: of hashes, are compared.
SMALL, CHUNK, CHUNK_BYTES = 48, 384, 8 << 20
#: Bytes of counts of large bands, and of ids of components of LARGE classes or more, that are broadcast.
BROADCAST, LARGE = 8 << 20, 256
#: Share of the driver's heap in use beyond which a step collects garbage.
HEAP = 0.3
#: Rounds of labels between steps, where they only save pairs that are connected already.
ROUNDS = 2
#: Partitions of pairs and labels: so many rows each, and so many at least.
PARTITION_ROWS, LEAST_PARTITIONS = 20_000, 8

_H = BANDS * ROWS
_rng = np.random.Generator(np.random.Philox(key=[20, 24]))
_XOR = _rng.integers(0, 1 << 32, _H, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 31, _H, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_WORD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def settled(df: DataFrame) -> DataFrame:
    """df, checkpointed. Frames that Python still holds pin their plans in the driver's heap, so they are let go; where the heap
    is well used all the same, the driver collects garbage."""
    out = checkpoint(df)
    gc.collect()
    jvm = df.sparkSession.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > HEAP * heap.maxMemory():
        jvm.System.gc()
    return out


def released(df: DataFrame) -> DataFrame:
    """df, checkpointed. Spark deletes the shuffles of finished steps when the driver collects garbage, so it does."""
    out = settled(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def gathered(df: DataFrame, documents: int) -> DataFrame:
    """df, of fewer rows than documents or hardly more, in no more partitions than those rows are worth."""
    return df.coalesce(max(LEAST_PARTITIONS, documents // PARTITION_ROWS))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased: bytes split at, and are lower-cased in, exactly the ASCII characters meant."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, in no order; their number is exact."""
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    n = len(words) - width + 1
    bits = max(1, (len(number) - 1).bit_length())
    if bits * width <= 64:
        code = np.zeros(n, np.uint64)
        for k in range(width):
            code = (code << np.uint64(bits)) | ids[k : k + n]
    else:  # renumber the distinct prefixes step by step
        code = ids[:n]
        for k in range(1, width):
            code = np.unique(code * np.uint64(len(number)) + ids[k : k + n], return_inverse=True)[1].astype(np.uint64)
    first = np.unique(code, return_index=True)[1]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))[ids.astype(np.int64)]
    total = np.full(len(first), width, np.uint64)
    for k in range(width):
        total = _mix(total + hashes[first + k] * _WORD[k % len(_WORD)])
    return total


def signature(hashes: np.ndarray) -> np.ndarray:
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(_H, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):  # in pieces that stay in the cache
        part = low[at : at + 1024]
        np.minimum(out, ((part[None, :] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1), out=out)
    return out


def bytes_of(minima: np.ndarray) -> bytes:
    """A byte of another hash of each minimum: the least of many hashes is small, so that its own upper bytes agree by chance."""
    x = (minima ^ (minima >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return (x >> np.uint32(24)).astype(np.uint8).tobytes()


def signed(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, class, signature, bands); class and what follows are null for empty sets."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("t"))

    def f(cols):
        out = {"n_shingles": [], "class": [], "signature": [], "bands": []}
        for x in cols.pop("t"):
            s = shingles(words_of(x), width)
            out["n_shingles"].append(len(s))
            if not len(s):
                for name in ("class", "signature", "bands"):
                    out[name].append(None)
                continue
            sig = signature(s)
            out["class"].append(hashlib.blake2b(np.sort(s).tobytes(), digest_size=16).digest())
            out["signature"].append(bytes_of(sig))
            rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
            key = np.arange(BANDS, dtype=np.uint64)
            for k in range(ROWS):
                key = _mix(key + rows[:, k] * _WORD[k % len(_WORD)])
            out["bands"].append(key.view(np.int64).tolist())
        return cols | out

    return map_columns(base, lambda: f, "doc_id long, text_hash long, n_shingles long, class binary, signature binary, bands array<long>")


@lru_cache(maxsize=8)
def least_matches(percent: int, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(compared, matches): with fewer matches, the posterior probability of the threshold is under miss.

    A signature byte matches by chance in 1 of 256 cases. With a uniform prior, the posterior after m matches of n is
    Beta(m + 1, n - m + 1), whose upper tail at p is the chance of at most m successes in n + 1 trials.
    """
    p = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in [*range(BATCH, _H + 1, BATCH)]:
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append((n, m))
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the row pairs of two signature matrices that no batch prunes, and their matches."""
    alive, seen, matches = np.arange(len(a)), 0, np.zeros(len(a), np.int32)
    for n, least in least_matches(percent):
        matches = matches + (a[alive, seen:n] == b[alive, seen:n]).sum(axis=1)
        keep = matches >= least
        alive, matches, seen = alive[keep], matches[keep], n
        if not len(alive):
            break
    return alive, matches


def _matrix(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, _H)


def screened(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that the sequential test leaves."""
    sig = classes.select("class", "signature")
    x = pairs.join(sig.withColumnsRenamed({"class": "a", "signature": "sa"}), "a").join(sig.withColumnsRenamed({"class": "b", "signature": "sb"}), "b").select("a", "b", "sa", "sb")

    def f(cols):
        keep, _ = surviving(_matrix(cols["sa"]), _matrix(cols["sb"]), percent)
        return {"a": [cols["a"][i] for i in keep], "b": [cols["b"][i] for i in keep]}

    return map_columns(x, lambda: f, "a binary, b binary")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    x = pairs.join(texts.withColumnsRenamed({"class": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"class": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb")

    def make():
        @lru_cache(maxsize=64)
        def full(text: str) -> frozenset:
            w = words_of(text)
            k = min(width, len(w))
            return frozenset(zip(*[w[i:] for i in range(k)], strict=False))

        def linked(ta: str, tb: str) -> bool:
            a, b = full(ta), full(tb)
            both = len(a & b)
            return 100 * both >= percent * (len(a) + len(b) - both)

        def f(cols):
            keep = [i for i, (ta, tb) in enumerate(zip(cols["ta"], cols["tb"], strict=True)) if linked(ta, tb)]
            return {"a": [cols["a"][i] for i in keep], "b": [cols["b"][i] for i in keep]}

        return f

    return map_columns(x, make, "a binary, b binary")


def components(edges: DataFrame, documents: int = 1 << 40, rounds: int | None = None) -> DataFrame:
    """(node, label) of every node of the edges (a, b): its component's least node. documents bounds partitions.

    Each round takes the least label among a node and its neighbours, then that label's own label; rounds grow with
    the logarithm of a component's diameter. After a given number of rounds, labels are some node of the component.
    """
    both = settled(gathered(edges.select("a", "b").union(edges.select("b", "a")).distinct(), documents))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label"))
    labels = settled(gathered(labels, documents))
    done = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("next"))
        new = step.join(jump, "new", "left").select("node", "label", F.least("new", F.coalesce("next", "new")).alias("new"))
        new = settled(gathered(new, documents))
        labels, done = new.select("node", F.col("new").alias("label")), done + 1
        if done == rounds or new.filter(F.col("label") != F.col("new")).isEmpty():
            return labels


def _pairs(x: DataFrame, a: str, b: str) -> DataFrame:
    return x.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def links(docs: DataFrame, classes: DataFrame, width: int, percent: int, documents: int) -> DataFrame:
    """(node, label) of the classes that have a link; classes are (class, place, signature, bands) of so many documents."""
    spark = docs.sparkSession
    # bands with two members or more, and their members
    member = classes.select(F.explode("bands").alias("band"), F.col("class").alias("m"))
    hubs = member.groupBy("band").agg(F.min("m").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    shared = released(member.join(hubs, "band"))
    del member, hubs
    classes = released(classes.join(shared.select(F.col("m").alias("class")).distinct(), "class", "left_semi"))
    places = classes.select("class", F.col("place.doc_id").alias("d"), F.col("place.text_hash").alias("h"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).withColumn("text_hash", F.xxhash64("text"))
    texts = places.join(source, places["d"].eqNullSafe(source["doc_id"]) & (places["h"] == source["text_hash"])).select("class", "text")
    texts = released(texts.dropDuplicates(["class"]))
    del places, source

    met = spark.createDataFrame([], "a binary, b binary")
    edges, labels = met, spark.createDataFrame([], "node binary, label binary")

    def verified(pairs: DataFrame, screen: bool = True) -> DataFrame:
        return released(confirmed(screened(pairs, classes, percent) if screen else pairs, texts, width, percent))

    def labelled(x: DataFrame, column: str, name: str) -> DataFrame:
        l = labels.withColumnsRenamed({"node": column, "label": f"__{name}"})
        return x.join(l, column, "left").withColumn(name, F.coalesce(f"__{name}", column)).drop(f"__{name}")

    # each class and the hub that it shares most bands with
    counted = shared.filter("m != hub").groupBy("m", "hub").agg(F.count("*").alias("times"))
    first = settled(gathered(_pairs(counted.groupBy("m").agg(F.max(F.struct("times", "hub")).alias("x")).select("m", "x.hub"), "m", "hub"), documents))
    edges, met = verified(first), first
    labels = components(edges, documents, ROUNDS)

    # each class and its bands' hubs in other components
    apart = labelled(labelled(shared, "m", "lm"), "hub", "lh")
    second = settled(gathered(_pairs(apart.filter("lm != lh"), "m", "hub").join(met, ["a", "b"], "left_anti"), documents))
    edges, met = edges.union(verified(second)), met.union(second)
    labels = components(edges, documents, ROUNDS)

    # what is left between components of a band, other than with its hub
    apart = labelled(shared, "m", "lm").select("band", "hub", "n", "m", "lm")
    mixed = apart.groupBy("band").agg(F.min("lm").alias("x"), F.max("lm").alias("y")).filter("x != y").select("band")
    apart = settled(apart.join(mixed, "band", "left_semi").filter("m != hub"))
    common = released(_common(apart.select("m").distinct(), texts, width))
    apart = apart.join(common.filter(F.lit(100) * F.col("common") >= percent * F.col("size")).drop("hashes"), "m")
    few = apart.filter(F.col("n") <= SMALL).select("band", "m", "lm", "size", "common")
    other = few.withColumnsRenamed({c: f"{c}2" for c in few.columns if c != "band"})
    most = F.least("common", "common2")
    possible = F.lit(100) * most >= percent * (F.col("size") + F.col("size2") - most)
    third = _pairs(few.join(other, "band").filter("m < m2 and lm != lm2").filter(possible), "m", "m2").join(met, ["a", "b"], "left_anti")
    edges, met = edges.union(verified(third)), met.union(third)
    # in large bands, first each class with what matches it best, so that few are left for the rest
    many = settled(labelled(apart.filter(F.col("n") > SMALL), "hub", "lh").withColumn("base", F.col("lm") == F.col("lh")).select("band", "hub", "m", "lm", "size", "common", "base"))
    if many.isEmpty():
        return components(edges, documents)
    best = _between_blocks(many, classes, percent, best=True).groupBy("m").agg(F.max(F.struct("matches", "other")).alias("x"))
    fourth = settled(gathered(_pairs(best.select("m", "x.other"), "m", "other").join(met, ["a", "b"], "left_anti"), documents))
    edges, met = edges.union(verified(fourth, screen=False)), met.union(fourth)
    labels = components(edges, documents, ROUNDS)
    many = labelled(labelled(many.drop("lm", "base"), "m", "lm"), "hub", "lh").withColumn("base", F.col("lm") == F.col("lh")).drop("hub", "lh")
    rest = _between_blocks(settled(many.join(common.select("m", "hashes"), "m")), classes, percent).select(F.col("m").alias("a"), F.col("other").alias("b")).join(met, ["a", "b"], "left_anti")
    return components(edges.union(verified(settled(rest), screen=False)), documents)


def _common(members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(m, size, common, hashes): the shingles of each member, how many of them another member has too, and their hashes
    cut to 32 bits."""
    x = members.join(texts.withColumnRenamed("class", "m"), "m")

    def f(cols):
        out = {"m": [], "shingle": []}
        for m, t in zip(cols["m"], cols["text"], strict=True):
            s = shingles(words_of(t), width).view(np.int64).tolist()
            out["m"] += [m] * len(s)
            out["shingle"] += s
        return out

    each = map_columns(x, lambda: f, "m binary, shingle long")
    # all shingles count with their holder only if it is the only one
    alone = each.groupBy("shingle").agg(F.min("m").alias("m"), F.count("*").alias("holders")).filter("holders = 1").groupBy("m").agg(F.count("*").alias("alone"))

    def g(cols):
        sets = [shingles(words_of(t), width) for t in cols["text"]]
        return {"m": cols["m"], "size": [len(s) for s in sets], "hashes": [(s >> np.uint64(32)).astype("<u4").tobytes() for s in sets]}

    size = map_columns(x, lambda: g, "m binary, size long, hashes binary")
    return size.join(alone, "m", "left").select("m", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"), "hashes")


def _between_blocks(members: DataFrame, classes: DataFrame, percent: int, best: bool = False) -> DataFrame:
    """Surviving pairs (m, other, matches) between components of large bands; members are (band, m, lm, size, common, base).

    For each member of a pair of blocks its best match there; or all of them, m the lesser, once each, whose shingles'
    hashes reach the threshold: cut hashes can only add to what is common, so no link is lost.
    base tells the members of one component (the hub's): they meet blocks of the others, which also meet among themselves.
    """
    weight = F.lit(0) if best else F.octet_length("hashes")
    blocks = lambda of: F.greatest(F.ceil(F.count(F.when(of, 1)) / CHUNK), F.ceil(F.coalesce(F.sum(F.when(of, weight)), F.lit(0)) / CHUNK_BYTES)).cast("int")
    counts = settled(members.groupBy("band").agg(blocks(F.col("base")).alias("bases"), blocks(~F.col("base")).alias("others")).filter("others > 0").withColumnRenamed("band", "__band"))
    counts = F.broadcast(counts) if 32 * counts.count() <= BROADCAST else counts
    x = members.join(counts, F.col("band") == F.col("__band")).drop("__band")
    x = x.join(classes.select(F.col("class").alias("m"), "signature", "bands"), "m")
    x = x.withColumn("block", F.pmod(F.xxhash64("m"), F.when(F.col("base"), F.col("bases")).otherwise(F.col("others"))).cast("int"))
    # a block of others meets itself and every other once, as the first of the two or as the second, and each block of the base
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    block = F.col("block")
    own = F.transform(upto("others"), lambda k: cell("others", F.least(block, k), F.greatest(block, k)))
    meets = F.when(F.col("base"), F.transform(upto("others"), lambda k: cell("base", k, block))).otherwise(F.concat(own, F.transform(upto("bases"), lambda k: cell("base", block, k))))
    x = x.withColumn("p", F.explode(meets)).select("band", "p.kind", "p.i", "p.j", "block", "base", "m", "lm", "size", "common", "signature", "bands", *([] if best else ["hashes"]))

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        kind, i, j, band = (rows[c].iloc[0] for c in ("kind", "i", "j", "band"))
        left, right = rows[(rows["block"] == i) & ~rows["base"]], rows[(rows["block"] == j) & (rows["base"] == (kind == "base"))]
        same = kind == "others" and i == j
        sl, sr = _matrix(left["signature"].tolist()), _matrix(right["signature"].tolist())
        bl, br = np.array(left["bands"].tolist(), np.int64).reshape(-1, BANDS), np.array(right["bands"].tolist(), np.int64).reshape(-1, BANDS)
        ml, mr, cl, cr = left["m"].tolist(), right["m"].tolist(), left["lm"].tolist(), np.array(right["lm"].tolist(), dtype=object)
        nl, nr, ul, ur = left["size"].tolist(), right["size"].to_numpy(), left["common"].tolist(), right["common"].to_numpy()
        hl, hr = ([] if best else [np.frombuffer(h, "<u4") for h in side["hashes"]] for side in (left, right))
        out: list[tuple[bytes, bytes, int]] = []
        of_right: dict[int, tuple[int, int]] = {}
        for k in range(len(ml)):
            most = np.minimum(ul[k], ur)
            rest = np.flatnonzero((100 * most >= percent * (nl[k] + nr - most)) & (cr != cl[k]))
            if same:
                rest = rest[rest > k]
            at = int(np.flatnonzero(bl[k] == band)[0])
            if len(rest) and at and not best:
                rest = rest[~(br[rest, :at] == bl[k, :at]).any(axis=1)]
            if not len(rest):
                continue
            alive, matches = surviving(np.broadcast_to(sl[k], (len(rest), _H)), sr[rest], percent)
            rest = rest[alive]
            if not best and len(rest):
                own = np.sort(hl[k])
                joint = np.concatenate([hr[q] for q in rest])
                found = own[np.minimum(np.searchsorted(own, joint), len(own) - 1)] == joint
                both = np.minimum(np.add.reduceat(found, np.r_[0, np.cumsum([len(hr[q]) for q in rest])[:-1]], dtype=np.int64), nl[k])
                good = 100 * both >= percent * (nl[k] + nr[rest] - both)
                rest, matches = rest[good], matches[good]
            if not best:
                out += [(min(ml[k], mr[q]), max(ml[k], mr[q]), int(n)) for q, n in zip(rest, matches, strict=True)]
            elif len(rest):
                top = int(matches.argmax())
                out.append((ml[k], mr[rest[top]], int(matches[top])))
                for q, n in zip(rest.tolist(), matches.tolist(), strict=True):
                    if n > of_right.get(q, (0, 0))[0]:
                        of_right[q] = n, k
        out += [(mr[q], ml[k], n) for q, (n, k) in of_right.items()]
        return pd.DataFrame({"m": [a for a, *_ in out], "other": [b for _, b, _ in out], "matches": [n for *_, n in out]}).astype({"m": object, "other": object, "matches": "int32"})

    return x.groupBy("band", "kind", "i", "j").applyInPandas(f, "m binary, other binary, matches int")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, component_id, kept) of every row of docs (doc_id, text).

    component is the least class of a component, null for an empty set.
    """
    heavy = settled(signed(docs, width))
    own = settled(heavy.select("doc_id", "text_hash", "n_shingles", "class"))
    members = heavy.filter(F.col("class").isNotNull())
    # the row with the smallest doc_id stands for the class; null only where all are
    place = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash")))
    spare = F.min(F.struct("doc_id", "text_hash"))
    full = settled(members.groupBy("class").agg(F.coalesce(place, spare).alias("place"), F.min("signature").alias("signature"), F.min("bands").alias("bands")))
    del heavy, members
    classes = released(full.select("class", "place.doc_id"))
    steps = [full]
    del full
    labels = links(docs, steps.pop(), width, percent, own.count())
    joined = settled(classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class")))
    least = settled(joined.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")))
    ids = _with_least(joined, least).select("class", F.col("label").alias("component"), "component_id")
    out = own.select("doc_id", "text_hash", "n_shingles", "class").join(ids, "class", "left")
    own_id = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.withColumn("component_id", own_id)
    return out.select("doc_id", "text_hash", "n_shingles", "component", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _with_least(joined: DataFrame, least: DataFrame) -> DataFrame:
    """joined (label, ...) with its label's component_id. Large components' rows don't meet by their label: their ids are broadcast."""
    large = least.filter(F.col("n") >= LARGE).drop("n")
    if not 0 < 64 * large.count() <= BROADCAST:
        return joined.join(least.drop("n"), "label")
    large = F.broadcast(large)
    others = joined.join(large.select("label"), "label", "left_anti").join(least.filter(F.col("n") < LARGE).drop("n"), "label")
    return joined.join(large, "label").unionByName(others)


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: of the smallest doc_id, null after all others. Empty texts all stay."""
    found = near_duplicates(docs, width, percent)
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"))
    one = found.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(place).alias("x")).select("x.__d", "x.__h")
    own = {c: f"__near{k}" for k, c in enumerate(docs.columns)}
    x = docs.toDF(*own.values()).withColumn("__t", F.xxhash64(own["text"]))
    has_words = F.coalesce(F.col(own["text"]).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    chosen = x.filter(has_words).join(one, (F.col("__t") == F.col("__h")) & F.col(own["doc_id"]).cast("long").eqNullSafe(F.col("__d")), "left_semi")
    back = [F.col(v).alias(k) for k, v in own.items()]
    return chosen.dropDuplicates(["__t", own["doc_id"]]).select(*back).unionByName(x.filter(~has_words).select(*back))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every row of documents; null and empty texts are alone, repeated rows share one, null ids aren't kept."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
