"""Periodic runs of words by suffix trees, and texts with all but the first period of each run dropped.

A run is a stretch of words with smallest period q, at least max(least, 2 q) words long, that neither neighbour extends.

Any word of a run lies in a stretch of GRAM words that occurs twice in the run, so words outside such stretches are passed by and what remains falls into
segments. A segment's suffixes are sorted by doubling; common prefixes of neighbours are measured where they can't be derived from the suffix one word before.
Both together are the segment's suffix tree: an inner node is an interval of suffixes with its depth. For each node, the leaves of all children but the largest are asked
whether the suffix one depth away (to either side) is a leaf of the node too, and followed by another word: then a square of that period branches there. As a leaf
is in a smaller half at most log n times, that takes n log n steps. A run has one branching square for its period, at its end; it is rotated to the left for as long
as the words agree, and squares of a multiple of the period that the run covers are merged into it.

Defined results: a null or wordless text has no runs and an empty collapsed text; words are compared exactly; repeated rows are searched each; an empty table
gives an empty result; extra columns are kept where asked for by name. Beside a text's words, a segment takes some 300 bytes a word, and n log n time whatever
the words are; texts whose segments are short cost a hash a word.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.common import WORD, extended, slices, table, words

#: Shortest run; words that are asked to occur twice (a run of LEAST words has twice GRAM or more); comparisons at a time.
LEAST, GRAM, AT_ONCE = 12, 6, 1 << 16


def agreeing(words: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, way: int = 1) -> np.ndarray:
    """How many words agree from places a and b on, in direction way, at most room."""
    out = np.zeros(len(a), np.int64)
    for low in range(0, len(a), AT_ONCE):
        open_ = np.flatnonzero(room[low : low + AT_ONCE] > 0) + low
        while len(open_):
            left = room[open_] - out[open_]
            reach = np.arange(min(max(8, AT_ONCE // len(open_)), int(left.max())))
            step = np.minimum(reach, left[:, None] - 1) + out[open_][:, None]
            same = (words[a[open_][:, None] + way * step] == words[b[open_][:, None] + way * step]) & (reach < left[:, None])
            whole = same.all(axis=1)
            out[open_] += np.where(whole, len(reach), same.argmin(axis=1))
            open_ = open_[whole & (out[open_] < room[open_])]
    return out


def repeated_stretches(words: np.ndarray, ends: np.ndarray, gram: int) -> np.ndarray:
    """Which places lie in gram words that their segment, which stops at ends[place], holds twice (or whose hash it holds twice)."""
    n = len(words)
    if n < gram:
        return np.zeros(n, bool)
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = ends[: n - gram + 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(gram):
        h = (h ^ mixed[k : n - gram + 1 + k]) * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(32)
    fits = np.flatnonzero(np.arange(n - gram + 1) + gram <= ends[: n - gram + 1])
    own = h[fits]
    ordered = np.sort(own)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    change = np.zeros(n + 1, np.int64)
    if len(twice):
        near = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
        found = fits[twice[near] == own]
        np.add.at(change, found, 1)
        np.add.at(change, found + gram, -1)
    return np.cumsum(change[:-1]) > 0


def candidates(words: np.ndarray, ends: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that a run can hold, and how far (in these) their segment goes. No run goes over the end of a segment."""
    places = np.arange(len(words))
    while True:
        keep = repeated_stretches(words[places], ends, gram)
        # a segment is what stays in a row, of one text; shorter ones hold no run
        cut = np.flatnonzero(keep)
        fresh = np.ones(len(cut), bool)
        fresh[1:] = (np.diff(cut) > 1) | (ends[cut[1:]] != ends[cut[:-1]])
        first = np.flatnonzero(fresh)
        sizes = np.diff(first, append=len(cut))
        stay = np.repeat(sizes >= least, sizes)
        sizes = sizes[sizes >= least]
        before, places = len(places), places[cut[stay]]
        ends = np.repeat(np.cumsum(sizes), sizes)
        if len(places) in (0, before):
            return places, ends


def suffix_order(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, segment by segment, and the place of each in that order; a suffix stops where its segment does."""
    n = len(words)
    order = np.lexsort((words, ends))
    key = np.ones(n, bool)
    key[1:] = (words[order[1:]] != words[order[:-1]]) | (ends[order[1:]] != ends[order[:-1]])
    at = np.maximum.accumulate(np.where(key, np.arange(n), 0))  # the first of those that are equal so far
    rank = np.empty(n, np.int64)
    rank[order] = at
    shared = np.concatenate([at[1:] == at[:-1], [False]])
    shared[1:] |= shared[:-1]
    open_, h = order[shared], 1
    while len(open_):
        follow = open_ + h
        inside = follow < ends[open_]
        key = rank[open_] * (n + 1) + np.where(inside, rank[np.minimum(follow, n - 1)] + 1, 0)
        turn = np.argsort(key, kind="stable")
        open_, key = open_[turn], key[turn]
        old = rank[open_]
        k = np.arange(len(open_))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), k, 0))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), k, 0))
        rank[open_] = old + first - group
        shared = np.concatenate([first[1:] == first[:-1], [False]])
        shared[1:] |= shared[:-1]
        open_, h = open_[shared], 2 * h
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, rank


def common_prefixes(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each suffix in order, the words it shares with the one before it; 0 at the first of a segment.

    Where the words before a suffix and before its neighbour are equal, the value is one less than that of the suffix one word earlier. The others are
    measured: their sum is of the order n log n (Karkkainen, Manzini, Puglisi 2009).
    """
    n = len(words)
    near = order[np.maximum(rank - 1, 0)]
    has = (rank > 0) & (ends[near] == ends)
    k = np.arange(n)
    inside = has & (k > begins) & (near > begins)
    derived = inside & (words[k - 1] == words[near - 1])
    measured = np.flatnonzero(has & ~derived)
    own = np.zeros(n, np.int64)
    own[measured] = agreeing(words, measured, near[measured], np.minimum(ends[measured] - measured, ends[measured] - near[measured]))
    source = np.maximum.accumulate(np.where(derived, 0, k))
    return (own[source] - np.where(has, k - source, 0))[order] * has[order]


def enclosing(shared: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each border between suffixes in order (border k lies before suffix k), the nearest border with a smaller value on either side."""
    n = len(shared)
    left, right, stack = [0] * n, [n] * n, [0]
    for k in range(1, n):
        v = shared[k]
        while shared[stack[-1]] > v:
            right[stack.pop()] = k
        top = stack[-1]
        left[k] = left[top] if shared[top] == v else top
        stack.append(k)
    return np.asarray(left, np.int64), np.asarray(right, np.int64)


def branching_squares(words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the squares that another word (or the end) follows than would continue them."""
    n = len(words)
    order, rank = suffix_order(words, ends)
    shared = common_prefixes(words, begins, ends, order, rank)
    left, right = enclosing(shared.tolist())
    border = np.flatnonzero(shared > 0)
    if not len(border):
        return border, border
    # a node is what has the same left end and depth; its borders part its children
    node = left[border] * (int(shared.max()) + 1) + shared[border]
    turn = np.argsort(node, kind="stable")
    border, node = border[turn], node[turn]
    opens = np.concatenate([[True], node[1:] != node[:-1]])
    closes = np.concatenate([opens[1:], [True]])
    low = np.concatenate([np.where(opens, left[border], np.concatenate([[0], border[:-1]])), border[closes]])
    high = np.concatenate([border, right[border[closes]]])
    number = np.concatenate([np.cumsum(opens) - 1, np.arange(int(opens.sum()))])
    of = border[opens]  # a border of each node
    turn = np.lexsort((high - low, number))
    largest = turn[np.concatenate([number[turn][1:] != number[turn][:-1], [True]])]
    rest = np.ones(len(low), bool)
    rest[largest] = False
    low, high, of = low[rest], high[rest], of[number[rest]]
    size = high - low
    found_at, found_q = [], []
    part = (np.cumsum(size) - size) // (AT_ONCE * 16)
    for a, b in itertools.pairwise([*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(size)]):
        s = size[a:b]
        leaf = np.repeat(low[a:b] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
        v = np.repeat(of[a:b], s)
        i, q, first, last = order[leaf], shared[v], left[v], right[v]
        for start in (i, i - q):
            j = start + q
            ok = (start >= begins[i]) & (j < ends[i])
            other = rank[np.where(ok, np.where(start == i, j, start), 0)]
            ok &= (other >= first) & (other < last)
            after = j + q
            end = after == ends[i]
            ok &= end | (words[np.minimum(after, n - 1)] != words[np.minimum(j, n - 1)])
            found_at.append(start[ok])
            found_q.append(q[ok])
    key = np.unique(np.concatenate(found_at) * (n + 1) + np.concatenate(found_q)) if found_at else np.zeros(0, np.int64)
    return key // (n + 1), key % (n + 1)


def maximal_runs(words: np.ndarray, text_ends: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the runs of texts that lie end to end (text_ends[place]: where its text stops), by start, then period."""
    if 2 * gram > least:
        raise ValueError("a run must be able to hold its grams twice")
    places, ends = candidates(words, text_ends, least, gram)
    if not len(places):
        return places, places, places
    own = words[places]
    begins = np.concatenate([[0], ends[:-1]])
    begins[1:][ends[1:] == ends[:-1]] = 0
    begins = np.maximum.accumulate(begins)
    start, period = branching_squares(own, begins, ends)
    stop = start + 2 * period
    turn = np.lexsort((period, stop))
    start, period, stop = start[turn], period[turn], stop[turn]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(start):  # the smallest period that is left at each end; primitive ones are few at an end
        head = np.concatenate([[True], stop[1:] != stop[:-1]])
        s, q, e = start[head], period[head], stop[head]
        s = s - agreeing(own, s - 1, s + q - 1, s - begins[s], -1)
        found.append((s, e - s, q))
        group = np.cumsum(head) - 1
        left = ~head & ~((period % q[group] == 0) & (start >= s[group]))
        start, period, stop = start[left], period[left], stop[left]
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    long_ = length >= least
    start, length, period = places[start[long_]], length[long_], period[long_]
    turn = np.lexsort((period, start))
    return start[turn], length[turn], period[turn]


def periodic_runs(docs: DataFrame, keep: list[str], least: int = LEAST, gram: int = GRAM, text: str = "text") -> DataFrame:
    """keep's columns, runs (by start, then period) and collapsed: the words that no run holds after its first period, joined by a space."""
    base = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = extended(base.drop("__text"), "runs array<struct<start:long,length:long,period:long>>, collapsed string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [WORD.findall(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            sizes = np.asarray([len(x) for x in words], np.int64)
            bound = np.concatenate([[0], np.cumsum(sizes)])
            number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
            ids = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(bound[-1]))
            start, length, period = maximal_runs(ids, np.repeat(bound[1:], sizes), least, gram)
            row = np.searchsorted(bound, start, side="right") - 1
            change = np.zeros(len(ids) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            dropped = np.cumsum(change[:-1]) > 0
            collapsed = []
            for a, b, x in zip(bound[:-1].tolist(), bound[1:].tolist(), words, strict=True):
                own = dropped[a:b]
                collapsed.append(" ".join(itertools.compress(x, (~own).tolist()) if own.any() else x))
            at = np.searchsorted(row, np.arange(len(words) + 1))
            values = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start - bound[row], length, period)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists.cast(arrow.field("runs").type), pa.array(collapsed, pa.string())], schema=arrow)

    return base.mapInArrow(run, schema)


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; where the id's crc32 is a multiple of ten, the text's words repeat from a place on, as its last digits say. A null id changes nothing."""
    n = F.size("w")
    g = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 10)
    here = docs.select("doc_id", "text", g.alias("g"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).alias("chosen"))
    here = here.withColumn("w", F.when(F.col("chosen"), words(F.col("text"))))
    a = (F.col("g") % n).cast("int")
    period = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    here = here.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, period))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    turned = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))), F.lit(1), n)
    return here.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every row of documents, planted ones included; a null text has none."""
    found = periodic_runs(with_planted(table(spark, sf_dir, "documents")), ["doc_id"])
    # the greatest length, then the smallest start, then the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    out = out.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"), "runs_sha256", "collapsed_sha256")
    return out.withColumn("exponent_milli", F.expr("1000 * length div period"))
