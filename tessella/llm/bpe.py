"""Byte-level BPE encoding and decoding, with pre-tokenisation by scans over arrays.

Characters become classes by a table over all code points. A class says what a piece boundary needs to know of what follows: an apostrophe is one that opens
a contraction of two or three characters or is not; white space is followed by more of it (or the text's end), or it is the last of its run. What came before is
the state of a small automaton. Each class is a function from states to states; the functions that classes make by following each other are few, so each has a
number, and one table gives the number of any two in turn. As this is associative, blocks of characters are scanned side by side, then the blocks' totals.
No regular expression runs over a text.

The pieces between boundaries are merged by rank once each, and remembered. A token keeps the place where its bytes start, by which decoding puts
tokens back, any run of them alone.

Defined results: a null text is an empty one and has no tokens; repeated rows are encoded each; an empty table gives an empty result; extra columns are kept
where asked for by name. Texts are scanned in windows, the automaton's state carried over, so beside the text itself a very long one needs no more than its
tokens. A piece of n bytes takes n log n steps. Ids without a token raise.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.common import extended, slices, table

#: Characters of a window and of a block; pieces that a task remembers, and the longest of these in characters.
WINDOW, BLOCK = 1 << 21, 256
REMEMBERED, REMEMBERED_CHARS = 500_000, 64
#: Bytes up to which a piece's pairs are searched one by one; longer ones keep them in a heap. Both ways give the same.
SHORT = 100

#: Kinds of characters in the table of code points.
OTHER, LETTER, NUMBER, SPACE, BLANK, APOSTROPHE = range(6)
#: Classes: letter, number, other, apostrophe of a contraction with one or two letters, white space before more of it, last blank, other last white space.
#: FIRST is added for a text's first character.
L, N, O, A1, A2, W, B, V = range(8)
FIRST = 8
#: States: a piece must start next; inside letters, numbers, others, white space; after a blank that joins what follows; one or two letters of a contraction to come.
START, IN_L, IN_N, IN_O, IN_W, JOIN, ONE, TWO = range(8)


def step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at the character."""
    if kind >= FIRST:
        return step(START, kind - FIRST)[0], True
    if state in (ONE, TWO):
        return (START if state == ONE else ONE), False
    if kind in (L, N, O):
        own = {L: IN_L, N: IN_N, O: IN_O}[kind]
        return own, state not in (own, JOIN)
    if kind in (A1, A2):
        return (IN_O, False) if state in (IN_O, JOIN) else (ONE if kind == A1 else TWO, True)
    if kind == W:
        return IN_W, state != IN_W
    return (JOIN if kind == B else START), True


@functools.lru_cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the classes' functions; the number of two functions in turn; a function's state from each state; whether a piece starts, by state and class."""
    base = [tuple(step(s, c)[0] for s in range(8)) for c in range(2 * FIRST)]
    known = {f: k for k, f in enumerate(dict.fromkeys(base))}
    functions = list(known)
    for f in functions:  # grows as it runs, until every function in turn with a class is known
        for g in base:
            both = tuple(g[s] for s in f)
            if both not in known:
                known[both] = len(functions)
                functions.append(both)
    compose = np.asarray([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    return (
        np.asarray([known[f] for f in base], np.uint16), compose, np.asarray(functions, np.uint8),
        np.asarray([[step(s, c)[1] for c in range(2 * FIRST)] for s in range(8)]),
    )


@functools.lru_cache
def kinds() -> bytes:
    """The kind of each code point, as the library with the same pattern has it (its Unicode version need not be Python's)."""
    import tiktoken

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    one = {bytes([k]): k for k in range(256)}
    out = np.zeros(0x110000, np.uint8)
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = bytes(tiktoken.Encoding("classes", pat_str=name, mergeable_ranks=one, special_tokens={}).encode_ordinary(every))
        out[np.frombuffer(found.decode().encode("utf-32-le"), "<u4")] = kind
    out[ord(" ")], out[ord("'")] = BLANK, APOSTROPHE
    return out.tobytes()


def packed_kinds() -> tuple[bytes, bytes]:
    """The table of kinds as runs: where each starts, and its kind."""
    every = np.frombuffer(kinds(), np.uint8)
    at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return at.astype(np.uint32).tobytes(), every[at].tobytes()


def unpacked(runs: tuple[bytes, bytes]) -> np.ndarray:
    at = np.frombuffer(runs[0], np.uint32).astype(np.int64)
    return np.repeat(np.frombuffer(runs[1], np.uint8), np.diff(at, append=0x110000))


def classes(points: np.ndarray, first: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """The classes of code points; first: which of them begin a text. What follows the last one counts as an end."""
    kind = table_[points]
    ahead = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])
    own = ~np.concatenate([first[1:], [True]])  # the next character is of the same text
    own2 = own & ahead(own, 1)
    white = (kind == SPACE) | (kind == BLANK)
    out = np.asarray([O, L, N, V, B, O], np.uint8)[kind]
    out[white & ~(own & ~ahead(white, 1))] = W
    k = np.flatnonzero((kind == APOSTROPHE) & own)
    one, two = points[k + 1], np.where(own2[k], ahead(points, 2)[k], 0)
    out[k[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = A2
    out[k[np.isin(one, [ord(x) for x in "stmd"])]] = A1
    return out + first * np.uint8(FIRST)


def starts(cls: np.ndarray, state: int = START) -> tuple[np.ndarray, int]:
    """Whether a piece starts at each character, and the state after the last."""
    generator, compose, apply, out = automaton()
    n = len(cls)
    if not n:
        return np.zeros(0, bool), state
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, W, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)  # a row is a place in all blocks
    names, flat, width = generator[grid], compose.ravel(), compose.shape[1]
    for j in range(1, BLOCK):  # within the blocks
        names[j] = flat[names[j - 1].astype(np.int32) * width + names[j]]
    total, shift = names[-1].copy(), 1
    while shift < blocks:  # over the blocks
        total[shift:] = flat[total[:-shift].astype(np.int32) * width + total[shift:]]
        shift *= 2
    entry = np.full(blocks, state, np.uint8)
    entry[1:] = apply[total[:-1], state]
    before = np.empty_like(grid)
    before[0] = entry
    before[1:] = apply[names[:-1], entry]
    made = out[before, grid].T.reshape(-1)[:n]
    k = (n - 1) % BLOCK
    return made, int(apply[names[k, -1], entry[-1]])


def boundaries(text: str, begins: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """Places of text, several texts end to end that begin at begins, where pieces start."""
    found, state = [], START
    for low in range(0, len(text), WINDOW):
        seen = text[low : low + WINDOW + 2]
        n = min(WINDOW, len(seen))
        points = np.frombuffer(seen.encode("utf-32-le", "surrogatepass"), "<u4")
        first = np.zeros(len(points), bool)
        first[begins[np.searchsorted(begins, low) : np.searchsorted(begins, low + len(points))] - low] = True
        made, state = starts(classes(points, first, table_)[:n], state)
        found.append(np.flatnonzero(made) + low)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """A piece's ids: the pair of the lowest rank, the leftmost first, is joined until no pair has one."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    return list(map(ranks.__getitem__, _joined(piece, ranks) if n <= SHORT else _joined_by_heap(piece, ranks)))


def _joined(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    parts = [piece[k : k + 1] for k in range(len(piece))]
    none = 1 << 62
    pair = [ranks.get(a + b, none) for a, b in itertools.pairwise(parts)]
    while pair and (low := min(pair)) < none:
        k = pair.index(low)
        parts[k] += parts.pop(k + 1)
        del pair[k]
        if k:
            pair[k - 1] = ranks.get(parts[k - 1] + parts[k], none)
        if k < len(pair):
            pair[k] = ranks.get(parts[k] + parts[k + 1], none)
    return parts


def _joined_by_heap(piece: bytes, ranks: dict[bytes, int]) -> Iterator[bytes]:
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    pair = [ranks.get(piece[k : k + 2]) for k in range(n - 1)] + [None]
    heap = [(r, k) for k, r in enumerate(pair) if r is not None]
    heapq.heapify(heap)
    while heap:
        r, k = heapq.heappop(heap)
        if pair[k] != r:
            continue
        gone = after[k]
        end[k], after[k], pair[gone] = end[gone], after[gone], None
        if after[k] < n:
            before[after[k]] = k
        for a in (before[k], k):
            if a >= 0:
                b = after[a]
                pair[a] = new = ranks.get(piece[a : end[b]]) if b < n else None
                if new is not None:
                    heapq.heappush(heap, (new, a))
    k = 0
    while k < n:
        yield piece[k : end[k]]
        k = after[k]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """The tokens' bytes end to end, for reading many by their ids."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for b, k in ranks.items():
            tokens[k] = b
        self.length = np.asarray([len(x) for x in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> bytes:
        """The tokens' bytes, each put where it starts, counted from the first one's start."""
        if not len(ids):
            return b""
        length, at = self.length[ids], at.astype(np.int64)
        if not (length.all() and (at[1:] - at[:-1] == length[:-1]).all()):
            raise ValueError("ids and offsets are not of one text")
        source = np.repeat(self.start[ids] - (at - at[0]), length)
        source += np.arange(len(source))
        return self.bytes[source].tobytes()


def encode(docs: DataFrame, keep: list[str], path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """keep's columns, ids and offsets (array<int>): the tokens of each text by the ranks in path, and the bytes of the text before each (a row holds less than 2 GB).

    decoded adds what the ids and offsets are read back as, as by decode() but in the same pass."""
    base = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = extended(base.drop("__text"), "ids array<int>, offsets array<int>" + ", decoded binary" * decoded)
    arrow, runs = to_arrow_schema(schema), packed_kinds()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, table_, known = read_ranks(path), unpacked(runs), {}
        words = Vocabulary(ranks)
        length = words.length
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sizes = np.asarray([len(x) for x in texts], np.int64)
            ends = np.cumsum(sizes)
            whole = "".join(texts)
            at = boundaries(whole, np.unique((ends - sizes)[sizes > 0]), table_)
            places = at.tolist()
            pieces = list(map(whole.__getitem__, map(slice, places, [*places[1:], len(whole)])))
            if len(known) > REMEMBERED:
                known.clear()
            ids = list(map(known.get, pieces))
            if None in ids:
                for k, x in enumerate(ids):
                    if x is None:
                        p = pieces[k]
                        ids[k] = x = known.get(p) or np.asarray(merged(p.encode("utf-8", "surrogatepass"), ranks), "<i4").tobytes()
                        if len(p) <= REMEMBERED_CHARS:
                            known[p] = x
            row = np.searchsorted(at, np.concatenate([[0], ends])).tolist()  # a text's first piece
            joined = [b"".join(ids[a:b]) for a, b in itertools.pairwise(row)]
            bound = np.concatenate([[0], np.cumsum([len(x) // 4 for x in joined], dtype=np.int64)])
            values = np.frombuffer(b"".join(joined), "<i4")
            before = np.concatenate([[0], np.cumsum(length[values])])
            offsets = before[:-1] - np.repeat(before[bound[:-1]], np.diff(bound))
            lists = [pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(x, kind)) for x, kind in ((values, pa.int32()), (offsets.astype(np.int32), pa.int32()))]
            made = [pa.array([words.decoded(values[a:b], offsets[a:b]) for a, b in itertools.pairwise(bound.tolist())], pa.binary())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[x.cast(arrow.field(n).type) for x, n in zip(lists, ("ids", "offsets"), strict=True)], *made], schema=arrow)

    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, keep: list[str], path: str, ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """keep's columns and decoded (binary): the bytes of ids, or of any run of them with the offsets of that run."""
    base = encoded.select(*keep, F.col(ids).alias("__ids"), F.col(offsets).alias("__offsets"))
    schema = extended(base.drop("__ids", "__offsets"), "decoded binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(read_ranks(path))
        for batch in slices(batches):
            a, b = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            numbers, places = a.flatten().to_numpy(zero_copy_only=False), b.flatten().to_numpy(zero_copy_only=False)
            bound = np.concatenate([[0], np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
            made = [words.decoded(numbers[x:y], places[x:y]) for x, y in itertools.pairwise(bound)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(made, pa.binary())], schema=arrow)

    return base.mapInArrow(run, schema)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, encoded and decoded again; a null text is empty and has no tokens."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(table(spark, sf_dir, "documents"), ["doc_id"], path, decoded=True)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
