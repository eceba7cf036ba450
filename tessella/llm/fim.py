"""Fill-in-the-middle transformation, cut at line ends that overlapping chunks find.

A batch's texts lie end to end as bytes and are taken in chunks. A byte opens a line if it is a text's first or follows a line feed, so a chunk that also
sees the byte before it counts its own lines without its neighbours. Prefix sums of the counts give the chunk that holds a cut, and only that chunk is read
again. A cut is a number of whole lines, so that no character is ever split.

Defined results: a null text is an empty one; a null doc_id is the empty word in the hash that places cuts; repeated rows are cut each for themselves;
a text of one line has cuts at its ends only; empty texts and texts that hold one of the marks stay plain; an empty table gives an empty result. Extra columns are
kept where asked for by name. Work and memory grow with a batch's bytes, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.common import extended, slices, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk.
CHUNK = 4096
SEED, RATE, SPM = 7, 100, 50


def line_cuts(data: np.ndarray, offsets: np.ndarray, fractions: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts data[offsets[d]:offsets[d + 1]]: their numbers of lines n, and for each number f of fractions[d] the place in data after f % (n + 1) lines."""
    starts, ends = offsets[:-1], offsets[1:]
    per_text = -(-(ends - starts) // chunk)
    text = np.repeat(np.arange(len(starts)), per_text)
    base = np.cumsum(per_text) - per_text  # a text's first chunk
    low = starts[text] + (np.arange(len(text)) - base[text]) * chunk
    high = np.minimum(low + chunk, ends[text])

    opens = np.empty(len(data), bool)  # the predicate on neighbours, over all chunks at once
    opens[:1] = True
    np.equal(data[:-1], 10, out=opens[1:])
    opens[starts[per_text > 0]] = True
    sums = np.zeros(len(text) + 1, np.int64)
    if len(text):
        np.cumsum(np.add.reduceat(opens, low, dtype=np.int64), out=sums[1:])
    before = sums[base]
    n = sums[base + per_text] - before

    at = np.repeat(ends[:, None], fractions.shape[1], axis=1)
    rank = fractions % (n[:, None] + 1)
    for d, k in zip(*np.nonzero(rank < n[:, None]), strict=True):
        wanted = before[d] + rank[d, k]  # lines of the batch before the cut
        owner = np.searchsorted(sums, wanted, side="right") - 1
        a, b = low[owner], high[owner]
        inside = np.flatnonzero((data[max(a - 1, 0) : b - 1] == 10) if a > starts[d] else np.concatenate([[True], data[a : b - 1] == 10]))
        at[d, k] = a + inside[wanted - sums[owner]]
    return n, at


def numbers(doc_id: Column, seed: int) -> Column:
    """The first four 8-digit groups of the hash of seed and id, as an array of unsigned numbers."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def fill_in_middle(docs: DataFrame, keep: list[str], seed: int = SEED, rate: int = RATE, spm: int = SPM, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """keep's columns, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    rate in 100 texts are cut, spm in 100 of them take their suffix first.
    """
    base = docs.select(*keep, numbers(F.col(doc_id), seed).alias("__numbers"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = extended(base.drop("__numbers", "__text"), "n long, form string, prefix_chars long, middle_chars long, output string")
    arrow, marks = to_arrow_schema(schema), [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = marks
        for batch in slices(batches):
            raw = pc.cast(batch.column(batch.num_columns - 1), pa.large_binary())
            lengths = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
            joined = b"".join(raw.to_pylist())
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            given = np.asarray(batch.column(batch.num_columns - 2).to_pylist(), np.int64).reshape(-1, 4)
            n, cuts = line_cuts(np.frombuffer(joined, np.uint8), offsets, given[:, :2], chunk)
            out: list[tuple] = []
            for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                whole = joined[a:b]
                if not whole or any(x in whole for x in marks) or given[d, 2] % 100 >= rate:
                    out.append(("plain", None, None, whole))
                    continue
                c1, c2 = sorted(cuts[d].tolist())
                prefix, middle, suffix = joined[a:c1], joined[c1:c2], joined[c2:b]
                first = given[d, 3] % 100 < spm
                made = s + suffix + p + prefix + m + middle if first else p + prefix + s + suffix + m + middle
                out.append(("spm" if first else "psm", len(prefix.decode()), len(middle.decode()), made))
            form, prefix_chars, middle_chars, output = zip(*out, strict=True)
            columns = [*batch.columns[:-2], n, form, prefix_chars, middle_chars, pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    return base.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone: a cut text holds no mark of its own."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, cut at lines; a null text is empty and stays plain."""
    out = fill_in_middle(table(spark, sf_dir, "documents"), ["doc_id"])
    again = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


ORACLE = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), units AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS units,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM hashed
), cuts AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
