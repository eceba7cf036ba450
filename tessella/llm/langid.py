"""Language identification by compression.

A text is encoded with one zstandard raw-content dictionary per language; the language whose dictionary
gives the smallest output wins, and a narrow margin over the runner-up rejects the decision.

Defined results: a text that is null or holds no letter is ``und`` with score 0 and not accepted; ties go to the
language with most labelled rows; with no labelled row every text is ``und``; a null label teaches nothing; very long texts are encoded
whole, piece by piece; an empty table gives an empty result. Repeated rows give repeated rows. Columns other
than those named, also of clashing names, are ignored.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import extended, map_columns, table

#: Bytes of text encoded at a time. Each piece is scored against the bare dictionary, so that long texts
#: keep telling the languages apart instead of compressing against themselves.
PIECE = 4096
LEVEL, MIN_MATCH = 6, 3
_LETTER = re.compile(r"[^\W\d_]")
_GAP = re.compile(r"[^\w]+")


def normal(text: str) -> bytes:
    """What is encoded: lower case, a space for each run of other characters than letters, digits and _."""
    return _GAP.sub(" ", text.lower()).encode("utf-8", "replace")


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", sample_rows: int = 2000, dict_bytes: int = 64 << 10, model_bytes: int = 64 << 20) -> dict[str, bytes]:
    """A dictionary for each language, from a bounded sample of the labelled rows.

    sample_rows bounds the texts sampled, over all languages (each language has one at least): those with the smallest hashes,
    each text once. Each gives an equal share of its language's dictionary, from a place in it that its hash tells, and is cut
    to it before it reaches the driver. dict_bytes bounds a dictionary, model_bytes all of them: with more languages
    than model_bytes / dict_bytes each has a smaller one.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(label).alias("l")).filter("t is not null and l is not null and t != ''")
    distinct = F.approx_count_distinct(F.xxhash64("t")).alias("texts")
    counts = rows.groupBy("l").agg(F.count("*").alias("count"), distinct).orderBy(F.desc("count"), "l").collect()
    if not counts:
        return {}
    each = max(1, sample_rows // len(counts))
    most = max(8, min(dict_bytes, model_bytes // len(counts)))
    chars = {r["l"]: -(-most // max(1, min(each, r["texts"]))) for r in counts}
    model = F.broadcast(labelled.sparkSession.createDataFrame([(r["l"], min(1.0, (2.0 * each + 20) / max(1, r["texts"])), chars[r["l"]]) for r in counts], "__l string, __p double, __n int"))
    h = F.xxhash64("t")
    x = rows.join(model, F.col("l") == F.col("__l")).withColumn("h", (h.cast("double") / F.lit(2.0**64)) + 0.5).filter("h <= __p")
    at = F.pmod(F.xxhash64(h), F.greatest(F.length("t") - F.col("__n") + 1, F.lit(1))).cast("int") + 1
    one = x.select("l", "h", F.substring(F.col("t"), at, F.col("__n")).alias("t")).groupBy("l", "h").agg(F.min("t").alias("t"))
    sample = one.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h"))).filter(F.col("k") <= each).orderBy("l", "k").collect()
    texts: dict[str, list[bytes]] = {}
    for r in sample:
        texts.setdefault(r["l"], []).append(normal(r["t"]))
    # zstandard takes eight bytes at least
    return {r["l"]: b"\n".join(texts[r["l"]])[-most:].ljust(8) for r in counts if r["l"] in texts}


class Encoder:
    def __init__(self, model: dict[str, bytes]):
        self.langs = list(model)
        self.coders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=PIECE, dict_size=len(model[lang]), min_match=MIN_MATCH, write_content_size=False, write_dict_id=False)
            d.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def sizes(self, text: str) -> list[int]:
        data = normal(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its margin over the runner-up, as a share of the runner-up's size."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        if len(order) == 1:
            return self.langs[0], 1.0
        first, second = sizes[order[0]], sizes[order[1]]
        return self.langs[order[0]], (second - first) / second


def predict(docs: DataFrame, model: dict[str, bytes], keep: list[str], text: str = "text", min_margin: float = 0.01) -> DataFrame:
    """keep's columns, lang_pred, score (the margin, 0 to 1) and accepted (the margin is at least min_margin)."""
    base = docs.select(*keep, F.col(text).alias("__text"))

    def make():
        coder = Encoder(model)

        def f(cols):
            found = [coder.predict(x) for x in cols.pop("__text")]
            return cols | {"lang_pred": [x for x, _ in found], "score": [s for _, s in found], "accepted": [x != "und" and s >= min_margin for x, s in found]}

        return f

    schema = extended(base.drop("__text"), "lang_pred string, score double, accepted boolean")
    return map_columns(base, make, schema)


def held_out(doc_id=None):
    """Whether a document is in the fifth that the model never learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of documents, learned from four fifths of them; "und" for texts that are null or have no letter."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = fit(docs.filter(~F.col("held_out")))
    return predict(docs, model, ["doc_id", "held_out"])
