import random
from collections import Counter

import pytest

from tessella.llm import chat as C
from tests.llm.test_sql import rows_in, rows_of

SCHEMA = "conv_id string, turn long, role string, text string"


def talk(rng):
    hot = [(rng.choice([None, 0, 1, 2]), rng.choice(["a", "b", None, "system"]), rng.choice(["x <|y", "x < |y", "z", None, str(k)])) for k in range(1500)]
    hot += [(1, "a", "again")] * 900 + [(0, "system", "Be kind <|")]
    rows = [(None, *m) for m in hot]
    rows += [("long", k, ("system" if k == 0 else "ann" if k % 2 else "bob"), f"turn {k}") for k in range(500)]
    rows += [("crowd", 3, rng.choice(["ann", "bob"]), f"at once {rng.randrange(400)}") for _ in range(1000)]
    rows += [("small", k, "a" if k % 2 else "b", f"t{k}") for k in range(80)] + [("wide", 0, "a", "w" * 5000), ("wide", 1, "b", "v")] + [("mute", 0, "system", "nobody")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("part", [C.PART, 3000])
def test_sql_and_order(spark, tmp_path, monkeypatch, part):
    """Whole dialogues, and parts of them, against SQL, whatever the partitions."""
    monkeypatch.setattr(C, "PART", part)
    rng, results = random.Random(4), []
    for n in (1, 7):
        rows = talk(random.Random(4))
        rng.shuffle(rows)
        spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA + ", speaker string, part int").repartition(n).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
        got = C.op7_chat_rotation(spark, str(tmp_path))
        results.append(rows_of(got))
        assert results[-1] == rows_in(tmp_path, ["conversations"], C.oracle(part))
    assert results[0] == results[1]
    most = max(r["part"] for r in got.collect())
    assert most > 20 if part == 3000 else most == 0


def test_parts_rejoin(spark, monkeypatch):
    rows = [(1, k, "system" if k == 0 else "ab"[k % 2], f"turn {k} " * (k % 5)) for k in range(500)]
    turns = spark.createDataFrame(rows, SCHEMA)
    whole = {r["speaker"]: r["text"] for r in C.rotate(turns).collect()}
    monkeypatch.setattr(C, "PART", 2000)
    got = sorted(C.rotate(turns).collect(), key=lambda r: r["part"])
    assert len(got) > 20 and all(r["system"] == (None if r["part"] == 0 else "") for r in got)
    for speaker, text in whole.items():
        own = [r for r in got if r["speaker"] == speaker]
        assert "".join(r["text"] for r in own) == text and [r["part"] for r in own] == list(range(len(own)))
        said = [r["text"][s["start"] : s["end"]] for r in own for s in r["spans"]]
        assert said == [t for _, _, who, t in rows if who == speaker]


def test_a_row_repeated_over_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "PART", 1000)
    rows = [("x", 0, "a", "same")] * 300 + [("x", 1, "b", "end")]
    got = C.parts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(len(r["messages"]) for r in got) == 301 and Counter(len(r["messages"]) for r in got).most_common(1)[0][0] in (14, 15)
    assert sorted(r["part"] for r in got) == list(range(len(got)))


def test_keys_without_broadcast(spark, monkeypatch):
    turns = spark.createDataFrame(talk(random.Random(5)), SCHEMA)
    monkeypatch.setattr(C, "PART", 3000)
    want = rows_of(C.rotate(turns).drop("spans"))
    monkeypatch.setattr(C, "BROADCAST", 1)
    assert rows_of(C.rotate(turns).drop("spans")) == want
