import random
import zlib

from tessella.llm import langid as L

WORDS = {"en": "the water under bridge with stone where green fields are lying".split(), "de": "das wasser unter brücke mit stein über grüne felder liegen schön".split(), "fr": "les eaux sous le pont avec pierre où champs verts étaient couchés".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_query_and_held_out_accuracy(spark, tmp_path):
    rng, rows = random.Random(1), []
    for k in range(600):
        lang = rng.choice(list(WORDS))
        rows.append((k, text(rng, lang, rng.randrange(8, 300)), lang, "clash"))
    rows += [(1000, None, "en", ""), (1001, "", "en", ""), (1002, "123 --- 456", "de", ""), (1003, text(rng, "de", 20_000), None, ""), (None, text(rng, "fr", 50), "fr", ""), rows[0]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op3_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    lang = {d: x for d, _, x, _ in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in got if r["doc_id"] is not None)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.98
    by = {r["doc_id"]: r for r in got}
    assert {by[k]["lang_pred"] for k in (1000, 1001, 1002)} == {"und"} and by[1003]["lang_pred"] == "de" and by[None]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] == "und" or r["lang_pred"] in WORDS) for r in got)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.fit(docs) == {} and L.predict(docs, {}, ["doc_id"]).first()["lang_pred"] == "und"
    assert L.predict(docs.limit(0), L.fit(docs.limit(0)), ["doc_id"]).count() == 0


def test_margins(spark):
    rng = random.Random(2)
    model = {k: L.normal(text(rng, k, 2000)) for k in WORDS}
    docs = spark.createDataFrame([(1, text(rng, "en", 200)), (2, "zq")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.predict(docs, model, ["doc_id"]).collect()}
    assert got[1]["accepted"] and got[1]["lang_pred"] == "en" and not got[2]["accepted"]


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([("same text again", "en")] * 500 + [(f"text {k}", "de") for k in range(500)], "text string, lang string")
    model = L.fit(docs, sample_rows=20)
    assert set(model) == {"en", "de"} and model["de"].count(b"text") <= 20


def test_every_language_has_its_dictionary(spark):
    """Rare languages, short ones and many of them; what reaches the driver is cut."""
    rng = random.Random(6)
    rows = [(text(rng, "en", 3000), "en")] * 2 + [(text(rng, "en", 50) + str(k), "en") for k in range(50)] + [("ab", "tiny")]
    rows += [(f"{chr(0x400 + k)}{chr(0x500 + k)} " * 40, f"l{k}") for k in range(150)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = L.fit(docs, sample_rows=100, dict_bytes=4096, model_bytes=150 * 1024)
    assert len(model) == 152 and all(8 <= len(v) <= 1024 for v in model.values()) and model["tiny"].strip() == b"ab"
    coder = L.Encoder(model)
    assert [coder.predict(f"{chr(0x400 + k)}{chr(0x500 + k)} " * 30)[0] for k in range(0, 150, 30)] == [f"l{k}" for k in range(0, 150, 30)]


def test_held_out_accuracy_on_documents(spark):
    got = L.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = [r for r in got.collect() if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
