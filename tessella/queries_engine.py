"""Registered queries of indexing, the stored index, streams, and the query language's golden tables."""

from __future__ import annotations

import io
import json
import time
import zipfile
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.engine import Engine
from tessella.functions import scores, text
from tessella.operators import filenames, migrations, ranking, reports, tables, vectors
from tessella.operators.index import VectorIndex
from tessella.operators.postings import NameIndex
from tessella.plans import parser, understanding
from tessella.plans.clauses import Clause, Spec, chips, deny_list, merge
from tessella.plans.dates import resolve
from tessella.queries import NOW, _bm25, query
from tessella.schema import RETRY
from tessella.sources import documents, folders, media, pdf, stored
from tessella.sources import tables as src
from tessella.streaming import registry, timers, watch


def _values(rows: list[tuple]) -> str:
    """Rows as an SQL VALUES list."""
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(show, r))})" for r in rows)


def _turns(s: SparkSession, d: str, texts: list[str], name: str = "q") -> DataFrame:
    """(conv_id, turn, name): every turn of the conversations with one of the texts, dealt by number."""
    pick = F.element_at(F.array(*map(F.lit, texts)), (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(texts))) + 1).cast("int"))
    return src.table(s, d, "conversations").select("conv_id", "turn", pick.alias(name))


def _golden(rows: list[tuple], columns: str, picked: str) -> str:
    """SQL of the turns with their golden rows; the first column is the text that was dealt."""
    return f"""WITH g AS (SELECT *, row_number() OVER () - 1 AS k FROM (VALUES {_values(rows)}) AS v({columns}))
SELECT conv_id, turn, {picked} FROM conversations JOIN g ON k = (conv_id * 7 + turn) % {len(rows)}"""


# --- sources

_LISTED = """
SELECT doc_id, ['/corpus/', '/corpus/Node_Modules/', '/corpus/a/.git/b/', '/corpus/build.d/', '/corpus/coverage/x/'][doc_id % 5 + 1] || 'f' || doc_id || ['.txt', '.PDF', '.mp4', '.bin', ''][doc_id // 5 % 5 + 1] AS path,
  CASE WHEN doc_id % 3 = 0 THEN 60000000 ELSE octet_length(encode(text)) END AS length, text FROM documents"""


def _raw(s, d) -> DataFrame:
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    i = F.col("doc_id")
    path = F.concat(pick(("/corpus/", "/corpus/Node_Modules/", "/corpus/a/.git/b/", "/corpus/build.d/", "/corpus/coverage/x/"), i), F.lit("f"), i.cast("string"), pick((".txt", ".PDF", ".mp4", ".bin", ""), F.expr("doc_id div 5")))
    return src.table(s, d, "documents").select(
        path.alias("path"), F.when(i % 3 == 0, F.lit(60_000_000)).otherwise(F.octet_length("text")).cast("long").alias("length"),
        F.lit(datetime(2024, 1, 1)).alias("modificationTime"), F.col("text").cast("binary").alias("content"),
    )


@query(f"""WITH l AS ({_LISTED}), k AS (SELECT *, CASE WHEN path LIKE '%.PDF' THEN 'document' WHEN path LIKE '%.mp4' THEN 'video' WHEN text IS NOT NULL AND text <> '' THEN 'text' ELSE '' END AS kind FROM l)
SELECT path, kind AS file_type, CASE WHEN path LIKE '%.PDF' THEN '.pdf' WHEN path LIKE '%.mp4' THEN '.mp4' WHEN path LIKE '%.txt' THEN '.txt' WHEN path LIKE '%.bin' THEN '.bin' ELSE '' END AS extension, length::BIGINT AS size_bytes,
  CASE WHEN length > 52428800 AND kind IN ('video', 'document') THEN 'ERR_FILE_TOO_LARGE' END AS error
FROM k WHERE kind <> '' AND NOT regexp_matches(path, '/Node_Modules/|/[.]git/|/coverage/')""", relations=False)
def walk_listing(s, d):
    """Folder exclusion in any case, kinds by name or content, and the size limit, over a listing."""
    return folders.described(folders.listing(_raw(s, d), "/corpus")).select("path", "file_type", "extension", "size_bytes", "error")


@query(f"""WITH l AS ({_LISTED}) SELECT count(*) AS n FROM l WHERE (path LIKE '%.PDF' OR path LIKE '%.mp4' OR (text IS NOT NULL AND text <> '')) AND NOT regexp_matches(path, '/Node_Modules/|/[.]git/|/coverage/')""", relations=False)
def indexable_count(s, d):
    return folders.described(folders.listing(_raw(s, d), "/corpus")).agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN html <> '' THEN substr(html, 1, 2000) END AS preview FROM pages", relations=False)
def file_preview(s, d):
    return src.table(s, d, "pages").select("page_id", F.substring(text.preview(F.col("html").cast("binary")), 1, 2000).alias("preview"))


_PLAIN = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g'))"


def _plain(s, d) -> DataFrame:
    return src.table(s, d, "documents").select("doc_id", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " ")).alias("x"))


@query(f"SELECT doc_id, CASE WHEN x = '' THEN '' WHEN length(x) + 1 >= 8000 THEN substr(x, 1, 8000) ELSE substr(x || chr(10) || 'ABC', 1, 8000) END AS text, 1 + doc_id % 3 AS pages FROM (SELECT doc_id, {_PLAIN} AS x FROM documents)", relations=False)
def pdf_text(s, d):
    shown = F.concat(F.lit("%PDF-1.4\n"), F.repeat(F.lit("/Type /Page \n"), (1 + F.col("doc_id") % 3).cast("int")), F.lit("/Type /Pages\n("), "x", F.lit(") Tj\n"), F.when(F.col("x") == "", "").otherwise("<414 243> Tj"))
    files = _plain(s, d).select(F.col("doc_id").alias("file_id"), F.lit(".pdf").alias("extension"), shown.cast("binary").alias("content"))
    return documents.extract(files).select(F.col("file_id").alias("doc_id"), "text", F.col("pages").cast("long").alias("pages"))


def _pdf_files(docs: DataFrame) -> DataFrame:
    """(doc_id, content): a PDF file of up to 17 pages for each of docs."""
    def written(doc_id: int, lang: str) -> bytes:
        n = 1 + doc_id % 17
        kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(n))
        out = f"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Count {n} /Kids [{kids}] /MediaBox [0 0 9 9] >>\nendobj\n"
        for k in range(n):
            shown = f"(page {k + 1} of {doc_id} in {lang}) Tj\n"
            out += f"{10 + 2 * k} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>\nendobj\n{11 + 2 * k} 0 obj\n<< /Length {len(shown)} >>\nstream\n{shown}endstream\nendobj\n"
        return (out + "trailer\n<< /Root 1 0 R >>\n").encode()

    def write(frames):
        for rows in frames:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "content": [written(n, x) for n, x in zip(rows["doc_id"], rows["lang"], strict=True)]})

    return docs.select("doc_id", F.coalesce("lang", F.lit("-")).alias("lang")).mapInPandas(write, "doc_id long, content binary")


@query("""WITH n AS (SELECT doc_id, coalesce(lang, '-') AS lang, 1 + doc_id % 17 AS pages FROM documents),
w AS (SELECT *, unnest(range(0, CASE WHEN pages > 6 THEN 1 + CAST(ceil((pages - 6) / 5.0) AS BIGINT) ELSE 1 END)) AS i FROM n)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(i * 5 + 1 AS INTEGER) AS page_start, CAST(least(i * 5 + 6, pages) AS INTEGER) AS page_end, least(i * 5 + 6, pages) - i * 5 AS pages,
  array_to_string(list_transform(range(i * 5 + 1, least(i * 5 + 6, pages) + 1), lambda p: 'page ' || p || ' of ' || doc_id || ' in ' || lang), chr(10)) AS text FROM w""", relations=False)
def pdf_parts(s, d):
    """Files of up to 17 pages taken apart, and the parts read again."""
    made = pdf.parts(_pdf_files(src.table(s, d, "documents")), ["doc_id"]).withColumns({"file_id": F.col("doc_id") * 8 + F.col("chunk_index"), "extension": F.lit(".pdf")})
    read = documents.extract(made.select("file_id", "extension", "content")).select("file_id", "text", F.col("pages").cast("long").alias("pages"))
    return made.drop("content", "extension").join(read, "file_id").select("doc_id", "chunk_index", "page_start", "page_end", "pages", "text")


@query("""WITH n AS (SELECT doc_id, text, doc_id % 4 AS kind, CASE WHEN doc_id % 4 = 0 THEN 1 + doc_id % 17 ELSE 1 END AS pages FROM documents WHERE doc_id % 4 = 0 OR (doc_id % 4 <> 2 AND text <> '')),
w AS (SELECT *, unnest(range(0, CASE WHEN pages > 6 THEN 1 + CAST(ceil((pages - 6) / 5.0) AS BIGINT) ELSE 1 END)) AS i FROM n)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CASE kind WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' ELSE 'audio/mpeg' END AS media_type,
  CASE WHEN kind = 0 THEN CAST(i * 5 + 1 AS INTEGER) END AS page_start, CASE WHEN kind = 0 THEN CAST(least(i * 5 + 6, pages) AS INTEGER) END AS page_end, CASE WHEN kind <> 0 THEN sha256(text) END AS sha256 FROM w""", relations=False)
def media_parts(s, d):
    """What a provider would be sent of documents taken as PDF files, images, images that need a converter, and sounds by turns."""
    docs = src.table(s, d, "documents").withColumn("kind", F.element_at(F.array(*map(F.lit, (".pdf", ".png", ".heic", ".mp3"))), (F.col("doc_id") % 4 + 1).cast("int")))
    other = docs.filter("kind <> '.pdf'").select("doc_id", F.col("text").cast("binary").alias("content"), "kind")
    files = other.unionByName(_pdf_files(docs.filter("kind = '.pdf'")).withColumn("kind", F.lit(".pdf"))).withColumn("path", F.concat(F.lit("/f"), "kind"))
    files = files.select(F.col("doc_id").alias("file_id"), text.extension(F.col("path")).alias("extension"), text.media_type(F.col("path")).alias("media_type"), text.file_kind(F.col("path")).alias("file_type"), "content")
    made = media.parts(files.filter(media.embedded(F.col("file_type"), F.col("extension"))))
    sha = F.when(F.col("media_type") != "application/pdf", F.sha2("content", 256)).alias("sha256")
    return made.select(F.col("file_id").alias("doc_id"), "chunk_index", "media_type", "page_start", "page_end", sha)


@query(f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CASE WHEN x = '' THEN 'last' ELSE x || chr(10) || 'last' END WHEN 1 THEN CASE WHEN x = '' THEN 'ten' ELSE x || chr(10) || 'ten' END WHEN 2 THEN substr(x || chr(9) || '7', 1, 8000) END AS text,
  CASE WHEN doc_id % 5 > 2 THEN 'ERR_EXTRACTION_FAILED' END AS error FROM (SELECT doc_id, {_PLAIN} AS x FROM documents)""", relations=False)
def office_text(s, d):
    """Word, slides by number and sheets with shared strings; broken and old formats fail with a code."""
    def packed(k: int, x: str) -> bytes:
        b = io.BytesIO()
        if k > 2:
            return b"not an archive"
        with zipfile.ZipFile(b, "w") as z:
            if k == 0:
                z.writestr("word/document.xml", f'<w:d xmlns:w="w"><w:p><w:t>{x[:20]}</w:t><w:t>{x[20:]}</w:t></w:p><w:p><w:t>last</w:t></w:p></w:d>')
            elif k == 1:
                for n, t in ((10, "ten"), (2, x)):
                    z.writestr(f"ppt/slides/slide{n}.xml", f'<a xmlns:a="a"><a:p><a:t>{t}</a:t></a:p></a>')
            else:
                z.writestr("xl/sharedStrings.xml", f"<sst><si><t>{x}</t></si></sst>")
                z.writestr("xl/worksheets/sheet1.xml", '<w><row><c t="s"><v>0</v></c><c><v>7</v></c></row></w>')
        return b.getvalue()

    def write(frames):
        for rows in frames:
            k = rows["doc_id"] % 5
            yield pd.DataFrame({"file_id": rows["doc_id"], "extension": [(".docx", ".pptx", ".xlsx", ".docx", ".rtf")[n] for n in k], "content": [packed(n, x) for n, x in zip(k, rows["x"], strict=True)]})

    files = _plain(s, d).mapInPandas(write, "file_id long, extension string, content binary")
    return documents.extract(files).select(F.col("file_id").alias("doc_id"), "text", "error")


@query("SELECT user_id, count(*) > 0 AND min(value) >= 0.995 * max(value) AS still FROM events GROUP BY user_id", relations=False)
def still_frames(s, d):
    e = src.table(s, d, "events").groupBy("user_id").agg(F.min("value").alias("a"), F.max("value").alias("z"))
    return e.select("user_id", text.still(F.array("a", "z")).alias("still"))


# --- indexing


@query("""+
c AS (SELECT doc_id AS file_id, CASE WHEN doc_id % 10 = 0 THEN substr(coalesce(text, ''), 1, 50) ELSE coalesce(text, '') END AS x FROM documents),
n AS (SELECT file_id, octet_length(encode(x)) AS len FROM c)
SELECT file_id, CASE WHEN len > 0 THEN 1 + greatest(0, CAST(ceil((len - 2000) / 1800.0) AS BIGINT)) ELSE 0 END AS n_chunks FROM n WHERE len > 0""")
def reindex_replaces_chunks(s, d):
    """Files that shrank, indexed again: none of their old chunks stays."""
    f = src.files(s, d, text=True).withColumn("text", F.coalesce("text", F.lit("")))
    made = lambda x, column: x.select("file_id", F.explode(text.byte_chunks(F.col(column).cast("binary"))).alias("c")).select("file_id", F.concat(F.lit("f"), F.col("file_id").cast("string"), F.lit("-c"), F.col("c.chunk_index").cast("string")).alias("vector_id"))
    again = f.filter(F.col("file_id") % 10 == 0).withColumn("text", F.substring("text", 1, 50))
    out = tables.replace_chunks(made(f, "text"), again, made(again, "text"))
    return out.groupBy("file_id").agg(F.count_distinct("vector_id").alias("n_chunks"))


@query("SELECT file_id, CASE WHEN file_id % 4 = 0 AND file_id % 8 <> 0 THEN '' WHEN file_id % 8 = 0 THEN 'new' ELSE content_hash END AS content_hash FROM files")
def two_phase_commit(s, d):
    """Pending rows have no hash; only those whose chunks were stored get theirs."""
    f = src.files(s, d)
    pending = f.filter(F.col("file_id") % 4 == 0).drop("file_id").withColumns({"content_hash": F.lit(""), "seq": F.lit(1)})
    files = tables.upsert_files(f, pending)
    done = f.filter(F.col("file_id") % 8 == 0).select("file_id", F.lit("new").alias("content_hash"))
    return tables.set_hashes(files, done).select("file_id", "content_hash")


@query("""SELECT file_id, basename, parent, stem, content_hash, (SELECT count(*) FROM chunks) AS unnamed, '[2, 3, 4, 5]' AS steps FROM files""")
def migrations_applied(s, d):
    """A store from before versions were recorded, brought up step by step."""
    store = tables.Store(s, tables.scratch(s, "migrate"))
    store.write("files", src.files(s, d).drop("basename", "parent", "stem"))
    store.write("chunks", src.chunks(s, d).drop("embedding", "embedding_model", "embedding_dims"))
    steps = migrations.migrate(store)
    unnamed = store.read("chunks").filter("embedding_model = '' and embedding is null and embedding_dims = 0").count()
    return store.read("files").select("file_id", "basename", "parent", "stem", "content_hash", F.lit(unnamed).cast("long").alias("unnamed"), F.lit(str(steps)).alias("steps"))


@query("""WITH k AS (SELECT DISTINCT source AS key FROM documents WHERE source IS NOT NULL) SELECT key, CASE WHEN key = 'src1' THEN 'changed' ELSE 'v' END AS value FROM k WHERE key <> 'added' UNION ALL SELECT 'added', 'x'""", relations=False)
def settings_put(s, d):
    kept = src.table(s, d, "documents").filter("source is not null").select(F.col("source").alias("key"), F.lit("v").alias("value")).distinct()
    return tables.put_setting(tables.put_setting(tables.put_setting(kept, "src1", "changed"), "added", "w"), "added", "x")


@query("""SELECT DISTINCT '/corpus/' || source AS path FROM documents WHERE source IS NOT NULL AND source <> 'src2' UNION SELECT '/new'""", relations=False)
def folder_list(s, d):
    names = src.table(s, d, "documents").filter("source is not null").select(F.concat(F.lit("/corpus/"), "source").alias("path")).distinct()
    return tables.without_name(tables.with_name(tables.with_name(names, "/new"), "/corpus/src1"), "/corpus/src2")


@query("SELECT greatest(count(DISTINCT path) - 20, 0) AS dropped FROM failures")
def failures_dropped(s, d):
    return reports.dropped(src.failures(s, d), 20)


@query("""SELECT count(*) AS n, CAST(sum(greatest(length(basename) - 2, 0) + greatest(length(parent) - 2, 0) + greatest(length(stem) - 2, 0) + greatest(length(extension) - 2, 0)) AS BIGINT) AS length
FROM files WHERE file_id % 5 <> 0""")
def filename_figures(s, d):
    """The corpus figures of filename scores, kept up to date by what came and went."""
    f = src.files(s, d)
    part = lambda *rest: f.filter(F.col("file_id").isNotNull() & (F.col("file_id") % 5).isin(*rest))
    return filenames.adjusted(filenames.figures(part(0, 1, 2)), part(3, 4), part(0))


@query(f"{_bm25('doc_12')} SELECT file_id, round(raw, 6) AS raw, round(1 / (1 + greatest(0, -raw)), 6) AS score FROM b")
def filename_bm25_postings(s, d):
    """The scores of a phrase by stored postings, built of some files, with others added, replaced and taken out."""
    f = src.files(s, d)
    index = NameIndex(s, tables.scratch(s, "names"))
    wrong = f.filter("file_id % 5 < 2").withColumn("basename", F.when(F.col("file_id") % 5 == 0, F.lit("doc_12 doc_12")).otherwise(F.col("basename")))
    extra = f.filter("file_id % 7 = 0").withColumn("file_id", -1 - F.col("file_id"))
    index.build(wrong.unionByName(extra))
    index.update(added=f.filter("file_id % 5 >= 2"), removed=extra)
    index.update(added=f.filter("file_id % 5 = 0"), removed=wrong.filter("file_id % 5 = 0"))
    return filenames.bm25(f, "doc_12", index).select("file_id", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"))


# --- the stored index

_KEPT = """
kept AS (SELECT vector_id, file_id, embedding FROM chunks WHERE chunk_index % 3 <> 0 OR chunk_index = 0),
now AS (SELECT vector_id, file_id, CASE WHEN file_id % 20 = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM kept)"""


def _index(s, d) -> VectorIndex:
    """Built of some chunks, with others added and replaced, and some deleted again."""
    c = src.chunks(s, d).select("vector_id", "file_id", "embedding", "chunk_index")
    index = VectorIndex(s, tables.scratch(s, "index"))
    index.build(c.filter("chunk_index < 6"))
    index.add(c.filter("chunk_index >= 6"))
    index.add(c.filter("file_id % 20 = 0").withColumn("embedding", F.reverse("embedding")))
    index.delete(c.filter("chunk_index % 3 = 0 and chunk_index > 0"))
    return index


@query(f"""+ {_KEPT} SELECT vector_id, file_id, round(1 - greatest(least(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 1), -1), 6) AS distance FROM now, query_vector
ORDER BY 1 - greatest(least(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 1), -1), vector_id LIMIT 25""")
def index_search(s, d):
    index = _index(s, d)
    index.save()
    again = VectorIndex(s, index.store.root)  # loaded from what was saved
    return again.search(src.query_vector(s, d), 25).select("vector_id", "file_id", F.round("distance", 6).alias("distance"))


@query(f"+ {_KEPT} SELECT vector_id, vector_id IN (SELECT vector_id FROM now) AS has FROM chunks UNION ALL SELECT 'nobody', false")
def index_has(s, d):
    ids = src.chunks(s, d).select("vector_id").union(s.createDataFrame([("nobody",)], "vector_id string"))
    return _index(s, d).has(ids)


# --- the engine

_BEST_OF = """+
scored AS (SELECT c.file_id, c.vector_id, 1 - greatest(least(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 1), -1) AS distance FROM chunks c, query_vector WHERE embedding_model IN ('', 'model-b')),
best AS (SELECT file_id, min(distance) AS distance FROM scored GROUP BY file_id)"""


def _engine(s, d, model: str) -> Engine:
    return Engine(s, src.files(s, d), src.chunks(s, d), embed=lambda _: src.query_vector(s, d), model=model)


@query(f"""{_BEST_OF} SELECT path, 'content' AS match_kind, 'content' AS kind FROM best JOIN files USING (file_id) WHERE extension IN ('.md', '.py') ORDER BY round(best.distance, 9), path LIMIT 20""")
def engine_search(s, d):
    """A whole search: parsed filters, the model's chunks, ranking."""
    hits, how = _engine(s, d, "model-b").search("ext:md,py where is the report about rivers", 20, now=NOW)
    return hits.select("path", "match_kind", F.lit(how["kind"]).alias("kind"))


def _indexed(s, d) -> Engine:
    e = _engine(s, d, "model-b")
    e.settings = tables.put_setting(e.settings, "brute_force_threshold", "2")
    e.build_index(8)
    return e


@query(f"""{_BEST_OF} SELECT path, 'content' AS match_kind, 'semantic' AS strategy FROM best JOIN files USING (file_id) ORDER BY round(best.distance, 9), path LIMIT 20""")
def engine_search_indexed(s, d):
    """A search without filters, by the stored index."""
    hits, how = _indexed(s, d).search("where is the report about rivers", 20, now=NOW)
    return hits.select("path", "match_kind", F.lit(how["strategy"]).alias("strategy"))


@query(f"""{_BEST_OF} SELECT path, 'content' AS match_kind, 'post_filter' AS strategy FROM best JOIN files USING (file_id) WHERE extension IN ('.md', '.py') ORDER BY round(best.distance, 9), path LIMIT 20""")
def engine_search_post_filter(s, d):
    """A search by the stored index with a filter that leaves more files than are compared exactly."""
    hits, how = _indexed(s, d).search("ext:md,py where is the report about rivers", 20, now=NOW)
    return hits.select("path", "match_kind", F.lit(how["strategy"]).alias("strategy"))


@query("SELECT CASE WHEN count(*) > 0 AND count(*) FILTER (WHERE embedding_model IN ('', 'model-x')) = 0 THEN 'ERR_MODEL_MISMATCH' ELSE 'OK' END AS outcome FROM chunks")
def engine_model_mismatch(s, d):
    try:
        _engine(s, d, "model-x").search("where is the report about rivers", 5, now=NOW)
        outcome = "OK"
    except vectors.ModelMismatch as e:
        outcome = str(e)
    return s.createDataFrame([(outcome,)], "outcome string")


@query("SELECT file_id, path FROM files WHERE size_bytes > 500 AND starts_with(path, '/corpus/src1') AND extension IN ('.md', '.py')")
def stored_source(s, d):
    """A stored table read as a data source, by a view in SQL whose filters are pushed."""
    store = tables.Store(s, tables.scratch(s, "stored"))
    store.write("files", src.files(s, d).repartitionByRange(4, "path").sortWithinPartitions("path"))
    stored.register(s)
    s.sql(f"CREATE OR REPLACE TEMPORARY VIEW stored_files USING tessella OPTIONS (root '{store.root}', table 'files')")
    return s.sql("SELECT file_id, path FROM stored_files WHERE size_bytes > 500 AND path LIKE '/corpus/src1%' AND extension IN ('.md', '.py')")


# --- streams


def _stream(s, d, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is a file or a folder of files."""
    batch = src.table(s, d, name)
    return s.readStream.schema(batch.schema).option("pathGlobFilter", f"{name}.parquet" if batch.inputFiles()[0].endswith(f"/{name}.parquet") else "*.parquet").parquet(d if batch.inputFiles()[0].endswith(f"/{name}.parquet") else f"{d}/{name}.parquet")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, ['created', 'modified', 'deleted'][event_id % 4 + 1] AS type, ts FROM events WHERE event_id % 4 < 3)
SELECT path, CASE WHEN arg_max(type, ts) = 'deleted' THEN 'remove' ELSE 'index' END AS action FROM e GROUP BY path""", relations=False)
def watch_events_applied(s, d):
    """The events table as a stream, applied in one batch: what was indexed and removed."""
    op = F.element_at(F.array(*map(F.lit, ("CREATE", "write", "rename", "chmod"))), (F.col("event_id") % 4 + 1).cast("int"))
    raw = _stream(s, d, "events").select(F.col("user_id").cast("string").alias("path"), op.alias("op"), F.col("ts").cast("timestamp").alias("ts"))
    store, out = tables.Store(s, tables.scratch(s, "watch")), {}

    def keep(action):
        def add(paths):
            out[action] = store.write(action, paths.withColumn("action", F.lit(action)))

        return add

    stream = watch.apply_events(watch.file_events(raw), keep("index"), keep("remove"), f"{store.root}/progress")
    stream.awaitTermination()
    return out["index"].unionByName(out["remove"])


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (
  SELECT user_id, event_id, t, k, true AS admitted, [t] AS held FROM e WHERE k = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.t, e.k, len(list_filter(r.held, lambda h: h > e.t - 3600000000)) < 5,
    CASE WHEN len(list_filter(r.held, lambda h: h > e.t - 3600000000)) < 5 THEN list_append(list_filter(r.held, lambda h: h > e.t - 3600000000), e.t) ELSE list_filter(r.held, lambda h: h > e.t - 3600000000) END
  FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1
)
SELECT CAST(user_id AS VARCHAR) AS key, t AS us, admitted FROM r""", relations=False)
def rate_admission(s, d):
    """The requests as a stream through the limiter, at most 5 an hour for each user."""
    requests = _stream(s, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    root = tables.scratch(s, "rates")
    stream = watch.admitted(requests, 5, 3600.0).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress").outputMode("append").trigger(availableNow=True).start()
    stream.awaitTermination()
    return s.read.schema("key string, ts timestamp, admitted boolean").parquet(f"{root}/out").select("key", F.unix_micros("ts").alias("us"), "admitted")


@query("""SELECT seq FROM failures WHERE seq % 3 = 1 AND path NOT LIKE '%7' AND (code = 'ERR_RATE_LIMITED' OR (code IN ('ERR_EMBED_FAILED', 'ERR_HNSW_ADD', 'ERR_STORE_WRITE') AND 1 + seq % 4 < 3
AND last_failed_at + INTERVAL 1 SECOND * (CASE seq % 4 WHEN 0 THEN 1 ELSE 2 END) <= TIMESTAMP '2024-01-15')) AND (code <> 'ERR_RATE_LIMITED' OR 1 + seq % 4 < 3)""")
def retries_due(s, d):
    """The retries due at a time, after a pause, of the running generation and without cancelled paths."""
    f = src.failures(s, d).withColumns({"attempts": (1 + F.col("seq") % 4).cast("int"), "failed_at": F.col("last_failed_at"), "generation": (F.col("seq") % 3).cast("int")})
    queue = watch.reschedule(f).filter(~F.col("recorded"))
    return watch.due_retries(queue, "2024-01-15 00:00:00", 1, f.filter(F.col("path").endswith("7")), True).select("seq")


def _ran(df: DataFrame, root: str, schema: str, done=None) -> DataFrame:
    """What a stream gives: over all there is, or until done(query)."""
    out = df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress").outputMode("append")
    stream = (out.trigger(processingTime="0 seconds") if done else out.trigger(availableNow=True)).start()
    try:
        if done:
            done(stream)
        else:
            stream.awaitTermination()
    finally:
        stream.stop()
    return df.sparkSession.read.schema(schema).parquet(f"{root}/out")


@query("""SELECT CAST(user_id AS VARCHAR) AS path, arg_max(event_type, (ts, event_type)) AS type, epoch_us(max(ts)) AS us, count(*) AS n FROM events GROUP BY user_id""", relations=False)
def debounce_timers(s, d):
    """The events as one burst: each path's last one leaves by its timer, with no later event in the stream."""
    events = _stream(s, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("type"), F.col("ts").cast("timestamp").alias("ts"))
    out = _ran(timers.debounced(events, 1.0), tables.scratch(s, "debounce"), "path string, type string, ts timestamp, n long", lambda q: timers.settled(q, 300))
    return out.select("path", "type", F.unix_micros("ts").alias("us"), "n")


@query("""+ f AS (SELECT seq, path, code, 1 + seq % 4 AS attempts, code IN ('ERR_EMBED_FAILED', 'ERR_HNSW_ADD', 'ERR_STORE_WRITE', 'ERR_RATE_LIMITED') AND 1 + seq % 4 < 3 AS again FROM failures)
SELECT path, code, CAST(attempts AS INTEGER) AS attempts, 'record' AS action FROM f WHERE NOT again
UNION ALL SELECT path, code, CAST(attempts + 1 AS INTEGER), 'retry' FROM (SELECT path, max_by(code, seq) AS code, max_by(attempts, seq) AS attempts, max_by(again, seq) AS again FROM f GROUP BY path) WHERE again""")
def retries_coordinated(s, d):
    """All failures at once through the retry coordinator: what is recorded, and the path's last one where that is tried again."""
    e = _stream(s, d, "events").filter("event_id is not null")
    codes = F.array(*map(F.lit, sorted(RETRY)))
    failed = e.select(
        F.col("event_id").alias("seq"), F.lit("failed").alias("kind"), F.concat(F.lit("/corpus/user_"), F.col("user_id").cast("string")).alias("path"), F.element_at(codes, (F.col("event_id") % 9 + 1).cast("int")).alias("code"),
        (1 + F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(1).cast("long").alias("generation"), F.lit(None).cast("timestamp").alias("until"),
    )
    root = tables.scratch(s, "retries")
    marks = []

    def quiet(q) -> None:  # its state holds the generation, so it is never empty
        until = time.monotonic() + 300
        while time.monotonic() < until and len(marks) < 20:
            p = q.lastProgress
            marks.extend([p["batchId"]] if p and p["batchId"] > 0 and not p["numInputRows"] and p["batchId"] not in marks else [])
            if p and time.monotonic() > until - 300 + 8 and len(marks) >= 3:
                break
            time.sleep(0.1)

    return _ran(timers.coordinated(failed, backoff=0.1, parts=4), root, timers.JOB, quiet).select("path", "code", "attempts", "action")


_KEEP = 20


@query(f"""WITH RECURSIVE failures AS (SELECT event_id AS seq, '/corpus/user_' || user_id AS path,
    ['ERR_EMBED_COUNT_MISMATCH', 'ERR_EMBED_FAILED', 'ERR_EXTRACTION_FAILED', 'ERR_FILE_TOO_LARGE', 'ERR_FILE_UNREADABLE', 'ERR_HNSW_ADD', 'ERR_RATE_LIMITED', 'ERR_STORE_WRITE', 'ERR_UNSUPPORTED_FORMAT'][event_id % 9 + 1] AS code FROM events),
f AS (SELECT path, row_number() OVER (ORDER BY seq) AS k FROM failures),
r AS (
  SELECT k, [{{'path': path, 'place': 0::BIGINT}}] AS kept, 1::BIGINT AS next FROM f WHERE k = 1
  UNION ALL
  SELECT f.k, CASE WHEN len(list_filter(r.kept, lambda x: x.path = f.path)) > 0 THEN r.kept
    ELSE list_append(CASE WHEN len(r.kept) = {_KEEP} THEN r.kept[2:] ELSE r.kept END, {{'path': f.path, 'place': r.next}}) END,
    r.next + CASE WHEN len(list_filter(r.kept, lambda x: x.path = f.path)) > 0 THEN 0 ELSE 1 END
  FROM r JOIN f ON f.k = r.k + 1
), l AS (SELECT unnest(kept) AS e FROM (SELECT kept FROM r ORDER BY k DESC LIMIT 1))
SELECT e.path AS path, e.place AS place, c.code AS code FROM l JOIN (SELECT path, max_by(code, seq) AS code FROM failures GROUP BY path) c ON c.path = e.path""", relations=False)
def failure_registry_stream(s, d):
    """The failures as a stream through the registry, first in, first out at {_KEEP} paths; what stands at its end."""
    codes = F.array(*map(F.lit, sorted(RETRY)))
    failed = _stream(s, d, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("/corpus/user_"), F.col("user_id").cast("string")).alias("path"), F.element_at(codes, (F.col("event_id") % 9 + 1).cast("int")).alias("code"),
        F.lit("").alias("message"), F.lit(1).alias("attempts"), F.col("ts").cast("timestamp").alias("last_failed_at"),
    )
    root = tables.scratch(s, "registry")
    failed.writeStream.foreachBatch(registry.keep(root, _KEEP)).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return timers.standing(registry.changes(s, root)).filter("path is not null").select("path", "place", "code")


# --- the query language: golden tables, dealt over the turns of the conversations

_DAY = lambda *ymd: int((datetime(*ymd) - datetime(1970, 1, 1)).total_seconds())
#: Query, meaning, and its clauses as field, operator and value (now is 2024-01-20 12:00).
SPECS = [
    ("kind:image cats", "cats", "file_type eq image"), ("ext:py some function", "some function", "extension in_set .py"), ("size:<500kb report", "report", "size_bytes lt 512000"),
    ("size:>=1.5mb", "", "size_bytes gte 1572864"), ("kind:imgae x", "x", "file_type eq image"), ("ext: pdf,txt notes", "notes", "extension in_set .pdf|.txt"), ("in:src notes", "notes", "path contains src"),
    ("-draft kind:video x", "x", "file_type eq video & not path contains draft"), ('-path:tmp "big report"', "big report", "not path contains tmp"), ("kind:zzz foo", "kind:zzz foo", ""),
    ("my vacation photos from today", "my vacation", f"file_type eq image & modified_at gte {_DAY(2024, 1, 20)}"), ("find pictures", "find pictures", ""), ("all my photos", "", "file_type eq image"),
    ("documents since last month", "", f"file_type eq document & modified_at gte {_DAY(2023, 12, 20)}"), ("before:2023-05-01 plan", "plan", "modified_at lt 2023-05-01T00:00:00Z"),
    ("after:yesterday plan", "plan", "modified_at gte 2024-01-19T00:00:00Z"), ("report from last week", "report", f"modified_at gte {_DAY(2024, 1, 13)} & modified_at lte {_DAY(2024, 1, 20, 12)}"),
    ("the deck created in 2022", "the deck", f"modified_at gte {_DAY(2022, 1, 1)} & modified_at lte {_DAY(2023, 1, 1) - 1}"), ("last week's slides", "slides", f"modified_at gte {_DAY(2024, 1, 13)} & modified_at lte {_DAY(2024, 1, 20, 12)}"),
    ("plain words", "plain words", ""), ("", "", ""),
]


def _clauses(spec: Spec) -> str:
    def shown(c: Clause) -> str:
        v = "|".join(c.value) if isinstance(c.value, list) else c.value.isoformat() + "Z" if isinstance(c.value, datetime) else str(c.value)
        return f"{c.field} {c.op} {v}"

    return " & ".join([*map(shown, spec.must), *("not " + shown(c) for c in spec.must_not)])


def _read(q: pd.Series, stored: bool = False) -> pd.DataFrame:
    specs = [parser.parse(x, NOW) for x in q]
    specs = [Spec.from_json(x.to_json()) for x in specs] if stored else specs
    return pd.DataFrame({"semantic": [x.semantic for x in specs], "clauses": [_clauses(x) for x in specs]})


def _per_batch(df: DataFrame, f, schema: str) -> DataFrame:
    """df (conv_id, turn, q) with f(q)'s columns, batch by batch."""
    def run(frames):
        for rows in frames:
            yield pd.concat([rows[["conv_id", "turn"]].reset_index(drop=True), f(rows["q"])], axis=1)

    return df.mapInPandas(run, f"conv_id long, turn long, {schema}")


@query(_golden(SPECS, "q, semantic, clauses", "semantic, clauses"), relations=False)
def parse_spec(s, d):
    return _per_batch(_turns(s, d, [x[0] for x in SPECS]), _read, "semantic string, clauses string")


@query(_golden(SPECS, "q, semantic, clauses", "semantic, clauses"), relations=False)
def spec_stored(s, d):
    """Specifications written as tagged JSON and read back."""
    return _per_batch(_turns(s, d, [x[0] for x in SPECS]), lambda q: _read(q, True), "semantic string, clauses string")


_END = 86_399
DATES = [
    ("today", _DAY(2024, 1, 20), _DAY(2024, 1, 20, 12)), ("yesterday", _DAY(2024, 1, 19), _DAY(2024, 1, 19) + _END), ("last week", _DAY(2024, 1, 13), _DAY(2024, 1, 20, 12)),
    ("this week", _DAY(2024, 1, 15), _DAY(2024, 1, 20, 12)), ("last month", _DAY(2023, 12, 20), _DAY(2024, 1, 20, 12)), ("past 3 days", _DAY(2024, 1, 17), _DAY(2024, 1, 20, 12)),
    ("two weeks ago", _DAY(2024, 1, 6), _DAY(2024, 1, 20, 12)), ("q3 2023", _DAY(2023, 7, 1), _DAY(2023, 10, 1) - 1), ("december", _DAY(2023, 12, 1), _DAY(2024, 1, 1) - 1),
    ("2023-08", _DAY(2023, 8, 1), _DAY(2023, 9, 1) - 1), ("last friday", _DAY(2024, 1, 12), _DAY(2024, 1, 12) + _END), ("last winter", _DAY(2022, 12, 1), _DAY(2023, 3, 1) - 1),
    ("12-25-2023", _DAY(2023, 12, 25), _DAY(2023, 12, 25) + _END), ("last 5 hours", _DAY(2024, 1, 20, 7), _DAY(2024, 1, 20, 12)), ("next month", _DAY(2024, 2, 1), _DAY(2024, 3, 1) - 1),
    ("02-30-2024", None, None), ("no date", None, None),
]


@query(_golden(DATES, "q, after_, before_", "after_::BIGINT AS after, before_::BIGINT AS before"), relations=False)
def normalize_date(s, d):
    def read(q: pd.Series) -> pd.DataFrame:
        spans = [resolve(x, NOW) for x in q]
        return pd.DataFrame({n: pd.array([parser.seconds(x[k]) if x else None for x in spans], "Int64") for k, n in enumerate(("after", "before"))})

    return _per_batch(_turns(s, d, [x[0] for x in DATES]), read, "after long, before long")


#: Words with the kind and the ending that they are taken for.
TYPOS = [
    ("image", "image", None), ("imgae", "image", None), ("vidoe", "video", None), ("documnet", "document", None), ("zebra", None, None), ("pdff", "document", "pdf"), ("txt", "text", "txt"),
    ("xyzzy", None, None), ("photo", "image", None), ("rs", None, "js"), ("gz", None, "go"),
]


@query(_golden(TYPOS, "q, kind, extension", "kind, extension"), relations=False)
def typo_corrected(s, d):
    read = lambda q: pd.DataFrame({"kind": [parser.near_kind(x) for x in q], "extension": [parser.near_extension(x) for x in q]})
    return _per_batch(_turns(s, d, [x[0] for x in TYPOS]), read, "kind string, extension string")


_GRAMMAR = "kind:image size:>1mb -draft cats"
_MODEL = Spec("dogs", (Clause("size_bytes", "gt", 5), Clause("size_bytes", "lt", 10**9), Clause("file_type", "eq", "video")), (Clause("path", "contains", "draft"), Clause("path", "contains", "old")), (Clause("extension", "eq", ".md", 1.5),))
MERGED = [
    ("", "cats", "file_type eq image & size_bytes gt 1048576 & size_bytes lt 1000000000 & not path contains draft & not path contains old"),
    ("file_type|eq|image", "cats", "size_bytes gt 1048576 & size_bytes lt 1000000000 & not path contains draft & not path contains old"),
    ("path|contains|old", "cats", "file_type eq image & size_bytes gt 1048576 & size_bytes lt 1000000000 & not path contains draft"),
    ("not a key", "cats", "file_type eq image & size_bytes gt 1048576 & size_bytes lt 1000000000 & not path contains draft & not path contains old"),
]


@query(_golden(MERGED, "q, semantic, clauses", "semantic, clauses"), relations=False)
def merge_specs(s, d):
    """The grammar's clauses and a model's, without the denied ones; what is no chip key denies nothing."""
    def read(q: pd.Series) -> pd.DataFrame:
        found = [merge(parser.parse(_GRAMMAR, NOW), _MODEL, deny_list([x])) for x in q]
        return pd.DataFrame({"semantic": [x.semantic for x in found], "clauses": [_clauses(x) for x in found]})

    return _per_batch(_turns(s, d, [x[0] for x in MERGED]), read, "semantic string, clauses string")


CHIPS = [
    ("size:>3mb", "> 3 MB", "size_bytes|gt|3145728"), ("ext:a,b", ".a, .b", 'extension|in_set|[".a",".b"]'), ("-kind:image", "Not Images", "file_type|eq|image"), ("in:src", "Path: src", "path|contains|src"),
    ("after:2024-01-02", "Since Jan 2", f"modified_at|gte|{_DAY(2024, 1, 2)}"), ("words", None, None),
]


@query(_golden(CHIPS, "q, label, key", "label, key"), relations=False)
def chip_labels(s, d):
    def read(q: pd.Series) -> pd.DataFrame:
        first = [next(iter(chips(parser.parse(x, NOW, False))), {}) for x in q]
        return pd.DataFrame({n: [c.get(n) for c in first] for n in ("label", "key")})

    return _per_batch(_turns(s, d, [x[0] for x in CHIPS]), read, "label string, key string")


ORDERS = [
    ("path,size_bytes", "path,size_bytes"), ("nope,extension", "extension"), ("", "modified_at,size_bytes,path,file_type,extension"), ("nope", "modified_at,size_bytes,path,file_type,extension"),
    ("semantic_contains,path", "semantic_contains,path"),
]


@query(_golden(ORDERS, "q, fields", "fields"), relations=False)
def drop_order(s, d):
    read = lambda q: pd.DataFrame({"fields": [",".join(ranking.drop_order(x.split(","))) for x in q]})
    return _per_batch(_turns(s, d, [x[0] for x in ORDERS]), read, "fields string")


#: A model's answer, and the clauses and outcome that come of it for "files over 10mb from yesterday".
ANSWERS = [
    ('{"semantic_query": "files", "must": [{"field": "size_bytes", "op": "gt", "value": "10mb"}, {"field": "nope", "op": "eq", "value": "1"}]}', "size_bytes gt 10485760", "OK"),
    ('{"must": [{"field": "modified_at", "op": "lte", "value": "2024-01-02"}, {"field": "modified_at", "op": "gte", "value": "yesterday"}]}', f"modified_at lte {_DAY(2024, 1, 3) - 1} & modified_at gte {_DAY(2024, 1, 19)}", "OK"),
    ('{"must": [{"field": "extension", "op": "in_set", "value": "py, .md"}], "must_not": [{"field": "path", "op": "contains", "value": "tmp"}]}', "extension in_set .py|.md & not path contains tmp", "OK"),
    ('{"must": []}', f"modified_at gte {_DAY(2024, 1, 19)} & modified_at lte {_DAY(2024, 1, 20) - 1}", "Failed"), ("junk", f"modified_at gte {_DAY(2024, 1, 19)} & modified_at lte {_DAY(2024, 1, 20) - 1}", "Failed"),
]


@query(_golden(ANSWERS, "q, clauses, outcome", "clauses, outcome"), relations=False)
def model_answers(s, d):
    """A language model's answers, read, coerced and validated; unusable ones leave the grammar's reading."""
    def read(q: pd.Series) -> pd.DataFrame:
        found = [parser.model_spec("files over 10mb from yesterday", NOW, lambda _, x=x: x) for x in q]
        return pd.DataFrame({"clauses": [_clauses(f) for f, _ in found], "outcome": [o for _, o in found]})

    return _per_batch(_turns(s, d, [x[0] for x in ANSWERS]), read, "clauses string, outcome string")


@query("SELECT conv_id, turn, lower(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))) AS key FROM conversations", relations=False)
def query_vector_key(s, d):
    """What a query's vector is cached under."""
    return src.table(s, d, "conversations").select("conv_id", "turn", F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"^[ \t\n\r]+|[ \t\n\r]+$", "")).alias("key"))


@query("""WITH p AS (SELECT p_partkey, p_name, instr(p_name, 'a') AS i FROM part)
SELECT p_partkey, CASE WHEN i = 0 THEN p_name ELSE substr(p_name, 1, i - 1) || '[' || substr(p_name, i, 3) || ']' || substr(p_name, i + 3) END AS shown FROM p""", relations=False)
def highlight_split(s, d):
    """Texts cut at overlapping highlights, which are joined first."""
    at = F.instr("p_name", "a") - 1
    spans = F.when(at >= 0, F.array(F.struct((at + 1).alias("start"), (at + 3).alias("end")), F.struct(at.alias("start"), (at + 2).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    parts = scores.segments(F.col("p_name"), scores.merged_ranges(spans, F.length("p_name")))
    shown = F.array_join(F.transform(parts, lambda x: F.when(x["marked"], F.concat(F.lit("["), x["text"], F.lit("]"))).otherwise(x["text"])), "")
    return src.table(s, d, "part").select("p_partkey", shown.alias("shown"))


@query("SELECT p_partkey, damerau_levenshtein(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) AS distance FROM part", relations=False)
def typo_osa(s, d):
    """The distance of each name's first two words."""
    w = F.split("p_name", " ")
    return src.table(s, d, "part").select("p_partkey", scores.edits(F.get(w, F.lit(0)), F.coalesce(F.get(w, F.lit(1)), F.lit(""))).cast("long").alias("distance"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN (conv_id * 7 + turn) % 23 = 5 THEN 'plain words' ELSE 'find me all the notes on topic ' || (conv_id * 7 + turn) % 23 END AS q, (conv_id * 7 + turn) % 23 AS k FROM conversations)
SELECT conv_id, turn, q AS semantic, CASE WHEN k NOT IN (5, 11) THEN 'topic ' || k END AS path, CASE WHEN k = 5 THEN 'Grammar' WHEN k = 11 THEN 'RateLimited' ELSE 'OK' END AS outcome,
  CASE WHEN k IN (5, 11) THEN 'grammar' WHEN k < 9 THEN 'cache' ELSE 'llm' END AS source FROM t""", relations=False)
def queries_understood(s, d):
    """Every turn as a query to a model, after some were asked before: what was answered, and what came from the cache."""
    k = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(23))
    q = F.when(k == 5, "plain words").otherwise(F.concat(F.lit("find me all the notes on topic "), k.cast("string")))
    asked = src.table(s, d, "conversations").select("conv_id", "turn", q.alias("q"))

    def model(prompt: str, schema: dict, temperature: float, left: float) -> str:
        topic = prompt.partition("topic ")[2].split("\n")[0]
        if topic == "11":
            raise ConnectionRefusedError
        return json.dumps({n: [] for n in schema["required"]} | {"must": [{"field": "path", "op": "contains", "value": f"topic {topic}"}]})

    store = tables.Store(s, tables.scratch(s, "understood"))
    understanding.understand(asked.filter(k < 9), "q", model, store, NOW, budget=60.0)
    out = understanding.understand(asked, "q", model, store, NOW, budget=60.0)
    return out.select("conv_id", "turn", F.get_json_object("spec", "$.semantic_query").alias("semantic"), F.get_json_object("spec", "$.must[0].value.v").alias("path"), "outcome", "source")

