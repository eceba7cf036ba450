"""Registered queries over the benchmark tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scores, text
from tessella.operators import filenames, ranking, reports, tables, vectors
from tessella.plans import parser
from tessella.plans.clauses import Clause, Spec, chips, refine, where
from tessella.sources import embedding
from tessella.sources import tables as src
from tessella.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = datetime(2024, 1, 20, 12, 0)
RECENT = Clause("modified_at", "gte", parser.seconds(datetime(2024, 1, 10)))


def query(sql: str | None = None, relations: bool = True):
    """Register a function under its name; sql may use the relations of sources.tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {src.SQL.strip()}{',' if sql.lstrip().startswith('+') else ''}\n{sql.lstrip().removeprefix('+')}" if relations else sql
        return f

    return add


def _files(s, d, *clauses: Clause, must_not: tuple[Clause, ...] = ()) -> DataFrame:
    return src.files(s, d).filter(where(Spec("", clauses, must_not)))


# --- filters


@query("SELECT file_id, path, size_bytes FROM files WHERE size_bytes >= 1000 AND NOT contains(lower(path), 'src1')")
def filter_must_mustnot(s, d):
    return _files(s, d, Clause("size_bytes", "gte", 1000), must_not=(Clause("path", "contains", "src1"),)).select("file_id", "path", "size_bytes")


@query("SELECT file_id, extension FROM files WHERE extension IN ('.md', '.pdf')")
def filter_in_set(s, d):
    return _files(s, d, Clause("extension", "in_set", [".md", ".pdf"])).select("file_id", "extension")


@query("SELECT CAST(count(*) FILTER (WHERE false) AS BIGINT) AS n FROM files")
def filter_in_set_empty(s, d):
    return _files(s, d, must_not=(Clause("extension", "in_set", []),)).agg(F.count("*").alias("n"))


@query("SELECT file_id, CAST(epoch(modified_at) AS BIGINT) AS modified FROM files WHERE modified_at >= TIMESTAMP '2024-01-10' AND modified_at < TIMESTAMP '2024-01-20 12:00:00'")
def filter_date_unix(s, d):
    return _files(s, d, RECENT, Clause("modified_at", "lt", NOW)).select("file_id", F.unix_timestamp("modified_at").alias("modified"))


@query("SELECT file_id, path FROM files WHERE contains(lower(path), '/src1/en')")
def filter_contains_ci(s, d):
    return _files(s, d, Clause("path", "contains", "/SRC1/En")).select("file_id", "path")


@query("SELECT file_id, file_type FROM files WHERE file_type <> 'text'")
def filter_neq(s, d):
    return _files(s, d, Clause("file_type", "neq", "text")).select("file_id", "file_type")


@query("SELECT file_type, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM files WHERE size_bytes > 500 AND size_bytes <= 5000 GROUP BY file_type")
def count_filtered(s, d):
    return _files(s, d, Clause("size_bytes", "gt", 500), Clause("size_bytes", "lte", 5000)).groupBy("file_type").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query("SELECT file_id, path FROM files WHERE size_bytes > 2000 AND NOT (extension = '.py') AND modified_at >= TIMESTAMP '2024-01-10'")
def client_filter(s, d):
    spec = Spec("", (Clause("size_bytes", "gt", 2000), RECENT, Clause("file_type", "eq", "video")), (Clause("extension", "eq", ".py"),), (Clause("extension", "eq", ".md", 2.0),))
    return src.files(s, d).filter(refine(chips(spec), frozenset({"file_type|eq|video"}))).select("file_id", "path")


@query("SELECT file_id, path FROM files WHERE path = '/corpus/src1' OR starts_with(path, '/corpus/src1/')")
def path_containment(s, d):
    return src.files(s, d).filter(text.inside(F.col("path"), "/corpus/src1/")).select("file_id", "path")


@query("SELECT file_id, basename, parent, stem FROM files")
def path_parts(s, d):
    return src.files(s, d).select("file_id", "basename", "parent", "stem")


# --- vectors

_DIST = "1 - greatest(least(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 1), -1)"
_BEST = f"""+
scored AS (SELECT c.* EXCLUDE (embedding), {_DIST} AS distance FROM chunks c, query_vector),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY distance, vector_id) AS r FROM scored) WHERE r = 1)"""


def _near(s, d, spec: Spec | None = None, k: int = 20, model: str | None = None) -> DataFrame:
    return vectors.nearest_files(src.files(s, d), src.chunks(s, d), src.query_vector(s, d), spec, k, model)


@query(f"{_BEST} SELECT file_id, path, vector_id, round(distance, 6) AS distance FROM best JOIN files USING (file_id) ORDER BY best.distance, path LIMIT 20")
def knn_exact(s, d):
    return _near(s, d).select("file_id", "path", "vector_id", F.round("distance", 6).alias("distance"))


@query(f"{_BEST} SELECT file_id, path, vector_id, round(distance, 6) AS distance FROM best JOIN files USING (file_id) WHERE size_bytes >= 1000 AND NOT contains(lower(path), 'src1') ORDER BY best.distance, path LIMIT 20")
def knn_filtered(s, d):
    spec = Spec("", (Clause("size_bytes", "gte", 1000),), (Clause("path", "contains", "src1"),))
    return _near(s, d, spec).select("file_id", "path", "vector_id", F.round("distance", 6).alias("distance"))


@query(f"{_BEST} SELECT file_id, vector_id, round(distance, 6) AS distance FROM best")
def best_chunk_per_file(s, d):
    return vectors.best_chunks(vectors.distances(src.chunks(s, d), src.query_vector(s, d))).select("file_id", "vector_id", F.round("distance", 6).alias("distance"))


@query("""+
qs AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 25 = 0),
r AS (SELECT query_id, vector_id, file_id, 1 - greatest(least(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 1), -1) AS distance FROM qs, chunks),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vector_id) AS rank FROM r)
SELECT query_id, vector_id, file_id, round(distance, 6) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def knn_batch(s, d):
    queries = src.table(s, d, "embeddings").filter(F.col("vec_id") % 25 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = vectors.nearest_batch(queries, src.chunks(s, d), 10)
    return near.select("query_id", "vector_id", "file_id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


@query(f"""{_BEST.replace("query_vector)", "query_vector WHERE embedding_model IN ('', 'model-b'))")}
SELECT file_id, vector_id, embedding_model, round(distance, 6) AS distance FROM best JOIN files USING (file_id) ORDER BY best.distance, path LIMIT 20""")
def model_gate(s, d):
    return _near(s, d, model="model-b").select("file_id", "vector_id", "embedding_model", F.round("distance", 6).alias("distance"))


@query("SELECT embedding_model, count(*) AS n FROM chunks WHERE embedding_model <> '' GROUP BY embedding_model")
def models_distinct(s, d):
    return tables.models(src.chunks(s, d))


_RERANK = Spec("", (RECENT,), (), (Clause("extension", "eq", ".md", 1.5), Clause("file_type", "contains", "doc", 1.25), Clause("path", "eq", "x", 9.0)))


@query(f"""{_BEST},
near AS (SELECT * EXCLUDE (r) FROM best JOIN files USING (file_id) ORDER BY best.distance, path LIMIT 50),
f AS (SELECT *, (1 - distance / 2) * CASE WHEN extension = '.md' THEN 1.5 ELSE 1 END * CASE WHEN contains(file_type, 'doc') THEN 1.25 ELSE 1 END * CASE WHEN modified_at >= TIMESTAMP '2024-01-10' THEN 1.2 ELSE 1 END AS score FROM near)
SELECT file_id, path, round(score, 6) AS final_score, CAST(row_number() OVER (ORDER BY score DESC, path) AS INTEGER) AS rank FROM f""")
def rerank_boost_recency(s, d):
    out = ranking.rerank(_near(s, d, k=50), _RERANK)
    return ranking.ranked(out, F.desc("final_score"), "path").select("file_id", "path", F.round("final_score", 6).alias("final_score"), "rank")


_RELAX = Spec("", (Clause("extension", "eq", ".md"), Clause("size_bytes", "gt", 10**9), Clause("modified_at", "lt", parser.seconds(datetime(1990, 1, 1)))), (Clause("path", "contains", "/de/"),))


@query("SELECT file_id, path, 'size filter' AS banner FROM files WHERE extension = '.md' AND NOT contains(lower(path), '/de/')")
def relaxation_ladder(s, d):
    out, note = ranking.relaxed(src.files(s, d), _RELAX)
    return out.select("file_id", "path", F.lit(note).alias("banner"))


@query("""SELECT level, count(*) AS n FROM (
SELECT CASE WHEN extension <> '.md' THEN 3 WHEN NOT (size_bytes > 1000) THEN 2 WHEN NOT (modified_at >= TIMESTAMP '2024-01-10') THEN 1 ELSE 0 END AS level FROM files) GROUP BY level""")
def relaxation_levels(s, d):
    spec = Spec("", (Clause("extension", "eq", ".md"), Clause("size_bytes", "gt", 1000), RECENT))
    return ranking.relaxation_levels(src.files(s, d), spec).groupBy("level").agg(F.count("*").alias("n"))


@query("SELECT 'size' AS filter, count(*) AS n, CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) < 5000 THEN 'brute_force' ELSE 'post_filter' END AS strategy FROM files WHERE size_bytes > 500 UNION ALL SELECT 'none', count(*), CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) < 5000 THEN 'brute_force' ELSE 'post_filter' END FROM files WHERE size_bytes < 0")
def planner_strategy(s, d):
    rows = []
    for name, clause in (("size", Clause("size_bytes", "gt", 500)), ("none", Clause("size_bytes", "lt", 0))):
        n = _files(s, d, clause).count()
        rows.append((name, n, vectors.strategy(n)))
    return s.createDataFrame(rows, "filter string, n long, strategy string")


@query("SELECT file_type, count(*) AS matching, greatest(64, least(500, 20 * 10 * (SELECT count(*) FROM files) // count(*)))::BIGINT AS width FROM files GROUP BY file_type")
def ef_clamp(s, d):
    f = src.files(s, d)
    total = f.count()
    rows = [(r["file_type"], r["count"], vectors.search_width(20, 10, total, r["count"])) for r in f.groupBy("file_type").count().collect()]
    return s.createDataFrame(rows, "file_type string, matching long, width long")


# --- filenames


@query("SELECT file_id, path, 1.0::DOUBLE AS score FROM files WHERE lower(basename) = 'doc_17.py'")
def filename_exact(s, d):
    return filenames.exact(src.files(s, d), "DOC_17.PY").select("file_id", "path", "score")


@query("SELECT file_id, path FROM files WHERE contains(lower(path), 'doc_1') ORDER BY path LIMIT 50")
def filename_contains(s, d):
    return filenames.substring(src.files(s, d), "Doc_1").select("file_id", "path")


@query("SELECT file_id, path, 0.8::DOUBLE AS score FROM files WHERE regexp_matches(path, '^/corpus/src.*/en/doc_..\\.md$') ORDER BY modified_at DESC, path LIMIT 30")
def filename_glob(s, d):
    return filenames.glob(src.files(s, d), "/corpus/SRC*/en/doc_??.md", 30).select("file_id", "path", "score")


_BM25 = """+
t AS (SELECT file_id, path, basename, 10 * tf(basename) + 3 * tf(parent) + 5 * tf(stem) + 2 * tf(extension) AS tf,
  greatest(length(basename) - 2, 0) + greatest(length(parent) - 2, 0) + greatest(length(stem) - 2, 0) + greatest(length(extension) - 2, 0) AS len FROM files),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE tf > 0) AS hits, avg(len) AS mean FROM t),
b AS (SELECT file_id, path, basename, -greatest(ln((n - hits + 0.5) / (hits + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS raw FROM t, c WHERE tf > 0)"""


def _bm25(phrase: str) -> str:
    import re

    return re.sub(r"tf\((\w+)\)", rf"((length(\1) - length(replace(lower(\1), '{phrase}', ''))) / {len(phrase)})", _BM25)


@query(f"{_bm25('doc_12')} SELECT file_id, round(raw, 6) AS raw, round(1 / (1 + greatest(0, -raw)), 6) AS score FROM b")
def filename_bm25(s, d):
    return filenames.bm25(src.files(s, d), "DOC_12").select("file_id", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"))


@query(f"""{_bm25('doc_1.py')} SELECT file_id, path, match_kind FROM (
SELECT file_id, path, 'exact' AS match_kind, 0 AS leg, 0 AS raw FROM files WHERE lower(basename) = 'doc_1.py'
UNION ALL SELECT file_id, path, 'substring', 1, raw FROM b WHERE lower(basename) <> 'doc_1.py') ORDER BY leg, raw, path LIMIT 20""")
def filename_phrase(s, d):
    return filenames.phrase_hits(src.files(s, d), "doc_1.py", 20).select("file_id", "path", "match_kind")


@query()
def filename_fuzzy(s, d):
    return filenames.search(src.files(s, d), "doc_12", 20).select("file_id", "path", F.round("score", 6).alias("score"), "match_kind", "highlights")


@query("""+
o AS (SELECT p_partkey, unnest(range(0, length(p_name))) AS i, p_name FROM part),
h AS (SELECT p_partkey, i, i - row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS g FROM o WHERE substr(p_name, i::INTEGER + 1, 1) IN ('a', 'e', 'l', 'n', 'r', 's', 't')),
r AS (SELECT p_partkey, min(i) AS a, max(i) + 1 AS z FROM h GROUP BY p_partkey, g)
SELECT p_partkey, string_agg(a || ':' || z, ',' ORDER BY a) AS spans FROM r GROUP BY p_partkey""")
def highlight_ranges(s, d):
    letters = F.split("p_name", "")
    marked = F.transform(letters, lambda c, i: F.when(c.isin(*"aelnrst"), i))
    spans = scores.ranges(F.filter(marked, lambda i: i.isNotNull()))
    shown = F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return src.table(s, d, "part").select("p_partkey", shown.alias("spans")).filter("spans != ''")


@query("""+
o AS (SELECT file_id, path, unnest(range(1, length(path))) AS i FROM files),
h AS (SELECT file_id, i FROM o WHERE lower(substr(path, i::INTEGER, 3)) = 'src')
SELECT file_id, string_agg((i - 1) || ':' || (i + 2), ',' ORDER BY i) AS spans FROM h GROUP BY file_id""")
def phrase_highlights(s, d):
    spans = scores.occurrences(F.col("path"), "SRC")
    shown = F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return src.files(s, d).select("file_id", shown.alias("spans")).filter("spans != ''")


# --- fusion

_LEGS = f"""{_BEST},
sem AS (SELECT path, file_id, row_number() OVER (ORDER BY distance, path) AS sr FROM (SELECT * FROM best JOIN files USING (file_id) ORDER BY best.distance, path LIMIT 30)),
nam AS (SELECT path, file_id, row_number() OVER (ORDER BY path) AS nr, CASE WHEN lower(basename) = 'doc_1.py' THEN 'exact' ELSE 'substring' END AS kind FROM (SELECT * FROM files WHERE contains(lower(path), 'doc_1') ORDER BY path LIMIT 30))"""


def _legs(s, d) -> tuple[DataFrame, DataFrame]:
    near = ranking.ranked(_near(s, d, k=30), "distance", "path")
    names = filenames.substring(src.files(s, d), "doc_1", 30).withColumn("match_kind", F.when(F.lower("basename") == "doc_1.py", "exact").otherwise("substring"))
    return near, ranking.ranked(names, "path")


@query(f"""{_LEGS}
SELECT path, coalesce(sem.file_id, nam.file_id) AS file_id, round(coalesce(1.0::DOUBLE / (60 + sr), 0) + coalesce(1.0::DOUBLE / (60 + nr), 0) + CASE WHEN kind = 'exact' THEN 0.05::DOUBLE ELSE 0 END, 9) AS score,
  CASE WHEN sr IS NULL THEN 'filename' WHEN nr IS NULL THEN 'content' ELSE 'both' END AS match_kind FROM sem FULL JOIN nam USING (path)""")
def rrf_hybrid(s, d):
    near, names = _legs(s, d)
    return ranking.fuse(near, names).select("path", "file_id", F.round("score", 9).alias("score"), "match_kind")


@query(f"""{_LEGS}
SELECT path, round(coalesce(1.0::DOUBLE / (10 + sr), 0) + coalesce(1.0::DOUBLE / (10 + nr), 0) + CASE WHEN kind = 'exact' THEN 0.5::DOUBLE ELSE 0 END, 9) AS score FROM sem FULL JOIN nam USING (path)
ORDER BY coalesce(1.0::DOUBLE / (10 + sr), 0) + coalesce(1.0::DOUBLE / (10 + nr), 0) + CASE WHEN kind = 'exact' THEN 0.5::DOUBLE ELSE 0 END DESC, path LIMIT 15""")
def rrf_exact_bonus(s, d):
    near, names = _legs(s, d)
    return ranking.fuse(near, names, 15, 10, 0.5).select("path", F.round("score", 9).alias("score"))


@query(f"""{_LEGS}
SELECT path, leg FROM (SELECT path, 0 AS leg, nr AS r FROM nam UNION ALL SELECT path, 1, sr FROM sem WHERE path NOT IN (SELECT path FROM nam)) ORDER BY leg, r, path LIMIT 40""")
def merge_filename_first(s, d):
    near, names = _legs(s, d)
    return ranking.names_first(names, near, 40).select("path", "leg")


@query(f"{_LEGS} SELECT path, 'content' AS match_kind FROM sem ORDER BY sr LIMIT 10")
def blend_content(s, d):
    near, names = _legs(s, d)
    return ranking.blend("content", near, names, 10).select("path", "match_kind")


@query(f"{_LEGS} SELECT path, 'filename' AS match_kind FROM nam ORDER BY nr LIMIT 10")
def blend_filename(s, d):
    near, names = _legs(s, d)
    return ranking.blend("filename", near, names, 10).select("path", "match_kind")


# --- contents


@query("SELECT file_id, CASE WHEN extension = '.pdf' THEN 'document' ELSE CASE WHEN octet_length(encode(text)) > 0 THEN 'text' ELSE '' END END AS kind FROM files")
def classify_file_type(s, d):
    return src.files(s, d, text=True).select("file_id", text.file_kind(F.col("path"), F.col("text").cast("binary")).alias("kind"))


@query("SELECT page_id, html IS NOT NULL AND html <> '' AND NOT contains(substr(html, 1, 8192), chr(0)) AS is_text FROM pages", relations=False)
def sniff_text(s, d):
    return src.table(s, d, "pages").select("page_id", text.is_text(F.col("html").cast("binary")).alias("is_text"))


@query("SELECT file_id, CASE WHEN extension = '.pdf' THEN 'application/pdf' ELSE '' END AS media_type FROM files")
def mime_lookup(s, d):
    return src.files(s, d).select("file_id", text.media_type(F.col("path")).alias("media_type"))


_CHUNKS = """
n AS (SELECT file_id, encode(text) AS b, octet_length(encode(text)) AS len FROM files),
w AS (SELECT file_id, b, unnest(range(0, 1 + greatest(0, CAST(ceil((len - 2000) / 1800.0) AS BIGINT)))) AS chunk_index FROM n WHERE len > 0)"""


@query(f"""+ {_CHUNKS} SELECT file_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(least(2000, octet_length(b) - chunk_index * 1800) AS INTEGER) AS size,
sha256(b[chunk_index * 1800 + 1 : chunk_index * 1800 + 2000]) AS bytes FROM w""")
def chunk_text(s, d):
    x = src.files(s, d, text=True).select("file_id", F.explode(text.byte_chunks(F.col("text").cast("binary"))).alias("c"))
    return x.select("file_id", "c.chunk_index", F.octet_length("c.content").alias("size"), F.sha2("c.content", 256).alias("bytes"))


@query("""+
n AS (SELECT file_id, size_bytes / 20.0 AS sec FROM files),
w AS (SELECT file_id, sec, unnest(range(0, 1 + CAST(ceil(greatest(sec - 30, 0) / 25.0) AS BIGINT))) AS i FROM n WHERE sec > 0)
SELECT file_id, CAST(i * 25.0 AS DOUBLE) AS start, CAST(least(i * 25.0 + 30, sec) AS DOUBLE) AS "end" FROM w""")
def chunk_time_ranges(s, d):
    x = src.files(s, d).select("file_id", F.explode(text.time_ranges(F.col("size_bytes") / 20.0)).alias("r"))
    return x.select("file_id", "r.start", "r.end")


@query("""+
n AS (SELECT file_id, 1 + size_bytes % 40 AS pages FROM files),
w AS (SELECT file_id, pages, unnest(range(0, CASE WHEN pages > 6 THEN 1 + CAST(ceil((pages - 6) / 5.0) AS BIGINT) ELSE 1 END)) AS i FROM n)
SELECT file_id, CAST(i * 5 + 1 AS BIGINT) AS first, CAST(least(i * 5 + 6, pages) AS BIGINT) AS last FROM w""")
def chunk_pages(s, d):
    x = src.files(s, d).select("file_id", F.explode(text.page_ranges(1 + F.col("size_bytes") % 40)).alias("r"))
    return x.select("file_id", "r.first", "r.last")


@query("SELECT file_id, CAST(CASE WHEN total >= 100 THEN n ELSE 0 END AS INTEGER) AS n_chunks FROM (SELECT file_id, octet_length(encode(trim(text))) AS len, CASE WHEN len > 0 THEN 1 + greatest(0, CAST(ceil((len - 2000) / 1800.0) AS BIGINT)) ELSE 0 END AS n, CASE WHEN len > 0 THEN len + (n - 1) * 200 ELSE 0 END AS total FROM files)")
def document_chunk_counts(s, d):
    return src.files(s, d, text=True).select("file_id", F.size(text.document_chunks(F.col("text"))).alias("n_chunks"))


# --- maintenance


@query("SELECT file_id, sha256(text) AS content_hash FROM files")
def content_hash(s, d):
    return src.files(s, d, text=True).select("file_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


def _listing(s, d) -> DataFrame:
    """A folder listing that lacks, changes and adds files against the relation."""
    f = src.files(s, d, text=True)
    moved = F.when(F.col("file_id") % 5 == 0, F.col("modified_at") + F.expr("interval 1 hour")).otherwise(F.col("modified_at"))
    path = F.when(F.col("file_id") % 7 == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path"))
    digest = F.sha2(F.when(F.col("file_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary"), 256)
    return f.filter(F.col("file_id") % 11 != 0).select(path.alias("path"), moved.alias("modified_at"), digest.alias("content_hash"))


_LISTING = """+
listing AS (SELECT CASE WHEN file_id % 7 = 0 THEN path || '.new' ELSE path END AS path, CASE WHEN file_id % 5 = 0 THEN modified_at + INTERVAL 1 HOUR ELSE modified_at END AS modified_at,
  sha256(CASE WHEN file_id % 3 = 0 THEN text || 'x' ELSE text END) AS content_hash FROM files WHERE file_id % 11 <> 0)"""


@query(f"{_LISTING} SELECT l.path, f.path IS NULL OR f.content_hash = '' OR f.content_hash <> l.content_hash AS stale FROM listing l LEFT JOIN files f ON l.path = f.path")
def stale_diff(s, d):
    return tables.stale(_listing(s, d), src.files(s, d)).select("path", "stale")


@query(f"""{_LISTING} SELECT path, action FROM (SELECT coalesce(l.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'new' WHEN l.path IS NULL THEN 'gone' WHEN l.modified_at <> f.modified_at THEN 'changed' END AS action
FROM listing l FULL JOIN files f ON l.path = f.path) WHERE action IS NOT NULL""")
def rescan_diff(s, d):
    return tables.rescan(_listing(s, d), src.files(s, d))


@query("SELECT file_id, count(*) AS n_missing FROM chunks WHERE NOT (chunk_index % 3 <> 0) GROUP BY file_id")
def reconcile_missing(s, d):
    c = src.chunks(s, d)
    return tables.missing_vectors(c, c.filter(F.col("chunk_index") % 3 != 0))


@query("SELECT file_id FROM files WHERE content_hash = ''")
def incomplete_files(s, d):
    return src.files(s, d).filter(F.col("content_hash") == "").select("file_id")


@query("SELECT file_id FROM files WHERE content_hash = '' UNION SELECT file_id FROM chunks WHERE chunk_index = 2")
def files_to_index(s, d):
    c = src.chunks(s, d)
    return tables.to_index(src.files(s, d), c, c.filter(F.col("chunk_index") != 2))


@query("""SELECT path, file_id, size_bytes::BIGINT AS size_bytes, basename FROM (
SELECT path, file_id, size_bytes, basename FROM files WHERE file_id % 4 <> 0
UNION ALL SELECT path, file_id, size_bytes + 2, basename FROM files WHERE file_id % 4 = 0
UNION ALL SELECT path || '.added', -1, 1, basename || '.added' FROM files WHERE file_id % 9 = 0)""")
def upsert_latest(s, d):
    f = src.files(s, d)
    part = f.filter(F.col("file_id") % 4 == 0)
    old, new = (part.withColumns({"size_bytes": F.col("size_bytes") + k, "seq": F.lit(k)}) for k in (1, 2))
    added = f.filter(F.col("file_id") % 9 == 0).withColumns({"path": F.concat("path", F.lit(".added")), "size_bytes": F.lit(1).cast("long"), "seq": F.lit(1)})
    out = tables.upsert_files(f, new.unionByName(old).unionByName(added).withColumn("file_id", F.lit(-7).cast("long")))
    return out.select("path", F.when(F.col("path").endswith(".added"), F.lit(-1)).otherwise(F.col("file_id")).cast("long").alias("file_id"), "size_bytes", "basename")


@query("""SELECT vector_id, CAST(chunk_index AS INTEGER) AS chunk_index, CASE WHEN file_id % 2 = 0 THEN 'model-c' ELSE embedding_model END AS embedding_model FROM chunks
UNION ALL SELECT vector_id || 'n', 99, 'model-c' FROM chunks WHERE file_id % 50 = 0""")
def upsert_chunk_vectors(s, d):
    c = src.chunks(s, d)
    changed = c.filter(F.col("file_id") % 2 == 0).withColumns({"embedding_model": F.lit("model-c"), "chunk_index": F.lit(77)})
    new = c.filter(F.col("file_id") % 50 == 0).withColumns({"vector_id": F.concat("vector_id", F.lit("n")), "embedding_model": F.lit("model-c"), "chunk_index": F.lit(99)})
    return tables.upsert_chunks(c, changed.unionByName(new).withColumn("seq", F.lit(1))).select("vector_id", "chunk_index", "embedding_model")


@query("SELECT (SELECT count(*) FROM files WHERE NOT starts_with(path, '/corpus/src1/')) AS n_files, (SELECT count(*) FROM chunks WHERE file_id NOT IN (SELECT file_id FROM files WHERE starts_with(path, '/corpus/src1/'))) AS n_chunks")
def folder_delete(s, d):
    f, c = tables.delete_folder(src.files(s, d), src.chunks(s, d), "/corpus/src1")
    return f.agg(F.count("*").alias("n_files")).withColumn("n_chunks", F.lit(c.count()).cast("long"))


@query("SELECT vector_id FROM chunks WHERE file_id IN (SELECT file_id FROM files WHERE file_id % 10 = 3)")
def file_delete(s, d):
    f = src.files(s, d)
    return tables.delete_files(f, src.chunks(s, d), f.filter(F.col("file_id") % 10 == 3))[2]


@query("SELECT file_id, CASE WHEN file_id = 4 THEN 'new name.tar.gz' ELSE basename END AS basename, CASE WHEN file_id = 4 THEN '/other' ELSE parent END AS parent, CASE WHEN file_id = 4 THEN 'new name.tar' ELSE stem END AS stem FROM files")
def rename_file(s, d):
    f = src.files(s, d)
    return tables.rename(f, f.filter("file_id = 4").first()["path"], "/other//./new name.tar.gz").select("file_id", "basename", "parent", "stem")


@query("SELECT file_id FROM files WHERE modified_at > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY")
def cache_evict(s, d):
    rows = src.files(s, d).select("file_id", F.unix_timestamp("modified_at").alias("created_at"))
    return tables.evict(rows, "created_at", parser.seconds(NOW) - 7 * 86400, False).select("file_id")


@query("SELECT file_id, substr(sha256(path), 1, 16) || '.jpg' AS name FROM files")
def thumbnail_names(s, d):
    return src.files(s, d).select("file_id", embedding.thumbnail_name(F.col("path")).alias("name"))


@query("SELECT vector_id, CAST(len(embedding) * 4 AS INTEGER) AS size, true AS same FROM chunks")
def vector_blobs(s, d):
    x = src.chunks(s, d).withColumn("b", embedding.packed("embedding"))
    return x.select("vector_id", F.octet_length("b").alias("size"), (embedding.unpacked("b") == F.col("embedding")).alias("same"))


@query("SELECT file_id, coalesce(nullif(CASE WHEN file_id % 2 = 0 THEN '' ELSE basename END, ''), basename) AS basename, parent FROM files")
def backfill_paths(s, d):
    old = src.files(s, d).withColumn("basename", F.when(F.col("file_id") % 2 == 0, "").otherwise(F.col("basename"))).drop("parent")
    return tables.derived(old).select("file_id", "basename", "parent")


@query()
def embed_batches(s, d):
    out = embedding.embed(src.files(s, d, text=True).select("file_id", "text"), embedding.stand_in(8))
    return out.select("file_id", F.transform("embedding", lambda v: F.round(v, 4)).alias("embedding"))


# --- reports

_REGISTRY = "reg AS (SELECT path, min(seq) AS seq, arg_max(code, seq) AS code, arg_max(CAST(epoch_us(last_failed_at) AS BIGINT), seq) AS last_us, count(*) AS attempts FROM failures GROUP BY path ORDER BY seq DESC LIMIT 100)"


def _registry(s, d) -> DataFrame:
    return reports.registry(src.failures(s, d), 100)


@query(f"+ {_REGISTRY} SELECT path, seq, code, attempts, last_us FROM reg")
def failure_registry_fifo(s, d):
    return _registry(s, d).select("path", "seq", "code", "attempts", F.unix_micros("last_failed_at").alias("last_us"))


@query(f"""+ {_REGISTRY}, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY seq) AS k FROM reg)
SELECT code, any_value(CASE code WHEN 'ERR_EMBED_COUNT_MISMATCH' THEN 'embedding response count does not match chunk count' WHEN 'ERR_EMBED_FAILED' THEN 'embedding request failed' WHEN 'ERR_EXTRACTION_FAILED' THEN 'text extraction from file failed'
WHEN 'ERR_FILE_TOO_LARGE' THEN 'file exceeds the maximum size for indexing' WHEN 'ERR_FILE_UNREADABLE' THEN 'file could not be read' WHEN 'ERR_HNSW_ADD' THEN 'failed to add vector to HNSW index' WHEN 'ERR_RATE_LIMITED' THEN 'rate limited by embedding provider'
WHEN 'ERR_STORE_WRITE' THEN 'failed to write to metadata store' WHEN 'ERR_UNSUPPORTED_FORMAT' THEN 'file format is not supported for indexing' END) AS label,
count(*) AS n, string_agg(path, ',' ORDER BY seq) FILTER (WHERE k <= 3) AS sample_files FROM r GROUP BY code ORDER BY n DESC, code LIMIT 5""")
def failure_groups(s, d):
    return reports.failure_groups(_registry(s, d)).withColumn("sample_files", F.array_join("sample_files", ","))


@query("SELECT code, CASE WHEN code IN ('ERR_EMBED_FAILED', 'ERR_HNSW_ADD', 'ERR_STORE_WRITE') THEN 'TransientRetry' WHEN code = 'ERR_RATE_LIMITED' THEN 'TransientWait' ELSE 'Permanent' END AS class, count(*) AS n FROM failures GROUP BY code")
def retry_classes(s, d):
    return src.failures(s, d).groupBy("code", reports.retry_class(F.col("code")).alias("class")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE file_id % 13 <> 0 AND content_hash <> '') AS indexed, count(*) FILTER (WHERE file_id % 13 = 0) AS failed, count(*) FILTER (WHERE file_id % 13 <> 0 AND content_hash = '') AS pending FROM files")
def status_counts(s, d):
    f = src.files(s, d)
    return reports.status(f, f.filter(F.col("file_id") % 13 == 0))


@query("SELECT count(*) FILTER (WHERE event_id % 4 <> 0) AS calls, CAST(sum(event_id % 700) FILTER (WHERE event_id % 4 <> 0) // count(*) FILTER (WHERE event_id % 4 <> 0) AS BIGINT) AS avg_ms, count(*) FILTER (WHERE event_id % 4 = 0) AS hits, count(*) FILTER (WHERE event_id % 4 <> 0) AS misses FROM events", relations=False)
def llm_stats(s, d):
    return reports.call_stats(src.table(s, d, "events").select((F.col("event_id") % 700).alias("ms"), (F.col("event_id") % 4 == 0).alias("hit")))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1", relations=False)
def requests_per_day(s, d):
    return reports.requests_per_day(src.watch_events(s, d)).withColumn("day", F.col("day").cast("string"))


@query("SELECT tag, round(avg(score), 6) AS mean FROM (SELECT doc_id % 10 / 10.0 AS score, unnest(['', lang, source]) AS tag FROM documents) GROUP BY tag", relations=False)
def eval_means(s, d):
    cases = src.table(s, d, "documents").select((F.col("doc_id") % 10 / 10.0).alias("score"), F.array("lang", "source").alias("tags"))
    return reports.mean_scores(cases).select("tag", F.round("mean", 6).alias("mean"))


# --- streams, as their batch forms


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, event_type AS type, ts FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts) AS burst FROM g)
SELECT path, arg_max(type, ts) AS type, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, count(*) AS n FROM b GROUP BY path, burst""", relations=False)
def debounce_last_event(s, d):
    out = watch.debounced(src.watch_events(s, d), "30 minutes")
    return out.select("path", "type", F.unix_micros("ts").alias("last_us"), "n")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS in_window FROM events""", relations=False)
def rate_window_count(s, d):
    e = src.table(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return reports.window_counts(e, "user_id", 3600).select("event_id", "in_window")


@query("""SELECT seq, CASE WHEN code IN ('ERR_EMBED_FAILED', 'ERR_HNSW_ADD', 'ERR_STORE_WRITE') AND a < 3 THEN 'retry' WHEN code = 'ERR_RATE_LIMITED' THEN 'wait' ELSE 'record' END AS verdict,
CASE WHEN code IN ('ERR_EMBED_FAILED', 'ERR_HNSW_ADD', 'ERR_STORE_WRITE') AND a < 3 THEN CAST(epoch_us(last_failed_at) + 1000000 * (CASE a WHEN 1 THEN 1 ELSE 2 END) AS BIGINT) END AS next_us FROM (SELECT *, 1 + seq % 4 AS a FROM failures)""")
def retry_schedule(s, d):
    f = src.failures(s, d).withColumn("attempts", (1 + F.col("seq") % 4).cast("int"))
    return reports.retry_schedule(f).select("seq", "verdict", F.unix_micros("next_attempt_at").alias("next_us"))



# --- query strings


def _strings(s, d) -> DataFrame:
    """Query-like strings: the whole texts of conversation turns, with what makes them queries of each kind."""
    turns = src.table(s, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("w"))
    n = (F.col("conv_id") + F.col("turn")) % 6
    q = F.when(n == 0, F.col("w")).when(n == 1, F.concat(F.lit("f:"), "w")).when(n == 2, F.concat("w", F.lit(".py"))).when(n == 3, F.concat(F.lit("the "), "w", F.lit(" photos from last week."))).when(n == 4, F.concat(F.lit("report in Downloads  10mb "), "w", F.lit("?!"))).otherwise(F.concat("w", F.lit(" over 3")))
    return turns.select("conv_id", "turn", q.alias("q"))


_STRINGS = """s AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN w WHEN 1 THEN 'f:' || w WHEN 2 THEN w || '.py' WHEN 3 THEN 'the ' || w || ' photos from last week.' WHEN 4 THEN 'report in Downloads  10mb ' || w || '?!' ELSE w || ' over 3' END AS q
FROM (SELECT conv_id, turn, coalesce(text, '') AS w FROM conversations))"""


_STOPWORDS = (
    "['the','a','an','and','or','of','in','on','at','with','about','for','to','from','by','is','are','was','were','be','been','this','that','these','those','what','where','why','when','who','how']"
)


@query(f"""WITH {_STRINGS}, t AS (SELECT *, trim(q, ' ' || chr(10) || chr(9) || chr(13)) AS x, list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '') AS w FROM s)
SELECT conv_id, turn, CASE WHEN starts_with(lower(x), 'f:') OR regexp_matches(x, '[*?]') THEN 'filename' WHEN len(w) = 0 THEN 'content' WHEN len(w) = 1 AND regexp_matches(x, '\\.[a-zA-Z0-9]{{1,4}}$') THEN 'filename'
WHEN len(w) = 1 AND octet_length(encode(x)) <= 30 AND regexp_matches(x, '^[A-Za-z][A-Za-z0-9_-]*$') THEN 'hybrid' WHEN len(w) >= 2 AND list_has_any(list_transform(w, lambda y: lower(y)), {_STOPWORDS}) THEN 'content' WHEN len(w) >= 4 THEN 'content' ELSE 'hybrid' END AS kind,
CASE WHEN starts_with(lower(x), 'f:') THEN substr(x, 3) ELSE x END AS stripped FROM t""", relations=False)
def classify_query(s, d):
    return _strings(s, d).select("conv_id", "turn", text.route(F.col("q")).alias("r")).select("conv_id", "turn", "r.kind", "r.stripped")


_WORD, _END = "(^|[^A-Za-z0-9_])", "($|[^A-Za-z0-9_])"
_HINTS = {
    "extension": "regexp_matches(lower(q), '\\.[a-z0-9]{1,6}\\b')",
    "file_type": f"regexp_matches(lower(q), '{_WORD}(image|img|photo|picture|video|audio|document|doc|pdf|text|code)s?{_END}')",
    "size_bytes": "regexp_matches(lower(q), '\\b\\d+\\s*(kb|mb|gb|tb)\\b|\\b(large|small|bigger|smaller|huge|tiny)\\b')",
    "modified_at": "regexp_matches(lower(q), '\\b(today|yesterday|tomorrow|recent|recently|week|month|year|day)\\b|\\b(last\\s+(week|month|year|day)|\\d+\\s+(day|week|month|year)s?\\s+ago)\\b')",
    "path": "regexp_matches(q, '\\bin\\s+[A-Z][a-zA-Z0-9_-]+|\\b(Downloads|Desktop|Documents|Pictures|Music|Videos)\\b')",
}
_SIGNALS_SQL = ", ".join(f"{test} AS {k}" for k, test in _HINTS.items())


@query(f"WITH {_STRINGS} SELECT conv_id, turn, {_SIGNALS_SQL} FROM s", relations=False)
def structured_signals(s, d):
    return _strings(s, d).select("conv_id", "turn", text.signals(F.col("q")).alias("s")).select("conv_id", "turn", "s.*")


_WANTS = (
    "octet_length(encode(q)) <= 500 AND (len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) > 6 OR regexp_matches(lower(q), "
    "'\\b(yesterday|today|last|past|recent|older|newer|since|before|after|not|no|without|except|exclude|photos?|pictures?|screenshots?|videos?|docs?|documents?|code|scripts?)\\b') OR " + " OR ".join(_HINTS.values()) + ")"
)


@query(f"WITH {_STRINGS} SELECT conv_id, turn, {_WANTS} AS wants FROM s", relations=False)
def llm_trigger(s, d):
    return _strings(s, d).select("conv_id", "turn", text.wants_model(F.col("q")).alias("wants"))


@query(f"WITH {_STRINGS} SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(trim(q)), '\\s+', ' ', 'g'), '[.?!]+$', '')) AS key FROM s", relations=False)
def normalize_key(s, d):
    return _strings(s, d).select("conv_id", "turn", text.normal_key(F.col("q")).alias("key"))


@query("""WITH t AS (SELECT doc_id, ['>', '>=', '<', '<=', '=', '', '~'][doc_id % 7 + 1] AS o, n_chars, ['b', 'kb', 'mb', 'gb', 'tb', 'xb'][doc_id % 6 + 1] AS u FROM documents)
SELECT doc_id, CASE WHEN o <> '~' AND u <> 'xb' THEN CASE o WHEN '>' THEN 'gt' WHEN '>=' THEN 'gte' WHEN '<' THEN 'lt' WHEN '<=' THEN 'lte' WHEN '=' THEN 'eq' ELSE 'gte' END END AS op,
CASE WHEN o <> '~' AND u <> 'xb' THEN CAST(n_chars * CASE u WHEN 'b' THEN 1 WHEN 'kb' THEN 1024 WHEN 'mb' THEN 1048576 WHEN 'gb' THEN 1073741824 ELSE 1099511627776 END AS BIGINT) END AS bytes FROM t""", relations=False)
def parse_size(s, d):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    q = F.concat(pick((">", ">=", "<", "<=", "=", "", "~")), F.col("n_chars").cast("string"), pick(("b", "kb", "mb", "gb", "tb", "xb")))
    return src.table(s, d, "documents").select("doc_id", text.parsed_size(F.upper(q)).alias("p")).select("doc_id", "p.op", "p.bytes")


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN n // 1024 || ' KB' WHEN n < 1073741824 THEN n // 1048576 || ' MB' ELSE n // 1073741824 || ' GB' END AS label,
CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.0f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS shown
FROM (SELECT doc_id, n_chars * (1 + doc_id % 1000) * 17 + 1 AS n FROM documents)""", relations=False)
def format_bytes(s, d):
    n = F.col("n_chars") * (1 + F.col("doc_id") % 1000) * 17 + 1
    return src.table(s, d, "documents").select("doc_id", text.whole_size(n).alias("label"), text.shown_size(n).alias("shown"))


from tessella import queries_engine  # noqa: E402, F401 - registers its queries
