"""The engine: a store of files and chunks, and the searches over it."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.functions.text import byte_chunks, document_chunks, preview, route
from tessella.operators import filenames, migrations, ranking, reports, tables, vectors
from tessella.operators.index import VectorIndex
from tessella.operators.postings import NameIndex
from tessella.plans import parser
from tessella.plans.clauses import Cache, Spec, chips, deny_list, merge, where
from tessella.schema import CHUNKS, DEFAULT_IGNORED, FAILURES, FILES, SPEC_VERSION
from tessella.sources import documents, folders, media, watching
from tessella.sources.embedding import EmbedBatch
from tessella.streaming import timers, watch

Embed = Callable[[str], list[float]]
EmbedChunks = Callable[[DataFrame], DataFrame]
DAY = 86400


class StaleGeneration(RuntimeError):
    """The index was reset while this work was under way; its results are dropped."""


class ConfigInvalid(ValueError):
    """A setting outside its bounds (ERR_CONFIG_INVALID)."""


@dataclass
class VectorCache:
    """Query vectors by normalised text: at most most of them (the longest unused goes), none older than seconds."""

    most: int = 1000
    seconds: int = 7 * DAY
    rows: dict[str, tuple[list[float], float]] = field(default_factory=dict)

    def get(self, key: str, now: float) -> list[float] | None:
        found = self.rows.pop(key, None)
        if found is None or now - found[1] >= self.seconds:
            return None
        self.rows[key] = found  # the last used comes last
        return found[0]

    def put(self, key: str, vector: list[float], now: float) -> None:
        self.rows.pop(key, None)
        self.rows[key] = vector, now
        while len(self.rows) > self.most:
            del self.rows[next(iter(self.rows))]


class Engine:
    """files and chunks as DataFrames, an embedding function for queries, and optionally a language model.

    embed_media adds embedding (and error, a code) to (file_id, chunk_index, media_type, page_start, page_end, content), for providers that read images, audio and
    PDF pages as they are. A PDF's page parts come before the chunks of its text. Without it images and audio are failures, and PDF files have their text alone.

    What indexing changes is written to a store at root before it is used, so that no later action reads a folder or embeds a
    chunk again. Without a root, a folder under spark.checkpoint.dir holds it (under a temporary folder on a local master).
    """

    #: Bounds of the settings that users may change, and their defaults.
    BOUNDS = {"indexing.workers": (1, 32, 4), "indexing.rate_limit_per_minute": (1, 10_000, 55)}

    def __init__(self, spark: SparkSession, files: DataFrame | None = None, chunks: DataFrame | None = None, embed: Embed | None = None, model: str | None = None, provider: parser.Provider | None = None, root: str | None = None, embed_media: EmbedChunks | None = None):
        self.spark, self.embed, self.model, self.provider, self.embed_media = spark, embed, model, provider, embed_media
        self.files = files if files is not None else spark.createDataFrame([], FILES)
        self.chunks = chunks if chunks is not None else spark.createDataFrame([], CHUNKS)
        self.failed = spark.createDataFrame([], FAILURES)
        self.settings = spark.createDataFrame([], "key string, value string")
        self.ignored: tuple[str, ...] = DEFAULT_IGNORED
        self.folders: list[str] = []
        self.cache, self.vectors = Cache(SPEC_VERSION), VectorCache()
        self.generation, self.paused, self.waiting, self.changes = 0, False, [], 0
        self.calls: list[tuple[int, bool]] = []
        self._root, self._store, self._index_ = root, None, None
        self.names: NameIndex | None = None

    # --- queries

    @staticmethod
    def _now() -> datetime:
        return datetime.now(UTC).replace(tzinfo=None)

    def parse(self, raw: str, denied: list[str] | None = None, now: datetime | None = None) -> dict:
        """The query's specification, its chips, and how the model fared."""
        now, outcome = now or self._now(), "OK"
        key, stamp = " ".join(raw.lower().split()).rstrip(".?!").strip(), int(now.replace(tzinfo=UTC).timestamp())
        spec = self.cache.get(key, stamp)
        if spec is None:
            spec = parser.parse(raw, now)
            if self.provider and parser.wants_model(raw):
                began = datetime.now(UTC)
                found, outcome = parser.model_spec(raw, now, self.provider)
                self.calls.append((int((datetime.now(UTC) - began).total_seconds() * 1000), False))
                if outcome == "OK":
                    spec = merge(spec, found)
                    self.cache.put(key, spec, stamp)
        else:
            self.calls.append((0, True))
        spec = merge(spec, Spec(), deny_list(denied or []))
        return {"spec": spec, "chips": chips(spec), "outcome": outcome}

    def vector(self, text: str) -> list[float] | None:
        key, now = text.strip().lower(), datetime.now(UTC).timestamp()
        found = self.vectors.get(key, now)
        if found is None and self.embed:
            found = self.embed(text)
            self.vectors.put(key, found, now)
        return found

    def pre_embed(self, text: str) -> bool:
        """Embeds a query while it is typed; whether its vector is at hand."""
        return bool(text.strip()) and self.vector(text) is not None

    def search(self, raw: str, k: int = 20, denied: list[str] | None = None, semantic: str | None = None, filter_names: bool = False, now: datetime | None = None) -> tuple[DataFrame, dict]:
        """Result rows (path, score, match_kind, ...) and how they came about (kind, spec, banner, strategy).

        vectors.ModelMismatch is raised where the filters leave chunks, but none of the engine's model.
        """
        spec = self.parse(raw, denied, now)["spec"]
        text = semantic if semantic is not None else spec.semantic or raw
        kind, stripped = self.spark.range(1).select(route(F.lit(text)).alias("r")).select("r.kind", "r.stripped").first()
        how = {"kind": kind, "spec": spec, "banner": ""}
        if not self.embed:
            hits = filenames.substring(self.files, text, k).select("path", F.lit(0.0).alias("score"), F.lit("filename").alias("match_kind"))
            return hits, how | {"kind": "filename"}
        near = None
        if kind != "filename":
            stored = self.chunks.filter(F.col("embedding").isNotNull())
            with_vectors = self.files.join(stored.select("file_id").distinct(), "file_id", "left_semi")
            allowed, how["banner"] = ranking.relaxed(with_vectors, spec)
            if self.model:
                left = stored.select("file_id", "embedding_model").join(allowed.select("file_id"), "file_id", "left_semi")
                vectors.check_model(left, vectors.current_model(left, self.model))
            near, plan = self._near(allowed, spec, self.vector(text), k)
            how |= plan
            near = ranking.ranked(ranking.rerank(near, spec), F.desc("final_score"), "path")
        if kind == "content":
            return ranking.blend("content", near, near, k), how
        pool = self.files.filter(where(spec)) if filter_names else self.files
        names = ranking.ranked(filenames.search(pool, stripped, k, index=self.names), F.desc("fuzzy_score"), F.desc("modified_at"), "path")
        return ranking.blend(kind, near if near is not None else names, names, k), how

    #: Candidates of a search for each wanted file, and vectors that cells are read for in the place of one candidate of a graph.
    OVER_FETCH, SPREAD = 10, 20

    def _near(self, allowed: DataFrame, spec: Spec, vector: list[float], k: int) -> tuple[DataFrame, dict]:
        """The k nearest of the allowed files, and how they were found.

        Few files are compared exactly. Beyond exact_threshold files, the stored index is asked, where there is one of this model, with the
        filter inside its scan; else all are compared.
        """
        filtered = bool(spec.must or spec.must_not)
        index, matching = self.vector_index(), None
        how = {"strategy": "brute_force"}
        if index is not None:
            total = self.files.count()
            matching = allowed.count() if filtered else total
            how = {"strategy": vectors.strategy(matching, self.exact_threshold()), "matching": matching}
        if how["strategy"] != "post_filter":
            return vectors.nearest_files(allowed, self.chunks, vector, None, k, self.model, filtered), how
        width = self.SPREAD * vectors.search_width(k, 2 * self.OVER_FETCH, total, matching)
        found, read = index.nearest_files(vector, k, allowed if filtered else None, width, matching)
        scan = vectors.current_model(self.chunks, self.model).filter(F.col("embedding").isNotNull())
        return vectors.hydrated(allowed, scan, vector, [f for _, _, f in found], k), how | read | {"strategy": "post_filter" if filtered else "semantic"}

    def file_preview(self, path: str) -> str | None:
        """The beginning of a file as text; None if it is no text."""
        row = folders.read(self.spark, path).select(preview(F.col("content")).alias("p")).first()
        return row and row["p"]

    # --- indexing

    @property
    def store(self) -> tables.Store:
        if self._store is None:
            self._root = self._root or tables.scratch(self.spark, "engine")
            self._store = tables.Store(self.spark, self._root)
        return self._store

    def _commit(self, generation: int, **new: DataFrame) -> None:
        """Writes tables and takes them up, unless the index was reset meanwhile or another engine wrote them first (tables.LostUpdate)."""
        if generation != self.generation:
            raise StaleGeneration
        before = self.files
        for name, df in new.items():
            setattr(self, name, self.store.write(name, df))
        if "files" in new:
            self._renamed_too(before, self.files)
        self.changes += 1

    # --- the vector index

    def build_index(self, cells: int | None = None) -> None:
        """A stored index of the current model's vectors, kept up to date from here on."""
        own = vectors.current_model(self.chunks, self.model).filter(F.col("embedding").isNotNull())
        self._index_ = VectorIndex(self.spark, self.store.root, store=self.store)
        self._index_.build(own, cells)
        self._index_state()

    def vector_index(self) -> VectorIndex | None:
        """The stored index, if it is of the current model."""
        return self._index_ if self._index_ is not None and self._indexed == self.model else None

    def _index_state(self, version: str = "") -> None:
        """Notes the model that the index is of, and the stored version of the chunks that it holds."""
        self._indexed = self.model
        self.store.write("index_state", self.spark.createDataFrame([(self.model, version)], "model string, version string"))

    def build_names(self) -> None:
        """Stored postings of the file names, kept up to date from here on, which searches by name read in the place of all files."""
        self.names = NameIndex(self.spark, self.store.root, store=self.store)
        self.names.build(self.files)

    def _renamed_too(self, before: DataFrame, now: DataFrame) -> None:
        """The name index after a commit: files that were (before) and are there now; only what differs in a name counts."""
        if self.names is None:
            return
        key = ["file_id", *filenames.WEIGHTS]
        same = before.select(*key).join(now.select(*key), key, "left_semi").select("file_id")
        self.names.update(now.join(same, "file_id", "left_anti"), before.join(same, "file_id", "left_anti"))

    def _indexed_too(self, gone: DataFrame | None, new: DataFrame | None = None) -> None:
        """The chunks of the files in gone (file_id) leave the index, new chunks enter it."""
        if (index := self.vector_index()) is None:
            return
        if gone is not None:
            index.delete(self.chunks.join(gone.select("file_id").distinct(), "file_id", "left_semi").select("vector_id"))
        if new is not None:
            index.add(vectors.current_model(new, self.model).filter(F.col("embedding").isNotNull()))

    def reset(self) -> None:
        """Forgets failures and retries, and stops work under way, which ends without result."""
        self.generation += 1
        self.spark.sparkContext.cancelJobsWithTag(self._tag(self.generation - 1))
        if self.store.exists("retry_events"):
            self._tell(self.spark.createDataFrame([("reset", self.generation)], "kind string, generation long"))
        self.failed = self.spark.createDataFrame([], FAILURES)

    def add_folder(self, folder: str, embed_chunks: EmbedChunks | None = None, force: bool = False, queued: bool = False) -> DataFrame:
        """Index a folder's stale files (all of them if forced); returns the failures (path, code).

        embed_chunks adds embedding to (file_id, chunk_index, text); queued leaves the texts to embedder() instead, within the provider's limit, and calls no embed_media. A paused engine keeps the folder for resume().
        """
        if folder not in self.folders:
            self.folders.append(folder)
        if self.paused:
            self.waiting.append((folder, embed_chunks, force))
            return self.spark.createDataFrame([], "path string, code string")
        return self._index(folders.walk(self.spark, folder, self.ignored), embed_chunks, force, queued=queued)

    def ignored_folders(self) -> list[str]:
        """The names of folders that indexing leaves out."""
        return sorted(self.ignored)

    def ignore_folder(self, name: str) -> None:
        """Leaves folders of that name (a pattern with * and ?) out from now on; what is indexed of them stays until it is removed or rescanned."""
        if not name.strip() or "/" in name:
            raise ConfigInvalid("a folder's name, without its path")
        self.ignored = tuple(dict.fromkeys((*self.ignored, name.strip())))

    def unignore_folder(self, name: str) -> None:
        self.ignored = tuple(n for n in self.ignored if n != name)

    def index_paths(self, paths: list[str], embed_chunks: EmbedChunks | None = None, tries: DataFrame | None = None) -> DataFrame:
        """Index some files; those that went meanwhile are passed by. Excluded names count below the folder that is indexed.

        tries (path, attempts) tells which attempt this is for a path; without it, it is the first, and retries that wait for the paths are dropped.
        """
        if tries is None and self.store.exists("retry_events"):
            self._tell(self.spark.createDataFrame([(p,) for p in paths], "path string").withColumn("kind", F.lit("cancel")))
        within: dict[str, list[str]] = {}
        for p in folders.existing(self.spark, paths):
            known = [f.removeprefix("file://").rstrip("/") for f in self.folders]
            within.setdefault(max((f for f in known if p.startswith(f"{f}/")), key=len, default=p.rpartition("/")[0]), []).append(p)
        if not within:
            return self.spark.createDataFrame([], "path string, code string")
        found = [folders.walk(self.spark, f, self.ignored, ps) for f, ps in within.items()]
        return self._index(reduce(DataFrame.unionByName, found), embed_chunks, False, tries)

    def _index(self, found: DataFrame, embed_chunks: EmbedChunks | None, force: bool, tries: DataFrame | None = None, queued: bool = False) -> DataFrame:
        """_indexed_in under the generation's tag: a reset in another thread stops the job that runs, and StaleGeneration is raised here."""
        generation = self.generation
        self.spark.sparkContext.addJobTag(self._tag(generation))
        try:
            return self._indexed_in(generation, found, embed_chunks, force, tries, queued)
        except Exception as e:
            if generation != self.generation and not isinstance(e, StaleGeneration):
                raise StaleGeneration from e
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self._tag(generation))

    def _tag(self, generation: int) -> str:
        return f"index-{id(self):x}-{generation}"

    def _indexed_in(self, generation: int, found: DataFrame, embed_chunks: EmbedChunks | None, force: bool, tries: DataFrame | None, queued: bool) -> DataFrame:
        """In two phases: file rows without a hash, and no chunks; then chunks, and the hash last. What a lost job leaves
        counts as incomplete, and is indexed again. Every step is written before the next uses it.

        Where embed_chunks adds a column error (a code, null for none), files with such a chunk have failed and stay incomplete; the others are
        committed. Failures go to the retry coordinator; what that doesn't take (permanent ones, and the last attempt) is recorded.
        """
        store, known = self.store, self.files.select("path", F.col("file_id").alias("__known"))
        stale = tables.stale(found, self.files, force).filter("stale").drop("stale").join(known, "path", "left")
        stale = stale.withColumn("file_id", F.coalesce("__known", "file_id")).drop("__known")
        is_document = (F.col("file_type") == "document") & F.col("error").isNull()
        read = documents.text_of(F.when(is_document, F.col("extension")), F.when(is_document, F.col("content")))
        pieces = F.when(F.col("file_type") == "text", byte_chunks(F.col("content"))).when(is_document & F.col("read.text").isNotNull(), document_chunks(F.col("read.text")))
        text = F.transform(pieces, lambda c: F.struct(c["chunk_index"].cast("int").alias("chunk_index"), F.make_valid_utf8(c["content"].cast("string")).alias("text")))
        as_is = media.embedded(F.col("file_type"), F.col("extension")) if self.embed_media and not queued else F.lit(False)
        bad_media = F.when(F.col("file_type").isin("image", "video", "audio") & ~as_is, "ERR_UNSUPPORTED_FORMAT")  # no transcoder here
        staged = stale.withColumn("read", read).withColumns({"pieces": text, "error": F.coalesce("error", F.col("read.error"), bad_media)})
        staged = staged.withColumn("content", F.when(as_is & F.col("error").isNull(), F.col("content"))).drop("read")
        staged = store.write("staged", staged)  # the only scan of the folder
        parts = store.write("parts", media.parts(staged.filter("content is not null"))) if self.embed_media and not queued else None
        staged = self._after_parts(staged.drop("content"), parts)
        done = staged.filter(F.size(F.coalesce("pieces", F.array().cast("array<struct<chunk_index:int,text:string>>"))) + F.col("n_parts") > 0)
        columns = [c for c in self.files.columns if c in staged.columns]
        pending = done.select(*columns).withColumns({"content_hash": F.lit(""), "indexed_at": F.current_timestamp(), "thumbnail_path": F.lit(""), "seq": F.lit(0)})
        if generation != self.generation:
            raise StaleGeneration
        self._indexed_too(done)
        self._commit(generation, files=tables.upsert_files(self.files, pending), chunks=tables.replace_chunks(self.chunks, done))
        if queued:
            self._queue(done, generation)
        elif embed_chunks or parts is not None:
            if generation != self.generation:  # before what costs most
                raise StaleGeneration
            texts = done.select("file_id", F.explode("pieces").alias("c")).select("file_id", "c.chunk_index", "c.text")
            made = [embed_chunks(texts)] if embed_chunks else []
            made += [self.embed_media(parts)] if parts is not None else []
            new = reduce(DataFrame.unionByName, [self._as_chunks(x) for x in made])
            embedded = store.write("embedded", new)  # the only call of the provider
            bad = embedded.filter("error is not null").groupBy("file_id").agg(F.min("error").alias("code"))
            embedded = embedded.drop("error").join(bad, "file_id", "left_anti")
            self._commit(generation, chunks=tables.replace_chunks(self.chunks, done, embedded))
            self._indexed_too(None, embedded)
        if queued or not (embed_chunks or parts is not None):
            bad = self.spark.createDataFrame([], "file_id long, code string")
        if not queued:  # else the hash follows the vectors
            self._commit(generation, files=tables.set_hashes(self.files, done.join(bad, "file_id", "left_anti")))
        failures = staged.filter("error is not null").select("path", F.col("error").alias("code")).unionByName(done.join(bad, "file_id").select("path", "code"))
        tried = failures.withColumn("attempts", F.lit(1)) if tries is None else failures.join(tries.select("path", "attempts"), "path", "left").withColumn("attempts", F.coalesce("attempts", F.lit(1)))
        failures = store.write("failures", tried)
        self._take(failures.filter((reports.retry_class(F.col("code")) == "Permanent") | (F.col("attempts") >= self.MOST_ATTEMPTS)), generation)
        waiting = failures.filter((reports.retry_class(F.col("code")) != "Permanent") & (F.col("attempts") < self.MOST_ATTEMPTS))
        if not waiting.isEmpty():
            self._tell(waiting.withColumns({"kind": F.lit("failed"), "generation": F.lit(generation).cast("long")}))
        return failures.drop("attempts")

    @staticmethod
    def _after_parts(staged: DataFrame, parts: DataFrame | None) -> DataFrame:
        """staged with n_parts, its file's parts, and pieces numbered after them."""
        if parts is None:
            return staged.withColumn("n_parts", F.lit(0))
        x = staged.join(parts.groupBy("file_id").agg(F.count("*").cast("int").alias("n_parts")), "file_id", "left").withColumn("n_parts", F.coalesce("n_parts", F.lit(0)))
        later = F.transform("pieces", lambda c: F.struct((c["chunk_index"] + F.col("n_parts")).alias("chunk_index"), c["text"].alias("text")))
        return x.withColumn("pieces", later)

    def _as_chunks(self, answered: DataFrame) -> DataFrame:
        """What a provider answered as the chunks relation's rows, and error."""
        x = answered.withColumns({
            "vector_id": F.concat(F.lit("f"), F.col("file_id").cast("string"), F.lit("-c"), F.col("chunk_index").cast("string")),
            "start_time": F.lit(0.0), "end_time": F.lit(0.0), "embedding_model": F.lit(self.model or ""), "embedding_dims": F.size("embedding"),
        })
        return x.select(*self.chunks.columns, F.col("error") if "error" in x.columns else F.lit(None).cast("string").alias("error"))

    #: Texts of a call, and what the queue and the answers hold.
    CALL = 100
    REQUESTS = "provider string, id string, seq long, until timestamp"
    QUEUE = "id string, stamp long, file_id long, path string, content_hash string, calls int, generation long, chunk_index int, text string"
    ANSWERS = "id string, stamp long, file_id long, path string, content_hash string, calls int, generation long, chunk_index int, embedding array<float>, error string, wait double"

    def _queue(self, done: DataFrame, generation: int) -> None:
        """Queues the files' texts by calls, and a request for each call."""
        for name, schema in (("embed_requests", self.REQUESTS), ("embed_queue", self.QUEUE), ("embed_answers", self.ANSWERS)):
            if not self.store.exists(name):
                self.store.write(name, self.spark.createDataFrame([], schema))
        stamp = time.time_ns()
        each = done.select("file_id", "path", "content_hash", F.ceil(F.size("pieces") / self.CALL).cast("int").alias("calls"), "pieces")
        id_ = lambda part: F.concat_ws("-", F.col("file_id").cast("string"), F.lit(str(stamp)), part.cast("string"))
        texts = each.withColumn("c", F.explode("pieces")).withColumn("part", F.floor(F.col("c.chunk_index") / self.CALL))
        self.store.append("embed_queue", texts.select(id_(F.col("part")).alias("id"), F.lit(stamp).alias("stamp"), "file_id", "path", "content_hash", "calls", F.lit(generation).cast("long").alias("generation"), "c.chunk_index", "c.text"))
        calls = each.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("calls") - 1)))
        self.store.append("embed_requests", calls.select(F.lit("embedding").alias("provider"), id_(F.col("part")).alias("id"), F.lit(stamp).alias("seq"), F.lit(None).cast("timestamp").alias("until")))

    def embedder(self, checkpoint: str, call: EmbedBatch, most: int | None = None, seconds: float = 60.0) -> StreamingQuery:
        """Embeds what was queued, at most most calls (the setting's rate) in any window of so many seconds by all tasks together; runs until it is stopped, and goes on from its checkpoint.

        A call has at most CALL texts of one file. A ConnectionError with retry_after is the provider's own limit: nothing is sent for so long, and the call is made again. A file is
        committed when all its calls were answered; other errors go to the retry coordinator. A call may be made twice where the stream is lost between call and checkpoint.
        """
        self._queue(self.spark.createDataFrame([], "file_id long, path string, content_hash string, pieces array<struct<chunk_index:int,text:string>>"), self.generation)
        requests = self.spark.readStream.schema(self.REQUESTS).option("recursiveFileLookup", True).parquet(self.store.folder("embed_requests"))

        def step(batch: DataFrame, _: int) -> None:
            if ids := [r["id"] for r in batch.collect()]:  # no more than the limit
                self._embed_now(ids, call)

        limit = most or self.indexing()["rate_limit_per_minute"]
        return timers.leased(requests, limit, seconds).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()

    def _embed_now(self, ids: list[str], call: EmbedBatch) -> None:
        def one(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("chunk_index")
            vectors, error, wait = [None] * len(part), None, 0.0
            try:
                vectors = call(part["text"].fillna("").tolist())
                error = None if len(vectors) == len(part) else "ERR_EMBED_COUNT_MISMATCH"
            except ConnectionError as e:
                error, wait = ("ERR_RATE_LIMITED", float(e.retry_after)) if hasattr(e, "retry_after") else ("ERR_EMBED_FAILED", 0.0)
            return part.drop(columns=["text"]).assign(embedding=vectors if error is None else [None] * len(part), error=pd.Series([error] * len(part), index=part.index, dtype=object), wait=wait)

        store, generation = self.store, self.generation
        rows = store.appended("embed_queue", self.QUEUE).drop("batch").filter(F.col("id").isin(ids) & (F.col("generation") == generation)).dropDuplicates(["id", "chunk_index"])
        n = store.append("embed_answers", rows.groupBy("id").applyInPandas(one, self.ANSWERS))
        answers = store.appended("embed_answers", self.ANSWERS)
        states = answers.filter(F.col("batch") == n).groupBy("id", "file_id", "path").agg(F.max("error").alias("code"), F.max("wait").alias("wait")).collect()  # a row a call
        if limited := [r for r in states if r["code"] == "ERR_RATE_LIMITED"]:
            until = datetime.fromtimestamp(time.time() + max(r["wait"] for r in limited), UTC)
            store.append("embed_requests", self.spark.createDataFrame([("embedding", r["id"], time.time_ns(), until) for r in limited], self.REQUESTS))
        if failed := list({r["path"]: r["code"] for r in states if r["code"] not in (None, "ERR_RATE_LIMITED")}.items()):
            found = self.spark.createDataFrame([(p, c, 1) for p, c in failed], "path string, code string, attempts int")
            permanent = reports.retry_class(F.col("code")) == "Permanent"
            self._take(found.filter(permanent), generation)
            self._tell(found.filter(~permanent).withColumns({"kind": F.lit("failed"), "generation": F.lit(generation).cast("long")}))
        of = [r["file_id"] for r in states if r["code"] is None]
        whole = answers.filter(F.col("file_id").isin(of) & F.col("error").isNull() & (F.col("generation") == generation))
        complete = whole.groupBy("file_id", "stamp").agg(F.count_distinct("id").alias("n"), F.max("calls").alias("calls"), F.max("content_hash").alias("content_hash")).filter("n = calls")
        complete = store.write("embed_complete", complete.groupBy("file_id").agg(F.max("stamp").alias("stamp"), F.max_by("content_hash", "stamp").alias("content_hash")))
        if complete.isEmpty():
            return
        new = self._as_chunks(whole.join(complete.select("file_id", "stamp"), ["file_id", "stamp"], "left_semi")).drop("error")
        embedded = store.write("embedded", new.dropDuplicates(["vector_id"]))
        self._commit(generation, chunks=tables.replace_chunks(self.chunks, complete, embedded))
        self._indexed_too(None, embedded)
        self._commit(generation, files=tables.set_hashes(self.files, complete))

    #: Attempts after which a failed file is recorded.
    MOST_ATTEMPTS = 3

    def _take(self, failures: DataFrame, generation: int) -> None:
        """Records failures (path, code, attempts)."""
        seq = (self.failed.agg(F.max("seq")).first()[0] or 0) + 1
        rows = failures.withColumns({"seq": F.lit(seq).cast("long") + F.monotonically_increasing_id(), "message": reports.label(F.col("code")), "last_failed_at": F.current_timestamp()})
        self._commit(generation, failed=self.failed.unionByName(rows.select(*self.failed.columns)))

    def _tell(self, events: DataFrame) -> None:
        """Adds events for the retry coordinator; columns they lack are null."""
        if not self.store.exists("retry_events"):
            self.store.write("retry_events", self.spark.createDataFrame([], f"seq long, {timers.RETRY_EVENT}"))
        have = set(events.columns)
        fields = [tuple(f.split()) for f in timers.RETRY_EVENT.split(", ")]
        rows = events.select(F.lit(time.time_ns()).alias("seq"), *[F.col(n).cast(t) if n in have else F.lit(None).cast(t).alias(n) for n, t in fields])
        self.store.append("retry_events", rows)

    def rate_limited(self, until: datetime) -> None:
        """The provider asks for a pause: what waits for it is retried from then on, or when limit_lifted() is called."""
        self._tell(self.spark.createDataFrame([("pause", until)], "kind string, until timestamp"))

    def limit_lifted(self) -> None:
        self._tell(self.spark.createDataFrame([("unpause",)], "kind string"))

    def retries(self, checkpoint: str, embed_chunks: EmbedChunks | None = None, backoff: float = 1.0) -> StreamingQuery:
        """Tries failed files again, each when its time has come; runs until it is stopped, and goes on from its checkpoint.

        A retry of another generation than the engine's is dropped.
        """
        if not self.store.exists("retry_events"):
            self._tell(self.spark.createDataFrame([], "kind string"))
        home = self.store.folder("retry_events")
        events = self.spark.readStream.schema(f"seq long, {timers.RETRY_EVENT}").option("recursiveFileLookup", True).parquet(home)

        def step(jobs: DataFrame, _: int) -> None:
            rows = [r for r in jobs.collect() if r["generation"] == self.generation]  # what came due in one batch
            again = [(r["path"], r["attempts"]) for r in rows if r["action"] == "retry"]
            if again:
                self.index_paths([p for p, _ in again], embed_chunks, self.spark.createDataFrame(again, "path string, attempts int"))

        return timers.coordinated(events, self.MOST_ATTEMPTS, backoff).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()

    def pause(self) -> None:
        self.paused = True

    def resume(self) -> None:
        """Indexes what came while the engine was paused."""
        self.paused, waiting, self.waiting = False, self.waiting, []
        for folder, embed_chunks, force in waiting:
            self.add_folder(folder, embed_chunks, force)

    def reindex(self, embed_chunks: EmbedChunks | None = None, folder: str | None = None) -> None:
        """Indexes a folder, or all folders, anew."""
        self.reset()
        for f in [folder] if folder else list(self.folders):
            self.add_folder(f, embed_chunks, True)

    def rescan(self, folder: str, embed_chunks: EmbedChunks | None = None) -> DataFrame:
        """What changed in a folder since it was indexed (path, action): new and changed files are indexed, gone ones removed."""
        here = self.files.filter(tables.inside(F.col("path"), folder.removeprefix("file://")))
        there = folders.stats(self.spark, folder, self.ignored)
        sure = there.filter("kind != ''").select("path", "modified_at").unionByName(there.filter("kind = ''").join(here.select("path"), "path", "left_semi").select("path", "modified_at"))
        diff = self.store.write("rescan", tables.rescan(sure, here))
        if folder not in self.folders:
            self.folders.append(folder)
        # only what is new, changed or incomplete is opened; its names come to the driver in groups of a bounded size
        sound = here.filter("content_hash <> ''").select("path", "modified_at")
        fresh = self.store.write("rescan_paths", there.select("path", "modified_at").join(sound, ["path", "modified_at"], "left_anti").select("path"))
        paths = (r["path"] for r in fresh.toLocalIterator())
        while group := list(islice(paths, self.GROUP)):
            self._index(folders.walk(self.spark, folder, self.ignored, group), embed_chunks, False)
        self.remove_paths(diff.filter("action = 'gone'").select("path"))
        return diff

    #: Files that a rescan opens by one job.
    GROUP = 10_000

    def remove_paths(self, gone: DataFrame) -> None:
        self._indexed_too(self.files.join(gone.select("path"), "path", "left_semi"))
        files, chunks, _ = tables.delete_files(self.files, self.chunks, gone)
        self._commit(self.generation, files=files, chunks=chunks)

    def remove_folder(self, folder: str, delete: bool = True) -> None:
        self.folders = [f for f in self.folders if f != folder]
        if delete:
            self._indexed_too(self.files.filter(tables.inside(F.col("path"), folder.removeprefix("file://"))))
            files, chunks = tables.delete_folder(self.files, self.chunks, folder.removeprefix("file://"))
            self._commit(self.generation, files=files, chunks=chunks)

    def watch(self, events: DataFrame, checkpoint: str, embed_chunks: EmbedChunks | None = None) -> StreamingQuery:
        """Applies a stream of file events (path, type, ts): written files are indexed, deleted ones removed."""
        index = lambda paths: self.index_paths([r["path"] for r in paths.collect()], embed_chunks)  # noqa: E731 - the paths of one batch
        return watch.apply_events(events, index, self.remove_paths, checkpoint)

    def watch_folder(self, folder: str, checkpoint: str, embed_chunks: EmbedChunks | None = None, delay: float = 0.5) -> StreamingQuery:
        """Applies a folder's changes as they come, each path's last one delay seconds after it; runs until it is stopped, and goes on from its checkpoint."""
        if folder not in self.folders:
            self.folders.append(folder)
        events = watch.file_events(watching.changes(self.spark, folder, f"{self.store.root}/snapshots-{zlib.crc32(folder.encode()):08x}", ignored=self.ignored))
        index = lambda paths: self.index_paths([r["path"] for r in paths.collect()], embed_chunks)  # noqa: E731 - the paths of one batch
        return watch.apply_events(timers.debounced(events, delay), index, self.remove_paths, checkpoint, every="0 seconds")

    def tick(self, report: Callable[[dict], None], checkpoint: str, every: str = "1 second") -> StreamingQuery:
        """Reports the status every so often."""
        return watch.ticker(self.spark, every, lambda: report(self.status().first().asDict()), checkpoint)

    def autosave(self, root: str, checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
        """Saves to root every so often, where something changed."""
        saved = [-1]

        def act() -> None:
            if saved[0] != self.changes:
                at = self.changes
                self.save(root)
                saved[0] = at

        return watch.ticker(self.spark, every, act, checkpoint)

    # --- reports and settings

    def needs_reindex(self) -> bool:
        """Whether chunks lack their vectors, or were embedded by another model."""
        other = ~F.col("embedding_model").isin("", self.model) if self.model else F.lit(False)
        return not self.chunks.filter(F.col("embedding").isNull() | other).isEmpty()

    def missing_vectors(self) -> bool:
        return tables.has_missing_blobs(self.chunks)

    def failures(self) -> DataFrame:
        """The registry of failed paths."""
        return reports.registry(self.failed)

    def status(self, failures: DataFrame | None = None) -> DataFrame:
        return reports.status(self.files, self.failures() if failures is None else failures)

    def failure_groups(self) -> DataFrame:
        return reports.failure_groups(self.failures())

    def stats(self) -> DataFrame:
        """Calls of the language model, their mean time, and the parse cache's hits and misses."""
        return reports.call_stats(self.spark.createDataFrame(self.calls, "ms long, hit boolean"))

    def set_indexing(self, **values: int) -> None:
        """workers and rate_limit_per_minute; none is set if one is out of bounds."""
        for name, v in values.items():
            low, high, _ = self.BOUNDS.get(f"indexing.{name}", (1, 0, 0))
            if not low <= v <= high:
                raise ConfigInvalid(f"{name} must be between {low} and {high}" if low <= high else f"no such setting: {name}")
        for name, v in values.items():
            self.settings = tables.put_setting(self.settings, f"indexing.{name}", str(v))

    def indexing(self) -> dict[str, int]:
        """The settings; values out of bounds or unreadable count as unset."""
        saved = {r["key"]: r["value"] for r in self.settings.filter(F.col("key").isin(*self.BOUNDS)).collect()}
        ok = lambda k: str(saved.get(k, "")).isdigit() and self.BOUNDS[k][0] <= int(saved[k]) <= self.BOUNDS[k][1]
        return {k.removeprefix("indexing."): int(saved[k]) if ok(k) else d for k, (_, _, d) in self.BOUNDS.items()}

    def exact_threshold(self, default: int = 5000) -> int:
        """Files up to which a search compares all vectors."""
        v = tables.setting(self.settings, "brute_force_threshold", "")
        return int(v) if v.strip().isdigit() and int(v) > 0 else default

    # --- storage

    def save(self, root: str) -> None:
        """Writes the engine's tables to root. An index lies where the engine indexes, and is found again by an engine that loads from there."""
        store = self.store if root.rstrip("/") == (self._root or "").rstrip("/") else tables.Store(self.spark, root)
        for name in ("files", "chunks", "failed", "settings"):
            store.write(name, getattr(self, name))
        names = [("folder", n) for n in self.folders] + [("ignored", n) for n in self.ignored]
        store.write("folder_names", self.spark.createDataFrame(names, "kind string, name string"))
        if store is self._store and self.vector_index() is not None:
            self._index_state(store.version("chunks"))
        migrations.stamp(store)

    def load(self, root: str) -> None:
        """Takes up a store, brought to the current version first, with its index if that holds the stored chunks."""
        store = tables.Store(self.spark, root)
        migrations.migrate(store)
        for name in ("files", "chunks", "failed", "settings"):
            if store.exists(name):
                setattr(self, name, store.read(name))
        if store.exists("folder_names"):
            names = store.read("folder_names").collect()
            self.folders = [r["name"] for r in names if r["kind"] == "folder"]
            self.ignored = tuple(r["name"] for r in names if r["kind"] == "ignored")
        self._index_, self.names = None, None
        if self._root is None or root.rstrip("/") == self._root.rstrip("/"):
            self._root, self._store = root, store
            state = store.read("index_state").first() if store.exists("index_state") and store.exists("chunks") else None
            if state and state["version"] == store.version("chunks"):
                self._index_, self._indexed = VectorIndex(self.spark, root, store=store), state["model"]
