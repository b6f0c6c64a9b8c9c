"""What an application asks of a store: searches, documents, indices, ingest, embedding, jobs."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from docuplane.functions import meta as M
from docuplane.functions.vectors import Embedder
from docuplane.operators import related as R, search as S
from docuplane.sources.files import Extractor, listed, walk
from docuplane.sources.store import Store
from docuplane.streaming import ingest as G

JOB = "job_id string, source_dir string, index_name string, status string, job_type string, total_files bigint, extracted bigint, processed bigint, failed bigint, n_empty bigint, skipped bigint, created_at timestamp, finished_at timestamp, at timestamp"
ERROR = "job_id string, file_path string, error_type string, message string, error_ts timestamp"
MODEL = "index_name string, model string, backend string, dimension bigint, context_length bigint, query_prefix string, updated_at timestamp"
# Types a browser may show, and those it may never run.
PREVIEW_ALLOWED = ("application/pdf", "image/png", "image/jpeg", "image/gif", "image/webp", "text/plain", "text/csv", "message/rfc822")
PREVIEW_DENIED = ("text/html", "image/svg+xml", "application/xhtml+xml", "application/javascript", "text/javascript")


def previewable(mime: str) -> bool:
    base = mime.split(";")[0].strip().lower()
    return base in PREVIEW_ALLOWED and base not in PREVIEW_DENIED


def retry_scope(kind: str | None, ocr_changed: bool = False) -> dict:
    """Arguments for jobs.failed_paths of what a retry takes: failed, empty or truncated files; all if only the OCR settings changed."""
    scopes = {"failed": {"exclude": ("EmptyExtraction", "ContentTruncated")}, "empty": {"only": "EmptyExtraction"}, "truncated": {"only": "ContentTruncated"}}
    if kind is None and not ocr_changed:
        raise ValueError("say what to retry")
    return scopes[kind] if kind else {}


class JobLog:
    """Append-only tables of jobs, errors and embedding models; the last row of a job, the first of an error, count."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def _read(self, name: str, schema: str) -> DataFrame:
        p, fs = self.store._fs(f"{self.store.root}/{name}")
        return self.spark.read.schema(schema).parquet(p.toString()) if fs.exists(p) else self.spark.createDataFrame([], schema)

    def _add(self, name: str, rows: list[dict] | DataFrame, schema: str) -> None:
        names = [c.split()[0] for c in schema.split(", ")]
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
        small = df if isinstance(rows, DataFrame) else df.coalesce(1)
        small.select(*names).write.mode("append").parquet(f"{self.store.root}/{name}")

    def jobs(self, status: str | None = None) -> DataFrame:
        """The state of every job, the newest first."""
        cols = [c.split()[0] for c in JOB.split(", ") if not c.startswith(("job_id", "at "))]
        last = self._read("jobs", JOB).groupBy("job_id").agg(F.max_by(F.struct(*cols), "at").alias("x")).select("job_id", "x.*")
        return (last.where(F.col("status") == status) if status else last).orderBy(F.desc("created_at"), "job_id")

    def create(self, source_dir: str, index: str, job_type: str = "ingest", total: int = 0) -> str:
        now = datetime.now(timezone.utc)
        job = f"job-{uuid.uuid4().hex[:16]}"
        self._add("jobs", [{"job_id": job, "source_dir": source_dir, "index_name": index, "status": "running", "job_type": job_type, "total_files": total, "extracted": 0, "processed": 0, "failed": 0, "n_empty": 0, "skipped": 0, "created_at": now, "at": now}], JOB)
        return job

    def update(self, job: str, **values) -> None:
        """Counters or the status of a job; an end status sets finished_at."""
        row = self.jobs().where(F.col("job_id") == job).first()
        if row is None:
            raise ValueError(f"no job {job}")
        now = datetime.now(timezone.utc)
        new = row.asDict() | values | {"at": now}
        if values.get("status") in ("completed", "failed", "interrupted"):
            new["finished_at"] = now
        self._add("jobs", [new], JOB)

    def record(self, job: str, errors: DataFrame) -> None:
        """Errors (source_path, error_type, message) of a job."""
        self._add("job_errors", errors.select(F.lit(job).alias("job_id"), F.col("source_path").alias("file_path"), "error_type", "message", F.current_timestamp().alias("error_ts")), ERROR)

    def errors(self, job: str | None = None) -> DataFrame:
        from docuplane.operators.jobs import first_errors

        rows = first_errors(self._read("job_errors", ERROR))
        return (rows.where(F.col("job_id") == job) if job else rows).orderBy("error_ts", "file_path")

    def forget(self, index: str) -> None:
        """Drop the jobs, errors and models of an index; each table is written anew beside the old one and then takes its place."""
        from docuplane.operators.jobs import without_index

        jobs, errors = without_index(self._read("jobs", JOB), self._read("job_errors", ERROR), index)
        models = self._read("models", MODEL).where(F.col("index_name") != index)
        new = [(n, df) for n, df in (("job_errors", errors), ("jobs", jobs), ("models", models)) if self.store._fs(f"{self.store.root}/{n}")[1].exists(self.store._fs(f"{self.store.root}/{n}")[0])]
        for name, df in new:
            df.write.mode("overwrite").parquet(f"{self.store.root}/.{name}.new")
        for name, _ in new:
            old, fs = self.store._fs(f"{self.store.root}/{name}")
            fs.delete(old, True)
            fs.rename(self.store._fs(f"{self.store.root}/.{name}.new")[0], old)

    def set_model(self, index: str, model: str, backend: str, dimension: int, context_length: int, prefix: str = "") -> None:
        self._add("models", [{"index_name": index, "model": model, "backend": backend, "dimension": dimension, "context_length": context_length, "query_prefix": prefix, "updated_at": datetime.now(timezone.utc)}], MODEL)

    def models(self) -> DataFrame:
        from docuplane.operators.jobs import latest_models

        return latest_models(self._read("models", MODEL))


@dataclass
class Answer:
    """A search response: the page, the number of hits and the facets (label -> values by falling count)."""

    rows: list[dict]
    total: int
    facets: dict[str, list[str]] = field(default_factory=dict)


class Service:
    """Searches, documents and maintenance over one store."""

    def __init__(self, store: Store, extractor: Extractor | None = None, max_depth: int = 5, max_chars: int = 100_000):
        self.store, self.log, self.extractor, self.max_depth, self.max_chars = store, JobLog(store), extractor, max_depth, max_chars

    def search(self, request: S.SearchRequest, embedder: Embedder | None = None, ratio: float | None = None) -> Answer:
        """A text search; with an embedder a hybrid one (fused ranks, or weighted by ratio). Total and facets are those of the text."""
        r = request.checked()
        docs = self.store.docs(*r.indices)
        if docs is None:
            return Answer([], 0)
        hits = S.matches(docs, r.query).where(S.filter_column(r.filters))
        if r.wants_facets:  # the total is one more facet of the same pass
            counted = S.facet_counts(hits.withColumn("__all", F.lit("all")), {**S.FACETS, "__all": "__all"}).persist()
            total = next((x.n for x in counted.where("facet = '__all'").collect()), 0)
            facets = {x.facet: x.shown_values for x in S.shown_facets(counted.where("facet <> '__all'")).orderBy("place").collect()}
            counted.unpersist()
        else:
            total, facets = hits.count(), {}
        page = S.search(docs, r) if embedder is None else self._hybrid(docs, r, embedder, ratio)
        shown = [c for c in ("doc_id", "index_name", "display_path", "extracted_from", "score", "snippet", "content_type", "creator", "created", "file_size") if c in page.columns]
        return Answer([x.asDict() for x in page.select(*shown).collect()], total, facets)

    def _hybrid(self, docs: DataFrame, r: S.SearchRequest, embedder: Embedder, ratio: float | None) -> DataFrame:
        k = r.offset + r.limit
        kept = docs.where(S.filter_column(r.filters))
        kw = S.ranked(S.content_score(docs, r.query).where(S.filter_column(r.filters)), k, "doc_id")
        chunks = None
        for i in r.indices or self.store.indices():
            if (c := self.store.chunks(i)) is not None:
                chunks = c if chunks is None else chunks.unionByName(c)
        if chunks is None:
            raise ValueError("the indices have no embeddings")
        names = r.indices or self.store.indices()
        S.one_model(self.log.models(), names)
        prefix = self.log.models().where(F.col("index_name") == names[0]).first().query_prefix or ""
        asked = r.query if prefix and getattr(embedder, "prefix", "") == prefix else prefix + r.query
        mine = chunks.join(kept.select("doc_id"), "doc_id", "left_semi")
        q = self.store.spark.createDataFrame([(0, [float(x) for x in embedder.embed_query(asked)])], "query_id bigint, vector array<double>")
        vec = S.knn(mine, q, k, row_key="doc_id", group=F.col("doc_id")).select(F.col("key").alias("doc_id"), "score", "place")
        fused = S.fuse_ranks(kw, vec, "doc_id") if ratio is None else S.fuse_weighted(kw, vec, "doc_id", ratio)
        return S.page(fused.join(docs, "doc_id").withColumn("snippet", F.left("content", F.lit(200))), r.sort, r.limit, r.offset)

    def document(self, index: str, doc_id: str) -> dict | None:
        """A document with its visible metadata, attachments, parent and thread; None if it isn't there."""
        docs = self.store.docs(index)
        row = docs.where(F.col("doc_id") == doc_id).withColumn("metadata", M.visible(F.col("metadata"))).first() if docs is not None else None
        if row is None:
            return None
        kids = R.attachments(docs, index, row.display_path).select("doc_id", "display_path").collect()
        parent = docs.where(F.col("display_path") == row.extracted_from).orderBy("doc_id").select("doc_id", "display_path").first() if row.extracted_from else None
        thread = []
        if row.message_id:
            mails = docs.select("doc_id", "index_name", "message_id", "in_reply_to", F.col("references").alias("refs"), F.col("created").alias("sent_at"), "display_path")
            thread = R.thread_of(mails, doc_id).select("doc_id", "display_path", "sent_at").collect()
        return row.asDict() | {"attachments": [k.asDict() for k in kids], "parent": parent.asDict() if parent else None, "thread": [t.asDict() for t in thread]}

    def ingest(self, index: str, folder: str, paths: list[str] | None = None, resume: bool = False, limit: int | None = None, only: DataFrame | None = None, job_type: str = "ingest") -> str:
        """Index a folder (or some paths of it, or those in `only`, file_path) as a job; resume leaves out files that are in already, limit takes
        the first files by path. Returns the job id."""
        from docuplane.sources.files import without_indexed

        files = listed(self.store.spark, paths) if paths is not None else walk(self.store.spark, folder)
        if only is not None:
            files = files.join(only.select(F.col("file_path").alias("__p")).distinct(), F.regexp_replace("path", "^file:", "") == F.col("__p"), "left_semi")
        if limit is not None:
            files = files.orderBy("path").limit(limit)
        have = self.store.docs(index) if resume else None
        todo = without_indexed(files, have) if have is not None else files
        all_files, n = files.select("path").count(), todo.select("path").count()
        job = self.log.create(folder, index, job_type, all_files)
        try:
            parts, errors = G.index_batch(self.store, todo, index, folder, self.extractor, self.max_depth, self.max_chars)
            counts = parts.agg(F.count_distinct("source_path").alias("extracted"), F.count_if(F.expr("error_type is null or error_type = 'EmptyExtraction'")).alias("processed"), F.count_if(F.trim("content") == "").alias("n_empty")).first()
            self.log.record(job, errors)
            failed = errors.where("error_type not in ('EmptyExtraction', 'ContentTruncated')").select("source_path").distinct().count()
            parts.unpersist()
            self.log.update(job, status="completed", skipped=all_files - n, failed=failed, **counts.asDict())
        except Exception:
            self.log.update(job, status="failed")
            raise
        return job

    def retry(self, job: str, kind: str | None = None, ocr_changed: bool = False) -> str:
        """Index again what a job failed on (`failed`), found empty (`empty`) or cut (`truncated`); all its errors if only OCR settings changed."""
        from docuplane.operators.jobs import failed_paths

        row = self.log.jobs().where(F.col("job_id") == job).first()
        if row is None:
            raise ValueError(f"no job {job}")
        paths = failed_paths(self.log.errors(job), **retry_scope(kind, ocr_changed))
        return self.ingest(row.index_name, row.source_dir, only=paths, job_type="retry")

    def embed(self, index: str, embedder: Embedder, model: str, backend: str = "local", context_length: int = 8192, overlap: int = 200, force: bool = False) -> int:
        """Embed what has no vectors; another model than before only by force, which starts over."""
        from docuplane.operators.jobs import embed_guard

        now = self.log.models().where(F.col("index_name") == index).first()
        if embed_guard((now.model, now.backend, now.dimension) if now else None, (model, backend, embedder.dimension), force):
            self.store.clear_chunks(index)
        n = G.embed_index(self.store, index, embedder, context_length, overlap)
        self.log.set_model(index, model, backend, embedder.dimension, context_length, getattr(embedder, "prefix", ""))
        return n

    def reset(self, index: str, history: bool = True) -> None:
        """Drop an index with its vectors and, with `history`, its jobs, errors and model."""
        self.store.delete(index)
        if history:
            self.log.forget(index)
