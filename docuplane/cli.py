"""docuplane init | indices | ingest | resume | retry | embed | search | document | jobs | job | errors | reset, over one store folder."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from docuplane.functions.vectors import HashingEmbedder
from docuplane.operators.search import SearchRequest, parse_sort, resolve_indices
from docuplane.service import Service
from docuplane.session import build_session
from docuplane.sources.config import Config
from docuplane.sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docuplane")
    p.add_argument("--store")
    p.add_argument("--config")
    p.add_argument("--master")
    s = p.add_subparsers(dest="command", required=True)
    for name in ("init", "indices", "jobs", "config"):
        s.add_parser(name)
    for name in ("ingest", "resume"):
        c = s.add_parser(name)
        c.add_argument("index")
        c.add_argument("folder")
        c.add_argument("--limit", type=int)
    c = s.add_parser("retry")
    c.add_argument("job")
    c.add_argument("--kind", choices=["failed", "empty", "truncated"])
    c.add_argument("--ocr-changed", action="store_true")
    c = s.add_parser("embed")
    c.add_argument("index")
    c.add_argument("--force", action="store_true")
    c = s.add_parser("search")
    c.add_argument("query")
    c.add_argument("--index", default="")
    c.add_argument("--limit", type=int, default=20)
    c.add_argument("--offset", type=int, default=0)
    c.add_argument("--sort")
    c.add_argument("--created-from", type=int)
    c.add_argument("--created-to", type=int)
    c.add_argument("--filter", action="append", default=[], metavar="LABEL=VALUE")
    c.add_argument("--hybrid", action="store_true")
    for name, more in (("document", ("index", "doc_id")), ("errors", ("job",)), ("job", ("job",)), ("reset", ("index",))):
        c = s.add_parser(name)
        for m in more:
            c.add_argument(m)
    return p


def request(a: argparse.Namespace) -> SearchRequest:
    """The search that the arguments spell; both years are inclusive bounds."""
    filters: dict[str, list[str]] = {}
    for f in a.filter:
        label, _, value = f.partition("=")
        filters.setdefault(label, []).append(value)
    years = [f"from:{a.created_from}"] * (a.created_from is not None) + [f"to:{a.created_to}"] * (a.created_to is not None)
    if years:
        filters["Created"] = filters.get("Created", []) + years
    return SearchRequest(a.query, resolve_indices(a.index), a.limit, a.offset, filters, parse_sort(a.sort))


def run(args: list[str] | None = None, spark=None) -> object:
    """Run a command; returns what it prints as JSON."""
    a = parser().parse_args(args)
    config = Config.load(a.config)
    if a.command == "config":
        return vars(config)
    spark = spark or build_session(master=a.master)
    app = Service(Store(spark, a.store or config.data_dir), max_depth=config.max_extract_depth, max_chars=config.max_content_length)
    if a.command == "init":
        path, fs = app.store._fs(app.store.root)
        return {"store": app.store.root, "made": bool(fs.mkdirs(path))}
    embedder = HashingEmbedder(config.embed_dimension)
    if a.command == "indices":
        counts = {} if (docs := app.store.docs()) is None else {r.index_name: r["count"] for r in docs.groupBy("index_name").count().collect()}
        return [{"index": i, "documents": counts.get(i, 0), "embedded": app.store.chunks(i) is not None} for i in app.store.indices()]
    if a.command in ("ingest", "resume"):
        return {"job": app.ingest(a.index, a.folder, resume=a.command == "resume", limit=a.limit)}
    if a.command == "retry":
        return {"job": app.retry(a.job, a.kind, a.ocr_changed)}
    if a.command == "embed":
        return {"chunks": app.embed(a.index, embedder, "hashing", force=a.force, context_length=config.context_length, overlap=config.chunk_overlap)}
    if a.command == "search":
        answer = app.search(request(a), embedder if a.hybrid else None)
        return vars(answer)
    if a.command == "document":
        return app.document(a.index, a.doc_id)
    if a.command == "jobs":
        return [r.asDict() for r in app.log.jobs().collect()]
    if a.command == "job":
        found = app.log.jobs().where(F.col("job_id") == a.job).first()
        return found.asDict() if found else None
    if a.command == "errors":
        return [r.asDict() for r in app.log.errors(a.job).collect()]
    app.reset(a.index)
    return {"reset": a.index}


if __name__ == "__main__":
    print(json.dumps(run(), default=str, ensure_ascii=False, indent=1))
