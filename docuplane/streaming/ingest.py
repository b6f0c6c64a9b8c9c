"""Ingest as a stream of files, and streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docuplane.functions.vectors import Embedder
from docuplane.operators import chunking, index as I
from docuplane.sources.files import Extractor, extract
from docuplane.sources.store import Store

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def index_batch(store: Store, files: DataFrame, index: str, base: str, extractor: Extractor | None = None, max_depth: int = 5, max_chars: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Extract, curate and put one batch of files; returns the parts written and the errors (path, type, message).

    A file all of whose parts are empty is an EmptyExtraction; a content that is cut is a ContentTruncated; a file that failed after a part counts as done.
    """
    parts = extract(files, extractor, max_depth).persist()
    good = parts.where("error_type is null or error_type in ('EmptyExtraction', 'DepthLimitExceeded')")
    store.put(I.curate(good, index, base, max_chars), index)
    empty = parts.groupBy("source_path").agg(F.bool_and(F.trim("content") == "").alias("e")).where("e").select("source_path", F.lit("EmptyExtraction").alias("error_type"), F.lit("all parts are empty").alias("message"))
    errors = parts.where("error_type is not null and error_type <> 'EmptyExtraction'").select("source_path", "error_type", "message").unionByName(empty).unionByName(I.truncated(good, max_chars)).distinct()
    return parts, errors


def ingest_stream(spark: SparkSession, store: Store, folder: str, index: str, checkpoint: str, base: str | None = None, extractor: Extractor | None = None, files_per_batch: int = 1000, max_depth: int = 5, max_chars: int = 100_000):
    """Index all files of a folder that weren't seen before, in batches, then stop; a restart goes on from the checkpoint.

    Putting a batch twice gives the same rows, so a batch that is repeated after a failure does no harm.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)

    def put(batch: DataFrame, _: int) -> None:
        parts, _errors = index_batch(store, batch, index, base or folder, extractor, max_depth, max_chars)
        parts.unpersist()

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_index(store: Store, index: str, embedder: Embedder, context_length: int = 8192, overlap: int = 200) -> int:
    """Chunk and embed the rows without vectors; returns how many chunks were written."""
    todo = store.unembedded(index)
    if todo is None:
        return 0
    pieces = todo.where("content is not null").select("doc_id", F.posexplode(chunking.chunks(F.col("content"), context_length * 4, overlap)).alias("chunk_no", "chunk"))
    rows = pieces.select("doc_id", "chunk_no", embedder.column()("chunk").alias("embedding")).persist()
    n = rows.count()
    if n:
        store.put_chunks(rows, index)
    rows.unpersist()
    return n


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """events with ts as a timestamp and, on a stream, a watermark; late=None leaves one that is there already."""
    if dict(events.dtypes)["ts"] != "timestamp":
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if events.isStreaming and late else events


def event_windows(events: DataFrame, late: str | None = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums per event type in event-time windows; works on streams (late rows dropped after `late`) and tables."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """Sessions of each user: events with no more than `gap` between them."""
    s = _timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def first_deliveries(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream without repeated event ids that come within `late` of each other."""
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])
