"""Files as a source: folders, path lists, and the parts inside archives and mails."""

from __future__ import annotations

import email
import email.policy
import io
import posixpath
import zipfile
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


SYMLINK = 0o120000
CONTAINERS = (".zip", ".eml")
PARTS = "source_path string, part int, display_path string, extracted_from string, content string, metadata map<string,array<string>>, error_type string, message string"
UNNAMED = ("__TEXT__", "__METADATA__")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """All regular files below a folder: path, modificationTime, length, content. A missing folder is an error."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files of a list that exist."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def there(p: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(conf).exists(path)

    found = [p for p in dict.fromkeys(paths) if there(p)]
    read = spark.read.format("binaryFile")
    return read.load(found) if found else read.schema("path string, modificationTime timestamp, length bigint, content binary").load([])


class Extractor(ABC):
    """Turns the bytes of one file into text and metadata; containers are opened by `parts`."""

    @abstractmethod
    def read(self, name: str, data: bytes) -> tuple[str, dict[str, list[str]]]: ...


class PlainExtractor(Extractor):
    """Text files by their bytes, HTML without tags, mails with their headers; others have no text."""

    TYPES = {".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv", ".html": "text/html", ".htm": "text/html", ".eml": "message/rfc822", ".zip": "application/zip", ".json": "application/json", ".pdf": "application/pdf"}
    HEADERS = {"From": "Message-From", "To": "Message-To", "Cc": "Message-CC", "Bcc": "Message-BCC", "Subject": "Message-Subject", "Message-ID": "Message:Raw-Header:Message-ID", "In-Reply-To": "Message:Raw-Header:In-Reply-To", "References": "Message:Raw-Header:References", "Date": "date"}

    def read(self, name: str, data: bytes) -> tuple[str, dict[str, list[str]]]:
        kind = self.TYPES.get(posixpath.splitext(name.lower())[1], "application/octet-stream")
        meta = {"Content-Type": [kind], "Content-Length": [str(len(data))]}
        if kind == "message/rfc822":
            msg = email.message_from_bytes(data, policy=email.policy.default)
            for h, key in self.HEADERS.items():
                if values := [str(v) for v in msg.get_all(h, [])]:
                    meta[key] = [a.strip() for v in values for a in v.split(",")] if h in ("To", "Cc", "Bcc") else values
            body = msg.get_body(("plain", "html"))
            return (body.get_content() if body else ""), meta
        if kind.startswith("text/") or kind == "application/json":
            return data.decode("utf-8", "replace"), meta
        return "", meta


def entry_name(name: str) -> str | None:
    """The file name of an archive entry, None for unsafe and hidden ones."""
    last = name.split("/")[-1]
    return None if not name or "\0" in name or last in ("", ".", "..") or last.startswith(".") else last


def children(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """Name and bytes of what lies directly in a zip archive or mail; unnamed parts are embedded-N by their place."""
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i, info in enumerate(z.infolist(), 1):
                if info.is_dir() or (info.external_attr >> 16) & 0o170000 == SYMLINK or info.filename.endswith(".metadata.json") or info.filename in UNNAMED:
                    continue
                if entry_name(info.filename) is None:
                    continue
                yield info.filename, z.read(info)
    elif name.lower().endswith(".eml"):
        msg = email.message_from_bytes(data, policy=email.policy.default)
        for i, part in enumerate(msg.iter_attachments(), 1):
            payload = part.get_payload(decode=True)
            yield (entry_name(part.get_filename() or "") or f"embedded-{i}"), payload if payload is not None else b""


def file_parts(path: str, data: bytes, extractor: Extractor, max_depth: int = 5) -> Iterator[tuple]:
    """Rows of PARTS for a file: itself, then everything in it in order, depth first.

    An archive that can't be opened, or lies deeper than max_depth, is a row of its own with error_type; the others go on.
    """
    place = -1

    def rows(shown: str, inside: str, name: str, blob: bytes, depth: int) -> Iterator[tuple]:
        nonlocal place
        place += 1
        try:
            content, meta = extractor.read(name, blob)
            kind, said = ("EmptyExtraction", "no text") if not content.strip() and not name.lower().endswith(CONTAINERS) else (None, None)
        except Exception as e:
            content, meta, kind, said = "", {"Content-Length": [str(len(blob))]}, "ExtractionError", str(e)[:512]
        if name.lower().endswith(CONTAINERS) and depth >= max_depth:
            kind, said = "DepthLimitExceeded", f"deeper than {max_depth}"
        yield path, place, shown, inside, content, meta, kind, said
        if not name.lower().endswith(CONTAINERS) or kind == "DepthLimitExceeded":
            return
        try:
            for child, more in children(name, blob):
                yield from rows(f"{shown}/{child}", posixpath.dirname(f"{shown}/{child}") if "/" in child else shown, child, more, depth + 1)
        except Exception as e:
            place += 1
            yield path, place, shown, inside, "", {}, "UnpackError", str(e)[:512]

    yield from rows(path, "", path, data, 0)


def extract(files: DataFrame, extractor: Extractor | None = None, max_depth: int = 5) -> DataFrame:
    """Parts (PARTS) of all files of walk() or listed(); rows with error_type are the side output of failures."""
    tool = extractor or PlainExtractor()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARTS.split(", ")]
        for b in batches:
            for p, d in zip(b["path"], b["content"]):
                yield pd.DataFrame(list(file_parts(p.removeprefix("file:"), d, tool, max_depth)), columns=names)

    return files.select("path", "content").mapInPandas(run, PARTS)


def email_html(data: bytes) -> str | None:
    """The HTML of a mail with its inline images as data addresses; plain text escaped in <pre> where it has no HTML."""
    import base64

    msg = email.message_from_bytes(data, policy=email.policy.default)
    inline = {}
    html = plain = None
    for part in msg.walk():
        cid, kind = part.get("Content-ID"), part.get_content_type()
        if cid and kind.startswith("image/"):
            inline[cid.strip().strip("<>")] = f"data:{kind};base64,{base64.b64encode(part.get_payload(decode=True) or b'').decode()}"
        elif kind == "text/html" and html is None:
            html = part.get_content()
        elif kind == "text/plain" and plain is None and not part.get_filename():
            plain = part.get_content()
    if html is not None:
        for cid, address in inline.items():
            html = html.replace(f"cid:{cid}", address)
        return html
    if plain is not None:
        return "<pre>" + plain.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") + "</pre>"
    return None


def without_indexed(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Files whose own part isn't in the index yet."""
    return files.join(docs.select(F.col("source_path").alias("__p")).distinct(), F.regexp_replace("path", "^file:", "") == F.col("__p"), "left_anti")


def shown_size(df: DataFrame) -> DataFrame:
    """Total bytes of a file listing."""
    return df.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
