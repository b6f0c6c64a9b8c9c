"""Metadata columns: prioritised keys, types, addresses, ids, sizes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The metadata keys a field is read from, the first that is present counts.
SOURCE_KEYS = {
    "content_type": ["Content-Type"],
    "creator": ["dc:creator", "xmp:dc:creator", "Author", "meta:author", "creator"],
    "created": ["dcterms:created", "Creation-Date", "meta:creation-date", "created", "date"],
    "modified": ["dcterms:modified", "Last-Modified", "meta:save-date", "modified"],
    "file_size": ["Content-Length"],
    "message_id": ["Message:Raw-Header:Message-ID", "Message-ID"],
    "in_reply_to": ["Message:Raw-Header:In-Reply-To", "In-Reply-To"],
    "references": ["Message:Raw-Header:References", "References"],
}
# Headers with addresses, keys of the subject, internal keys, prefixes hidden from responses.
ADDRESS_KEYS = ["Message-From", "Message-To", "Message-CC", "Message-BCC"]
SUBJECT_KEYS = ["Message-Subject", "dc:subject", "subject"]
INTERNAL_KEYS = ["X-TIKA:content", "X-TIKA:embedded_resource_path", "resourceName", "X-TIKA:content_handler", "X-TIKA:content_handler_type", "X-TIKA:parse_time_millis", "X-TIKA:Parsed-By", "X-TIKA:Parsed-By-Full-Set"]
DROPPED_KEYS = [k for k in INTERNAL_KEYS if k != "resourceName"]
HIDDEN_PREFIXES = ["X-TIKA:", "X-Parsed-By", "pdf:", "access_permission:", "dc:", "dcterms:", "meta:", "cp:", "extended-properties:", "_docuplane_"]
OWN_PREFIX = "_docuplane_"
# Short labels of MIME types.
MIME_LABELS = {
    "application/pdf": "PDF",
    "application/msword": "Word",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "Word",
    "application/vnd.ms-excel": "Excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "Excel",
    "application/vnd.ms-powerpoint": "PowerPoint",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "PowerPoint",
    "text/plain": "Text",
    "text/html": "HTML",
    "text/csv": "CSV",
    "text/markdown": "Markdown",
    "text/rtf": "RTF",
    "application/rtf": "RTF",
    "application/zip": "ZIP",
    "application/x-tar": "TAR",
    "application/gzip": "GZip",
    "application/json": "JSON",
    "application/xml": "XML",
    "application/epub+zip": "EPUB",
    "application/x-mobipocket-ebook": "Mobi",
    "image/png": "PNG",
    "image/jpeg": "JPEG",
    "image/gif": "GIF",
    "image/svg+xml": "SVG",
    "message/rfc822": "Email",
}
# Labels of the command line, where they differ from MIME_LABELS (None: the type as it is).
CLI_LABELS = MIME_LABELS | {
    "text/xml": "XML", "image/tiff": "TIFF", "audio/mpeg": "MP3", "audio/mp3": "MP3", "video/mp4": "MP4", "application/mbox": "Mbox",
    "text/rtf": None, "application/x-tar": None, "application/gzip": None, "application/epub+zip": None, "application/x-mobipocket-ebook": None, "image/svg+xml": None,
}
PARENT, ATTACHMENT = "Parent Document", "Attachment"


def first_present(metadata: Column, keys: list[str]) -> Column:
    """The values (an array) of the first key that is there, even if they are empty."""
    return F.coalesce(*[F.try_element_at(metadata, F.lit(k)) for k in keys])


def single(values: Column) -> Column:
    """The first of an array of values, null where there is none."""
    return F.try_element_at(values, F.lit(1))


def mime_base(content_type: Column) -> Column:
    return F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))


def label_of(mime: Column, labels: dict[str, str | None] = MIME_LABELS) -> Column:
    """The short label of a MIME type; unknown ones as they are."""
    m = F.create_map(*[F.lit(x) for k, v in labels.items() if v for x in (k, v)])
    return F.coalesce(F.try_element_at(m, mime), mime)


def types_of(label: str) -> list[str]:
    """All MIME types behind a label; the value itself where it is none."""
    return [k for k, v in MIME_LABELS.items() if v == label] or [label]


def whole_number(text: Column) -> Column:
    """A BIGINT from an optional sign and digits only; null else."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def year_of(created: Column) -> Column:
    """The year that the first four characters spell; null for shorter strings."""
    return F.when(F.length(created) >= 4, whole_number(F.substring(created, 1, 4)))


def document_type(extracted_from: Column) -> Column:
    return F.when(F.coalesce(extracted_from, F.lit("")) == "", PARENT).otherwise(ATTACHMENT)


def message_id(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), r"^[<>]+|[<>]+$", "")


def references(values: Column) -> Column:
    """All message ids of reference headers, split at white space."""
    parts = F.flatten(F.transform(values, lambda x: F.split(x, r"\s+")))
    return F.filter(F.transform(parts, message_id), lambda x: x != "")


def email_address(raw: Column) -> Column:
    """The address between angle brackets, else the whole text; null without @."""
    inner = F.when(raw.rlike("^[^<]*<[^>]*>"), F.regexp_extract(raw, "^[^<]*<([^>]*)>", 1)).otherwise(raw)
    out = F.regexp_replace(inner, r"(?U)^\s+|\s+$", "")
    return F.when(out.contains("@"), out)


def address_set(*headers: Column) -> Column:
    """Lower-case addresses of header arrays, each once, in order."""
    every = F.concat(*[F.coalesce(h, F.array().cast("array<string>")) for h in headers])
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.lower(email_address(x))), lambda x: x.isNotNull()))


def visible(metadata: Column) -> Column:
    """Metadata without the keys that responses hide."""
    def shown(k: Column, _: Column) -> Column:
        ok = F.lit(True)
        for p in HIDDEN_PREFIXES:
            ok = ok & ~k.startswith(p)
        return ok

    return F.map_filter(metadata, shown)


def raw_metadata(metadata: Column) -> Column:
    """Metadata without the internal keys of the extraction and its own bookkeeping."""
    return F.map_filter(metadata, lambda k, _: ~k.isin(*DROPPED_KEYS) & ~k.startswith(OWN_PREFIX))


def overlay(metadata: Column, curated: Column) -> Column:
    """Raw metadata with curated values laid over it; the curated ones win."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(metadata, lambda k, _: ~F.array_contains(F.map_keys(curated), k))), F.map_entries(curated)))


def human_size(n: Column) -> Column:
    """B, KB, MB, GB with one decimal, base 1024."""
    x = n.cast("double")
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024**2, F.format_string("%.1f KB", x / 1024))
        .when(n < 1024**3, F.format_string("%.1f MB", x / 1024**2))
        .otherwise(F.format_string("%.1f GB", x / 1024**3))
    )


def file_doc_id(path: Column, part: Column) -> Column:
    """16 hex digits for the part of a file."""
    return F.substring(F.sha2(F.concat_ws(":", path, part.cast("string")), 256), 1, 16)


def store_dir(path: Column, root: str, index: str) -> Column:
    """Where the parts unpacked from a container are kept: two levels of two hex digits, then the hash."""
    h = F.substring(F.sha2(path, 256), 1, 16)
    return F.concat_ws("/", F.lit(root), F.lit(index), F.substring(h, 1, 2), F.substring(h, 3, 2), h)


def display_path(path: Column, base: Column) -> Column:
    """A path relative to base (by whole components), else its file name."""
    b = F.regexp_replace(base, "/+$", "")
    return F.when(path.startswith(F.concat(b, F.lit("/"))), F.substring(path, F.length(b) + 2, F.length(path))).otherwise(F.element_at(F.split(path, "/"), -1))


def backoff_seconds(attempt: Column, base: float = 1.0, most: float = 30.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(attempt, F.lit(31))), F.lit(most))
