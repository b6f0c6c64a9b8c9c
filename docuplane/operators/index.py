"""The index rows: curation of raw documents, live rows, upserts, catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docuplane.functions import meta as M, text as X


def live(docs: DataFrame, *columns: str, key: str = "doc_id", order: tuple[str, ...] = ("indexed_at", "row_id")) -> DataFrame:
    """One row per key: the last written. Only the named columns (all if none) are carried through the shuffle."""
    cols = [c for c in (columns or docs.columns) if c != key]
    if not cols:
        return docs.select(key).distinct()
    last = docs.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("x"))
    return last.select(key, *[F.col("x").getField(c).alias(c) for c in cols])


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ()) -> DataFrame:
    """old with whole rows replaced or added by new. Of a key that new repeats, the row that is last by the columns `order` counts; without
    an order the last by all columns, so that a repetition gives the same rows."""
    cols = [c for c in new.columns if c != key]
    rank = [F.col(c) for c in order] or [F.to_json(F.struct(*cols))]
    last = new.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*rank)).alias("x")).select(key, *[F.col("x").getField(c).alias(c) for c in cols])
    return old.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def outcomes(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, outcome of each distinct key of new rows put over old ones: updated, created, or refused for a null key."""
    have = old.select(key).distinct().withColumn("have", F.lit(True))
    what = F.when(F.col(key).isNull(), "refused").when(F.col("have"), "updated").otherwise("created")
    return new.select(key).distinct().join(have, key, "left").select(key, what.alias("outcome"))


def truncated(raw: DataFrame, max_chars: int) -> DataFrame:
    """source_path, error_type, message of raw documents whose content curate() cuts."""
    long = F.length(F.regexp_replace("content", r"(?U)^\s+|\s+$", ""))
    cut = raw.select("source_path", "display_path", long.alias("n")).where(F.col("n") > max_chars) if max_chars else raw.select("source_path", "display_path", F.lit(0).alias("n")).limit(0)
    return cut.select("source_path", F.lit("ContentTruncated").alias("error_type"), F.concat("display_path", F.lit(": "), F.col("n").cast("string"), F.lit(f" characters cut to {max_chars}")).alias("message"))


def curate(raw: DataFrame, index: str, base: str = "", max_chars: int = 100_000) -> DataFrame:
    """Index rows of raw documents (source_path, part, content, metadata MAP<STRING, ARRAY<STRING>>, display_path, extracted_from).

    Content is trimmed, cut to max_chars characters (0: not at all) and its blank lines are condensed; missing values and empty
    lists are null; a size that is no whole number is null and the row stays.
    """
    m = F.col("metadata")
    content = F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)^\s+|\s+$", "")
    if max_chars:
        content = F.left(content, F.lit(max_chars))

    def listed(c: Column) -> Column:
        return F.when(F.size(c) > 0, c)

    first = lambda k: M.single(M.first_present(m, M.SOURCE_KEYS[k]))
    mail = {k: listed(F.try_element_at(m, F.lit(h))) for k, h in zip(("email_from", "email_to", "email_cc", "email_bcc"), M.ADDRESS_KEYS)}
    out = raw.select(
        F.lit(index).alias("index_name"),
        M.file_doc_id(F.col("source_path"), F.col("part")).alias("doc_id"),
        "source_path",
        M.display_path(F.coalesce("display_path", "source_path"), F.lit(base)).alias("display_path"),
        F.when(F.coalesce("extracted_from", F.lit("")).startswith(base + "/") if base else F.lit(True), F.coalesce(F.when(F.col("extracted_from") != "", M.display_path(F.col("extracted_from"), F.lit(base))), F.lit(""))).otherwise("").alias("extracted_from"),
        X.condense_blank_lines(content).alias("content"),
        M.raw_metadata(m).alias("metadata"),
        M.mime_base(first("content_type")).alias("content_type"),
        first("creator").alias("creator"),
        first("created").alias("created"),
        M.year_of(first("created")).alias("created_year"),
        first("modified").alias("modified"),
        M.whole_number(first("file_size")).alias("file_size"),
        F.nullif(M.message_id(first("message_id")), F.lit("")).alias("message_id"),
        F.nullif(M.message_id(first("in_reply_to")), F.lit("")).alias("in_reply_to"),
        listed(M.references(M.first_present(m, M.SOURCE_KEYS["references"]))).alias("references"),
        listed(M.address_set(*[F.try_element_at(m, F.lit(h)) for h in M.ADDRESS_KEYS])).alias("email_addresses"),
        *[c.alias(k) for k, c in mail.items()],
        M.single(M.first_present(m, M.SUBJECT_KEYS)).alias("email_subject"),
        F.lit(False).alias("has_embeddings"),
    )
    return out.withColumn("document_type", M.document_type(F.col("extracted_from")))


def size_estimate(columns: dict[str, Column]) -> Column:
    """Estimated JSON bytes of a row: keys, strings with a tenth for escapes, 5 for booleans, 20 for numbers, 4 for null."""
    total = F.lit(2).cast("bigint")
    for k, (kind, c) in columns.items():
        length = F.octet_length(c.cast("string"))
        value = {"string": length + F.floor(length / 10) + 2, "boolean": F.lit(5), "number": F.lit(20)}[kind]
        total = total + len(k.encode()) + 4 + F.when(c.isNull(), 4).otherwise(value)
    return total.cast("bigint")


def fit_size(content: Column, size: Column, most: int) -> Column:
    """Content cut so that a row of `size` estimated bytes gets below `most`."""
    cut = F.floor(F.length(content) * F.lit(most) * 9 / (size * 10)).cast("int")
    return F.when(size > most, F.left(content, cut)).otherwise(content)


def state_check(df: DataFrame, wanted: dict[str, str]) -> list[str]:
    """Columns of an index whose type isn't the wanted one; a non-empty answer means the index is to be made anew."""
    have = dict(df.dtypes)
    return sorted(k for k, t in wanted.items() if have.get(k) != t)
