"""Replies of an extraction service (JSON arrays of flat objects, one per part of a file) as parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The keys of a reply that aren't metadata.
CONTENT, INSIDE = "X-TIKA:content", "X-TIKA:embedded_resource_path"


def _values(v: Column) -> Column:
    """A JSON value as a list of strings: arrays as they are, anything else as one."""
    many = F.from_json(v, "array<string>")
    return F.when(v.rlike(r"^\s*\[") & many.isNotNull(), F.filter(many, lambda x: x.isNotNull())).when(v.isNotNull(), F.array(v))


def reply_parts(replies: DataFrame, max_depth: int = 5) -> DataFrame:
    """source_path, part, display_path, extracted_from, content, metadata, error_type, message of replies (source_path, reply).

    The first object is the file itself, the others lie in it under their embedded path; one without gets the name embedded-N by its place.
    A part deeper than max_depth is kept without content as DepthLimitExceeded. An empty array is one empty part; a reply that
    is no array of objects is one part with ExtractionError. Null values of metadata are left out. Repeated rows stay.
    """
    parsed = F.from_json("reply", "array<map<string,string>>", {"mode": "PERMISSIVE"})
    bad = parsed.isNull() | F.exists(parsed, lambda x: x.isNull())
    one = F.array(F.create_map().cast("map<string,string>"))
    rows = replies.select("source_path", bad.alias("bad"), F.posexplode(F.when(bad | (F.size(parsed) == 0), one).otherwise(parsed)).alias("part", "x"))
    path = F.regexp_replace(F.coalesce(F.try_element_at("x", F.lit(INSIDE)), F.concat(F.lit("/embedded-"), F.col("part").cast("string"))), "^/*", "/")
    shown = F.when(F.col("part") == 0, F.col("source_path")).otherwise(F.concat("source_path", path))
    inside = F.when(F.col("part") == 0, F.lit("")).otherwise(F.regexp_replace(shown, "/[^/]*$", ""))
    depth = F.when(F.col("part") == 0, 0).otherwise(F.size(F.split(path, "/")) - 1)
    deep = depth > max_depth
    meta = F.transform_values(F.map_filter("x", lambda k, v: ~k.isin(CONTENT, INSIDE) & v.isNotNull()), lambda k, v: _values(v))
    content = F.coalesce(F.try_element_at("x", F.lit(CONTENT)), F.lit(""))
    kind = F.when(F.col("bad"), "ExtractionError").when(deep, "DepthLimitExceeded").when(F.trim(content) == "", "EmptyExtraction")
    message = F.when(F.col("bad"), "the reply is no list of parts").when(deep, f"deeper than {max_depth}").when(kind.isNotNull(), "no text")
    return rows.select("source_path", "part", shown.alias("display_path"), inside.alias("extracted_from"), F.when(deep, "").otherwise(content).alias("content"), meta.alias("metadata"), kind.alias("error_type"), message.alias("message"))


def entry_parts(parts: DataFrame, entries: DataFrame) -> DataFrame:
    """entries (source_path, place, name) of archives with `part`, the part of the same file that they are: that whose path in the file ends in
    the entry's whole name, else, where only one part has its last segment, that one; null for an entry that no part names.
    """
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    inner = F.expr("substring(display_path, length(source_path) + 2)")
    p = parts.where("part > 0").select("source_path", "part", inner.alias("inner"), tail(inner).alias("last"))
    whole = p.groupBy("source_path", F.col("inner").alias("name")).agg(F.min("part").alias("by_name"))
    single = p.groupBy("source_path", "last").agg(F.min("part").alias("by_last"), F.count("*").alias("n")).where("n = 1").drop("n")
    e = entries.withColumn("last", tail(F.col("name")))
    found = e.join(whole, ["source_path", "name"], "left").join(single, ["source_path", "last"], "left")
    return found.select(*entries.columns, F.coalesce("by_name", "by_last").alias("part"))
