"""Documents related to a document: container, attachments, mail thread."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docuplane.functions import meta as M
from docuplane.session import bounded_broadcast

ATTACHMENTS, THREAD = 200, 100


def parents(docs: DataFrame) -> DataFrame:
    """doc_id, parent_id: the document of the same index with the display path in extracted_from (smallest id of several)."""
    p = docs.groupBy("index_name", F.col("display_path").alias("extracted_from")).agg(F.min("doc_id").alias("parent_id"))
    return docs.where("extracted_from <> ''").join(p, ["index_name", "extracted_from"], "left").select("doc_id", "parent_id")


def attachments(docs: DataFrame, index: str, path: str, most: int = ATTACHMENTS) -> DataFrame:
    """Rows extracted from a path, by doc_id."""
    return docs.where((F.col("index_name") == index) & (F.col("extracted_from") == path)).orderBy("doc_id").limit(most)


def message_ids(mails: DataFrame) -> DataFrame:
    """doc_id, index_name, m: every message id a mail carries (its own, the answered one, the references)."""
    ids = F.concat(F.array(M.message_id(F.col("message_id")), M.message_id(F.col("in_reply_to"))), F.coalesce(F.transform("refs", M.message_id), F.array().cast("array<string>")))
    return mails.select("doc_id", "index_name", F.explode(F.array_distinct(ids)).alias("m")).where("m is not null and m <> ''")


def thread_members(mails: DataFrame) -> DataFrame:
    """index_name, m, doc_id, carriers: each message id with every mail that carries it and how many do.

    Mails with an id in common are one thread's. They are given as membership, not as pairs, so a thread of very many mails costs
    no more than its mails.
    """
    ids = message_ids(mails).distinct()
    n = ids.groupBy("index_name", "m").agg(F.count("*").alias("carriers"))
    return ids.join(n, ["index_name", "m"]).select("index_name", "m", "doc_id", "carriers")


def thread_of(mails: DataFrame, doc_id: str, most: int = THREAD) -> DataFrame:
    """The other mails of a mail's thread, oldest first."""
    own = message_ids(mails.where(F.col("doc_id") == doc_id)).select("index_name", "m").distinct()
    found = message_ids(mails).join(bounded_broadcast(own, 100_000), ["index_name", "m"], "left_semi").select("doc_id").distinct()
    return mails.where(F.col("doc_id") != doc_id).join(found, "doc_id", "left_semi").orderBy("sent_at", "doc_id").limit(most)
