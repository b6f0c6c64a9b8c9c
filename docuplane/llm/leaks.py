"""Evaluation texts inside training texts, by Wu-Manber search over words.

The symbols are words, the patterns all runs of ten words of the items. A table of block shifts (three words) skips what can't end
a pattern, mostly eight words at a time; a block that ends a pattern leads to the patterns with that suffix, which are compared
directly.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from docuplane.session import Scratch

RUN, BLOCK = 10, 3
_WORD, _DROP = re.compile("[a-z0-9]+"), regex.compile(r"[\p{M}\p{Cf}]+")


def words(text: str | None) -> list[str]:
    """Runs of a-z and 0-9 after NFKD, without combining marks and format characters, in lower case. Null counts as empty."""
    if not text:
        return []
    if not text.isascii():
        text = _DROP.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.lower())


class Patterns:
    """Shift and suffix tables of all runs of `run` words of the items."""

    def __init__(self, items, run: int = RUN, block: int = BLOCK):
        self.run, self.block, self.default = run, block, run - block + 1
        self.shift: dict[tuple, int] = {}
        self.suffix: dict[tuple, dict[tuple, set]] = {}
        for item, text in items:
            w = words(text)
            for i in range(len(w) - run + 1):
                p = tuple(w[i : i + run])
                for e in range(block, run + 1):
                    b = p[e - block : e]
                    if run - e < self.shift.get(b, self.default):
                        self.shift[b] = run - e
                self.suffix.setdefault(p[run - block :], {}).setdefault(p, set()).add(item)

    def search(self, text: str | None) -> set:
        """The items that have a run in the text."""
        w, found = words(text), set()
        shift, suffix, run, block, default = self.shift, self.suffix, self.run, self.block, self.default
        end, n = run, len(w)
        while end <= n:
            b = tuple(w[end - block : end])
            step = shift.get(b, default)
            if not step:
                hit = suffix[b].get(tuple(w[end - run : end]))
                if hit:
                    found |= hit
                step = 1
            end += step
        return found


#: Words of an item that are searched for together; longer items are cut into parts that overlap by a run.
PART_WORDS = 5_000


def item_parts(items: DataFrame, item_key: str, run: int) -> DataFrame:
    """i, part, n, t: the words of each item in parts of at most PART_WORDS and how many they are; items shorter than a run have none."""
    kind = items.schema[item_key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, sizes, texts = [], [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                w = words(t)
                for p, at in enumerate(range(0, max(len(w) - run + 1, 0), PART_WORDS - run + 1)):
                    part = w[at : at + PART_WORDS]
                    rows.append(r)
                    parts.append(p)
                    sizes.append(len(part))
                    texts.append(" ".join(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(parts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(texts, pa.string())], ["i", "part", "n", "t"])

    return items.select(F.col(item_key).alias("i"), F.col("text").alias("t")).where("t is not null").mapInArrow(cut, f"i {kind}, part int, n int, t string")


def leaked(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", run: int = RUN, items_at_once: int = 20_000, words_at_once: int = 1_000_000) -> DataFrame:
    """doc_key, item_key: documents in which at least `run` consecutive words of an item's text stand consecutively.

    docs and items have a column text; null and shorter texts never match. Parts of items go to the executors in blocks of about
    items_at_once parts and words_at_once words (a bound on what is broadcast and held by the driver, whatever the number and length of items; more of them mean more passes
    over the documents, none is left out). One row per pair, also where a document's key is repeated. An empty table on either
    side gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    texts = docs.select(F.col(doc_key).alias("k"), F.col("text").alias("t")).where("t is not null")
    key = items.schema[item_key].dataType.simpleString()
    schema = f"k {docs.schema[doc_key].dataType.simpleString()}, i {key}"
    arrow = pa.int64() if key == "bigint" else pa.int32() if key == "int" else pa.string()
    parts = scratch.cut(item_parts(items, item_key, run))
    size = parts.agg(F.count("*").alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    blocks = max(-(-size["words"] // words_at_once), -(-size["parts"] // items_at_once))
    result = None
    for b in range(blocks):
        part = parts.where(F.pmod(F.xxhash64("i", "part"), F.lit(blocks)) == b).select("i", "t").collect()
        shared = spark.sparkContext.broadcast(Patterns([(r.i, r.t) for r in part], run))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            patterns = shared.value
            for batch in batches:
                rows, hits = [], []
                for n, t in enumerate(batch.column(1).to_pylist()):
                    for item in patterns.search(t):
                        rows.append(n)
                        hits.append(item)
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(hits, arrow)], ["k", "i"])

        hit = texts.mapInArrow(scan, schema)
        if blocks > 1:  # done before the next block is made
            hit = scratch.cut(hit)
            shared.destroy()
        result = hit if result is None else result.unionByName(hit)
    if result is None:
        result = spark.createDataFrame([], schema)
    return result.distinct().select(F.col("k").alias(doc_key), F.col("i").alias(item_key))
