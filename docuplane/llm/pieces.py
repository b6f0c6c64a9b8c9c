"""Oversized contents cut into overlapping pieces at natural boundaries.

Both operators walk a content from landmark to landmark and snap each to a natural boundary. Content-defined landmarks are where a
rolling hash of the last characters has a fixed pattern, so an edit moves only the cuts beside it (content_defined_pieces).
Where every cut is prescribed by its distance from the one before (oversized_pieces), the landmark is the end of the allowed range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docuplane.session import bounded_broadcast

_ENDS = [a + b for a in ".!?" for b in " \n"]


#: Characters that a landmark's hash is taken of, and how far from it, as a part of the limit, a boundary may lie.
WINDOW, REACH = 48, 8
_K, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_INVERSE = pow(_K, -1, 1 << 64)
#: Characters hashed at once.
_BLOCK = 1 << 20


def last_boundary(text: str, low: int, high: int) -> int:
    """The last position in (low, high] that follows an empty line, else the end of a sentence and a blank, else a blank or line end; 0 if
    there is none."""
    at = text.rfind("\n\n", max(low - 1, 0), high) + 2
    if at < 2:
        at = max(text.rfind(x, max(low - 1, 0), high) for x in _ENDS) + 2
    if at < 2:
        at = max(text.rfind(" ", low, high), text.rfind("\n", low, high)) + 1
    return max(at, 0)


def first_boundary(text: str, low: int, high: int) -> int:
    """As last_boundary, but the first of the best kind."""
    at = text.find("\n\n", max(low - 1, 0), high) + 2
    if at < 2:
        found = [i for x in _ENDS if (i := text.find(x, max(low - 1, 0), high)) >= 0]
        at = min(found) + 2 if found else 0
    if at < 2:
        found = [i for x in " \n" if (i := text.find(x, low, high)) >= 0]
        at = min(found) + 1 if found else 0
    return at


def _back(text: str, at: int, overlap: int) -> int:
    """Where the piece after a cut starts: at the first word within the last `overlap` characters, else there."""
    back = at - overlap
    found = [i for i in (text.find(x, max(back - 1, 0), at - 1) for x in " \n") if i >= 0] if back < at else []
    return min(found) + 1 if found else back


def cut_points(text: str, limit: int) -> list[tuple[int, int]]:
    """Start and end (exclusive, code points) of each piece of a text longer than limit; one piece for others, none for ''.

    A piece ends at the last position in (start + limit div 2, start + limit] that follows an empty line, else the end of a
    sentence and a blank, else a blank or line end, else at start + limit. The next starts at the first word within the last
    limit div 10 characters, else there. Every piece advances, so the pieces cover the text.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    out, start, n = [], 0, len(text)
    while n - start > limit:
        at = last_boundary(text, start + limit // 2, start + limit) or start + limit
        out.append((start, at))
        start = _back(text, at, limit // 10)
    if n > start:
        out.append((start, n))
    return out


def landmarks(text: str, bits: int) -> np.ndarray:
    """Positions after which a rolling hash of the last WINDOW characters has `bits` zero bits; in order. They depend on those characters
    only."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    shift, found = np.uint64(64 - bits), []
    for begin in range(0, max(len(code) - WINDOW + 1, 0), _BLOCK):
        part = code[begin : begin + _BLOCK + WINDOW - 1].astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(part) - 1, _K, np.uint64)]), dtype=np.uint64)
            down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(part) - 1, _INVERSE, np.uint64)]), dtype=np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up, dtype=np.uint64)])
            h = (sums[WINDOW:] - sums[:-WINDOW]) * down[: len(part) - WINDOW + 1]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        found.append(np.flatnonzero(h >> shift == 0) + begin + WINDOW)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def content_defined_cuts(text: str, limit: int) -> list[tuple[int, int]]:
    """Start and end of content-defined pieces of at most `limit` characters; one piece for a text that fits, none for ''.

    A cut is sought in the range of a quarter of the room (limit less an overlap of a tenth) to all of it after the one before: at the
    first landmark there, snapped to the nearest natural boundary of the best kind within limit div REACH on either side and
    the range; where there is no landmark, at the last boundary of the range. Landmarks are a quarter of the room apart on average. A piece begins
    with the overlap before its first cut, which the next cut doesn't depend on; so behind an edit the cuts are soon the old ones.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    n, overlap = len(text), limit // 10
    if n <= limit:
        return [(0, n)] if n else []
    room = limit - overlap
    marks = landmarks(text, max(1, round(np.log2(max(room // 4, 2)))))
    out, start, cut = [], 0, 0
    while n - start > limit:
        low, high = cut + room // 4, cut + room
        k = int(np.searchsorted(marks, low, side="right"))
        at = 0
        if k < len(marks) and marks[k] <= high:
            mark = int(marks[k])
            near, far = max(low, mark - limit // REACH), min(high, mark + limit // REACH)
            left, right = last_boundary(text, near, mark), first_boundary(text, mark, far)
            both = [x for x in (left, right) if x]
            at = min(both, key=lambda x: (_kind(text, x), abs(x - mark), x)) if both else mark
        cut = at or last_boundary(text, low, high) or high
        out.append((start, cut))
        start = _back(text, cut, overlap)
    out.append((start, n))
    return out


def _kind(text: str, at: int) -> int:
    """The kind of boundary before a position: 0 an empty line, 1 the end of a sentence, 2 another blank or line end, 3 none."""
    return 0 if text[at - 2 : at] == "\n\n" else 1 if text[at - 2 : at] in _ENDS else 2 if text[at - 1 : at] in " \n" else 3


_PIECES = T.ArrayType(T.StructType([T.StructField("piece_start", T.LongType()), T.StructField("piece_end", T.LongType())]))


def _cuts(text: Column, limit: Column, points) -> Column:
    @F.pandas_udf(_PIECES)
    def run(t: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([[{"piece_start": a, "piece_end": b} for a, b in points(x, int(y))] for x, y in zip(t, k)])

    return run(text, limit)


def model_limits(embeddings: DataFrame, per_token: int = 4) -> DataFrame:
    """index_name, max_chars: per_token x context_length of the latest row of each index whose context_length isn't null.

    Of rows with one updated_at the larger context_length counts. An index without such a row has no limit and no row.
    """
    known = embeddings.where("context_length is not null and index_name is not null and context_length > 0")
    last = known.groupBy("index_name").agg(F.max(F.struct("updated_at", "context_length")).alias("x"))
    return last.select("index_name", (F.col("x.context_length") * per_token).cast("bigint").alias("max_chars"))


def _pieces(docs: DataFrame, embeddings: DataFrame, points) -> DataFrame:
    limits = bounded_broadcast(model_limits(embeddings), 100_000)
    long = (
        docs.select("doc_id", "row_id", "index_name", "content")
        .where("content is not null and doc_id is not null")
        .join(limits, "index_name")
        .where(F.length("content") > F.col("max_chars"))
    )
    once = long.groupBy("doc_id").agg(F.min_by(F.struct("content", "max_chars"), "row_id").alias("x"))
    pieces = once.select("doc_id", F.posexplode(_cuts(F.col("x.content"), F.col("x.max_chars"), points)).alias("i", "p"))
    return pieces.select("doc_id", (F.col("i") + 1).cast("bigint").alias("piece_no"), "p.piece_start", "p.piece_end")


def oversized_pieces(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """doc_id, piece_no (from 1), piece_start, piece_end of every content longer than its index's limit, by cut_points().

    Rows of one doc_id count once (that with the smallest row_id, should they differ). Null, empty and short contents, and indexes
    without limit give no row. The length is tested before anything is shuffled or handed to Python.
    """
    return _pieces(docs, embeddings, cut_points)


def content_defined_pieces(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The same rows by content_defined_cuts(): pieces that an edit elsewhere in the content leaves as they are."""
    return _pieces(docs, embeddings, content_defined_cuts)
