"""Texts cut into chunks for embedding: paragraphs, then sentences, then bytes. Lengths are UTF-8 bytes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F, types as T


def _size(s: str) -> int:
    return len(s.encode())


def _tail(parts: list[str], room: int, glue: int) -> list[str]:
    """The last parts that together fit into room."""
    out, used = [], 0
    for p in reversed(parts):
        need = _size(p) + (glue if out else 0)
        if used + need > room:
            break
        out.insert(0, p)
        used += need
    return out


def split_sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]


def _hard(text: str, most: int, overlap: int) -> list[str]:
    """Windows of at most `most` bytes, each beginning most less overlap (or most, where the overlap is no less) bytes after the one before;
    all bounds are moved back to the beginning of a character, and every window moves on by a character at least."""
    raw = text.encode()
    step, out, start = most - overlap if most > overlap else most, [], 0

    def bound(i: int, way: int) -> int:
        while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
            i += way
        return min(i, len(raw))

    while start < len(raw):
        least = bound(start + 1, 1)
        out.append(raw[start : max(bound(start + most, -1), least)].decode())
        start = max(bound(start + step, -1), least)
    return out


def _pack(parts: list[str], most: int, overlap: int, glue: str, split, carry: bool) -> list[str]:
    """Parts filled into chunks; a new chunk begins with the last parts of the one before, as far as the overlap lets. What is too long itself is
    split; with `carry`, the overlap of the chunk before it waits for the part behind it."""
    out, now = [], []
    size = lambda xs: sum(map(_size, xs)) + len(glue) * max(0, len(xs) - 1)

    def flush(keep: bool) -> list[str]:
        out.append(glue.join(now))
        return _tail(now, overlap, len(glue)) if keep and overlap else []

    for p in parts:
        if _size(p) > most:
            now = flush(carry) if now else now
            out += split(p)
        else:
            if now and size([*now, p]) > most:
                now = flush(True)
            now.append(p)
    if now:
        flush(False)
    return out


def chunk_text(text: str, most: int, overlap: int) -> list[str]:
    """Chunks of at most `most` bytes, but for an overlap carried before a part: trimmed paragraphs joined by an empty line, sentences of
    longer paragraphs joined by a blank, windows of longer sentences. A text without words is one chunk as it is."""
    parts = [p.strip() for p in re.split(r"\n\n+", text) if p.strip()]
    if not parts:
        return [text]
    return _pack(parts, most, overlap, "\n\n", lambda p: _pack(split_sentences(p), most, overlap, " ", lambda s: _hard(s, most, overlap), False), True)


_STRINGS = T.ArrayType(T.StringType())


def chunks(text, most: int, overlap: int):
    """Column of the chunks of a text column; null for null. Sequential, so Arrow-batched Python."""

    @F.pandas_udf(_STRINGS)
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else chunk_text(x, most, overlap) for x in t])

    return run(text)


def payload_batches(rows, group: str, key: str, size: str, most: int, per_row: int = 0, per_batch: int = 0):
    """group, key, batch (from 0): the rows of each group in key order filled greedily into batches whose bytes, with per_row for each row and
    per_batch beside them (commas and brackets, say), stay within `most`; a row that is larger alone. rows: group, key, size (BIGINT); of a repeated key every row counts.

    Where a batch begins depends on all rows before it, so a group is walked in order, as a stream of Arrow batches of one sorted
    partition in which nothing is gathered; a group is one batch sequence by its nature, different groups run side by side.
    """
    names = f"{group} {rows.schema[group].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, batch bigint"

    def fill(batches):
        now, n, used, first = None, 0, 0, True
        for b in batches:
            out = []
            for g, s in zip(b[group], b[size]):
                need = int(s) + per_row
                if g != now:
                    now, n, used, first = g, 0, per_batch, True
                elif not first and used + need > most:
                    n, used = n + 1, per_batch
                used, first = used + need, False
                out.append(n)
            yield pd.DataFrame({group: b[group], key: b[key], "batch": out})

    return rows.select(group, key, size).where(F.col(group).isNotNull()).repartition(group).sortWithinPartitions(group, key, size).mapInPandas(fill, names)
