"""The whole corpus encoded with a public byte-level BPE vocabulary.

The most frequent words of the corpus, with their ids, are compiled into a minimal acyclic automaton (equal suffixes shared), whose
states carry how many words they lead to, so that walking a word also gives its number. The arrays lie in one file that every
executor fetches and maps into memory; words that are not in it are merged exactly from the ranks.
"""

from __future__ import annotations

import base64
import heapq
import io
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from docuplane.session import Scratch, remove_at_exit, shared_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEXICON_WORDS = 65_536

# Fixed value: how the vocabulary's makers split a text into words; white space is Unicode's.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_WORDS = regex.compile(_SPLIT)
_JAVA_SPLIT = _SPLIT.replace("White_Space", "IsWhite_Space")


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes -> id of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the pair of lowest rank is merged first, the leftmost of equals. O(n log n), so long words are no problem."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or not alive[i] or end[j] != e:
            continue
        end[i], alive[j] = e, False
        if e < n:
            prev[e] = i
            if (r := ranks.get(word[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (p := prev[i]) >= 0 and (r := ranks.get(word[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Lexicon:
    """A minimal acyclic automaton over words (bytes) that numbers them in order, and the ids of each number."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @staticmethod
    def build(words: list[bytes], ids: list[list[int]]) -> Lexicon:
        """From distinct words and their ids. Words are added in order; a finished branch is replaced by an equal one at once."""
        order = sorted(range(len(words)), key=words.__getitem__)
        nodes: list[list] = [[False, []]]  # final, [(byte, child)]
        register: dict[tuple, int] = {}
        path, last = [0], b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                child = path.pop()
                key = (nodes[child][0], tuple(nodes[child][1]))
                same = register.setdefault(key, child)
                if same != child:
                    byte, _ = nodes[path[-1]][1][-1]
                    nodes[path[-1]][1][-1] = (byte, same)

        for k in order:
            w = words[k]
            common = 0
            while common < min(len(w), len(last)) and w[common] == last[common]:
                common += 1
            close(common)
            for b in w[common:]:
                nodes.append([False, []])
                nodes[path[-1]][1].append((b, len(nodes) - 1))
                path.append(len(nodes) - 1)
            nodes[path[-1]][0] = True
            last = w
        close(0)
        number, seen, todo = {0: 0}, [0], [0]
        while todo:
            for _, c in nodes[todo.pop()][1]:
                if c not in number:
                    number[c] = len(seen)
                    seen.append(c)
                    todo.append(c)
        counts: dict[int, int] = {}
        stack = [0]
        while stack:
            s = stack[-1]
            open_ = [c for _, c in nodes[s][1] if c not in counts]
            if open_:
                stack.extend(open_)
                continue
            stack.pop()
            counts[s] = nodes[s][0] + sum(counts[c] for _, c in nodes[s][1])
        keys, to, skip = [], [], []
        for s in seen:
            before = int(nodes[s][0])
            for b, c in sorted(nodes[s][1]):
                keys.append(number[s] << 8 | b)
                to.append(number[c])
                skip.append(before)
                before += counts[c]
        o = np.argsort(np.array(keys, np.int64), kind="stable")
        lens = [len(ids[k]) for k in order]
        return Lexicon({
            "keys": np.array(keys, np.int64)[o], "to": np.array(to, np.int32)[o], "skip": np.array(skip, np.int32)[o],
            "final": np.array([nodes[s][0] for s in seen], bool),
            "starts": np.concatenate([[0], np.cumsum(lens)]).astype(np.int64), "ids": np.array([x for k in order for x in ids[k]], np.int32),
        })

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for one that isn't here; all words walk on byte by byte together."""
        n = len(words)
        state, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not n or not len(self.keys):
            return np.full(n, -1, np.int64)
        lens = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
        alive = np.arange(n)
        for i in range(int(lens.max(initial=0))):
            alive = alive[lens[alive] > i]
            if not len(alive):
                break
            key = state[alive] << 8 | flat[begin[alive] + i]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[at] == key
            state[alive[~good]] = -1
            alive, at = alive[good], at[good]
            state[alive] = self.to[at]
            number[alive] += self.skip[at]
        ok = (state >= 0) & self.final[np.maximum(state, 0)]
        return np.where(ok, number, -1)

    def dump(self) -> bytes:
        """All arrays in one file image, each at an offset of 64 bytes, after a head that names them."""
        head, body = [], io.BytesIO()
        for k, a in self.__dict__.items():
            body.write(b"\0" * (-body.tell() % 64))
            head.append(f"{k} {a.dtype.str} {len(a)} {body.tell()}")
            body.write(a.tobytes())
        top = "\n".join(head).encode()
        return top.ljust(1024) + body.getvalue()

    @staticmethod
    def map(path: str) -> Lexicon:
        """The arrays of a dumped file, mapped into memory."""
        with open(path, "rb") as f:
            head = f.read(1024).decode().split("\n")
        out = {}
        for line in head:
            k, kind, n, at = line.split()
            out[k] = np.memmap(path, np.dtype(kind), "r", 1024 + int(at), (int(n),)) if int(n) else np.zeros(0, np.dtype(kind))
        return Lexicon(out)


class Encoder:
    """Ids of texts by a lexicon, exact merges for the rest, and a memory of at most `memory` words between batches."""

    def __init__(self, lexicon: Lexicon, ranks: dict[bytes, int], memory: int = 200_000):
        self.lexicon, self.ranks, self.memory, self.known = lexicon, ranks, memory, {}

    def learn(self, words) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.memory:
            self.known, new = {}, list(words)
        raw = [w.encode() for w in new]
        lex = self.lexicon
        for w, b, k in zip(new, raw, lex.numbers(raw).tolist()):
            self.known[w] = lex.ids[lex.starts[k] : lex.starts[k + 1]].tolist() if k >= 0 else merge(b, self.ranks)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [_WORDS.findall(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(split)))
        known = self.known
        return [list(chain.from_iterable([known[w] for w in ws])) for ws in split]


def frequent_words(docs: DataFrame, text: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """At most `most` words, the most frequent over all texts; counted in the JVM and summed before the shuffle.

    Where to cut is read from a histogram of the counts (steps of an eighth of an octave, whole steps are taken), so that never
    more than `most` words come to the driver.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(_JAVA_SPLIT), F.lit(0))).alias("w"))
    step = F.floor(8 * F.log2("count")).cast("int").alias("step")
    counts = Scratch(docs.sparkSession, "words").cut(words.groupBy("w").count().where("octet_length(w) between 1 and 64").select("w", "count", step))
    total, cut = 0, None
    for r in sorted(counts.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > most:
            break
        cut = r["step"]
    if cut is None:
        return []
    return sorted(r.w for r in counts.where(F.col("step") >= cut).select("w").collect())


def share_lexicon(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, most: int = LEXICON_WORDS) -> str:
    """Build the lexicon, put its file into the shared folder and name it to the executors; returns the file's name."""
    spark, ranks = docs.sparkSession, load_ranks(vocabulary)
    words = [w.encode() for w in frequent_words(docs, text, most)]
    image = Lexicon.build(words, [merge(w, ranks) for w in words]).dump()
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    at = f"{shared_dir(spark)}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(image)
    out.close()
    remove_at_exit(spark, at)
    spark.sparkContext.addFile(at)
    return name


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, most: int = LEXICON_WORDS) -> DataFrame:
    """key, ids (ARRAY<INT>): each text by the vocabulary without special tokens; an empty list for empty and null texts.

    One row per row of docs, in no shuffle. `most` bounds the lexicon only; the ids don't depend on it. The vocabulary is read
    on each executor from its path.
    """
    name = share_lexicon(docs, text, vocabulary, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.get((name, vocabulary))
        if enc is None:
            _ENCODERS.clear()
            enc = _ENCODERS[name, vocabulary] = Encoder(Lexicon.map(SparkFiles.get(name)), load_ranks(vocabulary))
        for batch in batches:
            ids = enc.encode(batch.column(1).to_pylist())
            ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            values = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]) if len(ids) else 0))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")
