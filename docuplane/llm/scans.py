"""Text of scanned pages repaired: page furniture, words broken across lines and misread characters.

Furniture is what the edges of the pages of one document repeat, page numbers and stray marks. Words are repaired by the corpus
itself: a lexicon of its frequent words per language, an index of them under all forms with one or two neighbouring letters
deleted (symmetric deletion), a weighted edit distance that knows which characters are misread for which, and, where several
words fit, how often the word before is followed by each.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docuplane.session import Scratch, spread

# What is read -> what stands there, and how little such a misreading costs (a plain edit costs 1).
CONFUSIONS = {
    ("c", "e"): 0.2, ("e", "c"): 0.4, ("o", "a"): 0.2, ("a", "o"): 0.4, ("ri", "n"): 0.2, ("n", "ri"): 0.4, ("0", "o"): 0.1, ("f", "t"): 0.2, ("t", "f"): 0.4, ("+", "t"): 0.1, ("!", "i"): 0.1,
    ("l", "i"): 0.2, ("i", "l"): 0.2, ("cl", "d"): 0.2, ("d", "cl"): 0.4, ("5", "s"): 0.1, ("ii", "u"): 0.2, ("u", "ii"): 0.4, ("1", "l"): 0.1, ("1", "i"): 0.2, ("(", "c"): 0.1, ("b", "h"): 0.2, ("h", "b"): 0.4,
    ("9", "g"): 0.1, ("rn", "m"): 0.2, ("m", "rn"): 0.2, ("m", "in"): 0.2, ("in", "m"): 0.4, ("y", "v"): 0.2, ("v", "y"): 0.4, ("6", "b"): 0.1, ("6", "é"): 0.1, ("6", "o"): 0.3, ("h", "li"): 0.2, ("li", "h"): 0.4,
    ("vv", "w"): 0.1, ("w", "vv"): 0.4, ("ii", "ü"): 0.2, ("u", "ü"): 0.3, ("o", "ö"): 0.3, ("a", "ä"): 0.3, ("8", "b"): 0.2, ("$", "s"): 0.1, ("@", "a"): 0.1, ("|", "l"): 0.1, ("|", "i"): 0.2, ("b", "ß"): 0.2, ("ﬁ", "fi"): 0.1, ("ﬂ", "fl"): 0.1, ("nn", "rm"): 0.4, ("tii", "tü"): 0.2,
}
#: What a lost accent costs beside another misreading of the letter.
ACCENT = 0.3
#: A single misreading is accepted up to this cost, two in one word up to twice as much.
MOST_COST = 0.45
#: Letters from which on a word one plain edit away is thought of.
LONG = 7
#: How many times as frequent as what was read the right word must be.
RATIO = 10
#: The least share of a word in all words of its language for the lexicon (so it has at most a million words), and the least count.
LEAST_SHARE, LEAST_COUNT = 1e-6, 5

def _misreadings() -> dict[tuple[str, str], list[tuple[str, str, float]]]:
    """CONFUSIONS and what two of them make of one letter (6 for o for ö), also where the second is a lost accent (6 for o for ó), by
    their last letters."""
    every = dict(CONFUSIONS)
    for (a, b), c in CONFUSIONS.items():
        for (d, e), f in CONFUSIONS.items():
            if b == d and a != e and len(b) == 1:
                every[a, e] = min(every.get((a, e), 9.0), c + f)
        for accent in "\u0300\u0301\u0302\u0308" if not a.isalpha() and b in "aeiou" else "":
            every.setdefault((a, unicodedata.normalize("NFC", b + accent)), c + ACCENT)
    out: dict[tuple[str, str], list] = defaultdict(list)
    for (a, b), c in every.items():
        out[a[-1], b[-1]].append((a, b, c))
    return dict(out)


_MISREAD = _misreadings()

# Frequent small words by which the language of a page is told.
MARKERS = {
    "en": "the of and was were with that has been by is under after before according our each no file holds",
    "de": "die der das und wurde wurden mit eine nach zur liegt unter hat laut ist aber keine wird ohne",
    "fr": "le la les et est une ont été du sous selon sans aucun n’est reste sous cote malgré exemplaires",
    "es": "el los y fue una fueron del según sin ningún sigue pese con referencia copias es ha",
}
# Language codes of the settings.
OCR_LANGUAGES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es"}

_HYPHENS = "-­‐‑¬"
_BROKEN = re.compile(rf"([^\W\d_]|[0-9!(+|$@])[{_HYPHENS}]\s*$")
_PAGE_WORD = r"(?:p[ao0][g9][ec(]\.?|se[il1!][tf+][ec(]|p[áa6][g9][il1!]n[ao]|p\.|s\.|fol\.?|blatt|folio)"
_NUM = r"[0-9OolI]+"
_PAGE_NUMBER = re.compile(rf"^[\W_]*(?:{_PAGE_WORD}\s*)?{_NUM}(?:\s*(?:/|of|[o0a]f|o[f+t]|von|de|d[ec(]|sur|s[u]r)\s*{_NUM})?[^\w.?!]*$|^[\W_]*[ivxlcIVXLC]{{1,7}}[^\w.?!]*$", re.I)
_TAIL_NUMBER = re.compile(rf"^(?:.*\s{{2,}}(?:{_PAGE_WORD}\s*)?({_NUM})|({_NUM})\s{{3,}}.*)$", re.I)
_EDGE = ".,;:?!\"'()[]{}…«»“”„‚‘’<>*"
_TOKEN = re.compile(r"\S+")


def _digits(s: str) -> str:
    return s.translate(str.maketrans("OoIlı", "00111"))


def skeleton(line: str) -> str:
    """A line as repeated lines are compared: lower case, characters that are misread for each other alike, numbers as #."""
    out = []
    for w in re.findall(r"\S+", line.strip()):
        if re.fullmatch(rf"\W*{_NUM}\W*", w) and re.search(r"[0-9]", w) or w in ("l", "O", "I", "ll", "lO"):
            out.append("#")
            continue
        w = w.lower()
        for a, b in (("ri", "n"), ("rn", "m"), ("in", "m"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("li", "h")):
            w = w.replace(a, b)
        w = w.translate(str.maketrans("0öäüéáíóú5$196(c+f!l1|by@8", "oaauoaiou" + "ss" + "igb" + "ee" + "tt" + "iiii" + "hv" + "ab"))
        out.append(w.replace("a", "o"))
    return " ".join(out)


def edges(content: str | None, reach: int = 3) -> list[tuple[int, str]]:
    """Line numbers (from 0) and skeletons of the lines near the top and bottom that could be running headers or footers."""
    lines = (content or "").split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    near = sorted({*full[:reach], *full[-reach:]})
    return [(i, skeleton(lines[i])) for i in near if not re.search(r"[.?!,;]\s*$", lines[i]) and not _BROKEN.search(lines[i]) and re.match(r"\s*[^\Wa-z_]|\s*[!(+]|.*\s{3,}", lines[i]) and not _PAGE_NUMBER.match(lines[i].strip())]


def furniture(content: str | None, page_no: int | None, repeated: set[str], pages: int) -> set[int]:
    """Line numbers (from 0) of running headers and footers, page numbers and stray marks."""
    lines = (content or "").split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    out = {i for i in full if not re.search(r"\w", lines[i].replace("_", " "))}
    real = [i for i in full if i not in out]
    near = {*real[:3], *real[-3:]}
    known = dict(edges(content, 5))
    for i in sorted(near):
        s = lines[i].strip()
        number = _TAIL_NUMBER.match(s)
        tail = _digits(next(x for x in number.groups() if x)) if number else ""
        if known.get(i) in repeated or (i in (*real[:2], *real[-2:]) and _PAGE_NUMBER.match(s)) or (tail.isdigit() and page_no is not None and int(tail) == page_no):
            out.add(i)
    rest = [i for i in real if i not in out]
    if pages == 1 and len(rest) > 3:
        width = max(len(lines[i].strip()) for i in rest)
        for i, beside in ((rest[0], rest[1]), (rest[-1], None)):
            s = lines[i].strip()
            if i in known and len(s) < 0.8 * width and len(s.split()) <= 8 and not re.search(r"[a-zäöüß-]$", lines[rest[-2]].strip() if beside is None else "x.") and (beside is None or not lines[beside].strip()[:1].islower()):
                out.add(i)
    return out


def language(content: str | None, setting: str | None = None) -> str:
    """The language of a page by its small words; where they don't tell, the first of the setting, else English."""
    n = Counter()
    for w in re.findall(r"[^\W\d_]+(?:’[^\W\d_]+)?", (content or "").lower()):
        for k, ws in _MARKERS.items():
            n[k] += w in ws
    best = n.most_common(2)
    if best and best[0][1] > 0 and (len(best) < 2 or best[0][1] > best[1][1]):
        return best[0][0]
    for code in re.split(r"\W+", (setting or "").lower()):
        if code in OCR_LANGUAGES:
            return OCR_LANGUAGES[code]
    return "en"


_MARKERS = {k: set(v.split()) for k, v in MARKERS.items()}


def _cores(token: str) -> list[str]:
    """The word in a token without punctuation around it, then the same with marks at its edge that may be misread letters."""
    core = token.strip(_EDGE)
    out = [core.lower()] if core else []
    at = token.find(core) if core else 0
    for lead, tail in ((token[at - 1 : at] if at else "", ""), ("", token[at + len(core) : at + len(core) + 1])):
        if (lead and lead in "(!") or (tail and tail in "(!"):
            out.append((lead + core + tail).lower())
    return out


def text_tokens(lines: list[str], skip: set[int], head: str = "", goes_on: bool = False) -> Iterator[tuple[int, str, str]]:
    """Line, token and role of each token of the running text: 'word'; 'left', the part of a broken word at the end of a line; and
    'right', its rest, which is given before the words of its own line. head is the first token of the next page's text; goes_on: whether the page
    before ended within a word."""
    text = [i for i, x in enumerate(lines) if x.strip() and i not in skip]
    broken = goes_on
    for i in text:
        tokens = _TOKEN.findall(lines[i].replace("­ ", "­"))
        ends = bool(_BROKEN.search(lines[i]))
        for k, t in enumerate(tokens):
            if k == 0 and broken:
                yield i, t, "right"
            elif ends and k == len(tokens) - 1:
                yield i, t, "left"
            else:
                yield i, t, "word"
        broken = ends
    if broken and head:
        yield -1, head, "right"


class Repair:
    """Right words for read words of one language."""

    def __init__(self, counts: dict[str, int], bigrams: dict[tuple[str, str], int] | None = None):
        self.counts, self.bigrams = counts, bigrams or {}
        self.index: dict[str, list[str]] = defaultdict(list)
        for w in counts:
            if len(w) > 1:
                for k in self._deletes(w):
                    self.index[k].append(w)
        self.known: dict[str, list[tuple[float, str]]] = {}

    @staticmethod
    def _deletes(w: str) -> set[str]:
        return {w, *(w[:i] + w[i + k :] for k in (1, 2) for i in range(len(w) - k + 1))}

    @staticmethod
    def cost(read: str, right: str, most: float = 9.0) -> float:
        """The weighted edit distance between what was read and a right word: the least sum of misreadings, at their costs, and of plain
        edits, 1 for each letter added, dropped, changed or swapped with its neighbour; 9 if it's more than `most`."""
        n, m = len(read), len(right)
        rows = [[float(j) for j in range(m + 1)]]
        for i in range(1, n + 1):
            above, row = rows[-1], [float(i)]
            for j in range(1, m + 1):
                x, y = read[i - 1], right[j - 1]
                best = above[j - 1] if x == y else min(above[j - 1], above[j], row[j - 1]) + 1
                if x != y and i > 1 and j > 1 and x == right[j - 2] and y == read[i - 2]:
                    best = min(best, rows[i - 2][j - 2] + 1)
                for a, b, c in _MISREAD.get((x, y), ()):
                    if len(a) <= i and len(b) <= j and read.endswith(a, 0, i) and right.endswith(b, 0, j):
                        best = min(best, rows[i - len(a)][j - len(b)] + c)
                row.append(best)
            if i > 1 and min(row) > most and min(above) > most:
                return 9.0
            rows.append(row)
        return rows[n][m] if rows[n][m] <= most else 9.0

    def candidates(self, read: str) -> list[tuple[float, str]]:
        """Lexicon words that are frequent enough to be what was read, with their costs, the cheapest first: up to MOST_COST; for longer
        words that nobody writes up to twice as much, or, if there is none, one plain edit away."""
        if read in self.known:
            return self.known[read]
        n = self.counts.get(read, 0)
        near = {w for k in self._deletes(read) for w in self.index.get(k, ()) if self.counts[w] >= RATIO * max(n, 1)} - {read}
        costs = [(c, w) for w in near if (c := self.cost(read, w, 1.0)) <= 1.0]
        found = [x for x in costs if x[0] <= MOST_COST]
        if not found and not n and len(read) > 5:
            twice = [x for x in costs if x[0] <= 2 * MOST_COST]
            for (a, b), c in CONFUSIONS.items():
                i = read.find(a)
                while i >= 0 and c <= MOST_COST:
                    once = read[:i] + b + read[i + len(a) :]
                    for w in {w for k in self._deletes(once) for w in self.index.get(k, ()) if self.counts[w] >= RATIO}:
                        if (c2 := self.cost(read, w, 2 * MOST_COST)) <= 2 * MOST_COST:
                            twice.append((c2, w))
                    i = read.find(a, i + 1)
            found = twice or (costs if len(read) >= LONG else [])
        found = sorted(set(found), key=lambda x: (x[0], -self.counts[x[1]], x[1]))
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[read] = found
        return found

    def word(self, read: str, before: str = "") -> str | None:
        """The right word for what was read (lower case), None if nothing needs repair or nothing fits."""
        found = self.candidates(read)
        if found:
            level = [x for x in found if x[0] <= MOST_COST] or found
            if level[0][0] > 2 * MOST_COST and not any((before, w) in self.bigrams for _, w in level):
                return None  # a plain edit away: only what is known to follow the word before
            return max(level, key=lambda x: (self.bigrams.get((before, x[1]), 0), -x[0], self.counts[x[1]]))[1]
        if not self.counts.get(read) and re.fullmatch(r"[^\W\d_]*[0-9(!+$@|][^\W\d_]+|[^\W\d_]+[0-9(!+$@|][^\W\d_]*", read) and len(read) > 3:
            return "".join(_SYMBOLS.get(c, c) for c in read)
        return None

    def token(self, token: str, before: str = "") -> str | None:
        """The right word for a token as it stands in the text, its parts repaired one by one if hyphens join them."""
        cores = _cores(token)
        if not cores or re.fullmatch(r"[\W\d]*|[a-z]{2}-\d+", cores[0]):
            return None
        if "-" in cores[0]:
            parts = cores[0].split("-")
            fixed = [p and (self.counts.get(p, 0) and not self.candidates(p) and p or self.word(p) or p) for p in parts]
            return "-".join(fixed) if fixed != parts else None
        for core in cores:
            if self.counts.get(core) and not self.candidates(core):
                return None
        for core in cores[::-1]:
            if (w := self.word(core, before)) and (core == cores[0] or self.counts.get(w)):
                return w
        return None

    def whole(self, left: str, right: str) -> str | None:
        """The word of two parts that a line end separates."""
        left = left.rstrip().rstrip(_HYPHENS).lstrip(_EDGE).lower()
        right = right.rstrip(_EDGE).lower() or right.lower()
        if not left or not right or not re.match(r"[\w(!+]", right):
            return None
        head, _, a = left.rpartition("-")
        head = head and head + "-"
        b, dash, tail = right.partition("-")
        if re.fullmatch(r"[a-z]{2}", a) and b.isdigit():
            return f"{head}{a}-{right}"
        one = a + b
        get = self.counts.get
        if not get(one):
            if get(a) and get(b):
                return f"{head}{a}-{right}"
            if fixed := self.word(one):
                if get(fixed):
                    one = fixed
                elif (fa := get(a) and a or self.word(a)) and (fb := get(b) and b or self.word(b)) and get(fa) and get(fb):
                    return f"{head}{fa}-{fb}{dash}{tail}"
                else:
                    one = fixed
            elif (fa := get(a) and a or self.word(a)) and (fb := get(b) and b or self.word(b)) and get(fa) and get(fb) and len(fa) > 3 and len(fb) > 3:
                return f"{head}{fa}-{fb}{dash}{tail}"
        elif (fixed := self.candidates(one)) and get(fixed[0][1]):
            one = fixed[0][1]
        return f"{head}{one}{dash}{tail}"


_SYMBOLS = {"0": "o", "1": "l", "5": "s", "6": "b", "9": "g", "8": "b", "(": "c", "!": "i", "+": "t", "$": "s", "@": "a", "|": "l"}


def structure(pages: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """page_key, content, lang, skip (line numbers of furniture from 0), head (the first text token of the document's next page),
    goes_on (whether the page before ends within a word).

    Repetition is counted per document and line skeleton, so that no document is gathered in one place. jobs (job_id,
    ocr_language; repeated rows don't matter) only helps where a page doesn't tell its language.
    """
    rows = pages.select("page_key", "doc_id", "job_id", "page_no", "content").where("content is not null")
    facts = rows.select("page_key", "doc_id", "job_id", "page_no").distinct()
    if jobs is not None:
        facts = facts.join(jobs.where("job_id is not null").groupBy("job_id").agg(F.max("ocr_language").alias("setting")), "job_id", "left")
    else:
        facts = facts.withColumn("setting", F.lit(None).cast("string"))

    def at_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, d, n, s) for k, d, n, t in zip(b["page_key"], b["doc_id"], b["page_no"], b["content"]) for s in {s for _, s in edges(t)}]
            yield pd.DataFrame(out, columns=["page_key", "doc_id", "page_no", "s"])

    near = rows.where("doc_id is not null and page_no is not null").select("page_key", "doc_id", "page_no", "content").mapInPandas(at_edges, "page_key bigint, doc_id string, page_no bigint, s string")
    again = near.groupBy("doc_id", "s").agg(F.count_distinct("page_no").alias("n")).where("n > 1").select("doc_id", "s")
    own = near.join(again, ["doc_id", "s"]).groupBy("page_key").agg(F.collect_set("s").alias("again"))
    count = facts.groupBy("doc_id").agg(F.count_distinct("page_no").alias("pages"))
    facts = facts.join(count, "doc_id", "left").join(own, "page_key", "left").dropDuplicates(["page_key"]).drop("job_id")
    # the contents are shuffled once, by the key that all that was found out about a page is joined on
    whole = spread(rows.select("page_key", "content"), "page_key").join(facts, "page_key")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, d, n, t, g, a, p in zip(b["page_key"], b["doc_id"], b["page_no"], b["content"], b["setting"], b["again"], b["pages"]):
                skip = furniture(t, None if pd.isna(n) else int(n), set(a) if a is not None else set(), 0 if pd.isna(p) else int(p))
                text = [x for i, x in enumerate(t.split("\n")) if x.strip() and i not in skip]
                out.append((k, d, n, t, language(t, g), sorted(skip), text[0].split()[0] if text else "", bool(text) and bool(_BROKEN.search(text[-1]))))
            yield pd.DataFrame(out, columns=["page_key", "doc_id", "page_no", "content", "lang", "skip", "first", "ends"])

    marked = Scratch(pages.sparkSession, "scans").cut(whole.mapInPandas(mark, "page_key bigint, doc_id string, page_no bigint, content string, lang string, skip array<int>, first string, ends boolean"))
    one = marked.where("doc_id is not null and page_no is not null").select("doc_id", "page_no", "page_key", "first", "ends")
    sides = one.select("doc_id", (F.col("page_no") - 1).alias("page_no"), "page_key", F.col("first").alias("head"), F.lit(None).cast("boolean").alias("goes_on")).unionByName(
        one.select("doc_id", (F.col("page_no") + 1).alias("page_no"), "page_key", F.lit(None).cast("string").alias("head"), F.col("ends").alias("goes_on"))
    )
    beside = sides.groupBy("doc_id", "page_no").agg(F.min(F.when(F.col("head").isNotNull(), F.struct("page_key", "head")))["head"].alias("head"), F.bool_or("goes_on").alias("goes_on"))
    known = marked.select("page_key", "doc_id", "page_no").join(beside, ["doc_id", "page_no"]).groupBy("page_key").agg(F.min("head").alias("head"), F.bool_or("goes_on").alias("goes_on"))
    out = spread(marked.select("page_key", "content", "lang", "skip"), "page_key").join(known, "page_key", "left")
    return out.select("page_key", "content", "lang", "skip", F.coalesce("head", F.lit("")).alias("head"), F.coalesce("goes_on", F.lit(False)).alias("goes_on"))


def _plain(token: str) -> list[str]:
    core = token.strip(_EDGE).lower()
    return [p for p in core.split("-") if re.fullmatch(r"[^\s\d]+", p) and re.search(r"[^\W_]", p)]


def lexicon(structured: DataFrame) -> DataFrame:
    """lang, word, n: how often each word stands in the running text of its language, broken words left out; counted over all
    pages, frequent ones only (LEAST_SHARE, LEAST_COUNT)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            for t, g, s, o in zip(b["content"], b["lang"], b["skip"], b["goes_on"]):
                n.update((g, p) for _, x, role in text_tokens(t.split("\n"), set(s), "", o) if role == "word" for p in _plain(x))
            if len(n) > 500_000:
                yield pd.DataFrame([(g, w, k) for (g, w), k in n.items()], columns=["lang", "word", "n"])
                n.clear()
        yield pd.DataFrame([(g, w, k) for (g, w), k in n.items()], columns=["lang", "word", "n"])

    words = structured.select("content", "lang", "skip", "goes_on").mapInPandas(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = Scratch(structured.sparkSession, "lexicon").cut(words)
    all_words = words.groupBy("lang").agg(F.sum("n").alias("m"))
    return words.join(F.broadcast(all_words), "lang").where((F.col("n") >= LEAST_COUNT) & (F.col("n") >= LEAST_SHARE * F.col("m"))).select("lang", "word", "n")


def _ambiguous(counts: dict[str, int]) -> set[str]:
    """Words that share a misread form with another word."""
    forms: dict[str, set] = defaultdict(set)
    for w in counts:
        for a, b in CONFUSIONS:
            i = w.find(b)
            while i >= 0:
                forms[w[:i] + a + w[i + len(b) :]].add(w)
                i = w.find(b, i + 1)
    return {w for ws in forms.values() if len(ws) > 1 for w in ws}


_TOOLS: dict[str, dict[str, Repair]] = {}


def repairs(pages: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """page_key, line_no (from 1), repair_kind, fixed_word of all repairs of the pages.

    furniture: the line is no text (fixed_word ''). hyphen: the line ends within a word; fixed_word is the whole word. glyph: a
    word with misread characters; fixed_word is the right word. Words in lower case without punctuation; one row per line, kind
    and word. Null, empty and blank contents give no row; a page without doc_id or page_no is a document of its own.
    """
    spark = pages.sparkSession
    rows = Scratch(spark, "pages").cut(structure(pages, jobs))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in lexicon(rows).collect():  # at most 1 / LEAST_SHARE words a language
        counts[r["lang"]][r["word"]] = r["n"]
    doubtful = spark.sparkContext.broadcast({g: _ambiguous(c) for g, c in counts.items()})

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter = Counter()
            for t, g, s, o in zip(b["content"], b["lang"], b["skip"], b["goes_on"]):
                known, before = doubtful.value.get(g, set()), ""
                for _, x, role in text_tokens(t.split("\n"), set(s), "", o):
                    w = x.strip(_EDGE).lower() if role == "word" else ""
                    if w in known and before:
                        n[g, before, w] += 1
                    before = w
            yield pd.DataFrame([(*k, c) for k, c in n.items()], columns=["lang", "a", "b", "n"])

    follow = rows.select("content", "lang", "skip", "goes_on").mapInPandas(pairs, "lang string, a string, b string, n bigint").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))
    bigrams: dict[str, dict] = defaultdict(dict)
    least = {g: max(2, LEAST_SHARE * sum(c.values())) for g, c in counts.items()}
    least_col = F.create_map(*[F.lit(x) for kv in least.items() for x in kv]) if least else None
    for r in follow.where(F.col("n") >= least_col[F.col("lang")]).collect() if least else []:
        bigrams[r["lang"]][r["a"], r["b"]] = r["n"]
    shared = spark.sparkContext.broadcast({g: (c, bigrams.get(g, {})) for g, c in counts.items()})

    run = uuid.uuid4().hex

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if run not in _TOOLS:  # one index for all tasks of a worker
            _TOOLS.clear()
            _TOOLS[run] = {g: Repair(*x) for g, x in shared.value.items()}
        tools = _TOOLS[run]
        for b in batches:
            out = set()
            for k, t, g, s, h, o in zip(b["page_key"], b["content"], b["lang"], b["skip"], b["head"], b["goes_on"]):
                skip = set(s)
                out.update((k, i + 1, "furniture", "") for i in skip)
                tool = tools.get(g) or Repair({})
                left, at, before = "", -1, ""
                for i, x, role in text_tokens(t.split("\n"), skip, h, o):
                    if role == "left":
                        left, at = x, i
                        before = ""
                    elif role == "right":
                        if left and (w := tool.whole(left, x)):
                            out.add((k, at + 1, "hyphen", w))
                        left = ""
                    else:
                        if w := tool.token(x, before):
                            out.add((k, i + 1, "glyph", w))
                        before = w or x.strip(_EDGE).lower()
            yield pd.DataFrame(list(out), columns=["page_key", "line_no", "repair_kind", "fixed_word"])

    return spread(rows, "page_key").mapInPandas(fix, "page_key bigint, line_no bigint, repair_kind string, fixed_word string").distinct()
