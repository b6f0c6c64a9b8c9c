"""Text columns: tokens, paths, blank lines, sentences, highlights, HTML. Nulls stay null unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

MARK, UNMARK = "<mark>", "</mark>"
#: Runs of letters split where letters and digits or lower and upper case meet; no look-around, so other engines read it too.
PATH_TOKEN = r"\p{Lu}+[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]*|[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+|\p{N}+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def path_tokens(path: Column) -> Column:
    """Parts of a path, split at separators, at letter-digit and at lower-upper transitions, in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(path, F.lit("")), F.lit(f"({PATH_TOKEN})"), F.lit(1)), F.lower)


def condense_blank_lines(text: Column) -> Column:
    """Runs of lines that hold nothing but blanks become one empty line."""
    return F.regexp_replace(text, r"(?U)(\A|\n)\s*(?=\n|\z)", "$1")


def sentences(text: Column) -> Column:
    """Sentences with their end marks; split after . ! ? and white space."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    """Trimmed paragraphs between empty lines."""
    return F.filter(F.transform(F.split(text, r"\n\n+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def highlight(text: Column, terms: list[str]) -> Column:
    """Whole-word matches of the terms, in any case, wrapped in marks."""
    if not terms:
        return text
    rx = "(?i)(^|[^\\p{L}\\p{N}])(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + ")(?=[^\\p{L}\\p{N}]|$)"
    return F.regexp_replace(text, rx, f"$1{MARK}$2{UNMARK}")


def fragment(text: Column, terms: list[str], size: int = 200) -> Column:
    """`size` characters from a quarter of them before the first matched term, from the start where none matches."""
    if not terms:
        return F.left(text, F.lit(size))
    at = F.least(*[F.when(F.locate(t, F.lower(text)) > 0, F.locate(t, F.lower(text))).otherwise(F.lit(1 << 30)) for t in terms], F.lit(1 << 30))
    start = F.when(at == 1 << 30, 1).otherwise(F.greatest(at - size // 4, F.lit(1)))
    return F.substring(text, start, F.lit(size))


def strip_highlights(text: Column) -> Column:
    """The marks, and nothing else, taken out."""
    return F.replace(F.replace(text, F.lit(MARK)), F.lit(UNMARK))


def truncate(text: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where something is cut."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(max(n - 1, 0))), F.lit("…"))).otherwise(text)


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_to_text(html: Column) -> Column:
    """Tags, scripts and styles out, the three escapes undone, white space single."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    t = F.replace(F.replace(F.replace(t, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def safe_entry_name(name: Column) -> Column:
    """The last segment of an archive entry's name; null where that is empty, dots, hidden or the name holds a NUL."""
    last = F.element_at(F.split(name, "/"), -1)
    return F.when((name == "") | name.contains("\0") | last.isin("", ".", "..") | last.startswith("."), None).otherwise(last)


def path_split(path: Column) -> tuple[Column, Column]:
    """Directory and file name of a path."""
    file = F.element_at(F.split(path, "/"), -1)
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("")), file


def highlight_parts(text: Column, query: str) -> Column:
    """Every occurrence of a query's words, also within words and in any case, wrapped in marks; the text is escaped first."""
    words = sorted({w for w in query.split() if w}, key=len, reverse=True)
    plain = html_escape(text)
    if not words:
        return plain
    rx = "(?i)(" + "|".join(re.escape(w.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")) for w in words) + ")"
    return F.regexp_replace(plain, rx, f"{MARK}$1{UNMARK}")


def sanitise_html(html: Column) -> Column:
    """HTML that runs nothing: scripts, styles, frames, objects and forms out with what is in them, no event attributes, no addresses but http,
    https, mailto, cid and images as data. Comments go too. Null stays null."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?is)<(script|style|iframe|object|embed|form|svg|math|template|noscript)\b[^>]*>.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?is)</?(script|style|iframe|object|embed|form|svg|math|template|noscript|link|meta|base|input|button)\b[^>]*>?", "")
    t = F.regexp_replace(t, r"(?is)[\s/\"']on[a-z]+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    bad = r"(?is)\s(href|src|action|background|poster|xlink:href)\s*=\s*(\"\s*(?!https?:|mailto:|cid:|data:image/(?:png|jpeg|gif|webp)|#|/)[^\"]*\"|'\s*(?!https?:|mailto:|cid:|data:image/(?:png|jpeg|gif|webp)|#|/)[^']*'|(?!\"|'|https?:|mailto:|cid:|#|/)[^\s>]+)"
    return F.regexp_replace(t, bad, "")
