"""Template residue, filler and error pages among real documents.

Everything is Catalyst expressions. Placeholders and filler are looked for sentence by sentence, so that a sentence that only
speaks of them doesn't count. Notices in place of content are told by two kinds of evidence: by terms that such pages have
anywhere, and by the corpus itself, which gives the same short answer for different addresses and titles, at several hosts, in words that
its real texts don't use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docuplane.session import Scratch, bounded_broadcast

# Words of the usual filler text.
FILLER_WORDS = (
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna "
    "aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui "
    "officia deserunt mollit anim id est laborum"
).split()

# What marks an unfilled placeholder.
PLACEHOLDERS = [
    r"\{\{[^{}\n]{1,60}\}\}",
    r"\{%[^%\n]{1,60}%\}",
    r"\$\{[^{}\n]{1,60}\}",
    r"<<\s*[\p{L}_][\p{L}\p{N}_. ]{0,40}>>",
    r"&lt;\s*[\p{L}_][\p{L}\p{N}_. ]{0,40}&gt;",
    r"@@[\p{L}_][\p{L}\p{N}_.]{0,40}@@",
    r"(?<![\p{L}\p{N}_])__[\p{L}][\p{L}\p{N}_.]{0,40}?__(?![\p{L}\p{N}_])",
    r"(?<![\p{L}\p{N}%])%[\p{L}_][\p{L}\p{N}_.]{1,40}%(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}#])#[\p{L}_][\p{L}\p{N}_.]{1,40}#(?![\p{L}\p{N}])",
    r"«[\p{L}_][\p{L}\p{N}_.]{0,40}»",
    r"(?i)\[(?:insert|enter|your|todo|tbd|fixme|placeholder|name|nom|nombre|date|datum|fecha|company|client|kunde|address|amount|title|recipient|signature)(?![\p{L}])[^\]\n]{0,40}\]",
]

# What a sentence says that speaks about placeholders instead of having one.
MENTIONS = r"(?i)\btemplates? (?:says?|has|uses?)\b|\bthe variables?\b|\bin the shell\b|\b(?:is|are) (?:expanded|explained|replaced|substituted)\b|\bplaceholders?\b|\bmail merge\b|\bsquare brackets\b|\bcurly (?:braces|brackets)\b|\bsyntax\b"

# Lines of pages that hold an error, a notice that scripts or a check of the browser are required, or sample text
# in place of content. Each must fit a whole line or, with its own anchors, begin it.
NOTICE_LINES = [
    # status lines and error pages
    r"(?:http status |error |fehler |erreur )?[45][0-9][0-9][ :-]{1,3}[\p{L} ]{3,40}(?: - nginx)?",
    r"(?:the )?(?:requested )?(?:page|url|address|resource|file)\b.{0,120}\b(?:was not found|could not be found|does not exist|no longer exists)\b.*",
    r"page not found.*", r"not found", r"bad gateway", r"service (?:temporarily )?unavailable", r"internal server error", r"bad request",
    r"access (?:is )?(?:denied|forbidden).*", r"(?:error [0-9]+: )?you do(?: not|n't) have permission\b.*", r"forbidden",
    r"seite nicht gefunden.*", r"die adresse .{0,120}gibt es nicht.*", r"zugriff verweigert.*", r"page introuvable.*", r"acc[eè]s (?:refus|interdit).*",
    r"p[aá]gina no encontrada.*", r"acceso denegado.*", r"error establishing a database connection.*", r"(?:the )?(?:service|site) is (?:down|unavailable|offline).*",
    r"too many requests.*", r"(?:request|connection|gateway) (?:has )?timed? ?out.*", r"this site can[’']t be reached.*", r".{0,120}took too long to respond.*",
    r"(?:oops[!.,]* ?)?something went wrong.*", r"(?:your )?session (?:has )?expired.*", r"(?:this )?(?:document|page|file|content) (?:could not|cannot|can't) be (?:displayed|shown|loaded).*",
    r"preview (?:is )?not available.*", r"traceback \(most recent call last\):?", r"fatal error: .*", r"(?:uncaught|unhandled) (?:exception|error)\b.*", r"stack trace:.*", r"type exception report.*",
    r"<html>.*\b[45][0-9][0-9]\b.*",
    # scripts and checks of the browser
    r"(?:please |you need to |you must )?(?:enable|activate|turn on|switch on) (?:javascript|scripts|cookies)\b.*", r"javascript is (?:turned off|disabled|required|not enabled)\b.*",
    r"(?:this|the) (?:page|site|app|document) (?:needs|requires) (?:java)?scripts?\b.*", r"<noscript>.*", r"(?:java)?scripts? (?:is|are) required\b.*",
    r"(?:veuillez )?activer? javascript\b.*", r"(?:bitte )?aktivieren sie javascript\b.*", r"(?:por favor,? )?active? javascript\b.*",
    r"(?:we are )?checking your browser\b.*", r"verify(?:ing)? (?:that )?you are (?:a )?human\b.*", r"just a moment\.*",
    # sample text and values that were never filled
    r"(?:[\w.]+ )?(?:sample|dummy|placeholder) (?:text|content|page)\b.*", r"your text (?:goes )?here\b.*", r"click here to add (?:text|a title|a subtitle)\b.*", r"untitled(?: document)?",
    r"hello world!? this is your first post\b.*", r"(?:mustertext|blindtext|texto de ejemplo|texte d'exemple)\b.*", r"\[object object\]", r"(?:undefined ?)+", r"(?:null|nan|n/a|none|nil)",
    r"tbd|tba|to be (?:completed|done|defined|announced)|todo|fixme", r"(?:x{2,} ?){2,}", r"(?:(?:asdf|qwer|qwerty|jkl|hjkl|zxcv|fdsa|yxcv)[a-z]{0,3} ?){2,}",
]

# Lines around a notice that say nothing themselves.
CHROME_LINES = [
    r"(?:home|search|help|menu|login|sign in|contact|about|back|next|imprint|start|accueil|inicio|hilfe|suche)(?: *[|>·/-] *(?:home|search|help|menu|login|sign in|contact|about|back|next|imprint|accueil|inicio|hilfe|suche))*",
    r"(?:\(c\)|©|copyright)(?: .{0,60})?", r".{0,40}\b(?:portal|viewer)", r"proxy v[0-9.]+", r"retour à l'accueil", r"please (?:try again|sign in)\b.*",
    r"#[0-9]+ [\w.{}]+", r"file \".*\", line [0-9]+.*", r"at [\w.$]+\(.*\)", r"[\p{L}]+error: .*", r"[\p{P}\p{S} ]+",
    r"(?:request id|message|reference|ray id|incident)\b.{0,60}", r"[\p{L}]{1,30}",
]

#: A text of at most so many different words says little. A line of such texts is an answer if so many texts of so many hosts have it
#: and if such a share of its words stand for the most part in lines like it.
WORDS, TEXTS, HOSTS, OWN_SHARE = 40, 3, 2, 0.25
#: Words of a line without an end mark that a notice may follow.
HEADING = 8


def _any(rx: list[str]) -> str:
    return "(?iu)^(?:" + "|".join(rx) + ")$"


def _lines(text: Column) -> Column:
    """The lines of a text without outer white space and without empty ones."""
    trimmed = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def _skeleton(line: Column) -> Column:
    """A line as answers are compared: lower case, addresses and whatever has digits alike."""
    return F.regexp_replace(F.regexp_replace(F.lower(line), r"/[\p{L}\p{N}_.\-]+(?:/[\p{L}\p{N}_.\-]*)+", "/"), r"[^\s/]*[0-9][^\s/]*", "0")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) > 1))


def has_placeholder(text: Column) -> Column:
    """Whether a sentence of the text has an unfilled placeholder and doesn't speak about placeholders."""
    marks = "(?:" + "|".join(PLACEHOLDERS) + ")"
    sentences = F.split(text, r"(?<=[.!?])\s+|\n")
    return text.rlike(r"[{<&@_%#«\[]") & text.rlike(marks) & F.exists(sentences, lambda s: s.rlike(marks) & ~s.rlike(MENTIONS))


def has_filler(text: Column) -> Column:
    """Whether a line of at least five words is for two thirds filler words."""
    words = "(?i)\\b(?:" + "|".join(FILLER_WORDS) + ")\\b"

    def bad(line: Column) -> Column:
        n = F.size(F.regexp_extract_all(line, F.lit(r"[\p{L}]+"), F.lit(0)))
        return (n >= 5) & (F.regexp_count(line, F.lit(words)) * 3 >= n * 2)

    lower = F.lower(text)
    rare = reduce(Column.__or__, [lower.contains(w) for w in ("lorem", "ipsum", "adipiscing", "consectetur", "eiusmod", "incididunt", "ullamco", "nostrud", "aliquip")])
    return rare & F.exists(F.split(text, "\n"), bad)


def has_notice(text: Column) -> Column:
    """Whether a run of lines, all notices or chrome and at least one a notice, stands by itself in the text.

    A run ends at blank lines and at other lines. It isn't by itself if it may be part of a wrapped sentence: the line before neither
    ends a sentence nor is a heading of at most HEADING words before a capital, or the line after goes on in lower case.
    """
    notice, chrome = _any(NOTICE_LINES), _any(CHROME_LINES)
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))

    def after(s: Column, x: Column) -> Column:
        # run: 0 none, 1 chrome only, 2 with a notice, 3 goes on with a sentence
        hit, own = x.rlike(notice), x.rlike(notice) | x.rlike(chrome)
        begins = (s.edge == "end") | ((s.edge == "heading") & x.rlike(r"^\p{Lu}"))
        run = F.when((x == "") | ~own, 0).when(s.run == 0, F.when(begins, F.when(hit, 2).otherwise(1)).otherwise(3)).when((s.run == 1) & hit, 2).otherwise(s.run)
        edge = F.when((x == "") | x.rlike(r"[.!?:…][\p{P}\p{S}]*$"), "end").when(F.size(F.split(x, " ")) <= HEADING, "heading").otherwise("open")
        return F.struct(edge.alias("edge"), run.alias("run"), (s.found | ((s.run == 2) & ((x == "") | (~own & ~x.rlike(r"^\p{Ll}"))))).alias("found"))

    begin = F.struct(F.lit("end").alias("edge"), F.lit(0).alias("run"), F.lit(False).alias("found"))
    # one look at the whole text rules most of them out
    blank = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*"
    return F.lower(text).rlike(f"(?m)^{blank}(?:" + "|".join(NOTICE_LINES) + f"){blank}$") & F.aggregate(lines, begin, after, lambda s: s.found | (s.run == 2))


def answers(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key of the rows that are an answer in place of content, by the evidence of the corpus alone.

    A text of at most WORDS different words is one if every line of it is an answer or a line of at most three words, and one at
    least is an answer that neither an address in the text nor its title explains: a line that TEXTS texts of HOSTS hosts share, but
    for addresses and numbers, and whose words stand for the most part in such lines. A line that shares a term of over
    three letters with the slug of an address, or with a title (a first line without end mark) that isn't itself an answer, is
    explained. Counted over all rows, summed per line and host before the shuffle.
    """
    where = F.coalesce(F.col(host), F.lit("")) if host in docs.columns else F.lit("")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), where.alias("h")).where("k is not null and t is not null")
    short = rows.where(F.size(_terms(F.col("t"))).between(1, WORDS))
    slug = F.regexp_extract("t", r"/[\p{L}\p{N}_.\-]+/[\p{L}\p{N}_.\-/]*[\p{L}\p{N}]", 0)
    long_terms = lambda c: F.filter(_terms(c), lambda w: F.length(w) > 3)
    parts = short.select("k", "h", F.xxhash64("t").alias("copy"), long_terms(slug).alias("slug"), F.posexplode(_lines(F.col("t"))).alias("place", "line"))
    parts = parts.select("k", "h", "copy", "slug", "place", _terms(F.regexp_replace("line", r"/[\p{L}\p{N}_.\-]+/[\p{L}\p{N}_.\-/]*", " ")).alias("w"), F.xxhash64(_skeleton(F.col("line"))).alias("s"))
    parts = Scratch(docs.sparkSession, "answers").cut(parts)
    by_host = parts.groupBy("s", "h").agg(F.count_distinct("k").alias("n"), F.min("w").alias("w"))
    again = by_host.groupBy("s").agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), F.min("w").alias("w")).where((F.col("n") >= TEXTS) & (F.col("hosts") >= HOSTS) & (F.size("w") > 0))
    again = Scratch(docs.sparkSession, "again").cut(again.select("s", "n", "w"))
    of_lines = again.select("n", F.explode("w").alias("word")).groupBy("word").agg(F.sum("n").alias("inside"))
    every = rows.select(F.explode(_terms(F.col("t"))).alias("word")).join(bounded_broadcast(of_lines.select("word"), 200_000), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    own = of_lines.join(every, "word").where(F.col("inside") * 2 >= F.col("n")).select("word")
    marked = again.select("s", F.size("w").alias("m"), F.explode("w").alias("word")).join(own, "word").groupBy("s", "m").agg(F.count("*").alias("own"))
    good = marked.where(F.col("own") >= OWN_SHARE * F.col("m")).select("s", F.lit(True).alias("good"))
    seen = parts.join(good, "s", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    title = F.max(F.when((F.col("place") == 0) & ~F.col("good"), F.filter("w", lambda x: F.length(x) > 3)))
    told = F.collect_list(F.when(F.col("good"), F.col("w")))
    # a low-information text has few lines, so what is gathered of one is bounded by WORDS but for repeated lines
    whole = seen.where("good or size(w) > 0").groupBy("k", "copy", "slug").agg(F.bool_and(F.col("good") | (F.size("w") <= 3)).alias("all"), F.coalesce(title, F.array().cast("array<string>")).alias("title"), F.array_distinct(told).alias("told"))
    alien = F.exists("told", lambda w: ~F.arrays_overlap(w, F.col("slug")) & ~F.arrays_overlap(w, F.col("title")))
    return whole.where(F.col("all") & alien).select(F.col("k").alias(key)).distinct()


def residue_evidence(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, has_placeholder, has_filler, is_notice, is_response for every row of docs.

    is_notice: the text is or has in it a notice (has_notice). is_response: the corpus shows that it's an answer in place of content
    (answers). Null, empty and blank texts have no evidence. A table without the host column counts as one host, where no line is
    an answer.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), t.alias("t"))
    found = rows.select("k", has_placeholder(F.col("t")).alias("has_placeholder"), has_filler(F.col("t")).alias("has_filler"), has_notice(F.col("t")).alias("is_notice"))
    known = answers(docs, key, text, host).select(F.col(key).alias("k"), F.lit(True).alias("is_response"))
    return found.join(known, "k", "left").select(F.col("k").alias(key), "has_placeholder", "has_filler", "is_notice", F.coalesce("is_response", F.lit(False)).alias("is_response"))


def residue(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key of the rows that hold residue, wholly or in part; once per key."""
    e = residue_evidence(docs, key, text, host)
    return e.where("has_placeholder or has_filler or is_notice or is_response").select(key).distinct()


def without_residue(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """docs without the rows that residue() names; rows with a null key stay."""
    return docs.join(residue(docs, key, text, host), key, "left_anti")
