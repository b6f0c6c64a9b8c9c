"""The text that the sender of a mail wrote for it, without quoted history, signatures and notices.

A mail is cut into blocks (runs of lines of one quote depth and kind between blank lines). Each block gets figures: contact
density, quote depth, how often its sender and others write the same block, overlap with the mail it answers, and cues of wording and
place. Gradient-boosted trees decide on every block. They are fitted on a bounded sample of blocks that the corpus itself labels,
by evidence no cue takes part in: text that stands in the answered mail, blocks that a sender writes again and again, the sender's own name,
lines that name the sender of the answered mail above quoted text, an opening line with a recipient's name, and text that stands nowhere else. A few written examples stand
beside them for what a small corpus doesn't hold.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from docuplane.operators.hierarchy import message_key
from docuplane.session import Scratch, spread

#: About so many of the labelled blocks, by the hash of their place, are what the trees are fitted on.
SAMPLE_BLOCKS = 20_000
#: A block is its sender's habit in at least so many mails that are at least such a share of all of them, and boilerplate if so many
#: mails of several senders begin a block of at least WORDY words with the same LEAD words.
HABIT_MAILS, HABIT_SHARE, COMMON_MAILS, WORDY, LEAD = 3, 0.2, 5, 6, 5

_PREFIX = re.compile(r"^[ \t]*(?:(?:[>|]|[A-ZÄÖÜ]{1,3}>)[ \t]?)+")
_MARK = re.compile(r"[>|]")
_SEPARATOR = re.compile(r"^[\W_]*$")
_EMAIL = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+")
#: An address, site or telephone number, which no evidence for new text has.
_ADDRESS = re.compile(r"\S@\S|\bwww\.|https?:|\d[\d ()/.-]{5,}\d")

# Lines that introduce quoted or forwarded text, whole after joining wrapped lines; those that begin with a date or
# mark, and those that begin with the name or address of who wrote.
_INTRO_DATED = re.compile(
    r"^(?:on|at) .{0,40}\d.{5,160}\bwrote ?:$|^am \d.{5,160}\bschrieb\b.{0,120}:$|^el \d.{5,160}\bescribió ?:$|^le \d.{5,160}\ba écrit ?:$|^\*? ?[^\s*].{2,80} \[[^\[\]]{6,60}\] ?:$", re.I
)
_INTRO_NAMED = re.compile(r"^(?:[A-ZÄÖÜ]|\S+@)[^.!?]{0,60}(?:[(<]?\S+@\S+[)>]? )?(?:wrote|writes|schrieb (?:am|um) .{4,60}|escribió(?: el .{4,60})?|a écrit(?: le .{4,60})?) ?:$")
_INTRO_REST = re.compile(r"^[(<]\S+@\S+[)>]? .{0,80}:$")
_FORWARD = re.compile(
    r"^-{3,} ?(?:original message|forwarded message|ursprüngliche nachricht|originalnachricht|weitergeleitete nachricht|mensaje original|mensaje reenviado|message d['’]origine|message original|message transféré) ?-{3,}$"
    r"|^(?:begin forwarded message|anfang der weitergeleiteten nachricht|(?:inicio|comienzo) del mensaje reenviado|début du (?:message|courriel) (?:transféré|réexpédié)) ?:$",
    re.I,
)
_HEADER = re.compile(r"^\*?(?:from|sent|to|cc|subject|date|von|gesendet|an|betreff|datum|de|enviado|para|asunto|fecha|envoyé|à|objet|date)\*? ?:\*? ?\S", re.I)

# Closing formulas, greetings, notices of devices and lists, and the terms of disclaimers.
_CLOSING = re.compile(
    r"^(?:(?:with )?(?:kind|best|warm|many)(?:est)? ?(?:regards|wishes|thanks)?|regards|rgds|cheers|thanks(?: again| and regards)?|thank you|yours(?: (?:sincerely|faithfully|truly|ever))?|sincerely(?: yours)?|all the best"
    r"|mit (?:freundlichen|besten|herzlichen|vielen) grüßen|(?:viele|beste|liebe|freundliche|herzliche|schöne) grüße|gruß|mfg|lg|vg|danke"
    r"|(?:un |muchos )?saludos?(?: cordiales?)?|un cordial saludo|atentamente|cordialmente|(?:un )?abrazos?|gracias"
    r"|cordialement|bien (?:à vous|cordialement)|salutations(?: distinguées)?|(?:sincères|meilleures) salutations|amicalement|merci)[ ,.!;]*$",
    re.I,
)
_GREETING = re.compile(r"^(?:dear|hi|hello|good (?:morning|afternoon|evening|day)|hallo|guten (?:tag|morgen|abend)|liebe[rs]?|sehr geehrte|moin|hola|estimad[oa]s?|querid[oa]s?|buen[oa]s? (?:días|tardes|noches)|bonjour|bonsoir|chère?s?|salut|madame|monsieur)\b.{0,60}$", re.I)
_NOTICE = re.compile(
    r"^(?:sent from (?:my|a)\b|sent (?:via|with)\b|get the \S+ app\b|gesendet (?:von|mit)\b|von unterwegs gesendet|enviado desde\b|envoyé (?:de(?:puis)?|avec)\b|scanned for viruses\b|(?:please )?(?:think|consider) (?:of|about|before)?.{0,40}\bprint"
    r"|bitte prüfen sie, ob diese mail gedruckt|antes de imprimir\b|pensez à l['’]environnement|you (?:receive|received|are receiving) this\b|to (?:leave|unsubscribe)\b|sie erhalten diese (?:mail|nachricht)|recibe (?:usted )?este\b|vous recevez ce\b|excuse typos)",
    re.I,
)
_LEGAL = re.compile(
    r"\b(?:confidential(?:ity)?|privileged|disclosure|addressee|recipient|intended (?:only )?for|liability|virus(?:-free|es)?|disclaimer|legally|not bind|does not (?:bind|amount)|author's own|no contract|by mistake|in error|delete it|destroy it|passed on|records policy|this (?:e-?mail|message|transmission|communication)|the above message|any attachment to this mail"
    r"|vertraulich|empfänger|irrtümlich|weitergegeben|untersagt|unbefugtes|rechtlich|bindend|geschützte|diese (?:e-?mail|nachricht|mitteilung)|inhalt dieser|amtsgericht|sitz der gesellschaft|hrb"
    r"|confidencial|destinatario|por error|bórrelo|difundirse|prohíbe|compromiso|protegidos|este (?:mensaje|correo)"
    r"|confidentiel|destinataire|destiné|détruire|expéditeur|diffusé|interdite|copie|engage|(?:ce|le présent) (?:message|courriel)|cette communication|protégées|société|comunicación)\b",
    re.I,
)
_LEGAL_START = re.compile(
    r"^(?:confidential(?:ity notice)?|notice|disclaimer|important|hinweis|achtung|vertraulich|aviso|avis|avertissement)(?: legal| important)? ?:"
    r"|^(?:this|the above|the views in this|any attachment to this|the contents? of this) (?:e-?mail|message|transmission|communication|mail)\b|^the above message\b"
    r"|^(?:diese|der inhalt dieser|die vorliegende) (?:e-?mail|nachricht|mitteilung)\b|^sitz der gesellschaft\b|^(?:este|el contenido de este|el presente) (?:mensaje|correo)\b|^(?:la presente|esta) comunicación\b|^(?:ce|le contenu de ce|le présent) (?:message|courriel)\b|^(?:cette|la présente) communication\b",
    re.I,
)
_CONTACT = re.compile(r"^(?:t|tel|tél|phone|telephone|telefon|teléfono|téléphone|mobile?|mobil|móvil|fax|f|m|p|e-?mail|mail|web|www)\b[ .:+]*.*\d|^\+?[\d ()/.-]{6,}$|^(?:https?://|www\.)\S+$|^[\w.+-]+@[\w-]+\.[\w.]+$", re.I)
_PLACE = re.compile(r"^[^.!?]{2,40}, (?:room|haus|quay|pier|floor|building|etage|zimmer|planta|bureau|étage|dock|gate|unit|suite|office) ?[\w.]{0,8}$", re.I)

FEATURES = ["depth", "history", "text", "wrap", "intro", "separator", "closing", "greeting", "contact", "names", "notice", "legal", "legal_start", "words", "overlap", "has_ancestor", "after_closing", "opens", "from_end", "sentences"]
#: What is counted over all mails and joins the figures of a block: mails that hold it, senders, mails of its sender, their share.
COUNTED = ["mails", "senders", "habit", "habit_share"]
#: Evidence for a label: text of the answered mail, a line that introduces it, or only the sender's own name; a recipient greeted where the own text opens; text that is new if it stands nowhere else.
OLD, GREETED, PROSE = 1, 2, 3


def _words(s: str) -> list[str]:
    return re.findall(r"\w+", s.lower())


def lines_of(content: str) -> list[str]:
    """Lines as numbered in the results: split at \\n, a \\r before it taken off."""
    return [x[:-1] if x.endswith("\r") else x for x in content.split("\n")]


def sender_names(sender: str | None) -> set[str]:
    """Lower-case given, family and full name of a From header, from its display name or the address."""
    if not sender:
        return set()
    shown = re.sub(r"<[^>]*>|\([^)]*@[^)]*\)|[\"']", " ", sender).strip()
    if not shown or "@" in shown:
        m = _EMAIL.search(sender)
        shown = re.sub(r"[._-]+", " ", m[0].split("@")[0]) if m else ""
    parts = _words(shown)
    return {*parts, " ".join(parts), " ".join(parts[::-1])} - {""} if parts else set()


def _bare(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


class Block:
    """Lines [first, last] of one kind, their figures and what speaks for a label."""

    __slots__ = ("first", "last", "kind", "figures", "key", "lead", "evidence")


def blocks_of(content: str | None, sender: str | None = None, ancestor: str | None = None, above: str | None = None, to: str | None = None, starts: bool = False) -> list[Block]:
    """The blocks of a mail in order; every non-blank line is in one. Null and blank contents have none.

    ancestor and above: content and sender of the mail it answers; to: the recipients; starts: whether it answers none. Figures are
    FEATURES; key is the hash by which equal blocks are counted, None for quoted ones and those without words, lead that of the first words of
    longer ones; evidence is OLD, GREETED,
    PROSE or 0.
    """
    if not content or not content.strip():
        return []
    lines = lines_of(content)
    n = len(lines)
    text = [x.strip() for x in lines]
    prefix = [_PREFIX.match(x) for x in lines]
    depth = [len(_MARK.findall(p[0])) if p else 0 for p in prefix]
    kind = [""] * n
    names = {_bare(x) for x in sender_names(sender)}

    a_words = [w for x in lines_of(ancestor) for w in _words(_PREFIX.sub("", x))] if ancestor else []
    grams = {tuple(a_words[k : k + 4]) for k in range(len(a_words) - 3)}

    def known(w: list[str]) -> float:
        return sum(tuple(w[k : k + 4]) in grams for k in range(len(w) - 3)) / (len(w) - 3) if len(w) >= 4 else 0.0

    # quoted lines; a single marked number at the start of a paragraph is none
    for i in range(n):
        if not text[i]:
            kind[i] = "blank"
        elif depth[i] == 1 and re.match(r"^> \d+ [a-z]", lines[i]) and (i == 0 or not text[i - 1]) and i + 1 < n and text[i + 1] and not depth[i + 1] and known(_words(lines[i])) < 0.5:
            depth[i] = 0
        elif depth[i]:
            kind[i] = "quoted"
    # unmarked lines right below quoted ones: the rest of a line that was wrapped again, or a reply
    i = 0
    while i < n:
        if kind[i] == "" and i and kind[i - 1] in ("quoted", "wrap"):
            j = i
            while j < n and kind[j] == "":
                j += 1
            above, own = _PREFIX.sub("", lines[i - 1]).strip(), " ".join(text[i:j])
            below = next((_PREFIX.sub("", lines[k]).strip() for k in range(j, min(n, j + 3)) if kind[k] == "quoted"), "")
            aw, ow, bw = _words(above), _words(own), _words(below)
            if known(aw[-3:] + ow[:3]) > 0.6 or known(ow) > 0.5:
                rest = True
            elif bw and known(aw[-3:] + bw[:3]) > 0.6:
                rest = False
            elif own[:1].islower():
                rest = True
            else:
                rest = bool(above) and not re.search(r"[.!?:]$", above) and len(above) > 20 and (len(ow) < 5 or not re.search(r"[.!?]$", own))
            if rest:
                for k in range(i, j):
                    kind[k] = "wrap"
            i = j
        else:
            i += 1

    # introductions and forwarded history
    def introduces(i: int) -> int:
        """The number of lines from i on that are one introduction, else 0."""
        for k in range(1, 4):
            part = text[i : i + k]
            if len(part) < k or any(kind[i + m] for m in range(k)):
                return 0
            whole = " ".join(part)
            if _INTRO_DATED.match(whole) or (k > 1 and len(_words(part[0])) <= 4 and _INTRO_REST.match(" ".join(part[1:])) and _INTRO_NAMED.match(whole)):
                return k
            if _INTRO_NAMED.match(whole):
                address = _EMAIL.search(whole)
                inside = set(_words(_bare(address[0]).replace("_", " "))) if address else set()
                if k == 1 or (address and all(w in inside for w in _words(_bare(part[0]))[:2])) or (not address and len(_words(part[0])) <= 3 and not _CLOSING.match(part[0])):
                    return k
        return 0

    history = False
    in_history = [False] * n
    i = 0
    while i < n:
        if kind[i] == "":
            if _FORWARD.match(text[i]):
                kind[i], history = "intro", True
            elif re.fullmatch(r"_{8,}", text[i]) and i + 1 < n and sum(bool(_HEADER.match(x)) for x in text[i + 1 : i + 6]) >= 3:
                kind[i], history = "intro", True
            elif not history and _HEADER.match(text[i]) and sum(bool(_HEADER.match(x)) for x in text[i : i + 5]) >= 3:
                kind[i], history = "intro", True
            elif history and _HEADER.match(text[i]):
                kind[i] = "intro"
            elif k := introduces(i):
                for m in range(k):
                    kind[i + m] = "intro"
                    in_history[i + m] = history
        in_history[i] = history
        i += 1

    # what is left: line by line, then whole paragraphs
    after = [False] * n
    closed = False
    i = 0
    while i < n:
        after[i] = closed
        if kind[i] in ("quoted", "wrap", "intro", "blank"):
            closed = False if kind[i] in ("quoted", "wrap") else closed
            i += 1
            continue
        t = text[i]
        if _SEPARATOR.match(t) and not re.search(r"[+]", t):
            kind[i] = "separator"
            closed = closed or bool(re.fullmatch(r"-{2,3}", t))
        elif _CLOSING.match(t):
            kind[i], closed = "closing", True
        elif (_bare(" ".join(_words(t))) in names and not t.endswith("-")) or (i and kind[i - 1] in ("closing", "separator") and after[i - 1 : i] and closed and re.fullmatch(r"[A-ZÄÖÜ][\w.-]*(?: [A-ZÄÖÜ][\w.-]*){0,2}", t)):
            kind[i], closed = "names", True
        elif _CONTACT.match(t) or (_PLACE.match(t) and (closed or (i and kind[i - 1] in ("names", "contact", "separator")))):
            kind[i] = "contact"
        elif _NOTICE.match(t):
            j = i
            while j < n and kind[j] == "" and text[j] and (j == i or not _SEPARATOR.match(text[j])):
                kind[j] = "notice"
                after[j] = closed
                j += 1
            i = j
            continue
        elif _LEGAL_START.match(t):
            j = i
            while j < n and kind[j] == "" and text[j] and not _SEPARATOR.match(text[j]):
                j += 1
            whole = " ".join(text[i:j])
            if len(_LEGAL.findall(whole)) >= 2:
                for k in range(i, j):
                    kind[k] = "legal"
                    after[k] = closed
                i = j
                continue
            kind[i] = "text"
        else:
            kind[i] = "greeting" if _GREETING.match(t) or (re.fullmatch(r"\w+ -", t)) else "text"
            if kind[i] == "greeting" and closed and not in_history[i]:  # another letter begins below the signature, unmarked
                in_history[i:] = [True] * (n - i)
        i += 1

    last_text = max((i for i in range(n) if text[i]), default=0)
    author = {w for x in sender_names(above) for w in _words(_bare(x))}
    greeted = {w for w in _words(_bare(re.sub(r"@\S*", " ", to or "").replace(".", " ").replace("_", " "))) if len(w) > 2}
    out: list[Block] = []
    begun = False
    i = 0
    while i < n:
        if kind[i] == "blank":
            i += 1
            continue
        j = i
        while j + 1 < n and kind[j + 1] == kind[i] and kind[i] not in ("closing", "separator", "greeting") and in_history[j + 1] == in_history[i]:
            j += 1
        b = Block()
        b.first, b.last, b.kind = i, j, kind[i]
        quoted = kind[i] == "quoted"
        body = "" if quoted else " ".join(text[i : j + 1])
        w = _words(body)
        if quoted:
            over = known([x for k in range(i, j + 1) for x in _words(_PREFIX.sub("", lines[k]))])
        else:  # a few words stand in any mail
            over = known(w)
        k = kind[i]
        opens = not begun
        plain = re.sub(r"\d+", "0", " ".join(w))
        b.lead = xxhash.xxh64_intdigest(" ".join(w[:LEAD])) - (1 << 63) if len(w) >= WORDY else None
        b.key = xxhash.xxh64_intdigest(plain) - (1 << 63) if plain else None
        b.figures = {
            "depth": max(depth[i : j + 1]), "history": in_history[i], "text": k == "text", "wrap": k == "wrap", "intro": k == "intro", "separator": k == "separator", "closing": k == "closing", "greeting": k == "greeting",
            "contact": 0.0 if quoted else sum(bool(_CONTACT.match(x) or _PLACE.match(x)) for x in text[i : j + 1]) / (j - i + 1), "names": k == "names", "notice": k == "notice",
            "legal": len(_LEGAL.findall(body)) / max(1, len(w)) * 10, "legal_start": k == "legal", "words": min(len(w), 60), "overlap": 0.0 if quoted else over, "has_ancestor": bool(ancestor),
            "after_closing": after[i], "opens": opens, "from_end": (last_text - j) / max(1, n), "sentences": len(re.findall(r"[.!?](?:\s|$)", body)),
        }
        b.evidence = 0
        prose = not depth[i] and len(w) >= WORDY and text[j][-1] not in ":," and not _ADDRESS.search(body)
        begun = begun or (prose and over < 0.6)
        said = {x for x in _words(_bare(body))}
        if said and said <= {x for y in names for x in y.split()} and not depth[i] and text[j][-1:] not in ",:!-":  # signed
            b.evidence = OLD
        elif ancestor and over >= 0.6 and (quoted or len(w) >= 4):
            b.evidence = OLD
        elif opens and not depth[i] and j == i and len(w) <= 6 and said & greeted and (said - greeted or text[j][-1] in ",:!-"):
            b.evidence = GREETED
        elif prose and (starts or (ancestor and over < 0.1)):
            b.evidence = PROSE
        if quoted and out and not out[-1].figures["depth"] and len(said & author) == 0:
            last = out[-1]
            names_author = {x for k in range(last.first, last.last + 1) for x in _words(_bare(text[k]))} & author
            if len(names_author) >= 2 and text[last.last].endswith(":"):
                last.evidence = OLD
        out.append(b)
        i = j + 1
    return out


class Trees:
    """Gradient-boosted regression trees for a yes-or-no target (log loss), grown on quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 32, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """x: rows by features, y: 0 or 1. With one class only the base rate is learnt."""
        p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        if not len(y) or len(np.unique(y)) < 2:
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            node, tree = np.zeros(len(y), np.int64), [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            for k in range(len(tree)):
                at = np.flatnonzero(node == k)
                if not len(at):
                    continue
                tree[k] = (-1, 0.0, self.rate * g[at].sum() / (h[at].sum() + 1))
                if k >= 2**self.depth - 1 or len(at) < 2 * self.least:
                    continue
                best = (1e-6, -1, 0)
                whole = g[at].sum() ** 2 / (h[at].sum() + 1)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    m = len(c) + 1
                    gs, hs, ns = (np.bincount(binned[at, f], v, m).cumsum()[:-1] for v in (g[at], h[at], np.ones(len(at))))
                    gain = gs**2 / (hs + 1) + (g[at].sum() - gs) ** 2 / (h[at].sum() - hs + 1) - whole
                    gain[(ns < self.least) | (len(at) - ns < self.least)] = -1
                    s = int(gain.argmax())
                    if gain[s] > best[0]:
                        best = (float(gain[s]), f, s)
                if best[1] >= 0:
                    tree[k] = (best[1], float(cuts[best[1]][best[2]]), 0.0)
                    node[at] = 2 * k + 1 + (binned[at, best[1]] > best[2])
            self.trees.append(tree)
            score += self._walk(tree, x)
        return self

    @staticmethod
    def _walk(tree: list, x: np.ndarray) -> np.ndarray:
        f, c, v = (np.array(z) for z in zip(*tree))
        node = np.zeros(len(x), np.int64)
        while (inner := f[node] >= 0).any():
            i = np.flatnonzero(inner)
            node[i] = 2 * node[i] + 1 + (x[i, f[node[i]]] > c[node[i]])
        return v[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of 1 for each row."""
        return self.base + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))


def with_ancestor(mails: DataFrame) -> DataFrame:
    """doc_id, content, sender, to (recipients), message (its id, else doc_id), starts (whether it answers no mail), and ancestor and above: content and sender of the mail
    that in_reply_to, else the last of refs, names (null if none is here or it's sent later, as on loops)."""
    at = F.col("sent_at") if "sent_at" in mails.columns else F.lit(None).cast("timestamp")
    to = F.array_join(F.coalesce(F.col("email_to"), F.array().cast("array<string>")), " ") if "email_to" in mails.columns else F.lit("")
    named = F.concat(F.array(message_key(F.col("in_reply_to"))), F.reverse(F.coalesce(F.transform("refs", message_key), F.array().cast("array<string>"))))
    rows = mails.select("doc_id", "content", at.alias("at"), F.col("email_from").alias("sender"), to.alias("to"), message_key(F.col("message_id")).alias("m"), named.alias("named"))
    bodies = rows.where("m is not null and content is not null").groupBy("m").agg(F.min_by(F.struct("content", "sender"), "doc_id").alias("x"), F.min("at").alias("sent"))
    links = rows.select("doc_id", F.posexplode("named").alias("place", "m")).where("m is not null").distinct()
    up = links.join(bodies.select("m"), "m", "left_semi").groupBy("doc_id").agg(F.min_by("m", "place").alias("m")).join(bodies, "m").select("doc_id", "x", "sent")
    known = F.when(F.coalesce(F.col("sent") > F.col("at"), F.lit(False)), None).otherwise(F.col("x"))
    starts = ~F.exists("named", lambda x: x.isNotNull())
    mine = spread(rows.select("doc_id", "content", "sender", "at", "to", F.coalesce("m", "doc_id").alias("message"), starts.alias("starts")), "doc_id").join(up, "doc_id", "left")
    return mine.select("doc_id", "content", "sender", "to", "message", "starts", known["content"].alias("ancestor"), known["sender"].alias("above"))


def mail_blocks(mails: DataFrame) -> DataFrame:
    """doc_id, first, last (line numbers from 0), sender and message (hashes of the address and the id), key, lead, evidence, x (FEATURES as half floats) of all blocks
    of all mails."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, t, s, a, up, to, m, new in zip(*(batch[c] for c in ("doc_id", "content", "sender", "ancestor", "above", "to", "message", "starts"))):
                address = _EMAIL.search(s.lower()) if isinstance(s, str) else None
                who = xxhash.xxh64_intdigest(address[0] if address else s or "") - (1 << 63)
                sent = xxhash.xxh64_intdigest(m) - (1 << 63)
                for b in blocks_of(t, s, *(x if isinstance(x, str) else None for x in (a, up, to)), bool(new)):
                    out.append((d, b.first, b.last, who, sent, b.key, b.lead, b.evidence, np.array([b.figures[f] for f in FEATURES], np.float16).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "first", "last", "sender", "message", "key", "lead", "evidence", "x"]).astype({"key": "Int64", "lead": "Int64"})

    rows = with_ancestor(mails).where("content is not null")
    return rows.mapInPandas(cut, "doc_id string, first int, last int, sender bigint, message bigint, key bigint, lead bigint, evidence int, x binary")


def with_frequency(blocks: DataFrame) -> DataFrame:
    """blocks with COUNTED, over all mails (a message that is stored twice is one): how many mails and senders hold the block outside quotes, in how many mails of the same sender
    it stands and which share of the sender's other mails hold it; 0 for blocks without key. A block that very many mails hold is counted, and joined,
    by sender."""
    once = blocks.where("key is not null").select("key", "sender", "message").distinct()
    own = once.groupBy("key", "sender").agg(F.count("*").alias("habit"))
    every = own.groupBy("key").agg(F.sum("habit").alias("mails"), F.count("*").alias("senders"))
    wrote = blocks.groupBy("sender").agg(F.count_distinct("message").alias("wrote"))
    known = own.where("key is not null").join(every, "key").join(wrote, "sender").select("key", "sender", "mails", "senders", "habit", ((F.col("habit") - 1) / F.greatest(F.col("wrote") - 1, F.lit(1))).alias("habit_share"))
    return blocks.join(known, ["key", "sender"], "left").select(*blocks.columns, *[F.coalesce(c, F.lit(0)).cast("float").alias(c) for c in COUNTED])


# Mails written as examples, one line a row; + marks what is new. They teach the trees the plain cases that a small
# corpus may not hold.
EXAMPLES = [
    ("Ruth Amber <ruth.amber@example.org>", """+Dear Tom,

+The second crate is in the cellar now, and the key hangs where it always did.

+Could you bring the two lists along on Friday?

 Kind regards
 Ruth Amber
 --
 Ruth Amber
 Accounts, Room 14
 Tel. +00 555 0101
 www.example.org
 * * *
 This message is confidential and intended for the addressee only. If you received it in error, please delete it."""),
    ("Tom Field <tom.field@example.org>", """+Yes.

 Sent from my phone

 On Mon, 3 Feb 2020 at 10:00, Ruth Amber wrote:
 > Dear Tom,
 > the second crate is in the cellar now, and the key hangs
 where it always did.
 > Ruth"""),
    ("Tom Field <tom.field@example.org>", """+Both.

 Sent from my phone
 * * *
 Disclaimer: this e-mail and its contents are confidential and may be privileged. If you are not
 the intended recipient, delete it and tell the sender."""),
    ("Tom Field <tom.field@example.org>", """+For your files, the letter we spoke of this morning.

 -----Original Message-----
 From: Ruth Amber <ruth.amber@example.org>
 Sent: Mon, 3 Feb 2020 at 10:00
 To: tom.field@example.org
 Subject: crate

 Hi all,

 The lists were checked twice and are complete.

 Thanks,
 Ruth"""),
    ("Jana Holt <jana.holt@example.org>", """+Guten Tag,

+Die Unterlagen liegen seit gestern im zweiten Schrank, der Schlüssel steckt.

+danke, passt

 Mit freundlichen Grüßen
 Jana Holt
 -----
 Gesendet von meinem Telefon

 Hinweis: diese Nachricht ist vertraulich und nur für den Empfänger bestimmt. Sitz der Gesellschaft ist Musterstadt."""),
    ("Inés Mora <ines.mora@example.org>", """+Hola Pedro,

+Los dos paquetes llegaron ayer por la tarde y están en la entrada.

 Un saludo,
 Inés
 Enviado desde mi teléfono

 El 03/02/2020 a las 10:00, Pedro Luna escribió:
 > ¿Llegaron los paquetes?"""),
    ("Luc Bonnet <luc.bonnet@example.org>", """ Le 03/02/2020 à 10:00, Anne Petit a écrit :
 | Bonjour Luc,
 | Les clés sont où ?

+Bonjour Anne,

+Elles sont dans le tiroir du bureau, à gauche de la porte.
+* tiroir
+* armoire

 Cordialement,
 Luc Bonnet
 Tél. +00 555 0102
 luc.bonnet@example.org

 Ce message est confidentiel et destiné à la seule personne nommée ; toute copie est interdite."""),
]
#: How often the examples count beside the corpus.
EXAMPLE_WEIGHT = 10


def examples() -> tuple[np.ndarray, np.ndarray]:
    """Figures and labels of the blocks of EXAMPLES, each with the counts of a rare and of a frequent block, in a mail that answers
    another and in one that doesn't."""
    x, y = [], []
    for sender, text in EXAMPLES:
        lines = text.split("\n")
        for b in blocks_of("\n".join(t[1:] for t in lines), sender):
            for counts, answers in product(([1, 1, 1, 0], [7, 6, 4, 0.5]), (0, 1)):
                x.append([float(answers if f == "has_ancestor" else b.figures[f]) for f in FEATURES] + counts)
                y.append(float(lines[b.first][0] == "+"))
    return np.array(x), np.array(y)


def labels(rows: pd.DataFrame) -> np.ndarray:
    """1 (new), 0 (not) or nan for blocks with evidence, COUNTED and `begins` (mails of several senders that begin a block like this one), by
    what the corpus says of them."""
    x, mails = _matrix(rows), rows["mails"].to_numpy()
    opens, several = x[:, FEATURES.index("opens")] > 0, x[:, FEATURES.index("words")] > 1
    again = several & (rows["habit"].to_numpy() >= HABIT_MAILS) & (rows["habit_share"].to_numpy() >= HABIT_SHARE)
    common, evidence = rows["begins"].to_numpy() >= COMMON_MAILS, rows["evidence"].to_numpy()
    out = np.full(len(rows), np.nan)
    out[(evidence == PROSE) & (mails <= 1)] = 1
    out[(again | common) & ~opens] = 0
    out[evidence == GREETED] = 1
    out[evidence == OLD] = 0
    return out


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    x = np.frombuffer(b"".join(rows["x"]), np.float16).reshape(len(rows), len(FEATURES)).astype(float)
    counted = rows[COUNTED].to_numpy(float)
    counted[:, :3] = np.log2(1 + counted[:, :3])
    return np.hstack([x, counted])


def fitted(blocks: DataFrame, sample_blocks: int = SAMPLE_BLOCKS) -> tuple[Trees, pd.DataFrame]:
    """The trees, and the labelled sample (with `label`) they are fitted on: about sample_blocks blocks, by the hash of their place, which
    is all that comes to the driver."""
    n = blocks.count()
    part = min(1.0, sample_blocks / max(1, n))
    chosen = blocks.where(F.pmod(F.xxhash64("doc_id", "first"), F.lit(1 << 30)) < int(part * (1 << 30))).select("doc_id", "first", "lead", "evidence", "x", *COUNTED)
    leads = F.broadcast(chosen.where("lead is not null").select("lead").distinct())  # no more than the sample
    begins = blocks.join(leads, "lead").groupBy("lead", "sender").agg(F.count_distinct("message").alias("n")).groupBy("lead").agg(F.when(F.count("*") > 1, F.sum("n")).otherwise(0).alias("begins"))
    sample = chosen.join(begins, "lead", "left").withColumn("begins", F.coalesce("begins", F.lit(0))).toPandas().sort_values(["doc_id", "first"], ignore_index=True)
    sample["label"] = labels(sample)
    told = sample[sample["label"].notna()]
    x, y = _matrix(told), told["label"].to_numpy(float)
    # in a second copy the counts say nothing and the answered mail isn't here: the trees can't live on what the labels were read from
    again, order = x.copy(), np.random.default_rng(7).permutation(len(x))
    again[:, len(FEATURES) :] = x[order][:, len(FEATURES) :]
    again[:, [FEATURES.index("overlap"), FEATURES.index("has_ancestor")]] = 0
    seed_x, seed_y = examples()
    return Trees().fit(np.vstack([x, again] + [seed_x] * EXAMPLE_WEIGHT), np.concatenate([y, y] + [seed_y] * EXAMPLE_WEIGHT)), sample


def newly_written(mails: DataFrame, sample_blocks: int = SAMPLE_BLOCKS) -> DataFrame:
    """doc_id, line_no (from 1): the non-blank lines newly written by the sender of each mail.

    mails: doc_id, message_id, in_reply_to, refs, email_from, content and, if known, email_to and sent_at; other columns don't matter.
    Null and blank contents, and mails of quotes and notices only, give no line. The trees decide on every block; see fitted() for
    what they learn from.
    """
    spark = mails.sparkSession
    blocks = Scratch(spark, "mails").cut(with_frequency(Scratch(spark, "blocks").cut(mail_blocks(mails))))
    shared = spark.sparkContext.broadcast(fitted(blocks, sample_blocks)[0])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = b[shared.value.score(_matrix(b)) > 0]
            lens = (new["last"] - new["first"] + 1).to_numpy()
            nos = [n for a, z in zip(new["first"], new["last"]) for n in range(a + 1, z + 2)]
            yield pd.DataFrame({"doc_id": np.repeat(new["doc_id"].to_numpy(), lens), "line_no": pd.Series(nos, dtype="int64")})

    return blocks.select("doc_id", "first", "last", "x", *COUNTED).mapInPandas(decide, "doc_id string, line_no bigint")
