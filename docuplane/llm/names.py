"""Variant spellings of names of people and organisations linked within each index.

A spelling is read into a family name (or an organisation's own name), the given names it may stand for and what kind of
organisation it is. Spellings are blocked by phonetic codes of their sorted name tokens and by all forms with one letter dropped
(which no single slip escapes), compared with Jaro-Winkler and a nickname table, and accepted pairs are clustered by connected
components. An initial or abbreviation that fits several people of that family name is linked with none of them.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from docuplane.llm.components import components
from docuplane.session import Scratch, spread

# Given names and their short forms.
NICKNAMES = {
    "alexander": "alex sasha xander sandy lex alec sascha", "antonio": "toni tony tono tonio tino anton anthony", "charlotte": "lotte lottie charly charlie lola",
    "dorothea": "thea dora doro dolly dorothy dot", "edward": "ted ned ed eddie teddy eduard", "elizabeth": "liz betty beth eliza lizzie bess elisabeth lisa elsa libby",
    "francisco": "paco pancho fran frank curro paquito cisco", "friedrich": "fritz fred freddy fredi frieder", "gabriel": "gabe gabi gab", "giuseppe": "beppe pino peppe peppino joe",
    "hakan": "hak hakon", "isabelle": "isa bella belle izzy isabel", "johannes": "hans jo john hannes johann jan", "jose": "pepe jo chepe joe pepito", "jurgen": "jogi jurg jorg",
    "katherine": "kate kathy kat katie kit kitty catherine kathrin kay", "leonard": "leo len lenny leon leonhard", "margaret": "peggy maggie meg marge greta madge margarete daisy",
    "matthias": "matze matt hias mats mathias matthew", "michael": "mike mick micky mickey michel", "nicholas": "nick nico nic nicky klaus nicolas", "olivier": "oli ollie oliver olly",
    "patricia": "pat patty trish tricia patti", "quentin": "quin quint quinn", "richard": "dick rick rich ricky richie", "robert": "bob rob bobby robbie bert robin",
    "rosalind": "roz rosa rosie ros linda", "susanne": "susi sanne susan sue suse suzy", "theresa": "tess terry tessa teresa resi tracy", "ulrike": "uli rike ulli ulla",
    "valentin": "val tino valente vali", "veronica": "ronnie vera roni nica vero ronni", "wilhelmina": "mina willa minna wilma minnie helma", "william": "will bill billy willy liam willie",
    "yvonne": "yvi von evi yvie vonnie", "zachary": "zach zack zak zac",
}

# Short forms that no rule gives (short_form knows Ben, Sammy, Vicky and the like).
IRREGULAR = {
    "albert": "al bertie", "andrew": "drew", "ann": "nancy nan nanny", "anna": "nan annie", "barbara": "babs bobbie", "charles": "chuck charlie carlos", "concepcion": "concha", "cornelius": "neil con", "dolores": "lola",
    "eduardo": "lalo", "eleanor": "nell nora nellie", "emily": "millie", "enrique": "quique", "frances": "fanny", "gilbert": "bert", "giovanni": "gianni vanni nanni", "guillermo": "memo", "gustav": "gus", "harold": "hal harry",
    "heinrich": "heinz heiner", "helen": "nell nellie", "henry": "harry hank hal", "herbert": "bert", "ignacio": "nacho", "isabel": "tibby", "jacob": "jack jake", "james": "jim jimmy jamie", "jane": "jenny", "janet": "jenny jessie",
    "jesus": "chuy", "johann": "hans", "john": "jack johnny", "josef": "sepp jupp", "joseph": "joe jos", "lawrence": "larry lorry", "louise": "lulu", "ludwig": "lutz", "luigi": "gigi", "martha": "patty mattie", "mary": "molly polly mamie",
    "mildred": "millie", "oliver": "noll", "rosario": "charo", "rudolf": "rolf", "salvatore": "toto", "sarah": "sally sadie", "sophia": "fifi", "theodore": "ted teddy", "thomas": "tam", "ursula": "uschi", "virginia": "ginny ginger",
    "walter": "wat", "winifred": "freda", "zenobia": "nobie",
}

# Words that name a kind of organisation, with common short forms.
ORG_WORDS = {
    "authority": "auth", "association": "assoc assn", "bank": "bk", "board": "bd", "bureau": "", "college": "coll", "commission": "comm", "committee": "cttee", "company": "co", "corporation": "corp",
    "council": "cncl", "department": "dept", "engineering": "engg eng engr", "foundation": "found fdn", "harbour": "harbor hbr", "hospital": "hosp", "institute": "inst", "insurance": "ins", "laboratory": "lab",
    "ministry": "min", "municipal": "mun munic", "museum": "mus", "office": "off", "port": "pt", "research": "res", "savings": "svgs sav", "school": "sch", "shipping": "shpg ship", "society": "soc",
    "trust": "tr", "university": "univ", "water": "wtr", "works": "wks",
}
# What is taken off a name.
LEGAL = "ltd limited gmbh ag inc incorporated sa plc llc llp kg bv nv corp sarl srl".split()
TITLES = "dr prof professor mr mrs ms miss mx herr frau m mme sir dame dipl ing mag rev hon".split()
DEGREES = "msc bsc phd ba ma md mba jr sr esq llm".split()

_WORD = re.compile(r"[^\W\d_]+")


def plain(s: str) -> str:
    """Lower case, letters without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o")


def fold(s: str) -> str:
    """plain(), with written-out umlauts like plain vowels."""
    return re.sub(r"([aou])e", r"\1", plain(s))


_GIVEN: dict[str, frozenset] = {}
for _full, _short in NICKNAMES.items():
    for _n in [_full, *_short.split()]:
        _GIVEN[fold(_n)] = _GIVEN.get(fold(_n), frozenset()) | {fold(_full)}
_KNOWN = frozenset(fold(n) for n in NICKNAMES)
for _full, _short in IRREGULAR.items():
    for _n in [_full, *_short.split()]:
        _GIVEN[fold(_n)] = _GIVEN.get(fold(_n), frozenset()) | {fold(_full)}
_FULL = [fold(n) for n in NICKNAMES]
_ORG = {fold(n): fold(full) for full, short in ORG_WORDS.items() for n in [full, *short.split()]}
_ORG_FULL = [fold(n) for n in ORG_WORDS]


def slips(a: str, b: str) -> int:
    """0 for equal strings, 1 if one letter is added, dropped, changed or swapped with its neighbour, else 2."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return 2
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return 1 if a[i:] == b[i + 1 :] else 2
    if a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]):
        return 1
    return 2


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity; 1 for equal, 0 if one is empty."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    hit_a, hit_b = [], [False] * len(b)
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not hit_b[j] and b[j] == x:
                hit_b[j] = True
                hit_a.append(x)
                break
    m = len(hit_a)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(hit_a, (c for c, h in zip(b, hit_b) if h))) / 2
    j = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return j + prefix * 0.1 * (1 - j)


def phonetic(word: str) -> str:
    """The first letter and the classes of all further consonants, without repeats."""
    classes = {c: k for k, cs in {"1": "bfpvw", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}
    return word[:1] + "".join(k for k, _ in groupby(classes.get(c, "") for c in word[1:]) if k)


@lru_cache(100_000)
def _given(token: str) -> tuple[frozenset, int]:
    """The given names a token may stand for, and how surely: 0 by the table, 1 short form, 2 with a slip, 3 not known."""
    t = fold(token.rstrip("."))
    if t in _GIVEN:
        return _GIVEN[t], 0
    if len(t) >= 3 and (found := frozenset(n for n in _FULL if n.startswith(t))):
        return found, 1
    if len(t) >= 4:
        found = frozenset(n for n in _FULL if slips(t, n) == 1)
        found = found or frozenset(sorted(((jaro_winkler(t, n), n) for n in _FULL), reverse=True)[0][1:]) if len(t) >= 6 and max(jaro_winkler(t, n) for n in _FULL) >= 0.9 else found
        if found:
            return found, 2
    return frozenset(), 3


@lru_cache(100_000)
def _org_word(token: str) -> str:
    t = fold(token)
    if t in _ORG:
        return _ORG[t]
    if len(t) >= 4:
        return next((n for n in _ORG_FULL if slips(t, n) == 1), "")
    return ""


def _clean(raw: str) -> str:
    try:
        fixed = raw.encode("cp1252").decode("utf-8")
        raw = fixed if any(ord(c) > 127 for c in raw) else raw
    except (UnicodeEncodeError, UnicodeDecodeError):
        try:
            raw = raw.encode("latin-1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    s = unicodedata.normalize("NFKC", raw)
    s = re.sub(r"<[^<>]*@[^<>]*>", " ", s)
    s = re.sub(r"\((?:external|extern|ext\.?|contractor|guest)\)", " ", s, flags=re.I)
    s = re.sub(r"(?<=[^\W\d_])0(?=[^\W\d_])", "o", s)
    s = re.sub(r"(?<=[^\W\d_])1(?=[^\W\d_])", "l", s)
    return s.strip(" \t\r\n;,")


def read_name(raw: str | None) -> dict:
    """kind (person, org or ''), name (family or own name in plain letters), given (names it may stand for), initial, org (initials of the
    kind's words), weak (only an initial or an ambiguous short form), other (what the name is in another order of the words: the first name of a
    person where nothing tells which of two is the family name, the sorted own words of an organisation; '' else). Null, empty and strings without letters give kind ''."""
    out = {"kind": "", "name": "", "given": [], "initial": "", "org": "", "weak": False, "other": ""}
    if not raw or not _WORD.search(raw):
        return out
    s = _clean(raw)
    login = re.fullmatch(r"(?:[\w.-]+\\)?([^\W\d_]+(?:[._-][^\W\d_]+)?)", s)
    if login and login[1] == login[1].lower():
        parts = re.split(r"[._-]", login[1])
        if len(parts) == 2:
            first, last = parts
            return out | {"kind": "person", "name": plain(last)} | ({"initial": fold(first), "weak": True} if len(first) == 1 else _as_given(first))
        return out | {"kind": "person", "name": plain(parts[0][1:]), "initial": fold(parts[0][0]), "weak": True}
    dash = re.split(r"\s+[-–|]\s+", s)
    if len(dash) > 1 and not any(_org_word(w) for w in _WORD.findall(dash[0])):
        s = dash[0]
    words = [w for w in re.findall(r"[^\W\d_]+\.?", s.replace("S.A.", "SA"))]
    kinds = [(w, _org_word(w.rstrip("."))) for w in words]
    acronym = [w for w in words if re.fullmatch(r"[A-Z]{2,4}", w) and fold(w) not in LEGAL + DEGREES + TITLES]
    shouted = s == s.upper()
    if any(k for _, k in kinds) and sum(bool(k) for _, k in kinds) >= (2 if "," in s and _WORD.fullmatch(s.split(",")[0]) else 1) or (acronym and not shouted and len(words) == 2 and "," not in s and words[1] in acronym):
        own = [plain(w.rstrip(".")) for w, k in kinds if not k and fold(w.rstrip(".")) not in LEGAL + ["the", "of", "and", "for"] and w not in acronym]
        kind = "".join(k[0] for _, k in kinds if k) or (acronym[0].lower() if acronym else "")
        return out | {"kind": "org", "name": "".join(own), "org": kind, "other": "".join(sorted(own)) if len(own) > 1 else ""}
    left, comma, right = s.partition(",")
    if comma and all(fold(w) in DEGREES for w in _WORD.findall(right)):
        left, comma, right = left, "", ""

    def tokens(x: str) -> list[str]:
        found = re.findall(r"[^\W\d_]+\.?", x)
        return [w for w in found if fold(w.rstrip(".")) not in DEGREES and not (fold(w.rstrip(".")) in TITLES and (len(w.rstrip(".")) > 1))]

    a, b = tokens(left), tokens(right)
    if comma and a and b:
        last, firsts = a[-1], b
    else:
        a = a or tokens(s)
        if len(a) == 1:
            cut = re.fullmatch(r"(.+?[^\W\d_A-Z])((?=[^a-z\d_\W])[^\W\d_].+)", a[0])
            if cut and cut[2][0].isupper():
                a = [cut[1], cut[2]]
        if not a:
            return out
        if len(a) == 1:
            return out | {"kind": "person", "name": plain(a[0].rstrip(".")), "weak": True}
        if len(a[0].rstrip(".")) == 1:
            last, firsts = a[-1], a[:1]
        elif len(a[-1].rstrip(".")) == 1:
            last, firsts = a[0], a[-1:]
        elif _given(a[-1])[1] < _given(a[0])[1]:
            last, firsts = a[0], a[1:][::-1]
        else:
            last, firsts = a[-1], a[:-1]
    first = next((f for f in firsts if len(f.rstrip(".")) > 1), firsts[0])
    out |= {"kind": "person", "name": plain(last.rstrip("."))}
    if not (comma and b) and len(a) == 2 and min(len(x.rstrip(".")) for x in a) > 1 and _given(a[0])[1] == _given(a[1])[1] == 3:
        out["other"] = plain(first.rstrip("."))
    if len(first.rstrip(".")) == 1:
        return out | {"initial": fold(first[0]), "weak": True}
    return out | _as_given(first)


def _as_given(first: str) -> dict:
    names, sure = _given(first)
    if not names:
        names = {fold(first.rstrip("."))}
    return {"given": sorted(names), "initial": fold(first)[0], "weak": len(names) > 1}


@lru_cache(100_000)
def short_form(x: str, y: str) -> bool:
    """Whether x is a short form of the given name y by rule: what is left of x without a fond ending, at least three letters of it (a doubled
    one may be single), begins y. For names that NICKNAMES tells about, only the table counts."""
    if len(x) >= len(y) or x in _KNOWN or y in _KNOWN:
        return False
    if len(x) >= 3 and y.startswith(x):
        return True
    stem = re.sub(r"(?:chen|ito|ita|ie|ey|y|i|o)$", "", x)
    once = stem[:-1] if len(stem) > 2 and stem[-1] == stem[-2] else stem
    y = y.replace("ph", "f")
    return stem != x and len(stem) >= 3 and (y.startswith(stem) or y.startswith(once) or (stem.endswith("ck") and y.startswith(stem[:-1])))


def _alike(x: str, y: str) -> bool:
    return (slips(x, y) <= 1 and jaro_winkler(x, y) >= 0.85) or fold(x) == fold(y)


def same_name(a, b) -> bool:
    """Whether two read names may be one person or organisation: own names alike but for one slip, given names compatible; or the same
    words in another order, where the order isn't told."""
    if a["kind"] != b["kind"]:
        return False
    if not _alike(a["name"], b["name"]):
        if a["kind"] == "person":
            ga, gb = list(a["given"]), list(b["given"])
            if not (a["other"] or b["other"]) or len(ga) != 1 or len(gb) != 1:
                return False
            return _alike(a["name"], gb[0]) and _alike(b["name"], ga[0]) and (fold(a["name"]) == fold(gb[0]) or fold(b["name"]) == fold(ga[0]))
        if not _alike(a["other"] or a["name"], b["other"] or b["name"]):
            return False
    if a["kind"] == "org":
        return not a["org"] or not b["org"] or a["org"] == b["org"]
    ga, gb = set(a["given"]), set(b["given"])
    if ga and gb:
        return bool(ga & gb) or (a["name"] == b["name"] and any(slips(x, y) <= 1 or jaro_winkler(x, y) >= 0.93 for x in ga for y in gb)) or shorter(a, b) != 0
    if not a["initial"] or not b["initial"]:
        return True
    return any(x[0] == b["initial"] for x in ga) if ga else any(y[0] == a["initial"] for y in gb) if gb else a["initial"] == b["initial"]


def shorter(a, b) -> int:
    """-1 if a's given name may be a short form of b's by rule, 1 if b's of a's, else 0."""
    pairs = [(x, y) for x in a["given"] for y in b["given"]]
    return -1 if any(short_form(x, y) for x, y in pairs) else int(any(short_form(y, x) for x, y in pairs))


_READ = T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("given", T.ArrayType(T.StringType())), T.StructField("initial", T.StringType()), T.StructField("org", T.StringType()), T.StructField("weak", T.BooleanType()), T.StructField("other", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType()))])


@F.pandas_udf(_READ)
def _read(raw: pd.Series) -> pd.DataFrame:
    rows = []
    for v in raw:
        r = read_name(v)
        n = r["name"]
        names = [x for x in dict.fromkeys([n, r["other"]]) if r["kind"] and n and x]
        r["keys"] = list(dict.fromkeys(k for n in names for k in [f"{r['kind']}/{phonetic(n)}", *(f"{r['kind']}:{x}" for x in {n, fold(n), *(n[:i] + n[i + 1 :] for i in range(len(n)))})]))
        rows.append(r)
    return pd.DataFrame(rows, columns=[f.name for f in _READ])


_SAME = T.StructType([T.StructField("same", T.BooleanType()), T.StructField("shorter", T.IntegerType())])


@F.pandas_udf(_SAME)
def _same(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    names = list(a.columns)
    same, short = [], []
    for x, y in zip(zip(*(a[c] for c in names)), zip(*(b[c] for c in names))):
        x, y = dict(zip(names, x)), dict(zip(names, y))
        same.append(same_name(x, y))
        short.append(shorter(x, y) if same[-1] and x["kind"] == "person" and not set(x["given"]) & set(y["given"]) else 0)
    return pd.DataFrame({"same": pd.Series(same, dtype=bool), "shorter": pd.Series(short, dtype="int32")})


def name_links(values: DataFrame, key: str = "value_id", scope: str = "index_name", name: str = "creator") -> DataFrame:
    """a < b: accepted pairs of keys within a scope, before clustering. Null names and scopes have no pairs. Each spelling is read once,
    into a written table; all joins are by shuffle, since sizes of read names aren't known beforehand."""
    scratch = Scratch(values.sparkSession, "names")
    rows = values.where(F.col(name).isNotNull() & F.col(scope).isNotNull()).select(F.col(key).alias("id"), F.col(scope).alias("s"), F.col(name).alias("n"))
    read = scratch.cut(spread(rows, "id").select("id", "s", _read(F.col("n")).alias("r"))).where("r.kind <> ''")
    ids = read.select("s", "id", F.explode("r.keys").alias("k"))
    pairs = ids.alias("x").join(ids.alias("y").hint("merge"), (F.col("x.s") == F.col("y.s")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    facts = read.select("id", F.col("r").dropFields("keys").alias("r"))
    both = pairs.join(facts.toDF("a", "ra").hint("merge"), "a").join(facts.toDF("b", "rb").hint("merge"), "b").withColumn("x", _same("ra", "rb")).where("x.same")
    links = both.select("a", "b", F.col("ra.given").alias("ga"), F.col("rb.given").alias("gb"), F.col("ra.weak").alias("wa"), F.col("rb.weak").alias("wb"), "x.shorter", F.col("ra.kind").alias("kind"))
    links = scratch.cut(links)
    # who has a short form of somebody's name is as little sure as who has an initial
    short = links.where("shorter <> 0").select(F.when(F.col("shorter") < 0, F.col("a")).otherwise(F.col("b")).alias("id")).distinct().withColumn("short", F.lit(True))
    for side in "ab":
        links = links.join(short.toDF(side, "short"), side, "left").withColumn(f"w{side}", F.col(f"w{side}") | F.coalesce("short", F.lit(False))).drop("short")
    sides = links.where("kind = 'person'").select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("wa").alias("w"), F.col("gb").alias("g"), F.col("wb").alias("v")), F.struct(F.col("b").alias("id"), F.col("wb").alias("w"), F.col("ga").alias("g"), F.col("wa").alias("v")))).alias("x")).select("x.*")
    doubtful = sides.where("w and not v and size(g) = 1").groupBy("id").agg(F.collect_set(F.col("g")[0]).alias("names"))
    differ = lambda x, y: (x != y) & ((F.levenshtein(x, y) > 2) | (F.least(F.length(x), F.length(y)) < 5))
    doubtful = scratch.cut(doubtful.where(F.exists("names", lambda x: F.exists("names", lambda y: differ(x, y)))).select("id"))
    firm = links.join(doubtful.withColumnRenamed("id", "a"), "a", "left_anti").join(doubtful.withColumnRenamed("id", "b"), "b", "left_anti")
    return firm.select("a", "b")


def same_entities(values: DataFrame, key: str = "value_id", scope: str = "index_name", name: str = "creator") -> DataFrame:
    """key, entity (the smallest key of its entity) for every key that is linked with another."""
    return components(name_links(values, key, scope, name)).select(F.col("node").alias(key), F.col("component").alias("entity"))


def entity_pairs(values: DataFrame, key: str = "value_id", scope: str = "index_name", name: str = "creator") -> DataFrame:
    """a < b: all pairs of keys in one scope that name one entity."""
    e = same_entities(values, key, scope, name)
    x, y = e.select(F.col(key).alias("a"), "entity"), e.select(F.col(key).alias("b"), "entity")
    return x.join(y, "entity").where("a < b").select("a", "b")
