"""Mixed timestamp formats and time zones brought to one UTC instant.

All of it is Catalyst expressions: a value is rewritten by the first pattern that fits into
``year|month|day|hour|minute|second|fraction|am/pm|zone`` and built into an instant once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docuplane.session import Scratch, bounded_broadcast, small_enough

# Month names of English, German, French and Spanish dates, by month.
MONTH_NAMES = {
    1: "jan january januar jänner janvier enero",
    2: "feb february februar février fevrier febrero",
    3: "mar march märz maerz mars marzo",
    4: "apr april avril abril",
    5: "may mai mayo",
    6: "jun june juni juin junio",
    7: "jul july juli juillet julio",
    8: "aug august août aout agosto",
    9: "sep sept september septembre septiembre",
    10: "oct october oktober octobre octubre",
    11: "nov november novembre noviembre",
    12: "dec december dezember décembre decembre diciembre",
}

# Zone abbreviations and their offsets.
ZONE_ABBREVIATIONS = {
    "Z": "+00:00", "UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "WET": "+00:00", "WEST": "+01:00", "BST": "+01:00",
    "CET": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00", "SAST": "+02:00",
    "IST": "+05:30", "NPT": "+05:45", "PKT": "+05:00", "SGT": "+08:00", "HKT": "+08:00", "AWST": "+08:00",
    "JST": "+09:00", "KST": "+09:00", "ACST": "+09:30", "ACDT": "+10:30", "AEST": "+10:00", "AEDT": "+11:00",
    "NZST": "+12:00", "NZDT": "+13:00", "NST": "-03:30", "NDT": "-02:30", "AST": "-04:00", "ADT": "-03:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00",
    "PST": "-08:00", "PDT": "-07:00", "AKST": "-09:00", "AKDT": "-08:00", "HST": "-10:00",
}

_T = r"(\d{1,2}):(\d\d)(?::(\d\d))?(?:[.,](\d+))?"
_Z = r"(Z|z|[+-]\d\d:?\d\d|[+-]\d\d|[A-Za-z]{2,5}|[A-Za-z]+/[A-Za-z_]+(?:/[A-Za-z_]+)?)?"
_W = r"(?:[A-Za-z]{3,9},?\s+)?"
#: pattern, replacement. `N` stands for the numeric date, whose order is the index's. Names of months become numbers later.
_PATTERNS = [
    # ISO 8601 and its relatives; a zone in brackets only repeats the offset
    (rf"^(\d{{4}})[-:](\d\d)[-:](\d\d)[Tt ]\s*{_T}\s*{_Z}(?:\[[^\]]*\])?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    # basic ISO
    (r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)?(?:[.,](\d+))?(Z|[+-]\d\d:?\d\d)?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    # PDF
    (r"^D:(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)?(Z|[+-]\d\d)?(?:'(\d\d)'?)?$", "$1|$2|$3|$4|$5|$6|||$7$8"),
    (r"^D:(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)?Z(?:'?00'?(?:00'?)?)?$", "$1|$2|$3|$4|$5|$6|||Z"),
    # mail headers and other English dates with the day first, the zone repeated in a comment
    (rf"^{_W}(\d{{1,2}})[ -]([A-Za-z]{{3,9}})\.?[ -](\d{{4}}|\d\d),?\s+{_T}\s*{_Z}(?:\s*\([^)]*\))?$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    # C's ctime
    (r"^[A-Za-z]{3,9}\s+([A-Za-z]{3,9})\s+(\d{1,2})\s+(\d{1,2}):(\d\d):(\d\d)\s+(?:([A-Za-z]{2,5}|[+-]\d{4})\s+)?(\d{4})$", "$7|$1|$2|$3|$4|$5|||$6"),
    # English, month first
    (r"^([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4}),?\s+(\d{1,2}):(\d\d)(?::(\d\d))?\s*([AaPp])\.?[Mm]\.?$", "$3|$1|$2|$4|$5|$6||$7|"),
    (r"^([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4}),?\s+(\d{1,2}):(\d\d)(?::(\d\d))?$", "$3|$1|$2|$4|$5|$6|||"),
    # German, French, Spanish
    (r"^(\d{1,2})\.\s*([^\W\d_]+)\s+(\d{4}),?\s+(\d{1,2}):(\d\d)(?::(\d\d))?(?:\s*Uhr)?$", "$3|$2|$1|$4|$5|$6|||"),
    (r"^(\d{1,2})(?:er)?\s+([^\W\d_]+)\s+(\d{4})\s+à\s+(\d{1,2})\s*[h:]\s*(\d\d)$", "$3|$2|$1|$4|$5||||"),
    (r"^(\d{1,2})\s+de\s+([^\W\d_]+)\s+de\s+(\d{4}),?\s+(\d{1,2}):(\d\d)(?::(\d\d))?(?:\s*h)?$", "$3|$2|$1|$4|$5|$6|||"),
    # numeric
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2}),?\s+(\d{1,2}):(\d\d)(?::(\d\d))?\s*(?:([AaPp])\.?[Mm]\.?)?$", "$1|$2|$3|$4|$5|$6||$7|"),
    (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d\d),?\s+(\d{1,2}):(\d\d)(?::(\d\d))?\s*(?:([AaPp])\.?[Mm]\.?)?$", "N$3|$1|$2|$4|$5|$6||$7|"),
]

_CANONICAL = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"


def _tidy(raw: Column) -> Column:
    """Outer blanks off, any blank inside (no-break, narrow) a plain one."""
    return F.trim(F.regexp_replace(raw, r"(?U)[\s\x{FEFF}\x{200B}]+", " "))


def _pieces(v: Column) -> Column:
    """The rewritten value of the first pattern that fits, else null."""
    c = F.lit(None).cast("string")
    for rx, to in reversed(_PATTERNS):
        rx = f"(?U){rx}".replace(r"\d", "[0-9]")
        c = F.when(v.rlike(rx), F.regexp_replace(v, rx, to)).otherwise(c)
    return c


def _month(text: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, words in MONTH_NAMES.items() for w in words.split() for x in (w, str(k))])
    return F.when(text.rlike("^[0-9]+$"), text).otherwise(F.try_element_at(names, F.lower(text))).try_cast("int")


def _zone(text: Column, home: Column) -> Column:
    """A zone that make_timestamp takes; null for an unknown abbreviation."""
    digits = F.regexp_replace(text, "[^0-9+-]", "")
    abbreviations = F.create_map(*[F.lit(x) for kv in ZONE_ABBREVIATIONS.items() for x in kv])
    return (
        F.when((text == "") | text.isNull(), home)
        .when(text.rlike(r"^[+-]\d\d$"), F.concat(text, F.lit(":00")))
        .when(text.rlike(r"^[+-]\d\d:?\d\d$"), F.concat(F.substring(digits, 1, 3), F.lit(":"), F.substring(digits, 4, 2)))
        .when(text.contains("/"), text)
        .otherwise(F.try_element_at(abbreviations, F.upper(text)))
    )


def _free(df: DataFrame) -> str:
    """A prefix that no column of df has."""
    tag = "__at_"
    while any(c.startswith(tag) for c in df.columns):
        tag += "_"
    return tag


def with_instant(df: DataFrame, value: str, home_zone: str, date_order: str, out: str = "instant_ms", zone_out: str | None = None) -> DataFrame:
    """Add `out`: epoch milliseconds (BIGINT) of the instant that the string column `value` denotes, else null; and `zone_out`, if it's
    named: the zone the value itself carries (`Z` for UTC by name and counts of seconds), null for a value without zone.

    A value without zone is local to the column `home_zone`; numeric dates follow the column `date_order` (dmy, mdy, ymd; null
    counts as dmy). Years of two digits are 1969-2068. A clock time that occurs twice is the earlier instant, a skipped one moves
    on by the gap. Null for null, empty, nonsense, impossible dates, unknown zones, values without time of day and values without
    zone whose home_zone is null. 10 digits are Unix seconds, 13 milliseconds, 18 ticks of 100 ns since 1601. Other columns stay as
    they are, whatever their names.
    """
    tag = _free(df)
    v, y, m, d, h, i, s, f, a, z = (F.col(tag + c) for c in "vymdhisfaz")
    df = df.withColumn(tag + "v", _tidy(F.col(value)))
    df = df.withColumn(tag + "p", F.split(_pieces(v), r"\|"))
    p = [F.try_element_at(tag + "p", F.lit(n + 1)) for n in range(9)]
    numeric = p[0].startswith("N")
    year = F.regexp_replace(p[0], "^N", "")
    swap = numeric & (F.coalesce(F.col(date_order), F.lit("dmy")) != "mdy")
    df = df.withColumns({
        tag + "y": F.when(F.length(year) == 2, year.try_cast("int") + F.when(year.try_cast("int") < 69, 2000).otherwise(1900)).otherwise(year.try_cast("int")),
        tag + "m": F.when(swap, p[2].try_cast("int")).otherwise(_month(p[1])),
        tag + "d": F.when(swap, p[1].try_cast("int")).otherwise(p[2].try_cast("int")),
        tag + "h": p[3].try_cast("int"),
        tag + "i": p[4].try_cast("int"),
        tag + "s": F.coalesce(p[5].try_cast("int"), F.lit(0)),
        tag + "f": F.coalesce(F.substring(F.concat(p[6], F.lit("000")), 1, 3).try_cast("int"), F.lit(0)),
        tag + "a": F.lower(p[7]),
        tag + "z": _zone(p[8], F.col(home_zone)),
    })
    half = a.isin("a", "p")
    df = df.withColumn(tag + "h", F.when(half & ~h.between(1, 12), None).when(half, h % 12 + F.when(a == "p", 12).otherwise(0)).otherwise(h))
    fits = h.between(0, 23) & i.between(0, 59) & s.between(0, 59) & z.isNotNull() & y.between(1, 9999)
    whole = F.when(fits, F.try_make_timestamp(y, m, d, h, i, s.cast("decimal(8,6)"), z))
    number = v.try_cast("bigint")
    ms = (
        F.when(v.rlike(r"^[0-9]{10}$"), number * 1000)
        .when(v.rlike(r"^[0-9]{13}$"), number)
        .when(v.rlike(r"^[0-9]{18}$"), F.expr(f"(try_cast({tag}v as bigint) - 116444736000000000L) div 10000"))
        .otherwise(F.unix_millis(whole) + f)
    )
    if zone_out:
        own = F.when(v.rlike(r"^[0-9]+$") | F.upper(p[8]).isin("Z", "UT", "UTC", "GMT"), F.lit("Z")).otherwise(_zone(F.nullif(p[8], F.lit("")), F.lit(None).cast("string")))
        df = df.withColumn(zone_out, own)
    return df.withColumn(out, ms).drop(*[tag + c for c in "vpymdhisfaz"])


#: Zones are compared by their offsets in every month of these years.
HISTORY_YEARS = (1990, 2040)
#: How much of an index's evidence must speak against its declared zone, more than against the best one, to overrule it.
OVERRULE = 0.5
#: Zones so close to the best, as a share of the tests, are no worse than it: evidence is told apart by weeks.
EQUAL = 0.02
_ZONE_NAME = "^[A-Za-z]+(/[A-Za-z0-9_+-]+)*$"
#: Farther from the bound than any offset can carry it, a clock time is no evidence.
_REACH = 26 * 60


def _offset(at: Column, zone: Column) -> Column:
    """Minutes that a zone is ahead of UTC at an instant."""
    return F.floor((F.unix_seconds(F.from_utc_timestamp(at, zone)) - F.unix_seconds(at)) / 60).cast("int")


def offset_histories(spark: SparkSession, first: DataFrame | None = None) -> DataFrame:
    """zone, liked: one IANA zone for each history of offsets in HISTORY_YEARS; of several with the same, one of `first` (zone), then
    the first by name. liked: 0 for a zone of `first`, else 1. Their number is that of the world's clocks, some hundreds, and doesn't
    grow with the data."""
    names = sorted(str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    names = [z for z in names if "/" in z and not z.startswith(("Etc/", "SystemV/")) or z == "UTC"]
    liked = {r.zone for r in first.select("zone").distinct().limit(10_000).collect()} & set(names) if first is not None else set()
    zones = spark.createDataFrame([(z, int(z not in liked)) for z in names], "zone string, liked int")
    months = F.sequence(F.lit(f"{HISTORY_YEARS[0]}-01-10 12:00:00").cast("timestamp"), F.lit(f"{HISTORY_YEARS[1]}-01-10 12:00:00").cast("timestamp"), F.expr("interval 1 month"))
    history = F.xxhash64(F.transform(months, lambda t: _offset(t, F.col("zone"))))
    found = zones.groupBy(history.alias("history")).agg(F.min(F.struct("liked", "zone")).alias("x")).select("x.zone", "x.liked").collect()
    return spark.createDataFrame(sorted(map(tuple, found)), "zone string, liked int")


def zone_evidence(rows: DataFrame, date_order: str | None = None) -> DataFrame:
    """What the rows of an index tell about its zone, summed: index_name, kind, month, week (of the month, from 0), minutes, n.

    rows: index_name, created, modified, indexed_at and the column named by date_order. kind `is`: n values of that week carry
    the offset `minutes` themselves, which people's tools mostly take from their own zone. `above` and `below`: n clock times without
    zone keep the order of events (created, then modified, both before the ingestion) only with an offset of at least or at most
    `minutes`; kept where it's within a day of being broken. Counts are summed before the shuffle; months and minutes (in steps
    of 15, as offsets are) are bounded by the calendar, not by the rows.
    """
    tag = _free(rows)
    order, utc = f"{tag}order", f"{tag}utc"
    df = rows.withColumn(utc, F.lit("UTC")).withColumn(order, F.col(date_order) if date_order else F.lit("dmy"))
    for side in ("created", "modified"):
        df = with_instant(df, side, utc, order, f"{tag}{side}", f"{tag}{side}_zone")
    at, zone = (lambda side: F.col(f"{tag}{side}")), (lambda side: F.col(f"{tag}{side}_zone"))
    none = F.lit(None).cast("struct<kind:string,at:bigint,minutes:int>")

    def fact(kind: str, when: Column, ms: Column, minutes: Column) -> Column:
        return F.when(when & minutes.between(-_REACH, _REACH), F.struct(F.lit(kind).alias("kind"), ms.alias("at"), minutes.cast("int").alias("minutes"))).otherwise(none)

    def between(a: Column, b: Column, kind: str) -> Column:
        quarters = (a - b) / 900_000
        return (F.ceil(quarters) if kind == "above" else F.floor(quarters)) * 15

    facts = []
    for side in ("created", "modified"):
        digits = F.regexp_replace(zone(side), "[^0-9]", "")
        minutes = F.when(zone(side).startswith("-"), -1).otherwise(1) * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))
        facts.append(fact("is", at(side).isNotNull() & zone(side).rlike("^[+-]"), at(side), minutes))
        local = at(side).isNotNull() & zone(side).isNull()
        # a clock time reads too late by the offset, which must bring it before the ingestion
        facts.append(fact("above", local, at(side), between(at(side), F.unix_millis("indexed_at"), "above")))
        kind, other = ("above", "modified") if side == "created" else ("below", "created")
        firm = local & at(other).isNotNull() & zone(other).isNotNull()
        facts.append(fact(kind, firm, at(side), between(at(side), at(other), kind)))
    told = df.select("index_name", F.explode(F.filter(F.array(*facts), lambda x: x.isNotNull())).alias("x"))
    day = F.timestamp_millis("x.at")
    return told.groupBy("index_name", "x.kind", F.trunc(day, "month").alias("month"), F.floor((F.dayofmonth(day) - 1) / 7).cast("int").alias("week"), "x.minutes").agg(F.count("*").alias("n"))


def estimate_zones(rows: DataFrame, candidates: DataFrame | None = None, date_order: str | None = None, declared: DataFrame | None = None) -> DataFrame:
    """Choose for each index the offset history (IANA zone) that its own rows violate least.

    rows as in zone_evidence(); candidates: zone (at most 10,000), by default offset_histories(). Returns index_name, home_zone,
    violations, tests: of the zones within EQUAL of the least violations the first by the column `liked` of the candidates, if they
    have one, then by violations, then by name. declared (index_name, home_zone): a zone that is known; it is a candidate too and stays unless violated in more than OVERRULE of the tests
    beyond the best. Zones meet the summed evidence, never the rows: its weeks get the distinct offsets there are, and the
    zones then the sums of their offsets. An index without evidence has its declared zone, else no row. Empty rows give an
    empty result.
    """
    told = zone_evidence(rows, date_order)
    if candidates is None:
        candidates = offset_histories(rows.sparkSession, None if declared is None else declared.select(F.col("home_zone").alias("zone")))
    known = rows.sparkSession.createDataFrame([], "index_name string, home_zone string") if declared is None else declared.where("index_name is not null and home_zone is not null").select("index_name", "home_zone")
    every = candidates.select("zone", F.col("liked") if "liked" in candidates.columns else F.lit(1).alias("liked")).unionByName(known.select(F.col("home_zone").alias("zone"), F.lit(0).alias("liked")))
    zones = every.where("zone is not null").groupBy("zone").agg(F.min("liked").alias("liked")).limit(10_001).collect()
    if len(zones) > 10_000:
        raise ValueError("more than 10000 candidate zones")
    told = told.where("month is not null")
    listed = F.array(*[F.struct(F.lit(z.zone).alias("zone"), F.lit(z.liked).alias("liked")) for z in zones]) if zones else F.array().cast("array<struct<zone:string,liked:int>>")
    begin = F.date_add("month", F.col("week") * 7).cast("timestamp")
    clocks = told.select("month", "week").distinct().withColumn("z", F.explode(listed)).select("month", "week", "z.zone", "z.liked", _offset(begin, F.col("z.zone")).alias("offset"))
    seen = clocks.select("month", "week", "offset").distinct()
    wrong = F.when(F.col("kind") == "is", F.col("offset") != F.col("minutes")).when(F.col("kind") == "above", F.col("offset") < F.col("minutes")).otherwise(F.col("offset") > F.col("minutes"))
    broken = told.join(seen, ["month", "week"]).groupBy("index_name", "month", "week", "offset").agg(F.sum(F.when(wrong, F.col("n")).otherwise(0)).alias("v"), F.sum("n").alias("t"))
    scored = broken.join(clocks, ["month", "week", "offset"]).groupBy("index_name", "zone", "liked").agg(F.sum("v").alias("violations"), F.sum("t").alias("tests"))
    scored = scored.join(known.select("index_name", F.col("home_zone").alias("zone"), F.lit(1).alias("known")), ["index_name", "zone"], "full")
    of = lambda c: F.coalesce(c, F.lit(0))
    scored = scored.select("index_name", "zone", "liked", of("violations").alias("violations"), of("tests").alias("tests"), of("known").alias("known"))
    scored = scored.withColumn("cost", F.col("violations") - F.col("known") * OVERRULE * F.col("tests"))
    scored = scored.withColumn("far", F.col("cost") > F.min("cost").over(Window.partitionBy("index_name")) + EQUAL * F.col("tests"))
    best = F.min_by(F.struct("zone", "violations", "tests"), F.struct("far", -F.col("known"), "liked", "violations", "zone"))
    return scored.groupBy("index_name").agg(best.alias("x")).select("index_name", F.col("x.zone").alias("home_zone"), "x.violations", "x.tests")


def normalise_dates(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """created and modified of docs as UTC instants: adds created_ms, modified_ms (BIGINT) and created_utc_year (BIGINT).

    docs: index_name, created, modified and any others, which stay; profiles: index_name (unique), home_zone, date_order. The zone of
    every index is estimated from its rows (estimate_zones, needs indexed_at), with the home_zone of its profile as the declared
    one; without indexed_at only declared zones count. Null and nonsense give null; an empty table gives an empty one.
    """
    keep = [c for c in docs.columns if c not in ("created_ms", "modified_ms", "created_utc_year")]
    docs = docs.select(*keep)
    home, order = (f"{_free(docs)}{c}" for c in ("home", "order"))
    p = profiles.where("index_name is not null").groupBy("index_name").agg(F.min("home_zone").alias(home), F.min("date_order").alias(order))
    p = p.withColumn(home, F.when(F.col(home).rlike(_ZONE_NAME), F.col(home)))
    if "indexed_at" in docs.columns:
        orders = bounded_broadcast(p.select("index_name", order), 10_000)
        rows = docs.select("index_name", "created", "modified", "indexed_at").where("index_name is not null").join(orders, "index_name", "left")
        zones = Scratch(docs.sparkSession, "zones").cut(estimate_zones(rows, date_order=order, declared=p.select("index_name", F.col(home).alias("home_zone"))))
        p = p.drop(home).join(zones.select("index_name", F.col("home_zone").alias(home)), "index_name", "full")
    df = docs.join(bounded_broadcast(p, 10_000), "index_name", "left")
    df = with_instant(with_instant(df, "created", home, order, "created_ms"), "modified", home, order, "modified_ms")
    return df.withColumn("created_utc_year", F.year(F.timestamp_millis("created_ms")).cast("bigint")).drop(home, order)


def date_repairs(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """What of created, modified and created_year must be rewritten: row_id, field_name, fixed_value.

    One row per field: a date that denotes an instant but isn't written YYYY-MM-DDTHH:MM:SSZ (fixed_value = epoch ms), and a
    created_year that is null or not the UTC year of an instant in created (fixed_value = that year). Repeated row_id give a row
    each; nulls, nonsense and empty tables none.
    """
    need = ["row_id", "index_name", "created", "modified", "created_year"] + [c for c in ("indexed_at",) if c in docs.columns]
    df = normalise_dates(docs.select(*need), profiles)

    def case(name: str, value: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("field_name"), F.col(value).cast("bigint").alias("fixed_value")))

    found = F.array(
        case("created", "created_ms", F.col("created_ms").isNotNull() & ~F.col("created").rlike(_CANONICAL)),
        case("modified", "modified_ms", F.col("modified_ms").isNotNull() & ~F.col("modified").rlike(_CANONICAL)),
        case("created_year", "created_utc_year", F.col("created_utc_year").isNotNull() & ~F.col("created_year").eqNullSafe(F.col("created_utc_year"))),
    )
    return df.select("row_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("row_id", "x.field_name", "x.fixed_value")
