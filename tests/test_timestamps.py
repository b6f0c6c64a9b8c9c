"""Dates of any form against datetime and zoneinfo."""

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from docuplane.operators import timestamps as T


def ms(*a, zone="UTC", fold=0):
    return int(datetime(*a, tzinfo=ZoneInfo(zone), fold=fold).timestamp() * 1000)


CASES = [
    ("2020-01-02T03:04:05Z", "Europe/Berlin", "dmy", ms(2020, 1, 2, 3, 4, 5)),
    ("  2020-01-02T03:04:05+02:00 ", "UTC", "dmy", ms(2020, 1, 2, 1, 4, 5)),
    ("2020-01-02T03:04:05.6789Z", "UTC", "dmy", ms(2020, 1, 2, 3, 4, 5) + 678),
    ("2020-07-02 03:04:05", "Europe/Berlin", "dmy", ms(2020, 7, 2, 1, 4, 5)),
    ("2020:07:02 03:04:05", "Asia/Kathmandu", "dmy", ms(2020, 7, 2, 3, 4, 5, zone="Asia/Kathmandu")),
    ("03/04/2020 05:06", "UTC", "dmy", ms(2020, 4, 3, 5, 6)),
    ("03/04/2020 05:06", "UTC", "mdy", ms(2020, 3, 4, 5, 6)),
    ("3/4/20 5:06 PM", "UTC", "mdy", ms(2020, 3, 4, 17, 6)),
    ("12/4/20 12:06am", "UTC", "mdy", ms(2020, 12, 4, 0, 6)),
    ("2020/3/4 5:06 pm", "UTC", "ymd", ms(2020, 3, 4, 17, 6)),
    ("02.07.2020 07:40", "Europe/Berlin", "dmy", ms(2020, 7, 2, 5, 40)),
    ("1531327529014", "UTC", "dmy", 1531327529014),
    ("1531327529", "UTC", "dmy", 1531327529000),
    ("130871425328920000", "UTC", "dmy", 130871425328920000 // 10000 - 11644473600000),
    ("Wed, 21 Nov 2018 13:54:53 +0530", "UTC", "dmy", ms(2018, 11, 21, 8, 24, 53)),
    ("Sat, 06 Oct 2018 10:09:23 -0500 (CDT)", "UTC", "dmy", ms(2018, 10, 6, 15, 9, 23)),
    ("Wednesday, 01-Dec-21 08:29:04 GMT", "Europe/Berlin", "dmy", ms(2021, 12, 1, 8, 29, 4)),
    ("Mon Mar 28 13:54:06 UTC 2011", "Europe/Berlin", "dmy", ms(2011, 3, 28, 13, 54, 6)),
    ("Sat Aug 29 08:35:36 CEST 2020", "UTC", "dmy", ms(2020, 8, 29, 6, 35, 36)),
    ("2013-08-12 00:23:55 EDT", "UTC", "dmy", ms(2013, 8, 12, 4, 23, 55)),
    ("2012-06-01 07:21:23 Europe/Madrid", "UTC", "dmy", ms(2012, 6, 1, 5, 21, 23)),
    ("2011-06-22T16:39:36+02:00[Europe/Berlin]", "UTC", "dmy", ms(2011, 6, 22, 14, 39, 36)),
    ("D:20131003105758+03'00'", "UTC", "dmy", ms(2013, 10, 3, 7, 57, 58)),
    ("D:20131003105758-03'30", "UTC", "dmy", ms(2013, 10, 3, 14, 27, 58)),
    ("D:20131003105758", "Asia/Tokyo", "dmy", ms(2013, 10, 3, 1, 57, 58)),
    ("20150225T032151Z", "Asia/Tokyo", "dmy", ms(2015, 2, 25, 3, 21, 51)),
    ("25 January 2017 17:47", "America/New_York", "mdy", ms(2017, 1, 25, 22, 47)),
    ("19 Feb 2011 14:56 +0545", "UTC", "dmy", ms(2011, 2, 19, 9, 11)),
    ("August 24, 2022 5:13 AM", "UTC", "mdy", ms(2022, 8, 24, 5, 13)),
    ("31. Dezember 2022, 19:51 Uhr", "Europe/Berlin", "dmy", ms(2022, 12, 31, 18, 51)),
    ("22 août 2014 à 21h44", "Europe/Paris", "dmy", ms(2014, 8, 22, 19, 44)),
    ("22 de junio de 2024, 08:23 h", "Europe/Madrid", "dmy", ms(2024, 6, 22, 6, 23)),
    # an hour that comes twice is the earlier, one that is skipped moves on
    ("2021-10-31 02:30:00", "Europe/Berlin", "dmy", ms(2021, 10, 31, 0, 30)),
    ("2021-03-28 02:30:00", "Europe/Berlin", "dmy", ms(2021, 3, 28, 1, 30)),
    ("2022-11-06 01:30:00", "America/New_York", "mdy", ms(2022, 11, 6, 5, 30)),
    # no instants
    *[(v, "UTC", "dmy", None) for v in ("2020-01-02", "2020", "02.07.2020", "20200102", "2019-13-04 08:00:00", "2018-04-31 12:30:00", "31/31/2017 10:15", "2016-06-07T25:10:00Z", "0000-00-00 00:00:00", "heute", "", "--", None, "2020-01-02 03:04:05 XYZ", "13:05 pm", "13/01/2020 13:05 pm")],
    ("2020-07-02 03:04:05", None, "dmy", None),
]


def test_forms(spark):
    df = spark.createDataFrame([(i, v, z, o) for i, (v, z, o, _) in enumerate(CASES)], "i int, v string, z string, o string")
    got = {r.i: r.instant_ms for r in T.with_instant(df, "v", "z", "o").collect()}
    assert [(c, got[i]) for i, c in enumerate(CASES) if got[i] != c[3]] == []


SCHEMA = "row_id bigint, index_name string, created string, modified string, created_year bigint, indexed_at timestamp, __y string, home_zone string"


def test_repairs(spark):
    at = datetime(2024, 1, 1)
    rows = [
        (1, "a", "2020-01-01T00:30:00+02:00", "2020-01-01T00:00:00Z", 2020, at, "x", "y"),
        (2, "a", None, "", None, at, None, None),
        (3, "a", "2020-05-01T00:00:00Z", "n/a", None, at, None, None),
        (3, "a", "2020-05-01T00:00:00Z", "n/a", None, at, None, None),
    ]
    prof = spark.createDataFrame([("a", "en", "Europe/Berlin", "dmy")], "index_name string, main_lang string, home_zone string, date_order string")
    got = sorted(map(tuple, T.date_repairs(spark.createDataFrame(rows, SCHEMA), prof).collect()))
    assert got == [(1, "created", ms(2019, 12, 31, 22, 30)), (1, "created_year", 2019), (3, "created_year", 2020), (3, "created_year", 2020)]
    assert T.date_repairs(spark.createDataFrame([], SCHEMA), prof).count() == 0
    kept = T.normalise_dates(spark.createDataFrame(rows, SCHEMA).withColumn("created_ms", F.lit("clash")), prof)
    assert set(SCHEMA.replace(",", "").split()[::2]) <= set(kept.columns) and kept.count() == 4


def test_zone_is_estimated(spark):
    """Held-out: the zones of indices whose profile is taken away, from what their rows carry."""
    rows = []
    for name, zone in (("b", "Europe/Berlin"), ("n", "America/New_York"), ("k", "Asia/Kolkata")):
        for m in range(1, 13):
            off = datetime(2021, m, 3, 12, tzinfo=ZoneInfo(zone)).strftime("%z")
            rows.append((m, name, f"2021-{m:02d}-03T12:00:00{off[:3]}:{off[3:]}", f"2021-{m:02d}-03 13:00:00", None, datetime(2024, 1, 1, tzinfo=timezone.utc), None, None))
    docs = spark.createDataFrame(rows, SCHEMA)
    zones = spark.createDataFrame([(z,) for z in ("Europe/Berlin", "America/New_York", "Asia/Kolkata", "UTC", "Europe/London")], "zone string")
    got = {r.index_name: (r.home_zone, r.violations) for r in T.estimate_zones(docs, zones).collect()}
    assert got == {"b": ("Europe/Berlin", 0), "n": ("America/New_York", 0), "k": ("Asia/Kolkata", 0)}
    prof = spark.createDataFrame([("b", None, "dmy"), ("x", "Europe/Berlin", "dmy"), ("y", "UTC", "dmy")], "index_name string, home_zone string, date_order string")
    fixed = {r.row_id: r.fixed_value for r in T.date_repairs(docs.where("index_name = 'b'"), prof).where("field_name = 'modified'").collect()}
    assert fixed[7] == ms(2021, 7, 3, 11, 0)


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York"])
def test_every_hour_of_a_change(spark, zone):
    rows = [(h, f"2021-{m}-{d:02d} {h % 24:02d}:30:00", zone, "dmy") for m, d in (("03", 14), ("03", 28), ("10", 31), ("11", 7)) for h in range(6)]
    for r in T.with_instant(spark.createDataFrame(rows, "i int, v string, z string, o string"), "v", "z", "o").collect():
        assert r.instant_ms == int(datetime.fromisoformat(r.v).replace(tzinfo=ZoneInfo(zone), fold=0).timestamp() * 1000)
