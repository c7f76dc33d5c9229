"""Problem 1 against zoneinfo and known instants."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from auralake.operators.timestamps import dated_rows, extend_dictionary, normalise_timestamps, parse_instants

SCHEMA = "raw string, zone string"


def parse(spark, rows):
    df = parse_instants(spark.createDataFrame(rows, SCHEMA))
    return {(r.raw, r.zone): r.utc_second for r in df.collect()}


def at(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp())


KNOWN = [
    ("2020-01-02T03:04:05Z", None, at(2020, 1, 2, 3, 4, 5)), ("2020-01-02T03:04:05.999z", None, at(2020, 1, 2, 3, 4, 5)), ("20200102T030405Z", None, at(2020, 1, 2, 3, 4, 5)),
    ("20200102030405", "UTC", at(2020, 1, 2, 3, 4, 5)), ("2020-01-02", "Asia/Tokyo", at(2020, 1, 1, 15)), ("1577934245", None, 1577934245), ("1577934245999", "Asia/Tokyo", 1577934245),
    ("Thu, 02 Jan 2020 03:04:05 +0530", None, at(2020, 1, 1, 21, 34, 5)), ("2 Jan 20 03:04 EST", None, at(2020, 1, 2, 8, 4)), ("Thu Jan 02 03:04:05 2020", "UTC", at(2020, 1, 2, 3, 4, 5)),
    ("January 2, 2020 3:04 PM CST", None, at(2020, 1, 2, 21, 4)), ("1/2/2020 12:04 AM", "UTC", at(2020, 1, 2, 0, 4)), ("1/2/2020 12:04 pm", "UTC", at(2020, 1, 2, 12, 4)), ("02.01.2020 03:04", "UTC", at(2020, 1, 2, 3, 4)),
    ("2020-07-02 03:04:05 BST", None, at(2020, 7, 2, 2, 4, 5)), ("2020-01-02 03:04:05 UTC-05:00", None, at(2020, 1, 2, 8, 4, 5)), ("2020-01-02T03:04:05[Europe/Paris]", "UTC", at(2020, 1, 2, 2, 4, 5)),
    ("2020-01-02 03:04:05 America/New_York", "UTC", at(2020, 1, 2, 8, 4, 5)), ("2020-01-02T03:04:05+01:00[Europe/Berlin]", None, at(2020, 1, 2, 2, 4, 5)), (" 2020-01-02 03:04:05\n", "UTC", at(2020, 1, 2, 3, 4, 5)),
    ("17 September 2025", "UTC", at(2025, 9, 17)), ("2020-01-02 03:04:05 AM EDT", None, at(2020, 1, 2, 7, 4, 5)),
    # twice: the earlier; skipped: the offset before the change
    ("2021-11-07 01:30:00", "America/New_York", at(2021, 11, 7, 5, 30)), ("2021-03-14 02:30:00", "America/New_York", at(2021, 3, 14, 7, 30)), ("2021-03-28 02:30:00", "Europe/Berlin", at(2021, 3, 28, 1, 30)),
    ("2020-01-02 03:04:05", "No/Where", at(2020, 1, 2, 3, 4, 5)), ("2020-01-02 03:04:05", None, at(2020, 1, 2, 3, 4, 5)),
]
NONE = ["", "  ", "-", "n/a", "yesterday", "20:15", "2021-13-04", "0000-00-00 00:00:00", "2021-02-29", "Sun, 31 Nov 2015 08:00:00 GMT", "25/25/2016 11:00 AM", "2020-01-02 24:00:00", "2020-01-02 10:60:00", "1/2/2020 13:04 PM", "2020-01-02 03:04:05 XYZ", "2020-01-02 03:04:05 +99:00", "x" * 100_000]


def test_known(spark):
    got = parse(spark, [(r, z) for r, z, _ in KNOWN] + [(r, "UTC") for r in NONE] + [(None, "UTC")])
    for r, z, want in KNOWN:
        assert got[r, z] == want, r
    assert all(got[r, "UTC"] is None for r in NONE) and got[None, "UTC"] is None


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Australia/Sydney", "Asia/Kolkata"])
def test_zones_against_zoneinfo(spark, zone):
    z, t, rows, want = ZoneInfo(zone), datetime(2018, 1, 1, 0, 17, 3), [], {}
    while t.year < 2022:
        s = t.strftime("%Y-%m-%d %H:%M:%S")
        rows.append((s, zone))
        want[s, zone] = int(t.replace(tzinfo=z, fold=0).timestamp())  # fold 0: the earlier, and the offset before the change
        t += timedelta(hours=5, minutes=1)
    assert parse(spark, rows) == want


def test_dictionary_grows(spark, tmp_path):
    store = "file://" + str(tmp_path / "store")
    first = spark.createDataFrame([("2020-01-02", "UTC"), ("2020-01-02", "UTC"), (None, "UTC")], SCHEMA)
    assert extend_dictionary(first, store).count() == 1
    more = spark.createDataFrame([("2020-01-02", "UTC"), ("2020-01-03", None), ("2020-01-02", None)], SCHEMA)
    assert extend_dictionary(more, store).count() == 3


def test_hot_values_and_extra_columns(spark):
    rows = [("soon", None, k) for k in range(3000)] + [("2020-01-02", "UTC", -1), (None, None, -2)]
    df = spark.createDataFrame(rows, "raw string, zone string, rec int").withColumn("utc_second", F.lit(7)).withColumn("n_rows", F.lit(1))
    out = normalise_timestamps(df).collect()
    assert len(out) == 3002 and {r.rec: r.utc_second for r in out if r.rec < 0} == {-1: at(2020, 1, 2), -2: None}
    assert all(r.utc_second is None for r in out if r.rec >= 0)


def test_empty_tables(spark, data):
    r = lambda t: spark.read.parquet(f"{data}/{t}.parquet").limit(0)
    assert normalise_timestamps(dated_rows(r("episodes"), r("podcast_charts"), r("feed_hosts"))).count() == 0
