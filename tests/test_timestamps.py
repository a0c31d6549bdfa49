from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.operators import timestamps as X


def ms(text, locale=None, zone=None):
    return X.to_utc_ms([text], [locale], [zone])[0][0]


def utc(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp() * 1000)


@pytest.mark.parametrize(
    ("text", "locale", "zone", "want"),
    [
        ("2024-03-31", "es-ES", "Europe/Madrid", utc(2024, 3, 30, 23)),
        ("2023-09-17 10:47:26", "en-IN", "Asia/Kathmandu", utc(2023, 9, 17, 5, 2, 26)),
        ("20250530T035456Z", None, None, utc(2025, 5, 30, 3, 54, 56)),
        ("2024-08-15T14:22:19.135393759+05:45", None, None, utc(2024, 8, 15, 8, 37, 19) + 135),
        ("1697921823713", None, None, 1697921823713),
        ("1694039533.986", None, None, 1694039533986),
        ("1713946161787060", None, None, 1713946161787),
        ("1739076506", None, None, 1739076506000),
        ("Sat Jan 11 07:27:58 EST 2025", "en-US", None, utc(2025, 1, 11, 12, 27, 58)),
        ("Thu, 29 May 2025 12:45:50 +0200", None, None, utc(2025, 5, 29, 10, 45, 50)),
        ("30 mars 2025 à 0 h 43", "fr-FR", "Europe/Paris", utc(2025, 3, 29, 23, 43)),
        ("26. Oktober 2025, 02:47 Uhr", "de-DE", "Europe/Berlin", utc(2025, 10, 26, 0, 47)),
        ("30. März 2025, 02:03 Uhr", "de-DE", "Europe/Berlin", utc(2025, 3, 30, 1, 3)),
        ("23 de diciembre de 2023, 18:59", "es-ES", "Europe/Madrid", utc(2023, 12, 23, 17, 59)),
        ("2024年3月30日 13時12分", "ja-JP", "Asia/Tokyo", utc(2024, 3, 30, 4, 12)),
        ("9/7/2024, 12:54:59", "en-US", None, utc(2024, 9, 7, 12, 54, 59)),
        ("9/7/2024", "en-GB", None, utc(2024, 7, 9)),
        ("29.10.23 04:22", "de-DE", None, utc(2023, 10, 29, 4, 22)),
        ("[Dec 5, 2023, 12:09 AM]", None, None, utc(2023, 12, 5, 0, 9)),
        ("(saved 2024-07-27 22:50:29 +0100)", None, None, utc(2024, 7, 27, 21, 50, 29)),
        ("  Oct. 12 2024\n", None, None, utc(2024, 10, 12)),
        ("２０２４-01-02", None, None, utc(2024, 1, 2)),
    ],
)
def test_notations(text, locale, zone, want):
    assert ms(text, locale, zone) == want


@pytest.mark.parametrize("text", [None, "", "  ", "soon", "last spring", "14:05", "Q3 2025", "2025-02-30", "31/02/2025", "0000-00-00 00:00:00", "n/a", "13:05 PM", "x" * 10_000, "2024-01-01 25:00"])
def test_no_instant(text):
    assert ms(text, "en-GB", "Europe/London") is None


def test_unknown_zone_is_null():
    assert ms("2024-01-01", None, "Mars/Olympus") is None


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1971, 1, 1), datetime(2090, 1, 1)), st.sampled_from(["Europe/Paris", "America/New_York", "Australia/Lord_Howe", "Asia/Tehran", "Africa/Casablanca", "America/Sao_Paulo", "UTC"]))
def test_local_times_against_the_standard_library(t, zone):
    t = t.replace(microsecond=0, fold=0)
    got = X.local_to_utc(np.array([int((t - datetime(1970, 1, 1)).total_seconds())]), zone)[0]
    # fold 0 is the earlier instant of two, and the offset before a gap
    assert datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=int(got)) == t.replace(tzinfo=ZoneInfo(zone)).astimezone(UTC)


def test_table(spark):
    rows = [(1, "2024-01-01", None, None, 7), (2, None, "en-US", "UTC", 8), (2, None, "en-US", "UTC", 8), (3, "soon", None, None, 9)]
    df = spark.createDataFrame(rows, "entry_id long, created_at string, locale string, tz_hint string, utc_ms int")
    assert sorted(tuple(r) for r in X.found(df).collect()) == [(1, 1704067200000)]
    assert X.normalised(df).count() == 4
    assert X.found(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "zone", "want"),
    [
        (" " * 150 + "2024-03-31" + "\n" * 150, "UTC", utc(2024, 3, 31)),
        ("1900-01-01", "UTC", utc(1900, 1, 1)),
        ("1850-07-01T12:00:00Z", None, utc(1850, 7, 1, 12)),
        ("2100-01-01", "UTC", utc(2100, 1, 1)),
        ("2150-07-01 12:00:00", "Europe/Berlin", utc(2150, 7, 1, 10)),
        ("1870-01-01 00:53:28", "Europe/Berlin", utc(1870, 1, 1)),
    ],
)
def test_padded_and_far_dates(text, zone, want):
    assert ms(text, None, zone) == want


def test_versions_of_the_zones_must_agree(spark):
    df = spark.createDataFrame([(1, "2026-01-02 10:00", None, "Europe/Berlin")], "entry_id long, created_at string, locale string, tz_hint string")
    assert [r["zones"] for r in X.normalised(df).collect()] == [X.zone_version()] and X.zone_version()
    with pytest.raises(Exception, match="tz database"):
        X.normalised(df, zones="1970a").collect()
