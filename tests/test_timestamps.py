from __future__ import annotations

import pytest

from caseloom.functions.timestamps import normal_form, normalise, readings

BERLIN, NEW_YORK = "Europe/Berlin", "America/New_York"


@pytest.mark.parametrize(
    ("value", "zone", "order", "want"),
    [
        ("2020-04-05", None, None, "2020-04-05"),
        (" 2020-04-05\t", None, None, "2020-04-05"),
        ("20200405", None, None, "2020-04-05"),
        ("Tuesday, January 27, 2009", None, None, "2009-01-27"),
        ("24 juin 2024", BERLIN, "DMY", "2024-06-24"),
        ("the 30th of November 2023", None, None, "2023-11-30"),
        ("24 de mayo de 2021", None, None, "2021-05-24"),
        ("21-APR-2016", None, None, "2016-04-21"),
        ("08/31/2019", NEW_YORK, "MDY", "2019-08-31"),
        ("08/09/2019", NEW_YORK, "MDY", "2019-08-09"),
        ("08/09/2019", BERLIN, "DMY", "2019-09-08"),
        ("08/09/2019", None, None, None),  # two orders, two days
        ("09/09/2019", None, None, "2019-09-09"),
        ("31/12/2013", None, None, "2013-12-31"),
        ("31/04/2021", BERLIN, "DMY", None),
        ("26.04.17", BERLIN, "DMY", "2017-04-26"),
        ("2018-03-25 03:03:00,082", BERLIN, "DMY", "2018-03-25T01:03:00.082Z"),
        ("2018-03-25 02:30:00", BERLIN, "DMY", None),  # skipped
        ("2018-10-28 02:30:00", BERLIN, "DMY", None),  # shown twice
        ("2018-10-28 02:30:00 CET", BERLIN, "DMY", "2018-10-28T01:30:00.000Z"),
        ("2018-10-28 02:30:00 CEST", BERLIN, "DMY", "2018-10-28T00:30:00.000Z"),
        ("2018-07-01 12:00:00", None, None, None),  # no zone
        ("2018-07-01T12:00:00Z", None, None, "2018-07-01T12:00:00.000Z"),
        ("2022-08-12 06:07:15.026903 +0530", None, None, "2022-08-12T00:37:15.026Z"),
        ("2018-10-04T20:13:52+02:00[Europe/Berlin]", None, None, "2018-10-04T18:13:52.000Z"),
        ("13 Nov 2022 at 10:22:03 (UTC)", None, None, "2022-11-13T10:22:03.000Z"),
        ("Nov 1, 2020 12:56 AM CDT", "America/Chicago", "MDY", "2020-11-01T05:56:00.000Z"),
        ("14 Aug 2017, 03.02h", "Asia/Tokyo", "YMD", "2017-08-13T18:02:00.000Z"),
        ("1427597885", None, None, "2015-03-29T02:58:05.000Z"),
        ("1714001941616", None, None, "2024-04-24T23:39:01.616Z"),
        ("2020-02-30", None, None, None),
        ("13-16 January 2013", BERLIN, "DMY", None),
        ("June 2020", BERLIN, "DMY", None),
        ("unknown", BERLIN, "DMY", None),
        ("", None, None, None),
        (None, None, None, None),
        ("x" * 100_000, None, None, None),
    ],
)
def test_normal_form(value, zone, order, want):
    assert normal_form(value, zone, order) == want


def test_fold_policies():
    assert normal_form("2018-10-28 02:30:00", BERLIN, "DMY", "earlier") == "2018-10-28T00:30:00.000Z"
    assert normal_form("2018-10-28 02:30:00", BERLIN, "DMY", "later") == "2018-10-28T01:30:00.000Z"


def test_tables(spark):
    sources = spark.createDataFrame([("HBR", "x", BERLIN, "DMY", "de")], "source_code string, site_name string, zone_name string, date_order string, main_lang string")
    rows = [(1, "HBR_1.pdf", "2020-01-02", "a"), (2, "HBR_1.pdf", "02.01.2020", "b"), (3, "x.pdf", "2.3.2020", None), (3, "x.pdf", None, None), (4, None, "2020-13-01", None)]
    df = spark.createDataFrame(rows, "id long, f string, d string, __zone2 string")
    got = {(r["id"], r["d"]): r["normal_form"] for r in normalise(df, "d", "f", sources).collect()}
    assert got == {(1, "2020-01-02"): "2020-01-02", (2, "02.01.2020"): "2020-01-02", (3, "2.3.2020"): None, (3, None): None, (4, "2020-13-01"): None}
    assert [(r["id"], r["normal_form"]) for r in readings(df, "d", "f", sources).collect()] == [(2, "2020-01-02")]
    assert readings(df.filter("false"), "d", "f", sources).count() == 0
