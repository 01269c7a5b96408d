"""Dates over midnight, job order and holds, by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sweepline.functions import nmea
from sweepline.operators import gnss, poses


def sentence(body):
    c = 0
    for b in body.encode():
        c ^= b
    return f"${body}*{c:02X}"


def test_dates_over_midnight(spark):
    gga = lambda hms: sentence(f"GPGGA,{hms}.00,4807.038,N,01131.000,E,1,08,0.9,545.4,M,46.9,M,,")
    rmc = lambda hms, date: sentence(f"GPRMC,{hms}.00,A,4807.038,N,01131.000,E,022.4,084.4,{date},,,A")
    lines = [gga("235957"), rmc("235958", "310124"), gga("235959"), gga("000000"), gga("000001"), gga("120000"), gga("235959"), gga("000001"), rmc("000002", "020224"), gga("000003")]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "session long, seq long, line string")
    got = gnss.epochs(nmea.decoded(nmea.parsed(df)), ["session"], ["seq"], F.expr("seq div 3")).orderBy("epoch").collect()
    day = lambda d, h, m, s: int(dt.datetime(2024, *d, h, m, s, tzinfo=dt.UTC).timestamp()) * 10**9
    want = [None, day((1, 31), 23, 59, 58), day((1, 31), 23, 59, 59), *(day((2, 1), h, 0, s) for h, s in ((0, 0), (0, 1), (12, 0))), day((2, 1), 23, 59, 59), day((2, 2), 0, 0, 1), day((2, 2), 0, 0, 2), day((2, 2), 0, 0, 3)]
    assert [r.utc_ns for r in got] == want


@pytest.mark.parametrize(("up", "orientation"), [((0, 1, 0.2), "portrait"), ((1, 0, 0.2), "landscape_left"), ((-1, 0, 0), "landscape_right"), ((0, -1, 0), "portrait_reverse"), ((0.1, -0.3, 1), "portrait")])
def test_holds_from_gravity(spark, up, orientation):
    """An attitude whose device-frame up is the given vector, for a camera mounted at 0 degrees."""
    import numpy as np

    a, y = np.array(up, float) / np.linalg.norm(up), np.array([0.0, 1.0, 0.0])
    axis, w = np.cross(a, y), 1 + a @ y
    q = np.array([*axis, w]) if w > 1e-9 else np.array([1.0, 0, 0, 0])
    q = q / np.linalg.norm(q)
    h = spark.range(1).select(poses.hold_of(tuple(F.lit(float(c)) for c in q), 0.0).alias("h")).first().h
    assert h.orientation == orientation and h.confident == (np.hypot(a[0], a[1]) >= np.sin(np.radians(20)))
    assert h.pitch == pytest.approx(np.degrees(np.arctan2(a[2], np.hypot(a[0], a[1]))), abs=1e-6) and h.tilt == pytest.approx(90 - abs(h.pitch), abs=1e-6)
