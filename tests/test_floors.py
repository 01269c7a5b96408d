"""Floors and levelling on rooms with a known tilt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepline.operators import floors


def turn(axis, degrees):
    a = np.array(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    r = np.radians(degrees)
    return np.eye(3) + np.sin(r) * k + (1 - np.cos(r)) * k @ k


def room(session, tilt=0.0, n=4000, walls=True, floor=True, seed=0, heading=0.0):
    """A floor of 4 by 3 m with walls to 2.4 m, turned by tilt degrees about x, in two passes of time."""
    random = np.random.default_rng(seed)
    u = random.uniform(0, 1, (n, 3))
    parts = []
    if floor:
        parts.append(np.column_stack([u[:, 0] * 4 - 2, random.normal(0, 0.003, n), u[:, 1] * 3 - 1.5]))
    if walls:
        parts.append(np.column_stack([np.where(u[: n // 2, 0] < 0.5, -2.0, 2.0), u[: n // 2, 1] * 2.4, u[: n // 2, 2] * 3 - 1.5]))
    p = np.concatenate(parts) @ turn((np.cos(heading), 0, np.sin(heading)), tilt).T
    return [(session, int(k % 2000) * 10_000_000, *map(float, x)) for k, x in enumerate(p)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "session int, t long, x double, y double, z double")


def still(spark, sessions, q=(0.0, 0.0, 0.0, 1.0)):
    rows = [(s, t * 5_000_000_000, 0.0, 1.2, 0.0, *q, 0.01, 2, False, 1.0) for s in sessions for t in range(5)]
    return spark.createDataFrame(rows, "session int, t long, px double, py double, pz double, qx double, qy double, qz double, qw double, sigma double, quality int, lost boolean, confidence double")


def test_floors_of_known_tilt(spark):
    sessions = {1: 0.0, 2: 4.0, 3: 12.0}
    rows = [r for s, tilt in sessions.items() for r in room(s, tilt, seed=s, heading=0.7 * s)]
    rows += room(4, n=2400, floor=False) + room(8, n=6000, floor=False) + room(5, n=300, seed=2) + [(6, 0, float(k), 0.0, 0.0) for k in range(10)] + room(7, n=900, seed=7)
    df = frame(spark, rows)
    got = {r.session: r for r in floors.floor_planes(df, ["session"]).collect()}
    for s, tilt in sessions.items():
        assert got[s].state == "found" and got[s].tilt == pytest.approx(tilt, abs=0.15) and got[s].ny > 0
        assert got[s].inliers > 3500 and got[s].area == pytest.approx(12, rel=0.1)
    assert [got[k].state for k in (4, 8, 5, 6, 7)] == ["no-floor", "thin-floor", "not-enough-data", "not-enough-data", "thin-floor"]
    other = {r.session: r for r in floors.floor_planes(df.repartition(5).orderBy(F.rand(1)), ["session"]).collect()}
    assert got == other  # to the last bit
    assert floors.floor_planes(frame(spark, []), ["session"]).collect() == []


def test_levelling(spark):
    q = (0.0, float(np.sin(0.4)), 0.0, float(np.cos(0.4)))  # the carrier looks aside
    rows = room(1, 5.0, seed=1) + room(2, 0.5, seed=2) + room(3, 25.0, seed=3) + room(4, 4.0, seed=4)
    points, poses = frame(spark, rows), still(spark, [1, 2, 3], q)
    moved, report = floors.levelled(points, poses, "session", 10_000_000_000)
    got = {r.session: r for r in report.collect()}
    assert {k: r.decision for k, r in got.items()} == {1: "applied", 2: "already-level", 3: "tilt-too-big", 4: "not-enough-data"}
    assert got[1].tilt_before == pytest.approx(5, abs=0.15) and got[1].tilt_after < 0.3 and got[1].angle == pytest.approx(5, abs=0.3) and got[1].rounds in (1, 2)
    assert (got[2].cw, got[2].rounds, got[2].angle) == (1.0, 0, 0.0)
    after = floors.floor_planes(moved, ["session"]).where("session = 1").first()
    assert after.tilt == pytest.approx(got[1].tilt_after, abs=1e-6)
    # no turn about the vertical: with one attitude, the correction in the world has no y part
    c = np.array([got[1].cx, got[1].cy, got[1].cz])
    s, w = q[1], q[3]
    assert abs(c[1]) < 1e-9 and abs((w * w + s * s) - 1) < 1e-12
    untouched = points.where("session <> 1").exceptAll(moved.where("session <> 1"))
    assert untouched.count() == 0 and moved.count() == len(rows)
