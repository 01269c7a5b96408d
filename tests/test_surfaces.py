"""Planes, normals and self-consistency on rooms of known shape, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepline.operators import surfaces

SECOND = 1_000_000_000


def walls(dx=0.0, dy=0.0, dz=0.0, slide=0.0, t=0):
    """Four walls of a room of 4 by 3 m, sampled every 4 cm."""
    u, v = np.meshgrid(-1.2 + 0.04 * np.arange(61), 0.2 + 0.04 * np.arange(41), indexing="ij")
    u, v = u.ravel(), v.ravel()
    parts = [(np.full(len(u), x), v, u + slide) for x in (2.0, -2.0)] + [(u + slide, v, np.full(len(u), z)) for z in (1.5, -1.5)]
    return [(1, t, float(np.float32(a + dx)), float(np.float32(b + dy)), float(np.float32(c + dz))) for x, y, z in parts for a, b, c in zip(x, y, z, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "session int, t long, x double, y double, z double")


def two_passes(dx=0.0, dy=0.0, dz=0.0, slide=0.0):
    return walls(t=SECOND // 1000) + walls(dx, dy, dz, slide, 8 * SECOND + SECOND // 1000)


def by_hand(rows, p=surfaces.Consistency()):
    """Offsets of each separation, cell by cell."""
    a = np.array([r[1:] for r in rows])
    w = ((a[:, 0] - a[:, 0].min()) // p.window).astype(int)
    cells = {}
    for k, c in enumerate(map(tuple, np.floor(a[:, 1:] / p.cell).astype(int))):
        cells.setdefault((c, w[k]), []).append(a[k, 1:])
    cells = {k: np.array(sorted(map(tuple, v))) for k, v in cells.items() if len(v) >= p.least}

    def offset(one, two):
        values, vectors = np.linalg.eigh(np.cov(one.T, bias=True))
        return np.abs((two - one.mean(axis=0)) @ vectors[:, 0]).mean() if values[0] <= p.ratio * values[2] else None

    found = {}
    for (c, i), one in cells.items():
        if len(one) >= 2 * p.least:
            found.setdefault(0, []).append(offset(one[: len(one) // 2], one[len(one) // 2 :]))
        for s in range(1, p.apart + 1):
            if (c, i + s) in cells:
                found.setdefault(s, []).append(offset(one, cells[c, i + s]))
    return {s: sorted(x for x in v if x is not None) for s, v in found.items()}


@pytest.mark.parametrize(("dx", "slide"), [(0.0, 0.0), (0.05, 0.0), (0.0, 0.02), (0.03, 0.07)])
def test_room_painted_twice(spark, dx, slide):
    rows = two_passes(dx=dx, dz=dx, slide=slide)
    got = {r.separation: r for r in surfaces.self_consistency(frame(spark, rows), ["session"]).collect()}
    want = by_hand(rows)
    assert sorted(got) == sorted(want) == [0, 1]
    for s, offsets in want.items():
        assert got[s].cells == len(offsets)
        assert got[s].median_offset == pytest.approx(offsets[len(offsets) // 2], abs=2e-6)
        assert got[s].p90_offset == pytest.approx(offsets[int(0.9 * len(offsets))], abs=2e-6)
    assert got[0].median_offset < 0.0005
    if dx == 0:
        assert got[1].median_offset < 0.0005  # along a wall nothing shows
    elif slide == 0:
        assert got[1].median_offset == pytest.approx(dx, abs=0.005)


def test_shuffles_change_no_bit(spark):
    rows = two_passes(dx=0.02)
    df = frame(spark, rows)
    one = surfaces.self_consistency(df, ["session"]).orderBy("separation").collect()
    assert one == surfaces.self_consistency(df.repartition(7).orderBy(F.rand(3)), ["session"]).orderBy("separation").collect()
    assert one == surfaces.self_consistency(df.withColumn("session", F.lit(None).cast("int")), ["session"]).orderBy("separation").withColumn("session", F.lit(1)).collect()


def test_blockers(spark):
    room = walls()
    few = [(2, 0, 0.0, 0.0, 0.0)] * 15
    short = [(3, *r[1:]) for r in room]
    sparse = [(4, k * SECOND, float(k), 0.0, float("nan") if k == 3 else 0.0) for k in range(30)]
    once = [(5, *r[1:]) for r in room] + [(5, 30 * SECOND, r[2] + 50, r[3], r[4]) for r in room]
    good = [(6, *r[1:]) for r in two_passes(dx=0.05, dz=0.05)]
    got = {r.session: r for r in surfaces.consistency_report(frame(spark, few + short + sparse + once + good), ["session"]).collect()}
    assert [got[k].blocker for k in (2, 3, 4, 5, 6)] == ["too few points", "capture shorter than one window", "no cell holds enough points", "no surface was painted twice", None]
    assert (got[6].points, got[6].windows, got[6].nearest_separation, got[6].measurable) == (2 * len(room), 2, 1, True)
    assert got[5].self_cells > 0 and got[5].nearest_offset is None
    assert surfaces.consistency_report(frame(spark, []), ["session"]).collect() == []
    with pytest.raises(ValueError):
        surfaces.consistency_report(frame(spark, few), ["session"], surfaces.Consistency(cell=0))


def test_eigen_against_numpy(spark):
    random = np.random.default_rng(4)
    matrices = [m @ m.T for m in random.normal(size=(200, 3, 3)) * 10.0 ** random.integers(-4, 4, (200, 1, 1))]
    matrices += [np.diag(d) for d in ((1.0, 2.0, 3.0), (3.0, 1.0, 2.0), (0.0, 5.0, 5.0), (0.0, 0.0, 4.0), (2.0, 2.0, 2.0), (0.0, 0.0, 0.0))]
    rows = [(k, *(float(m["xyz".index(a), "xyz".index(b)]) for a, b in surfaces.PAIRS)) for k, m in enumerate(matrices)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"c{a}{b} double" for a, b in surfaces.PAIRS))
    for r in surfaces.with_eigen(df).collect():
        values, vectors = np.linalg.eigh(matrices[r.id])
        scale = max(values[2], 1e-300)
        assert np.allclose(np.array([r.e1, r.e2, r.e3]) / scale, values / scale, atol=1e-9 if values[1] - values[0] > 1e-3 * scale else 1e-7)
        if values[1] - values[0] > 1e-3 * scale:
            n = np.array([r.nx, r.ny, r.nz])
            assert abs(n @ vectors[:, 0]) == pytest.approx(1, abs=1e-6) and n[np.argmax(np.abs(n))] > 0
        elif values[1] == values[0]:
            assert r.nx is None


def test_normals_and_coverage(spark):
    random = np.random.default_rng(8)
    floor = [(0, k, float(a), float(b), 0.0) for k, (a, b) in enumerate(random.uniform(0, 1, (400, 2)))]
    corner = [(1, k, float(a), float(b), 0.0) if k % 3 == 0 else (1, k, float(a), 0.0, float(b)) if k % 3 == 1 else (1, k, 0.0, float(a), float(b)) for k, (a, b) in enumerate(random.uniform(0.15, 1, (900, 2)))]
    few = [(2, k, float(k), 0.0, 0.0) for k in range(10)]
    df = spark.createDataFrame(floor + corner + few, "room int, id long, x double, y double, z double")
    got = surfaces.normals(df.where("room = 0")).collect()
    assert all(r.nx is None if r.found < 6 else abs(r.nz - 1) < 1e-9 for r in got) and len(got) == 400
    places = np.array([r[2:] for r in floor])
    near = (np.linalg.norm(places[:, None] - places[None], axis=2) <= 0.15).sum(axis=1)
    assert {r.id: r.found for r in got} == dict(enumerate(near.tolist()))
    rooms = {r.room: r for r in surfaces.normal_coverage(df, ["room"], 0.15).collect()}
    assert rooms[0].coverage == 0 and rooms[0].planes > 300 and rooms[0].weak_z is None  # any direction of the floor
    assert rooms[1].coverage > 0.6 and rooms[2].coverage == 0 and rooms[2].planes == 0 and rooms[2].weak_x is None


@pytest.mark.parametrize("values", [[0.0] * 50, list(np.linspace(0, 1, 101)), [0.5], [0.1, 0.2]])
def test_picked_places(spark, values):
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", None), ("c", 9.0)], "g string, v double")
    got = {r.g: r for r in surfaces.picked(df, ["g"], "v", {"low": 0.0, "mid": 0.5, "p90": 0.9, "top": 1.0}, 0.25).collect()}
    n, s = len(values), sorted(values)
    assert sorted(got) == ["a", "c"] and got["a"].n == n
    assert [got["a"][k] for k in ("low", "mid", "p90", "top")] == [s[min(int(p * n), n - 1)] for p in (0, 0.5, 0.9, 1)]
