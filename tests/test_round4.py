"""Findings of round 4: rows that made a query differ from its SQL, and the blocks, tiles and bands of larger tables."""

import datetime as dt

import duckdb
import pytest

from sweepline.plans import registry

SF = "/root/testdata/sf0.001"
DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def against_sql(spark, tmp_path):
    """The rows of a query and of its SQL over sf0.001 with one table changed to ``select`` of it."""

    def run(name, table, select):
        con = duckdb.connect()
        con.execute(f"copy ({select.format(t=f'{SF}/{table}.parquet')}) to '{tmp_path}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
        df = registry.QUERIES[name](spark, str(tmp_path))
        said = con.sql(registry.ORACLE_SQL[name])
        at = [said.columns.index(c) for c in df.columns]
        return sorted(map(tuple, df.collect()), key=str), sorted((tuple(r[i] for i in at) for r in said.fetchall()), key=str)

    return run


EVENT = "select {event} event_id, timestamp '2024-01-01' + interval ({hour}) hour ts, {user}::bigint user_id, 'view' event_type, {value}::double value, null::varchar props"


def events(rows):
    return " union all ".join(EVENT.format(event=f"{k}::bigint", hour=h, user=u, value="null" if v is None else v) for k, (u, h, v) in enumerate(rows))


def test_motion_gate_with_equal_times_and_nulls(against_sql):
    got, want = against_sql("motion_gate", "events", events([(1, 0, 5), (1, 0, 7), (1, 3, 20), (2, 0, None), (3, 1, 9)]))
    assert got == want
    assert {r[0]: r[5] for r in got} == {0: float("inf"), 1: float("inf"), 2: 0.666667, 3: None, 4: None}
    assert {r[0]: r[4] for r in got}[3] is False


def test_phone_burst_keeps_the_sign_of_small_heights(against_sql):
    got, want = against_sql("phone_burst", "customer", "select * replace (case c_custkey % 3 when 0 then -0.3 when 1 then 0.3 else -0.5 end as c_acctbal) from '{t}' where c_custkey < 30")
    assert got == want
    assert sum(",-0.0,M," in line for _, line in got) == 10


def test_parallax_watch_on_the_threshold(against_sql):
    """Turns of 30 degrees and none of the way, each pair a session of its own."""
    pairs = [(k, n, e) for k in range(60) for n, e in enumerate((k, k + 1500))]
    rows = " union all ".join(EVENT.format(event=f"{e}::bigint", hour=n, user=k, value=7) for k, n, e in pairs)
    got, want = against_sql("parallax_watch", "events", rows)
    assert got == want
    assert sum(turned == 30.0 and starved for _, _, turned, starved in got) >= 30


def test_holds_are_written_out_once(spark):
    """The plan of a hold grows with its steps, not with their product."""
    df = registry.QUERIES["hold_orientation"](spark, SF)
    assert len(df._jdf.queryExecution().analyzed().toString()) < 100_000


def test_survey_by_tiles_and_blocks(spark):
    """More sessions than a tile holds, voxels on both sides of 0, one session that shares with none."""
    import numpy as np
    from sweepline.operators import fits

    r = np.random.default_rng(3)
    rows = [(int(s), *map(float, r.uniform(-12, 12, 3).round(3))) for s in range(40) for _ in range(int(r.integers(1, 60)))] + [(99, 500.0, 500.0, 500.0)]
    cells = {}
    for s, *p in rows:
        cells.setdefault(s, set()).add(tuple(int(np.floor(v)) for v in p))
    want = {(a, b): (len(cells[a] & cells[b]), len(cells[a] & cells[b]) / max(len(cells[a]), len(cells[b]))) for a in cells for b in cells if a < b and cells[a] & cells[b]}
    found = fits.overlap_survey(spark.createDataFrame(rows, "s long, x double, y double, z double"), "s", 1.0, tile=7)
    assert {(x.a, x.b): (x.shared, x.overlap) for x in found.collect()} == want


def test_points_in_rings_by_bands(spark, against_sql):
    """Flat rings, edges of one height, points on the heights of vertices; the plan has no list of a ring."""
    from sweepline.operators import fits

    ring = [(1, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (10, 0), (10, 7), (6, 7), (6, 3), (3, 9), (0, 9)])] + [(2, 0, 0.0, 1.0), (2, 1, 5.0, 1.0)]
    asked = [(g, x / 2, y / 2) for g in (1, 2, 3) for x in range(-2, 24) for y in range(-2, 22)] * 2
    of = {g: [(x, y) for h, _, x, y in ring if h == g] for g in (1, 2)}

    def inside(g, x, y):
        v = of[g]
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(v, v[1:] + v[:1], strict=True)) % 2 == 1

    found = fits.inside_rings(spark.createDataFrame(asked, "g long, x double, y double"), spark.createDataFrame(ring, "g long, k long, x double, y double"), "g", ["k"], bands=4)
    assert sorted((p.g, p.x, p.y, p.inside) for p in found.collect()) == sorted((g, x, y, inside(g, x, y)) for g, x, y in asked if g < 3)


def test_collinear_lines_take_headings_once_a_line(spark):
    plan = registry.QUERIES["collinear_lines"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [step for step in plan.splitlines() if "Join" in step and "ATAN2" in step.upper()]


@pytest.mark.parametrize("name", ["knn_topk", "outlier_filter", "mean_nearest", "normal_coverage", "point_normals"])
def test_neighbours_are_found_inside_blocks(spark, name):
    """No join or window holds pairs of points, so none is shuffled or sent to the driver."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    steps = [s.strip(" :+-") for s in plan.splitlines()]
    assert not [s for s in steps if s.startswith("Window")]
    assert not [s for s in steps if s.startswith("Join") and " (d2" in s.lower() or s.startswith("Join") and "i#" in s]


def test_nearest_against_brute_force(spark):
    """Points on a lattice, so that many distances are equal, on both sides of 0, more than a box holds, copies at one place."""
    import numpy as np
    from sweepline.operators import spatial, surfaces

    r = np.random.default_rng(5)
    p = np.concatenate([r.integers(-6, 6, (400, 3)) / 8.0, np.zeros((30, 3))])
    rows = [(int(k), *map(float, x)) for k, x in zip(r.permutation(len(p)), p, strict=True)]
    df = spark.createDataFrame([*rows, (1000, None, 0.0, 0.0), (1001, float("nan"), 0.0, 0.0), (1002, 90.0, 90.0, 90.0)], "id long, x double, y double, z double")
    rows.append((1002, 90.0, 90.0, 90.0))
    ids, at = np.array([x[0] for x in rows]), np.array([x[1:] for x in rows])
    want, moments = set(), {}
    for q, place in zip(ids, at, strict=True):
        d = at - place
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        near = [k for k in np.lexsort((ids, d2)) if d2[k] <= 0.25 * 0.25]
        want |= {(int(q), int(ids[k]), n, float(d2[k])) for n, k in enumerate(near[:9], 1)}
        u = np.floor(d[near] / 0.25 * surfaces.UNIT).astype(int)
        moments[int(q)] = (len(near), int(u[:, 0].sum()), int((u[:, 1] * u[:, 2]).sum()))
    found = spatial.knn(df.withColumnRenamed("id", "q"), df, 0.25, 9, ["id"])
    assert {(x.q, x.id, x["rank"], x.d2) for x in found.collect()} == want
    assert {x.id: (x.n, x.sx, x.syz) for x in surfaces.neighbour_moments(df, 0.25).collect()} == moments


def test_one_block_of_a_batch_is_unpacked_at_a_time(spark):
    import pyarrow as pa
    from sweepline.sources import serial

    def find(data, own):
        import gc

        unpacked = [o for o in gc.get_objects() if type(o) is list and o and type(o[0]) is dict and "base" in o[0]]
        return [(0, len(data), True, len(unpacked))]

    chunks = spark.createDataFrame([(s, 0, 0, b"abc") for s in range(300)], "session long, seq long, t long, payload binary").coalesce(1)
    found = serial.searched(chunks, find, "ok boolean, unpacked long", 8, "ok", {"ok": pa.bool_()}).collect()
    assert len(found) == 300 and max(x.unpacked for x in found) == 1


def test_stl_checks_by_table():
    from sweepline.plans import scanner
    from sweepline.sources import serial

    for byte in range(256):
        c = byte
        for _ in range(8):
            c = (c << 1 ^ 0x4D if c & 0x80 else c << 1) & 0xFF
        assert serial.CRC8_TABLE[byte] == c
    for k in range(50):
        p = scanner.stl_packet(k)[k % 3 :]
        assert (serial.crc8(p[:-1]) == p[-1]) == (k % 9 > 0)
