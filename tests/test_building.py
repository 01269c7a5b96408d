"""Walls, openings and rooms of a building of known measures; components, matchings and cycles by hand."""

import numpy as np
import pytest

from sweepline.operators import building, graph


def faces(noise, rotate=0.0, seed=1):
    """Two rooms and a corridor: outer faces from inside, two partitions of 15 cm with both faces, two doors of 90 cm, as occupied cells."""
    random = np.random.default_rng(seed)
    door_a, door_b = (1.5, 2.4), (5.5, 6.4)
    lines = [((0, 0), (8, 0), ()), ((8, 0), (8, 5), ()), ((8, 5), (0, 5), ()), ((0, 5), (0, 0), ())]
    lines += [((0, y), (8, y), (door_a, door_b)) for y in (1.4, 1.55)] + [((x, 1.55), (x, 5), ()) for x in (3.85, 4.0)]
    points = []
    for (x0, y0), (x1, y1), holes in lines:
        length = np.hypot(x1 - x0, y1 - y0)
        t = np.arange(0, length, 0.01)
        keep = np.ones(len(t), bool)
        for a, b in holes:
            keep &= (t < a) | (t > b)
        u = np.array([x1 - x0, y1 - y0]) / length
        points.append(np.array([x0, y0]) + t[keep, None] * u + random.normal(0, noise, (keep.sum(), 1)) * np.array([-u[1], u[0]]))
    p = np.concatenate(points)
    c, s = np.cos(np.radians(rotate)), np.sin(np.radians(rotate))
    p = p @ np.array([[c, s], [-s, c]])
    return np.unique(np.floor(p / 0.02), axis=0) * 0.02 + 0.01


AREAS = {"corridor": 8 * 1.4, "a": 3.85 * 3.45, "b": 4.0 * 3.45}


def test_building(spark):
    rows = [("one", *map(float, c)) for c in faces(0.004)] + [("two", *map(float, c)) for c in faces(0.006, 12.0, 3)]
    rows += [("dots", float(k), float(k * k % 7)) for k in range(20)]
    cells = spark.createDataFrame(rows, "plan string, x double, y double")
    walls, openings = building.extract_walls(cells, "plan")
    got = walls.toPandas()
    assert got.groupby("plan").size().to_dict() == {"one": 6, "two": 6}
    for plan in ("one", "two"):
        mine = got[got.plan == plan]
        assert mine.paired.sum() == 2 and np.allclose(mine[mine.paired].thickness, 0.15, atol=0.012)
        lengths = np.sort(np.hypot(mine.bx - mine.ax, mine.by_ - mine.ay))
        assert np.allclose(lengths, [3.525, 5, 5, 8, 8, 8], atol=0.08)
        headings = np.degrees(np.arctan2(mine.by_ - mine.ay, mine.bx - mine.ax)) % 90
        assert np.ptp(np.minimum(headings, 90 - headings)) < 1.0
    doors = openings.where("kind = 'door'").toPandas()
    assert doors.groupby("plan").size().to_dict() == {"one": 2, "two": 2} and np.allclose(doors.width, 0.9, atol=0.05)
    found = building.rooms(walls, "plan").toPandas()
    for plan in ("one", "two"):
        mine = found[found.plan == plan].sort_values("area")
        assert np.allclose(mine.area, sorted(AREAS.values()), rtol=0.02)
        assert sorted(mine.room) == ["R1", "R2", "R3"] and mine.confidence.between(0.5, 1).all()
    order = found[found.plan == "one"].set_index("room").area
    assert np.allclose(order[["R1", "R2", "R3"]], [AREAS["corridor"], AREAS["a"], AREAS["b"]], rtol=0.02)


def test_no_cells_no_walls(spark):
    cells = spark.createDataFrame([], "plan string, x double, y double")
    walls, openings = building.extract_walls(cells, "plan")
    assert walls.collect() == [] and openings.collect() == [] and building.rooms(walls, "plan").collect() == []


@pytest.mark.parametrize("seed", [1])
def test_graphs_by_hand(spark, seed):
    random = np.random.default_rng(seed)
    edges = [(g, int(a), int(b)) for g in (0, 1) for a, b in random.integers(0, 40, (25, 2))]
    low = {(g, n): n for g in (0, 1) for n in range(40)}
    for _ in range(40):
        for g, a, b in edges:
            low[g, a] = low[g, b] = min(low[g, a], low[g, b])
    nodes = spark.createDataFrame([(g, n) for g, n in low], "g int, node long")
    df = spark.createDataFrame(edges, "g int, a long, b long")
    assert {(r.g, r.node): r.label for r in graph.components(nodes, df, "g").collect()} == low
    pairs = sorted({(g, min(a, b), max(a, b)) for g, a, b in edges if a != b})
    weights = [(*p, float(random.integers(0, 4))) for p in pairs]
    taken, used = set(), set()
    for g, i, j, w in sorted(weights, key=lambda x: (-x[3], x[1], x[2])):
        if not {(g, i), (g, j)} & used:
            used |= {(g, i), (g, j)}
            taken.add((g, i, j, w))
    assert {tuple(r) for r in graph.greedy_matching(spark.createDataFrame(weights, "g int, i long, j long, w double"), "g", "w").collect()} == taken
    ring = random.permutation(60)
    least = {}
    for n in range(60):
        seen, k = [n], int(ring[n])
        while k != n:
            seen.append(k)
            k = int(ring[k])
        least[n] = min(seen)
    following = spark.createDataFrame([(0, n, int(ring[n])) for n in range(60)], "g int, node long, next long")
    assert {r.node: r.label for r in graph.cycles(following, "g").collect()} == least
