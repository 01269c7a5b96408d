"""Wall probes against a loop over cells."""

import numpy as np
import pytest

from sweepline.operators import probes


def by_hand(points, p, most):
    u, v = np.array(points).T
    u0, v0 = u.min() - 1, v.min() - 1
    i, j = np.floor((u - u0) / p.cell).astype(int), np.floor((v - v0) / p.cell).astype(int)
    counts = {}
    for c in zip(i.tolist(), j.tolist(), strict=True):
        counts[c] = counts.get(c, 0) + 1
    apart, taken, out = int(np.ceil(0.5 * p.radius / p.cell)), set(), []
    for (a, b), n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if n < p.least_cell or (a, b) in taken or len(out) == most:
            continue
        du, dv = u - (u0 + (a + 0.5) * p.cell), v - (v0 + (b + 0.5) * p.cell)
        near = du * du + dv * dv <= p.radius**2
        if near.sum() < p.least:
            continue
        small, large = np.linalg.eigvalsh(np.cov(du[near], dv[near], bias=True))
        if small > 0 and large >= p.elongation * small:
            out.append((a, b, n, int(near.sum()), float(np.sqrt(small))))
            taken |= {(a + x, b + y) for x in range(-apart, apart + 1) for y in range(-apart, apart + 1)}
    return out


@pytest.mark.parametrize(("most", "sigma"), [(100, 0.02), (4, 0.05)])
def test_probes_by_hand(spark, most, sigma):
    random = np.random.default_rng(2)
    n = 6000
    along = random.uniform(0, 5, n)
    walls = [np.column_stack([along, 1.0 + random.normal(0, sigma, n)]), np.column_stack([2.5 + random.normal(0, sigma, n), along]), random.uniform(0, 5, (3000, 2))]
    points = np.concatenate(walls)
    p = probes.Probes(least_cell=30, least=150, elongation=8.0)
    rows = [("room", *map(float, x)) for x in points] + [("few", 0.0, float(k)) for k in range(9)] + [("few", None, 1.0)]
    got = probes.wall_probes(spark.createDataFrame(rows, "plan string, u double, v double"), "plan", most, p).orderBy("place").collect()
    want = by_hand(points, p, most)
    assert [(r.i, r.j, r.filled, r.n) for r in got] == [w[:4] for w in want] and len(want) == min(most, len(want)) > 3
    assert np.allclose([r.sigma for r in got], [w[4] for w in want], atol=1e-9)
