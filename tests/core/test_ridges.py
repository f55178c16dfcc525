"""Ridges at all scales come from one pass over bands, as from a pass over lines for each scale and axis."""

import numpy as np
import pytest

from voxelgrain.operators import lines as L
from voxelgrain.plans import filters as E


def by_lines(cells: dict, axis: int, taps) -> dict:
    """One filter along an axis, voxel by voxel, mirrored at the ends of each line."""
    out, r = {}, len(taps) // 2
    ends: dict = {}
    for p in cells:
        key = p[:axis] + p[axis + 1 :]
        lo, hi = ends.get(key, (p[axis], p[axis]))
        ends[key] = min(lo, p[axis]), max(hi, p[axis])
    for p in cells:
        lo, hi = ends[p[:axis] + p[axis + 1 :]]
        n = hi - lo + 1
        total = 0.0
        for k, t in enumerate(taps):
            i = (p[axis] + k - r - lo) % (2 * n)
            total += t * cells.get(p[:axis] + (lo + min(i, 2 * n - 1 - i),) + p[axis + 1 :], 0.0)
        out[p] = total
    return out


@pytest.mark.parametrize("dark", [True, False])
def test_ridges(spark, monkeypatch, dark):
    monkeypatch.setattr(E, "BAND", 4)
    r, sigmas = np.random.default_rng(5), (0.5, 1.5)
    cells = {(z, y, x): float(r.integers(0, 9)) for z in range(2) for y in range(-3, 11) for x in range(9) if r.random() < 0.8}
    want = dict.fromkeys(cells, 0.0)
    for s in sigmas:
        g = [L.gaussian_taps(s, o) for o in range(3)]
        hyy, hyx, hxx = (by_lines(by_lines(cells, 1, g[a]), 2, g[b]) for a, b in ((2, 0), (1, 1), (0, 2)))
        for p in cells:
            e = np.linalg.eigvalsh([[hyy[p], hyx[p]], [hyx[p], hxx[p]]])
            want[p] = max(want[p], (e[1] if dark else -e[0]) * s * s)
    image = spark.createDataFrame([("t", *p, v) for p, v in cells.items()], "tomo string, z int, y int, x int, value double")
    found = E.ridges(image, sigmas, dark)
    got = {(q.z, q.y, q.x): q.value for q in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    # lines, then bands: nothing else is shuffled, however many scales there are
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 2
