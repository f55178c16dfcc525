"""Axes of objects from moments that Spark sums."""

import numpy as np
import pytest

from voxelgrain.operators import kernels as K
from voxelgrain.views import voxels


def test_axes_equal_numpy_and_gather_no_object(spark, small):
    v = voxels(spark, small)
    out = K.axes(v, (2.0, 1.0, 0.5))
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan
    want = {}
    for (tomo, label), p in v.toPandas().groupby(["tomo", "label"]):
        e = np.linalg.eigvalsh(np.cov((p[["z", "y", "x"]].to_numpy(float) * [2, 1, 0.5]).T, bias=True) + np.diag([4 / 12, 1 / 12, 0.25 / 12]))
        want[tomo, label] = pytest.approx((4 * np.sqrt(e[2]), 4 * np.sqrt(e[0])))
    assert {(r.tomo, r.label): (r.major, r.minor) for r in out.collect()} == want
