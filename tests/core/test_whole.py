"""Queries over all objects of a volume against brute force."""

from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from voxelgrain import catalog
from voxelgrain.views import voxels


@pytest.fixture(scope="module")
def volume(spark, small):
    out = defaultdict(dict)
    for r in voxels(spark, small).collect():
        out[r.tomo][r.z, r.y, r.x] = r.label
    return out


def run(spark, small, name):
    return catalog.queries()[name](spark, small).collect()


@pytest.fixture(scope="module")
def pairs(volume):
    """{(tomo, a, b): (d2, end of a, end of b)} up to 20, the first ends of equal ones."""
    out = {}
    for tomo, v in volume.items():
        objects = defaultdict(list)
        for p, label in sorted(v.items()):
            objects[label].append(p)
        for a, b in product(sorted(objects), repeat=2):
            if a < b:
                p, q = np.array(objects[a]), np.array(objects[b])
                d2 = ((p[:, None] - q[None]) ** 2).sum(2)
                i, j = np.unravel_index(int(d2.argmin()), d2.shape)
                if d2[i, j] <= 400:
                    out[tomo, a, b] = int(d2[i, j]), objects[a][i], objects[b][j]
    return out


def test_components(spark, small, volume):
    want, largest, big = {}, set(), set()
    for tomo, v in volume.items():
        part = {}
        for p in sorted(v):
            if p not in part:
                k, todo = len(set(part.values())) + 1, [p]
                part[p] = k
                while todo:
                    z, y, x = todo.pop()
                    for dz, dy, dx in product((-1, 0, 1), repeat=3):
                        q = (z + dz, y + dy, x + dx)
                        if q in v and q not in part:
                            part[q] = k
                            todo.append(q)
        n = Counter(part.values())
        top = min(n, key=lambda k: (-n[k], k))
        want |= {(tomo, *p): k for p, k in part.items()}
        largest |= {(tomo, *p) for p, k in part.items() if k == top}
        big |= {(tomo, *p) for p, k in part.items() if n[k] >= 5}
    assert {(r.tomo, r.z, r.y, r.x): r.component for r in run(spark, small, "connected_components")} == want
    assert {(r.tomo, r.z, r.y, r.x) for r in run(spark, small, "largest_component")} == largest
    assert {(r.tomo, r.z, r.y, r.x) for r in run(spark, small, "components_size_filter")} == big


def test_pairs(spark, small, pairs):
    got = {(r.tomo, r.id_a, r.id_b): r.distance for r in run(spark, small, "pairwise_distances")}
    assert got == {k: pytest.approx(m[0] ** 0.5, abs=1e-6) for k, m in pairs.items()}
    near = defaultdict(list)
    for (t, a, b), m in pairs.items():
        near[t, a].append((m[0], b))
        near[t, b].append((m[0], a))
    want = {(t, min(a, b), max(a, b)) for (t, a), some in near.items() for _, b in sorted(some)[:2]}
    assert {(r.tomo, r.id_a, r.id_b) for r in run(spark, small, "nearest_neighbours")} == want


def test_direct_pairs(spark, small, volume, pairs):
    def free(t, a, b, p, q):
        n = max(abs(i - j) for i, j in zip(p, q, strict=True))
        line = [tuple(int(np.floor(i + (j - i) * k / max(n, 1) + 0.5)) for i, j in zip(p, q, strict=True)) for k in range(n + 1)]
        return all(volume[t].get(at, a) in (a, b) for at in line)

    got = {(r.tomo, r.id_a, r.id_b) for r in run(spark, small, "direct_pairs")}
    assert got == {(t, a, b) for (t, a, b), (_, p, q) in pairs.items() if free(t, a, b, p, q)}


def test_proximity(spark, small, volume):
    want = {}
    for tomo, v in volume.items():
        wall, objects = np.array([p for p, k in v.items() if k % 7 == 0]), defaultdict(list)
        for p, k in v.items():
            if k % 7:
                objects[k].append(np.sqrt(((wall - np.array(p)) ** 2).sum(1).min()))
        want |= {(tomo, k): pytest.approx((min(d), np.median(d), max(d)), abs=2e-6) for k, d in objects.items()}
    assert {(r.tomo, r.label): (r.min, r.median, r.max) for r in run(spark, small, "proximity")} == want
