"""The candidate filter of near-duplicates against brute force, on pairs at the threshold."""

import numpy as np
import pytest

from voxelgrain.llm import dedup


def pairs(r, n, a, b, common):
    """2n sets: n pairs of sizes a and b with so many common hashes."""
    pool = r.integers(0, 2**64, (n, a + b - common), dtype=np.uint64)
    return [s for p in pool for s in (np.sort(p[:a]), np.sort(np.r_[p[:common], p[a:]]))]


def lost(sets, block=1000):
    """How many of the pairs (0, 1), (2, 3), ... that brute force links are no candidates."""
    missed = 0
    for at in range(0, len(sets), block):
        some = sets[at : at + block]
        bits, n = dedup.sketch(some)
        marks = np.zeros(dedup.BANDS, np.uint32).tobytes()
        a, b, ident, _ = dedup._candidates([(0, i, i, int(n[i]), len(s), bits[i].tobytes(), marks, 0) for i, s in enumerate(some)], 0.8)
        found = {tuple(sorted((int(ident[x]), int(ident[y])))) for x, y in zip(a, b, strict=True)}
        same = [len(np.intersect1d(x, y)) for x, y in zip(some[::2], some[1::2], strict=True)]
        linked = {(2 * k, 2 * k + 1) for k, m in enumerate(same) if 100 * m >= 80 * (len(some[2 * k]) + len(some[2 * k + 1]) - m)}
        missed += len(linked - found)
    return missed


@pytest.mark.parametrize("sizes", [(4, 5, 4), (9, 9, 8), (8, 10, 8)])
def test_small_sets_at_the_threshold_are_candidates(sizes):
    assert lost(pairs(np.random.default_rng(1), 2000, *sizes)) == 0


def test_no_jump_at_sets_that_nearly_fill_the_ranges():
    assert lost(pairs(np.random.default_rng(1), 1000, 855, 855, 760)) <= 10


@pytest.mark.parametrize("sizes", [(300, 300, 267), (630, 630, 560), (855, 855, 760), (800, 1000, 800), (1350, 1350, 1200), (2250, 2250, 2000), (5000, 5000, 4445)])
def test_estimate_has_no_bias_and_the_margin_loses_no_pair(sizes):
    sets = pairs(np.random.default_rng(2), 2000, *sizes)
    a, b = np.full(2000, float(sizes[0])), np.full(2000, float(sizes[1]))
    bits, n = dedup.sketch(sets)
    z = np.bitwise_count(bits[::2] ^ bits[1::2]).sum(1).astype(np.int64)
    j, se = dedup.estimate(z, n[::2].astype(float), n[1::2].astype(float), a, b)
    assert abs(j.mean() - sizes[2] / (sizes[0] + sizes[1] - sizes[2])) < 0.002
    assert abs(j.std() / se.mean() - 1) < 0.15
    assert lost(sets, 20) == 0
