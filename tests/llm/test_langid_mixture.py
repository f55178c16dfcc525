"""The mixture of languages, document by document in plain loops."""

import numpy as np
import pytest

from voxelgrain.llm import langid


def slow(p, weight, iterations):
    def em(pi):
        for _ in range(iterations):
            joint = p * pi
            pi = (joint * (weight / joint.sum(1))[:, None]).sum(0) / weight.sum()
        return pi, float((weight * np.log((p * pi).sum(1))).sum())

    pi, best = em(np.full(p.shape[1], 1 / p.shape[1]))
    while (pi > 0).sum() > 1:
        trial = pi.copy()
        trial[np.where(trial > 0, trial, np.inf).argmin()] = 0
        trial, fit = em(trial / trial.sum())
        if fit + 0.5 * np.log(max(weight.sum(), 2)) < best:
            break
        pi, best = trial, fit
    return pi


def test_mixture_is_that_of_plain_loops():
    r = np.random.default_rng(1)
    like, weight = r.normal(-20, 2, (300, 4)).astype(np.float32), r.integers(1, 5, 300).astype(float)
    doc = np.sort(r.choice([0, 2, 3, 4, 7], 300))
    got = langid.mixture(like, doc, weight, 9)
    p = np.exp(like - like.max(1, keepdims=True)).astype(float)
    for k in range(9):
        mine = doc == k
        want = slow(p[mine], weight[mine], langid.ITERATIONS) if mine.any() else np.zeros(4)
        assert got[k] == pytest.approx(want, abs=1e-12)
