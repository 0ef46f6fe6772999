"""Scores of the masked model against plain softmaxes."""

import numpy as np
import pytest

from tidebook.llm import masked_lm as m
from tidebook.llm import toxicity


@pytest.mark.parametrize("size", [0.3, 40.0])
def test_log_probabilities(size):
    """The rows that ids add to the hidden layer give what the whole window's product gives, also where exponentials would overflow."""
    rng = np.random.default_rng(3)
    net = {k: rng.standard_normal(s) * size for k, s in m.SHAPES.items()}
    ctx, target = rng.integers(0, m.VOCABULARY + 1, (500, 2 * m.SIDE)), rng.integers(0, m.VOCABULARY, 500)
    h = np.maximum(net["e"][ctx].reshape(500, -1) @ net["w"] + net["b"], 0)
    kind, place = target // m.WORDS, target % m.WORDS
    inner = np.einsum("nh,nhw->nw", h, net["o"][kind]) + net["ob"][kind]
    want = m.softmax(h @ net["c"] + net["cb"])[np.arange(500), kind] + m.softmax(inner)[np.arange(500), place]
    got = m.log_probabilities(net, ctx, target, m.turned(net))
    assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_packed_counts_of_any_size():
    of, entries = toxicity.packed(np.array([0, 0, 1]), np.array([5, toxicity.BUCKETS - 1, 7]), np.array([3, 70_000, toxicity.MOST]))
    assert entries.dtype == np.uint32
    assert list(zip(of, entries // (toxicity.MOST + 1), entries & toxicity.MOST)) == [(0, 5, 3), *((0, toxicity.BUCKETS - 1, n) for n in (32_767, 32_767, 4_466)), (1, 7, 32_767)]
