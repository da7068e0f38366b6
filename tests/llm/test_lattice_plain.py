"""Sums of probabilities against sums of logarithms."""

import numpy as np

from travelfields.llm import lattice_lm as L


def test_probabilities_sum_as_logarithms_do(monkeypatch):
    rng = np.random.default_rng(4)
    lattice = L.Lattice([b" a", b"ab", b"abc", b"bc", b"ca", b" ab", b"cab"])
    lattice.logp = np.log10(rng.dirichlet(np.ones(len(lattice.keys)) * 0.3) + 1e-9)
    words = ["".join(rng.choice(list("abcé"), n)) for n in (1, 2, 5, 9, 20, 26, 40, 90) for _ in range(4)]
    weight = rng.random(len(words))
    assert lattice._plain(20) and not lattice._plain(90)
    plain = lattice.score(words), lattice.expected(words, weight)
    monkeypatch.setattr(L, "PLAIN", 0.0)
    for a, b in zip(plain, (lattice.score(words), lattice.expected(words, weight))):
        assert np.isfinite(a).all() and np.allclose(a, b, rtol=1e-11, atol=1e-13)
