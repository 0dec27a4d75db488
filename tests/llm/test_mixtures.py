"""Expectation-maximisation and the choice of languages against plain loops over every document."""

from __future__ import annotations

import math

import numpy as np

from tallyloom.llm.op5_language import PENALTY, ROUNDS, mixtures


def plain_mixture(words: list[list[float]]) -> list[float]:
    """words: log likelihoods by language."""
    n = len(words[0])
    p = [[math.exp(max(x - max(w), -60.0)) for x in w] for w in words]
    allowed, best, value = list(range(n)), [0.0] * n, -math.inf
    while allowed:
        share = {k: 1 / len(allowed) for k in allowed}
        for _ in range(ROUNDS):
            total = dict.fromkeys(allowed, 0.0)
            for w in p:
                all_of = sum(w[k] * share[k] for k in allowed) + 1e-300
                for k in allowed:
                    total[k] += w[k] * share[k] / all_of
            share = {k: v / len(p) for k, v in total.items()}
        like = sum(math.log(sum(w[k] * share[k] for k in allowed) + 1e-300) for w in p)
        like -= PENALTY / 2 * (len(allowed) - 1) * math.log(max(len(p), 2))
        if like > value:
            value, best = like, [share.get(k, 0.0) for k in range(n)]
        allowed.remove(min(allowed, key=lambda k: (share[k], -k)))
    return best


def test_mixtures_equal_plain_loops() -> None:
    rng = np.random.default_rng(11)
    docs = []
    for n in (1, 2, 7, 40, 300, 300):
        mixed = rng.dirichlet(np.full(5, 0.4))
        own = rng.choice(5, n, p=mixed)
        logp = rng.normal(-20, 3, (n, 5))
        logp[np.arange(n), own] += rng.choice([0.0, 4.0, 15.0], n)
        docs.append(logp)
    begins = np.cumsum([0, *map(len, docs)])[:-1]
    got = mixtures(np.concatenate(docs), begins)
    for d, share in zip(docs, got, strict=True):
        assert np.allclose(share, plain_mixture(d.tolist()), atol=1e-9)


def test_a_language_of_one_word_in_a_hundred_is_kept_if_the_likelihood_says_so() -> None:
    logp = np.full((600, 3), -40.0)
    logp[:, 0] = -10.0
    logp[:6] = [-60.0, -10.0, -60.0]  # one in a hundred words can be of the second language alone
    share = mixtures(logp, np.array([0]))[0]
    assert 0.009 < share[1] < 0.011 and share[2] == 0.0


def test_ties_go_to_the_first_language_and_two_languages_are_told() -> None:
    assert mixtures(np.full((9, 3), -5.0), np.array([0]))[0].argmax() == 0
    logp = np.full((80, 3), -40.0)
    logp[:50, 0] = logp[50:, 2] = -10.0
    assert np.allclose(mixtures(logp, np.array([0]))[0], [50 / 80, 0.0, 30 / 80])
