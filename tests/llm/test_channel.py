"""Viterbi decoding of character lattices against scoring every reading of the full lattice."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tallyloom.llm.op8_toxicity import SPACED, SYMBOLS, Channel, symbol, symbols


def channel(rng: random.Random) -> Channel:
    """A model of random words, some of them the ones that spans hide."""
    words = ["hello", "idiot", "stupid", "assess", "tool", "lost", "class", "silly", *("".join(rng.choice("abdeghilost") for _ in range(rng.randrange(2, 7))) for _ in range(60))]
    text = " ".join(rng.choice(words) for _ in range(3000))
    s = np.concatenate([[0], symbols(np.frombuffer(text.encode(), np.uint8)), [0]])
    gram, n = np.unique((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], return_counts=True)
    return Channel(gram, n)


def score(model: Channel, reading: tuple[tuple[str, float], ...]) -> float:
    """Channel and model log probability of one reading: symbols one after the other, runs of what is no letter once, a word edge at the end."""
    line, total = [], sum(cost for _, cost in reading)
    for c in "".join(letters for letters, _ in reading):
        z = symbol(c) if c.isalpha() else 0
        if z or (line and line[-1]):
            line.append(z)
    if line and line[-1]:
        line.append(0)
    padded = [0, 0, *line]
    return total + sum(float(model.log[x, y, z]) for x, y, z in zip(padded, padded[1:], padded[2:], strict=False))


SPANS = ["h3ll0", "1d10t", "st*pid", "$tup1d", "a$$e$$", "t00l", "cl@ss!", "sss111", "helllo", "s1llly", "l0$t", "!d!0t", "7ool", "8 9", "aa", "h.e.l.l.o", "s i l l y", "t-0-0-l-s", "a a a s s", "i_d_i_o_t", "l o s s t t"]


@pytest.mark.parametrize("span", SPANS)
def test_decoding_finds_the_likeliest_reading(span: str) -> None:
    model = channel(random.Random(3))
    lattices = [model.spaced(span)] if SPACED.fullmatch(span) else []
    lattices.append(model.lattice("".join(c for c in span if c not in " .-_") if lattices else span))
    for places in map(list, lattices):
        readings = list(itertools.islice(itertools.product(*places), 300_000))
        assert len(readings) < 300_000
        best = max(score(model, r) for r in readings)
        found = model.decoded(iter(places))
        assert max(score(model, r) for r in readings if "".join(x for x, _ in r) == found) == pytest.approx(best, abs=1e-9)


def test_random_spans() -> None:
    rng = random.Random(9)
    model = channel(rng)
    for _ in range(150):
        places = list(model.lattice("".join(rng.choice("hilostae013@$!") for _ in range(rng.randrange(1, 8)))))
        readings = list(itertools.product(*places))
        best = max(score(model, r) for r in readings)
        found = model.decoded(iter(places))
        assert max(score(model, r) for r in readings if "".join(x for x, _ in r) == found) == pytest.approx(best, abs=1e-9)


def test_hidden_words_come_back() -> None:
    model = channel(random.Random(3))
    assert [model.restore(s) for s in ("1d10t", "$tup1d")] == ["idiot", "stupid"]
    assert "silly" in model.restore("s i l l y").split()
