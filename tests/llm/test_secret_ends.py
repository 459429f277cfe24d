"""Ends of long runs: one pass against scoring each end anew, and its time."""

import random
import time

import pytest

from quakeframe.llm import secret_scan


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    key = lambda n, alphabet: "".join(rng.choice(alphabet) for _ in range(n)).encode()
    kinds = {
        "hex": [key(40, "0123456789abcdef") for _ in range(200)],
        "access": [b"AKIA" + key(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(200)],
        "assign": [key(24, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(200)],
    }
    ordinary = [key(rng.randrange(3, 12), "etaoinshrdlu") for _ in range(500)]
    return secret_scan.fit_model(kinds, ordinary)


def test_one_pass_equals_each_end_anew(model):
    rng = random.Random(2)
    for k in range(200):
        n = rng.randrange(12, 300)
        token = "".join(rng.choice("abcdef0123456789=/AKIAZz+_.-" if k % 2 else "0123456789abcdef=/") for _ in range(n)).encode()
        places = [0, *(m.end() for m in secret_scan._SEPARATOR.finditer(token) if n - m.end() >= secret_scan.MIN_CANDIDATE)]
        for a in model.automata.values():
            assert a.score_ends(token, places) == pytest.approx([a.score(token[p:]) for p in places], rel=1e-9)
        assert model.backgrounds(token, places) == pytest.approx([model.background(token[p:]) for p in places], rel=1e-9)
        gains = [model.likelihood(token[p:]) for p in places]
        at, gain = model.best_end(token)
        assert gain == pytest.approx(max(gains), rel=1e-9) and gains[places.index(at)] == pytest.approx(max(gains), rel=1e-9)


def test_time_follows_the_length(model):
    rng = random.Random(3)
    run = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n)).encode()
    seconds = []
    for n in (100_000, 400_000):
        token = run(n)
        began = time.process_time()
        model.best_end(token)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 10 * seconds[0] + 1, seconds
    print(seconds)
