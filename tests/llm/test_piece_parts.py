"""Pre-tokens that go through the library as one text."""

import random

import numpy as np

from quakeframe.llm import piece_codec
from quakeframe.llm.token_counts import default_model, processor


def test_one_text_gives_the_ids_of_each():
    c = piece_codec.Codec(default_model())
    rng = random.Random(4)
    letters = "abcdeEXYZ019.,;:-_é日\U0001f600\x00\t▁"
    parts = [" " * rng.randrange(1, 4) + "".join(rng.choices(letters[:-1], k=rng.randrange(12))) for _ in range(300)]
    parts += ["\n" * rng.randrange(1, 4) + "".join(rng.choices(letters[:-1], k=rng.randrange(12))) for _ in range(300)] + [" ", "  ", "\n", " <s>", " </s>", " <unk>", " <0x0A>"]
    rng.shuffle(parts)
    calls, library = [], c._library
    c._library = lambda texts: (calls.append(len(texts)), library(texts))[1]
    got = c._parts(parts)
    assert calls == [1]
    assert got == [np.array(x[2:], np.int32).tobytes() for x in library(["\n" + p for p in parts])]
    assert got == [np.array(x[2:], np.int32).tobytes() for x in processor(c.path).encode(["\n" + p for p in parts])]
    # Without fixed widths each part goes by itself, with the same ids.
    c.widths[:] = 0
    assert c._parts(parts) == got and len(parts) in calls
