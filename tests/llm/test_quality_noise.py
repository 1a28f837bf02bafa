"""Noise in ASCII is rejected by its compression, clean text of several scripts is not."""

import base64
import random
import string

import pytest
import zstandard

from weftgraph.llm import quality_rules

compress = zstandard.ZstdCompressor(level=3).compress


def kept(text):
    *_, failed, kept = quality_rules.measure(text.encode(), compress)
    assert not failed
    return kept


@pytest.mark.parametrize("size", [300, 700, 1500, 3000, 10_000, 70_000, 300_000])
def test_noise_is_rejected(size):
    r = random.Random(size)
    wrapped = base64.b64encode(r.randbytes(size * 3 // 4)).decode()
    lines = "\n".join(wrapped[k : k + 25] for k in range(0, len(wrapped), 25))
    printable = "".join(r.choice(string.printable[:95]) for _ in range(size))
    printable = " ".join(printable[k : k + 20] for k in range(0, size, 20))
    assert not kept(lines) and not kept(printable)


def test_noise_at_the_end_is_rejected():
    r = random.Random(1)
    words = ["".join(r.choice(["th", "er", "on", "an", "ed", "ing", "or"]) for _ in range(r.randint(1, 4))) for _ in range(3000)]
    prose = " ".join(words)[:4096]
    noise = base64.b64encode(r.randbytes(3000)).decode()
    assert kept(prose) and not kept(prose + "\n" + noise)


def test_clean_text_is_kept():
    r = random.Random(2)
    wide = [chr(0x4E00 + k) for k in r.sample(range(20_000), 3000)]
    for size in (700, 1500, 3000, 10_000):
        text = "".join(r.choices(wide, [1 / (k + 10) for k in range(3000)], k=size // 3))
        assert kept(" ".join(text[k : k + 8] for k in range(0, len(text), 8)))
