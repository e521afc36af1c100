"""The compression rules read all of a text, and where in it junk lies decides nothing."""

import base64
import random

import pytest
import zstandard

from cardwarden.llm import compression

LETTERS = "etaoinshrdlucmfw"


def blocks(rng, n_prose, n_junk):
    """Prose of a few hundred words, and words of base64."""
    words = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = b""
    while len(prose) < n_prose:
        prose += rng.choice(words).encode() + b" "
    raw = base64.b64encode(rng.randbytes(n_junk))[:n_junk]
    return prose[:n_prose], b" ".join(raw[i : i + 12] for i in range(0, len(raw), 13))


@pytest.mark.parametrize("size", [1024, 4096])
def test_chunks_hold_every_byte_and_mirror(size):
    for n in (size, size + 1, size + size // 2, 2 * size - 1, 2 * size, 3 * size + 7, 6700, 8191, 50_001):
        places = compression.chunk_places(n, size)
        assert sorted({i for a, b in places for i in range(a, b)}) == list(range(n))
        assert places == sorted((n - b, n - a) for a, b in places)
        assert all(b - a == size for a, b in places)
        assert all(y[0] - x[0] <= size // 2 + 1 for x, y in zip(places, places[1:]))


@pytest.mark.parametrize("n_prose,n_junk", [(4200, 2500), (4200, 3200), (4200, 3900), (2200, 1500), (8300, 4000)])
def test_junk_first_or_last_has_one_verdict(n_prose, n_junk):
    press = zstandard.ZstdCompressor(level=3, write_content_size=False)
    rng = random.Random(n_prose + n_junk)
    for _ in range(20):
        prose, junk = blocks(rng, n_prose, n_junk)
        assert compression.judge(prose, press)[6]
        first, last = (compression.judge(t, press) for t in (junk + b" " + prose, prose + b" " + junk))
        assert not first[6] and not last[6]
