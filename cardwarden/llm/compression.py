"""Quality rules by compression: zstandard ratios of whole documents and of overlapping chunks.

Repetitive text compresses far better than prose of its length, random or encoded text far worse.
The ratio of a short text is higher for reasons of format alone, so each length has its own band.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from cardwarden.llm.words import map_texts, slim

#: (from how many bytes, lowest ratio, highest ratio) of a whole document.
DOCUMENT_BANDS = (
    (0, 0.0, 9.9), (160, 0.40, 0.90), (400, 0.36, 0.80), (1000, 0.30, 0.70),
    (3000, 0.26, 0.62), (10000, 0.22, 0.58), (40000, 0.18, 0.58),
)
#: (lowest, highest) ratio of a full chunk; ``BAD_CHUNKS`` is the share of chunks allowed outside.
CHUNK_BYTES, CHUNK_BAND, BAD_CHUNKS = 4096, (0.22, 0.65), 0.25
#: Every text also has chunks of this size, or is one; they are held to the document band of theirs.
SHORT_CHUNK_BYTES = 1024
LEVEL = 3

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
_SYMBOLS = tuple(bytes([c]) for c in b"#*$%&|<>")

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)


def repeated_words(words: Sequence[bytes]) -> int:
    """Words inside a 3-word window that the text holds at least twice."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pairs = ids[:-2] * len(known) + ids[1:-1]
    if len(known) ** 3 >= 2**63:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    lines = [line for line in text.split(b"\n") if line.strip()]
    seen.update(lines)
    return len(lines) - len(seen)


def band_of(n_bytes: int, bands=DOCUMENT_BANDS) -> tuple[float, float]:
    return [b[1:] for b in bands if n_bytes >= b[0]][-1]


def chunk_places(n_bytes: int, size: int) -> list[tuple[int, int]]:
    """(first, end) of equal chunks at even distances of half a chunk at most, which hold every byte
    of a text of at least ``size`` bytes; the places are the same counted from either end."""
    last = n_bytes - size
    steps = -(-last // (size // 2)) | 1
    half = [last * i // steps for i in range(steps // 2 + 1)]
    return [(a, a + size) for a in sorted({*half, *(last - a for a in half)})]


def judge(text: bytes, compressor: zstandard.ZstdCompressor, bands=DOCUMENT_BANDS) -> tuple:
    words = text.split()
    chars = len(b"".join(words).decode("utf-8", "replace"))
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * len(words)
    ratio = len(compressor.compress(text)) / len(text) if text else 0.0
    low, high = band_of(len(text), bands)
    bad_of = []
    for size, band in ((SHORT_CHUNK_BYTES, band_of(SHORT_CHUNK_BYTES, bands)), (CHUNK_BYTES, CHUNK_BAND)):
        if len(text) >= size:
            ratios = [len(compressor.compress(text[a:b])) / size for a, b in chunk_places(len(text), size)]
            bad_of.append((sum(not band[0] <= r <= band[1] for r in ratios), len(ratios)))
    if text and not bad_of:
        bad_of.append((int(not low <= ratio <= high), 1))
    kept = not failed and low <= ratio <= high and all(bad <= BAD_CHUNKS * n for bad, n in bad_of)
    symbols = sum(text.count(s) for s in _SYMBOLS)
    return (len(words), chars, symbols, duplicate_lines(text), repeated, failed, kept, ratio, sum(n for _, n in bad_of), sum(bad for bad, _ in bad_of))


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=DOCUMENT_BANDS) -> DataFrame:
    """One row per row of ``docs``: its counts, its ratios, ``base_failed`` and ``kept``.

    A null or empty text has zero counts and fails the base rule; so does a text without words.
    Repeated rows and null ids get one row each; an empty table gives none; other columns of
    ``docs`` are not read. The chunks of either size overlap and hold all of a text, so junk counts
    wherever it lies; ``n_chunks`` and ``n_bad_chunks`` cover both sizes. Texts are judged whole, one at a time, in a scan without a shuffle.
    """

    def make():
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        return lambda text: judge(text, compressor, bands)

    return map_texts(slim(docs, id_col, text_col), make, FIELDS)
