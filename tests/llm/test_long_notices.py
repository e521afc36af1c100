"""Licence scans of long dense texts, against plain passes over the whole text."""

import random
import time

from cardwarden.llm import licenses

SCAN = licenses.Scanner(licenses.NOTICES, licenses.PHRASES)


def plain_spans(text):
    """(label, start, edits) by the regex library over the whole text."""
    return sorted(
        (label, text.count(" ", 0, m.start()), sum(m.fuzzy_counts))
        for label, notice, k in licenses.NOTICES
        for m in licenses.pattern(notice, k).finditer(text)
    )


def plain_base(raw):
    words = licenses.alnum_words(raw)
    places = []
    for phrase, label in licenses.PHRASES:
        wanted = [w.encode() for w in phrase.split()]
        places += [(i, label) for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def damaged(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", "x", text[at] + "q"]) + text[at + 1 :]
    return text


def test_filtered_places_hold_every_match():
    """Whole, damaged and cut notices between other words: nothing that the plain pass finds is lost."""
    rng = random.Random(11)
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            _, notice, k = rng.choice(licenses.NOTICES)
            parts.append(damaged(rng, notice, rng.randint(0, k + 2)))
            parts.append(" ".join(rng.choice(["alpha", "the", "under", "ß", "free"]) for _ in range(rng.randint(8, 20))))
        text = " ".join(" ".join(parts).split())
        assert sorted((s[0], s[1], s[3]) for s in SCAN.spans(text)) == plain_spans(text)


def test_base_columns_by_brute_force():
    rng = random.Random(12)
    pieces = ["under", "the", "MIT", "License", "apache", "license", "version", "2", "cc", "BY", "nc", "é", "x\0y", "20"]
    for _ in range(200):
        raw = "".join(rng.choice(pieces) + rng.choice([" ", "  ", "-", "\n", ".\t", "\0"]) for _ in range(rng.randint(0, 60))).encode()
        assert SCAN(raw)[:5] == plain_base(raw)
    phrases = " ".join(rng.choice([p for p, _ in licenses.PHRASES]) for _ in range(3000)).encode()
    assert SCAN(phrases)[:5] == plain_base(phrases)


def test_long_dense_texts_end_soon():
    rng = random.Random(13)
    cuts = [n[a : a + rng.randint(8, 16)] for _, n, _ in licenses.NOTICES for a in range(0, len(n), 5)]
    fragments = " ".join(rng.choice(cuts).strip() for _ in range(90_000))[: 1 << 20]
    exact = "under the mit license " * 48_000
    for text in (fragments, exact):
        start = time.perf_counter()
        SCAN(text.encode())
        assert time.perf_counter() - start < 20  # seconds on an idle core are far fewer
    assert SCAN(exact.encode())[1:4] == (48_000, 0, 4 * 47_999)
