"""The first bounds of a document's passages lose no hit."""

import random
from collections import Counter

from cardwarden.llm import decontaminate as d


def test_search_equals_plain_scoring_of_every_passage():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words[:90]) for _ in range(rng.randint(6, 40))).encode()) for i in range(150)]
    df = Counter(w for _, t in items for w in set(t.split()))
    index = d.Index(items, df, len(items), 20.0)
    for n in (0, 3, 60, 128, 129, 700, 9000):
        text = [rng.choice(words) for _ in range(n)]
        for _ in range(n // 300):
            at = rng.randrange(n)
            text[at:at] = items[rng.randrange(150)][1].decode().split()
        found = d.search(index, " ".join(text).encode(), 128, 0.5, 0.0, 0.0)
        want = {}
        for start, stop in d.passages(len(text), 128):
            terms = {w.encode() for w in text[start:stop]} & set(index.postings)
            scores = Counter()
            for w in terms:
                for item, x in zip(*index.postings[w][:2]):
                    scores[item] += x
            for item, x in scores.items():
                if x >= 0.5 - 1e-9:
                    want[item] = max(want.get(item, 0), round(x, 9))
        assert {index.items.index(next(i for i in index.items if i[0] == r[0])): round(r[2], 9) for r in found} == want


def test_last_known_word_counts_in_short_documents():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.sample(words, rng.randint(6, 20))).encode()) for i in range(40)]
    df = Counter(w for _, t in items for w in set(t.split()))
    index = d.Index(items, df, len(items), 13.0)
    narrow = 0
    for item, text in items:
        held = text.split()
        impact = {w: dict(zip(*index.postings[w][:2]))[item] for w in held}
        for k in range(1, len(held) + 1):
            score = sum(impact[w] for w in held[:k])
            last = impact[held[k - 1]]
            narrow += score - last < 0.5 <= score
            # Alone, after words that no item has, and before a half passage of such words.
            for doc in (held[:k], [b"zz"] * 20 + held[:k], held[:k] + [b"zz"] * 90):
                found = {r[0] for r in d.search(index, b" ".join(doc), 128, 0.5, 0.0, 0.0)}
                assert (item in found) == (score >= 0.5 - 1e-9)
    assert narrow == len(items)
