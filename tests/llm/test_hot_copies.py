"""Near copies under hot keys: many copies of a text, many near copies, many rows of one id."""

import random

from cardwarden.llm import near_dedup


def _near(n, words, seed):
    """A text and ``n`` texts that differ from it, and from each other, in a word or two."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(9000)}" for _ in range(words)]
    out = [" ".join(base)]
    for i in range(n):
        other = list(base)
        other[rng.randrange(words)] = f"new{i}"
        out.append(" ".join(other))
    return out


def _brute(rows, size=5):
    """Least id reachable from each id, by all pairs."""
    sets = {}
    for i, text in rows:
        w = text.split()
        sets.setdefault(i, []).append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[a] for t in sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = {k: low if v == high else v for k, v in comp.items()}
    return comp


def test_hot_keys_are_salted_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_ROWS", 5)
    found, real = [], near_dedup._hot

    def seen(counts, key):
        out = real(counts, key)
        found.append((key, 0 if out is None else out.count()))
        return out

    monkeypatch.setattr(near_dedup, "_hot", seen)
    texts = _near(60, 120, 3) + _near(6, 90, 4) + [f"alone {i} a b c d {i} e f" for i in range(30)]
    texts += [texts[0]] * 40 + ["", "one", "one"]
    rows = list(enumerate(texts, 1))
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # A band key holds a 32nd of its bands' rows at most: more than an even task's share of 64.
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == _brute(rows)
    assert {k for k, n in found if n} >= {"key", "b", "print", "to"}
    assert all(n < 64 for _, n in found)


def test_copies_of_linked_ids_do_not_multiply(spark, monkeypatch):
    first, second = _near(1, 150, 6)
    rows = [(1, first)] * 300 + [(2, second)] * 200 + [(3, "another text of six words")]
    sizes, real = [], near_dedup._Finder.verified

    def verified(self, pairs, texts):
        sizes.append(texts.count())
        out = real(self, pairs, texts)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(near_dedup._Finder, "verified", verified)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).groupBy("doc_id", "component_id", "kept").count().collect()
    assert {tuple(r) for r in got} == {(1, 1, True, 300), (2, 1, False, 200), (3, 3, True, 1)}
    assert sizes and max(sizes) <= 2
