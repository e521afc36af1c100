"""Phrases against plain counting, whatever is routed by how many words."""

import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from cardwarden.llm import collocations as c
from cardwarden.llm import queries
from cardwarden.llm.oracle import ORACLE


def _plain(docs, least, top, longest=5):
    upper = {i: i + 32 for i in range(65, 91)}
    f: Counter = Counter()
    n: Counter = Counter()
    for _, lang, text in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(upper)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = {}
    frequent = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    for (lang, p), a in frequent.items():
        if any(q[0] == lang and len(q[1]) > len(p) and b >= a and any(q[1][i : i + len(p)] == p for i in range(len(q[1]))) for q, b in frequent.items()):
            continue
        cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        l, r = f[lang, p[: cut[1]]], f[lang, p[cut[1] :]]
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(p).encode(), l, r))
    rows = set()
    for lang, found in out.items():
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            rows.add((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return rows


def _docs(seed):
    rng = random.Random(seed)
    words = ["The", "of", "and", "ä", "\x00", "\xa0b", "\x1c", "é ", "x-y", "9"] + [f"w{i}" for i in range(30)]
    docs = []
    for i in range(120):
        picks = [rng.choice(words[: rng.choice([4, 10, 40])]) for _ in range(rng.randrange(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b", "!?"]) for w in picks)
        docs.append((i, rng.choice(["en", "en", "de", None, "und"]), text))
    docs += [(i, "en", "the of and the of and w1 w2 w3") for i in range(40)]  # repeated rows
    return docs + [(None, "en", "of The of"), (5, None, None), (6, "en", ""), (7, "fr", " .\t, "), (8, "en", "z" * 100_000 + " the of")]


@pytest.mark.parametrize(("crowded", "chunk"), [(1 << 18, 1 << 19), (40, 200), (8, 1)])
def test_phrases_equal_plain_counting(spark, monkeypatch, crowded, chunk):
    monkeypatch.setattr(c, "CROWDED", crowded)
    monkeypatch.setattr(c, "CHUNK", chunk // 6 or 1)
    monkeypatch.setattr(c, "KNOWN", 50)
    docs = _docs(crowded)
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, lang string, text string, n int, score string").repartition(5)
    for least, top in ((3, 2000), (6, 7)):
        rows = [tuple(r) for r in c.collocations(df, least=least, top=top).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == _plain(docs, least, top)


def test_tables_without_phrases(spark):
    kind = "doc_id long, lang string, text string"
    for rows in ([], [(1, None, None)], [(1, "en", "a b c")]):
        assert c.collocations(spark.createDataFrame(rows, kind)).count() == 0


def test_sort_gives_every_heavy_prefix():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 6, (4000, 5)).astype(np.int32)
    cut = rng.integers(1, 6, 4000)
    rows[np.arange(5) >= cut[:, None]] = -1
    weight = rng.integers(1, 9, 4000)
    for whole in (1, 3):
        for least in (1, 60):
            got = {(tuple(rows[p, :d].tolist()), d): s for p, d, s in c.multikey_quicksort(np.ascontiguousarray(rows.T), weight, whole, least)}
            want: Counter = Counter()
            for row, w in zip(rows.tolist(), weight.tolist()):
                for d in range(2, 6):
                    if row[d - 1] >= 0:
                        want[tuple(row[:d]), d] += w
            assert got == {k: v for k, v in want.items() if v >= least or k[1] < whole}


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    path = os.path.join(sf_dir, "documents.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.execute(ORACLE["op12_phrases"]).fetchall()
    got = queries.op12_phrases(spark, sf_dir).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
