"""Operators on single texts and on copies, against brute force on small tables."""

import hashlib
import math
import random

import pytest
from oracle_check import connect, difference

from cardwarden.llm import compression, decontaminate, lattice, licenses, line_crf, mixing, near_dedup, substring_dedup, toxicity
from cardwarden.llm.url_filter import filter_urls

WORDS = [f"w{i:03d}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, tag int, runs string, key long, comp long, word string, score double"


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, exact and near copies, repeated rows, shared passages."""
    rng = random.Random(5)
    base, passage = prose(rng, 300), prose(rng, 70)
    near = base.split()
    near[100] = "changed"
    out = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (None, base), (None, None), (2, base), (8, prose(rng, 40000))]
    out += [(20 + i, prose(rng, 30) + " " + passage + "\n" + prose(rng, 30)) for i in range(12)]
    out += [(50 + i, prose(rng, 80)) for i in range(10)] + [(90, base.upper()), (91, "ß É " + base)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = [(i, t, "en", 1, "x", 2, 3, "y", 0.5) for i, t in rows]
    return spark.createDataFrame(clash, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (20, 0, 1), (21, 1, 0), (None, 1, 1), (999, 0, 0), (50, None, 1), (50, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    return spark.createDataFrame([(1, rows[11][1][:400]), (2, None), (3, ""), (3, "not in any document at all")], "item_id long, text string")


def key(row):
    return repr(row)


def test_urls_match_sql(spark, sf_dir):
    import __spark_entry__ as entry

    sql = entry.oracle_sql()["op2_url_filter"]
    assert difference(entry.queries()["op2_url_filter"](spark, sf_dir), connect(sf_dir), sql) is None


@pytest.mark.parametrize("blocks, size, n", [(200_000, 1 << 24, None), (0, -1, 64), (200_000, -1, 1)])
def test_url_filter_edges(spark, blocks, size, n):
    urls = ["http://A.com/x/", "https://www.a.com/x?utm_source=1", "http://b.org/es/1", None, "no scheme", "://", "http://a.com/y", "http://a.com/x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[0], "h")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("http://a.com/x",), ("http://a.com/x/",), (None,)], "url string")
    got = filter_urls(pages, listed, [("block", "b.org", "/es/"), ("allow", "org", "/")], broadcast_blocks=blocks, broadcast_bytes=size, n_blocks=n)
    assert {r.page_id: r.verdict for r in got.collect()} == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", None: "block"}
    assert not got.where("listed and not maybe_listed").count()
    assert filter_urls(pages, listed.limit(0)).where("verdict = 'block'").count() == 0


def test_compression(docs, empty, rows):
    import zstandard

    press = zstandard.ZstdCompressor(level=3, write_content_size=False)
    want = [(i, *compression.judge((t or "").encode(), press)) for i, t in rows]
    assert sorted(map(key, (tuple(r) for r in compression.compression_bands(docs).collect()))) == sorted(map(key, want))
    assert compression.compression_bands(empty).count() == 0
    assert compression.repeated_words(b"a b c x a b c y".split()) == 6
    assert compression.duplicate_lines(b"a\n\na\n \nb") == 1
    assert not compression.judge(b"spam and ham " * 200, press)[6]


def test_repeats_by_brute_force(docs, empty, rows):
    window = 50
    least = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[j : j + window])
            least[k] = min(i, least.get(k, i))
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for j in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        left = [x for j, x in enumerate(w) if j not in gone]
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    got = [tuple(r) for r in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert substring_dedup.remove_repeats(empty).count() == 0
    cut = substring_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    kept = {(r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in cut.collect()}
    assert kept == {(i, h) for i, _, _, h in want}


def test_crowded_minimisers_change_nothing(docs, monkeypatch):
    plain = sorted(map(key, substring_dedup.remove_repeats(docs).collect()))
    monkeypatch.setattr(substring_dedup, "HOT_COUNT", 0)
    monkeypatch.setattr(substring_dedup, "HOT_SAMPLE", 1)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 600)
    assert sorted(map(key, substring_dedup.remove_repeats(docs).collect())) == plain


@pytest.mark.parametrize("crowded, size", [(64, 2), (1, 2), (64, 5)])
def test_near_duplicates_by_brute_force(docs, empty, rows, crowded, size):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets.append((i, frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else frozenset()))
    ids = {i for i, s in sets if i is not None}
    root = {i: i for i in ids}
    for _ in ids:
        for i, s in sets:
            for j, t in sets:
                if i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                    root[i] = root[j] = min(root[i], root[j])
    want = [(i, len(s), root.get(i), i is None or root[i] == i) for i, s in sets]
    got = near_dedup.near_duplicates(docs, size=size, crowded=crowded)
    assert sorted(map(key, (tuple(r) for r in got.collect()))) == sorted(map(key, want))
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Copies with changes of their own: components in crowded buckets stay whole."""
    rng = random.Random(3)
    base = prose(rng, 60).split()
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.sample(range(60), rng.choice([1, 2, 3, 4, 5])):
            w[j] = f"n{i}x{j}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(x) for x in zip(t.split(), t.split()[1:])} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for crowded in (16, 1000):
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2, crowded=crowded)
        assert {r.doc_id: r.component_id for r in got.collect()} == {i: find(i) for i in sets}


def test_sketches_fill_and_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 5000):
        assert near_dedup.sketch(rng.integers(0, 2**63, n).astype(np.uint64)).max() < np.iinfo(np.uint64).max
    agree = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 1200).astype(np.uint64)
        agree.append((near_dedup.sketch(x[:900]) == near_dedup.sketch(x[100:1000])).mean())
    assert abs(np.mean(agree) - 0.8) < 0.02


def test_licences(docs, empty, rows):
    scan = licenses.Scanner(licenses.NOTICES, licenses.PHRASES)
    assert scan(b"Under the MIT License. under the mit license")[:6] == (8, 2, 0, 4, "mit", "mit")
    fuzzy = scan(b"it is relesed under the M1T licence, so there")
    assert (fuzzy[1], fuzzy[4], fuzzy[5]) == (0, "", "") and scan(b"it is relesed under the MIT licence")[5] == "mit"
    assert scan(b"under the mit licenses")[1] == 0
    assert scan("© CC BY-NC 4.0".encode())[4] == "cc-by-nc"
    for text in ("Licensed under the Apache Licence, Version 2.0", "copyright (c) all rights reservd", "nothing here", "this work is licensed under teh gnu general public license version 3"):
        joined = b" ".join(licenses.alnum_words(text.encode())).decode()
        want = {label for label, n, k in licenses.NOTICES if licenses.pattern(n, k).search(joined)}
        assert {s[0] for s in scan.spans(joined)} == want
    got = licenses.scan_licenses(docs)
    assert sorted(map(key, (r.doc_id for r in got.collect()))) == sorted(map(key, (i for i, _ in rows)))
    assert licenses.scan_licenses(empty).count() == 0


def test_wand_finds_all_above_threshold():
    from collections import Counter

    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(WORDS[:60]) for _ in range(rng.randint(5, 30))).encode()) for i in range(80)]
    df = Counter(w for _, t in items for w in set(t.split()))
    index = decontaminate.Index(items, df, len(items), 15.0)
    for _ in range(200):
        terms = {w.encode() for w in rng.sample(WORDS[:60], rng.randint(1, 40))}
        scores = Counter()
        for w in terms & set(index.postings):
            for d, x in zip(*index.postings[w][:2]):
                scores[d] += x
        for threshold in (0.2, 0.5, 0.8):
            want = sorted((d, round(s, 9)) for d, s in scores.items() if s >= threshold - 1e-9)
            assert sorted((d, round(s, 9)) for d, s in index.retrieve(terms, threshold)) == want


def test_leaks(docs, empty, benchmark, rows):
    got = decontaminate.find_leaks(docs, benchmark)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(20, 1)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark, index_bytes=50).collect()} == {(20, 1)}
    left = decontaminate.drop_leaks(docs, benchmark)
    assert left.columns == docs.columns and left.count() == len(rows) - 1
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.find_leaks(empty, benchmark).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = {"▁a": -1.0, "a": -2.0, "b": -2.5, "ab": -1.5, "▁": -3.0, "▁ab": -4.0, "<0x63>": -5.0, "</s>": -1.0}
    grid = lattice.Lattice(pieces)

    def total(text):
        if not text:
            return 1.0
        out = sum(math.exp(pieces[text[:k]]) * total(text[k:]) for k in range(1, len(text) + 1) if text[:k] in pieces)
        return out + (math.exp(grid._fallback(ord(text[0]))) * total(text[1:]) if text[0] not in pieces else 0.0)

    words = [b"ab", b"abab", b"c", b"", b"aabcb", b"b"]
    for w, p in zip(words, grid.log_probabilities(words)):
        want = math.log(total("▁" + w.decode())) if w else -1.0
        assert p == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("frequent", [100_000, 5])
def test_lattice_scores(docs, empty, rows, frequent):
    import zlib
    from collections import Counter

    learned = [(i, t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter()
    for _, t in learned:
        counts.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    got = sorted(lattice.lattice_scores(docs, frequent=frequent).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    want = []
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), b""]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens)
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(tokens), sum(counts[x] > 0 for x in tokens), n, base))
    want.sort(key=lambda r: (str(r[0]), r[2]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5] and g.base_score == pytest.approx(w[5], rel=1e-9) and g.score < 0
    assert lattice.lattice_scores(empty).count() == 0


def test_line_field_marginals():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    unary, edge = rng.normal(size=(2, 4)), rng.normal(size=(2, 2))
    p, z, _ = line_crf.forward_backward(unary, np.array([4, 2]), edge)
    for d, n in ((0, 4), (1, 2)):
        weight = {s: math.exp(sum(unary[d][i] * s[i] for i in range(n)) + sum(edge[a, b] for a, b in zip(s, s[1:]))) for s in itertools.product((0, 1), repeat=n)}
        assert math.log(sum(weight.values())) == pytest.approx(z[d])
        for i in range(n):
            assert p[d, i] == pytest.approx(sum(w for s, w in weight.items() if s[i]) / sum(weight.values()))


def test_learned_operators_on_odd_rows(docs, empty, labels, rows):
    ids = sorted(map(key, (i for i, _ in rows)))
    none = labels.limit(0)
    for known in (labels, none):
        scored = line_crf.line_quality(docs, known).collect()
        assert sorted(key(r.doc_id) for r in scored) == ids and all(0 <= r.score <= 1 for r in scored)
        judged = toxicity.score_toxicity(docs, known).collect()
        assert sorted(key(r.doc_id) for r in judged) == ids and all(0 <= r.p_toxic <= 1 for r in judged)
        mixed = mixing.mix_documents(docs, known).collect()
        assert sorted(key(r.doc_id) for r in mixed) == ids and all(r.rate >= 0 for r in mixed)
    assert line_crf.line_quality(empty, labels).count() == toxicity.score_toxicity(empty, labels).count() == mixing.mix_documents(empty, labels).count() == 0
    assert toxicity.drop_toxic(docs, none, reject_at=0.6).count() == len(rows)


def test_learned_operators_on_held_out_documents(spark):
    """Half of the labels are withheld; quality and toxicity are found in the other half."""
    sf = "/root/testdata/sf0.1"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = line_crf.line_quality(docs, known).where("held_out").join(known, "doc_id")
    assert scored.selectExpr("avg(int(predicted = quality))").first()[0] > 0.95
    learn, rest = known.where("crc32(string(doc_id)) % 2 = 0"), known.where("crc32(string(doc_id)) % 2 = 1")
    judged = toxicity.score_toxicity(docs.join(known.select("doc_id"), "doc_id", "left_semi"), learn).join(rest, "doc_id")
    rates = judged.selectExpr("avg(CASE WHEN toxic = 1 THEN int(rejected) END)", "avg(CASE WHEN toxic = 0 THEN int(rejected) END)").first()
    print("held-out recall and false alarms of toxicity", rates)
    assert rates[0] > 0.6 and rates[1] < 0.02


def test_rates_meet_targets(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    p = rng.dirichlet([2, 1, 0.5], 500)
    rows = [(int(n), *map(float, q)) for n, q in zip(rng.integers(0, 900, 500), p)]
    members = spark.createDataFrame(rows, "n long, p0 double, p1 double, p2 double")
    goal = np.array([0.5, 0.3, 0.2]) * sum(r[0] for r in rows)
    found, reached = mixing.fit_rates(members, goal)
    assert np.abs(reached - goal).max() < 1e-5 * goal.sum()
    rates = [r[0] for r in members.select(mixing.rate_of(found)).collect()]
    assert min(rates) >= 0 and np.allclose([sum(r * x[0] * x[k + 1] for r, x in zip(rates, rows)) for k in range(3)], goal, rtol=1e-4)


def test_features_are_chosen_as_by_hand(spark):
    """One pass over two columns picks what counting each column alone picks, ties by key."""
    from cardwarden.llm.linear import choose_features, keys_of

    rng = random.Random(8)
    rows = []
    for i in range(400):
        toxic, quality = rng.random() < 0.3, rng.random() < 0.6
        words = [rng.choice(WORDS[:40]) for _ in range(12)] + ["vile"] * toxic + ["neat"] * quality
        rows.append((" ".join(words), int(toxic), int(quality)))
    rows += [("", 1, 0), (None, 0, 1)]
    want = []
    for column, most in ((1, 5), (2, 3)):
        n = [sum(not r[column] for r in rows), sum(r[column] for r in rows)]
        counts = {}
        for r in rows:
            for k in {k for w in set((r[0] or "").split()) for k in keys_of(w.encode())}:
                counts.setdefault(k, [0, 0])[r[column]] += 1
        z = {}
        for k, (a, b) in counts.items():
            p, q = (b + 0.5) / (n[1] + 1), (a + 0.5) / (n[0] + 1)
            z[k] = abs(p - q) / math.sqrt(p * (1 - p) / n[1] + q * (1 - q) / n[0]) if a + b >= 4 else 0
        want += sorted((k for k in z if z[k] > 3), key=lambda k: (-z[k], k))[:most]
    table = spark.createDataFrame(rows, "text string, toxic int, quality int").repartition(3)
    table = table.withColumn("text", table["text"].cast("binary"))
    got = choose_features(table, {"toxic": 5, "quality": 3})
    assert got == list(dict.fromkeys(want)) and keys_of(b"vile")[0] in got and keys_of(b"neat")[0] in got
    assert choose_features(table.where("toxic = 2"), {"toxic": 5, "quality": 3}) == []
