"""Indexes of a benchmark: built in tasks, one loaded at a time, the same hits in any number."""

import random

from pyspark.sql import functions as F

from cardwarden.llm import decontaminate as d


def tables(spark):
    """Documents that hold whole items and parts of them, beside repeated rows and odd ones."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(8, 30)))) for i in range(60)]
    docs = []
    for i in range(80):
        text = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        for item in rng.sample(items, rng.randint(0, 2)):
            held = item[1].split()
            at = rng.randint(0, len(text))
            text[at:at] = held if rng.random() < 0.6 else held[rng.randint(0, len(held) // 2) :]
        docs.append((i, " ".join(text)))
    docs += [docs[3], (None, items[0][1]), (90, None), (91, "")]
    # One item a third of all rows, one id with two texts, and rows that hold nothing.
    items += [items[0]] * 40 + [(1, items[2][1]), (None, "w1 w2"), (70, None), (71, ""), (72, " .,")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def brute_force(docs, items):
    """Every passage against every item, scored word by word."""
    known = [(i, d.alnum_words(t.encode())) for i, t in items if i is not None and t is not None]
    df = d.Counter(w for _, t in known for w in set(t))
    mean = sum(len(t) for _, t in known) / len(known)
    size = max(d.PASSAGE_WORDS, 2 * max(len(t) for _, t in known))
    found = []
    for doc_id, text in docs:
        words = d.alnum_words((text or "").encode())
        for item_id, held in sorted({(i, tuple(t)) for i, t in known if t}):
            norm = d.K1 * (1 - d.B + d.B * len(held) / mean)
            raw = {
                w: d.math.log(1 + (len(known) - df[w] + 0.5) / (df[w] + 0.5)) * n * (d.K1 + 1) / (n + norm)
                for w, n in d.Counter(held).items()
            }
            question, answer = d.split_item(list(held))
            best = None
            for start, stop in d.passages(len(words), size):
                here = words[start:stop]
                score = sum(raw.get(w, 0.0) for w in set(here)) / sum(raw.values())
                parts = d.grams(here, 3) | d.grams(here, 2) | set(here)
                have_q = d.overlap(d.grams(question), parts)
                have_a = d.overlap(d.grams(answer, 2), d.grams(here, 2) | set(here))
                if score >= d.THRESHOLD - 1e-9 and have_q >= 0.5 and have_a >= 0.5:
                    best = max(best or (0.0, 0), (round(score, 9), -start))
            if best:
                found.append((doc_id, item_id, -best[1], best[0]))
    return sorted(found, key=repr)


def test_hits_equal_brute_force_in_one_index_or_many(spark):
    docs, items = tables(spark)
    want = brute_force([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert len({r[:2] for r in want}) > 40
    for index_bytes in (d.INDEX_BYTES, 1500):
        got = d.find_leaks(docs, items, index_bytes=index_bytes)
        rows = [(r.doc_id, r.item_id, r.passage_start, round(r.score, 9)) for r in got.collect()]
        assert sorted(rows, key=repr) == want
        left = d.drop_leaks(docs.withColumn("shard", F.lit(1)), items, index_bytes=index_bytes)
        leaking = {r[0] for r in want}
        kept = [r.doc_id for r in docs.collect() if r.doc_id not in leaking]
        assert left.columns == ["doc_id", "text", "shard"]
        assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(map(str, kept))


def test_shards_split_the_benchmark_and_copies_do_not_crowd_one(spark):
    _, items = tables(spark)
    built, n_shards, _ = d.build_indexes(items, 1500)
    rows = built.collect()
    assert n_shards > 3 and len(rows) == len({r.shard for r in rows}) <= n_shards
    held = [d.pickle.loads(r["index"]) for r in rows]
    assert sum(len(i.items) for i in held) == 61
    assert max(len(i.items) for i in held) < 40


def test_empty_benchmarks_find_nothing(spark):
    docs, items = tables(spark)
    for none in (items.limit(0), items.where("text is null"), items.where("item_id = 72")):
        assert d.find_leaks(docs, none).count() == 0
        assert d.drop_leaks(docs, none).count() == docs.count()
