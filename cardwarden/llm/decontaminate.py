"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

The test items are indexed, the passages of the training documents are the queries. Scores are
shares of the item's score against itself, so one threshold suits short and long items alike, and
all items at or above it are retrieved. Each is then verified on question and answer words.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cardwarden.llm.words import alnum_words, record_batch, slim, tidy
from cardwarden.session import materialize

K1, B = 1.2, 0.75
THRESHOLD, QUESTION_OVERLAP, ANSWER_OVERLAP = 0.5, 0.5, 0.5
#: A passage is at least this many words; half of it is shared with the next one.
PASSAGE_WORDS, BLOCK, NGRAM = 128, 8, 3
#: The items of an index are cut into at most this many ranges. A term has one upper bound for
#: each range; most passages end at these bounds, summed for a whole document at once.
RANGES = 128
#: An index holds items of about this many bytes of text; more items make more indexes, and the
#: corpus meets them one after the other.
INDEX_BYTES = 8 << 20


def split_item(words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Question and answer: the last quarter of an item, three words at least, is its answer."""
    cut = len(words) - min(len(words), max(3, len(words) // 4))
    return words[:cut], words[cut:]


def grams(words: list[bytes], n: int = NGRAM) -> set[bytes]:
    n = min(n, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(wanted: set[bytes], found: set[bytes]) -> float:
    return len(wanted & found) / len(wanted) if wanted else 1.0


class Index:
    """Postings in blocks with their highest impact, for one set of items."""

    def __init__(self, items: Iterable[tuple[int, bytes]], df: dict[bytes, int], n_items: int, mean_words: float):
        self.items, postings = [], defaultdict(list)
        for item_id, text in sorted(items):
            words = alnum_words(text)
            norm = K1 * (1 - B + B * len(words) / max(mean_words, 1e-9))
            raw = {
                w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm)
                for w, tf in Counter(words).items()
            }
            total = sum(raw.values())
            if total <= 0:
                continue
            question, answer = split_item(words)
            for w, impact in raw.items():
                postings[w].append((len(self.items), impact / total))
            self.items.append((item_id, total, grams(question), grams(answer, 2), len(words)))
        self.postings, self.best = {}, {}
        for w, rows in postings.items():
            blocks = [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)]
            self.postings[w] = (
                [d for d, _ in rows],
                [x for _, x in rows],
                [b[-1][0] for b in blocks],
                [max(x for _, x in b) for b in blocks],
            )
            self.best[w] = max(x for _, x in rows)
        self.range = max(1, -(-len(self.items) // RANGES))
        self.rows = {w: i for i, w in enumerate(self.postings)}
        # The last row is for words that no item has.
        self.bounds = np.zeros((len(self.rows) + 1, max(1, -(-len(self.items) // self.range))), np.float32)
        for w, i in self.rows.items():
            docs, impacts = self.postings[w][:2]
            np.maximum.at(self.bounds[i], np.array(docs) // self.range, np.array(impacts))

    def retrieve(self, terms: Iterable[bytes], threshold: float) -> list[tuple[int, float]]:
        """All items that score at least ``threshold``: (item, score), by block-max WAND.

        Items in ranges whose bounds stay below are passed over.
        """
        terms = [w for w in terms if w in self.postings]
        most = self.bounds[[self.rows[w] for w in terms]].sum(0)
        open_ranges = np.flatnonzero(most >= threshold - 1e-5).tolist()
        if not open_ranges:
            return []
        cursors = [[self.postings[w], 0, self.best[w]] for w in sorted(terms) if w in self.postings]
        out, slack, end = [], threshold - 1e-9, len(self.items)

        def doc(c):
            return c[0][0][c[1]] if c[1] < len(c[0][0]) else end

        def seek(c, target):
            """To the first posting at or after ``target``, whole blocks at a time."""
            docs, lasts = c[0][0], c[0][2]
            block = c[1] // BLOCK
            while block < len(lasts) and lasts[block] < target:
                block += 1
            at = max(c[1], block * BLOCK)
            while at < len(docs) and docs[at] < target:
                at += 1
            c[1] = at

        while cursors:
            cursors = [c for c in cursors if c[1] < len(c[0][0])]
            cursors.sort(key=doc)
            bound, pivot = 0.0, None
            for i, c in enumerate(cursors):
                bound += c[2]
                if bound >= slack:
                    pivot = i
                    break
            if pivot is None:
                return out
            target = doc(cursors[pivot])
            while pivot + 1 < len(cursors) and doc(cursors[pivot + 1]) == target:
                pivot += 1
            near = bisect_left(open_ranges, target // self.range)
            if near == len(open_ranges):
                return out
            if open_ranges[near] * self.range > target:
                for c in cursors[: pivot + 1]:
                    seek(c, open_ranges[near] * self.range)
                continue
            # The blocks that hold the pivot bound its score more tightly.
            bound, reach = 0.0, end
            for c in cursors[: pivot + 1]:
                lasts = c[0][2]
                block = c[1] // BLOCK
                while block < len(lasts) and lasts[block] < target:
                    block += 1
                if block < len(lasts):
                    bound += c[0][3][block]
                    reach = min(reach, lasts[block])
            if bound < slack:
                # No item up to the end of these blocks, or before the next cursor, can pass.
                after = doc(cursors[pivot + 1]) if pivot + 1 < len(cursors) else end
                target = max(target + 1, min(reach + 1, after))
                for c in cursors[: pivot + 1]:
                    seek(c, target)
            elif doc(cursors[0]) == target:
                score = sum(c[0][1][c[1]] for c in cursors[: pivot + 1])
                if score >= slack:
                    out.append((target, score))
                for c in cursors[: pivot + 1]:
                    c[1] += 1
            else:
                for c in cursors[:pivot]:
                    seek(c, target)
        return out


def passages(n_words: int, size: int) -> list[tuple[int, int]]:
    """(first, end) of passages of an even ``size``, each half a passage after the last."""
    step = size // 2
    return [(s, min(s + size, n_words)) for s in range(0, max(1, n_words - size + step), step)] if n_words else []


def search(index: Index, text: bytes, size: int, threshold: float, question: float, answer: float) -> list[tuple]:
    """Verified hits of one document: best passage of each item."""
    words = alnum_words(text)
    row, last = index.rows.get, len(index.rows)
    ids = np.fromiter((row(w, last) for w in words), np.int64, len(words))
    if not len(words) or not index.items:
        return []
    hits: dict[int, tuple] = {}
    places = passages(len(words), size)
    for k in range(0, len(places), 64):
        hits = _search_part(index, words, ids, places[k : k + 64], size, threshold, question, answer, hits)
    return [hits[k] for k in sorted(hits)]


def _search_part(index, words, ids, places, size, threshold, question, answer, hits) -> dict[int, tuple]:
    """A stretch of neighbouring passages; repeated words count anew in these first bounds."""
    first, step = places[0][0], size // 2
    # A passage is two of these halves; words that no item has add nothing and are left out.
    edges = np.minimum(first + step * np.arange(len(places) + 2), places[-1][1])
    known = first + np.flatnonzero(ids[first : places[-1][1]] < len(index.rows))
    if not len(known):
        return hits
    cuts = np.searchsorted(known, edges)
    # The row of no item ends the bounds, so that an empty half after the last known word has a place.
    rows = np.append(ids[known], len(index.rows))
    halves = np.add.reduceat(index.bounds[rows], cuts[:-1], axis=0)
    halves[cuts[1:] == cuts[:-1]] = 0
    reach = (halves[:-1] + halves[1:]).max(1) >= threshold - 1e-3
    for start, stop in (p for p, r in zip(places, reach) if r):
        terms = {w for w, i in zip(words[start:stop], ids[start:stop]) if i < len(index.rows)}
        found = index.retrieve(terms, threshold)
        if not found:
            continue
        three, two = grams(words[start:stop]), grams(words[start:stop], 2)
        one = terms
        for item, score in found:
            item_id, total, q, a, n = index.items[item]
            have_q = overlap(q, three | two | one)
            have_a = overlap(a, two | one)
            if have_q >= question and have_a >= answer:
                row = (item_id, start, score, score * total, have_q, have_a)
                if item not in hits or (score, -start) > (hits[item][2], -hits[item][1]):
                    hits[item] = row
    return hits


HIT = "item_id long, passage_start long, score double, bm25 double, question_overlap double, answer_overlap double"


def build_indexes(benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> tuple[DataFrame, int, int]:
    """Indexes of at most about ``index_bytes`` of item text each, their number and the passage size.

    A row of the table (``shard``, ``index``) is one index, built by the task that its items and the
    weights of their words were shuffled to. Equal (id, text) items are one in the index, so that
    copies don't crowd a shard; term counts and lengths that weigh the items cover every row of the
    benchmark. A passage is twice the longest item at least, so every item lies whole in some
    passage that holds all of it.
    """
    items = benchmark.select(benchmark["item_id"], benchmark["text"].cast("binary").alias("text")).dropna()
    held = materialize(items.groupBy("item_id", "text").agg(F.count("*").alias("copies")), "items")
    size = held.agg(
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")
    ).first()
    n_shards = max(1, -(-size["bytes"] // index_bytes))
    held = held.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards)))
    term = T.StructType.fromDDL("shard long, copies long, word binary, tf long, n_words long")

    def terms(batches):
        for batch in batches:
            rows = []
            for shard, copies, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = alnum_words(text)
                rows += [(shard, copies, w, n, len(words)) for w, n in Counter(words).items()]
            yield record_batch(rows, to_arrow_schema(term))

    counted = materialize(held.select("shard", "copies", "text").mapInArrow(terms, term), "item-terms")
    total = counted.agg(F.sum(F.expr("tf * copies")).alias("words"), F.max("n_words").alias("longest")).first()
    n_items, mean_words = size["rows"], (total["words"] or 0) / max(1, size["rows"])
    df = counted.groupBy("word").agg(F.sum("copies").alias("df"))
    weights = counted.select("shard", "word").distinct().join(df, "word").select("shard", "word", "df")

    def build(items: pa.Table, weights: pa.Table) -> pa.Table:
        found = dict(zip(weights["word"].to_pylist(), weights["df"].to_pylist()))
        pairs = zip(items["item_id"].to_pylist(), items["text"].to_pylist())
        index = Index(pairs, found, n_items, mean_words)
        return pa.table({"shard": items["shard"][:1], "index": pa.array([pickle.dumps(index)], pa.binary())})

    grouped = held.select("shard", "item_id", "text").groupBy("shard").cogroup(weights.groupBy("shard"))
    built = materialize(grouped.applyInArrow(build, "shard long, index binary"), "item-indexes")
    return built, n_shards, max(PASSAGE_WORDS, 2 * (total["longest"] or 0))


def per_index(
    benchmark: DataFrame, index_bytes: int, search_with: Callable[[object, int, DataFrame | None], DataFrame]
) -> list[DataFrame]:
    """The frames ``search_with(index, passage size, last frame)``, an index at a time.

    All but the last are written before the next index is loaded and the last one's copies in the
    driver and the workers are dropped, so memory holds one index, however many there are.
    """
    built, n_shards, size = build_indexes(benchmark, index_bytes)
    context, done = benchmark.sparkSession.sparkContext, []
    for shard in range(n_shards):
        row = built.where(F.col("shard") == shard).first()
        index = context.broadcast(pickle.loads(row["index"]) if row else Index([], {}, 0, 0.0))
        frame = search_with(index, size, done[-1] if done else None)
        if shard + 1 < n_shards:
            frame = materialize(frame, "leaks")
            index.unpersist(blocking=False)
        done.append(frame)
    return done


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    question: float = QUESTION_OVERLAP,
    answer: float = ANSWER_OVERLAP,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """One row per document row and benchmark item that it leaks, with the best passage's scores.

    Null and empty texts, on either side, leak nothing; repeated documents get rows each, and so do
    items of one id with different texts, while rows of equal id and text are one item; a null
    document id stays null; an empty benchmark gives no rows. Other columns are not read. The corpus
    is scanned once per index and never shuffled.
    """
    rows = slim(docs, id_col, text_col)
    out = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(HIT).fields])
    arrow = to_arrow_schema(out)

    def search_with(index, size, _):
        @tidy
        def run(batches):
            for batch in batches:
                hits = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = search(index.value, text or b"", size, threshold, question, answer)
                    hits += [(doc_id, *hit) for hit in found]
                yield record_batch(hits, arrow)

        return rows.mapInArrow(run, out)

    return reduce(DataFrame.union, per_index(benchmark, index_bytes, search_with))


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    threshold: float = THRESHOLD,
    question: float = QUESTION_OVERLAP,
    answer: float = ANSWER_OVERLAP,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text leaks no item; judged in the scan itself."""

    def keep_with(index, size, kept):
        def judge(texts: pd.Series) -> pd.Series:
            found = [bool(search(index.value, t or b"", size, threshold, question, answer)) for t in texts]
            return pd.Series(found, dtype=bool)

        kept = docs if kept is None else kept
        return kept.where(~F.pandas_udf(judge, "boolean")(kept[text_col].cast("binary")))

    return per_index(benchmark, index_bytes, keep_with)[-1]
