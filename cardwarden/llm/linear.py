"""Linear classifiers of texts: features, selection over Spark, logistic fits on a bounded sample.

Features of a text are the presence of chosen words and word beginnings, and a few shares of its
characters, words and lines. Words are chosen by how unevenly two classes use them, counted in
Spark over the sample; only the chosen ones reach the driver, which fits the weights.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cardwarden.llm.compression import duplicate_lines
from cardwarden.llm.words import alnum_words, record_batch, tidy
from cardwarden.session import materialize

#: Labelled documents that a classifier is fitted on, at most about this many.
SAMPLE = 12_000
#: Chosen word features, and the least documents a feature must be in.
CHOSEN, LEAST_DOCS = 1500, 4
BEGINNINGS = (5, 6, 7, 8)
_MARKS = b"#*$%&|<>"
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
N_SHARES = 9


def shares(text: bytes) -> np.ndarray:
    """Dense features of a text, each about 0 to 1."""
    n = max(1, len(text))
    marks = n - len(text.translate(None, _MARKS)) if text else 0
    upper = n - len(text.translate(None, _UPPER)) if text else 0
    digits = n - len(text.translate(None, _DIGITS)) if text else 0
    words = text.split()
    lines = text.count(b"\n") + 1
    k = max(1, len(words))
    return np.array([
        marks / n, upper / n, digits / n, text.count(b"!") / n, text.count(b"|") / n,
        duplicate_lines(text) / lines, 1 - len(set(words)) / k,
        min(1.0, np.log1p(k) / 10), min(1.0, n / k / 20),
    ], np.float32)


def keys_of(word: bytes) -> list[int]:
    """Features of a word: itself and its beginnings, as 32-bit checksums."""
    return [zlib.crc32(b"w" + word), *(zlib.crc32(b"b" + word[:n]) for n in BEGINNINGS if len(word) > n)]


@dataclass
class Chooser:
    """Finds the chosen features in a text, with a bounded memory of words seen."""

    chosen: dict[int, int]
    seen: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def __call__(self, text: bytes) -> list[int]:
        found: set[int] = set()
        if len(self.seen) > 200_000:
            self.seen.clear()
        for word in set(alnum_words(text)):
            ids = self.seen.get(word)
            if ids is None:
                ids = tuple(self.chosen[k] for k in keys_of(word) if k in self.chosen)
                self.seen[word] = ids
            if ids:
                found.update(ids)
        return sorted(found)


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = SAMPLE) -> DataFrame:
    """Documents with labels (doc_id, text, quality, toxic): all, or a share chosen by the id's hash
    that gives about ``sample`` rows. ``docs`` are slim; rows with null labels are left out. Of the
    rows that share an id one stands for all, so no id outweighs the others or breaks the bound."""
    known = labels.select("doc_id", "quality", "toxic").dropna().dropDuplicates(["doc_id"]).where(allowed)
    n = known.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(1, n)))
    few = known.where(part)
    # At most about ``sample`` rows, so the broadcast has a proven bound.
    rows = docs.join(F.broadcast(few), "doc_id").withColumn("_h", F.xxhash64("text"))
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "quality", "toxic"), "_h").alias("_r"))
    return one.select("doc_id", "_r.text", "_r.quality", "_r.toxic")


def choose_features(rows: DataFrame, chosen: dict[str, int], least: int = LEAST_DOCS) -> list[int]:
    """The features whose share of documents differs most between the values of each column.

    ``chosen`` names 0/1 columns and how many features each may bring. All are counted in one pass
    over ``rows``: per feature its documents, and those among them with a 1 in each column.
    """
    columns = list(chosen)
    names = ["n", *(f"pos{i}" for i in range(len(columns)))]
    out = T.StructType.fromDDL(", ".join(["key long", *(f"{c} long" for c in names)]))
    arrow = to_arrow_schema(out)

    @tidy
    def run(batches):
        seen: dict[bytes, list[int]] = {}

        def keys(text: bytes) -> set[int]:
            if len(seen) > 200_000:
                seen.clear()
            out: set[int] = set()
            for word in set(alnum_words(text)):
                of_word = seen.get(word)
                if of_word is None:
                    of_word = seen[word] = keys_of(word)
                out.update(of_word)
            return out

        for batch in batches:
            # One counter per combination of labels; -1 counts the documents themselves.
            found: dict[tuple, Counter] = {}
            *flags, texts = (batch.column(i).to_pylist() for i in range(len(columns) + 1))
            for text, *marks in zip(texts, *flags):
                into = found.setdefault(tuple(map(bool, marks)), Counter())
                into.update(keys(text or b""))
                into[-1] += 1
            for marks, counts in found.items():
                n = np.fromiter(counts.values(), np.int64, len(counts))
                made = [np.fromiter(counts, np.int64, len(counts)), n, *(n * m for m in marks)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], schema=arrow)

    counted = rows.select(*columns, "text").mapInArrow(run, out).groupBy("key").agg(*(F.sum(c).alias(c) for c in names))
    counted = materialize(counted.where((F.col("n") >= least) | (F.col("key") == -1)), "features")
    size = counted.where("key = -1").first()
    best: list[int] = []
    for i, column in enumerate(columns):
        n_pos, n_all = (size[f"pos{i}"], size["n"]) if size else (0, 0)
        n_neg = n_all - n_pos
        if not n_pos or not n_neg:
            continue
        p = (F.col(f"pos{i}") + 0.5) / (n_pos + 1.0)
        q = (F.col("n") - F.col(f"pos{i}") + 0.5) / (n_neg + 1.0)
        z = F.abs(p - q) / F.sqrt(p * (1 - p) / n_pos + q * (1 - q) / n_neg)
        ranked = counted.where("key <> -1").select("key", z.alias("z")).where("z > 3")
        best += [r["key"] for r in ranked.orderBy(F.desc("z"), "key").limit(chosen[column]).collect()]
    return list(dict.fromkeys(best))


def collect_rows(rows: DataFrame, chosen: dict[int, int]) -> list:
    """(doc_id, quality, toxic, ids, shares) of the bounded sample, in order of the id."""
    sent = rows.sparkSession.sparkContext.broadcast(chosen)
    out = T.StructType.fromDDL("doc_id long, quality long, toxic long, ids array<int>, shares array<float>")
    arrow = to_arrow_schema(out)

    @tidy
    def run(batches):
        find = Chooser(sent.value)
        for batch in batches:
            made = [(d, q, t, find(x or b""), shares(x or b"")) for d, q, t, x in zip(*(batch.column(i).to_pylist() for i in range(4)))]
            yield record_batch(made, arrow)

    typed = rows.select(F.col("doc_id").cast("long"), F.col("quality").cast("long"), F.col("toxic").cast("long"), "text")
    return sorted(typed.mapInArrow(run, out).collect(), key=lambda r: (r["doc_id"], r["ids"]))


@dataclass
class Table:
    """A sparse design: ids of chosen features per row, then dense columns."""

    indptr: np.ndarray
    ids: np.ndarray
    dense: np.ndarray
    n_chosen: int

    @classmethod
    def of(cls, ids: list[list[int]], dense: np.ndarray, n_chosen: int) -> Table:
        sizes = np.array([len(i) for i in ids], np.int64)
        flat = np.array([x for i in ids for x in i], np.int64)
        return cls(np.concatenate([[0], np.cumsum(sizes)]), flat, np.asarray(dense, float).reshape(len(ids), -1), n_chosen)

    def with_columns(self, more: np.ndarray) -> Table:
        return Table(self.indptr, self.ids, np.hstack([self.dense, more]), self.n_chosen)

    def margin(self, w: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(self.dense)), np.diff(self.indptr))
        sparse = np.bincount(row, weights=w[self.ids], minlength=len(self.dense)) if len(self.ids) else 0.0
        return sparse + self.dense @ w[self.n_chosen : -1] + w[-1]

    def fit(self, y: np.ndarray, use: np.ndarray, steps: int = 250, l2: float = 1.0) -> np.ndarray:
        """Logistic weights (chosen, dense, bias) on the rows ``use``, by adaptive gradient steps.

        Without both classes the bias alone carries the rate.
        """
        w = np.zeros(self.n_chosen + self.dense.shape[1] + 1)
        n = use.sum()
        rate = (y[use].sum() + 0.5) / (n + 1.0)
        w[-1] = np.log(rate / (1 - rate))
        if not n or y[use].min() == y[use].max():
            return w
        row = np.repeat(np.arange(len(self.dense)), np.diff(self.indptr))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for k in range(1, steps + 1):
            g = (sigmoid(self.margin(w)) - y) * use / n
            grad = np.concatenate([np.bincount(self.ids, weights=g[row], minlength=self.n_chosen), self.dense.T @ g, [g.sum()]])
            grad[:-1] += l2 * w[:-1] / n
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return w


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
