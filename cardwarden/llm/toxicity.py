"""Toxicity by a classifier chain over the categories of the labels table.

The categories are predicted in order: poor quality, toxicity, and both at once. Each later linear
model also reads the earlier categories' probabilities. In training these come from models that
have not seen the row (out of fold), so a later model learns how far to trust them; the models
that score are fitted on the whole sample.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwarden.llm.linear import CHOSEN, SAMPLE, Chooser, Table, choose_features, collect_rows, labelled_sample, shares, sigmoid
from cardwarden.llm.words import give_back, map_texts, slim
from cardwarden.session import materialize

CATEGORIES = ("poor", "toxic", "poor_toxic")
FOLDS = 5
REJECT_AT = 0.5
FIELDS = "p_poor double, p_toxic double, p_poor_toxic double, rejected boolean"


@dataclass(frozen=True)
class Chain:
    """The fitted chain: chosen features, and weights of each category's model."""

    chosen: dict[int, int]
    weights: tuple[np.ndarray, ...]

    def scorer(self):
        find, n = Chooser(self.chosen), len(self.chosen)

        def score(text: bytes) -> list[float]:
            ids, extra = find(text), shares(text).tolist()
            out: list[float] = []
            for w in self.weights:
                dense = np.array([*extra, *out])
                out.append(float(sigmoid(w[ids].sum() + dense @ w[n:-1] + w[-1])))
            return out

        return score


def targets(quality: np.ndarray, toxic: np.ndarray) -> list[np.ndarray]:
    return [1.0 - quality, toxic, (1.0 - quality) * toxic]


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def fit_rows(rows: list, chosen: dict[int, int]) -> Chain:
    """Fit the chain on collected sample rows."""
    table = Table.of([r["ids"] for r in rows], np.array([r["shares"] for r in rows]), len(chosen))
    folds = np.array([fold_of(r["doc_id"]) for r in rows])
    quality, toxic = (np.array([float(r[c]) for r in rows]) for c in ("quality", "toxic"))
    everything = np.ones(len(rows), bool)
    weights = []
    for y in targets(quality, toxic):
        weights.append(table.fit(y, everything))
        if len(weights) == len(CATEGORIES):
            break
        unseen = np.zeros(len(rows))
        for k in range(FOLDS):
            w = table.fit(y, folds != k)
            unseen = np.where(folds == k, sigmoid(table.margin(w)), unseen)
        table = table.with_columns(unseen[:, None])
    return Chain(chosen, tuple(weights))


def fit_chain(docs: DataFrame, labels: DataFrame, allowed=None, sample: int = SAMPLE, chosen: int = CHOSEN) -> Chain:
    """Learn from the labelled rows of slim ``docs``; ``sample`` bounds how many are used.

    Without labelled rows every probability is the prior of an empty table, one half.
    """
    rows = labelled_sample(docs, labels, F.lit(True) if allowed is None else allowed, sample)
    rows = materialize(rows.where("text is not null"), "labelled")
    # Poor is the other value of quality, which the choice treats alike.
    keys = choose_features(rows, {"toxic": chosen, "quality": chosen // 3})
    index = {k: i for i, k in enumerate(keys)}
    found = collect_rows(rows, index)
    if not found:
        n = len(index) + shares(b"").size
        return Chain(index, tuple(np.zeros(n + i + 1) for i in range(len(CATEGORIES))))
    return fit_rows(found, index)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """One row per row of ``docs``: the three probabilities, and ``rejected`` at ``reject_at``.

    Null and empty texts are scored by the models' biases, as texts without features. Repeated
    rows and null ids get a row each; labels without a document, and null labels, are ignored.
    """
    rows = slim(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(fit_chain(rows, labels))

    def make():
        score = sent.value.scorer()

        def judge(text):
            p = score(text)
            return (*p, p[1] >= reject_at)

        return judge

    return map_texts(rows, make, FIELDS)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of ``docs``, all columns, that the chain does not reject; judged in the scan."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_chain(slim(docs, id_col, text_col), labels))

    @F.pandas_udf("boolean")
    def rejected(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = sent.value.scorer()
        try:
            for texts in parts:
                yield pd.Series([score(t or b"")[1] >= reject_at for t in texts], dtype=bool)
        finally:
            give_back()

    return docs.where(~rejected(docs[text_col].cast("binary")))
