"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of its characters and words, and those of the
lines before and after; a transition weight ties neighbours. The field learns from documents whose
label stands for all of their lines. A document's mean marginal, lines weighted by length, is
mapped to a probability by a logistic curve fitted on the same documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cardwarden.llm.linear import labelled_sample, sigmoid
from cardwarden.llm.words import id_remainder, record_batch, slim

#: Documents that the field is fitted on, and the most lines one of them may have.
SAMPLE, SAMPLE_LINES = 4000, 400
HELD_OUT_MODULUS, GOOD_AT = 5, 0.3
_MARKS, _UPPER, _DIGITS = b"#*$%&<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
N_OWN = 12
N_FEATURES = 3 * N_OWN


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines that hold a word; a text without any has one empty line."""
    lines = [x for x in text.split(b"\n") if x.strip()] or [b""]
    rows, seen = [], set()
    for line in lines:
        n, words = max(1, len(line)), line.split()
        k = max(1, len(words))
        marked = sum(w[-1:] in (b"*", b"#", b"$", b"%", b"&", b"!") for w in words)
        rows.append((
            1.0, np.log1p(n) / 8, (len(line) - len(line.translate(None, _MARKS))) / n * 5,
            (len(line) - len(line.translate(None, _UPPER))) / n, (len(line) - len(line.translate(None, _DIGITS))) / n,
            line.count(b"|") / k, line.count(b"!") / k, marked / k, 1 - len(set(words)) / k,
            float(line in seen), min(3.0, n / k / 8), float(k <= 2),
        ))
        seen.add(line)
    own = np.array(rows, np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    return np.hstack([own, before, after]), np.array([max(1, len(x)) for x in lines], np.float64)


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(p) for p in parts)
    x = np.zeros((len(parts), longest, *parts[0].shape[1:]), np.float64)
    for i, p in enumerate(parts):
        x[i, : len(p)] = p
    return x, np.array([len(p) for p in parts])


def forward_backward(unary: np.ndarray, sizes: np.ndarray, edge: np.ndarray):
    """Marginals of state 1 per line, log-normaliser, and expected transitions, in log space.

    ``unary`` [documents, lines] is the score of state 1 (state 0 scores nothing), ``edge`` the
    2 x 2 transition scores. Lines beyond a document's size are ignored.
    """
    n, t = unary.shape
    u = np.stack([np.zeros_like(unary), unary], 2)
    alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    alpha[:, 0] = u[:, 0]
    for i in range(1, t):
        alpha[:, i] = u[:, i] + np.logaddexp(alpha[:, i - 1, :1] + edge[0], alpha[:, i - 1, 1:] + edge[1])
    for i in range(t - 2, -1, -1):
        nxt = beta[:, i + 1] + u[:, i + 1]
        now = np.logaddexp(nxt[:, :1] + edge[:, 0], nxt[:, 1:] + edge[:, 1])
        beta[:, i] = np.where((i + 1 < sizes)[:, None], now, 0.0)
    last = alpha[np.arange(n), sizes - 1]
    z = np.logaddexp(last[:, 0], last[:, 1])
    p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None])
    moves = np.zeros((2, 2))
    if t > 1:
        live = np.arange(1, t)[None, :] < sizes[:, None]
        for a in (0, 1):
            for b in (0, 1):
                s = alpha[:, :-1, a] + edge[a, b] + u[:, 1:, b] + beta[:, 1:, b] - z[:, None]
                moves[a, b] = np.exp(np.where(live, s, -np.inf)).sum()
    return p, z, moves


@dataclass(frozen=True)
class Field:
    weights: np.ndarray
    edge: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def means(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted mean marginal of each document, computed in groups of similar size."""
        out = np.zeros(len(docs))
        order = sorted(range(len(docs)), key=lambda i: len(docs[i][0]))
        at = 0
        while at < len(order):
            # A group holds at most about 20,000 padded lines, or one document.
            width = len(docs[order[min(at + 255, len(order) - 1)]][0])
            group = order[at : at + max(1, min(256, 20_000 // width))]
            at += len(group)
            unary, sizes = _padded([docs[i][0] @ self.weights for i in group])
            p, _, _ = forward_backward(unary, sizes, self.edge)
            for row, i in enumerate(group):
                length = docs[i][1]
                out[i] = (p[row, : len(length)] * length).sum() / length.sum()
        return out

    def scores(self, docs) -> np.ndarray:
        m = np.clip(self.means(docs), 1e-6, 1 - 1e-6)
        return sigmoid(self.slope * np.log(m / (1 - m)) + self.offset)


def fit_field(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 120, l2: float = 1e-3) -> Field:
    """Maximise the conditional likelihood of the lines' labels; each document counts once."""
    weights, edge = np.zeros(N_FEATURES), np.zeros((2, 2))
    if len(docs) == 0 or labels.min() == labels.max():
        rate = (labels.sum() + 0.5) / (len(docs) + 1.0)
        return Field(weights, edge, 0.0, float(np.log(rate / (1 - rate))))
    order = np.argsort([len(d[0]) for d in docs], kind="stable")
    groups = []
    for k in range(0, len(order), 512):
        ids = order[k : k + 512]
        x, sizes = _padded([docs[i][0] for i in ids])
        live = np.arange(x.shape[1])[None, :] < sizes[:, None]
        groups.append((x, sizes, live, labels[ids]))
    m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    theta = np.zeros(N_FEATURES + 4)
    for step in range(1, steps + 1):
        weights, edge = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        grad = np.zeros_like(theta)
        lines = 0
        for x, sizes, live, y in groups:
            p, _, moves = forward_backward(x @ weights, sizes, edge)
            off = np.where(live, y[:, None] - p, 0.0)
            seen = np.zeros((2, 2))
            seen[1, 1], seen[0, 0] = ((sizes - 1) * y).sum(), ((sizes - 1) * (1 - y)).sum()
            grad[:N_FEATURES] -= np.einsum("ntf,nt->f", x, off)
            grad[N_FEATURES:] -= (seen - moves).ravel()
            lines += sizes.sum()
        grad = grad / lines + l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field = Field(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))
    mean = np.clip(field.means(docs), 1e-6, 1 - 1e-6)
    slope, offset = _logistic(np.log(mean / (1 - mean)), labels)
    return Field(field.weights, field.edge, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A logistic curve of one variable by Newton steps, with a small ridge."""
    design, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = sigmoid(design @ w)
        h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (p - y) + 1e-2 * w)
        w = w - np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, allowed, sample: int = SAMPLE) -> Field:
    """Fit on at most about ``sample`` labelled documents of at most ``SAMPLE_LINES`` lines."""
    rows = labelled_sample(docs, labels, allowed, sample)
    out = T.StructType.fromDDL("doc_id long, quality long, n int, x binary, lengths binary")
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            made = []
            for doc_id, quality, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x, lengths = line_features(text or b"")
                if len(x) <= SAMPLE_LINES:
                    made.append((doc_id, quality, len(x), x.tobytes(), lengths.tobytes()))
            yield record_batch(made, arrow)

    typed = rows.select(F.col("doc_id").cast("long"), F.col("quality").cast("long"), "text")
    found = sorted(typed.mapInArrow(run, out).collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    docs_of = [(np.frombuffer(r["x"], np.float32).reshape(r["n"], -1), np.frombuffer(r["lengths"], np.float64)) for r in found]
    return fit_field(docs_of, np.array([float(r["quality"]) for r in found]))


def line_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_lines.

    Learned from documents whose id's checksum modulo 5 is not 0; text alone is read for a score.
    A null or empty text is one empty line. Rows with a null id are scored, not learned from, and
    not held out; repeated rows get a row each; labels that are null or lack a document are
    ignored, and without usable labels every score is one half.
    """
    rows = slim(docs, id_col, text_col)
    rest = id_remainder(F.col("doc_id"), HELD_OUT_MODULUS)
    sent = docs.sparkSession.sparkContext.broadcast(train(rows, labels, rest != 0, sample))
    held = rows.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "text")
    fields = T.StructType.fromDDL("held_out boolean, score double, predicted int, n_lines long")
    out = T.StructType([rows.schema["doc_id"], *fields.fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            ids, held, texts = (batch.column(i).to_pylist() for i in range(3))
            docs_of = [line_features(t or b"") for t in texts]
            scores = sent.value.scores(docs_of).tolist() if docs_of else []
            made = [(d, h, s, int(s >= GOOD_AT), len(x[0])) for d, h, s, x in zip(ids, held, scores, docs_of)]
            yield record_batch(made, arrow)

    return held.mapInArrow(run, out)
