"""Soft-membership mixing: document rates that bring expected domain tokens to their targets.

A classifier fitted on the labels table gives every document a posterior over domains. Rates are
never negative; the expected tokens of a domain are the sum over documents of rate x tokens x
posterior. Of the rates that minimise the squares of what the domain totals miss, those closest to 1
are sought. They are max(0, 1 - multipliers . posterior), the multipliers being one number a domain:
where these are the token residuals over a small weight, no step along the projected gradient
remains. The fit is projected-gradient least squares on the rates, begun near its end: Newton steps on
the multipliers are the warm start. Each step or round is one aggregation of a few numbers over all
documents, and rates are computed in the scan, never stored between rounds.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwarden.llm.linear import CHOSEN, SAMPLE, Chooser, Table, choose_features, collect_rows, labelled_sample, shares, sigmoid
from cardwarden.llm.words import map_texts, slim
from cardwarden.session import materialize

DOMAINS = ("good", "poor", "toxic")
#: Shares of all tokens that the domains shall have.
TARGETS = {"good": 0.85, "poor": 0.10, "toxic": 0.05}
ROUNDS, TOLERANCE = 25, 1e-6
#: Projected-gradient rounds after the warm start, at most.
POLISH = 30
#: Weight of the rates' distance from 1, as a share of all tokens, against the squared residuals.
DISTANCE = 1e-8
#: Shorter steps, tried in one aggregation where a full one does not help.
STEPS = tuple(0.25**i for i in range(1, 12))


@dataclass(frozen=True)
class Posterior:
    """One linear model per domain; the posterior is their probabilities over their sum."""

    chosen: dict[int, int]
    weights: tuple[np.ndarray, ...]

    def scorer(self):
        find, n = Chooser(self.chosen), len(self.chosen)

        def score(text: bytes) -> list[float]:
            ids, dense = find(text), shares(text)
            p = np.array([sigmoid(w[ids].sum() + dense @ w[n:-1] + w[-1]) for w in self.weights])
            return (p / p.sum()).tolist()

        return score


def fit_posterior(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Posterior:
    """Toxic rows are domain toxic, others good or poor by quality; at most about ``sample`` rows.

    Without labelled rows all domains are equally likely.
    """
    rows = materialize(labelled_sample(docs, labels, F.lit(True), sample).where("text is not null"), "labelled")
    keys = choose_features(rows, {"toxic": CHOSEN, "quality": CHOSEN // 3})
    index = {k: i for i, k in enumerate(keys)}
    found = collect_rows(rows, index)
    if not found:
        return Posterior(index, tuple(np.zeros(len(index) + shares(b"").size + 1) for _ in DOMAINS))
    table = Table.of([r["ids"] for r in found], np.array([r["shares"] for r in found]), len(index))
    toxic, quality = (np.array([float(r[c]) for r in found]) for c in ("toxic", "quality"))
    members = ((1 - toxic) * quality, (1 - toxic) * (1 - quality), toxic)
    everything = np.ones(len(found), bool)
    return Posterior(index, tuple(table.fit(y, everything) for y in members))


def rate_of(multipliers: list[np.ndarray]) -> Column:
    """The rate after the rounds so far: from 1, each takes off a product and stops at zero."""
    rate = F.lit(1.0)
    if not multipliers:
        return rate
    rounds = F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in multipliers])

    def step(r, m):
        dot = sum((F.get(m, F.lit(k)) * F.col(f"p{k}") for k in range(1, len(DOMAINS))), F.get(m, F.lit(0)) * F.col("p0"))
        return F.greatest(F.lit(0.0), r - dot)

    return F.aggregate(rounds, rate, step)


def fit_rates(members: DataFrame, goal: np.ndarray, rounds: int = ROUNDS, polish: int = POLISH) -> tuple[list[np.ndarray], np.ndarray]:
    """Multipliers whose rates bring sum(rate * n * p) to ``goal``, and the totals reached.

    ``members`` has n and p0..; the driver sees a few sums a round. A domain whose goal is NaN is
    free. With m multipliers and r rates, Newton steps minimise the convex dual
    sum(n r^2) / 2 + goal . m + weight m^2 / 2, whose gradient is goal + weight m - totals. They are
    the warm start; projected-gradient rounds on the rates themselves follow.
    """
    k = len(DOMAINS)
    held = [i for i in range(k) if np.isfinite(goal[i])]
    n = F.col("n").cast("double")
    total = float(members.agg(F.sum(n)).first()[0] or 0.0)
    weight = DISTANCE * max(1.0, total)

    def value_of(m: np.ndarray) -> Column:
        return F.sum(n * rate_of([m]) * rate_of([m])) / 2 + F.lit(float(goal[held] @ m[held] + weight * (m @ m) / 2))

    def measure(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Dual value, totals and Hessian without the weight."""
        r = F.col("r")
        active = F.when(r > 0, n).otherwise(F.lit(0.0))
        grams = [F.sum(active * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}_{j}") for i in held for j in held if i <= j]
        totals = [F.sum(n * F.col(f"p{i}") * r).alias(f"t{i}") for i in range(k)]
        row = members.withColumn("r", rate_of([m])).agg(value_of(m).alias("v"), *totals, *grams).first()
        gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in held] for i in held])
        return row["v"] or 0.0, np.array([row[f"t{i}"] or 0.0 for i in range(k)]), gram

    at = np.zeros(k)
    value, reached, gram = measure(at)
    for _ in range(rounds):
        slope = goal[held] + weight * at[held] - reached[held]
        if np.abs(slope).max() <= TOLERANCE / 100 * max(1.0, total):
            break
        way = np.zeros(k)
        way[held] = -np.linalg.solve(gram + weight * np.eye(len(held)), slope)
        found = measure(at + way)
        if found[0] >= value:
            row = members.agg(*[value_of(at + s * way).alias(f"v{i}") for i, s in enumerate(STEPS)]).first()
            values = [x or 0.0 for x in row]
            best = int(np.argmin(values))
            if values[best] >= value:
                break
            way = STEPS[best] * way
            found = measure(at + way)
        at, (value, reached, gram) = at + way, found
    return _descended(members, goal, held, [at], reached, total, polish)


def _descended(members: DataFrame, goal: np.ndarray, held: list[int], found: list[np.ndarray], reached: np.ndarray, total: float, rounds: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Projected-gradient rounds of the least squares |totals - goal|^2 from the rates of ``found``.

    In each every document's rate moves against its own gradient, the posterior times the tokens
    that its domains have too many, and stops at zero. The sums run over all documents; the rates
    themselves follow from the rounds' multipliers, so a round costs one pass and no new table. The
    step is one over a bound of the curvature. The rounds end when the rates stand still.
    """
    n = F.col("n").cast("double")
    curve = float(members.agg(F.sum(sum((n * F.col(f"p{i}") * F.col(f"p{i}") for i in held), F.lit(0.0)))).first()[0] or 0.0)
    for _ in range(rounds if curve > 0 else 0):
        step = np.zeros(len(DOMAINS))
        step[held] = (reached[held] - goal[held]) / curve
        both = members.withColumns({"r": rate_of(found), "s": rate_of([*found, step])})
        totals = [F.sum(n * F.col(f"p{i}") * F.col("s")) for i in range(len(DOMAINS))]
        moved, *sums = both.agg(F.sum(n * F.abs(F.col("s") - F.col("r"))), *totals).first()
        if moved <= TOLERANCE / 100 * max(1.0, total):
            break
        found, reached = [*found, step], np.array(sums)
    return found, reached


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", budget: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, n_tokens, p_good, p_poor, p_toxic, rate, expected_tokens and targets_met.

    Targets are shares of ``budget`` tokens, by default all that the named domains hold; a domain
    without a target is free. A null or empty text has no tokens and takes the rate its posterior
    gives, which moves no total. Repeated rows and null ids count as rows of their own; an empty
    table gives no rows. If no non-negative rates meet the targets, the rates go towards the least
    squares, ``targets_met`` is false in every row and a warning names goals and totals reached.
    """
    targets = targets or TARGETS
    rows = slim(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(fit_posterior(rows, labels))

    def make():
        score = sent.value.scorer()
        return lambda text: (len(text.split()), *score(text))

    columns = ", ".join(f"p{i} double" for i in range(len(DOMAINS)))
    members = materialize(map_texts(rows, make, f"n long, {columns}"), "members")
    named = [i for i, d in enumerate(DOMAINS) if d in targets]
    if budget is None:
        held = sum((F.col(f"p{i}") for i in named), F.lit(0.0)) if len(named) < len(DOMAINS) else F.lit(1.0)
        budget = float(members.agg(F.coalesce(F.sum(F.col("n") * held), F.lit(0.0))).first()[0])
    goal = np.array([budget * targets[d] / sum(targets.values()) if d in targets else np.nan for d in DOMAINS])
    found, reached = fit_rates(members, goal, rounds)
    met = bool(np.abs(reached - goal)[named].max() <= 10 * TOLERANCE * max(1.0, budget))
    if not met:
        said = ", ".join(f"{DOMAINS[i]} {goal[i]:.1f} wanted, {reached[i]:.1f} reached" for i in named)
        warnings.warn(f"no rates found that meet the targets, in tokens: {said}", stacklevel=2)
    rated = members.withColumn("rate", rate_of(found))
    posteriors = [F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return rated.select("doc_id", F.col("n").alias("n_tokens"), *posteriors, "rate", (F.col("rate") * F.col("n")).alias("expected_tokens"), F.lit(met).alias("targets_met"))
