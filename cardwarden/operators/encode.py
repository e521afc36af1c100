"""Dictionary encoding: category to risk, category to integer code."""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.operators.joins import hot_keys, spread_join
from cardwarden.session import materialize

# Dictionary variable of each encoded field.
RISK_VARIABLES = {
    "cat1": "cat1",
    "cat2": "cat2",
    "merchant": "merchant",
    "merchantarea": "TERM_COUNTRY",
}
ID_VARIABLES = {"nationality": "nationality", "gender": "GENDER", "cat3": "cat3", "cat4": "cat4"}
VARIABLES = frozenset([*RISK_VARIABLES.values(), *ID_VARIABLES.values()])

#: A variable with at most so many levels, and characters in them, is looked up in a literal: without a
#: join, which would take a job for every field of every batch. Others are broadcast or shuffled.
LITERAL_LEVELS, LITERAL_CHARS = 256, 20_000
_BUCKETS = 32


def _bucket(level: Column) -> Column:
    return F.pmod(F.xxhash64(level), F.lit(_BUCKETS)).cast("int")


def _literals(found: list[Row]) -> dict[str, tuple[str, str]]:
    """Per variable its levels as JSON: a map from level to id and one to risk for each hash bucket.

    A variable with a repeated level, or a risk that JSON can't tell, has none.
    """
    levels = defaultdict(list)
    for row in found:
        levels[row["variable"]].append(row)
    out = {}
    for variable, rows in levels.items():
        once = len({r["level"] for r in rows}) == len(rows)
        finite = all(r["risk"] is None or math.isfinite(r["risk"]) for r in rows)
        if once and finite and sum(len(r["level"]) for r in rows) <= LITERAL_CHARS:
            maps = [({}, {}) for _ in range(_BUCKETS)]
            for r in rows:
                for part, value in zip(maps[r["bucket"]], (r["id"], r["risk"])):
                    part[r["level"]] = value
            out[variable] = tuple(json.dumps(part) for part in zip(*maps))
    return out


@dataclass(frozen=True)
class Dictionary:
    """Entries (variable, level, id, risk), one per variable and level.

    ``small`` names the variables whose counted levels may be broadcast, ``codes`` the number of
    codes of each variable, from its highest id, and ``literals`` has the levels of those with few.
    """

    entries: DataFrame
    small: frozenset[str] = VARIABLES
    codes: dict[str, int] = field(default_factory=dict)
    literals: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    _columns: dict[tuple[str, str], Column] = field(default_factory=dict, init=False, repr=False, compare=False)

    @classmethod
    def of(cls, entries: DataFrame, cfg: EngineConfig) -> Dictionary:
        """Measure every variable by itself, so one long list makes no other lookup a shuffle."""
        known = entries.where(F.col("variable").isin(*VARIABLES)).groupBy("variable")
        sizes = known.agg(F.count("*").alias("n_levels"), F.max("id").alias("top")).collect()
        large = {r["variable"] for r in sizes if r["n_levels"] > cfg.broadcast_rows}
        codes = {r["variable"]: r["top"] + 1 for r in sizes if r["top"] is not None}
        most = min(LITERAL_LEVELS, cfg.broadcast_rows)
        few = [r["variable"] for r in sizes if r["n_levels"] <= most]
        listed = entries.where(F.col("variable").isin(few) & F.col("level").isNotNull())
        rows = listed.select("variable", "level", "id", "risk", _bucket(F.col("level")).alias("bucket"))
        return cls(entries, VARIABLES - large, codes, _literals(rows.collect()) if few else {})

    def literal(self, field: str, variable: str, value: str) -> Column:
        """The ``id`` or ``risk`` of the field's level, or null, from the literal of its variable."""
        key = field, value
        if key not in self._columns:
            of_risk = value == "risk"
            buckets = F.from_json(
                F.lit(self.literals[variable][of_risk]), f"array<map<string,{'double' if of_risk else 'int'}>>"
            )
            level = F.col(f"{field}_level")
            self._columns[key] = F.try_element_at(F.get(buckets, _bucket(level)), level)
        return self._columns[key]

    def widened(self, cfg: EngineConfig) -> EngineConfig:
        """Settings whose nominal domains, and with them ``max_bins``, hold all codes in use."""
        arity = dict(cfg.arity)
        for name, variable in ID_VARIABLES.items():
            arity[name] = max(arity[name], self.codes.get(variable, 0))
        return replace(cfg, arity=arity, max_bins=max(cfg.max_bins, *arity.values()))


def _lookup(df: DataFrame, d: Dictionary, field: str, variable: str, value: str, cfg: EngineConfig):
    """Left join of one field to its levels; the result column is ``_<field>``."""
    level = f"{field}_level"
    found = d.entries.where(F.col("variable") == variable).select(
        F.col("level").alias(level), F.col(value).alias(f"_{field}")
    )
    if variable in d.small:
        return df.join(F.broadcast(found), level, "left")
    # Too many levels to broadcast: one shuffle for this field, its hot levels salted.
    counts = materialize(df.groupBy(level).agg(F.count("*").alias("_rows")), "levels")
    hot = hot_keys(counts, [level], "_rows", cfg.hot_rows, cfg.broadcast_rows)
    return spread_join(df, found, [level], "tx_id", hot)


def _encode(df: DataFrame, d: Dictionary, variables: dict[str, str], value: str, unknown, cfg: EngineConfig):
    """Replace the ``*_level`` columns by the value of their level."""
    coded, joined = {}, []
    for field, variable in variables.items():
        if variable in d.literals:
            found = d.literal(field, variable, value)
        else:
            df, found = _lookup(df, d, field, variable, value, cfg), F.col(f"_{field}")
            joined.append(f"_{field}")
        coded[field] = F.coalesce(found, F.lit(unknown))
    return df.withColumns(coded).drop(*joined, *[f"{f}_level" for f in variables])


def encode_risk(df: DataFrame, d: Dictionary, cfg: EngineConfig) -> DataFrame:
    """Replace the ``*_level`` columns of the risk-coded fields by the risk of their level."""
    return _encode(df, d, RISK_VARIABLES, "risk", cfg.prior_risk, cfg)


def encode_id(df: DataFrame, d: Dictionary, cfg: EngineConfig) -> DataFrame:
    """Replace the ``*_level`` columns of the id-coded fields by the id of their level."""
    return _encode(df, d, ID_VARIABLES, "id", 0, cfg)
