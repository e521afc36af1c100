"""Settings of the scoring engine."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from cardwarden.schema import NOMINAL_ARITY


@dataclass(frozen=True)
class EngineConfig:
    """One immutable bundle of settings, passed to every operator that needs one."""

    # The defaults below must stay as they are for equal results.
    history_hours: int = 120
    days_before_training: int = 3
    delay_days: int = 2
    train_days: int = 2
    feedback_days: int = 4
    alerts_per_day: int = 20
    batch_candidates: int = 100
    n_tree: int = 10
    genuine_per_fraud: int = 1
    min_shard_rows: int = 10
    feedback_trees: int = 100
    prior_risk: float = 0.002809
    default_amount: float = 88.0
    default_age: int = 42
    unscored: float = 0.1
    trigger_interval: str = "180 seconds"

    # What the source takes in for one batch at most: Kafka messages or, of a folder, files. None: all.
    max_per_trigger: int | None = None
    # A new stream starts with what arrived at or after this time (epoch milliseconds). None: all there is.
    start_ms: int | None = None

    # Logical shards of the training set; each shard grows up to ``n_tree`` trees.
    n_shards: int = 1
    # Trees grow until pure; MLlib accepts at most 30 levels.
    tree_depth: int = 30
    # Single-tree fits submitted to the cluster at the same time.
    fit_parallelism: int = 8

    # Batch folders of closed hours are folded once there are this many more than hours.
    spare_folders: int = 200
    # A join side is broadcast only after it was counted at or below this many rows.
    broadcast_rows: int = 200_000
    # A join key with more rows than this is spread over several tasks.
    hot_rows: int = 2_000_000

    # A batch of no more rows is stored by one task, without a shuffle.
    one_task_rows: int = 20_000

    # Thresholds that a tree tries for each amount; must not be below the largest nominal domain.
    max_bins: int = 32
    # Number of codes of each nominal feature; a dictionary with more of them widens it.
    arity: Mapping[str, int] = field(default_factory=lambda: dict(NOMINAL_ARITY), hash=False)

    def __post_init__(self):
        if self.batch_candidates < self.alerts_per_day:
            raise ValueError("batch_candidates below alerts_per_day would lose alerts")
        if self.max_per_trigger is not None and self.max_per_trigger < 1:
            raise ValueError("max_per_trigger must be at least 1")
        if self.max_bins < max(self.arity.values()):
            raise ValueError("max_bins must not be below the largest nominal domain")

    @property
    def live_delayed_models(self) -> int:
        return max(1, self.train_days - 1)
