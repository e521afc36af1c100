"""One micro-batch: clock, day roll, card features, scores, alerts, commit."""

from __future__ import annotations

from concurrent.futures import Future
from contextlib import ExitStack, nullcontext
from dataclasses import dataclass
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.functions.clock import DAY_MS, HOUR_MS, with_time_fields
from cardwarden.operators import alerts as al
from cardwarden.operators.bags import bags_of_history, delayed_window, recent_window
from cardwarden.operators.encode import Dictionary, encode_id, encode_risk
from cardwarden.operators.history import (
    batch_cards,
    finished,
    rolled_stats,
)
from cardwarden.operators.joins import fits_broadcast, hot_keys, spread_join
from cardwarden.operators.models import score, train_delayed, train_feedback
from cardwarden.operators.parse import accepted, parse_lines, rejects
from cardwarden.plans.schedule import DayPlan, day_plan, live_after
from cardwarden.session import beside, give_back, materialize, scratch_scope, start_beside
from cardwarden.sources.tables import Fenced, Tables, current_tables
from cardwarden.streaming.registry import ModelRegistry


@dataclass
class Progress:
    """What one batch knows of the stream so far; becomes the next committed state."""

    origin_ms: int
    clock_ms: int
    day: int
    models: list[str]
    forest: str | None
    alerts_batch: int | None

    @property
    def clock_hour(self) -> int:
        return (self.clock_ms - self.origin_ms) // HOUR_MS


class Engine:
    def __init__(self, tables: Tables, dictionary: Dictionary, cfg: EngineConfig = EngineConfig()):
        self.spark = tables.spark
        self.tables = tables
        self.dictionary = dictionary
        self.cfg = cfg = dictionary.widened(cfg)
        self.models = ModelRegistry(tables)
        self.epoch = tables.claim()
        # Lines, id and parsed rows of the batch that was prepared.
        self._ahead: tuple[DataFrame, int, Future] | None = None

    def process_batch(
        self, lines: DataFrame, batch_id: int, following: tuple[DataFrame, int] | None = None
    ) -> None:
        """Run one batch of lines (``tx_id``, ``value``); safe to run again with the same id.

        A caller that has the lines and id of the ``following`` batch already gets them parsed while this one runs.

        The newest engine of a root is the one that writes: once another one was made, a batch
        raises ``Fenced`` before it writes and again before it would commit. Intermediate tables are dropped when the batch ends.
        """
        with scratch_scope(self.spark):
            self._process(lines, batch_id, following)

    def _prepare(self, lines: DataFrame, batch_id: int) -> None:
        """Begin to parse the next batch.

        Nothing but its rejects is written, which no reader sees before the batch is committed.
        """
        self._ahead = lines, batch_id, start_beside(self.spark, self._parsed, lines, batch_id)

    def discard(self) -> None:
        """Give back the rows of a following batch that was not processed."""
        if self._ahead is not None:
            ahead, self._ahead = self._ahead[2], None
            if ahead.exception() is None:
                ahead.result()[0].unpersist()

    def _parsed(self, lines: DataFrame, batch_id: int) -> tuple[DataFrame, tuple[int, int, int | None]]:
        """The parsed lines, cached, and what :meth:`_split` counts."""
        parsed = parse_lines(lines, self.cfg).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.tables.check_epoch(self.epoch)
            return parsed, self._split(parsed, batch_id)
        except BaseException:
            parsed.unpersist()
            raise

    def _process(self, lines: DataFrame, batch_id: int, following: tuple[DataFrame, int] | None) -> None:
        last = self.tables.begin(batch_id)
        ahead = self._ahead
        if ahead is not None and ahead[0] is lines and ahead[1] == batch_id:
            self._ahead, found = None, ahead[2].result
        else:
            self.discard()
            found = partial(self._parsed, lines, batch_id)
        try:
            parsed, counts = found()
        except Fenced:
            if lines.isEmpty():
                return
            raise
        with ExitStack() as held:
            held.callback(parsed.unpersist)
            held.callback(self.tables.release)
            if following is not None:
                self._prepare(*following)
            self._run(parsed, counts, last, batch_id, held)

    def _run(self, parsed: DataFrame, counts: tuple[int, int, int | None], last, batch_id: int, held: ExitStack) -> None:
        """The rest of a batch; ``held`` gives back, when it ends, what it keeps in memory."""
        n_in, n_good, first_ms = counts
        if n_in == 0 or (n_good == 0 and last is None):
            return
        now = self._advance(last, first_ms)
        n_alerts = last["n_alerts"] if last and now.alerts_batch is not None else 0
        with ExitStack() as saved:
            if n_good:
                small, last_day = n_good <= self.cfg.one_task_rows, last["day"] if last else 0
                rows = self._features(accepted(parsed), now, batch_id, n_good)
                plan = day_plan(now.day, self.cfg, len(now.models)) if now.day > last_day else None
                if small and plan and (plan.train_recent or plan.train_delayed or plan.train_feedback):
                    # Features need no model, so they are made while the models are trained.
                    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
                    held.callback(rows.unpersist)
                    made = rows.write.format("noop").mode("overwrite").save
                    with beside(self.spark, made):
                        self._roll(plan, now, batch_id, saved)
                elif plan:
                    self._roll(plan, now, batch_id, saved)
                scored = self._scored(rows, now)
                if small:
                    self.tables.keep(scored, batch_id)
                    stored = beside(self.spark, self.tables.append_kept)
                else:
                    self.tables.append_history(scored, batch_id)
                    stored = nullcontext()
                # All read the rows that are kept or were just stored, none what another writes.
                with stored, beside(self.spark, self._update_alerts, now, batch_id) as listed:
                    self.tables.append_rollup(batch_id)
                n_alerts = listed.result()
            self._tidy(last, now, batch_id)
        self.tables.check_epoch(self.epoch)
        self.tables.commit_state(
            epoch=self.epoch, batch_id=batch_id, origin_ms=now.origin_ms, clock_ms=now.clock_ms, day=now.day,
            models=now.models, forest=now.forest, alerts_batch=now.alerts_batch,
            n_in=n_in, n_dropped=n_in - n_good, n_alerts=n_alerts,
        )
        self._maintain(last, now, batch_id)

    def _split(self, parsed: DataFrame, batch_id: int) -> tuple[int, int, int | None]:
        """Store the rejects: the one pass that fills the cache of parsed rows also counts them.

        Returns all lines, good lines and the earliest good time. The pass has no shuffle, so a
        task that runs again counts its rows once.
        """
        facts, good = Observation(), F.col("reject_reason").isNull()
        seen = parsed.observe(
            facts,
            F.count(F.lit(1)).alias("n_in"),
            F.count_if(good).alias("n_good"),
            F.min(F.when(good, F.unix_millis("tx_datetime"))).alias("first_ms"),
        )
        self.tables.save_rejects(rejects(seen), batch_id)
        found = facts.get
        return found.get("n_in", 0), found.get("n_good", 0), found.get("first_ms")

    def _advance(self, last, first_ms: int | None) -> Progress:
        """The batch clock is the earliest good time of the batch and never moves back."""
        if last is None:
            return Progress(first_ms, first_ms, 0, [], None, None)
        clock = max(last["clock_ms"], first_ms) if first_ms is not None else last["clock_ms"]
        day = max(last["day"], (clock - last["origin_ms"]) // DAY_MS)
        return Progress(
            last["origin_ms"], clock, day, list(last["models"]), last["forest"], last["alerts_batch"]
        )

    # --- day roll ----------------------------------------------------------------------

    def _stored(self, now: Progress, batch_id: int) -> DataFrame:
        return self.tables.history(batch_id, now.clock_hour, self.cfg.history_hours)

    def _roll(self, plan: DayPlan, now: Progress, batch_id: int, saved: ExitStack) -> None:
        # The forest learns from closed lists, the delayed model from stored rows.
        with beside(self.spark, self._close_alerts, plan, now, batch_id, saved):
            self._train_trees(plan, now, batch_id, saved)

    def _close_alerts(self, plan: DayPlan, now: Progress, batch_id: int, saved: ExitStack) -> None:
        if plan.close_alerts:
            if now.alerts_batch is not None:
                closed = self.tables.current_alerts(now.alerts_batch)
                ranked = al.daily_ranks(
                    closed.withColumn("_day", F.lit(now.day - 1)), "_day", "zfraud_pr", self.cfg
                )
                self.tables.save_alert_day(ranked, now.day - 1)
            now.alerts_batch = None
        if plan.train_feedback:
            self._train_forest(now, batch_id, saved)

    def _train_forest(self, now: Progress, batch_id: int, saved: ExitStack) -> None:
        window = al.in_feedback_window(F.col("day"), now.day, self.cfg)
        forest = train_feedback(self.tables.alerts(now.day).where(window), self.cfg)
        if forest is not None:
            now.forest = f"feedback-{now.day}-{batch_id}"
            self.models.hold(now.forest, forest)
            saved.enter_context(beside(self.spark, self.models.save_forest, now.forest, forest))

    def _train_trees(self, plan: DayPlan, now: Progress, batch_id: int, saved: ExitStack) -> None:
        hour = F.col("tx_dhour")
        if plan.train_recent:
            self._train("recent", recent_window(hour, now.day), now, batch_id, saved)
        if plan.train_delayed:
            self._train("delayed", delayed_window(hour, now.day, self.cfg), now, batch_id, saved)

    def _train(self, kind: str, window: Column, now: Progress, batch_id: int, saved: ExitStack) -> None:
        """Train a delayed model; one without trees changes nothing. It is saved while the batch goes on."""
        model_id = f"{kind}-{now.day}-{batch_id}"
        bagged = bags_of_history(self._stored(now, batch_id).where(window), self.cfg)
        bag = train_delayed(bagged, self.cfg, model_id, now.day)
        if bag is not None:
            self.models.hold(model_id, bag)
            saved.enter_context(beside(self.spark, self.models.save_bag, bag))
            now.models = live_after([*now.models, model_id], self.cfg)

    # --- scoring -----------------------------------------------------------------------

    def _features(self, good: DataFrame, now: Progress, batch_id: int, n_good: int) -> DataFrame:
        rows = with_time_fields(good, now.origin_ms)
        rows = encode_id(encode_risk(rows, self.dictionary, self.cfg), self.dictionary, self.cfg)
        small = n_good <= self.cfg.one_task_rows
        cards = batch_cards(good.coalesce(1) if small else good)
        return self._with_features(rows, cards, now, batch_id, n_good)

    def _scored(self, rows: DataFrame, now: Progress) -> DataFrame:
        bags = [self.models.bag(m) for m in now.models]
        return score(rows, bags, self.models.forest(now.forest), self.cfg)

    def _with_features(
        self, rows: DataFrame, cards: DataFrame, now: Progress, batch_id: int, n_good: int
    ) -> DataFrame:
        """Join each card's history statistics, merged from its stored hours.

        The rows of a card in the rollup are bounded by the retained hours, so no card of the
        history is hot; a batch of few rows has few cards to broadcast.
        """
        rolled = self.tables.rollup(batch_id, now.clock_hour, self.cfg.history_hours)
        hot = None
        if n_good > self.cfg.broadcast_rows:
            cards = materialize(cards, "cards")
            hot = hot_keys(cards, ["cardid"], "batch_rows", self.cfg.hot_rows, self.cfg.broadcast_rows)
        few = n_good <= self.cfg.broadcast_rows or fits_broadcast(cards, self.cfg.broadcast_rows)
        keys = cards.select("cardid")
        of_cards = rolled.join(F.broadcast(keys) if few else keys, "cardid", "left_semi")
        one_task = few and self.tables.few_seen()
        stats = rolled_stats(of_cards.coalesce(1) if one_task else of_cards, one_task)
        if few:
            joined = rows.join(F.broadcast(stats), "cardid", "left")
        else:
            joined = spread_join(rows, stats, ["cardid"], "tx_id", hot)
        return joined.selectExpr(*rows.columns, *finished())

    def _update_alerts(self, now: Progress, batch_id: int) -> int:
        """Merge the batch's candidates into the list of the day; none before the first model.

        The candidates come from the rows just stored, so nothing is scored twice.
        """
        if not now.models:
            return 0
        before = None
        if now.alerts_batch is not None:
            before = self.tables.current_alerts(now.alerts_batch)
        top = al.batch_top(self.tables.stored_batch(batch_id), self.cfg).drop("batch_id")
        merged = al.merge_daily(before, top, self.cfg)
        listed = Observation()
        self.tables.save_current_alerts(merged.observe(listed, F.count(F.lit(1)).alias("n")), batch_id)
        now.alerts_batch = batch_id
        return listed.get.get("n", 0)

    def _tidy(self, last, now: Progress, batch_id: int) -> None:
        """Take expired and folded folders out of the log that this batch commits."""
        self.tables.expire_history(now.clock_hour, self.cfg)
        if last is not None and now.day > last["day"]:
            self.tables.compact_history(now.clock_hour, batch_id, self.cfg.spare_folders)

    def _maintain(self, last, now: Progress, batch_id: int) -> None:
        """Drop what neither the next batch nor a second run of this one can need."""
        self.tables.drop_retired(last)
        self.tables.prune(batch_id)
        live = {*now.models, now.forest}
        if last is not None and now.day > last["day"]:
            self.models.drop(live | {*last["models"], last["forest"]})
            self.tables.fold_state(last["day"])
            give_back(self.spark)
        self.models.forget(live)


def run_stream(
    lines: DataFrame,
    engine: Engine,
    checkpoint: str,
    available_now: bool = False,
):
    """Start the engine on a stream of lines; restarts resume from ``checkpoint``."""
    writer = lines.writeStream.foreachBatch(engine.process_batch).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=engine.cfg.trigger_interval)
    return writer.start()


def start(spark: SparkSession, lines: DataFrame, root: str, dictionary: Dictionary, **options):
    """Open the tables below ``root`` and run the stream on them; ``reset=True`` starts over."""
    cfg = options.pop("cfg", EngineConfig())
    tables = current_tables(spark, root, options.pop("reset", False))
    engine = Engine(tables, dictionary, cfg)
    return run_stream(lines, engine, f"{engine.tables.root}/checkpoint", **options)
