"""The engine's tables: history, alerts, rejects and committed state, as partitioned Parquet.

Every batch writes below its own ``batch_id`` and commits one state row last. The state row is the
commit log: it names every folder of stored rows that is part of the tables as of that batch. Readers
open what the newest state names and nothing else, so what a batch wrote and did not commit is never
seen, no folder has to be listed to find the stored rows, and a batch that is run again replaces its
own rows only. Folders that a batch takes out of the log are deleted one commit later, when no batch
that could be run again starts from a state that names them.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Iterable
from concurrent.futures import Future
from dataclasses import dataclass
from threading import Lock

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden.config import EngineConfig
from cardwarden.operators.history import latest_per_key, partial_stats
from cardwarden.schema import ALERT, TX_STORED, typed
from cardwarden.session import FEW_BYTES, materialize, start_beside

FOLDERS = T.ArrayType(
    T.StructType(
        [
            T.StructField("table", T.StringType()),
            T.StructField("batch_id", T.LongType()),
            T.StructField("tx_dhour", T.IntegerType()),
        ]
    )
)
STATE = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("origin_ms", T.LongType()),
        T.StructField("clock_ms", T.LongType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("models", T.ArrayType(T.StringType())),
        T.StructField("forest", T.StringType()),
        T.StructField("alerts_batch", T.LongType()),
        T.StructField("n_in", T.LongType()),
        T.StructField("n_dropped", T.LongType()),
        T.StructField("n_alerts", T.LongType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("folders", FOLDERS),
        T.StructField("retired", FOLDERS),
    ]
)
REJECT = T.StructType(
    [
        T.StructField("tx_id", T.LongType()),
        T.StructField("value", T.StringType()),
        T.StructField("reject_reason", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
METRIC = T.StructType([f for f in STATE.fields if f.name in ("batch_id", "day", "n_in", "n_dropped", "n_alerts")])
ALERT_DAY = T.StructType([*ALERT.fields, T.StructField("day", T.IntegerType())])


#: (table, batch, hour) of one folder of stored rows.
Folder = tuple[str, int, int]


@dataclass(frozen=True)
class Kept:
    """The rows of a small batch, without its id, and their hours."""

    batch_id: int
    rows: DataFrame
    hours: set[int]


@dataclass(frozen=True)
class Seen:
    """What a batch has read of the rollup, and whether it is little."""

    batch_id: int
    folders: set[Folder]
    rows: DataFrame
    few: bool


@dataclass(frozen=True)
class Window:
    """One file with the rows of some folders of the rollup."""

    folders: set[Folder]
    rows: DataFrame
    path: str


class Fenced(RuntimeError):
    """Another engine was started on the same tables; this one must not write any more."""


class Tables:
    """All tables below one root folder that every executor can reach.

    An object that writes keeps the log of the batch it is in, and sees its own rows before they
    are committed. One that only reads looks up the newest committed state at every read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._rollup = self.rollup_schema()
        self._log: set[Folder] | None = None
        self._retired: set[Folder] = set()
        self._committed: Row | None = None
        # Rows of the small batch that was stored last, kept for what is made of them.
        self._small: Kept | None = None
        self._widening: Future | None = None
        self._lock = Lock()
        self._seen: Seen | None = None
        self._window: Window | None = None
        for name in ("history", "rollup", "alerts", "alerts_current", "rejects", "state", "metrics", "models", "epochs"):
            self._fs.mkdirs(self._path(self.path(name)))

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    # --- folders -----------------------------------------------------------------------

    def _values(self, folder: str, column: str) -> list[int]:
        """The values of a partition column, from the folder names."""
        mark = f"{column}="
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
        return sorted(int(n[len(mark) :]) for n in names if n.startswith(mark))

    def folders(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path(name)))]

    def _size(self, folder: str) -> int:
        return self._fs.getContentSummary(self._path(folder)).getLength()

    def _few_bytes(self, folders: Iterable[Folder]) -> bool:
        return sum(self._size(self._stored_in(f)) for f in folders) <= FEW_BYTES

    def _drop(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    # --- commit log --------------------------------------------------------------------

    def begin(self, batch_id: int):
        """Start a batch from the last committed state before it, and return that state.

        A batch after the one that this object committed last starts from the state it holds: only
        another writer could have committed since, and its epoch stops this one before it writes.
        """
        state = self._committed
        if state is None or state["batch_id"] >= batch_id:
            state = self.last_state(batch_id)
        self._log = {tuple(f) for f in state["folders"]} if state else set()
        self._retired = set()
        self._seen = None
        self.release()
        return state

    def release(self) -> None:
        """Give back the memory of the rows kept of a small batch."""
        self.settle()
        if self._small:
            self._small.rows.unpersist()
        self._small = None

    def _folders(self, name: str) -> list[Folder]:
        log = self._log
        if log is None:
            state = self.last_state()
            log = {tuple(f) for f in state["folders"]} if state else set()
        return sorted(f for f in log if f[0] == name)

    def _stored_in(self, folder: Folder) -> str:
        name, batch, hour = folder
        return self.path(name, f"batch_id={batch}", f"tx_dhour={hour}")

    def _open(self, schema: T.StructType, folders: list[Folder]) -> DataFrame:
        """Read the given folders of one table; their batches are listed, no other folder is.

        A batch of which all hours are given is opened as one path: Spark looks up each path by itself,
        and takes a job to list many.
        """
        if not folders:
            return self.spark.createDataFrame([], schema)
        name, paths, given = folders[0][0], [], {}
        for _, batch, hour in folders:
            given.setdefault(batch, []).append(hour)
        for batch, hours in given.items():
            whole = self.path(name, f"batch_id={batch}")
            if set(self._values(whole, "tx_dhour")) == set(hours):
                paths.append(whole)
            else:
                paths += [self._stored_in((name, batch, h)) for h in hours]
        reader = self.spark.read.schema(schema).option("basePath", self.path(name))
        return reader.parquet(*paths).select(schema.names)

    def _append(self, rows: DataFrame, name: str, batch_id: int) -> None:
        """Write a batch's folder anew, with nothing left of an earlier try, and log its hours."""
        if self._log is None:
            self.begin(batch_id)
        target = self.path(name, f"batch_id={batch_id}")
        whole = rows.drop("batch_id").write.mode("overwrite").option("partitionOverwriteMode", "static")
        whole.partitionBy("tx_dhour").parquet(target)
        hours = self._values(target, "tx_dhour")
        # Another thread may be writing another table; one that reads the log sees a whole one.
        with self._lock:
            kept = {f for f in self._log if f[:2] != (name, batch_id)}
            self._log = kept | {(name, batch_id, h) for h in hours}

    def _retire(self, folders: list[Folder]) -> None:
        self._log -= set(folders)
        self._retired |= set(folders)

    def drop_retired(self, state) -> None:
        """Delete the folders that ``state``, the one before the last commit, had taken out."""
        for folder in {tuple(f) for f in (state["retired"] if state else ())} - self._log:
            self._drop(self._stored_in(folder))

    # --- epochs ------------------------------------------------------------------------

    def _newest_epoch(self) -> int:
        return max((int(n) for n in self.folders("epochs")), default=0)

    def claim(self) -> int:
        """Become the engine of these tables: the file of each number can be created once only."""
        epoch = self._newest_epoch() + 1
        while not self._fs.createNewFile(self._path(self.path("epochs", str(epoch)))):
            epoch += 1
        for older in self.folders("epochs"):
            if int(older) < epoch:
                self._drop(self.path("epochs", older))
        return epoch

    def check_epoch(self, epoch: int) -> None:
        newest = self._newest_epoch()
        if newest != epoch:
            raise Fenced(f"engine {epoch} of {self.root} was replaced by engine {newest}")

    def _replace(self, df: DataFrame, name: str, *by: str) -> None:
        """Overwrite just the partitions that ``df`` has rows for."""
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*by)
            .parquet(self.path(name))
        )

    # --- history -----------------------------------------------------------------------

    def history(self, before_batch: int | None = None, clock_hour: int | None = None, hours: int = 0):
        """Stored rows, optionally of earlier batches and of the retained hours only.

        Both conditions are on partition columns, so they choose folders, not rows.
        """
        return self._hours_before("history", TX_STORED, before_batch, clock_hour, hours)

    def _hours_before(self, name, schema, before_batch, clock_hour, hours) -> DataFrame:
        folders, wanted = self._folders(name), F.lit(True)
        if before_batch is not None:
            folders = [f for f in folders if f[1] < before_batch]
            wanted = wanted & (F.col("batch_id") < before_batch)
        if clock_hour is not None:
            folders = [f for f in folders if f[2] > clock_hour - hours]
            wanted = wanted & (F.col("tx_dhour") > clock_hour - hours)
        return self._open(schema, folders).where(wanted)

    def stored_batch(self, batch_id: int) -> DataFrame:
        """The rows that one batch stored; lists only that batch's folders, or none if they are still kept."""
        if self._small and self._small.batch_id == batch_id:
            return self._small.rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        return self._open(TX_STORED, [f for f in self._folders("history") if f[1] == batch_id])

    def append_history(self, scored: DataFrame, batch_id: int) -> None:
        """Store a scored batch; rebalancing joins small tasks and splits a crowded hour."""
        rows = typed(scored.withColumn("batch_id", F.lit(batch_id)), TX_STORED)
        self._append(rows.hint("rebalance", "tx_dhour"), "history", batch_id)

    def keep(self, scored: DataFrame, batch_id: int) -> None:
        """Make the rows of a small batch in one task, and keep them until the batch is stored, with its
        alerts and its rollup."""
        self.release()
        rows = typed(scored, T.StructType(TX_STORED.fields[:-1])).coalesce(1).persist(StorageLevel.MEMORY_AND_DISK)
        self._small = Kept(batch_id, rows, {row[0] for row in rows.select("tx_dhour").collect()})

    def append_kept(self) -> None:
        self._append(self._small.rows, "history", self._small.batch_id)

    def rollup_schema(self) -> T.StructType:
        empty = self.spark.createDataFrame([], TX_STORED).groupBy("cardid", "tx_dhour").agg(*partial_stats())
        return T.StructType([*empty.schema.fields, T.StructField("batch_id", T.LongType())])

    def append_rollup(self, batch_id: int) -> None:
        """Store the statistics of every (card, hour) that a batch wrote rows of.

        Each row is whole: if earlier batches stored rows of the same hour, late or written again,
        the rows of those cards in that hour are read once more, and the new version takes the place
        of the old one for later batches. Other hours are not read. One task makes and writes the few
        rows of a small batch, unless many earlier rows are read.
        """
        small = self._small is not None and self._small.batch_id == batch_id
        mine, stored = self.stored_batch(batch_id), self._folders("history")
        hours = self._small.hours if small else {h for _, b, h in stored if b == batch_id}
        earlier = sorted({h for _, b, h in stored if b < batch_id and h in hours})
        rows, one_task = mine, small
        if earlier:
            touched = mine.where(F.col("tx_dhour").isin(earlier)).select("cardid", "tx_dhour")
            before_folders = [f for f in stored if f[1] < batch_id and f[2] in hours]
            before = self._open(TX_STORED, before_folders)
            one_task = small and self._few_bytes(before_folders)
            touched = F.broadcast(touched.coalesce(1)) if small else touched.distinct()
            rows = mine.unionByName(before.join(touched, ["cardid", "tx_dhour"], "left_semi").select(*mine.columns))
        rows = rows.coalesce(1) if one_task else rows
        rolled = latest_per_key(rows, ["batch_id", "tx_id"]).groupBy("cardid", "tx_dhour").agg(*partial_stats())
        self._append(rolled.coalesce(1) if small else rolled.hint("rebalance", "tx_dhour"), "rollup", batch_id)
        if small:
            self._widening = start_beside(self.spark, self._widen_window, batch_id)

    def _widen_window(self, batch_id: int) -> None:
        """Write what this batch has read of the rollup, and its own, as one file for the next batch.

        The file saves opening a folder for each hour; it is only a copy, and without it, as in a new
        engine, or where it lacks a folder that the log names, the folders are read.
        """
        seen, self._window = self._seen, None
        if seen is None or seen.batch_id != batch_id or not seen.few:
            return
        own = [f for f in self._folders("rollup") if f[1] == batch_id]
        name = uuid.uuid4().hex
        # Readers of the table open what the log names, so they never see this folder.
        path = self.path("rollup", "_window", name)
        seen.rows.unionByName(self._open(self._rollup, own)).coalesce(1).write.parquet(path)
        self._window = Window(seen.folders.union(own), self.spark.read.schema(self._rollup).parquet(path), path)
        for other in self.folders("rollup/_window"):
            if other != name:
                self._drop(self.path("rollup", "_window", other))

    def settle(self) -> None:
        """Wait for the copy that :meth:`append_rollup` began; one that failed is not used."""
        copy, self._widening = self._widening, None
        if copy is not None and (fault := copy.exception()) is not None:
            self._window = None
            logging.getLogger(__name__).warning("the copy of the rollup was not written: %s", fault)

    def rollup(self, before_batch: int, clock_hour: int, hours: int) -> DataFrame:
        """Statistics per card, retained hour and version, as of earlier batches."""
        self.settle()
        least = clock_hour - hours
        wanted = {f for f in self._folders("rollup") if f[1] < before_batch and f[2] > least}
        held = self._window.folders if self._window else set()
        if wanted and wanted <= held and all(b < before_batch for _, b, _ in held):
            rows, few = self._window.rows.where(F.col("tx_dhour") > least), self._size(self._window.path) <= FEW_BYTES
            rows = rows.coalesce(1) if few else rows
        else:
            rows = self._hours_before("rollup", self._rollup, before_batch, clock_hour, hours)
            few = self._few_bytes(wanted)
        self._seen = Seen(before_batch, wanted, rows, few)
        return rows

    def few_seen(self) -> bool:
        """Whether the rows that :meth:`rollup` returned last are few enough for one task."""
        return self._seen is not None and self._seen.few

    def expire_history(self, clock_hour: int, cfg: EngineConfig) -> list[int]:
        """Take expired hours out of the log. Reads no longer see those hours by then."""
        old = [f for n in ("history", "rollup") for f in self._folders(n) if f[2] <= clock_hour - cfg.history_hours]
        self._retire(old)
        return sorted({h for _, _, h in old})

    def compact_history(self, before_hour: int, before_batch: int, spare: int = 0) -> list[int]:
        """Fold the batches of closed hours into one folder per hour, last write per key kept."""
        self._fold_hours(
            "rollup", self._rollup, before_hour, before_batch, spare,
            lambda rows: rows.groupBy("cardid", "tx_dhour").agg(
                *[F.max_by(c, "batch_id").alias(c) for c in rows.columns if c.startswith("p_")]
            ),
        )
        return self._fold_hours(
            "history", TX_STORED, before_hour, before_batch, spare,
            lambda rows: latest_per_key(rows, ["batch_id", "tx_id"]),
        )

    def _fold_hours(self, name: str, schema: T.StructType, before_hour: int, before_batch: int, spare: int, last_of) -> list[int]:
        """Does nothing while no more than ``spare`` folders would go.

        The folded rows take the highest folded ``batch_id``. A crash before the commit leaves them
        beside the old folders, and readers keep one row per key, so it loses nothing.
        """
        crowded: dict[int, list[int]] = {}
        for _, batch, hour in self._folders(name):
            if batch < before_batch and hour < before_hour:
                crowded.setdefault(hour, []).append(batch)
        crowded = {h: ids for h, ids in sorted(crowded.items()) if len(ids) > 1}
        if sum(len(ids) - 1 for ids in crowded.values()) <= spare:
            return []
        self.settle()
        rows = self._open(schema, [(name, b, h) for h, ids in crowded.items() for b in ids])
        target = F.create_map(*[F.lit(v) for h, ids in crowded.items() for v in (h, ids[-1])])
        folded = last_of(rows).withColumn("batch_id", target[F.col("tx_dhour")].cast("bigint"))
        saved = materialize(folded, "compact")
        self._replace(typed(saved, schema).hint("rebalance", "tx_dhour"), name, "batch_id", "tx_dhour")
        self._retire([(name, b, h) for h, ids in crowded.items() for b in ids[:-1]])
        return list(crowded)

    # --- alerts ------------------------------------------------------------------------

    def current_alerts(self, batch_id: int) -> DataFrame:
        schema = T.StructType(ALERT.fields[1:])
        return self.spark.read.schema(schema).parquet(
            self.path("alerts_current", f"batch_id={batch_id}")
        )

    def save_current_alerts(self, alerts: DataFrame, batch_id: int) -> None:
        rows = typed(alerts, T.StructType(ALERT.fields[1:]))
        rows.write.mode("overwrite").parquet(self.path("alerts_current", f"batch_id={batch_id}"))

    def alerts(self, before_day: int | None = None) -> DataFrame:
        """The lists of closed days: those before ``before_day``, or before the newest committed day."""
        if before_day is None:
            state = self.last_state()
            before_day = state["day"] if state else 0
        return self._read("alerts", ALERT_DAY).where(F.col("day") < before_day)

    def save_alert_day(self, ranked: DataFrame, day: int) -> None:
        self._replace(typed(ranked.withColumn("day", F.lit(day)), ALERT_DAY), "alerts", "day")

    # --- rejects -----------------------------------------------------------------------

    def save_rejects(self, rejected: DataFrame, batch_id: int) -> None:
        rows = typed(rejected, T.StructType(REJECT.fields[:-1]))
        rows.write.mode("overwrite").parquet(self.path("rejects", f"batch_id={batch_id}"))

    def rejects(self) -> DataFrame:
        """Rejected lines of the batches up to the newest committed one."""
        state = self.last_state()
        return self._read("rejects", REJECT).where(F.col("batch_id") <= (state["batch_id"] if state else -1))

    # --- state -------------------------------------------------------------------------

    def last_state(self, before_batch: int | None = None):
        """The committed state that a batch starts from, or None for the first batch; without a
        batch the newest state.

        Reads one batch's folder of the newest day that has an earlier batch.
        """
        for day in reversed(self._values(self.path("state"), "day")):
            folder = self.path("state", f"day={day}")
            earlier = [b for b in self._values(folder, "batch_id") if before_batch is None or b < before_batch]
            if earlier:
                reader = self.spark.read.schema(STATE).option("basePath", self.path("state"))
                return reader.parquet(f"{folder}/batch_id={earlier[-1]}").first()
        return None

    def commit_state(self, **values) -> None:
        """Write the state row of a batch, and with it the log of stored folders."""
        log = {f.name: sorted(x) for f, x in zip(STATE.fields[-2:], (self._log or (), self._retired))}
        row = {"epoch": None, **log, **values}
        named = {n: [dict(zip(FOLDERS.elementType.names, f)) for f in v] if n in log else v for n, v in row.items()}
        # Made of a literal, so that no Python worker has to start for one row.
        made = F.from_json(F.lit(json.dumps(named)), STATE)
        self._replace(self.spark.range(0, 1, 1, 1).select(made.alias("_s")).select("_s.*"), "state", "day", "batch_id")
        self._committed = Row(**row)

    def batch_metrics(self) -> DataFrame:
        """One row per committed batch: lines in, lines dropped, alerts of the day so far."""
        states = self._read("state", STATE).select(*METRIC.names)
        # While a day is folded its batches are in both tables.
        return states.unionByName(self._read("metrics", METRIC)).dropDuplicates(["batch_id"])

    def fold_state(self, before_day: int) -> None:
        """Fold the states of days before ``before_day`` into one file of metrics a day."""
        days = [d for d in self._values(self.path("state"), "day") if d < before_day]
        for day in days:
            rows = self._read("state", STATE).where(F.col("day") == day).select(*METRIC.names)
            self._replace(rows.coalesce(1), "metrics", "day")
            self._drop(self.path("state", f"day={day}"))

    def prune(self, before_batch: int, keep: int = 10) -> None:
        """Drop alert lists that no batch can start from any more.

        A state names one list, so the last ``keep`` states name at most as many, the newest ones
        written. They stay however long ago that was: batches without good rows write none.
        """
        folder = self.path("alerts_current")
        written = [b for b in self._values(folder, "batch_id") if b <= before_batch]
        for batch in written[: -(keep + 1)]:
            self._drop(f"{folder}/batch_id={batch}")


def _resets(spark: SparkSession, root: str) -> int:
    """How often the tables of ``root`` were reset: the number of roots named after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    run = 0
    while fs.exists(path(f"{root}-{run}")):
        run += 1
    return run


def new_tables(spark: SparkSession, root: str, reset: bool = False) -> Tables:
    """Open the tables; ``reset`` starts over with an empty root of a new name."""
    root = root.rstrip("/")
    return Tables(spark, f"{root}-{_resets(spark, root)}" if reset else root)


def current_tables(spark: SparkSession, root: str, reset: bool = False) -> Tables:
    """The tables of the last reset of ``root``, of a new one, or of ``root`` if there was none."""
    root = root.rstrip("/")
    resets = _resets(spark, root)
    if reset or not resets:
        return new_tables(spark, root, reset)
    return Tables(spark, f"{root}-{resets - 1}")
