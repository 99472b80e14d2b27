"""The live board: pick events become a keyed table of holders and an overlay on the board, refreshed batch by batch."""

from __future__ import annotations

import datetime
import threading
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from accordant.sources.publish import commit, manifest, published, vacuum, write

HOLDERS = "entity long, manager long, pick long, ts timestamp"
CHANGES = HOLDERS + ", new boolean"
#: Changes of so many batches are merged into the base.
COMPACT = 16
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_picks(spark: SparkSession, path: str, schema: str, delay: str = "1 hour") -> DataFrame:
    """Pick events of landed files: purchases, entity from props. Repeats within the delay are dropped by state."""
    rows = spark.readStream.schema(schema).parquet(path).filter("event_type = 'purchase'")
    rows = rows.select(F.get_json_object("props", "$.k").cast("long").alias("entity"), F.col("user_id").alias("manager"), F.col("event_id").alias("pick"), F.col("ts").cast("timestamp").alias("ts"))
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["pick"])


def _later(a: tuple, b: tuple) -> bool:
    """Whether (at, pick) a comes after b; null comes first."""
    return [(x is not None, x or 0) for x in a] > [(x is not None, x or 0) for x in b]


class LatestHolder(StatefulProcessor):
    """Keeps the latest pick of an entity; gives a row when it changes, whatever order picks come in. Times are microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "manager long, pick long, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was = self.held.get() if self.held.exists() else None
        best = was
        for r in rows:
            row = (r.manager, r.pick, r.at)
            if best is None or _later((row[2], row[1]), (best[2], best[1])):
                best = row
        if best is not None and best is not was:
            self.held.update(tuple(best))
            yield Row(entity=key[0], manager=best[0], pick=best[1], at=best[2], new=was is None)

    def close(self) -> None:
        pass


def holder_changes(picks: DataFrame) -> DataFrame:
    """Stream of CHANGES of a stream of picks(entity, manager, pick, ts). A batch touches the state of its own entities only."""
    rows = picks.select("entity", "manager", "pick", F.unix_micros("ts").alias("at"))
    out = rows.groupBy("entity").transformWithState(LatestHolder(), "entity long, manager long, pick long, at long, new boolean", "Append", "None")
    return out.select("entity", "manager", "pick", F.timestamp_micros("at").alias("ts"), "new")


class Feed:
    """A keyed table that lives by changes: a base, and the changes of the batches since, all named by one version.

    A batch writes its own rows and a version, so its cost follows the batch, not the table. Changes are merged into the base
    every COMPACT batches, and versions before the last ones are removed. A failed batch leaves the old version, a
    repeated batch changes nothing, a second writer of the same batch fails, and a new object on the same path goes on where the last one
    stopped.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        self.spark, self.path, self.keys, self.schema = spark, path, keys, schema

    def says(self) -> dict:
        return {"batch": -1, "base": None, "changes": [], **manifest(self.spark, self.path)[1]}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], f"{self.schema}, batch long")
        return self.spark.read.schema(f"{self.schema}, batch long").parquet(*[f"{self.path}/{f}" for f in folders])

    def _merged(self, says: dict) -> DataFrame:
        rows = self._read([f for f in (says["base"], *says["changes"]) if f])
        if not says["changes"]:
            return rows
        whole = F.struct(*[c for c in rows.columns])
        return rows.groupBy(*self.keys).agg(F.max_by(whole, "batch").alias("r")).select("r.*")

    def table(self) -> DataFrame:
        return self._merged(self.says()).drop("batch")

    def last(self) -> DataFrame:
        """Rows of the last batch that had any (a query also runs batches that only move its watermark)."""
        says = self.says()
        return self._read(says["changes"][-1:] or [f for f in (says["base"],) if f]).filter(F.col("batch") == says.get("filled", -1)).drop("batch")

    def append(self, rows: DataFrame, batch: int, replace: bool = False, **facts) -> bool:
        """Commits the rows of a batch, one a key at most; with `replace` they are the whole table. False for a batch that is there."""
        number, _ = manifest(self.spark, self.path)
        says = self.says()
        if batch <= says["batch"]:
            return False
        folder, n = write(rows.withColumn("batch", F.lit(batch).cast("long")), self.path)
        new = {"base": says["base"], "changes": [*says["changes"], folder] if n else says["changes"]}
        if replace:
            new = {"base": folder, "changes": []}
        if n:
            new["filled"] = batch
        commit(self.spark, self.path, number + 1, {**says, **facts, **new, "batch": batch})
        if len(new["changes"]) >= COMPACT:
            self.compact()
        return True

    def compact(self) -> None:
        """Merges the changes before the last one into the base; the last stays, for `last`."""
        number, _ = manifest(self.spark, self.path)
        says = self.says()
        merged = self._merged({**says, "changes": says["changes"][:-1]})
        folder, _ = write(merged, self.path)
        commit(self.spark, self.path, number + 1, {**says, "base": folder, "changes": says["changes"][-1:]})
        vacuum(self.spark, self.path)


class Holders(Feed):
    """One holder per entity, the latest wins; `new` has the entities that nobody held before the last batch."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, ["entity"], CHANGES)

    def version(self) -> int:
        return self.says()["batch"]

    def table(self) -> DataFrame:
        return super().table().drop("new")

    def new(self) -> DataFrame:
        return self.last().filter("new").drop("new")

    def changes(self, batch: DataFrame) -> DataFrame:
        """Changes of plain picks against the table, for a backfill without a stream."""
        latest = F.max_by(F.struct("manager", "pick", "ts"), F.struct("ts", "pick"))
        own = batch.groupBy("entity").agg(latest.alias("h")).select("entity", "h.manager", "h.pick", "h.ts")
        held = self.table().select("entity", F.struct("ts", "pick").alias("held"))
        both = own.join(held, "entity", "left").filter(F.col("held").isNull() | (F.struct("ts", "pick") > F.col("held")))
        return both.select("entity", "manager", "pick", "ts", F.col("held").isNull().alias("new"))

    def update(self, batch: DataFrame, number: int) -> None:
        if number > self.version():
            self.append(batch if "new" in batch.columns else self.changes(batch), number)

    def start(self, picks: DataFrame, checkpoint: str) -> StreamingQuery:
        return started(holder_changes(picks), self.update, checkpoint)


def started(rows: DataFrame, update, checkpoint: str) -> StreamingQuery:
    """Runs what has landed. The state of the query lies in RocksDB, with changes only in its checkpoints."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return rows.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LiveBoard(Feed):
    """The board with its holders, kept by the stream: the table equals `overlay` of the board and the holders after every batch.

    Each batch joins its changed entities with the board as it is published at that time. Has the board been published
    anew since the last batch, the whole table is made from the new board and the holders.
    """

    def __init__(self, spark: SparkSession, path: str, board_path: str, name: str = "board"):
        self.board_path, self.name = board_path, name
        board = published(spark, board_path, name)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in board.schema)
        super().__init__(spark, f"{path}/board", [k for k in ("avg_type", "pos", "id") if k in board.columns], f"{schema}, manager long, pick long")
        self.holders = Holders(spark, f"{path}/holders")

    def update(self, batch: DataFrame, number: int) -> None:
        self.holders.update(batch, number)
        own = self.holders.says()
        version, says = manifest(self.spark, self.board_path)
        board = self.spark.read.parquet(f"{self.board_path}/{says[self.name]}")
        if self.says().get("board") != version:
            self.append(overlay(board, self.holders.table()), number, True, board=version)
        else:
            rows = self.holders.last() if own.get("filled") == number else self.holders.last().limit(0)
            self.append(overlay(board, rows, "inner"), number, board=version)

    def start(self, picks: DataFrame, checkpoint: str) -> StreamingQuery:
        return started(holder_changes(picks), self.update, checkpoint)


def overlay(board: DataFrame, holders: DataFrame, how: str = "left") -> DataFrame:
    """board(id, ...) with manager of the entity's holder, null where nobody holds it."""
    return board.join(holders.select(F.col("entity").alias("id"), "manager", "pick"), "id", how).select(*board.columns, "manager", "pick")


def limit_seconds(poll_seconds: float) -> float:
    return max(10.0, 4 * poll_seconds)


def freshness(refreshed: DataFrame, poll_seconds: float, now: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Last refresh of refreshed(ts, ...), by scope if named, and whether it is older than max(10, 4 polls) seconds at `now` (else the clock)."""
    last = refreshed.groupBy(*(by or [])).agg(F.max("ts").alias("last"))
    now = F.current_timestamp() if now is None else now
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))
    return last.withColumn("stale", age > limit_seconds(poll_seconds) * 1e6)


class Freshness(StreamingQueryListener):
    """The time of the last good batch of every named query (a scope is a query's name), from the queries' own progress."""

    def __init__(self, poll_seconds: float):
        self.poll_seconds, self.last, self.failed, self.lock = poll_seconds, {}, {}, threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        begun = datetime.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        self.good(p.name or str(p.id), begun + datetime.timedelta(milliseconds=p.batchDuration))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            with self.lock:
                self.failed[str(event.id)] = event.exception

    def good(self, scope: str, at: datetime.datetime) -> None:
        with self.lock:
            self.last[scope] = max(at, self.last.get(scope, at))

    def stale(self, scope: str, now: datetime.datetime) -> bool:
        """Whether no batch of the scope has ended within max(10, 4 polls) seconds before now; a scope without a batch is stale."""
        with self.lock:
            last = self.last.get(scope)
        return last is None or (now - last).total_seconds() > limit_seconds(self.poll_seconds)
