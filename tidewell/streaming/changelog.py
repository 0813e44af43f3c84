"""A change log as a stream: each micro-batch is committed once; compaction folds the log into a base."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.functions.numbers import entry_bytes, SNAPSHOT_BYTES, should_compact
from tidewell.functions.options import Options
from tidewell.operators.accounting import log_account
from tidewell.operators.state import current_state

CHANGE = "seq long, sub_seq int, op int, key_enc binary, value binary"
#: Places at which a test may fail a store.
FAILPOINTS = ("log_written", "base_written", "event_written")


class StoreFatal(RuntimeError):
    pass


class StreamedState:
    """State below one folder: log/batch=N is the committed change log, base/version=N all keys as of batch N.

    A batch writes its own changes only. After it the log's bytes since the newest base decide by the options
    whether the log is folded into a new base, which resets the accounting, as compact() does on request; a log
    of more than MOST batches is folded in any case, so that readers and lists stay short. A batch that is processed
    again, after a failure, overwrites its own folders only, so it counts once. Folders that carry Spark's success
    mark are whole; readers take the newest base and the batches after it. What the base before the newest doesn't
    need either is deleted. The first error makes the object refuse all further batches; a new one, as after a
    restart, goes on from what is whole.
    """

    MOST = 64

    def __init__(self, spark: SparkSession, folder: str, options: Options | None = None, failpoint: Callable[[str], None] | None = None) -> None:
        self.spark, self.folder, self.options = spark, folder, (options or Options()).sane()
        self.failpoint, self.fatal = failpoint or (lambda name: None), None
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        root = self._path(f"{self.folder}/{kind}")
        if not self._fs.exists(root):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(root)]
        return sorted(int(n.split("=")[1]) for n in names if self._fs.exists(self._path(f"{self.folder}/{kind}/{n}/_SUCCESS")))

    def versions(self) -> list[int]:
        return self._numbers("base")

    def _changes(self, batches: list[int]) -> DataFrame:
        paths = [f"{self.folder}/log/batch={n}" for n in batches]
        return self.spark.read.schema(CHANGE).parquet(*paths) if paths else self.spark.createDataFrame([], CHANGE)

    def log(self) -> DataFrame:
        """The changes since the newest base."""
        base = max(self.versions(), default=-1)
        return self._changes([n for n in self._numbers("log") if n > base])

    def account(self) -> DataFrame:
        """Total, live and obsolete bytes of the log since the newest base; a key's latest record is live."""
        return log_account(self.log())

    def apply(self, changes: DataFrame, batch: int) -> None:
        if self.fatal:
            raise StoreFatal(self.fatal)
        try:
            if batch in self.versions() or batch < max(self.versions(), default=-1):
                return  # it is in a base already
            changes.select("seq", "sub_seq", "op", "key_enc", "value").write.mode("overwrite").parquet(f"{self.folder}/log/batch={batch}")
            self.failpoint("log_written")
            o = self.options
            a = self.account().withColumn("wanted", should_compact(F.col("total_bytes"), F.col("live_bytes"), o.auto_compact_wal_bytes_threshold, o.auto_compact_invalid_wal_ratio_percent)).first()
            if a.wanted or len(self._numbers("log")) > self.MOST:
                self._fold(batch, a.total_bytes, "auto")
        except Exception as e:
            self.fatal = f"batch {batch}: {e}"
            raise

    def compact(self) -> None:
        """On request; without a log there is nothing to do."""
        if self.fatal:
            raise StoreFatal(self.fatal)
        batches = self._numbers("log")
        if batches and batches[-1] > max(self.versions(), default=-1):
            self._fold(batches[-1], self.account().first().total_bytes, "manual")

    def _fold(self, batch: int, reclaimed: int, kind: str) -> None:
        old = [v for v in self.versions() if v < batch]
        self.state().sortWithinPartitions("key_enc").write.mode("overwrite").parquet(f"{self.folder}/base/version={batch}")
        self.failpoint("base_written")
        size = self.state().agg(F.coalesce(F.sum(entry_bytes(F.col("key_enc"), F.col("value"))), F.lit(0)).alias("n")).first().n + SNAPSHOT_BYTES
        event = json.dumps({"version": batch, "kind": kind, "snapshot_bytes": size, "reclaimed_bytes": reclaimed})
        self.spark.createDataFrame([(event,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/compactions/version={batch}")
        self.failpoint("event_written")
        for n in self._numbers("log"):
            if old and n <= old[-1]:
                self._fs.delete(self._path(f"{self.folder}/log/batch={n}"), True)
        for v in old[:-1]:
            self._fs.delete(self._path(f"{self.folder}/base/version={v}"), True)

    def compactions(self) -> DataFrame:
        """A row for each compaction that left its mark: version, kind, snapshot_bytes, reclaimed_bytes."""
        kind = "version long, kind string, snapshot_bytes long, reclaimed_bytes long"
        paths = [f"{self.folder}/compactions/version={n}" for n in self._numbers("compactions")]
        return self.spark.read.schema(kind).json(paths) if paths else self.spark.createDataFrame([], kind)

    def start(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Processes all that is there and stops; the same checkpoint goes on from there later."""
        return changes.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def state(self) -> DataFrame:
        """key_enc and value of all keys."""
        rows, found = self.log(), self.versions()
        if found:
            base = self.spark.read.schema("key_enc binary, value binary").parquet(f"{self.folder}/base/version={found[-1]}")
            rows = rows.unionByName(base.select(F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("sub_seq"), F.lit(1).alias("op"), "key_enc", "value"))
        return current_state(rows)
