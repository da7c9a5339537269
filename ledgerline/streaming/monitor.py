"""Monitoring of entities on a stream: watermarks that advance with the batch that used them, and a ledger of batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import Folder, scan_or_empty

MARKS = "entity string, mark timestamp, batch long"


class Monitor:
    """Tables of a folder: marks (entity, mark) and fired, each by batch, and a ledger of finished batches.

    A batch reads the marks of the batches before it and fires what is newer, then writes what fired, then its entities' new marks,
    then its line of the ledger. A batch that is replayed after that does nothing; one that stopped on the way reads the same marks again and
    overwrites its own part of each table. So what fires is fired once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def marks(self, before: int) -> DataFrame:
        """entity, mark: the latest of batches before this one."""
        every = scan_or_empty(self.spark, f"{self.path}/marks", self.spark.createDataFrame([], MARKS).schema)
        return every.filter(F.col("batch") < before).groupBy("entity").agg(F.max("mark").alias("mark"))

    def done(self, batch: int) -> bool:
        return Folder(self.spark, f"{self.path}/ledger/batch={batch}").exists()

    def tick(self, rows: DataFrame, batch: int, started, evaluate: Callable[[DataFrame], DataFrame] = lambda new: new) -> bool:
        """Fires what evaluate makes of rows (entity, at, ...) newer than their entity's mark; False if the batch was finished before.

        Marks move to the start of the tick, not to the newest row: rows that arrive while it runs are the next one's. A row of the future
        stays for the tick that its time has come in.
        """
        if self.done(batch):
            return False
        known = self.marks(batch)
        due = rows.filter(F.col("at") <= F.lit(started)).join(known, "entity", "left").filter(F.col("mark").isNull() | (F.col("at") > F.col("mark"))).drop("mark")
        self._write(evaluate(due), "fired", batch)
        self._write(rows.select("entity").distinct().select("entity", F.lit(started).cast("timestamp").alias("mark")), "marks", batch)
        self._write(self.spark.range(1).select(F.lit(started).cast("timestamp").alias("started")), "ledger", batch)
        return True

    def fired(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/fired")


def monitor_stream(rows: DataFrame, path: str, checkpoint: str, started: Callable[[], object], evaluate: Callable[[DataFrame], DataFrame] = lambda new: new) -> StreamingQuery:
    """A tick for each micro-batch, by its id."""

    def act(batch: DataFrame, number: int) -> None:
        Monitor(batch.sparkSession, path).tick(batch, number, started(), evaluate)

    return rows.writeStream.outputMode("update").foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
