"""Detection as a stream: the exact rule of the shared expiry queue, in micro-batches whose state is versioned by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.operators.batches import RunState, advance
from emberlog.operators.episodes import PRUNED, Preset
from emberlog.operators.novelty import NoveltyConfig
from emberlog.operators.tables import saved

COLUMNS = ("time", "seq", "source", "user", "dest")


class EpisodeStream:
    """A sink for a stream of login events that come in order of time: writes the episodes that are closed for good.

    An episode is closed by the next event of any key, so no key can be judged by its own state alone, and a watermark closes
    others. Therefore a micro-batch goes through batches.advance(): its state (first events of edges, entries of sessions that may
    go on, counts) is a table for each batch in the folder, and what it closes is written under the batch's number. A batch that is
    run again after a failure starts from the state before it and overwrites what it had written, so each episode is there once,
    whatever the split into batches and wherever the stream was stopped. Older states are deleted.

        stream.writeStream.foreachBatch(EpisodeStream(folder)).option("checkpointLocation", ...).start()
        ...
        sink.finish(spark); sink.episodes(spark)
    """

    def __init__(self, folder: str, novelty: NoveltyConfig = NoveltyConfig(), preset: Preset = PRUNED):
        self.folder, self.novelty, self.preset = folder.rstrip("/"), novelty, preset

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        events = saved(batch.select(*COLUMNS), "batch")
        if events.isEmpty():
            self._carry(spark, number)
            return
        closed, state = advance(self._state(spark, number - 1), events, self.novelty, self.preset)
        self._write(closed, number)
        state.save(f"{self.folder}/state/{number}")
        self._delete(spark, f"state/{number - 2}")

    def finish(self, spark: SparkSession) -> None:
        """Closes what is still open. Running it again writes the same."""
        number = self._newest(spark)
        if number < 0:
            return
        none = spark.createDataFrame([], "time long, seq long, source string, user string, dest string")
        closed, _ = advance(self._state(spark, number), none, self.novelty, self.preset, last=True)
        self._write(closed, number + 1)

    def episodes(self, spark: SparkSession) -> DataFrame:
        """All episodes that are closed."""
        return spark.read.parquet(f"{self.folder}/episodes").drop("batch")

    def _write(self, closed: DataFrame, number: int) -> None:
        closed.write.mode("overwrite").parquet(f"{self.folder}/episodes/batch={number}")

    def _state(self, spark: SparkSession, number: int) -> RunState:
        return RunState.load(spark, f"{self.folder}/state/{number}") if number >= 0 and self._exists(spark, f"state/{number}/counts/_SUCCESS") else RunState()

    def _carry(self, spark: SparkSession, number: int) -> None:
        """A batch without events has the state of the one before."""
        if self._exists(spark, f"state/{number - 1}/counts/_SUCCESS"):
            self._state(spark, number - 1).save(f"{self.folder}/state/{number}")

    def _path(self, spark: SparkSession, name: str):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, spark: SparkSession, name: str) -> bool:
        path, fs = self._path(spark, name)
        return fs.exists(path)

    def _delete(self, spark: SparkSession, name: str) -> None:
        path, fs = self._path(spark, name)
        fs.delete(path, True)

    def _newest(self, spark: SparkSession) -> int:
        path, fs = self._path(spark, "state")
        names = [int(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []
        return max((n for n in names if self._exists(spark, f"state/{n}/counts/_SUCCESS")), default=-1)
