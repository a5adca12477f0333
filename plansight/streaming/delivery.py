"""ST9: delivery per destination, one failure apart from the others.

Every micro-batch is sent to each destination on its own. What one destination
got of one batch is a folder of its own, complete when its job has committed
(``_SUCCESS``); a destination that fails leaves the rows and the error in the
dead-letter table instead, and the batch goes on. A batch that is run again
skips what is complete. ``replay`` sends dead letters again; a letter counts
as dead only until its (batch, destination) is complete, so each payload is
delivered once however often batches and replays are repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sends the rows of one destination and batch; ``path`` is the folder to leave the delivered rows in.
Sender = Callable[[DataFrame, str], None]
PAYLOAD = "request_id string, pos int, repo_id long, event_name string, message_id string, payload string"


def to_folder(rows: DataFrame, path: str) -> None:
    """The default sender: delivered rows as Parquet."""
    rows.write.mode("overwrite").parquet(path)


class Delivery:
    """Deliveries under ``root`` to the destinations named in ``senders``."""

    def __init__(self, spark: SparkSession, root: str, senders: dict[str, Sender], schema: str = PAYLOAD):
        self.spark, self.root, self.senders, self.schema = spark, root, senders, schema

    def _folder(self, part: str, destination: str, batch: int) -> str:
        return f"{self.root}/{part}/destination={destination}/batch_no={batch}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self, folder: str) -> bool:
        p, fs = self._fs(f"{folder}/_SUCCESS")
        return fs.exists(p)

    def _send(self, rows: DataFrame, destination: str, batch: int) -> bool:
        folder = self._folder("delivered", destination, batch)
        if self._complete(folder):
            return True
        rows = rows.drop("destination")
        try:
            self.senders[destination](rows, folder)
            return True
        except Exception as e:  # noqa: BLE001 - whatever a destination does must not stop the others
            rows.withColumn("error", F.lit(f"{type(e).__name__}: {str(e)[:200]}")).write.mode("overwrite").parquet(
                self._folder("dead", destination, batch))
            return False

    def write_batch(self, batch: DataFrame, batch_no: int) -> None:
        """The ``foreachBatch`` body. The batch is read once; destinations are served side by side.

        A destination without a sender fails like any other."""
        batch = batch.persist()
        try:
            named = sorted({*self.senders, *(r["destination"] for r in batch.select("destination").distinct().collect())})  # the fan-out's targets
            with ThreadPoolExecutor(max(1, len(named))) as pool:
                list(pool.map(lambda d: self._send(batch.where(F.col("destination") == d), d, batch_no), named))
        finally:
            batch.unpersist()

    def run(self, payloads: DataFrame, checkpoint: str) -> None:
        """Drain a stream of payloads (with their ``destination``)."""
        payloads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.write_batch).trigger(
            availableNow=True).start().awaitTermination()

    def _listed(self, part: str) -> list[tuple[str, int]]:
        """(destination, batch) of every committed folder of a part."""
        p, fs = self._fs(f"{self.root}/{part}/destination=*/batch_no=*/_SUCCESS")
        folders = [str(s.getPath().getParent()) for s in fs.globStatus(p) or []]
        return sorted((f.split("/")[-2].split("=", 1)[1], int(f.split("/")[-1].split("=")[1])) for f in folders)

    def _read(self, part: str, which: list[tuple[str, int]], schema: str) -> DataFrame:
        full = f"{schema}, destination string, batch_no long"
        if not which:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{part}").parquet(*[self._folder(part, d, b) for d, b in which])

    def delivered(self) -> DataFrame:
        return self._read("delivered", self._listed("delivered"), self.schema)

    def _dead(self) -> list[tuple[str, int]]:
        return sorted(set(self._listed("dead")) - set(self._listed("delivered")))

    def dead_letters(self) -> DataFrame:
        """Rows not delivered yet, with the error of their last attempt."""
        return self._read("dead", self._dead(), f"{self.schema}, error string")

    def replay(self) -> int:
        """Send all dead letters again; how many (batch, destination) are still dead."""
        for destination, batch in self._dead():
            rows = self._read("dead", [(destination, batch)], f"{self.schema}, error string").drop("error", "batch_no")
            # the rows are copied first: a failed attempt writes the letters anew
            self._send(rows.checkpoint(), destination, batch)
        return len(self._dead())
