"""Streams of member rows: files a trigger, duplicates within a watermark, batches that are written once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:  # noqa: ANN001
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(rows: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Rows whose keys haven't been seen within the watermark; state older than it is dropped."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed(rows: DataFrame, at: str, length: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by event-time window."""
    return rows.withWatermark(at, late).groupBy(F.window(at, length), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def write_once(rows: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """A batch a folder named by its id, so a batch that is run again replaces what it wrote before."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Names that an archive may have; one more fails the stream.
CAP = 400_000
SEEN = "archive string, member string, kind string"


class Members(StatefulProcessor):
    """Of each row whether its name is new in its archive, a duplicate, or collides with another that differs in case alone.
    Names are map states, an entry each in the state store, so none is held in memory; a count of them fails closed."""

    def __init__(self, cap: int = CAP):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getMapState("names", "member string", "seen boolean")
        self.folded = handle.getMapState("folded", "folded string", "seen boolean")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        n = self.count.get()[0] if self.count.exists() else 0
        for f in rows:
            kinds = []
            for member, folded in zip(f["member"], f["folded"]):
                if self.names.containsKey((member,)):
                    kinds.append("duplicate")
                    continue
                n += 1
                if n > self.cap:
                    raise ValueError(f"archive {key[0]} has more than {self.cap} names")
                self.names.updateValue((member,), (True,))
                kinds.append("collision" if self.folded.containsKey((folded,)) else "new")
                self.folded.updateValue((folded,), (True,))
            yield pd.DataFrame({"archive": f["archive"], "member": f["member"], "kind": kinds})
        self.count.update((n,))

    def close(self) -> None:
        pass


def named(rows: DataFrame, archive: str, member: str) -> DataFrame:
    """archive, member, folded; nulls are empty names."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(text(archive).alias("archive"), text(member).alias("member"), F.lower(text(member)).alias("folded"))


def inventory(rows: DataFrame, archive: str, member: str, cap: int = CAP) -> DataFrame:
    """A stream's rows as archive, member, kind (new, duplicate, collision). It needs the RocksDB state store."""
    own = named(rows, archive, member).groupBy("archive")
    return own.transformWithStateInPandas(Members(cap), SEEN, "Append", "None")


def inventory_counts(rows: DataFrame, archive: str, member: str) -> DataFrame:
    """The same of a table: archive, n_new, n_duplicate, n_collision. Names are counted before archives, so a large archive is
    no group."""
    own = named(rows, archive, member).groupBy("archive", "folded", "member").agg(F.count("*").alias("n"))
    by = own.groupBy("archive", "folded").agg(F.count("*").alias("names"), F.sum("n").alias("n"))
    return by.groupBy("archive").agg(F.count("*").alias("n_new"), F.sum(F.col("n") - F.col("names")).alias("n_duplicate"), F.sum(F.col("names") - 1).alias("n_collision"))
