"""Sources by option, and sinks that write every micro-batch once.

A query that is stopped between writing and committing runs its last batch again, with the same rows.
The parts of ``deliver`` therefore write under the batch's number and replace what an earlier try left:
the archive by partitions of channel, day and batch, messages by a folder of their own. Messages are made
from the archived rows, so a second try sends the same vehicle numbers. The batch's entry in the ledger
comes last; a batch that has one is not written again, and readers take only batches that have one, so
they see none in part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators.passes import archive_keys, number_vehicles
from ..sources.writers import MESSAGE, PARTS, pass_message


def read_stream(spark: SparkSession, kind: str, schema: StructType | str, path: str | None = None, **options) -> DataFrame:
    """Rows that arrive as files of ``kind`` (parquet, json, csv, orc), or as JSON in the lines of text files or Kafka records.

    options go to Spark's source (``maxFilesPerTrigger``, ``kafka.bootstrap.servers``, ``subscribe``, ...).
    Kafka needs Spark's connector on the class path.
    """
    reader = spark.readStream.format(kind).options(**{k: str(v) for k, v in options.items()})
    if kind in ("text", "kafka"):
        return parsed(reader.load(path) if path else reader.load(), schema)
    return reader.schema(schema).load(path)


def _read(rows: DataFrame, schema: StructType | str) -> DataFrame:
    shape = schema.simpleString() if isinstance(schema, StructType) else f"struct<{schema}>"
    return rows.select(F.col("value").cast("string").alias("value"), F.from_json(F.col("value").cast("string"), shape).alias("v"))


def parsed(rows: DataFrame, schema: StructType | str) -> DataFrame:
    """The fields of JSON values; values that are none are left to ``rejected``."""
    return _read(rows, schema).filter(_good(rows, schema)).select("v.*")


def rejected(rows: DataFrame, schema: StructType | str) -> DataFrame:
    """The values that hold no JSON object with any of the fields."""
    return _read(rows, schema).filter(~_good(rows, schema)).select("value")


def _good(rows: DataFrame, schema: StructType | str) -> F.Column:
    names = _read(rows, schema).schema["v"].dataType.names
    there = F.lit(False)
    for n in names:
        there = there | F.col(f"v.`{n}`").isNotNull()
    return F.coalesce(there, F.lit(False))


class Ledger:
    """Numbers of the batches that are done, an empty file each, in a folder that any of Hadoop's file systems holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.folder = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _entry(self, batch: int):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{batch}")

    def __contains__(self, batch: int) -> bool:
        return self.files.exists(self._entry(batch))

    def add(self, batch: int) -> None:
        """Fails if the entry is there: two writers of one batch are an error."""
        self.files.create(self._entry(batch), False).close()

    def batches(self) -> list[int]:
        return sorted(int(s.getPath().getName()) for s in self.files.listStatus(self.folder)) if self.files.exists(self.folder) else []


def once(ledger: Ledger, *steps: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that runs steps for batches without an entry and then makes it. A step may run again for a batch."""

    def write(df: DataFrame, batch: int) -> None:
        if batch in ledger:
            return
        df.persist()
        try:
            for step in steps:
                step(df, batch)
        finally:
            df.unpersist()
        ledger.add(batch)

    return write


def archived(spark: SparkSession, path: str, batches: Iterable[int]) -> DataFrame | None:
    """The rows of these batches in an archive; None if it holds none yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place) or not any(s.isDirectory() and "=" in s.getPath().getName() for s in files.listStatus(place)):
        return None
    return spark.read.parquet(path).filter(F.col("batch").isin(list(batches))).withColumns({"channel": F.col("channel").cast("string"), "day": F.lpad(F.col("day").cast("string"), 6, "0")})


def archive_step(spark: SparkSession, path: str, ledger: Ledger, required: tuple[str, ...] = PARTS) -> Callable[[DataFrame, int], None]:
    """Writes the complete passes of a batch, numbered after the vehicles that earlier batches gave their channel and day.

    Rows: channel, ts, pass_no, the parts, and what else a message needs.
    """

    def write(df: DataFrame, batch: int) -> None:
        whole = archive_keys(df.dropna(subset=list(required)))
        done = archived(spark, path, [b for b in ledger.batches() if b < batch])
        if done is None:
            done = spark.createDataFrame([], "channel string, day string, vehicle string")
        # Only the days of this batch are read.
        old = done.join(whole.select("channel", "day").distinct(), ["channel", "day"], "left_semi").select("channel", "day", "vehicle")
        rows = number_vehicles(whole, old).withColumn("batch", F.lit(batch))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("channel", "day", "batch").parquet(path)

    return write


def message_lines(rows: DataFrame) -> DataFrame:
    missing = [c for c in MESSAGE if c not in rows.columns]
    return rows.withColumns({c: F.lit(None).cast("string") for c in missing}).select("channel", "vehicle", pass_message().alias("value"))


def message_step(spark: SparkSession, archive: str, path: str | None = None, kafka: dict | None = None) -> Callable[[DataFrame, int], None]:
    """Sends a message for each archived pass of the batch: to text files in a folder of the batch, or to Kafka.

    A folder is replaced by a second try. Kafka can't take a message back: a second try of a batch without
    an entry in the ledger sends again, with the same key (channel/vehicle) and value, for readers to tell.
    """

    def write(df: DataFrame, batch: int) -> None:
        rows = archived(spark, archive, [batch])
        if rows is None:
            return
        lines = message_lines(rows)
        if path:
            lines.select("value").write.mode("overwrite").text(f"{path.rstrip('/')}/batch={batch}")
        if kafka:
            lines.select(F.concat_ws("/", "channel", "vehicle").alias("key"), "value").write.format("kafka").options(**kafka).save()

    return write


def deliver(passes: DataFrame, archive: str, ledger: str, checkpoint: str, messages: str | None = None, kafka: dict | None = None, required: tuple[str, ...] = PARTS) -> DataStreamWriter:
    """A writer (call ``start``) that archives the complete passes of a stream and sends their messages."""
    spark = passes.sparkSession
    book = Ledger(spark, ledger)
    steps = once(book, archive_step(spark, archive, book, required), message_step(spark, archive, messages, kafka))
    return passes.writeStream.foreachBatch(steps).outputMode("append").option("checkpointLocation", checkpoint)
