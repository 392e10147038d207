"""Running values over long ordered streams, in two levels.

A stream (a camera, a log) is too long for one task, so it is cut in chunks by time. Windows run inside
(key, chunk); totals of the chunks, one row each, are scanned in a second, small window and added.
Every step keeps the partitioning by key and chunk, so the rows are shuffled once.

Where nothing cuts the order (a value, a confidence) ``ranged`` does: chunks are ranges of the whole
order, of about ``ROWS`` rows each however the values are spread.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a range, about.
ROWS = 1_000_000


def shared(spark: SparkSession) -> str:
    """The checkpoint folder; without one a temporary one is set, in local mode only."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="portico-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder, so that rounds do not grow its lineage and lost executors cost nothing."""
    shared(df.sparkSession)
    return df.checkpoint()


class Rounds:
    """Tables of a loop in the shared folder. A new one of a name takes the place of the one before, whose files go."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.count, self.held = spark, f"{shared(spark)}/rounds-{uuid.uuid4().hex}", 0, {}

    def put(self, **tables: DataFrame) -> list[DataFrame]:
        """The tables, written and read again. Those they replace are deleted when all are written."""
        old, out = [self.held[n] for n in tables if n in self.held], []
        for name, df in tables.items():
            self.count += 1
            self.held[name] = f"{self.base}/{name}-{self.count}"
            df.write.parquet(self.held[name])
            out.append(self.spark.read.schema(df.schema).parquet(self.held[name]))
        self._delete(old)
        return out

    def drop(self, *names: str) -> None:
        self._delete([self.held.pop(n) for n in names if n in self.held])

    def _delete(self, paths: list[str]) -> None:
        for path in paths:
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def ranged(df: DataFrame, order: list[str], chunk: str, rows: int | None = None) -> DataFrame:
    """df with ``chunk``, the number of its range in the order of these columns, which should tell all rows apart.

    Ranges are dealt by sampled bounds, so the table is written: another run would have other bounds.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (rows or ROWS)))
    return cut(df.repartitionByRange(n, *order).withColumn(chunk, F.spark_partition_id()))


def _windows(key: str, chunk: str, order: list[str]):
    inside = Window.partitionBy(key, chunk).orderBy(*order)
    before = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return inside, before


def running(df: DataFrame, key: str, chunk: str, order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """df with running sums and running maxima, each with its own row included."""
    sums, maxima = sums or {}, maxima or {}
    inside, before = _windows(key, chunk, order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    base = df.withColumns({f"__{n}": c for n, c in (sums | maxima).items()})
    totals = base.groupBy(key, chunk).agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in sums], *[F.max(f"__{n}").alias(f"__t_{n}") for n in maxima])
    carried = totals.select(key, chunk, *[F.sum(f"__t_{n}").over(before).alias(f"__c_{n}") for n in sums], *[F.max(f"__t_{n}").over(before).alias(f"__c_{n}") for n in maxima])
    out = base.withColumns({n: F.sum(f"__{n}").over(upto) for n in sums} | {n: F.max(f"__{n}").over(upto) for n in maxima})
    out = out.join(carried, [key, chunk])
    out = out.withColumns({n: F.col(n) + F.coalesce(f"__c_{n}", F.lit(0)) for n in sums} | {n: F.greatest(n, f"__c_{n}") for n in maxima})
    return out.drop(*[f"__{n}" for n in sums | maxima], *[f"__c_{n}" for n in sums | maxima])


def previous(df: DataFrame, key: str, chunk: str, order: list[str], column: str, out: str) -> DataFrame:
    """df with the value of column in the row before, across chunks."""
    inside, _ = _windows(key, chunk, order)
    last = df.groupBy(key, chunk).agg(F.max_by(column, F.struct(*order)).alias("__last"))
    carried = last.select(key, chunk, F.lag("__last").over(Window.partitionBy(key).orderBy(chunk)).alias("__carried"))
    numbered = df.withColumn("__rn", F.row_number().over(inside)).withColumn(out, F.lag(column).over(inside))
    joined = numbered.join(carried, [key, chunk])
    return joined.withColumn(out, F.when(F.col("__rn") == 1, F.col("__carried")).otherwise(F.col(out))).drop("__rn", "__carried")


def runs(df: DataFrame, key: str, chunk: str, order: list[str], state: str) -> DataFrame:
    """df with ``idx`` (place in the stream), ``run`` (place where the run began) and ``pos`` (place in it), from 1."""
    out = previous(df, key, chunk, order, state, "__before")
    out = running(out, key, chunk, order, sums={"idx": F.lit(1)})
    start = F.when(F.col("__before").isNull() | (F.col("__before") != F.col(state)), F.col("idx"))
    out = running(out, key, chunk, order, maxima={"run": start})
    return out.withColumn("pos", F.col("idx") - F.col("run") + 1).drop("__before")
