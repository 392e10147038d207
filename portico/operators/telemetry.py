"""Roll-ups of logs, resource samples and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import running

RESOURCES = {"cpu": "cpu", "gpu": "gpu", "gpu_memory": "显存", "memory": "内存"}


def parse_log(lines: DataFrame) -> DataFrame:
    """ts, logger, level and message of lines ``time - name - level - message``; other lines give nulls."""
    shape = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)(?:,(\d+))? - (\S+) - ([A-Z]+) - (.*)$"
    part = lambda i: F.regexp_extract("line", shape, i)
    there = F.col("line").rlike(shape)
    # A missing fraction reads as zero.
    ts = F.try_to_timestamp(F.concat(part(1), F.lit("."), F.rpad(part(2), 6, "0")), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return lines.withColumns({"ts": F.when(there, ts), "logger": F.when(there, part(3)), "level": F.when(there, part(4)), "message": F.when(there, part(5))})


#: Kinds of messages and how they are told, tried in this order.
KINDS = {"panorama": r"^panorama \d+", "outage": "^outage", "archive": "^archive", "error": "(?i)error|exception"}


def log_kind(message: Column | str) -> Column:
    """The kind of a message, ``other`` if none fits."""
    c = F.col(message) if isinstance(message, str) else message
    out = None
    for kind, shape in KINDS.items():
        out = F.when(c.rlike(shape), kind) if out is None else out.when(c.rlike(shape), kind)
    return out.otherwise("other")


def log_counts(events: DataFrame) -> DataFrame:
    """Counts over all combinations of level, camera and kind, with their totals."""
    return events.withColumn("kind", log_kind("message")).cube("level", "camera", "kind").agg(F.count("*").alias("n"))


def panorama_stats(events: DataFrame) -> DataFrame:
    """Frames of panoramas per camera."""
    n = events.withColumn("n", F.regexp_extract("message", r"^panorama (\d+)$", 1)).filter("n <> ''").select("camera", F.col("n").cast("long").alias("n"))
    return n.groupBy("camera").agg(F.count("*").alias("panoramas"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.sum((F.col("n") < 5).cast("int")).alias("fragments"))


def parse_resources(df: DataFrame, line: str = "line") -> DataFrame:
    """cpu, gpu, gpu_memory, memory of lines like ``cpu:50.7% gpu:23%``, in any order."""
    pairs = F.str_to_map(F.trim(F.col(line)), F.lit(" +"), F.lit(":"))
    value = lambda k: F.regexp_replace(F.try_element_at(pairs, F.lit(k)), "%$", "").try_cast("double")
    return df.withColumns({name: value(key) for name, key in RESOURCES.items()})


def bucketed(df: DataFrame, n: int, key: str | None = None) -> DataFrame:
    """df with the number of its n-sample bucket, in order of ts and seq; streams are cut by the hour."""
    rows = df.withColumn("__key", F.lit(0) if key is None else F.col(key)).withColumn("__chunk", F.date_trunc("hour", "ts"))
    out = running(rows, "__key", "__chunk", ["ts", "seq"], sums={"place": F.lit(1)})
    return out.withColumn("bucket", F.floor((F.col("place") - 1) / n)).drop("__key", "__chunk", "place")


def resource_max(samples: DataFrame, n: int = 11, key: str | None = None) -> DataFrame:
    """Largest values of every n samples of each host (key); without a key all samples are one host's."""
    return bucketed(parse_resources(samples), n, key).groupBy(*([key] if key else []), "bucket").agg(*[F.max(c).alias(c) for c in RESOURCES], F.count("*").alias("samples"))


def batched_mean(samples: DataFrame, n: int, key: str = "direction") -> DataFrame:
    """Mean of every n measurements per key; an unfinished bucket says nothing."""
    return bucketed(samples, n, key).groupBy(key, "bucket").agg(F.avg("seconds").alias("mean"), F.count("*").alias("k")).filter(F.col("k") == n).drop("k")


def queue_depth(samples: DataFrame) -> DataFrame:
    return samples.groupBy("direction").agg(F.max("depth").alias("most"), F.avg("depth").alias("mean"))


def frame_rate(frames: DataFrame, seconds: int = 120) -> DataFrame:
    w = F.window("ts", f"{seconds} seconds")
    return frames.groupBy("direction", w.alias("w")).agg(F.count("*").alias("frames")).select("direction", F.col("w.start").alias("start"), "frames", (F.col("frames") / seconds).alias("rate"))


def outage_rate(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Outages per camera and interval, with the gap in seconds since the interval before that had one."""
    out = events.filter("message = 'outage'").groupBy("camera", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    start = F.col("w.start")
    gap = F.unix_micros(start.cast("timestamp")) - F.unix_micros(F.lag(start).over(Window.partitionBy("camera").orderBy(start)).cast("timestamp"))
    return out.select("camera", start.alias("start"), "n", (gap / 1e6).alias("gap"))


def gpu_utilization(df: DataFrame) -> DataFrame:
    return df.withColumns({"memory_ratio": F.round(F.col("used_mb") / F.col("total_mb"), 3), "used_gib": F.round(F.col("used_mb") / 1024, 2)})


def fit_batch_size(points: DataFrame, capacity: float, fraction: float = 0.8, group: str = "gpu", default: int = 16, most: int = 1024) -> DataFrame:
    """Batch size that uses a fraction of the memory, by a line through (batch, memory).

    A null memory is a batch that failed: at or beyond the smallest of them the largest good batch below
    it counts, or else that smallest one. A batch outside 1 to ``most`` gives way to ``default``.
    """
    failed = F.min(F.when(F.col("memory").isNull(), F.col("batch")))
    line = points.groupBy(group).agg(F.regr_slope("memory", "batch").alias("slope"), F.regr_intercept("memory", "batch").alias("intercept"), failed.alias("__fail"))
    safe = points.join(line.select(group, "__fail"), group).filter("batch < __fail AND memory IS NOT NULL").groupBy(group).agg(F.max("batch").alias("__safe"))
    fit = F.try_divide(F.lit(capacity * fraction) - F.col("intercept"), F.col("slope")).cast("long")  # towards zero
    out = line.join(safe, group, "left").withColumn("batch", F.when(fit >= F.col("__fail"), F.coalesce("__safe", "__fail").cast("long")).otherwise(fit))
    return out.withColumn("batch", F.when(F.col("batch").between(1, most), F.col("batch")).otherwise(default)).drop("__fail", "__safe")
