"""Lines and tables that leave the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = ("channel", "vehicle", "front", "rear", "left", "right", "top", "ip")
PARTS = ("front", "rear", "left", "right", "top")


def pass_message(ts: str = "ts") -> Column:
    """[C|time|channel|vehicle|front|rear|left|right|top|ip|D] with empty text for nulls."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in MESSAGE]
    return F.concat(F.lit("[C|"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("|"), F.concat_ws("|", *fields), F.lit("|D]"))


def ocr_record(code: str, front: str, rear: str, load: str) -> Column:
    """Number and size-type, door lines and load type, one per line; nulls leave their line out."""
    c = F.col(code)
    number = F.when(F.length(c) > 4, F.concat(F.expr(f"substring({code}, 1, length({code}) - 4)"), F.lit(" "), F.expr(f"right({code}, 4)"))).otherwise(c)
    return F.concat_ws("\n", number, F.col(front), F.col(rear), F.col(load))


def label_row(with_conf: bool = False) -> Column:
    """``cls xc yc w h`` with six decimals, and the confidence if asked."""
    text = F.format_string("%d %.6f %.6f %.6f %.6f", *[F.col(c).cast("int" if c == "cls" else "double") for c in ("cls", "xc", "yc", "w", "h")])
    return F.concat(text, F.format_string(" %.6f", F.col("conf").cast("double"))) if with_conf else text


def rec_label_line(image: str, text: str) -> Column:
    """path, tab, label without blanks and quotes."""
    return F.concat(F.col(image), F.lit("\t"), F.regexp_replace(text, '[ "]', ""))


def det_label_lines(df: DataFrame) -> DataFrame:
    """One line per image of rows (image, item, transcription, points): path, tab, JSON of its items in order."""
    items = F.array_sort(F.collect_list(F.struct("item", "transcription", "points")))
    out = df.groupBy("image").agg(F.transform(items, lambda x: F.struct(x["transcription"].alias("transcription"), x["points"].alias("points"))).alias("items"))
    return out.select(F.concat("image", F.lit("\t"), F.to_json("items")).alias("line"))


def write_archive(df: DataFrame, path: str, required: tuple[str, ...] = PARTS) -> None:
    """Complete passes only, by channel and day; writing a day again replaces it."""
    whole = df.dropna(subset=list(required))
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("channel", "day").parquet(path)
