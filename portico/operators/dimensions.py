"""Small dimension tables that are part of the program, and ones derived from readings."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import LIVE

#: Fixed values of ISO 6346: lengths and heights in feet, and the sizes in use, the frequent ones first.
LENGTHS = {"2": 20.0, "4": 40.0, "L": 45.0}
HEIGHTS = {"0": 8.0, "2": 8.5, "4": 9.0, "5": 9.5}
SIZES = ("22", "42", "45", "20", "40", "L5", "25", "44", "24", "L2")
#: Fixed values of ISO 6346: type letter -> description, group, last characters in use (digits, then those of group codes).
TYPES = {
    "G": ("Standard Dry", "GP", "0123P"), "V": ("Ventilated", "VH", "0234H"), "B": ("Dry Bulk", "BU", "013456KU"), "S": ("Named Cargo", "SN", "012N"),
    "R": ("Thermal Refrigerated/Heated", "RT", "01239CEST"), "H": ("Thermal Insulated", "HR", "01256IR"), "U": ("Open Top", "UT", "012345T"), "P": ("Platform", "PF", "12345789LSFC"),
    "T": ("Tank", "TN", "0123456789DGN"),
}
#: Types with a name or group of their own.
NAMED = {"P3": ("Collapsible Flat Rack", "PC"), "P1": ("Flat Rack", "PF"), "R1": ("Reefer", "RT"), "H0": ("Insulated (Conair)", "HR"), "B0": ("Bulk", "BU")}


def size_type_rows() -> list[tuple[str, str, float, float, str]]:
    """(code, description, length, height, group) of every size with every type.

    ``readers.read_size_types`` reads a list from a file where there is one.
    """
    rows = []
    for size, (t, (name, group, last)) in itertools.product(SIZES, TYPES.items()):
        for d in last:
            own = NAMED.get(t + d, (name, group))
            rows.append((size + t + d, own[0], LENGTHS[size[0]], HEIGHTS[size[1]], size + own[1]))
    return rows


SIZE_TYPES = size_type_rows()


def size_types(spark: SparkSession) -> DataFrame:
    """code, description, length, height, group; one row per code."""
    return spark.createDataFrame(SIZE_TYPES, "code string, description string, length double, height double, `group` string")


def size_codes() -> list[str]:
    return sorted(row[0] for row in SIZE_TYPES)


def type_candidates(dimension: DataFrame, most: int = 100) -> DataFrame:
    """fragment, rank, candidate: the codes like a fragment of a size-type, ``most`` at most, in order of their place.

    A fragment has characters that fit three or four places in order; likeness is twice the longest
    common subsequence over the sum of lengths, 0.8 at least: so four characters are the code itself
    and three are a code without one of its places. Fragments come from the codes' side.
    """
    places = ["".join(x) for n in (3, 4) for x in itertools.combinations(LIVE, n)]
    code = F.col("code")
    less = [F.concat(F.substring(code, 1, i), F.substring(code, i + 2, 4)) for i in range(4)]
    rows = dimension.select("code", "place", F.explode(F.array_distinct(F.array(code, *less))).alias("fragment")).filter(F.col("fragment").rlike(f"^({'|'.join(places)})$"))
    rank = F.row_number().over(Window.partitionBy("fragment").orderBy("place", code)) - 1
    return rows.select("fragment", rank.alias("rank"), F.col("code").alias("candidate")).filter(F.col("rank") < most)


def size_candidates(spark: SparkSession) -> DataFrame:
    """fragment, rank, candidate of the dimension's own codes; ``readers.read_candidates`` reads a list from a file."""
    placed = spark.createDataFrame([(row[0], i) for i, row in enumerate(SIZE_TYPES)], "code string, place int")
    return type_candidates(placed)


def owner_codes(readings: DataFrame, code: str = "true_code") -> DataFrame:
    """The distinct four-letter heads ending in U."""
    head = F.substring(code, 1, 4)
    return readings.filter(head.rlike("^[A-Z]{3}U$")).select(head.alias("owner")).distinct()


def owner_wildcards(owners: DataFrame) -> DataFrame:
    """Owners by what is left of their three letters when one is dropped: key, owners (sorted)."""
    o = F.col("owner")
    keys = F.array(
        F.concat(F.lit("*"), F.substring(o, 2, 2)), F.concat(F.substring(o, 1, 1), F.lit("*"), F.substring(o, 3, 1)), F.concat(F.substring(o, 1, 2), F.lit("*"))
    )
    return owners.select(F.explode(keys).alias("key"), "owner").groupBy("key").agg(F.sort_array(F.collect_list("owner")).alias("owners"))
