"""Votes, repairs and matches over the readings of a pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from . import nearest


def decode_size_types(readings: DataFrame, dimension: DataFrame, code: str = "size_text") -> DataFrame:
    """readings with what the positions say and what the dimension says of a size-type.

    The dimension is a fixed list of some hundred rows, so it is broadcast.
    """
    known = dimension.select(F.col("code").alias("__code"), "description", "length", "height")
    out = readings.join(F.broadcast(known), F.col(code) == F.col("__code"), "left").drop("__code")
    return out.withColumns({"length_feet": C.decoded(code, "length"), "second_size": C.decoded(code, "height"), "type_group": C.decoded(code, "group")})


class _Cells:
    """Votes of keys numbered from 0: key, place, character plus one (0: the end of a text, at its length), readings, first."""

    def __init__(self, k: np.ndarray, p: np.ndarray, ch: np.ndarray, n: np.ndarray, first: np.ndarray):
        self.columns = k, p, ch, n, first

    @classmethod
    def of(cls, k: np.ndarray, texts: pa.Array, n: np.ndarray, first: np.ndarray) -> _Cells:
        """A null text ends before its first place."""
        size = pc.fill_null(pc.utf8_length(texts), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        letters = np.frombuffer("".join(t for t in texts.to_pylist() if t).encode("utf-32-le"), np.uint32).astype(np.int64)
        long = np.maximum(size, 0)
        row = np.repeat(np.arange(len(size)), long)
        place = np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long)
        both = lambda x, y: np.concatenate([x, y])
        return cls(both(k, k[row]), both(size, place), both(np.zeros(len(size), np.int64), letters + 1), both(n, n[row]), both(first, first[row]))

    def __add__(self, other: _Cells) -> _Cells:
        return _Cells(*[np.concatenate(x) for x in zip(self.columns, other.columns, strict=True)])

    def where(self, ok: np.ndarray) -> _Cells:
        return _Cells(*[x[ok] for x in self.columns])

    def summed(self) -> _Cells:
        k, p, ch, n, first = self.columns
        order = np.lexsort((ch, p, k))
        k, p, ch, n, first = (x[order] for x in (k, p, ch, n, first))
        start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (ch[1:] != ch[:-1])]))
        return _Cells(k[start], p[start], ch[start], np.add.reduceat(n, start), np.minimum.reduceat(first, start))

    def voted(self, keys: int, blank_last: bool, most: int | None) -> list[str | None]:
        """The vote of each key; the cells are summed. With ``most`` up to the end of the first text, and no more places."""
        k, p, ch, n, first = self.columns
        rank = np.unique(first, return_inverse=True)[1]
        cut = np.full(keys, np.iinfo(np.int64).max)
        none = np.zeros(keys, bool)
        if most is not None:
            ends = np.flatnonzero(ch == 0)
            ends = ends[np.lexsort((p[ends], rank[ends], k[ends]))]
            size = p[ends[np.searchsorted(k[ends], np.arange(keys))]]
            none = (size < 0) & (np.bincount(k[ends], n[ends], keys) <= 2)
            cut = np.where(size < 0, most, np.minimum(size, most))
        end, letter = (ch == 0) & (p > 0), ch > 0
        longest = np.zeros(keys, np.int64)
        np.maximum.at(longest, k[end], p[end])
        total = np.bincount(k[end], n[end], keys).astype(np.int64)
        lk, lp, lc, ln, lr = (x[letter] for x in (k, p, ch, n, rank))
        # Letters of a place are neighbours; the most frequent one comes first, then the first seen.
        order = np.lexsort((lc, lr, -ln, lp, lk))
        lk, lp, lc, ln, lr = (x[order] for x in (lk, lp, lc, ln, lr))
        if len(lk):
            start = np.flatnonzero(np.concatenate([[True], (lk[1:] != lk[:-1]) | (lp[1:] != lp[:-1])]))
            said = np.add.reduceat(ln, start)
            lk, lp, lc, ln, lr = (x[start] for x in (lk, lp, lc, ln, lr))
            # When the first text was at its end: the least so far of each key, as later keys lie lower.
            ranks, before = int(rank.max()) + 1, np.cumsum(longest + 1) - longest - 1
            least = np.minimum.accumulate(rank[end] + (keys - k[end]) * ranks)
            at = np.searchsorted(before[k[end]] + p[end], before[lk] + lp, "right") - 1
            since = least[np.maximum(at, 0)] - (keys - lk) * ranks
            blanks = total[lk] - said
            blank = (blanks > 0) & ((blanks > ln) | ((blanks == ln) & (since < lr)))
            if not blank_last:
                blank &= lp < longest[lk] - 1
            left = ~blank & (lp < cut[lk])
            lk, lc = lk[left], lc[left]
        text = (lc - 1).astype("<u4").tobytes().decode("utf-32-le")
        to = np.cumsum(np.bincount(lk, minlength=keys)).tolist()
        return [None if no else text[i:j] for i, j, no in zip([0, *to], to, none.tolist(), strict=False)]


def _voted(readings: DataFrame, keys: list[str], text: str, order: str, blank_last: bool, most: int | None) -> DataFrame:
    """keys, voted. Equal texts of a key are counted first; of the key that a task is at it holds one row per place and character."""
    spark = readings.sparkSession
    names = [f"__k{i}" for i in range(len(keys))]
    counted = readings.groupBy(*[F.col(c).alias(n) for n, c in zip(names, keys, strict=True)], F.col(text).alias("__t")).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    dealt = counted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), names[0]).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held = None  # the key that may go on in the next batch, and its cells
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(i) for i in range(len(names))]
            seen = [pa.concat_arrays([x, y]) for x, y in zip(last, own, strict=True)] if last else own
            new = np.zeros(len(seen[0]), bool)
            for x in seen:
                there = np.asarray(x.is_valid().to_numpy(zero_copy_only=False))
                new[1:] |= pc.fill_null(pc.not_equal(x[1:], x[:-1]), False).to_numpy(zero_copy_only=False) | (there[1:] != there[:-1])
            at = np.cumsum(new)
            begin = np.concatenate([[0], np.flatnonzero(new)])
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            cells = _Cells.of(at[len(at) - batch.num_rows :], column("__t"), column("__n").to_numpy(zero_copy_only=False), column("__first").to_numpy(zero_copy_only=False))
            cells = (held + cells if last else cells).summed()
            k, keep = cells.columns[0], int(at[-1])
            if keep:
                yield pa.RecordBatch.from_arrays([*[x.take(pa.array(begin[:-1])) for x in seen], pa.array(cells.where(k < keep).voted(keep, blank_last, most), pa.string())], names=[*names, "voted"])
            last, held = [x[len(x) - 1 :] for x in seen], cells.where(k == keep)
            held.columns[0][:] = 0
        if last:
            yield pa.RecordBatch.from_arrays([*last, pa.array(held.voted(1, blank_last, most), pa.string())], names=[*names, "voted"])

    kinds = ", ".join(f"{n} {dealt.schema[n].dataType.simpleString()}" for n in names)
    return dealt.mapInArrow(run, f"{kinds}, voted string").withColumnsRenamed(dict(zip(names, keys, strict=True)))


def positional_vote(readings: DataFrame, key: str | list[str], text: str, order: str, blank_last: bool = True) -> DataFrame:
    """key, voted: at every position the most frequent character, the first seen on ties.

    Readings that are too short vote blank; with ``blank_last`` off they do not at the last position.
    Counting of equal readings starts in the map tasks; a task takes its passes in turn and holds one row
    per position and character, however many readings a pass has. With several keys the first one deals the rows.
    """
    return _voted(readings.filter(F.length(text) > 0), [key] if isinstance(key, str) else key, text, order, blank_last, None)


def vote_code(readings: DataFrame, key: str, text: str, order: str, most: int = 10) -> DataFrame:
    """key, voted: the vote over the first reading's positions, ``most`` of them; up to two readings give the first."""
    return _voted(readings, [key], text, order, True, most)


def stacked_votes(readings: DataFrame, key: str, texts: list[Column], order: str, blank_last: bool = True) -> DataFrame:
    """key and v0, v1, ...: votes over several texts of a reading, apart, in one run; null where none was read."""
    rows = readings.select(key, order, F.posexplode(F.array(*texts)).alias("__kind", "__text"))
    voted = positional_vote(rows, [key, "__kind"], "__text", order, blank_last)
    return voted.groupBy(key).agg(*[F.max(F.when(F.col("__kind") == i, F.col("voted"))).alias(f"v{i}") for i in range(len(texts))])


def pass_vote(readings: DataFrame) -> DataFrame:
    """Number and size-type of each pass, voted apart over non-empty parts."""
    both = stacked_votes(readings, "pass_id", [F.col("text"), F.col("size_text")], "seq").withColumnsRenamed({"v0": "number", "v1": "size_type"})
    return both.select("pass_id", F.concat(F.coalesce("number", F.lit("")), F.coalesce("size_type", F.lit(""))).alias("voted"), "number", "size_type")


def filter_plates(readings: DataFrame, least: float = 0.5) -> DataFrame:
    """Readings of seven characters, the second a letter, with enough confidence."""
    return readings.filter((F.col("score") >= least) & (F.length("text") == 7) & F.substring("text", 2, 1).rlike("[A-Za-z]"))


def plate_pass(readings: DataFrame, best: int = 3) -> DataFrame:
    """pass_id, voted, best_seq, readings: the vote of the ``best`` readings by detection score."""
    order = Window.partitionBy("pass_id").orderBy(F.desc("det_score"), "seq")
    ranked = readings.withColumn("r", F.row_number().over(order))
    top = ranked.filter(F.col("r") <= best)
    counts = readings.groupBy("pass_id").agg(F.count("*").alias("readings"), F.max_by("seq", F.struct("det_score", -F.col("seq"))).alias("best_seq"))
    return positional_vote(top, "pass_id", "text", "seq").join(counts, "pass_id").select("pass_id", "voted", "best_seq", "readings")


def repair_size_types(codes: DataFrame, candidates: DataFrame, default: str = "22G1") -> DataFrame:
    """codes with repaired and flag (1 known, 2 repaired, 0 guessed).

    candidates (fragment, rank, candidate) is a fixed list, so its three look-ups are broadcast.
    """
    from .dimensions import size_codes

    listed = candidates.groupBy("fragment").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate"))).alias("l"))
    listed = listed.select("fragment", F.transform("l", lambda x: x["candidate"]).alias("l"))
    look = lambda df, key, name: df.join(F.broadcast(listed.select(F.col("fragment").alias(f"__{name}"), F.col("l").alias(name))), key == F.col(f"__{name}"), "left").drop(f"__{name}")
    c = F.col("code")
    out = look(look(look(codes, c, "own"), F.substring(c, 1, 4), "four"), F.substring(c, 1, 3), "three")
    known, short = c.isin(size_codes()), F.length(c) == 3
    has = lambda x: F.coalesce(F.array_contains("own", x), F.lit(False))
    repaired = (
        F.when(known, c)
        .when(short & has(F.concat(c, F.lit("1"))), F.concat(c, F.lit("1")))
        .when(short & c.startswith("2") & has(F.concat(F.lit("2"), c)), F.concat(F.lit("2"), c))
        .when(short & c.startswith("5") & has(F.concat(F.lit("4"), c)), F.concat(F.lit("4"), c))
        .otherwise(F.coalesce(F.get("own", F.lit(0)), F.get("four", F.lit(0)), F.get("three", F.lit(0)), F.when(F.length(c) == 4, c), F.lit(default)))
    )
    found = F.col("own").isNotNull() | F.col("four").isNotNull() | F.col("three").isNotNull()
    return out.select(*codes.columns, repaired.alias("repaired"), F.when(known, 1).when(found, 2).otherwise(0).alias("flag"))


#: Codes of one head from which on they meet by parts of their numbers as well.
LARGE = 1_000_000


def match_against(codes: DataFrame, expected: DataFrame, code: str, reference: str) -> DataFrame:
    """code, matched, found, distance: the first expected code by rank that matches, else null, and the edits to it.

    Where nothing matches, the distance is that to the last expected code, and null without any.
    Codes meet the expected ones three times, with the best so far: by head (and by the middle part of the number
    where a head has many codes), by the first part of the number and by the last one. Keys that say where a number was
    changed are made inside a task (``nearest``), so a code is shuffled three times, not once for each key.
    """
    bucket = lambda *of: F.pmod(F.xxhash64(*of), F.lit(nearest.BUCKETS)).cast("int")
    head, number = C.split_head, C.split_number
    # All parts take the same columns of both sides and filter late, so that each side is shuffled once.
    left, right = codes.select(F.col(code).alias("code")), expected.select(F.col(reference).alias("reference"), "rank")
    # One row: there are no more lengths than a code can have.
    lengths = F.broadcast(left.agg(F.collect_set(F.length(number("code"))).alias("__lengths")))
    # There are few heads of many rows, at most as many as all rows divided by LARGE.
    many = lambda df, c, rows: df.groupBy(F.coalesce(head(c), F.lit("")).alias("__head")).agg(F.count(rows).alias("n")).filter(F.col("n") >= LARGE).select("__head")
    large = F.broadcast(many(left, "code", "code").union(many(right, "reference", "rank")).distinct().withColumn("__large", F.lit(True)))

    def by_head(df: DataFrame, c: str, cut: Callable[[Column], Column]) -> DataFrame:
        known = df.withColumns({"__head": head(c), "__number": number(c)}).join(large, "__head", "left")
        return known.withColumn("__bucket", F.when(F.coalesce("__large", F.lit(False)), cut(F.col("__number"))).otherwise(F.array(bucket("__head"))))

    right = right.crossJoin(lengths)
    met = by_head(left, "code", lambda n: F.array(bucket("__head", nearest.own_block(n, "middle")))).select("code", F.col("__bucket")[0].alias("__bucket"))
    parts = by_head(right, "reference", lambda n: F.transform(nearest.partner_blocks(n, "middle", F.col("__lengths")), lambda b: bucket("__head", b)))
    met = nearest.step(met, parts.select("reference", "rank", F.explode(F.array_distinct("__bucket")).alias("__bucket")), head, number, False)
    for at in ("first", "last"):
        parts = F.transform(nearest.partner_blocks(number("reference"), at, F.col("__lengths")), lambda b: bucket(b))
        parts = right.select("reference", "rank", F.explode(F.array_distinct(parts)).alias("__bucket"))
        met = nearest.step(met.withColumn("__bucket", bucket(nearest.own_block(number("code"), at))), parts, head, number, True)

    last = expected.agg(F.max_by(reference, F.struct("rank", reference)).alias("__last"))
    out = met.select(F.col("code").alias(code), F.col("reference").alias("matched")).withColumn("found", F.col("matched").isNotNull()).crossJoin(F.broadcast(last))  # one row
    return out.withColumn("distance", C.code_distance(F.col(code), F.coalesce("matched", "__last"))).drop("__last")


def pick_nearest(tokens: DataFrame, key: str, least: float | None = None) -> DataFrame:
    """The text nearest to the reference centre; with ``least`` the nearest of those scored above it, if any."""
    sure = F.lit(0) if least is None else F.when(F.col("score") > least, 0).otherwise(1)
    return tokens.groupBy(key).agg(F.min_by("text", F.struct(sure, "distance", "seq")).alias("picked"))


def pick_confident(tokens: DataFrame, key: str) -> DataFrame:
    """The most confident valid code, or the most confident text where none is valid."""
    valid = C.is_valid_code("text").cast("int")
    return tokens.groupBy(key).agg(F.max_by("text", F.struct(valid, "score", -F.col("seq"))).alias("picked"))


def code_window(text: Column | str) -> Column:
    """Four characters up to the last U and seven after it, of texts longer than a code; null if that is no whole code."""
    c = F.col(text) if isinstance(text, str) else text
    whole = F.concat(F.regexp_extract(c, "^.*([A-Z0-9]{3}U)([^U]{7})[^U]*$", 1), F.regexp_extract(c, "^.*([A-Z0-9]{3}U)([^U]{7})[^U]*$", 2))
    return F.when(F.length(whole) == 11, whole)


def join_short_numbers(numbers: Column, most: int = 7) -> Column:
    """Numbers put together in order as long as the result has no more than ``most`` digits."""
    return F.aggregate(numbers, F.lit(""), lambda s, x: F.when(F.length(s) + F.length(x) <= most, F.concat(s, x)).otherwise(s))
