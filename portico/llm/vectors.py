"""Exact top-k search by inner product over buckets of vectors of like length.

Vectors are scaled to whole numbers, floor(scale * x). ``index`` deals them out to buckets by the
logarithm of their length (steps of ``STEP``) and cuts a bucket into blocks of about ``ROWS`` vectors,
longest first; a block is a row with the unit vectors and the lengths.

Queries are blocks too. Their thresholds are the k-th best scores within a bounded sample, one block
of the longest vectors; they hold for the whole table, since the sample is part of it. A
block of queries is joined only to the blocks of buckets whose greatest length can still reach one of
its thresholds. In a pair of blocks each query has its local threshold, the least cosine to a
vector of the bucket's greatest length that reaches it: above 1 the bucket is skipped; from ``FOCUS``
on coordinate pruning is used, the unit vectors outside the feasible range of one of the query's
largest coordinates being ruled out; below it length pruning, the block being read as far as its
lengths can reach the threshold. Whatever remains is verified by whole-number products, in double precision
where these are exact and as Python integers where they are not.

Defined cases: a vector that is null or has a null or non-finite component takes no part; vectors of
different dimension are filled up with zeros; a query leaves out the rows with its own id; every
row whose id asks is a query; a null id is no query and comes last among equal scores; repeated rows
are candidates each; a score beyond 64 bits is cut to the nearest such number; an empty table gives an
empty result; further columns are ignored. The work is queries times vectors by nature, less what is
pruned; no task holds more than a block of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, shared_dir, table

TOP, SCALE, EVERY = 5, 256, 50
#: Ratio of lengths within a bucket, vectors and queries of a block (by hash, so about as many).
STEP, ROWS, QUERIES = 0.9, 4096, 1024
#: Local cosine from which coordinates are used, how many, and how much room is left for rounding.
FOCUS, COORDINATES, SLACK = 0.8, 6, 1e-9
EXACT = 2**53
_LEAST, _MOST = -(2**63), 2**63 - 1


def matrix(packed: list, dimension: int) -> np.ndarray:
    out = np.zeros((len(packed), dimension))
    for i, x in enumerate(packed):
        out[i, : len(x)] = x
    return out


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Whole-number inner products, queries by vectors."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    if float(np.abs(queries).max()) * float(np.abs(vectors).max()) * queries.shape[1] < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in m] for m in (queries, vectors)]
    return np.array([[min(_MOST, max(_LEAST, sum(a * b for a, b in zip(q, v, strict=True)))) for v in whole[1]] for q in whole[0]], np.int64)


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths without overflow."""
    top = np.abs(vectors).max(axis=1, initial=0)
    safe = np.where(top > 0, top, 1)
    return safe * np.sqrt(((vectors / safe[:, None]) ** 2).sum(axis=1)) * (top > 0)


def feasible(cosine: float, coordinate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between which values a coordinate of a unit vector lies whose cosine to a query is at least so much."""
    middle, width = coordinate * cosine, np.sqrt(np.maximum(0, 1 - coordinate**2) * max(0.0, 1 - cosine**2))
    low = np.where(coordinate <= -cosine, -1.0, middle - width)
    high = np.where(coordinate >= cosine, 1.0, middle + width)
    return low - SLACK, high + SLACK


def candidates(query: np.ndarray, size: float, least: float, unit: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
    """Places of the vectors of a block, longest first, that may score ``least`` with a query of length size; None for all."""
    if least <= 0:
        return None  # without a positive threshold no length rules anything out
    if size * sizes[0] == 0:
        return np.empty(0, np.int64)
    local = least / (size * sizes[0]) * (1 - SLACK)
    if local > 1:
        return np.empty(0, np.int64)
    if local < FOCUS:
        reach = int(np.searchsorted(-sizes, -least / size * (1 - SLACK), "right"))
        return None if reach == len(sizes) else np.arange(reach)
    own = query / size
    focus = np.argsort(-np.abs(own))[:COORDINATES]
    low, high = feasible(local, own[focus])
    there = np.arange(len(sizes))
    for f, a, b in zip(focus, low, high, strict=True):
        x = unit[there, f]
        there = there[(x >= a) & (x <= b)]
    return there


def scaled(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id, v (whole numbers as doubles) and length of the vectors that take part."""
    up = lambda x: x.cast("double") * F.lit(float(scale))
    # floor gives a long; doubles beyond that are whole as they are.
    whole = F.transform(F.col(vector), lambda x: F.when(F.abs(up(x)) < 2.0**53, F.floor(up(x)).cast("double")).otherwise(up(x)))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(up(x)) < float("inf")))
    rows = df.filter(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(key).cast("long").alias("id"), whole.alias("v"))
    top = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("__m")) * (x / F.col("__m")))
    return rows.withColumn("__m", top).withColumn("length", F.when(F.col("__m") > 0, F.col("__m") * F.sqrt(squares)).otherwise(0.0)).drop("__m")


def blocks(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """Blocks of about ``most`` rows (rid, id, v, length) with the same values of by, longest first."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = rows.join(counts, by).withColumn("part", F.expr("cast(pmod(xxhash64(rid), parts) as int)"))
    row = F.struct("length", "rid", "id", "v")
    return dealt.groupBy(*by, "part").agg(F.sort_array(F.collect_list(row), False).alias("x")).select(*by, "part", F.col("x.length").alias("lengths"), F.col("x.rid").alias("rids"), F.col("x.id").alias("ids"), F.col("x.v").alias("vectors"))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id."""
    if len(scores) > k:
        return np.lexsort((ids, ~scores))[:k]
    return np.arange(len(scores))


def _numbers(ids: list) -> np.ndarray:
    return np.array([_MOST if x is None else x for x in ids], np.int64)


class _Block:
    def __init__(self, r: dict, dimension: int):
        self.ids, self.rids, self.sizes = r["ids"], r["rids"], np.array(r["lengths"])
        self.order, self.vectors = _numbers(self.ids), matrix(r["vectors"], dimension)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            self.unit = np.nan_to_num(self.vectors / self.sizes[:, None]) if len(self.sizes) else self.vectors


def _dimension(*rows: dict) -> int:
    return max((len(v) for r in rows for v in r["vectors"]), default=0)


def pair(queries: dict, vectors: dict, k: int) -> Iterator[tuple[int, list[tuple]]]:
    """Each query's place in its block and its k best (score, id) in a block of vectors, from its threshold on."""
    dimension = _dimension(queries, vectors)
    q, v, least = _Block(queries, dimension), _Block(vectors, dimension), queries["least"]
    whole = []
    picked: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i, t in enumerate(least):
        places = None if t is None else candidates(q.vectors[i], float(q.sizes[i]), float(t), v.unit, v.sizes)
        if places is None or 4 * len(places) > len(v.sizes):
            whole.append(i)
        elif len(places):
            picked.append((i, places, products(q.vectors[i : i + 1], v.vectors[places])[0]))
    everything = np.arange(len(v.sizes))
    for at in range(0, len(whole), 128):
        some = whole[at : at + 128]
        picked += [(i, everything, s) for i, s in zip(some, products(q.vectors[some], v.vectors), strict=True)]
        yield from _chosen(picked, q, v, least, k)
        picked = []
    yield from _chosen(picked, q, v, least, k)


def _chosen(picked: list, q: _Block, v: _Block, least: list, k: int) -> Iterator[tuple[int, list[tuple]]]:
    for i, places, scores in picked:
        there = np.flatnonzero(scores >= (_LEAST if least[i] is None else least[i]))
        there = there[[v.ids[p] != q.ids[i] for p in places[there]]] if len(there) <= 64 else there[v.order[places[there]] != q.order[i]]
        there = there[best(scores[there], v.order[places[there]], k)]
        if len(there):
            yield i, [(int(scores[p]), v.ids[places[p]]) for p in there]


QUERY = "part int, lengths array<double>, rids array<long>, ids array<long>, vectors array<array<double>>, least array<long>, reach double"


def thresholds(queries: DataFrame, sample: dict, k: int) -> DataFrame:
    """Blocks of queries with what each one's k-th best result scores at least, and the length that a vector needs to reach any of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (x for batch in batches for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
            least: list = [None] * len(r["ids"])
            for i, found in pair(r | {"least": least}, sample, k):
                if len(found) == k:
                    least[i] = min(s for s, _ in found)
            reach = min((t / n if t is not None and t > 0 and n > 0 else 0.0 for t, n in zip(least, r["lengths"], strict=True)), default=0.0)
            yield pa.RecordBatch.from_pylist([{n: (r | {"least": least, "reach": reach * (1 - SLACK)})[n] for n in schema.names}], schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(queries.sparkSession.createDataFrame([], QUERY).schema)
    return queries.select("part", "lengths", "rids", "ids", "vectors").mapInArrow(run, QUERY)


def nearest(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, id and score of the k best rows for every row of which is_query (a condition on ``id``) holds."""
    spark, place = df.sparkSession, shared_dir(df.sparkSession)
    rows = keep(scaled(df, key, vector, scale).withColumn("rid", F.monotonically_increasing_id()), f"{place}/rows")
    step = F.floor(F.log("length") / math.log(STEP)).cast("int")
    index = keep(blocks(rows.withColumn("bucket", F.when(F.col("length") > 0, step).otherwise(1 << 20)), ["bucket"], ROWS).withColumn("longest", F.element_at("lengths", 1)), f"{place}/index")
    # One row for each bucket: as many as a double's range has steps at most, about 14,000.
    buckets = index.groupBy("bucket").agg(F.count("*").alias("parts"), F.max("longest").alias("longest")).collect()
    first = index.orderBy(F.desc("longest"), "bucket", "part").limit(1).collect()  # one block
    if not first:
        return spark.createDataFrame([], f"query_id long, rank int, `{key}` long, score long")
    queries = keep(thresholds(blocks(rows.filter(is_query).withColumn("all", F.lit(0)), ["all"], QUERIES), first[0].asDict(), k), f"{place}/queries")
    known = spark.createDataFrame([(0, [(r["bucket"], r["parts"], r["longest"]) for r in buckets])], "one int, known array<struct<bucket: int, parts: int, longest: double>>")
    near = queries.withColumn("one", F.lit(0)).join(F.broadcast(known), "one")
    near = near.select("*", F.explode(F.expr("filter(known, b -> b.longest >= reach)")).alias("b")).select("*", F.explode(F.expr("sequence(0, b.parts - 1)")).alias("p"))
    q = F.struct("lengths", "rids", "ids", "vectors", "least").alias("q")
    pairs = near.select(F.col("b.bucket").alias("bucket"), F.col("p").alias("part"), q).join(index.select("bucket", "part", F.struct("lengths", "rids", "ids", "vectors").alias("x")), ["bucket", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (x for batch in batches for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
            out = [(r["q"]["rids"][i], r["q"]["ids"][i], n, s) for i, found in pair(r["q"], r["x"], k) for s, n in found]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["rid", "query_id", "id", "score"])

    found = pairs.select("q", "x").mapInArrow(run, "rid long, query_id long, id long, score long")
    w = Window.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def op12_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for every fiftieth one."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)


OP12_SQL = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS cr, CAST(coalesce(list_sum(list_transform(range(1, greatest(len(q.v), len(c.v)) + 1), lambda i: coalesce(q.v[i], 0) * coalesce(c.v[i], 0))), 0) AS BIGINT) AS score
  FROM e q JOIN e c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % {EVERY} = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, cr) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM k WHERE rank <= {TOP}
"""
