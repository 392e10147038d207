"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Signature: every permutation keeps its minimum and its maximum, so 64 evaluations give 128 values,
each an unbiased estimate; a band takes two minima and two maxima of four permutations. With 32
bands of four a pair at similarity 0.8 shares no band with probability 5e-8.

1. Documents with equal shingle sets form a class, its smallest doc_id stands for it.
2. Representatives meet in band buckets. In each bucket all members are compared with one centre,
   the member that is in the largest buckets: pairs grow with the members, not their square.
3. Confirmed links give components.
4. Buckets whose members are not yet one component are finished exactly: the members outside the
   bucket's largest component meet all others, in blocks of bounded size that one task compares
   without emitting pairs. There a pair is skipped only if it is joined already or met in an earlier
   band; the full sets of all others are counted against each other.
5. Components of the second links join the first.

A link is always confirmed on full sets: ``100 * |A & B| >= 80 * |A | B|``.

Defined cases: a null or empty text has no shingles and links with nothing; a text of one to three
words has one shingle; a doc_id names one document, so rows that share it share its component; a row
with a null doc_id links with nothing, has a null component and is kept; an empty table gives an empty
result; further columns are ignored by ``near_duplicates`` and pass through ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, remove, shared_dir, slices, table
from .graph import components

WORDS, PER_CENT = 4, 80
PERMUTATIONS, BANDS, ROWS = 64, 32, 4
#: Rows of a block in step 4.
BLOCK = 512
_SEED = 20240229


class _Hashes(dict):
    """64-bit hashes of words, kept for the next ones; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def shingles(texts: list[str | None], memo: _Hashes, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    # bytes.lower() changes A-Z only and bytes.split() cuts at the six ASCII blanks.
    split = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    total = sum(map(len, split))
    hashes = np.fromiter(map(memo.__getitem__, (w for ws in split for w in ws)), dtype=np.uint64, count=total)
    factors = np.resize(_FACTORS, words) + np.arange(words, dtype=np.uint64) * np.uint64(2)
    rolled = np.zeros(max(0, total - words + 1), np.uint64)
    for k in range(words):
        rolled += _mixed(hashes[k : k + len(rolled)] * factors[k])
    rolled = _mixed(rolled)
    out, at = [], 0
    for ws in split:
        n = len(ws)
        if n >= words:
            out.append(np.unique(rolled[at : at + n - words + 1]))
        elif n:
            part = hashes[at : at + n]
            out.append(_mixed(np.array([sum(int(h) * (2 * k + 3) ** 9 for k, h in enumerate(part)) + n & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.Generator(np.random.PCG64(_SEED)).integers(0, 1 << 63, (2, count), dtype=np.uint64)
    return drawn[0] * np.uint64(2) + np.uint64(1), drawn[1]


def signatures(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """One row of 2 * permutations values per non-empty set, in order of bands."""
    factor, shift = _permutations(permutations)
    joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.cumsum([0, *map(len, sets)][:-1]) if sets else np.zeros(0, np.int64)
    low = np.empty((len(sets), permutations), np.uint32)
    high = np.empty_like(low)
    for k in range(permutations if sets else 0):
        value = ((joined * factor[k] + shift[k]) >> np.uint64(32)).astype(np.uint32)
        low[:, k] = np.minimum.reduceat(value, starts)
        high[:, k] = np.maximum.reduceat(value, starts)
    # Two minima and two maxima of different permutations make a band.
    bands = permutations // 2
    out = np.empty((len(sets), bands, 4), np.uint32)
    out[:, :, 0], out[:, :, 1] = low[:, 0::2], low[:, 1::2]
    out[:, :, 2], out[:, :, 3] = np.roll(high[:, 0::2], -1, axis=1), np.roll(high[:, 1::2], -1, axis=1)
    return out.reshape(len(sets), 2 * permutations)


def linked(a: np.ndarray, b: np.ndarray, per_cent: int = PER_CENT) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < per_cent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= per_cent * (len(a) + len(b) - both)


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            texts = batch.column(1)
            for i, j in slices(batch, [len(x.as_buffer()) if x.is_valid else 0 for x in texts], 1 << 20):
                sets = shingles(texts.slice(i, j - i).to_pylist(), memo, words)
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                marks = [next(rows).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(marks, pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "signature"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def _confirmed(pairs: DataFrame, words: int, per_cent: int) -> DataFrame:
    """The linked pairs of (u, v, text_u, text_v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last, own = _Hashes(), (None, None), None
        for batch in batches:
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = []
            for i in range(len(u)):  # rows come sorted by one side of the join, so its set is made once
                text = batch.column(2)[i].as_py()
                if last != (u[i], text):
                    last, own = (u[i], text), shingles([text], memo, words)[0]
                if linked(own, shingles([batch.column(3)[i].as_py()], memo, words)[0], per_cent):
                    found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in found], pa.int64()), pa.array([v[i] for i in found], pa.int64())], names=["u", "v"])

    return pairs.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def _compared(words: int, per_cent: int):
    """A function that finds the links between components within one pair of blocks."""

    def run(block: pa.Table) -> pa.Table:
        where = block.column("block").to_numpy()
        comps = block.column("comp").to_pylist()
        band = block.column("band")[0].as_py()
        # Signatures are made again from the texts: that costs less than moving them.
        sets, marks, memo = [], [], _Hashes()
        for i, j in slices(block, [len(x.as_buffer()) for x in block.column("text")], 1 << 20):
            own = shingles(block.column("text").slice(i, j - i).to_pylist(), memo, words)
            sets += own
            marks.append(signatures(own))
        marks = np.concatenate(marks)
        left = np.flatnonzero(where == where.min())
        right = np.flatnonzero(where == where.max())
        code = {c: i for i, c in enumerate(dict.fromkeys(comps))}
        code_of, parent = np.array([code[c] for c in comps]), list(range(len(code)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        found, names = [], list(code)
        # Shingles as places in the sorted list of all, so that one look-up per place counts an overlap.
        sizes = np.array([len(s) for s in sets])
        every, places = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        held = np.zeros(len(every), bool)
        for i in left:
            others = right[(code_of[right] != code_of[i]) & ((right > i) | (where[right] != where[i]))]
            low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
            others = others[100 * low >= per_cent * high]
            if not len(others):
                continue
            first = (marks[others] == marks[i]).reshape(len(others), BANDS, ROWS).all(axis=2).argmax(axis=1)
            others = others[first == band]
            own = places[ends[i] - sizes[i] : ends[i]]
            held[own] = True
            for j in others:
                a, b = root(int(code_of[i])), root(int(code_of[j]))
                if a == b:
                    continue
                both = int(np.count_nonzero(held[places[ends[j] - sizes[j] : ends[j]]]))
                if 100 * both >= per_cent * (int(sizes[i]) + int(sizes[j]) - both):
                    parent[a] = b
                    found.append((names[code_of[i]], names[code_of[j]]))
            held[own] = False
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([x for _, x in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, path: str | None = None, words: int = WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    path = path or shared_dir(docs.sparkSession)
    signed = keep(_signed(docs, words), f"{path}/signed")
    # Written, so that the joins with these small tables have an exchange on both sides: only then can
    # Spark split a digest or bucket that a large part of all rows share.
    heads = keep(signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")), f"{path}/heads")
    member = signed.join(heads, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"), F.when(F.col("doc_id") == F.col("rep"), F.col("signature")).alias("signature"))
    member = keep(member, f"{path}/members")
    nodes = member.filter("signature IS NOT NULL").select("rep", "signature")

    # Step 2: buckets with more than one node, and pairs with the centre of each.
    band = F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> struct(b AS band, xxhash64(b, substring(signature, b * {4 * ROWS} + 1, {4 * ROWS})) AS bucket))")).alias("b")
    rows = nodes.select("rep", band).select("rep", "b.band", "b.bucket")
    shared = rows.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("n")).filter("low <> high").select("bucket", "n")
    shared = keep(shared, f"{path}/shared")
    met = keep(rows.join(shared, "bucket"), f"{path}/met")
    weight = met.groupBy("rep").agg(F.sum("n").alias("weight"))
    centre = met.join(weight, "rep").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("c")).select("bucket", (-F.col("c.minus")).alias("centre"))
    centre = keep(centre, f"{path}/centres")
    pairs = keep(met.join(centre, "bucket").filter("rep <> centre").select(F.col("centre").alias("u"), F.col("rep").alias("v")).distinct(), f"{path}/pairs")

    # Texts of the nodes that meet others; rows of one id and text count once. A text without shingles
    # may share the id of one with some.
    needed = pairs.select(F.col("u").alias("doc_id")).unionAll(pairs.select(F.col("v").alias("doc_id"))).distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The ids grow with the corpus; the hint keeps one plan at every size and spares sorting the texts.
    texts = text.join(needed.hint("shuffle_hash"), "doc_id", "left_semi").withColumn("h", F.xxhash64("text")).groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    texts = keep(texts.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "text"), f"{path}/texts")
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    links = _confirmed(pairs.join(side("v"), "v").join(side("u"), "u"), words, per_cent)
    first = components(links, f"{path}/first")
    remove(docs.sparkSession, *(f"{path}/{x}" for x in ("signed", "heads", "shared", "centres", "pairs")))

    # Step 4: buckets of several components.
    placed = met.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    parts = placed.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("k", (-F.col("comp")).alias("minus"))).alias("top"), F.sum("k").alias("all"), F.count("*").alias("several"))
    # A bucket of two has met in step 2.
    mixed = mixed.filter("several > 1 AND `all` > 2").select(
        "bucket", (-F.col("top.minus")).alias("main"), F.ceil((F.col("all") - F.col("top.k")) / BLOCK).cast("int").alias("outer"), F.ceil(F.col("top.k") / BLOCK).cast("int").alias("inner")
    )
    open_rows = placed.join(mixed, "bucket").withColumn(
        "block", F.when(F.col("comp") == F.col("main"), F.expr("outer + pmod(xxhash64(rep), inner)")).otherwise(F.expr("pmod(xxhash64(rep), outer)")).cast("int")
    )
    meets = F.expr("""if(block >= outer, transform(sequence(0, outer - 1), j -> struct(j AS x, block AS y)),
        transform(sequence(0, outer + inner - 1), j -> struct(least(j, block) AS x, greatest(j, block) AS y)))""")
    spread = open_rows.select("bucket", "band", "rep", "comp", "block", F.explode(meets).alias("m")).select("bucket", "band", "rep", "comp", "block", "m.x", "m.y")
    full = spread.join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    more = full.groupBy("bucket", "x", "y").applyInArrow(_compared(words, per_cent), "u long, v long")
    second = components(more, f"{path}/second")
    remove(docs.sparkSession, f"{path}/met", f"{path}/texts")

    known = first.join(second.select(F.col("node").alias("component"), F.col("component").alias("above")), "component", "left")
    known = known.select(F.col("node").alias("rep"), F.coalesce("above", "component").alias("c"))
    # Nodes without a first link may have a second one.
    late = second.join(first, "node", "left_anti").select(F.col("node").alias("rep"), F.col("component").alias("c"))
    return member.select("doc_id", "n_shingles", "rep").join(known.unionAll(late), "rep", "left").select("doc_id", "n_shingles", F.coalesce("c", "rep").alias("component_id"))


def deduplicate(docs: DataFrame, path: str | None = None, words: int = WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """The rows of docs that stand for their component, and rows with a null doc_id."""
    found = near_duplicates(docs, path, words, per_cent)
    dropped = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.s = b.s WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
