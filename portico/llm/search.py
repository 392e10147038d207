"""Ranked lexical search over bit-sliced Bloom signatures.

``build`` turns documents into blocks. A document's keys are its terms, once for each level of
occurrences that they reach (1, 2, 3, 5, 9, 17, ...); a block holds documents with about as many keys,
and its bit matrix has a row for each Bloom position and a column for each document. The AND of a key's
rows marks every document that has it, and some that don't. ``search`` answers a query set from them:

1. the document frequencies of the queries' terms are summed from the blocks' vocabularies;
2. the marked columns of each term, weighted by the most that its level can add in that document, are
   summed to an upper bound for every query and document; the best by bound are scored exactly, which
   gives each query a score that its last result has at least;
3. every document whose bound doesn't stay below that score (or ties with it at a smaller key) is
   scored exactly from its text. Nothing else is left out, so the result is exact.

A query's terms are counted once each. A term weighs w = floor(1000 ln((2N+2)/(2df+1))); a document of
n terms has m = 50 + 50nN div L, and scores the sum of w * (10^9 tf div (1000 tf + 20 m)).

Blocks are written with their texts, in small row groups, and go to Python one at a time, so that a task
holds some MB of them however large its file is. Scoring moves no text between tasks: all that is shuffled
are frequencies of query terms and at most ``k`` rows of each query and task. Queries are taken
``ITEMS`` at a time (or fewer, if their texts are long); the driver holds one such block, its term
weights and k candidates of each query; its answers are written before the next block.

Defined cases: null and empty texts have no terms and count nowhere; rows of equal text or key are
documents each; a null key comes last among equal scores; each row of the query set is a query, whatever
its id, and one without terms (or of which no document has a term of weight above 0) has no result; an
empty table gives an empty result; further columns are ignored. A text is held whole by its task, and
so are the distinct terms of one query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, keep, shared_dir, slices, table

#: Fixed value: the characters that are no part of a term, as the body of a pattern's negated class.
BREAKS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
TOP = 50
#: Positions of a key, Bloom bits for a key, documents and cells of a block, queries and bytes of a query block.
HASHES, BITS, DOCUMENTS, CELLS, ITEMS, ITEM_BYTES = 4, 12, 1024, 1 << 23, 256, 4 << 20
#: Query terms whose slices are unpacked at a time.
TERMS = 2048
#: Keys of a block whose positions are marked at a time.
KEYS = 1 << 16
#: Texts and blocks that a task sends to Python at once. A block has up to some MB.
TEXTS, BLOCKS = 64, 1
#: The index's row groups end after some MB, whatever a block's size: the writer would look after a hundred rows only, and readers hold a group.
WRITER = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}
LAST = np.iinfo(np.int64).max  # stands for a null key, in the order of keys

_LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order. Every byte of a character beyond ASCII is part of a term, so bytes will do."""
    return (text or "").encode().translate(_LETTERS).split()


def level(tf: int) -> int:
    """The highest level that tf occurrences reach; level j stands for up to 2**j of them."""
    return (tf - 1).bit_length()


def _hashes(term: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in term), np.uint64, len(term))


def positions(hashed: np.ndarray, at: np.ndarray | int, rows: int) -> np.ndarray:
    """The ``HASHES`` rows of each (hash of a term, level)."""
    key = hashed + np.asarray(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    step = (key >> np.uint64(32)) | np.uint64(1)
    return ((key[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(rows)).astype(np.int64)


BLOCK = "size int, rows int, top int, total long, keys binary, lengths binary, bits binary, vocabulary binary, frequencies binary, ids array<{key}>, texts array<string>"


class _Open:
    """A block that is being filled: a document's terms are numbers in its vocabulary, its counts are not held."""

    def __init__(self):
        self.docs, self.place, self.which, self.reach = [], {}, [], []

    def add(self, o: int, key: object, text: str, counts: Counter) -> None:
        """o: the order key."""
        place = self.place
        self.which.append(np.fromiter((place.setdefault(t, len(place)) for t in counts), np.int32, len(counts)))
        self.reach.append(np.fromiter((level(n) for n in counts.values()), np.int8, len(counts)))
        self.docs.append((o, key, text, counts.total()))

    def closed(self, rows: int) -> dict:
        """Columns stand in order of key."""
        order = sorted(range(len(self.docs)), key=lambda i: self.docs[i][0])
        docs, vocabulary = [self.docs[i] for i in order], list(self.place)
        which, reach = np.concatenate([self.which[i] for i in order]), np.concatenate([self.reach[i] for i in order])
        column = np.repeat(np.arange(len(docs)), [len(self.which[i]) for i in order])
        hashed, marks = _hashes(vocabulary), np.zeros((rows, len(docs)), bool)
        for j in range(int(reach.max()) + 1):
            there = np.flatnonzero(reach >= j)
            for i in range(0, len(there), KEYS):
                own = there[i : i + KEYS]
                marks[positions(hashed[which[own]], j, rows), column[own][:, None]] = True
        lengths = np.array([d[3] for d in docs], np.int64)
        return {
            "size": len(docs), "rows": rows, "top": int(reach.max()), "total": int(lengths.sum()), "keys": np.array([d[0] for d in docs], np.int64).tobytes(), "lengths": lengths.tobytes(),
            "bits": np.packbits(marks, axis=1).tobytes(), "vocabulary": b" ".join(vocabulary), "frequencies": np.bincount(which, minlength=len(vocabulary)).astype(np.int64).tobytes(), "ids": [d[1] for d in docs], "texts": [d[2] for d in docs],
        }


def _block(docs: list[tuple], rows: int) -> dict:
    """docs: (order key, id, text, counts)."""
    block = _Open()
    for d in docs:
        block.add(*d)
    return block.closed(rows)


def build(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of signatures, vocabularies and texts of a partition's documents; no shuffle. key is a column of whole numbers."""
    kind = df.schema[key].dataType.simpleString()
    schema = BLOCK.format(key=kind)
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Open] = {}
        table_of = lambda c: pa.RecordBatch.from_pylist([held.pop(c).closed(BITS << c)], arrow)
        for batch in batches:
            for i, j in slices(batch, [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)]):
                part = batch.slice(i, j - i)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts = Counter(terms(t))
                    if not counts:
                        continue
                    keys = sum(level(n) + 1 for n in counts.values())
                    c = max(4, (keys - 1).bit_length())
                    held.setdefault(c, _Open()).add(LAST if k is None else k, k, t, counts)
                    if len(held[c].docs) >= max(1, min(DOCUMENTS, CELLS // (BITS << c))):
                        yield table_of(c)
        for c in sorted(held):
            yield table_of(c)

    return rows.mapInArrow(run, schema)


class Queries:
    """A block of queries: their terms, and weights once the frequencies are known."""

    def __init__(self, texts: list[str | None]):
        each = [list(dict.fromkeys(terms(t))) for t in texts]
        self.terms = list(dict.fromkeys(t for q in each for t in q))
        self.place = {t: i for i, t in enumerate(self.terms)}
        self.each = [np.array(sorted(self.place[t] for t in q), np.int64) for q in each]
        self.hashed = _hashes(self.terms)

    def weigh(self, documents: int, total: int, frequency: dict[bytes, int]) -> None:
        self.documents, self.total = documents, total
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency.get(t, 0) + 1))) for t in self.terms], np.float64)

    def norm(self, n: int) -> int:
        return 50 + 50 * n * self.documents // self.total

    def score(self, query: int, counts: Counter, norm: int) -> int:
        out = 0
        for i in self.each[query].tolist():
            if tf := counts.get(self.terms[i], 0):
                out += int(self.weights[i]) * (1_000_000_000 * tf // (1000 * tf + 20 * norm))
        return out

    def bounds(self, size: int, rows: int, top: int, lengths: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """An upper bound of each query's score in each document of a block; whole numbers as doubles."""
        norms = np.array([self.norm(n) for n in lengths.tolist()], np.int64)
        most = np.array([(1_000_000_000 << j) // ((1000 << j) + 20 * norms) for j in range(top + 1)])
        gain = np.diff(most, axis=0, prepend=0).astype(np.float32)  # below 10^6, so exact
        out = np.zeros((len(self.each), size))
        for low in range(0, len(self.terms), TERMS):
            part = self.hashed[low : low + TERMS]
            alive, share = np.arange(len(part)), np.zeros((len(part), size), np.float32)
            marks = np.full((len(part), bits.shape[1]), 255, np.uint8)
            for j in range(top + 1):
                at = positions(part[alive], j, rows)
                marks = marks & np.bitwise_and.reduce(bits[at], axis=1)
                left = marks.any(axis=1)
                alive, marks = alive[left], marks[left]
                if not len(alive):
                    break
                share[alive] += np.unpackbits(marks, axis=1, count=size) * gain[j]
            for q, own in enumerate(self.each):
                own = own[np.searchsorted(own, low) : np.searchsorted(own, low + TERMS)]
                if len(own):
                    out[q] += self.weights[own] @ share[own - low].astype(np.float64)
        return out * (1 + 1e-12) if len(out) and out.max() > 2**53 else out


def _unpacked(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bits = np.frombuffer(r["bits"], np.uint8).reshape(r["rows"], -1) if "bits" in r else None
    return np.frombuffer(r["keys"], np.int64), np.frombuffer(r["lengths"], np.int64), bits


class _Best:
    """The k highest rows of each query, ties by key."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def add(self, query: int, scores: np.ndarray, keys: np.ndarray, what: np.ndarray) -> None:
        old = self.rows.get(query)
        if old is not None:
            scores, keys, what = np.concatenate([old[0], scores]), np.concatenate([old[1], keys]), np.concatenate([old[2], what])
        if len(scores) > self.k:
            order = np.lexsort((keys, -scores))[: self.k]
            scores, keys, what = scores[order], keys[order], what[order]
        self.rows[query] = scores, keys, what


def _frequencies(index: DataFrame, q: Queries) -> dict[bytes, int]:
    place = q.place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(place), np.int64)
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1), strict=True):
                for t, n in zip(words.as_py().split(), np.frombuffer(counts.as_py(), np.int64).tolist(), strict=True):
                    if (i := place.get(t)) is not None:
                        found[i] += n
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["i", "n"])

    rows = index.select("vocabulary", "frequencies").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    return {q.terms[r["i"]]: r["n"] for r in rows}  # one row for each term of the block of queries at most


def _candidates(index: DataFrame, q: Queries, k: int) -> list:
    """The k documents of the highest bounds of each query: query, task and place of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                keys, lengths, bits = _unpacked(r)
                bounds = q.bounds(r["size"], r["rows"], r["top"], lengths, bits)
                what = np.array([(r["block"], i) for i in range(r["size"])], "i8,i8")
                for n in range(len(q.each)):
                    if len(there := np.flatnonzero(bounds[n] > 0)):
                        best.add(n, bounds[n][there], keys[there], what[there])
        rows = [(n, b, i, s, o) for n, (scores, keys, what) in best.rows.items() for s, o, (b, i) in zip(scores.tolist(), keys.tolist(), what.tolist(), strict=True)]
        yield pa.RecordBatch.from_pylist([dict(zip(("q", "block", "place", "bound", "o"), x, strict=True)) for x in rows], pa.schema([("q", pa.int64()), ("block", pa.int64()), ("place", pa.int64()), ("bound", pa.float64()), ("o", pa.int64())]))

    found = index.select("block", "size", "rows", "top", "keys", "lengths", "bits").mapInArrow(run, "q long, block long, place long, bound double, o long")
    w = Window.partitionBy("q").orderBy(F.desc("bound"), "o", "block", "place")
    return found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select("q", "block", "place").collect()  # k rows of each query of the block at most


def _scored(index: DataFrame, q: Queries, k: int, columns: list[str], pick: Callable) -> DataFrame:
    """The k highest exact scores above 0 of each query and task, of the (query, places) that pick gives for a block."""
    kind = index.schema["ids"].dataType.elementType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("q", pa.int64()), ("score", pa.int64()), ("o", pa.int64()), ("id", to_arrow_type(kind)), ("block", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            texts, light = batch.column(batch.schema.get_field_index("texts")), batch.drop_columns(["texts"])
            for row in range(batch.num_rows):
                r = light.slice(row, 1).to_pylist()[0]
                keys, lengths, bits = _unpacked(r)
                wanted: dict[int, list[int]] = {}
                for n, places in pick(r, keys, lengths, bits):
                    for i in places:
                        wanted.setdefault(i, []).append(n)
                found: dict[int, list[tuple]] = {}
                for i, own in wanted.items():
                    counts, norm = Counter(terms(texts[row][i].as_py())), q.norm(int(lengths[i]))
                    for n in own:
                        if (s := q.score(n, counts, norm)) > 0:
                            found.setdefault(n, []).append((s, int(keys[i]), (r["block"], i, r["ids"][i])))
                for n, rows in found.items():
                    what = np.empty(len(rows), object)
                    what[:] = [x[2] for x in rows]
                    best.add(n, np.array([x[0] for x in rows], np.int64), np.array([x[1] for x in rows], np.int64), what)
        rows = [{"q": n, "score": s, "o": o, "id": x[2], "block": x[0], "place": x[1]} for n, (scores, keys, what) in best.rows.items() for s, o, x in zip(scores.tolist(), keys.tolist(), what.tolist(), strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema)

    kind_name = kind.simpleString()
    return index.select("block", "size", "rows", "top", "keys", "lengths", "ids", "texts", *columns).mapInArrow(run, f"q long, score long, o long, id {kind_name}, block long, place long")


def _least(rows: list, queries: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The score that each query's last result has at least, and the key up to which a tie can still enter."""
    least, last = np.zeros(queries), np.full(queries, LAST)
    each: dict[int, list] = {}
    for r in rows:
        each.setdefault(r["q"], []).append((-r["score"], r["o"]))
    for n, own in each.items():
        if len(own) >= k:
            score, key = sorted(own)[k - 1]
            least[n], last[n] = -score, key
    return least, last


def search(index: DataFrame, texts: list[str | None], k: int = TOP) -> DataFrame:
    """q (place in texts), id and score of the k best documents of each query, and of some more.

    index: blocks of ``build`` with a number ``block`` each, from a written table. texts: one block of queries.
    """
    q = Queries(texts)
    sums = index.agg(F.sum("size").alias("n"), F.sum("total").alias("l")).first()
    q.weigh(sums["n"] or 0, sums["l"] or 0, _frequencies(index, q))
    wanted: dict[int, dict[int, list[int]]] = {}
    for r in _candidates(index, q, k):
        wanted.setdefault(r["block"], {}).setdefault(r["q"], []).append(r["place"])
    seeds = _scored(index, q, k, [], lambda r, *_: wanted.get(r["block"], {}).items()).select("q", "score", "o").collect()  # k of each query at most
    least, last = _least(seeds, len(texts), k)

    def pick(r: dict, keys: np.ndarray, lengths: np.ndarray, bits: np.ndarray) -> Iterator[tuple]:
        bounds = q.bounds(r["size"], r["rows"], r["top"], lengths, bits)
        for n in range(len(texts)):
            may = (bounds[n] > 0) & ((bounds[n] > least[n]) | ((bounds[n] == least[n]) & (keys <= last[n])))
            if may.any():
                yield n, np.flatnonzero(may).tolist()

    return _scored(index, q, k, ["bits"], pick)


def numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with a number each."""
    return blocks.withColumn("block", F.monotonically_increasing_id())


def query_blocks(queries: DataFrame, item: str, text: str) -> Iterator[list]:
    """The rows of a query set, some at a time; a partition of it is read by the driver at once."""
    held, size = [], 0
    for r in queries.select(item, text).toLocalIterator():
        n = len((r[1] or "").encode())
        if held and (len(held) >= ITEMS or size + n > ITEM_BYTES):
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += n
    if held:
        yield held


def ranked(documents: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = TOP) -> DataFrame:
    """item, rank, key and score of the k highest-scoring documents of each query."""
    spark, place = documents.sparkSession, shared_dir(documents.sparkSession)
    with arrow_rows(spark, TEXTS):
        index = keep(numbered(build(documents, key, text)), f"{place}/index", **WRITER)
    kinds = queries.schema[item].dataType.simpleString(), documents.schema[key].dataType.simpleString()
    schema = f"`{item}` {kinds[0]}, rank int, `{key}` {kinds[1]}, score long"
    spark.createDataFrame([], schema).write.parquet(f"{place}/answers")
    for block in query_blocks(queries, item, item_text):
        with arrow_rows(spark, BLOCKS):
            found = search(index, [t for _, t in block], k)
            w = Window.partitionBy("q").orderBy(F.desc("score"), "o", "block", "place")
            best = found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
            names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"q long, item {kinds[0]}")
            best = best.join(F.broadcast(names), "q")  # at most ITEMS rows
            best.select(F.col("item").alias(item), "rank", F.col("id").alias(key), "score").write.mode("append").parquet(f"{place}/answers")
    return spark.read.schema(schema).parquet(f"{place}/answers")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{BREAKS}]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS t FROM benchmark),
it AS (SELECT q, item_id, unnest(t) AS term FROM i),
p AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM it) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
c AS (SELECT it.q, it.item_id, tf.r, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM it JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
