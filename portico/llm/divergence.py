"""Source divergence audit: how the word shares of a source differ from other sources and from its language.

``counted`` finds occurrences and documents of every term by group. A task takes some MB of text at a
time, as bytes: terms of up to 8 bytes become one 64-bit word and those of up to 16 two, which are
radix-sorted (16 bits a pass) and counted by runs; longer ones are sorted as bytes in buckets of equal
length. Documents are in order of group first and the sorts keep the order of equal terms, so one run
is a term of a group, and the steps of document in it are its documents. A task adds the runs up and
gives one row for each term and group, so that few rows are shuffled, once, by language and term.

``audit`` keeps the terms of a language that at least ``least`` of its documents have, V of them. The
share of a term in a group of c occurrences among N of kept terms is p = 1 + 10^9 (c + 5) div (N + 5V).
Part ``term``: the ``top`` terms of a group whose share exceeds that of the language. Part ``pair``: the
sum of the differences of shares for each two sources of a language; blocks of terms are tables of
source by term, of about ``CELLS`` cells (more if there are many sources), and each block adds to all
pairs.

Defined cases: null text, lang or source is ''; a group without terms has N = 0; a language without
kept terms gives pairs of value 0 and no terms; equal values are ranked by item in order of its bytes;
repeated rows count each; an empty table gives an empty result; further columns are ignored. A text is
held whole by its task. Pairs of sources are as many as the contract asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, shared_dir, slices, table

#: Fixed value: the characters that are no part of a term, as the body of a pattern's negated class.
BREAKS = r"\x00-\x40\x5B-\x60\x7B-\x7F"
LEAST, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
#: Bytes of text handled at a time, rows of runs that a task gathers, cells of a block of sources and terms, sources of a tile.
BYTES, ROWS, CELLS, TILE = 8 << 20, 2 << 20, 1 << 16, 128

_CODES = np.arange(256, dtype=np.uint8)
_LETTER = ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and documents of the terms in texts that lie one after another."""
    letter = _LETTER[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(letter & (border[:-1] | ~np.concatenate([[False], letter[:-1]])))
    ends = np.flatnonzero(letter & (border[1:] | ~np.concatenate([letter[1:], [False]]))) + 1
    return starts, ends - starts, np.searchsorted(offsets, starts, "right") - 1


def packed(lower: np.ndarray, starts: np.ndarray, sizes: np.ndarray, words: int) -> list[np.ndarray]:
    """Terms of 8 * (words - 1) + 1 to 8 * words bytes as big-endian words, filled up with zeros. lower has 8 bytes to spare."""
    at = np.ndarray((len(lower) - 7,), ">u8", lower, 0, (1,))
    out = [at[starts + 8 * k].astype(np.uint64) for k in range(words)]
    spare = ((8 * words - sizes) * 8).astype(np.uint64)
    out[-1] = (out[-1] >> spare) << spare
    return out


def radix(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by words, the first one most significant: 16 bits a pass, passes without a difference left out."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def steps(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


class _Runs:
    """Terms of one width with their groups, occurrences and documents."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, words: list[np.ndarray], group: np.ndarray, doc: np.ndarray) -> None:
        order = radix(words) if words[0].dtype == np.uint64 else np.argsort(words[0], kind="stable")
        words, group, doc = [w[order] for w in words], group[order], doc[order]
        new = steps([*words, group])
        at = np.flatnonzero(new)
        if len(at):
            docs = np.add.reduceat((new | steps([doc])).astype(np.int64), at)
            self.parts.append(([w[at] for w in words], group[at], np.diff(at, append=len(new)), docs))

    def rows(self) -> int:
        return sum(len(p[1]) for p in self.parts)

    def merge(self) -> None:
        if len(self.parts) > 1:
            words = [np.concatenate(w) for w in zip(*(p[0] for p in self.parts), strict=True)]
            group, n, docs = (np.concatenate([p[k] for p in self.parts]) for k in (1, 2, 3))
            by = [group.astype(np.uint64)]
            order = radix(words + by) if words[0].dtype == np.uint64 else np.lexsort((group, words[0]))
            words, group = [w[order] for w in words], group[order]
            at = np.flatnonzero(steps([*words, group]))
            self.parts = [([w[at] for w in words], group[at], np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at))]


def _texts(words: list[np.ndarray]) -> pa.Array:
    """Terms as strings: zeros at the end are no part of them, as no term has a zero."""
    if words[0].dtype == np.uint64:
        words = [np.ascontiguousarray(np.stack(words, axis=1).astype(">u8")).view(f"S{8 * len(words)}").ravel()]
    return pa.array(words[0], pa.binary()).cast(pa.string())


COUNTED = "lang string, source string, term string, n long, docs long"


def counted(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, its occurrences and documents; some rows for a term of a group, one of each task at best."""
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple, int] = {}
        held: dict[int, _Runs] = {}

        def out() -> Iterator[pa.RecordBatch]:
            langs, sources = (pa.array([g[k] for g in codes], pa.string()) for k in (0, 1))
            for runs in held.values():
                runs.merge()
                for words, group, n, docs in runs.parts:
                    for i in range(0, len(group), 1 << 16):
                        part = slice(i, i + (1 << 16))
                        which = pa.array(group[part])
                        yield pa.RecordBatch.from_arrays([langs.take(which), sources.take(which), _texts([w[part] for w in words]), pa.array(n[part]), pa.array(docs[part])], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for i, j in slices(batch, [len(x.as_buffer()) for x in batch.column(2)], BYTES):
                part = batch.slice(i, j - i)
                own = np.array([codes.setdefault(g, len(codes)) for g in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)])
                order = np.argsort(own, kind="stable")
                texts = part.column(2).take(pa.array(order)).cast(pa.large_binary())
                own, offsets = own[order], np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                starts, sizes, doc = spans(data, offsets - offsets[0])
                lower = np.concatenate([_LOWER[data], np.zeros(16, np.uint8)])
                for width in (1, 2):
                    mine = (sizes > 8 * width - 8) & (sizes <= 8 * width)
                    if mine.any():
                        held.setdefault(width, _Runs()).add(packed(lower, starts[mine], sizes[mine], width), own[doc[mine]], doc[mine])
                long = sizes > 16
                for size in np.unique(sizes[long]).tolist():
                    mine = sizes == size
                    term = np.ascontiguousarray(lower[starts[mine][:, None] + np.arange(size)]).view(f"S{size}").ravel()
                    held.setdefault(size, _Runs()).add([term], own[doc[mine]], doc[mine])
                if sum(r.rows() for r in held.values()) > 2 * ROWS:
                    for r in held.values():
                        r.merge()
                    if sum(r.rows() for r in held.values()) > ROWS:
                        yield from out()
        yield from out()

    return rows.mapInArrow(run, COUNTED)


def share(n: Column, total: Column, kinds: Column) -> Column:
    """1 + 10^9 (n + 5) div (total + 5 kinds), exact beyond 64 bits."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", up, (total + PRIOR * kinds).cast("decimal(20,0)"))


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (a before b) and the sum of the differences of their shares, by blocks of terms."""
    per = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("kinds").alias("kinds"))
    terms = F.greatest(F.lit(1.0), CELLS / F.col("sources"), F.col("sources") / 8)  # many sources: fewer sums for each pair
    blocks = per.select("lang", F.greatest(F.lit(1), F.ceil(F.col("kinds") / terms)).cast("int").alias("blocks"))
    sized = groups.join(blocks, "lang")
    alone = F.when(F.col("kinds") > 0, share(F.lit(0), F.col("total"), F.col("kinds"))).otherwise(F.lit(0))
    bare = sized.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), alone.alias("p"))
    own = kept.join(sized, ["lang", "source"]).select("lang", F.expr("cast(pmod(xxhash64(term), blocks) as int)").alias("block"), "source", "term", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"))

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        bare = rows[rows["term"].isna()].sort_values("source", key=lambda s: s.map(str.encode))
        names, alone = bare["source"].to_numpy(), bare["p"].to_numpy(np.int64)
        there = rows[rows["term"].notna()]
        at = pd.Series(np.arange(len(names)), index=names)
        place, terms = pd.factorize(there["term"])
        shares = np.repeat(alone[:, None], len(terms), axis=1)
        shares[at[there["source"]].to_numpy(), place] = there["p"].to_numpy(np.int64)
        found = []
        for i in range(0, len(names), TILE):
            for a in range(i, min(i + TILE, len(names) - 1)):
                found.append(pd.DataFrame({"a": names[a], "b": names[a + 1 :], "value": np.concatenate([np.abs(shares[j : j + TILE] - shares[a]).sum(axis=1) for j in range(a + 1, len(names), TILE)])}))
        out = pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "value": []}).astype({"a": object, "b": object, "value": "int64"})
        out.insert(0, "lang", rows["lang"].iloc[0])
        return out

    parts = bare.unionByName(own).groupBy("lang", "block").applyInPandas(block, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of all pairs of sources and of the most over-represented terms."""
    name = lambda c, n: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
    found = counted(df, lang, source, text).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # a row for each source that has the term
    found = found.select("lang", "term", "source", "n", F.sum("n").over(term).alias("all_n"), F.sum("docs").over(term).alias("all_docs"), (F.col("source") == F.min("source").over(term)).alias("first"))
    kept = keep(found.filter(F.col("all_docs") >= least).drop("all_docs"), shared_dir(df.sparkSession))
    kinds = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("kinds"), F.sum("n").alias("all_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = df.select(name(lang, "lang"), name(source, "source")).distinct().join(totals, ["lang", "source"], "left").join(kinds, "lang", "left").fillna(0, ["total", "kinds", "all_total"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    p, q = share(F.col("n"), F.col("total"), F.col("kinds")), share(F.col("all_n"), F.col("all_total"), F.col("kinds"))
    over = kept.join(groups, ["lang", "source"]).filter("n > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    terms = over.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top)
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    pairs = _pairs(kept, groups).select("lang", both, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    return pairs.withColumn("rank", F.row_number().over(order).cast("int")).unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and over-represented terms of all documents."""
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{BREAKS}]+') AS t FROM documents),
o AS (SELECT r, lang, source, unnest(t) AS term FROM d),
v AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN v USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, count(*) AS v FROM v GROUP BY lang),
ng AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
nl AS (SELECT lang, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + (CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + {PRIOR})) // (coalesce(ng.total, 0) + {PRIOR} * k.v) AS p
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term LEFT JOIN ng ON ng.lang = g.lang AND ng.source = g.source),
q AS (SELECT c.lang, c.term, 1 + (CAST({SCALE} AS HUGEINT) * (sum(n) + {PRIOR})) // (any_value(nl.total) + {PRIOR} * any_value(k.v)) AS q FROM c JOIN nl ON nl.lang = c.lang JOIN k ON k.lang = c.lang GROUP BY c.lang, c.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
w AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM e)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM w WHERE part = 'pair' OR rank <= {TOP}
"""
