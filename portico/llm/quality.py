"""Quality rules: base counts per document and line frequency across the documents of a host.

Lines are normalised (blanks collapsed, lower case) and hashed; per host the distinct documents with
a line are counted, where documents with equal texts are one and null texts none. A line is above the
limits if at least ``line_documents`` of the host's documents and more than ``line_share`` per cent of
them have it; the default share is 0, as a line that twenty pages of a host share is its furniture
whether the host has a hundred pages or a million. It is removed
from every document but the first (smallest doc_id) of the host that has it: ``judge`` gives the text
without it as ``cleaned``. A document of which less than ``keep_percent`` per cent of the words remain
is depleted and rejected.

Everything is DataFrame operations. Line counts are aggregated per task before each shuffle, and the
join with the few frequent lines is one that Spark can split, so a line that all documents share
costs no task more than its part.

Defined cases: a null text has no words and fails the base rules; a null source is a host of its
own; equal rows get equal verdicts; a null doc_id counts as no first holder; an empty table gives an
empty result; further columns pass through ``judge``, and its own columns replace ones of their name.
Equality of three-word windows and of lines goes by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, table

#: Limits of a line per host: per cent of its documents, documents; per cent of words that must remain.
LINE_SHARE, LINE_DOCUMENTS, KEEP_PERCENT = 0, 20, 50
#: Fixed values of the base rules: fewest words, most per cent of repeated words.
LEAST_WORDS, MOST_REPEATED = 50, 50
WORD = f"[^{BLANKS}]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_OWN = ("__text", "__words", "__sorted", "__places", "__lines")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, f"[{BLANKS}]+", " "))))


def _has_word(line: Column) -> Column:
    return line.rlike(f"[^{BLANKS}]")


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base counts of its text column."""
    df = df.drop(*COUNTS)
    out = df.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("__words", _words(F.col("__text")))
    hashes = "transform(__words, w -> xxhash64(w))"
    out = out.withColumn("__hashes", F.expr(hashes))
    n = "greatest(size(__hashes) - 2, 0)"
    windows = f"zip_with(zip_with(slice(__hashes, 1, {n}), slice(__hashes, 2, {n}), (a, b) -> xxhash64(a, b)), slice(__hashes, 3, {n}), (a, b) -> xxhash64(a, b))"
    out = out.withColumn("__sorted", F.expr(f"sort_array(transform({windows}, (h, i) -> struct(h AS h, i AS i)))"))
    m = "greatest(size(__sorted) - 1, 0)"
    out = out.withColumn("__same", F.expr(f"zip_with(slice(__sorted, 1, {m}), slice(__sorted, 2, {m}), (a, b) -> a.h = b.h)"))
    twice = "zip_with(concat(array(false), __same), concat(__same, array(false)), (a, b) -> a OR b)"
    out = out.withColumn("__places", F.expr(f"sort_array(filter(zip_with(__sorted, {twice}, (s, t) -> if(t, s.i, -1)), i -> i >= 0))"))
    covered = "aggregate(zip_with(__places, slice(__places, 2, size(__places)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (x, y) -> x + y)"
    out = out.withColumn("__lines", F.expr(rf"filter(split(__text, '\n', -1), l -> l rlike r'[^{BLANKS}]')"))
    counts = {
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.translate("__text", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.expr(covered),
    }
    # A generator of one row: filters on the counts stay above it. Pushed below, they would repeat the
    # nested arrays once for every mention.
    return out.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in counts.items()]))))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words"))


def _host() -> Column:
    """The source behind a mark; a null source is the only one without it."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def _keyed(df: DataFrame) -> DataFrame:
    """Columns by which equal rows are equal: id, host, hash of the text."""
    return df.filter("text IS NOT NULL").select(F.col("doc_id").alias("__id"), _host().alias("__host"), F.xxhash64("text").alias("__hash"), "text")


def removed_lines(docs: DataFrame, line_share: int = LINE_SHARE, line_documents: int = LINE_DOCUMENTS) -> DataFrame:
    """Words that lose their line, and the hashes of those lines: (__id, __host, __hash, __removed, __gone), of documents that lose any."""
    keyed = _keyed(docs)
    lines = (
        keyed.select("__id", "__host", "__hash", F.explode(F.split("text", "\n", -1)).alias("l"))
        .filter(_has_word(F.col("l")))
        .select("__id", "__host", "__hash", _line_hash(F.col("l")).alias("__line"), F.size(_words(F.col("l"))).alias("__n"))
    )
    once = lines.groupBy("__host", "__line", "__hash").agg(F.min("__id").alias("__id"))
    counts = once.groupBy("__host", "__line").agg(F.count("*").alias("n"), F.min("__id").alias("__first")).filter(F.col("n") >= line_documents)
    hosts = keyed.select("__host", "__hash").distinct().groupBy("__host").agg(F.count("*").alias("all"))
    frequent = counts.join(hosts, "__host").filter(F.lit(100) * F.col("n") > F.lit(line_share) * F.col("all")).select("__host", "__line", "__first")
    lost = lines.join(frequent, ["__host", "__line"]).filter(~F.col("__id").eqNullSafe(F.col("__first")))
    # Equal rows are counted together here and shared out again by the count of rows.
    rows = keyed.groupBy("__id", "__host", "__hash").agg(F.count("*").alias("__rows")).filter("__rows > 1")
    sums = lost.groupBy("__id", "__host", "__hash").agg(F.sum("__n").alias("__removed"), F.collect_set("__line").alias("__gone"))
    same = F.col("a.__id").eqNullSafe(F.col("b.__id")) & (F.col("a.__host") == F.col("b.__host")) & F.col("a.__hash").eqNullSafe(F.col("b.__hash"))
    return sums.alias("a").join(rows.alias("b"), same, "left").select(
        "a.__id", "a.__host", "a.__hash", F.expr("__removed div coalesce(__rows, 1)").alias("__removed"), "__gone"
    )


def judge(docs: DataFrame, line_share: int = LINE_SHARE, line_documents: int = LINE_DOCUMENTS, keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """docs (doc_id, text, source, ...) with the base counts, ``base_failed``, ``kept`` and ``cleaned``, the text without its removed lines."""
    counted = with_counts(docs.drop("base_failed", "kept", "cleaned")).withColumn("base_failed", base_failed())
    keyed = counted.withColumn("__host", _host()).withColumn("__hash", F.xxhash64("text"))
    lost = removed_lines(docs, line_share, line_documents)
    same = keyed["doc_id"].eqNullSafe(lost["__id"]) & (keyed["__host"] == lost["__host"]) & (keyed["__hash"] == lost["__hash"])
    left = F.col("n_words") - F.coalesce(F.col("__removed"), F.lit(0))
    kept = ~F.col("base_failed") & (F.lit(100) * left >= F.lit(keep_percent) * F.col("n_words"))
    stays = F.filter(F.split("text", "\n", -1), lambda x: ~(_has_word(x) & F.array_contains("__gone", _line_hash(x))))
    cleaned = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    joined = keyed.join(lost, same, "left").withColumn("__kept", kept).withColumn("__cleaned", cleaned)
    return joined.select(*counted.columns, F.col("__kept").alias("kept"), F.col("__cleaned").alias("cleaned"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept")


OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, text, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) > 2),
v AS (SELECT r, p, count(*) OVER (PARTITION BY r, w[p], w[p + 1], w[p + 2]) AS n FROM g),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM v WHERE n > 1) GROUP BY r),
b AS (SELECT d.*, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[{BLANKS}]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{BLANKS}]')) AS lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep ON d.r = rep.r),
f AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM b),
l AS (SELECT r, doc_id, host, text, line, len(regexp_extract_all(line, '{WORD}')) AS n, lower(trim(regexp_replace(line, '[{BLANKS}]+', ' ', 'g'))) AS norm
  FROM (SELECT r, doc_id, host, text, unnest(lines) AS line FROM f)),
c AS (SELECT host, norm, count(DISTINCT text) AS n, min(doc_id) AS first FROM l GROUP BY host, norm),
h AS (SELECT host, count(DISTINCT text) AS n FROM d GROUP BY host),
q AS (SELECT c.host, c.norm, c.first FROM c JOIN h ON c.host = h.host WHERE c.n >= {LINE_DOCUMENTS} AND 100 * c.n > {LINE_SHARE} * h.n),
x AS (SELECT l.r, sum(l.n) AS lost FROM l JOIN q ON l.host = q.host AND l.norm = q.norm WHERE l.doc_id IS DISTINCT FROM q.first GROUP BY l.r)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * (n_words - coalesce(x.lost, 0)) >= {KEEP_PERCENT} * n_words AS kept
FROM f LEFT JOIN x ON f.r = x.r
"""
