"""Secret scans: fixed patterns plus two character Markov models compared by likelihood.

``train`` counts character transitions of random strings and of ordinary identifiers in a bounded
sample of labelled documents; ``find`` marks the fixed patterns and every other long token whose
log-likelihood ratio of random over ordinary exceeds ``margin``; ``redact`` replaces what was found.

Fixed kinds are whole matches, leftmost and non-overlapping per kind, short ones dropped after
matching; a token that overlaps one of them is not reported again. Positions are code points.

Defined cases: a null or empty text has no spans (redacted, null stays null); without labelled
documents the ordinary model is uniform apart from smoothing; repeated rows are scanned alike;
further columns pass through; an empty table gives an empty result. A text is scanned whole, so a
task holds the longest text and a batch of a few MB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, shared_dir, slices, table

#: The patterns, the group that is measured, and the least length.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "markov")
_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(r"[0-9a-f]{16,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Characters of tokens; the model's states are these and one for the start.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What training leaves out of the ordinary tokens, and such a token.
MATCHES, ORDINARY = f"(?:(?i){ASSIGN})|(?:{ACCESS})|(?:[0-9a-f]{{16,}})", "[A-Za-z0-9+/_=-]{6,}"
#: Labelled documents that training reads at most, and the log odds that a token must exceed.
TRAIN_DOCUMENTS, MARGIN = 2000, 16.0
SMOOTHING = 0.5


def train(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> np.ndarray:
    """Log-likelihood ratio of each transition, random over ordinary, as a matrix.

    The sample is the ``most`` documents labelled as good whose ids' digests come first. Its labels for
    secrets are the fixed patterns: random strings are the values of matches that are long enough, and
    digests of the sample's ids in hexadecimal and base 64. Ordinary identifiers are the tokens of six
    or more characters outside of all matches, each as it is, in capitals, and joined with itself as
    ``a_a`` and ``aA``. Equal tokens are counted before their characters are.
    """
    picked = labels.filter("quality = 1").select("doc_id").distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    sample = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id", "left_semi")  # at most ``most`` ids
    # Written first: else the optimizer moves the patterns below the join, onto every document.
    sample = keep(sample, shared_dir(documents.sparkSession))
    digest = F.unhex(F.sha2(F.col("doc_id").cast("string"), 256))
    long = lambda found, least: F.filter(found, lambda x: F.length(x) >= least)
    every = lambda pattern, group: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    strings = sample.select(
        F.regexp_extract_all(F.regexp_replace("text", MATCHES, " "), F.lit(ORDINARY), F.lit(0)).alias("ordinary"),
        F.concat(
            long(every(HEX, 0), LEAST["hex"]), long(every(ACCESS, 0), LEAST["access"]), long(every(f"(?i){ASSIGN}", 2), LEAST["assign"]),
            F.array(F.lower(F.hex(digest)), F.base64(digest)),
        ).alias("random"),
    )
    tokens = strings.select(F.lit(0).alias("random"), F.explode("ordinary").alias("s")).unionAll(strings.select(F.lit(1), F.explode("random")))
    tokens = tokens.groupBy("random", "s").agg(F.count("*").alias("n"))
    own = F.col("s")
    forms = F.array(own, F.upper(own), F.concat(own, F.lit("_"), own), F.concat(own, F.upper(F.substring(own, 1, 1)), F.expr("substring(s, 2)")))
    tokens = tokens.select("random", "n", F.explode(F.when(F.col("random") == 0, forms).otherwise(F.array(own))).alias("s"))
    pairs = tokens.select("random", "n", F.explode(F.expr("transform(sequence(1, length(s)), i -> struct(if(i = 1, '', substring(s, i - 1, 1)) AS a, substring(s, i, 1) AS b))")).alias("p"))
    counts = pairs.groupBy("random", "p.a", "p.b").agg(F.sum("n").alias("n"))
    n = len(ALPHABET)
    seen = np.full((2, n + 1, n), SMOOTHING)
    at = {c: i for i, c in enumerate(ALPHABET)}
    for r in counts.collect():  # no more than two counts for each pair of characters of the patterns' alphabet
        if r["b"] in at and (r["a"] == "" or r["a"] in at):
            seen[r["random"], at.get(r["a"], n), at[r["b"]]] += r["n"]
    share = np.log(seen / seen.sum(axis=2, keepdims=True))
    return share[1] - share[0]


def _codes() -> np.ndarray:
    out = np.zeros(128, np.int64)
    for i, c in enumerate(ALPHABET):
        out[ord(c)] = i
    return out


CODES = _codes()


def score(token: str, model: np.ndarray) -> float:
    """Log-likelihood ratio of a token, random over ordinary."""
    codes = CODES[np.frombuffer(token.encode("ascii"), np.uint8)]
    return float(model[len(ALPHABET), codes[0]] + model[codes[:-1], codes[1:]].sum())


def spans(text: str | None, model: np.ndarray, margin: float = MARGIN) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, score) by start, then kind."""
    found: list[tuple[str, int, int, float | None]] = []
    if not text:
        return found
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end(), None) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]  # every long run of hexadecimal digits lies in one
    for a, b in tokens:
        found += [("hex", m.start(), m.end(), None) for m in _HEX.finditer(text, a, b)]
    base = sorted((s, e) for _, s, e, _ in found)
    k = 0
    for a, b in tokens:
        while k < len(base) and base[k][1] <= a:
            k += 1
        if not any(s < b and a < e for s, e in base[k : k + 3]) and (x := score(text[a:b], model)) > margin:
            found.append(("markov", a, b, x))
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def find(df: DataFrame, model: np.ndarray, text: str = "text", out: str = "spans", margin: float = MARGIN) -> DataFrame:
    """df with the spans of secrets in its text column."""
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for i, j in slices(batch, [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(at)]):
                part = batch.slice(i, j - i)
                found = [[{"kind": k, "start": a, "end": b, "score": x} for k, a, b, x in spans(t, model, margin)] for t in part.column(at).to_pylist()]
                cols = {n: part.column(c) for c, n in enumerate(part.schema.names)} | {out: pa.array(found, kind)}
                yield pa.RecordBatch.from_arrays([cols[n] for n in schema.names], names=schema.names)

    return df.mapInArrow(run, schema)


MARK = "[SECRET]"


def redacted(text: str | None, model: np.ndarray, margin: float = MARGIN) -> str | None:
    """text with each stretch of overlapping spans replaced by a mark."""
    at, parts = 0, []
    for _, a, b, _ in spans(text, model, margin):
        if a >= at:
            parts += [text[at:a], MARK]
        at = max(at, b)
    return "".join([*parts, text[at:]]) if parts else text


def redact(df: DataFrame, model: np.ndarray, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """df with the secrets of its text column replaced by a mark."""
    names, schema = df.columns, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(at)]
            for i, j in slices(batch, sizes):
                part = batch.slice(i, j - i)
                new = pa.array([redacted(t, model, margin) for t in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([new if k == at else part.column(k) for k in range(len(names))], names=names)

    return df.mapInArrow(run, schema)


def _joined(keep: str) -> F.Column:
    return F.expr(f"array_join(transform(filter(spans, s -> {keep}), s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def op10_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    count = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    return find(docs, model).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined("s.kind <> 'markov'"), 256).alias("base_sha256"), _joined("true").alias("spans"),
    )


def _sql() -> str:
    # RE2 folds more than A-Z, so the letters are spelt out.
    both = lambda x: re.sub(r"[a-z]+", lambda m: "".join(f"[{c.upper()}{c}]" for c in m[0]), x)
    words, rest = re.match(r"(\(.*?\))(.*)", ASSIGN).groups()
    assign = both(words) + rest
    quoted = lambda x: x.replace("'", "''")
    assign, matches = quoted(assign), quoted(f"(?:{assign})|(?:{ACCESS})|(?:[0-9a-f]{{16,}})")
    token = "[A-Za-z0-9+/_=-]{16,}"

    def matched(kind: str, pattern: str, length: str, least: int) -> str:
        """Matches of a pattern with their places: what is between and what is matched add up."""
        return f"""SELECT r, '{kind}' AS kind, m, CAST(b AS BIGINT) AS b, CAST(b + length(m) AS BIGINT) AS e FROM (
  SELECT r, m[i] AS m, list_sum(list_transform(s[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS b
  FROM (SELECT r, m, s, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS s FROM d))) WHERE {length} >= {least}"""

    digest = "sha256(CAST(doc_id AS VARCHAR))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
picked AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT {TRAIN_DOCUMENTS}),
sample AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM picked)),
strings AS (SELECT 0 AS random, unnest(regexp_extract_all(regexp_replace(text, '{matches}', ' ', 'g'), '{ORDINARY}')) AS s FROM sample
  UNION ALL SELECT 1, unnest(list_concat(list_filter(regexp_extract_all(text, '{HEX}'), lambda x: length(x) >= {LEAST['hex']}), list_filter(regexp_extract_all(text, '{ACCESS}'), lambda x: length(x) >= {LEAST['access']}),
    list_filter(regexp_extract_all(text, '{assign}', 2), lambda x: length(x) >= {LEAST['assign']}), [{digest}, base64(unhex({digest}))])) FROM sample),
tokens AS (SELECT random, s, count(*) AS n FROM strings GROUP BY random, s),
forms AS (SELECT random, n, unnest(CASE WHEN random = 0 THEN [s, upper(s), s || '_' || s, s || upper(s[1]) || s[2:]] ELSE [s] END) AS s FROM tokens),
places AS (SELECT random, n, s, unnest(range(1, length(s) + 1)) AS i FROM forms),
counts AS (SELECT random, CASE WHEN i = 1 THEN '' ELSE s[i - 1] END AS a, s[i] AS b, sum(n) AS n FROM places GROUP BY ALL),
letters AS (SELECT unnest(string_split('{ALPHABET}', '')) AS b),
cells AS (SELECT f.random, x.a, y.b, {SMOOTHING} + coalesce(c.n, 0) AS n FROM (VALUES (0), (1)) f(random), (SELECT b AS a FROM letters UNION ALL SELECT '') x, letters y
  LEFT JOIN counts c ON c.random = f.random AND c.a = x.a AND c.b = y.b),
shares AS (SELECT random, a, b, ln(n / sum(n) OVER (PARTITION BY random, a)) AS share FROM cells),
model AS (SELECT p.a, p.b, q.share - p.share AS ratio FROM shares p JOIN shares q ON p.a = q.a AND p.b = q.b WHERE p.random = 0 AND q.random = 1),
base AS ({matched('assign', assign, f"length(regexp_extract(m, '{assign}', 2))", LEAST['assign'])}
  UNION ALL {matched('access', ACCESS, 'length(m)', LEAST['access'])} UNION ALL {matched('hex', HEX, 'length(m)', LEAST['hex'])}),
other AS ({matched('markov', token, 'length(m)', 16)}),
alone AS (SELECT o.* FROM other o WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.r = o.r AND x.b < o.e AND o.b < x.e)),
scored AS (SELECT p.r, p.b, p.e, p.kind FROM (SELECT *, unnest(range(1, length(m) + 1)) AS i FROM alone) p
  JOIN model ON model.a = CASE WHEN p.i = 1 THEN '' ELSE p.m[p.i - 1] END AND model.b = p.m[p.i] GROUP BY p.r, p.b, p.e, p.kind HAVING sum(ratio) > {MARGIN}),
found AS (SELECT r, kind, b, e FROM base UNION ALL SELECT r, kind, b, e FROM scored),
said AS (SELECT r, kind, kind || ':' || b || ':' || e AS s, b, list_position({list(KINDS)}, kind) AS k FROM found),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(s, ',' ORDER BY b, k) FILTER (kind <> 'markov'), '') AS base, string_agg(s, ',' ORDER BY b, k) AS spans FROM said GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.r = d.r
"""


OP10_SQL = _sql()
