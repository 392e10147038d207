"""Ranked search, vector search and source divergence: against plain versions, and their edge cases."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from portico.llm import divergence as D
from portico.llm import search as S
from portico.llm import vectors as V

from .test_operators import docs


# 11 --------------------------------------------------------------------------------------------
def plain_ranked(documents, items, k):
    """By the formulas, over all documents, with dictionaries. documents: (id, text); items: (id, text)."""
    counts = [(i, Counter(S.terms(t))) for i, t in documents]
    counts = [(i, c) for i, c in counts if c]
    total, n, df = sum(c.total() for _, c in counts), len(counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 50 + 50 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(S.terms(text)) if t in c)
            if s > 0:
                found.append((-s, S.LAST if i is None else i, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:k])]
    return sorted(out, key=str)


def test_terms():
    assert S.terms("Das Öl, 3x_ABC-é\x00É漢!") == ["das".encode(), "Öl".encode(), b"3x", b"abc", "é".encode(), "É漢".encode()]
    assert S.terms(None) == S.terms(" .,_") == []


WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    rows = [(int(i), " ".join(rng.choice(WORDS, int(rng.integers(1, 90)), p=np.arange(60, 0, -1) / 1830))) for i in range(300)]
    rows += [(1000 + i, "w1 w2 w3 w59 w59 same text") for i in range(150)]  # a group of copies larger than k
    rows += [(None, "w3 w59"), (None, "w3 w59"), (7, "w59"), (7, "w59"), (-5, None), (-6, ""), (-7, " .. "), (-8, "w4 " * 60000 + "rare"), (-9, " ".join(f"t{i}" for i in range(20000)))]
    return rows


@pytest.mark.parametrize("few", [False, True])
def test_ranked_like_a_plain_version(spark, corpus, few, monkeypatch):
    if few:  # many small blocks, of documents and of queries
        monkeypatch.setattr(S, "DOCUMENTS", 8)
        monkeypatch.setattr(S, "ITEMS", 3)
        monkeypatch.setattr(S, "TERMS", 5)
    items = [(1, "w1 W2 w2 w59"), (2, "same text"), (2, "w3 rare"), (None, "w59 w58 w57"), (4, None), (5, "unknown"), (6, " ".join(WORDS)), (7, "t7 t19999 w4")]
    df = docs(spark, [(i, t, "s") for i, t in corpus], extra=True).withColumn("score", F.lit("x")).repartition(5)
    got = S.ranked(df, spark.createDataFrame(items, "item_id int, text string"), k=50)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_ranked(corpus, items, 50)


def test_ranked_of_nothing(spark):
    df, items = docs(spark, [(1, None, "a"), (2, "", "b")]), spark.createDataFrame([(1, "a b")], "item_id int, text string")
    assert S.ranked(df, items).count() == S.ranked(df.limit(0), items).count() == S.ranked(docs(spark, [(1, "a", "s")]), items.limit(0)).count() == 0


def test_large_blocks_are_stored_and_sent_a_few_at_a_time(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(S, "DOCUMENTS", 1)
    monkeypatch.setattr(S, "WRITER", S.WRITER | {"parquet.block.size": str(1 << 16)})
    monkeypatch.setattr(S, "shared_dir", lambda _: f"{tmp_path}/x")
    rng, name = np.random.default_rng(3), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = [(i, " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 3000).tolist())) for i in range(60)]
    df, items = docs(spark, [(i, t, "s") for i, t in rows]).coalesce(1), [(1, rows[7][1][:300]), (2, rows[9][1][-300:])]
    assert sorted((tuple(r) for r in S.ranked(df, spark.createDataFrame(items, "item_id int, text string")).collect()), key=str) == plain_ranked(rows, items, 50)
    assert spark.conf.get(name) == before
    for f in (tmp_path / "x" / "index").glob("*.parquet"):
        m = pq.ParquetFile(f).metadata
        assert max(m.row_group(i).num_rows for i in range(m.num_row_groups)) <= 8
    with S.arrow_rows(spark, 2):
        count = spark.range(9, numPartitions=1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
    assert max(r["n"] for r in count) == 2


def test_an_open_block_holds_numbers_of_terms():
    a, b = Counter({b"x": 3, b"y": 1}), Counter({b"y": 9, b"z": 1})
    block = S._Open()
    block.add(5, 5, "x x x y", a)
    block.add(2, 2, "y z", b)
    assert [x.dtype for x in (*block.which, *block.reach)] == [np.int32, np.int32, np.int8, np.int8]
    r = block.closed(64)
    assert r["ids"] == [2, 5] and r["vocabulary"] == b"x y z" and np.frombuffer(r["frequencies"], np.int64).tolist() == [1, 2, 1] and np.frombuffer(r["lengths"], np.int64).tolist() == [10, 4]


def test_bounds_are_never_too_low():
    rng, q = np.random.default_rng(3), S.Queries(["a b c", "b d", ""])
    texts = [" ".join(rng.choice(list("abcdef"), int(rng.integers(1, 40)))) for _ in range(200)]
    counts = [Counter(S.terms(t)) for t in texts]
    q.weigh(200, sum(c.total() for c in counts), Counter(t for c in counts for t in c))
    block = S._block([(i, i, t, c) for i, (t, c) in enumerate(zip(texts, counts, strict=True))], 64)  # so dense that marks are often wrong
    bounds = q.bounds(block["size"], block["rows"], block["top"], *S._unpacked(block)[1:])
    exact = np.array([[q.score(n, c, q.norm(c.total())) for c in counts] for n in range(3)])
    assert (bounds >= exact).all() and (bounds[2] == 0).all() and (bounds[:2] > exact[:2]).any()


# 12 --------------------------------------------------------------------------------------------
def plain_nearest(rows, k):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in whole:
        if i is not None and i % 50 == 0:
            found = sorted((-min(V._MOST, sum(a * b for a, b in zip(q, v, strict=False))), c is None, c or 0, c) for c, v in whole if c != i)[:k]
            out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(found)]
    return sorted(out, key=str)


def vectors(kind):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(900, 8)) / 3
    if kind == "lengths":  # a long tail, so that whole buckets fall away
        v *= np.exp(rng.normal(size=(900, 1)) * 2)
    if kind == "close":  # so that coordinates rule vectors out
        v = v[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) / 60
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    if kind == "odd":
        rows += [(None, v[3].tolist()), (None, None), (1000, None), (1050, [None] * 8), (1100, [math.nan] * 8), (1150, [math.inf] + [0.0] * 7), (1200, []), (1250, [0.0] * 8), (1300, [0.5]), (1300, [0.5]), (1350, [1.0] * 9), (1351, [3e7, 1.0]), (1400, [2e7, 0.3])]
        rows += [(2000 + i, v[0].tolist()) for i in range(400)]
    return rows


@pytest.mark.parametrize("kind", ["plain", "lengths", "close", "odd"])
def test_nearest_like_a_plain_version(spark, kind, monkeypatch):
    monkeypatch.setattr(V, "ROWS", 64)
    monkeypatch.setattr(V, "QUERIES", 4)
    rows = vectors(kind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "length": F.lit(1), "bucket": F.lit(2)}).repartition(3)
    got = V.nearest(df, F.col("id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_nearest(rows, 5)


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")
    assert V.nearest(df, F.col("id") % 50 == 0).count() == V.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_pruning_keeps_what_can_reach():
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(500, 6)) * 100)
    v = v[np.argsort(-V.lengths(v))]
    sizes = V.lengths(v)
    for q in np.concatenate([v[:40], -v[:5]]):
        scores, size = V.products(q[None], v)[0], float(V.lengths(q[None])[0])
        for least in np.sort(scores)[::-1][[0, 1, 5, 20]]:
            places = V.candidates(q, size, float(least), v / sizes[:, None], sizes)
            if places is not None:
                assert set(np.flatnonzero(scores >= least)) <= set(places.tolist())
    assert V.products(np.array([[2.0**52, 1]]), np.array([[2.0**52, 3], [4, 2]])).tolist() == [[2**63 - 1, 2**54 + 2]]


# 13 --------------------------------------------------------------------------------------------
def plain_audit(rows, least, top):
    import re

    rows = [(t or "", a or "", s or "") for t, a, s in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found, docs_of, n = {}, Counter(), Counter()
    for t, a, s in rows:
        found.setdefault(a, set()).add(s)
        terms = re.findall(f"[^{D.BREAKS}]+", t.translate(low))
        docs_of.update((a, x) for x in set(terms))
        n.update((a, s, x) for x in terms)
    out = []
    for a, sources in found.items():
        kept = [x for (b, x), c in docs_of.items() if b == a and c >= least]
        share = lambda c, total, v=len(kept): 1 + 10**9 * (c + 5) // (total + 5 * v)
        total = {s: sum(n[a, s, x] for x in kept) for s in sources}
        p = {(s, x): share(n[a, s, x], total[s]) for s in sources for x in kept}
        q = {x: share(sum(n[a, s, x] for s in sources), sum(total.values())) for x in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s, x] - p[o, x]) for x in kept), o.encode()) for o in sources if o != s]
            terms = [(q[x] - p[s, x], x.encode()) for x in kept if n[a, s, x] and p[s, x] > q[x]]
            for part, own in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(a, s, part, x.decode(), -v, r + 1) for r, (v, x) in enumerate(own)]
    return sorted(out)


def test_audit_like_a_plain_version(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pool = [*(f"ab{chr(97 + i)}" for i in range(26)), "Abcdefgh", "ABCDEFGHI", "sixteenletters_x", "sixteenlettersab", "seventeenletterss", "überfällig", "漢字", "x" * 40, "ÉÉ", "éé", "a" * 8, "b" * 16]
    rows = [(" ".join(rng.choice(pool, int(rng.integers(0, 40)))) + "-9", ["en", "de", None][i % 3], [None, "s1", "s2", "é", "Z"][i % 5]) for i in range(240)]
    rows += [(None, "en", "s1"), ("", "fr", "only"), ("aba", "it", "x"), (None, "it", "y"), ("z" * 200000 + " aba", "en", "s2"), *[("aba abb", "en", "copies")] * 60]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit("x"), "p": F.lit(2)})
    want = plain_audit(rows, 10, 7)
    for cells, size, held in ((1 << 16, 8 << 20, 2 << 20), (64, 500, 20)):
        monkeypatch.setattr(D, "CELLS", cells)
        monkeypatch.setattr(D, "BYTES", size)
        monkeypatch.setattr(D, "ROWS", held)
        monkeypatch.setattr(D, "TILE", 2)
        got = D.audit(df.repartition(3), least=10, top=7)
        assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == want
    assert D.audit(df.limit(0)).count() == 0


def test_radix_is_a_stable_sort():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 4, 500).astype(np.uint64) << np.uint64(60), rng.integers(0, 2**63, 500).astype(np.uint64) >> np.uint64(50)]
    assert D.radix(words).tolist() == np.lexsort((words[1], words[0])).tolist()
