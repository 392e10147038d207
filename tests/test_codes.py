"""Worked cases of codes, votes, repair and fusion, by hand or by a plain version."""

import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from portico.functions import codes as C
from portico.operators import boxes, dimensions, fusion, passes, recognise, scans

VALUES = {c: i for i, c in enumerate("0123456789A_BCDEFGHIJK_LMNOPQRSTU_VWXYZ") if c != "_"}


def digit(code):
    return str(sum(VALUES[c] * 2**i for i, c in enumerate(code[:10])) % 11 % 10)


def valid(code):
    return len(code) == 11 and code[:4].isalpha() and code[4:].isdigit() and digit(code) == code[10]


def column(spark, values, col):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(col).collect()]


def test_check_digits(spark):
    cases = {"EISU200755": "5", "BSIU310744": "8", "COIU411094": "3", "BXTU202890": "3", "RXTU202890": "9"}
    got = dict(zip(cases, column(spark, list(cases), C.check_digit("c")), strict=True))
    assert got == {k: digit(k) for k in cases} == cases
    assert column(spark, ["EISU200755"], C.check_digit("c", legacy=True)) == ["8"]
    assert column(spark, ["EISU2007551", "CCIU4110943", "EISU2007555", None, ""], C.is_valid_code("c")) == [False, False, True, False, False]


def test_normalized(spark):
    cases = {"1481BODA567": "IABI8004567", "B0D4A": "80044", "O0OB": "O0OB", "BODA5": "80045", "E1SU2OO7555": "EISU2007555"}
    assert column(spark, list(cases), C.normalize_reading("c")) == list(cases.values())
    assert column(spark, ["冀A0O1I2"], C.normalize_plate("c")) == ["冀A00112"]


def test_vote(spark):
    rows = [(1, i, t) for i, t in enumerate(["EISU2007555", "EISU200755", "ISU2007555"])]
    df = spark.createDataFrame(rows, "pass_id long, seq long, text string")
    # Two readings are too short for the last place and vote blank there, unless told not to.
    assert fusion.positional_vote(df, "pass_id", "text", "seq").first()["voted"] == "EISU200755"
    assert fusion.positional_vote(df, "pass_id", "text", "seq", blank_last=False).first()["voted"] == "EISU2007555"
    two = spark.createDataFrame(rows[:2], df.schema)
    assert fusion.vote_code(two, "pass_id", "text", "seq").first()["voted"] == "EISU200755"


def test_vote_does_not_depend_on_order_without_ties(spark):
    texts = ["ABCU1", "ABCU2", "ABCU1", "XBCU1", "ABDU1"]
    rows = [(p, i, t) for p, order in enumerate(itertools.islice(itertools.permutations(texts), 0, 120, 7)) for i, t in enumerate(order)]
    df = spark.createDataFrame(rows, "pass_id long, seq long, text string")
    assert {r["voted"] for r in fusion.positional_vote(df, "pass_id", "text", "seq").collect()} == {"ABCU1"}


def test_matches(spark):
    df = spark.createDataFrame([("BXTU2028909", "RXTU202890"), ("BXTU2028909", "BXTU2028909"), ("BXTU2028909", "RXTU2028909"), ("BXTU2028909", "RXTU2028111")], "a string, b string")
    assert [tuple(r) for r in df.select(C.code_distance("a", "b"), C.code_matches("a", "b")).collect()] == [(2, True), (0, True), (1, True), (4, False)]


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row, old = [i], row
        for j, d in enumerate(y, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    return row[-1]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.randoms(use_true_random=False))
def test_reconciliation_like_all_pairs(spark, rng):
    """The lowest rank among all matches, over numbers of all lengths, few digits and few heads."""
    make = lambda: rng.choice(["AB", "ABU", "", "CU"]) + "".join(rng.choice("012") for _ in range(rng.randint(0, 6)))
    left, right = sorted({make() for _ in range(200)}), [(make(), rng.randint(0, 30)) for _ in range(40)]
    split = lambda c: (c.rstrip("012"), c[len(c.rstrip("012")) :])
    matches = lambda a, b: distance(split(a)[1], split(b)[1]) <= (2 if split(a)[0] == split(b)[0] else 1)
    want = {a: min(((k, b) for b, k in right if matches(a, b)), default=(0, None))[1] for a in left}
    got = fusion.match_against(spark.createDataFrame([(x,) for x in left], "code string"), spark.createDataFrame(right, "ref string, rank int"), "code", "ref").collect()
    assert {r["code"]: r["matched"] for r in got} == want
    last = max((k, b) for b, k in right)[1]  # what an unmatched code is compared with in the end
    for r in got:
        a, b = split(r["code"]), split(last if r["matched"] is None else r["matched"])
        assert r["distance"] == distance(a[0], b[0]) + distance(a[1], b[1])


def test_reconciliation_by_parts_and_of_long_numbers(spark, monkeypatch):
    """Heads of many rows are cut by parts of their numbers; numbers may be too long for one whole number as a key."""
    split = lambda c: (c.rstrip("0123456789"), c[len(c.rstrip("0123456789")) :])
    matches = lambda a, b: distance(split(a)[1], split(b)[1]) <= (2 if split(a)[0] == split(b)[0] else 1)
    for large, letters, least, most in ((1, "012", 0, 10), (1_000_000, "0123456789", 17, 30)):
        monkeypatch.setattr(fusion, "LARGE", large)
        rng = random.Random(most)
        seeds = ["".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(20)]

        def make(rng=rng, seeds=seeds, letters=letters):
            s = rng.choice(seeds)
            for _ in range(rng.randint(0, 3)):
                i = rng.randint(0, len(s))
                s = s[:i] + rng.choice([rng.choice(letters), rng.choice(letters) + s[i : i + 1], ""]) + s[i + 1 :]
            return rng.choice(["AB", "ABU", ""]) + s

        left, right = sorted({make() for _ in range(120)}), [(make(), rng.randint(0, 30)) for _ in range(40)]
        want = {a: min(((k, b) for b, k in right if matches(a, b)), default=(0, None))[1] for a in left}
        assert 20 < sum(b is not None for b in want.values())
        got = fusion.match_against(spark.createDataFrame([(x,) for x in left], "code string"), spark.createDataFrame(right, "ref string, rank int"), "code", "ref").collect()
        assert {r["code"]: r["matched"] for r in got} == want


def test_reconciliation_shuffles_codes_and_no_keys(spark):
    """A code of seven digits has 35 keys and an expected one 84: rows are shuffled a few times each."""
    code = F.concat(F.lit("ABCU"), F.lpad((F.col("id") * 7919 % 10_000_000).cast("string"), 7, "0"))
    codes, expected = spark.range(500).select(code.alias("code")), spark.range(0, 1000, 4).select(code.alias("ref"), F.col("id").alias("rank"))
    store, java = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (at.apply(i) for at in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(java.double, 0), java.java.util.ArrayList())] for i in range(at.size()))}
    before = stages()
    assert len(fusion.match_against(codes, expected, "code", "ref").collect()) == 500
    assert 0 < sum(n for k, n in stages().items() if k not in before) < 8 * 750


def test_vote_like_a_plain_count(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 30), k, "".join(rng.choice("AB1é漢") for _ in range(rng.randint(0, 6)))) for k in range(400)]
    for blank_last in (True, False):
        want = {}
        for k in {k for k, _, t in rows if t}:
            texts = [t for kk, _, t in rows if kk == k and t]
            longest, out = max(map(len, texts)), ""
            for p in range(longest):
                count = {}
                for t in texts:
                    if len(t) > p or blank_last or p < longest - 1:
                        count[t[p : p + 1]] = count.get(t[p : p + 1], 0) + 1
                out += max(count, key=count.get)  # the first seen on ties
            want[k] = out
        got = fusion.positional_vote(spark.createDataFrame(rows, "k int, o int, t string"), "k", "t", "o", blank_last).collect()
        assert {r["k"]: r["voted"] for r in got} == want


def brute_repair(code, candidates):
    """Written for these tests: the order of attempts in words of the docstring."""
    if valid(code):
        return code, 1
    cut = max((i for i, c in enumerate(code) if c.isalpha()), default=-1) + 1
    head, num = code[:cut], code[cut:]
    letters = "".join(c for c in head if not c.isdigit())
    stem = letters[: letters.rfind("U")] if "U" in letters else letters
    owners = candidates.get(stem, [])
    if len(num) < 6 or not owners:
        return code, 0
    tries = []
    if len(num) >= 7:
        def swaps(text, table):
            return [text[:i] + c + text[i + 1 :] for i, x in enumerate(text) for c in table.get(x, "")]

        heads = swaps(stem + "U", recognise.LETTERS) if len(stem) == 3 else []
        digits = swaps(num[:6], recognise.DIGITS)
        if len(num) == 8:
            tries += [owners[0] + num[:7], owners[0] + num[1:]]
        tries += [owners[0] + d + num[6] for d in digits] + [h + num for h in heads + owners]
        tries += [h + d + num[6] for h in owners[:1] + heads + owners[1:] for d in digits]
    found = next((t for t in tries if valid(t)), None)
    made = owners[0] + num[:6]
    return found or made + digit(made), 2


def test_repair_like_a_plain_version(spark):
    rng = random.Random(2)
    owners = ["EISU", "BSIU", "COIU", "HLCU", "MWHU", "GCDU", "TITU"]
    df = recognise.owner_candidates(spark.createDataFrame([(o,) for o in sorted(set(owners))], "owner string"))
    candidates = {r["fragment"]: r["owners"] for r in df.collect()}
    codes = set()
    for _ in range(400):
        base = rng.choice(owners) + f"{rng.randrange(10**6):06d}"
        c = list(base + digit(base))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(c))
            c[i : i + 1] = rng.choice([[], [rng.choice("0123456789")], [rng.choice("CDGHIMNOTUW")], [c[i], rng.choice("0123456789")]])
        codes.add("".join(c))
    got = recognise.repair_codes(spark.createDataFrame([(c,) for c in sorted(codes)], "code string"), df).collect()
    assert {r["code"]: (r["repaired"], r["flag"]) for r in got} == {c: brute_repair(c, candidates) for c in codes}


@pytest.mark.parametrize("readings, code, outcome", [
    (["EISU2007555"], "EISU2007555", 1),
    (["EISU2007555", "EISU2007555"], "EISU2007555", 1),
    (["EISU2007555", "EISU200755"], "EISU2007555", 1),
    (["EISU2007555", "EISU200755", "ISU2007555"], "EISU2007555", 1),
    (["EISU2007551", "EISU2007551", "EISU2007555"], "EISU2007555", 1),
    (["EISU2007551", "EISU2007551"], "EISU2007551", -1),
])
def test_fusion_cases(spark, readings, code, outcome):
    owners = recognise.owner_candidates(spark.createDataFrame([("EISU",)], "owner string"))
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(readings)], "pass_id long, seq long, text string")
    r = recognise.fuse_codes(df, owners).first()
    assert (r["code"], r["outcome"]) == (code, outcome)


def test_size_repair(spark):
    codes = ["22G1", "22G2", "22G", "2G1", "5G1", "45", "4T6", "251"]
    got = {r["code"]: (r["repaired"], r["flag"]) for r in fusion.repair_size_types(spark.createDataFrame([(c,) for c in codes], "code string"), dimensions.size_candidates(spark)).collect()}
    assert got == {"22G1": ("22G1", 1), "22G2": ("22G2", 1), "22G": ("22G1", 2), "2G1": ("22G1", 2), "5G1": ("45G1", 2), "45": ("22G1", 0), "4T6": ("42T6", 2), "251": ("25G1", 2)}


def test_type_fragments(spark):
    got = {}
    for r in dimensions.size_candidates(spark).orderBy("fragment", "rank").collect():
        got.setdefault(r["fragment"], []).append(r["candidate"])
    assert got["4T6"][:3] == ["42T6", "45T6", "40T6"] and got["22G1"] == ["22G1"] and "4T" not in got and "GT6" not in got
    less = lambda c: {c[:i] + c[i + 1 :] for i in range(4)}
    assert set(got["2G1"]) == {c for c in dimensions.size_codes() if "2G1" in less(c)}


def test_suppression_and_clips(spark):
    t = spark.createDataFrame([("a", float(x)) for x in (0, 40, 60, 100, 120)], "direction string, t double")
    assert [r["t"] for r in passes.suppress_adjacent(t, "direction").orderBy("t").collect()] == [0, 60, 120]
    p = spark.createDataFrame([("a", x) for x in (0.0, 30.5, 90.2)], "direction string, t double")
    assert [(r["begin"], r["end"]) for r in passes.clip_plan(p, "direction").orderBy("clip").collect()] == [(0, 33), (22, 93)]


def test_two_level_runs_cross_chunks(spark):
    rng = random.Random(9)
    rows = [(k, i // 7, i, rng.choice("xxy")) for k in "ab" for i in range(100)]
    got = {(r["k"], r["i"]): r["pos"] for r in scans.runs(spark.createDataFrame(rows, "k string, c int, i int, s string"), "k", "c", ["i"], "s").collect()}
    for k in "ab":
        last, pos = None, 0
        for kk, _, i, s in rows:
            if kk == k:
                pos = pos + 1 if s == last else 1
                last = s
                assert got[(k, i)] == pos


def test_nms_is_idempotent(spark):
    rng = random.Random(3)
    rows = [(0, i, 0, rng.random(), x, y, x + 60, y + 60) for i in range(80) for x, y in [(rng.random() * 300, rng.random() * 300)]]
    df = spark.createDataFrame(rows, "image_id long, det_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double")
    once = boxes.nms(df)
    assert sorted(r["det_id"] for r in once.collect()) == sorted(r["det_id"] for r in boxes.nms(once).collect())


def test_empty_inputs(spark):
    obs = spark.createDataFrame([], "direction string, ts timestamp, frame_no long, state string")
    assert passes.passes(obs).count() == 0 and passes.segment_presence(obs).count() == 0 and passes.lane_events(obs).count() == 0
    reads = spark.createDataFrame([], "pass_id long, seq long, text string")
    assert fusion.positional_vote(reads, "pass_id", "text", "seq").count() == 0
