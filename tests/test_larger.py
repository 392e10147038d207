"""Cases that only larger tables have: long numbers, hot passes, texts in both kinds of places."""

from pyspark.sql import functions as F

from portico.functions import codes
from portico.operators import fusion, passes, recognise
from portico.plans import QUERIES, fixtures


def test_vehicle_numbers_beyond_four_digits(spark):
    new = spark.createDataFrame([("a", "240101", 1, 7), ("a", "240101", 2, 8), ("b", "240101", 1, 1)], "channel string, day string, ts int, pass_no int")
    old = spark.createDataFrame([("a", "240101", "V12345"), ("b", "240101", "V9999")], "channel string, day string, vehicle string")
    got = {(r["channel"], r["pass_no"]): r["vehicle"] for r in passes.number_vehicles(new, old).collect()}
    assert got == {("a", 7): "V12346", ("a", 8): "V12347", ("b", 1): "V10000"}
    assert [r["v"] for r in spark.range(2).select(passes.vehicle_name(F.col("id") * 99999).alias("v")).orderBy("v").collect()] == ["V0000", "V99999"]


def reads(df):
    """How often a query's plan reads a table."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_votes_read_their_table_once(spark):
    for name in ("first_length_vote", "positional_vote"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert reads(df) == 1, name
        assert "Generate explode" not in df._jdf.queryExecution().optimizedPlan().toString(), name
    for name in ("pass_vote", "frame_results", "shared_readings"):
        assert reads(QUERIES[name](spark, "/root/testdata/sf0.001")) == 1, name


def test_vote_of_a_pass_in_many_batches(spark):
    """A pass whose texts fill several batches is voted as one, nulls are a key of their own, places have no limit."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(1, i, f"{i % 3}X{i:04d}") for i in range(300)] + [(2, 5, "AB"), (2, 3, "B"), (None, 1, "Q"), (3, 1, "Y" * 5000)]
        got = {r["k"]: r["voted"] for r in fusion.positional_vote(spark.createDataFrame(rows, "k int, o int, t string"), "k", "t", "o").collect()}
        assert got == {1: "0X0000", 2: "B", None: "Q", 3: "Y" * 5000}
        cut = spark.createDataFrame([(1, 1, "ABC"), (1, 2, "ABXD"), (1, 3, "ABXD"), (2, 1, ""), (2, 2, "AB"), (3, 1, None)], "k int, o int, t string")
        assert {r["k"]: r["voted"] for r in fusion.vote_code(cut, "k", "t", "o").collect()} == {1: "ABX", 2: "", 3: None}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_readings_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "LINES", 100)
    r = fixtures.fixture(spark, "/root/testdata/sf0.001", "READ")
    assert r.rdd.getNumPartitions() >= r.count() // 100


def lines(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_")


def test_repairs_read_lines_no_more_than_they_need(spark):
    sf = "/root/testdata/sf0.001"
    assert lines(QUERIES["fused_codes"](spark, sf)) == 1  # the size-types; the codes are in a table
    assert lines(QUERIES["confused_codes"](spark, sf)) == 2  # codes and owners


def test_repair_keeps_what_stands_beside_a_code(spark):
    owners = spark.createDataFrame([("ABC", ["ABCU"])], "fragment string, owners array<string>")
    codes = spark.createDataFrame([(1, "ABCU1234560", 4), (2, "ABCU1234560", 5), (2, None, 6)], "pass_id int, code string, n int")
    got = recognise.repair_codes(codes, owners).drop("info").collect()
    assert {(r["pass_id"], r["n"]) for r in got} == {(1, 4), (2, 5), (2, 6)} and len({(r["code"], r["repaired"], r["flag"]) for r in got}) == 2


def test_short_passes_are_split_without_rounds(spark, monkeypatch):
    rows = [(p, i, "".join("ABCDEFGHIJ"[(p + i * k) % 10] if (i + k) % 3 else "X" for k in range(8))) for p in range(20) for i in range(12)]
    df = spark.createDataFrame(rows, "pass_id long, seq long, text string")
    split = lambda: sorted(map(tuple, recognise.split_two(df).collect()))
    with monkeypatch.context() as m:
        m.setattr(recognise, "FOLDED", 5)
        by_rounds = split()
    monkeypatch.setattr(recognise, "_by_rounds", None)
    assert split() == by_rounds and len(by_rounds) > 20


def test_vocabulary_lengths(spark):
    df = spark.createDataFrame([("Ab 12-é漢İ\n",), ("kK\u212aÅ\u212bIı",), ("",), (None,), ("zZ9" * 50,)], "t string")
    for kind in codes.VOCABULARIES:
        for r in df.select(codes.vocabulary_length("t", kind).alias("a"), F.length(codes.filter_vocabulary("t", kind)).alias("b")).collect():
            assert r["a"] == r["b"]
    assert [r["w"] for r in df.select(codes.text_width("t").alias("w")).collect()] == [7, 5, 0, None, 75]
