"""Sinks of streams write every batch once, whatever is stopped in between."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from portico.plans.fixtures import fixture
from portico.streaming import sinks as K

ROW = "channel string, ts timestamp, pass_no long, front string, rear string, left string, right string, top string"


@pytest.fixture(scope="module")
def passes(spark):
    """Rows of three files; every fifth one is incomplete."""
    obs = fixture(spark, "/root/testdata/sf0.001", "OBS").filter("state = 'present'")
    part = lambda n: F.concat(F.lit(n), F.col("frame_no").cast("string"))
    df = obs.select(F.col("lane").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.col("frame_no").alias("pass_no"), *[F.when(F.col("frame_no") % 5 != i, part(n)).alias(n) for i, n in enumerate(("front", "rear"))], *[part(n).alias(n) for n in ("left", "right", "top")])
    path = tempfile.mkdtemp(prefix="spark-")
    for i in range(3):
        df.filter(F.col("pass_no") % 3 == i).coalesce(1).write.mode("append").parquet(path)
    return path, df


def run(spark, path, place):
    rows = K.read_stream(spark, "parquet", ROW, path, maxFilesPerTrigger=1)
    q = K.deliver(rows, f"{place}/archive", f"{place}/ledger", f"{place}/checkpoint", f"{place}/messages").trigger(availableNow=True).start()
    q.awaitTermination(300)


def found(spark, place):
    rows = K.archived(spark, f"{place}/archive", K.Ledger(spark, f"{place}/ledger").batches())
    archive = sorted((r["channel"], r["day"], r["vehicle"], r["pass_no"]) for r in rows.collect())
    return archive, sorted(r["value"] for r in spark.read.text(f"{place}/messages").collect())


@pytest.fixture(scope="module")
def undisturbed(spark, passes):
    place = tempfile.mkdtemp(prefix="spark-")
    run(spark, passes[0], place)
    archive, messages = found(spark, place)
    whole = passes[1].dropna()
    assert sorted(r["pass_no"] for r in whole.collect()) == sorted(x[3] for x in archive) and len(messages) == len(archive) == len(set(messages))
    for channel, day in {x[:2] for x in archive}:
        own = [x[2] for x in archive if x[:2] == (channel, day)]
        assert own == [f"V{k + 1:04d}" for k in range(len(own))]
    return archive, messages


class Stop(Exception):
    pass


@pytest.mark.parametrize("where", ["before the archive", "between archive and messages", "before the entry", "after the entry"])
def test_stopped_and_started_again(spark, passes, undisturbed, where, monkeypatch):
    place, stopped = tempfile.mkdtemp(prefix="spark-"), set()

    def breaking(f, after=False):
        def g(*args):
            n = args[1]
            if after:
                f(*args)
            if n in (0, 1) and n not in stopped:
                stopped.add(n)
                raise Stop
            if not after:
                f(*args)

        return g

    if where in ("before the entry", "after the entry"):
        monkeypatch.setattr(K.Ledger, "add", breaking(K.Ledger.add, where == "after the entry"))
    else:
        name = "archive_step" if where == "before the archive" else "message_step"
        monkeypatch.setattr(K, name, lambda *a, f=getattr(K, name): breaking(f(*a)))
    for _ in range(3):
        try:
            run(spark, passes[0], place)
        except Exception as e:  # the query's own, which holds ours
            assert "Stop" in str(e)
    assert stopped == {0, 1} and found(spark, place) == undisturbed


def test_one_entry_for_a_batch(spark, tmp_path):
    book, calls = K.Ledger(spark, str(tmp_path / "l")), []
    assert book.batches() == []
    write = K.once(book, lambda df, n: calls.append(n))
    for n in (0, 0, 1, 0):
        write(spark.range(1), n)
    assert calls == [0, 1] == book.batches() and 1 in book and 2 not in book
    with pytest.raises(Exception, match="exist"):
        book.add(1)


def test_json_values_of_text_files(spark, tmp_path):
    lines = [json.dumps({"channel": "a", "pass_no": 1, "ts": "2024-01-01T00:00:00Z"}), "no json", json.dumps({"other": 1}), "", json.dumps({"channel": None, "pass_no": 2})]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f.txt").write_text("\n".join(lines), encoding="utf-8")
    got = []
    q = K.read_stream(spark, "text", "channel string, ts timestamp, pass_no long", str(tmp_path / "x")).writeStream.foreachBatch(lambda d, _: got.extend(d.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["channel"] or "", r["pass_no"]) for r in got) == [("", 2), ("a", 1)]
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted(r["value"] for r in K.rejected(raw, "channel string, pass_no long").collect()) == sorted(["no json", '{"other": 1}', ""])
