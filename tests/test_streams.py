"""Streams give the rows of their batch forms, in whatever order rows arrive within the delay."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from portico.operators import passes as P
from portico.operators import telemetry as T
from portico.plans.fixtures import fixture
from portico.streaming import streams as S

SF = "/root/testdata/sf0.01"
FAR = "timestamp'2100-01-01 00:00:00'"


def replay(spark, df, make, time, jitter="0 seconds", seed=0, files=4, runs=2, mode="append", last=None):
    """(batch, row) of a stream over df, whose rows arrive up to ``jitter`` late in files.

    The query is stopped and started again from its checkpoint between ``runs`` groups of files. last: a
    row that comes at the end, so late that the watermark passes everything.
    """
    path, checkpoint, got = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-"), []
    late = F.expr(f"cast(pmod(xxhash64(*, {seed}), 1000) as double) / 1000") * (P.micros(F.expr(f"timestamp'1970-01-01' + interval {jitter}")))
    rows = df.withColumn("__at", P.micros(F.col(time)) + late).orderBy("__at").drop("__at").collect()
    size = -(-len(rows) // files)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] + ([[last]] if last else [])
    made = make(S.observations(S.ready(spark), path, df.schema))
    for n in range(0, len(parts), -(-len(parts) // runs)):
        for part in parts[n : n + -(-len(parts) // runs)]:
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
        q = made.writeStream.foreachBatch(lambda d, b: got.extend((b, r) for r in d.collect())).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination(300)
    return got


def last_frame(df, **own):
    """A row of a camera of its own, far in the future."""
    return tuple(own.get(c, "end" if kind == "string" else __import__("datetime").datetime(2100, 1, 1) if "timestamp" in kind else 10**12) for c, kind in df.dtypes)


@pytest.fixture(scope="module")
def obs(spark):
    return fixture(spark, SF, "OBS").cache()


def replay_frames(spark, obs, make, seed):
    last = last_frame(obs, direction="none", state="empty")
    return [r for _, r in replay(spark, obs, make, "ts", "2 hours", seed, last=last)]


@pytest.mark.parametrize("seed", [1, 2])
def test_pass_stream(spark, obs, seed):
    columns = ["direction", "pass_no", "seg", "start_ts", "end_ts", "present", "carried"]
    want = sorted(map(str, (tuple(r) for r in P.passes(obs, min_frames=2).select(*columns).collect())))
    got = replay_frames(spark, obs, lambda s: S.pass_stream(s, min_frames=2, delay="3 hours"), seed)
    assert sorted(str((r["direction"], r["nth"], r["seg"], r["start_ts"], r["end_ts"], r["frames"], r["carried"])) for r in got) == want
    assert len(want) > 100 and any(r["carried"] for r in got)


def test_presence_stream(spark, obs):
    want = sorted(str((r["direction"], r["seg"], r["present"], r["start_ts"], r["end_ts"])) for r in P.segment_presence(obs, 3).collect())
    got = replay_frames(spark, obs, lambda s: S.presence_stream(s, 3, delay="3 hours"), 3)
    assert sorted(str((r["direction"], r["seg"], r["frames"], r["start_ts"], r["end_ts"])) for r in got) == want


def test_outage_stream(spark, obs):
    reads = obs.withColumn("ok", F.when(F.col("state") == "present", 1).otherwise(0))
    want = sorted(str((r["direction"], r["ts"], r["nth"])) for r in P.outages(reads, 5).collect())
    got = [r for _, r in replay(spark, reads, lambda s: S.outage_stream(s, 5, delay="3 hours"), "ts", "2 hours", 4, last=last_frame(reads, direction="none", ok=1))]
    assert sorted(str((r["direction"], r["start_ts"], r["nth"])) for r in got) == want


def test_late_frames_are_left_out_and_counted(spark):
    frames = lambda a, b: spark.sql(f"select 'left' as direction, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) as ts, id as frame_no, if(id < 80, 'present', 'empty') as state from range({a}, {b})")
    path, got = tempfile.mkdtemp(prefix="spark-"), []
    for part in (frames(20, 60), frames(60, 90), frames(0, 20), frames(400, 401)):
        part.coalesce(1).write.mode("append").parquet(path)
    q = S.pass_stream(S.observations(S.ready(spark), path, frames(0, 1).schema), delay="5 seconds").writeStream.foreachBatch(lambda d, _: got.extend(d.collect())).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert [(r["frames"], r["closed_by"]) for r in got] == [(60, "frames")]
    assert sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"]) == 20


def plain_fold(rows, silence):
    """Passes of ordered (second, state) by a plain loop: enter 4, leave 3, carry from 5 frames on."""
    out, run, state, entered, present, carried, first, last, n = [], 0, "", False, 0, 0, None, None, 0

    def close(end, by):
        nonlocal entered, present, carried, first, n
        if entered:
            n += 1
            out.append((n, first, end, present, carried, by))
            carried = 0
        elif present >= 5:
            carried += present
        entered, present, first = False, 0, None

    for t, now in [*rows, (None, None)]:
        if last is not None and (t is None or t - last > silence):
            if first is not None:
                close(last, "silence")
            run, state = 0, ""
        if t is None:
            break
        first, last = t if first is None else first, t
        if now == "skipped":
            continue
        run, state = run + 1 if now == state else 1, now
        if now == "present":
            present += 1
            entered |= run >= 4
        elif run % 3 == 0:
            close(t, "frames")
    return out


def test_silent_camera_is_closed_by_a_timer(spark):
    rng, rows, at = random.Random(5), [], 0
    while len(rows) < 400:
        state = rng.choice(["present", "present", "empty", "skipped"])
        for _ in range(rng.randint(1, 7)):
            at += rng.choice([1, 1, 1, 2, 40])
            rows.append((at, state))
    df = spark.createDataFrame([("left", t, t, s) for t, s in rows], "direction string, t long, frame_no long, state string").select("direction", F.timestamp_seconds("t").alias("ts"), "frame_no", "state")
    got = [r for _, r in replay(spark, df, lambda s: S.pass_stream(s, delay="30 seconds", silence="20 seconds"), "ts", "25 seconds", 7, files=6, runs=3, last=last_frame(df, direction="none", state="empty"))]
    want = plain_fold(rows, 20)
    sec = lambda t: int(t.timestamp())
    assert sorted((r["nth"], sec(r["start_ts"]), sec(r["end_ts"]), r["frames"], r["carried"], r["closed_by"]) for r in got if r["direction"] == "left") == want
    assert {x[-1] for x in want} == {"frames", "silence"}


def test_resource_stream(spark):
    res = fixture(spark, SF, "RES").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = T.parse_resources(res).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.max("cpu").alias("cpu"), F.count("*").alias("n")).select(F.col("w.start").alias("s"), "cpu", "n").collect()
    got = {(r["start"], r["cpu"], r["samples"]) for _, r in replay(spark, res, lambda s: S.resource_stream(s, "1 hour"), "ts")}
    want = {(r["s"], r["cpu"], r["n"]) for r in batch}
    assert got <= want and len(want - got) <= 1  # the last interval is still open


@pytest.mark.parametrize("seed", [1, 5])
def test_assign_stream_corrects_numbers(spark, obs, seed):
    own = obs.filter("direction in ('front', 'rear')")
    marked = own.select(F.lit("lane").alias("lane"), F.col("ts").cast("timestamp").alias("ts"), F.col("frame_no").alias("reading_id"), F.when((F.col("direction") == "rear") & (F.col("frame_no") % 11 == 0), 1).otherwise(0).alias("is_end"))
    want = {r["frame_no"]: r["pass_no"] for r in P.assign_pass(marked.filter("is_end = 0").select("ts", F.col("reading_id").alias("frame_no")), marked.filter("is_end = 1").select("ts")).select("frame_no", "pass_no").collect()}
    got = replay(spark, marked, lambda s: S.assign_stream(s, delay="3 hours"), "ts", "2 hours", seed, files=8, mode="update", last=last_frame(marked, lane="end", is_end=1))
    now, corrected = {}, 0
    for _, r in got:
        assert now.get(r["reading_id"]) == r["corrects"] != r["pass_no"]
        corrected += r["corrects"] is not None
        now[r["reading_id"]] = r["pass_no"]
    assert now == want and corrected > 0


VIEWS, READ = ["left", "right", "front", "rear"], ["code", "plate"]


@pytest.fixture(scope="module")
def lanes(spark, obs):
    """Parts of records, and the records of the batch form."""
    df = obs.withColumn("direction", F.concat_ws("/", "lane", "direction"))
    apart = lambda x: x.withColumn("lane", F.split("direction", "/")[0]).withColumn("direction", F.split("direction", "/")[1])
    sides, faces = apart(P.passes(df)).cache(), apart(P.segment_presence(df, gap=3)).cache()
    views = {v: (sides if v in ("left", "right") else faces).filter(F.col("direction") == v).select("lane", "start_ts", "end_ts", "seg") for v in VIEWS}
    read = {"code": (views["rear"].filter("seg % 3 <> 0").withColumn("code", F.concat(F.lit("C"), "seg")), "code"), "plate": (views["front"].filter("seg % 4 <> 0").withColumn("plate", F.concat(F.lit("P"), "seg")), "plate")}
    anchors = sides.filter("direction = 'top'").select("lane", "pass_no", "start_ts", "end_ts")
    batch = P.vehicle_records(anchors, views, {k: (d, [c]) for k, (d, c) in read.items()})
    return S.parts_of(views, read, "top", anchors).cache(), batch.cache()


def records(rows):
    return sorted(str((r["lane"], r["pass_no"], *[r[f"seg_{v}"] for v in VIEWS], r["code"], r["plate"], r["complete"])) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_record_stream_like_the_batch(spark, lanes, seed):
    parts, batch = lanes
    got = [r for _, r in replay(spark, parts, lambda s: S.record_stream(s, VIEWS, READ, delay="3 hours", wait="900 days", longest="900 days"), "end_ts", "2 hours", seed, files=6, runs=3, last=last_frame(parts, lane="end", kind="none"))]
    assert records(got) == records(batch.collect())
    assert len({r["complete"] for r in got}) == 2


def test_records_go_out_before_the_time_is_over_or_then_without_what_is_missing(spark):
    t = lambda s: f"timestamp'2024-01-01 00:00:00' + interval {s} seconds"
    rows = [("L", "top", 100, 200, 1, None), ("L", "left", 90, 210, 5, None), ("L", "code", 150, 160, 0, "A"), ("L", "code", 205, 290, 0, "B"), ("L", "top", 400, 500, 2, None), ("L", "code", 450, 470, 0, "C"), ("L", "left", 480, 700, 6, None)]
    df = spark.sql(" union all ".join(f"select '{lane}' as lane, '{kind}' as kind, {t(a)} as start_ts, {t(b)} as end_ts, {n}l as number, {'null' if x is None else repr(x)} as text" for lane, kind, a, b, n, x in rows)).select("lane", "kind", "start_ts", "end_ts", "number", F.col("text").cast("string"))
    tick = spark.sql(f"select 'x' as lane, 'tick' as kind, {t(0)} as start_ts, {t(300)} as end_ts, 0l as number, cast(null as string) as text")
    got = replay(spark, df.unionByName(tick), lambda s: S.record_stream(s, ["left"], ["code"], delay="1 seconds", wait="100 seconds"), "end_ts", files=8, runs=8, last=last_frame(df, lane="x", kind="tick"))
    assert [(r["pass_no"], r["seg_left"], r["code"], r["complete"]) for _, r in got] == [(1, 5, "A", True), (2, None, "C", False)]
    assert got[0][0] < got[1][0]


def test_fuse_stream(spark, obs):
    df = obs.withColumn("direction", F.concat_ws("/", "lane", "direction"))
    apart = lambda x: x.withColumn("lane", F.split("direction", "/")[0]).withColumn("direction", F.split("direction", "/")[1])
    sides, faces = apart(P.passes(df)).filter("direction = 'top'"), apart(P.segment_presence(df, gap=3)).filter("direction = 'rear'")
    want = {(r["lane"], r["pass_no"], r["face_seg"]) for r in P.fuse_passes(sides, faces).collect()}
    stamp = lambda x: x.withColumn("start_ts", F.col("start_ts").cast("timestamp")).withColumn("end_ts", F.col("end_ts").cast("timestamp"))
    left, right = stamp(sides.withColumnRenamed("pass_no", "nth")).select("lane", "direction", "nth", "start_ts", "end_ts"), stamp(faces.withColumnRenamed("seg", "nth")).select("lane", "direction", "nth", "start_ts", "end_ts")
    path = tempfile.mkdtemp(prefix="spark-")
    right.coalesce(1).write.mode("append").parquet(path)
    got = replay(spark, left, lambda s: S.fuse_stream(s, spark.readStream.schema(right.schema).parquet(path), "900 days", "900 days"), "start_ts")
    assert {(r["lane"], r["nth"], r["face_no"]) for _, r in got} == want and want
