"""Vehicle passes from ordered observations of cameras, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import Rounds, cut, previous, running, runs

ORDER = ["ts", "frame_no"]


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def _chunked(obs: DataFrame) -> DataFrame:
    return obs.withColumn("chunk", F.to_date("ts"))


def segment_frames(obs: DataFrame, enter: int = 4, leave: int = 3) -> DataFrame:
    """Every frame with its segment: ``leave`` empty frames in a row close one.

    Adds seg (from 0 per direction), is_close, entered_here (the ``enter``-th present frame of a run).
    Skipped frames count nothing and take the segment they fall in.
    """
    rows = _chunked(obs)
    seen = runs(rows.filter("state <> 'skipped'"), "direction", "chunk", ORDER, "state")
    marks = seen.select(
        "direction", *ORDER, "chunk", "state", "pos",
        (F.when((F.col("state") == "empty") & (F.col("pos") % leave == 0), 1).otherwise(0)).alias("is_close"),
        F.when((F.col("state") == "present") & (F.col("pos") == enter), 1).otherwise(0).alias("entered_here"),
    )
    skipped = rows.filter("state = 'skipped'").select("direction", *ORDER, "chunk", "state", F.lit(None).cast("long").alias("pos"), F.lit(0).alias("is_close"), F.lit(0).alias("entered_here"))
    both = running(marks.unionByName(skipped), "direction", "chunk", ORDER, sums={"seg": F.col("is_close")})
    return both.withColumn("seg", F.col("seg") - F.col("is_close")).drop("chunk")


def segments(frames: DataFrame) -> DataFrame:
    """One row per direction and segment of ``segment_frames``."""
    kept = F.when(F.col("state") == "present", 1).otherwise(0)
    return frames.groupBy("direction", "seg").agg(
        F.max("entered_here").alias("entered"), F.max("is_close").alias("closed"), F.sum(kept).alias("present"), F.count("*").alias("frames"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
    )


def passes(obs: DataFrame, enter: int = 4, leave: int = 3, min_frames: int = 5) -> DataFrame:
    """One row per closed pass: direction, pass_no, start, end, own frames and carried ones.

    A segment that never saw a vehicle but kept ``min_frames`` frames or more carries them into the
    next one; shorter ones are dropped.
    """
    seg = segments(segment_frames(obs, enter, leave))
    order = Window.partitionBy("direction").orderBy("seg")
    # One row per segment is left here; groups of carries end at each entered segment.
    carry = F.when((F.col("entered") == 0) & (F.col("present") >= min_frames), F.col("present")).otherwise(0)
    ended = F.coalesce(F.sum("entered").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = seg.withColumn("carry", carry).withColumn("grp", ended)
    carried = F.sum("carry").over(Window.partitionBy("direction", "grp"))
    done = grouped.withColumn("carried", carried).filter("entered = 1 AND closed = 1")
    return done.select("direction", F.row_number().over(order).cast("long").alias("pass_no"), "seg", "start_ts", "end_ts", "present", "carried")


def lane_events(obs: DataFrame, enter: int = 4, leave: int = 3) -> DataFrame:
    """1 where a vehicle is first sure to be in the lane, 0 where its segment closes."""
    frames = segment_frames(obs, enter, leave)
    entered = frames.filter("entered_here = 1").groupBy("direction", "seg").agg(F.min_by("frame_no", F.struct("ts", "frame_no")).alias("frame_no"), F.min("ts").alias("ts"))
    closed = frames.filter("is_close = 1").select("direction", "seg", "frame_no", "ts").join(entered.select("direction", "seg"), ["direction", "seg"], "left_semi")
    return entered.select("direction", "seg", "ts", "frame_no", F.lit(1).alias("in_lane")).unionByName(closed.select("direction", "seg", "ts", "frame_no", F.lit(0).alias("in_lane")))


def chunk_frames(frames: DataFrame, size: int = 50) -> DataFrame:
    """Chunks of ``size`` present frames per segment: chunk number, frames, whether it is the last."""
    w = Window.partitionBy("direction", "seg").orderBy(*ORDER)
    numbered = frames.filter("state = 'present'").withColumn("chunk_no", F.floor((F.row_number().over(w) - 1) / size))
    sized = numbered.groupBy("direction", "seg", "chunk_no").agg(F.count("*").alias("frames"), F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"))
    return sized.withColumn("is_last", F.col("chunk_no") == F.max("chunk_no").over(Window.partitionBy("direction", "seg")))


def complete_chunks(chunks: DataFrame) -> DataFrame:
    """Segments whose chunk numbers have no gap, with their frames in order of chunk."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "frames")))
    out = chunks.groupBy("direction", "seg").agg(F.count_distinct("chunk_no").alias("chunks"), (F.max("chunk_no") - F.min("chunk_no") + 1).alias("span"), ordered.alias("parts"))
    return out.filter("chunks = span").select("direction", "seg", "chunks", F.array_join(F.transform("parts", lambda p: p["frames"].cast("string")), ",").alias("sizes"))


def sample_frames(obs: DataFrame, every: dict[str, int]) -> DataFrame:
    """Each direction's every n-th frame keeps its state, the others become skipped."""
    out = running(_chunked(obs), "direction", "chunk", ORDER, sums={"k": F.lit(1)})
    n = F.try_element_at(F.create_map(*[F.lit(x) for kv in every.items() for x in kv]), F.col("direction"))
    return out.withColumn("state", F.when((F.col("k") - 1) % F.coalesce(n, F.lit(1)) == 0, F.col("state")).otherwise("skipped")).drop("chunk", "k")


def segment_presence(obs: DataFrame, gap: int = 8) -> DataFrame:
    """Passes of a face camera: closed when more than ``gap`` frames in a row see nothing after something."""
    seen = runs(_chunked(obs.filter("state <> 'skipped'")), "direction", "chunk", ORDER, "state")
    marks = seen.withColumn("is_close", F.when((F.col("state") == "empty") & (F.col("pos") == gap + 1), 1).otherwise(0))
    out = running(marks, "direction", "chunk", ORDER, sums={"closes": F.col("is_close")})
    out = out.withColumn("seg", F.col("closes") - F.col("is_close"))
    found = out.groupBy("direction", "seg").agg(
        F.sum(F.when(F.col("state") == "present", 1).otherwise(0)).alias("present"), F.max("is_close").alias("closed"),
        F.min(F.when(F.col("state") == "present", F.col("ts"))).alias("start_ts"), F.max(F.when(F.col("state") == "present", F.col("ts"))).alias("end_ts"),
    )
    return found.filter("present > 0 AND closed = 1").drop("closed")


def key_frame(detections: DataFrame, keys: list[str]) -> DataFrame:
    """The frame with the largest face of each group, the first on ties."""
    return detections.groupBy(*keys).agg(F.max_by("frame_no", F.struct("area", -F.col("frame_no"))).alias("frame_no"), F.max("area").alias("area"))


def door_vote(detections: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent label of each group, the first seen on ties, with the largest area of that label."""
    counted = detections.groupBy(*keys, "label").agg(F.count("*").alias("n"), F.min("frame_no").alias("first"), F.max("area").alias("area"))
    return counted.groupBy(*keys).agg(F.max_by(F.struct("label", "area", "n"), F.struct("n", -F.col("first"))).alias("b")).select(*keys, "b.label", "b.area", "b.n")


def orientation(doors: DataFrame) -> DataFrame:
    """door forward where the front shows a door, door backward where the rear does, else unknown."""
    front = F.max(F.when((F.col("direction") == "front") & (F.col("label") == "door"), 1).otherwise(0))
    rear = F.max(F.when((F.col("direction") == "rear") & (F.col("label") == "door"), 1).otherwise(0))
    return doors.groupBy("pass_key").agg(F.when(front == 1, "door forward").when(rear == 1, "door backward").otherwise("unknown").alias("orientation"))


def load_type(detections: DataFrame, key: str) -> DataFrame:
    return detections.groupBy(key).agg(F.when(F.count("*") == 2, "double").otherwise("single").alias("load_type"))


def assign_pass(readings: DataFrame, terminators: DataFrame, key: str | None = None) -> DataFrame:
    """readings (ts, ...) with pass_no, the number of terminators (ts) of the same lane (key) before them.

    Markers and readings are put in one order; a running count over chunks of an hour needs no join.
    Without a key all readings are one lane's.
    """
    a = readings.withColumn("__mark", F.lit(0))
    b = terminators.select(*[F.col(c) if c in terminators.columns else F.lit(None).cast(readings.schema[c].dataType).alias(c) for c in readings.columns]).withColumn("__mark", F.lit(1))
    both = a.unionByName(b).withColumn("__k", F.lit(0) if key is None else F.col(key)).withColumn("chunk", F.date_trunc("hour", "ts"))
    out = running(both, "__k", "chunk", ["ts", "__mark"], sums={"pass_no": F.col("__mark")})
    return out.filter("__mark = 0").drop("__mark", "__k", "chunk")


def complete_only(parts: DataFrame, key: list[str], required: list[str]) -> DataFrame:
    """Groups that have every required kind."""
    kinds = parts.groupBy(*key).agg(F.collect_set("kind").alias("kinds"))
    return kinds.filter(F.size(F.array_except(F.array(*map(F.lit, required)), "kinds")) == 0).select(*key)


def vehicle_name(n: Column, prefix: str = "V") -> Column:
    """prefix and the number in four digits, or in as many as it has."""
    digits = n.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0")))


def number_vehicles(new: DataFrame, existing: DataFrame, prefix: str = "V") -> DataFrame:
    """vehicle: prefix and a number of four digits or more that continues the largest of channel and day."""
    last = existing.groupBy("channel", "day").agg(F.max(F.regexp_extract("vehicle", "([0-9]+)$", 1).cast("int")).alias("last"))
    n = F.row_number().over(Window.partitionBy("channel", "day").orderBy("ts", "pass_no"))
    out = new.withColumn("__n", n).join(last, ["channel", "day"], "left")
    return out.withColumn("vehicle", vehicle_name(F.col("__n") + F.coalesce("last", F.lit(0)), prefix)).drop("__n", "last")


def archive_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format("ts", "yyMMdd")).withColumn("clock", F.date_format("ts", "HHmmss"))


def outages(reads: DataFrame, n: int = 5) -> DataFrame:
    """Every n-th failed read in a row (ok = 0) is an outage."""
    seen = runs(_chunked(reads), "direction", "chunk", ORDER, "ok")
    return seen.filter((F.col("ok") == 0) & (F.col("pos") % n == 0)).select("direction", "ts", "frame_no", (F.col("pos") / n).cast("long").alias("nth"))


def boundaries_side(obs: DataFrame, enter: int = 10, idle: int = 3) -> DataFrame:
    """direction, n, t: boundaries of a side camera in seconds from the start of its recording.

    Idle seconds are those of empty frames from the ``idle``-th in a row on. The ``enter``-th present
    frame of a run ends a stretch, which gives its earliest idle second, if any; what follows the last
    one gives its latest. A recording without a vehicle gives 0 and its latest idle second.
    """
    seen = runs(_chunked(obs.filter("state <> 'skipped'")), "direction", "chunk", ORDER, "state")
    marks = seen.withColumn("__end", F.when((F.col("state") == "present") & (F.col("pos") == enter), 1).otherwise(0))
    out = running(marks, "direction", "chunk", ORDER, sums={"ends": F.col("__end")}).withColumn("stretch", F.col("ends") - F.col("__end"))
    start = obs.groupBy("direction").agg(F.min("ts").alias("t0"), F.max((F.col("state") == "present").cast("int")).alias("any"))
    second = F.round(micros(F.col("ts")) / 1e6 - micros(F.col("t0")) / 1e6, 2)
    rows = out.join(start, "direction").withColumn("s", F.when((F.col("state") == "empty") & (F.col("pos") >= idle), second))
    per = rows.groupBy("direction", "any", "stretch").agg(F.max("__end").alias("ended"), F.min("s").alias("low"), F.max("s").alias("high")).filter("low IS NOT NULL")
    t = F.when(F.col("any") == 0, F.array(F.lit(0.0), F.col("high"))).when(F.col("ended") == 1, F.array("low")).otherwise(F.array("high"))
    order = Window.partitionBy("direction").orderBy("stretch", "t")  # one row per vehicle is left here
    return per.select("direction", "stretch", F.explode(t).alias("t")).withColumn("n", F.row_number().over(order).cast("long")).select("direction", "n", "t")


def _reached(rows: DataFrame, key: str, least: float) -> DataFrame:
    """key, t of the rows (key, cluster, t) that are kept: the first of a cluster, and from each the first one more than least behind it.

    Every row's successor is found by one scan over rows and limits. Then successors are doubled: after r
    rounds all rows up to 2**r steps from a cluster's first are reached, so rounds are logarithmic.
    """
    by, rounds = F.floor(F.col("__at") / (least * 1000)), Rounds(rows.sparkSession)
    own = running(rows.withColumn("__at", F.col("t")).withColumn("__c", by), key, "__c", ["t"], sums={"n": F.lit(1)}).select(key, "cluster", "t", "n")
    (own,) = rounds.put(own=own)
    points = own.select(key, "cluster", "t", "n", F.col("t").alias("__at"), F.lit(0).alias("__mark")).unionByName(own.select(key, "cluster", "t", "n", (F.col("t") + least).alias("__at"), F.lit(1).alias("__mark")))
    upto = running(points.withColumn("__c", by), key, "__c", ["__at", "__mark", "n"], sums={"upto": 1 - F.col("__mark")}).filter("__mark = 1")
    # The sum may be rounded the other way than the difference that counts: the rows next to the limit are looked at.
    near = upto.select(key, "cluster", "t", "n", F.explode(F.expr("sequence(upto, upto + 2)")).alias("to"))
    after = own.select(key, F.col("cluster").alias("__cluster"), F.col("t").alias("__t"), F.col("n").alias("to"))
    jump = near.join(after, [key, "to"]).filter((F.col("__t") - F.col("t") > least) & (F.col("__cluster") == F.col("cluster"))).groupBy(key, "n").agg(F.min("to").alias("to"))
    first = own.groupBy(key, "cluster").agg(F.min("n").alias("n")).select(key, "n")
    jump, kept = rounds.put(jump=jump, kept=first)
    while True:
        new = kept.join(jump, [key, "n"]).select(key, F.col("to").alias("n")).distinct().join(kept, [key, "n"], "left_anti")
        (new,) = rounds.put(new=new)
        if new.isEmpty():
            break
        further = jump.select(key, F.col("n").alias("to"), F.col("to").alias("__to"))
        kept, jump = rounds.put(kept=kept.unionByName(new), jump=jump.join(further, [key, "to"]).select(key, "n", F.col("__to").alias("to")))
    rounds.drop("new", "jump")
    return own.join(kept, [key, "n"], "left_semi").select(key, "t")


def suppress_adjacent(times: DataFrame, key: str, time: str = "t", least: float = 50.0, fold: int = 1000) -> DataFrame:
    """key, n, time: boundaries more than ``least`` seconds from the last kept one, numbered from 0.

    A boundary that far behind its predecessor is kept whatever came before, so the boundaries fall
    into clusters. A cluster of up to ``fold`` of them is one array; longer ones, such as a busy lane's, go by
    doubling of successors. Gaps and numbers go in two levels over stretches of time.
    """
    rows = cut(times.select(key, F.col(time).cast("double").alias("t")).distinct())  # some rows per vehicle, from many scans
    stretch = F.floor(F.col("t") / (least * 1000))
    rows = previous(rows.withColumn("__c", stretch), key, "__c", ["t"], "t", "__p")
    apart = F.when(F.col("t") - F.col("__p") > least, 1).otherwise(0)
    rows = cut(running(rows, key, "__c", ["t"], sums={"cluster": apart}).select(key, "cluster", "t"))
    sizes = rows.groupBy(key, "cluster").agg(F.count("*").alias("__n"))
    long = sizes.filter(F.col("__n") > fold).select(key, "cluster")
    short = rows.join(long, [key, "cluster"], "left_anti").groupBy(key, "cluster").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    folded = F.aggregate(
        "ts", F.array().cast("array<double>"),
        lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) > least), F.concat(kept, F.array(t))).otherwise(kept),
    )
    kept = short.select(key, F.explode(folded).alias("t"))
    if not long.isEmpty():
        kept = kept.unionByName(_reached(rows.join(long, [key, "cluster"], "left_semi"), key, least))
    out = running(kept.withColumn("__c", stretch), key, "__c", ["t"], sums={"n": F.lit(1)})
    return out.select(key, (F.col("n") - 1).cast("int").alias("n"), F.col("t").alias(time))


def choose_timeline(times: DataFrame, group: list[str], direction: str = "direction") -> DataFrame:
    """The direction with the fewest boundaries; the last by name on ties."""
    sized = times.groupBy(*group, direction).agg(F.count("*").alias("k"))
    return sized.groupBy(*group).agg(F.max_by(direction, F.struct(-F.col("k"), direction)).alias(direction), F.min("k").alias("k"), (F.count_distinct("k") == 1).alias("all_equal"))


def clip_plan(times: DataFrame, key: str, time: str = "t", pre: float = 8, post: float = 3) -> DataFrame:
    """Clips between neighbouring boundaries, widened and cut to whole seconds."""
    w = Window.partitionBy(key).orderBy(time)
    pairs = times.withColumn("__next", F.lead(time).over(w)).filter("__next IS NOT NULL").withColumn("clip", F.row_number().over(w).cast("long"))
    begin = F.when(F.col(time) - pre > 0, F.col(time) - pre).otherwise(F.col(time))
    return pairs.select(key, "clip", begin.cast("int").alias("begin"), (F.col("__next") + post).cast("int").alias("end"))


def clip_rows(obs: DataFrame, plan: DataFrame, key: str, second: Column, bucket: int = 60) -> DataFrame:
    """Rows of obs inside each clip: an equi-join on minutes, then the exact condition."""
    rows = obs.withColumn("__s", second).withColumn("__b", F.floor(F.col("__s") / bucket))
    clips = plan.withColumn("__b", F.explode(F.sequence(F.floor(F.col("begin") / bucket), F.floor(F.col("end") / bucket))))
    return rows.join(clips, [key, "__b"]).filter("__s >= begin AND __s <= `end`").drop("__b", "__s")


def retention(files: DataFrame, keep: int = 20) -> DataFrame:
    """Files beyond the newest ``keep`` of their directory."""
    w = Window.partitionBy("dir").orderBy(F.desc("mtime"), "name")
    return files.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") > keep).drop("__r")


def _hours(df: DataFrame) -> DataFrame:
    return df.withColumn("h", F.explode(F.sequence(F.date_trunc("hour", "start_ts"), F.date_trunc("hour", "end_ts"), F.expr("interval 1 hour"))))


def fuse_passes(sides: DataFrame, faces: DataFrame) -> DataFrame:
    """Side passes joined with face passes of the same lane that overlap them in time, by hour and then exactly."""
    hit = _hours(sides).alias("a").join(_hours(faces).alias("b"), ["lane", "h"]).filter("a.start_ts <= b.end_ts AND b.start_ts <= a.end_ts")
    return hit.select("lane", F.col("a.direction").alias("side"), F.col("a.pass_no").alias("pass_no"), F.col("b.direction").alias("face"), F.col("b.seg").alias("face_seg")).distinct()


def best_parts(anchors: DataFrame, parts: DataFrame, columns: list[str]) -> DataFrame:
    """lane, pass_no of anchors (with start_ts, end_ts) and the columns of the part of their lane that overlaps them most.

    On ties the earlier part counts; anchors without one are left out. Parts meet anchors by lane and
    hour, then exactly; what is grouped are the few parts of one anchor.
    """
    own = anchors.select("lane", "pass_no", F.col("start_ts").alias("__s"), F.col("end_ts").alias("__e"))
    a = own.withColumn("h", F.explode(F.sequence(F.date_trunc("hour", "__s"), F.date_trunc("hour", "__e"), F.expr("interval 1 hour"))))
    hit = a.join(_hours(parts), ["lane", "h"]).filter("start_ts <= __e AND __s <= end_ts")
    common = micros(F.least("end_ts", "__e")) - micros(F.greatest("start_ts", "__s"))
    best = hit.groupBy("lane", "pass_no").agg(F.max_by(F.struct(*columns), F.struct(common.alias("c"), (-micros(F.col("start_ts"))).alias("s"), F.struct(*columns).alias("p"))).alias("__p"))
    return best.select("lane", "pass_no", *[F.col(f"__p.{c}").alias(c) for c in columns])


def vehicle_records(anchors: DataFrame, views: dict[str, DataFrame], readings: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One record per anchor pass: the pass of every other view, the texts read, and whether all views are there.

    views: name -> passes (lane, start_ts, end_ts, seg); readings: name -> (results with lane, start_ts,
    end_ts and texts, their columns). Adds seg_<name> per view, the texts and ``complete``.
    """
    out = anchors
    parts = [(df.withColumnRenamed("seg", f"seg_{name}"), [f"seg_{name}"]) for name, df in views.items()]
    for df, columns in [*parts, *readings.values()]:
        out = out.join(best_parts(anchors, df, columns), ["lane", "pass_no"], "left")
    there = F.lit(True)
    for name in views:
        there = there & F.col(f"seg_{name}").isNotNull()
    return out.withColumn("complete", there)


def segment_idle(obs: DataFrame, idle: int = 8) -> DataFrame:
    """Readings of one vehicle: from the first present frame until ``idle`` empty frames in a row."""
    return segment_presence(obs, idle - 1)


def recording_durations(frames: DataFrame, fps: float = 25.0) -> DataFrame:
    """direction, frames and seconds of each recording at a frame rate."""
    return frames.groupBy("direction").agg(F.count("*").alias("frames")).withColumn("seconds", F.col("frames") / F.lit(fps))


#: How far a match must move to count, and how little it may drop, per view; None is the mean of the middle.
MOVES = {"right": (None, 10.0), "left": (-1.0, None), "top": (-10.0, 10.0)}


def pair_offsets(matches: DataFrame, view: str, keys: list[str]) -> DataFrame:
    """keys and offset: how far the picture moved between two frames, of matched points (x1, y1, x2, y2).

    Points count by ``MOVES`` (to the right more than the mean of the middle 60 per cent, else less
    than a limit); the offset is the rounded mean of the middle half of their moves, of all up to three,
    and 0 where no point counts. A pair of frames has as many points as its detector gives.
    """
    limit, drop = MOVES[view]
    rows = matches.withColumns({"dx": F.col("x2") - F.col("x1"), "dy": F.col("y2") - F.col("y1")})
    pair = Window.partitionBy(*keys)

    def middle(df: DataFrame, low: float, high: float, out: str) -> DataFrame:
        k, n = F.row_number().over(pair.orderBy("dx", "dy")) - 1, F.count("*").over(pair)
        inside = (F.col("__k") >= F.floor(F.col("__n") * low)) & (F.col("__k") < F.floor(F.col("__n") * high))
        return df.withColumns({"__k": k, "__n": n}).withColumn(out, inside)

    if limit is None:
        rows = middle(rows, 0.2, 0.8, "__mid")
        good = rows.withColumn("__mean", F.avg(F.when(F.col("__mid"), F.col("dx"))).over(pair)).filter(F.col("dx") > F.col("__mean"))
    else:
        good = rows.filter(F.col("dx") < limit)
    if drop is not None:
        good = good.filter(F.col("dy") < drop)
    good = middle(good, 0.25, 0.75, "__mid")
    kept = good.filter((F.col("__n") <= 3) | F.col("__mid")).groupBy(*keys).agg(F.bround(F.abs(F.avg("dx"))).cast("long").alias("offset"))
    return matches.select(*keys).distinct().join(kept, keys, "left").select(*keys, F.coalesce("offset", F.lit(0)).alias("offset"))


def stitch_plan(offsets: DataFrame, key: str, order: str, width: int) -> DataFrame:
    """key, order, used, x, total: where each frame of a panorama is placed, and the panorama's width.

    Offsets of 1 or less give way to the whole part of the mean of those that are not 0 (0 without
    any). The frame at ``order`` 0 is left out, the next one stands at 0. A panorama is one pass, of
    some thousand frames at most.
    """
    w = Window.partitionBy(key).orderBy(order)
    mean = F.coalesce(F.avg(F.when(F.col("offset") != 0, F.col("offset"))).over(Window.partitionBy(key)).cast("long"), F.lit(0))
    used = F.when(F.col("offset") > 1, F.col("offset")).otherwise(F.col("__mean"))
    placed = offsets.withColumn("__mean", mean).filter(F.col(order) >= 1).withColumn("used", used).withColumn("x", F.sum("used").over(w))
    return placed.withColumn("total", F.max("x").over(Window.partitionBy(key)) + F.lit(width)).select(key, order, "used", "x", "total")


def boundaries_face(obs: DataFrame, gap: int = 10) -> DataFrame:
    """One second per pass of a face camera: the first pass gives its earliest idle second, later ones the latest before them.

    Idle seconds are those of empty frames between the pass before and this one.
    """
    seen = runs(_chunked(obs.filter("state <> 'skipped'")), "direction", "chunk", ORDER, "state")
    marks = seen.withColumn("is_close", F.when((F.col("state") == "empty") & (F.col("pos") == gap + 1), 1).otherwise(0))
    out = running(marks, "direction", "chunk", ORDER, sums={"closes": F.col("is_close")}).withColumn("seg", F.col("closes") - F.col("is_close"))
    start = obs.groupBy("direction").agg(F.min("ts").alias("t0"))
    second = F.round(micros(F.col("ts")) / 1e6 - micros(F.col("t0")) / 1e6, 2)
    idle = out.join(start, "direction").withColumn("s", F.when(F.col("state") == "empty", second))
    seg = idle.groupBy("direction", "seg").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.max("is_close").alias("closed"), F.sum(F.when(F.col("state") == "present", 1).otherwise(0)).alias("present"))
    w = Window.partitionBy("direction").orderBy("seg")  # one row per pass
    good = seg.filter("closed = 1 AND present > 0").withColumn("n", F.row_number().over(w).cast("long"))
    return good.select("direction", "n", F.when(F.col("n") == 1, F.col("low")).otherwise(F.col("high")).alias("t"))


def best_reading_frame(readings: DataFrame, key: str, frame: str) -> DataFrame:
    """Of the frames of each group the one with the most readings, then the highest mean score, then the first."""
    per = readings.groupBy(key, frame).agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    return per.groupBy(key).agg(F.max_by(F.struct(frame, "n", "mean"), F.struct("n", F.round("mean", 9), -F.col(frame))).alias("b")).select(key, f"b.{frame}", "b.n", "b.mean")


def final_pairs(pairs: DataFrame, key: str, a: str, b: str, order: str) -> DataFrame:
    """With more than one pair those with both parts; with more than two of those each once, at its first place."""
    counted = pairs.groupBy(key).agg(F.count("*").alias("__n"))
    full = pairs.join(counted, key).filter((F.col("__n") == 1) | ((F.col(a) != "") & (F.col(b) != "")))
    left = full.groupBy(key).agg(F.count("*").alias("__m"))
    once = full.join(left, key).withColumn("__k", F.when(F.col("__m") > 2, F.lit(0)).otherwise(F.col(order)))
    return once.groupBy(key, a, b, "__k").agg(F.min(order).alias(order)).drop("__k")


def front_epochs(rows: DataFrame, is_close: Column, key: str | None = None) -> DataFrame:
    """rows with ``epoch``, the number of front closes of their lane (key) up to them; streams are cut by the hour."""
    keyed = rows.withColumn("chunk", F.date_trunc("hour", "ts")).withColumn("__k", F.lit(0) if key is None else F.col(key))
    return running(keyed, "__k", "chunk", ORDER, sums={"epoch": F.when(is_close, 1).otherwise(0)}).drop("__k", "chunk")


def reset_on_front(rows: DataFrame, is_close: Column, record: list[str], key: str | None = None) -> DataFrame:
    """rows without what a later front close of the same record makes void: those of its last epoch are left."""
    epochs = front_epochs(rows, is_close, key)
    last = epochs.groupBy(*record).agg(F.max("epoch").alias("__last"))
    return epochs.join(last, record).filter(F.col("epoch") == F.col("__last")).drop("__last")
