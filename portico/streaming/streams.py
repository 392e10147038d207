"""Passes, outages, pass numbers, vehicle records and roll-ups over streams, in event time.

Every stateful operator takes a watermark: rows may arrive in any order within ``delay``. Spark itself
leaves out rows that are older than the watermark and counts them (``numRowsDroppedByWatermark``).

* ``pass_stream``, ``presence_stream``, ``outage_stream``: frames wait in a map from second to rows until
  the watermark has passed them, and are then folded in order, so the result is that of the batch form
  however frames fall into micro-batches. A camera that is silent longer than ``silence`` has its open
  pass closed by a timer; all that stays of it are counters.
* ``assign_stream``: numbers go out at once. Terminators and readings stay in maps until the watermark has
  passed them; a terminator that comes later than readings after it sends corrections for these.
* ``record_stream``: the passes and readings of a lane are held as open intervals; a timer sends the record
  of an anchor once nothing can change it any more, or after ``wait`` with what there is.

They need the RocksDB state store, which ``ready`` sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000


def ready(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def observations(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Frame observations that arrive as Parquet files, a number of files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def micros(interval: str | None) -> int | None:
    """Microseconds of an interval such as '10 minutes'."""
    return None if interval is None else pd.Timedelta(interval).value // 1000


def _micros_of(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def _frame(rows: list[tuple], types: dict[str, str]) -> pd.DataFrame:
    """Rows as a DataFrame; columns of type time are microseconds (None: no time)."""
    made = pd.DataFrame(rows, columns=list(types))
    for c, kind in types.items():
        made[c] = pd.to_datetime(made[c].astype("Int64"), unit="us").astype("datetime64[ns]") if kind == "time" else made[c].astype(kind)
    return made


class _Timed(StatefulProcessor):
    """What the processors share: a timer just after a time in microseconds, and the watermark in microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wake(self, us: int) -> None:
        self.handle.registerTimer(max(0, us // 1000 + 1))

    @staticmethod
    def watermark(timers) -> int:
        return timers.getCurrentWatermarkInMs() * 1000

    def close(self) -> None:
        pass


EVENT = "direction string, kind string, nth long, seg long, start_ts timestamp, end_ts timestamp, frames long, carried long, closed_by string"
_EVENT = {"direction": "object", "kind": "object", "nth": "int64", "seg": "int64", "start_ts": "time", "end_ts": "time", "frames": "int64", "carried": "int64", "closed_by": "object"}
STATE = "state string, pos long, entered boolean, nth long, seg long, present long, carried long, first_us long, last_us long, shown_first long, shown_last long"
_FIRST = ("", 0, False, 0, 0, 0, 0, -1, -1, -1, -1)


class Fold:
    """The state of one camera: the run it is in and what it has seen since the last close.

    ``add`` takes frames in order and ``quiet`` the end of a camera that fell silent; both return rows of
    (kind, nth, seg, start, end, frames, carried, closed_by).
    """

    def __init__(self, mode: str, enter: int, leave: int, least: int, silence: int | None, kept: tuple = _FIRST):
        self.mode, self.enter, self.leave, self.least, self.silence = mode, enter, leave, least, silence
        self.state, self.pos, self.entered, self.nth, self.seg, self.present, self.carried, self.first, self.last, self.shown, self.seen = kept

    def kept(self) -> tuple:
        return self.state, self.pos, self.entered, self.nth, self.seg, self.present, self.carried, self.first, self.last, self.shown, self.seen

    def _close(self, by: str) -> list[tuple]:
        out = []
        if self.mode == "pass" and self.entered or self.mode == "presence" and self.present:
            self.nth += 1
            ends = (self.first, self.last) if self.mode == "pass" else (self.shown, self.seen)
            out = [(self.mode, self.nth, self.seg, *ends, self.present, self.carried, by)]
            self.carried = 0
        elif self.mode == "pass" and self.present >= self.least:
            self.carried += self.present
        self.seg, self.present, self.entered, self.first, self.shown, self.seen = self.seg + 1, 0, False, -1, -1, -1
        return out

    def quiet(self) -> list[tuple]:
        out = self._close("silence") if self.first >= 0 and self.mode != "outage" else []
        self.state, self.pos, self.first, self.last = "", 0, -1, -1
        return out

    def add(self, us: int, now: str) -> list[tuple]:
        out = self.quiet() if self.silence is not None and 0 <= self.last < us - self.silence else []
        if now == "skipped" and self.mode != "pass":
            return out
        self.first, self.last = us if self.first < 0 else self.first, us
        if now == "skipped":
            return out
        self.pos = self.pos + 1 if now == self.state else 1
        self.state = now
        if now == "present":
            self.present, self.shown, self.seen = self.present + 1, us if self.shown < 0 else self.shown, us
            self.entered |= self.pos >= self.enter
        elif self.mode == "outage":
            if self.pos % self.leave == 0:
                out.append(("outage", self.pos // self.leave, self.seg, us, us, self.pos, 0, "frames"))
        elif self.pos == self.leave if self.mode == "presence" else self.pos % self.leave == 0:
            out += self._close("frames")
        return out


class _Runs(_Timed):
    """Frames of one camera wait until the watermark has passed them and are folded in order."""

    def __init__(self, *args):
        self.args = args

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("run", STATE)
        self.waiting = handle.getMapState("waiting", "second long", "us array<long>, frame array<long>, state array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: dict[int, list[tuple]] = {}
        for batch in rows:
            for us, frame, state in zip(_micros_of(batch["ts"]), batch["frame_no"].tolist(), batch["state"].tolist(), strict=True):
                new.setdefault(us // SECOND, []).append((us, frame, state))
        for second, found in new.items():
            self._put(second, self._take(second) + found)
        if new:
            self.wake(min(new[min(new)])[0])
        yield from ()

    def _take(self, second: int) -> list[tuple]:
        v = self.waiting.getValue((second,)) if self.waiting.containsKey((second,)) else None
        return [] if v is None else list(zip(v[0], v[1], v[2], strict=True))

    def _put(self, second: int, rows: list[tuple]) -> None:
        self.waiting.updateValue((second,), tuple([r[k] for r in rows] for k in range(3)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = self.watermark(timerValues)
        fold = Fold(*self.args, tuple(self.kept.get()) if self.kept.exists() else _FIRST)
        seconds = sorted(k[0] for k in self.waiting.keys())  # noqa: SIM118
        out, rest = [], None
        for second in seconds:
            if second * SECOND > mark:
                rest = second * SECOND
                break
            rows = sorted(self._take(second))
            due = [r for r in rows if r[0] <= mark]
            for us, _, state in due:
                out += fold.add(us, state)
            if len(due) < len(rows):
                rest = rows[len(due)][0]
                self._put(second, rows[len(due) :])
                break
            self.waiting.removeKey((second,))
        if fold.silence is not None and fold.last >= 0:
            if mark >= fold.last + fold.silence:
                out += fold.quiet()
            else:
                self.wake(fold.last + fold.silence)
        if rest is not None:
            self.wake(rest)
        self.kept.update(fold.kept())
        yield _frame([(key[0], *r) for r in out], _EVENT)


def _fold(obs: DataFrame, delay: str, *args) -> DataFrame:
    rows = obs.select("direction", F.col("ts").cast("timestamp").alias("ts"), "frame_no", "state").withWatermark("ts", delay)
    return rows.groupBy("direction").transformWithStateInPandas(statefulProcessor=_Runs(*args), outputStructType=EVENT, outputMode="append", timeMode="EventTime")


def pass_stream(obs: DataFrame, enter: int = 4, leave: int = 3, min_frames: int = 5, delay: str = "10 seconds", silence: str | None = None) -> DataFrame:
    """A row for each closed pass of a side camera, as ``passes.passes`` in batch, carried frames included.

    nth and seg are the batch's pass_no and seg, frames its present. closed_by is ``frames``, or ``silence``
    for a pass (with the time of its last frame) whose camera sent nothing for longer than that.
    """
    return _fold(obs, delay, "pass", enter, leave, min_frames, micros(silence))


def presence_stream(obs: DataFrame, gap: int = 8, delay: str = "10 seconds", silence: str | None = None) -> DataFrame:
    """A row for each pass of a face camera, as ``passes.segment_presence`` in batch; skipped frames count nowhere."""
    return _fold(obs, delay, "presence", 1, gap + 1, 0, micros(silence))


def outage_stream(reads: DataFrame, n: int = 5, delay: str = "10 seconds") -> DataFrame:
    """A row for every n-th failed read in a row, as ``passes.outages``; reads have ok = 1 or 0."""
    state = F.when(F.col("ok") == 1, "present").otherwise("empty")
    return _fold(reads.withColumn("state", state), delay, "outage", 1, n, 0, None)


NUMBER = "lane string, reading_id long, pass_no long, corrects long"


class _Epochs(_Timed):
    """Numbers readings of a lane by the terminators before them; late terminators correct them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.base = handle.getValueState("base", "passes long")
        self.ends = handle.getMapState("ends", "us long", "n long")
        self.readings = handle.getMapState("readings", "us long, reading_id long", "pass_no long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        times, ids, marks = _micros_of(batch["ts"]), batch["reading_id"].tolist(), batch["is_end"].tolist()
        first = None
        for us, mark in zip(times, marks, strict=True):
            if mark:
                n = self.ends.getValue((us,))[0] if self.ends.containsKey((us,)) else 0
                self.ends.updateValue((us,), (n + 1,))
                first = us if first is None else min(first, us)
        ends = sorted((k[0], v[0]) for k, v in self.ends.iterator())
        base = self.base.get()[0] if self.base.exists() else 0
        # Readings that were numbered before and lie after a new terminator are numbered again.
        old = {} if first is None else {tuple(k): v[0] for k, v in self.readings.iterator() if k[0] > first}
        new = {(us, int(i)) for us, i, mark in zip(times, ids, marks, strict=True) if not mark}
        out, at, n = [], 0, base
        for us, i in sorted(new | old.keys()):
            while at < len(ends) and ends[at][0] < us:
                n, at = n + ends[at][1], at + 1
            if (before := old.get((us, i))) != n:
                out.append((key[0], i, n, before))
                self.readings.updateValue((us, i), (n,))
        self.wake(max(times))
        yield _frame(out, {"lane": "object", "reading_id": "int64", "pass_no": "int64", "corrects": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = self.watermark(timerValues)
        over = [(k[0], v[0]) for k, v in self.ends.iterator() if k[0] <= mark]
        if over:
            self.base.update(((self.base.get()[0] if self.base.exists() else 0) + sum(n for _, n in over),))
        for us, _ in over:
            self.ends.removeKey((us,))
        for k in [tuple(k) for k in self.readings.keys() if k[0] <= mark]:  # noqa: SIM118
            self.readings.removeKey(k)
        yield from ()


def assign_stream(marked: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """lane, reading_id, pass_no of marked rows (lane, ts, reading_id, is_end); ends are terminators.

    A row with ``corrects`` replaces that number of its reading; the last row of a reading counts, and is
    the number of ``passes.assign_pass`` in batch. Readings of a lane are told apart by time and reading_id.
    """
    rows = marked.select("lane", F.col("ts").cast("timestamp").alias("ts"), "reading_id", "is_end").withWatermark("ts", delay)
    return rows.groupBy("lane").transformWithStateInPandas(statefulProcessor=_Epochs(), outputStructType=NUMBER, outputMode="update", timeMode="EventTime")


def resource_stream(samples: DataFrame, every: str = "11 seconds", late: str = "10 seconds") -> DataFrame:
    """Largest values of each interval of event time."""
    from ..operators.telemetry import RESOURCES, parse_resources

    parsed = parse_resources(samples.withColumn("ts", F.col("ts").cast("timestamp"))).withWatermark("ts", late)
    return parsed.groupBy(F.window("ts", every).alias("w")).agg(*[F.max(c).alias(c) for c in RESOURCES], F.count("*").alias("samples")).select(F.col("w.start").alias("start"), *RESOURCES, "samples")


PART = "lane string, kind string, start_ts timestamp, end_ts timestamp, number long, text string"


def overlap(part: tuple[int, int], start: int, end: int) -> int | None:
    """Common microseconds of an interval and a part (start, end); None if they don't touch."""
    return min(part[1], end) - max(part[0], start) if part[0] <= end and start <= part[1] else None


def best_part(parts: list[tuple], start: int, end: int) -> tuple | None:
    """Of parts (start, end, number, text) the one that overlaps most, the earlier one on ties."""
    found = [(c, -p[0], p[3] or "", p[2], p) for p in parts if (c := overlap(p, start, end)) is not None]
    return max(found, key=lambda x: x[:4])[4] if found else None


def settled(parts: list[tuple], start: int, end: int) -> bool:
    """Whether no later part of a kind can be a better one. Parts of one kind don't overlap each other."""
    last, best = max((p[1] for p in parts), default=None), best_part(parts, start, end)
    if last is None:
        return False
    return overlap(best, start, end) >= end - last if best else last > end


class _Records(_Timed):
    """Open intervals of one lane; an anchor's record goes out when it is settled or its time is over."""

    def __init__(self, anchor: str, views: list[str], readings: list[str], wait: int, longest: int):
        self.anchor, self.views, self.readings, self.wait, self.longest = anchor, views, readings, wait, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.anchors = handle.getMapState("anchors", "start_us long, number long", "end_us long")
        self.parts = handle.getMapState("parts", "kind string, start_us long, number long", "end_us long, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            for kind, start, end, number, text in zip(batch["kind"], _micros_of(batch["start_ts"]), _micros_of(batch["end_ts"]), batch["number"].tolist(), batch["text"], strict=True):
                if kind == self.anchor:
                    self.anchors.updateValue((start, number), (end,))
                    self.wake(end + self.wait)
                elif kind in self.views or kind in self.readings:
                    self.parts.updateValue((kind, start, number), (end, text))
                else:
                    continue
                self.wake(end)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, parts, out = self.watermark(timerValues), {k: [] for k in [*self.views, *self.readings]}, []
        for (kind, start, number), (end, text) in self.parts.iterator():
            parts[kind].append((start, end, number, text))
        open_from = mark - self.longest
        for (start, number), (end,) in sorted((tuple(k), tuple(v)) for k, v in self.anchors.iterator()):
            # Only what ended by now counts, and nothing that ended after the waiting time, so that the order of arrival is of no account.
            upto = min(mark, end + self.wait)
            known = {k: [p for p in own if p[1] <= upto] for k, own in parts.items()}
            if mark < end or (mark < end + self.wait and not all(settled(own, start, end) for own in known.values())):
                open_from = min(open_from, start)
                continue
            chosen = {k: best_part(own, start, end) for k, own in known.items()}
            row = [p and p[2] for p in (chosen[v] for v in self.views)] + [p and p[3] for p in (chosen[r] for r in self.readings)]
            out.append((key[0], number, start, end, *row, all(chosen[v] for v in self.views)))
            self.anchors.removeKey((start, number))
        for kind, own in parts.items():  # the last one of a kind tells what is settled
            last = max((p[1] for p in own if p[1] <= mark), default=None)
            for start, end, number, _ in own:
                if end < open_from and end != last:
                    self.parts.removeKey((kind, start, number))
        yield _frame(out, self.types())

    def types(self) -> dict[str, str]:
        return {"lane": "object", "pass_no": "int64", "start_ts": "time", "end_ts": "time"} | {f"seg_{v}": "Int64" for v in self.views} | dict.fromkeys(self.readings, "object") | {"complete": "bool"}


def parts_of(views: dict[str, DataFrame], readings: dict[str, tuple[DataFrame, str]], anchor: str, anchors: DataFrame) -> DataFrame:
    """The one stream that ``record_stream`` takes, of passes of views, readings with their text column, and anchors."""
    times = [F.col(c).cast("timestamp").alias(c) for c in ("start_ts", "end_ts")]
    part = lambda df, kind, number, text: df.select("lane", F.lit(kind).alias("kind"), *times, F.col(number).cast("long").alias("number"), text.alias("text"))
    out = part(anchors, anchor, "pass_no", F.lit(None).cast("string"))
    for kind, df in views.items():
        out = out.unionByName(part(df, kind, "seg", F.lit(None).cast("string")))
    for kind, (df, column) in readings.items():
        out = out.unionByName(part(df.withColumn("__n", F.lit(0)), kind, "__n", F.col(column)))
    return out


def record_stream(parts: DataFrame, views: list[str], readings: list[str], anchor: str = "top", delay: str = "10 seconds", wait: str = "5 minutes", longest: str = "10 minutes") -> DataFrame:
    """One record per anchor pass, as ``passes.vehicle_records``: seg_<view> of each view, the texts read, complete.

    parts: lane, kind (anchor, a view or a reading), start_ts, end_ts, number, text; a part is known when it
    ends. A record goes out as soon as no part to come can change it, at the latest ``wait`` after its
    anchor's end, then without what is missing; parts that end after that count no more. An anchor lasts no
    longer than ``longest``; parts are kept as long as an anchor can still need them.
    """
    made = _Records(anchor, views, readings, micros(wait), micros(longest))
    kinds = {"object": "string", "int64": "long", "Int64": "long", "time": "timestamp", "bool": "boolean"}
    schema = ", ".join(f"`{c}` {kinds[k]}" for c, k in made.types().items())
    return parts.withWatermark("end_ts", delay).groupBy("lane").transformWithStateInPandas(statefulProcessor=made, outputStructType=schema, outputMode="append", timeMode="EventTime")


def fuse_stream(sides: DataFrame, faces: DataFrame, late: str = "10 seconds", longest: str = "10 minutes") -> DataFrame:
    """Side and face passes of a lane that overlap; state is kept no longer than the longest pass."""
    a = sides.withWatermark("start_ts", late).alias("a")
    b = faces.select("lane", F.col("direction").alias("face"), F.col("nth").alias("face_no"), F.col("start_ts").alias("f_start"), F.col("end_ts").alias("f_end")).withWatermark("f_start", late).alias("b")
    near = F.expr(f"a.lane = b.lane AND a.start_ts <= f_end AND f_start <= a.end_ts AND f_start >= a.start_ts - interval {longest} AND f_start <= a.start_ts + interval {longest}")
    return a.join(b, near).select("a.lane", "a.direction", "a.nth", "face", "face_no")
