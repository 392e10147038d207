"""Queries over observations of cameras: passes, events, timelines, clips."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import passes as P
from ..operators.scans import cut
from .fixtures import fixture, oracle
from .registry import query

_ISLANDS = """, o AS (SELECT * FROM f_obs WHERE state<>'skipped'),
r AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY direction ORDER BY ts,frame_no)=state THEN 0 ELSE 1 END AS chg FROM o),
i AS (SELECT *, sum(chg) OVER (PARTITION BY direction ORDER BY ts,frame_no ROWS UNBOUNDED PRECEDING) AS run FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY direction,run ORDER BY ts,frame_no) AS pos FROM i)"""
_SEG = _ISLANDS + """,
c AS (SELECT f.direction, f.ts, f.frame_no, f.state, coalesce(CASE WHEN p.state='empty' AND pos%3=0 THEN 1 END,0) AS is_close, coalesce(CASE WHEN p.state='present' AND pos=4 THEN 1 END,0) AS ent
 FROM f_obs f LEFT JOIN p ON p.direction=f.direction AND p.frame_no=f.frame_no),
g AS (SELECT *, CAST(coalesce(sum(is_close) OVER (PARTITION BY direction ORDER BY ts,frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS seg FROM c),
s AS (SELECT direction, seg, max(ent) AS entered, max(is_close) AS closed, count(*) FILTER (state='present') AS present, count(*) AS frames, min(ts) AS start_ts, max(ts) AS end_ts FROM g GROUP BY direction, seg)"""


@query(oracle("OBS", _SEG + """, q AS (SELECT *, CASE WHEN entered=0 AND present>=5 THEN present ELSE 0 END AS carry, coalesce(sum(entered) OVER (PARTITION BY direction ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS grp FROM s),
w AS (SELECT *, sum(carry) OVER (PARTITION BY direction, grp) AS carried FROM q)
SELECT direction, row_number() OVER (PARTITION BY direction ORDER BY seg) AS pass_no, seg, start_ts, end_ts, present, CAST(carried AS BIGINT) AS carried FROM w WHERE entered=1 AND closed=1"""))
def pass_segments(spark, sf_dir):
    return P.passes(fixture(spark, sf_dir, "OBS"))


@query(oracle("OBS", _SEG + """, e AS (SELECT direction, seg, min(ts) AS ts, min_by(frame_no,(ts,frame_no)) AS frame_no FROM g WHERE ent=1 GROUP BY direction, seg)
SELECT direction, seg, ts, frame_no, 1 AS in_lane FROM e UNION ALL
SELECT g.direction, g.seg, g.ts, g.frame_no, 0 FROM g JOIN e ON e.direction=g.direction AND e.seg=g.seg WHERE is_close=1"""))
def lane_events(spark, sf_dir):
    return P.lane_events(fixture(spark, sf_dir, "OBS"))


_CHUNKS = """, n AS (SELECT *, (row_number() OVER (PARTITION BY direction,seg ORDER BY ts,frame_no)-1)//5 AS chunk_no FROM g WHERE state='present'),
k AS (SELECT direction, seg, chunk_no, count(*) AS frames, min(frame_no) AS first_frame, max(frame_no) AS last_frame FROM n GROUP BY direction, seg, chunk_no)"""


@query(oracle("OBS", _SEG + _CHUNKS + " SELECT *, chunk_no=max(chunk_no) OVER (PARTITION BY direction, seg) AS is_last FROM k"))
def frame_chunks(spark, sf_dir):
    return P.chunk_frames(P.segment_frames(fixture(spark, sf_dir, "OBS")), 5)


@query(oracle("OBS", _SEG + _CHUNKS + """ SELECT direction, seg, count(DISTINCT chunk_no) AS chunks, string_agg(CAST(frames AS VARCHAR),',' ORDER BY chunk_no) AS sizes FROM k
WHERE NOT (chunk_no=1 AND seg%3=0) GROUP BY direction, seg HAVING count(DISTINCT chunk_no)=max(chunk_no)-min(chunk_no)+1"""))
def chunk_completeness(spark, sf_dir):
    chunks = P.chunk_frames(P.segment_frames(fixture(spark, sf_dir, "OBS")), 5)
    return P.complete_chunks(chunks.filter("NOT (chunk_no = 1 AND seg % 3 = 0)"))


@query(oracle("OBS", """, k AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY ts,frame_no) AS k FROM f_obs)
SELECT direction, CASE WHEN (k-1)%CASE direction WHEN 'left' THEN 2 WHEN 'right' THEN 2 WHEN 'front' THEN 4 ELSE 1 END=0 THEN state ELSE 'skipped' END AS state, count(*) AS n FROM k GROUP BY ALL"""))
def frame_sampling(spark, sf_dir):
    return P.sample_frames(fixture(spark, sf_dir, "OBS"), {"left": 2, "right": 2, "front": 4}).groupBy("direction", "state").agg(F.count("*").alias("n"))


_PRESENCE = _ISLANDS + """, c AS (SELECT *, CASE WHEN state='empty' AND pos={gap}+1 THEN 1 ELSE 0 END AS is_close FROM p),
g AS (SELECT *, coalesce(sum(is_close) OVER (PARTITION BY direction ORDER BY ts,frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS seg FROM c),
s AS (SELECT direction, CAST(seg AS BIGINT) AS seg, count(*) FILTER (state='present') AS present, max(is_close) AS closed, min(ts) FILTER (state='present') AS start_ts, max(ts) FILTER (state='present') AS end_ts FROM g GROUP BY direction, seg)"""


@query(oracle("OBS", _PRESENCE.format(gap=3) + " SELECT direction, seg, present, start_ts, end_ts FROM s WHERE present>0 AND closed=1"))
def face_passes(spark, sf_dir):
    return P.segment_presence(fixture(spark, sf_dir, "OBS"), gap=3)


@query(oracle("FACE", """ SELECT direction, day, frame_no, area FROM (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY direction, CAST(ts AS DATE) ORDER BY area DESC, frame_no) AS r FROM f_face) t WHERE r=1"""))
def key_frames(spark, sf_dir):
    return P.key_frame(fixture(spark, sf_dir, "FACE").withColumn("day", F.to_date("ts")), ["direction", "day"])


_VOTES = """, c AS (SELECT direction, date_trunc('hour',ts) AS hour, label, count(*) AS n, min(frame_no) AS first, max(area) AS area FROM f_face GROUP BY ALL),
v AS (SELECT direction, hour, label, area, n FROM (SELECT *, row_number() OVER (PARTITION BY direction, hour ORDER BY n DESC, first) AS r FROM c) t WHERE r=1)"""


@query(oracle("FACE", _VOTES + " SELECT * FROM v"))
def door_votes(spark, sf_dir):
    return P.door_vote(fixture(spark, sf_dir, "FACE").withColumn("hour", F.date_trunc("hour", "ts")), ["direction", "hour"])


@query(oracle("FACE", _VOTES + """ SELECT hour AS pass_key, CASE WHEN bool_or(direction='front' AND label='door') THEN 'door forward' WHEN bool_or(direction='rear' AND label='door') THEN 'door backward' ELSE 'unknown' END AS orientation FROM v GROUP BY hour"""))
def door_orientation(spark, sf_dir):
    votes = P.door_vote(fixture(spark, sf_dir, "FACE").withColumn("hour", F.date_trunc("hour", "ts")), ["direction", "hour"])
    return P.orientation(votes.withColumnRenamed("hour", "pass_key"))


@query(oracle("FACE", """ SELECT date_trunc('minute',ts) AS minute, CASE WHEN count(*)=2 THEN 'double' ELSE 'single' END AS load_type FROM f_face WHERE direction='right' GROUP BY 1"""))
def load_types(spark, sf_dir):
    return P.load_type(fixture(spark, sf_dir, "FACE").filter("direction = 'right'").withColumn("minute", F.date_trunc("minute", "ts")), "minute")


@query(oracle("OBS", _PRESENCE.format(gap=3) + """, t AS (SELECT end_ts AS ts FROM s WHERE present>0 AND closed=1 AND direction='rear'),
x AS (SELECT o.frame_no, count(t.ts) AS pass_no FROM f_obs o LEFT JOIN t ON t.ts<o.ts WHERE o.direction='front' GROUP BY o.frame_no) SELECT frame_no, pass_no FROM x"""))
def assigned_passes(spark, sf_dir):
    obs = fixture(spark, sf_dir, "OBS")
    ends = P.segment_presence(obs.filter("direction = 'rear'"), gap=3).select(F.col("end_ts").alias("ts"))
    return P.assign_pass(obs.filter("direction = 'front'").select("ts", "frame_no"), ends).select("frame_no", "pass_no")


_PASS = _SEG + """, d AS (SELECT direction AS channel, row_number() OVER (PARTITION BY direction ORDER BY seg) AS pass_no, start_ts AS ts, seg, present FROM s WHERE entered=1 AND closed=1)"""


@query(oracle("OBS", _PASS + """, n AS (SELECT *, strftime(ts,'%y%m%d') AS day, strftime(ts,'%H%M%S') AS clock FROM d),
e AS (SELECT channel, day, max(pass_no) AS last FROM n WHERE pass_no%4=0 GROUP BY channel, day),
m AS (SELECT n.*, row_number() OVER (PARTITION BY n.channel, n.day ORDER BY ts, pass_no) AS k FROM n WHERE pass_no%4<>0)
SELECT m.channel, m.day, m.clock, m.pass_no, 'V'||CASE WHEN k+coalesce(last,0)<10000 THEN lpad(CAST(k+coalesce(last,0) AS VARCHAR),4,'0') ELSE CAST(k+coalesce(last,0) AS VARCHAR) END AS vehicle FROM m LEFT JOIN e ON e.channel=m.channel AND e.day=m.day"""))
def vehicle_numbers(spark, sf_dir):
    p = P.archive_keys(P.passes(fixture(spark, sf_dir, "OBS")).select(F.col("direction").alias("channel"), "pass_no", F.col("start_ts").alias("ts")))
    old = p.filter("pass_no % 4 = 0").select("channel", "day", P.vehicle_name(F.col("pass_no")).alias("vehicle"))
    return P.number_vehicles(p.filter("pass_no % 4 <> 0"), old).select("channel", "day", "clock", "pass_no", "vehicle")


@query(oracle("OBS", """, h AS (SELECT DISTINCT date_trunc('hour',ts) AS hour, direction AS kind FROM f_obs WHERE state='present')
SELECT hour FROM h WHERE kind IN ('left','right','top') GROUP BY hour HAVING count(DISTINCT kind)=3"""))
def complete_records(spark, sf_dir):
    parts = fixture(spark, sf_dir, "OBS").filter("state = 'present'").select(F.date_trunc("hour", "ts").alias("hour"), F.col("direction").alias("kind"))
    return P.complete_only(parts, ["hour"], ["left", "right", "top"])


@query(oracle("OBS", _ISLANDS.replace("state<>'skipped'", "true").replace("lag(state)", "lag(ok)").replace("=state THEN", "=ok THEN").replace("SELECT * FROM f_obs", "SELECT direction, ts, frame_no, CASE WHEN state='present' THEN 1 ELSE 0 END AS ok FROM f_obs") + " SELECT direction, ts, frame_no, pos//5 AS nth FROM p WHERE ok=0 AND pos%5=0"))
def stream_outages(spark, sf_dir):
    reads = fixture(spark, sf_dir, "OBS").withColumn("ok", F.when(F.col("state") == "present", 1).otherwise(0))
    return P.outages(reads, 5)


_SIDE = _ISLANDS + """, e AS (SELECT *, CASE WHEN state='present' AND pos={enter} THEN 1 ELSE 0 END AS fin FROM p),
st AS (SELECT *, coalesce(sum(fin) OVER (PARTITION BY direction ORDER BY ts,frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS stretch FROM e),
t0 AS (SELECT direction, min(ts) AS t0, bool_or(state='present') AS seen FROM f_obs GROUP BY direction),
se AS (SELECT st.direction, stretch, fin, seen, CASE WHEN state='empty' AND pos>=3 THEN round(epoch_us(ts)/1e6-epoch_us(t0)/1e6,2) END AS s FROM st JOIN t0 USING (direction)),
w AS (SELECT direction, stretch, seen, max(fin) AS ended, min(s) AS low, max(s) AS high FROM se GROUP BY ALL HAVING min(s) IS NOT NULL),
b AS (SELECT direction, stretch, unnest(CASE WHEN NOT seen THEN [0,high] WHEN ended=1 THEN [low] ELSE [high] END) AS t FROM w)"""


@query(oracle("OBS", _SIDE.format(enter=10) + " SELECT direction, row_number() OVER (PARTITION BY direction ORDER BY stretch, t) AS n, t FROM b"))
def side_boundaries(spark, sf_dir):
    return P.boundaries_side(fixture(spark, sf_dir, "OBS"))


_KEPT = _SIDE.format(enter=4) + """, q AS (SELECT direction, t, row_number() OVER (PARTITION BY direction ORDER BY t) AS k FROM b),
z AS (SELECT direction, t, k, t AS last, 1 AS kept FROM q WHERE k=1 UNION ALL
 SELECT q.direction, q.t, q.k, CASE WHEN q.t-z.last> 20000 THEN q.t ELSE z.last END, CASE WHEN q.t-z.last> 20000 THEN 1 ELSE 0 END FROM z JOIN q ON q.direction=z.direction AND q.k=z.k+1),
y AS (SELECT direction, t, row_number() OVER (PARTITION BY direction ORDER BY t)-1 AS n FROM z WHERE kept=1)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH f_", "WITH RECURSIVE f_", 1)


def _kept(spark, sf_dir):
    side = P.boundaries_side(fixture(spark, sf_dir, "OBS"), enter=4)
    return P.suppress_adjacent(side, "direction", least=20000.0)


@query(_recursive(oracle("OBS", _KEPT + " SELECT direction, CAST(n AS INT) AS n, t FROM y")))
def suppressed_boundaries(spark, sf_dir):
    return _kept(spark, sf_dir)


@query(_recursive(oracle("OBS", _KEPT + """, cc AS (SELECT direction, count(*) AS k FROM y GROUP BY direction)
SELECT 'all' AS recording, max_by(direction,(-k,direction)) AS direction, min(k) AS k, count(DISTINCT k)=1 AS all_equal FROM cc""")))
def chosen_timeline(spark, sf_dir):
    return P.choose_timeline(_kept(spark, sf_dir).withColumn("recording", F.lit("all")), ["recording"])


_CLIPS = _KEPT + """, l AS (SELECT direction, t, lead(t) OVER (PARTITION BY direction ORDER BY t) AS nt, row_number() OVER (PARTITION BY direction ORDER BY t) AS clip FROM y),
pl AS (SELECT direction, clip, CAST(trunc(CASE WHEN t-8>0 THEN t-8 ELSE t END) AS INT) AS "begin", CAST(trunc(nt+3) AS INT) AS "end" FROM l WHERE nt IS NOT NULL)"""


@query(_recursive(oracle("OBS", _CLIPS + " SELECT * FROM pl")))
def clip_plan(spark, sf_dir):
    return P.clip_plan(_kept(spark, sf_dir), "direction")


@query(_recursive(oracle("OBS", _CLIPS + """, a AS (SELECT f.*, epoch_us(ts)/1e6-epoch_us(t0)/1e6 AS s FROM f_obs f JOIN t0 USING (direction))
SELECT a.direction, clip, count(*) AS frames, min(frame_no) AS first_frame, max(frame_no) AS last_frame FROM a JOIN pl ON pl.direction=a.direction AND s BETWEEN pl."begin" AND pl."end" GROUP BY ALL""")))
def clip_frames(spark, sf_dir):
    obs = fixture(spark, sf_dir, "OBS")
    start = obs.groupBy("direction").agg(F.min("ts").alias("t0"))
    second = P.micros(F.col("ts")) / 1e6 - P.micros(F.col("t0")) / 1e6
    rows = P.clip_rows(obs.join(start, "direction"), P.clip_plan(_kept(spark, sf_dir), "direction"), "direction", second, bucket=3600)
    return rows.groupBy("direction", "clip").agg(F.count("*").alias("frames"), F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"))


@query(oracle("OBS", """ SELECT dir, name, mtime FROM (SELECT direction AS dir, frame_no AS name, ts AS mtime, row_number() OVER (PARTITION BY direction ORDER BY ts DESC, frame_no) AS r FROM f_obs) t WHERE r>20"""))
def retention_list(spark, sf_dir):
    return P.retention(fixture(spark, sf_dir, "OBS").select(F.col("direction").alias("dir"), F.col("frame_no").alias("name"), F.col("ts").alias("mtime")))


@query(oracle("OBS", " SELECT direction, count(*) AS frames, CAST(count(*) AS DOUBLE)/25 AS seconds FROM f_obs GROUP BY direction"))
def recording_durations(spark, sf_dir):
    return P.recording_durations(fixture(spark, sf_dir, "OBS"))


@query(oracle("OBS", _PRESENCE.format(gap=7) + " SELECT direction, seg, present, start_ts, end_ts FROM s WHERE present>0 AND closed=1"))
def idle_segments(spark, sf_dir):
    return P.segment_idle(fixture(spark, sf_dir, "OBS"))


def _renamed(sql: str, mark: str) -> str:
    """The common table expressions of sql under names of their own, over the lanes' streams."""
    names = [n for n in ("o", "r", "i", "p", "c", "g", "s") if f"{n} AS (" in sql]
    for n in names:
        sql = re.sub(rf"(?<![a-z_.]){n} AS \(", f"{mark}{n} AS (", sql)
        sql = re.sub(rf"(FROM|JOIN) {n}(?![a-z_0-9])", rf"\1 {mark}{n}", sql)
    return sql.replace("f_obs f LEFT JOIN", "f_lane f LEFT JOIN").replace("FROM f_obs", "FROM f_lane").replace(f"JOIN {mark}p ON p.", f"JOIN {mark}p p ON p.")


_LANES = ", f_lane AS (SELECT lane||'/'||direction AS direction, ts, frame_no, state FROM f_obs)" + _renamed(_SEG, "x") + _renamed(_PRESENCE.format(gap=3), "z") + """,
sides AS (SELECT split_part(direction,'/',1) AS lane, split_part(direction,'/',2) AS side, row_number() OVER (PARTITION BY direction ORDER BY seg) AS pass_no, seg, start_ts, end_ts FROM xs WHERE entered=1 AND closed=1),
faces AS (SELECT split_part(direction,'/',1) AS lane, split_part(direction,'/',2) AS face, seg, start_ts, end_ts FROM zs WHERE present>0 AND closed=1)"""


def _lanes(spark, sf_dir):
    """Passes of the side cameras and of the face cameras of each lane, whose streams are apart."""
    obs = fixture(spark, sf_dir, "OBS").withColumn("direction", F.concat_ws("/", "lane", "direction"))
    apart = lambda df: df.withColumn("lane", F.split("direction", "/")[0]).withColumn("direction", F.split("direction", "/")[1])
    # Few rows that several joins read: made once.
    return cut(apart(P.passes(obs))), cut(apart(P.segment_presence(obs, gap=3)))


@query(oracle("OBS", _LANES + """ SELECT a.lane, a.side, a.pass_no, b.face, b.seg AS face_seg FROM sides a JOIN faces b ON a.lane=b.lane AND a.start_ts<=b.end_ts AND b.start_ts<=a.end_ts WHERE a.side IN ('left','right','top') AND b.face IN ('front','rear')"""))
def fused_passes(spark, sf_dir):
    sides, faces = _lanes(spark, sf_dir)
    return P.fuse_passes(sides.filter("direction IN ('left','right','top')"), faces.filter("direction IN ('front','rear')"))


def _attached(name: str, source: str, column: str, where: str) -> str:
    return f""", {name} AS (SELECT lane, pass_no, v FROM (SELECT a.lane, a.pass_no, {column} AS v, row_number() OVER (PARTITION BY a.lane, a.pass_no ORDER BY least(a.end_ts,b.end_ts)-greatest(a.start_ts,b.start_ts) DESC, b.start_ts, {column} DESC) AS k
 FROM anc a JOIN {source} b ON a.lane=b.lane AND a.start_ts<=b.end_ts AND b.start_ts<=a.end_ts WHERE {where}) t WHERE k=1)"""


_CODE, _PLATE = "'ABCU'||lpad(CAST(seg AS {STR}),7,'0')", "'冀A'||lpad(CAST(seg AS {STR}),5,'0')"
_VIEWS = {"left": ("sides", "side"), "right": ("sides", "side"), "front": ("faces", "face"), "rear": ("faces", "face")}


#: Readings have times of their own: they begin and end some time after the pass that they were made from, and some passes have none.
_READ_AT = ", rdc AS (SELECT lane, face, seg, start_ts + INTERVAL 40 MINUTE AS start_ts, end_ts + INTERVAL 25 MINUTE AS end_ts FROM faces WHERE seg%5<>0 AND start_ts + INTERVAL 40 MINUTE <= end_ts + INTERVAL 25 MINUTE)"


@query(oracle("OBS", _LANES + _READ_AT + ", anc AS (SELECT * FROM sides WHERE side='top')" + "".join(_attached(f"a_{v}", t, "b.seg", f"b.{c}='{v}'") for v, (t, c) in _VIEWS.items())
  + _attached("a_code", "rdc", _CODE.format(STR="VARCHAR").replace("seg", "b.seg"), "b.face='rear'") + _attached("a_plate", "rdc", _PLATE.format(STR="VARCHAR").replace("seg", "b.seg"), "b.face='front'") + """
SELECT anc.lane, anc.pass_no, l.v AS seg_left, r.v AS seg_right, f.v AS seg_front, e.v AS seg_rear, c.v AS code, p.v AS plate, l.v IS NOT NULL AND r.v IS NOT NULL AND f.v IS NOT NULL AND e.v IS NOT NULL AS complete
FROM anc LEFT JOIN a_left l USING (lane,pass_no) LEFT JOIN a_right r USING (lane,pass_no) LEFT JOIN a_front f USING (lane,pass_no) LEFT JOIN a_rear e USING (lane,pass_no) LEFT JOIN a_code c USING (lane,pass_no) LEFT JOIN a_plate p USING (lane,pass_no)"""))
def vehicle_records(spark, sf_dir):
    sides, faces = _lanes(spark, sf_dir)
    part = lambda df, v: df.filter(F.col("direction") == v).select("lane", "start_ts", "end_ts", "seg")
    views = {v: part(sides if t == "sides" else faces, v) for v, (t, _) in _VIEWS.items()}
    later = lambda df: df.filter("seg % 5 <> 0").withColumns({"start_ts": F.expr("start_ts + interval 40 minutes"), "end_ts": F.expr("end_ts + interval 25 minutes")}).filter("start_ts <= end_ts")
    read = {"ocr": (later(views["rear"]).withColumn("code", F.expr(_CODE.format(STR="STRING"))), ["code"]), "plate": (later(views["front"]).withColumn("plate", F.expr(_PLATE.format(STR="STRING"))), ["plate"])}
    anchors = sides.filter("direction = 'top'").select("lane", "pass_no", "start_ts", "end_ts")
    return P.vehicle_records(anchors, views, read).drop("start_ts", "end_ts")


@query(oracle("OBS", """, k AS (SELECT lane, frame_no, ts, date_trunc('day',ts) AS day, count(*) FILTER (direction='front' AND state='empty') OVER (PARTITION BY lane ORDER BY ts,frame_no ROWS UNBOUNDED PRECEDING) AS epoch FROM f_obs),
m AS (SELECT lane, day, max(epoch) AS last FROM k GROUP BY lane, day) SELECT k.lane, k.frame_no, epoch FROM k JOIN m ON m.lane=k.lane AND m.day=k.day WHERE epoch=last"""))
def fresh_artifacts(spark, sf_dir):
    obs = fixture(spark, sf_dir, "OBS").withColumn("day", F.date_trunc("day", "ts"))
    close = (F.col("direction") == "front") & (F.col("state") == "empty")
    return P.reset_on_front(obs, close, ["lane", "day"], "lane").select("lane", "frame_no", "epoch")


_DX = ", v AS (SELECT *, x2-x1 AS dx, y2-y1 AS dy FROM f_match), n AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY dx, dy)-1 AS k, count(*) OVER (PARTITION BY pair_id) AS n FROM v), mu AS (SELECT pair_id, avg(dx) AS mu FROM n WHERE k>=floor(n*0.2) AND k<floor(n*0.8) GROUP BY pair_id)"
_OK = {"right": "dx>mu AND dy<10", "left": "dx<-1", "top": "dx<-10 AND dy<10"}
_OFFSETS = _DX + "".join(
    f""", g_{v} AS (SELECT v.*, row_number() OVER (PARTITION BY v.pair_id ORDER BY dx, dy)-1 AS k, count(*) OVER (PARTITION BY v.pair_id) AS n FROM v LEFT JOIN mu ON mu.pair_id=v.pair_id WHERE {c}),
h_{v} AS (SELECT pair_id, CAST(round_even(abs(avg(dx)),0) AS BIGINT) AS o FROM g_{v} WHERE n<=3 OR (k>=floor(n*0.25) AND k<floor(n*0.75)) GROUP BY pair_id)""" for v, c in _OK.items()
) + ", all_o AS (" + " UNION ALL ".join(f"SELECT '{v}' AS view, p.pair_id, coalesce(o,0) AS \"offset\" FROM (SELECT DISTINCT pair_id FROM f_match) p LEFT JOIN h_{v} h ON h.pair_id=p.pair_id" for v in _OK) + ")"


def _offsets(spark, sf_dir):
    m = fixture(spark, sf_dir, "MATCH")
    out = None
    for v in P.MOVES:
        part = P.pair_offsets(m, v, ["pair_id"]).select(F.lit(v).alias("view"), "pair_id", "offset")
        out = part if out is None else out.unionByName(part)
    return out


@query(oracle("MATCH", _OFFSETS + " SELECT * FROM all_o"))
def panorama_offsets(spark, sf_dir):
    return _offsets(spark, sf_dir)


@query(oracle("MATCH", _OFFSETS + """, pa AS (SELECT view||'/'||CAST(pair_id//200 AS VARCHAR) AS panorama, pair_id%200//20 AS place, "offset" AS o FROM all_o),
u AS (SELECT panorama, place, CASE WHEN o>1 THEN o ELSE coalesce(CAST(trunc(avg(nullif(o,0)) OVER (PARTITION BY panorama)) AS BIGINT),0) END AS used FROM pa),
x AS (SELECT *, sum(used) OVER (PARTITION BY panorama ORDER BY place ROWS UNBOUNDED PRECEDING) AS x FROM u WHERE place>=1)
SELECT panorama, place, used, CAST(x AS BIGINT) AS x, CAST(max(x) OVER (PARTITION BY panorama)+640 AS BIGINT) AS total FROM x"""))
def panorama_plan(spark, sf_dir):
    o = _offsets(spark, sf_dir).select(F.concat_ws("/", "view", F.expr("pair_id div 200")).alias("panorama"), F.expr("pair_id % 200 div 20").alias("place"), "offset")
    return P.stitch_plan(o, "panorama", "place", 640)
