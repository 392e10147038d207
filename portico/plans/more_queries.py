"""Further queries: face timelines, best frames, polygons, review tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes as B
from ..operators import datasets as D
from ..operators import evaluate as E
from ..operators import passes as P
from .fixtures import fixture, oracle
from .pass_queries import _PRESENCE
from .registry import query


@query(oracle("OBS", _PRESENCE.format(gap=3).split(", s AS", 1)[0].rsplit(",\ns AS", 1)[0] + """,
t0 AS (SELECT direction, min(ts) AS t0 FROM f_obs GROUP BY direction),
q AS (SELECT direction, seg, min(round(epoch_us(ts)/1e6-epoch_us(t0)/1e6,2)) FILTER (state='empty') AS low, max(round(epoch_us(ts)/1e6-epoch_us(t0)/1e6,2)) FILTER (state='empty') AS high, max(is_close) AS closed, count(*) FILTER (state='present') AS present FROM g JOIN t0 USING (direction) GROUP BY direction, seg),
k AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY seg) AS n FROM q WHERE closed=1 AND present>0) SELECT direction, n, CASE WHEN n=1 THEN low ELSE high END AS t FROM k"""))
def face_boundaries(spark, sf_dir):
    return P.boundaries_face(fixture(spark, sf_dir, "OBS"), 3)


@query(oracle("READ", """, p AS (SELECT pass_id%200 AS video, pass_id AS frame, count(*) AS n, avg(score) AS mean FROM f_read GROUP BY ALL)
SELECT video, frame, n, round(mean,6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY n DESC, round(mean,9) DESC, frame) AS r FROM p) t WHERE r=1"""))
def best_frames(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ").select((F.col("pass_id") % 200).alias("video"), F.col("pass_id").alias("frame"), "score")
    return P.best_reading_frame(r, "video", "frame").withColumn("mean", F.round("mean", 6))


@query(oracle("READ", """, c AS (SELECT *, count(*) OVER (PARTITION BY pass_id) AS n FROM f_read), f AS (SELECT * FROM c WHERE n=1 OR (text<>'' AND size_text<>'')), m AS (SELECT *, count(*) OVER (PARTITION BY pass_id) AS m FROM f)
SELECT pass_id, text, size_text, min(seq) AS seq FROM m GROUP BY pass_id, text, size_text, CASE WHEN m>2 THEN 0 ELSE seq END"""))
def final_pairs(spark, sf_dir):
    return P.final_pairs(fixture(spark, sf_dir, "READ").select("pass_id", "seq", "text", "size_text"), "pass_id", "text", "size_text", "seq")


def _quads(spark, sf_dir):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return fixture(spark, sf_dir, "BOX").select("det_id", F.when(F.col("det_id") % 2 == 0, F.array(p("x2", "y1"), p("x1", "y2"), p("x1", "y1"), p("x2", "y2"))).otherwise(F.array(p("x1", "y1"), p("x2", "y1"), p("x2", "y2"), p("x1", "y2"))).alias("points"))


@query(oracle("BOX", """, c AS (SELECT det_id, least(greatest(x1,0),1279) AS x1, least(greatest(y1,0),959) AS y1, least(greatest(x2,0),1279) AS x2, least(greatest(y2,0),959) AS y2 FROM f_box)
SELECT det_id, round(x1,6) AS ax, round(y1,6) AS ay, round(x2,6) AS bx, round(y1,6) AS "by", round(x2,6) AS cx, round(y2,6) AS cy, round(x1,6) AS dx, round(y2,6) AS dy FROM c WHERE x2-x1>3 AND y2-y1>3"""))
def ordered_quads(spark, sf_dir):
    q = B.order_quads(_quads(spark, sf_dir), 1280.0, 960.0)
    return q.select("det_id", *[F.round(F.col("quad")[i][c], 6).alias("abcd"[i] + c) for i in range(4) for c in ("x", "y")])


@query(oracle("BOX", """, p AS (SELECT det_id, [x1,x2] AS xs, [y1,y2] AS ys FROM f_box), c AS (SELECT det_id, unnest(xs) AS x, ys FROM p), d AS (SELECT det_id, x, unnest(ys) AS y FROM c), i AS (SELECT * FROM d WHERE x BETWEEN 0 AND 640 AND y BETWEEN 0 AND 480)
SELECT b.det_id, round(coalesce(min(i.x),0),6) AS x1, round(coalesce(min(i.y),0),6) AS y1, round(coalesce(max(i.x),0),6) AS x2, round(coalesce(max(i.y),0),6) AS y2 FROM f_box b LEFT JOIN i ON i.det_id=b.det_id GROUP BY b.det_id"""))
def polygon_boxes(spark, sf_dir):
    return B.segment_boxes(_quads(spark, sf_dir), 640.0, 480.0).select("det_id", *[F.round(c, 6).alias(c) for c in B.CORNERS])


# Nine points are the four corners, the middles of the sides and the first corner again.
@query(oracle("BOX", """, q AS (SELECT det_id, CASE WHEN det_id%2=0 THEN [x2,x1,x1,x2] ELSE [x1,x2,x2,x1] END AS xs, CASE WHEN det_id%2=0 THEN [y1,y2,y1,y2] ELSE [y1,y1,y2,y2] END AS ys FROM f_box)
SELECT det_id, round((xs[1]+xs[2])/2,6) AS x1, round((ys[1]+ys[2])/2,6) AS y1, round(xs[3],6) AS x4, round(ys[3],6) AS y4 FROM q"""))
def resampled_polygons(spark, sf_dir):
    r = B.resample_polygon(_quads(spark, sf_dir), 9)
    return r.select("det_id", *[F.round(F.col("resampled")[i][c], 6).alias(f"{c}{i}") for i in (1, 4) for c in ("x", "y")])


@query(oracle("READ", """ SELECT pass_id, seq, ignore, text FROM (SELECT pass_id, seq, seq%5=0 AS ignore, CASE WHEN seq%5=0 THEN '###' ELSE substr(text,1,4)||' '||substr(text,5) END AS text FROM f_read) t"""))
def converted_labels(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ").select("pass_id", "seq", F.expr("case when seq%5=0 then '###' else concat(substr(text,1,4), '　', substr(text,5)) end").alias("transcription"), F.col("score").cast("string").alias("score"))
    return E.convert_labels(r, True).select("pass_id", "seq", "ignore", "text")


@query(oracle("READ", """ SELECT pass_id, seq, false AS ignore, text FROM (SELECT pass_id, seq, CASE WHEN seq%5=0 THEN '###' ELSE substr(text,1,4)||' '||substr(text,5) END AS text, CASE WHEN seq%7=0 THEN NULL ELSE (pass_id*seq)%100/100 END AS s FROM f_read) t WHERE coalesce(s,1)>=0.5"""))
def converted_predictions(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ").selectExpr("pass_id", "seq", "case when seq%5=0 then '###' else concat(substr(text,1,4), '　', substr(text,5)) end as transcription", "case when seq%7=0 then '' else cast((pass_id*seq)%100/100 as string) end as score")
    return E.convert_labels(r, False).select("pass_id", "seq", "ignore", "text")


@query(oracle("READ", """, v AS (SELECT pass_id, list(seq ORDER BY seq) AS paths FROM f_read GROUP BY pass_id)
SELECT pass_id, paths[CAST(floor(('0x'||substr(md5('0:'||pass_id),1,12))::BIGINT/281474976710656.0*len(paths)) AS INT)+1] AS path FROM v"""))
def chosen_variants(spark, sf_dir):
    v = fixture(spark, sf_dir, "READ").groupBy("pass_id").agg(F.array_sort(F.collect_list("seq")).alias("paths"))
    return D.choose_variant(v, "paths", "pass_id").select("pass_id", "path")


@query(oracle("LABEL", """, n(cls,name) AS (VALUES (0,'car'),(1,'bus'),(2,'truck'),(3,'van')), b AS (SELECT image_path, line_no, l.cls, name, CAST(round((xc-w/2)*1280) AS INT) AS x1, CAST(round((yc-h/2)*960) AS INT) AS y1, CAST(round((xc+w/2)*1280) AS INT) AS x2, CAST(round((yc+h/2)*960) AS INT) AS y2 FROM f_label l JOIN n ON n.cls=l.cls)
SELECT image_path, (SELECT string_agg(cls||':'||name, ',' ORDER BY cls) FROM (SELECT DISTINCT cls, name FROM b c WHERE c.image_path=b.image_path) d) AS classes, string_agg(cls||' '||x1||' '||y1||' '||x2||' '||y2, ';' ORDER BY line_no) AS boxes FROM b GROUP BY image_path"""))
def review_tables(spark, sf_dir):
    t = D.review_table(fixture(spark, sf_dir, "LABEL"), {0: "car", 1: "bus", 2: "truck", 3: "van"}, 1280, 960)
    classes = F.array_join(F.transform(F.array_sort(F.map_entries("classes")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"])), ",")
    boxes = F.array_join(F.transform("boxes", lambda b: F.concat_ws(" ", *[b[c].cast("string") for c in ("cls", "x1", "y1", "x2", "y2")])), ";")
    return t.select("image_path", classes.alias("classes"), boxes.alias("boxes"))
