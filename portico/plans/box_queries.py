"""Queries over boxes and over quality scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes as B
from ..operators import evaluate as E
from ..operators import quads as Q
from .fixtures import fixture, oracle
from .registry import query

_R = lambda *cs: ", ".join(f"round({c},6) AS {c.split('.')[-1]}" for c in cs)


def _round(df, *cs):
    return df.withColumns({c: F.round(c, 6) for c in cs})


@query(oracle("BOX", f""", b AS (SELECT *, (x1+x2)/2 AS xc, (y1+y2)/2 AS yc, x2-x1 AS w, y2-y1 AS h FROM f_box),
n AS (SELECT *, xc/1280 AS nx, yc/960 AS ny, w/1280 AS nw, h/960 AS nh FROM b)
SELECT det_id, {_R('xc', 'yc', 'w', 'h', 'nx', 'ny', 'nw', 'nh')}, round(1280*(nx-nw/2)+4,6) AS x1, round(960*(ny-nh/2)+8,6) AS y1, round(1280*(nx+nw/2)+4,6) AS x2, round(960*(ny+nh/2)+8,6) AS y2 FROM n"""))
def box_forms(spark, sf_dir):
    b = B.to_xywh(fixture(spark, sf_dir, "BOX"))
    n = B.normalize(b.select("det_id", "xc", "yc", "w", "h"), 1280, 960)
    p = B.denormalize(n, 1280, 960, 4, 8).select("det_id", F.col("xc").alias("nx"), F.col("yc").alias("ny"), F.col("w").alias("nw"), F.col("h").alias("nh"), *B.CORNERS)
    return _round(b.select("det_id", "xc", "yc", "w", "h").join(p, "det_id"), "xc", "yc", "w", "h", "nx", "ny", "nw", "nh", *B.CORNERS)


@query(oracle("BOX", """, c AS (SELECT det_id, least(greatest((x1-0)/0.5,0),1280) AS x1, least(greatest((y1-80)/0.5,0),960) AS y1, least(greatest((x2-0)/0.5,0),1280) AS x2, least(greatest((y2-80)/0.5,0),960) AS y2 FROM f_box)
SELECT det_id, round(x1) AS x1, round(y1) AS y1, round(x2) AS x2, round(y2) AS y2 FROM c"""))
def letterbox_undo(spark, sf_dir):
    return B.unletterbox(fixture(spark, sf_dir, "BOX"), 1280, 960).select("det_id", *B.CORNERS)


@query(oracle("BOX", """, d AS (SELECT det_id, x2-x1 AS w, y2-y1 AS h, least(640/(x2-x1),640/(y2-y1)) AS ratio FROM f_box), n AS (SELECT *, round(w*ratio) AS new_w, round(h*ratio) AS new_h FROM d)
SELECT det_id, round(ratio,6) AS ratio, new_w, new_h, (640-new_w)/2 AS pad_w, (640-new_h)/2 AS pad_h, (640-new_w)%32/2 AS auto_w, (640-new_h)%32/2 AS auto_h FROM n"""))
def letterbox_plan(spark, sf_dir):
    b = B.to_xywh(fixture(spark, sf_dir, "BOX"))
    return _round(b.select("det_id", *[v.alias(k) for k, v in B.letterbox_plan(F.col("w"), F.col("h")).items()]), "ratio")


_PAIR = """, p AS (SELECT a.image_id, a.det_id AS a_id, b.det_id AS b_id, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
 FROM f_box a JOIN f_gt b ON a.image_id=b.image_id AND a.x1<b.x2 AND b.x1<a.x2 AND a.y1<b.y2 AND b.y1<a.y2),
q AS (SELECT *, (least(ax2,bx2)-greatest(ax1,bx1))*(least(ay2,by2)-greatest(ay1,by1)) AS i, greatest(ax2,bx2)-least(ax1,bx1) AS cw, greatest(ay2,by2)-least(ay1,by1) AS ch,
 ((bx1+bx2-ax1-ax2)**2+(by1+by2-ay1-ay2)**2)/4 AS d2, 4/pi()**2*(atan((bx2-bx1)/(by2-by1+1e-7))-atan((ax2-ax1)/(ay2-ay1+1e-7)))**2 AS v FROM p),
u AS (SELECT *, i/((ax2-ax1)*(ay2-ay1)+(bx2-bx1)*(by2-by1)-i+1e-7) AS iou, (ax2-ax1)*(ay2-ay1)+(bx2-bx1)*(by2-by1)-i+1e-7 AS uni FROM q)"""


@query(oracle("BOX GT", _PAIR + """ SELECT image_id, a_id, b_id, round(iou,6) AS iou, round(iou-(cw*ch+1e-7-uni)/(cw*ch+1e-7),6) AS giou, round(iou-d2/(cw*cw+ch*ch+1e-7),6) AS diou,
 round(iou-(d2/(cw*cw+ch*ch+1e-7)+v*v/(v-iou+1+1e-7)),6) AS ciou,
 round(i/((bx2-bx1)*(by2-by1)+1e-7),6) AS ioa, round(least(ax2-ax1,bx2-bx1)*least(ay2-ay1,by2-by1)/((ax2-ax1)*(ay2-ay1)+(bx2-bx1)*(by2-by1)-least(ax2-ax1,bx2-bx1)*least(ay2-ay1,by2-by1)+1e-7),6) AS wh_iou FROM u"""))
def iou_pairs(spark, sf_dir):
    pairs = B.overlap_join(fixture(spark, sf_dir, "BOX"), fixture(spark, sf_dir, "GT"), ("det_id",), ("det_id",))
    return _round(pairs.select("image_id", F.col("a_det_id").alias("a_id"), F.col("b_det_id").alias("b_id"), *[B.iou(k).alias(k) for k in ("iou", "giou", "diou", "ciou")], B.ioa().alias("ioa"), B.wh_iou().alias("wh_iou")), "iou", "giou", "diou", "ciou", "ioa", "wh_iou")


_NMS = """, c AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY conf DESC, det_id) AS k FROM f_box WHERE conf>0.25),
pr AS (SELECT a.image_id, a.cls, a.k AS hi, b.k AS lo, (least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1)) AS i, (a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1) AS s
 FROM c a JOIN c b ON a.image_id=b.image_id AND a.cls=b.cls AND a.k<b.k AND a.x1<b.x2 AND b.x1<a.x2 AND a.y1<b.y2 AND b.y1<a.y2),
bad AS (SELECT image_id, cls, lo, list(hi) AS his FROM pr WHERE i/(s-i)>0.45 GROUP BY ALL),
w AS (SELECT image_id, cls, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT image_id, cls FROM c) z UNION ALL
 SELECT w.image_id, w.cls, c.k, CASE WHEN list_has_any(w.kept, coalesce(bad.his,[])) THEN w.kept ELSE list_append(w.kept, c.k) END
 FROM w JOIN c ON c.image_id=w.image_id AND c.cls=w.cls AND c.k=w.k+1 LEFT JOIN bad ON bad.image_id=c.image_id AND bad.cls=c.cls AND bad.lo=c.k),
kp AS (SELECT image_id, cls, max_by(kept,k) AS kept FROM w GROUP BY image_id, cls)"""


@query(oracle("BOX", _NMS + " SELECT c.image_id, c.cls, c.det_id FROM c JOIN kp ON kp.image_id=c.image_id AND kp.cls=c.cls WHERE list_contains(kp.kept, c.k)").replace("WITH ", "WITH RECURSIVE ", 1))
def suppressed_boxes(spark, sf_dir):
    return B.nms(fixture(spark, sf_dir, "BOX")).select("image_id", "cls", "det_id")


@query(oracle("BOX", " SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY y1, x1, det_id) AS place, row_number() OVER (PARTITION BY image_id ORDER BY y1, det_id) AS by_top, row_number() OVER (PARTITION BY image_id ORDER BY y1+y2, det_id) AS by_middle FROM f_box"))
def box_reading_order(spark, sf_dir):
    b = fixture(spark, sf_dir, "BOX")
    for name, by in (("by_top", "y"), ("by_middle", "sum")):
        b = B.reading_order(b, by).withColumnRenamed("place", name)
    return B.reading_order(b).select("image_id", "det_id", "place", "by_top", "by_middle")


_CROP = "CAST(floor(least(greatest({c}{d},0),{m})) AS INT)"


@query(oracle("BOX", """, c AS (SELECT det_id, CAST(floor(least(greatest(x1-10,0),1280)) AS INT) AS x1, CAST(floor(least(greatest(y1-10,0),960)) AS INT) AS y1, CAST(floor(least(greatest(x2+10,0),1280)) AS INT) AS x2, CAST(floor(least(greatest(y2+10,0),960)) AS INT) AS y2 FROM f_box)
SELECT *, y2-y1>x2-x1 AS turn FROM c"""))
def crop_plans(spark, sf_dir):
    return B.crop_plan(fixture(spark, sf_dir, "BOX"), 1280, 960).select("det_id", *B.CORNERS, "turn")


@query(oracle("BOX", """, b AS (SELECT *, (x1+x2)/2 AS xc, (y1+y2)/2 AS yc, (x2-x1)*1.2+3 AS w, (y2-y1)*1.2+3 AS h FROM f_box)
SELECT det_id, CAST(floor(least(greatest(xc-w/2,0),1280)) AS INT) AS x1, CAST(floor(least(greatest(yc-h/2,0),960)) AS INT) AS y1, CAST(floor(least(greatest(xc+w/2,0),1280)) AS INT) AS x2, CAST(floor(least(greatest(yc+h/2,0),960)) AS INT) AS y2,
 cls||'_'||image_id||'_'||(row_number() OVER (PARTITION BY image_id ORDER BY det_id)-1) AS name FROM b"""))
def object_crops(spark, sf_dir):
    return B.extract_plan(fixture(spark, sf_dir, "BOX"), 1280, 960).select("det_id", *B.CORNERS, "name")


@query(oracle("BOX GT", """ SELECT b.det_id, (g.x2-g.x1>2 AND g.y2-g.y1>2 AND (g.x2-g.x1)*(g.y2-g.y1)*(b.det_id%5)/4/((b.x2-b.x1)*(b.y2-b.y1)+1e-16)>0.3 AND greatest((g.x2-g.x1)/(g.y2-g.y1+1e-16),(g.y2-g.y1)/(g.x2-g.x1+1e-16))<100) AS kept, round(sqrt(((b.x1+b.x2)/2-640)**2+((b.y1+b.y2)/2-480)**2),6) AS distance,
 round(degrees(atan2((b.y1+b.y2)/2-480,(b.x1+b.x2)/2-640)),6) AS angle FROM f_box b JOIN f_gt g ON b.det_id=g.det_id""".replace("*(b.det_id%5)/4", "*1")))
def box_measures(spark, sf_dir):
    b, g = fixture(spark, sf_dir, "BOX"), fixture(spark, sf_dir, "GT")
    both = B.centre_distance(b, 640, 480).select("det_id", "distance", "angle", *[F.col(c).alias(f"a_{c}") for c in B.CORNERS]).join(g.select("det_id", *[F.col(c).alias(f"b_{c}") for c in B.CORNERS]), "det_id")
    return _round(both.select("det_id", B.box_survivors("a_", "b_", area=0.3).alias("kept"), "distance", "angle"), "distance", "angle")


@query(oracle("BOX", """, r(direction,r0,r1,c0,c1) AS (VALUES ('a',100,700,200,900),('b',0,500,0,640)), d AS (SELECT *, CASE WHEN det_id%2=0 THEN 'a' ELSE 'b' END AS direction FROM f_box)
SELECT d.direction, det_id, round(x1-c0,6) AS x1, round(y1-r0,6) AS y1, round(x2-c0,6) AS x2, round(y2-r0,6) AS y2 FROM d JOIN r ON d.direction=r.direction WHERE (y1+y2)/2>=r0 AND (y1+y2)/2<r1 AND (x1+x2)/2>=c0 AND (x1+x2)/2<c1"""))
def region_boxes(spark, sf_dir):
    d = fixture(spark, sf_dir, "BOX").withColumn("direction", F.when(F.col("det_id") % 2 == 0, "a").otherwise("b"))
    cams = spark.createDataFrame([("a", [100, 700, 200, 900]), ("b", [0, 500, 0, 640])], "direction string, roi array<int>")
    return _round(B.apply_roi(d, cams).select("direction", "det_id", *B.CORNERS), *B.CORNERS)


@query(oracle("BOX", """, s AS (SELECT *, least(greatest((x2-x1)*0.1,1),5) AS dx, least(greatest((y2-y1)*0.1,1),5) AS dy FROM f_box)
SELECT det_id, round(x1+dx,6) AS x1, round(y1+dy,6) AS y1, round(x2-dx,6) AS x2, round(y2-dy,6) AS y2 FROM s"""))
def shrunk_cells(spark, sf_dir):
    return _round(B.shrink_boxes(fixture(spark, sf_dir, "BOX")).select("det_id", *B.CORNERS), *B.CORNERS)


@query(oracle("BOX", """, k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS r FROM f_box)
SELECT image_id, det_id, cls, round((x1+x2)/2,6) AS xc, round((y1+y2)/2,6) AS yc, round(x2-x1,6) AS w, round(y2-y1,6) AS h, round(conf,6) AS conf FROM k WHERE r<=300"""))
def target_table(spark, sf_dir):
    return _round(B.to_targets(fixture(spark, sf_dir, "BOX")), "xc", "yc", "w", "h", "conf")


def _matched(spark, sf_dir):
    return E.greedy_match(E.candidate_matches(fixture(spark, sf_dir, "GT"), fixture(spark, sf_dir, "BOX"), 0.45))


_GREEDY = _PAIR + """, o AS (SELECT image_id, a_id AS det_id, b_id AS gt_id, iou, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, b_id, a_id) AS k FROM u WHERE iou>0.45),
gw AS (SELECT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ds, CAST([] AS BIGINT[]) AS gs, CAST([] AS BIGINT[]) AS ks FROM (SELECT DISTINCT image_id FROM o) z UNION ALL
 SELECT o.image_id, o.k, CASE WHEN hit THEN ds ELSE list_append(ds,det_id) END, CASE WHEN hit THEN gs ELSE list_append(gs,gt_id) END, CASE WHEN hit THEN ks ELSE list_append(ks,o.k) END
 FROM (SELECT gw.*, o.k AS nk, o.det_id AS nd, o.gt_id AS ng, list_contains(ds,o.det_id) OR list_contains(gs,o.gt_id) AS hit FROM gw JOIN o ON o.image_id=gw.image_id AND o.k=gw.k+1) y JOIN o ON o.image_id=y.image_id AND o.k=y.nk),
gm AS (SELECT o.image_id, o.gt_id, o.det_id, o.iou FROM o JOIN (SELECT image_id, max_by(ks,k) AS ks FROM gw GROUP BY image_id) f ON f.image_id=o.image_id WHERE list_contains(f.ks,o.k))"""


@query(oracle("BOX GT", _GREEDY + " SELECT image_id, gt_id, det_id, round(iou,6) AS iou FROM gm").replace("WITH ", "WITH RECURSIVE ", 1))
def matched_boxes(spark, sf_dir):
    return _round(_matched(spark, sf_dir).select("image_id", "gt_id", "det_id", "iou"), "iou")


_CONF = _GREEDY.replace("FROM f_box a JOIN", "FROM (SELECT * FROM f_box WHERE conf>0.25) a JOIN") + """, cf AS (SELECT pred, true_c AS "true", count(*) AS n FROM (
 SELECT b.cls AS pred, g.cls AS true_c FROM gm JOIN f_box b ON b.det_id=gm.det_id JOIN f_gt g ON g.det_id=gm.gt_id
 UNION ALL SELECT -1, cls FROM f_gt WHERE det_id NOT IN (SELECT gt_id FROM gm) UNION ALL SELECT cls, -1 FROM f_box WHERE conf>0.25 AND det_id NOT IN (SELECT det_id FROM gm)) x GROUP BY ALL)"""


@query(oracle("BOX GT", _CONF + """ SELECT CAST(pred AS BIGINT) AS pred, CAST("true" AS BIGINT) AS "true", n, round(CASE WHEN n/(sum(n) OVER (PARTITION BY "true")+1e-9)>=0.005 THEN n/(sum(n) OVER (PARTITION BY "true")+1e-9) END,6) AS share FROM cf""").replace("WITH ", "WITH RECURSIVE ", 1))
def confusion_matrix(spark, sf_dir):
    return _round(E.normalize_confusion(E.ranked_confusion(fixture(spark, sf_dir, "GT"), fixture(spark, sf_dir, "BOX"))), "share")


_AP = """c AS (SELECT fl.cls, row_number() OVER w AS k, sum(tp) OVER (w ROWS UNBOUNDED PRECEDING) AS tps, n FROM fl JOIN t ON t.cls=fl.cls WINDOW w AS (PARTITION BY fl.cls ORDER BY conf DESC, seq)),
e AS (SELECT cls, k, tps/n AS r, max(tps/k) OVER (PARTITION BY cls ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM c),
a AS (SELECT * FROM e UNION ALL SELECT cls, 0, 0, 1 FROM t UNION ALL SELECT cls, 1000000, 1, 0 FROM t),
x AS (SELECT cls, g, g/100 AS x FROM t, (SELECT unnest(range(101)) AS g) z),
l AS (SELECT x.cls, g, max_by((r,p),k) AS lp FROM x JOIN a ON a.cls=x.cls AND a.r<=x.x AND NOT (a.k=1000000) GROUP BY ALL),
h AS (SELECT x.cls, g, min_by((r,p),k) AS hp FROM x JOIN a ON a.cls=x.cls AND (a.r>x.x OR a.k=1000000) GROUP BY ALL),
y AS (SELECT x.cls, x.g, CASE WHEN hp[1]>lp[1] THEN lp[2]+(hp[2]-lp[2])*(x.x-lp[1])/(hp[1]-lp[1]) ELSE hp[2] END AS y FROM x JOIN l ON l.cls=x.cls AND l.g=x.g JOIN h ON h.cls=x.cls AND h.g=x.g),
ap AS (SELECT y.cls, sum(CASE WHEN g IN (0,100) THEN y/2 ELSE y END)/100 AS ap, m.recall FROM y JOIN (SELECT cls, max(r) AS recall FROM e GROUP BY cls) m ON m.cls=y.cls GROUP BY y.cls, m.recall)"""
_FLAGS = """, fl AS (SELECT cls, conf, det_id AS seq, CASE WHEN det_id%5<>0 AND det_id%7<>3 THEN 1 ELSE 0 END AS tp FROM f_box), t AS (SELECT cls, count(*) AS n FROM f_gt GROUP BY cls)"""


def _flags(spark, sf_dir):
    tp = F.when((F.col("det_id") % 5 != 0) & (F.col("det_id") % 7 != 3), 1).otherwise(0)
    flags = fixture(spark, sf_dir, "BOX").select("cls", "conf", F.col("det_id").alias("seq"), tp.alias("tp"))
    return flags, fixture(spark, sf_dir, "GT").groupBy("cls").agg(F.count("*").alias("n"))


@query(oracle("BOX GT", f"{_FLAGS}, {_AP} SELECT cls, round(ap,6) AS ap, round(recall,6) AS recall FROM ap"))
def average_precision(spark, sf_dir):
    return _round(E.average_precision(*_flags(spark, sf_dir)), "ap", "recall")


_SAME = _GREEDY.replace("b.det_id AS b_id, a.x1", "b.det_id AS b_id, a.cls AS a_cls, b.cls AS b_cls, a.x1").replace("FROM u WHERE iou>0.45", "FROM u WHERE iou>=0.5 AND a_cls=b_cls")


@query(oracle("BOX GT", _SAME + f""", z AS (SELECT unnest(range(10)) AS lv), fl AS (SELECT b.cls*10+lv AS cls, conf, b.det_id AS seq, CASE WHEN coalesce(gm.iou,0)>=0.5+lv*0.05-1e-9 THEN 1 ELSE 0 END AS tp FROM f_box b LEFT JOIN gm ON gm.det_id=b.det_id, z),
t AS (SELECT cls*10+lv AS cls, count(*) AS n FROM f_gt, z GROUP BY ALL), {_AP.replace("h AS (", "hh AS (").replace("JOIN h ON h.cls=x.cls AND h.g", "JOIN hh ON hh.cls=x.cls AND hh.g")}
SELECT CAST(cls//10 AS BIGINT) AS cls, round(max(ap) FILTER (cls%10=0),6) AS ap50, round(avg(ap),6) AS ap FROM ap GROUP BY 1""").replace("WITH ", "WITH RECURSIVE ", 1))
def precision_ladder(spark, sf_dir):
    found, truth = fixture(spark, sf_dir, "BOX"), fixture(spark, sf_dir, "GT")
    same = E.candidate_matches(truth, found, 0.4999999999).filter("gt_cls = det_cls AND iou >= 0.5")
    return _round(E.ap_ladder(E.greedy_match(same), found, truth.groupBy("cls").agg(F.count("*").alias("n"))), "ap50", "ap")


@query(oracle("BOX GT", _FLAGS + """, c AS (SELECT fl.cls, conf, row_number() OVER w AS k, sum(tp) OVER (w ROWS UNBOUNDED PRECEDING) AS tps, n FROM fl JOIN t ON t.cls=fl.cls WINDOW w AS (PARTITION BY fl.cls ORDER BY conf DESC, seq)),
e AS (SELECT cls, conf, k, tps/(n+1e-16) AS r, tps/k AS p FROM c), x AS (SELECT cls, g, g/999 AS x FROM (SELECT DISTINCT cls FROM e) q, (SELECT unnest(range(1000)) AS g) z),
a AS (SELECT x.cls, g, max_by((conf,r,p),k) AS a FROM x JOIN e ON e.cls=x.cls AND e.conf>x.x GROUP BY ALL), b AS (SELECT x.cls, g, min_by((conf,r,p),k) AS b FROM x JOIN e ON e.cls=x.cls AND e.conf<=x.x GROUP BY ALL),
v AS (SELECT x.cls, x.g, CASE WHEN b[1]=x.x THEN b[2] WHEN a IS NULL THEN 0 WHEN b IS NULL THEN a[2] ELSE a[2]+(b[2]-a[2])*((a[1]-x.x)/(a[1]-b[1])) END AS r, CASE WHEN b[1]=x.x THEN b[3] WHEN a IS NULL THEN 1 WHEN b IS NULL THEN a[3] ELSE a[3]+(b[3]-a[3])*((a[1]-x.x)/(a[1]-b[1])) END AS p
 FROM x LEFT JOIN a ON a.cls=x.cls AND a.g=x.g LEFT JOIN b ON b.cls=x.cls AND b.g=x.g),
f AS (SELECT *, 2*p*r/(p+r+1e-16) AS f FROM v), m AS (SELECT g, avg(f) AS f FROM f GROUP BY g), s AS (SELECT m.g, avg(o.f) AS s FROM m, (SELECT unnest(range(-50,51)) AS d) d JOIN m o ON o.g=least(greatest(m.g+d,0),999) GROUP BY m.g),
w AS (SELECT max_by(g,(round(s,12),-g)) AS g FROM s)
SELECT f.cls, f.g AS cell, round(p,6) AS "precision", round(r,6) AS recall, round(f,6) AS f1, round(r*n) AS tp, round(round(r*n)/(p+1e-16)-round(r*n)) AS fp FROM f JOIN w ON w.g=f.g JOIN t ON t.cls=f.cls"""))
def best_f1(spark, sf_dir):
    return _round(E.best_f1(*_flags(spark, sf_dir)), "precision", "recall", "f1")


_SCORE = """s AS (SELECT count(*) FILTER (truth=found) AS hits, count(truth) AS truths, count(found) AS founds, coalesce(sum(levenshtein(coalesce(truth,''),coalesce(found,''))),0) AS edits, coalesce(sum(length(truth)),0) AS chars, count(DISTINCT image_id) AS images FROM m),
pr AS (SELECT *, hits/(founds+1e-9) AS p, hits/(truths+1e-9) AS r FROM s)
SELECT hits, truths, founds, round(p,6) AS "precision", round(r,6) AS recall, round(2*p*r/(p+r+1e-9),6) AS f_score, round(1-edits/(chars+1e-9),6) AS char_accuracy, round(edits/(truths+1e-9),6) AS edit_per_field, round(edits/images,6) AS edit_per_image FROM pr"""
_SCORES = ("precision", "recall", "f_score", "char_accuracy", "edit_per_field", "edit_per_image")


@query(oracle("READ", f""", m AS (SELECT pass_id%500 AS image_id, CASE WHEN seq%9=0 THEN NULL ELSE true_code END AS truth, CASE WHEN seq%7=0 THEN NULL ELSE text END AS found FROM f_read), {_SCORE}"""))
def ocr_score(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ")
    m = r.select((F.col("pass_id") % 500).alias("image_id"), F.expr("case when seq%9=0 then null else true_code end").alias("truth"), F.expr("case when seq%7=0 then null else text end").alias("found"))
    return _round(E.end_to_end_score(m), *_SCORES)


def _quads(spark, sf_dir):
    """Truth and found boxes as quads whose corners come in several orders."""
    def quad(df):
        n = lambda *cs: F.array(*[F.col(c) for c in cs])
        plain, mixed = n("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2"), n("x2", "y2", "x1", "y1", "x1", "y2", "x2", "y1")
        return df.withColumn("quad", F.when(F.col("det_id") % 2 == 0, plain).otherwise(mixed)).drop("x1", "y1", "x2", "y2")

    truth, found = fixture(spark, sf_dir, "QUAD"), fixture(spark, sf_dir, "FOUND")
    return quad(truth).withColumnRenamed("det_id", "gt_id"), quad(found)


_MET = """, pq AS (SELECT a.image_id, a.det_id AS gt_id, b.det_id, a.ignore, a.text AS truth, b.text AS found, (least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1)) AS i, (a.x2-a.x1)*(a.y2-a.y1) AS ga, (b.x2-b.x1)*(b.y2-b.y1) AS da
 FROM f_quad a JOIN f_found b ON a.image_id=b.image_id AND a.x1<b.x2 AND b.x1<a.x2 AND a.y1<b.y2 AND b.y1<a.y2)"""


@query(oracle("QUAD FOUND", _MET + " SELECT image_id, gt_id, det_id, round(i,3) AS inter, round(i,3) AS rough, round(i/(ga+da-i),6) AS iou, round(i/da,6) AS iod FROM pq"))
def quad_pairs(spark, sf_dir):
    pairs = Q.quad_overlaps(*_quads(spark, sf_dir), "gt_id", "det_id")
    return pairs.select("image_id", "gt_id", "det_id", F.round("inter", 3).alias("inter"), F.round("rough", 3).alias("rough"), F.round("iou", 6).alias("iou"), F.round("iod", 6).alias("iod"))


_QM = _MET + """, o AS (SELECT image_id, det_id, gt_id, row_number() OVER (PARTITION BY image_id ORDER BY i/(ga+da-i) DESC, gt_id, det_id) AS k FROM pq WHERE i/(ga+da-i)>=0.5),
gw AS (SELECT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ds, CAST([] AS BIGINT[]) AS gs, CAST([] AS BIGINT[]) AS ks FROM (SELECT DISTINCT image_id FROM o) z UNION ALL
 SELECT o.image_id, o.k, CASE WHEN list_contains(ds,o.det_id) OR list_contains(gs,o.gt_id) THEN ds ELSE list_append(ds,o.det_id) END, CASE WHEN list_contains(ds,o.det_id) OR list_contains(gs,o.gt_id) THEN gs ELSE list_append(gs,o.gt_id) END,
 CASE WHEN list_contains(ds,o.det_id) OR list_contains(gs,o.gt_id) THEN ks ELSE list_append(ks,o.k) END FROM gw JOIN o ON o.image_id=gw.image_id AND o.k=gw.k+1),
gm AS (SELECT o.image_id, o.gt_id, o.det_id FROM o JOIN (SELECT image_id, max_by(ks,k) AS ks FROM gw GROUP BY image_id) f ON f.image_id=o.image_id WHERE list_contains(f.ks,o.k)),
m AS (SELECT q.image_id, q.text AS truth, f.text AS found FROM f_quad q LEFT JOIN gm ON gm.gt_id=q.det_id LEFT JOIN f_found f ON f.det_id=gm.det_id WHERE NOT q.ignore
 UNION ALL SELECT image_id, NULL, text FROM f_found WHERE det_id NOT IN (SELECT det_id FROM gm) AND image_id IN (SELECT image_id FROM f_quad) UNION ALL SELECT DISTINCT image_id, NULL, NULL FROM f_quad)"""


@query(oracle("QUAD FOUND", f"{_QM}, {_SCORE}").replace("WITH ", "WITH RECURSIVE ", 1))
def ocr_end_to_end(spark, sf_dir):
    truth, found = _quads(spark, sf_dir)
    return _round(E.end_to_end_score(E.matched_fields(truth, found), truth.select("image_id")), *_SCORES)


@query(oracle("QUAD FOUND", _MET + " SELECT image_id, gt_id, det_id, round(i/ga,2) AS sigma, round(i/da,2) AS tau FROM pq WHERE NOT ignore AND det_id NOT IN (SELECT det_id FROM pq WHERE ignore AND i/da>0.5)"))
def overlap_shares(spark, sf_dir):
    return E.overlap_tables(*_quads(spark, sf_dir))[2]


def _taken(step: str, source: str, own: str, other: str, alone: str, share: str, least: float) -> str:
    """Quads in order of their number, each with what is left of its list: taken, with which others, and whether texts agree."""
    return f""", {step}q AS (SELECT image_id, {own} AS o, row_number() OVER (PARTITION BY image_id ORDER BY {own}) AS k, list({{'x': {other}, 's': {share}, 'ok': {alone}, 'same': same}} ORDER BY {other}) AS ps FROM {source} GROUP BY image_id, {own}),
{step}w AS (SELECT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone, CAST(NULL AS BIGINT) AS o, 0 AS n, false AS same, false AS won FROM (SELECT DISTINCT image_id FROM {step}q) z UNION ALL
 SELECT image_id, k, CASE WHEN won THEN list_concat(gone, list_transform(ps, lambda p: p.x)) ELSE gone END, o, len(ps), ps[1].same, won FROM (SELECT *, CASE WHEN len(ps)=0 THEN false WHEN len(ps)=1 THEN ps[1].ok ELSE round(list_sum(list_transform(ps, lambda p: p.s)),6)>={least} END AS won FROM (
  SELECT q.image_id, q.k, w.gone, q.o, list_filter(q.ps, lambda p: NOT list_contains(w.gone, p.x)) AS ps FROM {step}w w JOIN {step}q q ON q.image_id=w.image_id AND q.k=w.k+1) y) z),
{step} AS (SELECT image_id, o, n, same FROM {step}w WHERE won), {step}x AS (SELECT image_id, unnest(gone) AS x FROM (SELECT image_id, max_by(gone, k) AS gone FROM {step}w GROUP BY image_id) z)"""


_AREA = _MET + """, lf AS (SELECT * FROM f_found WHERE det_id NOT IN (SELECT det_id FROM pq WHERE ignore AND i/da>0.5)),
pr AS (SELECT image_id, gt_id, det_id, round(i/ga,2) AS sigma, round(i/da,2) AS tau, lower(trim(truth))=lower(trim(found)) AS same FROM pq WHERE NOT ignore AND det_id IN (SELECT det_id FROM lf)),
n AS (SELECT *, count(*) FILTER (sigma>0.7) OVER g AS gs, count(*) FILTER (tau>0.6) OVER g AS gt, count(*) FILTER (sigma>0.7) OVER d AS ds, count(*) FILTER (tau>0.6) OVER d AS dt, count(*) FILTER (sigma>0) OVER g AS kg, count(*) FILTER (tau>0) OVER d AS kd
 FROM pr WINDOW g AS (PARTITION BY image_id, gt_id), d AS (PARTITION BY image_id, det_id)),
one AS (SELECT image_id, gt_id, max(det_id) FILTER (sigma>0.7) AS det_id, bool_or(same) FILTER (sigma>0.7) AS same FROM n WHERE gs=1 AND gt=1 GROUP BY image_id, gt_id HAVING bool_or(sigma>0.7 AND ds=1) AND bool_or(tau>0.6 AND dt=1)),
fr AS (SELECT * FROM n WHERE (image_id, gt_id) NOT IN (SELECT (image_id, gt_id) FROM one) AND (image_id, det_id) NOT IN (SELECT (image_id, det_id) FROM one)),
f2 AS (SELECT * FROM fr WHERE tau>=0.6 AND kg>=2)""" + _taken("sp", "f2", "gt_id", "det_id", "sigma>=0.7", "sigma", 0.7) + """,
f3 AS (SELECT * FROM fr WHERE sigma>=0.6 AND kd>=2 AND (image_id, gt_id) NOT IN (SELECT (image_id, o) FROM sp) AND (image_id, det_id) NOT IN (SELECT (image_id, x) FROM spx))""" + _taken("mg", "f3", "det_id", "gt_id", "tau>=0.6 AND sigma>=0.7", "tau", 0.6) + """,
cr AS (SELECT 1.0::DOUBLE AS recall, 1.0::DOUBLE AS precision, same FROM one UNION ALL SELECT CASE WHEN n=1 THEN 1 ELSE 0.8 END, CASE WHEN n=1 THEN 1 ELSE 0.8*n END, same FROM sp UNION ALL SELECT CASE WHEN n=1 THEN 1 ELSE 0.8*n END, CASE WHEN n=1 THEN 1 ELSE 0.8 END, same FROM mg),
su AS (SELECT coalesce(sum(recall),0) AS rc, coalesce(sum(precision),0) AS pc, count(*) FILTER (same) AS hits, (SELECT count(*) FROM f_quad WHERE NOT ignore) AS truths, (SELECT count(*) FROM lf) AS founds FROM cr),
sh AS (SELECT *, rc/truths AS r, pc/founds AS p, hits/truths AS re, hits/founds AS pe FROM su)
SELECT truths, founds, hits, round(rc,6) AS recall_credit, round(r,6) AS recall, round(p,6) AS precision, round(CASE WHEN p+r>0 THEN 2*p*r/(p+r) ELSE 0 END,6) AS f_score, round(CASE WHEN rc>0 THEN 1-hits/rc ELSE 1 END,6) AS sequence_error,
 round(re,6) AS recall_e2e, round(pe,6) AS precision_e2e, round(CASE WHEN pe+re>0 THEN 2*pe*re/(pe+re) ELSE 0 END,6) AS f_score_e2e FROM sh"""


@query(oracle("QUAD FOUND", _AREA).replace("WITH ", "WITH RECURSIVE ", 1))
def area_match(spark, sf_dir):
    got = E.area_match_score(*_quads(spark, sf_dir))
    return _round(got, *[c for c in got.columns if c not in ("truths", "founds", "hits")])


@query(oracle("BOX", """, r AS (SELECT det_id, image_id, conf AS obj, [conf,1-conf,abs(x1)-floor(abs(x1))] AS sc FROM f_box), u AS (SELECT image_id, det_id, obj, unnest(sc) AS s, generate_subscripts(sc,1)-1 AS cls FROM r)
SELECT image_id, det_id, CAST(cls AS BIGINT) AS cls, round(obj*s,6) AS conf FROM u WHERE obj>0.3 AND obj*s>0.3 AND cls IN (0,2)"""))
def class_candidates(spark, sf_dir):
    raw = fixture(spark, sf_dir, "BOX").selectExpr("image_id", "det_id", "conf as obj", "array(conf, 1-conf, abs(x1)-floor(abs(x1))) as scores")
    return _round(B.class_boxes(raw, 0.3, multi=True, classes=[0, 2]).withColumn("cls", F.col("cls").cast("long")), "conf")


_ANY = _NMS.replace("PARTITION BY image_id, cls", "PARTITION BY image_id").replace(" AND a.cls=b.cls", "").replace("a.cls, a.k", "0 AS cls, a.k").replace("SELECT DISTINCT image_id, cls FROM c", "SELECT DISTINCT image_id, 0 AS cls FROM c").replace(" AND c.cls=w.cls", "").replace(" AND bad.cls=c.cls", "")


@query(oracle("BOX", _ANY + " SELECT c.image_id, c.cls, c.det_id FROM c JOIN kp ON kp.image_id=c.image_id WHERE list_contains(kp.kept, c.k)").replace("WITH ", "WITH RECURSIVE ", 1))
def agnostic_boxes(spark, sf_dir):
    return B.nms(fixture(spark, sf_dir, "BOX"), agnostic=True).select("image_id", "cls", "det_id")


@query(oracle("BOX", _NMS + """ SELECT c.image_id, c.det_id, round(least(greatest((x1-0)/0.5,0),1280),6) AS ax, round(least(greatest((y1-80)/0.5,0),960),6) AS ay, round(least(greatest((x2-0)/0.5,0),1280),6) AS cx, round(least(greatest((y2-80)/0.5,0),960),6) AS cy
 FROM c JOIN kp ON kp.image_id=c.image_id AND kp.cls=c.cls WHERE list_contains(kp.kept, c.k)""").replace("WITH ", "WITH RECURSIVE ", 1))
def landmark_boxes(spark, sf_dir):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    b = fixture(spark, sf_dir, "BOX").withColumn("points", F.array(p("x1", "y1"), p("x2", "y1"), p("x2", "y2"), p("x1", "y2")))
    kept = B.unletterbox_points(B.nms(b), 1280, 960)
    at = lambda i, c, name: F.round(F.col("points")[i][c], 6).alias(name)
    return kept.select("image_id", "det_id", at(0, "x", "ax"), at(0, "y", "ay"), at(2, "x", "cx"), at(2, "y", "cy"))


@query(oracle("LAT", " SELECT direction, seq, round(sum(seconds*depth) OVER w/nullif(sum(depth) OVER w,0),4) AS mean FROM f_lat WINDOW w AS (PARTITION BY direction ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"))
def running_means(spark, sf_dir):
    rows = fixture(spark, sf_dir, "LAT").withColumn("hour", F.date_trunc("hour", "ts"))
    out = E.running_mean(rows, "direction", "hour", ["ts", "seq"], "seconds", "depth")
    return out.select("direction", "seq", F.round("mean", 4).alias("mean"))


@query(oracle("EVOLVE", " SELECT max_by(generation,(round(map50*0.1+map*0.9+p*0.1+r*0.9,9),-generation)) AS generation, round(max(map50*0.1+map*0.9+p*0.1+r*0.9),6) AS fitness FROM f_evolve"))
def best_mask_generation(spark, sf_dir):
    runs = fixture(spark, sf_dir, "EVOLVE").withColumns({"mask_map50": F.col("p"), "mask_map": F.col("r")})
    return _round(E.best_run(runs, masks=True), "fitness")


@query(oracle("EVOLVE", " SELECT max_by(generation,(round(map50*0.1+map*0.9,9),-generation)) AS generation, round(max(map50*0.1+map*0.9),6) AS fitness FROM f_evolve"))
def best_generation(spark, sf_dir):
    return _round(E.best_run(fixture(spark, sf_dir, "EVOLVE")), "fitness")


@query(oracle("LABEL", """, p AS (SELECT cls AS "true", CASE WHEN line_no%10=0 THEN (cls+1)%4 ELSE cls END AS pred FROM f_label), u AS (SELECT c, count(*) AS u FROM (SELECT pred AS c FROM p UNION ALL SELECT "true" FROM p WHERE pred<>"true") z GROUP BY c),
i AS (SELECT pred AS c, count(*) AS i FROM p WHERE pred="true" GROUP BY pred) SELECT round(avg(coalesce(i,0)/u),6) AS mean_iou, count(*) AS classes FROM u LEFT JOIN i ON i.c=u.c"""))
def label_mean_iou(spark, sf_dir):
    p = fixture(spark, sf_dir, "LABEL").select(F.col("cls").alias("true"), F.expr("case when line_no%10=0 then (cls+1)%4 else cls end").alias("pred"))
    return _round(E.mean_iou(p), "mean_iou")


@query(oracle("BOX", " SELECT image_id, cls, round(sum(CASE WHEN conf>=0.35 THEN conf ELSE 0 END)/greatest(1,count(*) FILTER (conf>=0.35)),6) AS confidence FROM f_box GROUP BY ALL"))
def image_confidence(spark, sf_dir):
    return _round(E.image_confidence(fixture(spark, sf_dir, "BOX"), 0.35), "confidence")


@query(oracle("BOX", _NMS + """, kept AS (SELECT c.* FROM c JOIN kp ON kp.image_id=c.image_id AND kp.cls=c.cls WHERE list_contains(kp.kept, c.k)),
mm AS (SELECT a.image_id, a.cls, a.det_id, b.conf, b.x1, b.y1, b.x2, b.y2 FROM kept a JOIN c b ON a.image_id=b.image_id AND a.cls=b.cls AND a.x1<b.x2 AND b.x1<a.x2 AND a.y1<b.y2 AND b.y1<a.y2
 WHERE (least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1))/((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)-(least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1))+1e-7)>0.45)
SELECT image_id, cls, det_id, round(sum(x1*conf)/sum(conf),6) AS x1, round(sum(y1*conf)/sum(conf),6) AS y1, round(sum(x2*conf)/sum(conf),6) AS x2, round(sum(y2*conf)/sum(conf),6) AS y2, count(*) AS support FROM mm GROUP BY ALL HAVING count(*)>1""").replace("WITH ", "WITH RECURSIVE ", 1))
def merged_boxes(spark, sf_dir):
    return _round(B.merge_nms(fixture(spark, sf_dir, "BOX")), *B.CORNERS)
