"""Queries over label datasets and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets as D
from ..operators import telemetry as T
from .fixtures import fixture, oracle
from .registry import query

_U = lambda k, seed=0: f"(('0x'||substr(md5('{seed}:'||CAST({k} AS VARCHAR)),1,12))::BIGINT/281474976710656.0)"
_IMG = """, im AS (SELECT i AS image_no, 'set/images/'||i||'.jpg' AS image_path, CASE WHEN i%13=5 THEN 8 ELSE 640+(i*37)%400 END AS width, 480+(i*53)%500 AS height, i%4<>3 AS labelled
 FROM (SELECT DISTINCT vec_id AS i FROM embeddings) z)"""


def _images(spark, sf_dir):
    """An image per vector, some too small, most without labels."""
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("i")).distinct()
    return ids.selectExpr("i as image_no", "concat('set/images/', i, '.jpg') as image_path", "if(i%13=5, 8, 640+(i*37)%400) as width", "480+(i*53)%500 as height", "i%4<>3 as labelled")


def _round(df, *cs):
    return df.withColumns({c: F.round(c, 6) for c in cs})


@query(oracle("LABEL", " SELECT DISTINCT image_path, 'set/labels/'||regexp_extract(image_path,'([0-9]+)[.]jpg$',1)||'.txt' AS label_path FROM f_label"))
def label_paths(spark, sf_dir):
    return fixture(spark, sf_dir, "LABEL").select("image_path", D.label_path("image_path").alias("label_path")).distinct()


_VERIFIED = _IMG + """, pr AS (SELECT image_path, count(*) AS rows, bool_or(cls<0 OR least(xc,yc,w,h)<0 OR greatest(xc,yc,w,h)>1) AS bad, count(DISTINCT (cls,xc,yc,w,h)) AS u FROM f_label GROUP BY image_path),
v AS (SELECT im.image_path, CASE WHEN width<10 OR height<10 OR coalesce(bad,false) THEN 'corrupt' WHEN rows>0 THEN 'found' WHEN labelled THEN 'empty' ELSE 'missing' END AS status, coalesce(rows,0) AS rows, coalesce(rows-u,0) AS duplicates FROM im LEFT JOIN pr ON pr.image_path=im.image_path)"""


@query(oracle("LABEL", _VERIFIED + " SELECT * FROM v"))
def verified_labels(spark, sf_dir):
    return D.verify_labels(_images(spark, sf_dir), fixture(spark, sf_dir, "LABEL"))


@query(oracle("LABEL", _VERIFIED + " SELECT count(*) FILTER (status='found') AS found, count(*) FILTER (status='missing') AS missing, count(*) FILTER (status='empty') AS empty, count(*) FILTER (status='corrupt') AS corrupt, count(*) AS total, CAST(sum(duplicates) AS BIGINT) AS duplicates FROM v"))
def scan_totals(spark, sf_dir):
    return D.scan_summary(D.verify_labels(_images(spark, sf_dir), fixture(spark, sf_dir, "LABEL")))


@query(oracle("LABEL", " SELECT image_path, cls, round(xc,6) AS xc, round(yc,6) AS yc, round(w,6) AS w, round(h,6) AS h, min(line_no) AS line_no FROM f_label GROUP BY image_path, cls, f_label.xc, f_label.yc, f_label.w, f_label.h"))
def distinct_labels(spark, sf_dir):
    return _round(D.dedup_labels(fixture(spark, sf_dir, "LABEL")), "xc", "yc", "w", "h")


_SPLIT = f", sp AS (SELECT *, CASE WHEN {_U('image_path')}<0.7 THEN 'train' WHEN {_U('image_path')}<0.9 THEN 'val' ELSE 'test' END AS split FROM f_label)"


@query(oracle("LABEL", _SPLIT + " SELECT split, cls, count(*) AS instances, count(DISTINCT image_path) AS images FROM sp GROUP BY ROLLUP (split, cls)"))
def dataset_statistics(spark, sf_dir):
    return D.dataset_stats(D.autosplit(fixture(spark, sf_dir, "LABEL"), (0.7, 0.2, 0.1)), "split")


@query(oracle("LABEL", _SPLIT + " SELECT DISTINCT image_path, split FROM sp"))
def stable_split(spark, sf_dir):
    return D.autosplit(fixture(spark, sf_dir, "LABEL").select("image_path").distinct(), (0.7, 0.2, 0.1)).select("image_path", "split")


_WEIGHT = ", n AS (SELECT r.c AS cls, coalesce(k,1) AS k FROM (SELECT unnest(range(6)) AS c) r LEFT JOIN (SELECT cls, count(*) AS k FROM f_label GROUP BY cls) l ON l.cls=r.c), cw AS (SELECT CAST(cls AS INT) AS cls, (1/k)/sum(1/k) OVER () AS weight FROM n)"


@query(oracle("LABEL", _WEIGHT + " SELECT cls, round(weight,6) AS weight FROM cw"))
def class_weights(spark, sf_dir):
    return _round(D.class_weights(fixture(spark, sf_dir, "LABEL"), 6), "weight")


_IW = _WEIGHT + ", iw AS (SELECT image_path, sum(weight) AS weight FROM f_label JOIN cw ON cw.cls=f_label.cls GROUP BY image_path)"


@query(oracle("LABEL", _IW + " SELECT image_path, round(weight,6) AS weight FROM iw"))
def image_weights(spark, sf_dir):
    labels = fixture(spark, sf_dir, "LABEL")
    return _round(D.image_weights(labels, D.class_weights(labels, 6)), "weight")


@query(oracle("LABEL", _IW + f""", c AS (SELECT image_path, weight, sum(weight) OVER (ORDER BY floor({_U('image_path')}*256), image_path ROWS UNBOUNDED PRECEDING) AS upto FROM iw),
d AS (SELECT i AS draw, {_U('i', 1)}*(SELECT max(upto) FROM c) AS x FROM (SELECT unnest(range(count(*))) AS i FROM f_label) z)
SELECT d.draw, c.image_path FROM d JOIN c ON x>=upto-weight AND x<upto"""))
def weighted_draws(spark, sf_dir):
    labels = fixture(spark, sf_dir, "LABEL")
    return D.weighted_sample(D.image_weights(labels, D.class_weights(labels, 6)), "image_path", labels.count())


@query(oracle("LABEL", ", k AS (SELECT * FROM f_label WHERE cls IN (0,2)), m AS (SELECT image_path FROM k GROUP BY image_path HAVING count(*)>=8) SELECT image_path, line_no, 0 AS cls FROM k WHERE image_path IN (SELECT image_path FROM m)"))
def filtered_dataset(spark, sf_dir):
    return D.filter_dataset(fixture(spark, sf_dir, "LABEL"), 8, [0, 2], single=True).select("image_path", "line_no", "cls")


_RATIO = _IMG + ", a AS (SELECT *, height/width AS ar, width/height AS wh FROM im)"


@query(oracle("LABEL", _RATIO + f""", b AS (SELECT *, (row_number() OVER (ORDER BY ar, {_U('image_path')}, image_path)-1)//6 AS batch FROM a), s AS (SELECT batch, count(*) AS images, min(ar) AS low, max(ar) AS high FROM b GROUP BY batch)
SELECT batch, images, CAST(ceil((CASE WHEN high<1 THEN high ELSE 1 END)*640/32+0.5)*32 AS INT) AS batch_h, CAST(ceil((CASE WHEN high>=1 AND low>1 THEN 1/low ELSE 1 END)*640/32+0.5)*32 AS INT) AS batch_w FROM s"""))
def rectangular_batches(spark, sf_dir):
    return D.rect_batches(_images(spark, sf_dir), 6)


@query(oracle("LABEL", _RATIO + f", b AS (SELECT *, (row_number() OVER (ORDER BY wh, {_U('image_path')}, image_path)-1)//6 AS batch FROM a) SELECT batch, count(*) AS images, round(greatest(max(wh),0.8),6) AS ratio FROM b GROUP BY batch"))
def width_aware_batches(spark, sf_dir):
    return _round(D.width_batches(_images(spark, sf_dir), 6, 0.8), "ratio")


@query(oracle("LABEL", """, b AS (SELECT 'class' AS kind, cls AS i, 0 AS j FROM f_label UNION ALL SELECT 'centre', least(floor(xc*20),19), least(floor(yc*20),19) FROM f_label UNION ALL SELECT 'size', least(floor(w*20),19), least(floor(h*20),19) FROM f_label)
SELECT kind, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, count(*) AS n FROM b GROUP BY ALL"""))
def label_histograms(spark, sf_dir):
    return D.label_histograms(fixture(spark, sf_dir, "LABEL"), 20)


@query(oracle("LABEL", ", p AS (SELECT DISTINCT 'd'||(line_no%3)||'/'||regexp_extract(image_path,'([^/]*)$',1) AS path FROM f_label) SELECT regexp_extract(path,'([^/]*)$',1) AS name, max(path) AS path FROM p GROUP BY 1"))
def flat_names(spark, sf_dir):
    return D.flatten_names(fixture(spark, sf_dir, "LABEL").selectExpr("concat('d', line_no%3, '/', regexp_extract(image_path, '([^/]*)$', 1)) as path").distinct())


@query(oracle("LABEL", _IMG + """, h AS (SELECT ('0x'||substr(md5(image_path),1,8))::BIGINT%64 AS b, ('0x'||substr(md5(image_path||':'||width),1,15))::BIGINT AS h, width FROM im),
p AS (SELECT b, bit_xor(h) AS x, sum(width) AS s, count(*) AS n FROM h GROUP BY b) SELECT sha256(string_agg(b||':'||x||':'||s||':'||n, ',' ORDER BY b)) AS fingerprint, CAST(sum(n) AS BIGINT) AS files FROM p"""))
def dataset_fingerprint(spark, sf_dir):
    return D.fingerprint(_images(spark, sf_dir).select(F.col("image_path").alias("path"), F.col("width").alias("size")))


@query()
def anchor_clusters(spark, sf_dir):
    """Anchors by k-means and ten generations of mutation, with the fitness that they have."""
    labels = fixture(spark, sf_dir, "LABEL")
    anchors, scores = D.evolve_anchors(labels, D.kmeans_anchors(labels, 640.0, 4), 640.0, generations=10, mutants=8)
    return anchors.withColumn("fitness", F.lit(scores[-1]))


#: Anchors whose mutants are compared with SQL: sets of a parent and of sides changed by whole factors.
_SETS = [[(40.0, 50.0), (80.0, 70.0), (160.0, 120.0)], [(44.0, 50.0), (80.0, 63.0), (176.0, 120.0)], [(40.0, 60.0), (90.0, 70.0), (150.0, 140.0)]]
_BEST = lambda anchors: "greatest(" + ",".join(f"least(w/{a},{a}/w,h/{b},{b}/h)" for a, b in anchors) + ")"


@query(oracle("LABEL", ", z AS (SELECT w*640 AS w, h*640 AS h FROM f_label WHERE w*640>=2 OR h*640>=2) " + " UNION ALL ".join(f"SELECT {i} AS candidate, round(avg(CASE WHEN w>0 AND h>0 AND {_BEST(a)}>0.25 THEN {_BEST(a)} ELSE 0 END),6) AS fitness FROM z" for i, a in enumerate(_SETS))))
def anchor_mutants(spark, sf_dir):
    sizes = D.anchor_sizes(fixture(spark, sf_dir, "LABEL"), 640.0).withColumn("n", F.lit(1))
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(D.anchor_scores(sizes, _SETS))], "candidate int, fitness double")


_MARKS = """, ln AS (SELECT image_path, [CAST(cls AS DOUBLE), xc, yc, abs(w), h, 0.5, 0.5, 0.25, -1.0, -1.0, CASE WHEN line_no%23=0 THEN 1.5 ELSE 0.1 END, xc, yc] AS v, line_no FROM f_label),
lm AS (SELECT image_path, CASE WHEN line_no%31=0 THEN v[:12] ELSE v END AS v FROM ln)"""


@query(oracle("LABEL", _IMG + _MARKS + """, pr AS (SELECT image_path, count(*) AS rows, bool_or(len(v)<>13 OR list_min(v)<-1 OR list_max(v[2:])>1) AS bad, count(DISTINCT list_transform(v, lambda x: CAST(x AS FLOAT))) AS u FROM lm GROUP BY image_path)
SELECT im.image_path, CASE WHEN width<10 OR height<10 OR coalesce(bad,false) OR rows>u THEN 'corrupt' WHEN rows>0 THEN 'found' WHEN labelled THEN 'empty' ELSE 'missing' END AS status, coalesce(rows,0) AS rows FROM im LEFT JOIN pr ON pr.image_path=im.image_path"""))
def verified_landmarks(spark, sf_dir):
    one = F.expr("array(cast(cls as double), xc, yc, abs(w), h, 0.5d, 0.5d, 0.25d, -1.0d, -1.0d, if(line_no%23=0, 1.5d, 0.1d), xc, yc)")
    lines = fixture(spark, sf_dir, "LABEL").select("image_path", F.when(F.expr("line_no%31=0"), F.slice(one, 1, 12)).otherwise(one).alias("fields"))
    return D.verify_landmarks(_images(spark, sf_dir), lines)


@query(oracle("LABEL", _VERIFIED + " SELECT * FROM v"))
def reverified_labels(spark, sf_dir):
    """Verification of a whole set of which a part was verified before: rows of another width then, and some not there."""
    images, labels = _images(spark, sf_dir), fixture(spark, sf_dir, "LABEL")
    part = F.expr("crc32(image_path) % 40")
    old = images.filter(part != 1).withColumn("width", F.when(part == 2, F.col("width") + 1).otherwise(F.col("width")))
    return D.verify_changed(images, labels, D.verify_changed(old, labels))[0]


_R = lambda a, b: f"least(least(w*640/{a},{a}/(w*640)),least(h*640/{b},{b}/(h*640)))"
_A = [(40.0, 50.0), (80.0, 70.0), (160.0, 120.0)]
_RS = "[" + ",".join(_R(a, b) for a, b in _A) + "]"


@query(oracle("LABEL", f", x AS (SELECT {_RS} AS x FROM f_label WHERE w>0 AND h>0) SELECT round(avg(CASE WHEN list_max(x)>0.5 THEN 1.0 ELSE 0 END),6) AS recall, round(avg(len(list_filter(x,lambda v: v>0.5))),6) AS past, round(avg(list_max(x)),6) AS best, round(avg(list_sum(x)/3),6) AS mean FROM x"))
def anchor_fitness(spark, sf_dir):
    return _round(D.anchor_fit(fixture(spark, sf_dir, "LABEL"), _A, 640.0, 2.0), "recall", "past", "best", "mean")


@query(oracle("LABEL", " SELECT CASE cls WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE cls END AS cls, count(*) AS n FROM f_label GROUP BY 1"))
def remapped_categories(spark, sf_dir):
    return D.remap_categories(fixture(spark, sf_dir, "LABEL"), {0: 1, 1: 2, 2: 3}).groupBy("cls").agg(F.count("*").alias("n"))


@query(oracle("LABEL", f", u AS (SELECT image_path, 0 AS source_no FROM f_label WHERE {_U('line_no')}<0.5 UNION ALL SELECT image_path, 1 FROM f_label WHERE {_U('line_no', 1)}<0.25) SELECT source_no, image_path, count(*) AS n FROM u GROUP BY ALL"))
def mixed_sources(spark, sf_dir):
    l = fixture(spark, sf_dir, "LABEL")  # noqa: E741
    return D.mix_sources([l, l], [0.5, 0.25], "line_no").groupBy("source_no", "image_path").agg(F.count("*").alias("n"))


@query(oracle("LOG", """, k AS (SELECT *, CASE WHEN message LIKE 'panorama %' THEN 'panorama' WHEN message LIKE 'outage%' THEN 'outage' WHEN message LIKE 'archive%' THEN 'archive' WHEN lower(message) LIKE '%error%' THEN 'error' ELSE 'other' END AS kind FROM f_log)
SELECT level, camera, kind, count(*) AS n FROM k GROUP BY CUBE (level, camera, kind)"""))
def log_totals(spark, sf_dir):
    return T.log_counts(fixture(spark, sf_dir, "LOG"))


@query(oracle("LOG", r""" SELECT date_trunc('millisecond', ts) AS ts, level, camera, message FROM f_log"""))
def parsed_log(spark, sf_dir):
    log = fixture(spark, sf_dir, "LOG")
    lines = log.select(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - "), "camera", F.lit(" - "), "level", F.lit(" - "), "message").alias("line"))
    return T.parse_log(lines).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "level", F.col("logger").alias("camera"), "message")


@query(oracle("LOG", r""", n AS (SELECT camera, CAST(regexp_extract(message,'^panorama (\d+)$',1) AS BIGINT) AS n FROM f_log WHERE message LIKE 'panorama%')
SELECT camera, count(*) AS panoramas, min(n) AS least, max(n) AS most, round(avg(n),6) AS mean, median(n) AS median, count(*) FILTER (n<5) AS fragments FROM n GROUP BY camera"""))
def panorama_statistics(spark, sf_dir):
    return _round(T.panorama_stats(fixture(spark, sf_dir, "LOG")), "mean")


_RES = ", ".join(f"CAST(regexp_extract(line,'{k}:([0-9.]+)',1) AS DOUBLE) AS {n}" for n, k in T.RESOURCES.items())


@query(oracle("RES", f", v AS (SELECT host, {_RES}, (row_number() OVER (PARTITION BY host ORDER BY ts, seq)-1)//11 AS bucket FROM f_res) SELECT host, bucket, max(cpu) AS cpu, max(gpu) AS gpu, max(gpu_memory) AS gpu_memory, max(memory) AS memory, count(*) AS samples FROM v GROUP BY host, bucket"))
def resource_maxima(spark, sf_dir):
    return T.resource_max(fixture(spark, sf_dir, "RES"), key="host")


@query(oracle("LAT", ", b AS (SELECT *, (row_number() OVER (PARTITION BY direction ORDER BY ts, seq)-1)//100 AS bucket FROM f_lat) SELECT direction, bucket, round(avg(seconds),6) AS mean FROM b GROUP BY ALL HAVING count(*)=100"))
def latency_means(spark, sf_dir):
    return _round(T.batched_mean(fixture(spark, sf_dir, "LAT"), 100), "mean")


@query(oracle("LAT", " SELECT direction, max(depth) AS most, round(avg(depth),6) AS mean FROM f_lat GROUP BY direction"))
def queue_depths(spark, sf_dir):
    return _round(T.queue_depth(fixture(spark, sf_dir, "LAT")), "mean")


@query(oracle("OBS", " SELECT direction, time_bucket(INTERVAL '3600 seconds', ts) AS start, count(*) AS frames, round(count(*)/3600,6) AS rate FROM f_obs GROUP BY ALL"))
def frame_rates(spark, sf_dir):
    return _round(T.frame_rate(fixture(spark, sf_dir, "OBS"), 3600), "rate")


@query(oracle("LOG", """, o AS (SELECT camera, time_bucket(INTERVAL '3600 seconds', ts) AS start, count(*) AS n FROM f_log WHERE message='outage' GROUP BY ALL)
SELECT camera, start, n, epoch(start-lag(start) OVER (PARTITION BY camera ORDER BY start)) AS gap FROM o"""))
def outage_rates(spark, sf_dir):
    return T.outage_rate(fixture(spark, sf_dir, "LOG"), 3600)


@query(oracle("LAT", " SELECT seq, round((depth*100+7)/8192,3) AS memory_ratio, round((depth*100+7)/1024,2) AS used_gib FROM f_lat"))
def gpu_usage(spark, sf_dir):
    return T.gpu_utilization(fixture(spark, sf_dir, "LAT").select("seq", (F.col("depth") * 100 + 7).alias("used_mb"), F.lit(8192).alias("total_mb"))).select("seq", "memory_ratio", "used_gib")


_POINTS = "SELECT direction AS gpu, CAST(depth AS DOUBLE) AS batch, CASE WHEN depth<CASE direction WHEN 'left' THEN 10 WHEN 'right' THEN 0 ELSE 30 END THEN depth*0.25+1+seconds END AS memory FROM"


@query(oracle("LAT", f""", p AS ({_POINTS} f_lat), l AS (SELECT gpu, regr_slope(memory,batch) AS slope, regr_intercept(memory,batch) AS intercept, min(batch) FILTER (memory IS NULL) AS bad FROM p GROUP BY gpu),
g AS (SELECT l.gpu, max(batch) AS safe FROM p JOIN l ON l.gpu=p.gpu WHERE batch<bad AND memory IS NOT NULL GROUP BY l.gpu), b AS (SELECT l.*, safe, CAST(trunc((24*0.8-intercept)/slope) AS BIGINT) AS fit FROM l LEFT JOIN g ON g.gpu=l.gpu),
c AS (SELECT *, CASE WHEN fit>=bad THEN CAST(coalesce(safe,bad) AS BIGINT) ELSE fit END AS batch FROM b)
SELECT gpu, round(slope,6) AS slope, round(intercept,6) AS intercept, CASE WHEN batch BETWEEN 1 AND 1024 THEN batch ELSE 16 END AS batch FROM c"""))
def batch_size_fit(spark, sf_dir):
    """Some batches fail: those from 10, 0 or 30 on."""
    points = spark.sql(f"{_POINTS} {{lat}}", lat=fixture(spark, sf_dir, "LAT"))
    return _round(T.fit_batch_size(points, 24.0), "slope", "intercept")


_SCALES = [(320, 32), (256, 48), (320, 64)]
_PLAN = D.scale_plan(_SCALES, 6, fixed=False)
_TURN = sum(x[2] for x in _PLAN)
_STARTS = [sum(x[2] for x in _PLAN[:i]) for i in range(len(_PLAN))]
_SCALE_SQL = "CASE " + " ".join(f"WHEN {{p}}%{_TURN}>={start} THEN {i}" for i, start in reversed(list(enumerate(_STARTS)))) + " END"
_PICK = lambda k, s: f"CASE {s} " + " ".join(f"WHEN {i} THEN {x[k]}" for i, x in enumerate(_PLAN)) + " END"


@query(oracle("LABEL", _RATIO + f""", o AS (SELECT wh, row_number() OVER (ORDER BY wh, {_U('image_path')}, image_path)-1 AS p, count(*) OVER () AS n FROM a),
e AS (SELECT DISTINCT n, (n-1)//{_TURN}*{_TURN} + {_PICK(2, _SCALE_SQL.format(p='(n-1)'))} + CASE {_SCALE_SQL.format(p='(n-1)')} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_STARTS))} END AS fin FROM o),
w AS (SELECT p, wh FROM o UNION ALL SELECT p+o.n, wh FROM o JOIN e ON e.n=o.n WHERE p<fin-o.n), s AS (SELECT wh, p//{_TURN}*{len(_PLAN)}+{_SCALE_SQL.format(p='p')} AS batch, {_SCALE_SQL.format(p='p')} AS sc FROM w)
SELECT batch, {_PICK(0, 'sc')} AS width, {_PICK(1, 'sc')} AS height, count(*) AS samples, round(least(avg(wh),480/{_PICK(1, 'sc')}),6) AS ratio FROM s GROUP BY batch, sc"""))
def multi_scale_batches(spark, sf_dir):
    return _round(D.multi_scale_batches(_images(spark, sf_dir), _PLAN), "ratio")


@query(oracle("LABEL", """, m AS (SELECT min(xc) AS lx, max(xc) AS hx, min(yc) AS ly, max(yc) AS hy FROM f_label),
c AS (SELECT line_no, least(greatest(floor((xc-lx)/greatest(hx-lx,1e-12)*19),0),18) AS i, least(greatest(floor((yc-ly)/greatest(hy-ly,1e-12)*19),0),18) AS j FROM f_label, m)
SELECT line_no, round(ln(count(*) OVER (PARTITION BY i, j)),6) AS density FROM c"""))
def label_density(spark, sf_dir):
    return _round(D.log_density(fixture(spark, sf_dir, "LABEL"), "xc", "yc", 20).select("line_no", "density"), "density")


_SPREAD = [(f"{k}_{c}", f, c) for c in ("xc", "yc", "w", "h") for k, f in (("mean", "avg"), ("sd", "stddev_pop"))]


@query(oracle("LABEL", " SELECT cls, count(*) AS n, " + ", ".join(f"round({f}({c}),6) AS {name}" for name, f, c in _SPREAD) + " FROM f_label GROUP BY cls"))
def label_spread(spark, sf_dir):
    return _round(D.label_spread(fixture(spark, sf_dir, "LABEL")), *[name for name, _, _ in _SPREAD])


@query(oracle("LABEL", ", n AS (SELECT DISTINCT 'kind'||cls AS label, cls AS place FROM f_label WHERE cls<>3), k AS (SELECT label, row_number() OVER (ORDER BY place)-1 AS k FROM n) SELECT 0 AS id, 'O' AS tag UNION ALL SELECT CAST(2*k+1 AS INT), 'B-'||upper(label) FROM k UNION ALL SELECT CAST(2*k+2 AS INT), 'I-'||upper(label) FROM k"))
def tag_ids(spark, sf_dir):
    labels = fixture(spark, sf_dir, "LABEL").select(F.when(F.col("cls") == 3, "Other").otherwise(F.concat(F.lit("kind"), F.col("cls").cast("string"))).alias("label"), F.col("cls").alias("place")).distinct()
    return D.tag_map(labels)
