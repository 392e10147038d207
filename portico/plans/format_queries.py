"""Queries of readers: a projection of a given table is written in the format and read back.

The files lie in a new folder under the shared one, and stay as long as the result may be read. Formats
of one document per file get a folder for each small group of rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion
from ..operators.scans import shared
from ..sources import readers as R
from ..sources import writers as W
from .data_queries import _round
from .fixtures import fixture, oracle
from .registry import query


def _folder(spark: SparkSession) -> str:
    return f"{shared(spark)}/formats-{uuid.uuid4().hex}"


def _table(spark, sf_dir, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(df: DataFrame, path: str, *by: str) -> str:
    df.select("value", *by).write.partitionBy(*by).text(path)
    return path


@query("""SELECT 'cam'||s_suppkey AS camera_key, CASE s_suppkey%5 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'top' WHEN 3 THEN 'front' ELSE 'rear' END AS direction, CAST(s_nationkey AS INT) AS id,
 'rtsp://host/'||s_suppkey||'?q="x"' AS file_path, '0,'||(s_suppkey%100)||',1,'||(100+s_suppkey%100) AS roi, CASE WHEN s_suppkey%3=0 THEN round(s_suppkey/8.0,3) END AS sleep_time FROM supplier""")
def camera_settings(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    direction = F.element_at(F.array(*map(F.lit, ("left", "right", "top", "front", "rear"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    roi = F.array(F.lit(0), (F.col("s_suppkey") % 100).cast("int"), F.lit(1), (F.col("s_suppkey") % 100 + 100).cast("int"))
    one = F.struct(
        F.concat(F.lit("rtsp://host/"), F.col("s_suppkey").cast("string"), F.lit('?q="x"')).alias("file_path"), roi.alias("roi"), F.col("s_nationkey").cast("int").alias("id"), direction.alias("direction"),
        F.when(F.expr("s_suppkey % 3 = 0"), F.round(F.col("s_suppkey") / 8, 3)).alias("sleep_time"),
    )
    # A file is one object of some cameras.
    docs = s.groupBy(F.floor(F.col("s_suppkey") / 50).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("cam"), F.col("s_suppkey").cast("string")), one)))).alias("value"))
    got = R.read_cameras(spark, _text(docs, _folder(spark), "part"))
    return got.select("camera_key", "direction", "id", "file_path", F.array_join(F.transform("roi", lambda x: x.cast("string")), ",").alias("roi"), "sleep_time")


_CODE = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(p_partkey%26 AS INT)+1, 1)||lpad(CAST(p_partkey%1000 AS {STR}), 3, '0')"


@query(f"""WITH p AS (SELECT *, {_CODE.format(STR='VARCHAR')} AS code FROM part), m AS (SELECT code, max(p_partkey) AS k FROM p GROUP BY code)
SELECT p.code, p.p_name AS description, CASE WHEN p_partkey%7=0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS length, CAST(p_size AS DOUBLE)/4 AS height, p_brand AS "group" FROM p JOIN m ON m.k=p.p_partkey UNION ALL SELECT '0000', 'override', NULL, NULL, NULL""")
def size_type_file(spark, sf_dir):
    p = _table(spark, sf_dir, "part").withColumn("code", F.expr(_CODE.format(STR="STRING")))
    # A list of 26,000 codes at most: the first and the last row of each, in order, in one file.
    row = F.struct("p_partkey", "p_name", "p_size", "p_brand")
    ends = p.groupBy("code").agg(F.min_by(row, "p_partkey").alias("a"), F.max_by(row, "p_partkey").alias("b")).select("code", F.explode(F.array("a", "b")).alias("r"))
    rows = ends.select("code", F.col("r.p_name").alias("description"), F.when(F.expr("r.p_partkey % 7 = 0"), "x").otherwise(F.col("r.p_size").cast("string")).alias("length"), (F.col("r.p_size") / 4).alias("height"), F.col("r.p_brand").alias("group"), F.col("r.p_partkey").alias("k"))
    path = _folder(spark)
    rows.coalesce(1).sortWithinPartitions("k").drop("k").write.csv(path, header=True)
    return R.read_size_types(spark, path, {"0000": "override", "A026": "loses"}).filter("description <> 'loses'")


@query("""SELECT owner, name FROM (SELECT substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ',CAST(c_custkey%26 AS INT)+1,1)||'BC'||CASE WHEN c_custkey%3=0 THEN 'U' WHEN c_custkey%3=1 THEN 'J' ELSE 'UU' END AS owner, c_name AS name FROM customer) t WHERE owner LIKE '___U' """)
def owner_file(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    path = _folder(spark)
    c.selectExpr("concat(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(c_custkey % 26 as int) + 1, 1), 'BC', CASE c_custkey % 3 WHEN 0 THEN 'U' WHEN 1 THEN 'J' ELSE 'UU' END)", "c_name").write.csv(path)
    return R.read_owners(spark, path).select("owner", F.col("_c1").alias("name"))


@query("""SELECT 'f'||p_partkey AS fragment, i AS "rank", 'c'||(p_partkey*10+i) AS candidate FROM (SELECT p_partkey, unnest(range(0, p_partkey%4)) AS i FROM part) t""")
def candidate_lists(spark, sf_dir):
    lines = _table(spark, sf_dir, "part").selectExpr("concat_ws(',', concat('f', p_partkey), array_join(transform(filter(sequence(0, 3), i -> i < p_partkey % 4), i -> concat(' c', p_partkey * 10 + i)), ',')) AS value")
    return R.read_candidates(spark, _text(lines, _folder(spark))).select("fragment", F.col("rank").cast("long").alias("rank"), "candidate")


@query("""SELECT CASE WHEN event_id%3=0 THEN 'step '||event_id WHEN event_id%3=1 THEN 'step '||event_id||' took '||(event_id%90)||'.25 s' ELSE 'read in '||(event_id%7)||'.5s, 3 s' END AS line,
 CASE WHEN event_id%3=1 THEN event_id%90+0.25 WHEN event_id%3=2 THEN event_id%7+0.5 END AS seconds FROM events""")
def run_log(spark, sf_dir):
    lines = _table(spark, sf_dir, "events").selectExpr("CASE event_id % 3 WHEN 0 THEN concat('step ', event_id) WHEN 1 THEN concat('step ', event_id, ' took ', event_id % 90, '.25 s') ELSE concat('read in ', event_id % 7, '.5s, 3 s') END AS value")
    return R.read_run_log(spark, _text(lines, _folder(spark))).select("line", "seconds")


@query("""SELECT 't'||event_id AS timestamp, 'g'||(user_id%8) AS name, CASE WHEN event_id%5=0 THEN NULL ELSE CAST(event_id%90 AS DOUBLE) END AS temperature, CAST(event_id%101 AS DOUBLE) AS gpu, CAST(8192 AS DOUBLE) AS total, CAST(event_id%8000 AS DOUBLE) AS free,
 CAST(8192-event_id%8000 AS DOUBLE) AS used, round((8192-event_id%8000)/8192.0,3) AS ratio FROM events""")
def gpu_snapshots(spark, sf_dir):
    path = _folder(spark)
    _text(_table(spark, sf_dir, "events").selectExpr("concat_ws(', ', concat('t', event_id), concat('g', user_id % 8), 'p', 'd', 'P0', '4', '3', if(event_id % 5 = 0, '[N/A]', cast(event_id % 90 as string)), event_id % 101, event_id % 100, 8192, event_id % 8000) AS value"), path)
    return R.read_gpu_csv(spark, path).select("timestamp", "name", F.when(~F.isnan("temperature"), F.col("temperature")).alias("temperature"), "gpu", "total", "free", "used", "ratio")


@query(oracle("QUAD", """, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_id)-1 AS item FROM f_quad)
SELECT 'img'||image_id||'.jpg' AS image, item, text||' "q"' AS transcription, round(x1,6) AS x1, round(y2,6) AS y2 FROM r"""))
def recognised_labels(spark, sf_dir):
    """Lines of an image's items as JSON, as written for detection, and read as labels."""
    q = fixture(spark, sf_dir, "QUAD")
    at = lambda x, y: F.array(F.col(x), F.col(y))
    rows = q.select(F.concat(F.lit("img"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("image"), F.col("det_id").alias("item"), F.concat("text", F.lit(' "q"')).alias("transcription"), F.array(at("x1", "y1"), at("x2", "y1"), at("x2", "y2"), at("x1", "y2")).alias("points"))
    lines = W.det_label_lines(rows)
    # Some lines have four blanks instead of the tab.
    lines = lines.select(F.when(F.crc32("line") % 3 == 0, F.regexp_replace("line", "\t", "    ")).otherwise(F.col("line")).alias("value"))
    got = R.read_ocr_labels(spark, _text(lines, _folder(spark)))
    return _round(got.select("image", F.col("item").cast("long").alias("item"), "transcription", F.col("points")[0][0].alias("x1"), F.col("points")[2][1].alias("y2")), "x1", "y2")


@query(oracle("LABEL", """ SELECT cls, CASE WHEN p THEN round(round(xc,6)+0.05,6) ELSE round(xc,6) END AS xc, round(yc,6) AS yc, CASE WHEN p THEN 0.1 ELSE round(w,6) END AS w, CASE WHEN p THEN 0.0 ELSE round(h,6) END AS h, CASE WHEN p THEN 3 END AS points
FROM (SELECT *, line_no%5=0 AS p FROM f_label) t"""))
def label_files(spark, sf_dir):
    """Box lines as they are written, and for some labels polygons instead."""
    labels = fixture(spark, sf_dir, "LABEL")
    polygon = F.format_string("%d %.6f %.6f %.6f %.6f %.6f %.6f", F.col("cls").cast("int"), "xc", "yc", F.round("xc", 6) + 0.1, "yc", "xc", "yc")
    lines = labels.select(F.when(F.col("line_no") % 5 == 0, polygon).otherwise(W.label_row()).alias("value"))
    got = R.read_det_labels(spark, _text(lines, _folder(spark)))
    return _round(got.select(F.col("cls").cast("long").alias("cls"), "xc", "yc", "w", "h", F.when(F.col("points").isNotNull(), F.size("points")).alias("points")), "xc", "yc", "w", "h")


@query(oracle("LABEL", """ SELECT round(xc,6) AS xc, round(yc,6) AS yc, round(w,6) AS w, round(h,6) AS h, 0.25 AS x1, CASE WHEN line_no%4<>0 THEN 0.5 END AS x3 FROM f_label WHERE line_no%7<>0"""))
def landmark_files(spark, sf_dir):
    value = F.format_string("0 %.6f %.6f %.6f %.6f 0.25 0.125 0.3 0.4 %s 0.7 0.8 0.9", "xc", "yc", "w", "h", F.when(F.col("line_no") % 4 == 0, "-1").otherwise("0.5"))
    lines = fixture(spark, sf_dir, "LABEL").select(F.when(F.col("line_no") % 7 == 0, F.lit("0 0.5 0.5 0.1 0.1")).otherwise(value).alias("value"))
    got = R.read_landmark_labels(spark, _text(lines, _folder(spark)))
    return got.select("xc", "yc", "w", "h", F.col("landmarks")[0]["x"].alias("x1"), F.col("landmarks")[2]["x"].alias("x3"))


_PIXEL = """, b AS (SELECT image_id, det_id, cls, CAST(floor(greatest(x1,1)) AS INT) AS l, CAST(floor(greatest(y1,1)) AS INT) AS t, CAST(floor(x2-x1) AS INT) AS w, CAST(floor(y2-y1) AS INT) AS h FROM f_box)"""


def _pixels(spark, sf_dir) -> DataFrame:
    whole = lambda x: F.floor(x).cast("int")
    b = fixture(spark, sf_dir, "BOX")
    return b.select("image_id", "det_id", "cls", whole(F.greatest("x1", F.lit(1.0))).alias("l"), whole(F.greatest("y1", F.lit(1.0))).alias("t"), whole(F.col("x2") - F.col("x1")).alias("w"), whole(F.col("y2") - F.col("y1")).alias("h"))


_UNIT = "round((l+w/2.0)/2000,9) AS xc, round((t+h/2.0)/1000,9) AS yc, round(w/2000.0,9) AS w, round(h/1000.0,9) AS h"


def _unit(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(c, 9).alias(c) for c in ("xc", "yc", "w", "h")])


@query(oracle("BOX", _PIXEL + """ SELECT 'i'||image_id||'.jpg' AS image, CASE WHEN cls=0 THEN 0 ELSE 1 END AS cls, round(((l+l+w)/2.0-1)/2000,9) AS xc, round(((t+t+h)/2.0-1)/1000,9) AS yc, round(w/2000.0,9) AS w, round(h/1000.0,9) AS h FROM b WHERE det_id%6<>0 AND det_id%11<>0"""))
def voc_files(spark, sf_dir):
    b = _pixels(spark, sf_dir)
    item = F.format_string("<object><name>%s</name><difficult>%d</difficult><bndbox><xmin>%d</xmin><ymin>%d</ymin><xmax>%d</xmax><ymax>%d</ymax></bndbox></object>", F.when(F.expr("det_id % 11 = 0"), "other").when(F.col("cls") == 0, "car").otherwise("box"), F.expr("int(det_id % 6 = 0)"), "l", "t", F.col("l") + F.col("w"), F.col("t") + F.col("h"))
    docs = b.groupBy("image_id").agg(F.array_join(F.collect_list(item), "").alias("objects"))
    lines = docs.select(F.format_string("<annotation><filename>i%d.jpg</filename><size><width>2000</width><height>1000</height></size>%s</annotation>", "image_id", "objects").alias("value"), F.col("image_id").alias("part"))
    return _unit(R.import_voc(spark, _text(lines, _folder(spark), "part"), ["car", "box"]), "image", "cls")


def _sizes(b: DataFrame, name) -> DataFrame:
    return b.select(name.alias("image"), F.lit(2000.0).alias("width"), F.lit(1000.0).alias("height")).distinct()


@query(oracle("BOX", _PIXEL + f""" SELECT 'i'||image_id AS image, CAST(cls AS INT) AS cls, {_UNIT} FROM b WHERE det_id%5<>0"""))
def visdrone_files(spark, sf_dir):
    b = _pixels(spark, sf_dir)
    name = F.concat(F.lit("i"), F.col("image_id").cast("string"))
    lines = b.select(name.alias("image"), F.format_string("%d,%d,%d,%d,%d,%d,0,0", "l", "t", "w", "h", F.expr("int(det_id % 5 <> 0)"), (F.col("cls") + 1).cast("int")).alias("value"))
    return _unit(R.import_visdrone(spark, _text(lines.repartition("image"), _folder(spark), "image"), _sizes(b, name)), "image", "cls")


@query(oracle("BOX", _PIXEL + """ SELECT 'i'||image_id||'.jpg' AS image, CAST(cls AS INT) AS cls, CASE WHEN cls=0 THEN 'a' ELSE 'b' END AS name, round((least(l,600)+least(l+w,600))/2.0/600,9) AS xc, round((t+t+h)/2.0/2000,9) AS yc, round((least(l+w,600)-least(l,600))/600.0,9) AS w, round(h/2000.0,9) AS h FROM b WHERE det_id%9<>0"""))
def coco_files(spark, sf_dir):
    """One document for some images, numbered from 0 in each; boxes reach beyond an image of 600 pixels' width."""
    b = _pixels(spark, sf_dir).withColumns({"part": F.expr("image_id div 100"), "id": F.expr("image_id % 100 div 20")})
    note = F.struct(F.col("id").alias("image_id"), F.when(F.col("cls") == 0, 7).otherwise(30).alias("category_id"), F.expr("int(det_id % 9 = 0)").alias("iscrowd"), F.array("l", "t", "w", "h").alias("bbox"))
    image = F.struct("id", F.concat(F.lit("i"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(600).alias("width"), F.lit(2000).alias("height"))
    kinds = F.array(F.struct(F.lit(30).alias("id"), F.lit("b").alias("name")), F.struct(F.lit(7).alias("id"), F.lit("a").alias("name")))
    docs = b.groupBy("part").agg(F.to_json(F.struct(F.collect_set(image).alias("images"), kinds.alias("categories"), F.collect_list(note).alias("annotations"))).alias("value"))
    return _unit(R.import_coco(spark, _text(docs, _folder(spark), "part")).withColumn("cls", F.col("cls").cast("int")), "image", "cls", "name")


@query(oracle("BOX", _PIXEL + f""" SELECT 'i'||image_id||'.tif' AS image, CASE WHEN cls=0 THEN 3 ELSE 1 END AS cls, {_UNIT} FROM b WHERE det_id%7<>0 AND det_id%13<>0"""))
def geojson_files(spark, sf_dir):
    b = _pixels(spark, sf_dir)
    name = F.concat(F.lit("i"), F.col("image_id").cast("string"), F.lit(".tif"))
    bounds = F.when(F.expr("det_id % 7 = 0"), F.lit("1,2,3")).otherwise(F.concat_ws(",", "l", "t", F.col("l") + F.col("w"), F.col("t") + F.col("h")))
    kind = F.when(F.expr("det_id % 13 = 0"), 99).when(F.col("cls") == 0, 11).otherwise(12)
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(bounds.alias("bounds_imcoords"), name.alias("image_id"), kind.alias("type_id")).alias("properties"))
    docs = b.groupBy(F.expr("image_id div 100").alias("part")).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value"))
    got = R.import_geojson(spark, _text(docs, _folder(spark), "part"), {11: 3, 12: 1}, _sizes(b, name))
    return _unit(got, "image", "cls")


@query(oracle("BOX", _PIXEL + f""" SELECT 'i'||image_id||'.jpg' AS image, 0 AS cls, {_UNIT} FROM b"""))
def pixel_files(spark, sf_dir):
    path = _folder(spark)
    _pixels(spark, sf_dir).select(F.concat(F.lit("i"), F.col("image_id").cast("string"), F.lit(".jpg")), "l", "t", F.col("l") + F.col("w"), F.col("t") + F.col("h"), F.lit("object"), F.lit(2000), F.lit(1000)).write.csv(path)
    return _unit(R.import_pixel_csv(spark, path), "image", "cls")


@query(oracle("EVOLVE", " SELECT CAST(generation AS DOUBLE) AS generation, p, round(r,9) AS r, map50, map FROM f_evolve"))
def evolution_file(spark, sf_dir):
    path = _folder(spark)
    names = ["generation", "p", "r", "map50", "map"]
    fixture(spark, sf_dir, "EVOLVE").select(*[F.concat(F.lit("   "), F.col(c).cast("string"), F.lit(" ")).alias(f"   {c} ") for c in names]).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return R.read_evolve(spark, path).withColumn("r", F.round("r", 9))


@query("""SELECT 'p'||page_id||'.png' AS filename, CAST(n AS INT) AS tokens, CAST(n%3 AS INT) AS cells FROM (SELECT page_id, length(coalesce(html,''))%12 AS n FROM pages) t WHERE n BETWEEN 1 AND 8""")
def table_files(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").selectExpr("page_id", "length(coalesce(html, '')) % 12 AS n")
    tokens = F.array_repeat(F.lit("<td>"), F.col("n").cast("int"))
    cells = F.array_repeat(F.struct(F.array(F.lit("a")).alias("tokens"), F.array(F.lit(1.0), F.lit(2.0)).alias("bbox")), (F.col("n") % 3).cast("int"))
    html = F.struct(F.struct(tokens.alias("tokens")).alias("structure"), cells.alias("cells"))
    path = _folder(spark)
    p.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".png")).alias("filename"), html.alias("html")).write.json(path)
    return R.read_table_dataset(spark, path, 8).select("filename", F.size("html.structure.tokens").alias("tokens"), F.size("html.cells").alias("cells"))


@query(oracle("OBS", """ SELECT lane AS channel, strftime(ts,'%y%m%d') AS day, frame_no, 'f'||frame_no AS front FROM f_obs WHERE frame_no%4<>0"""))
def pass_archive(spark, sf_dir):
    o = fixture(spark, sf_dir, "OBS").selectExpr("lane as channel", "date_format(ts, 'yyMMdd') as day", "frame_no", "if(frame_no % 4 = 0, null, concat('f', frame_no)) as front", "'r' as rear", "'l' as left", "'t' as top", "'x' as right")
    path = _folder(spark)
    W.write_archive(o, path)
    W.write_archive(o, path)  # writing the days again replaces them
    return spark.read.parquet(path).select("channel", F.col("day").cast("string").alias("day"), "frame_no", "front")


@query(oracle("READ", """, a AS (SELECT DISTINCT text FROM f_read WHERE seq%2=0), b AS (SELECT DISTINCT text FROM f_read WHERE seq%2=1)
SELECT 'both' AS kind, text FROM (SELECT text FROM a INTERSECT SELECT text FROM b) t UNION ALL SELECT 'even', text FROM (SELECT text FROM a EXCEPT SELECT text FROM b) t"""))
def shared_readings(spark, sf_dir):
    """Texts that were read in places of both kinds, and those read in even places only."""
    r = fixture(spark, sf_dir, "READ")
    kinds = r.groupBy("text").agg(F.max(F.col("seq") % 2 == 0).alias("a"), F.max(F.col("seq") % 2 == 1).alias("b"))
    return kinds.filter("a").select(F.when(F.col("b"), "both").otherwise("even").alias("kind"), "text")


@query(oracle("READ", """, w AS (SELECT pass_id, min_by(text, seq) AS first, count(*) AS k FROM f_read GROUP BY pass_id),
l AS (SELECT f.pass_id, f.seq, substr(f.text,1,CAST(least(length(first),10) AS INT)) AS t FROM f_read f JOIN w ON w.pass_id=f.pass_id),
c AS (SELECT pass_id, p, substr(t,CAST(p AS INT),1) AS ch, count(*) AS k, min(seq) AS first FROM l, LATERAL (SELECT unnest(range(1,length(t)+1)) AS p) u GROUP BY pass_id, p, ch),
b AS (SELECT pass_id, p, ch, row_number() OVER (PARTITION BY pass_id,p ORDER BY k DESC, first) AS r FROM c),
v AS (SELECT pass_id, string_agg(ch,'' ORDER BY p) AS voted FROM b WHERE r=1 GROUP BY pass_id)
SELECT w.pass_id, CASE WHEN w.k<=2 THEN substr(first,1,10) ELSE v.voted END AS voted FROM w JOIN v ON v.pass_id=w.pass_id"""))
def first_length_vote(spark, sf_dir):
    return fusion.vote_code(fixture(spark, sf_dir, "READ"), "pass_id", "text", "seq")
