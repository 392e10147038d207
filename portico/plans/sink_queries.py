"""Queries of pickers and of lines that leave the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion
from ..operators import passes as P
from ..sources import readers, writers
from .code_queries import _VALID
from .fixtures import fixture, oracle
from .registry import query


@query(oracle("READ", f""" SELECT pass_id, min_by(text,(distance,seq)) AS nearest, min_by(text,(CASE WHEN score>0.95 THEN 0 ELSE 1 END,distance,seq)) AS sure, max_by(text,(CASE WHEN {_VALID('text')} THEN 1 ELSE 0 END,score,-seq)) AS confident FROM f_read GROUP BY pass_id"""))
def picked_readings(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ")
    name = lambda df, n: df.withColumnRenamed("picked", n)
    near = name(fusion.pick_nearest(r, "pass_id"), "nearest").join(name(fusion.pick_nearest(r, "pass_id", 0.95), "sure"), "pass_id")
    return near.join(name(fusion.pick_confident(r, "pass_id"), "confident"), "pass_id")


@query(oracle("READ", r""", l AS (SELECT pass_id, seq, 'XQ'||text||size_text AS t, [substr(text,5,3),substr(text,8,3),substr(text,11,1),'99'] AS parts FROM f_read)
SELECT pass_id, seq, CASE WHEN regexp_matches(t,'^.*[A-Z0-9]{3}U[^U]{7}[^U]*$') THEN regexp_extract(t,'^.*([A-Z0-9]{3}U[^U]{7})[^U]*$',1) END AS window,
 CASE WHEN length(parts[1]||parts[2]||parts[3])<=5 THEN parts[1]||parts[2]||parts[3]||parts[4] ELSE parts[1]||parts[2]||parts[3] END AS number FROM l"""))
def code_windows(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ").select("pass_id", "seq", F.concat(F.lit("XQ"), "text", "size_text").alias("t"), F.array(F.substring("text", 5, 3), F.substring("text", 8, 3), F.substring("text", 11, 1), F.lit("99")).alias("parts"))
    return r.select("pass_id", "seq", fusion.code_window("t").alias("window"), fusion.join_short_numbers(F.col("parts")).alias("number"))


@query(oracle("READ", """ SELECT pass_id, seq, 'img/'||pass_id||'.jpg'||chr(9)||replace(replace(text,' ',''),'"','') AS line, row_number() OVER (PARTITION BY pass_id%16 ORDER BY pass_id, seq) AS idx FROM f_read"""))
def recognition_labels(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ").withColumns({"image": F.concat(F.lit("img/"), F.col("pass_id").cast("string"), F.lit(".jpg")), "shard": F.col("pass_id") % 16, "place": F.struct("pass_id", "seq")})
    return readers.index_shards(r, "shard", "place").select("pass_id", "seq", writers.rec_label_line("image", "text").alias("line"), F.col("idx").cast("long").alias("idx"))


@query(oracle("READ", """ SELECT pass_id, seq, CASE WHEN length(text||size_text)>4 THEN substr(text||size_text,1,length(text||size_text)-4)||' '||right(text||size_text,4) ELSE text||size_text END||CASE WHEN seq%2=0 THEN chr(10)||'door' ELSE '' END||chr(10)||CASE WHEN seq%3=0 THEN 'double' ELSE 'single' END AS record FROM f_read"""))
def ocr_records(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ").selectExpr("pass_id", "seq", "concat(text, size_text) as code", "if(seq%2=0, 'door', null) as front", "cast(null as string) as rear", "if(seq%3=0, 'double', 'single') as load")
    return r.select("pass_id", "seq", writers.ocr_record("code", "front", "rear", "load").alias("record"))


@query(oracle("OBS", """ SELECT frame_no, '[C|'||strftime(ts,'%Y%m%d%H%M%S')||'|'||direction||'|V'||lpad(CAST(frame_no%10000 AS VARCHAR),4,'0')||'|f||l|r|t|10.0.0.1|D]' AS message FROM f_obs"""))
def pass_messages(spark, sf_dir):
    o = fixture(spark, sf_dir, "OBS").selectExpr("frame_no", "ts", "direction as channel", "concat('V', lpad(cast(frame_no%10000 as string), 4, '0')) as vehicle", "'f' as front", "cast(null as string) as rear", "'l' as left", "'r' as right", "'t' as top", "'10.0.0.1' as ip")
    return o.select("frame_no", writers.pass_message().alias("message"))


@query(oracle("LABEL", """ SELECT line_no, image_path, printf('%d %.6f %.6f %.6f %.6f', cls, xc, yc, w, h) AS line FROM f_label"""))
def label_rows(spark, sf_dir):
    return fixture(spark, sf_dir, "LABEL").select("line_no", "image_path", writers.label_row().alias("line"))


@query(oracle("OBS", """, m AS (SELECT frame_no, count(*) FILTER (direction='front' AND state='empty') OVER (ORDER BY ts, frame_no ROWS UNBOUNDED PRECEDING) AS epoch FROM f_obs) SELECT frame_no, CAST(epoch AS BIGINT) AS epoch FROM m"""))
def front_epochs(spark, sf_dir):
    return P.front_epochs(fixture(spark, sf_dir, "OBS"), (F.col("direction") == "front") & (F.col("state") == "empty")).select("frame_no", "epoch")
