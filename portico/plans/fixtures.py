"""Inputs of the registered queries: projections of the driver's tables, one SQL text for both engines.

The texts differ between Spark and the oracle in three points only: the name of the string type, the
access to array elements, and the check sum of a code, which Spark takes from the order's number, since ten
look-ups written out make code that is too large to compile. Rows that a window numbers are dealt out first,
in tasks of about as many rows each however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ALPHABET = "0123456789A_BCDEFGHIJK_LMNOPQRSTU_VWXYZ"
_VALUES = "+".join(f"(instr('{ALPHABET}',substr(base10,{i},1))-1)*{2 ** (i - 1)}" for i in range(1, 11))
_LETTER = lambda i: f"(10+{i}+(9+{i}) div 10)"
#: The same sum from the number: three letters, the U and six digits; a letter's value skips the multiples of 11.
_COUNTED = "+".join([f"{_LETTER(f'((pass_id*{k})%26)')}*{w}" for k, w in ((1, 1), (7, 2), (11, 4))] + ["32*8"] + [f"((pass_id*7919)%1000000 div {10 ** (10 - i)})%10*{2 ** (i - 1)}" for i in range(5, 11)])
#: Lines of a task that numbers them, about.
LINES = 500_000

READ = """
SELECT pass_id, seq, score, distance, true_code, size_true,
 CASE WHEN m=0 THEN substr(true_code,2) WHEN m=1 THEN substr(true_code,1,10)
      WHEN m=2 THEN substr(true_code,1,5)||'8'||substr(true_code,7)
      WHEN m=3 THEN 'M'||substr(true_code,2) ELSE true_code END AS text,
 CASE WHEN m=4 THEN substr(size_true,1,3) WHEN m=5 THEN '' ELSE size_true END AS size_text
FROM (SELECT *, base10||CAST((({VALUES})%11)%10 AS {STR}) AS true_code FROM (
 SELECT l_orderkey AS pass_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey) AS BIGINT) AS seq,
  1-l_discount AS score, l_quantity AS distance, (l_partkey*31+l_suppkey)%10 AS m,
  CASE l_orderkey%4 WHEN 0 THEN '22G1' WHEN 1 THEN '42G1' WHEN 2 THEN '45G1' ELSE '22R1' END AS size_true,
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ',CAST(l_orderkey%26 AS INT)+1,1)
  ||substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ',CAST((l_orderkey*7)%26 AS INT)+1,1)
  ||substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ',CAST((l_orderkey*11)%26 AS INT)+1,1)||'U'
  ||lpad(CAST((l_orderkey*7919)%1000000 AS {STR}),6,'0') AS base10
 FROM {{lineitem}}) a) b
"""
OBS = """
SELECT CASE user_id%5 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'top' WHEN 3 THEN 'front' ELSE 'rear' END AS direction,
 ts, event_id AS frame_no, 'L'||CAST(user_id%2 AS {STR}) AS lane,
 CASE WHEN event_id%7=0 THEN 'skipped' WHEN event_type IN ('view','click','purchase') THEN 'present' ELSE 'empty' END AS state
FROM {{events}}
"""
BOX = """
SELECT vec_id-vec_id%20 AS image_id, vec_id AS det_id, label%2 AS cls, least(0.99,0.3+2*abs(e5)) AS conf,
 500+1000*e1-(80+200*abs(e3))/2 AS x1, 500+1000*e2-(80+200*abs(e4))/2 AS y1,
 500+1000*e1+(80+200*abs(e3))/2 AS x2, 500+1000*e2+(80+200*abs(e4))/2 AS y2
FROM ({VEC}) t
"""
GT = """
SELECT vec_id-vec_id%20 AS image_id, vec_id AS det_id, label%2 AS cls,
 500+1000*e1-(80+200*abs(e3))/2+20*e6 AS x1, 500+1000*e2-(80+200*abs(e4))/2+20*e7 AS y1,
 500+1000*e1+(80+200*abs(e3))/2+20*e6 AS x2, 500+1000*e2+(80+200*abs(e4))/2+20*e7 AS y2
FROM ({VEC}) t WHERE vec_id%5<>0
"""
FACE = """
SELECT direction, ts, frame_no, CASE WHEN user_id%3=0 THEN 'door' ELSE 'nodoor' END AS label, value*100 AS area
FROM (SELECT CASE user_id%5 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'top' WHEN 3 THEN 'front' ELSE 'rear' END AS direction,
 ts, event_id AS frame_no, user_id, value, event_type FROM {{events}}) t
WHERE frame_no%7<>0 AND event_type IN ('view','click','purchase')
"""
LABEL = """
SELECT 'set/images/'||CAST(vec_id-vec_id%20 AS {STR})||'.jpg' AS image_path, label%4 AS cls, 0.5+e1 AS xc, 0.5+e2 AS yc,
 CASE WHEN vec_id%17=0 THEN -1 ELSE 1 END*(0.05+abs(e3)) AS w, 0.05+abs(e4) AS h, vec_id*2+k AS line_no
FROM ({VEC}) t CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) u WHERE k=0 OR vec_id%19=0
"""
LOG = """
SELECT event_id, ts, CASE WHEN event_type='error' THEN 'ERROR' ELSE 'INFO' END AS level,
 CASE user_id%5 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'top' WHEN 3 THEN 'front' ELSE 'rear' END AS camera,
 CASE WHEN event_type='error' OR event_id%13=0 THEN 'outage' WHEN event_id%17=0 THEN 'archive V'||CAST(event_id AS {STR}) WHEN event_id%19=0 THEN 'read error' WHEN event_id%23=0 THEN 'ready' ELSE 'panorama '||CAST(CAST(floor(abs(value)) AS BIGINT) AS {STR}) END AS message
FROM {{events}}
"""
RES = """
SELECT event_id AS seq, ts, 'h'||CAST(user_id%3 AS {STR}) AS host, 'cpu:'||CAST(event_id%101 AS {STR})||'% gpu:'||CAST((event_id*7)%101 AS {STR})||'% 显存:'
 ||CAST((event_id*13)%101 AS {STR})||'% 内存:'||CAST((event_id*29)%101 AS {STR})||'%' AS line
FROM {{events}}
"""
LAT = """
SELECT CASE user_id%5 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'top' WHEN 3 THEN 'front' ELSE 'rear' END AS direction,
 event_id AS seq, ts, value/1000 AS seconds, event_id%37 AS depth
FROM {{events}}
"""
PLATE = """
SELECT o_custkey AS pass_id, o_orderkey AS seq,
 CASE WHEN o_orderkey%6=0 THEN replace(replace(plate,'0','O'),'1','I') WHEN o_orderkey%11=0 THEN substr(plate,2) ELSE plate END AS text,
 CAST(o_orderkey%100 AS DOUBLE)/100 AS score, CAST((o_orderkey*17)%1000 AS DOUBLE)/1000 AS det_score
FROM (SELECT *, '冀'||substr('ABCDEFGHJK',CAST(o_custkey%10 AS INT)+1,1)||lpad(CAST((o_custkey*7919)%100000 AS {STR}),5,'0') AS plate FROM {{orders}}) t
"""
TEXTS = "SELECT doc_id, text FROM {{documents}}"
IDX = "SELECT vec_id AS row_id, " + ", ".join(f"CAST(floor(abs(e{i})*20) AS BIGINT)%4 AS i{i}, abs(e{i}) AS p{i}" for i in range(1, 17)) + " FROM ({VEC}) t"
MATCH = """
SELECT vec_id-vec_id%20 AS pair_id, vec_id AS point_id, 500+1000*e1 AS x1, 500+1000*e2 AS y1, 500+1000*e1+500*e6 AS x2, 500+1000*e2+100*e7 AS y2 FROM ({VEC}) t
"""
QUAD = """
SELECT image_id, det_id, det_id%11=0 AS ignore, 'T'||CAST(det_id%50 AS {STR}) AS text, x1, y1, x2, y2 FROM (
SELECT vec_id-vec_id%20 AS image_id, vec_id AS det_id,
 500+1000*e1-(80+200*abs(e3))/2+20*e6 AS x1, 500+1000*e2-(80+200*abs(e4))/2+20*e7 AS y1,
 500+1000*e1+(80+200*abs(e3))/2+20*e6 AS x2, 500+1000*e2+(80+200*abs(e4))/2+20*e7 AS y2
FROM ({VEC}) v WHERE vec_id%5<>0) t
"""
FOUND = """
SELECT image_id, det_id, CASE WHEN det_id%6=0 THEN 'T'||CAST((det_id+1)%50 AS {STR}) ELSE 'T'||CAST(det_id%50 AS {STR}) END AS text, x1, y1, x2, y2 FROM (
SELECT vec_id-vec_id%20 AS image_id, vec_id AS det_id,
 500+1000*e1-(80+200*abs(e3))/2 AS x1, 500+1000*e2-(80+200*abs(e4))/2 AS y1,
 500+1000*e1+(80+200*abs(e3))/2 AS x2, 500+1000*e2+(80+200*abs(e4))/2 AS y2
FROM ({VEC}) v) t
"""
STEPS = "SELECT vec_id AS row_id, CAST(floor(abs(e1)*1000) AS BIGINT) AS a FROM ({VEC}) t"
EVOLVE = """
SELECT p_partkey AS generation, CAST(p_size AS DOUBLE)/50 AS p, p_retailprice/(p_retailprice+1000) AS r,
 CAST((p_partkey*31)%1000 AS DOUBLE)/1000 AS map50, CAST((p_partkey*17)%1000 AS DOUBLE)/1000 AS map FROM {{part}}
"""
ORDERED = {"READ": READ, "OBS": OBS, "BOX": BOX, "GT": GT, "FACE": FACE, "LABEL": LABEL, "LOG": LOG, "RES": RES, "LAT": LAT, "PLATE": PLATE, "TEXTS": TEXTS, "IDX": IDX, "MATCH": MATCH, "QUAD": QUAD, "FOUND": FOUND, "STEPS": STEPS, "EVOLVE": EVOLVE}
_TABLES = ("lineitem", "events", "embeddings", "orders", "documents", "part")


def _vec(spark: bool) -> str:
    take = lambda i: f"element_at(embedding,{i})" if spark else f"embedding[{i}]"
    return "SELECT vec_id, label, " + ", ".join(f"CAST({take(i)} AS DOUBLE) AS e{i}" for i in range(1, 17)) + " FROM {{embeddings}}"


def text_of(name: str, spark: bool) -> str:
    """The SQL of a projection; tables stand in braces for Spark and by name for the oracle."""
    text = ORDERED[name].replace("{VEC}", _vec(spark)).replace("{STR}", "STRING" if spark else "VARCHAR").replace("{VALUES}", _COUNTED if spark else _VALUES)
    for t in _TABLES:
        text = text.replace("{{" + t + "}}", "{" + t + "}" if spark else t)
    return text


def fixture(spark: SparkSession, sf_dir: str, name: str, numbered: bool = True) -> DataFrame:
    """The projection; without ``numbered`` the rows stay where they are, for queries that leave seq out."""
    text = text_of(name, True)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{" + t + "}" in text}
    if name == "READ" and numbered:
        lines = used["lineitem"]
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES))
        used["lineitem"] = lines.repartition(tasks, "l_orderkey")
    return spark.sql(text, **used)


def oracle(names: str, body: str) -> str:
    """body after WITH clauses f_<name> of the named projections; body may go on with ', x AS (...)'."""
    heads = ", ".join(f"f_{n.lower()} AS ({text_of(n, False)})" for n in names.split())
    return f"WITH {heads}{body}" if body.lstrip().startswith(",") else f"WITH {heads} {body}"
