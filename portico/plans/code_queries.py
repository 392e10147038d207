"""Queries over readings of container codes, size-types and plates."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..functions import codes as C
from ..operators import dimensions as dim
from ..operators import fusion
from .fixtures import fixture, oracle
from .registry import query

_LIST = ", ".join(f"'{c}'" for c in dim.size_codes())
_SUM = lambda c, n=10: "+".join(f"(instr('{C.VALUES}',substr({c},{i},1))-1)*{1 << (i - 1)}" for i in range(1, n + 1))
_DIGIT = lambda c, n=10: f"CASE WHEN regexp_matches({c},'^[A-Z]{{4}}[0-9]{{6}}') THEN CAST(({_SUM(c, n)})%11%10 AS VARCHAR) ELSE '0' END"
_VALID = lambda c: f"(regexp_full_match({c},'[A-Z]{{4}}[0-9]{{7}}') AND {_DIGIT(c)}=substr({c},11,1))"
_COMPLETE = lambda c: f"CASE WHEN length({c}) IN (10,11) AND regexp_matches({c},'^[A-Z]{{4}}[0-9]{{6}}') THEN substr({c},1,10)||{_DIGIT(c)} ELSE {c} END"
_HEAD = lambda c: f"regexp_extract({c},'^(.*?)([^A-Za-z]*)$',1)"
_NUMBER = lambda c: f"regexp_extract({c},'^(.*?)([^A-Za-z]*)$',2)"
_CASES = lambda c, table, i: "CASE substr({},{},1) ".format(c, i) + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in table.items()) + " END"


@query(oracle("READ", f"""
SELECT pass_id, seq, text, {_VALID('text')} AS valid, {_DIGIT('text')} AS digit, {_DIGIT('text', 9)} AS legacy_digit, {_COMPLETE('text')} AS completed,
 {_HEAD('text')} AS head, {_NUMBER('text')} AS number FROM f_read"""))
def code_check_digits(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ")
    return r.select(
        "pass_id", "seq", "text", C.is_valid_code("text").alias("valid"), C.check_digit("text").alias("digit"), C.check_digit("text", legacy=True).alias("legacy_digit"),
        C.complete_code("text").alias("completed"), C.split_head("text").alias("head"), C.split_number("text").alias("number"),
    )


@query(oracle("READ", """
SELECT pass_id, seq, text,
 regexp_full_match(text,'[A-Za-z]{3}U[0-9]*|[A-Za-z]{2}U[0-9]+|[A-Za-z]U[0-9]+|U[0-9]+') AND length(text)>=4 AS is_part,
 regexp_full_match(text,'[A-Za-z]{3}[Uu][0-9]*') AS good_head, regexp_full_match(text,'[0-9]{2,7}') AS good_body,
 regexp_full_match(text,'[0-9]') AS end_digit, regexp_full_match(text,'[A-Za-z]{3}U') AS owner_code, regexp_matches(text,'^[0-9]{6}') AS six_digits,
 length(text) IN (9,10) AND regexp_full_match(text,'[A-Za-z]{3}[Uu][0-9]*') AS candidate
FROM (SELECT pass_id, seq, substr(text,CAST(seq%3 AS INT)+1,CAST(4+(pass_id*seq)%8 AS INT)) AS text FROM f_read) t"""))
def code_structure_flags(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ").select("pass_id", "seq", F.expr("substr(text, cast(seq%3 as int)+1, cast(4+(pass_id*seq)%8 as int))").alias("text"))
    return r.select("pass_id", "seq", "text", *[v.alias(k) for k, v in C.code_flags("text").items()])


_W = "".join((C.FIRST, C.SECOND, C.THIRD, C.FOURTH))
_P3, _P2 = C._runs((C.FIRST, C.SECOND, C.THIRD, C.FOURTH), 3), C._runs((C.FIRST, C.SECOND, C.THIRD, C.FOURTH), 2)


@query(oracle("READ", f"""
SELECT pass_id, seq, size_text, size_text IN ({_LIST}) AS known, regexp_full_match(size_text,'{"".join(C.LIVE)}') AS live,
 regexp_full_match(old,'([A-Za-z]{{2}})?{"".join(C.OLD)}') AS old_type,
 regexp_full_match(part,'{"|".join(C._runs(C.PART, n) for n in (3, 2, 1))}') AS partial,
 CASE WHEN regexp_full_match(longer,'{_W}') OR regexp_full_match(longer,'[A-Za-z]{{2}}{"".join(C.OLD)}') THEN 'good'
  WHEN regexp_full_match(longer,'{_P3}|{_P2}') OR (length(longer) BETWEEN 5 AND 7 AND regexp_full_match(longer,'({_W}|{_P3}).{{1,4}}')) THEN 'candidate' ELSE 'none' END AS class
FROM (SELECT *, substr('US'||CAST(2000+(pass_id*13+seq)%999 AS VARCHAR),CAST(1+2*(seq%2) AS INT)) AS old, substr(size_text,CAST(1+seq%3 AS INT),CAST(1+pass_id%3 AS INT)) AS part,
 substr(size_text||text,CAST(1+seq%2 AS INT),CAST(2+pass_id%6 AS INT)) AS longer FROM f_read) t"""))
def size_type_flags(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ").selectExpr(
        "*", "substr(concat('US', cast(2000+(pass_id*13+seq)%999 as string)), cast(1+2*(seq%2) as int)) as old",
        "substr(size_text, cast(1+seq%3 as int), cast(1+pass_id%3 as int)) as part", "substr(concat(size_text,text), cast(1+seq%2 as int), cast(2+pass_id%6 as int)) as longer")
    return r.select(
        "pass_id", "seq", "size_text", F.col("size_text").isin(dim.size_codes()).alias("known"), C.is_live_size_type("size_text").alias("live"), C.is_old_size_type("old").alias("old_type"),
        C.is_partial_size_type("part").alias("partial"), C.size_type_class("longer").alias("class"),
    )


_DIM = ", ".join("('{}','{}',{},{})".format(*row[:4]) for row in {r[0]: r for r in dim.SIZE_TYPES}.values())


@query(oracle("READ", f""", s(code,description,length,height) AS (VALUES {_DIM})
SELECT pass_id, seq, size_text, {_CASES('size_text', C.LENGTH_FEET, 1)} AS length_feet, {_CASES('size_text', C.SECOND_SIZE, 2)} AS second_size,
 {_CASES('size_text', C.TYPE_GROUPS, 3)} AS type_group, s.description, CAST(s.length AS DOUBLE) AS length, CAST(s.height AS DOUBLE) AS height
FROM f_read LEFT JOIN s ON s.code=size_text"""))
def size_type_decode(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ")
    return fusion.decode_size_types(r, dim.size_types(spark)).select("pass_id", "seq", "size_text", "length_feet", "second_size", "type_group", "description", "length", "height")


@query(oracle("READ", f"""
SELECT class, count(*) AS n, count(inside) AS with_size_type FROM (SELECT CASE WHEN text IS NULL OR text='' THEN 'blank'
 WHEN length(text)=11 AND substr(text,4,1)='U' THEN 'code_11' WHEN text IN ({_LIST}) THEN 'size_type'
 WHEN regexp_full_match(text,'[A-Za-z]{{2}}{"".join(C.OLD)}') THEN 'size_type_84' WHEN regexp_full_match(text,'[0-9]{{7}}') THEN 'digits_7'
 WHEN regexp_full_match(text,'[0-9]|[0-9]{{3}}') THEN 'digits_1_3' WHEN regexp_full_match(text,'[0-9]{{1,6}}') THEN 'digits_less_7'
 WHEN regexp_full_match(text,'[0-9]{{8,}}') THEN 'digits_over_7' WHEN regexp_full_match(text,'[A-Za-z]{{3}}U') THEN 'head_4'
 WHEN regexp_full_match(text,'[A-Za-z]{{0,2}}U') THEN 'head_less_4' WHEN regexp_full_match(text,'[A-Za-z]{{4,}}U') THEN 'head_over_4'
 WHEN regexp_full_match(text,'[A-Za-z]+') THEN 'letters' WHEN length(text)>11 AND contains(text,'U') THEN 'over_11'
 WHEN regexp_full_match(text,'[A-Za-z]{{4}}[0-9]{{6}}') THEN 'code_10' ELSE 'rest' END AS class,
 list_filter(list_transform(range(1,greatest(length(text)-2,2)),lambda i: substr(text,i,4)),lambda s: s IN ({_LIST}))[1] AS inside
 FROM (SELECT substr(text||size_text,CAST(1+(pass_id+seq)%8 AS INT),CAST((pass_id*seq)%15 AS INT)) AS text FROM f_read) t) u GROUP BY class"""))
def token_classes(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ").selectExpr("substr(concat(text,size_text), cast(1+(pass_id+seq)%8 as int), cast((pass_id*seq)%15 as int)) as text")
    known = dim.size_codes()
    return r.select(C.token_class("text", known).alias("class"), C.size_type_inside("text", known).alias("inside")).groupBy("class").agg(F.count("*").alias("n"), F.count("inside").alias("with_size_type"))


_REST = lambda c: f"translate({c},'BODA','8004')"


@query(oracle("READ PLATE", f"""
SELECT 'code' AS kind, CAST(text AS VARCHAR) AS raw, CASE WHEN length(text)>8 THEN translate(substr(text,1,4),'1408','IAOB')||{_REST('substr(text,5)')} WHEN length(text)>4 THEN {_REST('text')} ELSE text END AS fixed, count(*) AS n
FROM (SELECT substr(replace(text,'5','B'),1,CAST(11-pass_id%9 AS INT)) AS text FROM f_read) t GROUP BY ALL
UNION ALL SELECT 'plate', text, translate(text,'OI','01'), count(*) FROM f_plate GROUP BY ALL"""))
def normalized_readings(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ").selectExpr("substr(replace(text,'5','B'), 1, cast(11-pass_id%9 as int)) as raw")
    p = fixture(spark, sf_dir, "PLATE").select(F.col("text").alias("raw"))
    both = r.select(F.lit("code").alias("kind"), "raw", C.normalize_reading("raw").alias("fixed")).unionAll(p.select(F.lit("plate"), "raw", C.normalize_plate("raw")))
    return both.groupBy("kind", "raw", "fixed").agg(F.count("*").alias("n"))


@query(oracle("TEXTS", r"""
SELECT doc_id, md5(translate(text,'ＡＢ０１　','AB01 ')) AS half, length(regexp_replace(lower(text),'[^0-9a-z]','','g')) AS lower_chars,
 length(regexp_replace(text,'[^0-9A-Z]','','g')) AS upper_chars, length(regexp_replace(text,'[^0-9]','','g')) AS digit_chars,
 md5(regexp_replace(text,'[|@#!¡·$€%&()=?¿^*;:,¨´><+]','_','g')) AS cleaned, regexp_matches(text,'[\x{4e00}-\x{9fff}]') AS cjk,
 CAST(length(text)-ceil(length(regexp_replace(text,'[^0-9a-zA-Z ]','','g'))/2) AS BIGINT) AS width FROM f_texts"""))
def text_cleanup(spark, sf_dir):
    t = fixture(spark, sf_dir, "TEXTS")
    return t.select(
        "doc_id", F.md5(C.to_half_width("text")).alias("half"), *[C.vocabulary_length("text", k).cast("long").alias(f"{k}_chars") for k in ("lower", "upper", "digit")],
        F.md5(C.clean_name("text")).alias("cleaned"), C.has_cjk("text").alias("cjk"), C.text_width("text").cast("long").alias("width"),
    )


_VOTE = """, l AS (SELECT pass_id, seq, {t} AS t, length({t}) AS n FROM {f} WHERE {t} IS NOT NULL AND {t}<>''),
m AS (SELECT pass_id, max(n) AS n FROM l GROUP BY pass_id),
c AS (SELECT l.pass_id, p, substr(t,CAST(p AS INT),1) AS ch, count(*) AS k, min(seq) AS first FROM l JOIN m USING (pass_id), LATERAL (SELECT unnest(range(1,m.n+1)) AS p) u GROUP BY l.pass_id, p, ch),
b AS (SELECT pass_id, p, ch, row_number() OVER (PARTITION BY pass_id,p ORDER BY k DESC, first) AS r FROM c),
v AS (SELECT pass_id, string_agg(ch,'' ORDER BY p) AS voted FROM b WHERE r=1 GROUP BY pass_id)"""


@query(oracle("READ", _VOTE.format(t="text", f="f_read") + f", x AS (SELECT pass_id, voted, {_COMPLETE('voted')} AS completed FROM v) SELECT pass_id, voted, completed, {_VALID('completed')} AS valid FROM x"))
def positional_vote(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ")
    voted = fusion.positional_vote(r, "pass_id", "text", "seq").withColumn("completed", C.complete_code("voted"))
    return voted.withColumn("valid", C.is_valid_code("completed"))


@query(oracle("READ", _VOTE.format(t="text", f="f_read") + _VOTE.format(t="size_text", f="f_read").replace(", l AS", ", l2 AS").replace("m AS", "m2 AS").replace("c AS", "c2 AS").replace("b AS", "b2 AS").replace("v AS", "v2 AS").replace("FROM l ", "FROM l2 ").replace("JOIN m ", "JOIN m2 ").replace("m.n", "m2.n").replace("l.pass_id", "l2.pass_id").replace("FROM c)", "FROM c2)").replace("FROM b ", "FROM b2 ") + """
SELECT coalesce(v.pass_id,v2.pass_id) AS pass_id, coalesce(v.voted,'')||coalesce(v2.voted,'') AS voted, v.voted AS number, v2.voted AS size_type FROM v FULL JOIN v2 ON v.pass_id=v2.pass_id"""))
def pass_vote(spark, sf_dir):
    return fusion.pass_vote(fixture(spark, sf_dir, "READ"))


@query(oracle("PLATE", """, g AS (SELECT * FROM f_plate WHERE score>=0.5 AND length(text)=7 AND regexp_matches(substr(text,2,1),'[A-Za-z]')),
o AS (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY det_score DESC, seq) AS r, count(*) OVER (PARTITION BY pass_id) AS k FROM g),
t AS (SELECT * FROM o WHERE k<=3 OR r<=3),
c AS (SELECT pass_id, p, substr(translate(text,'OI','01'),CAST(p AS INT),1) AS ch, count(*) AS n, min(seq) AS first FROM t, LATERAL (SELECT unnest(range(1,8)) AS p) u GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY pass_id,p ORDER BY n DESC, first) AS rr FROM c),
v AS (SELECT pass_id, string_agg(ch,'' ORDER BY p) AS voted FROM b WHERE rr=1 GROUP BY pass_id)
SELECT v.pass_id, voted, o.seq AS best_seq, k AS readings FROM v JOIN o ON o.pass_id=v.pass_id AND o.r=1"""))
def plate_pass(spark, sf_dir):
    good = fusion.filter_plates(fixture(spark, sf_dir, "PLATE")).withColumn("text", C.normalize_plate("text"))
    return fusion.plate_pass(good)


#: The repair of each distinct size-type, as table sr.
_SIZE_REPAIR = f"""
, dm(code,place) AS (VALUES {", ".join(f"('{r[0]}',{i})" for i, r in enumerate(dim.SIZE_TYPES))}),
dp AS (SELECT DISTINCT code, place, unnest([code,substr(code,2),code[1]||substr(code,3),substr(code,1,2)||code[4],substr(code,1,3)]) AS fragment FROM dm),
c AS (SELECT fragment, code AS candidate, row_number() OVER (PARTITION BY fragment ORDER BY place)-1 AS rank FROM dp WHERE regexp_full_match(fragment,'{"|".join("".join(x) for n in (3, 4) for x in itertools.combinations(C.LIVE, n))}')),
d AS (SELECT DISTINCT size_text AS code FROM f_read),
f AS (SELECT d.code, list(c.candidate ORDER BY c.rank) FILTER (c.candidate IS NOT NULL) AS l FROM d LEFT JOIN c ON c.fragment=d.code GROUP BY d.code),
f4 AS (SELECT d.code, min_by(c.candidate,c.rank) AS x FROM d JOIN c ON c.fragment=substr(d.code,1,4) GROUP BY d.code),
f3 AS (SELECT d.code, min_by(c.candidate,c.rank) AS x FROM d JOIN c ON c.fragment=substr(d.code,1,3) GROUP BY d.code),
sr AS (SELECT f.code, CASE WHEN f.code IN ({_LIST}) THEN f.code WHEN l IS NOT NULL AND length(f.code)=3 AND list_contains(l,f.code||'1') THEN f.code||'1'
 WHEN l IS NOT NULL AND length(f.code)=3 AND f.code[1]='2' AND list_contains(l,'2'||f.code) THEN '2'||f.code
 WHEN l IS NOT NULL AND length(f.code)=3 AND f.code[1]='5' AND list_contains(l,'4'||f.code) THEN '4'||f.code
 WHEN l IS NOT NULL THEN l[1] WHEN f4.x IS NOT NULL THEN f4.x WHEN f3.x IS NOT NULL THEN f3.x WHEN length(f.code)=4 THEN f.code ELSE '22G1' END AS repaired,
 CASE WHEN f.code IN ({_LIST}) THEN 1 WHEN l IS NOT NULL OR f4.x IS NOT NULL OR f3.x IS NOT NULL THEN 2 ELSE 0 END AS flag
FROM f LEFT JOIN f4 ON f4.code=f.code LEFT JOIN f3 ON f3.code=f.code)"""


@query(oracle("READ", _SIZE_REPAIR + " SELECT * FROM sr"))
def size_type_repair(spark, sf_dir):
    distinct = fixture(spark, sf_dir, "READ").select(F.col("size_text").alias("code")).distinct()
    return fusion.repair_size_types(distinct, dim.size_candidates(spark))


@query(oracle("READ", f"""
, o AS (SELECT DISTINCT substr(true_code,1,4) AS owner FROM f_read WHERE regexp_matches(true_code,'^[A-Z]{{3}}U'))
SELECT key, string_agg(owner,',' ORDER BY owner) AS owners FROM (SELECT '*'||substr(owner,2,2) AS key, owner FROM o
 UNION ALL SELECT substr(owner,1,1)||'*'||substr(owner,3,1), owner FROM o UNION ALL SELECT substr(owner,1,2)||'*', owner FROM o) t GROUP BY key"""))
def owner_wildcards(spark, sf_dir):
    return dim.owner_wildcards(dim.owner_codes(fixture(spark, sf_dir, "READ"))).select("key", F.array_join("owners", ",").alias("owners"))


@query(oracle("READ", f"""
, a AS (SELECT DISTINCT text, {_HEAD('text')} AS h, {_NUMBER('text')} AS n FROM f_read),
e AS (SELECT true_code, {_HEAD('true_code')} AS h, {_NUMBER('true_code')} AS n, min(pass_id) AS rank FROM f_read GROUP BY true_code),
p AS (SELECT text, true_code, rank FROM a JOIN e ON a.h=e.h WHERE levenshtein(a.n,e.n)<=2
 UNION SELECT text, true_code, rank FROM a JOIN e ON substr(a.n,1,3)=substr(e.n,1,3) WHERE levenshtein(a.n,e.n)<=1
 UNION SELECT text, true_code, rank FROM a JOIN e ON right(a.n,3)=right(e.n,3) WHERE levenshtein(a.n,e.n)<=1),
m AS (SELECT text, min_by(true_code,(rank,true_code)) AS matched FROM p GROUP BY text),
z AS (SELECT a.text, m.matched, coalesce(m.matched, (SELECT max_by(true_code,(rank,true_code)) FROM e)) AS ref FROM a LEFT JOIN m ON m.text=a.text)
SELECT text, matched, matched IS NOT NULL AS found, CAST(levenshtein({_HEAD('text')},{_HEAD('ref')})+levenshtein({_NUMBER('text')},{_NUMBER('ref')}) AS INT) AS distance FROM z"""))
def fuzzy_reconciliation(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ", numbered=False)
    expected = r.groupBy("true_code").agg(F.min("pass_id").alias("rank"))
    return fusion.match_against(r.select("text").distinct(), expected, "text", "true_code")


@query(oracle("READ", f"""
, a AS (SELECT DISTINCT pass_id, true_code, text, size_true, size_text FROM f_read)
SELECT text, true_code, size_text, size_true, CAST(levenshtein({_HEAD('text')},{_HEAD('true_code')})+levenshtein({_NUMBER('text')},{_NUMBER('true_code')}) AS INT) AS distance,
 text=true_code OR levenshtein({_NUMBER('text')},{_NUMBER('true_code')})<=CASE WHEN {_HEAD('text')}={_HEAD('true_code')} THEN 2 ELSE 1 END AS matched,
 levenshtein(size_text,size_true)<=1 AS size_matched, count(*) AS n FROM a GROUP BY ALL"""))
def fuzzy_pairs(spark, sf_dir):
    a = fixture(spark, sf_dir, "READ").select("pass_id", "true_code", "text", "size_true", "size_text").distinct()
    return a.select(
        "text", "true_code", "size_text", "size_true", C.code_distance("text", "true_code").alias("distance"), C.code_matches("text", "true_code").alias("matched"), C.size_type_matches("size_text", "size_true").alias("size_matched")
    ).groupBy("text", "true_code", "size_text", "size_true", "distance", "matched", "size_matched").agg(F.count("*").alias("n"))
