"""Queries that put codes together from loose texts, and decode plates under what is known of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..operators import assemble as A
from ..operators import dimensions as dim
from ..operators import recognise as R
from .code_queries import _LIST, _VALID
from .fixtures import fixture, oracle
from .registry import query

_TEXT = """CASE (pass_id*3+seq)%10 WHEN 0 THEN text WHEN 1 THEN substr(text,1,4) WHEN 2 THEN substr(text,5) WHEN 3 THEN substr(text,5,3) WHEN 4 THEN size_text
 WHEN 5 THEN text||'99' WHEN 6 THEN substr(text,2,3) WHEN 7 THEN substr(text,1,10) WHEN 8 THEN substr(text,5)||'12' ELSE substr(text,5,4) END"""
_PARTS = "|".join(C._runs(C.PART, n) for n in (3, 2, 1))
_TOKENS = f""", tk AS (SELECT pass_id, seq, distance, score, (pass_id*seq*7)%100 AS y, {_TEXT} AS text FROM f_read)"""
_CLASSED = _TOKENS + f""", kl AS (SELECT *, CASE WHEN text IS NULL OR text='' THEN 'blank' WHEN length(text)=11 AND substr(text,4,1)='U' THEN 'code_11' WHEN text IN ({_LIST}) THEN 'size_type'
 WHEN regexp_full_match(text,'[A-Za-z]{{2}}{"".join(C.OLD)}') THEN 'size_type_84' WHEN regexp_full_match(text,'[0-9]{{7}}') THEN 'digits_7'
 WHEN regexp_full_match(text,'[0-9]|[0-9]{{3}}') THEN 'digits_1_3' WHEN regexp_full_match(text,'[0-9]{{1,6}}') THEN 'digits_less_7'
 WHEN regexp_full_match(text,'[0-9]{{8,}}') THEN 'digits_over_7' WHEN regexp_full_match(text,'[A-Za-z]{{3}}U') THEN 'head_4'
 WHEN regexp_full_match(text,'[A-Za-z]{{0,2}}U') THEN 'head_less_4' WHEN regexp_full_match(text,'[A-Za-z]{{4,}}U') THEN 'head_over_4'
 WHEN regexp_full_match(text,'[A-Za-z]+') THEN 'letters' WHEN length(text)>11 AND contains(text,'U') THEN 'over_11'
 WHEN regexp_full_match(text,'[A-Za-z]{{4}}[0-9]{{6}}') THEN 'code_10' ELSE 'rest' END AS class,
 {_VALID('text')} AS valid, regexp_extract(text,'^.*([A-Z0-9]{{3}}U[^U]{{7}})[^U]*$',1) AS win,
 list_filter(list_transform(range(1,greatest(length(text)-2,2)),lambda i: substr(text,i,4)),lambda s: s IN ({_LIST}))[1] AS inside,
 regexp_full_match(text,'{_PARTS}') AS part FROM tk)"""


def _assembled(vertical: bool) -> str:
    near = "(distance,seq)" if vertical else "(distance,y,seq)"
    first = "seq" if vertical else "y, seq"
    best = "(CAST(valid AS INT),score,-seq)" if vertical else "(CAST(valid AS INT),score,-y,-seq)"
    of = ", ".join(f"arg_min(text,{near}) FILTER (class='{c}') AS {c}" for c in ("head_4", "head_less_4", "head_over_4", "digits_7", "digits_less_7", "digits_over_7", "code_10", "rest", "size_type", "size_type_84"))
    tried = ", ".join("||".join(b.split("+")) for b in (A.VERTICAL if vertical else A.HORIZONTAL))
    valid = _VALID("s")
    return f""", g AS (SELECT pass_id, arg_max(text,{best}) FILTER (class='code_11') AS code_11, {of}, arg_min(win,{near}) FILTER (class='over_11' AND length(win)=11) AS over_11,
 list(text ORDER BY {first}) FILTER (class='digits_1_3') AS ns, arg_min(inside,{near}) FILTER (class='rest' AND inside IS NOT NULL) AS inside,
 arg_max(text,(length(text),{'0' if vertical else '-y'},-seq)) FILTER (class='rest' AND part) AS part FROM kl GROUP BY pass_id),
h AS (SELECT *, CASE WHEN ns IS NOT NULL THEN list_reduce(list_prepend('',ns),lambda s,x: CASE WHEN length(s)+length(x)<=7 THEN s||x ELSE s END) END AS short,
 list_transform(range(1,length(digits_over_7)-6),lambda i: right(head_over_4,4)||substr(digits_over_7,i,7)) AS slid FROM g),
i AS (SELECT *, coalesce(list_filter(slid,lambda s: {valid})[1],slid[-1]) AS sliding FROM h),
o AS (SELECT pass_id, coalesce({tried},'') AS code, coalesce(size_type,inside,size_type_84) AS size_type, part FROM i)
SELECT {int(vertical)} AS vertical, pass_id, code, size_type, code||coalesce(' '||coalesce(size_type,part),'') AS text FROM o"""


def _tokens(spark, sf_dir):
    return fixture(spark, sf_dir, "READ").selectExpr("pass_id", "seq", "distance", "score", "(pass_id*seq*7)%100 as y", f"{_TEXT} as text")


@query(oracle("READ", _CLASSED + _assembled(False)))
def assembled_codes(spark, sf_dir):
    return A.assemble_tokens(_tokens(spark, sf_dir), "pass_id", dim.size_codes()).withColumn("vertical", F.lit(0))


@query(oracle("READ", _CLASSED + _assembled(True)))
def assembled_vertical_codes(spark, sf_dir):
    return A.assemble_tokens(_tokens(spark, sf_dir), "pass_id", dim.size_codes(), vertical=True).withColumn("vertical", F.lit(1))


_WHOLE = "".join((C.FIRST, C.SECOND, C.THIRD, C.FOURTH))
_P = f"{C._runs((C.FIRST, C.SECOND, C.THIRD, C.FOURTH), 3)}|{C._runs((C.FIRST, C.SECOND, C.THIRD, C.FOURTH), 2)}"
_PART_LIKE = lambda c: f"(regexp_full_match({c},'[A-Za-z]{{3}}U[0-9]*|[A-Za-z]{{2}}U[0-9]+|[A-Za-z]U[0-9]+|U[0-9]+') AND length({c})>=4)"


@query(oracle("READ", _TOKENS + f""", t AS (SELECT pass_id, seq, CAST(score AS DOUBLE) AS score, text, {_VALID('text')} AS good, length(text) IN (9,10) AND regexp_full_match(text,'[A-Za-z]{{3}}[Uu][0-9]*') AS cand,
 regexp_full_match(text,'[A-Za-z]{{3}}[Uu][0-9]*') AS head, regexp_full_match(text,'[0-9]{{2,7}}') AS body, regexp_full_match(text,'[0-9]') AS fin,
 CASE WHEN regexp_full_match(text,'{_WHOLE}') OR regexp_full_match(text,'[A-Za-z]{{2}}{"".join(C.OLD)}') THEN 2 WHEN regexp_full_match(text,'{_P}') OR (length(text) BETWEEN 5 AND 7 AND regexp_full_match(text,'({_WHOLE}|{C._runs((C.FIRST, C.SECOND, C.THIRD, C.FOURTH), 3)}).{{1,4}}')) THEN 1 ELSE 0 END AS kind FROM tk),
w AS (SELECT pass_id, lim, seq AS h, text AS s, CAST([] AS BIGINT[]) AS used FROM t, (VALUES (11),(9)) l(lim) WHERE head
 UNION ALL SELECT w.pass_id, lim, h, s||b.text, list_append(used,b.seq) FROM w JOIN t b ON b.pass_id=w.pass_id AND b.body AND NOT list_contains(used,b.seq) AND length(s)+length(b.text)<=lim),
f AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.pass_id=w.pass_id AND b.body AND NOT list_contains(w.used,b.seq) AND length(w.s)+length(b.text)<=w.lim)),
en AS (SELECT pass_id, list(text ORDER BY seq) AS ends FROM t WHERE fin GROUP BY pass_id),
m AS (SELECT f.*, list_reduce(list_prepend(s,coalesce(ends,[])),lambda a,x: CASE WHEN length(a)<11 THEN a||x ELSE a END) AS made, row_number() OVER (PARTITION BY f.pass_id ORDER BY -lim, h, used) AS k FROM f LEFT JOIN en ON en.pass_id=f.pass_id),
v AS (SELECT pass_id, arg_min(made,k) AS code FROM m WHERE {_VALID('made')} GROUP BY pass_id),
al AS (SELECT pass_id, text AS x, seq AS k FROM t UNION ALL SELECT pass_id, made, 1000+k FROM m),
lo AS (SELECT pass_id, arg_max(x,(CAST({_PART_LIKE('x')} AS INT),length(x),-k)) AS code FROM al GROUP BY pass_id),
g AS (SELECT pass_id, arg_max(text,(score,-seq)) FILTER (good) AS good, arg_max(text,(CAST({_PART_LIKE('text')} AS INT),length(text),-seq)) FILTER (cand) AS cand,
 arg_max(text,(score,-seq)) FILTER (kind=2) AS t2, arg_max(text,(score,-seq)) FILTER (kind=1) AS t1 FROM t GROUP BY pass_id)
SELECT g.pass_id, coalesce(g.good,v.code,g.cand,lo.code,'') AS code, coalesce(t2,t1,'') AS size_type FROM g LEFT JOIN v ON v.pass_id=g.pass_id LEFT JOIN lo ON lo.pass_id=g.pass_id""").replace("WITH ", "WITH RECURSIVE ", 1))
def generated_codes(spark, sf_dir):
    return A.generate_codes(_tokens(spark, sf_dir), "pass_id")


def _tries(kind: str, table: dict[str, str], at: range, letter: bool) -> str:
    rows = ", ".join(f"('{a}','{b}',{i})" for a, bs in table.items() for i, b in enumerate(bs))
    return f"""SELECT code, substr(code,1,CAST(p AS INT)-1)||b||substr(code,CAST(p AS INT)+1) AS x, {1 if not letter else 0}*1000+p*10+i AS rank, {letter} AS letter
 FROM d, (SELECT unnest(range({at.start},{at.stop})) AS p) q JOIN (VALUES {rows}) {kind}(a,b,i) ON true WHERE substr(code,CAST(p AS INT),1)=a"""


@query(oracle("READ", f""", d AS (SELECT DISTINCT text AS code FROM f_read), ow AS (SELECT DISTINCT substr(true_code,1,4) AS owner FROM f_read WHERE regexp_matches(true_code,'^[A-Z]{{3}}U')),
tr AS ({_tries('l', R.LETTERS, range(1, 4), True)} UNION ALL {_tries('n', R.DIGITS, range(5, 11), False)}),
ok AS (SELECT code, arg_min(x,rank) AS fixed FROM tr WHERE {_VALID('x')} AND (NOT letter OR substr(x,1,4) IN (SELECT owner FROM ow)) GROUP BY code)
SELECT d.code, CASE WHEN {_VALID('d.code')} THEN d.code ELSE coalesce(ok.fixed,d.code) END AS fixed FROM d LEFT JOIN ok ON ok.code=d.code"""))
def confused_codes(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ")
    return A.try_confusions(r.select(F.col("text").alias("code")).distinct(), dim.owner_codes(r))


_PROB = "((row_id*31+a*7+s*977+c*613)%1000)/1000.0"
_ALLOWED = ", ".join(f"({k},{c})" for k, cs in A.PROVINCES.items() for c in cs)


@query(oracle("STEPS", f""", q AS (SELECT row_id, s, c, {_PROB} AS v FROM f_steps, (SELECT unnest(range(7)) AS s) x, (SELECT unnest(range(72)) AS c) y), al(p,c) AS (VALUES {_ALLOWED}),
ab AS (SELECT row_id, max(v) FILTER (c={A.CLOSE[0]}) AS va, max(v) FILTER (c={A.CLOSE[1]}) AS vb FROM q WHERE s=0 GROUP BY row_id),
f AS (SELECT q.row_id, c, CASE WHEN c NOT IN ({", ".join(map(str, A.PROVINCES))}) THEN 0 WHEN va>vb AND va-vb<{A.CLOSE[2]} AND c={A.CLOSE[0]} THEN vb WHEN va>vb AND va-vb<{A.CLOSE[2]} AND c={A.CLOSE[1]} THEN va ELSE v END AS v FROM q JOIN ab ON ab.row_id=q.row_id WHERE s=0),
p AS (SELECT row_id, arg_max(c,(v,-c)) AS p FROM f GROUP BY row_id),
m AS (SELECT row_id, 0 AS s, c, v FROM f UNION ALL SELECT q.row_id, s, q.c, CASE WHEN s<3 AND al.c IS NULL THEN 0 ELSE v END FROM q JOIN p ON p.row_id=q.row_id LEFT JOIN al ON al.p=p.p AND al.c=q.c WHERE s>0),
b AS (SELECT row_id, s, arg_max(c,(v,-c)) AS i, max(v) AS v FROM m GROUP BY row_id, s)
SELECT row_id, string_agg(CAST(i AS VARCHAR),',' ORDER BY s) AS idx, round(sum(v),6) AS total FROM b GROUP BY row_id"""))
def masked_plates(spark, sf_dir):
    rows = fixture(spark, sf_dir, "STEPS").withColumn("probs", F.expr(f"transform(sequence(0,6), s -> transform(sequence(0,71), c -> cast({_PROB} as double)))"))
    out = A.plate_mask_decode(rows)
    return out.select("row_id", F.array_join(F.transform("idx", lambda i: i.cast("string")), ",").alias("idx"), F.round(F.aggregate("prob", F.lit(0.0), lambda a, p: a + p), 6).alias("total"))


@query(f"""WITH dm(code,place) AS (VALUES {", ".join(f"('{r[0]}',{i})" for i, r in enumerate(dim.SIZE_TYPES))}), dp AS (SELECT DISTINCT code, place, unnest([code,substr(code,2),code[1]||substr(code,3),substr(code,1,2)||code[4],substr(code,1,3)]) AS fragment FROM dm),
r AS (SELECT DISTINCT substr(size_type,1,3) AS fragment FROM (SELECT CASE l_orderkey%4 WHEN 0 THEN '22G1' WHEN 1 THEN '42G1' WHEN 2 THEN '45G1' ELSE '22R1' END AS size_type FROM lineitem) t)
SELECT dp.fragment, string_agg(code,',' ORDER BY place) AS candidates FROM dp JOIN r ON r.fragment=dp.fragment GROUP BY dp.fragment""")
def type_fragments(spark, sf_dir):
    read = fixture(spark, sf_dir, "READ").select(F.substring("size_true", 1, 3).alias("fragment")).distinct()
    found = dim.size_candidates(spark).join(read, "fragment", "left_semi")
    return found.groupBy("fragment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda x: x["candidate"]), ",").alias("candidates"))
