"""Queries of stitching, repair and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..operators import dimensions as dim
from ..operators import recognise as R
from .code_queries import _COMPLETE, _HEAD, _NUMBER, _SIZE_REPAIR, _VALID, _VOTE
from .fixtures import fixture, oracle
from .registry import query


def _frames(spark, sf_dir):
    """Frames of tokens: whole codes, or head and number apart in either order, and a size-type; some with a head that another replaces."""
    r = fixture(spark, sf_dir, "READ")
    t = lambda x: F.struct(x.alias("text"), F.col("score").cast("double").alias("score"))
    head, number, whole, size = t(F.substring("text", 1, 4)), t(F.expr("substr(text, 5)")), t(F.col("text")), t(F.col("size_text"))
    tokens = F.when(F.col("seq") % 3 == 0, F.array(whole, size)).when(F.col("seq") % 3 == 1, F.array(head, number, size)).otherwise(F.array(size, number, head))
    tokens = F.when((F.col("seq") % 3 == 1) & (F.col("pass_id") % 5 == 0), F.array(t(F.lit("XYZU")), head, number, size)).otherwise(tokens)
    return r.select((F.col("pass_id") * 100 + F.col("seq")).alias("frame_id"), "pass_id", "seq", tokens.alias("tokens"))


@query(oracle("READ", """ SELECT pass_id*100+seq AS frame_id, CASE WHEN seq%3=2 THEN size_text||','||text ELSE text||','||size_text END AS joined FROM f_read"""))
def stitched_tokens(spark, sf_dir):
    out = R.stitch_tokens(_frames(spark, sf_dir))
    return out.select("frame_id", F.array_join(F.transform("tokens", lambda t: t["text"]), ",").alias("joined"))


_LIVE = "".join(C.LIVE)


def _vote_of(name: str, column: str) -> str:
    """The vote over lists of texts; in the last place missing characters don't count."""
    return f""", {name}l AS (SELECT pass_id, unnest(range(1,len({column})+1)) AS seq, unnest({column}) AS t FROM gd), {name}m AS (SELECT pass_id, max(length(t)) AS n FROM {name}l WHERE t<>'' GROUP BY pass_id),
{name}c AS (SELECT l.pass_id, p, n, substr(t,CAST(p AS INT),1) AS ch, count(*) AS k, min(seq) AS first FROM {name}l l JOIN {name}m m ON m.pass_id=l.pass_id, LATERAL (SELECT unnest(range(1,m.n+1)) AS p) u WHERE t<>'' GROUP BY l.pass_id, p, n, ch),
{name} AS (SELECT pass_id, string_agg(ch,'' ORDER BY p) AS voted FROM (SELECT *, row_number() OVER (PARTITION BY pass_id,p ORDER BY k DESC, first) AS r FROM {name}c WHERE NOT (p=n AND ch='')) z WHERE r=1 GROUP BY pass_id)"""


#: Tokens of a pass in order, split codes joined, then what is scored about as high as the last one accepted.
_GATED = f""", tk AS (SELECT pass_id, seq, {{'t': text, 's': CAST(score AS DOUBLE)}} AS whole, {{'t': substr(text,1,4), 's': CAST(score AS DOUBLE)}} AS head, {{'t': substr(text,5), 's': CAST(score AS DOUBLE)}} AS number, {{'t': size_text, 's': CAST(score AS DOUBLE)}} AS size, {{'t': 'XYZU', 's': CAST(score AS DOUBLE)}} AS other FROM f_read),
tl AS (SELECT pass_id, flatten(list(CASE WHEN seq%3=1 AND pass_id%5=0 THEN [other, head, number, size] WHEN seq%3=0 THEN [whole, size] WHEN seq%3=1 THEN [head, number, size] ELSE [size, number, head] END ORDER BY seq)) AS ts FROM tk GROUP BY pass_id),
st AS (SELECT pass_id, ts, 0 AS k, CAST([] AS STRUCT(t VARCHAR, s DOUBLE)[]) AS outs, '' AS head, '' AS digits FROM tl UNION ALL
 SELECT pass_id, ts, k+1, CASE WHEN emit THEN list_append(outs, {{'t': CASE WHEN is_head THEN ts[k+1].t||digits ELSE head||ts[k+1].t END, 's': ts[k+1].s}}) ELSE outs END, CASE WHEN is_head AND NOT emit THEN ts[k+1].t ELSE '' END, CASE WHEN is_digits THEN head||ts[k+1].t ELSE '' END FROM (
  SELECT *, (is_head AND digits<>'') OR (NOT is_head AND NOT is_digits) AS emit FROM (
   SELECT *, NOT is_head AND regexp_full_match(head||ts[k+1].t,'[0-9]{{6,7}}') AS is_digits FROM (SELECT *, length(ts[k+1].t)=4 AND contains(ts[k+1].t,'U') AS is_head FROM st WHERE k<len(ts)) a) b) c),
so AS (SELECT pass_id, outs FROM st WHERE k=len(ts)),
ga AS (SELECT pass_id, outs, 0 AS k, CAST([] AS VARCHAR[]) AS codes, 0.0::DOUBLE AS bc, CAST([] AS VARCHAR[]) AS sizes, 0.0::DOUBLE AS bs FROM so UNION ALL
 SELECT pass_id, outs, k+1, CASE WHEN is_code THEN list_append(codes, outs[k+1].t) ELSE codes END, CASE WHEN is_code THEN outs[k+1].s ELSE bc END, CASE WHEN is_size THEN list_append(sizes, outs[k+1].t) ELSE sizes END, CASE WHEN is_size THEN outs[k+1].s ELSE bs END FROM (
  SELECT *, regexp_full_match(outs[k+1].t,'[A-Za-z]{{3}}U[0-9]*|[A-Za-z]{{2}}U[0-9]+|[A-Za-z]U[0-9]+|U[0-9]+') AND length(outs[k+1].t)>5 AND outs[k+1].s>bc-0.1::DOUBLE AS is_code, regexp_full_match(outs[k+1].t,'{_LIVE}') AND outs[k+1].s>bs-0.1::DOUBLE AS is_size FROM ga WHERE k<len(outs)) a),
gd AS (SELECT pass_id, codes, sizes FROM ga WHERE k=len(outs))""" + _vote_of("vc", "codes") + _vote_of("vz", "sizes") + f""",
fr AS (SELECT gd.pass_id AS frame_id, {_COMPLETE('vc.voted')} AS code, vz.voted AS size_type FROM gd LEFT JOIN vc ON vc.pass_id=gd.pass_id LEFT JOIN vz ON vz.pass_id=gd.pass_id)"""


@query(oracle("READ", _GATED + " SELECT frame_id, CASE WHEN length(code)=11 THEN code ELSE '' END AS code, CASE WHEN length(size_type)=4 THEN size_type ELSE '' END AS size_type FROM fr").replace("WITH ", "WITH RECURSIVE ", 1))
def frame_results(spark, sf_dir):
    passes = _frames(spark, sf_dir).groupBy("pass_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tokens"))), lambda x: x["tokens"])).alias("tokens"))
    stitched = R.stitch_tokens(passes.withColumnRenamed("pass_id", "frame_id"))
    return R.frame_result(R.gate_readings(stitched))


_K = ", ".join(f"i{k}" for k in range(1, 17))
_Q = ", ".join(f"p{k}" for k in range(1, 17))


@query(oracle("IDX", f""", a AS (SELECT row_id, [{_K}] AS idx, [{_Q}] AS prob FROM f_idx), k AS (SELECT row_id, idx, prob, list_filter(range(1,17), lambda j: idx[j]<>0 AND (j=1 OR idx[j]<>idx[j-1])) AS kept FROM a)
SELECT row_id, array_to_string(list_transform(kept, lambda j: substr('ABC',CAST(idx[j] AS INT),1)),'') AS text, round(list_avg(list_transform(kept, lambda j: prob[j])),6) AS score FROM k"""))
def greedy_decode(spark, sf_dir):
    rows = fixture(spark, sf_dir, "IDX").selectExpr("row_id", f"array({_K}) as idx", f"array({_Q}) as prob")
    return R.ctc_decode(rows, "ABC").select("row_id", "text", F.round("score", 6).alias("score"))


def _candidates(spark, sf_dir):
    return R.owner_candidates(dim.owner_codes(fixture(spark, sf_dir, "READ")))


_OWNERS = f""", o AS (SELECT DISTINCT substr(true_code,1,4) AS owner FROM f_read WHERE regexp_matches(true_code,'^[A-Z]{{3}}U')),
pr AS (SELECT DISTINCT owner, owner[CAST(i AS INT)]||owner[CAST(j AS INT)] AS p FROM o, (SELECT unnest(range(1,5)) AS i) a, (SELECT unnest(range(1,5)) AS j) b WHERE i<j),
le AS (SELECT unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZ','')) AS c), fr AS (SELECT owner, p AS fragment FROM pr UNION SELECT owner, unnest([c||p, p[1]||c||p[2], p||c]) FROM pr, le),
sc AS (SELECT owner, fragment, 2*CASE WHEN length(fragment)=2 THEN 2 WHEN fragment IN (substr(owner,2), owner[1]||substr(owner,3), substr(owner,1,2)||owner[4], substr(owner,1,3)) THEN 3 ELSE 2 END/(length(fragment)+4) AS ratio FROM fr),
k AS (SELECT *, row_number() OVER (PARTITION BY fragment ORDER BY ratio DESC, owner) AS r FROM sc)"""


@query(oracle("READ", _OWNERS + f" SELECT fragment, string_agg(owner, ',' ORDER BY r) AS owners FROM k WHERE r<={R.OWNERS} GROUP BY fragment"))
def owner_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("fragment", F.array_join("owners", ",").alias("owners"))


def _swaps(text: str, table: dict[str, str], n: int) -> str:
    """text with one confused character replaced, by place and then by preference."""
    pairs = "[" + ", ".join(f"{{'a': '{k}', 'b': '{c}'}}" for k, v in table.items() for c in v) + "]"
    one = f"list_transform(list_filter({pairs}, lambda p: p.a={text}[i]), lambda p: substr({text},1,i-1)||p.b||substr({text},i+1))"
    return f"flatten(list_transform(range(1,{n + 1}), lambda i: {one}))"


_TAG = lambda items, kind: f"list_transform({items}, lambda x: {{'code': x, 'kind': '{kind}'}})"
#: Ranked tries of each distinct code; the first valid one wins.
_REPAIRED = _OWNERS + f""", ca AS (SELECT fragment, list(owner ORDER BY r) AS owners FROM k WHERE r<={R.OWNERS} GROUP BY fragment),
c0 AS (SELECT DISTINCT text AS code, {_HEAD('text')} AS head, {_NUMBER('text')} AS num FROM f_read),
c1 AS (SELECT *, regexp_replace(head,'[0-9]','','g') AS letters FROM c0),
c2 AS (SELECT *, CASE WHEN contains(letters,'U') THEN regexp_extract(letters,'^(.*)U',1) ELSE letters END AS stem FROM c1),
c3 AS (SELECT c2.*, coalesce(ca.owners, CAST([] AS VARCHAR[])) AS owners, coalesce(ca.owners[1],'') AS first, substr(num,1,6) AS six, stem||'U' AS full_head FROM c2 LEFT JOIN ca ON ca.fragment=c2.stem),
c4 AS (SELECT *, CASE WHEN length(num)>=7 THEN {_swaps('six', R.DIGITS, 6)} ELSE CAST([] AS VARCHAR[]) END AS digits, CASE WHEN length(stem)=3 THEN {_swaps('full_head', R.LETTERS, 4)} ELSE CAST([] AS VARCHAR[]) END AS heads FROM c3),
c5 AS (SELECT *, list_concat(list_concat(CASE WHEN length(num)=8 THEN {_TAG("[first||substr(num,1,7), first||substr(num,2,7)]", 'number error')} ELSE [] END, {_TAG("list_transform(digits, lambda d: first||d||substr(num,7,1))", 'number error')}),
 list_concat({_TAG("list_transform(list_concat(heads, owners), lambda h: h||num)", 'owner code error')},
 {_TAG("flatten(list_transform(list_concat(list_concat(owners[1:1], heads), owners[2:" + str(R.OWNERS) + "+1]), lambda h: list_transform(digits, lambda d: h||d||substr(num,7,1))))", 'owner code and number error')})) AS tries FROM c4),
c6 AS (SELECT *, list_filter(tries, lambda t: {_VALID('t.code')})[1] AS won, {_VALID('code')} AS good, {_COMPLETE('(first||six)')} AS set_digit, CASE WHEN first=head THEN 'check error' ELSE 'owner code and check error' END AS kind FROM c5),
rp AS (SELECT code, CASE WHEN good OR length(num)<6 OR len(owners)=0 THEN code WHEN length(num)<7 THEN set_digit ELSE coalesce(won.code, set_digit) END AS repaired,
 CASE WHEN good THEN 1 WHEN length(num)<6 OR len(owners)=0 THEN 0 ELSE 2 END AS flag,
 CASE WHEN good THEN 'good code' WHEN length(num)<6 THEN 'number error' WHEN len(owners)=0 THEN 'owner code error' WHEN length(num)<7 THEN kind ELSE coalesce(won.kind, kind) END AS info FROM c6)"""


@query(oracle("READ", _REPAIRED + " SELECT * FROM rp"))
def repaired_codes(spark, sf_dir):
    return R.repair_codes(fixture(spark, sf_dir, "READ").select(F.col("text").alias("code")).distinct(), _candidates(spark, sf_dir))


_WHOLE = "".join((C.FIRST, C.SECOND, C.THIRD, C.FOURTH))
_VOTES = f""", vr AS (SELECT pass_id, text AS code, seq AS o, repaired, flag, {_HEAD('text')} AS head, substr({_NUMBER('text')},1,6) AS six, {_VALID('text')} AS valid FROM f_read JOIN rp ON rp.code=f_read.text WHERE text<>''),
vo AS (SELECT *, regexp_full_match(head,'[A-Za-z]{{3}}U') AS owner_ok, regexp_full_match(six,'[0-9]{{6}}') AS number_ok, {_COMPLETE('(head||six)')} AS whole FROM vr),
vs AS (SELECT pass_id, code, 0.0::DOUBLE AS w, 'read' AS kind, o*4 AS o FROM vo
 UNION ALL SELECT pass_id, CASE WHEN valid OR (owner_ok AND number_ok AND length(code)=11) THEN code WHEN owner_ok AND number_ok THEN whole ELSE repaired END,
  CASE WHEN valid THEN {R.VALID} WHEN owner_ok AND number_ok AND length(code)=11 THEN {R.FORMED} WHEN owner_ok AND number_ok THEN {R.COMPLETED} WHEN flag<>0 THEN {R.REPAIRED} ELSE 0 END,
  CASE WHEN valid THEN 'good' WHEN owner_ok AND number_ok AND length(code)=11 THEN 'voted' WHEN owner_ok AND number_ok THEN 'repair' WHEN flag<>0 THEN 'repair' ELSE 'read' END, o*4+1 FROM vo
 UNION ALL SELECT pass_id, whole, {R.COMPLETION}, 'read', o*4+2 FROM vo WHERE NOT valid AND owner_ok AND number_ok AND length(code)=11
 UNION ALL SELECT a.pass_id, {_COMPLETE('(a.part||b.part)')}, {R.COMPOSED}, 'repair', 1099511627776 FROM
  (SELECT pass_id, max_by(part,(n,-o)) AS part FROM (SELECT pass_id, head AS part, count(*) FILTER (NOT number_ok) AS n, min(o) AS o FROM vo WHERE owner_ok GROUP BY pass_id, head) z GROUP BY pass_id HAVING max(n)>0) a JOIN
  (SELECT pass_id, max_by(part,(n,-o)) AS part FROM (SELECT pass_id, six AS part, count(*) FILTER (NOT owner_ok) AS n, min(o) AS o FROM vo WHERE number_ok GROUP BY pass_id, six) z GROUP BY pass_id HAVING max(n)>0) b ON a.pass_id=b.pass_id),
vt AS (SELECT pass_id, code, round(sum(w),9) AS w, min(o) AS o, bool_or(kind='good') AS good, bool_or(kind='voted') AS voted, bool_or(kind='repair') AS repair FROM vs GROUP BY pass_id, code),
vf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY w DESC, o) AS k FROM vt) z WHERE k=1),
vg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY w DESC, o) AS k FROM (SELECT pass_id, code, CASE WHEN good THEN w+1 ELSE w END AS w, o, good, voted, repair FROM vt WHERE pass_id IN (SELECT pass_id FROM vf WHERE voted)) y) z WHERE k=1),
vh AS (SELECT * FROM vg UNION ALL SELECT * FROM vf WHERE pass_id NOT IN (SELECT pass_id FROM vg)),
al AS (SELECT pass_id, any_value(repaired) AS repaired, any_value(flag) AS flag FROM vr GROUP BY pass_id HAVING count(*)=1),
fc AS (SELECT vh.pass_id, CASE WHEN al.pass_id IS NOT NULL THEN al.repaired ELSE vh.code END AS code, CASE WHEN al.pass_id IS NOT NULL THEN al.flag WHEN good THEN 1 WHEN voted THEN -1 WHEN repair THEN 2 ELSE 0 END AS outcome,
 CASE WHEN al.pass_id IS NULL THEN w WHEN al.flag=1 THEN 1.0 WHEN al.flag=2 THEN 0.5 ELSE 0 END AS score FROM vh LEFT JOIN al ON al.pass_id=vh.pass_id)""" + _SIZE_REPAIR.replace(", c AS (", ", szc AS (").replace("\nc AS (", "\nszc AS (").replace("JOIN c ON", "JOIN szc c ON").replace("\nd AS (", "\nszd AS (").replace("FROM d ", "FROM szd d ").replace("\nf AS (", "\nszf AS (").replace("FROM f LEFT", "FROM szf f LEFT") + f""",
sz AS (SELECT pass_id, size_text AS code, CASE WHEN flag=1 OR regexp_full_match(size_text,'{_WHOLE}') THEN {R.VALID} ELSE 0 END AS w, seq*2 AS o FROM f_read JOIN sr ON sr.code=size_text
 UNION ALL SELECT pass_id, repaired, CASE WHEN NOT (flag=1 OR regexp_full_match(size_text,'{_WHOLE}')) AND flag=2 THEN {R.REPAIRED} ELSE 0 END, seq*2+1 FROM f_read JOIN sr ON sr.code=size_text),
sy AS (SELECT pass_id, code, round(sum(w),9) AS w, min(o) AS o FROM sz GROUP BY pass_id, code),
fs AS (SELECT pass_id, code AS size_type, w AS size_score FROM (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY w DESC, o) AS k FROM sy) z WHERE k=1)"""


@query(oracle("READ", _REPAIRED + _VOTES + " SELECT coalesce(fc.pass_id, fs.pass_id) AS pass_id, fc.code, CAST(outcome AS INT) AS outcome, round(score,6) AS score, size_type, round(size_score,6) AS size_score FROM fc FULL JOIN fs ON fs.pass_id=fc.pass_id"))
def fused_codes(spark, sf_dir):
    fused = R.fuse_pass_codes(fixture(spark, sf_dir, "READ"), _candidates(spark, sf_dir), dim.size_candidates(spark))
    return fused.withColumns({"score": F.round("score", 6), "size_score": F.round("size_score", 6)})


_SPLIT = f""", rd AS (SELECT pass_id-pass_id%2 AS pass_id, seq*2+pass_id%2 AS seq, {_COMPLETE('text')} AS text FROM f_read), rk AS (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY seq, text) AS k FROM rd WHERE text<>''),
w AS (SELECT pass_id, k, seq, text, [text] AS members, 1 AS container FROM rk WHERE k=1 UNION ALL
 SELECT pass_id, k, seq, text, CASE WHEN same THEN list_append(members, text) ELSE members END, CASE WHEN same THEN 1 ELSE 2 END FROM (
  SELECT rk.pass_id, rk.k, rk.seq, rk.text, w.members, len(list_filter(w.members, lambda m: list_sum(list_transform(range(1, least(length(m), length(rk.text))+1), lambda i: CASE WHEN m[i]=rk.text[i] THEN 1 ELSE 0 END))>=0.6::DOUBLE*least(length(m), length(rk.text))))>0 AS same
  FROM w JOIN rk ON rk.pass_id=w.pass_id AND rk.k=w.k+1) z), sp AS (SELECT pass_id*10+container AS pass_id, seq, text FROM w)"""


@query(oracle("READ", _SPLIT + _VOTE.format(t="text", f="sp") + " SELECT pass_id//10 AS pass_id, CAST(pass_id%10 AS INT) AS container, voted FROM v").replace("WITH ", "WITH RECURSIVE ", 1))
def two_containers(spark, sf_dir):
    r = fixture(spark, sf_dir, "READ").select((F.col("pass_id") - F.col("pass_id") % 2).alias("pass_id"), (F.col("seq") * 2 + F.col("pass_id") % 2).alias("seq"), C.complete_code("text").alias("text"))
    return R.split_two(r)
