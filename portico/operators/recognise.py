"""Stitching, repair and weighted fusion of container codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes as C
from .scans import Rounds

#: Characters that readers confuse, in order of preference.
DIGITS = {"0": "8", "5": "86", "6": "85", "8": "06", "9": "8", "1": "7", "7": "1"}
LETTERS = {"C": "G", "D": "O", "G": "C", "H": "M", "I": "T", "M": "WH", "N": "M", "O": "D", "R": "P", "T": "I", "W": "M"}
#: Weights of votes: valid, well formed but invalid, its completion, completed, repaired, composed.
VALID, FORMED, COMPLETION, COMPLETED, REPAIRED, COMPOSED = 1.0, 0.5, 0.25, 0.5, 0.4, 0.5
#: Most owners that a fragment is offered.
OWNERS = 100
#: Most readings of a pass that are gone through in order at once; passes with more of them go by rounds.
FOLDED = 64


def stitch_tokens(frames: DataFrame, key: str = "frame_id") -> DataFrame:
    """key, tokens: token arrays (struct of text and score, in reading order) with split codes joined.

    A four-character token with a U waits and prefixes the next token, unless that is such a head
    itself, which takes its place; a token of six or seven digits waits and suffixes the next one if
    that is a head. The later token's score stands for both.
    """
    empty = F.array().cast("array<struct<text:string,score:double>>")
    start = F.struct(empty.alias("out"), F.lit("").alias("head"), F.lit("").alias("digits"))

    def step(acc: Column, t: Column) -> Column:
        text = F.concat(acc["head"], t["text"])
        is_head = (F.length(t["text"]) == 4) & F.contains(t["text"], F.lit("U"))
        is_digits = ~is_head & F.length(text).between(6, 8) & text.rlike("^[0-9]{6,7}$")  # the length first: it spares most searches
        done = F.when(is_head, F.concat(t["text"], acc["digits"])).otherwise(text)
        emit = (is_head & (acc["digits"] != "")) | (~is_head & ~is_digits)
        return F.struct(
            F.when(emit, F.concat(acc["out"], F.array(F.struct(done.alias("text"), t["score"].alias("score"))))).otherwise(acc["out"]).alias("out"),
            F.when(is_head & ~emit, t["text"]).otherwise("").alias("head"), F.when(is_digits, text).otherwise("").alias("digits"),
        )

    return frames.select(key, F.aggregate("tokens", start, step, lambda acc: acc["out"]).alias("tokens"))


def gate_readings(frames: DataFrame, key: str = "frame_id", slack: float = 0.1) -> DataFrame:
    """key, codes, sizes: code-like and size-type-like texts scored above the last accepted one less ``slack``."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("codes"), F.lit(0.0).alias("best_code"), none.alias("sizes"), F.lit(0.0).alias("best_size"))
    add = lambda kept, ok, t: F.when(ok, F.concat(kept, F.array(t["text"]))).otherwise(kept)

    def step(acc: Column, t: Column) -> Column:
        code = (F.length(t["text"]) > 5) & (t["score"] > acc["best_code"] - slack) & C.code_flags(t["text"])["is_part"]
        size = F.length(t["text"]).between(4, 5) & (t["score"] > acc["best_size"] - slack) & C.is_live_size_type(t["text"])
        return F.struct(
            add(acc["codes"], code, t).alias("codes"), F.when(code, t["score"]).otherwise(acc["best_code"]).alias("best_code"),
            add(acc["sizes"], size, t).alias("sizes"), F.when(size, t["score"]).otherwise(acc["best_size"]).alias("best_size"),
        )

    out = frames.select(key, F.aggregate("tokens", start, step).alias("g"))
    return out.select(key, "g.codes", "g.sizes")


def frame_result(gated: DataFrame, key: str = "frame_id") -> DataFrame:
    """key, code, size_type: votes of the gated texts, the check digit set, blank unless of full length."""
    from .fusion import positional_vote

    # One run of votes for both kinds; a blank of a third kind keeps frames that nothing was read in.
    marked = lambda kind, texts: F.transform(texts, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))
    rows = gated.select(key, F.posexplode(F.concat(marked(0, "codes"), marked(1, "sizes"), marked(2, F.array(F.lit(" "))))).alias("seq", "r"))
    voted = positional_vote(rows.select(key, "seq", "r.kind", "r.text"), [key, "kind"], "text", "seq", blank_last=False)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("voted")))
    both = voted.groupBy(key).agg(of(0).alias("codes"), of(1).alias("sizes"))
    code = C.complete_code("codes")
    return both.select(key, F.when(F.length(code) == 11, code).otherwise("").alias("code"), F.when(F.length("sizes") == 4, F.col("sizes")).otherwise("").alias("size_type"))


def ctc_decode(rows: DataFrame, alphabet: str, idx: str = "idx", prob: str = "prob") -> DataFrame:
    """rows with text and score: repeats collapsed, class 0 dropped, mean probability of what is left."""
    i = F.col(idx)
    kept = F.filter(F.sequence(F.lit(0), F.size(i) - 1), lambda k: (F.get(i, k) != 0) & ((k == 0) | (F.get(i, k) != F.get(i, k - 1))))
    out = rows.withColumn("__kept", F.when(F.size(i) > 0, kept).otherwise(F.array().cast("array<int>")))
    text = F.array_join(F.transform("__kept", lambda k: F.substring(F.lit(alphabet), F.get(F.col(idx), k).cast("int"), F.lit(1))), "")
    total = F.aggregate(F.transform("__kept", lambda k: F.get(F.col(prob), k)), F.lit(0.0), lambda a, p: a + p)
    return out.withColumns({"text": text, "score": F.when(F.size("__kept") > 0, total / F.size("__kept"))}).drop("__kept")


def owner_candidates(owners: DataFrame) -> DataFrame:
    """fragment, owners: for two or three letters the owners like them, best first, ``OWNERS`` at most.

    Likeness is twice the longest common subsequence over the sum of lengths, 0.57 at least: three
    letters must share two with an owner in order, two letters both. Fragments come from the owners'
    side: their letter pairs, and those with any letter put in.
    """
    o = F.col("owner")
    pairs = F.array(*[F.concat(F.substring(o, i, 1), F.substring(o, j, 1)) for i in range(1, 4) for j in range(i + 1, 5)])
    letters = F.split(F.lit("A,B,C,D,E,F,G,H,I,J,K,L,M,N,O,P,Q,R,S,T,U,V,W,X,Y,Z"), ",")
    wide = F.flatten(F.transform(pairs, lambda p: F.flatten(F.transform(letters, lambda c: F.array(F.concat(c, p), F.concat(F.substring(p, 1, 1), c, F.substring(p, 2, 1)), F.concat(p, c))))))
    rows = owners.select("owner", F.explode(F.array_distinct(F.concat(pairs, wide))).alias("fragment"))
    inside = F.array(*[F.concat(*[F.substring(o, i, 1) for i in range(1, 5) if i != k]) for k in range(1, 5)])
    lcs = F.when(F.length("fragment") == 2, 2).when(F.array_contains(inside, F.col("fragment")), 3).otherwise(2)
    scored = rows.withColumn("ratio", 2 * lcs / (F.length("fragment") + 4))
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy("fragment").orderBy(F.desc("ratio"), "owner"))).filter(F.col("r") <= OWNERS)
    return ranked.groupBy("fragment").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "owner"))), lambda x: x["owner"]).alias("owners"))


def _swapped(text: Column, table: dict[str, str], n: int, start: int) -> Column:
    """text with one confused character replaced, by place and then by preference.

    Structs of the text (s) and of what that adds to the weighted sum of a code in which text begins at place ``start`` (d).
    """
    none = F.array().cast("array<struct<c:string,v:int>>")

    def at(i: int) -> Column:
        old = F.substring(text, i, 1)
        weight = 1 << (start + i - 2)
        swap = lambda k, c: F.struct(F.lit(c).alias("c"), F.lit((C.VALUES.index(c) - C.VALUES.index(k)) * weight).alias("v"))
        found = F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[swap(k, c) for c in v]))]), old)
        return F.transform(F.coalesce(found, none), lambda x: F.struct(F.concat(F.substring(text, 1, i - 1), x["c"], F.substring(text, i + 1, n)).alias("s"), x["v"].alias("d")))

    return F.concat(*[at(i) for i in range(1, n + 1)])


def repair_codes(codes: DataFrame, candidates: DataFrame) -> DataFrame:
    """codes with repaired, flag and info; flag 1 is valid as read, 2 repaired, 0 beyond repair.

    candidates (fragment, owners) is bounded by the alphabet (26**2 + 26**3 fragments of ``OWNERS``
    owners) and comes from ``owner_candidates``. Attempts go in this order and the first valid one wins:
    both windows of eight digits, one confused digit, other owners, both; else the check digit is set.
    An attempt is put together from a head and a number, and only their sums are looked at: what one
    changed character adds is known. Each kind of attempt is made only where the one before found nothing.
    """
    c = F.col("code")
    letters = F.regexp_replace(C.split_head(c), "[0-9]", "")
    stem = F.when(letters.contains("U"), F.regexp_extract(letters, "^(.*)U", 1)).otherwise(letters)
    names = codes.columns
    summed = lambda x: F.struct(x.alias("s"), C.weighted_sum(x, 4).alias("d"), F.coalesce(x.rlike("^[A-Z]{4}$"), F.lit(False)).alias("ok"))
    known = candidates.select(F.col("fragment").alias("__fragment"), F.transform("owners", summed).alias("__owners"))
    rows = codes.select(*names, stem.alias("__stem"), C.split_head(c).alias("__head"), C.split_number(c).alias("__num")).join(F.broadcast(known), F.col("__stem") == F.col("__fragment"), "left")
    num, owners = F.col("__num"), F.col("__owners")
    rows = rows.withColumn("__first", F.coalesce(F.get(owners, F.lit(0))["s"], F.lit("")))
    good, short, lost = C.is_valid_code("code"), F.length(num) < 6, F.coalesce(F.size(owners) <= 0, F.lit(True))
    rows = rows.withColumn("__state", F.when(good, 1).when(short, 2).when(lost, 3).when(F.length(num) < 7, 4).otherwise(5))
    tried = F.col("__state") == 5
    six, end = F.substring(num, 1, 6), F.substring(num, 7, 1)
    # What follows the last letter may hold other characters than digits; then only windows of it can be valid.
    rows = rows.withColumn("__digits", F.when(tried & F.substring(num, 1, 7).rlike("^[0-9]{7}$"), _swapped(six, DIGITS, 6, 5)))
    rows = rows.withColumn("__sum", F.when(F.col("__digits").isNotNull(), sum((F.substring(num, i, 1).try_cast("int") * (1 << (i + 3)) for i in range(1, 7)), F.lit(0))))
    rows = rows.withColumn("__end", F.when(F.col("__digits").isNotNull(), end.try_cast("int")))
    full, plain = F.concat("__stem", F.lit("U")), F.array().cast("array<struct<s:string,d:int>>")
    fits = tried & (F.length("__stem") == 3) & F.col("__stem").rlike("^[A-Z]{3}$")
    at = F.when(fits, C.weighted_sum(full, 4))
    swapped = F.transform(F.when(fits, _swapped(full, LETTERS, 4, 1)).otherwise(plain), lambda x: F.struct(x["s"].alias("s"), (x["d"] + F.col("__at")).alias("d"), F.lit(True).alias("ok")))
    rows = rows.withColumn("__at", at).withColumn("__heads", swapped)
    right = lambda h, d: h["ok"] & ((h["d"] + F.col("__sum") + d) % 11 % 10 == F.col("__end"))
    made = lambda code, kind: F.struct(code.alias("code"), F.lit(kind).alias("kind"))
    top = lambda found: F.get(found, F.lit(0))
    with_digits = lambda h, kind: F.transform(F.filter("__digits", lambda d: right(h, d["d"])), lambda d: made(F.concat(h["s"], d["s"], F.substring(F.col("__num"), 7, 1)), kind))
    one = top(owners)
    windows = F.when(F.length(num) == 8, top(F.filter(F.array(*[made(F.concat("__first", F.substring(num, i, 7)), "number error") for i in (1, 2)]), lambda t: C.is_valid_code(t["code"]))))
    others = F.when(F.length(num) == 7, top(F.transform(F.filter(F.concat("__heads", owners), lambda h: right(h, F.lit(0))), lambda h: made(F.concat(h["s"], F.col("__num")), "owner code error"))))
    order = F.concat(F.slice(owners, 1, 1), F.col("__heads"), F.slice(owners, 2, OWNERS))
    both = top(F.flatten(F.transform(order, lambda h: with_digits(h, "owner code and number error"))))
    rows = rows.withColumn("__won", F.when(tried, F.coalesce(windows, top(with_digits(one, "number error")), others, both)))
    set_digit = C.complete_code(F.concat("__first", six))
    kind = F.when(F.col("__first") == F.col("__head"), "check error").otherwise("owner code and check error")
    state = F.col("__state")
    return rows.select(
        *names,
        F.when(state <= 3, c).when(state == 4, set_digit).otherwise(F.coalesce("__won.code", set_digit)).alias("repaired"),
        F.when(state == 1, 1).when(state <= 3, 0).otherwise(2).alias("flag"),
        F.when(state == 1, "good code").when(state == 2, "number error").when(state == 3, "owner code error").when(state == 4, kind).otherwise(F.coalesce("__won.kind", kind)).alias("info"),
    )


def fuse_codes(readings: DataFrame, candidates: DataFrame, key: str = "pass_id", text: str = "text", order: str = "seq") -> DataFrame:
    """key, code, outcome, score: the code of each pass with the most votes; the first seen on ties.

    outcome is 1 for a code that was read validly, -1 for a well-formed invalid one, 2 for a repaired
    or composed one, 0 for another. A single reading is repaired only.
    """
    rows = readings.select(key, F.col(text).alias("code"), F.col(order).alias("o")).filter("code <> ''")
    # Equal readings of a pass are one row with their number; each is repaired where it is, and the rows are read again from a table.
    r = repair_codes(rows.groupBy(key, "code").agg(F.count("*").alias("n"), F.min("o").alias("o")), candidates).drop("info")
    (r,) = Rounds(readings.sparkSession).put(repaired=r)
    r = r.withColumns({"head": C.split_head("code"), "six": F.substring(C.split_number("code"), 1, 6)})
    owner, number = F.col("head").rlike("^[A-Za-z]{3}U$"), F.col("six").rlike("^[0-9]{6}$")
    r = r.withColumns({"owner_ok": owner, "number_ok": number, "valid": C.is_valid_code("code")})
    formed = F.col("owner_ok") & F.col("number_ok")
    full = C.complete_code(F.concat("head", "six"))
    vote = lambda code, w, kind, k: F.struct(code.alias("code"), F.lit(w).alias("w"), F.lit(kind).alias("kind"), F.lit(k).alias("k"))
    votes = F.concat(
        F.array(vote(F.col("code"), 0.0, "read", 0)),
        F.when(F.col("valid"), F.array(vote(F.col("code"), VALID, "good", 1)))
        .when(formed & (F.length("code") == 11), F.array(vote(F.col("code"), FORMED, "voted", 1), vote(full, COMPLETION, "read", 2)))
        .when(formed, F.array(vote(full, COMPLETED, "repair", 1)))
        .when(F.col("flag") != 0, F.array(vote(F.col("repaired"), REPAIRED, "repair", 1)))
        .otherwise(F.array(vote(F.col("repaired"), 0.0, "read", 1))),
    )
    single = r.select(key, "o", "n", F.explode(votes).alias("v")).select(key, F.col("v.code").alias("code"), (F.col("v.w") * F.col("n")).alias("w"), "v.kind", (F.col("o") * 4 + F.col("v.k")).alias("o"))
    # The best head and the best number of readings that fail in the other part make one more candidate.
    def best(ok: str, other: str, part: str) -> DataFrame:
        n = r.filter(F.col(ok)).groupBy(key, part).agg(F.sum(F.when(F.col(other), 0).otherwise(F.col("n"))).alias("n"), F.min("o").alias("o"))
        return n.groupBy(key).agg(F.max_by(part, F.struct("n", -F.col("o"))).alias(part), F.max("n").alias("n")).filter("n > 0").drop("n")

    composed = best("owner_ok", "number_ok", "head").join(best("number_ok", "owner_ok", "six"), key)
    composed = composed.select(key, C.complete_code(F.concat("head", "six")).alias("code"), F.lit(COMPOSED).alias("w"), F.lit("repair").alias("kind"), F.lit(2**40).cast("long").alias("o"))
    kinds = lambda k: F.max((F.col("kind") == k).cast("int"))
    sums = single.unionByName(composed).groupBy(key, "code").agg(F.round(F.sum("w"), 9).alias("w"), F.min("o").alias("o"), kinds("good").alias("good"), kinds("voted").alias("voted"), kinds("repair").alias("repair"))
    top = lambda w: F.max_by(F.struct("code", w.alias("w"), "good", "voted", "repair"), F.struct(w.alias("w"), -F.col("o")))
    # Where an invalid code leads, codes that were read validly get another vote.
    best_two = sums.groupBy(key).agg(top(F.col("w")).alias("t"), top(F.col("w") + F.col("good")).alias("u"))
    final = best_two.select(key, F.when(F.col("t.voted") == 1, F.col("u")).otherwise(F.col("t")).alias("t"))
    alone = r.groupBy(key).agg(F.sum("n").alias("readings"), F.min("repaired").alias("repaired"), F.min("flag").alias("flag")).filter("readings = 1").drop("readings")
    outcome = F.when(F.col("t.good") == 1, 1).when(F.col("t.voted") == 1, -1).when(F.col("t.repair") == 1, 2).otherwise(0)
    joined = final.join(alone, key, "left")
    one = F.col("flag").isNotNull()
    return joined.select(
        key, F.when(one, F.col("repaired")).otherwise(F.col("t.code")).alias("code"), F.when(one, F.col("flag")).otherwise(outcome).alias("outcome"),
        F.when(one, F.when(F.col("flag") == 1, 1.0).when(F.col("flag") == 2, 0.5).otherwise(0.0)).otherwise(F.col("t.w")).alias("score"),
    )


def fuse_size_types(readings: DataFrame, candidates: DataFrame, key: str = "pass_id", text: str = "size_text", order: str = "seq") -> DataFrame:
    """key, size_type, size_score: known types count one, repaired ones 0.4; the first seen on ties."""
    from .fusion import repair_size_types

    rows = readings.groupBy(key, F.col(text).alias("code")).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    r = repair_size_types(rows, candidates)
    good = (F.col("flag") == 1) | (C.size_type_class("code") == "good")
    votes = F.array(F.struct(F.col("code").alias("code"), F.when(good, VALID).otherwise(0.0).alias("w"), F.lit(0).alias("k")), F.struct(F.col("repaired").alias("code"), F.when(~good & (F.col("flag") == 2), REPAIRED).otherwise(0.0).alias("w"), F.lit(1).alias("k")))
    sums = r.select(key, "o", "n", F.explode(votes).alias("v")).groupBy(key, "v.code").agg(F.round(F.sum(F.col("v.w") * F.col("n")), 9).alias("w"), F.min(F.col("o") * 2 + F.col("v.k")).alias("o"))
    return sums.groupBy(key).agg(F.max_by("code", F.struct("w", -F.col("o"))).alias("size_type"), F.max("w").alias("size_score"))


def fuse_pass_codes(readings: DataFrame, owners: DataFrame, sizes: DataFrame) -> DataFrame:
    """Both fusions of each pass."""
    return fuse_codes(readings, owners).join(fuse_size_types(readings, sizes), "pass_id", "full_outer")


def first_container(readings: DataFrame, key: str, text: str, order: str, limit: float) -> DataFrame:
    """key, text, joined: when each distinct text of a pass joins its first container; texts that never do are left out.

    Time is (order, text). A text joins at its first reading after a similar text has joined, the first
    reading of all joins at once: the least fixed point of that. Passes of up to ``FOLDED`` readings are gone
    through in order; it is found by rounds in those of more. A round compares texts
    that have just joined (or joined earlier than known) with those that may still join earlier, by equal
    characters in equal places. A text that joins at its first reading is settled.
    """
    at = F.struct(F.col(order).alias("o"), F.col(text).alias("t"))
    rounds = Rounds(readings.sparkSession)
    (seen,) = rounds.put(seen=readings.select(key, F.col(text).alias("t"), at.alias("at")).distinct())
    (long,) = rounds.put(long=seen.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > FOLDED).select(key))
    if long.isEmpty():
        return _folded(seen, key, limit).withColumnRenamed("t", text)
    # Neither side of these joins is bounded, so none may be sent to the driver, however small its files are.
    short = _folded(seen.join(long.hint("merge"), key, "left_anti"), key, limit)
    (rest,) = rounds.put(rest=seen.join(long.hint("merge"), key, "left_semi"))
    return short.unionByName(_by_rounds(rest, key, limit, rounds)).withColumnRenamed("t", text)


def _folded(seen: DataFrame, key: str, limit: float) -> DataFrame:
    """key, t, joined: the readings of a pass in order, each text beside those that have joined."""
    def near(a: Column, b: Column) -> Column:
        n = F.least(F.length(a), F.length(b))
        same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
        return (n > 0) & (F.size(same) >= limit * n)

    members = F.array().cast(T.ArrayType(seen.schema["at"].dataType))
    joins = lambda acc, x: (F.size(acc) == 0) | (~F.exists(acc, lambda m: m["t"] == x["t"]) & F.exists(acc, lambda m: near(m["t"], x["t"])))
    passes = seen.groupBy(key).agg(F.array_sort(F.collect_list("at")).alias("ats"))
    folded = F.aggregate("ats", members, lambda acc, x: F.when(joins(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return passes.select(key, F.explode(folded).alias("joined")).select(key, F.col("joined.t").alias("t"), "joined")


def _by_rounds(seen: DataFrame, key: str, limit: float, rounds: Rounds) -> DataFrame:
    (texts,) = rounds.put(texts=seen.groupBy(key, "t").agg(F.min("at").alias("first")))
    seed = texts.groupBy(key).agg(F.min_by("t", "first").alias("t"), F.min("first").alias("joined"))
    letters = lambda df: df.select("*", F.posexplode(F.split("t", "")).alias("place", "letter")).filter("letter <> ''")
    (joined,) = rounds.put(joined=seed)
    (new,) = rounds.put(new=seed)
    while not new.isEmpty():
        open_ = texts.join(joined.hint("merge"), [key, "t"], "left").filter("joined IS NULL OR joined > first").select(key, "t", F.col("joined").alias("known"))
        a = letters(new).select(key, F.col("t").alias("member"), F.col("joined").alias("m"), "place", "letter")
        same = letters(open_).join(a.hint("merge"), [key, "place", "letter"]).filter("member <> t AND (known IS NULL OR m < known)").groupBy(key, "t", "member", "m", "known").agg(F.count("*").alias("n"))
        near = same.filter(F.col("n") >= limit * F.least(F.length("t"), F.length("member"))).groupBy(key, "t").agg(F.min("m").alias("m"), F.first("known").alias("known"))
        found = seen.join(near.hint("merge"), [key, "t"]).filter("at > m").groupBy(key, "t").agg(F.min("at").alias("joined"), F.first("known").alias("known")).filter("known IS NULL OR joined < known").drop("known")
        (new,) = rounds.put(new=found)
        (joined,) = rounds.put(joined=joined.join(new.select(key, "t").hint("merge"), [key, "t"], "left_anti").unionByName(new))
    rounds.drop("new", "texts")
    return joined.select(key, "t", "joined")


def split_two(readings: DataFrame, limit: float = 0.6) -> DataFrame:
    """pass_id, container (1 or 2), voted: two containers on one vehicle told apart.

    The first reading seeds the first; a reading that agrees in at least ``limit`` (above 0) of the positions
    with any member joins it, the rest are the second. Readings are in order of seq and text.
    """
    from .fusion import positional_vote

    rows = readings.filter("text <> ''").select("pass_id", "seq", "text")
    member = rows.join(first_container(rows, "pass_id", "text", "seq", limit).hint("merge"), ["pass_id", "text"], "left")
    own = F.coalesce(F.struct(F.col("seq").alias("o"), F.col("text").alias("t")) >= F.col("joined"), F.lit(False))
    return positional_vote(member.withColumn("container", F.when(own, 1).otherwise(2)), ["pass_id", "container"], "text", "seq")
