"""From the loose texts of one picture to a container code, and decoding under what is known of plates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from .fusion import code_window, join_short_numbers
from .recognise import DIGITS, LETTERS, _swapped

#: What is tried for a code, in this order. A part is a token class, its pick, or both of a pair.
HORIZONTAL = ("code_11", "head_4+digits_7", "head_4+short", "over_11", "code_10", "sliding", "rest", "head_4+digits_less_7", "head_less_4+digits_7", "head_less_4+digits_less_7", "head_less_4+short")
VERTICAL = ("code_11", "head_4+digits_7", "over_11", "code_10", "rest", "head_4+digits_over_7", "sliding", "head_4+digits_less_7", "head_less_4+digits_7", "head_less_4+digits_less_7")
#: Classes of the four provinces of the plate alphabet and the letters that follow each.
PROVINCES = {37: [*range(17)], 39: [*range(19)], 47: [*range(21)], 50: [0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 20, 23]}
CLOSE = (37, 39, 0.2)


def assemble_tokens(tokens: DataFrame, key: str, size_types: list[str], vertical: bool = False) -> DataFrame:
    """key, code, size_type, text of tokens (text, distance, score, y, seq) of one picture each.

    Tokens are classed, of each class the one nearest to the reference centre counts (of whole codes
    the most confident, valid ones first), and the branches are tried in order. Short numbers are put
    together from top to bottom. All digits of a long number but the last window are slid over a long
    head: the first valid code counts, else the last one tried. A size-type follows, or else the
    longest part of one. Everything is a conditional aggregate: one shuffle, partial sums in the tasks.
    """
    t = F.col("text")
    rows = tokens.withColumn("__class", C.token_class("text", size_types))
    first = F.struct(F.lit(0).alias("y"), F.col("seq")) if vertical else F.struct("y", "seq")
    rows = rows.withColumns({"__near": F.struct("distance", first.alias("first")), "__valid": C.is_valid_code("text").cast("int"), "__window": code_window("text"), "__inside": C.size_type_inside("text", size_types), "__part": C.is_partial_size_type("text")})
    rest = F.col("__class") == "rest"
    near = lambda what, where: F.min_by(F.when(where, what), F.when(where, F.col("__near")))
    of = lambda name: near(t, F.col("__class") == name).alias(name)
    best = lambda order: F.max_by(F.when(F.col("__class") == "code_11", t), F.when(F.col("__class") == "code_11", order))
    back = F.struct(F.col("__valid"), "score", (-F.col("seq")).alias("s")) if vertical else F.struct(F.col("__valid"), "score", (-F.col("y")).alias("y"), (-F.col("seq")).alias("s"))
    picked = rows.groupBy(key).agg(
        best(back).alias("code_11"), *[of(x) for x in ("head_4", "head_less_4", "head_over_4", "digits_7", "digits_less_7", "digits_over_7", "code_10", "rest")],
        near(F.col("__window"), (F.col("__class") == "over_11") & F.col("__window").isNotNull()).alias("over_11"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("__class") == "digits_1_3", F.struct(first.alias("f"), t.alias("text"))))), lambda x: x["text"]).alias("numbers"),
        of("size_type"), of("size_type_84"), near(F.col("__inside"), rest & F.col("__inside").isNotNull()).alias("inside"),
        F.max_by(F.when(rest & F.col("__part"), t), F.when(rest & F.col("__part"), F.struct(F.length("text"), (-F.col("y") if not vertical else F.lit(0)).alias("y"), (-F.col("seq")).alias("s")))).alias("part"),
    )
    picked = picked.withColumn("short", F.when(F.size("numbers") > 0, join_short_numbers(F.col("numbers"))))
    slid = F.transform(F.sequence(F.lit(1), F.length("digits_over_7") - 7), lambda i: F.concat(F.right("head_over_4", F.lit(4)), F.substring(F.col("digits_over_7"), i, F.lit(7))))
    valid = F.filter("__slid", C.is_valid_code)
    picked = picked.withColumn("__slid", F.when(F.col("head_over_4").isNotNull() & F.col("digits_over_7").isNotNull(), slid))
    picked = picked.withColumn("sliding", F.coalesce(F.get(valid, F.lit(0)), F.element_at("__slid", -1)))
    tried = [F.concat(*[F.col(x) for x in branch.split("+")]) for branch in (VERTICAL if vertical else HORIZONTAL)]
    size = F.coalesce("size_type", "inside", "size_type_84")
    out = picked.select(key, F.coalesce(*tried, F.lit("")).alias("code"), size.alias("size_type"), "part")
    tail = F.coalesce(F.concat(F.lit(" "), F.coalesce("size_type", "part")), F.lit(""))
    return out.select(key, "code", "size_type", F.concat("code", tail).alias("text"))


def _filled(head: Column, bodies: Column, limit: int) -> Column:
    """head with ordered selections of bodies behind it, each as long as one more fits into ``limit``."""
    state = F.array(F.struct(head.alias("s"), F.array().cast("array<int>").alias("used")))
    for _ in range((11 - 4) // 2):  # a head has four characters and a body two at least
        def more(x: Column) -> Column:
            fits = F.filter(F.transform(bodies, lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda y: ~F.array_contains(x["used"], y["i"]) & (F.length(x["s"]) + F.length(y["b"]) <= limit))
            longer = F.transform(fits, lambda y: F.struct(F.concat(x["s"], y["b"]).alias("s"), F.concat(x["used"], F.array(y["i"])).alias("used")))
            return F.when(F.size(longer) > 0, longer).otherwise(F.array(x))

        state = F.flatten(F.transform(state, more))
    return F.transform(state, lambda x: x["s"])


def _longest(texts: Column) -> Column:
    """Of texts that look like a part of a code the longest, else the longest; the first on ties."""
    order = F.transform(texts, lambda x, i: F.struct(C.code_flags(x)["is_part"].alias("p"), F.length(x).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.array_max(order)["x"]


def generate_codes(tokens: DataFrame, key: str) -> DataFrame:
    """key, code, size_type of tokens (text, score, seq): codes put together from heads and numbers.

    A valid code that was read counts, the most confident first. Else every head takes ordered
    selections of numbers up to eleven characters, then up to nine, and single digits are put behind
    what is short; the first valid one counts. Else a text of nine or ten characters with a good head,
    else the longest of all texts and candidates. Candidates grow with the third power of the numbers
    of one picture, of which a detector gives a few.
    """
    up = tokens.select(key, "seq", F.col("score").cast("double").alias("score"), F.upper("text").alias("text"))
    flags, kind = C.code_flags("text"), C.size_type_class("text")
    token = F.struct(
        "seq", "text", "score", C.is_valid_code("text").alias("good"), flags["candidate"].alias("candidate"), flags["good_head"].alias("head"), flags["good_body"].alias("body"),
        flags["end_digit"].alias("end"), (kind == "good").alias("type"), (kind == "candidate").alias("type_part"),
    )
    frames = up.groupBy(key).agg(F.array_sort(F.collect_list(token)).alias("t"))
    of = lambda flag: F.filter("t", lambda x: x[flag])
    texts = lambda found: F.transform(found, lambda x: x["text"])
    best = lambda found: F.array_max(F.transform(found, lambda x: F.struct(x["score"].alias("score"), (-x["seq"]).alias("s"), x["text"].alias("text"))))["text"]
    frames = frames.withColumns({"heads": texts(of("head")), "bodies": texts(of("body")), "ends": texts(of("end"))})
    filled = lambda limit: F.flatten(F.transform("heads", lambda h: _filled(h, F.col("bodies"), limit)))
    made = F.concat(filled(11), filled(9))
    frames = frames.withColumn("made", F.transform(made, lambda c: F.aggregate("ends", c, lambda s, e: F.when(F.length(s) < 11, F.concat(s, e)).otherwise(s))))
    code = F.coalesce(best(of("good")), F.get(F.filter("made", C.is_valid_code), F.lit(0)), _longest(texts(of("candidate"))), _longest(F.concat(texts(F.col("t")), F.col("made"))), F.lit(""))
    return frames.select(key, code.alias("code"), F.coalesce(best(of("type")), best(of("type_part")), F.lit("")).alias("size_type"))


def try_confusions(codes: DataFrame, owners: DataFrame) -> DataFrame:
    """code, fixed of distinct codes: one confused letter of a known owner, or one confused digit, that makes it valid.

    Letters are tried first, by place and preference. owners (owner) has 26**3 rows at most.
    """
    c = F.col("code")
    # A changed character leaves a code as well formed as it was, and what it adds to the sum is known.
    wrong = c.rlike("^[A-Z]{4}[0-9]{7}$") & ~C.is_valid_code("code")
    right = lambda xs: F.filter(xs, lambda x: (F.col("__sum") + x["d"]) % 11 % 10 == F.col("__end"))
    heads = F.transform(right(_swapped(F.substring(c, 1, 3), LETTERS, 3, 1)), lambda x, i: F.struct(i.alias("rank"), F.concat(x["s"], F.substring(c, F.lit(4), F.length(c))).alias("try"), F.lit(True).alias("letter")))
    numbers = F.transform(right(_swapped(F.substring(c, 5, 6), DIGITS, 6, 5)), lambda x, i: F.struct((i + 1000).alias("rank"), F.concat(F.substring(c, 1, 4), x["s"], F.substring(c, F.lit(11), F.length(c))).alias("try"), F.lit(False).alias("letter")))
    rows = codes.select("code", F.when(wrong, C.weighted_sum(c)).alias("__sum"), F.when(wrong, F.substring(c, 11, 1).try_cast("int")).alias("__end"))
    tries = rows.select("code", F.explode_outer(F.when(F.col("__sum").isNotNull(), F.concat(heads, numbers))).alias("t")).select("code", "t.*")
    known = F.broadcast(owners.select(F.col("owner").alias("__owner")).distinct())
    found = tries.join(known, F.substring("try", 1, 4) == F.col("__owner"), "left")
    good = ~F.col("letter") | F.col("__owner").isNotNull()
    first = found.groupBy("code").agg(F.min_by(F.when(good, F.col("try")), F.when(good, F.col("rank"))).alias("fixed"))
    return first.select("code", F.coalesce("fixed", "code").alias("fixed"))


def plate_mask_decode(rows: DataFrame, probs: str = "probs", provinces: dict[int, list[int]] | None = None, close: tuple[int, int, float] = CLOSE) -> DataFrame:
    """rows with idx and prob, the best class of every step and its probability, under what plates allow.

    The first step is one of ``provinces``; if the first class of ``close`` leads the second one by
    less than the margin they change places. The next two steps are letters of the province that won.
    """
    allowed = provinces or PROVINCES
    a, b, margin = close
    here = F.array(*map(F.lit, allowed))
    first = F.transform(F.get(probs, F.lit(0)), lambda v, i: F.when(F.array_contains(here, i), v).otherwise(0.0))
    out = rows.withColumn("__first", first)
    va, vb = F.get("__first", F.lit(a)), F.get("__first", F.lit(b))
    swap = (va > vb) & (va - vb < margin)
    out = out.withColumn("__first", F.transform("__first", lambda v, i: F.when(swap & (i == a), vb).when(swap & (i == b), va).otherwise(v)))
    at = lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int")
    letters = F.try_element_at(F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("__province"))
    out = out.withColumn("__province", at(F.col("__first"))).withColumn("__letters", letters)
    step = lambda s, i: F.when(i == 0, F.col("__first")).when((i < 3) & F.col("__letters").isNotNull(), F.transform(s, lambda v, j: F.when(F.array_contains("__letters", j), v).otherwise(0.0))).otherwise(s)
    out = out.withColumn("__steps", F.transform(probs, step))
    return out.withColumns({"idx": F.transform("__steps", at), "prob": F.transform("__steps", F.array_max)}).drop("__first", "__province", "__letters", "__steps")
