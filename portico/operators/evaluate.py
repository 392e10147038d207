"""Recognition and detection quality against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import to_half_width
from .boxes import iou, overlap_join
from .quads import quad_overlaps
from .scans import Rounds, ranged, running


def candidate_matches(truth: DataFrame, found: DataFrame, least: float = 0.45) -> DataFrame:
    """Pairs of truth (gt_id) and found boxes (det_id) of one image with their IoU."""
    pairs = overlap_join(truth.withColumnRenamed("det_id", "gt_id"), found, ("gt_id", "cls"), ("det_id", "cls", "conf"))
    return pairs.withColumn("iou", iou()).filter(F.col("iou") > least).select("image_id", F.col("a_gt_id").alias("gt_id"), F.col("a_cls").alias("gt_cls"), F.col("b_det_id").alias("det_id"), F.col("b_cls").alias("det_cls"), F.col("b_conf").alias("conf"), "iou")


def greedy_match(pairs: DataFrame, rounds: int | None = None) -> DataFrame:
    """One-to-one pairs by falling IoU per image (ties: gt_id, det_id).

    A pair that is the best of both its sides is in the greedy result; taking all of them and dropping
    what they block is repeated until nothing is left. Boxes whose best pairs are tied and join every
    one of them with every other (copies) are settled in one round, equal ranks together. A round
    settles the best open pair of every image at least, so rounds end; with a bound on ``rounds`` a
    match that needs more fails.
    """
    done, tables = [], Rounds(pairs.sparkSession)
    (left,) = tables.put(left=pairs)
    while not left.isEmpty():
        if rounds is not None and len(done) >= rounds:
            raise RuntimeError(f"greedy_match: pairs are left after {rounds} rounds")
        ranked, tied = left, []
        for own, other in (("gt_id", "det_id"), ("det_id", "gt_id")):
            box = Window.partitionBy("image_id", own)
            level = Window.partitionBy("image_id", own, "iou")
            ranked = ranked.withColumns({
                f"__rank_{own}": F.row_number().over(box.orderBy(F.desc("iou"), other)), f"__top_{own}": F.max("iou").over(box),
                f"__n_{own}": F.count("*").over(level), f"__set_{own}": F.bit_xor(F.xxhash64(other)).over(level),
            })
            tied += [f"__n_{own}", f"__set_{own}"]
        (ranked,) = tables.put(ranked=ranked.filter((F.col("iou") == F.col("__top_gt_id")) & (F.col("iou") == F.col("__top_det_id"))))
        # Tied boxes with the same partners on both sides; complete if all their best pairs are here.
        groups = ranked.groupBy("image_id", "iou", *tied).agg(F.count("*").alias("__pairs")).filter("__pairs = __n_gt_id * __n_det_id AND __pairs > 1")
        both = ranked.join(groups, ["image_id", "iou", *tied], "left")
        best = F.expr("__rank_gt_id = __rank_det_id AND (__rank_gt_id = 1 OR __pairs IS NOT NULL)")
        (taken,) = tables.put(**{f"taken{len(done)}": both.filter(best).select(*pairs.columns)})
        done.append(taken)
        (left,) = tables.put(left=left.join(taken.select("image_id", "gt_id"), ["image_id", "gt_id"], "left_anti").join(taken.select("image_id", "det_id"), ["image_id", "det_id"], "left_anti"))
    tables.drop("left", "ranked")
    while len(done) > 1:
        done = [a.unionByName(b) for a, b in zip(done[::2], done[1::2], strict=False)] + done[len(done) // 2 * 2 :]
    return done[0] if done else pairs.limit(0)


def ranked_confusion(truth: DataFrame, found: DataFrame, conf: float = 0.25, least: float = 0.45) -> DataFrame:
    """Counts by (predicted, true) class of greedily matched boxes; -1 is background on either side."""
    found = found.filter(F.col("conf") > conf)
    matched = greedy_match(candidate_matches(truth, found, least))
    both = matched.select(F.col("det_cls").alias("pred"), F.col("gt_cls").alias("true"))
    missed = truth.withColumnRenamed("det_id", "gt_id").join(matched.select("image_id", "gt_id"), ["image_id", "gt_id"], "left_anti").select(F.lit(-1).cast("bigint").alias("pred"), F.col("cls").cast("bigint").alias("true"))
    extra = found.join(matched.select("image_id", "det_id"), ["image_id", "det_id"], "left_anti").select(F.col("cls").cast("bigint").alias("pred"), F.lit(-1).cast("bigint").alias("true"))
    return both.select(F.col("pred").cast("bigint"), F.col("true").cast("bigint")).unionAll(missed).unionAll(extra).groupBy("pred", "true").agg(F.count("*").alias("n"))


def normalize_confusion(counts: DataFrame, least: float = 0.005) -> DataFrame:
    """Share of each true class, small shares blank."""
    share = F.col("n") / (F.sum("n").over(Window.partitionBy("true")) + 1e-9)
    return counts.withColumn("share", F.when(share >= least, share))


def _ranked(flags: DataFrame) -> DataFrame:
    """flags with ``down``, by which they are in order, and ``slice``, their range of class and confidence."""
    return ranged(flags.withColumn("down", -F.col("conf")), ["cls", "down", "seq"], "slice")


def average_precision(flags: DataFrame, totals: DataFrame) -> DataFrame:
    """Per class recall and AP: the area, by trapezoids at 101 recall points, under the precision envelope.

    flags: cls, conf, seq, tp (0 or 1); totals: cls, n of ground truth boxes. Running counts go in two
    levels over ranges of class and confidence; after that each class is reduced to the first and last point of
    each recall hundredth, so no task holds a whole class.
    """
    ranked = _ranked(flags)
    curve = running(ranked, "cls", "slice", ["down", "seq"], sums={"tps": F.col("tp"), "k": F.lit(1)}).join(totals, "cls")
    curve = curve.withColumns({"recall": F.col("tps") / F.col("n"), "precision": F.col("tps") / F.col("k"), "up": -F.col("k"), "back": -F.col("slice")})
    env = running(curve, "cls", "back", ["up"], maxima={"env": F.col("precision")})
    g = F.floor(F.col("recall") * 100)
    points = env.groupBy("cls", g.alias("g"), F.when(F.col("recall") == g / 100.0, 0).otherwise(2).alias("kind")).agg(
        F.max("recall").alias("last_r"), F.max_by("env", "k").alias("last_p"), F.min("recall").alias("first_r"), F.min_by("env", "k").alias("first_p")
    )
    classes = points.select("cls").distinct()
    none = F.lit(None).cast("double")
    grid = classes.select("cls", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long"))).alias("g"), F.lit(1).alias("kind"), none.alias("last_r"), none.alias("last_p"), none.alias("first_r"), none.alias("first_p"))
    order = Window.partitionBy("cls").orderBy("g", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    both = points.unionByName(grid)
    last, first = lambda c: F.last(c, ignorenulls=True).over(before), lambda c: F.first(c, ignorenulls=True).over(after)
    at = both.select(
        "cls", "g", "kind", F.coalesce(last("last_r"), F.lit(0.0)).alias("r0"), F.coalesce(last("last_p"), F.lit(1.0)).alias("p0"),
        F.coalesce(first("first_r"), F.lit(1.0)).alias("r1"), F.coalesce(first("first_p"), F.lit(0.0)).alias("p1"), (F.col("g") / 100.0).alias("x"),
    ).filter("kind = 1")
    y = F.when(F.col("r1") > F.col("r0"), F.col("p0") + (F.col("p1") - F.col("p0")) * (F.col("x") - F.col("r0")) / (F.col("r1") - F.col("r0"))).otherwise(F.col("p1"))
    area = F.sum(F.when(F.col("g").isin(0, 100), y / 2).otherwise(y)) / 100
    best = env.groupBy("cls").agg(F.max("recall").alias("recall"))
    return at.groupBy("cls").agg(area.alias("ap")).join(best, "cls")


def ap_ladder(matched: DataFrame, found: DataFrame, totals: DataFrame, levels: int = 10) -> DataFrame:
    """cls, ap50, ap (mean over IoU 0.5, 0.55, ...) of greedily matched pairs of equal class (det_id, iou).

    Greedy matching goes by falling IoU, so the pairs of a higher limit are the first ones of a lower:
    one matching serves all levels.
    """
    flags = found.join(matched.select("image_id", "det_id", "iou"), ["image_id", "det_id"], "left")
    steps = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    flags = flags.withColumn("level", steps).withColumn("tp", F.coalesce((F.col("iou") >= F.lit(0.5) + F.col("level") * 0.05 - 1e-9).cast("int"), F.lit(0)))
    wide = lambda df: df.withColumn("cls", F.col("cls").cast("long") * levels + F.col("level"))
    per = average_precision(wide(flags).select("cls", "conf", F.col("det_id").alias("seq"), "tp"), wide(totals.withColumn("level", steps)).select("cls", "n"))
    level = F.pmod("cls", F.lit(levels))
    per = per.select(F.floor(F.col("cls") / levels).alias("cls"), level.alias("level"), "ap")
    return per.groupBy("cls").agg(F.max(F.when(F.col("level") == 0, F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap"))


GRID = 1000


def best_f1(flags: DataFrame, totals: DataFrame, width: float = 0.1, eps: float = 1e-16) -> DataFrame:
    """Per class precision, recall, F1, true and false positives at the confidence where mean F1 is highest.

    Curves are read at ``GRID`` confidences by linear interpolation, F1 is averaged over classes and
    smoothed by a box of ``width`` of the grid with its ends repeated. flags and totals as in
    ``average_precision``; a class keeps the points next to each grid confidence only.
    """
    top = GRID - 1
    ranked = _ranked(flags)
    curve = running(ranked, "cls", "slice", ["down", "seq"], sums={"tps": F.col("tp"), "k": F.lit(1)}).join(totals, "cls")
    curve = curve.select("cls", "conf", "k", (F.col("tps") / (F.col("n") + eps)).alias("r"), (F.col("tps") / F.col("k")).alias("p"))
    # Between two grid confidences the highest and the lowest point matter; one on the grid is both.
    cell = F.ceil(F.col("conf") * top)
    ends = curve.groupBy("cls", cell.alias("cell")).agg(F.min_by(F.struct("conf", "r", "p"), "k").alias("high"), F.max_by(F.struct("conf", "r", "p"), "k").alias("low"))
    grid = ends.select("cls").distinct().select("cls", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(top).cast("long"))).alias("cell"))
    both = grid.join(ends, ["cls", "cell"], "left")
    w = Window.partitionBy("cls").orderBy("cell")
    # conf in (x(cell - 1), x(cell)]: the next point above x lies in a later cell, the one at or below in this or an earlier one.
    above, below = F.first("low", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.last("high", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = F.col("cell") / float(top)
    at = both.select("cls", "cell", x.alias("x"), above.alias("a"), below.alias("b"))

    def value(c: str, before: float):
        part = (F.col("a.conf") - F.col("x")) / (F.col("a.conf") - F.col("b.conf"))
        mixed = F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * part
        exact = F.when(F.col("b.conf") == F.col("x"), F.col(f"b.{c}"))
        return F.coalesce(exact, F.when(F.col("a").isNull(), F.lit(before)).when(F.col("b").isNull(), F.col(f"a.{c}")).otherwise(mixed))

    read = at.select("cls", "cell", value("r", 0.0).alias("r"), value("p", 1.0).alias("p")).withColumn("f", 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + eps))
    mean = read.groupBy("cell").agg(F.avg("f").alias("f"))
    half = int(round(GRID * width * 2) // 2 + 1) // 2
    # The grid has GRID rows, whatever the input: its ends are repeated and a window slides over it.
    padded = mean.withColumn("copies", F.when(F.col("cell").isin(0, top), F.lit(half)).otherwise(F.lit(0)))
    padded = padded.select("cell", "f", F.explode(F.sequence(F.lit(0), F.col("copies"))).alias("c")).withColumn("place", F.when(F.col("cell") == 0, -F.col("c")).otherwise(F.col("cell") + F.col("c")))
    slide = Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(-half, half)
    best = padded.withColumn("smooth", F.avg("f").over(slide)).filter("c = 0").agg(F.max_by("cell", F.struct(F.round("smooth", 12), -F.col("cell"))).alias("cell"))
    out = read.join(F.broadcast(best), "cell").join(totals, "cls")
    tp = F.round(F.col("r") * F.col("n"))
    return out.select("cls", "cell", F.col("p").alias("precision"), F.col("r").alias("recall"), F.col("f").alias("f1"), tp.alias("tp"), F.round(tp / (F.col("p") + eps) - tp).alias("fp"))


def matched_fields(truth: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """Fields (image_id, truth, found) of quads matched greedily by falling IoU, ``least`` at least.

    truth: image_id, gt_id, quad, ignore, text; found: image_id, det_id, quad, text. A match with ignored
    truth counts nowhere; what is unmatched has a null on the other side, ignored truth aside. Found
    quads of images without a truth file are left out.
    """
    found = found.join(truth.select("image_id").distinct(), "image_id", "left_semi")
    pairs = quad_overlaps(truth, found, "gt_id", "det_id").filter(F.col("iou") >= least).select("image_id", "gt_id", "det_id", "iou")
    taken = greedy_match(pairs)
    t = truth.select("image_id", "gt_id", "ignore", to_half_width("text").alias("truth"))
    f = found.select("image_id", "det_id", to_half_width("text").alias("found"))
    left = t.join(taken.select("image_id", "gt_id", "det_id"), ["image_id", "gt_id"], "left")
    both = left.join(f, ["image_id", "det_id"], "full_outer")
    return both.filter("coalesce(ignore, false) = false").select("image_id", "truth", "found")


def end_to_end_score(fields: DataFrame, images: DataFrame | None = None, eps: float = 1e-9) -> DataFrame:
    """One row of totals from fields (image_id, truth, found), either of them null where unmatched.

    Edits per character and per field go by the truth, edits per image by the images (image_id) with a
    truth file, those of the fields if not given.
    """
    d = F.levenshtein(F.coalesce("truth", F.lit("")), F.coalesce("found", F.lit("")))
    sums = fields.agg(
        F.coalesce(F.sum((F.col("truth") == F.col("found")).cast("int")), F.lit(0)).alias("hits"), F.count("truth").alias("truths"), F.count("found").alias("founds"),
        F.coalesce(F.sum(d), F.lit(0)).alias("edits"), F.coalesce(F.sum(F.length("truth")), F.lit(0)).alias("chars"),
    )
    n = (fields if images is None else images).agg(F.count_distinct("image_id").alias("images"))
    s = sums.crossJoin(n)  # one row each
    p, r = F.col("hits") / (F.col("founds") + eps), F.col("hits") / (F.col("truths") + eps)
    return s.select(
        "hits", "truths", "founds", p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + eps)).alias("f_score"), (1 - F.col("edits") / (F.col("chars") + eps)).alias("char_accuracy"),
        (F.col("edits") / (F.col("truths") + eps)).alias("edit_per_field"), F.try_divide("edits", "images").alias("edit_per_image"),
    )


def overlap_tables(truth: DataFrame, found: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Truth without ignored quads, found quads without those mostly on an ignored one, and their overlaps.

    Overlaps (image_id, gt_id, det_id, sigma, tau): the common share of truth and of found, in hundredths.
    """
    ignored = quad_overlaps(truth.filter("ignore"), found, "gt_id", "det_id").filter(F.col("iod") > least)
    good, left = truth.filter("NOT ignore"), found.join(ignored.select("image_id", "det_id").distinct(), ["image_id", "det_id"], "left_anti")
    share = lambda over: F.round(F.col("inter") / F.col(over), 2)
    pairs = quad_overlaps(good, left, "gt_id", "det_id").select("image_id", "gt_id", "det_id", share("area_a").alias("sigma"), share("area_b").alias("tau"))
    return good, left, pairs


def _claims(pairs: DataFrame, own: str, other: str, alone: Column, together: Column, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """Quads (own) that lie in one or several free ones of the other side (other), each free one taken once.

    In order of own, a quad looks at those of its pairs whose other is still free and takes them all if
    ``alone`` (one pair) or ``together`` (an aggregate of several) holds. A quad that shares no free other
    with an earlier open one can be settled at once; that is repeated until none is open. Gives credits
    (image_id, own, n, same: taken with n others) and the taken pairs.
    """
    credits, taken, n = [], [], 0
    (left,) = rounds.put(**{f"{own}_open": pairs})
    while not left.isEmpty():
        first = F.min(own).over(Window.partitionBy("image_id", other))
        ready = left.withColumn("__first", first).groupBy("image_id", own).agg(
            F.min((F.col("__first") == F.col(own)).cast("int")).alias("ready"), F.count("*").alias("n"), F.min_by("same", other).alias("same"), F.min_by(alone, other).alias("alone"), together.alias("together"),
        ).filter("ready = 1")
        (settled,) = rounds.put(**{f"{own}_settled{n}": ready.select("image_id", own, "n", "same", F.when(F.col("n") == 1, F.col("alone")).otherwise(F.col("together")).alias("won"))})
        won = settled.filter("won")
        (gone,) = rounds.put(**{f"{own}_gone{n}": left.join(won.select("image_id", own), ["image_id", own], "left_semi").select("image_id", "gt_id", "det_id")})
        rest = left.join(settled.select("image_id", own), ["image_id", own], "left_anti").join(gone.select("image_id", other), ["image_id", other], "left_anti")
        (left,) = rounds.put(**{f"{own}_open": rest})
        credits.append(won.select("image_id", "n", "same"))
        taken.append(gone)
        n += 1
    rounds.drop(f"{own}_open")
    none = pairs.limit(0)
    out, all_taken = none.select("image_id", F.lit(0).cast("long").alias("n"), "same"), none.select("image_id", "gt_id", "det_id")
    for c, t in zip(credits, taken, strict=True):
        out, all_taken = out.unionByName(c), all_taken.unionByName(t)
    return out, all_taken


def area_match_score(truth: DataFrame, found: DataFrame, tr: float = 0.7, tp: float = 0.6, part: float = 0.8, k: int = 2) -> DataFrame:
    """One row: area-match recall, precision and F, and the same end to end, by one-to-one, split and merged quads.

    Texts are equal whatever their case. First come pairs that have each other alone, then truths in
    several found quads, then found quads over several truths; the last two by order-respecting rounds
    over the overlaps. Sums of shares are those of hundredths, exact.
    """
    good, left, pairs = overlap_tables(truth, found)
    text = lambda df, i: df.select("image_id", i, F.lower(F.trim("text")).alias(f"__{i}"))
    rows = pairs.join(text(good, "gt_id"), ["image_id", "gt_id"]).join(text(left, "det_id"), ["image_id", "det_id"])
    of = lambda i: Window.partitionBy("image_id", i)
    count = lambda c, i: F.sum(c.cast("int")).over(of(i))
    strong, tight = F.col("sigma") > tr, F.col("tau") > tp
    rows = rows.select("image_id", "gt_id", "det_id", "sigma", "tau", F.coalesce(F.col("__gt_id") == F.col("__det_id"), F.lit(False)).alias("same"))
    rows = rows.withColumns({
        "gs": count(strong, "gt_id"), "gt": count(tight, "gt_id"), "ds": count(strong, "det_id"), "dt": count(tight, "det_id"),
        "kg": count(F.col("sigma") > 0, "gt_id"), "kd": count(F.col("tau") > 0, "det_id"),
    })
    rounds = Rounds(truth.sparkSession)
    (rows,) = rounds.put(rows=rows)
    pairing = rows.filter("gs = 1 AND gt = 1").groupBy("image_id", "gt_id").agg(
        F.max((strong & (F.col("ds") == 1)).cast("int")).alias("a"), F.max((tight & (F.col("dt") == 1)).cast("int")).alias("b"), F.max(F.when(strong, F.struct("det_id", "same"))).alias("s"),
    ).filter("a = 1 AND b = 1")
    (one,) = rounds.put(one=pairing.select("image_id", "gt_id", "s.det_id", "s.same"))
    without = lambda df, taken: df.join(taken.select("image_id", "gt_id"), ["image_id", "gt_id"], "left_anti").join(taken.select("image_id", "det_id"), ["image_id", "det_id"], "left_anti")
    total = lambda c: F.sum(F.col(c).cast("decimal(10,2)"))
    free = without(rows, one)
    split, in_parts = _claims(free.filter((F.col("tau") >= tp) & (F.col("kg") >= k)), "gt_id", "det_id", F.col("sigma") >= tr, total("sigma") >= F.lit(tr).cast("decimal(10,2)"), rounds)
    free = without(free, in_parts)
    merged, _ = _claims(free.filter((F.col("sigma") >= tp) & (F.col("kd") >= k)), "det_id", "gt_id", (F.col("tau") >= tp) & (F.col("sigma") >= tr), total("tau") >= F.lit(tp).cast("decimal(10,2)"), rounds)
    # A quad taken with several others counts ``part``, and so does each of these.
    several = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.col("n") * part)
    single = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.lit(part))
    credit = lambda df, recall, precision: df.select(recall.alias("recall"), precision.alias("precision"), F.col("same").cast("long").alias("hits"))
    credits = credit(one, F.lit(1.0), F.lit(1.0)).unionAll(credit(split, single, several)).unionAll(credit(merged, several, single))
    sums = credits.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("recall", "precision", "hits")])
    s = sums.crossJoin(good.agg(F.count("*").alias("truths"))).crossJoin(left.agg(F.count("*").alias("founds")))  # one row each
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    f = lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    p, r, pe, re = share("precision", "founds"), share("recall", "truths"), share("hits", "founds"), share("hits", "truths")
    return s.select(
        "truths", "founds", "hits", F.col("recall").alias("recall_credit"), r.alias("recall"), p.alias("precision"), f(p, r).alias("f_score"),
        F.when(F.col("recall") > 0, 1 - F.col("hits") / F.col("recall")).otherwise(1.0).alias("sequence_error"), re.alias("recall_e2e"), pe.alias("precision_e2e"), f(pe, re).alias("f_score_e2e"),
    )


#: Weights of precision, recall, mAP at 0.5 and mAP over the ladder; for boxes and masks both count alike.
FITNESS = {"p": 0.0, "r": 0.0, "map50": 0.1, "map": 0.9}


def fitness(df: DataFrame, masks: bool = False) -> DataFrame:
    """df with its fitness; with ``masks`` the columns of the masks (mask_p, ...) are added to those of the boxes."""
    terms = [F.col(f"{kind}{c}") * w for kind in (("", "mask_") if masks else ("",)) for c, w in FITNESS.items() if w]
    total = terms[0]
    for x in terms[1:]:
        total = total + x
    return df.withColumn("fitness", total)


def best_run(df: DataFrame, masks: bool = False) -> DataFrame:
    return fitness(df, masks).agg(F.max_by("generation", F.struct("fitness", -F.col("generation"))).alias("generation"), F.max("fitness").alias("fitness"))


def running_mean(df: DataFrame, key: str, chunk: str, order: list[str], value: str, n: str) -> DataFrame:
    """df with ``mean``, the mean of value weighted by n over the rows up to this one, in two levels over chunks."""
    out = running(df, key, chunk, order, sums={"__s": F.col(value) * F.col(n), "__w": F.col(n)})
    return out.withColumn("mean", F.try_divide("__s", "__w")).drop("__s", "__w")


def mean_iou(df: DataFrame) -> DataFrame:
    """Mean over classes of agreeing positions over positions of either label."""
    both = df.filter(F.col("pred") == F.col("true")).groupBy(F.col("true").alias("c")).agg(F.count("*").alias("i"))
    either = df.select(F.explode(F.array_distinct(F.array("pred", "true"))).alias("c")).groupBy("c").agg(F.count("*").alias("u"))
    return either.join(both, "c", "left").agg(F.avg(F.coalesce("i", F.lit(0)) / F.col("u")).alias("mean_iou"), F.count("*").alias("classes"))


def image_confidence(df: DataFrame, least: float = 0.25) -> DataFrame:
    """Per image and class the summed confidence of boxes above a limit over their count, one at least."""
    good = F.col("conf") >= least
    return df.groupBy("image_id", "cls").agg((F.sum(F.when(good, F.col("conf")).otherwise(0.0)) / F.greatest(F.lit(1), F.sum(good.cast("int")))).alias("confidence"))


def convert_labels(items: DataFrame, truth: bool, least: float = 0.5) -> DataFrame:
    """Label items (transcription, score) as evaluation fields: ideographic blanks plain, ``###`` ignored, weak guesses left out."""
    out = items if truth else items.filter(F.coalesce(F.col("score").try_cast("double"), F.lit(1.0)) >= least)
    return out.withColumns({"ignore": F.lit(truth) & (F.col("transcription") == "###"), "text": F.translate("transcription", "　", " ")})
