"""Curation of label datasets: verification, splits, weights, batches, statistics.

Labels are rows of image_path, cls, xc, yc, w, h and line_no.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scans import cut, ranged, running

BOX = ["cls", "xc", "yc", "w", "h"]


def label_path(image: Column | str) -> Column:
    """The label file of an image: the last images folder becomes labels, the extension txt."""
    return F.regexp_replace(F.regexp_replace(image, r"^(.*)/images/(.*)$", "$1/labels/$2"), r"\.[^./]*$", ".txt")


def verify_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Per image (image_path, width, height): status found, missing, empty or corrupt, with counts.

    ``images`` may carry labelled = false for images without a label file.
    """
    bad = (F.col("cls") < 0) | F.least("xc", "yc", "w", "h").__lt__(0) | F.greatest("xc", "yc", "w", "h").__gt__(1)
    per = labels.groupBy("image_path").agg(F.count("*").alias("rows"), F.max(bad.cast("int")).alias("bad"), F.count_distinct(F.struct(*BOX)).alias("distinct_rows"))
    out = images.join(per, "image_path", "left")
    small = (F.col("width") < 10) | (F.col("height") < 10)
    status = (
        F.when(small | (F.coalesce("bad", F.lit(0)) == 1), "corrupt").when(F.col("rows") > 0, "found").when(F.col("labelled"), "empty").otherwise("missing")
    )
    return out.select("image_path", status.alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce(F.col("rows") - F.col("distinct_rows"), F.lit(0)).alias("duplicates"))


#: Columns of a label line with landmarks: class, box, and four points.
LANDMARKS = [*BOX, *(f"{c}{i}" for i in range(1, 5) for c in "xy")]


def verify_landmarks(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Per image its status, as ``verify_labels``, by the rules for label lines with landmarks.

    labels: image_path and ``fields``, the numbers of a line. Each line has 13 of them, none below -1 (a
    point that is not there) and, but for the class, none above 1; equal lines make the file corrupt. A
    line that holds no numbers (null, or a null among them) makes it corrupt too.
    """
    f = F.col("fields")
    wrong = f.isNull() | (F.size(f) != len(LANDMARKS)) | F.exists(f, lambda x: x.isNull() | F.isnan(x) | (x < -1)) | F.exists(F.slice(f, 2, len(LANDMARKS)), lambda x: x > 1)
    # As single precision, in which lines are compared.
    per = labels.groupBy("image_path").agg(F.count("*").alias("rows"), F.max(F.coalesce(wrong, F.lit(True)).cast("int")).alias("bad"), F.count_distinct(F.transform(f, lambda x: x.cast("float"))).alias("__u"))
    out = images.join(per, "image_path", "left")
    corrupt = (F.col("width") < 10) | (F.col("height") < 10) | (F.coalesce("bad", F.lit(0)) == 1) | (F.col("rows") > F.col("__u"))
    status = F.when(corrupt, "corrupt").when(F.col("rows") > 0, "found").when(F.col("labelled"), "empty").otherwise("missing")
    return out.select("image_path", status.alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"))


def bucket_of(path: Column | str, buckets: int = 64) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(path), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def bucket_prints(files: DataFrame, buckets: int = 64) -> DataFrame:
    """b, print of each bucket of a file list (image_path, and any columns that tell a change, such as sizes and times)."""
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(files.columns) if c != "image_path"]
    text = F.concat_ws("\x01", "image_path", *rest)
    h = lambda start: F.conv(F.substring(F.md5(text), start, 15), 16, 10).cast("long")
    parts = files.groupBy(bucket_of("image_path", buckets).alias("b")).agg(F.bit_xor(h(1)).alias("x"), F.sum(h(16).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    return parts.select("b", F.concat_ws(":", "x", "s", "n").alias("print"))


def verify_changed(images: DataFrame, labels: DataFrame, before: tuple[DataFrame, DataFrame] | None = None, buckets: int = 64, verify=verify_labels) -> tuple[DataFrame, DataFrame]:
    """What ``verify`` says of all images, and the prints of their buckets: together the ``before`` of the next call.

    images tell of a change by their columns (sizes and times of image and label file). Only images of
    buckets whose print is new or another one, and only their labels, are verified; the rest is taken from
    before, whose buckets that are gone are left out.
    """
    prints = cut(bucket_prints(images, buckets))
    if before is None:
        return verify(images, labels), prints
    verified, old = before
    changed = prints.join(old.withColumnRenamed("print", "__old"), "b", "full_outer")
    dirty = F.broadcast(changed.filter(~F.col("print").eqNullSafe(F.col("__old"))).select("b"))  # no more rows than ``buckets``
    of = lambda df: df.withColumn("b", bucket_of("image_path", buckets))
    again = verify(of(images).join(dirty, "b", "left_semi").drop("b"), of(labels).join(dirty, "b", "left_semi").drop("b"))
    return of(verified).join(dirty, "b", "left_anti").drop("b").unionByName(again), prints


def scan_summary(verified: DataFrame) -> DataFrame:
    n = lambda s: F.sum((F.col("status") == s).cast("int")).alias(s)
    return verified.agg(n("found"), n("missing"), n("empty"), n("corrupt"), F.count("*").alias("total"), F.sum("duplicates").alias("duplicates"))


def dedup_labels(labels: DataFrame) -> DataFrame:
    """The first line of equal labels of an image."""
    return labels.groupBy("image_path", *BOX).agg(F.min("line_no").alias("line_no"))


def dataset_stats(labels: DataFrame, split: str) -> DataFrame:
    """Instances and images per split and class, with totals (class null) and a grand total."""
    return labels.rollup(split, "cls").agg(F.count("*").alias("instances"), F.count_distinct("image_path").alias("images"))


def class_weights(labels: DataFrame, classes: int) -> DataFrame:
    """Inverse frequencies that sum to one; a class without labels counts as one."""
    spark = labels.sparkSession
    counts = labels.groupBy("cls").agg(F.count("*").alias("n"))
    full = spark.range(classes).select(F.col("id").cast("int").alias("cls")).join(counts, "cls", "left").withColumn("inv", 1 / F.coalesce("n", F.lit(1)))
    return full.select("cls", (F.col("inv") / F.sum("inv").over(Window.partitionBy())).alias("weight"))  # one row per class


def image_weights(labels: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of the class weights of an image's labels; weights has one row per class and is broadcast."""
    return labels.join(F.broadcast(weights), "cls").groupBy("image_path").agg(F.sum("weight").alias("weight"))


def uniform(key: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) fixed by key and seed, whatever the order of rows."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(16**12))


def autosplit(images: DataFrame, weights: tuple[float, float, float] = (0.9, 0.1, 0.0), seed: int = 0) -> DataFrame:
    """images with a split that does not change when images are added."""
    u = uniform("image_path", seed)
    return images.withColumn("split", F.when(u < weights[0], "train").when(u < weights[0] + weights[1], "val").otherwise("test"))


def weighted_sample(weights: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k draws with replacement in proportion to weight: draw, key.

    Keys stand in an order by hash, cut in ranges. Draws are put into the order of the cumulative
    weights; the last interval that begins at or before a draw is the one it falls into.
    """
    w = weights.select(F.col(key).alias("__key"), "weight").withColumn("place", F.floor(uniform("__key", seed) * 256)).withColumn("one", F.lit(0))
    cum = running(ranged(w, ["place", "__key"], "chunk"), "one", "chunk", ["place", "__key"], sums={"upto": F.col("weight")})
    cum = cut(cum.select("__key", (F.col("upto") - F.col("weight")).alias("x"), "upto"))
    total = cum.agg(F.max("upto").alias("total"))
    draws = weights.sparkSession.range(k).select(F.col("id").alias("draw"), uniform("id", seed + 1).alias("u")).crossJoin(F.broadcast(total))  # one row
    begun = cum.select(F.lit(None).cast("long").alias("draw"), "x", F.struct("x", "upto", "__key").alias("begun"))
    both = begun.unionByName(draws.select("draw", (F.col("u") * F.col("total")).alias("x"), F.lit(None).cast(begun.schema["begun"].dataType).alias("begun")))
    order = ["x", "mark", "tie"]
    both = both.withColumns({"one": F.lit(0), "mark": F.col("draw").isNotNull().cast("int"), "tie": F.coalesce("draw", F.hash("begun.__key").cast("long"))})
    placed = running(ranged(both, order, "chunk"), "one", "chunk", order, maxima={"last": F.col("begun")})
    return placed.filter("draw IS NOT NULL AND x < last.upto").select("draw", F.col("last.__key").alias(key))


def filter_dataset(labels: DataFrame, least: int = 0, classes: list[int] | None = None, single: bool = False) -> DataFrame:
    """Labels of some classes, merged to one if asked, of images that keep ``least`` of them."""
    out = labels if classes is None else labels.filter(F.col("cls").isin(classes))
    many = out.groupBy("image_path").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    out = out.join(many.select("image_path"), "image_path", "left_semi")
    return out.withColumn("cls", F.lit(0)) if single else out


def _ordered(images: DataFrame, value: str) -> DataFrame:
    """images with ``k``, their place from 1 in the order of value, hash of the path and path.

    The whole order is cut in ranges, so equal values (one camera's pictures share a ratio) are spread too.
    """
    order = [value, "__u", "image_path"]
    placed = ranged(images.withColumn("__u", uniform("image_path")), order, "__slice").withColumn("__one", F.lit(0))
    return running(placed, "__one", "__slice", order, sums={"k": F.lit(1)}).drop("__u", "__one", "__slice")


def rect_batches(images: DataFrame, n: int, side: int = 640, stride: int = 32, pad: float = 0.5) -> DataFrame:
    """Batches of n images in order of height over width, each with its padded shape."""
    shaped = images.withColumn("ar", F.col("height") / F.col("width"))
    placed = _ordered(shaped, "ar").withColumn("batch", F.floor((F.col("k") - 1) / n))
    shape = placed.groupBy("batch").agg(F.count("*").alias("images"), F.min("ar").alias("low"), F.max("ar").alias("high"))
    h = F.when(F.col("high") < 1, F.col("high")).otherwise(1.0)
    w = F.when((F.col("high") >= 1) & (F.col("low") > 1), 1 / F.col("low")).otherwise(1.0)
    up = lambda c: (F.ceil(c * side / stride + pad) * stride).cast("int")
    return shape.select("batch", "images", up(h).alias("batch_h"), up(w).alias("batch_w"))


def width_batches(images: DataFrame, n: int, base: float) -> DataFrame:
    """Batches of n images in order of width over height, each with its largest ratio, ``base`` at least."""
    placed = _ordered(images.withColumn("wh", F.col("width") / F.col("height")), "wh").withColumn("batch", F.floor((F.col("k") - 1) / n))
    return placed.groupBy("batch").agg(F.count("*").alias("images"), F.greatest(F.max("wh"), F.lit(base)).alias("ratio"))


def scale_plan(scales: list[tuple[int, int]], first: int, fixed: bool = True, factor: tuple[int, int] = (8, 16)) -> list[tuple[int, int, int]]:
    """(width, height, batch size) of each scale: sides are multiples of ``factor``; without ``fixed`` a batch has as many pixels as the first."""
    pixels = scales[0][0] * scales[0][1] * first
    down = [(w // factor[0] * factor[0], h // factor[1] * factor[1]) for w, h in scales]
    return [(w, h, first if fixed else max(1, pixels // (w * h))) for w, h in down]


def multi_scale_batches(images: DataFrame, plan: list[tuple[int, int, int]], widest: float = 480.0) -> DataFrame:
    """batch, width, height, samples, ratio of batches that take the scales of plan in turn, in order of width over height.

    A sample's batch follows from its place by division: a turn of the plan takes a fixed number of
    samples. The last batch is filled up from the first samples. The ratio is the mean of its samples,
    as far as the width stays under ``widest``.
    """
    starts, turn = [], 0
    for _, _, size in plan:
        starts.append(turn)
        turn += size
    placed = _ordered(images.withColumn("wh", F.col("width") / F.col("height")), "wh").withColumn("__p", F.col("k") - 1)
    total = placed.agg(F.count("*").alias("__all"))
    rows = placed.crossJoin(F.broadcast(total))  # one row
    # The batch that the last sample is in may lack some: the first samples are seen again behind the last.
    scale_of = lambda p: F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= p % turn)) - 1
    size, start = F.array(*[F.lit(x[2]) for x in plan]), F.array(*map(F.lit, starts))
    last = F.col("__all") - 1
    end = F.floor(last / turn) * turn + F.get(start, scale_of(last)) + F.get(size, scale_of(last))
    again = F.when(F.col("__p") < end - F.col("__all"), F.array("__p", F.col("__p") + F.col("__all"))).otherwise(F.array("__p"))
    seen = rows.withColumn("__at", F.explode(again)).withColumn("__s", scale_of(F.col("__at")))
    seen = seen.withColumn("batch", F.floor(F.col("__at") / turn) * len(plan) + F.col("__s"))
    of = lambda i: F.get(F.array(*[F.lit(x[i]) for x in plan]), F.col("__s"))
    per = seen.groupBy("batch", of(0).alias("width"), of(1).alias("height")).agg(F.count("*").alias("samples"), F.avg("wh").alias("mean"))
    return per.select("batch", "width", "height", "samples", F.least(F.col("mean"), F.lit(widest) / F.col("height")).alias("ratio"))


def replica_batches(images: DataFrame, plan: list[tuple[int, int, int]], replicas: int = 1, seed: int = 0, shuffled: bool = True) -> DataFrame:
    """replica, batch, position, width, height, place, image_path: what each replica sees, batch by batch, in one epoch.

    Samples (shuffled by a hash of seed and path, else in order of path) are dealt to replicas in turn, as
    many to each: the last ones to come are filled up with the first. A replica's samples fill the scales of
    plan in turn; its last batch is filled up with its first samples. Its batches are shuffled by a hash
    of seed and replica: ``batch`` counts in that order, ``place`` in the plan's.
    """
    turn, starts = sum(x[2] for x in plan), [sum(x[2] for x in plan[:i]) for i in range(len(plan))]
    order = ["__u", "image_path"]
    rows = images.select("image_path").withColumns({"__u": uniform("image_path", seed) if shuffled else F.lit(0.0), "__one": F.lit(0)})
    placed = running(ranged(rows, order, "__slice"), "__one", "__slice", order, sums={"k": F.lit(1)}).select("image_path", (F.col("k") - 1).alias("k"))
    total = placed.agg(F.count("*").alias("all"), F.ceil(F.count("*") / replicas).alias("own"))
    size, start = F.array(*[F.lit(x[2]) for x in plan]), F.array(*map(F.lit, starts))
    scale_of = lambda p: F.size(F.filter(start, lambda s: s <= p % turn)) - 1
    rows = placed.crossJoin(F.broadcast(total))  # one row
    seen = rows.select("image_path", "own", F.explode(F.sequence(F.col("k"), F.greatest(F.col("k"), F.col("own") * replicas - 1), F.col("all"))).alias("p"))
    seen = seen.select("image_path", "own", (F.col("p") % replicas).cast("int").alias("replica"), F.floor(F.col("p") / replicas).alias("at"))
    last = F.col("own") - 1
    end = F.floor(last / turn) * turn + F.get(start, scale_of(last)) + F.get(size, scale_of(last))
    # The last batch may need a replica's samples several times over.
    seen = seen.select("image_path", "replica", F.explode(F.sequence(F.col("at"), F.greatest(F.col("at"), end - 1), F.col("own"))).alias("at"))
    s = scale_of(F.col("at"))
    seen = seen.withColumns({"__s": s, "place": (F.floor(F.col("at") / turn) * len(plan) + s).cast("long"), "position": (F.col("at") % turn - F.get(start, s)).cast("int")})
    of = lambda i: F.get(F.array(*[F.lit(x[i]) for x in plan]), F.col("__s"))
    seen = seen.select("replica", "place", "position", of(0).alias("width"), of(1).alias("height"), "image_path")
    if not shuffled:
        return seen.withColumn("batch", F.col("place"))
    batches = seen.select("replica", "place").distinct().withColumn("__u", uniform(F.concat_ws("/", F.col("replica").cast("string"), F.col("place").cast("string")), seed + 1))
    by = ["replica", "__u", "place"]
    numbered = running(ranged(batches, by, "__slice"), "replica", "__slice", by[1:], sums={"n": F.lit(1)})
    return seen.join(numbered.select("replica", "place", (F.col("n") - 1).alias("batch")), ["replica", "place"])


def log_density(labels: DataFrame, x: str, y: str, n: int = 100) -> DataFrame:
    """labels with ``density``, the logarithm of the labels in their cell of an even grid of n edges each way."""
    ends = labels.agg(*[f(c).alias(f"__{k}_{c}") for c in (x, y) for k, f in (("low", F.min), ("high", F.max))])
    wide = lambda c: F.greatest(F.col(f"__high_{c}") - F.col(f"__low_{c}"), F.lit(1e-12))
    cell = lambda c: F.least(F.greatest(F.floor((F.col(c) - F.col(f"__low_{c}")) / wide(c) * (n - 1)), F.lit(0)), F.lit(n - 2))
    rows = labels.crossJoin(F.broadcast(ends)).withColumns({"__i": cell(x), "__j": cell(y)})  # one row
    counts = rows.groupBy("__i", "__j").agg(F.log(F.count("*")).alias("density"))  # (n - 1)**2 cells at most
    return rows.join(F.broadcast(counts), ["__i", "__j"]).select(*labels.columns, "density")


def label_spread(labels: DataFrame) -> DataFrame:
    """cls, n and mean and standard deviation of centre and size."""
    return labels.groupBy("cls").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in BOX[1:] for k, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def label_histograms(labels: DataFrame, bins: int = 50) -> DataFrame:
    """Counts by class, by bins of the centre and by bins of the size, in one table."""
    at = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("long")
    kinds = F.array(
        F.struct(F.lit("class").alias("kind"), F.col("cls").cast("long").alias("i"), F.lit(0).cast("long").alias("j")),
        F.struct(F.lit("centre").alias("kind"), at("xc").alias("i"), at("yc").alias("j")),
        F.struct(F.lit("size").alias("kind"), at("w").alias("i"), at("h").alias("j")),
    )
    return labels.select(F.explode(kinds).alias("b")).groupBy("b.kind", "b.i", "b.j").agg(F.count("*").alias("n"))


def flatten_names(files: DataFrame) -> DataFrame:
    """File names without folders; of equal names the last path wins."""
    return files.groupBy(F.regexp_extract("path", "([^/]*)$", 1).alias("name")).agg(F.max("path").alias("path"))


def fingerprint(files: DataFrame, buckets: int = 64) -> DataFrame:
    """One hash of a file list (path, size): of hashes of its buckets, so no task sees the whole list."""
    digest = lambda text, n: F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("long")
    rows = files.select(F.pmod(digest(F.col("path"), 8), F.lit(buckets)).alias("b"), digest(F.concat_ws(":", "path", F.col("size").cast("string")), 15).alias("h"), "size")
    parts = rows.groupBy("b").agg(F.bit_xor("h").alias("x"), F.sum("size").alias("s"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("b", "x", "s", "n"))), lambda p: F.concat_ws(":", *[p[c].cast("string") for c in ("b", "x", "s", "n")]))
    return parts.agg(F.sha2(F.array_join(ordered, ","), 256).alias("fingerprint"), F.sum("n").alias("files"))


def anchor_sizes(labels: DataFrame, side: float, least: float = 2.0) -> DataFrame:
    """w, h in pixels of the labels that are ``least`` or more either way."""
    return labels.select((F.col("w") * side).alias("w"), (F.col("h") * side).alias("h")).filter((F.col("w") >= least) | (F.col("h") >= least))


def kmeans_anchors(labels: DataFrame, side: float, n: int = 9, least: float = 2.0, seed: int = 0) -> DataFrame:
    """anchor, w, h: n anchor sizes by k-means over whitened label sizes, by area.

    With fewer distinct sizes than anchors, or a size that is the same for all, they are drawn at random
    from seed, up to ``side``.
    """
    sizes = anchor_sizes(labels, side, least)
    s = sizes.agg(F.stddev_pop("w").alias("sw"), F.stddev_pop("h").alias("sh"), F.count_distinct("w", "h").alias("n")).first()
    if not s["sw"] or not s["sh"] or s["n"] < n:
        drawn = np.sort(np.random.default_rng(seed).random(2 * n)).reshape(n, 2) * side
        return _anchors(labels.sparkSession, drawn)
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(sizes.select((F.col("w") / s["sw"]).alias("a"), (F.col("h") / s["sh"]).alias("b")))
    centres = np.array(KMeans(k=n, seed=seed).fit(data).clusterCenters())
    return _anchors(labels.sparkSession, centres * np.array([s["sw"], s["sh"]]))


def _anchors(spark: SparkSession, sizes: np.ndarray) -> DataFrame:
    rows = sorted(((float(w), float(h)) for w, h in sizes), key=lambda x: (x[0] * x[1], x))
    return spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(rows)], "anchor int, w double, h double")


def _fit_of(w: Column, h: Column, a: Column, b: Column) -> Column:
    """How far a size is from an anchor: the worse of its two ratios, 1 at best. A side of 0 fits nothing."""
    return F.when((w > 0) & (h > 0), F.least(w / a, a / w, h / b, b / h)).otherwise(0.0)


def anchor_scores(sizes: DataFrame, candidates: list[list[tuple[float, float]]], limit: float = 4.0) -> list[float]:
    """The fitness of each set of anchors: the mean over sizes (w, h, and n how often) of the best fit, fits of 1/limit or less counting 0.

    All sets, of as many anchors each, are data in one row and are scored in one pass over the sizes, by
    code that stays the same for other sets. The sums are decimals, so their order is of no account.
    """
    one = sizes.sparkSession.createDataFrame([([(i, [float(x[0]) for x in c], [float(x[1]) for x in c]) for i, c in enumerate(candidates)],)], "cs array<struct<i: int, a: array<double>, b: array<double>>>")
    rows = sizes.crossJoin(F.broadcast(one)).select("w", "h", "n", F.explode("cs").alias("c"))  # one row
    fits = [_fit_of(F.col("w"), F.col("h"), F.get(F.col("c.a"), F.lit(k)), F.get(F.col("c.b"), F.lit(k))) for k in range(len(candidates[0]))]
    rows = rows.select(F.col("c.i").alias("i"), "n", F.greatest(F.lit(0.0), *fits).alias("best"))
    value = F.when(F.col("best") > 1 / limit, F.col("best")).otherwise(0.0).cast("decimal(18,15)")
    found = {r["i"]: float(r["s"] / r["n"]) for r in rows.groupBy("i").agg(F.sum(value * F.col("n")).alias("s"), F.sum("n").alias("n")).collect()}  # one row a set
    return [found.get(i, 0.0) for i in range(len(candidates))]


#: How likely a side is changed, how much, and between which factors.
MUTATION, SIGMA, FACTORS = 0.9, 0.1, (0.3, 3.0)


def evolve_anchors(labels: DataFrame, anchors: DataFrame, side: float, generations: int = 50, mutants: int = 20, limit: float = 4.0, least: float = 2.0, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """Anchors refined by seeded mutation, and the fitness after each generation.

    A generation's mutants are scored together; the fittest one is the parent of the next if it is fitter
    than its parent. Equal sizes are counted once, before the first generation.
    """
    rng, spark = np.random.default_rng(seed), labels.sparkSession
    sizes = cut(anchor_sizes(labels, side, least).groupBy("w", "h").agg(F.count("*").alias("n")))
    parent = np.array([(r["w"], r["h"]) for r in anchors.orderBy("anchor").collect()])  # a handful of anchors
    fitness = anchor_scores(sizes, [parent.tolist()], limit)
    for _ in range(generations):
        children = []
        while len(children) < mutants:
            changed = rng.random(parent.shape) < MUTATION
            factor = np.clip(changed * rng.random() * rng.standard_normal(parent.shape) * SIGMA + 1, *FACTORS)
            if (factor != 1).any():
                children.append(np.maximum(parent * factor, 2.0))
        scores = anchor_scores(sizes, [c.tolist() for c in children], limit)
        best = int(np.argmax(scores))
        if scores[best] > fitness[-1]:
            parent = children[best]
        fitness.append(max(scores[best], fitness[-1]))
    return _anchors(spark, parent), fitness


def anchor_fit(labels: DataFrame, anchors: list[tuple[float, float]], side: float, limit: float = 4.0) -> DataFrame:
    """Best possible recall, anchors past the threshold per label, mean of all and of best ratios."""
    w, h = F.col("w") * side, F.col("h") * side
    fit = F.array(*[F.least(F.least(w / a, F.lit(a) / w), F.least(h / b, F.lit(b) / h)) for a, b in anchors])
    per = labels.filter("w > 0 AND h > 0").select(fit.alias("x"))
    best = F.array_max("x")
    good = F.size(F.filter("x", lambda v: v > 1 / limit))
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / len(anchors)
    return per.agg(F.avg((best > 1 / limit).cast("double")).alias("recall"), F.avg(good).alias("past"), F.avg(best).alias("best"), F.avg(mean).alias("mean"))


def remap_categories(labels: DataFrame, mapping: dict[int, int]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return labels.withColumn("cls", F.coalesce(F.try_element_at(table, F.col("cls")), F.col("cls")))


def mix_sources(sources: list[DataFrame], ratios: list[float], key: str, seed: int = 0) -> DataFrame:
    """The union of sources, of each the share of its ratio, chosen by hash."""
    out = None
    for i, (df, ratio) in enumerate(zip(sources, ratios, strict=True)):
        part = df.filter(uniform(key, seed + i) < ratio).withColumn("source_no", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def tag_map(labels: DataFrame, place: str = "place") -> DataFrame:
    """Tag ids: O is 0, then B- and I- of each label but other and ignore, in order of place."""
    names = labels.filter(~F.lower("label").isin("other", "ignore", "others"))
    k = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(place)) - 1  # a list of labels, not of rows
    pairs = names.withColumn("k", k).select(F.explode(F.array(F.struct((F.col("k") * 2 + 1).alias("id"), F.concat(F.lit("B-"), F.upper("label")).alias("tag")), F.struct((F.col("k") * 2 + 2).alias("id"), F.concat(F.lit("I-"), F.upper("label")).alias("tag")))).alias("t"))
    spark: SparkSession = labels.sparkSession
    return spark.createDataFrame([(0, "O")], "id int, tag string").unionByName(pairs.select("t.id", "t.tag"))


def choose_variant(items: DataFrame, paths: str, key: str, seed: int = 0) -> DataFrame:
    """One path of each array of variants, chosen by hash of the key."""
    n = F.size(paths)
    return items.withColumn("path", F.when(n > 0, F.get(F.col(paths), F.floor(uniform(key, seed) * n).cast("int"))))


def review_table(labels: DataFrame, names: dict[int, str], width: float, height: float) -> DataFrame:
    """Per image the classes that occur by id, and its boxes in pixels in order of line."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    px = lambda c, s, sign, side: F.round((F.col(c) + F.col(s) * sign / 2) * side).cast("int")
    box = F.struct("line_no", "cls", px("xc", "w", -1, width).alias("x1"), px("yc", "h", -1, height).alias("y1"), px("xc", "w", 1, width).alias("x2"), px("yc", "h", 1, height).alias("y2"))
    kinds = F.array_sort(F.collect_set(F.struct("cls", F.try_element_at(table, F.col("cls")).alias("name"))))
    return labels.groupBy("image_path").agg(F.map_from_entries(kinds).alias("classes"), F.array_sort(F.collect_list(box)).alias("boxes"))
