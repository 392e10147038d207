"""Orders cut in ranges, doubling, evolution of anchors, incremental verification, replicas: against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from portico.operators import datasets as D
from portico.operators import passes, scans

IMAGE = "image_path string, width int, height int, labelled boolean"
LABEL = "image_path string, cls int, xc double, yc double, w double, h double, line_no long"


def plain_kept(ts, least):
    kept = []
    for t in ts:
        if not kept or t - kept[-1] > least:
            kept.append(t)
    return kept


@pytest.mark.parametrize("step", [0.1, 7.3])
def test_doubling_like_a_fold(spark, step):
    rng = random.Random(8)
    times = {"a": sorted({round(rng.random() * 900 * step, 2) for _ in range(900)}), "b": [round(i * step * 10, 2) for i in range(300)], "c": [5.0], "d": [0.1, 50.1, 50.2, 100.1, 100.2, 150.30000000000001]}
    rows = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "k string, t double")
    got = {}
    for r in passes.suppress_adjacent(rows, "k", least=50.0, fold=3).orderBy("k", "n").collect():
        got.setdefault(r["k"], []).append((r["n"], r["t"]))
    assert got == {k: list(enumerate(plain_kept(ts, 50.0))) for k, ts in times.items()}


def test_ranges_hold_about_as_many_rows(spark):
    df = spark.range(4000).select(F.lit(1.0).alias("v"), F.xxhash64("id").alias("u"), "id")  # one value fills everything
    got = scans.ranged(df, ["v", "u", "id"], "c", rows=500)
    sizes = [r["count"] for r in got.groupBy("c").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 1200
    ends = got.groupBy("c").agg(F.min("u").alias("low"), F.max("u").alias("high")).orderBy("c").collect()
    assert all(a["high"] < b["low"] for a, b in zip(ends, ends[1:], strict=False))
    k = D._ordered(df.select(F.col("id").cast("string").alias("image_path"), "v"), "v")
    assert sorted(r["k"] for r in k.collect()) == list(range(1, 4001)) and scans.ranged(df.limit(0), ["v"], "c").count() == 0


def test_draws_follow_the_weights(spark):
    w = spark.createDataFrame([(f"k{i}", float(i)) for i in range(20)], "k string, weight double")
    got = D.weighted_sample(w, "k", 5000, seed=3).collect()
    assert sorted(r["draw"] for r in got) == list(range(5000))
    share = {}
    for r in got:
        share[r["k"]] = share.get(r["k"], 0) + 1
    assert "k0" not in share and all(abs(share.get(f"k{i}", 0) - 5000 * i / 190) < 90 for i in range(20))


def test_tables_of_rounds_are_replaced(spark):
    import os

    rounds = scans.Rounds(spark)
    path = lambda: [p for p in os.listdir(rounds.base.removeprefix("file:"))]
    (a,) = rounds.put(a=spark.range(3))
    (a,) = rounds.put(a=a.withColumn("id", F.col("id") + 1))
    assert [r["id"] for r in a.orderBy("id").collect()] == [1, 2, 3] and path() == ["a-2"]
    rounds.drop("a")
    assert path() == []


def test_anchors_either_side_counts_and_fitness_never_falls(spark):
    rng = np.random.default_rng(6)
    wh = np.abs(rng.normal(0.2, 0.1, (400, 2))) + 0.001
    wh[:40, 0] = 0.0005  # narrow, but high enough to count
    wh[40:50] = 0.0004
    labels = spark.createDataFrame([(f"i{k}", 0, 0.5, 0.5, float(w), float(h), k) for k, (w, h) in enumerate(wh)], LABEL)
    px = wh * 640
    px = px[(px >= 2).any(axis=1)]
    assert D.anchor_sizes(labels, 640.0).count() == len(px) == 390

    def plain(anchors):
        r = px[:, None] / np.array(anchors)[None]
        best = np.minimum(r, 1 / r).min(2).max(1)
        return (best * (best > 0.25)).mean()

    start = D.kmeans_anchors(labels, 640.0, 3)
    own = [(r["w"], r["h"]) for r in start.collect()]
    sizes = D.anchor_sizes(labels, 640.0).withColumn("n", F.lit(1))
    other = [(a * 1.3, b * 0.8) for a, b in own]
    assert np.allclose(D.anchor_scores(sizes, [own, other]), [plain(own), plain(other)], atol=1e-12)
    runs = [D.evolve_anchors(labels, start, 640.0, generations=4, mutants=6, seed=2) for _ in range(2)]
    (a, fit), (b, again) = runs
    assert a.collect() == b.collect() and fit == again and fit == sorted(fit) and fit[-1] > fit[0] and len(fit) == 5
    assert abs(plain([(r["w"], r["h"]) for r in a.collect()]) - fit[-1]) < 1e-12
    few = D.kmeans_anchors(labels.limit(1), 640.0, 3, seed=1)
    assert few.count() == 3 and few.collect() == D.kmeans_anchors(labels.limit(1), 640.0, 3, seed=1).collect()


def test_landmark_rules(spark):
    good = [1.0, 0.5, 0.5, 0.2, 0.1, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, -1.0, -1.0]
    lines = {"good": [good, [7.0, *good[1:]]], "double": [good, good], "short": [good[:12]], "long": [[*good, 0.1]], "low": [[*good[:12], -1.01]], "high": [[*good[:5], 1.1, *good[6:]]], "text": [None], "hole": [[*good[:3], None, *good[4:]]], "nan": [[*good[:3], float("nan"), *good[4:]]], "small": [good]}
    images = spark.createDataFrame([(k, 5 if k == "small" else 50, 50, True) for k in [*lines, "empty"]] + [("missing", 50, 50, False)], IMAGE)
    df = spark.createDataFrame([(k, v) for k, ls in lines.items() for v in ls], "image_path string, fields array<double>")
    want = dict.fromkeys(lines, "corrupt") | {"good": "found", "empty": "empty", "missing": "missing"}
    assert {r["image_path"]: r["status"] for r in D.verify_landmarks(images, df).collect()} == want


def test_only_what_changed_is_verified_again(spark):
    rows = [(f"p{i}", 100, 100, i % 4 > 0) for i in range(200)]
    labels = [(f"p{i}", 0, 0.5, 0.5, 0.1, 0.1, i) for i in range(200) if i % 4 > 1]
    make = lambda r, n: (spark.createDataFrame(r, IMAGE), spark.createDataFrame(n, LABEL))
    state = D.verify_changed(*make(rows, labels))
    seen = []

    def verify(images, found):
        seen.append((images.count(), found.count()))
        return D.verify_labels(images, found)

    rows2 = [r for r in rows if r[0] != "p7"] + [("new", 9, 100, True)]
    rows2[3] = ("p3", 5, 100, True)
    labels2 = [(*n[:4], 1.5 if n[0] == "p11" else n[4], *n[5:]) for n in labels]
    rows2 = [(*r[:2], 101, r[3]) if r[0] == "p11" else r for r in rows2]  # its label file is another one
    got, prints = D.verify_changed(*make(rows2, labels2), state, verify=verify)
    want = {tuple(r) for r in D.verify_labels(*make(rows2, labels2)).collect()}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(rows2)
    assert 0 < seen[0][0] < 60 and seen[0][1] < len(labels2)
    D.verify_changed(*make(rows2, labels2), (got, prints), verify=verify)
    assert seen[1] == (0, 0)
    none, _ = D.verify_changed(*make([], []), (got, prints))
    assert none.count() == 0


def plain_replica(paths, plan, replicas, rank):
    own = -(-len(paths) // replicas)
    mine = (paths * replicas)[: own * replicas][rank::replicas]
    out, at = [], 0
    while at < own:
        for w, h, n in plan:
            if at >= own:
                break
            ids = mine[at : at + n]
            while len(ids) < n:
                ids += mine[: n - len(ids)]
            out.append([(w, h, p) for p in ids])
            at += n
    return out


@pytest.mark.parametrize("n,replicas", [(37, 3), (1, 4), (4, 3)])
def test_replicas_see_what_the_plan_says(spark, n, replicas):
    images = spark.createDataFrame([(f"p{i:03d}",) for i in range(n)], "image_path string")
    plan = [(320, 32, 6), (256, 48, 3), (160, 64, 4)]
    for shuffled in (False, True):
        got = D.replica_batches(images, plan, replicas, seed=4, shuffled=shuffled).collect()
        paths = [r["image_path"] for r in images.orderBy(*([D.uniform("image_path", 4)] if shuffled else []), "image_path").collect()]
        for rank in range(replicas):
            own = sorted((r["place"], r["position"], r["width"], r["height"], r["image_path"]) for r in got if r["replica"] == rank)
            want = [(b, i, *x) for b, batch in enumerate(plain_replica(paths, plan, replicas, rank)) for i, x in enumerate(batch)]
            assert own == want
            batches = {r["place"]: r["batch"] for r in got if r["replica"] == rank}
            assert sorted(batches.values()) == sorted(batches) and (shuffled or all(a == b for a, b in batches.items()))
