"""Worked cases and plain versions: assembly, generated codes, quads, scores, timelines, batches."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from portico.operators import assemble, boxes, datasets, dimensions, evaluate, passes, quads, recognise, telemetry

from .test_codes import digit, valid

TOKEN = "k long, seq long, text string, distance double, score double, y double"


def tokens(spark, *frames):
    rows = [(k, i, t, float(d), float(s), float(y)) for k, frame in enumerate(frames) for i, (t, d, s, y) in enumerate(frame)]
    return spark.createDataFrame(rows, TOKEN)


def assembled(spark, frames, vertical=False):
    out = assemble.assemble_tokens(tokens(spark, *frames), "k", dimensions.size_codes(), vertical).orderBy("k").collect()
    return [r["text"] for r in out]


def test_assembly_branches(spark):
    t = lambda text, d=1, s=0.5, y=0: (text, d, s, y)
    frames = [
        [t("EISU2007551", s=0.9), t("EISU2007555", s=0.1), t("22G1")],  # a valid code before a more confident one
        [t("EISU", 5), t("ABCU", 2), t("2007555"), t("45G")],  # the nearest head; the longest part of a size-type
        [t("EISU"), t("555", y=9), t("200", y=1), t("7", y=5), t("123", y=20)],  # 4 + 3 + 1 + 3 from top to bottom, seven digits at most
        [t("XEISU200755599"), t("45G1")],  # eleven characters out of a longer text
        [t("EISU200755")],
        [t("QEISU"), t("1200755512")],  # slides: 1200755, 2007555, 0075551; the second is valid
        [t("EIS2U", 3)],
        [t("EISU"), t("20075")],
        [t("SU"), t("2007555")],
        [t("SU"), t("200")],
        [t("")],
    ]
    assert assembled(spark, frames) == ["EISU2007555 22G1", "ABCU2007555 45G", "EISU2007555", "EISU2007555 45G1", "EISU200755", "EISU2007555", "EIS2U", "EISU20075", "SU2007555", "SU200", ""]
    assert assembled(spark, [[t("EISU"), t("20075551")], [t("EISU"), t("555"), t("200")]], vertical=True) == ["EISU20075551", ""]


def plain_codes(frame):
    """All ordered selections by permutations: the candidates of the docstring in words."""
    heads = [t for t in frame if len(t) >= 4 and t[:3].isalpha() and t[3] == "U" and (t[4:].isdigit() or not t[4:])]
    bodies = [t for t in frame if t.isdigit() and 2 <= len(t) <= 7]
    made = []
    for limit in (11, 9):
        for h in heads:
            found = []
            for n in range(4):
                for p in itertools.permutations(range(len(bodies)), n):
                    s = h + "".join(bodies[i] for i in p)
                    if len(s) <= limit and not any(i not in p and len(s) + len(b) <= limit for i, b in enumerate(bodies)):
                        found.append((p, s))
            made += [s for _, s in sorted(found)]
    for e in (t for t in frame if len(t) == 1 and t.isdigit()):
        made = [m + e if len(m) < 11 else m for m in made]
    return made


def test_generated_codes_like_permutations(spark):
    rng = random.Random(5)
    frames = []
    for _ in range(60):
        base = rng.choice(["EISU", "ABCU"]) + f"{rng.randrange(10**6):06d}"
        code = base + digit(base)
        cuts = sorted(rng.sample(range(6, 10), rng.randint(0, 2)))
        parts = [code[:4], *[code[a:b] for a, b in zip([4, *cuts], [*cuts, 11], strict=True)]]
        extra = [rng.choice(["12", "7", "ABCU", "22G1", "9876", "XX"]) for _ in range(rng.randint(0, 2))]
        frame = parts + extra
        rng.shuffle(frame)
        frames.append(frame)
    frames.append([code, "EISU", code[:10]])
    df = tokens(spark, *[[(t, 0, 0.5, 0) for t in f] for f in frames])
    got = {r["k"]: r["code"] for r in assemble.generate_codes(df, "k").collect()}
    assert got[60] == code
    for k, frame in enumerate(frames[:60]):
        good = [m for m in plain_codes(frame) if valid(m)]
        if good:
            assert got[k] == good[0]
        elif not any(valid(t) for t in frame):
            every = [t for t in frame if len(t) in (9, 10) and t[3] == "U"] or [*frame, *plain_codes(frame)]
            assert len(got[k]) <= max(map(len, every))


def test_confusions_and_masks(spark):
    owners = spark.createDataFrame([("EISU",), ("GICU",)], "owner string")
    codes = ["EISU2007555", "ETSU2007555", "EISU2007565", "QQQQ", "EIHU2007555"]
    got = {r["code"]: r["fixed"] for r in assemble.try_confusions(spark.createDataFrame([(c,) for c in codes], "code string"), owners).collect()}
    assert got == {"EISU2007555": "EISU2007555", "ETSU2007555": "EISU2007555", "EISU2007565": "EISU2007555", "QQQQ": "QQQQ", "EIHU2007555": "EIHU2007555"}
    steps = np.zeros((4, 72))
    steps[0, [5, 37, 39]] = 0.9, 0.6, 0.5  # no province leads; two that are close change places
    steps[1, [30, 18]] = 0.8, 0.3  # no letter of the province leads
    steps[2, 3], steps[3, 60] = 0.4, 0.7
    r = assemble.plate_mask_decode(spark.createDataFrame([(steps.tolist(),)], "probs array<array<double>>")).first()
    assert (r["idx"], [round(x, 3) for x in r["prob"]]) == ([39, 18, 3, 60], [0.6, 0.3, 0.4, 0.7])


def test_quad_areas():
    square, diamond = [0, 0, 2, 0, 2, 2, 0, 2], [1, -1, 3, 1, 1, 3, -1, 1]
    dent, far = [0, 0, 4, 0, 1, 1, 0, 4], [9, 9, 10, 9, 10, 10, 9, 10]
    a, b = quads.hulls(np.array([square, square, square, dent, square], float)), quads.hulls(np.array([diamond, square, far, square, [2, 0, 4, 0, 4, 2, 2, 2]], float))
    assert np.allclose(quads.area(a), [4, 4, 4, 8, 4])  # the dent's hull is a triangle
    assert np.allclose(quads.common_area(a, b), [4, 4, 0, 4, 0])
    rng = np.random.default_rng(1)
    x, y = (quads.hulls(rng.random((40, 8)) * 10) for _ in range(2))
    points = rng.random((200_000, 2)) * 10

    def inside(ring):
        after = np.roll(ring, -1, axis=0)
        return ((after[:, 0] - ring[:, 0]) * (points[:, None, 1] - ring[:, 1]) - (after[:, 1] - ring[:, 1]) * (points[:, None, 0] - ring[:, 0]) >= 0).all(axis=1)

    share = [100 * (inside(p) & inside(q)).mean() for p, q in zip(x, y, strict=True)]
    assert np.abs(quads.common_area(x, y) - share).max() < 0.5


def rect(x, y, w=10, h=10):
    return [float(v) for v in (x, y, x + w, y, x + w, y + h, x, y + h)]


GT, DT = "image_id long, gt_id long, quad array<double>, ignore boolean, text string", "image_id long, det_id long, quad array<double>, text string"


def test_end_to_end_score(spark):
    truth = spark.createDataFrame([(1, 0, rect(0, 0), False, "ＡBC"), (1, 1, rect(50, 0), True, "zz"), (1, 2, rect(90, 0), False, "lost"), (2, 0, rect(0, 0), False, "x")], GT)
    found = spark.createDataFrame([(1, 0, rect(1, 0), "ABC"), (1, 1, rect(50, 0), "any"), (1, 2, rect(0, 80), "no"), (2, 0, rect(0, 0), "y"), (3, 0, rect(0, 0), "other image")], DT)
    r = evaluate.end_to_end_score(evaluate.matched_fields(truth, found), truth.select("image_id")).first()
    # fields: ABC hit; lost unmatched (4); no unmatched (2); x against y (1)
    assert (r["hits"], r["truths"], r["founds"]) == (1, 3, 3)
    assert [round(r[c], 4) for c in ("precision", "recall", "char_accuracy", "edit_per_field", "edit_per_image")] == [0.3333, 0.3333, round(1 - 7 / 8, 4), round(7 / 3, 4), 3.5]
    none = evaluate.end_to_end_score(evaluate.matched_fields(truth.limit(0), found), truth.limit(0).select("image_id")).first()
    assert (none["hits"], none["edit_per_image"]) == (0, None)


def test_area_match_cases(spark):
    truth = [(1, 0, rect(0, 0), False, "One"), (2, 0, rect(0, 0, 20), False, "split"), (3, 0, rect(0, 0), False, "a"), (3, 1, rect(10, 0), False, "b"), (4, 0, rect(0, 0), True, "###"), (4, 1, rect(100, 0), False, "miss")]
    found = [(1, 0, rect(0, 0), "oNE"), (2, 0, rect(0, 0), "split"), (2, 1, rect(10, 0), "x"), (3, 0, rect(0, 0, 20), "a"), (4, 0, rect(0, 0), "gone")]
    r = evaluate.area_match_score(spark.createDataFrame(truth, GT), spark.createDataFrame(found, DT)).first()
    # image 1: one to one; 2: one truth in two parts (0.8 and 1.6); 3: two truths in one (1.6 and 0.8); 4: the found quad lies on an ignored one
    assert (r["truths"], r["founds"], r["hits"], round(r["recall_credit"], 6)) == (5, 4, 3, 3.4)
    assert (round(r["recall"], 6), round(r["precision"], 6), round(r["sequence_error"], 6)) == (0.68, 0.85, round(1 - 3 / 3.4, 6))
    assert evaluate.area_match_score(spark.createDataFrame([], GT), spark.createDataFrame([], DT)).first()["f_score"] == 0


def test_class_boxes_and_agnostic_suppression(spark):
    raw = spark.createDataFrame([(0, 1, 0.9, [0.5, 0.9, 0.1]), (0, 2, 0.2, [0.9, 0.9, 0.9])], "image_id long, det_id long, obj double, scores array<double>")
    rows = lambda df: sorted((r["det_id"], r["cls"], round(r["conf"], 4)) for r in df.collect())
    assert rows(boxes.class_boxes(raw)) == [(1, 1, 0.81)] and rows(boxes.class_boxes(raw, multi=True)) == [(1, 0, 0.45), (1, 1, 0.81)]
    assert rows(boxes.class_boxes(raw, multi=True, classes=[0])) == [(1, 0, 0.45)]
    df = spark.createDataFrame([(0, i, i % 2, 0.9 - i / 10, 0.0, 0.0, 10.0, 10.0) for i in range(4)], "image_id long, det_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double")
    assert [boxes.nms(df, agnostic=a).count() for a in (False, True)] == [2, 1] and boxes.nms(df, classes=[1]).first()["det_id"] == 1
    points = spark.createDataFrame([([(320.0, 320.0), None, (700.0, 0.0)],)], "points array<struct<x:double,y:double>>")
    assert [p and tuple(p) for p in boxes.unletterbox_points(points, 1280, 960).first()["points"]] == [(640.0, 480.0), None, (1280.0, 0.0)]


def test_best_f1_of_a_perfect_ranking(spark):
    flags = spark.createDataFrame([(0, 0.9 - i / 100, i, int(i < 5)) for i in range(10)], "cls int, conf double, seq long, tp int")
    r = evaluate.best_f1(flags, spark.createDataFrame([(0, 5)], "cls int, n long")).first()
    conf = np.array([0.9 - i / 100 for i in range(10)])
    tps = np.minimum(np.arange(1, 11), 5)
    grid = np.linspace(0, 1, 1000)
    rec, pre = np.interp(-grid, -conf, tps / 5, left=0), np.interp(-grid, -conf, tps / np.arange(1, 11), left=1)
    f1 = 2 * rec * pre / (rec + pre + 1e-16)
    smooth = np.convolve(np.concatenate([np.full(50, f1[0]), f1, np.full(50, f1[-1])]), np.ones(101) / 101, mode="valid")
    assert r["cell"] == smooth.round(12).argmax() and abs(r["f1"] - f1[r["cell"]]) < 1e-9 and abs(r["recall"] - rec[r["cell"]]) < 1e-9


OBS = "direction string, ts timestamp, frame_no long, state string"


def observed(spark, **streams):
    rows = [(d, i, i, s) for d, states in streams.items() for i, s in enumerate(states)]
    name = {"e": "empty", "p": "present", "s": "skipped"}
    return spark.createDataFrame([(d, i, n, name[s]) for d, i, n, s in rows], "direction string, t long, frame_no long, state string").select("direction", F.timestamp_seconds("t").alias("ts"), "frame_no", "state")


def test_side_boundaries(spark):
    obs = observed(spark, a="e" * 5 + "p" * 10 + "e" * 4 + "p" * 3 + "e" * 3, b="e" * 6, c="p" * 12 + "e" * 3, d="eep")
    got = {}
    for r in passes.boundaries_side(obs).orderBy("direction", "n").collect():
        got.setdefault(r["direction"], []).append(r["t"])
    # a: the first idle second is 2; what follows the tenth present frame is one stretch that ends at 24
    assert got == {"a": [2.0, 24.0], "b": [0.0, 5.0], "c": [14.0]}


def test_suppression_like_a_fold(spark):
    rng = random.Random(4)
    times = {k: sorted(round(rng.random() * 4000, 1) for _ in range(120)) for k in "ab"}
    got = {}
    for r in passes.suppress_adjacent(spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "k string, t double"), "k").orderBy("k", "n").collect():
        got.setdefault(r["k"], []).append((r["n"], r["t"]))
    for k, ts in times.items():
        kept = []
        for t in ts:
            if not kept or t - kept[-1] > 50:
                kept.append(t)
        assert got[k] == list(enumerate(kept))


def test_panoramas(spark):
    rows = [(1, 0.0, 0.0, dx, 0.0) for dx in (-5.0, -4.0, -6.0, -50.0, 3.0)] + [(2, 0.0, 0.0, 0.0, 0.0)]
    m = spark.createDataFrame([(p, x1, y1, x1 + dx, y1 + dy) for p, x1, y1, dx, dy in rows], "pair long, x1 double, y1 double, x2 double, y2 double")
    assert {r["pair"]: r["offset"] for r in passes.pair_offsets(m, "left", ["pair"]).collect()} == {1: 6, 2: 0}  # the middle of -50, -6, -5, -4 is -5.5
    o = spark.createDataFrame([(7, i, v) for i, v in enumerate([5, 10, 0, 1, 20])], "p long, i long, offset long")
    assert [(r["used"], r["x"], r["total"]) for r in passes.stitch_plan(o, "p", "i", 100).orderBy("i").collect()] == [(10, 10, 148), (9, 19, 148), (9, 28, 148), (20, 48, 148)]


def test_two_heads_in_a_row(spark):
    frames = spark.createDataFrame([(1, [("XYZU", 0.1), ("EISU", 0.2), ("2007555", 0.3), ("22G1", 0.4)]), (2, [("2007555", 0.1), ("EISU", 0.2)])], "frame_id long, tokens array<struct<text:string,score:double>>")
    got = {r["frame_id"]: [t["text"] for t in r["tokens"]] for r in recognise.stitch_tokens(frames).collect()}
    assert got == {1: ["EISU2007555", "22G1"], 2: ["EISU2007555"]}


def test_gated_frames(spark):
    frames = spark.createDataFrame([(1, [("EISU2007555", 0.5), ("EISU2007551", 0.45), ("EISU2", 0.9), ("ABCU2007555", 0.3), ("22G1", 0.9), ("45G1", 0.7)])], "frame_id long, tokens array<struct<text:string,score:double>>")
    r = recognise.gate_readings(frames).first()
    assert (r["codes"], r["sizes"]) == (["EISU2007555", "EISU2007551"], ["22G1"])
    assert tuple(recognise.frame_result(recognise.gate_readings(frames)).first()) == (1, "EISU2007555", "22G1")


def test_two_containers(spark):
    rows = [(1, i, t) for i, t in enumerate(["EISU2007555", "ABCD9999999", "EISU2007551", "ABCD9999998", "ABCD9999999"])]
    got = {(r["pass_id"], r["container"]): r["voted"] for r in recognise.split_two(spark.createDataFrame(rows, "pass_id long, seq long, text string")).collect()}
    assert got == {(1, 1): "EISU2007555", (1, 2): "ABCD9999999"}


def test_batches_of_one_hot_ratio(spark):
    images = spark.range(3000).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("image_path"), F.when(F.col("id") % 10 == 0, 640 + F.col("id") % 7).otherwise(640).alias("width"), F.lit(480).alias("height"))
    got = datasets.rect_batches(images, 64).orderBy("batch").collect()
    assert [r["images"] for r in got] == [64] * 46 + [56] and datasets.rect_batches(images.limit(0), 64).count() == 0
    plan = datasets.scale_plan([(320, 32), (256, 48)], 10, fixed=False)
    assert plan == [(320, 32, 10), (256, 48, 8)]
    out = datasets.multi_scale_batches(images.limit(50), plan).orderBy("batch").collect()
    assert [(r["width"], r["samples"]) for r in out] == [(320, 10), (256, 8), (320, 10), (256, 8), (320, 10), (256, 8)]  # 50 samples and the first four again


def test_batch_size_falls_back(spark):
    rows = [("a", float(b), 1.0 + b) for b in (1, 2, 4)] + [("a", 8.0, None)] + [("b", float(b), 1.0 + b / 100) for b in (1, 2)] + [("c", 1.0, 2.0), ("c", 2.0, 3.0)]
    got = {r["gpu"]: r["batch"] for r in telemetry.fit_batch_size(spark.createDataFrame(rows, "gpu string, batch double, memory double"), 20.0).collect()}
    assert got == {"a": 4, "b": 16, "c": 15}  # beyond the failed 8; beyond 1024; by the line


@pytest.mark.parametrize("line, kind", [("panorama 36", "panorama"), ("outage", "outage"), ("archive V1", "archive"), ("Read Error", "error"), ("x", "other")])
def test_log_kinds(spark, line, kind):
    assert spark.createDataFrame([(line,)], "m string").select(telemetry.log_kind("m")).first()[0] == kind
