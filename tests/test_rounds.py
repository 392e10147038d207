"""Rounds over joins against plain loops: two containers, area match."""

import random
from collections import Counter

import numpy as np

from portico.operators import evaluate, recognise

from .test_records import DT, GT, rect


def plain_split(rows, limit=0.6):
    """rows: (seq, text) of one pass; the text's vote of either container is not looked at, only who joins."""
    members, side = [], []
    for _, t in sorted(rows):
        same = not members or any(sum(a == b for a, b in zip(t, m, strict=False)) >= limit * min(len(t), len(m)) for m in members)
        members += [t] if same and t not in members else []
        side.append(1 if same else 2)
    return side


def split_rows(spark, passes, limit=0.6):
    rows = [(p, q, t) for p, own in passes.items() for q, t in own]
    df = spark.createDataFrame(rows, "pass_id long, seq long, text string")
    joined = {(r["pass_id"], r["text"]): tuple(r["joined"]) for r in recognise.first_container(df, "pass_id", "text", "seq", limit).collect()}
    return {p: [1 if (p, t) in joined and (q, t) >= joined[p, t] else 2 for q, t in sorted(own)] for p, own in passes.items()}


def test_first_container_like_the_loop(spark):
    rng = random.Random(3)
    passes = {}
    for p in range(60):
        stems = ["".join(rng.choice("AB12") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 4))]
        own = []
        for q in range(rng.randint(1, 25)):
            t = list(rng.choice(stems))
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice("AB12")
            own.append((q // 2, "".join(t[: rng.choice([len(t), len(t), 3])])))  # ties, repeats, other lengths
        passes[p] = own
    assert split_rows(spark, passes) == {p: plain_split(own) for p, own in passes.items()}
    assert split_rows(spark, {1: passes[1]}, 0.9) == {1: plain_split(passes[1], 0.9)}


def test_a_hot_pass_is_split(spark):
    rng, codes = random.Random(1), ("EISU2007555", "TGHU9031448")
    own = []
    for q in range(20000):
        t = list(codes[q % 7 == 3])
        for _ in range(rng.choice([0, 0, 1, 2])):
            t[rng.randrange(11)] = rng.choice("0123456789ABCU")
        own.append((q, "".join(t)))
    want = plain_split(own)
    assert split_rows(spark, {5: own}) == {5: want} and len(Counter(want)) == 2


def plain_credits(sigma, tau, same, tr=0.7, tp=0.6, k=2, part=0.8):
    """Credits of one image by the three steps in order; rows are truths, columns found quads, shares in hundredths."""
    n, m = sigma.shape
    gt, det, out = set(range(n)), set(range(m)), [0.0, 0.0, 0]

    def add(recall, precision, hit):
        out[0], out[1], out[2] = out[0] + recall, out[1] + precision, out[2] + bool(hit)

    strong, tight = sigma > tr, tau > tp
    for g in range(n):
        if strong[g].sum() == 1 and tight[g].sum() == 1:
            s, t = strong[g].argmax(), tight[g].argmax()
            if strong[:, s].sum() == 1 and tight[:, t].sum() == 1:
                add(1, 1, same[g, s])
                gt.discard(g), det.discard(int(s))
    for own, shares, others, first in ((gt, (tau, sigma), det, True), (det, (sigma.T, tau.T), gt, False)):
        for i in sorted(own):
            inside, whole = shares[0][i], shares[1][i]
            parts = [j for j in sorted(others) if inside[j] >= tp]
            if (whole > 0).sum() < k or not parts:
                continue
            alone = len(parts) == 1
            limit = tr if first else tp
            good = (whole[parts[0]] >= limit and (first or inside[parts[0]] >= tr)) if alone else round(sum(whole[j] for j in parts), 6) >= limit
            if good:
                a, b = (1, 1) if alone else (part, part * len(parts))
                add(*((a, b) if first else (b, a)), same[i, parts[0]] if first else same[parts[0], i])
                own.discard(i)
                others -= set(parts)
    return out


def test_area_match_like_the_loop(spark):
    rng, truth, found = random.Random(9), [], []
    for image in range(40):
        for i in range(rng.randint(1, 7)):
            truth.append((image, i, rect(rng.randint(0, 6) * 5, rng.randint(0, 1) * 5, rng.choice([10, 20, 30])), rng.random() < 0.1, rng.choice("ab")))
        for i in range(rng.randint(1, 7)):
            found.append((image, i, rect(rng.randint(0, 6) * 5, rng.randint(0, 1) * 5, rng.choice([5, 10, 20])), rng.choice("ab")))
    a, b = spark.createDataFrame(truth, GT), spark.createDataFrame(found, DT)
    good, left, pairs = evaluate.overlap_tables(a, b)
    text = {("g", r["image_id"], r["gt_id"]): r["text"] for r in good.collect()} | {("d", r["image_id"], r["det_id"]): r["text"] for r in left.collect()}
    by, want = {}, [0.0, 0.0, 0]
    for r in pairs.collect():
        by.setdefault(r["image_id"], []).append(r)
    for image, rows in by.items():
        gts, dets = sorted({r["gt_id"] for r in rows}), sorted({r["det_id"] for r in rows})
        sigma, tau, same = (np.zeros((len(gts), len(dets))) for _ in range(3))
        for r in rows:
            at = gts.index(r["gt_id"]), dets.index(r["det_id"])
            sigma[at], tau[at], same[at] = r["sigma"], r["tau"], text["g", image, r["gt_id"]] == text["d", image, r["det_id"]]
        want = [x + y for x, y in zip(want, plain_credits(sigma, tau, same), strict=True)]
    got = evaluate.area_match_score(a, b).first()
    assert (round(got["recall_credit"], 6), round(got["precision"] * got["founds"], 6), got["hits"]) == (round(want[0], 6), round(want[1], 6), want[2])
    assert want[0] > 10
