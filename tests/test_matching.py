"""Greedy matching against a sorted loop, where rounds are many or boxes are tied."""

import random

import pytest

from portico.operators import evaluate

PAIRS = "image_id long, gt_id long, gt_cls int, det_id long, det_cls int, conf double, iou double"


def pairs_of(spark, rows):
    return spark.createDataFrame([(i, g, 0, d, 0, 0.5, u) for i, g, d, u in rows], PAIRS)


def plain(rows):
    used, out = set(), set()
    for i, g, d, _ in sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if not used & {(i, "g", g), (i, "d", d)}:
            used |= {(i, "g", g), (i, "d", d)}
            out.add((i, g, d))
    return out


def matched(df):
    return {(r["image_id"], r["gt_id"], r["det_id"]) for r in df.collect()}


def test_copies_and_ties_match_like_a_sorted_loop(spark):
    rng = random.Random(9)
    rows = [(1, g, 500 + d, 0.9) for g in range(70) for d in range(80)]
    for image in range(2, 60):
        rows += [(image, g, d, rng.choice([0.5, 0.6, 0.7])) for g in range(6) for d in range(6) if rng.random() < 0.6]
    got = matched(evaluate.greedy_match(pairs_of(spark, rows)))
    assert got == plain(rows) and len([x for x in got if x[0] == 1]) == 70


def test_copies_take_one_round_and_a_bound_fails(spark):
    copies = [(1, g, d, 0.9) for g in range(9) for d in range(9)]
    assert matched(evaluate.greedy_match(pairs_of(spark, copies), 1)) == plain(copies)
    chain = [(1, k // 2, (k + 1) // 2, 0.9 - k / 100) for k in range(9)]
    with pytest.raises(RuntimeError, match="left after 2 rounds"):
        evaluate.greedy_match(pairs_of(spark, chain), 2)
    assert matched(evaluate.greedy_match(pairs_of(spark, chain))) == plain(chain)
