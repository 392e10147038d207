"""Licence windows against an enumeration of all of them."""

import random

import pytest

from portico.llm import licences as L

from .test_operators import docs


def plain_windows(text, templates, threshold=85):
    """Names found by windows: the best one of each beginning, none that another with more in common overlaps."""
    words = L._words(text)
    grams, out = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)], []
    for i, (_, body) in enumerate(templates):
        own = set(L._bigrams(body))
        if len(own & set(grams)) < L.bounds(len(own), threshold)[0]:
            continue
        for p in range(len(grams)):
            if grams[p] not in own:
                continue
            seen, both, best = set(), 0, (0, 0, 0)
            for q in range(p, len(grams)):
                if grams[q] not in seen:
                    seen.add(grams[q])
                    both += grams[q] in own
                if len(seen) > L.bounds(len(own), threshold)[1]:
                    break
                if grams[q] in own:
                    best = max(best, (2000 * both // (len(seen) + len(own)), q + 1, both))
            if best[0] >= 10 * threshold:
                out.append((best[2], best[0], p, best[1], i))
    kept = [x for x in out if not any(y[2] < x[3] and x[2] < y[3] and y[:2] > x[:2] for y in out)]
    return {templates[x[4]][0] for x in kept}, max((x[1] for x in kept), default=0)


def edited(rng, words, share, kind):
    out = list(words)
    for _ in range(int(len(words) * share)):
        at = rng.randrange(len(out))
        if kind == "insert":
            out.insert(at, f"extra{rng.randrange(50)}")
        elif kind == "drop":
            del out[at]
        else:
            out[at] = f"other{rng.randrange(50)}"
    return out


def test_edited_and_wrapped_copies_like_an_enumeration(spark):
    rng = random.Random(7)
    listed = [*L.TEMPLATES, *L.TEXTS]
    short = [(n, b) for n, b in listed if len(b) < 1500]
    other = [f"w{i}" for i in range(300)] + ["the", "software", "of", "license"]
    rows, cases = [], []
    for k in range(70):
        name, body = short[k % len(short)] if k < 30 else next(x for x in short if x[0] == "MIT" and len(x[1]) > 500)
        words = edited(rng, body.split(), rng.random() * 0.16, rng.choice(["insert", "drop", "replace"]))
        around = rng.choices(other, k=rng.randrange(0, 120))
        at = rng.randrange(len(around) + 1)
        text = " ".join([*around[:at], *words, *around[at:]]).split(" ")
        lines = [f"# {' '.join(text[i : i + 9])}" for i in range(0, len(text), 9)]
        rows.append((k, "\n".join(lines), "s"))
        cases.append(name)
    rows += [(100, "all rights reserved " * 200, "s"), (101, None, "s"), (102, "the software " * 3000 + L.TEXTS[0][1], "s")]
    df = docs(spark, rows, extra=True)
    got = {r["doc_id"]: (set(r["licenses"].split(",")) - {""}, r["best_permille"]) for r in L.scan(df).collect()}
    found = 0
    for k, text, _ in rows:
        names, best = plain_windows(text or "", listed)
        assert names <= got[k][0], (k, names, got[k])
        assert not names or got[k][1] >= 850 <= best
        found += k < 70 and cases[k] in names
    assert 30 < found < 70  # the edits reach over the threshold


def test_windows_only_when_needed_words_are_there():
    listed = [*L.TEMPLATES, *L.TEXTS]
    words = set(L.needed_words(listed))
    for _, body in listed:
        own = L._bigrams(body)
        assert len([g for g in own if not set(g.split(" ")) & words]) < L.bounds(len(own))[0]


@pytest.mark.parametrize("threshold", [70, 95])
def test_other_thresholds(spark, threshold):
    rng = random.Random(threshold)
    body = L.TEXTS[0][1]
    rows = [(k, " ".join(["x"] * 30 + edited(rng, body.split(), k / 60, "insert") + ["y"] * 30), "s") for k in range(12)]
    got = {r["doc_id"]: r["licenses"] for r in L.scan(docs(spark, rows), templates=[("ISC", body)], threshold=threshold).collect()}
    for k, text, _ in rows:
        assert ("ISC" in got[k]) == ("ISC" in plain_windows(text, [("ISC", body)], threshold)[0]), k
