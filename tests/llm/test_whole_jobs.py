"""Whole jobs: cases in which an operator once did less."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from portico.llm import licences, packing, pieces, quality

from .test_operators import docs
from .test_queries import assert_packed, library_ids


def test_frequent_lines_leave_the_text(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"{own(i)}\n\n  Home\t| News {'' if i % 2 else ' '}\n{own(1000 + i)}", "h") for i in range(30)]
    rows += [(100 + i, f"{own(i + 2000)}\nhome | news", "other") for i in range(5)]
    want = {i: t if i in (0, *range(100, 105)) else f"{own(i)}\n\n{own(1000 + i)}" for i, t, _ in rows}
    assert {r["doc_id"]: r["cleaned"] for r in quality.judge(docs(spark, rows, extra=True)).collect()} == want
    got = corpus_pipeline.quality_rules(spark, docs(spark, rows), "").collect()
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got} == {i: (t, len(t)) for i, t in want.items()}


def test_characters_of_all_planes_like_the_library():
    import sentencepiece

    path = public_tokenizers.path(pieces.MODEL)
    lib, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path)
    texts = [f"a {chr(c)}b {chr(c)} in{chr(c)} {chr(c) * 60}" for c in (0x20106, 0x2A6D6, 0xE0100, 0x10FFFF, *range(0x20000, 0x27D00, 97))]
    assert [x.tolist() for x in pieces.encode_many(texts, [1] * len(texts), model, 0.0)] == [lib.encode(t) for t in texts]
    assert [pieces.decode_ids(x, model) for x in pieces.encode_many(texts, [1] * len(texts), model, 0.1)] == texts


def test_dropout_draws_for_every_occurrence():
    model = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    n = 4000
    got = pieces.encode_many(["international"] * n, list(range(n)), model, 0.1)
    found = {tuple(x.tolist()) for x in got}
    assert len(found) > 40 and {pieces.decode_ids(np.array(x), model) for x in found} == {"international"}
    # Shares are those of a plain loop with draws of its own.
    rng = random.Random(5)

    def plain():
        symbols = [(int(model.of_char[ord(c)]), k, k + 1) for k, c in enumerate(" international")]
        drawn = {}
        while True:
            open_ = []
            for k, ((a, start, middle), (b, _, end)) in enumerate(zip(symbols, symbols[1:], strict=False)):
                hit, at = model.look_up(np.array([a << 32 | b]))
                if hit[0] and not drawn.setdefault((start, middle, end), rng.random() < 0.1):
                    open_.append((int(model.ranks[at[0]]), k, int(model.merged[at[0]])))
            if not open_:
                return tuple(s for s, _, _ in symbols)
            _, k, piece = min(open_)
            symbols[k : k + 2] = [(piece, symbols[k][1], symbols[k + 1][2])]

    mine, theirs = Counter(tuple(x.tolist()) for x in got), Counter(plain() for _ in range(n))
    assert max(abs(mine[x] - theirs[x]) for x in mine | theirs) < 0.04 * n
    same = pieces.encode_many([" ".join(["international"] * n)], [1], model, 0.1)[0]
    assert len({tuple(x) for x in np.split(same, np.flatnonzero([model.data[i].startswith(b" ") for i in same.tolist()])) if len(x)}) > 40


def test_occurrences_like_the_heap():
    rng, model = np.random.default_rng(4), pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    for length in (1, 2, 3, 7, 20, 48):
        words = [" " + "".join(rng.choice(list("etaonihsrd"), length - 1)) for _ in range(20)]
        points = np.array([model.of_char[[ord(c) for c in w]] for w in words])
        state, keys = rng.integers(0, 20, 500), rng.integers(0, 1 << 62, 500).astype(np.uint64)
        for rate in (0.0, 0.1, 0.6):
            flat, sizes, result = pieces.walk(points, np.full(20, length), state, keys, rate, model)
            ends = np.cumsum(sizes)
            for s, k, r in zip(state.tolist(), keys.tolist(), result.tolist(), strict=True):
                assert pieces.agenda(points[s].tolist(), k, rate, model) == flat[ends[r] - sizes[r] : ends[r]].tolist()


def test_packed_ids_like_the_library_as_it_comes(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    tok = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext |> plain", "", "é <|endoftext|>"]
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert 50256 in want[0]
    rows = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = corpus_pipeline.packed(spark, rows, "").collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got} == want
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["doc_tokens"] for r in packing.op2_packed_sequences(spark, str(tmp_path)).collect()} == {i: len(x) for i, x in want.items()}


def test_notices_inside_longer_documents(spark):
    def wrapped(body, mark="", width=9):
        words = body.split()
        return "\n".join(mark + " ".join(words[k : k + width]) for k in range(0, len(words), width))

    of = lambda name, last=-1: [t for n, t in [*licences.TEMPLATES, *licences.TEXTS] if n == name][last]
    own = lambda i: "\n".join(f"int value{i}x{k} = other{k} + {k};" for k in range(150))
    cases = [("MIT", wrapped(of("MIT"), " * ")), ("Apache-2.0", wrapped(of("Apache-2.0", 1), "# ")), ("GPL-3.0", wrapped(of("GPL-3.0", 1), "// ")), ("GPL-2.0", wrapped(of("GPL-2.0", 1)))]
    cases += [(n, wrapped(of(n))) for n in ("ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Apache-2.0", "GPL-3.0", "GPL-2.0")] + [("", "permission to use the software")]
    rows = [(i, f"{own(i)}\n{body}\n{own(i + 50)}", "s") for i, (_, body) in enumerate(cases)] + [(100 + i, body, "s") for i, (_, body) in enumerate(cases)]
    got = {r["doc_id"]: r["licenses"] for r in licences.scan(docs(spark, rows, extra=True)).collect()}
    assert got == {i + at: name for i, (name, _) in enumerate(cases) for at in (0, 100)}


def test_long_white_space_is_packed(spark):
    """Runs of more than a million blanks, which the quick encoder gives up on, in the operator and in the pipeline's stage."""
    import corpus_pipeline

    texts = {1: " " * 1_200_000, 2: "\t" * 1_200_000 + "x", 3: "a" + " \n\t" * 400_000 + "<|endoftext|> b", 4: "plain"}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want = library_ids(texts)
    for added in (True, False):
        encode = packing.encoder(public_tokenizers.path(packing.VOCABULARY), added)
        assert added is False or all([*encode(t), 0] == want[i] for i, t in texts.items())
        assert 0 not in encode(texts[3]) or added
    assert_packed(packing.packed_digests(packing.pack(df, public_tokenizers.path(packing.VOCABULARY), added=True)).collect(), want)
    assert_packed(dict(corpus_pipeline.STAGES)["packing"](spark, df, "").select("*", F.crc32("ids").alias("ids_crc32")).collect(), want)
