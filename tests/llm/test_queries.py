"""The registered queries of the subpackage: against SQL, and the pipeline against a plain version."""

import base64
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from portico.llm import packing, pieces, quality, secrets
from portico.llm import queries as Q
from tests.compare import assert_same, connect

from .test_operators import brute_adpcm, brute_components, brute_counts, brute_spans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    df = Q.QUERIES[name](spark, SF)
    if Q.SQL.get(name):
        assert_same(df, connect(SF), Q.SQL[name])
    else:
        assert df.count() > 0


def test_every_number_is_there():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in Q.QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in connect(SF).execute("select doc_id, text from documents").fetchall()}


def plain_codec(payload, codec):
    """Samples of mu-law, A-law and ADPCM codes by loops over the formats' definitions."""
    if codec == "adpcm":
        return [v for k in range(0, len(payload), 64) for v in brute_adpcm(payload[k : k + 64])]
    out = []
    for byte in payload:
        if codec == "mulaw":
            c = byte ^ 255
            size = ((2 * (c & 15) + 33) << (c >> 4 & 7)) - 33
            out.append(-4 * size if c & 128 else 4 * size)
        else:
            c = byte ^ 0x55
            part, low = c >> 4 & 7, c & 15
            size = 2 * low + 1 if part == 0 else (2 * low + 33) << (part - 1)
            out.append(8 * size if c & 128 else -8 * size)
    return out


def test_audio_rows_like_plain_loops(spark, texts):
    got = {r["doc_id"]: r for r in Q.QUERIES["op1_telephony_audio"](spark, SF).collect()}
    assert sorted(got) == sorted(texts)
    for i, t in texts.items():
        data, r = t.encode(), got[i]
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        codec = ("mulaw", "alaw", "adpcm")[zlib.crc32(payload) % 3]
        tag, bits, align, speed = {"mulaw": (7, 8, 1, 8000), "alaw": (6, 8, 1, 8000), "adpcm": (17, 4, 64, 8000 * 64 // 121)}[codec]
        fmt = tag.to_bytes(2, "little") + b"\1\0" + (8000).to_bytes(4, "little") + speed.to_bytes(4, "little") + bytes([align, 0, bits, 0]) + (b"\2\0\x79\0" if tag == 17 else b"\0\0")
        pcm = plain_codec(payload, codec)
        body = b"WAVEfmt " + len(fmt).to_bytes(4, "little") + fmt + b"fact\4\0\0\0" + len(pcm).to_bytes(4, "little") + b"data" + len(payload).to_bytes(4, "little") + payload
        media = b"RIFF" + len(body).to_bytes(4, "little") + body
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"], r["codec"]) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), codec)
        crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False))
        assert r["feature"] == f"{codec};samples={len(pcm)};sum={sum(pcm)};energy={sum(x * x for x in pcm)};peak={max(map(abs, pcm))};crossings={crossings};samples_16000={2 * len(pcm)}"


def assert_packed(got, want):
    """Pieces against the whole ids of each document: all columns of the contract, and little padding."""
    parts, windows = {}, {}
    for r in got:
        parts.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["padded_tokens"]))
    assert sorted(parts) == sorted(want)
    for i, rows in parts.items():
        ids, at = want[i], 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for rows in windows.values():
        at = 0
        for offset, n, whole in sorted(rows):
            assert offset == at
            at += n
        assert all(whole == (at if at.bit_count() == 1 else 1024) for _, _, whole in rows) and at <= 1024
        padding += rows[0][2] - at
    assert padding < 1024 * 8


def library_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    return {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}


def test_packed_rows_like_the_library(spark, texts):
    assert_packed(Q.QUERIES["op2_packed_sequences"](spark, SF).collect(), library_ids(texts))


def test_merge_dropout_rows(spark, texts):
    import sentencepiece

    got = {r["doc_id"]: r for r in Q.QUERIES["op8_merge_dropout"](spark, SF).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(got) == sorted(texts) and all(r["lossless"] for r in got.values())
    for i, t in texts.items():
        assert (got[i]["n_chars"], got[i]["decoded_sha256"]) == (len(t), hashlib.sha256(t.encode()).hexdigest())
        least = len(lib.encode(t))
        assert least * 0.98 <= got[i]["n_ids"] <= 2 * least + 20  # skipped merges make more pieces
    # The library decodes the varied ids to the same texts.
    model = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    some = list(texts.items())
    for (i, t), ids in zip(some, pieces.encode_many([t for _, t in some], [xxhash.xxh64_intdigest(str(i)) for i, _ in some], model), strict=True):
        assert lib.decode(ids.tolist()) == t and got[i]["ids_crc32"] == zlib.crc32(ids.tobytes())


def test_control_texts_are_a_conversation(spark):
    said = "</s>[INST] ok [/INST]"
    r = Q.QUERIES["op5_chat_masks"](spark, SF).filter("conv_id = -1").first()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def plain_quality(rows):
    """Rows (doc_id, text, source) that stay, without their frequent lines, by the rules of the docstring."""
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip().lower()
    holders, hosts = {}, {}
    for i, t, s in rows:
        hosts.setdefault(s, set()).add(t)
        for line in {norm(x) for x in t.split("\n")} - {""}:
            holders.setdefault((s, line), {}).setdefault(t, i)
            holders[(s, line)][t] = min(holders[(s, line)][t], i)
    frequent = {k: min(v.values()) for k, v in holders.items() if len(v) >= quality.LINE_DOCUMENTS and 100 * len(v) > quality.LINE_SHARE * len(hosts[k[0]])}
    kept = []
    for i, t, s in rows:
        n, _, _, _, rep = brute_counts(t)
        lost = sum(len(x.split()) for x in t.split("\n") if frequent.get((s, norm(x)), i) != i)
        if n >= quality.LEAST_WORDS and 100 * rep <= quality.MOST_REPEATED * n and 100 * (n - lost) >= quality.KEEP_PERCENT * n:
            kept.append((i, "\n".join(x for x in t.split("\n") if not norm(x) or frequent.get((s, norm(x)), i) == i), s))
    return kept


def plain_model(rows, labels):
    """The likelihood ratios of the docstring by counting in dictionaries."""
    good = sorted({i for i, q in labels if q == 1}, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[: secrets.TRAIN_DOCUMENTS]
    good, seen = set(good), [{}, {}]

    def count(kind, s):
        for a, b in zip(["", *s], s, strict=False):
            seen[kind][a, b] = seen[kind].get((a, b), 0) + 1

    for i, t in rows:
        if i not in good:
            continue
        spans = [t[a:b] for kind, a, b in brute_spans(t) if kind != "assign"]
        spans += [m[2] for m in re.finditer(secrets.ASSIGN, t, re.I | re.A) if len(m[2]) >= 12]
        digest = hashlib.sha256(str(i).encode())
        for s in [*spans, digest.hexdigest(), base64.b64encode(digest.digest()).decode()]:
            count(1, s)
        for s in re.findall(r"[A-Za-z0-9+/_=-]{6,}", plain_cut(t)):
            for form in (s, s.upper(), f"{s}_{s}", s + s[0].upper() + s[1:]):
                count(0, form)
    n, out = len(secrets.ALPHABET), {}
    for a in ["", *secrets.ALPHABET]:
        total = [sum(seen[k].get((a, b), 0) for b in secrets.ALPHABET) + 0.5 * n for k in (0, 1)]
        for b in secrets.ALPHABET:
            share = [math.log((seen[k].get((a, b), 0) + 0.5) / total[k]) for k in (0, 1)]
            out[a, b] = share[1] - share[0]
    return out


def plain_cut(t):
    return re.sub(rf"(?:(?i:{secrets.ASSIGN}))|(?:AKIA[A-Z0-9]+)|(?:[0-9a-f]{{16,}})", " ", t, flags=re.A)


def plain_redacted(t, ratio):
    fixed = [(a, b) for _, a, b in brute_spans(t)]
    base = list(fixed)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", t):
        if not any(a < m.end() and m.start() < b for a, b in fixed) and sum(ratio[x] for x in zip(["", *m[0]], m[0], strict=False)) > secrets.MARGIN:
            base.append(m.span())
    out, at = "", 0
    for a, b in sorted(base):
        out += t[at:a] + ("[SECRET]" if a >= at else "")
        at = max(at, b)
    return out + t[at:]


def test_pipeline_like_a_plain_version(spark):
    got = corpus_pipeline.run(spark, SF)
    con = connect(SF)
    left = plain_quality(con.execute("select doc_id, text, source from documents").fetchall())
    comp = brute_components(left)
    left = [r for r in left if comp[r[0]] == r[0]]
    ratio = plain_model([(i, t) for i, t, _ in left], con.execute("select doc_id, quality from labels").fetchall())
    want = library_ids({i: plain_redacted(t, ratio) for i, t, _ in left})
    assert_packed(got.select("*", F.crc32("ids").alias("ids_crc32")).collect(), want)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scans", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema


EMPTY = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "word " * 80, "en", "s", 400), (4, " ".join(f"w{k}" for k in range(30000)), "en", None, 1), (5, " ".join(f"v{k}" for k in range(90)), None, "s", None)]


def test_stages_take_nulls_and_empty_tables(spark):
    """Null and repeated rows, a very long text, and no rows at all, through every stage."""
    docs = spark.createDataFrame(EMPTY, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            left = {r["doc_id"] for r in stage(spark, rows, SF).collect()}
            kept = {4, 5} if name == "quality_rules" else {1, 2, None, 4, 5}  # the null id repeats one word
            assert left == (kept if rows is docs else set()), name
