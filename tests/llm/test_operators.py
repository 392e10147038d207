"""Every operator against a brute-force version, and its edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from portico.llm import audio, chat, licences, minhash, packing, pieces, quality, secrets, sharding, warc
from portico.llm.common import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    full = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    df = spark.createDataFrame(full, DOCS)
    # columns whose names clash with the operators' own
    return df.withColumns({"shard": F.lit("x"), "spans": F.lit(1), "kept": F.lit(0), "media": F.lit("m")}) if extra else df


EDGE = [(1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (4, "one two three", None), (4, "one two three", None), (None, "alpha beta gamma delta epsilon", "b"), (7, "long " * 40000, "b"), (8, "é漢🎉 \x00 x", "c")]


# 1 ---------------------------------------------------------------------------------------------
def test_companding_tables():
    mu, a = audio.mulaw_table(), audio.alaw_table()
    assert (mu[0], mu[0x80], mu[0xFF]) == (-32124, 32124, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)


def brute_adpcm(block):
    value = int(np.frombuffer(block[:2], "<i2")[0])
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for nib in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            diff = (step >> 3) + (step if nib & 4 else 0) + (step >> 1 if nib & 2 else 0) + (step >> 2 if nib & 1 else 0)
            value = max(-32768, min(32767, value - diff if nib & 8 else value + diff))
            index = max(0, min(88, index + int(audio.MOVES[nib & 7])))
            out.append(value)
    return out


def test_adpcm_blocks_like_a_loop():
    data = np.random.default_rng(1).integers(0, 256, (20, 64)).astype(np.uint8)
    assert audio.decode_adpcm(data).tolist() == [brute_adpcm(bytes(b)) for b in data]


def test_resample_is_linear():
    assert audio.resample(np.array([0, 10, 20], np.int16)).tolist() == [0, 5, 10, 15, 20, 20]


def test_wav_round_trip():
    for codec in ("mulaw", "alaw", "adpcm", "pcm"):
        payload = bytes(range(64)) * 2
        assert audio.parse_wav(audio.wav(payload, codec))[0::3] == (codec, payload)
    with pytest.raises(ValueError):
        audio.parse_wav(b"nothing")


def test_audio_edges(spark):
    df = docs(spark, EDGE, extra=True).withColumn("payload", audio.padded(F.col("text"))).withColumn("codec", F.lit("adpcm"))
    got = audio.expand(audio.store(df)).collect()
    assert len(got) == len(EDGE)
    for r in got:
        want = (r["text"] or "").encode()
        assert r["payload"] == want + b"\0" * (max(64, -(-len(want) // 64) * 64) - len(want))
        assert len(audio.parse_wav(r["pcm"])[3]) == len(r["payload"]) // 64 * 121 * 4
    broken = spark.createDataFrame([(1, bytearray(b"RIFF")), (2, None)], "id int, media binary")
    assert [r["feature"] for r in audio.expand(broken).collect()] == [None, None]
    assert audio.expand(audio.store(df.limit(0))).count() == 0


# 2 ---------------------------------------------------------------------------------------------
def test_packing_ids_and_places(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    tok = Tokenizer.from_file(path)
    rng = random.Random(3)
    rows = [r for r in EDGE if r[0] is not None] + [(100 + i, " ".join(rng.choice(["the", "unfold", "ça", "x1", "<|endoftext|>"]) for _ in range(rng.randint(0, 900))), "s") for i in range(60)]
    rows = [r for r in rows if r[0] != 4] + [(4, "one two three", None)]
    got = packing.pack(docs(spark, rows), path, added=True).collect()
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in rows}
    pieces_of, windows = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["doc_tokens"] == len(want[r["doc_id"]])
        pieces_of.setdefault(r["doc_id"], []).append((r["start"], ids))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_tokens"]))
        assert r["padded_tokens"] == (r["sequence_tokens"] if r["sequence_tokens"] in [2**k for k in range(11)] else 1024)
    for i, ids in want.items():
        assert [x for _, p in sorted(pieces_of[i]) for x in p] == ids
    for parts in windows.values():
        at = 0
        for offset, n, total in sorted(parts):
            assert offset == at
            at += n
        assert at == total <= 1024
    assert sum(1 for parts in windows.values() if parts[0][2] < 1024) <= spark.sparkContext.defaultParallelism
    assert packing.pack(docs(spark, []), path).count() == 0


def test_level_choice_is_least_sum_of_squares():
    rng = random.Random(5)
    p = packing.Packer(32)
    for _ in range(2000):
        n = rng.randint(1, 31)
        before, level = p.levels.copy(), p.level_for(n)

        def cost(lv):
            after = before.copy()
            if lv:
                after[lv] -= 1
            if lv + n < 32:
                after[lv + n] += 1
            return int((after[:32] ** 2).sum())

        options = [0, *[lv for lv in range(1, 33 - n) if before[lv]]]
        assert cost(level) == min(map(cost, options))
        p.add(0, np.zeros(n, np.uint32))


def test_open_windows_are_refilled_at_the_end():
    p = packing.Packer(10)
    done = [w for _ in range(50) for w in p.add(1, np.zeros(6, np.uint32))] + p.finish()
    assert sum(len(x[2]) for w in done for x in w) == 300
    assert len(done) == 30 and not p.finish()


# 3 ---------------------------------------------------------------------------------------------
def test_archive_round_trip(spark):
    big, rows = "b" * 1500, []
    rows = [(1, "http://a/1", big), (2, None, big), (5, "http://x\r\nWARC-Type: response", big), (5, "again", big), (3, "u", "small"), (4, "u", "small"), (6, "u%0D%250A%25250d\r", None), (None, "n\n", big), (9, "é", "é" * 600)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record int")
    path = shared_dir(spark)
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        text = bytes(r["record"])
        assert r["header_digest"] == hashlib.sha1(bytes(r["payload"])).hexdigest()
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        head, _, rest = text.partition(b"\r\n\r\n")
        length = int(head.rpartition(b"Content-Length: ")[2])
        assert len(rest) == length + 4
        if r["record_type"] == "response":
            assert rest.partition(b"\r\n\r\n")[2] == bytes(r["payload"]) + b"\r\n\r\n"
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got)
    assert kinds == [(0, "revisit", 5), (1, "revisit", 5), (2, "revisit", 5), (3, "response", 0), (4, "response", 0), (5, "response", 0), (5, "response", 0), (6, "response", 0), (9, "response", 0)]
    assert sorted((r["page_id"] or 0, r["url"] or "") for r in got) == sorted((i or 0, u or "") for i, u, _ in rows)
    parsed = {r["page_id"]: r for r in warc.parse_records(warc.read_archive(spark, path).filter("page_id IN (1, 4)")).collect()}
    assert [(r["parsed_type"], r["parsed_page"], r["parsed_refers_to"], r["parsed_payload"] and bytes(r["parsed_payload"])) for r in (parsed[1], parsed[4])] == [("revisit", 1, 5, None), ("response", 4, None, b"small")]
    empty = shared_dir(spark)
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_damaged_payload_fails(spark):
    path = shared_dir(spark)
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), path)
    stored = spark.read.parquet(f"{path}/payloads")
    bad = spark.createDataFrame(stored.collect(), stored.schema).withColumn("payload", F.encode(F.lit("y"), "UTF-8"))
    bad.write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, path).collect()
    good = warc.read_archive(spark, shared_archive(spark))
    for change in ("substring(record, 1, octet_length(record) - 5)", "encode(replace(decode(record, 'UTF-8'), 'xyz', 'xyy'), 'UTF-8')"):
        with pytest.raises(Exception, match="damaged record"):
            warc.parse_records(good.withColumn("record", F.expr(change))).collect()


def shared_archive(spark):
    path = shared_dir(spark)
    warc.write_archive(spark.createDataFrame([(1, "u", "xyz")], "page_id long, url string, html string"), path)
    return path


# 4 ---------------------------------------------------------------------------------------------
def brute_components(rows):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    ids, parent = list(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: root(i) for i in ids}


def test_near_duplicates_like_all_pairs(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    rows = [r for r in EDGE if r[0] is not None]
    at = 100
    for size in (1, 2, 3, 5, 60):
        for _ in range(6 if size < 60 else 1):
            base = [rng.choice(words) for _ in range(rng.randint(5, 160))]
            for _ in range(size):
                w = list(base)
                for _ in range(rng.randint(0, max(1, len(w) // 12))):
                    w[rng.randrange(len(w))] = rng.choice(words)
                rows.append((at, " ".join(w).upper() if rng.random() < 0.3 else "  ".join(w), "s"))
                at += 1
    rng.shuffle(rows)
    got = minhash.near_duplicates(docs(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows)
    kept = minhash.deduplicate(docs(spark, rows)).select("doc_id").collect()
    assert {r[0] for r in kept} == set(brute_components(rows).values())


def test_near_duplicates_edges(spark):
    rows = {(r["doc_id"], r["component_id"], r["n_shingles"]) for r in minhash.near_duplicates(docs(spark, EDGE)).collect()}
    assert rows == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (None, None, 2), (7, 7, 1), (8, 8, 1)}
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_min_and_max_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    x, y = minhash.signatures([a, b], 1024)
    assert abs((x == y).mean() - 1 / 3) < 0.05


# 5 ---------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|end|>", r"<\|end|>", r"<\\|turn|> [\INST]", "", " lead", "🎉é\n\n", "plain " * 500, "<|endoftext|>", "<<s>>"]
    assert all(chat.unescape(chat.escape(t)) == t for t in hard)
    rows = [(1, k, "assistant" if k % 2 else "user", t, 0) for k, t in enumerate(hard)] + [(2, 0, None, None, 0), (None, 1, "assistant", "x", 0), (None, 1, "assistant", "x", 0), (3, None, "assistant", "a", 0), (3, None, "assistant", "a", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    path = public_tokenizers.path(chat.VOCABULARY)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df, path)).collect()}
    loss = "".join(t for k, t in enumerate(hard) if k % 2)
    said = "".join(f"{'assistant' if k % 2 else 'user'}\n{t}\n" for k, t in enumerate(hard))
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert (got[2]["n_turns"], got[2]["loss_chars"], got[None]["loss_chars"], got[3]["loss_chars"]) == (1, 0, 1, 2)
    everything = chat.read_back(chat.format_conversations(df, path)).collect()
    assert [r["n_turns"] for r in everything if r["conv_id"] is None] == [1, 1]  # each by itself
    assert chat.read_back(chat.format_conversations(df.limit(0), path)).count() == 0


# 6 ---------------------------------------------------------------------------------------------
def test_licences_found(spark):
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 500)
    rows = [(10, "x\nLicensed under the Apache License, Version 2.0.\ny", "s"), (11, mit, "s"), (12, mit.replace(". ", ".\n").replace("Licence", "License"), "s"), (13, "This work is licensed under the GNU General Public License, version 2.", "s"), (14, "licensed to kill", "s")]
    got = {r["doc_id"]: (r["licenses"], r["n_licensed"]) for r in licences.scan(docs(spark, [*EDGE, *rows], extra=True)).collect()}
    assert [got[i] for i in (10, 11, 12, 13, 14)] == [("Apache-2.0", 2), ("MIT", 1), ("MIT", 1), ("GPL-2.0", 1), ("", 0)]  # the first as a line and as a whole text
    assert got[1] == ("", 0)


def test_size_bounds_are_exact():
    for n in range(1, 60):
        low, high = licences.bounds(n)
        for m in range(1, 120):
            possible = 100 * 2 * min(n, m) >= licences.THRESHOLD * (n + m)
            assert possible == (low <= m <= high)


# 7 ---------------------------------------------------------------------------------------------
def brute_counts(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {p + k for p, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(4)
    rows = [r for r in EDGE if r[0] != 7] + [(100 + i, "".join(rng.choice(["a ", "b ", "c\n", "# ", "\t", "x y z "]) for _ in range(rng.randint(0, 60))), "s") for i in range(80)]
    got = quality.judge(docs(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, _ in rows:
        want[(i, t)] = brute_counts(t)
    for r in got:
        assert tuple(r[c] for c in quality.COUNTS) == want[(r["doc_id"], r["text"])]
        assert not r["kept"] if r["base_failed"] else True


def test_frequent_lines_deplete_all_but_the_first(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    menu = " ".join(f"menu{k}" for k in range(70))
    rows = [(i, f"{own(i)}\n{menu if i % 2 else own(1000 + i)}", "h") for i in range(60)] + [(200 + i, f"{own(5000)}\n{own(6000 + i) if i else 'x'}", "other") for i in range(5)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs(spark, rows)).collect()}
    assert sorted(i for i, k in got.items() if not k) == [i for i in range(60) if i % 2 and i != 1]
    assert quality.judge(docs(spark, [])).count() == 0


def test_null_hosts_and_null_texts(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    line = " ".join(f"menu{k}" for k in range(70))
    n = quality.LINE_DOCUMENTS
    # half of the documents of '' and half of no host: neither reaches the limit, and null texts count nowhere
    rows = [(i, f"{own(i)}\n{line}", "" if i % 2 else None) for i in range(2 * n - 2)] + [(900 + k, None, s) for k in range(5) for s in ("", None)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs(spark, rows)).collect()}
    assert all(got[i] for i in range(2 * n - 2)) and not any(got[900 + k] for k in range(5))
    rows += [(300 + i, f"{own(300 + i)}\n{line}", None) for i in range(2)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs(spark, rows)).collect()}
    assert {i for i, k in got.items() if not k and i < 900} == {i for i in range(2 * n - 2) if i % 2 == 0 and i} | {300, 301}


# 8 ---------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(public_tokenizers.path(pieces.MODEL))


def test_without_dropout_like_the_library(model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    texts = ["Hello world", "", "a  b\n\tc 漢字🎉", "x" * 300, "tion " * 50, "Ünïcödé straße"]
    assert [x.tolist() for x in pieces.encode_many(texts, [1] * 6, model, 0.0)] == [lib.encode(t) for t in texts]


def test_dropout_varies_and_is_lossless(model):
    texts = ["internationalization of tokenizers " * 20, "▁ literal ▁", " lead  and trail ", "🎉" * 9]
    a = pieces.encode_many(texts, [1, 2, 3, 4], model, 0.3, 1)
    b = pieces.encode_many(texts, [1, 2, 3, 4], model, 0.3, 2)
    assert [pieces.decode_ids(x, model) for x in a] == texts == [pieces.decode_ids(x, model) for x in b]
    assert a[0].tolist() != b[0].tolist() and a[0].tolist() == pieces.encode_many(texts, [1, 2, 3, 4], model, 0.3, 1)[0].tolist()


def test_heap_and_batch_agree(model):
    rng = random.Random(8)
    for _ in range(300):
        word = " " * rng.randint(1, 3) + "".join(rng.choice("etaonihsrd") for _ in range(rng.randint(0, 20)))
        points = model.of_char[[ord(c) for c in word]]
        for rate in (0.0, 0.1, 0.6):
            grid, size = pieces.together(points[None].copy(), np.array([len(points)]), np.array([9], np.uint64), rate, model)
            assert pieces.agenda(points.tolist(), 9, rate, model) == grid[0, : size[0]].tolist()


def test_pieces_edges(spark):
    path = public_tokenizers.path(pieces.MODEL)
    got = pieces.decode(pieces.encode(docs(spark, EDGE, extra=True), path), path).collect()
    assert len(got) == len(EDGE)
    assert [r["doc_id"] for r in got if r["decoded"] != r["text"]] == []


# 9 ---------------------------------------------------------------------------------------------
def test_shards_move_only_into_new_ones(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    for n in (40, 41, 44):
        cols = df.select(sharding.shard_of(F.col("k"), sharding.default_tree(n)).alias("a"), sharding.shard_of(F.col("k"), sharding.default_tree(n + 1)).alias("b"))
        moved = {r["b"] for r in cols.filter("a <> b").distinct().collect()}
        assert moved == {n}
    sizes = [r["count"] for r in df.select(sharding.shard_of(F.col("k"), sharding.default_tree(40)).alias("s")).groupBy("s").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 1.35 * min(sizes)


def test_weights_move_rows_inside_their_subtree(spark):
    tree = sharding.default_tree(40)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 2.0) if x.shard == 3 else sharding.Leaf(x.region, x.rack, x.shard, x.weight * (2 / 3 if x.rack == "k0" and x.region == "r0" else 1)) for x in tree]
    df = spark.range(20000).select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), heavier).alias("b")).filter("a <> b")
    assert {(r["a"] // 4, r["b"] // 4) for r in df.distinct().collect()} == {(0, 0)}


def test_slots_are_gapless(spark):
    # own columns that clash, a hot key and equal rows beyond a block
    many = [(1000 + i, "t", "s") for i in range(500)] + [(None, f"{i % 7}", "s") for i in range(3000)] + [(5, "t", "s")] * (2 * sharding.BLOCK_ROWS + 5)
    df = docs(spark, [*EDGE, *many], extra=True).withColumns({"slot": F.lit(1), "__block": F.lit(1), "__n": F.lit(2)})
    tree = sharding.default_tree(40)
    got = sharding.place(df, "doc_id", tree, ties=("text",)).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append((r["slot"], r["doc_id"], r["text"]))
    assert len(got) == len(EDGE) + len(many) and all(sorted(x[0] for x in v) == list(range(len(v))) for v in by.values())
    assert Counter((i, t) for v in by.values() for _, i, t in v) == Counter((i, t) for i, t, _ in [*EDGE, *many])
    # by the digest of key and ties, like a plain sort
    said = lambda i, t: hashlib.md5(f"{'null' if i is None else i}/{'null' if t is None else t}".encode()).hexdigest()
    for v in by.values():
        assert [said(i, t) for _, i, t in sorted(v, key=lambda x: x[0])] == sorted(said(i, t) for _, i, t in v)
    assert sharding.place(df.limit(0), "doc_id", tree).count() == 0


def brute_shard(key, tree):
    """The walk of the docstring, child by child."""
    path, leaves = "", tree
    for level in ("region", "rack", "shard"):
        weights = {}
        for leaf in leaves:
            weights[str(getattr(leaf, level))] = weights.get(str(getattr(leaf, level)), 0) + leaf.weight
        draw = lambda name: -math.log((int(hashlib.md5(f"tree/{path}/{name}/{key}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12) / weights[name]  # noqa: B023, E731
        name = min(weights, key=draw)
        leaves = [x for x in leaves if str(getattr(x, level)) == name]
        path += f"/{name}"
    return leaves[0].shard


def test_draws_like_a_plain_walk(spark):
    tree = [sharding.Leaf(x.region, x.rack, x.shard, 1 + x.shard % 3) for x in sharding.default_tree(44)]
    for r in spark.range(300).select("id", sharding.shard_of(F.col("id"), tree).alias("s")).collect():
        assert r["s"] == brute_shard(str(r["id"]), tree)


# 10 --------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def markov(spark):
    rng = random.Random(1)
    syllables = ["the", "ing", "tion", "er", "and", "con", "ment", "al", "ver", "sta"]
    rows = [(i, " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 6))) for _ in range(60)), "s") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    return secrets.train(docs(spark, rows), labels)


def test_markov_on_held_out(markov):
    rng = random.Random(77)
    letters = secrets.ALPHABET[:62]
    random_ones = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(500)]
    plain = ["".join(rng.choice(["the", "ing", "tion", "er", "and", "con", "ment", "al"]) for _ in range(8)) for _ in range(500)]
    assert sum(secrets.score(t, markov) > secrets.MARGIN for t in random_ones) >= 495
    assert sum(secrets.score(t, markov) > secrets.MARGIN for t in plain) <= 5


def brute_spans(text):
    import re

    out = [("assign", m.start(), m.end()) for m in re.finditer(secrets.ASSIGN, text, re.I | re.A) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer(secrets.ACCESS, text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer(secrets.HEX, text) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def test_base_spans_like_plain_patterns(markov):
    rng = random.Random(6)
    bits = ["password", " = ", ":", '"', "AKIA", "ABCDEFGHIJ1234", "deadbeef00112233", "Secret", "api_key", "x" * 12, " ", "é", "tOKEN", "0a1b", "\n", "ſecret", "=="]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [s[:3] for s in secrets.spans(text, markov) if s[0] != "markov"] == brute_spans(text)


def test_secret_edges(spark, markov):
    got = secrets.find(docs(spark, EDGE, extra=True), markov).collect()
    assert len(got) == len(EDGE) and all(r["spans"] == [] for r in got)
    text = "key é password=abcdefghijkl0 and q7GhT2kLmZ9xWc4VbN8pR5sD1fJ0 end"
    row = secrets.redact(docs(spark, [(1, text, "s"), (2, None, "s")]), markov).orderBy("doc_id").collect()
    assert row[0]["text"] == "key é [SECRET] and [SECRET] end" and row[1]["text"] is None
    empty = secrets.train(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert secrets.spans("zzzzzzzzzzzzzzzzzzzz", empty) == []


def test_tail_and_crc(spark):
    r = spark.createDataFrame([("ab",)], "text string").select(audio.padded(F.col("text")).alias("p")).select(F.crc32("p").alias("c")).first()
    assert r["c"] == zlib.crc32(b"ab" + b"\0" * 62)
