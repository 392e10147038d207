"""Ids under merge-dropout against a plain loop that draws by the same hash."""

import re
import zlib

import numpy as np
import public_tokenizers
import xxhash

from portico.llm import pieces
from portico.llm import queries as Q
from tests.compare import connect

SF = "/root/testdata/sf0.001"
FULL = (1 << 64) - 1


def mix(x):
    x &= FULL
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & FULL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & FULL
    return x ^ x >> 31


def skipped(key, start, middle, end):
    drawn = mix(key + start * 0x9E3779B97F4A7C15 + mix(middle * 0xC2B2AE3D27D4EB4F + end * 0x165667B19E3779F9))
    return (drawn >> 11) * 2.0**-53 < pieces.RATE


class Plain:
    """Symbols as strings; each turn joins the best pair whose draw lets it, leftmost first."""

    def __init__(self, path):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        self.id = {lib.id_to_piece(i): i for i in ids if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        self.order = {p: (-lib.get_score(i), i) for p, i in self.id.items()}
        self.byte = lib.piece_to_id("<0x00>")

    def chunk(self, word, key):
        # U+2581 in a text is no blank: it stands for itself and joins nothing.
        symbols = ["▁" if c == " " else "\0" + c if c == "▁" else c for c in word]
        at = list(range(len(symbols) + 1))
        while True:
            best = None
            for i in range(len(symbols) - 1):
                order = self.order.get(symbols[i] + symbols[i + 1])
                if order and symbols[i] in self.id and symbols[i + 1] in self.id and (best is None or order < best[0]) and not skipped(key, at[i], at[i + 1], at[i + 2]):
                    best = order, i
            if best is None:
                break
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del at[i + 1]
        out = []
        for s in symbols:
            out += [self.id[s]] if s in self.id else [self.byte + b for b in s.lstrip("\0").encode("utf-8", "surrogatepass") or b"\0"]
        return out

    def text(self, text, name):
        if not text:
            return []
        key, out = xxhash.xxh64_intdigest(name), []
        for place, word in enumerate(re.findall(" +[^ ]*", f" {text}")):
            own = mix(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) + mix(key + mix(place + pieces.SEED)))
            out += self.chunk(word, own)
        return out


def test_rows_like_the_plain_loop(spark):
    plain = Plain(public_tokenizers.path(pieces.MODEL))
    texts = dict(connect(SF).execute("select doc_id, coalesce(text, '') from documents where length(text) < 6000").fetchall())
    got = {r["doc_id"]: r for r in Q.QUERIES["op8_merge_dropout"](spark, SF).collect()}
    assert len(texts) > 150
    for i, t in texts.items():
        ids = np.array(plain.text(t, str(i)), "<u4")
        assert (got[i]["n_ids"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes())), i


def test_odd_texts_like_the_plain_loop():
    path = public_tokenizers.path(pieces.MODEL)
    plain, model = Plain(path), pieces.Pieces(path)
    texts = ["a▁b ▁ ▁▁c", "  two   blanks ", "漢字🎉\x00é", "abc" * 40, " " * 70 + "x", "the the the the " * 5, "ünïcödé_and-more/than+that" * 3]
    for k, (t, ids) in enumerate(zip(texts, pieces.encode_many(texts, [xxhash.xxh64_intdigest(str(k)) for k in range(len(texts))], model), strict=True)):
        assert plain.text(t, str(k)) == ids.tolist(), t
