"""SentencePiece encoding with seeded merge-dropout, and decoding.

A merge-type model joins neighbouring symbols, best score first and leftmost among equals. Under
dropout each candidate of that agenda is skipped if a keyed hash of the seed, the text's key, the
chunk, its place in the text and the candidate's place in the chunk falls below the rate; at rate 0
the ids are the library's own. A chunk is a run of spaces and the characters up to the next one; no
piece of such a model crosses that edge.

All chunks of a batch go through the agenda together, one numpy step per candidate: occurrences of a
chunk share a state as long as their draws agree, and each draws by itself whether its state's next
candidate is skipped. Chunks longer than ``LONG`` characters take the agenda one by one with a heap.
Characters without a piece, and U+2581 itself,
become byte pieces, so decoding gives back every text exactly.

Defined cases: a null text gives null ids and null text; an empty text has no ids;
repeated rows get equal ids; a null key counts as one key; an empty table gives an empty result;
further columns pass through, own columns replace ones of their name. A text is encoded whole.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

MODEL = "piece_bpe_32k.model"
RATE, SEED, LONG = 0.1, 7, 48
_CHUNK = re.compile(" +[^ ]*")
#: Ids from here on stand for characters without a piece.
_OUT = 1 << 17
#: Bits of the right symbol in a pair's key; symbols go up to _OUT + 0x10FFFF.
_BITS = 32
_NONE = np.int32(1 << 30)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class Pieces:
    """A merge-type model as tables."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_from = model.piece_to_id("<0x00>")
        plain = {model.id_to_piece(i): i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.data = [b""] * size
        for piece, i in plain.items():
            self.data[i] = piece.replace("▁", " ").encode()
        for b in range(256):
            self.data[self.bytes_from + b] = bytes([b])
        order = sorted(plain.values(), key=lambda i: (-model.get_score(i), i))
        rank = {i: k for k, i in enumerate(order)}
        pairs = [(plain[p[:c]] << _BITS | plain[p[c:]], rank[i], i) for p, i in plain.items() for c in range(1, len(p)) if p[:c] in plain and p[c:] in plain]
        pairs.sort()
        self.keys = np.array([k for k, _, _ in pairs] + [1 << 62], dtype=np.int64)
        self.ranks = np.array([r for _, r, _ in pairs] + [0], dtype=np.int64)
        self.merged = np.array([i for _, _, i in pairs] + [0], dtype=np.int64)
        self.of_char = np.arange(0x110000, dtype=np.int64) + _OUT
        for piece, i in plain.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        self.of_char[ord(" ")] = plain["▁"]
        self.of_char[0x2581] = _OUT + 0x2581

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, key)
        return self.keys[at] == key, at

    def bytes_of(self, symbol: int) -> list[int]:
        return [self.bytes_from + b for b in chr(symbol - _OUT).encode("utf-8", "surrogatepass")]


def dropped(chunk: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether candidates are skipped, by the chunk's key and their place."""
    place = [np.asarray(x).astype(np.uint64) * f for x, f in zip((start, middle, end), _PLACES, strict=True)]
    drawn = _mixed(chunk + place[0] + _mixed(place[1] + place[2]))
    return (drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53 < rate


def agenda(symbols: list[int], chunk: int, rate: float, model: Pieces) -> list[int]:
    """One chunk by a heap of candidates."""
    n = len(symbols)
    left, right, ends = list(range(-1, n - 1)), [*range(1, n), -1], list(range(1, n + 1))
    value, queue = list(symbols), []
    key = np.array([chunk], dtype=np.uint64)

    def offer(places: list[int]) -> None:
        places = [i for i in places if i >= 0 and right[i] >= 0]
        if not places:
            return
        keys = np.array([value[i] << _BITS | value[right[i]] for i in places], dtype=np.int64)
        hit, at = model.look_up(keys)
        skip = dropped(key, np.array(places), np.array([ends[i] for i in places]), np.array([ends[right[i]] for i in places]), rate) if rate else np.zeros(len(places), bool)
        for i, h, a, s in zip(places, hit, at, skip, strict=True):
            if h and not s:
                heapq.heappush(queue, (int(model.ranks[a]), i, ends[i], ends[right[i]], int(model.merged[a])))

    offer(list(range(n)))
    alive = [True] * n
    while queue:
        _, i, middle, end, piece = heapq.heappop(queue)
        j = right[i] if alive[i] else -1
        if j < 0 or ends[i] != middle or ends[j] != end:
            continue
        value[i], ends[i], alive[j] = piece, end, False
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer([left[i], i])
    return [value[i] for i in range(n) if alive[i]]


def walk(symbols: np.ndarray, sizes: np.ndarray, state: np.ndarray, keys: np.ndarray, rate: float, model: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of many chunks at once: rows of symbols with their sizes, the row and key of each occurrence.

    Returns the pieces of all results end to end, their sizes, and the result of each occurrence. A
    state is a row's symbols after some draws, with the ranks of the candidates that are still open.
    """
    width = symbols.shape[1]
    column = np.arange(width)
    sym = symbols.astype(np.int32)
    starts = np.tile(np.arange(width + 1, dtype=np.int8 if width < 127 else np.int16), (len(sym), 1))
    rank = np.full((len(sym), width), _NONE)
    hit, at = model.look_up(np.where(column[1:] < sizes[:, None], symbols[:, :-1] << _BITS | symbols[:, 1:], -1).ravel())
    rank[:, :-1] = np.where(hit, model.ranks[at], _NONE).reshape(len(sym), -1)
    sizes, who, result = sizes.copy(), np.arange(len(state)), np.empty(len(state), np.int64)
    data, counts, n_results = [], [], 0
    while len(sym):
        own = np.arange(len(sym))
        best = rank.argmin(axis=1)
        ended = rank[own, best] == _NONE
        if ended.any():
            rows = sym[ended]
            data.append(rows[np.arange(rows.shape[1]) < sizes[ended, None]])
            counts.append(sizes[ended])
            number = np.cumsum(ended) - 1
            out = ended[state]
            result[who[out]] = n_results + number[state[out]]
            n_results += int(ended.sum())
            state, who, keys = state[~out], who[~out], keys[~out]
        if rate:
            place = [starts[own, best + k].astype(np.int64) for k in range(2)] + [starts[own, np.minimum(best + 2, starts.shape[1] - 1)].astype(np.int64)]
            skip = dropped(keys, *[x[state] for x in place], rate)
        else:
            skip = np.zeros(len(state), bool)
        branch = state * 2 + skip
        there = np.zeros(2 * len(sym), bool)
        there[branch] = True
        state = (np.cumsum(there) - 1)[branch]
        parent, skipped = np.divmod(np.flatnonzero(there), 2)
        skipped = skipped.astype(bool)
        best, sizes = best[parent], sizes[parent] - ~skipped
        if not len(parent):
            break
        wide = max(int(sizes.max()) + 1, 2)  # a column without a candidate stays behind the last pair
        wide = min(wide, sym.shape[1])
        places = np.arange(wide)
        # A merge takes out the symbol, start and pair behind the one it joins.
        after = (~skipped[:, None]) & (places > best[:, None])
        pick = np.minimum(places + after, sym.shape[1] - 1)
        merged = model.merged[model.look_up(sym[parent, best].astype(np.int64) << _BITS | sym[parent, np.minimum(best + 1, sym.shape[1] - 1)])[1]]
        sym = sym[parent[:, None], pick]
        rank = rank[parent[:, None], pick]
        edges = np.arange(wide + 1)
        starts = starts[parent[:, None], np.minimum(edges + ((~skipped[:, None]) & (edges > best[:, None])), starts.shape[1] - 1)]
        own = np.arange(len(parent))
        rank[own[skipped], best[skipped]] = _NONE
        rows, cols = own[~skipped], best[~skipped]
        sym[rows, cols] = merged[~skipped]
        for shift in (-1, 0):
            left = cols + shift
            pair = (left >= 0) & (left + 1 < sizes[rows])
            r, c = rows[pair], left[pair]
            hit, at = model.look_up(sym[r, c].astype(np.int64) << _BITS | sym[r, c + 1])
            rank[r, c] = np.where(hit, model.ranks[at], _NONE)
            if shift == 0:
                rank[rows[~pair], left[~pair]] = _NONE
    flat = np.concatenate(data).astype(np.int64) if data else np.zeros(0, np.int64)
    return flat, np.concatenate(counts) if counts else np.zeros(0, np.int64), result


def together(symbols: np.ndarray, sizes: np.ndarray, chunks: np.ndarray, rate: float, model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Many chunks at once, each with its key: rows of symbols with their sizes, joined in place; returns both."""
    flat, counts, result = walk(symbols, sizes, np.arange(len(symbols)), chunks, rate, model)
    at = (np.cumsum(counts) - counts)[result]
    sizes[:] = counts[result]
    inside = np.arange(symbols.shape[1]) < sizes[:, None]
    symbols[inside] = flat[(at[:, None] + np.arange(symbols.shape[1]))[inside]]
    return symbols, sizes


def encode_many(texts: list[str], keys: list[int], model: Pieces, rate: float = RATE, seed: int = SEED) -> list[np.ndarray]:
    """The ids of each text; keys vary the segmentation."""
    split = [_CHUNK.findall(f" {t}") if t else [] for t in texts]
    counts = np.array([len(c) for c in split])
    seen: dict[str, int] = {}
    code = np.fromiter((seen.setdefault(c, len(seen)) for chunks in split for c in chunks), dtype=np.int64, count=int(counts.sum()))
    words = list(seen)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    place = np.arange(len(code)) - first
    key = np.repeat(np.array(keys, dtype=np.uint64), counts)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    digests = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)
    own = _mixed(digests[code] + _mixed(key + _mixed(place.astype(np.uint64) + np.uint64(seed & (1 << 64) - 1))))
    points = model.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")]
    offsets = np.cumsum(lengths) - lengths
    by_word = np.argsort(code, kind="stable")
    uses = np.bincount(code, minlength=len(words))
    use_at = np.cumsum(uses) - uses
    done_data: list[np.ndarray] = []
    done_sizes: list[np.ndarray] = []
    which, n_done, low = np.empty(len(code), np.int64), 0, 0
    for high in (4, 6, 8, 10, 12, 16, 24, 32, LONG):
        rows = np.flatnonzero((lengths > low) & (lengths <= high))
        low = high
        if not len(rows):
            continue
        # Whole chunks, about a million symbols of their occurrences at a time.
        for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(uses[rows]) * high // 1_000_000)) + 1):
            grid = points[np.minimum(offsets[part, None] + np.arange(high), len(points) - 1)]
            state = np.repeat(np.arange(len(part)), uses[part])
            mine = by_word[np.arange(len(state)) + np.repeat(use_at[part] - (np.cumsum(uses[part]) - uses[part]), uses[part])]
            flat, sizes, result = walk(grid, lengths[part], state, own[mine], rate, model)
            which[mine] = n_done + result
            n_done += len(sizes)
            done_data.append(flat)
            done_sizes.append(sizes)
    for i in np.flatnonzero(lengths > LONG):
        chunk = points[offsets[i] : offsets[i] + lengths[i]].tolist()
        mine = by_word[use_at[i] : use_at[i] + uses[i]]
        # At rate 0 all occurrences are the same.
        for group in [mine[k : k + 1] for k in range(len(mine))] if rate else [mine]:
            out = np.array(agenda(chunk, int(own[group[0]]), rate, model), np.int64)
            which[group] = n_done
            n_done += 1
            done_data.append(out)
            done_sizes.append(np.array([len(out)]))
    flat, sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_data, done_sizes))
    if (flat >= _OUT).any():
        owner = np.repeat(np.arange(len(sizes)), sizes)
        spelt = [model.bytes_of(int(s)) if s >= _OUT else None for s in np.unique(flat)]
        table_of = dict(zip(np.unique(flat).tolist(), spelt, strict=True))
        extra = np.ones(len(flat), np.int64)
        out_at = np.flatnonzero(flat >= _OUT)
        extra[out_at] = [len(table_of[s]) for s in flat[out_at].tolist()]
        sizes = np.bincount(owner, weights=extra, minlength=len(sizes)).astype(np.int64)
        starts = np.cumsum(extra) - extra
        wide = np.repeat(flat, extra)
        for a, s in zip(starts[out_at].tolist(), flat[out_at].tolist(), strict=True):
            wide[a : a + len(table_of[s])] = table_of[s]
        flat = wide
    at = np.cumsum(sizes) - sizes
    each = sizes[which]
    ends = np.cumsum(each)
    ids = flat[np.repeat(at[which] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)].astype("<u4")
    edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return [ids[edge[i] : edge[i + 1]] for i in range(len(texts))]


def decode_ids(ids: np.ndarray, model: Pieces) -> str:
    return b"".join(map(model.data.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


def _run(df: DataFrame, out: str, kind: T.DataType, arrow: pa.DataType, work) -> DataFrame:
    """df with a column that work(model, batch) yields for slices of each batch."""
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, kind)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or Pieces(work.path)
            source = batch.column(batch.schema.get_field_index(work.column))
            for i, j in slices(batch, [len(x.as_buffer()) if x.is_valid else 0 for x in source], 2 << 20):
                part = batch.slice(i, j - i)
                new = pa.array(work(model, part), arrow)
                yield pa.RecordBatch.from_arrays([new if n == out else part.column(part.schema.get_field_index(n)) for n in names], names=names)

    return df.mapInArrow(run, schema)


class _Encode:
    def __init__(self, path, column, key, rate, seed):
        self.path, self.column, self.key, self.rate, self.seed = path, column, key, rate, seed

    def __call__(self, model: Pieces, part: pa.RecordBatch) -> list[bytes | None]:
        texts = part.column(part.schema.get_field_index(self.column)).to_pylist()
        keys = [xxhash.xxh64_intdigest(str(k)) for k in part.column(part.schema.get_field_index(self.key)).to_pylist()]
        there = [i for i, t in enumerate(texts) if t is not None]
        out: list[bytes | None] = [None] * len(texts)
        for i, ids in zip(there, encode_many([texts[i] for i in there], [keys[i] for i in there], model, self.rate, self.seed) if there else [], strict=True):
            out[i] = ids.tobytes()
        return out


class _Decode:
    def __init__(self, path, column):
        self.path, self.column = path, column

    def __call__(self, model: Pieces, part: pa.RecordBatch) -> list[str | None]:
        return [None if x is None else decode_ids(np.frombuffer(x, "<u4"), model) for x in part.column(part.schema.get_field_index(self.column)).to_pylist()]


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", out: str = "ids", rate: float = RATE, seed: int = SEED) -> DataFrame:
    """df with the ids of its text column as little-endian 32-bit words."""
    return _run(df, out, T.BinaryType(), pa.binary(), _Encode(path, text, key, rate, seed))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of its ids column."""
    return _run(df, out, T.StringType(), pa.string(), _Decode(path, ids))


def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded under dropout and decoded again."""
    import public_tokenizers

    path = public_tokenizers.path(MODEL)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    read = decode(encode(docs, path), path)
    return read.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("lossless"),
    )
