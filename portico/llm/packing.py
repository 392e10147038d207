"""Sum-of-squares packing of token sequences.

Every document is its token ids and a final id 0. Full windows of a document go out at once; its
remainder is placed online where the sum of squared counts of partially filled windows, kept in an
array by fill level, grows least (ties: the fullest level, and an open window before a new one).
At the end of a task the windows still open are filled from the emptiest ones, cutting pieces, so a
task leaves one partial window at most. A sequence whose tokens are a power of two stays as long as
it is; any other is padded to ``size``: ``padded_tokens`` is its length with padding.

Each task packs the rows of its own partition: no shuffle, no state but its open windows, which hold
the ids of the partition's remainders. A partition is a file split, so its text, and with it the ids,
is bounded by ``spark.sql.files.maxPartitionBytes``; a larger split means fewer partial windows. Ids
are those of the ``tokenizers`` library for the given vocabulary; they are computed by ``tiktoken``
over the merges of the same file, which is several times faster and is tested to agree. Its pattern
engine gives up on a run of about a million white space characters; such a text is encoded by
``tokenizers`` itself, so that every text has its ids at any length.

Defined cases: a null text is an empty one and gives the single id 0; repeated rows are packed
each; an empty table gives no piece; a null id is kept; further columns are ignored. A text is
encoded whole, so a task holds the longest text's ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

WINDOW = 1024
VOCABULARY = "byte_bpe_50k.json"


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str, added: bool = False):
    """A function from text to ids by the byte-level vocabulary in path (tokenizers' JSON format).

    With ``added``, the library's default, the file's added tokens are single ids where a text has
    them; without, as with the library's ``encode_special_tokens``, they are ordinary text.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    byte = _byte_letters()
    special = {x["content"]: x["id"] for x in content["added_tokens"]}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in content["model"]["vocab"].items() if piece not in special}
    coding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special if added else {})
    quick = partial(coding.encode, allowed_special="all", disallowed_special=())  # without added there are none
    library = None

    def encode(text: str) -> list[int]:
        nonlocal library
        try:
            return quick(text)
        except ValueError as e:
            if "stack size" not in str(e):
                raise
        if library is None:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.encode_special_tokens = not added
        return library.encode(text, add_special_tokens=False).ids

    return encode


class Packer:
    """Windows of ``size`` tokens; ``add`` and ``finish`` return those that are complete.

    A piece is (key, start, ids, total) and a window a list of pieces.
    """

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.levels = np.zeros(size + 1, np.int64)  # how many open windows have each fill
        self.open: list[list[list]] = [[] for _ in range(size)]

    def level_for(self, n: int) -> int:
        """The fill to which n tokens are added; 0 is a new window."""
        room = self.size - n
        if room == 0:
            return 0
        counts, after = self.levels[1 : room + 1], self.levels[n + 1 : self.size + 1]
        cost = 2 * (after - counts) + 2
        cost[-1] = 1 - 2 * counts[-1]  # a window that fills up leaves the count
        cost[counts == 0] = np.iinfo(np.int64).max
        best = room - int(np.argmin(cost[::-1]))
        return best if cost[best - 1] <= 2 * self.levels[n] + 1 else 0

    def add(self, key, ids: np.ndarray) -> list[list]:
        whole = len(ids) // self.size * self.size
        done = [[(key, at, ids[at : at + self.size], len(ids))] for at in range(0, whole, self.size)]
        if whole == len(ids):
            return done
        piece = (key, whole, ids[whole:].copy(), len(ids))
        n = len(piece[2])
        level = self.level_for(n)
        if level:
            window = self.open[level].pop()
            self.levels[level] -= 1
        else:
            window = []
        window.append(piece)
        if level + n == self.size:
            done.append(window)
        else:
            self.open[level + n].append(window)
            self.levels[level + n] += 1
        return done

    def finish(self) -> list[list]:
        """All open windows, the fullest filled up from the emptiest; one stays partial at most."""
        windows = [(level, w) for level in range(self.size - 1, 0, -1) for w in self.open[level]]
        self.open = [[] for _ in range(self.size)]
        self.levels[:] = 0
        done, low, spare = [], len(windows), []
        for i, (level, window) in enumerate(windows):
            if i >= low:
                break
            room = self.size - level
            while room and (spare or low - 1 > i):
                if not spare:
                    low -= 1
                    spare = windows[low][1]
                key, start, ids, total = spare.pop()
                if len(ids) > room:
                    cut = len(ids) - room
                    spare.append((key, start, ids[:cut], total))
                    key, start, ids, total = key, start + cut, ids[cut:], total
                window.append((key, start, ids, total))
                room -= len(ids)
            done.append(window)
        return [*done, spare] if spare else done


PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_tokens long"


def padded(tokens: int, size: int) -> int:
    """The length of a sequence of so many tokens with its padding."""
    return tokens if tokens & (tokens - 1) == 0 else size


def pack(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", size: int = WINDOW, added: bool = False) -> DataFrame:
    """Pieces of packed sequences: key, place in the document, ids (little-endian 32-bit), place in the sequence.

    ``added`` as in ``encoder``.

    sequence_id is the task's number times 2**33 plus the sequence's number in it.
    """
    rows = df.select(key, F.coalesce(text, F.lit("")).alias("text"))
    key_type = rows.schema[0].dataType
    names = [key, *(x.split()[0] for x in PIECES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        encode, packer, number, held, tokens = encoder(vocabulary, added), Packer(size), TaskContext.get().partitionId() << 33, [], 0
        kinds = [to_arrow_type(key_type), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]

        def table_of(windows: list[list]) -> pa.RecordBatch:
            nonlocal number
            out = []
            for window in windows:
                full, at = sum(len(p[2]) for p in window), 0
                for k, start, ids, total in window:
                    out.append((k, start, len(ids), ids.tobytes(), total, number, at, full, padded(full, size)))
                    at += len(ids)
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            texts = batch.column(1)
            for i, j in slices(batch, [len(x.as_buffer()) for x in texts]):
                for k, t in zip(batch.column(0).slice(i, j - i).to_pylist(), texts.slice(i, j - i).to_pylist(), strict=True):
                    ids = encode(t)
                    ids.append(0)
                    for window in packer.add(k, np.array(ids, dtype="<u4")):
                        held.append(window)
                        tokens += size
                if tokens >= 1 << 20:
                    yield table_of(held)
                    held, tokens = [], 0
        held += packer.finish()
        for at in range(0, len(held), 1024):
            yield table_of(held[at : at + 1024])

    key_name = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {key_name}, {PIECES}")


def op2_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    import public_tokenizers

    return packed_digests(pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), added=True))


def packed_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_tokens")
