"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and its sorted assistant spans are
intersected with the token spans by binary search. The template is
``<|turn|>role<|text|>text<|end|>`` per turn; the three marks are single tokens, so token edges fall
on text edges. Control strings inside roles and texts get a backslash after their first character
(``<|end|>`` becomes ``<\\|end|>``, which itself would become ``<\\\\|end|>``), which is undone exactly.

Defined cases: turns are ordered by turn, role, text, null turns first; a null role or text is an
empty one; a row with a null conv_id is a conversation by itself, as nothing says what it belongs to; repeated rows are turns of their own; an
empty table gives no conversation; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: The control strings, each as first character and rest. They start with < or [, end
#: with > or ], and hold no such character between, so matches never overlap.
CONTROLS = r"(<)(\\*)(\|(?:turn|text|end|endoftext)\|>|/?s>)|(\[)(\\*)(/?INST\])"
_HIDE = re.compile(CONTROLS)
_SHOW = re.compile(CONTROLS.replace(r"(\\*)", r"\\(\\*)"))
_TURNS = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.S)
VOCABULARY = "byte_bpe_50k.json"


def escape(text: str) -> str:
    return _HIDE.sub(lambda m: f"{m[1] or m[4]}\\{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def unescape(text: str) -> str:
    return _SHOW.sub(lambda m: f"{m[1] or m[4]}{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns and the spans of the assistant's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(a), unescape(b)) for a, b in _TURNS.findall(formatted)]


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token that lies in a span; spans are sorted and disjoint."""
    if not spans:
        return np.zeros(len(starts), np.int8)
    lows, highs = np.array(spans, dtype=np.int64).T
    k = np.searchsorted(lows, starts, "right") - 1
    inside = (k >= 0) & (ends <= highs[np.maximum(k, 0)]) & (ends > starts)
    return inside.astype(np.int8)


def masked_runs(starts: np.ndarray, ends: np.ndarray, mask: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Joined character spans of the tokens under the mask."""
    on = mask.astype(bool)
    change = np.zeros(size + 2, np.int64)
    np.add.at(change, starts[on] + 1, 1)
    np.add.at(change, ends[on] + 1, -1)
    covered = np.cumsum(change) > 0
    edges = np.flatnonzero(np.diff(covered.astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    out = Tokenizer.from_file(path)
    out.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
    return out


FORMATTED = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss_mask array<tinyint>"


def format_conversations(rows: DataFrame, vocabulary: str) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text): text, tokens, spans and mask."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    alone = rows.filter("conv_id IS NULL").select("conv_id", F.array(turn).alias("turns"))
    ready = whole.unionAll(alone).select(F.col("conv_id").cast("long"), F.expr("transform(turns, t -> struct(t.role AS role, t.text AS text))").alias("turns"))
    ready = ready.withColumn("size", F.expr("cast(aggregate(turns, 0L, (n, t) -> n + octet_length(t.text)) as long)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = tokenizer(vocabulary)
        for batch in batches:
            for i, j in slices(batch, batch.column(2).to_pylist(), 512 << 10):
                part = batch.slice(i, j - i)
                made = [render([(t["role"], t["text"]) for t in turns]) for turns in part.column(1).to_pylist()]
                ids, starts, ends, masks = [], [], [], []
                for e, (_, spans) in zip(encoder.encode_batch([t for t, _ in made], add_special_tokens=False), made, strict=True):
                    offsets = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
                    ids.append(np.array(e.ids, dtype=np.int32))
                    starts.append(offsets[:, 0])
                    ends.append(offsets[:, 1])
                    masks.append(mask_tokens(offsets[:, 0], offsets[:, 1], spans))
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t for t, _ in made], pa.string()), pa.array(ids, ints), pa.array(starts, ints), pa.array(ends, ints), pa.array(masks, pa.list_(pa.int8()))],
                    names=["conv_id", "formatted", "ids", "starts", "ends", "loss_mask"],
                )

    return ready.mapInArrow(run, FORMATTED)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say: turns from the text, loss text from tokens and mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in zip(*(batch.column(i) for i in range(6)), strict=True):
                conv, text = row[0].as_py(), row[1].as_py()
                starts, ends, mask = (x.values.to_numpy(zero_copy_only=False) for x in row[3:6])
                turns = parse(text)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(unescape(text[a:b]) for a, b in masked_runs(starts, ends, mask, len(text)))
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                rows.append((conv, len(turns), sha(said), len(loss), sha(loss), len(text), len(mask), int(mask.sum())))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in READ_BACK.split(", ")])

    return formatted.mapInArrow(run, READ_BACK)


def op5_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings, read back from their format."""
    import public_tokenizers

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    found = read_back(format_conversations(rows.unionByName(probe), public_tokenizers.path(VOCABULARY)))
    return found.drop("n_tokens", "loss_tokens")


def _sql() -> str:
    # RE2 has no names for the groups that do not take part: they are empty.
    hide = lambda x: f"regexp_replace({x}, '{CONTROLS}', '\\1\\4\\\\\\2\\5\\3\\6', 'g')"
    marks = len(TURN + TEXT + END)
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM r),
g AS (SELECT conv_id, own, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum({marks} + length({hide('role')}) + length({hide('text')})) AS formatted FROM k GROUP BY conv_id, own)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted AS BIGINT) AS formatted_chars FROM g
"""


#: Everything but the tokens: turns, loss text and length of the template.
OP5_SQL = _sql()
