"""The first of the codes within some edits of another: rows meet by parts of their numbers, keys are made inside a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows meet in so many buckets.
BUCKETS = 1024
#: Characters of a part by which numbers meet, at most.
BLOCK = 3


def _pairs(a: int, e: int, edits: int) -> Iterator[tuple[list[tuple[int, ...]], list[tuple[int, ...]]]]:
    """Places left out of numbers of lengths a and e: what is left is equal for some choice of both just where few edits part them."""
    one = lambda n: [(i,) for i in range(n)]
    two = lambda n: list(combinations(range(n), 2))
    wild = lambda n, k: [(i, k if k < i else k + 1) for i in range(n)]
    if a == e:
        # The same places changed; with two edits also one left out on each side.
        yield from (([x], [x]) for x in ([()] if not a else one(a) if edits == 1 or a == 1 else two(a)))
        if edits == 2 and a:
            yield one(a), one(e)
    elif abs(a - e) == 1:
        # A character more, and with two edits one place changed.
        yield (one(a), [()]) if a > e else ([()], one(e))
        if edits == 2:
            yield from ((wild(a, k), [(k,)]) if a > e else ([(k,)], wild(e, k)) for k in range(min(a, e)))
    elif abs(a - e) == 2 and edits == 2:
        yield (two(a), [()]) if a > e else ([()], two(e))


class _Side:
    """Numbers of one side by length: their rows, groups and a column of character ids for each place."""

    def __init__(self, group: np.ndarray, letters: np.ndarray, size: np.ndarray):
        start = np.cumsum(size) - size
        self.rows = {int(n): np.flatnonzero(size == n) for n in np.unique(size)}
        self.group = {n: group[r] for n, r in self.rows.items()}
        self.places = {n: [letters[start[r] + i] for i in range(n)] for n, r in self.rows.items()}

    def columns(self, n: int, out: tuple[int, ...]) -> list[np.ndarray]:
        return [self.group[n], *[x for i, x in enumerate(self.places[n]) if i not in out]]


def _folded(columns: list[np.ndarray], letters: int) -> np.ndarray:
    key = columns[0].astype(np.int64)
    for x in columns[1:]:
        key *= letters
        key += x
    return key


def _met(a: Callable, e: Callable, index: np.ndarray, size: int, rows: int, none: int) -> np.ndarray:
    """The least index of an equal key of e for each key of a, over all choices; keys are below size."""
    if size <= 4 * rows + 4096:
        table = np.full(size, none, np.int64)
        for keys in e():
            np.minimum.at(table, keys, index)
        found = [table[keys] for keys in a()]
    else:
        keys = np.concatenate(list(e()))
        at = np.tile(index, len(keys) // len(index))
        order = np.lexsort((at, keys))
        keys, at = keys[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, at = keys[first], at[first]
        found = []
        for own in a():
            i = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            found.append(np.where(keys[i] == own, at[i], none))
    return np.minimum.reduce(found)


def least_within(a_group: np.ndarray, a: pa.Array, e_group: np.ndarray, e: pa.Array, edits: int) -> np.ndarray:
    """For each number of a the least place in e of one of its group within one or two edits, else the length of e."""
    none = len(e)
    best = np.full(len(a), none, np.int64)
    if not len(a) or not len(e):
        return best
    text = [np.frombuffer("".join(x.to_pylist()).encode("utf-32-le"), np.uint32) for x in (a, e)]
    size = [pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, e)]
    used = np.zeros(1 + max((int(x.max()) for x in text if len(x)), default=0), bool)
    for x in text:
        used[x] = True
    ids, letters = (np.cumsum(used) - 1).astype(np.int32), max(1, int(used.sum()))
    groups = 1 + int(max(a_group.max(), e_group.max()))
    left, right = (_Side(g, ids[x], n) for g, x, n in zip((a_group, e_group), text, size, strict=True))
    for m, at in left.rows.items():
        for n, index in right.rows.items():
            for out_a, out_e in _pairs(m, n, edits):
                over = groups * letters ** (m - len(out_a[0]))
                if over < 1 << 62:
                    keys_a = lambda m=m, out=out_a: (_folded(left.columns(m, x), letters) for x in out)
                    keys_e = lambda n=n, out=out_e: (_folded(right.columns(n, x), letters) for x in out)
                else:
                    # Too long for a whole number: the rows of all choices are numbered together.
                    both = [np.stack(s.columns(k, x), 1).astype(np.int32) for s, k, out in ((left, m, out_a), (right, n, out_e)) for x in out]
                    whole = np.ascontiguousarray(np.concatenate(both))
                    ranks = np.unique(whole.view(f"V{whole.shape[1] * 4}").ravel(), return_inverse=True)[1]
                    over, cut = len(whole), np.split(ranks, np.cumsum([len(x) for x in both])[:-1])
                    keys_a, keys_e = (lambda k=cut[: len(out_a)]: k), (lambda k=cut[len(out_a) :]: k)
                best[at] = np.minimum(best[at], _met(keys_a, keys_e, index, over, len(at) * len(out_a) + len(index) * len(out_e), none))
    return best


def _part(n: Column) -> Column:
    """Characters of the parts of a number of n characters: with two edits at most one of its three parts is not touched."""
    return F.least(F.lit(BLOCK), F.floor(n / 3).cast("int"))


def _named(size: Column, text: Column) -> Column:
    return F.concat_ws(".", size.cast("string"), text)


def own_block(number: Column, at: str) -> Column:
    """The first, middle or last part of a number and its length, which a partner has to share."""
    n, h = F.length(number), _part(F.length(number))
    start = {"first": F.lit(1), "middle": F.floor((n - h) / 2).cast("int") + 1, "last": n - h + 1}[at]
    return _named(n if at == "middle" else h, F.substring(number, start, h))


def partner_blocks(number: Column, at: str, lengths: Column) -> Column:
    """The blocks in which a number may meet one of the lengths given.

    A number within two edits shares the first part, or the last one, counted from the end, or one edit is in the
    first part and one in the last one: then the middle part is there, moved by one place at most.
    """
    n = F.length(number)

    def of(own: Column) -> Column:
        h = _part(own)
        if at == "first":
            return F.array(_named(h, F.substring(number, F.lit(1), h)))
        if at == "last":
            return F.array(_named(h, F.substring(number, F.greatest(n - h + 1, F.lit(1)), h)))
        start = F.floor((own - h) / 2).cast("int") + 1
        moves = F.filter(F.array(*[F.lit(s) for s in (-1, 0, 1)]), lambda s: F.abs(n - own - s) <= 1)
        return F.transform(moves, lambda s: _named(own, F.substring(number, start + s, h)))

    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda own: F.abs(own - n) <= 2), of)))


def step(left: DataFrame, right: DataFrame, head: Callable, number: Callable, any_head: bool) -> DataFrame:
    """left (code, rank, reference) with the first of what it has and the rows of right (rank, reference) in the same __bucket.

    Rows match within two edits under equal heads, with ``any_head`` within one edit as well. A task has both sides of
    a bucket at a time. Rows go out by code: neighbours are alike, and less is written.
    """
    tasks = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in left.columns if c != "__bucket"]

    def run(a: pa.Table, e: pa.Table) -> pa.Table:
        a = a.sort_by("code")
        e = e.filter(pc.and_(pc.is_valid(e["rank"]), pc.is_valid(e["__number"])))
        # Ranks of both sides in one order; what a code has already stands among them.
        every = pa.concat_tables([t.select(["rank", "reference"]) for t in ((a, e) if "rank" in kept else (e,))]).combine_chunks()
        order = pc.sort_indices(every, [("rank", "ascending"), ("reference", "ascending")]).to_numpy().astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        had = np.where(pc.is_valid(a["reference"]).to_numpy(), place[: len(a)], len(order)) if "rank" in kept else np.full(len(a), len(order))
        own = place[len(order) - len(e) :]
        by = np.argsort(own)
        e, own = e.take(pa.array(by)), np.append(own[by], len(order))
        text = [pc.fill_null(t["__number"], "").combine_chunks() for t in (a, e)]
        heads = pa.chunked_array([*a["__head"].chunks, *e["__head"].chunks], pa.string()).combine_chunks().dictionary_encode()
        group = pc.fill_null(heads.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        best = own[least_within(group[: len(a)], text[0], group[len(a) :], text[1], 2)]
        if any_head:
            best = np.minimum(best, own[least_within(np.zeros(len(a), np.int64), text[0], np.zeros(len(e), np.int64), text[1], 1)])
        best = np.minimum(np.where(pc.is_valid(a["__number"]).to_numpy(), best, len(order)), had)
        at = pa.array(np.append(order, 0)[best], mask=best == len(order))
        return pa.table({"code": a["code"], **{c: every[c].combine_chunks().take(at) for c in ("rank", "reference")}})

    schema = f"code string, rank {right.schema['rank'].dataType.simpleString()}, reference string"
    a, e = (df.repartition(tasks, "__bucket").withColumns({"__head": head(c), "__number": number(c)}).groupBy("__bucket") for df, c in ((left, "code"), (right, "reference")))
    return a.cogroup(e).applyInArrow(run, schema)
