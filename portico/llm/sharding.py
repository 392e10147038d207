"""Hierarchical weighted hash tree: a row descends region, rack and shard by weighted draws.

At a node every child draws ``-ln(u) / weight`` with ``u`` hashed from the key and the child's
name; the smallest draw wins. Raising one child's weight only lowers that child's draws, so rows
move into it and nowhere else, and a change inside one subtree leaves all others alone.

``default_tree(n)`` lays the first ``base`` shards out in full regions; every further shard is a
region of its own. So each shard added beyond ``base`` takes rows only into itself.

Defined cases: a null key draws as the text ``null``; repeated rows share a shard and get slots of
their own; an empty table gives an empty result; ``place`` gives a table of the key and the columns
named in ``ties`` with shard and slot, ignores further columns, and lets its own replace ones of their
name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Distinct rows of one numbering block, which one task sorts, and equal rows that it numbers at a time.
BLOCK_ROWS = 4096
#: Fixed value: hexadecimal digits of a draw, 48 bits.
DIGITS = 12


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def default_tree(n_shards: int, base: int = 40, racks: int = 2, per_rack: int = 4) -> list[Leaf]:
    wide = racks * per_rack
    return [
        Leaf(f"r{s // wide}", f"k{s % wide // per_rack}", s) if s < base else Leaf(f"x{s}", "k0", s)
        for s in range(n_shards)
    ]


def _grouped(leaves: list[Leaf], level: str) -> dict[str, list[Leaf]]:
    out: dict[str, list[Leaf]] = {}
    for leaf in leaves:
        out.setdefault(str(getattr(leaf, level)), []).append(leaf)
    return out


def _descend(key: Column, leaves: list[Leaf], levels: tuple[str, ...], path: str, seed: str) -> Column:
    """The shard of key under the node at path."""
    children = _grouped(leaves, levels[0])
    names = list(children)
    if len(names) == 1:
        won = F.lit(0)
    else:
        draws = []
        for i, name in enumerate(names):
            weight = sum(leaf.weight for leaf in children[name])
            digest = F.md5(F.concat(F.lit(f"{seed}/{path}/{name}/"), key))
            u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**DIGITS))
            draws.append(F.struct((-F.ln(u) / F.lit(float(weight))).alias("draw"), F.lit(i).alias("child")))
        won = F.least(*draws)["child"]
    if len(levels) == 1:
        shards = F.array(*[F.lit(children[name][0].shard) for name in names])
        return F.element_at(shards, won + F.lit(1))
    out = None
    for i, name in enumerate(names):
        below = _descend(key, children[name], levels[1:], f"{path}/{name}", seed)
        out = below if len(names) == 1 else (F.when if out is None else out.when)(won == i, below)
    return out


def shard_of(key: Column, tree: list[Leaf], seed: str = "tree") -> Column:
    """The shard in which the tree puts key."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return _descend(text, tree, ("region", "rack", "shard"), "", seed).cast("int")


def place(df: DataFrame, key: str, tree: list[Leaf], seed: str = "tree", ties: tuple[str, ...] = (), rows: int | None = None) -> DataFrame:
    """Key, ties, ``shard`` and ``slot``, the place in the shard, gapless from 0, of every row of df.

    Slots follow the digest of the key and ``ties``. Equal rows are counted first, so the rows that a
    hot key repeats are one row here; a shard's distinct rows are numbered in blocks of leading digest
    digits, so no task sorts a whole shard; block offsets come from counts. In the end a count becomes
    rows again, in parts of ``BLOCK_ROWS``.
    """
    rows = df.count() if rows is None else rows
    digits = 1
    while 16**digits * len(tree) * BLOCK_ROWS < rows:
        digits += 1
    names = [key, *ties]
    said = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in names]
    own = df.select(*names).withColumns({"shard": shard_of(F.col(key), tree, seed), "__digest": F.md5(F.concat_ws("/", *said))})
    values = own.groupBy("shard", "__digest", *names).agg(F.count("*").alias("__n")).withColumn("__block", F.substring("__digest", 1, digits))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        values.groupBy("shard", "__block").agg(F.sum("__n").alias("__rows"))
        .select("shard", "__block", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    )
    inside = Window.partitionBy("shard", "__block").orderBy("__digest", *names).rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn("__first", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    firsts = ranked.join(offsets, ["shard", "__block"]).select(*names, "shard", (F.col("__before") + F.col("__first")).alias("__at"), "__n")
    few = firsts.filter(F.col("__n") <= BLOCK_ROWS).select("*", F.lit(0).cast("long").alias("__part"))
    # Equal rows beyond a block: their parts go to tasks of their own.
    many = firsts.filter(F.col("__n") > BLOCK_ROWS).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {BLOCK_ROWS}"))).alias("__part"))
    many = many.repartition(*names, "__part")
    place_of = F.explode(F.expr(f"sequence(__at + __part * {BLOCK_ROWS}, __at + least(__n, (__part + 1) * {BLOCK_ROWS}) - 1)"))
    return few.unionAll(many).select(*names, "shard", place_of.alias("slot"))


def op9_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards, and where it would be with 41."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    placed = place(sized, "doc_id", default_tree(40), ties=("size", "text_crc32"), rows=docs.count())
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"),
        shard_of(F.col("doc_id"), default_tree(41)).alias("grown_shard"),
    )


def _sql_shard(n: int, name: str) -> str:
    """CTEs that walk the default tree of n shards: the last one, name, has k (a key's text) and shard."""
    tree, rows = default_tree(n), []
    seen: dict[str, float] = {}
    for leaf in tree:
        for path, child in (("", leaf.region), (f"/{leaf.region}", leaf.rack), (f"/{leaf.region}/{leaf.rack}", str(leaf.shard))):
            seen[f"{path}/{child}"] = seen.get(f"{path}/{child}", 0.0) + leaf.weight
    for full, weight in seen.items():
        path, _, child = full.rpartition("/")
        rows.append(f"('{path}', '{child}', {weight})")
    at = "(SELECT k, '' AS path FROM keys)"
    out = f"{name}_t(path, child, weight) AS (VALUES {', '.join(rows)})"
    for level in range(3):
        u = f"((('0x' || substr(md5('tree/' || p.path || '/' || t.child || '/' || p.k), 1, {DIGITS}))::BIGINT + 0.5) / {float(16**DIGITS)})"
        out += f", {name}_{level} AS (SELECT p.k, p.path || '/' || arg_min(t.child, -ln({u}) / t.weight) AS path FROM {at} p JOIN {name}_t t ON t.path = p.path GROUP BY p.k, p.path)"
        at = f"{name}_{level}"
    return out + f", {name} AS (SELECT k, CAST(split_part(path, '/', 4) AS INTEGER) AS shard FROM {name}_2)"


def _sql() -> str:
    # CRC-32 by its table of 256 values, one byte at a time.
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    value = "i"
    for _ in range(8):
        value = f"list_transform([{value}], lambda c: {step})[1]"
    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: {value}) AS t),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, encode(coalesce(text, '')) AS b, coalesce(octet_length(encode(text)), 0) + 16 AS size FROM documents),
c AS (SELECT doc_id, k, CAST(size AS BIGINT) AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda s, x: xor(s >> 8, t[xor(s & 255, x) + 1])), 4294967295) AS text_crc32 FROM d, crc),
keys AS (SELECT DISTINCT k FROM d), {_sql_shard(40, 'a')}, {_sql_shard(41, 'b')}
SELECT doc_id, size, text_crc32, 'key' AS law, a.shard,
  row_number() OVER (PARTITION BY a.shard ORDER BY md5(c.k || '/' || size || '/' || text_crc32), doc_id, size, text_crc32) - 1 AS slot, b.shard AS grown_shard
FROM c JOIN a ON a.k = c.k JOIN b ON b.k = c.k
"""


OP9_SQL = _sql()
