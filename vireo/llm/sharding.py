"""Hierarchical weighted hash tree: keys descend region, rack and shard by weighted hash draws.

At each level every child ``c`` with weight ``w`` draws ``-ln(u) / w``, where ``u`` in (0, 1) hashes the child's name
and the key; the smallest draw wins. A child's chance is its share of the weight, and when one child's weight
changes, only that child gains or loses keys. A node weighs what its shards weigh together, so a change of
topology moves keys only into or out of the subtrees whose weights changed. The law is ``key``: the key and the
topology decide, nothing else.

Only SQL functions are used. A row evaluates the children of one region and one rack, not the whole tree.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, settled, table

#: (shard, rack, region, weight)
Leaf = tuple[int, int, int, float]


def topology(shards: int, racks_of: int = 2, regions_of: int = 4, weights: dict[int, float] | None = None) -> list[Leaf]:
    """``shards`` leaves, ``racks_of`` to a rack and ``regions_of`` to a region, filled in order.

    From 8 to 9 shards the new one opens a region of its own, so that rows move only into it.
    """
    if shards < 1:
        raise ValueError("a tree needs at least one shard")
    return [(s, s // racks_of, s // regions_of, float((weights or {}).get(s, 1.0))) for s in range(shards)]


def _draw(kind: str, node: int, weight: float, key: Column) -> Column:
    """An exponential variate of rate ``weight``: 52 bits of a digest of node and key."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(kind), F.lit(str(node)), key)), 1, 13), 16, 10)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52)) / weight


def _least(kind: str, children: dict[int, float], key: Column) -> Column:
    """The child with the smallest draw; children of no weight get nothing."""
    live = {n: w for n, w in children.items() if w > 0}
    if not live:
        raise ValueError(f"no {kind} has weight")
    if len(live) == 1:
        return F.lit(next(iter(live)))
    return F.array_min(F.array(*(F.struct(_draw(kind, n, w, key).alias("d"), F.lit(n).alias("n")) for n, w in live.items())))["n"]


def _weights(leaves: list[Leaf], level: int) -> dict[int, float]:
    return {n: sum(x[3] for x in group) for n, group in groupby(sorted(leaves, key=lambda x: x[level]), key=lambda x: x[level])}


def _under(node: Column, leaves: list[Leaf], level: int, kind: str, child: int, key: Column) -> Column:
    """For each value of ``node``, the draw among its children."""
    cases = [(n, [x for x in leaves if x[level] == n]) for n, w in _weights(leaves, level).items() if w > 0]
    picks = [(n, _least(kind, _weights(own, child), key)) for n, own in cases]
    return reduce(lambda out, p: out.when(node == p[0], p[1]), picks[1:], F.when(node == picks[0][0], picks[0][1]))


def descend(df: DataFrame, key: Column, leaves: list[Leaf], shard: str = "shard") -> DataFrame:
    """``df`` with the column ``shard``. A null key counts as the empty string and so has one shard."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    region, rack = f"__{shard}_region", f"__{shard}_rack"
    out = df.withColumn(region, _least("region", _weights(leaves, 2), key))
    out = out.withColumn(rack, _under(F.col(region), leaves, 2, "rack", 1, key))
    return out.withColumn(shard, _under(F.col(rack), leaves, 1, "shard", 0, key)).drop(region, rack)


def numbered(df: DataFrame, shard: str, order: list[str], buckets: int = 1024, slot: str = "slot") -> DataFrame:
    """``df`` with a gapless number from 0 within each shard, without sorting a shard in one task.

    Rows go to ``buckets`` hash buckets of a shard; a bucket's first number is the count of the buckets before it
    (``shards x buckets`` rows), and only within a bucket are rows sorted. ``df`` should be cheap to read twice.
    """
    digest = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in order)))
    at = df.withColumn("__bucket", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets)
    counts = at.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(shard, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy(shard, "__bucket").orderBy(*order))
    return (
        at.withColumn("__within", within)
        .join(first, [shard, "__bucket"])
        .withColumn(slot, (F.col("__first") + F.col("__within") - 1).cast("long"))
        .drop("__bucket", "__first", "__within")
    )


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's size, checksum, shard, slot and the shard it would have with one more.

    Null or empty text has size 1 and checksum 0. Rows with a null id share the shard of the empty key. Repeated rows
    get the same shard and different slots. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = documents(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32")
    )
    slim = descend(slim, F.col("doc_id"), topology(shards), "shard")
    slim = descend(slim, F.col("doc_id"), topology(shards + 1), "grown_shard")
    slim = settled(slim, "shards")
    return numbered(slim, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int")
    )


def op2_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def _sql_draws(shards: int, name: str) -> str:
    """The descent in DuckDB: at each level the child of the least draw, for every node that has children."""

    def least(kind: str, children: dict[int, float]) -> str:
        bits = lambda n: f"('0x' || substr(md5('{kind}|{n}|' || key), 1, 13))::BIGINT::DOUBLE"
        draws = ", ".join(f"{{'d': -ln(({bits(n)} + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / {w}::DOUBLE, 'n': {n}}}" for n, w in children.items())
        return f"list_sort([{draws}])[1].n"

    leaves, out = topology(shards), "base"
    for level, child, kind in ((None, 2, "region"), (2, 1, "rack"), (1, 0, "shard")):
        parents = {None: leaves} if level is None else {n: [x for x in leaves if x[level] == n] for n in _weights(leaves, level)}
        picks = {n: least(kind, _weights(own, child)) for n, own in parents.items()}
        column = f"CASE {' '.join(f'WHEN node = {n} THEN {x}' for n, x in picks.items())} END" if level is not None else picks[None]
        out = f"(SELECT * EXCLUDE (node), {column} AS node FROM {out})" if level is not None else f"(SELECT *, {column} AS node FROM {out})"
    return f"{name} AS (SELECT * EXCLUDE (node), node::INTEGER AS {name}_of FROM {out})"


#: The checksum a byte at a time; its table follows from the polynomial.
_CRC = """
powers AS (SELECT list(c ORDER BY k) AS t FROM (SELECT range AS k, list_reduce(list_prepend(range, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256))),
bytes AS (SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
base AS (SELECT r, doc_id, size::BIGINT AS size, coalesce(doc_id::VARCHAR, '') AS key,
  xor(list_reduce(list_prepend(4294967295, list_transform(b, lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM bytes, powers)"""
OP2_SQL = f"""
WITH {_CRC.strip()},
{_sql_draws(8, "eight")},
{_sql_draws(9, "nine")}
SELECT e.doc_id, e.size, e.crc AS text_crc32, 'key' AS law, eight_of AS shard, nine_of AS grown_shard,
  row_number() OVER (PARTITION BY eight_of ORDER BY ('0x' || substr(md5(concat_ws('|', e.doc_id, e.crc, e.size)), 1, 8))::BIGINT % 1024, e.doc_id NULLS FIRST, e.crc, e.size) - 1 AS slot
FROM eight e JOIN nine n USING (r)
"""
