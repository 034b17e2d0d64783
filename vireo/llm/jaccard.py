"""Exact Jaccard join of shingle sets in metric space.

Jaccard distance is a metric, so a pivot's distances bound those between documents. Two documents without a common
shingle lie at distance 1 from each other and from every pivot, where no bound helps; most pairs are such. So the
pivots work inside families that an exact filter has found. No step loses a link.

1. *Families.* Linked sets differ in few shingles. Shingles are dealt by hash into more parts than can differ, so linked
   sets agree on whole parts, and on one of the first few in a common order (see ``part_keys``). Keys travel packed by
   bucket, once; sets that share a key meet the smallest of them, and the components of these meetings are families.
   Long passages that documents share make families of unlike documents, so a family's members first compare
   sketches, whose distance never exceeds the true one: what is left are components of sets that may be linked.
2. *Regions.* A family above ``most_sets`` is cut by pivots: a member goes to its nearest pivot's Voronoi cell and, by
   the triangle inequality, into every cell whose pivot is at most ``2 (1 - t)`` farther: of two linked sets each is then
   in the other's home cell. Members linked with their pivot are joined at once; a cell whose members are all joined is
   finished. The others are regions of the next level, with pivots of their own. A region that its pivots don't cut
   meets in blocks, that region alone.
3. *Links.* Within a small region sketches rule out most pairs, the sets decide the rest. Members already joined aren't
   compared, so a region gives at most a link less than it has members.

Sets are known by 64-bit digests: among n sets, n^2 / 2^65 false meetings are expected. Keys and sets are dealt by 48
bits and more; two that coincide there share a family without need, and nothing else.
"""

from __future__ import annotations

import hashlib
import logging
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, give_back, passing, renamed, scratch, settled, table
from .graph import components
from .shingles import U, Words, common, mixed, shingle_sets

log = logging.getLogger(__name__)
RATIO = 1.5
#: Keys that a task holds before it packs them, and keys that a bucket should have.
HELD_KEYS, BUCKET_KEYS = 1 << 18, 1 << 19
#: Texts that become words at a time, and sets that a task knows again.
STEP, KNOWN_SETS = 64, 50_000
#: Sets, and shingles in them, whose sketches one task compares.
SLIM_SETS, SLIM_SHINGLES = 1024, 1 << 24
#: Sets are dealt by so many bits of their digest.
NODE = (1 << 48) - 1
#: Where keys have buckets enough, they meet a part after another, so that a part alone stands on disk twice.
PARTS, PARTED_BITS = 4, 7
#: Bits of a map of rows: at most 262,144 words, which are spread out.
SLOTS = 1 << 24


def level(n: int, num: int, den: int) -> int:
    """Sets of up to ``small`` shingles are level 0; then each level is half as wide again as the last.

    Below a similarity of 5/7 so much can differ that parts of several shingles prove nothing: all sets are level 0.
    """
    small = 16 if 10 * num >= 9 * den else 64
    return 0 if n <= small or 7 * num < 5 * den else int(np.log(n) / np.log(RATIO) + 1e-9)


def largest(at: int) -> int:
    """No set of the level is larger."""
    return int(RATIO ** (at + 1)) + 1


def part_keys(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys such that sets linked at similarity ``num / den`` share one.

    A set's shingles are dealt by hash into parts, and each part that isn't empty has a key made of its shingles; in
    level 0 each shingle is a part. Of two linked sets, at most ``n (den - num) / num`` parts of a set of n shingles have
    another key in the other set. So among its keys in one order of all keys, the smallest that both have is at most one
    place further, and only so many keys are kept. The number of parts, a tenth and a few more than can differ at the
    upper end of a level, hangs on the level alone; a set is dealt for its own level and for that of its largest partner.
    """
    n, out = len(shingles), []
    if not n:
        return np.empty(0, U)
    differ = n * (den - num) // num
    for at in sorted({level(n, num, den), level(n * den // num, num, den)}):
        x = mixed(shingles, 11 + at)
        if at:
            parts = 11 * largest(at) * (den - num) // (10 * num) + 5
            part = ((x >> U(32)) * U(parts)) >> U(32)
            order = np.argsort(part, kind="stable")
            part = part[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            x = mixed(np.add.reduceat(mixed(x, 5)[order], first) + mixed(part[first], at), 9)
        out.append(np.sort(x)[: differ + 1])
    return np.concatenate(out)


def set_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


# --- sketches --------------------------------------------------------------------------------------------------------


def sketch_words(n: int) -> int:
    """64-bit words of the sketch of a set of n shingles: two to four bits a shingle."""
    return min(1024, max(8, 1 << (n // 32).bit_length()))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the counts of hash buckets: one shingle more or less changes one bit."""
    width = sketch_words(len(shingles))
    bit = (mixed(shingles, 21) & U(64 * width - 1)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=64 * width).astype(np.uint8) & 1, bitorder="little").view("<u8")


def folded(one: np.ndarray, words: int) -> np.ndarray:
    """The sketch that the set would have with fewer words: halves meet bit by bit."""
    while len(one) > words:
        one = one[: len(one) // 2] ^ one[len(one) // 2 :]
    return one


def spanning(
    size: np.ndarray,
    sketches: list[np.ndarray],
    num: int,
    den: int,
    linked: Callable[[int, int], bool] | None = None,
    root: np.ndarray | None = None,
    block: np.ndarray | None = None,
) -> list[tuple[int, int]]:
    """Pairs that join all linked sets, at most one less than there are sets.

    Pairs come to ``linked`` if size and sketch allow them; without it these count. ``root``: sets of equal value are
    joined already. ``block``: only pairs across two blocks.
    """
    order = np.argsort(size, kind="stable")
    n, out = size[order].astype(np.int64), []
    root = np.arange(len(n)) if root is None else np.unique(root[order], return_inverse=True)[1]
    side = None if block is None else block[order]
    widths = np.array([len(sketches[k]) for k in order], np.int64)
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        # Sizes are sorted: partners of a set are at most den / num larger. All meet at the smaller one's width.
        until = int(np.searchsorted(n, int(n[own[-1]]) * den // num, side="right"))
        at = np.stack([folded(sketches[k], int(width)) for k in order[own[0] : until]])
        for i in own.tolist():
            j = np.arange(i + 1, int(np.searchsorted(n, int(n[i]) * den // num, side="right")))
            j = j[root[j] != root[i]]
            if side is not None:
                j = j[side[j] != side[i]]
            if not len(j):
                continue
            apart = np.bitwise_count(at[j - own[0]] ^ at[i - own[0]]).sum(axis=1, dtype=np.int64)
            for k in j[apart * (den + num) <= (n[j] + n[i]) * (den - num)].tolist():
                if root[k] != root[i] and (linked is None or linked(int(order[i]), int(order[k]))):
                    out.append((int(order[i]), int(order[k])))
                    root[root == root[k]] = root[i]
    return out


def spanning_links(sets: list[np.ndarray], num: int, den: int, root: np.ndarray | None = None, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """``spanning`` for links proper."""

    def linked(a: int, b: int) -> bool:
        both = common(sets[a], sets[b])
        return den * both >= num * (len(sets[a]) + len(sets[b]) - both)

    return spanning(np.array([len(s) for s in sets], np.int64), [sketch(s) for s in sets], num, den, linked, root, block)


# --- families --------------------------------------------------------------------------------------------------------


def _packed(x: np.ndarray) -> bytes:
    """The lower 48 bits of each value."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with the same components, every node with the smallest of its own."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, up = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        x, y = up[u], up[v]
        if (x == y).all():
            break
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
    rest = up != np.arange(len(names))
    return names[rest], names[up[rest]]


def _met(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, each once with its smallest node, and ``stars`` of the nodes that share a key."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    least = nodes[new][np.cumsum(new) - 1]
    rest = nodes != least
    return keys[new], nodes[new], *stars(nodes[rest], least[rest])


_words = Words()
KEYED = "doc_id long, th long, n long, sid long, sketch binary, bucket long, keys binary, nodes binary"


def _keyed(docs: DataFrame, width: int, num: int, den: int, bits: int) -> DataFrame:
    """Rows of documents (doc_id, th, n, sid, sketch), and rows of packed keys (bucket, keys, nodes) or, with a null
    bucket, of meetings within the task (keys and nodes are both nodes).

    ``docs`` has doc_id, text and th, the text's hash. A copy of a set that the task has just had brings neither sketch
    nor keys; a key that a task has many times leaves it once, so a key of a third of all rows is no hot group.
    """
    names = [x.split()[0] for x in KEYED.split(", ")]
    types = [{"long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in KEYED.split(", ")]

    def rows(**given) -> pa.RecordBatch:
        n = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names=names)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, owners, count = [], [], 0

        def packs():
            keys, nodes, a, b = _met(np.concatenate(held), np.repeat(np.array(owners, U), [len(h) for h in held]))
            bucket = keys >> U(64 - bits)
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(keys)]
            spans = list(zip(cuts, cuts[1:], strict=False))
            yield rows(bucket=bucket[cuts[:-1]].astype(np.int64), keys=[_packed(keys[x:y]) for x, y in spans], nodes=[_packed(nodes[x:y]) for x, y in spans])
            if len(a):
                yield rows(keys=[_packed(a)], nodes=[_packed(b)])

        for batch in batches:
            text, sizes, sids, drawn = batch.column("text"), [], [], []
            for k in range(0, len(text), STEP):
                for s in shingle_sets(text.slice(k, STEP).to_pylist(), width, _words):
                    sid = set_id(s)
                    sizes.append(len(s))
                    sids.append(sid)
                    if sid in seen or not len(s):
                        drawn.append(None)
                        continue
                    seen.add(sid)
                    drawn.append(sketch(s).tobytes())
                    held.append(part_keys(s, num, den))
                    owners.append(sid & NODE)
                    count += len(held[-1])
                if count > HELD_KEYS:
                    yield from packs()
                    held, owners, count = [], [], 0
            yield rows(doc_id=batch.column("doc_id"), th=batch.column("th"), n=sizes, sid=sids, sketch=drawn)
            if len(seen) > KNOWN_SETS:
                seen.clear()
        if held:
            yield from packs()
        held, owners = [], []
        _words.empty()
        give_back()

    return docs.mapInArrow(make, KEYED)


def _meetings(packed: pa.Table) -> pa.Table:
    """Who shares a key in one bucket."""
    _, _, a, b = _met(*(_unpacked(packed.column(c).to_pylist()) for c in ("keys", "nodes")))
    return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64)})


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meetings that tasks found among their own keys."""
    for batch in batches:
        a, b = (_unpacked(batch.column(c).to_pylist()).astype(np.int64) for c in ("keys", "nodes"))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _banded(members: DataFrame, num: int, den: int, most_sets: int, most_shingles: int) -> DataFrame:
    """Families too large for a task, cut by size: linked sizes differ by a factor of at most den / num.

    The logarithm of the size is the distance to a pivot on a line. Bands are as wide as that factor; a member stands in
    its own and in that of its largest partner, so that two linked sets are together in the larger one's band.
    """
    load = members.groupBy("region").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles_in"))
    large = settled(load.where((F.col("sets") > most_sets) | (F.col("shingles_in") > most_shingles)).select("region"), "large")
    band = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(den / num)) + 1e-9)
    n = F.col("n")
    cut = members.join(large, "region").withColumn("band", F.explode(F.sequence(band(n), band(F.floor(n * den / num)))))
    return members.join(large, "region", "left_anti").union(cut.select(F.xxhash64("region", "band").alias("region"), *members.columns[1:]))


def _by_blocks(members: DataFrame, most_sets: int, most_shingles: int, link: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``link`` over each region; one too large for a task is dealt into blocks that meet pairwise.

    Members of one block meet in its own task; elsewhere only pairs across the two blocks count.
    """
    load = members.groupBy("region").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles_in"))
    tasks = F.ceil(F.greatest(F.col("sets") / most_sets, F.col("shingles_in") / most_shingles)).cast("int")
    load = load.select("region", F.greatest(tasks, F.lit(1)).alias("tasks"))
    at = members.join(load, "region").withColumn("block", F.pmod(F.xxhash64("sid", F.lit("block")), F.col("tasks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("tasks") - 1)
    pairs = F.transform(other, lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    met = at.withColumn("p", F.explode(pairs)).select("region", *members.columns[1:], "block", "p.i", "p.j")
    return met.groupBy("region", "i", "j").applyInPandas(link, "a long, b long")


def _pairs(sid: np.ndarray, found: list[tuple[int, int]]) -> pd.DataFrame:
    """What was found, as pairs that are joined by one round of ``components``."""
    at = np.array(found, np.int64).reshape(-1, 2)
    a, b = stars(sid[at[:, 0]], sid[at[:, 1]])
    return pd.DataFrame({"a": a, "b": b}, dtype="int64")


def _blocks_of(pdf: pd.DataFrame) -> np.ndarray | None:
    return pdf["block"].to_numpy() if pdf["block"].nunique() > 1 else None


def _alike(num: int, den: int):
    """Pairs whose sketches allow a link."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        drawn = [np.frombuffer(x, "<u8") for x in pdf["sketch"]]
        return _pairs(pdf["sid"].to_numpy(), spanning(pdf["n"].to_numpy(), drawn, num, den, block=_blocks_of(pdf)))

    return link


# --- regions ---------------------------------------------------------------------------------------------------------


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8").astype(U, copy=False)


def _linked(num: int, den: int):
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        found = spanning_links([_set(x) for x in pdf["shingles"]], num, den, pdf["root"].to_numpy(), _blocks_of(pdf))
        return _pairs(pdf["sid"].to_numpy(), found)

    return link


def _cut(num: int, den: int):
    """Members of a chunk to their nearest pivot and to all at most 2 (1 - num/den) farther, by id.

    A row per placement: region, sid, cell, and the pivot's sid where the member is linked with it.
    """

    def place(key: tuple, members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        points = [_set(x) for x in pivots["shingles"]] or [np.empty(0, U)]  # without a pivot the region stays one
        ids = pivots["sid"].tolist() or [None]
        names = [hash((int(key[0]), p)) & 0x7FFFFFFFFFFFFFFF if p is not None else int(key[0]) for p in ids]
        sizes, rows = np.array([len(p) for p in points], np.int64), []
        for sid, n, data in members[["sid", "n", "shingles"]].itertuples(index=False):
            s = _set(data)
            both = np.array([common(s, p) for p in points], np.int64)
            union = n + sizes - both
            far = 1 - both / np.maximum(1, union)
            for k in np.flatnonzero(far <= far.min() + 2 * (den - num) / den + 1e-9).tolist():
                rows.append((key[0], sid, names[k], ids[k] if den * both[k] >= num * union[k] and ids[k] not in (None, sid) else None))
        return pd.DataFrame(rows, columns=["region", "sid", "cell", "pivot"]).astype({"pivot": "Int64"})

    return place


def links(
    members: DataFrame, num: int, den: int, most_sets: int = 32, most_shingles: int = 1_000_000, levels: int = 6, pivots: int = 32, block_sets: int = 2048, block_shingles: int = 4_000_000
) -> DataFrame:
    """(a, b): pairs that join all linked members of each region (region, sid, n, shingles).

    A region of more than ``most_sets`` sets or ``most_shingles`` shingles is cut by about ``pivots`` pivots (a quarter
    of its sets, if these are fewer), for up to ``levels`` levels. Blocks of at most about ``block_sets`` sets and ``block_shingles`` shingles are for a region that
    pivots don't cut: its largest open cell keeps more than 0.7 of it, or its cells hold eight times its sets.
    """
    found, region, columns = [], members.withColumn("root", F.col("sid")), ["region", "sid", "n", "shingles", "root"]
    for depth in range(levels + 1):
        load = region.groupBy("region").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles_in"))
        load = settled(load.where((F.col("sets") > most_sets) | (F.col("shingles_in") > most_shingles)), "regions")
        small = region.join(load, "region", "left_anti").withColumn("block", F.lit(0))
        found.append(settled(small.groupBy("region").applyInPandas(_linked(num, den), "a long, b long"), "links"))
        if load.isEmpty():
            break
        chunks = F.ceil(F.greatest(F.col("sets") / block_sets, F.col("shingles_in") / block_shingles)).cast("int") * 4
        here = region.join(load.select("region", "sets", chunks.alias("chunks")), "region")
        if depth == levels:
            found.append(settled(_by_blocks(here.select(columns), block_sets, block_shingles, _linked(num, den)), "links"))
            break
        # Pivots are drawn by hash; chunks of a region meet all its pivots apart.
        chunk = F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int")
        drawn = F.pmod(F.xxhash64("sid", F.lit(depth)), F.lit(1 << 40)) < F.lit(1 << 40) * F.least(F.lit(0.25), F.lit(float(pivots)) / F.col("sets"))
        points = here.where(drawn).select("region", "sid", "shingles", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        points = settled(points, "pivots")
        own = here.select("region", "sid", "n", "shingles", chunk.alias("chunk"))
        cut = own.groupBy("region", "chunk").cogroup(points.groupBy("region", "chunk"))
        placed = settled(cut.applyInPandas(_cut(num, den), "region long, sid long, cell long, pivot long"), "placed")
        met = placed.where("pivot IS NOT NULL").select(F.col("sid").alias("a"), F.col("pivot").alias("b")).distinct()
        found.append(met)
        joined = components(met.union(here.where("root != sid").select("sid", "root")))
        joined = joined.select(F.col("node").alias("sid"), "component")
        placed = placed.select("region", "sid", "cell").join(joined, "sid", "left").withColumn("root", F.coalesce("component", "sid")).drop("component")
        placed = settled(placed, "placed")
        cells = placed.groupBy("region", "cell").agg(F.count(F.lit(1)).alias("held"), F.min("root").alias("low"), F.max("root").alias("high"))
        cells = settled(cells.where("low != high").select("region", "cell", "held"), "cells")
        load = load.select("region", "sets")
        stubborn = cells.groupBy("region").agg(F.max("held").alias("most"), F.sum("held").alias("all")).join(load, "region")
        stubborn = settled(stubborn.where("most > 0.7 * sets OR all > 8 * sets").select("region"), "stubborn")
        if log.isEnabledFor(logging.INFO):  # each count is a job
            log.info(
                "level %d: %d sets of %d regions placed %d times; %d cells open with %d places, %d regions uncut",
                depth, here.count(), load.count(), placed.count(), cells.count(), cells.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0], stubborn.count(),
            )
        roots = placed.select("region", "sid", "root").distinct()
        uncut = here.drop("root").join(stubborn, "region", "left_semi").join(roots, ["region", "sid"]).select(columns)
        found.append(settled(_by_blocks(uncut, block_sets, block_shingles, _linked(num, den)), "links"))
        open_cells = cells.join(stubborn, "region", "left_anti").select("region", "cell")
        if open_cells.isEmpty():
            break
        region = placed.join(open_cells, ["region", "cell"]).join(here.drop("root"), ["region", "sid"])
        region = settled(region.select(F.col("cell").alias("region"), "sid", "n", "shingles", "root"), "open")
    return reduce(DataFrame.union, found)


# --- the join --------------------------------------------------------------------------------------------------------


def _mapped(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` (doc_id and th among others) with ``__hit``, which is false only for rows that aren't among ``rows`` (doc_id, th).

    So texts needn't be shuffled to be told from a few others. Beyond some ten million ``rows`` most are hits.
    """
    at = F.pmod(F.xxhash64("doc_id", "th"), F.lit(SLOTS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    word = F.floor(at / 64).alias("__word")
    words = settled(rows.select(word, bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits")), "words")
    found = docs.withColumn("__word", F.floor(at / 64)).join(F.broadcast(words), "__word", "left")
    return found.withColumn("__hit", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__word", "__bits")


def _members(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """region, sid, n and the set of one text for each wanted (doc_id, th, sid, region)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k in range(0, len(texts), 256):
                sets, part = shingle_sets(texts[k : k + 256], width, _words), batch.slice(k, 256)
                same = pa.array([set_id(s) == sid for s, sid in zip(sets, part.column("sid").to_pylist(), strict=True)])
                made = pa.RecordBatch.from_arrays(
                    [part.column("region"), part.column("sid"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["region", "sid", "n", "shingles"],
                )
                yield made.filter(same)
        _words.empty()
        give_back()

    w = wanted.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "sid", "region")
    likely = _mapped(docs, wanted).where("__hit")
    near = likely.join(w, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))).select("text", "sid", "region")
    return near.mapInArrow(make, "region long, sid long, n long, shingles binary").dropDuplicates(["region", "sid"])  # a row may occur twice


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and the hash of the text; id and hash together name a row, up to rows that are equal."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def joined_sets(docs: DataFrame, width: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", **limits) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n, sid) for each row of ``docs``, and (sid, component) for each set with a shingle.

    A component's name is a set's. ``th`` is the hash of the text.
    """
    spark, d = docs.sparkSession, _documents(docs, id_col, text_col)
    bits = min(24, max(6, math.ceil(math.log2(1 + d.count() * 256 / BUCKET_KEYS))))
    path = scratch(spark, "keyed")
    parts = PARTS if bits >= PARTED_BITS else 1
    part = F.when(F.col("bucket").isNotNull(), F.col("bucket") % parts).otherwise(-1).cast("int")
    _keyed(d, width, num, den, bits).withColumn("part", part).write.partitionBy("part").parquet(path)
    keyed = spark.read.schema(f"{KEYED}, part int").parquet(path)
    found = keyed.where("part = -1 AND keys IS NOT NULL").select("keys", "nodes").mapInArrow(_found, "a long, b long")
    met = []
    for k in range(parts):
        packed = keyed.where(F.col("part") == k).select("bucket", "keys", "nodes")
        met.append(settled(packed.groupBy("bucket").applyInArrow(_meetings, "a long, b long"), "met"))
        discard(spark, f"{path}/part={k}")
    edges = reduce(DataFrame.union, [*met, found])
    family = components(edges).select(F.col("node"), F.col("component").alias("region"))
    node = F.col("sid").bitwiseAND(F.lit(NODE)).alias("node")
    own = keyed.where("part = -1 AND sid IS NOT NULL")
    sized = settled(own.select("doc_id", "th", "n", "sid"), "sized")
    slim = own.where("sketch IS NOT NULL").select("sid", "n", "sketch", node).join(family, "node").select("region", "sid", "n", "sketch")
    slim = settled(slim.dropDuplicates(["region", "sid"]), "slim")
    discard(spark, path)
    alike = _by_blocks(_banded(slim, num, den, SLIM_SETS, SLIM_SHINGLES), SLIM_SETS, SLIM_SHINGLES, _alike(num, den))
    alike = components(alike)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    sets = settled(sized.where("n > 0").groupBy("sid").agg(first), "sets")
    wanted = alike.select(F.col("node").alias("sid"), F.col("component").alias("region")).join(sets, "sid").select("first.doc_id", "first.th", "sid", "region")
    near = settled(_members(d, wanted, width), "members")
    joined = components(links(near, num, den, **limits)).select(F.col("node").alias("sid"), "component")
    return sized, sets.select("sid").join(joined, "sid", "left").select("sid", F.coalesce("component", "sid").alias("component"))


def _first(*more: str) -> Column:
    """The smallest row: by id, null ids last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *more)).alias("first")


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs``.

    Words are what stands between ASCII blanks, A-Z lower-cased; a document's set has its distinct shingles of ``width``
    words, or all its words as one if there are fewer. Two rows link when ``den`` x intersection >= ``num`` x union;
    component_id is the smallest doc_id that links reach. Null or blank text has an empty set and is a component of its
    own. Each row is a document: rows that repeat an id each have the component of their own text, and rows with a null
    id link like others. A null id names a component only where all its ids are null. Other columns are ignored.
    """
    with passing(docs.sparkSession) as keep:
        sized, sets = joined_sets(docs, width, num, den, id_col, text_col, **limits)
        rows = keep(settled(sized.where("n > 0").join(sets, "sid").select("doc_id", "n", "component"), "rows"))
        keep(sized)
    name = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(name, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(sized.where("n = 0").select("doc_id", F.col("n"), F.col("doc_id")))


def without_near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs``, all columns, that stand first in their component (see ``jaccard_components``).

    First is the smallest id, null ids last, then the smallest hash of the text; of rows that have both in common one
    stays. Rows without words all stay.
    """
    docs, own_names = renamed(docs, id_col, text_col)
    with passing(docs.sparkSession) as keep:
        sized, sets = joined_sets(docs, width, num, den, **limits)
        full = settled(sized.where("n > 0").join(sets, "sid").select("doc_id", "th", "component"), "rows")
        first = full.groupBy("component").agg(_first("th")).select("component", F.col("first.doc_id").alias("id"), F.col("first.th").alias("h"))
        rows = full.join(first, "component").select("doc_id", "th", (F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h"))).alias("stays"))
        verdict = rows.groupBy("doc_id", "th").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("rows"))
        verdict = keep(settled(verdict.where("NOT stays OR rows > 1").select("doc_id", "th", "stays"), "verdict"))
    own = F.struct(*(F.col(c) for c in docs.columns)).alias("own")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"), own)
    named = _mapped(named, verdict)
    verdict = verdict.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "stays")
    row = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
    once = named.where("NOT __hit").select("own.*").union(named.where("__hit").join(verdict, row, "left_anti").select("own.*"))
    again = verdict.where("stays")
    if again.isEmpty():
        return own_names(once)
    twice = named.where("__hit").join(again.drop("stays"), row).dropDuplicates(["__id", "__th"])
    return own_names(once.union(twice.select("own.*")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays (see ``without_near_duplicates``): five words, similarity 0.8.

    Null and empty texts stay; a component of rows without ids keeps one of them; an empty table stays empty.
    """
    return without_near_duplicates(docs)


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP5_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(r, q) AS (SELECT r, r FROM n UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.q),
named AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.q GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN named USING (r)
"""
