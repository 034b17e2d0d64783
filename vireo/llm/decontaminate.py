"""Benchmark passages in documents within an edit distance: CGK random walks, bit-sampling LSH, exact verification.

The CGK embedding reads a sequence of words by a random walk: at step j it writes the current word and, as bit j of the
word's hash says, moves on or stays. Texts that differ in few edits give walks that meet again soon, so edit distance
becomes Hamming distance of what is written, and sampling a few steps gives a locality-sensitive key.

Items of ``CGK_LEAST`` words and more are sorted by length into classes of windows, at most half an item or eight words;
a class walks windows of its size at every fourth of that size through each document, counted from its first word, and
from every word of its items. A passage is found if any of its windows has an item's key under any of the independent
walks, of which there are as many as the target recall asks for at the greatest share of edited words that is accepted.
Wider windows would need many more walks (``walks_for``: 3 at 8 words, 7 at 16, 41 at 32, 1453 at 64, for 20 % of edited
words), so a long item has many windows instead of wide ones. Shorter items are cut into one piece more than the edits
they may have, one of which any accepted passage leaves whole: pieces are sought at every word, and none is missed. Each
meeting is then verified: the edit distance, in words, of the whole item to its best place in the document.

The benchmark is a query set, indexed in blocks of bounded size, a file each in the shared folder. The documents are
read once and never shuffled: a task walks a few of them and looks their keys up in one block after the other.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, renamed, scratch, table
from .files import fresh, reader, writer
from .shingles import U, Words, mixed, words_of

#: Items of a block, and bytes of their texts; a longer item is a block of its own.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 1 << 20
SAMPLED = 6
#: A key of fewer words says little and meets frequent words everywhere.
LEAST_READ = 3
CLASSES = (8, 16)
#: Shorter items are sought by exact pieces.
CGK_LEAST = 10
EDGES = bytes(range(0x21, 0x30)) + b":;<=>?@[\\]^_`{|}~"
FOUND = "doc_id long, item_id long, distance int, start_word long, end_word long"
MULTIPLIER = U(0x9E3779B97F4A7C15)


class PlainWords(Words):
    """Words without the ASCII punctuation at their ends."""

    def __missing__(self, word: bytes) -> int:
        plain = word.strip(EDGES) or word
        n = self[word] = self[plain] if plain != word else super().__missing__(word)
        return n


def walks_for(recall: float, edit_rate: float, size: int) -> int:
    """Walks so that a window read through about half its words, each edited with that chance, is met with that recall.

    A passage has at least two windows of its class that start within it; both count.
    """
    clean = (1 - edit_rate) ** (size / 2)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - clean) / 2))


def sampled_steps(size: int, walk: int) -> list[int]:
    rng = np.random.default_rng([size, walk])
    return sorted(rng.choice(size, min(SAMPLED, size), replace=False).tolist())


def walk_keys(words: np.ndarray, starts: np.ndarray, size: int, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """The sampled key of the walk from each start and the last place it read. ``words`` must go ``size`` beyond the last start."""
    turns, steps = mixed(words, 100 + walk), sampled_steps(size, walk)
    at, key, last = starts.astype(np.int64), np.full(len(starts), U(size * 64 + walk)), starts
    for j in range(steps[-1] + 1):
        if j in steps:
            key = (key ^ words[at]) * MULTIPLIER
            key ^= key >> U(31)
            last = at
        if j < steps[-1]:
            at = at + ((turns[at] >> U(j % 64)) & U(1)).astype(np.int64)
    return key, last


def piece_keys(words: np.ndarray, size: int) -> np.ndarray:
    """The key of the ``size`` words from each place; ``words`` must go ``size`` beyond the last place that counts."""
    key = np.full(len(words) - size, U(size * 64 + 63))
    for k in range(size):
        key = mixed(key ^ words[k : len(words) - size + k], k)
    return key


def pieces_of(n: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of ``edits`` + 1 pieces of n words: as many edits leave one whole."""
    cuts = [n * k // (edits + 1) for k in range(edits + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass
class Index:
    """A block of items by the keys of their windows, and of the pieces of short items."""

    item_ids: list[int | None]
    items: list[np.ndarray]
    walks: dict[int, int]
    pieces: list[int]
    keys: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    maybe: np.ndarray


def index_of(rows: list[tuple[int | None, str | None]], recall: float, edit_rate: float, max_edit_rate: float) -> Index:
    words = PlainWords()
    items = [words.of(words_of(t)) for _, t in rows]
    walks = {c: walks_for(recall, edit_rate, c) for c in CLASSES}
    keys, item, offset, used, sizes = [np.empty(0, U)], [np.empty(0, np.int32)], [np.empty(0, np.int32)], {}, set()

    def add(found: np.ndarray, k: int, at: np.ndarray) -> None:
        keys.append(found)
        item.append(np.full(len(found), k, np.int32))
        offset.append(at.astype(np.int32))

    for k, w in enumerate(items):
        if not len(w):
            continue
        if len(w) < CGK_LEAST:
            for at, size in pieces_of(len(w), int(max_edit_rate * len(w))):
                sizes.add(size)
                add(piece_keys(np.concatenate([w[at : at + size], np.zeros(1, U)]), size), k, np.array([at]))
            continue
        size = max([c for c in CLASSES if 2 * c <= len(w)], default=CLASSES[0])
        used[size] = walks[size]
        padded, starts = np.concatenate([w, np.zeros(size, U)]), np.arange(len(w))
        for r in range(walks[size]):
            key, last = walk_keys(padded, starts, size, r)
            inside = (last < len(w)) & (last - starts >= LEAST_READ - 1)
            add(key[inside], k, starts[inside])
    key, which, off = np.concatenate(keys), np.concatenate(item), np.concatenate(offset)
    order = np.argsort(key, kind="stable")
    maybe = np.zeros(1 << 22, bool)
    maybe[(key >> U(42)).astype(np.int64)] = True
    return Index([i for i, _ in rows], items, used, sorted(sizes), key[order], which[order], off[order], maybe)


class Texts:
    """The words of some documents in a row, and the keys of their windows, each made once."""

    def __init__(self, texts: list[str | None], words: Words) -> None:
        split = [words_of(t) for t in texts]
        size = np.array([len(s) for s in split], np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.flat = words.of([w for s in split for w in s])
        self.padded = np.concatenate([self.flat, np.zeros(max(*CLASSES, CGK_LEAST) + 1, U)])
        self.within = np.arange(len(self.flat)) - np.repeat(self.starts, size)
        self.end_of = np.repeat(self.ends, size)
        self.made: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def keys(self, size: int, walk: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of a class's windows under a walk, or with walk -1 of all pieces; none reads beyond its document."""
        if (size, walk) not in self.made:
            if walk < 0:
                at = np.flatnonzero(np.arange(len(self.flat)) + size <= self.end_of)
                key = piece_keys(self.padded[: len(self.flat) + size], size)[at]
            else:
                at = np.flatnonzero(self.within % max(1, size // 4) == 0)
                key, last = walk_keys(self.padded, at, size, walk)
                inside = last < self.end_of[at]
                at, key = at[inside], key[inside]
            self.made[size, walk] = at, key
        return self.made[size, walk]


def best_place(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of ``item`` to any stretch of ``text``, and where the first such stretch ends (bit-parallel)."""
    m, full = len(item), (1 << len(item)) - 1
    at: dict[int, int] = {}
    for k, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << k
    up, down, score, best = full, 0, m, (m, 0)
    for j, w in enumerate(text):
        eq = at.get(w, 0)
        x = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(x | up) & full, up & x
        score += (rise >> (m - 1) & 1) - (fall >> (m - 1) & 1)
        rise, fall, eq = rise << 1 & full, fall << 1 & full, eq | down
        up, down = fall | ~(eq | rise) & full, rise & eq
        if score < best[0]:
            best = (score, j + 1)
    return best


def _portions(n: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Stretches whose sum is about ``most``: a key that many items share is spread out a portion at a time."""
    ends, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        if ends[b - 1] > (ends[a - 1] if a else 0):
            yield a, b
        a = b


def passages(texts: Texts, index: Index, max_edit_rate: float) -> list[list[tuple[int, int, int, int]]]:
    """For each text its (item number, distance, first word, word after the last)."""
    met: list[np.ndarray] = []
    if len(texts.flat):
        for size, walk in [(c, r) for c, n in index.walks.items() for r in range(n)] + [(p, -1) for p in index.pieces]:
            at, key = texts.keys(size, walk)
            hit = np.flatnonzero(index.maybe[(key >> U(42)).astype(np.int64)])
            low, high = np.searchsorted(index.keys, key[hit], "left"), np.searchsorted(index.keys, key[hit], "right")
            places, n = at[hit], high - low
            for a, b in _portions(n):
                many = n[a:b]
                which = np.repeat(low[a:b] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                place = np.repeat(places[a:b], many)
                met.append(np.unique(np.column_stack([np.searchsorted(texts.ends, place, side="right"), index.item[which], place - index.offset[which]]), axis=0))
    out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts.ends]
    flat = texts.flat
    for doc, k, start in np.unique(np.concatenate(met), axis=0).tolist() if met else []:
        item, first, end = index.items[k], int(texts.starts[doc]), int(texts.ends[doc])
        known, m = out[doc].get(k), len(item)
        if known and (known[0] == 0 or known[1] <= start - first < known[2]):
            continue
        if start >= first and start + m <= end and np.array_equal(flat[start : start + m], item):
            out[doc][k] = (0, start - first, start - first + m)
            continue
        most = int(max_edit_rate * m)
        a, b = max(first, start - most), min(end, start + m + most)
        pattern, text = item.tolist(), flat[a:b].tolist()
        here = set(text)
        if sum(w not in here for w in pattern) > most:  # each such word needs an edit of its own
            continue
        distance, stop = best_place(pattern, text)
        if distance <= most and (not known or distance < known[0]):
            _, back = best_place(pattern[::-1], text[:stop][::-1])
            out[doc][k] = (distance, a - first + stop - back, a - first + stop)
    return [[(k, *v) for k, v in sorted(o.items())] for o in out]


_words = PlainWords()
_loaded: dict[str, tuple[Index, int]] = {}
#: Bytes of blocks that a worker process keeps.
KEPT_BYTES = 192 << 20


def _index(path: str, among: frozenset[str]) -> Index:
    """The index of a block. A worker keeps as many of ``among`` as ``KEPT_BYTES`` allow, the first that it met: blocks come
    round in the same order, so those are met again each time, and only the rest is read again."""
    if path in _loaded:
        return _loaded[path][0]
    for other in [p for p in _loaded if p not in among]:
        del _loaded[other]
    with reader(path) as file:
        data = file.read()
    index = pickle.loads(data)
    if sum(size for _, size in _loaded.values()) + len(data) <= KEPT_BYTES or not _loaded:
        _loaded[path] = index, len(data)
    return index


def item_blocks(benchmark: DataFrame, max_edit_rate: float, recall: float, edit_rate: float) -> list[str]:
    """Files of the index, one for each block of items; their paths are all that comes to the driver."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n, folder = max(1, math.ceil(size.n / BLOCK_ITEMS), math.ceil(size.bytes / BLOCK_BYTES)), scratch(benchmark.sparkSession, "items")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = [None if pd.isna(i) else int(i) for i in pdf["item_id"]]
        own = sorted(zip(ids, pdf["text"], strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        path = fresh(folder, "block", ".pickle")
        with writer(path) as out:
            out.write(pickle.dumps(index_of(own, recall, edit_rate, max_edit_rate)))
        return pd.DataFrame({"path": [path]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    made = dealt.groupBy("block").applyInPandas(build, "path string").collect()  # a row per block
    return sorted(r.path for r in made)


def _searched(texts: list[str | None], blocks: list[str], max_edit_rate: float, batch: int) -> Iterator[list[list[tuple]]]:
    """For a few texts at a time, what each holds: (item_id, distance, start, end)."""
    among = frozenset(blocks)
    for x in range(0, len(texts), batch):
        some = Texts(texts[x : x + batch], _words)
        found: list[list[tuple]] = [[] for _ in some.ends]
        for path in blocks:
            index = _index(path, among)
            for own, hits in zip(found, passages(some, index, max_edit_rate), strict=True):
                own += [(index.item_ids[k], *at) for k, *at in hits]
        yield found


def find_passages(docs: DataFrame, benchmark: DataFrame, max_edit_rate: float = 0.2, recall: float = 0.9, edit_rate: float | None = None, batch: int | None = None) -> DataFrame:
    """doc_id, item_id, distance, start_word, end_word: every item found in every row of ``docs``, at its best place.

    Words stand between ASCII blanks, A-Z lower-cased, without ASCII punctuation at their ends. An item is found where at
    most ``max_edit_rate`` of its words need editing; candidates are sought so that with a share ``edit_rate`` of words
    edited (``max_edit_rate`` if not given) at least ``recall`` are met. Items of fewer than ``CGK_LEAST`` words are
    all met. What is found in a row hangs on that row alone. Items without words are never found; items that repeat are
    found each. Null or empty texts hold nothing. Rows that repeat an id are searched each; null ids are kept. An empty
    benchmark or table gives no rows. Other columns are ignored.
    """
    blocks = item_blocks(benchmark, max_edit_rate, recall, max_edit_rate if edit_rate is None else edit_rate)
    step = batch or (256 if len(blocks) < 2 else 2048)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = pa.int64()
        for rows in batches:
            ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
            each = [hits for some in _searched(texts, blocks, max_edit_rate, step) for hits in some]
            found = [(d, *at) for d, hits in zip(ids, each, strict=True) for at in hits]
            d, i, e, a, b = zip(*found, strict=True) if found else ((),) * 5
            made = [pa.array(d, long), pa.array(i, long), pa.array(e, pa.int32()), pa.array(a, long), pa.array(b, long)]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "item_id", "distance", "start_word", "end_word"])
        _words.empty()
        give_back()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, FOUND)


def without_passages(docs: DataFrame, benchmark: DataFrame, max_edit_rate: float = 0.2, recall: float = 0.9, edit_rate: float | None = None, batch: int | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item (see ``find_passages``)."""
    docs, own_names = renamed(docs)
    blocks = item_blocks(benchmark, max_edit_rate, recall, max_edit_rate if edit_rate is None else edit_rate)
    step = batch or (256 if len(blocks) < 2 else 2048)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column("text").to_pylist()
            clean = [not hits for some in _searched(texts, blocks, max_edit_rate, step) for hits in some]
            yield rows.filter(pa.array(clean, pa.bool_()))
        _words.empty()
        give_back()

    return own_names(docs.mapInArrow(run, docs.schema))


def op8_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document, with at most a fifth of the item's words edited."""
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, all columns; null and empty texts stay, rows that repeat are judged each."""
    return without_passages(docs, table(spark, sf_dir, "benchmark"))
