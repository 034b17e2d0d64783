"""Byte-level BPE with DuckDB inside each task: merges by a recursive query, decoding by ordered aggregation.

Spark deals the texts and shuffles nothing. In a task, texts fall apart into parts that repeat (see ``pieces``); the
pre-tokens of parts not seen before go to DuckDB as rows (word, position, token). The recursive query joins neighbours
with the merge table and contracts each word's leftmost pair of least rank until no word changes. Decoding joins
(document, position, token) rows with the vocabulary and aggregates their bytes in order.

DuckDB runs in memory, on one thread and without a spill folder, over a bounded number of rows at a time.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, give_back, table
from .pieces import Memory, Recent

#: Documents at a time: new words of more documents go to one query.
BATCH = 1024
#: Rows of tokens in a query. A longer document is decoded in slices.
ENCODE_ROWS, DECODE_ROWS = 200_000, 400_000
#: The same, documents first, where a task gives its room back: about 95 MB less for a worker, a third more time.
SMALL = (256, 100_000, 100_000)
#: A pre-token of more bytes would need as many rounds of the query as it has merges; a heap does the same merges.
LONG_WORD = 256

MERGE = """
WITH RECURSIVE s(k, i, id, done) AS (
  SELECT k, i, id, false FROM first_rows
  UNION ALL
  (WITH p AS MATERIALIZED (
     SELECT k, i, id, lead(id) OVER w AS following, lag(i) OVER w AS previous FROM s WHERE NOT done WINDOW w AS (PARTITION BY k ORDER BY i)),
   best AS (
     SELECT p.k, min((m.c::BIGINT << 32) | p.i) AS least FROM merges m JOIN p ON m.a = p.id AND m.b = p.following GROUP BY p.k)
   SELECT r.k, r.i, CASE WHEN r.i = (best.least & 4294967295) THEN (best.least >> 32)::INTEGER ELSE r.id END, best.k IS NULL
   FROM p r LEFT JOIN best ON best.k = r.k
   WHERE best.k IS NULL OR r.previous IS DISTINCT FROM (best.least & 4294967295))
)
SELECT k, i, id FROM s WHERE done ORDER BY k, i
"""
DECODE = "SELECT r.k, string_agg(v.hex, '' ORDER BY r.i) AS hex FROM id_rows r JOIN vocabulary v ON v.id = r.id GROUP BY r.k"


def _joined(values: list[tuple[bytes, str]]) -> tuple[bytes, str]:
    data, text = zip(*values, strict=True) if values else ((), ())
    return b"".join(data), ",".join(filter(None, text))


class Codec:
    """A rank file's encoder and decoder; one per worker process."""

    def __init__(self, path: str, pattern: str, words: int = 600_000, encode_rows: int = ENCODE_ROWS, decode_rows: int = DECODE_ROWS) -> None:
        """``words``: pre-tokens that are remembered, in each of two generations."""
        import duckdb
        import regex

        self.encode_rows, self.decode_rows = encode_rows, decode_rows
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "400MB", "temp_directory": ""})
        cuts = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        a, b, c = (pa.array(x, pa.int32()) for x in zip(*cuts, strict=True)) if cuts else (pa.array([], pa.int32()),) * 3
        self._table("merges", pa.table({"a": a, "b": b, "c": c}))
        self._table("vocabulary", pa.table({"id": pa.array(list(self.bytes_of), pa.int32()), "hex": [t.hex() for t in self.bytes_of.values()]}))
        self.words, self.memory = Recent(words), Memory(self._parts, words // 3)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _merged(self, words: list[bytes]) -> list[tuple[bytes, str]]:
        """Ids of each word, by the recursive query."""
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        k = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        i = (np.arange(len(k)) - np.repeat(starts, lengths)).astype(np.int32)
        rows = pa.table({"k": k, "i": i, "id": self.single[np.frombuffer(b"".join(words), np.uint8)]})
        self.db.register("first_rows", rows)
        found = self.db.execute(MERGE).fetchnumpy()
        self.db.unregister("first_rows")
        data, text = np.asarray(found["id"], "<u4").tobytes(), list(map(str, found["id"].tolist()))
        ends = np.searchsorted(found["k"], np.arange(len(words) + 1)).tolist()
        return [(data[4 * a : 4 * b], ",".join(text[a:b])) for a, b in zip(ends, ends[1:], strict=False)]

    def _long(self, word: bytes) -> tuple[bytes, str]:
        """The same merges with a heap of (rank, position), for a word of any length."""
        ids: list[int | None] = [int(self.single[b]) for b in word]
        size = [1] * len(word)
        before, after = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
        rank = lambda x: self.ranks.get(word[x : x + size[x] + size[after[x]]]) if after[x] < len(word) else None
        heap = [(r, x, 1, 1) for x in range(len(word) - 1) if (r := rank(x)) is not None]
        heapq.heapify(heap)
        while heap:
            r, x, left, right = heapq.heappop(heap)
            y = after[x]
            if ids[x] is None or size[x] != left or y >= len(word) or size[y] != right:
                continue
            ids[x], ids[y], size[x], after[x] = r, None, left + right, after[y]
            if after[x] < len(word):
                before[after[x]] = x
            for z in (before[x], x):
                if z >= 0 and (q := rank(z)) is not None:
                    heapq.heappush(heap, (q, z, size[z], size[after[z]]))
        found = [x for x in ids if x is not None]
        return np.array(found, "<u4").tobytes(), ",".join(map(str, found))

    def encode_words(self, words: list[str]) -> list[tuple[bytes, str]]:
        """Ids of each pre-token: as little-endian unsigned 32-bit integers, and in decimal, joined by commas."""
        raw = [w.encode() for w in words]
        out: list[tuple[bytes, str] | None] = [self._long(w) if len(w) > LONG_WORD else None for w in raw]
        group, rows = [], 0
        for x in [x for x, done in enumerate(out) if done is None] + [None]:
            if group and (x is None or rows + len(raw[x]) > self.encode_rows):
                for y, ids in zip(group, self._merged([raw[y] for y in group]), strict=True):
                    out[y] = ids
                group, rows = [], 0
            if x is not None:
                if raw[x]:
                    group.append(x)
                    rows += len(raw[x])
                else:
                    out[x] = (b"", "")
        return out

    def _parts(self, parts: list[str]) -> list[tuple[bytes, str]]:
        # Letters after a space, or alone, are one match of the pattern.
        split = [[p] if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()) else self.pattern.findall(p) for p in parts]
        new = self.words.unknown(set(chain.from_iterable(split)))
        self.words.now.update(zip(new, self.encode_words(new), strict=True))
        known = self.words.now
        return [known[s[0]] if len(s) == 1 else _joined([known[w] for w in s]) for s in split]

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids, in both forms."""
        return [_joined(values) for values in self.memory.values(texts)]

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """The bytes that each row of ids stands for."""
        cut = [(k, ids[a : a + self.decode_rows]) for k, ids in enumerate(rows) for a in range(0, len(ids), self.decode_rows)]
        out: list[list[bytes]] = [[] for _ in rows]
        group, size = [], 0
        for item in [*cut, None]:
            if group and (item is None or size + len(item[1]) > self.decode_rows):
                lengths = np.array([len(ids) for _, ids in group])
                flat = np.concatenate([ids for _, ids in group]).astype(np.int32)
                k = np.repeat(np.arange(len(group), dtype=np.int32), lengths)
                self.db.register("id_rows", pa.table({"k": k, "i": np.arange(len(flat), dtype=np.int32), "id": flat}))
                for x, text in self.db.execute(DECODE + " ORDER BY r.k").fetchall():
                    out[group[x][0]].append(bytes.fromhex(text))
                self.db.unregister("id_rows")
                group, size = [], 0
            if item is not None:
                group.append(item)
                size += len(item[1])
        return [b"".join(x) for x in out]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str, words: int = 600_000, *rows: int) -> Codec:
    if (path, pattern) not in _codecs:
        gc.set_threshold(1_000_000, 50, 1000)  # remembered values hold no cycles, and looking for some takes long
        _codecs[path, pattern] = Codec(path, pattern, words, *rows)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array) and ids_text (decimal, joined by commas), one row for each row of ``docs``.

    Null text is empty and has no ids. Text that isn't valid Unicode can't occur in a Spark string. Other columns are
    ignored; rows that repeat are encoded each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for k in range(0, len(texts), 256):
                found = own.encode(texts[k : k + 256])
                flat = np.frombuffer(b"".join(x for x, _ in found), "<u4").astype(np.int32)
                ends = np.cumsum([0, *(len(x) // 4 for x, _ in found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[k : k + 256], lists, pa.array([y for _, y in found])], names=["doc_id", "ids", "ids_text"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, ids_text string")


def decode_ids(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and decoded (binary) from doc_id and ids; a null array decodes to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [np.asarray(x.values.to_numpy() if x.is_valid else [], np.int32) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.decode(ids), pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", forget: bool = False) -> DataFrame:
    """Digests of encoding and decoding in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256 and whether the bytes came back.

    Null text is empty and has no ids; rows that repeat an id are encoded each, null ids are kept; an empty table gives no
    rows; other columns aren't read.

    ``forget``: a task remembers fewer words, has fewer rows in a query and gives the room back when it ends, for jobs whose other stages need it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, *rows = SMALL if forget else (BATCH, ENCODE_ROWS, DECODE_ROWS)
        own = codec(ranks, pattern, 200_000 if forget else 600_000, *rows)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for k in range(0, len(texts), step):
                found = own.encode(texts[k : k + step])
                back = own.decode([np.frombuffer(x, "<u4") for x, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[k : k + step],
                        pa.array([len(x) // 4 for x, _ in found], pa.int64()),
                        pa.array([hashlib.sha256(y.encode()).hexdigest() for _, y in found]),
                        pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                        pa.array([b == t.encode() for b, t in zip(back, texts[k : k + step], strict=True)]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same"],
                )
        if forget:
            own = found = back = None
            _codecs.clear()
            give_back()

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")


def _files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *_files()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: each row's token count and digests (see ``round_trip``)."""
    return round_trip(docs, *_files(), forget=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
