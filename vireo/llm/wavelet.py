"""Token ids as wavelet matrices, one compressed file per shard.

A shard holds whole documents in ascending id order. Its ids are stored as bit-planes, most significant first; after
each plane the sequence is dealt stably into those with a 0 and those with a 1. Planes are cut into blocks, each
compressed alone and listed with the ones before it, so that access, rank and select touch one block a plane.

File: ``WMX1``, length of the directory (8 bytes), directory (JSON, zlib), blocks.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, scratch, settled, table
from .files import fresh, reader, writer
from .pieces import Memory

MAGIC, BLOCK_BITS = b"WMX1", 1 << 17
END_ID = 2
#: Documents at a time, and parts that are tokenized as one text.
BATCH, ROW = 3072, 1024


def packed(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], level: int = 1) -> bytes:
    """The file of one shard."""
    n, squeeze = len(ids), zstandard.ZstdCompressor(level=level)
    bits = max(1, int(ids.max()).bit_length()) if n else 1
    seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    planes, blocks, at = [], [], 0
    for p in range(bits - 1, -1, -1):
        ones = (seq & seq.dtype.type(1 << p)) != 0
        plane = {"at": [], "len": [], "ones": []}
        before, raw = 0, np.packbits(ones, bitorder="little")
        for k in range(0, n, BLOCK_BITS):
            data = squeeze.compress(raw[k // 8 : (k + BLOCK_BITS) // 8].tobytes())
            plane["at"].append(at)
            plane["len"].append(len(data))
            plane["ones"].append(before)
            blocks.append(data)
            at += len(data)
            before += int(np.count_nonzero(ones[k : k + BLOCK_BITS]))
        plane["zeros"] = n - before
        planes.append(plane)
        held, mask = pa.array(seq), pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(raw)])
        seq = np.concatenate([held.filter(pc.invert(mask)).to_numpy(), held.filter(mask).to_numpy()])
    head = zlib.compress(json.dumps({"n": n, "bits": bits, "doc_ids": doc_ids, "lengths": lengths, "planes": planes}).encode())
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *blocks])


class Shard:
    """Reads a shard's file: single tokens, counts and places without decoding the rest, or the whole sequence."""

    def __init__(self, file) -> None:
        self.file = file
        if file.read(4) != MAGIC:
            raise ValueError("not a wavelet shard")
        size = int.from_bytes(file.read(8), "little")
        self.__dict__.update(json.loads(zlib.decompress(file.read(size))))
        self.base, self.kept = 12 + size, {}

    def _block(self, plane: int, k: int) -> np.ndarray:
        if (plane, k) not in self.kept:
            if len(self.kept) > 64:
                self.kept.clear()
            at, length = self.planes[plane]["at"][k], self.planes[plane]["len"][k]
            self.file.seek(self.base + at)
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read(length), max_output_size=BLOCK_BITS // 8), np.uint8)
            self.kept[plane, k] = np.unpackbits(raw, bitorder="little")
        return self.kept[plane, k]

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of the plane."""
        if i == 0:
            return 0
        k = (i - 1) // BLOCK_BITS
        return self.planes[plane]["ones"][k] + int(np.count_nonzero(self._block(plane, k)[: i - k * BLOCK_BITS]))

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value."""
        p = self.planes[plane]
        before = [x if bit else j * BLOCK_BITS - x for j, x in enumerate(p["ones"])]
        j = int(np.searchsorted(before, k, side="right")) - 1
        return j * BLOCK_BITS + int(np.flatnonzero(self._block(plane, j)[: self.n - j * BLOCK_BITS] == bit)[k - before[j]])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for q in range(self.bits):
            bit = int(self._block(q, i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self._ones(q, i)
            i = self.planes[q]["zeros"] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits:
            return 0, 0
        for q in range(self.bits):
            a, b = self._ones(q, start), self._ones(q, end)
            z = self.planes[q]["zeros"]
            start, end = (z + a, z + b) if token >> (self.bits - 1 - q) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, from 0."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for q in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - q) & 1
            i = self._select(q, bit, i - self.planes[q]["zeros"] if bit else i)
        return i

    def places(self, token: int) -> Iterator[int]:
        for k in range(self.count(token)):
            yield self.select(token, k)

    def decoded(self) -> np.ndarray:
        """The whole sequence: the dealing of each plane undone, from the last to the first."""
        seq = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        unpack = zstandard.ZstdDecompressor()
        for q in range(self.bits - 1, -1, -1):
            plane = self.planes[q]
            raw = b""
            if plane["at"]:
                self.file.seek(self.base + plane["at"][0])
                whole = self.file.read(sum(plane["len"]))
                starts = [a - plane["at"][0] for a in plane["at"]]
                raw = b"".join(unpack.decompress(whole[a : a + m], max_output_size=BLOCK_BITS // 8) for a, m in zip(starts, plane["len"], strict=True))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            out = np.empty_like(seq)
            out[~ones] = seq[: plane["zeros"]]
            out[ones] = seq[plane["zeros"] :] | seq.dtype.type(1 << (self.bits - 1 - q))
            seq = out
        return seq


_memories: dict[str, Memory] = {}


def encoder(path: str) -> Memory:
    """The tokenizer's memory of parts, one per worker process and file; values are little-endian unsigned 32-bit ids."""
    if path not in _memories:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        added = tuple(t.content for t in tok.get_added_tokens_decoder().values())
        vocabulary = tok.get_vocab(with_added_tokens=False)
        size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        size[list(vocabulary.values())] = [len(t) for t in vocabulary]  # byte-level: a character of the token is a byte

        def fill(texts: list[str]) -> list[bytes]:
            return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

        def fill_after(keys: list[str]) -> list[bytes]:
            """Parts in a row are tokenized as one text, and cut where their bytes end: no token crosses."""
            rows, out = [keys[k : k + ROW] for k in range(0, len(keys), ROW)], []
            joined = [" " + " ".join(row) for row in rows]
            for row, text, e in zip(rows, joined, tok.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.cumsum(1 + np.fromiter(map(len, row if text.isascii() else map(str.encode, row)), np.int64, len(row)))
                data, cut = ids.tobytes(), (4 * np.searchsorted(np.cumsum(size[ids]), ends, side="right")).tolist()
                out += [data[x:y] for x, y in zip([0, *cut], cut, strict=False)]
            return out

        _memories[path] = Memory(fill, 800_000, added, fill, fill_after)
    return _memories[path]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = 4 << 20) -> DataFrame:
    """Documents in ascending id order as shard files; one row per file: path, part, number in the part, ids.

    ``docs`` is dealt by ranges of (doc_id, hash of the text), so rows that repeat an id are spread too. A file closes
    at ``shard_ids`` ids, at a document's end; a longer document has a file of its own.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        held, names, lengths, total = [], [], [], 0

        def closed():
            path = fresh(folder, "ids", ".wmx")
            with writer(path) as out:
                out.write(packed(np.frombuffer(b"".join(held), "<u4"), names, lengths))
            return pa.RecordBatch.from_pydict({"path": [path], "part": [part], "number": [number], "ids": [total]})

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").fill_null("")
            for k in range(0, len(ids), BATCH):
                for doc_id, data in zip(ids[k : k + BATCH], memory.arrays(texts[k : k + BATCH]), strict=True):
                    data += end
                    held.append(data)
                    names.append(doc_id)
                    lengths.append(len(data) // 4)
                    total += lengths[-1]
                    if total >= shard_ids:
                        yield closed()
                        held, names, lengths, total, number = [], [], [], 0, number + 1
        if names:
            yield closed()

    d = documents(docs).withColumn("__tie", F.xxhash64("text"))
    d = d.repartitionByRange("doc_id", "__tie").sortWithinPartitions("doc_id", "__tie").drop("__tie")
    return settled(d.mapInArrow(write, "path string, part long, number long, ids long"), "wavelet-files")


def read_shards(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. A file's start is the ids of the files before it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with reader(path) as file:
                    shard = Shard(file)
                    ids = shard.decoded()
                ends = np.cumsum(np.asarray(shard.lengths, np.int64))
                crcs = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends.tolist(), shard.lengths, strict=True)]
                starts = start + ends - np.asarray(shard.lengths, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(starts), pa.array(shard.lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))  # a row per file
    dealt = placed.repartition(max(2, 4 * files.sparkSession.sparkContext.defaultParallelism), "path")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text is empty and so has the end id alone; null ids come first; an empty table writes no file."""
    import public_tokenizers

    files = write_shards(table(spark, sf_dir, "documents"), scratch(spark, "wavelet"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(files)
