"""Alignment of two tokenizers' tokens over the same bytes.

Offsets at which tokens of both end cut a document into groups; inside a group every token of one is linked with every
token of the other. A byte range of a document is a *fragment*: a prefix whose group began before the range, closed
groups, and a suffix whose group goes on. Fragments compose, and composing is associative: the suffix of one and the prefix
of the next close a group together. So a very long document is cut into byte ranges, which go to tasks of their own,
and a tree of Spark reductions composes them, ``FAN`` neighbours at a time.

Neither tokenizer's tokens cross a space between two characters that aren't blank, so the words of a text are fragments
without open ends, and tokens of words that repeat are remembered (see ``pieces``). A byte range may end inside a word: both
neighbours tokenize that word, and each takes the tokens that end in its own range.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, settled, table
from .pieces import Memory

#: Bytes of a range; a word of more than ``LONG`` bytes isn't cut.
RANGE, LONG, FAN = 16_384, 2048, 8
#: Documents and bytes of text at a time, words that are tokenized as one text, and words that are remembered, in each of two generations.
BATCH, BATCH_BYTES, ROW, WORDS = 512, 1 << 20, 1024, 120_000
#: Pairs of ids whose counts every task knows; rarer ones are joined.
KNOWN = 2_000_000
#: Bits of an id in a pair; with fewer than 2^11 documents at a time, document and pair are one number.
BITS = 26
#: Marks the second tokenizer's ids among remembered values, and words whose bytes don't come back. Larger groups than ``SMALL`` links are counted by their different ids.
SECOND, BAD, SMALL = np.uint32(1 << 31), np.uint32(0xFFFFFFFF), 64


def words(text: str) -> list[str]:
    """``text`` cut at each space that stands between characters that aren't blank; joined by spaces they are the text."""
    out: list[str] = []
    for p in text.split(" "):
        if out and out[-1] and p and not out[-1][-1].isspace() and not p[0].isspace():
            out.append(p)
        elif out:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def grouped(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int]) -> Iterator[tuple[list[int], list[int]]]:
    """Tokens between common ends; those after the last one come last."""
    i = j = from_a = from_b = 0
    while i < len(a) and j < len(b):
        if a_ends[i] == b_ends[j]:
            i, j = i + 1, j + 1
            yield a[from_a:i], b[from_b:j]
            from_a, from_b = i, j
        elif a_ends[i] < b_ends[j]:
            i += 1
        else:
            j += 1
    if from_a < len(a) or from_b < len(b):
        yield a[from_a:], b[from_b:]


def said(a: list[int], b: list[int]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def link(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The id pairs of a group, and how many occurrences each links."""
    left, m = np.unique(np.array(a, np.int64), return_counts=True)
    right, n = np.unique(np.array(b, np.int64), return_counts=True)
    return (left[:, None] << BITS | right).ravel(), (m[:, None] * n).ravel()


def added(links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and their numbers, each pair once."""
    if not links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, code = np.unique(np.concatenate([p for p, _ in links]), return_inverse=True)
    return pairs, np.bincount(code, np.concatenate([t for _, t in links]), len(pairs)).astype(np.int64)


@dataclass
class Fragment:
    """``cut``: whether a common end lies in it; if not, all its tokens are in the prefix. ``groups`` are closed ones, written; ``links`` theirs."""

    ok: bool = True
    cut: bool = False
    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    groups: list[str] = field(default_factory=list)
    n_groups: int = 0
    n_a: int = 0
    n_b: int = 0
    links: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def close(self, a: list[int], b: list[int]) -> None:
        if a or b:
            self.groups.append(said(a, b))
            self.n_groups += 1
            self.links.append(link(a, b))

    def then(self, other: Fragment) -> Fragment:
        """This range followed by the next."""
        out = Fragment(self.ok and other.ok, self.cut or other.cut, n_a=self.n_a + other.n_a, n_b=self.n_b + other.n_b)
        middle = lambda x, y: (x[0] + y[0], x[1] + y[1])
        out.groups, out.n_groups, out.links = list(self.groups), self.n_groups, list(self.links)
        if not self.cut:
            out.prefix = middle(self.prefix, other.prefix)
            out.suffix = other.suffix
        elif not other.cut:
            out.prefix, out.suffix = self.prefix, middle(self.suffix, other.prefix)
        else:
            out.close(*middle(self.suffix, other.prefix))
            out.prefix, out.suffix = self.prefix, other.suffix
        out.groups += other.groups
        out.n_groups += other.n_groups
        out.links += other.links
        return out

    def whole(self) -> Fragment:
        """Of a whole document: what is open at either end is a group."""
        return Fragment(cut=True).then(self).then(Fragment(cut=True))


def fragment(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int], start: int, end: int) -> Fragment:
    """Of the tokens that end in (start, end]."""

    def between(x: int, y: int) -> list[list[int]]:
        return [[v for v, e in zip(values, ends, strict=True) if x < e <= y] for ids, ends in ((a, a_ends), (b, b_ends)) for values in (ids, ends)]

    own_a, ends_a, own_b, ends_b = between(start, end)
    both = set(ends_a) & set(ends_b)
    out = Fragment(cut=bool(both), n_a=len(own_a), n_b=len(own_b))
    if not both:
        out.prefix = own_a, own_b
        return out
    first, last = min(both), max(both)
    out.prefix, out.suffix = tuple(between(start, first)[::2]), tuple(between(last, end)[::2])
    for x, y in grouped(*between(first, last)):
        out.close(x, y)
    return out


@dataclass
class Aligned:
    """Documents in a row: for each whether it has tokens, their numbers, and the groups' text; and all pairs in order of documents."""

    fine: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    text: list[str]
    ends: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def cut_words(text: str) -> list[str]:
    """The same as ``words``, each with the space before it."""
    first, *rest = words(text)
    return [first, *(" " + w for w in rest)]


class Aligner:
    """The two tokenizers of a worker process, and the words it remembers."""

    def __init__(self, tokenizer: str, pieces: str, remember: int = WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer)
        self.tok.encode_special_tokens = True
        self.sp = SentencePieceProcessor(model_file=pieces)
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        byte_of = _byte_alphabet()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        self.b_bytes = [_piece_bytes(self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        ids = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        # What stands for a token in the groups' text: the id and what follows it.
        self.written = pa.array([i + c for c in ",|,;" for i in ids])
        self.many = len(ids)
        self.memory = Memory(self._each, remember, fill_after=self._after, cut=cut_words)

    def _first(self, text: str) -> list[int]:
        """Ids of the first tokenizer; its fast way leaves offsets out, which follow from the tokens' bytes."""
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def tokens(self, w: str) -> tuple[list[int], list[int], list[int], list[int]] | None:
        """Ids and ends of both tokenizers for a space and a word; none if the bytes aren't those of the word."""
        a, b = self._first(" " + w), self.sp.encode(w)
        data = (" " + w).encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return a, np.cumsum(self.a_size[a]).tolist(), b, np.cumsum(self.b_size[b]).tolist()

    def _each(self, parts: list[str]) -> list[bytes]:
        """Values of parts that start at a space: ids of the first tokenizer, then those of the second, marked."""
        out = []
        for p in parts:
            found = self.tokens(p[1:]) if p else ([], [], [], [])
            out.append(BAD.tobytes() if found is None else np.array(found[0], np.uint32).tobytes() + (np.array(found[2], np.uint32) | SECOND).tobytes())
        return out

    def _after(self, keys: list[str]) -> list[bytes]:
        """The same for words: many stand in a row and are tokenized as one text, cut where they end."""
        out: list[bytes] = []
        for k in range(0, len(keys), ROW):
            row = keys[k : k + ROW]
            text = " ".join(row)
            data = (" " + text).encode()
            until = np.cumsum(1 + np.fromiter(map(len, row if text.isascii() else map(str.encode, row)), np.int64, len(row)))
            sides = []
            for ids, names, size in ((self._first(" " + text), self.a_bytes, self.a_size), (self.sp.encode(text), self.b_bytes, self.b_size)):
                ids = np.array(ids, np.uint32)
                ends = np.cumsum(size[ids])
                cut = np.searchsorted(ends, until, side="right")
                if b"".join(map(names.__getitem__, ids.tolist())) != data or (ends[cut - 1] != until).any():
                    break
                sides.append((ids, [0, *(4 * cut).tolist()]))
            if len(sides) < 2:
                out += self._each([" " + w for w in row])
                continue
            (a, x), (b, y) = sides
            a, b = a.tobytes(), (b | SECOND).tobytes()
            out += [a[x[i] : x[i + 1]] + b[y[i] : y[i + 1]] for i in range(len(row))]
        return out

    def documents(self, texts: pa.Array) -> Aligned:
        """Texts, each taken with a space before it; empty ones have no tokens."""
        n = len(texts)
        full = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        values = self.memory.arrays(pc.binary_join_element_wise("", texts, " "))
        data = np.frombuffer(b"".join(values), np.uint32)
        doc = np.repeat(np.arange(n), np.fromiter(map(len, values), np.int64, n) // 4)
        fine = full & (np.bincount(doc, data == BAD, n) == 0)
        keep = fine[doc]
        data, doc = data[keep], doc[keep]
        second = data >= SECOND
        a, doc_a, b, doc_b = data[~second].astype(np.int64), doc[~second], (data[second] ^ SECOND).astype(np.int64), doc[second]
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # Documents have the same bytes in both, so ends stand beside each other across all of them.
        a_cut, b_cut = (x[np.minimum(np.searchsorted(x, y), max(0, len(x) - 1))] == y if len(x) else np.zeros(0, bool) for x, y in ((b_ends, a_ends), (a_ends, b_ends)))
        of_a, of_b = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        groups = int(a_cut.sum())
        size_a, size_b, group_doc = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups), doc_a[a_cut]
        from_b = np.cumsum(size_b) - size_b
        small = size_a * size_b <= SMALL
        each = np.where(small, size_b, 0)[of_a]
        at = np.repeat(from_b[of_a] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
        key = np.repeat(doc_a << 2 * BITS | a << BITS, each) | b[at]
        key, times = np.unique(key, return_counts=True)
        if not small.all():
            from_a, more = np.cumsum(size_a) - size_a, [(key, times)]
            for g in np.flatnonzero(~small).tolist():
                pairs, n_times = link(a[from_a[g] : from_a[g] + size_a[g]], b[from_b[g] : from_b[g] + size_b[g]])
                more.append((pairs | int(group_doc[g]) << 2 * BITS, n_times))
            key, times = added(more)
        place_a, place_b = np.arange(len(a)) + from_b[of_a], np.arange(len(b)) + np.cumsum(size_a)[of_b]
        code, owner = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        code[place_a], code[place_b] = a + self.many * a_cut, b + self.many * (2 + b_cut.astype(np.int64))
        owner[place_a], owner[place_b] = doc_a, doc_b
        offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
        text = pc.binary_join(pa.ListArray.from_arrays(offsets, self.written.take(pa.array(code))), "").to_pylist()
        count = lambda of, weights=None: np.bincount(of, weights, n).astype(np.int64)
        ends = np.searchsorted(key >> 2 * BITS, np.arange(1, n + 1))
        return Aligned(fine, count(doc_a), count(doc_b), count(group_doc), count(group_doc, size_a * size_b), [t[:-1] for t in text], ends, key & ((1 << 2 * BITS) - 1), times)


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones as they are, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece[:3] == "<0x" and piece[5] == ">":
        return bytes([int(piece[3:5], 16)])
    return piece.replace("\u2581", " ").encode()


_aligners: dict[tuple, Aligner] = {}


def aligner(tokenizer: str, pieces: str) -> Aligner:
    if (tokenizer, pieces) not in _aligners:
        _aligners[tokenizer, pieces] = Aligner(tokenizer, pieces)
    return _aligners[tokenizer, pieces]


_DOCUMENT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_FRAGMENT = (
    "row long, number long, doc_id long, ok boolean, cut boolean, pa array<int>, pb array<int>, sa array<int>, sb array<int>, groups string, n_groups long, n_a long, n_b long, "
    "pairs array<long>, times array<long>"
)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in schema.split(", "))])


def _finished(rows: pa.Array, ids: pa.Array, found: Aligned) -> pa.RecordBatch:
    """Rows of documents; those without tokens have zeros."""
    digests = [hashlib.sha256(t.encode()).hexdigest() if ok and n else "" for t, ok, n in zip(found.text, found.fine.tolist(), found.n_a.tolist(), strict=True)]
    offsets = pa.array(np.concatenate([[0], found.ends]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (found.pairs, found.times)]
    return pa.RecordBatch.from_arrays([rows, ids, *(pa.array(x) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)), pa.array(digests, pa.string()), *lists], schema=_arrow(_DOCUMENT))


def _portions(batch: pa.RecordBatch, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``BATCH`` rows and about ``BATCH_BYTES``."""
    ends, a = np.cumsum(size), 0
    while a < batch.num_rows:
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BATCH_BYTES, side="right"))
        b = min(max(a + 1, b), a + BATCH, batch.num_rows)
        yield batch.slice(a, b - a)
        a = b


def short_documents(docs: DataFrame, tokenizer: str, pieces: str) -> DataFrame:
    """Documents of at most ``RANGE`` bytes, finished in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(tokenizer, pieces)
        for batch in batches:
            for part in _portions(batch, pc.binary_length(batch.column("text").fill_null("")).to_numpy()):
                yield _finished(part.column("row"), part.column("doc_id"), own.documents(part.column("text").fill_null("")))
        give_back()

    return docs.mapInArrow(run, _DOCUMENT)


def ranges(lengths: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """Byte ranges over words of these lengths: number, first and last word that overlap it (the last excluded), and where it starts and ends in the window of these words."""
    ends = np.cumsum(lengths)
    start, number, total = 0, 0, int(ends[-1])
    while start < total:
        end = min(total, start + RANGE)
        last = int(np.searchsorted(ends, end, side="left"))
        if lengths[last] > LONG:
            end = int(ends[last])
        first = int(np.searchsorted(ends, start, side="right"))
        offset = int(ends[first] - lengths[first])
        yield number, first, last + 1, start - offset, end - offset
        start, number = end, number + 1


def cut_documents(docs: DataFrame) -> DataFrame:
    """A row for each byte range of a document: the words that overlap it, and where it starts and ends among their bytes."""
    schema = "row long, number long, doc_id long, words array<string>, start long, end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                ws = words(text)
                for number, first, last, start, end in ranges([1 + len(w.encode()) for w in ws]):
                    yield pa.RecordBatch.from_pylist([{"row": row, "number": number, "doc_id": doc_id, "words": ws[first:last], "start": start, "end": end}], _arrow(schema))

    return docs.mapInArrow(run, schema)


def range_fragments(own: Aligner, rows: list[tuple[list[str], int, int]]) -> list[Fragment]:
    """Of byte ranges, each given by the words that overlap it, its start and its end among their bytes.

    Words wholly inside a range come from memory, those of all ranges at once; words at its ends give the tokens that end inside.
    """
    split = []
    for ws, start, end in rows:
        lengths = [1 + len(w.encode()) for w in ws]
        inner, ahead, behind, until = [], [], [], 0
        for w, n in zip(ws, lengths, strict=True):
            from_, until = until, until + n
            if from_ >= start and until <= end:
                inner.append(w)
            else:
                (behind if from_ >= start else ahead).append((w, start - from_, end - from_))
        split.append((ahead, " ".join(inner) if inner else None, behind))
    found = own.documents(pa.array([text or "" for _, text, _ in split], pa.string()))

    def partial(parts: list) -> Fragment:
        f = Fragment()
        for w, x, y in parts:
            tokens = own.tokens(w)
            f = f.then(Fragment(ok=False) if tokens is None else fragment(*tokens, max(0, x), y))
        return f

    out = []
    for k, (ahead, text, behind) in enumerate(split):
        f = partial(ahead)
        if text is not None:
            x, y = found.ends[k - 1] if k else 0, found.ends[k]
            n_groups, n_a, n_b = (int(v[k]) for v in (found.n_groups, found.n_a, found.n_b))
            f = f.then(Fragment(bool(found.fine[k]), True, groups=[found.text[k]] if n_groups else [], n_groups=n_groups, n_a=n_a, n_b=n_b, links=[(found.pairs[x:y], found.times[x:y])]))
        out.append(f.then(partial(behind)))
    return out


def _row_of(row: int, number: int, doc_id: int | None, f: Fragment) -> pa.RecordBatch:
    pairs, times = added(f.links)
    values = {
        "row": row, "number": number, "doc_id": doc_id, "ok": f.ok, "cut": f.cut, "pa": f.prefix[0], "pb": f.prefix[1], "sa": f.suffix[0], "sb": f.suffix[1], "groups": ";".join(f.groups),
        "n_groups": f.n_groups, "n_a": f.n_a, "n_b": f.n_b,
    }
    schema, one = _arrow(_FRAGMENT), pa.array([0, len(pairs)], pa.int32())
    return pa.RecordBatch.from_arrays([*(pa.array([values[n]], schema.field(n).type) for n in schema.names[:-2]), pa.ListArray.from_arrays(one, pa.array(pairs)), pa.ListArray.from_arrays(one, pa.array(times))], schema=schema)


def _of_rows(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[dict, Fragment]]:
    """Fragments of rows, with row, number and doc_id."""
    slim = rows.select(_arrow(_FRAGMENT).names[:-2]).to_pylist()
    for k, r in enumerate(slim):
        links = tuple(np.asarray(rows.column(c)[k].values.to_numpy(zero_copy_only=False), np.int64) for c in ("pairs", "times"))
        yield r, Fragment(r["ok"], r["cut"], (r["pa"], r["pb"]), (r["sa"], r["sb"]), [r["groups"]] if r["groups"] else [], r["n_groups"], r["n_a"], r["n_b"], [links])


def fragments(chunks: DataFrame, tokenizer: str, pieces: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(tokenizer, pieces)
        for batch in batches:
            for k in range(0, batch.num_rows, 32):
                rows = batch.slice(k, 32).to_pylist()
                for r, f in zip(rows, range_fragments(own, [(r["words"], r["start"], r["end"]) for r in rows]), strict=True):
                    yield _row_of(r["row"], r["number"], r["doc_id"], f)
        give_back()

    return chunks.mapInArrow(run, _FRAGMENT)


def composed(level: DataFrame) -> DataFrame:
    """One level of the tree: ``FAN`` neighbours become one fragment."""

    def merge(group: pa.Table) -> pa.Table:
        rows = sorted(_of_rows(group.combine_chunks()), key=lambda x: x[0]["number"])
        first, out = rows[0]
        for _, f in rows[1:]:
            out = out.then(f)
        return pa.Table.from_batches([_row_of(first["row"], first["number"] // FAN, first["doc_id"], out)])

    return level.withColumn("up", F.floor(F.col("number") / FAN)).groupBy("row", "up").applyInArrow(merge, _FRAGMENT)


def long_documents(docs: DataFrame, tokenizer: str, pieces: str) -> DataFrame:
    """Documents of more than ``RANGE`` bytes: ranges are dealt anew, their fragments composed by a tree."""
    level = settled(fragments(cut_documents(docs).repartition("row", "number"), tokenizer, pieces), "fragments")
    most = level.agg(F.max("number")).first()[0] or 0
    while most > 0:
        level, most = composed(level), most // FAN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, f in _of_rows(batch):
                f = f.whole() if f.ok else Fragment()
                pairs, times = added(f.links)
                one = lambda v: np.array([v], np.int64)
                own = Aligned(np.array([f.ok]), one(f.n_a), one(f.n_b), one(f.n_groups), one(times.sum()), [";".join(f.groups)], one(len(pairs)), pairs, times)
                yield _finished(pa.array([r["row"]], pa.int64()), pa.array([r["doc_id"]], pa.int64()), own)

    return level.mapInArrow(run, _DOCUMENT)


def aligned(docs: DataFrame, tokenizer: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document, written out: numbers of tokens, groups and links, the groups' digest, and its linked id pairs (A's id in the high half) with their links."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return settled(short_documents(d.where(size <= RANGE), tokenizer, pieces).unionByName(long_documents(d.where(size > RANGE), tokenizer, pieces)), "alignments")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and whether no other pair of its A id is in more."""
    n = settled(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    a = F.shiftright("pair", BITS)
    most = n.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return settled(n.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def weighed(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``found`` with n_best and count_sum. Tasks know the counts of at most ``KNOWN`` pairs, the most frequent; what they don't know is joined."""
    spark = found.sparkSession
    scale = F.floor(F.log2("n"))
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(scale.alias("s")).agg(F.count(F.lit(1))).collect()), reverse=True)  # a row for each power of 2
    least, held = 1 << 62, 0
    for s, n in sizes:
        if held + n > KNOWN:
            break
        held, least = held + n, 1 << s
    top = counts.where(F.col("n") >= least).toArrow() if held else None
    order = np.argsort(top["pair"].to_numpy()) if held else np.zeros(0, int)
    known = spark.sparkContext.broadcast(tuple(top[c].to_numpy()[order] for c in ("pair", "n", "best")) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)))
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<long>"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            own, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            size = batch.column("pairs").value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), size)
            at = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
            hit = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
            count, top = (n[at] * hit, best[at] & hit) if len(pairs) else (np.zeros(len(own), np.int64), hit)
            total = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(total[0], doc, times * top)
            np.add.at(total[1], doc, times * count)
            rest = [x[~hit] for x in (own, times, doc)]
            cut = np.searchsorted(rest[2], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in rest[:2]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _arrow(schema).names[:7]), pa.array(total[0]), pa.array(total[1]), *lists], schema=_arrow(schema))

    out = found.mapInArrow(look, schema)
    if held == sum(n for _, n in sizes):
        return out.drop("pairs", "times", "row")
    out = settled(out, "weighed")
    rare = out.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    met = rare.join(counts.where(F.col("n") < least), "pair")
    more = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("c"))
    both = out.join(more, "row", "left")
    return both.withColumns({c: F.col(c) + F.coalesce(x, F.lit(0)) for c, x in (("n_best", "b"), ("count_sum", "c"))}).select(*[c for c in out.columns if c not in ("row", "pairs", "times")])


def align_documents(docs: DataFrame, tokenizer: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    A null or empty text, and one that either tokenizer doesn't give back byte for byte, has zeros and an empty digest
    column and links nothing. Rows that repeat an id, or have none, are documents of their own, in counts too. An empty
    table has no rows. Columns of other names are not read.
    """
    found = aligned(docs, tokenizer, pieces, id_col, text_col)
    return weighed(found, pair_counts(found))


def op13_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between byte_bpe_50k and piece_bpe_32k over all documents; see ``align_documents`` for nulls, repeats and empty tables."""
    import public_tokenizers

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
