"""Subword lattice likelihood: the probability of a text, summed over every segmentation of its words.

An existing subword vocabulary gives the pieces and, by the rank that its scores hold, their first weights. Every word
is a lattice of arcs: pieces, bytes where a character is no piece, and, if training has seen it, the whole word. A
forward recursion in log space sums all its segmentations. A backward one gives expected uses, from which the pieces'
probabilities are estimated again over all distinct words of the training documents. The arc of a whole word has
absolutely discounted counts for a weight; what they lose is the weight of entering the pieces, so that

    P(w) = (max(c(w) - d, 0) + (d V + 1) (1 - e) P_pieces(w)) / (N + 1),   P(end) = (max(c(end) - d, 0) + (d V + 1) e) / (N + 1)

with e = 1/100. Pieces that start a word share a mass of 1; other pieces, bytes and the stop share another. So words and
the end add up to 1, less what the pieces give to bytes that spell no character or one that is a piece.

Counts are a Spark aggregate over all words of all documents, so what is gathered grows with the input. Scores are
made once per distinct word. Documents take those of the commonest words (a fixed number, short ones) from a broadcast
table; the other words of documents meet their scores in a join. Nothing else goes to the driver than the pieces'
expected uses and a row of totals.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, settled, table

#: Size of the broadcast table of words and the longest word in it, in bytes.
HEAD_WORDS, HEAD_BYTES = 150_000, 64
END_SHARE = 0.01
START = "▁"
NEVER = -1e300
#: Longer words, in characters, are summed one by one: few are of equal length.
LONG = 32


class Lattice:
    """Pieces with log probabilities (natural), and the recursions over words of equal length at once."""

    def __init__(self, pieces: list[str], log_p: np.ndarray, byte_log_p: np.ndarray, log_stop: float) -> None:
        self.pieces, self.log_p, self.byte_log_p, self.log_stop = pieces, np.asarray(log_p, float), np.asarray(byte_log_p, float), log_stop
        self.longest = max(map(len, pieces), default=1)
        self.starts = np.array([p.startswith(START) for p in pieces], bool)
        self.number = {p: k for k, p in enumerate(pieces)}
        self.prefixes = {p[:n] for p in pieces for n in range(1, len(p) + 1)}
        keys = np.zeros(len(pieces), np.uint64)
        for n in {len(p) for p in pieces}:
            at = [k for k, p in enumerate(pieces) if len(p) == n]
            codes = np.array([[ord(c) for c in pieces[k]] for k in at], np.uint64)
            h = np.zeros(len(at), np.uint64)
            for c in range(n):
                h = self._step(h, codes[:, c])
            keys[at] = h
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(keys >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h ^ code) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def _found(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        place = np.searchsorted(self.keys, h[at])
        place[place == len(self.keys)] = 0
        hit = self.keys[place] == h[at]
        out[at[hit]] = self.order[place[hit]]
        return out

    def _edges(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Piece numbers for every start and length that fits in some word."""
        edges, length = {}, codes.shape[1]
        for i in range(length):
            h = np.zeros(len(codes), np.uint64)
            for n in range(1, min(self.longest, length - i) + 1):
                h = self._step(h, codes[:, i + n - 1])
                k = self._found(h)
                k[self.starts[k] != (i == 0)] = -1  # a piece that starts a word does nothing else
                if (k >= 0).any():
                    edges[i, n] = k
        return edges

    def _bytes(self, codes: np.ndarray, i: int, missing: np.ndarray) -> np.ndarray:
        """Log probability of spelling the i-th character in bytes, where it is no piece itself."""
        out = np.full(len(codes), NEVER)
        for c in np.unique(codes[missing, i]):
            spelled = sum(self.byte_log_p[b] for b in chr(int(c)).encode("utf-8", "surrogatepass"))
            out[missing & (codes[:, i] == c)] = spelled
        return out

    def _weights(self, codes: np.ndarray):
        """For each start the arcs (length, piece numbers or None for bytes, log probability)."""
        edges, arcs = self._edges(codes), []
        for i in range(codes.shape[1]):
            single = edges.get((i, 1))
            missing = np.ones(len(codes), bool) if single is None else single < 0
            out = [(1, None, self._bytes(codes, i, missing))] if missing.any() else []
            out += [(n, k, np.where(k >= 0, self.log_p[k], NEVER)) for n in range(1, self.longest + 1) if (k := edges.get((i, n))) is not None]
            arcs.append(out)
        return arcs

    def _forward(self, codes: np.ndarray, arcs) -> list[np.ndarray]:
        alpha = [np.full(len(codes), NEVER) for _ in range(codes.shape[1] + 1)]
        alpha[0][:] = 0
        for i, out in enumerate(arcs):
            for n, _, w in out:
                alpha[i + n] = np.logaddexp(alpha[i + n], alpha[i] + w)
        return alpha

    @staticmethod
    def groups(words: list[str], most: int = 20_000) -> Iterator[tuple[list[int], np.ndarray]]:
        """Words of equal length up to ``LONG``, with their start mark, as codes."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) <= LONG:
                by.setdefault(len(w), []).append(k)
        for n, ks in by.items():
            for a in range(0, len(ks), most):
                part = ks[a : a + most]
                flat = np.frombuffer("".join(START + words[k] for k in part).encode("utf-32-le", "surrogatepass"), "<u4")
                yield part, flat.reshape(len(part), n + 1).astype(np.uint64)

    def _arcs(self, w: str, i: int) -> list[tuple[int, int | None, float]]:
        """The arcs that start at the i-th character: length, piece number or None for bytes, log probability."""
        out = []
        for n in range(1, min(self.longest, len(w) - i) + 1):
            part = w[i : i + n]
            if part not in self.prefixes:
                break
            k = self.number.get(part)
            if k is not None and self.starts[k] == (i == 0):
                out.append((n, k, float(self.log_p[k])))
        if not out or out[0][0] > 1:
            out.append((1, None, float(sum(self.byte_log_p[b] for b in w[i].encode("utf-8", "surrogatepass")))))
        return out

    def _long_forward(self, w: str) -> list[float]:
        """As ``_forward``, for one word with its start mark: a few microseconds a character."""
        alpha = [NEVER] * (len(w) + 1)
        alpha[0] = 0.0
        for i in range(len(w)):
            for n, _, weight in self._arcs(w, i):
                alpha[i + n] = _log_add(alpha[i + n], alpha[i] + weight)
        return alpha

    def log_marginal(self, words: list[str], enter: float = 0.0, whole: np.ndarray | None = None) -> np.ndarray:
        """Natural logarithm of each word's weight, the sum over its segmentations.

        ``enter``: logarithm of the weight of going through pieces; ``whole``: logarithm of the weight of each whole word's own
        arc, ``NEVER`` where it has none.
        """
        out = np.empty(len(words))
        for part, codes in self.groups(words):
            out[part] = self._forward(codes, self._weights(codes))[-1] + self.log_stop
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self._long_forward(START + w)[-1] + self.log_stop
        out += enter
        return out if whole is None else np.logaddexp(out, whole)

    def _long_expected(self, w: str, uses: np.ndarray, byte_uses: np.ndarray) -> None:
        alpha, beta = self._long_forward(w), [NEVER] * (len(w) + 1)
        beta[-1] = 0.0
        for i in range(len(w) - 1, -1, -1):
            for n, k, weight in self._arcs(w, i):
                beta[i] = _log_add(beta[i], weight + beta[i + n])
                share = math.exp(min(0.0, alpha[i] + weight + beta[i + n] - alpha[-1]))
                if k is not None:
                    uses[k] += share
                else:
                    for b in w[i].encode("utf-8", "surrogatepass"):
                        byte_uses[b] += share

    def expected(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of pieces and of bytes in the words, each word once."""
        uses, byte_uses = np.zeros(len(self.pieces)), np.zeros(256)
        for _, codes in self.groups(words):
            arcs = self._weights(codes)
            alpha = self._forward(codes, arcs)
            length = codes.shape[1]
            beta = [np.full(len(codes), NEVER) for _ in range(length + 1)]
            beta[length][:] = 0
            for i in range(length - 1, -1, -1):
                for n, k, w in arcs[i]:
                    beta[i] = np.logaddexp(beta[i], w + beta[i + n])
                    share = np.exp(np.minimum(0, alpha[i] + w + beta[i + n] - alpha[length]))
                    if k is not None:
                        uses += np.bincount(k[k >= 0], share[k >= 0], len(self.pieces))
                    else:
                        for c in np.unique(codes[share > 1e-12, i]):
                            total = share[codes[:, i] == c].sum()
                            for b in chr(int(c)).encode("utf-8", "surrogatepass"):
                                byte_uses[b] += total
        for w in words:
            if len(w) > LONG:
                self._long_expected(START + w, uses, byte_uses)
        return uses, byte_uses


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if a - b < 40 else a


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """The ordinary pieces of a sentencepiece file and their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    at = [k for k in range(sp.get_piece_size()) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
    at = [k for k in at if START not in sp.id_to_piece(k)[1:]]  # words have the mark at their start alone
    return [sp.id_to_piece(k) for k in at], np.array([sp.get_score(k) for k in at])


def first_lattice(path: str) -> Lattice:
    """Weights before any text is seen: the scores are negative ranks, and a piece of rank r weighs 1 / (r + 50)."""
    pieces, scores = vocabulary(path)
    rank = np.empty(len(scores))
    rank[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
    return _normalised(pieces, 1 / (rank + 50), np.full(256, 1e-4), 0.5)


def _normalised(pieces: list[str], uses: np.ndarray, byte_uses: np.ndarray, stops: float) -> Lattice:
    """Pieces that start a word add up to 1, and so do all others with the bytes and the stop."""
    starts = np.array([p.startswith(START) for p in pieces], bool)
    rest = uses[~starts].sum() + byte_uses.sum() + stops
    return Lattice(pieces, np.log(uses / np.where(starts, uses[starts].sum(), rest)), np.log(byte_uses / rest), float(np.log(stops / rest)))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _key(word: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(word)
    return x - (1 << 64) if x >> 63 else x


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes) and its count in training documents, 0 for words of held-out documents alone; counted per batch, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train: Counter = Counter()
            rest: set = set()
            for text, out in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist(), strict=True):
                (rest if out else train).update(_words(text))
            rest.difference_update(train)
            words = [*train, *rest]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([*train.values(), *[0] * len(rest)], pa.int64())], names=["word", "c"])

    return docs.select("text", "held_out").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def refined(counts: DataFrame, lattice: Lattice, rounds: int = 2) -> Lattice:
    """The pieces' probabilities by expectation and maximisation over the distinct training words, which stand for new ones."""
    spark = counts.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(lattice)  # as large as the vocabulary

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, uses, byte_uses, n = shared.value, 0, 0, 0  # noqa: B023
            for batch in batches:
                words = [w.decode("utf-8", "surrogatepass") for w in batch.column("word").to_pylist()]
                a, b = own.expected(words)
                uses, byte_uses, n = uses + a, byte_uses + b, n + len(words)
            if n:
                every = np.concatenate([uses, byte_uses, [n]])
                at = np.flatnonzero(every)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at])], names=["k", "uses"])

        rows = counts.where("c > 0").select("word").mapInArrow(expect, "k long, uses double").groupBy("k").agg(F.sum("uses").alias("uses")).collect()
        if not rows:
            return lattice
        every = np.full(len(lattice.pieces) + 257, 0.01)
        for r in rows:
            every[r.k] += r.uses
        lattice = _normalised(lattice.pieces, every[: len(lattice.pieces)], every[len(lattice.pieces) : -1], float(every[-1]))
    return lattice


def _commonest(scores: DataFrame) -> DataFrame:
    """At most ``HEAD_WORDS`` short words, the commonest: as many steps of a scale of counts, 16 to the octave, as fit."""
    short = scores.where((F.octet_length("word") <= HEAD_BYTES) & (F.col("c") > 0)).withColumn("step", F.floor(16 * F.log2("c")))
    least, taken = 1 << 30, 0
    for step, n in short.groupBy("step").count().orderBy(F.desc("step")).collect():  # about a thousand steps at most
        if (taken := taken + n) > HEAD_WORDS:
            break
        least = step
    return short.where(F.col("step") >= least).select("word", "base", "score")


def score_texts(docs: DataFrame, vocabulary_path: str, modulus: int = 7, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Words are what stands between ASCII blanks, A-Z lower-cased, then one end. Null or empty text is the end alone.
    A null id is a training document. Rows that repeat an id are scored each. Without training documents the counts are
    empty and the lattice is as the vocabulary's scores make it; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    d = documents(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder))
    counts = settled(word_counts(d), "counts")
    seen = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    ends = d.where(~F.col("held_out")).count()
    total, kinds = (seen.n or 0) + ends, seen.v + (ends > 0)
    discount = seen.once / (seen.once + 2 * seen.twice) if seen.once and seen.twice else 0.5
    lattice = refined(counts, first_lattice(vocabulary_path))
    shared = spark.sparkContext.broadcast(lattice)

    def base(c):
        return np.log10((c + 1) / (total + 1 * (kinds + 1)))

    def own_arc(c):
        """Logarithm of the weight of a whole word's arc; ``NEVER`` for a word never seen."""
        seen = np.maximum(c - discount, 0)
        return np.where(seen > 0, np.log(np.maximum(seen, 1e-12) / (total + 1)), NEVER)

    left = math.log((discount * kinds + 1) / (total + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float)
            log_p = own.log_marginal([w.decode("utf-8", "surrogatepass") for w in words], left + math.log(1 - END_SHARE), own_arc(c))
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.array([_key(w) for w in words], pa.int64()), pa.array(c.astype(np.int64)), pa.array(base(c)), pa.array(log_p / math.log(10))],
                names=["word", "h", "c", "base", "score"],
            )

    scores = settled(counts.select("word", "c").mapInArrow(score, "word binary, h long, c long, base double, score double"), "scores")
    common = _commonest(scores).toPandas()
    head = spark.sparkContext.broadcast((dict(zip(common["word"].map(bytes), range(len(common)), strict=True)), common["base"].to_numpy(float), common["score"].to_numpy(float)))
    end_arc = np.logaddexp(left + math.log(END_SHARE), float(own_arc(np.array(ends))))
    end = (float(base(ends)), float(end_arc) / math.log(10), int(ends > 0))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base_of, score_of = head.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts, out = batch.column("text").to_pylist(), []
            for text in texts:
                words = _words(text)
                at = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
                rare = Counter([words[k] for k in np.flatnonzero(at < 0).tolist()])
                at = at[at >= 0]
                out.append((len(words) + 1, len(at) + end[2], base_of[at].sum() + end[0], score_of[at].sum() + end[1], [{"h": _key(w), "n": n} for w, n in rare.items()]))
            n, k, b, s, tail = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + len(out)), pa.int64()), batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(k, pa.int64()),
                    pa.array(b, pa.float64()), pa.array(s, pa.float64()), pa.array(tail, pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "tail"],
            )
            row += len(out)

    rows = settled(d.mapInArrow(split, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, tail array<struct<h: long, n: long>>"), "rows")
    rare = rows.select("row", F.explode("tail").alias("t")).select("row", "t.h", "t.n").join(scores.select("h", "c", F.col("base").alias("b"), F.col("score").alias("s")), "h")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.col("b")).alias("b"), F.sum(F.col("n") * F.col("s")).alias("s"))
    none = F.lit(0)
    return rows.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", none)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", none)).alias("base_score"), (F.col("score") + F.coalesce("s", none)).alias("score"),
    )


def crc_remainder(doc_id: int, modulus: int) -> int:
    """The remainder that decides on training, for tests."""
    return zlib.crc32(str(doc_id).encode()) % modulus


def op4_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability under the pieces of the installed vocabulary and what its training share teaches."""
    import public_tokenizers

    return score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
