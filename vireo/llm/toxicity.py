"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

*Voters* are lexicon words, general and learned from labelled training rows, and patterns. Each votes toxic or abstains.
*Label model.* A document's votes are a bit mask. Over the masks of all training documents, expectation and maximisation
estimates how often each voter fires on toxic and on other documents, and how votes go together within a class; voters
that go together share one voice. Labelled rows start the estimate and stand in it as counts that don't move; where they
have a pattern of votes often, its posterior leans on what they say of the pattern.
*Classifier.* Logistic regression on the presence of words and patterns, trained on the label model's posteriors and on
nothing else.

Labels are learned only from training rows, and from all of these: words by class and masks by class are counted in
full. The classifier is fitted on a sample of at most about ``SAMPLE`` training rows, drawn by hash of the id, and as
many labelled ones, by their posteriors; its features and a few voters are all that the driver and broadcasts hold.
Votes cover all rows, and grouped masks and matrices of voters by voters are all that is summed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, settled, table

#: Rows of the classifier's sample, expected, and of the labelled rows that join it.
SAMPLE = 20_000
LEARNED, FEATURES = 40, 500
#: Labels, an id and a number each, that may be broadcast; more of them meet their texts in a shuffle.
SENT = 2_000_000
#: The model's word on a pattern of votes counts as so many labelled rows that have it.
OWN = 5
#: Lengths of the beginnings of words, in bytes, that stand for their stems.
STEMS = (4, 5, 6)
#: Insults that need no label to be suspected.
INSULTS = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "ugly", "freak",
    "imbecile", "jerk", "bastard", "bitch", "asshole", "shit", "fuck", "fucking", "whore", "slut", "retard", "vermin", "filth", "hate", "kill",
)
#: Patterns of text: shouting, repeated marks, hidden letters, insults addressed to a reader.
PATTERNS = {
    "marks": re.compile(r"[!?]{3,}"),
    "hidden": re.compile(r"\b\w+[*@$]{2,}\w+\b"),
    "addressed": re.compile(r"\b(?:you|u|your|they|he|she)\s+(?:are|re|is|r)?\s*(?:an?|the|such)?\s*(?:" + "|".join(INSULTS[:20]) + r")\b", re.I),
    "wish": re.compile(r"\b(?:shut up|go to hell|drop dead|kill yourself)\b", re.I),
}
#: ASCII letters lower-cased, other ASCII but digits as blanks; all other bytes stay.
PLAIN = bytes((b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def plain_words(text: str | None) -> set[bytes]:
    """The distinct words of a text and, with a star, their beginnings: insults are inflected and compounded."""
    words = set((text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split())
    for n in STEMS:
        words |= {w[:n] + b"*" for w in words if len(w) >= n and w[-1:] != b"*"}
    return words


def distinct_voters(rows: list) -> list[bytes]:
    """Words and stems in the given order, without those that one before them with the same beginning makes idle.

    That is one with about as many toxic rows: what a wider stem finds besides are other rows.
    """
    out = []
    for r in rows:
        word = bytes(r.word)
        same = (o for o in out if o.word.rstrip(b"*").startswith(word.rstrip(b"*")) or word.startswith(o.word.rstrip(b"*")))
        if not any(abs(o.toxic - r.toxic) <= 0.05 * r.toxic for o in same):
            out.append(r)
    return [bytes(r.word) for r in out]


def patterns_in(text: str | None) -> list[int]:
    return [k for k, p in enumerate(PATTERNS.values()) if text and p.search(text)]


@dataclass
class Voters:
    """Voter words and feature words by number; patterns come after the words in both."""

    words: list[bytes]
    features: list[bytes]
    bit: dict[bytes, int] = field(init=False)
    number: dict[bytes, int] = field(init=False)

    def __post_init__(self) -> None:
        self.bit = {w: k for k, w in enumerate(self.words)}
        self.number = {w: k for k, w in enumerate(self.features)}

    @property
    def size(self) -> int:
        return len(self.words) + len(PATTERNS)

    def read(self, text: str | None) -> tuple[int, list[int]]:
        """The mask of votes and the numbers of the features present."""
        words, found = plain_words(text), patterns_in(text)
        mask = sum(1 << self.bit[w] for w in words & self.bit.keys()) | sum(1 << len(self.words) + k for k in found)
        return mask, sorted([self.number[w] for w in words & self.number.keys()] + [len(self.features) + k for k in found])


def learned_voters(docs: DataFrame, labels: DataFrame) -> tuple[Voters, float]:
    """Voters and the share of toxic rows, from all labelled rows.

    A word's strength is the difference of its shares in toxic and other rows in standard deviations. Voters are the
    strongest of those found in toxic rows in four of five cases or more, features the strongest either way.
    """
    total = labels.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    n_toxic, n_other = float(total.toxic or 0), float(total.n - (total.toxic or 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (toxic if label else other).update(plain_words(text))
        words = list({**toxic, **other})
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([other[w] for w in words], pa.int64())], names=["word", "toxic", "other"])

    side = F.broadcast(labels) if total.n <= SENT else labels
    rows = docs.join(side, "doc_id").select("text", "toxic").mapInArrow(count, "word binary, toxic long, other long")
    rows = rows.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where((F.octet_length("word") <= 40) & (F.col("toxic") + F.col("other") >= 5))
    rows = settled(rows, "words")
    share = (F.col("toxic") + F.col("other")) / max(1.0, n_toxic + n_other)
    apart = F.col("toxic") / max(1.0, n_toxic) - F.col("other") / max(1.0, n_other)
    rows = rows.withColumn("z", apart / F.sqrt(share * (1 - share) * (1 / max(1.0, n_toxic) + 1 / max(1.0, n_other)) + 1e-12))
    sure = F.col("toxic") / (F.col("toxic") + F.col("other") + 2) >= 0.8
    best = distinct_voters(rows.where(sure & (F.col("z") > 3)).orderBy(F.desc("z"), "word").limit(4 * LEARNED).collect())[:LEARNED] if n_toxic and n_other else []
    telling = [bytes(r.word) for r in rows.orderBy(F.desc(F.abs("z")), "word").limit(FEATURES).collect()] if n_toxic and n_other else []
    general = [w.encode() for w in INSULTS]
    words = list(dict.fromkeys([*best, *general]))[: 62 - len(PATTERNS)]
    return Voters(words, list(dict.fromkeys([*telling, *general]))), (n_toxic + 1) / (n_toxic + n_other + 10)


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows by hash of the id; all, if there are fewer."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * most / n))


class LabelModel:
    """How often each voter fires on toxic and on other documents, and how votes go together within a class.

    An abstaining voter says nothing, but that all abstain is a voter of its own, the last. Where correlated voters fire
    together, each counts for its share: its log ratio is divided by the sum of its correlations with those that fire.
    """

    def __init__(self, voters: int, prior: float) -> None:
        self.size, self.prior = voters + 1, prior
        self.toxic, self.other, self.correlation = np.full(self.size, 0.2), np.full(self.size, 0.01), np.eye(self.size)
        self.toxic[-1], self.other[-1] = 0.1, 0.9

    def bits(self, masks: np.ndarray) -> np.ndarray:
        fired = (masks[:, None] >> np.arange(self.size - 1)) & 1
        return np.concatenate([fired, fired.sum(axis=1, keepdims=True) == 0], axis=1).astype(float)

    def logit(self, masks: np.ndarray) -> np.ndarray:
        bits = self.bits(masks)
        shares = np.maximum(1, bits @ self.correlation)
        return math.log(self.prior / (1 - self.prior)) + (bits / shares) @ np.log(self.toxic / self.other)

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(masks), -30, 30)))

    def update(self, both_toxic: np.ndarray, both_other: np.ndarray, n_toxic: float, n_other: float) -> None:
        """From expected co-votes per class; the diagonal holds votes."""
        self.prior = min(0.5, max(0.001, (n_toxic + 1) / (n_toxic + n_other + 10)))
        self.toxic, self.other = (np.diag(both_toxic) + 0.5) / (n_toxic + 1), (np.diag(both_other) + 0.5) / (n_other + 1)
        total = np.zeros((self.size, self.size))
        for both, rate, n in ((both_toxic, self.toxic, n_toxic), (both_other, self.other, n_other)):
            rate = np.clip(rate, 1e-9, 1 - 1e-9)
            spread = np.sqrt(rate * (1 - rate))
            total = np.maximum(total, np.clip((both / (n + 1) - np.outer(rate, rate)) / np.outer(spread, spread), 0, 1) * (n > 20))
        np.fill_diagonal(total, 1)
        self.correlation = total


def _co_votes(groups: DataFrame, model: LabelModel) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Expected co-votes over all groups of masks: every task sums its own, and the sums meet by place in the matrix."""
    size = model.size

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, totals = np.zeros((2, size, size)), np.zeros(2)
        for f in frames:
            masks = f["mask"].to_numpy(np.int64)
            bits, post = model.bits(masks), model.posterior(masks)
            weight = f["n"].to_numpy(float) * post + f["toxic"].to_numpy(float)
            rest = f["n"].to_numpy(float) * (1 - post) + f["clean"].to_numpy(float)
            sums += np.stack([(bits * weight[:, None]).T @ bits, (bits * rest[:, None]).T @ bits])
            totals += [weight.sum(), rest.sum()]
        flat = np.concatenate([sums.ravel(), totals])
        at = np.flatnonzero(flat)
        yield pd.DataFrame({"k": at, "v": flat[at]})

    flat = np.zeros(2 * size * size + 2)
    for r in groups.mapInPandas(add, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # 2 x voters x voters + 2 rows at most
        flat[r.k] = r.v
    return flat[: size * size].reshape(size, size), flat[size * size : -2].reshape(size, size), flat[-2], flat[-1]


def fitted_line(features: list[list[int]], target: np.ndarray, size: int, rounds: int = 600, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept of logistic regression by accelerated gradient steps, each weight scaled by how often it is used."""
    lengths = np.array([len(f) for f in features], np.int64)
    row, at = np.repeat(np.arange(len(features)), lengths), np.array([k for f in features for k in f], np.int64)
    n = max(1, len(features))
    step = 4.0 / (np.bincount(at, minlength=size) / n + ridge + 1e-2) / max(1.0, lengths.mean() if len(lengths) else 1.0)
    base = float(np.clip(target.mean() if len(target) else 0.1, 0.01, 0.99))
    w, b, ahead_w, ahead_b = np.zeros(size), math.log(base / (1 - base)), np.zeros(size), math.log(base / (1 - base))
    for t in range(rounds if len(features) else 0):
        z = np.bincount(row, ahead_w[at], n) + ahead_b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        new_w = ahead_w - step * (np.bincount(at, error[row], size) / n + ridge * ahead_w)
        new_b = ahead_b - 2.0 * error.mean()
        k = t / (t + 3)
        ahead_w, ahead_b, w, b = new_w + k * (new_w - w), new_b + k * (new_b - b), new_w, new_b
    return w, b


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, threshold: float = 0.7, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text", by_votes: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``; with ``by_votes`` the label model's own posterior.

    Words are ASCII letters and digits and all non-ASCII characters, A-Z lower-cased. Null and empty texts have no words
    and get the score of none. A null id is a training row without a label. Ids that repeat are scored by their own texts;
    labels that repeat count as often; null labels don't count. Words of more than 40 bytes, or in fewer than 5 training
    rows, are neither voters nor features. An empty table gives no rows. Without labels, the general voters and the label model's
    first rates decide. Other columns are ignored; labels, ids, languages and sources are never inputs of a score.
    """
    spark = docs.sparkSession
    d = documents(docs, id_col, text_col)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    own = settled(own.where(~held_out(F.col("doc_id"), modulus, remainder)), "labels")
    voters, prior = learned_voters(d, own)
    shared = spark.sparkContext.broadcast(voters)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            found = [v.read(t) for t in batch.column("text").to_pylist()]
            masks, features = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(masks, pa.int64()), pa.array(features, pa.list_(pa.int32()))], names=["doc_id", "mask", "features"])

    rows = settled(d.mapInArrow(read, "doc_id long, mask long, features array<int>").withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder)), "votes")
    train = rows.where(~F.col("held_out"))
    known = settled(train.join(own, "doc_id").select("doc_id", "mask", "features", "toxic"), "known")
    groups = train.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).withColumns({"toxic": F.lit(0), "clean": F.lit(0)})
    fixed = known.groupBy("mask").agg(F.lit(0).alias("n"), F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    groups = settled(groups.unionByName(fixed).groupBy("mask").agg(*(F.sum(c).cast("long").alias(c) for c in ("n", "toxic", "clean"))), "masks")
    model = LabelModel(voters.size, prior)
    model.update(*_co_votes(groups.withColumn("n", F.lit(0)), model))  # labelled rows alone
    for _ in range(rounds):
        model.update(*_co_votes(groups, model))

    def speak(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            post, labelled = model.posterior(f["mask"].to_numpy(np.int64)), (f["toxic"] + f["clean"]).to_numpy(float)
            yield pd.DataFrame({"mask": f["mask"], "posterior": (f["toxic"].to_numpy(float) + OWN * post) / (labelled + OWN)})

    voices = settled(groups.mapInPandas(speak, "mask long, posterior double"), "voices")
    some = _sample(train, SAMPLE).select("mask", "features").union(_sample(known, SAMPLE).select("mask", "features")).join(voices, "mask").toPandas()
    target = some["posterior"].to_numpy(float)
    weights, bias = fitted_line([list(f) for f in some["features"]], target, len(voters.features) + len(PATTERNS))
    line = spark.sparkContext.broadcast((weights, bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = line.value
        for batch in batches:
            lists = batch.column("features")
            row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64))
            z = b + np.bincount(row, w[lists.flatten().to_numpy(zero_copy_only=False)], len(lists)) if len(lists) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "held_out", "score"])

    if by_votes:
        # A pattern that no training row has is as the model makes it.
        alone = F.pandas_udf(lambda m: pd.Series(model.posterior(m.to_numpy(np.int64))), "double")
        scored = rows.join(voices, "mask", "left").select("doc_id", "held_out", F.coalesce("posterior", alone("mask")).alias("score"))
    else:
        scored = rows.select("doc_id", "held_out", "features").mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
