"""Nearest neighbours by largest inner product: probed lists and an adaptive scan of rotated dimensions.

A vector x becomes (x / M, sqrt(1 - |x|^2 / M^2)), M the largest norm, and a query q becomes (q / |q|, 0): then all lie on
the unit sphere and the nearest is the one of largest inner product. A random rotation makes any leading dimensions a fair
sample of the whole distance. Lists come from k-means on a bounded sample (``SAMPLE``); every row is in a list. A list is
stored in groups, a group by blocks of columns, so that a scan reads block after block.

A query scans its home lists whole, which gives it a threshold that is met by enough rows; the nearest of the other probed
lists raise it before the rest are scanned, so few rows pass. There candidates are abandoned block by block, by a test of the hypothesis that the whole distance is within the threshold: the
first d of D rotated dimensions hold a share of it that is distributed as Beta(d / 2, (D - d) / 2), so a partial distance
beyond the share's mean and ``DEVIATIONS`` standard deviations rejects it. What survives is scored exactly, on the original
vectors.

How many lists are probed is measured: the exact neighbours of a bounded number of queries (``PILOTS``), found by one pass
over all groups, lie in so many of their nearest lists that ``RECALL`` of them are met.

Equal vectors are one entry with their ``k + 1`` smallest ids: no answer can hold another. So copies, of rows or of
queries, make no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, settled, table

#: Rows that k-means learns from; rows of a list that are aimed at; lists at most, so that centroids stay small.
SAMPLE, LIST_ROWS, MOST_LISTS = 16_384, 256, 4096
#: Entries of a group, and queries that scan it together.
GROUP, PACK = 1024, 256
PILOTS, RECALL = 64, 0.96
#: One in so many of the lists beyond the home lists is scanned first.
AHEAD = 8
DEVIATIONS, BLOCK, SLACK = 2.5, 16, 1e-5


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v of rows that take part: an id, and a vector of finite numbers that aren't all zero."""
    v = F.col("v")
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False)))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """Different vectors with their ``keep`` smallest ids; tasks limit the copies before they meet."""
    w = Window.partitionBy("h", "v").orderBy("vec_id")
    few = rows.withColumn("h", F.xxhash64("v")).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep)
    return few.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


@dataclass
class Space:
    """Where vectors live: dimensions, the largest norm and the rotation; and the lists."""

    size: int
    norm: float
    rotation: np.ndarray
    centroids: np.ndarray | None = None
    #: Tasks that an expected list is dealt to.
    parts: np.ndarray | None = None
    #: Entries of each list.
    counts: np.ndarray | None = None

    def padded(self, column: pa.Array) -> np.ndarray:
        """Vectors as rows; shorter ones end in zeros."""
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if (lengths == self.size).all():
            return flat.reshape(len(column), self.size)
        out = np.zeros((len(column), self.size), flat.dtype)
        out[np.arange(self.size) < lengths[:, None]] = flat
        return out

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float) / self.norm
        rest = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))
        return (np.column_stack([x, rest]) @ self.rotation).astype(np.float32)

    def queries(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = q.astype(float)
        size = np.sqrt((q * q).sum(1))
        return (np.column_stack([q / size[:, None], np.zeros(len(q))]) @ self.rotation).astype(np.float32), size * self.norm

    def order(self, y: np.ndarray) -> np.ndarray:
        """Lists from the nearest on."""
        return np.argsort((self.centroids**2).sum(1) - 2 * (y @ self.centroids.T), axis=1, kind="stable")


def lists_of(y: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k-means of the sample; an empty list takes the row that is farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    c = y[rng.choice(len(y), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        far = (c**2).sum(1) - 2 * (y @ c.T)
        at = far.argmin(1)
        n = np.bincount(at, minlength=k)
        sums = np.zeros((k, y.shape[1]))
        np.add.at(sums, at, y)
        if (empty := np.flatnonzero(n == 0)).size:
            sums[empty], n[empty] = y[np.argsort(-far.min(1) - (y**2).sum(1))[: len(empty)]], 1
        c = (sums / n[:, None]).astype(np.float32)
    return c


def blocks(size: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK, size)) for a in range(0, size, BLOCK)]


def adaptive(queries: np.ndarray, columns: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, row) whose squared distance is within ``limit``, and how many values were read.

    ``columns``: [dimensions, rows]. Dense while most candidates live, pair by pair afterwards.
    """
    size, n, read = len(columns), columns.shape[1], 0
    partial, who = np.zeros((len(queries), n), np.float32), None
    for a, b in blocks(size):
        q, x = queries[:, a:b], columns[a:b]
        if who is None:
            partial += (q * q).sum(1)[:, None] + (x * x).sum(0) - 2 * (q @ x)
            read += partial.size * (b - a)
        else:
            d = q[who[0]] - x[:, who[1]].T
            partial = partial + (d * d).sum(1)
            read += len(partial) * (b - a)
        share = b / size
        most = limit * min(1.0, share + DEVIATIONS * np.sqrt(2 * share * (1 - share) / (size + 2))) + SLACK
        stay = partial <= (most[:, None] if who is None else most[who[0]])
        if who is not None:
            who, partial = (who[0][stay], who[1][stay]), partial[stay]
        elif b == size or stay.mean() < 0.5:
            who = np.nonzero(stay)
            partial = partial[who]
        if who is not None and not len(partial):
            break
    return who[0], who[1], read


def exact(q: np.ndarray, x: np.ndarray, who: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Inner products in double precision, added in order of the dimensions, so that equal vectors score equally."""
    out = np.zeros(len(who[0]))
    for d in range(q.shape[1]):
        out += q[who[0], d].astype(float) * x[who[1], d].astype(float)
    return out


def best(who: np.ndarray, score: np.ndarray, first: np.ndarray, most: int) -> np.ndarray:
    """Places of each query's ``most`` best pairs, ties to the smaller id."""
    order = np.lexsort((first, -score, who))
    w = who[order]
    begin = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, int)
    place = np.arange(len(w)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(w)]])))
    return order[place < most]


class Group:
    """A row of the index."""

    def __init__(self, space: Space, row: dict, kind: np.dtype) -> None:
        self.ids = row["ids"]
        self.raw = np.frombuffer(row["raw"], kind).reshape(-1, space.size)
        self.columns = np.frombuffer(row["columns"], np.float32).reshape(space.size + 1, -1)
        self.first = np.array([i[0] for i in self.ids])


def build(spark: SparkSession, vectors: DataFrame, space: Space, kind: np.dtype) -> DataFrame:
    """Index rows (list, ids, raw, columns): every entry, dealt by its nearest list, in groups."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = space.order(space.rows(space.padded(batch.column("v"))))[:, 0] if batch.num_rows else np.zeros(0, int)
            part = batch.column("h").to_numpy() % space.parts[at]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(part, pa.int32()), batch.column("v"), batch.column("ids")], names=["list", "part", "v", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, raw = None, [], []

        def closed() -> pa.RecordBatch:
            x = np.concatenate(raw)
            columns = np.ascontiguousarray(space.rows(x).T).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int32()), pa.array([ids], pa.list_(pa.list_(pa.int64()))), pa.array([x.astype(kind).tobytes()], pa.binary()), pa.array([columns], pa.binary())],
                names=["list", "ids", "raw", "columns"],
            )

        for batch in batches:
            x, at, own = space.padded(batch.column("v")), batch.column("list").to_numpy(), batch.column("ids").to_pylist()
            for k in range(batch.num_rows):
                if ids and (at[k] != name or len(ids) == GROUP):
                    yield closed()
                    ids, raw = [], []
                name = int(at[k])
                ids.append(own[k])
                raw.append(x[k : k + 1])
        if ids:
            yield closed()

    v = vectors.schema["v"].dataType.simpleString()
    placed = vectors.mapInArrow(place, f"list int, part int, v {v}, ids array<long>")
    dealt = placed.repartition("list", "part").sortWithinPartitions("list", "part")
    return settled(dealt.mapInArrow(pack, "list int, ids array<array<long>>, raw binary, columns binary"), "vector-index")


def probes_needed(index: DataFrame, pilots: np.ndarray, space: Space, kind: np.dtype, k: int) -> int:
    """Nearest lists that hold ``RECALL`` of the pilots' exact neighbours: one pass over all groups, the best of each task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.zeros(0, int), np.zeros(0), np.zeros(0, int))
        for batch in batches:
            for row in batch.to_pylist():
                raw = np.frombuffer(row["raw"], kind).reshape(-1, space.size).astype(float)
                s = pilots.astype(float) @ raw.T
                top = np.argsort(-s, axis=1)[:, : k + 1]
                who = np.repeat(np.arange(len(pilots)), top.shape[1])
                now = (np.concatenate([kept[0], who]), np.concatenate([kept[1], np.take_along_axis(s, top, 1).ravel()]), np.concatenate([kept[2], np.full(len(who), row["list"])]))
                stay = best(now[0], now[1], now[2], k + 1)
                kept = tuple(x[stay] for x in now)
        yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int32()), pa.array(kept[1]), pa.array(kept[2], pa.int32())], names=["pilot", "score", "list"])

    top = Window.partitionBy("pilot").orderBy(F.desc("score"))
    found = index.select("list", "raw").mapInArrow(scan, "pilot int, score double, list int").withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1)
    rows = found.select("pilot", "list").collect()  # at most PILOTS x (k + 1)
    rank = np.argsort(space.order(space.queries(pilots)[0]), axis=1)
    needed = np.sort([rank[r.pilot, r.list] for r in rows])
    return 1 + int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))])


def routed(queries: DataFrame, space: Space, probes: int, least: int, round_: int) -> DataFrame:
    """A row for each query and list of a round: home lists, which hold ``least`` entries at least; the nearest ``1 / AHEAD`` of the others up to ``probes``; the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = space.order(space.queries(space.padded(batch.column("v")))[0])
            own = 1 + (np.cumsum(space.counts[order], axis=1) < least).sum(axis=1)
            own = np.minimum(own, order.shape[1])
            end = np.maximum(own, probes)
            edges = np.zeros_like(own), own, own - (own - end) // AHEAD, end
            first, last = edges[round_], edges[round_ + 1]
            at = np.repeat(np.arange(batch.num_rows), last - first)
            to = np.concatenate([order[i, a:b] for i, (a, b) in enumerate(zip(first, last, strict=True))])
            took = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *(took.column(c) for c in ("k", "least", "v"))], names=["list", "k", "least", "v"])

    v = queries.schema["v"].dataType.simpleString()
    return queries.select("k", "least", "v").mapInArrow(run, f"list int, k long, least double, v {v}")


def scanned(index: DataFrame, to: DataFrame, space: Space, kind: np.dtype, most: int) -> DataFrame:
    """Each query's best entries of each group that it meets: k, score, ids, and whether the vector is the query's own.

    ``least`` is the score that an entry needs; null: any.
    """
    own = np.dtype(kind)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def closed() -> pa.RecordBatch:
            k, least, raw = zip(*held, strict=True)
            arrays = [pa.array([name], pa.int32()), pa.array([k], pa.list_(pa.int64())), pa.array([least], pa.list_(pa.float64())), pa.array([np.concatenate(raw).astype(own).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["list", "k", "least", "q"])

        for batch in batches:
            x = space.padded(batch.column("v"))
            for i, (at, k, least) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("list", "k", "least")), strict=True)):
                if held and (at != name or len(held) == PACK):
                    yield closed()
                    held = []
                name = at
                held.append((k, least, x[i : i + 1]))
        if held:
            yield closed()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                group, q = Group(space, row, own), np.frombuffer(row["q"], own).reshape(-1, space.size)
                y, size = space.queries(q)
                least = np.array([-np.inf if s is None else s for s in row["least"]])
                who = adaptive(y, group.columns, 2 - 2 * least / size)[:2]
                score = exact(q, group.raw, who)
                stay = score >= least[who[0]]
                who, score = (who[0][stay], who[1][stay]), score[stay]
                at = best(who[0], score, group.first[who[1]], most)
                a, b = who[0][at], who[1][at]
                same = (q[a] == group.raw[b]).all(axis=1)
                k = np.array(row["k"])[a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.int64()), pa.array(score[at]), pa.array([group.ids[j] for j in b.tolist()], pa.list_(pa.int64())), pa.array(same)], names=["k", "score", "ids", "same"]
                )

    dealt = to.repartition("list", F.pmod(F.xxhash64("k"), F.lit(8))).sortWithinPartitions("list")
    packs = dealt.mapInArrow(pack, "list int, k array<long>, least array<double>, q binary")
    met = index.join(packs.hint("shuffle_merge"), "list")
    return met.mapInArrow(scan, "k long, score double, ids array<long>, same boolean")


def search(df: DataFrame, modulus: int, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row whose id ``modulus`` divides, its ``k`` nearest rows: query_id, rank, vec_id, score.

    Rows take no part if their id is null or their vector is null, empty, zero or holds a null or a number that isn't
    finite. A shorter vector counts as ending in zeros. Of rows that repeat an id each is a candidate and, if the modulus
    divides it, a query with an answer of its own, that leaves out that one row. Ties go to the smaller id. An empty table, or
    one row alone, has no answers. Columns of other names are not read.
    """
    spark, most = df.sparkSession, k + 1
    rows = usable(df, id_col, vector_col)
    kind = np.dtype(np.float32 if rows.schema["v"].dataType.elementType.simpleString() == "float" else np.float64)
    if rows.schema["v"].dataType.elementType.simpleString() not in ("float", "double"):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    vectors = settled(entries(rows, most), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, size, longest = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out)
    turn = np.linalg.qr(np.random.default_rng(11).normal(size=(size + 1, size + 1)))[0]
    space = Space(size, float(np.sqrt(longest)) * (1 + 1e-12), turn)
    every = max(1, -(-n // SAMPLE))
    sample = vectors.where(F.pmod("h", F.lit(every)) == 0).select("v").limit(2 * SAMPLE).toArrow()["v"].combine_chunks()  # bounded: k-means only
    y = space.rows(space.padded(sample)) if len(sample) else space.rows(space.padded(vectors.select("v").limit(1).toArrow()["v"].combine_chunks()))
    space.centroids = lists_of(y, max(1, min(MOST_LISTS, len(y) // 8 or 1, -(-n // LIST_ROWS))))
    share = np.bincount(space.order(y)[:, 0], minlength=len(space.centroids)) / len(y)
    space.parts = np.maximum(1, np.ceil(share * n / (2 * GROUP))).astype(np.int64)
    index = build(spark, vectors, space, kind)
    sizes = index.groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect()  # a row per list
    space.counts = np.zeros(len(space.centroids), np.int64)
    space.counts[[r.list for r in sizes]] = [r.n for r in sizes]

    asked = rows.where(F.col("vec_id") % modulus == 0).withColumn("h", F.xxhash64("v"))
    queries = settled(asked.select("h", "v").distinct().withColumn("k", F.monotonically_increasing_id()), "queries")
    pilot = queries.orderBy(F.xxhash64("h"), "h").select("v").limit(PILOTS).toArrow()["v"].combine_chunks()
    if not len(pilot):
        return spark.createDataFrame([], out)
    probes = probes_needed(index, space.padded(pilot), space, kind, k)
    by_entry = Window.partitionBy("k").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    now, best_so_far = queries.withColumn("least", F.lit(None).cast("double")), None
    for round_ in range(3):
        found = scanned(index, routed(now, space, probes, most, round_), space, kind, most)
        found = found if best_so_far is None else best_so_far.unionByName(found)
        # An id among the best k + 1 is in one of the best k + 1 entries: each of these holds an id that comes before.
        ranked = settled(found.withColumn("n", F.row_number().over(by_entry)).where(F.col("n") <= most).drop("n"), "nearest")
        forget(best_so_far)
        best_so_far = ranked
        now = queries.join(ranked.groupBy("k").agg(F.when(F.count(F.lit(1)) == most, F.min("score")).alias("least")), "k")
    met = best_so_far.select("k", "score", "same", F.explode("ids").alias("vec_id"))
    ordered = Window.partitionBy("k").orderBy(F.desc("score"), "vec_id")
    top = met.withColumn("n", F.row_number().over(ordered)).where(F.col("n") <= most)
    answers = top.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score", "same"))).alias("found"))  # k + 1 a query
    answers = queries.join(answers, "k").select("h", "v", "found")
    own = F.filter("found", lambda e: e["same"] & (e["vec_id"] == F.col("query_id")))
    joined = asked.select(F.col("vec_id").alias("query_id"), "h", "v").join(answers, ["h", "v"])
    left = joined.select("query_id", "found", F.get(own, F.lit(0))["n"].alias("mine"))
    kept = F.slice(F.filter("found", lambda e: ~e["n"].eqNullSafe(F.col("mine"))), 1, k)
    return left.select("query_id", F.posexplode(kept).alias("at", "e")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))


def op12_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest 20 of every row whose id 20 divides; see ``search`` for nulls, ties, repeats and empty tables."""
    return search(table(spark, sf_dir, "embeddings"), 20)


#: Exact neighbours by all inner products. The operator finds nearly all of them, and all where it probes every list, as on small tables.
OP12_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(0::DOUBLE, list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0::DOUBLE))), lambda a, b: a + b) AS score
  FROM usable q JOIN usable c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""
