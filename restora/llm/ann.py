"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table has `functions` hashes floor((a.x + b) / width) with Gaussian a; equal hashes share a bucket.
A query visits its own bucket and then perturbed ones in order of their estimated success: the sum of
squared distances from the query's projections to the bucket walls that the perturbation crosses.
Candidates of all tables are merged and ranked by exact distance in double precision.

Widths follow the data: there is one for each level of the distances to the k-th nearest in a bounded sample,
`spread` times the level, and a query takes the level next above its own such distance.  That distance also bounds
the true one from above, so a query with fewer than k hits, or with the k-th beyond it, has missed some; all
such queries are compared with every vector.
Every vector is indexed.  Queries are packed in blocks of `block` on the executors, and tasks take every
pair of a group of blocks and a partition of vectors, find the probes themselves, and keep the best of their
own vectors: neither queries nor probes reach the driver, and candidates are never shuffled.  Work therefore
grows with vectors x queries; where few vectors are hit, only their distances are computed.

Results for special cases: vectors that are null, zero, not of the commonest dimension, or that hold
null or non-finite components take no part; ties go to the smaller vec_id; only if fewer than k other
vectors take part, there are fewer rows; no vectors give no rows; rows that share a vec_id are each indexed, and
none of them is a candidate for a query of that id, whose result is that of one row: the one with the smallest
distances, compared in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from restora.llm.graph import cut
from restora.llm.textkit import field, mix, randoms

SAMPLE = 1000
#: Up to so many functions all steps to neighbouring buckets are ranked at once.
ENUMERATED = 8
#: Vectors packed in one row, query blocks in one group, and the share of hits under which distances are computed one by one.
CHUNK, GROUP, SPARSE = 4096, 16, 0.05
#: Levels differ by this factor at least.
STEP = 1.25


class Tables:
    """The hash functions of all tables."""

    def __init__(self, dimension: int, tables: int, functions: int, width: float, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.a = draw.normal(size=(tables, dimension, functions))
        self.b = draw.uniform(0, width, size=(tables, functions))
        self.width = width
        self.salt = randoms(functions, 31) | np.uint64(1)

    def projected(self, x: np.ndarray, t: int) -> np.ndarray:
        return (x @ self.a[t] + self.b[t]) / self.width

    def keys(self, cells: np.ndarray) -> np.ndarray:
        total = np.zeros(len(cells), dtype=np.uint64)
        for j, c in enumerate(self.salt):
            total += cells[:, j].astype(np.int64).view(np.uint64) * c
        return mix(total)

    def probes(self, q: np.ndarray, t: int, probes: int) -> np.ndarray:
        """Keys (queries x probes + 1) of the buckets that each query visits; all buckets around if there are fewer."""
        p = self.projected(q, t)
        home = np.floor(p)
        inside = p - home
        m = p.shape[1]
        if m > ENUMERATED:
            return self.keys((home[:, None, :] + np.array([_cheapest(x, probes) for x in inside])).reshape(-1, m)).reshape(len(q), -1)
        steps = np.indices((3,) * m).reshape(m, -1).T - 1  # every step of -1, 0 or 1 along each function
        down, up, n = (steps < 0).T.astype(float), (steps > 0).T.astype(float), min(probes + 1, len(steps))
        out = np.empty((len(q), n), dtype=np.uint64)
        for start in range(0, len(q), 256):
            part = slice(start, start + 256)
            cost = inside[part] ** 2 @ down + (1 - inside[part]) ** 2 @ up
            best = np.argpartition(cost, n - 1, axis=1)[:, :n]
            out[part] = self.keys((home[part, None, :] + steps[best]).reshape(-1, m)).reshape(-1, n)
        return out


def _cheapest(inside: np.ndarray, probes: int) -> np.ndarray:
    """The step to the query's own bucket and the `probes` cheapest others, from a heap of perturbation sets."""
    m = len(inside)
    out = np.zeros((probes + 1, m), dtype=np.int64)
    walls = sorted([(inside[j] ** 2, j, -1) for j in range(m)] + [((1 - inside[j]) ** 2, j, 1) for j in range(m)])
    heap, n = [(walls[0][0], (0,))], 0
    while heap and n < probes:
        cost, chosen = heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heappush(heap, (cost - walls[last][0] + walls[last + 1][0], (*chosen[:-1], last + 1)))
            heappush(heap, (cost + walls[last + 1][0], (*chosen, last + 1)))
        if len({walls[k][1] for k in chosen}) == len(chosen):
            n += 1
            for k in chosen:
                out[n, walls[k][1]] += walls[k][2]
    return out


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, hit: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, distances) of the k nearest hits."""
    square = None
    if hit.mean() >= SPARSE:
        square = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T)
        slack = 1e-9 * (1 + float(np.abs(square).max(initial=0)))
    for i in range(len(q)):
        at = np.flatnonzero(hit[i])
        if not len(at):
            continue
        if len(at) > k and square is not None:
            rough = square[i, at]
            at = at[rough <= np.partition(rough, k - 1)[k - 1] + slack]
        d = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
        order = np.lexsort((ids[at], d))[:k]
        yield i, ids[at][order], d[order]


class Best:
    """The k nearest so far of each query of a block."""

    def __init__(self, names: np.ndarray, k: int):
        self.names, self.k, self.of = names, k, {}

    def add(self, i: int, ids: np.ndarray, d: np.ndarray) -> None:
        if i in self.of:
            ids, d = np.r_[self.of[i][0], ids], np.r_[self.of[i][1], d]
            order = np.lexsort((ids, d))[: self.k]
            ids, d = ids[order], d[order]
        self.of[i] = ids, d

    def rows(self) -> pa.RecordBatch:
        found = list(self.of.values())
        owners = np.repeat(self.names[list(self.of)], [len(x[0]) for x in found])
        return pa.RecordBatch.from_arrays([pa.array(owners), pa.array(np.concatenate([x[0] for x in found])), pa.array(np.concatenate([x[1] for x in found]))], names=["row", "vec_id", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.where("vec_id is not null and embedding is not null").where(finite & F.exists("embedding", lambda c: c != 0))


def levels_of(distances: np.ndarray) -> np.ndarray:
    """Distances from the smallest to the largest of a sample, each over STEP times the one before."""
    out: list[float] = []
    for d in np.quantile(distances, np.linspace(0.98, 0.02, 25)) if len(distances) else []:
        if not out or STEP * d < out[-1]:
            out.append(float(d))
    return np.array(out[::-1] or [1.0])


def kth(q: np.ndarray, names: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Upper bounds of the distances from each query to its k-th nearest among the x with another id; infinite if there are fewer."""
    square = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T)
    slack = 1e-9 * (1 + np.abs(square).max(initial=0))
    square[names[:, None] == ids[None, :]] = np.inf
    return np.sqrt(np.maximum(np.partition(square, k - 1, axis=1)[:, k - 1], 0) + slack) if len(x) >= k else np.full(len(q), np.inf)


def bounded(q: DataFrame, x: np.ndarray, ids: np.ndarray, levels: np.ndarray, k: int) -> DataFrame:
    """q with the bound of its k-th distance, from a sample, and the number of its level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                names = field(batch, "vec_id").to_numpy()
                bound = kth(field(batch, "embedding").flatten().to_numpy().reshape(len(names), x.shape[1]), names, x, ids, k)
                level = np.minimum(np.searchsorted(levels, bound), len(levels) - 1)
                yield pa.RecordBatch.from_arrays([field(batch, "vec_id"), field(batch, "embedding"), pa.array(bound), pa.array(level.astype(np.int64))], names=["vec_id", "embedding", "bound", "level"])

    return q.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, bound double, level long")


def packed(df: DataFrame, most: int, prefix: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Ids, embeddings and extra columns (bytes of longs and doubles) of up to `most` vectors a row."""
    names = [f"{prefix}_ids", f"{prefix}_at", *(f"{prefix}_{e}" for e in extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, most):
                batch = whole.slice(start, most)
                columns = [field(batch, "vec_id"), field(batch, "embedding").flatten(), *(field(batch, e) for e in extra)]
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in columns], names=names)

    return df.select("vec_id", "embedding", *extra).mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def searched(v: DataFrame, q: DataFrame, many: int, dimension: int, hashes: list[Tables] | None, probes: int, k: int, block: int) -> DataFrame:
    """row, vec_id, score: of each query row (many in number) the k nearest hits of every partition of v; without hashes (one a level) all are hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, at, probe = None, None, None, []
        for batch in batches:
            for q_row, q_ids, q_at, q_level, v_ids, v_at in zip(*(field(batch, n).to_pylist() for n in ("q_row", "q_ids", "q_at", "q_level", "v_ids", "v_at")), strict=True):
                if q_row != now:  # the pairs of a block come one after the other
                    if best is not None and best.of:
                        yield best.rows()
                    now, best, at = q_row, Best(np.frombuffer(q_row, dtype=np.int64), k), np.frombuffer(q_at).reshape(-1, dimension)
                    names = np.frombuffer(q_ids, dtype=np.int64)
                    probe, level = [], np.frombuffer(q_level, dtype=np.int64)
                    for one in np.unique(level) if hashes else []:
                        members = np.flatnonzero(level == one)
                        for t in range(len(hashes[one].a)):
                            keys = hashes[one].probes(at[members], t, probes)
                            flat = keys.reshape(-1)
                            order = np.argsort(flat, kind="stable")
                            probe.append((hashes[one], t, flat[order], members[order // keys.shape[1]].astype(np.int32)))
                ids, x = np.frombuffer(v_ids, dtype=np.int64), np.frombuffer(v_at).reshape(-1, dimension)
                hit = np.full((len(at), len(ids)), hashes is None)
                for table, t, keys, owner in probe:
                    own = table.keys(np.floor(table.projected(x, t)))
                    low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                    n = high - low
                    which = np.repeat(np.arange(len(ids)), n)
                    place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                    hit[owner[place], which] = True
                hit &= names[:, None] != ids[None, :]
                for i, near_ids, d in nearest(at, x, ids, hit, k):
                    best.add(i, near_ids, d)
        if best is not None and best.of:
            yield best.rows()

    blocks = packed(q.repartition(max(1, -(-many // (block * GROUP)))), block, "q", ("level", "row"))
    return blocks.hint("shuffle_replicate_nl").crossJoin(packed(v, CHUNK, "v")).mapInArrow(run, "row long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("row", "rank", "vec_id", "score")


def one_an_id(found: DataFrame, q: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: of the rows that share an id, the one whose distances are smallest, compared in order."""
    lists = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("l"))  # k at most
    lists = lists.join(q.select("row", F.col("vec_id").alias("query_id")), "row")
    best = F.min(F.struct(F.col("l.score").alias("score"), F.col("l.vec_id").alias("vec_id"))).alias("b")
    each = lists.groupBy("query_id").agg(best).select("query_id", F.posexplode(F.arrays_zip("b.score", "b.vec_id")).alias("place", "x"))
    return each.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = 32, functions: int = 8, probes: int = 120, spread: float = 1.35, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query; a query's own vec_id is no candidate."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v, q = usable(vectors), usable(queries)
    common = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return empty
    dimension = common.n
    v, q = v.where(F.size("embedding") == dimension), q.where(F.size("embedding") == dimension)
    sample = v.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in sample], dtype=np.int64), np.array([r.embedding for r in sample])
    apart = kth(x, ids, x, ids, k)
    levels = levels_of(apart[np.isfinite(apart)])
    q = cut(bounded(q, x, ids, levels, k).withColumn("row", F.monotonically_increasing_id()))  # numbers that the written table keeps
    many = q.count()
    if not many:
        return empty
    found = cut(ranked(searched(v, q, many, dimension, [Tables(dimension, tables, functions, spread * w) for w in levels], probes, k, block), k))
    reached = found.groupBy("row").agg(F.count("*").alias("n"), F.max("score").alias("far")).join(q.select("row", "bound"), "row")
    whole = reached.where((F.col("n") >= k) & (F.col("far") <= F.col("bound"))).select("row")
    short = cut(q.join(whole, "row", "left_anti"))
    few = short.count()
    if few:
        found = found.join(whole, "row", "left_semi").unionByName(ranked(searched(v, short, few, dimension, None, probes, k, block), k))
    return one_an_id(found, q)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours(vectors, vectors.where("vec_id % 100 = 0"))
