"""Hard-negative mining with exact integer scores from a residue number system.

Scores are inner products of integer vectors.  Blocks of anchors meet shards of rows; both are reduced modulo a few
small primes, residues are multiplied as float32 matrices (each prime is small enough for every sum to be exact),
and the signed score is rebuilt from its residues by Chinese remaindering.  As many primes are taken as the largest
possible score of the pair of blocks needs.

A first pass finds every anchor's positives: its best rows of the same label.  A second one selects, for each
anchor and positive, the best rows of other labels whose score lies in the window
low * positive <= 100 * score <= high * positive.  Each pass keeps the best of every part of the shards and merges them, so
a label that holds a third of all rows costs no more than others.

Results for special cases: rows with a null label, vec_id or vector, or with null or non-finite components, take no
part; rows of other dimensions don't meet; an anchor whose label is its own alone, or whose windows are empty (all of
negative positive scores are), has no rows; rows that share a vec_id are each anchors, positives and negatives of
their own; ties go to the smaller vec_id; scores beyond 64 bits stop at its limits; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from restora.llm import shards as S
from restora.llm.graph import stored
from restora.llm.textkit import field
from restora.llm.topk import Best

#: Sums of float32 products are exact up to this, and are reduced after so many dimensions.
FLOAT_EXACT, DEPTH = 1 << 24, 4096


@lru_cache(maxsize=256)
def primes(depth: int, bits: int) -> tuple[int, ...]:
    """The largest primes whose centred residues can be multiplied over `depth` dimensions, with a product of over `bits` bits."""
    top = 2 * int((FLOAT_EXACT // max(depth, 1)) ** 0.5) + 1
    while depth * ((top - 1) // 2) ** 2 >= FLOAT_EXACT:
        top -= 1
    out, product = [], 1
    for p in range(top, 2, -1):
        if p % 2 and all(p % d for d in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
            if product.bit_length() > bits:
                return tuple(out)
    raise ValueError("scores are too large for the primes of this dimension")


def residues(c: np.ndarray, p: int) -> np.ndarray:
    """c modulo p, between -(p - 1) / 2 and (p - 1) / 2, in float32."""
    r = np.fmod(c, p)
    half = (p - 1) // 2
    return np.where(r > half, r - p, np.where(r < -half, r + p, r)).astype(np.float32)


def rebuilt(parts: list[np.ndarray], moduli: tuple[int, ...]) -> np.ndarray:
    """The signed numbers of least size with these residues: digits of the mixed radix one after the other, then their sum."""
    digits: list[np.ndarray] = []
    for i, (r, p) in enumerate(zip(parts, moduli, strict=True)):
        v = r.astype(np.int64)
        for d, m in zip(digits, moduli, strict=False):
            v = (v - d) * pow(m, -1, p) % p
        digits.append(v % p if not i else v)
    product = 1
    for p in moduli:
        product *= p
    wide = product.bit_length() > 62
    total, radix = np.zeros(parts[0].shape, dtype=object if wide else np.int64), 1
    for d, p in zip(digits, moduli, strict=True):
        total = total + (d.astype(object) if wide else d) * radix
        radix *= p
    total = np.where(total > product // 2, total - product, total)
    return np.clip(total, -S.LONGEST, S.LONGEST).astype(np.int64) if wide else total


class Residues:
    """A matrix of whole numbers (as doubles) with its residues, which are kept."""

    def __init__(self, c: np.ndarray):
        self.c, self.most, self.known = c, int(np.abs(c).max(initial=0)), {}

    def of(self, p: int) -> np.ndarray:
        if p not in self.known:
            self.known[p] = residues(self.c, p)
        return self.known[p]


def scores(a: Residues, b: Residues) -> np.ndarray:
    """All inner products of the rows of a and b."""
    dim = a.c.shape[1]
    depth = max(1, min(dim, DEPTH))
    moduli = primes(depth, max(2, (2 * dim * a.most * b.most).bit_length() + 1))
    parts = []
    for p in moduli:
        x, y = a.of(p), b.of(p)
        total = np.zeros((len(x), len(y)), dtype=np.int64)
        for k in range(0, dim, depth):
            total += np.rint(x[:, k : k + depth] @ y[:, k : k + depth].T).astype(np.int64) % p
        parts.append(total % p)
    return rebuilt(parts, moduli)


def _positives(k: int):
    def meet(block: dict, shards: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        names, shard_of, place, labels = (S.longs(block[n]) for n in ("q_ids", "q_shard", "q_place", "q_labels"))
        q = S.unpacked(block["q_at"], len(names), block["q_dim"])
        a, best = Residues(q), [Best(k) for _ in names]
        for s in shards:
            ids, own = S.longs(s["ids"]), S.longs(s["labels"])
            got = scores(a, Residues(S.unpacked(s["at"], len(ids), s["dim"])))
            alike = {label: np.flatnonzero(own == label) for label in np.unique(labels)}
            for i in range(len(names)):
                at = alike[labels[i]]
                if shard_of[i] == s["shard"]:
                    at = at[at != place[i]]
                best[i].add(ids[at], got[i, at])
        size = [len(b.ids) for b in best]
        columns = [np.repeat(x, size) for x in (shard_of, place)] + [np.concatenate([b.ids for b in best]), np.concatenate([b.scores for b in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q_shard", "q_place", "positive_id", "positive_score"])

    return meet


def _with_windows(anchors: DataFrame, positives: DataFrame) -> DataFrame:
    """Blocks of anchors with their positives (ids and scores, one row of the block for each pair)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, shard, place, ids, at, labels in zip(*(field(batch, n).to_pylist() for n in ("q_dim", "q_shard", "q_place", "q_ids", "q_at", "q_labels")), strict=True):
                c = S.unpacked(at, len(ids) // 8, dim)
                columns = [pa.array(np.full(len(c), dim, np.int32)), *(pa.array(S.longs(x)) for x in (shard, place, ids)), pa.array([S.packed(x) for x in c], pa.binary()), pa.array(S.longs(labels))]
                yield pa.RecordBatch.from_arrays(columns, names=["q_dim", "q_shard", "q_place", "q_id", "q_at", "q_label"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, S.BLOCK):
                batch = whole.slice(start, S.BLOCK)
                dims = field(batch, "q_dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == dim)
                    shard, place, ids, labels = (field(batch, n).to_numpy()[own].astype("<i8") for n in ("q_shard", "q_place", "q_id", "q_label"))
                    at = np.concatenate([S.unpacked(field(batch, "q_at")[i].as_py(), 1, dim) for i in own.tolist()])
                    near = [field(batch, "near")[i].as_py() for i in own.tolist()]
                    count = np.array([len(n) for n in near], dtype="<i8")
                    p_ids, p_scores = (np.array([p[n] for one in near for p in one], dtype="<i8") for n in ("positive_id", "positive_score"))
                    base = S.block(dim, shard, place, ids, at, labels)
                    extra = [pa.array([x.tobytes()], pa.binary()) for x in (count, p_ids, p_scores)]
                    yield pa.RecordBatch.from_arrays([*base.columns, *extra], names=[*base.schema.names, "q_count", "q_p_ids", "q_p_scores"])

    single = anchors.mapInArrow(rows, "q_dim int, q_shard long, q_place long, q_id long, q_at binary, q_label long")
    near = positives.groupBy("q_shard", "q_place").agg(F.array_sort(F.collect_list(F.struct("p_rank", "positive_id", "positive_score"))).alias("near"))
    joined = stored(single.join(near, ["q_shard", "q_place"]))
    parts = max(1, -(-joined.count() // (S.BLOCK * S.GROUP)))
    return joined.repartition(parts).mapInArrow(pack, S._BLOCKS + ", q_count binary, q_p_ids binary, q_p_scores binary")


def _negatives(k: int, low: int, high: int):
    def meet(block: dict, shards: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        names, shard_of, place, labels, count, p_ids, p_scores = (S.longs(block[n]) for n in ("q_ids", "q_shard", "q_place", "q_labels", "q_count", "q_p_ids", "q_p_scores"))
        a = Residues(S.unpacked(block["q_at"], len(names), block["q_dim"]))
        owner = np.repeat(np.arange(len(names)), count)
        # whole scores between these ends lie in the window; rounding is up below and down above
        window = [(-(-low * int(p) // 100), high * int(p) // 100) for p in p_scores]
        best = [Best(k) for _ in window]
        first = np.cumsum(count) - count
        for s in shards:
            ids, own = S.longs(s["ids"]), S.longs(s["labels"])
            got = scores(a, Residues(S.unpacked(s["at"], len(ids), s["dim"])))
            for i in range(len(names)):
                pairs = [j for j in range(first[i], first[i] + count[i]) if window[j][0] <= window[j][1]]
                if not pairs:
                    continue
                row = got[i]
                at = np.flatnonzero((row >= min(window[j][0] for j in pairs)) & (row <= max(window[j][1] for j in pairs)) & (own != labels[i]))
                at = at[np.lexsort((ids[at], -row[at]))]
                down = -row[at]
                for j in pairs:
                    x, y = np.searchsorted(down, -window[j][1], "left"), np.searchsorted(down, -window[j][0], "right")
                    best[j].add(ids[at[x : min(x + k, y)]], row[at[x : min(x + k, y)]])
        size = [len(b.ids) for b in best]
        rank = np.arange(len(owner)) - np.repeat(first, count) + 1
        columns = [np.repeat(x, size) for x in (shard_of[owner], place[owner], names[owner], rank, p_ids, p_scores)] + [np.concatenate([np.zeros(0, np.int64), *(b.ids for b in best)]), np.concatenate([np.zeros(0, np.int64), *(b.scores for b in best)])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["q_shard", "q_place", "anchor_id", "p_rank", "positive_id", "positive_score", "negative_id", "negative_score"])

    return meet


def hard_negatives(rows: DataFrame, asked: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among rows (vec_id, embedding, label) for which `asked` holds."""
    index = S.index(S.usable(rows, asked, F.col("label")), sorted_lists=False)
    anchors = stored(S.blocks(index))
    alike = S.against_all(anchors, index, _positives(positives), "q_shard long, q_place long, positive_id long, positive_score long", ("labels",))
    place = F.row_number().over(Window.partitionBy("q_shard", "q_place").orderBy(F.desc("positive_score"), "positive_id"))
    alike = alike.withColumn("p_rank", place).where(F.col("p_rank") <= positives)
    found = S.against_all(_with_windows(anchors, alike), index, _negatives(negatives, low, high), "q_shard long, q_place long, anchor_id long, p_rank long, positive_id long, positive_score long, negative_id long, negative_score long", ("labels",))
    rank = F.row_number().over(Window.partitionBy("q_shard", "q_place", "p_rank").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh vector's label is moved on by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    rows = rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)
