"""Integer vectors packed in shards, and blocks of query rows that meet every shard.

A shard holds up to SHARD vectors of one dimension in binary columns; its number and the place in it name a row, so
rows that share an id, or are wholly equal, are told apart.  Shards are written once to the shared folder and read
again by every later step, so a lost executor costs only its own tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restora.llm.graph import stored
from restora.llm.textkit import field

#: Vectors in a shard, query rows in a block, and blocks in one partition.
SHARD, BLOCK, GROUP = 2048, 512, 16
#: Whole numbers up to this are exact as doubles; scores stop at the limits of 64 bits.
EXACT, LONGEST = 2.0**53, 2**63 - 1

_INDEX = "shard long, dim int, ids binary, at binary, labels binary, asked binary, lists binary"
_BLOCKS = "q_dim int, q_shard binary, q_place binary, q_ids binary, q_at binary, q_labels binary"


def scaled(x: np.ndarray, factor: float = 256.0) -> np.ndarray:
    """floor(factor * x), as doubles."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(factor * x), -np.finfo(np.float64).max, np.finfo(np.float64).max)


def packed(c: np.ndarray) -> bytes:
    """Two bytes a component where they are enough, else eight."""
    return (c.astype("<i2") if not c.size or np.abs(c).max() < 1 << 15 else c.astype("<f8")).tobytes()


def unpacked(raw: bytes, rows: int, dim: int) -> np.ndarray:
    kind = "<i2" if len(raw) == 2 * rows * dim else "<f8"
    return np.frombuffer(raw, dtype=kind).reshape(rows, dim).astype(np.float64)


def longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i8")


def usable(vectors: DataFrame, asked: Column, label: Column | None = None) -> DataFrame:
    """vec_id, embedding (doubles), label and asked of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), (F.lit(0) if label is None else label).cast("long").alias("label"), F.coalesce(asked, F.lit(False)).alias("asked"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where("vec_id is not null and embedding is not null and label is not null").where(finite)


def index(rows: DataFrame, sorted_lists: bool) -> DataFrame:
    """The shards of `usable` rows, with each dimension's sorted list of places if wanted; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def shard(dim: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            ids, label, asked, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((label, ids))
            ids, label, asked, c = ids[order], label[order], asked[order], c[order]
            lists = np.argsort(c.T, axis=1, kind="stable").astype("<u2").tobytes() if sorted_lists else b""
            values = [number, dim, ids.tobytes(), packed(c), label.tobytes(), asked.tobytes(), lists]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64(), pa.int32(), *[pa.binary()] * 5], strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])

        for batch in batches:
            for start in range(0, batch.num_rows, SHARD):
                part = batch.slice(start, SHARD)
                at = field(part, "embedding")
                size = np.diff(at.offsets.to_numpy())
                flat, begin = at.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
                columns = [field(part, n).to_numpy(zero_copy_only=False) for n in ("vec_id", "label", "asked")]
                for dim in np.unique(size).tolist():
                    own = np.flatnonzero(size == dim)
                    c = scaled(flat[(begin[own][:, None] + np.arange(dim)).reshape(-1)].reshape(len(own), dim))
                    held.setdefault(dim, []).append((*(x[own] for x in columns), c))
                    while sum(len(x[0]) for x in held[dim]) >= SHARD:
                        whole = [np.concatenate(x) for x in zip(*held[dim], strict=True)]
                        yield shard(dim, [tuple(x[:SHARD] for x in whole)])
                        number += 1
                        held[dim] = [tuple(x[SHARD:] for x in whole)]
        for dim, parts in held.items():
            if sum(len(x[0]) for x in parts):
                yield shard(dim, parts)
                number += 1

    parts = max(1, -(-rows.count() // SHARD))
    return stored(rows.repartition(parts).mapInArrow(run, _INDEX))


def blocks(shards: DataFrame) -> DataFrame:
    """The rows that are asked for, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, dim, ids, at, labels, asked in zip(*(field(batch, n).to_pylist() for n in ("shard", "dim", "ids", "at", "labels", "asked")), strict=True):
                place = np.flatnonzero(np.frombuffer(asked, dtype=bool))
                at = unpacked(at, len(asked), dim)
                for k in range(0, len(place), BLOCK):
                    own = place[k : k + BLOCK].astype("<i8")
                    yield block(dim, np.full(len(own), shard, "<i8"), own, longs(ids)[own], at[own], longs(labels)[own])

    return _joined(shards.select("shard", "dim", "ids", "at", "labels", "asked").mapInArrow(run, _BLOCKS))


def block(dim: int, shard: np.ndarray, place: np.ndarray, ids: np.ndarray, at: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
    values = [dim, shard.tobytes(), place.tobytes(), ids.tobytes(), packed(at), labels.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32(), *[pa.binary()] * 5], strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])


def _joined(small: DataFrame) -> DataFrame:
    """Blocks of up to BLOCK rows from the few rows of each shard; GROUP of them in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            shard, place, ids, labels, at = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            return block(dim, shard, place, ids, at, labels)

        for batch in batches:
            for dim, shard, place, ids, at, labels in zip(*(field(batch, n).to_pylist() for n in ("q_dim", "q_shard", "q_place", "q_ids", "q_at", "q_labels")), strict=True):
                new = (*(longs(x) for x in (shard, place, ids, labels)), unpacked(at, len(ids) // 8, dim))
                if sum(len(x[0]) for x in held.get(dim, [])) + len(new[0]) > BLOCK:
                    yield out(dim)
                held.setdefault(dim, []).append(new)
        for dim in list(held):
            yield out(dim)

    small = stored(small)
    rows = small.agg(F.coalesce(F.sum(F.length("q_ids") / 8), F.lit(0))).first()[0]
    return small.repartition(max(1, -(-int(rows) // (BLOCK * GROUP)))).mapInArrow(run, _BLOCKS)


def against_all(queries: DataFrame, shards: DataFrame, meet: Callable[[dict, Iterator[dict]], Iterator[pa.RecordBatch]], schema: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """meet(block, its shards) for every block and every part of the shards; both go as dicts of columns.  Blocks and shards of other dimensions don't meet."""
    wanted = ["dim", "shard", "ids", "at", *columns]
    own = queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[dict, dict]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {n: field(batch, n)[i].as_py() for n in (*own, *wanted)}
                    yield {n: row[n] for n in own}, {n: row[n] for n in wanted}

        source = pairs()
        ahead = next(source, None)
        while ahead is not None:  # the pairs of a block come one after the other
            now = ahead[0]

            def same() -> Iterator[dict]:
                nonlocal ahead
                while ahead is not None and (ahead[0]["q_shard"], ahead[0]["q_place"]) == (now["q_shard"], now["q_place"]):
                    if ahead[1]["dim"] == now["q_dim"]:
                        yield ahead[1]
                    ahead = next(source, None)

            mine = same()
            yield from meet(now, mine)
            for _ in mine:
                pass

    return queries.hint("shuffle_replicate_nl").crossJoin(shards.select(*wanted)).mapInArrow(run, schema)
