"""Benchmark decontamination by greedy string tiling.

Seeds: runs of `seed` words that a document shares with a benchmark item are found by hashing every
run of the document and looking it up among the items' runs.  Tiling: for each item with a seed, the
longest matches between the item and the document are marked, longest first and never overlapping, by
running Karp-Rabin with shrinking match lengths; matches shorter than `seed` words do not count.  The
share of the item's words that is marked is its coverage; order does not matter, so reordered passages
are caught.  A document is contaminated if an item's coverage reaches the threshold.

The benchmark is read in blocks of at most `block_bytes` of text; each block is broadcast and all
documents are compared with it, so a benchmark of any size is compared whole.  With several blocks, only the
texts that a block covers in part are written, by digest, before the next block is loaded; the best of all blocks
are joined to the documents once.

Results for special cases: null or empty text has coverage 0; an item without words never matches; an
item of fewer than `seed` words matches as a whole only; an empty benchmark leaves all clean; ties
between items go to the smaller item_id, null last; each text of a repeated item_id is an item.  Words are runs of letters, digits and non-ASCII characters,
lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restora.llm.graph import keyed_join, stored
from restora.llm.textkit import Words, field, pieces, string_bytes

_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687 % ((1 << 61) - 1)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[:128] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _SEPARATOR[_c] = False


def _windows(tokens: list[int], marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of every window of `size` unmarked tokens."""
    top, h, free = pow(_BASE, size - 1, _PRIME), 0, 0
    for i, x in enumerate(tokens):
        if marked[i]:
            h = free = 0
            continue
        if free == size:
            h = (h - tokens[i - size] * top) % _PRIME
        else:
            free += 1
        h = (h * _BASE + x) % _PRIME
        if free == size:
            yield i - size + 1, h


def tiles(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, length) of the tiles, each at least `least` long."""
    in_item, in_text, out = [False] * len(item), [False] * len(text), []
    size = max(least, len(item))
    while True:
        table: dict[int, list[int]] = {}
        for p, h in _windows(item, in_item, size):
            table.setdefault(h, []).append(p)
        found = []
        for t, h in _windows(text, in_text, size) if table else ():
            for p in table.get(h, ()):
                if p and t and item[p - 1] == text[t - 1] and not in_item[p - 1] and not in_text[t - 1]:
                    continue  # inside a match that began earlier
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and not in_item[p + n] and not in_text[t + n]:
                    n += 1
                if n >= size:
                    found.append((-n, p, t))
        heapify(found)
        while found:  # longest first; what is left of a match goes back by its own length
            n, p, t = heappop(found)
            free = [k for k in range(-n) if not in_item[p + k] and not in_text[t + k]]
            if len(free) == -n:
                in_item[p : p - n] = in_text[t : t - n] = [True] * -n
                out.append((p, t, -n))
                continue
            for _, run in groupby(enumerate(free), lambda x: x[1] - x[0]):
                left = [k for _, k in run]
                if len(left) >= size:
                    heappush(found, (-len(left), p + left[0], t + left[0]))
        if size <= least:
            return out
        size = max(least, size // 2)


class Items:
    """Seeds and words of a block of benchmark items."""

    def __init__(self, rows: list[tuple[int, str | None]], seed: int):
        column = pa.array([t for _, t in rows], pa.string())
        data, offsets = string_bytes(pc.utf8_lower(column))
        words = Words(data, offsets, lower=False, separators=_SEPARATOR)
        edge = np.searchsorted(words.doc, np.arange(len(rows) + 1))
        self.ids = [i for i, _ in rows]
        self.words = [[int(x) % _PRIME for x in words.hash[edge[k] : edge[k + 1]]] for k in range(len(rows))]
        self.least = [min(seed, len(w)) for w in self.words]
        self.seeds: dict[int, dict[int, list[int]]] = {}
        for size in sorted(set(self.least) - {0}):
            first, value = words.shingles(size)
            owner = words.doc[first]
            by: dict[int, list[int]] = {}
            for k, h in zip(owner.tolist(), value.tolist(), strict=True):
                if self.least[k] == size and (not by.get(h) or by[h][-1] != k):
                    by.setdefault(h, []).append(k)
            self.seeds[size] = by
        self.sieve = {}
        for size, by in self.seeds.items():
            keys = np.array(sorted(by), dtype=np.uint64)
            bits = np.zeros(1 << 20, dtype=bool)
            bits[keys & np.uint64((1 << 20) - 1)] = True
            self.sieve[size] = (bits, keys)

    def coverages(self, column: pa.Array) -> dict[int, list[tuple[float, int | None]]]:
        """row -> (coverage, item id) of each item that a row shares a seed with."""
        data, offsets = string_bytes(pc.utf8_lower(column))
        words = Words(data, offsets, lower=False, separators=_SEPARATOR)
        shared: dict[tuple[int, int], list[int]] = {}
        for size, (bits, keys) in self.sieve.items():
            first, value = words.shingles(size)
            maybe = np.flatnonzero(bits[value & np.uint64((1 << 20) - 1)])
            at = np.minimum(np.searchsorted(keys, value[maybe]), len(keys) - 1)
            hit = maybe[keys[at] == value[maybe]] if len(keys) else maybe[:0]
            for w, h in zip(first[hit].tolist(), value[hit].tolist(), strict=True):
                for k in self.seeds[size][h]:
                    shared.setdefault((int(words.doc[w]), k), []).append(w)
        out: dict[int, list[tuple[float, int | None]]] = {}
        for (row, k), starts in shared.items():
            text, end = [], -1  # only stretches that seeds cover can hold tiles
            for w in sorted(starts):
                if w > end:
                    text.append(-1)
                for x in range(max(w, end), w + self.least[k]):
                    text.append(int(words.hash[x]) % _PRIME)
                end = w + self.least[k]
            covered = sum(n for _, _, n in tiles(self.words[k], text, self.least[k]))
            out.setdefault(row, []).append((covered / len(self.words[k]), self.ids[k]))
        return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[DataFrame]:
    """The benchmark's rows in hashed blocks of about block_bytes of text at most."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block_bytes))
    for k in range(blocks):
        yield rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)


def _rows_of(block: DataFrame) -> list[tuple[int | None, str]]:
    return [(r.item_id, r.text) for r in block.orderBy("item_id", "text").collect()]  # one block


def covered(docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.5, block_bytes: int = 4 << 20) -> DataFrame:
    """The columns of docs plus coverage (largest of any item), item_id (its item) and contaminated; clashing names are replaced."""
    docs = docs.drop("coverage", "item_id", "contaminated")
    names, blocks = docs.columns, list(_blocks(benchmark, block_bytes))
    schema = T.StructType([*docs.schema.fields, T.StructField("coverage", T.DoubleType()), T.StructField("item_id", T.LongType())])
    if len(blocks) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(_rows_of(blocks[0]))  # at most a block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, seed)
            for batch in pieces(batches):
                best = [(0.0, None)] * batch.num_rows
                for row, found in items.coverages(field(batch, "text")).items():
                    best[row] = min([*found, best[row]], key=_order)
                columns = [field(batch, n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([c for c, _ in best], pa.float64()), pa.array([i for _, i in best], pa.int64())], names=[*names, "coverage", "item_id"])

        out = docs.mapInArrow(run, schema)
    else:
        text, key = F.col("text").cast("string"), "__text_" + "_" * max(map(len, names))  # a name that docs doesn't have
        hits = reduce(DataFrame.unionByName, [_hits(docs.select(text.alias("text")), block, seed) for block in blocks])
        order = F.struct((-F.col("coverage")).alias("less"), F.col("item_id").isNull().alias("unnamed"), F.col("item_id"))
        best = hits.groupBy("text_key").agg(F.min(order).alias("best")).select(F.col("text_key").alias(key + "_"), (-F.col("best.less")).alias("coverage"), F.col("best.item_id").alias("item_id"))
        out = keyed_join(docs.withColumn(key, F.sha2(text, 256)), best, key, key + "_", "left")
        out = out.select(*[F.col(f"`{n}`") for n in names], F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "item_id")
    return out.withColumn("contaminated", F.col("coverage") >= threshold)


def _order(found: tuple[float, int | None]) -> tuple:
    """The largest coverage first, then the smallest item_id, null last."""
    return -found[0], found[1] is None, found[1] or 0


def _hits(texts: DataFrame, block: DataFrame, seed: int) -> DataFrame:
    """text_key (a digest), coverage and item_id of the texts that one block covers in part; written, so that one block at a time is in memory."""
    shared = texts.sparkSession.sparkContext.broadcast(_rows_of(block))  # at most a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value, seed)
        for batch in pieces(batches):
            found = [(row, *min(hits, key=_order)) for row, hits in items.coverages(field(batch, "text")).items()]
            if found:
                row, coverage, item = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([field(batch, "text").take(pa.array(row)), pa.array(coverage, pa.float64()), pa.array(item, pa.int64())], names=["text", "coverage", "item_id"])

    hits = texts.mapInArrow(run, "text string, coverage double, item_id long")
    out = stored(hits.select(F.sha2("text", 256).alias("text_key"), "coverage", "item_id"))
    shared.unpersist()
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, coverage and item_id of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return covered(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "contaminated", "coverage", "item_id")
