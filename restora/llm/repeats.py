"""Exact removal of long repeated byte strings (op1), by hash-compared suffix sorts.

Every string of `length` bytes holds one anchor: the leftmost of its `length // 2`-byte substrings with
the smallest polynomial hash.  Equal strings have their anchor at the same place, so strings need
comparing only around equal anchors, and about one place in fifty is an anchor.  Anchors that occur once
are dropped.  What surrounds an anchor (half of `length` before it, `length` from it on) is its context;
equal contexts are counted by fingerprint and go on as one.

Contexts of one anchor form a group.  In a task, the suffixes that begin at the anchors, and the reversed
prefixes that end there, are sorted by merge sorts whose comparisons find common extensions by binary
search over prefix hashes; extensions are verified on the bytes (`suffixes.py`).  The string that begins d
bytes before an anchor is repeated if another context shares d bytes before and `length` - d from the
anchor on, which is read off the two sorted orders for every d.

A group of more than `most` contexts is never collected: its offsets d are halved, and the half's
contexts are grouped anew by the bytes that all its strings share; contexts alone in their group drop out.
With one offset left, the shared bytes are the whole string, and counting settles it.

Anchors and fingerprints of contexts (61 bits modulo a prime and 64 bits of another hash) are compared as
numbers across tasks; all that is sorted, and the shared bytes of every group that is divided, are verified byte
by byte, and hashed anew with another base after a collision.

Results for special cases: null text is empty; texts shorter than `length` keep all bytes; repeats inside
one document count, overlapping ones too; rows are told apart by doc_id and text, null ids included, so
rows that share an id are each judged on their own text, and equal rows repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restora.llm.graph import forget, keyed_join, stored
from restora.llm.suffixes import BASES, PRIME, Sorted, fold, times
from restora.llm.textkit import field, mix, pieces, randoms, signed, string_bytes

LENGTH = 200
#: Contexts of a group that are sorted in one task; contexts that a task sorts at once.
MOST, TOGETHER = 4096, 16_384
_VALUE = randoms(256, 21)
_BASE = int(randoms(1, 22)[0]) | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_PRIME_POWERS: dict[int, list[np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64; kept for the largest n so far."""
    for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
        while len(_POWERS[k]) <= n:
            step = np.uint64(pow(b, len(_POWERS[k]), 1 << 64))
            _POWERS[k] = np.concatenate([_POWERS[k], _POWERS[k] * step])
    return _POWERS[0], _POWERS[1]


def prime_powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """As powers, modulo 2**61 - 1 and for any base."""
    p, known = int(PRIME), _PRIME_POWERS.setdefault(base, [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    for k, b in enumerate((base, pow(base, -1, p))):
        while len(known[k]) <= n:
            step = np.uint64(pow(b, len(known[k]), p))
            known[k] = np.concatenate([known[k], times(known[k], step)])
    return known[0], known[1]


class Prefixes:
    """Prefix hashes of a byte array modulo 2**64; hash(start, end) of many substrings at once."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + size * np.uint64(0x9E3779B97F4A7C15))

    def all(self, size: int) -> np.ndarray:
        """Hashes of all substrings of one size."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


class PrimePrefixes:
    """The same modulo 2**61 - 1."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        up, self.down = prime_powers(len(data), base)
        terms = times(up[: len(data)], data.astype(np.uint64) + np.uint64(1))
        low, high = np.cumsum(terms & np.uint64(0xFFFFFFFF)), np.cumsum(terms >> np.uint64(32))
        high = fold(high)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        self.sums[1:] = fold(fold(low) + ((high << np.uint64(32)) & PRIME) + (high >> np.uint64(29)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return times(fold(self.sums[end] + PRIME - self.sums[start]), self.down[start])


def anchors(offsets: np.ndarray, prefixes: Prefixes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every anchor."""
    half = length // 2
    if len(prefixes.sums) - 1 < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = prefixes.all(half) >> np.uint64(32) << np.uint64(32)
    low |= np.arange(len(low), dtype=np.uint64)  # the leftmost of equal hashes wins
    width, span = length - half + 1, 1
    while span < width:  # minimum of `width` neighbours, by doubling
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # for each string's start
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    ok = np.arange(len(place)) + length <= offsets[row + 1]
    place, row = place[ok], row[ok]
    new = np.ones(len(place), dtype=bool)
    new[1:] = place[1:] != place[:-1]
    return row[new], place[new]


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key (kid, kth) that no two different rows share, and no null text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select(F.coalesce("doc_id", F.lit(0)).alias("kid"), F.xxhash64("text", F.col("doc_id").isNull()).alias("kth"), "doc_id", "text")


def anchor_uses(rows: DataFrame, length: int) -> DataFrame:
    """inner (hash of an anchor) and uses, the number of its places in a part of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = string_bytes(field(batch, "text"))
            prefixes = Prefixes(data)
            _, place = anchors(offsets, prefixes, length)
            inner, uses = np.unique(prefixes.of(place, place + length // 2), return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(inner), pa.array(uses)], names=["inner", "uses"])

    return rows.select("text").mapInArrow(run, "inner long, uses long")


def anchored(rows: DataFrame, length: int) -> DataFrame:
    """kid, kth, inner (hash of an anchor), o1, o2 (fingerprint of its context), place (the first), places (packed), uses."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = string_bytes(field(batch, "text"))
            prefixes = Prefixes(data)
            row, place = anchors(offsets, prefixes, length)
            if not len(row):
                continue
            prime = PrimePrefixes(data)
            left = np.minimum(place - offsets[row], half)
            begin, end = place - left, np.minimum(place + length, offsets[row + 1])
            shape = (left * (length + 1) + end - place).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            inner = prefixes.of(place, place + half)  # only brings together: equal by accident does no harm
            o1, o2 = mix(prime.of(begin, end) + shape), mix(prefixes.of(begin, end) + shape)
            order = np.lexsort((place, o2, o1, row))
            row, place, inner, o1, o2 = row[order], place[order], inner[order], o1[order], o2[order]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (o1[1:] != o1[:-1]) | (o2[1:] != o2[:-1])
            first = np.flatnonzero(new)
            packed = (place - offsets[row]).astype("<u4")
            ends = np.r_[first, len(row)]
            places = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])
            owner = pa.array(row[first])
            columns = [field(batch, "kid").take(owner), field(batch, "kth").take(owner), signed(inner[first]), signed(o1[first]), signed(o2[first]), pa.array(packed[first].astype(np.int32)), places, pa.array(np.diff(ends))]
            yield pa.RecordBatch.from_arrays(columns, names=["kid", "kth", "inner", "o1", "o2", "place", "places", "uses"])

    return rows.select("kid", "kth", "text").mapInArrow(run, "kid long, kth long, inner long, o1 long, o2 long, place int, places binary, uses long")


def contexts(wanted: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """inner, n, o1, o2, weight of wanted (kid, kth, place too), with around (the context's bytes) and left (how many precede the anchor)."""
    half = length // 2
    fields = ["inner", "n", "o1", "o2", "weight"]
    lists = wanted.groupBy(F.col("kid").alias("k1"), F.col("kth").alias("k2")).agg(F.collect_list(F.struct("place", *fields)).alias("wants"))  # anchors of one text
    both = rows.join(lists, (F.col("kid") == F.col("k1")) & (F.col("kth") == F.col("k2"))).select("kid", "kth", "text", "wants")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # equal rows have equal contexts: a task gives those of one of them
        for batch in pieces(batches):
            keys = list(zip(field(batch, "kid").to_pylist(), field(batch, "kth").to_pylist(), strict=True))
            new = [i for i, key in enumerate(keys) if key not in seen and not seen.add(key)]
            if not new:
                continue
            batch = batch.take(pa.array(new)) if len(new) < len(keys) else batch
            data, offsets = string_bytes(field(batch, "text"))
            wants = field(batch, "wants")
            flat = wants.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(wants.offsets.to_numpy()))
            place = flat.field("place").to_numpy() + offsets[row]
            begin, end = np.maximum(place - half, offsets[row]), np.minimum(place + length, offsets[row + 1])
            for k in range(0, len(row), 20_000):
                b, size = begin[k : k + 20_000], (end - begin)[k : k + 20_000]
                ends = np.r_[0, np.cumsum(size)]
                at = np.arange(ends[-1]) + np.repeat(b - ends[:-1], size)
                around = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes())])
                left = pa.array((place - begin)[k : k + 20_000].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(flat.field(f)[k : k + 20_000] for f in fields), around, left], names=[*fields, "around", "left"])

    return both.mapInArrow(run, "inner long, n long, o1 long, o2 long, weight long, around binary, left int")


def _around(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all contexts, the place of each anchor in them, and the number of bytes from the anchor on."""
    column = field(batch, "around")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    left = field(batch, "left").to_numpy().astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), ends[:-1] + left, ends[1:] - ends[:-1] - left


def halved(items: DataFrame, length: int, base: int) -> DataFrame:
    """items (low, high, o1, o2, weight, around, left) with both halves of their offsets, and key, the hash of the bytes that the strings of a half share; these begin at `begin` in around and are `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "around"):
            data, anchor, right = _around(batch)
            left = field(batch, "left").to_numpy().astype(np.int64)
            low, high = field(batch, "low").to_numpy().astype(np.int64), field(batch, "high").to_numpy().astype(np.int64)
            middle = (low + high) // 2
            prefixes = PrimePrefixes(data, base)
            for a, b in ((low, middle), (middle + 1, high)):
                use = (a <= b) & (np.maximum(a, length - right) <= np.minimum(b, left))  # some of the strings exist
                which = np.flatnonzero(use)
                a, b = a[which], b[which]
                at = anchor[which]
                key = mix(prefixes.of(at - a, at + length - b) + (a * (length + 1) + b).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
                part = batch.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([signed(key), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *(field(part, f) for f in ("o1", "o2", "weight", "around", "left")), pa.array((left[which] - a).astype(np.int32)), pa.array((a + length - b).astype(np.int32))], names=["key", "low", "high", "o1", "o2", "weight", "around", "left", "begin", "size"])

    return items.mapInArrow(run, "key long, low int, high int, o1 long, o2 long, weight long, around binary, left int, begin int, size int")


def grouped(large: DataFrame, length: int, bases: list[int]) -> tuple[DataFrame, DataFrame]:
    """(halved items, k and n of their keys with several), where rows of a key share their bytes: compared byte by byte, and keyed anew with another base after a collision."""
    shared = F.substring("around", F.col("begin") + 1, F.col("size"))
    for base in bases:
        parts = stored(halved(large, length, base))
        counts = parts.withColumn("s", shared).groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n"), F.min("s").alias("least"), F.max("s").alias("most")).where("n > 1")
        counts = stored(counts.select("k", "n", (F.col("least") == F.col("most")).alias("alike")))
        if counts.where("not alike").isEmpty():
            return parts, counts.select("k", "n")
        forget(parts, counts)
    raise ArithmeticError("hash collisions with every base")


def repeated_offsets(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest repeated offset of each context (key, low, high, o1, o2, weight, around, left); smallest > largest if none is."""
    half = length // 2
    data, anchor, right = _around(batch)
    left = field(batch, "left").to_numpy().astype(np.int64)
    n = len(left)
    low, high = field(batch, "low").to_numpy().astype(np.int64), field(batch, "high").to_numpy().astype(np.int64)
    group = np.unique(field(batch, "key").to_numpy(), return_inverse=True)[1]
    data = np.r_[data, np.zeros(1, np.uint8)]
    span = np.arange(length)
    after = np.where(span < right[:, None], data[np.minimum(anchor[:, None] + span, len(data) - 1)], 0).astype(np.uint8)
    before = np.where(span[:half] < left[:, None], data[np.maximum(anchor[:, None] - 1 - span[:half], 0)], 0).astype(np.uint8)
    forward, backward = Sorted(after, right, group), Sorted(before, left, group)
    near_f, near_b = forward.nearest(), backward.nearest()
    first, last = np.full(n, half + 1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    # offsets beyond these have no partner on one side
    least, most = np.maximum(low, length - near_f), np.minimum(high, near_b)
    some = least <= most
    for d in range(int(least[some].min(initial=half)), int(most[some].max(initial=-1)) + 1):
        pick = np.flatnonzero((least <= d) & (d <= most))
        if len(pick) < 2:
            continue
        both = forward.classes(length - d)[pick] * (n + 1) + backward.classes(d)[pick]
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        hit = pick[order[np.r_[same, False] | np.r_[False, same]]]
        first[hit], last[hit] = np.minimum(first[hit], d), d
    return first, last


def sorted_out(items: DataFrame, length: int) -> DataFrame:
    """o1, o2, first, last of the contexts with a repeated offset; a key's contexts are at most MOST and meet in one task."""

    def settled(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids = np.stack([field(batch, "key").to_numpy(), field(batch, "o1").to_numpy(), field(batch, "o2").to_numpy()])
        order = np.lexsort(ids)
        new = np.r_[True, (ids[:, order[1:]] != ids[:, order[:-1]]).any(axis=0)]
        batch = batch.take(pa.array(order[new]))  # equal rows of a document bring the same context again
        first, last = repeated_offsets(batch, length)
        use = np.flatnonzero(first <= last)
        return pa.RecordBatch.from_arrays([field(batch, "o1").take(pa.array(use)), field(batch, "o2").take(pa.array(use)), pa.array(first[use].astype(np.int32)), pa.array(last[use].astype(np.int32))], names=["o1", "o2", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = field(batch, "key").to_numpy()
            if many >= TOGETHER:  # up to the last change of key all groups are whole
                edge = int(np.argmax(keys != keys[0])) if (keys != keys[0]).any() else -1
                previous = field(held[-1], "key")[-1].as_py()
                edge = 0 if previous != keys[0] else edge
                if edge >= 0:
                    if edge:
                        held.append(batch.slice(0, edge))
                    yield settled(held)
                    held, many, batch = [], 0, batch.slice(edge)
            held.append(batch)
            many += batch.num_rows
        if held:
            yield settled(held)

    dealt = items.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "o1 long, o2 long, first int, last int")


def repeated_ranges(found: DataFrame, length: int, most: int, bases: list[int] = BASES) -> DataFrame:
    """o1, o2, first, last: smallest and largest repeated offset of the contexts that have one."""
    columns = ["key", "low", "high", "o1", "o2", "weight", "around", "left"]
    items = found.select(F.col("inner").alias("key"), "n", F.lit(0).alias("low"), F.lit(length // 2).alias("high"), *columns[3:])
    out, scratch = [], []
    while True:
        out.append(stored(sorted_out(items.where(F.col("n") <= most).select(columns), length)))
        large = items.where(F.col("n") > most)
        # equal texts under one id bring a context twice, which is no repetition of its own
        whole = large.where("low = high").select("o1", "o2", F.col("low").alias("first"), F.col("high").alias("last"))
        out.append(stored(whole.distinct()))
        parts, counts = grouped(large.where("low < high").dropDuplicates(["key", "o1", "o2"]).select(columns[1:]), length, bases)
        forget(*scratch)
        scratch = [parts]
        if counts.isEmpty():
            forget(parts)
            break
        items = stored(keyed_join(parts, counts, "key", "k").select(*columns, "n"))
        scratch.append(items)
    every = out[0]
    for t in out[1:]:
        every = every.unionByName(t)
    return every


def without_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text), and the kept bytes if asked for."""
    half = length // 2
    rows = keyed(docs)
    seen = anchor_uses(rows, length).groupBy(F.col("inner").alias("i")).agg(F.sum("uses").alias("n")).where("n > 1").select("i")
    seen = stored(seen)
    alive = stored(keyed_join(anchored(rows, length), seen, "inner", "i", "left_semi"))
    forget(seen)
    kinds = alive.groupBy("inner", "o1", "o2").agg(F.sum("uses").alias("weight"), *(F.first(c).alias(c) for c in ("kid", "kth", "place")))
    kinds = stored(kinds)
    open_ = kinds.groupBy(F.col("inner").alias("i")).agg(F.min("weight").alias("least"), F.count("*").alias("n")).where("least = 1 and n > 1").select("i", "n")
    found = stored(contexts(keyed_join(kinds, open_, "inner", "i").select("kid", "kth", "place", "inner", "n", "o1", "o2", "weight"), rows, length))
    partly = repeated_ranges(found, length, most)
    whole = kinds.where("weight > 1").select("o1", "o2", F.lit(0).alias("first"), F.lit(half).alias("last"))
    settled = whole.unionByName(partly).groupBy(F.col("o1").alias("c1"), F.col("o2").alias("c2")).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    settled = stored(settled)
    forget(found, kinds)
    spans = alive.join(settled, (F.col("o1") == F.col("c1")) & (F.col("o2") == F.col("c2")))
    spans = spans.dropDuplicates(["kid", "kth", "o1", "o2"])  # equal rows have equal spans
    spans = spans.groupBy(F.col("kid").alias("k1"), F.col("kth").alias("k2")).agg(F.collect_list(F.struct("places", "first", "last")).alias("spans"))  # of one text
    both = rows.join(spans, (F.col("kid") == F.col("k1")) & (F.col("kth") == F.col("k2")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for text, found_ in zip(field(batch, "text").to_pylist(), field(batch, "spans"), strict=True):
                raw = text.encode("utf-8")
                if not found_.is_valid:
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw))
                    continue
                inside = found_.values
                packed = inside.field("places")
                p = np.frombuffer(b"".join(packed.to_pylist()), dtype="<u4").astype(np.int64)
                many = np.diff(np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1]) // 4
                begins = np.maximum(p - np.repeat(inside.field("last").to_numpy(), many), 0)
                ends = np.minimum(p - np.repeat(inside.field("first").to_numpy(), many) + length, len(raw))
                delta = np.bincount(begins, minlength=len(raw) + 1) - np.bincount(ends, minlength=len(raw) + 1)
                gone = np.cumsum(delta[:-1]) > 0
                kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
            n, removed, runs, digest, kept = zip(*out, strict=True)
            columns = [field(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 200 bytes."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
