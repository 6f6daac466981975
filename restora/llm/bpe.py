"""Byte-level BPE with a hierarchical-bitmap rank queue.

The pattern splits a text into pre-tokens; each is merged on its own.  Adjacent pairs wait in buckets,
one for each merge rank, that hold positions of a linked list.  Two levels of 256-bit words say which
buckets are in use, so finding the lowest rank is two find-first-set steps.  An entry whose pair has
changed since is stale and skipped.  A pre-token of n bytes takes O(n log n) however long it is.

Results for special cases: null or empty text has no tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from restora.llm.textkit import field, pieces

#: Pre-tokens that a worker remembers in each of two generations.
REMEMBERED = 400_000
BIT = [1 << i for i in range(256)]


class BytePairCoder:
    """Encodes and decodes with the ranks of a tiktoken file."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import regex

        with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.decimal = {r: str(r) for r in self.bytes_of}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token.  The queue is inlined: a Python call for every entry would cost more than the work."""
        rank_of = self.ranks.get
        if (whole := rank_of(piece)) is not None:
            return (whole,)
        n = len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        waiting = [-1] * (n + 1)  # rank of the pair that begins here, as last pushed
        buckets: dict[int, int | list[int]] = {}  # rank: its position, or a heap of them
        words: dict[int, int] = {}  # number of a bitmap word: its bits
        used = 0  # which words have bits
        fresh = [(rank_of(piece[i : i + 2]), i) for i in range(n - 1)]
        while True:
            for r, i in fresh:
                if r is None:
                    waiting[i] = -1
                    continue
                waiting[i] = r
                held = buckets.get(r)
                if held is None:
                    buckets[r] = i
                    w = r >> 8
                    if w in words:
                        words[w] |= BIT[r & 255]
                    else:
                        words[w] = BIT[r & 255]
                    used |= BIT[w]
                elif type(held) is int:
                    buckets[r] = [held, i] if held < i else [i, held]
                else:
                    heappush(held, i)
            while used:  # find-first-set on both levels, until an entry is not stale
                w = (used & -used).bit_length() - 1
                word = words[w]
                low = word & -word
                r = (w << 8) + low.bit_length() - 1
                held = buckets[r]
                if type(held) is not int and len(held) > 1:
                    i = heappop(held)
                else:
                    i = held if type(held) is int else held[0]
                    del buckets[r]
                    if word == low:
                        del words[w]
                        used ^= BIT[w]
                    else:
                        words[w] = word ^ low
                if waiting[i] == r:
                    break
            else:
                break
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            waiting[i] = waiting[j] = -1
            h = before[i]
            fresh = [(rank_of(piece[i : after[k]]), i)] if k < n else []
            if h >= 0:
                fresh.append((rank_of(piece[h:k]), h))
        out, i = [], 0
        while i < n:
            k = after[i]
            out.append(self.ranks[piece[i:k]])
            i = k
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        parts = self.split(text)
        young, old, long = self.young, self.old, {}
        for part in set(parts).difference(young):
            ids = old.get(part)
            if ids is None:
                ids = self.merge(part.encode("utf-8"))
            (young if len(part) <= 64 else long)[part] = ids
        if long:  # not worth remembering
            out = [x for part in parts for x in (long[part] if part in long else young[part])]
        else:
            out = list(chain.from_iterable(map(young.__getitem__, parts)))
        if len(young) > REMEMBERED:
            self.old, self.young = young, {}
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODERS: dict[str | None, BytePairCoder] = {}


def coder(path: str | None = None) -> BytePairCoder:
    if path not in _CODERS:
        _CODERS[path] = BytePairCoder(path)
    return _CODERS[path]


def encoded(docs: DataFrame, vocabulary_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text), and the ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary_path)
        for batch in pieces(batches):
            counts, digests, decoded, lists = [], [], [], []
            for text in field(batch, "text").to_pylist():
                ids = bpe.encode(text or "")
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                lists.append(ids if with_ids else None)
            columns = [field(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes of every document."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
