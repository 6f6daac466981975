"""Spelling variants: words one insertion, deletion or replacement apart, found by a trie of letter counts.

Letters fall into GROUPS groups, and a word's vector holds how many of its letters each group has.  One edit adds at most one
to one count (surplus) and takes at most one from another (deficit), so the partners of a word lie on few paths of a
trie whose levels are the word's length and then the counts of one group after the other.  A depth-first search
spends a budget of one surplus and one deficit along these paths; the words at the leaves it reaches are verified
letter by letter.  Each pair is looked for from one side only: from the shorter word, or, of words of equal length,
from the one with the surplus at the first count in which they differ (from the smaller one if none differs).

The trie is cut into blocks.  A node with more than `most` words is divided by its next count, so a block is the
subtree of a small node, or a part (by hash) of a leaf that is still too large.  Nodes that are divided are counted
in Spark, one level a job; there are at most DIVIDED of them on a level, whatever the number of words, and only they are
sent to the tasks.  A word is sent to every block that its budget reaches, with what is left of the budget; words
and searches go packed by block, and a block that many words search is copied for parts of them.

Results for special cases: null or empty texts have no words; without doc_id no letter is deleted; long texts are
read in pieces that end between words; words of any length are compared; equal rows count each time; counts over 255
of one letter group count as 255 in the trie, which only adds candidates; no words give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restora.llm.graph import forget, keyed_join, stored
from restora.llm.textkit import field, pieces, string_bytes

#: Letters of U+00C0 to U+00FF are two bytes, of which the first, 0xC3, begins no other letter.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_BETWEEN = re.compile(rb"[^a-z\xc3\x80-\xbf]")
#: Text handled at once, and different words held before they are passed on.
SLICE, HELD = 1 << 20, 200_000

GROUPS = 16
#: The order of the groups (a letter's Latin-1 code modulo GROUPS), those of common letters first.
_ORDER = np.array([5, 14, 9, 4, 1, 2, 3, 8, 15, 12, 13, 7, 0, 6, 11, 10])
_LEVEL = np.argsort(_ORDER)[np.arange(256) % GROUPS]
#: Words of a block, divided nodes of a level, searches of one copy of a block, and candidates searched for or verified at once.
MOST, DIVIDED, SEARCHES, AT_ONCE = 30_000, 2000, 500_000, 1 << 19

#: What is left of the budget: nothing spent between equal lengths, a deficit, nothing, a surplus towards longer words.
FRESH, DEFICIT, SPENT, LONGER = 0, 1, 2, 3
#: Moves: budget before, step of the count, budget after.
MOVES = ((FRESH, 1, DEFICIT), (DEFICIT, -1, SPENT), (LONGER, 1, SPENT))


def slices(raw: bytes, most: int = SLICE) -> Iterator[bytes]:
    """raw in parts of about `most` bytes that end between words."""
    at = 0
    while len(raw) - at > most:
        end = _BETWEEN.search(raw, at + most)
        if end is None:
            break
        yield raw[at : end.start()]
        at = end.start()
    yield raw[at:]


def misspelt(word: bytes, h: int) -> bytes:
    """word without its code point number h modulo length."""
    letters = word.decode("utf-8")
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode("utf-8")


def counted(docs: DataFrame, period: int = 97, least_length: int = 5, least: int = 3) -> DataFrame:
    """word, n of the words of docs (doc_id, text) after deletions; one in `period` of the runs of each document loses a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return rows

        for batch in pieces(batches):
            data, offsets = string_bytes(field(batch, "text"))
            for doc_id, a, b in zip(field(batch, "doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                start = None if doc_id is None else crc32(b"%d:" % doc_id)
                for part in slices(data[a:b].tobytes().lower()):
                    own: dict[bytes, int] = {}
                    for w in _RUN.findall(part):
                        own[w] = own.get(w, 0) + 1
                    for w, n in own.items():
                        if start is not None and not (h := crc32(w, start)) % period:
                            w = misspelt(w, h)
                        total[w] = total.get(w, 0) + n
                    if len(total) > HELD:
                        yield out()
        if total:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    words = rows.mapInArrow(run, "word string, n long").where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def vectors(flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Counts of the letter groups of n words, up to 255, from their letters and whose each letter is."""
    counts = np.bincount(owner * GROUPS + _LEVEL[flat], minlength=n * GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(n, GROUPS)


def keyed(words: DataFrame) -> DataFrame:
    """word, n and key: the length (4 bytes) and the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = [w.encode("latin-1") for w in field(batch, "word").to_pylist()]
            length = np.array([len(w) for w in letters], dtype=">u4")
            v = vectors(np.frombuffer(b"".join(letters), np.uint8), np.repeat(np.arange(len(letters)), length.astype(np.int64)), len(letters))
            key = np.concatenate([length.view(np.uint8).reshape(-1, 4), v], axis=1)
            yield pa.RecordBatch.from_arrays([field(batch, "word"), field(batch, "n"), pa.array([k.tobytes() for k in key], pa.binary())], names=["word", "n", "key"])

    return words.mapInArrow(run, "word string, n long, key binary")


class Top:
    """The nodes of the trie that are divided: for each level the sorted keys (parent * 256 + count) of such nodes, numbered in this order."""

    def __init__(self, nodes: list[tuple[bytes, int]], most: int):
        known: list[dict[bytes, int]] = [{} for _ in range(GROUPS + 1)]
        for key, _ in nodes:
            known[len(key) - 4][key] = 0
        self.lengths = np.array(sorted(int.from_bytes(k, "big") for k in known[0]), dtype=np.int64)
        number = {int(n).to_bytes(4, "big"): i for i, n in enumerate(self.lengths)}
        self.levels = []
        for level in known[1:]:
            keys = sorted((number[k[:-1]] * 256 + k[-1], k) for k in level)
            self.levels.append(np.array([k for k, _ in keys], dtype=np.int64))
            number = {k: i for i, (_, k) in enumerate(keys)}
        self.parts = np.array([-(-n // most) for k, n in sorted((k for k in nodes if len(k[0]) == GROUPS + 4), key=lambda k: number[k[0]])], dtype=np.int64)

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted in the sorted keys, -1 where they are missing."""
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def routed(self, length: np.ndarray, v: np.ndarray, state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, budget left, block) of all blocks that words of these vectors reach, towards words of this length.

        A block is the length, its depth, its counts and (for parts of a leaf) a number, in 23 bytes.
        """
        word, plus, minus = np.arange(len(v)), np.full(len(v), -1), np.full(len(v), -1)
        node = self.find(self.lengths, length)
        for depth in range(GROUPS + 1):
            here = node < 0
            yield word[here], state[here], self._block(length, v, word[here], plus[here], minus[here], depth)
            word, state, plus, minus, node = (x[~here] for x in (word, state, plus, minus, node))
            if not len(word) or depth == GROUPS:
                break
            count = v[word, depth].astype(np.int64)
            grown = [(word, state, plus, minus, node * 256 + count)]
            for before, step, after in MOVES:
                can = np.flatnonzero((state == before) & (count + step >= 0) & (count + step <= 255))
                moved = np.full(len(can), depth)
                grown.append((word[can], np.full(len(can), after), moved if step > 0 else plus[can], moved if step < 0 else minus[can], node[can] * 256 + count[can] + step))
            word, state, plus, minus, key = (np.concatenate(x) for x in zip(*grown, strict=True))
            node = self.find(self.levels[depth], key)
        for i in range(int(self.parts.max(initial=0))):  # leaves that are still too large
            own = np.flatnonzero(self.parts[node] > i) if len(node) else node
            block = self._block(length, v, word[own], plus[own], minus[own], GROUPS)
            block[:, 21:] = np.array([i + 1], dtype=">u2").view(np.uint8)
            yield word[own], state[own], block

    @staticmethod
    def _block(length: np.ndarray, v: np.ndarray, word: np.ndarray, plus: np.ndarray, minus: np.ndarray, depth: int) -> np.ndarray:
        out = np.zeros((len(word), 23), dtype=np.uint8)
        out[:, :4] = length[word].astype(">u4").view(np.uint8).reshape(-1, 4)
        out[:, 4] = depth
        out[:, 5 : 5 + depth] = v[word, :depth]
        for at, step in ((plus, 1), (minus, -1)):
            moved = np.flatnonzero(at >= 0)
            out[moved, 5 + at[moved]] = (out[moved, 5 + at[moved]].astype(np.int64) + step).astype(np.uint8)
        return out


def divided(words: DataFrame, most: int) -> Top:
    """Counts the nodes of the trie, level by level, as far as there are any with more than `most` words."""
    nodes: list[tuple[bytes, int]] = []
    for depth in range(GROUPS + 1):
        large = words.groupBy(F.substring("key", 1, 4 + depth).alias("k")).count().where(F.col("count") > most).collect()  # the words / most at most
        nodes += [(bytes(r.k), r["count"]) for r in large]
        if not large:
            break
    return Top(nodes, most)


_ROUTED = "block binary, copy int, role int, size long, letters binary, ns binary, states binary"


def route(words: DataFrame, top: Top) -> DataFrame:
    """Words (role 0) and searches (role 1: for words as long, 2: for longer ones), packed by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = np.array([w.encode("latin-1") for w in field(batch, "word").to_pylist()], dtype=object)
            ns = field(batch, "n").to_numpy()
            key = np.frombuffer(b"".join(field(batch, "key").to_pylist()), np.uint8).reshape(len(text), -1)
            length, v = key[:, :4].copy().view(">u4").reshape(-1).astype(np.int64), key[:, 4:]
            salt = np.array([crc32(w) for w in text], dtype=np.int64)
            for role, to, state in ((0, length, SPENT), (1, length, FRESH), (2, length + 1, LONGER)):
                found = [x for x in top.routed(to, v, np.full(len(text), state)) if len(x[0])]
                if not found:
                    continue
                word, left, block = (np.concatenate(x) for x in zip(*found, strict=True))
                if role == 0 and len(top.parts):  # a word is in one part of its leaf, a search goes to all
                    part = block[:, 21:].copy().view(">u2").reshape(-1).astype(np.int64)
                    whole = np.zeros(len(text), dtype=np.int64)
                    np.maximum.at(whole, word, part)
                    keep = (part == 0) | (part - 1 == salt[word] % np.maximum(whole[word], 1))
                    word, left, block = word[keep], left[keep], block[keep]
                name = np.ascontiguousarray(block).view("V23").reshape(-1)
                order = np.argsort(name, kind="stable")
                edge = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
                rows = []
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
                    own = word[order[a:b]]
                    rows.append((name[order[a]].tobytes(), 0, role, b - a, b"".join(text[own]), ns[own].astype("<i8").tobytes(), left[order[a:b]].astype(np.uint8).tobytes()))
                kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _ROUTED.split(", ")])

    return words.mapInArrow(run, _ROUTED)


class Trie:
    """The words of a block: a table of children for each level below the block's node, and the words of each leaf."""

    def __init__(self, letters: np.ndarray, ns: np.ndarray, depth: int):
        order = np.lexsort(letters.T[::-1])
        self.letters, self.ns, self.depth = letters[order], ns[order], depth
        v = matrix_vectors(self.letters)
        node, self.children = np.zeros(len(v), dtype=np.int64), []
        for level in range(depth, GROUPS):
            keys, node = np.unique(node * 256 + v[:, level], return_inverse=True)
            self.children.append(keys)
        self.by_leaf = np.argsort(node, kind="stable")
        size = np.bincount(node, minlength=1)
        self.begin, self.size = np.cumsum(size) - size, size

    def leaves(self, v: np.ndarray, state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word searched for, budget left, leaf) by a depth-first search that takes many words along a level together."""
        stack = [(0, np.arange(len(v)), state.astype(np.int64), np.zeros(len(v), dtype=np.int64))]
        while stack:
            level, word, left, node = stack.pop()
            if level == len(self.children):
                yield word, left, node
                continue
            if len(word) > AT_ONCE:
                half = len(word) // 2
                stack += [(level, word[half:], left[half:], node[half:]), (level, word[:half], left[:half], node[:half])]
                continue
            count = v[word, self.depth + level].astype(np.int64)
            grown = [(word, left, node * 256 + count)]
            for before, step, after in MOVES:
                can = np.flatnonzero((left == before) & (count + step >= 0) & (count + step <= 255))
                grown.append((word[can], np.full(len(can), after), node[can] * 256 + count[can] + step))
            word, left, key = (np.concatenate(x) for x in zip(*grown, strict=True))
            node = Top.find(self.children[level], key)
            there = node >= 0
            if there.any():
                stack.append((level + 1, word[there], left[there], node[there]))


def matrix_vectors(letters: np.ndarray) -> np.ndarray:
    return vectors(letters.reshape(-1), np.repeat(np.arange(len(letters)), letters.shape[1]), len(letters))


def near_pairs(trie: Trie, letters: np.ndarray, state: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """(word searched for, word of the trie) one edit apart."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    n = letters.shape[1]
    most = max(1, (AT_ONCE * 8) // max(n, 1))
    for word, left, leaf in trie.leaves(matrix_vectors(letters), state):
        size = trie.size[leaf]
        end = np.cumsum(size)
        start = 0
        while start < len(word):
            stop = max(start + 1, int(np.searchsorted(end, (end[start - 1] if start else 0) + most, "right")))
            own = slice(start, stop)
            q = np.repeat(word[own], size[own])
            w = trie.by_leaf[np.arange(len(q)) - np.repeat(np.cumsum(size[own]) - size[own], size[own]) + np.repeat(trie.begin[leaf[own]], size[own])]
            fresh = np.repeat(left[own] == FRESH, size[own])
            start = stop
            for k in range(0, len(q), most):
                a, b = q[k : k + most], w[k : k + most]
                if longer:
                    head, tail = letters[a] == trie.letters[b][:, :-1], letters[a] == trie.letters[b][:, 1:]
                    before = np.where(head.all(axis=1), n, head.argmin(axis=1))
                    after = np.where(tail.all(axis=1), n, tail[:, ::-1].argmin(axis=1))
                    near = before + after >= n
                else:
                    differ = letters[a] != trie.letters[b]
                    near = differ.sum(axis=1) == 1
                    at = differ.argmax(axis=1)
                    # words of equal vectors find each other: the smaller one reports the pair
                    near &= ~fresh[k : k + most] | (letters[a, at] < trie.letters[b, at])
                out.append((a[near], b[near]))
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return a, b


def _summed(owner: np.ndarray, other: np.ndarray, owners: list[bytes], others: list[bytes], other_ns: np.ndarray, rank: np.ndarray) -> list[tuple]:
    """(word, near words, largest n of them, the smallest such word) of every owner; rank: the order of the others."""
    order = np.lexsort((rank[other], -other_ns[other], owner))
    first = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]])
    many = np.diff(np.r_[first, len(order)])
    return [(owners[owner[i]], int(n), int(other_ns[other[i]]), others[other[i]]) for i, n in zip(order[first].tolist(), many.tolist(), strict=True)]


def search(routed: DataFrame) -> DataFrame:
    """word, n_near, near_n, near of each word and the near words that one block has for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, trie, texts = None, [], None, []
        for batch in batches:
            for block, copy, role, size, letters, ns, states in zip(*(field(batch, x.split()[0]).to_pylist() for x in _ROUTED.split(", ")), strict=True):
                if (block, copy) != now:
                    now, held, trie = (block, copy), [], None
                length, depth = int.from_bytes(block[:4], "big"), block[4]
                if role == 0:
                    held.append((np.frombuffer(letters, np.uint8).reshape(size, length), np.frombuffer(ns, "<i8")))
                    continue
                if not held:
                    continue  # nothing is there
                if trie is None:
                    trie = Trie(*(np.concatenate(x) for x in zip(*held, strict=True)), depth)
                    texts = [w.tobytes() for w in trie.letters]
                own = np.frombuffer(letters, np.uint8).reshape(size, length - (role == 2))
                own_ns = np.frombuffer(ns, "<i8")
                a, b = near_pairs(trie, own, np.frombuffer(states, np.uint8), role == 2)
                if not len(a):
                    continue
                words = [w.tobytes() for w in own]
                rank = np.empty(len(own), dtype=np.int64)
                rank[np.lexsort(own.T[::-1])] = np.arange(len(own))
                rows = _summed(a, b, words, texts, trie.ns, np.arange(len(texts))) + _summed(b, a, texts, words, own_ns, rank)
                yield pa.RecordBatch.from_arrays([pa.array([r[0].decode("latin-1") for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([r[3].decode("latin-1") for r in rows])], names=["word", "n_near", "near_n", "near"])

    return routed.mapInArrow(run, "word string, n_near long, near_n long, near string")


def neighbours(words: DataFrame, most: int = MOST, searches: int = SEARCHES) -> DataFrame:
    """word, n_near, near_n, near for the words (word, n) that have near ones: their number, and the commonest of them."""
    words = stored(keyed(words))
    packed = stored(route(words, divided(words, max(most, words.count() // DIVIDED))))
    routed = packed
    load = routed.where("role > 0").groupBy("block").agg(F.sum("size").alias("load"))
    total = load.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    share = max(searches, total // DIVIDED)
    # at most DIVIDED blocks have more than their share of all searches
    hot = F.broadcast(load.where(F.col("load") > share).select("block", F.ceil(F.col("load") / share).cast("int").alias("copies")))
    routed = routed.join(hot, "block", "left")
    of = F.when(F.col("role") == 0, F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).otherwise(F.array(F.pmod(F.hash("letters"), F.coalesce("copies", F.lit(1))).cast("int")))
    routed = routed.withColumn("copy", F.explode(of)).select(*[x.split()[0] for x in _ROUTED.split(", ")])
    parts = max(1, -(-total // searches))
    dealt = routed.repartition(parts, "block", "copy").sortWithinPartitions("block", "copy", "role")
    best = F.min(F.struct((-F.col("near_n")).alias("down"), "near"))
    found = search(dealt).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    found = stored(found.select("word", "n_near", (-F.col("best.down")).alias("near_n"), F.col("best.near").alias("near")))
    forget(words, packed)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """word, root for every word with a form (word, form): the last of the chain.  Each round doubles how far a word looks; a chain's counts double, so rounds are few."""
    table = now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        over = now.select(F.col("word").alias("over"), F.col("root").alias("next"))
        new = stored(keyed_join(now, over, "root", "over", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        forget(table)
        table, now = new, new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n): form is the commonest near word, if it is `factor` times as common."""
    words = stored(words)
    found = neighbours(words)
    near = found.withColumnRenamed("word", "of")
    is_form = F.col("near_n") >= factor * F.col("n")
    all_ = keyed_join(words, near, "word", "of", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    all_ = stored(all_)
    forget(words, found)
    ends = roots(all_.where("form is not null")).withColumnRenamed("word", "of")
    out = keyed_join(all_, ends, "word", "of", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among all words of at least 5 letters and 3 occurrences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(counted(docs))
