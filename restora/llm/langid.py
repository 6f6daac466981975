"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The probability of a
word is the sum over all its segmentations into pieces, found by a forward pass; a text's is the
product over its words.  Probabilities are learned by expectation-maximisation: every task counts the
words of its documents, runs forward-backward on its distinct words and emits expected piece counts
per language; Spark adds them up.  Only tables of (language, piece), bounded by the vocabulary, reach
the driver.

Results for special cases: null text, or text without a letter: ``und`` with score 0.  If there are no
labelled training rows every text is ``und``.  Ties go to the alphabetically first language.  Words of any
length are scored whole: those over `LONG` bytes by a forward pass that keeps as many places as the longest
piece has bytes.  A null doc_id is not held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restora.llm.textkit import Words, field, pieces, string_bytes

#: Longest word, in bytes, whose forward values are all kept; what probabilities are multiplied by for each byte; forward values and bytes of text at once; bytes cut into words at once; places of a long word at once.
LONG, SCALE, VALUES, BATCH_BYTES, CUT_BYTES, PLACES = 40, 32.0, 1 << 20, 4 << 20, 512 << 10, 4096
_LETTER = re.compile(r"[^\W\d_]")


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of a sentencepiece model, by id."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


class Lattice:
    """All segmentations of byte strings into pieces of the vocabulary, its byte pieces included.

    The pieces stand in a trie whose inner nodes come first, each with a row of 256 children, so that a
    step of many words at once is one array look-up.
    """

    def __init__(self, path: str | None = None):
        names = vocabulary(path)
        self.size = len(names)
        spelled = {}
        for i, p in enumerate(names):
            if re.fullmatch(r"<0x[0-9A-F]{2}>", p):
                spelled[bytes([int(p[3:5], 16)])] = i
        for i, p in enumerate(names):
            if not re.fullmatch(r"<.*>", p):
                spelled[p.encode()] = i  # a piece of one byte replaces the byte's fallback
        inner = {s[:k] for s in spelled for k in range(len(s))}
        order = sorted(inner, key=len) + sorted(set(spelled) - inner)
        number = {s: k for k, s in enumerate(order)}
        self.inner = len(inner)
        self.next = np.full(self.inner * 256, -1, dtype=np.int32)
        self.piece = np.full(len(order), -1, dtype=np.int32)
        for s, k in number.items():
            if s:
                self.next[number[s[:-1]] * 256 + s[-1]] = k
            self.piece[k] = spelled.get(s, -1)
        self.longest = max(map(len, spelled))

    def _from(self, columns: np.ndarray, i: int, word: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(to, words, pieces) of what fits in byte columns from place i on."""
        node = np.zeros(len(word), dtype=np.int32)
        for j in range(i, len(columns)):
            if not len(word):
                return
            node = self.next[node * 256 + columns[j][word]]
            piece = self.piece[node]
            hit = (node >= 0) & (piece >= 0)
            yield j + 1, word[hit], piece[hit]
            go = (node >= 0) & (node < self.inner)
            word, node = word[go], node[go]

    def edges(self, rows: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, words, pieces) of everything that fits in zero-padded byte rows; each word once in an entry."""
        columns = np.ascontiguousarray(rows.T)
        return [(i, *x) for i in range(len(columns)) for x in self._from(columns, i, np.flatnonzero(lengths > i))]

    def _forward(self, rows: np.ndarray, lengths: np.ndarray, p: np.ndarray):
        edges = self.edges(rows, lengths)
        alpha = np.zeros((rows.shape[1] + 1, len(rows), p.shape[1]))
        alpha[0] = 1
        for i, j, word, piece in edges:  # by start: all that ends at i is in
            alpha[j, word] += alpha[i, word] * (p[piece] * SCALE ** (j - i))
        return edges, alpha, np.maximum(alpha[lengths, np.arange(len(rows))], 1e-300)

    def forward(self, rows: np.ndarray, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log of the summed probability of each word in each language."""
        total = self._forward(rows, lengths, p)[-1]
        return np.log(total) - lengths[:, None] * np.log(SCALE)

    def _fits(self, word: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bytes, places, pieces) of all pieces that fit at places begin..end-1 of one word."""
        at = np.arange(begin, end)
        node = np.zeros(len(at), dtype=np.int32)
        for k in range(1, self.longest + 1):
            inside = at + k <= len(word)
            at, node = at[inside], node[inside]
            node = self.next[node * 256 + word[at + k - 1]]
            piece = self.piece[node]
            hit = (node >= 0) & (piece >= 0)
            yield k, at[hit], piece[hit]
            go = (node >= 0) & (node < self.inner)
            at, node = at[go], node[go]

    def _chain(self, word: np.ndarray, p: np.ndarray, back: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(values, logs of what they are scaled by) of a forward pass over one word of any length, from its last byte if `back`; some places at a time."""
        n, kinds, most = len(word), p.shape[1], self.longest
        ring, log = np.zeros((most, kinds)), np.zeros(kinds)
        ring[-1] = 1
        yield ring[-1:].copy(), log[None, :].copy()
        for done in range(0, n, PLACES):
            size = min(PLACES, n - done)
            ways = np.zeros((size, most, kinds))
            low, high = (n - done - size, n - done) if back else (max(0, done + 1 - most), done + size)
            for k, at, piece in self._fits(word, low, high):
                to = (n - at if back else at + k) - done - 1
                own = (to >= 0) & (to < size)
                ways[to[own], most - k] = p[piece[own]] * SCALE**k
            values, logs = np.zeros((most + size, kinds)), np.empty((size, kinds))
            values[:most] = ring
            shown = np.empty((size, kinds))
            for r in range(size):
                values[most + r] = shown[r] = np.einsum("kl,kl->l", values[r : r + most], ways[r])
                logs[r] = log
                if r % 16 == 15 or r == size - 1:
                    scale = np.maximum(values[r + 1 : r + 1 + most].max(axis=0), 1e-250)
                    values[r + 1 : r + 1 + most] /= scale
                    log = log + np.log(scale)
            ring = values[size:].copy()
            yield shown, logs

    def forward_long(self, rows: np.ndarray, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
        """As forward, for words of any length, one after another."""
        out = np.zeros((len(rows), p.shape[1]))
        for k, n in enumerate(lengths.tolist()):
            for value, log in self._chain(rows[k, :n], p):
                out[k] = np.log(np.maximum(value[-1], 1e-300)) + log[-1]
        return out - lengths[:, None] * np.log(SCALE)

    def expected_long(self, rows: np.ndarray, lengths: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """As expected, for words of any length, one after another."""
        out = np.zeros((self.size, p.shape[1]))
        for k, n in enumerate(lengths.tolist()):
            alpha, beta = (np.concatenate([np.log(np.maximum(v, 1e-300)) + g for v, g in self._chain(rows[k, :n], p, back)]) for back in (False, True))
            for size, at, piece in self._fits(rows[k, :n], 0, n):
                flow = np.exp(np.minimum(alpha[at] + beta[n - at - size] + np.log(p[piece] * SCALE**size) - alpha[n], 0)) * counts[k]
                for j in range(p.shape[1]):
                    out[:, j] += np.bincount(piece, weights=flow[:, j], minlength=self.size)
        return out

    def expected(self, rows: np.ndarray, lengths: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, by language, in `counts` (words x languages) uses of the words."""
        edges, alpha, total = self._forward(rows, lengths, p)
        beta = np.zeros_like(alpha)
        beta[lengths, np.arange(len(rows))] = counts / total
        out = np.zeros((self.size, p.shape[1]))
        for i, from_i in groupby(reversed(edges), itemgetter(0)):
            flows = []
            for _, j, word, piece in from_i:
                flow = p[piece] * SCALE ** (j - i) * beta[j, word]
                beta[i, word] += flow
                flow *= alpha[i, word]
                flows.append((piece, flow))
            piece, flow = (np.concatenate(x) for x in zip(*flows, strict=True))
            for k in range(p.shape[1]):
                out[:, k] += np.bincount(piece, weights=flow[:, k], minlength=self.size)
        return out


_MARK = np.frombuffer("▁".encode(), dtype=np.uint8)


class Spelled:
    """The different words of a batch, each with the mark of a word's begin; rows of about `CUT_BYTES` are cut into words at once."""

    def __init__(self, column: pa.Array):
        self.data, offsets = string_bytes(pc.utf8_lower(column))
        found, row = [], 0
        while row < len(column) or not found:
            end = max(int(np.searchsorted(offsets, offsets[row] + CUT_BYTES, side="right")) - 1, min(row + 1, len(column)))
            at = offsets[row]
            words = Words(self.data[at : offsets[end]], offsets[row : end + 1] - at, lower=False)
            found.append((words.hash, *(x.astype(np.int32) for x in (words.start + at, words.end - words.start, words.doc + row))))
            row = end
        value, start, lengths, self.doc = (np.concatenate(x) for x in zip(*found, strict=True))
        del found, words
        _, first, self.which = np.unique(value, return_index=True, return_inverse=True)
        self.begin, self.n = start[first].astype(np.int64), len(first)
        self.lengths = lengths[first].astype(np.int64) + len(_MARK)

    def rows(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Zero-padded bytes and lengths of some words."""
        lengths, begin = self.lengths[part], self.begin[part]
        place = np.arange(int(lengths.max(initial=0)))[None, :]
        at = np.clip(begin[:, None] + place - len(_MARK), 0, max(len(self.data) - 1, 0))
        rows = np.where(place < lengths[:, None], self.data[at], 0).astype(np.uint8)
        rows[:, : len(_MARK)] = _MARK
        return rows, lengths

    def blocks(self, kinds: int, long: int = LONG) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        """(word numbers, bytes, lengths, whether they are long); at most `VALUES` forward values of `kinds` languages unless one word has more; padding at most doubles the bytes of long words."""
        order = np.argsort(self.lengths, kind="stable")
        lengths = self.lengths[order]
        edge, k = int(np.searchsorted(lengths, long, side="right")), 0
        while k < edge:
            near = lengths[k : min(edge, k + max(1, VALUES // kinds))]
            values = (near + 1) * np.arange(1, len(near) + 1) * kinds  # of a block that ends there
            end = k + max(1, int(np.searchsorted(values, VALUES, side="right")))
            part = order[k:end]
            yield part, *self.rows(part), False
            k = end
        while edge < len(order):
            most = 2 * lengths[edge]
            end = min(int(np.searchsorted(lengths, most, side="right")), edge + max(1, (1 << 18) // int(most)))
            part = order[edge:end]
            yield part, *self.rows(part), True
            edge = end

    def scores(self, net: Lattice, p: np.ndarray, long: int = LONG) -> np.ndarray:
        """log probabilities (words x languages) of the different words."""
        out = np.zeros((self.n, p.shape[1]))
        for part, rows, lengths, is_long in self.blocks(p.shape[1], long):
            out[part] = (net.forward_long if is_long else net.forward)(rows, lengths, p)
        return out


_LATTICES: dict[str | None, Lattice] = {}


def lattice(path: str | None) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def start_probabilities(path: str | None, languages: int) -> np.ndarray:
    """Where learning starts: the vocabulary lists common pieces first, so a Zipf curve over ids."""
    n = lattice(path).size
    p = 1.0 / (np.arange(n) + 200.0)
    return np.repeat((p / p.sum())[:, None], languages, axis=1)


def expected_counts(batches: Iterator[pa.RecordBatch], languages: list[str], p: np.ndarray, path: str | None) -> Iterator[pa.RecordBatch]:
    """Rows (lang number, piece, expected count) of the words of (text, lang) batches."""
    net, number = lattice(path), {x: k for k, x in enumerate(languages)}
    total = np.zeros((net.size, len(languages)))
    for batch in pieces(batches, most=BATCH_BYTES):
        s = Spelled(field(batch, "text"))
        lang = np.array([number[x] for x in field(batch, "lang").to_pylist()], dtype=np.int64)
        uses = np.zeros((s.n, len(languages)))
        np.add.at(uses, (s.which, lang[s.doc]), 1.0)
        for part, rows, lengths, is_long in s.blocks(len(languages)):
            total += (net.expected_long if is_long else net.expected)(rows, lengths, uses[part], p)
    piece, lang = np.nonzero(total > 1e-9)
    yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, lang])], names=["lang_no", "piece", "n"])


def learn(training: DataFrame, documents_per_language: int = 1500, iterations: int = 2, smoothing: float = 0.05, vocabulary_path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and probabilities (pieces x languages) from rows (doc_id, text, lang) with non-null lang.

    `documents_per_language` bounds the labelled sample: of a language with more documents, those with
    the smallest hashes of doc_id are used, about that many.
    """
    rows = training.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((0, 0))
    share = F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, documents_per_language / sizes[x]))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("text", "lang")
    p = start_probabilities(vocabulary_path, len(languages))
    for _ in range(iterations):
        shared = rows.sparkSession.sparkContext.broadcast(p)  # vocabulary x languages

        def step(batches, shared=shared):
            return expected_counts(batches, languages, shared.value, vocabulary_path)

        counts = sample.mapInArrow(step, "lang_no int, piece int, n double").groupBy("lang_no", "piece").agg(F.sum("n").alias("n")).collect()
        p = np.full_like(p, smoothing)
        for r in counts:
            p[r.piece, r.lang_no] += r.n
        p /= p.sum(axis=0)
        shared.unpersist()
    return languages, p


def predict(docs: DataFrame, languages: list[str], p: np.ndarray, vocabulary_path: str | None = None) -> DataFrame:
    """Columns of docs plus lang_pred and score (posterior of lang_pred under equal priors)."""
    from pyspark.sql import types as T

    clash = [c for c in docs.columns if c in ("lang_pred", "score")]
    docs = docs.drop(*clash)
    shared = docs.sparkSession.sparkContext.broadcast((languages, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, p = shared.value
        net = lattice(vocabulary_path)
        for batch in pieces(batches, most=BATCH_BYTES):
            n = batch.num_rows
            total = np.zeros((n, max(len(languages), 1)))
            if languages:
                s = Spelled(field(batch, "text"))
                if len(s.which):
                    begin = np.flatnonzero(np.r_[True, np.diff(s.doc) != 0])
                    total[s.doc[begin]] = np.add.reduceat(s.scores(net, p)[s.which], begin, axis=0)
            lettered = [bool(languages) and t is not None and _LETTER.search(t) is not None for t in field(batch, "text").to_pylist()]
            best = total.argmax(axis=1)
            posterior = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            names = [languages[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)]
            scores = np.where(lettered, posterior, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the rows not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    languages, p = learn(docs.where(~held_out))
    out = predict(docs.select("doc_id", held_out.alias("held_out"), "text"), languages, p)
    return out.select("doc_id", "held_out", "lang_pred", "score")
