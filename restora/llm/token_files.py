"""Token ids as canonical length-limited Huffman files.

Writing: documents are encoded, dealt by ranges of doc_id and sorted; global counts of ids give code
lengths of at most 16 bits (package-merge), and canonical codes follow from the lengths.  Each block is
a row of a Parquet dataset with its own bit stream, so blocks are read independently; every 64th id's
bit offset is a checkpoint.  The code book is one more row group beside it.

Reading: a table of 65,536 entries turns the next 16 bits into an id and a length; all checkpoints of a
block decode side by side.

A block holds whole documents, of `BLOCK_IDS` ids together or one longer document.  Encoding goes by
words between ASCII white space, and parts of words where the tokenizer's pattern always parts them, in
lower case: its normaliser and pattern never look across these places, so ids of a text are those of
its words in turn, and a task encodes each different word once by the library.

Results for special cases: null or empty text has the end id alone; documents with equal doc_id follow
one another in order of their texts' hashes (null ids come first); an empty table gives no files' rows
and no result rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restora.llm.graph import cut, shared_folder
from restora.llm.textkit import LOWER, field, pieces, string_bytes

LIMIT, BLOCK_IDS, CHECKPOINT, PARTITION_BYTES, REMEMBERED = 16, 65_536, 64, 24 << 20, 400_000
#: Bytes of text encoded at once.
ENCODED = 8 << 20


#: Runs of letters, single digits and runs of marks: between these the tokenizer's pattern always parts a text.  Letters are those up to
#: U+00FF (0xC3 and the byte after it, but for two signs); apostrophes, with which endings begin, and what special ids are written with
#: belong to none.
_RUNS = re.compile(rb"[a-zA-Z\xc3\x80-\xbf]+|[0-9]|[!-&(-;=?-@\[-`{}~]+")
#: The same with the ends of words that are parted together.
_RUNS_AND_ENDS = re.compile(rb"[a-zA-Z\xc3\x80-\xbf]+|[0-9]|[!-&(-;=?-@\[-`{}~]+|\n")
#: All bytes of such runs: a word that has nothing else can be parted.
_PARTABLE = bytes(i for i in range(256) if _RUNS.fullmatch(bytes([i])))
_LETTERS = bytes([*range(97, 123), 0xC3, *range(0x80, 0xC0)])
_SIGNS = b"\xc3\x97", b"\xc3\xb7"


def partable(word: bytes) -> bool:
    """Whether a word is made of nothing but runs."""
    return not word.translate(None, _PARTABLE) and not (b"\xc3" in word and (_SIGNS[0] in word or _SIGNS[1] in word))


class WordEncoder:
    """ids of whole texts as little-endian 16-bit bytes."""

    def __init__(self, path: str | None, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids of over 16 bits")
        self.ends = np.zeros(1 << 16, dtype=bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.end = np.uint16(end_id).tobytes()
        self.words, self.parts = Memory(), Memory()

    def _learn(self, words: list[bytes]) -> None:
        """Encodes parts of words by a few calls: one call for many is much cheaper than a call for each."""
        plain = [not w.translate(None, _LETTERS) and not (_SIGNS[0] in w or _SIGNS[1] in w) for w in words]
        for kind in (True, False):
            of_kind = list(compress(words, plain) if kind else compress(words, map(not_, plain)))
            for k in range(0, len(of_kind), 8192):
                part = of_kind[k : k + 8192]
                joined = b"\n".join(part).decode("utf-8")
                if kind:  # each is one match of the pattern, so its last id ends a word and no other does
                    ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u2")
                    edge = np.r_[0, np.flatnonzero(self.ends[ids]) + 1]
                else:
                    found = self.library.encode(joined, add_special_tokens=False)
                    ids = np.array(found.ids, dtype="<u2")
                    place = np.fromiter((o[0] for o in found.offsets), dtype=np.int64, count=len(ids))
                    edge = np.searchsorted(place, np.cumsum([0, *(len(x.decode("utf-8")) + 1 for x in part)]))
                if len(edge) != len(part) + 1 or edge[-1] != len(ids):
                    raise ValueError("ids do not fall into words")
                self.parts.young.update(zip(part, cut_up(ids.tobytes(), 2 * edge), strict=True))

    def _learn_words(self, new: list[bytes]) -> None:
        """ids of new words from those of their parts."""
        simple = list(map(partable, new))
        known = self.words.young
        for k in range(0, len(new), 65_536):
            some, ok = new[k : k + 65_536], simple[k : k + 65_536]
            parted_, whole = list(compress(some, ok)), list(compress(some, map(not_, ok)))
            tokens = _RUNS_AND_ENDS.findall(b"\n".join([*parted_, b""]))
            wanted = {*tokens, *whole}
            wanted.discard(b"\n")
            self._learn(self.parts.unknown(wanted))
            of = self.parts.young
            of[b"\n"] = b""
            ids = list(map(of.__getitem__, tokens))
            del of[b"\n"]
            size = np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
            ends = np.fromiter((t == b"\n" for t in tokens), dtype=bool, count=len(tokens))
            known.update(zip(parted_, cut_up(b"".join(ids), np.r_[0, size[ends]]), strict=True))
            known.update(zip(whole, map(of.__getitem__, whole), strict=True))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """ids of each text (null: empty), with the end id."""
        data, offsets = string_bytes(texts)
        lower = LOWER[data]
        marked = pc.match_substring(texts, "<|")
        if pc.any(marked).as_py():  # the names of special ids count as they are written
            kept = np.repeat(pc.fill_null(marked, False).to_numpy(zero_copy_only=False), np.diff(offsets))
            lower[kept] = data[kept]
        own = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(lower))
        split = pc.ascii_split_whitespace(own)
        coded = split.flatten().dictionary_encode()
        spelled, place = string_bytes(coded.dictionary)
        words = cut_up(spelled.tobytes(), place)
        self._learn_words(self.words.unknown(set(words) - {b""}))
        known = self.words.young
        raw = [known[w] if w else b"" for w in words]
        table = np.frombuffer(b"".join(raw), dtype="<u2")
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 2
        begin = np.cumsum(size) - size
        code = coded.indices.to_numpy()
        n = size[code]
        end = np.cumsum(n)
        at = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(begin[code] - (end - n), n)
        stream = table[at].tobytes()
        edge = np.r_[0, end][split.offsets.to_numpy() - split.offsets[0].as_py()]
        self.words.age()
        self.parts.age()
        return [x + self.end for x in cut_up(stream, 2 * edge)]


def cut_up(raw: bytes, edges: np.ndarray) -> list[bytes]:
    """raw between each edge and the next."""
    at = edges.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]  # noqa: B905


class Memory:
    """What has been seen of late: up to twice REMEMBERED entries and those of one batch."""

    def __init__(self):
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def unknown(self, keys: set[bytes]) -> list[bytes]:
        """Keys that are not remembered; the others are young from now on."""
        out = keys - self.young.keys()
        if self.old:
            back = out & self.old.keys()
            self.young.update((k, self.old[k]) for k in back)
            out -= back
        return list(out)

    def age(self) -> None:
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}


_ENCODERS: dict[tuple, WordEncoder] = {}


def token_ids(docs: DataFrame, end_id: int = 2, vocabulary_path: str | None = None) -> DataFrame:
    """part, doc_id and ids (16 bits each) of every row of docs (part, doc_id, text), in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary_path, end_id)
        if key not in _ENCODERS:
            _ENCODERS[key] = WordEncoder(vocabulary_path, end_id)
        for batch in pieces(batches, most=ENCODED):
            yield pa.RecordBatch.from_arrays([field(batch, "part"), field(batch, "doc_id"), pa.array(_ENCODERS[key].encode(field(batch, "text")), pa.binary())], names=["part", "doc_id", "ids"])

    return docs.select("part", "doc_id", "text").mapInArrow(run, "part int, doc_id long, ids binary")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits, by package-merge; 0 for ids without uses."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.r_[weight, packages]
        by = np.argsort(merged, kind="stable")
        levels.append(by)
        merged = merged[by]
        even = len(merged) // 2 * 2
        packages = merged[:even:2] + merged[1:even:2]
    take = 2 * n - 2  # items of the last level; each package takes two of the level before
    for by in reversed(levels):
        chosen = by[:take]
        symbols = chosen[chosen < n]
        lengths[order[symbols]] += 1
        take = 2 * int((chosen >= n).sum())
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    length = lengths[order].astype(np.int64)
    step = np.uint64(1) << (np.uint64(LIMIT) - length.astype(np.uint64))
    begin = np.cumsum(step) - step
    codes[order] = (begin >> (np.uint64(LIMIT) - length.astype(np.uint64))).astype(np.uint32)
    return codes


def write_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """(bit stream, 64-bit bit offsets of every CHECKPOINT-th id)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    begin = end - size
    shifted = codes[ids].astype(np.int64) << (24 - size - (begin & 7))
    at, total = begin >> 3, (int(end[-1]) + 7) // 8 + 3 if len(ids) else 0
    out = np.zeros(total)
    for k in range(3):
        out += np.bincount(at + k, weights=(shifted >> (16 - 8 * k)) & 255, minlength=total)[:total]
    return out.astype(np.uint8).tobytes(), begin[::CHECKPOINT].astype("<i8").tobytes()


class Decoder:
    def __init__(self, lengths: np.ndarray):
        codes = canonical_codes(lengths)
        self.id, self.size = np.zeros(1 << LIMIT, np.uint16), np.ones(1 << LIMIT, np.int64)
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        span = 1 << (LIMIT - lengths[used].astype(np.int64))
        filled = int(span.sum())
        self.id[:filled] = np.repeat(used, span)
        self.size[:filled] = np.repeat(lengths[used].astype(np.int64), span)
        assert not len(used) or codes[used[0]] == 0

    def read(self, bits: bytes, offsets: bytes, n: int) -> np.ndarray:
        data = np.frombuffer(bits + b"\0\0\0", dtype=np.uint8).astype(np.int64)
        place = np.frombuffer(offsets, dtype="<i8").copy()
        out = np.zeros((CHECKPOINT, len(place)), dtype=np.uint16)
        last = len(data) - 3
        for k in range(min(CHECKPOINT, n)):
            at = np.minimum(place >> 3, last)
            window = (data[at] << 16 | data[at + 1] << 8 | data[at + 2]) >> (8 - (place & 7)) & 0xFFFF
            out[k] = self.id[window]
            place += self.size[window]
        return out.T.reshape(-1)[:n]


def write(docs: DataFrame, path: str, end_id: int = 2, vocabulary_path: str | None = None, partition_bytes: int = PARTITION_BYTES, block_ids: int = BLOCK_IDS) -> None:
    """Writes docs (doc_id, text) to path/blocks and path/code."""
    spark = docs.sparkSession
    whole = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    parts = max(1, -(-whole // partition_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ranges of ids, and of texts and rows of one id, so that no id's rows need fit in one task
    rows = rows.withColumns({"text_hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(parts, "doc_id", "text_hash", "row").sortWithinPartitions("doc_id", "text_hash", "row")
    dealt = cut(token_ids(dealt.withColumn("part", F.spark_partition_id()), end_id, vocabulary_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in pieces(batches, "ids"):
            for part, raw in zip(field(batch, "part").to_pylist(), field(batch, "ids").to_pylist(), strict=True):
                seen = np.bincount(np.frombuffer(raw, dtype="<u2"), minlength=1 << 16)
                total[part] = total[part] + seen if part in total else seen
        for part, seen in total.items():
            used = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array(seen[used])], names=["part", "id", "n"])

    counted = cut(dealt.mapInArrow(count, "part int, id int, n long"))
    sizes = dict(counted.groupBy("part").agg(F.sum("n")).collect())  # a row for each partition
    starts, before = {}, 0
    for part in sorted(sizes):
        starts[part], before = before, before + sizes[part]
    counts = np.zeros(1 << 16, dtype=np.int64)
    for r in counted.groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(part, start, docs_, streams):
            stream = np.concatenate(streams)
            bits, offsets = write_bits(stream, codes, lengths)
            sizes_ = [len(s) for s in streams]
            return pa.RecordBatch.from_pylist([{"part": part, "start": start, "docs": docs_, "sizes": sizes_, "checkpoints": offsets, "bits": bits}], schema=layout)

        layout = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("bits", pa.binary())])
        part_now, start, held, docs_, streams = None, 0, 0, [], []
        for batch in pieces(batches, "ids"):
            for part, doc, raw in zip(field(batch, "part").to_pylist(), field(batch, "doc_id").to_pylist(), field(batch, "ids").to_pylist(), strict=True):
                stream = np.frombuffer(raw, dtype="<u2")
                if streams and (part != part_now or held + len(stream) > block_ids):
                    yield block(part_now, start, docs_, streams)
                    start, held, docs_, streams = start + held, 0, [], []
                if part != part_now:
                    part_now, start = part, starts[part]
                docs_.append(doc)
                streams.append(stream)
                held += len(stream)
        if streams:
            yield block(part_now, start, docs_, streams)

    dealt.mapInArrow(pack, "part int, start long, docs array<long>, sizes array<long>, checkpoints binary, bits binary").write.parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, and the ids if asked for."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first()[0]), dtype=np.uint8)  # 64 KB

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                docs_, sizes, start = field(batch, "docs")[i].as_py(), field(batch, "sizes")[i].as_py(), field(batch, "start")[i].as_py()
                stream = decoder.read(field(batch, "bits")[i].as_py(), field(batch, "checkpoints")[i].as_py(), sum(sizes)).astype("<u4")
                end = np.cumsum(sizes)
                own = [stream[e - n : e] for e, n in zip(end, sizes, strict=True)]
                columns = [pa.array(docs_, pa.int64()), pa.array(start + end - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    blocks = spark.read.parquet(f"{path}/blocks").select("start", "docs", "sizes", "checkpoints", "bits")
    return blocks.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of every document to files and reads them back."""
    path = shared_folder(spark, "token_files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return read(spark, path)
