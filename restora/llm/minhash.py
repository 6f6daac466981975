"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is the set of its distinct word shingles.  The sketch fills `t` coordinates by rounds: in
the first t rounds every element is thrown into one hashed bin per round, in the next t rounds round i
throws all elements into bin i, so every coordinate is certain to fill; the smallest (round, hash) wins
a bin, and filling stops after the round in which the last bin filled.  `bands` groups of `rows`
coordinates are hashed into buckets; documents that share a bucket are candidates, and links are
confirmed on the full sets.

Documents with equal sets form one class and go on as its smallest id, so groups of exact copies cost
one row.  In a bucket, members are first compared with the smallest one.  Members still in different
components afterwards are compared by an exact prefix-filtered join over their shingles, so hot buckets
make no pairs within what is linked already and no link between components is lost.  Before that each is
compared with the member of a shared prefix shingle that has the fewest shingles of its own: one row for
each place, which links most of what is left of a large group of near copies.

Results for special cases: null text or text without words is the empty set and linked with nothing;
with fewer than k words the whole sequence is one shingle; rows are told apart by doc_id and text, so rows
that share an id are each linked by their own text, and rows without one like others; a component's id is
the smallest doc_id in it, whose rows stay; if it has none one row (and its equals) stays, with a null
component_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from restora.llm.graph import components, cut, keyed_join
from restora.llm.textkit import Words, field, mix, pieces, randoms, signed, string_bytes


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles, ascending in each row, and the n+1 offsets of the rows."""
    data, offsets = string_bytes(column)
    n = len(offsets) - 1
    words = Words(data, offsets)
    first, value = words.shingles(k)
    doc = words.doc[first]
    count = np.bincount(words.doc, minlength=n) if len(words.doc) else np.zeros(n, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        begin = np.searchsorted(words.doc, short)
        total = randoms(k, 14)[count[short]].copy()
        for j, c in enumerate(randoms(k, 15) | np.uint64(1)):
            use = count[short] > j
            total[use] += words.hash[begin[use] + j] * c
        doc, value = np.r_[doc, short], np.r_[value, mix(total)]
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
    edge = np.searchsorted(doc, np.arange(n + 1))
    value = value.view(np.int64)  # ascending as Spark's longs
    parts, sizes = [], np.zeros(n + 1, dtype=np.int64)
    for i in range(n):
        if edge[i + 1] > edge[i]:
            s = np.sort(value[edge[i] : edge[i + 1]])
            s = s[np.r_[True, s[1:] != s[:-1]]]
            parts.append(s)
            sizes[i + 1] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.cumsum(sizes)


def sketches(values: np.ndarray, edge: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of every non-empty set (rows of empty ones stay at the largest value)."""
    n = len(edge) - 1
    out = np.full((n, t), np.uint64(0xFFFFFFFFFFFFFFFF))
    flat = out.reshape(-1)
    size = np.diff(edge)
    x, doc = values.view(np.uint64), np.repeat(np.arange(n), size)
    open_ = size > 0
    seeds = randoms(2 * t, 16)
    for i in range(2 * t):
        use = open_[doc]
        if not use.all():
            x, doc = x[use], doc[use]
        if not len(x):
            break
        h = mix(x ^ seeds[i])
        if i < t:
            at = (h >> np.uint64(40)) % np.uint64(t)
        else:
            at = np.uint64(i - t)
        value = (np.uint64(i) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
        np.minimum.at(flat, doc * t + at.astype(np.int64), value)
        open_ &= (out == np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    part = mix(sketch).reshape(len(sketch), bands, rows)
    total = np.zeros((len(sketch), bands), dtype=np.uint64) + randoms(bands, 17)[None, :]
    for j, c in enumerate(randoms(rows, 18) | np.uint64(1)):
        total += part[:, :, j] * c
    return mix(total)


def row_key(doc_id: Column, text: Column) -> Column:
    """A number for each different row (doc_id, text), null ids included."""
    return F.xxhash64(doc_id, text, doc_id.isNull())


def sketched(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, own, n_shingles, set_a and set_b (128 bits of the set), bands (empty for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values, edge = shingle_sets(field(batch, "text"), k)
            size = np.diff(edge)
            full = size > 0
            keys = band_keys(sketches(values, edge, bands * rows), bands, rows)[full]
            sums = []
            for seed in (np.uint64(0), np.uint64(0x5851F42D4C957F2D)):
                total = np.zeros(len(size), dtype=np.uint64)
                if full.any():
                    total[full] = np.add.reduceat(mix(values.view(np.uint64) ^ seed), edge[:-1][full])
                sums.append(total)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(full * bands)].astype(np.int32)), signed(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([field(batch, "doc_id"), field(batch, "own"), pa.array(size), signed(sums[0]), signed(sums[1]), lists], names=["doc_id", "own", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select("doc_id", "own", "text").mapInArrow(run, "doc_id long, own long, n_shingles long, set_a long, set_b long, bands array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and its sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values, edge = shingle_sets(field(batch, "text"), k)
            yield pa.RecordBatch.from_arrays([field(batch, "doc_id"), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(values))], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets' similarity is at least percent / 100."""
    a = sets.select(F.col("doc_id").alias("id_a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("doc_id").alias("id_b"), F.col("shingles").alias("set_b"))
    both = keyed_join(keyed_join(pairs, a, "a", "id_a").select("a", "b", "set_a"), b, "b", "id_b")
    same = F.size(F.array_intersect("set_a", "set_b"))
    sized = both.select("a", "b", same.alias("same"), (F.size("set_a") + F.size("set_b")).alias("total"))
    return sized.where(F.col("same") * 100 >= (F.col("total") - F.col("same")) * percent).select("a", "b")


def prefix_places(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, sig, df and place of the prefixes of docs (doc_id, n): what prefix_pairs joins.

    With a document's shingles in order of frequency, rarest first, linked documents share one of their
    first (100 - percent) % (prefix filter).  Shingles found in the same documents count once.
    """
    own = keyed_join(docs, sets.select(F.col("doc_id").alias("of"), "shingles"), "doc_id", "of")
    rows = own.select("doc_id", "n", F.explode("shingles").alias("s"))
    found = rows.groupBy("s").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("doc_id")).alias("sig")).where("df > 1").select(F.col("s").alias("t"), "df", "sig")
    shared = keyed_join(rows, found, "s", "t").select("doc_id", "n", "s", "df", "sig")
    of_doc = Window.partitionBy("doc_id")  # a document's own shingles
    place = F.col("n") - F.count("*").over(of_doc) + F.row_number().over(of_doc.orderBy("df", "sig", "s")) - 1
    first = shared.withColumn("place", place).where(f"100 * (n - place) >= {percent} * n")
    return cut(first.groupBy("doc_id", "n", "sig", "df").agg(F.min("place").alias("place")))


def prefix_pairs(first: DataFrame, percent: int, delegates: bool = False) -> DataFrame:
    """All pairs (a, b) of documents in different components (first: prefix_places with component) that may be linked.

    They share a shingle of their prefixes, early enough in both that what follows can reach the overlap that
    a link needs (position filter).  With delegates a document is paired only with one of those in which the shared
    shingle comes earliest, which have the least of their own: no more pairs than places.
    """
    mixed = first.groupBy("sig", "df").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("place", F.xxhash64("doc_id", "sig").alias("k"), "doc_id", "n", "component")).alias("best")).where("low <> high").select(F.col("sig").alias("g"), F.col("df").alias("h"), "best")
    left = keyed_join(first, mixed.drop("best"), "sig", "g", "left_semi")
    right = mixed.select("best.*", F.col("g").alias("sig"), F.col("h").alias("df")) if delegates else left
    right = right.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("component").alias("cb"), F.col("sig").alias("g"), F.col("df").alias("h"), F.col("place").alias("pb"))
    fits = f"component <> cb and 100 * least(n, m) >= {percent} * greatest(n, m) and {100 + percent} * least(n - place, m - pb) >= {percent} * (n + m)"
    on = (F.col("sig") == F.col("g")) & (F.col("df") == F.col("h")) & F.expr(fits if delegates else f"doc_id < b and {fits}")
    return left.join(right, on).select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and row_key of every row of docs (doc_id, text; other columns are ignored)."""
    own, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    docs = docs.select(row_key(own, text).alias("doc_id"), own.alias("own"), text.alias("text"))  # from here on rows go by their keys
    sketch = cut(sketched(docs, k, bands, rows))
    classes = sketch.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = cut(classes.select("rep", "n_shingles", F.xxhash64("set_a", "set_b", "n_shingles").alias("set_key"), "set_a", "set_b"))

    one = sketch.join(classes.select("rep"), sketch.doc_id == F.col("rep"), "left_semi").dropDuplicates(["doc_id"])
    keys = one.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    shared = keys.groupBy(F.col("band").alias("of")).agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = cut(keyed_join(keys, shared, "band", "of").select("band", "doc_id", "n_shingles", "pivot"))
    wanted = members.select(F.col("doc_id").alias("want")).distinct()
    sets = cut(full_sets(docs.join(wanted, docs.doc_id == F.col("want"), "left_semi").dropDuplicates(["doc_id"]), k))

    # Each document with its smallest pivot; then with each pivot that is not in its component.
    tested = cut(members.where("doc_id <> pivot").groupBy(F.col("doc_id").alias("b")).agg(F.min("pivot").alias("a")).select("a", "b"))
    links = cut(confirmed(tested, sets, percent))
    labels = components(links)
    sizes_fit = "100 * least(n, m) >= {p} * greatest(n, m)".format(p=percent)
    first = None
    for step in ("pivots", "delegates", "all"):
        named = keyed_join(members, labels, "doc_id", "node", "left").select("band", "doc_id", "n_shingles", "pivot", F.coalesce("component", "doc_id").alias("component"))
        mixed = named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select(F.col("band").alias("of"))
        apart = cut(keyed_join(named, mixed, "band", "of", "left_semi"))
        if apart.isEmpty():
            break
        if step != "pivots":
            open_ = apart.select("doc_id", F.col("n_shingles").alias("n"), "component").distinct()
            first = prefix_places(open_.drop("component"), sets, percent) if first is None else first
            of = open_.select(F.col("doc_id").alias("of"), "component")
            pairs = prefix_pairs(keyed_join(first, of, "doc_id", "of").drop("of"), percent, step == "delegates")
        else:
            left = apart.where("doc_id <> pivot").select("band", F.col("doc_id").alias("x"), F.col("n_shingles").alias("n"), F.col("component").alias("cx"), "pivot")
            right = apart.select(F.col("band").alias("of"), F.col("doc_id").alias("y"), F.col("n_shingles").alias("m"), F.col("component").alias("cy"))
            pairs = left.join(right, (F.col("band") == F.col("of")) & (F.col("pivot") == F.col("y"))).where("cx <> cy").where(sizes_fit)
            pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = cut(pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        found = cut(confirmed(pairs, sets, percent))
        tested = tested.unionByName(pairs)
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)

    named = keyed_join(classes, labels, "rep", "node", "left").select("set_key", "set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component"))
    of = sketch.select("doc_id", "own", "n_shingles", F.xxhash64("set_a", "set_b", "n_shingles").alias("set_key"))
    named = named.where("n_shingles > 0").select(F.col("set_key").alias("key"), "component")
    out = cut(keyed_join(of, named, "set_key", "key", "left").select("doc_id", "own", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component")))
    first = out.where("component is not null").groupBy(F.col("component").alias("c")).agg(F.min("own").alias("first"), F.min("doc_id").alias("first_key"))
    out = keyed_join(out, first, "component", "c", "left")
    kept = F.when(F.col("c").isNull(), True).when(F.col("first").isNull(), F.col("doc_id") == F.col("first_key")).otherwise(F.coalesce(F.col("own") == F.col("first"), F.lit(False)))
    return out.select(F.col("own").alias("doc_id"), "n_shingles", F.when(F.col("c").isNull(), F.col("own")).otherwise(F.col("first")).alias("component_id"), kept.alias("kept"), F.col("doc_id").alias("row_key"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at 80 % of their 4-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=4).drop("row_key")
